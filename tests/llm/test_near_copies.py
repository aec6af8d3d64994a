"""The pipeline drops edited copies just below the threshold of op2."""

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common, near_dup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_edited_copies_below_the_threshold_of_op2_go(spark):
    rows = []
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(100)]
        changed = [f"y{k}x{i}" for i in range(100)]
        rows.append((10 * k, " ".join(words)))
        rows.append((10 * k + 1, " ".join(words + changed[:60])))  # Jaccard 99 / 159 = 0.62
        rows.append((10 * k + 2, " ".join(words[:50] + changed[60:])))  # 49 / 139 = 0.35 at most
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if i % 10 != 1}
    assert near_dup.similar(docs).filter("n_links > 0").isEmpty()


def test_bands_keep_the_meeting_probability():
    assert near_dup.bands_for(near_dup.THRESHOLD) == near_dup.BANDS
    missed = [(1 - t**near_dup.ROWS_PER_BAND) ** near_dup.bands_for(t) for t in (near_dup.THRESHOLD, 0.6, near_dup.COPY_THRESHOLD)]
    assert max(missed) <= missed[0] + 1e-12 and missed[0] < 0.0003


def test_sets_without_a_common_ngram_are_never_linked():
    """Just below a power of two the bitmap is fullest; there it linked all that shared a key, in one group."""
    rng = np.random.default_rng(3)
    for size in (127, 511, 2000):
        sets = [np.unique(rng.integers(0, 1 << 48, size).astype(np.uint64)) for _ in range(30)]
        near = np.unique(np.concatenate([sets[0][: size * 4 // 5], rng.integers(0, 1 << 48, size // 5).astype(np.uint64)]))
        maps = [near_dup.bitmap(s, near_dup.bits_for(near_dup.COPY_THRESHOLD)) for s in [*sets, near]]
        order = sorted(range(31), key=lambda k: len([*sets, near][k]))
        i, j = near_dup._compatible(np.array([len([*sets, near][k]) for k in order]), [maps[k] for k in order], near_dup.COPY_THRESHOLD)
        assert {frozenset((order[a], order[b])) for a, b in zip(i, j)} == {frozenset((0, 30))}
    assert near_dup.bits_for(near_dup.THRESHOLD) == 1


@pytest.mark.parametrize("limit", [100, 7, 1])
def test_keys_in_parts(spark, limit):
    """In one broadcast, in several, and beyond what is broadcast."""
    docs = spark.createDataFrame([(k % 40, f"t{k}") for k in range(60)], "`in0` long, text string")
    keys = spark.createDataFrame([(k,) for k in range(10, 30)], "`in0` long")
    inside, outside = common.within(docs, keys, "in0", limit), common.without(docs, keys, "in0", limit)
    assert sorted(r["text"] for r in inside.collect()) == sorted(f"t{k}" for k in range(60) if 10 <= k % 40 < 30)
    assert sorted(r["text"] for r in outside.collect()) == sorted(f"t{k}" for k in range(60) if not 10 <= k % 40 < 30)
    assert set(inside.columns) == set(outside.columns) == {"in0", "text"}
