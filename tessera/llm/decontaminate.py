"""Benchmark decontamination by winnowing.

Every text is a sequence of lower-cased words (see ``textops``).  Of each window of ``w`` consecutive
k-grams the smallest hash (the rightmost of equal ones) is kept as a fingerprint, for documents and
benchmark items alike; fingerprints are joined, and of every pair of a document and an item that
share one, each hit is extended word by word to the whole shared span.  Two texts that share
``k + w - 1`` words or more always share a fingerprint at the same places, so every shared span of at
least ``k + w - 1`` (13) words is reported, and no shorter one.

Only (row, fingerprint) goes through the join, each once: a text that repeats itself sends no more
rows than one that doesn't, and both texts of a pair are read once.  Before the join, document
fingerprints pass a bitmap of fixed size (``FILTER_BITS``) that holds the benchmark's fingerprints.
It only saves shuffling: with a huge benchmark it lets more through, and the result is the same.

Defined results
* null or empty text, on either side: no words, no spans; the document is clean.
* items or documents of fewer than 13 words: never matched (below the guarantee).
* repeated rows (same id and text): reported once; all of them go in ``clean``.
* null ids are ids like others; ids may be of any type and keep it.
* ties and repeats inside a text: every pair of places is a span of its own, so an item's passage
  found twice in one text gives two, and a text of one repeated word gives one for every shift
  against another such text.
* very long texts: read whole.  Spans grow with the texts' lengths; the time for a pair grows with the
  product of their lengths only where both repeat the same passage very often.
* empty tables: no spans.  Extra columns are carried through ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, cut, fresh, row_key, small_side, small_texts, table, type_of
from .textops import WORD, Words, gram_hashes, row_slices, scan_words, string_parts

K, W = 8, 6
MIN_WORDS = K + W - 1
FILTER_BITS = 24
#: Pairs of places of one fingerprint that are listed; for more, all shifts between the outermost are tried.
_LISTED = 1 << 22


def winnow(hashes: np.ndarray, row_end: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the fingerprints among k-gram hashes; row_end: for each, its row's end in words."""
    n = len(hashes)
    at = np.arange(n)
    selected = np.zeros(n, bool)
    starts = np.flatnonzero(at[: max(0, n - w + 1)] + (k + w - 1) <= row_end[: max(0, n - w + 1)])
    if len(starts):
        least = hashes[: n - w + 1].copy()
        for j in range(1, w):
            np.minimum(least, hashes[j : n - w + 1 + j], out=least)
        open_ = np.zeros(n - w + 1, bool)
        open_[starts] = True
        for j in range(w - 1, -1, -1):
            hit = open_ & (hashes[j : n - w + 1 + j] == least)
            selected[np.flatnonzero(hit) + j] = True
            open_ &= ~hit
    return np.flatnonzero(selected)


def _prints(batches: Iterator[pa.RecordBatch], k: int, w: int, keep: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = string_parts(batch.column("text"))
        keys = batch.column("key")
        for a, b in row_slices(offsets):
            words = scan_words(raw, offsets[a : b + 1])
            grams, inside = gram_hashes(words, k)
            if not inside.any():
                continue
            row_of = np.repeat(np.arange(a, b), np.diff(words.offsets))
            pos = winnow(grams, words.offsets[1:][row_of - a], k, w)
            fp, rows = grams[pos], row_of[pos]
            if keep is not None:
                slot = (fp & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                held = (keep[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                fp, rows = fp[held], rows[held]
            order = np.lexsort((fp, rows))
            fp, rows = fp[order], rows[order]
            new = np.ones(len(fp), bool)
            new[1:] = (fp[1:] != fp[:-1]) | (rows[1:] != rows[:-1])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[new])), pa.array(fp[new].view(np.int64))], names=["key", "fp"])


def fingerprints(texts: DataFrame, k: int = K, w: int = W, keep: np.ndarray | None = None) -> DataFrame:
    """(key, fp), each once, of the rows of ``texts`` (key, text)."""
    lower = texts.select("key", F.lower("text").alias("text")).filter("text is not null")
    return lower.mapInArrow(lambda batches: _prints(batches, k, w, keep), "key long, fp long")


def _shifts(mine: Words, theirs: Words, k: int, w: int) -> np.ndarray:
    """Places in the first text less places in the second, of all fingerprints that both have."""
    found = []
    for words in (mine, theirs):
        grams, _ = gram_hashes(words, k)
        pos = winnow(grams, np.full(len(grams), len(words.hashes)), k, w)
        order = np.argsort(grams[pos], kind="stable")
        found.append((grams[pos][order], pos[order]))
    (fa, pa_), (fb, pb) = found
    room = len(theirs.hashes)
    seen = np.zeros(len(mine.hashes) + room + 1, bool)
    for fp in np.intersect1d(fa, fb):
        a = pa_[np.searchsorted(fa, fp, "left") : np.searchsorted(fa, fp, "right")]
        b = pb[np.searchsorted(fb, fp, "left") : np.searchsorted(fb, fp, "right")]
        if len(a) * len(b) <= _LISTED:
            seen[(a[:, None] - b[None, :] + room).ravel()] = True
        else:
            seen[a.min() - b.max() + room : a.max() - b.min() + room + 1] = True
    return np.flatnonzero(seen) - room


def spans_of(mine: Words, theirs: Words, k: int = K, w: int = W) -> np.ndarray:
    """(places in the first text, places in the second, words): the maximal shared spans of two texts."""
    shifts = _shifts(mine, theirs, k, w)
    if not len(shifts):
        return np.zeros((0, 3), np.int32)
    both = np.unique(np.concatenate([mine.hashes, theirs.hashes]), return_inverse=True)[1].astype(np.int32)
    a, b = both[: len(mine.hashes)], both[len(mine.hashes) :]
    least, out = k + w - 1, []
    for shift in shifts.tolist():
        lo, hi = max(0, -shift), min(len(b), len(a) - shift)
        if hi - lo < least:
            continue
        unequal = np.flatnonzero(a[lo + shift : hi + shift] != b[lo:hi])
        if not len(unequal):
            out.append((lo + shift, lo, hi - lo))
            continue
        edges = np.concatenate([[-1], unequal, [hi - lo]])
        for x in np.flatnonzero(np.diff(edges) > least).tolist():
            start = lo + int(edges[x]) + 1
            out.append((start + shift, start, int(edges[x + 1] - edges[x]) - 1))
    return np.array(out, np.int32).reshape(-1, 3)


def _extend(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    """The shared spans of every pair of a document and an item."""
    for batch in batches:
        texts, items = string_parts(batch.column("text")), string_parts(batch.column("item_text"))
        for r in range(len(batch)):
            spans = spans_of(scan_words(texts[0], texts[1][r : r + 2]), scan_words(items[0], items[1][r : r + 2]), k, w)
            for at in range(0, len(spans), 100_000):
                part = spans[at : at + 100_000]
                take = pa.array(np.full(len(part), r))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(take) for c in ("key", "doc_id", "item_id")], *[pa.array(np.ascontiguousarray(part[:, c])) for c in range(3)]],
                    names=["key", "doc_id", "item_id", "doc_start", "item_start", "n_words"],
                )


def _spans(docs: DataFrame, benchmark: DataFrame, k: int, w: int) -> DataFrame:
    """Spans with the key of the document's row."""
    items = benchmark.select("item_id", "text").filter("text is not null").select(row_key("item_id").alias("key"), "item_id", "text").dropDuplicates(["key"])
    theirs = cut(fingerprints(items, k, w).select(F.col("key").alias("item_key"), "fp"))
    slots = theirs.select(F.expr(f"fp & {(1 << FILTER_BITS) - 1}").cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()  # FILTER_BITS bits at most
    keep = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    np.bitwise_or.at(keep, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
    rows = docs.select("doc_id", "text").filter("text is not null").select(row_key().alias("key"), "doc_id", "text")
    mine = fingerprints(rows.select("key", "text"), k, w, keep)
    pairs = cut(mine.join(small_side(theirs), "fp").select("key", "item_key").distinct())
    item_texts = small_texts(items.select(F.col("key").alias("item_key"), "item_id", F.lower("text").alias("item_text")), "item_text")
    found = rows.join(small_side(pairs), "key").join(item_texts, "item_key")
    return found.select("key", "doc_id", "item_id", F.lower("text").alias("text"), "item_text").mapInArrow(
        lambda batches: _extend(batches, k, w),
        f"key long, doc_id {type_of(docs, 'doc_id')}, item_id {type_of(benchmark, 'item_id')}, doc_start int, item_start int, n_words int",
    )


def shared_spans(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Every span of ``k + w - 1`` words or more that a document shares with a benchmark item:
    (doc_id, item_id, doc_start, item_start, n_words), positions counted in words."""
    return _spans(docs, benchmark, k, w).drop("key").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """``docs`` without the rows that share such a span."""
    (key,) = fresh(docs, "key")
    dirty = cut(_spans(docs, benchmark, k, w).select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, row_key()).join(small_side(dirty), key, "left_anti").select(*columns_of(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(lower(text), '{WORD}')"
ORACLE_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
     b AS (SELECT DISTINCT item_id, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL),
     dg AS (SELECT doc_id, p, array_to_string(words[p + 1 : p + {MIN_WORDS}], ' ') AS gram
            FROM (SELECT doc_id, words, unnest(range(len(words) - {MIN_WORDS - 1})) AS p FROM d WHERE len(words) >= {MIN_WORDS})),
     bg AS (SELECT item_id, p, array_to_string(words[p + 1 : p + {MIN_WORDS}], ' ') AS gram
            FROM (SELECT item_id, words, unnest(range(len(words) - {MIN_WORDS - 1})) AS p FROM b WHERE len(words) >= {MIN_WORDS})),
     hits AS (SELECT DISTINCT doc_id, item_id, dg.p AS dp, bg.p AS bp FROM dg JOIN bg USING (gram)),
     runs AS (SELECT *, bp - row_number() OVER (PARTITION BY doc_id, item_id, dp - bp ORDER BY bp) AS island FROM hits)
SELECT doc_id, item_id, CAST(min(dp) AS INTEGER) AS doc_start, CAST(min(bp) AS INTEGER) AS item_start,
       CAST(count(*) + {MIN_WORDS - 1} AS INTEGER) AS n_words
FROM runs GROUP BY doc_id, item_id, dp - bp, island
"""
