"""Decontamination, near duplicates, exact duplicates: against SQL or brute force on small tables."""

import itertools
import random
import time

import duckdb
import numpy as np
import pytest
import regex

from tessera.llm import components, decontaminate, exact_dedup, near_dup, textops

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROOT = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(rng, n, kinds=5000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def cut(text):
    return regex.findall(textops.WORD, text.lower())


def grams(text, n=near_dup.N):
    w = cut(text)
    return set(zip(*[w[k:] for k in range(n)]))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(k, " ".join(words(rng, rng.choice([3, 20, 80, 300])))) for k in range(60)]
    for k in range(60, 110):
        base = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(0, 6)):
            base[rng.randrange(len(base))] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(base)))
    rows += [(110, None), (111, ""), (112, "one"), (113, "one"), (None, rows[3][1]), (114, rows[7][1].upper()), (115, rows[7][1])]
    rows += [(115, rows[7][1]), (116, "ha " * 20_000), (117, "ha " * 20_001)]
    return rows


def brute_links(rows, threshold=near_dup.THRESHOLD):
    """{(id, text): linked (id, text)} of distinct rows."""
    docs = sorted(set(rows), key=str)
    sets = [grams(t) if t is not None else set() for _, t in docs]
    out = {d: set() for d in docs}
    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
            out[docs[a]].add(docs[b])
            out[docs[b]].add(docs[a])
    return out


def brute_classes(links):
    class_of = {}
    for d in links:
        seen, todo = {d}, [d]
        while todo:
            for e in links[todo.pop()] - seen:
                seen.add(e)
                todo.append(e)
        class_of[d] = min((i for i, _ in seen if i is not None), default=None)
    return class_of


@pytest.mark.parametrize("tile_rows, tile_grams", [(512, 2_000_000), (3, 2_000_000), (512, 500)])
def test_similar_equals_brute_force(spark, corpus, monkeypatch, tile_rows, tile_grams):
    """In one tile a group, and with groups and blocks parted in bands and chunks."""
    monkeypatch.setattr(near_dup, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(near_dup, "TILE_GRAMS", tile_grams)
    got = sorted(map(tuple, near_dup.similar(table(spark, corpus)).collect()), key=str)
    links = brute_links(corpus)
    classes = brute_classes(links)
    assert got == sorted([(i, classes[i, t] if links[i, t] else i, len(links[i, t])) for i, t in links], key=str)


@pytest.mark.parametrize("tile_rows", [512, 3])
def test_one_of_each(spark, corpus, monkeypatch, tile_rows):
    monkeypatch.setattr(near_dup, "TILE_ROWS", tile_rows)
    docs = table(spark, corpus).withColumnRenamed("source", "key")
    got = near_dup.one_of_each(docs)
    assert got.columns == docs.columns
    links = brute_links(corpus)
    classes = brute_classes(links)
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = {(i, t) for i, t in links if not links[i, t] or i == classes[i, t]}
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_large_group_of_near_copies(spark):
    """300 different texts that are all near copies of one another: 299 links each, in one class."""
    words_ = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(words_[: k % 100] + [f"x{k}"] + words_[k % 100 + 1 :])) for k in range(300)]
    got = near_dup.similar(table(spark, rows)).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 299)} and len(got) == 300


def test_near_dup_empty(spark):
    assert near_dup.similar(table(spark, [])).isEmpty()
    assert near_dup.one_of_each(table(spark, [])).isEmpty()


def test_bitmap_bounds_overlap():
    rng = np.random.default_rng(1)
    for n in (5, 70, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 48, n // 3).astype(np.uint64)]))
        x, y = near_dup.bitmap(a), near_dup.bitmap(b)
        while len(x) != len(y):
            if len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            else:
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5), (None, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def brute_spans(docs, items):
    out = set()
    for i, t in docs:
        for j, u in items:
            if t is None or u is None:
                continue
            a, b = cut(t), cut(u)
            for shift in range(-len(b) + 1, len(a)):
                run = 0
                for k in range(max(0, -shift), min(len(b), len(a) - shift) + 1):
                    if k < min(len(b), len(a) - shift) and a[k + shift] == b[k]:
                        run += 1
                        continue
                    if run >= decontaminate.MIN_WORDS:
                        out.add((i, j, k - run + shift, k - run, run))
                    run = 0
    return out


def test_decontaminate(spark):
    rng = random.Random(3)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([5, 12, 13, 14, 40, 60])] + [(6, None), (7, ""), (8, "so so so " * 8), (None, " ".join(words(rng, 20)))]
    docs = [(k, " ".join(words(rng, 30))) for k in range(20)]
    for k in range(20, 50):
        source = items[rng.choice([1, 2, 3, 4, 5])][1].split()
        a = rng.randrange(max(1, len(source) - 12))
        docs.append((k, " ".join(words(rng, 7) + source[a : a + rng.randrange(8, 40)] + words(rng, 9)).title()))
    docs += [(50, None), (51, ""), (52, "so " * 30), (None, items[4][1]), (53, items[9][1]), (54, items[5][1] + " " + items[5][1]), (54, items[5][1] + " " + items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table_ = table(spark, docs).withColumnRenamed("source", "key")
    want = brute_spans(docs, items)
    got = {tuple(r) for r in decontaminate.shared_spans(table_, bench).collect()}
    assert got == want and len(want) > 10
    dirty = {i for i, *_ in want}
    clean = decontaminate.clean(table_, bench)
    assert clean.columns == table_.columns
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(i) for i, _ in docs if i not in dirty)
    assert decontaminate.shared_spans(table(spark, []), bench).isEmpty()
    assert decontaminate.clean(table_, bench.limit(0)).count() == len(docs)


PASSAGES = {
    "chinese": "\u4f60\u597d\u4e16\u754c\u8fd9\u662f\u4e00\u6bb5\u7528\u6765\u6d4b\u8bd5\u7684\u4e2d\u6587\u6587\u672c\uff0c\u5b83\u6ca1\u6709\u7a7a\u683c\u3002" * 3,
    "japanese": "\u3053\u308c\u306f\u6771\u4eac\u3067\u66f8\u304b\u308c\u305f\u30c6\u30b9\u30c8\u306e\u6587\u7ae0\u3067\u3059\u3002\u7a7a\u767d\u306f\u3042\u308a\u307e\u305b\u3093" * 3,
    "thai": "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22\u0e44\u0e21\u0e48\u0e21\u0e35\u0e0a\u0e48\u0e2d\u0e07\u0e27\u0e48\u0e32\u0e07\u0e23\u0e30\u0e2b\u0e27\u0e48\u0e32\u0e07\u0e04\u0e33" * 3,
    "quoted": "\u201cWe don\u2019t know\u201d, she said \u2014 and nobody else in that long \u00abhouse\u00bb ever knew what it was for",
}


@pytest.mark.parametrize("name", PASSAGES)
def test_passages_in_every_script(spark, name):
    passage = PASSAGES[name]
    plain = passage.translate(str.maketrans("\u201c\u201d\u2019\u2014\u00ab\u00bb", "\"\"'-\"\""))
    docs = table(spark, [(1, "before it " + plain + " after it"), (2, "clean text of no interest to anyone at all " * 3), (3, passage + "!"), (4, plain)])
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    spans = {}
    for r in decontaminate.shared_spans(docs, bench).collect():
        spans[r["doc_id"]] = max(spans.get(r["doc_id"], 0), r["n_words"])
    assert spans == dict.fromkeys((1, 3, 4), len(cut(passage)))
    classes = {r["doc_id"]: r["class_id"] for r in near_dup.similar(docs).collect()}
    assert classes[3] == classes[4] and classes[2] == 2


def test_words():
    texts = ["Don\u2019t stop", "a\u4f60b\u597d", "\u00e9t\u00e9 \u00ab na\u00efve \u00bb", "", "\u0e44\u0e17\u0e22", "x\u200by", "\U00020000\U0001f600z", "e\u0301a", "\u043f\u0440\u0438\u0432\u0435\u0442, \u043c\u0438\u0440", "\uc548\ub155 1\u00bd"]
    import pyarrow as pa

    raw, offsets = textops.string_parts(pa.array([t.lower() for t in texts]))
    found = textops.scan_words(raw, offsets)
    for r, t in enumerate(texts):
        own = range(found.offsets[r], found.offsets[r + 1])
        assert [bytes(raw[found.starts[k] : found.ends[k]]).decode() for k in own] == cut(t)


def test_repetitive_texts_in_linear_rows(spark):
    """A text of one word 50,000 times against its like: every shift is a span; no row holds a whole text."""
    began = time.time()
    long = "so " * 50_000
    docs, bench = table(spark, [(1, long), (2, "one two " * 3_000)]), spark.createDataFrame([(7, long), (8, "one two " * 2_000)], "item_id long, text string")
    got = {tuple(r): c for *r, c in decontaminate.shared_spans(docs, bench).groupBy("doc_id", "item_id").count().collect()}
    assert got == {(1, 7): 2 * (50_000 - decontaminate.MIN_WORDS) + 1, (2, 8): (6_000 - decontaminate.MIN_WORDS) // 2 + (4_000 - decontaminate.MIN_WORDS) // 2 + 1}
    assert decontaminate.clean(docs, bench).isEmpty()
    assert time.time() - began < 60


def test_fingerprints_above_the_listing_limit(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_LISTED", 4)
    docs, items = [(1, "so " * 40 + "end"), (2, "a b " * 20 + "so " * 15)], [(1, "so " * 20), (2, "b a " * 12)]
    got = {tuple(r) for r in decontaminate.shared_spans(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_spans(docs, items)


def test_winnowing_guarantee():
    rng = np.random.default_rng(4)
    for _ in range(50):
        h = rng.integers(0, 50, rng.integers(1, 60)).astype(np.uint64)
        k, w = 3, 5
        picked = set(decontaminate.winnow(h, np.full(len(h), len(h) + k - 1), k, w).tolist())
        for start in range(len(h) - w + 1):
            window = range(start, start + w)
            assert picked & {p for p in window if h[p] == h[start : start + w].min()}


def test_exact_dedup(spark):
    rows = [(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None), (6, ""), (7, ""), (8, "b "), (9, "x" * 300 + "1"), (10, "x" * 300 + "2"), (11, "x" * 300 + "1"), (1, "a"), (None, "b")]
    docs = table(spark, rows).withColumnRenamed("lang", "__copy")
    assert sorted(map(tuple, exact_dedup.copies(docs).collect()), key=str) == sorted([(3, 1), (7, 6), (11, 9), (1, 1), (None, 2)], key=str)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5, 6, 8, 9, 10]
    assert exact_dedup.copies(table(spark, [])).isEmpty() and exact_dedup.keep_first(table(spark, [])).isEmpty()


@pytest.mark.parametrize("module", [decontaminate, exact_dedup, near_dup])
def test_queries_equal_sql(spark, module):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{ROOT}/{name}.parquet')")
    want = con.execute(module.ORACLE_SQL).df()
    got = module.query(spark, ROOT).toPandas()
    assert len(want) and set(map(tuple, got[list(want.columns)].values)) == set(map(tuple, want.values)) and len(got) == len(want)
