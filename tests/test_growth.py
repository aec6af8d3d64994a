"""Steps that must not exchange or hold more than a document or a run of them, whatever the table's size."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from tessera import Analyzer, PositionEncoding, SearchIndex
from tessera.operators import index as X
from tessera.operators.highlight import highlight, highlight_everywhere
from tessera.queries import QUERIES
from tessera.schema import ORIGINAL
from tessera.sources.snapshot import read_snapshot, write_snapshot

ROOT = "/root/testdata/sf0.001"
ODD = [None, "", "—…", "Élan straße élan x_2-y", "x" * 9 + "7 9", "a" + "_-" * 9 + "b", "你好世界 hello 你好", "ünï 😀 ünï", "ªº café"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def odd(spark):
    rows = [("i" if k % 2 else "j", k, t, True) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "index_name string, doc_id bigint, content string, indexed boolean")


def test_positions_are_gathered_where_a_document_is_read(spark, odd):
    assert "Exchange" not in plan(QUERIES["forward_positions_documents"](spark, ROOT))
    want = {}
    for k, text in enumerate(ODD):
        for t in Analyzer().tokens(text or "", derive=False):
            want.setdefault((k, t.term), []).append((t.start, t.end))
    got = X.forward_positions(odd, Analyzer())
    assert {(r["doc_id"], r["term"]): [tuple(s) for s in r["spans"]] for r in got.collect()} == want
    assert X.forward_positions(odd.filter("doc_id < 2"), Analyzer()).count() == 0


@pytest.fixture
def writes(monkeypatch):
    """Plans of what is written as Parquet."""
    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(plan(self._df)), write(self, *a, **k))[1])
    return seen


def counted(docs):
    """(index, domain, term, id) -> (tf, dl) by the analyzer alone."""
    tf = Counter((i, t.domain, t.term, k) for i, k, text, _ in docs for t in Analyzer().tokens(text or ""))
    dl = Counter()
    for (i, domain, _, k), n in tf.items():
        dl[i, domain, k] += n
    return {key: (n, dl[key[0], key[1], key[3]]) for key, n in tf.items()}


def as_counted(rows):
    return {(r["index_name"], r["domain"], r["term"], r["doc_id"]): (r["tf"], r["dl"]) for r in rows}


def test_postings_are_counted_and_written_without_exchange(spark, odd, writes):
    stored = X.Index.build(odd).store()
    assert len(writes) == 1 and "Exchange" not in writes[0] and "Sort" not in writes[0]
    rows = stored.postings.collect()
    assert as_counted(rows) == counted(odd.collect()) and len(rows) == len(as_counted(rows))


def test_a_task_holds_a_run_of_postings(monkeypatch):
    monkeypatch.setattr(X, "_RUN", 3)
    names = ["i" if k % 2 else "j" for k in range(len(ODD) - 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(range(len(names)), pa.int64()), pa.array(ODD[1:])], names=["index_name", "doc_id", "content"])
    made = [b.to_pylist() for b in X._posting_rows(iter([batch]), Analyzer())]
    assert len(made) > 3
    for rows in made:
        keys = [(r["domain"], r["index_name"], r["term"].encode()) for r in rows]
        assert keys == sorted(keys)
    assert as_counted([r for rows in made for r in rows]) == counted([(i, k, t, True) for k, (i, t) in enumerate(zip(names, ODD[1:]))])


def test_rows_of_one_id_are_one_document(spark):
    rows = [("i", 1, "go go on", True), ("i", 1, "go off", True), ("i", 2, "go", True), ("i", None, "on", True), ("i", None, "on", True)]
    docs = spark.createDataFrame(rows, "index_name string, doc_id bigint, content string, indexed boolean")
    assert as_counted(X.Index.build(docs).postings.collect()) == {
        ("i", ORIGINAL, "go", 1): (3, 5),
        ("i", ORIGINAL, "on", 1): (1, 5),
        ("i", ORIGINAL, "off", 1): (1, 5),
        ("i", ORIGINAL, "go", 2): (1, 1),
        ("i", ORIGINAL, "on", None): (2, 2),
    }


@pytest.mark.parametrize("encoding", list(PositionEncoding))
def test_highlights_everywhere_exchange_no_text(spark, odd, encoding):
    assert "Exchange" not in plan(QUERIES["highlight_bytes"](spark, ROOT))
    terms = ["elan", "hello", "nihao", "ünï", "cafe", "uni"]
    wanted = odd.select(F.lit("q").alias("query_id"), "index_name", "doc_id", F.array(*map(F.lit, terms)).alias("terms"))
    got, want = highlight_everywhere(odd, terms, encoding=encoding).collect(), highlight(odd, wanted, encoding=encoding).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["doc_id"] for r in got} == {3, 6, 7, 8}


def test_snapshots_exchange_no_postings(spark, odd, writes, tmp_path):
    built = X.Index.build(odd).store()
    writes.clear()
    write_snapshot(built, str(tmp_path), "i")
    postings = [p for p in writes if "term" in p and "sum" not in p]
    assert len(postings) == 1 and "Exchange" not in postings[0] and "Sort" not in postings[0]
    rows = read_snapshot(spark, str(tmp_path)).postings.collect()
    assert as_counted(rows) == {k: v for k, v in counted(odd.collect()).items() if k[0] == "i"}


def test_snapshots_of_changed_indexes_are_sorted(spark, odd, writes, tmp_path):
    changed = X.Index.build(odd).remove(odd.filter("doc_id = 3"))
    write_snapshot(changed, str(tmp_path), "i")
    assert any("Sort [domain" in p for p in writes)
    assert 3 not in {r["doc_id"] for r in read_snapshot(spark, str(tmp_path)).postings.collect()}


def test_changes_without_lengths_tokenize_nothing(spark, odd, monkeypatch):
    monkeypatch.setattr("tessera.queries.built", None)
    assert "MapInArrow" not in plan(QUERIES["dirty_deleted"](spark, ROOT))
    store = SearchIndex(spark, Analyzer(), id_type="bigint")
    store.add_docs(odd)
    dirty, _ = store.take_dirty_and_deleted()
    length = Counter()
    for (_, domain, _, k), (n, _) in counted(odd.collect()).items():
        length[k] += n * (domain == ORIGINAL)
    assert {r["doc_id"]: r["doc_len"] for r in dirty.collect()} == {k: length[k] for k in range(len(ODD))}


def test_staged_documents_are_not_joined(spark):
    found = plan(QUERIES["staged_docs_stats"](spark, ROOT))
    assert not re.search(r"hashpartitioning\([^)]*doc_id", found)


def test_terms_are_not_gathered_in_one_task_for_their_statistics(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = plan(QUERIES["idf_table"](spark, ROOT))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in found and re.findall(r"hashpartitioning\((\w+)#\d+, (\w+)#\d+, (\w+)", found) == [("index_name", "domain", "term")]


def test_lengths_are_summed_before_documents_are_joined(spark):
    found = plan(QUERIES["length_recovery"](spark, ROOT))
    below = found[found.index("Join") :]
    assert re.search(r"HashAggregate\(keys=\[index_name#\d+, domain#\d+, doc_id#\d+L\], functions=\[partial_sum\(tf", below)


def test_a_search_exchanges_no_postings_for_its_index(spark, writes):
    QUERIES["auto_route_ascii"](spark, f"{ROOT}/")  # a path of its own, so that the index is built here
    postings = [p for p in writes if "MapInArrow" in p]
    assert len(postings) == 1 and "Exchange" not in postings[0] and "Sort" not in postings[0]
