"""Extra columns of any name, and ids that aren't numbers: every operator and every pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, decontaminate, exact_dedup, langid, license_scan, lm_score, near_dup, packing, toxicity, url_filter

CLASHES = ["__len", "__full", "__head", "__rank", "__key", "__row_key", "key", "rank", "n_chars", "a.b", "a`b", "TEXT_", "component", "members", "spread", "tile", "class", "score", "places"]
PASSAGE = " ".join(f"w{k}" for k in range(40))


def with_clashes(df, but=()):
    for k, name in enumerate(CLASHES):
        if name not in but:
            df = df.withColumn(name, F.lit(777 + k))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"id-{k}", " ".join(f"v{k}x{i}" for i in range(30)), "en", "s") for k in range(6)]
    rows += [("copy", rows[0][1], "en", "s"), ("near", rows[1][1] + " more", "en", "s"), ("leak", PASSAGE, "en", "s"), (None, None, None, None), ("copy", rows[0][1], "en", "s"), ("bad", "what an idiot", "en", "s")]
    return with_clashes(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string"))


@pytest.fixture(scope="module")
def bench(spark):
    return with_clashes(spark.createDataFrame([("item", PASSAGE)], "item_id string, text string"))


def unchanged(got, docs):
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[name] == 777 + k for r in rows for k, name in enumerate(CLASHES))
    return sorted(str(r["doc_id"]) for r in rows)


EVERY = ["None", "bad", "copy", "copy", "id-0", "id-1", "id-2", "id-3", "id-4", "id-5", "leak", "near"]


def test_filters_carry_every_column(docs, bench):
    assert unchanged(decontaminate.clean(docs, bench), docs) == [i for i in EVERY if i != "leak"]
    assert unchanged(exact_dedup.keep_first(docs), docs) == [i for i in EVERY if i not in ("id-0", "copy")] [:2] + ["copy"] + [i for i in EVERY if i not in ("id-0", "copy")][2:]
    assert unchanged(near_dup.one_of_each(docs), docs) == ["None", "bad", "copy", "id-1", "id-2", "id-3", "id-4", "id-5", "leak"]


def test_queries_keep_string_ids(spark, docs, bench):
    assert [tuple(r) for r in decontaminate.shared_spans(docs, bench).collect()] == [("leak", "item", 0, 0, 40)]
    assert sorted(map(tuple, exact_dedup.copies(docs).collect())) == [("copy", "copy"), ("id-0", "copy")]
    assert {tuple(r) for r in near_dup.similar(docs).filter("n_links > 0").collect()} == {("copy", "copy", 1), ("id-0", "copy", 1), ("id-1", "id-1", 1), ("near", "id-1", 1)}
    for df in (lm_score.score_corpus(docs), langid.classify(docs, None), toxicity.classify(docs, None)):
        assert sorted(str(r["doc_id"]) for r in df.collect()) == EVERY
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == set(EVERY) - {"None"}
    assert license_scan.scan(docs.withColumn("text", F.lit("All rights reserved"))).count() == len(EVERY)


def test_classifiers_learn_with_string_ids(spark, docs):
    labels = spark.createDataFrame([(f"id-{k}", 0) for k in range(6)] + [("bad", 1), ("bad", 1)], "doc_id string, toxic int")
    model = toxicity.fit(docs, labels)
    assert unchanged(toxicity.keep_clean(docs, model), docs) and toxicity.classify(docs, model).count() == len(EVERY)
    assert langid.classify(docs, langid.fit(docs)).count() == len(EVERY)


def test_packing_reads_no_other_column(docs):
    rows = [sorted(map(tuple, packing.pack(d).collect())) for d in (docs, docs.drop("n_chars"))]
    assert rows[0] == rows[1]


def test_pages_and_conversations(spark):
    pages = with_clashes(spark.createDataFrame([("p", "http://a.test/", None)], "page_id string, url string, html string"))
    assert url_filter.decide(pages).first()["page_id"] == "p"
    turns = with_clashes(spark.createDataFrame([("c", 0, "user", "hi")], "conv_id string, turn int, role string, text string"))
    assert chat.render(turns).first()["conv_id"] == "c"


def test_stages(spark, docs, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(f"id-{k}", 0, 0) for k in range(6)], "doc_id string, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            unchanged(now, docs)
    assert {r["doc_id"] for r in now.collect()} == {"bad", "copy", "id-1", "id-2", "id-3", "id-4", "id-5"}
