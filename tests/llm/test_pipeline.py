"""The pipeline: stages, order, and what each may drop, on planted rows."""

import random

import corpus_pipeline
from tessera.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 11)} and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "packing"]


def test_stages(spark, tmp_path):
    rng = random.Random(9)

    def text(n):
        return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))

    docs, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        docs.append((k, text(30) + (f" {rng.choice(['idiot', 'moron'])} " + text(5) if toxic else ""), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    clean = [r for r in docs if r[0] % 4]
    passage = text(30)
    docs += [(1000, clean[0][1], "en", "s", 1), (1001, clean[1][1].replace(" ", "  ", 3), "en", "s", 1), (1002, text(20) + " " + passage, "en", "s", 1), (1003, None, None, None, None), (1004, "", "en", "s", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(got.doc_id)
    gone = {r[0] for r in docs} - kept
    assert {1000, 1001, 1002, 1003, 1004} <= gone  # the last two have no tokens to pack
    toxic = {r[0] for r in docs[:240] if r[0] % 4 == 0}
    assert len(toxic & gone) >= 0.95 * len(toxic) and len((gone - toxic) - {1000, 1001, 1002, 1003, 1004}) <= 3


def test_stages_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
