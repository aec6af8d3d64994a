import pytest

from tessera import DictionaryConfig, PositionEncoding, ScriptDictionary, SearchIndex, SearchMode
from tessera.functions.pinyin import readings
from tessera import Analyzer

I = "test-index"
DOCS = {
    "doc-cn": "你好世界",
    "doc-en": "fuzzy search handles typos",
    "doc-jp": "こんにちは世界",
    "case": "SEARCH-ENGINE",
    "alnum": "version2 stable",
    "go": "go go",
    "greet": "nihao greeting",
    "kana": "東京へようこそ",
    "f1": "apple banana",
    "f2": "apple banana cherry",
    "f3": "apple",
    "poly": "重庆火锅",
    "camel": "searchEngine",
    "uni": "北京大学",
    "mixed": "hello 世界",
    "oov": "明博",
    "plan": "方案",
    "news": "公司将在内存短缺之际退出手机内存市场",
    "id": "BXRtA7Zq3eo_mXkKWTGcd",
}


@pytest.fixture(scope="module")
def index(spark):
    made = SearchIndex(spark)
    made.add_docs(spark.createDataFrame([(I, k, v) for k, v in DOCS.items()], "index_name string, doc_id string, content string"))
    made.compact()
    return made


CASES = [
    ("nihao", "auto", {"greet"}, {"doc-cn"}),
    ("nihao", "exact", {"greet"}, {"doc-cn"}),
    ("nihao", "pinyin", {"doc-cn"}, {"greet"}),
    ("nh", "auto", {"doc-cn"}, set()),
    ("nhs", "auto", {"doc-cn"}, set()),
    ("nih", "auto", {"doc-cn"}, set()),
    ("nihap", "fuzzy", {"greet"}, {"doc-cn"}),
    ("fuzze", "auto", {"doc-en"}, set()),
    ("search-engine", "exact", {"case"}, {"camel"}),
    ("versoin2", "fuzzy", {"alnum"}, set()),
    ("serch-engine", "fuzzy", {"case"}, set()),
    ("go", "fuzzy", {"go"}, set()),
    ("こん", "auto", {"doc-jp"}, set()),
    ("dongjing", "pinyin", set(), {"kana"}),
    ("apple banana cherry", "exact", {"f1", "f2"}, {"f3"}),
    ("zhongqing", "pinyin", {"poly"}, set()),
    ("chongqing", "pinyin", {"poly"}, set()),
    ("serchengine", "auto", {"camel"}, set()),
    ("ＮＩＨＡＯ", "pinyin", {"doc-cn"}, set()),
    ("北景大学", "auto", {"uni"}, set()),
    ("hello 世界", "auto", {"mixed"}, set()),
    ("明搏", "auto", {"oov"}, set()),
    ("applr banaan", "fuzzy", {"f1", "f2"}, {"f3"}),
    ("方桉", "auto", {"plan"}, set()),
    ("BXRtA7Zq3eo_mXkKWTGcd", "exact", {"id"}, set()),
    ("apple apple apple", "exact", set(), {"f1", "f2", "f3"}),
    ("apple zzz", "exact", {"f1", "f2", "f3"}, set()),
    ("*", "auto", set(DOCS), set()),
]


@pytest.fixture(scope="module")
def answers(spark, index):
    out = {}
    for mode in SearchMode:
        rows = [(str(k), I, q) for k, (q, m, _, _) in enumerate(CASES) if m == mode.value]
        hits = index.search_batch(spark.createDataFrame(rows, "query_id string, index_name string, text string"), mode).collect()
        for k, *_ in rows:
            out[int(k)] = {h["doc_id"]: h for h in hits if h["query_id"] == k}
    return out


@pytest.mark.parametrize("k", range(len(CASES)), ids=[f"{m}-{q}" for q, m, _, _ in CASES])
def test_search(k, answers):
    _, _, wanted, unwanted = CASES[k]
    assert wanted <= set(answers[k])
    assert not unwanted & set(answers[k])


def test_scores(answers):
    hits = answers[next(k for k, c in enumerate(CASES) if c[0] == "apple banana cherry")]
    assert hits["f2"]["score"] > hits["f1"]["score"]
    fuzzy = answers[next(k for k, c in enumerate(CASES) if c[0] == "fuzze")]
    assert [tuple(m) for m in fuzzy["doc-en"]["matched_terms"]] == [("fuzzy", "original")]
    full = answers[next(k for k, c in enumerate(CASES) if c[0] == "ＮＩＨＡＯ")]
    assert {m["domain"] for m in full["doc-cn"]["matched_terms"]} == {"pinyin_full"}


def test_auto_pinyin_typo(spark):
    one = SearchIndex(spark)
    one.add_doc(I, "a", "你好世界")
    assert one.search_hits(I, "nihap").first()["matched_terms"]
    assert one.search_with_mode(I, "nihap", SearchMode.FUZZY).isEmpty()


def test_highlights(index):
    assert index.get_matches(I, "doc-cn", "nihao") == index.get_matches(I, "doc-cn", "你好") == [(0, 2)]
    assert index.get_matches(I, "doc-cn", "nh")[0][0] == index.get_matches(I, "doc-cn", "nih")[0][0]
    text = DOCS["news"]
    assert {text[s:e] for s, e in index.get_matches(I, "news", "neicun")} == {"内存"}
    assert index.get_matches(I, "mixed", "hello shijie") == [(0, 5), (6, 8)]
    index.set_position_encoding(PositionEncoding.BYTES)
    assert index.get_matches(I, "mixed", "shijie") == [(6, 12)]
    index.set_position_encoding(PositionEncoding.UTF16)
    assert index.get_matches(I, "none", "x") == []


def test_tables(index):
    terms = {(r["domain"], r["term"]): r["in_aux"] for r in index.tables.terms().collect()}
    assert terms[("original", "bxrta7zq3eo")] in (True, False)
    assert ("original", "bxrta7zq3eo_mxkkwtgcd") not in terms
    assert terms[("original", "你好")] and terms[("pinyin_full", "nihao")] and not terms[("pinyin_full_prefix", "nih")]
    grams = {r["gram"] for r in index.tables.grams().filter("domain = 'pinyin_full' and term = 'nihao'").collect()}
    assert grams == {"nih", "iha", "hao"}


def test_changes(spark, tmp_path):
    s = SearchIndex(spark)
    assert not s.has_unpersisted_changes() and s.get_snapshot_data(I) is None
    s.add_doc(I, "a", "token removal check")
    s.add_doc(I, "b", "你好世界 search-engine")
    s.add_doc(I, "c", "staged only", index=False)
    assert s.has_unpersisted_changes(I) and not s.has_unpersisted_changes("other")
    assert s.get_doc(I, "c") == "staged only" and s.get_doc(I, "zz") is None
    assert s.search_with_mode(I, "staged", SearchMode.EXACT).isEmpty()
    assert {r[0] for r in s.search(I, "*").collect()} == {"a", "b", "c"}
    assert s.tables.stats().filter("domain = 'original'").first()["n"] == 3
    called = []
    with pytest.raises(RuntimeError):
        s.persist_if_dirty(I, lambda _: (_ for _ in ()).throw(RuntimeError("no")))
    assert s.has_unpersisted_changes(I)
    assert s.persist_if_dirty(I, called.append) and len(called) == 1
    assert not s.persist_if_dirty(I, called.append) and len(called) == 1
    s.remove_doc(I, "a")
    s.remove_doc(I, "never")
    s.add_doc(I, "b", "replaced text")
    dirty, deleted = s.take_dirty_and_deleted()
    assert [tuple(r) for r in dirty.collect()] == [(I, "b", "replaced text", 2)]
    assert [tuple(r) for r in deleted.collect()] == [(I, "a")]
    assert not s.has_unpersisted_changes()
    assert s.tables.terms().filter("term in ('token', '你好')").isEmpty()
    path = str(tmp_path / "snap")
    assert s.save_snapshot(I, path)
    other = SearchIndex(spark)
    other.load_snapshot("copy", path)
    assert not other.has_unpersisted_changes()
    assert [r[0] for r in other.search("copy", "replaced").collect()] == ["b"]
    spark.createDataFrame([(3, I, None)], "version int, index_name string, lexicon_version string").write.mode("overwrite").parquet(path + "/meta")
    with pytest.raises(ValueError):
        other.load_snapshot("copy", path)


def test_clear(spark):
    s = SearchIndex(spark)
    for k, text in (("a", "fuzzy words"), ("b", "other words")):
        s.add_doc(I, k, text)
        s.add_doc("second", k, text)
    s.clear(I, only_dictionaries=True)
    assert s.search_with_mode(I, "fuzze", SearchMode.FUZZY).isEmpty() and not s.search_with_mode(I, "fuzzy", SearchMode.EXACT).isEmpty()
    assert not s.search_with_mode("second", "fuzze", SearchMode.FUZZY).isEmpty()
    s.add_doc(I, "a", "fuzzy again")
    assert not s.search_with_mode(I, "fuzze", SearchMode.FUZZY).isEmpty() and s.search_with_mode(I, "othar", SearchMode.FUZZY).isEmpty()
    s.clear(I)
    assert s.search(I, "*").isEmpty() and s.search(I, "fuzzy").isEmpty() and s.search("second", "*").count() == 2
    assert s.tables.stats().filter(f"index_name = '{I}'").isEmpty()


def test_json(spark, tmp_path):
    from tessera.sources.snapshot import read_json, write_json

    s = SearchIndex(spark)
    s.add_doc(I, "a", "你好世界 hello")
    s.add_doc(I, "b", "hello again")
    write_json(s.get_snapshot_data(I), str(tmp_path / "j"), I, version="x")
    back = read_json(spark, str(tmp_path / "j"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(back.postings) == key(s.tables.postings.select(back.postings.columns)) and key(back.documents.select("doc_id", "content")) == key(s.tables.documents.select("doc_id", "content"))
    other = SearchIndex(spark)
    other.load_snapshot("copy", back)
    assert {r[0] for r in other.search("copy", "nihao").collect()} == {"a"} and other.search("copy", "hello").count() == 2


def test_last_of_repeated_ids_stays(spark):
    s = SearchIndex(spark)
    rows = spark.createDataFrame([(I, "a", f"version{k}") for k in range(20)], "index_name string, doc_id string, content string").coalesce(1)
    s.add_docs(rows)
    assert s.get_doc(I, "a") == "version19"


def test_large_batches_of_queries(spark, index, monkeypatch):
    """Queries as a table, not as literals, give the same hits."""
    from tessera.plans import search as P

    for mode in SearchMode:
        rows = [(str(k), I, q) for k, (q, m, _, _) in enumerate(CASES) if m == mode.value]
        asked = spark.createDataFrame(rows, "query_id string, index_name string, text string")
        few = sorted((h["query_id"], h["doc_id"], round(h["score"], 9), str(h["matched_terms"])) for h in index.search_batch(asked, mode).collect())
        with monkeypatch.context() as m:
            m.setattr(P, "LOCAL_TOKENS", 0)
            many = sorted((h["query_id"], h["doc_id"], round(h["score"], 9), str(h["matched_terms"])) for h in index.search_batch(asked, mode).collect())
        assert few == many and few


def test_dictionary(spark):
    s = SearchIndex.with_dictionary_config(spark, DictionaryConfig(japanese=ScriptDictionary({"こんにちは"})))
    s.add_doc(I, "a", "こんにちは世界")
    assert not s.tables.terms().filter("term = 'こんにちは'").isEmpty()
    assert s.search_with_mode(I, "こんにちは", SearchMode.EXACT).count() == 1
    s.set_dictionary_config(None)
    s.add_doc(I, "b", "こんにちは世界")
    assert s.search_with_mode(I, "こんにちは", SearchMode.EXACT).count() == 1


def test_custom_tokenizer(spark):
    s = SearchIndex(spark, Analyzer(readings={}))
    s.register_tokenizer("latin", lambda run: [(k, k + 1) for k in range(len(run))])
    s.add_doc(I, "a", "abc")
    assert {r["term"] for r in s.tables.terms().collect()} == {"a", "b", "c"}


def test_readings(spark):
    table = readings(spark)
    assert table["你"] == ("ni",) and table["重"] == ("zhong", "chong") and len(table) > 20_000


def test_native_and_general_agree(spark, index):
    from tessera.operators.index import Index

    docs = spark.createDataFrame(
        [(I, k, t, True) for k, t in enumerate(["École d'été, «ça» va… naïve", "a_b-c  x1y2 É", "", "Straße – Æøð ÿ", "12-34 don't"])],
        "index_name string, doc_id long, content string, indexed boolean",
    )
    native = Index.build(docs, Analyzer())
    general = Index.build(docs, Analyzer(tokenizers={"none": lambda r: []}))
    assert {tuple(r) for r in native.postings.collect()} == {tuple(r) for r in general.postings.collect()}


def test_stream(spark, tmp_path):
    from tessera.streaming.ingest import ingest

    schema = "index_name string, doc_id string, content string, op string, seq long"
    rows = [(I, "a", "one", "index", 1), (I, "a", "two", "index", 2), (I, "b", "three", "index", 1), (I, "b", None, "delete", 2)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    s = SearchIndex(spark)
    ingest(s, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert [(r["doc_id"], r["content"]) for r in s.tables.documents.collect()] == [("a", "two")]
