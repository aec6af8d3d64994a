"""Column functions against the general analyzer, and the analyzer's own cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import Analyzer, DictionaryConfig, ScriptDictionary
from tessera.functions import analyzer as A
from tessera.functions import text as T
from tessera.functions.lexicon import best_path, longest_matches, search_words
from tessera.functions.pinyin import prefixes, variants
from tessera.operators import scoring as S
from tessera.operators.train import TrainingConfig, export, lexicon_table, load, train_dictionary_config

WORDS = ["", "a", "ab", "abcd", "IKPeA9Zu9eo_pXlKWVFcf", "0123456789abcdef", "hello-world", "strengths12", "x" * 20, "zzzzzzz1", "----------------", "naïve", "北京大学"]


def test_columns_agree_with_analyzer(spark):
    got = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", T.id_like(F.col("w")).alias("id"), T.char_ngrams(F.col("w")).alias("grams"), T.uni_bigrams(F.col("w")).alias("pairs")).collect()
    for r in got:
        assert r["id"] == A.is_id_like(r["w"])
        assert r["pairs"] == [r["w"][s:e] for s, e in A.uni_bigrams(r["w"])]
        n = len(r["w"])
        assert r["grams"] == ([r["w"][k : k + 3] for k in range(n - 2)] if n >= 3 else [r["w"]] if n == 2 else [])


@pytest.mark.parametrize("text", ["hello 世界,ラーメンこん안녕 привет мир!", "", "𠀀々a", "École ² x_y"])
def test_script_runs(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(T.script_runs(F.col("t")).alias("r")).first()["r"]
    assert got == [text[s:e] for _, s, e in A.runs(text)]


def test_similarity_and_offsets(spark):
    one = spark.createDataFrame([("kitten", "sitting", "a😀é")], "a string, b string, t string")
    r = one.select(T.similarity(F.col("a"), F.col("b")).alias("s"), T.utf16_offset(F.col("t"), F.lit(2)).alias("u"), T.byte_offset(F.col("t"), F.lit(2)).alias("b"), T.similarity(F.lit(""), F.lit("")).alias("e")).first()
    assert r["s"] == pytest.approx(1 - 3 / 7) and (r["u"], r["b"], r["e"]) == (3, 5, 1.0)


def test_scoring(spark):
    cases = [(0, 3, 0), (1, 1, 1), (3, 3, 2), (5, 5, 3), (5, 1, 1), (10, 10, 6)]
    got = spark.createDataFrame(cases, "q int, a int, want int").select("want", S.min_should_match(F.col("q"), F.col("a")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got[1:])
    r = spark.range(1).select(S.bm25(F.lit(2), F.lit(4), F.lit(8.0), F.lit(1.5)).alias("x"), S.bm25(F.lit(0), F.lit(4), F.lit(8.0), F.lit(1.5)).alias("z"), S.bm25(F.lit(1), F.lit(4), F.lit(0.0), F.lit(1.0)).alias("p")).first()
    assert r["x"] == pytest.approx(1.5 * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 0.5))) and r["z"] == 0 and r["p"] == pytest.approx(2.2 / 1.3)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_runs_cover_any_text(text):
    assert "".join(text[s:e] for _, s, e in A.runs(text)) == text
    raw = text.encode("utf-8", "surrogatepass")
    for t in Analyzer().tokens(text):
        assert 0 <= t.start < t.end <= len(raw) and t.term


def test_normalize():
    assert A.normalize("Hello_World-12") == [("hello", 0, 5), ("world", 6, 11), ("12", 12, 14)]
    assert A.normalize("x9K2mQ7bT4_wZ8rL1") == [("x9k2mq7bt4_wz8rl1", 0, 17)] and len(A.normalize("IKPeA9Zu9eo_pXlKWVFcf")) == 2
    assert A.normalize(" ²") == [(" 2", 0, 2)] and A.normalize("…") == [] and A.normalize("привет мир")[0][0] == "привет мир"
    assert A.fold("ＮＩＨＡＯ Éが") == "nihao eか"


def test_lexicons():
    assert longest_matches("abcab", {"ab", "abc"}) == [(0, 3), (3, 5)]
    words = {"北京": 5.0, "大学": 5.0, "北京大学": 5.0}
    assert best_path("北京大学x", words) == [(0, 4), (4, 5)]
    assert search_words("北京大学", words) == [(0, 2), (2, 4), (0, 4)]
    made = Analyzer(dictionary=DictionaryConfig(japanese=ScriptDictionary({"こん"})))
    found = made.tokens("こんにちは", derive=False)
    assert (found[0].term, found[0].start) == ("こん", 0) and any(t.start == 12 for t in found)


def test_pinyin():
    table = {"重": ("zhong", "chong"), "庆": ("qing",)}
    assert variants("重庆", table) == [("zhongqing", "zq"), ("chongqing", "cq")]
    assert variants("重" * 5, table) == [("zhong" * 5, "z" * 5)] and variants("重x", table) == [] and variants("重" * 17, table) == []
    assert len(variants("重" * 4, table)) == 4
    assert prefixes("ni", (2, 16)) == [] and prefixes("nh", (1, 16)) == ["n"] and len(prefixes("a" * 40, (2, 16))) == 15


def test_training(spark):
    texts = spark.createDataFrame([("こんにちは世界",), ("こんにちは友達",), ("안녕하세요 세계",)], "text string")
    config = train_dictionary_config(texts, TrainingConfig(min_freq=1, min_len=2, max_len=3, max_entries=4, version="v1"))
    assert len(config.japanese.entries) == 4 == len(config.hangul.entries)
    rows = export(spark, config).collect()
    assert len(rows) == 2 and all(r["entry_count"] == len(r["entries"]) and r["version"].startswith("v1") and r["entries"] == sorted(r["entries"]) for r in rows)
    again = load(lexicon_table(spark, config))
    assert again.japanese.entries == config.japanese.entries and again.hangul.version == "v1"
    assert train_dictionary_config(texts.limit(0)).japanese is None
