"""Registered queries of the text index, each with the DuckDB statement that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.analyzer import Analyzer
from .functions.lexicon import DictionaryConfig, ScriptDictionary
from .functions.pinyin import prefixes, variants
from .operators import index as X
from .operators.highlight import highlight, highlight_everywhere
from .operators.index import Index
from .operators.train import TrainingConfig, export, lexicon_counts
from .plans import search as P
from .schema import PositionEncoding, SearchMode
from .session import cut, reachable, shared_folder
from .sources.snapshot import corpus, read_json, read_snapshot, write_json, write_snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_built: dict[tuple[str, str, str], Index] = {}


def _register(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def built(spark: SparkSession, sf_dir: str, table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of a table, built once for a session and written to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _built:
        docs = corpus(reachable(spark).read.parquet(f"{sf_dir}/{table}.parquet"), table, id_col, text_col)
        _built[key] = Index.build(docs).store()
    return _built[key]


def _ask(spark: SparkSession, texts: dict[str, str], index_name: str = "documents") -> DataFrame:
    return spark.createDataFrame([(k, index_name, v) for k, v in texts.items()], "query_id string, index_name string, text string")


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.size("matched_terms").alias("n_matched"))


# SQL that the statements share

def _base(table: str = "documents", id_col: str = "doc_id", text: str = "text", where: str = "TRUE") -> str:
    return rf"""
docs AS (SELECT {id_col} AS doc_id, {text} AS text FROM {table} WHERE {where}),
tok AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{{Latin}}0-9]+')) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT sum(tf)::DOUBLE FROM tf) / (SELECT count(*) FROM docs) AS avgdl)"""


def _asked(texts: dict[str, str]) -> str:
    rows = [(k, i, t) for k, v in texts.items() for i, t in enumerate(v.split())]
    values = ", ".join(f"('{k}', {i}, '{t}')" for k, i, t in rows)
    return f"""
q AS (SELECT query_id, q_idx, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (VALUES {values}) v(query_id, q_idx, term))"""


_MSM = "CASE WHEN available = 0 THEN 0 ELSE least(greatest(ceil(n_terms * 0.6e0), 1), available) END"
_BM25 = "ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))"
_EXACT = f"""
views AS (SELECT q.*, df, count(*) OVER (PARTITION BY query_id) AS available FROM q JOIN df USING (term)),
exact AS (SELECT query_id, doc_id, sum({_BM25}) AS score, count(DISTINCT term) AS n_matched, any_value(n_terms) AS n_terms, any_value(available) AS available
          FROM views JOIN tf USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY query_id, doc_id HAVING count(DISTINCT term) >= any_value({_MSM}))"""
_ID_LIKE = r"""(regexp_full_match(term, '[A-Za-z0-9_-]{8,}') AND (
  (len(term) >= 16 AND (len(regexp_replace(term, '[^A-Za-z]', '', 'g')) = 0 OR 10 * len(regexp_replace(term, '[^aeiouyAEIOUY]', '', 'g')) <= 3 * len(regexp_replace(term, '[^A-Za-z]', '', 'g'))))
  OR (regexp_matches(term, '[A-Z]')::INT + regexp_matches(term, '[a-z]')::INT + regexp_matches(term, '[0-9]')::INT >= 2
      AND (len(regexp_replace(term, '[^A-Za-z]', '', 'g')) = 0 OR 4 * len(regexp_replace(term, '[^aeiouyAEIOUY]', '', 'g')) <= len(regexp_replace(term, '[^A-Za-z]', '', 'g'))))))"""
_GRAMS = "CASE WHEN len(term) >= 3 THEN list_transform(range(1, len(term) - 1), lambda i: substring(term, i::INT, 3)) WHEN len(term) = 2 THEN [term] ELSE [] END"
_FUZZY = f"""
aux AS (SELECT term, df FROM df WHERE NOT {_ID_LIKE}),
grams AS (SELECT DISTINCT term AS candidate, unnest({_GRAMS}) AS gram FROM aux),
qg AS (SELECT query_id, q_idx, term, unnest({_GRAMS}) AS gram FROM q),
shared AS (SELECT query_id, q_idx, term, candidate, count(*) AS shared FROM qg JOIN grams USING (gram) GROUP BY ALL),
top40 AS (SELECT *, row_number() OVER (PARTITION BY query_id, q_idx ORDER BY shared DESC, candidate) AS rank FROM shared QUALIFY rank <= 40),
near AS (SELECT *, 1e0 - levenshtein(translate(candidate, 'ßæøðþ', '~~~~~'), term) / greatest(len(candidate), len(term))::DOUBLE AS similarity FROM top40 WHERE abs(len(candidate) - len(term)) <= 2),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, q_idx ORDER BY rank) AS again FROM near
         WHERE similarity >= CASE WHEN len(term) <= 2 THEN 0.5e0 ELSE 0.6e0 END QUALIFY again <= 20),
short AS (SELECT q.query_id, q.q_idx, q.term, aux.term AS candidate,
                 1e0 - levenshtein(translate(aux.term, 'ßæøðþ', '~~~~~'), q.term) / greatest(len(aux.term), len(q.term))::DOUBLE AS similarity
          FROM q JOIN aux ON abs(len(aux.term) - len(q.term)) <= 2 WHERE len(q.term) = 1),
known AS (SELECT * FROM short WHERE candidate = term),
scanned AS (SELECT * FROM short WHERE similarity >= 0.5e0 AND (query_id, q_idx) NOT IN (SELECT (query_id, q_idx) FROM known)
            QUALIFY row_number() OVER (PARTITION BY query_id, q_idx ORDER BY similarity DESC, candidate) <= 20),
cand AS (SELECT query_id, q_idx, term, candidate, similarity FROM kept UNION ALL SELECT * FROM known UNION ALL SELECT * FROM scanned),
avail AS (SELECT query_id, count(DISTINCT q_idx) AS available FROM cand GROUP BY ALL),
fuzzy AS (SELECT query_id, doc_id, sum({_BM25} * 0.7e0 * similarity) AS score, count(DISTINCT candidate) AS n_matched
          FROM cand JOIN (SELECT DISTINCT query_id, n_terms FROM q) USING (query_id) JOIN avail USING (query_id)
          JOIN df ON df.term = candidate JOIN tf ON tf.term = candidate JOIN dl USING (doc_id) CROSS JOIN st
          GROUP BY query_id, doc_id HAVING count(DISTINCT q_idx) >= any_value({_MSM}))"""


def _exact_sql(texts: dict[str, str], base: str = "") -> str:
    return f"WITH {base or _base()}, {_asked(texts)}, {_EXACT} SELECT query_id, doc_id, round(score, 6) AS score, CAST(n_matched AS INTEGER) AS n_matched FROM exact"


def _fuzzy_sql(texts: dict[str, str]) -> str:
    return f"WITH {_base()}, {_asked(texts)}, {_FUZZY} SELECT query_id, doc_id, round(score, 6) AS score, CAST(n_matched AS INTEGER) AS n_matched FROM fuzzy"


# statistics

@_register("term_freq", f"WITH {_base()} SELECT doc_id, term, tf FROM tf")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).postings.select("doc_id", "term", "tf")


@_register("tokenize_latin", f"WITH {_base()} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tok GROUP BY term")
def tokenize_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents", "doc_id", "text")
    counted = X.native_terms(docs).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@_register("doc_len", f"WITH {_base()} SELECT doc_id, CAST(dl AS BIGINT) AS len FROM dl")
def doc_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).doc_lens().select("doc_id", "len")


@_register("doc_freq", f"WITH {_base()} SELECT term, df FROM df")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).terms().select("term", "df")


@_register("corpus_stats", f"WITH {_base()} SELECT n, CAST((SELECT sum(tf) FROM tf) AS BIGINT) AS total, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).stats().select("n", "total", F.round("avgdl", 6).alias("avgdl"))


@_register("idf_table", f"WITH {_base()} SELECT term, round(ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0), 6) AS idf FROM df CROSS JOIN st")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.scoring import idf

    index = built(spark, sf_dir)
    stats = F.broadcast(index.kept("stats").select("index_name", "domain", "n"))
    return index.terms().join(stats, ["index_name", "domain"]).select("term", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


# exact search

def _search(name: str, texts: dict[str, str], mode: SearchMode, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _shown(P.search(built(spark, sf_dir), _ask(spark, texts), mode))
    ORACLES[name] = sql


_BATCH = {"b1": "the of and", "b2": "de la", "b3": "und der die", "b4": "idiot clown", "b5": "license", "b6": "that with zzzz"}
for _name, _texts in {
    "bm25_exact_1term": {"q": "the"},
    "bm25_exact_multi_msm": {"q": "the of and de la"},
    "bm25_repeated_token": {"q": "the the the"},
    "bm25_partial_available": {"q": "the zzzzqq"},
    "batch_queries": _BATCH,
}.items():
    _search(_name, _texts, SearchMode.EXACT, _exact_sql(_texts))


@_register("topk_hits", f"WITH {_base()}, {_asked(_BATCH)}, {_EXACT} SELECT query_id, doc_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM exact) WHERE rank <= 10")
def topk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = P.search(built(spark, sf_dir), _ask(spark, _BATCH), SearchMode.EXACT)
    return P.ranked(hits.withColumn("score", F.round("score", 9)), 10).select("query_id", "doc_id", "rank")


@_register("match_all", "SELECT doc_id, 1e0 AS score FROM documents")
def match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.search(built(spark, sf_dir), _ask(spark, {"q": "*"})).select("doc_id", "score")


@_register("get_doc", "SELECT text AS content FROM documents WHERE doc_id = 7")
def get_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).get_doc("documents", 7)


for _name, _table, _id_col, _text_col, _texts in (
    ("benchmark_search", "benchmark", "item_id", "text", {"q": "the and"}),
    ("pages_search", "pages", "page_id", "html", {"q": "article the nav"}),
):
    QUERIES[_name] = lambda spark, sf_dir, t=_table, i=_id_col, x=_text_col, q=_texts: _shown(P.search(built(spark, sf_dir, t, i, x), _ask(spark, q, t), SearchMode.EXACT))
    ORACLES[_name] = _exact_sql(_texts, _base(_table, _id_col, _text_col))


_TURN = "conv_id * 10000 + turn"


@_register("conversations_search", _exact_sql({"q": "the is"}, _base("conversations", _TURN)))
def conversations_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("id", F.expr(_TURN))
    index = Index.build(corpus(turns, "conversations", "id", "text"))
    return _shown(P.search(index, _ask(spark, {"q": "the is"}, "conversations"), SearchMode.EXACT))


# dictionary and fuzzy search

@_register("id_like_filter", rf"WITH docs AS (SELECT text FROM documents), raw AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS term FROM docs) SELECT term FROM raw WHERE {_ID_LIKE}")
def id_like_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]+"), F.lit(0))).alias("term")).distinct()
    return words.filter(T.id_like(F.col("term")))


@_register("aux_terms", f"WITH {_base()} SELECT term, df FROM df WHERE NOT {_ID_LIKE}")
def aux_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).dictionary().select("term", "df")


@_register("term_ngrams", f"WITH {_base()} SELECT term, list_aggregate({_GRAMS}, 'string_agg', ' ') AS grams FROM df WHERE len(term) >= 2")
def term_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).terms().filter("n_chars >= 2").select("term", F.array_join(T.char_ngrams(F.col("term")), " ").alias("grams"))


@_register("ngram_index", f"WITH {_base()}, g AS (SELECT DISTINCT term, unnest({_GRAMS}) AS gram FROM df WHERE NOT {_ID_LIKE}) SELECT gram, count(*) AS n_terms FROM g GROUP BY gram")
def ngram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).grams().groupBy("gram").agg(F.count(F.lit(1)).alias("n_terms"))


_PROBES = {"p1": "thaer erinng", "p2": "lizense", "p3": "publik genaral", "p4": "idoit", "p5": "x", "p6": "th ofe"}


@_register("fuzzy_candidates_ascii", f"WITH {_base()}, {_asked(_PROBES)}, {_FUZZY} SELECT query_id, CAST(q_idx AS INTEGER) AS q_idx, candidate, round(similarity, 6) AS similarity FROM cand")
def fuzzy_candidates_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = cut(P.query_tokens(_ask(spark, _PROBES), Analyzer()))
    return P.fuzzy_candidates(built(spark, sf_dir), q, "original").select("query_id", "q_idx", "candidate", F.round("similarity", 6).alias("similarity"))


@_register("ngram_candidates", f"WITH {_base()}, {_asked(_PROBES)}, {_FUZZY} SELECT query_id, CAST(q_idx AS INTEGER) AS q_idx, candidate, shared FROM shared")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = P.query_tokens(_ask(spark, _PROBES), Analyzer())
    asked = q.select("query_id", "q_idx", F.explode(T.char_ngrams(F.col("term"))).alias("gram"))
    grams = built(spark, sf_dir).kept("grams").select("gram", F.col("term").alias("candidate"))
    return asked.join(grams, "gram").groupBy("query_id", "q_idx", "candidate").agg(F.count(F.lit(1)).alias("shared"))


for _name, _texts in {"fuzzy_search_ascii": _PROBES, "fuzzy_msm": {"q": "thaer erinng zzqqk"}, "short_term_dict_scan": {"q1": "z", "q2": "a", "q3": "7"}}.items():
    _search(_name, _texts, SearchMode.FUZZY, _fuzzy_sql(_texts))

_MIXED = {"a1": "the of and", "a2": "thaer erinng", "a3": "idoit clwon", "a4": "the zzqqkk"}
_search(
    "auto_route_ascii",
    _MIXED,
    SearchMode.AUTO,
    f"""WITH {_base()}, {_asked(_MIXED)}, {_EXACT}, {_FUZZY},
done AS (SELECT query_id FROM exact GROUP BY query_id HAVING max(n_matched) >= any_value(least(greatest(ceil(n_terms * 0.6e0), 1), n_terms)))
SELECT query_id, doc_id, round(score, 6) AS score, CAST(n_matched AS INTEGER) AS n_matched FROM (
  SELECT query_id, doc_id, score, n_matched FROM exact WHERE query_id IN (SELECT query_id FROM done)
  UNION ALL SELECT query_id, doc_id, score, n_matched FROM fuzzy WHERE query_id NOT IN (SELECT query_id FROM done))""",
)


# highlights

def _highlight_sql(measure: str) -> str:
    return rf"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{Latin}}0-9]+|[^\p{{Latin}}0-9]+')) AS run, generate_subscripts(regexp_extract_all(text, '[\p{{Latin}}0-9]+|[^\p{{Latin}}0-9]+'), 1) AS k FROM documents),
     placed AS (SELECT doc_id, run, sum({measure}(run)) OVER (PARTITION BY doc_id ORDER BY k) - {measure}(run) AS start FROM runs)
SELECT doc_id, CAST(start AS INTEGER) AS "start", CAST(start + {measure}(run) AS INTEGER) AS "end" FROM placed WHERE strip_accents(lower(run)) IN ('license', 'ecole', 'idiot', 'que')"""


def _highlight(encoding: PositionEncoding) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents", "doc_id", "text")
        return highlight_everywhere(docs, ["license", "ecole", "idiot", "que"], Analyzer(), encoding).select("doc_id", "start", "end")

    return run


QUERIES["highlight_bytes"], ORACLES["highlight_bytes"] = _highlight(PositionEncoding.BYTES), _highlight_sql("strlen")
QUERIES["highlight_utf16"], ORACLES["highlight_utf16"] = _highlight(PositionEncoding.UTF16), _highlight_sql("length")


@_register("forward_positions", r"""
WITH runs AS (SELECT item_id, unnest(regexp_extract_all(text, '[\p{Latin}0-9]+|[^\p{Latin}0-9]+')) AS run, generate_subscripts(regexp_extract_all(text, '[\p{Latin}0-9]+|[^\p{Latin}0-9]+'), 1) AS k FROM benchmark),
     placed AS (SELECT item_id, strip_accents(lower(run)) AS term, sum(strlen(run)) OVER (PARTITION BY item_id ORDER BY k) - strlen(run) AS start FROM runs)
SELECT item_id AS doc_id, term, string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR), ' ' ORDER BY start) AS starts FROM placed WHERE regexp_matches(term, '^[\p{Latin}0-9]') GROUP BY ALL""")
def forward_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _starts(corpus(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "benchmark", "item_id", "text"))


def _starts(docs: DataFrame) -> DataFrame:
    found = X.forward_positions(docs, Analyzer())
    return found.select("doc_id", "term", F.array_join(F.transform("spans", lambda s: s["start"].cast("string")), " ").alias("starts"))


@_register("forward_positions_documents", ORACLES["forward_positions"].replace("item_id", "doc_id").replace("benchmark", "documents"))
def forward_positions_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _starts(corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents", "doc_id", "text"))


# changes

def _changed(spark: SparkSession, sf_dir: str) -> tuple[Index, DataFrame]:
    docs = corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents", "doc_id", "text")
    return built(spark, sf_dir), docs


def _of_lang(spark: SparkSession, sf_dir: str, docs: DataFrame, lang: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("lang") == lang).select("doc_id")
    return docs.join(ids, "doc_id", "left_semi")


_REPLACED = "CASE WHEN lang = 'es' THEN 'the new text ' || source ELSE text END"


@_register("upsert_replace", f"WITH {_base(text=_REPLACED)} SELECT term, df FROM df")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _changed(spark, sf_dir)
    new = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'es'").withColumn("text", F.concat(F.lit("the new text "), "source"))
    return index.upsert(corpus(new, "documents", "doc_id", "text")).terms().select("term", "df")


@_register("remove_docs", f"WITH {_base(where="lang <> 'de'")} SELECT term, df FROM df")
def remove_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, docs = _changed(spark, sf_dir)
    return index.remove(_of_lang(spark, sf_dir, docs, "de")).terms().select("term", "df")


@_register("staged_docs_stats", f"WITH {_base(text="CASE WHEN lang <> 'fr' THEN text END")} SELECT n, CAST((SELECT sum(tf) FROM tf) AS BIGINT) AS total, round(avgdl, 6) AS avgdl FROM st")
def staged_docs_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = corpus(table.withColumn("kept", F.expr("lang <> 'fr'")), "documents", "doc_id", "text", "kept")
    return Index.build(docs).stats().select("n", "total", F.round("avgdl", 6).alias("avgdl"))


@_register("dirty_deleted", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'deleted' ELSE 'dirty' END AS op FROM documents WHERE lang IN ('de', 'es')")
def dirty_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .index import SearchIndex

    docs = corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents", "doc_id", "text")
    store = SearchIndex(spark, Analyzer(), id_type="bigint")
    store.add_docs(docs)
    store.take_dirty_and_deleted()
    store.add_docs(_of_lang(spark, sf_dir, docs, "es"))
    store.remove_docs(_of_lang(spark, sf_dir, docs, "de"))
    dirty, deleted = store.take_dirty_and_deleted()
    return dirty.select("doc_id", F.lit("dirty").alias("op")).unionByName(deleted.select("doc_id", F.lit("deleted").alias("op")))


@_register("last_write_wins", "SELECT o_custkey AS doc_id, max(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("orders").alias("index_name"), F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"))
    return X.last_write(orders, "seq").select("doc_id", "seq")


@_register("snapshot_roundtrip", f"WITH {_base()} SELECT term, df FROM df")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/snapshot-{spark.sparkContext.applicationId}"
    write_snapshot(built(spark, sf_dir), folder, "documents")
    return read_snapshot(spark, folder, "copy").terms().select("term", "df")


# the index object: encodings, highlights of queries and hits, pending changes, lengths of older snapshots

def _store(spark: SparkSession, sf_dir: str, **kw: object):
    from .index import SearchIndex

    store = SearchIndex(spark, Analyzer(), id_type="bigint", **kw)
    store.add_docs(corpus(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "benchmark", "item_id", "text"))
    return store


_PLACED = r"""
runs AS (SELECT item_id AS doc_id, unnest(regexp_extract_all(text, '[\p{Latin}0-9]+|[^\p{Latin}0-9]+')) AS run, generate_subscripts(regexp_extract_all(text, '[\p{Latin}0-9]+|[^\p{Latin}0-9]+'), 1) AS k FROM benchmark),
placed AS (SELECT doc_id, strip_accents(lower(run)) AS term, sum(strlen(run)) OVER w - strlen(run) AS byte_start, strlen(run) AS bytes, sum(length(run)) OVER w - length(run) AS start, length(run) AS units FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""
_SHOWN = ["the", "que", "and", "des", "eine"]


@_register("encoding_setting", f"""WITH {_PLACED}
SELECT 'bytes' AS encoding, doc_id, CAST(byte_start AS INTEGER) AS "start", CAST(byte_start + bytes AS INTEGER) AS "end" FROM placed WHERE term IN ({', '.join(f"'{t}'" for t in _SHOWN)})
UNION ALL SELECT 'utf16', doc_id, CAST(start AS INTEGER), CAST(start + units AS INTEGER) FROM placed WHERE term IN ({', '.join(f"'{t}'" for t in _SHOWN)})""")
def encoding_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, encoding=PositionEncoding.BYTES)
    wanted = store.tables.documents.select(F.lit("q").alias("query_id"), "index_name", "doc_id", F.array(*map(F.lit, _SHOWN)).alias("terms"))
    one = store.highlight_batch(wanted).select(F.lit("bytes").alias("encoding"), "doc_id", "start", "end")
    store.set_position_encoding(PositionEncoding.UTF16)
    return one.unionByName(store.highlight_batch(wanted).select(F.lit("utf16").alias("encoding"), "doc_id", "start", "end"))


_HITS_SHOWN = {"h1": "the of and", "h2": "de la"}


@_register("highlight_hits", f"""WITH {_base("benchmark", "item_id")}, {_asked(_HITS_SHOWN)}, {_EXACT}, {_PLACED}
SELECT query_id, doc_id, CAST(start AS INTEGER) AS "start", CAST(start + units AS INTEGER) AS "end" FROM exact JOIN placed USING (doc_id) JOIN (SELECT DISTINCT query_id, term FROM q) USING (query_id, term)""")
def highlight_hits_(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.highlight import highlight_hits

    index = built(spark, sf_dir, "benchmark", "item_id", "text")
    hits = P.search(index, _ask(spark, _HITS_SHOWN, "benchmark"), SearchMode.EXACT)
    return highlight_hits(index.documents, hits).select("query_id", "doc_id", "start", "end")


@_register("hits_id_score", f"WITH {_base('benchmark', 'item_id')}, {_asked({'q': 'the of'})}, {_EXACT} SELECT doc_id, round(score, 6) AS score FROM exact")
def hits_id_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).search("benchmark", "the of").select("doc_id", F.round("score", 6).alias("score"))


@_register("pending_changes", "SELECT * FROM (VALUES ('added', TRUE), ('failed', TRUE), ('persisted', FALSE), ('again', FALSE)) v(step, pending)")
def pending_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    rows = [("added", store.has_unpersisted_changes("benchmark"))]
    try:
        store.persist_if_dirty("benchmark", lambda _: 1 // 0)
    except ZeroDivisionError:
        rows.append(("failed", store.has_unpersisted_changes()))
    store.persist_if_dirty("benchmark", lambda _: None)
    rows.append(("persisted", store.has_unpersisted_changes()))
    rows.append(("again", store.persist_if_dirty("benchmark", lambda _: None)))
    return spark.createDataFrame(rows, "step string, pending boolean")


@_register("ascii_split", rf"""
WITH raw AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS term FROM documents),
     cuts AS (SELECT term AS word, CASE WHEN {_ID_LIKE} THEN [lower(term)] ELSE list_filter(regexp_split_to_array(lower(term), '[_-]+'), lambda x: x <> '') END AS terms FROM raw)
SELECT word, array_to_string(terms, ' ') AS terms FROM cuts""")
def ascii_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.array_join(T.ascii_terms(F.col("word")), " ").alias("terms"))


_OLD = "CASE WHEN lang = 'es' THEN NULL WHEN lang = 'fr' THEN 0 ELSE {0} END"


@_register("length_recovery", f"WITH {_base()} SELECT doc_id, CAST(coalesce(dl, n_chars) AS BIGINT) AS len FROM documents LEFT JOIN dl USING (doc_id) WHERE coalesce(dl, n_chars) > 0")
def length_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = built(spark, sf_dir).postings.groupBy("index_name", "domain", "doc_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    rows = own.join(table.select("doc_id", "lang"), "doc_id").withColumn("dl", F.expr(_OLD.format("dl")))
    docs = table.select(F.lit("documents").alias("index_name"), "doc_id", F.col("n_chars").alias("doc_len"))
    return X.doc_lengths(docs, rows.drop("lang")).select("doc_id", "len")


@_register("json_roundtrip", f"WITH {_base('benchmark', 'item_id')} SELECT doc_id, term, tf, CAST(dl AS BIGINT) AS dl FROM tf JOIN dl USING (doc_id)")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    write_json(built(spark, sf_dir, "benchmark", "item_id", "text"), folder, "benchmark")
    return read_json(spark, folder).postings.select("doc_id", "term", "tf", "dl")


@_register("clear_dictionary", f"WITH {_base('benchmark', 'item_id')} SELECT term, df, FALSE AS in_aux FROM df")
def clear_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "benchmark", "item_id", "text").clear("benchmark", only_dictionaries=True).terms().select("term", "df", "in_aux")


# Chinese at size: the benchmark's letters as characters, searched by pinyin, with scores

_HAN_OF = dict(zip("abcdefghijklmnopqrstuvwxyz", "明北地大案方锅好人京口火木你博山水日世天月学界東庆土"))
_LETTERS, _HANS = "".join(_HAN_OF), "".join(_HAN_OF.values())
_HAN_READINGS = {
    c: (r,) for c, r in zip(_HANS, "ming bei di da an fang guo hao ren jing kou huo mu ni bo shan shui ri shi tian yue xue jie dong qing tu".split())
}
_SPELLED = {"full": "tianhaoan", "initials": "tha", "full_prefix": "tianh", "initials_prefix": "thmntr", "char": "tian", "absent": "zzzz"}
_HAN_SQL = rf"""
readings(c, r) AS (VALUES {', '.join(f"('{c}', '{r[0]}')" for c, r in _HAN_READINGS.items())}),
docs AS (SELECT item_id AS doc_id, translate(lower(text), '{_LETTERS}', '{_HANS}') AS text FROM benchmark),
runs AS (SELECT doc_id, row_number() OVER () AS run_id, run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{Han}}]+')) AS run FROM docs)),
chars AS (SELECT doc_id, run_id, run, k, r FROM (SELECT *, unnest(string_split(run, '')) AS c, generate_subscripts(string_split(run, ''), 1) AS k FROM runs) JOIN readings USING (c)),
spelled AS (SELECT doc_id, 0 AS late, run_id, k, r AS full_value, r[1] AS initials FROM chars
            UNION ALL SELECT doc_id, 1, run_id, 0, string_agg(r, '' ORDER BY k), string_agg(r[1], '' ORDER BY k) FROM chars WHERE len(run) BETWEEN 2 AND 16 GROUP BY doc_id, run_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY late, run_id, k) AS nth FROM spelled),
vals AS (SELECT doc_id, nth, 'full' AS kind, full_value AS value, 2 AS low FROM placed UNION ALL SELECT doc_id, nth, 'initials', initials, 1 FROM placed),
seen AS (SELECT doc_id, kind, value AS p, min(nth) AS first_at FROM vals GROUP BY ALL),
pre AS (SELECT doc_id, nth, kind, value[1 : n] AS p FROM (SELECT *, unnest(range(low, least(17, len(value)))) AS n FROM vals)),
tok AS (SELECT doc_id, kind AS domain, value AS term FROM vals
        UNION ALL SELECT doc_id, kind || '_prefix', p FROM pre LEFT JOIN seen USING (doc_id, kind, p) WHERE first_at IS NULL OR first_at > nth),
tf AS (SELECT doc_id, domain, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, domain, sum(tf) AS dl FROM tf GROUP BY ALL),
df AS (SELECT domain, term, count(*) AS df FROM tf GROUP BY ALL),
st AS (SELECT domain, (SELECT count(*) FROM docs) AS n, sum(dl)::DOUBLE / (SELECT count(*) FROM docs) AS avgdl FROM dl GROUP BY domain)"""
_PINYIN_SQL = f"""WITH {_HAN_SQL},
q(query_id, term) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _SPELLED.items())}),
weights(domain, weight, long) AS (VALUES ('full', 0.9e0, 1), ('initials', 0.8e0, 1), ('full_prefix', 0.7e0, 0), ('initials_prefix', 0.75e0, 0)),
routes(domain, place) AS (VALUES ('full', 1), ('initials', 2), ('full_prefix', 3), ('initials_prefix', 4)),
hits AS (SELECT query_id, doc_id, domain, place, weight * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * CASE WHEN long = 1 THEN dl / avgdl ELSE 0 END)) AS score
         FROM q JOIN tf USING (term) JOIN dl USING (doc_id, domain) JOIN df USING (domain, term) JOIN st USING (domain) JOIN weights USING (domain) JOIN routes USING (domain))
SELECT query_id, doc_id, 'pinyin_' || domain AS domain, round(score, 6) AS score FROM hits WHERE (query_id, place) IN (SELECT (query_id, min(place)) FROM hits GROUP BY query_id)"""


def _han_index(spark: SparkSession, sf_dir: str) -> tuple[Index, Analyzer]:
    analyzer = Analyzer(readings=_HAN_READINGS, words={})
    key = (spark.sparkContext.applicationId, sf_dir, "han")
    if key not in _built:
        rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.translate(F.lower("text"), _LETTERS, _HANS).alias("text"))
        _built[key] = Index.build(corpus(rows, "han", "item_id", "text"), analyzer).store()
    return _built[key], analyzer


@_register("pinyin_scores", _PINYIN_SQL)
def pinyin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, analyzer = _han_index(spark, sf_dir)
    hits = P.search(index, _ask(spark, _SPELLED, "han"), SearchMode.PINYIN, analyzer)
    return hits.select("query_id", "doc_id", F.get("matched_terms", 0)["domain"].alias("domain"), F.round("score", 6).alias("score"))


@_register("pinyin_postings", f"WITH {_HAN_SQL} SELECT doc_id, 'pinyin_' || domain AS domain, term, tf FROM tf")
def pinyin_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _han_index(spark, sf_dir)
    return index.postings.filter("domain <> 'original'").select("doc_id", "domain", "term", "tf")


@_register("highlight_astral", rf"""
WITH docs AS (SELECT item_id AS doc_id, translate(lower(text), 'e', chr(131075)) || ' the' AS text FROM benchmark),
     runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{Latin}}0-9]+|[^\p{{Latin}}0-9]+')) AS run, generate_subscripts(regexp_extract_all(text, '[\p{{Latin}}0-9]+|[^\p{{Latin}}0-9]+'), 1) AS k FROM docs),
     sized AS (SELECT *, length(run) + length(run) - length(replace(run, chr(131075), '')) AS units FROM runs),
     placed AS (SELECT doc_id, run, units, sum(units) OVER (PARTITION BY doc_id ORDER BY k) - units AS start FROM sized)
SELECT doc_id, CAST(start AS INTEGER) AS "start", CAST(start + units AS INTEGER) AS "end" FROM placed WHERE run IN ('the', 'of', 'th')""")
def highlight_astral(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.concat(F.translate(F.lower("text"), "e", "𠀃"), F.lit(" the")).alias("text"))
    docs = corpus(rows, "astral", "item_id", "text")
    wanted = docs.select(F.lit("q").alias("query_id"), "index_name", "doc_id", F.array(*map(F.lit, ("the", "of", "th"))).alias("terms"))
    return highlight(docs, wanted, Analyzer(), PositionEncoding.UTF16).select("doc_id", "start", "end")


# scripts other than Latin: fixed texts, and the rows expected of them

def _values(columns: str, rows: list[tuple]) -> str:
    def lit(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


_FIXED = {1: "你好世界", 2: "hello 世界", 3: "こんにちは世界", 4: "東京へようこそ", 5: "重庆火锅", 6: "北京大学", 7: "明博", 8: "方案", 9: "안녕하세요 세계", 10: "nihao greeting"}
_READINGS = {
    c: tuple(r.split("/"))
    for c, r in (p.split(":") for p in "你:ni 好:hao 世:shi 界:jie 重:zhong/chong 庆:qing 火:huo 锅:guo 北:bei 京:jing 大:da 学:xue 明:ming 博:bo 方:fang 案:an 東:dong".split())
}


def _fixed(spark: SparkSession) -> tuple[Index, Analyzer]:
    analyzer = Analyzer(readings=_READINGS)
    key = (spark.sparkContext.applicationId, "", "cjk")
    if key not in _built:
        docs = spark.createDataFrame([("cjk", k, v, True) for k, v in _FIXED.items()], "index_name string, doc_id int, content string, indexed boolean")
        _built[key] = Index.build(docs.coalesce(1), analyzer).store()
    return _built[key], analyzer


@_register("script_runs", _values("k, run, script", [(0, "hello", "latin"), (1, " ", "other"), (2, "世界", "han"), (3, ",", "other"), (4, "ラ", "katakana"), (5, "ー", "other"), (6, "メン", "katakana"), (7, "こん", "hiragana"), (8, "안녕", "hangul"), (9, " привет мир!", "other")]))
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.createDataFrame([("hello 世界,ラーメンこん안녕 привет мир!",)], "text string")
    return one.select(F.posexplode(T.script_runs(F.col("text"))).alias("k", "run")).withColumn("script", T.script_of(F.col("run")))


@_register("char_bigrams_kana", _values("k, token", [(0, "こ"), (1, "こん"), (2, "ん"), (3, "んに"), (4, "に")]))
def char_bigrams_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("こんに",)], "t string").select(F.posexplode(T.uni_bigrams(F.col("t"))).alias("k", "token"))


@_register("char_bigrams_hangul", _values("k, token", [(0, "안"), (1, "안녕"), (2, "녕")]))
def char_bigrams_hangul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("안녕",)], "t string").select(F.posexplode(T.uni_bigrams(F.col("t"))).alias("k", "token"))


@_register("lexicon_segment", _values("ord, term, start, end_", [(0, "こん", 0, 6), (1, "に", 6, 9), (2, "にち", 6, 12), (3, "ち", 9, 12), (4, "ちは", 9, 15), (5, "は", 12, 15)]))
def lexicon_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([("i", 1, "こんにちは")], "index_name string, doc_id int, content string")
    analyzer = Analyzer(dictionary=DictionaryConfig(japanese=ScriptDictionary({"こん"})))
    return X.tokens(docs, analyzer).select("ord", "term", "start", F.col("end").alias("end_"))


_TRAIN = TrainingConfig(min_freq=2, min_len=2, max_len=3, max_entries=5, version="v1")


@_register("lexicon_train", _values("language, entry, freq, rank", [("japanese", "こんに", 2, 1), ("japanese", "にちは", 2, 2), ("japanese", "んにち", 2, 3), ("japanese", "こん", 2, 4), ("japanese", "ちは", 2, 5), ("hangul", "안녕", 2, 1)]))
def lexicon_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([("こんにちは世界",), ("こんにちは友達",), ("안녕 세계",), ("안녕",)], "text string")
    return lexicon_counts(texts, _TRAIN).select("language", "entry", F.col("freq").cast("int").alias("freq"), "rank")


@_register("lexicon_export", _values("language, version, entry_count, entries", [("japanese", "v1", 2, "こん にち"), ("hangul", "ko-unversioned", 1, "안녕")]))
def lexicon_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = DictionaryConfig(ScriptDictionary({"にち", "こん"}, "v1"), ScriptDictionary({"안녕"}))
    return export(spark, config).select("language", "version", "entry_count", F.array_join("entries", " ").alias("entries"))


@_register("pinyin_variants", _values("term, k, full_, initials", [("重庆", 0, "zhongqing", "zq"), ("重庆", 1, "chongqing", "cq"), ("你好", 0, "nihao", "nh")]))
def pinyin_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, k, full, initials) for t in ("重庆", "你好", "你x") for k, (full, initials) in enumerate(variants(t, _READINGS))]
    return spark.createDataFrame(rows, "term string, k int, full_ string, initials string")


@_register("pinyin_prefixes", _values("prefix", [("ni",), ("nih",), ("niha",)]))
def pinyin_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in prefixes("nihao", (2, 16))], "prefix string")


@_register("prefix_suppression", _values("term, domain, tf", [("ni", "pinyin_full", 1), ("nini", "pinyin_full", 1), ("nin", "pinyin_full_prefix", 1)]))
def prefix_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([("i", 1, "你,你你", True)], "index_name string, doc_id int, content string, indexed boolean")
    index = Index.build(docs, Analyzer(readings=_READINGS, words={"你": 1.0, "你你": 9.0}))
    return index.postings.filter("domain in ('pinyin_full', 'pinyin_full_prefix')").select("term", "domain", F.col("tf").cast("int").alias("tf"))


@_register("derived_spans", _values("term, start, end_", [("nihao", 0, 6), ("shijie", 6, 12), ("nh", 0, 6), ("sj", 6, 12)]))
def derived_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([("i", 1, "你好世界")], "index_name string, doc_id int, content string")
    spans = X.derived_spans(X.tokens(docs, Analyzer(readings=_READINGS)))
    return spans.filter("term in ('nihao', 'shijie', 'nh', 'sj')").select("term", "start", F.col("end").alias("end_"))


def _fixed_search(name: str, mode: SearchMode, answers: dict[str, list[int]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index, analyzer = _fixed(spark)
        asked = spark.createDataFrame([(q, "cjk", q) for q in answers], "query_id string, index_name string, text string")
        return P.search(index, asked, mode, analyzer).select("query_id", "doc_id")

    QUERIES[name] = run
    ORACLES[name] = _values("query_id, doc_id", [(q, d) for q, ids in answers.items() for d in ids])


_fixed_search("pinyin_full_search", SearchMode.PINYIN, {"nihao": [1], "zhongqing": [5], "chongqing": [5], "shijie": [1, 2], "dongjing": []})
_fixed_search("pinyin_initials_search", SearchMode.PINYIN, {"nh": [1], "sj": [1, 2], "bjdx": [6]})
_fixed_search("pinyin_prefix_search", SearchMode.PINYIN, {"nih": [1], "shij": [1, 2], "beij": [6], "nhs": [1]})
_fixed_search("pinyin_fuzzy_search", SearchMode.AUTO, {"shijia": [1, 2], "zhongqin": [5]})
_fixed_search("cjk_fuzzy", SearchMode.AUTO, {"明搏": [7], "方桉": [8]})
_fixed_search("kana_adjacency_skip", SearchMode.PINYIN, {"dongjing": [], "nihao": [1]})
