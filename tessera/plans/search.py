"""Search plans: batches of queries as joins, aggregations and staged fallbacks.

Every plan takes the tokens of many queries at once, (query_id, index_name, q_idx, term, n_terms,
ascii), and gives hits (query_id, index_name, doc_id, score, matched_terms).  A route that
comes later sees only the queries that no earlier one has satisfied, so a query's answer is that of
its first sufficient route.

A batch of up to ``LOCAL_TOKENS`` tokens is part of the plan itself: its terms and n-grams are pushed
down to the files of postings, terms and n-grams as literals, and its sides of joins are broadcast,
their size being known.  A larger batch is a table, and the same joins are left to Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.analyzer import Analyzer, is_ascii_word
from ..operators import scoring as S
from ..operators.index import Index, tokens
from ..schema import DOMAINS, FULL, FULL_PREFIX, FUZZY_PENALTY, HITS, INITIALS, INITIALS_PREFIX, MATCHED, MAX_CANDIDATES, MAX_LENGTH_GAP, ORIGINAL, PREFIX_DOMAINS, SearchMode
from ..session import cut, local_rows, stored

#: Query tokens that are handled as literals; candidates of fuzzy search are 20 times as many at most.
LOCAL_TOKENS = 5_000
_KEY = ["query_id", "index_name"]
_TOKENS = "query_id string, index_name string, q_idx int, term string, n_terms long, ascii boolean"


def query_tokens(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Tokens of (query_id, index_name, text), repeated ones kept."""
    few = queries.select(F.col("query_id").cast("string").alias("query_id"), "index_name", "text").limit(LOCAL_TOKENS + 1).collect()
    if len(few) <= LOCAL_TOKENS:
        rows = []
        for query_id, group in _by_query(few).items():
            terms = [t.term for text in group for t in analyzer.tokens(text or "", derive=False)]
            ascii_ = all(map(is_ascii_word, terms))
            rows += [(*query_id, k, t, len(terms), ascii_) for k, t in enumerate(terms)]
        if len(rows) <= LOCAL_TOKENS:
            return local_rows(queries.sparkSession, rows, _TOKENS)
    rows = queries.select("index_name", F.col("query_id").cast("string").alias("doc_id"), F.col("text").alias("content"))
    found = tokens(rows, analyzer, derive=False).withColumnRenamed("doc_id", "query_id")
    w = Window.partitionBy("query_id", "index_name")
    return cut(
        found.select(
            "query_id",
            "index_name",
            F.col("ord").alias("q_idx"),
            "term",
            F.count(F.lit(1)).over(w).alias("n_terms"),
            F.min(F.col("term").rlike(r"\A[A-Za-z0-9]*\z")).over(w).alias("ascii"),
        )
    )


def _by_query(rows: list) -> dict[tuple[str, str], list[str]]:
    out: dict[tuple[str, str], list[str]] = {}
    for r in rows:
        out.setdefault((r["query_id"], r["index_name"]), []).append(r["text"])
    return out


def _among(table: DataFrame, column: str, wanted: DataFrame, literals: list[str] | None) -> DataFrame:
    """Rows of ``table`` with a wanted value: by literals where they are few."""
    return table.join(wanted, ["index_name", column], "left_semi") if literals is None else table.filter(F.col(column).isin(literals))


def _where(q: DataFrame, test: Callable, column: Column) -> DataFrame:
    return local_rows(q.sparkSession, [r for r in q.collect() if test(r)], q.schema) if q.isLocal() else q.filter(column)


def _without(q: DataFrame, ids: DataFrame) -> DataFrame:
    """Tokens of the queries that aren't among ``ids``."""
    if not q.isLocal():
        return cut(q.join(ids, _KEY, "left_anti"))
    gone = {tuple(r) for r in ids.select(*_KEY).collect()}  # as many as there are queries, at most
    return _where(q, lambda r: (r["query_id"], r["index_name"]) not in gone, F.lit(True))


def _none_left(q: DataFrame) -> bool:
    return not q.collect() if q.isLocal() else q.isEmpty()


def _no_hits(index: Index, spark: SparkSession) -> DataFrame:
    return local_rows(spark, [], HITS.format(id=index.documents.schema["doc_id"].dataType.simpleString()))


def _hits(scored: DataFrame, matches: Column, needed: Column) -> DataFrame:
    return scored.filter(matches >= needed).select(*_KEY, "doc_id", "score", "matched_terms")


def _length(domain: str) -> Column:
    return F.lit(0.0) if domain in PREFIX_DOMAINS else F.col("dl").cast("double")


def _absent(index: Index, domain: str) -> bool:
    return all(d != domain for _, d in index.statistics())


def _seen(index: Index, domain: str, terms: list[str]) -> dict[tuple[str, str], int]:
    """(index_name, term) -> document frequency of the terms that have postings in the domain."""
    rows = index.kept("terms").filter((F.col("domain") == domain) & F.col("term").isin(terms)).select("index_name", "term", "df").collect()
    return {(r["index_name"], r["term"]): r["df"] for r in rows}


def bm25_search(index: Index, q: DataFrame, domain: str) -> DataFrame:
    """Exact terms in one domain."""
    if _absent(index, domain):
        return _no_hits(index, q.sparkSession)
    literals = None
    if q.isLocal():
        # views: the query tokens that have postings; available: how many of a query's tokens, with repeats, do
        literals = sorted({r["term"] for r in q.collect()})
        df, stats = _seen(index, domain, literals), index.statistics()
        found = [r for r in q.collect() if (r["index_name"], r["term"]) in df]
        available = Counter((r["query_id"], r["index_name"]) for r in found)
        rows = [(r["query_id"], r["index_name"], r["term"], r["n_terms"], available[r["query_id"], r["index_name"]], df[r["index_name"], r["term"]], *stats[r["index_name"], domain]) for r in found]
        views = local_rows(q.sparkSession, rows, "query_id string, index_name string, term string, n_terms long, available long, df long, n long, avgdl double")
        literals = sorted({r[2] for r in rows})
    else:
        df = index.kept("terms").filter(F.col("domain") == domain).select("index_name", "term", "df")
        stats = index.kept("stats").filter(F.col("domain") == domain).select("index_name", "n", "avgdl")
        views = q.join(df, ["index_name", "term"]).withColumn("available", F.count(F.lit(1)).over(Window.partitionBy(*_KEY))).join(stats, "index_name")
    lists = _among(index.postings.filter(F.col("domain") == domain).drop("domain"), "term", q.select("index_name", "term").distinct(), literals)
    part = S.bm25(F.col("tf"), _length(domain), F.col("avgdl"), S.idf(F.col("n"), F.col("df"))) * DOMAINS[domain].weight
    rows = lists.join(views, ["index_name", "term"]).withColumn("component", part).filter("component > 0")
    scored = rows.groupBy(*_KEY, "doc_id").agg(
        F.sum("component").alias("score"),
        F.array_sort(F.collect_set(F.struct("term", F.lit(domain).alias("domain")))).alias("matched_terms"),
        F.first("n_terms").alias("n_terms"),
        F.first("available").alias("available"),
    )
    return _hits(scored, F.size("matched_terms"), S.min_should_match(F.col("n_terms"), F.col("available")))


def fuzzy_candidates(index: Index, q: DataFrame, domain: str) -> DataFrame:
    """(query_id, index_name, q_idx, term, candidate, similarity): dictionary terms near each query token.

    Terms with n-grams meet the 40 dictionary terms that share most of them, of which the first
    20 within the length gap and threshold stay; one-character terms meet themselves or, if they
    aren't in the dictionary, scan it.  Ties go to the lesser term.
    """
    columns = [*_KEY, "q_idx", "term", "candidate", "similarity"]
    literals = sorted({g for r in q.collect() for g in T.ngrams_of(r["term"])}) if q.isLocal() else None
    tokens_ = q.select(*_KEY, "q_idx", "term")
    place = Window.partitionBy(*_KEY, "q_idx")
    near = F.abs(F.length("candidate") - F.length("term")) <= MAX_LENGTH_GAP
    sim = T.similarity(F.col("candidate"), F.col("term"))

    q_grams = tokens_.filter(F.length("term") >= 2).select(*_KEY, "q_idx", "term", F.explode(T.char_ngrams(F.col("term"))).alias("gram"))
    grams = _among(index.kept("grams").filter(F.col("domain") == domain).drop("domain"), "gram", q_grams.select("index_name", "gram").distinct(), literals)
    shared = q_grams.join(grams.withColumnRenamed("term", "candidate"), ["index_name", "gram"]).groupBy(*_KEY, "q_idx", "term", "candidate").agg(F.count(F.lit(1)).alias("shared"))
    ranked = shared.withColumn("rank", F.row_number().over(place.orderBy(F.desc("shared"), "candidate"))).filter(F.col("rank") <= 2 * MAX_CANDIDATES)
    kept = ranked.filter(near).withColumn("similarity", sim).filter(F.col("similarity") >= T.fuzzy_threshold(F.col("term")))
    first = kept.withColumn("again", F.row_number().over(place.orderBy("rank"))).filter(F.col("again") <= MAX_CANDIDATES).select(columns)
    if q.isLocal() and all(len(r["term"]) >= 2 for r in q.collect()):
        return first

    dictionary = index.dictionary().filter(F.col("domain") == domain).select("index_name", F.col("term").alias("candidate"))
    short = tokens_.filter(F.length("term") < 2)
    exact = short.join(dictionary, (short["index_name"] == dictionary["index_name"]) & (F.col("term") == F.col("candidate")), "left_semi")
    known = exact.select(*_KEY, "q_idx", "term", F.col("term").alias("candidate"), F.lit(1.0).alias("similarity"))
    absent = short.join(exact.select(*_KEY, "q_idx"), [*_KEY, "q_idx"], "left_anti")
    lengths = absent.select("*", F.explode(F.sequence(F.lit(0), F.length("term") + MAX_LENGTH_GAP)).alias("size"))
    sized = dictionary.withColumn("size", F.length("candidate"))
    scanned = lengths.join(sized, ["index_name", "size"]).withColumn("similarity", sim).filter(F.col("similarity") >= T.fuzzy_threshold(F.col("term")))
    best = scanned.withColumn("rank", F.row_number().over(place.orderBy(F.desc("similarity"), "candidate"))).filter(F.col("rank") <= MAX_CANDIDATES)
    return first.unionByName(known.select(columns)).unionByName(best.select(columns))


def fuzzy_search(index: Index, q: DataFrame, domain: str, allow_non_ascii: bool = False) -> DataFrame:
    """Terms near the query's, in one domain."""
    if _absent(index, domain):
        return _no_hits(index, q.sparkSession)
    q = q if allow_non_ascii else _where(q, lambda r: r["ascii"], F.col("ascii"))
    near = fuzzy_candidates(index, q, domain)
    literals = None
    if q.isLocal():
        near = [tuple(r) for r in near.collect()]  # 20 a token at most
        literals = sorted({r[4] for r in near})
        n_terms = {(r["query_id"], r["index_name"]): r["n_terms"] for r in q.collect()}
        df, stats = _seen(index, domain, literals), index.statistics()
        available = Counter(k for k in {(*r[:3],) for r in near})
        available = Counter(k[:2] for k in available)
        rows = [(*r[:3], r[4], r[5], n_terms[r[:2]], available[r[:2]], df[r[1], r[4]], *stats[r[1], domain]) for r in near if (r[1], r[4]) in df]
        views = local_rows(q.sparkSession, rows, "query_id string, index_name string, q_idx int, term string, similarity double, n_terms long, available long, df long, n long, avgdl double")
        wanted = views.select("index_name", "term")
    else:
        found = near.join(q.select(*_KEY, "q_idx", "n_terms"), [*_KEY, "q_idx"])
        available = found.groupBy(*_KEY).agg(F.count_distinct("q_idx").alias("available"))
        wanted = found.select("index_name", F.col("candidate").alias("term")).distinct()
        df = index.kept("terms").filter(F.col("domain") == domain).select("index_name", "term", "df")
        stats = index.kept("stats").filter(F.col("domain") == domain).select("index_name", "n", "avgdl")
        views = found.drop("term").withColumnRenamed("candidate", "term").join(df, ["index_name", "term"]).join(stats, "index_name").join(available, _KEY)
    lists = _among(index.postings.filter(F.col("domain") == domain).drop("domain"), "term", wanted, literals)
    part = S.bm25(F.col("tf"), _length(domain), F.col("avgdl"), S.idf(F.col("n"), F.col("df"))) * (DOMAINS[domain].weight * FUZZY_PENALTY) * F.col("similarity")
    rows = lists.join(views, ["index_name", "term"]).withColumn("component", part).filter("component > 0")
    scored = rows.groupBy(*_KEY, "doc_id").agg(
        F.sum("component").alias("score"),
        F.array_sort(F.collect_set(F.struct("term", F.lit(domain).alias("domain")))).alias("matched_terms"),
        F.size(F.collect_set("q_idx")).alias("positions"),
        F.first("n_terms").alias("n_terms"),
        F.first("available").alias("available"),
    )
    return _hits(scored, F.col("positions"), S.min_should_match(F.col("n_terms"), F.col("available")))


def _ids(hits: DataFrame) -> DataFrame:
    return hits.select(*_KEY).distinct()


def either(first: DataFrame, second: Callable[[DataFrame], DataFrame], q: DataFrame) -> DataFrame:
    """The first's hits, and the second's for the queries that the first has none for."""
    if first.isLocal():  # none: its domain isn't there
        return second(q)
    first = stored(first)
    rest = _without(q, _ids(first))
    return first if _none_left(rest) else first.unionByName(second(rest))


def satisfied(hits: DataFrame, q: DataFrame) -> DataFrame:
    """Queries of which some hit matches enough of all their terms."""
    terms = q.select(*_KEY, "n_terms").distinct()
    most = hits.groupBy(*_KEY).agg(F.max(F.size("matched_terms")).alias("most")).join(terms, _KEY)
    done = most.filter(F.col("most") >= S.min_should_match(F.col("n_terms"), F.col("n_terms"))).select(*_KEY)
    return local_rows(q.sparkSession, done.collect(), done.schema) if q.isLocal() else cut(done)


def pinyin_exact(index: Index, q: DataFrame) -> DataFrame:
    return either(bm25_search(index, q, FULL), lambda rest: bm25_search(index, rest, INITIALS), q)


def pinyin_prefix(index: Index, q: DataFrame) -> DataFrame:
    return either(bm25_search(index, q, FULL_PREFIX), lambda rest: bm25_search(index, rest, INITIALS_PREFIX), q)


def pinyin_search(index: Index, q: DataFrame) -> DataFrame:
    q = _where(q, lambda r: r["ascii"], F.col("ascii"))
    return either(pinyin_exact(index, q), lambda rest: pinyin_prefix(index, rest), q)


def fuzzy_pinyin(index: Index, q: DataFrame) -> DataFrame:
    return either(fuzzy_search(index, q, FULL), lambda rest: fuzzy_search(index, rest, INITIALS), q)


def auto_search(index: Index, q: DataFrame) -> DataFrame:
    """Exact; then, for queries with other than ASCII letters and digits, fuzzy and no more; for the
    others pinyin prefixes, pinyin, fuzzy and fuzzy pinyin, until one suffices.

    Each route's hits are written before the next; a route without queries left, or without postings
    in its domain, isn't run."""
    out = _no_hits(index, q.sparkSession)
    rest = q

    def settle(hits: DataFrame, rest: DataFrame) -> DataFrame:
        """Take the hits of the queries that these satisfy; the tokens of the others."""
        nonlocal out
        if hits.isLocal():
            return rest
        hits = stored(hits)
        done = satisfied(hits, rest)
        out = out.unionByName(hits.join(done, _KEY, "left_semi"))
        return _without(rest, done)

    rest = settle(bm25_search(index, rest, ORIGINAL), rest)
    foreign = _where(rest, lambda r: not r["ascii"], ~F.col("ascii"))
    if not _none_left(foreign):
        out = out.unionByName(fuzzy_search(index, foreign, ORIGINAL, allow_non_ascii=True))
    rest = _where(rest, lambda r: r["ascii"], F.col("ascii"))
    for route in (pinyin_prefix, pinyin_exact):
        if not _none_left(rest):
            rest = settle(route(index, rest), rest)
    if _none_left(rest):
        return out
    hits = fuzzy_search(index, rest, ORIGINAL)
    if _absent(index, FULL) and _absent(index, INITIALS):
        return out.unionByName(hits)
    hits = stored(hits)
    rest = _without(rest, _ids(hits))
    out = out.unionByName(hits)
    return out if _none_left(rest) else out.unionByName(fuzzy_pinyin(index, rest))


def search(index: Index, queries: DataFrame, mode: SearchMode = SearchMode.AUTO, analyzer: Analyzer | None = None) -> DataFrame:
    """Hits of (query_id, index_name, text); ``*`` and the empty query match every document."""
    every = F.col("text").isin("*", "")
    all_ = queries.filter(every).select(F.col("query_id").cast("string").alias("query_id"), "index_name").join(index.match_all(), "index_name")
    all_ = all_.select(*_KEY, "doc_id", "score", F.array().cast(MATCHED).alias("matched_terms"))
    q = query_tokens(queries.filter(~every), analyzer or Analyzer())
    run = {
        SearchMode.EXACT: lambda: bm25_search(index, q, ORIGINAL),
        SearchMode.PINYIN: lambda: pinyin_search(index, q),
        SearchMode.FUZZY: lambda: fuzzy_search(index, q, ORIGINAL),
        SearchMode.AUTO: lambda: auto_search(index, q),
    }[SearchMode(mode)]
    return all_ if q.isLocal() and _none_left(q) else all_.unionByName(run())


def ranked(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Hits with their rank in each query, best first, ties by doc_id; the first k if given."""
    w = Window.partitionBy(*_KEY).orderBy(F.desc("score"), "doc_id")
    out = hits.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)
