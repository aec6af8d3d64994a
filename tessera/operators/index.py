"""The inverted index as tables: documents, postings, and what follows from them."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.analyzer import Analyzer, byte_offsets
from ..schema import DOMAINS, ORIGINAL, POSTINGS, PREFIX_DOMAINS, TOKENS
from ..session import reachable, stored

#: Postings that are sorted together, and rows of a batch that goes back to the JVM.
_RUN, _BATCH = 1_000_000, 50_000
_ORDER = {"terms": ("domain", "index_name", "term"), "grams": ("domain", "index_name", "gram"), "stats": ()}


def _id(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _token_rows(batches: Iterator[pa.RecordBatch], analyzer: Analyzer, derive: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for k, content in enumerate(batch.column("content").to_pylist()):
            for ord_, t in enumerate(analyzer.tokens(content or "", derive)):
                at.append(k)
                rows.append((ord_, *t))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("index_name").take(take), batch.column("doc_id").take(take), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
            names=["index_name", "doc_id", "ord", "term", "domain", "start", "end", "base_term"],
        )


def tokens(docs: DataFrame, analyzer: Analyzer, derive: bool = True) -> DataFrame:
    """Tokens with spans of (index_name, doc_id, content), by the general analyzer."""
    reachable(docs.sparkSession)
    rows = docs.select("index_name", "doc_id", "content")
    return rows.mapInArrow(lambda b: _token_rows(b, analyzer, derive), TOKENS.format(id=_id(docs)))


def native_terms(docs: DataFrame) -> DataFrame:
    """(index_name, doc_id, term): one row a token, without leaving the JVM; for native texts."""
    return docs.select("index_name", "doc_id", F.explode(T.latin_terms(F.col("content"))).alias("term"))


class _Codes(dict):
    """Numbers of terms in the order in which they are met."""

    def __missing__(self, term: str) -> int:
        self[term] = len(self)
        return self[term]


class _Run:
    """Postings of some documents, given out sorted by domain, index and term."""

    def __init__(self, id_type: pa.DataType):
        self.id_type = id_type
        self.names, self.ids, self.size = [], [], 0
        #: by domain: terms, and of each document its place, its terms' codes and frequencies
        self.domains: dict[str, tuple[_Codes, list[int], list[int], array, array]] = {}

    def add(self, name: str, doc_id: object, counts: dict[str, dict[str, int]]) -> None:
        for domain, freq in counts.items():
            if freq:
                seen, places, sizes, codes, tfs = self.domains.setdefault(domain, (_Codes(), [], [], array("i"), array("q")))
                places.append(len(self.ids))
                sizes.append(len(freq))
                codes.extend(map(seen.__getitem__, freq))
                tfs.extend(freq.values())
                self.size += len(freq)
        self.names.append(name)
        self.ids.append(doc_id)

    def batches(self) -> Iterator[pa.RecordBatch]:
        names, ids = pa.array(self.names, pa.string()), pa.array(self.ids, self.id_type)
        name_rank = np.unique(np.array(self.names, dtype=object).astype(str), return_inverse=True)[1] if self.names else np.zeros(0, np.int64)
        for domain in sorted(self.domains):
            seen, places, sizes, codes, tfs = self.domains[domain]
            terms, sizes, tf = pa.array(list(seen), pa.string()), np.array(sizes), np.frombuffer(tfs, np.int64)
            rank = np.empty(len(terms), np.int64)
            rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
            code, doc = np.frombuffer(codes, np.int32), np.repeat(np.array(places), sizes)
            dl = np.repeat(np.add.reduceat(tf, np.concatenate([[0], np.cumsum(sizes)[:-1]])), sizes)
            order = np.argsort(name_rank[doc] * len(terms) + rank[code], kind="stable")
            for k in range(0, len(order), _BATCH):
                at = order[k : k + _BATCH]
                own = pa.array(doc[at])
                columns = [names.take(own), pa.array([domain] * len(at), pa.string()), terms.take(pa.array(code[at])), ids.take(own), pa.array(tf[at]), pa.array(dl[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["index_name", "domain", "term", "doc_id", "tf", "dl"])


def _posting_rows(batches: Iterator[pa.RecordBatch], analyzer: Analyzer) -> Iterator[pa.RecordBatch]:
    run = None
    for batch in batches:
        run = run or _Run(batch.column("doc_id").type)
        for name, doc_id, content in zip(batch.column("index_name").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("content")):
            text = content.as_py()
            if not analyzer.tokenizers and T.native(text):
                counts = {ORIGINAL: Counter(T.native_words(text))}
            else:
                counts = {}
                for t in analyzer.tokens(text):
                    counts.setdefault(t.domain, Counter())[t.term] += 1
            run.add(name, doc_id, counts)
            if run.size >= _RUN or len(run.ids) >= _RUN:
                yield from run.batches()
                run = _Run(run.id_type)
    if run is not None:
        yield from run.batches()


def postings(docs: DataFrame, analyzer: Analyzer, unique: bool = False) -> DataFrame:
    """(index_name, domain, term, doc_id, tf, dl); dl: tokens of the document in the domain.

    A document is counted where it is read, so neither texts nor postings are exchanged and a task holds
    one run of postings at a time.  Runs are sorted by domain, index and term.  ``unique``: no id occurs
    twice; else that is looked up first, and rows of one id are counted as one document.
    """
    reachable(docs.sparkSession)
    keys = ["index_name", "doc_id"]
    rows = docs.filter("indexed and content is not null").select(*keys, "content")
    found = rows.mapInArrow(lambda b: _posting_rows(b, analyzer), POSTINGS.format(id=_id(docs)))
    if unique:
        return found
    again = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("index_name").alias("name"), F.col("doc_id").alias("id"))
    if again.isEmpty():
        return found
    same = F.col("index_name").eqNullSafe(F.col("name")) & F.col("doc_id").eqNullSafe(F.col("id"))
    one = found.join(again, same, "left_semi").groupBy("index_name", "domain", "term", "doc_id").agg(F.sum("tf").alias("tf"))
    one = one.withColumn("dl", F.sum("tf").over(Window.partitionBy(*keys, "domain")))
    return found.join(again, same, "left_anti").unionByName(one)


@dataclass
class Index:
    """documents: (index_name, doc_id, content, indexed); postings: see ``postings``."""

    documents: DataFrame
    postings: DataFrame
    #: (index_name, doc_id) of documents whose terms fuzzy search no longer finds; None: of none.
    cleared: DataFrame | None = None
    #: Whether the postings are in sorted runs already.
    in_runs: bool = False
    _kept: dict = field(default_factory=dict, repr=False)

    def kept(self, name: str) -> DataFrame:
        """``terms``, ``grams`` or ``stats``, written once and reused by all searches on this index."""
        if name not in self._kept:
            made = getattr(self, name)()
            if name == "grams":
                made = made.repartition("gram")
            self._kept[name] = stored(made, *_ORDER[name], partition=() if name == "stats" else ("domain",))
        return self._kept[name]

    def statistics(self) -> dict[tuple[str, str], tuple[int, float]]:
        """(index_name, domain) -> (documents, average length): a row for each domain of each index."""
        if "rows" not in self._kept:
            self._kept["rows"] = {(r["index_name"], r["domain"]): (r["n"], r["avgdl"]) for r in self.kept("stats").collect()}
        return self._kept["rows"]

    @classmethod
    def build(cls, documents: DataFrame, analyzer: Analyzer | None = None, unique: bool = False) -> Index:
        return cls(documents, postings(documents, analyzer or Analyzer(), unique), in_runs=True)

    def store(self) -> Index:
        """The same, with postings in files, in which they are sorted by domain, index and term, or in runs that are."""
        return Index(self.documents, stored(self.postings, *self.order()), self.cleared, True)

    def order(self) -> tuple[str, ...]:
        """By what the postings are still to be sorted within files."""
        return () if self.in_runs else ("domain", "index_name", "term")

    def clear(self, index_name: str, only_dictionaries: bool = False) -> Index:
        """Without the documents of an index; or with them, but unknown to fuzzy search until written again."""
        other = F.col("index_name") != index_name
        cleared = None if self.cleared is None else self.cleared.filter(other)
        if not only_dictionaries:
            return Index(self.documents.filter(other), self.postings.filter(other), cleared)
        own = self.documents.filter(~other).select("index_name", "doc_id")
        return Index(self.documents, self.postings, own if cleared is None else cleared.unionByName(own))

    def terms(self) -> DataFrame:
        """(index_name, domain, term, n_chars, df, in_aux) of every posting list."""
        aux = F.when(F.col("domain").isin(*PREFIX_DOMAINS), False).when(F.col("domain") == ORIGINAL, T.in_dictionary(F.col("term"))).otherwise(True)
        rows, known = self.postings, F.lit(True)
        if self.cleared is not None:
            rows = rows.join(self.cleared.withColumn("cleared", F.lit(True)), ["index_name", "doc_id"], "left")
            known = F.max(F.col("cleared").isNull())
        counted = rows.groupBy("index_name", "domain", "term").agg(F.count(F.lit(1)).alias("df"), known.alias("known") if self.cleared is not None else F.first(known).alias("known"))
        return counted.select("index_name", "domain", "term", F.length("term").alias("n_chars"), "df", (aux & F.col("known")).alias("in_aux"))

    def dictionary(self) -> DataFrame:
        """Terms that fuzzy search may find."""
        return self.kept("terms").filter("in_aux").select("index_name", "domain", "term", "n_chars", "df")

    def grams(self) -> DataFrame:
        """(index_name, domain, gram, term): distinct n-grams of the dictionary's terms."""
        return self.dictionary().select("index_name", "domain", F.explode(F.array_distinct(T.char_ngrams(F.col("term")))).alias("gram"), "term")

    def doc_lens(self) -> DataFrame:
        """(index_name, domain, doc_id, len)."""
        return self.postings.groupBy("index_name", "domain", "doc_id").agg(F.sum("tf").alias("len"))

    def stats(self) -> DataFrame:
        """(index_name, domain, n, total, avgdl): n counts staged documents too."""
        n = self.documents.groupBy("index_name").agg(F.count(F.lit(1)).alias("n"))
        total = self.postings.groupBy("index_name", "domain").agg(F.sum("tf").alias("total"))
        avgdl = F.when(F.col("domain").isin(*PREFIX_DOMAINS), 0.0).otherwise(F.col("total") / F.col("n"))
        return total.join(n, "index_name").select("index_name", "domain", "n", "total", avgdl.alias("avgdl"))

    def match_all(self) -> DataFrame:
        return self.documents.select("index_name", "doc_id", F.lit(1.0).alias("score"))

    def get_doc(self, index_name: str, doc_id: object) -> DataFrame:
        return self.documents.filter((F.col("index_name") == index_name) & (F.col("doc_id") == doc_id)).select("content")

    def upsert(self, changed: DataFrame, analyzer: Analyzer | None = None, unique: bool = False) -> Index:
        """Replace or add documents (index_name, doc_id, content, indexed)."""
        rest = self.remove(changed.select("index_name", "doc_id"))
        new = Index.build(changed, analyzer, unique)
        return Index(rest.documents.unionByName(new.documents), rest.postings.unionByName(new.postings), rest.cleared)

    def remove(self, ids: DataFrame) -> Index:
        """Without the documents (index_name, doc_id); their terms go with their postings."""
        keys = ["index_name", "doc_id"]
        gone = ids.select(keys).distinct()
        without = lambda df: df.join(gone, keys, "left_anti")
        return Index(without(self.documents), without(self.postings), None if self.cleared is None else without(self.cleared))


def last_write(docs: DataFrame, order: str) -> DataFrame:
    """Of several versions of a document the one that comes last by ``order``."""
    w = Window.partitionBy("index_name", "doc_id").orderBy(F.col(order).desc())
    return docs.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def _native_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Byte spans of each term of a native text, in order."""
    found: dict[str, list[tuple[int, int]]] = {}
    at = None if text.isascii() else byte_offsets(text)
    for m in T.native_matches(text):
        found.setdefault(m[0], []).append(m.span() if at is None else (int(at[m.start()]), int(at[m.end()])))
    return found


def _forward_rows(batches: Iterator[pa.RecordBatch], analyzer: Analyzer) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        docs, terms, ends, starts, stops = [], [], [0], array("i"), array("i")

        def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            take = pa.array(docs, pa.int64())
            spans = pa.StructArray.from_arrays([pa.array(np.frombuffer(x, np.int32)) for x in (starts, stops)], fields=list(span))
            columns = [batch.column("index_name").take(take), batch.column("doc_id").take(take), pa.array(terms, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)]
            return pa.RecordBatch.from_arrays(columns, names=["index_name", "doc_id", "term", "spans"])

        for k, content in enumerate(batch.column("content")):
            text = content.as_py() or ""
            if not analyzer.tokenizers and T.native(text):
                own = _native_spans(text)
            else:
                own = {}
                for t in analyzer.tokens(text, derive=False):
                    own.setdefault(t.term, []).append((t.start, t.end))
            for term, found in own.items():
                docs.append(k)
                terms.append(term)
                starts.extend([s for s, _ in found])
                stops.extend([e for _, e in found])
                ends.append(len(starts))
            if len(starts) >= _BATCH:
                yield made()
                docs, terms, ends, starts, stops = [], [], [0], array("i"), array("i")
        yield made()


def forward_positions(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(index_name, doc_id, term, spans): original spans of each term in token order, in bytes.

    A document's are gathered where it is read: nothing is exchanged, and a task holds those of one document
    and a batch at most."""
    reachable(docs.sparkSession)
    rows = docs.select("index_name", "doc_id", "content")
    schema = f"index_name string, doc_id {_id(docs)}, term string, spans array<struct<start: int, end: int>>"
    return rows.mapInArrow(lambda b: _forward_rows(b, analyzer), schema)


def derived_spans(token_rows: DataFrame) -> DataFrame:
    """(index_name, doc_id, term, start, end): shortest distinct spans of derived terms."""
    rows = token_rows.filter(F.col("domain") != ORIGINAL).select("index_name", "doc_id", "term", "start", "end").distinct()
    w = Window.partitionBy("index_name", "doc_id", "term").orderBy(F.col("end") - F.col("start"))
    return rows.withColumn("__rank", F.rank().over(w)).filter("__rank = 1").drop("__rank")


def doc_lengths(documents: DataFrame, postings: DataFrame) -> DataFrame:
    """(index_name, doc_id, domain, len) of rows that may lack lengths, as older snapshots do.

    Of a document the stored ones (``dl``) if any is positive, else those counted from ``tf``; a document
    without postings has its ``doc_len`` in the original domain."""
    keys = ["index_name", "doc_id"]
    each = postings.groupBy(*keys, "domain").agg(F.coalesce(F.max("dl"), F.lit(0)).alias("stored"), F.sum("tf").alias("counted"))
    any_ = F.max("stored").over(Window.partitionBy(*keys)) > 0
    known = each.select(*keys, "domain", F.when(any_, F.col("stored")).otherwise(F.col("counted")).alias("len")).filter("len > 0")
    rest = documents.join(known.select(*keys).distinct(), keys, "left_anti").filter("doc_len > 0")
    return known.unionByName(rest.select(*keys, F.lit(ORIGINAL).alias("domain"), F.col("doc_len").cast("long").alias("len")))


def weights() -> Column:
    """Weight of the column ``domain``."""
    return F.create_map(*[F.lit(x) for d in DOMAINS.values() for x in (d.name, d.weight)])[F.col("domain")]


def empty_postings(spark: SparkSession, id_type: str) -> DataFrame:
    return spark.createDataFrame([], POSTINGS.format(id=id_type))
