"""``SearchIndex``: named indexes with changes, search, highlights and snapshots in one object."""

from __future__ import annotations

import copy
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analyzer import Analyzer
from .functions.lexicon import DictionaryConfig
from .functions.pinyin import readings
from .operators import highlight as H
from .operators.index import Index, empty_postings, last_write
from .plans import search as P
from .schema import PositionEncoding, SearchMode
from .session import cut, reachable, stored
from .sources import snapshot as Snap

_DOCS = "index_name string, doc_id {id}, content string, indexed boolean, seq long"
_CHANGES = "index_name string, doc_id {id}, op string"


class SearchIndex:
    """Batches of documents are added, removed and searched; single documents are batches of one.

    Tables are immutable DataFrames: a change makes new ones, and ``compact`` (called every
    ``COMPACT_EVERY`` changes) writes them to the checkpoint folder so that plans stay short.
    A dictionary set later holds for documents added later.
    """

    COMPACT_EVERY = 8

    def __init__(self, spark: SparkSession, analyzer: Analyzer | None = None, encoding: PositionEncoding = PositionEncoding.UTF16, id_type: str = "string"):
        self.spark = reachable(spark)
        self.analyzer = analyzer or Analyzer(readings=readings(spark))
        self.position_encoding = PositionEncoding(encoding)
        self.id_type = id_type
        self._past: list[Analyzer] = [self.analyzer]
        self._index = Index(spark.createDataFrame([], f"index_name string, doc_id {id_type}, content string, indexed boolean, analyzer int"), empty_postings(spark, id_type))
        self._changes = spark.createDataFrame([], _CHANGES.format(id=id_type))
        self._known: set[str] = set()
        self._since = 0

    @classmethod
    def with_position_encoding(cls, spark: SparkSession, encoding: PositionEncoding, **kw: object) -> SearchIndex:
        return cls(spark, encoding=encoding, **kw)

    @classmethod
    def with_dictionary_config(cls, spark: SparkSession, config: DictionaryConfig, **kw: object) -> SearchIndex:
        made = cls(spark, **kw)
        made.set_dictionary_config(config)
        return made

    def set_position_encoding(self, encoding: PositionEncoding) -> None:
        self.position_encoding = PositionEncoding(encoding)

    def set_dictionary_config(self, config: DictionaryConfig | None) -> None:
        self.analyzer = copy.copy(self.analyzer)
        self.analyzer.dictionary = config
        self._past.append(self.analyzer)

    def register_tokenizer(self, script: str, cut: Callable[[str], list[tuple[int, int]]]) -> None:
        """Cut runs of a script (han, hiragana, katakana, hangul, latin, other) with a function of one's own."""
        self.analyzer = copy.copy(self.analyzer)
        self.analyzer.tokenizers = {**self.analyzer.tokenizers, script: cut}
        self._past.append(self.analyzer)

    # changes

    def add_docs(self, docs: DataFrame) -> None:
        """Upsert (index_name, doc_id, content[, indexed][, seq]); of one id the last by seq stays, without
        seq the last in the order of the rows."""
        if "indexed" not in docs.columns:
            docs = docs.withColumn("indexed", F.lit(True))
        docs = docs if "seq" in docs.columns else docs.withColumn("seq", F.monotonically_increasing_id())
        docs = last_write(docs, "seq")
        docs = docs.select("index_name", F.col("doc_id").cast(self.id_type).alias("doc_id"), "content", "indexed", F.lit(len(self._past) - 1).alias("analyzer"))
        self._index = self._index.upsert(docs, self.analyzer, unique=True)
        self._known |= {r[0] for r in docs.select("index_name").distinct().collect()}
        self._changed(docs.select("index_name", "doc_id"), "dirty")

    def add_doc(self, index_name: str, doc_id: object, text: str, index: bool = True) -> None:
        self.add_docs(self.spark.createDataFrame([(index_name, doc_id, text, index, 0)], _DOCS.format(id=self.id_type)))

    def remove_docs(self, ids: DataFrame) -> None:
        """Remove (index_name, doc_id); ids that aren't there are left out."""
        ids = ids.select("index_name", F.col("doc_id").cast(self.id_type).alias("doc_id")).distinct()
        there = ids.join(self._index.documents, ["index_name", "doc_id"], "left_semi")
        there = cut(there)
        self._index = self._index.remove(there)
        self._changed(there, "deleted")

    def remove_doc(self, index_name: str, doc_id: object) -> None:
        self.remove_docs(self.spark.createDataFrame([(index_name, doc_id)], f"index_name string, doc_id {self.id_type}"))

    def clear(self, index_name: str, only_dictionaries: bool = False) -> None:
        """Empty an index, or only what fuzzy search looks terms up in; nothing counts as changed."""
        self._index = self._index.clear(index_name, only_dictionaries)
        if not only_dictionaries:
            self._changes = self._changes.filter(F.col("index_name") != index_name)

    def highlight_batch(self, wanted: DataFrame) -> DataFrame:
        """Spans of (query_id, index_name, doc_id, terms) in the encoding set now: (…, nth, start, end)."""
        parts = [H.highlight(self._index.documents.filter(F.col("analyzer") == k), wanted, a, self.position_encoding) for k, a in enumerate(self._past)]
        return reduce(DataFrame.unionByName, parts)

    def _changed(self, ids: DataFrame, op: str) -> None:
        rest = self._changes.join(ids, ["index_name", "doc_id"], "left_anti")
        self._changes = rest.unionByName(ids.select("index_name", "doc_id", F.lit(op).alias("op")))
        self._since += 1
        if self._since >= self.COMPACT_EVERY:
            self.compact()

    def compact(self) -> None:
        """Write the tables to the shared folder and go on from there."""
        cleared = None if self._index.cleared is None else cut(self._index.cleared)
        self._index = Index(stored(self._index.documents), self._index.postings, cleared).store()
        self._changes = cut(self._changes)
        self._since = 0

    def take_dirty_and_deleted(self) -> tuple[DataFrame, DataFrame]:
        """(index_name, doc_id, content, doc_len) of changed and (index_name, doc_id) of removed
        documents of all indexes; both are then forgotten."""
        key = ["index_name", "doc_id"]
        # one row a key, so that Spark leaves the join out where doc_len isn't read
        lens = self._index.postings.filter("domain = 'original'").groupBy(*key).agg(F.sum("tf").alias("doc_len"))
        dirty = self._changes.filter("op = 'dirty'").join(self._index.documents, key).join(lens, key, "left")
        dirty = dirty.select(*key, "content", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))
        deleted = self._changes.filter("op = 'deleted'").select(*key)
        self._changes = self.spark.createDataFrame([], _CHANGES.format(id=self.id_type))
        return dirty, deleted

    def has_unpersisted_changes(self, index_name: str | None = None) -> bool:
        rows = self._changes if index_name is None else self._changes.filter(F.col("index_name") == index_name)
        return not rows.isEmpty()

    def persist_if_dirty(self, index_name: str, write: Callable[[Index], None]) -> bool:
        """Pass a changed index's snapshot to ``write``; it stays changed if that raises."""
        if not self.has_unpersisted_changes(index_name):
            return False
        one = self.get_snapshot_data(index_name)
        if one is None:
            return False
        write(one)
        self._changes = self._changes.filter(F.col("index_name") != index_name)
        return True

    # reading

    @property
    def tables(self) -> Index:
        return self._index

    def get_doc(self, index_name: str, doc_id: object) -> str | None:
        row = self._index.get_doc(index_name, doc_id).first()
        return None if row is None else row[0]

    def search_batch(self, queries: DataFrame, mode: SearchMode = SearchMode.AUTO) -> DataFrame:
        """Hits of (query_id, index_name, text)."""
        return P.search(self._index, queries, mode, self.analyzer)

    def search_with_mode_hits(self, index_name: str, query: str, mode: SearchMode = SearchMode.AUTO) -> DataFrame:
        """(doc_id, score, matched_terms), best first, ties by doc_id."""
        one = self.spark.createDataFrame([("0", index_name, query)], "query_id string, index_name string, text string")
        return self.search_batch(one, mode).select("doc_id", "score", "matched_terms").orderBy(F.desc("score"), "doc_id")

    def search_hits(self, index_name: str, query: str) -> DataFrame:
        return self.search_with_mode_hits(index_name, query, SearchMode.AUTO)

    def search_with_mode(self, index_name: str, query: str, mode: SearchMode) -> DataFrame:
        return self.search_with_mode_hits(index_name, query, mode).select("doc_id", "score")

    def search(self, index_name: str, query: str) -> DataFrame:
        return self.search_with_mode(index_name, query, SearchMode.AUTO)

    def get_matches_for_terms(self, index_name: str, doc_id: object, terms: list[str]) -> list[tuple[int, int]]:
        row = self._index.documents.filter((F.col("index_name") == index_name) & (F.col("doc_id") == doc_id))
        wanted = self.spark.createDataFrame([("0", index_name, doc_id, terms)], f"query_id string, index_name string, doc_id {self.id_type}, terms array<string>")
        first = row.select("analyzer").first()
        if first is None:
            return []
        found = H.highlight(row, wanted, self._past[first[0]], self.position_encoding).orderBy("nth").collect()
        return [(r["start"], r["end"]) for r in found]

    def get_matches(self, index_name: str, doc_id: object, query: str) -> list[tuple[int, int]]:
        return self.get_matches_for_terms(index_name, doc_id, [t.term for t in self.analyzer.tokens(query, derive=False)])

    def get_matches_for_matched_terms(self, index_name: str, doc_id: object, matched: list) -> list[tuple[int, int]]:
        return self.get_matches_for_terms(index_name, doc_id, [m["term"] for m in matched])

    # snapshots

    def get_snapshot_data(self, index_name: str) -> Index | None:
        """The tables of one index; None if it was never written to."""
        if index_name not in self._known:
            return None
        here = F.col("index_name") == index_name
        return Index(self._index.documents.filter(here), self._index.postings.filter(here), self._index.cleared)

    def save_snapshot(self, index_name: str, path: str) -> bool:
        one = self.get_snapshot_data(index_name)
        if one is None:
            return False
        Snap.write_snapshot(one, path, index_name)
        return True

    def load_snapshot(self, index_name: str, source: Index | str) -> None:
        """Replace an index by a snapshot (its tables or their folder); it then counts as unchanged."""
        one = Snap.read_snapshot(self.spark, source) if isinstance(source, str) else source
        docs, postings = (df.withColumn("index_name", F.lit(index_name)) for df in (one.documents, one.postings))
        other = F.col("index_name") != index_name
        if "analyzer" not in docs.columns:
            docs = docs.withColumn("analyzer", F.lit(len(self._past) - 1))
        rest = self._index.clear(index_name)
        self._index = Index(rest.documents.unionByName(docs, allowMissingColumns=True), rest.postings.unionByName(postings), rest.cleared)
        self._changes = self._changes.filter(other)
        self._known.add(index_name)

    @staticmethod
    def snapshot_version() -> int:
        return Snap.snapshot_version()

