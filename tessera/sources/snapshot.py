"""Snapshots of an index as Parquet (zstd) or JSON, and the files an index is built from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.index import Index, doc_lengths
from ..schema import SNAPSHOT_VERSION


def write_snapshot(index: Index, path: str, index_name: str, lexicon_version: str | None = None) -> None:
    """documents, postings, stats and a one-row meta table.

    Postings are sorted by domain and term within files or runs of files, as in ``Index.store``; they aren't
    exchanged.  Snapshots with a folder for each domain can be read too."""
    docs = index.documents.filter(F.col("index_name") == index_name)
    postings = index.postings.filter(F.col("index_name") == index_name)
    one = Index(docs, postings)

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")

    put(docs, "documents")
    put(postings.sortWithinPartitions(*by) if (by := index.order()) else postings, "postings")
    put(one.stats(), "stats")
    put(docs.sparkSession.createDataFrame([(SNAPSHOT_VERSION, index_name, lexicon_version)], "version int, index_name string, lexicon_version string").coalesce(1), "meta")


def read_snapshot(spark: SparkSession, path: str, index_name: str | None = None) -> Index:
    """The index of a snapshot, under another name if one is given; another version is an error."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != SNAPSHOT_VERSION:
        raise ValueError(f"snapshot version {meta['version']}, expected {SNAPSHOT_VERSION}")
    docs, postings = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/postings")
    if index_name is not None:
        docs, postings = (df.withColumn("index_name", F.lit(index_name)) for df in (docs, postings))
    return Index(docs, postings.select("index_name", "domain", "term", "doc_id", "tf", "dl"))


def write_json(index: Index, path: str, index_name: str, version: str | None = None) -> None:
    """The same tables as lines of JSON."""
    here = F.col("index_name") == index_name
    docs, postings = index.documents.filter(here), index.postings.filter(here)
    docs.write.mode("overwrite").json(f"{path}/documents")
    postings.write.mode("overwrite").json(f"{path}/postings")
    schemas = [(SNAPSHOT_VERSION, index_name, version, docs.schema.json(), postings.schema.json())]
    docs.sparkSession.createDataFrame(schemas, "version int, index_name string, lexicon_version string, documents string, postings string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_json(spark: SparkSession, path: str) -> Index:
    """The index of ``write_json``; lengths that its postings lack are counted again."""
    meta = spark.read.json(f"{path}/meta").first()
    if meta["version"] != SNAPSHOT_VERSION:
        raise ValueError(f"snapshot version {meta['version']}, expected {SNAPSHOT_VERSION}")
    docs, postings = (spark.read.schema(StructType.fromJson(json.loads(meta[name]))).json(f"{path}/{name}") for name in ("documents", "postings"))
    if "dl" not in postings.columns:
        postings = postings.withColumn("dl", F.lit(None).cast("long"))
    lengths = doc_lengths(docs if "doc_len" in docs.columns else docs.withColumn("doc_len", F.lit(0)), postings)
    postings = postings.drop("dl").join(lengths.withColumnRenamed("len", "dl"), ["index_name", "doc_id", "domain"], "left")
    return Index(docs, postings.select("index_name", "domain", "term", "doc_id", "tf", F.coalesce("dl", "tf").alias("dl")))


def snapshot_version() -> int:
    return SNAPSHOT_VERSION


def corpus(df: DataFrame, index_name: str, id_col: str, text_col: str, indexed_col: str | None = None) -> DataFrame:
    """Any table as documents (index_name, doc_id, content, indexed); ``indexed_col``: null or false where staged only."""
    indexed = F.lit(True) if indexed_col is None else F.coalesce(F.col(indexed_col), F.lit(False))
    return df.select(F.lit(index_name).alias("index_name"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("content"), indexed.alias("indexed"))
