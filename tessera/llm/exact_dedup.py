"""Exact deduplication by progressive refinement.

Rows are grouped by byte length, then by a hash of their first bytes, and only the groups
that still have two rows or more have their full content read and hashed (SHA-256).

Defined results
* null text: never a copy of anything, always kept.
* empty text: a text like any other; all empty texts are copies of one another.
* ties and repeated rows: the copy with the smallest doc_id stays (null ids last); of rows
  repeated with the same id and text exactly one stays, whichever if their other columns differ.
* very long text: read and hashed whole.  Empty table: empty result.  Ids may be of any type.
* Extra columns are carried through ``keep_first`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, cut, fresh, small_side, table

PREFIX_CHARS = 256
_LEN = F.octet_length


def _head(prefix_chars: int) -> Column:
    return F.xxhash64(F.substring("text", 1, prefix_chars))


def _surviving_keys(texts: DataFrame, prefix_chars: int) -> DataFrame:
    """(len, head), length and prefix hash, of the groups that hold two rows or more."""
    lengths = texts.select(_LEN("text").alias("len")).groupBy("len").count().filter("count > 1").select("len")
    lengths = small_side(cut(lengths))
    sized = texts.select(_LEN("text").alias("len"), _head(prefix_chars).alias("head")).join(lengths, "len", "left_semi")
    return cut(sized.groupBy("len", "head").count().filter("count > 1").select("len", "head"))


def copies(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row ``(doc_id, duplicate_of)`` for every row that is a copy of an earlier one.

    Repeated rows are counted before anything is shuffled, and the first of a group is joined to its
    members, so no task holds a group."""
    texts = docs.select("doc_id", "text").filter("text is not null")
    keys = small_side(_surviving_keys(texts, prefix_chars))
    sized = texts.select("doc_id", "text", _LEN("text").alias("len"), _head(prefix_chars).alias("head")).join(keys, ["len", "head"], "left_semi")
    ids = cut(sized.groupBy("len", F.sha2("text", 256).alias("full"), "doc_id").agg(F.count(F.lit(1)).alias("times")))
    groups = ids.groupBy("len", "full").agg(F.min("doc_id").alias("duplicate_of"), F.sum("times").alias("members")).filter("members > 1").drop("members")
    more = F.when(F.col("doc_id").eqNullSafe(F.col("duplicate_of")), F.col("times") - 1).otherwise(F.col("times"))
    joined = ids.join(groups, ["len", "full"]).withColumn("more", more).filter("more > 0")
    return joined.select("doc_id", "duplicate_of", F.explode(F.sequence(F.lit(1), F.col("more").cast("int")))).select("doc_id", "duplicate_of")


def keep_first(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with one row of every group of equal texts.

    Only the rows of surviving groups are shuffled, of a group only the first that each task sees;
    all others pass straight through.
    """
    n_len, n_head, n_full, n_rank = fresh(docs, "len", "head", "full", "rank")
    keys = _surviving_keys(docs.select("text").filter("text is not null"), prefix_chars)
    keys = small_side(keys.select(F.col("len").alias(n_len), F.col("head").alias(n_head)))
    keyed = docs.withColumns({n_len: _LEN("text"), n_head: _head(prefix_chars)})
    columns = columns_of(docs)
    alone = keyed.join(keys, [n_len, n_head], "left_anti").select(*columns)
    w = Window.partitionBy(n_len, n_full).orderBy(F.col("doc_id").asc_nulls_last())
    first = (
        keyed.join(keys, [n_len, n_head], "left_semi")
        .withColumn(n_full, F.sha2("text", 256))
        .withColumn(n_rank, F.row_number().over(w))
        .filter(F.col(n_rank) == 1)
        .select(*columns)
    )
    return alone.unionByName(first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, duplicate_of
FROM (SELECT doc_id,
             row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rank_in_group,
             min(doc_id) OVER (PARTITION BY text) AS duplicate_of
      FROM documents WHERE text IS NOT NULL) g
WHERE rank_in_group > 1
"""
