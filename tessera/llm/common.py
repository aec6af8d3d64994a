"""What the operators share: reading, cutting lineage, column names, row keys, and size-checked broadcasts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import reachable, shared_folder

#: A side of a join is broadcast only if it has been counted and holds at most so many rows.
BROADCAST_ROWS = 1_000_000
#: Keys alone are broadcast in up to so many such parts.
BROADCASTS = 8
#: Texts are broadcast only if they come to so many bytes at most.
BROADCAST_BYTES = 16 << 20

#: Texts differ in length a thousandfold: batches to Python are bounded by bytes, not only by rows.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; from here on the session's batches to Python hold BATCH_BYTES at most."""
    if _bytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(size: str) -> int:
    """Bytes of a size as Spark writes it; a negative one is no bound."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)i?b?", size.strip().lower()).groups()
    n = int(number) << 10 * " kmgt".index(unit or " ")
    return n if n > 0 else 1 << 62


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names."""
    return shared_folder(spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written to the shared one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df``, whose rows are of fixed width, if it holds few; beyond the limit Spark's own choice holds.

    ``df`` should be cheap to count (checkpointed): the count is the size check.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def _slices(keys: DataFrame, name: str, limit: int) -> list[DataFrame] | None:
    """``keys`` in broadcasts of about ``limit`` rows, or None if they are more than ``BROADCASTS`` such."""
    parts = max(1, -(-keys.count() // limit))
    if parts > BROADCASTS:
        return None
    part = F.pmod(F.xxhash64(quoted(name)), F.lit(parts))
    return [F.broadcast(keys if parts == 1 else keys.filter(part == k)) for k in range(parts)]


def within(df: DataFrame, keys: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose column ``name`` is among ``keys`` (that column, distinct, cheap to count), so that wide rows aren't exchanged."""
    slices = _slices(keys, name, limit)
    if slices is None or len(slices) == 1:
        return df.join(slices[0] if slices else keys, name, "left_semi")
    marks = fresh(df, *[f"in{k}" for k in range(len(slices))])
    for part, mark in zip(slices, marks):
        df = df.join(part.withColumn(mark, F.lit(True)), name, "left")
    return df.filter(F.coalesce(*marks)).drop(*marks)


def without(df: DataFrame, keys: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose column ``name`` isn't among ``keys``, likewise."""
    for part in _slices(keys, name, limit) or [keys]:
        df = df.join(part, name, "left_anti")
    return df


def small_texts(df: DataFrame, column: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` if its texts in ``column`` and its rows come to few bytes."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(column) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def quoted(name: str) -> Column:
    """A column by its exact name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each led by as many underscores as no column of ``df`` has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    lead = "__"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def type_of(df: DataFrame, name: str) -> str:
    """A column's type as it's written in a schema."""
    return df.schema[name].dataType.simpleString()


def row_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of (id, text): never null, so rows with null ids or texts join too; repeated rows have the same."""
    return F.xxhash64(F.col(id_col), F.col(text))


def bounded_texts(docs: DataFrame, chosen: DataFrame, order: list[str], rows: int, most_bytes: int) -> DataFrame:
    """``chosen`` (doc_id, lang, h, size, ...) with the documents' texts, in ``order`` as far as rows and bytes allow.

    h: the text's hash.  A document is there once, however often its row is repeated; both bounds hold
    for what a driver collects of it."""
    first = chosen.orderBy(*order, "doc_id").limit(rows)
    so_far = F.sum(F.coalesce("size", F.lit(0))).over(Window.orderBy(*order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # of at most ``rows`` rows
    picked = cut(first.withColumn("so_far", so_far).filter(F.col("so_far") <= most_bytes).drop("so_far", "size"))
    texts = docs.select(F.col("doc_id").alias("own_id"), F.col("lang").alias("own_lang"), "text")
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_lang").eqNullSafe(F.col("lang")) & (F.xxhash64("text") == F.col("h"))
    return texts.join(small_side(picked), same).drop("own_id", "own_lang").dropDuplicates(["doc_id", "lang"])
