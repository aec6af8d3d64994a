"""Sessions: where Python workers find this package, and a session for local use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did.

    A cluster whose machines don't share that path installs the package instead."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, env.get("PYTHONPATH", "")) if p)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where none is named, a local session gets a temporary one; on a cluster that's an error, as each
    machine would write to its own disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that plans stay short."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *by: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, sorted by ``by`` within files, and read it from there.

    Unlike a checkpoint it's read by column, with filters pushed down, and its size is known to joins."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    rows = df.sortWithinPartitions(*by) if by else df
    rows.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def local_rows(spark: SparkSession, rows: list, schema: str | StructType) -> DataFrame:
    """A few rows as a relation that is part of the plan: reading it takes no job, and joins know its size."""
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds), schema)


def local(threads: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests, benches and notebooks."""
    spark = (
        SparkSession.builder.master(f"local[{threads}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return reachable(spark)
