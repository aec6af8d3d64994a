"""Training of segmentation dictionaries from texts, and their export."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import DictionaryConfig, ScriptDictionary

LANGUAGES = {"japanese": ("hiragana", "katakana"), "hangul": ("hangul",)}
_CODES = {"japanese": "ja", "hangul": "ko"}


@dataclass
class TrainingConfig:
    """Shortest 1 at least, longest no less than shortest; max_entries 0: all."""

    min_freq: int = 2
    min_len: int = 2
    max_len: int = 8
    max_entries: int = 8000
    version: str | None = None


def lexicon_counts(texts: DataFrame, config: TrainingConfig | None = None) -> DataFrame:
    """(language, entry, freq, rank): frequent substrings of the runs of each language."""
    config = config or TrainingConfig()
    low = max(1, config.min_len)
    high = max(low, config.max_len)
    run = texts.select(F.explode(T.script_runs(F.col("text"))).alias("run")).withColumn("script", T.script_of(F.col("run")))
    language = F.when(F.col("script").isin(*LANGUAGES["japanese"]), "japanese").when(F.col("script") == "hangul", "hangul")
    cut = run.withColumn("language", language).filter(f"language is not null and length(run) >= {low}")
    starts = cut.select("language", "run", F.explode(F.expr(f"sequence(1, length(run) - {low - 1})")).alias("at"))
    parts = starts.select("language", F.explode(F.expr(f"transform(sequence({low}, least({high}, length(run) - at + 1)), n -> substring(run, at, n))")).alias("entry"))
    counted = parts.groupBy("language", "entry").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= config.min_freq)
    w = Window.partitionBy("language").orderBy(F.desc("freq"), F.desc(F.octet_length("entry")), "entry")
    ranked = counted.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= config.max_entries) if config.max_entries else ranked


def train_dictionary_config(texts: DataFrame, config: TrainingConfig | None = None) -> DictionaryConfig:
    """Lexicons of both languages; a language without entries has none.  Bounded by max_entries."""
    config = config or TrainingConfig()
    rows = lexicon_counts(texts, config).groupBy("language").agg(F.collect_set("entry").alias("entries")).collect()
    now = int(time.time())
    made = {r["language"]: ScriptDictionary(set(r["entries"]), config.version or f"{_CODES[r['language']]}-{now}") for r in rows}
    return DictionaryConfig(made.get("japanese"), made.get("hangul"))


def lexicon_table(spark: SparkSession, config: DictionaryConfig) -> DataFrame:
    """(language, version, entry)."""
    rows = [(lang, d.version or f"{_CODES[lang]}-unversioned", e) for lang, d in (("japanese", config.japanese), ("hangul", config.hangul)) if d for e in sorted(d.entries)]
    return spark.createDataFrame(rows, "language string, version string, entry string")


def export(spark: SparkSession, config: DictionaryConfig) -> DataFrame:
    """(language, version, entry_count, generated_at, entries): one row for each language that has entries."""
    return lexicon_table(spark, config).groupBy("language", "version").agg(F.count(F.lit(1)).cast("int").alias("entry_count"), F.current_timestamp().alias("generated_at"), F.sort_array(F.collect_list("entry")).alias("entries"))


def load(table: DataFrame) -> DictionaryConfig:
    """The lexicons of a (language, version, entry) table."""
    rows = {r["language"]: r for r in table.groupBy("language").agg(F.max("version").alias("version"), F.collect_set("entry").alias("entries")).collect()}
    made = {k: ScriptDictionary(set(r["entries"]), r["version"]) for k, r in rows.items()}
    return DictionaryConfig(made.get("japanese"), made.get("hangul"))
