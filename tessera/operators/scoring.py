"""BM25 and minimum-should-match as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import B, K1, MIN_SHOULD_MATCH


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(tf: Column, dl: Column, avgdl: Column, idf_: Column) -> Column:
    """Component of one term; 0 unless both tf and idf are positive."""
    ratio = F.when(avgdl > 0, dl / avgdl).otherwise(0.0)
    return F.when((tf > 0) & (idf_ > 0), idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))).otherwise(0.0)


def min_should_match(query_terms: Column, available: Column, ratio: float = MIN_SHOULD_MATCH) -> Column:
    wanted = F.least(F.greatest(F.ceil(query_terms * F.lit(ratio)), F.lit(1)), available)
    return F.when(available > 0, wanted).otherwise(0)
