"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logs often hold the same conversation again and again, each time a turn longer.  Every turn gets a
rolling digest (128 bits) of itself and all turns before it; a conversation whose last digest is a
digest of a longer conversation, at the same turn, is a prefix of it and goes (an anti-join).  Only
digests are sorted and shuffled for that; the texts of the conversations that are left then go to
their place once and are rendered in a chat template.

Defined results
* order: by turn (null first), then role, then the text's MD5; repeated rows (all four columns) count once.
* null role or text is told apart from an empty one when comparing; both render as empty.
* ``<|`` in a role or text is rendered as ``< |``, so that no text can begin or end a turn.
* null conv_id: such rows belong to no conversation; each different one is a conversation of one turn.
* equal conversations: the smallest conv_id stays (null last).  Ids may be of any type.
* a very long conversation is one row; its digests take time in proportion to its turns.
* Empty table: empty result.  Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_side, table

TURN_START, ROLE_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """(k, conv_id, turn, role, h, text); k: the key of the conversation, h: the text's MD5."""
    turns = conversations.select("conv_id", "turn", "role", F.md5("text").alias("h"), "text")
    alone = F.concat(F.lit("n"), F.md5(F.to_json(F.struct("turn", "role", "h"), {"ignoreNullFields": "false"})))
    return turns.withColumn("k", F.when(F.col("conv_id").isNull(), alone).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string"))))


def _steps(turns: DataFrame) -> DataFrame:
    """(k, conv_id, n, total, d1, d2): for every turn the digest of all turns so far."""
    own = [F.xxhash64(F.lit(seed), F.col("text").isNull(), "text").alias(f"t{seed}") for seed in (1, 2)]
    rows = turns.select("k", "conv_id", "turn", "role", "h", *own).dropDuplicates(["k", "turn", "role", "h"])
    by = Window.partitionBy("k").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "h")])
    placed = rows.select("*", F.row_number().over(by).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("k")).alias("total"))
    rolling = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    digests = [F.bit_xor(F.xxhash64("n", F.col("role").isNull(), "role", f"t{seed}")).over(rolling).alias(f"d{seed}") for seed in (1, 2)]
    return placed.select("k", "conv_id", "n", "total", *digests)


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the conversations that no other one continues or repeats."""
    turns = _turns(conversations)
    steps = cut(_steps(turns))
    digest = ["n", "d1", "d2"]
    first = F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "k")).alias("least")
    once = steps.filter("n = total").groupBy(*digest).agg(first)
    longer = steps.filter("n < total").select(*digest).distinct()
    kept = cut(once.join(longer, digest, "left_anti").select("least.k", "n"))
    listed = turns.join(small_side(kept), "k").groupBy("k").agg(
        F.first("conv_id").alias("conv_id"), F.first("n").alias("n_turns"), F.sort_array(F.collect_set(F.struct("turn", "role", "h", "text"))).alias("turns")
    )
    shown = F.transform("turns", lambda t: F.concat(F.lit(TURN_START), _safe(t["role"]), F.lit(ROLE_END), _safe(t["text"]), F.lit(TURN_END)))
    return listed.select("conv_id", "n_turns", F.array_join(shown, "").alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


_SAFE = "replace(coalesce({0}, ''), '<|', '< |')"
ORACLE_SQL = f"""
WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
     turns AS (SELECT *, CASE WHEN conv_id IS NULL THEN 'n' || row_number() OVER () ELSE 'c' || conv_id END AS k FROM rows),
     steps AS (SELECT conv_id, k, count(*) OVER w AS n_turns,
                      string_agg('<|im_start|>' || {_SAFE.format('role')} || chr(10) || {_SAFE.format('text')} || '<|im_end|>' || chr(10), '') OVER w AS rendered,
                      string_agg(coalesce('=' || length(role) || ':' || role, '-') || coalesce('=' || length(text) || ':' || text, '-'), '') OVER w AS exact
               FROM turns WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST ROWS UNBOUNDED PRECEDING)),
     whole AS (SELECT k, any_value(conv_id) AS conv_id, max(n_turns) AS n_turns, max_by(rendered, n_turns) AS rendered, max_by(exact, n_turns) AS exact FROM steps GROUP BY k),
     parts AS (SELECT DISTINCT exact FROM steps JOIN (SELECT k, n_turns AS total FROM whole) t USING (k) WHERE n_turns < total)
SELECT min(conv_id) AS conv_id, CAST(min(n_turns) AS INTEGER) AS n_turns, min(rendered) AS rendered
FROM whole WHERE exact NOT IN (SELECT exact FROM parts) GROUP BY exact
"""
