"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

A document's length is its number of tokens (an existing vocabulary's pieces; white space
between words costs nothing).  Documents longer than ``capacity`` are cut in full chunks and a
rest.  The plan is made from the counts by length alone, the longest first: items of a length go
into the fullest bins that still hold them, all bins alike in one step, and new bins are opened
for what is left.  It has at most a few entries a length, whatever the corpus holds.  Documents
then take the planned slots: the chunk of rank r among those of its length has the slot r of
that length, found by a join on length and range of ranks.  Ranks follow a
hash of the row; they come from counts by (length, bucket), a bucket being a range of hashes, so no
partition holds a whole length and the ranks don't depend on the number of buckets.

Defined results
* null, empty or blank text: no tokens, no slot.
* ties: equal lengths are ranked by a hash of doc_id, text and chunk; repeated rows get a slot each.
* very long text: ``ceil(n / capacity)`` chunks, each in exactly one bin.
* empty table: empty result.  Ids may be of any type.  Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_side, table, type_of
from .pieces import VOCABULARY, token_counts

CAPACITY = 2048
#: Rows that a window over one (length, bucket) is meant to hold at most.
BUCKET_ROWS = 200_000
_ENTRY = "n_tokens int, rank_from long, rank_to long, bin_from long, per_bin long, first_start int"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: entries (length, rank_from, rank_to, bin_from, per_bin, first_start).

    Ranks rank_from..rank_to-1 of the length go to bins from bin_from on, per_bin to each, the
    first of a bin at token first_start."""
    spaces: list[int] = []  # the spaces that any bins have left, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # space left -> [(first bin, bins)]
    entries: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in open_:
                open_[space] = []
                insort(spaces, space)
            open_[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
            else:
                space = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            each = space // length
            full = min(n, left // each)
            if full:
                entries.append((length, rank, rank + full * each, first, each, capacity - space))
                put(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                entries.append((length, rank, rank + left, first + full, left, capacity - space))
                put(space - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(space, first + full, n - full)
    return entries


def _lengths(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.array(token_counts(batch.column("text"), vocabulary))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("spread"), counts], names=["doc_id", "spread", "n"])


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, chunk, n_tokens, bin, start): where each chunk of each document goes."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("spread"), "text")
    lengths = texts.mapInArrow(lambda batches: _lengths(batches, vocabulary), f"doc_id {type_of(docs, 'doc_id')}, spread long, n long").filter("n > 0")
    chunks = cut(
        lengths.select("doc_id", "spread", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity})")).alias("chunk")).select(
            "doc_id", F.xxhash64("spread", "chunk").alias("spread"), "chunk", F.least(F.lit(capacity), F.col("n") - F.col("chunk") * capacity).cast("int").alias("n_tokens")
        )
    )
    histogram = {r["n_tokens"]: r["count"] for r in chunks.groupBy("n_tokens").count().collect()}  # at most capacity rows
    bits = max(0, -(-max(histogram.values(), default=1) // BUCKET_ROWS) - 1).bit_length()
    chunks = chunks.withColumn("bucket", F.shiftright("spread", 64 - bits) if bits else F.lit(0).cast("long"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.groupBy("n_tokens", "bucket").count().select("n_tokens", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("n_tokens", "bucket").orderBy("spread", "doc_id", "chunk")
    ranked = (
        chunks.withColumn("own", F.row_number().over(own))
        .join(small_side(sizes, len(histogram) << bits, 100_000), ["n_tokens", "bucket"])
        .withColumn("rank", F.col("earlier") + F.col("own") - 1)
    )
    entries = plan(histogram, capacity)
    slots = spark.createDataFrame(entries, _ENTRY).withColumnRenamed("n_tokens", "slot_tokens")
    taken = ranked.join(
        small_side(slots, len(entries), 100_000),
        (F.col("n_tokens") == F.col("slot_tokens")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    )
    within = F.col("rank") - F.col("rank_from")
    return taken.select(
        "doc_id",
        F.col("chunk").cast("int").alias("chunk"),
        "n_tokens",
        (F.col("bin_from") + F.expr("(rank - rank_from) div per_bin")).alias("bin"),
        (F.col("first_start") + F.pmod(within, F.col("per_bin")) * F.col("n_tokens")).cast("int").alias("start"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
