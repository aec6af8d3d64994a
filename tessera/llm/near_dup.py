"""N-gram Jaccard join: documents whose word n-gram sets have Jaccard >= threshold.

1. Every text becomes its set of word n-gram hashes (48 bits), a parity bitmap of ``bits_for(threshold)``
   times as many bits, or up to twice that, and ``bands_for(threshold)`` keys, each of ``ROWS_PER_BAND`` minimum hashes.  Equal sets are
   one class and go on as one row with the number of its members.
2. Classes that share a key are compared by size and bitmap: the bits that differ are at most the
   n-grams that differ, so overlap <= (|x| + |y| - differing bits) / 2.  Classes that the bound allows
   are linked; only a spanning forest of the links is passed on.  Its connected components are the
   groups in which all links are looked for.
3. A small group is one tile.  A larger one is parted in size bands, each size being ``1 / threshold``
   times the last, and bands in chunks of ``TILE_ROWS`` rows and ``TILE_GRAMS`` n-grams; a tile is a pair
   of chunks of the same or of neighbouring bands, as others can't reach the threshold.  Within a
   tile sizes and bitmaps bound the overlap from above, and what they leave is counted exactly,
   by intersection of sorted arrays.  A tile gives the number of links of each class and a spanning
   forest, never the pairs.

The bounds and counts are exact; only which classes come in one group is a matter of chance.  A pair
at the threshold (0.7) shares a key with probability 1 - (1 - 0.7**3)**20 = 0.9998, one at 0.8 with
1 - 1e-6, and pairs that meet over a third class are found without; lower thresholds get more keys,
for the same probability at the threshold.  Sharing only a passage makes no group.

Defined results
* null text, or fewer than ``N`` words: no n-grams, no links (exact copies of those are for exact
  deduplication); in ``one_of_each`` they stay.
* repeated rows (same id and text) are one document; rows with the same id and another text are
  documents of their own.  Null ids are ids like others.  In ``one_of_each`` of equal rows one stays.
* ties: the smallest id, null last, names a class and stays in ``one_of_each``; then the smallest key.
* very long text: one set like any other.  Empty table: empty result.  Ids may be of any type.
* Extra columns are carried through ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, cut, fresh, row_key, small_side, table, within, without
from .components import components
from .textops import WORD, gram_hashes, mix, row_slices, scan_words, string_parts

N = 2
THRESHOLD = 0.7
BANDS, ROWS_PER_BAND = 20, 3
#: For near copies that the pipeline drops: in the empty range between edited copies and other pairs.
COPY_THRESHOLD = 0.55
#: Classes and n-grams of one chunk of a tile; larger groups and blocks are parted.
TILE_ROWS, TILE_GRAMS = 512, 2_000_000
#: n-grams (both arrays of a pair) that are intersected at once.
_CHUNK = 2_000_000
_LEAST_BITS, _MOST_BITS = 64, 1 << 16
#: Least bits at lower thresholds, where many short texts of few words come close: there the bound is nearly exact.
_SMALL_BITS = 512
_PAIRS_AT_ONCE = 1 << 20


def bands_for(threshold: float) -> int:
    """Keys with which a pair at ``threshold`` meets as surely as one at ``THRESHOLD`` with ``BANDS``."""
    return max(BANDS, math.ceil(BANDS * math.log1p(-(THRESHOLD**ROWS_PER_BAND)) / math.log1p(-(threshold**ROWS_PER_BAND)) - 1e-9))


def _seeds(bands: int) -> np.ndarray:
    return mix(np.arange(1, bands * ROWS_PER_BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each row, row offsets)."""
    words = scan_words(raw, offsets)
    grams, inside = gram_hashes(words, n)
    rows = len(offsets) - 1
    row_of = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(words.offsets))[: len(grams)][inside]
    keyed = (row_of << np.uint64(48)) | (grams[inside] >> np.uint64(16))
    keyed.sort()
    keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])] if len(keyed) else keyed
    counts = np.bincount((keyed >> np.uint64(48)).astype(np.int64), minlength=rows)
    return keyed & np.uint64((1 << 48) - 1), np.concatenate([[0], np.cumsum(counts)])


def bits_for(threshold: float) -> int:
    """Bits for an n-gram, a power of two, with which the bound tells sets without a common n-gram from a pair at ``threshold``.

    Of two sets of n in n * bits places each the parities differ in n * bits * (1 - exp(-4 / bits)) / 2 places."""
    bits = 1
    while 1 - bits * (1 - math.exp(-4 / bits)) / 4 > 0.93 * 2 * threshold / (1 + threshold):
        bits *= 2
    return bits


def _width(size: int, bits: int = 1) -> int:
    least = _LEAST_BITS if bits == 1 else _SMALL_BITS
    return min(_MOST_BITS, max(least, bits << int(size).bit_length()))


def bitmap(grams: np.ndarray, bits: int = 1) -> np.ndarray:
    """Parity of the n-grams that fall on each bit, as 64-bit words.  Folding halves by xor gives the smaller bitmap."""
    width = _width(len(grams), bits)
    bits = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _signatures(batches: Iterator[pa.RecordBatch], n: int, keys_each: int = BANDS, bits_each: int = 1) -> Iterator[pa.RecordBatch]:
    seeds = _seeds(keys_each)
    for batch in batches:
        raw, offsets = string_parts(batch.column("text"))
        keys = batch.column("key")
        for a, b in row_slices(offsets):
            grams, own = gram_sets(raw, offsets[a : b + 1], n)
            sizes = np.diff(own)
            rows = np.flatnonzero(sizes)
            if not len(rows):
                continue
            first = own[rows]
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(mix(grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), first)
                bands = np.zeros((len(rows), keys_each), np.uint64)
                for i, seed in enumerate(seeds):
                    h = grams ^ (seed >> np.uint64(16))
                    h *= seed | np.uint64(1)
                    h ^= h >> np.uint64(31)
                    h *= np.uint64(0xBF58476D1CE4E5B9)
                    least = np.minimum.reduceat(h, first)
                    band = i // ROWS_PER_BAND
                    bands[:, band] = mix(bands[:, band] * np.uint64(31) + least + np.uint64(band + 1))
            maps = [bitmap(grams[own[r] : own[r + 1]], bits_each).tobytes() for r in rows]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys_each), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows + a)), pa.array(sums.view(np.int64)), pa.array(sizes[rows].astype(np.int32)), pa.array(maps, pa.binary()), lists],
                names=["key", "set_hash", "size", "bits", "bands"],
            )


def _compatible(sizes: np.ndarray, maps: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of one block, sorted by size, that size and bitmap allow."""
    left, right = [], []
    widths = np.array([len(m) for m in maps])
    for width in np.unique(widths):
        low = np.flatnonzero(widths == width)
        near = np.flatnonzero((widths == width) | (widths == 2 * width))
        folded = np.stack([maps[k] if len(maps[k]) == width else maps[k][:width] ^ maps[k][width:] for k in near])
        position = np.searchsorted(near, low)
        step = max(1, _PAIRS_AT_ONCE // (len(near) * int(width)))
        for at in range(0, len(low), step):
            mine = low[at : at + step]
            to = int(np.searchsorted(sizes[near], sizes[mine[-1]] / threshold + 1e-9, side="right"))
            start = int(position[at])
            differ = np.bitwise_count(folded[position[at : at + step]][:, None, :] ^ folded[None, start:to, :]).sum(axis=2, dtype=np.int32)
            total = sizes[mine][:, None] + sizes[near[start:to]][None, :]
            overlap = (total - differ) // 2
            overlap = np.minimum(overlap, sizes[mine][:, None])
            ok = (overlap >= threshold * (total - overlap) - 1e-9) & (near[start:to][None, :] > mine[:, None])
            i, j = np.nonzero(ok)
            left.append(mine[i])
            right.append(near[start:to][j])
    return np.concatenate(left), np.concatenate(right)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each member's component, for links i-j among n."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    while (root != root[root]).any():
        root = root[root]
    return root


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``by``; the partition is sorted by it, and every run is bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(by).to_numpy()
        if held and held[-1].column(by)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        before = np.flatnonzero(key != key[-1])
        whole = int(before[-1]) + 1 if len(before) else 0
        if whole:
            yield pa.Table.from_batches([*held, batch.slice(0, whole)])
            held = []
        held.append(batch.slice(whole))
    if held:
        yield pa.Table.from_batches(held)


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(u, v): a spanning forest of the links that size and bitmap allow within each block."""
    for t in _runs(batches, "block"):
        t = t.combine_chunks()
        block, cls, size, side = (t[c].to_numpy() for c in ("block", "cls", "size", "side"))
        bits = t["bits"].combine_chunks()
        edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
        u, v = [], []
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s < 2:
                continue
            order = s + np.argsort(size[s:e], kind="stable")
            maps = [np.frombuffer(bits[int(k)].as_buffer(), np.uint64) for k in order]
            i, j = _compatible(size[order].astype(np.int64), maps, threshold)
            if e - s > 2:
                across = (side[order[i]] == 0) | (side[order[i]] != side[order[j]])
                root = _roots(e - s, i[across], j[across])
                i = np.flatnonzero(root != np.arange(e - s))
                j = root[i]
            u.append(cls[order[i]])
            v.append(cls[order[j]])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v)], names=["u", "v"])


def _arrays(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The sorted n-grams of each class, once for every tile that it belongs to."""
    for batch in batches:
        raw, offsets = string_parts(batch.column("text"))
        places = batch.column("places")
        per_row = np.diff(places.offsets.to_numpy())
        flat = places.flatten()
        tile, side = flat.field("tile"), flat.field("side")
        at = np.concatenate([[0], np.cumsum(per_row)])
        for a, b in row_slices(offsets):
            grams, own = gram_sets(raw, offsets[a : b + 1], n)
            rows = np.repeat(np.arange(b - a), per_row[a:b])
            lists = pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(grams.view(np.int64)))
            step = max(1, int((4 << 20) // max(1, np.diff(own).max())))
            for s in range(0, len(rows), step):
                part = pa.array(rows[s : s + step])
                put = slice(int(at[a]) + s, int(at[a]) + min(s + step, len(rows)))
                yield pa.RecordBatch.from_arrays(
                    [tile[put], side[put], *[batch.column(c).slice(a, b - a).take(part) for c in ("cls", "members", "whole")], lists.take(part)],
                    names=["tile", "side", "cls", "members", "whole", "grams"],
                )


def _jaccard(starts: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact Jaccard of the sets a[k] and b[k], by intersection of sorted arrays."""
    size_a, size_b = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
    load = np.cumsum(size_a + size_b)
    jaccard = np.zeros(len(a))

    def spread(which: np.ndarray, size: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + starts[which][row]
        return (row.astype(np.uint64) << np.uint64(48)) | values[at]

    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + _CHUNK, side="right")))
        for s in range(at, to, 60_000):
            e = min(to, s + 60_000)
            both = np.concatenate([spread(a[s:e], size_a[s:e]), spread(b[s:e], size_b[s:e])])
            both.sort()
            shared = both[1:][both[1:] == both[:-1]] >> np.uint64(48)
            overlap = np.bincount(shared.astype(np.int64), minlength=e - s)
            jaccard[s:e] = overlap / (size_a[s:e] + size_b[s:e] - overlap)
        at = to
    return jaccard


def _tile(side: np.ndarray, starts: np.ndarray, values: np.ndarray, weight: np.ndarray, threshold: float, count: bool) -> tuple[np.ndarray, np.ndarray]:
    """(linked members of the other classes, least linked member) of each class of a tile.

    Without ``count`` pairs that are known to be connected aren't looked at, and only the forest holds."""
    n = len(side)
    sizes = np.diff(starts)
    order = np.argsort(sizes, kind="stable")
    bits = bits_for(threshold)
    i, j = _compatible(sizes[order], [bitmap(values[starts[k] : starts[k + 1]], bits) for k in order], threshold)
    i, j = order[i], order[j]
    across = (side[i] == 0) | (side[i] != side[j])
    i, j = i[across], j[across]
    links, root = np.zeros(n, np.int64), np.arange(n)
    if count:
        ok = _jaccard(starts, values, i, j) >= threshold - 1e-12
        i, j = i[ok], j[ok]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        return links, _roots(n, i, j)
    li, lj = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(i):
        first = np.unique(np.maximum(root[i], root[j]) * n + np.minimum(root[i], root[j]), return_index=True)[1]
        a, b = i[first], j[first]
        ok = _jaccard(starts, values, a, b) >= threshold - 1e-12
        li, lj = np.concatenate([li, a[ok]]), np.concatenate([lj, b[ok]])
        root = _roots(n, li, lj)
        left = np.ones(len(i), bool)
        left[first] = False
        left &= root[i] != root[j]
        i, j = i[left], j[left]
    return links, root


def _tiles(batches: Iterator[pa.RecordBatch], threshold: float, count: bool) -> Iterator[pa.RecordBatch]:
    """(cls, links, root, whole) of the classes of each tile."""
    for t in _runs(batches, "tile"):
        t = t.combine_chunks()
        tile, side, cls, members, whole = (t[c].to_numpy() for c in ("tile", "side", "cls", "members", "whole"))
        lists = t["grams"].combine_chunks()
        starts, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        edges = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]])
        links, root = np.zeros(len(tile), np.int64), np.arange(len(tile))
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s > 1:
                links[s:e], own = _tile(side[s:e], starts[s : e + 1], values, members[s:e], threshold, count)
                root[s:e] = s + own
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(links), pa.array(cls[root]), pa.array(whole)], names=["cls", "links", "root", "whole"])


def _signed(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    keys_each, bits_each = bands_for(threshold), bits_for(threshold)
    texts = docs.select("key", F.lower("text").alias("text")).filter("text is not null")
    return texts.mapInArrow(lambda batches: _signatures(batches, n, keys_each, bits_each), "key long, set_hash long, size int, bits binary, bands array<long>")


def _parts(rows: str, grams: str | None = None) -> Column:
    """Into how many chunks a set of ``rows`` rows and ``grams`` n-grams goes."""
    by_rows = F.ceil(F.col(rows) / TILE_ROWS)
    return F.greatest(F.lit(1), by_rows if grams is None else F.greatest(by_rows, F.ceil(F.col(grams) / TILE_GRAMS))).cast("int")


def _chunk_pairs(parts: Column) -> Column:
    """Of chunk ``c`` of ``parts``: (other chunk, own side) of its pairs with all chunks; side 0: the chunk alone."""
    other = F.sequence(F.lit(0), parts - 1)
    return F.transform(other, lambda o: F.struct(F.least(F.col("c"), o).alias("low"), F.greatest(F.col("c"), o).alias("high"), F.when(F.col("c") == o, 0).when(F.col("c") < o, 1).otherwise(2).alias("side")))


def _groups(classes: DataFrame, threshold: float) -> DataFrame:
    """(node, component): the groups of two classes or more in which all links lie.

    All keys are exchanged once, alone; bitmaps join only those that are shared."""
    keyed = classes.select("cls", F.explode("bands").alias("band_key"))
    counted = keyed.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("band_key"))).filter("rows > 1")
    met = counted.select("cls", "band_key", _parts("rows").alias("parts")).join(classes.select("cls", "size", "bits"), "cls")
    met = met.withColumn("c", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).select("cls", "size", "bits", "band_key", F.explode(_chunk_pairs(F.col("parts"))).alias("p"))
    blocks = met.select(F.xxhash64("band_key", "p.low", "p.high").alias("block"), F.col("p.side").alias("side"), "cls", "size", "bits")
    blocks = blocks.repartition("block").sortWithinPartitions("block")
    return components(blocks.mapInArrow(lambda batches: _linked(batches, threshold), "u long, v long"))


def _places(grouped: DataFrame, threshold: float) -> DataFrame:
    """(cls, places, whole): the tiles that each class belongs to; whole: its group is one tile."""
    band = F.floor(F.log(F.col("size").cast("double")) / -math.log(threshold) + 1e-9).cast("int")
    sums = (F.count(F.lit(1)).alias("rows"), F.sum("size").alias("grams"))
    groups = grouped.groupBy("component").agg(*sums).select("component", _parts("rows", "grams").alias("parts"))
    large = cut(groups.filter("parts > 1").select("component"))
    one_tile = grouped.join(small_side(large), "component", "left_anti")
    small = one_tile.select("cls", F.array(F.struct(F.xxhash64("component").alias("tile"), F.lit(0).alias("side"))).alias("places"), F.lit(True).alias("whole"))
    rest = grouped.join(small_side(large), "component", "left_semi").withColumn("band", band)
    bands = cut(rest.groupBy("component", "band").agg(*sums).select("component", "band", _parts("rows", "grams").alias("parts")))

    def beside(step: int) -> DataFrame:
        return bands.select("component", (F.col("band") - step).alias("band"), F.col("parts").alias(f"parts{step}"))

    placed = rest.join(small_side(bands), ["component", "band"]).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    for step in (-1, 1):
        placed = placed.join(small_side(beside(step)), ["component", "band"], "left")
    own = F.transform(_chunk_pairs(F.col("parts")), lambda p: F.struct(F.xxhash64("component", "band", p["low"], "band", p["high"]).alias("tile"), p["side"].alias("side")))

    def across(step: int) -> Column:
        other = F.when(F.col(f"parts{step}").isNotNull(), F.sequence(F.lit(0), F.col(f"parts{step}") - 1)).otherwise(F.array().cast("array<int>"))
        low, high = (F.col("band") - 1, F.col("band")) if step < 0 else (F.col("band"), F.col("band") + 1)
        return F.transform(other, lambda o: F.struct(F.xxhash64(F.col("component"), low, *((o, high, F.col("c")) if step < 0 else (F.col("c"), high, o))).alias("tile"), F.lit(2 if step < 0 else 1).alias("side")))

    return small.unionByName(placed.select("cls", F.concat(own, across(-1), across(1)).alias("places"), F.lit(False).alias("whole")))


class Linked(NamedTuple):
    rows: DataFrame  # (key, cls) of every row with n-grams
    classes: DataFrame  # (cls, links, component) of the classes that may have links
    repeats: bool  # whether some key occurs more than once


def linked_classes(rows: DataFrame, n: int = N, threshold: float = THRESHOLD, count: bool = True) -> Linked:
    """Links between the classes of ``rows`` (key, text); ``links`` counts the members of the linked
    classes, a key that occurs several times once (only with ``count``)."""
    signed = cut(_signed(rows, n, threshold).withColumn("cls", F.xxhash64("set_hash", "size")).drop("set_hash"))
    members = cut(signed.select("key", "cls").distinct())
    repeats = signed.count() > members.count()
    first = members.groupBy("cls").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("members"))
    classes = signed.join(first, "cls").filter("key = first").drop("first")
    classes = cut(classes.dropDuplicates(["cls"]) if repeats else classes)
    grouped = cut(_groups(classes, threshold).select(F.col("node").alias("cls"), "component").join(classes.select("cls", "size", "key", "members"), "cls"))
    wanted = cut(_places(grouped, threshold).join(grouped.select("cls", "key", "members"), "cls"))
    n_places = wanted.agg(F.coalesce(F.sum(F.size("places") + 2), F.lit(0))).first()[0]  # the size of what would be broadcast
    texts = within(rows, wanted.select("key"), "key").join(small_side(wanted, n_places), "key").select("cls", "members", "whole", "places", F.lower("text").alias("text"))
    texts = texts.dropDuplicates(["cls"]) if repeats else texts
    arrays = texts.mapInArrow(lambda batches: _arrays(batches, n), "tile long, side int, cls long, members long, whole boolean, grams array<long>")
    tiles = arrays.repartition("tile").sortWithinPartitions("tile")
    found = cut(tiles.mapInArrow(lambda batches: _tiles(batches, threshold, count), "cls long, links long, root long, whole boolean"))
    parted = components(found.filter("not whole").select(F.col("cls").alias("u"), F.col("root").alias("v")))
    rooted = found.groupBy("cls").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    out = rooted.join(parted.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "links", F.coalesce("component", "root").alias("component"))
    return Linked(signed.select("key", "cls"), cut(out), repeats)


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links), one row for every document, a document being a distinct (doc_id, text).

    n_links: how many other documents are at or above the threshold, copies included; class_id: the
    smallest id among the documents connected by such links (the document's own if it has none)."""
    rows = cut(docs.select("doc_id", row_key().alias("key")).distinct())
    linked = linked_classes(docs.select(row_key().alias("key"), "text"), n, threshold)
    members = linked.rows.distinct()
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("members"))
    sized = copies.join(linked.classes, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    crowded = cut(rows.join(members.join(sized.filter("n_links > 0"), "cls"), "key").select("key", "doc_id", "component", "n_links"))
    names = crowded.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    together = crowded.join(names, "component").select("doc_id", "class_id", "n_links")
    alone = rows.join(crowded.select("key"), "key", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return together.unionByName(alone)


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of rows connected by links at or above the threshold."""
    (name,) = fresh(docs, "key")
    rows = docs.select(row_key().alias("key"), "doc_id", "text")
    linked = linked_classes(rows.select("key", "text"), n, threshold, count=False)
    grouped = linked.rows.join(linked.classes, "cls", "left").select("key", F.coalesce("component", "cls").alias("component"))
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("component")
    crowded = cut(grouped.join(sizes, "component", "left_semi").distinct())
    ids = rows.select("key", "doc_id").join(small_side(crowded), "key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    stay = cut(ids.groupBy("component").agg(F.min(order).alias("least")).select(F.col("least.key").alias(name)))
    keyed = docs.withColumn(name, row_key())
    columns = columns_of(docs)
    grouped_keys = crowded.select(F.col("key").alias(name))
    if not linked.repeats:
        return without(keyed, cut(grouped_keys.join(stay, name, "left_anti")), name).select(*columns)
    others = without(keyed, grouped_keys, name).select(*columns)
    firsts = within(keyed, stay, name).dropDuplicates([name])
    return others.unionByName(firsts.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE
     docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
     words AS (SELECT r, regexp_extract_all(lower(text), '{WORD}') AS w FROM docs WHERE text IS NOT NULL),
     grams AS (SELECT DISTINCT r, w[i] || ' ' || w[i + 1] AS gram
               FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) >= 2)),
     sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
     ordered AS (SELECT r, gram, n, row_number() OVER (PARTITION BY r ORDER BY df, gram) AS place
                 FROM grams JOIN sizes USING (r) JOIN (SELECT gram, count(*) AS df FROM grams GROUP BY gram) USING (gram)),
     heads AS (SELECT * FROM ordered WHERE place <= n - ceil({THRESHOLD}e0 * n - 1e-9) + 1),
     met AS (SELECT DISTINCT x.r AS a, y.r AS b, x.n AS n_a, y.n AS n_b
             FROM heads x JOIN heads y ON x.gram = y.gram AND x.r < y.r
             WHERE least(x.n, y.n) >= {THRESHOLD}e0 * greatest(x.n, y.n) - 1e-9),
     shared AS (SELECT a, b, n_a, n_b, count(*) AS n
                FROM met JOIN grams x ON x.r = a JOIN grams y ON y.r = b AND y.gram = x.gram GROUP BY ALL),
     pairs AS (SELECT a, b FROM shared WHERE n / (n_a + n_b - n)::DOUBLE >= {THRESHOLD}e0 - 1e-12),
     links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
     reach AS (SELECT DISTINCT a AS r, a AS s FROM links UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.s = links.a),
     classes AS (SELECT r, min(doc_id) AS class_id FROM (SELECT reach.r, docs.doc_id FROM reach JOIN docs ON docs.r = reach.s) GROUP BY r),
     degrees AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, CASE WHEN n_links IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links
FROM docs LEFT JOIN classes USING (r) LEFT JOIN degrees USING (r)
"""
