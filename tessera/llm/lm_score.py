"""Language-model scoring: the marginal probability of a text over all its segmentations.

An existing vocabulary gives the pieces and their order (its scores).  By default a piece's probability
is its count in the whole corpus, smoothed by a prior that falls with the piece's place in the
vocabulary (``vocabulary_scores`` is that prior alone, without the corpus):  p(piece) = (count + weight * prior) / (total + weight), prior ~ 1 / (place + 10).
Counts come from every document: words are counted over the corpus, each distinct word is cut
by the vocabulary's own tokenizer and its pieces counted as often as the word occurs.

A text is its words (runs without white space), each led by the word mark.  A word's marginal
probability sums the product of piece probabilities over *all* segmentations in pieces; it is
computed by forward recursion in log space over the lattice, for a batch's distinct words at
once.  A character that isn't a piece is spelled in byte pieces.  The text's log probability is
the sum over its words.

Defined results
* null text: null scores, no words.  Empty or blank text: no words, log probability 0,
  null bits per byte.
* repeated rows: scored alike, each counted in the statistics.  Ties can't occur.
* very long texts and words: scored whole.  The recursion of many words at once holds ``_LATTICE_CHARS``
  characters at most, padding included; a longer word goes through a window of ``_BLOCK`` characters.
* empty table: empty result.  Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pieces import VOCABULARY, distinct_words, processor, row_sums

PRIOR_WEIGHT = 10_000.0
#: Distinct words counted in one go before they are passed on.
_FLUSH_WORDS = 2_000_000
#: Rows times longest word of the lattices that are held at once; words of _LONG characters and fewer than _FEW rows go one by one.
_LATTICE_CHARS, _LONG, _FEW = 200_000, 256, 16
#: Characters of a long word whose pieces are looked up at once.
_BLOCK = 1 << 15
_MARK = "▁"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.StructArray] = []

    def merged() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([pa.RecordBatch.from_struct_array(x) for x in held]).group_by("word").aggregate([("n", "sum")])
        for b in t.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(max_chunksize=100_000):
            yield b.set_column(0, "word", b.column("word").cast(pa.string()))

    for batch in batches:
        words, at, _ = distinct_words(batch.column("text"))
        n = np.bincount(at, minlength=len(words))
        keep = np.asarray(pc.not_equal(words, ""))
        held.append(pa.StructArray.from_arrays([words.filter(pa.array(keep)), pa.array(n[keep])], names=["word", "n"]))
        if sum(map(len, held)) > _FLUSH_WORDS:
            yield from merged()
            held = []
    if held:
        yield from merged()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in all documents."""
    parts = docs.select("text").filter("text is not null").mapInArrow(_word_counts, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _piece_counts(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    sp = processor(vocabulary)
    total = np.zeros(sp.get_piece_size(), np.int64)
    for batch in batches:
        times = batch.column("n").to_numpy()
        for start in range(0, len(batch), 50_000):
            cut_words = sp.encode(batch.column("word")[start : start + 50_000].to_pylist(), num_threads=1)
            sizes = np.fromiter(map(len, cut_words), np.int64, len(cut_words))
            ids = np.fromiter((i for w in cut_words for i in w), np.int64, int(sizes.sum()))
            total += np.bincount(ids, np.repeat(times[start : start + 50_000], sizes), minlength=len(total)).astype(np.int64)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["piece", "n"])


def piece_scores(docs: DataFrame, vocabulary: str = VOCABULARY, prior_weight: float = PRIOR_WEIGHT) -> np.ndarray:
    """Log probability of each piece of the vocabulary, from counts over all documents."""
    counted = word_counts(docs).mapInArrow(lambda batches: _piece_counts(batches, vocabulary), "piece int, n long")
    rows = counted.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # as many as the vocabulary has, at most
    return smoothed(rows["piece"].to_numpy(), rows["n"].to_numpy(), vocabulary, prior_weight)


def smoothed(pieces: np.ndarray, counts: np.ndarray, vocabulary: str, prior_weight: float) -> np.ndarray:
    sp = processor(vocabulary)
    place = np.argsort(np.argsort([-sp.get_score(i) for i in range(sp.get_piece_size())], kind="stable"))
    prior = 1.0 / (place + 10.0)
    prior /= prior.sum()
    n = np.zeros(len(prior))
    n[pieces] = counts
    return np.log(n + prior_weight * prior) - np.log(n.sum() + prior_weight)


def vocabulary_scores(vocabulary: str = VOCABULARY) -> np.ndarray:
    """Log probability of each piece from its place in the vocabulary alone."""
    return smoothed(np.zeros(0, np.int64), np.zeros(0), vocabulary, PRIOR_WEIGHT)


class Lattice:
    """The vocabulary as a hash table of code point strings, and the forward recursion."""

    def __init__(self, scores: np.ndarray, vocabulary: str):
        sp = processor(vocabulary)
        pieces = [(sp.id_to_piece(i), scores[i]) for i in range(len(scores)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = [(p, s) for p, s in pieces if p.rfind(_MARK) <= 0]
        self.byte_scores = np.full(256, -np.inf)
        for i in range(len(scores)):
            if sp.is_byte(i):
                self.byte_scores[int(sp.id_to_piece(i)[3:5], 16)] = scores[i]
        self.longest = max(len(p) for p, _ in pieces)
        text = "".join(p for p, _ in pieces)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(p) for p, _ in pieces])
        starts = np.cumsum(sizes) - sizes
        sums, inverse = self._sums(points)
        keys = self._key(sums, inverse, starts, sizes)
        self.bits = 18
        self.slots = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -np.inf)
        value = np.array([s for _, s in pieces])
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.slots[at[todo]] == 0
            first = np.unique(at[todo][free], return_index=True)[1]
            placed = todo[free][first]
            self.slots[at[placed]] = keys[placed]
            self.values[at[placed]] = value[placed]
            todo = np.setdiff1d(todo, placed)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.singles = {p: s for p, s in pieces if len(p) == 1}
        self.by_length = [bool((sizes == n).any()) for n in range(self.longest + 1)]

    @staticmethod
    def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power = np.full(len(points) + 1, _MUL, np.uint64)
        inverse = np.full(len(points) + 1, _INV, np.uint64)
        power[0] = inverse[0] = 1
        power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(power[:-1] * (points.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        return sums, inverse

    @staticmethod
    def _key(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        h = (sums[starts + sizes] - sums[starts]) * inverse[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h | np.uint64(1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = np.full(len(keys), -np.inf)
        todo = np.arange(len(keys))
        while len(todo):
            here = self.slots[at[todo]]
            hit = here == keys[todo]
            found[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[(here != 0) & ~hit]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return found

    def marginals(self, words: pa.Array) -> np.ndarray:
        """Log marginal probability of each word (the mark is put before it); 0 for the empty one."""
        marked = pc.binary_join_element_wise(pa.scalar(_MARK, words.type), words, pa.scalar("", words.type))
        sizes = pc.utf8_length(marked).to_numpy().astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        out = np.empty(len(words))
        at = 0
        while at < len(order):
            longest = int(sizes[order[at]])
            part = order[at : at + max(1, _LATTICE_CHARS // longest)]
            if longest > _LONG and len(part) < _FEW:
                for k in part.tolist():
                    out[k] = self._walk(marked[k].as_py())
            else:
                out[part] = self._forward(marked.take(pa.array(part)), sizes[part])
            at += len(part)
        out[np.asarray(pc.equal(words, ""))] = 0.0
        return out

    def _pieces(self, points: np.ndarray, room: np.ndarray, top: int) -> np.ndarray:
        """Score of the piece of each size (row) that begins at each point (column); room: points left in its word."""
        sums, inverse = self._sums(points)
        score = np.full((top + 1, len(points)), -np.inf)
        for size in range(1, top + 1):
            if self.by_length[size]:
                at = np.flatnonzero(room >= size)
                score[size, at] = self._lookup(self._key(sums, inverse, at, size))
        spelled = np.flatnonzero(np.isneginf(score[1]))
        if len(spelled):
            kinds, which = np.unique(points[spelled], return_inverse=True)
            score[1, spelled] = np.array([self.byte_scores[list(chr(p).encode("utf-8", "surrogatepass"))].sum() for p in kinds])[which]
        return score

    def _forward(self, words: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """Words in falling order of length."""
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        n, starts, longest = len(points), np.cumsum(sizes) - sizes, int(sizes[0])
        top = min(self.longest, longest)
        score = self._pieces(points, np.repeat(starts + sizes, sizes) - np.arange(n), top)
        alpha = np.full((longest + 1, len(sizes)), -np.inf)
        alpha[0] = 0.0
        active = np.searchsorted(-sizes, -np.arange(longest + 1), side="right")
        for t in range(1, longest + 1):
            m = int(active[t])
            terms = [alpha[t - size, :m] + score[size, starts[:m] + t - size] for size in range(1, min(t, top) + 1) if self.by_length[size] or size == 1]
            terms = np.stack(terms)
            peak = terms.max(axis=0)
            alpha[t, :m] = peak + np.log(np.exp(terms - peak).sum(axis=0))
        return alpha[sizes, np.arange(len(sizes))]

    def _walk(self, word: str) -> float:
        """One word of any length: the recursion needs the last ``longest`` values only."""
        size, top = len(word), self.longest
        ahead = [0.0] + [-math.inf] * top
        for start in range(0, size, _BLOCK):
            own = min(_BLOCK, size - start)
            points = np.frombuffer(word[start : start + own + top].encode("utf-32-le", "surrogatepass"), np.uint32)
            score = self._pieces(points, len(points) - np.arange(len(points)), top)[:, :own]
            at, length = np.nonzero(~np.isneginf(score.T))
            alpha = ahead + [-math.inf] * own
            for i, n, s in zip(at.tolist(), length.tolist(), score[length, at].tolist()):
                a, b = alpha[i] + s, alpha[i + n]
                if b > a:
                    a, b = b, a
                alpha[i + n] = a if b == -math.inf else a + math.log1p(math.exp(b - a))
            ahead = alpha[own : own + top + 1]
        return ahead[0]


def _scores(batches: Iterator[pa.RecordBatch], piece_logp: np.ndarray, vocabulary: str) -> Iterator[pa.RecordBatch]:
    lattice = Lattice(piece_logp, vocabulary)
    for batch in batches:
        col = batch.column("text")
        words, at, offsets = distinct_words(col)
        total = row_sums(lattice.marginals(words)[at], offsets)
        n_words = row_sums(np.asarray(pc.not_equal(words, "")).astype(np.int64)[at], offsets)
        n_bytes = pc.binary_length(pc.fill_null(col, "")).to_numpy().astype(np.float64)
        none = np.asarray(col.is_null())
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = -total / np.log(2) / n_bytes
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words),
                pa.array(total, pa.float64(), mask=none),
                pa.array(bits, pa.float64(), mask=none | (n_words == 0)),
            ],
            names=["doc_id", "n_words", "log_prob", "bits_per_byte"],
        )


def score(docs: DataFrame, piece_logp: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, log_prob, bits_per_byte) under given piece probabilities."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _scores(batches, piece_logp, vocabulary),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, log_prob double, bits_per_byte double",
    )


def score_corpus(docs: DataFrame, vocabulary: str = VOCABULARY, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """Score every document with probabilities counted over all of them."""
    return score(docs, piece_scores(docs, vocabulary, prior_weight), vocabulary)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))
