"""Toxicity: a convolutional text classifier trained in numpy, with a threshold for each language.

A word is embedded as the sum of three rows of one hashed table: of the word, of its first four
bytes and of its first six.  Filters of one, two and three words slide over the embedded text,
each filter's largest response is kept (max pooling), and a logistic layer weighs them.  The
network is trained by gradient descent on all labelled documents but a part that is held out by a
hash of doc_id; on all of that part the threshold of each language is the one with the best F1 (at
the labels' own class ratio), halfway between the neighbouring scores.

Training begins on the driver, on a bounded sample: at most ``PER_CLASS`` documents of each language
and label, ``SAMPLE_ROWS`` in all and ``SAMPLE_BYTES`` of text, chosen by a hash of doc_id.  Unless that
is every labelled document, ``PASSES`` over all of them follow: ``SHARDS`` tasks each go on from the
network on their share, and the driver joins what they moved.  A document that is repeated, or has
several texts, is learned once.  The driver gets the score of every held-out document, not its text.
At scoring the filters are folded into the embedding table, so a word costs three lookups.

Defined results
* null or empty text: score 0, not toxic.  Null or unknown language: the threshold over all languages.
* labels: null labels are left out, of several for one document the largest counts; of several texts of
  one document the one with the smallest hash is learned.
* a language with fewer than ``LEAST_TOXIC`` held-out toxic or clean documents has the threshold over all.
* no labels of both classes: there is no model; scores and thresholds are null, nothing is toxic.
* ties (score equal to the threshold) are toxic.  Repeated rows are scored alike.
* empty table: empty result.  Extra columns are carried through ``keep_clean``, whatever their names.
* very long text: scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import bounded_texts, cut, small_side, table, within
from .textops import mix, row_slices, scan_words, string_parts

PER_CLASS = 800
SAMPLE_ROWS, SAMPLE_BYTES = 8000, 64 << 20
#: Tasks of a pass over all labelled documents, each of which returns a network of 2 MB, and passes.
SHARDS, PASSES = 16, 2
HELD_OUT = 0.3
TABLE = 1 << 15
DIM, FILTERS, WIDTHS = 12, 6, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.15, 7
#: A language gets its own threshold from so many held-out toxic rows on.
LEAST_TOXIC = 8
#: Share of a document's words that training leaves out at each visit, so that every telling word is learned, not only the strongest.
DROP_WORDS = 0.5
_SLICE = 1 << 18


class Model(NamedTuple):
    table: np.ndarray  # TABLE x taps: the embedding times every filter's every word
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    thresholds: dict[str | None, float]  # None: over all languages


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(3 x words) rows of the table for each word, and row offsets in words."""
    words = scan_words(raw, offsets)
    base = int(offsets[0])
    starts, ends = words.starts + base, words.ends + base
    head = np.zeros(len(starts), np.uint64)
    four = head
    for i in range(6):
        at = np.minimum(starts + i, max(0, len(raw) - 1))
        head = head | np.where(starts + i < ends, raw[at], 0).astype(np.uint64) << np.uint64(8 * i)
        if i == 3:
            four = head | np.uint64(1 << 62)
    keep = np.uint64(TABLE - 1)
    out = np.stack([words.hashes & keep, mix(four.copy()) & keep, mix(head | np.uint64(1 << 61)) & keep])
    return out.astype(np.int32), words.offsets


def _texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return string_parts(pc.utf8_lower(pc.fill_null(col, "")))


def pooled(words: np.ndarray, offsets: np.ndarray, folded: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Largest response of each filter for each row; rows without words get the bias alone."""
    n = words.shape[1]
    out = np.tile(bias, (len(offsets) - 1, 1))
    rows = np.flatnonzero(np.diff(offsets) > 0)
    if not n:
        return np.maximum(out, 0)
    taps = folded[words[0]]
    taps += folded[words[1]]
    taps += folded[words[2]]
    first = offsets[rows]
    last = offsets[rows + 1] - 1
    at = 0
    for w, width in enumerate(WIDTHS):
        response = taps[:, at : at + FILTERS].copy()
        for j in range(1, width):
            at += FILTERS
            shifted = taps[j:, at : at + FILTERS].copy()
            for back in range(j):  # words after the end of a row count nothing
                ends = last - back
                ends = ends[(ends >= 0) & (ends < len(shifted))]
                shifted[ends] = 0
            response[: n - j] += shifted
        at += FILTERS
        out[rows, w * FILTERS : (w + 1) * FILTERS] += np.maximum.reduceat(response, first, axis=0)
    return np.maximum(out, 0)


def _fold(embedding: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([embedding @ f[j] for f in filters for j in range(len(f))], axis=1).astype(np.float32)


class Network(NamedTuple):
    """What training moves; arrays are changed in place."""

    embedding: np.ndarray  # TABLE x DIM
    filters: list[np.ndarray]  # of each width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray  # one number


def gradients(net: Network, docs: list[np.ndarray], heard: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of the weighted cross-entropy of a batch: (rows of the embedding, their gradients, those of the rest).

    docs: (3 x words) rows of each text; heard: which of its words count."""
    grad_f, grad_b, grad_o, grad_c = [np.zeros_like(f) for f in net.filters], np.zeros_like(net.bias), np.zeros_like(net.out), np.zeros_like(net.offset)
    at_rows, at_grads = [np.zeros(0, np.int32)], [np.zeros((0, net.embedding.shape[1]), net.embedding.dtype)]
    for words, hears, y, importance in zip(docs, heard, toxic, weight):
        x = (net.embedding[words[0]] + net.embedding[words[1]] + net.embedding[words[2]]) * hears[:, None]
        x = np.concatenate([x, np.zeros((max(WIDTHS) - 1, x.shape[1]), x.dtype)])
        n = words.shape[1]
        hidden, places = np.empty_like(net.bias), []
        for w, width in enumerate(WIDTHS):
            response = sum(x[j : j + n] @ net.filters[w][j] for j in range(width))
            places.append(response.argmax(axis=0))
            hidden[w * FILTERS : (w + 1) * FILTERS] = response[places[w], np.arange(FILTERS)]
        hidden += net.bias
        live = hidden > 0
        hidden = hidden * live
        p = 1 / (1 + np.exp(-(hidden @ net.out + net.offset[0])))
        d = float(p - y) * importance
        grad_o += d * hidden
        grad_c += d
        back = d * net.out * live
        grad_b += back
        for w, width in enumerate(WIDTHS):
            g = back[w * FILTERS : (w + 1) * FILTERS]
            for j in range(width):
                where = places[w] + j
                grad_f[w][j] += x[where].T * g
                ok = (where < n) & (g != 0)
                ok[ok] &= hears[where[ok]]
                spread = net.filters[w][j].T[ok] * g[ok, None]
                for k in range(3):
                    at_rows.append(words[k][where[ok]])
                    at_grads.append(spread)
    rows, which = np.unique(np.concatenate(at_rows), return_inverse=True)
    grad_e = np.zeros((len(rows), net.embedding.shape[1]), net.embedding.dtype)
    np.add.at(grad_e, which, np.concatenate(at_grads))
    return rows, grad_e, grad_f, grad_b, grad_o, grad_c


class State(NamedTuple):
    net: Network
    seen: list[np.ndarray]  # Adagrad's sums: of the rows of the embedding, then of each array of the rest

    def arrays(self) -> list[np.ndarray]:
        return [self.net.embedding, *_rest(self.net), *self.seen]

    def copy(self) -> State:
        net = Network(self.net.embedding.copy(), [f.copy() for f in self.net.filters], self.net.bias.copy(), self.net.out.copy(), self.net.offset.copy())
        return State(net, [x.copy() for x in self.seen])


def _rest(net: Network) -> list[np.ndarray]:
    return [*net.filters, net.bias, net.out, net.offset]


def _descend(state: State, docs: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, usable: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """One visit (Adagrad) to the ``usable`` documents, in that order."""
    net, (seen_e, *seen) = state
    for start in range(0, len(usable), BATCH):
        batch = usable[start : start + BATCH]
        own = [docs[r] for r in batch]
        heard = [rng.random(words.shape[1]) >= DROP_WORDS for words in own]
        rows, grad_e, grad_f, *grads = gradients(net, own, heard, toxic[batch], weight[batch])
        seen_e[rows] += (grad_e**2).mean(axis=1)
        net.embedding[rows] -= rate * grad_e / np.sqrt(seen_e[rows])[:, None]
        for x, past, g in zip(_rest(net), seen, [*grad_f, *grads]):
            past += g**2
            x -= rate * g / np.sqrt(past)


def _cut_up(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(rows of the table for each text, which texts have words)."""
    raw, offsets = _texts(texts)
    docs = [buckets(raw, offsets[r : r + 2])[0] for r in range(len(offsets) - 1)]
    return docs, np.array([r for r in range(len(docs)) if docs[r].shape[1]], np.int64)


def train(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray, seed: int = SEED) -> State:
    """Gradient descent on (text, 0/1) from a random network."""
    rng = np.random.default_rng(seed)
    docs, usable = _cut_up(texts)
    embedding = rng.normal(0, 0.03, (TABLE, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.6, (width, DIM, FILTERS)).astype(np.float32) for width in WIDTHS]
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    out = rng.normal(0, 0.3, len(bias)).astype(np.float32)
    net = Network(embedding, filters, bias, out, np.array([-1.0]))
    state = State(net, [np.full(TABLE, 0.1, np.float32), *[np.full_like(x, 0.1) for x in _rest(net)]])
    for epoch in range(EPOCHS):
        rng.shuffle(usable)
        _descend(state, docs, toxic, weight, usable, RATE * (1 - epoch / (EPOCHS + 1)), rng)
    return state


def _pass(rows: DataFrame, state: State, weights: tuple[float, float], rate: float, seed: int) -> State:
    """``state`` after one visit to all ``rows`` (text, toxic): each shard goes on from it; a row of the
    embedding moves by the mean over the shards that moved it, the rest by the mean over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        own, rng, n = state.copy(), np.random.default_rng([seed, shard]), 0
        for batch in batches:
            toxic = batch.column("toxic").to_numpy().astype(np.float64)
            docs, usable = _cut_up(batch.column("text"))
            rng.shuffle(usable)
            _descend(own, docs, toxic, np.where(toxic == 1, weights[1], weights[0]), usable, rate, rng)
            n += len(usable)
        if n:
            moved = [(a - b).tobytes() for a, b in zip(own.arrays(), state.arrays())]
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([moved], pa.list_(pa.binary()))], names=["shard", "moved"])

    new, got = state.copy(), rows.select("text", "toxic").coalesce(SHARDS).mapInArrow(run, "shard long, moved array<binary>").toArrow().sort_by("shard")
    arrays = new.arrays()
    moved = [[np.frombuffer(m, a.dtype).reshape(a.shape) for m, a in zip(row, arrays)] for row in got["moved"].to_pylist()]
    if not moved:
        return new
    for k, a in enumerate(arrays):
        total = sum(m[k] for m in moved)
        if k == 0:
            a += total / np.maximum(1, sum((m[k] != 0).any(axis=1) for m in moved))[:, None].astype(a.dtype)
        else:
            a += total / len(moved) if k <= len(arrays) - 1 - len(state.seen) else total
    return new


def scores_of(texts: pa.Array, folded: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float) -> np.ndarray:
    raw, offsets = _texts(texts)
    out = np.zeros(len(texts), np.float64)
    for a, b in row_slices(offsets, _SLICE):
        words, own = buckets(raw, offsets[a : b + 1])
        hidden = pooled(words, own, folded, bias)
        p = 1 / (1 + np.exp(-(hidden.astype(np.float64) @ weights.astype(np.float64) + offset)))
        out[a:b] = np.where(np.diff(own) > 0, p, 0.0)
    return out


def threshold(scores: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1, halfway to the next lower score."""
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], toxic[order], weight[order]
    hits, wrong = np.cumsum(w * y), np.cumsum(w * (1 - y))
    f1 = 2 * hits / np.maximum(hits + wrong + (w * y).sum(), 1e-12)
    f1[:-1][s[:-1] == s[1:]] = -1
    best = int(np.argmax(f1))
    return float((s[best] + (s[best + 1] if best + 1 < len(s) else 0.0)) / 2)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, h, size, lang, toxic, held) of every labelled document, h being its text's hash."""
    labelled = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"), "lang").alias("t"))
    classes = texts.join(labelled, "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"), F.first("toxic").alias("toxic")).select("doc_id", "t.*", "toxic")
    return classes.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1000)) < int(1000 * HELD_OUT))


def _first(docs: DataFrame, classes: DataFrame, per_class: int, rows: int, most_bytes: int) -> DataFrame:
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ranked = classes.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "toxic").orderBy(*order))).filter(F.col("nth") <= per_class)
    sizes = classes.groupBy(F.col("lang").alias("class_lang"), F.col("toxic").alias("class_toxic")).agg(F.count(F.lit(1)).alias("of_class"))
    same = F.col("lang").eqNullSafe(F.col("class_lang")) & (F.col("toxic") == F.col("class_toxic"))
    return bounded_texts(docs, ranked.join(sizes, same).drop("class_lang", "class_toxic"), ["nth", "lang", "toxic"], rows, most_bytes).select("doc_id", "text", "lang", "toxic", "of_class", "held")


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, lang, toxic, of_class, held): where training begins; of_class: documents of its language and label in all."""
    return _first(docs, _labelled(docs, labels), per_class, rows, most_bytes)


def every(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(text, lang, toxic, held) of all labelled documents, each once, in the shared folder."""
    keys = cut(classes.select(F.xxhash64("doc_id", "h", "lang").alias("key"), "doc_id", "h", "toxic", "held"))
    keyed = docs.select(F.xxhash64("doc_id", F.xxhash64("text"), "lang").alias("key"), "text", "lang")
    found = within(keyed, keys.select("key"), "key").join(small_side(keys), "key")
    return stored(found.dropDuplicates(["doc_id"]).select("text", "lang", "toxic", "held"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on all labelled documents: first on the sample, on the driver, then by passes over all."""
    classes = cut(_labelled(docs, labels))
    counts = [(r["lang"] or "", r["toxic"], r["held"], r["count"]) for r in classes.groupBy("lang", "toxic", "held").count().collect()]

    def number(lang: str | None = None, y: int | None = None, held: bool | None = None) -> int:
        return sum(n for a, b, h, n in counts if lang in (None, a) and y in (None, b) and held in (None, h))

    if not (number(y=1) and number(y=0)):
        return None
    got = _first(docs, classes, per_class, rows, SAMPLE_BYTES).toArrow().sort_by("doc_id")
    text = got["text"].combine_chunks() if got.num_rows else got["text"]
    toxic = got["toxic"].to_numpy().astype(np.float64)
    apart = all(number(y=y, held=h) for y in (0, 1) for h in (False, True))
    learned = np.flatnonzero(~np.array(got["held"].to_pylist(), bool)) if apart else np.arange(len(toxic))
    y = toxic[learned]
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    state = train(text.take(pa.array(learned)), y, balance)
    rows_of = every(docs, classes)
    if len(toxic) < number():
        own = rows_of.filter("not held") if apart else rows_of
        n = [number(y=k, held=False if apart else None) for k in (0, 1)]
        for k in range(PASSES):
            state = _pass(own, state, (0.5 * sum(n) / n[0], 0.5 * sum(n) / n[1]), RATE * (1 - k / PASSES) / 2, SEED + k)
    net = state.net
    folded, bias, weights, offset = _fold(net.embedding, net.filters), net.bias, net.out, float(net.offset[0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores_of(batch.column("text"), folded, bias, weights, offset)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(s)], names=["lang", "toxic", "score"])

    judged = rows_of.filter("held") if apart else rows_of
    on = judged.select("lang", "toxic", "text").mapInArrow(scored, "lang string, toxic int, score double").toArrow()
    langs = np.array([x or "" for x in on["lang"].to_pylist()])
    toxic, s = on["toxic"].to_numpy().astype(np.float64), on["score"].to_numpy()
    natural = np.zeros(len(toxic))
    for lang in np.unique(langs):
        for y in (0, 1):
            m = (langs == lang) & (toxic == y)
            if m.any():
                natural[m] = number(str(lang), y) / m.sum()
    cuts: dict[str | None, float] = {None: threshold(s, toxic, natural)}
    for lang in np.unique(langs):
        m = langs == lang
        if lang and toxic[m].sum() >= LEAST_TOXIC and (1 - toxic[m]).sum() >= LEAST_TOXIC:
            cuts[str(lang)] = threshold(s[m], toxic[m], natural[m])
    return Model(folded, bias, weights, offset, cuts)


def _judged(texts: pa.Array, langs: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    s = scores_of(texts, model.table, model.bias, model.weights, model.offset)
    cuts = np.array([model.thresholds.get(x, model.thresholds[None]) for x in langs.to_pylist()])
    return s, cuts


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang, score, threshold, toxic) for every document."""
    if model is None:
        return docs.select("doc_id", "lang", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, cuts = _judged(batch.column("text"), batch.column("lang"), model)
            toxic = (s >= cuts) & (s > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(s), pa.array(cuts), pa.array(toxic)],
                names=["doc_id", "lang", "score", "threshold", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, score double, threshold double, toxic boolean")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rows found toxic."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, cuts = _judged(batch.column(text), batch.column(lang), model)
            yield batch.filter(pa.array(~((s >= cuts) & (s > 0))))

    text, lang = (docs.columns.index(c) for c in ("text", "lang"))
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names of any signs
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
