"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads the lower-cased text's UTF-8 bytes in windows of ``WINDOW`` bytes, one
recurrence from the left and one from the right; at every byte both states give the
probabilities of the languages.  A document's probabilities are the mean over all its bytes, and
its language is the largest.  The network is trained in numpy by backpropagation through time on
documents whose ``lang`` is given.

The labelled sample is bounded: at most ``PER_LANG`` documents of each language (chosen by a hash
of doc_id), ``SAMPLE_ROWS`` in all and ``SAMPLE_BYTES`` of text; a document that is repeated is in it
once.  Classification covers every byte of every document.

The state starts anew at each window, so that windows of all documents are read side by side and a
long document is no longer a chain of steps than a short one.  The first bytes of a window are read
without what is before them: that costs single positions, not documents (see the README for the
figures with and without).

Defined results
* null or empty text: no bytes, null language and probability.
* null languages aren't learned.  No labelled rows: every language is null.
* ties: the first language in alphabetical order.  Repeated rows are labelled alike.
* very long text: all its windows are read.  Empty table: empty result.  Extra columns aren't read,
  whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_texts, table, type_of
from .textops import string_parts

PER_LANG = 250
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 64 << 20
WINDOW = 128
HIDDEN = 8
STEPS, BATCH, TRAIN_WINDOW, RATE, SEED = 260, 192, 64, 0.02, 11
#: Windows that are read side by side.
_SIDE_BY_SIDE = 2048


class Direction(NamedTuple):
    """z and r gates first, then the candidate: table 256 x 3H, recurrent H x 3H."""

    table: np.ndarray
    recurrent: np.ndarray


class Model(NamedTuple):
    langs: list[str]
    left: Direction
    right: Direction
    out: np.ndarray  # 2H x languages
    bias: np.ndarray


def _read(x: np.ndarray, active: np.ndarray, d: Direction, order: range, keep: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """States (time, windows, H).  x: (time, windows) bytes; active[t]: how many windows reach t."""
    hidden = d.recurrent.shape[0]
    states = np.zeros((x.shape[0], x.shape[1], hidden), np.float32)
    h = np.zeros((x.shape[1], hidden), np.float32)
    half = np.float32(0.5)
    for t in order:
        m = int(active[t])
        own = h[:m]
        a = d.table[x[t, :m]]
        b = own @ d.recurrent
        gates = a[:, : 2 * hidden] + b[:, : 2 * hidden]
        gates *= half
        np.tanh(gates, out=gates)
        gates += 1
        gates *= half
        z, r = gates[:, :hidden], gates[:, hidden:]
        n = r * b[:, 2 * hidden :]
        n += a[:, 2 * hidden :]
        np.tanh(n, out=n)
        if keep is not None:
            keep["z"][t], keep["r"][t], keep["n"][t], keep["u"][t], keep["h"][t] = z, r, n, b[:, 2 * hidden :], own
        h[:m] = n + z * (own - n)
        states[t, :m] = h[:m]
    return states


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def probabilities(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum over each row's bytes of the languages' probabilities, number of bytes)."""
    sizes = np.diff(offsets)
    per_row = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = offsets[row] + nth * WINDOW
    size = np.minimum(WINDOW, offsets[row + 1] - start)
    order = np.argsort(-size, kind="stable")
    sums = np.zeros((len(sizes), len(model.langs)))
    steps = np.arange(WINDOW)[:, None]
    hidden = model.left.recurrent.shape[0]
    for at in range(0, len(order), _SIDE_BY_SIDE):
        part = order[at : at + _SIDE_BY_SIDE]
        longest = int(size[part[0]])
        x = raw[np.minimum(start[part][None, :] + steps[:longest], len(raw) - 1)]
        active = np.searchsorted(-size[part], -np.arange(1, longest + 1), side="right")
        left = _read(x, active, model.left, range(longest))
        right = _read(x, active, model.right, range(longest - 1, -1, -1))
        logits = left.reshape(-1, hidden) @ model.out[:hidden]
        logits += right.reshape(-1, hidden) @ model.out[hidden:]
        logits += model.bias
        np.exp(logits, out=logits)  # bounded: states are in (-1, 1)
        logits /= logits.sum(axis=1, keepdims=True)
        p = logits.reshape(longest, len(part), -1)
        for_window = p[: int(size[part[-1]])].sum(axis=0, dtype=np.float64)
        for t in range(int(size[part[-1]]), longest):
            for_window[: int(active[t])] += p[t, : int(active[t])]
        np.add.at(sums, row[part], for_window)
    return sums, sizes


def _train_direction(x: np.ndarray, d: Direction, order: range) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    hidden = d.recurrent.shape[0]
    keep = {k: np.zeros((*x.shape, hidden), np.float32) for k in "zrnuh"}
    return _read(x, np.full(x.shape[0], x.shape[1]), d, order, keep), keep


def _back(x: np.ndarray, d: Direction, order: range, keep: dict[str, np.ndarray], grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrent weights from those of the states."""
    hidden = d.recurrent.shape[0]
    parts = np.zeros((*x.shape, 3 * hidden), np.float32)
    g_rec = np.zeros_like(d.recurrent)
    g = np.zeros((x.shape[1], hidden), np.float32)
    for t in reversed(order):
        z, r, n, u, h = (keep[k][t] for k in "zrnuh")
        g = g + grad[t]
        gn = g * (1 - z) * (1 - n * n)
        gz = g * (h - n) * z * (1 - z)
        gr = gn * u * r * (1 - r)
        parts[t] = np.concatenate([gz, gr, gn], axis=1)
        through = np.concatenate([gz, gr, gn * r], axis=1)
        g_rec += h.T @ through
        g = g * z + through @ d.recurrent.T
    g_table = np.zeros_like(d.table)
    np.add.at(g_table, x.reshape(-1), parts.reshape(-1, 3 * hidden))
    return g_table, g_rec


def train(texts: pa.Array, langs: list[str], seed: int = SEED, steps: int = STEPS) -> Model:
    """Fit on (text, language) pairs; every byte of a window is labelled with the document's language."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y_of = np.array([names.index(x) for x in langs])
    raw, offsets = string_parts(pc.utf8_lower(texts))
    usable = [np.flatnonzero((y_of == k) & (np.diff(offsets) > 0)) for k in range(len(names))]
    usable = [u for u in usable if len(u)]

    def direction() -> list[np.ndarray]:
        return [rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32), rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)]

    params = [*direction(), *direction(), rng.normal(0, 0.3, (2 * HIDDEN, len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    ahead, behind = range(TRAIN_WINDOW), range(TRAIN_WINDOW - 1, -1, -1)
    for step in range(1, steps + 1):
        rows = np.array([rng.choice(usable[k]) for k in rng.integers(0, len(usable), BATCH)])
        room = np.maximum(offsets[rows + 1] - offsets[rows] - TRAIN_WINDOW, 0)
        at = offsets[rows] + (rng.random(BATCH) * (room + 1)).astype(np.int64)
        spread = np.arange(TRAIN_WINDOW)[:, None]
        inside = at[None, :] + spread < offsets[rows + 1][None, :]
        x = np.where(inside, raw[np.minimum(at[None, :] + spread, len(raw) - 1)], 32)
        left, right = Direction(params[0], params[1]), Direction(params[2], params[3])
        hl, kl = _train_direction(x, left, ahead)
        hr, kr = _train_direction(x, right, behind)
        states = np.concatenate([hl, hr], axis=2)
        p = _softmax(states @ params[4] + params[5])
        p[:, np.arange(BATCH), y_of[rows]] -= 1
        p *= (inside / max(1, inside.sum()))[:, :, None].astype(np.float32)
        g_states = p @ params[4].T
        grads = [
            *_back(x, left, ahead, kl, g_states[:, :, :HIDDEN]),
            *_back(x, right, behind, kr, g_states[:, :, HIDDEN:]),
            np.tensordot(states, p, ([0, 1], [0, 1])),
            p.sum(axis=(0, 1)),
        ]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - 0.8 * step / steps)
        for i, g in enumerate(grads):
            g = g / max(1.0, norm)
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)
    return Model(names, Direction(params[0], params[1]), Direction(params[2], params[3]), params[4], params[5])


def fit(docs: DataFrame, per_lang: int = PER_LANG, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Train on a bounded sample of the labelled documents."""
    texts = docs.filter("lang is not null and text <> ''").select("doc_id", "lang", F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("size")).alias("t"))
    labelled = texts.groupBy("doc_id", "lang").agg(F.min("t").alias("t")).select("doc_id", "lang", "t.*")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ranked = labelled.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("nth") <= per_lang)
    got = bounded_texts(docs, ranked, ["nth", "lang"], rows, most_bytes).select("doc_id", "lang", "text").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    if not got.num_rows:
        return None
    return train(got["text"].combine_chunks(), got["lang"].to_pylist())


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang, language, probability, n_bytes) for every document; probability: that of the language."""
    kind = type_of(docs, "doc_id")
    if model is None:
        return docs.select("doc_id", "lang", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.coalesce(F.octet_length(F.lower("text")), F.lit(0)).cast("long").alias("n_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.langs, dtype=object)
        for batch in batches:
            raw, offsets = string_parts(pc.utf8_lower(pc.fill_null(batch.column("text"), "")))
            sums, sizes = probabilities(model, raw, offsets)
            mean = sums / np.maximum(sizes, 1)[:, None]
            best = mean.argmax(axis=1)
            none = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("lang"),
                    pa.array(names[best], pa.string(), mask=none),
                    pa.array(mean[np.arange(len(best)), best], pa.float64(), mask=none),
                    pa.array(sizes),
                ],
                names=["doc_id", "lang", "language", "probability", "n_bytes"],
            )

    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, language string, probability double, n_bytes long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs))
