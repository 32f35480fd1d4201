"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (lower-cased, cut at white space and ASCII signs) has an embedding
made of three hashed rows, side by side: two independent hashes of the word,
so that a collision fills only half of it, and one of its first four bytes.
Filters of widths 1, 2 and 3 run over the words, the largest response of each
filter is kept for the text, and a logistic unit reads them. Rows start at
the shrunk log-odds of their words in the sample, then everything is trained
by Adagrad on the sample.

Training takes at most ``max_per_class`` labelled rows and ``max_bytes`` of text
of each class, those with the smallest key hashes, but for a fifth of them. All labelled rows it was
not fitted on, however many, are then scored and counted by language, score
and class; from these counts, each class weighted to its share among all
labels, comes a threshold for each language. Scoring covers every whole text. Nulls count as empty texts,
whose score is the model's bias; without samples of both classes the score is
the share of toxic labels (0 without any). Repeated rows get equal scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import restored, stored, whole
from .tokens import ALNUM, Words

PREFIX, DIM, WIDTHS, FILTERS = 4, 8, (1, 2, 3), 8
WORD_BITS, PREFIX_BITS = 17, 15
DEFAULT_THRESHOLD = 0.3
GRID = np.arange(20, 81) / 100


class Model(NamedTuple):
    tables: tuple[np.ndarray, np.ndarray, np.ndarray]
    kernels: tuple[np.ndarray, ...]  # one (width, 3 DIM, FILTERS) for each width
    biases: tuple[np.ndarray, ...]
    out: np.ndarray
    bias: float


def slots(words: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = np.uint64((1 << WORD_BITS) - 1)
    return (words & mask).astype(np.int32), ((words >> np.uint64(24)) & mask).astype(np.int32), (prefixes & np.uint64((1 << PREFIX_BITS) - 1)).astype(np.int32)


def embed(model: Model, ids: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.concatenate([t[i] for t, i in zip(model.tables, ids, strict=True)], axis=1).astype(np.float32, copy=False)


def responses(model: Model, x: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Of each width's filters at each word; what lies beyond the end of a text counts as zeros."""
    out = []
    for kernel, bias in zip(model.kernels, model.biases, strict=True):
        y = x @ kernel[0] + bias
        for k in range(1, len(kernel)):
            y[:-k] += (x[k:] @ kernel[k]) * (left[:-k, None] > k)
        out.append(y)
    return out


def scores(model: Model, ids: tuple[np.ndarray, ...], bounds: np.ndarray) -> np.ndarray:
    """One score for each text between two bounds."""
    n = len(bounds) - 1
    pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1])
        y = responses(model, embed(model, ids), left)
        pooled[some] = np.concatenate([np.maximum(np.maximum.reduceat(v, bounds[:-1][some]), 0) for v in y], axis=1)
    return 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30).astype(float)))


def log_odds(index: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Of each slot by the texts that hold it, shrunk towards 0 by three texts of the mean."""
    parts = [np.unique(index[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    doc, slot = np.repeat(np.arange(len(y)), [len(p) for p in parts]), np.concatenate(parts)
    toxic = np.bincount(slot, y[doc] * weight[doc], size)
    clean = np.bincount(slot, (1 - y[doc]) * weight[doc], size)
    mean = (y * weight).sum() / weight.sum()
    rate = (toxic + 3 * mean) / (toxic + clean + 3)
    return np.clip(np.log(rate / (1 - rate)) - np.log(mean / (1 - mean)), -4, 4)


def initial(ids: tuple[np.ndarray, ...], bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    rng = np.random.default_rng(7)
    tables = []
    for index, bits in zip(ids, (WORD_BITS, WORD_BITS, PREFIX_BITS), strict=True):
        t = rng.standard_normal((1 << bits, DIM), np.float32) * np.float32(0.02)
        t[:, 0] = log_odds(index, bounds, y, weight, 1 << bits) / 4
        tables.append(t)
    kernels = [rng.normal(0, 0.1, (w, 3 * DIM, FILTERS)) for w in WIDTHS]
    for k in kernels:
        k[0, [0, DIM], : FILTERS // 2] += 0.7
        k[0, 2 * DIM, : FILTERS // 2] += 0.2
    mean = (y * weight).sum() / weight.sum()
    out = np.concatenate([np.where(np.arange(FILTERS) < FILTERS // 2, 0.2, 0.0)] * len(WIDTHS))
    return Model(tuple(tables), tuple(k.astype(np.float32) for k in kernels), tuple(np.zeros(FILTERS, np.float32) for _ in WIDTHS), out.astype(np.float32), float(np.log(mean / (1 - mean))) - 1)


def fit(ids: tuple[np.ndarray, ...], bounds: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.05) -> Model:
    """Adagrad; through max pooling only the winning windows of a text are changed."""
    m = initial(ids, bounds, y, weight)
    tables, kernels, biases, out, bias = list(m.tables), list(m.kernels), list(m.biases), m.out.copy(), m.bias
    seen = [np.full(t.shape, 0.1, np.float32) for t in tables]
    seen_k, seen_b, seen_o, seen_c = [np.full(k.shape, 0.1, np.float32) for k in kernels], [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS], np.full(out.shape, 0.1, np.float32), 0.1
    rng = np.random.default_rng(11)
    scale = weight / weight.mean()
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(np.diff(bounds)))
        for chunk in (order[i : i + batch] for i in range(0, len(order), batch)):
            length = np.diff(bounds)[chunk]
            local = np.concatenate([[0], np.cumsum(length)])
            pick = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in chunk])
            own = tuple(i[pick] for i in ids)
            m = Model(tuple(tables), tuple(kernels), tuple(biases), out, bias)
            x = embed(m, own)
            left = np.repeat(local[1:], length) - np.arange(local[-1])
            resp = responses(m, x, left)
            top = [np.stack([a + v[a:b].argmax(0) for a, b in zip(local[:-1], local[1:], strict=True)]) for v in resp]
            pooled = np.concatenate([np.take_along_axis(v, t, 0) for v, t in zip(resp, top, strict=True)], axis=1)
            active = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ out + bias, -30, 30)))
            err = ((p - y[chunk]) * scale[chunk] / len(chunk)).astype(np.float32)
            back = err[:, None] * out * (pooled > 0)
            g = active.T @ err + 1e-4 * out
            seen_o += g * g
            seen_c += float(err.sum()) ** 2
            out = out - rate * g / np.sqrt(seen_o)
            bias -= rate * float(err.sum()) / seen_c**0.5
            grad_x: list[tuple[np.ndarray, np.ndarray]] = []
            for j, (kernel, t) in enumerate(zip(kernels, top, strict=True)):
                d = back[:, j * FILTERS : (j + 1) * FILTERS]
                g_k = np.zeros_like(kernel)
                for k in range(len(kernel)):
                    inside = left[t] > k
                    at = np.minimum(t + k, len(x) - 1)
                    dk = d * inside
                    g_k[k] = np.einsum("bf,bfe->ef", dk, x[at])
                    grad_x.append((at.reshape(-1), (dk[:, :, None] * kernel[k].T).reshape(-1, 3 * DIM)))
                g_k += 1e-4 * kernel
                seen_k[j] += g_k * g_k
                kernels[j] = kernel - rate * g_k / np.sqrt(seen_k[j])
                g_b = d.sum(0)
                seen_b[j] += g_b * g_b
                biases[j] = biases[j] - rate * g_b / np.sqrt(seen_b[j])
            at, g_x = np.concatenate([a for a, _ in grad_x]), np.concatenate([v for _, v in grad_x])
            for i, table in enumerate(tables):
                rows, inverse = np.unique(own[i][at], return_inverse=True)
                g_t = np.zeros((len(rows), DIM), np.float32)
                np.add.at(g_t, inverse, g_x[:, i * DIM : (i + 1) * DIM])
                seen[i][rows] += g_t * g_t
                table[rows] -= rate * g_t / np.sqrt(seen[i][rows])
    return Model(tuple(tables), tuple(kernels), tuple(biases), out, bias)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their words' three slots, packed in one long for each word."""
    for b in batches:
        w = Words(b.column("text"), ALNUM, (PREFIX,))
        x, y, z = (i.astype(np.int64) for i in slots(w.hashes, w.prefixes[0]))
        packed = x | y << WORD_BITS | z << 2 * WORD_BITS
        parts = [packed[i:j].tobytes() for i, j in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("toxic"), pa.array(parts, pa.binary())], ["_k", "toxic", "words"])


def unpacked(words: pa.ChunkedArray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Slots of all words of the texts in order, and the texts' bounds; read from Arrow's buffers."""
    words = words.combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = words.buffers()[2]
    all_ = np.frombuffer(data, np.int64, (ends[-1] - ends[0]) // 8, ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.int64)
    low, prefix = (1 << WORD_BITS) - 1, (1 << PREFIX_BITS) - 1
    ids = (all_ & low).astype(np.int32), (all_ >> WORD_BITS & low).astype(np.int32), (all_ >> 2 * WORD_BITS & prefix).astype(np.int32)
    return ids, (ends - ends[0]) // 8


class Trained(NamedTuple):
    model: Broadcast | None  # of a Model's arrays: 5 MB whatever the input
    share: float
    thresholds: dict[str, float]


def best_threshold(toxic: np.ndarray, clean: np.ndarray, weights: tuple[float, float]) -> float:
    """Of ``GRID``, the one with the best F1, from counts of rows by the number of thresholds they reach; the default with fewer than 10 of a class."""
    if min(toxic.sum(), clean.sum()) < 10:
        return DEFAULT_THRESHOLD
    hit, wrong = (w * c[::-1].cumsum()[::-1][1:] for w, c in zip(weights, (toxic, clean), strict=True))
    f1 = 2 * hit / np.maximum(1e-9, hit + wrong + weights[0] * toxic.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(GRID[best[len(best) // 2]])


def reached(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many thresholds of ``GRID`` each text's score reaches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                w = Words(b.column("text"), ALNUM, (PREFIX,))
                s = scores(Model(*model.value), slots(w.hashes, w.prefixes[0]), w.bounds)
                yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("lang"), pa.array(np.searchsorted(GRID, s, side="right").astype(np.int32))], ["_k", "lang", "reached"])

    return count


def calibrated(model: Broadcast, rows: DataFrame, marks: DataFrame, totals: dict[int, int]) -> dict[str, float]:
    """Thresholds by language from the rows whose keys ``marks`` names; only keys and counts are shuffled."""
    kind = rows.schema["_k"].dataType.simpleString()
    met = rows.mapInArrow(reached(model), f"_k {kind}, lang string, reached int").join(marks.select("_k", (F.col("toxic") > 0).cast("int").alias("toxic")), "_k")
    met = met.groupBy("_k").agg(F.min(F.struct("lang", "reached", "toxic")).alias("x"))  # one row of a repeated key
    counts: dict[str, np.ndarray] = {}
    for r in met.groupBy("x").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["x"]["lang"], np.zeros((2, len(GRID) + 1)))[r["x"]["toxic"], r["x"]["reached"]] = r["n"]
    seen = sum(counts.values(), np.zeros((2, len(GRID) + 1))).sum(axis=1)
    weights = tuple(totals[c] / max(1.0, seen[c]) for c in (1, 0))
    return {x: best_threshold(c[1], c[0], weights) for x, c in counts.items()}


def halved(m: Model) -> tuple:
    """The model with tables of half the size, which is what is sent around."""
    return tuple(m._replace(tables=tuple(t.astype(np.float16) for t in m.tables)))


def fitter(totals: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One task fits the model on all rows it gets and returns its arrays, packed."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        got = pa.Table.from_batches(held)
        got = got.take(pa.array(np.argsort([hash_bytes(x.as_buffer()) for x in got["words"]], kind="stable")))
        y = got["toxic"].to_numpy().astype(float)
        counts = {c: int((y == c).sum()) for c in (1, 0)}
        if all(counts.values()):
            weight = np.where(y > 0, *[totals[c] / counts[c] for c in (1, 0)])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(halved(fit(*unpacked(got["words"]), y, weight)))], pa.binary())], ["model"])

    return fitted


def train(
    docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", max_per_class: int = 3000, max_bytes: int = 24_000_000
) -> Trained:
    """Fits on the labelled rows whose key is ``allowed``; a key with several labels counts as toxic if one says so.

    Of each class at most ``max_per_class`` rows and, in the order of the keys'
    hashes, ``max_bytes`` of text (but one row at least) are fitted, by one task.
    Of a key with several texts one is taken, always the same. Only the fitted
    arrays, whose size is fixed, reach the driver.
    """
    marks = labels.filter(allowed & F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max("toxic").alias("toxic"))
    totals = {int(r["toxic"]): r["n"] for r in marks.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n = sum(totals.values())
    if len(totals) < 2:
        return Trained(None, totals.get(1, 0) / max(1, n), {})
    pick = [marks.filter(c).orderBy(F.xxhash64("_k"), "_k").limit(max_per_class) for c in ("toxic > 0", "toxic <= 0")]
    part = F.pmod(F.xxhash64("_k", F.lit(5)), F.lit(5)).cast("int")
    few = F.broadcast(pick[0].unionByName(pick[1]).filter(part > 0))
    docs = docs.select(F.col(key).cast(labels.schema[key].dataType).alias("_k"), whole(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    rows = docs.join(few, "_k").groupBy("_k").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"), F.first((F.col("toxic") > 0).cast("int")).alias("toxic"))
    before = F.sum(F.octet_length("x.text").cast("long")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("_k"), "_k")) - F.octet_length("x.text")
    rows = rows.select("_k", "toxic", F.col("x.text").alias("text"), before.alias("before")).filter(F.col("before") < max_bytes)
    used = stored(rows.mapInArrow(hashed, f"_k {docs.schema['_k'].dataType.simpleString()}, toxic int, words binary"))
    got = used.select("toxic", "words").repartition(1).mapInArrow(fitter(totals), "model binary").collect()
    if not got:
        return Trained(None, totals[1] / n, {})
    model = docs.sparkSession.sparkContext.broadcast(pickle.loads(got.pop()["model"]))
    left = marks.join(F.broadcast(used.select("_k")), "_k", "left_anti")
    return Trained(model, totals[1] / n, calibrated(model, docs.filter(F.col("_k").isNotNull()), left, totals))


def hash_bytes(x: pa.Buffer | None) -> int:
    """A number that orders texts alike in every run."""
    return int(np.frombuffer(x, np.uint64, min(64, x.size // 8)).sum(dtype=np.uint64)) if x is not None and x.size else 0


def scorer(trained: Trained) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                if trained.model is None:
                    s = np.full(b.num_rows, trained.share)
                else:
                    w = Words(b.column("text"), ALNUM, (PREFIX,))
                    s = scores(Model(*trained.model.value), slots(w.hashes, w.prefixes[0]), w.bounds)
                limit = [trained.thresholds.get(x or "", DEFAULT_THRESHOLD) for x in b.column("lang").to_pylist()]
                names = [c for c in b.schema.names if c not in ("text", "lang")]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(s, pa.float64()), pa.array(limit, pa.float64())], [*names, "r_score", "r_threshold"])

    return score


def score_toxicity(docs: DataFrame, trained: Trained, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep`` columns, score, threshold of the row's language, and flagged (score at or above it).

    A result whose name is among ``keep`` gets an underscore at its end.
    """
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, whole(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = rows.mapInArrow(scorer(trained), f"{kinds}r_score double, r_threshold double")
    return restored(out.withColumn("r_flagged", F.col("r_score") >= F.col("r_threshold")), keep, ("score", "threshold", "flagged"))
