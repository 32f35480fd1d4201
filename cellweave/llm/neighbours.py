"""Quality by the votes of nearest neighbours among labelled latent-semantic vectors.

A text is two bags, of words (lower-cased letters and digits) and of shapes: the kinds of
characters of a word run by run, with a mark where the word is one of the four before it.
Both are hashed, and the square roots of their shares, words weighted by how few sampled texts hold them, are
a vector. The leading right singular vectors of the labelled sample's matrix are the latent space; a text's
vector there has length one. For each document the products with all labelled vectors are computed
in blocks, exactly, and the ``k`` nearest (with all that tie with the k-th) vote with
their similarity, each class weighted to its share among all labels. The score is the share of the votes for label 1.

The sample has at most ``max_per_class`` labelled rows and ``max_bytes`` of text of each class, those with the smallest key hashes. One
task fits it, and only the fitted arrays, whose size is fixed, reach the driver and are broadcast. All else
covers every row and whole text. Nulls count as empty texts; a text without words, or whose neighbours all have no similarity, scores the
share of label 1, as every text does if a class is missing (0.5 without any label). Of a key with several labels the largest
counts, of one with several texts one is taken, always the same. Repeated rows and equal texts get equal scores.
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

from .common import restored, whole
from .tokens import ALNUM, MULT, PLAIN, Words, mix, text_bytes

WORD_BITS, SHAPE_BITS, RANK, BACK, RUNS = 12, 10, 48, 4, 12
WIDTH = (1 << WORD_BITS) + (1 << SHAPE_BITS)

#: Kinds of bytes in a shape: letters by case (bytes beyond ASCII as lower case), digits, and every sign for itself.
KIND = np.arange(256, dtype=np.uint64)
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 1, 2, 2, 3


def shapes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word's shape, and the texts' bounds."""
    w = Words(column, PLAIN)
    if not len(w.starts):
        return np.zeros(0, np.uint64), w.bounds
    kind = KIND[text_bytes(column)[0]]
    inside, begins = w.data != 0, np.zeros(len(w.data), bool)
    begins[w.starts] = True
    change = begins.copy()
    change[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(change & inside)
    first = np.flatnonzero(begins[runs])
    place = np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs))))
    value = (kind[runs] + np.uint64(1)) * np.cumprod(np.full(RUNS, MULT, np.uint64))[np.minimum(place, RUNS - 1)]
    value[place >= RUNS] = 0
    again, text = np.zeros(len(w.hashes), bool), w.texts()
    for back in range(1, BACK + 1):
        again[back:] |= (w.hashes[back:] == w.hashes[:-back]) & (text[back:] == text[:-back])
    return mix(np.add.reduceat(value, first) ^ again.astype(np.uint64)), w.bounds


def shares(slots: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """Square roots of the share of each slot among a text's; one row for each text."""
    n, size = len(bounds) - 1, 1 << bits
    at = (slots >> np.uint64(64 - bits)).astype(np.int64) + np.repeat(np.arange(n), np.diff(bounds)) * size
    counts = np.bincount(at, minlength=n * size).reshape(n, size)
    return np.sqrt(counts / np.maximum(np.diff(bounds), 1)[:, None]).astype(np.float32)


def bags(column: pa.Array) -> np.ndarray:
    """(texts, WIDTH) before words are weighted."""
    w = Words(column, ALNUM)
    return np.concatenate([shares(w.hashes, w.bounds, WORD_BITS), shares(*shapes(column), SHAPE_BITS)], axis=1)


class Model(NamedTuple):
    space: np.ndarray  # (WIDTH, RANK), with the weights of the words
    vectors: np.ndarray  # (labelled, RANK), of length one
    good: np.ndarray  # labels of the vectors
    weight: np.ndarray  # of the vectors' classes
    share: float  # of label 1


def latent(space: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = x @ space
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def fit(x: np.ndarray, good: np.ndarray, totals: dict[int, int]) -> Model:
    """The leading right singular vectors by power iterations from a fixed start."""
    n = len(x)
    held = (x > 0).sum(axis=0)
    weight = np.log((1 + n) / (1 + held)) / np.log(1 + n)
    weight[1 << WORD_BITS :] = 1
    weighted = (x * weight).astype(np.float32)
    basis = np.random.default_rng(5).standard_normal((WIDTH, RANK + 8)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, right = np.linalg.svd(weighted @ basis, full_matrices=False)
    space = ((basis @ right.T)[:, :RANK] * weight[:, None]).astype(np.float32)
    counts = {c: int((good == c).sum()) for c in (0, 1)}
    return Model(space, latent(space, x).astype(np.float32), good.astype(np.float32), np.where(good > 0, *[totals[c] / counts[c] for c in (1, 0)]).astype(np.float32), totals[1] / (totals[0] + totals[1]))


def votes(model: Model, x: np.ndarray, k: int) -> np.ndarray:
    """Scores of rows of bags: the share of the votes for label 1."""
    near = np.maximum(np.round(latent(model.space, x) @ model.vectors.T, 6), 0)
    k = min(k, near.shape[1])
    least = np.partition(near, near.shape[1] - k, axis=1)[:, -k][:, None]
    vote = np.where(near >= least, near, 0).astype(float) * model.weight
    total = vote.sum(axis=1)
    return np.where(total > 0, np.minimum((vote @ model.good) / np.maximum(total, 1e-300), 1.0), model.share)


class Trained(NamedTuple):
    model: Broadcast | None  # of a Model's arrays: under 2 MB whatever the input
    share: float


def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [row.tobytes() for row in bags(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("good"), pa.array(rows, pa.binary())], ["h", "good", "bag"])


def fitter(totals: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One task fits on the bounded sample and returns the arrays, packed."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["bag"]))
        good = np.array([r["good"] for r in rows])
        if len({*good}) == 2:
            x = np.frombuffer(b"".join(r["bag"] for r in rows), np.float32).reshape(len(rows), WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(fit(x, good, totals)))], pa.binary())], ["model"])

    return fitted


def train(
    docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_per_class: int = 1500, max_bytes: int = 24_000_000
) -> Trained:
    """Labelled vectors of the rows whose key is ``allowed``; a label above 0 counts as 1.

    ``allowed`` is a condition on the labels. Of each class at most ``max_per_class`` rows and, in the order of
    the keys' hashes, ``max_bytes`` of text (but one row at least).
    """
    marks = labels.filter(allowed & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).cast("int").alias("good"))
    totals = {c: 0 for c in (0, 1)} | {r["good"]: r["n"] for r in marks.groupBy("good").agg(F.count("*").alias("n")).collect()}
    share = totals[1] / sum(totals.values()) if any(totals.values()) else 0.5
    if not all(totals.values()):
        return Trained(None, share)
    order = F.xxhash64("k"), F.col("k")
    few = [marks.filter(F.col("good") == c).orderBy(*order).limit(max_per_class) for c in (0, 1)]
    rows = docs.select(F.col(key).cast(labels.schema[key].dataType).alias("k"), whole(text).alias("text")).join(F.broadcast(few[0].unionByName(few[1])), "k")
    rows = rows.groupBy("k", "good").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select(F.xxhash64("k").alias("h"), "k", "good", F.col("x.text").alias("text"))
    size = F.octet_length("text").cast("long")
    before = F.sum(size).over(Window.partitionBy("good").orderBy(*order)) - size
    rows = rows.withColumn("before", before).filter(F.col("before") < max_bytes).select("h", "good", "text")
    got = rows.mapInArrow(bagged, "h long, good int, bag binary").repartition(1).mapInArrow(fitter(totals), "model binary").collect()
    return Trained(docs.sparkSession.sparkContext.broadcast(pickle.loads(got[0]["model"])) if got else None, share)


def scorer(trained: Trained, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                s = np.full(b.num_rows, trained.share) if trained.model is None else votes(Model(*trained.model.value), bags(b.column("text")), k)
                names = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(s, pa.float64())], [*names, "r_score"])

    return score


def score_quality(docs: DataFrame, trained: Trained, keep: list[str], text: str = "text", k: int = 15) -> DataFrame:
    """``keep`` columns and score; an underscore follows the result's name where it is taken."""
    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], whole(text).alias("text"))
    return restored(rows.mapInArrow(scorer(trained, k), f"{kinds}r_score double"), keep, ("score",))
