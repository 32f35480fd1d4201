"""Near-duplicate classes: DartMinHash signatures, banded joining, exact check.

Elements are the distinct runs of five words of a text (its whole word
sequence if it has fewer), lower-cased A-Z, split at white space. Each
element's weight region [0, w) x [0, rank) is hit by hashed darts, a Poisson
process of rate 1; every dart has a coordinate, and each coordinate keeps its
earliest dart. Two texts agree in a coordinate with a probability equal to
their weighted Jaccard similarity; with weight 1 for every element, which is
what the classes use, that is the Jaccard similarity of the sets.

Texts that agree in a band of coordinates are candidates. The classes are the
connected components of the pairs whose exact similarity is at least
``least``. First each text is compared with the best few of its buckets'
centres, the members that meet most others; then the centre of every class in
a bucket with the centre of the largest class there; at last every pair of a
bucket that is still in two classes, so the first steps drop no link; bitmaps
of their runs rule out most of those pairs, and only pairs that can't have the
similarity. Pairs inside one class need no check.

Equal texts form one node throughout. A null or wordless text and a row
without key are classes of their own. Repeated rows get equal classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, whole
from .components import connected, united
from .tokens import Words, mix

SHINGLE, COORDINATES, ROWS = 5, 128, 6
#: Longs of the bitmap of a text's runs.
BITMAP = 32
STEPS = np.cumprod(np.full(ROWS, 0xC2B2AE3D27D4EB4F, np.uint64))
#: The coordinates of each band: two partitions of all coordinates, in order and shuffled.
BANDS = np.concatenate([p[: COORDINATES // ROWS * ROWS].reshape(-1, ROWS) for p in (np.arange(COORDINATES), np.random.default_rng(1).permutation(COORDINATES))])


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of five words, in order; one run for a shorter text."""
    n = len(words.hashes)
    padded = np.concatenate([words.hashes, np.zeros(SHINGLE, np.uint64)])
    run = np.zeros(n, np.uint64)
    ends = np.repeat(words.bounds[1:], np.diff(words.bounds))
    left = ends - np.arange(n)
    for k in range(SHINGLE):
        run += np.where(left > k, padded[k : n + k], np.uint64(0)) * STEPS[k]
    first = np.zeros(n, bool)
    first[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
    keep = (left >= SHINGLE) | first
    return mix(run)[keep], words.texts()[keep]


def distinct_counts(hashes: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements, their texts and how often each occurs."""
    bounds = np.searchsorted(texts, np.arange(n + 1))
    parts = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([p[0] for p in parts]), np.repeat(np.arange(n), [len(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])


def unit(h: np.ndarray) -> np.ndarray:
    """Hash -> (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def throw(elements: np.ndarray, texts: np.ndarray, weights: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts with rank up to ``limit`` of their text: text, rank, hash.

    Weight is cut in strips [0,1), [1,2), [2,4), ...; the darts of an element
    in a strip come in order of rank, each from a hash of element, strip and
    number, so whoever has the element finds the same darts.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low, width, strip = 0.0, 1.0, 0
    while len(elements):
        e, t, w, rank, number = elements, texts, weights, np.zeros(len(elements)), 0
        while len(e):
            h = mix(e + np.uint64(((strip << 32) + number) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(unit(h)) / width
            near = rank <= limit[t]
            e, t, w, rank, h = e[near], t[near], w[near], rank[near], h[near]
            other = mix(h + np.uint64(1))
            hit = low + unit(other) * width <= w
            out.append((t[hit], rank[hit], other[hit]))
            number += 1
        low, width = (1.0, 1.0) if strip == 0 else (low * 2, width * 2)
        more = weights > low
        elements, texts, weights, strip = elements[more], texts[more], weights[more], strip + 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def signatures(elements: np.ndarray, texts: np.ndarray, weights: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """n x k hashes of the earliest darts; rows of texts without elements stay 0."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(texts, weights, n)
    need = k * (np.log(k) + 4)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(n)
    limit[todo] = need / total[todo]
    while len(todo):
        mask = np.zeros(n, bool)
        mask[todo] = True
        own = mask[texts]
        t, rank, h = throw(elements[own], texts[own], weights[own], limit)
        cell = t * k + ((h >> np.uint64(40)) % np.uint64(k)).astype(np.int64)
        late = np.lexsort((h, rank))[::-1]
        filled = np.zeros(n * k, bool)
        filled[cell] = True
        out.reshape(-1)[cell[late]] = mix(h[late])
        todo = todo[~filled.reshape(n, k)[todo].all(axis=1)]
        limit[todo] *= 2
    return out


def weighted_signatures(column: pa.Array, presence: bool = True, k: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and element counts; weights are 1, or the counts of each run."""
    n = len(column)
    e, t, c = distinct_counts(*shingles(Words(column)), n)
    return signatures(e, t, np.ones(len(e)) if presence else c.astype(float), n, k), np.bincount(t, minlength=n)


def bitmaps(elements: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """n x BITMAP longs: one bit for each run of a text."""
    bit = (elements >> np.uint64(20)) % np.uint64(64 * BITMAP)
    out = np.zeros(n * BITMAP, np.uint64)
    np.bitwise_or.at(out, texts * BITMAP + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n, BITMAP)


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.reshape(-1).view(np.int64))


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, 256):
            b = big.slice(at, 256)
            e, t, _ = distinct_counts(*shingles(Words(b.column("text"))), b.num_rows)
            sig, n = signatures(e, t, np.ones(len(e)), b.num_rows), np.bincount(t, minlength=b.num_rows)
            bands = mix((sig[:, BANDS] * STEPS).sum(axis=2, dtype=np.uint64) + np.arange(len(BANDS), dtype=np.uint64))
            short = [x.tobytes() for x in (sig & np.uint64(0xFFFF)).astype("<u2")]
            rows = [b.column("key"), b.column("md5"), pa.array(n.astype(np.int64)), pa.array(short, pa.binary()), lists(bands), lists(bitmaps(e, t, len(n)))]
            yield pa.RecordBatch.from_arrays(rows, ["key", "md5", "n", "sig", "bands", "bits"])


def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the share of coordinates in which two short signatures agree."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("sig_u", "sig_v"))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array((x == y).mean(axis=1))], ["u", "v", "close"])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact Jaccard similarity of the two texts' sets of runs."""
    for big in batches:
        for at in range(0, big.num_rows, 256):
            b = big.slice(at, 256)
            sets = []
            for c in ("text_u", "text_v"):
                h, t = shingles(Words(b.column(c)))
                bounds = np.searchsorted(t, np.arange(b.num_rows + 1))
                sets.append([np.unique(h[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)])
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)])
            either = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)]) - both
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(both / np.maximum(either, 1))], ["u", "v", "jaccard"])


def close_pairs(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    sig = nodes.select("node", "sig")
    joined = pairs.join(sig.withColumnsRenamed({"node": "u", "sig": "sig_u"}).hint("merge"), "u").join(sig.withColumnsRenamed({"node": "v", "sig": "sig_v"}).hint("merge"), "v")
    return joined.select("u", "v", "sig_u", "sig_v").mapInArrow(estimate, "u long, v long, close double").filter(F.col("close") >= least)


def links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    joined = pairs.join(texts.withColumnsRenamed({"node": "u", "text": "text_u"}).hint("merge"), "u").join(texts.withColumnsRenamed({"node": "v", "text": "text_v"}).hint("merge"), "v")
    return joined.select("u", "v", "text_u", "text_v").mapInArrow(compare, "u long, v long, jaccard double").filter(F.col("jaccard") >= least)


def can_reach(least: float) -> Column:
    """Whether two sets of nx and n runs with bitmaps a and b can have the similarity, which no pair that has it fails.

    A bit of one bitmap that the other lacks is a run that the other text lacks.
    """
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(f"{y}{i}"))) for i in range(1, BITMAP)), F.bit_count(F.col(f"{x}0").bitwiseAND(F.bitwise_not(f"{y}0"))))
    shared = F.least(F.col("nx") - only("a", "b"), F.col("n") - only("b", "a"))
    return shared + 1e-9 >= (F.col("nx") + F.col("n") - shared) * least


def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u <> v").distinct()


def mixed_buckets(entries: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets with several classes, with their labels; each such bucket's largest class and its centre."""
    named = entries.join(label.hint("merge"), "node")
    by_label = named.groupBy("band", "label").agg(F.count("*").alias("m"), F.max_by("node", F.struct("met", "node")).alias("centre"))
    largest = F.max_by(F.struct("label", "centre"), F.struct("m", "label"))
    main = by_label.groupBy("band").agg(F.count("*").alias("labels"), largest.alias("l")).filter("labels > 1")
    main = main.select("band", F.col("l.label").alias("main"), F.col("l.centre").alias("centre"))
    mixed = stored(named.join(main.select("band"), "band"))
    return mixed, main


def text_digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), text_digest(whole(text)).alias("md5"), whole(text).alias("text"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, margin: float = 0.16, centres: int = 2) -> DataFrame:
    """One row per row of ``docs``: key, md5 of the text, n_shingles, class_id and class_md5 (key and md5 of the class's smallest (key, md5)).

    Where keys repeat, different classes may share a class_id; (class_id, class_md5) is theirs alone. Keys may be of any type that has an order.

    ``margin``: candidates are checked exactly if their signatures' estimate is
    at least ``least - margin`` (4.5 standard deviations at 128 coordinates).
    """
    signed, grouped = text_classes(keyed_texts(docs, key, text), "n > 0 and key is not null", least, margin, centres)
    least_row = grouped.groupBy("label").agg(F.min(F.struct("key", "md5")).alias("x"))
    classes = stored(grouped.join(least_row, "label").select("md5", F.col("x.key").alias("class_id"), F.col("x.md5").alias("class_md5")))
    out = signed.select("key", "md5", "n").join(classes, "md5", "left")
    judged = (F.col("n") > 0) & F.col("key").isNotNull()
    own = [F.when(judged, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("class_id", "key"), ("class_md5", "md5"))]
    return out.select(F.col("key").alias(key), "md5", F.col("n").alias("n_shingles"), *own)


def text_classes(rows: DataFrame, judged: str, least: float, margin: float, centres: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows; md5, node, smallest key and class label of each different text of those that are ``judged``."""
    signed = stored(rows.mapInArrow(sign, f"key {rows.schema['key'].dataType.simpleString()}, md5 string, n long, sig binary, bands array<long>, bits array<long>"))
    full = signed.filter(judged)
    nodes = full.groupBy("md5").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))

    entries = nodes.select("node", F.posexplode("bands").alias("i", "h")).select("node", F.xxhash64("i", "h").alias("band"))
    sizes = entries.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    entries = stored(entries.join(sizes, "band"))  # only buckets of two or more
    met = stored(entries.groupBy("node").agg(F.sum("m").alias("met")))
    entries = stored(entries.join(met, "node").select("node", "band", "met"))
    texts = stored(candidate_texts(rows, nodes, met.select("node")))

    central = F.max_by("node", F.struct("met", "node"))
    heads = entries.groupBy("band").agg(F.min("node").alias("a"), central.alias("b"))
    stars = entries.join(heads, "band").select("node", F.explode(F.array("a", "b")).alias("v")).filter("node <> v")
    close = close_pairs(ordered(stars, "node", "v"), nodes, least - margin)
    best = close.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("close", "v")), False), 1, centres).alias("x"))
    tried = stored(best.select("u", F.explode("x.v").alias("v")))
    found = links(tried, texts, least).select("u", "v")
    label = met.select("node").join(connected(found), "node", "left")
    label = stored(label.select("node", F.coalesce("label", "node").alias("label")))

    mixed, main = mixed_buckets(entries, label)
    some = mixed.groupBy("band", "label").agg(central.alias("x")).join(main, "band")
    pairs = ordered(some.filter("label <> main"), "x", "centre")
    more = stored(close_pairs(pairs, nodes, least - margin).select("u", "v").join(tried, ["u", "v"], "left_anti"))
    label, tried = united(label, links(more, texts, least)), tried.union(more)

    mixed, main = mixed_buckets(entries, label)
    bits = [F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(BITMAP)]
    mixed = mixed.join(main, "band").join(nodes.select("node", "n", *bits), "node")
    minor = mixed.filter("label <> main").select("band", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"), *[F.col(f"b{i}").alias(f"a{i}") for i in range(BITMAP)])
    # each pair once: two minor ends by order, a minor and a main end as they come
    cross = (F.col("lx") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("x") < F.col("node")))
    rest = minor.join(mixed, (minor["band"] == mixed["band"]) & cross & can_reach(least))
    rest = stored(ordered(rest, "x", "node").join(tried, ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        label = united(label, links(rest, texts, least))

    grouped = nodes.select("md5", "node", "key").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return signed, grouped


def candidate_texts(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the wanted nodes, each once, from the row with the node's key."""
    few = nodes.select("node", F.col("key").alias("_key"), F.col("md5").alias("_md5")).join(wanted, "node", "left_semi")
    return rows.join(few, F.col("key").eqNullSafe(F.col("_key")) & (F.col("md5") == F.col("_md5"))).groupBy("node").agg(F.first("text").alias("text"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, margin: float = 0.16, centres: int = 2) -> DataFrame:
    """The rows of ``docs`` that stand for their class: that of the smallest (key, md5), once; a null key comes last.

    Wordless texts are classes of their own, one for each (key, text); without key each row is one.
    """
    k, d = free_name(docs, "_k"), free_name(docs, "_d")
    signed, grouped = text_classes(keyed_texts(docs, key, text), "n > 0", least, margin, centres)
    least_row = grouped.groupBy("label").agg(F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "md5")).alias("x")).select("x.key", "x.md5")
    wordless = signed.filter("n = 0").select("key", "md5").distinct()
    kept = least_row.union(wordless.filter("key is not null")).select(F.col("key").alias(k), F.col("md5").alias(d))
    named = docs.withColumn(d, text_digest(whole(docs[text])))
    same = named[key].eqNullSafe(kept[k]) & (named[d] == kept[d])
    apart = wordless.filter("key is null").select(F.col("md5").alias(d))
    loose = named.filter(F.col(key).isNull()).join(apart, d, "left_semi")
    return named.join(kept, same, "left_semi").dropDuplicates([key, d]).select(docs.columns).unionByName(loose.select(docs.columns))
