"""Sharding by sampled splitters: shards of near equal bytes.

A sample of keys, drawn with a probability in proportion to size, gives
splitters at its quantiles; records are range-partitioned by them. A key that
fills several splitters is dealt over as many ranges; ranges that still hold
more than ``overfull`` times their share get splitters from a denser sample of
their own. Exact bytes and counts of the ranges then place every record on one
line of bytes that is cut into equal shards, so shards differ by less than two
records. No range, and so no task, holds a large part of the data.

A null key sorts first; a null text has no bytes. Repeated rows get different
slots; records with equal texts are placed by their keys and sizes like others,
so a group of copies spreads over as many shards as its bytes fill. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import restored, stored, whole

OVERHEAD = 16


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text and the record's overhead."""
    return F.octet_length(text).cast("long") + OVERHEAD


def splitters(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Keys at the quantiles of the weights."""
    if not len(keys) or parts < 2:
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    line = np.cumsum(weights[order])
    return keys[order][np.searchsorted(line, line[-1] * np.arange(1, parts) / parts)]


def range_of(cuts: np.ndarray):  # noqa: ANN201
    """Range of each record; a key that equals several cuts is dealt over the ranges between them by its tie."""

    @F.pandas_udf("int")
    def ranged(key: pd.Series, tie: pd.Series) -> pd.Series:
        low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
        dealt = (tie.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        several = high - low > 1
        return pd.Series(np.where(several, low + 1 + (dealt % np.maximum(high - low - 1, 1).astype(np.uint64)).astype(np.int64), high).astype(np.int32))

    return ranged


def drawn(rows: DataFrame, k: str, size: str, tie: str, each: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn with probability size / each, at most 1, and the bytes that each stands for."""
    u = F.pmod(F.xxhash64(tie, F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    got = rows.filter(u * each < F.col(size)).select(F.col(k).alias("k"), F.greatest(F.col(size).cast("double"), F.lit(each)).alias("w")).toArrow()
    return got["k"].to_numpy(), got["w"].to_numpy()


def shards(
    records: DataFrame,
    size: Column,
    key: str = "doc_id",
    n_shards: int = 40,
    ranges_per_shard: int = 25,
    sample: int = 20000,
    overfull: float = 3.0,
) -> DataFrame:
    """The records with size, shard (0 to n_shards - 1) and slot (0, 1, ... in each shard); a result whose name is taken gets an underscore.

    ``size``: positive bytes of a record. Keys that are no whole numbers are ordered by their hashes.
    About ``sample`` keys and ``n_shards * ranges_per_shard`` range totals reach the driver.
    """
    k, tie, r = "key", "tie", "range"
    place = F.col(f"c{records.columns.index(key)}")
    whole_number = isinstance(records.schema[key].dataType, IntegralType)
    ordered = F.coalesce(place.cast("long") if whole_number else F.when(place.isNotNull(), F.xxhash64(place)), F.lit(-(1 << 63)).cast("long"))
    named = [f"c{i}" for i in range(len(records.columns))]
    rows = stored(records.select("*", size.alias("size")).toDF(*named, "r_size").withColumn(k, ordered).withColumn(tie, F.monotonically_increasing_id()))
    results = ("size", "shard", "slot")
    total = rows.agg(F.sum("r_size")).first()[0] or 0
    if not total:
        return restored(rows.withColumn("r_shard", F.lit(0)).withColumn("r_slot", F.lit(0).cast("long")), records.columns, results)
    parts = n_shards * ranges_per_shard
    cuts = splitters(*drawn(rows, k, "r_size", tie, total / sample), parts)
    for _ in range(3):
        placed = rows.withColumn(r, range_of(cuts)(k, tie))
        totals = placed.groupBy(r).agg(F.sum("r_size").alias("bytes"), F.count("*").alias("n"), F.max("r_size").alias("largest")).orderBy(r).collect()
        full = [x for x in totals if x["bytes"] > overfull * total / parts and x["bytes"] > 2 * x["largest"]]
        if not full:
            break
        for x in full:  # a bounded number: each holds several shares
            more = drawn(placed.filter(F.col(r) == x[r]), k, "r_size", tie, x["bytes"] / 2000)
            cuts = np.concatenate([cuts, splitters(*more, max(2, int(x["bytes"] * parts / total) + 1))])
        cuts = np.sort(cuts)
    placed = rows.withColumn(r, range_of(cuts)(k, tie))
    totals = placed.groupBy(r).agg(F.sum("r_size").alias("bytes"), F.count("*").alias("n")).orderBy(r).collect()
    starts, at_byte, at_row = [], 0, 0
    for x in totals:
        starts.append((x[r], at_byte, at_row))
        at_byte, at_row = at_byte + x["bytes"], at_row + x["n"]
    begin = F.broadcast(rows.sparkSession.createDataFrame(starts, f"{r} int, byte long, row long"))
    inside = F.expr(f"row_number() over (partition by {r} order by {k}, {tie})")
    before = F.expr(f"sum(r_size) over (partition by {r} order by {k}, {tie} rows unbounded preceding) - r_size")
    lined = placed.withColumn("i", inside).withColumn("b", before).join(begin, r)
    shard = F.least(F.lit(n_shards - 1), F.expr(f"(byte + b) * {n_shards} div {total}")).cast("int")
    lined = lined.withColumn("r_shard", shard).withColumn("at", (F.col("row") + F.col("i") - 1).cast("long"))
    first = F.broadcast(lined.groupBy("r_shard").agg(F.min("at").alias("head")))
    out = lined.join(first, "r_shard").withColumn("r_slot", F.col("at") - F.col("head"))
    return restored(out, records.columns, results)


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 40) -> DataFrame:
    """The documents with size, shard and slot."""
    return shards(docs, text_size(whole(text)), key, n_shards)
