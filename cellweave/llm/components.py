"""Connected components of a table of links by joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every end of ``links`` (u, v): label is the smallest node that it reaches.

    Each round takes the smallest label among the neighbours, then the label
    of the label, so that long chains halve. Ends when a round changes nothing.
    Tables are merged, not broadcast: many small broadcasts, one round after
    another, fill the driver's memory faster than it is cleared.
    """
    both = stored(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("node", "v").hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        hung = label.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(hung.join(up.hint("merge"), "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        label = new.select("node", "label")


def united(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, label), with the classes united that ``links`` (u, v) between its nodes connect; rounds run over classes, not nodes."""
    named = links.select("u", "v").join(label.toDF("u", "lu").hint("merge"), "u").join(label.toDF("v", "lv").hint("merge"), "v")
    between = connected(named.filter("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct())
    out = label.join(between.toDF("label", "to"), "label", "left")
    return stored(out.select("node", F.coalesce("to", "label").alias("label")))
