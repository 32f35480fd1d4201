"""Filter interaction audit: what each filter removes in every order of the filters.

Each document becomes one mask of the filters that it fails. Documents are counted
by part and mask, at most 32 cells a part, and each cell folds across
the array of all 120 orders: ``transform`` goes over the orders, ``aggregate``
over the five letters of one, and the 600 structs that come out are weighted
by the cell's counts. The cells of a part are merged by elementwise sums.
The orders are a literal of the plan, so nothing is joined for them.

Whole texts are read once and become a digest (SHA-256) and a mask. Equal
(digest, key, part) are counted before any other shuffle; the smallest key
of each digest is a partial minimum, and meets rows by digest and key, so
a text or a key that a third of all rows share is spread or summed up first.

A null text is empty, a null part is the empty string. A row without key is
no copy, nor makes others copies. Rows that share text and key are no copies
of each other (no key is smaller). Of several labels of a key the largest counts;
without label nothing is good or toxic. An empty table gives no rows. Other
columns of the documents, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole, words

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column, min_words: int = 200) -> Column:
    """Bits 1, 2, 4 and 8 of the filters that look at one text alone: few words, few different words, capitals, signs."""
    w = words(text)
    few = F.size(w) < min_words
    repeats = F.size(F.array_distinct(w)) * 100 < F.size(w) * 50
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (few, repeats, capitals.cast("long") * 100 > F.length(text).cast("long") * 3, text.rlike(r"[#$%&*|]"))
    return reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)])


def masked(docs: DataFrame, labels: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(part, mask, n, good, toxic) for each mask that occurs in a part."""
    t = whole(text)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("d"), text_mask(t).alias("mask"))
    rows = stored(rows.groupBy("d", "k", "part", "mask").agg(F.count("*").alias("n")))
    first = rows.groupBy("d").agg(F.min("k").alias("k")).filter("k is not null").withColumn("first", F.lit(True))
    rows = rows.join(first, ["d", "k"], "left")
    copy = F.when(F.col("first").isNull() & F.col("k").isNotNull(), 16).otherwise(0)
    rows = rows.groupBy("k", "part", (F.col("mask") + copy).alias("mask")).agg(F.sum("n").alias("n"))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    met = rows.filter("k is not null").join(marks, "k", "left").drop("k")
    met = met.unionByName(rows.filter("k is null").select("part", "mask", "n", F.lit(0).alias("q"), F.lit(0).alias("t")))
    return met.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("q") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("t") == 1, F.col("n")).otherwise(0)).alias("toxic"))


def steps(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """600 structs of one cell, order by order: what its documents meet at each step."""
    none = F.lit(0).cast("long")

    def step(bit: Column, before: Column) -> Column:
        fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
        counts = (
            F.when(~gone & ~fails, n), F.when(~gone & fails, n), F.when(gone & fails, n), F.when(mask == bit, n),
            F.when(~gone & fails, good), F.when(~gone & fails, toxic),
        )
        return F.struct(*[F.coalesce(c, none).alias(name) for name, c in zip(COUNTS, counts, strict=True)])

    bits = F.lit([[1 << LETTERS.index(f) for f in order] for order in ORDERS])
    before = lambda order, i: F.aggregate(F.slice(order, 1, i), F.lit(0), lambda seen, b: seen.bitwiseOR(b))
    return F.flatten(F.transform(bits, lambda order: F.transform(order, lambda b, i: step(b, before(order, i)))))


def merged(cells: Column) -> Column:
    """The elementwise sum of arrays of 600 structs."""
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(LETTERS))
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    return F.aggregate(cells, zero, lambda a, x: F.zip_with(a, x, add))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included."""
    cells = masked(docs, labels, key, text, part)
    folds = cells.select("part", steps(*[F.col(c) for c in ("mask", "n", "good", "toxic")]).alias("steps"))
    whole_part = folds.groupBy("part").agg(F.collect_list("steps").alias("cells")).select("part", merged(F.col("cells")).alias("all"))
    at = F.lit([LETTERS.index(f) for order in ORDERS for f in order])
    share = lambda f: F.aggregate(F.zip_with("all", at, lambda x, i: F.when(i == f, x["removed"]).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = whole_part.withColumn("shares", F.array(*[share(f) for f in range(len(LETTERS))]))
    rows = rows.select("part", "shares", F.posexplode("all").alias("i", "x"))
    order = F.get(F.lit(ORDERS), F.floor(F.col("i") / len(LETTERS)).cast("int"))
    return rows.select("part", order.alias("filter_order"), (F.col("i") % len(LETTERS) + 1).cast("int").alias("step"), "x.*", F.get("shares", F.get(at, F.col("i"))).alias("shapley"))
