"""Benchmark decontamination by spaced seeds.

Words are lower-cased and cut at everything that is no letter or digit. A
mask such as 11011 picks some of the words below it; a seed is the
hash of the picked words, so a changed word at an ignored place changes
nothing. Seeds of the benchmark and of the documents are joined on equality.
Around each hit the item is laid over the document, and the words are compared
over every run of ``window`` item words with the hit in it (the whole item, if
shorter): it counts if at least ``least`` of one run's words are equal.
Everything is DataFrame work.

No pattern of changed words up to a fifth escapes the seeds: of n words at most
n // 5 are changed, so of their n // 5 blocks of five one has a single change or
none. At an end of the block it leaves 1111, inside it one of the other
``LIGHT`` masks. Fewer than five words may have no change. Inserted or dropped
words shift the item; each side of them has to reach ``least`` by itself.

The seeds of the benchmark are broadcast up to ``max_broadcast`` of them,
counted first; beyond that the seeds are joined by shuffle and the documents'
words are fetched for the hits alone. Both ways give the same rows.

Null and wordless texts on either side have no overlap. Items of fewer than five
words are compared whole, as runs of their own words. Equal items are compared
once and reported under the smallest item_id with their number; items without
item_id are left out. Documents count once for each (key, item): those that repeat a key, and all those without key, whose
rows have a null key, stand together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, whole

# 8 of 13 words each; every word but the outermost is ignored by one mask at least.
MASKS = ("1101100110101", "1010111001011", "1110010101011")
SPAN = len(MASKS[0])
# Find every overlap of a fifth of changed words; where more may be changed, ``MASKS`` are searched too.
LIGHT = ("1111", "10111", "11011", "11101")
BLOCK, SHORTEST = 5, 4
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), NOT_A_WORD), ""), lambda w: F.xxhash64(w))


def seeds(h: Column, at: Column, masks: tuple[str, ...]) -> list[Column]:
    """One hash for each mask over the words from ``at`` (0-based), null where it doesn't fit; masks are told apart by a number."""
    seed = lambda k, mask: F.xxhash64(F.lit(k), *[F.get(h, at + i) for i, c in enumerate(mask) if c == "1"])
    return [F.when(at + len(mask) <= F.size(h), seed(k, mask)) for k, mask in enumerate(masks)]


def starts(h: Column) -> Column:
    """Where the shortest mask fits wholly."""
    return F.when(F.size(h) >= SHORTEST, F.sequence(F.lit(0), F.size(h) - SHORTEST))


def prepared(items: DataFrame, item: str, text: str) -> DataFrame:
    """item_id, n_items and hashes of each different item with words."""
    rows = items.select(F.col(item).alias("item_id"), word_hashes(whole(text)).alias("words")).filter("item_id is not null")
    return rows.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items")).filter(F.size("words") > 0)


def item_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    n = F.size("words")
    rows = items.filter(n >= BLOCK).select("item_id", "words", n.alias("n"), F.explode(starts(F.col("words"))).alias("j"))
    return rows.select("item_id", "n", "j", F.explode(F.array(*seeds(F.col("words"), F.col("j"), masks))).alias("seed")).filter("seed is not null")


def equal_words() -> Column:
    """For each item word of the runs around the hit, 1 if the document's is equal."""
    k = F.sequence(F.lit(0), F.col("reach") - 1)
    return F.transform(k, lambda i: F.coalesce(F.get("cut", i + F.col("skip")) == F.get("words", F.col("from") + i), F.lit(False)).cast("int"))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda a, x: a + x)


def judged(hits: DataFrame, items: DataFrame, window: int, least: float) -> DataFrame:
    """Hits (_key, h, i, item_id, n, j) with a run of enough equal words: a and b around all such runs, share of the best."""
    width = F.least(F.lit(window), F.col("n"))
    first = F.greatest(F.lit(0), F.least(F.col("j") + SHORTEST, F.col("n")) - width)
    last = F.least(F.col("j"), F.col("n") - width)
    placed = hits.select("_key", "item_id", "h", (F.col("i") - F.col("j") + first).alias("lead"), first.alias("from"), width.alias("width"), (F.greatest(first, last) - first + width).alias("reach"))
    # what lies before the document's first word can't be equal
    cut = F.slice("h", F.greatest(F.col("lead"), F.lit(0)) + 1, F.col("reach"))
    placed = placed.select("_key", "item_id", "lead", "from", "width", "reach", cut.alias("cut"), F.least(F.col("lead"), F.lit(0)).alias("skip"))
    need = F.ceil(F.lit(least) * F.col("width"))
    placed = placed.join(items, "item_id").withColumn("same", equal_words()).filter(total(F.col("same")) >= need)
    run = lambda k: F.struct(total(F.slice("same", k + 1, F.col("width"))).alias("equal"), k.alias("k"))
    runs = F.filter(F.transform(F.sequence(F.lit(0), F.col("reach") - F.col("width")), run), lambda r: r["equal"] >= need)
    placed = placed.withColumn("runs", runs).filter(F.size("runs") > 0)
    a, b = F.col("lead") + F.array_min("runs.k"), F.col("lead") + F.array_max("runs.k") + F.col("width")
    return placed.select("_key", "item_id", "n_items", a.alias("a"), b.alias("b"), (F.array_max("runs.equal") / F.col("width")).alias("share"))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 20,
    least: float = 0.8,
    max_broadcast: int = 500_000,
) -> DataFrame:
    """One row for each (key, item_id) that overlap: n_items, hits, first_word, last_word (of the runs), best (equal share)."""
    items = prepared(benchmark, item, item_text)
    masks = LIGHT if least >= 0.8 else LIGHT + MASKS
    n_seeds = items.select(F.sum(F.greatest(F.size("words") - SHORTEST + 1, F.lit(0))) * len(masks)).first()[0] or 0
    rows = docs.select(F.col(key).alias("_key"), word_hashes(whole(text)).alias("h"))
    at = rows.select("_key", "h", F.explode(starts(F.col("h"))).alias("i"))
    seed = F.explode(F.array(*seeds(F.col("h"), F.col("i"), masks))).alias("seed")
    bench = item_seeds(items, masks)
    if n_seeds <= max_broadcast:
        hits = at.select("_key", "h", "i", seed).join(F.broadcast(bench), "seed")
    else:
        met = at.select("_key", F.xxhash64("h").alias("_t"), "i", seed).join(bench, "seed").select("_key", "_t", "i", "item_id", "n", "j").distinct()
        own = rows.select(F.col("_key").alias("_own"), "h")  # a key may stand on many texts
        hits = met.join(own, F.col("_key").eqNullSafe(F.col("_own")) & (F.col("_t") == F.xxhash64("h"))).drop("_own", "_t")
    every = judged(hits, items, window, least)
    for part in short_overlaps(rows, items):
        every = every.unionByName(part)
    found = every.groupBy("_key", "item_id").agg(
        F.first("n_items").alias("n_items"), F.count("*").alias("hits"), F.min("a").alias("first_word"), F.max("b").alias("last_word"), F.max("share").alias("best")
    )
    return found.withColumnRenamed("_key", key)


def short_overlaps(rows: DataFrame, items: DataFrame) -> list[DataFrame]:
    """Items shorter than a block, by length: their exact runs. Nothing is read where there is none."""
    few, out = items.filter(F.size("words") < BLOCK), []
    for n in sorted(r[0] for r in few.select(F.size("words")).distinct().collect()):  # below BLOCK each
        run = F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n))
        own = rows.select("_key", "h", F.explode(run).alias("a")).select("_key", "a", F.xxhash64(F.slice("h", F.col("a") + 1, F.lit(n))).alias("x"))
        met = own.join(few.filter(F.size("words") == n).withColumn("x", F.xxhash64("words")), "x")
        out.append(met.select("_key", "item_id", "n_items", "a", (F.col("a") + n).alias("b"), F.lit(1.0).alias("share")))
    return out


def without_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs`` whose text overlaps no item, whatever their key."""
    d = free_name(docs, "_d")
    named = docs.withColumn(d, F.md5(whole(text).cast("binary")))
    texts = named.select(F.col(d).alias("text_md5"), F.col(text).alias("text"))
    found = overlaps(texts, benchmark, "text_md5", "text", **options).select(F.col("text_md5").alias(d)).distinct()
    return named.join(found, d, "left_anti").select(docs.columns)
