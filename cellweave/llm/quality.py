"""Quality rules: hashed n-gram log-likelihood ratio, and the plain text rules before it.

The score of a text is the mean, over its words and word pairs, of
log P_target(bucket) - log P_raw(bucket). Both are multinomials over the same
hashed buckets with add-one smoothing: P_raw from every text given, P_target
from the trusted texts. All of it is DataFrame work; the two count vectors
are as long as ``buckets``, whatever the input.

Nulls count as empty texts, which have no words, score 0 and fail the base
rule of at least 50 words. Repeated rows are rows like others. All columns given
are kept; a result whose name is taken gets an underscore at its end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, constant_array, let, neutral, restored, stored, whole, words

#: 40 bits of hash above 24 bits of position.
POSITION_BITS = 24
SYMBOLS = "#*$%&|<>"


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def with_text_rules(docs: DataFrame, text: str = "text", hash_bits: int = 40) -> DataFrame:
    """Adds ``RULES``. A result whose name is taken gets an underscore at its end."""
    return restored(ruled(docs, text, hash_bits), docs.columns, RULES)


def ruled(docs: DataFrame, text: str, hash_bits: int = 40) -> DataFrame:
    """The columns as c0, c1, ..., the words as ``words``, and the rules as r_*.

    Repeated windows are found by sorting (hash, position) pairs packed in one
    long and by comparing the words of neighbours with equal hashes. Where two
    different windows of a text share a hash, or it has more words than
    positions have bits for, its windows themselves are sorted: the count is
    exact for every text.
    """
    position = (1 << POSITION_BITS) - 1
    w, s = F.col("words"), F.col("sorted")
    at = lambda x: x.bitwiseAND(F.lit(position)).cast("int")
    three = lambda i: [F.get(w, i + k) for k in range(3)]

    def packed(i: Column) -> Column:
        h = F.xxhash64(*three(i)).bitwiseAND(F.lit((1 << hash_bits) - 1))
        return F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("long"))

    def same_hash(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS), F.lit(False))

    def same_words(x: Column, y: Column) -> Column:
        equal = [a.eqNullSafe(b) for a, b in zip(three(at(x)), three(at(y)), strict=True)]
        return equal[0] & equal[1] & equal[2]

    def same(x: Column, y: Column) -> Column:
        return same_hash(x, y) & same_words(x, y)

    fast = F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), at)
    clash = F.size(F.filter(s, lambda x, i: same_hash(x, F.get(s, i + 1)) & ~same_words(x, F.get(s, i + 1)))) > 0
    n = F.size("words")
    positions = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    whole_windows = F.sort_array(F.transform(positions, lambda i: F.struct(*[x.alias(f"w{k}") for k, x in enumerate(three(i))], i.alias("at"))))
    alike = lambda x, y: F.coalesce((x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]), F.lit(False))
    beside = lambda ws: lambda x, i: alike(x, F.get(ws, i - 1)) | alike(x, F.get(ws, i + 1))
    exact = let(whole_windows, lambda ws: F.transform(F.filter(ws, beside(ws)), lambda x: x["at"]))
    starts = F.sort_array(F.when((n > position) | clash, exact).otherwise(fast))
    none = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        starts,
        none,
        lambda a, p: F.struct((p + 3).cast("long").alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    with_word = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = neutral(docs).withColumn("text", whole(f"c{docs.columns.index(text)}"))
    out = out.withColumn("words", words(F.col("text")))
    out = (
        out.withColumn("sorted", F.sort_array(F.transform(positions, packed)))
        .withColumn("lines", with_word)
        .withColumn("r_n_words", n.cast("long"))
        .withColumn("r_word_chars", F.length(F.translate("text", SPACES, "")).cast("long"))
        .withColumn("r_n_symbols", (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"))
        .withColumn("r_n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("r_n_repeat_words", covered)
    )
    failed = (F.col("r_n_words") < 50) | (100 * F.col("r_n_repeat_words") > 50 * F.col("r_n_words"))
    return out.withColumn("r_base_failed", failed).drop("text", "sorted", "lines")


def bucket(n: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(n)).cast("int")


def log_ratios(raw: DataFrame, trusted: Column, text: str = "text", buckets: int = 16384) -> list[float]:
    """log P_target - log P_raw by bucket; ``trusted`` marks the target's rows among ``raw``."""
    w = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1))
    rows = raw.select(words(whole(text)).alias("_w"), F.coalesce(trusted, F.lit(False)).alias("_t"))
    rows = rows.select("_t", "_w", F.explode(w).alias("_i"))
    one = bucket(buckets, F.get("_w", F.col("_i")))
    two = bucket(buckets, F.get("_w", F.col("_i")), F.get("_w", F.col("_i") + 1))
    rows = rows.select("_t", one.alias("_one"), two.alias("_two")).select("_t", F.explode(F.array("_one", "_two")).alias("_b"))
    counts = rows.groupBy("_b").agg(F.count("*").alias("n"), F.sum(F.col("_t").cast("long")).alias("t")).collect()
    n, t = [1] * buckets, [1] * buckets  # one row for each bucket at most
    for r in counts:
        n[r["_b"]] += r["n"]
        t[r["_b"]] += r["t"]
    log_n, log_t = math.log(sum(n)), math.log(sum(t))
    return [math.log(b) - log_t - math.log(a) + log_n for a, b in zip(n, t, strict=True)]


def score(w: Column, ratios: list[float]) -> Column:
    """The mean log ratio of a text's words and word pairs; 0 without words."""
    table, n = constant_array(ratios), len(ratios)

    def of(x: Column, i: Column) -> Column:
        return F.get(table, bucket(n, x)) + F.get(table, bucket(n, x, F.get(w, i + 1)))

    total = F.aggregate(F.transform(w, of), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(w) > 0, total / (2 * F.size(w))).otherwise(0.0)


def at_share(values: DataFrame, share: float) -> float | None:
    """The percentile of a column v, linear between ranks as Spark's own; None without values.

    Different values are counted into sampled ranges and only a range that holds a wanted rank is sorted, so no
    task or driver holds all values.
    """
    counted = values.filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    counted = stored(counted.repartitionByRange("v").withColumn("r", F.spark_partition_id()))
    sizes = counted.groupBy("r").agg(F.sum("n").alias("n")).orderBy("r").collect()  # one row for each range
    position = (sum(r["n"] for r in sizes) - 1) * share

    def at(rank: int) -> float:
        before = 0
        for r in sizes:
            if rank < before + r["n"]:
                break
            before += r["n"]
        upto = counted.filter(F.col("r") == r["r"]).select("v", F.sum("n").over(Window.partitionBy("r").orderBy("v")).alias("upto"))
        return upto.filter(F.col("upto") > rank - before).agg(F.min("v")).first()[0]

    if not sizes:
        return None
    low, high = at(math.floor(position)), at(math.ceil(position))
    return low if low == high else (math.ceil(position) - position) * low + (position - math.floor(position)) * high


def quality_filter(
    docs: DataFrame,
    trusted_keys: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    buckets: int = 16384,
    pass_share: float = 0.995,
    max_broadcast: int = 500_000,
) -> DataFrame:
    """Text rules, llr, threshold and kept for every row.

    ``trusted_keys`` lists keys of good texts. All of them count, up to
    ``max_broadcast`` by a broadcast and more by a shuffle. The threshold is
    the llr that ``pass_share`` of the trusted texts reach that the base rules
    pass (-infinity without any), so the same input always gives the same one.
    """
    k, t, mark = f"c{docs.columns.index(key)}", f"c{docs.columns.index(text)}", f"c{len(docs.columns)}"
    trusted = stored(trusted_keys.select(F.col(key).alias("trusted_key")).filter("trusted_key is not null").distinct())
    few = trusted.count() <= max_broadcast
    flags = trusted.withColumn(mark, F.lit(True)).hint("broadcast" if few else "merge")
    rows = neutral(docs)
    rows = rows.join(flags, F.col(k) == F.col("trusted_key"), "left").drop("trusted_key")
    rows = rows if few else stored(rows)
    ratios = log_ratios(rows, F.col(mark), t, buckets)
    # every text is scored once: the threshold comes from what is written
    scored = stored(ruled(rows, t).withColumn("r_llr", score(F.col("words"), ratios)).drop("words"))
    low = at_share(scored.filter(F.col(mark) & ~F.col("r_base_failed")).select(F.col("r_llr").alias("v")), 1 - pass_share)
    threshold = float("-inf") if low is None else low
    kept = ~F.col("r_base_failed") & (F.col("r_llr") >= threshold)
    out = scored.withColumn("r_threshold", F.lit(threshold)).withColumn("r_kept", kept)
    return restored(out, docs.columns, (*RULES, "llr", "threshold", "kept"))
