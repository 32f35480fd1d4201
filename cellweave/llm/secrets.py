"""Secret scans: fixed patterns, and two character Markov models told apart by likelihood.

Fixed patterns give the spans of kinds assign, access and hex. Any other run
of 12 or more key characters is scored by the log-likelihood ratio of two
first-order character models, one of random strings and one of ordinary
identifiers, and becomes a span of kind random if the run as a whole beats odds
of a million to one and its characters on average the threshold that one in
10,000 of the ordinary strings passes, found on strings no model was counted
from. All of it is DataFrame work in the row of the text; the models are
95 x 95 tables.

The labelled strings: values of base spans and strings of four alphabets and
12 to 40 characters made from the keys' digests are random; words, pairs of
words joined to one name, and numbers are ordinary.

Nulls count as empty texts without spans. Offsets are code points, the end is
exclusive. Rows and columns given are kept, repeated rows too. Without labelled
strings of both kinds no random span is found.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import constant_array, let, neutral, restored, stored, whole, words

# The patterns of the base kinds, in the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
RUN = r"[A-Za-z0-9+/_=-]{12,}"
SHORTEST = 12
ODDS = math.log(1e6)
SIDE = 95  # printable ASCII
EMPTY = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def found(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Spans of a pattern: the lengths of the matches and of what is between them add up to the offsets.

    Lengths are summed in blocks of about the square root of their number, so
    a text of n matches costs n times that root and not the square.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def spans(m: Column) -> Column:
        size = F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(m["hits"]))).cast("int"))
        lengths = F.transform(m["hits"], lambda h, i: F.length(F.get(m["gaps"], i)) + F.length(h))
        blocks = let(lengths, lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_), size), lambda at: F.slice(all_, at, size)))
        return let(F.struct(blocks.alias("blocks"), size.alias("size")), lambda x: placed(m, x["blocks"], x["size"]))

    def placed(m: Column, blocks: Column, size: Column) -> Column:
        def of_block(block: Column, b: Column, begin: Column) -> Column:
            start = F.transform(block, lambda _, i: begin + total(F.slice(block, 1, i)) + F.length(F.get(m["gaps"], b * size + i)))
            return F.transform(start, lambda at, i: span(at, F.get(m["hits"], b * size + i)))

        def span(at: Column, hit: Column) -> Column:
            value = F.regexp_extract(hit, pattern, group) if group else hit
            return F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(hit)).alias("end"), value.alias("value"))

        begins = let(F.transform(blocks, total), lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, 1, b))))
        return let(begins, lambda all_: F.flatten(F.transform(blocks, lambda block, b: of_block(block, b, F.get(all_, b)))))

    some = let(F.struct(hits.alias("hits"), gaps.alias("gaps")), spans)
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(EMPTY))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind."""
    assign = F.filter(found(text, ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= 8)
    return F.sort_array(F.concat(assign, found(text, ACCESS, 1), found(text, HEX, 2)))


def joined(spans: Column) -> Column:
    name = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def codes(value: Column) -> Column:
    """The characters of a string as 0 to 94; what isn't printable ASCII counts as 0."""
    code = lambda c: F.when(F.ascii(c).between(32, 126), F.ascii(c) - 32).otherwise(0)
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), code)


def pair_counts(values: DataFrame, value: str) -> list[int]:
    c = values.select(codes(F.col(value)).alias("_c"))
    pairs = c.select("_c", F.explode(F.when(F.size("_c") > 1, F.sequence(F.lit(0), F.size("_c") - 2))).alias("_i")).select((F.get("_c", F.col("_i")) * SIDE + F.get("_c", F.col("_i") + 1)).alias("_p"))
    out = [0] * (SIDE * SIDE)
    for r in pairs.groupBy("_p").count().collect():  # one row for each pair at most
        out[r["_p"]] = r["count"]
    return out


class Model(NamedTuple):
    ratios: list[float]  # log P(next | previous, random) - log P(next | previous, ordinary) for each pair of characters
    per_char: float


SILENT = Model([0.0] * (SIDE * SIDE), math.inf)


def train(labelled: DataFrame, passing: float = 1e-4) -> Model:
    """From (value, is_random): add-half smoothed models of four fifths of the strings, the threshold from the rest."""
    held = F.pmod(F.xxhash64("value", F.lit(7)), F.lit(5)) == 0
    counts = [pair_counts(labelled.filter(F.col("is_random") == kind).filter(~held), "value") for kind in (True, False)]
    if not all(map(sum, counts)):
        return SILENT
    logs = []
    for n in counts:
        rows = [sum(n[a * SIDE : a * SIDE + SIDE]) for a in range(SIDE)]
        logs.append([math.log((n[i] + 0.5) / (rows[i // SIDE] + 0.5 * SIDE)) for i in range(SIDE * SIDE)])
    ratios = [a - b for a, b in zip(*logs, strict=True)]
    ordinary = labelled.filter(~F.col("is_random")).filter(held).filter(F.length("value") >= SHORTEST).select((ratio(F.col("value"), ratios) / F.length("value")).alias("r"))
    high = ordinary.agg(F.percentile("r", F.lit(1 - passing)).alias("r")).first()["r"]
    return Model(ratios, max(0.5, high or 0.0))


def ratio(value: Column, model: list[float]) -> Column:
    table = constant_array(model)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        more = F.when(a["last"] >= 0, F.get(table, a["last"] * SIDE + c)).otherwise(0.0)
        return F.struct(c.alias("last"), (a["sum"] + more).alias("sum"))

    return F.aggregate(codes(value), start, step, lambda a: a["sum"])


def touches(spans: Column, x: Column) -> Column:
    """Whether one of the spans, which are sorted and apart, overlaps x; halves the spans until the last that begins before x ends."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    zero = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        before = (a["low"] < a["high"]) & (F.get(spans, middle)["start"] < x["end"])
        return F.struct(F.when(before, middle + 1).otherwise(a["low"]).alias("low"), F.when(before, a["high"]).otherwise(F.least(middle, a["high"])).alias("high"))

    last = F.aggregate(steps, zero, halve, lambda a: a["low"] - 1)
    return F.coalesce(let(last, lambda i: (i >= 0) & (F.get(spans, F.greatest(i, F.lit(0)))["end"] > x["start"])), F.lit(False))


def random_spans(text: Column, base: Column, model: Model, few: int = 16) -> Column:
    """Runs that touch no base span and that the random model explains better."""
    speaks = lambda x: ratio(x["value"], model.ratios) >= F.greatest(F.lit(ODDS), F.lit(model.per_char) * F.length(x["value"]))
    runs = found(text, RUN, 3)
    near = F.filter(runs, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    of_kind = lambda k: F.filter(base, lambda b: b["kind"] == k).alias(f"k{k}")
    kinds = F.struct(*[of_kind(k) for k in range(3)])
    far = let(kinds, lambda by: F.filter(runs, lambda x: ~(touches(by["k0"], x) | touches(by["k1"], x) | touches(by["k2"], x))))
    return F.filter(F.when(F.size(base) <= few, near).otherwise(far), speaks)


def made_strings(key: Column) -> tuple[Column, Column]:
    """Random strings and a number from the digests of a key."""
    digest = lambda i: F.sha2(F.concat_ws(":", F.lit(i), key.cast("string")), 256)
    coded = lambda i: F.base64(F.unhex(digest(i)))
    cut = lambda c, i: c.substr(F.lit(1), (SHORTEST + F.pmod(F.xxhash64(key, F.lit(i)), F.lit(29))).cast("int"))
    letters = lambda i: F.translate(coded(i), "+/=", "aB")
    return F.array(cut(digest(1), 1), cut(F.upper(digest(2)), 2), cut(F.translate(coded(3), "=", ""), 3), cut(letters(4), 4), cut(F.upper(letters(5)), 5)), F.array(cut(F.translate(digest(6), "abcdef", "012345"), 6))


def labelled_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = 5000) -> DataFrame:
    """(value, is_random) from the ``max_docs`` keys with the smallest hashes, one text of each."""
    rows = docs.select(F.col(key).alias("k"), whole(text).alias("t")).filter("k is not null")
    few = F.broadcast(rows.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(max_docs))
    texts = rows.join(few, "k", "left_semi").groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("x"))
    texts = stored(texts.select("k", F.col("x.t").alias("t")).select("k", words(F.col("t")).alias("w"), base_spans(F.col("t")).alias("s")))
    bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", "")
    joined_words = lambda x, i: F.when(i % 10 == 0, F.concat(bare(x), F.initcap(bare(F.get("w", i + 1))))).when(i % 10 == 5, F.concat_ws("_", bare(x), bare(F.get("w", i + 1))))
    plain = texts.filter(F.size("s") == 0)
    made, numbers = made_strings(F.col("k"))
    parts = [
        (texts.select(F.explode("s.value").alias("value")), True),
        (texts.select(F.explode(made).alias("value")), True),
        (plain.select(F.explode("w").alias("value")), False),
        (plain.select(F.explode(F.transform("w", joined_words)).alias("value")), False),
        (texts.select(F.explode(numbers).alias("value")), False),
    ]
    every = [p.select("value", F.lit(kind).alias("is_random")) for p, kind in parts]
    return reduce(DataFrame.unionAll, every).filter(F.length("value") > 1)


def scan_secrets(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds base_spans and secret_spans: arrays of (start, kind, end, value), by start, then kind.

    A result whose name is taken gets an underscore at its end.
    """
    rows = neutral(docs).withColumn("text", whole(f"c{docs.columns.index(text)}"))
    rows = rows.withColumn("r_base_spans", base_spans(F.col("text")))
    more = random_spans(F.col("text"), F.col("r_base_spans"), model)
    return restored(rows.withColumn("r_secret_spans", F.sort_array(F.concat("r_base_spans", more))), docs.columns, ("base_spans", "secret_spans"))
