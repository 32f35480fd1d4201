"""Line dedup by content-defined chunks.

A rolling hash over the hashes of three consecutive lines ends a chunk after
the last of them when it is divisible by ``average``, so an inserted line
moves only boundaries next to it. A chunk of two or more lines that occurs
anywhere else is removed everywhere but at its first occurrence, by (key,
place in the document), after its text has been compared with that one's byte
by byte. Everything is DataFrame work; texts travel only for chunks whose
digest occurs more than once.

A document is its key, of any type, and its text: rows that agree in both are one document and get equal results, and rows
that share a key, or have none, are told apart by their texts' MD5. The first occurrence is that of the
smallest key (a null sorts last), of equal keys that of the smaller MD5, of one document the first place. Nulls count as
empty texts, which have one empty line. Removed chunks take their line breaks with them. An empty table gives no rows.

A chunk that many documents share never meets in one task with its texts: its smallest occurrence is a partial minimum, and a copy of
the original goes to each part of ``part_rows`` occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole

MODULUS, B1, B2 = 2147483647, 257, 66049


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def with_chunks(docs: DataFrame, key: str, text: str, average: int) -> DataFrame:
    """_k, _h, and _chunks: array of (place, n_lines, body) in order."""
    rows = docs.select(F.col(key).alias("_k"), F.md5(whole(text).cast("binary")).alias("_h"), F.split(whole(text), "\n", -1).alias("_l"))
    rows = rows.withColumn("_x", F.transform("_l", line_hash))
    zero = F.lit(0).cast("long")
    at = lambda i: F.coalesce(F.get("_x", i), zero)
    ends = lambda i: F.pmod(F.pmod(at(i - 2) * B2 + at(i - 1) * B1 + at(i), F.lit(MODULUS)), F.lit(average)) == 0
    starts = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: (i == 0) | ends(i - 1))
    rows = rows.select("_k", "_h", "_l", starts.alias("_s"))

    def chunk(s: Column, k: Column) -> Column:
        n = F.coalesce(F.get("_s", k + 1), F.size("_l")) - s
        return F.struct(k.alias("place"), n.alias("n_lines"), F.array_join(F.slice("_l", s + 1, n), "\n").alias("body"))

    return rows.select("_k", "_h", F.transform("_s", chunk).alias("_chunks"))


def repeated_chunks(chunked: DataFrame, part_rows: int = 2000) -> DataFrame:
    """(_k, _h, _gone): the places of the chunks to remove, for documents that have some."""
    many = chunked.select("_k", "_h", F.explode(F.filter("_chunks", lambda c: c["n_lines"] >= 2)).alias("c"))
    many = many.select("_k", "_h", F.col("c.place").alias("place"), F.col("c.body").alias("body"), F.md5(F.col("c.body").cast("binary")).alias("digest"))
    place = F.struct(F.col("_k").isNull().alias("none"), "_k", "_h", "place")
    first = many.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.ceil(F.count("*") / part_rows).alias("parts")).filter("first <> last").drop("last")
    first = stored(first)  # read again, both sides of the join come from a shuffle, which Spark can split where a chunk is common
    part = F.pmod(F.xxhash64("_k", "_h", "place"), F.col("parts"))
    members = stored(many.join(first.hint("merge"), "digest").select("digest", "_k", "_h", "place", "body", "parts", part.alias("part"), (place == F.col("first")).alias("is_first")))
    original = members.filter("is_first").groupBy("digest").agg(F.min("body").alias("original"), F.first("parts").alias("parts"))
    original = original.select("digest", "original", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    gone = members.filter("not is_first").join(original, ["digest", "part"]).filter(F.col("body") == F.col("original"))
    return gone.groupBy("_k", "_h").agg(F.collect_set("place").alias("_gone"))


def without_repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", average: int = 4) -> DataFrame:
    """For every row: key, n_lines, n_chunks, n_removed_lines, clean (the text that is left)."""
    chunked = with_chunks(docs, key, text, average)
    gone = repeated_chunks(chunked).toDF("_gk", "_gh", "_gone")
    out = chunked.join(gone, (F.col("_h") == F.col("_gh")) & F.col("_k").eqNullSafe(F.col("_gk")), "left")
    places = F.sequence(F.lit(0), F.size("_chunks") - 1)
    stays = F.when(F.col("_gone").isNull(), F.col("_chunks")).otherwise(F.transform(F.array_except(places, F.col("_gone")), lambda i: F.get("_chunks", i)))
    lines = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["n_lines"]).cast("long")
    out = out.withColumn("_stays", stays)
    return out.select(
        F.col("_k").alias(key),
        lines(F.col("_chunks")).alias("n_lines"),
        F.size("_chunks").cast("long").alias("n_chunks"),
        (lines(F.col("_chunks")) - lines(F.col("_stays"))).alias("n_removed_lines"),
        F.array_join(F.transform("_stays", lambda c: c["body"]), "\n").alias("clean"),
    )
