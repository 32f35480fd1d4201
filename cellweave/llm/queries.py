"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, filter_audit, line_chunks, minhash, mixing, neighbours, pii, ppm, quality, secrets, sharding, toxicity
from .common import fold, read, whole

#: Offsets and counts of the base kinds go into a digest that any engine can recompute.
ORACLE: dict[str, str] = {}


def op1_spaced_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.overlaps(docs, read(spark, sf_dir, "benchmark"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 7) == 2
    scored = ppm.score_texts(docs.withColumn("held_out", held_out), ~held_out)
    return scored.select("doc_id", "held_out", *ppm.RESULTS)


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.train(docs))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    kind = lambda x: F.get(F.array(*[F.lit(k) for k in pii.KINDS]), x["kind"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(text("base_spans"), 256).alias("base_sha256"), text("pii_spans").alias("spans"))


def op4_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.labelled_samples(docs))
    found = secrets.scan_secrets(docs, model)
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.joined(F.col("secret_spans")).alias("spans"),
    )


#: Token weights of the languages.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def op6_soft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rates, model = mixing.mixture(docs, read(spark, sf_dir, "labels").select("doc_id"), TARGETS)
    named = [F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rates.select("doc_id", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_"), "n_tokens", *named, "rate").drop("_")


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.without_repeated_chunks(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.md5(F.col("clean").cast("binary"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", F.length("clean").cast("long").alias("clean_chars"), digest.alias("clean_md5"))


ORACLE["op7_line_chunks"] = """
WITH l AS (SELECT doc_id, i, x, ('0x' || substr(md5(x), 1, 8))::BIGINT AS h FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
r AS (SELECT *, ((coalesce(lag(h, 2) OVER w, 0) * 66049 + coalesce(lag(h, 1) OVER w, 0) * 257 + h) % 2147483647) % 4 = 0 AS ends FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM r),
c AS (SELECT doc_id, place, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS body FROM p GROUP BY doc_id, place),
g AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, place) > 1 AND n >= 2 AS gone FROM c)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  length(coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (NOT gone), ''))::BIGINT AS clean_chars,
  md5(coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS clean_md5
FROM g GROUP BY doc_id
"""


def op8_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    out = quality.quality_filter(docs, trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "threshold")


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "class_id", "class_md5")


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    small = docs.select("doc_id", F.crc32(whole("text").cast("binary")).alias("text_crc32"), F.octet_length(whole("text")).alias("bytes"))
    out = sharding.shards(small, F.col("bytes").cast("long") + sharding.OVERHEAD)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = lambda c: fold(c, 4) == 2
    trained = toxicity.train(docs, labels, ~held_out("doc_id"))
    out = toxicity.score_toxicity(docs, trained, ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "flagged")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    return filter_audit.audit(docs, labels)


ORACLE["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
m AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS e, coalesce(d.doc_id > s.least, false) AS f, coalesce(q, 0) AS good, coalesce(x, 0) AS toxic FROM d JOIN s USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, a, b, c, e, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT k1.x || k2.x || k3.x || k4.x || k5.x AS o FROM k k1, k k2, k k3, k k4, k k5 WHERE len(list_distinct([k1.x, k2.x, k3.x, k4.x, k5.x])) = 5),
st AS (SELECT o AS filter_order, i AS step, substr(o, i, 1) AS letter, substr(o, 1, i - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
z AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN e THEN 'D' ELSE '' END || CASE WHEN f THEN 'E' ELSE '' END AS fails, n, good, toxic FROM g),
r AS (SELECT part, filter_order, step, letter, contains(fails, letter) AS here, length(translate(before, fails, '')) < length(before) AS gone, fails = letter AS only_this, n, good, toxic FROM z, st),
u AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_this), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM u
"""


def op12_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = lambda c: fold(c, 5) == 0
    out = neighbours.score_quality(docs, neighbours.train(docs, labels, ~held_out("doc_id")), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): rows with the faults that the checksum of their key deals out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = fold(F.concat(text("conv_id"), F.lit(":"), text("turn")), 20)
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), (F.col("kind") != 0).alias("present"), copies).drop("_")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversations.repair(damaged(read(spark, sf_dir, "conversations")), present=F.col("present"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


def crc32_sql(text: str) -> str:
    """SQL for the checksum of an ASCII text, half a byte at a time; the 16 values follow from the polynomial."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    half = lambda c, b: f"xor(list_extract({table}::BIGINT[], (xor({c}, {b}) & 15)::INT + 1), {c} >> 4)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)), lambda c, b: {half(half('c', 'b'), '(b >> 4)')}), 4294967295::BIGINT)"


# Places of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a pair. Best edits from each row on, last row first.
ORACLE["op13_conversation_repair"] = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT *, {crc32_sql("k")} % 20 AS kind FROM o),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM z WHERE kind <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  substr(role, 1, 1) AS ini, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
r AS (SELECT conv_id, turn, role, text, i, ini, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)) AS t(p, letters, q)),
nxt AS (SELECT * FROM (VALUES (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) AS t(q, q2, want)),
y AS (SELECT conv_id, i, q, 'D' AS x, 4 AS c, q AS q2 FROM r, nxt UNION ALL SELECT conv_id, i, q, 'R', 3 + cut::INT * 3, q2 FROM r, nxt WHERE NOT blank AND NOT dup
  UNION ALL SELECT conv_id, i, q, 'K', cut::INT * 3, q2 FROM r, nxt WHERE NOT blank AND NOT dup AND ini = want UNION ALL SELECT conv_id, i, 0, 'K', cut::INT * 3, 1 FROM r WHERE NOT blank AND NOT dup AND ini = 's'),
e AS (SELECT conv_id, i, p, letters || x AS letters, c + 3 * length(letters) AS cost, q2 FROM ins JOIN y USING (q)),
b AS (SELECT conv_id, n + 1 AS i, p, {{'c': 3 * length(letters), 'a': letters}} AS v FROM s, (SELECT p, min(letters) AS letters FROM ins WHERE q IN (0, 3) GROUP BY p) UNION ALL
  SELECT e.conv_id, e.i, e.p, min({{'c': e.cost + b.v.c, 'a': e.letters || b.v.a}}) AS v FROM b JOIN e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i - 1 AND e.q2 = b.p GROUP BY e.conv_id, e.i, e.p),
w AS (SELECT conv_id, v.c AS cost, v.a AS audit FROM b WHERE i = 1 AND p = 0),
l AS (SELECT conv_id, audit, generate_subscripts(string_split(audit, ''), 1) AS k, unnest(string_split(audit, '')) AS x FROM w WHERE audit <> ''),
m AS (SELECT *, sum((x <> 'I')::INT) OVER a AS i, sum((x <> 'D')::INT) OVER a AS place, sum((x <> 'D')::INT) OVER (PARTITION BY conv_id) % 2 AS odd FROM l WINDOW a AS (PARTITION BY conv_id ORDER BY k)),
t AS (SELECT m.conv_id, string_agg(CASE WHEN x = 'K' THEN r.role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY place) AS body
  FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i WHERE x <> 'D' GROUP BY m.conv_id)
SELECT a.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
  coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(w.cost, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seed": op1_spaced_seed,
    "op2_ppm": op2_ppm,
    "op3_skip_chain_pii": op3_skip_chain_pii,
    "op4_secret_markov": op4_secret_markov,
    "op5_dart_minhash": op5_dart_minhash,
    "op6_soft_mixture": op6_soft_mixture,
    "op7_line_chunks": op7_line_chunks,
    "op8_quality_llr": op8_quality_llr,
    "op9_sampled_splitters": op9_sampled_splitters,
    "op10_toxicity_cnn": op10_toxicity_cnn,
    "op11_filter_audit": op11_filter_audit,
    "op12_neighbour_quality": op12_neighbour_quality,
    "op13_conversation_repair": op13_conversation_repair,
}
