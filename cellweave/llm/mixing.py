"""Mixing sources to target weights with soft domain membership.

A naive Bayes classifier over hashed words, counted from a table of labelled
texts, gives every text its probabilities of belonging to each domain; the
evidence of a text saturates at ``evidence`` words, which keeps memberships
soft. Rates, one for each document and never below ``least_rate``, are fitted
by projected gradient: every step sums the expected tokens of the domains over
all documents in one aggregation and moves all rates against the gradient of
the squared distance from the targets, scaled by the domains' sizes, then
projects. Only the sums of the domains pass through the driver. All of it is
DataFrame work.

Nulls count as empty texts: no tokens, memberships equal to the shares of the
labels. Rows without domain or text in the labelled table say nothing about
words. Repeated rows get equal rates. Without labelled rows there is one
domain, named unknown.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, held_arrays, stored, whole, words

MAX_DOMAINS = 16


class Classifier(NamedTuple):
    domains: list[str]
    prior: list[float]
    logs: list[list[float]]  # log P(bucket | domain)


def bucket(word: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(n)).cast("int")


def train(labelled: DataFrame, domain: str = "domain", text: str = "text", buckets: int = 4096) -> Classifier:
    """Counts of (domain, bucket): at most ``MAX_DOMAINS`` x ``buckets`` of them reach the driver."""
    rows = labelled.select(F.col(domain).cast("string").alias("d"), whole(text).alias("t")).filter("d is not null")
    sizes = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains = sorted(sizes) or ["unknown"]
    total = sum(sizes.values())
    counts = {d: [1] * buckets for d in domains}
    pairs = rows.select("d", F.explode(words(F.col("t"))).alias("w")).select("d", bucket(F.col("w"), buckets).alias("b"))
    for r in pairs.groupBy("d", "b").agg(F.count("*").alias("n")).collect():
        counts[r["d"]][r["b"]] += r["n"]
    sums = {d: math.log(sum(c)) for d, c in counts.items()}
    return Classifier(domains, [sizes.get(d, 1) / max(1, total) for d in domains], [[math.log(n) - sums[d] for n in counts[d]] for d in domains])


def memberships(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text", evidence: float = 50.0) -> DataFrame:
    """For each different (key, text): text_hash, rows, n_tokens of one of them, and p_0, p_1, ... by domain.

    Means over the words are the same for one row and for several equal ones.
    """
    size, k = len(model.logs[0]), len(model.domains)
    rows = docs.select(F.col(key).alias("_k"), F.xxhash64(whole(text)).alias("_h"), F.explode(F.concat(F.array(F.lit("")), words(whole(text)))).alias("_w"))
    real = F.col("_w") != ""
    rows = rows.select("_k", "_h", real.alias("_real"), bucket(F.col("_w"), size).alias("_b"))
    sums = [F.sum(F.when(F.col("_real"), F.get(logs, F.col("_b")))).alias(f"s_{i}") for i, logs in enumerate(held_arrays(docs.sparkSession, model.logs))]
    grouped = rows.groupBy("_k", "_h").agg(F.sum((~F.col("_real")).cast("long")).alias("rows"), F.count_if("_real").alias("_n"), *sums)
    n = F.col("_n") / F.col("rows")
    weight = n * evidence / (n + evidence)
    logit = [F.coalesce(F.col(f"s_{i}") / F.col("_n") * weight, F.lit(0.0)) + math.log(model.prior[i]) for i in range(k)]
    top = F.greatest(*logit) if k > 1 else logit[0]
    powers = [F.exp(x - top) for x in logit]
    return grouped.select(F.col("_k").alias(key), F.col("_h").alias("text_hash"), "rows", n.cast("long").alias("n_tokens"), *[(p / sum(powers[1:], powers[0])).alias(f"p_{i}") for i, p in enumerate(powers)])


def fit_rates(
    members: DataFrame, model: Classifier, targets: dict[str, float], total: float | None = None, growth: float = 1.0, least_rate: float = 0.0, steps: int = 25, close: float = 1e-4
) -> DataFrame:
    """Adds rate. ``targets``: weights of domains, by share of ``total`` tokens.

    Unless given, ``total`` is ``growth`` times what the domains with a target
    have, or more where one has too much for its weight at ``least_rate``.
    Domains without a target aim at ``least_rate`` and stand beside the total.
    Warns if a domain misses its target by more than a hundredth of the total.
    """
    k = range(len(model.domains))
    p = [F.col(f"p_{i}") for i in k]
    tokens = (F.col("n_tokens") * F.col("rows")).cast("double")
    mass = list(members.agg(*[F.coalesce(F.sum(tokens * x), F.lit(0.0)) for x in p]).first())
    share = [max(0.0, targets.get(d, 0.0)) for d in model.domains]
    if total is None:
        aimed = [(s / sum(share), m) for s, m in zip(share, mass, strict=True) if s]
        total = max([growth * (sum(m for _, m in aimed) if least_rate else sum(mass)), *(least_rate * m / s for s, m in aimed)])
    goal = [(total * s / sum(share) if s else least_rate * m) if sum(share) else m for s, m in zip(share, mass, strict=True)]
    rate, have = F.lit(1.0), mass
    for _ in range(steps):
        gap = [g - h for g, h in zip(goal, have, strict=True)]
        if max(abs(g) for g in gap) <= close * max(1.0, total):
            break
        step = [g / m if m > 0 else 0.0 for g, m in zip(gap, mass, strict=True)]
        rate = F.greatest(F.lit(least_rate), rate + sum((x * F.lit(s) for x, s in zip(p[1:], step[1:], strict=True)), p[0] * F.lit(step[0])))
        new = list(members.agg(*[F.coalesce(F.sum(rate * tokens * x), F.lit(0.0)) for x in p]).first())
        if max(abs(a - b) for a, b in zip(new, have, strict=True)) <= 1e-6 * max(1.0, total):
            break
        have = new
    if max(abs(g - h) for g, h in zip(goal, have, strict=True)) > 0.01 * max(1.0, total):
        warnings.warn(f"expected tokens {dict(zip(model.domains, have, strict=True))} miss the targets {dict(zip(model.domains, goal, strict=True))}", stacklevel=2)
    return members.withColumn("rate", rate)


def mixture(
    docs: DataFrame, labelled_keys: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "lang", max_labelled: int = 20000, **options
) -> tuple[DataFrame, Classifier]:  # noqa: ANN003
    """Memberships and rates of all documents; the classifier learns from the labelled keys with the smallest hashes."""
    few = labelled_keys.select(F.col(key).alias("_k")).filter("_k is not null").distinct().orderBy(F.xxhash64("_k"), "_k").limit(max_labelled)
    docs = docs.select(key, text, domain)
    labelled = docs.join(F.broadcast(few), F.col(key) == F.col("_k"), "left_semi")
    model = train(labelled, domain, text)
    members = stored(memberships(docs, model, key, text))
    return fit_rates(members, model, targets, **options), model


def repeated(docs: DataFrame, rates: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as often as its rate says: the whole part, and once more by a hash for the rest."""
    k, h, rate, t, copy = (free_name(docs, c) for c in ("_k", "_h", "_rate", "_t", "_copy"))
    r = rates.select(F.col(key).alias(k), F.col("text_hash").alias(h), F.col("rate").alias(rate))
    rows = docs.withColumn(t, F.xxhash64(whole(text)))
    rows = rows.join(r, rows[key].eqNullSafe(r[k]) & (rows[t] == r[h]))
    u = F.pmod(F.xxhash64(k, h, F.lit(6)), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(F.col(rate) + u).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(docs.columns)
