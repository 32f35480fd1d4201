"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.llm import conversations, decontaminate, filter_audit, line_chunks, minhash, mixing, neighbours, pii, ppm, quality, secrets, sharding, toxicity

KINDS = "doc_id long, text string, lang string, score double, kept string, shard int, label string, r_score int, c0 int, Text_hash string"
LONG = "many plain words of one text " * 12_000
ROWS = [
    (1, "the same words in two rows, mail a@b.co or +4912345678901", "en", None, "x", 1, "l", 5, 6, "h"),
    (1, "the same words in two rows, mail a@b.co or +4912345678901", "en", None, "x", 1, "l", 5, 6, "h"),
    (2, None, None, None, None, None, None, None, None, None),
    (3, "", "de", 0.5, "y", 2, "m", 5, 6, "h"),
    (4, " \n\t ", "de", 0.5, "y", 2, "m", 5, 6, "h"),
    (None, "a row without key says something", "fr", 0.5, "y", 2, "m", 5, 6, "h"),
    (None, None, "fr", 0.5, "y", 2, "m", 5, 6, "h"),
    (5, LONG, "en", 0.5, "y", 2, "m", 5, 6, "h"),
    (6, "𝒳 é ü non-ASCII 𝒴 text stands here", "", 0.5, "y", 2, "m", 5, 6, "h"),
    (6, "another text of the same key", "en", 0.5, "y", 2, "m", 5, 6, "h"),
]
LABELS = [(1, 1, 0), (1, 0, 0), (3, 0, 1), (5, 1, 0), (6, 0, 1), (None, 1, 1), (9, None, None)]
ITEMS = [(1, "the same words in two rows"), (2, None), (None, "no key"), (3, "")]


def scored_toxicity(docs, labels):
    return toxicity.score_toxicity(docs, toxicity.train(docs, labels, F.lit(True)), docs.columns)


def scored_quality(docs, labels):
    return neighbours.score_quality(docs, neighbours.train(docs, labels, F.lit(True)), docs.columns)


#: Operators with one row for each row of the documents, and whether they keep the caller's columns.
ROW_BY_ROW = {
    "op2": (lambda d, _: ppm.score_texts(d, F.col("doc_id").isNotNull()), True),
    "op3": (lambda d, _: pii.find_pii(d, pii.train(d)), False),
    "op4": (lambda d, _: secrets.scan_secrets(d, secrets.SILENT), True),
    "op5": (lambda d, _: minhash.near_classes(d), False),
    "op7": (lambda d, _: line_chunks.without_repeated_chunks(d), False),
    "op8": (lambda d, x: quality.quality_filter(d, x.filter("quality = 1").select("doc_id")), True),
    "op9": (lambda d, _: sharding.shard_documents(d, n_shards=3), True),
    "op10": (scored_toxicity, True),
    "op12": (scored_quality, True),
}
PLACED = {"op9"}  # equal rows get different results: places


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, KINDS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_rows_keep_their_places(tables, name):
    docs, labels, _ = tables
    run, keeps = ROW_BY_ROW[name]
    out = run(docs, labels)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    if keeps:
        kept = [c for c in docs.columns if c in out.columns]
        assert {*docs.columns} - {*kept} <= {"text"}
        assert Counter(str([r[c] for c in kept]) for r in got) == Counter(str([r[docs.columns.index(c)] for c in kept]) for r in ROWS)
    if name not in PLACED:
        assert len({str(r.asDict()) for r in got if r["doc_id"] == 1}) == 1
    assert run(docs.limit(0), labels).count() == 0 and run(docs.limit(0), labels.limit(0)).count() == 0


def test_operators_with_other_rows(tables, spark):
    docs, labels, items = tables
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()} == {(1, 1)}
    assert decontaminate.overlaps(docs.limit(0), items).count() == decontaminate.overlaps(docs, items.limit(0)).count() == 0
    rates, model = mixing.mixture(docs, labels.select("doc_id"), {"en": 0.5, "de": 0.5})
    assert rates.agg(F.sum("rows")).first()[0] == len(ROWS) and mixing.repeated(docs, rates).columns == docs.columns
    empty, _ = mixing.mixture(docs.limit(0), labels.select("doc_id"), {"en": 1.0})
    assert empty.count() == 0
    parts = {r[2] or "" for r in ROWS}
    audit = filter_audit.audit(docs, labels)
    assert audit.count() == 600 * len(parts) and {r.part for r in audit.select("part").distinct().collect()} == parts
    talk = docs.select(F.col("doc_id").alias("conv_id"), F.col("r_score").alias("turn"), F.col("lang").alias("role"), "text", "kept", F.lit(1).alias("plan"), F.lit(2).alias("rows"))
    got = conversations.repair(talk).collect()
    assert {r.conv_id for r in got} == {r[0] for r in ROWS} and conversations.repair(talk.limit(0)).count() == 0


def test_memberships_and_rates_equal_numpy(spark):
    """Naive Bayes memberships and the projected gradient, recomputed from the words."""
    rng = np.random.default_rng(3)
    bags = {"en": [f"en{i}" for i in range(30)] + ["shared"] * 10, "de": [f"de{i}" for i in range(30)] + ["shared"] * 10}
    rows = [(i, " ".join(rng.choice(bags[d], rng.integers(1, 40))), d) for i in range(80) for d in [["en", "de"][i % 3 > 0]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    targets = {"en": 0.6, "de": 0.4}
    rates, model = mixing.mixture(docs, docs.select("doc_id"), targets, least_rate=0.5, growth=1.5)
    got = {r.doc_id: r for r in rates.collect()}
    words = sorted({w for _, t, _ in rows for w in t.split()})
    place = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", mixing.bucket(F.col("w"), len(model.logs[0])).alias("b")).collect()}
    counts = np.ones((2, len(model.logs[0])))
    for _, t, d in rows:
        for w in t.split():
            counts[model.domains.index(d), place[w]] += 1
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    np.testing.assert_allclose(model.logs, logs, rtol=1e-12)
    prior = np.array([sum(d == x for _, _, d in rows) for x in model.domains]) / len(rows)
    p, n = [], []
    for i, t, _ in rows:
        w = t.split()
        score = np.log(prior) + np.mean([logs[:, place[x]] for x in w], axis=0) * (len(w) * 50 / (len(w) + 50))
        own = np.exp(score - score.max())
        p.append(own / own.sum())
        n.append(len(w))
        np.testing.assert_allclose([got[i][f"p_{k}"] for k in range(2)], p[-1], rtol=1e-9)
    p, n = np.array(p), np.array(n, float)
    mass = n @ p
    goal_share = np.array([targets[d] for d in model.domains])
    total = max(1.5 * mass.sum(), *(0.5 * mass / goal_share))
    goal, rate, have = total * goal_share, np.ones(len(n)), mass
    for _ in range(25):
        if np.abs(goal - have).max() <= 1e-4 * max(1, total):
            break
        rate = np.maximum(0.5, rate + p @ ((goal - have) / mass))
        new = (rate * n) @ p
        if np.abs(new - have).max() <= 1e-6 * max(1, total):
            break
        have = new
    np.testing.assert_allclose([got[i].rate for i, _, _ in rows], rate, rtol=1e-9)


def test_shards_of_different_keys_equal_one_line(spark):
    """Records in the order of their keys on one line of bytes, cut into equal parts."""
    rng = np.random.default_rng(5)
    rows = [(int(k), "x" * int(rng.integers(0, 300))) for k in rng.permutation(4000)]
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n_shards=7).collect()}
    total, at, slots = sum(len(t) + 16 for _, t in rows), 0, Counter()
    for k, t in sorted(rows):
        shard = min(6, at * 7 // total)
        assert got[k] == (shard, slots[shard]), k
        slots[shard] += 1
        at += len(t) + 16


def test_network_scores_equal_loops():
    """Embedding, three widths of filters, max pooling and the logistic unit, word by word."""
    rng = np.random.default_rng(6)
    tables = tuple(rng.normal(0, 1, (1 << b, toxicity.DIM)).astype(np.float32) for b in (toxicity.WORD_BITS, toxicity.WORD_BITS, toxicity.PREFIX_BITS))
    kernels = tuple(rng.normal(0, 0.3, (w, 3 * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS)
    biases = tuple(rng.normal(0, 0.1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS)
    model = toxicity.Model(tables, kernels, biases, rng.normal(0, 0.3, len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), -0.2)
    texts = ["one", "", "two words", "some more words, of a longer text! with signs", None, "x " * 30]
    w = toxicity.Words(pa.array(texts), toxicity.ALNUM, (toxicity.PREFIX,))
    ids = toxicity.slots(w.hashes, w.prefixes[0])
    got = toxicity.scores(model, ids, w.bounds)
    for t in range(len(texts)):
        span = range(w.bounds[t], w.bounds[t + 1])
        x = [np.concatenate([table[i[j]] for table, i in zip(tables, ids, strict=True)]) for j in span]
        pooled = []
        for kernel, bias in zip(kernels, biases, strict=True):
            at = [sum((x[j + k] @ kernel[k] for k in range(len(kernel)) if j + k < len(x)), bias) for j in range(len(x))]
            pooled.append(np.maximum(np.max(at, axis=0), 0) if at else np.zeros(toxicity.FILTERS))
        want = 1 / (1 + np.exp(-(np.concatenate(pooled) @ model.out + model.bias)))
        assert abs(got[t] - want) < 1e-4, t
