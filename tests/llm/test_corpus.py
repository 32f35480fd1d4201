"""Near duplicates, decontamination, mixing, line chunks, sharding and the pipeline."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, line_chunks, minhash, mixing, sharding

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(6)) for _ in range(400)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def changed(t, n):
    w = t.split()
    for i in RNG.sample(range(len(w)), n):
        w[i] = "changed%d" % RNG.randrange(10**6)
    return " ".join(w)


def runs(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    sets = {i: runs(t or "") for i, t in rows}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def test_near_classes(spark):
    rows, k = [], 0
    for size in (60, 150, 400):
        base = text(size)
        for edits in (0, 0, 1, 2, size // 40, size // 30, size // 12, size // 5):
            rows.append((k, changed(base, edits)))
            k += 1
    chain = text(200)
    for _ in range(12):  # each near the one before, the ends far apart
        rows.append((k, chain))
        chain, k = changed(chain, 4), k + 1
    rows += [(k + i, t) for i, t in enumerate([None, "", " ", "short one", "Short one", "other", text(90)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()}
    assert got == brute_classes(rows)
    kept = minhash.one_of_each(docs.union(docs.limit(3)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert kept.columns == docs.columns
    assert minhash.near_classes(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    e = rng.integers(0, 2**63, 300, np.uint64)
    a, b = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = minhash.signatures(np.concatenate([e, e]), np.repeat([0, 1], 300), np.concatenate([a, b]), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.04
    counted, n = minhash.weighted_signatures(pa.array(["a b c d e f", "a b c d e f", ""]), presence=False)
    assert (counted[0] == counted[1]).all() and list(n) == [2, 2, 0] and not counted[2].any()


def test_overlaps(spark):
    items = [(i, text(30)) for i in range(6)] + [(6, text(5)), (7, None), (8, "")]
    rows = [
        (1, text(80) + " " + items[0][1] + " " + text(40)),
        (2, text(50) + " " + changed(items[1][1], 3) + " " + text(9)),
        (3, text(300)),
        (4, items[2][1].upper().replace(" ", ", ")),
        (5, text(20) + " " + items[6][1] + " " + text(20)),
        (6, None),
        (7, ""),
        (8, changed(items[3][1], 20)),
        (9, " ".join(items[4][1].split()[:22]) + " " + text(50)),
    ]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 0), (2, 1), (4, 2), (5, 6), (9, 4)}
    for limit in (500_000, 0):  # broadcast, and the way by shuffle
        got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench, max_broadcast=limit).collect()}
        assert got == want
    assert sorted(r.doc_id for r in decontaminate.without_overlaps(docs, bench).collect()) == [3, 6, 7, 8]
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0


def test_masks_ignore_every_inner_word():
    for at in range(1, decontaminate.SPAN - 1):
        assert any(m[at] == "0" for m in decontaminate.MASKS)
    assert {m.count("1") for m in decontaminate.MASKS} == {8}


def test_overlaps_find_every_fifth_changed(spark):
    rows, items, want, k = [], [], set(), 0
    for n in (3, 5, 6, 9, 10, 12, 13, 14, 15, 16, 19, 20, 38):
        for edits in range(min(4, n // 5) + 2):
            for _ in range(6):
                item = text(n)
                items.append((k, item))
                w, head = item.split(), n if n <= 20 else 20  # a run of 20 words of a longer item
                at = RNG.randrange(n - head + 1)
                for i in RNG.sample(range(at, at + head), edits):
                    w[i] = "changed%d" % i
                w[:at] = ["before"] * at
                w[at + head :] = ["after"] * (n - at - head)
                rows.append((k, text(RNG.randrange(9)) + " " + " ".join(w) + " " + text(RNG.randrange(9))))
                if edits <= head // 5:
                    want.add((k, k))
                k += 1
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (500_000, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench, max_broadcast=limit).collect()}
        assert {x for x in got if x[0] == x[1]} == want


def test_mixture_meets_targets(spark):
    words = {"x": "red green blue", "y": "one two three"}
    rows = [(i, " ".join(random.Random(i).choice(words["x" if i % 4 else "y"].split()) for _ in range(20 + i % 7)), "x" if i % 4 else "y") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", "x"), (5, *rows[5][1:])], "doc_id long, text string, lang string")
    rates, model = mixing.mixture(docs, docs.select("doc_id").filter("doc_id < 100"), {"x": 0.5, "y": 0.5})
    got = rates.collect()
    total = {d: sum(r.rate * r.rows * r.n_tokens * r[f"p_{i}"] for r in got) for i, d in enumerate(model.domains)}
    assert abs(total["x"] / (total["x"] + total["y"]) - 0.5) < 0.01
    assert all(r.rate >= 0 for r in got)
    more, _ = mixing.mixture(docs, docs.select("doc_id"), {"x": 0.6, "y": 0.4}, growth=1.3, least_rate=1.0)
    out = mixing.repeated(docs, more)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} and out.count() > 210
    none, model = mixing.mixture(docs.limit(0), docs.select("doc_id").limit(0), {"x": 1.0})
    assert none.count() == 0 and model.domains == ["unknown"]


def test_mixture_grows_for_a_language_beyond_its_weight(spark):
    words = {"en": "the red house", "de": "das rote haus", "fr": "la maison rouge", "es": "el casa roja", "it": "il treno nero"}
    langs = ["de"] * 45 + ["en"] * 30 + ["fr"] * 10 + ["es"] * 10 + ["it"] * 5
    rows = [(i, " ".join(random.Random(i).choice(words[langs[i % 100]].split()) for _ in range(30)), langs[i % 100]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    targets = {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12}
    rates, model = mixing.mixture(docs, docs.select("doc_id"), targets, growth=1.2, least_rate=1.0)
    got = rates.collect()
    total = {d: sum(r.rate * r.rows * r.n_tokens * r[f"p_{i}"] for r in got) for i, d in enumerate(model.domains)}
    aimed = sum(total[d] for d in targets)
    assert all(abs(total[d] / aimed - w) < 0.01 for d, w in targets.items())
    assert min(r.rate for r in got) >= 1 and total["it"] < 1.05 * 30 * 30


def test_filters_with_repeated_and_null_keys(spark):
    many, item = [text(60) for _ in range(9)], text(30)
    rows = [(7, t) for t in many] + [(None, many[0]), (None, changed(many[1], 1)), (None, "x " + item), (7, item + " y"), (3, many[2]), (None, None), (None, "")]
    rows += [(None, t) for t in [text(70)] * 2] + [(8, many[3])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in minhash.one_of_each(docs).collect())
    want = [(False, 7, t) for i, t in enumerate(many) if i != 2] + [(False, 3, many[2]), (False, 7, item + " y"), (True, 0, ""), (True, 0, ""), (True, 0, rows[-3][1])]
    assert sorted(x for x in kept if x[2] != "x " + item) == sorted(want)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontaminate.without_overlaps(docs, bench).collect()
    assert len(clean) == len(rows) - 2 and not any(item in (r.text or "") for r in clean)


def brute_chunks(t):
    import hashlib

    lines = (t or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, now = [], []
    for i, x in enumerate(lines):
        now.append(x)
        if ((h[i - 2] if i > 1 else 0) * 66049 + (h[i - 1] if i else 0) * 257 + h[i]) % 2147483647 % 4 == 0:
            out.append(now)
            now = []
    return [*out, now] if now else out


def test_line_chunks(spark):
    shared = "\n".join(text(6) for _ in range(12))
    rows = [(1, shared), (2, text(5) + "\n" + shared), (3, text(9)), (4, None), (5, "\n\n\n"), (6, "\n\n\n"), (7, shared + "\n" + text(3)), (8, "")]
    seen, want = set(), {}
    for i, t in rows:
        stay = []
        for c in brute_chunks(t):
            body = "\n".join(c)
            if len(c) < 2 or body not in seen:
                stay.append(body)
            seen.add(body)
        want[i] = "\n".join(stay)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.clean for r in line_chunks.without_repeated_chunks(docs).collect()} == want
    assert line_chunks.without_repeated_chunks(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    rows = [(7 if hot and i % 3 == 0 else i, "w" * (i % 90), "s", 1) for i in range(3000)] + [(None, None, "s", 1), (5, "w" * 2000, "s", 1), (5, "w" * 2000, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, _range int")
    got = sharding.shard_documents(docs, n_shards=8).collect()
    assert len(got) == len(rows)
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 16
        assert r.shard == "s"
        size[r.shard_] += r["size"]
        slots[r.shard_].append(r.slot)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * 2016
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, None, None, None, 0), (10**6 + 1, "", "xx", "s", 0)], docs.schema)
    now = docs.union(odd)
    n = now.count()
    for name, stage in corpus_pipeline.STAGES:
        before = now.columns
        now = stage(spark, now, tiny)
        m = now.count()
        if name == "sharding":
            assert {"doc_id", "shard", "slot"} <= set(now.columns) and m == n
        else:
            assert now.columns == before and (m >= n if name == "mixing" else 0 < m < n)
        n = m


def test_mixing_writes_no_model_into_its_plan(spark):
    """A description of the plan is kept by the driver for each execution and each of its steps."""
    docs = spark.createDataFrame([(i, f"word{i} and word{i % 7}", "abcd"[i % 4]) for i in range(40)], "doc_id long, text string, lang string")
    model = mixing.train(docs, "lang")
    members = mixing.memberships(docs, model)
    assert len(members._jdf.queryExecution().toString()) < 200_000
    place = {r.w: r.b for r in spark.createDataFrame([("word5",), ("and",)], "w string").select("w", mixing.bucket(F.col("w"), len(model.logs[0])).alias("b")).collect()}
    first = members.filter("doc_id = 5").first()
    words = [place["word5"], place["and"], place["word5"]]
    logit = [sum(logs[b] for b in words) / 3 * (3 * 50 / 53) + math.log(p) for logs, p in zip(model.logs, model.prior, strict=True)]
    powers = [math.exp(x - max(logit)) for x in logit]
    assert [first[f"p_{i}"] for i in range(4)] == pytest.approx([p / sum(powers) for p in powers])
