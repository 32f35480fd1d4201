"""The filter audit, neighbour votes and conversation repair against plain Python and SQL."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.llm import conversations, filter_audit, neighbours, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, kept int"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_conversation_repair"])
def test_query_equals_its_sql(spark, tiny, name):
    db = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tiny}/{table}.parquet'")
    got = queries.QUERIES[name](spark, tiny)
    names = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE[name]})").fetchall()
    assert len(want) and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(names).collect())


def brute_audit(docs, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1} - {None} for i in (0, 1))
    fails = []
    for d, t, *_ in docs:
        t = t or ""
        w = WORDS.findall(t)
        own = [len(w) < 200, 100 * len({*w}) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t))]
        own.append(d is not None and any(o is not None and o < d and (x or "") == t for o, x, *_ in docs))
        fails.append({f for f, x in zip("ABCDE", own, strict=True) if x})
    out = {}
    for part in {p or "" for _, _, p, *_ in docs}:
        mine = [(d, f) for (d, _, p, *_), f in zip(docs, fails, strict=True) if (p or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                redundant = sum(f in x and bool(x & {*order[: step - 1]}) for _, x in mine)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x == {f} for _, x in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "A B", "$ x", " ".join(f"w{i}" for i in range(210)), " ".join(["w"] * 230), "é " * 220, "AB " * 300, " ".join(f"W{i}|" for i in range(250))]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", None, ""]), 5) for _ in range(150)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in [None, *range(0, 40, 2), 4, 6]]
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert {tuple(r[:3]): list(r[3:]) for r in got.collect()} == brute_audit(docs, labels)
    assert got.columns[:3] == ["part", "filter_order", "step"] and got.count() == 1200


def test_audit_of_an_empty_table_and_a_long_text(spark):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    long = spark.createDataFrame([(1, "word " * 600_000, "en", 0)], DOCS)
    rows = filter_audit.audit(long, labels).collect()
    assert len(rows) == 600 and {r.removed for r in rows if r.filter_order == "BACDE" and r.step == 1} == {1} and max(r.shapley for r in rows) == 120


def cheapest(code):
    """(cost, letters) by trying edits in the order of cost and letters."""
    heap = [(0, "", 0, "")]
    while True:
        cost, letters, i, roles = heapq.heappop(heap)
        if i == len(code) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters
        put = lambda c, x, j, r: re.fullmatch("(s?(ua)*u?)", r) and heapq.heappush(heap, (cost + c, letters + x, j, r))
        for r in "ua":
            put(3, "I", i, roles + r)
        if i < len(code):
            put(4, "D", i + 1, roles)
            if code[i] != "-":
                cut = 3 * code[i].isupper()
                put(cut, "K", i + 1, roles + code[i].lower())
                for r in "ua":
                    put(cut + 3, "R", i + 1, roles + r)


def test_edits_equal_a_search_over_all():
    rng = random.Random(5)
    for _ in range(300):
        code = "".join(rng.choice("suaxSUAX--uaua") for _ in range(rng.randint(0, 6)))
        assert conversations.least_weight(code) == conversations.least_word(code) == cheapest(code), code
    for _ in range(60):
        code = "".join(rng.choice("suaxSUAX-uuuaaa") for _ in range(rng.randint(50, 400)))
        assert conversations.least_weight(code) == conversations.least_word(code)


def test_repair_of_odd_rows(spark):
    rows = [
        (1, None, "user", "Hi.", 0), (1, 1, "assistant", "Yes.", 0), (1, 1, "assistant", "Yes.", 0), (1, 4, "user", "and\n", 0), (2, 1, None, None, 0), (2, 2, "tool", "x.", 0),
        (None, 1, "system", "Be.", 0), (None, 2, "user", "Hi!", 0), (3, None, "user", "", 0), (4, 7, "user", "gone", 0), (5, 1, "", "x.", 0),
    ]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    got = {r.conv_id: r for r in conversations.repair(docs, present=~F.col("text").eqNullSafe("gone")).collect()}
    r = got[1]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (2, 0, 1, 1, 1, 8, "KKDD") and [tuple(t) for t in r.repaired] == [("user", "Hi."), ("assistant", "Yes.")]
    assert (got[2].blank, got[2].cost, got[2].audit, got[2].repaired) == (1, 8, "DD", [])
    assert (got[None].audit, [tuple(t) for t in got[None].repaired]) == ("KKI", [("system", "Be."), ("user", "Hi!"), ("assistant", "")])
    assert (got[3].gaps, got[3].audit, got[4].gaps, got[4].audit, got[4].repaired, got[5].audit) == (0, "D", 0, "", [], "D")
    assert conversations.repair(docs.limit(0)).count() == 0


def test_long_conversations_go_the_other_way_and_agree(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 30)}{rng.choice(['.', ''])}") for c in range(3) for t in range(120)]
    rows += [(9, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(5000)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = ({r.conv_id: (r.cost, r.audit, len(r.repaired)) for r in conversations.repair(docs, long=n).collect()} for n in (2000, 0))
    assert a == b and a[9] == (0, "K" * 5000, 5000)


def test_repair_digest_by_hand(spark, tiny):
    """Damage, kept turns and digest of the registered query for one conversation."""
    rows = sorted((r.turn, r.role, r.text) for r in spark.read.parquet(f"{tiny}/conversations.parquet").filter("conv_id = 1").collect())
    kinds = [zlib.crc32(f"1:{t}".encode()) % 20 for t, *_ in rows]
    got = queries.op13_conversation_repair(spark, tiny).filter("conv_id = 1").collect()[0]
    if all(k > 4 for k in kinds) and set(got.audit) <= {"K"}:
        assert got.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in rows).encode()).hexdigest()
    assert got.gaps == 0 or 0 in kinds


def test_votes_equal_all_cosines():
    """Every product with every labelled vector, sorted, and the nearest with their ties by hand."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd!!", "EE$"], rng.integers(1, 30))) for _ in range(90)]
    x = neighbours.bags(pa.array(texts))
    good = (rng.random(60) < 0.6).astype(int)
    model = neighbours.fit(x[:60], good, {0: 300, 1: 700})
    got = neighbours.votes(model, x, 7)
    z = x.astype(float) @ model.space.astype(float)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for i in range(90):
        near = [round(float(s), 5) for s in z[i] @ z[:60].T]
        least = sorted(near)[-7]
        pick = [j for j in range(60) if near[j] >= least - 2e-5]
        vote = [max(near[j], 0) * (700 / good.sum() if good[j] else 300 / (60 - good.sum())) for j in pick]
        assert abs(got[i] - sum(v for v, j in zip(vote, pick, strict=True) if good[j]) / sum(vote)) < 0.02, i


def test_bags_hold_shares_of_words_and_shapes():
    x = neighbours.bags(pa.array(["aa bb aa", "", None, "Ab!! x"]))
    assert x.shape == (4, neighbours.WIDTH) and np.allclose((x**2).sum(axis=1), [2, 0, 0, 2], atol=1e-6)
    once, again = neighbours.shapes(pa.array(["ab cd ab"]))[0][[0, 2]]
    assert once != again and once == neighbours.shapes(pa.array(["xyz"]))[0][0]


def test_quality_on_held_out_rows(spark):
    """Trained on the rows that op12 learns from, asked about the others."""
    sf = "/root/testdata/sf0.01"
    got = queries.op12_neighbour_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted for r in held if r.quality) >= 0.98 * sum(r.quality for r in held)
    assert sum(1 - r.predicted for r in held if not r.quality) >= 0.8 * sum(1 - r.quality for r in held)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 3), (2, "BAD!! BAD!!", 3), (None, None, 3), (3, "good words here", 3), (3, "good words here", 3), (4, "x " * 300_000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 1)], LABELS)
    out = neighbours.score_quality(docs, neighbours.train(docs, labels, F.lit(True)), docs.columns)
    assert out.columns == ["doc_id", "text", "score", "score_"] and out.count() == 6
    by = {r.doc_id: r.score_ for r in out.collect()}
    assert by[1] == by[3] > 0.5 > by[2] and by[None] == 0.5
    one = neighbours.train(docs, labels.filter("quality = 1"), F.lit(True))
    assert one.model is None and {r.score_ for r in neighbours.score_quality(docs, one, ["doc_id", "score"]).collect()} == {1.0}
    none = neighbours.train(docs.limit(0), labels.limit(0), F.lit(True))
    assert neighbours.score_quality(docs.limit(0), none, ["doc_id"]).count() == 0


def test_chunks_of_equal_null_and_text_keys(spark):
    """The second holder of a shared passage loses as many lines, whatever the keys are."""
    from cellweave.llm import line_chunks

    shared = "\n".join(f"shared line {i}" for i in range(60))
    texts = [f"one\n{shared}\nend", f"two\nmore\n{shared}\nother end"]

    def removed(kind, keys):
        docs = spark.createDataFrame([(k, t) for k, t in zip(keys, texts, strict=True)], f"doc_id {kind}, text string")
        got = line_chunks.without_repeated_chunks(docs).collect()
        assert {r.doc_id for r in got} == set(keys)
        return sorted(r.n_removed_lines for r in got)

    want = removed("long", [1, 2])
    assert want[0] == 0 and want[1] > 20
    for kind, keys in (("long", [None, None]), ("long", [1, 1]), ("long", [(1 << 63) - 1, None]), ("string", ["a", "b"]), ("string", [None, "b"])):
        assert removed(kind, keys) == want, keys


def test_chunks_of_many_holders_and_one_long_text(spark):
    from cellweave.llm import line_chunks

    rng = random.Random(9)
    body = "\n".join(f"common {i} {rng.random()}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{i}\n{body}") for i in range(300)] + [(900, "\n".join(["a line", "b line"] * 40_000))], "doc_id long, text string")
    chunked = line_chunks.with_chunks(docs, "doc_id", "text", 4)
    few, many = ({(r._k, tuple(sorted(r._gone))) for r in line_chunks.repeated_chunks(chunked, n).collect()} for n in (7, 2000))
    assert few == many and len(few) >= 299 and 0 not in {k for k, _ in few}


def test_twenty_thousand_hits_in_one_text(spark):
    import time

    from cellweave.llm import secrets

    hits = [hashlib.sha256(str(i).encode()).hexdigest()[:33] for i in range(20_000)]
    df = spark.createDataFrame([(1, "é " + "  ".join(hits))], "doc_id long, text string")
    began = time.time()
    r = secrets.scan_secrets(df, secrets.SILENT).first()
    assert [(s.start, s.end, s.value) for s in r.base_spans] == [(2 + 35 * i, 35 + 35 * i, h) for i, h in enumerate(hits)] == [(s.start, s.end, s.value) for s in r.secret_spans]
    assert time.time() - began < 90


def test_runs_beside_many_spans_equal_runs_beside_few(spark):
    """Halving the sorted spans drops the runs that a look at every span drops."""
    from cellweave.llm import secrets

    rng = random.Random(4)
    word = lambda: rng.choice(["x" * rng.randint(1, 30), hashlib.md5(str(rng.random()).encode()).hexdigest(), f"token={rng.random()}", "AKIA" + "B" * rng.randint(9, 16), "pre-password: 'Zz9/+longer.value'", f"secret=a{rng.randint(0, 9)}"])
    texts = [rng.choice([" ", "", "\n", "."]).join(word() for _ in range(n)) for n in (0, 1, 3, 40, 90, 90)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("base", secrets.base_spans(F.col("text")))
    every = secrets.Model([9.0] * (95 * 95), 0.5)
    a, b = ({r.doc_id: r.s for r in rows.select("doc_id", secrets.random_spans(F.col("text"), F.col("base"), every, few).alias("s")).collect()} for few in (10**6, -1))
    assert a == b and sum(map(len, a.values())) > 10


def test_field_is_fitted_on_a_bounded_sample(spark):
    """One key on many rows, or one giant text, gives no more texts than the bounds say."""
    from cellweave.llm import pii

    rows = [(7, f"mail a{i}@b.co now") for i in range(3000)] + [(i, f"call +4912345678{i:02} now") for i in range(40, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = spark.sparkContext.accumulator(0)
    fit = pii.fitter

    def counting(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield from fit(iter([b]))

    pii.fitter = counting
    try:
        a = pii.train(docs, max_docs=10)
        assert counted.value <= 10 and a.unary.any()
        pii.train(docs, max_docs=1000, max_bytes=100)
        assert counted.value <= 10 + 6
    finally:
        pii.fitter = fit
    assert not pii.train(docs.limit(0)).unary.any() and not pii.train(docs.filter("doc_id < 0")).unary.any()


def letters(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def brute_overlaps(docs, items, window=20, least=0.8):
    """Every (key, item) for which some run of the item, laid anywhere over the document, has enough equal words."""
    out = set()
    for k, t in docs:
        d = letters(t or "")
        for i, x in items:
            w = letters(x)
            n = min(window, len(w))
            for at in range(-len(w) + 1, len(d)):
                same = [0 <= at + j < len(d) and d[at + j] == v for j, v in enumerate(w)]
                if any(sum(same[j : j + n]) >= max(1, -(-least * n // 1)) for j in range(len(w) - n + 1)) and w:
                    out.add((k, i))
                    break
    return out


def test_overlaps_equal_all_pairs(spark):
    """All items against all documents, null and repeated keys too: no overlap is missed and none is made up."""
    from cellweave.llm import decontaminate

    rng = random.Random(8)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    run = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(run(n))) for i, n in enumerate([3, 4, 5, 9, 14, 20, 26, 33, 40])]
    docs = []
    for k in range(60):
        _, x = rng.choice(items)
        w = x.split()
        for _ in range(rng.randint(0, max(1, len(w) // 4))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        cut = rng.randint(0, max(0, len(w) - 12)) if k % 3 == 0 else 0
        docs.append((k if k % 7 else None, " ".join(run(rng.randint(0, 25)) + w[cut:] + run(rng.randint(0, 25)))))
    docs += [(3, " ".join(run(40))), (98, ""), (99, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_overlaps(docs, items)
    for most in (500_000, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b, max_broadcast=most).collect()} == want
    assert any(k is None for k, _ in want) and len(want) > 30
