"""Language-model scores: prediction by partial matching over bytes, with a word unigram base.

The trie holds, for every context of up to five bytes, how often each byte
followed in the training texts (A-Z lower-cased, five start marks before, one
end mark after). A byte seen after the longest known context has probability
(n - 1/2) / N; otherwise the escape q / 2N is paid, with q distinct successors
there, and the next shorter context is asked, where the bytes just excluded
and their counts no longer take part. Below the empty context the bytes never
seen share what is left. The score is the sum of log10 over the bytes and the
end mark.

The trie is a set of tables, one for each order, and grows with the corpus:
every context is kept, nothing of it passes through the driver or a broadcast.
Consecutive rows form parts of up to ``part_bytes`` of text. Each part states
the distinct codes (context and byte) and words it holds and how often they
occur in its training texts. Sums of these are the counts. Codes never seen in
training climb down the orders by joins; a node of the trie has at most 256
neighbours on the next order, so no join has a hot key. The answers go back to
the parts that asked, which add them up; a word whose training occurrences are
all in one part needs none there.

Nulls count as empty texts, which consist of the end mark. Without training
texts every byte has probability 1/256 and the base score is 0. A null training
mark counts as false. Repeated rows get equal scores. All columns given are
kept; a result whose name is taken gets an underscore at its end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import restored, stored, whole
from .tokens import WHITE, text_bytes

ORDER, START, END, ALPHABET = 5, 0xFE, 0xFF, 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[list(WHITE)] = True
WINDOW = 1 << 19
#: A part is numbered by its task and, in this many bits, within it.
PER_TASK = 11
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code of (context, byte) for each byte and end mark in order, and the index of its text; in windows."""
    data, offsets = text_bytes(column)
    n, length = len(offsets) - 1, np.diff(offsets) + ORDER + 1
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(n, dtype=np.int32), length)
    padded = np.full(len(owner), START, np.uint8)
    marks = np.zeros(len(owner), bool)
    if n:
        marks[(ends - length)[:, None] + np.arange(ORDER)] = True
    counted = ~marks
    marks[ends - 1] = True
    padded[~marks] = LOWER[data]
    padded[ends - 1] = END
    for a in range(ORDER, len(padded), WINDOW):
        b = min(a + WINDOW, len(padded))
        code = padded[a:b].astype(np.uint64)
        for k in range(1, ORDER + 1):
            code |= padded[a - k : b - k].astype(np.uint64) << np.uint64(8 * k)
        yield code[counted[a:b]], owner[a:b][counted[a:b]]


def token_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, lower-cased, and the texts' n + 1 bounds among them."""
    data, offsets = text_bytes(column)
    inside = ~BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(inside, starts, dtype=np.int64))])
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[data[inside]])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), buffers), np.searchsorted(starts, offsets)


def slices(texts: pa.Array, limit: int = 3_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts of up to ``limit`` bytes together, one at least, and the first one's index."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), "right")))
        yield at, texts.slice(at, to - at)
        at = to


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(code)
    code, n = code[order], n[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(code) else n


def holdings(rows: pa.Table, part: int) -> pa.RecordBatch:
    """The distinct codes and words of a part, with their occurrences in its training texts; at last its rows, packed, and how many train."""
    codes, words, trained = [], [pa.array([], pa.large_string())], [np.zeros(0, np.int64)]
    for training in (True, False):
        for _, texts in slices(rows.filter(pc.equal(rows["training"], training))["text"].combine_chunks()):
            new = []
            for code, _ in grams(texts):
                got, n = np.unique(code, return_counts=True)
                new.append((got, n if training else np.zeros(len(got), np.int64)))
            new = merged(new)
            codes = [merged([*codes, new])]
            del new
            found = token_words(texts)[0].value_counts()
            words.append(found.field("values"))
            trained.append(found.field("counts").to_numpy() if training else np.zeros(len(found), np.int64))
    code, n = merged(codes)
    found = pa.concat_arrays(words).dictionary_encode()
    m = np.bincount(found.indices.to_numpy(), np.concatenate(trained), len(found.dictionary)).astype(np.int64)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_table(rows)
    x, y, kind = len(code), len(m), pa.large_string()
    columns = [
        pa.array(np.full(x + y + 1, part, np.int32)),
        pa.concat_arrays([pa.array(code.astype(np.int64)), pa.nulls(y + 1, pa.int64())]),
        pa.concat_arrays([pa.nulls(x, kind), found.dictionary.cast(kind), pa.nulls(1, kind)]).cast(pa.string()),
        pa.array(np.concatenate([n, m, [pc.sum(rows["training"]).as_py() or 0]]).astype(np.int64)),
        pa.concat_arrays([pa.nulls(x + y, pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "code", "word", "n", "packed"])


def parts_of(part_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parts of consecutive rows, none of them over ``part_bytes`` of text unless it is one row; a text is never cut."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, held, size = TaskContext.get().partitionId() << PER_TASK, 0, [], 0
        for b in batches:
            ends, at = np.cumsum(pc.binary_length(b.column("text")).to_numpy()), 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                to = max(int(np.searchsorted(ends, before + part_bytes - size, "right")), at if held else at + 1)
                if to > at:
                    held.append(b.slice(at, to - at))
                    size, at = size + int(ends[to - 1] - before), to
                if at < len(ends):
                    yield holdings(pa.Table.from_batches(held), first + n)
                    n, held, size = n + 1, [], 0
        if held:
            yield holdings(pa.Table.from_batches(held), first + n)

    return deal


def low(column: str, n_bytes: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << (8 * n_bytes)) - 1).cast("long"))


def upper(column: str) -> Column:
    return F.shiftright(column, 8)


def levels(seen: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 0: counts (code, n) and contexts (ctx, total, q, log_rest, again).

    log_rest: log of what the next shorter context has left once the context's
    successors are excluded; again: the escape from there.
    """
    counts = [seen]
    for d in range(ORDER - 1, -1, -1):
        counts.insert(0, stored(counts[0].groupBy(low("code", d + 1).alias("code")).agg(F.sum("n").alias("n"))))
    sums = lambda: (F.sum("n").alias("total"), F.count("*").alias("q"))
    none = F.lit(0.0)
    empty = counts[0].groupBy(upper("code").alias("ctx")).agg(*sums()).select("ctx", "total", "q", none.alias("log_rest"), none.alias("again"))
    out = [(counts[0], stored(empty))]
    for d in range(1, ORDER + 1):
        shorter = counts[d - 1].select(F.col("code").alias("short"), F.col("n").alias("m"))
        ctx = counts[d].select(upper("code").alias("ctx"), "n", low("code", d).alias("short")).join(shorter, "short").groupBy("ctx").agg(*sums(), F.sum("m").alias("shared"))
        parent = out[-1][1].select(F.col("ctx").alias("up"), F.col("total").alias("p_total"), F.col("q").alias("p_q"))
        log_rest = F.log(F.greatest(F.col("p_total") - F.col("shared"), F.lit(1)).cast("double"))
        again = F.when(F.col("p_q") > F.col("q"), F.log((F.col("p_q") - F.col("q")) / 2) - log_rest).otherwise(0.0)
        ctx = ctx.withColumn("up", low("ctx", d - 1)).join(parent, "up").select("ctx", "total", "q", log_rest.alias("log_rest"), again.alias("again"))
        out.append((counts[d], stored(ctx)))
    return out


def log_probabilities(codes: DataFrame) -> DataFrame:
    """(code, log_p), natural, for every code of (code, n); those with n > 0 are the trie."""
    tree = levels(codes.filter("n > 0"))
    symbols = tree[0][0].count()  # 256 at most
    floor = -math.log(ALPHABET - symbols) if 0 < symbols < ALPHABET else -math.log(ALPHABET)
    need = [codes.filter("n = 0").select("code")]
    for d in range(ORDER - 1, -1, -1):
        need.insert(0, stored(need[0].select(low("code", d + 1).alias("code")).distinct()))
    direct = F.log(F.col("n") - 0.5) - F.log("total")
    # of what is below the empty context: no shorter code, and an escape that leads to the floor
    below = need[0].select(F.lit(None).cast("long").alias("n_short"), F.lit(floor).alias("a_short"), F.lit(floor).alias("m_short"), F.lit(0).cast("long").alias("short")).distinct()
    for d, (counts, contexts) in enumerate(tree):
        rows = need[d].select("code", upper("code").alias("ctx"), low("code", d).alias("short"))
        rows = rows.join(counts, "code", "left").join(contexts, "ctx", "left").join(below, "short")
        after = F.when(F.col("n_short").isNotNull(), F.log(F.col("n_short") - 0.5) - F.col("log_rest")).otherwise(F.col("again") + F.col("m_short"))
        first = F.when(F.col("n").isNotNull(), direct).when(F.col("total").isNotNull(), F.log(F.col("q") / 2) - F.log("total") + after).otherwise(F.col("a_short"))
        answers = stored(rows.select("code", "n", first.alias("a"), after.alias("m")))
        below = answers.select(F.col("code").alias("short"), F.col("n").alias("n_short"), F.col("a").alias("a_short"), F.col("m").alias("m_short"))
    counts, contexts = tree[ORDER]
    known = counts.withColumn("ctx", upper("code")).join(contexts, "ctx").select("code", direct.alias("log_p"))
    return known.union(answers.select("code", F.col("a").alias("log_p")))


class Lookup:
    """Values of the codes of a part, through a table of slots; what is not in its slot is searched."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        del values, order
        bits = max(10, int(np.ceil(np.log2(max(2, len(codes))))) + 1)
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self.place(self.codes)] = np.arange(len(self.codes), dtype=np.int32)

    def place(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.slots[self.place(codes)]
        missed = np.flatnonzero(self.codes[at] != codes)
        at[missed] = np.searchsorted(self.codes, codes[missed])
        return self.values[at]


def word_counts(rows: pa.Table, words: pa.Array, counts: np.ndarray) -> Callable[[pa.Array], np.ndarray]:
    """Training counts of words: those that occur in other parts too are given, the rest are counted in the part itself."""
    own, n = [pa.array([], pa.large_string())], [np.zeros(0)]
    for _, texts in slices(rows.filter(rows["training"])["text"].combine_chunks()):
        found = token_words(texts)[0].value_counts()
        own.append(found.field("values"))
        n.append(found.field("counts").to_numpy())
    own = pa.concat_arrays(own).dictionary_encode()
    sums = np.bincount(own.indices.to_numpy(), np.concatenate(n), len(own.dictionary))
    place = pc.index_in(words, value_set=own.dictionary)
    known = place.is_valid().to_numpy(zero_copy_only=False)
    sums[place.drop_null().to_numpy()] = counts[known]
    every = pa.concat_arrays([own.dictionary.cast(pa.large_string()), words.filter(pa.array(~known))])
    sums = np.concatenate([sums, counts[~known], [0.0]])
    return lambda found: sums[pc.fill_null(pc.index_in(found, value_set=every), len(every)).to_numpy()]


def scorer(n: int, v: int, ends: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``n`` training tokens of ``v`` kinds, ``ends`` of them ends."""
    scale = math.log10(n + 1 * (v + 1))

    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(packed["packed"][0].as_buffer()).read_all()
        column = rows["text"].combine_chunks()
        is_code = pc.is_valid(answers["code"])
        look = Lookup(answers["code"].filter(is_code).to_numpy().astype(np.uint64), answers["value"].filter(is_code).to_numpy())
        others = pc.invert(is_code)
        counts = word_counts(rows, answers["word"].filter(others).combine_chunks().cast(pa.large_string()), answers["value"].filter(others).to_numpy())
        del answers, packed, is_code, others
        total, m, n_known, base = (np.zeros(len(column)) for _ in range(4))
        for at, texts in slices(column):
            k, own = len(texts), slice(at, at + len(texts))
            for code, owner in grams(texts):
                total[own] += np.bincount(owner, look(code), k)
            found, bounds = token_words(texts)
            text, c = np.repeat(np.arange(k), np.diff(bounds)), counts(found)
            m[own] = np.diff(bounds) + 1
            n_known[own] = np.bincount(text, c > 0, k) + (1 if ends else 0)
            base[own] = np.bincount(text, np.log10(c + 1), k) + math.log10(ends + 1) - m[own] * scale
        kept = [c for c in rows.column_names if c not in ("training", "text")]
        results = [m.astype(np.int64), n_known.astype(np.int64), np.full(len(column), n, np.int64), base, total / math.log(10)]
        return pa.table([*[rows[c] for c in kept], *map(pa.array, results)], [*kept, *[f"r_{r}" for r in RESULTS]])

    return score


def score_texts(docs: DataFrame, training: Column, text: str = "text", part_bytes: int = 20_000_000) -> DataFrame:
    """The columns of ``docs`` besides the text, and ``RESULTS``: the words' counts and base score, and the model's log10 probability.

    The model learns from the rows that ``training`` marks and scores all of them.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.coalesce(training, F.lit(False)).alias("training"), whole(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    few = max(rows.sparkSession.sparkContext.defaultParallelism, size // part_bytes + 1)
    held = stored(rows.coalesce(few).mapInArrow(parts_of(part_bytes), "part int, code long, word string, n long, packed binary"))
    codes = stored(held.filter("code is not null").groupBy("code").agg(F.sum("n").alias("n")))
    # a word has one row for each part, so no word has more rows than there are parts
    one = Window.partitionBy("word")
    words = held.filter("word is not null").select("part", "word", "n", F.sum("n").over(one).alias("c"), (F.min("part").over(one) == F.col("part")).alias("first"))
    words = stored(words.filter("c > 0 and (first or c <> n)"))
    n, v = words.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    packed = held.filter("packed is not null").select("part", "packed", "n")
    ends = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    answers = held.filter("code is not null").select("part", "code").join(log_probabilities(codes), "code").select("part", "code", F.lit(None).cast("string").alias("word"), F.col("log_p").alias("value"))
    known = words.filter("c <> n").select("part", F.lit(None).cast("long").alias("code"), "word", F.col("c").cast("double").alias("value"))
    kinds = ", ".join([*[f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)], *[f"r_{r} {'double' if 'score' in r else 'long'}" for r in RESULTS]])
    both = packed.select("part", "packed").toDF("p", "packed").groupBy("p").cogroup(answers.union(known).groupBy("part"))
    out = both.applyInArrow(scorer(n + ends, v + (1 if ends else 0), ends), kinds)
    return restored(out, rest, RESULTS)
