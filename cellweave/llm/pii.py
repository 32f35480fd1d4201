"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

The patterns give base spans. The field labels the words that hold a digit,
@, (at) or + and the words beside them with one of the kinds or none. Potentials:
features of a word's form, pairs of neighbours, and skip links between one
occurrence of a word (compared by its digits, or else lower-cased) and the
next, however far away, which make a document label them alike. Loopy
sum-product passes messages over both kinds of links; runs of words with a
marginal of at least ``certain`` for one kind become spans unless they touch a
base span. The potentials are fitted by pseudo-likelihood in numpy on at most
``max_docs`` texts and ``max_bytes`` of text, one for each of the smallest key hashes among those with a
digit or @, labelled by the patterns, and on a made text for each of them that
has spans: there its values stand in forms that no pattern finds, labelled as
what they are, with or without the value as it was, among ordinary numbers,
labelled as none.

Nulls count as empty texts without spans. Offsets are code points, the end is
exclusive. Repeated rows get equal spans. Without sample texts no span is added.
"""

from __future__ import annotations

import pickle
import random
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import restored, whole

# The kinds in order and the patterns behind them.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AT = re.compile(r"[(\[]at[)\]]", re.IGNORECASE)
NONE = len(KINDS)
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Each @ with the run before it, back to the last match, and the domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Graph(NamedTuple):
    words: list[tuple[int, int]]  # start, end
    features: np.ndarray
    chain: np.ndarray  # pairs of neighbours
    skip: np.ndarray  # pairs of occurrences


STEPS = (0, 1, 4, 7, 10, 14, 20)


def form(word: str) -> list[float]:
    digits = DIGIT.findall(word)
    n = len(digits)
    bucket = max(i for i, s in enumerate(STEPS) if n >= s)
    bare = re.sub(r"[ ().+-]", "", word.rstrip(".,;:"))
    flags = [
        "@" in word, "." in word.rstrip("."), word.rstrip(".").count(".") == 3, "-" in word, word.startswith("+"), "(" in word or ")" in word,
        AT.search(word) is not None, "[.]" in word, word.count(",") == 3, bare.isdigit(), any(c.isalpha() for c in word), len(word) > 12, len(word) > 24, n >= 14 and n <= 19 and luhn("".join(digits)), n == len(word),
    ]
    return [1.0, *[float(i == bucket) for i in range(len(STEPS))], *map(float, flags)]


WIDTH = len(form("a"))


def graph(text: str) -> Graph | None:
    """Nodes around the words with a digit, @, (at) or +; None without one."""
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    hot = [i for i, (a, b) in enumerate(spans) if DIGIT.search(text, a, b) or text.find("@", a, b) >= 0 or text[a] == "+" or AT.search(text, a, b)]
    if not hot:
        return None
    nodes = sorted({j for i in hot for j in (i - 1, i, i + 1) if 0 <= j < len(spans)})
    words = [text[spans[i][0] : spans[i][1]] for i in nodes]
    chain = [(k, k + 1) for k in range(len(nodes) - 1) if nodes[k + 1] == nodes[k] + 1]
    last: dict[str, int] = {}
    skip = []
    for k, w in enumerate(words):
        digits = "".join(DIGIT.findall(w))
        name = digits if len(digits) >= 6 else w.lower().strip(".,;:()")
        if len(name) >= 6:
            if name in last and last[name] != k - 1:
                skip.append((last[name], k))
            last[name] = k
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph([spans[i] for i in nodes], np.array([form(w) for w in words]), pairs(chain), pairs(skip))


class Field(NamedTuple):
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, left to right
    skip: np.ndarray  # labels x labels, symmetric


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gold(g: Graph, spans: list[Span]) -> np.ndarray:
    out = np.full(len(g.words), NONE)
    for a, k, b in spans:
        for i, (s, e) in enumerate(g.words):
            if s < b and a < e:
                out[i] = k
    return out


def disguised(kind: int, value: str, pick: random.Random) -> str:
    """The value in a form that the patterns are not made for."""
    if kind == 0:
        return value.replace("@", pick.choice(("(at)", "[at]")))
    if kind == 1:
        return value.replace(".", pick.choice(("[.]", ",")))
    if kind == 2:
        digits = "".join(DIGIT.findall(value))
        return pick.choice("./_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return pick.choice(("", "00")) + value[1:]


def ordinary(pick: random.Random) -> str:
    """A number that is nobody's: date, time, amount, version, measure, count, or 16 digits that fail the Luhn test."""
    n = pick.randrange
    digits = str(n(10**15, 10**16))
    if luhn(digits):
        digits = digits[:-1] + str((int(digits[-1]) + 1) % 10)
    grouped = pick.choice("./_").join(digits[i : i + 4] for i in range(0, 16, 4))
    return pick.choice([
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(24):02}:{n(60):02}:{n(60):02}", f"{n(1, 999)},{n(1000):03},{n(1000):03}", f"{n(20)}.{n(20)}.{n(20)}", f"{n(90)}.{n(10**4):04}",
        str(n(10 ** n(1, 13))), f"{n(100, 1000)}-{n(100, 1000)}", digits, grouped,
    ])


def made(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """A text of the spans' values in disguise, half of them after the value itself, among plain words and ordinary numbers; always the same."""
    pick = random.Random(zlib.crc32(text.encode()))
    plain = [w for w in WORD.findall(text) if not DIGIT.search(w) and "@" not in w][:200] or ["and"]
    out: list[str] = []
    labels: list[Span] = []
    at = 0

    def put(piece: str, kind: int = NONE) -> None:
        nonlocal at
        if kind != NONE:
            labels.append((at, kind, at + len(piece)))
        out.append(piece)
        at += len(piece) + 1

    for a, k, b in spans:
        form = disguised(k, text[a:b], pick)
        if base_spans(form):
            continue
        pieces = [(form, k), (ordinary(pick), NONE), (ordinary(pick), NONE)] + [(text[a:b], k)] * pick.randrange(2)
        pick.shuffle(pieces)
        for piece, kind in pieces:
            for _ in range(pick.randrange(1, 4)):
                put(pick.choice(plain))
            put(piece + pick.choice(("", "", ".", ",")) if kind == NONE else piece, kind)
        put(pick.choice(plain))
    return " ".join(out), labels


def examples(texts: list[str]) -> list[tuple[str, list[Span]]]:
    """Texts with their labelled spans: as they are, and made ones."""
    out = []
    for text in texts:
        spans = base_spans(text)
        out.append((text, spans))
        if spans:
            out.append(made(text, spans))
    return out


def fit(labelled: list[tuple[str, list[Span]]], rounds: int = 200, rate: float = 0.5) -> Field:
    """Pseudo-likelihood: each label given the labels of its neighbours on both kinds of links."""
    labels, parts, n = NONE + 1, [], 0
    for text, spans in labelled:
        if g := graph(text):
            parts.append((g, gold(g, spans), n))
            n += len(g.words)
    field = Field(np.zeros((WIDTH, labels)), np.zeros((labels, labels)), np.zeros((labels, labels)))
    if not n:
        return field
    x, y = np.concatenate([g.features for g, _, _ in parts]), np.concatenate([v for _, v, _ in parts])
    chain, skip = (np.concatenate([getattr(g, name) + at for g, _, at in parts]) for name in ("chain", "skip"))
    hot = np.eye(labels)[y]
    before, after, beside = np.zeros((n, labels)), np.zeros((n, labels)), np.zeros((n, labels))
    np.add.at(before, chain[:, 1], hot[chain[:, 0]])
    np.add.at(after, chain[:, 0], hot[chain[:, 1]])
    np.add.at(beside, skip[:, 0], hot[skip[:, 1]])
    np.add.at(beside, skip[:, 1], hot[skip[:, 0]])
    unary, link, same = field
    squares = [np.full(w.shape, 1e-6) for w in field]
    for _ in range(rounds):
        error = hot - softmax(x @ unary + before @ link + after @ link.T + beside @ same)
        s = beside.T @ error
        grads = [x.T @ error / n - 1e-4 * unary, (before.T @ error + error.T @ after) / n - 1e-4 * link, (s + s.T) / n - 1e-4 * same]
        for w, g, q in zip(field, grads, squares, strict=True):
            q += g * g
            w += rate * g / np.sqrt(q)
    return field


def marginals(field: Field, g: Graph, rounds: int = 8) -> np.ndarray:
    """Loopy sum-product: every round each link's two messages are renewed from the last round's."""
    own = g.features @ field.unary
    ends = np.concatenate([g.chain, g.skip])
    if not len(ends):
        return softmax(own)
    tables = np.concatenate([np.broadcast_to(field.chain, (len(g.chain), *field.chain.shape)), np.broadcast_to(field.skip, (len(g.skip), *field.skip.shape))])
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    tables = np.exp(np.concatenate([tables, tables.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
    sent = np.zeros((len(source), own.shape[1]))
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, target, sent)
        cavity = softmax(belief[source] - sent[back])
        sent = np.log(np.einsum("ea,eab->eb", cavity, tables) + 1e-300)
        sent -= sent.max(axis=1, keepdims=True)
    belief = own.copy()
    np.add.at(belief, target, sent)
    return softmax(belief)


def added_spans(field: Field, text: str, base: list[Span], certain: float) -> list[Span]:
    g = graph(text)
    if g is None or not field.unary.any():
        return []
    p = marginals(field, g)
    label, sure = p.argmax(1), p.max(1) >= certain
    linked = set(map(tuple, g.chain.tolist()))
    out, i = [], 0
    while i < len(label):
        j = i
        if sure[i] and label[i] != NONE:
            while (j, j + 1) in linked and sure[j + 1] and label[j + 1] == label[i]:
                j += 1
            a, b = g.words[i][0], g.words[j][1]
            while b > a + 1 and text[b - 1] in ".,;:":
                b -= 1
            if not any(s < b and a < e for s, _, e in base):
                out.append((a, int(label[i]), b))
        i = j + 1
    return out


def finder(field: Field, certain: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        rows = lambda s: [{"start": a, "kind": k, "end": b} for a, k, b in s]
        for b in batches:
            base, every = [], []
            for text in b.column("text").to_pylist():
                spans, more = [], []
                if "@" in text or DIGIT.search(text) or AT.search(text):
                    spans = base_spans(text)
                    more = added_spans(field, text, spans, certain)
                base.append(rows(spans))
                every.append(rows(sorted(spans + more)))
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(base, span), pa.array(every, span)], [*names, "r_base_spans", "r_pii_spans"])

    return find


def fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task fits the field on the bounded sample it gets and returns its tables, packed."""
    texts = sorted(t for b in batches for t in b.column("t").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(fit(examples(texts))))], pa.binary())], ["field"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = 2000, max_bytes: int = 8_000_000) -> Field:
    """A field fitted on at most ``max_docs`` texts with a digit or @, one for each of the keys with the smallest hashes.

    Of these, in the order of the keys' hashes, at most ``max_bytes`` of text are used, but one text at
    least; of a key with several texts always the same one. One task fits, only the field's tables, whose size is fixed, reach the driver.
    """
    rows = docs.select(F.col(key).alias("k"), whole(text).alias("t")).filter(F.col("k").isNotNull() & F.col("t").rlike("[0-9@]"))
    few = rows.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(max_docs)
    one = rows.join(F.broadcast(few), "k").groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("x")).select("k", F.col("x.t").alias("t"))
    size = F.octet_length("t").cast("long")
    before = F.sum(size).over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("k"), "k")) - size  # of max_docs rows at most
    used = one.withColumn("before", before).filter(F.col("before") < max_bytes).select("t")
    got = used.repartition(1).mapInArrow(fitter, "field binary").collect()
    return Field(*pickle.loads(got[0]["field"])) if got else fit([])


def find_pii(docs: DataFrame, field: Field, text: str = "text", certain: float = 0.9) -> DataFrame:
    """Adds base_spans and pii_spans to the columns besides the text: arrays of (start, kind, end).

    A result whose name is taken gets an underscore at its end.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], whole(text).alias("text"))
    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(rest))
    span = "array<struct<start: bigint, kind: int, end: bigint>>"
    return restored(rows.mapInArrow(finder(field, certain), f"{kinds}r_base_spans {span}, r_pii_spans {span}"), rest, ("base_spans", "pii_spans"))
