"""Repair of the turn structure of conversations by edits of least cost.

A conversation is its rows by turn (nulls first; rows of one turn by role, then text). A row
is blank (no visible character), else a duplicate (role and text seen earlier), else truncated
(its last visible character ends no sentence). Rows are kept, given another role, deleted (a must
for the blank and the duplicate), and empty turns are inserted, until the roles read ``(s?(ua)+)?``
by their initials. Among the cheapest edits the ASCII-least letters win.

Each conversation becomes a short code, one character for each row, and only codes go to Python. There every path
through the edits has one integer for a weight: its high digits are the cost, the low ones spell the letters
of the edits from the left in digits of three bits, and places after the last letter are zero. So the smaller
integer is the cheaper path, and of equally cheap ones the lesser word. Going back from the end, a node (row,
place in the pattern) takes the minimum over its edges of ordinary integers; an edge adds its cost and puts its letters before
the digits of what follows. The integers have as many digits as a conversation has edits, so the work grows with the square of a
conversation's rows. From ``long`` rows on costs alone are minimised, and the least word is then read from the start
along all cheapest paths at once: at each letter the paths have used the same rows, so a row and a set of the four places
is all there is to follow. Both give the same edits.

A null role or text counts as one space, a null turn sorts first, and a null conversation key is one conversation.
A role whose initial is none of s, u and a can't be kept. A conversation without rows has no edits. An empty table
gives no rows. Columns other than the four aren't read. The unit is the conversation, whose repaired text is
one value: one conversation must fit in a task, as one text must.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES

VISIBLE = r"[^\x20\x09-\x0D]"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3

# Places in the pattern: nothing yet, after the system turn, after a user turn, after a pair. Only the first and the last may end.
START, SYSTEM, USER, PAIR = range(4)
NEXT = {START: (USER, "u"), SYSTEM: (USER, "u"), USER: (PAIR, "a"), PAIR: (USER, "u")}
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
WIDTH, LONG = 3, 2000


def edges(row: str, place: int) -> list[tuple[int, str, int]]:
    """(cost, letter, next place) of the edits of one row. Its code is the initial, upper case if truncated, or ``-`` where it must go."""
    out = [(DELETE, "D", place)]
    if row != "-":
        cut, initial = (CUT, row.lower()) if row.isupper() else (0, row)
        to, wanted = NEXT[place]
        out.append((REROLE + cut, "R", to))
        if initial == wanted:
            out.append((cut, "K", to))
        if initial == "s" and place == START:
            out.append((cut, "K", SYSTEM))
    return out


def inserted(place: int) -> list[tuple[int, str, int]]:
    """Inserts before a row: none, one or two; a third would only lead back to a place already reached."""
    one = NEXT[place][0]
    return [(0, "", place), (INSERT, "I", one), (2 * INSERT, "II", NEXT[one][0])]


def least_weight(code: str) -> tuple[int, str]:
    """(cost, letters) by the minimum of integers over the paths from each node, last row first."""
    high = WIDTH * (3 * len(code) + 2)  # below it as many letters as a path can have
    digit = {x: d << high - WIDTH for x, d in DIGIT.items()}
    low = (1 << high) - 1

    def before(cost: int, letters: str, weight: int) -> int:
        for x in reversed(letters):
            weight = (weight >> high << high) + digit[x] + ((weight & low) >> WIDTH)
        return weight + (cost << high)

    row_before = lambda x, w: (w >> high << high) + x + ((w & low) >> WIDTH)
    ends = {START: 0, PAIR: 0}
    best = [min(before(c, x, ends[to]) for c, x, to in inserted(p) if to in ends) for p in range(4)]
    for row in reversed(code):
        taken = [min(row_before(digit[x], best[to]) + (c << high) for c, x, to in edges(row, p)) for p in range(4)]
        best = [min(before(c, x, taken[to]) for c, x, to in inserted(p)) for p in range(4)]
    word, name = best[START] & low, {d: x for x, d in DIGIT.items()}
    digits = (word >> k & (1 << WIDTH) - 1 for k in range(high - WIDTH, -1, -WIDTH))
    return best[START] >> high, "".join(name[d] for d in digits if d)


def least_word(code: str) -> tuple[int, str]:
    """The same in time that grows with the rows: costs from the end, then the least letters along all cheapest paths."""
    togo = [[0] * 4 for _ in range(len(code) + 1)]  # with inserts, before each row
    after = [[0] * 4 for _ in code]  # without
    togo[-1] = [min(c for c, _, to in inserted(p) if to in (START, PAIR)) for p in range(4)]
    for i in range(len(code) - 1, -1, -1):
        after[i] = [min(c + togo[i + 1][to] for c, _, to in edges(code[i], p)) for p in range(4)]
        togo[i] = [min(c + after[i][to] for c, _, to in inserted(p)) for p in range(4)]
    out, at, i, left = [], {START}, 0, togo[0][START]
    while i < len(code) or not (left == 0 and at & {START, PAIR}):
        found: dict[str, set[tuple[int, int]]] = {}
        for p in at:
            if i < len(code):
                for c, x, to in edges(code[i], p):
                    if c + togo[i + 1][to] == left:
                        found.setdefault(x, set()).add((to, c))
            if INSERT + togo[i][NEXT[p][0]] == left:
                found.setdefault("I", set()).add((NEXT[p][0], INSERT))
        x = min(found)
        out.append(x)
        left = min(left - c for _, c in found[x])
        at = {to for to, c in found[x]}
        i += x != "I"
    return togo[0][START], "".join(out)


def turns(letters: str) -> tuple[list[int], list[str | None]]:
    """For each turn of the repaired conversation its row (-1: inserted) and its new role (None: its own)."""
    source, row = [], 0
    for x in letters:
        if x != "D":
            source.append((row if x != "I" else -1, x == "K"))
        row += x != "I"
    odd = len(source) % 2  # then a system turn leads
    return [r for r, _ in source], [None if own else ("user", "assistant")[(k - odd) % 2] for k, (_, own) in enumerate(source)]


def planned(long: int = LONG):  # noqa: ANN201
    @F.pandas_udf("cost long, audit string, source array<int>, role array<string>")
    def plan(codes: pd.Series) -> pd.DataFrame:
        once = {c: least_weight(c) if len(c) < long else least_word(c) for c in codes.unique()}
        return pd.DataFrame([(*once[c], *turns(once[c][1])) for c in codes], columns=["cost", "audit", "source", "role"])

    return plan


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, long: int = LONG) -> DataFrame:
    """One row for each conversation: its key, gaps, blank, duplicate, truncated, illegal, cost, audit, and repaired, an array of (role, text).

    Rows for which ``present`` isn't true count as gone; their conversation stays in the result.
    """
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    flat = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), here.alias("here")).repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "here", "role", "text").orderBy("turn"))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(~F.col("text").rlike(VISIBLE), BLANK).when(F.col("copy") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    flat = flat.withColumn("copy", seen).withColumn("fault", fault)
    row = F.when(F.col("here"), F.struct("turn", "role", "text", "copy", "fault"))
    number = F.when(F.col("here"), F.col("turn"))
    span = F.coalesce(F.max(number) - F.min(number) + 1, F.lit(0)) - F.size(F.collect_set(number))
    count = lambda k: F.count_if(F.col("here") & (F.col("fault") == k))
    one = flat.groupBy("conv").agg(span.alias("gaps"), *[count(k).alias(n) for n, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))], F.array_sort(F.collect_list(row)).alias("rows"))
    initials = F.transform("rows", lambda r: F.substring(r["role"], 1, 1))
    pairs = F.zip_with(initials, F.slice(initials, F.lit(2), F.size("rows")), lambda a, b: F.concat(a, b))

    def code(r: Column) -> Column:
        initial = F.substring(r["role"], 1, 1)
        known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
        return F.when(r["fault"].isin(BLANK, DUPLICATE), "-").when(r["fault"] == TRUNCATED, F.upper(known)).otherwise(known)

    one = one.withColumns({"illegal": F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long"), "code": F.array_join(F.transform("rows", code), "")})
    one = one.withColumn("plan", planned(long)("code"))
    turn_of = lambda at, new: F.struct(F.coalesce(new, F.get("rows", at)["role"]).alias("role"), F.when(at >= 0, F.get("rows", at)["text"]).otherwise("").alias("text"))
    repaired = F.zip_with("plan.source", "plan.role", turn_of)
    return one.select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "plan.cost", "plan.audit", repaired.alias("repaired"))
