"""Queries by name, each beside SQL text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cellweave.sources.views import VIEWS, sql

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, text: str | None = None) -> Callable:
    """Registers a function of a view getter ``t(name)``; ``<view>`` in the text stands for a view."""

    def keep(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        from cellweave.sources.views import view

        QUERIES[name] = lambda spark, sf_dir: f(lambda table: view(spark, sf_dir, table))
        if text:
            ORACLE[name] = filled(text)
        return f

    return keep


def filled(text: str) -> str:
    for v in VIEWS:
        text = text.replace(f"<{v}>", f"({sql(v)}) AS {v}")
    return text


def cell_sql(source: str, res: int, x: str = "x", y: str = "y", name: str = "cell") -> str:
    """SQL that adds the hexagonal cell of (x, y) to the columns of ``source``."""
    from cellweave.functions.cells import BIAS, EDGE_METRES, ROOT3, SHIFT

    a = EDGE_METRES[res]
    one = f"SELECT *, ({x} * {ROOT3 / 3!r}::DOUBLE - {y} / 3) / {a!r}::DOUBLE AS _q, ({y} * 2 / 3) / {a!r}::DOUBLE AS _r FROM {source}"
    two = f"SELECT *, -_q - _r AS _s FROM ({one})"
    three = f"SELECT *, floor(_q + 0.5)::BIGINT AS _rq, floor(_r + 0.5)::BIGINT AS _rr, floor(_s + 0.5)::BIGINT AS _rs FROM ({two})"
    four = f"SELECT *, abs(_rq - _q) AS _dq, abs(_rr - _r) AS _dr, abs(_rs - _s) AS _ds FROM ({three})"
    five = f"SELECT *, CASE WHEN _dq > _dr AND _dq > _ds THEN -_rr - _rs ELSE _rq END AS _cq, CASE WHEN NOT (_dq > _dr AND _dq > _ds) AND _dr > _ds THEN -_rq - _rs ELSE _rr END AS _cr FROM ({four})"
    pack = f"({res << SHIFT} + _cq + {BIAS}) * {1 << SHIFT} + _cr + {BIAS}"
    return f"(SELECT * EXCLUDE (_q, _r, _s, _rq, _rr, _rs, _dq, _dr, _ds, _cq, _cr), {pack} AS {name} FROM ({five}))"


def centre_sql(source: str, res: int, cell: str = "cell", x: str = "cx", y: str = "cy") -> str:
    from cellweave.functions.cells import BIAS, EDGE_METRES, ROOT3, SHIFT

    a, mask = EDGE_METRES[res], (1 << SHIFT) - 1
    q, r = f"((({cell} >> {SHIFT}) & {mask}) - {BIAS})", f"(({cell} & {mask}) - {BIAS})"
    return f"(SELECT *, ({q} + {r} / 2.0::DOUBLE) * {a * ROOT3!r}::DOUBLE AS {x}, {r} * {a * 1.5!r}::DOUBLE AS {y} FROM {source})"


def parent_sql(source: str, res: int, to: int, cell: str = "cell", name: str = "up") -> str:
    """SQL that adds the ancestor at resolution ``to``, one level at a time."""
    now = f"(SELECT *, {cell} AS {name} FROM {source})"
    for r in range(res - 1, to - 1, -1):
        inner = centre_sql(now, r + 1, name, "_cx", "_cy")
        now = f"(SELECT * EXCLUDE (_cx, _cy, {name}, _new), _new AS {name} FROM {cell_sql(inner, r, '_cx', '_cy', '_new')})"
    return now
