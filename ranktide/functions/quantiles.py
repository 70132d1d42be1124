"""Exact quantiles by counting: brackets around the wanted places are narrowed until few rows are left in them.

A pass asks for approximate quantiles inside each bracket, the next counts what lies below, at and between them, so the place is known to be in a
smaller bracket whatever the approximation.  Only when a bracket holds ``LIMIT`` rows or fewer are its values looked at one by one.
All columns and places share the passes; no task holds or sorts more than ``LIMIT`` values of a bracket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 10_000
ACCURACY = 10_000


@dataclass
class _Bracket:
    """Values above ``lo`` and below ``hi``, both left out; ``base`` rows lie at ``lo`` or below, ``rows`` inside."""

    column: str
    place: int
    lo: float
    hi: float
    base: int
    rows: int
    found: float | None = None

    def inside(self) -> Column:
        return (F.col(self.column) > self.lo) & (F.col(self.column) < self.hi)


def _narrowed(d: DataFrame, open_: list[_Bracket]) -> None:
    near = {}
    for k, b in enumerate(open_):
        at, off = (b.place - b.base + 0.5) / b.rows, 2.0 / ACCURACY
        near[f"q{k}"] = F.percentile_approx(F.when(b.inside(), F.col(b.column)), [max(0.0, at - off), min(1.0, at + off)], ACCURACY)
    ends = d.agg(*[c.alias(n) for n, c in near.items()]).first()
    counts = []
    for k, b in enumerate(open_):
        x, (lo, hi) = F.col(b.column), ends[f"q{k}"]
        here = [x < lo, x == lo, (x > lo) & (x < hi), (x == hi) & (x > lo)]
        counts += [F.count_if(b.inside() & c).alias(f"c{k}_{i}") for i, c in enumerate(here)]
    n = d.agg(*counts).first()
    for k, b in enumerate(open_):
        lo, hi = ends[f"q{k}"]
        c, at = [n[f"c{k}_{i}"] for i in range(4)], b.place - b.base
        if at < c[0]:
            b.hi, b.rows = lo, c[0]
        elif at < c[0] + c[1]:
            b.found = lo
        elif at < sum(c[:3]):
            b.lo, b.hi, b.base, b.rows = lo, hi, b.base + c[0] + c[1], c[2]
        elif at < sum(c):
            b.found = hi
        else:
            b.lo, b.base, b.rows = hi, b.base + sum(c), b.rows - sum(c)


def exact(df: DataFrame, values: dict[str, Column], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """For each named column of doubles its quantiles at the shares, between neighbours by their distance, over finite values; None without any."""
    if not values:
        return {}
    d = df.select(*[F.when(F.abs(c) < math.inf, c).alias(f"_v{i}") for i, c in enumerate(values.values())])
    n = d.agg(*[F.count(c).alias(c) for c in d.columns]).first()
    brackets = {}
    for c in d.columns:
        for p in shares if n[c] else ():
            at = p * (n[c] - 1)
            for place in {math.floor(at), math.ceil(at)}:
                brackets[c, place] = _Bracket(c, place, -math.inf, math.inf, 0, n[c])
    while open_ := [b for b in brackets.values() if b.found is None and b.rows > LIMIT]:
        _narrowed(d, open_)
    last = [b for b in brackets.values() if b.found is None]
    if last:
        small = {(b.column, b.lo, b.hi): b for b in last}
        lists = d.agg(*[F.sort_array(F.collect_list(F.when(b.inside(), F.col(b.column)))).alias(f"l{k}") for k, b in enumerate(small.values())]).first()
        at = {s: lists[f"l{k}"] for k, s in enumerate(small)}
        for b in last:
            b.found = at[b.column, b.lo, b.hi][b.place - b.base]
    out = {}
    for name, c in zip(values, d.columns, strict=True):
        places = [p * (n[c] - 1) for p in shares]
        ends = [(brackets[c, math.floor(h)].found, brackets[c, math.ceil(h)].found, h - math.floor(h)) for h in places] if n[c] else []
        out[name] = [lo + part * (hi - lo) for lo, hi, part in ends] if n[c] else None
    return out
