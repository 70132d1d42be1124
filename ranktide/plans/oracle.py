"""SQL for DuckDB that says the same as the operators, in its own way: plain windows over rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from ranktide.functions.gauss import ERFC

Z95 = NormalDist().inv_cdf(0.975)


def part(keys: Sequence[str], *more: str) -> str:
    return "PARTITION BY " + (", ".join([*keys, *more]) or "(1 = 1)")


def head(keys: Sequence[str]) -> str:
    return "".join(f"{k}, " for k in keys)


def group(keys: Sequence[str]) -> str:
    return f"GROUP BY {', '.join(keys)}" if keys else ""


def using(keys: Sequence[str]) -> str:
    return f"USING ({', '.join(keys)})" if keys else "ON (1 = 1)"


def rank(v: str, keys: Sequence[str] = ()) -> str:
    return f"(RANK() OVER ({part(keys)} ORDER BY {v}) + (COUNT(*) OVER ({part(keys, v)}) - 1) / 2.0E0)"


def rga(rel: str, keys: Sequence[str] = (), y: str = "y", z: str = "z") -> str:
    """keys, n, rga; null for a constant target."""
    return f"""(SELECT {head(keys)}COUNT(*) AS n, CASE WHEN MIN(_y) < MAX(_y) THEN 0.5E0 + SUM(c * rz) / (2.0E0 * SUM(c * ry)) END AS rga FROM (
      SELECT {head(keys)}{y} AS _y, {y} - AVG({y}) OVER ({part(keys)}) AS c, {rank(y, keys)} AS ry, {rank(z, keys)} AS rz FROM {rel}) {group(keys)})"""


def rga_w(rel: str, keys: Sequence[str], y: str, z: str, w: str) -> str:
    """Weighted; weights are scaled to mean 1 in each key."""
    wr = lambda v: f"(SUM(ww) OVER ({part(keys)} ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (SUM(ww) OVER ({part(keys, v)}) - 1) / 2.0E0)"
    return f"""(SELECT {head(keys)}COUNT(*) AS n, CASE WHEN MIN(_y) < MAX(_y) THEN 0.5E0 + SUM(ww * (_y - mu) * rz) / (2.0E0 * SUM(ww * (_y - mu) * ry)) END AS rga FROM (
      SELECT {head(keys)}{y} AS _y, ww, SUM(ww * {y}) OVER ({part(keys)}) / SUM(ww) OVER ({part(keys)}) AS mu, {wr(y)} AS ry, {wr(z)} AS rz
      FROM (SELECT *, {w} * COUNT(*) OVER ({part(keys)}) / SUM({w}) OVER ({part(keys)}) AS ww FROM {rel})) {group(keys)})"""


def jackknife(rel: str, keys: Sequence[str] = (), y: str = "y", z: str = "z", extra: str = "row_id") -> str:
    """extra, keys, value: the measure without each row."""
    upto = lambda v: f"SUM({y}) OVER ({part(keys)} ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    side = lambda p, r, c, u: f"({p} - _y * {r} - (sy - {c}) - 0.5E0 * ({u} - _y) - (sy - _y) / (m - 1) * ((m - 1) * m / 2.0E0))"
    return f"""(SELECT {head(keys)}{extra}, _y, 0.5E0 + {side('pz', 'rz', 'cz', 'uz')} / (2.0E0 * {side('py', 'ry', 'cy', 'uy')}) AS value FROM (
      SELECT *, SUM(_y * rz) OVER ({part(keys)}) AS pz, SUM(_y * ry) OVER ({part(keys)}) AS py, SUM(_y) OVER ({part(keys)}) AS sy, COUNT(*) OVER ({part(keys)}) AS m FROM (
        SELECT {head(keys)}{extra}, {y} AS _y, {rank(z, keys)} AS rz, {rank(y, keys)} AS ry, {upto(z)} AS cz, {upto(y)} AS cy, SUM({y}) OVER ({part(keys, z)}) AS uz, SUM({y}) OVER ({part(keys, y)}) AS uy FROM {rel})))"""


def influence(rel: str, keys: Sequence[str] = (), y: str = "y", z: str = "z", extra: str = "row_id") -> str:
    above = lambda v: f"(SUM({y}) OVER ({part(keys)}) - SUM({y}) OVER ({part(keys)} ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    return f"""(SELECT {head(keys)}{extra}, iz / (2.0E0 * d) - num * iy / (2.0E0 * d * d) AS value FROM (
      SELECT *, psz - mu / 2 AS num, psy - mu / 2 AS d, _y * fz + tz - 2 * psz - (_y - mu) / 2 AS iz, _y * fy + ty - 2 * psy - (_y - mu) / 2 AS iy FROM (
        SELECT *, AVG(_y * fz) OVER ({part(keys)}) AS psz, AVG(_y * fy) OVER ({part(keys)}) AS psy, AVG(_y) OVER ({part(keys)}) AS mu FROM (
          SELECT {head(keys)}{extra}, {y} AS _y, ({rank(z, keys)} - 0.5E0) / COUNT(*) OVER ({part(keys)}) AS fz, ({rank(y, keys)} - 0.5E0) / COUNT(*) OVER ({part(keys)}) AS fy,
            ({above(z)} + 0.5E0 * SUM({y}) OVER ({part(keys, z)})) / COUNT(*) OVER ({part(keys)}) AS tz, ({above(y)} + 0.5E0 * SUM({y}) OVER ({part(keys, y)})) / COUNT(*) OVER ({part(keys)}) AS ty FROM {rel}))))"""


def estimate(rel: str, keys: Sequence[str] = (), y: str = "y", z: str = "z", extra: str = "row_id") -> str:
    """keys, n, rga, se by jackknife."""
    return f"(SELECT {head(keys)}n, rga, SQRT((n - 1) * v) AS se, (n - 1) * (m - rga) AS bias FROM {rga(rel, keys, y, z)} a JOIN (SELECT {head(keys)}VAR_POP(value) AS v, AVG(value) AS m FROM {jackknife(rel, keys, y, z, extra)} {group(keys)}) b {using(keys)})"


def uniform(*parts: str) -> str:
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" if not p.startswith("'") else p for p in parts)
    return f"((CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) + 0.5E0) / 4503599627370496.0E0)"


def normal(*parts: str) -> str:
    return f"(SQRT(-2.0E0 * LN({uniform(chr(39) + 'r' + chr(39), *parts)})) * COS(6.283185307179586E0 * {uniform(chr(39) + 'a' + chr(39), *parts)}))"


def two_sided(z: str) -> str:
    x = f"(ABS({z}) / {math.sqrt(2)!r}E0)".replace("E0)", ")")
    t = f"(1.0E0 / (1.0E0 + 0.5E0 * {x}))"
    s = f"({ERFC[-1]!r})"
    for c in ERFC[-2::-1]:
        s = f"(({c!r}) + {t} * {s})"
    return f"({t} * EXP(-{x} * {x} + {s}))"


def upper(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 0.5E0 * {two_sided(z)} ELSE 1.0E0 - 0.5E0 * {two_sided(z)} END)"
