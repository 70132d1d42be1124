"""Bootstrap replicates without a row for each row and replicate.

A row carries one vector: how often each replicate drew it, packed into bits.  Draws are exact multinomial ones.  Rows lie in parts of
``PART`` places by row id; a replicate's draws are first dealt to the parts by hashed places of the whole key, which needs the counts only,
and then to the rows of a part by hashed places of that part, where the part lies.  A key of one part has only the second step.

The measure of all replicates comes from one sorted pass over each ordering: parts of the value (``ranks.part_of``) are summed into vectors over
replicates, and only these vectors, three numbers a part and replicate, are put together by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.functions.hashing import SCALE, uniform
from ranktide.functions.ranks import SALTS, Cuts, by_number, cut_points, ranges_for, side_rows
from ranktide.operators.measure import from_sums, on

#: Places of a part, places whose draws one replicate hashes for the parts in one row of work, draws that a task is meant to hash for them, and rows and numbers that are unpacked at a time.
PART = 4096
BLOCK = 1 << 16
DEALT = 1 << 19
CHUNK = 512
UNPACKED = 1 << 22


def packed(counts: np.ndarray) -> list[bytes]:
    """A byte string for each row of counts: the number of bit planes, then the planes."""
    planes = max(1, int(counts.max(initial=0)).bit_length())
    bits = np.hstack([np.packbits((counts >> k & 1).astype(np.uint8), axis=1) for k in range(planes)])
    return [bytes([planes]) + row.tobytes() for row in bits]


def unpacked(rows: Sequence[bytes], replicates: int) -> np.ndarray:
    """rows x replicates."""
    width = -(-replicates // 8)
    out = np.zeros((len(rows), replicates))
    planes = np.array([r[0] for r in rows])
    for k in range(int(planes.max(initial=0))):
        has = np.flatnonzero(planes > k)
        bits = np.frombuffer(b"".join(rows[i][1 + k * width : 1 + (k + 1) * width] for i in has), np.uint8).reshape(len(has), width)
        out[has] += np.unpackbits(bits, axis=1, count=replicates).astype(float) * (1 << k)
    return out


def draws(seed: int, part: int, replicate: int, n: int, places: int) -> np.ndarray:
    """Counts of ``n`` draws among the places of a part; its name is left out of the hashed text for the first part."""
    head = f"{seed}:boot:{replicate}:" if part == 0 else f"{seed}:boot:{replicate}:{part}:"
    hashed = np.fromiter((int(md5(f"{head}{j}".encode()).hexdigest()[:13], 16) for j in range(n)), np.int64, n)
    return np.bincount(np.floor((hashed + 0.5) / SCALE * places).astype(np.int64), minlength=places)


def _deal(replicates: int, seed: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rows of a part, and how many draws each replicate has there (none: as many as rows), with their vectors."""

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        part, m = rows.column("_part")[0].as_py() if len(rows) else 0, len(rows)
        order = np.argsort(rows.column("_i").to_numpy())
        given = dict(zip(counts.column("_rep").to_pylist(), counts.column("_c").to_pylist(), strict=True))
        w = np.empty((m, replicates), np.uint16)
        for b in range(replicates):
            w[order, b] = draws(seed, part, b, given.get(b, 0) if given else m, m)
        return rows.drop_columns(["_i", "_part"]).append_column("_drawn", pa.array(packed(w), pa.binary()))

    return run


def dealers(rows: int, replicates: int) -> int:
    """Tasks that hash the draws of so many rows."""
    return max(1, -(-rows * replicates // DEALT))


def with_draws(df: DataFrame, keys: Sequence[str], values: Sequence[str], row_id: str, replicates: int, seed: int) -> tuple[DataFrame, int]:
    """keys, values and ``_drawn``, the packed vector, for each row; and the number of rows."""
    g = [f"_g{i}" for i in range(len(keys))]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    d = by_number(df.select(*dict.fromkeys([*keys, *values, row_id])), row_id, row_id, keys).withColumn("_i", F.col("_k") - 1).withColumn("_part", F.floor(F.col("_i") / PART))
    d = d.select(*[F.col(k).alias(x) for k, x in zip(keys, g, strict=True)], *[F.col(v).try_cast("double").alias(f"_v{i}") for i, v in enumerate(values)], "_i", "_part")
    largest, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    big = sizes.filter(F.col("_n") > PART).select(*[F.col(k).alias(x) for k, x in zip(keys, g, strict=True)], "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / BLOCK))).alias("_block"))
    # the number of tasks is given, as their rows are few and short before the draws, and would all be put into one task
    big = big.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition(dealers(total or 0, replicates), *g, "_block", "_rep")
    big = big.select(*g, "_n", "_rep", F.explode(F.sequence(F.col("_block") * BLOCK, F.least((F.col("_block") + 1) * BLOCK, "_n") - 1)).alias("_t"))
    dealt = big.groupBy(*g, F.floor(F.floor(uniform(seed, "part", F.col("_rep"), F.col("_t")) * F.col("_n")) / PART).alias("_part"), "_rep").agg(F.count("*").alias("_c"))
    if (largest or 0) <= PART:
        dealt = dealt.filter(F.lit(False))
    schema = ", ".join([*[f"{x} {df.schema[k].dataType.simpleString()}" for k, x in zip(keys, g, strict=True)], *[f"_v{i} double" for i in range(len(values))], "_drawn binary"])
    tasks = dealers(total or 0, replicates)  # given here too: rows are short beside the draws that they stand for
    d, dealt = d.repartition(tasks, *g, "_part"), dealt.repartition(tasks, *g, "_part")
    out = d.groupBy(*g, "_part").cogroup(dealt.groupBy(*g, "_part")).applyInArrow(_deal(replicates, seed), schema)
    return out.select(*[F.col(x).alias(k) for k, x in zip(keys, g, strict=True)], *[c for c in out.columns if c not in g]), total or 0


def _sums(width: int, unpack: Callable[[Sequence[bytes]], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """Rows of one part of a value: for each of ``width`` replicates the weight, the weighted sum of t, and the sum over ties of their t times (weight below in the part + half of their own)."""

    def run(table: pa.Table) -> pa.Table:
        v, t = table.column("v").to_numpy(), table.column("t").to_numpy()
        order = np.argsort(v, kind="stable")
        drawn = table.column("_drawn").to_pylist()
        below, total, p = np.zeros(width), np.zeros(width), np.zeros(width)
        own, own_t, at = np.zeros(width), np.zeros(width), None
        chunk = max(1, min(CHUNK, UNPACKED // width))
        for k in range(0, len(v), chunk):
            rows = order[k : k + chunk]
            w = unpack([drawn[i] for i in rows])
            first = np.flatnonzero(np.r_[True, np.diff(v[rows]) != 0])
            n, s = np.add.reduceat(w, first), np.add.reduceat(w * t[rows][:, None], first)
            total += s.sum(0)
            if at is not None and v[rows[0]] == at:
                n[0] += own
                s[0] += own_t
            elif at is not None:
                p += own_t * (below + own / 2)
                below += own
            closed = below + np.cumsum(n[:-1], 0) - n[:-1]
            p += (s[:-1] * (closed + n[:-1] / 2)).sum(0)
            below, own, own_t, at = below + n[:-1].sum(0), n[-1], s[-1], v[rows[-1]]
        p += own_t * (below + own / 2)
        one = table.select([c for c in table.column_names if c.startswith("_g") or c in ("side", "part")]).slice(0, 1)
        for name, x in (("n", below + own), ("s", total), ("p", p)):
            one = one.append_column(name, pa.array([x.tolist()], pa.list_(pa.float64())))
        return one.append_column("lo", pa.array([float(t.min())])).append_column("hi", pa.array([float(t.max())]))

    return run


def replicated(df: DataFrame, keys: Sequence[str], y: str, values: Sequence[str], row_id: str, replicates: int, seed: int) -> DataFrame:
    """keys, _rep, and ``_value0``, ``_value1``, ...: the measure of each value in each replicate, all from the same draws; null where it is not defined."""
    d, rows = with_draws(df, keys, [y, *values], row_id, replicates, seed)
    return measured(d, keys, len(values), cut_points(df, [y, *values, y]), rows, replicates, lambda drawn: unpacked(drawn, replicates))


def measured(d: DataFrame, keys: Sequence[str], values: int, cuts: Cuts, rows: int, width: int, unpack: Callable[[Sequence[bytes]], np.ndarray]) -> DataFrame:
    """keys, _rep, and ``_value0``, ``_value1``, ...: the measure of each value with each of ``width`` weights of the rows; null where it is not defined.

    ``d`` has the keys, the target as _v0, the values as _v1, _v2, ..., and ``_drawn``, from which ``unpack`` makes the weights.  ``cuts`` are those of (target, *values, target).
    """
    u = side_rows(d, keys, "_v0", [*[f"_v{i + 1}" for i in range(values)], "_v0"], cuts, ["_drawn"]).filter("part is not null")
    g = [f"_g{i}" for i in range(len(keys))]
    # a cut's very value, of which there may be many rows, is dealt out; its sums are added up again
    salt = F.when(F.col("part") % 2 == 1, F.pmod(F.xxhash64("_drawn", "t"), F.lit(max(SALTS, ranges_for(rows))))).otherwise(0)
    schema = ", ".join([*[f"{x} {d.schema[k].dataType.simpleString()}" for k, x in zip(keys, g, strict=True)], "side string, part int, n array<double>, s array<double>, p array<double>, lo double, hi double"])
    parts = u.withColumn("_salt", salt).groupBy(*g, "side", "part", "_salt").applyInArrow(_sums(width, unpack), schema)
    long = parts.select(*g, "side", "part", "lo", "hi", F.posexplode(F.arrays_zip("n", "s", "p")).alias("_rep", "_z")).groupBy(*g, "side", "part", "_rep").agg(
        F.sum("_z.n").alias("n"), F.sum("_z.s").alias("s"), F.sum("_z.p").alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    long = long.withColumn("p", F.when(F.col("part") % 2 == 1, F.col("s") * F.col("n") / 2.0).otherwise(F.col("p")))
    k = long.groupBy(*g, "_rep").agg(F.array_sort(F.collect_list(F.struct("side", "part", "n", "s", "p"))).alias("_parts"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))  # a part for each range and each cut
    own = lambda i: F.filter("_parts", lambda e: e["side"] == str(i))
    total = lambda c: F.aggregate(own(0), F.lit(0.0), lambda a, e: a + e[c])
    zero = F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("p"))
    p = lambda i: F.aggregate(own(i), zero, lambda a, e: F.struct((a["before"] + e["n"]).alias("before"), (a["p"] + e["p"] + a["before"] * e["s"]).alias("p")))["p"]
    k = k.select(*[F.col(x).alias(c) for c, x in zip(keys, g, strict=True)], "_rep", "_lo", "_hi", total("n").alias("_w"), total("s").alias("_s"), *[p(i).alias(f"_p{i}") for i in range(values + 1)]).withColumn("_rows", F.col("_w"))
    return k.select(*keys, "_rep", *[from_sums(i, values)[0].alias(f"_value{i}") for i in range(values)])
