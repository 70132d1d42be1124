"""Kendall's tau-b of any targets: inversions are counted inside ranges by merging, and between ranges from a grid of counts.

Rows lie in parts of the target and parts of the score (``ranks.part_of``).  A pair of rows is counted once: in its target's range if both are in one,
else in its score's range if both are in one, else from the numbers of rows in the cells of the grid.  Parts of a single value have ties only.
So rows are shuffled twice, a task sorts one range, and the work grows with n log n whatever the number of levels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranktide.functions.ranks import Cuts, cut_points, finite, part_of
from ranktide.operators.measure import on

BIG = "decimal(38,0)"  # pairs of 10^11 rows


def inversions(a: np.ndarray) -> int:
    """Pairs of places i < j with a[i] > a[j], for whole numbers from 0, by merging halves of all blocks of a width at once."""
    n = len(a)
    if n < 2:
        return 0
    top = int(a.max()) + 1
    a = np.concatenate([a, np.full((1 << (n - 1).bit_length()) - n, top)]).astype(np.int64)
    total, width = 0, 1
    while width < len(a):
        halves = a.reshape(-1, 2 * width)
        block = np.arange(len(halves))[:, None]
        left, right = (halves[:, :width] + block * (top + 1)).ravel(), (halves[:, width:] + block * (top + 1)).ravel()
        total += int((width * (block + 1) - np.searchsorted(left, right, side="right").reshape(-1, width)).sum())
        a = np.sort(halves, axis=1).ravel()
        width *= 2
    return total


def _ties(*of: np.ndarray) -> int:
    counts = np.unique(np.column_stack(of), axis=0, return_counts=True)[1].astype(np.int64)
    return int((counts * (counts - 1) // 2).sum())


def concordant_less_discordant(y: np.ndarray, z: np.ndarray) -> int:
    if len(y) < 2:
        return 0
    order = np.lexsort((z, y))
    discordant = inversions(np.unique(z, return_inverse=True)[1][order])
    return len(y) * (len(y) - 1) // 2 - _ties(y) - _ties(z) + _ties(y, z) - 2 * discordant


def _in_part(own: str, other: str, less_cells: bool) -> Callable[[pa.Table], pa.Table]:
    """Pairs inside one range of ``own``: their sum, without those that a range of ``other`` has too if ``less_cells``, and the ties of the own value."""

    def run(table: pa.Table) -> pa.Table:
        keys = [c for c in table.column_names if c.startswith("_g")]
        y, z, cell = (table.column(c).to_numpy() for c in ("y", "z", f"part_{other}"))
        s = concordant_less_discordant(y, z)
        if less_cells:
            order = np.argsort(cell, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                s -= concordant_less_discordant(y[at], z[at]) if cell[at[0]] % 2 == 0 else 0
        return table.select(keys).slice(0, 1).append_column("s", pa.array([s])).append_column("ties", pa.array([_ties(y if own == "y" else z)]))

    return run


def kendall(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z", cuts: Cuts | None = None) -> DataFrame:
    """keys, kendall (tau-b) over the rows whose y and z are finite; null where either is constant."""
    (cy, _), (cz, _) = cut_points(df, [y, z]) if cuts is None else cuts
    g = [f"_g{i}" for i in range(len(keys))]
    d = df.select(*[F.col(k).alias(n) for k, n in zip(keys, g, strict=True)], F.col(y).try_cast("double").alias("y"), F.col(z).try_cast("double").alias("z"))
    d = d.filter(finite(F.col("y"), F.col("z"))).withColumns({"part_y": part_of("y", cy), "part_z": part_of("z", cz)})
    schema = ", ".join([*[f"{n} {df.schema[k].dataType.simpleString()}" for k, n in zip(keys, g, strict=True)], "s bigint, ties bigint"])
    zero = F.lit(0).cast(BIG)
    within = {}
    for own, other, less in (("y", "z", False), ("z", "y", True)):
        r = d.filter(f"part_{own} % 2 = 0").groupBy(*g, f"part_{own}").applyInArrow(_in_part(own, other, less), schema)
        within[own] = r.select(*g, F.col("s").cast(BIG).alias("s"), *[(F.col("ties").cast(BIG) if own == v else zero).alias(f"t{v}") for v in "yz"], zero.alias("n"))
    cells = d.groupBy(*g, "part_y", "part_z").agg(F.count("*").alias("c"))
    single = []
    for v in "yz":  # a value that is a part of its own
        c = cells.groupBy(*g, f"part_{v}").agg(F.sum("c").cast(BIG).alias("c"))
        pairs = F.when(F.col(f"part_{v}") % 2 == 1, F.expr("cast(c * (c - 1) / 2 as decimal(38,0))")).otherwise(zero)
        single.append(c.select(*g, zero.alias("s"), *[(pairs if w == v else zero).cast(BIG).alias(f"t{w}") for w in "yz"], (F.col("c") if v == "y" else zero).cast(BIG).alias("n")))
    # rows of smaller parts of the target, with smaller and with larger parts of the score
    parts = cells.groupBy(*g).agg(F.collect_set("part_y").alias("ys"), F.collect_set("part_z").alias("zs"))
    grid = parts.select(*g, F.explode("ys").alias("part_y"), "zs").select(*g, "part_y", F.explode("zs").alias("part_z"))
    grid = on(grid, cells, [*g, "part_y", "part_z"], "left")
    up, along = Window.partitionBy(*g, "part_z").orderBy("part_y"), Window.partitionBy(*g, "part_y").orderBy("part_z")
    grid = grid.withColumn("above", F.coalesce(F.sum("c").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("above").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("lead", 2 * before + F.col("above") - F.sum("above").over(Window.partitionBy(*g, "part_y"))).filter("c is not null")
    between = grid.select(*g, (F.col("c").cast("decimal(18,0)") * F.col("lead").cast("decimal(19,0)")).cast(BIG).alias("s"), zero.alias("ty"), zero.alias("tz"), zero.alias("n"))
    every = within["y"].unionByName(within["z"]).unionByName(single[0]).unionByName(single[1]).unionByName(between)
    t = every.groupBy(*g).agg(*[F.coalesce(F.sum(c), zero).cast("double").alias(c) for c in ("s", "ty", "tz", "n")])
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    tau = F.try_divide(F.col("s"), F.sqrt(pairs - F.col("ty")) * F.sqrt(pairs - F.col("tz")))
    return t.select(*[F.col(n).alias(k) for k, n in zip(keys, g, strict=True)], tau.alias("kendall"))
