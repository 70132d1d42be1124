"""Robustness: how far a score's ranking survives a perturbed input. RGR = RGA(score, perturbed score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranktide.errors import BadInput
from ranktide.functions.gauss import quantile
from ranktide.functions.hashing import normal, uniform
from ranktide.functions.ranks import Cuts, by_number, cut_points
from ranktide.operators.inference import METHODS, influence_values, jackknife_values
from ranktide.operators.measure import on, rga
from ranktide.operators.resampling import replicated
from ranktide.operators.scorer import Model, score
from ranktide.sources.frames import columns, count, finite, is_numeric, level as check_level

KINDS = ("tailswap", "gaussian", "shuffle")
GRIDS = {"tailswap": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5), "gaussian": (0.05, 0.1, 0.25, 0.5, 0.75, 1.0)}


def _check(df: DataFrame, names: Sequence[str], kind: str, magnitude: float) -> None:
    if kind not in KINDS:
        raise BadInput(f"unknown perturbation {kind!r}")
    finite(magnitude, "magnitude")
    if kind == "tailswap" and not 0 <= magnitude <= 0.5:
        raise BadInput("a tail swap takes a share from 0 to 0.5")
    if kind == "gaussian" and magnitude < 0:
        raise BadInput("a gaussian perturbation takes a magnitude of 0 or more")
    for c in names:
        if kind != "shuffle" and not is_numeric(df, c):
            raise BadInput(f"{c} is not numeric; only a shuffle can perturb it")


def perturb(df: DataFrame, names: str | Sequence[str], magnitude: float = 0.05, kind: str = "tailswap", row_id: str = "row_id", seed: int = 0, rep: int = 0) -> DataFrame:
    """The rows with the named columns perturbed.

    ``tailswap`` swaps the i-th smallest with the i-th largest value for i up to s =
    min(ceil(m n), n - ceil((1 - m) n)); ties go by row id.  ``gaussian`` adds noise of m population standard
    deviations.  ``shuffle`` permutes all the columns together.  Random numbers depend on seed, repeat and row, not on the column.
    """
    names = columns(df, names, "variable")
    _check(df, names, kind, magnitude)
    if kind == "shuffle":
        from ranktide.operators.explain import permuted

        return permuted(df, names, row_id, seed, f"shuffle:{rep}")
    if kind == "gaussian":
        sd = df.agg(*[F.stddev_pop(c).alias(f"_sd{i}") for i, c in enumerate(names)])
        d = df.crossJoin(F.broadcast(sd))
        return d.withColumns({c: F.col(c) + magnitude * F.col(f"_sd{i}") * normal(seed, "gauss", rep, F.col(row_id)) for i, c in enumerate(names)}).select(*df.columns)
    out = df
    for c in names:
        out = mirrored(out, c, row_id).withColumn(c, F.when(_swapped(magnitude), F.col("_mirror")).otherwise(F.col(c))).select(*df.columns)
    return out


def mirrored(df: DataFrame, column: str, row_id: str, cuts: Cuts | None = None) -> DataFrame:
    """The rows with ``_k``, their place by (column, row id), ``_n``, the number of rows, and ``_mirror``, the value of the row as far from the other end."""
    cuts = cut_points(df, [column, row_id]) if cuts is None else cuts
    n = df.agg(F.count("*").alias("_n"))
    other = by_number(df.select(row_id, column), column, row_id, name="_j", cuts=cuts).crossJoin(F.broadcast(n)).select((F.col("_n") + 1 - F.col("_j")).alias("_at"), F.col(column).alias("_mirror"), "_n")
    return by_number(df, column, row_id, cuts=cuts).join(other, F.col("_k") == F.col("_at")).drop("_at")


def _swapped(magnitude: float | Column, place: str = "") -> Column:
    """Whether a row is in the share of either tail that is swapped."""
    m, n = magnitude if isinstance(magnitude, Column) else F.lit(float(magnitude)), F.col(f"_n{place}")
    s = F.least(F.ceil(m * n), n - F.ceil((1 - m) * n))
    return (F.col(f"_k{place}") <= s) | (F.col(f"_k{place}") > n - s)


def _long(df: DataFrame, model: Model, groups: dict[str, list[str]], settings: Sequence[tuple[float, int]], kind: str, row_id: str, seed: int, **scorer) -> DataFrame:
    """row_id, y (score), variable, magnitude, rep, z (perturbed score)."""
    if kind == "tailswap":
        return _tailswaps(df, model, groups, [m for m, _ in settings], row_id, **scorer)
    full, out = score(df, model, "y", **scorer).select(row_id, "y"), None
    for name, g in groups.items():
        for m, rep in settings:
            z = score(perturb(df, g, m, kind, row_id, seed, rep), model, "z", **scorer).select(F.col(row_id).alias("_id"), "z")
            part = full.join(z, F.col(row_id) == F.col("_id")).select(row_id, "y", F.lit(name).alias("variable"), F.lit(float(m)).alias("magnitude"), F.lit(rep).alias("rep"), "z")
            out = part if out is None else out.unionByName(part)
    return out


def _cuts(df: DataFrame, model: Model, **scorer) -> Cuts:
    """Cuts of the full score, which part the perturbed ones about as well."""
    return cut_points(score(df, model, "_full", **scorer), ["_full"]) * 3


def _tailswaps(df: DataFrame, model: Model, groups: dict[str, list[str]], magnitudes: Sequence[float], row_id: str, **scorer) -> DataFrame:
    """As ``_long``: a variable is ordered once, and all magnitudes are made from its places in one projection."""
    full, out = score(df, model, "_full", **scorer), None
    names = list(dict.fromkeys(c for g in groups.values() for c in g))
    *found, of_id = cut_points(df, [*names, row_id])  # one pass for all variables
    cuts = {c: [x, of_id] for c, x in zip(names, found, strict=True)}
    for name, g in groups.items():
        for c in g:
            _check(df, [c], "tailswap", max(magnitudes))
        d = full
        for k, c in enumerate(g):
            placed = mirrored(df.select(row_id, c), c, row_id, cuts[c])
            d = d.join(placed.select(F.col(row_id).alias("_id"), F.col("_k").alias(f"_k{k}"), F.col("_n").alias(f"_n{k}"), F.col("_mirror").alias(f"_mirror{k}")), F.col(row_id) == F.col("_id")).drop("_id")
        d = d.withColumn("_magnitude", F.explode(F.array(*[F.lit(float(m)) for m in magnitudes])))
        d = d.withColumns({c: F.when(_swapped(F.col("_magnitude"), str(k)), F.col(f"_mirror{k}")).otherwise(F.col(c)) for k, c in enumerate(g)})
        part = score(d, model, "_changed", **scorer).select(row_id, F.col("_full").alias("y"), F.lit(name).alias("variable"), F.col("_magnitude").alias("magnitude"), F.lit(0).alias("rep"), F.col("_changed").alias("z"))
        out = part if out is None else out.unionByName(part)
    return out


def rgr(df: DataFrame, model: Model, variables: str | Sequence[str], magnitude: float = 0.05, kind: str = "tailswap", group: bool = False, n_repeats: int = 1, ci: bool = False, ci_method: str = "jackknife", level: float = 0.95, row_id: str = "row_id", seed: int = 0, n_resamples: int = 2000, **scorer) -> DataFrame:
    """variable, n, rgr (mean over repeats), spread (and standard_error, ci_low, ci_high with ``ci``).

    Several repeats: values are averaged row by row, bootstrap replicates replicate by replicate, over the draws, and the variance of
    the draws over their number is added.  This interval is known to be somewhat wide.
    """
    names = columns(df, variables, "variables")
    zc = quantile(1 - (1 - check_level(level)) / 2)
    if ci_method not in METHODS:
        raise BadInput(f"unknown method {ci_method!r}")
    groups = {"+".join(names): names} if group else {c: [c] for c in names}
    n_repeats = 1 if kind == "tailswap" else count(n_repeats, "n_repeats")
    long = _long(df, model, groups, [(magnitude, r) for r in range(n_repeats)], kind, row_id, seed, **scorer)
    r = rga(long, ["variable", "rep"], cuts=_cuts(df, model, **scorer)).groupBy("variable").agg(F.max("n").alias("n"), F.avg("rga").alias("rgr"), F.coalesce(F.stddev_samp("rga"), F.lit(0.0)).alias("spread"))
    if not ci:
        return r
    if ci_method == "bootstrap":
        v = _pooled(long, n_repeats, row_id, count(n_resamples, "n_resamples", 2), seed).groupBy("variable").agg(F.var_samp("value").alias("_var"))
    else:
        f = {"jackknife": jackknife_values, "influence": influence_values}[ci_method]
        v = f(long, ["variable", "rep"]).groupBy("variable", row_id).agg(F.avg("value").alias("value")).groupBy("variable")
        v = v.agg(((F.count("*") - 1) * F.var_pop("value") if ci_method == "jackknife" else F.var_samp("value") / F.count("*")).alias("_var"))
    r = on(r, v, ["variable"]).withColumn("standard_error", F.sqrt(F.col("_var") + F.pow("spread", F.lit(2.0)) / n_repeats))
    return r.select("variable", "n", "rgr", "spread", "standard_error", (F.col("rgr") - zc * F.col("standard_error")).alias("ci_low"), (F.col("rgr") + zc * F.col("standard_error")).alias("ci_high"))


def _pooled(long: DataFrame, n_repeats: int, row_id: str, n_resamples: int, seed: int) -> DataFrame:
    """variable, value: for each replicate the mean over the perturbation draws of the measure.

    All draws of a variable are columns of one row, which has one vector of bootstrap counts: every draw is resampled alike.  A replicate
    that is not defined for one of the draws is left out.
    """
    wide = long.groupBy("variable", row_id, "y").pivot("rep", list(range(n_repeats))).agg(F.first("z"))
    z = [f"_z{i}" for i in range(n_repeats)]
    wide = wide.withColumnsRenamed({str(i): c for i, c in enumerate(z)})
    values = replicated(wide, ["variable"], "y", z, row_id, n_resamples, seed)
    mean = sum((F.col(f"_value{i}") for i in range(1, n_repeats)), F.col("_value0")) / n_repeats
    return values.select("variable", mean.alias("value")).filter("value is not null")


def rgr_curve(df: DataFrame, model: Model, variables: str | Sequence[str], grid: Sequence[float] | None = None, kind: str = "tailswap", group: bool = False, n_repeats: int = 1, row_id: str = "row_id", seed: int = 0, **scorer) -> DataFrame:
    """variable, magnitude, rgr, aurgr: the area under the curve from (0, 1), over the largest magnitude."""
    if kind == "shuffle":
        raise BadInput("a shuffle has no magnitude to draw a curve over")
    grid = sorted({finite(m, "grid") for m in (GRIDS[kind] if grid is None else grid)})
    count(n_repeats, "n_repeats")
    if len(grid) < 2 or grid[0] <= 0:
        raise BadInput("a curve needs two magnitudes above 0")
    names = columns(df, variables, "variables")
    groups = {"+".join(names): names} if group else {c: [c] for c in names}
    long = _long(df, model, groups, [(m, r) for m in grid for r in range(1 if kind == "tailswap" else n_repeats)], kind, row_id, seed, **scorer)
    p = rga(long, ["variable", "magnitude", "rep"], cuts=_cuts(df, model, **scorer)).groupBy("variable", "magnitude").agg(F.avg("rga").alias("rgr"))
    w = Window.partitionBy("variable").orderBy("magnitude")
    p = p.withColumn("_area", (F.col("rgr") + F.coalesce(F.lag("rgr").over(w), F.lit(1.0))) / 2.0 * (F.col("magnitude") - F.coalesce(F.lag("magnitude").over(w), F.lit(0.0))))
    return p.select("variable", "magnitude", "rgr", (F.sum("_area").over(Window.partitionBy("variable")) / float(grid[-1])).alias("aurgr"))


__all__ = ["perturb", "rgr", "rgr_curve", "uniform"]
