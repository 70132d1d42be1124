"""Explainability: how much the ranking of the full score is lost without some columns.

RGE(S) = 1 - RGA(full score, score without S).  All reduced scores of a call are one long table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.errors import BadInput
from ranktide.functions.hashing import uniform
from ranktide.functions.quantiles import exact
from ranktide.functions.ranks import by_number, numbered, spread_evenly
from ranktide.operators.inference import estimate
from ranktide.operators.measure import on, rga
from ranktide.operators.scorer import Model, score
from ranktide.sources.frames import columns, is_numeric

REMOVALS = ("mean", "median", "mode", "permute", "retrain")


def replacement(train: DataFrame, names: Sequence[str], method: str) -> dict[str, object]:
    """A value for each column, from one pass, medians from ``quantiles.exact``; other than numbers always take the most frequent value, the least of equals."""
    if method not in REMOVALS:
        raise BadInput(f"unknown removal {method!r}")
    aggs, medians = [], [c for c in names if method == "median" and is_numeric(train, c)]
    for c in [c for c in names if c not in medians]:
        if not is_numeric(train, c) or method == "mode":
            aggs.append(F.mode(c, True).alias(c))
        else:
            aggs.append(F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c))
    found = exact(train, {c: F.col(c).cast("double") for c in medians}, [0.5]) if medians else {}
    return (train.agg(*aggs).first().asDict() if aggs else {}) | {c: None if v is None else v[0] for c, v in found.items()}


def permuted(df: DataFrame, names: Sequence[str], row_id: str, seed: int, stream: str = "permute") -> DataFrame:
    """The rows with the named columns permuted together: the row at a place by row id takes the values of the row at that place by a hash."""
    a = by_number(df, row_id, row_id)
    u = df.select(row_id, F.struct(*names).alias("_s")).withColumn("_u", uniform(seed, stream, F.col(row_id)))
    b = numbered(u, (), ["_u", row_id], spread_evenly(F.col("_u"), df), "_k2").select("_s", "_k2")
    j = a.join(b, F.col("_k") == F.col("_k2"))
    return j.select(*[F.col("_s")[c].alias(c) if c in names else F.col(c) for c in df.columns])


def reduced(train: DataFrame, df: DataFrame, model: Model, names: Sequence[str], method: str, row_id: str, seed: int = 0, refit: Callable[[list[str]], Model] | None = None, **scorer) -> DataFrame:
    """row_id and ``_without``, the score of each row without the columns."""
    if method == "retrain":
        if refit is None:
            raise BadInput("removal by retraining needs refit")
        kept = [c for c in df.columns if c not in (*names, row_id)]
        if not kept:
            raise BadInput("all columns would be removed")
        return score(df.select(row_id, *kept), refit(kept), "_without", **scorer).select(row_id, "_without")
    if method == "permute":
        changed = permuted(df, names, row_id, seed)
    else:
        values = replacement(train, names, method)
        changed = df.withColumns({c: F.lit(values[c]) for c in names})
    return score(changed, model, "_without", **scorer).select(row_id, "_without")


def long_scores(train: DataFrame, df: DataFrame, model: Model, groups: dict[str, list[str]], method: str, row_id: str, seed: int = 0, refit: Callable | None = None, **scorer) -> DataFrame:
    """row_id, y (full score), variable, z (score without it)."""
    if method in ("mean", "median", "mode"):  # a row for each variable, with that variable replaced, is scored once
        values = replacement(train, sorted({c for g in groups.values() for c in g}), method)
        long = score(df, model, "_full", **scorer).withColumn("_variable", F.explode(F.array(*[F.lit(n) for n in groups])))
        without = lambda c: F.col("_variable").isin([n for n, g in groups.items() if c in g])
        long = long.withColumns({c: F.when(without(c), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})
        return score(long, model, "_changed", **scorer).select(row_id, F.col("_full").alias("y"), F.col("_variable").alias("variable"), F.col("_changed").alias("z"))
    full = score(df, model, "y", **scorer)
    out = None
    for name, g in groups.items():
        w = reduced(train, df, model, g, method, row_id, seed, refit, **scorer).withColumnRenamed(row_id, "_id")
        part = full.select(row_id, "y").join(w, F.col(row_id) == F.col("_id")).select(row_id, "y", F.lit(name).alias("variable"), F.col("_without").alias("z"))
        out = part if out is None else out.unionByName(part)
    return out


def rge(train: DataFrame, df: DataFrame, model: Model, variables: str | Sequence[str], method: str = "mean", group: bool = False, normalize: bool = False, ci: bool = False, level: float = 0.95, row_id: str = "row_id", seed: int = 0, refit: Callable | None = None, **scorer) -> DataFrame:
    """variable, n, rge (and rge_low, rge_high with ``ci``): one row each, or one row for the whole group; ``normalize`` doubles."""
    names = columns(df, variables, "variables")
    groups = {"+".join(names): names} if group else {c: [c] for c in names}
    long = long_scores(train, df, model, groups, method, row_id, seed, refit, **scorer)
    k = 2.0 if normalize else 1.0
    if ci:
        e = estimate(long, ["variable"], "y", "z", level=level)
        return e.select("variable", "n", (k * (1 - F.col("rga"))).alias("rge"), (k * (1 - F.col("ci_high"))).alias("rge_low"), (k * (1 - F.col("ci_low"))).alias("rge_high"))
    return rga(long, ["variable"]).select("variable", "n", (k * (1 - F.col("rga"))).alias("rge"))  # cuts of the reduced scores too: they may all lie between two cuts of the full one


def rge_group(train: DataFrame, df: DataFrame, model: Model, variables: Sequence[str], **options) -> DataFrame:
    return rge(train, df, model, variables, group=True, **options)


def shapley(train: DataFrame, df: DataFrame, model: Model, variables: Sequence[str], method: str = "mean", normalize: bool = False, max_exact: int = 12, n_permutations: int = 200, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """variable, value: the share of each in 1 - RGA without all of them.

    Every coalition is a bit mask in one long table.  With up to ``max_exact``
    variables all are scored; beyond that, those along ``n_permutations`` random orders.
    """
    names = columns(df, variables, "variables")
    d = len(names)
    values = replacement(train, names, method)
    spark = df.sparkSession
    if d <= max_exact:
        masks = spark.range(1, 2**d).select(F.col("id").alias("mask"))
        steps = [(m, m | (1 << j), j, math.factorial(bin(m).count("1")) * math.factorial(d - bin(m).count("1") - 1) / math.factorial(d)) for m in range(2**d) for j in range(d) if not m >> j & 1]
    else:
        import random

        rng, seen = random.Random(seed), {}
        for _ in range(n_permutations):
            order, m = rng.sample(range(d), d), 0
            for j in order:
                seen[m, m | (1 << j), j] = seen.get((m, m | (1 << j), j), 0) + 1
                m |= 1 << j
        steps = [(a, b, j, c / n_permutations) for (a, b, j), c in seen.items()]
        masks = spark.createDataFrame([(m,) for m in sorted({b for _, b, _ in seen})], "mask bigint")
    full = score(df, model, "_full")
    long = full.crossJoin(F.broadcast(masks))  # a table of 2^d rows at most, d bounded by max_exact
    long = long.withColumns({c: F.when(F.expr(f"shiftright(mask, {j}) & 1") == 1, F.lit(values[c])).otherwise(F.col(c)) for j, c in enumerate(names)})
    # cuts of the scores of all coalitions: those without a column have fewer values, which may all lie between two cuts of the full score
    v = rga(score(long, model, "z").select("mask", F.col("_full").alias("y"), "z"), ["mask"]).select("mask", (1 - F.col("rga")).alias("v"))
    step = spark.createDataFrame([(a, b, names[j], w) for a, b, j, w in steps], "a bigint, b bigint, variable string, w double")
    s = step.join(v.withColumnsRenamed({"mask": "b", "v": "vb"}), "b").join(v.withColumnsRenamed({"mask": "a", "v": "va"}), "a", "left")
    k = 2.0 if normalize else 1.0
    return s.groupBy("variable").agg((k * F.sum(F.col("w") * (F.col("vb") - F.coalesce("va", F.lit(0.0))))).alias("value"))


def rgf(train: DataFrame, df: DataFrame, model: Model, protected: str | Sequence[str], method: str = "mean", normalize: bool = False, row_id: str = "row_id", **scorer) -> DataFrame:
    """rgf = RGA(full, without the protected columns), and rge = 1 - rgf."""
    r = rge(train, df, model, protected, method=method, group=True, row_id=row_id, **scorer)
    return r.select("n", (1 - F.col("rge")).alias("rgf"), ((2.0 if normalize else 1.0) * F.col("rge")).alias("rge"))


__all__ = ["on", "permuted", "replacement", "rge", "rge_group", "rgf", "shapley"]
