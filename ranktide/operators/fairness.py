"""Ranking fairness: parity of the measure between groups, dependence on protected columns, leakage.

Group tables are small; whatever follows from them (pairs, simulated null draws) is a
table keyed by pair and draw, made from the group table inside Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.errors import BadInput
from ranktide.functions import gauss
from ranktide.functions.hashing import normal
from ranktide.operators.inference import bootstrap_values, estimate
from ranktide.operators.measure import rga
from ranktide.sources.frames import columns, is_numeric, no_missing_labels

#: Levels of a protected column that are taken one against the rest.
LEVELS = 1000


def compared(groups: DataFrame, error: str, facts: Sequence[str], n_draws: int, seed: int) -> DataFrame:
    """One row: ``g``, the groups in the order of place with their ``se`` and facts, ``floor``, the mean spread of draws under equality, and ``ts``, each draw's largest standardised difference.

    Groups are compared in pairs, so there can only be some; a draw is a row.
    """
    one = groups.agg(F.array_sort(F.collect_list(F.struct("place", F.col(error).alias("se"), *facts))).alias("g"))
    d = one.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    d = d.withColumn("d", F.transform("g", lambda x: F.struct((x["se"] * normal(seed, "null", F.col("rep"), x["place"])).alias("d"), x["se"].alias("se"))))

    def apart(x: Column, y: Column) -> Column:
        scale = F.sqrt(x["se"] * x["se"] + y["se"] * y["se"])
        return F.when(scale > 0, F.abs(x["d"] - y["d"]) / F.nullif(scale, F.lit(0.0))).otherwise(float("inf"))

    t = F.array_max(F.transform("d", lambda x, i: F.array_max(F.transform(F.slice("d", i + 2, F.size("d")), lambda y: apart(x, y)))))
    spread = F.array_max(F.transform("d", lambda x: x["d"])) - F.array_min(F.transform("d", lambda x: x["d"]))
    return d.agg(F.first("g").alias("g"), F.avg(spread).alias("floor"), F.collect_list(t).alias("ts"))


def pair_rows(row: DataFrame) -> DataFrame:
    """x, y, ts: a row for every two groups of ``compared``, in order."""
    every = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return row.select("ts", F.explode(every).alias("p")).select("p.x", "p.y", "ts")


def adjusted(statistic: Column, n_draws: int) -> Column:
    """(1 + draws with t >= |statistic|) / (draws + 1), over ``ts``."""
    return (1.0 + F.size(F.filter("ts", lambda t: t >= F.abs(statistic)))) / (n_draws + 1.0)


def difference(x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """Of two groups' rga: the difference, its error, its standardised value and its p-value."""
    d, se = x["rga"] - y["rga"], F.sqrt(x["se"] * x["se"] + y["se"] * y["se"])
    t = F.when(se > 0, F.try_divide(d, se)).when(d == 0, 0.0).otherwise(float("inf"))
    return d, se, t, F.when(se > 0, gauss.two_sided(F.try_divide(d, se))).when(d == 0, 1.0).otherwise(0.0)


def parity_groups(df: DataFrame, group: str, y: str = "y", z: str = "z", min_group_size: int = 50, level: float = 0.95, method: str = "jackknife", row_id: str = "row_id", n_resamples: int = 2000, seed: int = 0, in_order: bool = True) -> DataFrame:
    """group, n, rga, standard_error, ci_low, ci_high, included, place (order of first row), note; lowest first, undefined ones last; rows without a label are refused."""
    no_missing_labels(df, [group])
    e = estimate(df, [group], y, z, method, level, row_id=row_id, n_resamples=n_resamples, seed=seed)
    first = df.groupBy(group).agg(F.min(row_id).alias("_first")).withColumnRenamed(group, "_g")
    e = e.join(first, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    ok = F.col("rga").isNotNull() & (F.col("n") >= min_group_size)
    r = e.select(F.col(group).alias("group"), "n", "rga", "standard_error", "ci_low", "ci_high", ok.alias("included"), F.col("_first").alias("place"), F.when((F.col("note") == "") & ~ok, "n below min_group_size").otherwise(F.col("note")).alias("note"))
    return r.orderBy(F.col("rga").asc_nulls_last(), "group") if in_order else r


def parity_pairs(groups: DataFrame, n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """a, b, difference, standard_error, p_value, p_adjusted for included groups, in the order of their first rows."""
    p = pair_rows(compared(groups.filter("included"), "standard_error", ["group", "rga"], n_resamples, seed))
    d, se, t, value = difference(F.col("x"), F.col("y"))
    return p.select(F.col("x.group").alias("a"), F.col("y.group").alias("b"), d.alias("difference"), se.alias("standard_error"), value.alias("p_value"), adjusted(t, n_resamples).alias("p_adjusted"))


def parity(df: DataFrame, group: str, y: str = "y", z: str = "z", min_group_size: int = 50, level: float = 0.95, method: str = "jackknife", row_id: str = "row_id", n_resamples: int = 2000, seed: int = 0, gap_interval: bool = True) -> DataFrame:
    """One row: gap, best, worst, p_value, p_adjusted, noise_floor, excess, gap_low, gap_high; null with fewer than two included groups.

    The interval resamples inside each group and keeps resamples in which every included group is defined.
    """
    g = parity_groups(df, group, y, z, min_group_size, level, method, row_id, n_resamples, seed, in_order=False)
    k = g.filter("included")
    row = compared(k, "standard_error", ["group", "rga"], n_resamples, seed)
    by = F.transform("g", lambda x: F.struct(x["rga"].alias("rga"), x["group"].alias("group"), x["se"].alias("se")))
    row = row.withColumns({"hi": F.array_max(by), "lo": F.array_min(by)})
    d, _, t, value = difference(F.col("hi"), F.col("lo"))
    cols = {"gap": d, "best": F.col("hi.group"), "worst": F.col("lo.group"), "p_value": value, "p_adjusted": adjusted(t, n_resamples), "noise_floor": F.col("floor"), "excess": d - F.col("floor")}
    r = row.select(*[F.when(F.size("g") >= 2, c).alias(n) for n, c in cols.items()])
    if gap_interval:
        reps = bootstrap_values(df.join(k.select(F.col("group").alias("_g")), F.col(group) == F.col("_g"), "left_semi"), [group], y, z, row_id, n_resamples, seed)
        per = reps.groupBy("rep").agg((F.max("value") - F.min("value")).alias("_gap"), F.count_if(F.col("value").isNull()).alias("_bad")).filter("_bad = 0")
        q = per.agg(F.percentile("_gap", F.array(F.lit((1 - level) / 2), F.lit(1 - (1 - level) / 2))).alias("_q"), F.count("*").alias("_usable"))
        enough = (F.col("_usable") >= max(50, n_resamples / 2)) & F.col("gap").isNotNull()
        r = r.crossJoin(F.broadcast(q)).select(*cols, F.when(enough, F.col("_q")[0]).alias("gap_low"), F.when(enough, F.col("_q")[1]).alias("gap_high"))
    return r


def labels_from_dummies(df: DataFrame, names: Sequence[str], reference: str = "reference", label: str = "label") -> DataFrame:
    """The rows with a label column: the one dummy that is 1, or ``reference``; raises if a value is not 0 or 1 or two are 1."""
    names = columns(df, names, "columns")
    r = df.agg(F.count_if(~F.forall(F.array(*[F.col(c).cast("double") for c in names]), lambda x: x.isin(0.0, 1.0) & x.isNotNull())).alias("odd"), F.count_if(sum((F.col(c).cast("double") for c in names), F.lit(0.0)) > 1).alias("two")).first()
    if r["odd"]:
        raise BadInput(f"{r['odd']} rows with values other than 0 and 1")
    if r["two"]:
        raise BadInput(f"{r['two']} rows with two dummies set")
    return df.withColumn(label, F.coalesce(*[F.when(F.col(c).cast("double") == 1, F.lit(c)) for c in names], F.lit(reference)))


def proxy_leakage(df: DataFrame, protected: str | Sequence[str], candidates: Sequence[str] | None = None, ordered: bool = False, row_id: str = "row_id", yhat: str | None = None) -> DataFrame:
    """variable, rga, level, leakage, note: |2 RGA(level, candidate) - 1|, for the level that the candidate gives away most.

    A single protected column of more than two levels, or of text, is taken one level against the rest unless it is ordered.
    With ``yhat``, the score's column, a last row ``model`` says what the score itself gives away.
    """
    prot = columns(df, protected, "protected")
    names = columns(df, candidates, "candidates") if candidates is not None else [c for c in df.columns if c not in (*prot, row_id, yhat)]
    numeric = [c for c in names if is_numeric(df, c)]
    odd = [c for c in names if c not in numeric]
    if text := [c for c in prot if not is_numeric(df, c)]:
        if len(prot) > 1 or ordered:
            raise BadInput(f"protected: {text} are not numeric")
    no_missing_labels(df, prot)
    used = [*numeric, *([yhat] if yhat else [])]
    wide = df.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(prot)], *[F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(used)])
    z = [f"_z{i}" for i in range(len(used))]
    levels = [r["_p0"] for r in wide.select("_p0").distinct().limit(LEVELS + 1).collect()] if len(prot) == 1 and not ordered else []
    if len(levels) > LEVELS:
        raise BadInput(f"{prot[0]} has more than {LEVELS} levels; name it ordered, or bin it")
    if len(levels) > 2 or text:
        named = [(f"{prot[0]} == {v if isinstance(v, str) else format(v, 'g')}", v) for v in levels]
        stacked = F.array(*[F.struct(F.lit(n).alias("level"), F.when(F.col("_p0") == F.lit(v), 1.0).otherwise(0.0).alias("y")) for n, v in named])
    else:
        stacked = F.array(*[F.struct(F.lit(c).alias("level"), F.col(f"_p{i}").cast("double").alias("y")) for i, c in enumerate(prot)])
    long = wide.select(F.explode(stacked).alias("_s"), *z).select("_s.level", "_s.y", *z).unpivot(["level", "y"], z, "_v", "z")
    r = rga(long, ["_v", "level"]).withColumn("leakage", F.abs(2 * F.col("rga") - 1))
    best = r.groupBy("_v").agg(F.max_by(F.struct("rga", "level", "leakage"), F.struct("leakage", "level")).alias("_b"))
    title = F.element_at(F.create_map(*[x for i, c in enumerate(used) for x in (F.lit(f"_z{i}"), F.lit("model" if yhat and i == len(numeric) else c))]), F.col("_v"))
    out = best.select(title.alias("variable"), F.col("_b.rga").alias("rga"), F.col("_b.level").alias("level"), F.col("_b.leakage").alias("leakage"), F.when(F.col("_b.leakage").isNull(), "no two levels here").otherwise("").alias("note"))
    if odd:
        extra = df.sparkSession.createDataFrame([(c,) for c in odd], "variable string").select("variable", F.lit(None).cast("double").alias("rga"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("double").alias("leakage"), F.lit("not numeric, skipped").alias("note"))
        out = out.unionByName(extra)
    return out
