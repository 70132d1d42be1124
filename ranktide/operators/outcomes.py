"""Outcome fairness: selection rates by group, overall and among positives or negatives.

All criteria come from one pass over the rows.  Tests use the rate pooled over the
included groups; intervals do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.errors import BadInput
from ranktide.functions import gauss
from ranktide.operators.fairness import adjusted, compared, pair_rows
from ranktide.sources.frames import finite, level as check_level

CRITERIA = ("demographic_parity", "equal_opportunity", "predictive_equality")
FOUR_FIFTHS = 0.8


def wilson(x: Column, n: Column, z: float) -> tuple[Column, Column]:
    p, zz = x / n, z * z
    mid = (p + zz / (2.0 * n)) / (1.0 + zz / n)
    half = z * F.sqrt(p * (1.0 - p) / n + zz / (4.0 * n * n)) / (1.0 + zz / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def agresti_caffo(xa: Column, na: Column, xb: Column, nb: Column, z: float) -> tuple[Column, Column]:
    """Interval of a difference of proportions after one success and one failure more in each."""
    pa, pb = (xa + 1.0) / (na + 2.0), (xb + 1.0) / (nb + 2.0)
    half = z * F.sqrt(pa * (1.0 - pa) / (na + 2.0) + pb * (1.0 - pb) / (nb + 2.0))
    return F.greatest(F.lit(-1.0), pa - pb - half), F.least(F.lit(1.0), pa - pb + half)


def decided(df: DataFrame, decision: str, threshold: float | None = None) -> DataFrame:
    """The rows with ``_d`` 0 or 1: given, or score >= threshold. There is no default threshold."""
    if threshold is not None:
        return df.withColumn("_d", F.when(F.col(decision) >= finite(threshold, "threshold"), 1).otherwise(0))
    odd = df.filter(~F.col(decision).cast("double").isin(0.0, 1.0) | F.col(decision).isNull()).limit(1).count()
    if odd:
        raise BadInput("decisions must be 0 or 1; give a threshold for scores")
    return df.withColumn("_d", F.col(decision).cast("int"))


def rates(df: DataFrame, group: str, y: str, decision: str, threshold: float | None = None, min_group_size: int = 50, level: float = 0.95, row_id: str = "row_id") -> DataFrame:
    """criterion, group, n, n_eligible, n_selected, rate, standard_error, ci_low, ci_high, included, place, note."""
    zc = gauss.quantile(1 - (1 - check_level(level)) / 2)
    d = decided(df, decision, threshold)
    ends = d.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count_distinct(y).alias("k")).first()
    if ends["k"] != 2:
        raise BadInput("the outcome must have two values")
    pos = F.col(y) == F.lit(ends["hi"])
    g = d.groupBy(group).agg(F.count("*").alias("n"), F.sum("_d").alias("s0"), F.count_if(pos).alias("e1"), F.sum(F.when(pos, F.col("_d")).otherwise(0)).alias("s1"), F.sum(F.when(pos, F.lit(0)).otherwise(F.col("_d"))).alias("s2"), F.min(row_id).alias("place"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), e.cast("bigint").alias("n_eligible"), s.cast("bigint").alias("n_selected")) for c, e, s in zip(CRITERIA, (F.col("n"), F.col("e1"), F.col("n") - F.col("e1")), (F.col("s0"), F.col("s1"), F.col("s2")), strict=True)])).alias("_c")
    g = g.select(F.col(group).alias("group"), "n", "place", rows).select("_c.criterion", "group", "n", "_c.n_eligible", "_c.n_selected", "place")
    e, s = F.nullif(F.col("n_eligible").cast("double"), F.lit(0.0)), F.col("n_selected").cast("double")
    low, high = wilson(s, e, zc)
    rate = s / e
    note = F.when(F.col("n_eligible") == 0, "no eligible rows").when(F.col("n_eligible") < min_group_size, "eligible rows below min_group_size").otherwise("")
    return g.select("criterion", "group", "n", "n_eligible", "n_selected", rate.alias("rate"), F.sqrt(rate * (1.0 - rate) / e).alias("standard_error"), low.alias("ci_low"), high.alias("ci_high"), (F.col("n_eligible") >= max(1, min_group_size)).alias("included"), "place", note.alias("note"))


def _null_errors(groups: DataFrame) -> DataFrame:
    """Included groups of every criterion with ``null_error`` from the pooled rate."""
    k = groups.filter("included")
    p = k.groupBy("criterion").agg((F.sum("n_selected") / F.sum("n_eligible")).alias("_p")).withColumnRenamed("criterion", "_c")
    return k.join(p, F.col("criterion") == F.col("_c")).drop("_c").withColumn("null_error", F.sqrt(F.col("_p") * (1.0 - F.col("_p")) / F.col("n_eligible")))


def pairs(groups: DataFrame, criterion: str, level: float = 0.95, n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """a, b, difference, standard_error, null_error, ci_low, ci_high, p_value, p_adjusted of one criterion."""
    zc = gauss.quantile(1 - (1 - check_level(level)) / 2)
    k = _null_errors(groups.filter(F.col("criterion") == criterion))
    p = pair_rows(compared(k, "null_error", ["group", "rate", "standard_error", "n_eligible", "n_selected"], n_resamples, seed))
    a, b = F.col("x"), F.col("y")
    low, high = agresti_caffo(a["n_selected"], a["n_eligible"], b["n_selected"], b["n_eligible"], zc)
    d, null = a["rate"] - b["rate"], F.sqrt(a["se"] * a["se"] + b["se"] * b["se"])
    t = F.coalesce(F.try_divide(d, null), F.lit(0.0))
    se = F.sqrt(a["standard_error"] * a["standard_error"] + b["standard_error"] * b["standard_error"])
    return p.select(a["group"].alias("a"), b["group"].alias("b"), d.alias("difference"), se.alias("standard_error"), null.alias("null_error"), low.alias("ci_low"), high.alias("ci_high"), gauss.two_sided(t).alias("p_value"), adjusted(t, n_resamples).alias("p_adjusted"))


def gaps(groups: DataFrame, level: float = 0.95) -> DataFrame:
    """criterion, gap, best, worst, gap_low, gap_high, ratio, ratio_low, ratio_high, four_fifths; criteria with fewer than two included groups are null."""
    zc = gauss.quantile(1 - (1 - check_level(level)) / 2)
    k = groups.filter("included").withColumn("_row", F.struct("group", "rate", "n_eligible", "n_selected"))
    s = k.groupBy("criterion").agg(F.count("*").alias("_k"), F.max_by("_row", F.struct("rate", "place")).alias("hi"), F.min_by("_row", F.struct("rate", "place")).alias("lo")).filter("_k >= 2")
    low, high = agresti_caffo(F.col("hi.n_selected"), F.col("hi.n_eligible"), F.col("lo.n_selected"), F.col("lo.n_eligible"), zc)
    ratio = F.when(F.col("hi.rate") > 0, F.try_divide(F.col("lo.rate"), F.col("hi.rate")))
    both = (F.col("hi.rate") > 0) & (F.col("lo.rate") > 0)
    part = lambda x: F.try_divide(1.0 - F.col(f"{x}.rate"), F.col(f"{x}.n_eligible") * F.col(f"{x}.rate"))
    se = F.sqrt(part("lo") + part("hi"))
    first = F.col("criterion") == CRITERIA[0]
    out = s.select("criterion", (F.col("hi.rate") - F.col("lo.rate")).alias("gap"), F.col("hi.group").alias("best"), F.col("lo.group").alias("worst"), low.alias("gap_low"), high.alias("gap_high"), F.when(first, ratio).alias("ratio"), F.when(first & both, F.exp(F.log(ratio) - zc * se)).alias("ratio_low"), F.when(first & both, F.least(F.lit(1.0), F.exp(F.log(ratio) + zc * se))).alias("ratio_high"), F.when(first, ratio >= FOUR_FIFTHS).alias("four_fifths"))
    every = groups.select("criterion").distinct().withColumnRenamed("criterion", "_c")
    return every.join(out, F.col("_c") == F.col("criterion"), "left").drop("criterion").withColumnRenamed("_c", "criterion")


def equalized_odds(gap_table: DataFrame) -> DataFrame:
    """equalized_odds: the larger of the two conditional gaps, or null if either is."""
    g = gap_table.filter(F.col("criterion").isin(*CRITERIA[1:]))
    return g.agg(F.when(F.count("gap") == 2, F.max("gap")).alias("equalized_odds"))


def noise_floor(groups: DataFrame, criterion: str, n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    k = _null_errors(groups.filter(F.col("criterion") == criterion))
    return compared(k, "null_error", [], n_resamples, seed).select(F.col("floor").alias("noise_floor"))


__all__ = ["CRITERIA", "agresti_caffo", "decided", "equalized_odds", "gaps", "noise_floor", "pairs", "rates", "wilson"]
