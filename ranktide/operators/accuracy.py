"""Accuracy: reports, one-vs-rest, model and segment comparisons, contamination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranktide.errors import BadInput
from ranktide.functions import gauss
from ranktide.functions.hashing import uniform
from ranktide.functions.ranks import cut_points, finite, numbered, rank_sums, spread_evenly
from ranktide.operators.concordance import kendall
from ranktide.operators.inference import METHODS, ROW_VALUES, bootstrap_values, compare, estimate, from_rows, ranked, spread, test
from ranktide.operators.measure import NOTE_CONSTANT, NOTE_FEW, from_sums, on, rga
from ranktide.sources.frames import columns, level as check_level, no_missing_labels


#: Labels that one_vs_rest takes as classes by itself.
CLASSES = 1000


def _auroc(k: int = 0, target: int = 1) -> Column:
    """From ``rank_sums``: the rank sum of the larger of two target values; null for other targets."""
    n, lo, span = F.col("_rows"), F.col("_lo"), F.col("_hi") - F.col("_lo")
    ranks = (F.col(f"_p{k}") + F.col("_s") / 2.0 - lo * n * (n + 1) / 2.0) / span
    high = (F.col("_s") - lo * n) / span
    return F.when(F.col(f"_d{target}") == 2, F.try_divide(ranks - high * (high + 1) / 2.0, high * (n - high)))


def auroc(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    """keys, auroc, from the rank sum of one class and not from the measure; null for other than two target values."""
    return rank_sums(df, keys, y, [z, y]).select(*keys, _auroc().alias("auroc"))


def _references(y: str, z: str) -> list[Column]:
    """Aggregates over ``ranked`` rows; a correlation with a constant is null."""
    err = F.col(y) - F.col(z)

    def corr(a: str, b: str) -> Column:
        return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.corr(a, b))

    return [corr(y, z).alias("pearson"), corr("_r1", "_r0").alias("spearman"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae")]


def reference_measures(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    """keys, pearson, spearman, rmse, mae, is_binary; a correlation with a constant is null."""
    rows, sums = ranked(df, keys, y, [z], [y, z])
    r = on(sums.select(*keys, (F.col("_d1") == 2).alias("is_binary")), rows.groupBy(*keys).agg(*_references(y, z)), keys)
    return r.select(*keys, "pearson", "spearman", "rmse", "mae", "is_binary")


def report(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z", method: str = "jackknife", level: float = 0.95, with_kendall: bool = True, **options) -> DataFrame:
    """One row a key: the estimate with its interval, Gini, the usual measures with Kendall's tau, the one-sided test and the note."""
    t = test(df, keys, y, z).select(*keys, "p_value")
    rows, sums = ranked(df, keys, y, [z], [y, z])
    binary = sums.select(*keys, (F.col("_d1") == 2).alias("is_binary"), _auroc().alias("auroc"))
    if method == "bootstrap":
        e = on(estimate(df, keys, y, z, method, level, **options), rows.groupBy(*keys).agg(*_references(y, z)), keys)
    else:
        zc = gauss.quantile(1 - (1 - check_level(level)) / 2)
        e = from_rows(rows.groupBy(*keys).agg(*spread(method), *_references(y, z)), sums, keys, method, zc, ["pearson", "spearman", "rmse", "mae"])
    r = on(on(e, binary, keys), t, keys)
    r = on(r, kendall(df, keys, y, z), keys) if with_kendall else r.withColumn("kendall", F.lit(None).cast("double"))
    return r.select(*keys, "n", "rga", "standard_error", "ci_low", "ci_high", (2 * F.col("rga") - 1).alias("gini"), (2 * F.col("ci_low") - 1).alias("gini_low"), (2 * F.col("ci_high") - 1).alias("gini_high"), "is_binary", "pearson", "spearman", "kendall", "rmse", "mae", "auroc", "p_value", "note")


def one_vs_rest(df: DataFrame, label: str, proba: str, classes: Sequence | None = None, average: str = "macro") -> DataFrame:
    """class, n, rga, note for each class of an array of probabilities, and a last row with class null for the average.

    The probabilities of every row are those of ``classes`` in order, by default the labels in theirs, ``CLASSES`` at most.  A class without rows, or with all of them, has null and a note and is left out of the average.
    """
    if average not in ("macro", "weighted"):
        raise BadInput(f"unknown average {average!r}")
    if classes is None:
        found = df.select(label).filter(F.col(label).isNotNull()).distinct().limit(CLASSES + 1).collect()
        if len(found) > CLASSES:
            raise BadInput(f"{label} has more than {CLASSES} labels; name the classes")
        classes = sorted(r[0] for r in found)
    if not classes or len(set(map(str, classes))) < len(classes):
        raise BadInput("classes must be named once each")
    odd = df.agg(F.count_if(~F.coalesce(F.col(label).cast("string").isin([str(c) for c in classes]), F.lit(False))).alias("labels"), F.count_if(F.coalesce(F.size(proba), F.lit(-1)) != len(classes)).alias("widths")).first()
    if odd["labels"]:
        raise BadInput(f"{odd['labels']} rows with labels that are no class")
    if odd["widths"]:
        raise BadInput(f"{odd['widths']} rows without {len(classes)} probabilities, one for each class")
    long = df.select(F.col(label).cast("string").alias("_l"), F.posexplode(proba).alias("_k", "z"))
    long = long.withColumn("class", F.element_at(F.array(*[F.lit(str(c)) for c in classes]), F.col("_k") + 1)).withColumn("y", F.when(F.col("_l") == F.col("class"), 1.0).otherwise(0.0))
    share = long.groupBy("class").agg(F.sum("y").alias("members"))
    r = on(rga(long, ["class"]), share, ["class"])
    r = r.select("class", F.col("members").cast("bigint").alias("n"), "rga", F.when(F.col("rga").isNull(), F.when(F.col("members") == 0, "no rows of this class").otherwise("only rows of this class")).otherwise("").alias("note"))
    w = F.when(F.col("rga").isNotNull(), F.lit(1.0) if average == "macro" else F.col("n"))
    mean = r.agg(F.sum("n").cast("bigint").alias("n"), F.try_divide(F.sum(F.col("rga") * w), F.sum(w)).alias("rga"))
    return r.unionByName(mean.select(F.lit(None).cast("string").alias("class"), "n", "rga", F.lit(average).alias("note")))


def models_long(df: DataFrame, y: str, scores: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """row_id, y, model, z."""
    return df.select(row_id, y, *scores).unpivot([row_id, y], list(scores), "model", "z")


def compare_models(df: DataFrame, y: str, scores: Sequence[str], baseline: str | None = None, method: str = "jackknife", level: float = 0.95, row_id: str = "row_id", n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """model, rga, standard_error, ci_low, ci_high, place, difference, p_value: each model, and its paired test against the baseline, the lowest one by default.

    All scores are ranked over the rows that have all of them, so that every comparison is over the same rows.
    """
    scores = columns(df, list(scores), "scores")
    if baseline is not None and baseline not in scores:
        raise BadInput(f"baseline {baseline!r} is none of the scores")
    if method not in METHODS:
        raise BadInput(f"unknown method {method!r}")
    zc, k = gauss.quantile(1 - (1 - check_level(level)) / 2), len(scores)
    if method == "bootstrap":
        long = models_long(df.filter(finite(*[F.col(c).try_cast("double") for c in (y, *scores)])), y, scores, row_id)
        point = rga(long, ["model"], y, "z", least=3).select("model", "rga")
        reps = bootstrap_values(long, ["model"], y, "z", row_id, n_resamples, seed)
        base = point.filter(F.col("model") == baseline) if baseline else point.orderBy(F.col("rga").asc_nulls_last(), "model").limit(1)
        base = base.select(F.col("model").alias("_mb"), F.col("rga").alias("_rb"))
        ref = reps.join(F.broadcast(base), F.col("model") == F.col("_mb")).select(F.col("rep").alias("_rep"), F.col("value").alias("_base"))  # n_resamples rows
        se = reps.join(ref, F.col("rep") == F.col("_rep")).groupBy("model").agg(F.stddev_samp("value").alias("standard_error"), F.stddev_samp(F.col("value") - F.col("_base")).alias("_se"))
        r = point.join(se, "model").crossJoin(F.broadcast(base))
    else:
        rows, sums = ranked(df, (), y, scores, [])
        names = F.array(*[F.lit(s) for s in scores])
        values = F.array(*[F.when(F.col("_rows") >= 3, from_sums(i, k)[0]) for i in range(k)])
        points = sums.select(values.alias("_rga"), names.alias("_name"))
        order = F.array_sort(F.arrays_zip(F.transform("_rga", lambda v: F.coalesce(v, F.lit(2.0))).alias("v"), F.col("_name").alias("m")))
        points = points.withColumn("_mb", F.lit(baseline) if baseline else order[0]["m"]).withColumn("_at", F.array_position("_name", F.col("_mb")).cast("int"))
        at = F.broadcast(points.select("_at"))  # one row
        v = [ROW_VALUES[method](i, k) for i in range(k)]
        d = rows.select(*[c.alias(f"_v{i}") for i, c in enumerate(v)]).crossJoin(at).withColumn("_base", F.element_at(F.array(*[F.col(f"_v{i}") for i in range(k)]), F.col("_at")))
        n = F.count("*")
        own = (lambda c: F.sqrt((n - 1) * F.var_pop(c))) if method == "jackknife" else (lambda c: F.stddev_samp(c) / F.sqrt(n))
        wide = F.stddev_samp if method != "jackknife" else (lambda c: F.stddev_samp(c) * (n - 1))
        a = d.agg(F.array(*[F.struct(own(f"_v{i}").alias("se"), (wide(F.col(f"_v{i}") - F.col("_base")) / F.sqrt(n)).alias("paired")) for i in range(k)]).alias("_s"))
        r = points.crossJoin(F.broadcast(a)).withColumn("_rb", F.element_at("_rga", F.col("_at"))).select("_mb", "_rb", F.explode(F.arrays_zip("_name", "_rga", "_s")).alias("_e"))
        r = r.select("_mb", "_rb", F.col("_e._name").alias("model"), F.col("_e._rga").alias("rga"), F.col("_e._s.se").alias("standard_error"), F.col("_e._s.paired").alias("_se"))
    r = r.withColumns({"ci_low": F.col("rga") - zc * F.col("standard_error"), "ci_high": F.col("rga") + zc * F.col("standard_error"), "difference": F.when(F.col("model") != F.col("_mb"), F.col("rga") - F.col("_rb"))})
    p = F.when(F.col("_se") > 0, gauss.two_sided(F.try_divide(F.col("difference"), F.col("_se")))).when(F.col("difference") == 0, 1.0).when(F.col("difference").isNotNull(), 0.0)
    place = F.row_number().over(Window.orderBy(F.col("rga").desc_nulls_last(), "model"))  # a row a model
    return r.select("model", "rga", "standard_error", "ci_low", "ci_high", place.cast("bigint").alias("place"), "difference", F.when(F.col("difference").isNotNull(), p).alias("p_value"))


def by_segment(df: DataFrame, segment: str, y: str = "y", z: str = "z", min_size: int = 50, level: float = 0.95, method: str = "jackknife") -> DataFrame:
    """segment, n, rga, standard_error, ci_low, ci_high, reliable, note; lowest first, undefined ones last; rows without a label are refused."""
    no_missing_labels(df, [segment])
    e = estimate(df, [segment], y, z, method, level)
    e = e.select(segment, "n", "rga", "standard_error", "ci_low", "ci_high", (F.col("n") >= min_size).alias("reliable"), "note")
    return e.orderBy(F.col("rga").asc_nulls_last(), segment)


def contamination(df: DataFrame, y: str = "y", z: str = "z", row_id: str = "row_id", fractions: Sequence[float] = (0.0, 0.01, 0.02, 0.05, 0.1), magnitude: float = 50.0, n_repeats: int = 20, seed: int = 0) -> DataFrame:
    """fraction, rga, rmse, rga_change, rmse_change: means over draws in which that share of targets is shifted by +-magnitude standard deviations."""
    s = df.agg(F.count("*").alias("_n"), F.stddev_pop(y).alias("_sd"))
    n = s.first()["_n"]
    if n < 10:
        from ranktide.errors import TooFewRows

        raise TooFewRows(f"{n} rows; at least 10 are needed")
    spec = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(int(round(f * n))).alias("take")) for f in fractions])
    long = df.select(row_id, y, z, F.explode(spec).alias("_f")).select(row_id, y, z, "_f.fraction", "_f.take").crossJoin(F.broadcast(s)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    long = numbered(long.withColumn("_u", uniform(seed, "pick", F.col("rep"), F.col(row_id))), ["fraction", "rep"], ["_u", row_id], spread_evenly(F.col("_u"), df), "_place")
    shift = F.when(F.col("_place") <= F.col("take"), F.when(uniform(seed, "sign", F.col("rep"), F.col(row_id)) < 0.5, -1.0).otherwise(1.0) * magnitude * F.col("_sd")).otherwise(0.0)
    long = long.withColumn("y2", F.col(y) + shift)
    a = rga(long, ["fraction", "rep"], "y2", z, cuts=cut_points(df, [y, z, y]))
    b = long.groupBy("fraction", "rep").agg(F.sqrt(F.avg(F.pow(F.col("y2") - F.col(z), F.lit(2.0)))).alias("rmse"))
    r = on(a, b, ["fraction", "rep"]).groupBy("fraction").agg(F.avg("rga").alias("rga"), F.avg("rmse").alias("rmse"))
    clean = on(rga(df, (), y, z), df.agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(z), F.lit(2.0)))).alias("_rmse")), ())
    r = r.crossJoin(F.broadcast(clean.select(F.col("rga").alias("_rga"), "_rmse")))
    return r.select("fraction", "rga", "rmse", F.try_divide(F.col("rga") - F.col("_rga"), F.col("_rga")).alias("rga_change"), F.try_divide(F.col("rmse") - F.col("_rmse"), F.col("_rmse")).alias("rmse_change"))


__all__ = ["NOTE_CONSTANT", "NOTE_FEW", "auroc", "by_segment", "compare", "compare_models", "contamination", "kendall", "one_vs_rest", "reference_measures", "report"]
