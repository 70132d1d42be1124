"""Standard errors, intervals and tests for the measure.

Values by row (leave-one-out and influence) come from sums by distinct score and by
distinct target, joined to the rows by equality; replicates come from ``resampling``, as a vector for each row.  All draws are hashes of (seed, stream, replicate, row).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.errors import BadInput
from ranktide.functions import gauss
from ranktide.functions.ranks import SENT, cut_points, finite, key_sums, part_sums, placed, rank_sums
from ranktide.operators import permuting
from ranktide.operators.measure import NOTE_CONSTANT, NOTE_FEW, from_sums, left_out, on, rga
from ranktide.operators.resampling import replicated
from ranktide.sources.frames import count, level as check_level

METHODS = ("jackknife", "influence", "bootstrap")


def ranked(df: DataFrame, keys: Sequence[str], y: str, values: Sequence[str], keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows, of the columns ``keep``, whose y and values are all finite, with facts of each row by each value and by y, and the ``rank_sums`` of the keys.

    Columns of the rows: ``_y`` (y less a constant, which changes no measure), ``_n``, ``_sy``, and for the k-th of (*values, y): ``_r<k>`` (mean rank),
    ``_u<k>`` (sum of _y over its ties), ``_c<k>`` (sum of _y up to it) and ``_p<k>`` (sum of _y times rank over the key).
    """
    every = [*values, y]
    cuts = cut_points(df, [y, *every])
    parts = part_sums(df, keys, y, every, None, cuts)
    # used several times and found once: small, and kept on two executors where the session has no folder for checkpoints
    parts = parts.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else parts.localCheckpoint(storageLevel=StorageLevel.MEMORY_AND_DISK_2)
    few = parts.count() <= SENT
    sums = key_sums(parts, keys, len(every))
    t = sums.select(*keys, F.col("_rows").alias("_n"), F.col("_s").alias("_sy"), *[(F.col(f"_p{k}") + F.col("_s") / 2.0).alias(f"_p{k}") for k in range(len(every))])
    return placed(df, keys, y, every, cuts, parts, t, keep, few), sums


def jackknife_value(k: int, target: int) -> Column:
    """The measure of the k-th value without the row, over ``ranked`` rows; null where that is not defined."""
    n, y, sy = F.col("_n"), F.col("_y"), F.col("_sy")
    rest = (sy - y) / F.nullif(n - 1, F.lit(0)) * ((n - 1) * n / 2.0)
    side = lambda i: F.col(f"_p{i}") - y * F.col(f"_r{i}") - (sy - F.col(f"_c{i}")) - 0.5 * (F.col(f"_u{i}") - y) - rest
    return F.when((n > 2) & (F.abs(side(target)) > 1e-9), 0.5 + F.try_divide(side(k), 2.0 * side(target)))


def influence_value(k: int, target: int) -> Column:
    """The influence of the row on the measure of the k-th value, over ``ranked`` rows."""
    n, y, mean = F.col("_n"), F.col("_y"), F.col("_sy") / F.col("_n")
    psi = lambda i: (F.col(f"_p{i}") / n - 0.5 * mean) / n  # noqa: E731  mean of y F
    tail = lambda i: (F.col("_sy") - F.col(f"_c{i}") + 0.5 * F.col(f"_u{i}")) / n
    inf = lambda i: y * (F.col(f"_r{i}") - 0.5) / n + tail(i) - 2.0 * psi(i) - 0.5 * (y - mean)
    num, den = psi(k) - 0.5 * mean, psi(target) - 0.5 * mean
    return F.when(F.abs(den) > 1e-14, inf(k) / (2.0 * den) - num * inf(target) / (2.0 * den * den))


ROW_VALUES = {"jackknife": jackknife_value, "influence": influence_value}


def jackknife_values(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    """The complete rows with ``value``: the measure without the row; null where that is not defined."""
    return ranked(df, keys, y, [z])[0].withColumn("value", jackknife_value(0, 1)).select(*df.columns, "value")


def influence_values(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z") -> DataFrame:
    """The complete rows with ``value``: the influence of the row on the measure."""
    return ranked(df, keys, y, [z])[0].withColumn("value", influence_value(0, 1)).select(*df.columns, "value")


def bootstrap_values(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z", row_id: str = "row_id", n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """keys, rep, value: the measure of each resample."""
    r = replicated(df, keys, y, [z], row_id, count(n_resamples, "n_resamples", 2), seed)
    return r.select(*keys, F.col("_rep").cast("bigint").alias("rep"), F.col("_value0").alias("value"))


def _sd(c: str) -> Column:
    return F.stddev_samp(c)


def interval(reps: DataFrame, point: DataFrame, keys: Sequence[str], level: float, kind: str, jack: DataFrame | None = None) -> DataFrame:
    """keys, ci_low, ci_high from replicates (keys, rep, value) and estimates (keys, rga)."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    if kind in ("percentile", "basic"):
        q = reps.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(lo), F.lit(hi))).alias("q"))
        q = on(q, point.select(*keys, "rga"), keys)
        if kind == "percentile":
            return q.select(*keys, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
        return q.select(*keys, (2 * F.col("rga") - F.col("q")[1]).alias("ci_low"), (2 * F.col("rga") - F.col("q")[0]).alias("ci_high"))
    if kind != "bca" or jack is None:
        raise BadInput(f"unknown interval {kind!r}")
    j = on(jack, jack.groupBy(*keys).agg(F.avg("value").alias("_m")), keys).withColumn("_d", F.col("_m") - F.col("value"))
    a = j.groupBy(*keys).agg(F.try_divide(F.sum(F.pow("_d", F.lit(3.0))), 6.0 * F.pow(F.sum(F.pow("_d", F.lit(2.0))), F.lit(1.5))).alias("acc"))
    s = on(reps, point.select(*keys, "rga"), keys).groupBy(*keys).agg(F.avg(F.when(F.col("value") < F.col("rga"), 1.0).otherwise(0.0)).alias("below"), F.sort_array(F.collect_list("value")).alias("v"))
    rows = on(s.select(*keys, F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), "below")).alias("below")), a, keys).collect()  # a row for each key
    fixed = []
    for r in rows:
        z0, acc = gauss.quantile(r["below"]), r["acc"] or 0.0
        at = []
        for p in (lo, hi):
            z = z0 + gauss.quantile(p)
            at.append(gauss.cdf(z0 + z / (1 - acc * z)))
        fixed.append((*[r[k] for k in keys], *at))
    spark = reps.sparkSession
    schema = ", ".join([*[f"`{k}` {reps.schema[k].dataType.simpleString()}" for k in keys], "p_lo double", "p_hi double"])
    m = on(s.select(*keys, "v"), spark.createDataFrame(fixed, schema), keys)

    def at(p: str) -> Column:
        h = F.col(p) * (F.size("v") - 1)
        k = F.floor(h).cast("int")
        x, nxt = F.col("v")[k], F.col("v")[F.least(k + 1, F.size("v") - 1)]
        return x + (h - k) * (nxt - x)

    return m.select(*keys, at("p_lo").alias("ci_low"), at("p_hi").alias("ci_high"))


def estimate(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z", method: str = "jackknife", level: float = 0.95, kind: str | None = None, row_id: str = "row_id", n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """keys, n, rga, standard_error, bias, ci_low, ci_high, note, gini, gini_low, gini_high, method, interval, level.

    The interval is normal for jackknife and influence, not clipped; for the bootstrap
    it is bca unless ``kind`` names another.  Fewer than three rows or a constant
    target: null and a note.
    """
    if method not in METHODS:
        raise BadInput(f"unknown method {method!r}")
    zc = gauss.quantile(1 - (1 - check_level(level)) / 2)
    if method == "bootstrap":
        point = rga(df, keys, y, z, least=3)
        reps = bootstrap_values(df, keys, y, z, row_id, n_resamples, seed).filter("value is not null")
        se = reps.groupBy(*keys).agg(_sd("value").alias("standard_error"), F.count("*").alias("_ok"))
        kind = kind or "bca"
        ci = interval(reps, point, keys, level, kind, jackknife_values(df, keys, y, z) if kind == "bca" else None)
        r = on(on(point, se, keys, "left") if keys else on(point, se, keys), ci, keys, "left") if keys else on(on(point, se, keys), ci, keys)
        ok = F.col("_ok") * 2 >= n_resamples
        r = r.select(*keys, "n", "rga", F.when(ok, F.col("standard_error")).alias("standard_error"), F.lit(None).cast("double").alias("bias"), F.when(ok, F.col("ci_low")).alias("ci_low"), F.when(ok, F.col("ci_high")).alias("ci_high"), "note")
        return r.select("*", *_record(method, kind, level))
    rows, sums = ranked(df, keys, y, [z], [])
    r = from_rows(rows.groupBy(*keys).agg(*spread(method)), sums, keys, method, zc)
    return r.select("*", *_record(method, "normal", level))


def _record(method: str, interval: str, level: float) -> list[Column]:
    """The Gini form of an estimate with its interval, and how they were found."""
    gini = [(2.0 * F.col(c) - 1.0).alias(n) for c, n in (("rga", "gini"), ("ci_low", "gini_low"), ("ci_high", "gini_high"))]
    return [*gini, F.lit(method).alias("method"), F.lit(interval).alias("interval"), F.lit(float(level)).alias("level")]


def spread(method: str, k: int = 0, target: int = 1) -> list[Column]:
    """Aggregates over ``ranked`` rows that the error of the k-th value needs."""
    v = ROW_VALUES[method](k, target)
    return [(F.var_pop(v) if method == "jackknife" else F.var_samp(v)).alias("_v"), F.avg(v).alias("_m"), F.count(v).alias("_k")]


def from_rows(spreads: DataFrame, sums: DataFrame, keys: Sequence[str], method: str, zc: float, more: Sequence[str] = ()) -> DataFrame:
    """The estimate from the aggregates of ``spread`` and ``rank_sums``; a key all of whose rows were left out has null and a note."""
    value, flat = from_sums()
    point = sums.withColumns({"_rga": value, "_flat": flat})
    r = on(point, spreads, keys, "left") if keys else point.crossJoin(F.broadcast(spreads))
    n = F.col("_rows")
    if method == "jackknife":
        se, bias, ok = F.sqrt((n - 1) * F.col("_v")), (n - 1) * (F.col("_m") - F.col("_rga")), F.col("_k") == n
    else:
        se, bias, ok = F.sqrt(F.col("_v") / n), F.lit(None).cast("double"), F.lit(True)
    ok = F.coalesce(ok & (n >= 3) & F.col("_rga").isNotNull(), F.lit(False))
    r = r.withColumns({"n": n, "rga": F.when(ok, F.col("_rga")), "standard_error": F.when(ok, se), "bias": F.when(ok, bias)})
    note = F.concat_ws("; ", F.when(n < 3, NOTE_FEW).when(F.col("_flat") | F.col("standard_error").isNull(), NOTE_CONSTANT), left_out())
    return r.select(*keys, "n", "rga", "standard_error", "bias", (F.col("rga") - zc * F.col("standard_error")).alias("ci_low"), (F.col("rga") + zc * F.col("standard_error")).alias("ci_high"), note.alias("note"), *more)


def compare(df: DataFrame, keys: Sequence[str] = (), y: str = "y", a: str = "za", b: str = "zb", method: str = "jackknife", level: float = 0.95, row_id: str = "row_id", n_resamples: int = 2000, seed: int = 0) -> DataFrame:
    """keys, n, rga_a, rga_b, difference, standard_error, ci_low, ci_high, statistic, p_value, significant (the interval excludes 0): paired, over the same rows or the same draws."""
    zc = gauss.quantile(1 - (1 - check_level(level)) / 2)
    if method not in METHODS:
        raise BadInput(f"unknown method {method!r}")
    if method == "bootstrap":
        complete = df.filter(finite(*[F.col(c).try_cast("double") for c in (y, a, b)]))  # the same rows for both
        ra, rb = rga(complete, keys, y, a, least=3), rga(complete, keys, y, b, least=3)
        point = on(ra.select(*keys, "n", F.col("rga").alias("rga_a")), rb.select(*keys, F.col("rga").alias("rga_b")), keys)
        both = replicated(complete, keys, y, [a, b], row_id, count(n_resamples, "n_resamples", 2), seed)
        se = both.groupBy(*keys).agg(F.stddev_samp(F.col("_value0") - F.col("_value1")).alias("standard_error"))
    else:
        rows, sums = ranked(df, keys, y, [a, b], [])
        enough = F.col("_rows") >= 3
        point = sums.select(*keys, F.col("_rows").alias("n"), F.when(enough, from_sums(0, 2)[0]).alias("rga_a"), F.when(enough, from_sums(1, 2)[0]).alias("rga_b"))
        value, n = ROW_VALUES[method], F.count("*")
        # each is used twice, so that they stay columns: inside the aggregate they make a method that the JVM does not compile
        d = rows.select(*keys, value(0, 2).alias("_va"), value(1, 2).alias("_vb"))
        d = d.groupBy(*keys).agg(F.stddev_samp(F.when(F.col("_va").isNotNull() & F.col("_vb").isNotNull(), F.col("_va") - F.col("_vb"))).alias("_sd"), n.alias("_m"))
        se = d.select(*keys, (F.col("_sd") * (F.col("_m") - 1 if method == "jackknife" else F.lit(1.0)) / F.sqrt("_m")).alias("standard_error"))
    r = on(point, se, keys).withColumn("difference", F.col("rga_a") - F.col("rga_b"))
    stat = F.when(F.col("standard_error") > 0, F.try_divide(F.col("difference"), F.col("standard_error"))).when(F.col("difference") == 0, 0.0).otherwise(F.signum("difference") * math.inf)
    p = F.when(F.col("standard_error") > 0, gauss.two_sided(F.try_divide(F.col("difference"), F.col("standard_error")))).when(F.col("difference") == 0, 1.0).otherwise(0.0)
    return r.select(*keys, "n", "rga_a", "rga_b", "difference", "standard_error", (F.col("difference") - zc * F.col("standard_error")).alias("ci_low"), (F.col("difference") + zc * F.col("standard_error")).alias("ci_high"), stat.alias("statistic"), p.alias("p_value"), ((F.col("difference") - zc * F.col("standard_error") > 0) | (F.col("difference") + zc * F.col("standard_error") < 0)).alias("significant"))


def test(df: DataFrame, keys: Sequence[str] = (), y: str = "y", z: str = "z", alternative: str = "greater", n_permutations: int | None = None, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """keys, n, rga, statistic, p_value: against a score that ranks at random.

    Without ``n_permutations`` the exact variance over all permutations is used; with it,
    ranks are permuted inside strata (``permuting``) and the p-value is (1 + as extreme) / (permutations + 1).
    """
    if alternative not in ("greater", "two-sided", "less"):
        raise BadInput(f"unknown alternative {alternative!r}")
    value, flat = from_sums()
    rows = F.col("_rows")
    sums = rank_sums(df, keys, y, [z, y]) if n_permutations is None else None
    d, sums = (None, sums) if sums is not None else ranked(df, keys, y, [z], [row_id])
    s = sums.withColumns({
        "n": rows, "rga": F.when(rows >= 2, value), "_vy": F.col("_s2") / rows - F.pow(F.col("_s") / rows, F.lit(2.0)),
        "_rr": (F.pow(rows, F.lit(3.0)) - rows - F.col("_t0")) / 12.0, "_den": F.col("_p1") - F.col("_s") * rows / 2.0,
    })
    r = s.withColumn("_sd", F.when((rows > 1) & ~flat, F.sqrt(F.col("_vy") * rows * F.col("_rr") / (rows - 1)) / (2.0 * F.nullif(F.abs("_den"), F.lit(0.0)))))
    point = s.select(*keys, "n", "rga")
    if n_permutations is None:
        stat = F.when(F.col("_sd") > 0, F.try_divide(F.col("rga") - 0.5, F.col("_sd"))).when(F.col("rga").isNotNull(), 0.0)
        tail = {"greater": gauss.upper(stat), "less": 1.0 - gauss.upper(stat), "two-sided": gauss.two_sided(stat)}[alternative]
        return r.select(*keys, "n", "rga", stat.alias("statistic"), F.when(F.col("_sd") > 0, tail).when(F.col("rga").isNotNull(), 1.0).alias("p_value"))
    count(n_permutations, "n_permutations", 1)
    g = [f"_g{i}" for i in range(len(keys))]
    d = d.select(*[F.col(k).alias(x) for k, x in zip(keys, g, strict=True)], F.col(row_id).alias("_id"), F.col(row_id).cast("string").alias("_name"), F.col("_y").alias("_y"), F.col("_r0").alias("_r"), permuting.stratum(seed, row_id, F.col("_n")).alias("_stratum"))
    schema = ", ".join([*[f"{x} {df.schema[k].dataType.simpleString()}" for k, x in zip(keys, g, strict=True)], "_s array<double>, _t double, _c bigint"])
    m = d.groupBy(*g, "_stratum").applyInArrow(permuting.permuted_products(seed, "perm", n_permutations), schema)
    m = m.select(*[F.col(x).alias(k) for k, x in zip(keys, g, strict=True)], F.posexplode("_s").alias("_rep", "_sum"), "_t", "_c").groupBy(*keys, "_rep").agg(F.sum("_sum").alias("_s"), F.sum("_t").alias("_t"), F.sum("_c").alias("_c"))
    m = on(m, s.select(*keys, "_den"), keys).withColumn("_v", 0.5 + (F.col("_s") - F.col("_t") * (F.col("_c") + 1) / 2.0) / (2.0 * F.nullif("_den", F.lit(0.0))))
    m = on(m, point.select(*keys, "rga"), keys)
    extreme = {"greater": F.col("_v") >= F.col("rga") - 1e-12, "less": F.col("_v") <= F.col("rga") + 1e-12, "two-sided": F.abs(F.col("_v") - 0.5) >= F.abs(F.col("rga") - 0.5) - 1e-12}[alternative]
    p = m.groupBy(*keys).agg(((1.0 + F.count_if(extreme)) / (n_permutations + 1.0)).alias("p_value"))
    return on(point.select(*keys, "n", "rga"), p, keys).select(*keys, "n", "rga", F.lit(None).cast("double").alias("statistic"), "p_value")
