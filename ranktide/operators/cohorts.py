"""Cohort search: the bins of one or two features in which the ranking is worst."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranktide.errors import BadInput
from ranktide.functions.hashing import uniform
from ranktide.functions.quantiles import exact
from ranktide.functions.ranks import Cuts, cut_points
from ranktide.operators import permuting
from ranktide.operators.inference import estimate
from ranktide.operators.measure import on, rga
from ranktide.operators.resampling import measured
from ranktide.sources.frames import columns, count, is_numeric

#: Cohorts whose bins a row carries as one vector of permutations.
COHORTS = 4096


def bin_columns(df: DataFrame, features: Sequence[str], n_bins: int = 4) -> list[tuple[str, Column]]:
    """(feature, column with the label of the row's bin) for each feature.

    Numbers of up to ``n_bins`` distinct values have one bin a value, others half-open
    quantile bins of which the last is closed; other types one bin a level.  Missing and
    infinite values are a bin of their own.  Digit strings count as numbers.
    """
    names = columns(df, features, "features")
    count(n_bins, "n_bins", 2)
    num = {c: F.when(F.abs(F.col(c).try_cast("double")) < float("inf"), F.col(c).try_cast("double")) for c in names}
    odd = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in names]).first()
    numeric = [c for c in names if is_numeric(df, c) or not odd[c]]
    kinds = df.agg(*[F.count_distinct(num[c]).alias(c) for c in numeric]).first() if numeric else None
    few = [c for c in numeric if kinds[c] <= n_bins]
    quantiles = exact(df, {c: num[c] for c in numeric if c not in few}, [i / n_bins for i in range(n_bins + 1)])
    levels = df.agg(*[F.sort_array(F.collect_set(num[c])).alias(c) for c in few]).first() if few else None  # n_bins values at most
    out = []
    for c in names:
        missing = F.lit(f"{c} is missing")
        if c not in numeric:
            out.append((c, F.when(F.col(c).isNull(), missing).otherwise(F.concat(F.lit(f"{c} == '"), F.col(c).cast("string"), F.lit("'")))))
            continue
        x = num[c]
        if c in few:
            label = F.when(x.isNull(), missing)
            for v in levels[c]:
                label = label.when(x == v, f"{c} == {v:g}")
            out.append((c, label))
            continue
        edges = sorted(set(quantiles[c]))
        label = F.when(x.isNull(), missing)
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            last = i == len(edges) - 2
            label = label.when((x >= lo) & ((x <= hi) if last else (x < hi)), f"{lo:g} <= {c} {'<=' if last else '<'} {hi:g}")
        out.append((c, label))
    return out


def memberships(df: DataFrame, features: Sequence[str], n_bins: int = 4, max_depth: int = 2, min_size: int = 100, row_id: str = "row_id") -> DataFrame:
    """row_id, label, depth for every cohort of at least ``min_size`` rows that is not the whole table."""
    if max_depth not in (1, 2):
        raise BadInput("max_depth is 1 or 2")
    count(min_size, "min_size", 2)
    bins = bin_columns(df, features, n_bins)
    wide = df.select(row_id, *[b.alias(f"_b{i}") for i, (_, b) in enumerate(bins)])
    n = df.count()
    one = wide.select(row_id, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_b{i}").alias("bin")) for i in range(len(bins))])).alias("_c")).select(row_id, "_c.i", "_c.bin")
    proper = one.groupBy("i", "bin").count().filter((F.col("count") < n) & (F.col("count") >= min_size)).select(F.col("i").alias("_i"), F.col("bin").alias("_bin"))
    one = one.join(proper, (F.col("i") == F.col("_i")) & (F.col("bin") == F.col("_bin"))).select(row_id, "i", "bin")
    out = one.select(row_id, F.col("bin").alias("label"), F.lit(1).alias("depth"))
    if max_depth == 2:
        # the bins of a row, then every two of them
        lists = one.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("i", "bin"))).alias("_l"))
        two = lists.select(row_id, F.posexplode("_l").alias("_p", "_a"), "_l").select(row_id, "_a", F.explode(F.expr("slice(_l, _p + 2, size(_l))")).alias("_b"))
        two = two.select(row_id, F.concat_ws(" and ", F.col("_a.bin"), F.col("_b.bin")).alias("label"), F.lit(2).alias("depth"))
        large = two.groupBy("label").count().filter(F.col("count") >= min_size).select(F.col("label").alias("_label"))
        out = out.unionByName(two.join(large, F.col("label") == F.col("_label")).drop("_label"))
    return out


def search(df: DataFrame, features: Sequence[str], y: str = "y", z: str = "z", n_bins: int = 4, max_depth: int = 2, min_size: int = 100, row_id: str = "row_id") -> DataFrame:
    """label, depth, n, rga, shortfall (the whole table's measure less the cohort's); cohorts with a constant target are left out."""
    m = memberships(df, features, n_bins, max_depth, min_size, row_id).withColumnRenamed(row_id, "_id")
    long = df.select(row_id, y, z).join(m, F.col(row_id) == F.col("_id")).select("label", "depth", y, z)
    cuts = cut_points(df, [y, z, y])
    r = rga(long, ["label", "depth"], y, z, cuts=cuts).filter("rga is not null")
    whole = rga(df, (), y, z, cuts=cuts).select(F.col("rga").alias("_whole"))
    return r.crossJoin(F.broadcast(whole)).select("label", F.col("depth").cast("int").alias("depth"), "n", "rga", (F.col("_whole") - F.col("rga")).alias("shortfall"))


def worst(df: DataFrame, features: Sequence[str], y: str = "y", z: str = "z", n_bins: int = 4, max_depth: int = 2, min_size: int = 100, top: int = 10, level: float = 0.95, row_id: str = "row_id") -> DataFrame:
    """The ``top`` cohorts of the search, lowest first, with standard_error, ci_low, ci_high."""
    found = search(df, features, y, z, n_bins, max_depth, min_size, row_id).orderBy("rga", "label").limit(top)
    rows = found.collect()  # ``top`` rows
    best = df.sparkSession.createDataFrame(rows, found.schema)
    m = memberships(df, features, n_bins, max_depth, min_size, row_id).withColumnRenamed(row_id, "_id").filter(F.col("label").isin([r["label"] for r in rows]))
    long = df.select(row_id, y, z).join(m, F.col(row_id) == F.col("_id")).select(row_id, "label", y, z)
    e = estimate(long, ["label"], y, z, level=level).select("label", "standard_error", "ci_low", "ci_high")
    return on(best, e, ["label"], "left").orderBy("rga", "label")


def search_p_value(df: DataFrame, features: Sequence[str], y: str = "y", z: str = "z", n_bins: int = 4, max_depth: int = 2, min_size: int = 100, n_permutations: int = 200, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """worst_rga, p_value: (1 + permutations whose worst cohort is at or below the observed one) / (permutations + 1).

    Cohort memberships are permuted against the rows, inside strata (``permuting``).  Up to ``COHORTS`` cohorts each row carries one vector of its bins in all permutations, and all cohorts of all
    permutations are measured in one sorted pass; more cohorts are measured as rows of a long table, with the same permutations.
    """
    count(n_permutations, "n_permutations", 1)
    bins = bin_columns(df, features, n_bins)
    n = df.count()
    seen = search(df, features, y, z, n_bins, max_depth, min_size, row_id).agg(F.min("rga").alias("worst_rga"))
    cuts = cut_points(df, [y, z, y])
    part = permuting.stratum(seed, row_id, F.lit(n))
    every, pairs = _bins_of_cohorts(df, [b for _, b in bins], n, max_depth, min_size)
    if every is None:
        lows = _long_lows(df, memberships(df, features, n_bins, max_depth, min_size, row_id), part, cuts, y, z, n_permutations, row_id, seed)
    else:
        lows = _lows(df, [b for _, b in bins], every, pairs, part, cuts, n, y, z, n_permutations, row_id, seed)
    return lows.crossJoin(F.broadcast(seen)).groupBy("worst_rga").agg(((1.0 + F.count_if(F.col("low") <= F.col("worst_rga") + 1e-12)) / (n_permutations + 1.0)).alias("p_value"))


def _bins_of_cohorts(df: DataFrame, bins: Sequence[Column], n: int, max_depth: int, min_size: int) -> tuple[list[tuple[int, str]] | None, list[tuple[int, int]]]:
    """The bins (feature, label) of at least ``min_size`` rows but not all, and the pairs of them, as places in that list, that have as many; None if there are more than ``COHORTS``."""
    wide = df.select(*[b.alias(f"_b{i}") for i, b in enumerate(bins)])
    one = wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_b{i}").alias("bin")) for i in range(len(bins))])).alias("_c")).groupBy("_c.i", "_c.bin").count()
    every = [(r["i"], r["bin"]) for r in one.filter((F.col("count") < n) & (F.col("count") >= min_size)).limit(COHORTS + 1).collect()]  # a bounded number
    if len(every) > COHORTS:
        return None, []
    every.sort()
    if max_depth == 1 or len({i for i, _ in every}) < 2:
        return every, []
    at = _codes(bins, every)
    both = [F.struct(a.alias("a"), b.alias("b")) for k, a in enumerate(at) for b in at[k + 1 :]]
    two = df.select(F.explode(F.array(*both)).alias("_p")).filter("_p.a >= 0 and _p.b >= 0").groupBy("_p.a", "_p.b").count().filter(F.col("count") >= min_size)
    pairs = sorted((r["a"], r["b"]) for r in two.limit(COHORTS + 1).collect())
    return (None, []) if len(every) + len(pairs) > COHORTS else (every, pairs)


def _codes(bins: Sequence[Column], every: Sequence[tuple[int, str]]) -> list[Column]:
    """For each feature the place of the row's bin in the list, or -1."""
    out = []
    for i, b in enumerate(bins):
        mine = json.dumps({label: k for k, (j, label) in enumerate(every) if j == i})
        out.append(F.coalesce(F.try_element_at(F.from_json(F.lit(mine), "map<string,int>"), b), F.lit(-1)))
    return out


def _lows(df: DataFrame, bins: Sequence[Column], every: Sequence[tuple[int, str]], pairs: Sequence[tuple[int, int]], part: Column, cuts: Cuts, n: int, y: str, z: str, n_permutations: int, row_id: str, seed: int) -> DataFrame:
    """low: the least measure of a cohort, for each permutation."""
    blocks, cohorts = -(-n_permutations // permuting.BLOCK), len(every) + len(pairs)
    if not cohorts:
        return df.sparkSession.createDataFrame([], "low double")
    d = df.select(F.col(row_id).alias("_id"), F.col(row_id).cast("string").alias("_name"), F.col(y).try_cast("double").alias("_v0"), F.col(z).try_cast("double").alias("_v1"), F.array(*_codes(bins, every)).alias("_codes"), part.alias("_stratum"))
    d = d.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.groupBy("_stratum", "_block").applyInArrow(permuting.permuted_codes(seed, "cohort", n_permutations), "_v0 double, _v1 double, _block int, _drawn binary")
    width = min(n_permutations, permuting.BLOCK) * cohorts
    of, features = [i for i, _ in every], len(bins)
    first, second = np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)

    def unpack(drawn: Sequence[bytes]) -> np.ndarray:
        codes = np.frombuffer(b"".join(drawn), np.int16).reshape(len(drawn), -1, features)
        inside = codes[:, :, of] == np.arange(len(of), dtype=np.int16)
        w = np.zeros((len(drawn), width))
        w[:, : codes.shape[1] * cohorts] = np.concatenate([inside, inside[:, :, first] & inside[:, :, second]], axis=2).reshape(len(drawn), -1)
        return w

    m = measured(d, ["_block"], 1, cuts, n, width, unpack)
    return m.groupBy("_block", F.floor(F.col("_rep") / cohorts).alias("rep")).agg(F.min(F.when(F.col("_value0").isNotNull(), F.col("_value0"))).alias("low"))


def _long_lows(df: DataFrame, m: DataFrame, part: Column, cuts: Cuts, y: str, z: str, n_permutations: int, row_id: str, seed: int) -> DataFrame:
    """``_lows`` of any number of cohorts, with a row for each row and permutation."""
    each = F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1)))
    a = df.select(F.col(row_id).alias("_from"), part.alias("_stratum"), each.alias("rep"))
    a = a.withColumn("_u", uniform(seed, "cohort", F.col("rep"), F.col("_from")))
    a = a.select("rep", "_stratum", "_from", F.row_number().over(Window.partitionBy("_stratum", "rep").orderBy("_u", "_from")).alias("_k"))
    b = df.select(row_id, y, z, part.alias("_s2")).withColumn("_k2", F.row_number().over(Window.partitionBy("_s2").orderBy(row_id))).drop(row_id)
    j = a.join(b, (F.col("_stratum") == F.col("_s2")) & (F.col("_k") == F.col("_k2"))).join(m, F.col("_from") == F.col(row_id))
    return rga(j.select("rep", "label", y, z), ["rep", "label"], y, z, cuts=cuts).groupBy("rep").agg(F.min("rga").alias("low"))
