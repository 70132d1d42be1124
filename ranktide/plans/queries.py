"""The registered queries of the engine, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktide.functions import ranks, sql
from ranktide.operators import accuracy, cohorts, explain, facade, fairness, inference, measure, outcomes, robust
from ranktide.operators.permuting import STRATUM
from ranktide.operators.resampling import PART
from ranktide.operators.scorer import score
from ranktide.plans import oracle as q
from ranktide.plans.scored import CUSTOMERS, LINES, MODEL, ORDERS, Linear, table
from ranktide.streaming import monitor

O, C, L = f"({ORDERS})", f"({CUSTOMERS})", f"({LINES})"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
REPS, DRAWS, SEED = 60, 400, 7
FEATURES = ["f1", "f2", "f3"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits: sums may differ in the last bits with the order of rows."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def query(name: str, source: str, sql: str | None = None) -> Callable:
    """Register a function of the source's table; the SQL's double columns must be rounded alike."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(table(spark, sf_dir, source)))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def R(x: str, name: str) -> str:  # noqa: N802
    return f"ROUND({x}, 6) + 0.0E0 AS {name}"


# --- ranks and the measure
query("rga_by_flag", LINES, f"SELECT g, n, {R('rga', 'rga')}, {R('2 * rga - 1', 'gini')} FROM {q.rga(L, ['g'])}")(lambda d: measure.rga(d, ["g"]).drop("note"))
query("rga_global", LINES, f"SELECT n, {R('rga', 'rga')} FROM {q.rga(L)}")(lambda d: measure.rga(d).select("n", "rga"))
query("rga_weighted", LINES, f"SELECT g, n, {R('rga', 'rga')} FROM {q.rga_w(L, ['g'], 'y', 'z', 'w')}")(lambda d: measure.rga(d, ["g"], weight="w").select("g", "n", "rga"))
_disc = lambda v: f"(RANK() OVER (PARTITION BY g ORDER BY {v}) - 1 + (COUNT(*) OVER (PARTITION BY g, {v}) - 1) / 2.0E0)"
query("rga_discrete", ORDERS, f"SELECT g, n, {R('(conc - ((n - 1) * s - inc)) / (2 * inc - (n - 1) * s)', 'rga')} FROM (SELECT g, COUNT(*) AS n, SUM(y) AS s, SUM(y * iz) AS conc, SUM(y * iy) AS inc FROM (SELECT g, y, {_disc('t')} AS iz, {_disc('y')} AS iy FROM {O}) GROUP BY g)")(lambda d: measure.discrete(d, ["g"], "y", "t"))
query("gini", ORDERS, f"SELECT s, {R('2 * rga - 1', 'gini')} FROM {q.rga(O, ['s'])}")(lambda d: measure.rga(d, ["s"]).select("s", "gini"))
query("average_ranks", ORDERS, f"SELECT row_id, {R(q.rank('t', ['g']), 'rank')}, DENSE_RANK() OVER (PARTITION BY g ORDER BY t) - 1 AS tie FROM {O}")(lambda d: ranks.row_facts(d, ["g"], "t").select("row_id", "rank", "tie"))
query("weighted_ranks", ORDERS, f"SELECT row_id, {R('SUM(w) OVER (PARTITION BY g ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (SUM(w) OVER (PARTITION BY g, t) - 1) / 2.0E0', 'rank')} FROM {O}")(lambda d: ranks.row_facts(d, ["g"], "t", weight="w").select("row_id", "rank"))
query("tie_and_suffix_sums", ORDERS, f"SELECT row_id, {R('SUM(y) OVER (PARTITION BY g, t)', 'tie_sum')}, {R('SUM(y) OVER (PARTITION BY g) - SUM(y) OVER (PARTITION BY g ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'above')} FROM {O}".replace(", 6)", ", 3)"))(lambda d: rounded(ranks.row_facts(d, ["g"], "t", {"y": F.col("y")}).select("row_id", F.col("y_tie").alias("tie_sum"), F.col("y_above").alias("above")), 3))
query("rank_table", ORDERS, f"SELECT t, CAST(COUNT(*) AS DOUBLE) AS n, {R('SUM(COUNT(*)) OVER (ORDER BY t) - (COUNT(*) - 1) / 2.0E0', 'rank')} FROM {O} GROUP BY t")(lambda d: ranks.by_value(d, [], "t", {}).select("t", "n", "rank"))
_curve = f"""SELECT g, k, {R('k / CAST(n AS DOUBLE)', 'fraction')}, {R('lo / tot', 'lorenz')}, {R('du / tot', 'dual_lorenz')}, {R('co / tot', 'concordance')} FROM (
  SELECT a.g, a.k, a.n, a.tot, a.lo, b.du, c.co FROM
  (SELECT g, ROW_NUMBER() OVER (PARTITION BY g ORDER BY y) AS k, COUNT(*) OVER (PARTITION BY g) AS n, SUM(y) OVER (PARTITION BY g) AS tot, SUM(y) OVER (PARTITION BY g ORDER BY y ROWS UNBOUNDED PRECEDING) AS lo FROM {O}) a JOIN
  (SELECT g, ROW_NUMBER() OVER (PARTITION BY g ORDER BY y DESC) AS k, SUM(y) OVER (PARTITION BY g ORDER BY y DESC ROWS UNBOUNDED PRECEDING) AS du FROM {O}) b USING (g, k) JOIN
  (SELECT g, ROW_NUMBER() OVER (PARTITION BY g ORDER BY z) AS k, SUM(m) OVER (PARTITION BY g ORDER BY z ROWS UNBOUNDED PRECEDING) AS co FROM (SELECT g, z, AVG(y) OVER (PARTITION BY g, z) AS m FROM {O})) c USING (g, k)
  UNION ALL SELECT DISTINCT g, 0, 1, 1, 0, 0, 0 FROM {O})"""
query("rga_curves", ORDERS, _curve)(lambda d: measure.curves(d, ["g"]))


def in_sql(d: DataFrame, text: str) -> DataFrame:
    """The query in Spark's SQL, with the functions of ``functions.sql``."""
    sql.register(d.sparkSession)
    d.createOrReplaceTempView("ranktide_scored")
    return d.sparkSession.sql(text)


def in_sql_by_value(d: DataFrame, key: str, text: str) -> DataFrame:
    """As ``in_sql``, over ``ranktide_ties``: key, side (y or z), first (least rank), ties and c (sum of centred targets) of each value of a side.

    Ranks are found in ranges of the value, so that no task orders a whole key.
    """
    known = F.col("y").isNotNull().cast("double")
    long = d.select(key, F.col("y").alias("_t"), known.alias("_known"), F.expr("stack(2, 'y', y, 'z', z) AS (side, v)"))
    v = ranks.by_value(long, [key, "side"], "v", {"t": F.col("_t"), "known": F.col("_known")})
    mean = F.try_divide(F.col("t_all"), F.col("known_all"))
    v = v.select(key, "side", (F.col("before") + 1).cast("bigint").alias("first"), F.col("n").cast("bigint").alias("ties"), (F.col("t") - F.col("known") * mean).alias("c"))
    v.createOrReplaceTempView("ranktide_ties")
    return in_sql(d, text)


query("sql_functions", ORDERS, f"SELECT s, {R('rga', 'rga')}, {R('2 * rga - 1', 'gini')} FROM {q.rga(O, ['s'])}")(lambda d: in_sql_by_value(d, "s", """
  SELECT s, rga, gini_of(rga) AS gini FROM (SELECT s, rga_of(SUM(c * mid_rank(first, ties)) FILTER (WHERE side = 'z'), SUM(c * mid_rank(first, ties)) FILTER (WHERE side = 'y')) AS rga
    FROM ranktide_ties GROUP BY s)"""))
query("sql_curve", ORDERS, f"SELECT g AS key, k, fraction, concordance FROM ({_curve})")(lambda d: in_sql(d, "SELECT * FROM rga_curve(TABLE(SELECT g AS key, y, z FROM ranktide_scored) PARTITION BY key ORDER BY z)"))

# --- inference
query("jackknife_values", ORDERS, f"SELECT g, row_id, {R('value', 'value')} FROM {q.jackknife(O, ['g'])}")(lambda d: inference.jackknife_values(d, ["g"]).select("g", "row_id", "value"))
query("influence_values", ORDERS, f"SELECT g, row_id, {R('value', 'value')} FROM {q.influence(O, ['g'])}")(lambda d: inference.influence_values(d, ["g"]).select("g", "row_id", "value"))
_ci = f"{R('rga', 'rga')}, {R('se', 'standard_error')}, {R(f'rga - {q.Z95!r} * se', 'ci_low')}, {R(f'rga + {q.Z95!r} * se', 'ci_high')}"
query("rga_ci_jackknife", ORDERS, f"SELECT g, n, {_ci}, {R('bias', 'bias')} FROM {q.estimate(O, ['g'])}")(lambda d: inference.estimate(d, ["g"]).select("g", "n", "rga", "standard_error", "ci_low", "ci_high", "bias"))
query("rga_ci_influence", ORDERS, f"SELECT g, n, {_ci} FROM (SELECT g, n, rga, sd / SQRT(n) AS se FROM {q.rga(O, ['g'])} JOIN (SELECT g, STDDEV_SAMP(value) AS sd FROM {q.influence(O, ['g'])} GROUP BY g) USING (g))")(lambda d: inference.estimate(d, ["g"], method="influence").select("g", "n", "rga", "standard_error", "ci_low", "ci_high"))


def boot(rel: str, keys: list[str], reps: int = REPS, y: str = "y", z: str = "z", seed: int = SEED) -> str:
    """keys, rep, value."""
    k, u = q.head(keys), lambda *of: q.uniform(str(seed), *of)
    reps_ = f"(SELECT range AS rep FROM range({reps}))"
    placed = f"(SELECT *, ROW_NUMBER() OVER ({q.part(keys)} ORDER BY row_id) - 1 AS i, COUNT(*) OVER ({q.part(keys)}) AS m FROM {rel})"
    # draws go to parts of places first, and to places of a part then
    dealt = f"""(SELECT {k}m, rep, CAST(FLOOR({u("'part'", 'rep', 'i')} * m) AS BIGINT) // {PART} AS p, COUNT(*) AS c FROM {placed} CROSS JOIN {reps_} WHERE m > {PART} GROUP BY {k}m, rep, p
      UNION ALL SELECT DISTINCT {k}m, rep, 0, m FROM {placed} CROSS JOIN {reps_} WHERE m <= {PART})"""
    place = f"CASE WHEN p = 0 THEN {u("'boot'", 'rep', 'j')} ELSE {u("'boot'", 'rep', 'p', 'j')} END"
    drawn = f"(SELECT {k}rep, idx, COUNT(*) AS w FROM (SELECT {k}rep, p * {PART} + CAST(FLOOR({place} * LEAST({PART}, m - p * {PART})) AS BIGINT) AS idx FROM (SELECT *, UNNEST(range(c)) AS j FROM {dealt})) GROUP BY {k}rep, idx)"
    weighted = f"(SELECT {k}rep, {y}, {z}, CAST(w AS DOUBLE) AS w FROM {drawn} JOIN (SELECT *, ROW_NUMBER() OVER ({q.part(keys)} ORDER BY row_id) - 1 AS idx FROM {rel}) USING ({k}idx))"
    wr = lambda v: f"(SUM(w) OVER ({q.part(keys, 'rep')} ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (SUM(w) OVER ({q.part(keys, 'rep', v)}) - 1) / 2.0E0)"
    return f"(SELECT {k}rep, 0.5E0 + SUM(w * (_y - mu) * rz) / (2.0E0 * SUM(w * (_y - mu) * ry)) AS value FROM (SELECT {k}rep, w, {y} AS _y, SUM(w * {y}) OVER ({q.part(keys, 'rep')}) / SUM(w) OVER ({q.part(keys, 'rep')}) AS mu, {wr(y)} AS ry, {wr(z)} AS rz FROM {weighted}) GROUP BY {k}rep)"


# the weights of a resample are not scaled by the operator's mean-1 rule: they sum to the rows that were drawn
query("bootstrap_values", CUSTOMERS, None)(lambda d: inference.bootstrap_values(d, ["g"], n_resamples=REPS, seed=SEED))
query("rga_ci_bootstrap", CUSTOMERS, None)(lambda d: inference.estimate(d, ["g"], method="bootstrap", kind="percentile", n_resamples=REPS, seed=SEED).select("g", "n", "rga", "standard_error", "ci_low", "ci_high"))
query("rga_ci_bca", CUSTOMERS, None)(lambda d: inference.estimate(d, ["g"], method="bootstrap", n_resamples=REPS, seed=SEED).select("g", "n", "rga", "standard_error", "ci_low", "ci_high"))
ORACLE["bootstrap_values"] = f"SELECT g, rep, {R('value', 'value')} FROM {boot(C, ['g'])}"
ORACLE["rga_ci_bootstrap"] = f"SELECT g, n, {R('rga', 'rga')}, {R('sd', 'standard_error')}, {R('lo', 'ci_low')}, {R('hi', 'ci_high')} FROM {q.rga(C, ['g'])} JOIN (SELECT g, STDDEV_SAMP(value) AS sd, QUANTILE_CONT(value, 0.025) AS lo, QUANTILE_CONT(value, 0.975) AS hi FROM {boot(C, ['g'])} GROUP BY g) USING (g)"
_cmp = lambda values, se: f"""SELECT s, n, {R('ra', 'rga_a')}, {R('rb', 'rga_b')}, {R('ra - rb', 'difference')}, {R('se', 'standard_error')}, {R(f'ra - rb - {q.Z95!r} * se', 'ci_low')}, {R(f'ra - rb + {q.Z95!r} * se', 'ci_high')}, {R('(ra - rb) / se', 'statistic')}, {R(q.two_sided('((ra - rb) / se)'), 'p_value')}, (ra - rb - {q.Z95!r} * se > 0 OR ra - rb + {q.Z95!r} * se < 0) AS significant FROM (
  SELECT s, a.n AS n, a.rga AS ra, b.rga AS rb, {se} AS se FROM {q.rga(O, ['s'])} a JOIN {q.rga(O, ['s'], 'y', 'zb')} b USING (s) JOIN (
    SELECT s, STDDEV_SAMP(x.value - w.value) AS sd FROM {values(O, ['s'], 'y', 'z')} x JOIN {values(O, ['s'], 'y', 'zb')} w USING (s, row_id) GROUP BY s) d USING (s))"""  # noqa: E731
query("compare_jackknife", ORDERS, _cmp(q.jackknife, "sd * (a.n - 1) / SQRT(a.n)"))(lambda d: inference.compare(d, ["s"], "y", "z", "zb"))
query("compare_influence", ORDERS, _cmp(q.influence, "sd / SQRT(a.n)"))(lambda d: inference.compare(d, ["s"], "y", "z", "zb", method="influence"))
query("compare_bootstrap", CUSTOMERS, f"SELECT {R('ra - rb', 'difference')}, {R('sd', 'standard_error')} FROM (SELECT a.rga AS ra, b.rga AS rb FROM {q.rga(C)} a, {q.rga(C, [], 'y', 'zb')} b) CROSS JOIN (SELECT STDDEV_SAMP(x.value - w.value) AS sd FROM {boot(C, [])} x JOIN {boot(C, [], z='zb')} w USING (rep))")(lambda d: inference.compare(d, [], "y", "z", "zb", method="bootstrap", n_resamples=REPS, seed=SEED).select("difference", "standard_error"))
_test = f"(SELECT g, n, rga, (rga - 0.5E0) / sd AS t FROM {q.rga(O, ['g'], 'y', 'w')} JOIN (SELECT g, SQRT(VAR_POP(y) * COUNT(*) * SUM((rz - m) * (rz - m)) / (COUNT(*) - 1)) / (2.0E0 * ABS(SUM(y * (ry - m)))) AS sd FROM (SELECT g, y, {q.rank('w', ['g'])} AS rz, {q.rank('y', ['g'])} AS ry, (COUNT(*) OVER (PARTITION BY g) + 1) / 2.0E0 AS m FROM {O}) GROUP BY g) USING (g))"
query("test_analytic", ORDERS, f"SELECT g, n, {R('rga', 'rga')}, {R('t', 'statistic')}, {R(q.upper('t'), 'p_value')} FROM {_test}")(lambda d: inference.test(d, ["g"], "y", "w"))
query("test_two_sided", ORDERS, f"SELECT g, n, {R('rga', 'rga')}, {R('t', 'statistic')}, {R(q.two_sided('t'), 'p_value')} FROM {_test}")(lambda d: inference.test(d, ["g"], "y", "w", "two-sided"))
_st = lambda rel: f"(SELECT *, FLOOR({q.uniform(str(SEED), chr(39) + 'stratum' + chr(39), 'row_id')} * CEIL(COUNT(*) OVER () / {STRATUM}.0E0)) AS st FROM {rel})"
_at = lambda stream: f"ROW_NUMBER() OVER (PARTITION BY rep, st ORDER BY {q.uniform(str(SEED), chr(39) + stream + chr(39), 'rep', 'row_id')}, row_id) AS k"
_perm = f"""SELECT {R(f'(1.0E0 + SUM(CASE WHEN v >= r - 1E-12 THEN 1 ELSE 0 END)) / ({REPS} + 1.0E0)', 'p_value')} FROM (SELECT a.rep, 0.5E0 + SUM((a.y - mu) * b.rz) / (2.0E0 * MAX(den)) AS v FROM
  (SELECT rep, st, y, ROW_NUMBER() OVER (PARTITION BY rep, st ORDER BY row_id) AS k FROM {_st(C)} CROSS JOIN (SELECT range AS rep FROM range({REPS}))) a JOIN
  (SELECT rep, st, rz, {_at('perm')} FROM {_st(f"(SELECT row_id, {q.rank('f2')} AS rz FROM {C})")} CROSS JOIN (SELECT range AS rep FROM range({REPS}))) b USING (rep, st, k)
  CROSS JOIN (SELECT AVG(y) AS mu, SUM((y - m) * ry) AS den FROM (SELECT y, AVG(y) OVER () AS m, {q.rank('y')} AS ry FROM {C})) GROUP BY a.rep) CROSS JOIN (SELECT rga AS r FROM {q.rga(C, [], 'y', 'f2')})"""
query("test_permutation", CUSTOMERS, _perm)(lambda d: inference.test(d, [], "y", "f2", n_permutations=REPS, seed=SEED).select("p_value"))

# --- accuracy
_auc = f"(SELECT g, (SUM(CASE WHEN yb = 1 THEN rz ELSE 0 END) - SUM(yb) * (SUM(yb) + 1) / 2.0E0) / (SUM(yb) * (COUNT(*) - SUM(yb))) AS auroc FROM (SELECT g, yb, {q.rank('z', ['g'])} AS rz FROM {O}) GROUP BY g)"
query("auroc", ORDERS, f"SELECT g, {R('auroc', 'auroc')} FROM {_auc}")(lambda d: accuracy.auroc(d, ["g"], "yb"))
query("reference_measures", ORDERS, f"SELECT g, {R('CORR(y, z)', 'pearson')}, {R('CORR(ry, rz)', 'spearman')}, {R('SQRT(AVG((y - z) * (y - z)))', 'rmse')}, {R('AVG(ABS(y - z))', 'mae')}, COUNT(DISTINCT y) = 2 AS is_binary FROM (SELECT *, {q.rank('y', ['g'])} AS ry, {q.rank('z', ['g'])} AS rz FROM {O}) GROUP BY g")(lambda d: accuracy.reference_measures(d, ["g"]))
_kend = f"""SELECT {R('s / SQRT((p - ty) * (p - tz))', 'kendall')} FROM (SELECT CAST(SUM(CASE WHEN a.f3 < b.f3 AND a.f2 < b.f2 THEN 1 WHEN a.f3 < b.f3 AND a.f2 > b.f2 THEN -1 ELSE 0 END * a.m * b.m) AS DOUBLE) AS s FROM (SELECT f3, f2, COUNT(*) AS m FROM {C} GROUP BY f3, f2) a, (SELECT f3, f2, COUNT(*) AS m FROM {C} GROUP BY f3, f2) b)
  CROSS JOIN (SELECT COUNT(*) * (COUNT(*) - 1) / 2.0E0 AS p FROM {C}) CROSS JOIN (SELECT SUM(t * (t - 1) / 2.0E0) AS ty FROM (SELECT COUNT(*) AS t FROM {C} GROUP BY f3)) CROSS JOIN (SELECT SUM(t * (t - 1) / 2.0E0) AS tz FROM (SELECT COUNT(*) AS t FROM {C} GROUP BY f2))"""
query("kendall", CUSTOMERS, _kend)(lambda d: accuracy.kendall(d, [], "f3", "f2"))
query("kendall_continuous", CUSTOMERS, f"SELECT a.g AS g, {R('SUM(SIGN(a.y - b.y) * SIGN(a.z - b.z)) / (SQRT(SUM(CASE WHEN a.y <> b.y THEN 1.0E0 ELSE 0.0E0 END)) * SQRT(SUM(CASE WHEN a.z <> b.z THEN 1.0E0 ELSE 0.0E0 END)))', 'kendall')} FROM {C} a JOIN {C} b ON a.g = b.g GROUP BY a.g")(lambda d: accuracy.kendall(d, ["g"], "y", "z"))
_null = f"(SELECT g, SQRT(VAR_POP(yb) * COUNT(*) * SUM((rz - m) * (rz - m)) / (COUNT(*) - 1)) / (2.0E0 * ABS(SUM(yb * (ry - m)))) AS sd FROM (SELECT g, yb, {q.rank('z', ['g'])} AS rz, {q.rank('yb', ['g'])} AS ry, (COUNT(*) OVER (PARTITION BY g) + 1) / 2.0E0 AS m FROM {O}) GROUP BY g)"
_usual = f"(SELECT g, CORR(yb, z) AS pearson, CORR(ry, rz) AS spearman, SQRT(AVG((yb - z) * (yb - z))) AS rmse, AVG(ABS(yb - z)) AS mae FROM (SELECT *, {q.rank('yb', ['g'])} AS ry, {q.rank('z', ['g'])} AS rz FROM {O}) GROUP BY g)"
# tau-b of two target values: concordant less discordant pairs, over the square root of the pairs that are no ties in either
_tau = f"""(SELECT g, (2.0E0 * (SUM(yb * rz) - a * (a + 1) / 2.0E0) - a * (m - a)) / SQRT(a * (m - a) * (m * (m - 1) / 2.0E0 - tz)) AS kendall FROM (SELECT g, yb, {q.rank('z', ['g'])} AS rz, SUM(yb) OVER (PARTITION BY g) AS a, COUNT(*) OVER (PARTITION BY g) AS m FROM {O})
  JOIN (SELECT g, SUM(t * (t - 1) / 2.0E0) AS tz FROM (SELECT g, COUNT(*) AS t FROM {O} GROUP BY g, z) GROUP BY g) USING (g) GROUP BY g, a, m, tz)"""
_rep = f"""SELECT g, e.n AS n, {R('e.rga', 'rga')}, {R('se', 'standard_error')}, {R(f'e.rga - {q.Z95!r} * se', 'ci_low')}, {R(f'e.rga + {q.Z95!r} * se', 'ci_high')}, {R('2 * e.rga - 1', 'gini')}, {R(f'2 * (e.rga - {q.Z95!r} * se) - 1', 'gini_low')}, {R(f'2 * (e.rga + {q.Z95!r} * se) - 1', 'gini_high')}, TRUE AS is_binary,
  {R('pearson', 'pearson')}, {R('spearman', 'spearman')}, {R('kendall', 'kendall')}, ROUND(rmse, 2) + 0.0E0 AS rmse, ROUND(mae, 2) + 0.0E0 AS mae, {R('auroc', 'auroc')}, {R(q.upper('((e.rga - 0.5E0) / sd)'), 'p_value')}, '' AS note
  FROM {q.estimate(O, ['g'], 'yb', 'z')} e JOIN {_auc} USING (g) JOIN {_null} USING (g) JOIN {_usual} USING (g) JOIN {_tau} USING (g)"""
query("accuracy_report", ORDERS, _rep)(lambda d: accuracy.report(d, ["g"], "yb", "z", with_kendall=True).withColumns({"rmse": F.round("rmse", 2), "mae": F.round("mae", 2)}))
_cls = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_ovr_rel = f"(SELECT c AS class, CASE WHEN g = c THEN 1.0E0 ELSE 0.0E0 END AS y, CASE WHEN g = c THEN 0.5E0 ELSE 0.0E0 END + ((row_id + k * 7) % 13) / 13.0E0 AS z FROM {O} CROSS JOIN (VALUES {', '.join(f'({i}, {c!r})' for i, c in enumerate(_cls))}) v(k, c))"
_ovr = f"SELECT class, CAST(m AS BIGINT) AS n, {R('rga', 'rga')} FROM {q.rga(_ovr_rel, ['class'])} JOIN (SELECT class, SUM(y) AS m FROM {_ovr_rel} GROUP BY class) USING (class)"
query("one_vs_rest", ORDERS, f"{_ovr} UNION ALL SELECT NULL, CAST(SUM(n) AS BIGINT), {R('AVG(r)', 'rga')} FROM (SELECT n, rga AS r FROM ({_ovr.replace('ROUND(rga, 6) + 0.0E0', 'rga')}))")(
    lambda d: accuracy.one_vs_rest(d.withColumn("proba", F.array(*[F.when(F.col("g") == c, 0.5).otherwise(0.0) + ((F.col("row_id") + i * 7) % 13) / 13.0 for i, c in enumerate(_cls)])), "g", "proba", _cls).drop("note"))
_models = f"(SELECT row_id, y, 'z' AS model, z FROM {O} UNION ALL SELECT row_id, y, 'zb', zb FROM {O} UNION ALL SELECT row_id, y, 'f2', f2 FROM {O})"
_pair = f"(SELECT model, STDDEV_SAMP(x.value - base.value) * (COUNT(*) - 1) / SQRT(COUNT(*)) AS sp FROM {q.jackknife(_models, ['model'])} x JOIN (SELECT row_id, value FROM {q.jackknife(_models, ['model'])} WHERE model = (SELECT MIN_BY(model, rga) FROM {q.rga(_models, ['model'])})) base USING (row_id) GROUP BY model)"
_diff = "CASE WHEN rga > lo + 1E-9 THEN rga - lo END"
query("compare_models", ORDERS, f"""SELECT model, {R('rga', 'rga')}, {R('se', 'standard_error')}, {R(f'rga - {q.Z95!r} * se', 'ci_low')}, {R(f'rga + {q.Z95!r} * se', 'ci_high')}, ROW_NUMBER() OVER (ORDER BY rga DESC) AS place, {R(_diff, 'difference')},
  {R(f'CASE WHEN rga > lo + 1E-9 THEN {q.two_sided("((rga - lo) / sp)")} END', 'p_value')} FROM {q.estimate(_models, ['model'])} JOIN {_pair} USING (model) CROSS JOIN (SELECT MIN(rga) AS lo FROM {q.rga(_models, ['model'])})""")(lambda d: accuracy.compare_models(d, "y", ["z", "zb", "f2"]))
query("by_segment", ORDERS, f"SELECT g, n, {R('rga', 'rga')}, {R('se', 'standard_error')}, {R(f'rga - {q.Z95!r} * se', 'ci_low')}, {R(f'rga + {q.Z95!r} * se', 'ci_high')}, n >= 50 AS reliable, '' AS note FROM {q.estimate(O, ['g'], 'yb', 'zb')}")(lambda d: accuracy.by_segment(d, "g", "yb", "zb"))
_fr = [0.0, 0.01, 0.02, 0.05, 0.1]
_cont = f"(SELECT fraction, rep, z, y + CASE WHEN rn <= ROUND_EVEN(fraction * n, 0) THEN CASE WHEN {q.uniform(str(SEED), chr(39) + 'sign' + chr(39), 'rep', 'row_id')} < 0.5E0 THEN -1.0E0 ELSE 1.0E0 END * 50.0E0 * sd ELSE 0.0E0 END AS y2 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fraction, rep ORDER BY {q.uniform(str(SEED), chr(39) + 'pick' + chr(39), 'rep', 'row_id')}, row_id) AS rn FROM {C} CROSS JOIN (SELECT COUNT(*) AS n, STDDEV_POP(y) AS sd FROM {C}) CROSS JOIN (SELECT range AS rep FROM range(5)) CROSS JOIN (VALUES {', '.join(f'({f!r}E0)' for f in _fr)}) v(fraction)))"
query("contamination", CUSTOMERS, f"SELECT fraction, {R('AVG(rga)', 'rga')}, ROUND(AVG(rmse), 4) + 0.0E0 AS rmse FROM {q.rga(_cont, ['fraction', 'rep'], 'y2')} JOIN (SELECT fraction, rep, SQRT(AVG((y2 - z) * (y2 - z))) AS rmse FROM {_cont} GROUP BY fraction, rep) USING (fraction, rep) GROUP BY fraction")(lambda d: accuracy.contamination(d, fractions=_fr, n_repeats=5, seed=SEED).select("fraction", "rga", F.round("rmse", 4).alias("rmse")))

# --- explainability
_m = MODEL


def without(cols: dict[str, str], rel: str = O, stats: str = "") -> str:
    """row_id, y (full score), z (score with columns replaced)."""
    model = " " + _m
    for c, v in cols.items():
        model = model.replace(f" {c} ", f" {v} ").replace(f" {c}", f" {v}") if model.endswith(c) else model.replace(f" {c} ", f" {v} ")
    return f"(SELECT row_id, {_m} AS y,{model} AS z FROM {rel} r CROSS JOIN {stats})"


_avg = f"(SELECT AVG(f1) AS a1, AVG(f2) AS a2, AVG(f3) AS a3, MEDIAN(f1) AS m1, MEDIAN(f2) AS m2, MEDIAN(f3) AS m3 FROM {O}) st"
_md = f"(SELECT (SELECT f2 FROM {O} GROUP BY f2 ORDER BY COUNT(*) DESC, f2 LIMIT 1) AS o2, (SELECT f3 FROM {O} GROUP BY f3 ORDER BY COUNT(*) DESC, f3 LIMIT 1) AS o3) st"
_one = lambda p, stats, fs: " UNION ALL ".join(f"SELECT '{f}' AS variable, n, {R('1 - rga', 'rge')} FROM {q.rga(without({f: f'st.{p}{f[1]}'}, O, stats))}" for f in fs)
query("rge_mean", ORDERS, _one("a", _avg, FEATURES))(lambda d: explain.rge(d, d, MODEL, FEATURES))
query("rge_median", ORDERS, _one("m", _avg, FEATURES))(lambda d: explain.rge(d, d, MODEL, FEATURES, method="median"))
query("rge_mode", ORDERS, _one("o", _md, ["f2", "f3"]))(lambda d: explain.rge(d, d, MODEL, ["f2", "f3"], method="mode"))
query("rge_group", ORDERS, f"SELECT 'f1+f2' AS variable, n, {R('1 - rga', 'rge')} FROM {q.rga(without({'f1': 'st.a1', 'f2': 'st.a2'}, O, _avg))}")(lambda d: explain.rge_group(d, d, MODEL, ["f1", "f2"]))
query("rge_normalized", ORDERS, f"SELECT 'f1' AS variable, n, {R('2 * (1 - rga)', 'rge')} FROM {q.rga(without({'f1': 'st.a1'}, O, _avg))}")(lambda d: explain.rge(d, d, MODEL, "f1", normalize=True))
query("rge_ci", ORDERS, f"SELECT 'f2' AS variable, n, {R('1 - rga', 'rge')}, {R(f'1 - rga - {q.Z95!r} * se', 'rge_low')}, {R(f'1 - rga + {q.Z95!r} * se', 'rge_high')} FROM {q.estimate(without({'f2': 'st.a2'}, O, _avg))}")(lambda d: explain.rge(d, d, MODEL, "f2", ci=True))
_pm = f"(SELECT a.row_id, a.f1, b.f2, a.f3, a.f2 AS own FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY row_id) AS k FROM {O}) a JOIN (SELECT f2, ROW_NUMBER() OVER (ORDER BY {q.uniform(str(SEED), chr(39) + 'permute' + chr(39), 'row_id')}, row_id) AS k FROM {O}) b USING (k))"
query("rge_permute", ORDERS, f"SELECT 'f2' AS variable, n, {R('1 - rga', 'rge')} FROM {q.rga(f'(SELECT row_id, f1 + 2000.0E0 * own + 500.0E0 * f3 AS y, {_m} AS z FROM {_pm})')}")(lambda d: explain.rge(d, d, MODEL, "f2", method="permute", seed=SEED))
_masks = f"(SELECT mask, y, CASE WHEN mask & 1 = 1 THEN a1 ELSE f1 END + 2000.0E0 * CASE WHEN (mask >> 1) & 1 = 1 THEN a2 ELSE f2 END + 500.0E0 * CASE WHEN (mask >> 2) & 1 = 1 THEN a3 ELSE f3 END AS z FROM (SELECT {_m} AS y, f1, f2, f3, a1, a2, a3, mask FROM {O} CROSS JOIN {_avg} CROSS JOIN (SELECT range AS mask FROM range(1, 8))))"
_v = f"(SELECT mask, 1 - rga AS v FROM {q.rga(_masks, ['mask'])} UNION ALL SELECT 0, 0.0E0)"
_steps = ", ".join(f"({m}, {m | 1 << j}, 'f{j + 1}', {(2 if bin(m).count('1') in (0, 2) else 1) / 6!r}E0)" for m in range(8) for j in range(3) if not m >> j & 1)
query("shapley", ORDERS, f"SELECT variable, {R('SUM(w * (b.v - a.v))', 'value')} FROM (VALUES {_steps}) s(i, j, variable, w) JOIN {_v} a ON a.mask = s.i JOIN {_v} b ON b.mask = s.j GROUP BY variable")(lambda d: explain.shapley(d, d, MODEL, FEATURES))
query("rgf", ORDERS, f"SELECT n, {R('rga', 'rgf')}, {R('1 - rga', 'rge')} FROM {q.rga(without({'f3': 'st.a3'}, O, _avg))}")(lambda d: explain.rgf(d, d, MODEL, "f3"))

# --- robustness
def swapped(c: str, m: float, rel: str = O) -> str:
    """rel's rows with column c tail-swapped."""
    return f"(SELECT a.* EXCLUDE (k, n) REPLACE (COALESCE(b.x, a.{c}) AS {c}) FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {c}, row_id) AS k, COUNT(*) OVER () AS n FROM {rel}) a LEFT JOIN (SELECT {c} AS x, ROW_NUMBER() OVER (ORDER BY {c}, row_id) AS k FROM {rel}) b ON b.k = a.n + 1 - a.k AND (a.k <= LEAST(CEIL({m!r}E0 * a.n), a.n - CEIL({1 - m!r}E0 * a.n)) OR a.k > a.n - LEAST(CEIL({m!r}E0 * a.n), a.n - CEIL({1 - m!r}E0 * a.n))))"


def vs(changed: str, rel: str = O) -> str:
    return f"(SELECT x.row_id, x.y, w.z FROM (SELECT row_id, {_m} AS y FROM {rel}) x JOIN (SELECT row_id, {_m} AS z FROM {changed}) w USING (row_id))"


query("tailswap", ORDERS, f"SELECT row_id, f2, {R('f1', 'f1')} FROM {swapped('f1', 0.1)}")(lambda d: robust.perturb(d, "f1", 0.1).select("row_id", "f2", "f1"))
query("rgr", ORDERS, " UNION ALL ".join(f"SELECT '{c}' AS variable, n, {R('rga', 'rgr')} FROM {q.rga(vs(swapped(c, 0.05)))}" for c in FEATURES))(lambda d: robust.rgr(d, MODEL, FEATURES).select("variable", "n", "rgr"))
query("rgr_group", ORDERS, f"SELECT 'f1+f2' AS variable, n, {R('rga', 'rgr')} FROM {q.rga(vs(swapped('f2', 0.2, swapped('f1', 0.2))))}")(lambda d: robust.rgr(d, MODEL, ["f1", "f2"], 0.2, group=True).select("variable", "n", "rgr"))
query("rgr_ci", ORDERS, f"SELECT 'f2' AS variable, n, {R('rga', 'rgr')}, 0.0E0 AS spread, {R('se', 'standard_error')}, {R(f'rga - {q.Z95!r} * se', 'ci_low')}, {R(f'rga + {q.Z95!r} * se', 'ci_high')} FROM {q.estimate(vs(swapped('f2', 0.05)))}")(lambda d: robust.rgr(d, MODEL, "f2", ci=True))
_grid = [0.05, 0.2, 0.5]
_pts = " UNION ALL ".join(f"SELECT '{c}' AS variable, {m!r}E0 AS magnitude, rga AS r FROM {q.rga(vs(swapped(c, m)))}" for c in ("f1", "f2") for m in _grid)
query("rgr_curve", ORDERS, f"SELECT variable, magnitude, {R('r', 'rgr')}, {R('SUM(area) OVER (PARTITION BY variable) / 0.5E0', 'aurgr')} FROM (SELECT *, (r + COALESCE(LAG(r) OVER w, 1.0E0)) / 2.0E0 * (magnitude - COALESCE(LAG(magnitude) OVER w, 0.0E0)) AS area FROM ({_pts}) WINDOW w AS (PARTITION BY variable ORDER BY magnitude))")(lambda d: robust.rgr_curve(d, MODEL, ["f1", "f2"], _grid))
_ga = " UNION ALL ".join(f"SELECT {r} AS rep, rga FROM {q.rga(vs(f'(SELECT a.* REPLACE (f1 + 0.1E0 * sd * {q.normal(str(SEED), chr(39) + chr(103) + chr(97) + chr(117) + chr(115) + chr(115) + chr(39), str(r), chr(114) + chr(111) + chr(119) + chr(95) + chr(105) + chr(100))} AS f1) FROM {O} a CROSS JOIN (SELECT STDDEV_POP(f1) AS sd FROM {O}))'))}" for r in range(3))
query("rgr_gaussian", ORDERS, f"SELECT 'f1' AS variable, {R('AVG(rga)', 'rgr')}, {R('STDDEV_SAMP(rga)', 'spread')} FROM ({_ga})")(lambda d: robust.rgr(d, MODEL, "f1", 0.1, "gaussian", n_repeats=3, seed=SEED).select("variable", "rgr", "spread"))
_sh = f"(SELECT a.row_id, a.f1, b.f2, a.f3 FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY row_id) AS k FROM {O}) a JOIN (SELECT f2, ROW_NUMBER() OVER (ORDER BY {q.uniform(str(SEED), chr(39) + 'shuffle:0' + chr(39), 'row_id')}, row_id) AS k FROM {O}) b USING (k))"
query("rgr_shuffle", ORDERS, f"SELECT 'f2' AS variable, {R('rga', 'rgr')} FROM {q.rga(vs(_sh))}")(lambda d: robust.rgr(d, MODEL, "f2", kind="shuffle", seed=SEED).select("variable", "rgr"))

_stream = lambda d: f"'shuffle:{d}'"
_shd = lambda d: vs(f"(SELECT a.row_id, a.f1, b.f2, a.f3 FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY row_id) AS k FROM {C}) a JOIN (SELECT f2, ROW_NUMBER() OVER (ORDER BY {q.uniform(str(SEED), _stream(d), 'row_id')}, row_id) AS k FROM {C}) b USING (k))", C)
_draws = " UNION ALL ".join(f"SELECT {d} AS d, rep, value FROM {boot(_shd(d), [])}" for d in range(2))
_points = " UNION ALL ".join(f"SELECT rga FROM {q.rga(_shd(d))}" for d in range(2))
query("rgr_bootstrap", CUSTOMERS, f"SELECT 'f2' AS variable, {R('m', 'rgr')}, {R('s', 'spread')}, {R('SQRT(v + s * s / 2)', 'standard_error')} FROM (SELECT AVG(rga) AS m, STDDEV_SAMP(rga) AS s FROM ({_points})) CROSS JOIN (SELECT VAR_SAMP(x) AS v FROM (SELECT rep, AVG(value) AS x FROM ({_draws}) GROUP BY rep))")(
    lambda d: robust.rgr(d, MODEL, "f2", kind="shuffle", n_repeats=2, ci=True, ci_method="bootstrap", n_resamples=REPS, seed=SEED).select("variable", "rgr", "spread", "standard_error"))

# --- ranking fairness
_pg = f"(SELECT g, n, rga, se, place FROM {q.estimate(O, ['g'], 'yb', 'z')} JOIN (SELECT g, MIN(row_id) AS place FROM {O} GROUP BY g) USING (g))"
query("parity_groups", ORDERS, f"SELECT g AS \"group\", n, {_ci}, n >= 50 AS included FROM {_pg}")(lambda d: fairness.parity_groups(d, "g", "yb").select("group", "n", "rga", "standard_error", "ci_low", "ci_high", "included"))
_nd = lambda rel, se: f"(SELECT place, rep, {se} AS se, {se} * {q.normal(str(SEED), chr(39) + 'null' + chr(39), 'rep', 'place')} AS draw FROM {rel} CROSS JOIN (SELECT range AS rep FROM range({DRAWS})))"
_maxt = lambda draws: f"(SELECT a.rep, MAX(ABS(a.draw - b.draw) / SQRT(a.se * a.se + b.se * b.se)) AS t FROM {draws} a JOIN {draws} b ON a.rep = b.rep AND a.place < b.place GROUP BY a.rep)"
_pp = f"(SELECT a.g AS a, b.g AS b, a.rga - b.rga AS d, SQRT(a.se * a.se + b.se * b.se) AS s FROM {_pg} a JOIN {_pg} b ON a.place < b.place)"
query("parity_pairs", ORDERS, f"SELECT a, b, {R('d', 'difference')}, {R('s', 'standard_error')}, {R(q.two_sided('(d / s)'), 'p_value')}, {R(f'(1.0E0 + (SELECT COUNT(*) FROM {_maxt(_nd(_pg, chr(115) + chr(101)))} m WHERE m.t >= ABS(d / s))) / ({DRAWS} + 1.0E0)', 'p_adjusted')} FROM {_pp}")(lambda d: fairness.parity_pairs(fairness.parity_groups(d, "g", "yb"), DRAWS, SEED))
query("parity_gap", ORDERS, f"SELECT {R('MAX(rga) - MIN(rga)', 'gap')}, MAX_BY(g, rga) AS best, MIN_BY(g, rga) AS worst, {R(f'(SELECT AVG(x) FROM (SELECT rep, MAX(draw) - MIN(draw) AS x FROM {_nd(_pg, chr(115) + chr(101))} GROUP BY rep))', 'noise_floor')} FROM {_pg}")(lambda d: fairness.parity(d, "g", "yb", n_resamples=DRAWS, seed=SEED, gap_interval=False).select("gap", "best", "worst", "noise_floor"))
query("parity_gap_interval", CUSTOMERS, f"SELECT {R('QUANTILE_CONT(x, 0.025)', 'gap_low')}, {R('QUANTILE_CONT(x, 0.975)', 'gap_high')} FROM (SELECT rep, MAX(value) - MIN(value) AS x FROM {boot(C, ['g'])} GROUP BY rep)")(lambda d: fairness.parity(d, "g", n_resamples=REPS, seed=SEED).select("gap_low", "gap_high"))
query("labels_from_dummies", ORDERS, f"SELECT row_id, CASE WHEN d1 = 1 THEN 'd1' WHEN d2 = 1 THEN 'd2' ELSE 'other' END AS label FROM {O}")(lambda d: fairness.labels_from_dummies(d, ["d1", "d2"], "other").select("row_id", "label"))
_leak_rel = f"(SELECT variable, lv, CASE WHEN w = lv THEN 1.0E0 ELSE 0.0E0 END AS y, z FROM (SELECT w, 'f2' AS variable, f2 AS z FROM {O} UNION ALL SELECT w, 'f3', f3 FROM {O} UNION ALL SELECT w, 'z', z FROM {O}) CROSS JOIN (SELECT DISTINCT w AS lv FROM {O}))"
query("proxy_leakage", ORDERS, f"SELECT variable, {R('MAX(ABS(2 * rga - 1))', 'leakage')} FROM {q.rga(_leak_rel, ['variable', 'lv'])} GROUP BY variable")(lambda d: fairness.proxy_leakage(d.select("row_id", "w", "f2", "f3", "z"), "w").select("variable", "leakage"))

# --- outcome fairness
_th = 300000.0
_dec = f"(SELECT g, yb, row_id, CASE WHEN z >= {_th!r} THEN 1 ELSE 0 END AS d FROM {O})"
_rates = f"""(SELECT criterion, g, n, e, s, s / CAST(e AS DOUBLE) AS p, place FROM (SELECT g, COUNT(*) AS n, MIN(row_id) AS place, SUM(d) AS s0, SUM(CASE WHEN yb = 1 THEN 1 ELSE 0 END) AS e1, SUM(CASE WHEN yb = 1 THEN d ELSE 0 END) AS s1, SUM(CASE WHEN yb = 0 THEN d ELSE 0 END) AS s2 FROM {_dec} GROUP BY g)
  CROSS JOIN LATERAL (VALUES ('demographic_parity', n, s0), ('equal_opportunity', CAST(e1 AS BIGINT), s1), ('predictive_equality', n - CAST(e1 AS BIGINT), s2)) v(criterion, e, s))"""
_zz = q.Z95 * q.Z95
_mid, _half = f"((p + {_zz / 2!r} / e) / (1.0E0 + {_zz!r} / e))", f"({q.Z95!r} * SQRT(p * (1.0E0 - p) / e + {_zz / 4!r} / (CAST(e AS DOUBLE) * e)) / (1.0E0 + {_zz!r} / e))"
query("outcome_rates", ORDERS, f"SELECT criterion, g AS \"group\", n, CAST(e AS BIGINT) AS n_eligible, CAST(s AS BIGINT) AS n_selected, {R('p', 'rate')}, {R('SQRT(p * (1 - p) / e)', 'standard_error')}, {R(f'GREATEST(0.0E0, {_mid} - {_half})', 'ci_low')}, {R(f'LEAST(1.0E0, {_mid} + {_half})', 'ci_high')}, e >= 50 AS included FROM {_rates}")(lambda d: outcomes.rates(d, "g", "yb", "z", _th).drop("place", "note"))
_ac = lambda a, b: (f"(({a}.s + 1.0E0) / ({a}.e + 2.0E0) - ({b}.s + 1.0E0) / ({b}.e + 2.0E0))", f"({q.Z95!r} * SQRT(({a}.s + 1.0E0) / ({a}.e + 2.0E0) * (1 - ({a}.s + 1.0E0) / ({a}.e + 2.0E0)) / ({a}.e + 2.0E0) + ({b}.s + 1.0E0) / ({b}.e + 2.0E0) * (1 - ({b}.s + 1.0E0) / ({b}.e + 2.0E0)) / ({b}.e + 2.0E0)))")
_eo = f"(SELECT *, SQRT(pp * (1 - pp) / e) AS ne FROM (SELECT *, SUM(s) OVER () / CAST(SUM(e) OVER () AS DOUBLE) AS pp FROM {_rates} WHERE criterion = 'equal_opportunity'))"
_am, _ah = _ac("a", "b")
_t = "(a.p - b.p) / SQRT(a.ne * a.ne + b.ne * b.ne)"
query("outcome_pairs", ORDERS, f"SELECT a.g AS a, b.g AS b, {R('a.p - b.p', 'difference')}, {R('SQRT(a.ne * a.ne + b.ne * b.ne)', 'null_error')}, {R(f'{_am} - {_ah}', 'ci_low')}, {R(f'{_am} + {_ah}', 'ci_high')}, {R(q.two_sided('(' + _t + ')'), 'p_value')}, {R(f'(1.0E0 + (SELECT COUNT(*) FROM {_maxt(_nd(_eo, chr(110) + chr(101)))} m WHERE m.t >= ABS({_t}))) / ({DRAWS} + 1.0E0)', 'p_adjusted')} FROM {_eo} a JOIN {_eo} b ON a.place < b.place")(lambda d: outcomes.pairs(outcomes.rates(d, "g", "yb", "z", _th), "equal_opportunity", n_resamples=DRAWS, seed=SEED).drop("standard_error"))
_hm, _hh = _ac("h", "l")
_ends = f"(SELECT criterion, MAX_BY(g, p) AS hg, MIN_BY(g, p) AS lg FROM {_rates} GROUP BY criterion)"
query("outcome_gaps", ORDERS, f"SELECT criterion, {R('h.p - l.p', 'gap')}, h.g AS best, l.g AS worst, {R(f'{_hm} - {_hh}', 'gap_low')}, {R(f'{_hm} + {_hh}', 'gap_high')}, {R(f'CASE WHEN criterion = {chr(39)}demographic_parity{chr(39)} THEN l.p / h.p END', 'ratio')} FROM {_ends} x JOIN {_rates} h USING (criterion) JOIN {_rates} l USING (criterion) WHERE h.g = hg AND l.g = lg")(lambda d: outcomes.gaps(outcomes.rates(d, "g", "yb", "z", _th)).select("criterion", "gap", "best", "worst", "gap_low", "gap_high", "ratio"))
query("equalized_odds", ORDERS, f"SELECT {R('MAX(x)', 'equalized_odds')} FROM (SELECT criterion, MAX(p) - MIN(p) AS x FROM {_rates} WHERE criterion <> 'demographic_parity' GROUP BY criterion)")(lambda d: outcomes.equalized_odds(outcomes.gaps(outcomes.rates(d, "g", "yb", "z", _th))))

# --- cohorts
_fs = ["g", "d1", "f2"]
_qs = f"(SELECT QUANTILE_CONT(f2, 0.0) AS q0, QUANTILE_CONT(f2, 0.25) AS q1, QUANTILE_CONT(f2, 0.5) AS q2, QUANTILE_CONT(f2, 0.75) AS q3, QUANTILE_CONT(f2, 1.0) AS q4 FROM {O})"
_lab = lambda a, b, op: f"printf('%g', {a}) || ' <= f2 {op} ' || printf('%g', {b})"
_b = f"(SELECT row_id, yb AS y, z, 'g == ''' || g || '''' AS b0, 'd1 == ' || CASE WHEN d1 = 1 THEN '1' ELSE '0' END AS b1, CASE WHEN f2 < q1 THEN {_lab('q0', 'q1', '<')} WHEN f2 < q2 THEN {_lab('q1', 'q2', '<')} WHEN f2 < q3 THEN {_lab('q2', 'q3', '<')} ELSE {_lab('q3', 'q4', '<=')} END AS b2 FROM {O} CROSS JOIN {_qs})"
_coh = f"(SELECT y, z, 1 AS depth, UNNEST([b0, b1, b2]) AS label FROM {_b} UNION ALL SELECT y, z, 2, UNNEST([b0 || ' and ' || b1, b0 || ' and ' || b2, b1 || ' and ' || b2]) FROM {_b})"
query("cohort_search", ORDERS, f"SELECT label, depth, n, {R('rga', 'rga')}, {R('(SELECT rga FROM ' + q.rga(O, [], 'yb') + ') - rga', 'shortfall')} FROM {q.rga(_coh, ['label', 'depth'])} WHERE n >= 100 AND rga IS NOT NULL")(lambda d: cohorts.search(d, _fs, "yb", "z"))
query("cohort_worst", ORDERS, f"SELECT label, {R('rga', 'rga')} FROM {q.rga(_coh, ['label', 'depth'])} x WHERE n >= 100 AND x.rga IS NOT NULL ORDER BY x.rga, label LIMIT 10")(lambda d: cohorts.worst(d, _fs, "yb", "z").select("label", "rga"))
_cb = f"(SELECT row_id, yb AS y, z, st, g AS b0, CASE WHEN f3 < q1 THEN 1 WHEN f3 < q2 THEN 2 WHEN f3 < q3 THEN 3 ELSE 4 END AS b1 FROM {_st(C)} CROSS JOIN (SELECT QUANTILE_CONT(f3, 0.25) AS q1, QUANTILE_CONT(f3, 0.5) AS q2, QUANTILE_CONT(f3, 0.75) AS q3 FROM {C}))"
_moved = f"""(SELECT rep, y, z, b0, b1 FROM (SELECT st, y, z, ROW_NUMBER() OVER (PARTITION BY st ORDER BY row_id) AS k FROM {_cb}) JOIN (SELECT rep, st, b0, b1, {_at('cohort')} FROM {_cb} CROSS JOIN (SELECT range AS rep FROM range(20))) USING (st, k)
  UNION ALL SELECT -1, y, z, b0, b1 FROM {_cb})"""
_clows = f"(SELECT rep, MIN(rga) AS low FROM {q.rga(f'(SELECT rep, y, z, UNNEST([b0, CAST(b1 AS VARCHAR), b0 || CAST(b1 AS VARCHAR)]) AS label FROM {_moved})', ['rep', 'label'])} WHERE n >= 40 GROUP BY rep)"
_cp = f"SELECT {R('w', 'worst_rga')}, {R('(1.0E0 + SUM(CASE WHEN low <= w + 1E-12 THEN 1 ELSE 0 END)) / 21.0E0', 'p_value')} FROM {_clows} CROSS JOIN (SELECT low AS w FROM {_clows} WHERE rep = -1) WHERE rep >= 0 GROUP BY w"
query("cohort_p_value", CUSTOMERS, _cp)(lambda d: cohorts.search_p_value(d, ["g", "f3"], "yb", "z", min_size=40, n_permutations=20, seed=SEED))

# --- scores, facade, monitoring
query("score_sql", ORDERS, f"SELECT row_id, {R('-(' + _m + ')', 'z')} FROM {O}")(lambda d: score(d.drop("z"), MODEL, "z", greater_is_better=False).select("row_id", "z"))
query("score_python", ORDERS, f"SELECT row_id, {R('-(' + _m + ')', 'z')} FROM {O}")(lambda d: score(d.drop("z"), Linear(), "z", pos_label=0).select("row_id", "z"))
query("rge_python", ORDERS, _one("a", _avg, FEATURES))(lambda d: explain.rge(d, d, Linear(), FEATURES))
query("facade_rge", ORDERS, "SELECT variable, rge FROM (" + _one("a", _avg, FEATURES) + ")")(lambda d: facade.compute_rge_values(d, d, MODEL, FEATURES))
query("facade_rgr", ORDERS, "SELECT variable, rgr FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {R('rga', 'rgr')} FROM {q.rga(vs(swapped(c, 0.05)))}" for c in FEATURES) + ")")(lambda d: facade.compute_rgr_values(d, MODEL, FEATURES))
EVENTS = "SELECT ts, event_type, value AS y, CAST(FLOOR(value / 5.0E0) AS DOUBLE) + user_id % 3 AS z FROM events"
_ev = f"(SELECT date_trunc('day', ts) AS start, event_type, y, z FROM ({EVENTS}))"
query("monitor_daily", EVENTS, f"SELECT strftime(start, '%Y-%m-%d') AS day, event_type, n, {R('rga', 'rga')} FROM {q.rga(_ev, ['start', 'event_type'])}")(lambda d: monitor.measured(monitor.tie_counts(d, "ts", "y", "z", ["event_type"]), ["event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "rga"))
