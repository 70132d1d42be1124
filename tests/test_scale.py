"""What is there for scale, against plain loops: ranges, quantiles, Kendall's tau, draw vectors, and scores of Python models."""

import math
import random
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ranktide.errors import BadInput
from ranktide.functions import quantiles, ranks, sql
from ranktide.operators import accuracy, cohorts, concordance, estimators, explain, inference, measure, resampling, robust, scorer
from ranktide.operators.report import build
from ranktide.streaming import monitor
from test_measure import pair, plain_rga  # its folder is on the path

rng = random.Random(23)


# --- ranges
@pytest.mark.parametrize("n", [1, 15, 256, 257, 1000])
def test_ranges_of_any_number_of_cuts(spark, n):
    cuts = sorted({round(rng.gauss(0, 10), 3) for _ in range(n)})
    x = [rng.gauss(0, 12) for _ in range(300)] + cuts[:50]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", ranks.part_of("x", cuts).alias("p")).collect()
    assert all(r["p"] == 2 * sum(c < r["x"] for c in cuts) + (r["x"] in cuts) for r in got)


@pytest.mark.parametrize("rows", [40, 7, 2])
def test_parts_follow_the_count(spark, monkeypatch, rows):
    monkeypatch.setattr(ranks, "SAMPLED", 2.0)
    monkeypatch.setattr(ranks, "ROWS", rows)
    monkeypatch.setattr(ranks, "FRACTIONS", 64)
    z = [rng.random() for _ in range(600)]
    y = [float(rng.randrange(3)) for _ in z]
    d = pair(spark, y, z)
    cuts = ranks.cut_points(d, ["z"])[0][0]
    want = max(ranks.RANGES, math.ceil(600 / rows))
    assert len(cuts) == pytest.approx(want - 1, abs=2)
    fullest = d.groupBy(ranks.part_of("z", cuts)).count().agg(F.max("count")).first()[0]
    assert fullest <= max(2 * 600 / want, 4)
    assert measure.rga(d).first()["rga"] == pytest.approx(plain_rga(y, z), abs=1e-12)


# --- quantiles
@pytest.mark.parametrize("kind", ["spread", "ties", "one", "few"])
def test_quantiles_by_brackets(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "LIMIT", 3)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    x = [{"spread": rng.gauss(0, 1), "ties": float(rng.randrange(9)), "one": 5.0 if rng.random() < 0.7 else rng.random(), "few": 1.5}[kind] for _ in range(400)]
    d = spark.createDataFrame([(v, None) for v in x] + [(None, 2.0), (float("nan"), None), (math.inf, None)], "x double, other double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.777, 1.0]
    got = quantiles.exact(d, {"x": F.col("x"), "other": F.col("other"), "none": F.lit(None).cast("double")}, shares)
    assert got["x"] == pytest.approx(np.quantile(x, shares).tolist(), abs=1e-12)
    assert got["other"] == [2.0] * 6
    assert got["none"] is None
    assert quantiles.exact(d, {}, shares) == {}


# --- Kendall
def plain_tau(y, z):
    s = sum(((a > b) - (a < b)) * ((c > d) - (c < d)) for i, (a, c) in enumerate(zip(y, z, strict=True)) for b, d in list(zip(y, z, strict=True))[:i])
    pairs = lambda v: sum(v[i] != v[j] for i in range(len(v)) for j in range(i))
    return s / math.sqrt(pairs(y) * pairs(z))


def test_inversions():
    for n in (0, 1, 2, 3, 8, 33):
        a = np.array([rng.randrange(6) for _ in range(n)], dtype=np.int64)
        assert concordance.inversions(a) == sum(a[i] > a[j] for j in range(n) for i in range(j))


@pytest.mark.parametrize("kind", ["continuous", "levels", "hot"])
def test_kendall_in_many_parts(spark, monkeypatch, kind):
    monkeypatch.setattr(ranks, "SAMPLED", 2.0)
    one = lambda: {"continuous": rng.random(), "levels": float(rng.randrange(7)), "hot": 1.0 if rng.random() < 0.5 else rng.random() * 2}[kind]
    y = [one() for _ in range(150)]
    z = [v + one() for v in y]
    d = pair(spark, [*y, 1.0, None], [*z, float("nan"), 1.0], k=[float(i % 2) for i in range(152)])
    assert accuracy.kendall(d).first()["kendall"] == pytest.approx(plain_tau(y, z), abs=1e-12)
    for r in accuracy.kendall(d, ["k"]).collect():
        pick = [i for i in range(150) if i % 2 == r["k"]]
        assert r["kendall"] == pytest.approx(plain_tau([y[i] for i in pick], [z[i] for i in pick]), abs=1e-12)
    assert accuracy.kendall(pair(spark, [1, 1, 1], [1, 2, 3])).first()["kendall"] is None


# --- draws
def test_packed_counts_come_back():
    w = np.random.default_rng(3).poisson(1.0, (40, 77))
    w[3, 5], w[7] = 300, 0
    assert (resampling.unpacked(resampling.packed(w.astype(np.uint16)), 77) == w).all()
    assert (resampling.unpacked(resampling.packed(w[:2].astype(np.uint16)) + resampling.packed(w[3:4].astype(np.uint16)), 77) == w[[0, 1, 3]]).all()


def test_draws_in_parts_are_multinomial(spark, monkeypatch):
    """Counts of a replicate add up to the rows, over several parts, and vary as multinomial counts do."""
    monkeypatch.setattr(resampling, "PART", 16)
    monkeypatch.setattr(resampling, "BLOCK", 10)
    d = pair(spark, [float(i) for i in range(83)], [0.0] * 83, k=["a" if i < 70 else "b" for i in range(83)])
    rows, n = resampling.with_draws(d, ["k"], ["y"], "row_id", 300, 1)
    assert n == 83
    got = rows.collect()
    w = {r["_v0"]: resampling.unpacked([r["_drawn"]], 300)[0] for r in got}
    assert set(w) == {float(i) for i in range(83)}
    a, b = np.array([w[float(i)] for i in range(70)]), np.array([w[float(i)] for i in range(70, 83)])
    assert (a.sum(0) == 70).all() and (b.sum(0) == 13).all()
    assert a.mean(1).max() < 1.3 and a.mean(1).min() > 0.7
    assert a.var() == pytest.approx(1 - 1 / 70, abs=0.05)
    part = a[:16].sum(0)  # 16 of 70 rows
    assert part.var() == pytest.approx(70 * (16 / 70) * (54 / 70), rel=0.25)


@pytest.mark.parametrize("parts", [16, 4096])
def test_replicates_are_measures_of_resampled_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(resampling, "PART", parts)
    monkeypatch.setattr(resampling, "CHUNK", 7)
    monkeypatch.setattr(ranks, "SAMPLED", 2.0)
    y, z = [float(rng.randrange(5)) for _ in range(60)], [float(rng.randrange(20)) if rng.random() < 0.7 else 3.0 for _ in range(60)]
    other = [rng.random() for _ in y]
    d = pair(spark, [*y, 1.0], [*z, None], other=[*other, 1.0]).filter("row_id < 60")
    rows = resampling.with_draws(d, [], ["y", "z", "other"], "row_id", 12, 5)[0].collect()
    w = resampling.unpacked([r["_drawn"] for r in rows], 12).astype(int)
    for r in resampling.replicated(d, [], "y", ["z", "other"], "row_id", 12, 5).collect():
        drawn = [x for x, times in zip(rows, w[:, r["_rep"]], strict=True) for _ in range(times)]
        assert r["_value0"] == pytest.approx(plain_rga([x["_v0"] for x in drawn], [x["_v1"] for x in drawn]), abs=1e-11)
        assert r["_value1"] == pytest.approx(plain_rga([x["_v0"] for x in drawn], [x["_v2"] for x in drawn]), abs=1e-11)


def test_bootstrap_interval_of_several_draws(spark):
    d = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(120)], "row_id bigint, a double, b double")
    rows = [robust.rgr(d, "2 * a + b", "a", 0.5, "gaussian", n_repeats=m, ci=True, ci_method="bootstrap", n_resamples=60).first() for m in (2, 10)]
    assert all(r["ci_low"] < r["rgr"] < r["ci_high"] for r in rows)
    assert rows[1]["standard_error"] < rows[0]["standard_error"] * 1.05
    for options in ({"n_repeats": 0}, {"level": 1.5}, {"ci_method": "other"}, {"magnitude": float("nan")}):
        with pytest.raises(BadInput):
            robust.rgr(d, "a", "a", kind="gaussian", ci=True, **options)


# --- Python models
class Logit:
    """Fitted by gradient descent, as a library's estimator would be."""

    def fit(self, x, y):
        self.feature_names_in_, self.classes_ = list(x.columns), sorted(set(y))
        a, t = np.column_stack([x, np.ones(len(x))]), np.array([v == self.classes_[1] for v in y], float)
        self.w = np.zeros(a.shape[1])
        for _ in range(300):
            self.w += 0.5 * a.T @ (t - 1 / (1 + np.exp(-a @ self.w))) / len(a)
        return self

    def decision_function(self, x):
        return np.column_stack([x[self.feature_names_in_], np.ones(len(x))]) @ self.w

    def predict_proba(self, x):
        p = 1 / (1 + np.exp(-self.decision_function(x)))
        return np.column_stack([1 - p, p])

    def predict(self, x):
        return np.where(self.decision_function(x) > 0, self.classes_[1], self.classes_[0])


def only(model, *names):
    class Part:
        pass

    for n in names:
        setattr(Part, n, staticmethod(getattr(model, n)))
    out = Part()
    for n in ("classes_", "feature_names_in_"):
        setattr(out, n, getattr(model, n))
    return out


@pytest.fixture(scope="module")
def fitted():
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this module
    x = pd.DataFrame({"a": [rng.gauss(0, 1) for _ in range(200)], "b": [rng.gauss(0, 1) for _ in range(200)]})
    return x, Logit().fit(x, ["yes" if a + b / 2 + rng.gauss(0, 0.5) > 0 else "no" for a, b in zip(x["a"], x["b"], strict=True)])


def test_scores_of_fitted_estimators(spark, fitted):
    x, model = fitted
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x.to_numpy())], "row_id bigint, a double, b double").repartition(5)
    got = lambda m, **o: [r["z"] for r in scorer.score(d, m, "z", **o).orderBy("row_id").collect()]
    p, s = model.predict_proba(x), model.decision_function(x)
    assert got(model) == pytest.approx(p[:, 1].tolist())  # probabilities come first
    assert got(model, pos_label="no") == pytest.approx(p[:, 0].tolist())
    assert got(model, greater_is_better=False) == pytest.approx((-p[:, 1]).tolist())
    margin = only(model, "decision_function", "predict")
    assert got(margin) == pytest.approx(s.tolist())  # then the margin
    assert got(margin, pos_label="yes") == pytest.approx(s.tolist())
    assert got(margin, pos_label="no") == pytest.approx((-s).tolist())
    number = estimators.Batchwise(lambda f: f["a"] * 2)
    assert got(number, features=["a"]) == pytest.approx((x["a"] * 2).tolist())  # then predictions
    for bad in ("maybe", 3):
        with pytest.raises(BadInput):
            got(model, pos_label=bad)
    with pytest.raises(BadInput):
        got(number)
    with pytest.raises(BadInput):
        scorer.score(d.drop("b"), model)
    with pytest.raises(Exception, match="scores for"):
        got(estimators.Batchwise(lambda f: [1.0]), features=["a"])
    several = only(model, "predict_proba")
    several.classes_ = ["no", "perhaps", "yes"]
    with pytest.raises(BadInput):
        got(several)


def test_estimators_in_other_operators(spark, fitted):
    x, model = fitted
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x.to_numpy())], "row_id bigint, a double, b double")
    r = {v["variable"]: v["rge"] for v in explain.rge(d, d, only(model, "decision_function"), ["a", "b"]).collect()}
    w = model.w.tolist()
    want = {v["variable"]: v["rge"] for v in explain.rge(d, d, f"{w[0]!r} * a + {w[1]!r} * b", ["a", "b"]).collect()}
    assert r == pytest.approx(want, abs=1e-9)
    assert r["a"] > r["b"]


# --- checks and the report
def test_weights_below_zero_are_left_out_and_counted(spark):
    d = pair(spark, [1, 2, 3, 4, 9], [1, 3, 2, 4, 0], w=[1.0, 2.0, 1.0, 1.0, -1.0])
    r, clean = measure.rga(d, weight="w").first(), measure.rga(d.filter("w > 0"), weight="w").first()
    assert (r["n"], r["rga"]) == (4, pytest.approx(clean["rga"]))
    assert r["note"].startswith("1 rows left out")


def test_bins_are_checked(spark):
    d = pair(spark, [1, 2, 3], [1, 2, 3], f=["a", "b", "a"])
    for options in ({"n_bins": 1}, {"n_bins": 2.5}, {"min_size": 0}):
        with pytest.raises(BadInput):
            cohorts.search(d, ["f"], **options)


def test_report_with_every_section(spark):
    n = 80
    d = spark.createDataFrame([(i, float(i % 5 > 2), float(i % 7), float(i % 3), float(i % 2), "x" if i % 2 else "z") for i in range(n)], "row_id bigint, y double, f double, h double, p double, g string")
    out = build(d, "y", "f + h + p", train=d, variables=["f", "h"], group="g", protected=["p"], threshold=4.0, min_group_size=5, n_resamples=20)
    assert set(out.sections) == {"accuracy", "explainability", "robustness", "parity_groups", "parity", "outcomes", "leakage", "dependence"}
    assert all(out.sections.values()) and not out.warnings
    assert out.sections["dependence"][0]["rgf"] == pytest.approx(1 - explain.rge(d, d, "f + h + p", "p").first()["rge"])
    assert out.sections["accuracy"][0]["kendall"] is not None
    assert {r["variable"] for r in out.sections["leakage"]} >= {"f", "h", "model"}


def test_estimates_by_bootstrap_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PART", 8)
    y = [float(i % 4) for i in range(50)]
    z = [v + rng.random() * 3 for v in y]
    e = inference.estimate(pair(spark, y, z), method="bootstrap", kind="basic", n_resamples=80).first()
    assert e["ci_low"] < e["rga"] < e["ci_high"]


@pytest.mark.parametrize("method", ["jackknife", "bootstrap"])
def test_estimates_tell_how_they_were_found(spark, method):
    y = [float(i % 4) for i in range(40)]
    e = inference.estimate(pair(spark, y, [v + rng.random() * 3 for v in y]), method=method, level=0.9, n_resamples=30, kind="percentile").first()
    assert (e["method"], e["level"], e["interval"]) == (method, 0.9, "normal" if method == "jackknife" else "percentile")
    assert [e["gini"], e["gini_low"], e["gini_high"]] == pytest.approx([2 * e[c] - 1 for c in ("rga", "ci_low", "ci_high")])


def test_classes_default_to_the_labels(spark):
    rows = [(i, "abc"[i % 3], [float(i % 3 == k) + (i * (k + 2) % 7) / 10 for k in range(3)]) for i in range(30)]
    d = spark.createDataFrame(rows, "row_id bigint, label string, p array<double>")
    assert sorted(map(tuple, accuracy.one_vs_rest(d, "label", "p").collect()), key=repr) == sorted(map(tuple, accuracy.one_vs_rest(d, "label", "p", ["a", "b", "c"]).collect()), key=repr)
    with pytest.raises(BadInput, match="probabilities"):
        accuracy.one_vs_rest(d.withColumn("p", F.slice("p", 1, 2)), "label", "p")
    with pytest.raises(BadInput, match="no class"):
        accuracy.one_vs_rest(d, "label", "p", ["a", "b", "x"])


def test_report_warns_of_tiny_groups(spark):
    d = spark.createDataFrame([(i, float(i % 2), float(i % 7), "small" if i < 6 else "AB"[i % 2 * (i % 3 == 0)]) for i in range(90)], "row_id bigint, y double, f double, g string")
    out = build(d, "y", "f", group="g", min_group_size=10, n_resamples=20)
    assert any("small" in w and "6 rows" in w for w in out.warnings)


@pytest.mark.parametrize("kind", ["spread", "ties", "one"])
def test_discrete_definition_agrees(spark, monkeypatch, kind):
    monkeypatch.setattr(ranks, "SAMPLED", 2.0)
    z = [{"spread": rng.random(), "ties": float(rng.randrange(6)), "one": 2.0}[kind] for _ in range(120)]
    y = [float(rng.randrange(9)) for _ in z]
    d = pair(spark, [*y, None], [*z, 1.0])
    a, b = measure.discrete(d).first(), measure.rga(d).first()
    assert (a["n"], a["rga"]) == (120, pytest.approx(b["rga"], abs=1e-9))
    assert measure.discrete(pair(spark, [1, 1, 1], [1, 2, 3])).first()["rga"] is None


def test_curve_in_sql(spark):
    sql.register(spark)
    d = pair(spark, [3, 1, 2, 2, None, 5], [1, 1, 2, 3, 3, 3], key=["a", "a", "a", "b", "b", "b"])
    d.createOrReplaceTempView("scored_here")
    got = spark.sql("SELECT * FROM rga_curve(TABLE(SELECT key, y, z FROM scored_here) PARTITION BY key ORDER BY z)").collect()
    want = measure.curves(d.filter("y is not null"), ["key"]).collect()
    assert sorted((r["key"], r["k"], round(r["fraction"], 9), round(r["concordance"], 9)) for r in got) == sorted((r["key"], r["k"], round(r["fraction"], 9), round(r["concordance"], 9)) for r in want)
    assert spark.sql("SELECT gini_of(rga_of(2.0D, 4.0D)), mid_rank(3, 2)").first()[:] == (0.5, 3.5)


def test_labels_that_come_late(spark, tmp_path):
    """Labels come a window later, in other files than their scores; closed windows are measured as a batch would."""
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    scores = [(f"{d}-{i}", day(d, i % 20), float(rng.randrange(8))) for d in range(1, 5) for i in range(40)]
    labels = [(k, day(int(k.split("-")[0]) + 1, 21), float(rng.random() < z / 8)) for k, _, z in scores if not k.endswith("7")] + [("1-0", day(20), 1.0), ("none", day(2), 1.0)]
    ends = [("end", day(25), 0.0), ("end2", day(28), 0.0)], [("end", day(25, 1), 0.0), ("end2", day(28, 1), 0.0)]
    s_schema, l_schema = "id string, at string, z double", "id string, seen string, y double"
    for rows, schema, name, end in ((scores, s_schema, "scores", ends[0]), (labels, l_schema, "labels", ends[1])):
        column = schema.split(", ")[1].split()[0]
        for k, part in enumerate([[r for r in rows if r[1] < day(3)], [r for r in rows if r[1] >= day(3)], end[:1], end[1:]]):
            spark.createDataFrame(part, schema).withColumn(column, F.to_timestamp(column)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{k}")
    read = lambda name, r: r.option("recursiveFileLookup", "true").schema(spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}").schema)
    batch = monitor.labelled(*(read(n, spark.read).parquet(f"{tmp_path}/{n}") for n in ("scores", "labels")), "id", "at", "seen", "2 days", "1 hour")
    want = {r["start"]: (r["n"], pytest.approx(r["rga"])) for r in monitor.measured(monitor.tie_counts(batch, "at", "y", "z", late=None)).collect() if r["start"].day < 10}
    streams = (read(n, spark.readStream.option("maxFilesPerTrigger", 1)).parquet(f"{tmp_path}/{n}") for n in ("scores", "labels"))
    q = monitor.monitor(monitor.labelled(*streams, "id", "at", "seen", "2 days", "1 hour"), "at", "y", "z", f"{tmp_path}/out", f"{tmp_path}/state", late=None)
    q.awaitTermination()
    got = {r["start"]: (r["n"], r["rga"]) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["start"].day < 10}
    assert len(want) == 4
    assert got == want


# --- generated code
def method_sizes(df):
    """Bytes of the largest method that Spark generates for each stage of the plan."""
    seq = df._jdf.queryExecution().debug().codegenToSeq()
    return [seq.apply(k)._3().maxMethodCodeSize() for k in range(seq.size())]


@pytest.mark.parametrize("method", ["jackknife", "influence"])
def test_paired_values_are_compiled(spark, method):
    """The JVM runs methods above 8,000 bytes by its interpreter."""
    d = spark.range(4000).select("id", F.col("id").alias("row_id"), (F.col("id") % 3).alias("s"), F.rand(1).alias("y"), F.rand(2).alias("z"), F.rand(3).alias("zb"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        sizes = method_sizes(inference.compare(d, ["s"], "y", "z", "zb", method=method))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    print("SIZES", sizes)
    assert sizes
    assert max(sizes) < 8000
