import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from ranktide.errors import BadInput, TooFewRows, UndefinedMeasure
from ranktide.functions import gauss, ranks
from ranktide.operators import accuracy, cohorts, explain, fairness, inference, measure, outcomes, robust, scorer
from ranktide.operators.report import build
from ranktide.sources import frames
from ranktide.streaming import monitor


def pair(spark, y, z, **more):
    names = list(more)
    number = lambda v: None if v is None else float(v)
    fields = "".join(f", {k} {'string' if any(isinstance(x, str) for x in more[k]) else 'double'}" for k in names)
    return spark.createDataFrame([(i, number(a), number(b), *[more[k][i] for k in names]) for i, (a, b) in enumerate(zip(y, z, strict=True))], f"row_id bigint, y double, z double{fields}")


def mean_ranks(v):
    s = sorted(v)
    return [s.index(x) + (s.count(x) + 1) / 2 for x in v]


def plain_rga(y, z):
    m, rz, ry = sum(y) / len(y), mean_ranks(z), mean_ranks(y)
    return 0.5 + sum((a - m) * r for a, r in zip(y, rz, strict=True)) / (2 * sum((a - m) * r for a, r in zip(y, ry, strict=True)))


@pytest.mark.parametrize(("y", "z", "want"), [
    ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75),
    ([0, 0, 1, 1, 0, 1, 1, 0], [0.1, 0.3, 0.6, 0.9, 0.2, 0.8, 0.4, 0.5], 0.9375),
    ([0, 1], [0, 1], 1.0),
    ([0, 1], [1, 0], 0.0),
    ([1, 2, 3], [5, 5, 5], 0.5),
])
def test_literal_values(spark, y, z, want):
    assert measure.rga_value(pair(spark, y, z)) == pytest.approx(want, abs=1e-12)
    assert measure.gini_value(pair(spark, y, z)) == pytest.approx(2 * want - 1, abs=1e-12)


def test_properties(spark):
    rng = random.Random(1)
    y = [rng.randint(0, 3) for _ in range(60)]
    z = [round(a + rng.gauss(0, 1), 1) for a in y]
    base = measure.rga_value(pair(spark, y, z))
    assert base == pytest.approx(plain_rga(y, z), abs=1e-12)
    assert measure.rga_value(pair(spark, y, [math.exp(v) for v in z])) == pytest.approx(base, abs=1e-12)
    assert measure.rga_value(pair(spark, [3 * a + 7 for a in y], z)) == pytest.approx(base, abs=1e-12)
    assert measure.rga_value(pair(spark, y, [-v for v in z])) == pytest.approx(1 - base, abs=1e-12)


def test_bad_input(spark):
    with pytest.raises(UndefinedMeasure):
        measure.rga_value(pair(spark, [1, 1, 1], [1, 2, 3]))
    with pytest.raises(BadInput):
        measure.rga_value(pair(spark, [1, float("nan"), 2], [1, 2, 3]))
    with pytest.raises(BadInput):
        measure.rga_value(pair(spark, [1, 2, 3], [1, 2, float("inf")]))
    with pytest.raises(TooFewRows):
        measure.rga_value(pair(spark, [1], [1]))
    with pytest.raises(BadInput):
        measure.rga_value(pair(spark, [1, 2, 3], [1, 2, 3]), "y", "nothing")
    with pytest.raises(BadInput):
        frames.columns(pair(spark, [1, 2], [1, 2]), {"y", "z"})
    for bad in (0, 1, True, 2):
        with pytest.raises(BadInput):
            frames.level(bad)
    r = measure.rga(pair(spark, [1, 1, 1], [1, 2, 3])).first()
    assert r["rga"] is None
    assert r["note"] == measure.NOTE_CONSTANT


def test_jackknife_is_leaving_one_out(spark):
    rng = random.Random(2)
    y = [rng.randint(0, 4) for _ in range(25)]
    z = [rng.randint(0, 5) for _ in y]
    got = {r["row_id"]: r["value"] for r in inference.jackknife_values(pair(spark, y, z)).collect()}
    for i in range(len(y)):
        assert got[i] == pytest.approx(plain_rga(y[:i] + y[i + 1 :], z[:i] + z[i + 1 :]), abs=1e-10)


def test_estimates_agree(spark):
    rng = random.Random(3)
    y = [rng.gauss(0, 1) for _ in range(150)]
    z = [a + rng.gauss(0, 1) for a in y]
    d = pair(spark, y, z)
    se = {m: inference.estimate(d, method=m, n_resamples=100).first()["standard_error"] for m in ("jackknife", "influence", "bootstrap")}
    assert se["influence"] == pytest.approx(se["jackknife"], rel=0.1)
    assert se["bootstrap"] == pytest.approx(se["jackknife"], rel=0.3)
    t = inference.test(d).first()
    assert t["p_value"] < 1e-6
    c = inference.compare(d.withColumn("zb", d.z), (), "y", "z", "zb").first()
    assert (c["difference"], c["p_value"]) == (0.0, 1.0)


def test_auroc_equals_measure_for_two_values(spark):
    rng = random.Random(4)
    y = [rng.randint(0, 1) for _ in range(80)]
    z = [round(a + rng.gauss(0, 1), 1) for a in y]
    d = pair(spark, y, z)
    assert accuracy.auroc(d).first()["auroc"] == pytest.approx(measure.rga_value(d), abs=1e-12)


def test_tail_swap_of_all_reverses(spark):
    d = pair(spark, range(10), range(10))
    got = {r["row_id"]: r["y"] for r in robust.perturb(d, "y", 0.5).collect()}
    assert got == {i: 9.0 - i for i in range(10)}
    assert robust.rgr(d, "y", "y", 0.5).first()["rgr"] == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(BadInput):
        robust.rgr_curve(d, "y", "y", kind="shuffle")


def test_removing_everything_gives_half(spark):
    d = pair(spark, range(20), [i * 7 % 20 for i in range(20)])
    assert explain.rge_group(d, d, "y + z", ["y", "z"]).first()["rge"] == pytest.approx(0.5)
    s = {r["variable"]: r["value"] for r in explain.shapley(d, d, "y + z", ["y", "z"]).collect()}
    assert sum(s.values()) == pytest.approx(0.5)


def test_fairness_tables(spark):
    rng = random.Random(5)
    n = 240
    y = [rng.randint(0, 1) for _ in range(n)]
    g = ["ab"[i % 2] if i < n - 2 else "sliver" for i in range(n)]
    z = [a + rng.gauss(0, 0.5 if k == "a" else 3) for a, k in zip(y, g, strict=True)]
    d = pair(spark, y, z, g=g)
    rows = {r["group"]: r for r in fairness.parity_groups(d, "g").collect()}
    assert rows["a"]["included"] and rows["b"]["included"] and not rows["sliver"]["included"]
    assert rows["sliver"]["rga"] is None
    p = fairness.parity(d, "g", n_resamples=100, gap_interval=False).first()
    assert (p["best"], p["worst"]) == ("a", "b")
    assert p["p_value"] < 0.01


def test_outcomes_with_extreme_rates(spark):
    y = [i % 2 for i in range(200)]
    z = [1.0 if i < 100 else 0.0 for i in range(200)]
    d = pair(spark, y, z, g=["a" if i < 100 else "b" for i in range(200)])
    g = outcomes.gaps(outcomes.rates(d, "g", "y", "z", 0.5))
    r = {x["criterion"]: x for x in g.collect()}["demographic_parity"]
    assert (r["gap"], r["ratio"], r["four_fifths"]) == (1.0, 0.0, False)
    assert 0 < r["gap_low"] < r["gap_high"] <= 1
    q = outcomes.pairs(outcomes.rates(d, "g", "y", "z", 0.5), "demographic_parity", n_resamples=50).first()
    assert q["p_value"] < 1e-9
    with pytest.raises(BadInput):
        outcomes.decided(d.withColumn("z", d.z + 0.5), "z")


def test_planted_cohort_is_worst(spark):
    rng = random.Random(6)
    n = 1200
    region = [rng.choice(["north", "south"]) for _ in range(n)]
    channel = [rng.choice(["online", "branch"]) for _ in range(n)]
    y = [rng.gauss(0, 1) for _ in range(n)]
    z = [rng.gauss(0, 1) if (a, b) == ("south", "online") else v for a, b, v in zip(region, channel, y, strict=True)]
    d = pair(spark, y, z, region=region, channel=channel)
    assert cohorts.worst(d, ["region", "channel"], min_size=50, top=3).first()["label"] == "region == 'south' and channel == 'online'"


def test_report_is_the_same_twice(spark):
    d = pair(spark, [i % 5 for i in range(60)], [i % 7 for i in range(60)], g=["x|y" if i % 2 else "<b>" for i in range(60)])
    d = d.withColumnRenamed("z", "f")
    a, b = (build(d, "y", "f", train=d, variables=["f"], group="g", name="m|1", generated_at="now", min_group_size=5, n_resamples=20) for _ in range(2))
    assert a.to_json() == b.to_json()
    assert "m\\|1" in a.to_markdown()
    assert "&lt;b&gt;" in a.to_html()
    assert any("threshold" in w for w in a.warnings)


def test_stream_gives_the_same_windows(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 4, (i * 5) % 7) for i in range(90)] + [("2024-02-01 00:00:00", 1, 1)]
    d = spark.createDataFrame(rows, ["ts", "y", "z"]).selectExpr("to_timestamp(ts) AS ts", "y", "z")
    d.repartition(2).write.parquet(str(tmp_path / "in"))
    want = {r["start"]: r["rga"] for r in monitor.measured(monitor.tie_counts(d, "ts", "y", "z")).collect()}
    q = monitor.monitor(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "ts", "y", "z", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r["start"]: r["rga"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 3
    for k, v in got.items():
        assert v == pytest.approx(want[k])


def test_normal_tail(spark):
    r = spark.range(1).select(gauss.two_sided(pytest.importorskip("pyspark.sql.functions").lit(1.96)).alias("p")).first()
    assert r["p"] == pytest.approx(2 * (1 - gauss.cdf(1.96)), abs=1e-6)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_formats(spark, tmp_path, fmt):
    frames.write(pair(spark, [1, 2], [3, 4]), str(tmp_path / fmt), fmt)
    assert frames.read(spark, str(tmp_path / fmt), fmt).count() == 2
    with pytest.raises(BadInput):
        frames.read(spark, "x", "xls")


def test_incomplete_rows_are_left_out_and_counted(spark):
    y, z = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0], [2.0, 7.0, 1.0, 8.0, 2.0, 8.0, 1.0, 8.0]
    odd = pair(spark, [*y, float("nan"), 1.0, float("inf")], [*z, 1.0, None, 2.0])
    r, clean = measure.rga(odd).first(), measure.rga(pair(spark, y, z)).first()
    assert (r["n"], r["rga"]) == (8, pytest.approx(clean["rga"], abs=1e-12))
    assert r["note"].startswith("3 rows left out")
    assert clean["note"] == ""
    e = inference.estimate(odd).first()
    assert e["standard_error"] == pytest.approx(inference.estimate(pair(spark, y, z)).first()["standard_error"], abs=1e-12)
    assert e["note"].startswith("3 rows left out")
    none = measure.rga(pair(spark, [None, None], [1.0, 2.0])).first()
    assert (none["n"], none["rga"]) == (0, None)


def test_large_offsets_keep_digits(spark):
    r = random.Random(4)
    base = [round(r.gauss(100, 15), 2) for _ in range(300)]
    z = [v + r.gauss(0, 8) for v in base]
    plain = measure.rga(pair(spark, base, z)).first()["rga"]
    assert measure.rga(pair(spark, [v + 1e9 for v in base], z)).first()["rga"] == pytest.approx(plain, abs=1e-6)


@pytest.mark.parametrize("values", ["spread", "few", "one"])
def test_parts_change_no_result(spark, monkeypatch, values):
    """Cuts from all rows, of values that are distinct, few, or mostly one: ranks and row values stay those of a plain loop."""
    monkeypatch.setattr(ranks, "SAMPLED", 2.0)
    r = random.Random(7)
    z = [{"spread": r.random(), "few": float(r.randrange(5)), "one": 1.0 if r.random() < 0.9 else r.random()}[values] for _ in range(200)]
    y = [float(r.randrange(2)) for _ in z]
    d = pair(spark, y, z)
    assert measure.rga(d).first()["rga"] == pytest.approx(plain_rga(y, z), abs=1e-12)
    out = {x["row_id"]: x["value"] for x in inference.jackknife_values(d).collect()}
    for i in (0, 57, 199):
        assert out[i] == pytest.approx(plain_rga(y[:i] + y[i + 1 :], z[:i] + z[i + 1 :]), abs=1e-10)


def test_numbers_by_value(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SAMPLED", 2.0)
    r = random.Random(3)
    z = [float(r.randrange(6)) for _ in range(150)]
    got = {x["row_id"]: x["_k"] for x in ranks.by_number(pair(spark, z, z), "z", "row_id").collect()}
    order = sorted(range(150), key=lambda i: (z[i], i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_missing_labels_and_unknown_baselines_are_refused(spark):
    y, z = [float(i % 2) for i in range(20)], [float(i) for i in range(20)]
    d = pair(spark, y, z, g=[None if i < 4 else "a" for i in range(20)])
    for f in (lambda: fairness.parity_groups(d, "g"), lambda: accuracy.by_segment(d, "g")):
        with pytest.raises(BadInput, match="4 missing labels"):
            f()
    nan = pair(spark, y, z, g=[float("nan") if i < 3 else 1.0 for i in range(20)])
    with pytest.raises(BadInput, match="3 missing labels"):
        fairness.parity_groups(nan, "g")
    with pytest.raises(BadInput, match="baseline"):
        accuracy.compare_models(d, "y", ["z"], baseline="other")
    with pytest.raises(BadInput, match="method"):
        accuracy.compare_models(d, "y", ["z"], method="other")


def test_compare_models_by_every_method(spark):
    r = random.Random(8)
    y = [r.gauss(0, 1) for _ in range(120)]
    d = pair(spark, y, [v + r.gauss(0, 1) for v in y], b=[v + r.gauss(0, 2) for v in y])
    p = {}
    for method in ("jackknife", "influence", "bootstrap"):
        rows = {x["model"]: x for x in accuracy.compare_models(d, "y", ["z", "b"], method=method, n_resamples=100).collect()}
        assert rows["z"]["place"] == 1
        assert rows["b"]["difference"] is None
        p[method] = rows["z"]["p_value"]
        paired = inference.compare(d, (), "y", "z", "b", method=method, n_resamples=100).first()
        assert rows["z"]["difference"] == pytest.approx(paired["difference"], abs=1e-9)
        assert p[method] == pytest.approx(paired["p_value"], abs=1e-6)
    assert p["influence"] == pytest.approx(p["jackknife"], abs=0.05)


def test_leakage_of_text_and_of_the_score(spark):
    d = pair(spark, [0.0] * 60, [float(i % 3) for i in range(60)], g=["abc"[i % 3] for i in range(60)], u=[float(i * 7 % 11) for i in range(60)])
    r = {x["variable"]: x for x in fairness.proxy_leakage(d.drop("y"), "g", ["u"], yhat="z").collect()}
    assert r["model"]["leakage"] == pytest.approx(1.0)
    assert r["model"]["level"] in ("g == a", "g == c")
    assert r["u"]["leakage"] < 0.6
    with pytest.raises(BadInput, match="not numeric"):
        fairness.proxy_leakage(d, ["g", "u"])


def test_scores_of_models_and_retraining(spark):
    rows = [(i, float(i % 7), float(i * 5 % 11), float((i % 7) > 3)) for i in range(80)]
    d = spark.createDataFrame(rows, "row_id bigint, a double, b double, label double")
    made = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    model = Pipeline(stages=[made, LogisticRegression(labelCol="label")]).fit(d)
    full = scorer.score(d, model, "z")
    assert measure.rga(full, (), "label", "z").first()["rga"] > 0.95

    def refit(kept):
        kept = [c for c in kept if c in ("a", "b")]
        return Pipeline(stages=[VectorAssembler(inputCols=kept, outputCol="features"), LogisticRegression(labelCol="label")]).fit(d)

    r = {x["variable"]: x["rge"] for x in explain.rge(d, d, model, ["a", "b"], method="retrain", refit=refit).collect()}
    assert r["a"] > r["b"]
    mean = {x["variable"]: x["rge"] for x in explain.rge(d, d, model, ["a", "b"]).collect()}
    assert mean["a"] > mean["b"]
    ev = scorer.RankEvaluator(label="label", score="probability")
    assert ev.evaluate(model.transform(d)) == pytest.approx(measure.rga(full, (), "label", "z").first()["rga"])
    assert ev.isLargerBetter()


def test_sampled_shapley_adds_up(spark):
    r = random.Random(5)
    d = spark.createDataFrame([(i, r.random(), r.random(), r.random()) for i in range(60)], "row_id bigint, a double, b double, c double")
    exact = {x["variable"]: x["value"] for x in explain.shapley(d, d, "3 * a + 2 * b + c", ["a", "b", "c"]).collect()}
    some = {x["variable"]: x["value"] for x in explain.shapley(d, d, "3 * a + 2 * b + c", ["a", "b", "c"], max_exact=1, n_permutations=300).collect()}
    assert sum(some.values()) == pytest.approx(sum(exact.values()), abs=1e-9)
    assert all(some[k] == pytest.approx(exact[k], abs=0.05) for k in exact)


def test_gaussian_draws_have_an_interval(spark):
    r = random.Random(6)
    d = spark.createDataFrame([(i, r.random(), r.random()) for i in range(100)], "row_id bigint, a double, b double")
    x = robust.rgr(d, "2 * a + b", "a", magnitude=0.3, kind="gaussian", n_repeats=4, ci=True).first()
    assert x["spread"] > 0
    assert x["ci_low"] < x["rgr"] < x["ci_high"]
