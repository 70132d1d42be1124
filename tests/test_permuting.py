"""Permutations inside strata, and row facts by offsets, against plain loops with small parts."""

import math
import random
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from ranktide.errors import BadInput
from ranktide.functions import ranks
from ranktide.operators import cohorts, inference, measure, permuting, resampling
from test_measure import mean_ranks, pair, plain_rga  # its folder is on the path

rng = random.Random(31)


def hashed(*parts):
    return int(md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def moved(ids, stratum, seed, stream, rep):
    """For each row the row that it takes from."""
    strata = {}
    for i in sorted(ids):
        strata.setdefault(int((hashed(seed, "stratum", i) + 0.5) / 2**52 * math.ceil(len(ids) / stratum)), []).append(i)
    return {a: b for mine in strata.values() for a, b in zip(mine, sorted(mine, key=lambda i: (hashed(seed, stream, rep, i), i)), strict=True)}


@pytest.mark.parametrize("stratum", [1, 7, 4096])
@pytest.mark.parametrize("alternative", ["greater", "less", "two-sided"])
def test_permutation_p_value_by_loops(spark, monkeypatch, stratum, alternative):
    monkeypatch.setattr(permuting, "STRATUM", stratum)
    n, reps = 40, 30
    y = [float(rng.randrange(6)) for _ in range(n)]
    z = [v + rng.gauss(0, 6) for v in y]
    rz, ry, mean = mean_ranks(z), mean_ranks(y), sum(y) / n
    den = 2 * sum((v - mean) * r for v, r in zip(y, ry, strict=True))
    seen = plain_rga(y, z)
    values = []
    for b in range(reps):
        take = moved(range(n), stratum, 5, "perm", b)
        values.append(0.5 + sum((y[i] - mean) * rz[take[i]] for i in range(n)) / den)
    hit = {"greater": lambda v: v >= seen - 1e-12, "less": lambda v: v <= seen + 1e-12, "two-sided": lambda v: abs(v - 0.5) >= abs(seen - 0.5) - 1e-12}[alternative]
    want = (1 + sum(map(hit, values))) / (reps + 1)
    got = inference.test(pair(spark, y, z), [], alternative=alternative, n_permutations=reps, seed=5).collect()
    assert [r["p_value"] for r in got] == pytest.approx([want])


def test_permutation_p_values_by_key(spark, monkeypatch):
    monkeypatch.setattr(permuting, "STRATUM", 16)
    rows = [(k, i, float(i % 9), float(i % 9) if k == "sure" else rng.random()) for k in ("sure", None) for i in range(60)] + [("flat", 1, 1.0, 2.0), ("flat", 2, 1.0, 3.0)]
    got = {r["k"]: r for r in inference.test(spark.createDataFrame(rows, "k string, row_id long, y double, z double"), ["k"], n_permutations=99, seed=1).collect()}
    assert got["sure"]["p_value"] == pytest.approx(0.01)
    assert got[None]["p_value"] > 0.01
    assert got["flat"]["rga"] is None


def cohort_rows(spark, n=240):
    rows = [(i, rng.choice("abc"), rng.gauss(0, 1), float(rng.random() < 0.5), float(rng.randrange(20)) if rng.random() < 0.95 else None) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, g string, x double, y double, z double")


@pytest.mark.parametrize(("stratum", "depth", "block"), [(50, 2, 256), (4096, 1, 256), (50, 2, 4)])
def test_cohort_p_value_by_vectors_and_by_rows(spark, monkeypatch, stratum, depth, block):
    monkeypatch.setattr(permuting, "STRATUM", stratum)
    monkeypatch.setattr(permuting, "BLOCK", block)
    monkeypatch.setattr(resampling, "UNPACKED", 500)
    d = cohort_rows(spark)
    ask = lambda: [tuple(r) for r in cohorts.search_p_value(d, ["g", "x"], max_depth=depth, min_size=15, n_permutations=10, seed=3).collect()]
    by_vectors = ask()
    monkeypatch.setattr(cohorts, "COHORTS", 0)
    by_rows = ask()
    assert len(by_vectors) == len(by_rows) == 1
    assert by_vectors[0] == pytest.approx(by_rows[0])
    assert 0 < by_vectors[0][1] <= 1


def test_cohort_permutations_are_counted(spark):
    with pytest.raises(BadInput):
        cohorts.search_p_value(cohort_rows(spark, 60), ["g"], n_permutations=0)


def test_permuted_rows_are_shuffled_once(spark):
    d = pair(spark, [1.0, 2.0, 4.0], [2.0, 1.0, 5.0])
    text = inference.test(d, [], n_permutations=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(0, 4" not in text
    assert text.count("FlatMapGroupsInArrow") == 1


# --- facts of rows and curves by offsets
@pytest.mark.parametrize("kind", ["ties", "spread", "one"])
@pytest.mark.parametrize("weight", [None, "w"])
def test_row_facts_by_loops(spark, monkeypatch, kind, weight):
    monkeypatch.setattr(ranks, "SAMPLED", 2.0)
    values = [{"ties": float(rng.randrange(5)), "spread": rng.random(), "one": 3.0 if rng.random() < 0.8 else rng.random()}[kind] for _ in range(150)] + [None, None, -0.0, 0.0]
    rows = [(rng.choice(["a", None]), i, v, float(rng.randrange(1, 5)), float(rng.randrange(9)), "own") for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, "k string, id long, x double, w double, p double, _n string")
    got = {r["id"]: r for r in ranks.row_facts(d, ["k"], "x", {"p": F.col("p")}, weight).collect()}
    assert len(got) == len(rows)
    low = lambda v: -math.inf if v is None else v
    for k, i, v, _, _, own in rows:
        mine = [r for r in rows if r[0] == k]
        weigh = lambda r: r[3] if weight else 1.0
        below = sum(weigh(r) for r in mine if low(r[2]) < low(v))
        ties = [r for r in mine if low(r[2]) == low(v)]
        r = got[i]
        assert r["rank"] == pytest.approx(below + (sum(map(weigh, ties)) + 1) / 2)
        assert r["tie"] == len({low(m[2]) for m in mine if low(m[2]) < low(v)})
        assert r["p_tie"] == pytest.approx(sum(m[4] for m in ties))
        assert r["p_above"] == pytest.approx(sum(m[4] for m in mine if low(m[2]) > low(v)))
        assert r["_n"] == own
    assert ranks.row_facts(d.limit(0), [], "x").count() == 0


@pytest.mark.parametrize("piece", [1, 7, 1 << 14])
def test_curves_by_loops(spark, monkeypatch, piece):
    monkeypatch.setattr(measure, "PIECE", piece)
    monkeypatch.setattr(ranks, "SAMPLED", 2.0)
    y = [float(rng.randrange(4)) for _ in range(60)]
    z = [float(rng.randrange(6)) for _ in y]
    got = measure.curves(pair(spark, [*y, None], [*z, 1.0])).orderBy("k").collect()
    mean = {v: sum(a for a, b in zip(y, z, strict=True) if b == v) / z.count(v) for v in z}
    for name, order in (("lorenz", sorted(y)), ("dual_lorenz", sorted(y, reverse=True)), ("concordance", [mean[v] for v in sorted(z)])):
        assert [r[name] for r in got] == pytest.approx([sum(order[:k]) / sum(y) for k in range(61)])
    assert [r["fraction"] for r in got] == pytest.approx([k / 60 for k in range(61)])
    flat = measure.curves(pair(spark, [0.0, 0.0], [1.0, 2.0])).orderBy("k").collect()
    assert [r["lorenz"] for r in flat] == [0.0, None, None]
    assert [r["k"] for r in measure.curves(pair(spark, [1.0], [1.0]).limit(0)).collect()] == [0]
