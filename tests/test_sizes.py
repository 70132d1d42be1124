"""What must not grow with the largest key, value or task: one test for each."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ranktide.functions import ranks
from ranktide.operators import explain, measure, resampling
from ranktide.plans import queries
from test_measure import plain_rga  # its folder is on the path


def test_sql_functions_order_no_whole_key(spark):
    d = spark.createDataFrame([(k % 3, None if k % 19 == 5 else float(k * 7 % 40), None if k % 23 == 2 else float(k * 11 % 9)) for k in range(300)], "s bigint, y double, z double")
    runs = "RANK() OVER (PARTITION BY s ORDER BY {0}) AS first_{0}, COUNT(*) OVER (PARTITION BY s, {0}) AS ties_{0}"
    want = queries.in_sql(d, f"SELECT s, rga_of(SUM(c * mid_rank(first_z, ties_z)), SUM(c * mid_rank(first_y, ties_y))) AS rga FROM (SELECT s, y - AVG(y) OVER (PARTITION BY s) AS c, {runs.format('z')}, {runs.format('y')} FROM ranktide_scored) GROUP BY s")
    got = queries.in_sql_by_value(d, "s", "SELECT s, rga_of(SUM(c * mid_rank(first, ties)) FILTER (WHERE side = 'z'), SUM(c * mid_rank(first, ties)) FILTER (WHERE side = 'y')) AS rga FROM ranktide_ties GROUP BY s")
    assert dict(got.collect()) == pytest.approx(dict(want.collect()))
    if os.path.isdir("/root/testdata/sf0.001"):
        plan = queries.QUERIES["sql_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"windowspecdefinition\(\w+#\d+, [yz]#", plan)


def test_coalitions_share_no_range_with_a_whole_key(spark, monkeypatch):
    seen, rga = [], explain.rga
    monkeypatch.setattr(explain, "rga", lambda *a, **k: seen.append((a, k)) or rga(*a, **k))
    d = spark.range(2000).selectExpr("id AS row_id", "cast(id * 37 % 1009 AS double) AS f1", "cast(id % 7 AS double) AS f2")
    explain.shapley(d, d, "f1 + 10 * f2", ["f1", "f2"]).collect()
    explain.rge(d, d, "f1 + 10 * f2", ["f1", "f2"], group=True).collect()
    for (long, keys), named in seen:
        cuts = named.get("cuts") or ranks.cut_points(long, ["y", "z", "y"])
        fullest = long.groupBy(*keys, ranks.part_of("z", cuts[1][0]).alias("p")).count().filter("p % 2 = 0").agg(F.max("count")).first()[0] or 0
        assert fullest < 1000  # of 2,000 rows with one score


def test_draws_are_hashed_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PART", 8)
    monkeypatch.setattr(resampling, "BLOCK", 10)
    d = spark.range(600).selectExpr("id AS row_id", "id % 2 AS g", "double(id % 17) AS y", "double(id % 5) AS z")
    values = lambda: {(r["g"], r["_rep"]): r["_value0"] for r in resampling.replicated(d, ["g"], "y", ["z"], "row_id", 20, 3).collect()}
    want = values()
    monkeypatch.setattr(resampling, "DEALT", 1000, raising=False)
    out, rows = resampling.with_draws(d, ["g"], ["y", "z"], "row_id", 20, 3)
    assert rows == 600 and out.rdd.getNumPartitions() == 12
    assert values() == pytest.approx(want)


def test_parts_of_many_cuts_make_small_methods(spark):
    cuts = [k / 4 - 30.0 for k in range(240)]
    rows = [(float(k % 17), k * 0.13 - 40.0) for k in range(600)] + [(1.0, c) for c in cuts[:40]] + [(1.0, -0.0), (1.0, None), (None, 1.0), (1.0, float("nan"))]
    d = spark.createDataFrame(rows, "y double, z double")
    u = ranks.side_rows(d, [], "y", ["z", "y"], [([], 0.0), (cuts, 0.0), (cuts, 0.0)])
    shown = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(u._jdf.queryExecution().executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000  # larger ones are not compiled
    got = {(r["v"], r["part"]) for r in u.filter("side = '0' and part is not null").collect()}
    assert got == {(v, 2 * sum(c < v for c in cuts) + (v in cuts)) for t, v in rows if t is not None and v is not None and v == v}
    assert u.filter("side = '0' and part is null").count() == 3


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_groups_are_whole_over_batches_and_where_they_share_a_hash(size):
    h, i = [1, 1, 1, 1, 2, 2, 3, 5, 5, 5], [7, 8, 7, 8, 0, 0, 0, 4, 4, 4]
    rows = pa.table({"_h": h, "_i": i, "x": list(range(10))})
    seen = {}
    for table, group in ranks._groups(iter(rows.to_batches(max_chunksize=size))):
        for r, n in zip(table.to_pylist(), group.tolist(), strict=True):
            seen.setdefault((r["_h"], r["_i"]), []).append((id(table), n))
        assert len(set(group.tolist())) == len({(r["_h"], r["_i"]) for r in table.to_pylist()})
    assert {k: (len(v), len(set(v))) for k, v in seen.items()} == {(1, 7): (2, 1), (1, 8): (2, 1), (2, 0): (2, 1), (3, 0): (1, 1), (5, 4): (3, 1)}


def test_rows_are_ranked_without_windows_over_them(spark):
    d = spark.range(400).selectExpr("id AS row_id", "if(id % 3 = 0, null, id % 3) AS k", "double(id * 7 % 31) AS y", "double(id * 11 % 53) AS z")
    plan = measure.rga(d, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" not in plan
    for r in measure.rga(d, ["k"]).collect():
        own = d.filter(F.col("k").eqNullSafe(F.lit(r["k"]))).collect()
        assert r["n"] == len(own) and r["rga"] == pytest.approx(plain_rga([x["y"] for x in own], [x["z"] for x in own]), abs=1e-12)
