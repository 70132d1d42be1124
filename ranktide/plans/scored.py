"""Scored tables for the registered queries, as SQL that Spark and DuckDB both run.

The generated columns are independent of each other, so targets and scores are derived
from one column with known disturbances.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: A row for each order: two targets, two scores, three features, group and dummies.
ORDERS = """SELECT o_orderkey AS row_id, o_orderpriority AS g, o_orderstatus AS s, o_totalprice AS y,
  CASE WHEN o_totalprice + 1500.0E0 * (o_orderkey % 41) > 280000.0E0 THEN 1.0E0 ELSE 0.0E0 END AS yb,
  o_totalprice + 2000.0E0 * (o_custkey % 97) AS z, o_totalprice + 4000.0E0 * (o_orderkey % 53) AS zb,
  CAST(FLOOR(o_totalprice / 20000.0E0) AS DOUBLE) AS t, o_totalprice AS f1, CAST(o_custkey % 97 AS DOUBLE) AS f2, CAST(o_orderkey % 53 AS DOUBLE) AS f3,
  1.0E0 + (o_custkey % 3) AS w, CASE WHEN o_orderstatus = 'F' THEN 1.0E0 ELSE 0.0E0 END AS d1, CASE WHEN o_orderstatus = 'O' THEN 1.0E0 ELSE 0.0E0 END AS d2
  FROM orders"""
#: A small one, for replicates.
CUSTOMERS = """SELECT c_custkey AS row_id, c_mktsegment AS g, c_acctbal AS y, c_acctbal + 60.0E0 * (c_custkey % 37) AS z, c_acctbal + 90.0E0 * (c_custkey % 29) AS zb,
  CASE WHEN c_acctbal + 40.0E0 * (c_custkey % 23) > 4500.0E0 THEN 1.0E0 ELSE 0.0E0 END AS yb, c_acctbal AS f1, CAST(c_custkey % 37 AS DOUBLE) AS f2, CAST(c_nationkey AS DOUBLE) AS f3 FROM customer"""
LINES = "SELECT l_returnflag AS g, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS y, l_extendedprice AS z, 1.0E0 + l_linenumber AS w FROM lineitem"
MODEL = "f1 + 2000.0E0 * f2 + 500.0E0 * f3"


class Linear:
    """The same model as a fitted Python estimator."""

    classes_ = [0, 1]
    feature_names_in_ = ["f1", "f2", "f3"]

    def decision_function(self, x: pd.DataFrame) -> np.ndarray:
        return x["f1"].to_numpy() + 2000.0 * x["f2"].to_numpy() + 500.0 * x["f3"].to_numpy()


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    name = sql.rsplit("FROM ", 1)[1].split()[0]
    spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"ranktide_{name}")
    return spark.sql(sql.replace(f"FROM {name}", f"FROM ranktide_{name}"))
