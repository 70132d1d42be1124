"""The measure in SQL text: temporary functions, and a table function for curves.

    register(spark)
    SELECT * FROM rga_curve(TABLE(SELECT g AS key, y, z FROM scored) PARTITION BY key ORDER BY z)
    SELECT g, gini_of(rga_of(sum(c * mid_rank(first, ties)), sum(c * mid_rank(first_y, ties_y)))) FROM ranked GROUP BY g
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

FUNCTIONS = (
    "mid_rank(first BIGINT, ties BIGINT) RETURNS DOUBLE COMMENT 'mean rank of ties, from the least of their ranks' RETURN first + (ties - 1) / 2.0D",
    "rga_of(score DOUBLE, target DOUBLE) RETURNS DOUBLE COMMENT 'from the sums of centred targets times their ranks by score and by target' RETURN 0.5D + try_divide(score, 2.0D * target)",
    "gini_of(rga DOUBLE) RETURNS DOUBLE COMMENT 'the measure from -1 to 1' RETURN 2.0D * rga - 1.0D",
)


@udtf(returnType="key string, k bigint, fraction double, concordance double")
class Curve:
    """Rows (key, y, z) of one key by rising z: the share of all targets in the first k rows, where rows of one score have their mean target.

    Numbers of one key are held by one task: keys are evaluation sets.  Curves of any size: ``operators.measure.curves``.
    """

    def __init__(self) -> None:
        self.key, self.y, self.z = None, array("d"), array("d")

    def eval(self, row: Row) -> None:
        self.key = row["key"]
        if row["y"] is not None and row["z"] is not None:
            self.y.append(row["y"])
            self.z.append(row["z"])

    def terminate(self) -> Iterator[tuple]:
        n, total, upto, k = len(self.y), sum(self.y), 0.0, 0
        if not n:
            return
        key = None if self.key is None else str(self.key)
        yield key, 0, 0.0, 0.0
        while k < n:
            end = k
            while end < n and self.z[end] == self.z[k]:
                end += 1
            mean = sum(self.y[k:end]) / (end - k)
            for at in range(k, end):
                upto += mean
                yield key, at + 1, (at + 1) / n, upto / total if total > 0 else None
            k = end


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, for its SQL."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
    spark.udtf.register("rga_curve", Curve)
