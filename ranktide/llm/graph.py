"""Connected components of an edge table: distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the least node of the component.

    Rounds of large-star and small-star: every node's larger neighbours, then its
    smaller ones, are tied to its least neighbour, until nothing changes.  A round
    never makes more edges than it gets, so a hub does not blow up; each is written
    to the shared folder.  Edges with a null end are left out, loops give single nodes, repeated
    edges count once, and no edges give no rows.
    """
    edges = edges.filter("a is not null and b is not null")
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        # large star: neighbours above a node go to the least of the node and its neighbours
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a or b = m").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a >= b").distinct()
        # small star: a node and its neighbours below go to the least of those
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a >= b").distinct()
        now = written(small, "edges")
        r = now.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38,0))"))).first()
        if (r[0], r[1]) == state:
            break
        state = (r[0], r[1])
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
