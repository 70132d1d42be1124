"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  A document of the source expects
``e = min(max_repeats, lam * w)`` copies, where ``w`` grows with the logarithm
of its length and ``lam`` is the one factor that makes the expected words of
the source equal to its target.  ``floor(e)`` copies are certain.  The rest
``p = e - floor(e)`` is an inclusion probability: documents are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a uniform hash of the document's id,
and the lowest ranks are taken until the source's remaining words are used up.
The last one is taken if that ends nearer to the target.

Everything per source is computed from sums by (source, length class): at most
some forty classes a source.  The rank order is found without sorting a source
in one task: ranks are summed into ``BINS`` bins, the bin in which the words
run out is found from those sums, and only documents of that bin are ordered.

Nulls and edges: a null text has size 0 and is taken 0 times; a null source is a
source of its own; a null id hashes like the empty text; repeated rows are
separate documents with equal rank; a source of size 0 has target 0; an empty
table gives no rows.  Columns with other names pass through ``mix`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranktide.llm.common import WORD, documents, written

BINS = 4096
#: Fixed values of the contract: weights by the source's place, and the share of all words to take.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: int) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code point order, null last, take the weights in turn.  A target
    stops at ``max_repeats`` times the source's size and what is above it is dealt
    again by weight: sources fill up in the order of capacity by weight, so the
    factor after j full ones is (all words - their capacities) / other weights.
    The windows run over one row a source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_repeats)).filter("source_size > 0")
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns({
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "all": F.sum("source_size").over(every) * float(share),
    })
    s = s.withColumn("lam", (F.col("all") - F.col("full")) / F.col("left"))
    # the first source that its share does not fill sets the factor for all from there on
    s = s.withColumn("open", F.min(F.when(F.col("lam") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("lam")))).over(every)["lam"])
    t = s.select("source", F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open") * F.col("w"))).alias("target"))
    return sizes.join(t.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")), "left").select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def copies_by_class(classes: DataFrame, goals: DataFrame, max_repeats: int) -> DataFrame:
    """(source, w, words) and targets -> copies expected in each class and the words to draw.

    Classes with the largest w reach ``max_repeats`` first; factors are found as in
    ``targets``, over the few classes of a source.
    """
    c = classes.join(goals.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    by = Window.partitionBy("source").orderBy(F.col("w").desc())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    c = c.withColumns({
        "full": F.coalesce(F.sum("words").over(before), F.lit(0)) * float(max_repeats),
        "left": F.sum(F.col("w") * F.col("words")).over(every) - F.coalesce(F.sum(F.col("w") * F.col("words")).over(before), F.lit(0)),
    })
    c = c.withColumn("lam", F.when(F.col("left") > 0, (F.col("target") - F.col("full")) / F.col("left")))
    c = c.withColumn("lam", F.max_by("lam", F.when(F.col("lam") * F.col("w") < max_repeats, F.col("w"))).over(every))
    # no open class: the source is taken whole, as often as may be
    e = F.when(F.col("lam").isNull(), F.lit(float(max_repeats))).otherwise(F.least(F.lit(float(max_repeats)), F.greatest(F.lit(0.0), F.col("lam") * F.col("w"))))
    e = F.when(F.col("target") > 0, e).otherwise(0.0)
    c = c.withColumn("e", e).withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.floor("e"))
    c = c.withColumn("quota", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every))
    return c.select("source", "w", "source_size", "target", "whole", "p", "quota")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, ...) -> the same with source_size, target and copies (0 to max_repeats); columns of those names are replaced."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint") + 0.5) / 4503599627370496.0
    d = docs.select("doc_id", "source", "size", F.struct(*docs.columns).alias("_row"), F.length(F.bin("size")).alias("w"), u.alias("u"))
    classes = d.groupBy("source", "w").agg(F.sum("size").alias("words"))
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = written(copies_by_class(classes, targets(sizes, weights, share, max_repeats), max_repeats), "mix-plan")
    p = plan.withColumnsRenamed({"source": "p_source", "w": "p_w"})
    d = d.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("w") == F.col("p_w"))).drop("p_source", "p_w")
    rank = F.when(F.col("p") > 0, (F.col("u") / (1.0 - F.col("u"))) / (F.col("p") / (1.0 - F.col("p"))))
    d = d.withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") / (1.0 + F.col("rank")) * BINS))
    ends = d.filter("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    ends = ends.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    cut = ends.filter("upto > quota").groupBy("source").agg(F.min(F.struct("bin", F.expr("upto - words").alias("start"))).alias("cut"))
    cut = cut.select(F.col("source").alias("c_source"), F.col("cut.bin").alias("cut_bin"), F.col("cut.start").alias("start"))
    d = d.join(F.broadcast(cut) if _small(plan) else cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    at = F.col("rank").isNotNull() & (F.col("bin") == F.col("cut_bin"))
    sure = d.filter(~F.coalesce(at, F.lit(False)))
    sure = sure.withColumn("more", F.when(F.col("rank").isNotNull() & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))), 1).otherwise(0))
    upto = F.col("start") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = d.filter(at).withColumn("upto", upto).withColumn("more", F.when(2.0 * F.col("upto") - F.col("size") <= 2.0 * F.col("quota"), 1).otherwise(0)).drop("upto")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("source_size", "target", "copies")]
    return sure.unionByName(edge).select(*kept, "source_size", "target", (F.col("whole") + F.col("more")).alias("copies"))


def _small(plan: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table of a row by source may be sent to every task: it is counted first."""
    return plan.count() <= rows


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = written(with_size(documents(spark, sf_dir)).select("doc_id", "source", "size"), "mix-sizes")
    return mix(d).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def draw(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a row for each copy that the mix takes, numbered by ``copy``."""
    mixed = mix(with_size(docs)).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns, "copy")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
k AS (
  SELECT *, length(bin(size)) AS w,
    (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5E0) / 4503599627370496.0E0 AS u FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0E0 WHEN 1 THEN 1.0E0 ELSE 2.0E0 END AS sw, source_size * 2.0E0 AS cap FROM s),
s2 AS (
  SELECT *, coalesce(sum(cap) OVER b, 0.0E0) AS fullw, sum(sw) OVER () - coalesce(sum(sw) OVER b, 0.0E0) AS leftw, sum(source_size) OVER () * 1.5E0 AS allw
  FROM s1 WHERE source_size > 0
  WINDOW b AS (ORDER BY cap / sw, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (allw - fullw) / leftw AS lam FROM s2),
s4 AS (SELECT *, first_value(CASE WHEN lam * sw < cap THEN lam END IGNORE NULLS) OVER (ORDER BY cap / sw, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS openlam FROM s3),
goal AS (
  SELECT s.source, s.source_size, coalesce(CASE WHEN s4.source_size IS NULL THEN 0.0E0 WHEN openlam IS NULL THEN cap ELSE least(cap, openlam * sw) END, 0.0E0) AS target
  FROM s LEFT JOIN s4 ON s.source IS NOT DISTINCT FROM s4.source),
c AS (SELECT k.source, k.w, CAST(sum(size) AS BIGINT) AS words FROM k GROUP BY k.source, k.w),
c1 AS (
  SELECT c.*, source_size, target,
    coalesce(sum(words) OVER b, 0) * 2.0E0 AS fullw,
    sum(w * words) OVER (PARTITION BY c.source) - coalesce(sum(w * words) OVER b, 0) AS leftw
  FROM c JOIN goal ON c.source IS NOT DISTINCT FROM goal.source
  WINDOW b AS (PARTITION BY c.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c2 AS (SELECT *, CASE WHEN leftw > 0 THEN (target - fullw) / leftw END AS lam0 FROM c1),
c3 AS (SELECT *, max_by(lam0, CASE WHEN lam0 * w < 2 THEN w END) OVER (PARTITION BY source) AS lam FROM c2),
c4 AS (SELECT *, CASE WHEN target > 0 THEN CASE WHEN lam IS NULL THEN 2.0E0 ELSE least(2.0E0, greatest(0.0E0, lam * w)) END ELSE 0.0E0 END AS e FROM c3),
c5 AS (SELECT *, floor(e) AS whole, e - floor(e) AS p, target - sum(floor(e) * words) OVER (PARTITION BY source) AS quota FROM c4),
r AS (
  SELECT k.*, source_size, target, whole, p, quota, CASE WHEN p > 0 THEN (u / (1.0E0 - u)) / (p / (1.0E0 - p)) END AS rk
  FROM k JOIN c5 ON k.source IS NOT DISTINCT FROM c5.source AND k.w = c5.w),
o AS (SELECT *, sum(CASE WHEN rk IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rk NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN rk IS NOT NULL AND 2.0E0 * upto - size <= 2.0E0 * quota THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""
