"""Filter interaction audit by a trie of filter orders.

All orders of the filters form a trie.  It is walked depth first.  A node's state is the set of filters applied so far, whatever their
order, and its survivors are a persisted DataFrame, filtered from the survivors of the state before; the memo of visited states lets
every other prefix with the same set share it.  With n filters, 2^n - 1 states are counted instead of the nodes of n! orders.
At each state one pass over its survivors counts, by part, what is alive and what each filter not yet applied removes there: the edges.
They are appended to a table in the shared folder; the orders are read off that table at the end.

At most n states are persisted at a time: a state is let go when the walk leaves it.  Persisted blocks that are lost with an executor
are filtered again from the written flags.  Rows hold a part and flags only; texts are read once.

Nulls and edges: a null part is the empty string, together with parts that are empty; a null flag or mark is false; a part without survivors has
zeros; an empty table gives no rows.  Of the documents: a null text is empty, copies of an empty text are identical texts too; a null id is
neither smaller nor larger than another, so such a row never fails E; rows with one id and text are not copies of each other; an id counts as marked if any of its label rows
marks it.  Columns besides those named are ignored.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import WORD, documents, shared_dir, written

#: Fixed values of the contract.
FILTERS, SIGNS, CAPITALS = "ABCDE", "#$%&*|", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def walk(rows: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """(part, <filter> ..., <mark> ...) -> part, state, alive, edges: a row for each state and each part that has survivors there.

    A filter's column is true where a row fails it.  ``state`` has bit i set if filter i was applied; ``edges[i]`` counts what filter i removes from
    the survivors and how many of those have each mark, zeros if it was applied before.
    """
    table = f"{shared_dir(rows.sparkSession)}/interplay-{uuid.uuid4().hex}"
    seen = {2 ** len(filters) - 1}  # nothing follows the full set

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        fails = [F.lit(False) if state >> i & 1 else F.col(f) for i, f in enumerate(filters)]
        edges = [F.struct(F.count_if(f).alias("removed"), *[F.count_if(f & F.col(m)).alias(m) for m in marks]) for f in fails]
        survivors.groupBy("part").agg(F.count("*").alias("alive"), F.array(*edges).alias("edges")).select("part", F.lit(state).alias("state"), "alive", "edges").write.mode("append").parquet(table)
        for i, f in enumerate(filters):
            if state | 1 << i not in seen:
                visit(state | 1 << i, survivors.filter(~F.col(f)))
        survivors.unpersist()

    visit(0, rows)
    return rows.sparkSession.read.parquet(table)


def audit(rows: DataFrame, filters: Sequence[str], marks: Sequence[str] = (), part: str = "part") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost, shapley: a row for each part, order of the filters and step.

    ``filters`` name boolean columns, true where a row fails; an order is written as the filters' names in a row.
    """
    n = len(filters)
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*filters, *marks)]
    states = walk(rows.select(F.coalesce(part, F.lit("")).alias("part"), *flags), filters, marks)
    # at most 2^n - 1 entries a part
    p = states.groupBy("part").agg(F.collect_list(F.struct("state", "alive", "edges")).alias("states"))
    before = lambda s: bin(s).count("1")
    ways = [math.factorial(before(s)) * math.factorial(n - before(s) - 1) for s in range(2**n - 1)]  # orders that pass an edge from s
    p = p.withColumn("shapley", F.expr(f"transform(sequence(0, {n - 1}), i -> aggregate(states, 0L, (a, s) -> a + array({', '.join(map(str, ways))})[s.state] * s.edges[i].removed))"))
    p = p.withColumn("at", F.map_from_entries(F.transform("states", lambda s: F.struct(s["state"], F.struct(s["alive"], s["edges"])))))
    steps = [{"filter_order": "".join(filters[i] for i in o), "step": k + 1, "i": o[k], "state": sum(1 << i for i in o[:k])} for o in itertools.permutations(range(n)) for k in range(n)]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, i: int, state: int>>")
    p = p.select("part", "shapley", "at", F.inline(listed))
    edge = lambda state, field: F.coalesce(F.expr(f"try_element_at(at, {state}).edges[i].{field}"), F.lit(0).cast("bigint"))
    removed, alone = edge("state", "removed"), edge(f"{2**n - 1} - shiftleft(1, i)", "removed")
    alive = F.coalesce(F.expr("try_element_at(at, state).alive"), F.lit(0).cast("bigint"))
    return p.select("part", "filter_order", "step", (alive - removed).alias("kept"), removed.alias("removed"), (edge("0", "removed") - removed).alias("redundant"), alone.alias("unique_fails"), *[edge("state", f"`{m}`").alias(f"{m}_lost") for m in marks], F.expr("shapley[i]").alias("shapley"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, source), (doc_id, quality, toxic) -> doc_id, part, A to E, good, toxic: a row for each document, written."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    capitals = F.length("t") - F.length(F.translate("t", CAPITALS, ""))
    d = d.select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), (F.size("words") < 50).alias("A"), (100 * F.size(F.array_distinct("words")) < 65 * F.size("words")).alias("B"),
        (100 * capitals.cast("bigint") > 5 * F.length("t").cast("bigint")).alias("C"), F.col("t").rlike(f"[{SIGNS}]").alias("D"))
    d = written(d, "interplay-texts")
    # tables of their own, so that Spark can split a digest or an id that very many rows share
    copies = written(d.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("c_digest"), "least"), "interplay-copies")
    marks = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = written(marks.filter("l_id is not null and (good or toxic)"), "interplay-labels")
    d = d.join(copies, F.col("digest") == F.col("c_digest"), "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    d = d.join(marks, F.col("doc_id") == F.col("l_id"), "left")
    return written(d.select("doc_id", "part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]), "interplay-flags")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")), list(FILTERS), ["good", "toxic"])


SQL = rf"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (
  SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * (length(t) - length(translate(t, '{CAPITALS}', ''))) > 5 * length(t) AS c,
    regexp_matches(t, '[{SIGNS}]') AS d, coalesce(d.doc_id > least, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
x(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM x v, x w, x x, x y, x z
  WHERE w.f <> v.f AND x.f NOT IN (v.f, w.f) AND y.f NOT IN (v.f, w.f, x.f) AND z.f NOT IN (v.f, w.f, x.f, y.f)),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, i, 1) AS k, left(filter_order, i - 1) AS earlier FROM o, range(1, 6) t(i)),
m AS (SELECT g.*, filter_order, step, k, contains(fails, k) AS fail, fails <> translate(fails, earlier, '') AS gone FROM g, s),
r AS (
  SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = k), 0) AS unique_fails, coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0) AS toxic_lost
  FROM m GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM r
"""
