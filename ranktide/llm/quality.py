"""Quality rules: cross-document line frequency.

Lines are normalised (lower case; digits and white space between words become one
space) and hashed.  For each host the operator counts in how many distinct texts a
line stands.  Lines in more than ``LIMIT`` of them are removed, however large the host is,
and a document that keeps less than ``LEAST_LEFT`` of its words is depleted and rejected.
Equal texts count once, so copies of a clean text don't deplete each other.

Base measures of a text: see ``measures``.

Nulls and edges: a null or empty text has no words and fails the base rule; null hosts
are one host; a blank line is never counted; repeated rows get equal rows; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import WORD, documents

LIMIT = 20
LEAST_LEFT = 0.4
#: Fixed values of the contract.
SYMBOLS, SPACES, WINDOW = "#*$%&|<>", " \t\n\v\f\r", 8


def measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for ``text``.

    Repeated windows are found inside the row: windows are hashed, and only a
    text whose hashes are not all distinct has them sorted with their places.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("_w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    d = d.withColumns({"_h": F.expr(f"if(size(_w) >= {WINDOW}, transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW}))), cast(array() as array<bigint>))"), "n_words": F.size("_w").cast("bigint")}).drop("_w")
    d = d.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), null, array_sort(transform(_h, (h, i) -> struct(h as h, i as i))))")).drop("_h")
    d = d.withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, k) -> (k > 0 and _s[greatest(k - 1, 0)].h = x.h) or (k < size(_s) - 1 and _s[least(k + 1, size(_s) - 1)].h = x.h)), x -> x.i))")).drop("_s")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = d.withColumns({
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_repeat_words": F.expr(f"if(_p is null, 0L, aggregate(sequence(1, size(_p) - 1), {WINDOW}L, (a, k) -> a + least({WINDOW}, _p[k] - _p[k - 1])))"),
        "_lines": lines,
    })
    return d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")).drop("_p", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[0-9\x20\x09-\x0D]+", " ")))


def frequent_lines(docs: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(source, text) -> lines of every distinct text, and the (source, line) in more than ``limit`` distinct texts of the host."""
    texts = docs.filter("text is not null").select("source", "text", F.xxhash64("text").alias("t"))
    lines = texts.select("source", "t", F.explode(F.split("text", "\n")).alias("line")).withColumn("norm", normal(F.col("line"))).filter("norm != ''")
    lines = lines.select("source", "t", F.xxhash64("norm").alias("line"), F.size(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("words"))
    # one row for each distinct text and line; copies of a text on a host fall together
    lines = lines.groupBy("source", "t", "line").agg(F.sum("words").alias("words"))
    often = lines.groupBy("source", "line").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return lines, often


def depleted(docs: DataFrame, least_left: float = LEAST_LEFT, **limits: int) -> DataFrame:
    """(source, text) -> source, t (hash of the text), for texts that lose too many words with the frequent lines."""
    lines, often = frequent_lines(docs, **limits)
    o = often.select(F.col("source").alias("o_source"), F.col("line").alias("o_line"))
    cut = lines.join(o, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("line") == F.col("o_line")), "left")
    sums = cut.groupBy("source", "t").agg(F.sum("words").alias("words"), F.sum(F.when(F.col("o_line").isNotNull(), F.col("words")).otherwise(0)).alias("gone"))
    # sums of copies are multiples of both figures, so the share is that of one copy
    return sums.filter(F.col("words") - F.col("gone") < least_left * F.col("words")).select("source", "t")


def clean_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, source, text, ...) -> the same with frequent lines taken out of the text, depleted documents left out.  Columns of any names pass through."""
    _, often = frequent_lines(docs, **limits)
    o = often.select(F.col("source").alias("o_source"), F.col("line").alias("o_line"))
    at = docs.filter("text is not null").select("source", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    at = at.join(o, F.col("source").eqNullSafe(F.col("o_source")) & (F.xxhash64(normal(F.col("line"))) == F.col("o_line")))
    cut = at.groupBy(F.col("source").alias("c_source"), F.col("t").alias("c_t")).agg(F.collect_set("place").alias("places"))
    gone = depleted(docs, **limits).withColumnsRenamed({"source": "d_source", "t": "d_t"})
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("r_source"), F.col("text").alias("r_text"), F.xxhash64("text").alias("r_t"))
    d = d.join(gone, F.col("r_source").eqNullSafe(F.col("d_source")) & (F.col("r_t") == F.col("d_t")), "left_anti")
    d = d.join(cut, F.col("r_source").eqNullSafe(F.col("c_source")) & (F.col("r_t") == F.col("c_t")), "left")
    kept = F.when(F.col("places").isNull(), F.col("r_text")).otherwise(F.array_join(F.expr("filter(split(r_text, '\\n'), (x, i) -> not array_contains(places, i))"), "\n"))
    return d.select(*[kept.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    gone = depleted(docs).select(F.col("source").alias("d_source"), F.col("t").alias("d_t"), F.lit(True).alias("gone"))
    d = measures(docs.withColumn("t", F.xxhash64("text"))).select("doc_id", "source", "t", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    d = d.join(gone, F.col("source").eqNullSafe(F.col("d_source")) & (F.col("t") == F.col("d_t")), "left")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & F.col("gone").isNull()).alias("kept"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source, text AS raw, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT row_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT row_id, CAST(sum(least(8, i - coalesce(before, -100))) AS BIGINT) AS n FROM (SELECT row_id, i, lag(i) OVER (PARTITION BY row_id ORDER BY i) AS before FROM twice) GROUP BY row_id),
texts AS (SELECT DISTINCT source, raw AS t FROM d WHERE raw IS NOT NULL),
ln AS (SELECT source, t, lower(trim(regexp_replace(line, '[0-9\x20\x09-\x0D]+', ' ', 'g'))) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT source, t, unnest(string_split(t, chr(10))) AS line FROM texts)),
ln2 AS (SELECT source, t, norm, sum(words) AS words FROM ln WHERE norm <> '' GROUP BY source, t, norm),
often AS (SELECT source, norm FROM ln2 GROUP BY source, norm HAVING count(*) > 20),
gone AS (
  SELECT l.source, l.t FROM ln2 l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm
  GROUP BY l.source, l.t HAVING sum(words) - sum(CASE WHEN o.norm IS NOT NULL THEN words ELSE 0 END) < 0.4E0 * sum(words)),
m AS (
  SELECT w.doc_id, w.source, w.raw, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(translate(w.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(w.text) - length(translate(w.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(w.lines) - len(list_distinct(w.lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (row_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND gone.t IS NULL) AS kept
FROM m LEFT JOIN gone ON m.source IS NOT DISTINCT FROM gone.source AND m.raw = gone.t
"""
