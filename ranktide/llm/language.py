"""Language identification by nearest clustered centroid.

A text becomes a vector of hashed character n-grams (one to three characters of
the lower-cased letters, words set off by a space), weighted by TF-IDF with
1 + log(tf) and scaled to length 1.  Each language has several centroids, found by
spherical k-means over a bounded sample of its labelled texts; a text takes the
language of the centroid with the highest cosine, and is rejected if that
cosine falls below ``SLACK`` of the centroid's limit: the lowest usual cosine of its own texts, or of the language's if that is lower.

Document frequencies are counted over every labelled training text.  Only the
k-means fit works on a sample, of at most ``per_language`` texts a language.

Nulls and edges: a null text and a text without letters is ``und`` with score 0
and rejected; rows without a label are never learned from; with no labelled row at all every text is
``und``; ties between centroids go to the first language by name; repeated rows
count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents, fold, written

#: Number of hashed features of each n-gram length.
WIDTHS = (1 << 12, 1 << 13, 1 << 14)
DIM = sum(WIDTHS)
PER_LANGUAGE = 1500
CENTROIDS = 4
#: Up to so many labels, their counts are sent to every task.
LANGUAGES = 10_000
#: A text is rejected below this share of its centroid's lowest usual cosine.
SLACK = 0.25
UND = "und"


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[: 0x323B0] = [chr(i).isalpha() for i in range(0x323B0)]
    return table


class Vectors:
    """Turns texts into hashed n-gram counts."""

    def __init__(self) -> None:
        self.letter = _letters()

    def ids(self, text: str | None) -> np.ndarray | None:
        """Feature of every n-gram of the text, or None without letters."""
        if not text:
            return None
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ok = self.letter[c]
        if not ok.any():
            return None
        c = np.where(ok, c, 32).astype(np.uint64)
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = ok[1:] | ok[:-1]  # one space for each run of other characters
        c = np.concatenate(([32], c[keep], [32])).astype(np.uint64)
        a, b = c[:-1] * np.uint64(0x9E3779B1) + c[1:], c[:-2]
        tri = (b * np.uint64(0x85EBCA77) + a[1:]) * np.uint64(0x9E3779B97F4A7C15)
        one = ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        two = ((a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64)
        three = (tri >> np.uint64(50)).astype(np.int64)
        return np.concatenate((one[c != 32], two + WIDTHS[0], three + (WIDTHS[0] + WIDTHS[1])))

    def counts(self, text: str | None) -> np.ndarray | None:
        ids = self.ids(text)
        return None if ids is None else np.bincount(ids, minlength=DIM)


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the features that are not 0: (1 + log(tf)) * idf, scaled to length 1."""
    at = np.flatnonzero(counts)
    v = (1.0 + np.log(counts[at], dtype=np.float32)) * idf[at]
    return at, v / max(float(np.sqrt(v @ v)), 1e-12)


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), DIM), dtype=np.float32)
    for k, (at, v) in enumerate(rows):
        out[k, at] = v
    return out


def portions(rows: list, n: int = 256) -> Iterator[tuple[slice, np.ndarray]]:
    """Dense vectors of so many rows at a time, so that a language's sample is never dense as a whole."""
    for a in range(0, len(rows), n):
        yield slice(a, a + n), dense(rows[a : a + n])


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Over every training text; the table has ``DIM`` rows at most, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, df, n = Vectors(), np.zeros(DIM + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                ids = vec.ids(text.as_py())
                if ids is not None:
                    df[np.unique(ids)] += 1
                    n += 1
        df[DIM] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["feature", "n"])

    rows = train.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, dtype=np.int64)
    for r in rows:
        df[r["feature"]] = r["n"]
    return df[:DIM], int(df[DIM])


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> dict:
    """A model from (doc_id, text, lang); rows with a null text or label are left out.

    The sample takes the texts whose hashed id lies below ``per_language`` / (texts
    of the language), and never more than twice ``per_language``.
    """
    train = train.filter("text is not null and lang is not null")
    per = written(train.groupBy("lang").count().withColumnRenamed("lang", "s_lang"), "lang-counts")
    if per.count() <= LANGUAGES:  # so many rows at most go to every task, and the texts stay where they are
        per = F.broadcast(per)
    df, n = document_frequencies(train)
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32)
    u = F.pmod(F.xxhash64(F.lit(7), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = train.join(per, F.col("lang") == F.col("s_lang")).filter(u < per_language / F.col("count")).select("lang", "text")
    spark = train.sparkSession
    held = spark.sparkContext.broadcast(idf)
    most = 2 * per_language

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec = Vectors()
        for batch in batches:
            langs, places, values = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = vec.counts(text.as_py())
                if c is not None:
                    at, v = weighted(c, held.value)
                    langs.append(lang), places.append(at.astype(np.uint16).tobytes()), values.append(v.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["lang", "places", "values"])

    def clusters(key: tuple, table: pa.Table) -> pa.Table:
        packed = sorted(zip(table.column("places").to_pylist(), table.column("values").to_pylist(), strict=True))[:most]
        rows = [(np.frombuffer(a, dtype=np.uint16).astype(np.int64), np.frombuffer(v, dtype=np.float16).astype(np.float32)) for a, v in packed]
        n, k = len(rows), min(centroids, len(rows))
        cosines = lambda c: np.concatenate([x @ c.T for _, x in portions(rows)])
        c = sum(x.sum(0) for _, x in portions(rows))[None] / n
        for _ in range(k - 1):  # the text farthest from all centres so far
            c = np.vstack([c, dense([rows[int(np.argmin(cosines(c).max(axis=1)))]])])
        for _ in range(8):
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            near = np.argmax(cosines(c), axis=1)
            sums = np.zeros_like(c)
            for part, x in portions(rows):
                for j in range(k):
                    sums[j] += x[near[part] == j].sum(0)
            c = np.where((np.bincount(near, minlength=k) > 0)[:, None], sums, c)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        all_ = cosines(c)
        near, best = np.argmax(all_, axis=1), all_.max(axis=1)
        usual = float(np.quantile(best, 0.001))  # a centroid of few texts has no lowest usual cosine of its own
        low = [min(usual, float(np.quantile(best[near == j], 0.001))) if (near == j).any() else usual for j in range(k)]
        return pa.table({"lang": pa.array([key[0].as_py()] * k, pa.string()), "v": pa.array([r.astype(np.float32).tobytes() for r in c], pa.binary()), "low": low})

    sample = picked.mapInArrow(vectors, "lang string, places binary, values binary")
    rows = sorted(sample.groupBy("lang").applyInArrow(clusters, "lang string, v binary, low double").collect(), key=lambda r: (r["lang"], r["v"]))
    return {"idf": idf, "langs": [r["lang"] for r in rows], "centres": np.stack([np.frombuffer(r["v"], dtype=np.float32) for r in rows]) if rows else np.zeros((0, DIM), np.float32), "low": np.array([r["low"] for r in rows]) * SLACK}


def predict(docs: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """``columns`` of docs, and lang_pred, score, rejected for their ``text``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(columns)], F.col("text").alias("text"))
    names = [f"k_{i}" for i in range(len(columns))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, vec = held.value, Vectors()
        centres, langs, low, idf = m["centres"], m["langs"], m["low"], m["idf"]
        for batch in batches:
            pred, best, out = [], [], []
            for text in batch.column(len(names)):
                c = vec.counts(text.as_py())
                if c is None or not langs:
                    pred.append(UND), best.append(0.0), out.append(True)
                    continue
                at, v = weighted(c, idf)
                s = centres[:, at] @ v
                k = int(np.argmax(s))
                pred.append(langs[k]), best.append(min(1.0, max(0.0, float(s[k])))), out.append(bool(s[k] < low[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(pred, pa.string()), pa.array(best, pa.float64()), pa.array(out, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"{n} {kept.schema[n].dataType.simpleString()}" for n in names)
    out = kept.mapInArrow(score, f"{schema}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)], "lang_pred", "score", "rejected")


def held_out() -> Column:
    return fold("doc_id", 5) == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in a language that the model knows stay."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model, docs.columns).filter(~F.col("rejected")).select(*docs.columns)
