"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ranktide.llm import decontam, language, lines, mixing, neardup
from ranktide.llm.common import written

STAGES = [
    ("language_id", language.keep_known),
    ("line_dedup", lines.keep_first_lines),
    ("near_duplicates", neardup.keep_one),
    ("decontamination", decontam.drop_leaks),
    ("mixing", mixing.draw),
]

#: Several stages cannot be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
