"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\v\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary
    folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="ranktide-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then costs only the tasks it ran, and what several later
    steps read is computed once.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tokenizer_dir() -> str:
    """Default folder of the public vocabulary files; operators take it as a parameter."""
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
