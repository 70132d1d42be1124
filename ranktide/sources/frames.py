"""Reading scored rows and checking them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktide.errors import BadInput, TooFewRows, UndefinedMeasure

FORMATS = ("parquet", "csv", "json", "orc")


def read(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    if fmt not in FORMATS:
        raise BadInput(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    return spark.read.options(**({"header": "true", "inferSchema": "true"} if fmt == "csv" else {}) | options).format(fmt).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    if fmt not in FORMATS:
        raise BadInput(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    df.write.options(**({"header": "true"} if fmt == "csv" else {}) | options).format(fmt).mode(mode).save(path)


def columns(df: DataFrame, wanted: str | Sequence[str], argument: str = "columns") -> list[str]:
    """The named columns, checked against the schema; a set has no order and is refused."""
    if isinstance(wanted, (set, frozenset)):
        raise BadInput(f"{argument}: a set has no order; give a list")
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    if not names:
        raise BadInput(f"{argument}: no column given")
    if len(set(names)) < len(names):
        raise BadInput(f"{argument}: a column is named twice")
    if unknown := [c for c in names if c not in df.columns]:
        raise BadInput(f"{argument}: unknown columns {unknown}")
    return names


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType))


def number(df: DataFrame, column: str) -> Column:
    """The column as double; text is converted where it can be, and is null where it can't."""
    return F.col(column).try_cast("double")


def missing(c: Column, dtype: T.DataType) -> Column:
    odd = c.isNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        odd = odd | F.isnan(c) | (F.abs(c) == math.inf)
    return odd


def check_pair(df: DataFrame, y: str, z: str, least: int = 2, weight: str | None = None, labels: Sequence[str] = ()) -> DataFrame:
    """One pass over the rows; raises on what no estimate can be made from."""
    used = [y, z, *([weight] if weight else [])]
    columns(df, list(dict.fromkeys([*used, *labels])))
    counts = {f"bad_{i}": F.count_if(missing(number(df, c), T.DoubleType())) for i, c in enumerate(used)}
    counts |= {f"label_{i}": F.count_if(missing(F.col(c), df.schema[c].dataType)) for i, c in enumerate(labels)}
    if weight:
        counts |= {"negative": F.count_if(F.col(weight) < 0), "positive": F.count_if(F.col(weight) > 0)}
    r = df.agg(F.count("*").alias("n"), F.min(number(df, y)).alias("lo"), F.max(number(df, y)).alias("hi"), *[c.alias(k) for k, c in counts.items()]).first()
    for i, c in enumerate(used):
        if r[f"bad_{i}"]:
            raise BadInput(f"{c}: {r[f'bad_{i}']} missing, infinite or non-numeric values")
    for i, c in enumerate(labels):
        if r[f"label_{i}"]:
            raise BadInput(f"{c}: {r[f'label_{i}']} missing labels")
    if r["n"] < least:
        raise TooFewRows(f"{r['n']} rows; at least {least} are needed")
    if weight and (r["negative"] or r["positive"] < 2):
        raise BadInput(f"{weight}: weights must not be negative, and two must be positive")
    if r["lo"] == r["hi"]:
        raise UndefinedMeasure(f"{y} is constant")
    return df


def no_missing_labels(df: DataFrame, labels: Sequence[str]) -> None:
    """Raises if a label is null or NaN."""
    columns(df, labels, "labels")
    bad = [missing(F.col(c), df.schema[c].dataType) for c in labels]
    r = df.agg(*[F.count_if(b).alias(f"bad_{i}") for i, b in enumerate(bad)]).first()
    for i, c in enumerate(labels):
        if r[f"bad_{i}"]:
            raise BadInput(f"{c}: {r[f'bad_{i}']} missing labels")


def level(x: float) -> float:
    if isinstance(x, bool) or not 0 < x < 1:
        raise BadInput(f"level must lie between 0 and 1, not {x!r}")
    return float(x)


def count(x: int, name: str, least: int = 1) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < least:
        raise BadInput(f"{name} must be a whole number of at least {least}, not {x!r}")
    return x


def finite(x: float, name: str) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise BadInput(f"{name} must be a finite number, not {x!r}")
    return float(x)
