"""Short names for the usual calls, each giving a small table or a number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.errors import BadInput, UndefinedMeasure
from ranktide.operators import accuracy, explain, fairness, inference, robust
from ranktide.operators.measure import gini_value, rga_value
from ranktide.operators.scorer import Model, score

compute_rga = rga_value
compute_gini = gini_value


def compute_rga_ci(df: DataFrame, y: str = "y", z: str = "z", method: str = "jackknife", level: float = 0.95, **options) -> tuple[float, float, float]:
    r = inference.estimate(df, (), y, z, method, level, **options).first()
    return r["rga"], r["ci_low"], r["ci_high"]


def compare_rga(df: DataFrame, y: str, a: str, b: str, **options) -> DataFrame:
    return inference.compare(df, (), y, a, b, **options)


def accuracy_table(df: DataFrame, y: str = "y", z: str = "z", **options) -> DataFrame:
    return accuracy.report(df, (), y, z, **options)


def compute_rge_values(train: DataFrame, test: DataFrame, model: Model, variables: Sequence[str], group: bool = False, row_id: str = "row_id") -> DataFrame:
    return explain.rge(train, test, model, variables, group=group, row_id=row_id).select("variable", "rge").orderBy("rge", ascending=False)


def compute_rgr_values(test: DataFrame, model: Model, variables: Sequence[str], perturbation: float = 0.05, group: bool = False, row_id: str = "row_id") -> DataFrame:
    return robust.rgr(test, model, variables, perturbation, group=group, row_id=row_id).select("variable", "rgr").orderBy("rgr", ascending=False)


def compute_rga_parity(test: DataFrame, group: str, y: str = "y", z: str = "z", row_id: str = "row_id") -> float:
    """The gap between the best and the worst group, however small the groups; raises if there is none."""
    gap = fairness.parity(test, group, y, z, 0, row_id=row_id, n_resamples=200, gap_interval=False).first()["gap"]
    if gap is None:
        raise UndefinedMeasure("fewer than two groups have a defined measure")
    return gap


def manipulate_testdata(train: DataFrame, test: DataFrame, variable: str, method: str = "mean") -> DataFrame:
    return test.withColumn(variable, F.lit(explain.replacement(train, [variable], method)[variable]))


def check_nan(*frames: DataFrame) -> None:
    for df in frames:
        r = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
        if bad := [c for c in df.columns if r[c]]:
            raise BadInput(f"missing values in {bad}")


def validate_variables(variables: Sequence[str], train: DataFrame) -> None:
    from ranktide.sources.frames import columns

    columns(train, variables, "variables")


def find_yhat(model: Model, test: DataFrame, name: str = "yhat") -> DataFrame:
    return score(test, model, name)
