"""What gives a row its score: a column, SQL text, a function of the frame, a fitted ML transformer, or a fitted Python estimator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Transformer
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.errors import BadInput, BadScorer
from ranktide.operators import estimators
from ranktide.operators.measure import rga

Model = Column | str | Callable[[DataFrame], Column] | Transformer | object


def score(df: DataFrame, model: Model, name: str = "z", pos_label: object = None, greater_is_better: bool = True, features: Sequence[str] | None = None) -> DataFrame:
    """The rows with one more column, the model's score.

    A transformer's ``probability`` of the positive class is preferred, then its
    ``rawPrediction``, then its ``prediction``.  A model of more than two classes needs ``pos_label``.
    An object with predict_proba, decision_function or predict, in this order, scores Arrow batches of ``features``.
    """
    sign = 1.0 if greater_is_better else -1.0
    if isinstance(model, Transformer):
        out = model.transform(df)
        new = [c for c in out.columns if c not in df.columns]
        for c in ("probability", "rawPrediction"):
            if c in new:
                size = getattr(model, "numClasses", 2)
                if size > 2 and pos_label is None:
                    raise BadInput("a model of several classes needs pos_label")
                at = _class_index(model, pos_label, size)
                return out.withColumn(name, sign * vector_to_array(F.col(c))[at]).select(*df.columns, name)
        if "prediction" not in new:
            raise BadScorer("the transformer adds no probability, rawPrediction or prediction")
        return out.withColumn(name, sign * F.col("prediction")).select(*df.columns, name)
    if isinstance(model, str):
        column = F.expr(model)
    elif isinstance(model, Column):
        column = model
    elif estimators.is_estimator(model):
        column = estimators.score_column(df, model, features, pos_label)
    elif callable(model):
        column = model(df)
    else:
        raise BadScorer(f"{type(model).__name__} gives no score")
    if not isinstance(column, Column):
        raise BadScorer("the function must return a column")
    return df.withColumn(name, sign * column.cast("double"))


def _class_index(model: Transformer, pos_label: object, size: int) -> int:
    if pos_label is None:
        return size - 1
    labels = list(getattr(model, "labels", range(size)))
    for i, x in enumerate(labels):
        if str(x) == str(pos_label):
            return i
    raise BadInput(f"{pos_label!r} is no class of the model")


class RankEvaluator(Evaluator):
    """For ``CrossValidator`` and ``TrainValidationSplit``: the measure, or its Gini form, of a score column."""

    def __init__(self, label: str = "label", score: str = "probability", gini: bool = False, pos_label: object = None) -> None:
        super().__init__()
        self.label, self.score_column, self.gini, self.pos_label = label, score, gini, pos_label

    def _evaluate(self, dataset: DataFrame) -> float:
        z = F.col(self.score_column)
        if dataset.schema[self.score_column].dataType.typeName() == "vectorudt":
            z = vector_to_array(z)[1]
        y = F.col(self.label).cast("double") if self.pos_label is None else F.when(F.col(self.label) == F.lit(self.pos_label), 1.0).otherwise(0.0)
        r = rga(dataset.select(y.alias("y"), z.cast("double").alias("z"))).first()
        return float("nan") if r["rga"] is None else float(r["gini" if self.gini else "rga"])

    def isLargerBetter(self) -> bool:
        return True
