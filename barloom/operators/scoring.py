"""User-supplied scorers and models applied in Arrow batches, and a return model from Spark's own library."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.news import parse_reply


def score_texts(df: DataFrame, make_scorer: Callable[[], Callable[[list[str]], list[str]]], text: str = "text",
                max_concurrent: int | None = None) -> DataFrame:
    """Add sentiment, confidence and reasoning from a text scorer's replies.

    ``make_scorer`` is called once per task and returns a function from texts to replies (free-form, the
    first {...} block is read as JSON). ``max_concurrent`` bounds the number of tasks that call it.
    """

    @F.pandas_udf(T.StringType())
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for texts in batches:
            yield pd.Series(scorer(texts.tolist()), index=texts.index)

    if max_concurrent is not None:
        df = df.repartition(max_concurrent)
    out = df.withColumn("_reply", reply(F.col(text)))
    return out.withColumns(parse_reply(F.col("_reply"))).drop("_reply")


def score_vectors(
    df: DataFrame, make_predictor: Callable, features: Sequence[str], out: str = "predicted_return", batch_size: int = 1024
) -> DataFrame:
    """Add a model's output for a vector of feature columns; the model is loaded once per task."""
    predict = predict_batch_udf(
        make_predictor, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[len(features)]]
    )
    vector = F.array(*(F.col(f).cast("double") for f in features))
    return df.withColumn(out, predict(vector))


def score_sequences(
    df: DataFrame, make_predictor: Callable, shape: tuple[int, int], x: str = "x", out: str = "predicted_return",
    batch_size: int = 32,
) -> DataFrame:
    """Add a model's output for a sequence column (array of feature arrays)."""
    predict = predict_batch_udf(
        make_predictor, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[list(shape)]
    )
    return df.withColumn(out, predict(F.flatten(x)))


def prediction_signal(r: Column, threshold: float = 0.01) -> dict[str, Column]:
    """Direction, signal and confidence of a predicted return."""
    return {
        "direction": F.when(r > threshold, 1).when(r < -threshold, -1).otherwise(0),
        "signal": F.when(r > threshold, "BUY").when(r < -threshold, "SELL").otherwise("HOLD"),
        "confidence": F.least(F.lit(1.0), F.abs(r) / 0.05),
    }


def fit_return_model(
    df: DataFrame, features: Sequence[str], target: str, *, validation: str | None = None, kind: str = "linear"
):
    """Fit a return model on feature columns.

    ``kind`` 'linear' or 'trees'; with ``validation`` (a boolean column) boosting stops early when the
    error on the marked rows no longer falls.
    """
    data = df.na.drop(subset=[*features, target])
    data = data.withColumn("features", array_to_vector(F.array(*(F.col(f).cast("double") for f in features))))
    if kind == "linear":
        return LinearRegression(featuresCol="features", labelCol=target, solver="normal").fit(data)
    trees = GBTRegressor(featuresCol="features", labelCol=target, maxIter=100, stepSize=0.1, seed=42)
    if validation is not None:
        trees = trees.setValidationIndicatorCol(validation)
    return trees.fit(data)


def predict_return(model, df: DataFrame, features: Sequence[str], out: str = "predicted_return") -> DataFrame:
    """Add the model's prediction; rows with a missing feature are left out."""
    data = df.na.drop(subset=list(features))
    data = data.withColumn("features", array_to_vector(F.array(*(F.col(f).cast("double") for f in features))))
    return model.transform(data).withColumnRenamed("prediction", out).drop("features")
