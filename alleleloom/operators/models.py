"""What cost models are made of: scaled features, Gram sums, logistic regression, predictions, and measures of fit."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_scaled(x: Column) -> Column:
    """Signed log1p; null and values that aren't finite count as 0."""
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(fine, F.signum(x) * F.log1p(F.abs(x))).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow at either end."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def one_hot(column: Column, names: list[str]) -> dict[str, Column]:
    return {n: F.coalesce((F.upper(column) == n).cast("double"), F.lit(0.0)) for n in names}


def gram(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """(i, j, value) of X'X with a leading 1, and of X'y at j = -1: one sum for each pair, in one aggregation."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    sums = {(i, j): a * x[j] for i, a in enumerate(x) for j in range(i, len(x))} | {(i, -1): a * F.col(target) for i, a in enumerate(x)}
    row = rows.agg(*[F.sum(v).alias(f"{i} {j}") for (i, j), v in sums.items()])
    cell = lambda i, j, k: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"`{k[0]} {k[1]}`").alias("value"))
    return row.select(F.inline(F.array(*[cell(i, j, (i, j)) for i, j in sums], *[cell(j, i, (i, j)) for i, j in sums if j > i])))


def predicted(features: list[str], coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for f, c in zip(features, coefficients[1:]):
        out = out + F.col(f).cast("double") * c
    return F.greatest(F.lit(0.0), F.expm1(out))


def logistic(rows: DataFrame, features: list[str], label: str, penalty: float = 0.0, steps: int = 100) -> list[float]:
    """Intercept and coefficients of a logistic regression of a 0 or 1 label, with a squared penalty on the coefficients; gradients are summed on all tasks."""
    x = VectorAssembler(inputCols=features, outputCol="__x").transform(rows.select(F.col(label).cast("double").alias("__y"), *features).dropna())
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=penalty, maxIter=steps, tol=1e-9).fit(x)
    return [float(model.intercept), *map(float, model.coefficients)]


def probability(features: list[str], coefficients: list[float]) -> Column:
    """The chance that a logistic regression gives, with its sum kept within 30 of 0."""
    out = F.lit(coefficients[0])
    for f, c in zip(features, coefficients[1:]):
        out = out + F.col(f).cast("double") * c
    return sigmoid(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), out)))


def regression_metrics(rows: DataFrame, actual: str, guess: str) -> DataFrame:
    """One row: count, mean absolute and squared error, mean share (without zeros), R squared (0 if nothing varies)."""
    a, g = F.col(actual), F.col(guess)
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(a - g)).alias("mae"), F.sqrt(F.avg((a - g) * (a - g))).alias("rmse"),
        F.avg(F.when(a != 0, F.abs((a - g) / a))).alias("mape"), F.sum((a - g) * (a - g)).alias("res"), (F.var_pop(a) * F.count(a)).alias("tot"),
    )
    return sums.select("n", "mae", "rmse", "mape", F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(0.0).alias("r2"))


def classification_metrics(rows: DataFrame, label: str, score: str) -> DataFrame:
    """One row: counts at a threshold of one half, balanced accuracy, Brier score and clipped log-loss."""
    y, p = F.col(label), F.col(score)
    yes = p >= 0.5
    clipped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    sums = rows.agg(
        F.count_if((y == 1) & yes).alias("tp"), F.count_if((y == 0) & ~yes).alias("tn"), F.count_if((y == 0) & yes).alias("fp"), F.count_if((y == 1) & ~yes).alias("fn"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(-F.when(y == 1, F.log(clipped)).otherwise(F.log(1 - clipped))).alias("log_loss"),
    )
    recall = lambda hit, miss: F.coalesce(F.try_divide(F.col(hit).cast("double"), F.col(hit) + F.col(miss)), F.lit(0.0))
    return sums.withColumn("balanced_accuracy", (recall("tp", "fn") + recall("tn", "fp")) / 2)
