"""What to measure next, and what to choose, from plans of which some have been measured.

A Gaussian process over the choices of a plan is fitted to each workload's measurements, and the plans without one are ranked by how
much better than the best they can be expected to be. Plans with equal choices have one vector: their measurements are
reduced to number, mean and least before they meet, which changes nothing of the regression, as so many equal rows with
the noise of one are one row with their mean and the noise divided by their number. So what a task holds is bounded by the options
of the choices, not by plans or measurements; workloads are dealt out.
"""

from __future__ import annotations

from functools import reduce
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import same
from .validator import BALANCED, OBJECTIVES

#: Noise of one measurement, and how far apart in the choices' vector two plans still tell of each other.
NOISE, LENGTH = 1e-6, 1.5
GUESS = "mean double, deviation double, improvement double"


def kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    return np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) / (2 * length * length))


def regressed(known: np.ndarray, n: np.ndarray, mean: np.ndarray, best: float, asked: np.ndarray, noise: float, length: float) -> np.ndarray:
    """Mean, standard deviation and expected improvement on ``best`` (less is better) at each vector ``asked``, a column each."""
    if not len(known):
        return np.tile([0.0, 1.0, 1.0], (len(asked), 1))
    gram = kernel(known, known, length) + np.diag(noise / n)
    across = kernel(asked, known, length)
    guess = across @ np.linalg.solve(gram, mean)
    deviation = np.sqrt(np.maximum(1e-12, 1.0 - (across * np.linalg.solve(gram, across.T).T).sum(axis=1)))
    gain = best - guess
    z = gain / deviation
    below = 0.5 * (1.0 + np.array([erf(x / np.sqrt(2.0)) for x in z.tolist()]))
    improvement = np.maximum(0.0, gain * below + deviation * np.exp(-0.5 * z * z) / np.sqrt(2.0 * np.pi))
    return np.stack([guess, deviation, improvement], axis=1)


def suggested(plans: DataFrame, measured: DataFrame, by: list[str], key: str, vector: Column, noise: float = NOISE, length: float = LENGTH) -> DataFrame:
    """(``by``, ``key``, GUESS, place) for the plans of each workload (``by``) that have no row in ``measured`` (``by``, ``key``, value).

    Those that promise the greatest improvement on the least value come first, of equal ones those with the lesser mean, then the lesser key; promises are
    compared to nine digits. A plan measured several times counts as often; one whose value is null or no finite number was
    tried, so it isn't suggested, but tells nothing. Where nothing was measured, mean is 0 and the others are 1.
    """
    rows = plans.select(*by, key, vector.alias("v"))
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    seen = same(measured.filter(fine).select(*by, key, F.col("value").cast("double").alias("value")), rows, [*by, key])
    known = seen.groupBy(*[F.col(c).alias(c) for c in (*by, "v")]).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"))
    left = same(rows, measured.select(*by, key).distinct(), [*by, key], "left_anti")
    asked = left.select(*by, "v").distinct()
    fields = ", ".join(f"`{c}` {t}" for c, t in asked.dtypes) + ", " + GUESS

    def guess(known_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        stack = lambda rows_: np.array(rows_["v"].tolist(), dtype=float)
        out = np.empty((0, 3))
        if len(asked_):
            out = regressed(stack(known_), known_["n"].to_numpy(), known_["mean"].to_numpy(), known_["least"].min() if len(known_) else 0.0, stack(asked_), noise, length)
        return asked_.assign(**{f.split()[0]: out[:, k] for k, f in enumerate(GUESS.split(", "))})

    guesses = known.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(guess, fields)
    rows = same(left, guesses, [*by, "v"])
    place = Window.partitionBy(*by).orderBy(F.desc(F.round("improvement", 9)), F.round("mean", 9), key)
    return rows.select(*by, key, "mean", "deviation", "improvement", F.row_number().over(place).alias("place"))


#: What may come of a selection.
MEASURED, PREDICTED, NONE = "measured_and_validated", "predicted_only_no_successful_actual_validation", "no_feasible_candidate"
FIRST, REFINED = "top_k_actual_validation", "bayesian_refinement"


def compared(ranked: DataFrame, measured: DataFrame, by: list[str], key: str, top_k: int) -> DataFrame:
    """The feasible plans of each workload and objective that are among the first ``top_k`` or were measured: ``ranked``'s columns, phase, status, pairing, residual and measured_score.

    ``ranked`` is what validator.ranked_by_objectives gives, ``measured`` has a row for each measured plan (``by``, ``key``) with status and metrics. A plan
    measured beyond the first ones is of the refinement. A failed measurement stays as a row; one that isn't there has a null status. ``residual`` is measured less predicted; the
    score is the objective's metric, or for the balanced one the sum of the logs of five, each scaled to 0 to 1 over the group's measured plans.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive")
    metrics = sorted({*OBJECTIVES.values(), *BALANCED})
    rows = same(ranked.filter(F.size("reasons") == 0), measured.select(*by, key, "status", *metrics), [*by, key], "left")
    rows = rows.filter((F.col("rank") <= top_k) | F.col("status").isNotNull()).withColumn("phase", F.when(F.col("rank") <= top_k, FIRST).otherwise(REFINED))
    group = Window.partitionBy(*by, "objective")
    whole = reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in BALANCED])
    shares = []
    for m in BALANCED:
        log = F.when(whole, F.log1p(F.greatest(F.lit(0.0), F.col(m).cast("double"))))
        low, high = F.min(log).over(group), F.max(log).over(group)
        shares.append(F.coalesce(F.try_divide(log - low, high - low), F.lit(0.0)))
    balanced = F.when(whole, reduce(lambda a, b: a + b, shares))
    single = reduce(lambda out, x: F.when(F.col("objective") == x[0], F.col(x[1]).cast("double")).otherwise(out), OBJECTIVES.items(), F.lit(None).cast("double"))
    score = F.when(F.col("objective") == "balanced_multi_objective", balanced).otherwise(single)
    ok = F.col("status") == "ok"
    pairing = F.when(F.col("status").isNull(), "not_measured").when(ok & single.isNotNull() | ok & whole, "paired").otherwise("unavailable_failed_measurement")
    residual = F.when(ok & (F.col("objective") != "balanced_multi_objective"), single - F.col("score"))
    return rows.withColumns({"measured_score": score, "pairing": pairing, "residual": residual}).select(*ranked.columns, "phase", "status", "pairing", "residual", "measured_score")


def selected(ranked: DataFrame, measured: DataFrame, by: list[str], key: str, top_k: int = 10) -> DataFrame:
    """(``by``, objective, status, selected, measured_score, top, failed, refined): the choice of each workload and objective, and how it came about.

    The plan that was measured best of those that didn't fail, of equal ones the first by rank; without any, the first feasible one by
    rank, which is predicted only; without that, none. ``top``, ``failed`` and ``refined`` count the first ones by rank, failures, and plans measured beyond.
    """
    rows = compared(ranked, measured, by, key, top_k)
    good = (F.col("status") == "ok") & F.col("measured_score").isNotNull()
    pick = rows.groupBy(*by, "objective").agg(
        F.min(F.when(good, F.struct(F.round("measured_score", 9).alias("s"), "rank", key, "measured_score"))).alias("m"), F.min(F.struct("rank", key)).alias("p"),
        F.count_if(F.col("phase") == FIRST).alias("top"), F.count_if(F.col("status").isNotNull() & (F.col("status") != "ok")).alias("failed"), F.count_if(F.col("phase") == REFINED).alias("refined"),
    )
    out = same(ranked.select(*by, "objective").distinct(), pick, [*by, "objective"], "left")
    status = F.when(F.col("m").isNotNull(), MEASURED).when(F.col("p").isNotNull(), PREDICTED).otherwise(NONE)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*by, "objective", status.alias("status"), F.coalesce(f"m.{key}", f"p.{key}").alias("selected"), F.col("m.measured_score").alias("measured_score"), zero("top"), zero("failed"), zero("refined"))
