"""Cohort statistics: counts per variant, phenotypes, sites, score summaries and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allele_counts(calls: DataFrame) -> DataFrame:
    """Per variant: calls, ALT alleles, and the count of the rarer allele."""
    n, ac = F.count("alt_dosage"), F.coalesce(F.sum("alt_dosage"), F.lit(0))
    return calls.groupBy("vrow").agg(n.alias("n_calls"), ac.alias("alt_count"), F.least(ac, 2 * n - ac).alias("minor_count"))


def case_control_counts(calls: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """ALT alleles per variant among cases (phenotype 1) and controls."""
    rows = calls.join(phenotypes.withColumnRenamed("sample_id", "of"), F.col("sample_id") == F.col("of"))
    return rows.groupBy("vrow").agg(
        F.coalesce(F.sum(F.when(F.col("phenotype") == 1, F.col("alt_dosage"))), F.lit(0)).alias("case_count"),
        F.coalesce(F.sum(F.when(F.col("phenotype") == 0, F.col("alt_dosage"))), F.lit(0)).alias("control_count"),
    )


def upper_median_phenotypes(scores: DataFrame) -> DataFrame:
    """phenotype 1 for scores from the upper median on: the one with n div 2 scores before it. No scores, no rows."""
    threshold = upper_median(scores, "score_int").withColumnRenamed("value", "threshold")
    return scores.crossJoin(F.broadcast(threshold)).select("sample_id", "score_int", (F.col("score_int") >= F.col("threshold")).cast("int").alias("phenotype"))  # one row


#: Estimated quantiles are off by a share of 1 / ACCURACY at most, so the median lies between those ASIDE from a half.
ACCURACY, ASIDE = 10_000, 0.0005


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """One row with the ``value`` that n div 2 of the n values come before; none for no values.

    Two estimated quantiles enclose it. The values below the first are counted, and only the distinct ones between the
    two, of a thousandth of all rows, are put in order.
    """
    x = rows.select(F.col(column).alias("x")).filter("x is not null")
    bounds = x.agg(F.percentile_approx("x", [0.5 - ASIDE, 0.5 + ASIDE], ACCURACY).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    near = x.crossJoin(F.broadcast(bounds)).filter("x <= b[1]")  # one row
    near = near.groupBy("n", F.when(F.expr("x >= b[0]"), F.col("x")).alias("value")).agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.orderBy(F.col("value").asc_nulls_first()))
    found = near.withColumn("upto", upto).filter("value is not null and upto > n div 2")
    return found.agg(F.min("value").alias("value")).filter("value is not null")


def site_of(n_rows: int, sites: int):
    """Contiguous sites of ceil(rows / sites) rows; trailing ones may be smaller or empty."""
    size = max(1, -(-n_rows // sites))
    return lambda row: F.floor(row / size).cast("long")


def summary(scores: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, population deviation, least and greatest."""
    return scores.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.min(column).alias("lo"), F.max(column).alias("hi")
    )


def errors(pairs: DataFrame, expected: str, observed: str, floor: float = 1e-15) -> DataFrame:
    """One row: greatest and mean absolute and relative error."""
    off = F.abs(F.col(observed) - F.col(expected))
    relative = off / F.greatest(F.abs(F.col(expected)), F.lit(floor))
    return pairs.agg(
        F.max(off).alias("max_abs"), F.avg(off).alias("mean_abs"), F.max(relative).alias("max_rel"), F.avg(relative).alias("mean_rel"),
        F.bool_and(~F.isnan(off)).alias("all_finite"),
    )


def site_errors(sums: DataFrame, expected: str, observed: str, size: str, by: list[str]) -> DataFrame:
    """Per group the greatest absolute error of a sum, and the greatest of its mean, which is divided by the site's size."""
    off = F.abs(F.col(observed) - F.col(expected))
    return sums.groupBy(*by).agg(F.max(off).alias("max_abs"), F.max(off / F.col(size)).alias("max_mean_abs"))
