"""Weighted sums over aligned calls: per sample, score, window, slot, site and block."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import alleles


def effect_calls(ok: DataFrame, calls: DataFrame) -> DataFrame:
    """(sample_id, source_row, w_int, effect_dosage) of the aligned variants, by an equi-join on vrow."""
    picked = ok.select("source_row", "w_int", "side", F.col("vrow").alias("of"))
    rows = calls.join(picked, F.col("vrow") == F.col("of"))
    return rows.select("sample_id", "source_row", "w_int", alleles.effect_dosage(F.col("alt_dosage"), F.col("side")).alias("effect_dosage"))


def scores(rows: DataFrame, by: list[str], weight: str | Column = "w_int") -> DataFrame:
    """Number of calls and the exact sum of dosage times weight (a whole number) per group."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    return rows.groupBy(*by).agg(F.count("effect_dosage").alias("n"), F.sum(F.col("effect_dosage") * weight).alias("score_int"))


def fill_missing(rows: DataFrame, policy: str) -> DataFrame:
    """Missing dosages as 0 (``zero``), the variant's mean (``mean_dosage``), without the variant (``exclude_variant``) or an ``error``."""
    dosage = F.col("effect_dosage").cast("double")
    if policy == "zero":
        return rows.withColumn("effect_dosage", F.coalesce(dosage, F.lit(0.0)))
    if policy == "error":
        return rows.withColumn("effect_dosage", F.coalesce(dosage, F.raise_error(F.lit("missing genotype")).cast("double")))
    known = rows.groupBy("source_row").agg(F.avg(dosage).alias("mean"), F.count("effect_dosage").alias("n"), F.count(F.lit(1)).alias("all")).withColumnRenamed("source_row", "of")
    rows = rows.join(known, F.col("source_row") == F.col("of"))
    if policy == "exclude_variant":
        return rows.filter("n = all").drop("of", "mean", "n", "all")
    if policy == "mean_dosage":
        return rows.withColumn("effect_dosage", F.coalesce(dosage, "mean", F.lit(0.0))).drop("of", "mean", "n", "all")
    raise ValueError(f"no such policy: {policy}")


def numbered(ok: DataFrame) -> DataFrame:
    """Adds ``variant_ord``, the place among the aligned variants by source row from 0.

    A range-partitioned sort and the counts of its partitions give the places, so no task sees all variants.
    """
    chunk = F.floor(F.col("source_row") / 4096).alias("chunk")
    counts = ok.groupBy(chunk).agg(F.count(F.lit(1)).alias("m"))
    before = counts.withColumn("start", F.coalesce(F.sum("m").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("source_row")) - 1
    return ok.withColumn("chunk", F.floor(F.col("source_row") / 4096)).withColumn("place", place).join(before, "chunk").withColumn("variant_ord", (F.col("start") + F.col("place")).cast("long")).drop("chunk", "place", "start")


def exact_sums(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, ``column``): the correctly rounded sum of each group's finite doubles, whatever their order; nulls count nothing.

    A double is a whole number of 62 bits times two to a multiple of STEP. Such numbers are added up for each group and multiple, in pieces
    whose sums can't overflow, by one aggregation over all rows. The few sums of a group are then put together in a small list.
    """
    x = F.col(column)
    power = F.floor((F.floor(F.log2(F.abs(x))) - 53) / STEP) * STEP  # log2 may be off by one either way
    low = F.when(x != 0, F.greatest(power.cast("int"), F.lit(LEAST))).when(x == 0, 0)
    rows = rows.select(*by, low.alias("__at"), x.alias("__x")).select(*by, "__at", scaled_by(F.col("__x"), -F.col("__at")).cast("long").alias("__whole"))
    size, mask = F.abs("__whole"), (1 << PIECE) - 1
    pieces = [F.sum(F.signum("__whole").cast("long") * F.shiftright(size, PIECE * k).bitwiseAND(mask)).alias(f"p{k}") for k in range(3)]
    sums = rows.groupBy(*by, "__at").agg(*pieces)
    found = sums.groupBy(*by).agg(F.collect_list(F.when(F.col("__at").isNotNull(), F.struct(F.col("__at").alias("at"), "p0", "p1", "p2"))).alias("parts"))
    return found.select(*by, put_together("parts").alias(column))


#: Numbers are whole ones times two to a multiple of STEP, LEAST or more; they are summed in three pieces of PIECE bits, so that 2^42 rows can't overflow.
STEP, LEAST, PIECE = 8, -1080, 21


def scaled_by(x: Column, power: Column) -> Column:
    """x times two to the power, in two steps, so that neither overflows."""
    half = F.floor(power / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


@F.pandas_udf(T.DoubleType())
def put_together(parts: pd.Series) -> pd.Series:
    def one(found) -> float:
        if not len(found):
            return 0.0
        least = min(p["at"] for p in found)
        total = sum((p["p0"] + (p["p1"] << PIECE) + (p["p2"] << 2 * PIECE)) << (p["at"] - least) for p in found)
        return (total << least) / 1 if least >= 0 else total / (1 << -least)  # a quotient of whole numbers is correctly rounded

    return parts.map(one)


def weight_features(weights: DataFrame, most_dosage: float) -> DataFrame:
    """One row about weights: their number, mean, deviation, greatest and summed sizes, share of zeros, decimal places, and the bound of a score."""
    w, size = F.col("effect_weight"), F.abs("effect_weight")
    return weights.withColumn("places", decimal_places("effect_weight")).agg(
        F.count(w).alias("variants"), F.avg(w).alias("mean"), F.stddev_pop(w).alias("sd"), F.max(size).alias("max_abs"), F.sum(size).alias("sum_abs"),
        (F.count_if(w == 0) / F.count(w)).alias("sparsity"), F.max("places").alias("decimals"), (most_dosage * F.sum(size)).alias("bound"),
    )


@F.pandas_udf(T.IntegerType())
def decimal_places(x: pd.Series) -> pd.Series:
    """Decimal places of a number to fifteen digits, without zeros at the end: of the exact value, which Java's formats don't print."""
    return x.map(lambda v: len(f"{abs(v):.15f}".rstrip("0").partition(".")[2]), na_action="ignore").astype("Int32")


def dense_score(dosages: Column, weights: Column) -> Column:
    """The dot product of two arrays of one length."""
    return F.aggregate(F.zip_with(dosages, weights, lambda d, w: d * w), F.lit(0.0), lambda a, x: a + x)


def positional_scores(dosages: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, score) of rows (sample_id, variant_ord, effect_dosage) and weights (variant_ord, effect_weight): the column of a dosage is its weight's row."""
    w = weights.select(F.col("variant_ord").alias("of"), "effect_weight")
    rows = dosages.join(w, F.col("variant_ord") == F.col("of"))
    return rows.groupBy("sample_id").agg(F.sum(F.col("effect_dosage") * F.col("effect_weight")).alias("score"))
