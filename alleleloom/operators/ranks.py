"""Places, ranks and medians of any number of values, in windows of bounded size.

Values are counted first. A double is then read as a 64-bit whole number of the same order, in three digits of 22, 21 and 21 bits. How many
values are smaller is summed up digit by digit: before the first digit, of which a group has at most 2^22, then before the second among
those with the same first one, then before the third. So no task orders more than the values of one digit, whatever their number and
however they are spread, and nothing about their distribution has to be estimated.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the second and third digit, and of both.
DIGIT, TWO = 21, 42
#: Rows that are compared with a group's bounds are dealt out so many ways, as one group may have most of them.
WAYS = 16


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """A whole number for each double, in the same order; both zeros have one, and NaN comes last."""
    v = x.to_numpy(dtype=np.float64) + 0.0
    v = np.where(np.isnan(v), np.nan, v)
    b = v.view(np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64((1 << 63) - 1), b))


def same(rows: DataFrame, others: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``others`` where ``keys`` agree, nulls too; the keys are those of ``rows``."""
    renamed = others.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], F.lit(True))
    return rows.join(renamed, on, how).drop(*[f"__of_{k}" for k in keys])


def with_before(counts: DataFrame, value: str, n: str, by: list[str] = ()) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over the group's smaller values. ``counts`` has one row for each ``value`` (a number that isn't null) of a group."""
    by = list(by)
    rows = counts.withColumn("__c", ordered_bits(F.col(value).cast("double"))).withColumn("__b", F.shiftright("__c", DIGIT))
    middle = rows.groupBy(*by, "__b").agg(F.sum(n).alias("__n")).withColumn("__a", F.shiftright("__b", TWO - DIGIT))
    top = middle.groupBy(*by, "__a").agg(F.sum("__n").alias("__n"))
    upto = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    top = top.select(*by, "__a", upto(Window.partitionBy(*by).orderBy("__a"), "__n").alias("__first"))
    middle = middle.withColumn("__in", upto(Window.partitionBy(*by, "__a").orderBy("__b"), "__n"))
    middle = same(middle, top, [*by, "__a"]).select(*by, "__b", (F.col("__first") + F.col("__in")).alias("__start"))
    rows = rows.withColumn("__in", upto(Window.partitionBy(*by, "__b").orderBy("__c"), n))
    rows = same(rows, middle, [*by, "__b"])
    return rows.withColumn("before", F.col("__start") + F.col("__in")).drop("__b", "__c", "__in", "__start")


def average_ranks(rows: DataFrame, column: str, rank: str, by: list[str] = (), n: Column | None = None) -> DataFrame:
    """One row for each distinct value of ``column`` in a group: (``by``, of_``column``, ``rank``), where ties share the mean of their places; nulls have none.

    ``n``: how many rows each stands for, if not one.
    """
    m = F.count(F.lit(1)) if n is None else F.sum(n)
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias(f"of_{column}")).agg(m.alias("__m"))
    counts = with_before(counts, f"of_{column}", "__m", by)
    return counts.select(*by, f"of_{column}", (F.col("before") + (F.col("__m") + 1) / 2.0).alias(rank))


def spearman(rows: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """(``by``, spearman): the correlation of average ranks, 0 where either doesn't vary. Rows with a null have no rank and don't count.

    Equal pairs are counted before their ranks are looked up, and both ranks come from these counts.
    """
    return spearman_of_pairs(pairs_of(rows, a, b, by), by)


def pairs_of(rows: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """(``by``, __a, __b, __n): how often each pair of values that aren't null occurs in a group."""
    rows = rows.select(*by, F.col(a).alias("__a"), F.col(b).alias("__b")).dropna(subset=["__a", "__b"])
    return rows.groupBy(*by, "__a", "__b").agg(F.count(F.lit(1)).alias("__n"))


def spearman_of_pairs(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """``spearman`` of what ``pairs_of`` gives."""
    by, rows = list(by), pairs
    for c, r in (("__a", "__ra"), ("__b", "__rb")):
        pairs = same(pairs, average_ranks(rows, c, r, by, F.col("__n")).withColumnRenamed(f"of_{c}", c), [*by, c])
    n, x, y = F.col("__n"), F.col("__ra"), F.col("__rb")
    total = lambda c: F.sum(n * c)
    sums = pairs.groupBy(*by).agg(F.sum(n).alias("n"), total(x).alias("x"), total(y).alias("y"))
    middle = same(pairs, sums.select(*by, (F.col("x") / F.col("n")).alias("__mx"), (F.col("y") / F.col("n")).alias("__my")), by) if by else pairs.crossJoin(F.broadcast(sums.select((F.col("x") / F.col("n")).alias("__mx"), (F.col("y") / F.col("n")).alias("__my"))))  # one row
    dx, dy = x - F.col("__mx"), y - F.col("__my")
    out = middle.groupBy(*by).agg(total(dx * dy).alias("c"), total(dx * dx).alias("sx"), total(dy * dy).alias("sy"))
    return out.select(*by, F.coalesce(F.try_divide(F.col("c"), F.sqrt(F.col("sx")) * F.sqrt(F.col("sy"))), F.lit(0.0)).alias("spearman"))


def exact_medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(``by``, median) of each group's values; nulls don't count, and groups without any other have no row.

    Estimated quantiles, far more exact than they are apart, enclose the middle. Values below are only counted, and only those enclosed, about
    2 in 100, are put in order.
    """
    by, v = list(by), F.col("__v")
    rows = rows.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    bounds = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"), F.percentile_approx("__v", [0.49, 0.51], 10_000).alias("__q"))
    dealt = bounds.withColumn("__way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    rows = same(rows.withColumn("__way", F.pmod(F.xxhash64("__v"), F.lit(WAYS)).cast("int")), dealt, [*by, "__way"])
    inside = (v >= F.col("__q")[0]) & (v <= F.col("__q")[1])
    counts = rows.filter(v <= F.col("__q")[1]).groupBy(*by, "__all", F.when(inside, v).alias("__v")).agg(F.count(F.lit(1)).alias("__m"))
    below = counts.filter("__v is null").select(*by, F.col("__m").alias("__below"))
    counts = same(with_before(counts.filter("__v is not null"), "__v", "__m", by), below, by, "left") if by else with_before(counts.filter("__v is not null"), "__v", "__m").join(below, how="left")
    start = F.col("before") + F.coalesce("__below", F.lit(0))
    holds = lambda k: (start <= k) & (k < start + F.col("__m"))
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    counts = counts.withColumns({"__low": F.when(holds(low), v), "__high": F.when(holds(high), v)})
    return counts.groupBy(*by).agg(((F.max("__low") + F.max("__high")) / 2).alias("median"))
