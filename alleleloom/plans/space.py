"""The space of execution plans as DataFrames: candidates, their names, and the frontier of what was measured.

The axes are short lists of options; each workload of a table gets their whole product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import slots

#: The options of each axis.
SPACE = {
    "scheme": ["CKKS", "BFV", "BGV"],
    "ring": [8192, 16384, 32768],
    "width": [512, 1024, 2048, 4096],
    "strategy": ["reduce_then_add", "add_then_reduce"],
    "scale_bits": [40, 50],
    "first_bits": [60],
    "fixed_scale": [100_000, 1_000_000, 10_000_000],
    "modulus": [2_147_352_577],
}
#: The most modulus bits for each ring dimension at 128 bits of security.
MOST_BITS = {1024: 27, 2048: 54, 4096: 109, 8192: 218, 16384: 438, 32768: 881, 65536: 1761}


def candidates(workloads: DataFrame, space: dict[str, list] = SPACE) -> DataFrame:
    """One row per plan for each row of ``workloads``: approximate schemes vary the scale, whole-number schemes the fixed scale and modulus."""

    def axes(rows: DataFrame, names: list[str]) -> DataFrame:
        for n in names:
            values = F.array(*[F.lit(v) if isinstance(v, str) else F.lit(v).cast("long") for v in space[n]])
            rows = rows.select("*", F.explode(values).alias(n))
        return rows

    base = axes(workloads, ["scheme", "ring", "width", "strategy"]).withColumn("slots", slots.capacity(F.col("scheme"), F.col("ring")))
    base = base.filter("width <= slots")
    none = lambda n: F.lit(None).cast("long").alias(n)
    near = axes(base.filter("scheme = 'CKKS'"), ["scale_bits", "first_bits"]).select("*", none("fixed_scale"), none("modulus"))
    whole = base.filter("scheme <> 'CKKS'").select("*", none("scale_bits"), none("first_bits"))
    return near.unionByName(axes(whole, ["fixed_scale", "modulus"]))


#: Further axes of whole plans, with the options that are used if no others are given.
MORE = {"reduction": ["binary_tree"], "key_switching": ["HYBRID"], "scaling_technique": ["FLEXIBLEAUTO"]}


def whole_plans(workloads: DataFrame, space: dict[str, list] | None = None) -> DataFrame:
    """The candidates with every choice that a plan has, ready for the validator, for each workload (with ``variants``): those of ``candidates`` times the further axes.

    Scaling techniques concern approximate schemes alone. Windows are as wide as what one ciphertext holds, and the rotations are
    the powers of two that such a window, or all variants if they are fewer, needs.
    """
    space = SPACE | MORE | (space or {})
    rows, variants = candidates(workloads, space), F.col("variants")
    for n in ("reduction", "key_switching", "scaling_technique"):
        options = F.array(*map(F.lit, space[n]))
        rows = rows.select("*", F.explode(options if n != "scaling_technique" else F.when(F.col("scheme") == "CKKS", options).otherwise(F.array(F.lit(None).cast("string")))).alias(n))
    one = F.lit(1).cast("long")
    window = F.col("width")
    return rows.select(
        *workloads.columns, "scheme", "ring", F.lit(128).cast("long").alias("security_bits"), F.col("slots").alias("slot_count"), window.alias("window"), window.alias("batch_size"), window.alias("per_ciphertext"),
        F.greatest(one, slots.chunk_count(variants, window)).alias("chunk_count"), F.lit(True).alias("feature_packing"), F.lit(False).alias("sample_packing"), one.alias("samples_each"),
        F.lit(False).alias("score_packing"), one.alias("scores_each"), slots.rotations(F.least(variants, window)).alias("rotations"), one.alias("depth"),
        F.col("strategy").alias("aggregation"), "reduction", "key_switching", "scaling_technique", "scale_bits", F.col("scale_bits").alias("scaling_modulus_size"),
        F.col("first_bits").alias("first_modulus_size"), "fixed_scale", "modulus", F.bround(F.log10(F.col("fixed_scale").cast("double"))).cast("long").alias("encoding_precision"), F.lit(False).alias("imputed"),
    )


def plan_key() -> Column:
    """A text that names a plan, for joins and ties."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("scheme", "ring", "window", "aggregation", "scale_bits", "first_modulus_size", "fixed_scale", "modulus")])


def frontier(rows: DataFrame, objectives: list[str]) -> DataFrame:
    """Rows that no other is as good as in all objectives and better in one; rows with a null objective don't count.

    Distinct points are thinned out to each task's own frontier first, then to that of groups of tasks, each an eighth as many,
    and only what is left meets in one task: points of a frontier, which are few unless almost all rows belong to it.
    """
    rows = rows.dropna(subset=objectives)
    points = rows.select(*[F.col(c).alias(f"o_{c}") for c in objectives]).distinct()
    n = max(1, points.sparkSession.sparkContext.defaultParallelism)
    points = points.mapInPandas(undominated, points.schema)
    while n > 1:
        n = -(-n // 8)
        points = points.repartition(n).mapInPandas(undominated, points.schema)
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"o_{c}") for c in objectives])
    return rows.join(points, same, "left_semi")


def undominated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The points of all batches that no other one is as good as everywhere and better somewhere."""
    kept = None
    for batch in batches:
        both = (batch if kept is None else pd.concat([kept, batch])).drop_duplicates()
        both = both.sort_values(list(both.columns), ignore_index=True)  # what comes later can't dominate
        x = both.to_numpy(dtype=np.float64)
        left = np.zeros(len(x), dtype=bool)
        best = np.empty((0, x.shape[1]))
        for k, p in enumerate(x):
            if not (best <= p).all(axis=1).any():
                left[k], best = True, np.vstack([best, p])
        kept = both[left]
    if kept is not None:
        yield kept
