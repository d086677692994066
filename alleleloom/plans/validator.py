"""Everything that can be wrong with an execution plan, and the ranking of plans by what is predicted for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import slots
from .space import MOST_BITS

#: The names that are known for each choice.
AGGREGATIONS = ["reduce_then_add", "add_then_reduce"]
REDUCTIONS = ["binary_tree", "eval_sum"]
KEY_SWITCHING = ["HYBRID", "BV"]
SCALING = ["FIXEDMANUAL", "FIXEDAUTO", "FLEXIBLEAUTO", "FLEXIBLEAUTOEXT"]
#: Objectives and what is predicted for each; the balanced one sums log1p of the last five.
OBJECTIVES = {
    "evaluation_latency": "evaluation_seconds",
    "total_latency": "total_seconds",
    "memory": "peak_memory_mb",
    "ciphertext_size": "ciphertext_bytes",
    "key_size": "key_bytes",
}
BALANCED = ["evaluation_seconds", "peak_memory_mb", "ciphertext_bytes", "key_bytes", "max_absolute_error"]


#: Bases by which strong pseudoprimes below 2 to the 64 are all found out.
BASES = [2, 325, 9375, 28178, 450775, 9780504, 1795265022]


def prime(n: Column) -> Column:
    """Whether a whole number of up to 63 bits is prime, by the strong test of Miller and Rabin for seven bases, in constant memory.

    Products of two such numbers have at most 38 digits, which decimals hold exactly.
    """
    wide = lambda x: x.cast("decimal(38,0)")
    m, less = wide(n), n - 1
    bits = F.sequence(F.lit(62), F.lit(1), F.lit(-1))

    def strong(base: int) -> Column:
        a = wide(F.lit(base)) % m

        def step(s: Column, k: Column) -> Column:
            """``y`` is the base to the power of n - 1 without its last k bits; ``passes``: for a power with no bit cut off but zeros it is n - 1, or 1 for the odd one."""
            high = F.call_function("shiftright", less, k)
            square = wide(s["y"] * s["y"] % m)
            y = F.when(high % 2 != 0, wide(square * a % m)).otherwise(square)
            whole = F.call_function("shiftleft", high, k) == less
            found = whole & ((y == m - 1) | ((high % 2 != 0) & (y == 1)))
            return F.struct(y.alias("y"), (s["passes"] | found).alias("passes"))

        start = F.struct(wide(F.lit(1)).alias("y"), (a == 0).alias("passes"))
        return F.aggregate(bits, start, step, lambda s: s["passes"])

    odd = reduce(lambda x, y: x & y, [strong(b) for b in BASES])
    return F.when(n < 2, F.lit(False)).when(n < 4, F.lit(True)).when(n % 2 == 0, F.lit(False)).otherwise(odd)


def with_primes(plans: DataFrame) -> DataFrame:
    """Adds ``modulus_is_prime``; each distinct modulus is tested once."""
    tested = plans.select(F.col("modulus").alias("of")).filter("of is not null").distinct().withColumn("modulus_is_prime", prime(F.col("of")))
    return plans.join(tested, F.col("modulus") == F.col("of"), "left").drop("of")


def modulus_bits() -> Column:
    """Bits of all ciphertext moduli of a plan together."""
    levels, given = F.greatest(F.lit(1), F.col("depth") + 1), lambda c: F.nullif(F.col(c), F.lit(0))
    near = F.coalesce(given("first_modulus_size"), F.lit(60)) + F.coalesce(given("scaling_modulus_size"), given("scale_bits"), F.lit(50)) * levels
    return F.when(F.col("scheme") == "CKKS", near).otherwise(60 * F.greatest(F.lit(2), F.col("depth") + 1))


def memory_mb(samples: int | Column) -> Column:
    component = F.col("ring") * modulus_bits() / 8
    return (samples * F.greatest(F.lit(1), F.col("chunk_count")) * 3 * component + component * (8 + 2 * F.size("rotations"))) / 2**20


def issues(samples: int | Column, variants: int | Column, low: float, high: float, sum_abs: float | Column, security: int = 128, most_mb: float | None = None) -> Column:
    """The types of all issues of a plan, in the order of the checks, as an array; a plan is valid if there are none.

    Of rows with scheme, ring, security_bits, slot_count, window, batch_size, per_ciphertext, chunk_count, feature_packing,
    sample_packing, samples_each, score_packing, scores_each, rotations, depth, aggregation, reduction, key_switching,
    scaling_technique, scale_bits, scaling_modulus_size, first_modulus_size, fixed_scale, modulus, modulus_is_prime, imputed.
    """
    col, ring = F.col, F.col("ring")
    near = col("scheme") == "CKKS"
    cap = slots.capacity(col("scheme"), ring)
    each = col("per_ciphertext")
    limit = reduce(lambda out, x: F.when(ring == x[0], F.lit(x[1])).otherwise(out), MOST_BITS.items(), F.lit(None).cast("int"))
    scale = F.coalesce(F.nullif(col("scale_bits"), F.lit(0)), col("scaling_modulus_size"))
    given = F.coalesce(col("modulus"), F.lit(0))
    fixed = F.coalesce(col("fixed_scale"), F.lit(0))
    whole = F.ceil(F.lit(max(abs(low), abs(high)) * sum_abs) * fixed + F.lit(variants) * 0.5)
    is_prime = F.coalesce("modulus_is_prime", F.lit(False))
    tests = [
        ("unsupported_security_profile", (col("security_bits") != security) | F.lit(security != 128)),
        ("invalid_ring_dimension", (F.bit_count(ring) != 1) | (ring < 1024)),
        ("slot_count_mismatch", (col("slot_count") != 0) & (col("slot_count") != cap)),
        ("window_exceeds_slots", (col("window") <= 0) | (col("window") > cap)),
        ("variants_per_ciphertext_invalid", (each <= 0) | (each > cap)),
        ("batch_window_mismatch", (col("batch_size") != 0) & (col("batch_size") != col("window"))),
        ("chunk_count_mismatch", col("chunk_count") != F.greatest(F.lit(1), F.ceil(F.lit(variants) / F.greatest(F.lit(1), each)))),
        ("unsupported_non_feature_packing", ~col("feature_packing")),
        ("unsupported_sample_packing", col("sample_packing") | (col("samples_each") != 1)),
        ("unsupported_score_packing", col("score_packing") | (col("scores_each") != 1)),
        ("missing_rotation_keys", F.size(F.array_except(slots.rotations(F.least(F.lit(variants).cast("long"), each)), col("rotations"))) > 0),
        ("invalid_rotation_index", F.exists("rotations", lambda i: (i <= 0) | (i >= cap) | (F.bit_count(i) != 1))),
        ("insufficient_multiplicative_depth", col("depth") < 1),
        ("unsupported_chunk_aggregation", ~col("aggregation").isin(AGGREGATIONS)),
        ("unsupported_reduction_strategy", ~col("reduction").isin(REDUCTIONS)),
        ("unsupported_key_switching_technique", ~F.upper("key_switching").isin(KEY_SWITCHING)),
        ("modulus_budget_exceeded", limit.isNull() | (modulus_bits() > limit)),
        ("unsupported_scaling_technique", near & ~F.upper(F.coalesce(F.nullif("scaling_technique", F.lit("")), F.lit("FLEXIBLEAUTO"))).isin(SCALING)),
        ("ckks_scale_too_small", near & (scale.isNull() | (scale < 20))),
        ("ckks_scale_mismatch", near & (scale > F.nullif(col("scaling_modulus_size"), F.lit(0)))),
        ("ckks_first_modulus_too_small", near & (col("first_modulus_size") < scale)),
        ("unsupported_imputed_fixed_point", ~near & col("imputed")),
        ("invalid_fixed_point_scale", ~near & (fixed <= 0)),
        ("invalid_plaintext_modulus", ~near & (given <= 2)),
        ("plaintext_modulus_not_prime", ~near & (given > 2) & ~is_prime),
        ("plaintext_modulus_not_batching_compatible", ~near & (given > 2) & is_prime & (given % (2 * ring) != 1)),
        ("bgv_ring_dimension_below_openfhe_minimum", (col("scheme") == "BGV") & (given >= 2**30) & (ring < 16384)),
        ("fixed_point_wraparound", ~near & (fixed != 0) & (given != 0) & (2 * whole >= given)),
        ("estimated_memory_exceeded", F.lit(False) if most_mb is None else memory_mb(samples) > most_mb),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def predicted_reasons(most: dict[str, float], least_probability: float = 0.5) -> Column:
    """Why what is predicted rules a plan out, as an array. A missing prediction rules nothing out."""
    names = {
        "peak_memory_mb": "predicted_memory_exceeded", "total_seconds": "predicted_latency_exceeded",
        "max_absolute_error": "predicted_absolute_error_exceeded", "max_relative_error": "predicted_relative_error_exceeded",
    }
    tests = [(name, F.col(c) > most[c]) for c, name in names.items() if c in most]
    tests += [("predicted_execution_failure", F.col("success_probability") < least_probability), ("predicted_error_constraint_failure", F.col("feasible_probability") < least_probability)]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def ranked_by_objectives(plans: DataFrame, most: dict[str, float], by: list[str], key: str) -> DataFrame:
    """For each objective the plans of a workload (``by``) with their reasons, score and rank; those without reasons come first, then lesser scores, then ``key``.

    Plans have ``issues`` and predictions. One with issues has no score and no other reasons; a missing prediction counts as
    nothing in the balanced score and as no score in the others, which comes last.
    """
    rows = by_objectives(plans, most, [*by, key])
    place = Window.partitionBy(*by, "objective").orderBy(F.size("reasons") > 0, F.col("score").asc_nulls_last(), key)
    return rows.withColumn("rank", F.row_number().over(place))


def best_by_objectives(plans: DataFrame, most: dict[str, float], by: list[str], key: str) -> DataFrame:
    """(``by``, objective, ``key``, score): the first of ``ranked_by_objectives`` where it has no reasons. A least value for each objective and workload, so nothing is put in order."""
    rows = by_objectives(plans, most, [*by, key]).filter(F.size("reasons") == 0)
    first = F.min(F.struct(F.col("score").isNull(), "score", key)).alias("first")
    return rows.groupBy(*by, "objective").agg(first).select(*by, "objective", f"first.{key}", "first.score")


def by_objectives(plans: DataFrame, most: dict[str, float], keep: list[str]) -> DataFrame:
    """(``keep``, reasons, objective, score) of each plan and objective."""
    sound = F.size("issues") == 0
    balanced = reduce(lambda a, b: a + b, [F.log1p(F.coalesce(F.col(c), F.lit(0.0))) for c in BALANCED])
    scores = [F.struct(F.lit(n).alias("objective"), F.col(c).cast("double").alias("score")) for n, c in OBJECTIVES.items()]
    scores.append(F.struct(F.lit("balanced_multi_objective").alias("objective"), F.round(balanced, 6).alias("score")))
    rows = plans.withColumn("reasons", F.when(sound, predicted_reasons(most)).otherwise(F.col("issues"))).withColumn("o", F.explode(F.array(*scores)))
    return rows.select(*keep, "reasons", "o.objective", F.when(sound, F.col("o.score")).alias("score"))


def without(name: str, plans: DataFrame, scheme: str = "CKKS", window: int = 4096) -> DataFrame:
    """The plans that are left if a choice is not made; names that concern no choice of the plan leave all."""
    keep = {
        "no_scheme_selection": F.upper("scheme") == scheme.upper(), "no_packing_optimization": F.col("window") == window,
        "no_chunk_strategy_optimization": F.col("aggregation") == AGGREGATIONS[0], "no_reduction_strategy_optimization": F.col("reduction") == REDUCTIONS[0],
    }
    if name not in ABLATIONS:
        raise ValueError(f"no such ablation: {name}")
    return plans.filter(keep.get(name, F.lit(True)))


def relaxed(name: str, most: dict[str, float]) -> dict[str, float]:
    """The constraints that are left: without the error constraint no errors are bounded."""
    return {c: v for c, v in most.items() if name != "no_error_constraint" or c not in ("max_absolute_error", "max_relative_error")}


#: What can be left out.
ABLATIONS = [
    "no_scheme_selection", "no_packing_optimization", "no_chunk_strategy_optimization", "no_reduction_strategy_optimization", "no_learned_cost_model",
    "no_bayesian_refinement", "no_genomic_workload_features", "no_top_k_actual_validation", "no_error_constraint", "no_fixed_point_range_validator",
]


def plan_vector() -> Column:
    """Scheme, ring, window, scale bits and fixed scale of a plan as comparable numbers."""
    scheme = F.when(F.col("scheme") == "CKKS", 0.0).when(F.col("scheme") == "BFV", 1.0).otherwise(2.0)
    log10 = F.when(F.col("fixed_scale") > 0, F.log10(F.col("fixed_scale").cast("double")))
    return F.array(
        scheme, F.log2(F.col("ring").cast("double")), F.coalesce(F.when(F.col("window") > 0, F.log2(F.col("window").cast("double"))), F.lit(0.0)),
        F.coalesce("scale_bits", F.lit(0)) / 60.0, F.coalesce(log10, F.lit(0.0)),
    )


def paired(predicted: DataFrame, measured: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each prediction with the measurement of the same plan: key, predicted, measured, residual and whether there is a pair.

    Of several measurements of a plan the mean of those that didn't fail counts.
    """
    means = measured.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.avg(value).alias("measured"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    rows = predicted.select(*key, F.col(value).alias("predicted")).join(means, same, "left")
    status = F.when(F.col("measured").isNotNull(), "paired").when(F.col(f"__{key[0]}").isNotNull(), "unavailable_failed_measurement").otherwise("not_measured")
    return rows.select(*key, "predicted", "measured", (F.col("measured") - F.col("predicted")).alias("residual"), status.alias("status"))
