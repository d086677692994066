"""Benchmark records: canonical columns, grouped statistics, splits and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import slots
from . import ranks

METRICS = ["evaluation_seconds", "peak_memory_mb", "ciphertext_bytes"]


def summaries(records: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """Median, mean, sample deviation (0 for one), least, greatest and count per group and metric, over rows that are ok.

    Medians are exact, but no task holds, or orders, all values of a group.
    """
    long = records.filter(F.col("status") == "ok").select(*by, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = long.unpivot(by, metrics, "metric", "value").filter(F.col("value").isNotNull())
    by = [*by, "metric"]
    stats = long.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"),
    )
    return ranks.same(stats, ranks.exact_medians(long, by, "value"), by)


def group_statistics(records: DataFrame, by: list[str]) -> DataFrame:
    """Repeats, those ok, whether all are, the first row's bytes, and the mean evaluation."""
    ok = F.col("status") == "ok"
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("repeats"), F.count_if(ok).alias("ok_repeats"), F.when(F.bool_and(ok), "ok").otherwise("mixed").alias("status"),
        F.min_by("ciphertext_bytes", "rec_ord").alias("first_bytes"), F.avg("evaluation_seconds").alias("mean_seconds"),
    )


def with_held_out(rows: DataFrame, group: str, fraction: float = 0.2, seed: int = 20260728) -> DataFrame:
    """Adds ``held_out``: whether the row's group is among those with the least hashes of the seed and its name, a ``fraction`` of all groups and one at least.

    The last hash that is held out tells it of each row, so no list of groups is sent anywhere.
    """
    text = F.coalesce(F.col(group).cast("string"), F.lit(""))
    key = F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), text)).alias("h"), text.alias("g"))
    groups = rows.select(key.alias("k")).distinct()
    many = groups.count()
    edge = groups.orderBy("k").limit(max(1, round(many * fraction))).agg(F.max("k").alias("k")).first()["k"] if many else None
    held = key <= F.struct(F.lit(edge["h"]).alias("h"), F.lit(edge["g"]).alias("g")) if edge else F.lit(False)
    return rows.withColumn("held_out", held)


def source_domain(*texts: Column) -> Column:
    """synthetic, real or unspecified, by what the joined texts mention first in that order."""
    joined = F.lower(F.concat_ws(" ", *texts))
    real = reduce(lambda a, b: a | b, [joined.contains(t) for t in REAL])
    return F.when(joined.contains("synthetic"), "synthetic").when(real, "real").otherwise("unspecified")


def present(*columns: Column) -> Column:
    """The first that is neither null nor an empty text, as text."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def numeric(text: Column) -> Column:
    """A number from a text, a number or null; what isn't one is null."""
    return text.cast("string").try_cast("double")


def usable_numeric(column: Column) -> Column:
    """Whether a value is a finite number."""
    x = numeric(column)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def usable_label(column: Column) -> Column:
    """Whether a value can be a label: given, and finite if it is a number."""
    x = numeric(column)
    return F.coalesce(column.cast("string") != "", F.lit(False)) & F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(True))


def binary_label(column: Column, status: Column | None = None) -> Column:
    """1 for texts that say yes, else 0; where there is none, whether ``status`` is ok."""
    given = present(column)
    said = F.lower(F.trim(given)).isin(YES).cast("int")
    return F.when(given.isNotNull(), said).otherwise((status == "ok").cast("int") if status is not None else F.lit(None).cast("int"))


#: Texts that say yes, and that tell real data.
YES = ["1", "true", "yes", "ok"]
REAL = ["1000g", "1000 genomes", "real", "pgs"]
#: The fields of a record's plan that are read, and their defaults.
PLAN = {
    "scheme": "string", "ring_dimension": "long", "security_bits": "long", "multiplicative_depth": "long", "first_modulus_size": "long", "scaling_modulus_size": "long",
    "plaintext_modulus": "long", "fixed_point_scaling_factor": "long", "scale_bits": "long", "window_size": "long", "variants_per_ciphertext": "long", "chunk_count": "long",
    "samples_per_ciphertext": "long", "scores_per_ciphertext": "long", "rotation_indices": "array<long>", "feature_packing": "boolean", "reduction_tree_strategy": "string",
    "chunk_aggregation_strategy": "string",
}


def canonicalize(records: DataFrame) -> DataFrame:
    """All columns of ``records``, with the derived ones in place of those of the same name; whatever keys a record lacks count as null.

    ``plan`` may be a struct, JSON text or absent. Numbers may be given as texts. Where several keys say the same, the first
    that is given counts; for counts and sizes 0 is as good as not given.
    """
    have = {c: c for c in records.columns}
    raw = lambda n: F.col(f"`{n}`") if n in have else F.lit(None).cast("string")
    kinds = dict(records.dtypes)
    plan_text = kinds.get("plan", "string") == "string"
    plan = F.from_json(raw("plan"), ", ".join(f"{n} {t}" for n, t in PLAN.items())) if plan_text else F.col("plan")
    fields = set(PLAN) if plan_text else {f.name for f in records.schema["plan"].dataType.fields}
    rows = records.withColumn("__plan", plan)
    p = lambda n: F.col("__plan").getField(n).cast(PLAN[n]) if n in fields else F.lit(None).cast(PLAN[n])
    some = lambda *cs: F.coalesce(*[F.nullif(numeric(c), F.lit(0.0)) for c in cs])
    zero = F.lit(0.0)
    samples = F.coalesce(some(raw("samples"), raw("sample_count")), zero).cast("long")
    variants = F.coalesce(some(raw("variants"), raw("matched_snps"), raw("snps"), raw("matched_variant_count")), zero).cast("long")
    window = F.coalesce(some(p("window_size"), raw("window_size"), raw("window_snps")), F.greatest(F.lit(1.0), variants.cast("double"))).cast("long")
    each = F.coalesce(some(p("variants_per_ciphertext")), window.cast("double")).cast("long")
    status, backend = present(raw("status")), F.coalesce(raw("backend").cast("string"), F.lit(""))
    kind = F.coalesce(
        present(raw("measurement_kind")),
        F.when(F.lower(backend).contains("openfhe"), "measured_historical").when(raw("status").isNotNull(), "measured_unspecified").otherwise("unknown"),
    )
    given = lambda *ns: numeric(present(*[raw(n) for n in ns]))
    parts = [given("input_ciphertext_total_bytes", "input_ciphertext_bytes"), given("result_ciphertext_total_bytes", "result_ciphertext_bytes")]
    both = F.when(parts[0].isNotNull() | parts[1].isNotNull(), F.coalesce(parts[0], zero) + F.coalesce(parts[1], zero))
    ciphertext = F.coalesce(given("ciphertext_bytes"), both)
    scope = F.coalesce(
        present(raw("key_bytes_scope")),
        F.when(present(raw("total_key_material_bytes")).isNotNull(), "public+secret+multiplication+rotation").when(present(raw("key_bytes")).isNotNull(), "source_defined")
        .when(present(raw("public_context_bytes")).isNotNull(), "legacy_context+public_key_proxy").otherwise("unavailable"),
    )
    error = given("max_absolute_error", "max_abs_error")
    feasible = F.when(raw("failure_type").cast("string") == "error_constraint", 0).when((status == "ok") & error.isNotNull(), 1)
    group = F.coalesce(present(raw("workload_group")), present(raw("dataset_group")), present(raw("pgs_id")), F.lit("unspecified"))
    scheme = F.upper(F.coalesce(present(raw("scheme")), present(p("scheme")), F.lit("")))
    ring = F.coalesce(some(p("ring_dimension"), raw("ring_dimension"), raw("ring_dim"), raw("poly_modulus_degree")), zero).cast("long")
    scale, fixed = some(p("scale_bits"), raw("ckks_scaling_mod_size")), some(p("fixed_point_scaling_factor"), raw("fixed_point_scale"))
    text_of = lambda x: F.coalesce(x.cast("long").cast("string"), F.lit(""))
    default = lambda n, d: F.coalesce(some(p(n)), F.lit(float(d))).cast("long")
    derived = {
        "measurement_kind": kind,
        "workload_group": group,
        "group_variant_count": F.concat(F.lit("variants:"), variants.cast("string")),
        "group_sample_count": F.concat(F.lit("samples:"), samples.cast("string")),
        "group_window_size": F.concat(F.lit("window:"), window.cast("string")),
        "group_parameter_combination": F.concat_ws(":", scheme, ring.cast("string"), window.cast("string"), text_of(scale), text_of(fixed)),
        "group_scheme_configuration": F.concat_ws(":", scheme, ring.cast("string")),
        "group_pgs": F.coalesce(raw("pgs_id").cast("string"), F.lit("")),
        "group_source_domain": source_domain(*[F.coalesce(raw(n).cast("string"), F.lit("")) for n in ("workload_type", "source", "dataset_group", "workload_group")]),
        "sample_count": samples,
        "matched_variant_count": variants,
        "total_pgs_variants": F.coalesce(some(raw("total_pgs_variants"), raw("requested_weights_on_chrom")), variants.cast("double")).cast("long"),
        "score_count": default("scores_per_ciphertext", 1),
        "scheme": scheme,
        "ring_dimension": ring,
        "security_bits": default("security_bits", 128),
        "multiplicative_depth": default("multiplicative_depth", 1),
        "first_modulus_size": p("first_modulus_size"),
        "scaling_modulus_size": some(p("scaling_modulus_size"), raw("ckks_scaling_mod_size")).cast("long"),
        "plaintext_modulus": some(p("plaintext_modulus"), raw("plain_modulus")).cast("long"),
        "fixed_point_scale": fixed.cast("long"),
        "ckks_scale_bits": scale.cast("long"),
        "slots_used": window,
        "window_size": window,
        "chunk_count": default("chunk_count", 1),
        "samples_per_ciphertext": default("samples_per_ciphertext", 1),
        "scores_per_ciphertext": default("scores_per_ciphertext", 1),
        "key_count": F.coalesce(F.greatest(F.size(p("rotation_indices")), F.lit(0)), F.lit(0)) + present(raw("multiplication_key_bytes")).isNotNull().cast("int") + 2,
        "packing_strategy": F.when(F.coalesce(p("feature_packing"), F.lit(True)), "feature").otherwise("none"),
        "reduction_strategy": F.coalesce(p("reduction_tree_strategy"), F.lit("binary_tree")),
        "execution_success": F.coalesce((raw("status").cast("string") == "ok").cast("int"), F.lit(0)),
        "error_constraint_feasible": F.coalesce(numeric(present(raw("error_constraint_feasible"))).cast("int"), feasible),
        "total_seconds": given("total_seconds", "total_he_compute_seconds", "total_ckks_compute_seconds"),
        "peak_memory_mb": F.coalesce(given("peak_memory_mb"), given("peak_rss_bytes") / (1024 * 1024)),
        "ciphertext_bytes": ciphertext,
        "communication_bytes": F.coalesce(some(raw("communication_bytes")), ciphertext),
        "key_bytes": given("total_key_material_bytes", "key_bytes", "public_context_bytes"),
        "key_bytes_scope": scope,
        "max_absolute_error": error,
    }
    strategy = F.coalesce(p("chunk_aggregation_strategy"), F.lit("reduce_then_add"))
    derived |= slots.operation_counts(samples, variants, each, strategy)
    return rows.select(*[F.col(f"`{c}`") for c in records.columns if c not in derived], *[c.alias(n) for n, c in derived.items()])


def for_training(canonical_: DataFrame) -> DataFrame:
    """The canonical rows that hold a measurement: of a kind that is measured or for validation alone, with a status."""
    kind = F.col("measurement_kind")
    return canonical_.filter((kind.startswith("measured") | (kind == "validation_only")) & F.col("status").isNotNull())


def residuals(canonical_: DataFrame, predicted: str, scopes: str, key: list[str]) -> DataFrame:
    """(key, target, residual): measured less predicted, of rows that are ok, for each predicted target that was measured.

    ``predicted`` is a map from target to prediction, ``scopes`` one from target to what it covers: key bytes of
    another scope than the row's aren't compared, and probabilities have no measurement.
    """
    targets = [c for c in TARGETS if c in canonical_.columns]
    measured = F.create_map(*[x for c in targets for x in (F.lit(c), F.col(c).cast("double"))])
    rows = canonical_.filter("status = 'ok'").select(*key, "key_bytes_scope", measured.alias("m"), F.col(scopes).alias("s"), F.explode(predicted).alias("target", "guess"))
    found, covers = F.element_at("m", F.col("target")), F.element_at("s", F.col("target"))
    same = (F.col("target") != "key_bytes") | F.coalesce(covers, F.lit("")).isin("") | (covers == F.col("key_bytes_scope"))
    rows = rows.select(*key, "target", (found - F.col("guess")).alias("residual"), same.alias("same"))
    return rows.filter(F.col("same") & F.col("residual").isNotNull() & ~F.col("target").endswith("_probability")).drop("same")


#: What models predict.
TARGETS = ["evaluation_seconds", "total_seconds", "peak_memory_mb", "ciphertext_bytes", "communication_bytes", "key_bytes", "max_absolute_error"]
#: The splits by group and the column that each holds out, and the one by source.
SPLITS = {
    "unseen_variant_count": "group_variant_count", "unseen_sample_count": "group_sample_count", "unseen_window_size": "group_window_size",
    "unseen_parameter_combination": "group_parameter_combination", "unseen_scheme_configuration": "group_scheme_configuration", "one_pgs_to_another": "group_pgs",
}


def generalization_splits(canonical_: DataFrame, fraction: float = 0.2, seed: int = 20260728) -> DataFrame:
    """One row for each of the seven splits: name, group_key, status, train_rows, test_rows, n_groups; unavailable ones stay as rows without counts.

    Groups are held out whole: those with the least hashes of the seed and their name, a ``fraction`` of them and one at
    least. That goes for any number of groups, without any list of them. The seventh split trains on synthetic sources and tests on real ones.
    """
    rows = canonical_.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("group_key"), F.col(c).alias("g")) for n, c in SPLITS.items()])).alias("x")).select("x.*")
    groups = rows.filter("g <> ''").groupBy("name", "group_key", "g").agg(F.count(F.lit(1)).alias("n"))
    each = groups.groupBy("name", "group_key").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "g")), "g"))
    many = F.greatest(F.lit(1), F.bround(F.col("n_groups") * F.lit(fraction)).cast("long"))
    held = groups.select("name", "n", place.alias("place")).join(each, "name").filter(F.col("place") <= many).groupBy("name").agg(F.sum("n").alias("test_rows"))
    out = each.join(held, "name").select("name", "group_key", "n_groups", "total", "test_rows")
    domains = canonical_.filter(F.col("group_source_domain").isin("synthetic", "real")).groupBy().agg(
        F.count_distinct("group_source_domain").alias("n_groups"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("group_source_domain") == "real").alias("test_rows")
    )
    out = out.unionByName(domains.select(F.lit("synthetic_to_real").alias("name"), F.lit("group_source_domain").alias("group_key"), "n_groups", "total", "test_rows"))
    every = canonical_.sparkSession.createDataFrame([*SPLITS.items(), ("synthetic_to_real", "group_source_domain")], "name string, group_key string")
    out = every.join(out.drop("group_key"), "name", "left")
    ok = F.coalesce(F.col("n_groups") >= 2, F.lit(False))
    return out.select(
        "name", "group_key", F.when(ok, "ok").otherwise("unavailable").alias("status"), F.when(ok, F.col("total") - F.col("test_rows")).otherwise(0).alias("train_rows"),
        F.when(ok, F.col("test_rows")).otherwise(0).alias("test_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
    )


def one_scope(canonical_: DataFrame) -> DataFrame:
    """``canonical_``, with an error as soon as a row is read if its key bytes are of several scopes, which can't be fitted together."""
    scopes = canonical_.filter(F.col("key_bytes").isNotNull()).agg(F.array_sort(F.collect_set(F.nullif("key_bytes_scope", F.lit("")))).alias("scopes"))
    mixed = F.when(F.size("scopes") > 1, F.raise_error(F.concat(F.lit("key bytes of several scopes: "), F.array_join("scopes", ", "))))
    return canonical_.crossJoin(F.broadcast(scopes)).filter(mixed.isNull()).drop("scopes")  # one row, of a handful of scopes


def balanced_objective(rows: DataFrame, targets: list[str], by: list[str]) -> DataFrame:
    """Adds ``objective``: for rows with all targets the sum of their log1p, each scaled to 0 to 1 over such rows of the group (``by``)."""
    whole = reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in targets])
    logs = {f"__{t}": F.when(whole, F.log1p(F.greatest(F.lit(0.0), F.col(t).cast("double")))) for t in targets}
    rows = rows.withColumns(logs)
    bounds = rows.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in logs for n, f in (("lo", F.min), ("hi", F.max))])
    rows = rows.join(bounds, by) if by else rows.crossJoin(F.broadcast(bounds))  # one row
    share = [F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")), F.lit(0.0)) for c in logs]
    objective = F.when(whole, reduce(lambda a, b: a + b, share))
    return rows.withColumn("objective", objective).drop(*[x for c in logs for x in (c, f"{c}_lo", f"{c}_hi")])


def group_metrics(rows: DataFrame, by: list[str], metrics: list[str], firsts: dict[str, Column], order: str) -> DataFrame:
    """Per group: repeats, those ok, ok if all are, values of the first row, and of each metric mean, sample deviation (0 for one), least and greatest."""
    ok, of = F.col("status") == "ok", lambda m: F.col(m).cast("double")
    stats = [
        a.alias(f"{m}_{n}") for m in metrics
        for n, a in (("mean", F.avg(of(m))), ("sd", F.coalesce(F.stddev_samp(of(m)), F.lit(0.0))), ("min", F.min(of(m))), ("max", F.max(of(m))))
    ]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("repeats"), F.count_if(ok).alias("ok_repeats"), F.when(F.bool_and(ok), "ok").otherwise("failed").alias("status"),
        *[F.min_by(c, order).alias(n) for n, c in firsts.items()], *stats,
    )


def twelve_digits(x: Column) -> Column:
    """A number as text of up to twelve digits, without trailing zeros; null becomes an empty text. Large and small ones have an exponent."""
    power = F.floor(F.log10(F.abs(x)))
    plain = F.regexp_replace(F.regexp_replace(fixed(x, 11 - power), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(F.format_string("%.11e", x), r"\.?0+e", "e")
    return F.when(x.isNull(), "").when(x == 0, "0").when(power.between(-4, 11), plain).otherwise(short)


def fixed(x: Column, places: Column) -> Column:
    """A number with so many decimal places, at most 17."""
    out = F.format_string("%.0f", x)
    for n in range(1, 18):
        out = F.when(places == n, F.format_string(f"%.{n}f", x)).otherwise(out)
    return out


def ratio_text(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit("")).otherwise(F.format_string("%.6f", a.cast("double") / b.cast("double")))
