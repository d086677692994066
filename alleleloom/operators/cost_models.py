"""Cost models of plans: ridge regressions of what was measured, fitted for all targets and splits out of one pass, stored as a table.

A record becomes 38 features: 35 numbers, scaled by a signed log1p, and three schemes. One pass sums up, for each target, the packed
upper triangle of X'X with X'y of the rows where the target is usable; and the same of the rows that each split holds out. A split's
training sums are the total less those, so all splits are fitted without reading the records again. What comes to the driver is
one vector of 860 sums for each target and split. The models are rows of a table, which a join applies to records; or
they are compiled to expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import slots
from . import models, ranks, records

#: The numbers of a record that are features, the schemes, and what is predicted.
NUMERIC = [
    "matched_variant_count", "sample_count", "score_count", "total_pgs_variants", "ring_dimension", "multiplicative_depth", "slots_used", "window_size", "chunk_count",
    "ciphertext_count", "multiplication_count", "addition_count", "rotation_count", "key_count", "samples_per_ciphertext", "scores_per_ciphertext", "plaintext_modulus",
    "fixed_point_scale", "ckks_scale_bits", "scaling_modulus_size", "first_modulus_size", "genotype_min", "genotype_max", "missing_rate", "max_absolute_weight",
    "sum_absolute_weights", "weight_mean", "weight_standard_deviation", "weight_decimal_precision", "expected_score_bound", "score_sparsity", "score_overlap_ratio",
    "physical_core_count", "logical_core_count", "ram_bytes",
]
SCHEMES = ["CKKS", "BFV", "BGV"]
NAMES = [*NUMERIC, *[f"scheme_{s}" for s in SCHEMES]]
TARGETS = ["evaluation_seconds", "total_seconds", "peak_memory_mb", "ciphertext_bytes", "key_bytes", "max_absolute_error", "max_relative_error"]
#: The splits and the column by whose groups each is made.
SPLITS = records.SPLITS | {"synthetic_to_real": "group_source_domain"}
#: Labels and the probabilities that are predicted for them.
LABELS = {"execution_success": "success_probability", "error_constraint_feasible": "feasible_probability"}

SIZE = len(NAMES) + 1
ROWS, COLUMNS = np.triu_indices(SIZE)
#: Partial sums are added up in so many groups for each target and split first.
GROUPS = 64
ALL = "all"
#: Digits behind the point of a prediction's logarithm: what sums in another order change lies below, and makes no ranks.
DIGITS = 6


def number(rows: DataFrame, name: str) -> Column:
    """A column as doubles, whatever it is; null where there is none."""
    kinds = dict(rows.dtypes)
    if name not in kinds:
        return F.lit(None).cast("double")
    return records.numeric(F.col(f"`{name}`")) if kinds[name] == "string" else F.col(f"`{name}`").cast("double")


def features(rows: DataFrame) -> Column:
    """The 38 features of a row as an array; what is missing, null or no finite number counts as 0."""
    hot = models.one_hot(F.col("scheme") if "scheme" in rows.columns else F.lit(""), SCHEMES)
    return F.concat(F.transform(F.array(*[number(rows, n) for n in NUMERIC]), models.log_scaled), F.array(*hot.values()))


def facts(rows: DataFrame) -> DataFrame:
    """What the models need of canonical rows: the features ``x``, the targets ``y`` and the groups ``g`` of the splits, an array each."""
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("") for c in SPLITS.values()]
    return rows.select(features(rows).alias("x"), F.array(*[number(rows, t) for t in TARGETS]).alias("y"), F.array(*groups).alias("g"))


def partial_sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (x, y, within) the count and packed sums of each set and target, added up over the whole partition."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in stream:
        if not batch.num_rows:
            continue
        flat = lambda k, kind: np.asarray(batch.column(k).flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(batch.num_rows, -1)  # noqa: B023, E731
        x, y, within = flat(0, np.float64), flat(1, np.float64), flat(2, bool)
        x = np.hstack([np.ones((len(x), 1)), x])
        for t in range(y.shape[1]):
            for s in range(within.shape[1]):
                some = within[:, s] & np.isfinite(y[:, t])
                if some.any():
                    a, b = x[some], np.log1p(np.maximum(y[some, t], 0))
                    new = np.concatenate([[len(b)], (a.T @ a)[ROWS, COLUMNS], a.T @ b])
                    sums[s, t] = sums.get((s, t), 0) + new
    out = sorted(sums)
    kinds = [pa.array([k[j] for k in out], pa.int32()) for j in (0, 1)]
    yield pa.RecordBatch.from_arrays([*kinds, pa.array([sums[k].tolist() for k in out], pa.list_(pa.float64()))], ["s", "t", "sums"])


def added(rows: DataFrame, by: list[str]) -> DataFrame:
    """The sum of the vectors ``sums`` of each group."""
    fields = ", ".join(f"{c} int" for c in by) + ", sums array<double>"

    def total(key: tuple, part: pa.Table) -> pa.Table:
        vectors = np.asarray(part["sums"].combine_chunks().flatten()).reshape(part.num_rows, -1)
        return pa.table({**{c: pa.array([k.as_py()], pa.int32()) for c, k in zip(by, key)}, "sums": pa.array([vectors.sum(axis=0).tolist()], pa.list_(pa.float64()))})

    return rows.groupBy(*by).applyInArrow(total, fields)


def gram_sums(rows: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """(set, target, n, gram, moments) of facts, for each target that has rows where it is a finite number in a set.

    ``gram`` is X'X packed, row by row from the diagonal on, ``moments`` X'y, both with a leading 1; y is log1p of the target, at least 0.
    """
    data = rows.select("x", "y", F.array(*[F.coalesce(c, F.lit(False)) for c in sets.values()]).alias("within"))
    sums = data.mapInArrow(partial_sums, "s int, t int, sums array<double>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    sums = added(added(sums, ["s", "t", "part"]).drop("part"), ["s", "t"])
    name = lambda names, k: F.element_at(F.array(*map(F.lit, names)), F.col(k) + 1)
    n = len(ROWS)
    return sums.select(
        name(list(sets), "s").alias("set"), name(TARGETS, "t").alias("target"), F.col("sums")[0].cast("long").alias("n"), F.slice("sums", 2, n).alias("gram"), F.slice("sums", n + 2, SIZE).alias("moments"),
    )


def solved(gram: np.ndarray, moments: np.ndarray, penalty: float) -> list[float]:
    """Intercept and coefficients, the intercept without penalty, by elimination with pivots."""
    full = np.zeros((SIZE, SIZE))
    full[ROWS, COLUMNS] = full[COLUMNS, ROWS] = gram
    full[np.arange(1, SIZE), np.arange(1, SIZE)] += penalty
    return np.linalg.solve(full, moments).tolist()


MODEL = "split string, target string, log_target boolean, n long, scope string, intercept double, coefficients array<double>"


def fitted(spark: SparkSession, sums: dict[tuple[str, str], tuple], scope: str | None, penalty: float = 1.0) -> DataFrame:
    """The models (MODEL) of the sums (n, gram, moments) of each (split, target)."""
    rows = []
    for (split, target), (n, gram, moments) in sorted(sums.items()):
        if round(n) > 0:
            first, *rest = solved(np.asarray(gram), np.asarray(moments), penalty)
            rows.append((split, target, True, round(n), scope if target == "key_bytes" else None, first, rest))
    return spark.createDataFrame(rows, MODEL)


def of_scope(rows: DataFrame, scope: str | None) -> DataFrame:
    """``rows`` with the key bytes of other scopes taken as not measured; of scopes mixed, if none is given, an error comes as soon as rows are read."""
    if "key_bytes" not in rows.columns or "key_bytes_scope" not in rows.columns:
        return rows
    if scope is None:
        return records.one_scope(rows)
    return rows.withColumn("key_bytes", F.when(F.col("key_bytes_scope") == scope, F.col("key_bytes")))


def collected(sums: DataFrame) -> dict[tuple[str, str], tuple]:
    """Sums by set and target on the driver: SIZE * (SIZE + 3) / 2 numbers each."""
    return {(r["set"], r["target"]): (r["n"], np.array(r["gram"]), np.array(r["moments"])) for r in sums.collect()}


def train(canonical_: DataFrame, scope: str | None = None, penalty: float = 1.0) -> DataFrame:
    """The regressions (MODEL, split "all") of every target that the measured rows with status ok have; key bytes of one ``scope`` alone."""
    rows = of_scope(records.for_training(canonical_).filter("status = 'ok'"), scope)
    return fitted(canonical_.sparkSession, collected(gram_sums(facts(rows), {ALL: F.lit(True)})), scope, penalty)


def train_labels(canonical_: DataFrame, penalty: float = 0.001) -> DataFrame:
    """Logistic regressions (MODEL, not ``log_target``, by the LABELS' probabilities) of those labels that measured rows have both ways; the model of the other ones is left out."""
    rows, out = records.for_training(canonical_), []
    for label, name in LABELS.items():
        given = F.col(label) if label in rows.columns else F.lit(None).cast("string")
        y = records.binary_label(given, F.col("status")) if label == "execution_success" else F.when(records.usable_label(given), records.binary_label(given))
        some = rows.select(y.alias("y"), features(rows).alias("x")).filter("y is not null")
        some = some.select("y", *[F.col("x")[k].alias(f"x{k}") for k in range(SIZE - 1)])
        seen = some.groupBy().agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count(F.lit(1)).alias("n")).first()
        if seen["n"] and seen["low"] != seen["high"]:
            first, *rest = models.logistic(some, [f"x{k}" for k in range(SIZE - 1)], "y", penalty=penalty)
            out.append((ALL, name, False, seen["n"], None, first, rest))
    return canonical_.sparkSession.createDataFrame(out, MODEL)


def write_models(fits: DataFrame, path: str) -> None:
    """One row for each coefficient: MODEL's other columns, ``position`` (0: the intercept), ``feature`` and ``coefficient``; replaces what is there."""
    every = F.concat(F.array("intercept"), "coefficients")
    named = F.element_at(F.array(*map(F.lit, ["intercept", *NAMES])), F.col("position") + 1)
    rows = fits.select("split", "target", "log_target", "n", "scope", F.posexplode(every).alias("position", "coefficient"))
    rows.withColumn("feature", named).coalesce(1).write.mode("overwrite").parquet(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """MODEL, from what write_models has written; features are taken by their names, those that it lacks count 0."""
    rows = spark.read.parquet(path).groupBy("split", "target", "log_target", "n", "scope").agg(F.map_from_entries(F.collect_list(F.struct("feature", "coefficient"))).alias("of"))
    of = lambda name: F.coalesce(F.col("of")[name], F.lit(0.0))
    return rows.select("split", "target", "log_target", "n", "scope", of("intercept").alias("intercept"), F.array(*[of(n) for n in NAMES]).alias("coefficients"))


def with_predictions(rows: DataFrame, fits: DataFrame, split: str = ALL) -> DataFrame:
    """Adds a column for each target of the models, compiled to an expression, and ``scopes``, a map from target to what it covers. Models are few rows, which come to the driver."""
    few = fits.filter(F.col("split") == split).orderBy("target").collect()
    scopes = [x for r in few if r["scope"] for x in (F.lit(r["target"]), F.lit(r["scope"]))]
    rows = rows.withColumn("__x", features(rows))
    out = {r["target"]: predicted(F.array(*map(F.lit, r["coefficients"])), F.lit(r["intercept"]), F.lit(r["log_target"])) for r in few}
    return rows.withColumns(out | {"scopes": F.create_map(*scopes).cast("map<string,string>")}).drop("__x")


def predicted(coefficients: Column, intercept: Column, log_target: Column) -> Column:
    """A model's prediction for the features ``__x``: of a measurement, not below 0, or of a probability."""
    raw = F.aggregate(F.zip_with("__x", coefficients, lambda a, b: a * b), intercept, lambda a, b: a + b)
    raw = F.round(raw, DIGITS)
    return F.when(log_target, F.greatest(F.lit(0.0), F.expm1(raw))).otherwise(models.sigmoid(raw))


def of_plans(plans: DataFrame, samples: int, variants: int) -> DataFrame:
    """Plans under the names that records have, with the operations that each takes for a workload of so many samples and variants."""
    col = F.col
    counts = slots.operation_counts(F.lit(samples).cast("long"), F.lit(variants).cast("long"), F.greatest(F.lit(1).cast("long"), col("per_ciphertext")), col("aggregation"))
    named = {
        "matched_variant_count": F.lit(variants).cast("long"), "sample_count": F.lit(samples).cast("long"), "ring_dimension": col("ring"), "multiplicative_depth": col("depth"),
        "slots_used": col("window"), "window_size": col("window"), "samples_per_ciphertext": col("samples_each"), "scores_per_ciphertext": col("scores_each"),
        "plaintext_modulus": col("modulus"), "fixed_point_scale": col("fixed_scale"), "ckks_scale_bits": col("scale_bits"),
    }
    return plans.withColumns(named | counts)


def scored(rows: DataFrame, fits: DataFrame, keep: list[str], on: list[str] = ()) -> DataFrame:
    """(``keep``, split, target, predicted) for each row and model, by a join with the models, which are one row for each split and target.

    ``on``: columns of both that must agree. Without any, a row meets each of some dozen models.
    """
    few = F.broadcast(fits.select("split", "target", "log_target", "intercept", "coefficients"))
    x = rows.select(*keep, features(rows).alias("__x")) if "__x" not in rows.columns else rows.select(*keep, "__x")
    x = x.join(few, list(on)) if on else x.crossJoin(few)
    return x.select(*keep, *[c for c in ("split", "target") if c not in keep], predicted(F.col("coefficients"), F.col("intercept"), F.col("log_target")).alias("predicted"))


def held_out(every: DataFrame, rows: DataFrame, fraction: float, seed: int) -> dict[str, tuple[Column | None, str | None]]:
    """For each split whether a row is held out, as an expression, or None and why there is no such split.

    Both are facts. Of the groups of ``rows`` those with the least hashes are held out, a ``fraction`` of them and one at least, so one hash and
    name a split tell it. Splits need two groups of ``every`` that aren't empty.
    """
    long = lambda df: df.select(F.posexplode("g").alias("k", "g")).select(F.element_at(F.array(*map(F.lit, SPLITS)), F.col("k") + 1).alias("name"), "g")
    digest = lambda g: F.md5(F.concat_ws("|", F.lit(str(seed)), g))
    real = F.col("name") == "synthetic_to_real"
    known = long(every).filter("g <> ''").filter(~real | F.col("g").isin("synthetic", "real")).distinct().groupBy("name").count()
    known = {r["name"]: r["count"] for r in known.collect()}
    groups = long(rows).filter(~real).distinct()
    by = Window.partitionBy("name")
    groups = groups.withColumns({"h": digest(F.col("g")), "all": F.count(F.lit(1)).over(by)})
    place = groups.withColumn("place", F.row_number().over(by.orderBy("h", "g")))
    edge = place.filter((F.col("all") > 1) & (F.col("place") == F.greatest(F.lit(1), F.bround(F.col("all") * F.lit(fraction)).cast("long"))))
    edge = {r["name"]: (r["h"], r["g"]) for r in edge.collect()}
    out: dict[str, tuple[Column | None, str | None]] = {}
    for k, name in enumerate(SPLITS):
        g = F.col("g")[k]
        if known.get(name, 0) < 2:
            why = "both synthetic and real source domains are required" if name == "synthetic_to_real" else "at least two non-empty groups are required"
            out[name] = None, why
        elif name == "synthetic_to_real":
            out[name] = g == "real", None
        elif name in edge:
            out[name] = F.struct(digest(g), g) <= F.struct(*map(F.lit, edge[name])), None
        else:
            out[name] = F.lit(False), None
    return out


def evaluate_splits(canonical_: DataFrame, scope: str | None = None, fraction: float = 0.2, seed: int = 20260728, penalty: float = 1.0) -> DataFrame:
    """One row for each split and target: name, group_key, status, reason, train_rows, test_rows, target, measured_on, n, mae, rmse, mape, r2, spearman.

    The measured rows with status ok are summed up once, in total and for what each split holds out; the models of a split come from the
    difference. They are measured on the rows held out, or on all others if none of these has the target. A split that can't be made, or without any
    row to train on, is one row without a target. No rows, seven of those. What is read several times is kept on the executors until the result, some dozen rows, is there.
    """
    rows = facts(of_scope(records.for_training(canonical_).filter("status = 'ok'"), scope)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _evaluated(rows, held_out(facts(canonical_), rows, fraction, seed), scope, penalty)
    finally:
        rows.unpersist()


def _evaluated(rows: DataFrame, tests: dict[str, tuple[Column | None, str | None]], scope: str | None, penalty: float) -> DataFrame:
    spark = rows.sparkSession
    made = {n: t for n, (t, _) in tests.items() if t is not None}
    sets = {ALL: F.lit(True), **made}
    sums = collected(gram_sums(rows, sets))
    sizes = rows.agg(F.count(F.lit(1)).alias(ALL), *[F.count_if(t).alias(n) for n, t in made.items()]).first()
    left: dict[tuple[str, str], tuple] = {}
    for n in made:
        for t in TARGETS:
            if (ALL, t) in sums:
                whole, out = sums[ALL, t], sums.get((n, t))
                left[n, t] = tuple(a - b for a, b in zip(whole, out)) if out else whole
    fits = fitted(spark, left, scope, penalty)
    on_test = {(n, t): bool((n, t) in sums) for n, t in left}

    flags = [F.struct(F.lit(n).alias("split"), F.coalesce(t, F.lit(False)).alias("out")) for n, t in made.items()]
    actual = F.arrays_zip(F.array(*map(F.lit, TARGETS)).alias("target"), F.col("y").alias("actual"))
    tested = F.concat_ws("|", "split", "target").isin([f"{n}|{t}" for (n, t), yes in on_test.items() if yes])
    if flags:
        long = rows.select(F.col("x").alias("__x"), F.explode(F.array(*flags)).alias("f"), actual.alias("__y")).select("__x", "f.*", F.inline("__y").alias("target", "actual"))
        long = long.filter(F.col("actual").isNotNull() & ~F.isnan("actual") & (F.abs("actual") < float("inf")) & (F.col("out") == tested))
        measures = regression_measures(scored(long, fits, ["split", "target", "actual"], on=["split", "target"]), ["split", "target"])
    else:
        measures = spark.createDataFrame([], "split string, target string, n long, mae double, rmse double, mape double, r2 double, spearman double")
    heads = []
    for n, (t, why) in tests.items():
        if t is not None and not sizes[ALL] - sizes[n]:
            t, why = None, "cost-model training requires at least one training row"
        heads.append((n, SPLITS[n], "ok" if t is not None else "unavailable", why, sizes[ALL] - sizes[n] if t is not None else 0, sizes[n] if t is not None else 0))
    heads = spark.createDataFrame(heads, "name string, group_key string, status string, reason string, train_rows long, test_rows long")
    out = heads.join(measures, (F.col("name") == F.col("split")) & (F.col("status") == "ok"), "left")
    measured_on = F.when(F.col("target").isNotNull(), F.when(tested, "test").otherwise("train")).alias("measured_on")
    return out.select("name", "group_key", "status", "reason", "train_rows", "test_rows", "target", measured_on, "n", "mae", "rmse", "mape", "r2", "spearman")


def regression_measures(rows: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, n, mae, rmse, mape, r2, spearman) of ``actual`` and ``predicted`` in each group; mape leaves zeros out and is 0 without others, r2 and spearman are 0 where nothing varies.

    Equal pairs of both are counted and kept first: the predictions are made once, and everything else comes from the counts. The result, a row for each group, is collected.
    """
    pairs = ranks.pairs_of(rows, "actual", "predicted", by).persist(StorageLevel.DISK_ONLY)
    try:
        a, e, n = F.col("__a"), F.col("__b") - F.col("__a"), F.col("__n")
        all_, nonzero = F.sum(n), F.sum(F.when(a != 0, n))
        sums = pairs.groupBy(*by).agg(
            all_.alias("n"), (F.sum(n * F.abs(e)) / all_).alias("mae"), F.sqrt(F.sum(n * e * e) / all_).alias("rmse"),
            F.coalesce(F.sum(F.when(a != 0, n * F.abs(e / a))) / nonzero, F.lit(0.0)).alias("mape"), F.sum(n * e * e).alias("res"), (F.sum(n * a) / all_).alias("mean"),
        )
        spread = ranks.same(pairs, sums.select(*by, "mean"), by).groupBy(*by).agg(F.sum(n * (a - F.col("mean")) * (a - F.col("mean"))).alias("tot"))
        sums = ranks.same(sums, spread, by).withColumn("r2", F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(0.0)).drop("res", "tot", "mean")
        out = ranks.same(sums, ranks.spearman_of_pairs(pairs, by), by)
        return rows.sparkSession.createDataFrame(out.collect(), out.schema)
    finally:
        pairs.unpersist()
