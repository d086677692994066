"""Records with keys that only some have, and texts of numbers."""

import math

import pytest
from pyspark.sql import functions as F

from alleleloom.operators import records


def test_any_keys_will_do(spark):
    one = records.canonicalize(spark.createDataFrame([("ok", 4, '{"scheme": "bgv", "window_size": 512}')], "status string, samples int, plan string")).first()
    assert (one["scheme"], one["sample_count"], one["window_size"], one["measurement_kind"], one["key_bytes_scope"]) == ("BGV", 4, 512, "measured_unspecified", "unavailable")
    two = spark.sql("select 'ok' as status, '1e1' as variants, named_struct('ring_dimension', 8192) as plan")
    got = records.canonicalize(two).first()
    assert (got["ring_dimension"], got["matched_variant_count"], got["group_window_size"], got["workload_group"]) == (8192, 10, "window:10", "unspecified")


@pytest.mark.parametrize(("text", "domain"), [("pgs004941", "real"), ("1000G chr22", "real"), ("1000 genomes", "real"), ("Synthetic PGS", "synthetic"), ("x", "unspecified")])
def test_domains(spark, text, domain):
    assert spark.range(1).select(records.source_domain(F.lit(text))).first()[0] == domain


def test_twelve_digits(spark):
    values = [0.0, 1.0, -2.5, 1 / 3, 1e-5, 1.5e-7, 123456789012.0, 1.25e15, -0.001, 999999.9999, None, 100.0]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").select("k", records.twelve_digits(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == ["" if v is None else f"{v:.12g}" for v in values]


def test_labels(spark):
    rows = spark.createDataFrame([("", "ok"), (None, "bad"), ("Yes ", ""), ("0", "ok"), ("nan", "ok")], "t string, status string")
    got = rows.select(records.binary_label(F.col("t"), F.col("status")).alias("l"), records.usable_label(F.col("t")).alias("u"), records.usable_numeric(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(1, False, False), (0, False, False), (1, True, False), (0, True, True), (0, False, False)]


def test_scopes_do_not_mix(spark):
    rows = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (None, "b")], "key_bytes double, key_bytes_scope string")
    assert records.one_scope(rows).count() == 3
    with pytest.raises(Exception, match="several scopes: a, b"):
        records.one_scope(rows.fillna(3.0)).collect()


def test_sigmoid_at_its_ends(spark):
    from alleleloom.operators import models

    got = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,), (2.0,)], "x double").select(models.sigmoid(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.0, 0.5, 1.0, pytest.approx(1 / (1 + math.exp(-2)))]


def test_logistic_finds_the_coefficients(spark):
    import numpy as np

    from alleleloom.operators import models

    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 2))
    y = r.random(4000) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, -2.0])))
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    got = models.logistic(rows, ["a", "b"], "y")
    assert got == pytest.approx([0.5, 1.5, -2.0], abs=0.25)
    # At the maximum the residuals are orthogonal to the features.
    p = 1 / (1 + np.exp(-(got[0] + x @ got[1:])))
    assert np.abs(np.column_stack([np.ones(4000), x]).T @ (y - p)).max() < 0.5
    hit = rows.select(((models.probability(["a", "b"], got) >= 0.5).cast("int") == F.col("y")).cast("double").alias("h")).agg(F.avg("h")).first()[0]
    assert hit > 0.8
