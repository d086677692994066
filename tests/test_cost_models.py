"""Cost models against numpy on the collected rows; ranks, medians and primes at size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alleleloom.operators import cost_models, ranks
from alleleloom.plans import validator

SCHEMA = "status string, measurement_kind string, scheme string, ring_dimension long, window_size long, sample_count string, g string, key_bytes double, key_bytes_scope string, evaluation_seconds double, total_seconds double, group_variant_count string, group_sample_count string, group_source_domain string, error_constraint_feasible int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for k in range(400):
        ring, window, samples = r.choice([8192, 16384, None]), r.choice([256, 512, 1024]), r.choice(["3", "7", "", "x", None])
        seconds = (ring or 1) / 1000 * (1 + window / 100) + r.random()
        fails = r.random() < 0.2
        out.append((
            "failed" if fails else "ok", r.choice(["measured", "measured_historical", "validation_only", "simulated"]), r.choice(["CKKS", "bfv", "BGV", None]), ring, window, samples, "x",
            r.choice([100.0, 200.0, None]), r.choice(["a", "b"]), None if fails else seconds, r.choice([None, float("nan"), seconds * 2]), f"variants:{k % 9}", f"samples:{k % 2}" if k % 3 else "",
            r.choice(["synthetic", "real", "unspecified"]), r.choice([0, 1, None]),
        ))
    return out


@pytest.fixture(scope="module")
def canon(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def vectors(rows, target, keep=lambda r: True):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    x, y = [], []
    for r in map(lambda r: dict(zip(names, r)), rows):
        if r["status"] != "ok" or r["measurement_kind"] == "simulated" or not keep(r) or r[target] is None or not np.isfinite(r[target]):
            continue
        v = [1.0]
        for n in cost_models.NUMERIC:
            try:
                a = float(r.get(n) or 0)
            except ValueError:
                a = 0.0
            v.append(np.sign(a) * np.log1p(abs(a)))
        v += [float((r["scheme"] or "").upper() == s) for s in cost_models.SCHEMES]
        x.append(v)
        y.append(np.log1p(r[target]))
    return np.array(x), np.array(y)


def ridge(x, y):
    penalty = np.eye(x.shape[1])
    penalty[0, 0] = 0
    return np.linalg.solve(x.T @ x + penalty, x.T @ y)


def test_all_targets_out_of_one_pass(spark, rows, canon, tmp_path):
    fits = cost_models.train(canon, "a")
    cost_models.write_models(fits, f"{tmp_path}/models")
    stored = cost_models.read_models(spark, f"{tmp_path}/models")
    for some in (fits, stored):
        found = {r["target"]: r for r in some.collect()}
        assert found.keys() == {"evaluation_seconds", "total_seconds", "key_bytes"}
        for t, r in found.items():
            x, y = vectors(rows, t, lambda r: t != "key_bytes" or r["key_bytes_scope"] == "a")  # noqa: B023
            assert r["n"] == len(y) and r["scope"] == ("a" if t == "key_bytes" else None)
            np.testing.assert_allclose([r["intercept"], *r["coefficients"]], ridge(x, y), atol=1e-7)
    predicted = cost_models.with_predictions(canon, stored).collect()
    joined = {(r["status"], r["evaluation_seconds"], r["target"]): r["predicted"] for r in cost_models.scored(canon, stored, ["status", "evaluation_seconds"]).collect()}
    x, _ = vectors(rows, "evaluation_seconds")
    want = np.maximum(0, np.expm1(np.round(x @ ridge(*vectors(rows, "evaluation_seconds")), 6)))
    measured = [r[9] for r in rows if r[0] == "ok" and r[1] != "simulated"]
    np.testing.assert_allclose([joined["ok", m, "evaluation_seconds"] for m in measured], want, rtol=2e-6)
    again = cost_models.with_predictions(canon.withColumnRenamed("evaluation_seconds", "m"), stored).filter("status = 'ok' and measurement_kind <> 'simulated'")
    assert {r["m"]: r["evaluation_seconds"] for r in again.collect()} == {m: joined["ok", m, "evaluation_seconds"] for m in measured}
    assert {tuple(r["scopes"].items()) for r in predicted} == {(("key_bytes", "a"),)}


def test_scopes_are_not_mixed(canon):
    with pytest.raises(Exception, match="several scopes"):
        cost_models.train(canon)


def test_splits_by_subtraction(rows, canon):
    """Each split's measures are those of a fit on its own training rows."""
    got = cost_models.evaluate_splits(canon.withColumns({c: F.lit("") for c in ("group_window_size", "group_parameter_combination", "group_scheme_configuration", "group_pgs")}), "a").collect()
    by = {(r["name"], r["target"]): r for r in got}
    assert len({r["name"] for r in got}) == 7 and sum(r["status"] == "unavailable" for r in got) == 4
    assert all(r["reason"] == "at least two non-empty groups are required" for r in got if r["status"] == "unavailable")
    for t in ("evaluation_seconds", "total_seconds"):
        x, y = vectors(rows, t, lambda r: r["group_source_domain"] != "real")
        b = ridge(x, y)
        x, y = vectors(rows, t, lambda r: r["group_source_domain"] == "real")
        p, a = np.maximum(0, np.expm1(np.round(x @ b, 6))), np.expm1(y)
        r = by["synthetic_to_real", t]
        assert r["measured_on"] == "test" and r["n"] == len(a)
        assert (r["mae"], r["rmse"]) == pytest.approx((np.abs(p - a).mean(), np.sqrt(((p - a) ** 2).mean())), rel=1e-5)
        assert r["r2"] == pytest.approx(1 - ((p - a) ** 2).sum() / ((a - a.mean()) ** 2).sum(), abs=1e-5)
        assert r["spearman"] == pytest.approx(np.corrcoef(places(a), places(p))[0, 1], abs=1e-4)
    held = by["unseen_sample_count", "evaluation_seconds"]
    assert held["train_rows"] + held["test_rows"] == by["synthetic_to_real", "evaluation_seconds"]["train_rows"] + by["synthetic_to_real", "evaluation_seconds"]["test_rows"]


def test_no_records(spark):
    got = cost_models.evaluate_splits(spark.createDataFrame([], SCHEMA + ", group_window_size string, group_parameter_combination string, group_scheme_configuration string, group_pgs string"), "a").collect()
    assert len(got) == 7 and {r["status"] for r in got} == {"unavailable"}


def test_labels(canon):
    fits = {r["target"]: r for r in cost_models.train_labels(canon).collect()}
    assert fits.keys() == {"success_probability", "feasible_probability"} and not any(r["log_target"] for r in fits.values())
    one = cost_models.train_labels(canon.filter("status = 'ok'").withColumn("error_constraint_feasible", F.lit(1)))
    assert one.count() == 0


def places(values):
    order, out = np.sort(values), np.empty(len(values))
    for k, v in enumerate(values):
        out[k] = (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2
    return out


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(5)
    out = [(r.choice(["a", "b", "b", "b", None]), r.choice([0.0, -0.0, 1e-300, -1e300, 5.0, r.gauss(0, 1), round(r.gauss(0, 1), 1)]), float(r.randint(0, 9))) for _ in range(3001)]
    out += [("c", 1.5, 1.0), ("c", None, 2.0), ("d", None, 1.0), ("e", float(1 << 62), 1.0), ("e", -float(1 << 62), 1.0)]
    return out


def test_ranks_and_medians_of_groups(spark, values):
    df = spark.createDataFrame(values, "g string, v double, w double")
    medians = {r["g"]: r["median"] for r in ranks.exact_medians(df, ["g"], "v").collect()}
    of = {g: np.array([v for x, v, _ in values if x == g and v is not None]) for g in {x[0] for x in values}}
    assert medians == {g: np.median(v) for g, v in of.items() if len(v)}
    assert ranks.exact_medians(df, [], "v").first()["median"] == np.median(np.concatenate(list(of.values())))
    found = {(r["g"], r["of_v"] + 0.0): r["r"] for r in ranks.average_ranks(df, "v", "r", ["g"]).collect()}
    for g, v in of.items():
        assert all(found[g, x + 0.0] == p for x, p in zip(v, places(v)))
    rho = {r["g"]: r["spearman"] for r in ranks.spearman(df, "v", "w", ["g"]).collect()}
    for g in ("a", "b", None):
        pairs = [(v, w) for x, v, w in values if x == g and v is not None]
        assert rho[g] == pytest.approx(np.corrcoef(places(np.array([p[0] for p in pairs])), places(np.array([p[1] for p in pairs])))[0, 1])
    assert rho["c"] == 0.0


def test_windows_are_bounded(spark):
    """However values are spread, a window holds those of one digit: here all are within one part in 2^20 of another."""
    n = 300_000
    df = spark.range(n).select((F.lit(1.0) + F.col("id") * F.lit(2.0**-40)).alias("v"))
    got = ranks.with_before(df.withColumn("n", F.lit(1).cast("long")), "v", "n")
    assert got.agg(F.count_if(F.col("before") != F.round((F.col("v") - 1) * 2.0**40)), F.count("*")).first()[:] == (0, n)
    c = df.select(ranks.ordered_bits("v").alias("c"))
    sizes = [c.groupBy(F.shiftright("c", k).alias("k")).agg(F.countDistinct(F.shiftright("c", max(0, k - ranks.DIGIT))).alias("n")).agg(F.max("n")).first()[0] for k in (ranks.TWO, ranks.DIGIT)]
    assert max(sizes) <= 1 << ranks.DIGIT
    assert ranks.exact_medians(df, [], "v").first()["median"] == 1 + (n - 1) / 2 * 2.0**-40


def test_large_moduli(spark):
    """Primes and strong pseudoprimes of up to 63 bits, in constant memory."""
    primes = [2, 3, 5, 7, 13, 28181, 2147483647, 2147352577, 1152921504606830593, 9223372036854775783, 67280421310721]
    others = [0, 1, -7, 4, 9, 2047, 1373653, 25326001, 3215031751, 2152302898747, 3474749660383, 341550071728321, 3825123056546413051, 9223372036854775807, 1152921504606830592, 4294967297, 561, 9746347772161]
    others += [325, 9375, 28178, 450775, 9780504, 1795265022]
    got = {r["n"]: r["p"] for r in spark.createDataFrame([(x,) for x in primes + others], "n long").select("n", validator.prime(F.col("n")).alias("p")).collect()}
    assert [n for n in primes if not got[n]] == [] and [n for n in others if got[n]] == []
    small = {r["id"]: r["p"] for r in spark.range(0, 2000).select("id", validator.prime(F.col("id")).alias("p")).collect()}
    assert all(small[n] == (n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))) for n in small)
