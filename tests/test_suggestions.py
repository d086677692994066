"""Suggestions against a Gaussian process of all measurements one by one; selections and what becomes of failures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alleleloom.plans import suggestions


def test_suggestions_agree_with_all_measurements(spark):
    """Measurements reduced by vector give what a matrix over all of them gives."""
    r = random.Random(2)
    plans = [(w, k, [float(r.randint(0, 2)), float(r.randint(10, 12)), r.choice([0.5, 0.75])]) for w in ("a", "b", None) for k in range(40)]
    tried = [(w, k, 5 + v[0] + math.sin(v[1]) + r.gauss(0, 0.01)) for w, k, v in plans if w != "b" and k % 3 for _ in range(r.randint(1, 3))]
    tried += [("a", 0, None), ("a", 3, float("nan"))]
    made = spark.createDataFrame(plans, "w string, k long, x array<double>").repartition(3)
    got = suggestions.suggested(made, spark.createDataFrame(tried, "w string, k long, value double"), ["w"], "k", F.col("x"), noise=0.01)
    rows = {(x["w"], x["k"]): x for x in got.collect()}
    assert rows.keys() == {(w, k) for w, k, _ in plans} - {(w, k) for w, k, _ in tried}
    for w in ("a", None):
        vectors = {k: np.array(v) for x, k, v in plans if x == w}
        seen = [(vectors[k], v) for x, k, v in tried if x == w and v is not None and v == v]
        x, y = np.array([s[0] for s in seen]), np.array([s[1] for s in seen])
        kern = lambda a, b: np.exp(-((a - b) ** 2).sum() / (2 * 1.5**2))
        gram = np.array([[kern(a, b) for b in x] for a in x]) + 0.01 * np.eye(len(x))
        order = []
        for k in (k for v, k in rows if v == w):
            c = np.array([kern(vectors[k], b) for b in x])
            mean, sd = c @ np.linalg.solve(gram, y), math.sqrt(max(1e-12, 1 - c @ np.linalg.solve(gram, c)))
            z = (y.min() - mean) / sd
            gain = max(0.0, (y.min() - mean) * 0.5 * (1 + math.erf(z / math.sqrt(2))) + sd * math.exp(-z * z / 2) / math.sqrt(2 * math.pi))
            assert [rows[w, k][n] for n in ("mean", "deviation", "improvement")] == pytest.approx([mean, sd, gain], abs=1e-6)
            order.append((-round(rows[w, k]["improvement"], 9), round(rows[w, k]["mean"], 9), k))
        assert [k for *_, k in sorted(order)] == [k for _, k in sorted((rows[w, k]["place"], k) for v, k in rows if v == w)]
    assert all((x["mean"], x["deviation"], x["improvement"]) == (0, 1, 1) for (w, _), x in rows.items() if w == "b")


METRICS = ["evaluation_seconds", "total_seconds", "peak_memory_mb", "ciphertext_bytes", "key_bytes", "max_absolute_error"]


def test_selection_statuses(spark):
    """The best measured plan, also one beyond the first; the first predicted one where all measurements fail; none where nothing is feasible."""
    ranked = [("a", "memory", k, [], float(k), k + 1) for k in range(5)] + [("b", "memory", k, [], float(k), k + 1) for k in range(2)] + [("c", "memory", 1, ["x"], None, 1)]
    ranked = spark.createDataFrame(ranked, "w string, objective string, k int, reasons array<string>, score double, rank int")
    metrics = lambda m: [1.0, 1.0, m, 1.0, None, 1.0]
    tried = [("a", 0, "ok", *metrics(9.0)), ("a", 1, "failed", *[None] * 6), ("a", 4, "ok", *metrics(3.0)), ("b", 0, "failed", *[None] * 6), ("b", 7, "ok", *metrics(0.0))]
    tried = spark.createDataFrame(tried, "w string, k int, status string, " + ", ".join(f"{m} double" for m in METRICS))
    got = {r["w"]: tuple(r)[2:] for r in suggestions.selected(ranked, tried, ["w"], "k", top_k=2).collect()}
    assert got == {"a": ("measured_and_validated", 4, 3.0, 2, 1, 1), "b": ("predicted_only_no_successful_actual_validation", 0, None, 2, 1, 0), "c": ("no_feasible_candidate", None, None, 0, 0, 0)}
    rows = {(r["w"], r["k"]): (r["phase"], r["pairing"], r["residual"]) for r in suggestions.compared(ranked, tried, ["w"], "k", 2).collect()}
    assert rows["a", 0] == ("top_k_actual_validation", "paired", 9.0) and rows["a", 1][1] == "unavailable_failed_measurement"
    assert rows["a", 4] == ("bayesian_refinement", "paired", -1.0) and rows["b", 1][1] == "not_measured" and ("a", 2) not in rows
    with pytest.raises(ValueError):
        suggestions.selected(ranked, tried, ["w"], "k", top_k=0)
