"""What shows on large tables alone, on small ones made for it."""

import math

import duckdb
import numpy as np
import pytest

from alleleloom import catalogue
from alleleloom.functions import slots
from alleleloom.llm import toxicity
from alleleloom.operators import cost_models, score
from alleleloom.plans import validator

CALLED = [
    "case_control_counts", "error_metrics", "missing_exclude", "missing_mean", "missing_zero", "prs_block_sums", "prs_fixed", "prs_float_round6", "prs_mod_p_centered", "prs_multi_score",
    "prs_site_sums", "prs_windowed_add_then_reduce", "prs_windowed_reduce_then_add", "score_summary_pop", "workload_features", "phenotype_upper_median",
]


def rows_of_sql(path, name, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    want = db.execute(catalogue.ORACLES[name])
    return [c[0] for c in want.description], sorted(want.fetchall(), key=str)


@pytest.fixture(scope="module")
def million(spark, tmp_path_factory):
    """Parts with keys of a million and more, whose genotypes have numbers that duplicates of other parts' genotypes have as well."""
    path = tmp_path_factory.mktemp("million")
    keys = [k for k in range(0, 300) if k % 71 == 5 or k % 9 == 0] + [1_000_000 + k for k in range(0, 300) if k % 71 == 5 or k % 7 == 0]
    spark.createDataFrame([(k, 1 + 3 * (k % 5), 900.0 + k % 1009 / 10) for k in keys], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(c, c % 25) for c in range(12)], "c_custkey long, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(o, o % 12) for o in range(48)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(i % 48, keys[i * i % len(keys)]) for i in range(600)] + [(i % 48, k) for i, k in enumerate(keys)], "l_orderkey long, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("name", CALLED)
def test_calls_of_all_genotypes_of_a_number(spark, million, name):
    columns, want = rows_of_sql(million, name, ("part", "customer", "orders", "lineitem"))
    assert want and sorted(map(tuple, catalogue.QUERIES[name](spark, million).select(*columns).collect()), key=str) == want
    again = catalogue.QUERIES.get(f"{name}_all_samples")
    assert again is catalogue.QUERIES[name]


def test_exact_sums_in_one_pass(spark):
    data = [(None, 0.1), (None, 0.2), (1, 1e300), (1, 0.1), (1, -1e300), (1, 5e-324), (2, None), (3, 2.0**1023), (3, -1.0), (4, -5e-324)] + [(5, k / 10000) for k in range(-300, 900)]
    sums = score.exact_sums(spark.createDataFrame(data, "k long, x double"), ["k"], "x")
    of = {k: [x for i, x in data if i == k and x is not None] for k, _ in data}
    assert {r["k"]: r["x"] for r in sums.collect()} == {k: math.fsum(x) for k, x in of.items()}
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan and "Generate" not in plan


def test_embedding_dot_in_single_precision(spark, tmp_path):
    near = [float(x) for x in np.round(np.arange(1, 400) / 1000 + 0.0005, 4).astype(np.float32)]  # next to halves
    assert any(np.float32(x) * np.float32(1000) % 1 == 0.5 != x * 1000 % 1 for x in near)
    vectors = [near[k : k + 8] for k in range(0, len(near), 8)] + [[], None, [None, 1.0, None], [None], [3e6, 2.5e7, 1e9]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    columns, want = rows_of_sql(tmp_path, "embedding_dot", ("embeddings",))
    assert sorted(map(tuple, catalogue.embedding_dot(spark, str(tmp_path)).select(*columns).collect()), key=str) == want


def test_positional_scores_in_single_precision(spark, tmp_path):
    near = [float(x) for x in np.round(np.arange(1, 400) / 1000 + 0.0005, 4).astype(np.float32)]  # next to halves
    vectors = [[sign * x for x in near[k : k + 8]] for sign in (1, -1) for k in range(0, len(near), 8)] + [[], None, [None, 1.0, None], [None], [3e6, 2.5e7, 1e9]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    columns, want = rows_of_sql(tmp_path, "positional_scores", ("embeddings",))
    assert sorted(map(tuple, catalogue.QUERIES["positional_scores"](spark, str(tmp_path)).select(*columns).collect()), key=str) == want


def test_text_values_of_events_without_type(spark, tmp_path):
    rows = [(k, t) for k in [*range(-30, 40), None, 999_999, 5_999_999, (1 << 53) + 1, (1 << 63) - 1] for t in ("view", "click", "View", "", None)]
    spark.createDataFrame(rows, "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    columns, want = rows_of_sql(tmp_path, "text_values", ("events",))
    assert sorted(map(tuple, catalogue.QUERIES["text_values"](spark, str(tmp_path)).select(*columns).collect()), key=str) == want


def test_chunk_rows_deal_out_long_rows(spark, monkeypatch):
    monkeypatch.setattr(slots, "RUN", 16)
    monkeypatch.setattr(slots, "EACH", 100)
    parts = [(1, 1000, 1), (2, 7, 50), (3, 0, 1), (4, 160, 10), (5, 161, 10), (6, 333, 2)]
    out = slots.chunk_rows(spark.createDataFrame(parts, "k long, items long, width int").coalesce(1), "items", "width", ["k"])
    assert sorted(map(tuple, out.collect())) == sorted((k, lo, min(lo + w, n)) for k, n, w in parts for lo in range(0, n, w))
    assert out.rdd.getNumPartitions() == 13 and max(map(len, out.rdd.glom().collect())) < 300


def test_canonical_records_have_groups_kinds_and_sizes(spark):
    rows = catalogue.records_canonicalize(spark, "/root/testdata/sf0.001").select("workload_group", "measurement_kind", "ciphertext_bytes").collect()
    assert len({r[0] for r in rows}) > 1 and {r[1] for r in rows} == {"measured", "failed"} and min(r[2] for r in rows) == 1


def test_best_plans_without_order(spark):
    kinds = "w string, id long, issues array<string>, evaluation_seconds double, total_seconds double, peak_memory_mb double, ciphertext_bytes double, key_bytes double, max_absolute_error double, max_relative_error double, success_probability double, feasible_probability double"
    plans = [("a", k, ["x"] if k % 3 == 0 else [], None if k % 4 == 0 else float(k % 5), 1.0, float(k % 7), 2.0, None, 0.1, 0.1, 1.0, None) for k in range(40)] + [("b", 99, ["x"], *[1.0] * 9), (None, 7, [], *[None] * 9)]
    rows, most = spark.createDataFrame(plans, kinds), {"peak_memory_mb": 5.0}
    want = validator.ranked_by_objectives(rows, most, ["w"], "id").filter("rank = 1 and size(reasons) = 0").select("w", "objective", "id", "score").collect()
    best = validator.best_by_objectives(rows, most, ["w"], "id")
    assert want and sorted(map(tuple, best.collect()), key=str) == sorted(map(tuple, want), key=str)
    assert "Window" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_measures_read_the_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    data = [("s", "t", float(k % 7), float(k % 5 + 0.5)) for k in range(200)] + [("s", "u", 0.0, 1.0), ("s", "u", 0.0, 3.0)]
    rows = spark.createDataFrame(data, "split string, target string, actual double, predicted double").mapInArrow(counted, "split string, target string, actual double, predicted double")
    got = {r["target"]: r for r in cost_models.regression_measures(rows, ["split", "target"]).collect()}
    assert read.value == len(data)
    a, p = (np.array(x) for x in zip(*[(r[2], r[3]) for r in data[:200]]))
    t, u = got["t"], got["u"]
    want = [200, np.abs(p - a).mean(), np.sqrt(((p - a) ** 2).mean()), np.abs((p - a)[a != 0] / a[a != 0]).mean(), 1 - ((p - a) ** 2).sum() / ((a - a.mean()) ** 2).sum()]
    assert [t[c] for c in ("n", "mae", "rmse", "mape", "r2")] == pytest.approx(want)
    assert (u["n"], u["mae"], u["mape"], u["r2"], u["spearman"]) == (2, 2.0, 0.0, 0.0, 0.0)


def test_toxicity_lays_out_texts_in_parts(monkeypatch):
    sizes, laid = [], toxicity.laid_out
    monkeypatch.setattr(toxicity, "STEPS", 1)
    monkeypatch.setattr(toxicity, "laid_out", lambda texts: sizes.append(sum(map(len, texts))) or laid(texts))
    texts = [b"some words %d and others " % k * 4000 + b"awful" * (k % 2) for k in range(60)]
    toxicity.fit(texts, np.arange(60) % 2 * 1.0)
    assert max(sizes) < sum(map(len, texts)) / 2


def test_chunk_rows_are_small_when_written(spark, tmp_path):
    parts = [(k, 20_000 + 7 * k % 90, 10 + k % 3) for k in range(600)]
    out = slots.chunk_rows(spark.createDataFrame(parts, "k long, items long, width int").coalesce(1), "items", "width", ["k"])
    out.write.parquet(f"{tmp_path}/out")
    rows = sum(-(-n // w) for _, n, w in parts)
    assert spark.read.parquet(f"{tmp_path}/out").count() == rows and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < rows / 2


@pytest.mark.parametrize("starts", [2, 1 << 16])
def test_chunk_rows_of_lists(spark, monkeypatch, starts):
    monkeypatch.setattr(slots, "STARTS", starts)
    monkeypatch.setattr(slots, "TOGETHER", 4)
    monkeypatch.setattr(slots, "RUN", 10)
    parts = [(k, k * k % 61, 1 + k % 4) for k in range(60)] + [(60, None, 4), (61, 5, None), (62, -3, 2), (63, 4000, 3), (63, 4000, 3), (None, 4000, 3)]
    out = slots.chunk_rows(spark.createDataFrame(parts, "k long, items long, width int"), "items", "width", ["k"])
    want = [(k, lo, min(lo + w, n)) for k, n, w in parts if n and w for lo in range(0, n, w)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
