"""Small files whose results are known."""

import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from alleleloom.functions import alleles, slots
from alleleloom.operators import align, cohort, score
from alleleloom.plans import space, validator
from alleleloom.sources import genotypes
from alleleloom.streaming import hourly

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tP\tQ
7\t2210\tva\tC\tT\t.\t.\t.\tGT:DS\t0/1:1.1\t1/1:1.9
chr7\t3405\tvb\tG\tA\t.\t.\t.\tGT\t0/1\t0/0
7\t4711\tvc\tT\tC\t.\t.\t.\tGT\t0/0\t./.
7\t5290\tvd\tA\tG,T\t.\t.\t.\tGT\t1/1\t0/1
7\tbrief
"""
WEIGHTS = """#pgs_id=Y
#HmPOS_build=GRCh38
chr_name\tchr_position\trsID\teffect_allele\tother_allele\teffect_weight
7\t2210\tva\tT\tC\t0.5
7\t3405\tvb\tG\tA\t0.2
7\t4711\tvc\tC\tT\t-0.4
7\t8000\tvz\tA\tC\t1
5\t11\tv\tA\tC\t2
7\tq\tv\tA\tC\t2
7\t12\tv\tGC\tA\t2
7\t13\tv\tA\tC\tinf
7\t14\tv\t\tC\t3
"""


def test_golden_scores(spark, tmp_path):
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write(VCF)
    (tmp_path / "w.txt").write_text(WEIGHTS)
    weights, metadata = genotypes.read_weights(spark, str(tmp_path / "w.txt"), chrom="7")
    assert metadata == {"pgs_id": "Y", "HmPOS_build": "GRCh38"}
    reasons = [r["reason"] for r in weights.orderBy("line").collect()]
    assert reasons == [None] * 4 + ["outside_target_chromosome", "invalid_numeric_value", "multiallelic_or_haplotype", "invalid_numeric_value", "incomplete_variant"]
    weights = weights.filter("reason is null").drop("reason").withColumnRenamed("line", "source_row").withColumn("w_int", F.round(F.col("effect_weight") * 10).cast("long"))
    vcf = genotypes.read_vcf(spark, str(tmp_path / "a.vcf.gz"))
    assert [r["dosage_source"] for r in vcf.orderBy("line").collect()] == ["DS", "GT", "GT", "unsupported_multiallelic"]
    assert genotypes.read_vcf(spark, str(tmp_path / "a.vcf.gz"), wanted=weights).count() == 3
    variants = vcf.withColumnRenamed("line", "vrow")
    got = align.classify(weights, variants.select("chrom", "position", "vrow", "ref", "alt"))
    assert {r["reason"]: (r["n"], r["n_alt"]) for r in align.report(got).collect()} == {"ok": (3, 2), "missing_from_vcf": (1, 0)}
    calls = variants.select("vrow", F.explode(F.arrays_zip("samples", "alt_dosages")).alias("c")).select("vrow", F.col("c.samples").alias("sample_id"), F.col("c.alt_dosages").alias("alt_dosage"))
    rows = score.effect_calls(got.filter("reason = 'ok'"), calls)
    zero = score.fill_missing(rows, "zero").groupBy("sample_id").agg(F.sum(F.col("effect_dosage") * F.col("w_int") / 10).alias("s"))
    assert {r["sample_id"]: round(r["s"], 6) for r in zero.collect()} == {"P": 0.75, "Q": 1.35}
    assert score.fill_missing(rows, "exclude_variant").count() == 4
    with pytest.raises(Exception, match="missing genotype"):
        score.fill_missing(rows, "error").collect()


def test_samples_are_chosen(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    got = genotypes.read_vcf(spark, str(tmp_path / "a.vcf"), sample_ids=["Q"]).orderBy("line").collect()
    assert [r["alt_dosages"] for r in got] == [[1.9], [0.0], [None], [None]]
    with pytest.raises(ValueError, match="no such"):
        genotypes.read_vcf(spark, str(tmp_path / "a.vcf"), sample_ids=["R"])


def test_dosage_matrix_and_strands(spark, tmp_path):
    (tmp_path / "m.csv").write_text("sample_id,22:100:A:C,22:101:A:T:rs2\nS1,1,2\nS2,NA,2.5\n")
    cells = genotypes.read_dosage_matrix(spark, str(tmp_path / "m.csv"))
    assert {(r["sample_id"], r["position"]): r["alt_dosage"] for r in cells.collect()} == {("S1", 100): 1.0, ("S1", 101): 2.0, ("S2", 100): None, ("S2", 101): None}
    variants = cells.select("chrom", "position", "ref", "alt").distinct().withColumn("vrow", F.col("position"))
    weights = spark.createDataFrame([("22", 100, 1, "G", "T", 2), ("22", 101, 2, "T", "A", 1)], "chrom string, position long, source_row long, effect_allele string, other_allele string, w_int long")
    got = {r["position"]: (r["reason"], r["flipped"]) for r in align.classify(weights, variants).collect()}
    assert got == {100: ("ok", True), 101: ("strand_ambiguous", None)}
    spark.createDataFrame([("S1", 1.0, 2.0), ("S2", None, 2.5)], "sample_id string, `22:100:A:C` double, `22:101:A:T:rs2` double").write.parquet(f"{tmp_path}/m.parquet")
    assert sorted(map(tuple, genotypes.read_dosage_matrix(spark, f"{tmp_path}/m.parquet").collect()), key=str) == sorted(map(tuple, cells.collect()), key=str)
    (tmp_path / "bad.csv").write_text("id,22:1:A:C\n")
    with pytest.raises(ValueError, match="sample_id"):
        genotypes.read_dosage_matrix(spark, str(tmp_path / "bad.csv"))


def test_slots(spark):
    row = spark.range(1).select(
        slots.chunk_ranges(F.lit(9), F.lit(4)).alias("c"), slots.chunk_ranges(F.lit(0), F.lit(4)).alias("none"), slots.padding_mask(F.lit(2), F.lit(4)).alias("m"),
        slots.rotations(F.lit(5)).alias("r"), slots.rotations(F.lit(1)).alias("r1"),
        alleles.centered(F.lit(9), 11).alias("x"), alleles.quantized(F.lit(0.25), 10).alias("q"),
    ).first()
    assert [tuple(c) for c in row["c"]] == [(0, 4), (4, 8), (8, 9)] and row["none"] == []
    assert (row["m"], row["r"], row["r1"], row["x"], row["q"]) == ([1, 1, 0, 0], [1, 2, 4], [], -2, 2)


def test_issues_of_candidates(spark):
    work = spark.createDataFrame([("w", 4, 1000, 30.0)], "workload string, samples long, variants long, bound double")
    plans = space.whole_plans(work, {"scheme": ["BGV"], "ring": [8192], "width": [512], "fixed_scale": [10**9], "modulus": [2_147_352_577, 15]})
    rows = validator.with_primes(plans).withColumn("issues", validator.issues(F.col("samples"), F.col("variants"), 0.0, 2.0, F.col("bound")))
    got = {r["modulus"]: r["issues"] for r in rows.collect()}
    assert got[2_147_352_577] == ["bgv_ring_dimension_below_openfhe_minimum", "fixed_point_wraparound"]
    assert "plaintext_modulus_not_prime" in got[15]


def test_errors(spark):
    pairs = spark.createDataFrame([(1.0, 1.1), (0.0, 0.0)], "a double, b double")
    assert cohort.errors(pairs, "a", "b").first()["max_abs"] == pytest.approx(0.1)


def test_record_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, {"x": 1})], "b string, a long, plan map<string,int>")
    for kind in ("jsonl", "csv", "parquet"):
        genotypes.write_records(rows, f"{tmp_path}/r.{kind}")
        back = genotypes.read_records(spark, f"{tmp_path}/r.{kind}")
        assert back.columns == ["a", "b", "plan"] and back.count() == 1
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.jsonl").write_text('{"a": 1}\n{"c": 2}\n')
    assert genotypes.read_record_folder(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        genotypes.read_records(spark, "x.xml")


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_json_is_a_list_or_an_object(spark, tmp_path, n):
    rows = spark.range(n).select("id", F.struct(F.col("id").alias("x")).alias("plan"), F.concat(F.lit('a"\n'), F.col("id").cast("string")).alias("b")).repartition(3)
    genotypes.write_records(rows, f"{tmp_path}/r.json")
    (part,) = (tmp_path / "r.json").glob("part-*")
    found = json.loads(part.read_text())
    assert isinstance(found, dict if n == 1 else list)
    found = [found] if n == 1 else found
    assert sorted(x["id"] for x in found) == list(range(n)) and all(x["plan"] == {"x": x["id"]} and list(x) == ["b", "id", "plan"] for x in found)
    if n:
        assert genotypes.read_records(spark, f"{tmp_path}/r.json").count() == n


def test_parquet_has_numbers_for_texts_of_numbers(spark, tmp_path):
    rows = spark.createDataFrame([("1", "1.5", "x", "", {"k": 1}), ("", "2", "3", None, None), (None, " 7 ", "4", "", None)], "a string, b string, c string, d string, e map<string,int>")
    genotypes.write_records(rows, f"{tmp_path}/r.parquet")
    back = spark.read.parquet(f"{tmp_path}/r.parquet")
    assert dict(back.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "string", "e": "string"}
    assert sorted((tuple(r) for r in back.select("a", "b", "c").collect()), key=str) == sorted([(1, 1.5, "x"), (None, 2.0, "3"), (None, 7.0, "4")], key=str)


def test_null_dosages_stay_in_their_columns(spark, tmp_path):
    cells = spark.createDataFrame([("S", 0, None), ("S", 1, 1.0), ("T", 0, 0.5), ("T", 1, None)], "sample_id string, variant_ord int, effect_dosage double")
    weights = spark.createDataFrame([(k, "1", 5 + k, "r", "A", "C", "C", "ALT", 0.5, "GT", False) for k in range(2)], "variant_ord int, chrom string, position long, rsid string, ref string, alt string, effect_allele string, orientation string, effect_weight double, dosage_source string, strand_flipped boolean")
    genotypes.write_harmonized(cells, weights, weights.select("chrom", "position"), f"{tmp_path}/out")
    back, _ = genotypes.read_harmonized(spark, f"{tmp_path}/out/dosage.csv", f"{tmp_path}/out/weights.csv")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, cells.collect()), key=str)


def test_exact_sums(spark):
    r = random.Random(4)
    groups = {0: [1e16, 1.0, -1e16], 1: [0.1] * 10, 2: [r.uniform(-1, 1) * 10 ** r.randint(-30, 30) for _ in range(500)], 3: [1e308, -1e308, 5e-324], 4: [0.0, -0.0], 5: [None], 6: [2.0**1023, 2.0**-1074]}
    rows = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k int, x double").repartition(3)
    got = {row["k"]: row["x"] for row in score.exact_sums(rows, ["k"], "x").collect()}
    assert got == {k: math.fsum(x for x in v if x is not None) for k, v in groups.items()}


def test_decimal_places(spark):
    got = spark.createDataFrame([(0.1,), (1.0,), (-0.1234567,), (1 / 3,)], "x double").select(score.decimal_places("x")).collect()
    assert [r[0] for r in got] == [1, 0, 7, 15]


def test_stream_counts_like_a_batch(spark, tmp_path):
    rows = spark.sql("select 'CKKS' as scheme, timestamp '2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id) as ts from range(200)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = hourly.counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), late="10 minutes")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, hourly.counts(rows).collect()))


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 3, 3], [-(2**63), 2**63 - 1, 0, 7, 7], list(range(-50, 20000, 7)), [1] * 5000 + [2] * 5000, [1] * 5001 + [2] * 4999])
def test_upper_median(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "x long").repartition(3)
    assert cohort.upper_median(rows, "x").first()[0] == sorted(values)[len(values) // 2]
    assert cohort.upper_median(rows.filter("false"), "x").count() == 0


def test_frontier(spark):
    r = random.Random(3)
    points = [(k, float(r.randint(0, 9)), float(r.randint(0, 9)), r.choice([1.0, 2.0, None])) for k in range(300)]
    full = [p for p in points if p[3] is not None]
    want = {p[0] for p in full if not any(all(q[i] <= p[i] for i in (1, 2, 3)) and q[1:] != p[1:] for q in full)}
    got = space.frontier(spark.createDataFrame(points, "k int, a double, b double, c double").repartition(5), ["a", "b", "c"])
    assert {row["k"] for row in got.collect()} == want


def test_synthetic_cohort(spark):
    calls, weights, people = genotypes.synthetic_cohort(spark, 21, 200, informative=0.1)
    w = {r["vrow"]: r["effect_weight"] for r in weights.collect()}
    assert len(w) == 200 and sum(x != 0 for x in w.values()) == 20
    scores = dict.fromkeys(range(21), 0.0)
    for r in calls.collect():
        scores[r["sample_id"]] += r["alt_dosage"] * w[r["vrow"]]
    got = {r["sample_id"]: (r["score"], r["phenotype"]) for r in people.collect()}
    assert {k: s for k, (s, _) in got.items()} == pytest.approx(scores)
    middle = sorted(s for s, _ in got.values())[10]
    assert all(p == (s >= middle) for s, p in got.values())
    assert [tuple(r) for r in people.orderBy("sample_id").collect()] == [tuple(r) for r in genotypes.synthetic_cohort(spark, 21, 200, informative=0.1)[2].orderBy("sample_id").collect()]
    with pytest.raises(ValueError, match="informative"):
        genotypes.synthetic_cohort(spark, 3, 3, informative=0)
