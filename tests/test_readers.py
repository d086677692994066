"""Files of the looser and the harmonised kinds, panels and synthetic workloads."""

import pytest
from pyspark.sql import functions as F

from alleleloom.functions import alleles
from alleleloom.operators import align, score
from alleleloom.sources import genotypes

from .test_files import VCF, WEIGHTS


@pytest.mark.parametrize("chrom", ["7", "chr7", "CHR7", " 7", None])
def test_chromosome_of_weights(spark, tmp_path, chrom):
    (tmp_path / "w.txt").write_text(WEIGHTS)
    rows, _ = genotypes.read_weights(spark, str(tmp_path / "w.txt"), chrom)
    outside = {r["line"] for r in rows.filter("reason = 'outside_target_chromosome'").collect()}
    assert outside == (set() if chrom is None else {8})
    assert rows.filter("reason is null").count() == (5 if chrom is None else 4)


def test_lines_are_numbered_in_order(spark, tmp_path):
    text = [f"line {k} " + "x" * (k % 50) for k in range(5000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.txt").write_text("\n".join(text[:1234]) + "\n")
    (tmp_path / "a" / "2.txt").write_text("\n".join(text[1234:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = genotypes.numbered_lines(spark, str(tmp_path / "a")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in sorted(got)] == text and [r["line"] for r in sorted(got)] == list(range(1, 5001))


def test_looser_weights(spark, tmp_path):
    (tmp_path / "w.txt").write_text("#x=1\nchr_name\tchr_position\trsID\teffect_allele\teffect_weight\nchr1\t5\trs\tat\t0.5\n1\tx\trs\tA\t1\n2\t6\t\tC\t1e-2\n1\t7\trs\t\t1\n")
    rows = genotypes.read_scoring_file(spark, str(tmp_path / "w.txt"))
    assert {tuple(r) for r in rows.select("chrom", "position", "effect_allele", "other_allele", "effect_weight").collect()} == {("1", 5, "AT", "", 0.5), ("2", 6, "C", "", 0.01)}
    assert genotypes.read_scoring_file(spark, str(tmp_path / "w.txt"), "chr2").count() == 1
    with pytest.raises(ValueError, match="no usable"):
        genotypes.read_scoring_file(spark, str(tmp_path / "w.txt"), "9")


def test_records_are_counted(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    wanted = spark.createDataFrame([("7", 3405), ("7", 4711), ("1", 1)], "chrom string, position long")
    assert genotypes.count_records(spark, str(tmp_path / "a.vcf")) == (4, 0)
    assert genotypes.count_records(spark, str(tmp_path / "a.vcf"), wanted) == (4, 2)
    genotypes.same_build("GRCh37", "grch37")
    genotypes.same_build(None, "GRCh37")
    with pytest.raises(ValueError, match="builds differ"):
        genotypes.same_build("GRCh37", "GRCh38")


def test_many_samples(spark, tmp_path):
    names = [f"s{k}" for k in range(3000)]
    (tmp_path / "a.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(names) + "\n1\t5\t.\tA\tC\t.\t.\t.\tGT\t" + "\t".join(f"{k % 2}/1" for k in range(3000)) + "\n")
    row = genotypes.read_vcf(spark, str(tmp_path / "a.vcf"), sample_ids=names[::-1]).first()
    assert row["samples"] == names[::-1] and row["alt_dosages"] == [1.0 + k % 2 for k in range(3000)][::-1]
    assert genotypes.read_vcf(spark, str(tmp_path / "a.vcf"), sample_ids=[]).first()["alt_dosages"] == []


def test_first_variants(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    rows = genotypes.read_vcf(spark, str(tmp_path / "a.vcf"), prefer_ds=False)
    assert [(r["rsid"], r["frequency"]) for r in genotypes.first_variants(rows, 2).collect()] == [("va", 0.75), ("vb", 0.25)]
    with pytest.raises(ValueError, match="2 found"):
        genotypes.first_variants(rows, 3)


def test_panel(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("sample\tpop\tsuper_pop\nb\tX\tE\na\tX\tE\nc\tY\tE\nb\tY\tF\na\tX\tF\n")
    panel = genotypes.read_panel(spark, str(tmp_path / "p.tsv"))
    assert [r["sample"] for r in genotypes.panel_samples(panel, 2).collect()] == ["b", "a"]
    assert [r["sample"] for r in genotypes.panel_samples(panel, 9, population="Y").collect()] == ["b", "c"]
    assert [r["sample"] for r in genotypes.panel_samples(panel, 9, super_population="F", population="X").collect()] == ["a"]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_harmonised_round_trip(spark, tmp_path, kind):
    """Dosages and weights that were written go together by place again: by hand the scores are 0.7 and 0.75."""
    dosages = [[0, 1, 2, 1, 0, 2], [2, 0, 1, 2, 1, 0]]
    weights = [(k, "22", 100 + k, f"rs{k}", "A", "G", "G", "ALT", w, "GT", False) for k, w in enumerate([0.1, -0.2, 0.05, 0.4, -0.3, 0.2])]
    d = spark.createDataFrame([(f"S{i}", k, float(x)) for i, row in enumerate(dosages) for k, x in enumerate(row)], "sample_id string, variant_ord int, effect_dosage double")
    w = spark.createDataFrame(weights, "variant_ord int, chrom string, position long, rsid string, ref string, alt string, effect_allele string, orientation string, effect_weight double, dosage_source string, strand_flipped boolean")
    gone = spark.createDataFrame([("22", 7, "missing_from_vcf")], "chrom string, position long, reason string")
    genotypes.write_harmonized(d.repartition(3), w.repartition(2), gone, str(tmp_path / "h"), kind="both", report=spark.createDataFrame([(6, 1)], "matched_variants long, missing_variants long"))
    assert spark.read.json(f"{tmp_path}/h/report.json").first()["matched_variants"] == 6
    back = genotypes.read_harmonized(spark, f"{tmp_path}/h/dosage.{kind}", f"{tmp_path}/h/weights.{kind}")
    assert {r["sample_id"]: round(r["score"], 9) for r in score.positional_scores(*back).collect()} == {"S0": 0.7, "S1": 0.75}
    assert spark.read.csv(f"{tmp_path}/h/exclusions.csv", header=True).count() == 1


def test_harmonised_faults(spark, tmp_path):
    (tmp_path / "d.csv").write_text("sample_id,v1,v2\nS1,0,1\nS2,1,1,2\n")
    (tmp_path / "w.csv").write_text("effect_weight\n0.1\n0.2\n")
    (tmp_path / "bad.csv").write_text("id,v1\nS1,0\n")
    with pytest.raises(Exception, match="differ in number"):
        genotypes.read_harmonized(spark, f"{tmp_path}/d.csv", f"{tmp_path}/w.csv")[0].collect()
    with pytest.raises(ValueError, match="sample_id"):
        genotypes.read_harmonized(spark, f"{tmp_path}/bad.csv", f"{tmp_path}/w.csv")
    with pytest.raises(ValueError, match="effect_weight"):
        genotypes.read_harmonized(spark, f"{tmp_path}/d.csv", f"{tmp_path}/d.csv")


def test_synthetic(spark):
    calls, weights = genotypes.synthetic(spark, 40, 30, missing_rate=0.2, sparsity=0.5, imputed=True, seed=3)
    again = genotypes.synthetic(spark, 40, 30, missing_rate=0.2, sparsity=0.5, imputed=True, seed=3)[0]
    rows = calls.collect()
    assert len(rows) == 1200 and sorted(map(tuple, rows), key=str) == sorted(map(tuple, again.repartition(7).collect()), key=str)
    known = [r["alt_dosage"] for r in rows if r["alt_dosage"] is not None]
    assert 0.7 < len(known) / 1200 < 0.9 and all(0 <= d <= 2 for d in known)
    zero = [r["effect_weight"] for r in weights.collect()].count(0.0)
    assert 5 < zero < 25


def test_labels_are_read_back(spark):
    bad = spark.createDataFrame([("22:x:A:C",)], "t string").select(alleles.of_label(F.col("t")).alias("v"))
    with pytest.raises(Exception, match="not a variant"):
        bad.collect()


def test_report_counts_everything(spark):
    v = spark.createDataFrame([("1", 5, 1, "A", "C"), ("1", 6, 2, "A", "T"), ("1", 9, 3, "A", "C")], "chrom string, position long, vrow long, ref string, alt string")
    w = spark.createDataFrame([("1", 5, 1, "C", "A"), ("1", 6, 2, "A", "T"), ("1", 7, 3, "C", "A")], "chrom string, position long, source_row long, effect_allele string, other_allele string")
    rejects = spark.createDataFrame([(8, "unsupported_weight_type"), (9, "outside_target_chromosome"), (10, "outside_target_chromosome")], "line long, reason string")
    rows = align.classify(w, v)
    got = align.full_report(rows, rejects, v, filtered=4).first().asDict()
    assert got["total_pgs_variants"] == 6 and got["matched_variants"] == got["alt_oriented_variants"] == 1 and got["strand_ambiguous_variants"] == got["missing_variants"] == got["unsupported_variants"] == 1
    assert got["vcf_only_variants"] == 5
    assert {tuple(r) for r in align.exclusions(rows, rejects).collect()} == {
        ("1", 6, "strand_ambiguous", 1), ("1", 7, "missing_from_vcf", 1), ("", 8, "unsupported_weight_type", 1), ("", 9, "outside_target_chromosome", 2),
    }
