"""Alignment of weights with genotypes: one reason for each weight, and what is scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alleles

KEY = ["chrom", "position"]


def classify(weights: DataFrame, genotypes: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """Each weight with its genotype's row, ``reason``, ``side`` (ALT or REF) and ``flipped``.

    The genotypes are counted to one row per key first, so the join never multiplies weights. The first of the
    reasons in this order holds: all copies of a repeated weight go, then weights without genotype, with
    several, with several ALT alleles, ambiguous strands, other alleles, and missing calls (``incomplete``
    holds the vrow of variants with any).
    """
    weights = weights.withColumn("n_weights", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    one = genotypes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_genotypes"), F.min_by(F.struct("vrow", "ref", "alt"), "vrow").alias("v"))
    one = one.select(*[F.col(k).alias(f"v_{k}") for k in KEY], "n_genotypes", "v.*")
    rows = weights.join(one, (F.col("chrom") == F.col("v_chrom")) & (F.col("position") == F.col("v_position")), "left").drop("v_chrom", "v_position")
    if incomplete is None:
        rows = rows.withColumn("gap", F.lit(False))
    else:
        rows = rows.join(incomplete.select(F.col("vrow").alias("gap_row")), F.col("vrow") == F.col("gap_row"), "left")
        rows = rows.withColumn("gap", F.col("gap_row").isNotNull()).drop("gap_row")
    side, flipped = alleles.orientation(F.col("ref"), F.col("alt"), F.col("effect_allele"), F.col("other_allele"))
    reason = (
        F.when(F.col("n_weights") > 1, "duplicate_pgs_variant")
        .when(F.col("n_genotypes").isNull(), "missing_from_vcf")
        .when(F.col("n_genotypes") > 1, "duplicate_vcf_variant")
        .when(F.col("alt").contains(","), "multiallelic_variant")
        .when(alleles.strand_ambiguous(F.col("ref"), F.col("alt")), "strand_ambiguous")
        .when(side.isNull(), "allele_mismatch")
        .when(F.col("gap"), "missing_genotype")
        .otherwise("ok")
    )
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason") == "ok"
    return rows.withColumns({"side": F.when(ok, side), "flipped": F.when(ok, flipped)}).drop("gap")


def report(classified: DataFrame) -> DataFrame:
    """Rows of each reason, and of those scored how many are ALT and how many flipped."""
    return classified.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "ALT").alias("n_alt"), F.count_if("flipped").alias("n_flipped")
    )


def unused_genotypes(classified: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Keys of genotypes that no weight used: a weight uses a key if it is the only one there and so is the genotype."""
    used = classified.filter((F.col("n_weights") == 1) & (F.col("n_genotypes") == 1)).select(*KEY)
    return genotypes.select(*KEY).distinct().join(used, KEY, "left_anti")


def wanted_genotypes(genotypes: DataFrame, weights: DataFrame) -> DataFrame:
    """The genotypes at the weights' keys: what a scan has to read at all."""
    return genotypes.join(weights.select(*KEY).distinct(), KEY, "left_semi")


def incomplete(calls: DataFrame) -> DataFrame:
    """vrow of the variants with a missing call."""
    return calls.groupBy("vrow").agg(F.bool_or(F.col("alt_dosage").isNull()).alias("gap")).filter("gap").select("vrow")


def full_report(classified: DataFrame, rejects: DataFrame, genotypes: DataFrame, filtered: int = 0) -> DataFrame:
    """One row of all counters of an alignment. ``rejects`` (reason) are weights that weren't usable, ``filtered`` genotypes that weren't read."""
    none = F.lit(None)
    rows = classified.select("reason", "side", "flipped").unionByName(rejects.select("reason", none.cast("string").alias("side"), none.cast("boolean").alias("flipped")))
    unused = unused_genotypes(classified, genotypes).select(F.lit("unused").alias("reason"), none.cast("string").alias("side"), none.cast("boolean").alias("flipped"))
    reason = F.col("reason")
    count = lambda *names: F.count_if(reason.isin(*names))
    return rows.unionByName(unused).agg(
        F.count_if(reason != "unused").alias("total_pgs_variants"), count("ok").alias("matched_variants"), F.count_if(F.col("side") == "ALT").alias("alt_oriented_variants"),
        F.count_if(F.col("side") == "REF").alias("ref_oriented_variants"), count("strand_ambiguous").alias("strand_ambiguous_variants"), F.count_if("flipped").alias("strand_flipped_variants"),
        count("multiallelic_variant", "multiallelic_or_haplotype").alias("multiallelic_exclusions"), count("missing_from_vcf", "missing_genotype").alias("missing_variants"),
        count("duplicate_pgs_variant", "duplicate_vcf_variant").alias("duplicate_variants"),
        F.count_if(reason.startswith("unsupported") | (reason == "incomplete_variant")).alias("unsupported_variants"), count("ok").alias("final_scored_variants"),
        (count("unused") + filtered).alias("vcf_only_variants"),
    )


def exclusions(classified: DataFrame, rejects: DataFrame) -> DataFrame:
    """(chrom, position, reason, n): each weight that isn't scored, and each reject under no chromosome with its row in the file as position.

    Rejects of other chromosomes are one row, the first, with their number as ``n``.
    """
    outside = F.col("reason") == "outside_target_chromosome"
    own = classified.filter("reason <> 'ok'").select("chrom", "position", "reason", F.lit(1).cast("long").alias("n"))
    each = rejects.groupBy(F.when(outside, F.lit(-1)).otherwise(F.col("line")).alias("key"), "reason").agg(F.min("line").alias("position"), F.count(F.lit(1)).alias("n"))
    return own.unionByName(each.select(F.lit("").alias("chrom"), "position", "reason", "n"))
