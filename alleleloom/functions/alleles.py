"""Columns for alleles, genotypes and dosages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that a missing dosage is written as.
MISSING = ["", ".", "NA", "NaN", "nan"]
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def chromosome(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), "^(?i)chr", "")


def chromosome_as_is(name: Column) -> Column:
    """Without a leading chr in small letters, and otherwise as it is."""
    return F.regexp_replace(name, "^chr", "")


def single_bases(ref: Column, alt: Column) -> Column:
    """Whether both alleles are one character."""
    return (F.length(ref) == 1) & (F.length(alt) == 1) & (alt != ",")


def label(chrom: Column, position: Column, ref: Column, alt: Column, rsid: Column) -> Column:
    """chrom:position:ref:alt:rsid; a missing or empty id is a dot."""
    return F.concat_ws(":", chrom, position.cast("string"), ref, alt, F.coalesce(F.nullif(rsid, F.lit("")), F.lit(".")))


def of_label(text: Column) -> Column:
    """The parts of chrom:position:ref:alt with or without an id, as a struct; an error for anything else."""
    k = F.split(text, ":")
    fine = F.size(k).isin(4, 5) & F.get(k, F.lit(1)).try_cast("long").isNotNull()
    parts = F.struct(
        F.regexp_replace(k[0], "^(?i)chr", "").alias("chrom"), F.get(k, F.lit(1)).try_cast("long").alias("position"), F.upper(F.get(k, F.lit(2))).alias("ref"),
        F.upper(F.get(k, F.lit(3))).alias("alt"), F.coalesce(F.get(k, F.lit(4)), F.lit(".")).alias("rsid"),
    )
    return F.when(fine, parts).otherwise(F.raise_error(F.concat(F.lit("not a variant: "), text)).cast("struct<chrom:string,position:bigint,ref:string,alt:string,rsid:string>"))


def preferred_rsid(genotype: Column, weight: Column) -> Column:
    """The genotype's id unless it is a dot."""
    return F.when(genotype != ".", genotype).otherwise(weight)


def near_whole(dosage: Column) -> Column:
    whole = F.bround(dosage)
    return F.abs(dosage - whole) <= 1e-9 * F.greatest(F.abs(dosage), F.abs(whole))


def hard_call(dosage: Column) -> Column:
    """Whether a dosage is 0, 1 or 2, but for rounding."""
    return near_whole(dosage) & F.bround(dosage).isin(0, 1, 2)


def imputed(dosage: Column) -> Column:
    """Whether a dosage isn't a whole number, but for rounding."""
    return ~near_whole(dosage)


def number(text: Column) -> Column:
    """A finite number, or null: only plain decimal notation counts."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def dosage(value: Column) -> Column:
    """A dosage in [0, 2], or null."""
    return F.when(value.between(0, 2), value)


def gt_dosage(gt: Column) -> Column:
    """Number of ALT alleles of a diploid call like 0/1 or 1|1; null if anything is missing or another allele."""
    return F.when(gt.rlike(r"^[01][/|][01]$"), F.length(F.regexp_replace(gt, "[^1]", "")).cast("double"))


def any_ploidy_dosage(gt: Column) -> Column:
    """Number of ALT alleles of a call of any ploidy whose alleles are all 0 or 1."""
    return F.when(gt.rlike(r"^[01]([/|][01])*$"), F.length(F.regexp_replace(gt, "[^1]", "")).cast("long"))


def sample_dosage(sample: Column, fields: Column, prefer_ds: bool = True) -> Column:
    """DS if the row's FORMAT (an array) has it and it is given, even if it is no dosage; else GT."""
    parts = F.split(sample, ":")

    def value(name: str) -> Column:
        at = F.array_position(fields, F.lit(name))
        return F.when(at > 0, F.get(parts, (at - 1).cast("int")))

    ds, gt = value("DS"), gt_dosage(value("GT"))
    if not prefer_ds:
        return gt
    return F.when(ds.isNotNull() & ~ds.isin("", "."), dosage(number(ds))).otherwise(gt)


def complement(allele: Column) -> Column:
    return F.translate(allele, "ACGT", "TGCA")


def strand_ambiguous(a: Column, b: Column) -> Column:
    """Whether the pair reads the same on the other strand."""
    return F.concat(a, b).isin("AT", "TA", "CG", "GC")


def orientation(ref: Column, alt: Column, effect: Column, other: Column) -> tuple[Column, Column]:
    """(ALT, REF or null; whether the strand was flipped) of an effect allele. A direct match goes first."""
    direct = ((effect == alt) & (other == ref)) | ((effect == ref) & (other == alt))
    e, o = complement(effect), complement(other)
    flipped = ~direct & (((e == alt) & (o == ref)) | ((e == ref) & (o == alt)))
    side = F.when(direct, F.when(effect == alt, "ALT").otherwise("REF")).when(flipped, F.when(e == alt, "ALT").otherwise("REF"))
    return side, flipped


def effect_dosage(alt_dosage: Column, side: Column) -> Column:
    return F.when(side == "ALT", alt_dosage).when(side == "REF", 2 - alt_dosage)


def quantized(weight: Column, scale: int) -> Column:
    """Nearest whole number of weight times scale, ties to even."""
    return F.bround(weight * scale).cast("long")


def centered(value: Column, modulus: int) -> Column:
    """The representative of a value modulo ``modulus`` that is nearest to 0."""
    v = F.pmod(value, F.lit(modulus))
    return F.when(v > modulus // 2, v - modulus).otherwise(v)
