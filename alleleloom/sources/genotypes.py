"""Readers of genotype, weight and dosage text files, and writers of what was aligned."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alleles
from ..operators import cohort, ranks
from ..operators.score import numbered
from . import blocked


#: What marks a weight as not additive, the columns where that may be said, and flags that say it.
NOT_ADDITIVE = ["dominant", "recessive", "interaction", "haplotype"]
KIND_COLUMNS = ["weight_type", "effect_type", "variant_description", "locus_name", "inclusion_criteria"]
FLAGS = ["is_interaction", "is_dominant", "is_recessive", "is_haplotype"]
TRUE = ["1", "true", "yes", "y"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines numbered from 1, in order of the files' names and of the lines in each.

    The lines of each split are counted, and the counts summed up, so lines needn't come together anywhere. Block-compressed files
    are split as others are; those that are compressed as one stream are read by one task each.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    texts, packed = blocked.by_kind(spark, path)
    kinds = [spark.read.text(texts).select(*place, F.monotonically_increasing_id().alias("id"), "value")] if texts else []
    kinds += [blocked.lines(spark, packed)] if packed else []
    rows = kinds[0].unionByName(kinds[1]) if len(kinds) > 1 else kinds[0]
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    splits = splits.select(F.col("file").alias("f"), F.col("start").alias("s"), (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first") + 1).alias("shift"))
    rows = rows.join(splits, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    return rows.select((F.col("id") + F.col("shift")).alias("line"), "value")


def literal(values: list) -> Column:
    """Texts as one constant, however many there are; they hold no tabs."""
    return F.split(F.lit("\t".join(map(str, values))), "\t")


def read_vcf(spark: SparkSession, path: str, sample_ids: list[str] | None = None, sample_limit: int | None = None, wanted: DataFrame | None = None, prefer_ds: bool = True) -> DataFrame:
    """chrom, position, rsid, ref, alt, line, samples, alt_dosages, dosage_source; one row per record.

    ``wanted`` (chrom, position) limits the records before any sample is split. Only the chosen samples' fields
    are taken. Records with several ALT alleles keep null dosages and say so; rows of under nine fields are left out.
    """
    lines = numbered_lines(spark, path)
    head = lines.filter(F.col("value").startswith("#CHROM")).select("value").first()
    if head is None:
        raise ValueError("no #CHROM header")
    names = head[0].split("\t")[9:]
    chosen = sample_ids if sample_ids is not None else names[:sample_limit] if sample_limit else names
    if unknown := sorted(set(chosen) - set(names)):
        raise ValueError(f"no such samples: {unknown}")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 9)
    f = F.col("f")
    cell = lambda k: F.get(f, F.lit(k))  # noqa: E731  a later filter may be asked before that on the number of fields
    rows = rows.select("line", "f", alleles.chromosome(cell(0)).alias("chrom"), cell(1).try_cast("long").alias("position"), cell(2).alias("rsid"), F.upper(cell(3)).alias("ref"), F.upper(cell(4)).alias("alt"))
    if wanted is not None:
        rows = rows.join(wanted.select("chrom", "position").distinct(), ["chrom", "position"], "left_semi")
    fields = F.split(cell(8), ":")
    at = {n: k + 9 for k, n in enumerate(names)}
    samples = F.transform(literal([at[s] for s in chosen]).cast("array<int>"), lambda k: F.get(f, k)) if chosen else F.array().cast("array<string>")
    several = F.col("alt").contains(",")
    dosages = F.transform(samples, lambda s: F.when(~several, alleles.sample_dosage(s, fields, prefer_ds)))

    def source(s: Column) -> Column:
        ds = F.get(F.split(s, ":"), (F.array_position(fields, F.lit("DS")) - 1).cast("int"))
        has = F.array_contains(fields, "DS") & ds.isNotNull() & ~ds.isin("", ".") & F.lit(prefer_ds)
        return F.when(s.isNull(), "missing").when(has, "DS").otherwise("GT")

    kinds = F.array_distinct(F.transform(samples, source))
    kind = F.when(several, "unsupported_multiallelic").when(F.size(kinds) == 1, kinds[0]).otherwise("mixed")
    return rows.select("chrom", "position", "rsid", "ref", "alt", "line", (literal(chosen) if chosen else F.array().cast("array<string>")).alias("samples"), dosages.alias("alt_dosages"), kind.alias("dosage_source"))


def read_weights(spark: SparkSession, path: str, chrom: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The weights as judge_weights has them, and the metadata of the #key=value lines, the last of a key. ``line`` is the row in the file."""
    lines = numbered_lines(spark, path)
    metadata: dict[str, str] = {}
    for r in lines.filter(F.col("value").startswith("#")).orderBy("line").collect():  # comment lines of one file
        key, eq, value = r["value"].lstrip("#").partition("=")
        if eq:
            metadata[key.strip()] = value.strip()
    body = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    head = body.orderBy("line").first()
    if head is None:
        raise ValueError("no header")
    names, f = head["value"].split("\t"), F.split("value", "\t")
    cells = [F.get(f, F.lit(k)).alias(n) for k, n in enumerate(names) if n in WEIGHT_COLUMNS and n not in names[:k]]
    return judge_weights(body.filter(F.col("line") > head["line"]).select("line", *cells), chrom), metadata


#: The columns of a weight file that are read.
WEIGHT_COLUMNS = [
    "chr_name", "chromosome", "chr_position", "position", "rsID", "rsid", "effect_allele", "other_allele", "reference_allele", "effect_weight", *KIND_COLUMNS, *FLAGS,
]


def judge_weights(rows: DataFrame, chrom: str | None = None) -> DataFrame:
    """line, chrom, position, rsid, effect_allele, other_allele, effect_weight and ``reason`` (null if usable) of rows of texts.

    A row's first fault in the documented order is its reason; rows of other chromosomes are marked
    outside_target_chromosome. Where a column is absent its alias is read; an empty cell isn't replaced.
    """

    def cell(*options: str) -> Column:
        found = [o for o in options if o in rows.columns]
        return F.coalesce(*[F.col(o) for o in found]) if found else F.lit(None).cast("string")

    flagged = F.lit(False)
    for n in FLAGS:
        flagged = flagged | F.coalesce(F.lower(F.trim(cell(n))).isin(TRUE), F.lit(False))
    said = F.lower(F.concat_ws(" ", *[cell(n) for n in KIND_COLUMNS]))
    for word in NOT_ADDITIVE:
        flagged = flagged | said.contains(word)
    rows = rows.select(
        "line",
        alleles.chromosome(cell("chr_name", "chromosome")).alias("chrom"),
        cell("chr_position", "position").alias("position_text"),
        cell("rsID", "rsid").alias("rsid"),
        F.upper(F.trim(cell("effect_allele"))).alias("effect_allele"),
        F.upper(F.trim(cell("other_allele", "reference_allele"))).alias("other_allele"),
        cell("effect_weight").alias("weight_text"),
        flagged.alias("flagged"),
    )
    rows = rows.withColumns({"position": F.trim("position_text").try_cast("long"), "effect_weight": alleles.number(F.col("weight_text"))})
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    single = lambda c: F.col(c).rlike("^[ACGT]$")
    outside = F.lit(False) if chrom is None else ~F.col("chrom").eqNullSafe(alleles.chromosome(F.lit(chrom)))
    reason = (
        F.when(outside, "outside_target_chromosome")
        .when(F.col("flagged"), "unsupported_weight_type")
        .when(blank("chrom") | blank("position_text") | blank("effect_allele") | blank("other_allele") | blank("weight_text"), "incomplete_variant")
        .when(F.col("position").isNull() | F.col("weight_text").try_cast("double").isNull(), "invalid_numeric_value")
        .when(~single("effect_allele") | ~single("other_allele") | (F.col("effect_allele") == F.col("other_allele")), "multiallelic_or_haplotype")
        .when((F.col("position") <= 0) | F.col("effect_weight").isNull(), "invalid_numeric_value")
    )
    return rows.select("line", "chrom", "position", "rsid", "effect_allele", "other_allele", "effect_weight", reason.alias("reason"))


def read_scoring_file(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """chrom, position, rsid, effect_allele, other_allele, effect_weight of the rows that have them; others go without a word. An error if none is left.

    The looser reader: other alleles may be missing, and nothing is asked of alleles or kinds of weights.
    """
    rows, _ = read_weights(spark, path)
    rows = rows.filter("chrom <> '' and position is not null and effect_allele <> '' and effect_weight is not null").drop("reason", "line")
    rows = rows.withColumn("other_allele", F.coalesce("other_allele", F.lit("")))
    if chrom is not None:
        rows = rows.filter(F.col("chrom") == F.regexp_replace(F.lit(chrom), "^chr", ""))
    if rows.isEmpty():
        raise ValueError("no usable weights")
    return rows


def count_records(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> tuple[int, int]:
    """(records of a genotype file, those that ``wanted`` keys leave out); rows of under nine fields are no records."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(f) >= 9)).select(alleles.chromosome(f[0]).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("position"))
    total = rows.count()
    return total, 0 if wanted is None else rows.join(wanted.select("chrom", "position").distinct(), ["chrom", "position"], "left_anti").count()


def same_build(one: str | None, other: str | None) -> None:
    """An error if both genome builds are known and differ, but for capitals."""
    if one and other and one.lower() != other.lower():
        raise ValueError(f"genome builds differ: {one}, {other}")


def first_variants(records: DataFrame, n: int, least_minor: int = 1) -> DataFrame:
    """The first ``n`` records by line with one ALT base, all calls known and so many minor alleles; an error if there are fewer."""
    known = F.forall("alt_dosages", lambda d: d.isNotNull()) & (F.size("alt_dosages") > 0)
    count = F.aggregate("alt_dosages", F.lit(0.0), lambda a, d: a + d)
    rows = records.filter(alleles.single_bases(F.col("ref"), F.col("alt")) & known).withColumn("alt_count", count)
    rows = rows.filter(F.least(F.col("alt_count"), 2 * F.size("alt_dosages") - F.col("alt_count")) >= least_minor)
    rows = rows.withColumn("frequency", F.col("alt_count") / (2 * F.size("alt_dosages"))).orderBy("line").limit(n)
    if (found := rows.count()) < n:
        raise ValueError(f"{n} variants asked for, {found} found")
    return rows


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(place, sample, pop, super_pop and whatever else the header names) of a tab-separated panel: a sample's last row counts, at the place of its first."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    head = lines.orderBy("line").first()
    if head is None or "sample" not in head["value"].split("\t"):
        raise ValueError("no column sample")
    f, names = F.split("value", "\t"), head["value"].split("\t")
    rows = lines.filter(F.col("line") > head["line"]).select("line", *[F.get(f, F.lit(k)).alias(n) for k, n in enumerate(names)])
    return last_rows(rows, [n for n in names if n != "sample"])


def last_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of rows (line, sample, columns) the last of each sample, at the ``place`` of its first."""
    last = F.max_by(F.struct(*columns), "line").alias("last")
    return rows.groupBy("sample").agg(F.min("line").alias("place"), last).select("place", "sample", "last.*")


def panel_samples(panel: DataFrame, limit: int, population: str | None = None, super_population: str | None = None) -> DataFrame:
    """The first ``limit`` samples of the populations."""
    for column, value in (("pop", population), ("super_pop", super_population)):
        panel = panel if value is None else panel.filter(F.col(column) == value)
    return panel.orderBy("place").limit(limit).select("sample")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / float(1 << 48)


def synthetic(spark: SparkSession, samples: int, variants: int, sd: float = 0.05, decimals: int = 7, sparsity: float = 0.0, missing_rate: float = 0.0, imputed: bool = False, frequencies: tuple[float, float] = (0.01, 0.5), seed: int = 20260728) -> tuple[DataFrame, DataFrame]:
    """(calls of sample_id, vrow and alt_dosage; weights of vrow and effect_weight), the same for the same seed at any partitioning."""
    of = lambda *parts: uniform(F.lit(seed), *parts)
    normal = lambda *p: F.sqrt(-2 * F.log(1 - of(*p, F.lit("a")))) * F.cos(2 * math.pi * of(*p, F.lit("b")))
    calls = spark.range(samples * variants).select(F.floor(F.col("id") / variants).alias("sample_id"), (F.col("id") % variants).alias("vrow"))
    frequency = frequencies[0] + (frequencies[1] - frequencies[0]) * of(F.lit("frequency"), F.col("vrow"))
    hit = lambda n: (of(F.lit(n), F.col("sample_id"), F.col("vrow")) < frequency).cast("double")
    dosage = hit("first") + hit("second")
    if imputed:
        dosage = F.least(F.lit(2.0), F.greatest(F.lit(0.0), dosage + 0.08 * normal(F.lit("noise"), F.col("sample_id"), F.col("vrow"))))
    calls = calls.withColumn("alt_dosage", F.when(of(F.lit("missing"), F.col("sample_id"), F.col("vrow")) >= missing_rate, dosage))
    weight = F.when(of(F.lit("sparse"), F.col("vrow")) < sparsity, 0.0).otherwise(F.round(sd * normal(F.lit("weight"), F.col("vrow")), decimals))
    return calls, spark.range(variants).select(F.col("id").alias("vrow")).withColumn("effect_weight", weight)


def synthetic_cohort(spark: SparkSession, samples: int, variants: int, informative: float = 0.02, sd: float = 0.08, seed: int = 20260701) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls and weights as of ``synthetic``, without missing ones, and (sample_id, score, phenotype): 1 for scores from the upper median on.

    A share ``informative`` of the variants, one at least, has a weight that isn't 0: those with the least draws.
    """
    if samples < 1 or variants < 1 or not 0 < informative <= 1:
        raise ValueError("samples and variants must be positive, and the informative share in (0, 1]")
    calls, weights = synthetic(spark, samples, variants, sd=sd, decimals=15, frequencies=(0.05, 0.5), seed=seed)
    drawn = weights.withColumns({"draw": uniform(F.lit(seed), F.lit("informative"), F.col("vrow")), "n": F.lit(1).cast("long")})
    drawn = ranks.with_before(drawn.groupBy("draw").agg(F.sum("n").alias("n"), F.min("vrow").alias("vrow"), F.min("effect_weight").alias("effect_weight")), "draw", "n")
    tells = F.col("before") < max(1, int(variants * informative))
    weights = drawn.select("vrow", F.when(tells, F.col("effect_weight")).otherwise(0.0).alias("effect_weight"))
    weights = spark.range(variants).select(F.col("id").alias("vrow")).join(weights, "vrow", "left").na.fill(0.0)
    scored = calls.join(weights.filter("effect_weight <> 0"), "vrow").groupBy("sample_id").agg(F.round(F.sum(F.col("alt_dosage") * F.col("effect_weight")), 12).alias("score"))
    scored = spark.range(samples).select(F.col("id").alias("sample_id")).join(scored, "sample_id", "left").na.fill(0.0)
    threshold = cohort.upper_median(scored, "score").select(F.col("value").alias("__t"))
    return calls, weights, scored.crossJoin(F.broadcast(threshold)).select("sample_id", "score", (F.col("score") >= F.col("__t")).cast("int").alias("phenotype"))  # one row


def write_harmonized(dosages: DataFrame, weights: DataFrame, exclusions: DataFrame, folder: str, kind: str = "csv", report: DataFrame | None = None) -> None:
    """dosage, weights, exclusions and, as JSON, the report as ``csv``, ``parquet`` or ``both``. Dosages are (sample_id, variant_ord, effect_dosage), weights have variant_ord and WEIGHT_FIELDS.

    The CSV of dosages has a line for each sample and a column for each variant, named chrom:position:ref:alt:rsid; each of its
    files has the header, and a null is an empty cell. Parquet stays long: a row for each sample and variant.
    """
    if kind not in ("csv", "parquet", "both"):
        raise ValueError("kind must be csv, parquet or both")
    if kind != "csv":
        dosages.write.mode("overwrite").parquet(f"{folder}/dosage.parquet")
        weights.select("variant_ord", *WEIGHT_FIELDS).write.mode("overwrite").parquet(f"{folder}/weights.parquet")
    if kind != "parquet":
        label = alleles.label(F.col("chrom"), F.col("position"), F.col("ref"), F.col("alt"), F.col("rsid"))
        names = weights.agg(F.array_sort(F.collect_list(F.struct("variant_ord", label.alias("name")))).alias("n")).select("n.name").first()[0]  # the header of one line
        cells = dosages.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("variant_ord", "effect_dosage"))).alias("c"))
        line = F.concat_ws(",", F.col("sample_id").cast("string"), F.transform("c", lambda c: F.coalesce(c.getField("effect_dosage").cast("string"), F.lit(""))))
        lines = cells.select(line.alias(",".join(["sample_id", *names])))
        lines.write.mode("overwrite").csv(f"{folder}/dosage.csv", header=True, sep="\x01", quote="")
        weights.orderBy("variant_ord").select(*WEIGHT_FIELDS).write.mode("overwrite").csv(f"{folder}/weights.csv", header=True)
    exclusions.write.mode("overwrite").csv(f"{folder}/exclusions.csv", header=True)
    if report is not None:
        report.select(*sorted(report.columns)).write.mode("overwrite").json(f"{folder}/report.json")


#: The columns of written weights.
WEIGHT_FIELDS = ["chrom", "position", "rsid", "ref", "alt", "effect_allele", "orientation", "effect_weight", "dosage_source", "strand_flipped"]


def read_harmonized(spark: SparkSession, dosage: str, weights: str) -> tuple[DataFrame, DataFrame]:
    """(sample_id, variant_ord, effect_dosage) and (variant_ord, effect_weight) of written CSV or Parquet: columns and rows go together by place.

    Errors: a first column that isn't sample_id, weights without effect_weight, and lines with another number of dosages than there are weights.
    """
    if weights.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(weights)
        if "effect_weight" not in rows.columns:
            raise ValueError("no column effect_weight")
        w = rows.select(F.col("variant_ord").cast("int").alias("variant_ord"), F.col("effect_weight").cast("double").alias("effect_weight"))
    else:
        lines = numbered_lines(spark, weights)
        head = lines.orderBy("line").first()
        names = head["value"].lstrip("\ufeff").split(",") if head else []
        if "effect_weight" not in names:
            raise ValueError("no column effect_weight")
        lines = lines.filter(F.col("value") != head["value"]).filter(F.trim("value") != "")
        lines = numbered(lines.withColumnRenamed("line", "source_row"))
        w = lines.select(F.col("variant_ord").cast("int").alias("variant_ord"), F.get(F.split("value", ","), F.lit(names.index("effect_weight"))).cast("double").alias("effect_weight"))
    if dosage.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(dosage)
        if rows.columns[:1] != ["sample_id"]:
            raise ValueError("the first column must be sample_id")
        return rows.select("sample_id", F.col("variant_ord").cast("int").alias("variant_ord"), F.col("effect_dosage").cast("double").alias("effect_dosage")), w
    lines = spark.read.text(dosage)
    head = lines.first()
    if head is None or head[0].lstrip("\ufeff").split(",")[0] != "sample_id":
        raise ValueError("the first column must be sample_id")
    n = w.count()
    f = F.split("value", ",")
    cells = F.when(F.size(f) == n + 1, F.slice(f, 2, n)).otherwise(F.raise_error(F.lit("dosages and weights differ in number")).cast("array<string>"))
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").rlike("^\ufeff?sample_id,"))
    return rows.select(f[0].alias("sample_id"), F.posexplode(cells).alias("variant_ord", "cell")).select("sample_id", "variant_ord", F.nullif(F.trim("cell"), F.lit("")).cast("double").alias("effect_dosage")), w


def read_dosage_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, chrom, position, ref, alt, rsid, alt_dosage), one row per cell of a table with a column per variant.

    The header's columns are chrom:pos:REF:ALT with or without an id; the first one is sample_id. Cells of one line
    come from that line, so the table is never as wide as its variants. A .parquet path is read by its columns.
    """
    if path.rstrip("/").endswith(".parquet"):
        wide = spark.read.parquet(path)
        if wide.columns[:1] != ["sample_id"]:
            raise ValueError("the first column must be sample_id")
        pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("cell")) for c in wide.columns[1:]])
        return _cells(wide.select(F.col("sample_id").cast("string").alias("sample_id"), F.inline(pairs)))
    sep = "\t" if path.endswith((".tsv", ".txt")) else ","
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    head = lines.orderBy("line").first()
    names = head["value"].split(sep) if head else []
    if not names or names[0] != "sample_id":
        raise ValueError("the first column must be sample_id")
    if wrong := [n for n in names[1:] if len(n.split(":")) not in (4, 5)]:
        raise ValueError(f"not a variant: {wrong[0]}")
    keys = spark.createDataFrame([(k + 1, n) for k, n in enumerate(names[1:])], "at int, key string")
    cells = lines.filter(F.col("line") > head["line"]).filter(F.trim("value") != "").select(F.split("value", sep).alias("f"))
    return _cells(cells.select(F.col("f")[0].alias("sample_id"), F.posexplode("f").alias("at", "cell")).filter("at > 0").join(keys, "at"))


def _cells(cells: DataFrame) -> DataFrame:
    k, value = F.split("key", ":"), F.trim("cell")
    return cells.select(
        "sample_id", alleles.chromosome(k[0]).alias("chrom"), k[1].cast("long").alias("position"), F.upper(k[2]).alias("ref"), F.upper(k[3]).alias("alt"),
        F.coalesce(F.get(k, F.lit(4)), F.lit(".")).alias("rsid"), alleles.dosage(F.when(~value.isin(alleles.MISSING), alleles.number(value))).alias("alt_dosage"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark records of a json, jsonl, csv (all text) or parquet file or folder; keys are united."""
    kind = path.rstrip("/").rpartition(".")[2]
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "json":  # one object or a list in a file, or lines as written here
        lines = spark.read.json(path)
        return lines if "_corrupt_record" not in lines.columns else spark.read.json(path, multiLine=True)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=False)
    if kind == "parquet":
        return spark.read.option("mergeSchema", True).parquet(path)
    raise ValueError(f"unknown kind of records: {kind}")


def read_record_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all .jsonl files below a folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder)


def write_records(records: DataFrame, path: str) -> None:
    """As json, jsonl, csv or parquet by the path's ending; columns in order of name.

    json is one file with a list, or an object if there is one record; it is written row by row by one task. Nested columns are JSON text
    in csv and parquet. In parquet, texts of which all that aren't empty are numbers become numbers, and empty ones null.
    """
    kind, rows = path.rstrip("/").rpartition(".")[2], records.select(*sorted(records.columns))
    if kind == "jsonl":
        rows.write.mode("overwrite").json(path)
        return
    if kind == "json":
        lines = rows.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).mapInArrow(as_list, "value string")
        if rows.isEmpty():
            lines = records.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)
        lines.write.mode("overwrite").text(path)
        return
    nested = [c for c, t in rows.dtypes if t.startswith(("struct", "array", "map"))]
    rows = rows.withColumns({c: F.to_json(c) for c in nested}) if nested else rows
    if kind == "csv":
        rows.write.mode("overwrite").csv(path, header=True)
    elif kind == "parquet":
        retyped(rows).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown kind of records: {kind}")


def as_list(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that make a JSON list of the lines read, or the only line itself."""
    line, n = None, 0
    for batch in stream:
        out = []
        for value in batch.column(0).to_pylist():
            if line is not None:
                out.append(("[" if n == 1 else "") + line + ",")
            line, n = value, n + 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    if line is not None:
        yield pa.RecordBatch.from_arrays([pa.array([line if n == 1 else line + "]"], pa.string())], ["value"])


def retyped(rows: DataFrame) -> DataFrame:
    """``rows`` with text columns of numbers alone, but for empty texts, as whole numbers if all are, else as doubles."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    if not texts:
        return rows
    value = {c: F.nullif(F.trim(f"`{c}`"), F.lit("")) for c in texts}
    seen = [F.struct(F.count(v), F.count(v.try_cast("double")), F.count(v.try_cast("long"))).alias(c) for c, v in value.items()]
    counts = rows.agg(*seen).first()
    kinds = {c: "long" if n == longs else "double" for c in texts for n, doubles, longs in [tuple(counts[c])] if n and n == doubles}
    return rows.withColumns({c: value[c].try_cast(k) for c, k in kinds.items()}) if kinds else rows


def write_aligned(calls: DataFrame, classified: DataFrame, folder: str) -> None:
    """dosage, weights and exclusions as Parquet; variants are named by source_row, never by place."""
    calls.write.mode("overwrite").parquet(f"{folder}/dosage")
    classified.filter("reason = 'ok'").write.mode("overwrite").parquet(f"{folder}/weights")
    classified.filter("reason <> 'ok'").write.mode("overwrite").parquet(f"{folder}/exclusions")
