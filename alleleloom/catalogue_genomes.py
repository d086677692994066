"""Queries of weights and genotypes as their files have them, made from parts, and their SQL: faults, reports, labels, dosages and synthetic workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alleles, slots
from .operators import align, score
from .registry import query, table
from .sources import adapters, genotypes
from .sources.adapters import duckdb

#: Weights as texts, a few of them faulty in one way each, which the row number picks. For Spark and DuckDB.
RAW = """
select source_row as line, case k when 1 then 'chr'||chrom when 2 then ' CHR'||chrom when 3 then '' else chrom end as chr_name,
  case k when 4 then 'x1' when 5 then '' when 6 then '-5' when 7 then ' '||cast(position as {text})||' ' else cast(position as {text}) end as chr_position,
  'rs'||cast(source_row as {text}) as rsID,
  case k when 8 then lower(effect_allele) when 9 then 'AT' when 10 then '' when 11 then 'N' else effect_allele end as effect_allele,
  case k when 12 then null when 13 then effect_allele else other_allele end as other_allele,
  case k when 14 then 'nan' when 15 then 'abc' when 16 then '' else cast(w_int as {text}) end as effect_weight,
  case k when 17 then 'Dominant model' else 'beta' end as weight_type, case k when 18 then ' TRUE ' when 19 then '1' else 'no' end as is_dominant
from (select w.*, source_row%41 as k from {w} w) q
"""
CHROM = "chr3"


def raw_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW.replace("{text}", "string"), w=adapters.weights(spark, sf_dir))


JUDGED = "raw as (" + RAW.replace("{text}", "varchar").replace("{w}", "w") + """),
  x0 as (select *, regexp_replace(trim(chr_name), '(?i)^chr', '') as chrom, upper(trim(effect_allele)) as ea, upper(trim(other_allele)) as oa, try_cast(trim(chr_position) as bigint) as pos,
    try_cast(effect_weight as double) as wt from raw),
  judged as (select line, chrom, pos as position, rsID as rsid, ea as effect_allele, oa as other_allele, case when isfinite(wt) then wt end as effect_weight,
    case when {target} then 'outside_target_chromosome'
      when lower(trim(is_dominant)) in ('1','true','yes','y') or lower(weight_type) like '%dominant%' then 'unsupported_weight_type'
      when chrom='' or trim(chr_position)='' or ea='' or coalesce(oa,'')='' or trim(effect_weight)='' then 'incomplete_variant' when pos is null or wt is null then 'invalid_numeric_value'
      when ea not in ('A','C','G','T') or oa not in ('A','C','G','T') or ea=oa then 'multiallelic_or_haplotype' when pos<=0 or not isfinite(wt) then 'invalid_numeric_value' end as reason from x0)"""
ALL, ONE = JUDGED.replace("{target}", "false"), JUDGED.replace("{target}", "chrom<>'3'")
CLASSIFIED = """, wj as (select chrom, position, line as source_row, effect_allele, other_allele, effect_weight::bigint as w_int from judged where reason is null),
  wd as (select *, count(*) over (partition by chrom, position) as n_weights from wj),
  v1 as (select chrom, position, count(*) as n_genotypes, min_by(vrow, vrow) as vrow, min_by(ref, vrow) as ref, min_by(alt, vrow) as alt from v group by 1, 2),
  c0 as (select wd.*, v1.n_genotypes, v1.ref, v1.alt, translate(effect_allele,'ACGT','TGCA') as fe, translate(other_allele,'ACGT','TGCA') as fo from wd left join v1 using (chrom, position)),
  c1 as (select *, (effect_allele=alt and other_allele=ref) or (effect_allele=ref and other_allele=alt) as direct, (fe=alt and fo=ref) or (fe=ref and fo=alt) as turned from c0),
  c2 as (select *, case when n_weights>1 then 'duplicate_pgs_variant' when n_genotypes is null then 'missing_from_vcf' when n_genotypes>1 then 'duplicate_vcf_variant'
      when alt like '%,%' then 'multiallelic_variant' when ref||alt in ('AT','TA','CG','GC') then 'strand_ambiguous' when not direct and not turned then 'allele_mismatch' else 'ok' end as reason from c1),
  c as (select *, case when reason='ok' then case when direct then case when effect_allele=alt then 'ALT' else 'REF' end else case when fe=alt then 'ALT' else 'REF' end end end as side from c2)"""


def judged(spark: SparkSession, sf_dir: str, chrom: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(classified usable weights, rejects)."""
    rows = genotypes.judge_weights(raw_weights(spark, sf_dir), chrom)
    usable = rows.filter("reason is null").select("chrom", "position", F.col("line").alias("source_row"), "effect_allele", "other_allele", F.col("effect_weight").cast("long").alias("w_int"))
    return align.classify(usable, adapters.genotypes(spark, sf_dir)), rows.filter("reason is not null").select("line", "reason")


@query(duckdb(ALL + " select line, chrom, position, rsid, effect_allele, other_allele, effect_weight, reason from judged"))
def weight_row_rules(spark, sf_dir):
    return genotypes.judge_weights(raw_weights(spark, sf_dir))


@query(duckdb(ONE + " select reason, count(*) as n from judged group by 1"))
def weight_rows_of_chromosome(spark, sf_dir):
    return genotypes.judge_weights(raw_weights(spark, sf_dir), CHROM).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


REPORT = """ select (select count(*) from judged) as total_pgs_variants, count(*) filter (reason='ok') as matched_variants, count(*) filter (side='ALT') as alt_oriented_variants,
  count(*) filter (side='REF') as ref_oriented_variants, count(*) filter (reason='strand_ambiguous') as strand_ambiguous_variants, count(*) filter (reason='ok' and not direct) as strand_flipped_variants,
  count(*) filter (reason='multiallelic_variant')+(select count(*) from judged where reason='multiallelic_or_haplotype') as multiallelic_exclusions, count(*) filter (reason='missing_from_vcf') as missing_variants,
  count(*) filter (reason in ('duplicate_pgs_variant','duplicate_vcf_variant')) as duplicate_variants, (select count(*) from judged where reason like 'unsupported%' or reason='incomplete_variant') as unsupported_variants,
  count(*) filter (reason='ok') as final_scored_variants, (select count(*) from (select distinct v.chrom, v.position from v where not exists (select 1 from c where c.chrom=v.chrom and c.position=v.position and n_weights=1 and n_genotypes=1)) u) as vcf_only_variants from c"""


@query(duckdb(ALL + CLASSIFIED + REPORT))
def harmonization_report(spark, sf_dir):
    return align.full_report(*judged(spark, sf_dir), adapters.genotypes(spark, sf_dir))


@query(duckdb(ONE + CLASSIFIED + """ select chrom, position, reason, 1::bigint as n from c where reason<>'ok'
  union all select '', line, reason, 1 from judged where reason is not null and reason<>'outside_target_chromosome' union all select '', min(line), reason, count(*) from judged where reason='outside_target_chromosome' group by 3"""))
def harmonization_exclusions(spark, sf_dir):
    return align.exclusions(*judged(spark, sf_dir, CHROM))


@query(duckdb("""x as (select vrow, case vrow%3 when 0 then 'chr'||chrom when 1 then ' CHR'||chrom else chrom end as name, chrom, position, ref, alt, case when vrow%4=0 then '.' else 'v'||vrow end as vid, 'w'||vrow as wid from v),
  y as (select *, case when vid<>'.' then vid else wid end as rsid from x)
  select vrow, regexp_replace(trim(name), '(?i)^chr', '') as any_case, regexp_replace(name, '^chr', '') as as_is, rsid, chrom||':'||position||':'||ref||':'||alt||':'||rsid as label, chrom as back_chrom, position as back_position,
    rsid as back_rsid, len(ref)=1 and len(alt)=1 as single_bases from y"""))
def variant_labels(spark, sf_dir):
    v = adapters.genotypes(spark, sf_dir)
    name = F.when(F.col("vrow") % 3 == 0, F.concat(F.lit("chr"), "chrom")).when(F.col("vrow") % 3 == 1, F.concat(F.lit(" CHR"), "chrom")).otherwise(F.col("chrom"))
    own, weight = F.when(F.col("vrow") % 4 == 0, ".").otherwise(F.concat(F.lit("v"), "vrow")), F.concat(F.lit("w"), "vrow")
    rows = v.withColumns({"name": name, "rsid": alleles.preferred_rsid(own, weight)})
    rows = rows.withColumn("label", alleles.label(F.col("chrom"), F.col("position"), F.col("ref"), F.col("alt"), F.col("rsid")))
    rows = rows.withColumn("back", alleles.of_label(F.col("label")))
    return rows.select(
        "vrow", alleles.chromosome(F.col("name")).alias("any_case"), alleles.chromosome_as_is(F.col("name")).alias("as_is"), "rsid", "label", F.col("back.chrom").alias("back_chrom"),
        F.col("back.position").alias("back_position"), F.col("back.rsid").alias("back_rsid"), alleles.single_bases(F.col("ref"), F.col("alt")).alias("single_bases"),
    )


@query("""select l_partkey as vrow, count(*) as n, bool_and(d in (0,1,2)) as hard_calls, bool_or(d<>round(d)) as imputed, min(d) as lo, max(d) as hi
  from (select l_partkey, (l_quantity::bigint%3)::double+case when l_partkey%5=0 then 0.25 when l_partkey%5=1 then 1 else 0 end as d from lineitem) x group by 1""")
def dosage_checks(spark, sf_dir):
    more = F.when(F.col("l_partkey") % 5 == 0, 0.25).when(F.col("l_partkey") % 5 == 1, 1.0).otherwise(0.0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("vrow"), ((F.col("l_quantity").cast("long") % 3).cast("double") + more).alias("d"))
    d = F.col("d")
    return rows.groupBy("vrow").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(alleles.hard_call(d)).alias("hard_calls"), F.bool_or(alleles.imputed(d)).alias("imputed"), F.min(d).alias("lo"), F.max(d).alias("hi")
    )


@query(duckdb("""x as (select source_row, case when source_row%9=0 then 0 else w_int/10000.0::double end as weight from w)
  select count(*) as variants, round(avg(weight),9)::double as mean, round(stddev_pop(weight),9)::double as sd, max(abs(weight)) as max_abs, round(sum(abs(weight)),6)::double as sum_abs,
    round(count(*) filter (weight=0)/count(*)::double,9)::double as sparsity, max(len(rtrim(split_part(printf('%.15f', abs(weight)),'.',2),'0')))::int as decimals, round(2*sum(abs(weight)),6)::double as bound from x"""))
def weight_features(spark, sf_dir):
    weight = F.when(F.col("source_row") % 9 == 0, 0.0).otherwise(F.col("w_int") / 10000.0)
    rows = score.weight_features(adapters.weights(spark, sf_dir).select(weight.alias("effect_weight")), 2.0)
    return rows.withColumns({c: F.round(c, n) for c, n in (("mean", 9), ("sd", 9), ("sum_abs", 6), ("sparsity", 9), ("bound", 6))})


@query("""with d as (select vec_id as sample_id, unnest(range(0, len(embedding)))::int as variant_ord, unnest(list_transform(embedding, lambda x: (abs(round(x*1000))::bigint%3)::double)) as d from embeddings),
  w as (select distinct variant_ord, ((variant_ord*7)%11-5)/8.0::double as weight from d) select sample_id, round(sum(d*weight),6)::double as score from d join w using (variant_ord) group by 1""")
def positional_scores(spark, sf_dir):
    """Products are of single precision, as in SQL, which decides what is a half."""
    values = F.transform("embedding", lambda x: (F.abs(F.round(x * F.lit(1000).cast("float"))).cast("long") % 3).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode(values).alias("variant_ord", "effect_dosage"))
    weights = rows.select("variant_ord").distinct().withColumn("effect_weight", ((F.col("variant_ord") * 7) % 11 - 5) / 8.0)
    return score.positional_scores(rows, weights).withColumn("score", F.round("score", 6))


VARIANTS, MISSING, SEED = 40, 0.1, 20260728
UNIFORM = "('0x'||substr(md5(concat_ws('|', {}),1,12))::bigint/281474976710656.0::double"
SYNTHETIC = f"""with n as (select count(*) as n from supplier), ids as (select s.s as sample_id, t.v as vrow from (select unnest(range(0, (select n from n))) as s) s, (select unnest(range(0, {VARIANTS})) as v) t),
  f as (select *, 0.01+0.49*{UNIFORM.format(f"'{SEED}', 'frequency', vrow)")} as freq from ids),
  g as (select sample_id, vrow, case when {UNIFORM.format(f"'{SEED}', 'missing', sample_id, vrow)")}>={MISSING} then ({UNIFORM.format(f"'{SEED}', 'first', sample_id, vrow)")}<freq)::int::double+({UNIFORM.format(f"'{SEED}', 'second', sample_id, vrow)")}<freq)::int end as d from f),
  m as (select vrow, avg(d) as mean, count(*)=count(d) as whole from g group by 1)
  select sample_id, round(sum(coalesce(d,0)*(vrow%7-3)),6)::double as zero, round(sum(coalesce(d,mean,0)*(vrow%7-3)),6)::double as mean_dosage, round(coalesce(sum(d*(vrow%7-3)) filter (whole),0),6)::double as exclude_variant
  from g join m using (vrow) group by 1"""


@query(SYNTHETIC)
def synthetic_policies(spark, sf_dir):
    """Scores of a synthetic workload of as many samples as suppliers under each policy for missing calls."""
    samples = table(spark, sf_dir, "supplier").count()
    calls, _ = genotypes.synthetic(spark, samples, VARIANTS, missing_rate=MISSING, seed=SEED)
    rows = calls.select("sample_id", F.col("vrow").alias("source_row"), F.col("alt_dosage").alias("effect_dosage"), (F.col("vrow") % 7 - 3).alias("weight"))
    out = None
    for policy in ("zero", "mean_dosage", "exclude_variant"):
        one = score.fill_missing(rows, policy).groupBy("sample_id").agg(F.round(F.sum(F.col("effect_dosage") * F.col("weight")), 6).alias(policy))
        out = one if out is None else out.join(one, "sample_id", "left")
    return out.fillna(0.0, ["exclude_variant"])


@query("""with p as (select c_custkey as line, 's'||(c_custkey%97) as sample, c_mktsegment as pop, n_name as super_pop from customer join nation on c_nationkey=n_nationkey),
  k as (select sample, min(line) as place, max_by(pop, line) as pop, max_by(super_pop, line) as super_pop from p group by 1) select sample from k where pop='BUILDING' order by place limit 5""")
def panel_last_row_wins(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("super_pop"))
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("line"), F.concat(F.lit("s"), (F.col("c_custkey") % 97).cast("string")).alias("sample"), F.col("c_mktsegment").alias("pop"), "super_pop"
    )
    return genotypes.panel_samples(genotypes.last_rows(rows, ["pop", "super_pop"]), 5, population="BUILDING")


#: A sample's field and its FORMAT, as genotype files have them. The same for Spark and DuckDB.
FORMAT = "case l_linenumber%3 when 0 then 'GT:DS' when 1 then 'GT' else 'DP:GT' end as format"
FIELD = """(case l_linenumber%3 when 2 then '9:' else '' end)||(case cast(l_quantity as bigint)%9 when 0 then '0/0' when 1 then '0|1' when 2 then '1/1' when 3 then './.' when 4 then '0/2' when 5 then '1' when 6 then '.' when 7 then '1/0/1' else '0/1' end)
    ||(case l_linenumber%3 when 0 then (case cast(l_quantity as bigint)%7 when 0 then ':1.25' when 1 then ':.' when 2 then ':2.5' when 3 then ':x' when 4 then ':' else ':0.5' end) else '' end) as field"""
GT = "(case when regexp_matches(gt, '^[01][/|][01]$') then len(regexp_replace(gt, '[^1]', '', 'g'))::double end)"


@query(f"""with f as (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, {FORMAT}, {FIELD} from lineitem),
  p as (select *, string_split(field, ':') as parts, list_position(string_split(format, ':'), 'DS') as ds_at, list_position(string_split(format, ':'), 'GT') as gt_at from f),
  x as (select *, case when ds_at>0 then parts[ds_at] end as ds, parts[gt_at] as gt from p)
  select format, field, count(*) as n, any_value({GT}) as gt_dosage, any_value(case when regexp_matches(gt, '^[01]([/|][01])*$') then len(regexp_replace(gt, '[^1]', '', 'g')) end)::bigint as any_ploidy,
    any_value(case when ds is not null and ds not in ('', '.') then (case when try_cast(ds as double) between 0 and 2 then try_cast(ds as double) end) else {GT} end) as dosage from x group by 1, 2""")
def genotype_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber", "l_quantity", FORMAT).selectExpr("format", FIELD)
    fields = F.split("format", ":")
    gt = F.get(F.split("field", ":"), (F.array_position(fields, F.lit("GT")) - 1).cast("int"))
    made = rows.groupBy("format", "field").agg(F.count(F.lit(1)).alias("n"))
    return made.select("format", "field", "n", alleles.gt_dosage(gt).alias("gt_dosage"), alleles.any_ploidy_dosage(gt).alias("any_ploidy"), alleles.sample_dosage(F.col("field"), fields).alias("dosage"))


@query("""select p_partkey, round_even(p_retailprice*p_size, 0)::bigint as quantised, list_sum(list_concat(list_transform(range(0, least(p_size, 32)), lambda i: 1), list_transform(range(0, 32-least(p_size, 32)), lambda i: 0)))::bigint as active,
  least(p_size, 32)::bigint as ones from part""")
def quantised_masks(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    ones = F.least(F.col("p_size"), F.lit(32))
    mask = slots.padding_mask(ones, F.lit(32))
    return rows.select("p_partkey", alleles.quantized(F.col("p_retailprice"), F.col("p_size")).alias("quantised"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("active"), ones.cast("long").alias("ones"))
