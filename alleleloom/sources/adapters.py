"""Weights, genotypes, calls and benchmark records made from the general tables.

The queries of the catalogue run on these. The SQL is the same for Spark and DuckDB but for the name of the text type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of ``calls`` are the customers with keys below this.
SAMPLES = 64

WEIGHTS = """
select cast(cast(floor(p_partkey/100.0) as bigint)%22+1 as {text}) as chrom,
  cast(p_partkey+1-(case when p_partkey%50=1 then 1 else 0 end) as bigint) as position,
  p_partkey as source_row,
  substring('ACGT', cast(p_partkey%4 as int)+1, 1) as effect_allele,
  substring('ACGT', cast((p_partkey+1+p_size%3)%4 as int)+1, 1) as other_allele,
  cast(round((p_retailprice-950.0)*10) as bigint) as w_int
from part
"""

GENOTYPES = """
select chrom, position, source_row as vrow,
  case when k<=3 then other_allele when k<=6 then effect_allele
       when k=7 then translate(other_allele,'ACGT','TGCA') else other_allele end as ref,
  case when source_row%53=0 then 'A,C' when k<=3 then effect_allele when k<=6 then other_allele
       when k=7 then translate(effect_allele,'ACGT','TGCA')
       else substring('ACGT',(case effect_allele when 'A' then 2 when 'C' then 3 when 'G' then 4 else 1 end),1) end as alt
from (select w.*, source_row%10 as k from w) x where k<>9
union all
select chrom, position, source_row+1000000, other_allele, effect_allele from w where source_row%71=5
"""

#: One row per sample and variant; {c} is the sample, v the genotypes.
DOSAGE = """case when ({c}*31+v.vrow*17)%997=0 or v.alt='A,C' then null
       else cast((({c}+11)*(v.vrow+17)*({c}+2*v.vrow+3))%10007%3 as bigint) end"""

RECORDS = """
select event_id as rec_ord, cast(user_id%20 as bigint) as candidate_id,
  case event_type when 'click' then 'CKKS' when 'view' then 'BFV' when 'purchase' then 'BGV' when 'signup' then 'CKKS' else 'BGV' end as scheme,
  case when event_type='error' then 'failed' else 'ok' end as status,
  case when event_type='error' then null else value end as evaluation_seconds,
  case when event_type='error' then null else cast(event_id%7 as double)*10+64 end as peak_memory_mb,
  case when event_type='error' then null else cast((event_id*37)%1000+1 as bigint) end as ciphertext_bytes
from events
"""


#: One workload for each chromosome with weights and nation with customers of the same number: what plans are made for.
WORKLOADS = """
select w.chrom as workload, c.samples, w.variants, w.bound
from (select chrom, count(*) as variants, cast(sum(abs(w_int)) as double)/10000.0 as bound from w group by chrom) w
  join (select c_nationkey, count(*) as samples from customer group by c_nationkey) c on c.c_nationkey = cast(w.chrom as bigint)
"""

SPARSE_CALLS = "from (select distinct o_custkey as c_custkey, l_partkey from lineitem join orders on l_orderkey = o_orderkey) s join v on v.vrow = l_partkey"


def duckdb(rest: str) -> str:
    """A query over w, v, g and rec in DuckDB's SQL."""
    w = WEIGHTS.format(text="varchar")
    g = f"select c_custkey as sample_id, v.vrow, {DOSAGE.format(c='c_custkey')} as alt_dosage {SPARSE_CALLS}"
    return f"with w as ({w}), v as ({GENOTYPES}), g as ({g}), rec as ({RECORDS}), {rest.strip()}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WEIGHTS.format(text="string").replace("from part", "from {part}"), part=_table(spark, sf_dir, "part"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GENOTYPES.replace("select w.*", "select *").replace("from w", "from {w}"), w=weights(spark, sf_dir))


def calls(spark: SparkSession, sf_dir: str, variants: DataFrame | None = None) -> DataFrame:
    """(sample_id, vrow, alt_dosage) of ``variants``, with vrow and alt, or of all genotypes.

    Dense, for the customers with keys below SAMPLES alone. ``all_calls``, which the queries take, has no such bound.
    """
    variants = genotypes(spark, sf_dir) if variants is None else variants
    samples = _table(spark, sf_dir, "customer").filter(F.col("c_custkey") < SAMPLES).select(F.col("c_custkey").alias("sample_id"))
    return _dosed(variants.crossJoin(F.broadcast(samples)))  # a bounded list of keys


def all_calls(spark: SparkSession, sf_dir: str, variants: DataFrame | None = None) -> DataFrame:
    """As ``calls``, of all customers, sparse: a customer has one call of each variant whose part (vrow) they ordered.

    The lines are reduced to one row for each customer and part before the join, so it never multiplies calls.
    """
    variants = genotypes(spark, sf_dir) if variants is None else variants
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("sample_id"), F.col("l_partkey").alias("part")).distinct()
    return _dosed(variants.join(pairs, F.col("vrow") == F.col("part")).drop("part"))


def _dosed(rows: DataFrame) -> DataFrame:
    text = DOSAGE.format(c="sample_id").replace("v.", "")
    return rows.selectExpr(*[c for c in rows.columns if c != "sample_id"], "sample_id", f"{text} as alt_dosage")


def workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workload, samples, variants, bound), the bound being the sum of the weights' sizes."""
    return spark.sql(WORKLOADS.replace("from w ", "from {w} ").replace("from customer", "from {customer}"), w=weights(spark, sf_dir), customer=_table(spark, sf_dir, "customer"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RECORDS.replace("from events", "from {events}"), events=_table(spark, sf_dir, "events"))
