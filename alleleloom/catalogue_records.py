"""Queries of raw benchmark records, made from events, and their SQL: canonical columns, residuals, splits, counters and objectives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cohort, models, records
from .registry import query, table
from .sources import adapters

#: Records as they come: keys that say the same under several names, empty texts, zeros, and plans as JSON. For Spark and DuckDB.
RAW = """
select event_id as rec_ord, cast(user_id%20 as bigint) as candidate_id,
  case event_type when 'error' then 'failed' when 'signup' then null else 'ok' end as status,
  case event_id%5 when 0 then 'tenseal' when 1 then 'OpenFHE 1.5' end as backend,
  case event_id%7 when 0 then 'simulated' when 1 then 'validation_only' when 2 then '' end as measurement_kind,
  cast(case event_id%4 when 0 then null when 1 then 0 else event_id%9+1 end as bigint) as samples, cast(event_id%5+2 as bigint) as sample_count,
  cast(case event_id%3 when 0 then null else event_id%50+1 end as {text}) as variants, cast(case when event_id%6=0 then null else 77 end as bigint) as matched_snps,
  cast(case when event_id%8=0 then 512 end as bigint) as window_snps, case event_id%5 when 0 then 'ckks' when 1 then 'BFV' end as scheme,
  cast(case when event_id%3=1 then 8192 end as bigint) as ring_dim, cast(case when event_id%4=1 then 40 end as bigint) as ckks_scaling_mod_size,
  cast(case when event_id%4=2 then 100000 end as bigint) as fixed_point_scale, cast(case when event_id%4=3 then 65537 end as bigint) as plain_modulus,
  cast(case when event_id%10=0 then 900 end as bigint) as requested_weights_on_chrom, case event_id%6 when 0 then 'PGS004941' when 1 then '' end as pgs_id,
  case event_id%9 when 0 then 'synthetic small' when 1 then '1000G chr22' end as dataset_group, case event_id%11 when 0 then 'group a' end as workload_group,
  case event_id%13 when 0 then 'Synthetic' when 1 then 'real' end as workload_type,
  case when event_type='error' then case when event_id%2=0 then 'error_constraint' when event_id%3=0 then '' else 'crash' end end as failure_type,
  case event_id%17 when 0 then '' when 1 then '0' end as error_constraint_feasible,
  case when event_type<>'error' and event_id%3=0 then value end as total_seconds, case when event_type<>'error' then value*2 end as total_he_compute_seconds,
  case when event_type<>'error' then value/2 end as evaluation_seconds, case when event_id%3=0 then cast(100.5 as double)+event_id%7 end as peak_memory_mb,
  cast(case when event_id%2=0 then 1048576*(event_id%9+1) end as bigint) as peak_rss_bytes, cast(case when event_id%4=0 then event_id%1000*10 end as bigint) as ciphertext_bytes,
  cast(case when event_id%3=0 then event_id%100 end as bigint) as input_ciphertext_bytes, cast(case when event_id%5=0 then event_id%70 end as bigint) as result_ciphertext_total_bytes,
  cast(case when event_id%12=0 then 5 end as bigint) as communication_bytes, cast(case when event_id%6=2 then 1000 end as bigint) as total_key_material_bytes,
  cast(case when event_id%6=3 then 2000 end as bigint) as key_bytes, cast(case when event_id%6=4 then 3000 end as bigint) as public_context_bytes,
  cast(case when event_id%6=1 then 7 end as bigint) as multiplication_key_bytes, case when event_id%19=0 then 'own' end as key_bytes_scope,
  cast(case when event_id%4=0 then 0.001 end as double) as max_absolute_error, cast(case when event_id%3=0 then 0.002 end as double) as max_abs_error,
  case when event_id%2=1 then '{"scheme": "bgv", "ring_dimension": 16384, "window_size": '||cast(event_id%3*256 as {text})||', "scale_bits": '
    ||(case when event_id%5=0 then 'null' else '45' end)||', "chunk_count": '||cast(event_id%4 as {text})||', "rotation_indices": [1,2,4], "feature_packing": '
    ||(case when event_id%7=0 then 'false' else 'true' end)||', "chunk_aggregation_strategy": "add_then_reduce", "multiplicative_depth": 2, "variants_per_ciphertext": '
    ||cast(event_id%5*100 as {text})||'}' end as plan
from {events}
"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW.replace("{text}", "string").replace("\"{", "{").replace("'{\"", "'{{\"").replace("'}'", "'}}'"), events=table(spark, sf_dir, "events"))


HALVED = "case when {0}>1 then len(bin(({0}-1)::bigint)) else 0 end"
CANON = "with raw as (" + RAW.replace("{text}", "varchar").replace("{events}", "events") + f"""),
  r0 as (select *, plan->>'$.scheme' as p_scheme, (plan->>'$.ring_dimension')::bigint as p_ring, nullif((plan->>'$.window_size')::bigint,0) as p_window, (plan->>'$.scale_bits')::bigint as p_scale,
    nullif((plan->>'$.chunk_count')::bigint,0) as p_chunks, plan->>'$.feature_packing' as p_feature, plan->>'$.chunk_aggregation_strategy' as p_strategy,
    (plan->>'$.multiplicative_depth')::bigint as p_depth, nullif((plan->>'$.variants_per_ciphertext')::bigint,0) as p_each from raw),
  r1 as (select *, coalesce(nullif(samples,0), nullif(sample_count,0), 0)::bigint as ns, coalesce(nullif(try_cast(variants as bigint),0), nullif(matched_snps,0), 0)::bigint as nv from r0),
  r2 as (select *, coalesce(p_window, window_snps, greatest(1,nv))::bigint as win, upper(coalesce(nullif(scheme,''), p_scheme, '')) as sch, coalesce(p_ring, ring_dim, 0)::bigint as ring from r1),
  r3 as (select *, coalesce(p_each, win)::bigint as each, coalesce(ciphertext_bytes::double, case when input_ciphertext_bytes is not null or result_ciphertext_total_bytes is not null
      then coalesce(input_ciphertext_bytes,0)+coalesce(result_ciphertext_total_bytes,0) end::double) as cb, coalesce(max_absolute_error, max_abs_error) as err,
    coalesce(p_strategy,'reduce_then_add') as strategy from r2),
  r4 as (select *, (nv+each-1)//each as chunks, (nv//each)*({HALVED.format('each')}) + ({HALVED.format('(nv%each)')}) as seq from r3),
  r5 as (select *, case when strategy='add_then_reduce' and chunks>0 then {HALVED.format('each')} else seq end as turns from r4),
  canon as (select rec_ord, candidate_id, status, evaluation_seconds, failure_type,
    coalesce(nullif(measurement_kind,''), case when lower(coalesce(backend,'')) like '%openfhe%' then 'measured_historical' when status is not null then 'measured_unspecified' else 'unknown' end) as measurement_kind,
    coalesce(nullif(workload_group,''), nullif(dataset_group,''), nullif(pgs_id,''), 'unspecified') as workload_group, 'variants:'||nv as group_variant_count, 'samples:'||ns as group_sample_count,
    'window:'||win as group_window_size, sch||':'||ring||':'||win||':'||coalesce(coalesce(p_scale, ckks_scaling_mod_size)::varchar,'')||':'||coalesce(fixed_point_scale::varchar,'') as group_parameter_combination,
    sch||':'||ring as group_scheme_configuration, coalesce(pgs_id,'') as group_pgs,
    case when lower(concat_ws(' ', workload_type, dataset_group, workload_group)) like '%synthetic%' then 'synthetic'
      when regexp_matches(lower(concat_ws(' ', workload_type, dataset_group, workload_group)), '1000g|1000 genomes|real|pgs') then 'real' else 'unspecified' end as group_source_domain,
    ns as sample_count, nv as matched_variant_count, coalesce(requested_weights_on_chrom, nv)::bigint as total_pgs_variants, 1::bigint as score_count, sch as scheme, ring as ring_dimension,
    128::bigint as security_bits, coalesce(p_depth,1)::bigint as multiplicative_depth, null::bigint as first_modulus_size, ckks_scaling_mod_size as scaling_modulus_size, plain_modulus as plaintext_modulus,
    fixed_point_scale, coalesce(p_scale, ckks_scaling_mod_size) as ckks_scale_bits, win as slots_used, win as window_size, coalesce(p_chunks,1)::bigint as chunk_count,
    1::bigint as samples_per_ciphertext, 1::bigint as scores_per_ciphertext, (case when plan is null then 0 else 3 end+(multiplication_key_bytes is not null)::int+2)::int as key_count,
    case when coalesce(p_feature,'true')='true' then 'feature' else 'none' end as packing_strategy, 'binary_tree' as reduction_strategy, coalesce((status='ok')::int,0) as execution_success,
    coalesce(try_cast(nullif(error_constraint_feasible,'') as int), case when failure_type='error_constraint' then 0 when status='ok' and err is not null then 1 end) as error_constraint_feasible,
    coalesce(total_seconds, total_he_compute_seconds) as total_seconds, coalesce(peak_memory_mb, peak_rss_bytes/1048576.0)::double as peak_memory_mb, cb as ciphertext_bytes,
    coalesce(nullif(communication_bytes,0)::double, cb) as communication_bytes, coalesce(total_key_material_bytes, key_bytes, public_context_bytes)::double as key_bytes,
    coalesce(nullif(key_bytes_scope,''), case when total_key_material_bytes is not null then 'public+secret+multiplication+rotation' when key_bytes is not null then 'source_defined'
      when public_context_bytes is not null then 'legacy_context+public_key_proxy' else 'unavailable' end) as key_bytes_scope, err as max_absolute_error,
    (ns*chunks)::bigint as ciphertext_count, (ns*chunks)::bigint as multiplication_count, (ns*turns)::bigint as rotation_count, (ns*(turns+greatest(chunks-1,0)))::bigint as addition_count from r5)"""
KEPT = ["rec_ord", "candidate_id", "status"]


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.canonicalize(raw(spark, sf_dir))


@query(CANON + " select * exclude (evaluation_seconds, failure_type) from canon")
def records_canonical_columns(spark, sf_dir):
    rows = canonical(spark, sf_dir)
    keys = set(raw(spark, sf_dir).columns)
    derived = rows.columns[next(k for k, c in enumerate(rows.columns) if c == "measurement_kind") :]
    return rows.select(*[c for c in KEPT if c in keys], *derived)


@query(CANON + " select measurement_kind, count(*) as n, count(*) filter (status='ok') as n_ok from canon where (measurement_kind like 'measured%' or measurement_kind='validation_only') and status is not null group by 1")
def records_for_training(spark, sf_dir):
    rows = records.for_training(canonical(spark, sf_dir))
    return rows.groupBy("measurement_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"))


@query(CANON + """ select 'status' as kind, status as value, count(*) as n from canon where status is not null group by 2 union all select 'measurement_kind', measurement_kind, count(*) from canon group by 2
  union all select 'failure_type', failure_type, count(*) from canon where failure_type<>'' group by 2""")
def records_counters(spark, sf_dir):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("status", "measurement_kind", "failure_type")])
    rows = canonical(spark, sf_dir).select(F.explode(kinds).alias("x")).filter("x.value is not null and (x.kind <> 'failure_type' or x.value <> '')")
    return rows.groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query(CANON + """, l as (select rec_ord, unnest(['evaluation_seconds','peak_memory_mb','key_bytes','max_absolute_error']) as target,
    unnest([evaluation_seconds-rec_ord%7, peak_memory_mb-100, case when rec_ord%2=0 or key_bytes_scope='source_defined' then key_bytes-1500 end, max_absolute_error-0.001]) as residual from canon where status='ok')
  select rec_ord, target, round(residual,6)::double as residual from l where residual is not null""")
def residual_pairing(spark, sf_dir):
    made = {"evaluation_seconds": (F.col("rec_ord") % 7).cast("double"), "peak_memory_mb": F.lit(100.0), "key_bytes": F.lit(1500.0), "max_absolute_error": F.lit(0.001), "success_probability": F.lit(0.5)}
    rows = canonical(spark, sf_dir).withColumn("predicted", F.create_map(*[x for n, v in made.items() for x in (F.lit(n), v)]))
    rows = rows.withColumn("scopes", F.create_map(F.lit("key_bytes"), F.when(F.col("rec_ord") % 2 == 0, "").otherwise("source_defined")))
    return records.residuals(rows, "predicted", "scopes", ["rec_ord"]).withColumn("residual", F.round("residual", 6))


FIVE = ["evaluation_seconds", "peak_memory_mb", "ciphertext_bytes", "key_bytes", "max_absolute_error"]
LOGS = "[" + ", ".join(f"ln(1+greatest(0,{c}))" for c in FIVE) + "]"


@query(CANON + f""", a as (select rec_ord, scheme, {LOGS} as v from canon where {' and '.join(f'{c} is not null' for c in FIVE)}),
  b as (select scheme, {', '.join(f'min(v[{k}]) as lo{k}, max(v[{k}]) as hi{k}' for k in range(1, 6))} from a group by 1)
  select c.rec_ord, c.scheme, case when a.rec_ord is not null then round({' + '.join(f'coalesce((v[{k}]-lo{k})/nullif(hi{k}-lo{k},0),0)' for k in range(1, 6))}, 6) end::double as objective
  from canon c left join a on c.rec_ord=a.rec_ord left join b on a.scheme=b.scheme""")
def measured_objective_five(spark, sf_dir):
    rows = records.balanced_objective(canonical(spark, sf_dir), FIVE, ["scheme"])
    return rows.select("rec_ord", "scheme", F.round("objective", 6).alias("objective"))


@query(CANON + """ select scheme, min_by(rec_ord, (evaluation_seconds, rec_ord)) as rec_ord, min(evaluation_seconds) as seconds from canon
  where status='ok' and evaluation_seconds is not null group by 1""")
def best_record(spark, sf_dir):
    """The record with the least measurement of each scheme; of equal ones the first stays first."""
    rows = canonical(spark, sf_dir).filter("status = 'ok' and evaluation_seconds is not null").groupBy("scheme")
    return rows.agg(F.min(F.struct("evaluation_seconds", "rec_ord")).alias("b")).select("scheme", "b.rec_ord", F.col("b.evaluation_seconds").alias("seconds"))


@query(CANON + """, g as (select unnest(['unseen_variant_count','unseen_sample_count','unseen_window_size','unseen_parameter_combination','unseen_scheme_configuration','one_pgs_to_another']) as name,
    unnest(['group_variant_count','group_sample_count','group_window_size','group_parameter_combination','group_scheme_configuration','group_pgs']) as group_key,
    unnest([group_variant_count, group_sample_count, group_window_size, group_parameter_combination, group_scheme_configuration, group_pgs]) as g from canon),
  k as (select name, group_key, g, count(*) as n from g where g<>'' group by all),
  o as (select *, row_number() over (partition by name order by md5('20260728|'||g), g) as place, count(*) over (partition by name) as n_groups from k),
  s as (select name, group_key, n_groups, sum(n)::bigint as total, (sum(n) filter (place<=greatest(1, round_even(n_groups*0.2, 0))))::bigint as test_rows from o group by all
    union all select 'synthetic_to_real', 'group_source_domain', count(distinct group_source_domain), count(*), count(*) filter (group_source_domain='real') from canon where group_source_domain in ('synthetic','real'))
  select name, group_key, case when n_groups>=2 then 'ok' else 'unavailable' end as status, case when n_groups>=2 then total-test_rows else 0 end::bigint as train_rows,
    case when n_groups>=2 then test_rows else 0 end::bigint as test_rows, n_groups from s""")
def generalization_splits(spark, sf_dir):
    return records.generalization_splits(canonical(spark, sf_dir))


@query(CANON + """ select scheme, key_bytes_scope, count(*) as n, round(avg(key_bytes),6)::double as mean_key_bytes from canon where key_bytes_scope='source_defined' and key_bytes is not null group by 1,2""")
def key_bytes_of_one_scope(spark, sf_dir):
    rows = records.one_scope(canonical(spark, sf_dir).filter("key_bytes_scope = 'source_defined' and key_bytes is not null"))
    return rows.groupBy("scheme", "key_bytes_scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("key_bytes"), 6).alias("mean_key_bytes"))


ORDER = {"CKKS": 0, "BFV": 1, "BGV": 2}
REC = f"with rec as ({adapters.RECORDS}), "


@query(REC + """g as (select candidate_id, scheme, count(*) as repeats, count(*) filter (status='ok') as ok_repeats, bool_and(status='ok') as all_ok,
    min_by(coalesce(ciphertext_bytes,-1), rec_ord) as first_bytes, avg(evaluation_seconds) as m1, coalesce(stddev_samp(evaluation_seconds),0) as s1, min(evaluation_seconds) as l1, max(evaluation_seconds) as h1,
    avg(peak_memory_mb) as m2, coalesce(stddev_samp(peak_memory_mb),0) as s2, min(peak_memory_mb) as l2, max(peak_memory_mb) as h2 from rec group by 1,2)
  select candidate_id, scheme, (case scheme when 'CKKS' then 0 when 'BFV' then 1 else 2 end)::int as place, repeats, ok_repeats, case when all_ok then 'ok' else 'failed' end as status, first_bytes,
    round(m1,6)::double as evaluation_seconds_mean, round(s1,6)::double as evaluation_seconds_sd, l1 as evaluation_seconds_min, h1 as evaluation_seconds_max,
    round(m2,6)::double as peak_memory_mb_mean, round(s2,6)::double as peak_memory_mb_sd, l2 as peak_memory_mb_min, h2 as peak_memory_mb_max from g""")
def records_group_metrics(spark, sf_dir):
    rows = records.group_metrics(adapters.records(spark, sf_dir), ["candidate_id", "scheme"], ["evaluation_seconds", "peak_memory_mb"], {"first_bytes": F.coalesce("ciphertext_bytes", F.lit(-1))}, "rec_ord")
    place = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("scheme"))
    rounded = {f"{m}_{s}": F.round(f"{m}_{s}", 6) for m in ("evaluation_seconds", "peak_memory_mb") for s in ("mean", "sd")}
    return rows.withColumns(rounded | {"place": place})


@query(REC + """g as (select scheme, count(*) as n, count(*) filter (status='ok') as n_ok, max(evaluation_seconds) as most, min(ciphertext_bytes) as least from rec group by 1)
  select scheme, unnest(['rows_are_ok','seconds_below_bound','sizes_positive','scheme_known']) as name, unnest([n=n_ok, most<1000, least>0, scheme in ('CKKS','BFV','BGV')]) as passed from g""")
def acceptance_checks(spark, sf_dir):
    """One row for each check of each scheme's records: whether it passed."""
    g = adapters.records(spark, sf_dir).groupBy("scheme").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.max("evaluation_seconds").alias("most"), F.min("ciphertext_bytes").alias("least")
    )
    checks = {"rows_are_ok": F.col("n") == F.col("n_ok"), "seconds_below_bound": F.col("most") < 1000, "sizes_positive": F.col("least") > 0, "scheme_known": F.col("scheme").isin(*ORDER)}
    return g.select("scheme", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("passed")) for n, c in checks.items()])))


@query(REC + """g as (select scheme, sum(evaluation_seconds) as s, count(*) filter (status='ok') as n, sum(ciphertext_bytes)::bigint as b, sum(peak_memory_mb) as m from rec group by 1)
  select scheme, round(coalesce(n/nullif(s,0),0),6)::double as samples_per_second, round(coalesce(n*51225/nullif(s,0),0),6)::double as products_per_second,
    round(coalesce(b/nullif(n,0),0),6)::double as bytes_per_sample, round(coalesce(b/nullif(n*13,0),0),6)::double as bytes_per_chunk, round(coalesce(m/nullif(n,0),0),6)::double as mb_per_sample from g""")
def throughput_all_ratios(spark, sf_dir):
    g = adapters.records(spark, sf_dir).groupBy("scheme").agg(
        F.sum("evaluation_seconds").alias("s"), F.count_if(F.col("status") == "ok").alias("n"), F.sum("ciphertext_bytes").alias("b"), F.sum("peak_memory_mb").alias("m")
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    n, s, b = F.col("n"), F.col("s"), F.col("b")
    return g.select(
        "scheme", ratio(n, s).alias("samples_per_second"), ratio(n * 51225, s).alias("products_per_second"), ratio(b, n).alias("bytes_per_sample"),
        ratio(b, n * 13).alias("bytes_per_chunk"), ratio(F.col("m"), n).alias("mb_per_sample"),
    )


@query(REC + """p as (select candidate_id, scheme, evaluation_seconds as a, ciphertext_bytes/10.0::double as b, ciphertext_bytes as size from rec where status='ok')
  select scheme, round(max(abs(a-b)),6)::double as max_abs, round(max(abs(a-b)/size),6)::double as max_mean_abs from p group by 1""")
def max_mean_error(spark, sf_dir):
    rows = adapters.records(spark, sf_dir).filter("status = 'ok'").select("scheme", F.col("evaluation_seconds").alias("a"), (F.col("ciphertext_bytes") / 10.0).alias("b"), F.col("ciphertext_bytes").alias("size"))
    return cohort.site_errors(rows, "a", "b", "size", ["scheme"]).select("scheme", F.round("max_abs", 6).alias("max_abs"), F.round("max_mean_abs", 6).alias("max_mean_abs"))


@query("""select rec_ord, (upper(scheme)='CKKS')::int::double as is_ckks, (upper(scheme)='BFV')::int::double as is_bfv, (upper(scheme)='BGV')::int::double as is_bgv,
  round(1/(1+exp(-(rec_ord%121-60)/2.0)), 9)::double as sigmoid from (""" + adapters.RECORDS + ") rec")
def scheme_features(spark, sf_dir):
    rows = adapters.records(spark, sf_dir)
    hot = models.one_hot(F.col("scheme"), list(ORDER))
    return rows.select("rec_ord", *[c.alias(f"is_{n.lower()}") for n, c in hot.items()], F.round(models.sigmoid((F.col("rec_ord") % 121 - 60) / 2.0), 9).alias("sigmoid"))


#: Texts that are numbers, labels, both or neither. The same for Spark and DuckDB.
TEXTS = """case event_id%12 when 0 then '' when 1 then 'nan' when 2 then 'inf' when 3 then 'x1' when 4 then ' TRUE ' when 5 then '0' when 6 then '1' when 7 then '-2.5e1'
  when 8 then 'no' when 9 then 'ok' when 10 then null else cast(event_id as {text}) end"""


@query("select event_id, t as text, case when not isnan(x) then x end as number, coalesce(isfinite(x), false) as is_number, coalesce(t<>'' and (x is null or isfinite(x)), false) as is_label, "
  "case when t<>'' then (lower(trim(t)) in ('1','true','yes','ok'))::int else (event_type='view')::int end as label, list_intersect(['CKKS','BFV','BGV'], case when event_id%2=0 then ['BFV','X','BGV'] else ['CKKS'] end).list_sort().array_to_string(',') as schemes "
  "from (select *, try_cast(t as double) as x from (select event_id, event_type, " + TEXTS.format(text="varchar") + " as t from events)) q")  # fmt: skip
def text_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", TEXTS.format(text="string") + " as text")
    text = F.col("text")
    allowed = F.when(F.col("event_id") % 2 == 0, F.array(*map(F.lit, ("BFV", "X", "BGV")))).otherwise(F.array(F.lit("CKKS")))
    return rows.select(
        "event_id", "text", F.nanvl(records.numeric(F.nullif(text, F.lit(""))), F.lit(None).cast("double")).alias("number"), records.usable_numeric(text).alias("is_number"), records.usable_label(text).alias("is_label"),
        records.binary_label(text, F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") != "view", "")).alias("label"),
        F.array_join(F.array_sort(F.array_intersect(F.array(*map(F.lit, ORDER)), allowed)), ",").alias("schemes"),
    )


@query(REC + """g as (select scheme, count(*) filter (status='ok')::double as a, count(*) filter (status='failed')::double as b from rec group by 1)
  select rec_ord, rec.scheme, coalesce(printf('%.12g', evaluation_seconds), '') as seconds, case when g.b=0 then '' else printf('%.6f', g.a/g.b) end as ratio from rec join g on rec.scheme=g.scheme""")
def formatted_numbers(spark, sf_dir):
    """Each record's measurement as a text of up to twelve digits, and its scheme's ratio of successes to failures, empty where it has none."""
    rows = adapters.records(spark, sf_dir)
    counts = rows.groupBy("scheme").agg(F.count_if(F.col("status") == "ok").alias("a"), F.count_if(F.col("status") == "failed").alias("b"))
    text = records.twelve_digits(F.col("evaluation_seconds")).alias("seconds")
    return rows.join(counts, "scheme").select("rec_ord", "scheme", text, records.ratio_text(F.col("a"), F.col("b")).alias("ratio"))


#: Coefficients of a model of seconds (on log1p) and of one of success, as trained ones are stored.
SECONDS, SUCCESS = [0.25, 0.004, 0.0015], [1.5, -0.01, -0.002]


@query(REC + f"""r as (select rec_ord, peak_memory_mb, ciphertext_bytes from rec where status='ok')
  select rec_ord, round(greatest(0, exp({SECONDS[0]}+peak_memory_mb*{SECONDS[1]}+ciphertext_bytes*{SECONDS[2]})-1), 6)::double as seconds,
    round(1/(1+exp(-({SUCCESS[0]}+peak_memory_mb*{SUCCESS[1]}+ciphertext_bytes*{SUCCESS[2]}))), 9)::double as probability from r""")
def model_predictions(spark, sf_dir):
    names = ["peak_memory_mb", "ciphertext_bytes"]
    rows = adapters.records(spark, sf_dir).filter("status = 'ok'")
    return rows.select("rec_ord", F.round(models.predicted(names, SECONDS), 6).alias("seconds"), F.round(models.probability(names, SUCCESS), 9).alias("probability"))


@query()
def logistic_fit(spark, sf_dir):
    """Coefficients of whether a record is of the first scheme, by its measurements. Fitted step by step, so without SQL."""
    rows = adapters.records(spark, sf_dir).filter("status = 'ok'").select((F.col("scheme") == "CKKS").cast("int").alias("y"), "peak_memory_mb", (F.col("ciphertext_bytes") / 1000).alias("kilobytes"))
    names = ["peak_memory_mb", "kilobytes"]
    fitted = models.logistic(rows, names, "y", penalty=0.01)
    return spark.createDataFrame(list(zip(["intercept", *names], fitted)), "feature string, coefficient double")
