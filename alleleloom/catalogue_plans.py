"""Queries of whole plans, one made from each part, and their SQL: issues, ranks, ablations and the choice among measured plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import slots
from .plans import space, suggestions, validator
from .registry import query, table
from .sources import adapters

#: The workload that the plans are for.
SAMPLES, VARIANTS, LOW, HIGH, SUM_ABS, MOST_MB = 4, 5000, 0.0, 2.0, 30.0, 1000.0
MODULI = [2147352577, 65535, 7919, 2]
PRIMES = "2147352577,7919,2"

#: One plan from each part, sound but for one choice, which p_partkey % 31 picks. The same for Spark and DuckDB.
PLANS = """
select plan_id, workload, cast(scheme as {text}) as scheme, ring, security_bits, slot_count, "window", batch_size, per_ciphertext, chunk_count, feature_packing,
  sample_packing, cast(1 as bigint) as samples_each, score_packing, scores_each, rotation_text, depth, aggregation, reduction, key_switching,
  case when near then scaling_technique end as scaling_technique, case when near then scale_bits end as scale_bits,
  case when near then scaling_modulus_size end as scaling_modulus_size, case when near then first_modulus_size end as first_modulus_size,
  case when near then null else fixed_scale end as fixed_scale, case when near then null else modulus end as modulus, imputed,
  case when plan_id%11=0 then null else size_+ring/8192.0 end as evaluation_seconds, size_*2.0 as total_seconds, size_*25.0 as peak_memory_mb,
  cast(plan_id%97*1000 as double) as ciphertext_bytes, case when plan_id%13=0 then null else cast(plan_id%89*500 as double) end as key_bytes,
  size_/20000.0 as max_absolute_error, size_/10000.0 as max_relative_error, plan_id%10/10.0 as success_probability,
  case when plan_id%4=0 then null else plan_id%9/9.0 end as feasible_probability
from (select y.*, cast(case when k=3 then 7 else 0 end as bigint) as slot_count,
    cast(case when k=4 then (case when near then ring/2 else ring end)+1 when k=5 then 0 when k=0 then 4096 else 1024 end as bigint) as "window",
    cast(case when k=7 then 5 else 0 end as bigint) as batch_size, cast(case when k=6 then 0 else 1024 end as bigint) as per_ciphertext,
    cast(case when k=8 then 3 when k=6 then 5000 else 5 end as bigint) as chunk_count, k<>9 as feature_packing, k=10 as sample_packing, k=20 as score_packing,
    cast(case when k=11 then 2 else 1 end as bigint) as scores_each,
    case when k=12 then '1,2,4' when k=13 then '1,2,4,8,16,32,64,128,256,512,3' else '1,2,4,8,16,32,64,128,256,512' end as rotation_text,
    cast(case when k=14 then 0 else 1 end as bigint) as depth, case when k=15 then 'other' when plan_id%2=0 then 'add_then_reduce' else 'reduce_then_add' end as aggregation,
    case when k=17 then 'other' when plan_id%5=0 then 'eval_sum' else 'binary_tree' end as reduction, case when k=18 then 'X' else 'hybrid' end as key_switching,
    case when k=19 then 'none' when k=20 then null else 'FLEXIBLEAUTO' end as scaling_technique,
    cast(case when k=21 then 10 when k=22 then 55 when k=23 then null else 40 end as bigint) as scale_bits,
    cast(case when k=23 then null else 50 end as bigint) as scaling_modulus_size, cast(case when k=24 then 30 when k=25 then null else 60 end as bigint) as first_modulus_size,
    cast(case when k=26 then 0 when k=27 then 100000000 else 1000 end as bigint) as fixed_scale,
    cast(case when k=28 then 2 when k=30 then 65535 when k=0 then 7919 else 2147352577 end as bigint) as modulus, k=16 as imputed
  from (select x.*, scheme='CKKS' as near, cast(case when k=1 then 3000 when k=29 then 8192 else 16384 end as bigint) as ring,
      cast(case when k=2 then 192 else 128 end as bigint) as security_bits
    from (select p_partkey as plan_id, p_brand as workload, p_partkey%31 as k, cast(p_size as double) as size_,
        case p_partkey%3 when 0 then 'CKKS' when 1 then 'BFV' else 'BGV' end as scheme from {part}) x) y) z
"""


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(PLANS.replace("{text}", "string").replace('"window"', "`window`"), part=table(spark, sf_dir, "part"))
    return validator.with_primes(rows.withColumn("rotations", F.split("rotation_text", ",").cast("array<bigint>")))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans(spark, sf_dir).withColumn("issues", validator.issues(SAMPLES, VARIANTS, LOW, HIGH, SUM_ABS, most_mb=MOST_MB))


PLANS_SQL = "with pl as (" + PLANS.format(text="varchar", part="part") + f"""),
  b0 as (select *, string_split(rotation_text, ',')::bigint[] as rot, scheme='CKKS' as near, case when scheme='CKKS' then ring//2 else ring end as cap,
    case when scheme='CKKS' then coalesce(first_modulus_size,60)+coalesce(scaling_modulus_size,scale_bits,50)*greatest(1,depth+1) else 60*greatest(2,depth+1) end as bits,
    case ring when 8192 then 218 when 16384 then 438 end as lim, coalesce(scale_bits, scaling_modulus_size) as sc, coalesce(modulus,0) as m, coalesce(fixed_scale,0) as fx from pl),
  j as (select *, list_filter([
    case when security_bits<>128 then 'unsupported_security_profile' end, case when bit_count(ring)<>1 or ring<1024 then 'invalid_ring_dimension' end,
    case when slot_count not in (0,cap) then 'slot_count_mismatch' end, case when "window"<=0 or "window">cap then 'window_exceeds_slots' end,
    case when per_ciphertext<=0 or per_ciphertext>cap then 'variants_per_ciphertext_invalid' end, case when batch_size not in (0,"window") then 'batch_window_mismatch' end,
    case when chunk_count<>greatest(1,ceil({VARIANTS}/greatest(1,per_ciphertext)::double)) then 'chunk_count_mismatch' end,
    case when not feature_packing then 'unsupported_non_feature_packing' end, case when sample_packing or samples_each<>1 then 'unsupported_sample_packing' end,
    case when score_packing or scores_each<>1 then 'unsupported_score_packing' end,
    case when len(list_filter([1,2,4,8,16,32,64,128,256,512,1024,2048,4096], lambda i: i<least({VARIANTS},per_ciphertext) and not list_contains(rot,i)))>0 then 'missing_rotation_keys' end,
    case when len(list_filter(rot, lambda i: i<=0 or i>=cap or bit_count(i)<>1))>0 then 'invalid_rotation_index' end,
    case when depth<1 then 'insufficient_multiplicative_depth' end, case when aggregation not in ('reduce_then_add','add_then_reduce') then 'unsupported_chunk_aggregation' end,
    case when reduction not in ('binary_tree','eval_sum') then 'unsupported_reduction_strategy' end, case when upper(key_switching) not in ('HYBRID','BV') then 'unsupported_key_switching_technique' end,
    case when lim is null or bits>lim then 'modulus_budget_exceeded' end,
    case when near and coalesce(scaling_technique,'FLEXIBLEAUTO') not in ('FIXEDMANUAL','FIXEDAUTO','FLEXIBLEAUTO','FLEXIBLEAUTOEXT') then 'unsupported_scaling_technique' end,
    case when near and (sc is null or sc<20) then 'ckks_scale_too_small' end, case when near and sc>scaling_modulus_size then 'ckks_scale_mismatch' end,
    case when near and first_modulus_size<sc then 'ckks_first_modulus_too_small' end, case when not near and imputed then 'unsupported_imputed_fixed_point' end,
    case when not near and fx<=0 then 'invalid_fixed_point_scale' end, case when not near and m<=2 then 'invalid_plaintext_modulus' end,
    case when not near and m>2 and m not in ({PRIMES}) then 'plaintext_modulus_not_prime' end,
    case when not near and m>2 and m in ({PRIMES}) and m%(2*ring)<>1 then 'plaintext_modulus_not_batching_compatible' end,
    case when scheme='BGV' and m>=1073741824 and ring<16384 then 'bgv_ring_dimension_below_openfhe_minimum' end,
    case when not near and fx<>0 and m<>0 and 2*ceil({HIGH * SUM_ABS}*fx+{VARIANTS}*0.5)>=m then 'fixed_point_wraparound' end,
    case when ({SAMPLES}*greatest(1,chunk_count)*3*(ring*bits/8.0)+(ring*bits/8.0)*(8+2*len(rot)))/1048576.0>{MOST_MB} then 'estimated_memory_exceeded' end
  ], lambda x: x is not null) as issues from b0)"""


@query(PLANS_SQL + " select plan_id, array_to_string(issues, ',') as issues, len(issues)=0 as valid from j")
def plan_issues(spark, sf_dir):
    return judged(spark, sf_dir).select("plan_id", F.array_join("issues", ",").alias("issues"), (F.size("issues") == 0).alias("valid"))


@query(PLANS_SQL + f" select plan_id, bits, round(({SAMPLES}*greatest(1,chunk_count)*3*(ring*bits/8.0)+(ring*bits/8.0)*(8+2*len(rot)))/1048576.0, 6)::double as memory_mb from j")
def plan_memory(spark, sf_dir):
    return plans(spark, sf_dir).select("plan_id", validator.modulus_bits().alias("bits"), F.round(validator.memory_mb(SAMPLES), 6).alias("memory_mb"))


MOST = {"peak_memory_mb": 900.0, "total_seconds": 80.0, "max_absolute_error": 0.0022, "max_relative_error": 0.0046}
RANKED_SQL = PLANS_SQL + """, rs as (select *, case when len(issues)>0 then issues else list_filter([case when peak_memory_mb>900 then 'predicted_memory_exceeded' end,
    case when total_seconds>80 then 'predicted_latency_exceeded' end, case when max_absolute_error>0.0022 then 'predicted_absolute_error_exceeded' end,
    case when max_relative_error>0.0046 then 'predicted_relative_error_exceeded' end, case when success_probability<0.5 then 'predicted_execution_failure' end,
    case when feasible_probability<0.5 then 'predicted_error_constraint_failure' end], lambda x: x is not null) end as reasons from j),
  ob as (select plan_id, workload, issues, reasons, unnest(['evaluation_latency','total_latency','memory','ciphertext_size','key_size','balanced_multi_objective']) as objective,
    unnest([evaluation_seconds, total_seconds, peak_memory_mb, ciphertext_bytes, key_bytes, round(ln(1+coalesce(evaluation_seconds,0))+ln(1+coalesce(peak_memory_mb,0))
      +ln(1+coalesce(ciphertext_bytes,0))+ln(1+coalesce(key_bytes,0))+ln(1+coalesce(max_absolute_error,0)),6)]) as s from rs),
  rk as (select plan_id, workload, objective, array_to_string(reasons, ',') as reasons, case when len(issues)=0 then s end::double as score, len(reasons)=0 as feasible from ob),
  rr as (select *, (row_number() over (partition by workload, objective order by not feasible, score nulls last, plan_id))::int as rank from rk)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validator.ranked_by_objectives(judged(spark, sf_dir), MOST, ["workload"], "plan_id")
    return rows.select("plan_id", "workload", "objective", F.array_join("reasons", ",").alias("reasons"), "score", (F.size("reasons") == 0).alias("feasible"), "rank")


@query(RANKED_SQL + " select * from rr")
def rank_by_predictions(spark, sf_dir):
    return ranked(spark, sf_dir)


@query(RANKED_SQL + " select workload, objective, plan_id, score from rr where feasible and rank=1")
def best_plan_per_workload(spark, sf_dir):
    return validator.best_by_objectives(judged(spark, sf_dir), MOST, ["workload"], "plan_id")


@query("with pl as (" + PLANS.format(text="varchar", part="part") + """) select 'no_scheme_selection' as ablation, count(*) as plans from pl where scheme='CKKS'
  union all select 'no_packing_optimization', count(*) from pl where "window"=4096 union all select 'no_chunk_strategy_optimization', count(*) from pl where aggregation='reduce_then_add'
  union all select 'no_reduction_strategy_optimization', count(*) from pl where reduction='binary_tree'
  union all select x, count(*) from pl, (select unnest(['no_learned_cost_model','no_bayesian_refinement','no_genomic_workload_features','no_top_k_actual_validation','no_error_constraint','no_fixed_point_range_validator']) as x) t group by 1""")
def plan_ablations(spark, sf_dir):
    rows, out = plans(spark, sf_dir), None
    for name in validator.ABLATIONS:
        one = validator.without(name, rows).agg(F.count(F.lit(1)).alias("plans")).select(F.lit(name).alias("ablation"), "plans")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select p_partkey, greatest(1, least(p_size, 4096//(p_partkey+1)))::bigint as block, greatest(1, 4096//p_size)::bigint as window_snps from part""")
def block_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", slots.block_size(F.col("p_partkey") + 1, F.col("p_size"), 8192).alias("block"), slots.window_size(F.col("p_size"), 8192).alias("window_snps"))


MEASURED = f"with rec as ({adapters.RECORDS}), c as (select candidate_id, scheme, round(avg(evaluation_seconds),6)::double as seconds, count(*) as n from rec where status='ok' group by 1,2), "


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.records(spark, sf_dir).filter("status = 'ok'").groupBy("candidate_id", "scheme")
    return rows.agg(F.round(F.avg("evaluation_seconds"), 6).alias("seconds"), F.count(F.lit(1)).alias("n"))


@query(MEASURED + """w as (select *, row_number() over (partition by scheme order by seconds, candidate_id) as place, (row_number() over (partition by scheme order by candidate_id)-1) as ord,
    row_number() over (partition by scheme order by (candidate_id*7919)%104729, candidate_id) as draw, min(seconds) over (partition by scheme) as least from c),
  s as (select scheme, least, 'fixed' as way, seconds, candidate_id from w where ord=0 union all select scheme, least, 'grid', seconds, candidate_id from w where ord%5=0
    union all select scheme, least, 'random', seconds, candidate_id from w where draw<=4 union all select scheme, least, 'best', seconds, candidate_id from w where place=1)
  select scheme, way, min_by(candidate_id, (seconds, candidate_id)) as candidate_id, min(seconds) as seconds, round(min(seconds)-min(least),6)::double as regret from s group by 1,2""")
def baseline_search(spark, sf_dir):
    """What each way to spend a few measurements would have found among the measured candidates of a scheme, and its regret."""
    by = Window.partitionBy("scheme")
    rows = measured(spark, sf_dir).withColumns({
        "place": F.row_number().over(by.orderBy("seconds", "candidate_id")), "ord": F.row_number().over(by.orderBy("candidate_id")) - 1,
        "draw": F.row_number().over(by.orderBy((F.col("candidate_id") * 7919) % 104729, "candidate_id")), "least": F.min("seconds").over(by),
    })
    ways = {"fixed": F.col("ord") == 0, "grid": F.col("ord") % 5 == 0, "random": F.col("draw") <= 4, "best": F.col("place") == 1}
    rows = rows.withColumn("way", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in ways.items()]))))
    found = rows.groupBy("scheme", "way").agg(F.min(F.struct("seconds", "candidate_id")).alias("f"), F.min("least").alias("least"))
    return found.select("scheme", "way", "f.candidate_id", "f.seconds", F.round(F.col("f.seconds") - F.col("least"), 6).alias("regret"))


@query(MEASURED + """p as (select *, row_number() over (partition by scheme order by n desc, candidate_id) as rank from c),
  t as (select * from p where rank<=3) select scheme, candidate_id, rank::int as predicted_rank, seconds, (row_number() over (partition by scheme order by seconds, rank))::int as measured_rank from t""")
def topk_remeasured(spark, sf_dir):
    """Of each scheme the three candidates first by rank, ranked again by what was measured; ties go by the first rank."""
    rank = F.row_number().over(Window.partitionBy("scheme").orderBy(F.desc("n"), "candidate_id"))
    rows = measured(spark, sf_dir).withColumn("predicted_rank", rank).filter("predicted_rank <= 3")
    again = F.row_number().over(Window.partitionBy("scheme").orderBy("seconds", "predicted_rank"))
    return rows.select("scheme", "candidate_id", "predicted_rank", "seconds", again.alias("measured_rank"))


@query(PLANS_SQL + """ select plan_id, case scheme when 'CKKS' then 0.0 when 'BFV' then 1.0 else 2.0 end::double as v_scheme, round(log2(ring),9)::double as v_ring,
  round(case when "window">0 then log2("window") else 0 end,9)::double as v_window, round(coalesce(scale_bits,0)/60.0,9)::double as v_scale, round(case when fixed_scale>0 then log10(fixed_scale) else 0 end,9)::double as v_fixed from j""")
def plan_vectors(spark, sf_dir):
    v = F.col("v")
    rows = plans(spark, sf_dir).select("plan_id", validator.plan_vector().alias("v"))
    return rows.select("plan_id", *[F.round(v[k], 9).alias(f"v_{n}") for k, n in enumerate(("scheme", "ring", "window", "scale", "fixed"))])


@query("with pl as (" + PLANS.format(text="varchar", part="part") + """), p as (select plan_id, scheme, ring, total_seconds from pl),
  m as (select plan_id, scheme, avg(case when l_returnflag<>'A' then l_quantity end) as measured from lineitem join p on l_partkey=plan_id group by 1,2)
  select p.plan_id, p.scheme, p.total_seconds as predicted, round(m.measured,6)::double as measured, round(m.measured-p.total_seconds,6)::double as residual,
    case when m.measured is not null then 'paired' when m.plan_id is not null then 'unavailable_failed_measurement' else 'not_measured' end as status
  from p left join m on p.plan_id=m.plan_id and p.scheme=m.scheme""")
def prediction_pairing(spark, sf_dir):
    rows = plans(spark, sf_dir).select("plan_id", "scheme", "total_seconds")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("plan_id"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("total_seconds"))
    made = lines.join(rows.select("plan_id", "scheme"), "plan_id")
    out = validator.paired(rows, made, ["plan_id", "scheme"], "total_seconds")
    return out.withColumns({"measured": F.round("measured", 6), "residual": F.round("residual", 6)})


#: Measurements of plans from the lines that have their part: each fifth plan fails, and each third has none. The same for Spark and DuckDB.
TRIALS = """
select l_partkey as plan_id, case when l_partkey%5=0 then 'failed' else 'ok' end as status, avg(case when l_partkey%5<>0 then l_quantity end) as evaluation_seconds,
  avg(case when l_partkey%5<>0 then l_quantity*2 end) as total_seconds, max(case when l_partkey%5<>0 then l_tax*10000 end) as peak_memory_mb,
  cast(count(case when l_partkey%5<>0 then 1 end)*1000 as double) as ciphertext_bytes, min(case when l_partkey%5<>0 and l_partkey%7<>0 then l_extendedprice end) as key_bytes,
  avg(case when l_partkey%5<>0 then l_discount end) as max_absolute_error from {lines} where l_partkey%3<>0 group by l_partkey
"""
TRIALS_SQL = "tm as (" + TRIALS.format(lines="lineitem") + ")"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, workload, status and metrics) of measured plans."""
    rows = spark.sql(TRIALS, lines=table(spark, sf_dir, "lineitem"))
    return rows.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("plan_id"), F.col("p_brand").alias("workload")), "plan_id")


TOP = 3
SELECTED_SQL = RANKED_SQL + ", " + TRIALS_SQL + f""",
  cp as (select rr.plan_id, rr.workload, rr.objective, rr.score, rr.rank, tm.* exclude (plan_id), case when rank<={TOP} then 'top_k_actual_validation' else 'bayesian_refinement' end as phase
    from rr left join tm on rr.plan_id=tm.plan_id where feasible and (rank<={TOP} or status is not null)),
  cl as (select *, {' and '.join(f'{m} is not null' for m in validator.BALANCED)} as whole from cp),
  cs as (select *, {', '.join(f"coalesce((ln(1+{m})-min(ln(1+{m})) filter (whole) over g)/nullif(max(ln(1+{m})) filter (whole) over g-min(ln(1+{m})) filter (whole) over g,0),0) as s_{m}" for m in validator.BALANCED)}
    from cl window g as (partition by workload, objective)),
  cm as (select *, case objective when 'evaluation_latency' then evaluation_seconds when 'total_latency' then total_seconds when 'memory' then peak_memory_mb when 'ciphertext_size' then ciphertext_bytes
      when 'key_size' then key_bytes end as single, case when whole then {'+'.join(f's_{m}' for m in validator.BALANCED)} end as balanced from cs),
  ck as (select *, case when objective='balanced_multi_objective' then balanced else single end as measured_score from cm)"""


@query(SELECTED_SQL + """ select plan_id, workload, objective, rank, phase, status, case when status is null then 'not_measured' when status='ok' and (single is not null or whole) then 'paired' else 'unavailable_failed_measurement' end as pairing,
  case when status='ok' and objective<>'balanced_multi_objective' then round(single-score,4) end::double as residual, round(measured_score,6)::double as measured_score from ck""")
def plan_trials(spark, sf_dir):
    """The first plans of each workload and objective by rank, and all others that were measured, with what was measured; failures stay."""
    rows = validator.ranked_by_objectives(judged(spark, sf_dir), MOST, ["workload"], "plan_id")
    rows = suggestions.compared(rows, trials(spark, sf_dir), ["workload"], "plan_id", TOP)
    return rows.select("plan_id", "workload", "objective", "rank", "phase", "status", "pairing", F.round("residual", 4).alias("residual"), F.round("measured_score", 6).alias("measured_score"))


@query(SELECTED_SQL + """, pick as (select workload, objective, min((round(measured_score,9), rank, plan_id, measured_score)) filter (status='ok' and measured_score is not null) as m, min((rank, plan_id)) as p,
    count(*) filter (phase='top_k_actual_validation') as top, count(*) filter (status<>'ok') as failed, count(*) filter (phase='bayesian_refinement') as refined from ck group by 1, 2)
  select a.workload, a.objective, case when m is not null then 'measured_and_validated' when p is not null then 'predicted_only_no_successful_actual_validation' else 'no_feasible_candidate' end as status,
    coalesce(m[3], p[2]) as selected, round(m[4],6)::double as measured_score, coalesce(top,0) as top, coalesce(failed,0) as failed, coalesce(refined,0) as refined
  from (select distinct workload, objective from rr) a left join pick on a.workload=pick.workload and a.objective=pick.objective""")
def plan_selection(spark, sf_dir):
    """Which plan each workload and objective ends up with, and whether it was measured or only predicted."""
    rows = validator.ranked_by_objectives(judged(spark, sf_dir), MOST, ["workload"], "plan_id")
    return suggestions.selected(rows, trials(spark, sf_dir), ["workload"], "plan_id", TOP).withColumn("measured_score", F.round("measured_score", 6))


@query()
def plan_suggestions(spark, sf_dir):
    """The sound plans of each workload without a measurement, by the improvement that a Gaussian process over all measured ones expects. Matrices have no SQL."""
    sound = judged(spark, sf_dir).filter(F.size("issues") == 0)
    tried = trials(spark, sf_dir).select("workload", "plan_id", F.col("evaluation_seconds").alias("value"))
    return suggestions.suggested(sound, tried, ["workload"], "plan_id", validator.plan_vector())


AXES = {"reduction": ["binary_tree", "eval_sum"], "key_switching": ["HYBRID", "BV"], "scaling_technique": ["FIXEDAUTO", "FLEXIBLEAUTO"], "first_bits": [50, 60]}
WHOLE_SQL = "wl as (" + adapters.WORKLOADS + """), base as (select wl.workload, wl.variants, wl.bound, s.scheme, r.ring, w.win, a.aggregation, d.reduction, k.key_switching, case when s.scheme='CKKS' then r.ring//2 else r.ring end as cap
    from wl, (select unnest(['CKKS','BFV','BGV']) as scheme) s, (select unnest([8192,16384,32768])::bigint as ring) r, (select unnest([512,1024,2048,4096])::bigint as win) w,
      (select unnest(['reduce_then_add','add_then_reduce']) as aggregation) a, (select unnest(['binary_tree','eval_sum']) as reduction) d, (select unnest(['HYBRID','BV']) as key_switching) k),
  pl as (select b.*, t.technique, x.scale_bits, f.first_bits, null as fixed_scale from base b, (select unnest(['FIXEDAUTO','FLEXIBLEAUTO']) as technique) t, (select unnest([40,50])::bigint as scale_bits) x,
      (select unnest([50,60])::bigint as first_bits) f where scheme='CKKS' and win<=cap
    union all select b.*, null, null, null, y.fixed_scale from base b, (select unnest([100000,1000000,10000000])::bigint as fixed_scale) y where scheme<>'CKKS' and win<=cap),
  wp as (select workload, variants, bound, scheme, ring, win as "window", aggregation, reduction, key_switching, technique as scaling_technique, scale_bits, first_bits as first_modulus_size, fixed_scale,
    greatest(1, ceil(variants/win::double))::bigint as chunk_count, len(list_filter(range(0,20), lambda i: (1::bigint<<i)<least(variants,win)))::bigint as n_rotations,
    round(log10(fixed_scale))::bigint as encoding_precision from pl)"""


@query(adapters.duckdb(WHOLE_SQL + " select * exclude (variants, bound) from wp"))
def candidate_plans(spark, sf_dir):
    """Every choice of a plan for each workload."""
    rows = space.whole_plans(adapters.workloads(spark, sf_dir), AXES)
    return rows.select(
        "workload", "scheme", "ring", "window", "aggregation", "reduction", "key_switching", "scaling_technique", "scale_bits", "first_modulus_size", "fixed_scale", "chunk_count",
        F.size("rotations").cast("long").alias("n_rotations"), "encoding_precision",
    )


@query(adapters.duckdb(WHOLE_SQL + """ select workload, scheme, ring, count(*) as plans, count(*) filter (case when scheme='CKKS' then first_modulus_size+2*scale_bits<=case ring when 8192 then 218 when 16384 then 438 else 881 end and first_modulus_size>=scale_bits
    else 120<=218 and not (scheme='BGV' and ring<16384) and 2*ceil(2.0*bound*fixed_scale+variants*0.5)<2147352577 end) as valid from wp group by 1, 2, 3"""))
def candidate_plans_valid(spark, sf_dir):
    rows = validator.with_primes(space.whole_plans(adapters.workloads(spark, sf_dir), AXES))
    rows = rows.withColumn("issues", validator.issues(F.col("samples"), F.col("variants"), 0.0, 2.0, F.col("bound")))
    return rows.groupBy("workload", "scheme", "ring").agg(F.count(F.lit(1)).alias("plans"), F.count_if(F.size("issues") == 0).alias("valid"))
