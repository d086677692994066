"""Queries of cost models fitted on the records made from events, and their SQL, which solves the normal equations of each split by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue_plans import PLANS_SQL, SAMPLES, VARIANTS, judged
from .catalogue_records import CANON, HALVED, canonical
from .operators import cost_models
from .plans import validator
from .registry import query

#: Key bytes of this scope alone are fitted.
SCOPE = "source_defined"
#: The features that these records have; the others are 0 and so are their coefficients.
PRESENT = [n for n in cost_models.NUMERIC if n in (
    "matched_variant_count", "sample_count", "score_count", "total_pgs_variants", "ring_dimension", "multiplicative_depth", "slots_used", "window_size", "chunk_count", "ciphertext_count",
    "multiplication_count", "addition_count", "rotation_count", "key_count", "samples_per_ciphertext", "scores_per_ciphertext", "plaintext_modulus", "fixed_point_scale", "ckks_scale_bits",
    "scaling_modulus_size", "first_modulus_size",
)]
SIZE = 1 + len(PRESENT) + 3


def vector(names: dict[str, str] | None = None) -> str:
    """The features of a row in SQL, with a leading 1; ``names``: what a feature is called there, if not by its name."""
    of = lambda n: (names or {}).get(n, n if names is None else "null")
    numbers = [f"sign(coalesce({of(n)}::double,0))*ln(1+abs(coalesce({of(n)}::double,0)))" for n in PRESENT]
    return "[1.0::double, " + ", ".join(numbers) + ", " + ", ".join(f"(scheme='{s}')::int::double" for s in cost_models.SCHEMES) + "]"


SPLITS = cost_models.SPLITS
GROUPED = [n for n in SPLITS if n != "synthetic_to_real"]
LIST = "[" + ",".join(f"'{n}'" for n in SPLITS) + "]"
GROUPS = "[" + ",".join(SPLITS.values()) + "]"
ACTUAL = f"[evaluation_seconds, total_seconds, peak_memory_mb, ciphertext_bytes, case when key_bytes_scope='{SCOPE}' then key_bytes end, max_absolute_error]"
NAMES = "['evaluation_seconds','total_seconds','peak_memory_mb','ciphertext_bytes','key_bytes','max_absolute_error']"
#: Fits: what each split leaves to train on, and all rows; matrices with their right side, cleared column by column.
FITTED = CANON.replace("with raw", "with recursive raw", 1) + f""",
  tr as (select rec_ord as rn, {vector()} as x, {ACTUAL} as y, {GROUPS} as g from canon where (measurement_kind like 'measured%' or measurement_kind='validation_only') and status='ok'),
  tl as (select rn, x, unnest({NAMES}) as target, unnest(y) as actual from tr),
  gl as (select rn, unnest({LIST}) as name, unnest(g) as g from tr),
  gk as (select name, g, row_number() over (partition by name order by md5('20260728|'||g), g) as place, count(*) over (partition by name) as many from (select distinct name, g from gl where name<>'synthetic_to_real') q),
  out as (select gl.rn, gl.name, case when gl.name='synthetic_to_real' then gl.g='real' else many>1 and place<=greatest(1, round_even(many*0.2, 0)) end as held from gl left join gk on gl.name=gk.name and gl.g=gk.g),
  fit as (select 'all' as split, target, x, ln(1+greatest(0,actual)) as y from tl where actual is not null union all
    select name, target, x, ln(1+greatest(0,actual)) from tl join out on tl.rn=out.rn where actual is not null and not held),
  gram as (select split, target, i, j, sum(x[i]*case when j={SIZE + 1} then y else x[j] end) + case when i=j and i>1 then 1 else 0 end as v from fit,
    (select unnest(range(1,{SIZE + 1})) as i) a, (select unnest(range(1,{SIZE + 2})) as j) b group by 1,2,3,4),
  rr as (select split, target, i, list(v order by j) as r from gram group by 1,2,3),
  counted as (select split, target, count(*) as n from fit group by 1,2),
  cleared as (select 0::bigint as k, split, target, list(r order by i) as m from rr group by 1,2,3 union all
    select k+1, split, target, list_transform(range(1,{SIZE + 1}), lambda i: case when i=k+1 then list_transform(m[k+1], lambda v: v/m[k+1][k+1])
      else list_transform(range(1,{SIZE + 2}), lambda j: m[i][j]-m[i][k+1]/m[k+1][k+1]*m[k+1][j]) end) from cleared where k<{SIZE}),
  model as (select split, target, list_transform(range(1,{SIZE + 1}), lambda i: m[i][{SIZE + 1}]) as b from cleared where k={SIZE})"""
#: Where each of the library's features is in the vector of the SQL; 0: nowhere.
PLACES = [1, *[PRESENT.index(n) + 2 if n in PRESENT else 0 for n in cost_models.NUMERIC], *range(SIZE - 2, SIZE + 1)]


@query(FITTED + f""" select target, n, (k-1)::int as position, {["intercept", *cost_models.NAMES]}[k] as feature, round(case when {PLACES}[k]=0 then 0 else b[{PLACES}[k]] end, 5)::double+0 as coefficient
  from model join counted using (split, target), (select unnest(range(1,{len(PLACES) + 1})) as k) u where split='all'""")
def cost_model_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regressions of all targets, fitted out of one pass: a row for each coefficient, as they are stored."""
    fits = cost_models.train(canonical(spark, sf_dir), SCOPE)
    every = fits.select("target", "n", F.posexplode(F.concat(F.array("intercept"), "coefficients")).alias("position", "coefficient"))
    name = F.element_at(F.array(*map(F.lit, ["intercept", *cost_models.NAMES])), F.col("position") + 1)
    return every.select("target", "n", "position", name.alias("feature"), (F.round("coefficient", 5) + 0.0).alias("coefficient"))


PREDICTED = f"greatest(0, exp(round(list_dot_product(x, b), {cost_models.DIGITS}))-1)"


@query(FITTED + f""" select tl.rn as rec_ord, model.target, round(actual,4)::double as actual, round({PREDICTED}, 3)::double as predicted from tl join model on tl.target=model.target and split='all' where actual is not null""")
def cost_model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the models say of the records that they were fitted on, by a join with the table of models."""
    rows = canonical(spark, sf_dir)
    fits = cost_models.train(rows, SCOPE)
    rows = cost_models.of_scope(cost_models.records.for_training(rows).filter("status = 'ok'"), SCOPE)
    actual = F.create_map(*[x for t in cost_models.TARGETS for x in (F.lit(t), cost_models.number(rows, t))])
    scored = cost_models.scored(rows.withColumn("measured", actual), fits, ["rec_ord", "measured"])
    scored = scored.withColumn("actual", F.element_at("measured", F.col("target"))).filter("actual is not null")
    return scored.select("rec_ord", "target", F.round("actual", 4).alias("actual"), F.round("predicted", 3).alias("predicted"))


@query(FITTED + f""",
  known as (select name, count(distinct g) as k from (select unnest({LIST}) as name, unnest({GROUPS}) as g from canon) q where g<>'' and (name<>'synthetic_to_real' or g in ('synthetic','real')) group by 1),
  heads as (select s.name, s.group_key, coalesce(k,0)>=2 as ok, count(*) filter (not held) as train_rows, count(*) filter (held) as test_rows
    from (select unnest({LIST}) as name, unnest({[*SPLITS.values()]}) as group_key) s left join known on s.name=known.name left join out on s.name=out.name group by 1,2,3),
  pairs as (select name, tl.target, actual, x, held, bool_or(held) over (partition by name, tl.target) as tested from tl join out on tl.rn=out.rn where actual is not null),
  p as (select name, pairs.target, tested, actual, {PREDICTED} as predicted from pairs join model on pairs.name=model.split and pairs.target=model.target where held=tested),
  ranked as (select *, rank() over (partition by name, target order by actual)+(count(*) over (partition by name, target, actual)-1)/2.0 as ra,
    rank() over (partition by name, target order by predicted)+(count(*) over (partition by name, target, predicted)-1)/2.0 as rb from p),
  m as (select name, target, case when bool_or(tested) then 'test' else 'train' end as measured_on, count(*) as n, avg(abs(predicted-actual)) as mae, sqrt(avg((predicted-actual)*(predicted-actual))) as rmse,
    coalesce(avg(case when actual<>0 then abs((predicted-actual)/actual) end),0) as mape, case when var_pop(actual)>0 then 1-sum((predicted-actual)*(predicted-actual))/(var_pop(actual)*count(*)) else 0 end as r2,
    case when var_pop(ra)>0 and var_pop(rb)>0 then corr(ra, rb) else 0 end as spearman from ranked group by 1,2)
  select heads.name, group_key, case when ok then 'ok' else 'unavailable' end as status, case when ok then null when heads.name='synthetic_to_real' then 'both synthetic and real source domains are required'
      else 'at least two non-empty groups are required' end as reason, case when ok then train_rows else 0 end as train_rows, case when ok then test_rows else 0 end as test_rows, target, measured_on, n,
    round(mae,3)::double as mae, round(rmse,3)::double as rmse, round(mape,3)::double as mape, round(r2,3)::double as r2, round(spearman,3)::double as spearman
  from heads left join m on heads.name=m.name and ok""")
def cost_model_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well models fitted without the groups of a split predict those: all seven splits, fitted by subtraction from one pass."""
    rows = cost_models.evaluate_splits(canonical(spark, sf_dir), SCOPE)
    return rows.withColumns({c: F.round(c, 3) for c in ("mae", "rmse", "mape", "r2", "spearman")})


#: What predictions may rule plans out for.
MOST = {"peak_memory_mb": 150.0, "total_seconds": 60.0, "max_absolute_error": 0.01}
PLAN_NAMES = {
    "matched_variant_count": str(VARIANTS), "sample_count": str(SAMPLES), "ring_dimension": "ring", "multiplicative_depth": "depth", "slots_used": '"window"', "window_size": '"window"',
    "chunk_count": "chunk_count", "ciphertext_count": f"{SAMPLES}*pieces", "multiplication_count": f"{SAMPLES}*pieces", "addition_count": f"{SAMPLES}*(turns+greatest(pieces-1,0))", "rotation_count": f"{SAMPLES}*turns",
    "samples_per_ciphertext": "samples_each", "scores_per_ciphertext": "scores_each", "plaintext_modulus": "modulus", "fixed_point_scale": "fixed_scale", "ckks_scale_bits": "scale_bits",
    "scaling_modulus_size": "scaling_modulus_size", "first_modulus_size": "first_modulus_size",
}
GIVEN = ["evaluation_seconds", "total_seconds", "peak_memory_mb", "ciphertext_bytes", "key_bytes", "max_absolute_error", "max_relative_error", "success_probability", "feasible_probability"]


@query(FITTED + ", " + PLANS_SQL.removeprefix("with ") + f""",
  w0 as (select * exclude ({', '.join(GIVEN)}), greatest(1, per_ciphertext) as each from j),
  w1 as (select *, ({VARIANTS}+each-1)//each as pieces, ({VARIANTS}//each)*({HALVED.format('each')}) + ({HALVED.format(f'({VARIANTS}%each)')}) as seq from w0),
  w2 as (select *, case when aggregation='add_then_reduce' and pieces>0 then {HALVED.format('each')} else seq end as turns from w1),
  v as (select plan_id, workload, issues, {vector(PLAN_NAMES)} as x from w2),
  pr as (pivot (select plan_id, workload, issues, target, round({PREDICTED}, 4) as p from v, model where split='all') on target in {tuple(cost_models.TARGETS[:6])} using first(p)),
  rs as (select *, case when len(issues)>0 then issues else list_filter([case when peak_memory_mb>{MOST['peak_memory_mb']} then 'predicted_memory_exceeded' end,
    case when total_seconds>{MOST['total_seconds']} then 'predicted_latency_exceeded' end, case when max_absolute_error>{MOST['max_absolute_error']} then 'predicted_absolute_error_exceeded' end], lambda x: x is not null) end as reasons from pr),
  ob as (select plan_id, workload, issues, reasons, unnest(['evaluation_latency','total_latency','memory','ciphertext_size','key_size','balanced_multi_objective']) as objective,
    unnest([evaluation_seconds, total_seconds, peak_memory_mb, ciphertext_bytes, key_bytes, round(ln(1+coalesce(evaluation_seconds,0))+ln(1+coalesce(peak_memory_mb,0))
      +ln(1+coalesce(ciphertext_bytes,0))+ln(1+coalesce(key_bytes,0))+ln(1+coalesce(max_absolute_error,0)),6)]) as s from rs),
  rk as (select plan_id, workload, objective, array_to_string(reasons, ',') as reasons, case when len(issues)=0 then s end::double as score, len(reasons)=0 as feasible from ob)
  select *, (row_number() over (partition by workload, objective order by not feasible, score nulls last, plan_id))::int as rank from rk""")
def rank_by_cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans ranked by what models fitted on the records say of them, for each workload and objective."""
    fits = cost_models.train(canonical(spark, sf_dir), SCOPE)
    rows = cost_models.of_plans(judged(spark, sf_dir).drop(*GIVEN), SAMPLES, VARIANTS)
    rows = cost_models.with_predictions(rows, fits)
    known = [r["target"] for r in fits.select("target").collect()]
    rows = rows.withColumns({t: F.round(F.col(t), 4) if t in known else F.lit(None).cast("double") for t in [*cost_models.TARGETS, *cost_models.LABELS.values()]})
    ranked = validator.ranked_by_objectives(rows, MOST, ["workload"], "plan_id")
    return ranked.select("plan_id", "workload", "objective", F.array_join("reasons", ",").alias("reasons"), "score", (F.size("reasons") == 0).alias("feasible"), "rank")
