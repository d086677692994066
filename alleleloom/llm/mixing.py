"""Mixing sources to target weights by hash-threshold histograms.

Every row has a hash of 60 bits. The words of a source are summed by the leading bits of that hash; the
running sum shows in which bucket the source's budget ends, and only that bucket is looked at with the
next bits. A source's budget is then a threshold: the rows below it are taken, and a smaller budget takes a
subset of them. No rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, each_copy, small, table, word_count

#: Bits of a row's hash, and bits that one histogram looks at.
HASH_BITS, LEVEL_BITS = 60, 10


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source with its ``source_size``.

    The weights go round the sources by code point, a null last. ``share`` of all words is dealt out by
    weight; a target stops at ``cap`` times its source's size and the excess is dealt to the others by
    weight until none is above. In order of cap over weight, a source is stopped exactly if what those
    before it leave would fill it. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(int, weights))), (number + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    budget = F.lit(float(share)) * F.sum("source_size").over(every)
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("budget", budget)
    ranked = ranked.withColumn("full", F.col("cap") / F.col("weight") <= (F.col("budget") - before) / left)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * ((F.col("budget") - used) / open_weight))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix_to_weights(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """How often the mix takes each row: doc_id, source, size, source_size, target, times, taken.

    A source with target T and size S is taken whole floor(T / S) times; of the rest, the rows with hashes
    below its threshold once more. At the threshold itself the copies nearest to the budget are taken.

    Nulls: a text without words has size 0 and is taken 0 words, as a row as often as its hash says, up to ``cap`` times; a null source is a source of its own, last
    in order; a null id is hashed like any other value. Equal rows (id, source, text) share a hash: they are
    counted first, and as many of them are taken as the budget has room for. Very long texts are only counted. No rows, no result rows. Other
    columns are not read, whatever their names.
    """
    units, limits = budgets(docs, id_col, text_col, source_col, weights, share, cap)
    most = units.agg(F.max("copies")).first()[0] or 0
    joined = each_copy(units.join(limits, units["source"].eqNullSafe(limits["of"])).drop("of"), "copies", "copy", most)
    extra = F.when(F.col("hash") < F.col("threshold"), 1).when((F.col("hash") == F.col("threshold")) & (F.col("copy") < F.col("at")), 1).otherwise(0)
    times = (F.col("whole") + extra).cast("long")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken")
    )


def row_hash(id_col: str, text_col: str) -> Column:
    """HASH_BITS of a digest of a row's id and text."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def budgets(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """The distinct rows with their size, hash and number of copies; and one row per source with its threshold."""
    units = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(id_col, text_col).alias("hash")
        )
        .groupBy("doc_id", "source", "size", "hash")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("long")
    targets = cut(
        source_targets(sizes, weights, share, cap)
        .withColumn("whole", whole)
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    return units, small(cut(hash_thresholds(units, targets)))


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: a filter on the hash, without any shuffle of texts.

    Like mix_to_weights, but equal rows at a threshold are taken all or none, whichever is nearer to the budget.
    """
    _, limits = budgets(docs, id_col, text_col, source_col, weights, share, cap)
    limits = limits.select("of", "threshold", "whole", (2 * F.col("at") >= F.col("n")).alias("edge"))
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), row_hash(id_col, text_col).alias("hash"))
    rows = rows.join(limits, rows["source"].eqNullSafe(limits["of"]))
    extra = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("edge"))
    times = (F.col("whole") + extra.cast("int")).cast("int")
    return rows.filter(times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def hash_thresholds(units: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source (``of``): the targets' columns, ``threshold`` and ``at``.

    Rows with hashes below the threshold fit the source's ``budget``; of the copies at the threshold, the
    first ``at`` do. Each round makes a histogram of the boundary buckets alone, by the next bits.
    """
    bounds = targets.withColumnRenamed("source", "of").select("*", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("room"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        # A source whose budget was not used up by its whole histogram (prefix null) has no boundary bucket.
        inside = units.join(
            small(bounds.select("of", "prefix", "room")),
            units["source"].eqNullSafe(F.col("of")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")),
        )
        hist = inside.groupBy("of", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum(F.col("size") * F.col("copies")).alias("words"), F.first("room").alias("room")
        )
        upto = Window.partitionBy("of").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(upto)).filter(F.col("upto") > F.col("room"))
        first = hist.groupBy("of").agg(F.min_by(F.struct("bucket", (F.col("room") - (F.col("upto") - F.col("words"))).alias("room")), "bucket").alias("b"))
        first = first.select(F.col("of").alias("was"), F.col("b.bucket").alias("prefix"), F.col("b.room").alias("room"))
        kept = bounds.drop("prefix", "room")
        bounds = cut(kept.join(first, kept["of"].eqNullSafe(first["was"]), "left").drop("was"))
    edge = units.join(small(bounds.select("of", "prefix")), units["source"].eqNullSafe(F.col("of")) & (F.col("hash") == F.col("prefix")))
    edge = edge.groupBy(F.col("of").alias("was")).agg(F.sum("copies").alias("n"), F.max("size").alias("size"))
    both = bounds.join(edge, bounds["of"].eqNullSafe(edge["was"]), "left")
    at = F.least(F.floor(F.col("room") / F.col("size") + 0.5), F.col("n"))
    return both.select(
        *targets.drop("source", "budget").columns,
        "of",
        # Of a source whose whole copies use up its budget nothing more is taken, not even rows without words.
        F.when(F.col("budget") <= 0, F.lit(0)).otherwise(F.coalesce("prefix", F.lit(1 << HASH_BITS))).cast("long").alias("threshold"),
        F.when(F.col("budget") <= 0, F.lit(0)).otherwise(F.coalesce(at, F.lit(0))).cast("long").alias("at"),
        F.coalesce("n", F.lit(1)).alias("n"),
    )


def op1_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix_to_weights(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


#: The same mix in DuckDB's SQL: the threshold found by a running sum over the sorted hashes.
OP1_SQL = r"""
with units as (
  select doc_id, source, size, hash, count(*) as copies from (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
      ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 15))::bigint as hash
    from documents) group by all),
sizes as (select source, sum(size * copies)::bigint as source_size from units group by source),
ranked as (select source, source_size, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight,
  source_size * 2.0::double as cap from sizes),
filled as (select *, 1.5::double * (sum(source_size) over ())::double as budget,
  cap / weight <= (1.5::double * (sum(source_size) over ())::double
    - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as is_full
  from ranked),
targets as (select source, source_size, case when is_full then cap else weight * ((budget
    - coalesce(sum(case when is_full then cap end) over (), 0)) / (sum(case when not is_full then weight end) over ())::double) end as target
  from filled),
parts as (select *, case when source_size > 0 then least(floor(target / source_size), 2) else 0 end::bigint as whole from targets),
run as (select u.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as room,
    sum(u.size * u.copies) over (partition by u.source order by u.hash) as upto
  from units u join parts p on u.source is not distinct from p.source),
cast_run as (select *, upto::double as upto_d, (upto - size * copies)::double as below from run),
edge as (select *, case when upto_d <= room then copies when below > room then 0
    when hash = min(case when upto_d > room then hash end) over (partition by source) then least(floor((room - below) / size + 0.5), copies)
    else 0 end as extra from cast_run)
select doc_id, size, source_size, target, (size * (whole + case when c < extra then 1 else 0 end))::bigint as taken, source
from (select *, unnest(range(copies)) as c from edge)
"""
