"""Filter interaction audit: what each filter removes in every order of the filters.

Spark reduces the documents to cells: how many there are for each part and each set of filters that they fail. A part's cells
are then walked through all orders of the filters by single swaps of neighbours (plain changes). A swap concerns two steps, and of what
is kept only the number between them, which is summed up anew from the cells; all other steps stand as they are. A filter's Shapley sum grows along the
walk: whenever its step changes, what it removed goes in as often as there were orders with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: All orders are listed, so there may be this many filters; 8 have 40,320 orders.
MOST = 8


def swaps(n: int) -> Iterator[int]:
    """Places k such that swapping what is at k and k + 1, one after the other, visits each order of ``n`` things once."""
    if n < 2:
        return
    others, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        k = next(others, None)
        if k is None:
            return
        yield k + down  # the last thing is in front now, so the others have moved on by one
        down = not down


def walk(cells: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """A row for each order of the filters and step, from one part's cells (mask, n, good, toxic)."""
    masks, counts, n = cells["mask"].to_numpy(np.int64), cells[["n", "good", "toxic"]].to_numpy(np.int64), len(names)
    fails = [counts[(masks >> f) & 1 == 1, 0].sum() for f in range(n)]
    alone = [counts[masks == 1 << f, 0].sum() for f in range(n)]
    order, before = list(range(n)), [(1 << k) - 1 for k in range(n + 1)]  # before: the filters of the first k steps, as a mask
    kept = [counts[masks & b == 0].sum(axis=0) for b in before]
    shapley, since, rows = [0] * n, [0] * n, []

    def settle(k: int, now: int) -> None:
        shapley[order[k]] += int(kept[k][0] - kept[k + 1][0]) * (now - since[order[k]])
        since[order[k]] = now

    turns, now = swaps(n), 0
    while True:
        text = "".join(names[f] for f in order)
        for k, f in enumerate(order):
            removed, good, toxic = (kept[k] - kept[k + 1]).tolist()
            rows.append((text, k + 1, f, int(kept[k + 1][0]), removed, int(fails[f]) - removed, int(alone[f]), good, toxic))
        k, now = next(turns, None), now + 1
        if k is None:
            break
        settle(k, now)
        settle(k + 1, now)
        order[k], order[k + 1] = order[k + 1], order[k]
        before[k + 1] = before[k] | 1 << order[k]
        kept[k + 1] = counts[masks & before[k + 1] == 0].sum(axis=0)
    for k in range(n):
        settle(k, now)
    out = pd.DataFrame(rows, columns=["filter_order", "step", "f", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
    out["shapley"] = out["f"].map(dict(enumerate(shapley)))
    out["filter"] = out.pop("f").map(dict(enumerate(names)))
    return out


FIELDS = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(cells: DataFrame, names: list[str]) -> DataFrame:
    """FIELDS for each part, order of the filters and step, from cells: part, mask (bit k: fails filter k), n, good, toxic, one row for each part and mask."""
    if not 0 < len(names) <= MOST:
        raise ValueError(f"from 1 to {MOST} filters can be audited")

    def walked(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return walk(rows, names).assign(part=part[0])[[f.split()[0] for f in FIELDS.split(", ")]]

    return cells.groupBy("part").applyInPandas(walked, FIELDS)


def mask_of(failures: list[Column]) -> Column:
    """The failures of a row as the bits of a whole number, the first one's as the lowest."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures)])


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """What fails a document by its text alone: few words, few different words, many capitals, odd signs."""
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), "C": 100 * capitals > 10 * F.char_length(text), "D": text.rlike("[#$%&*|]"),
    }


def document_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic) of the filters A to E; E fails a text that a smaller id has too.

    Texts are compared by their SHA-256. The rows of a text are reduced to one for each part before those of all parts meet, so a
    text that a third of all rows has is a few rows by then; no row is joined to its copies.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask_of(list(text_failures(F.col("text"), F.col("words")).values())).alias("mask"))
    units = rows.groupBy("digest", "mask", "part", "doc_id").agg(F.count(F.lit(1)).alias("n"))

    yes = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"), F.lit(False).alias("unnamed")
    )
    named = units.withColumn("unnamed", F.col("doc_id").isNull()).withColumn("key", F.coalesce("doc_id", F.xxhash64("digest")))  # rows without id are spread out
    of = lambda c: F.when(F.col(c), F.col("n")).otherwise(F.lit(0).cast("long")).alias(c)
    units = named.join(yes, ["key", "unnamed"], "left").select("digest", "mask", "part", "doc_id", "unnamed", "n", of("good"), of("toxic"))

    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    least = F.min(F.struct("unnamed", "doc_id", "n", "good", "toxic")).alias("least")
    of_part = units.groupBy("digest", "mask", "part").agg(*sums, least)
    first = F.min(F.struct("least.unnamed", "least.doc_id")).over(Window.partitionBy("digest"))  # one row for each part that has the text
    of_part = of_part.withColumn("is_first", F.struct("least.unnamed", "least.doc_id").eqNullSafe(first))
    fine = {c: F.when(F.col("is_first"), F.col(f"least.{c}")).otherwise(F.lit(0).cast("long")) for c in ("n", "good", "toxic")}
    twice = F.array(
        F.struct(F.col("mask"), *[v.alias(c) for c, v in fine.items()]), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), *[(F.col(c) - v).alias(c) for c, v in fine.items()])
    )
    cells = of_part.select("part", F.inline(twice)).groupBy("part", "mask").agg(*sums)
    return cells


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """FIELDS for each part and all 120 orders of the filters A to E.

    A null text is an empty one and a null part an empty string; very long texts are read whole, row by row. A null id comes after all
    others: its text fails E if any other id has it, and fails no other's. Rows equal in id and text don't fail each other. A document is good or
    toxic if any row of ``labels`` says so; labels without id count for nothing. Ties don't arise: counts alone are returned. No rows,
    no result rows. Other columns are not read, whatever their names.
    """
    return audit(document_cells(docs, labels, id_col, text_col, part_col), list("ABCDE"))


def op13_audit(spark, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as first from d),
m as (select doc_id, part, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, first is not null)::int as mask from w),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by 1),
cells as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m left join l on m.doc_id = l.doc_id group by 1, 2),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as bit),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, step, bits[step] as bit, list_sum(bits[1:step]) - bits[step] as before, filter_order[step] as filter from o, (select unnest([1, 2, 3, 4, 5]) as step) x),
r as (select part, filter_order, step::int as step, filter, coalesce(sum(n) filter (mask & (before | bit)::int = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & before::int = 0 and mask & bit <> 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & before::int <> 0 and mask & bit <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & before::int = 0 and mask & bit <> 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (mask & before::int = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
  from cells, s group by 1, 2, 3, 4)
select *, (sum(removed) over (partition by part, filter))::bigint as shapley from r
"""
