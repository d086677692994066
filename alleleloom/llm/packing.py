"""Packing into optimal length buckets.

A histogram of all lengths, each with a bin of its own, is counted by Spark; dynamic programming over it chooses the bucket boundaries
that need the least padding, and batches of at most a token budget form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, each_copy, table, with_offsets, word_count

#: Rows of a bucket are numbered piece by piece, so that no task sorts a whole bucket.
PIECES = 1024


def choose_boundaries(edges: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` of the ascending ``edges``, the last included, that pad the rows least.

    Padding to the boundaries is (boundary times rows) summed; the lengths themselves don't depend on the
    choice. cost[k][j] is the least for the first j bins in k buckets; the best split for j never lies
    before the best for a smaller j, so each row of the table is filled by halves.
    """
    m, total = len(edges), np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    top = np.asarray(edges, dtype=np.float64)
    if not m:
        return []
    cost, splits = total[1:] * top, []
    for _ in range(1, min(buckets, m)):
        new, split = np.empty(m), np.zeros(m, dtype=np.int64)
        todo = [(0, m - 1, 0, m - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            # The last bucket holds bins i to mid; i = 0 leaves no bucket before it.
            i = np.arange(first, min(last, mid) + 1)
            tried = np.where(i > 0, cost[i - 1], 0.0) + (total[mid + 1] - total[i]) * top[mid]
            best = int(tried.argmin())
            new[mid], split[mid] = tried[best], i[best]
            todo += [(lo, mid - 1, first, int(i[best])), (mid + 1, hi, int(i[best]), last)]
        cost = new
        splits.append(split)
    out, j = [], m - 1
    for split in reversed(splits):
        if j < 0:
            break
        out.append(edges[j])
        j = int(split[j]) - 1
    if j >= 0:
        out.append(edges[j])
    return sorted(set(out))


def pack(docs: DataFrame, buckets: int = 8, budget: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, bucket, pad_to, batch_id, slot, n_pad for every row.

    A row's tokens are its words. It goes to the first bucket whose boundary ``pad_to`` is at least that; a
    batch holds up to budget // pad_to rows of one bucket (one, where a row alone is longer than the budget),
    ``slot`` counts them from 0. Rows of a bucket are ordered by their contents, so reruns agree.

    Rows without words or with a null text have length 0 and lie in the first bucket. Equal rows are counted
    first and numbered in turn; very long texts are only counted. No rows, no result rows. Other columns are not read, whatever their names.
    """
    units = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("n_tokens"))
    units = cut(units.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies")))
    # d different lengths need at least d * (d - 1) / 2 words: 100,000 of them have 5 * 10^9, so the histogram fits the driver.
    histogram = units.groupBy("n_tokens").agg(F.sum("copies").alias("n"), F.max("copies").alias("most")).orderBy("n_tokens").collect()
    bounds = choose_boundaries([r["n_tokens"] for r in histogram], [r["n"] for r in histogram], buckets)
    if not bounds:
        bounds = [0]
    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket)
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens").cast("string")))
    piece = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % PIECES
    units = units.withColumn("bucket", bucket.cast("int")).withColumn("piece", piece)
    rows = each_copy(with_offsets(units, "piece", ["doc_id", "n_tokens"], "copies", within=["bucket"]), "copies", "copy", max((r["most"] for r in histogram), default=0))
    pad_to = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    rows = rows.withColumn("pad_to", pad_to).withColumn("fits", F.greatest(F.floor(F.lit(budget) / F.greatest("pad_to", F.lit(1))), F.lit(1)).cast("long"))
    number = F.col("before") + F.col("copy")
    return rows.select(
        "doc_id", "n_tokens", "bucket", "pad_to",
        F.floor(number / F.col("fits")).cast("long").alias("batch_id"), (number % F.col("fits")).alias("slot"),
        (F.col("pad_to") - F.col("n_tokens")).alias("n_pad"),
    )


def op6_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def levels(buckets: int) -> str:
    """The tables of the dynamic programming in SQL: c1, c2 and so on, and b1 to b``buckets``, the numbers of the boundaries' lengths or -1."""
    out = ["c1 as (select i as j, upto * n as cost, 0 as split from t)"]
    for k in range(2, buckets + 1):
        out.append(f"""c{k} as (select j, min(cost) as cost, min_by(i, (cost, i)) as split from (select b.i as j, a.i as i, coalesce(p.cost, 0) + (b.upto - (a.upto - a.c)) * b.n as cost
    from t b join t a on a.i <= b.i left join c{k - 1} p on p.j = a.i - 1) x group by j)""")
    out.append(f"b{buckets} as (select max(i) as j from t)")
    out += [f"b{k} as (select coalesce((select split - 1 from c{k + 1} where c{k + 1}.j = (select b{k + 1}.j from b{k + 1})), -1) as j)" for k in range(buckets - 1, 0, -1)]
    return ", ".join(out)


#: The same packing in DuckDB's SQL, with the dynamic programming over all pairs of lengths.
OP6_SQL = rf"""
with u as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n, count(*) as copies from documents group by 1, 2),
t as (select n, c, row_number() over (order by n) - 1 as i, sum(c) over (order by n) as upto from (select n, sum(copies)::double as c from u group by 1) h),
{levels(8)},
bounds as (select distinct t.n as pad_to from t join ({' union all '.join(f'select j from b{k}' for k in range(1, 9))}) b on t.i = b.j),
named as (select pad_to, (row_number() over (order by pad_to) - 1)::int as bucket, lag(pad_to, 1, -1) over (order by pad_to) as above from bounds),
placed as (select doc_id, n, bucket, pad_to, greatest(8192 // greatest(pad_to, 1), 1) as fits,
    row_number() over (partition by bucket order by ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || n), 1, 8))::bigint % 1024, doc_id nulls first, n) - 1 as number
  from u join named on n > above and n <= pad_to, unnest(range(copies)))
select doc_id, n as n_tokens, bucket, pad_to, number // fits as batch_id, number % fits as slot, pad_to - n as n_pad from placed
"""
