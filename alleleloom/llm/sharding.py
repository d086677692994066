"""Sharding by a Feistel permutation of global row numbers.

Rows get numbers 0 to N - 1 from their contents alone; a keyed Feistel network over the next power of four
permutes the numbers, and whoever lands at N or above is sent through again (cycle walking) until it is
below. The permuted number modulo the shards is the shard, divided by it the slot: anyone who has a row's
number and the key can compute both, and the inverse leads back to the row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, each_copy, table, with_offsets

#: Rows are numbered bucket by bucket; this many buckets, so at 10^11 rows each sorts 6 million.
BUCKETS, ROUNDS = 16384, 6


def feistel(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0 to ``n`` - 1 chosen by ``seed``, applied to an array of such numbers."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, ROUNDS).astype(np.uint64)

    def mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ mixed(left, key), left
            else:
                left, right = right, left ^ mixed(right, key)
        return (left << shift) | right

    out = once(numbers.astype(np.uint64))
    while (over := out >= np.uint64(n)).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for every row; the shards' counts are at most one apart.

    Row numbers follow the contents (id, size, checksum), so reruns and other partitionings agree. Rows
    equal in all three are counted first and numbered in turn; which of them gets which number makes no
    difference. A null text has no bytes (size 1, checksum 0); null ids are numbered like others. Very long texts
    are only measured. No rows, no result rows. Other columns are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    units = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    units = units.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    units = cut(units.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(BUCKETS))))
    n, most = (x or 0 for x in units.agg(F.sum("copies"), F.max("copies")).first())

    @F.pandas_udf("long")
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel(numbers.to_numpy(), n, seed))

    rows = each_copy(with_offsets(units, "bucket", ["doc_id", "size", "text_crc32"], "copies"), "copies", "copy", most)
    rows = rows.withColumn("row_number", F.col("before") + F.col("copy")).withColumn("place", permuted("row_number"))
    return rows.select(
        "doc_id", "size", "text_crc32", "row_number",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
    )


def op2_shard(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
