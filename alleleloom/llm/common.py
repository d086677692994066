"""What several of these operators share: scratch tables, word counts, row numbers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, wherever a contract speaks of words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only where there is none and the master is local (tests on one machine) a temporary one is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[[^\]]*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; what is written there goes when the session ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)  # only what is there can be marked for deletion
    files.deleteOnExit(folder)
    return f"{folder.toString()}/of"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again, its lineage cut.

    A written table is computed once (a checkpoint would compute it a second time) and its columns are read singly.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keys(*values: Column) -> tuple[Column, Column]:
    """128 bits, as two longs, that tell rows apart by ``values``."""
    return F.xxhash64(*values).alias("k1"), F.xxhash64(F.lit(0x5DEECE66D), *reversed(values)).alias("k2")


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_offsets(units: DataFrame, bucket: str, order: list[str], copies: str, within: list[str] = ()) -> DataFrame:
    """Adds ``before``: how many rows (``copies`` summed) precede a unit, counting ``within`` each group.

    ``bucket`` is a column of few values known beforehand (a hash modulo a constant). Rows are ordered
    by bucket, then by ``order``: only the rows of one bucket are sorted together, and only one count for
    each bucket and group is summed up across buckets, so no task sees a whole group.
    """
    by = list(within)
    counts = units.groupBy(*by, bucket).agg(F.sum(copies).alias("__n"))
    ahead = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, bucket, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        units.withColumn("__in", F.coalesce(F.sum(copies).over(inside), F.lit(0)))
        .join(starts, [*by, bucket])
        .withColumn("before", (F.col("__start") + F.col("__in")).cast("long"))
        .drop("__start", "__in")
    )


#: So many copies of a row are made at once; rows with more are dealt out in blocks of as many.
BLOCK = 1 << 16


def each_copy(units: DataFrame, copies: str, number: str, most: int) -> DataFrame:
    """One row for each of ``copies`` equal rows, numbered from 0 in ``number``; ``most`` is the greatest number of copies.

    Where a row has more than BLOCK copies, blocks of them are dealt out before they are made, so that no task makes, or
    holds, all copies of a row.
    """
    rows = units.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(BLOCK).cast("long"))))
    if most > BLOCK:
        # With a number, as few rows that will be many aren't put together again.
        rows = rows.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*rows.columns))
    last = F.least(F.col("__block") + BLOCK, F.col(copies)) - 1
    return rows.withColumn(number, F.explode(F.sequence(F.col("__block"), last))).drop(copies, "__block")


#: A table of so few rows, each of a few numbers and a short key, may be broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df``, which must have been cut or written, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
