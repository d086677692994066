"""Columns for windows of a fixed width, their masks, rotations and operation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capacity(scheme: Column, ring: Column) -> Column:
    """Slots of a plaintext: half the ring for approximate numbers, the ring for whole ones."""
    return F.when(scheme == "CKKS", F.floor(ring / 2)).when(scheme.isin("BFV", "BGV"), ring).cast("long")


def chunk_ranges(items: Column, width: Column) -> Column:
    """(start, end) of the windows that cover ``items`` in order; none for no items."""
    starts = F.sequence(F.lit(0).cast("long"), items - 1, width)
    return F.when(items > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + width, items).alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


#: Rows that are taken together, windows of a run of these and starts of it at most, and windows of a task, as long as these are not more than TASKS.
TOGETHER, RUN, STARTS, EACH, TASKS = 256, 1 << 21, 1 << 16, 1 << 21, 20_000


def chunk_rows(rows: DataFrame, items: str, width: str, keep: list[str]) -> DataFrame:
    """(``keep``, start, end): ``chunk_ranges`` of each row as rows, however many there are.

    Rows of one width and, within a factor of two, as many items are taken together, and their windows come by start. So what differs from one to
    the next is the row alone, over and over, which columnar files keep in a small part of the space. Such lists are cut into runs of RUN windows,
    or of STARTS starts, which are dealt out to as many tasks as the windows need; so no task has all those of a long row, or of a small table.
    """
    n_items, n_width = F.col(items).cast("long"), F.col(width).cast("long")
    block = F.shiftright(F.monotonically_increasing_id(), 16)  # bounds the lists, whatever the widths
    rows = rows.select(F.struct(n_items.alias("items"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)]).alias("of"), n_width.alias("width"), block.alias("block")).filter("of.items > 0")
    n = rows.agg(F.sum(F.ceil(F.col("of.items") / F.col("width")).cast("decimal(38,0)"))).first()[0]
    lists = rows.groupBy("width", F.length(F.bin("of.items")), "block").agg(F.array_sort(F.collect_list("of")).alias("all"))
    lists = lists.select("width", F.explode(F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(TOGETHER)), lambda i: F.slice("all", i, TOGETHER))).alias("list"))
    step = F.col("width") * F.least(F.ceil(F.lit(RUN) / F.size("list")), F.lit(STARTS))
    lists = lists.withColumn("last", F.element_at("list", -1)["items"] - 1).withColumn("step", step)
    runs = lists.select("width", "list", "last", "step", F.explode(F.sequence(F.lit(0).cast("long"), "last", "step")).alias("first"))
    runs = runs.repartition(min(TASKS, -(-int(n or 1) // EACH)))
    starts = F.sequence("first", F.least(F.col("first") + F.col("step") - F.col("width"), "last"), "width")
    windows = runs.select("list", F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), (s + F.col("width")).alias("end")))).alias("w"))
    each = windows.select("w", F.explode("list").alias("of")).filter("of.items > w.start")
    return each.select(*[F.col(f"of.k{i}").alias(k) for i, k in enumerate(keep)], "w.start", F.least("w.end", "of.items").alias("end"))


def chunk_count(items: Column, width: Column) -> Column:
    return F.ceil(items / width).cast("long")


def padding_mask(active: Column, slots: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), active.cast("int")), F.array_repeat(F.lit(0), (slots - active).cast("int")))


def halvings(n: Column) -> Column:
    """How many powers of two lie below n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("long")


def rotations(n: Column) -> Column:
    """The powers of two below n, ascending."""
    steps = F.sequence(F.lit(0), (halvings(n) - 1).cast("int"))
    return F.when(n > 1, F.transform(steps, lambda i: F.pow(F.lit(2.0), i).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def operation_counts(samples: Column, items: Column, width: Column, strategy: Column) -> dict[str, Column]:
    """Multiplications, rotations and additions of a weighted sum in windows, by order of aggregation."""
    chunks = chunk_count(items, width)
    tail = F.pmod(items, width)
    each = F.floor(items / width) * halvings(width) + halvings(tail)
    turns = F.when((strategy == "add_then_reduce") & (chunks > 0), halvings(width)).otherwise(each)
    return {
        "ciphertext_count": (samples * chunks).cast("long"),
        "multiplication_count": (samples * chunks).cast("long"),
        "rotation_count": (samples * turns).cast("long"),
        "addition_count": (samples * (turns + F.greatest(chunks - 1, F.lit(0)))).cast("long"),
    }


def block_size(variants: Column, preferred: Column, degree: int) -> Column:
    """Samples in a packed block: as many as preferred, or as fit half the degree, but one at least."""
    return F.greatest(F.lit(1), F.least(preferred, F.floor(degree // 2 / variants))).cast("long")


def window_size(preferred: Column, degree: int) -> Column:
    """Variants in a window of blocks of the preferred size."""
    return F.greatest(F.lit(1), F.floor(degree // 2 / preferred)).cast("long")
