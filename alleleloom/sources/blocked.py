"""Lines of block-compressed text files (.gz or .bgz in members of up to 64 KB), read by several tasks a file.

A member is a record of Spark's text reader: what stands between two of the fixed 16-byte headers. So files are split as
uncompressed ones are, wherever Spark can read them. A line that goes on in a later split is put together from both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The first 16 bytes of each member as such files are written; two bytes of the member's length less one follow.
HEADER = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
#: A codec that changes nothing, for names that no file has: with it, names ending in .gz have no codec, and files are read as they are.
AS_IT_IS = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"}
AS_IT_IS |= {f"{prefix}io.compress.passthrough.extension": ".!.gz" for prefix in ("", "org.apache.hadoop.shaded.")}
AS_IT_IS |= {"encoding": "ISO-8859-1", "lineSep": HEADER.decode("latin-1")}


def is_blocked(spark: SparkSession, file: str) -> bool:
    """Whether a file begins with a member's header; only names ending in .gz or .bgz are looked into."""
    if not file.endswith((".gz", ".bgz")):
        return False
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.getFileStatus(path).getLen() < len(HEADER):
        return False
    stream = files.open(path)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, len(HEADER))) == HEADER
    finally:
        stream.close()


def by_kind(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The paths to read as text and those to read as blocks; of a path with files of one kind it is the path itself."""
    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(32) as pool:  # it is waiting for the store that takes time
        blocked = [f for f, yes in zip(files, pool.map(lambda f: is_blocked(spark, f), files)) if yes]
    if not blocked or len(blocked) == len(files):
        return ([], [path]) if blocked else ([path], [])
    return [unquote(f) for f in files if f not in set(blocked)], [unquote(f) for f in blocked]


def inflated(body: bytes) -> bytes:
    """A member's text from what follows its header."""
    if int.from_bytes(body[:2], "little") + 1 != len(body) + len(HEADER):
        raise ValueError("a damaged member, or one with another header, in a block-compressed file")
    text = zlib.decompress(body[2:-8], -15)
    if zlib.crc32(text) != int.from_bytes(body[-8:-4], "little"):
        raise ValueError("a member of a block-compressed file has another checksum")
    return text


def split_texts(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes | None]]:
    """(split, text) for each member, and (split, None) after a split's last."""
    last = None
    for batch in stream:
        files, starts, bodies = (batch.column(n) for n in range(3))
        for n in range(len(batch)):
            split = (files[n].as_py(), starts[n].as_py())
            if last is not None and split != last:
                yield last, None
            last = split
            if body := bodies[n].as_py():
                yield split, inflated(body)
    if last is not None:
        yield last, None


def edges(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: what is before its first newline, what is after its last (null if it has none), and the number of lines between."""
    head, tail, n = [], None, 0
    for (file, start), text in split_texts(stream):
        if text is None:
            values = [[file], [start], [b"".join(head)], [None if tail is None else b"".join(tail)], [n]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["file", "start", "head", "tail", "n"])
            head, tail, n = [], None, 0
        elif (at := text.rfind(b"\n")) < 0:
            (head if tail is None else tail).append(text)
        else:
            if tail is None:
                head.append(text[: text.index(b"\n")])
                n -= 1
            n, tail = n + text.count(b"\n"), [text[at + 1 :]]


def inner_lines(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that begin after a newline of the split and end in it, numbered from 0."""
    rest, n = None, 0
    for (file, start), text in split_texts(stream):
        if text is None:
            rest, n = None, 0
        elif b"\n" not in text:
            if rest is not None:
                rest.append(text)
        else:
            first, *lines = text.split(b"\n")
            if rest is not None:
                lines.insert(0, b"".join([*rest, first]))
            rest = [lines.pop()]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array([start] * len(lines), pa.int64()), pa.array(range(n, n + len(lines)), pa.int64()), pa.array(lines, pa.binary())], ["file", "start", "id", "value"])
                n += len(lines)


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, start (of the split), id and value: the lines of block-compressed files, in order of id in each split.

    A line belongs to the split that it begins in. Lines end with a newline, or a carriage return and a newline. An empty
    file has no lines, a text without a last newline has its last line. Damaged members are errors.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    members = spark.read.options(**AS_IT_IS).text(paths).select(*place, F.col("value").cast("binary").alias("body"))
    inside = members.mapInArrow(inner_lines, "file string, start long, id long, value binary")
    ends = members.mapInArrow(edges, "file string, start long, head binary, tail binary, n long").repartition("file", "start")
    # What is before a split's first newline ends the line that the last split with a newline before it began; one row a split.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    owners = ends.select("file", "start", F.max(F.when(F.col("tail").isNotNull(), F.col("start"))).over(before).alias("owner"))
    parts = ends.join(owners, ["file", "start"]).withColumn("owner", F.coalesce("owner", F.lit(-1)))
    null = F.lit(None)
    heads = parts.select("file", F.col("owner").alias("start"), F.col("start").alias("at"), F.col("head").alias("part"), null.cast("long").alias("n"), F.col("tail").isNotNull().alias("ends"))
    tails = ends.filter(F.col("tail").isNotNull()).select("file", "start", F.lit(-1).cast("long").alias("at"), F.col("tail").alias("part"), "n", F.lit(False).alias("ends"))
    joined = heads.unionByName(tails).groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"), F.max("n").alias("id"), F.bool_or("ends").alias("ended"))
    whole = F.aggregate(F.col("parts.part"), F.lit(b""), lambda a, b: F.concat(a, b))
    joined = joined.select("file", "start", F.coalesce("id", F.lit(0)).alias("id"), whole.alias("value"), "ended")
    joined = joined.filter(F.col("ended") | (F.octet_length("value") > 0)).drop("ended")
    value = F.col("value").cast("string")
    return inside.unionByName(joined).withColumn("value", F.when(value.endswith("\r"), F.expr("substring(cast(value as string), 1, char_length(cast(value as string)) - 1)")).otherwise(value))
