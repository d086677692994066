"""Block-compressed text files."""

import gzip
import random
import struct
import zlib

import pytest

from alleleloom.sources import blocked, genotypes

from .test_files import VCF


def packed(data: bytes, size: int) -> bytes:
    out = b""
    for part in [*(data[k : k + size] for k in range(0, len(data), size)), b""]:
        deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out += blocked.HEADER + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def numbered(spark, path):
    return [tuple(r) for r in sorted(genotypes.numbered_lines(spark, str(path)).collect())]


@pytest.mark.parametrize("end", ["\n", ""])
@pytest.mark.parametrize("name", ["a.vcf.gz", "a b.bgz"])
def test_lines_of_several_tasks(spark, tmp_path, small_splits, name, end):
    rng = random.Random(4)
    text = [f"{k}\t" + "".join(rng.choices("acgt\té漢", k=rng.choice([0, 3, 80, 900]))) for k in range(400)]
    # A line of many splits, empty ones, and one that ends in a carriage return.
    text[200], text[201:204], text[210] = "".join(rng.choices("acgt", k=60_000)), ["", "", ""], "with\r"
    (tmp_path / name).write_bytes(packed(("\n".join(text) + end).encode(), 1000))
    text[210] = "with"
    assert numbered(spark, tmp_path / name) == [(k + 1, v) for k, v in enumerate(text)]
    assert len({r["start"] for r in blocked.lines(spark, [str(tmp_path / name)]).collect()}) > 10


def test_kinds_of_files_together(spark, tmp_path, small_splits):
    text = [f"line {k} " + "x" * (k % 50) for k in range(900)]
    (tmp_path / "1.txt").write_text("\n".join(text[:300]) + "\n")
    (tmp_path / "2 2.gz").write_bytes(packed(("\n".join(text[300:600]) + "\n").encode(), 700))
    (tmp_path / "3.gz").write_bytes(gzip.compress(("\n".join(text[600:]) + "\n").encode()))
    assert numbered(spark, tmp_path) == [(k + 1, v) for k, v in enumerate(text)]


@pytest.mark.parametrize("text", ["", "\n", "one", "\n\ntwo\n"])
def test_little_text(spark, tmp_path, text):
    (tmp_path / "a.gz").write_bytes(packed(text.encode(), 3))
    assert numbered(spark, tmp_path / "a.gz") == [(k + 1, v) for k, v in enumerate(text.splitlines())]


def test_damage_is_an_error(spark, tmp_path):
    data = bytearray(packed(b"some text\n" * 50, 100))
    data[-50] ^= 1
    (tmp_path / "a.gz").write_bytes(bytes(data))
    with pytest.raises(Exception, match="block-compressed|zlib|decompress"):
        numbered(spark, tmp_path / "a.gz")


def test_genotypes(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    (tmp_path / "b.vcf.gz").write_bytes(packed(VCF.encode(), 60))
    want, got = (sorted(map(str, genotypes.read_vcf(spark, str(tmp_path / n)).collect())) for n in ("a.vcf", "b.vcf.gz"))
    assert got == want and len(got) > 0
