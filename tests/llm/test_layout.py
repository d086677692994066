"""Mixing, sharding and packing against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from alleleloom.llm import common, mixing, packing, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORDS.findall(text or ""))


def waterfilled(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = {s: (budget - sum(fixed.values())) * weights[s] / sum(weights[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix_reaches_targets(docs, rows):
    got = mixing.mix_to_weights(docs).collect()
    assert len(got) == len(rows)
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    want, taken = waterfilled(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["times"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_to_weights(docs.repartition(5)).collect()), key=str)


def test_a_capped_source_gives_no_row_three_times(spark):
    """A source whose words are all taken twice has none left, nor any of its rows without words."""
    rows = [(k, "word " * 9 if k % 3 else "", "small" if k < 60 else "large") for k in range(60)]
    rows += [(k, "word " * 200, "large") for k in range(60, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_to_weights(docs, weights=(1, 50)).collect()
    assert {r["target"] / r["source_size"] for r in mixed if r["source"] == "small"} == {2.0}
    assert max(r["times"] for r in mixed) == 2
    assert max(Counter(r["doc_id"] for r in mixing.mixed_rows(docs, weights=(1, 50)).collect()).values()) == 2


def test_mix_thresholds_are_nested(docs):
    lower = {(r["doc_id"], r["size"]): r["times"] for r in mixing.mix_to_weights(docs, share=0.5).filter("doc_id <> 3").collect()}
    upper = {(r["doc_id"], r["size"]): r["times"] for r in mixing.mix_to_weights(docs, share=0.9).filter("doc_id <> 3").collect()}
    assert all(upper[k] >= n for k, n in lower.items() if k[1])


def test_mixed_rows_are_the_mix(docs):
    want = Counter({r["doc_id"]: r["times"] for r in mixing.mix_to_weights(docs).filter("doc_id <> 3 and doc_id is not null").collect() if r["times"]})
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.filter("doc_id <> 3 and doc_id is not null").collect()) == want


def test_shards_are_a_permutation(docs, rows):
    got = sharding.shard_rows(docs).collect()
    assert len(got) == len(rows)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    counts = [len(s) for s in shards.values()]
    assert len(shards) == 16 and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sharding.shard_rows(docs.repartition(7)).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 1000, 4097])
def test_feistel_permutes_and_inverts(n):
    numbers = np.arange(n)
    to = sharding.feistel(numbers, n, 3)
    assert sorted(to) == list(range(n)) and (sharding.feistel(to, n, 3, inverse=True) == numbers).all()


def test_boundaries_are_optimal():
    r = random.Random(2)
    for _ in range(150):
        edges = sorted(r.sample(range(100), r.randint(1, 9)))
        counts, k = [r.randint(1, 9) for _ in edges], r.randint(1, 5)

        def padded(bounds):
            return sum(n * min(b for b in bounds if b >= e) for e, n in zip(edges, counts))

        best = min(padded((*c, edges[-1])) for n in range(min(k, len(edges))) for c in itertools.combinations(edges[:-1], n))
        got = packing.choose_boundaries(edges, counts, k)
        assert len(got) <= k and padded(got) == best


def test_batches_fit_the_budget(docs, rows):
    got = packing.pack(docs, budget=500).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    batches = defaultdict(list)
    for r in got:
        assert r["n_pad"] == r["pad_to"] - r["n_tokens"] >= 0
        batches[r["bucket"], r["batch_id"]].append(r)
    for b in batches.values():
        assert len(b) == 1 or sum(r["pad_to"] for r in b) <= 500
        assert sorted(r["slot"] for r in b) == list(range(len(b)))
    per = defaultdict(list)
    for k, n in batches:
        per[k].append(n)
    assert all(sorted(n) == list(range(len(n))) for n in per.values())


@pytest.mark.parametrize("f", [mixing.mix_to_weights, mixing.mixed_rows, sharding.shard_rows, packing.pack])
def test_empty_tables(empty, f):
    assert f(empty).count() == 0


def test_hash_is_that_of_the_sql(docs):
    r = docs.filter("doc_id = 7").select("text", mixing.row_hash("doc_id", "text").alias("h")).first()
    text = hashlib.md5(r["text"].encode()).hexdigest()
    assert r["h"] == int(hashlib.md5(f"7|{text}".encode()).hexdigest()[:15], 16)


def test_copies_in_blocks(spark, docs, monkeypatch):
    """Rows with more copies than a block are dealt out before they are made, with the same numbers."""
    many = docs.unionByName(docs.filter("doc_id in (1, 2)").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(53)))).drop("n"))
    whole = [sorted(map(tuple, f(many).collect()), key=str) for f in (sharding.shard_rows, packing.pack, mixing.mix_to_weights)]
    monkeypatch.setattr(common, "BLOCK", 7)
    assert whole == [sorted(map(tuple, f(many).collect()), key=str) for f in (sharding.shard_rows, packing.pack, mixing.mix_to_weights)]


def test_a_row_with_very_many_copies(spark):
    """Copies are made block by block: no array, nor any task, holds all of a row's."""
    units = spark.createDataFrame([(1, 20_000_000), (2, 1)], "doc_id long, copies long")
    rows = common.each_copy(units, "copies", "copy", 20_000_000)
    assert tuple(rows.agg(F.count("*"), F.max("copy")).first()) == (20_000_001, 19_999_999)
    assert rows.select(F.spark_partition_id()).distinct().count() > 1
