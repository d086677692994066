"""Boundaries of long documents against brute force."""

from itertools import combinations

import pytest

from alleleloom.llm import packing


@pytest.mark.parametrize(("lengths", "buckets"), [([2049], 1), ([2049, 2051, 2052, 3001, 3001, 3003, 4097, 4101, 4101, 9001, 9010, 9011], 4), ([7, 7, 2000, 5001, 5003, 5004, 20001], 3)])
def test_long_lengths_are_exact(spark, lengths, buckets):
    docs = spark.createDataFrame([(k, "a " * n) for k, n in enumerate(lengths)], "doc_id long, text string")
    got = packing.pack(docs, buckets=buckets).collect()
    top, rest = max(lengths), sorted(set(lengths) - {max(lengths)})
    choices = [[*c, top] for k in range(buckets) for c in combinations(rest, k)]
    assert sum(r["n_pad"] for r in got) == min(sum(min(b for b in c if b >= n) - n for n in lengths) for c in choices)
    assert max(r["pad_to"] for r in got) == top
