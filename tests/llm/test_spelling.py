"""Spelling variants against plain Python: every pair of words one edit apart, counted words, roots."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from alleleloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    n = Counter()
    for r in rows:
        for run in RUN.findall(r[1] or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 5
    return {w: m for w, m in n.items() if m >= 3}


def edits(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(n):
    near = {w: [v for v in n if edits(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def words(r, letters, most, size):
    return {"".join(r.choice(letters) for _ in range(r.randint(0, most))): r.choice([1, 1, 2, 3, 5, 9, 20, 50]) for _ in range(size)}


@pytest.mark.parametrize("seed, letters, most, per_range", [(1, "ab", 7, 5), (3, "aé\U0001f600z", 4, 17), (4, "abcdefgh", 3, 1000)])
def test_every_pair_is_found_once(spark, monkeypatch, seed, letters, most, per_range):
    """Tries in many ranges, with nodes that many of them share."""
    monkeypatch.setattr(spelling, "RANGE", per_range)
    n = words(random.Random(seed), letters, most, 150)
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {tuple(x) for x in spelling.group_variants(rows).collect()} == grouped(n)


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_tries_of_ranges_agree(size):
    """What Spark does with the tries' rows, done by hand: each pair comes once, however small the ranges."""
    for seed in range(12):
        r = random.Random(seed)
        made = sorted(words(r, ("ab", "abcde")[seed % 2], 6, 60))
        parts = [made[k : k + size] for k in range(0, len(made), size)]
        tries = [spelling.Trie(p, parts[k - 1][-1] if k else None, parts[k + 1][0] if k + 1 < len(parts) else None) for k, p in enumerate(parts)]
        opened = [list(t.open_children()) for t in tries]
        counts = defaultdict(Counter)
        for _, _, node, c, m in itertools.chain(*opened):
            counts[node].update({c: m} if c else {})
        pairs, groups = Counter(), defaultdict(list)
        for t, rows in zip(tries, opened):
            t.heavy = {(path, d): min(counts[node], key=lambda c: (-counts[node][c], c)) for path, d, node, *_ in rows if counts[node]}  # noqa: B023
            for is_word, key, place, w in t.merged():
                if not is_word:
                    groups[key, place].append(w)
                elif key in made:
                    pairs[frozenset((key, w))] += 1
        pairs.update(frozenset(x) for g in groups.values() for x in itertools.combinations(g, 2))
        assert pairs == Counter(frozenset(x) for x in itertools.combinations(made, 2) if edits(*x))


def test_ranges_are_many(spark, monkeypatch):
    monkeypatch.setattr(spelling, "RANGE", 3)
    n = words(random.Random(7), "abcd", 6, 120)
    ranged, ends = spelling.ranges(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert ends.count() > 20 and ranged.count() == len(n)


def test_long_words_and_light_edges():
    """A word of n letters goes through few light edges, however long; its keys are few, not one for each letter."""
    r = random.Random(8)
    made = sorted({"".join(r.choice("abcdefghijklmnop") for _ in range(r.choice([6, 9, 4000]))) for _ in range(600)})
    trie = spelling.Trie(made, None, None)
    light = Counter(w for low, high, *_ in trie.light_edges() for w in made[low:high])
    assert max(light.values()) <= 10  # log2(600)
    assert sum(1 for _ in trie.merged()) <= 4 * sum(light.values())


def test_documents(spark, docs, rows, empty):
    """Null, empty and long texts, a null id, equal rows; capitals outside A to Z stay."""
    r = random.Random(4)
    text = " ".join(r.choice(["Straße", "straße", "strase", "ÉTOILES", "étoiles", "letters", "lettres", "léttres", "letter", "×÷×÷×"]) for _ in range(2000))
    more = [(None, text, "en", "s", 1, "x", 1, 0.5), (7000, text, "en", "s", 1, "x", 1, 0.5), (7001, "q" * 3000 + " " + "q" * 2999, "en", "s", 1, "x", 1, 0.5)] + [(7002, "q" * 3000 + "-" + "q" * 2999, "", "", 1, "", 1, 0.5)] * 2
    got = spelling.spelling_variants(docs.unionByName(spark.createDataFrame(more, docs.schema))).collect()
    want = grouped(counted([*rows, *more]))
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert spelling.spelling_variants(empty).count() == 0
