"""Near copies and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from alleleloom.llm import near_copies, repeats

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    last = 1 << 63
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), last), last if r[0] is None else r[0])
    return Counter((r[0], len(sets[k]), None if least[find(k)] == last else least[find(k)]) for k, r in enumerate(rows))


@pytest.mark.parametrize("percent", [85, 80])
def test_components(docs, rows, percent):
    got = near_copies.link_near_copies(docs, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_built_collisions_are_not_linked(spark):
    """Texts made to share a sum of mixed bytes, or the linear fingerprint of a Q-gram, aren't taken for equal."""
    words = spark.createDataFrame([(1, "abcdefghijklmnop"), (2, "fzrlfdc5_oq*=_>)")], "doc_id long, text string")
    assert [r["component_id"] for r in near_copies.link_near_copies(words).orderBy("doc_id").collect()] == [1, 2]
    texts = [(1, "mmmmmmmmmmmmmmmmqiqzhgvs nsiopvuwzlcktdpsukghaxidw"), (2, "tsgnnndlislfrsulqiqzhgvs nsiopvuwzlcktdpsukghaxidw")]
    assert [r["n_removed"] for r in repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()] == [0, 0]


def test_words_have_numbers_of_their_own():
    r = random.Random(2)
    words = sorted({"".join(r.choice("abcdé1") for _ in range(r.randint(1, 20))) for _ in range(20000)} | {"a" * k for k in range(1, 400)})
    data = np.frombuffer(" ".join(words).encode() + b" ", np.uint8)
    with np.errstate(over="ignore"):
        assert len(np.unique(near_copies.hashes(data, *near_copies.words(data)))) == len(words)
        upper = np.frombuffer(" ".join(words).upper().replace("É", "é").encode() + b" ", np.uint8)
        assert (near_copies.hashes(data, *near_copies.words(data)) == near_copies.hashes(upper, *near_copies.words(upper))).all()


def test_large_nodes_branch(spark, monkeypatch):
    """With tiny nodes everything goes through the deeper levels, and the links stay the same."""
    monkeypatch.setattr(near_copies, "NODE", 4)
    r = random.Random(1)
    common = [f"c{k}" for k in range(120)]
    rows = []
    for k in range(90):
        w = list(common)
        for _ in range(r.choice([1, 2, 3, 12])):
            w[r.randrange(120)] = f"x{r.random()}"
        rows.append((k, " ".join(w)))
    got = near_copies.link_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 85)


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement agree in every polynomial modulo 2 to the 64; they are kept apart."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    got = near_copies.link_near_copies(spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("percent", [85, 80])
def test_components_of_sets(percent):
    r = np.random.default_rng(percent)
    base = r.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, n, replace=False), r.integers(0, 1 << 60, r.integers(0, 9)).astype(np.uint64)])) for n in r.integers(60, 80, 50)]
    root, want = near_copies.components_of(sets, percent), list(range(50))
    for a in range(50):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                want = [want[b] if w == want[a] else w for w in want]
    assert Counter(zip(root.tolist(), want)).keys() == {(x, y) for x, y in zip(root.tolist(), want)} and len(set(root.tolist())) == len(set(want)) == len(set(zip(root.tolist(), want)))


def test_one_of_each(docs, rows):
    kept = near_copies.one_of_each(docs, 85)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    sets = [shingles(t) for t in texts if shingles(t)]
    assert len(sets) == len(set(sets))
    assert {s for s in map(shingles, (r[1] for r in rows)) if s} >= set(sets)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[3] == 1  # of equal rows one stays


def brute_repeats(rows):
    last, seen, out = 1 << 63, {}, []
    for r in rows:
        b = (r[1] or "").encode()
        for k in range(len(b) - 49):
            own = last if r[0] is None else r[0]
            seen[b[k : k + 50]] = min(seen.get(b[k : k + 50], last), own)
    for r in rows:
        b, own = (r[1] or "").encode(), last if r[0] is None else r[0]
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < own:
                gone[k : k + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("chunk", "group"), [(1 << 18, 6 << 20), (700, 3000)])
def test_repeats(docs, rows, monkeypatch, chunk, group):
    for name, value in (("CHUNK", chunk), ("GROUP", group)):
        monkeypatch.setattr(repeats, name, value)
    got = repeats.remove_repeats(docs, whole=True).collect()
    assert Counter((r["doc_id"], r["row"]["doc_id"]) for r in got) == Counter((r[0], r[0]) for r in rows)
    assert all(r["row"].asDict().keys() == set(docs.columns) and r["row"]["text"] is None for r in got)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(rows)
    whole = {(r[0], r[1]) for r in rows}
    assert all((r["doc_id"], r["kept_text"]) in whole for r in got if not r["n_removed"])


def test_repeats_of_random_strings(spark):
    r = random.Random(4)
    rows = []
    parts = ["".join(r.choice("ab") for _ in range(n)) for n in (49, 50, 51, 80, 130, 300)]
    for k in range(80):
        rows.append((k // 2, "".join(r.choice(parts + ["x" * r.randint(1, 70), str(r.random())]) for _ in range(r.randint(0, 7)))))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(tuple(g) for g in got) == brute_repeats(rows)


@pytest.mark.parametrize("f", [near_copies.link_near_copies, near_copies.one_of_each, repeats.remove_repeats])
def test_empty_tables(empty, f):
    assert f(empty).count() == 0


def test_contexts_of_a_hot_anchor_are_dealt_out():
    """Contexts of one bucket go to many tasks if it is hot, and equal contexts meet."""
    p = object.__new__(repeats.Part)
    c = np.random.default_rng(3).integers(0, 1 << 63, 10000).astype(np.uint64)
    p.parts, p.h, p.c, p.hot = 10, np.full(20000, 7, np.uint64), np.concatenate([c, c]), np.ones(20000, dtype=bool)
    p.gone = ~p.hot
    with np.errstate(over="ignore"):
        which, to = p.questions()[repeats.HOT_CONTEXTS]
    assert len(which) == 20000 and (to[:10000] == to[10000:]).all() and set(to) == set(range(10)) and max(Counter(to.tolist()).values()) < 3000


@pytest.mark.parametrize(("hot", "group"), [(3, 6 << 20), (3, 2000), (1 << 14, 2000)])
def test_repeats_with_hot_anchors(spark, monkeypatch, hot, group):
    """Passages with other surroundings in each document, some of which are shared in part, whichever anchors are hot."""
    for name, value in (("HOT", hot), ("GROUP", group)):
        monkeypatch.setattr(repeats, name, value)
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, ends = word(300), [word(r.randint(5, 40)) for _ in range(6)]
    rows = [(k, word(60) + r.choice(ends) + passage[r.choice([0, 0, 9]) :] + r.choice(ends) + word(r.randint(0, 60))) for k in range(60)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(tuple(g) for g in got) == brute_repeats(rows)


def test_every_link_of_a_corpus(spark):
    """Recall on whole documents: components equal those of an exact join on shared shingles, at both thresholds. Measured: all of them."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets, holders = [shingles(t) for _, t in rows], {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for percent in (85, 80):
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        links = 0
        for k, s in enumerate(sets):
            for j, both in Counter(j for x in s for j in holders[x] if j < k).items():
                if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                    links += 1
                    root[find(k)] = find(j)
        least = {}
        for k, (i, _) in enumerate(rows):
            least[find(k)] = min(least.get(find(k), i), i)
        got = near_copies.link_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
        assert links > 50 and {r["doc_id"]: r["component_id"] for r in got} == {i: least[find(k)] for k, (i, _) in enumerate(rows)}
