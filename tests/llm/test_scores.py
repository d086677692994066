"""Token counts, top-k search, toxicity and quality against libraries, brute force and held-out labels."""

import math
import random
import time
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from alleleloom.llm import decision_list, rule_ensemble, textstats, token_counts, top_k, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_counts_are_the_library_s(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.tokenizer_path("word_bpe_49k.json"))
    got = token_counts.count_tokens(docs, prefixes=True, budget=30).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        if r["doc_id"] is None or r["n_bytes"] > 5000:
            continue
        text = texts[r["doc_id"]]
        assert len(r["prefix_tokens"]) == len(text)
        if len(text) < 400:
            for end in range(1, len(text) + 1):
                assert len(library.encode(text[:end].decode(errors="ignore"), add_special_tokens=False).ids) == r["prefix_tokens"][end - 1]
        assert r["cut_bytes"] == max((k for k, n in enumerate(r["prefix_tokens"], 1) if n <= 30), default=0)


def test_every_prefix():
    counter = token_counts.counter(token_counts.tokenizer_path("word_bpe_49k.json"))
    count = lambda b: len(counter.library.encode(b.decode(errors="ignore"), add_special_tokens=False).ids)
    r = random.Random(9)
    odd = ["it's we'll x're 'T''s", "a<|endoftext|>b!!<|startoftext|>", "<|endoftext|>" * 3, "été naïve 漢字かな 😀😀!", "İI ΣΑΣ e\u0301e", "  lead and trail \n", "", "don't!!'re"]
    odd += ["".join(r.choice(["ab", "é", "'s", "!", "7", " ", "漢", "Q", "<|endoftext|>"]) for _ in range(12)) for _ in range(60)]
    for text in map(str.encode, odd):
        table = counter.prefix_counts(text)
        assert table == [count(text[:k]) for k in range(1, len(text) + 1)], text
        for budget in range(6):
            assert counter.cut(text, budget) == max((k for k, n in enumerate(table, 1) if n <= budget), default=0)


def test_prefixes_of_characters_that_normalisation_joins():
    """Decomposed letters, Hangul parts, characters whose lower case is longer: every prefix, without encoding it anew."""
    counter = token_counts.counter(token_counts.tokenizer_path("word_bpe_49k.json"))
    count = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    pool = ["e\u0301", "é", "İ", "ß", "漢", "가", "\u1100\u1161\u11a8", "क\u093c", "a", "B", "'s", "'re", "'", "’", "!", "1", "x\u0323\u0307", "\u0307", "\u212b", "ﬁ", "\u3000", "😀", "'ll", "''", "ſ", "\u09c7\u09be"]
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(pool) for _ in range(r.randint(1, 14)))
        table = counter.prefix_counts(text.encode())
        assert [table[len(text[:k].encode()) - 1] for k in range(1, len(text) + 1)] == [count(text[:k]) for k in range(1, len(text) + 1)], text


@pytest.mark.parametrize("more", ["漢字仮名", "e\u0301漢", "İx", "'", "가나다"])
def test_long_words_take_time_in_proportion(more):
    counter = token_counts.counter(token_counts.tokenizer_path("word_bpe_49k.json"))
    text = ("e\u0301" + more * 20000)[:20000]
    tables, took = [], []
    for t in (text[:5000], text):
        began = time.process_time()
        tables.append(counter.prefix_counts(t.encode()))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5
    assert tables[1][: len(tables[0])] == tables[0] and tables[1][-1] == len(counter.library.encode(text, add_special_tokens=False).ids)
    assert counter.cut(text.encode(), 2048) == max(k for k, n in enumerate(tables[1], 1) if n <= 2048)
    assert not any(len(w) > token_counts.SHORT for w in (*counter.words, *counter.pieces))


def test_many_special_strings(spark):
    """As many special strings as may be are split one after the other."""
    text = "<|endoftext|>" * 5000
    got = token_counts.count_tokens(spark.createDataFrame([(1, text), (2, "a" + text)], "doc_id long, text string"), budget=2048).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["cut_bytes"]) for r in got} == {1: (5000, 13 * 2048), 2: (5001, 1 + 13 * 2047)}


def test_prefixes_of_pieces():
    counter = token_counts.counter(token_counts.tokenizer_path("word_bpe_49k.json"))
    r = random.Random(3)
    for k in range(3000):
        w = "".join(r.choice("abenost" if k % 2 else "aa!h.1<|>") for _ in range(r.randint(1, 12)))
        assert counter.count(w.encode()) == len(counter.library.encode(w, add_special_tokens=False).ids)
    for w in ("pneumonoultramicroscopic", "aaaaaaaaaaaa", "hahahaha", "!!!!!..."):
        pieces = counter.split(w.encode())
        for p in pieces:
            assert counter.piece_table(p) == [len(counter.library.encode(p[: n + 1], add_special_tokens=False).ids) for n in range(len(p))]
    for odd in ("a<|endoftext|>b <|startoftext|>", "é è  x y", "\x1c\x1d a\x85b", "İI ΣΑΣ", "😀😀!", "it's we'll 'T"):
        assert counter.count(odd.encode()) == len(counter.library.encode(odd, add_special_tokens=False).ids)


def vectors(spark):
    r = np.random.default_rng(1)
    data = [(k, [float(x) for x in np.round(r.normal(size=4), 1)], k) for k in range(300)]
    data += [(k, data[0][1], 0) for k in range(300, 420)]
    data += [(420, None, 0), (421, [1.0, None, 0.0, 0.0], 0), (422, [float("nan")] * 4, 0), (423, [float("inf")] * 4, 0), (424, [], 0), (425, [1.0, 2.0], 0), (None, [9.0] * 4, 0), (450, [1.0, 1.0, 1.0, 1.0], 0), (450, [1.0, 1.0, 1.0, 1.0], 0)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")


@pytest.mark.parametrize("shard", [8192, 40])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(top_k, "SHARD", shard)
    monkeypatch.setattr(top_k, "LEAF", 5)
    data, df = vectors(spark)
    got = top_k.top_k(df, df.filter("vec_id % 50 = 0")).collect()
    fine = [(i, np.floor(np.float32(v).astype(float) * 256)) for i, v, _ in data if i is not None and v and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in dict((i, q) for i, q in fine if i % 50 == 0).items():
        best = sorted((-int(q @ v), j) for j, v in fine if j != i and len(v) == len(q))[:5]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert Counter(map(tuple, got)) == Counter(want)


def test_top_k_large_numbers(spark):
    df = spark.createDataFrame([(0, [1e10, 2.0]), (1, [1e3, 1.0]), (2, [2e3, 1.0])], "vec_id long, embedding array<double>")
    got = top_k.top_k(df, df.filter("vec_id = 1"), k=1).first()
    assert (got["vec_id"], got["score"]) == (0, 256 * 256 * (10**13 + 2))


def test_top_k_beyond_64_bits(spark):
    """Exact up to 64 bits; beyond, the nearest number of 64 bits, with ties to smaller ids."""
    r = np.random.default_rng(2)
    data = [(k, [float(x) for x in r.normal(size=3) * 10.0 ** r.integers(0, 9, 3)]) for k in range(120)]
    data += [(200, [1e14, 1.0, -1.0]), (201, [1e300, -1e300, 3.0]), (202, [-1e308, 1.0, 0.0]), (203, [1.7e308] * 3), (204, [5e-324, 0.0, -0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = top_k.top_k(df, df.filter("vec_id % 50 = 0 or vec_id > 199"), k=5).collect()
    whole = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in data}
    want = set()
    for i in whole:
        if i % 50 == 0 or i > 199:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[i], v)))), j) for j, v in whole.items() if j != i]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:5])}
    assert set(map(tuple, got)) == want


@pytest.mark.parametrize("hot", [False, True])
def test_top_k_goes_where_it_must(spark, monkeypatch, hot):
    """Clustered vectors, a third of them equal where hot: results of brute force, for a small part of queries x shards."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 8))
    x = centres[rng.integers(60, size=6000)] / np.linalg.norm(centres, axis=1).mean() + rng.normal(scale=0.02, size=(6000, 8))
    if hot:
        x[::3] = x[0]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    sent, as_was = [], top_k.small

    def counted(popular):
        sent.append(popular)
        return as_was(popular)

    def placed(*given):
        spaces, rows = placing(*given)
        shards.append(int(spaces[8].shards.sum()))
        return spaces, rows

    placing, shards = top_k._placed, []
    monkeypatch.setattr(top_k, "_placed", placed)
    monkeypatch.setattr(top_k, "small", counted)
    monkeypatch.setattr(top_k, "ASKED", 40)
    got = top_k.top_k(df, df.filter("vec_id % 50 = 0"), shard_rows=60).collect()
    whole = np.floor(x * 256).astype(np.int64)
    want = []
    for q in range(0, 6000, 50):
        scores = whole @ whole[q]
        order = [n for n in sorted(range(6000), key=lambda n: (-scores[n], n)) if n != q][:5]
        want += [(q, r + 1, n, int(scores[n])) for r, n in enumerate(order)]
    assert sorted(tuple(r) for r in got) == want
    if not hot:
        # Rows that went through a shuffle, as the places' counts have them.
        visits = sum(p.agg(F.sum("asked")).first()[0] or 0 for p in sent)
        assert visits < 0.1 * 120 * shards[0], (visits, shards)


def test_top_k_wild_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [-1e300, 0.0]), (4, [1.0, 1.0]), (50, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k.top_k(df, df.filter("vec_id in (1, 50)"), k=3, shard_rows=2).collect())
    assert got == [(1, 1, 0, top_k.MOST), (1, 2, 2, 4 * 65536), (1, 3, 4, 2 * 65536), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]


def test_top_k_empty(spark, empty):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k.top_k(none, none).count() == 0


def labelled_texts(spark, n=900):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(800)]
    docs, labels = [], []
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randint(15, 120))]
        toxic, junk = r.random() < 0.3, r.random() < 0.25
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["zoxy", "zoxish", "Vrump!", "vrumpen"]))
        if junk:
            w = [x + "###" for x in w]
        docs.append((k, " ".join(w)))
        labels.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_held_out(spark):
    docs, labels, known = labelled_texts(spark)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels, spans=True).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = [k for k, _, _ in known if got[k]["held_out"]]
    assert {k for k, _, _ in known if zlib.crc32(str(k).encode()) % 5 == 0} == set(out)
    right = sum((got[k]["score"] >= 0.5) == bool(known[k][2]) for k in out)
    assert right >= 0.97 * len(out)
    found = [texts[k].encode()[s["start"] : s["end"]].decode().lower() for k in out for s in got[k]["spans"]]
    assert found and sum("zox" in f or "vrump" in f for f in found) >= 0.95 * len(found)


def brute_field(step, emission):
    """(log of all taggings, log of the one without offences, chance of each word to offend)."""
    total, clean, one = 0.0, 0.0, np.zeros(len(emission))
    for code in range(1 << len(emission)):
        tags, last, x = [code >> k & 1 for k in range(len(emission))], 0, 0.0
        for c, e in zip(tags, emission):
            x += step[last, c] + c * e
            last = c
        total += np.exp(x)
        clean += np.exp(x) * (code == 0)
        one += np.exp(x) * np.array(tags)
    return np.log(total), np.log(clean), one / total


def test_field_sums_over_all_taggings():
    r = np.random.default_rng(0)
    model = toxicity.Field(-1.0, step=r.normal(size=(2, 2)))
    n = np.array([7, 0, 1, 4, 5])
    emission = r.normal(size=n.sum()) * 2
    odds, at = model.odds(emission, n), 0
    for k, m in enumerate(n.tolist()):
        part = emission[at : at + m]
        at += m
        if not m:
            assert odds[k] == -50
            continue
        total, clean, one = brute_field(model.step, part)
        assert odds[k] == pytest.approx(np.log(np.exp(total) - np.exp(clean)) - clean)
        assert model.marginals(part) == pytest.approx(one)


def test_gradient_of_the_labels():
    """The gradient is that of the chance of the labels, summed over the taggings that agree with them."""
    r = np.random.default_rng(1)
    step, emission = r.normal(size=(2, 2)), r.normal(size=(3, 5)) - 1
    mask, toxic, weight = np.arange(5) < np.array([[5], [3], [4]]), np.array([True, False, True]), np.array([1.0, 2.0, 0.5])

    def likelihood(step, emission):
        out = 0.0
        for e, m, t, w in zip(emission, mask, toxic, weight):
            total, clean, _ = brute_field(step, e[m])
            out += w * (np.log(-np.expm1(clean - total)) if t else clean - total)
        return out

    value, by_emission, by_step = toxicity.gradient(step, emission, mask, toxic, weight)
    assert value == pytest.approx(likelihood(step, emission))
    for x, by in ((emission, by_emission), (step, by_step)):
        for k in np.ndindex(x.shape):
            more, less = x.copy(), x.copy()
            more[k] += 1e-5
            less[k] -= 1e-5
            pair = [(likelihood(step, y) if x is emission else likelihood(y, emission)) for y in (more, less)]
            assert by[k] == pytest.approx((pair[0] - pair[1]) / 2e-5, abs=1e-6)


def test_a_word_offends_in_one_context_only():
    r = random.Random(2)
    other = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts, toxic = [], []
    for k in range(600):
        w = [r.choice(other) for _ in range(30)]
        w[r.randrange(1, 29)] = "quux"
        at = next(n for n, x in enumerate(w) if x == "quux")
        w[at - 1] = "zig" if k % 3 == 0 else r.choice(["zag", "zog"])
        if k % 3:  # the other word is everywhere, but not before it
            w[(at + 5) % 28] = "zig"
        texts.append(" ".join(w).encode())
        toxic.append(float(k % 3 == 0))
    with np.errstate(over="ignore"):
        model = toxicity.fit(texts[:450], np.array(toxic[:450]))
        score = model.score(model.of_texts(texts[450:]))
        assert ((score >= 0.5) == np.array(toxic[450:])).mean() > 0.97
        hits = [toxicity.offsets(model, t) for t, y in zip(texts[450:], toxic[450:]) if y]
        assert sum(any(b"quux" in t[s["start"] : s["end"]] for s in spans) for spans, t in zip(hits, (t for t, y in zip(texts[450:], toxic[450:]) if y))) > 0.9 * len(hits)


def test_toxicity_edges(spark, docs, empty, labels, rows):
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    none = labels.filter("doc_id < 0")
    assert {round(r["score"], 6) for r in toxicity.score_toxicity(docs.limit(3), none).collect()} <= {0.0, 0.5}


def brute_statistics(text):
    t = text or ""
    w = WORDS.findall(t)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_statistics(docs, rows):
    got = textstats.with_statistics(docs, ["doc_id"]).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((r[0], *brute_statistics(r[1])) for r in rows)


def test_decision_list(spark):
    docs, labels, known = labelled_texts(spark)
    got = {r["doc_id"]: r for r in decision_list.judge_quality(docs, labels).collect()}
    assert sum(got[k]["kept"] == bool(q) for k, q, _ in known) >= 0.99 * len(known)


def test_rule_ensemble_held_out(spark):
    docs, labels, known = labelled_texts(spark)
    got = {r["doc_id"]: r for r in rule_ensemble.score_quality(docs, labels).collect()}
    out = [k for k, _, _ in known if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (k in set(out)) for k, _, _ in known)
    assert sum((got[k]["score"] >= 0.7) == bool(known[k][1]) for k in out) >= 0.97 * len(out)


def brute_features(spark, docs):
    stats = textstats.with_features(textstats.with_statistics(docs, ["doc_id"]))
    return [r.asDict() for r in stats.select("doc_id", "n_words", "n_repeat_words", *textstats.FEATURES).collect()]


def test_ensemble_by_hand(spark):
    """The compiled expression gives what adding up the rules' weights gives, on each row."""
    docs, labels, _ = labelled_texts(spark)
    got = {r["doc_id"]: r["score"] for r in rule_ensemble.score_quality(docs, labels).collect()}
    model = rule_ensemble.learn(docs, labels, 4, 2)
    assert model.rules
    for row in brute_features(spark, docs):
        total = model.bias + sum(w for rule, w in model.rules if all((row[f] > t) == above for f, above, t in rule))
        assert got[row["doc_id"]] == pytest.approx(1 / (1 + math.exp(-total)))


def test_decision_list_by_hand(spark):
    """A row is kept if it passes the base rules and no rule of the list holds."""
    docs, labels, known = labelled_texts(spark)
    label = {k: q for k, q, _ in known}
    stats = textstats.with_features(textstats.with_statistics(docs, ["doc_id"]))
    rules = decision_list.learn(textstats.labelled(stats, labels, "quality").select("doc_id", "label", *textstats.FEATURES))
    assert rules
    got = {r["doc_id"]: r["kept"] for r in decision_list.judge_quality(docs, labels).collect()}
    rows = brute_features(spark, docs)
    for row in rows:
        base = row["n_words"] < 10 or 100 * row["n_repeat_words"] > 20 * row["n_words"]
        held = any(all((row[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)
        assert got[row["doc_id"]] == (not base and not held)
    # Each rule finds the rejected ones with the precision that it must have, on the rows it wasn't grown on.
    left = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0]
    for rule in rules:
        found = [r for r in left if all((r[c.feature] > c.threshold) == c.above for c in rule)]
        assert sum(label[r["doc_id"]] == 0 for r in found) >= decision_list.PRECISION * len(found)
        left = [r for r in left if r not in found]


def test_quality_edges(spark, docs, empty, labels, rows):
    judged = decision_list.judge_quality(docs, labels).collect()
    assert len(judged) == len(rows)
    for r in judged:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    scored = rule_ensemble.score_quality(docs, labels, whole=True)
    assert scored.select("row.*").columns == docs.columns and scored.count() == len(rows)
    assert scored.filter(~F.col("score").between(0, 1)).count() == 0
    for f in (decision_list.judge_quality, rule_ensemble.score_quality):
        assert f(empty, labels).count() == 0
        assert f(docs.limit(3), labels.filter("doc_id < 0")).count() == 3


def test_long_texts_are_fitted_whole():
    """An offence in the middle of long texts is learned; batches are bounded by their padded words."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    texts, toxic = [], []
    for k in range(160):
        w = [r.choice(words) for _ in range(2500 if k % 4 == 0 else 120)]
        if k % 2 == 0:
            w[len(w) // 2] = "vileword"
        texts.append(" ".join(w).encode())
        toxic.append(float(k % 2 == 0))
    model = toxicity.fit(texts, np.array(toxic))
    scores = model.score(model.of_texts(texts))
    assert all((s >= 0.5) == (y == 1) for s, y in zip(scores, toxic))
    lengths = np.array([1, 2, 3, 5, 100, toxicity.CELLS // 2, toxicity.CELLS * 3])
    parts = toxicity.fitting(lengths)
    assert [k for a, b in parts for k in range(a, b)] == list(range(len(lengths))) and parts[-1] == (6, 7)
    assert all(b - a == 1 or (b - a) * lengths[a:b].max() <= toxicity.CELLS for a, b in parts)
