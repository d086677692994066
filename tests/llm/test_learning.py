"""What the two quality models learn, against searches of everything they may choose from."""

import math
import zlib

import numpy as np
import pytest

from alleleloom.llm import decision_list, rule_ensemble
from alleleloom.llm.textstats import FEATURES


def some_rows(n, seed):
    """Rows of small numbers, of which two statistics tell most about the label."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(n, len(FEATURES)))
    bad = ((x[:, 0] > 8) & (x[:, 2] <= 6)) | (x[:, 1] <= 1)
    y = np.where(rng.random(n) < 0.04, bad, ~bad).astype(int)
    return x, y


def met(condition, x):
    values = x[:, FEATURES.index(condition.feature)]
    return values > condition.threshold if condition.above else values <= condition.threshold


def all_met(rule, x):
    return np.all([met(c, x) for c in rule], axis=0) if rule else np.ones(len(x), bool)


def grown(x, y, edges):
    """The rule of the greatest information gain, each condition tried on the rows themselves."""
    rule = ()
    while len(rule) < decision_list.CONDITIONS:
        inside = all_met(rule, x)
        zeros, ones = (int((y[inside] == k).sum()) for k in (0, 1))
        if not zeros or not ones:
            break
        best = (0.0, None)
        for f in FEATURES:
            for t in edges[f]:
                for above in (False, True):
                    c = decision_list.Condition(f, above, t)
                    z, o = (int((y[inside & met(c, x)] == k).sum()) for k in (0, 1))
                    gain = z * (math.log2(z / (z + o)) - math.log2(zeros / (zeros + ones))) if z else -1.0
                    if gain > best[0]:
                        best = (gain, c)
        if best[1] is None:
            break
        rule += (best[1],)
    return rule


def covered(x, y, third, edges, rules):
    """Sequential covering, row by row."""
    out, left = [], np.ones(len(y), bool)
    while len(out) < rules:
        rule = grown(x[left & ~third], y[left & ~third], edges)
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            inside = left & third & all_met(rule[:k], x)
            z, o = int((y[inside] == 0).sum()), int((y[inside] == 1).sum())
            worth.append(((z - o) / max(1, z + o), -k, z / max(1, z + o), z))
        _, k, right, found = max(worth)
        if right < decision_list.PRECISION or found < decision_list.SUPPORT:
            break
        out.append(rule[:-k])
        left &= ~all_met(rule[:-k], x)
    return out


def test_list_of_a_search_over_all_conditions(spark, monkeypatch):
    monkeypatch.setattr(decision_list, "RULES", 3)
    x, y = some_rows(900, 3)
    names = ", ".join(f"{n} long" for n in ("doc_id", "label", *FEATURES))
    df = spark.createDataFrame([(k, int(label), *map(int, row)) for k, (label, row) in enumerate(zip(y, x))], names).coalesce(2).cache()
    edges = decision_list.thresholds(df)
    shares = sorted({*((k + 1) / 25 for k in range(24)), 0.005, 0.01, 0.02, 0.98, 0.99, 0.995})
    assert edges == {f: sorted({math.floor(v + 1e-9) for v in np.quantile(x[:, n], shares)}) for n, f in enumerate(FEATURES)}
    assert decision_list.grow(df, edges) == grown(x, y, edges)
    third = np.array([zlib.crc32(str(k).encode()) % 3 == 0 for k in range(len(y))])
    want = covered(x, y, third, edges, 3)
    assert decision_list.learn(df) == want and len(want) >= 2


@pytest.mark.parametrize("seed", range(4))
def test_splits_of_least_impurity(monkeypatch, seed):
    """A tree that may try all statistics splits where a search over all of them does."""
    monkeypatch.setattr(rule_ensemble, "TRIED", len(FEATURES))
    x, y = some_rows(300, seed)
    paths = set(rule_ensemble.tree_paths(x, y.astype(float), np.random.default_rng(seed)))

    def impurity(part):
        return 2 * part.sum() * (1 - part.mean()) if len(part) else 0.0

    def least(rows):
        tried = {(f, t): impurity(y[rows & (x[:, f] <= t)]) + impurity(y[rows & (x[:, f] > t)]) for f in range(len(FEATURES)) for t in np.unique(x[rows, f])[:-1]}
        return min(tried.values()), tried

    todo = [()]
    while todo:
        path = todo.pop()
        rows = rule_ensemble.covers(tuple(sorted(path)), x)
        longer = [p for p in paths if len(p) == len(path) + 1 and set(path) < set(p)]
        if len(path) == rule_ensemble.DEPTH or rows.sum() < 20 or y[rows].min() == y[rows].max():
            continue
        best, tried = least(rows)
        (name, _, t), = {c for p in longer for c in p if c not in path and not c[1]}
        assert tried[FEATURES.index(name), t] == pytest.approx(best)
        todo += [(*path, (name, above, t)) for above in (False, True)]


def test_weights_are_those_of_least_penalised_loss():
    """No rule that was tried, kept or not, could lower the penalised loss: the conditions of its minimum hold."""
    x, y = some_rows(800, 9)
    model = rule_ensemble.fit(x, y.astype(float))
    rng, rules = np.random.default_rng(10), {}
    for _ in range(rule_ensemble.TREES):
        drawn = rng.integers(0, len(y), len(y))
        rules |= dict.fromkeys(rule_ensemble.tree_paths(x[drawn], y[drawn].astype(float), rng))
    weights = dict(model.rules)
    assert 0 < len(weights) < len(rules) and set(weights) <= set(rules)
    total = model.bias + sum(w * rule_ensemble.covers(r, x) for r, w in weights.items())
    error = 1 / (1 + np.exp(-total)) - y
    assert abs(error.mean()) < 2e-4
    for r in rules:
        c = rule_ensemble.covers(r, x).astype(float)
        if 0 < c.mean() < 1:
            slope = ((c - c.mean()) / c.std() * error).mean()
            if r in weights:
                assert slope == pytest.approx(-rule_ensemble.PENALTY * np.sign(weights[r]), abs=2e-4)
            else:
                assert abs(slope) <= rule_ensemble.PENALTY + 2e-4
