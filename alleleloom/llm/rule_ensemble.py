"""Quality classifier: a sparse rule ensemble.

Small trees are fitted to the statistics of labelled texts; each path from a root is a rule, a conjunction of
thresholds; a logistic regression with a lasso penalty weighs the rules and drops most; the remaining ones
become Spark column expressions, so that all rows are scored without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .textstats import FEATURES, one_label, with_features, with_statistics

#: At most so many labelled rows are fitted, those whose ids have the least hashes: a few numbers of each come to the driver.
SAMPLE = 20_000
TREES, DEPTH, TRIED, EDGES, PENALTY, STEPS = 24, 3, 4, 32, 0.002, 600

#: (feature, above, threshold), each of which must hold.
Rule = tuple[tuple[str, bool, int], ...]


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """The chance of label 1 as an expression over the FEATURES."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            is_in = F.lit(True)
            for feature, above, t in rule:
                is_in = is_in & (F.col(feature) > t if above else F.col(feature) <= t)
            total = total + F.when(is_in, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[Rule]:
    """The paths of one tree: splits by Gini impurity among TRIED features, drawn anew at each node."""
    out: list[Rule] = []
    todo = [(np.arange(len(y)), ())]
    while todo:
        rows, path = todo.pop()
        if path:
            out.append(tuple(sorted(path)))
        ones = y[rows].sum()
        if len(path) >= DEPTH or len(rows) < 20 or ones in (0, len(rows)):
            continue
        best = (0.0, None, None)
        for f in rng.permutation(x.shape[1])[:TRIED]:
            values = x[rows, f]
            order = np.argsort(values, kind="stable")
            sorted_values, upto = values[order], np.cumsum(y[rows][order])
            ends = np.nonzero(sorted_values[1:] > sorted_values[:-1])[0]
            ends = ends[np.unique(np.linspace(0, len(ends) - 1, EDGES).astype(int))] if len(ends) > EDGES else ends
            if not len(ends):
                continue
            n, left, p = len(rows), ends + 1, upto[ends]
            impurity = 2 * p * (1 - p / left) + 2 * (ones - p) * (1 - (ones - p) / (n - left))
            gain = 2 * ones * (1 - ones / n) - impurity
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (gain[k], f, sorted_values[ends[k]])
        if best[1] is None:
            continue
        _, f, t = best
        low = x[rows, f] <= t
        todo += [(rows[low], (*path, (FEATURES[f], False, int(t)))), (rows[~low], (*path, (FEATURES[f], True, int(t))))]
    return out


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for feature, above, t in rule:
        values = x[:, FEATURES.index(feature)]
        out &= values > t if above else values <= t
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 10) -> Ensemble:
    """Rules and their lasso logistic weights; only the weights that aren't 0 stay."""
    if not len(y):
        return Ensemble(4.0, [])  # nothing is known against any text
    if y.min() == y.max():
        return Ensemble(4.0 if y[0] else -4.0, [])
    rng = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        drawn = rng.integers(0, len(y), len(y))
        rules |= dict.fromkeys(tree_paths(x[drawn], y[drawn], rng))
    names, columns, seen = [], [], set()
    for rule in rules:
        c = covers(rule, x)
        if 0 < c.sum() < len(c) and (key := c.tobytes()) not in seen:
            seen.add(key)
            names.append(rule)
            columns.append(c)
    r = np.array(columns, dtype=np.float64).T
    share = r.mean(axis=0)
    scale = np.sqrt(share * (1 - share))
    z = (r - share) / scale
    # Accelerated proximal steps on the mean log-loss; the intercept isn't penalised.
    w, b = np.zeros(z.shape[1]), math.log(y.mean() / (1 - y.mean()))
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / np.linalg.norm(np.hstack([z, np.ones((len(y), 1))]).T @ np.hstack([z, np.ones((len(y), 1))]) / len(y), 2)
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ error) / len(y)
        new, new_b = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0), c - step * error.mean()
        ahead = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / ahead * (new - w), new_b + (t - 1) / ahead * (new_b - b)
        w, b, t = new, new_b, ahead
    weights = w / scale
    kept = [(names[k], float(weights[k])) for k in np.nonzero(np.abs(w) > 1e-6)[0]]
    return Ensemble(float(b - (weights * share).sum()), kept)


def learn(docs: DataFrame, labels: DataFrame, folds: int, fold: int, sample: int = SAMPLE, seed: int = 10) -> Ensemble:
    """From rows with doc_id and text and labels with ``quality``: at most ``sample`` ids outside the fold.

    The ids with the least hashes are taken from the labels, so only their texts' statistics are worked out.
    """
    known = one_label(labels, "quality").filter(~held_out(F.col("__of"), folds, fold))
    ids = cut(known.orderBy(F.xxhash64("__of"), "__of").limit(sample))  # bounded, so it may be broadcast
    rows = docs.join(F.broadcast(ids), docs["doc_id"] == ids["__of"]).select("doc_id", "label", "text")
    stats = with_features(with_statistics(rows, ["doc_id", "label"]))
    # Rows that tie in all of these are alike, so reruns agree.
    drawn = stats.orderBy(F.xxhash64("doc_id"), *FEATURES, "label").limit(sample).select(*FEATURES, "label").collect()
    data = np.array([tuple(r) for r in drawn], dtype=np.int64).reshape(-1, len(FEATURES) + 1)
    return fit(data[:, :-1], data[:, -1].astype(np.float64), seed)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the checksum of the id's text falls into the fold that isn't learned from; a null id doesn't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def score_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, whole: bool = False, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """doc_id, held_out, score for every row; the score is the chance of quality 1. ``whole`` rows come along as ``row``.

    Only the statistics of the whole text go into a score. Null and empty texts have statistics of 0 and are
    scored like others. Labels that are null, neither 0 nor 1, or in contradiction are left out; without any
    the score is the same for all rows, near 1. Equal texts have equal scores; very long ones are read whole. No rows, no result rows. Other
    columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.struct("*").alias("row")] * whole)
    model = learn(rows, labels, folds, fold)
    stats = with_features(with_statistics(rows, ["doc_id"] + ["row"] * whole))
    out = held_out(F.col("doc_id"), folds, fold)
    # Spark would move a filter on the score below the statistics and work these out once for each mention; it
    # doesn't move one on a column that comes out of a list.
    return stats.select("doc_id", out.alias("held_out"), F.explode(F.array(model.score())).alias("score"), *["row"] * whole)


#: What a score must reach for label 1.
ACCEPT = 0.7


def op10_quality(spark, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
