"""Toxicity by a linear-chain conditional random field over a text's words.

Labels mark whole texts; which words offend is hidden. Each word is plain or offending, and a text is toxic if at
least one of its words offends. The field has potentials for an offending word, by the word and its neighbours, and for
the step from one class to the next. It is fitted to the texts' labels by summing over all taggings that agree with a
label: of a clean text that is the one without any offending word, of a toxic one all others. Forward-backward marginals
are the gradient, and the offending spans; the chance that no word offends is the score, by a logistic curve fitted to the labelled texts.

A text's matrices are multiplied in pairs, the products in pairs again, for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table
from .near_copies import FIRST, batches, eights, hashes, mixed, words
from .rule_ensemble import held_out
from .textstats import one_label

#: At most so many labelled texts of either class are fitted, those whose ids have the least hashes, each as a whole, and of them as
#: many as have BYTES bytes together (the first one in any case). Scoring has no such bounds.
TOXIC, CLEAN, BYTES = 1500, 3500, 12 << 20
#: Features are those that the fitted texts have between so many different neighbours (copies of a text have the same).
SUPPORT, PAIR_SUPPORT = 10, 6
#: A word of which toxic texts speak this many times as often as clean ones, or more, starts as an offending one, with this log potential.
RARER, START = 20, 6.0
#: Steps of gradient ascent, each for a batch of texts, however many texts there are.
STEPS, BATCH, RATE, PENALTY = 160, 128, 0.15, 3e-3
#: Words of a batch, padded to its longest text; a longer text is a batch of its own.
CELLS = 1 << 20
#: Log potential of any offending word at first: texts have many words, and most are plain.
BIAS = -9.0
#: Bytes that begin a word, each such prefix being a feature of it.
PREFIXES = (4, 5, 6, 7)
#: What a word is without the marks around it: ASCII letters and digits, and all other characters.
LETTER = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def featured(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, features) of the words of texts laid end to end, whose first words are at ``firsts``; each feature is a number, 0 for none.

    A word's features are its form (lower case, without marks around it), the form's first bytes, and the form with that of the word before it.
    """
    starts, ends = words(data)
    at, letter = np.arange(len(data)), LETTER[data]
    s = np.minimum(np.minimum.accumulate(np.where(letter, at, len(data))[::-1])[::-1][starts], ends)
    e = np.maximum(np.maximum.accumulate(np.where(letter, at, -1))[ends - 1] + 1, s)
    form, eight, length = hashes(data, s, e) | np.uint64(1), eights(data)[s], e - s
    out = np.zeros((len(PREFIXES) + 2, len(starts)), dtype=np.uint64)
    out[0] = np.where(length > 0, form, 0)
    for k, n in enumerate(PREFIXES, 1):
        out[k] = np.where(length >= n, mixed((eight & FIRST[n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) | np.uint64(1), 0)
    before = np.concatenate([np.zeros(min(1, len(form)), np.uint64), form[:-1]])
    before[firsts] = 0
    out[-1] = mixed(before * np.uint64(0xD6E8FEB86659FD93) + mixed(form)) | np.uint64(1)
    return starts, ends, out


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the texts end to end, the number of words of each)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return data, np.diff(np.searchsorted(words(data)[0], np.concatenate([[0], ends])))


def first_words(n: np.ndarray) -> np.ndarray:
    return (np.cumsum(n) - n)[n > 0]


def product_of_each(m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product of each run of ``n`` matrices (the four entries of each, laid end to end in ``m``), scaled, and the log of the scale; runs are not empty."""
    log = np.zeros(m.shape[1])
    while m.shape[1] > len(n):
        half = (n + 1) // 2
        first = np.cumsum(half) - half
        left = np.repeat(np.cumsum(n) - n - 2 * first, half) + 2 * np.arange(half.sum())
        alone = (first + half - 1)[n % 2 == 1]  # the last of a run of odd length
        right = np.minimum(left + 1, m.shape[1] - 1)
        (a, b, c, d), (e, f, g, h) = m[:, left], m[:, right]
        product = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h])
        product[:, alone] = m[:, left[alone]]
        more = log[right]
        more[alone] = 0
        scale = product.max(axis=0)
        m, log, n = product / scale, log[left] + more + np.log(scale), half
    return m, log


@dataclass
class Field:
    """Log potentials of an offending word, ``bias`` and those of its features (``keys`` in order, ``weights``), and of ``step`` from class to class."""

    bias: float = BIAS
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: The curve from the log odds of any offending word to the score.
    slope: float = 1.0
    shift: float = 0.0

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """The log potential of each word as an offending one."""
        out = np.full(features.shape[1], self.bias)
        for f in features if len(self.keys) else ():
            at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            out += np.where(self.keys[at] == f, self.weights[at], 0.0)
        return out

    def odds(self, emission: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log odds that any word offends, of texts of ``n`` words whose emissions are laid end to end; -50 for none."""
        out = np.full(len(n), -50.0)
        if len(emission):
            local, trans = np.exp(np.clip(emission, -60, 60)), np.exp(self.step)
            same = np.ones(len(emission))
            product, log = product_of_each(np.stack([trans[0, 0] * same, trans[0, 1] * local, trans[1, 0] * same, trans[1, 1] * local]), n[n > 0])
            total = np.log(product[0] + product[1]) + log  # a plain word stands before the first
            gap = np.minimum(n[n > 0] * self.step[0, 0] - total, -1e-15)  # log of the chance that no word offends
            out[n > 0] = np.clip(np.log(-np.expm1(gap)) - gap, -50, 50)
        return out

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        out = [np.empty(0)]
        for part in batches(texts):
            data, n = laid_out(part)
            out.append(self.odds(self.emissions(featured(data, first_words(n))[2]), n))
        return np.concatenate(out)

    def marginals(self, emission: np.ndarray) -> np.ndarray:
        """The chance of each word of a text that it offends."""
        local, trans, n = np.exp(np.clip(emission, -60, 60)), np.exp(self.step), len(emission)
        forward, backward = np.zeros((n + 1, 2)), np.ones((n + 1, 2))
        forward[0, 0] = 1
        for k in range(n):
            forward[k + 1] = forward[k] @ trans * (1, local[k])
            forward[k + 1] /= forward[k + 1].sum()
        for k in range(n - 1, -1, -1):
            backward[k] = trans @ (backward[k + 1] * (1, local[k]))
            backward[k] /= backward[k].sum()
        both = forward[1:] * backward[1:]
        return both[:, 1] / both.sum(axis=1)

    def score(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.shift, -40, 40)))


def chosen_features(features: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starting weights) of the features that texts of ``n`` words have between enough different neighbours."""
    form, first = features[0], first_words(n)
    before, after = (np.concatenate(x) for x in ((np.zeros(1, np.uint64), form[:-1]), (form[1:], np.zeros(1, np.uint64))))
    before[first], after[first - 1] = 0, 0
    y = np.repeat(toxic, n).astype(np.uint64)
    place = mixed(mixed(before * np.uint64(0xD6E8FEB86659FD93) + form) * np.uint64(0xA0761D6478BD642F) + after + y * np.uint64(0x589965CC75374CC3))
    once = np.unique(place, return_index=True)[1]
    total = np.bincount(y[once].astype(int), minlength=2) + 1
    keys, start = [np.empty(0, np.uint64)], [np.empty(0)]
    for k, f in enumerate(features):
        u, index = np.unique(f[once], return_inverse=True)
        counts = np.stack([np.bincount(index[y[once] == c], minlength=len(u)) for c in (0, 1)])
        enough = (counts.sum(axis=0) >= (PAIR_SUPPORT if k == len(features) - 1 else SUPPORT)) & (u > 0)
        often = np.log((counts[1] + 0.5) / total[1]) - np.log((counts[0] + 0.5) / total[0]) > np.log(RARER)
        keys.append(u[enough])
        start.append(np.where(often & (k == 0), START, 0.0)[enough])
    keys, start = np.concatenate(keys), np.concatenate(start)
    order = np.argsort(keys)
    return keys[order], start[order]


def gradient(step: np.ndarray, emission: np.ndarray, mask: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood of the labels, its gradient by each emission, by the steps) for padded rows of words; ``weight`` of each row."""
    b, width = emission.shape
    local, trans = np.exp(np.clip(emission, -60, 60)), np.exp(step)
    fw, bw, log = np.zeros((width + 1, b, 2)), np.ones((b, 2)), np.zeros(b)
    fw[0, :, 0] = 1
    for k in range(width):
        new = fw[k] @ trans
        new[:, 1] *= local[:, k]
        norm = new.sum(axis=1)
        fw[k + 1] = np.where(mask[:, k, None], new / norm[:, None], fw[k])
        log += np.where(mask[:, k], np.log(norm), 0)
    n = mask.sum(axis=1)
    gap = np.minimum(n * step[0, 0] - log, -1e-12)
    some = -np.expm1(gap)
    value = (weight * np.where(toxic, np.log(some), gap)).sum()
    # By the log-chance of no offending word: of a clean text itself, of a toxic one what it takes from the rest.
    share = weight * np.where(toxic, -np.exp(gap) / some, 1.0)
    by_emission, pair = np.zeros_like(emission), np.zeros((b, 2, 2))
    for k in range(width - 1, -1, -1):
        here = bw * np.stack([np.ones(b), local[:, k]], axis=1)
        joint = fw[k][:, :, None] * trans * here[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        joint *= mask[:, k, None, None]
        pair += joint
        by_emission[:, k] = -share * joint[:, :, 1].sum(axis=1)
        new = here @ trans.T
        bw = np.where(mask[:, k, None], new / new.sum(axis=1, keepdims=True), bw)
    by_step = -(share[:, None, None] * pair).sum(axis=0)
    by_step[0, 0] += (share * n).sum()
    return float(value), by_emission, by_step


def fitting(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Where batches of texts of these lengths, in rough order, begin and end: BATCH texts, or as many as have CELLS words with their padding."""
    out, first, width = [], 0, 1
    for k, n in enumerate(lengths.tolist()):
        if k > first and (k - first == BATCH or (k - first + 1) * max(width, n) > CELLS):
            out.append((first, k))
            first, width = k, 1
        width = max(width, n)
    return [*out, (first, len(lengths))]


def fit(texts: list[bytes], toxic: np.ndarray, clean_weight: float = 1.0) -> Field:
    """A field from whole texts and their labels; a clean text stands for ``clean_weight`` of them in the curve."""
    if not len(texts) or toxic.min() == toxic.max():
        return Field(shift=0.0 if not len(texts) else 50.0 * (2 * float(toxic[0]) - 1), slope=0.0)
    y = toxic.astype(bool)
    lengths, features = [], []
    for part in batches(texts):  # what is made of each byte on the way is many times as large as the texts
        data, n = laid_out(part)
        lengths.append(n)
        features.append(featured(data, first_words(n))[2])
    lengths, features = np.concatenate(lengths), np.concatenate(features, axis=1)
    keys, start = chosen_features(features, lengths, y)
    if not len(keys):
        return Field(slope=0.0)
    at, known = np.empty(features.shape, np.int32), np.empty(features.shape, bool)
    for k, f in enumerate(features):
        at[k] = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
        known[k] = keys[at[k]] == f
    del features, f
    begins = np.cumsum(lengths) - lengths
    f, rng = len(keys), np.random.default_rng(8)
    theta = np.concatenate([start, [BIAS, 0.0, 0.0, 0.0, 0.0]])
    seen = np.full(len(theta), 1e-6)
    for _ in range(-(-STEPS // -(-len(texts) // BATCH))):
        order = rng.permutation(len(texts))
        order = order[np.argsort(lengths[order] // 64, kind="stable")]  # texts of like length together, as padding costs time
        parts = fitting(lengths[order])
        for k in rng.permutation(len(parts)):
            some = order[slice(*parts[k])]
            width = max(1, int(lengths[some].max()))
            mask = np.arange(width) < lengths[some][:, None]
            word = (begins[some][:, None] + np.arange(width))[mask]
            have, col = known[:, word], at[:, word]
            emission = np.zeros(mask.shape)
            emission[mask] = theta[f] + np.where(have, theta[col], 0.0).sum(axis=0)
            _, by_emission, by_step = gradient(theta[f + 1 :].reshape(2, 2), emission, mask, y[some], np.ones(len(some)))
            own = by_emission[mask]
            grad = np.bincount(col[have], np.broadcast_to(own, have.shape)[have], len(theta))
            grad[f], grad[f + 1 :] = own.sum(), by_step.ravel()
            grad -= PENALTY * theta * (np.arange(len(theta)) != f)
            seen += grad**2
            theta += RATE * grad / np.sqrt(seen)
    model = Field(float(theta[f]), keys, theta[:f], theta[f + 1 :].reshape(2, 2))
    # The curve, by Newton's steps of a weighted logistic regression with two parameters.
    odds = model.of_texts(texts) / 10
    x, weight, p = np.stack([odds, np.ones(len(odds))], axis=1), np.where(toxic == 1, 1.0, clean_weight), np.zeros(2)
    for _ in range(30):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        h = (x * (weight * s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(2)
        p = p + np.clip(np.linalg.solve(h, x.T @ (weight * (toxic - s)) - 1e-3 * p), -2, 2)
    model.slope, model.shift = float(p[0] / 10), float(p[1])
    return model


def learn(docs: DataFrame, labels: DataFrame, folds: int, fold: int, most: tuple[int, int] = (CLEAN, TOXIC)) -> Field:
    """From docs with doc_id and text (as bytes) and labels with ``toxic`` outside the fold; see TOXIC for the bounds.

    The ids are drawn from the labels, so only their texts go anywhere.
    """
    known = cut(one_label(labels, "toxic").filter(~held_out(F.col("__of"), folds, fold)))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = [known.filter(F.col("label") == c).orderBy(F.xxhash64("__of"), "__of").limit(most[c]) for c in (0, 1)]
    ids = cut(least[0].unionByName(least[1]))  # bounded, so it may be broadcast

    rows = docs.join(F.broadcast(ids), docs["doc_id"] == ids["__of"]).select("doc_id", "label", "text").withColumn("h", F.xxhash64("doc_id"))
    place = Window.partitionBy("label").orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a bounded number of rows
    rows = rows.withColumns({"upto": F.sum(F.octet_length("text") + 1).over(place), "k": F.count(F.lit(1)).over(place)})
    limit = F.when(F.col("label") == 1, most[1]).otherwise(most[0])
    drawn = rows.filter((F.col("k") == 1) | (F.col("k") <= limit) & (F.col("upto") <= BYTES)).orderBy("h", "doc_id", "text").select("label", "text").collect()
    n1 = sum(r["label"] for r in drawn)
    weight = counts.get(0, 0) * max(1, n1) / (max(1, len(drawn) - n1) * max(1, counts.get(1, 0)))
    return fit([bytes(r["text"]) for r in drawn], np.array([r["label"] for r in drawn], dtype=float), weight)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score for every row; with ``spans`` also the offending words' offsets and marginals.

    ``spans`` are (start, end, marginal) of words whose marginal is at least a half, in bytes of the text; words
    next to each other are one span with the greatest marginal. Only the text goes into a score.

    Very long texts are fitted and scored whole. A null text is empty; empty texts get the score of texts in which no word offends. Labels that are null, neither
    0 nor 1, or in contradiction are left out; without labels all scores are a half. Equal texts have equal
    scores. No rows, no result rows. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    model = learn(rows, labels, folds, fold)
    fields = "doc_id long, held_out boolean, score double" + ", spans array<struct<start:long, end:long, marginal:double>>" * spans
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def scored(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in stream:
                texts = [x.as_py() for x in batch.column(1)]
                out = [batch.column(0), batch.column(2), pa.array(model.score(model.of_texts(texts)), pa.float64())]
                if spans:
                    out.append(pa.array([offsets(model, t) for t in texts], kind))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score"] + ["spans"] * spans)

    return rows.select("doc_id", "text", "held_out").mapInArrow(scored, fields)


def offsets(model: Field, text: bytes) -> list[dict]:
    starts, ends, features = featured(np.frombuffer(text + b" ", np.uint8), np.zeros(min(1, len(text.split(None, 1))), np.int64))
    out, last = [], -2
    for k in np.nonzero((m := model.marginals(model.emissions(features))) >= 0.5)[0].tolist():
        if last == k - 1:
            out[-1] |= {"end": int(ends[k]), "marginal": max(float(m[k]), out[-1]["marginal"])}
        else:
            out.append({"start": int(starts[k]), "end": int(ends[k]), "marginal": float(m[k])})
        last = k
    return out


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
