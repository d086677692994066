"""Quality rules: a decision list learned by sequential covering.

Each rule is a conjunction of thresholds on a text's statistics. It is grown on two thirds of the labelled
rows, condition by condition, by information gain; cut back on the other third to the conditions that hold
up there; and the rows that it covers are set aside before the next one is grown. The result is an ordered
Spark conditional expression. All counts are Spark aggregations over all labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .textstats import COUNTS, FEATURES, labelled, with_features, with_statistics

#: Thresholds tried for each statistic, conditions in a rule, rules in a list.
THRESHOLDS, CONDITIONS, RULES = 24, 3, 12
#: A rule must be right for this share of what it covers in the pruning rows, and cover as many there.
PRECISION, SUPPORT = 0.9, 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


def holds(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def thresholds(rows: DataFrame) -> dict[str, list[int]]:
    shares = [(k + 1) / (THRESHOLDS + 1) for k in range(THRESHOLDS)]
    shares = sorted({*shares, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995})
    found = rows.agg(*[F.percentile(f, shares).alias(f) for f in FEATURES]).first()
    return {f: sorted({math.floor(x) for x in found[f] or []}) for f in FEATURES}


def histogram(rows: DataFrame, edges: dict[str, list[int]]) -> dict[str, list[tuple[int, int]]]:
    """For each feature, and each bin between its thresholds, the rows of class 1 and of class 0."""
    bins = []
    for f, at in edges.items():
        number = F.lit(0)
        for t in at:
            number = number + (F.col(f) > t).cast("int")
        bins.append(F.struct(F.lit(f).alias("feature"), number.alias("bin")))
    counts = rows.select("label", F.explode(F.array(*bins)).alias("b")).groupBy("b.feature", "b.bin")
    out = {f: [(0, 0)] * (len(at) + 1) for f, at in edges.items()}
    for r in counts.agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros")).collect():
        out[r["feature"]][r["bin"]] = (r["ones"], r["zeros"])
    return out


def grow(rows: DataFrame, edges: dict[str, list[int]]) -> tuple[Condition, ...]:
    """Conditions that single out class 0, the best by information gain first."""
    rule: tuple[Condition, ...] = ()
    while len(rule) < CONDITIONS:
        counts = histogram(rows.filter(holds(rule)), edges)
        ones, zeros = (sum(x[k] for x in counts[FEATURES[0]]) for k in (0, 1))
        if not zeros or not ones:
            break
        base, best = math.log2(zeros / (zeros + ones)), (0.0, None)
        for f, at in edges.items():
            low = [0, 0]
            for t, (o, z) in zip(at, counts[f]):
                low = [low[0] + o, low[1] + z]
                for above, o1, z1 in ((False, *low), (True, ones - low[0], zeros - low[1])):
                    if z1:
                        gain = z1 * (math.log2(z1 / (z1 + o1)) - base)
                        best = max(best, (gain, Condition(f, above, t)), key=lambda x: x[0])
        if best[1] is None:
            break
        rule += (best[1],)
    return rule


def prune(rows: DataFrame, rule: tuple[Condition, ...]) -> tuple[tuple[Condition, ...], float, int]:
    """The best leading part of a rule on rows not used to grow it, its precision there and the rows it finds."""
    sums = []
    for k in range(1, len(rule) + 1):
        is_in = holds(rule[:k])
        sums += [F.count_if(is_in & (F.col("label") == 0)).alias(f"z{k}"), F.count_if(is_in & (F.col("label") == 1)).alias(f"o{k}")]
    r = rows.agg(*sums).first()
    worth = [((r[f"z{k}"] - r[f"o{k}"]) / max(1, r[f"z{k}"] + r[f"o{k}"]), -k) for k in range(1, len(rule) + 1)]
    k = -max(worth)[1]
    return rule[:k], r[f"z{k}"] / max(1, r[f"z{k}"] + r[f"o{k}"]), r[f"z{k}"]


def learn(rows: DataFrame) -> list[tuple[Condition, ...]]:
    """The rules that reject, in order, from rows with FEATURES, ``label`` (0 is what to reject) and doc_id."""
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    edges = {f: at for f, at in thresholds(rows).items() if at}
    rules: list[tuple[Condition, ...]] = []
    if len(edges) < len(FEATURES):
        return rules  # no labelled rows
    while len(rules) < RULES:
        rule = grow(rows.filter(~third), edges)
        if not rule:
            break
        rule, right, found = prune(rows.filter(third), rule)
        if right < PRECISION or found < SUPPORT:
            break
        rules.append(rule)
        rows = rows.filter(~holds(rule))
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The decision list as one expression: the first rule that holds rejects; otherwise the row is kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(holds(rule), F.lit(False)).otherwise(out)
    return out


def judge_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the COUNTS, base_failed and kept for every row.

    Rows with under 10 words or over 20 % repeated words fail the base rules; the others are kept unless the
    learned list rejects them. Null and empty texts have no words and fail. Labels that are null, neither 0
    nor 1, or in contradiction are left out; without labels the list is empty. Ties between conditions go to
    the first in the order of FEATURES and thresholds. Equal rows are judged alike, each for itself; very long texts are
    judged whole. No rows, no result rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = cut(with_features(with_statistics(rows, ["doc_id"])))
    rules = learn(cut(labelled(stats, labels, "quality").select("doc_id", "label", *FEATURES)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def base_columns(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the COUNTS that have a contract, and base_failed: what the base rules see, without any learned verdict."""
    stats = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])
    return stats.select("doc_id", *COUNTS[:5], ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"))


def quality_base_columns(spark, sf_dir: str) -> DataFrame:
    return base_columns(table(spark, sf_dir, "documents"))


BASE_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
windows as (select r, i, array_to_string(ws[i:i + 4], ' ') as k from w, unnest(range(1, len(ws) - 3)) as u(i)),
again as (select r, i from (select *, count(*) over (partition by r, k) as c from windows) x where c > 1),
covered as (select r, count(distinct i + j) as n from again, (select unnest(range(0, 5)) as j) s group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from (
  select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words from w left join covered c on w.r = c.r) x
"""
