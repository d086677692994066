"""Spelling variant grouping: pairs of words one edit apart, by merging the light subtrees of a trie.

Two words one edit apart part at one node of the trie of all words. There the heavy child is the one with the most words below
it; every other child, and the end of a word, is light, and a word passes few light edges: with each of them what is left of
the words halves at least. Only light words are merged. At its light edge a word is read with one character skipped: where it comes out
as another light word of the node with its own character skipped, one is replaced by the other. It is also looked up, as a
whole word, with its character left out, with the heavy child's character in its place, and with that character put in before it. Those four are all
pairs that part there, each found once; terminals that coincide are one-edit pairs.

The words are dealt out in ranges of the alphabet, and each task builds the trie of its range. A node that several ranges share, of
which there are at most as many as letters in the words at the ranges' ends, counts its children in all of them first, so that all agree on its heavy child.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Letters, and A to Z in both cases: fixed values of the contract.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a range, that is in the trie of one task.
RANGE = 20_000


def occurrences(docs: DataFrame, least: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """``word`` for each run of letters of at least ``least`` code points, in lower case, one in ``every`` of the different ones of a document with a letter left out."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("of"), F.explode(runs).alias("run"))
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))  # lower() knows more letters
    rows = rows.select("of", low.alias("run")).withColumn("h", F.crc32(F.encode(F.concat_ws(":", "of", "run"), "utf-8")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % every == 0, without).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.char_length("word") >= least)


def common(a: str, b: str) -> int:
    """How many characters ``a`` and ``b`` begin with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    if high < 64:
        return next(k for k in range(high) if a[k] != b[k])
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class Trie:
    """The sorted words of a range, of which every node is a stretch; ``before`` and ``after`` are the words next to the range.

    A node is open if words outside the range belong to it as well. Those are nodes on the path to the first or the last word.
    """

    def __init__(self, words: list[str], before: str | None, after: str | None):
        self.words, self.open = words, {}
        first, last = words[0], words[-1]
        self.left = -1 if before is None else common(before, first)  # nodes down to this depth are open, on the first word's path
        self.right = -1 if after is None else common(last, after)
        self.both = common(first, last)
        self.heavy: dict[tuple[str, int], str] = {}

    def open_at(self, low: int, high: int, depth: int) -> tuple[str, int] | None:
        """The name of the open node of this depth of which ``low`` to ``high`` is the stretch, if it is one."""
        if low == 0 and depth <= self.left:
            return "first", depth
        if high == len(self.words) and depth <= self.right:
            return ("first" if depth <= min(self.both, self.left) else "last"), depth
        return None

    def open_children(self) -> Iterator[tuple[str, int, bytes, str | None, int]]:
        """Of each open node its path, depth and digest, and of each child in this range the character and its words; a node without any has one row without a character."""
        words, n = self.words, len(self.words)
        start = min(self.both, self.left) + 1
        alike = [common(words[0], w) for w in words] if self.left >= 0 else []  # falls
        yield from self._children("first", words[0], 0, self.left, lambda d: (0, bisect_right(alike, -d, key=lambda x: -x)))
        alike_last = [common(words[-1], w) for w in words] if self.right >= start else []  # grows
        yield from self._children("last", words[-1], start, self.right, lambda d: (bisect_left(alike_last, d), n))

    def _children(self, path: str, word: str, start: int, stop: int, stretch) -> Iterator[tuple[str, int, bytes, str | None, int]]:
        digest = hashlib.sha256(word[:start].encode())
        for depth in range(start, stop + 1):
            counts, (low, high), deeper = {}, stretch(depth), stretch(depth + 1) if depth < len(word) else (0, 0)
            if depth < len(word):
                counts[word[depth]] = deeper[1] - deeper[0]
            for k in (*range(low, min(deeper[0], high)), *range(max(deeper[1], low), high)):
                if len(self.words[k]) > depth:
                    counts[self.words[k][depth]] = counts.get(self.words[k][depth], 0) + 1
            name = digest.digest()
            for c, m in counts.items() or [(None, 0)]:
                yield path, depth, name, c, m
            if depth < len(word):
                digest.update(word[depth].encode())

    def light_edges(self) -> Iterator[tuple[int, int, int, str, bool]]:
        """(low, high, depth, heavy, is_end): the words of a stretch go through a light edge below depth, or end there, beside the child of the character ``heavy``."""
        opened = sorted({d for _, d in self.heavy})
        stack = [(0, len(self.words), 0)]
        while stack:
            low, high, above = stack.pop()
            depth = common(self.words[low], self.words[high - 1])
            # Nodes with one child here may have more in other ranges.
            for d in opened[bisect_left(opened, above) : bisect_left(opened, depth)]:
                h = self.heavy.get(self.open_at(low, high, d))
                if h is not None and h != self.words[low][d]:
                    yield low, high, d, h, False
            children, at = [], low + (len(self.words[low]) == depth)
            while at < high:
                c = self.words[at][depth]
                end = bisect_right(self.words, c, at, high, key=lambda w: w[depth])
                children.append((at, end, c))
                at = end
            name = self.open_at(low, high, depth)
            if name is not None:
                h = self.heavy.get(name)
            else:
                h = max(children, key=lambda x: x[1] - x[0])[2] if children else None  # the first of equals
            if h is not None:
                if len(self.words[low]) == depth:
                    yield low, low + 1, depth, h, True
                for a, b, c in children:
                    if c != h:
                        yield a, b, depth, h, False
            stack.extend((a, b, depth + 1) for a, b, c in children if b - a > 1 or self.open_at(a, b, depth + 1))

    def merged(self) -> Iterator[tuple[bool, str, int, str]]:
        """(is_word, key, place, word): a whole word to look up, or a light word's rest with the character at ``place`` skipped."""
        for low, high, d, h, is_end in self.light_edges():
            for k in range(low, high):
                w = self.words[k]
                head, tail = w[:d], w[d:]
                yield True, head + h + tail, d, w
                if not is_end:
                    if tail[1:2] != tail[0]:  # of equal characters in a row the last one is left out
                        yield True, head + tail[1:], d, w
                    yield True, head + h + tail[1:], d, w
                    yield False, head + tail[1:], d, w


def ranges(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words (word, n) with the number of their range, written; and (part, before, after) with the words next to each range, written."""
    n = words.count()
    ranged = cut(words.repartitionByRange(max(1, math.ceil(n / RANGE)), "word").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"))
    beside = Window.orderBy("part")  # one row for each range
    return ranged, cut(ends.select("part", F.lag("last").over(beside).alias("before"), F.lead("first").over(beside).alias("after")))


def trie_of(words: pd.DataFrame, ends: pd.DataFrame) -> Trie:
    known = lambda x: None if pd.isna(x) else x
    return Trie(sorted(words["word"]), known(ends["before"].iloc[0]), known(ends["after"].iloc[0]))


def one_edit_keys(ranged: DataFrame, ends: DataFrame) -> DataFrame:
    """(is_word, key, place, word) as the tries' merging gives them, written."""

    def opened(words: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        rows = list(trie_of(words, of).open_children()) if len(words) else []
        out = pd.DataFrame(rows, columns=["path", "depth", "node", "child", "m"])
        return out.assign(part=words["part"].iloc[0] if len(words) else 0)

    def merged(words: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        columns = ["is_word", "key", "place", "word"]
        if not len(words):
            return pd.DataFrame([], columns=columns)
        trie = trie_of(words, of)
        trie.heavy = {(p, d): c for p, d, c in zip(of["path"], of["depth"], of["heavy"]) if isinstance(p, str)}
        return pd.DataFrame(trie.merged(), columns=columns)

    parts = ranged.select("part", "word").groupBy("part")
    opens = cut(parts.cogroup(ends.groupBy("part")).applyInPandas(opened, "path string, depth int, node binary, child string, m long, part int"))
    children = opens.filter("child is not null").groupBy("node", "child").agg(F.sum("m").alias("m"))
    heavy = children.groupBy("node").agg(F.min(F.struct((-F.col("m")).alias("m"), "child"))["child"].alias("heavy"))
    asked = opens.groupBy("part", "path", "depth", "node").agg(F.lit(1).alias("one")).join(heavy, "node").select("part", "path", "depth", "heavy")
    asked = ends.join(asked, "part", "left")
    return cut(parts.cogroup(asked.groupBy("part")).applyInPandas(merged, "is_word boolean, key string, place int, word string"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near): of each word with near ones their number and the best of them, a struct of ``less`` (its n, negative) and ``word``."""
    ranged, ends = ranges(words)
    keys = one_edit_keys(ranged, ends)
    number = ranged.select(F.col("word").alias("key"), F.col("n").alias("key_n"))
    own = ranged.select("word", "n")
    found = keys.filter("is_word").select("key", "word").join(number, "key").join(own, "word")
    best = lambda n, w: F.struct((-F.col(n)).alias("less"), F.col(w).alias("word")).alias("near")
    one = F.lit(1).cast("long").alias("n_near")
    sides = F.array(F.struct(F.col("word"), one, best("key_n", "key")), F.struct(F.col("key").alias("word"), one, best("n", "word")))
    pairs = found.select(F.inline(sides))
    # Words that are equal but for the skipped character: as many as there are letters at most.
    groups = keys.filter("not is_word").select("key", "place", "word").join(own, "word")
    groups = groups.groupBy("key", "place").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))).alias("all")).filter(F.size("all") > 1)
    others = groups.select(F.inline(F.transform("all", lambda x, k: F.struct(
        x["word"].alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(k == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("near")
    ))))
    return pairs.unionByName(others).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form), following forms to their end, by doubling: forms at least double in n, so a handful of steps do."""
    chains = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = chains.select(F.col("word").alias("at"), F.col("root").alias("further"))
        longer = chains.join(on, F.col("root") == F.col("at"), "left")
        if longer.filter("further is not null").isEmpty():
            return chains
        chains = cut(longer.select("word", F.coalesce("further", "root").alias("root")))


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n): different words, none of them null, with numbers above 0.

    ``form`` is the one-edit neighbour of greatest n, of equal ones the smallest in code-point order, if that n is at least ``ratio`` (2 or more) times
    the word's. Words may be of any length, empty ones too. No rows, no result rows.
    """
    near = near_words(words)
    form = F.when(-F.col("near.less") >= ratio * F.col("n"), F.col("near"))
    rows = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form")))
    ends = roots(rows.filter("form is not null").select("word", F.col("form.word").alias("form")))
    rows = rows.join(ends, "word", "left")
    return rows.select("word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("form.less")).alias("form_n"))


def spelling_variants(docs: DataFrame, least: int = 5, times: int = 3, ratio: int = 2, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least ``least`` letters that all texts have ``times`` times or more.

    A null or empty text has no words, and a null id counts as an empty one in the checksum that picks the words to shorten. Very long
    texts and words are read whole. Each of several equal rows counts. Words of equal n are taken by code point. No rows, no result
    rows. Other columns are not read, whatever their names.
    """
    words = occurrences(docs, least, every, id_col, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)
    return group_variants(cut(words), ratio)


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
