"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

The encoding of a prefix ends in exactly one token t that is compatible with the last token of what stands
before it, so the encoding of every prefix is known from one table: its last token and its token count. The
table answers how long a text is in tokens, where to cut it for a budget, and what any prefix costs, without
encoding anything again. (A cut in the middle of a character belongs to the prefix before that character.) White space ends a piece in the vocabularies read here, so the table of a text is the
running sum of the tables of its words, and each distinct word is worked out once per Python worker.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Distinct words that a worker remembers at once, each of so many bytes at most; beyond the number it starts anew.
REMEMBERED, SHORT = 700_000, 48
#: The rank of a pair that no merge joins.
NONE = 1 << 60


class PrefixCounter:
    """Exact token counts of every prefix for a tokenizer file with BPE merges and an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_file(path)
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.special_pattern = re.compile(b"|".join(map(re.escape, sorted(self.special)))) if self.special else None
        vocab = [t for t in model["vocab"] if t.encode() not in self.special]
        # What may join across the left or right edge of a token: its parts at that edge, each with the rank at
        # which it becomes part of a larger one. Only tokens that are their own encoding can stand in one.
        self.halves: dict[str, tuple[str, str]] = {}
        own = set()
        for t in vocab:
            plain = t.removesuffix(self.suffix)
            symbols = [*plain[:-1], plain[-1:] + t[len(plain) :]] if plain else []
            if self.merged(symbols) == [t]:
                own.add(t)
        self.right_edge = {t: self.edge(t, 1) for t in own}
        self.left_edge = {t: self.edge(t, 0) for t in own}
        self.ends = {t.removesuffix(self.suffix): t for t in own if t.endswith(self.suffix)}
        self.inner = {t for t in own if not self.suffix or not t.endswith(self.suffix)}
        self.longest = max(map(len, self.ends), default=1)
        self.reach = max(self.longest, max(map(len, self.inner), default=1))
        self.tree: dict = {}
        for t in self.inner:
            node = self.tree
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        self.pattern = self.ascii_pattern(spec)
        self.known_pairs: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, int] = {}
        self.words: dict[bytes, int] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The encoding of a few symbols by applying merges in order of rank."""
        symbols = list(symbols)
        rank = self.ranks.get
        ranks = [rank(p, NONE) for p in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < NONE:
            k = ranks.index(least)
            both = symbols[k] + symbols[k + 1]
            self.halves.setdefault(both, (symbols[k], symbols[k + 1]))
            symbols[k : k + 2] = [both]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((symbols[k - 1], symbols[k]), NONE)
            if k < len(ranks):
                ranks[k] = rank((symbols[k], symbols[k + 1]), NONE)
        return symbols

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        out = [(token, NONE)]
        while both := self.halves.get(token):
            token = both[side]
            out.append((token, self.ranks[both]))
        return out

    def fits(self, last: str, token: str) -> bool:
        """Whether ``token`` follows ``last`` in the encoding of the two together.

        It doesn't if parts of both would join across the border before either joins its own neighbour; of
        equal ranks the one further left goes first.
        """
        found = self.known_pairs.get((last, token))
        if found is None:
            rank = self.ranks.get
            found = not any(
                rank((x, y), NONE) < x_joins and rank((x, y), NONE) <= y_joins
                for x, x_joins in self.right_edge[last]
                for y, y_joins in self.left_edge[token]
            )
            if len(self.known_pairs) >= REMEMBERED:
                self.known_pairs.clear()
            self.known_pairs[last, token] = found
        return found

    @staticmethod
    def ascii_pattern(spec: dict):
        """The pattern by which the file splits texts, where lower case is all that it does to printable ASCII first."""
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
            if parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
                return regex.compile(parts[0]["pattern"]["Regex"])
        return None

    def piece_states(self, piece: str) -> tuple[list[str | None], list[int]]:
        """The last token and the tokens of each prefix of a piece (with characters already mapped to bytes' symbols) that goes on behind it."""
        n, tree, fits = len(piece), self.tree, self.fits
        last, tokens = [None] * (n + 1), [0] * (n + 1)
        last[0] = ""
        for j in range(n):
            before, node, more = last[j], tree, tokens[j] + 1
            for i in range(j, n):
                node = node.get(piece[i])
                if node is None:
                    break
                # One token alone can end a prefix: once found, no other is tried.
                if last[i + 1] is None and (t := node.get("")) is not None and (not j or fits(before, t)):
                    last[i + 1] = t
                    tokens[i + 1] = more
        return last, tokens

    def ended(self, piece: str, i: int, last: list[str | None], tokens: list[int], begins: bool = True) -> int:
        """The tokens of a piece's first ``i`` symbols as a piece of their own: its last token then ends a word. ``begins``: the lists are of the piece from its first symbol on."""
        for j in range(max(0, i - self.longest), i):
            t = self.ends.get(piece[j:i])
            if t is not None and (begins and not j or self.fits(last[j], t)):
                return tokens[j] + 1
        raise ValueError("a piece that the vocabulary can't spell")

    def piece_table(self, piece: str, every: bool = True) -> list[int]:
        """Tokens of each prefix of a piece, from length 1. Not ``every``: of the whole piece alone, in a list of one."""
        last, tokens = self.piece_states(piece)
        return [self.ended(piece, i, last, tokens) for i in (range(1, len(piece) + 1) if every else (len(piece),))]

    def with_tail(self, piece: str, at: int, states: tuple[list[str | None], list[int]], tail: str) -> int:
        """The tokens of a piece's first ``at`` symbols and ``tail`` behind them, from the states of the piece; only as many as the longest token are looked at again."""
        low = max(0, at - self.reach)
        symbols, last, tokens = piece[low:at] + tail, states[0][low : at + 1], states[1][low : at + 1]
        for i in range(at - low + 1, len(symbols)):
            for j in range(max(0, i - self.reach), i):
                t = symbols[j:i]
                if t in self.inner and (not low and not j or self.fits(last[j], t)):
                    last.append(t)
                    tokens.append(tokens[j] + 1)
                    break
        return self.ended(symbols, len(symbols), last, tokens, begins=not low)

    def split(self, word: bytes) -> list[str]:
        """The pieces of a text without ASCII white space, as symbols; special tokens are empty pieces, of one token."""
        out, at = [], 0
        for found in self.special_pattern.finditer(word) if self.special_pattern else ():
            out += [*self.plain(word[at : found.start()]), ""]
            at = found.end()
        return out + self.plain(word[at:]) if at else self.plain(word)

    def plain(self, word: bytes) -> list[str]:
        """The pieces of a text without ASCII white space or special strings."""
        text = word.decode()
        if self.pattern and text.isascii() and text.isprintable():  # as the library below, without its calls' cost
            return self.pattern.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def word_count(self, word: bytes) -> int:
        n = self.words.get(word)
        if n is None:
            n = sum(map(self.piece_count, self.split(word)))
            if len(word) <= SHORT:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = n
        return n

    def piece_count(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            n = 1 if not piece or piece in self.ends else self.piece_table(piece, every=False)[0]
            if len(piece) <= SHORT:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = n
        return n

    def count(self, text: bytes) -> int:
        known, count = self.words.get, self.word_count
        total = 0
        for w in text.split():
            n = known(w)
            total += count(w) if n is None else n
        return total

    def word_table(self, word: bytes) -> list[int]:
        """Tokens of each prefix of a text without ASCII white space, from one byte on; a character counts from its last byte."""
        out, before, at = [], 0, 0
        for found in self.special_pattern.finditer(word) if self.special_pattern else ():
            plain, special = word[at : found.start()], found[0]
            out += [before + n for n in self.plain_table(plain)]
            # Part of a special string is text like that before it.
            out += [before + self.word_count(plain + special[:k]) for k in range(1, len(special))]
            before, at = before + self.word_count(plain) + 1 if plain else before + 1, found.end()
            out.append(before)
        return out + [before + n for n in self.plain_table(word[at:])]

    def plain_table(self, word: bytes) -> list[int]:
        """Tokens of each prefix of a text without white space or special strings, from one byte on.

        The text is cut where normalisation joins nothing across, so that a prefix up to such a place is normalised to a prefix of
        the whole, whose tokens are in the tables of its pieces. A prefix that ends in a character and some of its marks goes on from
        there by what these are normalised to.
        """
        runs = self.unjoined(word.decode())
        normal = [self.library.normalizer.normalize_str(r) for r in runs]
        whole = "".join(normal)
        found = self.library.pre_tokenizer.pre_tokenize_str(whole)
        bounds = [(start, end) for _, (start, end) in found]
        states, ends = [self.piece_states(p) for p, _ in found], [start for start, _ in bounds]
        before, size = [0, *accumulate(self.piece_count(p) for p, _ in found)], [0, *accumulate(len(c.encode()) for c in whole)]
        out, at = [], 0
        for run, to in zip(runs, normal):
            for k in range(1, len(run) + 1):
                tail = to if k == len(run) else self.library.normalizer.normalize_str(run[:k])
                out += [out[-1] if out else 0] * (len(run[k - 1].encode()) - 1)
                now = at + len(to)
                p = bisect_right(ends, now - 1) - 1  # the piece that holds the last character
                if k == len(run) and to and p >= 0 and now <= bounds[p][1] and whole[ends[p]] != "'":
                    out.append(before[p] + self.ended(found[p][0], size[now] - size[ends[p]], *states[p]))
                else:
                    out.append(self.upto(whole, at, tail, found, bounds, states, before, ends, size))
            at += len(to)
        return out

    def upto(self, whole: str, at: int, tail: str, found: list, bounds: list, states: list, before: list[int], starts: list[int], size: list[int]) -> int:
        """The tokens of ``whole`` up to ``at`` and then ``tail``."""
        k = bisect_right(starts, at - 1) - 1  # the piece that holds the character before
        if k < 0 or bounds[k][1] < at:
            return before[k + 1] + sum(self.piece_count(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(tail))
        piece, start = found[k][0], bounds[k][0]
        if "'" in whole[max(0, at - 3) : at] and at - start <= 3:  # marks and letters may be one piece or two
            k -= k > 0 and bounds[k - 1][1] == start and whole[start - 1] == "'"
            again = whole[bounds[k][0] : at] + tail
            return before[k] + sum(self.piece_count(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(again))
        own = whole[max(start, at - 4) : at]
        first, *more = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(own + tail)]
        bytes_ = size[at] - size[start]
        joined = first[len(own.encode()) :]
        n = self.with_tail(piece, bytes_, states[k], joined) if joined else self.ended(piece, bytes_, *states[k])
        return before[k] + n + sum(map(self.piece_count, more))

    @staticmethod
    def unjoined(text: str) -> list[str]:
        """The text in runs between which normalisation joins nothing: each begins with a character that can't join the one before it."""
        if text.isascii():
            return list(text)
        starts = [0, *(k for k in range(1, len(text)) if text[k] < "\u0300" or text[k] not in joining())]
        return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])] if text else []

    def prefix_counts(self, text: bytes) -> list[int]:
        """Tokens of each prefix of the text, from one byte on: those of its words before, and of the part of a word at its end."""
        out, total, tables = [], 0, {}
        for w in text.split():
            start = text.index(w, len(out))
            out += [total] * (start - len(out))
            if w not in tables:
                tables[w] = self.word_table(w)
            out += [total + n for n in tables[w]]
            total = out[-1]
        return out + [total] * (len(text) - len(out))

    def cut(self, text: bytes, budget: int, most: int | None = None) -> int:
        """Bytes of the longest prefix of at most ``budget`` tokens; ``most`` are the tokens of the text, where they are known."""
        if most is not None and most <= budget:
            return len(text)
        words = text.split()
        upto = list(accumulate(map(self.word_count, words)))
        k = bisect_right(upto, budget)
        if k == len(words):
            return len(text)
        # The word that takes the text over the budget begins behind the first k and the white space behind those.
        start = len(text) - len(text.split(None, k)[k]) if k else text.index(words[0])
        left = budget - (upto[k - 1] if k else 0)
        return start + max((n for n, tokens in enumerate(self.word_table(words[k]), 1) if tokens <= left), default=0)


@cache
def joining() -> frozenset[str]:
    """Characters that composition may join to one before them: marks that have a class, and second parts of characters that can be taken apart."""
    out = {chr(c) for r in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for c in range(*r)}  # vowels and ends of Hangul syllables
    for c in map(chr, range(0x300, 0x110000)):
        if unicodedata.combining(c):
            out.add(c)
        of = unicodedata.decomposition(c).split()
        if len(of) > 1 and not of[0].startswith("<"):
            out.update(chr(int(x, 16)) for x in of[1:])
    return frozenset(out)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One for each Python worker: its tables are kept from one batch to the next."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def tokenizer_path(name: str) -> str:
    """The file of a public vocabulary where this process runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(
    docs: DataFrame, name: str = "word_bpe_49k.json", prefixes: bool = False, budget: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row; with ``prefixes`` also the table, with a ``budget`` where to cut.

    ``prefix_tokens`` has the tokens of the text's first byte, its first two bytes and so on; a character counts from its last
    byte. ``cut_bytes`` is the length of the longest prefix of at most ``budget`` tokens, read off the same table.

    A null text is empty: 0 bytes, 0 tokens, an empty table. Special strings inside texts are one token, as in
    the library, however many there are. Equal rows have equal counts. Texts go through one at a time, so a batch holds no more than
    its texts. Very long texts and words are read whole, in time that grows with their length (with ``prefixes`` or a ``budget`` also with the
    square of the longest run of combining marks on one character); only words of up to SHORT bytes are remembered. No rows, no result rows. Other columns are not read, whatever their names.
    """
    fields = "doc_id long, n_bytes long, n_tokens long" + ", prefix_tokens array<long>" * prefixes + ", cut_bytes long" * (budget is not None)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer_path(name))
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            counts = [tokens.count(t) for t in texts]
            out = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())]
            if prefixes:
                out.append(pa.array(map(tokens.prefix_counts, texts), pa.list_(pa.int64())))
            if budget is not None:
                out.append(pa.array([tokens.cut(t, budget, n) for t, n in zip(texts, counts)], pa.int64()))
            yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in fields.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "utf-8").alias("text")).mapInArrow(counted, fields)


#: Tokens beyond which a document is over the limit.
LIMIT = 2048


def op5_tokens(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), budget=LIMIT).withColumn("over_limit", F.col("n_tokens") > LIMIT)
