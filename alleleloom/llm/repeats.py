"""Exact removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller id. Comparing
all suffixes is avoided as in bucket-pointer refinement: suffixes lie in buckets by their first Q bytes, a bucket
that holds one document is done, and the others are refined by the buckets of later offsets, with what is known of
a bucket by then. The buckets here are fingerprints of Q bytes, so that they mean the same in every task.

Texts are dealt out once, in parts of GROUP bytes, and every step reads them there. A part asks the tasks to which
buckets are dealt, and gets one answer for each of its questions, in the order in which they were put, so that no
answer says where in which text it belongs.

1. In each string of LENGTH bytes the Q-gram with the least fingerprint is its anchor, which depends on the
   string alone; equal strings meet in their anchor's bucket. Strings next to each other with one anchor are a
   context. First question, for each anchor, in three bytes: does its bucket hold several documents?
2. Contexts in such buckets are told apart by the buckets Q, 2Q, ... further on. Of equal ones, all but those of the
   least document go whole. For those left the refined buckets Q + 1 after and before the anchor tell whether a part of
   them, to either side, can still be equal to another one. That is the second question.
3. The strings of such sides are compared one by one, by fingerprints of 96 bits (64 where they differ within one Q-gram): the third question.

A bucket of more than HOT contexts isn't gathered in a task: its contexts are dealt out by their content, and
its refined buckets likewise, each as one pair of ids from a part. What a part knows to be repeated within itself goes at once and asks nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_keys, table

LENGTH, Q = 50, 16
#: Q-grams in a string; windows of the anchor's search.
W = LENGTH - Q + 1
#: Bytes of text that one array operation works on, and bytes of text in a part: what a task holds is bounded by these.
CHUNK, GROUP = 1 << 18, 6 << 20
#: Contexts that one bucket may have in a task. The result doesn't depend on it.
HOT = 1 << 14
LAST = (1 << 63) - 1
K = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def buckets_of(data: np.ndarray) -> np.ndarray:
    """The bucket of the Q-gram at each offset: 64 bits of its two halves, each mixed in two ways, so that none can be solved for given the others."""
    if len(data) < Q:
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    eight = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))
    first, second = eight[: len(data) - Q + 1], eight[8 : len(data) - Q + 9]
    other = mixed(eight * K[0])
    h = mixed(mixed(first ^ K[2]) * K[1] + second) ^ other[8 : len(data) - Q + 9] * K[3]
    return mixed(h + other[: len(data) - Q + 1])


def sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        a, n = f(a[:-n], a[n:]), 2 * n
    return f(a[: len(a) - (w - n)], a[w - n :]) if n < w else a


def strings_of(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits that identify the LENGTH bytes at each offset, from the buckets that cover them."""
    h = mixed(g[at] * K[0] + g[at + Q] * K[1])
    h = mixed(h + g[at + 2 * Q] * K[2] + g[at + LENGTH - Q] * K[3])
    other = mixed(g[at] * K[3] + g[at + Q] * K[2] + mixed(g[at + 2 * Q] * K[1] + g[at + LENGTH - Q] * K[0]))
    return h, (other >> np.uint64(32)).astype(np.uint32)


def contexts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: (text, first string, last string, anchor, bucket, context, behind, before) of each context.

    Offsets are into ``data``. ``behind`` and ``before`` are 16 bits of the buckets Q + 1 after and before the anchor
    together with its own, 0 where the context doesn't reach so far.
    """
    if len(data) < LENGTH:
        return tuple(np.empty(0, dtype=t) for t in "qqqqQQHH")
    g = buckets_of(data)
    least = sliding(g, W, np.minimum)
    n = len(least)
    pad = np.zeros(W - 1, dtype=np.uint64)
    is_anchor = g == sliding(np.concatenate([pad, least, pad]), W, np.maximum)
    anchors = np.nonzero(is_anchor)[0]
    # The anchor of a string is the leftmost one in it with the least bucket.
    k = np.cumsum(is_anchor)[:n] - is_anchor[:n]
    wrong = np.nonzero(g[anchors[k]] != least)[0]
    while len(wrong):
        k[wrong] += 1
        wrong = wrong[g[anchors[k[wrong]]] != least[wrong]]
    begins = np.concatenate([[0], ends[:-1]])
    within = np.arange(n) + LENGTH <= np.repeat(ends, ends - begins)[:n]
    at = np.nonzero(within)[0]
    if not len(at):
        return contexts(data[:0], ends)
    own = k[at]
    first = np.nonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))[0]
    last = np.concatenate([first[1:], [len(at)]]) - 1
    a, e, o = at[first], at[last], anchors[own[first]]
    text = np.searchsorted(ends, a, side="right")
    end = e + W - 1  # the last Q-gram of the context
    c = (o - a).astype(np.uint64) * K[0] + (e - a).astype(np.uint64) * K[1]
    for j in range(0, 2 * W, Q):
        c = mixed(c * K[2] + g[np.minimum(a + j, end)] * K[3])
    c = mixed(c * K[2] + g[end])

    def sixteen(other: np.ndarray, reaches: np.ndarray) -> np.ndarray:
        other = np.where(reaches, other, 0)
        return np.where(reaches, (mixed(g[o] * K[0] + g[other] * K[1]) >> np.uint64(48)) | np.uint64(1), 0).astype(np.uint16)

    # Least buckets are small numbers; mixed again, they are dealt out evenly.
    return text, a, e, o, mixed(g[o]), c, sixteen(o + Q + 1, o + Q + 1 <= end), sixteen(o - Q - 1, o - Q - 1 >= a)


def chunks(texts: Iterable[bytes], chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end, ``chunk`` bytes or so at a time: (bytes, ends, numbers of the texts, their offsets there).

    A longer text comes in pieces that share LENGTH - 1 bytes, so that each of its strings is in one piece.
    """
    parts, ends, numbers, offsets, size = [], [], [], [], 0
    for n, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), chunk):
            part = t[at : at + chunk + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            parts.append(part)
            size += len(part)
            ends.append(size)
            numbers.append(n)
            offsets.append(at)
            if size >= chunk:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(numbers), np.array(offsets)
                parts, ends, numbers, offsets, size = [], [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(numbers), np.array(offsets)


def low_bytes(a: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of each number, all first ones, all second ones and so on from the highest, which compresses where they ascend."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, n - 1 :: -1].T).tobytes()


def from_low_bytes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), dtype=np.uint8)
    out[:, n - 1 :: -1] = np.frombuffer(b, np.uint8).reshape(n, -1).T
    return out.view("<u8").ravel()


def groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """The number of the group of each row, where rows with equal keys lie together."""
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1


def firsts(group: np.ndarray) -> np.ndarray:
    return np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0] if len(group) else np.empty(0, np.int64)


def later(own: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether a row with equal keys has a smaller id."""
    order = np.lexsort(keys)
    group = groups(*(k[order] for k in keys))
    out = np.zeros(len(own), dtype=bool)
    if len(own):
        out[order] = own[order] > np.minimum.reduceat(own[order], firsts(group))[group]
    return out


def several(own: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether rows with equal keys have several ids."""
    order = np.lexsort(keys)
    group = groups(*(k[order] for k in keys))
    out = np.zeros(len(own), dtype=bool)
    if len(own):
        start = firsts(group)
        out[order] = (np.minimum.reduceat(own[order], start) < np.maximum.reduceat(own[order], start))[group]
    return out


#: Questions and answers: to which task or part, of which kind, from where; and packed columns, as each kind has them.
LETTER = "to int, kind int, at int, ids binary, doc binary, h binary, c binary, x binary, y binary, n binary"
ANCHORS, CONTEXTS, HOT_CONTEXTS, SIDES, STRINGS, KNOWN, MARKS = range(7)
GONE = 4


def letters(rows: list[dict], schema: str = LETTER) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def task_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def dealt(to: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The order in which rows are sent, and the bounds of each letter in it."""
    order = np.argsort(to, kind="stable")
    cuts = [*firsts(to[order]).tolist(), len(to)]
    return order, list(zip(cuts, cuts[1:]))


def answered(to: np.ndarray, answers: pa.Table, kind: int) -> np.ndarray:
    """What is answered to rows that were sent ``to`` tasks, in their own order."""
    order, _ = dealt(to)
    mine = answers.filter(pa.array(answers["kind"].to_numpy() == kind))
    by = dict(zip(mine["at"].to_pylist(), mine["n"].to_pylist()))
    out = np.zeros(len(to), dtype=np.uint8)
    out[order] = np.frombuffer(b"".join(by[t] for t in sorted(by)), np.uint8)
    return out


def with_ids(ids: np.ndarray, doc: np.ndarray) -> dict:
    used, index = np.unique(doc, return_inverse=True)
    return {"ids": ids[used].tobytes(), "doc": index.astype(np.uint32).tobytes()}


def ids_of(letters_: pa.Table) -> tuple[np.ndarray, list[int]]:
    """The ids of all rows in letters, and where each letter's rows begin and end."""
    own = [np.frombuffer(i, np.int64)[np.frombuffer(d, np.uint32)] for i, d in zip(letters_["ids"].to_pylist(), letters_["doc"].to_pylist())]
    return np.concatenate(own), np.cumsum([0] + [len(x) for x in own]).tolist()


class Part:
    """The texts of a part, in an order that depends on them alone, and their contexts."""

    def __init__(self, texts: pa.Table, parts: int, chunk: int):
        self.number, self.parts, self.chunk = texts["part"][0].as_py(), parts, chunk
        self.order = np.lexsort([texts[c].to_numpy() for c in ("k2", "k1", "id")])
        self.ids = texts["id"].to_numpy()[self.order]
        self.column = texts["text"]

    def text(self, doc: int) -> bytes:
        return self.column[int(self.order[doc])].as_py()

    def find(self) -> None:
        """Sets doc, start, more (strings after the first), back (from the first to the anchor), h, c, behind, before."""
        found = []
        for data, ends, numbers, offsets in chunks((self.text(k) for k in range(len(self.ids))), self.chunk):
            t, a, e, o, *more = contexts(data, ends)
            found.append((numbers[t], a + (offsets - np.concatenate([[0], ends[:-1]]))[t], (e - a).astype(np.uint8), (o - a).astype(np.uint8), *more))
        empty = [np.empty(0, t) for t in "qqBBQQHH"]
        self.doc, self.start, self.more, self.back, self.h, self.c, self.behind, self.before = (np.concatenate([e, *x]) for e, x in zip(empty, zip(*found) if found else [()] * 8))
        self.own = self.ids[self.doc]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, each by the task of its bucket and the low 24 bits, and the anchor of each context."""
        return np.unique(task_of(self.h, self.parts) << 24 | (self.h & np.uint64(0xFFFFFF)).astype(np.int64), return_inverse=True)

    def choose(self, known: pa.Table) -> None:
        """Keeps only the contexts in buckets of several documents; sets ``hot`` and ``gone`` (repeated within the part)."""
        v, anchor = self.anchors()
        state = answered(v >> 24, known, KNOWN)[anchor]
        for name in ("doc", "start", "more", "back", "h", "c", "behind", "before", "own"):
            setattr(self, name, getattr(self, name)[state > 0])
        self.hot, self.gone = state[state > 0] == 2, later(self.own, self.c, self.h)

    def questions(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For contexts, those of hot buckets, and their two sides: (which contexts, to which task)."""
        cold, hot = np.nonzero(~self.gone & ~self.hot)[0], np.nonzero(~self.gone & self.hot)[0]
        return {CONTEXTS: (cold, task_of(self.h[cold], self.parts)), HOT_CONTEXTS: (hot, task_of(mixed(self.h[hot] + self.c[hot] * K[1]), self.parts))}

    def sides(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct refined buckets of contexts: (value, least id, greatest id, which of them each context has behind and before or -1)."""
        x = np.stack([self.behind[hot], self.before[hot]])
        value = mixed(self.h[hot] * K[0] + x.astype(np.uint64) * K[1] + np.array([[2], [3]], np.uint64) * K[2])
        u, index = np.unique(value[x > 0], return_inverse=True)
        own = np.stack([self.own[hot]] * 2)[x > 0]
        least, most = np.full(len(u), LAST), np.full(len(u), -LAST - 1)
        np.minimum.at(least, index, own)
        np.maximum.at(most, index, own)
        of = np.full(x.shape, -1)
        of[x > 0] = index
        return u, least, most, of


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with ``whole`` also ``kept_text`` and ``row``.

    ``n_spans`` are maximal removed runs. ``kept_text`` are the remaining bytes as text; bytes that the removal has
    cut off from their character are left out there, and only there. A null text stays null there. ``row`` is a struct of
    all columns of ``docs``, whatever their names, with a null in place of the text.

    A null text is empty. A null id counts as greater than all others; rows with one id, null included, don't
    remove from each other. Texts under LENGTH bytes stay whole. Equal rows are treated alike. Texts of any length are
    read in pieces, and equal rows are dealt to parts by where they are read. Contexts and strings are taken for equal if fingerprints of 96 bits agree, of which strings that differ
    within one Q-gram share 32; a Q-gram's 64 bits are no sum of its bytes, so unequal ones with equal bits have to be searched for. No rows, no result rows.
    """
    id_ = F.col(id_col).cast("long")
    columns = [F.lit(None).cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(
        id_.alias("doc_id"), F.coalesce(id_, F.lit(LAST)).alias("id"), *row_keys(F.col(id_col), F.col(text_col)),
        F.coalesce(F.encode(F.col(text_col), "utf-8"), F.lit(b"")).alias("text"), F.col(text_col).isNull().alias("no_text"),
        *([F.struct(*columns).alias("row")] if whole else []),
    )
    total = rows.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    chunk, parts = CHUNK, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP))

    def ask_anchors(texts: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            p = Part(texts, parts, chunk)
            p.find()
            v, anchor = p.anchors()
            order, start = np.argsort(anchor, kind="stable"), np.cumsum(np.concatenate([[0], np.bincount(anchor, minlength=len(v))]))[:-1]
            least, most = (f.reduceat(p.own[order], start) if len(v) else start for f in (np.minimum, np.maximum))
            n = np.minimum(np.diff(np.append(start, len(order))), 127).astype(np.uint8) | ((least < most).astype(np.uint8) << 7)
            order, cuts = dealt(v >> 24)
            return letters([{"to": int(v[lo] >> 24), "kind": ANCHORS, "at": p.number, "h": low_bytes(v[lo:hi], 3), "n": n[lo:hi].tobytes()} for lo, hi in cuts])

    def tell_anchors(asked: pa.Table) -> pa.Table:
        h, n = ([f(x) for x in asked[c].to_pylist()] for c, f in (("h", lambda x: from_low_bytes(x, 3)), ("n", lambda x: np.frombuffer(x, np.uint8))))
        ends = np.cumsum([len(x) for x in h])[:-1]
        _, index, times = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        n = np.concatenate(n)
        held, inside = np.bincount(index, weights=n & 127), np.bincount(index, weights=n >> 7)
        state = np.where((times > 1) | (inside > 0), np.where(held > HOT, 2, 1), 0).astype(np.uint8)[index]
        return letters([{"to": p, "kind": KNOWN, "at": t, "n": x.tobytes()} for p, t, x in zip(asked["at"].to_pylist(), asked["to"].to_pylist(), np.split(state, ends))])

    def ask_contexts(texts: pa.Table, known: pa.Table) -> pa.Table:
        if not texts.num_rows or not known.num_rows:
            return letters([])
        with np.errstate(over="ignore"):
            p = Part(texts, parts, chunk)
            p.find()
            p.choose(known)
            out = [{"to": p.number, "kind": KNOWN, "at": t, "n": n} for t, n in zip(known["at"].to_pylist(), known["n"].to_pylist())]
            for kind, (which, to) in p.questions().items():
                order, cuts = dealt(to)
                for lo, hi in cuts:
                    at = which[order[lo:hi]]
                    packed = {"h": low_bytes(p.h[at] >> np.uint64(16), 6), "c": low_bytes(p.c[at] >> np.uint64(16), 6)}
                    packed |= {"x": p.behind[at].tobytes(), "y": p.before[at].tobytes()} if kind == CONTEXTS else {}
                    out.append({"to": int(to[order[lo]]), "kind": kind, "at": p.number} | packed | with_ids(p.ids, p.doc[at]))
            value, least, most, _ = p.sides(p.questions()[HOT_CONTEXTS][0])
            order, cuts = dealt(task_of(value, parts))
            for lo, hi in cuts:
                at = order[lo:hi]
                out.append({"to": int(task_of(value[at[:1]], parts)[0]), "kind": SIDES, "at": p.number, "h": value[at].tobytes(), "x": least[at].tobytes(), "y": most[at].tobytes()})
            return letters(out)

    def tell_contexts(asked: pa.Table) -> pa.Table:
        out = []
        for kind in (CONTEXTS, HOT_CONTEXTS, SIDES, KNOWN):
            some = asked.filter(pa.array(asked["kind"].to_numpy() == kind))
            if kind == KNOWN:
                out.append(some)
            elif some.num_rows:
                if kind == SIDES:
                    value, least, most = (np.frombuffer(b"".join(some[c].to_pylist()), t) for c, t in (("h", np.uint64), ("x", np.int64), ("y", np.int64)))
                    bounds = np.cumsum([0] + [len(x) // 8 for x in some["h"].to_pylist()]).tolist()
                    both = np.concatenate([value, value])
                    told = several(np.concatenate([least, most]), both)[: len(value)].astype(np.uint8)
                else:
                    own, bounds = ids_of(some)
                    h, c = (np.concatenate([from_low_bytes(x, 6) for x in some[n].to_pylist()]) for n in "hc")
                    gone = later(own, c, h)
                    told = gone.astype(np.uint8) * GONE
                    if kind == CONTEXTS:
                        left = np.nonzero(~gone)[0]
                        for bit, n in ((1, "x"), (2, "y")):
                            side = np.frombuffer(b"".join(some[n].to_pylist()), np.uint16)[left]
                            told[left] |= (several(own[left], side, h[left]) & (side > 0)).astype(np.uint8) * np.uint8(bit)
                out.append(letters([{"to": p, "kind": kind, "at": t, "n": told[lo:hi].tobytes()} for p, t, lo, hi in zip(some["at"].to_pylist(), some["to"].to_pylist(), bounds, bounds[1:])]))
        return pa.concat_tables(out)

    def ask_strings(texts: pa.Table, known: pa.Table) -> pa.Table:
        if not texts.num_rows or not known.num_rows:
            return letters([])
        with np.errstate(over="ignore"):
            p = Part(texts, parts, chunk)
            p.find()
            p.choose(known)
            told, asked = p.gone.astype(np.uint8) * GONE, p.questions()
            for kind, (which, to) in asked.items():
                told[which] = answered(to, known, kind)
            hot = asked[HOT_CONTEXTS][0]
            value, _, _, of = p.sides(hot)
            shared = np.append(answered(task_of(value, parts), known, SIDES), 0)
            told[hot] |= np.where(told[hot] == GONE, 0, shared[of[0]] + 2 * shared[of[1]]).astype(np.uint8)
            gone, left = told == GONE, np.nonzero((told > 0) & (told != GONE))[0]
            doc, start, more, back = (getattr(p, n)[left].astype(np.int64) for n in ("doc", "start", "more", "back"))
            # Behind the anchor's half only strings that reach to its shared bucket, before it likewise.
            lo = np.where(told[left] & 2, 0, np.maximum(0, back - Q - 1))
            n = np.where(told[left] & 1, more, np.minimum(more, back - Q - 1)) - lo + 1
            at = np.repeat(start + lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            doc = np.repeat(doc, n)
            s, s2 = np.empty(len(at), np.uint64), np.empty(len(at), np.uint32)
            piece = firsts(groups(doc, at // chunk))
            for b, e in zip(piece, np.append(piece[1:], len(doc))):
                data, first = p.text(doc[b]), at[b]
                s[b:e], s2[b:e] = strings_of(buckets_of(np.frombuffer(data[first : at[e - 1] + LENGTH], np.uint8)), at[b:e] - first)
            own = later(p.ids[doc], s2, s)
            spans = joined(np.append(p.doc[gone], doc[own]), np.append(p.start[gone], at[own]), np.append(p.more[gone] + np.int64(LENGTH), np.full(own.sum(), LENGTH)))
            doc, at, s, s2 = doc[~own], at[~own], s[~own], s2[~own]
            to = task_of(s, parts)
            order, cuts = dealt(to)
            out = [
                {"to": int(to[order[lo]]), "kind": STRINGS, "at": p.number, "h": s[order[lo:hi]].tobytes(), "c": s2[order[lo:hi]].tobytes()} | with_ids(p.ids, doc[order[lo:hi]])
                for lo, hi in cuts
            ]
            steps = {"doc": doc.astype(np.uint32), "x": np.diff(at, prepend=0), "y": to.astype(np.uint16 if parts <= 1 << 16 else np.uint32)}
            out.append({"to": p.number, "kind": MARKS, "at": -1, "ids": np.stack(spans).tobytes()} | {k: x.tobytes() for k, x in steps.items()})
            return letters(out)

    def tell_strings(asked: pa.Table) -> pa.Table:
        out = [asked.filter(pa.array(asked["kind"].to_numpy() == MARKS))]
        some = asked.filter(pa.array(asked["kind"].to_numpy() == STRINGS))
        if some.num_rows:
            own, bounds = ids_of(some)
            s, s2 = (np.frombuffer(b"".join(some[c].to_pylist()), t) for c, t in (("h", np.uint64), ("c", np.uint32)))
            told = later(own, s2, s).astype(np.uint8)
            out.append(letters([{"to": p, "kind": STRINGS, "at": t, "n": told[lo:hi].tobytes()} for p, t, lo, hi in zip(some["at"].to_pylist(), some["to"].to_pylist(), bounds, bounds[1:])]))
        return pa.concat_tables(out)

    def removed(texts: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows:
            p, spans = Part(texts, parts, chunk), np.empty((3, 0), np.int64)
            marks = told.filter(pa.array(told["kind"].to_numpy() == MARKS)) if told.num_rows else told
            if marks.num_rows:
                m = marks.to_pylist()[0]
                doc, at = np.frombuffer(m["doc"], np.uint32).astype(np.int64), np.cumsum(np.frombuffer(m["x"], np.int64))
                gone = answered(np.frombuffer(m["y"], np.uint16 if parts <= 1 << 16 else np.uint32).astype(np.int64), told, STRINGS) > 0
                spans = np.frombuffer(m["ids"], np.int64).reshape(3, -1)
                more = doc[gone], at[gone], np.full(gone.sum(), LENGTH)
                spans = joined(*(np.append(x, y) for x, y in zip(spans, more)))
            bounds = np.searchsorted(spans[0], np.arange(len(p.ids) + 1)).tolist()
            for doc in range(len(p.ids)):
                data, kept, done = p.text(doc), [], 0
                for k in range(bounds[doc], bounds[doc + 1]):
                    kept.append(data[done : spans[1][k]])
                    done = int(spans[1][k] + spans[2][k])
                kept = b"".join([*kept, data[done:]])
                out.append((len(data), len(data) - len(kept), bounds[doc + 1] - bounds[doc], hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if whole else None))
            texts = texts.drop_columns(["text"]).take(pa.array(p.order))
        columns = [texts["doc_id"], *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if whole:
            none = texts["no_text"].to_pylist()
            columns += [pa.array([None if x else o[4] for o, x in zip(out, none)], pa.string()), texts["row"]]
            names += ["kept_text", "row"]
        return pa.table(columns, names)

    schema = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if whole:
        schema = schema.add("kept_text", "string").add(rows.schema["row"])
    # Equal rows are dealt out by the input partition that they are in, so that no part holds all of them.
    texts = rows.withColumn("part", F.pmod(F.xxhash64("k1", F.spark_partition_id()), F.lit(parts)).cast("int")).groupBy("part")
    known = texts.applyInArrow(ask_anchors, LETTER).groupBy("to").applyInArrow(tell_anchors, LETTER)
    known = texts.cogroup(known.groupBy("to")).applyInArrow(ask_contexts, LETTER).groupBy("to").applyInArrow(tell_contexts, LETTER)
    known = texts.cogroup(known.groupBy("to")).applyInArrow(ask_strings, LETTER).groupBy("to").applyInArrow(tell_strings, LETTER)
    return texts.cogroup(known.groupBy("to")).applyInArrow(removed, schema)


def joined(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes, in order of texts and offsets."""
    order = np.lexsort((start, doc))
    doc, start, end = (x[order].astype(np.int64) for x in (doc, start, start + size))
    if not len(doc):
        return doc, start, end
    # Texts lie far apart on one line, so that one running maximum does for all.
    far = groups(doc) << 40
    upto = np.maximum.accumulate(far + end)
    first = np.nonzero(np.concatenate([[True], far[1:] + start[1:] > upto[:-1]]))[0]
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], upto[last] - far[last] - start[first]


def op4_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
