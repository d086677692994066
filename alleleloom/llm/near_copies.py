"""Near copies by chosen-path set similarity join.

A text's set are its distinct shingles of five words. Independent trees branch the sets by minwise tokens: at each
node a set goes to the child of its token that is least under the chosen hash function. A node of few members is
compared exhaustively in one task, first by minima, then on the full sets of those members that minima don't rule
out. A larger node branches on: it has 1/threshold children functions on average, so that pairs at the threshold
hold and those below thin out.

1. Equal sets are one class (by a 128-bit digest of the set) from the start.
2. The first level has TREES nodes a class. Nodes of one member go at once. A pair is compared in the first tree
   in which it meets in a small node, and in no other.
3. Large nodes are dealt out in random blocks, each compared like a small node. Where the links so found join a whole
   node, it is done; else it branches on. What is still large after LEVELS more levels is compared block by block.
4. Tasks emit links that join a node's components, never pairs, so neither copies nor near copies come all with all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_keys, small, table

WORDS, PERCENT = 5, 85
#: Trees; levels below the first; hash functions: one a tree for the first level, then a pool of as many for each level.
TREES, LEVELS, POOL = 16, 6, 8
FUNCTIONS = TREES + LEVELS * POOL
#: Members and shingles of a node that one task compares exhaustively. This bounds memory, not what is compared.
NODE, TOKENS = 2048, 1 << 20
#: Chance that the minima of a pair at the threshold rule it out.
RULED_OUT = 1e-8
CHUNK = 1 << 18
LAST = (1 << 63) - 1
K = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_draw = np.random.Generator(np.random.PCG64(3))
XOR, MULTIPLY = (_draw.integers(0, 1 << 31, FUNCTIONS).astype(np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The first 0 to 8 bytes of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mixed(h):
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    space = SPACE[data]
    starts = np.nonzero(~space & np.concatenate([[True], space[:-1]]))[0]
    return starts, np.nonzero(~space & np.concatenate([space[1:], [True]]))[0] + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for the bytes of each span, A to Z in lower case: no two spans of under eight bytes share one, longer ones have 64 bits of a digest."""
    n = ends - starts
    if not len(n):
        return np.empty(0, np.uint64)
    whole = eights(data)[starts] & FIRST[np.minimum(n, 7)] | np.minimum(n, 7).astype(np.uint64) << np.uint64(56)
    out = mixed(mixed(whole ^ K[0]) * K[2])
    long = np.nonzero(n > 7)[0]
    if len(long):
        low = LOWER[data].tobytes()
        found = ((low[s:e], e - s) for s, e in zip(starts[long].tolist(), ends[long].tolist()))
        out[long] = np.fromiter((known_digest(w) if m <= KNOWN else digest(w) for w, m in found), np.uint64, len(long))
    return out


def digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


#: Digests of words up to this long are kept, up to so many of them.
KNOWN = 64
known_digest = lru_cache(1 << 17)(digest)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset as one number, A to Z in lower case."""
    lower = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=lower, strides=(1,))


def shingles(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct fingerprints of each text's shingles."""
    for part in batches(texts):
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        starts, ends = words(data)
        each = hashes(data, starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in part]))
        if len(each) >= WORDS:
            m = len(each) - WORDS + 1
            windows = np.full(m, K[4])
            for k in range(WORDS):  # one after the other: sums of words' numbers could be made equal
                windows = mixed((windows ^ each[k : k + m]) * K[1] + K[3])
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo >= WORDS:
                yield np.unique(windows[lo : hi - WORDS + 1])
            elif hi > lo:
                h = np.array([hi - lo], dtype=np.uint64)
                for w in each[lo:hi]:
                    h = mixed((h ^ w) * K[1] + K[3])
                yield h
            else:
                yield np.empty(0, dtype=np.uint64)


def batches(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def minima(tokens: np.ndarray) -> np.ndarray:
    """The least value of the tokens under each hash function, 31 bits each."""
    out = np.full(FUNCTIONS, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(tokens), 2048):
        h = ((tokens[at : at + 2048] >> np.uint64(32)).astype(np.uint32)[None, :] ^ XOR[:, None]) * MULTIPLY[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, h.min(axis=1))
    return (out >> np.uint32(1)).astype(np.int32)


def class_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def signed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, k1, k2) and the class, size and minima of each text's set; the class is null where that is empty."""
    with np.errstate(over="ignore"):
        for batch in stream:
            sets = [(class_of(s), len(s), minima(s)) if len(s) else (None, 0, None) for s in shingles(x.as_py() for x in batch.column(3))]
            columns = [pa.array([s[0] for s in sets], pa.binary()), pa.array([s[1] for s in sets], pa.int64()), pa.array([s[2] for s in sets], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "k1", "k2", "c", "n_shingles", "minima"])


def as_sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in stream:
            sets = list(shingles(x.as_py() for x in batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(map(class_of, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "tokens"])


def agreeing(percent: int) -> int:
    """How many minima agree for a pair at the threshold, but for a chance of RULED_OUT."""
    s, below = percent / 100, 0.0
    for k in range(FUNCTIONS + 1):
        below += comb(FUNCTIONS, k) * s**k * (1 - s) ** (FUNCTIONS - k)
        if below > RULED_OUT:
            return k
    return FUNCTIONS


def by_node(f: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]) -> Callable:
    """Calls ``f(rows, starts, sizes)`` with whole nodes, of which a partition sorted by its first column holds the rows."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            held: list[pa.RecordBatch] = []
            for batch in stream:
                if not batch.num_rows:
                    continue
                node = batch.column(0).to_numpy()
                open_ = int(np.argmax(node == node[-1]))
                if not open_ and (not held or held[0].column(0)[0].as_py() == node[0]):
                    held.append(batch)
                    continue
                yield from whole([*held, batch.slice(0, open_)])
                held = [batch.slice(open_)]
            yield from whole(held)

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            node = rows.column(0).to_numpy()
            starts = np.nonzero(np.concatenate([[True], node[1:] != node[:-1]]))[0]
            yield from f(rows, starts, np.diff(np.concatenate([starts, [len(node)]]))).to_batches()

    return run


def opened(percent: int, agree: int) -> Callable:
    """(node, c) of the members with another member that sizes and minima don't rule out, and with which neither an earlier
    tree nor a link has brought them together.

    Members are (node, c, n, tree, done, root, minima): ``done`` has a bit for each tree whose first node is compared
    exhaustively, ``tree`` is the number of such trees that come first, ``root`` names the component.
    """

    def compare(rows: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.Table:
        n, tree, done, root = (rows.column(x).to_numpy() for x in ("n", "tree", "done", "root"))
        least = rows.column("minima").chunk(0).flatten().to_numpy().reshape(-1, FUNCTIONS)
        met = (done[:, None] >> np.arange(TREES) & 1).astype(bool) & (np.arange(TREES) < tree[:, None])
        left = np.repeat(starts + sizes, sizes) - np.arange(len(n))
        at, out = np.arange(len(n)), np.zeros(len(n), dtype=bool)
        for d in range(1, int(sizes.max())):
            at = at[left[at] > d]
            for i in np.array_split(at, len(at) // 4096 + 1):
                i = i[(100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])) & (root[i] != root[i + d])]
                same = least[i] == least[i + d]
                i = i[(same.sum(axis=1) >= agree) & ~(same[:, :TREES] & met[i]).any(axis=1)]
                out[i] = out[i + d] = True
        return rows.select(["node", "c"]).filter(pa.array(out))

    return by_node(compare)


def linked(percent: int) -> Callable:
    """Links (a, b) that join the components of each node's members (node, c, tokens), compared on the full sets."""

    def compare(rows: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.Table:
        c, tokens = rows.column("c").to_pylist(), [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        a, b = [], []
        for start, size in zip(starts.tolist(), sizes.tolist()):
            root = components_of(tokens[start : start + size], percent)
            for k, r in enumerate(root.tolist()):
                if k != r:
                    a.append(c[start + k])
                    b.append(c[start + r])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return by_node(compare)


def components_of(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The number of the first set of each set's component, by comparing all with all."""
    m, n = len(sets), np.array([len(s) for s in sets])
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[of]
    ends = np.cumsum(n)
    width = -(-max(1, int(shared.sum())) // 64) * 64
    bits = np.zeros((m, width // 8), np.uint8)
    for k in range(m):
        own = slice(ends[k] - n[k], ends[k])
        row = np.zeros(width, dtype=bool)
        row[column[own][shared[of[own]]]] = True
        bits[k] = np.packbits(row)
    bits, root = bits.view(np.uint64), np.arange(m)
    for k in range(1, m):
        # Sets before it that are not in its component yet.
        other = np.nonzero(100 * np.minimum(n[:k], n[k]) >= percent * np.maximum(n[:k], n[k]))[0]
        for some in np.array_split(other, len(other) * width // (1 << 27) + 1):
            both = np.bitwise_count(bits[some] & bits[k]).sum(axis=1, dtype=np.int64)
            near = np.unique(root[some[100 * both >= percent * (n[some] + n[k] - both)]])
            if len(near):
                near = np.unique(np.append(near, root[k]))
                root[np.isin(root, near)] = near[0]
    return root


def components(links: DataFrame) -> DataFrame:
    """(c, root) for every member of ``links`` (a, b): its component's least member.

    Alternates large and small stars until nothing changes: each member is linked to the least of its
    neighbours, and the others to that one. Rounds grow as the logarithm of the number of members.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        # Done when each member points to one other and none of those points further.
        ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out + into > 1").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        next_ = large.join(down, F.col("u") == F.col("x"))
        next_ = next_.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(next_.select("e.u", "e.v").filter("u <> v").distinct())
    return edges.select(F.col("u").alias("c"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("root")).distinct())


MEMBER = ["node", "c", "n", "tree", "done", "root", "minima"]


def meet(members: DataFrame, percent: int) -> DataFrame:
    """(node, c) of those members of small nodes that are still to be compared on their full sets."""
    rows = members.select(MEMBER).repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(opened(percent, agreeing(percent)), "node long, c binary")


def sized(members: DataFrame) -> DataFrame:
    """The members of nodes of two or more, with the node's ``k`` members and whether it is ``few`` enough to be compared."""
    k, tokens = F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens")
    nodes = members.groupBy("node").agg(k, tokens).filter("k > 1").withColumnRenamed("node", "of")
    few = ((F.col("k") <= NODE) & (F.col("tokens") <= TOKENS)) | (F.col("k") == 2)
    return members.join(nodes, F.col("node") == F.col("of")).drop("of").withColumn("few", few)


def still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of nodes that links don't join as a whole, with their present ``root``."""
    rows = members.drop("root").join(roots.select(F.col("c").alias("of"), "root"), F.col("c") == F.col("of"), "left").drop("of")
    rows = rows.withColumn("root", F.xxhash64(F.coalesce("root", "c")))
    nodes = rows.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select(F.col("node").alias("of"))
    return rows.join(nodes, F.col("node") == F.col("of"), "left_semi")


def branched(members: DataFrame, level: int, percent: int) -> DataFrame:
    """The members in the children of their nodes: those of one function of the level's pool, and by chance of a second one."""
    first = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(POOL))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(-level)), F.lit(POOL - 1)), F.lit(POOL))
    twice = F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(percent)) < 100 - percent
    rows = members.withColumn("f", F.explode(F.when(twice, F.array(first, second)).otherwise(F.array(first))))
    f = (F.col("f") + TREES + POOL * (level - 1)).cast("int")
    return rows.withColumn("node", F.xxhash64("node", f, F.get("minima", f))).select(MEMBER)


def in_blocks(members: DataFrame) -> DataFrame:
    """Members of large nodes dealt out for comparing all with all, but for the pairs within a node's largest component."""
    roots = members.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n_root"), F.sum("n").alias("tokens"))
    nodes = roots.groupBy(F.col("node").alias("of")).agg(F.max(F.struct("n_root", "tokens", "root")).alias("most"), F.sum("n_root").alias("k"), F.sum("tokens").alias("tokens"))
    blocks = lambda k, tokens: F.ceil(F.greatest(2 * k / NODE, 2 * tokens / TOKENS)).cast("int")
    rest = blocks(F.col("k") - F.col("most.n_root"), F.col("tokens") - F.col("most.tokens")).alias("rest")
    nodes = nodes.select("of", F.col("most.root").alias("major"), rest, blocks(F.col("most.n_root"), F.col("most.tokens")).alias("most"))
    rows, h = members.join(nodes.filter("rest > 0"), F.col("node") == F.col("of")), F.xxhash64("c")
    is_major = F.col("root") == F.col("major")
    own = F.when(is_major, F.col("rest") + F.pmod(h, F.col("most"))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    others = F.sequence(F.lit(0), F.when(is_major, F.col("rest")).otherwise(F.col("rest") + F.col("most")) - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    return rows.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).select(MEMBER)


def confirm(met: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) on the full sets of the members (node, c) of each node."""
    wanted = cut(met.select("c").distinct().join(classes.select("c", "k1", "k2"), "c").select(F.col("k1").alias("w1"), F.col("k2").alias("w2")))
    texts = rows.join(small(wanted), (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")), "left_semi").select("text")
    sets = texts.mapInArrow(as_sets, "c binary, tokens binary").dropDuplicates(["c"]).withColumnRenamed("c", "of")
    full = met.join(sets, F.col("c") == F.col("of")).select("node", "c", "tokens").repartition("node").sortWithinPartitions("node")
    return cut(full.mapInArrow(linked(percent), "a binary, b binary"))


def link_near_copies(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; and k1, k2 (row_keys of id and text) and c and root, the classes of its set and of its component.

    Two rows are linked if their sets' intersection is at least ``percent`` (80 or more) hundredths of their
    union. A component's id is its least doc_id, and the rows with that id are kept.

    Words are runs of anything but ASCII white space, A to Z in lower case. A text of one to four words is one
    shingle; a null or empty one has no set and is linked with nothing. A null id counts as greater than all
    others and stays null. Rows with equal ids are rows of their own, linked by their texts. No rows, no result
    rows. Other columns are not read, whatever their names.

    Very long texts are read whole; their sets are as large. Ties: of equal ids each row is kept or not by the same rule.

    Two sets are one class, without a further look, if their digests of 128 bits agree. Words of under eight bytes have numbers of their
    own, longer ones 64 bits of a BLAKE2 digest, and shingles chain five of these in 64 bits.
    """
    text = F.coalesce(F.encode(F.col(text_col), "utf-8"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_keys(F.col(id_col), F.col(text_col)), text.alias("text"))
    signs = cut(rows.mapInArrow(signed, "doc_id long, k1 long, k2 long, c binary, n_shingles long, minima array<int>"))
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "k1", "k2", F.col("n_shingles").alias("n"), "minima")).alias("least")
    classes = cut(signs.filter(F.col("c").isNotNull()).groupBy("c").agg(least).select("c", "least.*"))
    paths = F.posexplode(F.slice("minima", 1, TREES)).alias("tree", "m")
    nodes = sized(classes.select("c", "n", paths).select("c", "n", "tree", F.xxhash64("tree", "m").alias("node")))
    bit = F.when(F.col("few"), F.expr("shiftleft(1, tree)")).otherwise(0)
    nodes = nodes.groupBy(F.col("c").alias("of")).agg(F.bit_or(bit).alias("done"), F.collect_list(F.struct("node", "tree", "few", "k", "tokens")).alias("nodes"))
    members = classes.join(nodes, F.col("c") == F.col("of")).select("c", "n", "done", "minima", F.xxhash64("c").alias("root"), F.explode("nodes").alias("x"))
    members = cut(members.select("c", "n", "done", "root", "minima", "x.*"))
    blocks = F.ceil(F.greatest(2 * F.col("k") / NODE, 2 * F.col("tokens") / TOKENS)).cast("int")
    block = F.when(F.col("few"), F.col("node")).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("c", "tree"), blocks)))
    met = cut(meet(members.withColumn("node", block), percent))
    links = confirm(met, classes, rows, percent)
    roots = components(links)
    large, open_ = cut(still_open(members.filter("not few"), roots).withColumn("tree", F.lit(TREES))), None
    for level in range(1, LEVELS + 1):
        if large.isEmpty():
            break
        members = cut(sized(branched(large, level, percent)))
        found = meet(members.filter("few"), percent)
        open_ = found if open_ is None else open_.unionByName(found)
        large = members.filter("not few")
    else:
        open_ = open_.unionByName(meet(in_blocks(large), percent))
    if open_ is not None:
        links = links.unionByName(confirm(cut(open_), classes, rows, percent))
        roots = components(links)
    named = classes.select("c", "id").join(roots.withColumnRenamed("c", "of"), F.col("c") == F.col("of"), "left").select("c", "id", F.coalesce("root", "c").alias("root"))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("id").alias("least"))
    named = named.join(least, F.col("root") == F.col("r")).select(F.col("c").alias("of"), "root", F.nullif("least", F.lit(LAST)).alias("least"))
    out = signs.select("doc_id", "k1", "k2", "c", "n_shingles").join(named, F.col("c") == F.col("of"), "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "k1", "k2", "c", "root")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component of linked rows: that with the least id, of equal ones the least keys.

    Rows without words are linked with nothing and stay, but of rows equal in id and text one stays. Null ids come last.
    """
    keys = F.struct(F.coalesce("doc_id", F.lit(LAST)), "k1", "k2")
    linked_ = cut(link_near_copies(docs, percent, id_col, text_col).select("root", "k1", "k2", keys.alias("keys")))
    first = linked_.filter(F.col("root").isNotNull()).groupBy(F.col("root").alias("of")).agg(F.min("keys").alias("first"))
    each = linked_.groupBy("root", "k1", "k2", "keys").agg(F.count(F.lit(1)).alias("copies"))
    each = each.join(first, F.col("root") == F.col("of"), "left").select("k1", "k2", "copies", (F.col("first").isNull() | (F.col("first") == F.col("keys"))).alias("stays"))
    each = cut(each.filter("copies > 1 or not stays").select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "stays"))
    rows = docs.select(F.struct("*").alias("row"), *row_keys(F.col(id_col), F.col(text_col)))
    same = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))
    once = rows.join(small(each.filter("stays").drop("stays")), same, "left_semi").dropDuplicates(["k1", "k2"])
    return rows.join(small(each.drop("stays")), same, "left_anti").unionByName(once).select("row.*")


def op3_near_copies(spark, sf_dir: str) -> DataFrame:
    return link_near_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
