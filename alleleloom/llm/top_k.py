"""Exact top-k search by inner product: ball-tree branch and bound in each shard.

Space is split by the top levels of one ball tree, grown on a bounded sample; its leaves are cells, and a cell's rows are dealt into
shards of bounded size. A task reads a shard's rows, builds a ball tree over them once, and walks it for each query
that follows, the node with the greatest upper bound first, until no bound reaches the k-th score so far. A query goes to one shard of
the likeliest cell, then, in rounds of ever more shards, to those whose cell's bound reaches its k-th score, which each round raises.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, table

#: Rows of a shard, at most or nearly so, and rows of a leaf.
SHARD, LEAF = 8192, 48
#: Cells of the rows of one length, at most; sampled rows for each; and bytes that all centres, or the sample of one length, may take.
CELLS, SAMPLE, BYTES = 4096, 32, 1 << 25
#: A split leaves no fewer sampled rows on a side, if it can be helped.
FEW = 4
#: Greater components than this could overflow a bound: such rows are a cell that every query visits.
WILD = 2.0**400
#: So many queries follow one copy of a shard's rows; where more do, the rows are copied to as many tasks as that takes.
ASKED = 1 << 16
#: Below this magnitude sums of products of whole numbers are exact in doubles.
EXACT = float(1 << 53)
#: Scores are 64 bits: greater ones are given as the greatest, lesser ones as the least.
MOST = (1 << 63) - 1
#: Relative error of a bound or of a product of many doubles, more than there is.
ERROR = 1e-9


class BallTree:
    """Nodes as (centre, radius, first row, last row, left child); a node's rows lie together in ``order``."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[np.ndarray, float, int, int, int]] = []
        todo = [(0, len(points), None)]
        children: dict[int, int] = {}
        while todo:
            lo, hi, parent = todo.pop(0)
            own = points[self.order[lo:hi]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            k = len(self.nodes)
            if parent is not None:
                children.setdefault(parent, k)
            self.nodes.append((centre, float(away.max()), lo, hi, -1))
            if hi - lo > LEAF and away.max() > 0:
                # Halves along the line between two rows far from each other.
                a = own[away.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                halves = np.argsort(own @ (b - a), kind="stable")
                self.order[lo:hi] = self.order[lo:hi][halves]
                todo += [(lo, (lo + hi) // 2, k), ((lo + hi) // 2, hi, k)]
        self.nodes = [(*n[:4], children.get(k, -1)) for k, n in enumerate(self.nodes)]
        self.centres = np.array([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])


class Cells:
    """The top levels of a ball tree over sampled rows: every split's direction and threshold, every cell's centre."""

    def __init__(self, points: np.ndarray, cells: int):
        self.splits: list[tuple[np.ndarray, float, int, int]] = []  # a negative child is cell -1 - child
        self.centres: list[np.ndarray] = []
        self.root, todo = -1, []

        def offer(cell: int, own: np.ndarray) -> None:
            # What is wide and full is split first.
            heapq.heappush(todo, (-float(((own - self.centres[cell]) ** 2).sum()), cell, own))

        def leaf(own: np.ndarray) -> int:
            self.centres.append(own.mean(axis=0))
            offer(len(self.centres) - 1, own)
            return -len(self.centres)

        leaf(points)
        at: dict[int, tuple[int, int]] = {}  # the split, and its side, that leads to a cell
        while todo and len(self.centres) < cells:
            _, cell, own = heapq.heappop(todo)
            a = own[((own - self.centres[cell]) ** 2).sum(axis=1).argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            along = own @ (b - a)
            # Between two rows far from each other, or, if one of them is all but alone, at the median.
            half = float((a + b) @ (b - a)) / 2
            right = along > half
            if not FEW <= right.sum() <= len(own) - FEW:
                half = float(np.median(along))
                right = along > half
            if not right.any():
                right = along >= half
            if right.all() or not right.any():
                continue  # all but equal
            # The left half keeps the cell's number.
            self.centres[cell] = own[~right].mean(axis=0)
            offer(cell, own[~right])
            new = leaf(own[right])
            self.splits.append((b - a, half if (along[right] > half).all() else np.nextafter(half, -np.inf), -1 - cell, new))
            k = len(self.splits) - 1
            if cell in at:
                up, side = at[cell]
                entry = list(self.splits[up])
                entry[2 + side] = k
                self.splits[up] = tuple(entry)
            else:
                self.root = k
            at[cell], at[-1 - new] = (k, 0), (k, 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                along, half, left, right = self.splits[node]
                far = x[rows] @ along > half
                todo += [(left, rows[~far]), (right, rows[far])]
        return out


class Space:
    """What a query's route is found by, for rows of one length: each cell's centre, radius, first shard and number of shards."""

    def __init__(self, cells: Cells | None, places: list[tuple[int, float, int, int]]):
        self.number = np.array([p[0] for p in places])
        self.radii, self.first, self.shards = (np.array([p[n] for p in places]) for n in (1, 2, 3))
        self.wild = self.number < 0
        self.centres = None if cells is None else np.array(cells.centres)[np.where(self.wild, 0, self.number)]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """More than any inner product with a row of each cell, for each query."""
        wild = np.abs(q).max(axis=1) > WILD
        q = np.where(wild[:, None], 0, q)
        length = np.sqrt((q**2).sum(axis=1))[:, None]
        radii = np.where(self.wild, 0, self.radii)[None, :]
        if self.centres is None:
            out = length * radii * (1 + ERROR)
        else:
            norms = np.sqrt((self.centres**2).sum(axis=1))[None, :]
            out = q @ self.centres.T + length * (radii + ERROR * (radii + norms))
        out[:, self.wild], out[wild] = np.inf, np.inf
        return out

    def likeliest(self, q: np.ndarray) -> np.ndarray:
        """For each query the cell with the greatest inner product at its centre."""
        if self.centres is None:
            return np.zeros(len(q), np.int64)
        fits = np.where(np.abs(q) > WILD, 0, q) @ self.centres.T
        fits[:, self.wild] = -np.inf
        return fits.argmax(axis=1)


def by_length(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their floored vectors) of a batch with columns dim and v."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.nonzero(dims == dim)[0]
        yield dim, at, floored(batch.column("v").take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim), scale)


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) / scale, which doubles hold exactly for a ``scale`` that is a power of two, also where the product has no double."""
    large = np.abs(x) >= EXACT
    return np.where(large, x, np.floor(np.where(large, 0, x) * scale) / scale)


class Shard:
    """Rows with their tree, scaled by a power of two to less than 2."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, scale: int):
        self.scale, self.unit = scale, 2.0 ** (math.frexp(np.abs(points).max(initial=0))[1] - 1) if points.any() else 1.0
        self.tree = BallTree(points / self.unit)
        self.ids, self.points = ids[self.tree.order], (points / self.unit)[self.tree.order]
        self.longest = float(np.sqrt((self.points**2).sum(axis=1)).max())

    def score(self, row: int, query: np.ndarray) -> int:
        """The exact score of a row, within 64 bits."""
        total = sum(Fraction(a) * Fraction(b) for a, b in zip(self.points[row].tolist(), query.tolist()))
        return max(-MOST - 1, min(MOST, int(total * Fraction(self.unit) * self.scale**2)))

    def search(self, own: int, query: np.ndarray, least: int | None, k: int) -> list[tuple[int, int]]:
        """(score, id) of the ``k`` best rows, ties to smaller ids, of those that reach ``least``; ``own`` is left out."""
        largest, nodes = float(np.abs(query).max(initial=0)), self.tree.nodes
        exact = self.unit * self.scale * (largest * self.scale) * len(query) < EXACT
        unit = 2.0 ** (math.frexp(largest)[1] - 1) if largest else 1.0
        q = query / unit
        length = float(np.sqrt((q**2).sum()))
        slack = ERROR * (1 + length) * (1 + self.longest)
        # A score is at least kth where this share of it is, but for the slack.
        share = lambda kth: -math.inf if kth is None or kth <= -MOST - 1 else float(kth) / self.scale / self.scale / self.unit / unit - slack - ERROR * abs(float(kth) / self.scale / self.scale / self.unit / unit)
        bounds = self.tree.centres @ q + self.tree.radii * length
        best: list[tuple[int, int]] = []
        kth, floor = least, share(least)
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= floor:
            _, at = heapq.heappop(heap)
            _, _, lo, hi, left = nodes[at]
            if left >= 0:
                for child in (left, left + 1):
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            scores = self.points[lo:hi] @ q
            hits = np.nonzero(scores >= floor)[0]
            if len(hits):
                hits = hits[self.ids[lo:hi][hits] != own]
            if not len(hits):
                continue
            if exact:
                found = zip((scores[hits] * (self.unit * unit * self.scale**2)).astype(np.int64).tolist(), self.ids[lo:hi][hits].tolist())
            else:
                found = ((self.score(lo + int(n), query), int(self.ids[lo + int(n)])) for n in hits)
            best = heapq.nsmallest(k, [*best, *(f for f in found if kth is None or f[0] >= kth)], key=lambda f: (-f[0], f[1]))
            if len(best) == k and (kth is None or best[-1][0] > kth):
                kth, floor = best[-1][0], share(best[-1][0])
        return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, the row's id (``vec_id``) and score: each query's ``k`` rows with the greatest inner product.

    Components become floor(scale * x), with a power of two as ``scale``, so scores are whole numbers; they are exact whatever their
    size, and one beyond 64 bits is given, and ranked, as the nearest number of 64 bits. Ties go to the smaller id. A query's own
    row, which is each row with its id, is left out. Rows and queries with a null id, or whose vector is null,
    empty or holds a null or non-finite component, take no part; rows of other lengths than the query's don't
    match it. Equal rows are rows of their own; equal queries (id and vector) are answered once. No rows or no
    queries, no result rows. Other columns are not read, whatever their names. No texts are read, so there are no very long ones.
    ``shard_rows`` (SHARD, if not given) bounds a shard; cells come from a sample, but every row is in one and no row is passed by unless its bound is too low.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")

    def usable(df: DataFrame) -> DataFrame:
        x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        fine = F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False)))
        return x.filter(F.col("id").isNotNull() & (F.size("v") > 0) & fine).withColumn("dim", F.size("v"))

    def searched(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come shard by shard, the shard's own rows before the queries.
        place, held, shard = None, [], None
        for batch in stream:
            at, kind, copy, found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(6).to_numpy(), []
            cuts = [0, *(np.nonzero((at[1:] != at[:-1]) | (copy[1:] != copy[:-1]) | (kind[1:] != kind[:-1]))[0] + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if (at[lo], copy[lo]) != place:
                    place, held, shard = (at[lo], copy[lo]), [], None
                part = batch.slice(lo, hi - lo)
                ids, x = part.column(3).to_numpy(), floored(part.column(5).flatten().to_numpy().reshape(hi - lo, -1), scale)
                if not kind[lo]:
                    held.append((ids, x))
                elif held:
                    shard = shard or Shard(*(np.concatenate([h[n] for h in held]) for n in (0, 1)), scale)
                    for q, own, least, vector in zip(part.column(2).to_pylist(), ids.tolist(), part.column(4).to_pylist(), x):
                        found += [(q, own, i, s) for s, i in shard.search(own, vector, least, k)]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in range(4)], ["q", "query_id", "vec_id", "score"])

    rows, asked = usable(vectors), usable(queries).dropDuplicates(["id", "v"])
    spaces, rows = _placed(rows, scale, shard_rows or SHARD)
    hidden = F.lit(None).cast("long")
    points = rows.select("place", F.lit(0).alias("kind"), hidden.alias("q"), "id", hidden.alias("least"), "v")

    def started(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            home = np.full(len(batch), -1)
            for dim, at, x in by_length(batch, scale):
                if space := spaces.get(dim):
                    cell, by = space.likeliest(x), np.abs(batch.column("q").to_numpy()[at])
                    home[at] = dim * LENGTH + space.first[cell] + by % space.shards[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], [*batch.schema.names, "home"])

    def routed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            routes: list[list[dict]] = [[] for _ in range(len(batch))]
            least = np.array([-math.inf if n is None or n <= -MOST - 1 else n - ERROR * abs(n) for n in batch.column("least").to_pylist()])
            for dim, at, x in by_length(batch, scale):
                if space := spaces.get(dim):
                    bounds = space.bounds(x) * scale * scale
                    for n, row in enumerate(at.tolist()):
                        cells = np.nonzero(bounds[n] >= least[row])[0]
                        cells = cells[np.argsort(-bounds[n][cells], kind="stable")]
                        start = np.cumsum(space.shards[cells]) - space.shards[cells]
                        routes[row] = [dict(zip(("start", "first", "shards", "bound"), r)) for r in zip(start.tolist(), (dim * LENGTH + space.first[cells]).tolist(), space.shards[cells].tolist(), bounds[n][cells].tolist())]
            kept = [n for n in batch.schema.names if n != "least"]
            route = pa.array(routes, pa.list_(pa.struct([("start", pa.int64()), ("first", pa.int64()), ("shards", pa.int64()), ("bound", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), route], [*kept, "route"])

    asked = asked.withColumn("q", F.xxhash64("id", "v")).select("dim", "q", "id", "v")
    asked = cut(asked.mapInArrow(started, "dim int, q long, id long, v array<double>, home long").filter(F.col("home") >= 0))
    best = F.row_number().over(Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")

    def visited(sought: DataFrame, found: DataFrame | None) -> DataFrame:
        """The best rows so far and those of the shards that the queries ``sought`` go to."""
        popular = sought.groupBy("place").agg(F.count(F.lit(1)).alias("asked"))
        popular = small(cut(popular.select(F.col("place").alias("p"), "asked", F.ceil(F.col("asked") / ASKED).alias("copies"))))
        held = points.join(popular, F.col("place") == F.col("p")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        sent = sought.join(popular, F.col("place") == F.col("p")).withColumn("copy", F.pmod(F.xxhash64("q", "place"), F.col("copies"))).withColumn("kind", F.lit(1))
        columns = ["place", "kind", "q", "id", "least", "v", "copy"]
        both = held.select(columns).unionByName(sent.select(columns)).repartition("place", "copy").sortWithinPartitions("place", "copy", "kind")
        new = both.mapInArrow(searched, "q long, query_id long, vec_id long, score long")
        new = new if found is None else new.unionByName(found.drop("rank"))
        return cut(new.select("*", best).filter(F.col("rank") <= k))

    def with_least(asked: DataFrame, found: DataFrame) -> DataFrame:
        kth = found.filter(F.col("rank") == k).select(F.col("q").alias("kq"), F.col("query_id").alias("kid"), F.col("score").alias("least"))
        return asked.join(kth, (F.col("q") == F.col("kq")) & (F.col("id") == F.col("kid")), "left").drop("kq", "kid")

    found = visited(asked.select(F.col("home").alias("place"), "q", "id", hidden.alias("least"), "v"), None)
    if all(space.shards.sum() == 1 for space in spaces.values()):
        return found.select("query_id", "rank", "vec_id", "score")  # each query has been where there are rows
    ahead = with_least(asked, found).select("dim", "q", "id", "v", "home", "least")
    entry = "array<struct<start:bigint,first:bigint,shards:bigint,bound:double>>"
    asked = cut(ahead.mapInArrow(routed, f"dim int, q long, id long, v array<double>, home long, route {entry}"))
    done, more = 0, 4
    while True:
        # Of a route, whose bounds fall, what is ahead and still reaches the k-th score.
        reach = F.when(F.col("least").isNull() | (F.col("least") <= -MOST - 1), -math.inf).otherwise(F.col("least") - ERROR * F.abs(F.col("least").cast("double")))
        ahead = with_least(asked, found).withColumn("reach", reach)
        ahead = ahead.withColumn("route", F.filter("route", lambda r: (r["bound"] >= F.col("reach")) & (r["start"] + r["shards"] > done)))
        most = ahead.agg(F.max(F.try_element_at("route", F.lit(-1))["start"] + F.try_element_at("route", F.lit(-1))["shards"])).first()[0]
        if most is None or most <= done:
            return found.select("query_id", "rank", "vec_id", "score")
        sought = ahead.withColumn("r", F.explode(F.filter("route", lambda r: r["start"] < done + more)))
        steps = F.sequence(F.greatest(F.col("r.start"), F.lit(done)), F.least(F.col("r.start") + F.col("r.shards"), F.lit(done + more)) - 1)
        sought = sought.withColumn("step", F.explode(steps)).withColumn("place", F.col("r.first") + F.col("step") - F.col("r.start"))
        found = visited(sought.filter(F.col("place") != F.col("home")).select("place", "q", "id", "least", "v"), found)
        done, more = done + more, 4 * more


#: The shards of rows of length d have the numbers from d times this.
LENGTH = 1 << 40


def _placed(rows: DataFrame, scale: int, shard_rows: int) -> tuple[dict[int, Space], DataFrame]:
    """The cells of the rows of each length, and the rows with the number of their shard (``place``).

    Cells are as many as shards would be, and up to ``CELLS``, as long as their centres take ``BYTES``; they come from some ``SAMPLE``
    rows for each. All rows are put into cells and a cell's radius is that of all its rows. Lengths of few rows are one cell.
    """
    lengths = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, trees = sum(lengths.values()), {}
    for dim, n in lengths.items():
        cells = min(math.ceil(n / shard_rows), CELLS, int(BYTES * n / total) // (16 * dim))
        if cells > 1:
            wanted = min(SAMPLE * cells, max(cells, BYTES // (8 * dim)))
            sample = rows.filter((F.col("dim") == dim) & (F.array_max(F.transform("v", F.abs)) <= WILD) & (F.rand(7) < wanted / n)).select("v").limit(2 * wanted).toArrow()
            if len(sample) > 1:
                x = np.concatenate([c.flatten().to_numpy() for c in sample.column(0).chunks if len(c)]).reshape(len(sample), dim)
                trees[dim] = Cells(floored(x, scale), cells)

    def celled(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            cell, away = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for dim, at, x in by_length(batch, scale):
                wild = np.abs(x).max(axis=1) > WILD
                x = np.where(wild[:, None], 0, x)
                if tree := trees.get(dim):
                    cell[at] = tree.of(x)
                    x = x - np.array(tree.centres)[cell[at]]
                away[at] = np.sqrt((x**2).sum(axis=1)) * (1 + ERROR)
                cell[at[wild]] = -1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    # Within a cell rows are dealt by chance, not by a key, so that no key can fill a shard.
    rows = rows.select("id", "v", "dim").mapInArrow(celled, "id long, v array<double>, dim int, cell long, away double").withColumn("deal", F.rand(9))
    rows = cut(rows)
    stats = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    places: dict[int, list] = {}
    first: dict[int, int] = {}
    for r in sorted(stats.collect()):
        m, at = math.ceil(r["n"] / shard_rows), first.get(r["dim"], 0)
        places.setdefault(r["dim"], []).append((r["cell"], r["radius"], at, m))
        first[r["dim"]] = at + m
    spaces = {dim: Space(trees.get(dim), p) for dim, p in places.items()}
    known = [(dim, cell, dim * LENGTH + at, m) for dim, p in places.items() for cell, _, at, m in p]
    known = rows.sparkSession.createDataFrame(known, "d int, c long, first long, shards long")
    # At most CELLS and one more for each length.
    rows = rows.join(F.broadcast(known) if len(places) <= CELLS else known, (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")))
    return spaces, rows.select("dim", "id", "v", (F.col("first") + F.floor(F.col("deal") * F.col("shards"))).alias("place"))


def op7_search(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0))


OP7_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored) where rank <= 5
"""
