"""Nearest neighbours by vantage-point trees, one for each part of a ball of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lumps, map_arrow

NEIGHBOURS = 10
#: Pruning is this much bolder than the triangle inequality allows; 1 is exact.
FACTOR = 1.3
#: Most vectors of a tree.
SHARD = 16_384
LEAF = 256
#: Vectors that bound each search from the start, and how many of them may be pivots; both are broadcast.
SAMPLE, PIVOTS = 4096, 1024
#: The registered query asks for the neighbours of every id divisible by this.
EVERY = 100


class Tree:
    """A vantage-point tree; inner nodes split the rest at the median distance."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors
        self.norm = np.einsum("ij,ij->i", vectors, vectors)
        self.root = self._build(np.arange(len(ids)))

    def _far(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = np.einsum("ij,ij->i", q, q)[:, None] + self.norm[at][None, :] - 2 * (q @ self.x[at].T)
        return np.sqrt(np.maximum(d, 0))

    def _build(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        d = self._far(self.x[at[:1]], at[1:])[0]
        mu = float(np.median(d))
        near = d <= mu
        if near.all():
            return at
        return at[0], mu, self._build(at[1:][near]), self._build(at[1:][~near])

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances (n x k, padded with inf) of the nearest vectors whose id isn't the query's own.

        bound: what the k-th distance of each query can't exceed, from elsewhere.

        A side of a node is left out if factor times the least distance that
        the triangle inequality gives for it exceeds the k-th found so far.
        """
        n = len(q)
        dist, ids = np.full((n, k), np.inf), np.zeros((n, k), np.int64)

        def offer(rows: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
            d = np.where(self.ids[at][None, :] == own[rows][:, None], np.inf, d)
            if d.shape[1] > k:
                part = np.argpartition(d, k - 1, axis=1)
                edge = np.take_along_axis(d, part[:, k - 1 : k], 1)
                # all ties of the k-th stay in the running
                many = int((d <= edge).sum(1).max())
                if many > k:
                    part = np.argpartition(d, min(many, d.shape[1]) - 1, axis=1)
                    pick = part[:, :many]
                else:
                    pick = part[:, :k]
                d, i = np.take_along_axis(d, pick, 1), self.ids[at][pick]
            else:
                i = np.broadcast_to(self.ids[at], d.shape)
            alld, alli = np.concatenate((dist[rows], d), 1), np.concatenate((ids[rows], i), 1)
            order = np.lexsort((alli, alld), axis=1)[:, :k]
            dist[rows], ids[rows] = np.take_along_axis(alld, order, 1), np.take_along_axis(alli, order, 1)

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                if len(node):
                    offer(rows, node, self._far(q[rows], node))
                return
            point, mu, near, far = node
            d = self._far(q[rows], np.array([point]))
            offer(rows, np.array([point]), d)
            d = d[:, 0]
            inside = d <= mu
            visit(near, rows[inside])
            visit(far, rows[~inside])
            tau = np.minimum(dist[rows, k - 1], bound[rows])
            # a hair of slack keeps rounding from pruning an exact tie
            visit(far, rows[inside & (factor * (mu - d) <= tau + 1e-6)])
            visit(near, rows[~inside & (factor * (d - mu) <= tau + 1e-6)])

        visit(self.root, np.arange(n))
        return ids, dist


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and matrix of the vectors of each length."""
    offs, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    first, size = offs[:-1] - offs[0], np.diff(offs)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield int(dim), rows, flat[first[rows][:, None] + np.arange(dim)]


def neighbours(
    vectors: DataFrame,
    k: int = NEIGHBOURS,
    factor: float = FACTOR,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard: int = SHARD,
    every: int = 1,
) -> DataFrame:
    """Returns vec_id, rank, neighbour_id and distance (Euclidean): the k nearest of each query among all vectors.

    Queries are the vectors whose id is divisible by ``every``; all vectors are
    indexed.  SAMPLE vectors with the least hashes of their ids give up to
    PIVOTS pivots; each vector belongs to the nearest one's ball, and a ball
    of more than ``shard`` vectors is split by hash, so that equal vectors
    can't fill one task.  Each part has a vantage-point tree.

    The k-th distance within the sample bounds a query's search from the start:
    a ball whose least possible distance times factor is beyond it isn't
    visited, and within a tree a side is left out by the same rule.  With
    factor 1 the result is exact.

    Ties go to the lesser neighbour_id.  Rows with a null id or a vector that
    is null, empty or has a null or NaN are left out; of rows that repeat an
    id the one with the least vector counts; vectors are only compared with
    those of their own length.  Fewer than k rows come if there are fewer
    other vectors.  Equal vectors of different ids are neighbours at distance
    0.  Vectors of any length are compared in full; an empty table gives no
    rows.  Other columns are never read, whatever their names.
    """
    if factor < 1:
        raise ValueError("factor must be at least 1")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x))").groupBy("id").agg(F.min("v").alias("v"))
    v = cut(v, "vp-vectors")
    total = v.count()
    some = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    most = min(PIVOTS, max(1, -(-total // shard)))
    if some.num_rows:
        ids = some["id"].to_numpy()
        known = {dim: (ids[rows], x) for dim, rows, x in _by_length(some["v"].combine_chunks())}
    sent = vectors.sparkSession.sparkContext.broadcast(known)

    def assign(b: pa.RecordBatch) -> pa.RecordBatch:
        dims, ball, far = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
        for dim, rows, x in _by_length(b.column("v")):
            dims[rows] = dim
            if dim in sent.value:
                d = _distances(x, sent.value[dim][1][:most])
                ball[rows] = d.argmin(1)
                far[rows] = d.min(1)
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(dims), pa.array(ball), pa.array(far)], ["id", "v", "dim", "ball", "far"])

    held = cut(map_arrow(v, assign, "id long, v array<double>, dim int, ball int, far double"), "vp-balls")
    # one row for each ball, and for each length that the sample lacks
    balls = held.groupBy("dim", "ball").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("parts", F.expr(f"cast(ceil(n / {int(shard)}) as int)"))
    size = {(r["dim"], r["ball"]): (r["parts"], r["radius"]) for r in balls.collect()}
    radii = vectors.sparkSession.sparkContext.broadcast(size)

    def ask(b: pa.RecordBatch) -> pa.RecordBatch:
        at, ball, tau = [], [], []
        for dim, rows, x in _by_length(b.column("v")):
            if dim not in sent.value:
                at.append(rows)
                ball.append(np.full(len(rows), -1))
                tau.append(np.full(len(rows), np.inf))
                continue
            own, sample = sent.value[dim]
            d = _distances(x, sample)
            to = d[:, :most].copy()
            d[b.column("id").to_numpy()[rows][:, None] == own[None, :]] = np.inf
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(rows), np.inf)
            radius = np.array([radii.value.get((dim, i), (0, -np.inf))[1] for i in range(to.shape[1])])
            # a hair of slack keeps rounding from pruning an exact tie
            q, i = np.nonzero(factor * (to - radius[None, :]) <= kth[:, None] + 1e-6)
            at.append(rows[q])
            ball.append(i)
            tau.append(kth[q])
        at, ball, tau = (np.concatenate(z) for z in (at, ball, tau))
        parts = np.array([radii.value.get((int(s), int(i)), (0, 0))[0] for s, i in zip(np.diff(b.column("v").offsets.to_numpy())[at], ball)], np.int64)
        n = np.repeat(np.arange(len(at)), parts)
        part = np.arange(len(n)) - np.repeat(np.cumsum(parts) - parts, parts)
        pick = pa.array(at[n])
        dims = np.diff(b.column("v").offsets.to_numpy())[at[n]].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [b.column("id").take(pick), b.column("v").take(pick), pa.array(dims), pa.array(ball[n].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(tau[n])], ["id", "v", "dim", "ball", "part", "tau"]
        )

    shape = "id long, v array<double>, dim int, ball int, part int, tau double"
    asks = map_arrow(v.where(F.col("id") % every == 0), ask, shape)
    known_parts = F.broadcast(balls.select(F.col("dim").alias("d"), F.col("ball").alias("b"), "parts"))
    data = held.join(known_parts, (F.col("dim") == F.col("d")) & (F.col("ball") == F.col("b")))
    data = data.select("id", "v", "dim", "ball", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("double").alias("tau"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in lumps(batches, ["dim", "ball", "part"], shard):
            lists, tau = t["v"].combine_chunks(), t["tau"].to_numpy()
            offs, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            first, ids = offs[:-1] - offs[0], t["id"].to_numpy()
            key = np.stack([t[c].to_numpy() for c in ("dim", "ball", "part")])
            cuts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0), [True])))
            for lo, hi in zip(cuts, cuts[1:]):
                rows = np.arange(lo, hi)
                asked = ~np.isnan(tau[rows])
                if not asked.any() or asked.all():
                    continue
                x = flat[first[rows[~asked]][:, None] + np.arange(key[0, lo])]
                tree = Tree(ids[rows[~asked]], x)
                for a in range(0, int(asked.sum()), 4096):
                    mine = rows[asked][a : a + 4096]
                    got, d = tree.search(flat[first[mine][:, None] + np.arange(key[0, lo])], ids[mine], k, factor, tau[mine])
                    ok = np.isfinite(d.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[mine], k)[ok]), pa.array(got.ravel()[ok]), pa.array(d.ravel()[ok])], ["vec_id", "neighbour_id", "distance"])

    met = data.unionByName(asks).repartition("dim", "ball", "part").sortWithinPartitions("dim", "ball", "part", F.col("tau").isNotNull(), "id")
    met = met.mapInArrow(run, "vec_id long, neighbour_id long, distance double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k)
    top = met.groupBy("vec_id").agg(best.alias("b")).select("vec_id", F.posexplode("b").alias("i", "n"))
    return top.select("vec_id", (F.col("i") + 1).alias("rank"), F.col("n.neighbour_id").alias("neighbour_id"), F.col("n.distance").alias("distance"))
