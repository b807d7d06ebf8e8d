"""Packing documents into sequences of fixed capacity, by linear grouping.

Everything that is decided depends on how many pieces there are of each
length, which is a small table whatever the corpus.  The plan made from it maps
the place of a piece in the descending order of lengths to its bin, so the
documents themselves are only counted, ranked and looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, word_count

CAPACITY = 2048
#: Pieces longer than this share of the capacity are large.
LARGE = 1 / 8
GROUPS = 32
#: Pieces of one length that one task ranks.
BUCKET = 100_000


def _price(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes that fits the capacity."""
    deep = capacity // int(sizes.min())
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(deep):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for g, w in enumerate(sizes):
            v = best[: capacity + 1 - w] + value[g]
            better = v > new[w:] + 1e-12
            new[w:][better] = v[better]
            pick[w:][better] = g
        picks.append(pick)
        best = new
    count = np.zeros(len(sizes))
    left = capacity
    for pick in reversed(picks):
        g = pick[left]
        if g >= 0:
            count[g] += 1
            left -= sizes[g]
    return float(count @ value), count


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each size) and how often each is used, covering need.

    The linear programme over all patterns is solved by column generation; what
    rounding down leaves is packed best fit, largest first.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    used = need / np.diag(basis)
    for _ in range(50 * k):
        value, column = _price(sizes, np.linalg.solve(basis.T, np.ones(k)), capacity)
        if value <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, column)
        ratio = np.where(move > 1e-9, used / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        used = np.maximum(np.linalg.solve(basis, need.astype(float)), 0)
    plan = []
    left = need.astype(np.int64).copy()
    for p in range(k):
        pattern = np.rint(basis[:, p]).astype(np.int64)
        times = int(used[p] + 1e-6)
        if pattern.any():
            over = pattern > 0
            times = min(times, int((left[over] // pattern[over]).min()))
        if times and pattern.any():
            plan.append((pattern, times))
            left -= pattern * times
    rest: list[tuple[int, np.ndarray]] = []
    for g in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[g])):
            fits = [(room, i) for i, (room, _) in enumerate(rest) if room >= sizes[g]]
            if fits:
                room, i = min(fits)
            else:
                i = len(rest)
                rest.append((capacity, np.zeros(k, np.int64)))
            rest[i][1][g] += 1
            rest[i] = (rest[i][0] - int(sizes[g]), rest[i][1])
    return plan + [(p, 1) for _, p in rest]


def plan(counts: np.ndarray, capacity: int, large: float = LARGE, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces go; counts[s] is the number of pieces of length s.

    Returns sorted first places, pieces per bin and first bins: the piece at
    place t of the descending order of lengths goes to bin
    first_bin + (t - first_place) // per_bin of the last interval that begins
    at or before t.
    """
    by_size = np.arange(capacity, 0, -1)
    upto = np.concatenate(([0], np.cumsum(counts[by_size])))
    small = int(capacity * large)
    n_large = int(counts[small + 1 :].sum())
    first: list[int] = []
    per: list[int] = []
    to: list[int] = []
    rooms: dict[int, list[tuple[int, int]]] = {}
    bins = 0
    size_at = lambda t: capacity - (np.searchsorted(upto, t, side="right") - 1)
    if n_large:
        edges = np.unique(np.linspace(0, n_large, min(groups, n_large) + 1).astype(np.int64))
        sizes = size_at(edges[:-1])
        # groups whose largest pieces are equal are one
        start = np.concatenate(([True], sizes[1:] != sizes[:-1]))
        edges, sizes = np.append(edges[:-1][start], n_large), sizes[start]
        done = edges[:-1].copy()
        for pattern, times in configurations(sizes, np.diff(edges), capacity):
            slots = [(g, int(a)) for g, a in enumerate(pattern) if a]
            breaks = {0}
            for g, a in slots:
                lo, hi = int(done[g]), int(done[g]) + times * a
                first.append(lo)
                per.append(a)
                to.append(bins)
                for t in upto[np.searchsorted(upto, lo, side="right") : np.searchsorted(upto, hi, side="left")].tolist():
                    breaks.update(i for i in range((t - lo) // a, (t - lo + a - 1) // a + 1) if i < times)
            at = np.array(sorted(breaks))
            room = np.full(len(at), capacity)
            for g, a in slots:
                for j in range(a):
                    room -= size_at(int(done[g]) + at * a + j)
                done[g] += times * a
            for i, r, n in zip(at.tolist(), room.tolist(), np.diff(np.append(at, times)).tolist()):
                rooms.setdefault(r, []).append((bins + i, n))
            bins += times
    for s in range(small, 0, -1):
        t, left = int(upto[capacity - s]), int(counts[s])
        while left:
            r = min((x for x in rooms if x >= s), default=None)
            if r is None:
                n = -(-left // (capacity // s))
                rooms[capacity] = [(bins, n)]
                bins += n
                continue
            at, n = rooms[r].pop()
            each = r // s
            m = min(n, left // each)
            if m == 0:
                each, m = left, 1
            if m < n:
                rooms[r].append((at + m, n - m))
            if not rooms[r]:
                del rooms[r]
            if r - each * s:
                rooms.setdefault(r - each * s, []).append((at, m))
            first.append(t)
            per.append(each)
            to.append(at)
            t += m * each
            left -= m * each
    order = np.argsort(np.array(first, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (first, per, to))


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", large: float = LARGE, groups: int = GROUPS) -> DataFrame:
    """Returns bin, start, doc_id, piece and tokens, a row for each piece.

    A document longer than the capacity is cut into pieces of the capacity and
    a rest; other documents are one piece, numbered 0.  Pieces longer than an
    eighth of the capacity are large: in descending order of length they fall
    into groups of equal cardinality, lengths are rounded up to the largest of
    the group, patterns of the few rounded lengths are optimised, and the
    actual pieces take the places of their group.  The small ones follow,
    longest first, each into the fullest bin with room for it.

    Null and empty texts have no tokens: one row each, with bin, start and
    piece null.  Null and repeated doc_ids are packed row by row.  Pieces of
    equal length are ranked by a hash and then the value of doc_id; rows that
    don't differ are interchangeable.  An empty table gives no rows.  Columns
    besides id and text are never read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("n"))
    whole = F.floor((F.col("n") + capacity - 1) / capacity)
    pieces = d.select("doc_id", "n", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), whole - 1))).alias("piece"))
    size = F.when(F.col("piece").isNull(), 0).otherwise(F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity)).cast("int")
    pieces = cut(pieces.select("doc_id", "piece", size.alias("tokens")), "pack-sizes")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("tokens").count().collect():
        counts[row["tokens"]] = row["count"]
    # a length that is frequent gets more buckets, so that none is ranked in one task
    many = F.create_map(*[F.lit(int(x)) for s in np.flatnonzero(counts > BUCKET) for x in (s, -(-counts[s] // BUCKET))]) if (counts > BUCKET).any() else None
    buckets = F.lit(1) if many is None else F.coalesce(many[F.col("tokens")], F.lit(1))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), buckets).cast("int"))
    nth = F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("doc_id", "piece"))

    held = pieces.groupBy("tokens", "bucket").count()
    # a row for each length, and one more for each BUCKET pieces
    before = Window.orderBy(F.desc("tokens"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = held.where("tokens > 0").select(F.col("tokens").alias("b_tokens"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    none = pieces.where("tokens = 0").select(F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("start"), "doc_id", "piece", "tokens")
    pieces = pieces.where("tokens > 0").withColumn("nth", nth)
    counts[0] = 0
    first, per, to = plan(counts, capacity, large, groups)

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        t = b.column("t").to_numpy()
        at = np.searchsorted(first, t, side="right") - 1
        return b.set_column(b.schema.get_field_index("t"), "bin", pa.array(to[at] + (t - first[at]) // per[at]))

    ranked = pieces.join(base, (F.col("tokens") == F.col("b_tokens")) & (F.col("bucket") == F.col("b_bucket")))
    ranked = ranked.select((F.col("base") + F.col("nth") - 1).cast("long").alias("t"), F.col("doc_id").alias("doc_id"), "piece", "tokens")
    kind = docs.schema[id_col].dataType.simpleString()
    placed = map_arrow(ranked, place, f"bin long, doc_id {kind}, piece long, tokens int")
    start = F.sum("tokens").over(Window.partitionBy("bin").orderBy(F.desc("tokens"), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = placed.select("bin", start.cast("long").alias("start"), "doc_id", "piece", "tokens")
    return placed.unionByName(none)
