"""SimHash near-duplicates found with BK-trees over shards of fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import components, cut, gather, map_arrow

#: Bits that one half of two linked fingerprints may differ in, and bits that both halves may.
RADIUS, WIDE = 8, 22
#: Blocks of a half; more of them make smaller shards, and more shards of each fingerprint.
BLOCKS = 10
#: Fingerprints that a shard should have at most on average, and rows of shards that a task takes.
SHARD, TASK_ROWS = 2_000, 700_000
_U = np.uint64
_ROW_BITS = 20
_LANES = _U(0x0101010101010101)
#: A shard's number ends with the number of its mask and half.
_TAIL = 10


def _majorities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each segment of hashes the bits that more than half of them have set."""
    m = np.diff(bounds)
    parts = -(-m // 255)
    acc = np.zeros((len(m), 64), np.int64)
    if len(h):
        # eight counters of eight bits are added up at a time, over 255 hashes at most
        at = np.repeat(bounds[:-1], parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        first = np.flatnonzero(parts)
        seg = (np.cumsum(parts) - parts)[first]
        for j in range(8):
            s = np.add.reduceat((h >> _U(j)) & _LANES, at).view(np.uint8).reshape(-1, 8)
            acc[first[:, None], np.arange(8)[None, :] * 8 + j] = np.add.reduceat(s, seg, axis=0, dtype=np.int64)
    return np.packbits(acc * 2 > m[:, None], axis=1, bitorder="little").view(_U).ravel()


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash, two halves of 64 bits, of the set of folded words of each text, and its number of words.

    A bit is set where more than half of the distinct words have it set.
    """
    buf, offs = K.raw(texts)
    n = len(offs) - 1
    one, two, sizes = np.zeros(n, _U), np.zeros(n, _U), np.zeros(n, np.int64)
    keep = _U(64 - _ROW_BITS)
    for lo, hi in K.slices(offs):
        for a in range(lo, hi, 1 << _ROW_BITS):
            b = min(hi, a + (1 << _ROW_BITS))
            key = np.zeros(0, _U)
            # a text beyond a slice comes in pieces, of which only the different words stay
            for part, o in K.pieces(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], K.WORD):
                part = K.fold(part)
                s, e = K.words(part, o)
                row = np.repeat(np.arange(b - a, dtype=_U), K.counts_per_row(s, o))
                key = np.sort(np.concatenate((key, (row << keep) | (K.span_hashes(part, s, e) >> _U(_ROW_BITS)))))
                if len(key):
                    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            bounds = np.searchsorted(key >> keep, np.arange(b - a + 1, dtype=_U))
            word = key & _U((1 << (64 - _ROW_BITS)) - 1)
            one[a:b] = _majorities(K.mix(word), bounds)
            two[a:b] = _majorities(K.mix(word + K.salt(77)), bounds)
            sizes[a:b] = np.diff(bounds)
    return one, two, sizes


def block_masks(blocks: int) -> list[np.uint64]:
    """Bit masks of so many blocks of the 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [_U(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:])]


def masks_of(radius: int, blocks: int) -> np.ndarray:
    """Bit masks of every choice of blocks - radius among blocks of the 64 bits.

    Hashes within the radius differ in at most radius blocks, so they agree on
    one of these masks at least.
    """
    return np.array([sum(map(int, c)) for c in combinations(block_masks(blocks), blocks - radius)], dtype=_U)


def first_masks(radius: int, blocks: int) -> np.ndarray:
    """For each set of blocks that differ, as a number, the first of masks_of that has none of them; -1 if none."""
    sets = np.arange(1 << blocks)
    out = np.full(len(sets), -1)
    for i, c in reversed(list(enumerate(combinations(range(blocks), blocks - radius)))):
        out[sets & sum(1 << k for k in c) == 0] = i
    return out


def blocks_for(count: int, radius: int) -> int:
    """The least number of blocks, BLOCKS or more, that keeps shards small for so many fingerprints.

    Any number gives the same links; fewer blocks mean larger shards, more of
    them more rows.
    """
    b = max(BLOCKS, radius + 1)
    while count / 2 ** (64 * (b - radius) / b) > SHARD and comb(b + 1, radius) * 2 <= 1 << _TAIL:
        b += 1
    return b


class Forest:
    """BK-trees of many shards, each a root and the leaves under it.

    A leaf holds the hashes that are at one Hamming distance, its edge, from the
    root.  Leaves are scanned flat: with a radius of 8 of 64 bits each further
    level would rule out next to nothing, and following its edges costs a
    hundred times what comparing two hashes does.
    """

    def __init__(self, shard: np.ndarray, hashes: np.ndarray):
        """shard: sorted."""
        n = len(hashes)
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        edge = np.bitwise_count(hashes ^ hashes[np.repeat(first, size)])
        # large trees come first, so that trees that are scanned together are alike in size
        place = np.empty(len(first), np.int64)
        place[np.argsort(-size, kind="stable")] = np.arange(len(first))
        leaf = np.repeat(place, size) * 256 + edge
        self.order = np.argsort(leaf, kind="stable")
        self.leaf, self.h = leaf[self.order], hashes[self.order]

    def pairs(self, radius: int, most: int = 1 << 15, found: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair (position, later position) within the radius in its shard.

        Each hash is compared with those behind it, up to the leaf at its edge +
        radius: with the next one, the second next and so on, for ``most``
        hashes at a time.  About ``found`` pairs are held.
        """
        n = len(self.h)
        reach = np.searchsorted(self.leaf, self.leaf + radius, side="right") - 1 - np.arange(n)
        diff, bits = np.empty(most, _U), np.empty(most, np.uint8)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        weight = 0

        def out() -> tuple[np.ndarray, np.ndarray]:
            a, b = (self.order[np.concatenate(x)] for x in zip(*held))
            return np.minimum(a, b), np.maximum(a, b)

        for lo in range(0, n, most):
            own = reach[lo : lo + most]
            # how many hashes, from lo on, still have something at each step
            far = np.maximum.accumulate(own[::-1])[::-1]
            for step, m in enumerate(np.searchsorted(-far, -np.arange(1, far[0] + 1), side="right").tolist(), 1):
                np.bitwise_xor(self.h[lo : lo + m], self.h[lo + step : lo + step + m], out=diff[:m])
                np.bitwise_count(diff[:m], out=bits[:m])
                hit = np.flatnonzero(bits[:m] <= radius)
                if len(hit):
                    hit = hit[own[hit] >= step] + lo
                    held.append((hit, hit + step))
                    weight += len(hit)
                    if weight >= found:
                        yield out()
                        held, weight = [], 0
        if weight:
            yield out()


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the edges a-b connect."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def node_of(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A number for each fingerprint, by which edges name it."""
    return K.mix(one + K.mix(two + K.salt(3))).view(np.int64)


def _links(radius: int, blocks: int, wide: int):
    """Of a partition of shards: edges (a, b) that connect its groups, and rows (a, null, links) that add up to each fingerprint's links.

    A link belongs to one shard, that of the first half that is near and of the
    first mask that agrees; the others that find it pass it over.
    """
    ones, firsts = block_masks(blocks), first_masks(radius, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        shard, x, y = t["shard"].to_numpy(), t["x"].to_numpy().view(_U), t["y"].to_numpy().view(_U)
        order = np.argsort(shard)
        shard, x, y = shard[order], x[order], y[order]
        mask = (shard & ((1 << _TAIL) - 1)) >> 1
        second = (shard & 1).astype(bool)
        name = node_of(np.where(second, y, x), np.where(second, x, y))
        counts = np.zeros(len(x), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        weight = 0
        for i, j in Forest(shard, x).pairs(radius):
            near, other = x[i] ^ x[j], np.bitwise_count(y[i] ^ y[j])
            ok = (np.bitwise_count(near) + other <= wide) & ~(second[i] & (other <= radius))
            i, j, near = i[ok], j[ok], near[ok]
            differ = np.zeros(len(i), np.int64)
            for k, one in enumerate(ones):
                differ |= ((near & one) != 0).astype(np.int64) << k
            ok = firsts[differ] == mask[i]
            i, j = i[ok], j[ok]
            counts += np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x))
            held.append((name[i], name[j]))
            weight += len(i)
            if weight > 1 << 20:
                a, b = spanning(np.concatenate([a, *(u for u, _ in held)]), np.concatenate([b, *(v for _, v in held)]))
                held, weight = [], 0
        a, b = spanning(np.concatenate([a, *(u for u, _ in held)]), np.concatenate([b, *(v for _, v in held)]))
        some = np.flatnonzero(counts)
        if len(a) or len(some):
            k = len(a)
            left = pa.array(np.concatenate((a, name[some])))
            right = pa.array(np.concatenate((b, np.zeros(len(some), np.int64))), mask=np.arange(k + len(some)) >= k)
            yield pa.RecordBatch.from_arrays([left, right, pa.array(np.concatenate((np.zeros(k, np.int64), counts[some])))], ["a", "b", "links"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, wide: int = WIDE, blocks: int | None = None) -> DataFrame:
    """Group documents whose SimHash fingerprints are linked.

    Returns one row per row of docs: doc_id, group_id (least doc_id of the
    group), kept (true for one row of each group), links (how many other
    fingerprints this one is linked to) and fingerprint (32 hex digits).

    A fingerprint has two halves of 64 bits, from the set of folded words of
    the whole text.  Two are linked if one of their halves is within the
    radius, and both together within ``wide`` bits: two chances to be found,
    and chance neighbours don't pass.  Each distinct fingerprint goes, by each
    half, to the shards of every choice of blocks - radius out of ``blocks``
    bit blocks; halves within the radius share a shard by the pigeonhole
    principle, so the search is exact.  The number of blocks follows the
    number of fingerprints, which changes the size of shards and nothing else.
    A shard's halves form a BK-tree, and each of them is compared with the
    leaves whose edges are within the radius of its own.  The trees stay where
    their shard is (a broadcast of all trees would grow with the corpus).
    Equal fingerprints are joined before, and a shard passes on only edges
    that connect its groups and sums of links, so large groups cost no more
    than linear traffic.

    Null text, empty text and text without words: fingerprint null, no links,
    a group of its own, kept.  Null doc_id: likewise, group_id null.  Rows
    that repeat a doc_id: one of each group_id is kept, the one with a
    fingerprint and the least one first.  Texts of any length are read in
    full, in pieces.  An empty table gives no rows.  Other columns of docs are
    never read, whatever their names.
    """
    return _groups(docs, id_col, text_col, radius, wide, blocks).select("doc_id", "group_id", "kept", "links", F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("one", "two")]).alias("fingerprint"))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _groups(docs: DataFrame, id_col: str, text_col: str, radius: int, wide: int = WIDE, blocks: int | None = None) -> DataFrame:
    """near_duplicates with the fingerprint's halves, and a hash h of each row's text."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _text_hash(text_col).alias("h"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are numbered once, in the table that is written
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            one, two, n = fingerprints(b.column("text"))
            none = n == 0
            numbers = np.arange(row, row + b.num_rows)
            row += b.num_rows
            cols = [pa.array(x, mask=none) for x in (one.view(np.int64), two.view(np.int64), node_of(one, two))]
            yield pa.RecordBatch.from_arrays([pa.array(numbers), b.column("doc_id"), *cols, b.column("h")], ["row", "doc_id", "one", "two", "node", "h"])

    fps = cut(src.mapInArrow(prints, "row long, doc_id long, one long, two long, node long, h long"), "simhash")
    real = fps.where("doc_id is not null and node is not null")
    distinct = cut(real.groupBy("one", "two", "node").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    count = distinct.count()
    blocks = blocks or blocks_for(count, radius)
    masks = masks_of(radius, blocks)

    def shards(b: pa.RecordBatch) -> pa.RecordBatch:
        halves = [b.column(c).to_numpy().view(_U) for c in ("one", "two")]
        which = np.arange(len(masks), dtype=_U) * _U(2)
        keys = []
        for side, h in enumerate(halves):
            tail = which + _U(side)
            keys.append((K.mix((h[:, None] & masks[None, :]) + (tail + _U(1)) * _U(0x9E3779B97F4A7C15)) & ~_U((1 << _TAIL) - 1)) | tail)
        x = np.concatenate([np.repeat(h, len(masks)) for h in halves])
        y = np.concatenate([np.repeat(h, len(masks)) for h in halves[::-1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k.ravel() for k in keys]).view(np.int64)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["shard", "x", "y"])

    keyed = map_arrow(distinct.select("one", "two"), shards, "shard long, x long, y long")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-count * len(masks) * 2 // TASK_ROWS))
    found = cut(keyed.repartition(tasks, "shard").mapInArrow(_links(radius, blocks, wide), "a long, b long, links long"), "simhash-links")
    roots = components(found.where("b is not null").select("a", "b"), "simhash-edges")
    times = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    rep = distinct.join(roots, distinct.node == roots.node, "left").select(distinct.node, "first", F.coalesce("root", distinct.node).alias("root"))
    lead = rep.groupBy("root").agg(F.min("first").alias("lead"))
    named = rep.join(lead, "root").select(F.col("node").alias("f"), "lead").join(times, F.col("f") == F.col("a"), "left").select("f", "lead", "links")
    out = fps.join(named, fps.node == named.f, "left")
    group = F.when(F.col("doc_id").isNull(), None).when(F.col("f").isNull(), F.col("doc_id")).otherwise(F.col("lead"))
    out = out.select("row", "doc_id", "one", "two", "h", group.alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    out = cut(out, "simhash-named")
    # the least row of each group, looked up by its number, so that no group meets in one task
    order = F.struct("doc_id", F.col("one").isNull().alias("none"), "one", "two", "h", "row")
    best = out.where("group_id is not null").groupBy("group_id").agg(F.min(order).alias("m")).select(F.col("m.row").alias("best"))
    return out.join(best, out.row == best.best, "left").select("doc_id", "one", "two", "h", "group_id", "links", (F.col("doc_id").isNull() | F.col("best").isNotNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    found = cut(_groups(docs, id_col, text_col, radius, wide), "simhash-groups")
    gone = found.where("doc_id is not null").groupBy("doc_id", "h").agg(F.max("kept").alias("k"), F.count("*").alias("n"))
    mark = uuid.uuid4().hex
    lost = gone.where(~F.col("k")).select(F.col("doc_id").alias("i" + mark), F.col("h").alias("h" + mark))
    out = docs.join(lost, (F.col(id_col) == F.col("i" + mark)) & (_text_hash(text_col) == F.col("h" + mark)), "left_anti").select(docs.columns)
    if gone.where("k and n > 1").isEmpty():
        return out
    nth = F.row_number().over(Window.partitionBy(id_col, _text_hash(text_col)).orderBy(F.lit(0)))
    name = "n" + mark
    return out.withColumn(name, nth).where(F.col(id_col).isNull() | (F.col(name) == 1)).drop(name)
