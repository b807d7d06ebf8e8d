"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of unigrams and bigrams over the whole corpus are quantised on a
logarithmic scale, and an n-gram of level q is put into the filter q times,
with the level number as part of the key.  Probing levels 1, 2, ... until one
is missing gives the level back; it can only be too high, and rarely is.
Level 0 is a count of one: whatever is scored has been counted, so an n-gram
that isn't in the filter at all occurs once, and needs no place in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import cut, gather, map_arrow

#: A count c has level floor(log_BASE c).
BASE = 1.5
#: Filter bits per entry, probes per entry: one in 100 that was never put in seems to be there.
BITS, PROBES = 10, 5
#: Weight of the bigram estimate; the rest is the unigram's.
MIX = 0.7
#: What is taken off a bigram's count, so that what was seen once proves little.
DISCOUNT = 0.9
#: The filter is made of parts of their own, one for so many bytes of text; an n-gram's probes all lie in one.
PART_BYTES = 8 << 20
#: Keys that a worker sorts at a time while it counts.
COMBINE_KEYS = 2_000_000
#: Bytes of text whose n-grams are looked up together.
LOOKUP_BYTES = 4 << 20
#: A filter of at most so many bytes is broadcast; n-grams travel to the parts of a larger one.
BROADCAST_BYTES = 96 << 20
#: Bytes of text in a block of documents that travels together, and tokens whose n-grams ask for their levels at a time.
BLOCK_BYTES, LUMP_TOKENS = 6 << 20, 1_500_000

_U = np.uint64
_G = _U(0x9E3779B97F4A7C15)


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the folded tokens, of the bigrams that end at them (the first of a row follows a start mark), and rows."""
    low = K.fold(buf)
    s, e = K.tokens(low, offs)
    row = np.repeat(np.arange(len(offs) - 1), K.counts_per_row(s, offs))
    uni = K.mix(K.span_hashes(low, s, e) + _U(1))
    before = np.empty_like(uni)
    if len(uni):
        before[0] = 0
        before[1:] = np.where(row[1:] == row[:-1], uni[:-1], _U(0))
    return uni, K.mix(before * _G + uni + _U(2)), row


def all_ngrams(buf: np.ndarray, offs: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, next row, rows, and keys of tokens, bigrams and the tokens before (0 for the start mark), slice by slice.

    A text beyond a slice comes in pieces, each of which knows the token that went before.
    """
    for lo, hi in K.slices(offs, limit):
        last = None
        for part, o in K.pieces(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], ~K.BLANK):
            uni, bi, row = ngrams(part, o)
            prev = np.zeros_like(uni)
            if len(uni):
                prev[1:] = np.where(row[1:] == row[:-1], uni[:-1], _U(0))
                if last is not None and last[0] == row[0]:
                    prev[0] = last[1]
                    bi[0] = K.mix(prev[:1] * _G + uni[:1] + _U(2))[0]
                last = (row[-1], uni[-1])
                yield lo, hi, row, uni, bi, prev


def _distinct(keys: list[np.ndarray], parts: int) -> pa.RecordBatch:
    x = np.concatenate(keys)
    x.sort()
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    g, c = x[at], np.diff(np.append(at, len(x)))
    return pa.RecordBatch.from_arrays([pa.array(part_of(g, parts).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(c.astype(np.int32))], ["part", "g", "c"])


def _counts(parts: int):
    """(part, n-gram, count), counts added up over so many keys as keep a worker small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        n = 0
        for b in batches:
            buf, offs = K.raw(b.column("text"))
            for *_, uni, bi, prev in all_ngrams(buf, offs):
                # the start mark counts once for each document that has tokens
                keys += [uni, bi, prev[prev == 0]]
                n += 2 * len(uni)
                if n >= COMBINE_KEYS:
                    yield _distinct(keys, parts)
                    keys, n = [], 0
        if n:
            yield _distinct(keys, parts)

    return run


def level(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    q = levels.astype(float)
    low, high = np.ceil(BASE**q - 1e-9), np.maximum(np.ceil(BASE ** (q + 1) - 1e-9) - 1, 1)
    return (low + np.maximum(high, low)) / 2


#: count_of each level that a byte can hold.
_COUNTS = count_of(np.arange(256))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Each key's part; of sorted keys those of a part follow one another."""
    return (((keys >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def least_of(part: np.ndarray, parts: int) -> np.ndarray:
    """The least key that a part may have."""
    return ((part.astype(np.int64) << 32) + parts - 1).astype(_U) // _U(parts) << _U(32)


def sorting(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that sort the keys, and the sorted keys.

    The high bits of each key are sorted with its position below them, which is
    several times as fast as argsort; keys that differ only in the low bits are
    put in order afterwards.
    """
    bits = _U(max(1, (len(keys) - 1).bit_length()))
    packed = ((keys >> bits) << bits) | np.arange(len(keys), dtype=_U)
    packed.sort()
    at = (packed & ((_U(1) << bits) - _U(1))).astype(np.int64)
    out = keys[at]
    wrong = np.flatnonzero(out[1:] < out[:-1])
    if len(wrong):
        packed >>= bits
        for x in np.unique(packed[wrong]):
            lo, hi = np.searchsorted(packed, x, side="left"), np.searchsorted(packed, x, side="right")
            order = np.argsort(out[lo:hi], kind="stable")
            at[lo:hi], out[lo:hi] = at[lo:hi][order], out[lo:hi][order]
    return at, out


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values of x begins."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _narrow(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Numbers as the low bytes that the largest of them needs; how many, and the bytes."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return width, np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width]).ravel()


def _wide(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view(_U).ravel()


def _runs_of_bytes(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values data[bounds[i]:bounds[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _bytes_of(values: pa.Array) -> np.ndarray:
    """The bytes of a binary array, one value behind the other."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    offs = np.frombuffer(values.buffers()[1], np.int32 if pa.types.is_binary(values.type) else np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offs[0] : offs[-1]]


def _probe(keys: np.ndarray, q: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit places of the probes of level q."""
    h = K.mix(keys + K.salt(q))
    step = K.mix(h + _G) | _U(1)
    for i in range(PROBES):
        yield ((h + _U(i) * step) >> _U(8)) % (bits if isinstance(bits, np.ndarray) else _U(bits))


def build_part(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of one part of the filter, as bytes."""
    q = level(counts)
    bits = max(64, int(q.sum()) * BITS)
    out = np.zeros(bits, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        for at in _probe(keys[q >= j], j, bits):
            out[at.astype(np.int64)] = True
    return np.concatenate((np.frombuffer(np.int64(bits).tobytes(), np.uint8), np.packbits(out, bitorder="little")))


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of the filter whose n-grams came to this task."""
    t = gather(batches)
    if t is None:
        return
    part, g, c = t["part"].to_numpy(), t["g"].to_numpy().view(_U), t["c"].to_numpy()
    del t
    for p in np.unique(part):
        here = part == p
        x = g[here]
        order = np.argsort(x)
        x = x[order]
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        n = np.add.reduceat(c[here][order].astype(np.int64), at)
        x = x[at]
        bits = build_part(x, n)
        yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])


def build(docs: DataFrame, parts: int, text_col: str = "text") -> DataFrame:
    """The filter, one row (part, bits) for each part that has n-grams.

    What a task holds is one part or a few, and parts are made in proportion to
    the text, so it doesn't grow.
    """
    src = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = src.mapInArrow(_counts(parts), "part int, g long, c int").repartitionById(parts, F.col("part"))
    return counted.mapInArrow(_parts_of, "part int, bits binary")


class Filter:
    """Parts of the filter at hand: one run of bytes, where each part begins, and its bits."""

    def __init__(self, data: bytes, at: np.ndarray, size: np.ndarray):
        self.data, self.at, self.size = np.frombuffer(data, np.uint8), at, size

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key by repeated probes."""
        out = np.zeros(len(keys), np.uint8)
        part = part_of(keys, len(self.size))
        live = np.flatnonzero(self.size[part] > 0)
        q = 1
        while len(live):
            p = part[live]
            ok = np.ones(len(live), bool)
            for bit in _probe(keys[live], q, self.size[p].astype(_U)):
                ok &= (self.data[self.at[p] + (bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8)) & 1 > 0
            live = live[ok]
            out[live] = q
            q += 1
        return out


def joined(parts: Iterable[tuple[int, bytes]], n: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    at, size, data = np.zeros(n, np.int64), np.zeros(n, np.int64), bytearray()
    for p, raw in parts:
        size[p] = int(np.frombuffer(raw, np.int64, 1)[0])
        at[p] = len(data)
        data += memoryview(raw)[8:]
    return bytes(data), at, size


def log_probability(uni: np.ndarray, bi: np.ndarray, before: np.ndarray, total: float) -> np.ndarray:
    """Natural log of MIX * max(c(w' w) - DISCOUNT, 0) / c(w') + (1 - MIX) * (c(w) + 1) / (total + 1), from levels."""
    c, cb, cw = _COUNTS[uni], _COUNTS[bi], _COUNTS[before]
    ratio = np.minimum(np.maximum(cb - DISCOUNT, 0) / cw, 1.0)
    return np.log(MIX * ratio + (1 - MIX) * np.minimum((c + 1) / (total + 1), 1.0))


def _scores(texts: pa.Array, levels, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and log probability of each text; levels gives those of distinct keys."""
    buf, offs = K.raw(texts)
    n, s = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for lo, hi, row, uni, bi, prev in all_ngrams(buf, offs, LOOKUP_BYTES):
        words, at = np.unique(np.concatenate((uni, prev)), return_inverse=True)
        u = levels(words)[at]
        both, at = np.unique(bi, return_inverse=True)
        n[lo:hi] += np.bincount(row, minlength=hi - lo)
        s[lo:hi] += np.bincount(row, log_probability(u[: len(uni)], levels(both)[at], u[len(uni) :], total), minlength=hi - lo)
    return n, s


_ASKS = "part int, block long, lump int, n int, wide int, keys binary, many int, counts binary"
_ANSWERS = "block long, lump int, part int, levels binary"


def _in_order(texts: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's documents in an order of their own, whatever order they came in; bytes and offsets of their texts."""
    t = texts.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    return t, *K.raw(t["text"])


def _lumps(buf: np.ndarray, offs: np.ndarray) -> Iterator[list[tuple]]:
    """What all_ngrams gives, about LUMP_TOKENS at a time."""
    held: list[tuple] = []
    n = 0
    for x in all_ngrams(buf, offs):
        held.append(x)
        n += len(x[3])
        if n >= LUMP_TOKENS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _keys(lump: list[tuple]) -> np.ndarray:
    """Keys of a lump's tokens, then of its bigrams, then a 0 for each start mark."""
    return np.concatenate([x[3] for x in lump] + [x[4] for x in lump] + [x[5][x[5] == 0] for x in lump])


def _ask(parts: int):
    """Of a block: for each lump and part the distinct n-grams in order, as differences in few bytes, and their counts."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("lump", pa.int32()), ("n", pa.int32()), ("wide", pa.int32()), ("keys", pa.binary()), ("many", pa.int32()), ("counts", pa.binary())])

    def run(texts: pa.Table) -> pa.Table:
        block = texts["block"][0].as_py()
        out = []
        for nth, lump in enumerate(_lumps(*_in_order(texts)[1:])):
            x = _keys(lump)
            x.sort()
            at = _starts(x)
            x, count = x[at], np.diff(np.append(at, len(x)))
            part = part_of(x, parts)
            first = _starts(part)
            gap = np.diff(x, prepend=_U(0))
            gap[first] = x[first] - least_of(part[first], parts)
            wide, keys = _narrow(gap)
            many, counts = _narrow(count.astype(_U))
            bounds = np.append(first, len(x))
            k = len(first)
            same = [np.full(k, v, np.int32) for v in (nth, wide, many)]
            out.append(pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(np.full(k, block)), pa.array(same[0]), pa.array(np.diff(bounds).astype(np.int32)), pa.array(same[1]), _runs_of_bytes(keys, bounds * wide), pa.array(same[2]), _runs_of_bytes(counts, bounds * many)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def _answer(parts: int):
    """Of a part's questions: its filter from their counts, and the levels that it has of each question's n-grams, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        part = t["part"].to_numpy()
        for p in np.unique(part):
            here = t.filter(pa.array(part == p)).sort_by([("wide", "ascending"), ("many", "ascending")]).combine_chunks()
            n, wide, many = (here[c].to_numpy() for c in ("n", "wide", "many"))
            bounds = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
            keys, counts = [], []
            # rows of one width are next to one another
            for rows in np.split(np.arange(len(n)), _starts(wide * 16 + many)[1:]):
                some = here.slice(rows[0], len(rows))
                keys.append(_wide(_bytes_of(some["keys"]), int(wide[rows[0]])))
                counts.append(_wide(_bytes_of(some["counts"]), int(many[rows[0]])))
            gap, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
            # sums of the differences within each row
            total = np.concatenate((np.zeros(1, _U), np.cumsum(gap, dtype=_U)))
            x = total[1:] - np.repeat(total[bounds[:-1]], n) + least_of(np.array([p]), parts)[0]
            order, x = sorting(x)
            at = _starts(x)
            x, size = x[at], np.diff(np.append(at, len(x)))
            bits = build_part(x, np.add.reduceat(count[order], at))
            levels = np.empty(len(order), np.uint8)
            levels[order] = np.repeat(Filter(*joined([(int(p), bits.tobytes())], parts)).levels(x), size)
            yield pa.RecordBatch.from_arrays([here["block"].combine_chunks(), here["lump"].combine_chunks(), pa.array(np.full(len(n), p, np.int32)), _runs_of_bytes(levels, bounds)], ["block", "lump", "part", "levels"])

    return run


def _finish(total: float, names: list[str]):
    """Of a block and the answers to its questions: the rows of the result."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        t, buf, offs = _in_order(texts)
        got = answers.sort_by([("lump", "ascending"), ("part", "ascending")]).combine_chunks()
        lump_of = got["lump"].to_numpy()
        n, s = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1)
        last = 0
        for nth, lump in enumerate(_lumps(buf, offs)):
            lo, hi = np.searchsorted(lump_of, nth, side="left"), np.searchsorted(lump_of, nth, side="right")
            order, x = sorting(_keys(lump))
            at = _starts(x)
            levels = np.empty(len(x), np.uint8)
            levels[order] = np.repeat(_bytes_of(got["levels"].slice(lo, hi - lo)), np.diff(np.append(at, len(x))))
            tokens = sum(len(x[3]) for x in lump)
            uni, bi, start = np.split(levels, (tokens, 2 * tokens))
            done = begun = 0
            for a, b, row, own, _, prev in lump:
                u = uni[done : done + len(own)]
                before = np.concatenate((np.array([last], np.uint8), u[:-1]))
                marks = prev == 0
                k = int(marks.sum())
                before[marks] = start[begun : begun + k]
                n[a:b] += np.bincount(row, minlength=b - a)
                s[a:b] += np.bincount(row, log_probability(u, bi[done : done + len(own)], before, total), minlength=b - a)
                # a text that goes on in the next piece knows the token that went before
                last = u[-1]
                done, begun = done + len(own), begun + k
        return pa.table(dict(zip(names, _row(t["doc_id"].combine_chunks(), n, s))))

    return run


def _row(ids: pa.Array, n: np.ndarray, s: np.ndarray) -> list[pa.Array]:
    return [ids, pa.array(n), pa.array(s), pa.array(np.exp(-s / np.maximum(n, 1)), mask=n == 0)]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and tokens of a partition."""
    size = count = 0
    for b in batches:
        buf, offs = K.raw(b.column("text"))
        size += len(buf)
        for lo in range(0, len(buf), K.SLICE_BYTES):
            # a token begins at a byte that is no blank and first in the text, or behind a blank
            blank = K.BLANK[buf[max(lo - 1, 0) : lo + K.SLICE_BYTES]]
            if not lo:
                blank = np.concatenate(([True], blank))
            count += int(np.count_nonzero(blank[:-1] & ~blank[1:]))
        first = offs[1:-1][np.diff(offs)[1:] > 0]
        count += int(np.count_nonzero(~K.BLANK[buf[first - 1]] & ~K.BLANK[buf[first]] & (first > 0)))
    yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([count])], ["size", "tokens"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, tokens, log_prob and perplexity of each row of docs, under the n-grams of all of docs.

    Tokens are runs of anything but blanks and line ends, with ASCII and
    Latin-1 letters in lower case.  A token's probability mixes the bigram's
    discounted relative frequency with that of the token, add-one smoothed; all
    counts come from the filter, so they are the middles of their levels.

    The filter grows with the corpus and takes fewer bytes than its texts.  If
    these have no more than broadcast_bytes it is broadcast; else each
    block of documents sends its distinct n-grams and their counts to the tasks
    that make their parts of the filter from them, and gets their levels back
    in the same order.  Both give the same scores.

    Null and empty texts have 0 tokens, log_prob 0 and perplexity null.  Null
    and repeated doc_ids are scored row by row, and rows of equal text get equal
    scores.  Texts of any length count in full, in pieces.  An empty table
    gives no rows.  Columns besides id and text are never read, whatever
    their names.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seen = d.select("text").mapInArrow(_sizes, "size long, tokens long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "tokens")]).first()
    size, total = seen["size"], seen["tokens"]
    parts = max(8, -(-size // PART_BYTES))
    names = ["doc_id", "tokens", "log_prob", "perplexity"]
    out_schema = "doc_id long, tokens long, log_prob double, perplexity double"
    if size <= broadcast_bytes:
        filt = cut(build(d, parts), "lm-filter")
        rows = ((r["part"], bytes(r["bits"])) for r in filt.select("part", "bits").toLocalIterator())
        sent = docs.sparkSession.sparkContext.broadcast(joined(rows, parts))
        held: dict[int, Filter] = {}

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            if 0 not in held:
                held[0] = Filter(*sent.value)
            return pa.RecordBatch.from_arrays(_row(b.column("doc_id"), *_scores(b.column("text"), held[0].levels, total)), names)

        return map_arrow(d, run, out_schema)

    blocks = max(1, -(-size // BLOCK_BYTES))
    h = F.xxhash64("doc_id", "text")
    # the same rows in the same partitions twice, which are shuffled once
    blocked = d.select("doc_id", "text", h.alias("h"), F.pmod(h, F.lit(blocks)).cast("long").alias("block")).repartition(blocks, "block")
    asks = blocked.groupBy("block").applyInArrow(_ask(parts), _ASKS)
    answers = asks.repartitionById(parts, F.col("part")).mapInArrow(_answer(parts), _ANSWERS)
    return blocked.groupBy("block").cogroup(answers.repartition(blocks, "block").groupBy("block")).applyInArrow(_finish(total, names), out_schema)
