"""Repeated passages found with content-defined chunks of lines, and removed."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import map_arrow

#: Independent chunkings; a passage is found if any of them has a chunk within it.
SEEDS = 6
#: Lines that the rolling hash covers which decides on a boundary.
ROLL = 2
#: A chunk counts from so many lines and bytes on.
MIN_LINES, MIN_BYTES = 2, 60
#: A single line counts from so many words on.
LONG_WORDS = 50

_U = np.uint64
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each row; together they cover every byte.

    A line ends behind a line end, or behind the blank that follows a full stop,
    an exclamation or a question mark: texts that keep a paragraph in one line
    are cut at its sentences.
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.zeros(n + 1, bool)
    stop[1:] = buf == 10
    stop[2:] |= (buf[1:] == 32) & _END[buf[:-1]]
    stop[0] = False
    stop[offs[offs <= n]] = True
    ends = np.flatnonzero(stop)
    ends = ends[ends > 0]
    return np.concatenate(([0], ends[:-1])), ends


def hashed_lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and hash of each line; the end is without the blanks that end the line, at most two."""
    s, e = lines(buf, offs)
    row = np.searchsorted(offs, s, side="right") - 1
    if len(s):
        e = e - K.BLANK[buf[e - 1]]
        e -= (e > s) & K.BLANK[buf[np.maximum(e - 1, 0)]]
    return row, s, e, K.span_hashes(buf, s, e)


def chunks(buf: np.ndarray, offs: np.ndarray, seeds: int = SEEDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, digest, and first and last byte (relative to the row) of each multi-line chunk.

    For each seed, a line ends a chunk if the rolling hash over it and the
    ROLL - 1 lines before it says so (one line in two), or if it is the last
    one.  The digest is that of the lines' hashes in their order.
    """
    row, s, e, h = hashed_lines(buf, offs)
    none = np.zeros(0, np.int64)
    if not len(s):
        return none, none.astype(_U), none, none
    last = np.append(row[1:] != row[:-1], True)
    at = np.arange(len(s))
    begin = np.maximum(at - ROLL + 1, np.searchsorted(row, row))
    rolled = K.sequence_hashes(h, begin, at + 1)
    out = []
    for seed in range(seeds):
        cut = last | ((K.mix(rolled + K.salt(seed + 1)) & _U(1)) == 0)
        b = np.flatnonzero(cut)
        a = np.concatenate(([0], b[:-1] + 1))
        keep = (b - a + 1 >= MIN_LINES) & (e[b] - s[a] >= MIN_BYTES)
        out.append((a[keep], b[keep]))
    ab = np.unique(np.concatenate([a * (len(s) + 1) + b for a, b in out]))
    a, b = ab // (len(s) + 1), ab % (len(s) + 1)
    return row[a], K.sequence_hashes(h, a, b + 1), s[a] - offs[row[a]], e[b] - offs[row[a]]


def windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``chunks``, of all the shortest runs of lines that count, and of single lines of LONG_WORDS words or more.

    From each line on, and up to each line, the least lines that are MIN_LINES
    and MIN_BYTES.  Whatever run of lines two documents share, if it is that
    long, these cover all of it, so no match needs to be extended by lines.
    """
    row, s, e, h = hashed_lines(buf, offs)
    if not len(s):
        none = np.zeros(0, np.int64)
        return none, none.astype(_U), none, none
    at = np.arange(len(s))
    # ends go up with the lines, except for lines of blanks only
    up = np.maximum.accumulate(e)
    b = np.maximum(at + MIN_LINES - 1, np.searchsorted(up, s + MIN_BYTES))
    a = np.minimum(at - MIN_LINES + 1, np.searchsorted(s, e - MIN_BYTES, side="right") - 1)
    first, _ = K.tokens(buf, offs)
    long = at[np.searchsorted(first, e) - np.searchsorted(first, s) >= LONG_WORDS]
    a, b = np.concatenate((at, a, long)), np.concatenate((b, at, long))
    ok = (a >= 0) & (b < len(s))
    a, b = a[ok], b[ok]
    ok = (row[a] == row[b]) & (e[b] - s[a] >= MIN_BYTES)
    ab = np.unique(a[ok] * (len(s) + 1) + b[ok])
    a, b = ab // (len(s) + 1), ab % (len(s) + 1)
    return row[a], K.sequence_hashes(h, a, b + 1), s[a] - offs[row[a]], e[b] - offs[row[a]]


def _find(b: pa.RecordBatch, cutter) -> pa.RecordBatch:
    """digest, salt, more, id, k and at of the candidates of a batch.

    Of one digest only the first candidate in the batch is left to be compared
    with other batches (salt 0); what follows it comes later in any case, and
    its salt spreads it.  more tells that something follows.
    """
    buf, offs = K.raw(b.column("text"))
    ids, k = b.column("id"), b.column("k").to_numpy()
    here = np.asarray(ids.is_valid())
    number = ids.fill_null(0).to_numpy()
    rows, parts = [np.zeros(0, np.int64)], [(np.zeros(0, _U), np.zeros(0, np.int64))]
    for lo, hi in K.slices(offs):
        r, d, p, q = cutter(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        rows.append(r + lo)
        parts.append((d, (p << 32) | q))
    row = np.concatenate(rows)
    d, at = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    order = np.lexsort((at, k[row], number[row], here[row], d))
    row, d, at = row[order], d[order], at[order]
    same = np.concatenate(([False], d[1:] == d[:-1])) if len(d) else np.zeros(0, bool)
    # rows that repeat id and text are one document
    again = same & np.concatenate(([False], (at[1:] == at[:-1]) & (k[row[1:]] == k[row[:-1]]) & (number[row[1:]] == number[row[:-1]]) & (here[row[1:]] == here[row[:-1]]))) if len(d) else same
    row, d, at, same = row[~again], d[~again], at[~again], same[~again]
    more = ~same & np.append(same[1:], False) if len(d) else same
    salt = np.where(same, np.where(k[row] == 0, 1, k[row]), 0)
    return pa.RecordBatch.from_arrays([pa.array(d.view(np.int64)), pa.array(salt), pa.array(more), pa.array(number[row], mask=~here[row]), pa.array(k[row]), pa.array(at)], ["digest", "salt", "more", "id", "k", "at"])


def _contents(b: pa.RecordBatch) -> pa.RecordBatch:
    """Digest and bytes, line by line, of the different candidates of a batch.

    The bytes are deflated, which keeps equal ones equal and different ones different.
    """
    buf, offs = K.raw(b.column("text").cast(pa.string()))
    _, s, e, _ = hashed_lines(buf, offs)
    lists = b.column("cand")
    parent = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    at, digest = flat.field("at").to_numpy() >> 1, flat.field("digest").to_numpy()
    first = np.searchsorted(s, offs[parent] + (at >> 32))
    last = np.searchsorted(s, offs[parent] + (at & 0x7FFFFFFF))
    raw, s, e = memoryview(buf), s.tolist(), e.tolist()
    seen = {(d, b"\n".join(raw[s[i] : e[i]] for i in range(x, y))) for d, x, y in zip(digest.tolist(), first.tolist(), last.tolist())}
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in seen], pa.int64()), pa.array([zlib.compress(x, 1, -15) for _, x in seen], pa.binary())], ["digest", "bytes"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """docs with every passage but its first occurrence removed from the texts.

    All columns and rows of docs come back, with text changed where something
    was removed, and one more column, ``__removed``: the bytes removed (0 in
    most rows).  A column of that name in docs gives way to it; other columns
    may have any name.

    Lines (see ``lines``) are cut into chunks where a rolling hash over line
    hashes says so, so the same run of lines gives the same chunks wherever it
    stands.  Chunks of two lines and 60 bytes at least whose 64-bit digest
    occurs twice are candidates.  The bytes of their lines are fetched and
    compared: a digest that stands for different bytes removes nothing.  Of
    the same chunks all but the first by (doc_id, place) go, in one document
    as well as over many.

    With every, the candidates are those of ``windows`` instead, rolling hashes
    over all runs of lines: a shared run of lines that counts goes from its
    first line to its last, and a single line of LONG_WORDS words too.
    Otherwise single lines are never removed.  Blanks and line ends between
    lines don't count.  A passage that begins or ends within a line keeps that
    line.

    Null texts stay null, empty ones empty.  Rows that repeat both doc_id and
    text are one document; those that repeat only doc_id are different ones,
    in the order of a hash of their texts.  A null doc_id comes before others
    in the order of occurrences.  A text all of which occurred before becomes
    empty; its row stays.  Texts of any length are read in full.  An empty
    table gives no rows.
    """
    return _without_repeats(docs.drop("__removed"), id_col, text_col, every, "__removed")


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, every: bool, removed: str) -> DataFrame:
    names, mark = docs.columns, uuid.uuid4().hex
    k, i, cand, new = (x + mark for x in ("k", "i", "cand", "new"))
    cutter = windows if every else chunks
    # a hash of the text tells rows of the same id apart; without an id, when it is negative, it must do so alone
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_col).bitwiseOR(F.lit(-1 << 63))).otherwise(F.xxhash64(text_col).bitwiseAND(0xFFFFFFFF))
    asked = docs.where(F.length(text_col) > MIN_BYTES // 4).select(F.col(id_col).cast("long").alias("id"), key.alias("k"), F.col(text_col).cast("string").alias("text"))
    found = map_arrow(asked, lambda b: _find(b, cutter), "digest long, salt long, more boolean, id long, k long, at long")
    order = Window.partitionBy("digest", "salt").orderBy("id", "k", "at")
    later = (F.col("salt") != 0) | (F.rank().over(order) > 1)
    times = found.select("digest", "id", "k", "at", "more", later.alias("later"), F.lead("k").over(order).isNotNull().alias("next")).where("later or next or more")
    # the lowest bit of at says whether the candidate comes later
    times = times.select(F.coalesce("id", F.lit(0)).alias("id"), "k", (F.col("at") * 2 + F.col("later").cast("long")).alias("at"), "digest").repartition("id", "k")
    wanted = times.groupBy("id", "k").agg(F.collect_set(F.struct("at", "digest")).alias(cand)).withColumnsRenamed({"id": i, "k": "w" + mark})

    # both joins read the same shuffled rows; plain keys, so that wanted stays as it is partitioned
    src = docs.withColumn(k, key)
    meet = (F.coalesce(F.col(id_col).cast("long"), F.lit(0)) == F.col(i)) & (F.col(k) == F.col("w" + mark))
    held = src.join(wanted, meet, "left").select(F.when(F.col(cand).isNotNull(), F.col(text_col)).alias("text"), F.col(cand).alias("cand"))
    shown = map_arrow(held, _contents, "digest long, bytes binary").groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    # digests that stand for different bytes; hardly ever any, and then a handful
    mixed = shown.where("least <> most").agg(F.collect_list("digest").alias("mixed" + mark))

    raw = F.encode(F.col(text_col).cast("string"), "UTF-8")
    end = F.octet_length(text_col).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)").alias("keep"))

    def step(acc: Column, r: Column) -> Column:
        more = F.when(r["lo"] > acc["at"], F.concat(acc["keep"], F.array(F.struct(acc["at"].alias("lo"), r["lo"].alias("hi"))))).otherwise(acc["keep"])
        return F.struct(F.greatest(acc["at"], r["hi"]).alias("at"), more.alias("keep"))

    gone = F.filter(cand, lambda x: (x["at"].bitwiseAND(1) == 1) & ~F.array_contains("mixed" + mark, x["digest"]))
    gone = F.array_sort(F.transform(gone, lambda x: F.struct(F.shiftright(x["at"], 33).alias("lo"), F.shiftright(x["at"], 1).bitwiseAND(0x7FFFFFFF).alias("hi"))))
    tail = F.array(F.struct(end.alias("lo"), end.alias("hi")))
    kept = F.aggregate(F.concat(gone, tail), start, step)["keep"]
    joined = F.concat(F.lit("").cast("binary"), F.array_join(F.transform(kept, lambda x: F.decode(F.substring(raw, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")), "UTF-8")), "").cast("binary"))
    text = F.when(F.exists(cand, lambda x: x["at"].bitwiseAND(1) == 1), F.when(F.size(gone) > 0, F.ltrim(F.decode(joined, "UTF-8"))))
    out = src.join(wanted, meet, "left").join(F.broadcast(mixed)).withColumn(new, F.coalesce(text, F.col(text_col).cast("string")))
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) - F.coalesce(F.octet_length(new), F.lit(0))).cast("long")
    return out.select(*[F.col(new).alias(c) if c == text_col else F.col(c) for c in names], size.alias(removed))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """doc_id, text without repeats, and the bytes removed, a row for each row of docs."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _without_repeats(d, "doc_id", "text", every, "removed")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs after remove_repeats with every, without the rows that it emptied; n_chars follows the text."""
    removed = "r" + uuid.uuid4().hex
    out = _without_repeats(docs, id_col, text_col, True, removed).where((F.col(removed) == 0) | (F.trim(text_col) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
