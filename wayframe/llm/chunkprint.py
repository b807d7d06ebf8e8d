"""Document fingerprints: digests of content-defined chunks, and containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import cut, map_arrow

#: Shortest, usual and longest chunk in bytes: five to eight words, so that an edited word spoils little more than itself.
LEAST, USUAL, MOST = 32, 32, 128
#: Bits that must be zero before the usual length is reached, and beyond it.
STRICT_BITS, LOOSE_BITS = 4, 4
THRESHOLD = 0.3
#: Chunks that more classes have are compared by profile.
HOT = 50
_WINDOW = 32
SIZE_MASK = 2047


def gear_table() -> np.ndarray:
    """256 random 32-bit numbers, the same everywhere."""
    return (K.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


_GEAR = gear_table()


def gear(buf: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: sum of table[byte] shifted by its distance, over 32 bytes."""
    h = _GEAR[buf]
    width = 1
    while width < _WINDOW:
        nxt = h.copy()
        nxt[width:] += h[:-width] << np.uint32(width) if width < len(h) else np.uint32(0)
        h, width = nxt, width * 2
    return h


def boundaries(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each chunk, in order.

    A chunk has LEAST to MOST bytes.  It ends behind the first byte whose
    gear hash has its STRICT_BITS upper bits zero or, from the USUAL length on,
    its LOOSE_BITS upper bits; at a row's end in any case.
    """
    h = gear(buf)
    n = len(buf)
    strict = np.append(np.flatnonzero(h < np.uint32(1 << (32 - STRICT_BITS))) + 1, 1 << 60)
    loose = np.append(np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS))) + 1, 1 << 60)
    row = np.flatnonzero(np.diff(offs) > 0)
    pos = offs[row].copy()
    rows, starts, ends = [], [], []
    while len(row):
        stop = offs[row + 1]
        a = strict[np.searchsorted(strict, pos + LEAST)]
        b = loose[np.searchsorted(loose, pos + USUAL)]
        end = np.where(a < pos + USUAL, a, np.minimum(b, pos + MOST))
        end = np.minimum(end, stop)
        rows.append(row)
        starts.append(pos)
        ends.append(end)
        more = end < stop
        row, pos = row[more], end[more]
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z
    r, s, e = (np.concatenate(x) for x in (rows, starts, ends))
    order = np.argsort(s, kind="stable")
    return r[order], s[order], e[order]


def fingerprint(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per row, and the code of each distinct chunk of the row, in ascending order.

    A code has 53 bits of digest, and the chunk's length in its lower bits.
    """
    buf, offs = K.raw(texts)
    rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in K.slices(offs):
        part, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        r, s, e = boundaries(part, o)
        d = ((K.span_hashes(part, s, e) & ~np.uint64(SIZE_MASK)) | (e - s).astype(np.uint64)).view(np.int64)
        order = np.lexsort((d, r))
        r, d = r[order], d[order]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (d[1:] != d[:-1]))) if len(r) else np.zeros(0, bool)
        rows.append(r[new] + lo)
        codes.append(d[new])
    return np.searchsorted(np.concatenate(rows), np.arange(len(offs))), np.concatenate(codes)


def chunk_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its chunk set as sorted codes; empty for null and empty texts."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        offs, c = fingerprint(b.column("text"))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(c))], ["doc_id", "codes"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, "doc_id long, codes array<long>")


def _class() -> Column:
    return F.xxhash64("print", "lead")


def _weight(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(SIZE_MASK))


def containment(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, other_id, shared (bytes), containment, class_id and other_class, for pairs from the threshold on.

    Containment is the share of doc_id's weight, the bytes of its distinct
    chunks, that other_id's chunk set has too; it isn't symmetric.

    Documents with equal chunk sets form a class led by their least doc_id.
    Each member but the leader comes with its leader and containment 1;
    searched for are pairs of leaders, every leader being a query.  What a
    member has in common with others is what its leader has: class_id and
    other_class name the classes of the two ids, and ``partners`` makes of
    them the pairs of all rows.

    The search is exact: a document's chunks outside of a set that holds at
    least t of its weight weigh 1 - t at most, so of its rarest chunks that
    add up to more than that one at least must be shared, and only those are
    looked up among all chunks.

    Null and empty texts have no chunks and no pairs; rows with a null doc_id
    are left out; rows that repeat a doc_id are one document if their text is
    the same, and otherwise candidates like any other, but no pair joins a
    doc_id to itself.  Texts of any length are read in full.  Other columns
    are never read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sets = chunk_sets(docs, id_col, text_col).where("doc_id is not null and size(codes) > 0").withColumn("print", F.xxhash64("codes"))
    classes = sets.groupBy("print", "codes").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"), F.collect_set("doc_id").alias("ids"))
    classes = cut(classes.select(_class().alias("k"), "lead", "last", "ids", "codes"), "chunk-classes")
    members = classes.where("lead <> last").select(F.explode("ids").alias("doc_id"), F.col("lead").alias("other_id"), _weight(F.col("codes")).alias("shared"), F.lit(1.0).alias("containment"), F.col("k").alias("class_id"), F.col("k").alias("other_class")).where("doc_id <> other_id")

    flat = classes.select("k", F.explode("codes").alias("code"))
    # only chunks of several classes lead anywhere; the others count by their weight alone
    common = cut(flat.withColumn("df", F.count("*").over(Window.partitionBy("code"))).where("df > 1"), "chunk-shared")
    known = common.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("df", "code"))).alias("r"))
    full = classes.select("k", "lead", "last", _weight(F.col("codes")).alias("w")).join(known, "k")
    codes = F.transform("r", lambda x: x["code"])
    full = cut(full.select("k", "lead", "last", "w", codes.alias("codes")), "chunk-ranked")
    slim = full.withColumn("alone", F.col("w") - _weight(F.col("codes"))).where(_weight(F.col("codes")) >= F.col("w") * threshold)

    def rare(acc: Column, x: Column) -> Column:
        more = acc["left"] >= 0
        return F.struct((acc["left"] - F.when(more, x.bitwiseAND(SIZE_MASK)).otherwise(0)).alias("left"), (acc["n"] + more.cast("int")).alias("n"))

    allowed = (F.col("w") * (1.0 - threshold) - F.col("alone")).cast("double")
    taken = F.aggregate("codes", F.struct(allowed.alias("left"), F.lit(0).alias("n")), rare)["n"]
    probe = slim.select(F.col("k").alias("a"), F.explode(F.slice("codes", F.lit(1), taken)).alias("code"))
    # a container may itself be within no other document, so all shared chunks are held
    held = common.select(F.col("k").alias("b"), "code")
    pairs = probe.join(held, "code").where("a <> b").select("a", "b").distinct()
    left = slim.select(F.col("k").alias("a"), F.col("lead").alias("la"), F.col("last").alias("za"), "w", F.col("codes").alias("ca"))
    right = full.select(F.col("k").alias("b"), F.col("lead").alias("lb"), F.col("last").alias("zb"), F.col("codes").alias("cb"))
    # a doc_id that leads both classes gives its place to another member of one of them
    one = F.when((F.col("la") != F.col("lb")) | (F.col("la") != F.col("zb")), F.col("la")).otherwise(F.col("za"))
    two = F.when(F.col("la") != F.col("lb"), F.col("lb")).when(F.col("la") != F.col("zb"), F.col("zb")).otherwise(F.col("lb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("doc_id", one).withColumn("other_id", two).where("doc_id <> other_id")
    found = both.select("doc_id", "other_id", _weight(F.array_intersect("ca", "cb")).alias("shared"), "w", "a", "b").where(F.col("shared") >= F.col("w") * threshold)
    found = found.select("doc_id", "other_id", "shared", (F.col("shared") / F.col("w")).alias("containment"), F.col("a").alias("class_id"), F.col("b").alias("other_class"))
    return found.unionByName(members)


def partners(found: DataFrame) -> DataFrame:
    """doc_id, other_id, shared and containment of every two documents that the rows of containment stand for.

    Grows with the square of a class.  Of rows that repeat a doc_id the most
    that one of them shares counts.
    """
    ids = found.select(F.col("class_id").alias("c"), F.col("doc_id").alias("id")).union(found.select("other_class", "other_id")).distinct()
    own = found.where("class_id = other_class").select("class_id", "other_class", "shared", "containment").distinct()
    across = found.where("class_id <> other_class").select("class_id", "other_class", "shared", "containment")
    a, b = ids.select(F.col("c").alias("class_id"), F.col("id").alias("doc_id")), ids.select(F.col("c").alias("other_class"), F.col("id").alias("other_id"))
    every = across.unionByName(own).join(a, "class_id").join(b, "other_class").where("doc_id <> other_id")
    most = F.max(F.struct("containment", "shared")).alias("m")
    return every.groupBy("doc_id", "other_id").agg(most).select("doc_id", "other_id", "m.shared", "m.containment")


def links(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """A row for each row of docs: doc_id, class_id, copies, links, other_id and containment.

    Rows with equal chunk sets form a class, named by its least doc_id; copies
    is the number of its other rows.  links is how many rows of other classes
    hold the threshold or more of the document's weight (the bytes of its
    distinct chunks), other_id leads a class that holds the most of it, and
    containment is that share; both are null without links.  Every link
    between different texts counts, and none is a row of its own, so the
    result is as long as docs.

    Chunks that the same classes have count as one unit.  Pairs are made of
    the units that ``hot`` classes or fewer have, at most hot squared for each.
    What a class has of the others, its profile, is compared once with every
    profile that shares one of them, however many classes have it: classes
    with no rarer unit in common have those bytes in common that their
    profiles have.  hot changes the work, not the result.

    Null and empty texts have no chunks: class_id null, no copies and no
    links.  Rows with a null doc_id are left out.  Rows that repeat a doc_id
    are documents of their own; with different texts they may lead two
    classes.  Texts of any length are read in full.  An empty table gives no
    rows.  Other columns are never read, whatever their names.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")

    def prints(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each row."""
        k = K.sequence_hashes(K.mix(codes.view(np.uint64)), offs[:-1], offs[1:]).view(np.int64)
        return k, K.segment_sum(codes & SIZE_MASK, offs)

    def heads(b: pa.RecordBatch) -> pa.RecordBatch:
        offs, codes = fingerprint(b.column("text"))
        k, w = prints(codes, offs)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(k, mask=w == 0), pa.array(w)], ["doc_id", "k", "w"])

    def postings(b: pa.RecordBatch) -> pa.RecordBatch:
        offs, codes = fingerprint(b.column("text"))
        k, _ = prints(codes, offs)
        _, first = np.unique(k, return_index=True)
        own = np.zeros(len(k), bool)
        own[first] = True
        n = np.diff(offs)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(k, n)[np.repeat(own, n)]), pa.array(codes[np.repeat(own, n)])], ["k", "code"])

    # chunks are cut twice, which is less than to keep them all on disk
    rows = cut(map_arrow(src, heads, "doc_id long, k long, w long"), "chunk-rows")
    classes = cut(rows.where("k is not null").groupBy("k").agg(F.max("w").alias("w"), F.count("*").alias("n"), F.min("doc_id").alias("lead")), "chunk-classes")
    flat = map_arrow(src, postings, "k long, code long").repartition("code").dropDuplicates(["code", "k"])
    same = Window.partitionBy("code")
    # chunks of the same number of classes, and of the same ones by two hashes, are a unit
    unit = F.xxhash64(F.count("*").over(same), F.bit_xor(F.xxhash64("k")).over(same), F.bit_xor(F.xxhash64("k", F.lit(1))).over(same))
    units = flat.select("k", F.count("*").over(same).alias("df"), unit.alias("u"), F.col("code").bitwiseAND(SIZE_MASK).alias("wt")).where("df > 1")
    # once the shared chunks are with their class, units and profiles need no shuffle of their own
    units = units.repartition("k")
    units = units.groupBy("k", "u", "df").agg(F.sum("wt").alias("wt"))
    profile = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("u", "wt"))))
    held = units.groupBy("k").agg(profile(F.col("df") > hot).alias("hot"), profile(F.col("df") <= hot).alias("rare"), F.sum("wt").alias("common")).join(classes, "k")
    size = F.aggregate("hot", F.lit(0).cast("long"), lambda a, x: a + x["wt"])
    # numbers in place of hashes, as they take less room in what follows
    held = cut(held.select(F.monotonically_increasing_id().alias("id"), "k", "w", "n", "lead", "hot", "rare", size.alias("size"), F.when(F.size("hot") > 0, F.xxhash64("hot")).alias("g"), (F.col("common") >= F.col("w") * threshold).alias("ask")), "chunk-profiles")
    groups = held.where("g is not null").groupBy("g", "hot", "size").agg(F.sum("n").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("w").alias("least"), F.max("ask").alias("ask"))
    groups = cut(groups.withColumn("id", F.monotonically_increasing_id()), "chunk-groups")

    # pairs by rarer units
    who = held.select("id", "ask", F.explode("rare").alias("x")).groupBy("x").agg(F.collect_list(F.struct("id", "ask")).alias("who"))
    who = who.where("size(who) > 1").select("x.wt", "who", F.explode(F.filter("who", lambda x: x["ask"])).alias("a")).select("wt", F.col("a.id").alias("a"), F.explode("who.id").alias("b")).where("a <> b")
    pairs = who.groupBy("a", "b").agg(F.sum("wt").alias("rare"))
    left = held.select(F.col("id").alias("a"), "w", F.col("g").alias("ga"), F.col("size").alias("sa"))
    right = held.select(F.col("id").alias("b"), "n", F.col("g").alias("gb"), F.col("size").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where(F.col("rare") + F.least("sa", "sb") >= F.col("w") * threshold)
    # only two different profiles must be compared
    simple = near.where("ga is null or gb is null or ga = gb").withColumn("both", F.when(F.col("ga") == F.col("gb"), F.col("sa")).otherwise(0))
    both = F.aggregate(F.array_intersect("ha", "hb"), F.lit(0).cast("long"), lambda a, x: a + x["wt"])
    two = near.where("ga <> gb").join(groups.select(F.col("g").alias("ga"), F.col("hot").alias("ha")), "ga").join(groups.select(F.col("g").alias("gb"), F.col("hot").alias("hb")), "gb").withColumn("both", both)
    cols = ["a", "b", "w", "n", "rare", "both"]
    near = simple.select(cols).union(two.select(cols)).where(F.col("rare") + F.col("both") >= F.col("w") * threshold)
    more = F.sum(F.when(F.col("both") < F.col("w") * threshold, F.col("n")).otherwise(0))
    near = near.groupBy("a").agg(more.alias("rare_links"), F.max(F.struct((F.col("rare") + F.col("both")).alias("shared"), F.col("b").alias("id"))).alias("rare_best"))

    # pairs of profiles
    each = groups.select(F.col("id").alias("b"), F.explode("hot").alias("x")).select("b", "x.u")
    asking = groups.where(F.col("ask") & (F.col("size") >= F.col("least") * threshold)).select(F.col("id").alias("a"), F.explode("hot").alias("x"))
    met = asking.select("a", "x.u", "x.wt").join(each, "u").groupBy("a", "b").agg(F.sum("wt").alias("both"))
    met = met.join(groups.select(F.col("id").alias("b"), "n", "lo", "hi"), "b").groupBy("a", "both").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # a row for each number of shared bytes at most
    met = met.groupBy("a").agg(F.collect_list(F.struct("both", "n", "lo", "hi")).alias("met"))
    met = met.join(groups.select(F.col("id").alias("a"), F.col("g").alias("mg")), "a").select("mg", "met")

    out = held.where("ask").select("id", "k", "w", "n", "hot", "size", "g").join(met, F.col("g") == F.col("mg"), "left").join(near, F.col("id") == F.col("a"), "left")
    enough = F.filter(F.coalesce("met", F.expr("cast(array() as array<struct<both:bigint,n:bigint,lo:bigint,hi:bigint>>)")), lambda x: x["both"] >= F.col("w") * threshold)
    counted = F.aggregate(enough, F.lit(0).cast("long"), lambda a, x: a + x["n"]) - F.when((F.size("hot") > 0) & (F.col("size") >= F.col("w") * threshold), F.col("n")).otherwise(0)
    other = F.transform(enough, lambda x: F.struct(x["both"].alias("shared"), F.when(x["hi"] != F.col("id"), x["hi"]).when(x["lo"] != F.col("id"), x["lo"]).alias("id")))
    best = F.array_max(F.concat(F.filter(other, lambda x: x["id"].isNotNull()), F.array_compact(F.array("rare_best"))))
    out = out.select("k", (counted + F.coalesce("rare_links", F.lit(0))).alias("links"), best.alias("best")).where("links > 0")
    leads = held.select(F.col("id").alias("best_id"), F.col("lead").alias("other_id"))
    out = out.withColumn("best_id", F.col("best.id")).join(leads, "best_id", "left").select(F.col("k").alias("o"), "links", "other_id", F.col("best.shared").alias("shared"))
    named = classes.join(out, F.col("k") == F.col("o"), "left").select(F.col("k").alias("c"), F.col("lead").alias("class_id"), (F.col("n") - 1).alias("copies"), "links", "other_id", (F.col("shared") / F.col("w")).alias("containment"))
    found = rows.join(named, F.col("k") == F.col("c"), "left")
    none = F.lit(0).cast("long")
    return found.select("doc_id", "class_id", F.coalesce("copies", none).alias("copies"), F.coalesce("links", none).cast("long").alias("links"), "other_id", "containment")
