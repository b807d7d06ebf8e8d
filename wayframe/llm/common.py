"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table into the shared folder and read it again.

    This cuts the lineage, so that a lost executor costs no recomputation of
    what went before, and each later use reads columns instead of running the
    plan again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Tokens of a text: runs of anything but blank, tab and line ends; null has 0."""
    bare = F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \t\n\r]+"))).cast("long")


WORD_COUNT_SQL = "CAST(len(list_filter(string_split_regex(coalesce({0}, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS BIGINT)"


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch; batches that give None vanish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a partition at once; None if there are none.  The caller sizes the partitions."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def lumps(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by keys, about ``least`` at a time, never part of a key's rows.

    Memory is bounded by ``least`` rows or those of one key, whatever the partition holds.
    """
    held: list[pa.RecordBatch] = []
    n, goal = 0, least
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < goal:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(n, bool)
        for k in keys:
            x = t[k].to_numpy()
            same &= x == x[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), n - cut
        goal = max(least, 2 * n)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the undirected edges (a, b), both long.

    Alternates large-star and small-star passes, each written to the shared
    folder, until the edges no longer change; needs about log(n) passes
    whatever the shape.  Returns (node, root) for each node that has an edge,
    root being the least node of its component.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.where("a <> b").distinct(), name)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (now.n, now.h):
            break
        before = (now.n, now.h)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
