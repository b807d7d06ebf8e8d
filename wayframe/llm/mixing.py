"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_COUNT_SQL, cut, word_count

#: Relative weights of the production mixture; a source that isn't listed has DEFAULT_WEIGHT.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 1.5}
DEFAULT_WEIGHT = 1.0
BUDGET_SHARE = 0.9
SEED = "mix-1"


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    if default <= 0 or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[source], F.lit(float(default))) if pairs else F.lit(float(default))


def _order_key(doc: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))


def schedule(
    docs: DataFrame,
    weights: dict[str, float] = WEIGHTS,
    budget: int | None = None,
    budget_share: float = BUDGET_SHARE,
    default_weight: float = DEFAULT_WEIGHT,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents within the budget, in the order of their virtual finish times.

    Returns doc_id, source, tokens, finish and total: a source's documents in
    shuffled order (by a seeded hash of doc_id) finish at the running sum of the
    source's tokens divided by its weight; total is the running sum of tokens
    over all sources in the order (finish, source, hash, doc_id).  Documents
    stay up to the last one whose total is within the budget, which is
    ``budget`` tokens, or the given share of all tokens.

    Neither running sum is ever made in one task: rows fall into buckets of the
    hash (of the finish time), small tables of bucket sums give each bucket its
    offset, and windows run within a bucket only.

    Rows that repeat (source, doc_id) are scheduled as one with their tokens
    added up.  A null source is a source of its own, a null doc_id a document
    of its own in each source; null and empty texts have 0 tokens and cost
    nothing.  Text of any length counts in full.  Ties in finish follow
    source, hash and doc_id, nulls first.  An empty table gives no rows.
    Columns besides id, text and source are never read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("tokens"))
    units = d.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens")).withColumn("hash", _order_key(F.col("doc_id"), seed))
    units = cut(units.withColumn("bucket", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int")), "mix-units")

    sums = units.groupBy("source", "bucket").agg(F.sum("tokens").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("at_source"), F.col("bucket").alias("at_bucket"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    here = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    local = units.withColumn("local", F.sum("tokens").over(here))
    timed = local.join(starts, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("bucket") == F.col("at_bucket")))
    finish = (F.col("start") + F.col("local")).cast("double") / _weight(F.col("source"), weights, default_weight)
    timed = cut(
        timed.select("doc_id", "source", "tokens", "hash", finish.alias("finish")).withColumn("slot", F.floor(F.log2(F.col("finish") + 1) * 256).cast("int")),
        "mix-finish",
    )

    slots = timed.groupBy("slot").agg(F.sum("tokens").alias("s"))
    # one row a slot, a few thousand whatever the input
    gone = slots.select(F.col("slot").alias("at_slot"), F.coalesce(F.sum("s").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    if budget is None:
        limit = timed.agg(F.floor(F.sum("tokens") * F.lit(float(budget_share))).alias("budget"))
    else:
        limit = docs.sparkSession.range(1).select(F.lit(int(budget)).alias("budget"))
    run = Window.partitionBy("slot").orderBy("finish", "source", "hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = timed.join(F.broadcast(gone.crossJoin(limit).where("start <= budget")), F.col("slot") == F.col("at_slot"))
    placed = placed.withColumn("total", F.col("start") + F.sum("tokens").over(run))
    return placed.where("total <= budget").select("doc_id", "source", "tokens", "finish", "total", F.col("hash").alias("order_key"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, **options) -> DataFrame:
    """The rows of docs that schedule keeps, with all their columns.

    What a source keeps is a prefix of its shuffled order, so one last key per
    source decides for every row and no text is moved.  The rules for nulls,
    repeats and ties are those of schedule.
    """
    kept = schedule(docs, id_col=id_col, source_col=source_col, seed=seed, **options)
    key = F.struct("order_key", "doc_id")
    name = "last" + uuid.uuid4().hex
    last = cut(kept.groupBy("source").agg(F.max(key).alias("last")), "mix-last").select(F.struct("source", "last").alias(name))
    mine = F.struct(_order_key(F.col(id_col), seed).alias("order_key"), F.col(id_col).alias("doc_id"))
    near = docs.join(last, F.col(source_col).eqNullSafe(F.col(name)["source"]))
    return near.where(mine <= F.col(name)["last"]).select(docs.columns)


def schedule_sql(weights: dict[str, float] = WEIGHTS, budget_share: float = BUDGET_SHARE, default_weight: float = DEFAULT_WEIGHT, seed: str = SEED) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in weights.items())
    return f"""
    WITH d AS (SELECT doc_id, source, {WORD_COUNT_SQL.format("text")} AS tokens FROM documents),
    u AS (SELECT source, doc_id, CAST(SUM(tokens) AS BIGINT) AS tokens, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM d GROUP BY source, doc_id),
    f AS (SELECT *, CAST(SUM(tokens) OVER (PARTITION BY source ORDER BY hash, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DOUBLE)
          / CAST(CASE source {cases} ELSE {default_weight!r} END AS DOUBLE) AS finish FROM u),
    g AS (SELECT *, CAST(SUM(tokens) OVER (ORDER BY finish, source NULLS FIRST, hash, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM f)
    SELECT doc_id, source, tokens, finish, total, hash AS order_key FROM g
    WHERE total <= (SELECT FLOOR(SUM(tokens) * CAST({budget_share!r} AS DOUBLE)) FROM u)"""
