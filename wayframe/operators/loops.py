"""Loops of mark and jump, as a fixpoint over frontiers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions import conditions
from ..shared import shared_dir

if TYPE_CHECKING:
    from ..plans.compiler import Context, Frame


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def iterate(ctx: "Context", start: "Frame", lo: int, hi: int, run: Callable) -> "Frame":
    """Run the steps from lo to hi until no traveler jumps any more.

    Travelers that a jump sends to a mark wait there; each round takes all that
    wait at one mark through the steps behind it.  What comes out of step hi
    piles up; duplicates are walks of their own and stay.  If a limit is next,
    the rounds end as soon as it is reached; otherwise the graph's loop_rounds
    say how many there may be.
    """
    at = {v: i for i, (n, v) in enumerate(ctx.steps) if n == "mark"}
    waiting: dict[int, list["Frame"]] = {lo: [start]}
    done: list["Frame"] = []
    enough = ctx.steps[hi][1] if hi < len(ctx.steps) and ctx.steps[hi][0] == "limit" else None
    have = 0
    rounds = 0
    while waiting:
        rounds += 1
        if ctx.graph.loop_rounds is not None and rounds > ctx.graph.loop_rounds:
            raise PlanError(f"travelers still jump after {ctx.graph.loop_rounds} rounds")
        i = min(waiting)
        frame = _merge(waiting.pop(i))
        while i < hi and frame is not None:
            name, v = ctx.steps[i]
            if name == "jump":
                frame = frame.with_df(cut(frame.df, "jump"))
                goes = frame.df.where(conditions.build(v["expression"], frame.value)) if v.get("expression") else frame.df
                if v["mark"] in at and not goes.isEmpty():
                    waiting.setdefault(at[v["mark"]], []).append(frame.with_df(goes))
                if not v.get("emit"):
                    frame = None
            elif name == "mark":
                pass
            else:
                frame = run(frame, i, i + 1)
            i += 1
        if frame is not None:
            done.append(frame)
            if enough is not None:
                have += frame.df.limit(enough - have).count()
                if have >= enough:
                    break
    if not done:
        return start.with_df(start.df.where(F.lit(False)))
    return _merge(done)


def _merge(frames: list["Frame"]) -> "Frame":
    from dataclasses import replace

    if len(frames) == 1:
        return frames[0]
    kinds = {f.kind for f in frames}
    may = None if any(f.may is None for f in frames) else frozenset().union(*[f.may for f in frames])
    marks = {m: k for f in frames for m, k in f.marks.items()}
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.df for f in frames])
    return replace(frames[0], df=df, kind=frames[0].kind if len(kinds) == 1 else "vertex", marks=marks, same=frozenset(), may=may)
