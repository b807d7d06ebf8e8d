"""Chat formatting: conversations cut into windows of a token budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_COUNT_SQL, map_arrow, word_count

BUDGET = 512
#: Tokens of earlier turns that a window may repeat.
HISTORY = 128
#: Tokens of the marks around each turn.
MARKS = 2


def spans(n: np.ndarray, fixed: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """Windows over turns of n tokens: (first of the history, first new turn, end).

    Every window has room for the fixed tokens; it takes at least one new turn,
    as many as fit, behind the longest run of earlier turns that is within the
    history limit and leaves room for the first new turn.
    """
    c = np.concatenate(([0], np.cumsum(n)))
    out, s = [], 0
    while s < len(n):
        room = min(history, budget - fixed - int(n[s]))
        back = int(np.searchsorted(c[: s + 1], c[s] - room, side="left")) if room > 0 else s
        e = int(np.searchsorted(c, budget - fixed + c[back], side="right")) - 1
        e = max(e, s + 1)
        out.append((back, s, e))
        s = e
    return out


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Returns conv_id, win, history_from, first_new, last_new, tokens, target_tokens, mask and text.

    A conversation's turns are ordered by (turn, role, text), nulls last.  Its
    first system turn opens every window; the other turns are numbered from 1
    and each is new in just one window, so each assistant turn is a target
    once.  A window repeats the latest turns before its new ones, up to the
    history limit, and new turns follow while the budget lasts, by prefix sums
    of their tokens.  mask has a digit for each turn of the window: 1 for a
    new assistant turn (a target), 0 for the system turn, other roles, and
    everything repeated.

    A turn is never cut: one that is longer than the budget gets a window
    beyond the budget for itself (with the system turn).  Null roles count as
    user, null and empty texts have only their marks' tokens.  Rows without
    conv_id are left out, repeated rows are turns of their own, and a
    conversation of only a system turn gives no window.  Other columns are
    never read.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit("user"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turn = F.col(turn_col).cast("long")
    d = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(turn.isNull().alias("last"), turn.alias("turn"), role.alias("role"), text.alias("text"), (word_count(text) + MARKS).alias("n")).alias("t"),
    )
    d = d.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        lists = b.column("t")
        offs = lists.offsets.to_pylist()
        flat = lists.flatten()
        base = offs[0]
        role, text, n = flat.field("role").to_pylist(), flat.field("text").to_pylist(), flat.field("n").to_numpy()
        for conv, lo, hi in zip(b.column("conv_id").to_pylist(), offs, offs[1:]):
            at = list(range(lo - base, hi - base))
            head = next((i for i in at if role[i] == "system"), None)
            if head is not None:
                at.remove(head)
            fixed = int(n[head]) if head is not None else 0
            for w, (back, s, e) in enumerate(spans(n[at], fixed, budget, history)):
                shown = ([] if head is None else [head]) + at[back:e]
                new = set(at[s:e])
                goal = [i in new and role[i] == "assistant" for i in shown]
                body = "".join(f"<|{role[i]}|>\n{text[i]}<|end|>\n" for i in shown)
                rows.append((conv, w, back + 1, s + 1, e, int(n[shown].sum()), int(sum(n[i] for i, g in zip(shown, goal) if g)), "".join("1" if g else "0" for g in goal), body))
        cols = list(zip(*rows)) if rows else [[]] * 9
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "win", "history_from", "first_new", "last_new", "tokens", "target_tokens", "mask", "text"])

    return map_arrow(d, run, "conv_id long, win long, history_from long, first_new long, last_new long, tokens long, target_tokens long, mask string, text string")


def windows_sql(budget: int = BUDGET, history: int = HISTORY) -> str:
    return rf"""
    WITH RECURSIVE t AS (
      SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text, {WORD_COUNT_SQL.format("text")} + {MARKS} AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'user'), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    head AS (SELECT conv_id, min(pos) AS pos FROM t WHERE role = 'system' GROUP BY conv_id),
    sys AS (SELECT t.conv_id, t.n, t.text FROM t JOIN head USING (conv_id, pos)),
    r AS (SELECT t.conv_id, t.role, t.text, t.n, coalesce(sys.n, 0) AS fixed, row_number() OVER w AS i, CAST(sum(t.n) OVER w AS BIGINT) AS c
          FROM t LEFT JOIN head ON t.conv_id = head.conv_id AND t.pos = head.pos LEFT JOIN sys ON t.conv_id = sys.conv_id
          WHERE head.pos IS NULL WINDOW w AS (PARTITION BY t.conv_id ORDER BY t.pos ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT s.conv_id, s.i, s.n, s.c, s.fixed, coalesce(min(j.i), s.i) AS back, coalesce(min(j.c - j.n), s.c - s.n) AS c0
          FROM r s LEFT JOIN r j ON j.conv_id = s.conv_id AND j.i < s.i AND (s.c - s.n) - (j.c - j.n) <= least({history}, {budget} - s.fixed - s.n)
          GROUP BY s.conv_id, s.i, s.n, s.c, s.fixed),
    x AS (SELECT b.conv_id, b.i, b.back, greatest(coalesce(max(j.i), b.i), b.i) AS e
          FROM b LEFT JOIN r j ON j.conv_id = b.conv_id AND j.i >= b.i AND b.fixed + j.c - b.c0 <= {budget} GROUP BY b.conv_id, b.i, b.back),
    walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS win, i, back, e FROM x WHERE i = 1
             UNION ALL SELECT x.conv_id, walk.win + 1, x.i, x.back, x.e FROM walk JOIN x ON x.conv_id = walk.conv_id AND x.i = walk.e + 1)
    SELECT w.conv_id, w.win, w.back AS history_from, w.i AS first_new, w.e AS last_new,
           CAST(any_value(r.fixed) + sum(r.n) AS BIGINT) AS tokens,
           CAST(coalesce(sum(r.n) FILTER (WHERE r.i >= w.i AND r.role = 'assistant'), 0) AS BIGINT) AS target_tokens,
           CASE WHEN any_value(r.fixed) > 0 THEN '0' ELSE '' END || string_agg(CASE WHEN r.i >= w.i AND r.role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY r.i) AS mask,
           coalesce('<|system|>' || chr(10) || any_value(sys.text) || '<|end|>' || chr(10), '')
             || string_agg('<|' || r.role || '|>' || chr(10) || r.text || '<|end|>' || chr(10), '' ORDER BY r.i) AS text
    FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.i BETWEEN w.back AND w.e LEFT JOIN sys ON sys.conv_id = w.conv_id
    GROUP BY w.conv_id, w.win, w.back, w.i, w.e"""
