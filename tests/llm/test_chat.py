from collections import defaultdict

import numpy as np

from wayframe.llm import chat as C


def brute(turns, budget, history):
    """turns: (role, text) in order."""
    n = [len(t.split()) + C.MARKS for _, t in turns]
    head = next((i for i, (r, _) in enumerate(turns) if r == "system"), None)
    rest = [i for i in range(len(turns)) if i != head]
    fixed = 0 if head is None else n[head]
    out, s = [], 0
    while s < len(rest):
        back = s
        while back > 0 and sum(n[i] for i in rest[back - 1 : s]) <= min(history, budget - fixed - n[rest[s]]):
            back -= 1
        e = s + 1
        while e < len(rest) and fixed + sum(n[i] for i in rest[back : e + 1]) <= budget:
            e += 1
        shown = ([] if head is None else [head]) + rest[back:e]
        mask = "".join("1" if i in rest[s:e] and turns[i][0] == "assistant" else "0" for i in shown)
        text = "".join(f"<|{turns[i][0]}|>\n{turns[i][1]}<|end|>\n" for i in shown)
        out.append((back + 1, s + 1, e, sum(n[i] for i in shown), sum(n[i] for i, m in zip(shown, mask) if m == "1"), mask, text))
        s = e
    return out


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for conv in range(60):
        for turn in range(rng.integers(1, 14)):
            role = "system" if turn == 0 and conv % 3 == 0 else ["user", "assistant", "tool"][rng.integers(0, 3)]
            rows.append((conv, turn, role, " ".join(["w"] * int(rng.integers(0, 40)))))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget, history in ((60, 20), (10, 0), (200, 1000), (45, 44)):
        got = defaultdict(list)
        for r in C.windows(d, budget, history).orderBy("conv_id", "win").collect():
            got[r.conv_id].append((r.history_from, r.first_new, r.last_new, r.tokens, r.target_tokens, r.mask, r.text))
        for conv in range(60):
            assert got[conv] == brute([(r, t) for c, _, r, t in rows if c == conv], budget, history)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"),
        (1, None, None, None),
        (1, 0, "assistant", "x " * 50000),
        (1, 1, "user", "same"),
        (1, 1, "user", "same"),
        (2, 0, "system", "alone"),
        (3, 0, "system", "s"),
        (3, 1, "assistant", ""),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("win", d0(spark)).withColumn("t", d0(spark)).withColumn("n", d0(spark))
    got = C.windows(d, 20, 10).orderBy("conv_id", "win").collect()
    assert [(r.conv_id, r.win, r.mask) for r in got] == [(1, 0, "1"), (1, 1, "000"), (3, 0, "01")]
    assert got[0].tokens == 50002 and got[0].text.count("x") == 50000
    assert C.windows(d.where("false")).count() == 0


def d0(spark):
    from pyspark.sql import functions as F

    return F.lit(7)
