import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wayframe.llm import ngramlm as N
from wayframe.llm import textkernel as K


def rows_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [(900, ""), (901, None), (None, "the the the"), (902, " \n")]


def folded(t):
    return "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in t)


def brute(rows, level=N.level, count=N.count_of):
    q = lambda c: float(count(level(np.array([c])))[0]) if c else 0.0
    tokens = [[w for w in folded(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w] for _, t in rows]
    uni, bi = Counter(), Counter()
    for ws in tokens:
        uni.update(ws)
        bi.update(zip([None] + ws, ws))
        uni[None] += bool(ws)
    total = sum(map(len, tokens))
    out = []
    for ws in tokens:
        lp = 0.0
        for a, b in zip([None] + ws, ws):
            ratio = min(max(q(bi[a, b]) - N.DISCOUNT, 0) / q(uni[a]), 1.0)
            lp += math.log(N.MIX * ratio + (1 - N.MIX) * min((q(uni[b]) + 1) / (total + 1), 1.0))
        out.append((len(ws), lp))
    return out


def test_close_to_exact_counts(spark, sf):
    rows = rows_of(spark, sf)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.score(d).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    a = sorted((-1 if r.doc_id is None else r.doc_id, r.tokens, r.log_prob) for r in got)
    b = sorted((i if i is not None else -1, n, lp) for (i, _), (n, lp) in zip(rows, want))
    for x, y in zip(a, b):
        # the filter only errs towards higher counts, and seldom
        assert x[:2] == y[:2] and abs(x[2] - y[2]) <= 0.06 * x[1] + 1
    tokens = sum(x[1] for x in a)
    assert abs(sum(x[2] for x in a) - sum(y[2] for y in b)) / tokens < 0.03
    assert all((r.perplexity is None) == (r.tokens == 0) for r in got)
    # n-grams that travel to the parts of the filter get the same scores
    parts = N.score(d, broadcast_bytes=0).collect()
    b = sorted((-1 if r.doc_id is None else r.doc_id, r.tokens, r.log_prob) for r in parts)
    assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b])


def test_levels_come_back():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    counts = rng.geometric(0.3, 20000)
    part = N.part_of(keys, 8)
    f = N.Filter(*N.joined(((int(p), N.build_part(keys[part == p], counts[part == p]).tobytes()) for p in np.unique(part)), 8))
    got, want = f.levels(keys).astype(int), N.level(counts)
    assert (got >= want).all() and (got == want).mean() > 0.97
    other = f.levels(rng.integers(0, 1 << 63, 20000, dtype=np.uint64))
    assert (other > 0).mean() < 0.02
    assert [int(x) for x in N.level(np.array([1, 2, 3, 4]))] == [0, 1, 2, 3] and N.count_of(np.array([0, 1, 2])).tolist() == [1, 2, 3]


def test_a_text_in_pieces_has_the_same_ngrams(monkeypatch):
    rng = np.random.default_rng(5)
    texts = pa.array(["one two", " ".join(f"w{x}" for x in rng.integers(0, 90, 4000)), "", "x" * 3000 + " y"])
    buf, offs = K.raw(texts)

    def found():
        got = [(np.asarray(row) + lo, u, b, p) for lo, _, row, u, b, p in N.all_ngrams(buf, offs)]
        return [np.concatenate(x).tolist() for x in zip(*got)]

    whole = found()
    monkeypatch.setattr(K, "SLICE_BYTES", 100)
    assert found() == whole


def shuffled(spark):
    """Rows that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}


def test_ngrams_travel_in_few_rows(spark, sf):
    """A row for each block and part, not for each n-gram, which took too long on large tables."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    before = shuffled(spark)
    got = N.score(d, broadcast_bytes=0).collect()
    rows = sum(n for k, n in shuffled(spark).items() if k not in before)
    assert len(got) == d.count() and 0 < rows < 3 * len(got) < sum(r.tokens for r in got) / 10


def test_lumps_and_pieces_get_the_same_scores(monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["one two", " ".join(f"w{x}" for x in rng.zipf(1.3, 6000) % 900), "", " \n", "one two", "x" * 3000 + " y"] + [" ".join(f"w{x}" for x in rng.zipf(1.3, 50) % 900) for _ in range(40)]
    total = sum(len(t.split()) for t in texts)

    def scored():
        blocks = [pa.table({"doc_id": list(range(a, len(texts), 2)), "text": texts[a::2], "h": [hash(t) for t in texts[a::2]], "block": [a] * len(texts[a::2])}) for a in (0, 1)]
        asked = pa.concat_tables([N._ask(8)(b) for b in blocks])
        answers = pa.Table.from_batches(N._answer(8)(iter(asked.to_batches())))
        names = ["doc_id", "tokens", "log_prob", "perplexity"]
        rows = pa.concat_tables([N._finish(total, names)(b, answers.filter(pa.array(answers["block"].to_numpy() == a))) for a, b in enumerate(blocks)])
        return asked.num_rows, sorted((r["doc_id"], r["tokens"], r["log_prob"]) for r in rows.to_pylist())

    few, whole = scored()
    want = brute(list(enumerate(texts)))
    assert [x[1] for x in whole] == [n for n, _ in want]
    assert all(abs(x[2] - lp) <= 0.06 * n + 1 for x, (n, lp) in zip(whole, want))
    monkeypatch.setattr(K, "SLICE_BYTES", 100)
    monkeypatch.setattr(N, "LUMP_TOKENS", 700)
    many, cut = scored()
    assert many > few and [x[:2] for x in cut] == [x[:2] for x in whole]
    assert [x[2] for x in cut] == pytest.approx([x[2] for x in whole])


def test_sorting_is_exact():
    rng = np.random.default_rng(9)
    for top, n in ((12, 5000), (40, 30_000), (63, 30_000), (63, 0), (63, 1)):
        x = rng.integers(0, 1 << top, n, dtype=np.uint64)
        at, out = N.sorting(x)
        assert (out == np.sort(x)).all() and (x[at] == out).all() and (np.sort(at) == np.arange(n)).all()


def test_a_text_that_occurs_twice_stands_out(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, 200) % 5000) for _ in range(120)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i]) for i in range(20)]
    got = {r.doc_id: r.perplexity for r in N.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == got[1000 + i] for i in range(20))
    assert np.quantile([got[i] for i in range(20)], 0.9) < np.quantile([got[i] for i in range(20, 120)], 0.1)


def test_odd_rows(spark, odd_docs, no_docs):
    got = N.score(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r.log_prob) for r in got)
    assert N.score(no_docs).count() == 0
