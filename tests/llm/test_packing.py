from collections import defaultdict

import numpy as np

from wayframe.llm import packing as P


def test_plan_is_tight_and_never_overflows():
    rng = np.random.default_rng(7)
    for n, cap in ((1, 64), (9, 64), (400, 64), (5000, 512), (60000, 2048)):
        sizes = np.clip(rng.lognormal(np.log(cap / 5), 1, n).astype(int), 1, cap)
        first, per, to = P.plan(np.bincount(sizes, minlength=cap + 1), cap)
        at = np.searchsorted(first, np.arange(n), side="right") - 1
        bins = to[at] + (np.arange(n) - first[at]) // per[at]
        load = np.bincount(bins, np.sort(sizes)[::-1])
        assert load.max() <= cap and load.min() > 0
        ffd = []
        for s in np.sort(sizes)[::-1][:5000]:
            i = next((i for i, x in enumerate(ffd) if x + s <= cap), None)
            ffd.append(s) if i is None else ffd.__setitem__(i, ffd[i] + s)
        if n <= 5000:
            assert len(load) <= len(ffd) * 1.08 + 2


def check(rows, texts, cap):
    bins, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        if r.bin is None:
            assert r.tokens == 0 and r.start is None and r.piece is None
        else:
            bins[r.bin].append((r.start, r.tokens))
        parts[r.doc_id].append(r.tokens)
    for b in bins.values():
        at = 0
        for start, n in sorted(b):
            assert start == at
            at += n
        assert at <= cap
    want = defaultdict(list)
    for i, t in texts:
        n = len((t or "").split())
        want[i] += [cap] * (n // cap) + ([n % cap] if n % cap or not n else [])
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    return len(bins)


def test_every_document_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    total = sum(len(t.split()) for _, t in texts)
    for cap in (256, 2048):
        n = check(P.pack(docs, cap).collect(), texts, cap)
        assert n <= total / cap * 1.06 + 2


def test_odd_rows(spark, odd_docs, no_docs):
    check(P.pack(odd_docs, 64).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 64)
    assert P.pack(no_docs).count() == 0


def fewest(sizes, capacity):
    """The least number of bins, by trying every placement."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                place(i + 1, rooms[:j] + [rooms[j] - sizes[i]] + rooms[j + 1 :])
        place(i + 1, rooms + [capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_bins_against_the_exhaustive_optimum(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 3)
    rng = np.random.default_rng(8)
    for n in (1, 6, 9, 10):
        sizes = sorted(rng.integers(1, 20, n).tolist(), reverse=True)
        d = spark.createDataFrame([(i, "w " * s) for i, s in enumerate(sizes)], "doc_id long, text string")
        rows = P.pack(d, capacity=24).collect()
        assert sorted(r.tokens for r in rows) == sorted(sizes)
        assert fewest(sizes, 24) <= len({r.bin for r in rows}) <= fewest(sizes, 24) + 1
