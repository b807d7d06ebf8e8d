import random
import re
import time

import numpy as np
import pyarrow as pa

from wayframe.llm import simhash as S
from wayframe.llm import textkernel as K


def brute_print(text):
    """Both halves of the fingerprint; None if there are no words."""
    words = {w for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", K.fold(np.frombuffer(text.encode(), np.uint8)).tobytes())}
    if not words:
        return None
    out = []
    for salt in (np.uint64(0), K.salt(77)):
        acc = [0] * 64
        for w in words:
            b = np.frombuffer(w, np.uint8)
            h = int(K.mix((K.span_hashes(b, np.array([0]), np.array([len(b)])) >> np.uint64(20)) + salt)[0])
            acc = [x + (h >> i & 1) for i, x in enumerate(acc)]
        out.append(sum(1 << i for i, x in enumerate(acc) if x * 2 > len(words)))
    return tuple(out)


def shown(p):
    return None if p is None else f"{p[0]:016x}{p[1]:016x}"


def linked(p, q):
    d = [(x ^ y).bit_count() for x, y in zip(p, q)]
    return min(d) <= S.RADIUS and sum(d) <= S.WIDE


def test_fingerprint_matches_brute_force(monkeypatch):
    texts = ["a b c d e", "A b c, d e!", "", "été Ñandú 12", "x " * 5000 + "y z", None, " ".join(f"w{i % 700}" for i in range(3000))]
    for limit in (K.SLICE_BYTES, 64):
        monkeypatch.setattr(K, "SLICE_BYTES", limit)
        one, two, n = S.fingerprints(pa.array(texts))
        for t, f, g, m in zip(texts, one.tolist(), two.tolist(), n):
            want = brute_print(t or "")
            assert (want is None and m == 0) or want == (f, g)


def test_a_long_text_stays_small(monkeypatch):
    """100 MB of one text: what the kernel holds besides the text is a small part of it."""
    import tracemalloc

    text = pa.array(["".join(f"word{i} " for i in range(20_000)) * 500], pa.large_string())
    size = len(text[0].as_py())
    assert size > 90 << 20
    K._table("p", 5 << 20), K._table("q", 5 << 20)
    tracemalloc.start()
    _, _, n = S.fingerprints(text)
    assert n[0] == 20_000 and tracemalloc.get_traced_memory()[1] < 4 * size
    tracemalloc.stop()


def test_forest_finds_every_pair():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for i in range(300):
        h = np.append(h, h[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 12), False))))
    h = np.unique(h)
    shard = np.sort(rng.integers(0, 3, len(h)))
    want = {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if shard[i] == shard[j] and bin(int(h[i] ^ h[j])).count("1") <= 8}
    got = set()
    for a, b in S.Forest(shard, h).pairs(8, 50):
        got |= set(zip(a.tolist(), b.tolist()))
    assert got == want and want


def test_large_shards_take_little_time():
    """40 million pairs, which share 13 bits as those of a shard do: 0.08 CPU seconds when written, 11 with trees of all levels."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) & ~np.uint64((1 << 13) - 1)
    h[1::2000] = h[::2000] ^ np.uint64(255 << 20)
    began = time.process_time()
    got = [p for a, b in S.Forest(np.arange(40_000) // 2000, h).pairs(8) for p in zip(a.tolist(), b.tolist())]
    assert time.process_time() - began < 2
    assert len(got) == len(set(got)) and {(i, i + 1) for i in range(0, 40_000, 2000)} <= set(got)


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choices(vocab, k=120)) for _ in range(40)]
    for i in range(30):
        w = texts[i // 2].split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "changed" + str(i)
        texts.append(" ".join(w))
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.near_duplicates(d).collect()}
    fps = {i: brute_print(t) for i, t in rows}
    lead = {i: i for i in fps}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and linked(fps[a], fps[b]):
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    different = set(fps.values())
    assert all(got[i].links == sum(p != fps[i] and linked(p, fps[i]) for p in different) for i in fps)
    assert {r.links for r in got.values()} > {0, 1}
    # blocks change the work, not the result
    assert {i: (r.group_id, r.links) for i, r in got.items()} == {r.doc_id: (r.group_id, r.links) for r in S.near_duplicates(d, blocks=11).collect()}
    assert all(got[i].fingerprint == shown(fps[i]) and got[i].group_id == find(i) and got[i].kept == (find(i) == i) for i in fps)
    assert len({r.group_id for r in got.values()}) < len(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    got = S.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.kept and r.group_id is None for r in by[None])
    assert sum(r.kept for r in by[1]) == 1 and by[2][0].fingerprint is None and by[2][0].kept
    assert by[4][0].group_id == by[5][0].group_id == 4
    kept = S.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(x.doc_id or 0 for x in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7]
    assert S.near_duplicates(no_docs).count() == 0 and S.drop_near_duplicates(no_docs).count() == 0


def test_repeated_ids_lose_no_group(spark):
    x, y = ("alpha beta gamma delta epsilon", "red green blue yellow purple orange")
    x, y = sorted((x, y), key=lambda t: np.array(brute_print(t), np.uint64).view(np.int64).tolist())
    d = spark.createDataFrame([(3, x), (5, x), (5, y), (7, y), (9, ""), (9, x + " " + y)], "doc_id long, text string")
    kept = {(r.doc_id, r.fingerprint) for r in S.near_duplicates(d).collect() if r.kept}
    assert kept == {(3, shown(brute_print(x))), (5, shown(brute_print(y))), (9, shown(brute_print(x + " " + y)))}
    assert sorted((r.doc_id, r.text) for r in S.drop_near_duplicates(d).collect()) == sorted([(3, x), (5, y), (9, x + " " + y)])
