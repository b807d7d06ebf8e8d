import random

import numpy as np
import pyarrow as pa

from wayframe.llm import chunkprint as C
from wayframe.llm import textkernel as K


def brute_chunks(t):
    b, out, at = t.encode(), [], 0
    g = C.gear_table().tolist()
    while at < len(b):
        end = min(len(b), at + C.MOST)
        for i in range(at + C.LEAST - 1, end):
            # the hash of the 32 bytes that end at i
            h = sum(g[b[i - k]] << k for k in range(min(32, i + 1))) & 0xFFFFFFFF
            bits = C.STRICT_BITS if i + 1 - at < C.USUAL else C.LOOSE_BITS
            if h >> (32 - bits) == 0:
                end = i + 1
                break
        out.append((at, end))
        at = end
    return out


def code(b):
    x = np.frombuffer(b, np.uint8)
    h = int(K.span_hashes(x, np.array([0]), np.array([len(x)]))[0])
    return int(np.array([(h & ~C.SIZE_MASK) | len(b)], np.uint64).view(np.int64)[0])


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijé", k=rng.randint(2, 9)))
    out = [" ".join(word() for _ in range(rng.choice([5, 100, 700]))) for _ in range(24)]
    out += [out[i][:k] + "inserted words " + out[i][k:] for i, k in ((1, 0), (2, 900), (4, 2000), (5, 300))]
    out += [out[3], out[3], out[6] + out[7] + out[8], "", "x" * 5000]
    return out


def test_boundaries_match_brute_force():
    ts = texts()
    buf, offs = K.raw(pa.array(ts))
    # hashes start afresh in each document only as far as the shortest chunk covers their window
    assert C.LEAST >= 32
    r, s, e = C.boundaries(buf, offs)
    for i, t in enumerate(ts):
        assert list(zip((s[r == i] - offs[i]).tolist(), (e[r == i] - offs[i]).tolist())) == brute_chunks(t)


def test_containment_matches_brute_force(spark):
    ts = texts()
    sets = {i: {code(t.encode()[a:b]) for a, b in brute_chunks(t)} for i, t in enumerate(ts)}
    w = lambda s: sum(c & C.SIZE_MASK for c in s)
    d = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    lead = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    for t in (0.3, 0.5, 1.0):
        want = {(i, lead[i], w(sets[i])) for i in sets if sets[i] and lead[i] != i}
        for a in set(lead.values()):
            for b in set(lead.values()):
                both = w(sets[a] & sets[b])
                if a != b and sets[a] and both >= t * w(sets[a]):
                    want.add((a, b, both))
        got = {(r.doc_id, r.other_id, r.shared): r.containment for r in C.containment(d, t).collect()}
        assert set(got) == want and all(abs(c - k[2] / w(sets[k[0]])) < 1e-12 for k, c in got.items())


def test_odd_rows(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.other_id) for r in C.containment(odd_docs).collect()}
    assert {(4, 5), (5, 4)} <= got and all(a != b and a is not None for a, b in got)
    assert C.containment(no_docs).count() == 0 and C.links(no_docs).count() == 0
    got = C.links(odd_docs).collect()
    assert len(got) == odd_docs.where("doc_id is not null").count()
    assert {(r.doc_id, r.copies, r.links, r.other_id) for r in got if r.doc_id in (2, 3, 4, 5)} == {(2, 0, 0, None), (3, 0, 0, None), (4, 0, 1, 5), (5, 0, 1, 4)}


def test_finds_near_copies_with_scattered_edits(spark):
    """Recall against the Jaccard index of 3-word shingles, which knows nothing of chunks."""
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(2000)]
    rows, pairs = [], {}
    shingles = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    for i in range(120):
        w = rng.choices(vocab, k=250)
        v = [rng.choice(vocab) if rng.random() < (0.02, 0.035, 0.055)[i % 3] else x for x in w]
        a, b = shingles(w), shingles(v)
        pairs[2 * i, 2 * i + 1] = len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = {tuple(sorted((r.doc_id, r.other_id))) for r in C.containment(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= set(pairs)
    for lo, hi, least in ((0.8, 1, 0.95), (0.7, 0.8, 0.8)):
        want = [p for p, j in pairs.items() if lo <= j < hi]
        assert len(want) >= 20 and sum(p in got for p in want) >= least * len(want), (lo, len(want), sum(p in got for p in want))


def test_every_row_has_its_partners(spark):
    ts = texts()
    rows = list(enumerate(ts)) + [(40 + i, ts[k]) for i, k in enumerate((1, 3, 6, 24, 27))] + [(5, ts[1]), (50, ts[5])]
    print_of = lambda t: {code(t.encode()[a:b]) for a, b in brute_chunks(t)}
    sets = [(i, print_of(t)) for i, t in rows if t]
    w = lambda s: sum(c & C.SIZE_MASK for c in s)
    want = {}
    for i, a in sets:
        for j, b in sets:
            if i != j and w(a & b) >= 0.5 * w(a):
                want[i, j] = max(want.get((i, j), 0), w(a & b) / w(a))
    got = {(r.doc_id, r.other_id): r.containment for r in C.partners(C.containment(spark.createDataFrame(rows, "doc_id long, text string"), 0.5)).collect()}
    assert (40, 43) in got and set(got) == set(want) and all(abs(got[p] - c) < 1e-12 for p, c in want.items())


def test_links_match_brute_force(spark):
    """Whatever counts as hot: every link of every row, copies and shared passages included."""
    rng = random.Random(3)
    ts = texts()
    passage = [" ".join("".join(rng.choices("klmnopqr", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(3)]
    own = lambda n: " ".join("".join(rng.choices("stuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
    ts += [own(k) + " " + passage[i % 3] + (" " + passage[0] if i % 4 == 0 else "") for i, k in enumerate([3, 9, 40, 200, 5, 30] * 4)]
    ts += [ts[40], ts[40], ts[41] + " and a little more"]
    rows = list(enumerate(ts)) + [(5, ts[1]), (1000, "")]
    sets = [(i, frozenset(code(t.encode()[a:b]) for a, b in brute_chunks(t))) for i, t in rows]
    w = lambda s: sum(c & C.SIZE_MASK for c in s)
    d = spark.createDataFrame(rows + [(None, ts[1])], "doc_id long, text string")
    for t, hot in ((0.3, 50), (0.3, 1), (0.3, 3), (0.8, 3), (1.0, 2)):
        want = []
        for i, s in sets:
            same = [j for j, x in sets if x == s] if s else []
            held = [(w(s & x), j) for j, x in sets if s and x != s and w(s & x) >= t * w(s)]
            want.append((i, min(same, default=None), max(len(same) - 1, 0), len(held), max(held)[0] / w(s) if held else None))
        got = C.links(d, t, hot=hot).collect()
        key = lambda r: (r[0], -1 if r[1] is None else r[1])
        assert [tuple(r)[:4] + (r.containment,) for r in sorted(got, key=key)] == sorted(want, key=key), (t, hot)
        leads = {i: s for i, s in sets}
        for r in got:
            if r.other_id is not None and r.doc_id != 5 and r.other_id != 5:
                assert w(leads[r.doc_id] & leads[r.other_id]) / w(leads[r.doc_id]) == r.containment
    assert sum(r[3] for r in want)
