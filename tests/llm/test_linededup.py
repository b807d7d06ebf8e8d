import random

import numpy as np

from wayframe.llm import linededup as L
from wayframe.llm import textkernel as K


def brute_lines(t):
    b, out, at = t.encode(), [], 0
    for i in range(1, len(b) + 1):
        if b[i - 1 : i] == b"\n" or (i > 1 and b[i - 1 : i] == b" " and b[i - 2 : i - 1] in (b".", b"!", b"?")) or i == len(b):
            out.append((at, i))
            at = i
    return [x for x in out if x[0] < x[1]]


def brute_chunks(t, seeds=L.SEEDS):
    b, ls, got = t.encode(), brute_lines(t), set()
    ends = []
    for s, e in ls:
        z = e
        for _ in range(2):
            if z > s and b[z - 1] in b" \t\r\n":
                z -= 1
        ends.append(z)
    one = lambda x: K.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))
    hs = [one(b[s : ends[i]]) for i, (s, _) in enumerate(ls)]
    for seed in range(seeds):
        a = 0
        for i, (s, e) in enumerate(ls):
            run = np.concatenate(hs[max(0, i - L.ROLL + 1) : i + 1])
            h = K.sequence_hashes(run, np.array([0]), np.array([len(run)]))
            cut = i == len(ls) - 1 or int(K.mix(h + K.salt(seed + 1))[0]) & 1 == 0
            if cut:
                if i - a + 1 >= L.MIN_LINES and ends[i] - ls[a][0] >= L.MIN_BYTES:
                    got.add((ls[a][0], ends[i], tuple(b[ls[j][0] : ends[j]] for j in range(a, i + 1))))
                a = i + 1
    return sorted(got)


def brute_dedup(rows):
    """rows: distinct (id, text) pairs."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        gone = np.zeros(len(t.encode()), bool)
        for s, e, x in brute_chunks(t):
            if x in seen:
                gone[s:e] = True
            else:
                seen[x] = (i, s)
        b = np.frombuffer(t.encode(), np.uint8)
        out[i] = (b[~gone].tobytes().decode().lstrip(" ") if gone.any() else t, int(gone.any()))
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgéñ", k=rng.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(4, 12))) + rng.choice([".", "!", "?", "."])
    shared = [" ".join(sentence() for _ in range(9)) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = ["\n".join(" ".join(sentence() for _ in range(4)) for _ in range(3)), "\n".join(" ".join(sentence() for _ in range(4)) for _ in range(2))]
        if i % 3 == 0:
            parts.insert(1, word() + " " + shared[i % 9 // 3] + " ")
        rows.append((i, "".join(parts)))
    return rows, shared


def test_lines_and_chunks_match_brute_force():
    for t in ["", "a", "One. Two! Three\nfour\n\nfive.", "x\n" * 40, "é. ñ. " * 30] + [t for _, t in corpus()[0][:10]]:
        buf = np.frombuffer(t.encode(), np.uint8)
        offs = np.array([0, len(buf)])
        s, e = L.lines(buf, offs)
        assert list(zip(s.tolist(), e.tolist())) == brute_lines(t)
        _, _, p, q = L.chunks(buf, offs)
        assert sorted(zip(p.tolist(), q.tolist())) == [x[:2] for x in brute_chunks(t)]


def test_removal_matches_brute_force(spark):
    rows, shared = corpus()
    got = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_dedup(rows)
    assert {i: r.text for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all((r.removed > 0) == bool(want[i][1]) for i, r in got.items())
    # passages stay in one document, and nothing else is touched
    assert all(sum(p in r.text for r in got.values()) == 1 for p in shared)
    assert all(got[i].text == t for i, t in rows if i % 3)


def test_copies_empty_and_extra_columns(spark, odd_docs, no_docs):
    out = L.remove_repeats(odd_docs)
    assert out.columns == odd_docs.columns + ["__removed"] and out.count() == odd_docs.count()
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].text is None and by[2][0].text == "" and by[4][0]["__removed"] == 0
    assert len(by[5][0].text) < len(by[4][0].text) / 2
    c = L.clean(odd_docs)
    assert c.columns == odd_docs.columns
    assert L.dedup_lines(no_docs).count() == 0 and L.clean(no_docs).count() == 0
    t = "\n".join(f"Line number {i} of a text that two documents have in full." for i in range(40))
    d = spark.createDataFrame([(1, t, "x"), (2, t, "x")], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in L.clean(d).collect()}
    assert got[1] == t and len(got.get(2, "")) < len(t) / 5


def test_clashing_names_and_repeats_over_batches(spark):
    names = ["__k", "__c", "__c_k", "__r", "__r_k", "__new", "__removed", "k", "i", "cand", "id", "at", "digest", "salt", "more"]
    t = "A first line that is long enough to count here.\nA second line that is long enough too."
    rows = [(i, t if i % 2 else t + f"\nand the end of number {i}") for i in range(40)] + [(None, t), (3, t)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted((r.doc_id or -1, r.text) for r in L.remove_repeats(d, every=True).collect())
    assert sum(t in x for _, x in plain) == 1 and len(plain) == len(rows)
    for n in names:
        d = d.withColumn(n, d["doc_id"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = L.remove_repeats(d.repartition(5), every=True)
        got = out.collect()
        assert out.columns == [c for c in d.columns if c != "__removed"] + ["__removed"]
        assert sorted((r.doc_id or -1, r.text) for r in got) == plain
        assert all(r[n] == r.doc_id for r in got for n in names if n != "__removed")
        assert L.clean(d).columns == d.columns
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hashes_of_long_spans(monkeypatch):
    b = np.frombuffer(b"one two three four five six seven" * 40, np.uint8)
    s, e = np.array([0, 10, 40, 700]), np.array([10, 30, 700, 1000])
    want = K.span_hashes(b, s, e).tolist()
    monkeypatch.setattr(K, "SLICE_BYTES", 25)
    assert K.span_hashes(b, s, e).tolist() == want


def surviving(rows):
    """Documents that hold a run of 50 words, 25 of them different, that an earlier one has."""
    seen, n = set(), 0
    for _, t in sorted((i, t) for i, t in rows if t):
        w = t.split()
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        n += any(x in seen and len(set(x)) >= 25 for x in runs)
        seen.update(runs)
    return n


def test_aligned_passages_go_whole(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    shared = [[sentence(k) for k in n] for n in ((8, 9), (30, 30), (55,), (9, 7, 8), (20, 2, 2), (1, 1, 18)) for _ in range(8)]
    rows = []
    for i, p in enumerate(shared):
        for j in (0, 100):
            rows.append((i + j, " ".join([sentence(10), *p, sentence(12)])))
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), every=True).collect()}
    for i, p in enumerate(shared):
        assert got[i] == rows[2 * i][1] and not any(x in got[100 + i] for x in p), (i, p)
        assert got[100 + i].count(".") == 2
    # a whole table, against what the chunkings leave
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before, chunked, now = (surviving([(r.doc_id, r.text) for r in x.collect()]) for x in (d, L.remove_repeats(d), L.remove_repeats(d, every=True)))
    assert now < chunked < before and now <= 0.1 * before, (before, chunked, now)
