import hashlib
from collections import Counter

from wayframe.llm import mixing as M


def brute(rows, weights, share, seed=M.SEED, default=1.0):
    units = Counter()
    for doc, text, source in rows:
        units[(source, doc)] += len((text or "").split())
    key = lambda d: hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    done, timed = Counter(), []
    none = lambda x: (x is not None, x or 0)
    for (source, doc), n in sorted(units.items(), key=lambda x: (key(x[0][1]), none(x[0][1]))):
        done[source] += n
        timed.append((done[source] / weights.get(source, default), (source is not None, source or ""), key(doc), none(doc), doc, source, n))
    budget, total, out = int(sum(units.values()) * share), 0, []
    for f, _, _, _, doc, source, n in sorted(timed, key=lambda x: x[:4]):
        total += n
        if total <= budget:
            out.append((doc, source, n, f, total))
    return out


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for share in (0.3, 0.9):
        got = [(r.doc_id, r.source, r.tokens, r.finish, r.total) for r in M.schedule(docs, budget_share=share).orderBy("total", "finish").collect()]
        assert sorted(got) == sorted(brute(rows, M.WEIGHTS, share))
    kept = {r.doc_id for r in M.mix(docs, budget_share=0.3).collect()}
    assert kept == {x[0] for x in brute(rows, M.WEIGHTS, 0.3)}


def test_shares_follow_weights(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = Counter(r.source for r in M.mix(d, weights={"a": 3.0, "b": 1.0}, budget=16000).collect())
    assert abs(n["a"] - 1200) <= 1 and abs(n["b"] - 400) <= 1


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    for share in (0.5, 1.0):
        got = [(r.doc_id, r.source, r.tokens, r.finish, r.total) for r in M.schedule(odd_docs, budget_share=share).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, M.WEIGHTS, share)))
    whole = M.mix(odd_docs, budget_share=1.0)
    assert whole.columns == odd_docs.columns and whole.count() == odd_docs.count()
    assert M.schedule(no_docs).count() == 0 and M.mix(no_docs).count() == 0
