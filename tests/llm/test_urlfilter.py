import datetime as dt

from wayframe.llm import urlfilter as U

T = dt.datetime


def test_as_of_lookup(spark, sf):
    entries = spark.createDataFrame(
        [
            ("a", "Bad.example", T(2024, 1, 1), True),
            ("a", "bad.example", T(2024, 2, 1), False),
            ("a", "bad.example", T(2024, 3, 1), True),
            ("b", "shop.example/sale", T(2024, 1, 1), True),
            ("b", "bad.example", T(2024, 1, 15), True),
            ("c", "tie.example", T(2024, 1, 1), True),
            ("c", "tie.example", T(2024, 1, 1), False),
            (None, "x.example", T(2024, 1, 1), True),
            ("d", None, T(2024, 1, 1), True),
            ("d", "x.example", None, True),
            ("d", "x.example", T(2024, 1, 1), None),
        ],
        "list string, pattern string, since timestamp_ntz, listed boolean",
    )
    long = "http://shop.example/sale/" + "a/" * 3000
    cases = [
        ("http://bad.example/", T(2023, 12, 31), None),
        ("http://bad.example/", T(2024, 1, 1), "a"),
        ("https://user:pw@www.BAD.example.:8080/x?y#z", T(2024, 1, 20), "a,b"),
        ("//bad.example", T(2024, 2, 1), "b"),
        ("http://bad.example", T(2024, 3, 1), "a,b"),
        ("http://notbad.example/", T(2024, 3, 1), None),
        ("http://shop.example/Sale/1", T(2024, 3, 1), "b"),
        ("http://shop.example/sales", T(2024, 3, 1), None),
        (long, T(2024, 3, 1), "b"),
        ("http://tie.example/", T(2024, 3, 1), "c"),
        ("http://x.example/", T(2024, 3, 1), None),
        ("no url", T(2024, 3, 1), None),
        ("", T(2024, 3, 1), None),
        (None, T(2024, 3, 1), None),
        ("http://bad.example/", None, None),
        ("http://bad.example/", T(2024, 3, 1), "a,b"),
        ("http://bad.example/", T(2024, 3, 1), "a,b"),
    ]
    rows = [(i if i % 5 else None, u, t) for i, (u, t, _) in enumerate(cases)]
    d = spark.createDataFrame(rows, "page_id long, url string, fetched timestamp_ntz").withColumn("key", U.F.lit("x")).withColumn("lists", U.F.lit("x")).withColumn("host", U.F.lit("x"))
    got = U.filter_urls(d, entries).collect()
    have = sorted((str(r.url), str(r.fetched), str(r.lists), r.blocked) for r in got)
    assert have == sorted((str(u), str(t), str(w), w is not None) for u, t, w in cases)
    assert U.filter_urls(d.where("false"), entries).count() == 0
    assert not any(r.blocked for r in U.filter_urls(d, entries.where("false")).collect())
