from __future__ import annotations

import hashlib

from panelcast.llm import warc as W

SCHEMA = "page_id long, url string, html string, key string, file string"


def brute(rows: list[tuple]) -> list[tuple]:
    out, seen = [], set()
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        same = [j for j, _, g, *_ in rows if (g or "") == (h or "") and j is not None]
        first = min(same, default=None)
        rev = len(p) >= 100 and i is not None and (first < i or (i, p) in seen)
        seen.add((i, p))
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if rev else "response", first if rev else None))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "k", "f") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in W.archive_round_trip(df).collect()), key=str)


def test_url_keys():
    assert W.url_key("https://user@Blog.Example.com:443/a b?q=1#top") == "com,example,blog)/a%20b?q=1"
    assert W.url_key("http://a.org:8080") == "org,a:8080)/"
    assert W.url_key(None) == ")" and W.url_key("no url") == ")no%20url"


def test_round_trip_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 7)
    page = "<p>é" + "x" * 120 + "</p>"
    rows = [(i, f"http://h{i % 5}.example.org/p{i % 17}?q\t{i % 3}", page + str(i % 9) if i % 4 else f"short {i % 2}") for i in range(150)]
    rows += [(500, None, None), (501, "", ""), (502, "x", "y" * 99), (503, "x", "y" * 99), (None, "http://a.org/", page + "1"), (504, "http://a.org/\r\nX: 1", page + "1"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (505, "http://a.org/", "\r\n\r\n" * 100_000), (506, "http://a.org/", "\r\n\r\n" * 100_000)]
    assert run(spark, rows) == brute(rows)


def test_many_captures_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 3)
    monkeypatch.setattr(W, "SHARD_LINES", 8)
    rows = [(7, "http://a.org/", "z" * 200)] * 40 + [(8, "http://a.org/", "z" * 200)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
