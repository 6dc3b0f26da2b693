from __future__ import annotations

import hashlib
import math
import random
import re

from panelcast.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, u double"


def uniform(s: str) -> float:
    return (int(hashlib.md5(s.encode()).hexdigest()[:12], 16) + 0.5) / 2**48


def brute(rows: list[tuple]) -> list[tuple]:
    docs = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s, hashlib.md5((t or "").encode()).hexdigest()) for i, t, _, s, *_ in rows]
    names = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(names)}
    size = {s: sum(d[1] for d in docs if d[2] == s) for s in names}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * size[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        free -= full
    out = []
    for s in names:
        own = [d for d in docs if d[2] == s]
        ratio = target[s] / size[s] if size[s] else 0.0
        whole, f = math.floor(ratio), ratio - math.floor(ratio)
        missing = target[s] - whole * size[s]
        mid = sum(d[1] * math.log1p(d[1]) for d in own) / size[s] if size[s] else 0
        width = max([abs(math.log1p(d[1]) - mid) for d in own])
        ranked = []
        for d in own:
            p = f + 0.5 * min(f, 1 - f) * ((math.log1p(d[1]) - mid) / width if width and size[s] else 0)
            p, u = max(p, 1e-12), uniform(f"{M.SEED}|{'' if d[0] is None else d[0]}|{d[3]}")
            ranked.append(((u / (1 - u)) / (p / max(1 - p, 1e-12)), d[0] if d[0] is not None else -1, d[1], d[3], d))
        cum = 0
        for *_, d in sorted(ranked, key=lambda x: x[:4]):
            extra = int(cum + d[1] / 2 <= missing)
            cum += d[1]
            out.append((d[0], d[1], size[s], round(target[s], 6), min(whole + extra, 3) * d[1]))
    return sorted(out, key=str)


def rows(n: int = 900) -> list[tuple]:
    r = random.Random(8)
    out = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 30, 200]))), "en", r.choice(["a", "a", "a", "b", "c", "dé", "e", None]), 0.5) for i in range(n)]
    return out + [(n, None, None, "z", 0.1), (n + 1, "x\x0by\x1cz w", "en", "q", 0.1), (n + 2, "v " * 40_000, "en", "a", 0.1), (5, out[5][1], "en", out[5][3], 0.1), (None, "one two", "en", "b", 0.1)]


def query(df):
    return df.select("doc_id", "size", "source_size", "target", (df["copies"] * df["size"]).alias("taken"))


def test_equals_brute_force(spark):
    data = rows()
    got = [tuple(x) for x in query(M.with_copies(spark.createDataFrame(data, SCHEMA))).collect()]
    assert sorted(((a, b, c, round(t, 6), k) for a, b, c, t, k in got), key=str) == brute(data)
    again = [tuple(x) for x in query(M.with_copies(spark.createDataFrame(data[::-1], SCHEMA).repartition(7))).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)


def test_sources_come_near_their_targets(spark):
    got = M.with_copies(spark.createDataFrame(rows(3000)[:3000], SCHEMA)).groupBy("source").agg({"target": "first", "size": "max"}).collect()
    taken = {r["source"]: r["t"] for r in query_sum(M.with_copies(spark.createDataFrame(rows(3000)[:3000], SCHEMA)))}
    for r in got:
        assert abs(taken[r["source"]] - r["first(target)"]) <= r["max(size)"] / 2


def query_sum(df):
    from pyspark.sql import functions as F

    return df.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()


def test_empty_and_wordless(spark):
    assert M.with_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    got = M.with_copies(spark.createDataFrame([(1, None, None, "a", 0.0), (2, " ", None, None, 0.0)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in got] == [(0, 0.0, 0)] * 2
