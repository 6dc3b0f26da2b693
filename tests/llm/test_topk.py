from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from panelcast.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string"


def brute(rows: list[tuple], k: int) -> list[tuple]:
    ok = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in set(ok):
        if i % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def rows(n: int) -> list[tuple]:
    r = random.Random(6)
    mids = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    out = [(i, [x + r.gauss(0, 0.2) for x in r.choice(mids)], 0, 1, "x") for i in range(n)]
    out += [(n + i, out[min(20, n - 1)][1], 0, 1, "x") for i in range(30)]
    return out + [(n + 100, None, 0, 1, "x"), (n + 101, [1.0] * 7 + [None], 0, 1, "x"), (n + 102, [math.nan] * 8, 0, 1, "x"), (n + 103, [math.inf] * 8, 0, 1, "x"), (None, [1.0] * 8, 0, 1, "x"), (n + 110, [0.5, -0.5], 0, 1, "x"), (n + 120, [0.0] * 8, 0, 1, "x"), (7, out[7][1], 0, 1, "x")] + [(23, out[min(20, n - 1)][1], 0, 1, "x")] * 30


def run(spark, data, k=10):
    df = spark.createDataFrame(data, SCHEMA)
    return sorted(tuple(x) for x in K.top_k(df, F.col("vec_id") % 10 == 0, k).collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 9)
    monkeypatch.setattr(K, "PACK", 7)
    monkeypatch.setattr(K, "SHARE", 4)
    monkeypatch.setattr(K, "PACKS", 2)
    data = rows(400)
    assert run(spark, data) == brute(data, 10)


def test_blocks_and_packs_are_bounded_under_skew(spark, monkeypatch):
    for name, n in (("BLOCK", 16), ("PACK", 8), ("SHARE", 8), ("PACKS", 2)):
        monkeypatch.setattr(K, name, n)
    r = random.Random(8)
    hot = [r.gauss(0, 1) for _ in range(8)]
    data = [(i, [x + r.choice((0, 0.001)) for x in hot] if i % 3 == 0 else [r.gauss(0, 1) for _ in range(8)], 0, 1, "x") for i in range(1500)]
    pack, most = K.pack, {}

    def spy(v, n, name, *more):
        out = pack(v, n, name, *more)
        most[name] = out.agg(F.max(F.length("ids"))).first()[0] / 8 / n
        assert out.groupBy(name, "dim").count().where("count > 1").count() == 0
        return out

    monkeypatch.setattr(K, "pack", spy)
    assert run(spark, data) == brute(data, 10)
    assert max(most.values()) <= 6, most


def test_few_candidates_and_empty(spark):
    data = rows(15)[:15]
    assert run(spark, data, 30) == brute(data, 30)
    assert run(spark, []) == []
    assert run(spark, data[:1]) == []


def test_blocks_are_pruned():
    r = np.random.default_rng(0)
    mids = r.normal(0, 1000, (20, 16)).astype(np.int64)
    blocks = [(np.arange(50) + 100 * b, m, m.max(0), m.min(0), b, np.ones(50, np.int64)) for b in range(20) for m in [mids[b] + r.integers(-50, 50, (50, 16))]]
    best, scored = K.search_share(np.array([-1]), mids[:1], np.array([K.LOWEST]), blocks, 10)
    every = np.concatenate([x[1] for x in blocks]) @ mids[0]
    assert sorted(best[-1][0].tolist()) == sorted(every)[-10:] and scored < 10
