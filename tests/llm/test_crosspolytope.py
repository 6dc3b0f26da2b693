from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from panelcast.llm import crosspolytope as C

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows: list[tuple], k: int) -> dict[int, list[tuple]]:
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i in {i for i, _ in ok if i % 20 == 0}:
        (q,) = [v for j, v in ok if j == i]
        s = sorted((-float((q * v).sum()), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out[i] = [(j, -x) for x, j in s]
    return {i: v for i, v in out.items() if v}


def run(spark, rows, k=20):
    out = {}
    for q, r, v, s in C.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(q, []).append((v, s))
        assert len(out[q]) == r
    return out


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def rows(n: int, dim: int = 24) -> list[tuple]:
    r = random.Random(2)
    mids = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    out = [(i, [x + r.gauss(0, 0.5) for x in r.choice(mids)], "x", 1) for i in range(n)]
    out = [(i, [x * 3 for x in v] if i % 7 == 0 else v, *z) for i, v, *z in out]  # other norms, other bands
    return out + [(10_000, None, "x", 1), (10_020, [0.0] * dim, "x", 1), (10_040, [math.nan] * dim, "x", 1), (10_060, [1.0] * (dim - 1) + [None], "x", 1), (None, [1.0] * dim, "x", 1), (10_080, [math.inf] * dim, "x", 1)]


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(C, "GROUP", 100)
    monkeypatch.setattr(C, "CELL", 2)  # two rotations a cell
    data = rows(3000)
    got, want = run(spark, data), brute(data, 20)
    assert recall(got, want) >= 0.9
    vec = {i: np.array(v, np.float32).astype(float) for i, v, *_ in data[:3000]}
    for q, found in got.items():
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
        assert all(abs(s - float((vec[q] * vec[v]).sum())) < 1e-9 for v, s in found)


def test_recall_of_scattered_vectors_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(C, "GROUP", 256)
    r = np.random.default_rng(4)
    x = r.normal(size=(2400, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    data = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)]
    assert recall(run(spark, data), brute(data, 20)) >= 0.93  # of all cells, those of negative axes too


def test_copies_ties_and_other_dimensions(spark, monkeypatch):
    monkeypatch.setattr(C, "GROUP", 50)
    hot = [1.0, 2.0, -1.0, 0.5]
    data = [(i, hot, "x", 1) for i in range(0, 400)] + [(i, [float(i % 5), 1.0, 0.0, float(i % 3)], "x", 1) for i in range(400, 700)] + [(800 + i, [float(i), 1.0], "x", 1) for i in range(4)]
    got, want = run(spark, data), brute(data, 20)
    assert got[0] == want[0] and got[380] == want[380]
    assert {q: v for q, v in got.items() if q >= 800} == {q: v for q, v in want.items() if q >= 800}
    assert recall(got, want) >= 0.9


def test_few_candidates_and_empty(spark):
    data = rows(15)
    assert recall(run(spark, data), brute(data, 20)) == 1
    assert run(spark, []) == {} and run(spark, [(20, [1.0, 2.0], "x", 1)]) == {}


def test_cells_are_pruned_and_rotations_keep_angles():
    r = np.random.default_rng(1)
    x = C.directions(r.normal(size=(50, 60)))
    y = C.rotated(x, 0, 0)
    assert np.allclose(x @ x.T, y @ y.T)
    gap = C.gaps(x, 0, 2)
    few = C.probes(gap, 0, 0.05)
    assert 1 <= len(few) < 200 and len(C.probes(gap, 0, math.inf)) == (2 * C.width(60)) ** 2
    assert C.cells(x[:1], 2)[0, 0] in few  # a query's own cell comes first
