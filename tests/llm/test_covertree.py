from __future__ import annotations

import math
import random

import numpy as np

from panelcast.llm import covertree as C

SCHEMA = "vec_id long, embedding array<float>, label int, key string, comp int"


def brute(rows: list[tuple]) -> list[tuple]:
    def ok(i, v, lab):
        return i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [k for k, r in enumerate(rows) if ok(*r[:3])]
    u = {k: np.array(rows[k][1], np.float32).astype(float) for k in good}
    u = {k: x / np.linalg.norm(x) for k, x in u.items()}
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.98:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    out = []
    for k, (i, *_) in enumerate(rows):
        c = min((rows[j][0] for j in good if find(j) == find(k)), default=i) if k in u else i
        out.append((i, n[k], c, i is None or i == c))
    return sorted(out, key=str)


def rows(n: int) -> list[tuple]:
    r = random.Random(9)
    mids = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    out = [(i, [x + r.gauss(0, r.choice([0.01, 0.08, 0.15, 1])) for x in r.choice(mids)], r.choice([1, 1, 1, 2, 3]), "x", 1) for i in range(n)]
    out += [(n + i, out[4][1], out[4][2], "x", 1) for i in range(25)]
    return out + [(n + 50, None, 1, "x", 1), (n + 51, [0.0] * 8, 1, "x", 1), (n + 52, [1.0] * 7 + [None], 1, "x", 1), (n + 53, [math.nan] * 8, 1, "x", 1), (n + 54, out[4][1], None, "x", 1), (None, out[4][1], 1, "x", 1), (n + 55, [1.0, 2.0], 1, "x", 1), (n + 56, [2.0, 4.0], 1, "x", 1), (3, out[3][1], out[3][2], "x", 1), (n + 57, [], 1, "x", 1), (n + 58, [1e30] * 8, 1, "x", 1), (n + 59, [1e-30] * 8, 1, "x", 1)]


def run(spark, data):
    return sorted((tuple(r) for r in C.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 40)
    monkeypatch.setattr(C, "SIDE", 2)
    data = rows(400)
    assert run(spark, data) == brute(data)


def test_dense_and_scattered_nodes(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 16)
    r = random.Random(3)
    near = lambda m, s: [x + r.gauss(0, s) for x in m]
    a, b = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 0.19, 0.0, 0.0, 0.0, 0.0]
    data = [(i, near(r.choice([a, a, b]), r.choice([0.001, 0.002, 0.03])) if i % 3 else [r.gauss(0, 1) for _ in range(6)], i % 2, "x", 1) for i in range(300)]
    data += [(1000 + i, [x * (1 + i) for x in a], 0, "x", 1) for i in range(40)]  # one direction, 40 classes: cannot be split
    assert run(spark, data) == brute(data)
    wide = spark.createDataFrame(data, SCHEMA.replace("float", "double"))
    assert len({r["component_id"] for r in C.near_duplicates(wide).collect()}) == len({x[2] for x in brute(data)})


def test_empty(spark):
    assert run(spark, []) == []


def test_dense_groups_are_accepted_whole():
    r = np.random.default_rng(1)
    x = C._unit(np.concatenate([np.array([1.0, 0, 0, 0]) + r.normal(0, 0.005, (300, 4)), r.normal(0, 1, (300, 4))]))
    w = np.ones(600, np.int64)
    t = C.CoverTree(x)
    na, nb, edges = C.dual_traversal(t, t, w, w, 0.98, True)
    m = x @ x.T >= 0.98
    np.fill_diagonal(m, False)
    assert (na + nb).tolist() == m.sum(1).tolist() and len(edges) < 20_000


def hub(r: random.Random, dims: int, at: int, n: int, spread: float) -> list[list[float]]:
    """Vectors about equally far from each other and nearer to axis ``at``."""
    out = []
    for _ in range(n):
        x = [r.gauss(0, 1) for _ in range(dims)]
        x[at] = 0.0
        s = spread / math.sqrt(sum(v * v for v in x))
        out.append([v * s for v in x[:at]] + [1.0] + [v * s for v in x[at + 1 :]])
    return out


def test_a_hub_does_not_cost_a_round_for_some_of_its_spokes(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 16)
    monkeypatch.setattr(C, "FAN", 4)
    r, rounds, stage = random.Random(5), [], C.stage

    def counted(df, name):
        rounds.extend([name] * (name == "centres"))
        assert len(rounds) <= 12
        return stage(df, name)

    monkeypatch.setattr(C, "stage", counted)
    data = [(i, v, 1, "x", 1) for i, v in enumerate(hub(r, 40, 0, 200, 0.12) + hub(r, 40, 0, 100, 0.001))]
    assert run(spark, data) == brute(data)


def test_pairs_of_a_hub_are_compared_in_blocks():
    r = random.Random(6)
    a, b = (C._unit(np.array(hub(r, 64, 0, 400, 0.115))) for _ in range(2))
    w = np.ones(400, np.int64)
    na, nb, edges = C.dual_traversal(C.CoverTree(a), C.CoverTree(b), w, w, 0.98, False)
    m = a @ b.T >= 0.98
    assert 0 < m.sum() and na.tolist() == m.sum(1).tolist() and nb.tolist() == m.sum(0).tolist() and len(edges) < 800


def test_pairs_of_nodes_are_not_broadcast(spark):
    pairs = C.stage(spark.createDataFrame([(1, 3, "a", "b")], "label long, dim long, a string, b string"), "pairs")
    nodes = C.stage(spark.createDataFrame([(1, 3, "a", 7), (1, 3, "b", 8)], "label long, dim long, node string, no long"), "nodes")
    out = C._of_nodes(pairs, lambda s: nodes.select("label", "dim", nodes["node"].alias(s), nodes["no"].alias(f"no_{s}")))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(x["no_a"], x["no_b"]) for x in out.collect()] == [(7, 8)]
