from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelcast.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node long"


def brute(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [y[1:] for y in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    out = []
    for k, m in members.items():
        below = [u for u in members if u[: len(k)] == k]
        kids = lambda u: [w for w in members if len(w) == len(u) + 1 and w[: len(u)] == u]
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in below if u)
        ending = ",".join(str(c) for c in sorted(c for c in m if built[c] == k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids(k)), sum(not kids(u) for u in below), saved, hashlib.sha256(ending.encode()).hexdigest()))
    return sorted(out, key=str)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run(spark, rows):
    return sorted((tuple(x) for x in T.shared_prefix_trie(spark.createDataFrame(rows, SCHEMA)).select(COLS).collect()), key=str)


def sample(n: int) -> list[tuple]:
    r = random.Random(4)
    rows = []
    for c in range(-12, n):
        for t in range(r.randint(1, 9)):
            rows.append((c, r.choice((t, t, t, None)), r.choice(("user", "assistant", None)), r.choice(("a", "b", "é", None)), "x", 1))
    rows += [(500, t, "user", str(t % 3), "x", 1) for t in range(60)] + [(None, 0, "user", "lost", "x", 1), (3, 0, "user", "a", "x", 1), (3, 0, "user", "a", "x", 1)]
    return rows + [(600 + k, 0, "user", "same", "x", 1) for k in range(0, 40, 5)]


@pytest.mark.parametrize("component,block", [(4096, 4096), (6, 4)])
def test_equals_brute_force(spark, monkeypatch, component, block):
    for name, n in (("COMPONENT", component), ("BLOCK", block), ("IDS", 7), ("BATCH", 20)):
        monkeypatch.setattr(T, name, n)
    rows = sample(40 if component == 6 else 90)
    assert run(spark, rows) == brute(rows)


def test_empty_and_turnless(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "a", "x", 1)]) == []
    rows = [(c, 0, "user", "a", "x", 1) for c in range(11, 15)]  # conversation 10 is absent: what its readers skip is lost
    assert run(spark, rows) == brute(rows)


def test_centroids_of_random_trees():
    r = np.random.default_rng(5)
    for n in (1, 2, 50, 3000):
        conv, depth, parent, par = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(1, n):
            par[k] = r.integers(max(0, k - 5), k) if n < 3000 else r.integers(0, k)
            parent[k], depth[k] = par[k], depth[par[k]] + 1
        value, weight = r.integers(0, 1 << 40, n), r.integers(1, 9, n)
        sums, sub = value.copy(), weight.copy()
        for k in range(n - 1, 0, -1):
            sums[par[k]] += sums[k]
            sub[par[k]] += sub[k]
        got = T.roll_up(conv, depth, parent, conv == 0, sub, [value])
        assert (got[0] == sums).all()
