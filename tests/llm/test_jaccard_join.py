from __future__ import annotations

import random

import numpy as np
from pyspark.sql import types as T

from panelcast.llm import jaccard_join as J

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType()), T.StructField("sig", T.IntegerType())])


def words(t: str | None) -> list[bytes]:
    return (t or "").encode().lower().split()


def shingles(t: str | None, k: int) -> set:
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows: list[tuple], k: int, num: int, den: int) -> list[tuple]:
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def fixture() -> list[tuple]:
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    common = [r.choice(vocab) for _ in range(40)]
    rows, i = [], 0
    for n in (1, 2, 3, 4, 7, 20, 60, 200):
        for _ in range(4):
            base = [r.choice(vocab) for _ in range(n)] + (common if r.random() < 0.5 else [])
            for _ in range(6):
                w = list(base)
                for _ in range(r.choice([0, 0, 1, 2, 3])):
                    w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
                rows.append((i, r.choice([" ", "\t", "\n ", "\x0b"]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
                i += 1
    base = [r.choice(vocab) for _ in range(120)]
    for _ in range(60):  # a large group of near copies: longer posting lists than SHORT
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
            w[r.randrange(120)] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
        i += 1
    long = " ".join(r.choice(vocab) for _ in range(30_000))
    return rows + [(i, ""), (i + 1, None), (i + 2, " \n"), (None, rows[40][1]), (i + 3, "À b"), (i + 4, "à b"), (3, rows[3][1]), (3, rows[3][1]), (i + 5, long), (i + 6, long + " end"), (i + 7, "a b c"), (i + 8, "a b c")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA)
    return sorted((tuple(x) for x in J.jaccard_components(df, **kw).collect()), key=str)


def test_equals_brute_force(spark):
    rows = fixture()
    for k, num, den in ((3, 90, 100), (5, 80, 100), (1, 50, 100)):
        assert run(spark, rows, k=k, num=num, den=den) == brute(rows, k, num, den)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "SHORT", 3)
    rows = fixture()
    assert run(spark, rows) == brute(rows, 3, 90, 100)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_signatures_of_sets_before_empty_ones():
    a = np.array([3, 9, 20], np.uint64)
    one, two = J._signatures(np.concatenate([a, a]), np.array([3, 0, 3, 0, 0]))
    assert one[0] == one[2] != 0 and two[0] == two[2] and (one[[1, 3, 4]] == 0).all()
    assert J._nodes(a, np.array([3, 0]), [int(one[0])]).tolist() == [int(two[0]), 0]


def test_lists_in_parts_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "SHORT", 2)
    monkeypatch.setattr(J, "BLOCK", 9)
    rows = fixture()[-90:]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=str) == brute(rows, 3, 90, 100)
