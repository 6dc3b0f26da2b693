from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from panelcast.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n long, way string"
COLS = ["word", "n", "n_near", "form", "form_n", "root"]


def words_of(rows: list[tuple]) -> dict[str, int]:
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n: dict[str, int]) -> list[tuple]:
    near = {w: [u for u in n if u != w and abs(len(u) - len(w)) < 2 and one_edit(w, u)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, r))
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(x) for x in S.spelling_groups(spark.createDataFrame(rows, SCHEMA)).select(COLS).collect())


def test_documents_equal_brute_force(spark):
    r = random.Random(3)
    stems = ["".join(r.choice("abÉé") for _ in range(r.randint(4, 9))) for _ in range(60)] + ["aaaaaa", "aaaaa", "Zürich", "zurich", "ababab", "bababa"]
    rows = []
    for i in range(150):
        out = []
        for _ in range(40):
            w = r.choice(stems)
            k = r.randrange(len(w))
            out.append(r.choice((w, w, w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w.upper())))
        rows.append((i, r.choice((" ", ", ", "1")).join(out), "w", 1, "f"))
    rows += [(None, "Zürich Zürich zürich ×÷×÷× " * 3, "w", 1, "f"), (7, None, "w", 1, "f"), (8, "", "w", 1, "f"), (9, "x" * 400 + " " + "x" * 399 + "y", "w", 1, "f")]
    rows += [(k, "q" * 300 + " " + "q" * 150 + "r" + "q" * 149 + " " + "q" * 301, "w", 1, "f") for k in range(1000, 1004)]
    assert run(spark, rows) == brute(words_of(rows))


@pytest.mark.parametrize("alphabet,lengths", [("ab", (1, 7)), ("abc", (1, 5))])
def test_all_short_words(spark, alphabet, lengths):
    r = random.Random(9)
    n = {"".join(r.choice(alphabet) for _ in range(r.randint(*lengths))): r.randint(1, 60) for _ in range(250)}
    df = spark.createDataFrame([(w, k) for w, k in n.items()], "word string, n long")
    assert sorted(tuple(x) for x in S.variants(df).select(COLS).collect()) == brute(n)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, "one two", "w", 1, "f")]) == []
