from __future__ import annotations

import math
import random
import re
import string
import zlib

import numpy as np

from panelcast.llm import quality as Q


def rows(n: int = 400) -> tuple[list, list]:
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(r.choice("aeioustrnl") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(3, 90))]
        good = i % 4 > 0
        if not good:
            w = [[x.upper() + "!!" for x in w], ["|".join([x, ""]) for x in w], [w[0]] * len(w), [x + "###" for x in w]][i // 4 % 4]
        docs.append((i, " ".join(w) + ".", "en", "s"))
        if r.random() < 0.7:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = rows()
    odd = [(900, None, "en", "s"), (901, "", "en", "s"), (None, "good text here.", "en", "s"), (7, docs[7][1], "en", "s"), (902, "word " * 50_000, "en", "s")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, score string, source string")
    lab = spark.createDataFrame(labels + [(7, 1, 0), (1, 0, 0), (1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = Q.score_held_out(df, lab).collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    got = {r["doc_id"]: r for r in out}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in docs)
    right = [got[i]["predicted"] == int(i % 4 > 0) for i, *_ in docs if got[i]["held_out"]]
    assert sum(right) / len(right) > 0.95


def test_no_labels_and_empty(spark):
    ds, ls = "doc_id long, text string", "doc_id long, quality int"
    assert [r["predicted"] for r in Q.score_held_out(spark.createDataFrame([(1, "a b")], ds), spark.createDataFrame([], ls)).collect()] == [1]
    assert [r["predicted"] for r in Q.score_held_out(spark.createDataFrame([(1, "a b")], ds), spark.createDataFrame([(1, 0)], ls)).collect()] == [0]
    assert Q.score_held_out(spark.createDataFrame([], ds), spark.createDataFrame([], ls)).count() == 0


KINDS = [string.ascii_uppercase, string.ascii_lowercase, string.digits, " \t", "\n\r", ".,;:?'\"-", "!", "|", "*#$%&@~^=_+<>{}[]\\/", "()"]
M = 2**64


def mixed(h: int) -> int:
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % M
    h = (h ^ h >> 27) * 0x94D049BB133111EB % M
    return h ^ h >> 31


def brute(text: str | None) -> list[float]:
    data = (text or "").encode()
    size = max(len(data), 1)
    words = re.split(rb"[ \t-\r]+", data.lower())
    words = [w for w in words if w]
    n = max(len(words), 1)
    shares = [sum(c in k.encode() for c in data) / size for k in KINDS] + [sum(c > 127 for c in data) / size]
    pairs = list(zip(words, words[1:], strict=False))
    lines = shares[4] * size + 1
    x = shares + [1 - len(set(words)) / n if words else 0.0, (len(pairs) - len(set(pairs))) / (n - 1) if n > 1 else 0.0, sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0]
    x += [len(data) / n / 10, math.log1p(len(words)) / 10, math.log1p(n / lines) / 5, *(shares[i] * size / n for i in (5, 8, 6, 7))]
    hashes = [mixed((sum((c + 1) * pow(0x9E3779B97F4A7C15, i, M) for i, c in enumerate(w)) + len(w) * 0xD6E8FEB86659FD93) % M) for w in words]
    ones, twos = [0] * Q.WORDS, [0] * Q.PAIRS
    for h in hashes:
        ones[h % Q.WORDS] += 1
    for a, b in zip(hashes, hashes[1:], strict=False):
        twos[mixed((b * 3 + a) % M) % Q.PAIRS] += 1
    return [*x, *map(math.sqrt, x), *(math.sqrt(c / n) for c in ones + twos)]


def test_scores_equal_brute_force(spark):
    docs, labels = rows(200)
    docs += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "Ünï Ünï\tÜNÏ\x0b(x) [y]\n\n a|b $5!", "en", "s"), (903, "one", "en", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, good string")
    m = Q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in df.select("text", Q.score(m, df["text"], df).alias("s")).collect():
        z = sum(max(-8.0, min(8.0, (x - a) / b)) * w for x, a, b, w in zip(brute(r["text"]), m.mean, m.spread, m.weights, strict=True)) - m.cut
        assert abs(r["s"] - 1 / (1 + math.exp(-max(-30, min(30, z))) * (1 - Q.CUT) / Q.CUT)) < 1e-6


def test_the_cut_is_a_quantile():
    r = np.random.default_rng(2)
    good = np.arange(400) % 2 == 0
    x = np.where(good, 1.0, -1.0)[:, None] + r.normal(0, 0.9, (400, 3))
    for share, q in ((0.5, None), (0.2, None), (0.2, 0.6), (0.5, 0.0), (0.5, 1.0)):
        m = Q.fit_pairs(x, good, share, q)
        w = np.where(good, (1 - share) / 200, share / 200)
        want = share if q is None else q
        assert abs(w[m.worth(x) < m.cut].sum() - want) < 0.006


def test_an_id_with_many_rows_is_one_row_of_the_sample(spark, monkeypatch):
    docs, labels = rows(200)
    seen, pairs = [], Q.fit_pairs
    monkeypatch.setattr(Q, "fit_pairs", lambda x, *more: (seen.append(len(x)), pairs(x, *more))[1])
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, source string")
    hot = spark.range(100_000).selectExpr("CAST(1 AS long) AS doc_id", "concat('word ', id) AS text", "'en' AS score", "'s' AS source")
    Q.fit(df.unionByName(hot), spark.createDataFrame([*labels, (1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert len(seen) == 1 and seen[0] <= len({i for i, *_ in labels} | {1})


def test_all_marked_documents_make_the_model(spark):
    docs, labels = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = Q.fit(df, lab, fit_rows=3000), Q.fit(df, lab, fit_rows=0)
    marks = {i: m for i, m, _ in labels}
    x = np.array([brute(t) for i, t, *_ in docs if i in marks])
    good = np.array([marks[i] == 1 for i, *_ in docs if i in marks])
    for m in (a, b):
        z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-3), -8, 8)
        assert np.abs(m.mean - x.mean(0)).max() < 1e-9 and np.abs(m.spread - np.maximum(x.std(0), 1e-3)).max() < 1e-9
        d = (z[good][:, None] - z[~good][None]).reshape(-1, x.shape[1])
        gradient = 1e-3 * m.weights - (1 / (1 + np.exp(d @ m.weights))) @ d / len(d)
        assert np.abs(gradient).max() < 1e-5 and (m.worth(x) < m.cut).sum() == (~good).sum()


def test_groups_hold_each_document_once_and_a_rare_mark_in_each(spark):
    docs = [(i, f"word{i} text " * (1 + i % 7), int(i % 100 > 0)) for i in range(800)]
    df = spark.createDataFrame(docs * 2, "id long, text string, good int")
    t = Q._featured(df).join(df.select("id", "good").distinct(), "id")
    got = Q._groups(t, 20, {0: 20, 1: 1}, 3).collect()
    assert len(got) == 20 and sum(r["n_good"] for r in got) == 792 and sum(r["n_bad"] for r in got) == 8
    assert all(len(r["bad"]) == 8 * 8 * Q.WIDTH and len(r["good"]) == 8 * r["n_good"] * Q.WIDTH for r in got)


def test_few_sums_reach_the_driver_from_many_tasks(spark, monkeypatch):
    docs = [(i, f"word{i} text " * (1 + i % 7), i % 2) for i in range(300)]
    df = spark.createDataFrame(docs, "id long, text string, good int")
    groups = Q._groups(Q._featured(df).join(df.select("id", "good"), "id"), 20, {0: 1, 1: 1}, 60).localCheckpoint()
    deal = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda d, n, *cols: deal(d, max(n, 90), *cols))
    rows = Q._sums(groups, lambda g, b, own: np.array([len(own)]), 1).collect()
    assert len(rows) <= 8 and sum(np.frombuffer(r["x"])[0] for r in rows) == 300
    assert Q._added(groups.where("at < 0"), lambda g, b, own: np.ones(3), 3).tolist() == [0, 0, 0]
