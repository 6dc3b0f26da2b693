from __future__ import annotations

import math
import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from panelcast.llm import langid as L
from panelcast.llm.util import chance

SYL = {"en": ["th", "ing", "the", "wh", "er"], "fr": ["eau", "oi", "é", "ç", "ou"], "de": ["sch", "ung", "ß", "ü", "ich"], "es": ["ción", "ñ", "ado", "ll", "os"]}


def rows(n: int = 240) -> list[tuple]:
    r = random.Random(2)
    out = []
    for i in range(n):
        lang = r.choice(list(SYL))
        out.append((i, " ".join("".join(r.choice(SYL[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 60))), lang, "s"))
    return out


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9, 20):
        m = L.codewords(k)
        d = min((m[i] != m[j]).sum() for i in range(k) for j in range(i))
        assert d >= (1 if k == 2 else 2 if k < 4 else 4)
        assert (np.abs(m.sum(0)) < k).all()


def test_held_out_accuracy_and_edge_cases(spark):
    data = rows()
    odd = [(1000, None, "en", None), (1001, "", "fr", "s"), (1002, "123 !!", "de", "s"), (None, "sch ung ich", "de", "s"), (1003, "sch ung ich sch", None, "s"), (1004, "the thing " * 20_000, "en", "s"), (5, data[5][1], data[5][2], "s")]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, lang string, source string")
    out = L.predict_held_out(df).collect()
    assert len(out) == len(data) + len(odd)
    got = {r["doc_id"]: r for r in out}
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[1003]["lang_pred"] == "de" and got[1004]["lang_pred"] == "en" and got[None]["held_out"]
    for i, _, _, _ in data:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [(got[i]["lang_pred"], lang) for i, _, lang, _ in data if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_no_labels_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert [r["lang_pred"] for r in L.predict_held_out(spark.createDataFrame([(1, "abc", None, "s")], schema)).collect()] == ["und"]
    assert L.predict_held_out(spark.createDataFrame([], schema)).count() == 0


def brute(model: L.LanguageModel, text: str | None) -> tuple[str, float]:
    """Gram by gram: mean log odds of each bit, then the loss of each language's codeword."""
    low = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in (text or "").encode()]
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    bits = [0.0] * model.codes.shape[1]
    for k in (2, 4):
        for i in range(len(low) - k + 1):
            x = int.from_bytes(bytes(low[i : i + k]), "big")
            w = model.weights[x if k == 2 else (x * 2654435761 % 2**32 >> 16) + 65536]
            bits = [b + float(y) for b, y in zip(bits, w, strict=True)]
    z = [b / len(low) / s for b, s in zip(bits, model.scale, strict=True)]
    loss = [sum(math.log1p(math.exp(-4 * x * c)) * v for x, c, v in zip(z, code, model.vote, strict=True)) for code in model.codes]
    p = [math.exp(min(loss) - x) for x in loss]
    return model.langs[loss.index(min(loss))], max(p) / sum(p)


def test_equals_brute_force(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame([*data, (7, None, "en", "s"), (1001, "?!", "de", "s"), (1002, "x", "de", "s"), (1003, "É ñ", None, None)], "doc_id long, text string, lang string, p string")
    model = L.fit(df.where("lang IS NOT NULL"))
    got = df.select("text", L.language(model, df["text"], df).alias("q")).collect()
    for r in got:
        lang, score = brute(model, r["text"])
        assert r["q"]["lang_pred"] == lang and abs(r["q"]["score"] - score) < 1e-4
    monkeypatch.setattr(L, "PART", 64)
    long = np.frombuffer(data[3][1].encode() * 9, np.uint8)
    ends = np.array([0, len(long)])
    whole = model.margins(long, ends)
    monkeypatch.setattr(L, "PART", 1 << 20)
    assert np.allclose(whole, model.margins(long, ends), atol=1e-9)


def test_clashing_columns(spark):
    data = [(i, t, lang, s, "p", 0.5, True, 1) for i, t, lang, s in rows(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, p string, score double, held_out boolean, id int")
    got = L.predict_held_out(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"] and got.count() == 60


def test_a_sample_without_texts_and_shares_of_any_size(spark):
    df = spark.createDataFrame(rows(60), "doc_id long, text string, lang string, p string")
    model = L.fit(df, fit_rows=1e-12)  # as little of a language as 2,000 of 1e17 texts
    assert len(model.scale) == len(model.vote) == model.codes.shape[1]
    assert df.select(L.language(model, df["text"], df).alias("q")).where("q.lang_pred IS NULL OR NOT q.score BETWEEN 0 AND 1").count() == 0
    ids = spark.range(200_000)
    for share in (0.5, 1e-3, 1e-4):
        n = ids.where(chance(F.lit("fit"), "id") < share).count()
        assert abs(n - share * 200_000) < 6 * (share * 200_000) ** 0.5
    assert ids.agg(F.count_distinct(chance("id"))).first()[0] == 200_000
