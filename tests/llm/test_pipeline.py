from __future__ import annotations

from collections import Counter

import corpus_pipeline as C
from pyspark.sql import functions as F

from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_mixing import brute as mixture

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    good = C.keep_quality(spark, docs, DIR)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    left = {r["doc_id"] for r in good.collect()}
    assert sum((i in left) == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    firsts = {i for i, _, c in groups(rows, 5, 80, 100) if i == c}
    one = C.drop_near_duplicates(spark, good, DIR)
    assert one.columns == docs.columns and Counter(r["doc_id"] for r in one.collect()) == Counter(firsts)
    clean = C.replace_personal_data(spark, one, DIR)
    assert clean.columns == docs.columns and clean.count() == one.count()
    assert clean.where(F.length("text") != F.col("n_chars")).count() == 0
    mixed = C.mix_sources(spark, clean, DIR)
    want = {i: taken // size if size else 0 for i, size, _, _, taken in mixture([(r["doc_id"], r["text"], None, r["source"]) for r in clean.collect()])}
    assert Counter(r["doc_id"] for r in mixed.where(F.length(F.trim("text")) > 0).collect()) == Counter({i: n for i, n in want.items() if n})
    out = C.run(spark, DIR)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in mixed.collect())


def test_repeated_rows_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "x", "en", "s", 1), (3, "A b c d e f", "en", "s", 11)], schema)
    assert sorted(str(r["doc_id"]) for r in C.drop_near_duplicates(spark, docs, DIR).collect()) == ["1", "2", "None"]
    assert C.replace_personal_data(spark, docs, DIR).count() == 5
    assert set(C.mix_sources(spark, docs, DIR).columns) == set(docs.columns)
    assert C.drop_near_duplicates(spark, docs.limit(0), DIR).count() == 0 and C.mix_sources(spark, docs.limit(0), DIR).count() == 0


def test_copies_go_to_their_own_source(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, text_key string, nth int, copy int, rn int, _sized int, _cut string"
    rest = ("en", None, 5, 1, "k", 2, 3, 4, 6, "c")
    data = [(i, t, "en", s, 5, *rest[3:]) for i, t, s in [(1, "a b c", "a"), (1, "a b c", "b"), (None, "a b c", "a"), (None, "a b c", "b"), (2, "d e", None), (3, "w " * 50, "b"), (3, "w " * 50, "b"), (4, None, "a")]]
    docs = spark.createDataFrame(data, schema)
    got = C.mix_sources(spark, docs, DIR)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {tuple(r)[5:] for r in rows} == {rest[3:]}
    want = {}
    for i, size, _, _, taken, s in mixture_by_source(data):
        want[i, s] = want.get((i, s), 0) + (taken // size if size else 0)
    have = Counter((r["doc_id"], r["source"]) for r in rows if r["text"] and r["text"].split())
    assert have == Counter({k: n for k, n in want.items() if n})


def mixture_by_source(data):
    out = []
    for s in {d[3] for d in data}:
        got = mixture([(d[0], d[1], None, d[3]) for d in data])
        sizes = {d[0]: len((d[1] or "").split()) for d in data if d[3] == s}
        total = sum(len((d[1] or "").split()) for d in data if d[3] == s)
        out += [(*g, s) for g in got if g[0] in sizes and g[2] == total and g[1] == sizes[g[0]]]
    return out


def test_duplicates_by_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rn int, _text_key int, _nth int, comp long"
    x, y = "a b c d e f g", "one two three four five six"
    data = [(5, x, "en", "s", 1), (3, x.upper(), "en", "s", 1), (5, y, "en", "s", 1), (5, y, "de", "s", 1), (None, x, "en", "s", 1), (None, "q r s t u v", "en", "t", 1), (None, "q r s t u v", "en", "s", 1), (7, "", "en", "s", 1), (7, "", "en", "s", 1), (7, None, "en", "s", 1)]
    docs = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in data], schema)
    got = C.drop_near_duplicates(spark, docs, DIR)
    assert got.columns == docs.columns
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter([(3, x.upper(), "en", "s"), (5, y, "de", "s"), (None, "q r s t u v", "en", "s"), (7, "", "en", "s"), (7, "", "en", "s"), (7, None, "en", "s")])
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, C.drop_near_duplicates(spark, docs.repartition(5), DIR).collect()))


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    assert all(f(spark, docs, DIR).count() == 0 for _, f in C.STAGES)


def test_only_texts_that_may_go_are_joined(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(9))
    data = [(i, text(i % 1900), "en", "s", 1) for i in range(2000)] + [(None, text(2000), "en", "s", 1), (None, text(2000), "de", "s", 1), (None, text(5), "en", "s", 1)]
    docs, joins = spark.createDataFrame(data, schema), []
    join = type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda d, other, on=None, how=None: (how == "left_anti" and joins.append(d.count()), join(d, other, on, how))[1])
    got = C.drop_near_duplicates(spark, docs, DIR).collect()
    assert len(joins) == 2 and max(joins) < 400
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame([*data[:1900], (None, text(2000), "de", "s", 1)], schema).collect())
