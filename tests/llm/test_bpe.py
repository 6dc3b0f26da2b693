from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken

from panelcast.llm import bpe

RAW = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()


def texts() -> list[str]:
    r = random.Random(3)
    syl = ["th", "ing", "er", "é", "ß", "aaaa", "ü", "tion", "  ", "\n", "\t ", "'s", "'ll", "42", "١٢", "!!!", "漢字", "🙂", "\x1c", " ", "....", "-", "_", " ", "é", "ﬀ", "Ⅷ", " "]
    return ["", "a", " ", "  \n ", "a" * 5000, "=" * 777, "ab" * 3000] + ["".join(r.choice(syl) for _ in range(r.randrange(1, 400))) for _ in range(300)]


def test_equals_tiktoken_and_round_trips(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RAW), special_tokens={})
    t = [*texts(), *texts()[:40], " ".join(f"x{i}y{i * 7}" for i in range(80_000))]  # the last has more pieces than a block
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in bpe.encode_texts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True).collect()}
    assert len(got) == len(t)
    for i, x in enumerate(t):
        ids = np.frombuffer(got[i]["ids"], "<u4").tolist()
        assert ids == enc.encode_ordinary(x) and got[i]["n_tokens"] == len(ids) and bytes(got[i]["decoded"]) == x.encode(), x[:60]


def lowest_first(ranks: dict, word: bytes) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 2**31), i) for i in range(len(parts) - 1))
        if r == 2**31:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_pieces_whose_merges_make_lower_ranks():
    ranks = {bytes([i]): 1000 + i for i in range(256)} | {b"bc": 5, b"abc": 1, b"ab": 9, b"cd": 7, b"abcd": 3, b"aa": 2, b"aaa": 1500}
    m = bpe.MergeReplay(ranks)
    r = random.Random(1)
    words = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 30))).encode() for _ in range(500)]
    toks, counts = m.encode(words)
    assert all(m.alone(w) == lowest_first(ranks, w) for w in words)
    at = 0
    for w, c in zip(words, counts.tolist(), strict=True):
        assert toks[at : at + c].tolist() == ([ranks[w]] if w in ranks else m.alone(w))
        at += c


def test_query_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (2, "The thing of\nit", None), (None, "a  b", "z")]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RAW), special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_repeated_pieces_of_a_block_are_numbered_by_frequency(monkeypatch):
    r = random.Random(3)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q" for i in (int(400 * r.random() ** 3) for _ in range(20_000)))
    raw = type("Raw", (), {"value": RAW})
    monkeypatch.setattr(bpe, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Own", (), {"partitionId": lambda _: 0})())}))
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1], pa.int64()), "text": [text]})
    rows = [r for b in bpe._cut(raw, P.PATTERN, 2)([batch]) for r in b.to_pylist() if r["kind"] == bpe.TEXT]
    times = np.bincount(np.concatenate([bpe.expand_codes(r["two"], r["three"]) for r in rows]))
    most = times[: int((times >= bpe.REPEATED).sum())]
    assert len(most) > bpe.OFTEN and most.min() >= bpe.REPEATED and (np.diff(most) <= 0).all()


def test_a_replay_begins_in_lots(monkeypatch):
    ranks, seen = bpe.load_ranks(RAW), []
    words = [w.encode() for w in texts()[4:60] if w]
    replay = bpe.MergeReplay(ranks)
    want = [replay.alone(w) for w in words if w not in ranks]
    monkeypatch.setattr(bpe, "PAIR_LOT", 7)
    look = replay.pair_rank
    monkeypatch.setattr(replay, "pair_rank", lambda a, b: (seen.append(len(a)), look(a, b))[1])
    toks, counts = replay.encode([w for w in words if w not in ranks])
    assert [x.tolist() for x in np.split(toks, np.cumsum(counts)[:-1])] == want
    n = sum(len(w) for w in words if w not in ranks)
    assert max(seen[: -(-(n - 1) // 7)]) <= 7 and sum(seen[: -(-(n - 1) // 7)]) == n - 1
