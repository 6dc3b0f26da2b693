"""Document quality by Bradley-Terry pairwise ranking.

A document's worth is linear in features of its whole text: shares of kinds of
characters, repetition, lengths, and shares of words and word pairs by hash. Of a
preference pair (a document marked 1 and one marked 0) the better one wins with
probability sigmoid(worth - worth'); the weights minimise the logistic loss on the
pairs' feature differences, over all marked documents. The cut is the quantile of the worths at the share of marks
that are 0, or at another share asked for, and scores are the logistic of the distance
to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.langid import remainder
from panelcast.llm.shingles import mix, pieces, text_buffers, word_hashes
from panelcast.llm.util import release_memory, stage, tasks

#: About the number of documents of each mark, and the number of preference pairs, that the start of the fit is found on.
FIT_ROWS, FIT_PAIRS = 3000, 40_000
#: Pairs whose differences the driver holds at once.
PAIR_LOT = 4096
#: Marked documents of a group whose good and bad ones are paired, least of a mark in a group, documents of a task.
GROUP, LEAST, LOT = 512, 16, 20_000
#: Hash buckets of words and of word pairs.
WORDS, PAIRS = 128, 64
#: The score at the cut.
CUT = 0.3
_U = np.uint64


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_KINDS = [
    _table(bytes(range(65, 91))),
    _table(bytes(range(97, 123))),
    _table(b"0123456789"),
    _table(b" \t"),
    _table(b"\n\r"),
    _table(b".,;:?'\"-"),
    _table(b"!"),
    _table(b"|"),
    _table(b"*#$%&@~^=_+<>{}[]\\/"),
    _table(b"()"),
    _table(bytes(range(128, 256))),
]


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of numbers for each text, from shares of bytes, of words and of word pairs; empty texts give zeros."""
    n = np.diff(offs).astype(float)
    size = np.maximum(n, 1)
    cols = []
    for k in _KINDS:
        c = np.concatenate([[0], np.cumsum(k[data])])
        cols.append((c[offs[1:]] - c[offs[:-1]]) / size)
    h, words = word_hashes(data, offs)
    ends = np.cumsum(words)
    distinct, pairs, again = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i, (w, e) in enumerate(zip(words.tolist(), ends.tolist(), strict=True)):
        if w > 1:
            x = h[e - w : e]
            again[i] = (x[1:] == x[:-1]).mean()
            two = np.sort(x[1:] * _U(3) + x[:-1])
            pairs[i] = (two[1:] == two[:-1]).sum() / (w - 1)
            x = np.sort(x)
            distinct[i] = (x[1:] == x[:-1]).sum() / w
    w = np.maximum(words, 1)
    lines = cols[4] * size + 1
    cols += [distinct, pairs, again, n / w / 10, np.log1p(words) / 10, np.log1p(w / lines) / 5, cols[5] * size / w, cols[8] * size / w, cols[6] * size / w, cols[7] * size / w]
    x = np.stack(cols, 1)
    at = np.repeat(np.arange(len(n)), words)
    with np.errstate(over="ignore"):
        two = mix(h[1:] * _U(3) + h[:-1])[at[1:] == at[:-1]]
    share = lambda t, h, k: np.sqrt(np.bincount(t * k + (h % _U(k)).astype(np.int64), minlength=len(n) * k).reshape(-1, k) / w[:, None])
    return np.concatenate([x, np.sqrt(x), share(at, h, WORDS), share(at[1:][at[1:] == at[:-1]], two, PAIRS)], 1)


#: Numbers of a document.
WIDTH = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


def _by_piece(col: pa.Array, f) -> list[np.ndarray]:
    data, offs = text_buffers(col)
    return [f(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in pieces(offs)]


@dataclass
class QualityModel:
    """Standardised features' weights and the cut on the worth."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.worth(x) - self.cut, -30, 30)
        s = 1 / (1 + np.exp(-z) * (1 - CUT) / CUT)
        return np.where(z >= 0, np.maximum(s, CUT), np.minimum(s, np.nextafter(CUT, 0)))


def fit_pairs(x: np.ndarray, good: np.ndarray, bad_share: float | None = None, quantile: float | None = None, pairs: int = FIT_PAIRS, ridge: float = 1e-3) -> QualityModel:
    """Bradley-Terry weights from pairs of a good and a bad row, then the cut at ``quantile`` of the worths.

    ``bad_share``: the share of bad documents among those that the rows stand for (by
    default that of the rows); good and bad rows weigh accordingly. The quantile is this
    share unless another is given. The cut lies in the gap between two worths, nearer to
    the lower one.
    """
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / spread, -8, 8)
    g, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(g) or not len(b):
        return QualityModel(mean, spread, np.zeros(x.shape[1]), 0.0 if len(g) or not len(b) else 1e-9)
    i = np.arange(pairs, dtype=np.int64)
    i, j = g[i % len(g)], b[(i * 7919 + i // len(g)) % len(b)]
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps on the logistic loss of differences
        grad, hess = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for k in range(0, pairs, PAIR_LOT):
            d = z[i[k : k + PAIR_LOT]] - z[j[k : k + PAIR_LOT]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad -= d.T @ p
            hess += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hess / pairs + ridge * np.eye(len(w)), ridge * w + grad / pairs)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    v, bad_share = z @ w, len(b) / len(x) if bad_share is None else bad_share
    order = np.argsort(v, kind="stable")
    below = np.cumsum(np.where(good[order], (1 - bad_share) / len(g), bad_share / len(b)))
    v, q = v[order], int(np.searchsorted(below, (bad_share if quantile is None else quantile) + 1e-9))
    cut = v[0] - 1e-9 if q == 0 else v[-1] + 1e-9 if q == len(v) else v[q - 1] + 0.25 * (v[q] - v[q - 1])
    return QualityModel(mean, spread, w, float(cut))


def _featured(texts: DataFrame) -> DataFrame:
    """(id, h, x) of (id, text): a hash of the text and its features; of an id's texts in a batch only that of the smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((h, ids))
            one = batch.take(pa.array(order[np.diff(ids[order], prepend=ids[order[:1]] - 1) != 0]))
            parts = _by_piece(one.column(2), features)
            x = [r.tobytes() for part in parts for r in part]
            yield pa.RecordBatch.from_arrays([*one.columns[:2], pa.array(x, pa.binary())], names=["id", "h", "x"])
            release_memory()

    return texts.select("id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "id long, h long, x binary")


def _groups(rows: DataFrame, groups: int, times: dict[int, int], lots: int) -> DataFrame:
    """One row for each group of (good, id, h, x): the features of its good and of its bad rows, own ones before copies from other groups.

    Of an id's rows the one of the smallest hash counts. Groups follow from a hash of
    the id, so these rows meet; documents of a mark go to ``times`` groups each.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, held, own = None, None, ([], []), [0, 0]

        def row() -> pa.RecordBatch:
            cols = [[now], [own[1]], [own[0]], [b"".join(held[1])], [b"".join(held[0])]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.binary()] * 2, strict=True)], names=["at", "n_good", "n_bad", "good", "bad"])

        for batch in batches:
            for at, good, copy, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and at != now:
                    yield row()
                    seen, held, own = None, ([], []), [0, 0]
                now = at
                if seen != (copy, i):
                    seen = (copy, i)
                    held[good].append(x)
                    own[good] += copy == 0
        if now is not None:
            yield row()

    n = F.when(F.col("good") == 1, F.lit(times[1])).otherwise(F.lit(times[0]))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    at = F.pmod(F.pmod(F.xxhash64("id"), F.lit(groups)) + F.floor(F.col("copy") * F.lit(groups) / n), F.lit(groups))
    rows = rows.withColumn("at", at).repartition(lots, "at").sortWithinPartitions("at", "copy", "id", "h")
    return rows.select("at", "good", "copy", "id", "x").mapInArrow(pack, "at long, n_good long, n_bad long, good binary, bad binary")


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of a group's good rows and bad rows, with copies, and of all its own rows."""
    for i in range(batch.num_rows):
        _, n_good, n_bad, good, bad = (c[i].as_py() for c in batch.columns)
        g, b = (np.frombuffer(x).reshape(-1, WIDTH) for x in (good, bad))
        yield g, b, np.concatenate([g[:n_good], b[:n_bad]])


def _sums(groups: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> DataFrame:
    """(task, x): sums of the ``size`` numbers ``of`` gives of groups, by task, then of eighths of the tasks; tasks without rows give none, so at most eight rows come out however many tasks there are."""

    def total(rows: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, met = np.zeros(size), False
        for r in rows:
            x += r
            met = True
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["task", "x"])
        release_memory()

    parts = groups.mapInArrow(lambda batches: total(of(*m) for batch in batches for m in _matrices(batch)), "task int, x binary")
    parts = parts.repartition(8, F.col("task") % 8).sortWithinPartitions("task")
    return parts.mapInArrow(lambda batches: total(np.frombuffer(x.as_py()) for batch in batches for x in batch.column(1)), "task int, x binary")


def _added(groups: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all groups of the ``size`` numbers ``of`` gives; eight rows reach the driver."""
    out = np.zeros(size)
    for r in sorted(_sums(groups, of, size).collect()):
        out += np.frombuffer(r["x"])
    return out


def _pair_sums(model: QualityModel) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Number of a group's pairs, their logistic loss, its gradient and its Hessian by the weights."""

    def of(good: np.ndarray, bad: np.ndarray, _: np.ndarray) -> np.ndarray:
        if not len(good) or not len(bad):
            return np.zeros(2 + WIDTH + WIDTH**2)
        z, y = model.standard(good), model.standard(bad)
        d = np.clip((z @ model.weights)[:, None] - (y @ model.weights)[None, :], -30, 30)
        p = 1 / (1 + np.exp(d))
        h = p * (1 - p)
        mixed = z.T @ (h @ y)
        hess = (z * h.sum(1)[:, None]).T @ z + (y * h.sum(0)[:, None]).T @ y - mixed - mixed.T
        return np.concatenate([[d.size, np.log1p(np.exp(-d)).sum()], p.sum(0) @ y - p.sum(1) @ z, hess.ravel()])

    return of


def _at_rank(v: DataFrame, rank: int) -> float:
    """The value of ``v`` that ``rank`` rows precede in its order: counts of 1,024 ranges, then of the ranges of one of these."""
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    while lo < hi:
        i = F.least(F.floor((F.col("v") - lo) / (hi - lo) * 1024), F.lit(1023))
        for r in v.where(F.col("v").between(lo, hi)).groupBy(i.alias("i")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i").collect():
            if rank < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return lo


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, quantile: float | None = None, ridge: float = 1e-3) -> QualityModel:
    """Fit on all marked documents: means, weights and the cut are those of all of them.

    Documents are dealt by id hash to groups of about ``GROUP``, and in a group each good
    one is paired with each bad one; documents of a rare mark go to several groups.
    Newton steps add up the groups' losses in tasks, from a start that ``fit_pairs`` finds
    on the groups of about ``fit_rows`` documents of each mark: the loss is convex, so the start
    shortens the way and does not change its end. The cut is found by counting worths.

    Documents with contradicting marks are left out, repeated marks count once; of the
    texts of an id that repeats one is taken, the first by a hash. Sums and counts reach
    the driver, and the start's features.
    """
    m = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("good"), F.max(label_col).alias("top")).where("good = top")
    m = stage(m.select(F.col("id").cast("long").alias("id"), F.col("good").cast("int").alias("good")), "marks")
    per = {0: 0, 1: 0, **{r["good"]: r["n"] for r in m.groupBy("good").agg(F.count("*").alias("n")).collect()}}
    marks, rare = sum(per.values()), int(per[1] < per[0])
    groups = max(1, -(-marks // GROUP))
    times = {1 - rare: 1, rare: max(1, min(groups, -(-LEAST * groups // max(per[rare], 1))))}
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    # features are smaller than texts; they are shuffled however few the marks are, so that disk grows as the input does
    all_groups = stage(_groups(_featured(t).join(m.hint("merge"), "id"), groups, times, tasks(docs.sparkSession, marks, LOT, LOT // 8)), "groups")
    some = all_groups.where(F.col("at") < max(1, -(-2 * fit_rows // GROUP))).orderBy("at").collect()
    g, b = (np.concatenate([np.zeros((0, WIDTH)), *(np.frombuffer(r[c]).reshape(-1, WIDTH)[: r[f"n_{c}"]] for r in some)]) for c in ("good", "bad"))
    if not len(g) + len(b):
        return fit_pairs(features(np.zeros(0, np.uint8), np.zeros(2, np.int64)), np.ones(1, bool))
    share = per[0] / max(marks, 1)
    start = fit_pairs(np.concatenate([g, b]), np.arange(len(g) + len(b)) < len(g), share, quantile)
    n = all_groups.agg(F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad")).first()
    if not n["good"] or not n["bad"]:
        return start
    rows = n["good"] + n["bad"]
    off = start.mean
    one, two = np.split(_added(all_groups, lambda g, b, own: np.concatenate([(own - off).sum(0), ((own - off) ** 2).sum(0)]), 2 * WIDTH) / rows, 2)
    spread = np.maximum(np.sqrt(np.maximum(two - one**2, 0)), 1e-3)
    model = QualityModel(off + one, spread, start.weights * spread / start.spread, 0.0)
    last, best = math.inf, model.weights
    for _ in range(40):
        s = _added(all_groups, _pair_sums(model), 2 + WIDTH + WIDTH**2)
        if not s[0]:
            break
        loss = s[1] / s[0] + ridge / 2 * model.weights @ model.weights
        if loss > last + 1e-12:  # too long a step
            model.weights = (model.weights + best) / 2
            continue
        last, best = loss, model.weights
        step = np.linalg.solve(s[2 + WIDTH :].reshape(WIDTH, WIDTH) / s[0] + ridge * np.eye(WIDTH), s[2 : 2 + WIDTH] / s[0] + ridge * best)
        model.weights = best - step
        if np.abs(step).max() < 1e-3:
            break

    def worths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, own in _matrices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(model.worth(own), pa.float64())], names=["v"])
        release_memory()

    v = stage(all_groups.mapInArrow(worths, "v double"), "worths")
    q = math.floor(rows * (share if quantile is None else quantile) + 1e-6)
    lower, upper = (_at_rank(v, i) for i in (max(q - 1, 0), min(q, rows - 1)))
    model.cut = lower - 1e-9 if q == 0 else upper + 1e-9 if q >= rows else lower + 0.25 * (upper - lower)
    return model


def score(model: QualityModel, text: Column, df: DataFrame) -> Column:
    """The score of whole texts; a null text counts as empty."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        parts = _by_piece(col, lambda d, o: held.value.score(features(d, o)))
        release_memory()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(text)


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labelled documents whose remainder by 5 is not 0 and score all: (doc_id, held_out, score, predicted).

    One row per row of ``docs``, repeated rows too; other columns are ignored; an empty
    table gives no rows. A null text counts as empty. A row with a null id is held out. Without labels of
    both kinds all documents are kept (predicted 1), or none if all labels are 0.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(d, labels.where(remainder(F.col("doc_id").cast("long"), 5) != 0))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    out = d.select("doc_id", held.alias("held_out"), score(model, F.col("text"), d).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
