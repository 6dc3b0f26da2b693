"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of bits. For every bit a binary classifier on hashed
byte bigrams and 4-grams (log odds of "languages with 1 here" against the rest)
gives a margin; decoding sums, over bits, the logistic loss of the margin against a
codeword's bit, weighted by how well the bit's classifier does on the fitting texts,
and takes the language of least loss. Close runners-up are flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.shingles import pieces, text_buffers
from panelcast.llm.util import chance

#: Fitting texts of each language (expected number of a sample by id hash): the bound of the model's sample.
FIT_ROWS = 2000
SIZE = 1 << 17
#: Bytes of a long text that are looked up at once.
PART = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1. Up to 6: the exhaustive code of 2**(k-1) - 1 bits; beyond: 8 * ceil(log2 k) + 8 bits of a fixed hash."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        bits = [[1 if (j >> i) & 1 else -1 for i in range(k)] for j in range(1, 2 ** (k - 1))]
        return np.array(bits, float).T
    rng = np.random.default_rng(20_240_601)
    best, far = None, -1
    for _ in range(64):  # the draw with the largest least distance
        m = np.where(rng.random((k, 8 * math.ceil(math.log2(k)) + 8)) < 0.5, -1.0, 1.0)
        m = m[:, np.abs(m.sum(0)) < k]
        d = int(min(((m[i] != m[j]).sum() for i in range(k) for j in range(i)), default=0))
        if d > far:
            best, far = m, d
    return best


def grams(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For every byte the number of the bigram and of the 4-gram that begin there; SIZE where one would leave its text."""
    low = _FOLD[data].astype(np.uint32)
    n, out = len(low), []
    for k in (2, 4):
        g = np.full(n, SIZE, np.int64)
        if n >= k:
            x = low[: n - k + 1].copy()
            for i in range(1, k):
                x = (x << np.uint32(8)) | low[i : n - k + 1 + i]
            g[: n - k + 1] = x if k == 2 else (x * np.uint32(2654435761) >> np.uint32(16)) + np.uint32(1 << 16)
        for i in range(1, k):
            e = offs[1:] - i
            g[e[e >= offs[:-1]]] = SIZE
        out.append(g)
    return out


def parts(data: np.ndarray, offs: np.ndarray) -> Iterator[list[np.ndarray]]:
    """``grams`` of a piece; those of a single long text in parts, so that memory stays bounded."""
    if len(offs) != 2 or len(data) <= 2 * PART:
        yield grams(data, offs)
        return
    for s in range(0, len(data), PART):
        part = data[s : s + PART + 3]
        yield [g[:PART] for g in grams(part, np.array([0, len(part)]))]


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a character of a Unicode letter category."""
    ascii_at = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = ascii_at[offs[1:]] > ascii_at[offs[:-1]]
    for i in np.flatnonzero(~out):
        part = data[offs[i] : offs[i + 1]]
        out[i] = bool((part > 127).any()) and any(map(str.isalpha, part.tobytes().decode("utf-8", "replace")))
    return out


@dataclass
class LanguageModel:
    """langs in code point order, their codewords, weights of grams for each bit, and each bit's scale and vote."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    vote: np.ndarray

    def margins(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean log odds of each text's grams for each bit."""
        out = np.zeros((len(offs) - 1, self.codes.shape[1]))
        full = np.flatnonzero(np.diff(offs) > 1)
        if not len(full):
            return out
        for gs in parts(data, offs):
            at = offs[:-1][full] if len(offs) > 2 else np.zeros(1, np.int64)
            for g in gs:
                out[full] += np.add.reduceat(self.weights[g], at, axis=0, dtype=np.float64)
        return out / np.maximum(np.diff(offs), 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        z = margins / self.scale
        return np.stack([(np.logaddexp(0, -4 * z * c) * self.vote).sum(1) for c in self.codes], 1)

    def predict(self, col: pa.Array, gap: float) -> pa.StructArray:
        names = np.array([*self.langs, "und"], object)
        parts: list[tuple] = []
        data, offs = text_buffers(col)
        for i, j in pieces(offs):
            d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            loss = self.losses(self.margins(d, o)) if self.langs else np.zeros((j - i, 1))
            e = np.exp(loss.min(1)[:, None] - loss)
            p = e / e.sum(1)[:, None]
            top = np.sort(p, 1)
            known = has_letter(d, o) & bool(self.langs)
            near = known & (p.shape[1] > 1) & ((top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)) < gap)
            parts.append((names[np.where(known, p.argmax(1), len(self.langs))], np.where(known, top[:, -1], 0.0), near))
        cols = [np.concatenate(x) if parts else np.zeros(0) for x in zip(*parts, strict=True)] if parts else [[], [], []]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], ["lang_pred", "score", "ambiguous"])


def _count(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for lang, part in zip(*_by_lang(batch), strict=True):
                data, offs = text_buffers(part)
                c = held.setdefault(lang, np.zeros(SIZE + 1, np.int64))
                for i, j in pieces(offs):
                    for gs in parts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                        c += sum(np.bincount(g, minlength=SIZE + 1) for g in gs)
        for lang, c in held.items():
            at = np.flatnonzero(c[:SIZE])
            yield pa.RecordBatch.from_arrays([pa.array([langs.index(lang)] * len(at), pa.int32()), pa.array(at), pa.array(c[at])], names=["lang", "gram", "n"])

    return run


def _by_lang(batch: pa.RecordBatch) -> tuple[list[str], list[pa.Array]]:
    langs = batch.column(0).unique().to_pylist()
    return langs, [batch.column(1).filter(pa.compute.equal(batch.column(0), x)) for x in langs]


def _margins(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in zip(*_by_lang(batch), strict=True):
                data, offs = text_buffers(part)
                z = np.concatenate([model.margins(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in pieces(offs)])
                right = z * model.codes[model.langs.index(lang)]
                sums = np.stack([np.abs(z).sum(0), (right > 0).sum(0), np.full(z.shape[1], len(z))])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(z.shape[1])), *map(pa.array, sums.astype(float))], names=["bit", "mag", "ok", "n"])

    return run


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on a sample of about ``fit_rows`` texts of each language of ``train``, chosen by a hash of the id.

    Rows with a null text or language are left out. A sample that holds no text (chance
    may do that where ``fit_rows`` is tiny) gives a model that knows no difference. What reaches the driver is one
    count for each language and gram, at most SIZE for each language.
    """
    t = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    per = {r["lang"]: r["n"] for r in t.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    k = len(langs)
    model = LanguageModel(langs, codewords(k), np.zeros((SIZE + 1, 1), np.float32), np.ones(1), np.ones(1))
    if k < 2:
        return model
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(fit_rows / per[lang]))])
    t = t.where(chance(F.lit("fit"), "id") < share[F.col("lang")]).select("lang", "text")
    got = t.mapInArrow(_count(langs), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    c = np.zeros((k, SIZE))
    c[got["lang"].to_numpy(), got["gram"].to_numpy()] = got["n"].to_numpy()
    p = (c + 0.5) / (c.sum(1)[:, None] + 0.5 * SIZE)
    w = [np.log(p[b > 0].mean(0) / p[b < 0].mean(0)) for b in model.codes.T]
    model.weights = np.concatenate([np.stack(w, 1), np.zeros((1, len(w)))]).astype(np.float32)
    model.scale, model.vote = np.ones(len(w)), np.ones(len(w))
    s = t.mapInArrow(_margins(model), "bit long, mag double, ok double, n double").groupBy("bit").agg(F.sum("mag").alias("mag"), F.sum("ok").alias("ok"), F.sum("n").alias("n")).toPandas().set_index("bit").reindex(range(len(w))).fillna(0)
    n = np.maximum(s["n"].to_numpy(), 1)
    model.scale = np.where(s["n"] > 0, np.maximum(s["mag"].to_numpy() / n, 1e-9), 1)
    vote = np.maximum(s["ok"].to_numpy() / n - 0.5, 0.01)
    model.vote = vote / vote.mean()
    return model


def language(model: LanguageModel, text: Column, df: DataFrame, gap: float = 0.2) -> Column:
    """struct(lang_pred, score, ambiguous) of whole texts; ``und`` and 0 for null texts and those without a letter."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predict(col: pa.Array) -> pa.Array:
        return held.value.predict(col, gap)

    return predict(text)


def remainder(id_col: Column, n: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def predict_held_out(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on documents whose remainder by 3 is not 1 and predict all.

    One row per row of ``docs``, repeated rows too. A row with a null id is held out
    and never learned from. With no labelled row every prediction is ``und``; an
    empty table gives no rows; other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(True))
    model = fit(d.where(~held), fit_rows=fit_rows)
    return d.select("doc_id", held.alias("held_out"), language(model, F.col("text"), d).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")
