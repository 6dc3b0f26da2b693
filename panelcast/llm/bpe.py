"""Byte-level BPE of whole texts by corpus-level merge replay.

Texts are cut by the vocabulary's pattern. Blocks of texts become numbers of their
distinct pieces; pieces that are tokens themselves are known at once. All other pieces
of the corpus meet in buckets of pieces, so each distinct one is encoded once for the
whole corpus (or once for each part of some 64 GB of text, in larger ones):
their bytes stand in one array with links to their neighbours, and an inverted index
leads from a rank to the positions whose token pair has it. Ranks are replayed in rising
order; each is applied at all its positions at once, and only pairs of the touched
neighbours are looked up and entered in the index again. The tokens then join their
blocks, whose texts are put together from them.

Rising ranks equal "lowest rank first, leftmost first" in each piece unless a merge
makes a pair of lower rank than its own; pieces where that happens are noticed and
encoded alone, by a heap of their pairs.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.util import release_memory, stage, tasks

NONE = np.int32(2**31 - 1)
#: Characters of text of a block and of a row of it, and bytes of pieces that are replayed together.
BLOCK_CHARS, ROW_CHARS, REPLAY_BYTES = 16 << 20, 1 << 19, 6 << 20
#: Pairs of bytes that are looked up at once as a replay begins.
PAIR_LOT = 1 << 18
#: Most bytes of text whose pieces make a bucket, and least if that leaves cores idle.
BUCKET_MOST, BUCKET_LEAST = 128 << 20, 64 << 20
#: Most buckets: a block has a row for each. Beyond, a bucket's blocks are dealt to several tasks, each of which encodes its pieces.
BUCKETS = 512


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Decoder:
    """Ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.lens = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.starts = np.cumsum(self.lens) - self.lens

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        ln = self.lens[ids]
        ends = np.cumsum(ln)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - ln), ln)].tobytes()


class MergeReplay(Decoder):
    """Encodes many pieces together; ``ranks`` must hold all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [((ranks[t[:i]] << 32) | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [2**62], np.int64)
        self.rank_of = np.array([p[1] for p in pairs] + [0], np.int32)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = (a.astype(np.int64) << 32) | b
        i = np.searchsorted(self.keys, k)
        return np.where(self.keys[i] == k, self.rank_of[i], NONE)

    def alone(self, word: bytes) -> list[int]:
        """One piece, lowest rank first: for the few that cannot be replayed."""
        n, ids = len(word), self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[j]])
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if nxt[i] != j or ids[i] < 0 or rank(i, j) != r:
                continue  # one of the two has merged since
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (q := rank(x, y)) is not None:
                    heapq.heappush(heap, (q, x, y))
        return [x for x in ids if x >= 0]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one after the other, and each word's number of tokens."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        lens = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lens) - lens
        n = int(lens.sum())
        tok = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[starts + lens - 1], prv[starts] = n, -1
        pr = np.full(n, NONE, np.int32)
        for k in range(0, n - 1, PAIR_LOT):
            e = min(k + PAIR_LOT, n - 1)
            pr[k:e] = np.where(nxt[k:e] < n, self.pair_rank(tok[k:e], tok[k + 1 : e + 1]), NONE)
        odd: list[np.ndarray] = []
        for w in np.flatnonzero(whole >= 0).tolist():
            s, e = starts[w], starts[w] + lens[w]
            pr[s:e], tok[s:e], tok[s] = NONE, -1, whole[w]
        self._replay(n, tok, nxt, prv, pr, odd)
        alive = tok >= 0
        counts = np.add.reduceat(alive.astype(np.int64), starts)
        if odd:
            fix = np.unique(np.searchsorted(starts, np.concatenate(odd), side="right") - 1)
            toks = np.split(tok[alive], np.cumsum(counts)[:-1])
            for w in fix.tolist():
                toks[w] = np.array(self.alone(words[w]), np.int32)
                counts[w] = len(toks[w])
            return np.concatenate(toks), counts
        return tok[alive], counts

    def _replay(self, n, tok, nxt, prv, pr, odd) -> None:
        at = np.flatnonzero(pr < NONE)
        if not len(at):
            return
        at = at[np.argsort(pr[at], kind="stable")]
        r = pr[at]
        cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        index = {int(r[c]): [x] for c, x in zip(cut, np.split(at, cut[1:]), strict=True)}
        heap = list(index)  # sorted, so it is a heap
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            pos = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            pos = pos[pr[pos] == rank]
            if not len(pos):
                continue
            q = nxt[pos]
            if (pr[q] == rank).any():  # overlapping pairs, as in aaaa: leftmost first
                keep, taken = [], -1
                for p, x in zip(pos.tolist(), q.tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = x
                pos = np.array(keep)
                q = nxt[pos]
            old = tok[pos]
            tok[pos], tok[q], pr[q] = rank, -1, NONE
            after = nxt[q]
            nxt[pos] = after
            r1, p1 = after < n, pos[after < n]
            a1 = after[r1]
            prv[a1] = p1
            rights = self.pair_rank(tok[p1], tok[a1])
            pr[pos] = NONE
            pr[p1] = rights
            before = prv[pos]
            p2 = pos[before >= 0]
            b2 = before[before >= 0]
            lefts = self.pair_rank(tok[b2], tok[p2])
            pr[b2] = lefts
            for where, made in ((p1, rights), (b2, lefts)):
                if (made < rank).any():
                    odd.append(where[made < rank])
            if len(p1):  # between neighbouring merges the left one met the right one's first token
                i = np.searchsorted(pos, a1)
                near = (i < len(pos)) & (pos[np.minimum(i, len(pos) - 1)] == a1)
                if near.any():
                    met = self.pair_rank(np.full(int(near.sum()), rank), old[i[near]])
                    if (met < rank).any():
                        odd.append(p1[near][met < rank])
            where, made = np.concatenate([p1, b2]), np.concatenate([rights, lefts])
            new = (made > rank) & (made < NONE)
            if new.any():
                where, made = where[new], made[new]
                for x in np.unique(made).tolist():
                    if x not in index:
                        index[x] = []
                        heapq.heappush(heap, x)
                    index[x].append(np.unique(where[made == x]))


def piece_pattern(pattern: str) -> regex.Pattern:
    """White space as the Unicode property, which leaves out the separators 0x1C-0x1F."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class _Index(dict):
    """Piece to number, in order of first sight."""

    def __missing__(self, k: str) -> int:
        self[k] = v = len(self)
        return v


#: Rows of a block: the tokens of its pieces as far as known, its unknown pieces by bucket, and its texts as piece numbers.
KNOWN, PIECE, TEXT = 0, 1, 2
_NAMES = ["block", "kind", "no", "ids", "one", "two", "three"]
_KINDS = [pa.int64(), pa.int8(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
_SCHEMA = "block long, kind tinyint, no long, ids array<long>, one binary, two binary, three binary"


#: Pieces of a block whose numbers fit one byte; times in a block from which on a piece is numbered by frequency; level of compression.
OFTEN, REPEATED, LEVEL = 255, 8, 12


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)


def squeeze(a: np.ndarray) -> bytes:
    """Integers of 32 bits, compressed byte by byte: most of their high bytes are alike."""
    return zstandard.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), LEVEL)


def squeeze_codes(a: np.ndarray) -> tuple[bytes, bytes]:
    """Piece numbers as bytes below OFTEN, and the rest of them."""
    return zstandard.compress(np.minimum(a, OFTEN).astype(np.uint8).tobytes(), LEVEL), squeeze(a[a >= OFTEN] - OFTEN)


def expand_codes(small: bytes, rest: bytes) -> np.ndarray:
    a = np.frombuffer(zstandard.decompress(small), np.uint8).astype(np.int64)
    a[a == OFTEN] = expand(rest).astype(np.int64) + OFTEN
    return a


def expand(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").reshape(-1)


def _cut(raw, pattern: str, buckets: int):
    """Texts to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ranks = piece_pattern(pattern).findall, {b.decode(): r for b, r in load_ranks(raw.value).items() if _is_text(b)}
        block, index, size = TaskContext.get().partitionId() << 32, _Index(), 0
        ids, lens, codes, cuts, chars = [], [], [], [0], 0

        def end() -> Iterator[pa.RecordBatch]:
            words = [k.encode() for k in index]
            known = np.fromiter((ranks.get(k, -1) for k in index), np.int64, len(index))
            of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            # repeated pieces come first, the most frequent ahead, all others by bucket and bytes: both compress well
            count = np.bincount(flat, minlength=len(words))
            often = np.argsort(-count, kind="stable")[: max(OFTEN, int((count >= REPEATED).sum()))]
            rest = np.setdiff1d(np.arange(len(words)), often)
            order = [often, *(np.array(sorted(at.tolist(), key=words.__getitem__), np.int64) for _, at in _groups(rest, of))]
            order = np.concatenate(order)
            number = np.empty_like(order)
            number[order] = np.arange(len(order))
            rows = [(block, KNOWN, 0, None, squeeze(known[order] + 1), None, None)]
            new = order[known[order] < 0]
            for k, at in _groups(new, of):
                own = [words[i] for i in at.tolist()]
                rows.append((block, PIECE, k, None, squeeze(number[at]), squeeze(np.array([len(w) for w in own])), zstandard.compress(b"".join(own), LEVEL)))
            yield _rows(rows)
            ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            for i, j in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                if i < j:
                    yield _rows([(block, TEXT, i, ids[i:j], squeeze(np.array(lens[i:j])), *squeeze_codes(number[flat[ends[i] : ends[j]]]))])
            for x in (ids, lens, codes, index):
                x.clear()
            cuts[:] = [0]
            del words, flat, order, number
            release_memory()

        for rows in (batch.slice(k, 500) for batch in batches for k in range(0, batch.num_rows, 500)):
            for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                p = find(t) if t else []
                ids.append(i)
                lens.append(len(p))
                codes.append(np.fromiter(map(index.__getitem__, p), np.uint32, len(p)))
                size, chars = size + len(t or ""), chars + len(t or "")
                if chars > ROW_CHARS:
                    cuts.append(len(ids))
                    chars = 0
                if size > BLOCK_CHARS:
                    yield from end()
                    block, size, chars = block + 1, 0, 0
        if ids:
            yield from end()
        release_memory()

    return run


def _groups(at: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its positions in their order) of the positions ``at``."""
    at = at[np.argsort(of[at], kind="stable")]
    cut = np.flatnonzero(np.diff(of[at])) + 1
    for part in np.split(at, cut) if len(at) else []:
        yield int(of[part[0]]), part


def _is_text(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


def _split(flat: bytes, lens: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lens).tolist()
    return [flat[e - n : e] for e, n in zip(ends, lens.tolist(), strict=True)]


def _encode_pieces(raw):
    """Rows of unknown pieces, those of a bucket together, with tokens in place of bytes; each distinct piece is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, now, held, index, size = MergeReplay(load_ranks(raw.value)), None, [], {}, 0

        def flush() -> pa.RecordBatch:
            toks, counts = replay.encode(list(index))
            first, rows = np.cumsum(counts) - counts, []
            for block, no, numbers, at in held:
                c = counts[at]
                e = np.cumsum(c)
                own = toks[np.arange(int(e[-1])) + np.repeat(first[at] - (e - c), c)]
                rows.append((block, PIECE, no, None, numbers, squeeze(c), squeeze(own)))
            return _rows(rows)

        for batch in batches:
            for block, no, numbers, lens, flat in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (no != now or size > REPLAY_BYTES):
                    yield flush()
                    held, index, size = [], {}, 0
                lens, now, before = expand(lens), no, len(index)
                words = _split(zstandard.decompress(flat), lens)
                at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
                size += int(lens[at >= before].sum())
                held.append((block, no, numbers, at))
        if held:
            yield flush()
        index.clear()
        release_memory()

    return run


def _put_together(raw, decode: bool):
    """Rows of a block in order of their kind: its tokens, then its texts, which come out as ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_tokens", "ids", "decoded"][: 3 + decode]
        decoder = Decoder(load_ranks(raw.value)) if decode else None
        now, known, pieces, joined = None, None, [], None
        for batch in batches:
            for block, kind, _, ids, one, two, three in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    now, known, pieces, joined = block, np.zeros(0, np.int64), [], None
                if kind == KNOWN:
                    known = expand(one).astype(np.int64) - 1
                elif kind == PIECE:
                    pieces.append((expand(one), expand(two), expand(three)))
                else:
                    joined = joined or _joined(known, pieces)
                    toks, first, lens = joined
                    d, of = expand_codes(two, three), expand(one).astype(np.int64)
                    c = lens[d]
                    e = np.cumsum(c)
                    all_ids = toks[np.arange(int(e[-1]) if len(e) else 0) + np.repeat(first[d] - (e - c), c)]
                    ends = np.concatenate([[0], e])[np.cumsum(of)]
                    counts = np.diff(ends, prepend=0)
                    cols = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(_split(all_ids.astype("<u4").tobytes(), counts * 4), pa.binary())]
                    if decode:
                        sizes = np.concatenate([[0], np.cumsum(decoder.lens[all_ids])])[ends]
                        cols.append(pa.array(_split(decoder.decode(all_ids), np.diff(sizes, prepend=0)), pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=names)
        release_memory()

    return run


def _joined(known: np.ndarray, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a block's pieces, and each piece's first token and number of tokens."""
    lens = np.ones(len(known), np.int64)
    for no, counts, _ in pieces:
        lens[no] = counts
    first = np.cumsum(lens) - lens
    toks = np.zeros(int(lens.sum()), np.int64)
    toks[first[known >= 0]] = known[known >= 0]
    for no, counts, own in pieces:
        c = counts.astype(np.int64)
        toks[np.arange(len(own)) + np.repeat(first[no] - (np.cumsum(c) - c), c)] = own
    return toks, first, lens


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, n_tokens, ids as little-endian uint32 bytes [, decoded bytes]) of every whole text.

    A null text counts as empty and has no tokens; each row comes out once, whatever
    its id; an empty table gives no rows. The rank file is sent to the tasks, so
    executors need no copy of it.
    """
    with open(rank_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spark = d.sparkSession
    wanted = tasks(spark, d.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"], BUCKET_MOST, BUCKET_LEAST)
    buckets = min(wanted, BUCKETS)
    split = F.pmod(F.xxhash64("block"), F.lit(-(-wanted // buckets)))
    cut = stage(d.mapInArrow(_cut(raw, pattern, buckets), _SCHEMA), "pieces")
    own = F.col("kind") == PIECE
    # explicit numbers of tasks, since few bytes mean much work here
    pieces = cut.where(own).select("block", "no", "one", "two", "three").repartition(3 * wanted, "no", split).sortWithinPartitions("no", "block")
    known = cut.where(~own).unionByName(pieces.mapInArrow(_encode_pieces(raw), _SCHEMA))
    blocks = known.repartition(tasks(spark, cut.where(F.col("kind") == KNOWN).count(), 4, 1), "block").sortWithinPartitions("block", "kind")
    schema = "id long, n_tokens long, ids binary" + ", decoded binary" * decode
    return blocks.mapInArrow(_put_together(raw, decode), schema).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Digests of ids and of the bytes decoded from them, one row per document."""
    e = encode_texts(docs, rank_file, pattern, decode=True)
    return e.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
