"""Lexical retrieval packing: token windows filled with BM25 neighbours of a seed document.

Every document is tokenised once into a table. Whole windows of a document stand alone, since they have no
room; its tail (what is left) joins the retrieval. BM25 statistics are counted over all documents by token id, so the table
of document frequencies is bounded by the vocabulary. Tails are placed by a projection of their BM25 weights: the nearest of at
most ``cells`` centroids (fitted on about ``fit_tails`` distinct tails), then the signs of what is left, which puts likely neighbours side by
side; ranges of that order are shards of bounded tokens, and each holds an inverted index of its tails. The longest unused tail seeds
a window; all its tokens are the query, and its unused neighbours follow by descending score until the window is full. The last one
is cut and its rest stays in the index. Only a shard's last window can be short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHasher, batch_rows, materialise, mix64, passes, squeeze, unsqueeze


@dataclass(frozen=True)
class PackingParams:
    tokenizer: str  # path of a tokenizers file, readable on every executor
    end_id: int = 1
    window: int = 2048
    shard_tokens: int = 2_000_000
    k1: float = 1.2
    b: float = 0.75
    min_df: int = 2  # least document frequency of a token that places a tail
    dimensions: int = 64  # of the projection that places tails
    cells: int = 1024
    fit_tails: int = 20_000
    cached_words: int = 2_000_000


_DOTS = np.zeros(256, bool)
_DOTS[[ord("."), ord(",")]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class WordTokens:
    """Token ids of texts, from those of their words, which are encoded once each.

    The tokenizer lower-cases and never joins text across ASCII white space, nor a letter or digit with
    full stops and commas after it; so a word's ids are those of its lower-cased stem and of that tail. Stems and tails are
    the units of the cache, told apart by 64-bit hashes; new ones are encoded many together and separated by their offsets.
    A tokenizer that doesn't do so to the sample texts encodes whole texts instead.
    """

    #: Case, full stops and commas, special names, marks that join, scripts without spaces, digits, kinds of space, long words.
    SAMPLES = (
        "Hello, World...  it's 1.5% of\n\n\"THAT\".", "a.b,c <|endoftext|>x <|EndOfText|> y", "é e\u0301 \u0301x ﬁ ß İ ǅ ÉCOLE", "\u3000全角 \u00a0nbsp\u00a0 \x1c \x85 日本語。中文",
        "don't DON'T ...,,, .,a .a. (b.), c.)", " lead\tand\r\ntrail ", "x" * 300, "😀😀. ١٢٣, 12345,678.90", "",
    )

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.hasher = Tokenizer.from_file(path), limit, ByteHasher()
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._clear()
        self.by_word = True
        texts = [x.encode() for x in self.SAMPLES]
        ids, bound = self.encode(texts)
        want, ends = self._whole(texts)
        self.by_word = np.array_equal(ids, want) and np.array_equal(bound, ends)
        self._clear()

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.fromiter((i for g in got for i in g), self.pool.dtype), np.cumsum([0, *map(len, got)])

    def _clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.start = np.zeros(0, _dtype(self.vocab)), np.zeros(1, np.int64)

    def _units(self, raw: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end, hash) of every unit of the lower-cased buffer, in order."""
        space = np.concatenate(([True], _SPACE[low], [True]))
        edges = np.flatnonzero(space[1:] != space[:-1])
        a, b = edges[0::2], edges[1::2]
        solid = np.where(_DOTS[low], -1, np.arange(len(low)))
        np.maximum.accumulate(solid, out=solid)
        last = solid[b - 1]  # of the word's stem
        split = (last >= a) & (last < b - 1) & _LETTER[low[last]]
        count = 1 + split
        at = np.cumsum(count) - count
        first, end = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
        first[at], end[at] = a, np.where(split, last + 1, b)
        first[at[split] + 1], end[at[split] + 1] = last[split] + 1, b[split]
        h = self.hasher.ranges(self.hasher.prefix(low), first, end)
        # Names of special tokens keep their case, and need the word whole.
        special = np.flatnonzero((low[:-1] == ord("<")) & (low[1:] == ord("|")))
        if len(special):
            word = np.unique(np.searchsorted(a, special, "right") - 1)
            keep = np.ones(len(first), bool)
            keep[at[word[split[word]]] + 1] = False
            end[at[word]] = b[word]
            h[at[word]] = mix64(self.hasher.ranges(self.hasher.prefix(raw), a[word], b[word]) + np.uint64(1))
            first, end, h = first[keep], end[keep], h[keep]
        return first, end, h

    def _learn(self, units: list[str], together: int = 500) -> list[list[int]]:
        out: list[list[int]] = []
        groups = [units[a : a + together] for a in range(0, len(units), together)]
        for g, e in zip(groups, self.tokenizer.encode_batch(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            begins = np.cumsum([0, *(len(w) + 1 for w in g)])
            cut = np.searchsorted([o[0] for o in e.offsets], begins).tolist()
            ids = e.ids
            out += [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each)."""
        if not self.by_word:
            return self._whole(texts)
        joined = b"\n".join([*texts, b""])
        raw = np.frombuffer(joined, np.uint8)
        low = _LOWER[raw]
        first, end, h = self._units(raw, low)
        code, every = pd.factorize(h)
        order = np.argsort(every)
        ranked = every[order]
        at = np.searchsorted(self.known, ranked)
        fresh = np.flatnonzero(np.append(self.known, np.uint64(0))[at] != ranked if len(self.known) else np.ones(len(ranked), bool))
        fresh = np.union1d(fresh, np.flatnonzero(at == len(self.known)))
        if len(self.known) and len(self.known) + len(fresh) > self.limit:
            self._clear()
            at, fresh = np.zeros(len(ranked), np.int64), np.arange(len(ranked))
        if len(fresh):
            lead = np.empty(len(every), np.int64)
            lead[code[::-1]] = np.arange(len(code))[::-1]  # a unit of each hash
            small = low.tobytes()
            spans = [(i, int(first[i]), int(end[i])) for i in lead[order[fresh]].tolist()]
            got = self._learn([(joined if b"<|" in small[a:b] else small)[a:b].decode("utf-8", "replace") for _, a, b in spans])
            lens = np.fromiter(map(len, got), np.int64, len(got))
            slots = len(self.start) - 1 + np.arange(len(fresh))
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(lens)))
            self.pool = np.concatenate((self.pool, np.fromiter((i for g in got for i in g), self.pool.dtype, int(lens.sum()))))
            self.known, self.slot = np.insert(self.known, at[fresh], ranked[fresh]), np.insert(self.slot, at[fresh], slots)
            at = np.searchsorted(self.known, ranked)
        slot = np.empty(len(every), np.int64)
        slot[order] = self.slot[at]
        idx = slot[code]
        lens = self.start[idx + 1] - self.start[idx]
        ends = np.concatenate(([0], np.cumsum(lens)))
        ids = self.pool[np.repeat(self.start[idx] - ends[:-1], lens) + np.arange(ends[-1])]
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        return ids, ends[np.searchsorted(first, offsets)]


@lru_cache(maxsize=1)
def _word_tokens(path: str, limit: int) -> WordTokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokens(path, limit)


def _dtype(vocab: int) -> str:
    return "<u2" if vocab <= 65536 else "<u4"


_COUNTS = 0  # width of the rows that hold document frequencies


def _tokeniser(p: PackingParams):
    """Token rows; last of a task, one row with the document frequencies of its tokens (width 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_tokens(p.tokenizer, p.cached_words)
        vocab = max(words.vocab, p.end_id + 1)
        kind = _dtype(vocab)
        width, df, names = int(kind[2]), np.zeros(vocab, np.int64), ["doc_id", "doc_tokens", "ids", "width"]
        for batch in batches:
            for lo, hi in passes(batch.column("n").to_numpy()):
                ids, bound = words.encode([t or b"" for t in batch.column("text")[lo:hi].cast(pa.binary()).to_pylist()])
                pair = np.sort(np.repeat(np.arange(hi - lo), np.diff(bound)) * vocab + ids)
                df += np.bincount(pair[np.concatenate((np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]))] % vocab, minlength=vocab)
                df[p.end_id] += hi - lo
                out = [np.append(ids[a:b], p.end_id).astype(kind).tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array([len(x) // width for x in out], pa.int64()), pa.array(out, pa.binary()), pa.array([width] * (hi - lo), pa.int32())], names)
        if df.any():
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([squeeze(df)], pa.binary()), pa.array([_COUNTS], pa.int32())], names)

    return run


def tokenise(docs: DataFrame, p: PackingParams) -> DataFrame:
    """doc_id, doc_tokens, ids (little-endian unsigned, ``width`` bytes each) of every document; null text is empty. Rows of width 0 hold document frequencies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("n"))
    return rows.mapInArrow(_tokeniser(p), "doc_id long, doc_tokens long, ids binary, width int")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for x in batch.column("ids").to_pylist():
            df = unsqueeze(x, np.int64, 8)
            total = df + total if len(total) else df
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["term", "df"])


def _weights(idf: np.ndarray, tf: np.ndarray, size: np.ndarray, mean: float, p: PackingParams) -> np.ndarray:
    """BM25 weights of terms in tails of ``size`` tokens."""
    return (idf * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * size / mean))).astype(np.float32)


@lru_cache(maxsize=2)
def _directions(vocab: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((vocab, dimensions), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def tail_vectors(tails: list[np.ndarray], idf: np.ndarray, mean: float, p: PackingParams) -> np.ndarray:
    """A unit row for each tail: its BM25 weights along random directions of the terms. Zero if all its terms have idf 0."""
    size = np.fromiter(map(len, tails), np.int64, len(tails))
    s = np.sort(np.concatenate(tails).astype(np.int64) + np.repeat(np.arange(len(tails)) * len(idf), size))
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    row, term = np.divmod(s[at], len(idf))
    weight = _weights(idf[term], np.diff(at, append=len(s)), size[row], mean, p)
    return _unit(np.add.reduceat(_directions(len(idf), p.dimensions)[term] * weight[:, None], np.searchsorted(row, np.arange(len(tails)))))


def _batch_vectors(batch: pa.RecordBatch, idf: np.ndarray, mean: float, p: PackingParams) -> np.ndarray:
    tails = [np.frombuffer(x.as_buffer(), f"<u{w}") for x, w in zip(batch.column("tail"), batch.column("width").to_pylist(), strict=True)]
    return np.concatenate([tail_vectors(tails[lo:hi], idf, mean, p) for lo, hi in passes(np.fromiter(map(len, tails), np.int64, len(tails)), 200_000)])


def _sampler(idf: np.ndarray, mean: float, p: PackingParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in _batch_vectors(batch, idf, mean, p)], pa.binary())], ["v"])

    return run


def fit_cells(vectors: np.ndarray, cells: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(mean, unit centroids of the rows less it, like ones side by side). The order of the rows doesn't matter."""
    vectors = np.unique(vectors[vectors.any(axis=1)], axis=0)
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1], np.float32)
    x = _unit(vectors - mean)
    c = x[np.random.default_rng(19).permutation(len(x))[:cells]]
    for _ in range(rounds if len(c) else 0):
        at = np.concatenate([(x[i : i + 2048] @ c.T).argmax(axis=1) for i in range(0, len(x), 2048)])  # all at once: 80 MB in the driver
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(np.bincount(at, minlength=len(c))[:, None] > 0, _unit(total), c)

    # Average linkage: the two likest groups join, and lie side by side in the order.
    like, size, order = c @ c.T, np.ones(len(c)), [[i] for i in range(len(c))]
    np.fill_diagonal(like, -np.inf)
    for _ in range(len(c) - 1):
        i, j = sorted(np.unravel_index(like.argmax(), like.shape))
        joined = (like[i] * size[i] + like[j] * size[j]) / (size[i] + size[j])
        like[i], like[:, i] = joined, joined
        like[i, i] = like[j] = like[:, j] = -np.inf
        size[i] += size[j]
        order[i] += order[j]
    return mean, c[order[0]] if len(c) else c


def places(vectors: np.ndarray, mean: np.ndarray, cells: np.ndarray, bits: int = 12) -> np.ndarray:
    """Where tails go in the order of shards: by cell, then by the signs of what the cell leaves; -1 for those without a direction."""
    if not len(cells):
        return np.full(len(vectors), -1)
    x = _unit(vectors - mean)
    cell = (x @ cells.T).argmax(axis=1)
    signs = (x - cells[cell])[:, :bits] > 0
    return np.where(vectors.any(axis=1), (cell << bits) + signs @ (1 << np.arange(signs.shape[1])), -1)


def _placer(idf: np.ndarray, mean: float, p: PackingParams, centre: np.ndarray, cells: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("place", pa.array(places(_batch_vectors(batch, idf, mean, p), centre, cells), pa.int64()))

    return run


class ShardIndex:
    """Inverted BM25 index of the tails of one shard: postings of rare tokens, whole rows of weights of common ones."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, p: PackingParams):
        self.count, self.tails = len(tails), tails
        vocab = len(idf)
        size = np.fromiter(map(len, tails), np.int64, len(tails))
        doc = np.repeat(np.arange(len(tails)), size)
        s = np.sort(np.concatenate(tails).astype(np.int64) * len(tails) + doc)
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
        tf = np.diff(at, append=len(s))
        term, self.doc = np.divmod(s[at], len(tails))
        self.weight = _weights(idf[term], tf, size[self.doc], mean, p)
        df = np.bincount(term, minlength=vocab)
        self.first = np.concatenate(([0], np.cumsum(df)))
        self.row = np.full(vocab, -1)
        common = np.flatnonzero(df * 16 > len(tails))
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), len(tails)), np.float32)
        dense = np.flatnonzero(self.row[term] >= 0)
        self.rows[self.row[term[dense]], self.doc[dense]] = self.weight[dense]

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused tails with a score above 0, best first (of equal ones the first)."""
        terms = np.sort(self.tails[seed])
        terms = terms[np.concatenate(([True], terms[1:] != terms[:-1]))]
        row = self.row[terms]
        score = self.rows[row[row >= 0]].sum(axis=0)
        rare = terms[row < 0]
        a, n = self.first[rare], self.first[rare + np.ones(1, np.int64)] - self.first[rare]
        ends = np.cumsum(n)
        if len(ends) and ends[-1]:
            at = np.repeat(a - (ends - n), n) + np.arange(ends[-1])
            score += np.bincount(self.doc[at], self.weight[at], self.count).astype(np.float32)
        score[~unused] = 0
        found = np.flatnonzero(score)
        if len(found) > 16:
            head = found[np.argpartition(-score[found], 15)[:16]]
            head = found[score[found] >= score[head].min()]  # with all ties of the last
        else:
            head = found
        yield from head[np.argsort(-score[head], kind="stable")]
        if len(found) > len(head):
            rest = np.setdiff1d(found, head)
            yield from rest[np.argsort(-score[rest], kind="stable")]


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean: float, p: PackingParams) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, start in it, length); every token of every tail lies in one of them."""
    index = ShardIndex(tails, idf, mean, p)
    left = np.fromiter(map(len, tails), np.int64, len(tails))
    begun = np.zeros(len(tails), np.int64)
    unused = left > 0
    window, room = [], p.window
    for seed in np.argsort(-left, kind="stable"):
        while unused[seed]:  # a seed that starts in what another left open is cut there and goes on
            query = seed
            for i in (i for group in ([seed], index.neighbours(query, unused)) for i in group):
                if not unused[i]:
                    continue
                n = int(min(room, left[i]))
                window.append((int(i), int(begun[i]), n))
                begun[i] += n
                left[i] -= n
                unused[i] = left[i] > 0
                room -= n
                if not room:
                    yield window
                    window, room = [], p.window
                    break
    if window:
        yield window


def _packer(idf: np.ndarray, mean: float, p: PackingParams):
    """Shards of about ``shard_tokens`` tokens, cut from the sorted rows of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, held = TaskContext.get().partitionId() << 32, [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
            tails = [np.frombuffer(r[2], f"<u{r[3]}") for r in rows]
            out: list[tuple] = []
            for window in pack_shard(tails, idf, mean, p):
                offset = 0
                for i, start, n in window:
                    out.append((rows[i][0], rows[i][1] - len(tails[i]) + start, n, rows[i][1], number, offset, tails[i][start : start + n].astype("<u4").tobytes()))
                    offset += n
                number += 1
                if len(out) > 2000:
                    yield _pieces(out)
                    out = []
            if out:
                yield _pieces(out)

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "tail", "width")), strict=True):
                rows.append(r)
                held += len(r[2]) // r[3]
                if held >= p.shard_tokens:
                    yield from shard()
                    rows, held = [], 0
        if rows:
            yield from shard()

    return run


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_NAMES = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pieces(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], list(_NAMES))


def _windows(p: PackingParams):
    """The whole windows of each document, sequences of their own (their ids have bit 62 set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (1 << 62) | (TaskContext.get().partitionId() << 32)
        for batch in batches:
            out: list[tuple] = []
            for d, n, x, w in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "width")), strict=True):
                ids = np.frombuffer(x, f"<u{w}")
                for start in range(0, n - p.window + 1, p.window):
                    out.append((d, start, p.window, n, number, 0, ids[start : start + p.window].astype("<u4").tobytes()))
                    number += 1
                if len(out) > 2000:
                    yield _pieces(out)
                    out = []
            if out:
                yield _pieces(out)

    return run


def pack(docs: DataFrame, p: PackingParams) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)``: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids are little-endian unsigned 32-bit numbers. Each token id, end id included, lies in one piece; in a
    sequence the offsets leave no gap and no sequence is longer than the window. Null and empty texts
    are their end id alone; a text of any length is tokenised whole. Rows that repeat a doc_id are packed each, with a null one too.
    Of neighbours of equal score the smaller doc_id comes first. Further columns are ignored, whatever their names; an empty table gives no piece.
    """
    with batch_rows(docs.sparkSession):
        tokens = materialise(tokenise(docs, p))
    documents = tokens.where(F.col("width") > _COUNTS)
    whole = F.col("doc_tokens") - F.col("doc_tokens") % p.window
    tails = documents.where(F.col("doc_tokens") % p.window > 0).select("doc_id", "doc_tokens", F.expr(f"substring(ids, int((doc_tokens - doc_tokens % {p.window}) * width) + 1)").alias("tail"), "width")
    windows = documents.where(whole > 0).mapInArrow(_windows(p), _PIECES)
    rest = F.col("doc_tokens") % p.window
    every, n, total = documents.agg(F.count("*"), F.count_if(rest > 0), F.coalesce(F.sum(rest), F.lit(0))).first()
    if not n:
        return windows
    counts = tokens.where(F.col("width") == _COUNTS).mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term = counts["term"].to_numpy()
    df = np.zeros(int(term.max()) + 1)
    df[term] = counts["df"].to_numpy()
    idf = np.log1p((every - df + 0.5) / (df + 0.5))
    telling = np.where((df >= p.min_df) & (df < every), idf, 0)
    mean = total / n
    share = int(min(1.0, p.fit_tails / n) * (1 << 40))
    fitted = tails.where(F.pmod(F.xxhash64("doc_id", "tail"), F.lit(1 << 40)) < share).mapInArrow(_sampler(telling, mean, p), "v binary").distinct().toArrow()
    centre, cells = fit_cells(np.frombuffer(b"".join(fitted["v"].to_pylist()), np.float32).reshape(-1, p.dimensions), p.cells)
    with batch_rows(docs.sparkSession):
        placed = materialise(tails.mapInArrow(_placer(telling, mean, p, centre, cells), "doc_id long, doc_tokens long, tail binary, width int, place long"))
    shards = max(1, -(-total // p.shard_tokens))
    spread = F.xxhash64("doc_id", "tail")  # parts a place that a large share of all tails has
    ranged = placed.repartitionByRange(shards, "place", spread).sortWithinPartitions("place", "doc_id", "doc_tokens")
    return windows.union(ranged.mapInArrow(_packer(idf, mean, p), _PIECES))
