"""Text scoring by online logistic context mixing, and a smoothed unigram base beside it.

The model reads the lower-cased UTF-8 bytes of a text and an end symbol (byte 255, which UTF-8 never has),
bit by bit. Each predictor looks up a context (the last four bytes; the last two and the last two of the word
before; the word so far; the last three) and the bits of the current byte seen so far, as logits of counts over
all learning documents. A gated set of weights (one for each bit position and for whether the word so far is
known) combines them, is trained online after every bit, and an adaptive probability map refines the mixed probability. Weights and map start
with a document and are carried through to its end, so every byte's probability depends on the text before
it alone. Many documents advance together as vectors; a block takes as many steps as its longest document
has bytes, so texts of like length share blocks.

What is counted grows with the corpus. Contexts are exact but for the word so far, which is 36 bits of its
hash. A block sends each of its (context, next byte) pairs once, with the count in its learning documents, to a range of
the context, and gets back the eight logits on the byte's path; no pair is hot, since a range gets it at most
once from each block. Word counts of the base go the same way, by 64-bit word hashes. So nothing the size of
the vocabulary or of the contexts meets in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHasher, hashed_words, materialise, passes, squeeze, unsqueeze


@dataclass(frozen=True)
class MixingLmParams:
    block_bytes: int = 8_000_000
    sorted_bytes: int = 32_000_000  # texts that are sorted by length before blocks are cut
    range_bytes: int = 64_000_000
    context_range_bytes: int = 24_000_000
    lanes: int = 8192
    rate: float = 0.006
    first_weight: float = 0.25
    map_rate: float = 0.02
    prior: float = 0.4  # pseudo-count of a bit
    alpha: float = 0.1  # of the base


PREDICTORS = 4
END = 255
_WORD_PREDICTOR = 2
_CONTEXT_BITS = 36
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SLICE = 1 << 20  # bytes whose keys are held at once; a key and a count up to this fit 64 bits
_CHUNK = 1 << 17  # bytes whose contexts are worked out at once, small enough for a core's cache
_FREE = np.uint64(2**64 - 1)  # no key
_HASHERS: dict[int, ByteHasher] = {}


def _hasher() -> ByteHasher:
    return _HASHERS.setdefault(0, ByteHasher())


def _joined(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(t.replace(b"\xff", b"\xfe") + b"\xff" for t in texts), np.uint8)


class Contexts:
    """Keys (context above, byte in the low eight bits) of every byte of ``buf``; texts in it end with the end symbol, which resets contexts."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        n = len(buf)
        ends = np.flatnonzero(buf == END)
        self.origin = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else np.zeros(0, np.int64)
        self.padded = np.concatenate((np.full(4, END, np.uint8), buf))
        cut = np.flatnonzero(_SPACE[buf[:-1]] | (buf[:-1] == END)) + 1 if n else np.zeros(0, np.int64)
        self.word = np.concatenate((np.zeros(min(1, n), np.int64), cut))
        self.letters = np.diff(self.word, append=n)
        self.last = self._last_four()

    def _last_four(self) -> np.ndarray:
        """The four bytes before each byte, the nearest highest; the end symbol before a text begins."""
        n = len(self.buf)
        x = np.empty(n, np.uint32)
        for k in range(min(4, n)):
            x[k::4] = np.frombuffer(self.padded, "<u4", (n - k + 3) // 4, k)
        for k in range(3):
            at = self.origin + k
            x[at[at < n]] |= np.uint32(0xFFFFFFFF >> 8 * k)
        return x

    def _before(self) -> np.ndarray:
        """The last two bytes of the word before, for each word."""
        begun = self.origin[np.searchsorted(self.origin, self.word, "right") - 1]
        byte = lambda d: np.where(self.word - begun >= d, self.padded[np.maximum(self.word + 4 - d, 0)], END).astype(np.uint64)
        return byte(2) | byte(3) << np.uint64(8)

    def _word_so_far(self) -> np.ndarray:
        hasher = _hasher()
        sums = hasher.prefix(self.buf)
        x = sums[:-1] - np.repeat(sums[self.word], self.letters)
        x *= np.repeat(hasher.down[self.word], self.letters)
        x ^= x >> np.uint64(32)
        x *= _SPREAD
        return x >> np.uint64(64 - _CONTEXT_BITS)

    def keys(self, k: int) -> np.ndarray:
        if k == 0:
            x = self.last.astype(np.uint64)
        elif k == 1:
            x = np.repeat(self._before() << np.uint64(16), self.letters)
            x |= self.last >> np.uint32(16)
        elif k == _WORD_PREDICTOR:
            x = self._word_so_far()
        else:
            x = (self.last >> np.uint32(8)).astype(np.uint64)
        x *= _SPREAD << np.uint64(64 - _CONTEXT_BITS)  # an odd factor: contexts stay apart, and their high bits deal them evenly
        x >>= np.uint64(64 - _CONTEXT_BITS - 8)
        x |= self.buf
        return x


def _sums(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ``v`` in order, sum of ``n`` of each)."""
    order = np.argsort(v)
    v = v[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(v)), bool), v[1:] != v[:-1])))
    return v[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _runs(s: np.ndarray) -> np.ndarray:
    """First place of each run of equal values of sorted ``s``."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))


def _keys(texts: list[bytes], room: list[np.ndarray]) -> np.ndarray:
    """Keys of every byte of the texts, for each predictor; valid until the next call with this ``room``, since fresh memory costs more than the keys."""
    n, at = sum(map(len, texts)) + len(texts), 0
    if not room or room[0].shape[1] < n:
        room[:] = [np.empty((PREDICTORS, n), np.uint64)]
    out = room[0][:, :n]
    for lo, hi in passes([len(t) + 1 for t in texts], _CHUNK):
        contexts = Contexts(_joined(texts[lo:hi]))
        for k in range(PREDICTORS):
            out[k, at : at + len(contexts.buf)] = contexts.keys(k)
        at += len(contexts.buf)
    return out


def block_pairs(texts: list[bytes], learn: list[bool]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each predictor: (keys of the distinct pairs of context and byte, in order; their counts in the texts to learn from)."""
    found: list[list] = [[] for _ in range(PREDICTORS)]
    room: list[np.ndarray] = []
    for known in (True, False):
        own = [t for t, h in zip(texts, learn, strict=True) if h == known]
        for lo, hi in passes([len(t) + 1 for t in own], _SLICE):
            for k, keys in enumerate(_keys(own[lo:hi], room)):
                for a in range(0, len(keys), _SLICE - 1):
                    s = keys[a : a + _SLICE - 1]
                    s.sort()
                    first = _runs(s)
                    v = s[first] << np.uint64(20)
                    found[k].append(v | np.diff(first, append=len(s)).astype(np.uint64) if known else v)
    out = []
    for parts in found:
        s = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        n = (s & np.uint64(_SLICE - 1)).astype(np.int64)
        s >>= np.uint64(20)
        first = _runs(s)
        out.append((s[first], np.add.reduceat(n, first) if len(first) else n))
        parts.clear()
    return out


class Numbers:
    """Numbers of keys, the same for equal keys. A key's number is its slot in the first table where no other key came before it."""

    def __init__(self, n: int):
        self.bits = max(8, n.bit_length() - 4)
        self.random = np.random.default_rng(5)
        self.tables: list[tuple[np.uint64, np.ndarray]] = []

    def of(self, v: np.ndarray, out: np.ndarray) -> None:
        """Writes the numbers of ``v`` to ``out``."""
        rest, level = None, 0
        while len(v):
            if level == len(self.tables):
                self.tables.append((self.random.integers(0, 2**64, dtype=np.uint64) | np.uint64(1), np.full(1 << self.bits, _FREE)))
            factor, table = self.tables[level]
            at = v * factor
            at >>= np.uint64(64 - self.bits)
            at = at.view(np.int64)
            missed = np.flatnonzero(table.take(at) != v)
            slot, own = at[missed], v[missed]
            free = table[slot] == _FREE
            table[slot[free]] = own[free]
            missed = missed[table[slot] != own]
            at += level << self.bits
            if rest is None:
                out[...] = at
            else:
                out[rest] = at
            rest, v = missed if rest is None else rest[missed], v[missed]
            level += 1

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys in order, place among them by number)."""
        taken = [np.flatnonzero(t != _FREE) for _, t in self.tables]
        keys = np.concatenate([np.zeros(0, np.uint64), *(t[at] for (_, t), at in zip(self.tables, taken, strict=True))])
        order, place = np.argsort(keys), np.empty(len(self.tables) << self.bits, np.int32)
        place[np.concatenate([np.zeros(0, np.int64), *(at + (i << self.bits) for i, at in enumerate(taken))])[order]] = np.arange(len(keys), dtype=np.int32)
        return keys[order], place


def block_places(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each predictor: (distinct pairs in order, place of every byte's pair among them)."""
    size = sum(map(len, texts)) + len(texts)
    numbers = [Numbers(size) for _ in range(PREDICTORS)]
    places = np.empty((PREDICTORS, size), np.int32 if size < 1 << 27 else np.int64)
    at, room = 0, []
    for lo, hi in passes([len(t) + 1 for t in texts], _SLICE):
        for k, keys in enumerate(_keys(texts[lo:hi], room)):
            for a in range(0, len(keys), _CHUNK):
                numbers[k].of(keys[a : a + _CHUNK], places[k, at + a : at + min(a + _CHUNK, len(keys))])
        at += len(keys)
    out = []
    for k in range(PREDICTORS):
        keys, place = numbers[k].sorted()
        numbers[k] = None
        for a in range(0, size, _SLICE):  # in place, so that they are held once
            places[k, a : a + _SLICE] = place.take(places[k, a : a + _SLICE])
        out.append((keys, places[k]))
    return out


def _pack(p: MixingLmParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        number = TaskContext.get().partitionId() << 32
        held_back: list[tuple[int | None, bool, bytes]] = []

        def row(rows: list, block: int) -> pa.RecordBatch:
            lens = np.fromiter((len(r[2]) for r in rows), np.int64, len(rows))
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(lens.sum()) + len(rows)]), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.bool_())), pa.array([lens.tobytes()], pa.binary()), pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(r[2] for r in rows))], pa.binary())], ["block", "n_bytes", "ids", "held", "lens", "text"])

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal number, held_back
            held_back.sort(key=lambda r: -len(r[2]))
            for lo, hi in passes([len(r[2]) + 1 for r in held_back], p.block_bytes):
                yield row(held_back[lo:hi], number)
                number += 1
            held_back = []

        size = 0
        for batch in batches:
            for lo, hi in passes(batch.column("n").to_numpy()):
                for d, h, t in zip(*(batch.column(c)[lo:hi].to_pylist() for c in ("doc_id", "held_out")), batch.column("text")[lo:hi].cast(pa.binary()).to_pylist(), strict=True):
                    if held_back and size + len(t) > p.sorted_bytes:
                        yield from blocks()
                        size = 0
                    held_back.append((d, h, t.lower()))
                    size += len(t) + 1
        yield from blocks()

    return run


def _texts(lens: bytes, text: bytes) -> list[bytes]:
    import zstandard

    raw, out, at = zstandard.ZstdDecompressor().decompress(text), [], 0
    for n in np.frombuffer(lens, np.int64).tolist():
        out.append(raw[at : at + n])
        at += n
    return out


def _values(x: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(x, np.uint64, 8), dtype=np.uint64)


def _by_range(v: np.ndarray, shift: int, ranges: int) -> np.ndarray:
    """Bounds of the ranges in sorted ``v``, by the 32 bits above ``shift``."""
    return np.searchsorted((v >> np.uint64(shift)).astype(np.int64) * ranges >> 32, np.arange(ranges + 1))


def _block_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, first word of each)."""
    parts = [hashed_words(texts[lo:hi], _hasher()) for lo, hi in passes([len(t) + 1 for t in texts], _CHUNK)]
    count = np.concatenate([np.diff(f) for _, f in parts])
    return np.concatenate([w for w, _ in parts]), np.concatenate(([0], np.cumsum(count)))


def _word_sender(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, lens, text in zip(*(batch.column(c).to_pylist() for c in ("block", "held", "lens", "text")), strict=True):
                words, first = _block_words(_texts(lens, text))
                known, parts = np.repeat(~np.array(held, bool), np.diff(first)), []
                for s, learned in ((np.sort(words[known]), True), (np.sort(words[~known]), False)):
                    at = _runs(s)
                    parts.append((s[at], np.diff(at, append=len(s)) * learned))
                v, n = _sums(*map(np.concatenate, zip(*parts, strict=True)))
                bound = _by_range(v, 32, ranges)
                rows = [(r, block, squeeze(np.diff(v[a:b], prepend=np.uint64(0))), squeeze(n[a:b].astype(np.uint32))) for r, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["range", "block", "v", "n"])

    return run


def _totals(each: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, their sums of ``n``, place of every value among them)."""
    every = np.concatenate(each)
    order = np.argsort(every)
    every = every[order]
    first = _runs(every)
    place = np.empty(len(every), np.int32)
    place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(every)))
    return every[first], np.add.reduceat(n[order], first, dtype=np.int64), place


def _word_counter(pdf: pd.DataFrame) -> pd.DataFrame:
    each = [_values(x) for x in pdf["v"]]
    _, total, at = _totals(each, np.concatenate([unsqueeze(x, np.uint32, 4) for x in pdf["n"]]))
    rows, spot = [], 0
    for i, (block, own) in enumerate(zip(pdf["block"], each, strict=True)):
        # The first row of a range also carries what the whole range adds to N and V.
        rows.append((block, pdf["range"].iloc[0], squeeze(total[at[spot : spot + len(own)]]), int(total.sum()) if i == 0 else 0, int((total > 0).sum()) if i == 0 else 0))
        spot += len(own)
    return pd.DataFrame(rows, columns=["block", "range", "counts", "tokens", "distinct"])


def _context_sender(ranges: int):
    """Each block's pairs of context and byte, with their counts in its learning documents, by ranges of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, lens, text in zip(*(batch.column(c).to_pylist() for c in ("block", "held", "lens", "text")), strict=True):
                for k, (v, n) in enumerate(block_pairs(_texts(lens, text), [not h for h in held])):
                    bound = _by_range(v, _CONTEXT_BITS + 8 - 32, ranges)
                    rows = [(k, r, block, squeeze(np.diff(v[a:b], prepend=np.uint64(0))), squeeze(n[a:b].astype(np.uint32))) for r, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)) if b > a]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], c) for i, c in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["k", "range", "block", "v", "n"])

    return run


def path_logits(v: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    """Logit of each of the eight bits of every pair's byte being what it is, in eighths; ``v`` are all pairs of their contexts, sorted."""
    out = np.empty((len(v), 8), np.int8)
    starts = lambda bits: np.flatnonzero(np.concatenate(([True], np.diff(v >> np.uint64(bits)) != 0)))
    spread = lambda at: np.repeat(np.add.reduceat(n, at), np.diff(at, append=len(v))).astype(np.float64)
    whole = spread(starts(8))
    for j in range(8):
        own = spread(starts(7 - j))
        out[:, j] = np.clip(np.rint(8.0 * np.log((own + prior) / (whole - own + prior))), -127, 127)
        whole = own
    return out


def signed(paths: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Logits of a 1, from those of the bits of the pairs ``v`` being what they are."""
    ones = np.unpackbits((v & np.uint64(255)).astype(np.uint8)[:, None], axis=1)
    return np.where(ones, paths, -paths)


def _context_counter(p: MixingLmParams):
    """Path logits of the corpus for every pair that a block sent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_values(x) for x in pdf["v"]]
        v, n, at = _totals(each, np.concatenate([unsqueeze(x, np.uint32, 4) for x in pdf["n"]]))
        paths = path_logits(v, n, p.prior)
        ends = np.cumsum([len(x) for x in each])
        rows = [(block, k, r, squeeze(paths[at[b - len(x) : b]])) for block, k, r, x, b in zip(pdf["block"], pdf["k"], pdf["range"], each, ends, strict=True)]
        return pd.DataFrame(rows, columns=["block", "k", "range", "counts"])

    return run


_TOP = 12  # the adaptive map has a cell for each whole logit up to this, of either sign
_STRETCH = 64  # steps whose places are read at once, lane by lane, since lanes lie far apart in memory
_NARROW = 512  # lanes below which fewer calls count for more than less memory
_EIGHT_ONES = np.uint64(0x0101010101010101)
_KNOWN = 20  # eighths of the word predictor's first logit from which the word so far counts as known


class ContextMixer:
    """Bits of texts, from the path logits (in eighths) of each predictor's pairs and the place among them of every byte.

    The weights have a gate: a second set is added where the word so far is known, which the size of the word predictor's
    first logit tells before a byte is read.
    """

    def __init__(self, p: MixingLmParams):
        self.p = p

    def mixed(self, texts: list[bytes], inputs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """-log2 probability of each text (the end symbol included)."""
        out, buf = np.zeros(len(texts)), _joined(texts)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        doc = np.argsort(-size, kind="stable")
        first = (np.cumsum(size) - size)[doc]
        for a in range(0, len(doc), self.p.lanes):
            own = slice(a, a + self.p.lanes)
            out[doc[own]] = self._advance(buf, inputs, first[own], size[doc[own]])
        return out

    def _inputs(self, inputs: list[tuple[np.ndarray, np.ndarray]], at: tuple[slice, slice]) -> tuple[np.ndarray, np.ndarray]:
        """The logits of the bytes whose places are given by (step, lane), for the steps and lanes ``at``: (steps, predictors, lanes * 8); and 1 where the second weights count, 0 elsewhere: (steps, lanes * 8)."""
        x = None
        for i, (paths, place) in enumerate(inputs):
            found = paths.take(place[at], 0)
            if x is None:
                x = np.empty((len(found), len(inputs), 8 * found.shape[1]), np.float32)
            x[:, i] = found.reshape(len(found), -1)
            if i == min(_WORD_PREDICTOR, len(inputs) - 1):
                known = (found[:, :, 0] >= _KNOWN) | (found[:, :, 0] <= -_KNOWN)
        return x, (known.astype(np.uint64) * _EIGHT_ONES).view(np.uint8).astype(np.float32)  # a one for each bit

    def _advance(self, buf: np.ndarray, inputs: list[tuple[np.ndarray, np.ndarray]], start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """-log2 probability of every lane, the longest first. The bits of a byte have weights and maps of their own, so all eight advance at once."""
        p, k, n = self.p, len(inputs), len(start)
        cells = 2 * _TOP + 1
        weights = np.zeros((2, k, 8 * n), np.float32)
        weights[0] = p.first_weight / 8  # the inputs' eighths are part of the weights
        grid = np.arange(-_TOP, _TOP + 1, dtype=np.float32)
        refined = np.repeat(1 / (1 + np.exp(-grid)), 8 * n)  # a chance for each whole logit and bit
        cost = np.zeros(n)
        one = np.array(1, np.float32)
        rate, map_rate, stay = (np.array(v, np.float32) for v in (p.rate / 64, p.map_rate, 1 - p.map_rate))
        room: list[np.ndarray] = []
        most, t, begun, until = int(size[0]) if n else 0, 0, 0, 0
        while t < most:
            m = int(np.searchsorted(-size, -t, "left"))  # lanes that still have a byte
            if m < 0.95 * n:  # the others go, so that every pass runs over memory without gaps; a few ended ones run along
                weights, refined = weights[..., : 8 * m].copy(), refined.reshape(cells, -1)[:, : 8 * m].flatten()
                n, start, size = m, start[:m], size[:m]
            if t == until:
                begun, until = t, min(most, t + _STRETCH)
                at = np.minimum(start[:, None] + np.arange(begun, until), len(buf) - 1)
                near = [(paths, np.ascontiguousarray(place.take(at).T)) for paths, place in inputs]
                wrong = ~np.ascontiguousarray(buf.take(at).T)
            steps = min(until - t, max(4, min(_STRETCH, 16384 // n)))
            at = slice(t - begun, t - begun + steps), slice(0, n)
            x, gates = self._inputs(near, at)
            zeros = np.unpackbits(wrong[at], axis=1).astype(np.float32)
            drift = map_rate * (one - zeros)
            narrow = n < _NARROW
            missed, mapped = np.empty_like(zeros), np.empty_like(zeros)
            if not room or len(room[0]) != 8 * n:
                room = [np.empty(8 * n, np.float32), np.empty(8 * n, np.float32), np.empty(8 * n, np.int64), np.empty((2, 8 * n), np.float32), np.empty((2, k, 8 * n), np.float32)]
                room += [np.arange(8 * n, dtype=np.float32) + _TOP * 8 * n, np.full(8 * n, _TOP - 0.1, np.float32), np.full(8 * n, 0.1 - _TOP, np.float32)]
            logit, error, place, both, part, lane, top, bottom = room  # comparing with a whole array is faster than with one number
            apart, (first, second) = np.array(8 * n, np.float32), both
            each, (w, v), half = both[:, None], weights, part[0]
            for own_x, gate, zero, own_drift, q, own in zip(x, gates, zeros, drift, missed, mapped, strict=True):
                if narrow:
                    np.einsum("sij,ij->sj", weights, own_x, out=both)
                else:
                    np.einsum("ij,ij->j", w, own_x, out=first)
                    np.einsum("ij,ij->j", v, own_x, out=second)
                second *= gate
                np.add(first, second, logit)
                np.minimum(logit, top, logit)
                np.maximum(logit, bottom, logit)
                np.rint(logit, error)
                error *= apart  # whole numbers below 2 ** 24
                error += lane
                place[...] = error
                refined.take(place, None, own, "clip")
                np.exp(logit, logit)
                logit += one
                np.reciprocal(logit, q)  # chance of a zero
                np.subtract(q, zero, error)
                np.multiply(own, stay, logit)
                logit += own_drift
                refined[place] = logit
                np.multiply(error, rate, first)
                if narrow:
                    np.multiply(first, gate, second)
                    np.multiply(own_x, each, part)
                    weights += part
                else:
                    np.multiply(own_x, first, half)
                    w += half
                    half *= gate
                    v += half
            missed *= np.float32(-0.75)
            missed += np.float32(0.75)
            mapped *= np.float32(0.25)
            missed += mapped
            missed -= zeros
            chance = np.abs(missed, missed)
            for _ in range(3):  # the product of a byte's eight
                chance = chance[:, ::2] * chance[:, 1::2]
            chance[(t + np.arange(steps))[:, None] >= size] = 1  # past a lane's end
            cost[:n] -= np.log2(np.maximum(chance, 1e-30)).sum(axis=0, dtype=np.float64)
            t += steps
        return cost


_SCORES = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, bits double"


def _scorer(tokens: int, distinct: int, end_count: int, p: MixingLmParams):
    def run(key, packed: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        row = packed.iloc[0]
        texts = _texts(row["lens"], row["text"])
        words, first = _block_words(texts)
        counted = counted.sort_values(["k", "range"])
        n = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(x, np.int64, 8) for x in counted["counts"][counted["k"] < 0])])
        _, _, at = _totals([words], np.zeros(len(words), np.uint8)) if len(words) else (None, None, np.zeros(0, np.int64))
        whole = np.log10(tokens + p.alpha * (distinct + 1))
        logs = np.concatenate(([0.0], np.cumsum(np.log10(n + p.alpha)[at] - whole)))
        known = np.concatenate(([0], np.cumsum((n > 0)[at])))
        size = np.diff(first)
        base = logs[first[1:]] - logs[first[:-1]] + np.log10(end_count + p.alpha) - whole
        inputs = []
        for k, (v, place) in enumerate(block_places(texts)):
            inputs.append((signed(np.concatenate([unsqueeze(x, np.int8, 8) for x in counted["counts"][counted["k"] == k]]), v), place))
        return pd.DataFrame({
            "doc_id": pd.array(row["ids"], "Int64"), "held_out": list(row["held"]), "n_bytes": [len(t) for t in texts], "n_tokens": size + 1,
            "n_known": known[first[1:]] - known[first[:-1]] + (end_count > 0), "train_tokens": tokens, "base_score": base, "bits": ContextMixer(p).mixed(texts, inputs),
        })

    return run


def score_texts(docs: DataFrame, params: MixingLmParams = MixingLmParams()) -> DataFrame:
    """Every row of ``docs(doc_id, text, held_out)`` scored by a model of the rows that are not held out.

    Returns doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score (log10), bits (total, end
    symbol included) and bits_per_byte. Null texts are empty, a null held_out is false, a null doc_id stays null. A learning
    document is scored with its own counts included. Rows that repeat count each; equal texts that are both held
    out or both learned from have equal scores. Texts of any length are read whole; byte 255, which UTF-8 doesn't have, counts as 254.
    Without any learning document all logits are 0 and the base knows no token. An empty table gives an
    empty result; further columns are ignored, whatever their names.
    """
    p = params
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("held_out"), F.lit(False)).alias("held_out"), text.alias("text"), F.octet_length(text).alias("n"))
    blocks = materialise(rows.mapInArrow(_pack(p), "block long, n_bytes long, ids array<long>, held array<boolean>, lens binary, text binary"), "none")
    size, learners = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum(F.aggregate("held", F.lit(0), lambda acc, h: acc + F.when(h, 0).otherwise(1))), F.lit(0))).first()
    ranges = max(1, -(-size // p.range_bytes))
    counted = materialise(blocks.mapInArrow(_word_sender(ranges), "range long, block long, v binary, n binary").groupBy("range").applyInPandas(_word_counter, "block long, range long, counts binary, tokens long, distinct long"), "none")
    tokens, distinct = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = tokens + learners, distinct + (learners > 0)
    context_ranges = max(1, -(-size // p.context_range_bytes))
    paths = blocks.mapInArrow(_context_sender(context_ranges), "k long, range long, block long, v binary, n binary").groupBy("k", "range").applyInPandas(_context_counter(p), "block long, k long, range long, counts binary")
    found = counted.select("block", F.lit(-1).cast("long").alias("k"), "range", "counts").unionByName(paths)
    scored = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_scorer(tokens, distinct, learners, p), _SCORES)
    return scored.withColumn("bits_per_byte", F.col("bits") / F.greatest(F.col("n_bytes"), F.lit(1)))
