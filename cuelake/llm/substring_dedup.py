"""Exact substring dedup: bytes covered by a string of ``length`` bytes that also starts in a document of smaller id.

1. Documents are packed into blocks of about ``block_bytes``, each one row of a scratch table.
2. The least k-mer hash (minimizer) of every ``length``-byte window splits a document into runs of windows
   that share it. Equal windows have equal minimizers, so only runs whose minimizer occurs twice anywhere
   can matter; blocks learn which those are from ranges of the minimizer, by hashes of 48 bits.
3. The bytes of these runs are the strings. They are dealt to ranges of the minimizer. A minimizer of many
   strings (a common phrase in varied surroundings) would fill one range; its windows are dealt one by one
   instead, by the hash of the whole window, so equal ones still meet. Strings of equal hash collapse to
   their least document once their bytes are found equal.
4. In a range the strings go through column-wise multi-string construction (``SuffixFiles``): each round
   prepends one symbol to a suffix of every string, and updates the collection's Burrows-Wheeler transform
   and the common prefixes of neighbouring suffixes in sequential files of the shared folder. Suffixes
   between which no common prefix is shorter than ``length`` are one class of equal windows; its least
   document holds for all of them.
5. The least documents return to the blocks, where the covered bytes are cut out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHasher, drop_path, drop_table, materialise, mix64, passes, scratch_dir, squeeze, unsqueeze


@dataclass(frozen=True)
class SubstringParams:
    length: int = 50
    k: int = 24
    block_bytes: int = 8_000_000
    range_bytes: int = 16_000_000
    run_windows: int = 64  # longer runs are split
    hot_strings: int = 4096  # a minimizer of more strings has its windows dealt by their own hashes
    chunk: int = 1 << 18  # symbols of a file that a round holds at once


def _zip(x: np.ndarray | bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _unzip(x: bytes, kind: str = "u1") -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _blocks(p: SubstringParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []

        def row() -> pa.RecordBatch:
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(lens.sum())]), pa.array([_zip(np.array(ids, np.int64))], pa.binary()), pa.array([_zip(lens)], pa.binary()), pa.array([_zip(b"\0".join([*texts, b""]))], pa.binary())], ["block", "n_bytes", "ids", "lens", "text"])

        size = 0
        for batch in batches:
            for lo, hi in passes(batch.column("n").to_numpy()):
                for d, t in zip(batch.column("doc_id")[lo:hi].to_pylist(), batch.column("text")[lo:hi].cast(pa.binary()).to_pylist(), strict=True):
                    if ids and size + len(t) > p.block_bytes:
                        yield row()
                        block, ids, texts, size = block + 1, [], [], 0
                    ids.append(d)
                    texts.append(t)
                    size += len(t) + 1
        if ids:
            yield row()

    return run


def window_runs(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, p: SubstringParams, hasher: ByteHasher, slice_windows: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, 48-bit minimizer) of each run of windows with one minimizer; texts start at ``starts`` in ``buf``."""
    out: list[tuple[np.ndarray, ...]] = []
    total = len(buf) - p.length + 1
    edge = np.zeros(max(len(buf) + 1, 1), np.int8)
    long = lens >= p.length
    edge[starts[long]] += 1
    edge[starts[long] + lens[long] - p.length + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    w = p.length - p.k + 1
    for lo in range(0, max(total, 0), slice_windows):
        hi = min(total, lo + slice_windows)
        part = buf[lo : hi + p.length - 1]
        prefix = hasher.prefix(part)
        at = np.arange(len(part) - p.k + 1)
        least = hasher.ranges(prefix, at, at + p.k)
        span = 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        ok = inside[lo:hi]
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
        pos = np.flatnonzero(first)
        # A run ends where the next begins or the text has no further window.
        stop = np.flatnonzero(np.concatenate((ok[:-1] & ~(ok[1:] & ~first[1:]), ok[-1:]))) + 1
        n = stop - pos
        pieces = -(-n // p.run_windows)
        rep = np.repeat(np.arange(len(pos)), pieces)
        step = (np.arange(len(rep)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * p.run_windows
        out.append((pos[rep] + step + lo, np.minimum(n[rep] - step, p.run_windows), mix64(least[pos[rep]] + np.uint64(0x51ED270B)) >> np.uint64(16)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _digests(hasher: ByteHasher, buf: np.ndarray, pos: np.ndarray, size: np.ndarray, slice_bytes: int = 1_000_000) -> np.ndarray:
    """Hashes of the strings ``buf[pos : pos + size]``; prefix sums of one slice of ``buf`` at a time."""
    out = np.empty(len(pos), np.uint64)
    order = np.argsort(pos, kind="stable")
    start = pos[order]
    cuts = np.searchsorted(start, np.arange(0, len(buf) + slice_bytes, slice_bytes))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            own = order[a:b]
            lo, hi = int(start[a]), int((pos[own] + size[own]).max())
            out[own] = hasher.ranges(hasher.prefix(buf[lo:hi]), pos[own] - lo, pos[own] + size[own] - lo) + size[own].astype(np.uint64)
    return out


def equal_strings(buf: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, chunk: int = 200_000) -> np.ndarray:
    """Whether the strings of ``size`` (8 at least) bytes at ``x`` and ``y`` are equal, eight bytes at a time."""
    out = np.ones(len(x), bool)
    if not len(x):
        return out
    eights = np.ndarray(len(buf) - 7, "<u8", np.ascontiguousarray(buf), strides=(1,))
    for c in range(0, len(x), chunk):
        rows = np.arange(c, min(len(x), c + chunk))
        step = 0
        while len(rows):
            at = np.minimum(step, size[rows] - 8)
            good = eights[x[rows] + at] == eights[y[rows] + at]
            out[rows[~good]] = False
            step += 8
            rows = rows[good & (size[rows] > step)]
    return out


def distinct_strings(buf: np.ndarray, v: np.ndarray, pos: np.ndarray, size: np.ndarray, doc: np.ndarray, hasher: ByteHasher) -> tuple[np.ndarray, np.ndarray]:
    """(a string of the least document for each distinct string, in the order of ``v``; for every string its number among those).

    Strings of one hash are equal only if their bytes are. Where unequal strings share a hash, equal ones may
    stay apart; the construction brings them together.
    """
    digest = _digests(hasher, buf, pos, size)
    order = np.lexsort((doc, digest, v))
    x, y = order[1:], order[:-1]
    same = (v[x] == v[y]) & (digest[x] == digest[y]) & (size[x] == size[y])
    at = np.flatnonzero(same)
    same[at] = equal_strings(buf, pos[x[at]], pos[y[at]], size[x[at]])
    fresh = np.concatenate((np.ones(min(1, len(order)), bool), ~same))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


def _opened(text: bytes, lens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = _unzip(lens, "i8")
    return _unzip(text), np.cumsum(sizes + 1) - sizes - 1, sizes


def _range_of(v: np.ndarray, ranges: int) -> np.ndarray:
    return (v >> np.uint64(16)).astype(np.int64) * ranges >> 32


def _minimizers(p: SubstringParams, ranges: int):
    """Per block and range: the distinct minimizers and the number of strings of each (2 at least where a string comes twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHasher()
        for batch in batches:
            for block, lens, text in zip(*(batch.column(c).to_pylist() for c in ("block", "lens", "text")), strict=True):
                buf, starts, sizes = _opened(text, lens)
                pos, windows, every = window_runs(buf, starts, sizes, p, hasher)
                order = np.argsort(every)
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), every[order][1:] != every[order][:-1])))
                v, n = every[order][first], np.diff(first, append=len(order))
                often = order[np.repeat(n > 3, n)]
                if len(often):
                    digest = _digests(hasher, buf, pos[often], windows[often] + p.length - 1)
                    at = np.repeat(np.arange(len(v)), n)[np.repeat(n > 3, n)]
                    turn = np.lexsort((digest, at))
                    at, digest = at[turn], digest[turn]
                    other = np.concatenate(([True], (at[1:] != at[:-1]) | (digest[1:] != digest[:-1])))
                    several = np.bincount(at[other], minlength=len(v))
                    n = np.where(several > 0, np.maximum(several, 2), n)
                n = np.minimum(n, 65535).astype(np.uint16)
                bound = np.searchsorted(_range_of(v, ranges), np.arange(ranges + 1))
                rows = [(r, block, squeeze(np.diff(v[a:b], prepend=np.uint64(0))), squeeze(n[a:b])) for r, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["range", "block", "v", "strings"])

    return run


def _values(x: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(x, np.uint64, 8), dtype=np.uint64)


def _shared(p: SubstringParams):
    """The minimizers of a range that several blocks have, or one block several times, for each block; and which of them have too many strings."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_values(x) for x in pdf["v"]]
        every, strings = np.concatenate(each), np.concatenate([unsqueeze(x, np.uint16, 2) for x in pdf["strings"]])
        order = np.argsort(every)
        first = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
        total = np.empty(len(every), np.int64)
        total[order] = np.repeat(np.add.reduceat(strings[order].astype(np.int64), first), np.diff(first, append=len(order)))
        rows, spot = [], 0
        for block, own in zip(pdf["block"], each, strict=True):
            count = total[spot : spot + len(own)]
            spot += len(own)
            found = count > 1
            if found.any():
                rows.append((block, squeeze(np.diff(own[found], prepend=np.uint64(0))), np.packbits(count[found] > p.hot_strings).tobytes()))
        return pd.DataFrame(rows, columns=["block", "v", "hot"])

    return run


@dataclass
class _Strings:
    """The strings of a block that may occur elsewhere: windows (first, number), the lead of each distinct one, and its range."""

    buf: np.ndarray
    starts: np.ndarray
    lens: np.ndarray
    ids: np.ndarray
    pos: np.ndarray
    n: np.ndarray
    v: np.ndarray
    doc: np.ndarray
    lead: np.ndarray
    number: np.ndarray
    bound: np.ndarray


def _block_strings(packed: pd.DataFrame, shared: pd.DataFrame, p: SubstringParams, ranges: int) -> _Strings:
    hasher = ByteHasher()
    buf, starts, lens = _opened(packed["text"].iloc[0], packed["lens"].iloc[0])
    ids = _unzip(packed["ids"].iloc[0], "i8")
    pos, n, v = window_runs(buf, starts, lens, p, hasher)
    each = [_values(x) for x in shared["v"]]
    hot = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(x, np.uint8))[: len(k)].astype(bool) for x, k in zip(shared["hot"], each, strict=True)]])
    known = np.concatenate([np.zeros(0, np.uint64), *each])
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    at = np.minimum(np.searchsorted(known, v), max(len(known) - 1, 0))
    hit = known[at] == v if len(known) else np.zeros(len(v), bool)
    pos, n, v, hot = pos[hit], n[hit], v[hit], hot[at[hit]]
    if hot.any():
        ends = np.cumsum(n[hot])
        alone = np.repeat(pos[hot] - (ends - n[hot]), n[hot]) + np.arange(ends[-1])
        pos, n = np.concatenate((pos[~hot], alone)), np.concatenate((n[~hot], np.ones(len(alone), np.int64)))
        v = np.concatenate((v[~hot], mix64(_digests(hasher, buf, alone, np.full(len(alone), p.length))) >> np.uint64(16)))
    doc = ids[np.searchsorted(starts, pos, "right") - 1]
    lead, number = distinct_strings(buf, v, pos, n + p.length - 1, doc, hasher)
    return _Strings(buf, starts, lens, ids, pos, n, v, doc, lead, number, np.searchsorted(_range_of(v[lead], ranges), np.arange(ranges + 1)))


def _cut_strings(buf: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return buf[np.repeat(pos - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _sender(p: SubstringParams, ranges: int):
    """The distinct strings of a block for each range: minimizer, windows, least document, bytes."""

    def run(key, packed: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        cols = ["block", "range", "v", "n", "doc", "text"]
        if not len(packed) or not len(shared):
            return pd.DataFrame([], columns=cols)
        s, rows = _block_strings(packed, shared, p, ranges), []
        for r, (a, b) in enumerate(zip(s.bound[:-1], s.bound[1:], strict=True)):
            if b > a:
                own = s.lead[a:b]
                rows.append((int(key[0]), r, squeeze(np.diff(s.v[own], prepend=np.uint64(0))), _zip(s.n[own].astype(np.uint8)), squeeze(s.doc[own]), _zip(_cut_strings(s.buf, s.pos[own], s.n[own] + p.length - 1))))
        return pd.DataFrame(rows, columns=cols)

    return run


_ALPHABET = 257  # 0: a string begins here; then 1 + byte


def _by_symbol(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of symbols, amount of each symbol)."""
    return np.argsort(symbols, kind="stable"), np.bincount(symbols, minlength=_ALPHABET)


class SuffixFiles:
    """Transform and common prefixes of the suffixes of strings, built column by column in sequential files.

    After round j the files hold, in the order of all suffixes of at most j symbols (the m empty ones first,
    by string), the symbol before each suffix (2 bytes) and the length of the prefix that it shares with the one before it
    (1 byte). A round reads both from start to end to place the suffixes of length j (last-to-first
    mapping: a suffix's rank among those that follow the same symbol) and to take the least common prefix since the
    last occurrence of their symbol; then it reads them again and writes them with the new entries put in.
    In memory are two numbers a string, one chunk of each file, and tables of the alphabet's size.
    """

    def __init__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, folder: str, chunk: int):
        from pyarrow.fs import FileSystem

        self.fs, self.folder = FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.text, self.start, self.size, self.chunk = text, start, size, chunk
        self.m = self.n = len(size)
        self.rounds = 0
        last = text[start + size - 1].astype(np.uint16) + np.uint16(1)
        self.count = np.bincount(last, minlength=_ALPHABET)
        self._write(0, iter([(last, np.zeros(self.m, np.uint8))]))
        self.active, self.at = np.arange(self.m), np.arange(self.m)

    def _name(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}-{number}"

    def _write(self, number: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        with self.fs.open_output_stream(self._name("bwt", number)) as b, self.fs.open_output_stream(self._name("lcp", number)) as c:
            for symbols, common in parts:
                b.write(symbols.tobytes())
                c.write(common.tobytes())

    def read(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the first, symbols, common prefixes) of each chunk."""
        with self._open() as (b, c):
            for lo in range(0, self.n, self.chunk):
                k = min(self.chunk, self.n - lo)
                yield lo, np.frombuffer(b.read(2 * k), np.uint16), np.frombuffer(c.read(k), np.uint8)

    def _open(self):
        from contextlib import ExitStack, contextmanager

        @contextmanager
        def both():
            with ExitStack() as stack:
                yield tuple(stack.enter_context(self.fs.open_input_stream(self._name(kind, self.rounds))) for kind in ("bwt", "lcp"))

        return both()

    def first(self) -> np.ndarray:
        """Place of the first suffix that begins with each symbol."""
        return self.m + np.cumsum(self.count) - self.count - (np.arange(_ALPHABET) > 0) * self.count[0]

    def insert(self) -> None:
        """One round: the next symbol of every string that has one."""
        place, common, changed, value = self._placed()
        order = np.argsort(place)
        self.active, place, common = self.active[order], place[order], common[order]
        j = self.rounds + 1
        more = self.size[self.active] > j
        symbol = np.zeros(len(place), np.uint16)
        own = self.active[more]
        symbol[more] = self.text[self.start[own] + self.size[own] - 1 - j].astype(np.uint16) + np.uint16(1)
        turn = np.argsort(changed)
        self._merge(place, symbol, common, changed[turn], value[turn])
        self.count += np.bincount(symbol, minlength=_ALPHABET)
        self.active, self.at = own, place[more]

    def _placed(self) -> tuple[np.ndarray, ...]:
        """Places and common prefixes of the new suffixes; places and common prefixes of those old ones that a new one now precedes."""
        first, seen = self.first(), np.zeros(_ALPHABET, np.int64)
        since, pending = np.full(_ALPHABET, 255, np.uint8), np.zeros(_ALPHABET, bool)
        place, common = np.empty(len(self.at), np.int64), np.zeros(len(self.at), np.uint8)
        bounds = np.searchsorted(self.at, np.arange(0, self.n + self.chunk, self.chunk))
        changed, value = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for c, (lo, symbols, prefix) in enumerate(self.read()):
            asked = slice(bounds[c], bounds[c + 1])
            k = len(symbols)
            order, amount = _by_symbol(symbols)
            begin = np.cumsum(amount) - amount
            new = np.zeros(k, bool)
            new[self.at[asked] - lo] = True
            sorted_new = new[order]
            follows = np.concatenate((np.zeros(min(1, k), bool), sorted_new[:-1]))
            have = np.flatnonzero(amount)
            follows[begin[have]] = pending[have]
            spot = np.flatnonzero(sorted_new | follows)  # in the order of symbols
            spot = spot[symbols[order[spot]] > 0]
            x = order[spot]
            sym = symbols[x].astype(np.int64)
            inner = spot > begin[sym]
            least = np.full(len(x), 255, np.uint8)
            ended = np.append(prefix, np.uint8(255))
            q = np.flatnonzero(inner)
            q = q[np.argsort(x[q])]
            if len(q):
                pair = np.empty(2 * len(q), np.int64)
                pair[0::2], pair[1::2] = order[spot[q] - 1] + 1, x[q] + 1
                least[q] = np.minimum.reduceat(ended, pair)[0::2]
            q = np.flatnonzero(~inner)
            if len(q):
                upto = np.minimum.accumulate(prefix)
                least[q] = np.minimum(upto[x[q]], since[sym[q]])
            got = np.where(inner | (seen[sym] > 0), least + np.uint8(1), 0).astype(np.uint8)
            where = first[sym] + seen[sym] + spot - begin[sym]
            fresh = sorted_new[spot]
            inverse = np.empty(k, np.int64) if fresh.any() else None
            if inverse is not None:
                inverse[x[fresh]] = np.flatnonzero(fresh)
                mine = inverse[self.at[asked] - lo]
                place[asked], common[asked] = where[mine], got[mine]
            changed.append(where[~fresh])
            value.append(got[~fresh])
            seen += amount
            last = order[begin[have] + amount[have] - 1]
            tail = np.minimum(since, prefix.min())
            turn = np.argsort(last)
            tail[have[turn]] = np.minimum.accumulate(np.minimum.reduceat(ended, last[turn] + 1)[::-1])[::-1]
            since = tail
            pending[have] = sorted_new[begin[have] + amount[have] - 1]
        return place, common, np.concatenate(changed), np.concatenate(value)

    def _merge(self, place: np.ndarray, symbol: np.ndarray, common: np.ndarray, changed: np.ndarray, value: np.ndarray) -> None:
        total = self.n + len(place)

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            with self._open() as (b, c):
                for lo in range(0, total, self.chunk):
                    hi = min(total, lo + self.chunk)
                    i, e = np.searchsorted(place, (lo, hi))
                    u, w = np.searchsorted(changed, (lo, hi))
                    old = np.ones(hi - lo, bool)
                    old[place[i:e] - lo] = False
                    k = hi - lo - (e - i)
                    symbols, prefix = np.empty(hi - lo, np.uint16), np.empty(hi - lo, np.uint8)
                    symbols[old], prefix[old] = np.frombuffer(b.read(2 * k), np.uint16), np.frombuffer(c.read(k), np.uint8)
                    symbols[~old], prefix[~old] = symbol[i:e], common[i:e]
                    prefix[changed[u:w] - lo] = value[u:w]
                    yield symbols, prefix

        self._write(self.rounds + 1, parts())
        for kind in ("bwt", "lcp"):
            self.fs.delete_file(self._name(kind, self.rounds))
        self.rounds, self.n = self.rounds + 1, total

    def build(self) -> SuffixFiles:
        while len(self.active):
            self.insert()
        return self

    def classes(self, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(suffix length, strings that have it, class) for every suffix of ``length`` symbols or more: equal in the first ``length`` symbols, one class."""
        step, group = np.empty(self.n, np.int32), np.empty(self.n, np.int32)
        first, seen, heads = self.first(), np.zeros(_ALPHABET, np.int64), 0
        for lo, symbols, prefix in self.read():
            order, amount = _by_symbol(symbols)
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(np.cumsum(amount) - amount, amount)
            step[lo : lo + len(order)] = first[symbols] + seen[symbols] + nth
            seen += amount
            group[lo : lo + len(order)] = heads + np.cumsum(prefix < length)
            heads = int(group[lo + len(order) - 1])
        who = np.argsort(-self.size, kind="stable")
        at = who.copy()  # the empty suffix of a string stands at the string's number
        many = np.searchsorted(-self.size[who], -np.arange(1, self.rounds + 1), "right")
        for j, k in enumerate(many.tolist(), 1):
            at = step[at[:k]]
            if j >= length:
                yield j, who[:k], group[at]

    def close(self) -> None:
        self.fs.delete_dir(self.folder)


def least_documents(text: np.ndarray, start: np.ndarray, windows: np.ndarray, doc: np.ndarray, p: SubstringParams, folder: str) -> np.ndarray:
    """For every window of every string (in order) the least document of all strings that hold it."""
    size = windows + p.length - 1
    files = SuffixFiles(text, start, size, folder, p.chunk)
    try:
        found = list(files.build().classes(p.length))
    finally:
        files.close()
    least = np.full(max(int(g.max()) for _, _, g in found) + 1, np.iinfo(np.int64).max)
    for _, who, group in found:
        np.minimum.at(least, group, doc[who])
    first = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    for j, who, group in found:
        out[first[who] + size[who] - j] = least[group]
    return out


def _resolver(p: SubstringParams, folder: str):
    """Least documents of the windows of every block's strings in a range; strings without another of their minimizer need no construction."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_values(x) for x in pdf["v"]]
        v = np.concatenate(each)
        n = np.concatenate([_unzip(x) for x in pdf["n"]]).astype(np.int64)
        doc = np.concatenate([unsqueeze(x, np.int64, 8) for x in pdf["doc"]])
        text = np.concatenate([_unzip(x) for x in pdf["text"]])
        size = n + p.length - 1
        start = np.cumsum(size) - size
        lead, number = distinct_strings(text, v, start, size, doc, ByteHasher())
        same = v[lead][1:] == v[lead][:-1]
        several = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        least = np.repeat(doc[lead], n[lead])
        first = np.cumsum(n[lead]) - n[lead]
        if len(several):
            own = lead[several]
            ends = np.cumsum(n[own])
            at = np.repeat(first[several] - (ends - n[own]), n[own]) + np.arange(ends[-1])
            least[at] = least_documents(text, start[own], n[own], doc[own], p, f"{folder}/{int(pdf['range'].iloc[0])}-{uuid.uuid4().hex}")
        rows, spot = [], 0
        for block, c in zip(pdf["block"], map(len, each), strict=True):
            own = number[spot : spot + c]
            w = n[lead][own]
            ends = np.cumsum(w)
            values = least[np.repeat(first[own] - (ends - w), w) + np.arange(ends[-1])]
            begins = np.zeros(len(values), bool)
            begins[ends - w] = True
            begins[1:] |= values[1:] != values[:-1]
            head = np.flatnonzero(begins)
            rows.append((block, int(pdf["range"].iloc[0]), squeeze(values[head]), _zip(np.diff(np.append(head, len(values))).astype(np.uint8))))
            spot += c
        return pd.DataFrame(rows, columns=["block", "range", "values", "repeats"])

    return run


_CUT = "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"


def _cutter(p: SubstringParams, ranges: int):
    def run(key, packed: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        shared, replies = found[found["range"] < 0], found[found["range"] >= 0].sort_values("range")
        s = _block_strings(packed, shared.rename(columns={"a": "v", "b": "hot"}), p, ranges)
        buf, starts = s.buf, s.starts
        edge = np.zeros(len(buf) + 1, np.int32)
        if len(replies):
            least = np.concatenate([np.repeat(unsqueeze(x, np.int64, 8), _unzip(y)) for x, y in zip(replies["a"], replies["b"], strict=True)])
            windows = s.n[s.lead]
            first = np.cumsum(windows) - windows
            ends = np.cumsum(s.n)
            step = np.arange(ends[-1]) - np.repeat(ends - s.n, s.n)
            at = np.repeat(s.pos, s.n) + step
            gone = at[least[np.repeat(first[s.number], s.n) + step] < s.ids[np.searchsorted(starts, at, "right") - 1]]
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + p.length, -1)
        covered = np.cumsum(edge[:-1]) > 0
        flips = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
        lo, hi = flips[0::2], flips[1::2]
        where = np.searchsorted(lo, np.append(starts, len(buf) + 1))
        rows = []
        for i, (d, a, size) in enumerate(zip(s.ids.tolist(), starts, s.lens, strict=True)):
            spans = [{"start": int(x - a), "length": int(y - x)} for x, y in zip(lo[where[i] : where[i + 1]], hi[where[i] : where[i + 1]], strict=True)]
            own = slice(a, a + size)
            rows.append((d, int(size), spans, (buf[own][~covered[own]] if spans else buf[own]).tobytes()))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeated_substrings(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` as doc_id, n_bytes, spans (removed, in bytes of the UTF-8 text), kept (the rest).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document of smaller doc_id;
    overlapping strings count, all are judged on the input, and none crosses documents. Null texts are
    empty. Rows with a null doc_id are returned whole and compare with nothing; rows that repeat a doc_id
    don't cut each other. A text longer than a block is a block of its own. An empty table gives an empty
    result; further columns are ignored, whatever their names.

    Scratch: three tables in the shared folder feed the result and stay until ``clear_scratch``; the files of
    the construction are gone when this returns.
    """
    p, spark = params, docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    binary = F.col("text").cast("binary")
    unknown = rows.where("doc_id is null").select("doc_id", F.length(binary).cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"), binary.alias("kept"))
    known = rows.where("doc_id is not null").withColumn("n", F.octet_length("text"))
    blocks = materialise(known.mapInArrow(_blocks(p), "block long, n_bytes long, ids binary, lens binary, text binary"), "none")
    ranges = max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // p.range_bytes))
    shared = blocks.mapInArrow(_minimizers(p, ranges), "range long, block long, v binary, strings binary").groupBy("range").applyInPandas(_shared(p), "block long, v binary, hot binary")
    shared = materialise(shared, "none")
    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(_sender(p, ranges), "block long, range long, v binary, n binary, doc binary, text binary")
    least = materialise(sent.groupBy("range").applyInPandas(_resolver(p, folder), "block long, range long, values binary, repeats binary"), "none")
    drop_path(spark, folder)
    found = shared.select("block", F.lit(-1).cast("long").alias("range"), F.col("v").alias("a"), F.col("hot").alias("b")).union(least.select("block", "range", "values", "repeats"))
    cut = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_cutter(p, ranges), _CUT)
    return cut.union(unknown)
