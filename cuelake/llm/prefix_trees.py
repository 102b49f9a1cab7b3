"""Exact repeated passages in words, by prefix-partitioned suffix trees.

1. Documents are packed into blocks of about ``block_bytes``, each one row of a table bucketed by block, so that the later passes over
   blocks shuffle no text. A suffix is a place in a document with ``length`` words from there on, its window.
2. The least hash of ``k`` words in a window (its minimizer) is the same in equal windows. Blocks learn from ranges of the minimizer which of
   theirs another document has too; only suffixes with one of those can have an equal window elsewhere.
3. The suffixes are split by variable-length prefixes: prefixes of one word whose suffixes are too many for a part of a tree are
   extended by a word, and so on to ``length`` words. How many there are is estimated from one suffix in ``sample``, whatever the size; it
   decides where a suffix goes and nothing else. A suffix is sent as the numbers of its words: ranges of the word hash give every distinct word,
   told apart as text, a number of its own in the whole corpus, frequent words small ones. So what a suffix takes doesn't depend on how many go the same way.
4. Each group of prefixes becomes one suffix tree over words, as suffix array and common prefixes. The trees are cut at ``length`` words, below
   which no node changes the result, so the deep internal nodes are those where neighbours share ``length`` words. They are the places
   of one repeated window; the least document of a node is the one that keeps it.
5. One bit a suffix returns to the blocks: whether a document smaller than the block's least has it. Windows that follow each other in a text are
   joined there to maximal repeats, and the words they cover go.
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

from .common import ByteHasher, keep_scratch, materialise, mix64, passes, scratch_dir, squeeze, unsqueeze
from .substring_dedup import _cut_strings, _opened, _unzip, _values, _zip, equal_strings


@dataclass(frozen=True)
class PrefixTreeParams:
    length: int = 13  # words of a window, 2 at least
    k: int = 6  # words that are hashed for a minimizer, ``length`` at most
    block_bytes: int = 16_000_000
    range_bytes: int = 64_000_000  # text whose minimizers meet in one task
    tree_suffixes: int = 1 << 20  # suffixes of a tree; a prefix of more than a fourth of them is extended
    sample: int = 1024
    bucket_blocks: int = 2  # blocks that a task sees


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 18  # bytes or words that one pass over a block works on; only its result is as large as the block


@dataclass
class _Words:
    """The words of a block's texts: first byte and end of each, and its document's number in the block. Places take 32 bits where the block allows it."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> _Words:
        kind = np.int32 if len(buf) < 2**31 - 2 * _SLICE else np.int64
        space = np.ones(len(buf) + 2, bool)
        for lo in range(0, len(buf), _SLICE):
            space[1 + lo : 1 + min(lo + _SLICE, len(buf))] = _SPACE[buf[lo : lo + _SLICE]]
        space[1 + starts + sizes] = True  # a text ends, whatever byte stands between texts
        edges = np.concatenate([(np.flatnonzero(space[lo + 1 : lo + 1 + _SLICE] != space[lo : lo + _SLICE][: len(space) - 1 - lo]) + lo).astype(kind) for lo in range(0, len(space) - 1, _SLICE)])
        start, end = edges[0::2], edges[1::2]
        first = np.searchsorted(start, starts.astype(kind))
        return cls(buf, start, end, np.repeat(np.arange(len(starts), dtype=kind), np.diff(first, append=len(start))))

    @staticmethod
    def _slices(start: np.ndarray, slice_bytes: int = _SLICE) -> Iterator[tuple[int, int]]:
        """Ranges of words that begin within a slice of bytes."""
        if len(start):
            cuts = np.unique(np.searchsorted(start, np.arange(0, int(start[-1]) + 1 + slice_bytes, slice_bytes, dtype=start.dtype)))
            yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)

    def hashes(self, slice_bytes: int = _SLICE) -> np.ndarray:
        hasher, out = ByteHasher(), np.empty(len(self.start), np.uint64)
        for a, b in self._slices(self.start, slice_bytes):
            lo = int(self.start[a])
            out[a:b] = hasher.ranges(hasher.prefix(self.buf[lo : int(self.end[b - 1])]), self.start[a:b] - lo, self.end[a:b] - lo) + (self.end[a:b] - self.start[a:b]).astype(np.uint64)
        return out

    def windows(self, length: int) -> np.ndarray:
        """Words that begin a window."""
        n = max(len(self.start) - length + 1, 0)
        return np.flatnonzero(self.doc[:n] == self.doc[length - 1 :][:n])

    def spaced(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the words, one space after each; first byte of each there and the end), or of those to keep."""
        start, end = (self.start, self.end) if keep is None else (self.start[keep], self.end[keep])
        parts = [np.zeros(0, np.uint8)]
        for a, b in self._slices(start):
            lo, hi = int(start[a]), int(end[b - 1])
            edge = np.zeros(hi - lo + 2, np.int8)
            edge[start[a:b] - lo] += 1
            edge[end[a:b] - lo + 1] -= 1
            text = np.append(self.buf[lo:hi], np.uint8(0x20))
            text[end[a:b] - lo] = 0x20
            parts.append(text[np.cumsum(edge[:-1], dtype=np.int8).view(bool)])
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start + 1, out=offsets[1:])
        return np.concatenate(parts), offsets


def _prefix_hashes(words: np.ndarray, at: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Hashes of the first 1, 2, ... words from each place."""
    h = np.zeros(len(at), np.uint64)
    for j in range(depth):
        h = h * _STEP + words[at + j]
        yield mix64(h)


def _minimizers(words: np.ndarray, p: PrefixTreeParams) -> np.ndarray:
    """48-bit minimizer of every ``length`` words in a row."""
    out = np.empty(max(len(words) - p.length + 1, 0), np.uint64)
    for lo in range(0, len(out), _SLICE):
        own = words[lo : lo + _SLICE + p.length - 1]
        n = len(own) - p.k + 1
        h = np.zeros(n, np.uint64)
        for j in range(p.k):
            h *= _STEP
            h += own[j : j + n]
        least, w, span = mix64(h), p.length - p.k + 1, 1
        while 2 * span <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        out[lo : lo + _SLICE] = mix64(least + np.uint64(0x2545F491)) >> np.uint64(16)  # minima are small numbers; ranges need even ones
    return out


def _blocks(p: PrefixTreeParams):
    """Blocks: texts; their distinct minimizers and whether several documents of the block have each; prefix hashes of sampled suffixes."""

    def row(block: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        packed = b"\n".join([*texts, b""])
        texts.clear()
        words = _Words.of(np.frombuffer(packed, np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes)
        hashes, at = words.hashes(), words.windows(p.length).astype(words.start.dtype)
        drawn = np.concatenate([at[:0], *(x[mix64(x.astype(np.uint64) + np.uint64((block * 0x9E3779B9 + 7) % 2**64)) % np.uint64(p.sample) == 0] for x in np.split(at, range(_SLICE, len(at), _SLICE)))])
        sampled = np.stack(list(_prefix_hashes(hashes, drawn, p.length - 1)), axis=1).reshape(-1)
        v, doc, n_windows = _minimizers(hashes, p)[at], words.doc[at], len(at)
        del words, hashes, at
        fresh = np.flatnonzero(np.concatenate((np.ones(min(1, len(v)), bool), (v[1:] != v[:-1]) | (doc[1:] != doc[:-1]))))
        order = fresh[np.lexsort((doc[fresh], v[fresh]))]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), v[order][1:] != v[order][:-1])))
        last = np.append(first[1:], len(order)) - 1
        several = doc[order[first]] != doc[order[last]] if len(order) else np.zeros(0, bool)
        values = [block, len(packed), n_windows, _zip(np.array(ids, np.int64)), _zip(sizes), _zip(packed), squeeze(np.diff(v[order[first]], prepend=np.uint64(0))), np.packbits(several).tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([*(pa.array([x], k) for x, k in zip(values, kinds, strict=True)), pa.array([sampled.view(np.int64)], pa.list_(pa.int64()))], _BLOCK_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for lo, hi in passes(batch.column("n").to_numpy()):
                for d, t in zip(batch.column("doc_id")[lo:hi].to_pylist(), batch.column("text")[lo:hi].cast(pa.binary()).to_pylist(), strict=True):
                    if ids and size + len(t) > p.block_bytes:
                        yield row(block, ids, texts)
                        block, ids, texts, size = block + 1, [], [], 0
                    ids.append(d)
                    texts.append(t)
                    size += len(t) + 1
        if ids:
            yield row(block, ids, texts)

    return run


_BLOCK = "block long, n_bytes long, n_windows long, ids binary, sizes binary, text binary, v binary, several binary, sampled array<long>"
_BLOCK_NAMES = [c.split(" ")[0] for c in _BLOCK.split(", ")]


def _range_of(v: np.ndarray, ranges: int) -> np.ndarray:
    return (v >> np.uint64(16)).astype(np.int64) * ranges >> 32


def _deal(ranges: int):
    """A block's minimizers by range; ranges without any get no row, so rows are never more than minimizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, bits in zip(*(batch.column(c).to_pylist() for c in ("block", "v", "several")), strict=True):
                v = _values(packed)
                several = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(v)]
                owner = _range_of(v, ranges)
                held = np.unique(owner)
                bounds = np.append(np.searchsorted(owner, held), len(v)).tolist()
                spans = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([block] * len(held), pa.int64()), pa.array([squeeze(np.diff(v[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()), pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary())], ["range", "block", "v", "several"])

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """The minimizers of a range that several documents have, for each block that holds them."""
    each = [_values(x) for x in pdf["v"]]
    every = np.concatenate(each)
    times = 1 + np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: len(v)] for b, v in zip(pdf["several"], each, strict=True)]).astype(np.int64)
    order = np.argsort(every)
    first = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(np.add.reduceat(times[order], first), np.diff(first, append=len(order)))
    found = np.split(total > 1, np.cumsum([len(v) for v in each])[:-1])
    rows = [(b, squeeze(np.diff(v[f], prepend=np.uint64(0)))) for b, v, f in zip(pdf["block"], each, found, strict=True) if f.any()]
    return pd.DataFrame(rows, columns=["block", "v"])


def _distinct(text: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """Words (a space after each) by number, in the order of their first place."""
    offsets = np.concatenate((np.zeros(1, np.int64), ends))
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text))]).dictionary_encode()


@dataclass
class _Spelling:
    """The distinct words of a block's windows: the number of each covered word (others: 0), and text, first bytes, range and frequency of each distinct one."""

    code: np.ndarray
    text: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, words: _Words, lead: np.ndarray, length: int, ranges: int) -> _Spelling:
        edge = np.zeros(len(words.start) + 1, np.int32)
        edge[lead] += 1
        edge[lead + length] -= 1
        covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
        text, first = words.spaced(covered)
        every = _distinct(text, first[1:])
        index, code = every.indices.to_numpy(), np.zeros(len(words.start), np.int32)
        code[covered] = index
        buffers = every.dictionary.buffers()
        first = np.frombuffer(buffers[1], np.int64)[: len(every.dictionary) + 1]
        text = np.frombuffer(buffers[2], np.uint8)[: first[-1]]
        hashes = _Words(text, first[:-1], first[1:] - 1, np.zeros(len(first) - 1, np.int64)).hashes()
        return cls(code, text, first, (hashes >> np.uint64(32)).astype(np.int64) * ranges >> 32, np.bincount(index))

    def dealt(self) -> list[dict]:
        """The words of each range, and how often they occur."""
        turn = np.argsort(self.owner, kind="stable")
        held, begin = np.unique(self.owner[turn], return_index=True)
        size, rows = np.diff(self.first), []
        for r, a, b in zip(held.tolist(), begin.tolist(), [*begin[1:].tolist(), len(turn)], strict=True):
            own = turn[a:b]
            rows.append({"range": r, "text": _zip(_cut_strings(self.text, self.first[own], size[own])), "times": squeeze(self.times[own].astype(np.int64))})
        return rows

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        """The number in the corpus of each covered word, from those of the ranges, one range after the other."""
        number = np.empty(len(codes), np.int64)
        number[np.argsort(self.owner, kind="stable")] = codes
        return number.astype(np.uint32 if int(number.max()) < 2**32 else np.int64)[self.code]


def _numberer(ranges: int):
    """Numbers of the distinct words of a range, the most frequent first; ranges take turns, so no number is given twice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_unzip(x) for x in pdf["text"]]
        text, r = np.concatenate(each), int(pdf["range"].iloc[0])
        index = _distinct(text, np.flatnonzero(text == 0x20) + 1).indices.to_numpy()
        total = np.bincount(index, np.concatenate([_longs(x) for x in pdf["times"]]))
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        codes = np.split((rank * ranges + r)[index], np.cumsum([np.count_nonzero(x == 0x20) for x in each])[:-1])
        return pd.DataFrame({"block": pdf["block"], "range": r, "codes": [squeeze(c) for c in codes]})

    return run


def _planner(p: PrefixTreeParams, trees: int, heavy: list[np.ndarray], ranges: int):
    """A block's suffixes that another document may have: their places, the number of each one's class of equal windows, the place of each class and its tree,
    and the distinct words of the classes, for the ranges that number them.

    Classes come in the order of trees. Equal windows with other white space between their words can be two classes; the tree brings them together.
    """

    def tree_of(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, rest = np.empty(len(at), np.int64), np.arange(len(at))
        for j, h in enumerate(_prefix_hashes(words, at, p.length)):
            more = np.isin(h[rest], heavy[j]) if j < len(heavy) and len(heavy[j]) else np.zeros(len(rest), bool)
            done = rest if j == p.length - 1 else rest[~more]
            out[done] = (mix64(h[done] + np.uint64(j)) >> np.uint64(32)).astype(np.int64) * trees >> 32
            rest = rest[more]
            if not len(rest):
                break
        return out

    def run(key, packed: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "places", "numbers", "leads", "trees", "amounts", "words"]
        if not len(packed) or not len(shared):
            return pd.DataFrame([], columns=columns)
        buf, starts, sizes = _opened(packed["text"].iloc[0], packed["sizes"].iloc[0])
        words = _Words.of(buf, starts, sizes)
        ids, hashes, at = _unzip(packed["ids"].iloc[0], "i8"), words.hashes(), words.windows(p.length).astype(words.start.dtype)
        known = np.sort(np.concatenate([_values(x) for x in shared["v"]]))
        v = _minimizers(hashes, p)
        at = np.concatenate([x[known[np.minimum(np.searchsorted(known, v[x]), len(known) - 1)] == v[x]] for x in np.split(at, range(_SLICE, len(at), _SLICE))])
        del v
        if not len(at):
            return pd.DataFrame([], columns=columns)
        for h in _prefix_hashes(hashes, at, p.length):
            pass
        order = np.lexsort((ids[words.doc[at]], h)).astype(at.dtype)
        h, size, begin = h[order], (words.end[at + p.length - 1] - words.start[at])[order], words.start[at[order]]
        same = (h[1:] == h[:-1]) & (size[1:] == size[:-1])
        del h
        for pairs in np.split(np.flatnonzero(same), range(_SLICE, np.count_nonzero(same), _SLICE)):
            same[pairs] = equal_strings(buf, begin[pairs + 1], begin[pairs], size[pairs])
        del size, begin
        fresh = np.concatenate(([True], ~same))
        number = np.empty(len(at), at.dtype)
        number[order] = np.cumsum(fresh, dtype=at.dtype) - 1
        lead = at[order[fresh]]
        del order, same, fresh
        tree = tree_of(hashes, lead)
        turn = np.lexsort((lead, tree))
        back = np.empty(len(turn), np.int64)
        back[turn] = np.arange(len(turn))
        held, amounts = np.unique(tree, return_counts=True)
        return pd.DataFrame([(int(key[0]), squeeze(np.diff(at.astype(np.int64), prepend=0)), squeeze(back[number]), squeeze(lead[turn].astype(np.int64)), squeeze(held), squeeze(amounts.astype(np.int64)), _Spelling.of(words, lead, p.length, ranges).dealt())], columns=columns)

    return run


def _longs(x: bytes) -> np.ndarray:
    return unsqueeze(x, np.int64, 8)


def _sender(p: PrefixTreeParams, ranges: int):
    """The classes of a block for each tree: least documents, and the numbers of their windows' words, the first words of all before the second ones."""

    def run(key, packed: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "tree", "docs", "width", "symbols"]
        if not len(packed) or not len(found):
            return pd.DataFrame([], columns=columns)
        buf, starts, sizes = _opened(packed["text"].iloc[0], packed["sizes"].iloc[0])
        words, plan = _Words.of(buf, starts, sizes), found[found["range"] < 0]
        ids, lead = _unzip(packed["ids"].iloc[0], "i8"), _longs(plan["leads"].iloc[0])
        codes = found[found["range"] >= 0].sort_values("range")["codes"]
        number = _Spelling.of(words, lead, p.length, ranges).numbered(np.concatenate([_longs(x) for x in codes]))
        doc, ends = ids[words.doc[lead]], np.cumsum(_longs(plan["amounts"].iloc[0]))
        step, rows = np.arange(p.length)[:, None], []
        for tree, a, b in zip(_longs(plan["trees"].iloc[0]).tolist(), np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            rows.append((int(key[0]), tree, squeeze(doc[a:b]), number.itemsize, squeeze(number[step + lead[a:b]].reshape(-1))))
        return pd.DataFrame(rows, columns=columns)

    return run


class SuffixTree:
    """A suffix tree cut at ``depth`` words, as an array: suffixes in the order of their words, and the words each shares with the one before it.

    ``text`` holds the suffixes one after the other, ``depth`` words each, a space after every word; or it is the words by number, (depth, suffixes).
    """

    def __init__(self, text: np.ndarray, depth: int):
        if text.ndim == 1:
            text = _distinct(text, np.flatnonzero(text == 0x20) + 1).indices.to_numpy().reshape(-1, depth).T
        self.symbols = text
        bits = max(int(text.max()) if text.size else 0, 1).bit_length()
        step = max(63 // bits, 1)
        keys = []
        for lo in range(0, depth, step):
            key = np.zeros(text.shape[1], np.int64)
            for column in text[lo : lo + step]:
                key = key << bits | column.astype(np.int64)
            keys.append(key)
        self.order = np.lexsort(keys[::-1])
        shared = np.ones(max(len(self.order) - 1, 0), bool)
        self.common = np.zeros(len(self.order), np.int16)
        for column in text:
            near = column[self.order]
            shared &= near[1:] == near[:-1]
            self.common[1:] += shared

    def deep_nodes(self, length: int) -> np.ndarray:
        """For each suffix (as given) the number of the highest node of ``length`` words or more above it; alone there, it is a leaf."""
        node = np.empty(len(self.order), np.int64)
        node[self.order] = np.cumsum(self.common < length) - 1
        return node


def _resolver(p: PrefixTreeParams):
    """For each block's classes in a tree, whether another block has the window in a smaller document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_longs(x) for x in pdf["docs"]]
        doc = np.concatenate(each)
        symbols = [unsqueeze(x, np.uint32 if w == 4 else np.int64, w).reshape(p.length, -1) for x, w in zip(pdf["symbols"], pdf["width"].tolist(), strict=True)]
        node = SuffixTree(np.concatenate(symbols, axis=1), p.length).deep_nodes(p.length)
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc)
        bits = np.split(least[node] < doc, np.cumsum([len(x) for x in each])[:-1])
        return pd.DataFrame({"block": pdf["block"], "tree": pdf["tree"], "bits": [np.packbits(b).tobytes() for b in bits]})

    return run


_CUT = "doc_id long, n_words long, spans array<struct<start:long,length:long>>, kept binary"


def _cutter(p: PrefixTreeParams):
    def run(key, packed: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        buf, starts, sizes = _opened(packed["text"].iloc[0], packed["sizes"].iloc[0])
        words, ids = _Words.of(buf, starts, sizes), _unzip(packed["ids"].iloc[0], "i8")
        edge = np.zeros(len(words.start) + 1, np.int32)
        plan = found[found["tree"] < 0]
        if len(plan):
            replies = found[found["tree"] >= 0].sort_values("tree")
            lead, amounts = _longs(plan["leads"].iloc[0]), _longs(plan["amounts"].iloc[0])
            smaller = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(replies["bits"], amounts.tolist(), strict=True)]).astype(bool)
            at, number = np.cumsum(_longs(plan["places"].iloc[0])), _longs(plan["numbers"].iloc[0])
            gone = at[smaller[number] | (ids[words.doc[lead]][number] < ids[words.doc[at]])]
            edge[gone] += 1  # a place stands there once
            edge[gone + p.length] -= 1
        covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
        first = np.searchsorted(words.doc, np.arange(len(ids) + 1, dtype=words.doc.dtype))  # a document's first word
        begin = covered.copy()
        begin[1:] &= ~covered[:-1] | (words.doc[1:] != words.doc[:-1])
        over = covered.copy()
        over[:-1] &= ~covered[1:] | (words.doc[1:] != words.doc[:-1])
        lo, hi = np.flatnonzero(begin), np.flatnonzero(over) + 1
        where = np.searchsorted(lo, first)
        del edge, begin, over
        text, offsets = words.spaced(~covered)
        place = offsets[np.concatenate(([0], np.cumsum(~covered, dtype=words.doc.dtype)))[first]]
        del words, buf, offsets, covered
        rows = []
        for i, d in enumerate(ids.tolist()):
            spans = [{"start": int(a - first[i]), "length": int(b - a)} for a, b in zip(lo[where[i] : where[i + 1]], hi[where[i] : where[i + 1]], strict=True)]
            rows.append((d, int(first[i + 1] - first[i]), spans, text[place[i] : max(place[i + 1] - 1, place[i])].tobytes()))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "spans", "kept"])

    return run


def remove_repeated_passages(docs: DataFrame, params: PrefixTreeParams = PrefixTreeParams()) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` as doc_id, n_words, spans (removed, in words), kept (the words left, joined by one space).

    Words are runs of bytes other than ASCII white space, taken as they are. A word goes if a window of ``length`` words that
    covers it also starts in a document of smaller doc_id; all windows are judged on the input, and none crosses documents. Null texts have no
    words. Rows with a null doc_id keep all their words and compare with nothing; rows that repeat a doc_id don't cut each other. A text longer than a
    block is a block of its own. An empty table gives an empty result; further columns are ignored, whatever their names.

    The driver holds the prefixes that are extended: at most ``length`` for each quarter of a tree. Scratch: blocks, plans and replies feed the
    result and stay until ``clear_scratch``.
    """
    p, spark = params, docs.sparkSession
    if not 2 <= p.k <= p.length:
        raise ValueError("k must lie between 2 and length")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.where("doc_id is not null").withColumn("n", F.octet_length("text"))
    n_bytes = known.agg(F.sum("n")).first()[0] or 0

    # Bucketed, so that the three passes below, which bring something to each block, leave the blocks where they are.
    name, path = f"prefix_trees_{uuid.uuid4().hex}", f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    buckets = min(100_000, max(1, -(-n_bytes // (p.bucket_blocks * p.block_bytes))))
    known.mapInArrow(_blocks(p), _BLOCK).write.option("compression", "none").option("path", path).bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    keep_scratch(path)
    blocks = spark.table(name)
    texts = blocks.select("block", "ids", "sizes", "text").groupBy("block")

    ranges = max(1, -(-n_bytes // p.range_bytes))
    dealt = blocks.select("block", "v", "several").mapInArrow(_deal(ranges), "range long, block long, v binary, several binary")
    shared = dealt.groupBy("range").applyInPandas(_shared, "block long, v binary")

    n_windows = blocks.agg(F.sum("n_windows")).first()[0] or 0
    trees = max(1, -(-n_windows // p.tree_suffixes))
    prefixes = blocks.select(F.posexplode("sampled").alias("at", "h")).groupBy((F.col("at") % (p.length - 1)).alias("depth"), "h").count()
    often = prefixes.where(F.col("count") * p.sample > p.tree_suffixes // 4).collect()  # at most 4 * length * n_windows / tree_suffixes
    heavy = [np.array([r["h"] for r in often if r["depth"] == j], np.int64).view(np.uint64) for j in range(p.length - 1)]

    plans = materialise(texts.cogroup(shared.groupBy("block")).applyInPandas(_planner(p, trees, heavy, ranges), "block long, places binary, numbers binary, leads binary, trees binary, amounts binary, words array<struct<range:long,text:binary,times:binary>>"), "none")
    codes = plans.select("block", F.inline("words")).groupBy("range").applyInPandas(_numberer(ranges), "block long, range long, codes binary")
    none = [F.lit(None).cast("binary").alias(c) for c in ("leads", "trees", "amounts")]
    told = plans.select("block", F.lit(-1).cast("long").alias("range"), F.lit(None).cast("binary").alias("codes"), "leads", "trees", "amounts").union(codes.select("block", "range", "codes", *none))
    sent = texts.cogroup(told.groupBy("block")).applyInPandas(_sender(p, ranges), "block long, tree long, docs binary, width int, symbols binary")
    replies = materialise(sent.groupBy("tree").applyInPandas(_resolver(p), "block long, tree long, bits binary"), "none")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("places", "numbers", "leads", "amounts")]
    found = plans.select("block", F.lit(-1).cast("long").alias("tree"), F.lit(None).cast("binary").alias("bits"), "places", "numbers", "leads", "amounts").union(replies.select("block", "tree", "bits", *nothing))
    cut = texts.cogroup(found.groupBy("block")).applyInPandas(_cutter(p), _CUT)

    bare = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    unknown = rows.where("doc_id is null").select("doc_id", F.size(bare).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"), F.array_join(bare, " ").alias("kept"))
    return cut.withColumn("kept", F.col("kept").cast("string")).union(unknown)
