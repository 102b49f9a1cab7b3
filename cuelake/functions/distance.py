"""Edit distance of many pairs of texts at once, as a pandas function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows of a word; the first band, and how it widens; pairs of a block, and words that it may hold.
WORD, BAND, WIDER, PAIRS, TABLE = 64, 64, 2, 1024, 1 << 22
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def _points(texts: list[str], longest: int) -> np.ndarray:
    """Code points plus 1 as (place, text); 0 after a text's end."""
    out = np.zeros((longest, len(texts)), np.int64)
    for i, t in enumerate(texts):
        out[: len(t), i] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        out[: len(t), i] += 1
    return out


def _banded(a: list[str], b: list[str], band: int) -> np.ndarray:
    """Distances of non-empty texts whose lengths differ by at most ``band``: exact up to it, and above it no less than it.

    Myers' bit vectors, word by word and for all pairs at once: bits of ``up`` and ``down`` tell where a column of the table grows or falls by one
    from row to row. Words outside the band are not met; a word that leaves it at the top counts one more with each column, as the table's first row does.
    """
    pairs, rows = len(a), np.array([len(t) for t in a])
    ends = np.array([len(t) for t in b])
    x, y = _points(a, rows.max()), _points(b, ends.max())
    known = np.zeros(max(x.max(), y.max()) + 1, bool)
    known[x] = known[y] = True
    known[0] = True
    code = np.cumsum(known) - 1
    lanes, words = np.arange(pairs), -(-len(x) // WORD)
    match = np.zeros((words, code[-1] + 1, pairs), np.uint64)
    for i, c in enumerate(code[x]):
        match[i // WORD, c, lanes] |= _ONE << np.uint64(i % WORD)
    match, places = match.reshape(words, -1), code[y] * pairs + lanes
    up, down = np.full((words, pairs), _ALL), np.zeros((words, pairs), np.uint64)
    held = np.clip(rows - WORD * np.arange(words)[:, None], 0, WORD).astype(np.uint64)
    inside = np.where(held == WORD, _ALL, (_ONE << (held % np.uint64(WORD))) - _ONE)
    grown = lambda first, last, mask: (np.bitwise_count(up[first:last] & mask).astype(np.int64) - np.bitwise_count(down[first:last] & mask)).sum(0)
    above, out, low = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64), 0
    eq, turn, flat, p, m, *carry = np.empty((9, pairs), np.uint64)
    one, last = _ONE, np.uint64(WORD - 1)
    done = {n: np.flatnonzero(ends == n) for n in set(ends.tolist())}
    for j, place in enumerate(places):
        if (j - band) // WORD > low:
            above += grown(low, low + 1, _ALL)
            low += 1
        more, less, p_out, m_out = 1, 0, *carry[:2]
        for w in range(low, min(words, (j + band) // WORD + 1)):
            u, d = up[w], down[w]
            match[w].take(place, out=eq, mode="clip")
            np.bitwise_or(eq, d, out=turn)
            eq |= less
            np.bitwise_and(eq, u, out=flat)
            flat += u
            flat ^= u
            flat |= eq  # in p and m, cells grow or fall by one from the column before
            np.bitwise_or(flat, u, out=p)
            np.invert(p, out=p)
            p |= d
            np.bitwise_and(u, flat, out=m)
            np.right_shift(p, last, out=p_out)
            np.right_shift(m, last, out=m_out)
            np.left_shift(p, one, out=p)
            p |= more
            np.left_shift(m, one, out=m)
            m |= less
            np.bitwise_and(p, turn, out=d)
            turn |= p
            np.invert(turn, out=turn)
            np.bitwise_or(m, turn, out=u)
            more, less, p_out, m_out = p_out, m_out, *(carry[2:] if p_out is carry[0] else carry[:2])
        if j + 1 in done:
            at = done[j + 1]
            out[at] = above[at] + j + 1 + grown(low, words, inside[low:])[at]
    return out


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs, in characters. Pairs of about one length share a block; those that the band is too narrow for go on to a wider one."""
    la, lb = np.array([len(t) for t in a], np.int64), np.array([len(t) for t in b], np.int64)
    out, band = np.maximum(la, lb), BAND
    left = np.flatnonzero((la > 0) & (lb > 0))
    left = left[np.array([a[i] != b[i] for i in left], bool)]
    out[[i for i in range(len(a)) if a[i] == b[i]]] = 0
    while len(left):
        left = left[np.lexsort((la[left], lb[left]))]
        near, wide = left[np.abs(la[left] - lb[left]) <= band], [left[np.abs(la[left] - lb[left]) > band]]
        while len(near):
            # A block has a word for each 64 rows, character and pair, and a few for each place of a text.
            first = near[:PAIRS]
            characters = set().union(*[a[i] for i in first], *[b[i] for i in first])
            size = -(-max(la[first].max(), lb[first].max()) // WORD) * max(len(characters) + 1, WORD)
            block, near = np.split(near, [max(1, min(PAIRS, TABLE // int(size)))])
            found = _banded([a[i] for i in block], [b[i] for i in block], band)
            out[block] = np.where(found <= band, found, out[block])
            wide.append(block[found > band])
        left, band = np.concatenate(wide), band * WIDER
    return out


def _edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.NA, index=a.index, dtype="Int32")
    out[known] = edit_distances(a[known].tolist(), b[known].tolist())
    return out


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in characters, null if either text is."""
    return F.pandas_udf(_edit_distance, "int")(a, b)
