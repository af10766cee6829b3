"""Indel similarity of strings: 2 * LCS / (|a| + |b|), whole and best window. Arrow-batched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _lcs(masks: dict[str, int], m: int, text: str) -> int:
    """Length of the longest common subsequence, a row of bits for each character of text."""
    full = (1 << m) - 1
    row = full
    for c in text:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return m - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100; two empty strings are alike."""
    if not a and not b:
        return 100.0
    return 200.0 * _lcs(_masks(a), len(a), b) / (len(a) + len(b)) if a else 0.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a window of its length, cut at either end of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    m, n = len(a), len(b)
    masks = _masks(a)
    # One pass gives the LCS of every prefix, and one backwards that of every suffix.
    best = max(_best_prefix(masks, m, b[: m]), _best_prefix(_masks(a[::-1]), m, b[: n - m - 1 if n > m else None : -1]))
    start, most = 0, best * m / 100.0  # windows inside have the same length, so their LCS decides
    while start + m <= n:
        found = _lcs(masks, m, b[start : start + m])
        most = max(most, found)
        start += int(most - found) + 1  # a step changes the LCS by one at most
    return 100.0 * most / m


def _best_prefix(masks: dict[str, int], m: int, text: str) -> float:
    """The best ratio of the pattern to a prefix of text."""
    full = (1 << m) - 1
    row, best = full, 0.0
    for h, c in enumerate(text, 1):
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
        best = max(best, 200.0 * (m - row.bit_count()) / (m + h))
    return best


_LANES = 4096  # windows that are compared side by side
_BITS = 62  # of a word of a row of bits; the rest takes the carry
_FULL = np.uint64((1 << _BITS) - 1)


def codes_of(texts: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Numbers of the characters that occur, the texts in them one after another, each text's place."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen, codes = np.unique(points, return_inverse=True)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=first[1:])
    return {chr(c): i for i, c in enumerate(seen.tolist())}, codes, first


def _rows(masks: np.ndarray, codes: np.ndarray, starts: np.ndarray, m: int):
    """Rows of bits of an LCS with the text at each start, after each of m characters."""
    rows = np.full((len(masks), len(starts)), _FULL)
    at = starts.copy()
    for _ in range(m):
        c = codes[at]
        at += 1
        carry = np.uint64(0)
        for row, mask in zip(rows, masks):
            u = row & mask[c]
            x = row + u + carry
            carry = x >> np.uint64(_BITS)
            row[:] = (x | (row ^ u)) & _FULL
        yield rows


def best_partial_ratio(a: str, texts: tuple[dict[str, int], np.ndarray, np.ndarray], floor: float = 0.0) -> float:
    """The best ``partial_ratio`` of a to texts that are not shorter, given by ``codes_of``; exact where it
    is above the floor, which else is returned.

    Windows of a's length are compared side by side, first at a stride. A step changes the LCS by one at
    most, so between two windows g apart it is (x + y + g) / 2 at most; only gaps that can hold a better one
    are halved.
    """
    symbols, codes, first = texts
    m, best = len(a), floor
    if not m or len(first) < 2:
        return best

    def masks_of(pattern: str) -> np.ndarray:
        out = np.zeros((-(-m // _BITS), len(symbols)), np.uint64)
        for c, bits in _masks(pattern).items():
            if c in symbols:
                out[:, symbols[c]] = [bits >> _BITS * w & int(_FULL) for w in range(len(out))]
        return out

    masks, size = masks_of(a), -(-m // _BITS) * _BITS
    common = lambda rows: size - np.bitwise_count(rows).sum(0, dtype=np.int64)

    def windows(starts: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(starts), _LANES):
            for rows in _rows(masks, codes, starts[i : i + _LANES], m):
                pass
            out.append(common(rows))
        return np.concatenate(out)

    back, total = codes[::-1], len(codes)
    for pattern, source, starts in ((masks, codes, first[:-1]), (masks_of(a[::-1]), back, total - first[1:])):
        for i in range(0, len(starts), _LANES):
            for h, rows in enumerate(_rows(pattern, source, starts[i : i + _LANES], m), 1):
                if 200.0 * h / (m + h) > best:
                    best = max(best, 200.0 * int(common(rows).max()) / (m + h))
    stride = max(1, m // 8)
    places = [np.append(np.arange(s, e - m, stride), e - m) for s, e in zip(first[:-1].tolist(), first[1:].tolist())]
    at, text = np.concatenate(places), np.repeat(np.arange(len(places)), [len(x) for x in places])
    found = windows(at)
    best = max(best, 100.0 * int(found.max()) / m)
    same = text[1:] == text[:-1]
    left, right, x, y = at[:-1][same], at[1:][same], found[:-1][same], found[1:][same]
    while len(left):
        keep = (right - left > 1) & (100.0 * ((x + y + right - left) // 2) / m > best)
        left, right, x, y = left[keep], right[keep], x[keep], y[keep]
        middle = (left + right) // 2
        z = windows(middle)
        best = max(best, 100.0 * int(z.max()) / m) if len(z) else best
        left, right, x, y = np.concatenate((left, middle)), np.concatenate((middle, right)), np.concatenate((x, z)), np.concatenate((z, y))
    return best


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _lcs(_masks(x), len(x), y) if x else 0 for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def indel_partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b)])
