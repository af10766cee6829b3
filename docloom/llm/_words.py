"""Word fingerprints of whole Arrow batches of texts.

A text's words are its maximal runs of bytes that are no separators. Words of a batch are hashed
together from one prefix sum of ``byte value * base ** position`` (mod 2**64), so the cost is a few
array passes over the bytes and no Python object is made for a word. Long batches are walked in
blocks that end at separators; memory beside the words' arrays is that of one block, or of one word
if it is longer than a block.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_BLOCK = 1 << 16
_BASE = U(0x9E3779B97F4A7C15 | 1)
_MULT = U(0xD6E8FEB86659FD93)
_values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xA0761D6478BD642F)
    return h ^ (h >> U(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = U(pow(int(_BASE), -1, 2**64))
_P = _powers(_BASE, _BLOCK + 1)
_Q = _powers(_INVERSE, _BLOCK + 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (_P, _Q) if n <= _BLOCK else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))


class Words:
    """The words of a batch: hash, first byte, end byte (in ``data``), and each text's slice."""

    __slots__ = ("data", "hash", "start", "end", "first", "at")

    def __init__(self, data, h, start, end, first, at):
        self.data, self.hash, self.start, self.end, self.first, self.at = data, h, start, end, first, at

    def __len__(self) -> int:
        return len(self.first) - 1


def words_of(column: pa.Array, lower: bool = False, separators: bytes = SPACES) -> Words:
    """Words of a string or binary column; a null has none.

    ``first[i]:first[i + 1]`` are the words of text i; ``at[i]`` is its first byte in ``data``.
    """
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, values = column.buffers()
    o = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    sizes = np.diff(o)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    data = np.full(int(at[-1]), 10, np.uint8)  # one separator after each text
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(n):
        if valid[i]:
            data[at[i] : at[i] + sizes[i]] = raw[o[i] : o[i + 1]]
        else:
            data[at[i] : at[i] + sizes[i]] = 10
    is_sep = np.zeros(256, bool)
    is_sep[list(separators) + [10]] = True
    table = _values.copy()
    if lower:
        table[65:91] = table[97:123]
    hashes, starts, ends = [], [], []
    pos, total = 0, len(data)
    while pos < total:
        end = min(pos + _BLOCK, total)
        if end < total:
            back = np.flatnonzero(is_sep[data[pos:end]])
            if len(back):
                end = pos + int(back[-1]) + 1
            else:  # a word longer than a block: go on to its end
                size = _BLOCK
                while end < total and not is_sep[data[end - 1]]:
                    size *= 2
                    more = np.flatnonzero(is_sep[data[end : pos + size]])
                    end = end + int(more[0]) + 1 if len(more) else min(pos + size, total)
        block = data[pos:end]
        p, q = _tables(len(block))
        sep = is_sep[block]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if not sep[0]:
            edge = np.concatenate(([0], edge))
        s, e = edge[0::2], edge[1::2]  # a block ends with a separator
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(table[block] * p[: len(block)], out=sums[1:])
        hashes.append((sums[e] - sums[s]) * q[s])
        starts.append(s + pos)
        ends.append(e + pos)
        pos = end
    none = np.zeros(0, np.int64)
    h = mix(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    start = np.concatenate(starts) if starts else none
    return Words(data, h, start, np.concatenate(ends) if ends else none, np.searchsorted(start, at), at)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, by first word; runs past a text's end are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _MULT
        g += h[j : j + n]
    return mix(g + U(k))


def batches(it, text: int | None = None, most: int = 1 << 22):
    """The batches of an iterator, without empty ones; cut so that column ``text`` has about
    ``most`` bytes in each (one row at least), so that memory follows neither the rows nor the
    sizes of the batches that Spark sends."""
    for batch in it:
        if not batch.num_rows:
            continue
        if text is None or batch.nbytes <= most:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - 1) // most
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


_KEPT: dict = {}


def keeps(name: str, clear) -> None:
    """``clear`` empties what an operator keeps in a worker from one task to the next."""
    _KEPT[name] = clear


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freed(run, name: str = ""):
    """``run`` for mapInArrow in a worker that lives on after a task, and that may have served others: what
    operators of other names keep is let go before, and unused memory is given back to the system after."""

    def with_release(it):
        others = [clear for other, clear in _KEPT.items() if other != name]
        for clear in others:
            clear()
        if others:
            gc.collect()  # what was kept may hold itself
            _release()
        yield from run(it)
        _release()

    return with_release
