"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece of text there is one token that ends the prefix's encoding. It is the one
token that ends there, that plain merging leaves whole, and that stays apart when merged together with
the token that ends the prefix before it. ``Prefixes`` stores that token for each prefix: the encoding
is read off backwards, bytes can be appended without a look at older ones, and after an edit only the
prefixes from the edit on are made anew, until as many in a row as the longest token has bytes agree
with what was stored.

``bpe_encode_decode`` is the DataFrame operator. Defined results: null is an empty text; an empty text
has no tokens and the digests of no bytes; other columns are ignored; rows that repeat give as many
rows; an empty table gives an empty table. Whole texts are encoded; memory is that of a few texts and
of a bounded memory of chunks (``REMEMBERED``, twice at most) in each Python worker.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from docloom.llm._chunks import Memory, chunks
from docloom.llm._words import batches, freed, keeps
from docloom.session import ship

REMEMBERED = 1 << 19
#: The split pattern of the usual byte-level vocabularies (a fixed value).
USUAL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes from which a piece's prefixes are not shared with other pieces.
LONG = 256
#: Bytes by which tokens that can end a prefix are looked up.
_TAIL = 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks of byte strings; a rank is also the id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self._whole: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = Memory(self._parts, len(ranks))
        self._apart: dict[int, bool] = Memory(self._stays_apart, 1 << 16)
        by_tail: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) >= _TAIL:
                by_tail.setdefault(token[-_TAIL:], set()).add(len(token))
        self._by_tail = by_tail
        self.lengths: dict[bytes, tuple[int, ...]] = Memory(self._lengths, 1 << 16)

    def merged(self, data: bytes) -> list[int]:
        """The encoding by repeated merging of the pair of least rank; the rule that prefixes follow."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, i: int) -> bool:
        """Whether merging leaves the token's bytes as that one token."""
        known = self._whole.get(i)
        if known is None:
            known = self._whole[i] = self.merged(self.bytes_of[i]) == [i]
        return known

    def _parts(self, i: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a whole token joins; None for a byte."""
        data, get = self.bytes_of[i], self.ranks.get
        if len(data) == 1:
            return None
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 2:
            ranks = [get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return get(parts[0]), get(parts[1])

    def _stays_apart(self, pair: int) -> bool:
        """Whether merging the bytes of two whole tokens leaves the border between them. Merges are undone from
        the last one back; at each moment the tokens at the border must not have a merge that comes earlier
        than what was undone (of two merges of one rank, the left one is earlier)."""
        a, b = divmod(pair, 1 << 32)
        get, data, parts, until = self.ranks.get, self.bytes_of, self.parts, 1 << 60
        while True:
            merge = get(data[a] + data[b])
            if merge is not None and merge < until:
                return False
            of_a, of_b = parts[a], parts[b]
            if of_a is not None and (of_b is None or a > b):
                until, a = a, of_a[1]
            elif of_b is not None:
                until, b = b + 1, of_b[0]
            else:
                return True

    def _lengths(self, tail: bytes) -> tuple[int, ...]:
        """Lengths of tokens that end with a tail of ``_TAIL`` bytes, or that a shorter one ends with; longest first."""
        short = [n for n in range(1, min(_TAIL, len(tail) + 1)) if tail[-n:] in self.ranks]
        return tuple(sorted([*self._by_tail.get(tail, ()), *short], reverse=True))

    def last_token(self, data: bytes, last) -> int:
        """The token that ends data's encoding; ``last(n)`` is the one that ends that of data[:n]."""
        get, known, apart, end = self.ranks.get, self._whole, self._apart, len(data)
        for n in self.lengths[data[-_TAIL:]]:
            begin = end - n
            if begin < 0:
                continue
            i = get(data[begin:])
            if i is not None and (known.get(i) or self.whole(i)) and (begin == 0 or apart[last(begin) << 32 | i]):
                return i
        raise ValueError(f"no token for byte {data[end - 1]}")


class PrefixStore:
    """The last token of each prefix of every byte string that was encoded, shared by all of them.

    Strings that begin alike share prefixes, and the prefixes of a new string are made only from the
    longest one that is stored. It holds ``most`` prefixes, or those of one longer string.
    """

    def __init__(self, vocabulary: Vocabulary, most: int):
        self.vocabulary, self.most = vocabulary, most
        self.last: dict[bytes, int] = {}

    def ids(self, data: bytes) -> list[int]:
        last, n = self.last, len(data)
        end = n
        while end and data[:end] not in last:
            end -= 1
        if end < n:
            if len(last) + n > self.most:
                self.last = last = {}
                end = 0
            step = lambda m: last[data[:m]]
            for k in range(end + 1, n + 1):
                prefix = data[:k]
                last[prefix] = self.vocabulary.last_token(prefix, step)
        out, sizes = [], self.vocabulary.bytes_of
        while n:
            i = last[data[:n]]
            out.append(i)
            n -= len(sizes[i])
        return out[::-1]


class Prefixes:
    """The last token of each prefix of a byte string; ``last[i]`` is that of ``data[:i + 1]``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _token(self, end: int) -> int:
        begin = max(0, end - self.vocabulary.longest - 1)  # no token that ends here begins before
        if begin:  # keep one byte before, so that no token counts as the first
            return self.vocabulary.last_token(self.data[begin:end], lambda m: self.last[begin + m - 1])
        return self.vocabulary.last_token(self.data[:end], lambda m: self.last[m - 1])

    def append(self, more: bytes) -> None:
        """Exact: prefixes that are stored do not depend on what follows."""
        begin = len(self.data)
        self.data += more
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._token(end))

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Replace data[begin:end]; returns the number of prefixes made anew."""
        old, tail = self.last[end:], self.data[end:]
        self.data = self.data[:begin] + new + tail
        self.last = self.last[:begin]
        agree, made, start = 0, 0, begin + len(new)
        for at in range(begin + 1, len(self.data) + 1):
            self.last.append(self._token(at))
            made += 1
            if at > start:
                agree = agree + 1 if self.last[-1] == old[at - start - 1] else 0
                if agree >= self.vocabulary.longest:
                    self.last += old[at - start :]
                    break
        return made

    def ids(self) -> list[int]:
        out, end, sizes = [], len(self.data), self.vocabulary.bytes_of
        while end:
            out.append(self.last[end - 1])
            end -= len(sizes[out[-1]])
        return out[::-1]


class Codec:
    """Texts to ids and back. A piece that is itself a token is that token, as in tiktoken."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        self.usual = pattern == USUAL_PATTERN
        self.chunk_ids = Memory(self._chunk, remembered)
        self.prefixes = PrefixStore(self.vocabulary, 2 * remembered)
        self.name = {i: str(i) for i in self.vocabulary.bytes_of}

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.prefixes.ids(data) if len(data) <= LONG else Prefixes(self.vocabulary, data).ids()

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if self.usual:  # letters after at most one space, and at most one mark: what the pattern gives
            body = chunk[1:] if chunk[:1] == " " else chunk
            if body.isalpha():
                return tuple(self._piece(chunk))
            if body[-1:] in (",", ".") and body[:-1].isalpha():
                return (*self._piece(chunk[:-1]), *self._piece(chunk[-1]))
        return tuple(chain.from_iterable(map(self._piece, self.pieces(chunk))))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.chunk_ids.__getitem__, chunks(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class EncodedText:
    """A text with its chunks' ids: appends and edits encode the chunks about them only."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec = codec
        self.parts = chunks(text)

    def append(self, more: str) -> None:
        self.edit(sum(map(len, self.parts)), None, more)

    def edit(self, begin: int, end: int | None, new: str) -> None:
        """Replace text[begin:end] by ``new``; a chunk on each side is encoded with it."""
        at, edges = 0, [0]
        for p in self.parts:
            at += len(p)
            edges.append(at)
        end = at if end is None else end
        first = max(0, sum(e <= begin for e in edges) - 2)
        last = min(len(self.parts), sum(e < end for e in edges) + 1)
        around = "".join(self.parts[first:last])
        text = around[: begin - edges[first]] + new + around[end - edges[first] :]
        self.parts[first:last] = chunks(text)

    def text(self) -> str:
        return "".join(self.parts)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(map(self.codec.chunk_ids.__getitem__, self.parts)))


@lru_cache(maxsize=2)
def codec_of(path: str, pattern: str, remembered: int = REMEMBERED) -> Codec:
    """One codec for a vocabulary file in each Python worker."""
    return Codec(read_ranks(path), pattern, remembered)


keeps("bpe", codec_of.cache_clear)


def _encode(path: str, pattern: str, with_ids: bool, remembered: int):
    def run(it):
        codec = codec_of(path, pattern, remembered)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches(it, 1):
            counts, ids_sha, decoded_sha, all_ids = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = codec.encode(text or "")
                counts.append(len(ids))
                ids_sha.append(sha(" ".join(map(codec.name.__getitem__, ids)).encode()))
                decoded_sha.append(sha(codec.decode(ids)))
                if with_ids:
                    all_ids.append(ids)
            out = [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def bpe_encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; with ``with_ids`` also ids.

    ``remembered`` bounds what a worker keeps (about 400 MB of chunks and prefixes at 2**19, 150 MB at 2**17); less
    costs time, and the results are the same.
    """
    ship(docs.sparkSession)
    shape = T.StructType([docs.schema["doc_id"]]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        shape = shape.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(freed(_encode(path, pattern, with_ids, remembered), "bpe"), shape)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """The rows with the bytes of their ids as UTF-8 text; a null list gives null."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def text_of(column):
        table = codec_of(path, "").vocabulary.bytes_of
        return column.map(lambda x: None if x is None else b"".join(map(table.__getitem__, x)).decode("utf-8", "replace"))

    return encoded.withColumn(to, text_of(F.col(ids)))
