"""Texts made so that weak 64-bit hashes of them are equal."""

import hashlib
import random
from collections import Counter

import pytest

from docloom.llm.substring_dedup import cut_repeats, substring_dedup
from tests.llm.test_exact import frame, removed, split

MASK, P1, P2 = 2**64 - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F
INVERSE = pow(P2, -1, 2**64)


def same_xxhash(rng):
    """Two beginnings of 64 bytes: texts that go on alike have one xxhash64 of seed 42."""
    letters = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    number = lambda b: int.from_bytes(b, "little")

    def lane(x):
        v = 42 + P1 + P2 + number(x) * P2 & MASK
        return (v << 31 | v >> 33) * P1 & MASK

    x, y, middle, end = letters(8), letters(8), b" " + letters(22) + b" ", b" " + letters(22) + b" "
    while True:
        other = letters(8)
        z = ((lane(x) + number(y) * P2 - lane(other)) * INVERSE & MASK).to_bytes(8, "little")
        if other != x and all(33 <= c < 127 for c in z):
            return (x + middle + y + end).decode(), (other + middle + z + end).decode()


def same_sums():
    """Two words whose bytes times powers of any odd base have one sum mod 2**64 (Thue-Morse)."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def windows(rng):
    """Over 64 contents about a common run, in pairs that differ by one of those words."""
    core = [f"w{i}" for i in range(20)]
    return [(j, " ".join([*(f"p{j // 2}_{i}" for i in range(7)), *core, same_sums()[j % 2], *(f"q{j // 2}_{i}" for i in range(7))])) for j in range(150)]


def contents(n):
    """n stretches that have copies, and one of the same hash beside each that has none."""

    def rows(rng):
        core = " ".join(f"c{i}" for i in range(31))
        pairs = [same_xxhash(rng) for _ in range(n)]
        return [(3 * j + k, x + core) for j, (a, b) in enumerate(pairs) for k, x in enumerate((a, a, b))]

    return rows


def names(rng):
    """Rows of one doc_id, and of none, whose texts have one hash."""
    out = []
    for j in range(4):
        a, b = same_xxhash(rng)
        core = " ".join(f"k{j}_{i}" for i in range(60))
        out += [(7 if j % 2 else None, a + core), (8, a + core), (7 if j % 2 else None, b + core)]
    return out


@pytest.mark.parametrize("make", [windows, contents(30), contents(70), names], ids=["windows", "few contents", "many contents", "names"])
def test_equal_hashes(spark, make):
    rows = [(i, t, 0, "", "") for i, t in make(random.Random(3))]
    docs, want = frame(spark, rows), removed(rows, 35)
    got = substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    digest = lambda t: hashlib.sha256(b" ".join(split(t))).hexdigest()
    assert Counter((r.doc_id, digest(r.text)) for r in cut_repeats(docs).collect()) == Counter((a, d) for a, _, _, d in want)
