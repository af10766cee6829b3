"""Jaccard join of documents on word n-grams, by prefix trees, and the components of its links.

A document's set is its distinct shingles of ``N`` words (hashed to 64 bits); documents link when
``100 * intersection >= PERCENT * union``. Documents of equal sets form a class, known by a digest of the
set and its size, and only classes are joined.

1. One global order of shingles: first those not known to be frequent, by hash, then the frequent ones,
   rarest first. Frequent shingles are counted over all documents; at most ``FREQUENT_KEPT`` of them
   are kept (24 bytes each, which is what is broadcast). Any one order gives exact results; this one keeps
   shared passages and common lines out of prefixes.
2. Two linked sets share a shingle of their prefixes, the first ``n - ceil(PERCENT / 100 * n) + 1``
   shingles. Prefixes are dealt by shingle. Up to ``SMALL`` classes at a shingle give their pairs; more
   give a star about the class that has most shingles in common with others.
3. Pairs pass bounds of size and of parity sketches, of 1,024 bits, and for large sets of as many bits as
   they need (the sketches of two sets differ in no more bits than the sets in shingles). Classes left fall
   into groups about stars' centres. A group's sets, in the global order, make a prefix tree, which each set
   of the group walks down, sharing partial overlaps and leaving subtrees whose remaining lengths cannot
   reach the overlap that is needed, or that hold only what it is already connected with. A tree gives
   the links that join components, no others.
4. Links make components (stars about least neighbours, until nothing changes). Shingles with more than
   ``SMALL`` classes that are in two components or more then give for each two components their closest
   pair by sketches, and after that all pairs between components that are still apart. Steps 3 and 4 follow
   for these. So no link between components is lost, and a large group of near copies costs stars, not its
   square.

Hot keys: copies are one class; a frequent shingle's classes are dealt by a salt and streamed; groups over ``TREE`` sets or ``TREE_SHINGLES`` shingles are dealt
to trees by a salt, and a set visits another tree only where it has a pair there; joins on documents'
classes are plain joins, which Spark can split.

Defined results: A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; fewer than ``N`` words are one
shingle; null texts and texts without words have an empty set and are alone; rows that repeat are copies
of each other; a null doc_id takes part, but is no component_id unless it is alone; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docloom.llm._words import batches, freed, grams, words_of
from docloom.llm.substring_dedup import keyed
from docloom.session import cut, drop, ship

N = 5
PERCENT = 80
FREQUENT_KEPT = 1 << 17
FREQUENT_LEAST = 8
SMALL = 8
#: Sets and shingles of a tree, about.
TREE = 256
TREE_SHINGLES = 1 << 20
#: Classes of a frequent shingle that are dealt to one task, about.
DEALT = 1 << 12
#: Routes of texts to trees that are broadcast at most, of about 60 bytes each; more go by a shuffle.
BROADCAST_ROUTES = 1 << 18
#: Shingles of a class that are listed with it, so that its pairs are made once.
LISTED = 64
_SKETCH = 16
_CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def sets_of(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes (uint64)."""
    w = words_of(texts, lower=True)
    g = grams(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        else:
            out.append(grams(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles by their last ten bits, as 16 longs."""
    bits = np.bincount((s & np.uint64(64 * _SKETCH - 1)).astype(np.int64), minlength=64 * _SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(s: np.ndarray) -> bytes | None:
    """For sets that the small sketch is too narrow for: parities by two to four times as many bits as
    shingles. The halves of a wide sketch fold into one of half the bits."""
    if len(s) <= 32 * _SKETCH:
        return None
    bits = 1 << (2 * len(s) - 1).bit_length()
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_difference(a: bytes, b: bytes) -> int:
    """Bits that differ between two wide sketches, at the width of the narrower one."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class Order:
    """The global order: frequent shingles with their keys, which are above all others, and the numbers of
    parts that they are dealt in."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        """shingles: the frequent ones, most frequent first."""
        by = np.argsort(shingles)
        self.values = shingles[by]
        self.keys = np.uint64(2**64 - 1) - by.astype(np.uint64)
        parts = -(-counts[by] // DEALT)
        self.hot, self.parts = self.values[parts > 1], parts[parts > 1]

    def frequent(self, s: np.ndarray):
        """Which of s are frequent, and the place in ``values`` of those."""
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        return self.values[at] == s, at

    def ordered(self, s: np.ndarray) -> np.ndarray:
        """The set's keys in the global order: hashes, then the keys of frequent shingles."""
        if not len(self.values):
            return s
        is_frequent, at = self.frequent(s)
        return np.concatenate([s[~is_frequent], np.sort(self.keys[at[is_frequent]])])

    def prefix(self, s: np.ndarray, p: int) -> np.ndarray:
        """The first p shingles of a sorted set."""
        if not len(self.values):
            return s[:p]
        for part in (s[: 2 * p], s):
            is_frequent, at = self.frequent(part)
            plain = part[~is_frequent]
            if len(plain) >= p:
                return plain[:p]
        rest = s[is_frequent]
        return np.concatenate([plain, rest[np.argsort(self.keys[at[is_frequent]])][: p - len(plain)]])

    def salts(self, s: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """Which of its shingle's parts a class belongs to, from 1; 0 where the shingle is dealt whole."""
        out = np.zeros(len(s), np.int32)
        if len(self.hot) and len(s):
            at = np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)
            hit = np.flatnonzero(self.hot[at] == s)
            out[hit] = 1 + (digests[hit].view(np.uint64) % self.parts[at[hit]].astype(np.uint64)).astype(np.int32)
        return out


def _counts(n: int):
    """text to (shingle, number of distinct sets with it in a chunk of the task), of two or more."""

    def run(it):
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def flush():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            some = times > 1
            return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(times[some].astype(np.int64))], ["shingle", "n"])

        for b in batches(it, 0):
            for s in sets_of(b.column(0), n):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    held.append(s)
                    size += len(s)
            if size >= _CHUNK:
                yield flush()
                held, size, seen = [], 0, set()
        if held:
            yield flush()

    return run


def _members(n: int, percent: int, order):
    """(doc_id, text_key, text) to (doc_id, text_key, n, digest, sketch, wide, prefix); the last three once
    for each digest that a task meets."""

    def run(it):
        shared = order.value
        seen: set = set()
        for b in batches(it, 2):
            sets = sets_of(b.column(2), n)
            sizes, digests, sketches, wides, prefixes = [], [], [], [], []
            for s in sets:
                d = digest(s) if len(s) else None
                sizes.append(len(s))
                digests.append(d)
                if d is None or d in seen:
                    sketches.append(None)
                    wides.append(None)
                    prefixes.append(None)
                    continue
                if len(seen) >= 1 << 17:
                    seen.clear()
                seen.add(d)
                sketches.append(sketch(s))
                wides.append(wide_sketch(s))
                prefixes.append(shared.prefix(s, prefix_length(len(s), percent)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(wides, pa.binary()), pa.array(prefixes, pa.binary())],
                ["doc_id", "text_key", "n", "digest", "sketch", "wide", "prefix"],
            )

    return run


def _postings(order):
    """(digest, prefix) to (shingle, salt, digest)."""

    def run(it):
        shared = order.value
        for b in batches(it, 1, 1 << 20):
            blob = b.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in blob])
            shingles = np.frombuffer(b"".join(blob), np.uint64)
            digests = np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(shared.salts(shingles, digests)), pa.array(digests)], ["shingle", "salt", "digest"])

    return run


def _pairs(small: int):
    """(shingle, salt, digest) rows in order to candidate pairs (shingle, a, b, large).

    More than ``small`` classes, and those of a part, are listed as pairs with their first class, which are
    streamed: what is held is up to ``small`` classes, or a list's first class.
    """

    def run(it):
        names = ["shingle", "a", "b", "large"]

        def batch(shingle, a, b, large):
            return pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(a), pa.array(b), pa.array(np.full(len(a), large))], names)

        def group_of(shingle, salt):
            return shingle.view(np.uint64) + salt.astype(np.uint64) * _ODD

        none = np.zeros(0, np.int64)
        held = (none, none.astype(np.int32), none)
        star = None  # group, first class and last class of a star that goes on

        def judged(t, salt, d):
            if not len(t):
                return
            g = group_of(t, salt)
            edges = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            sizes = np.diff(np.append(edges, len(t)))
            salted = salt[edges] > 0
            for k in range(2, small + 1):
                at = edges[(sizes == k) & ~salted]
                if len(at):
                    i, j = np.triu_indices(k, 1)
                    yield batch(np.repeat(t[at], len(i)), d[at[:, None] + i].ravel(), d[at[:, None] + j].ravel(), False)
            for e, k, own in zip(edges[(sizes > small) | salted], sizes[(sizes > small) | salted], salted[(sizes > small) | salted]):
                e, k = (e, k) if own else (e + 1, k - 1)
                first = d[e] if own else d[e - 1]
                yield batch(t[e : e + k], np.full(k, first), d[e : e + k], True)

        for b in batches(it):
            t, salt, d = (np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(held))
            g = group_of(t, salt)
            new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))
            t, salt, d, g = t[new], salt[new], d[new], g[new]
            if star is not None:
                others = np.flatnonzero(g != star[0])
                k = int(others[0]) if len(others) else len(g)
                more = d[:k][d[:k] > star[2]]
                if len(more):
                    yield batch(np.full(len(more), t[0]), np.full(len(more), star[1]), more, True)
                    star = (star[0], star[1], more[-1])
                if k == len(t):
                    held = (t[:0], salt[:0], d[:0])
                    continue
                t, salt, d, g, star = t[k:], salt[k:], d[k:], g[k:], None
            others = np.flatnonzero(g != g[-1])
            k = int(others[-1]) + 1 if len(others) else 0
            yield from judged(t[:k], salt[:k], d[:k])
            held = (t[k:], salt[k:], d[k:])
            if len(held[0]) > small:
                yield from judged(*held)
                star = (g[-1], held[2][0], held[2][-1])
                held = (t[:0], salt[:0], d[:0])
        yield from judged(*held)

    return run


class PrefixTree:
    """Sorted sets as a path-compressed tree; each node knows the sizes of the sets below it."""

    __slots__ = ("run", "children", "ends", "least", "most")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ends = run, {}, []
        self.least, self.most = 1 << 62, 0

    def add(self, key, values: np.ndarray) -> None:
        node, n = self, len(values)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if not len(values):
                node.ends.append((key, n))
                return
            child = node.children.get(int(values[0]))
            if child is None:
                leaf = PrefixTree(values)
                leaf.ends.append((key, n))
                leaf.least = leaf.most = n
                node.children[int(values[0])] = leaf
                return
            k = min(len(values), len(child.run))
            differ = np.flatnonzero(values[:k] != child.run[:k])
            k = int(differ[0]) if len(differ) else k
            if k < len(child.run):  # split the child's run
                upper = PrefixTree(child.run[:k])
                upper.least, upper.most = child.least, child.most
                child.run = child.run[k:]
                upper.children[int(child.run[0])] = child
                node.children[int(values[0])] = child = upper
            node, values = child, values[k:]

    def join(self, probe: np.ndarray, percent: int, passed_over=lambda key: False):
        """(key, overlap) of the sets that link with the sorted set ``probe``, without those that
        ``passed_over`` names; leaves that hold no others are not looked at."""
        m = len(probe)
        need = lambda n: -(-percent * (m + n) // (100 + percent))
        stack = [(self, 0, 0, 0)]  # node, depth, overlap, elements of probe passed
        while stack:
            node, depth, overlap, passed = stack.pop()
            if not node.children and all(passed_over(key) for key, _ in node.ends):
                continue
            at = np.searchsorted(probe, node.run) if len(node.run) else np.zeros(0, np.int64)
            if len(at):
                overlap += int((probe[np.minimum(at, m - 1)] == node.run).sum())
                depth += len(node.run)
                passed = int(at[-1])
            # Below, need(n) grows slower than n - depth, so the largest set is bounded best.
            if overlap + min(node.most - depth, m - passed) < need(node.least):
                continue
            for key, n in node.ends:
                if overlap >= need(n) and not passed_over(key):
                    yield key, overlap
            stack.extend((c, depth, overlap, passed) for c in node.children.values())


class TreeGroup:
    """Sets in a prefix tree, and what their links connect."""

    def __init__(self, percent: int):
        self.percent, self.tree, self.own = percent, PrefixTree(np.zeros(0, np.uint64)), {}
        self.parent: dict[int, int] = {}
        self.walked = False

    def root(self, key: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(key, key)) != key:
            parent[key] = parent.setdefault(up, up)
            key = up
        return key

    def add(self, key: int, ordered: np.ndarray) -> None:
        self.tree.add(key, ordered)
        self.own[key] = ordered

    def _connect(self, at: int | None, ordered: np.ndarray) -> int | None:
        """Connect what the set links with, and ``at`` if it is given; a set of the tree that it is connected with."""
        for other, _ in self.tree.join(ordered, self.percent, lambda k: at is not None and self.root(k) == self.root(at)):
            if at is not None:
                x, y = self.root(other), self.root(at)
                self.parent[max(x, y)] = min(x, y)
            at = other
        return at

    def walk_own(self) -> None:
        if not self.walked:
            for key, ordered in self.own.items():
                self._connect(key, ordered)
        self.walked = True

    def visit(self, key: int, ordered: np.ndarray):
        """The link of a set from outside to what it is connected with."""
        self.walk_own()
        at = self._connect(None, ordered)
        return [] if at is None else [(key, at)]

    def links(self):
        """Links of the tree's own sets to the least set that each is connected with."""
        self.walk_own()
        return [(key, root) for key in self.own if (root := self.root(key)) != key]


def _trees(n: int, percent: int, order):
    """(hub, salt, key, guest, text), sorted, guests last in each group, to links (a, b)."""

    def run(it):
        shared, at, group = order.value, None, None
        out: list[tuple[int, int]] = []

        def links():
            x, y = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        for batch in batches(it, 4):
            keys = zip(*(c.to_pylist() for c in batch.columns[:4]))
            for (hub, salt, key, guest), s in zip(keys, sets_of(batch.column(4), n)):
                if (hub, salt) != at:
                    if group is not None:
                        out.extend(group.links())
                    at, group = (hub, salt), TreeGroup(percent)
                if not guest:
                    group.add(key, shared.ordered(s))
                    continue
                out.extend(group.visit(key, shared.ordered(s)))
            if out:
                yield links()
        if group is not None:
            out.extend(group.links())
        if out:
            yield links()

    return run


def _differ() -> Column:
    """Bits that differ between the sketches of classes x and y."""
    return sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(1, _SKETCH)), F.bit_count(F.col("x.sketch")[0].bitwiseXOR(F.col("y.sketch")[0])))


def _may_link(percent: int) -> Column:
    """Bounds on a pair of classes x and y from their sizes and sketches."""
    x, y = F.col("x.n"), F.col("y.n")
    need = F.ceil((percent * (x + y)) / F.lit(100.0 + percent) - 1e-9)
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (_differ() <= x + y - 2 * need)


def _wide_filter(percent: int):
    """(a, b, m, n, v, w): sizes m, n and wide sketches v, w of a pair, to the pairs that they let link."""

    def run(it):
        for batch in batches(it):
            a, b, m, n, v, w = (c.to_pylist() for c in batch.columns)
            keep = [x is None or y is None or sketch_difference(x, y) <= p + q - 2 * -(-percent * (p + q) // (100 + percent)) for p, q, x, y in zip(m, n, v, w)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that links reach, for each node that has a link."""

    def are_stars(edges: DataFrame) -> bool:
        """Whether every node has one edge and no root has one."""
        ends = edges.select(F.explode(F.array(F.struct("u", F.lit(1).alias("out")), F.struct(F.col("v").alias("u"), F.lit(0).alias("out")))).alias("e"))
        return ends.groupBy("e.u").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("least")).filter("out > 1 or out = 1 and least = 0").isEmpty()

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not are_stars(edges):
        # Large star: each larger neighbour goes to the least one. Small star: each smaller one too.
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        after = cut(small.filter("u <> v").distinct())
        drop(edges)
        edges = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, order, n: int, percent: int) -> DataFrame:
    """Links that make the components that the candidate pairs (a, b) of classes make by their links.
    docs: doc_id, text_key, text; pairs: cut.

    A class belongs to the group of its least star's centre (the first of a pair), or to its own if it is
    no one's second. A document of each class sends its text to its group's tree, and to other trees where
    the class has a pair: texts compress better than hashed sets, and each set is made where it is joined.
    """
    ends = pairs.select(F.col("b").alias("node"), F.col("a").alias("hub")).unionByName(pairs.select(F.col("a").alias("node"), F.lit(None).cast("bigint").alias("hub")))
    hubs = ends.groupBy("node").agg(F.min("hub").alias("hub")).withColumn("hub", F.coalesce("hub", "node"))
    at = cut(hubs.join(classes.select(F.col("digest").alias("node"), "n", "doc"), "node"))
    salts = at.groupBy("hub").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TREE, F.sum("n") / TREE_SHINGLES)).cast("int").alias("salts"))
    placed = at.join(salts, "hub").select("node", "hub", "doc", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    own = placed.select("doc", "hub", "salt", F.col("node").alias("key"), F.lit(False).alias("guest"))
    x, y = placed.alias("x"), placed.alias("y")
    elsewhere = (F.col("x.hub") != F.col("y.hub")) | (F.col("x.salt") != F.col("y.salt"))
    apart = pairs.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & elsewhere)
    guests = apart.select("x.doc", "y.hub", "y.salt", F.col("a").alias("key"), F.lit(True).alias("guest")).distinct()
    wanted = cut(own.unionByName(guests))
    drop(at)
    wanted = (F.broadcast(wanted) if wanted.count() <= BROADCAST_ROUTES else wanted).alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc.doc_id")) & (F.col("d.text_key") == F.col("w.doc.text_key"))
    rows = docs.alias("d").join(wanted, same).select("w.hub", "w.salt", "w.key", "w.guest", "d.text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "guest", "key")
    return rows.mapInArrow(freed(_trees(n, percent, order)), "a bigint, b bigint")


def mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (shingle, digest) with their root, of shingles whose members have several roots."""
    at = members.join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    several = at.groupBy("shingle").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("shingle")
    return at.join(several, "shingle", "left_semi")


def stars(members: DataFrame) -> DataFrame:
    """Each shingle's members (shingle, digest) against the one that has most shingles in common with
    others: what copies were made from has more than a copy."""
    degree = members.groupBy("digest").agg(F.count(F.lit(1)).alias("degree"))
    centre = members.join(degree, "digest").groupBy("shingle").agg(F.max(F.struct("degree", "digest")).alias("c")).select("shingle", F.col("c.digest").alias("a"))
    return members.join(centre, "shingle").select("a", F.col("digest").alias("b")).filter("a <> b")


def between(at: DataFrame, classes: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Pairs of a shingle's members with different roots that bounds let link: for each two roots the closest
    pair by sketches, or all. Two classes of up to ``LISTED`` such shingles are paired at the least one
    they share; others at each, and made distinct."""
    lists = at.groupBy("digest").agg(F.collect_list("shingle").alias("all")).select("digest", F.when(F.size("all") <= LISTED, F.col("all")).alias("all"))
    at = at.join(lists.join(classes.select("digest", "n", "sketch"), "digest"), "digest")
    x, y = at.alias("x"), at.alias("y")
    apart = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.digest") < F.col("y.digest")) & (F.col("x.root") != F.col("y.root"))
    once = F.coalesce(F.array_min(F.array_intersect("x.all", "y.all")) == F.col("x.shingle"), F.lit(True))
    a, b = F.col("x.digest").alias("a"), F.col("y.digest").alias("b")
    pairs = x.join(y, apart & _may_link(percent) & once)
    if not closest:
        return pairs.select(a, b).distinct()
    roots = F.least("x.root", "y.root").alias("r"), F.greatest("x.root", "y.root").alias("s")
    return pairs.groupBy(*roots).agg(F.min(F.struct(_differ().alias("differ"), a, b)).alias("p")).select("p.a", "p.b").distinct()


def ngram_join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, text_key, n_shingles, component_id (the least doc_id that links
    reach, its own included), class_id (equal for documents of equal sets, null for an empty set) and
    is_first (whether it is its component's document of least doc_id, then text_key)."""
    spark = docs.sparkSession
    ship(spark)
    d = keyed(docs)
    counted = d.select("text").mapInArrow(freed(_counts(n)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "shingle").limit(FREQUENT_KEPT).toArrow()
    values = top.column("shingle").to_numpy().view(np.uint64)
    order = spark.sparkContext.broadcast(Order(values, top.column("n").to_numpy()))

    shape = T.StructType([d.schema["doc_id"]]).add("text_key", "long").add("n", "long").add("digest", "long").add("sketch", T.ArrayType(T.LongType())).add("wide", "binary").add("prefix", "binary")
    members = cut(d.mapInArrow(freed(_members(n, percent, order)), shape))
    postings = members.filter("prefix is not null").select("digest", "prefix").mapInArrow(_postings(order), "shingle bigint, salt int, digest bigint")
    candidates = cut(postings.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "digest").mapInArrow(freed(_pairs(SMALL)), "shingle bigint, a bigint, b bigint, large boolean"))
    large = cut(candidates.filter("large").select("shingle", F.explode(F.array("a", "b")).alias("digest")).distinct())
    pairs = cut(candidates.filter("not large").select("a", "b").unionByName(stars(large)).distinct())
    named = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    ours = members.filter("prefix is not null").join(named, "digest", "left_semi").groupBy("digest")
    first = F.min_by(F.struct("n", "sketch", F.struct("doc_id", "text_key").alias("doc")), F.struct("doc_id", "text_key"))
    classes = cut(ours.agg(first.alias("x")).select("digest", "x.n", "x.sketch", "x.doc"))
    wides = cut(ours.agg(F.min("wide").alias("wide")).filter("wide is not null"))

    def fits(pairs: DataFrame) -> DataFrame:
        x, y = classes.alias("x"), classes.alias("y")
        both = pairs.alias("p").join(x, F.col("p.a") == F.col("x.digest")).join(y, F.col("p.b") == F.col("y.digest"))
        both = both.filter(_may_link(percent)).select("p.a", "p.b", F.col("x.n").alias("m"), F.col("y.n").alias("n"))
        v, w = wides.select(F.col("digest").alias("a"), F.col("wide").alias("v")), wides.select(F.col("digest").alias("b"), F.col("wide").alias("w"))
        return both.join(v, "a", "left").join(w, "b", "left").select("a", "b", "m", "n", "v", "w").mapInArrow(_wide_filter(percent), "a bigint, b bigint")

    rest = cut(fits(pairs))
    links = cut(linked(d, classes, rest, order, n, percent))
    drop(pairs, rest)
    found = components(links)

    if not large.isEmpty():
        for closest in (True, False):
            at = cut(mixed(large, found))
            rest = cut(fits(between(at, classes, percent, closest)))
            if not rest.isEmpty():
                links = cut(links.unionByName(linked(d, classes, rest, order, n, percent)))
                found = components(links)
            drop(at, rest)

    whole = members.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "digest")
    placed = whole.filter("digest is not null").join(found.withColumnRenamed("node", "digest"), "digest", "left")
    # Classes without links are known by digest and size.
    placed = placed.withColumns({"root": F.coalesce("root", "digest"), "_n": F.when(F.col("root").isNull(), F.col("n_shingles")).otherwise(-1)})
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    least = placed.groupBy("root", "_n").agg(F.min(place).alias("least"))
    is_first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    joined = placed.join(least, ["root", "_n"]).select("doc_id", "text_key", "n_shingles", F.col("least.doc_id").alias("component_id"), F.col("digest").alias("class_id"), is_first.alias("is_first"))
    alone = whole.filter("digest is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.col("digest").alias("class_id"), F.lit(True).alias("is_first"))
    return joined.unionByName(alone)


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document of each component, that of the least doc_id (then text);
    of rows that are equal in doc_id and text one stays, unless they have no words."""
    first = cut(ngram_join(docs, n, percent).filter("is_first").groupBy("doc_id", "text_key").agg(F.count_if(F.col("class_id").isNotNull()).alias("times")))
    key = F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), key.alias("_key")).alias("r")
    same = F.col("r._id").eqNullSafe(F.col("j.doc_id")) & (F.col("r._key") == F.col("j.text_key"))
    out = rows.join(first.filter("times < 2").alias("j"), same, "left_semi").select("_row.*")
    again = first.filter("times > 1")
    if again.isEmpty():
        return out
    repeated = rows.join(again.alias("j"), same, "left_semi").dropDuplicates(["_id", "_key"])
    return out.unionByName(repeated.select("_row.*"))
