"""Operators against brute force on small tables with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from docloom.llm import ngram_join, substring_dedup
from docloom.llm.bpe import Codec, EncodedText, Prefixes, bpe_decode, bpe_encode_decode, read_ranks
from docloom.llm.ngram_join import keep_one
from docloom.llm.substring_dedup import cut_repeats
from docloom.llm.token_counts import token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, n long, at string, text_key string"


def corpus(seed=1):
    """Rows with copies, near copies, shared passages, loops, odd white space, nulls and repeated ids."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    words = lambda n: [word() for _ in range(n)]
    shared = words(60)
    base = words(120)
    texts = [None, "", " \t\n", "one", "one two three four", "A a A a", "x " * 90, ("p q r " * 40).strip(), "é ü " * 50]
    for _ in range(12):
        texts.append(" ".join(words(rng.randint(1, 150))))
    for _ in range(6):
        texts.append(" ".join(words(rng.randint(0, 30)) + shared[rng.randint(0, 10) : rng.randint(50, 60)] + words(rng.randint(0, 30))))
    for _ in range(90):  # over HOT places
        texts.append("\n".join(words(3) + shared + words(2)))
    for _ in range(14):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = word()
        texts.append("  ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    rows = [(i, t, i, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (3, " ".join(base), 1, "x", "y"), (None, " ".join(base), 1, "x", "y"), (None, None, 1, "x", "y")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def split(text):
    return (text or "").encode().split()


def removed(rows, n):
    count = Counter(tuple(w[i : i + n]) for w in (split(r[1]) for r in rows) for i in range(len(w) - n + 1))
    out = []
    for r in rows:
        w = split(r[1])
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((r[0], len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("n", [5, 35])
def test_substring_dedup(spark, n):
    rows = corpus()
    got = substring_dedup.substring_dedup(frame(spark, rows), n).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(removed(rows, n))


def test_substring_dedup_empty(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    assert cut_repeats(frame(spark, [])).count() == 0


def test_cut_repeats_keeps_clean_rows(spark):
    rows = corpus()
    out = cut_repeats(frame(spark, rows)).collect()
    digest = lambda t: hashlib.sha256(b" ".join(split(t))).hexdigest()
    assert Counter((r.doc_id, digest(r.text)) for r in out) == Counter((a, d) for a, _, _, d in removed(rows, 35))
    clean = {(a, t) for (a, t, *_), (_, _, gone, _) in zip(rows, removed(rows, 35)) if not gone}
    assert clean <= {(r.doc_id, r.text) for r in out} and out[0].asDict().keys() == {"doc_id", "text", "n", "at", "text_key"}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def grouped(rows):
    """The rows' sets, their components, and each component's least doc_id."""
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    return sets, group, least


def joined(rows):
    sets, group, least = grouped(rows)
    return [(r[0], len(s), least.get(g) if s else r[0]) for r, s, g in zip(rows, sets, group)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = corpus(seed)
    got = ngram_join.ngram_join(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(joined(rows))


def test_ngram_join_frequent_and_large_groups(spark, monkeypatch):
    """Frequent shingles go last, and shingles of many classes give stars; links stay whole."""
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 2)
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "TREE", 3)
    rows = corpus(4)
    got = ngram_join.ngram_join(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(joined(rows))


def test_keep_one(spark):
    rows = corpus()
    kept = keep_one(frame(spark, rows)).collect()
    sets, group, least = grouped(rows)
    roots = [least[g] for g in {g for g, s in zip(group, sets) if s}]
    assert sorted(r.doc_id for r in kept if shingles(r.text)) == sorted(roots)
    assert sum(not shingles(r.text) for r in kept) == sum(not shingles(r[1]) for r in rows)
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0


def test_prefix_tree():
    import numpy as np

    rng = random.Random(0)
    sets = [np.array(sorted(rng.sample(range(30), rng.randint(1, 20))), np.uint64) for _ in range(200)]
    tree = ngram_join.PrefixTree(np.zeros(0, np.uint64))
    for i, s in enumerate(sets):
        tree.add(i, s)
    for probe in sets[:40]:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 80 * len(np.union1d(s, probe))}
        assert {i for i, _ in tree.join(probe, 80)} == want


def test_sketches_bound_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, m in ((20, 700), (600, 5000), (3000, 3100)):
        a, b = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), np.unique(rng.integers(0, 2**63, m, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], b]))
        x, y = ngram_join.wide_sketch(a), ngram_join.wide_sketch(b)
        assert x is None or ngram_join.sketch_difference(x, y) <= len(np.setxor1d(a, b))


ODD = ["", " ", "  a  b ", "abc<|endoftext|> x", "don't  stop\n\n now　!", "日本語のテキスト 🙂🙂", "\x1c\x1d a\x85b", "x" * 3000, "a  b", "12३४ 5²", "word " * 2000]


def texts(seed=3):
    rng = random.Random(seed)
    letters = "abc the er  \n\t  é1२'s't!?., 　\x1c日🙂\r"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_bpe_against_tiktoken(spark):
    enc, rows = reference(), [(i, t, 0, "", "") for i, t in enumerate([None, *texts()])]
    rows.append(rows[5])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    df = frame(spark, rows)
    assert Counter(map(tuple, bpe_encode_decode(df, RANKS, public_tokenizers.PATTERN).collect())) == want
    back = bpe_decode(bpe_encode_decode(df, RANKS, public_tokenizers.PATTERN, with_ids=True), RANKS)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t, *_ in rows)


def test_bpe_small_memory_and_edits():
    enc, codec = reference(), Codec(read_ranks(RANKS), public_tokenizers.PATTERN, remembered=8)
    rng, all_ = random.Random(1), texts()
    for t in all_:
        assert codec.encode(t) == enc.encode_ordinary(t)
    for _ in range(200):
        t, new = rng.choice(all_)[:200], rng.choice(all_)[:8]
        i = rng.randint(0, len(t))
        j = rng.randint(i, len(t))
        e = EncodedText(codec, t)
        e.edit(i, j, new)
        e.append("x é")
        now = t[:i] + new + t[j:] + "x é"
        assert e.text() == now and e.ids() == enc.encode_ordinary(now)
        p = Prefixes(codec.vocabulary, t.encode())
        a, b = len(t[:i].encode()), len(t[:j].encode())
        p.edit(a, b, new.encode())
        assert p.ids() == codec.vocabulary.merged((t[:i] + new + t[j:]).encode())


def test_tokens_stay_apart():
    """Pairs of tokens against plain merging of their bytes."""
    v, rng = Codec(read_ranks(RANKS), public_tokenizers.PATTERN).vocabulary, random.Random(5)
    whole = [i for i in rng.sample(sorted(v.bytes_of), 1500) if v.whole(i)] + list(range(256))
    pairs = [(rng.choice(whole), rng.choice(whole)) for _ in range(4000)] + [(i, i) for i in whole[:300]]
    for t in texts():
        ids = v.merged(t.encode()[:200])
        pairs += list(zip(ids, ids[1:]))
    assert [v._apart[a << 32 | b] for a, b in pairs] == [v.merged(v.bytes_of[a] + v.bytes_of[b]) == [a, b] for a, b in pairs]


def test_edit_keeps_far_prefixes():
    codec = Codec(read_ranks(RANKS), public_tokenizers.PATTERN)
    p = Prefixes(codec.vocabulary, b"thereof " * 200)
    assert p.edit(3, 4, b"x") < 400


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t, 0, "", "") for i, t in enumerate([None, *texts()])]
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in rows]
    assert sorted(map(tuple, token_counts(frame(spark, rows), path).collect())) == want
    assert token_counts(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    rows = [(i, t, 0, "", "") for i, t in enumerate(["The cat", "", None])]
    got = [r.n_tokens for r in token_counts(frame(spark, rows), path).orderBy("doc_id").collect()]
    assert got[0] >= 2 and got[1:] == [0, 0]
