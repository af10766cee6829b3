"""Further checks against brute force: languages, decision lists, item ids, tokenizer libraries, hostile tables."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from docloom.llm import bpe, decontamination as D, language_id as L, license_scan as S, ngram_join as J, quality_rules as Q, substring_dedup as R, token_counts as C, url_filters as U
from tests.llm.test_exact import joined, removed


def trigram_vector(text):
    """One trigram after another, letter by letter."""
    symbols, blank = [0], True
    for c in text.lower():
        s = int(L._letters()[ord(c)])
        if s or not blank:
            symbols.append(s)
        blank = not s
    if not blank:
        symbols.append(0)
    first, second, third = L._vectors(L.DIMENSIONS)
    out = np.zeros(L.DIMENSIONS)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        out += first[a].astype(float) * second[b] * third[c]
    return out


def test_language_against_brute_force(spark):
    rng = random.Random(4)
    alphabets = {"a": "abcdefg ", "b": "efghijk ", "c": "日本語 éü"}
    make = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n)) + "x"
    rows = [(i, make("abc"[i % 3], rng.randint(5, 300)), "abc"[i % 3] if i % 7 else None, "z") for i in range(90)]
    rows += [rows[4], rows[4], (200, None, "a", ""), (201, "12 !", "b", ""), (None, make("a", 30), "a", ""), (202, make("b", 60_000), None, "")]
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    sums = {}
    for i, t, lang, _ in rows:
        if lang and i is not None and not held(i) and t and any(c.isalpha() for c in t):
            v = trigram_vector(t)
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    names = sorted(sums)
    table = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    got = L.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()
    left = Counter()
    for r in got:
        left[r.doc_id] += 1
    assert left == Counter(r[0] for r in rows)
    texts = {i: t for i, t, _, _ in rows}
    for r in got:
        t = texts[r.doc_id]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = trigram_vector(t)
        cosines = table @ v / np.linalg.norm(v)
        assert r.lang_pred == names[int(np.argmax(cosines))] and abs(r.score - max(0, cosines.max())) < 1e-4
        assert r.held_out == held(r.doc_id)


def test_language_ties_and_empty(spark):
    schema = "doc_id long, text string, lang string"
    assert L.language_id(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, "the same text", lang) for i, lang in enumerate(["z", "b", "q"] * 10)]
    assert {r.lang_pred for r in L.language_id(spark.createDataFrame(rows, schema)).collect()} == {"b"}


def test_best_condition_against_brute_force():
    rng = random.Random(2)
    for _ in range(5):
        rows = [tuple(round(rng.random(), 2) for _ in Q.FEATURES) + (int(rng.random() < 0.6),) for _ in range(80)]
        table = np.array(rows)
        values = {f: table[:, i] for i, f in enumerate(Q.FEATURES)}
        bad = table[:, -1] == 0
        found = Q._best(values, bad, np.ones(len(rows), bool))

        def gain(c):
            inside = [r for r in rows if (r[Q.FEATURES.index(c.feature)] > c.limit) == c.above]
            p = sum(r[-1] == 0 for r in inside)
            return p * (math.log2(p / len(inside)) - math.log2(bad.sum() / len(rows))) if p else 0

        best = 0
        for i, f in enumerate(Q.FEATURES):
            cuts = np.unique(np.quantile(table[:, i], np.linspace(0, 1, 65)))
            for limit in np.unique(np.round((cuts[1:] + cuts[:-1]) / 2, 6)):
                best = max(best, gain(Q.Condition(f, True, limit)), gain(Q.Condition(f, False, limit)))
        assert abs(gain(found) - best) < 1e-9


def test_rules_cover_in_order():
    """Rows of a rule are set aside for the next; rules that are not precise are left out."""
    rows = [(0.5, 0, 5, 0, 0, 0)] * 30 + [(0, 0.9, 5, 0, 0, 0)] * 30 + [(0, 0, 5, 0, 0, 1)] * 60
    rules = Q.cover(rows)
    assert {r[0].feature for r in rules} == {"symbol_share", "upper_share"} and all(len(r) == 1 and r[0].above for r in rules)
    assert Q.cover([(0, 0, 5, 0, 0, i % 2) for i in range(90)]) == [] and Q.cover([]) == []


def test_quality_tables(spark):
    schema, words = "doc_id long, text string, s string, kept string", " ".join(f"w{i}" for i in range(60))
    empty = spark.createDataFrame([], schema)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 0, 0), (2, 3, 0)], "doc_id long, quality int, toxic int")
    assert Q.quality_rules(empty, labels).count() == 0 and Q.learn_rules(empty, labels) == []
    docs = spark.createDataFrame([(1, words, "", "")] * 3 + [(None, None, "", ""), (2, words + " y" * 100_000, "", "")], schema)
    got = Counter((r.doc_id, r.n_words, r.base_failed, r.kept) for r in Q.quality_rules(docs, labels).collect())
    assert got == {(1, 60, False, True): 3, (None, 0, True, False): 1, (2, 100_060, True, False): 1}
    assert Q.learn_rules(docs, labels, sample=1) == []


@pytest.mark.parametrize("kind", ["int", "string", "bigint", "decimal(9,2)"])
def test_item_ids_of_any_type(spark, kind):
    bench = spark.createDataFrame([(7, "one two three four five six"), (7, "one two three four five six"), (7, "one two three four five siz")], "item_id int, text string")
    bench = bench.selectExpr(f"cast(item_id as {kind}) item_id", "text", "text doc_id")
    docs = spark.createDataFrame([(1, "x one two three four five six y", "q")] * 2 + [(2, "ONE, two three FOUR five", "q"), (3, None, "q")], "doc_id int, text string, item_id string")
    got = Counter((r.doc_id, str(r.item_id).split(".")[0], r.distance) for r in D.decontamination(docs, bench).collect())
    assert got == {(1, "7", 0): 2, (2, "7", 1): 1}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_as_the_libraries(spark, name):
    from tests.llm.test_exact import texts

    path = public_tokenizers.path(name)
    some = [None, *texts()[:150], "日本語の文。" * 3000]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in C.token_counts(docs, path).collect()}
    assert got == {i: (len((t or "").encode()), count(t or "")) for i, t in enumerate(some)}


def test_batches_are_of_bytes():
    lists = list(C.by_bytes(["日" * 1000] * 200))
    assert max(sum(len(x.encode()) for x in some) for some in lists) <= C.BATCH_BYTES + 3000 and sum(map(len, lists)) == 200


def test_bpe_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(40_000))
    rows = [(1, long, 0, "", ""), (2, long + " end", 0, "", ""), (3, "x" * 300_000, 0, "", ""), (4, "start " + long[: len(long) // 2], 0, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, at string, text_key string")
    assert Counter(map(tuple, J.ngram_join(docs).select("doc_id", "n_shingles", "component_id").collect())) == Counter(joined(rows))
    assert Counter(map(tuple, R.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == Counter(removed(rows, 35))


def test_licenses_repeat_and_tie(spark):
    line = "Released under the MIT License."
    docs = spark.createDataFrame([(1, line, "")] * 2 + [(2, f"{line}\n\n{line}", ""), (3, "word " * 50_000 + "\n" + line, ""), (None, line, "")], "doc_id long, text string, license string")
    got = Counter((r.doc_id, r.license, r.dice) for r in S.license_scan(docs).collect())
    assert got == {(1, "MIT", 1.0): 2, (2, "MIT", 1.0): 1, (3, "MIT", 1.0): 1, (None, "MIT", 1.0): 1}


def test_urls_repeat_and_long(spark):
    long = "http://a.net/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long, ""), (1, long, ""), (2, "http://b.net/fr/" + "y/" * 20_000, ""), (None, None, "")], "page_id long, url string, verdict string")
    got = Counter((r.page_id, r.host, r.rule, r.verdict) for r in U.url_filters(pages).collect())
    assert got == {(1, "a.net", None, "allow"): 2, (2, "b.net", "net/fr/", "block"): 1, (None, "", None, "allow"): 1}
