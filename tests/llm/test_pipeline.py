"""Each stage of the corpus pipeline, and the whole of it, against brute force on a table with nulls, empty and long
texts, ties, repeated rows, columns with clashing names, and no rows at all."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
import pytest
import tiktoken
from docloom.llm import quality_rules as Q
from docloom.llm.bpe import read_ranks
from tests.llm.test_exact import grouped, removed, shingles, split
from tests.llm.test_rules import base, edit_distance

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, _row string, found long, digest string"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    words = lambda n: [word() for _ in range(n)]
    texts = [None, "", " \n", "short text", " ".join(["same"] * 90)]
    passage, item = words(60), words(12)
    clean = [words(rng.randint(60, 140)) for _ in range(30)]
    texts += [" ".join(w) for w in clean]
    texts += ["\n".join([" ".join(words(40)), " ".join(passage), " ".join(words(40))]) for _ in range(4)]
    for k in (0, 0, 1, 5):
        near = list(clean[k])
        near[7] = word()
        texts.append("  ".join(near).upper() if k else " ".join(near))
    texts += [" ".join(clean[3])] * 2
    for k in range(4):
        hit = list(item)
        for i in range(k):
            hit[3 * i + 1] = word()
        texts.append(" ".join(words(50) + hit + words(30)))
    texts += [" ".join(words(30_000))]
    shout = [" ".join(w.upper() + "###" for w in words(80)) for _ in range(30)]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "k", "r", i, "d") for i, t in enumerate(texts + shout)]
    first_bad = len(texts)
    rows += [rows[8], rows[8], rows[0], (None, " ".join(words(70)), None, None, None, None, None, None, None)]
    labels = [(i, int(i < first_bad), 0) for i in range(5, len(texts) + len(shout))] + [(None, 1, 0), (6, None, None), (9999, 0, 1), (7, 1, 0), (7, 1, 0)]
    bench = [(0, " ".join(item)), (0, " ".join(item)), (1, None), (2, ""), (3, " ".join(words(9)))]
    return rows, labels, bench


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels, bench = corpus()
    for name, values, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(values, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return folder


def good(spark, folder, rows):
    rules = Q.learn_rules(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert rules
    kept = []
    for r in rows:
        n, chars, symbols, dup, repeat, failed = base(r[1])
        lines = len([x for x in (r[1] or "").split("\n") if x.strip(" \t\r\x0b\x0c")])
        part = lambda a, b: a / b if b else 0.0
        upper = len(re.findall("[A-Z]", r[1] or ""))
        values = dict(zip(Q.FEATURES, (part(symbols, chars), part(upper, chars), part(chars, n), part(dup, lines), part(repeat, n))))
        low = any(all((values[c.feature] > c.limit) == c.above for c in rule) for rule in rules)
        if not failed and not low:
            kept.append(r)
    return kept


def one_of_each(rows):
    sets, group, least = grouped(rows)
    out, seen = [], set()
    for r, s, g in sorted(zip(rows, sets, group), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if not s or g not in seen:
            out.append(r)
        seen.add(g if s else None)
    return out


def without_repeats(rows):
    digests = removed(rows, 35)
    return [(r[0], d) for r, (_, _, _, d) in zip(rows, digests)]


def clean_of(rows, bench):
    norm = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    items = [norm(t) for _, t in bench if norm(t)]
    return [r for r in rows if not any(edit_distance(x, norm(r[1])) <= len(x) // 5 for x in items if norm(r[1]))]


def key(rows):
    return Counter((r[0], r[1]) for r in rows)


def test_every_stage_and_the_whole(spark, data):
    rows, _, bench = corpus()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = [f for _, f in P.STAGES]

    kept = stages[0](spark, docs, data)
    assert kept.columns == docs.columns
    one = kept.collect()
    assert Counter(map(tuple, one)) == Counter(good(spark, data, rows)) and 30 < len(one) < len(rows)

    second = stages[1](spark, kept, data)
    assert second.columns == docs.columns
    two = second.collect()
    assert key(two) == key(one_of_each([tuple(r) for r in one])) and len(two) < len(one)

    third = stages[2](spark, second, data)
    assert third.columns == docs.columns
    three = third.collect()
    digest = lambda t: hashlib.sha256(b" ".join(split(t))).hexdigest()
    assert Counter((r.doc_id, digest(r.text)) for r in three) == Counter(without_repeats([tuple(r) for r in two]))
    assert all(r.n_chars == len(r.text) for r in three) and sum(len(split(r.text)) for r in three) < sum(len(split(r.text)) for r in two)

    fourth = stages[3](spark, third, data)
    assert fourth.columns == docs.columns
    four = fourth.collect()
    assert Counter(map(tuple, four)) == Counter(clean_of([tuple(r) for r in three], bench)) and len(four) < len(three)

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in four:
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())] += 1
    assert Counter(map(tuple, stages[4](spark, fourth, data).collect())) == want
    assert Counter(map(tuple, P.run(spark, data).collect())) == want


def test_stages_on_texts_without_words(spark, data):
    """Rows that the first stage would drop, given to the others: nulls and empty texts stay as they are."""
    rows = [(1, None, "en", "s", 0, "", "", 0, ""), (1, None, "en", "s", 0, "", "", 0, ""), (2, "", "en", "s", 0, "", "", 0, ""), (None, " ", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in P.STAGES[1:4]:
        assert Counter((r.doc_id, r.text) for r in stage(spark, docs, data).collect()) == key(rows)
    assert sorted((r.n_tokens for r in P.STAGES[4][1](spark, docs, data).collect())) == [0, 0, 0, 1]
    assert P.STAGES[0][1](spark, docs, data).count() == 0 and shingles(" ") == set()


def test_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, data).count() == 0
