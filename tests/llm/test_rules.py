"""Rules, scans, languages, pages and decontamination on small tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import decontamination as D, html_text as H, language_id as L, license_scan as S, quality_rules as Q, url_filters as U


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], "doc_id long, text string, s string, words string, lang string")


TEXTS = [None, "", " \n\t", "one", "a b c a b c", "x " * 400, "l1 w\nl2\nl1 w\n \n \nl2 ", "é# *$%&|<>\n", "a b a b a b a b", "word " * 3 + "\r\nq"]


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_base(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["aa ", "b ", "c\n", "\t", "# ", "dd "]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    got = Q.quality_rules(docs(spark, texts)).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {i: base(t) for i, t in enumerate(texts)}
    assert all(r.kept == (not r.base_failed) for r in got)


def test_quality_learns_and_filters(spark):
    rng = random.Random(3)
    clean = [" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(80)) for _ in range(60)]
    shout = [" ".join("".join(rng.choice("ABCDEFG") for _ in range(5)) + "###" for _ in range(80)) for _ in range(30)]
    d = docs(spark, clean + shout + ["short"])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)] + [(None, 1, 0), (5, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    rules = Q.learn_rules(d, labels)
    assert rules and "symbol_share" in str(rules[0][0]) or "upper_share" in str(rules[0][0])
    assert {r.doc_id for r in Q.filter_quality(d, rules=rules).collect()} == set(range(60))
    assert Q.filter_quality(d, rules=rules).columns == d.columns
    assert {r.doc_id for r in Q.quality_rules(d, rules=rules).filter("kept").collect()} == set(range(60))
    assert Q.learn_rules(d, labels.limit(0)) == [] and Q.filter_quality(d.limit(0), labels).count() == 0


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        (None, "", "", None, "allow"),
        ("no scheme/en/", "", "", None, "allow"),
        ("http://A.Example.COM/en/x?y", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://example.com?q=/en/", "example.com", "", None, "allow"),
        ("http://a.net/es/#z", "a.net", "/es/", "net/es/", "block"),
        ("http://anet/es/", "anet", "/es/", None, "allow"),
        ("http://spam-farm.org/en", "spam-farm.org", "/en", None, "block"),
        ("http://www.spam-farm.org/en/1", "www.spam-farm.org", "/en/1", None, "allow"),
        ("ftp://files.org/a", "files.org", "/a", None, "block"),
        ("http://x.org/a?clickid=3", "x.org", "/a", None, "block"),
        ("http://x.org/my-free-download.zip", "x.org", "/my-free-download.zip", None, "block"),
    ],
)
def test_url(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "z"), (1, url, "z")], "page_id long, url string, host string")
    rows = U.url_filters(df).collect()
    assert [tuple(r)[:5] for r in rows] == [(1, host, path, rule, verdict)] * 2


def test_url_tokens():
    assert U.pattern_tokens("||spam-farm.") == ["farm", "spam"]
    assert U.pattern_tokens("*free-download*") == []
    assert U.pattern_tokens("/adserver/*") == ["adserver"]
    assert U.pattern_tokens("ab/cd") == []


def test_url_empty(spark):
    assert U.url_filters(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_licenses(spark):
    mit = S.TEMPLATES["MIT-text"]
    texts = [None, "", "word", "intro\nReleased under the MIT License.\nmore", mit.upper(), mit.replace("granted", "given"), "x\n\nLicensed under CC BY-NC 4.0.", "released under mit"]
    got = {r.doc_id: (r.license, r.dice, r.n_units) for r in S.license_scan(docs(spark, texts)).collect()}
    assert got[0] == got[1] == got[2] == (None, None, 0)
    # The line itself, and the whole text, which reaches the limit exactly: 2 * 4 / (6 + 4).
    assert got[3] == ("MIT", 1.0, 2) and got[4][:2] == ("MIT-text", 1.0) and got[5][0] == "MIT-text" and 0.9 < got[5][1] < 1
    assert got[6][:2] == ("CC-BY-NC-4.0", 1.0) and got[7][0] is None
    assert S.license_scan(docs(spark, [])).count() == 0


def test_languages(spark):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(40))
    rows = [(i, make("abcde" if i % 2 else "vwxyz"), "l1" if i % 2 else "l2") for i in range(100)]
    rows += [(100, None, "l1"), (101, "12 3", "l1"), (102, "", None), (None, "abc", "l1"), (103, make("abcde") * 200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.language_id(df).collect()}
    assert all(got[i].lang_pred == ("l1" if i % 2 else "l2") for i in range(100))
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103].lang_pred == "l1" and all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(103)) and got[None].held_out is False
    none = L.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


PAGE = """<!DOCTYPE html><title>T</title><body><h1>Head  line</h1><p>One <b>bold</b>,
 two<p>Three<ul><li>a<li>b<ol start=3><li>x</li><li>y</ol><li>c</ul>
<table><tr><th>Name<th>Qty<tr><td>Pear<td>10<tr><td colspan=2>wide</table><pre>
 keep   this</pre><div hidden>no</div><div style="color:red; display: none">no</div>&copy; x &amp; y<script>var a="</p>";</script> end <!-- c --> fin"""


def test_html():
    assert H.html_to_text(PAGE) == (
        "Head line\n\nOne bold, two\n\nThree\n\n- a\n- b\n 3. x\n 4. y\n- c\n\nName | Qty\nPear | 10\nwide\n\n\n keep   this\n\n© x & y end fin"
    )


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"), ("<!-- x", ""), ("x <style>p{", "x"), ("</p></div>a", "a"), ("<td>a<td>b", "a\nb"), ("a < b &lt; c", "a < b < c"), ("<div>" * 5000 + "deep", "deep"), ('<a href="x>y">t</a>', "t")])
def test_html_edges(page, text):
    assert H.html_to_text(page) == text


def test_html_query(spark):
    df = spark.createDataFrame([(1, "<p>a", "q"), (1, "<p>a", "q"), (2, None, "q")], "page_id long, html string, text string")
    assert sorted(map(tuple, H.html_extraction(df).collect())) == [(1, "a"), (1, "a"), (2, "")]


def edit_distance(p, t):
    row = list(range(len(p) + 1))
    best = len(p)
    for c in t:
        new = [0]
        for i, a in enumerate(p):
            new.append(min(row[i] + (a != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "in", "zeta"]) + rng.choice("abcdefgh")
    items = [[word() for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 33, 47)]
    texts = []
    for _ in range(120):
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, 1 + len(item) // 4)):
            k = rng.randrange(len(item))
            kind = rng.random()
            item[k : k + 1] = [] if kind < 0.3 else [word()] if kind < 0.7 else [item[k], word()]
            item = item or [word()]
        texts.append(", ".join([word() for _ in range(rng.randint(0, 9))]) + "\n" + " ".join(item).upper() + ". " + " ".join(word() for _ in range(rng.randint(0, 9))))
    texts += [None, "", "!!!"]
    bench = spark.createDataFrame([(i, " ".join(x), "z") for i, x in enumerate(items)] + [(98, None, "z"), (99, "", "z")], "item_id long, text string, doc_id string")
    norm = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            k = edit_distance(norm(" ".join(x)), norm(t))
            if k <= len(x) // 5:
                want[d, i] = k
    rows = D.decontamination(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in rows} == want and len(rows) == len(want)
    assert all(0 <= r.first_word < r.end_word <= len(norm(texts[r.doc_id])) for r in rows)
    kept = D.drop_contaminated(docs(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} and kept.columns == docs(spark, []).columns
    assert D.decontamination(docs(spark, texts), bench.limit(0)).count() == 0
    assert D.decontamination(docs(spark, []), bench).count() == 0


def test_decontamination_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 64)
    bench = spark.createDataFrame([(i, f"item {i} has these very words") for i in range(9)], "item_id long, text string")
    texts = [f"so item {i} has these very words indeed" for i in range(9)] + ["none"]
    assert {(r.doc_id, r.item_id) for r in D.decontamination(docs(spark, texts), bench).collect() if r.distance == 0} == {(i, i) for i in range(9)}
    assert {r.doc_id for r in D.drop_contaminated(docs(spark, texts), bench).collect()} == {9}
