"""Pages against a plain reader made of Python's own tokenizer, tables against their cells, hostile pages."""

import random
import time
from html import escape
from html.parser import HTMLParser

import pytest

from docloom.llm import html_text as H


class Reader(HTMLParser):
    """Words outside hidden elements, which the pages below always close."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attributes):
        a = dict(attributes)
        if self.hidden and tag == self.hidden[0]:
            self.hidden.append(tag)
        elif not self.hidden and (tag in ("script", "style", "template") or "hidden" in a or "none" in a.get("style", "")):
            self.hidden = [tag]

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[0]:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def page(rng):
    count = iter(range(10**6))
    word = lambda: rng.choice(["w", "é", "日", "&amp;", "&lt;x&gt;", "&#233;", "&nbsp;y"]) + str(next(count))
    text = lambda: " ".join(word() for _ in range(rng.randint(1, 4)))

    def inline(deep):
        kind = rng.randrange(7)
        if deep > 3 or kind < 2:
            return text()
        return {
            2: f"<b>{inline(deep + 1)}</b>", 3: f"<span hidden>{text()}</span> {text()}", 4: f"{text()}<br>{text()}",
            5: f"<script>var a = '<p>{text()}';</script>", 6: f"<a href='x>{next(count)}' title=\"{escape(text())}\">{inline(deep + 1)}</a>",
        }[kind]

    def block(deep):
        kind = rng.randrange(9)
        if deep > 3 or kind < 2:
            return f"<p>{inline(0)}" + rng.choice(["", "</p>"])
        some = lambda f: "".join(f() for _ in range(rng.randint(1, 3)))
        return {
            2: lambda: f"<div>{some(lambda: block(deep + 1))}</div>",
            3: lambda: f"<div style='display: none'>{inline(3)}<div>{text()}</div></div>",
            4: lambda: f"<ul>{some(lambda: '<li>' + inline(0) + rng.choice(['', block(deep + 1), '</li>']))}</ul>",
            5: lambda: f"<ol start={rng.randint(-3, 30)}>{some(lambda: '<li>' + text())}</ol>",
            6: lambda: f"<table>{some(lambda: '<tr>' + some(lambda: rng.choice(['<td>', '<th>', '<td colspan=2>', '<td rowspan=2>']) + text()))}</table>",
            7: lambda: f"<h2>{inline(0)}</h2><!-- {text()} --><blockquote>{block(deep + 1)}</blockquote>",
            8: lambda: f"<pre>{text()}\n  {text()}</pre><hr>{text()}",
        }[kind]()

    return "".join(block(0) for _ in range(rng.randint(1, 6)))


@pytest.mark.parametrize("seed", range(60))
def test_words_and_their_order(seed):
    source = page(random.Random(seed))
    reader = Reader()
    reader.feed(source)
    reader.close()
    got = [w for line in H.html_to_text(source).split("\n") for w in line.split() if any(c.isdigit() for c in w) and not w.rstrip(".").lstrip("-").isdigit()]
    assert got == reader.words


@pytest.mark.parametrize("seed", range(10))
def test_cells_are_aligned(seed):
    rng = random.Random(seed)
    rows = [["x" * rng.randint(1, 9) for _ in range(4)] for _ in range(rng.randint(2, 6))]
    lines = H.html_to_text("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>").split("\n")
    assert [[c.strip() for c in x.split(" | ")] for x in lines] == rows
    assert len({tuple(i for i, c in enumerate(x) if c == "|") for x in lines}) == 1


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><tr><td>a<td>b<td>c<tr><td colspan=2>wide one<td>d</table>", "a | b    | c\nwide one | d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td>a<td><td>c<tr><td>d<td>e</table>", "a |   | c\nd | e"),
        ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb"),
        ("<table><tr><td>a<table><tr><td>in</table><td>c</table>", "a  | c\nin"),
        ("x<td>a<td>b<tr><td>c</td>d", "x\na\nb\nc\nd"),
        ("<ol start=-1><li>a<li>b<li value=9>c</ol>", "-1. a\n0. b\n9. c"),
        ("<table></table><table><tr></table>x", "x"),
    ],
)
def test_layout(page, text):
    assert H.html_to_text(page) == text


def test_hostile_pages():
    began = time.time()
    many = "9" * 5000
    assert H.html_to_text(f"<ol start={many}><li>a</ol>").endswith(". a")
    assert H.html_to_text(f"<table><tr><td colspan={many} rowspan={many}>a<td colspan=-{many}>b</table>") == "a | b"
    assert H.html_to_text("<div>" * 30000 + "x" + "</span>" * 30000 + "</div>" * 30000) == "x"
    assert H.html_to_text("<p><object>" + "<div>" * 30000 + "</object></p>") == ""
    assert H.html_to_text("<table><tr>" + "<td colspan=1000 rowspan=9>x" * 3000 + "<tr>" + "<td>y" * 3000 + "</table>").count("y") == 3000
    wide = H.html_to_text("<table><tr><td>" + "long " * 20000 + "<td>a" + "<tr><td>b<td>c" * 2000 + "</table>")
    assert len(wide) < 1_000_000 and wide.endswith("| c")
    assert time.time() - began < 30


def test_table_of_pages(spark):
    schema = "page_id string, html string, text string"
    assert H.html_extraction(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", "<p>x", "q"), ("a", "<p>x", "q"), (None, "", "q"), ("b", None, None)]
    assert sorted(map(tuple, H.html_extraction(spark.createDataFrame(rows, schema)).collect()), key=str) == [("a", "x"), ("a", "x"), ("b", ""), (None, "")]
