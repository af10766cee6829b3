"""Malformed attributes, and shown text of drawings, formulas and lists."""

import time

import pytest

from docloom.llm import html_text as H


@pytest.mark.parametrize(
    "page,lines",
    [
        ('<p class="x"">Visible one.</p><p>Visible two.</p>', ["Visible one.", "Visible two."]),
        ("<p title=it's>Visible one.</p><p>Visible two.</p>", ["Visible one.", "Visible two."]),
        ('<a href=a="b>one</a> two', ["one two"]),
        ('<p ="x>one', ["one"]),
        ("<p ' \" x>one</p ' >two", ["one", "two"]),
        ('<a title = "x>y" b=\'>\' c>one</a>', ["one"]),
        ('<a href=x/y/>one</a><br/>two', ["one", "two"]),
        ("<a title=>one</a>", ["one"]),
        ('<div hidden"">one</div><div a="b"hidden>no</div>', ["one"]),
        ("<!-->one<!--->two<!-- x --!>three", ["onetwothree"]),
        ('a <svg><title>t</title><desc>d</desc><defs><text>no</text></defs> x <path d="M0"/><text x=1>Axis</text><text>Unit <tspan>cm</tspan></text></svg> b', ["a Axis Unit cm b"]),
        ("<svg><text/></svg>one", ["one"]),
        ("<svg><foreignObject><p>in</p></foreignObject></svg><p>out", ["in", "out"]),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>", ["x=2"]),
        ("go <select><option>one<option selected>two<optgroup label=G><option>three</optgroup></select> end", ["go", "one", "two", "G", "three", "end"]),
        ("<input type=email value=a@b><input type=checkbox value=no><input type=number value=3>", ["a@b 3"]),
    ],
)
def test_visible(page, lines):
    assert [x for x in H.html_to_text(page).split("\n") if x] == lines


def test_stray_quotes_cost():
    began = time.time()
    assert H.html_to_text("<p a='\"" * 20000).strip() == "" and H.html_to_text('<p a"b=' * 20000 + ">x").strip() == "x"
    assert time.time() - began < 10
