"""Chunking against plain restatements of the rules."""

import random
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docloom.operators import chunking as C


def test_sections(spark):
    text = "1 Introduction\nfirst words\n\n2 Technical Specifications\n2.1 Material Requirements\n- a\n• b\n* c"
    pages = spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")
    rows = [(r.section, r.parent_section, r.chunk_type, r.n_lines) for r in C.paragraphs(C.lines(pages)).orderBy("para").collect()]
    assert rows == [
        ("1 Introduction", "1 Introduction", "paragraph", 2),
        ("2 Technical Specifications", "2 Technical Specifications", "paragraph", 1),
        ("2.1 Material Requirements", "2 Technical Specifications", "list", 4),
    ]


def test_hints_reset_by_page(spark):
    pages = spark.createDataFrame([("d", 1, "Overview\ntext"), ("d", 2, "more"), ("d", 3, "")], "doc_id string, page int, text string")
    got = C.paragraphs(C.lines(pages), F.array(F.lit("Overview"))).orderBy("page").collect()
    assert [(r.page, r.section, r.text) for r in got] == [(1, "Overview", "Overview\ntext"), (2, "Unknown", "more")]


def packed(text, most, overlap):
    count = lambda s: max(1, len(s) // 4)
    if count(text) <= most:
        return [text]
    out, cur = [], []
    for s in re.split(r"(?<=[.!?])\s+", text):
        if cur and sum(map(count, cur)) + count(s) > most:
            out.append(" ".join(cur))
            tail = []
            for x in reversed(cur):
                if tail and sum(map(count, tail)) + count(x) > overlap:
                    break
                tail.insert(0, x)
            cur = tail
        cur = cur + [s]
    return out + [" ".join(cur)] if cur else out


def test_pack_random(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "longer words ", ". ", "? ", "\n", "x"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", C.pack(F.col("t"), 40, 10).alias("p")).collect()}
    assert got == {i: packed(t, 40, 10) for i, t in enumerate(texts)}


def test_table_chunks(spark):
    rows = [("d", 1, "table_001", 1, ["Item", "Unit"], ["Bar", "kg"]), ("d", 1, "table_001", 2, ["Item", "Unit"], ["", " "])]
    df = spark.createDataFrame(rows, "doc_id string, page int, table_id string, row_no int, headers array<string>, cells array<string>")
    (r,) = C.table_chunks(df).collect()
    assert (r.chunk_id, r.text, r.section) == ("table_001_row_1", "[Table Headers]: Item | Unit\n[Row 1]: Bar | kg", "Table")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab1. \n-", max_size=80))
def test_paragraphs_keep_lines(spark, text):
    pages = spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")
    got = [x for r in C.paragraphs(C.lines(pages)).orderBy("para").collect() for x in r.text.split("\n")]
    assert got == [x.strip() for x in text.split("\n") if x.strip()]
