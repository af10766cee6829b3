"""Table rules against fixed expectations."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import tables as T

HEADS = [
    (["S. No.", "Equipment", "Specified Details", "UOM", "Qty"], {"item_name": 0, "specification_text": 2, "unit": 3, "numeric_value": 4}),
    (["Index", "Particulars", "Amount", "Volume"], {"item_name": 1, "numeric_value": 2}),
    (["Component", "Param", "Permitted variation", "ASTM", "Class"], {"item_name": 0, "specification_text": 1, "tolerance": 2, "standard_reference": 3, "material": 4}),
    ([], {}),
    (["x", ""], {}),
]


@pytest.mark.parametrize("headers,expected", HEADS)
def test_map_columns(spark, headers, expected):
    df = spark.createDataFrame([(headers,)], "h array<string>")
    assert df.select(T.map_columns(F.col("h")).alias("m")).first().m == expected


def test_clean_cells(spark):
    df = spark.createDataFrame([(["Pump", None, " 40  bar"],), (["two\nlines\n\nhere", "\t", "x "],)], "c array<string>")
    assert [r[0] for r in df.select(T.clean_cells(F.col("c"))).collect()] == [["Pump", "", "40 bar"], ["two lines here", "", "x"]]


@pytest.mark.parametrize(
    "item,spec,expected",
    [
        ("(1)", "Voltage: 415 V", ("Voltage", "415 V")),
        ("1.", "Motor rating. More", ("Motor rating", "Motor rating. More")),
        ("2", ": 5 units of cable", ("2", ": 5 units of cable")),
        ("Pump", "", ("Pump", "NOT_FOUND")),
        ("", "S teel bar", ("NOT_FOUND", "Steel bar")),
    ],
)
def test_derive(spark, item, spec, expected):
    df = spark.createDataFrame([(item, spec)], "i string, s string")
    assert tuple(df.select(T.derive(F.col("i"), F.col("s")).alias("d")).first().d) == expected


def test_table_specs_gates(spark):
    head = ["Item Description", "Specification Details"]
    rows = [
        ("d", 20, "t", 1, head, ["Pump", "delivers 40 litres a minute"]),
        ("d", 20, "t", 2, head, ["Pump", "short"]),
        ("d", 16, "u", 1, head, ["Pumps", "delivers 40 litres a minute"]),
        ("d", 16, "u", 2, head, ["123", "delivers 40 litres a minute"]),
        ("d", 3, "v", 1, ["Name", "Remarks"], ["Pumps", "delivers 40 litres a minute"]),
        ("d", 20, "t", 3, head, ["", "alone in its row"]),
    ]
    df = spark.createDataFrame(rows, "doc_id string, page int, table_id string, row_no int, headers array<string>, cells array<string>")
    got = {(r.table_id, r.row_no, r.item_name, r.chunk_id) for r in T.table_specs(df).collect()}
    assert got == {("t", 1, "Pump", "t_row_1"), ("u", 1, "Pumps", "u_row_1")}


def test_text_functions(spark):
    df = spark.createDataFrame([("specification tolerance material",), ("plain",)], "q string")
    assert [r[0] for r in df.select(X.expand_query(F.col("q"))).collect()] == ["specification tolerance material specs standard grade alloy", "plain"]
    s = spark.createDataFrame([("IS 1. A? b",), ("",)], "t string")
    assert s.select(X.sentences(F.col("t"))).first()[0] == ["IS 1.", "A?", "b"]
    assert [r[0] for r in s.select(X.token_count(F.col("t"))).collect()] == [2, 1]
