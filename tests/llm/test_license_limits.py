"""Units whose Dice coefficient is exactly the limit."""

from docloom.llm import license_scan as S


def test_size_bounds_keep_the_limit():
    for n in range(1, 400):
        low, high = S.size_bounds(n, S.LIMIT)
        for a in range(1, 700):
            assert (low <= a <= high) == (20 * min(a, n) >= 8 * (a + n)), (a, n)


def test_at_the_limit(spark):
    texts = {1: "This text is licensed under CC BY-NC 4.0.", 2: "This very text is licensed under CC BY-NC 4.0.", 3: "one two three four five six seven"}
    rows = {r.doc_id: (r.license, r.dice, r.n_units) for r in S.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert rows == {1: ("CC-BY-NC-4.0", 0.8, 1), 2: (None, None, 0), 3: (None, None, 0)}
    long = " ".join(f"w{i}" for i in range(10))
    short = spark.createDataFrame([(1, " ".join(long.split()[:7]))], "doc_id long, text string")
    assert [(r.license, r.dice) for r in S.license_scan(short, {"X": long}).collect()] == [("X", 0.8)]
