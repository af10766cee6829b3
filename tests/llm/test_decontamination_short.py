"""Short items, items in scripts without spaces, and edits in items of few words."""

from docloom.llm import decontamination as D


def test_short_and_unspaced(spark):
    items = ["Boiling point", "yes", "水的沸点是多少度", "沸点", "น้ำเดือดที่เท่าไร", "one two three four five"]
    texts = ["the boiling point, of", "boiling the point", "请问水的沸点是多少度？谢谢", "水的沸點是多少度", "ถามว่าน้ำเดือดที่เท่าไรครับ", "say one two thre four five now", "one two 3 4 five", "Yes!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)) + [(98, None), (99, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in D.decontamination(docs, bench).collect()}
    assert got == {(0, 0): 0, (2, 2): 0, (2, 3): 0, (3, 2): 1, (4, 4): 0, (5, 5): 1, (7, 1): 0}
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, bench).collect()) == [1, 6, 8]


def test_budget_is_the_rate():
    assert [D.budget(w) for w in (1, 4, 5, 7, 10, 11, 15, 20, 47)] == [0, 0, 1, 1, 2, 2, 3, 4, 9]
