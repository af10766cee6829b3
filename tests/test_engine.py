"""The whole way over files, and the stores."""

import json

from docloom import engine
from docloom.operators import retrieval as R
from docloom.sources import store

TENDER = """Notice for supply of pumps
1 Scope of Work
The contractor shall supply and install the pumps.

2 Technical Specifications
Pump capacity: 40 litres a minute
Motor voltage: 415 V three phase
"""


def test_analyse_and_ask(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TENDER)
    (tmp_path / "b.txt").write_text("nothing to see here")
    (tmp_path / "c.xyz").write_text("x")
    pages, faults = engine.read_pages(spark, str(tmp_path))
    assert [r.fault for r in faults.collect()] == ["unsupported"]
    specs, scope, summary = engine.analyse(pages)
    rows = specs.collect()
    assert {(r.component, r.specs["specification"], r.confidence) for r in rows} == {("Pump capacity", "40 litres a minute", 1.0), ("Motor voltage", "415 V three phase", 1.0)}
    assert {r.doc.rsplit("/", 1)[1]: (r.specs, r.deliverables, r.accuracy) for r in summary.collect()} == {"a.txt": (2, 1, 100.0), "b.txt": (0, 0, 0.0)}
    assert {r.doc.rsplit("/", 1)[1]: (r.summary, r.deliverables) for r in scope.collect()} == {
        "a.txt": ("The contractor shall supply and install the pumps.", ["The contractor shall supply and install the pumps."]),
        "b.txt": ("NOT_FOUND", []),
    }

    invent = lambda prompts: [json.dumps({"technical_specifications": [{"component": "Flux", "specs": {}, "source": {"exact_text": "zqxj zqxj zqxj zqxj zqxj"}}]}) for _ in prompts]

    doc = next(r.doc_id for r in pages.collect() if r.doc_id.endswith("a.txt"))
    q = spark.createDataFrame([(doc, "motor voltage"), ("missing", "what")], "doc string, question string")
    stages = []
    again = engine.analyse(pages, invent, scope_extractor=lambda ps: [json.dumps({"scope_of_work": {"summary": "s", "deliverables": ["zqxj zqxj zqxj zqxj", " "]}}) for _ in ps], progress=lambda n, s: stages.append(n))
    assert again.specs.count() == 0 and all(r.deliverables == [] for r in again.scope.collect()) and stages == sorted(stages)
    assert {r.deliverables_rejected for r in again.summary.collect()} == {1}

    answers = {r.question: (r.answer, r.confidence) for r in engine.ask(pages, q, lambda ps: ['{"answer": "415 V", "confidence": "HIGH"}' if "415 V" in p else "?" for p in ps]).collect()}
    assert answers == {"motor voltage": ("415 V", "HIGH"), "what": ("NOT_FOUND", "LOW")}


def test_stores(spark, tmp_path):
    path = str(tmp_path / "v")
    parents = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    children = R.child_spans(parents)
    assert store.load(spark, path) is None and store.missing(parents, None).count() == 2
    store.save_vectors(children.filter("doc_id = 1"), lambda texts: [[float(len(t))] for t in texts], path)
    kept = store.load(spark, path)
    assert [r.doc_id for r in store.missing(parents, kept).collect()] == [2]
    assert [(r.doc_id, r.vector) for r in store.with_vectors(children, kept).collect()] == [(1, [3.0])]
    assert store.load_profile(spark, str(tmp_path / "none.json"), "a string").count() == 0


def docx(path, paragraphs, rows):
    """A small file with paragraphs and one table."""
    import zipfile

    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    body = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(map(p, paragraphs))}{table}</w:body></w:document>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)


def test_tables_of_files(spark, tmp_path):
    rows = [["Sl", "Item Name", "Specification Details", "Material Grade"], ["1", "Bearing housing", "Cast iron body rated for 40 bar and 200 degrees", "FG 260"], ["", "", "", ""]]
    docx(tmp_path / "t.docx", ["Supply of bearings", "The bidder shall deliver the housings."], rows)
    pages, faults = engine.read_pages(spark, str(tmp_path))
    assert faults.count() == 0 and pages.first().tables == [rows]
    specs, scope, summary = engine.analyse(pages)
    table = [r for r in specs.collect() if r.src == 0]
    assert [(r.component, r.specs["specification"], r.specs["material"], r.confidence) for r in table] == [("Bearing housing", "Cast iron body rated for 40 bar and 200 degrees", "FG 260", 1.0)]
    assert [r.chunk_type for r in engine.chunk_pages(pages).filter("section = 'Table'").collect()] == ["table"]


def test_documents_are_searched_alone(spark):
    """Terms are rare or common within a document, whatever other documents hold; vectors count too."""
    pages = spark.createDataFrame([(d, p, t) for d in ("a", "b") for p, t in ((1, "pump pump motor"), (2, "valve"), (3, f"motor {d}"))], "doc_id string, page int, text string")
    chunks = engine.chunk_pages(pages)
    queries = spark.createDataFrame([("q1", "a", "valve"), ("q2", "b", "motor b")], "query_id string, doc string, query string")
    best = {r.query_id: (r.doc, r.text) for r in engine._search(chunks, queries, 1, engine.DEFAULT).collect()}
    assert best == {"q1": ("a", "valve"), "q2": ("b", "motor b")}
    alone = engine._search(chunks.filter("doc_id = 'b'"), queries.filter("doc = 'b'"), 3, engine.DEFAULT).select("text", "score").collect()
    both = engine._search(chunks, queries, 3, engine.DEFAULT).filter("doc = 'b'").select("text", "score").collect()
    assert sorted(alone) == sorted(both)
    embed = lambda texts: [[1.0, 0.0] if "pump" in t or "Represent" in t else [0.0, 1.0] for t in texts]
    assert {r.text for r in engine._search(chunks, queries, 1, engine.DEFAULT, embed).collect()} == {"pump pump motor"}


def test_session_and_stored_chunks(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "Pump capacity: 40 litres"), ("b", 1, "Nothing")], "doc_id string, page int, text string")
    path = str(tmp_path / "chunks")
    first = engine.stored_chunks(pages.filter("doc_id = 'a'"), path)
    assert first.count() == 1 and engine.stored_chunks(pages, path).count() == 2 and engine.stored_chunks(pages, path, again=True).count() == 2
    session = engine.Session(pages, lambda ps: ['{"answer": "40", "confidence": "HIGH"}'] * len(ps), path)
    r = session.ask(spark.createDataFrame([("a", "  pump capacity ")], "doc string, question string")).first()
    session.close()
    assert (r.question, r.answer, r.n_hits, [c.page for c in r.citations]) == ("pump capacity", "40", 1, [1])


def test_scanned_pages_and_profile(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "read by a machine", True), ("a", 2, "typed", False)], "doc_id string, page int, text string, is_ocr boolean")
    assert {r.page: r.chunk_type for r in engine.chunk_pages(pages).collect()} == {1: "image_ocr", 2: "paragraph"}
    path = str(tmp_path / "p")
    for name in ("one", "two"):
        store.save_profile(spark.createDataFrame([(name,)], "company_name string"), path)
    assert [r.company_name for r in store.load_profile(spark, path, "company_name string").collect()] == ["two"]


def test_command_line(tmp_path, monkeypatch, spark, capsys):
    from docloom import __main__ as command, session

    monkeypatch.setattr(session, "local_session", lambda *a: spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TENDER)
    out = tmp_path / "out"
    assert command.main([str(tmp_path / "none")]) == 1
    assert command.main([str(tmp_path / "in"), "-o", str(out), "-v", "--store", str(tmp_path / "store"), "--reindex"]) == 0
    assert "90 % validation" in capsys.readouterr().err
    assert spark.read.json(str(out / "specs")).count() == 2 and spark.read.json(str(out / "scope")).count() == 1
