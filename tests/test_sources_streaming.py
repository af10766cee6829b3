"""File parsers, and the stream as the batch's twin."""

import io
import zipfile

from pyspark.sql import functions as F

from docloom.operators.jobs import latest
from docloom.sources import ingest as I
from docloom.streaming.jobs import latest_stream

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx() -> bytes:
    body = "<w:p><w:r><w:t>Intro</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Bar</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>kg</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_parse_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.TXT").write_text("one\ftwo")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.docx").write_bytes(b"broken")
    rows = I.parse_files(I.read_files(spark, str(tmp_path))).collect()
    got = {(r.doc_id.rsplit("/", 1)[1], r.page): (r.text, r.error is not None) for r in rows}
    assert got == {("a.docx", 1): ("Intro\nBar | kg", False), ("b.TXT", 1): ("one", False), ("b.TXT", 2): ("two", False), ("c.pdf", 0): ("", True), ("d.docx", 0): ("", True)}
    seen = I.parse_files(I.read_files(spark, str(tmp_path / "b.TXT")), ocr=lambda data, page: f"ocr {page}").collect()
    assert sorted((r.text, r.is_ocr) for r in seen) == [("ocr 1", True), ("ocr 2", True)]


def test_faults(spark):
    df = spark.createDataFrame([("a.PDF", 5), ("b.exe", 5), ("c.png", 60 << 20), ("d.pdf", None)], "p string, n long")
    assert [r[0] for r in df.select(I.fault(F.col("p"), F.col("n"))).collect()] == [None, "unsupported", "too large", "missing"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:00", "queued", 0), (2, 7, "2024-01-01 00:05:00", "done", 100), (3, 7, "2024-01-01 00:04:00", "running", 50), (4, 8, "2024-01-01 00:01:00", "queued", 0)]
    df = spark.createDataFrame(rows, "event_id long, job_id long, ts string, status string, progress int").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = latest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("jobs_now").start()
    try:
        q.processAllAvailable()
        got = {r.job_id: (r.s.status, r.s.progress) for r in spark.table("jobs_now").collect()}
    finally:
        q.stop()
    assert got == {r.job_id: (r.status, r.progress) for r in latest(df).collect()} == {7: ("done", 100), 8: ("queued", 0)}
