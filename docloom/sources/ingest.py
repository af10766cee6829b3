"""Sources: routing and checks of files, page rules, parsers for text, HTML and DOCX files.

PDF, image and OCR parsers are providers: callables from bytes to pages, given by name to ``parse_files``.
None is built in, as no such library is at hand.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.config import DEFAULT, Config
from docloom.functions.text import strip
from docloom.session import ship

PAGES = "doc_id string, page int, text string, is_ocr boolean, headings array<string>, tables array<array<array<string>>>, error string"


def suffix(path: Column) -> Column:
    """The lower-cased last suffix with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def route(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == ".pdf", "pdf").when(s == ".docx", "docx").when(s.isin(".jpg", ".jpeg", ".png"), "image").otherwise("unsupported")


def fault(path: Column, length: Column, cfg: Config = DEFAULT) -> Column:
    """Why a file is not taken, or null."""
    return F.when(length.isNull(), "missing").when(~suffix(path).isin(*cfg.suffixes), "unsupported").when(length > cfg.max_bytes, "too large")


def needs_ocr(text: Column, cfg: Config = DEFAULT) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < cfg.scanned_chars


def is_heading(size: Column, flags: Column, text: Column, cfg: Config = DEFAULT) -> Column:
    """A span that is large or bold, and short."""
    return ((size > cfg.heading_size) | (flags.bitwiseAND(16) > 0)) & (F.length(text) < cfg.heading_length)


def html_headings(page: Column) -> Column:
    """The texts of h1 to h6, tags taken out."""
    found = F.regexp_extract_all(page, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.filter(F.transform(found, lambda h: strip(F.regexp_replace(h, "<[^>]*>", ""))), lambda h: h != "")


def joined_cells(cells: Column) -> Column:
    """A row's cells that are not blank, stripped, with pipes between."""
    return F.array_join(F.filter(F.transform(cells, strip), lambda c: c != ""), " | ")


def docx_pages(data: bytes) -> list[dict]:
    """Paragraphs, then table rows, of a DOCX file as one page, by the standard library; tables also as cells."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    lines = [t for p in body.findall(f"{w}p") if (t := text(p)).strip()]
    for row in body.iter(f"{w}tr"):
        cells = [c for cell in row.findall(f"{w}tc") if (c := "\n".join(text(p) for p in cell.iter(f"{w}p")).strip())]
        if cells:
            lines.append(" | ".join(cells))
    cell_text = lambda cell: "\n".join(text(p) for p in cell.iter(f"{w}p"))
    tables = [[[cell_text(c) for c in row.findall(f"{w}tc")] for row in t.findall(f"{w}tr")] for t in body.iter(f"{w}tbl")]
    return [{"page": 1, "text": "\n".join(lines), "headings": [], "tables": tables}]


def text_pages(data: bytes) -> list[dict]:
    """Pages of a text file, cut at form feeds."""
    return [{"page": i, "text": t, "headings": []} for i, t in enumerate(data.decode("utf-8", "replace").split("\f"), 1)]


PARSERS: dict[str, Callable[[bytes], list[dict]]] = {".docx": docx_pages, ".txt": text_pages}


def parse_files(files: DataFrame, parsers: dict[str, Callable[[bytes], list[dict]]] = PARSERS, ocr: Callable[[bytes, int], str] | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Pages of files (path, content) of format binaryFile. A file that fails gives one row with its
    error; pages with little text go through ``ocr``, if given, one page at a time."""
    ship(files.sparkSession)
    limit = cfg.scanned_chars

    def run(it):
        import pandas as pd

        for b in it:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                m = re.search(r"(\.[^./\\]+)$", path)
                try:
                    parse = parsers[m.group(1).lower() if m else ""]
                    for p in parse(bytes(content)):
                        scanned = len(p["text"].strip()) < limit and ocr is not None
                        rows.append((path, p["page"], ocr(bytes(content), p["page"]) if scanned else p["text"], scanned, p["headings"], p.get("tables") or [], None))
                except Exception as e:  # one bad file does not stop the others
                    rows.append((path, 0, "", False, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "is_ocr", "headings", "tables", "error"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)
