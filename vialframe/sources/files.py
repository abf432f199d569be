"""File sources (SRC-01..07, SRC-20/21): bytes to page texts or spans. Optional decoders are imported where they are used."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..functions.text import page_source, resolve_content_type, strip

PAGES = "doc_id string, content_type string, page int, text string, image binary, problem string"


def read_files(spark: SparkSession, path: str, declared: str = "") -> DataFrame:
    """Files of a folder: doc_id (the path), content_type, content. The content column is pruned where it is not used."""
    raw = spark.read.format("binaryFile").load(path)
    kind = resolve_content_type(F.col("path"), F.lit(declared))
    return raw.select(F.col("path").alias("doc_id"), kind.alias("content_type"), "length", "content")


def docx_text(content: bytes) -> str:
    """SRC-05: paragraphs and table rows in order; cells joined by four spaces, white space collapsed, merged cells once."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")

    def said(node) -> str:
        out = []
        for x in node.iter():
            if x.tag == f"{w}t":
                out.append(x.text or "")
            elif x.tag in (f"{w}tab", f"{w}br"):
                out.append("\t" if x.tag.endswith("tab") else "\n")
        return "".join(out)

    lines: list[str] = []
    for block in body if body is not None else ():
        if block.tag == f"{w}p":
            lines.append(said(block))
        elif block.tag == f"{w}tbl":
            for row in block.iter(f"{w}tr"):
                cells = []
                for cell in row.findall(f"{w}tc"):
                    merge = cell.find(f"{w}tcPr/{w}vMerge")
                    if merge is not None and merge.get(f"{w}val") != "restart":
                        continue
                    cells.append(re.sub(r"\s+", " ", said(cell)).strip())
                lines.append("    ".join(cells))
    return "\n".join(lines)


def pdf_texts(content: bytes) -> list[str | None]:
    """SRC-02: stripped text layer of each page, None where it is empty. Needs PyMuPDF."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [page.get_text().strip() or None for page in doc]


def image_page(content: bytes) -> bytes:
    """SRC-04: the image, checked, as PNG. Needs Pillow."""
    import io

    from PIL import Image

    out = io.BytesIO()
    Image.open(io.BytesIO(content)).convert("RGB").save(out, "PNG")
    return out.getvalue()


def load_pages(files: DataFrame) -> DataFrame:
    """SRC-01: one row per page. Text that is UTF-8 stays in the JVM; other text, docx, pdf and image bytes are decoded
    in Arrow batches.

    A file that can't be read is one row with its problem, so that no file is lost silently.
    """
    import pandas as pd

    ship(files.sparkSession)
    routed = files.withColumn("source", page_source(F.col("content_type")))
    # bytes that are no UTF-8 are dropped, as a lenient reader does
    broken = (F.col("source") == "text") & F.col("content").isNotNull() & F.expr("try_validate_utf8(content)").isNull()
    none = lambda kind: F.lit(None).cast(kind)
    text = routed.where((F.col("source") == "text") & ~broken).select(
        F.col("doc_id").cast("string"), "content_type", F.lit(1).alias("page"), F.regexp_replace(F.expr("try_validate_utf8(content)"), "﻿", "").alias("text"), none("binary").alias("image"), none("string").alias("problem")
    )
    text = text.withColumn("text", F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, kind, source, content in zip(pdf["doc_id"], pdf["content_type"], pdf["source"], pdf["content"], strict=True):
                try:
                    if source == "text":
                        out.append((doc, kind, 1, content.decode("utf-8", "ignore").replace("\ufeff", ""), None, None))
                    elif source == "docx":
                        out.append((doc, kind, 1, docx_text(content), None, None))
                    elif source == "pdf":
                        out += [(doc, kind, i, t, None, None) for i, t in enumerate(pdf_texts(content), 1)]
                    elif source == "image":
                        out.append((doc, kind, 1, None, image_page(content), None))
                    else:
                        out.append((doc, kind, 0, None, None, f"unsupported content type {kind}"))
                except Exception as e:
                    out.append((doc, kind, 0, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["doc_id", "content_type", "page", "text", "image", "problem"])

    rest = routed.where((F.col("source") != "text") | broken).select(F.col("doc_id").cast("string"), "content_type", "source", "content").mapInPandas(run, PAGES)
    return text.unionByName(rest)


def extract_with(pages: DataFrame, extractor: Callable, schema: str) -> DataFrame:
    """SRC-20: an injected model extractor: a function over pandas batches of pages; off unless given."""
    return pages.mapInPandas(extractor, schema)


def model_input(text_col: str = "text", mode: str = "auto", minimum: int = 400):
    """FLT-02: what goes to a model: the text alone, or the image."""
    text = strip(F.coalesce(text_col, F.lit("")))
    use = (text != "") & (F.lit(mode == "text") | (F.lit(mode == "auto") & (F.length(text) >= minimum)))
    return F.when(use, "text").otherwise("image")


def route_pages(pages: DataFrame) -> DataFrame:
    """ORC-01, ORC-06: parse, layout, ocr or unavailable per page."""
    kind, has_text = F.col("content_type"), F.length(strip(F.coalesce("text", F.lit("")))) >= 20
    source = page_source(kind)
    route = F.when(source.isin("text", "docx"), "parse").when((source == "pdf") & has_text, "layout").when(source.isin("pdf", "image"), "ocr").otherwise("unavailable")
    return pages.withColumn("route", route)
