"""The whole way from pages to mapped observations (ORC-01..06, SRC-16, MAP-01): one plan, split and reunited by route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import validate as V
from . import layout, mapping, parse, quality, terminology


def digital_rows(lines: DataFrame) -> DataFrame:
    """ORC-02: rows in reading order of the pages that have a text layer; scanned pages give none."""
    digital = layout.classify_pages(lines).where("path = 'digital'").select(*layout.PAGE)
    return layout.reading_order(lines.join(digital, list(layout.PAGE), "left_semi"))


def extract(texts: DataFrame | None = None, lines: DataFrame | None = None, ocr: DataFrame | None = None) -> DataFrame:
    """ORC-01, ORC-04: tests of text pages (doc_id, page, text), positioned lines and recognised lines, confidence capped.

    ``ocr`` has lines like ``layout.ocr_lines`` with their confidence; a test is no surer than its page was read.
    """
    parts = []
    if texts is not None:
        parts.append(layout.text_layout(texts).withColumn("read", F.lit(1.0)))
    if lines is not None:
        parts.append(digital_rows(lines).withColumn("read", F.lit(1.0)))
    if ocr is not None:
        sure = ocr.groupBy(*layout.PAGE).agg(F.round(F.avg("confidence"), 2).alias("read"))
        parts.append(layout.reading_order(ocr.drop("confidence")).join(sure, list(layout.PAGE)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    how = rows.groupBy(*layout.PAGE).agg(F.max("source").alias("source"), F.max("read").alias("read"))
    tests = parse.parse_pages(rows).join(how, list(layout.PAGE))
    return tests.withColumn("confidence", quality.fallback_confidence(F.least("confidence", "read"))).drop("read")


def observations(tests: DataFrame, catalog: DataFrame, learned: DataFrame | None = None, verifier: Callable | None = None, mode: str = "off") -> DataFrame:
    """FN-19, FLT-14, SRC-16, MAP-01: validated, cleaned of junk and mapped rows, ready for the sink."""
    from ..functions.text import standardize_unit

    rows = tests.select(
        F.xxhash64("doc_id", "page", "reading_order", "test_idx").alias("row_id"), F.col("doc_id").alias("document_id"), F.col("page").alias("page_number"),
        F.col("name").alias("original_test_name"), "value", "unit", "reference_range", "flag", "specimen", F.lit(None).cast("string").alias("method"),
        F.col("confidence").alias("extraction_confidence"), (F.col("source") == "ocr").alias("ocr"),
    )
    checked = V.validate_rows(V.correct_labels(rows, terminology.short_names(catalog))).where(~F.col("dropped"))
    name = F.when(F.col("ocr") & F.col("corrected_label").isNotNull(), F.col("corrected_label")).otherwise(F.col("original_test_name"))
    kept = checked.select(
        F.col("row_id").alias("observation_id"), "document_id", "page_number", name.alias("original_test_name"), "value", standardize_unit(F.col("unit")).alias("unit"), "reference_range",
        "specimen", "method", "flag", F.col("notes").alias("validation_notes"), "suggested_value", F.col("confidence").alias("extraction_confidence"), F.lit("fallback").alias("extraction_source"),
    )
    index = terminology.with_overrides(terminology.alias_index(catalog), terminology.overrides_table(catalog.sparkSession, C.ALIAS_OVERRIDES), catalog)
    return mapping.map_rows(kept, index, catalog, learned, verifier, mode)
