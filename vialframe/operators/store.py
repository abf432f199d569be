"""Read API and change log over observations (FLT-03..07, SRT-01..03, JOIN-07/12, MUT-01..04, SRC-14/16).

Tables are immutable files: a change is an appended event, the current table a fold over the events of each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import clip, like_any, standardize_unit

EDITABLE = ("original_test_name", "value", "unit", "reference_range", "specimen", "method", "timing", "flag")


def list_observations(observations: DataFrame, document_id=None, mapping_status: str | None = None, q: str | None = None, limit: int = C.LIST_LIMIT) -> DataFrame:
    """FLT-03, SRT-01: filters, newest first, at most ``limit`` rows (top-k, no full sort)."""
    out = observations
    if document_id is not None:
        out = out.where(F.col("document_id") == document_id)
    if mapping_status is not None:
        out = out.where(F.col("mapping_status") == mapping_status)
    if q:
        out = out.where(like_any(q, F.col("original_test_name"), F.col("normalized_test_name"), F.col("loinc_code")))
    return out.orderBy(F.desc_nulls_last("created_at"), "observation_id").limit(min(limit, C.LIST_LIMIT_MAX))


def search_terminology(catalog: DataFrame, q: str, limit: int = C.SEARCH_LIMIT) -> DataFrame:
    """FLT-04: codes whose names, component or number contain the text, in order of number."""
    hit = like_any(q, F.col("long_common_name"), F.col("shortname"), F.col("component"), F.col("loinc_num"))
    return catalog.where(hit).orderBy("loinc_num").limit(min(limit, C.SEARCH_LIMIT_MAX))


def list_reports(documents: DataFrame) -> DataFrame:
    """FLT-05, SRT-02: all columns but the file itself, newest first; the blob column is never read."""
    return documents.select(*[c for c in documents.columns if c != "raw_content"]).orderBy(F.desc_nulls_last("uploaded_at"), "document_id")


def export_order(observations: DataFrame) -> DataFrame:
    """SRT-03: by page, then creation; rows without a page first."""
    return observations.orderBy(F.asc_nulls_first("page_number"), F.asc_nulls_first("created_at"), "observation_id")


def orphans(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """JOIN-12: rows of documents that do not exist."""
    return observations.join(documents.select("document_id"), "document_id", "left_anti")


def cascade_delete(observations: DataFrame, deleted: DataFrame) -> DataFrame:
    """JOIN-07, MUT-03: what is left when documents go."""
    return observations.join(deleted.select("document_id"), "document_id", "left_anti")


def clipped(observations: DataFrame) -> DataFrame:
    """SRC-16: the sink's projection: standard unit, long texts clipped to their columns."""
    out = observations.withColumn("unit", standardize_unit(F.col("unit"))) if "unit" in observations.columns else observations
    return out.withColumns({c: clip(F.col(c), n) for c, n in C.OBSERVATION_WIDTHS.items() if c in out.columns})


def change(action: str, seq: Column, row_id: Column, values: dict[str, Column] | None = None) -> list[Column]:
    """Columns of a change event: only the given fields count; a given null sets null."""
    fields = {k: v.cast("string") for k, v in (values or {}).items()}
    entries = [x for k, v in fields.items() for x in (F.lit(k), v)]
    patch = F.create_map(*entries) if entries else F.lit(None)
    return [seq.alias("seq"), row_id.alias("observation_id"), F.lit(action).alias("action"), patch.cast("map<string,string>").alias("patch")]


def find(rows: DataFrame, value, key: str = "observation_id") -> DataFrame:
    """FLT-07, JOIN-02: the row with this key, or none; the filter reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def file_of(documents: DataFrame, document_id) -> DataFrame:
    """SRC-17: the original file of a document with the headers it is served under; other documents' files are not read."""
    name = F.replace(F.url_encode("filename"), F.lit("+"), F.lit("%20"))
    return find(documents, document_id, "document_id").select(
        "content_type", F.concat(F.lit("inline; filename*=UTF-8''"), name).alias("content_disposition"), F.lit("private, max-age=3600").alias("cache_control"), F.col("raw_content").alias("content")
    )


def accepted_events(events: DataFrame) -> DataFrame:
    """MUT-02: without the updates that are refused: those that name no field, and those that clear the name."""
    fields, name = F.coalesce(F.map_keys("patch"), F.array().cast("array<string>")), "original_test_name"
    clears = F.array_contains(fields, name) & F.try_element_at("patch", F.lit(name)).isNull()
    return events.where((F.col("action") != "update") | ((F.size(fields) > 0) & ~clears))


def current_rows(base: DataFrame, events: DataFrame, fields: tuple[str, ...] = EDITABLE) -> DataFrame:
    """MUT-01..03: rows after the events (seq, observation_id, action create|update|delete, patch map).

    The last event that names a field decides it, a null value included; created rows are manual and edited, updated
    ones edited; a delete is final. Refused updates change nothing. One shuffle by row id.
    """
    events = accepted_events(events)
    last = [
        F.max(F.when(F.map_contains_key("patch", f), F.struct("seq", F.try_element_at("patch", F.lit(f)).alias("v")))).alias(f"_{f}") for f in fields
    ]
    folded = events.groupBy("observation_id").agg(
        F.bool_or(F.col("action") == "delete").alias("_deleted"), F.bool_or(F.col("action") == "create").alias("_created"), *last
    )
    rows = base.join(folded, "observation_id", "full").where(~F.coalesce("_deleted", F.lit(False)))
    value = lambda f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f))
    touched = F.col("_deleted").isNotNull()
    more = {f: value(f) for f in fields}
    more["is_edited"] = touched | F.coalesce("is_edited", F.lit(False))
    more["extraction_source"] = F.when(F.coalesce("_created", F.lit(False)), "manual").otherwise(F.col("extraction_source"))
    return rows.withColumns(more).select(*base.columns)


def accepted_reviews(decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """MUT-04: the last decision on each row (by seq, if there is one) that passes its checks, with the code's name.

    A null code needs the status unmapped; a code must exist in the catalog.
    """
    known = catalog.select(F.col("loinc_num").alias("_code"), F.col("long_common_name").alias("_name"))
    checked = decisions.join(known, F.col("loinc_num") == F.col("_code"), "left").where(
        (F.col("loinc_num").isNull() & (F.col("status") == "unmapped")) | F.col("_code").isNotNull()
    )
    order = F.struct(*[F.col(c) for c in ("seq", "status", "loinc_num") if c in decisions.columns])
    return checked.groupBy("observation_id").agg(F.max_by(F.struct(F.col("status").alias("_status"), "_code", "_name"), order).alias("_d")).select("observation_id", "_d.*")


def review(observations: DataFrame, decisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """MUT-04: apply reviews (observation_id, loinc_num, status and, where a row may have several, seq); what fails changes nothing."""
    chosen = accepted_reviews(decisions, catalog).withColumn("_reviewed", F.lit(True))
    rows, done = observations.join(chosen, "observation_id", "left"), F.coalesce("_reviewed", F.lit(False))
    put = lambda c, v: F.when(done, v).otherwise(F.col(c))
    why = F.when(F.col("_code").isNull(), "Manually reviewed; confirmed no reliable LOINC mapping exists.").otherwise("Manually reviewed and confirmed by user.")
    changed = {
        "loinc_code": put("loinc_code", F.col("_code")), "loinc_display": put("loinc_display", F.col("_name")),
        "mapping_status": put("mapping_status", F.col("_status")), "mapping_stage": put("mapping_stage", F.lit("human_review")),
        "mapping_confidence": put("mapping_confidence", F.lit(1.0)),
    }
    if "mapping_rationale" in observations.columns:
        changed["mapping_rationale"] = put("mapping_rationale", why)
    return rows.withColumns(changed).select(*observations.columns)


def needs_sync(source: DataFrame, stored: DataFrame) -> DataFrame:
    """SRC-14: one row: do the counts of codes and aliases differ, so that the stored table must be rewritten?"""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("codes"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases"))
    a, b = count(source), count(stored)
    return a.withColumns({"stored_codes": b.select("codes").scalar(), "stored_aliases": b.select("aliases").scalar()}).withColumn(
        "rewrite", (F.col("codes") != F.col("stored_codes")) | (F.col("aliases") != F.col("stored_aliases"))
    )


def latest_per_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """WIN-16: the newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
