"""What people do to rows (MUT-01..06): edits with new checks and mappings, reviews that are remembered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.validate import validate_rows
from . import mapping, store

#: Columns that a row must have to be edited, besides the editable ones.
STATE = ("document_id", "page_number", "is_edited", "extraction_source", "extraction_confidence", "validation_notes", "suggested_value", *mapping.RESULT)


def apply_edits(base: DataFrame, events: DataFrame, documents: DataFrame, index: DataFrame, catalog: DataFrame) -> DataFrame:
    """MUT-01..03, MUT-06: rows after the events (seq, observation_id, action, patch).

    A created row (document_id and page_number are in its patch) of a document that does not exist is refused; others are
    fully trusted and mapped by name. An updated row is checked anew: if nothing looks off it is fully trusted, else it has
    the new notes and their lower confidence. A row whose name was changed is mapped anew, by name; other updates keep
    the mapping. Only touched rows are checked, only renamed and created ones searched.
    """
    fields = (*store.EDITABLE, "document_id", "page_number")
    text = base.withColumns({c: F.col(c).cast("string") for c in ("document_id", "page_number")})
    events = store.accepted_events(events)
    # events of one row in their order: did one of them change the name that stood before it?
    named = events.where(F.map_contains_key("patch", F.lit("original_test_name")) & (F.col("action") == "update"))
    renames = named.groupBy("observation_id").agg(F.collect_set(F.try_element_at("patch", F.lit("original_test_name"))).alias("_names"))
    touched = events.groupBy("observation_id").agg(F.bool_or(F.col("action") == "create").alias("_created"))
    before = base.select("observation_id", F.col("original_test_name").alias("_before"))
    rows = store.current_rows(text, events, fields).withColumns({c: F.col(c).cast(base.schema[c].dataType) for c in ("document_id", "page_number")})
    rows = rows.join(touched, "observation_id", "left").join(before, "observation_id", "left").join(renames, "observation_id", "left")
    rows = rows.join(documents.select("document_id", F.lit(True).alias("_known")), "document_id", "left")
    rows = rows.where(~F.coalesce("_created", F.lit(False)) | F.col("_known")).drop("_known")
    other = F.exists(F.coalesce("_names", F.array().cast("array<string>")), lambda n: ~n.eqNullSafe(F.col("_before")))
    rows = rows.withColumn("_renamed", F.coalesce("_created", F.lit(False)) | other).drop("_names", "_before")

    untouched = rows.where(F.col("_created").isNull()).select(*base.columns)
    fresh = rows.where("_created").withColumns({"extraction_confidence": F.lit(1.0), "validation_notes": F.lit(None).cast(base.schema["validation_notes"].dataType), "suggested_value": F.lit(None).cast("string")})
    changed = rows.where("NOT _created").withColumns({"extraction_confidence": F.lit(C.FALLBACK_CONFIDENCE), "ocr": F.lit(False)}).drop("suggested_value")
    checked = validate_rows(changed)
    sure = F.size("notes") == 0
    checked = checked.withColumns({"validation_notes": F.when(~sure, F.col("notes")), "extraction_confidence": F.when(sure, 1.0).otherwise(F.col("confidence"))})
    both = checked.select(*base.columns, "_renamed").unionByName(fresh.select(*base.columns, "_renamed"))
    kept = both.where("NOT _renamed").select(*base.columns)
    mapped = mapping.map_single(both.where("_renamed").select(*base.columns), index, catalog).select(*base.columns)
    return untouched.unionByName(kept).unionByName(mapped)


def apply_reviews(observations: DataFrame, decisions: DataFrame, catalog: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MUT-04, MUT-05: (rows, remembered picks) after the reviews: a person's choice of a code is kept for name, specimen and unit."""
    chosen = store.accepted_reviews(decisions, catalog).where("_code IS NOT NULL")
    picks = observations.join(chosen, "observation_id").select(
        F.col("observation_id").alias("pos"), F.col("original_test_name").alias("name"), "specimen", "unit", F.col("_code").alias("loinc_num")
    )
    return store.review(observations, decisions, catalog), mapping.remember(learned, picks, "review", 1.0)
