"""Per-document quality and dashboard aggregates (AGG-05..08, AGG-14..19, FLT-06/08/09, ORC-03/04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import strip


def status_counts(observations: DataFrame, by: str = "document_id") -> DataFrame:
    """AGG-05, AGG-08: counts per status and the share that needs review."""
    status = F.col("mapping_status")
    counts = observations.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_observations"),
        F.count_if(status == "confirmed").alias("confirmed_count"),
        F.count_if(status == "needs_review").alias("needs_review_count"),
        F.count_if(status == "unmapped").alias("unmapped_count"),
    )
    review = F.col("needs_review_count") + F.col("unmapped_count")
    return counts.withColumn("review_needed_ratio", F.round(review / F.nullif("total_observations", F.lit(0)), 3))


def duplicate_names(observations: DataFrame, by: str = "document_id") -> DataFrame:
    """AGG-06: names that occur more than once on a page of a document, sorted and distinct."""
    name = F.lower(strip(F.coalesce("original_test_name", F.lit(""))))
    per_page = observations.groupBy(by, "page_number", name.alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per_page.groupBy(by).agg(F.array_sort(F.collect_set("name")).alias("possible_duplicate_test_names"))


def is_low_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence < C.LOW_CONFIDENCE, F.lit(False))


def low_confidence(observations: DataFrame, by: str = "document_id") -> DataFrame:
    """AGG-07: the rows with a confidence under the limit, in order of id."""
    row = F.struct("observation_id", "original_test_name", "extraction_confidence")
    return observations.where(is_low_confidence(F.col("extraction_confidence"))).groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("low_confidence_extractions"))


def quality_summary(observations: DataFrame, by: str = "document_id") -> DataFrame:
    """FLT-06, AGG-05..08: the seven quality fields of each document, from one scan.

    Rows first meet by document, page and name, with their counts and doubtful rows, then by document alone.
    """
    status = F.col("mapping_status")
    name = F.lower(strip(F.coalesce("original_test_name", F.lit(""))))
    doubtful = F.struct("observation_id", "original_test_name", "extraction_confidence")
    each = observations.groupBy(by, "page_number", name.alias("_name")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(status == s).alias(f"_{s}") for s in ("confirmed", "needs_review", "unmapped")],
        F.collect_list(F.when(is_low_confidence(F.col("extraction_confidence")), doubtful)).alias("_low"),
    )
    out = each.groupBy(by).agg(
        F.sum("_n").alias("total_observations"), *[F.sum(f"_{s}").alias(f"{s}_count") for s in ("confirmed", "needs_review", "unmapped")],
        F.array_sort(F.collect_set(F.when(F.col("_n") > 1, F.col("_name")))).alias("possible_duplicate_test_names"),
        F.array_sort(F.flatten(F.collect_list("_low"))).alias("low_confidence_extractions"),
    )
    review = F.col("needs_review_count") + F.col("unmapped_count")
    return out.withColumn("review_needed_ratio", F.round(review / F.nullif("total_observations", F.lit(0)), 3))


def dashboard(documents: DataFrame) -> DataFrame:
    """AGG-16: totals of the document list."""
    s = F.col("status")
    return documents.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s.isin("pending", "processing")).alias("active"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "complete").alias("complete")
    )


def list_bucket(status: Column) -> Column:
    """FLT-08: which tab of the list a document belongs to."""
    return F.when(status.isin("pending", "processing"), "active").when(status == "complete", "done").when(status.isin("failed", "cancelled"), "issues")


def row_flags(observations: DataFrame) -> DataFrame:
    """FLT-09: review, flagged and edited marks of each row."""
    return observations.withColumns(
        {
            "review": F.col("mapping_status") != "confirmed",
            "flagged": (F.coalesce(F.size("validation_notes"), F.lit(0)) > 0) | ((F.col("extraction_source") == "fallback") & ~F.col("is_edited")),
            "edited": F.col("is_edited"),
        }
    )


def page_counters(validated: DataFrame, by: tuple[str, ...] = ("document_id", "page_number")) -> DataFrame:
    """AGG-17: rows kept, flagged and dropped per page."""
    kept = ~F.col("dropped")
    return validated.groupBy(*by).agg(
        F.count_if(kept).alias("kept"), F.count_if(kept & (F.size("notes") > 0)).alias("flagged"), F.count_if(F.col("dropped")).alias("dropped")
    )


def finalize_documents(pages: DataFrame) -> DataFrame:
    """AGG-18, STR-12: end state of each document from its pages (document_id, page_number, n_rows, failed, reason)."""
    reasons = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("page_number", "reason")))), lambda r: r["reason"]), "; "
    )
    out = pages.groupBy("document_id").agg(F.sum("n_rows").alias("n_rows"), F.bool_or("failed").alias("any_failure"), reasons.alias("reasons"))
    return out.select(
        "document_id", "n_rows", "any_failure",
        F.when(F.col("any_failure") & (F.col("n_rows") == 0), "failed").otherwise("complete").alias("status"),
        F.nullif(F.substring("reasons", 1, 2000), F.lit("")).alias("error_message"),
    )


def stage_histogram(observations: DataFrame, by: str = "document_id") -> DataFrame:
    """AGG-14: rows per mapping stage."""
    return observations.groupBy(by, "mapping_stage").agg(F.count(F.lit(1)).alias("n"))


STAGES = ("alias_exact", "learned", "retrieval_auto", "lexical_llm", "lexical_only", "error")


def run_summary(feed: DataFrame, observations: DataFrame, started: Column) -> DataFrame:
    """AGG-14: a row for each document of the feed (document_id, ts): seconds from its first event to its last, how many of them it
    waited (until the first event that is ``started``; all, if none is), and its rows by mapping stage, a column each.

    Both inputs are aggregated by document with partial sums; only totals meet.
    """
    at = lambda c: c.cast("double")
    times = feed.groupBy("document_id").agg(F.min(at(F.col("ts"))).alias("a"), F.max(at(F.col("ts"))).alias("b"), F.min(F.when(started, at(F.col("ts")))).alias("s"))
    stages = observations.groupBy("document_id").agg(*[F.count_if(F.col("mapping_stage") == s).alias(s) for s in STAGES])
    wall = F.col("b") - F.col("a")
    waited = F.greatest(F.lit(0.0), wall - (F.col("b") - F.coalesce("s", "b")))
    return times.join(stages, "document_id", "left").select(
        "document_id", F.round(wall, 1).alias("wall_seconds"), F.round(waited, 1).alias("queue_wait_seconds"), *[F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in STAGES]
    )


def with_grand_total(rows: DataFrame, key: str, *sums: str) -> DataFrame:
    """AGG-19: sums per key and a grand-total row (key null), from one pass."""
    return rows.rollup(key).agg(*[F.round(F.sum(c), 4).alias(c) for c in sums])


def fallback_confidence(confidence: Column) -> Column:
    """ORC-04."""
    return F.least(confidence, F.lit(C.FALLBACK_CONFIDENCE))


def text_lengths(df: DataFrame, *cols: str) -> DataFrame:
    """AGG-21: the longest value of each column."""
    return df.agg(*[F.max(F.length(c)).cast("long").alias(c) for c in cols])
