"""The driver tables seen as laboratory data: the same views in Spark and, as SQL text, for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt
from ..sources.tables import table


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """part as a terminology: codes, names, systems, units, ranks and aliases."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    unit = F.when(F.col("p_size") % 4 == 0, "g/dL").when(F.col("p_size") % 4 == 1, "mg/dL").when(F.col("p_size") % 4 == 2, "%")
    name = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return p.select(
        k.alias("ord"), F.concat(k.cast("string"), F.lit("-"), (k % 10).cast("string")).alias("loinc_num"),
        F.when(F.col("p_size") % 7 == 0, F.concat(name, F.lit(" [Presence]"))).otherwise(name).alias("long_common_name"),
        F.col("p_name").alias("shortname"), F.col("p_type").alias("component"), F.col("p_type").alias("system"), unit.alias("example_units"),
        (F.col("p_size") * 40).alias("common_test_rank"),
        F.array("p_name", "p_brand", F.concat_ws(" ", "p_name", k.cast("string"))).alias("aliases"),
    )


CATALOG_SQL = """catalog AS (
  SELECT p_partkey AS ord, p_partkey::VARCHAR || '-' || (p_partkey % 10)::VARCHAR AS loinc_num,
    p_name || ' ' || p_type || ' ' || p_brand || CASE WHEN p_size % 7 = 0 THEN ' [Presence]' ELSE '' END AS long_common_name,
    p_name AS shortname, p_type AS component, p_type AS system,
    CASE p_size % 4 WHEN 0 THEN 'g/dL' WHEN 1 THEN 'mg/dL' WHEN 2 THEN '%' END AS example_units, p_size * 40 AS common_test_rank,
    [p_name, p_brand, p_name || ' ' || p_partkey::VARCHAR] AS aliases
  FROM part)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with part and orders as observations: names in three spellings with case and punctuation noise."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    j = dealt(li.join(p, F.col("l_partkey") == F.col("p_partkey")), li.count(), "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    v = F.col("l_suppkey") % 3
    name = (
        F.when(v == 0, F.concat(F.upper("p_name"), F.lit(" - "), F.col("l_partkey").cast("string")))
        .when(v == 1, F.col("p_name"))
        .otherwise(F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit(" / "), F.col("p_brand")))
    )
    lo = F.col("p_size").cast("string")
    unit = F.when(v == 0, "gm/dl").when(v == 1, " MG/DL [H]").when(F.col("l_linenumber") % 2 == 0, "o/at")
    qty = F.col("l_quantity").cast("long")
    status = F.when(F.col("l_linenumber") % 3 == 0, "confirmed").when(F.col("l_linenumber") % 3 == 1, "needs_review").otherwise("unmapped")
    return j.select(
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("observation_id"),
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), name.alias("original_test_name"),
        qty.cast("string").alias("value"), unit.alias("unit"), F.concat(lo, F.lit(" - "), (F.col("p_size") + 5).cast("string")).alias("reference_range"),
        F.col("p_type").alias("specimen"), F.lit(None).cast("string").alias("method"), F.when(F.col("l_returnflag") == "R", "High").when(F.col("l_returnflag") == "A", "low").alias("flag"),
        F.round(1 - F.col("l_discount") * 4, 2).alias("extraction_confidence"), status.alias("mapping_status"), F.col("o_orderdate").alias("created_at"),
        F.lit(False).alias("ocr"),
    )


OBSERVATIONS_SQL = """observations AS (
  SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS observation_id, l_orderkey AS document_id, l_linenumber AS page_number,
    CASE l_suppkey % 3 WHEN 0 THEN upper(p_name) || ' - ' || l_partkey::VARCHAR WHEN 1 THEN p_name ELSE p_name || ', ' || p_type || ' / ' || p_brand END AS original_test_name,
    l_quantity::BIGINT::VARCHAR AS value, CASE WHEN l_suppkey % 3 = 0 THEN 'gm/dl' WHEN l_suppkey % 3 = 1 THEN ' MG/DL [H]' WHEN l_linenumber % 2 = 0 THEN 'o/at' END AS unit,
    p_size::VARCHAR || ' - ' || (p_size + 5)::VARCHAR AS reference_range, p_type AS specimen, NULL::VARCHAR AS method,
    CASE l_returnflag WHEN 'R' THEN 'High' WHEN 'A' THEN 'low' END AS flag, round(1 - l_discount * 4, 2) AS extraction_confidence,
    CASE l_linenumber % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'needs_review' ELSE 'unmapped' END AS mapping_status, o_orderdate AS created_at
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def feed(spark: SparkSession, d: str) -> DataFrame:
    """events as the progress feed of documents (a user is a document)."""
    e = table(spark, d, "events")
    msg = (
        F.when(F.col("event_type") == "purchase", "Matching rows").when(F.col("event_type") == "click", "Page read; AI took 3.5 s")
        .when(F.col("event_type") == "signup", "Opened the file").otherwise("...")
    )
    return e.select(F.col("user_id").alias("document_id"), F.col("ts"), F.col("event_id").alias("seq"), msg.alias("msg"), F.col("event_type").alias("level"), "value")


FEED_SQL = """feed AS (
  SELECT user_id AS document_id, ts, event_id AS seq, event_type AS level, value,
    CASE event_type WHEN 'purchase' THEN 'Matching rows' WHEN 'click' THEN 'Page read; AI took 3.5 s' WHEN 'signup' THEN 'Opened the file' ELSE '...' END AS msg
  FROM events)"""


def queue(spark: SparkSession, d: str) -> DataFrame:
    """orders as the document queue."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "processing").when(F.col("o_orderstatus") == "O", "pending").when(k % 2 == 0, "complete").otherwise("failed")
    return o.select(
        k.alias("document_id"), F.concat(F.lit("report "), k.cast("string"), F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".txt").otherwise(".bin")).alias("filename"),
        F.when(k % 2 == 0, "application/octet-stream").otherwise("text/plain").alias("content_type"), (k % 40 * 1048576 / 2).cast("long").alias("n_bytes"),
        F.col("o_orderdate").alias("uploaded_at"), F.when(k % 5 != 0, F.timestamp_add("SECOND", (k % 400).cast("int"), F.col("o_orderdate"))).alias("updated_at"),
        status.alias("status"), (k % 4 == 0).alias("cancel_requested"), (k % 9).cast("int").alias("num_pages"),
    )


QUEUE_SQL = """queue AS (
  SELECT o_orderkey AS document_id, 'report ' || o_orderkey::VARCHAR || CASE o_orderkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.bin' END AS filename,
    CASE WHEN o_orderkey % 2 = 0 THEN 'application/octet-stream' ELSE 'text/plain' END AS content_type, CAST(o_orderkey % 40 * 1048576 / 2 AS BIGINT) AS n_bytes,
    o_orderdate AS uploaded_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_seconds(o_orderkey % 400) END AS updated_at,
    CASE WHEN o_orderstatus = 'F' THEN 'processing' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderkey % 2 = 0 THEN 'complete' ELSE 'failed' END AS status,
    o_orderkey % 4 = 0 AS cancel_requested, CAST(o_orderkey % 9 AS INTEGER) AS num_pages
  FROM orders)"""
