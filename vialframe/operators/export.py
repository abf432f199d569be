"""FHIR-shaped export (FN-22..24, SRC-18): nested structs, to_json at the end leaves nulls out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import spaced
from ..functions.text import standardize_unit, strip

STATUS_URL, CONFIDENCE_URL = "urn:vialframe:mapping-status", "urn:vialframe:mapping-confidence"
_RANGE = spaced(r"^\s*([-+]?\d+(?:\.\d+)?)\s*-\s*([-+]?\d+(?:\.\d+)?)\s*$")


def is_pure_number(value: Column) -> Column:
    return F.rlike(strip(value), F.lit(r"^[-+]?\d+(?:\.\d+)?$"))


def value_quantity(value: Column, unit: Column) -> Column:
    """FN-22: struct(value, unit) if the whole value is a signed decimal, else null."""
    return F.when(is_pure_number(value), F.struct(strip(value).try_cast("double").alias("value"), standardize_unit(unit).alias("unit")))


def value_string(value: Column) -> Column:
    """FN-22: the untouched value if it is no plain number."""
    return F.when(~is_pure_number(value), value)


def reference_range(text: Column) -> Column:
    """FN-23: low and high of a whole 'lo-hi', else the text; null for none."""
    part = lambda g: F.nullif(F.regexp_extract(text, _RANGE, g), F.lit("")).try_cast("double")
    bound = lambda g: F.when(part(g).isNotNull(), F.struct(part(g).alias("value")))
    return F.when(F.coalesce(text, F.lit("")) != "", F.struct(bound(1).alias("low"), bound(2).alias("high"), F.when(part(1).isNull(), text).alias("text")))


#: The columns of an observation that its resource shows.
SHOWN = ("observation_id", "original_test_name", "normalized_test_name", "loinc_code", "loinc_display", "mapping_status", "mapping_confidence", "value", "unit", "reference_range", "specimen", "page_number")


def observation_resource(of: Callable[[str], Column] = F.col) -> Column:
    """FN-24: the resource of a row as a struct over the observation's columns, which ``of`` finds by name."""
    display = F.coalesce(*[F.nullif(of(c), F.lit("")) for c in ("loinc_display", "normalized_test_name", "original_test_name")])
    coding = F.when(
        F.coalesce(of("loinc_code"), F.lit("")) != "",
        F.array(F.struct(F.lit("http://loinc.org").alias("system"), of("loinc_code").alias("code"), display.alias("display"))),
    )
    category = F.array(
        F.struct(
            F.array(F.struct(F.lit("http://terminology.hl7.org/CodeSystem/observation-category").alias("system"), F.lit("laboratory").alias("code"), F.lit("Laboratory").alias("display"))).alias("coding")
        )
    )
    none = F.lit(None)
    extension = F.array_compact(
        F.array(
            F.struct(F.lit(STATUS_URL).alias("url"), of("mapping_status").alias("valueString"), none.cast("double").alias("valueDecimal")),
            F.when(of("mapping_confidence").isNotNull(), F.struct(F.lit(CONFIDENCE_URL).alias("url"), none.cast("string").alias("valueString"), of("mapping_confidence").alias("valueDecimal"))),
        )
    )
    span = reference_range(of("reference_range"))
    return F.struct(
        F.lit("Observation").alias("resourceType"),
        F.concat(F.lit("obs-"), of("observation_id").cast("string")).alias("id"),
        F.lit("final").alias("status"),
        category.alias("category"),
        F.struct(of("original_test_name").alias("text"), coding.alias("coding")).alias("code"),
        F.struct(F.lit("Patient/patient-1").alias("reference")).alias("subject"),
        extension.alias("extension"),
        value_quantity(of("value"), of("unit")).alias("valueQuantity"),
        value_string(of("value")).alias("valueString"),
        F.when(span.isNotNull(), F.array(span)).alias("referenceRange"),
        F.when(F.coalesce(of("specimen"), F.lit("")) != "", F.struct(of("specimen").alias("display"))).alias("specimen"),
        F.when(of("page_number").isNotNull(), F.array(F.struct(F.concat(F.lit("Source page "), of("page_number").cast("string")).alias("text")))).alias("note"),
    )


def bundles(documents: DataFrame, observations: DataFrame) -> DataFrame:
    """SRC-18: (document_id, bundle) with the bundle as JSON; resources by page, creation time and id."""
    # rows meet as they are: their JSON, many times as long, is made where the bundle is
    first = ("page_number", "created_at", "observation_id")
    rows = observations.select("document_id", F.struct(*first, *[c for c in SHOWN if c not in first]).alias("r"))
    listed = rows.groupBy("document_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    patient = '{"resource":{"resourceType":"Patient","id":"patient-1"}}'
    stamp = F.when(F.col("uploaded_at").isNotNull(), F.concat(F.lit('"timestamp":"'), F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('",'))).otherwise("")
    json = lambda r: F.to_json(observation_resource(lambda c: r[c]))
    entries = F.coalesce(F.transform("rs", lambda r: F.concat(F.lit('{"resource":'), json(r), F.lit("}"))), F.array().cast("array<string>"))
    bundle = F.concat(F.lit('{"resourceType":"Bundle","type":"collection",'), stamp, F.lit('"entry":['), F.array_join(F.concat(F.array(F.lit(patient)), entries), ","), F.lit("]}"))
    return documents.select("document_id", "uploaded_at").join(listed, "document_id", "left").select("document_id", bundle.alias("bundle"))


def write_bundles(documents: DataFrame, observations: DataFrame, path: str) -> None:
    """SRC-18: the bundles as a file sink, one JSON line for each document, packed by gzip; Spark's commit makes a failed task leave nothing."""
    bundles(documents, observations).select("bundle").write.text(path, compression="gzip")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_bundles`` has written: timestamp, number of entries and ids of the resources, each line parsed once."""
    shape = "timestamp string, entry array<struct<resource:struct<resourceType:string,id:string>>>"
    b = spark.read.schema(shape).json(path)
    ids = F.transform(F.filter("entry", lambda e: e["resource"]["resourceType"] == "Observation"), lambda e: e["resource"]["id"])
    return b.select("timestamp", F.size("entry").alias("n_entries"), ids.alias("ids"))
