"""Operator 7: URL filter lists, with DataFrame functions only.

Each URL is expanded into host-suffix x path-prefix expressions: the host and
every part of it that follows a dot, with the path cut to each length that a
rule's path has; suffixes with more labels than any rule's host fit none and are
left out, so a URL of any length makes few. Expressions and rules meet in an equi-join on the first four
bytes of their SHA-256; the whole digest confirms, and of the rules that fit a
URL the longest wins (of equally long ones block before allow, then the
smaller text). URLs that no rule fits get ``default``.

The exploded expressions of a row stay in its partition and are aggregated
there before the only shuffle, which carries one row per URL. The rules are a
plain join side: Spark broadcasts them only below its own size threshold.

Defined cases: a null URL or one without ``://`` has empty host and path and is
judged by the default; repeated rows stay; extra columns are not returned;
an empty table gives no rows; an empty rule list gives the default everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a DataFrame."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """One row per row of ``pages`` (key, url): key, host, path, rule, verdict."""
    prepared = rules.select(
        _digest(F.col("host"), F.col("path")).alias("r_digest"),
        F.concat("host", "path").alias("r_rule"),
        F.col("verdict").alias("r_verdict"),
        F.char_length("path").alias("r_cut"),
        F.size(F.split("host", r"\.", -1)).alias("r_labels"),
    ).withColumn("short", F.substring("r_digest", 1, 8))
    # the distinct path lengths: one row, at most as many values as rules have lengths; with them the most labels of a host
    shape = prepared.agg(F.struct(F.array_sort(F.collect_set("r_cut")).alias("cuts"), F.coalesce(F.max("r_labels"), F.lit(0)).alias("labels"))).scalar()
    rows = pages.select(
        F.monotonically_increasing_id().alias("row_uid"),
        F.col(key).alias("row_key"),
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
    ).withColumn("shape", shape)
    parts = F.split("host", r"\.", -1)
    most = F.least(F.col("shape.labels"), F.size(parts))
    last = F.slice(parts, F.size(parts) - most + 1, F.size(parts))
    suffixes = F.when(most > 0, F.transform(F.sequence(F.lit(1), most), lambda i: F.array_join(F.slice(last, i, most), "."))).otherwise(F.array().cast("array<string>"))
    prefixes = F.transform(
        F.filter("shape.cuts", lambda n: n <= F.char_length("path")), lambda n: F.col("path").substr(F.lit(1), n)
    )
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    expanded = rows.withColumn("digest", F.explode_outer(F.array_distinct(expressions)))
    found = expanded.withColumn("short", F.substring("digest", 1, 8)).join(prepared, "short", "left")
    confirmed = F.when(
        F.col("digest") == F.col("r_digest"),
        F.struct(
            F.char_length("r_rule").alias("size"),
            (F.col("r_verdict") == "block").alias("block"),
            F.col("r_rule").alias("rule"),
            F.col("r_verdict").alias("verdict"),
        ),
    )
    best = found.groupBy("row_uid").agg(
        F.any_value("row_key").alias("row_key"), F.any_value("host").alias("host"), F.any_value("path").alias("path"),
        F.max(confirmed).alias("best"),
    )
    return best.select(
        F.col("row_key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
