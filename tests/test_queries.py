"""Every registered report query equals its oracle, and the entry point works."""

import pytest

from tests.conftest import same_rows
from vialframe.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(name, spark, duck, sf_dir):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_and_no_cartesian_on_the_flagship(spark, sf_dir):
    plan = QUERIES["doc_quality"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_report_list_never_reads_the_blob(spark, tmp_path):
    from pyspark.sql import functions as F

    from vialframe.operators.store import list_reports

    spark.range(3).select(F.col("id").alias("document_id"), F.lit(b"x").alias("raw_content"), F.current_timestamp().alias("uploaded_at")).write.parquet(str(tmp_path / "d"))
    plan = list_reports(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "raw_content" not in plan
