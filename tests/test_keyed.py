"""Keyed tables: upserts rewrite what they touch, and nothing is seen before it is committed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vialframe.operators import store
from vialframe.sources.keyed import Conflict, KeyedTable, apply_events


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def part_files(table):
    return {p: v for p, v in table.state["versions"].items()}


def test_upserts_rewrite_only_the_parts_that_they_touch(spark, tmp_path):
    base = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    table = KeyedTable.create(base, f"file://{tmp_path}/t", ("k",), parts=8)
    want = {k: "old" for k in range(200)}
    for step, keys in enumerate(([3, 5000], [3], [7, 8, 9])):
        before = part_files(table)
        changes = spark.createDataFrame([(k, f"new{step}") for k in keys], "k long, v string")
        touched = {str(r[0]) for r in changes.select(table.part()).collect()}
        table = table.upsert(changes)
        want |= {k: f"new{step}" for k in keys}
        after = part_files(table)
        assert {p for p in after if after[p] != before.get(p)} == touched
        assert rows(table.read()) == sorted(want.items(), key=str)
    assert rows(KeyedTable.open(spark, table.path).read()) == rows(table.read())
    assert len(rows(KeyedTable.open(spark, table.path, version=1).read())) == 200
    gone = table.vacuum()
    assert gone and rows(KeyedTable.open(spark, table.path).read()) == sorted(want.items(), key=str)


def test_a_writer_that_dies_before_the_swap_changes_nothing(spark, tmp_path):
    table = KeyedTable.create(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v")), f"file://{tmp_path}/t", ("k",), parts=4)
    was = rows(table.read())

    def dies(now, changes):
        return now.withColumn("v", F.when(F.col("k") >= 0, F.raise_error(F.lit("lost")).cast("int")))

    with pytest.raises(Exception, match="lost"):
        table.upsert(spark.createDataFrame([(1, 2)], "k long, v int"), dies)
    assert rows(KeyedTable.open(spark, table.path).read()) == was
    # two writers that read the same version: the second is told, and nothing of its rows is seen
    one, two = KeyedTable.open(spark, table.path), KeyedTable.open(spark, table.path)
    one.upsert(spark.createDataFrame([(1, 10)], "k long, v int"))
    with pytest.raises(Conflict):
        two.upsert(spark.createDataFrame([(1, 20)], "k long, v int"))
    assert dict(rows(KeyedTable.open(spark, table.path).read()))[1] == 10


def test_parts_may_empty_and_null_keys_are_keys(spark, tmp_path):
    base = spark.createDataFrame([(None, "a"), (1, "b")], "k long, v string")
    table = KeyedTable.create(base, f"file://{tmp_path}/t", ("k",), parts=4)
    table = table.upsert(spark.createDataFrame([(None, "c")], "k long, v string"))
    assert rows(table.read()) == [(1, "b"), (None, "c")]
    table = table.upsert(base.where("k = 1"), lambda now, changes: now.join(changes.select("k"), "k", "left_anti"))
    assert rows(table.read()) == [(None, "c")]
    assert KeyedTable.create(base.limit(0), f"file://{tmp_path}/e", ("k",)).read().count() == 0
    assert table.upsert(base.limit(0)) is table


def test_events_are_folded_once_each(spark, tmp_path):
    fields = ", ".join(f"{c} string" for c in store.EDITABLE)
    base = spark.createDataFrame([(i, *[f"{c}{i}" for c in store.EDITABLE]) for i in range(30)], f"observation_id long, {fields}").withColumns({"is_edited": F.lit(False), "extraction_source": F.lit("llm")})
    shape = "seq long, observation_id long, action string, patch map<string,string>"
    first = [(1, 3, "update", {"value": "x"}), (2, 40, "create", {"original_test_name": "new", "value": "1"}), (3, 5, "delete", None)]
    second = [(4, 3, "update", {"unit": None}), (5, 40, "update", {"value": "2"}), (6, 6, "update", {"flag": "H"})]
    columns = ["observation_id", *store.EDITABLE, "is_edited", "extraction_source"]
    whole = store.current_rows(base, store.accepted_events(spark.createDataFrame(first + second, shape)))
    table = KeyedTable.create(base, f"file://{tmp_path}/o", ("observation_id",), parts=8)
    for events in (first, second):
        table = apply_events(table, spark.createDataFrame(events, shape))
    assert rows(table.read().select(*columns)) == rows(whole.select(*columns))
