"""What a task holds does not grow with the table, and rows are dealt once (findings of round 4)."""

import random
import re

import pytest

from vialframe import session
from vialframe.plans.queries import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def dealt_parts(name, spark, sf_dir, monkeypatch, each: int) -> set[int]:
    """Numbers of parts over which a query deals its rows out itself, with so many rows a task."""
    monkeypatch.setattr(session, "TASK_ROWS", each)
    return {int(n) for n in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", plan_of(QUERIES[name](spark, sf_dir)))}


@pytest.mark.parametrize("name", ["specimen_carry", "page_parsing"])
def test_pages_are_dealt_by_the_number_of_rows(name, spark, sf_dir, monkeypatch):
    """F11, F18."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert dealt_parts(name, spark, sf_dir, monkeypatch, 100) == {-(-rows // 100)}
    assert dealt_parts(name, spark, sf_dir, monkeypatch, 50) == {-(-rows // 50)}


@pytest.mark.parametrize("name", ["zone_assignment", "reading_order"])
def test_lines_are_dealt_once(name, spark, sf_dir):
    """one exchange by page and no join."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_zones_by_windows_equal_the_joined_ones(spark):
    """pages with lines outside of them, turned or missing boxes and bands of several headers."""
    from vialframe.operators import layout

    rnd, rows = random.Random(4), []
    at = lambda a, b: rnd.randint(a, b) / 20
    for doc in range(400):
        wild = doc % 3
        for i in range(rnd.randint(1, 14)):
            x0, y0 = (at(-8, 26), at(-4, 24)) if wild else (at(0, 16), at(0, 19))
            x1, y1 = x0 + (at(-6, 12) if wild == 2 else at(0, 8)), y0 + (at(-2, 3) if wild == 2 else rnd.choice([0.01, 0.02, 0.05, 0.1]))
            x0, y0 = (None if wild and rnd.random() < 0.02 else v for v in (x0, y0))
            rows.append((doc, i % 2, i, "t" * rnd.choice([3, 3, 3, 90]), x0, y0, x1, y1, rnd.choice([12.5, 12.5, 11.5, 11.5, 10.0, None])))
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_idx int, text string, x0 double, y0 double, x1 double, y1 double, max_font double")
    headed = layout.with_headers(lines)
    columns = ["doc_id", "page", "line_idx", "page_band", "header", "zone"]
    want = {tuple(r) for r in layout.assign_zones(headed, layout.zones(headed)).select(columns).collect()}
    assert {tuple(r) for r in layout.zoned(lines).select(columns).collect()} == want and len(want) == len(rows)


def test_words_are_dealt_within_their_texts(spark, sf_dir):
    """the texts are dealt once, their words never, and no word is sorted by a window."""
    plan = plan_of(QUERIES["ocr_lines"](spark, sf_dir))
    assert plan.count("Exchange ") == 1 and "Join" not in plan and plan.count("Window ") == 1


def test_phrases_of_odd_words(spark):
    """an even number of heights, a gap at the limit and beyond it, equal places, unsure words between."""
    from vialframe.operators import layout

    words = [(0, 10, 10, "a", 90), (14, 5, 10, "b", 90), (20, 5, 10, "c", 80), (38, 5, 20, "d", 70), (38, 5, 20, "e", 70), (45, 5, 20, "f", 70), (39, 1, 99, "x", 1), (39, 1, 99, " ", 90)]
    df = spark.createDataFrame([(1, 1, 1, 1, 1, x, 5, w, h, t, c, 100, 100) for x, w, h, t, c in words], "doc_id int, page int, block_num int, par_num int, line_num int, left int, top int, width int, height int, text string, conf int, page_width int, page_height int")
    (row,) = layout.ocr_lines(df).collect()
    assert row.spans == ["a b c", "d e f"] and row.x0 == 0.0 and row.x1 == 0.5 and row.y1 == 0.25
    assert row.confidence == pytest.approx(((90 + 90 + 80) / 300 + 0.7) / 2)


@pytest.mark.parametrize("name", ["page_counters", "finalize_documents"])
def test_observations_are_dealt_by_their_number(name, spark, sf_dir, monkeypatch):
    """F16, F17."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert dealt_parts(name, spark, sf_dir, monkeypatch, 100) == {-(-rows // 100)}


@pytest.mark.parametrize("name", ["doc_quality", "alias_exact_map"])
def test_observations_pass_the_alias_index_unsorted(name, spark, sf_dir, monkeypatch):
    """the rows are dealt by name as well, and stream past the index's keys."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert dealt_parts(name, spark, sf_dir, monkeypatch, 20) == {-(-rows // 20)}
    assert re.search(r"ShuffledHashJoin \[_name#\d+\], \[_key#\d+\], LeftOuter, BuildRight", plan_of(QUERIES[name](spark, sf_dir)))


def test_runs_are_paired_in_a_stream(spark):
    """pages go through Python by batches, not one by one, and may begin and end anywhere in a batch."""
    from vialframe.operators import evaluate

    rnd = random.Random(3)
    run = lambda: [(f"f{i % 5}", i % 3, i, rnd.choice(["ab", "abc", "b", "x"]), rnd.choice("12"), f"c{i}") for i in range(300)]
    base, new = run(), run()
    want = []
    taken = set()
    for file, page, i, name, value, _ in base:
        fit = next((r for r in new if r[:2] == (file, page) and r[4] == value and r[2] not in taken and (r[3] in name or name in r[3])), None)
        if fit:
            taken.add(fit[2])
            want.append((file, page, i, fit[2]))
    frame = lambda rows: spark.createDataFrame(rows, "file string, page int, row_idx long, name string, value string, loinc string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = evaluate.agreement(frame(base), frame(new))
        assert "CoGroups" not in plan_of(got) and "MapInArrow" in plan_of(got)
        assert sorted((r.file, r.page, r.base_idx, r.new_idx) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set(key, before)
