"""The page flow: decisions are made before each call."""

from __future__ import annotations

from vialframe.operators import flow


def test_no_call_after_the_first_failure_nor_local_reading_past_the_budget(spark, tmp_path):
    log = str(tmp_path / "calls")
    rows = [(d, n) for d in range(6) for n in range(1, 8)]
    pages = spark.createDataFrame(rows, "document_id long, page_number int").repartition(5)

    def call(page):
        with open(log, "a") as f:
            f.write(f"{page['document_id']},{page['page_number']}\n")
        if page["document_id"] % 2 and page["page_number"] == 3:
            raise TimeoutError("gone")
        if page["page_number"] == 2:
            raise ValueError("not JSON")
        return [{"name": "x", "confidence": 0.9}]

    def local(page):
        if page["page_number"] == 4:
            raise RuntimeError("no library")
        return [{"name": "y", "confidence": 0.9}]

    done = {(r.document_id, r.page_number): r for r in flow.run_pages(pages, call, local, budget=5.0, seconds=lambda p: 1.0).collect()}
    calls = {tuple(map(int, x.split(","))) for x in open(log).read().split()}
    assert calls == {(d, n) for d, n in rows if d % 2 == 0 or n <= 3} == {k for k, r in done.items() if r.called}
    assert done[0, 7].source == "llm" and done[0, 2].source == "fallback" and done[0, 2].note == "ValueError: not JSON" and done[0, 2].tests[0].confidence == 0.65
    assert done[1, 3].note == done[1, 5].note == "TimeoutError: gone" and not done[1, 5].called
    assert done[1, 4].reason == "page 4: local fallback unavailable (no library)"
    assert done[1, 6].source == "fallback" and done[1, 7].source is None and done[1, 7].reason == "page 7: local extraction time budget (5s) exceeded"


def test_flow_takes_no_pages(spark):
    assert flow.run_pages(spark.createDataFrame([], "document_id long, page_number int"), lambda p: [], lambda p: []).count() == 0
