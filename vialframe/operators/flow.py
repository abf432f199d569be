"""The flow of a document's pages through an extractor that may fail (STR-08, STR-10, ORC-01, ORC-03, ORC-04, SRC-20).

Documents are dealt over tasks and their pages stream through in order, so a decision is made before each call from
what the document's earlier pages have met; a task holds one page at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

from .. import config as C
from ..session import ship

TESTS = "array<struct<name:string,value:string,unit:string,reference_range:string,flag:string,specimen:string,confidence:double>>"
_FIELDS = ("name", "value", "unit", "reference_range", "flag", "specimen", "confidence")


class Breaker:
    """What a document's pages have met so far: whether the extractor may still be called, and the time gone."""

    def __init__(self, budget: float, clock: Callable[[], float]):
        self.budget, self.clock, self.began, self.stopped = budget, clock, clock(), None

    def failed(self, error: Exception) -> str:
        """The reason for a page; any error but an unreadable answer (ValueError) stops later calls."""
        reason = f"{type(error).__name__}: {error}"[:500]
        if not isinstance(error, ValueError):
            self.stopped = reason
        return reason

    def late(self) -> bool:
        return self.clock() - self.began > self.budget


def run_pages(
    pages: DataFrame, call: Callable[[dict], list[dict]], local: Callable[[dict], list[dict]], budget: Callable[[int], float] | float | None = None,
    seconds: Callable[[dict], float] | None = None,
) -> DataFrame:
    """(document_id, page_number, source, called, tests, note, reason) of every page.

    ``call`` is asked for a page until it fails for another reason than an unreadable answer (ValueError, which diverts one
    page); pages without an answer are read by ``local`` with capped confidence, unless the document's time is used up.
    ``reason`` says why a page has no rows; ``note`` why it went the local way. ``seconds``: the time a page takes, instead of the clock (for what must be repeatable).
    ``budget``: seconds, or a function of the number of pages (column num_pages).
    """
    ship(pages.sparkSession)
    columns = pages.columns
    key, number = pages.schema["document_id"].dataType.simpleString(), pages.schema["page_number"].dataType.simpleString()
    limit = budget if callable(budget) else (lambda n: C.BUDGET_MIN_SECONDS if n is None else max(C.BUDGET_MIN_SECONDS, C.BUDGET_PAGE_SECONDS * n)) if budget is None else (lambda _: budget)

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        document, breaker, spent = object(), None, [0.0]
        clock = time.monotonic if seconds is None else (lambda: spent[0])
        for pdf in batches:
            out = []
            for values in pdf.itertuples(index=False):
                page = dict(zip(columns, values, strict=True))
                if breaker is None or page["document_id"] != document:
                    document, most = page["document_id"], limit(page.get("num_pages"))
                    breaker = Breaker(most, clock)
                tests = note = None
                called = breaker.stopped is None
                if called:
                    try:
                        tests = call(page)
                    except Exception as e:
                        note = breaker.failed(e)
                else:
                    note = breaker.stopped
                source, reason, label = "llm", None, f"page {page['page_number']}"
                if tests is None:
                    source = "fallback"
                    if breaker.late():
                        source, reason = None, f"{label}: local extraction time budget ({breaker.budget:.0f}s) exceeded"
                    else:
                        try:
                            tests = [t | {"confidence": min(t.get("confidence") or 0.0, C.FALLBACK_CONFIDENCE)} for t in local(page)]
                            reason = None if tests else f"{label}: local fallback found no recognizable test rows"
                        except Exception as e:
                            reason = f"{label}: local fallback unavailable ({e})"
                if seconds is not None and source is not None:
                    spent[0] += seconds(page)
                out.append((page["document_id"], page["page_number"], source, called, [{f: t.get(f) for f in _FIELDS} for t in tests or []], note, reason))
            yield pd.DataFrame(out, columns=["document_id", "page_number", "source", "called", "tests", "note", "reason"])

    dealt = pages.repartition("document_id").sortWithinPartitions("document_id", "page_number")
    return dealt.mapInPandas(run, f"document_id {key}, page_number {number}, source string, called boolean, tests {TESTS}, note string, reason string")
