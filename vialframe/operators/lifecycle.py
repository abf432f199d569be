"""Job lifecycle over a document queue and its feed (STR-01..12, WIN-12/13, FN-29, AGG-15, SRC-10); batch forms."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import ship

TERMINAL = ("complete", "failed", "cancelled")


def heartbeat_age(updated_at: Column, uploaded_at: Column, now: Column) -> Column:
    """FN-29: seconds since the last sign of life; 0 if there never was one."""
    seen = F.coalesce(updated_at, uploaded_at)
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(seen), F.lit(0))


def next_pending(queue: DataFrame, n: int = 1) -> DataFrame:
    """STR-01, SRT-04: the oldest pending documents, first come first served."""
    return queue.where("status = 'pending'").orderBy(F.asc_nulls_first("uploaded_at"), "document_id").limit(n)


def recover_stuck(queue: DataFrame, now: Column, older_than: int = C.STUCK_SECONDS) -> DataFrame:
    """STR-03: documents in work without a heartbeat go back to pending, or end if their cancellation was asked for."""
    stuck = (F.col("status") == "processing") & (heartbeat_age(F.col("updated_at"), F.col("uploaded_at"), now) > older_than)
    to = F.when(F.col("cancel_requested"), "cancelled").otherwise("pending")
    return queue.withColumns({"status": F.when(stuck, to).otherwise(F.col("status")), "recovered": F.coalesce(stuck, F.lit(False))})


def cancel(queue: DataFrame, now: Column) -> DataFrame:
    """STR-04: what a cancellation does to each document: refused (409), cancelled at once, or flagged for the worker."""
    status = F.col("status")
    stale = heartbeat_age(F.col("updated_at"), F.col("uploaded_at"), now) > C.CANCEL_STALE_SECONDS
    outcome = (
        F.when(status.isin(*TERMINAL), "conflict").when(status == "pending", "cancelled").when(stale, "cancelled").otherwise("requested")
    )
    return queue.withColumns(
        {"outcome": outcome, "cancel_requested": F.col("cancel_requested") | (outcome == "requested"), "status": F.when(outcome == "cancelled", "cancelled").otherwise(status)}
    )


def feed_tail(feed: DataFrame, cap: int = C.FEED_CAP) -> DataFrame:
    """WIN-12, STR-06: the last ``cap`` entries of each document's feed (document_id, ts, seq, msg, level)."""
    newest = Window.partitionBy("document_id").orderBy(F.desc("ts"), F.desc("seq"))
    return feed.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= cap).drop("_n")


def feed_step(msg: Column) -> Column:
    """WIN-13: 3 matching, 2 reading pages, 1 opened; null for entries that tell nothing."""
    m = F.lower(msg)
    has = lambda *words: F.rlike(m, F.lit("|".join(words)))
    return F.when(has("match"), 3).when(has("page", r"\bai\b"), 2).when(has("opened", "picked"), 1)


def feed_phase(feed: DataFrame, step: Column | None = None) -> DataFrame:
    """WIN-13: the phase that the newest telling entry shows; 0 if none does."""
    step = feed_step(F.col("msg")) if step is None else step
    told = feed.withColumn("_s", step)
    return told.groupBy("document_id").agg(F.coalesce(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.struct("ts", "seq"))), F.lit(0)).alias("phase"))


def feed_offsets(feed: DataFrame, **predicates: Column) -> DataFrame:
    """AGG-15: per document the seconds from its first entry to the first entry of each predicate, and the AI seconds its messages name."""
    t = F.unix_timestamp("ts")
    first = {f"_{k}": F.min(F.when(p, t)) for k, p in predicates.items()}
    ai = F.sum(F.nullif(F.regexp_extract("msg", r"AI[^0-9]*(\d+(?:\.\d+)?)\s*s", 1), F.lit("")).try_cast("double"))
    out = feed.groupBy("document_id").agg(F.min(t).alias("_t0"), ai.alias("ai_seconds"), *[c.alias(k) for k, c in first.items()])
    return out.select("document_id", "ai_seconds", *[(F.col(f"_{k}") - F.col("_t0")).alias(f"{k}_s") for k in predicates])


def circuit_breaker(pages: DataFrame, by: str = "document_id", order: str = "page_number") -> DataFrame:
    """STR-08: use_llm per page: false after the first fatal failure of the document; a diverted page only for itself.

    pages: fatal, diverted booleans of each page's own call.
    """
    earlier = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tripped = F.coalesce(F.max(F.col("fatal").cast("int")).over(earlier), F.lit(0)) > 0
    return pages.withColumns({"tripped": tripped, "use_llm": ~tripped & ~F.col("fatal") & ~F.col("diverted")})


def within_budget(pages: DataFrame, budget: Column, by: str = "document_id", order: str = "page_number") -> DataFrame:
    """STR-10: pages that start before the document's time budget is spent."""
    earlier = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("processed", F.coalesce(F.sum("cost").over(earlier), F.lit(0.0)) <= budget)


def valid_batches(files: DataFrame) -> DataFrame:
    """SRC-10: files (batch_id, problem) of batches in which every file is fine."""
    fine = F.bool_and(F.col("problem").isNull()).over(Window.partitionBy("batch_id"))
    return files.withColumn("accepted", fine)


def limiter(hits: DataFrame, limit: int, window_s: float) -> DataFrame:
    """STR-07: admission per client: a hit passes if fewer than ``limit`` admitted hits lie in the last ``window_s`` seconds.

    hits: client, ts (timestamp), seq. Rejected hits do not count, so the decision is recursive: each client's hits stream
    through in order, sorted by Spark, and only the last ``limit`` admitted times of the current client are held.
    """
    import pandas as pd

    ship(hits.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        client, queue = object(), deque()
        for pdf in batches:
            wait = []
            for c, t in zip(pdf["client"], pdf["t"], strict=True):
                if c != client:
                    client, queue = c, deque()
                while queue and t - queue[0] >= window_s:
                    queue.popleft()
                if len(queue) >= limit:
                    wait.append(max(0.1, window_s - (t - queue[0])))
                else:
                    queue.append(t)
                    wait.append(0.0)
            yield pdf.assign(retry_after=wait, allowed=[w == 0.0 for w in wait])[["client", "seq", "allowed", "retry_after"]]

    timed = hits.select("client", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    sorted_ = timed.repartition("client").sortWithinPartitions("client", "t", "seq")
    kind = hits.schema["client"].dataType.simpleString()
    return sorted_.mapInPandas(run, f"client {kind}, seq long, allowed boolean, retry_after double")


COMMIT_EVERY_SECONDS = 0.8


def throttled(times, forced, last: float | None, every_s: float) -> tuple[list[bool], float | None]:
    """Which of a document's entries, in order, are committed, and when the last of them was."""
    out = []
    for t, f in zip(times, forced, strict=True):
        go = bool(f) or last is None or t - last >= every_s
        last = t if go else last
        out.append(go)
    return out, last


def commits(feed: DataFrame, every_s: float = COMMIT_EVERY_SECONDS) -> DataFrame:
    """STR-02: (document_id, seq, committed): an entry of the feed (document_id, ts, seq, forced) is committed, which is the document's
    heartbeat, if it is forced or the last commit lies ``every_s`` seconds back.

    Each document's entries stream through in order, sorted by Spark; only the time of the last commit is held.
    """
    import pandas as pd

    ship(feed.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, last = object(), None
        for pdf in batches:
            out: list[bool] = []
            for key, part in pdf.groupby("document_id", sort=False, dropna=False):
                last = last if key == document else None
                document = key
                went, last = throttled(part["t"], part["forced"], last, every_s)
                out += went
            yield pdf.assign(committed=out)[["document_id", "seq", "committed"]]

    timed = feed.select("document_id", "seq", F.coalesce("forced", F.lit(False)).alias("forced"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    kind = feed.schema["document_id"].dataType.simpleString()
    return timed.repartition("document_id").sortWithinPartitions("document_id", "t", "seq").mapInPandas(run, f"document_id {kind}, seq long, committed boolean")
