"""Streaming forms of the lifecycle (STR-01/02/03/07/13) with Structured Streaming state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from ..session import ship


def heartbeats(feed: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """STR-02: last sign of life and entries per document and window; ``ts`` must be a timestamp with time zone."""
    return feed.withWatermark("ts", late).groupBy(F.window("ts", width), "document_id").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))


def limiter_stream(hits: DataFrame, limit: int, window_s: float) -> DataFrame:
    """STR-07: the admission limiter over a stream of (client, ts, seq). State: the admitted times of the window.

    A client's state goes once the watermark, a window behind the newest hit, has passed its last admitted time by a
    window: none of its times can count any more. Hits later than the watermark get no verdict.
    """
    import pandas as pd

    ship(hits.sparkSession)
    kind = hits.schema["client"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        admitted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        out = []
        for t, seq in zip(rows["t"], rows["seq"], strict=True):
            admitted = [a for a in admitted if t - a < window_s]
            if len(admitted) < limit:
                admitted.append(float(t))
                out.append((key[0], seq, True, 0.0))
            else:
                out.append((key[0], seq, False, max(0.1, window_s - (t - admitted[0]))))
        state.update((admitted,))
        state.setTimeoutTimestamp(max(int((admitted[-1] + window_s) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["client", "seq", "allowed", "retry_after"])

    timed = hits.withWatermark("ts", f"{max(1, round(window_s))} seconds").select("client", "seq", "ts", (F.unix_micros(F.col("ts")) / 1e6).alias("t"))
    return timed.groupBy("client").applyInPandasWithState(
        run, f"client {kind}, seq long, allowed boolean, retry_after double", "admitted array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def commits_stream(feed: DataFrame, every_s: float | None = None, keep_s: int = C.STUCK_SECONDS) -> DataFrame:
    """STR-02: ``lifecycle.commits`` over a stream of (document_id, ts, seq, forced). State: the time of a document's last commit.

    It goes once the document has been silent for ``keep_s`` seconds of event time (and at least ``every_s``): its next entry is committed anyway.
    """
    import pandas as pd

    from ..operators.lifecycle import COMMIT_EVERY_SECONDS, throttled

    ship(feed.sparkSession)
    every = COMMIT_EVERY_SECONDS if every_s is None else every_s
    kind = feed.schema["document_id"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        went, last = throttled(rows["t"], rows["forced"], state.get[0] if state.exists else None, every)
        state.update((float(last),))
        state.setTimeoutTimestamp(max(int((last + max(keep_s, every)) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"document_id": [key[0]] * len(rows), "seq": rows["seq"].to_numpy(), "committed": went})

    timed = feed.withWatermark("ts", "1 minute").select("document_id", "seq", "ts", F.coalesce("forced", F.lit(False)).alias("forced"), (F.unix_micros(F.col("ts")) / 1e6).alias("t"))
    return timed.groupBy("document_id").applyInPandasWithState(run, f"document_id {kind}, seq long, committed boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def stuck_stream(feed: DataFrame, after_s: int = C.STUCK_SECONDS) -> DataFrame:
    """STR-03: documents whose feed (document_id, ts) was silent for ``after_s`` seconds of event time."""
    import pandas as pd

    ship(feed.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], last)], columns=["document_id", "last_seen_ms"])
            return
        newest = max(int(b["ms"].max()) for b in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        state.setTimeoutTimestamp(max(last + after_s * 1000, state.getCurrentWatermarkMs() + 1))

    kind = feed.schema["document_id"].dataType.simpleString()
    timed = feed.withWatermark("ts", "0 seconds").select("document_id", "ts", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("document_id").applyInPandasWithState(
        run, f"document_id {kind}, last_seen_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def claim(spark, folder: str, name: str) -> bool:
    """STR-01: compare-and-swap on the shared file system: only the first to create the claim's file has it."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    try:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False).close()
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise


def claim_next(queue: DataFrame, claims: str, tries: int = 5):
    """STR-01, SRT-04: the id of the oldest pending document that this worker won, or None; a lost race moves on to the next."""
    from ..operators.lifecycle import next_pending

    for row in next_pending(queue, tries).select("document_id").collect():
        if claim(queue.sparkSession, claims, f"document-{row['document_id']}"):
            return row["document_id"]
    return None


def claim_worker(queue: DataFrame, process, checkpoint: str, every: str = "2 seconds", claims: str | None = None, tries: int = 20):
    """STR-01, STR-13: each micro-batch claims the pending documents that arrived and that no worker has claimed before.

    Claims are rows of a keyed table at ``claims`` (workers that share a queue share it, each with a checkpoint of its own), written before
    ``process(claimed, batch)`` runs: a batch commits its claims against the version that it has read, and if another worker
    was faster it looks again. Only the parts of the table that the batch's documents fall into are read. A batch that was processed is marked; one that Spark
    repeats after a crash finds its own claims, or is skipped if its mark is there.
    """
    from ..sources.keyed import Conflict, KeyedTable
    from ..sources.tables import has_files

    pending = queue.where("status = 'pending'")
    worker = checkpoint.rstrip("/")
    held = claims or f"{worker}-claims"

    def step(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{worker}-done/{n}")
        files = done.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(done):
            return
        new = df.select("document_id").dropDuplicates().withColumns({"worker": F.lit(worker), "batch": F.lit(n).cast("long")})
        for left in range(tries, 0, -1):
            try:
                table = KeyedTable.open(spark, held) if has_files(spark, f"{held}/pointers") else KeyedTable.create(new.limit(0), held, ("document_id",))
                table = table.upsert(new, lambda rows, more: rows.unionByName(more.join(rows.select("document_id"), "document_id", "left_anti").select(*rows.columns)))
                break
            except Conflict:
                if left == 1:
                    raise
        mine = table.read().where((F.col("worker") == worker) & (F.col("batch") == n)).select("document_id")
        process(df.dropDuplicates(["document_id"]).join(mine, "document_id", "left_semi").withColumn("status", F.lit("processing")), n)
        files.create(done, True).close()

    return pending.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
