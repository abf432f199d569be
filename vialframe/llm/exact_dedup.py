"""Operator 10: exact deduplication by a tree merge of sorted digest runs.

Every scan partition becomes a *run*: its (digest, verification, max id, count)
entries sorted by digest, equal texts collapsed. The runs then meet in
``log_k P`` rounds. In round r each run is cut by the r-th digit of the digest's
home partition and the pieces of ``k`` partitions meet in one, which merges the
sorted pieces and collapses equal entries again. After the last round a
partition holds one contiguous digest range, completely merged, so no task ever
holds more than its share and a group of any size is at most one entry per run
at every level.

Texts are equal when identical after lower-casing A-Z. The 64-bit xxhash orders
the runs; SHA-256 and byte length of the normalised text verify every merge, so
entries with the same short digest and different texts stay apart.

Defined cases: null text counts as empty; a null doc_id loses against any other
id, and a group of null ids only keeps null; repeated rows count separately;
columns beyond doc_id and text are never read, and ``keep_one`` hands them on;
empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import lean, salted_groups, shuffle_partitions

#: Runs that meet in one partition in a round.
FAN_IN = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "home int, digest long, sha string, n_bytes long, keep_id long, n long"


def normalised(text: Column) -> Column:
    """A-Z to a-z, nothing else; null to empty. Texts of one byte per character take the fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )


def _collapse(batches: Iterable) -> Iterator:
    """Merge a sorted partition: equal (digest, sha, n_bytes) become one entry. Holds one batch and one entry."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    # Spark marks columns that hold no null, what is made here is not marked: batches of both kinds can't be put together
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    shape = pa.schema(list(zip(["home", "digest", "sha", "n_bytes", "keep_id", "n"], kinds, strict=True)))
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).cast(shape)
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        # equal entries are neighbours; a table of hashes would find them too, but gives its groups in no certain order
        changes = np.zeros(table.num_rows - 1, bool)
        for key in ("digest", "sha", "n_bytes"):
            column = table.column(key)
            changes |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(changes) + 1))
        ids = table.column("keep_id")
        most = np.maximum.reduceat(ids.fill_null(np.iinfo(np.int64).min).to_numpy(), starts)
        none = np.logical_and.reduceat(ids.is_null().to_numpy(), starts)
        sums = [pa.array(most, mask=none), pa.array(np.add.reduceat(table.column("n").to_numpy(), starts))]
        merged = pa.table([*table.select(shape.names[:4]).take(starts).columns, *sums], schema=shape)
        held = merged.slice(merged.num_rows - 1, 1)
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _radices(partitions: int, fan_in: int) -> list[int]:
    rounds = 1
    while fan_in**rounds < partitions:
        rounds += 1
    radix = max(2, round(partitions ** (1 / rounds) + 0.4999))
    return [radix] * rounds


def digest_groups(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Merge (digest, sha, n_bytes, keep_id, n) rows to one row per distinct text, by the tree of runs."""
    ship(rows.sparkSession)
    radices = _radices(shuffle_partitions(rows.sparkSession), fan_in)
    total = 1
    for r in radices:
        total *= r
    # the home partition: a contiguous range of unsigned digests
    home = F.expr(f"cast(((digest >> 32) + 2147483648L) * {total} >> 32 as int)")
    order = ["digest", "sha", "n_bytes"]
    runs = (
        rows.select(home.alias("home"), "digest", "sha", "n_bytes", "keep_id", "n")
        .sortWithinPartitions(*order)
        .mapInArrow(lean(_collapse), _RUN)
        .withColumn("at", F.spark_partition_id() % F.lit(total))
    )
    weight = total
    for radix in radices:
        weight //= radix
        digit = lambda c: F.floor(c / F.lit(weight)).cast("int") % F.lit(radix)  # noqa: E731, B023
        to = (F.col("at") + (digit(F.col("home")) - digit(F.col("at"))) * F.lit(weight)).cast("int")
        runs = (
            runs.withColumn("to", to)
            .repartitionById(total, "to")
            .drop("at", "to")
            .sortWithinPartitions(*order)
            .mapInArrow(lean(_collapse), _RUN)
            .withColumn("at", F.spark_partition_id())
        )
    return runs.drop("at", "home")


def mark_copies(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """All rows of ``docs`` (doc_id, text) with doc_id, keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the largest doc_id is kept. Rows that repeat a kept (doc_id, text) are
    all marked kept here; ``keep_one`` keeps one of them.
    """
    text = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.sha2(F.col("t").cast("binary"), 256).alias("sha"),
        F.xxhash64("t").alias("digest"),
        F.octet_length("t").cast("long").alias("n_bytes"),
    )
    groups = digest_groups(rows.select("digest", "sha", "n_bytes", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")), fan_in)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return salted_groups(rows, groups.where("n > 1"), ["digest", "sha", "n_bytes"], "doc_id").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept: the row with the largest doc_id."""
    text = normalised(F.col("text"))
    names = [f"_vf_{n}" for n in ("digest", "sha", "bytes")]
    keyed = docs.withColumns({names[0]: F.xxhash64(text), names[1]: F.sha2(text.cast("binary"), 256), names[2]: F.octet_length(text).cast("long")})
    rows = keyed.select(
        F.col(names[0]).alias("digest"), F.col(names[1]).alias("sha"), F.col(names[2]).alias("n_bytes"),
        F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("n"),
    )
    groups = digest_groups(rows, fan_in).select(F.col("digest").alias(names[0]), F.col("sha").alias(names[1]), F.col("n_bytes").alias(names[2]), F.col("keep_id").alias("_vf_keep"))
    # the id is part of the key: copies that go never meet their group, so no key is hot
    here = [F.col(f"k.{n}") == F.col(f"g.{n}") for n in names]
    kept = keyed.alias("k").join(groups.alias("g"), [*here, F.col("k.doc_id").cast("long").eqNullSafe(F.col("g._vf_keep"))], "left_semi")
    # only rows that repeat a whole (doc_id, text) can still be double
    return kept.dropDuplicates(["doc_id", *names]).select(*docs.columns)
