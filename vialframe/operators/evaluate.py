"""Evaluation of runs against gold rows and against each other (AGG-13, JOIN-09/10/15, SRT-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

from ..functions.text import clean
from ..session import dealt, ship


def score_gold(gold: DataFrame, observations: DataFrame) -> DataFrame:
    """JOIN-09: each gold row with found, value_ok and code_ok; of observations with one name the last counts.

    gold: file, original_test_name, value, loinc_code, expect_status array; observations: file, row_idx and the like.
    """
    name = F.lower(strip(F.col("original_test_name")))
    last = Window.partitionBy("file", "k").orderBy(F.desc("row_idx"))
    seen = observations.withColumn("k", name).withColumn("_n", F.row_number().over(last)).where("_n = 1").select(
        "file", "k", F.lit(True).alias("hit"), F.col("value").alias("got_value"), F.col("loinc_code").alias("got_code"), F.col("mapping_status").alias("got_status")
    )
    joined = gold.withColumn("k", name).join(seen, ["file", "k"], "left")
    found = F.coalesce("hit", F.lit(False))
    code = F.when(F.col("loinc_code").isNull(), F.coalesce(F.array_contains("expect_status", F.col("got_status")), F.lit(False))).otherwise(F.coalesce(F.col("got_code") == F.col("loinc_code"), F.lit(False)))
    return joined.select(
        "file", "original_test_name", found.alias("found"), (found & F.coalesce(F.col("got_value") == F.col("value"), F.lit(False))).alias("value_ok"), (found & code).alias("code_ok")
    )


def accuracy(scored: DataFrame) -> DataFrame:
    """AGG-13: hit ratios per document and the unweighted mean over documents (file null)."""
    per = scored.groupBy("file").agg(F.avg(F.col("value_ok").cast("double")).alias("extraction"), F.avg(F.col("code_ok").cast("double")).alias("mapping"))
    macro = per.agg(F.avg("extraction").alias("extraction"), F.avg("mapping").alias("mapping")).select(F.lit(None).cast("string").alias("file"), "extraction", "mapping")
    return per.unionByName(macro).withColumns({c: F.round(c, 6) for c in ("extraction", "mapping")})


def agreement(base: DataFrame, new: DataFrame, rows: int | None = None) -> DataFrame:
    """JOIN-10: greedy one-to-one pairing of two runs' rows (file, row_idx, page, name, value, loinc), in the base's order.

    Rows pair on the same page with the same cleaned value if one name holds the other; a base row takes the first free
    row of the new run. Pages cannot share a row, so each is resolved for itself: its new rows wait in line by value and
    name, and a base row looks at the heads of the lines whose names fit. No pair is ever listed, so a value that a page
    repeats 10^5 times takes 10^5 steps. Nulls pair with nothing.
    """
    ship(base.sparkSession)
    form = lambda df, side: df.select(F.col("file"), F.col("page"), F.lit(side).alias("side"), F.col("row_idx").cast("long").alias("idx"), clean(F.col("value")).alias("v"), clean(F.col("name")).alias("name"), F.col("loinc").alias("code")).dropna(subset=["file", "page", "v", "name"])  # noqa: E731, E501
    shape = f"file {base.schema['file'].dataType.simpleString()}, page {base.schema['page'].dataType.simpleString()}, base_idx long, new_idx long, base_code string, new_code string"
    both = form(new, 0).unionByName(form(base, 1))
    both = both.repartition("file", "page") if rows is None else dealt(both, rows, "file", "page")
    return both.sortWithinPartitions("file", "page", "side", "idx").mapInArrow(_pair_up, shape)


def _pair_up(batches):
    """The pairs of pages that stream through in order, each page's new rows before its base rows; only the new rows of one page are held."""
    import pyarrow as pa

    page, lines, at, fits = None, {}, {}, {}
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for file, number, side, idx, v, name, code in zip(*[batch.column(c).to_pylist() for c in ("file", "page", "side", "idx", "v", "name", "code")], strict=True):
            if page != (file, number):
                page, lines, at, fits = (file, number), {}, {}, {}
            if side == 0:
                lines.setdefault(v, {}).setdefault(name, []).append((idx, code))
                continue
            here = lines.get(v)
            if not here:
                continue
            if (v, name) not in fits:
                fits[v, name] = [n for n in here if n in name or name in n]
            free = fits[v, name] = [n for n in fits[v, name] if at.get((v, n), 0) < len(here[n])]
            if free:
                taken = min(free, key=lambda n: here[n][at.get((v, n), 0)][0])
                place = at.get((v, taken), 0)
                at[v, taken] = place + 1
                for column, value in zip(out, (file, number, idx, here[taken][place][0], code, here[taken][place][1]), strict=True):
                    column.append(value)
        kinds = (batch.schema.field("file").type, batch.schema.field("page").type, pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["file", "page", "base_idx", "new_idx", "base_code", "new_code"])


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """JOIN-15, SRT-10: two benchmark runs (file, wall_s, processing_s) side by side, in file order."""
    b = new.select("file", F.col("wall_s").alias("new_wall_s"), F.col("processing_s").alias("new_processing_s"))
    return old.join(b, "file", "left").withColumn("speedup", F.round(F.col("wall_s") / F.nullif("new_wall_s", F.lit(0)), 3)).orderBy("file")
