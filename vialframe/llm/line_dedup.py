"""Operator 11: line deduplication against levelled sorted runs of line hashes.

A *run* is a table of (h1, h2, owner): line keys by 128 bits of xxhash64 and the
smallest doc_id that holds them, dealt into buckets by the hash and sorted within
them. A new batch of documents is pre-aggregated to one row per key, shuffled once
into the same buckets and merged with the runs, one after the other, reading them in place
(no shuffle, no sort); what no run holds becomes the batch's own run of level 0. ``FANOUT``
runs of a level are compacted to one of the next, bucket by bucket, so a key is
rewritten once a level and a batch meets few runs. Batches come in ascending doc_id,
so the first batch that holds a key also holds its smallest document.

A line goes if its key has an owner that is another document. (key, document)
is unique but for repeats inside a document, so that join has no hot key however common a line is.

Words of the contract: a key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased; keys
of under ``MIN_CHARS`` code points are never dropped.

Defined cases: null and empty texts are one empty line; rows of one doc_id are one document, so what they share
stays in all of them; rows with a null doc_id are one document that comes last; equal rows get equal results;
a very long text is one row, its lines are rows of their own and the numbers of those to drop meet again by document; an empty table gives no
rows; all columns of the input are handed on, and those that the operator adds can be named.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, shared_dir, shuffle_partitions
from .exact_dedup import normalised

#: Lines shorter than this (code points of the key) are left alone.
MIN_CHARS = 10
#: Batches of a table that is deduplicated at once, and runs of a level before they become one of the next.
BATCHES, FANOUT = 4, 3
#: Hashes don't compress, and a codec holds native buffers for every file and column.
_PLAIN = {"compression": "uncompressed"}
_BLANK = " \t\n\v\f\r"
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, text_id, pos): the lines of ``docs`` that are long enough, by hash, with the number of the line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_id(text).alias("text_id"), F.posexplode(F.split(normalised(text), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_id", "pos", F.btrim("line", F.lit(_BLANK)).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"), "doc_id", "text_id", "pos")


def _text_id(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text)


class LineRuns:
    """The runs that later batches are compared with; ``add`` takes batches, ``owners`` gives every key's first document."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.name = f"vf_line_runs_{uuid.uuid4().hex}"
        self.made = 0

    def _ordered(self, do):
        """The files of a bucket are sorted, one for each run: Spark is told so while ``do`` plans and runs."""
        was = self.spark.conf.get(_ORDERED, "false")
        self.spark.conf.set(_ORDERED, "true")
        try:
            return do()
        finally:
            self.spark.conf.set(_ORDERED, was)

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        out = rows.write.format("parquet").options(**_PLAIN).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        out.option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Compare a batch (h1, h2, doc_id) with the runs and add its new keys as a run; returns them as (h1, h2, owner).

        A left join that finds nothing, not Spark's anti-join: that one would be pushed below the aggregation, and all
        rows of a common line would be shuffled.
        """

        def run() -> str:
            new = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
            for name in self.runs():
                seen = self.spark.table(name).select("h1", "h2", F.lit(True).alias("_seen")).hint("merge")
                new = new.hint("merge").join(seen, ["h1", "h2"], "left").where("_seen IS NULL").drop("_seen")
            return self._write(new)

        name = self._ordered(run)
        self.levels[0].append(name)
        new = self.spark.table(name)
        self._compact()
        return new

    def _compact(self) -> None:
        """``fanout`` runs of a level become one of the next; their keys differ, and buckets meet where they lie."""
        at = 0
        while len(self.levels[at]) >= self.fanout:
            old = self.levels[at]
            union = self.spark.table(old[0])
            for name in old[1:]:
                union = union.union(self.spark.table(name))
            merged = union.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
            name = self._ordered(lambda rows=merged: self._write(rows))
            self.levels[at] = []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(name)
            for x in old:
                self._drop(x)
            at += 1

    def owners(self) -> DataFrame:
        """(h1, h2, owner) of all keys."""
        out = None
        for name in self.runs():
            out = self.spark.table(name) if out is None else out.union(self.spark.table(name))
        return self.spark.createDataFrame([], "h1 long, h2 long, owner long") if out is None else out

    def close(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels = [[]]


def dropped_lines(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """(doc_id, text_id, gone): the numbers of the lines whose key is owned by another document."""
    own = [F.col("l.h1") == F.col("o.h1"), F.col("l.h2") == F.col("o.h2"), F.col("l.doc_id").eqNullSafe(F.col("o.owner"))]
    lost = lines.alias("l").join(owners.alias("o"), own, "left_anti")
    return lost.groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("gone"))


def without_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with ``names``: the text without the lines in ``gone``, its lines before, and those dropped."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumn("_vf_text_id", _text_id(text)).alias("d")
    here = [F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("g.doc_id")), F.col("d._vf_text_id") == F.col("g.text_id")]
    both = marked.join(gone.select("doc_id", "text_id", F.col("gone").alias("_vf_gone")).alias("g"), here, "left").select(*[F.col(f"d.{c}") for c in docs.columns], "_vf_gone")
    lines = F.split(text, "\n", -1)
    # set difference, then a look-up by number: linear in the lines, however many of them go
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_vf_lines") - 1), "_vf_gone"))
    kept = F.when(F.col("_vf_gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.col("_vf_lines")[i]), "\n"))
    out = both.withColumn("_vf_lines", lines).withColumns({names[0]: kept, names[1]: F.size("_vf_lines").cast("long"), names[2]: F.coalesce(F.size("_vf_gone"), F.lit(0)).cast("long")})
    return out.select(*[c for c in docs.columns if c not in names], *names)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with every line that an earlier document has taken out; columns ``names`` are added (and replace namesakes).

    The table is cut into ``batches`` of ascending doc_id by approximate quantiles (any cut gives the same result).
    """
    spark = docs.sparkSession
    where = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    cuts = sorted(set(where.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)))
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("doc_id") > int(cut)).cast("int")
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows = line_rows(docs, id_col, text_col, min_chars)
    rows.withColumn("batch", F.coalesce(batch, F.lit(len(cuts)))).write.options(**_PLAIN).partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, batch int").parquet(path)
    lines._vialframe_path = path
    runs = LineRuns(spark, fanout=fanout)
    for at in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == at))
    gone = materialise(dropped_lines(lines.drop("batch"), runs.owners()), "dropped-lines")
    runs.close()
    discard(lines)
    return without_lines(docs, gone, id_col, text_col, names)
