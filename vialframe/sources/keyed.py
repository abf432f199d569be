"""Tables kept by key, whose upserts rewrite only what they touch (MUT-01..05, SRC-14, SRC-16).

Rows lie in a fixed number of parts by a hash of their key. An upsert joins its changes with the parts that they fall
into and writes those parts anew, as one Spark job into a folder of its own version. A pointer file that names the
version of every part is then renamed into place: until that moment readers see the old table, whatever has been written. Old versions stay
readable until ``vacuum``. Everything is plain parquet in folders; the driver handles numbers of parts, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove

PARTS = 64


class Conflict(Exception):
    """Another writer has committed since the table was read; the upsert can be tried again."""


class KeyedTable:
    """A table under ``path``; ``versions`` maps each part that has rows to the version that holds them."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state

    # ---- opening
    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: tuple[str, ...], parts: int = PARTS) -> KeyedTable:
        """A new table; keys must be unique in ``rows``."""
        empty = {"version": 0, "keys": list(keys), "parts": parts, "schema": json.loads(rows.schema.json()), "versions": {}}
        return cls(rows.sparkSession, path, empty).replace(rows)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> KeyedTable:
        """The newest committed version, or an older one."""
        fs, jvm = _fs(spark, path)
        found = [f.getPath() for f in fs.listStatus(jvm.Path(f"{path.rstrip('/')}/pointers"))]
        at = {int(p.getName()[:-5]): p for p in found if p.getName().endswith(".json")}
        stream = fs.open(at[max(at) if version is None else version])
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return cls(spark, path, json.loads(text))

    # ---- reading
    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows, or those of some parts: only their files are listed and opened."""
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(self.state["schema"])
        versions = {int(p): v for p, v in self.state["versions"].items()}
        paths = [f"{self.path}/data/version={v}/part={p}" for p, v in sorted(versions.items()) if only is None or p in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.state["keys"]), F.lit(self.state["parts"])).cast("int")

    # ---- writing
    def upsert(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> KeyedTable:
        """The table after ``changes``: ``merge`` makes the new rows of the touched parts from (their rows, the changes); by default a changed row takes the place of the old one.

        ``changes`` has the key columns; it is read twice (which parts, then the join).
        """
        touched = [r[0] for r in changes.select(self.part().alias("p")).distinct().collect()]  # at most as many as parts
        if not touched:
            return self
        keys = self.state["keys"]
        now = self.read(touched)
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
        default = lambda rows, new: rows.join(new, same(rows, new), "left_anti").unionByName(new.select(*rows.columns))
        return self._commit((merge or default)(now, changes), touched)

    def replace(self, rows: DataFrame) -> KeyedTable:
        """The table with other rows altogether."""
        return self._commit(rows, None)

    def _commit(self, rows: DataFrame, touched: list[int] | None) -> KeyedTable:
        version = self.state["version"] + 1
        folder = f"{self.path}/data/version={version}-{uuid.uuid4().hex[:8]}"
        columns = [f["name"] for f in self.state["schema"]["fields"]]
        dealt = rows.select(*columns, self.part().alias("part")).repartition("part")
        dealt.write.partitionBy("part").parquet(folder)
        fs, jvm = _fs(self.spark, self.path)
        name = folder.rsplit("version=", 1)[1]
        written = [f.getPath().getName()[5:] for f in fs.listStatus(jvm.Path(folder)) if f.getPath().getName().startswith("part=")]
        kept = {} if touched is None else {p: v for p, v in self.state["versions"].items() if int(p) not in touched}
        state = self.state | {"version": version, "versions": kept | dict.fromkeys(written, name)}
        pointer, draft = jvm.Path(f"{self.path}/pointers/{version}.json"), jvm.Path(f"{self.path}/pointers/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if fs.exists(pointer) or not fs.rename(draft, pointer):
            fs.delete(draft, False)
            remove(self.spark, folder)
            raise Conflict(f"version {version} of {self.path} was committed by another writer")
        return KeyedTable(self.spark, self.path, state)

    def vacuum(self) -> list[str]:
        """Delete the folders of parts that this version doesn't use, and older pointers; returns what went."""
        fs, jvm = _fs(self.spark, self.path)
        used = {f"version={v}/part={p}" for p, v in self.state["versions"].items()}
        gone = []
        for version in fs.listStatus(jvm.Path(f"{self.path}/data")):
            for part in fs.listStatus(version.getPath()):
                name = f"{version.getPath().getName()}/{part.getPath().getName()}"
                if part.getPath().getName().startswith("part=") and name not in used:
                    fs.delete(part.getPath(), True)
                    gone.append(name)
        for pointer in fs.listStatus(jvm.Path(f"{self.path}/pointers")):
            name = pointer.getPath().getName()
            if name.endswith(".json") and int(name[:-5]) < self.state["version"]:
                fs.delete(pointer.getPath(), False)
        return gone


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def remember(table: KeyedTable, picks: DataFrame, source: str, confidence: float | None) -> KeyedTable:
    """MUT-05: remembered picks (key, loinc_num, source, confidence) after an upsert; a model's pick never replaces a reviewer's."""
    from ..functions.text import make_key
    from ..operators import mapping

    keyed = picks.withColumn("key", make_key(F.col("name"), F.col("specimen"), F.col("unit")))
    return table.upsert(keyed, lambda rows, new: mapping.remember(rows, new.drop("key"), source, confidence))


def apply_events(table: KeyedTable, events: DataFrame) -> KeyedTable:
    """MUT-01..03: rows after their change events, each folded once: the next events start from what these have made."""
    from ..operators import store

    return table.upsert(events, lambda rows, new: store.current_rows(rows, store.accepted_events(new)))
