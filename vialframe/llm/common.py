"""Shared pieces: the cluster's shared folder, chunked Arrow reading and vectorised word hashing.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D. Words are
hashed straight from the UTF-8 buffer of a whole chunk of documents: a table
gives each byte a random 64-bit value, prefix sums of ``value * R**i`` (mod
2**64) give the polynomial hash of any slice, and a finaliser mixes it. The
same trick over word hashes gives every n-gram hash at once, so no Python code
runs per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes and documents handled at once by a Python worker (one longer document is its own chunk).
CHUNK_BYTES, CHUNK_DOCS = 1 << 20, 1024

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_C = 0xD6E8FEB86659FD93 | 1
_C_INV = pow(_C, -1, 1 << 64)


# ----------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on this machine."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        got = "file://" + tempfile.mkdtemp(prefix="vialframe-shared-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vialframe_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``materialise`` that no later plan reads."""
    path = getattr(df, "_vialframe_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


#: Parts into which the rows of a key are dealt where a group's values go back to its rows.
SALTS = 64
#: Tables of so many rows are joined without salts: one task could hold them even if all had one key.
PLAIN_ROWS = 1_000_000


def salted_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: str, n: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row per key) so that no key is hot.

    The rows of a key are dealt over ``SALTS`` parts by a hash of ``spread``; a group is first sent to the parts that its
    rows use, at most ``SALTS`` entries per key, and meets its rows there. ``n``: the number of rows, where it is known.
    """
    if n is not None and n <= PLAIN_ROWS:
        return rows.join(groups, keys, "left").select(*rows.columns, *[c for c in groups.columns if c not in keys])
    salted = rows.withColumn("_vf_salt", F.pmod(F.xxhash64(F.lit(7), spread), F.lit(SALTS)).cast("int"))
    used = salted.select(*keys, "_vf_salt").distinct()
    return salted.join(used.join(groups, keys), [*keys, "_vf_salt"], "left").drop("_vf_salt").select(*rows.columns, *[c for c in groups.columns if c not in keys])


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, n: int | None = None) -> DataFrame:
    """Inner join like ``salted_groups`` for a table with a few rows per key: no key of ``rows`` is hot."""
    if n is not None and n <= PLAIN_ROWS:
        return rows.join(table, keys)
    salted = rows.withColumn("_vf_salt", F.pmod(F.xxhash64(F.lit(7), spread), F.lit(SALTS)).cast("int"))
    used = salted.select(*keys, "_vf_salt").distinct()
    return salted.join(used.join(table, keys), [*keys, "_vf_salt"]).drop("_vf_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# --------------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
_FOLDED = _EXACT.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _EXACT[ord("a") : ord("z") + 1]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept per worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        seed = np.full(max(n, 1 << 16), base, np.uint64)
        seed[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(seed)
        if n > 4 * CHUNK_BYTES:  # a giant document must not pin its tables
            del _POWERS[base]
    return have[:n]


def _slices(values: np.ndarray, base: int, inverse: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[starts:ends] for many slices."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(inverse, len(values) + 1)[starts]


class Words:
    """Words of a chunk: hash per word, byte bounds per word, and bounds[d]:bounds[d+1] = words of document d.

    ``gaps``: for each byte whether it parts words; \\n must.
    """

    def __init__(self, texts: list[bytes], fold: bool = False, gaps: np.ndarray = _SEP):
        joined = b"\n".join(texts) + b"\n"
        self.buf = buf = np.frombuffer(joined, np.uint8)
        sep = gaps[buf]
        edge = np.flatnonzero(np.diff(sep, prepend=True))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.doc_at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        self.bounds = np.searchsorted(self.starts, self.doc_at)
        raw = _slices((_FOLDED if fold else _EXACT)[buf], _R, _R_INV, self.starts, self.ends)
        self.hash = mix(raw + (self.ends - self.starts).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        """Hash of the words i..i+width-1 for every i (those that cross documents are the caller's to drop)."""
        n = len(self.hash)
        at = np.arange(max(0, n - width + 1))
        return span_hash(self.hash, at, at + width)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of many slices of a sequence of 64-bit values; the length counts."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(_slices(values, _C, _C_INV, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(_R))


# ------------------------------------------------------------- worker's memory
#: What an operator keeps in a worker from task to task, by operator.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """The operator's store in this worker; what other operators keep is let go."""
    for other in [k for k in _KEPT if k != owner]:
        del _KEPT[other]
    return _KEPT.setdefault(owner, {})


def trim() -> None:
    """Give freed memory back to the system, and keep large arrays out of the heap (where glibc is)."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: fixed, else it grows to 32 MB and the heap fragments
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(run):
    """A batch function that leaves its worker as small as it found it: workers idle between tasks and add up."""

    def trimmed(batches: Iterable) -> Iterator:
        trim()
        yield from run(batches)
        trim()

    return trimmed


# ---------------------------------------------------------------- Arrow reading
def text_chunks(batches: Iterable, column: str = "text", owner: str = "", size: int = CHUNK_BYTES, docs: int = CHUNK_DOCS) -> Iterator:
    """Slices of the record batches with about ``size`` bytes of text each: (slice, list of UTF-8 bytes; null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kept(owner)
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        at = 0
        while at < len(sizes):
            end, held = at, 0
            while end < len(sizes) and (end == at or held + sizes[end] <= size and end - at < docs):
                held += sizes[end]
                end += 1
            yield batch.slice(at, end - at), [t or b"" for t in texts.slice(at, end - at).to_pylist()]
            at = end


class PieceCache:
    """Ids (little-endian u32 bytes) of text pieces; two generations, so at most about ``limit`` pieces are kept.

    ``encode(list of new pieces) -> list of bytes`` is asked for each piece that no generation holds.
    """

    STEP = 1 << 18

    def __init__(self, encode, limit: int):
        self.encode, self.limit, self.new, self.old = encode, limit // 2, {}, {}

    def clear(self) -> None:
        self.new, self.old = {}, {}

    def learn(self, lists: list) -> None:
        """Learn the pieces of many texts at once, so that ``encode`` sees large batches."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = {p for pieces in lists for p in pieces if p not in new}
        again = {p: old[p] for p in missing if p in old}
        if again:
            new.update(again)
            missing.difference_update(again)
        if missing:
            todo = list(missing)
            new.update(zip(todo, self.encode(todo), strict=True))

    def get(self, pieces: list) -> bytes:
        """The ids of one text; what ``learn`` has just seen is there."""
        try:
            return b"".join(map(self.new.__getitem__, pieces))
        except KeyError:  # a giant text may have pushed pieces out
            out = []
            for at in range(0, len(pieces), self.STEP):
                part = pieces[at : at + self.STEP]
                self.learn([part])
                out.append(b"".join(map(self.new.__getitem__, part)))
            return b"".join(out)
