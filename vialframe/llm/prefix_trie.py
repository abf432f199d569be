"""Operator 12: the prefix trie of conversations by an LCP-aware external mergesort.

A conversation becomes a path: 16 bytes of SHA-256 for each turn's (role, text), so paths compare by bytes and two
share as many turns as their common prefix has whole digests. (Any total order of the turns gives the same trie.)

1. Every task sorts what it reads in runs of bounded size; a row carries its LCP, the number of turns shared with
   the row before it in the run.
2. The runs are cut at common ranges of (path, conv_id), so copies of a conversation are split as well as
   prefixes, and the pieces of a range meet in one task, which merges them with a loser tree. Two heads whose LCPs with the last winner
   differ are decided by those alone; turns are compared only from equal LCPs on, and never twice.
3. The merged stream, each row with its LCP, walks a stack of open nodes. A row closes the nodes deeper than its LCP; a closed
   node is finished and emitted, its sums go to its parent.

Nodes on the first or last path of a range may go on in a neighbour: they are emitted in part and put together by
their prefix (at most two paths a range). Only there the ids of ended conversations travel, in chunks of
``CHUNK_IDS``, already in order, and are hashed as a stream.

Defined cases: null role or text count as empty; a null turn comes first and equal turns of a conversation are ordered by role and
digest of the text; repeated rows are turns of their own; rows with a null conv_id are one conversation without a donor,
kept whole, that counts as a member, has no number and comes last; a very long text is only hashed and counted; a conversation's digests (20 bytes a turn) are one
row; other columns are not read; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, lean, materialise, salted_groups, shuffle_partitions

#: Bytes of a turn's digest.
TURN = 16
#: Conversations, and bytes of their paths, of a run.
RUN_ROWS, RUN_BYTES = 1 << 16, 32 << 20
#: Bytes of paths in a range, at most, on average.
RANGE_BYTES = 64 << 20
#: Ids of ended conversations in one row.
CHUNK_IDS = 1 << 16
#: Rows of an Arrow batch that is handed on.
OUT_ROWS = 1 << 13
#: A conversation shares turns with the first of its block, as many as a hash of its id says.
BLOCK, SHARES = 20, 4
_EMPTY = hashlib.sha256(b"").hexdigest()


# -------------------------------------------------------------------- paths
def own_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of (digest hex, words) per conversation, in order. Texts are digested before they are shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    turn = F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), words.alias("words"))
    got = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return got.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt_paths(turns: DataFrame, block: int = BLOCK, shares: int = SHARES) -> DataFrame:
    """(conv_id, path, words): the first h turns of the block's first conversation, then the conversation's own after its first h."""
    c = F.col("conv_id")
    own = turns.withColumns({"h": F.coalesce(F.crc32(c.cast("string").cast("binary")) % shares, F.lit(0)).cast("int"), "donor": c - c % block})
    donors = turns.select(F.col("conv_id").alias("donor"), F.slice("turns", 1, shares - 1).alias("lent"))
    both = own.join(donors, "donor", "left")
    lent = F.when(F.col("h") > 0, F.slice(F.coalesce("lent", F.array().cast(turns.schema["turns"].dataType)), 1, F.col("h"))).otherwise(F.array().cast(turns.schema["turns"].dataType))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    whole = both.select("conv_id", F.concat(lent, rest).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("path"), F.transform("t", lambda t: t["words"].cast("int")).alias("words"))


# ------------------------------------------------------------- runs and merging
class Head(NamedTuple):
    """A row of a run: its path, id and number of words per turn. Rows without an id come last."""

    path: bytes
    nameless: bool
    conv_id: int
    words: list


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths share, of which ``known`` are known to be equal."""
    most = min(len(a), len(b)) // TURN
    if a[known * TURN : most * TURN] == b[known * TURN : most * TURN]:
        return most
    low, high = known, most - 1  # the first unequal turn is in [low, high]
    while low < high:
        mid = (low + high) // 2
        if a[low * TURN : (mid + 1) * TURN] == b[low * TURN : (mid + 1) * TURN]:
            low = mid + 1
        else:
            high = mid
    return low


def sorted_run(rows: list[Head]) -> tuple[list[Head], list[int]]:
    """The rows in order, and the turns that each shares with the one before it."""
    rows.sort(key=lambda h: h[:3])
    return rows, [0, *(shared_turns(a.path, b.path) for a, b in zip(rows, rows[1:], strict=False))][: len(rows)]


def merge_runs(runs: list[Iterator[tuple[Head, int]]]) -> Iterator[tuple[Head, int]]:
    """Loser tree over sorted runs of (row, LCP within the run): the rows in order, each with its LCP with the row before it.

    A head's LCP is always the one with the last winner: where a run advances, that winner came from the same run, so the run's
    own LCP is the right one; a loser keeps the LCP with the winner that beat it.
    """
    heads: list[Head | None] = []
    lcps: list[int] = []
    for run in runs:
        head = next(run, None)
        heads.append(None if head is None else head[0])
        lcps.append(0)

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; the loser learns its LCP with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if lcps[a] != lcps[b]:
            return lcps[a] > lcps[b]
        same = shared_turns(x.path, y.path, lcps[a])
        first = (x.path[same * TURN : (same + 1) * TURN], x.nameless, x.conv_id, a) < (y.path[same * TURN : (same + 1) * TURN], y.nameless, y.conv_id, b)
        lcps[b if first else a] = same
        return first

    k = len(runs)
    if not k:
        return
    size = 1
    while size < k:
        size *= 2
    heads += [None] * (size - k)
    lcps += [0] * (size - k)
    losers, winners = [0] * size, [0] * (2 * size)
    for i in range(size):
        winners[size + i] = i
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        won = beats(a, b)
        winners[node], losers[node] = (a, b) if won else (b, a)
    top = winners[1]
    while heads[top] is not None:
        yield heads[top], lcps[top]
        following = next(runs[top], None)
        heads[top], lcps[top] = (None, 0) if following is None else following
        node = (size + top) // 2
        while node:
            if not beats(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2


# ------------------------------------------------------------------- open nodes
#: A finished node; one that may go on in the next range; ids of conversations that end in such a node.
NODE, PART, ENDS = "node", "part", "ends"
NODE_SHAPE = "kind string, key binary, ancestors array<binary>, parent_key binary, conv_id long, depth long, words long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary, first_end long"


class Open:
    """A node whose members are not all seen: its counts so far, the ids that end in it, and its finished children."""

    __slots__ = ("border", "children", "conv_id", "done", "ends", "leaves", "n", "saved", "words")

    def __init__(self, words: int, border: bool):
        self.words, self.border, self.conv_id, self.n, self.children, self.leaves, self.saved = words, border, None, 0, 0, 0, 0
        self.ends, self.done = [], []


def prefix_key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: depth * TURN]).digest()[:TURN]


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def walk(rows: Iterable[tuple[Head, int]]) -> Iterator[tuple]:
    """Rows of NODE_SHAPE from a sorted stream of (row, LCP), by a stack of open nodes.

    Nodes on the stream's first and last path are border nodes, given out as parts. Finished children of a border node
    name it by parent_key, as its smallest member isn't known here; those of another node have its conv_id.
    """
    stack: list[Open] = []
    path = b""

    def children(node: Open, depth: int) -> Iterator[tuple]:
        border = node.border
        key, conv_id = (prefix_key(path, depth), None) if border else (None, node.conv_id)
        for child in node.done:
            yield (NODE, None, None, key, *child[:3], conv_id, *child[3:], None, None)
        node.done = []

    def ids(node: Open, depth: int) -> Iterator[tuple]:
        for at in range(0, len(node.ends), CHUNK_IDS):
            some = node.ends[at : at + CHUNK_IDS]
            yield (ENDS, prefix_key(path, depth), None, None, None, depth, *[None] * 7, _joined(some), some[0])
        node.ends = []

    def close(depth: int) -> Iterator[tuple]:
        """Close the nodes deeper than ``depth``."""
        while len(stack) - 1 > depth:
            node = stack.pop()
            at = len(stack)
            yield from children(node, at)
            if stack:
                parent = stack[-1]
                parent.n += node.n
                if node.conv_id is not None and (parent.conv_id is None or node.conv_id < parent.conv_id):
                    parent.conv_id = node.conv_id
            if node.border:
                yield from ids(node, at)
                keys = [prefix_key(path, d) for d in range(at + 1)]
                yield (PART, keys[-1], keys, keys[-2] if at else None, node.conv_id, at, node.words, None, node.n, node.children, node.leaves, node.saved, None, None, None)
                continue
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.words
            parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + node.leaves, parent.saved + node.saved
            ends = hashlib.sha256(_joined(node.ends)).hexdigest() if node.ends else _EMPTY
            parent.done.append((node.conv_id, at, node.words, node.n, node.children, node.leaves, node.saved, ends))
            if parent.border and len(parent.done) >= OUT_ROWS:
                yield from children(parent, at - 1)

    for head, lcp in rows:
        yield from close(lcp)
        first = not stack
        if first:
            stack.append(Open(0, True))
        for depth in range(len(stack), len(head.path) // TURN + 1):
            stack.append(Open(head.words[depth - 1], first))
        path, end = head.path, stack[-1]
        end.n += 1
        if not head.nameless:
            end.conv_id = head.conv_id if end.conv_id is None else min(end.conv_id, head.conv_id)
            end.ends.append(head.conv_id)
            if end.border and len(end.ends) >= CHUNK_IDS:
                yield from ids(end, len(stack) - 1)
    for node in stack:
        node.border = True
    yield from close(-1)


# ----------------------------------------------------------------- Spark's side
_RUN_SHAPE = "run long, seq long, lcp int, path binary, nameless boolean, conv_id long, words array<int>"


def _arrow_batches(rows: Iterable[tuple], names: list[str], kinds: list) -> Iterator:
    import pyarrow as pa

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _shape(text: str) -> tuple[list[str], list]:
    import pyarrow as pa

    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}
    names, of = zip(*[x.split() for x in text.split(", ")], strict=True)
    return list(names), [kinds[k] for k in of]


def _heads(batch) -> Iterator[Head]:
    columns = [batch.column(c).to_pylist() for c in ("path", "conv_id", "words")]
    for path, conv_id, words in zip(*columns, strict=True):
        yield Head(path, conv_id is None, conv_id or 0, words)


def _sort_runs(batches: Iterable) -> Iterator:
    """Sorted runs of what the task reads, each row with its LCP; a run is known by its task and number."""
    from pyspark import TaskContext

    names, kinds = _shape(_RUN_SHAPE)
    base = TaskContext.get().partitionId() << 32
    held, size, made = [], 0, 0

    def run() -> Iterator[tuple]:
        for seq, (h, lcp) in enumerate(zip(*sorted_run(held), strict=True)):
            yield (base + made, seq, lcp, h.path, h.nameless, h.conv_id, h.words)

    for batch in batches:
        for head in _heads(batch):
            held.append(head)
            size += len(head.path)
            if len(held) >= RUN_ROWS or size >= RUN_BYTES:
                yield from _arrow_batches(run(), names, kinds)
                held, size, made = [], 0, made + 1
    if held:
        yield from _arrow_batches(run(), names, kinds)


def _merge_range(batches: Iterable) -> Iterator:
    """A range's pieces of runs, in order of run and place, to its nodes."""
    names, kinds = _shape(NODE_SHAPE)
    runs: dict[int, list[tuple[Head, int]]] = {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("run", "lcp", "path", "nameless", "conv_id", "words")]
        for run, lcp, path, nameless, conv_id, words in zip(*columns, strict=True):
            runs.setdefault(run, []).append((Head(path, nameless, conv_id, words), lcp))
    yield from _arrow_batches(walk(merge_runs([iter(r) for r in runs.values()])), names, kinds)


def _hash_ends(batches: Iterable) -> Iterator:
    """The digest of each key's chunks, which come in order: only a hash is held."""
    import pyarrow as pa

    key, digest = None, None
    for batch in batches:
        out = []
        for k, chunk in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k == key:
                digest.update(b"," + chunk)
                continue
            if key is not None:
                out.append((key, digest.hexdigest()))
            key, digest = k, hashlib.sha256(chunk)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "ends_sha256"])


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_nodes(paths: DataFrame, range_bytes: int = RANGE_BYTES, ranges: int | None = None) -> DataFrame:
    """All nodes (COLUMNS) of the trie of ``paths`` (conv_id, path, words)."""
    spark = paths.sparkSession
    ship(spark)
    runs = materialise(paths.select("conv_id", "path", "words").mapInArrow(lean(_sort_runs), _RUN_SHAPE), "trie-runs")
    if not ranges:
        size = runs.agg(F.sum(F.octet_length("path") + 64)).first()[0] or 0
        ranges = max(shuffle_partitions(spark), -(-size // range_bytes))
    dealt = runs.repartitionByRange(ranges, "path", "nameless", "conv_id").sortWithinPartitions("run", "seq")
    found = materialise(dealt.mapInArrow(lean(_merge_range), NODE_SHAPE), "trie-nodes")
    border = materialise(_border_nodes(found.where(F.col("kind") == PART), found.where(F.col("kind") == ENDS)), "trie-border")
    discard(runs)
    nodes = found.where(F.col("kind") == NODE)
    named = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    below = salted_groups(nodes.where("parent_key IS NOT NULL").drop("parent_conv_id"), named, ["parent_key"], "conv_id").withColumnRenamed("_parent", "parent_conv_id")
    ends = salted_groups(border, named, ["parent_key"], "conv_id").withColumnRenamed("_parent", "parent_conv_id")
    return nodes.where("parent_key IS NULL").select(*COLUMNS).unionByName(below.select(*COLUMNS)).unionByName(ends.select(*COLUMNS))


def _border_nodes(parts: DataFrame, ends: DataFrame) -> DataFrame:
    """Border nodes put together by key; what they add to subtrees goes to every node above them."""
    whole = parts.groupBy("key").agg(
        F.any_value("ancestors").alias("ancestors"), F.any_value("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), F.any_value("words").alias("words"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    children = whole.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("_more"))
    whole = whole.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0).cast("long"))).drop("_more")
    own = whole.select(F.explode("ancestors").alias("key"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("l"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("s"))
    sums = own.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    hashed = ends.select("key", "first_end", "ends").repartition("key").sortWithinPartitions("key", "first_end").mapInArrow(lean(_hash_ends), "key binary, ends_sha256 string")
    out = whole.drop("n_leaves", "saved_tokens", "ancestors").join(sums, "key").join(hashed, "key", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))


def conversation_trie(rows: DataFrame, range_bytes: int = RANGE_BYTES, ranges: int | None = None) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text)."""
    return trie_nodes(rebuilt_paths(own_turns(rows)), range_bytes, ranges)
