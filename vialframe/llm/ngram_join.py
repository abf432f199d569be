"""Operator 6: n-gram Jaccard self-join by vertical partitioning, and the classes of its links.

The global n-gram order is cut into fragments by hash range; a document's set
is cut into segments along them. Everything that needs the corpus happens per
fragment:

1. *Frequencies.* Segments of a whole chunk of documents travel packed (six
   bytes an n-gram). A fragment sees all occurrences of its n-grams, so it knows
   exactly which occur in several different sets. Only those go on: an n-gram of
   one set can't be shared. Documents with equal sets are one record from the
   start (the key is a digest of the set), so copies are never expanded.
2. *Candidates.* In the global order (rarest first) two sets with Jaccard >= t
   share an n-gram of their prefixes, ``n - ceil(t n) + 1`` n-grams each. N-grams
   of one set fill the prefix first; a record whose prefix they fill has no link
   and leaves. The rest is an inverted index with the length and position bounds.
3. *Partial overlaps.* For a candidate pair each fragment's overlap is counted
   separately and the counts are summed per pair; the sum decides exactly.

A bucket of the index with many members does not emit its pairs: star rounds
test its members against one leader, links contract into classes, and once the
pairs between different classes are few they are all tested. So a group of near
copies costs a few tests per member, and every pair that is never tested lies
inside one class already: no link is lost. If stars don't help, all remaining
pairs are tested.

Defined cases: a null text, or one without words, has an empty set, links with
nothing and is its own class; with fewer than ``width`` words the whole sequence
is the one n-gram; rows with equal sets are one class; a null doc_id takes the
class's smallest id; texts of any length are read whole; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import PLAIN_ROWS, SALTS, Words, discard, lean, materialise, mix, salted_groups, salted_join, shuffle_partitions, span_hash, text_chunks
from .graph import components

WIDTH = 5
THRESHOLD = 80  # per cent
#: Fragments in which the partial overlaps of a pair are counted.
PARTS = 4
#: Star rounds at most, and the pairs up to which all that remain are simply tested.
STAR_ROUNDS, FEW_PAIRS = 8, 100_000
#: Pairs per index row up to which the same holds: at first, and once a star round has contracted the groups of near
#: copies. What is left then are pairs that share common n-grams; the bounds rule nearly all out inside the join.
PAIRS_A_ROW = (2, 32)


# ---------------------------------------------------------------- sets of a chunk
def chunk_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of all documents one after the other, set size per document, 64-bit set key)."""
    words = Words(texts, fold=True)
    grams = words.grams(width)
    sets, sizes, keys = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64)
    for d, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = span_hash(words.hash, np.array([a]), np.array([b]))
        else:
            continue
        sets.append(own)
        sizes[d] = len(own)
        keys[d] = mix(own).sum(dtype=np.uint64)
    keys ^= mix(sizes.astype(np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes, keys


def _set_keys(width: int) -> Callable[[Iterable], Iterator]:
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch, texts in text_chunks(batches):
            _, sizes, keys = chunk_sets(texts, width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys.view(np.int64)), pa.array(sizes)], ["doc_id", "text_hash", "key", "n"]
            )

    return run


def set_keys(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash (xxhash64), key (digest of the n-gram set), n (its size) per row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(lean(_set_keys(width)), "doc_id long, text_hash long, key long, n long")


# ------------------------------------------------------------------ fragments
def _rows_of(order: np.ndarray, cell: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, positions) for each run of equal cells of a sorted permutation."""
    if len(order):
        sorted_cells = cell[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(sorted_cells)) + 1, [len(order)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(sorted_cells[a]), order[a:b]


def _segments(width: int, fragments: int) -> Callable[[Iterable], Iterator]:
    """Documents to one packed row per chunk and fragment."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["fragment", "keys", "sizes", "counts", "low", "high"]
        for _, texts in text_chunks(batches):
            grams, sizes, keys = chunk_sets(texts, width)
            _, first = np.unique(keys, return_index=True)
            once = np.zeros(len(keys), bool)
            once[first] = True
            once &= sizes > 0
            owner = np.repeat(np.arange(len(sizes)), sizes)
            wanted = once[owner]
            grams, owner = grams[wanted], owner[wanted]
            # the top bits choose the fragment, the next 48 name the n-gram inside it
            cell = ((grams >> np.uint64(40)) * np.uint64(fragments) >> np.uint64(24)).astype(np.int64)
            rows: list[list] = [[] for _ in names]
            for f, at in _rows_of(np.argsort(cell, kind="stable"), cell):
                own, g = owner[at], grams[at]
                starts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
                docs = own[starts]
                counts = np.diff(np.concatenate((starts, [len(own)])))
                values = (f, keys[docs], sizes[docs].astype("<u4"), counts.astype("<u4"), g.astype("<u4"), (g >> np.uint64(32)).astype("<u2"))
                for r, v in zip(rows, values, strict=True):
                    r.append(v if isinstance(v, int) else v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names)

    return run


def _join_binary(parts: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _shared(fragments: int, homes: int) -> Callable[[Iterable], Iterator]:
    """All segments of a partition's fragments to the n-grams that several sets hold, packed by the sets' home."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        cols: list[list] = [[] for _ in range(6)]
        for batch in batches:
            for c, name in zip(cols, ("fragment", "keys", "sizes", "counts", "low", "high"), strict=True):
                c.extend(batch.column(name).to_pylist())
        if not cols[0]:
            return
        per_row = [len(x) // 4 for x in cols[4]]
        keys, sizes, counts = _join_binary(cols[1], "<u8"), _join_binary(cols[2], "<u4"), _join_binary(cols[3], "<u4")
        gram = _join_binary(cols[4], "<u4").astype(np.uint64) | _join_binary(cols[5], "<u2").astype(np.uint64) << np.uint64(32)
        # the fragment is part of the name
        frag = np.repeat(np.array(cols[0], np.uint64), per_row)
        gram |= frag << np.uint64(48)
        del cols, frag
        key, size = np.repeat(keys, counts), np.repeat(sizes, counts)
        order = np.lexsort((key, gram))
        gram, key, size = gram[order], key[order], size[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
        gram, key, size = gram[fresh], key[fresh], size[fresh]
        head = np.concatenate(([True], gram[1:] != gram[:-1]))
        df = np.diff(np.concatenate((np.flatnonzero(head), [len(gram)])))
        df = np.repeat(df, df)
        several = df > 1
        gram, key, size, df = gram[several], key[several], size[several], np.minimum(df[several], 65535)
        home = (key >> np.uint64(32)) * np.uint64(homes) >> np.uint64(32)
        home = home.astype(np.int64)
        order = np.lexsort((key, home))
        rows: list[list] = [[] for _ in range(6)]
        for h, at in _rows_of(order, home):
            own = key[at]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
            counts = np.diff(np.concatenate((starts, [len(own)])))
            values = (own[starts], size[at][starts].astype("<u4"), counts.astype("<u4"), gram[at].astype("<u8"), df[at].astype("<u2"))
            rows[0].append(h)
            for r, v in zip(rows[1:], values, strict=True):
                r.append(v.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], ["home", "keys", "sizes", "counts", "grams", "dfs"]
        )

    return run


def _least_overlap(n: np.ndarray, threshold: int) -> np.ndarray:
    return -(-n * threshold // 100)


def _records(threshold: int) -> Callable[[Iterable], Iterator]:
    """Shared n-grams of a partition's sets to records: prefix and full list of those that may have a link."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        cols: list[list] = [[] for _ in range(5)]
        for batch in batches:
            for c, name in zip(cols, ("keys", "sizes", "counts", "grams", "dfs"), strict=True):
                c.extend(batch.column(name).to_pylist())
        keys, sizes, counts = _join_binary(cols[0], "<u8"), _join_binary(cols[1], "<u4").astype(np.int64), _join_binary(cols[2], "<u4")
        gram, df = _join_binary(cols[3], "<u8"), _join_binary(cols[4], "<u2")
        if not len(gram):
            return
        del cols
        key = np.repeat(keys, counts)
        n_of = np.repeat(sizes, counts)
        order = np.lexsort((gram, df, key))
        key, gram, df, n_of = key[order], gram[order], df[order], n_of[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        out: list[list] = [[] for _ in range(5)]
        names = ["key", "n", "prefix", "grams", "score"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int64())])), pa.list_(pa.int64()), pa.float64()]
        held = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n, shared = int(n_of[a]), b - a
            alone = n - shared
            prefix = n - int(_least_overlap(np.int64(n), threshold)) + 1
            if alone >= prefix:
                continue
            take = min(prefix - alone, shared)
            g = gram[a:b].view(np.int64).tolist()
            values = (
                int(key[a].view(np.int64)), n, [{"gram": x, "pos": alone + i} for i, x in enumerate(g[:take])], g,
                float(np.log2(df[a:b].astype(np.float64)).sum() / n),
            )
            for c, v in zip(out, values, strict=True):
                c.append(v)
            held += shared
            if held > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                out, held = [[] for _ in range(5)], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def linkable_records(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """key, n, prefix array<struct<gram,pos>>, grams array<long>, score: the distinct sets that may have a link."""
    ship(docs.sparkSession)
    parts = shuffle_partitions(docs.sparkSession)
    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        lean(_segments(width, parts)), "fragment int, keys binary, sizes binary, counts binary, low binary, high binary"
    )
    shared = packed.repartitionById(parts, "fragment").mapInArrow(
        lean(_shared(parts, parts)), "home int, keys binary, sizes binary, counts binary, grams binary, dfs binary"
    )
    return shared.repartitionById(parts, "home").mapInArrow(
        lean(_records(threshold)), "key long, n long, prefix array<struct<gram:long,pos:long>>, grams array<long>, score double"
    )


# ---------------------------------------------------------------------- pairs
def _fits(threshold: int, na: str, nb: str, pa: str, pb: str) -> str:
    """Length and position bounds: the overlap still possible from these positions reaches what the threshold needs."""
    return f"(100 + {threshold}) * least({na} - {pa}, {nb} - {pb}) >= {threshold} * ({na} + {nb})"


def verified(pairs: DataFrame, parts: DataFrame, threshold: int = THRESHOLD, n: int | None = None) -> DataFrame:
    """The pairs (a, b, na, nb) whose partial overlaps add up to the threshold, with the overlap."""
    left = parts.select(F.col("key").alias("a"), "part", F.col("grams").alias("ga"))
    right = parts.select(F.col("key").alias("b"), "part", F.col("grams").alias("gb"))
    # a star's leader is in many pairs: they are dealt by the other set
    counted = salted_join(salted_join(pairs, left, ["a"], "b", n), right, ["b", "part"], "a", n).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("o"))
    total = counted.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("overlap"))
    return total.where(f"100 * overlap >= {threshold} * (na + nb - overlap)")


def _untested(now: DataFrame, grouped: bool) -> tuple[float, int, list[int]]:
    """(pairs, rows, hot) of an index: pairs of different classes that share an n-gram and whose sizes are in the same or
    in neighbouring bands; the rows; and the n-grams that more than ``PLAIN_ROWS`` rows of one band hold.

    ``grouped``: some rows are of the same class (``root``); else every row is a class of its own.
    """
    by_gram = Window.partitionBy("gram").orderBy("band")
    near = lambda what, w: F.when(F.lag("band").over(w) == F.col("band") - 1, F.lag(what).over(w)).otherwise(0)
    if grouped:
        by_class = Window.partitionBy("gram", "root").orderBy("band")
        per_class = now.groupBy("gram", "root", "band").agg(F.count(F.lit(1)).alias("c")).withColumn("before", near("c", by_class))
        per_band = per_class.groupBy("gram", "band").agg(
            F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"), F.sum(F.col("c") * F.col("before")).alias("x")
        )
    else:
        per_band = now.groupBy("gram", "band").agg(F.count(F.lit(1)).alias("m")).withColumns({"s": F.col("m"), "x": F.lit(0)})
    per_band = per_band.withColumn("before", near("m", by_gram))
    m, pairs = F.col("m"), F.sum((F.col("m") * F.col("m") - F.col("s")) / 2 + F.col("m") * F.col("before") - F.col("x"))
    got = per_band.agg(F.coalesce(pairs, F.lit(0.0)), F.coalesce(F.sum(m), F.lit(0)), F.collect_set(F.when(m > PLAIN_ROWS, F.col("gram")))).first()
    return got[0], got[1], got[2]


def _dealt_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: list[int], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row per key, its key ``gram`` among them: rows of hot n-grams are dealt by salts."""
    if not hot:
        return rows.join(table, keys, how)
    is_hot = F.col("gram").isin(hot)
    salted = rows.withColumn("_vf_salt", F.when(is_hot, F.pmod(F.xxhash64(F.lit(7), *[c for c in rows.columns if c.startswith("key")]), F.lit(SALTS))).otherwise(F.lit(0)))
    dealt = table.withColumn("_vf_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return salted.join(dealt, [*keys, "_vf_salt"], how).drop("_vf_salt")


def link_sets(records: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, root): the class of each record in the graph of their links."""
    split = f"transform(sequence(0, {PARTS - 1}), p -> struct(p AS part, filter(grams, g -> pmod(g, {PARTS}) = p) AS grams))"
    parts = records.select("key", F.explode(F.expr(split)).alias("x")).select("key", "x.part", "x.grams").where("size(grams) > 0")
    parts = materialise(parts, "segments")
    labels = materialise(records.select(F.col("key").alias("node"), F.col("key").alias("root")), "labels")
    now = records.select("key", "n", "score", F.explode("prefix").alias("p"), F.col("key").alias("root")).select(
        F.col("p.gram").alias("gram"), "key", "n", "score", F.col("p.pos").alias("pos"), "root"
    )
    # sizes that can link differ by the factor 100 / threshold at most: one band or two neighbours
    band = lambda turn: F.floor(F.ln("n") / F.lit(float(np.log(100 / threshold))) + F.lit(0.5 * (turn % 2)))
    spent: list[DataFrame] = []
    before_left, hot = float("inf"), []
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            open_ = now.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("gram")
            now = _dealt_join(now, open_, ["gram"], hot, "left_semi")
        held = materialise(now.withColumn("band", band(turn)), "index")
        left, rows, hot = _untested(held, turn > 0)
        # a round that contracts next to nothing won't be followed by better ones: common n-grams of unlike sets are left
        stalled = turn > 1 and left > 0.9 * before_left
        last = left <= max(FEW_PAIRS, PAIRS_A_ROW[min(turn, 1)] * rows) or stalled or turn == STAR_ROUNDS
        before_left = left
        side = lambda x: held.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "pos", "root", "band")])  # noqa: E731, B023
        spent.append(held)
        if not left:
            break
        if last:
            # sizes that can link lie in the same or in neighbouring bands: no more pairs than were counted
            low = side("a").withColumn("band_b", F.explode(F.array(F.col("band_a"), F.col("band_a") + 1)))
            pairs = low.join(side("b"), ["gram", "band_b"]).where("(band_a < band_b or key_a < key_b) and root_a <> root_b")
        else:
            # the first leader is the set with the commonest n-grams (nearest to what a group of edits came from), later ones go by hash
            rank = F.col("score") if turn < 2 else F.xxhash64("key", F.lit(turn)).cast("double")
            best = held.groupBy("gram", "band").agg(F.max(F.struct(rank.alias("r"), "key", "n", "pos", "root")).alias("l"))
            leader = best.select("gram", F.col("band").alias("band_b"), *[F.col(f"l.{c}").alias(f"{c}_a") for c in ("key", "n", "pos", "root")])
            pairs = _dealt_join(side("b"), leader, ["gram", "band_b"], hot).where("root_a <> root_b")
        pairs = pairs.where(_fits(threshold, "n_a", "n_b", "pos_a", "pos_b"))
        swap = F.col("key_a") > F.col("key_b")
        ordered = [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(name) for c, x, y, name in (("key", "a", "b", "a"), ("key", "b", "a", "b"), ("n", "a", "b", "na"), ("n", "b", "a", "nb"))]
        pairs = materialise(pairs.select(*ordered).distinct(), "pairs")
        most = pairs.count()
        found = verified(pairs, parts, threshold, most)
        # links between sets become links between their classes
        of = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))  # noqa: E731, B023
        classes = salted_join(salted_join(found.select("a", "b"), of("a"), ["a"], "b", most), of("b"), ["b"], "a", most)
        merged = components(classes, "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("merged"))
        following = labels.join(merged, "root", "left").select("node", F.coalesce("merged", "root").alias("root"))
        before, labels = labels, materialise(following, "labels")
        discard(before)
        discard(pairs)
        if last:
            break
        now = held.drop("band", "root").join(labels.withColumnRenamed("node", "key"), "key")
        for table in spent[:-1]:
            discard(table)
        spent = spent[-1:]
    for table in (parts, *spent):
        discard(table)
    return labels


def _classes(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    keys = materialise(set_keys(docs, width), "sets")
    records = materialise(linkable_records(docs, width, threshold), "records")
    roots = link_sets(records, threshold)
    discard(records)
    n = keys.count()
    # rows of a set, and sets of a class, are dealt by their ids: a class may hold a third of all rows
    named = salted_groups(keys, roots.withColumnRenamed("node", "key"), ["key"], "doc_id", n).select("doc_id", "text_hash", "n", F.coalesce("root", "key").alias("class"))
    smallest = named.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return salted_groups(named, smallest, ["class"], "doc_id", n).select("doc_id", "text_hash", "class", F.col("n").alias("n_shingles"), component.alias("component_id"))


def near_classes(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id of its class)."""
    return _classes(docs, width, threshold).drop("text_hash", "class")


def keep_representatives(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id; all columns kept.

    Documents without words have no class and all stay. Rows are told apart by doc_id and text: of a class's rows with
    the smallest id the one with the smallest text hash stays (an id may repeat, or all may be null), with rows that
    repeat both.
    """
    named = _classes(docs, width, threshold)
    first = named.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("i"), "doc_id", "text_hash")).alias("f"))
    alone = named.where("n_shingles = 0").select(F.col("doc_id").alias("_vf_id"), F.col("text_hash").alias("_vf_text"))
    kept = first.select(F.col("f.doc_id").alias("_vf_id"), F.col("f.text_hash").alias("_vf_text")).unionByName(alone).distinct()
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_vf_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_vf_text"))  # null text: the seed
    return docs.join(kept, here, "left_semi")
