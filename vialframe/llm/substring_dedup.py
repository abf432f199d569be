"""Operator 3: substring deduplication by recompression.

Parsing. A document's words are symbols. In each of three rounds every symbol
gets a side, left or right, from a bit of its name, and a left symbol followed by
a right one becomes a new symbol named by a hash of the pair. The names need no
dictionary, so equal word sequences get equal names in every document of the
corpus without any exchange. Equal neighbours have the same side: runs never pair
and stay rows of equal names, so a long run can't pull a symbol over an edge. In
a round only the outermost symbol on each side of a substring can depend on what
stands outside; symbols before rounds 1, 2, 3 have at most 1, 2, 4 words. So in
any two occurrences of a window of W words all symbols that lie 7 or more words
inside are the same. With W >= 29 at least one symbol (8 words at most) does.

Sharing. A window's anchor is the best of those symbols (longest, then smallest
name, then leftmost); equal windows have the same anchor at the same offset.
Anchors travel to the home of their name, packed per chunk, with the hashes of
the windows that chose them. At home, names that occur once end there; for the
others (name, offset, window hash) tells which windows start in several places.
Their word intervals go back to the documents, which are read a second time.

Windows are judged on the input. A removed word is one that such a window covers.

Defined cases: a null text has no words; texts under W words lose nothing;
repeated rows are occurrences like any other, so a text of W words or more that
two rows hold is removed whole from both; very long texts are chunks of
their own and read whole; texts are known by their 64-bit xxhash; other columns are handed on untouched; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Words, lean, mix, shuffle_partitions, text_chunks

WINDOW = 35
ROUNDS = 3
#: Words at each end of a window whose symbols may depend on what stands outside it.
MARGIN = 2**ROUNDS - 1


# ------------------------------------------------------------------- parsing
def parse(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after the last round; no symbol crosses ``bounds``."""
    names, starts = words, np.arange(len(words))
    opens = np.zeros(len(words) + 1, bool)
    opens[bounds] = True
    for r in range(ROUNDS):
        if len(names) < 2:
            break
        right = (mix(names + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(names), bool)  # does the symbol join the one before it?
        pair[1:] = ~right[:-1] & right[1:] & ~opens[starts[1:]]
        first = np.flatnonzero(pair) - 1
        names = names.copy()
        names[first] = mix(names[first] * np.uint64(0xD6E8FEB86659FD93) + mix(names[first + 1]) + np.uint64(r))
        names, starts = names[~pair], starts[~pair]
    return names, starts


def anchors(names: np.ndarray, starts: np.ndarray, n_words: int, at: np.ndarray, window: int) -> np.ndarray:
    """Index of the anchor symbol of each window that starts at a word of ``at``."""
    size = np.diff(np.concatenate((starts, [n_words])))
    rank = (np.uint64(15) - np.minimum(size, 15).astype(np.uint64)) << np.uint64(60) | names >> np.uint64(4)
    opened = np.zeros(n_words + 2, np.int32)
    opened[starts + 1] = 1
    opened = np.cumsum(opened, dtype=np.int32)  # opened[x]: symbols that start before word x
    lo = opened[at + MARGIN]
    hi = opened[np.minimum(at + window - MARGIN + 1, n_words + 1)] - 1
    # at the end of the last document of a chunk the last symbol has no follower
    hi = np.where(at + window - MARGIN >= n_words, len(starts), hi)
    width = hi - lo
    level = np.zeros(int(width.max(initial=1)) + 1, np.int8)
    for i in range(2, len(level)):
        level[i] = level[i // 2] + 1
    table = [np.arange(len(names), dtype=np.int32)]
    for k in range(1, int(level[-1]) + 1):
        a, b = table[-1][: -(1 << (k - 1))], table[-1][1 << (k - 1) :]
        table.append(np.where(rank[b] < rank[a], b, a))
    out = np.empty(len(at), np.int32)
    chosen = level[width]
    for k, best in enumerate(table):
        m = np.flatnonzero(chosen == k)
        if len(m):
            a, b = best[lo[m]], best[hi[m] - (1 << k)]
            out[m] = np.where(rank[b] < rank[a], b, a)
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. +counts[0], starts[1] .. , one after the other."""
    total = int(counts.sum())
    skip = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total) + skip


_PACKED = "home int, names binary, keys binary, first binary, offset binary, counts binary, low binary, high binary"
_PACKED_NAMES = ["home", "names", "keys", "first", "offset", "counts", "low", "high"]


def _emit(window: int, homes: int) -> Callable[[Iterable], Iterator]:
    """Chunks of (key, text) to packed anchors by home."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch, texts in text_chunks(batches):
            keys = np.array(batch.column("key").to_numpy(zero_copy_only=False), np.int64)
            seen: dict[int, int] = {}
            twice = []  # two rows of a text tell as much as more of them
            for i, k in enumerate(keys.tolist()):
                seen[k] = seen.get(k, 0) + 1
                if seen[k] <= 2:
                    twice.append(i)
            keys, texts = keys[twice], [texts[i] for i in twice]
            words = Words(texts)
            n = np.diff(words.bounds)
            fits = n >= window
            if not fits.any():
                continue
            at = _ranges(words.bounds[:-1][fits], n[fits] - window + 1)
            doc = np.repeat(np.flatnonzero(fits), n[fits] - window + 1)
            names, starts = parse(words.hash, words.bounds)
            best = anchors(names, starts, len(words.hash), at, window)
            hashes = words.grams(window)[at]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(fresh)
            count = np.diff(np.concatenate((head, [len(at)])))
            name, key = names[best[head]], keys[doc[head]]
            first = at[head] - words.bounds[doc[head]]
            offset = starts[best[head]] - at[head]
            home = ((name >> np.uint64(32)) * np.uint64(homes) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            sorted_home = home[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(sorted_home)) + 1, [len(order)]))
            rows: list[list] = [[] for _ in _PACKED_NAMES]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                take = order[a:b]
                h = hashes[_ranges(head[take], count[take])]
                values = (
                    name[take], key[take], first[take].astype("<u4"), offset[take].astype("u1"), count[take].astype("u1"),
                    h.astype("<u4"), (h >> np.uint64(32)).astype("<u2"),
                )
                rows[0].append(int(sorted_home[a]))
                for r, v in zip(rows[1:], values, strict=True):
                    r.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], _PACKED_NAMES)

    return run


# ------------------------------------------------------------------- sharing
def _merge_cover(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the word intervals [first, last) per key, sorted."""
    order = np.lexsort((first, key))
    key, first, last = key[order], first[order], last[order]
    # running maximum of the ends inside a key: keys are made to dominate positions
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) << 40
    reach = np.maximum.accumulate(group + last)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (group + first)[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    ends = np.concatenate((at[1:], [len(key)])) - 1
    return key[at], first[at], reach[ends] - group[ends]


def _repeated(window: int, homes: int) -> Callable[[Iterable], Iterator]:
    """A partition's anchors to the word intervals of windows that start in several places, packed by text."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        cols: list[list] = [[] for _ in _PACKED_NAMES[1:]]
        for batch in batches:
            for c, n in zip(cols, _PACKED_NAMES[1:], strict=True):
                c.extend(batch.column(n).to_pylist())
        if not cols[0]:
            return
        name, key, first, offset, count, low, high = (
            np.frombuffer(b"".join(c), kind) for c, kind in zip(cols, ("<u8", "<i8", "<u4", "u1", "u1", "<u4", "<u2"), strict=True)
        )
        del cols
        begin = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))[:-1]
        order = np.argsort(name, kind="stable")
        same = np.zeros(len(name), bool)
        eq = name[order[1:]] == name[order[:-1]]
        same[order[1:]] |= eq
        same[order[:-1]] |= eq
        kept = np.flatnonzero(same)
        if not len(kept):
            return
        count = count[kept].astype(np.int64)
        at = _ranges(begin[kept], count)
        step = _ranges(np.zeros(len(kept), np.int64), count)
        owner = np.repeat(kept, count)
        away = (offset[owner].astype(np.int64) - step).astype(np.uint64)
        # 112 bits tell windows apart: where the anchor lies and its name, and the hash of the words
        ident, words = mix(name[owner] + away * np.uint64(0x9E3779B97F4A7C15)), low[at].astype(np.uint64) | high[at].astype(np.uint64) << np.uint64(32)
        order = np.lexsort((words, ident))
        eq = (ident[order[1:]] == ident[order[:-1]]) & (words[order[1:]] == words[order[:-1]])
        same = np.zeros(len(ident), bool)
        same[order[1:]] |= eq
        same[order[:-1]] |= eq
        hit = np.flatnonzero(same)
        if not len(hit):
            return
        word = first[owner[hit]].astype(np.int64) + step[hit]
        key, start, end = _merge_cover(key[owner[hit]], word, word + window)
        home = ((mix(key.view(np.uint64)) >> np.uint64(32)) * np.uint64(homes) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sorted_home = home[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(sorted_home)) + 1, [len(order)]))
        rows: list[list] = [[], [], [], []]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            take = order[a:b]
            rows[0].append(int(sorted_home[a]))
            for r, v in zip(rows[1:], (key[take], start[take].astype("<u4"), end[take].astype("<u4")), strict=True):
                r.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], ["home", "keys", "starts", "ends"])

    return run


def _united(batches: Iterable) -> Iterator:
    """Packed intervals of a home's texts to one row per text: key, spans (u32 start, end pairs)."""
    import pyarrow as pa

    cols: list[list] = [[], [], []]
    for batch in batches:
        for c, n in zip(cols, ("keys", "starts", "ends"), strict=True):
            c.extend(batch.column(n).to_pylist())
    if not cols[0]:
        return
    key, start, end = (np.frombuffer(b"".join(c), kind) for c, kind in zip(cols, ("<i8", "<u4", "<u4"), strict=True))
    key, start, end = _merge_cover(key, start.astype(np.int64), end.astype(np.int64))
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
    pairs = np.stack((start, end), axis=1).astype("<u4")
    for at in range(0, len(cuts) - 1, 20_000):
        part = cuts[at : at + 20_001]
        spans = [pairs[a:b].tobytes() for a, b in zip(part[:-1], part[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(key[part[:-1]], pa.int64()), pa.array(spans, pa.binary())], ["key", "spans"])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key (xxhash64 of the text), spans (binary: little-endian u32 first word, end word pairs) of what repeats."""
    if window < 2 * MARGIN + 2 * 2**ROUNDS - 1:
        raise ValueError("the window is too short for an anchor to be sure")
    if window > 255:
        raise ValueError("places inside a window are kept in one byte: 255 words at most")
    ship(docs.sparkSession)
    parts = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(text.alias("text")).select("text", F.xxhash64("text").alias("key")).mapInArrow(lean(_emit(window, parts)), _PACKED)
    spans = packed.repartitionById(parts, "home").mapInArrow(lean(_repeated(window, parts)), "home int, keys binary, starts binary, ends binary")
    return spans.repartitionById(parts, "home").mapInArrow(lean(_united), "key long, spans binary")


def _cut(batches: Iterable) -> Iterator:
    import pyarrow as pa

    for batch, texts in text_chunks(batches, "_vf_text"):
        kept, total, removed = [], [], []
        for text, spans in zip(texts, batch.column("_vf_spans").to_pylist(), strict=True):
            words = text.split()
            total.append(len(words))
            if spans:
                out, at = [], 0
                for a, b in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
                    out += words[at:a]
                    at = b
                words = out + words[at:]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        keep = [i for i, n in enumerate(batch.schema.names) if n not in ("_vf_text", "_vf_spans")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in keep], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
            [*[batch.schema.names[i] for i in keep], "_vf_kept", "_vf_n", "_vf_r"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW, names: tuple[str, str, str] = ("kept_text", "n_words", "n_removed")) -> DataFrame:
    """``docs`` with three more columns: the kept words joined by one space, the words, the removed words.

    A column of ``docs`` with one of these names is replaced.
    """
    spans = repeated_spans(docs, window).select(F.col("key").alias("_vf_key"), F.col("spans").alias("_vf_spans"))
    rest = [c for c in docs.columns if c not in names]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*rest, text.alias("_vf_text"), F.xxhash64(text).alias("_vf_key"))
    joined = keyed.join(spans, "_vf_key", "left").select(*rest, "_vf_text", "_vf_spans")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*rest).schema], "_vf_kept string, _vf_n long, _vf_r long"])
    cut = joined.mapInArrow(lean(_cut), schema)
    return cut.select(*rest, F.col("_vf_kept").alias(names[0]), F.col("_vf_n").alias(names[1]), F.col("_vf_r").alias(names[2]))
