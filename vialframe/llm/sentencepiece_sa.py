"""Operator 2: SentencePiece encoding and decoding by suffix-array matching.

A batch's new segments (a run of spaces with the word after it; a line break is
its own) are concatenated and their suffix array is built by prefix doubling up
to the longest piece. Every piece of the vocabulary is binary-searched in it; its
range of suffixes gives the places where it occurs. These edges, sorted by
position, are the lattice that is relaxed: in a BPE vocabulary an edge's score is
its merge order, so in each step every segment joins the adjacent pair with the
best edge, leftmost first, until no edge spans a pair. What no piece covers
falls back to bytes. Segments are encoded once and kept in a bounded cache, which
is exact as no piece holds a space behind another character or a line break.

Decoding joins the pieces, turns the space mark into a space and drops the one
that encoding puts in front.

Defined cases: a null or empty text has no ids and decodes to the empty text;
the space mark itself decodes as a space (the vocabulary can't tell them apart);
repeated rows stay; other columns are handed on; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import PieceCache, lean, text_chunks

MARK = "▁"
#: Segments that a worker remembers, characters indexed at once, and the length from which a segment is relaxed with a heap.
CACHE_SEGMENTS, INDEX_CHARS, LONG = 240_000, 1 << 18, 96
#: Text bytes whose new segments share a suffix array.
BATCH_BYTES = 2 << 20
_SEGMENT = re.compile(r"\n| *[^ \n]+| +")


class Vocabulary:
    """Normal pieces as padded code-point rows in order, with their scores; byte ids; decoding table."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.byte_id, normal, self.table = np.zeros(256, np.uint32), [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.table.append(b"")
            else:
                normal.append((piece, i, sp.get_score(i)))
                self.table.append(piece.replace(MARK, " ").encode())
        self.width = max(len(p) for p, _, _ in normal)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in normal):
            raise ValueError("pieces that span words need another segmentation")
        # punctuation that follows a letter or digit in no piece: no merge can cross such a place
        led = {b for p, _, _ in normal for a, b in zip(p[:-1], p[1:], strict=True) if a.isalnum()}
        closed = "".join(re.escape(c) for c in string.punctuation if c not in led and c != "_")
        self.cut = re.compile(rf"(?<=[^\W_])(?=[{closed}])") if closed else None
        order = {s: r for r, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        self.codes = np.zeros((len(normal), self.width), np.int64)
        for r, (p, _, _) in enumerate(normal):
            self.codes[r, : len(p)] = [ord(c) + 1 for c in p]
        self.size = np.array([len(p) for p, _, _ in normal])
        self.id = np.array([i for _, i, _ in normal], np.int16 if n < 1 << 15 else np.int32)
        #: Merge order of each piece; what is no normal piece, and the -1 of no piece, come never.
        self.rank_of = np.full(n + 1, np.iinfo(np.int32).max, np.int32)
        self.rank_of[self.id] = [order[s] for _, _, s in normal]


def first_three(codes: np.ndarray) -> np.ndarray:
    """The next three codes at each position in one number of 63 bits."""
    padded = np.concatenate((codes, np.zeros(2, np.int64)))
    return padded[:-2] << 42 | padded[1:-1] << 21 | padded[2:]


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """Suffixes of ``codes`` (0 ends a segment, others are code points + 1) in the order of their first ``width`` codes at least."""
    n, key, reach = len(codes), first_three(codes), 3
    while True:
        order = np.argsort(key)  # equal keys are equal prefixes: any order will do
        if reach >= width:
            return order
        fresh = np.concatenate(([0], (np.diff(key[order]) != 0).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) + 1
        ahead = np.zeros(n, np.int64)
        ahead[: n - reach] = rank[reach:] if reach < n else 0
        key = rank * (n + 2) + ahead
        reach *= 2


def _bound(codes: np.ndarray, order: np.ndarray, vocab: Vocabulary, lo: np.ndarray, hi: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search for the long pieces inside [lo, hi): the first suffix not before the piece (upper: that no longer starts with it)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero((lo < hi) & (vocab.size > 3))
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        at = order[mid]
        state = np.zeros(len(open_), np.int8)  # sign of suffix - piece, on the piece's length; the first three are equal
        undecided = np.arange(len(open_))
        for k in range(3, vocab.width):
            undecided = undecided[(state[undecided] == 0) & (vocab.size[open_[undecided]] > k)]
            if not len(undecided):
                break
            have = codes[np.minimum(at[undecided] + k, len(codes) - 1)]
            state[undecided] = np.sign(have - vocab.codes[open_[undecided], k])
        right = state <= 0 if upper else state < 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


def occurrences(codes: np.ndarray, order: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The range of suffixes that start with each piece: by the first three codes at once, then by the rest."""
    keys = first_three(codes)[order]
    c0, c1, c2 = vocab.codes[:, 0], vocab.codes[:, 1], vocab.codes[:, 2]
    last = np.where(vocab.size == 1, 1 << 42, np.where(vocab.size == 2, 1 << 21, 1))
    own = c0 << 42 | c1 << 21 | c2
    low, high = np.searchsorted(keys, own), np.searchsorted(keys, own + last)
    long_low, long_high = _bound(codes, order, vocab, low, high, False), _bound(codes, order, vocab, low, high, True)
    return np.where(vocab.size > 3, long_low, low), np.where(vocab.size > 3, long_high, high)


def lattice(codes: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Edges by position: id of the piece that covers [position, position + length), else -1, as [length][position]."""
    order = suffix_array(codes, vocab.width)
    low, high = occurrences(codes, order, vocab)
    ids = np.full((vocab.width + 1, len(codes)), -1, vocab.id.dtype)
    count = high - low
    piece = np.repeat(np.arange(len(count)), count)
    slot = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    ids[vocab.size[piece], order[slot]] = vocab.id[piece]
    return ids


def _relax_long(ids: np.ndarray, rank_of: np.ndarray, start: int, end: int, width: int) -> list[tuple[int, int]]:
    """One segment with a heap: (start, end) of its symbols."""
    stop = {i: i + 1 for i in range(start, end)}
    before = {i: i - 1 for i in range(start + 1, end)}
    none = np.iinfo(np.int32).max

    def push(i: int) -> None:
        j = stop[i]
        if j < end and stop[j] - i <= width and (r := int(rank_of[ids[stop[j] - i, i]])) != none:
            heapq.heappush(heap, (r, i, j, stop[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(start, end):
        push(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if stop.get(i) != j or stop.get(j) != e:
            continue
        stop[i] = e
        del stop[j]
        if e < end:
            before[e] = i
        push(i)
        if i > start:
            push(before[i])
    out, i = [], start
    while i < end:
        out.append((i, stop[i]))
        i = stop[i]
    return out


def relax(ids: np.ndarray, rank_of: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (start, end) of all segments [starts, ends), in order."""
    none = np.iinfo(np.int32).max
    done_a, done_b = [], []
    long = ends - starts > LONG
    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        found = np.array(_relax_long(ids, rank_of, s, e, width)).reshape(-1, 2)
        done_a.append(found[:, 0])
        done_b.append(found[:, 1])
    starts, ends = starts[~long], ends[~long]
    size = ends - starts
    a = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
    b, seg = a + 1, np.repeat(np.arange(len(size)), size)
    while len(a):
        span = np.full(len(a), width + 1)
        span[:-1] = b[1:] - a[:-1]
        score = np.full(len(a), none, np.int64)
        ok = np.flatnonzero((span <= width) & np.concatenate((seg[1:] == seg[:-1], [False])))
        score[ok] = rank_of[ids[span[ok], a[ok]]]
        key = score << 32 | np.arange(len(a))
        head = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        best = np.minimum.reduceat(key, head)
        merge = best[best >> 32 != none] & 0xFFFFFFFF
        live = np.repeat(best >> 32 != none, np.diff(np.concatenate((head, [len(a)]))))
        done_a.append(a[~live])
        done_b.append(b[~live])
        b = b.copy()
        b[merge] = b[merge + 1]
        live[merge + 1] = False
        a, b, seg = a[live], b[live], seg[live]
    a, b = np.concatenate(done_a or [np.zeros(0, np.int64)]), np.concatenate(done_b or [np.zeros(0, np.int64)])
    order = np.argsort(a)
    return a[order].astype(np.int64), b[order].astype(np.int64)


class Encoder:
    """Ids of whole texts."""

    def __init__(self, model_file: str, limit: int = CACHE_SEGMENTS):
        self.vocab = Vocabulary(model_file)
        self.cache, self.parts = PieceCache(self._encode_segments, limit), PieceCache(self._encode, limit)

    def _encode_segments(self, segments: list[str]) -> list[bytes]:
        """New segments by their parts: they are cut where the vocabulary lets no piece lie across."""
        if self.vocab.cut is None:
            return self._encode(segments)
        split = [self.vocab.cut.split(s) for s in segments]
        self.parts.learn(split)
        return [self.parts.get(s) for s in split]

    def _encode(self, segments: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(segments):
            end, size = at, 0
            while end < len(segments) and (end == at or size + len(segments[end]) < INDEX_CHARS):
                size += len(segments[end]) + 1
                end += 1
            out += self._encode_batch(segments[at:end])
            at = end
        return out

    def _encode_batch(self, segments: list[str]) -> list[bytes]:
        joined = "\x00".join(s.replace(" ", MARK).replace("\x00", "\U0010ffff") for s in segments) + "\x00"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        codes = np.where(codes == 0, 0, codes + 1)
        ends = np.flatnonzero(codes == 0)
        starts = np.concatenate(([0], ends[:-1] + 1))
        ids = lattice(codes, self.vocab)
        a, b = relax(ids, self.vocab.rank_of, starts, ends, self.vocab.width)
        size = b - a
        found = np.where(size <= self.vocab.width, ids[np.minimum(size, self.vocab.width), a], -1)
        cut = np.searchsorted(a, starts)
        bounds = np.concatenate((cut, [len(a)])).tolist()
        whole = np.add.reduceat((found < 0).astype(np.int64), cut) == 0 if len(a) else np.zeros(0, bool)
        raw = found.astype("<u4").tobytes()
        out = []
        for i, (s, x, y) in enumerate(zip(segments, bounds[:-1], bounds[1:], strict=True)):
            if whole[i]:
                out.append(raw[4 * x : 4 * y])
                continue
            parts, text, base = [], s.replace(" ", MARK), int(starts[i])
            for k in range(x, y):
                if found[k] >= 0:
                    parts.append(raw[4 * k : 4 * k + 4])
                else:
                    piece = text[int(a[k]) - base : int(b[k]) - base].encode("utf-8", "replace")
                    parts.append(self.vocab.byte_id[np.frombuffer(piece, np.uint8)].astype("<u4").tobytes())
            out.append(b"".join(parts))
        return out

    def ids_of(self, texts: list[str]) -> list[bytes]:
        split = [_SEGMENT.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self.cache.learn(split)
        return [self.cache.get(s) for s in split]


def decode_ids(ids: bytes, table: list[bytes]) -> str:
    text = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _mapper(model_file: str, decode: bool) -> Callable[[Iterable], Iterator]:
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        if decode:
            table = Vocabulary(model_file).table
            for batch in batches:
                found = [decode_ids(x or b"", table) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "_vf_out"])
            return
        encoder = Encoder(model_file)
        for batch, texts in text_chunks(batches, "_vf_text", size=BATCH_BYTES, docs=8192):
            found = encoder.ids_of([t.decode("utf-8", "replace") for t in texts])
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_vf_text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(found, pa.binary())], [*[batch.schema.names[i] for i in keep], "_vf_out"]
            )

    return run


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], more])


def encode(docs: DataFrame, model_file: str, out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as little-endian u32 binary in column ``out`` (replaced if there)."""
    ship(docs.sparkSession)
    rest = docs.select(*[c for c in docs.columns if c != out])
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_vf_text")
    done = rest.select("*", text).mapInArrow(lean(_mapper(model_file, False)), _schema(rest, "_vf_out binary"))
    return done.withColumnRenamed("_vf_out", out)


def decode(rows: DataFrame, model_file: str, out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ``ids`` in column ``out`` (replaced if there)."""
    ship(rows.sparkSession)
    rest = rows.select(*[c for c in rows.columns if c != out])
    return rest.mapInArrow(lean(_mapper(model_file, True)), _schema(rest, "_vf_out string")).withColumnRenamed("_vf_out", out)
