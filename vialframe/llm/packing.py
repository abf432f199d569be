"""Operator 4: packing by power-of-two decomposition.

A document's ids (with the end id) are cut into pieces whose lengths are the
binary digits of its length, at most ``max_len`` each; every piece is a sequence
of its own and belongs to the bucket of its length. No sequence crosses
documents and none is padded, as every length is a power of two. A batch of a
bucket is a rectangle of equal lengths (``bucket`` is log2 of the length).

There is no shuffle: pieces are made where the document is read. Words are
tokenised once and kept in a bounded cache per worker: the vocabulary's matches
never span white space, so a text's ids are its words' ids in order. That holds for
files with the normaliser and pre-tokeniser of ``WORDWISE``; with any other file
whole texts are encoded.

Ids are those of the library's plain call: a control string of the vocabulary inside
a text gives the control id. With ``control_ids=False`` it is ordinary text.

Defined cases: a null or empty text gives the end id alone, one piece of one id;
repeated rows are packed each for itself, with sequence ids of their own; very
long texts give full pieces of ``max_len``; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import kept, lean, text_chunks

MAX_LEN = 4096
END_ID = 2
#: Words, and runs, that a worker remembers.
CACHE_WORDS = 1_000_000
#: Bytes of text whose words are looked up together (a longer document is a chunk of its own), and new runs encoded together.
CHUNK, RUNS_AT_ONCE = 8 << 20, 4096
_PIECES = "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long"


#: What is no letter (ASCII or Latin-1) and no ASCII punctuation; the apostrophe has splitting rules of its own.
_OTHER = r"[^a-zA-ZÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]"
#: Runs that are pre-tokens of their own, and the line break between words.
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ\n]+|\n")
#: How a file must clean and split texts for words to be encoded one by one.
WORDWISE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class IdCache:
    """Ids (little-endian u32 bytes) of pieces, by Arrow arrays: about ``limit`` pieces of at most ``LONGEST`` bytes are kept.

    ``encode(array of new pieces) -> array of their ids`` is asked once for each piece of a call that isn't kept. When
    the limit is passed, only the pieces of the last call stay.
    """

    LONGEST = 64

    def __init__(self, encode: Callable, limit: int):
        import pyarrow as pa

        self.encode, self.limit = encode, limit
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def get(self, pieces):
        """The ids of every piece, in order, as one large_binary array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = pieces.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.pieces)
        new = coded.dictionary.filter(at.is_null())
        table = pa.concat_arrays([self.ids, self.encode(new)]) if len(new) else self.ids
        place = pc.fill_null(at, -1).to_numpy().copy()
        place[place < 0] = len(self.ids) + np.arange(len(new))
        if len(new):
            self._keep(coded.dictionary, new, table, place)
        return table.take(pa.array(place[coded.indices.to_numpy()]))

    def _keep(self, last, new, table, place: np.ndarray) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        short = pc.less_equal(pc.binary_length(new), self.LONGEST)
        if len(self.pieces) + len(new) <= self.limit:
            self.pieces = pa.concat_arrays([self.pieces, new.filter(short)])
            self.ids = pa.concat_arrays([self.ids, table.slice(len(self.ids)).filter(short)])
        else:
            short = pc.less_equal(pc.binary_length(last), self.LONGEST)
            self.pieces = pa.concat_arrays([last.filter(short).slice(0, self.limit)])
            self.ids = pa.concat_arrays([table.take(pa.array(place)).filter(short).slice(0, self.limit)])


def _joined(values, cuts: np.ndarray):
    """One large_binary array of the neighbours values[cuts[i]:cuts[i + 1]], written together; nothing is copied."""
    import pyarrow as pa

    ends = np.frombuffer(values.buffers()[1], "<i8")[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, "<i8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts]), values.buffers()[2]])


class WordIds:
    """Little-endian unsigned 32-bit ids of whole texts, word by word through bounded caches.

    Control strings (added tokens that match as they stand) are cut out first, as the library does.
    A new word of letters and punctuation is taken apart into its runs, in lower case, which a second cache holds.
    New runs are encoded as one text and told apart by the end-of-word mark of their last token. Other new words
    are encoded as one text with a mark between them, those that hold the mark one by one.
    """

    MARK = "|"

    def __init__(self, tokenizer_path: str, limit: int = CACHE_WORDS, control_ids: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as f:
            config = json.load(f)
        added = config.get("added_tokens") or []
        literal = all(x["special"] and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in added)
        model = config["model"]
        plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not (model.get("dropout") or config.get("truncation") or config.get("padding"))
        self.wordwise = plain and literal and (config.get("normalizer"), config.get("pre_tokenizer")) == WORDWISE
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = self.wordwise or not control_ids
        self.control = {x["content"].encode(): int(x["id"]).to_bytes(4, "little") for x in added} if control_ids else {}
        self.cut = re.compile(b"(" + b"|".join(re.escape(c) for c in sorted(self.control, key=len, reverse=True)) + b")") if self.control else None
        self.mark = self._encode_text(self.MARK)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.words, self.runs = IdCache(self._encode, limit), IdCache(self._encode_runs, limit)

    def _encode_text(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_runs(self, runs):
        """Runs, and the line break, which has no ids."""
        import pyarrow as pa

        texts = runs.to_pylist()
        if "\n" in texts:
            at = texts.index("\n")
            return pa.concat_arrays([self._encode_runs(runs.slice(0, at)), pa.array([b""], pa.large_binary()), self._encode_runs(runs.slice(at + 1))])
        out = [pa.array([], pa.large_binary())]
        for at in range(0, len(texts), RUNS_AT_ONCE):
            part = texts[at : at + RUNS_AT_ONCE]
            ids = self._encode_text(" ".join(part))
            cuts = 4 * np.flatnonzero(self.ends[ids]) + 4
            if len(cuts) == len(part):
                offsets = np.concatenate(([0], cuts)).astype("<i8")
                out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
            else:
                out.append(pa.array([self._encode_text(p).tobytes() for p in part], pa.large_binary()))
        return pa.concat_arrays(out)

    def _by_runs(self, words):
        import pyarrow as pa

        runs = _RUNS.findall("\n".join(words.to_pylist()).lower())
        pieces = pa.array(runs, pa.large_string())
        breaks = np.flatnonzero(pa.compute.equal(pieces, "\n").to_numpy(zero_copy_only=False)) if runs else np.zeros(0, np.int64)
        return _joined(self.runs.get(pieces), np.concatenate(([0], breaks, [len(runs)])))

    def _by_marks(self, words: list[str]) -> list[bytes]:
        ids = self._encode_text(f" {self.MARK} ".join(words))
        cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else []
        if len(cuts) != len(words) - 1:  # a word holds the mark
            return [self._encode_text(w).tobytes() for w in words]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)], strict=True)]

    def _encode(self, words):
        """New words; the empty word, which stands at the edges of texts, has no ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(words, _OTHER)
        empty = pc.equal(words, "")
        other = pc.and_not(odd, empty)
        plain = pc.invert(pc.or_(odd, empty))
        texts = words.filter(other).to_pylist()
        marked = [i for i, t in enumerate(texts) if self.MARK in t]
        free = [i for i, t in enumerate(texts) if self.MARK not in t]
        coded: list[bytes] = [b""] * len(texts)
        for at in range(0, len(free), 4096):
            part = free[at : at + 4096]
            for i, x in zip(part, self._by_marks([texts[i] for i in part]), strict=True):
                coded[i] = x
        for i in marked:
            coded[i] = self._encode_text(texts[i]).tobytes()
        groups = [(plain, self._by_runs(words.filter(plain)) if pc.any(plain).as_py() else None), (other, pa.array(coded, pa.large_binary())), (empty, None)]
        at, parts, n = np.zeros(len(words), np.int64), [], 0
        for mask, ids in groups:
            places = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            at[places] = n + np.arange(len(places))
            n += len(places)
            parts.append(pa.array([b""] * len(places), pa.large_binary()) if ids is None else ids)
        return pa.concat_arrays(parts).take(pa.array(at))

    def ids(self, text: bytes) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        if not self.wordwise:
            coded = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.asarray(c.ids, "<u4").tobytes() for c in coded]
        if self.cut:
            parts = {i: self.cut.split(t) for i, t in enumerate(texts) if any(c in t for c in self.control)}
            if parts:
                return self._around_control(texts, parts)
        return self._by_words(texts)

    def _by_words(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts without control strings. Bytes that are no UTF-8 are replacement characters."""
        import pyarrow as pa
        import pyarrow.compute as pc

        try:
            column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        except pa.ArrowInvalid:
            column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string())
        words = pc.ascii_split_whitespace(column)
        whole = _joined(self.words.get(words.values), words.offsets.to_numpy())
        return whole.to_pylist()

    def _around_control(self, texts: list[bytes], parts: dict[int, list[bytes]]) -> list[bytes]:
        """Ids of texts some of which hold control strings: ``parts`` has those, cut with the control strings at odd places."""
        own = iter(self._by_words([p for i, t in enumerate(texts) for p in (parts[i][::2] if i in parts else [t])]))
        out = []
        for i in range(len(texts)):
            pieces = [next(own)]
            for c in parts[i][1::2] if i in parts else ():
                pieces += [self.control[c], next(own)]
            out.append(b"".join(pieces))
        return out


def word_ids(tokenizer_path: str, control_ids: bool = True) -> WordIds:
    """The worker's encoder of a tokenizer, loaded once; its caches, of bounded size, serve the worker's next tasks too."""
    store, name = kept("packing"), (tokenizer_path, control_ids)
    if name not in store:
        store[name] = WordIds(tokenizer_path, control_ids=control_ids)
    return store[name]


def cut_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Full pieces first, then the binary digits of the rest, large to small."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(tokenizer_path: str, max_len: int, end_id: int, control_ids: bool) -> Callable[[Iterable], Iterator]:
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        words, end = word_ids(tokenizer_path, control_ids), end_id.to_bytes(4, "little")
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
        names = ["doc_id", "start", "length", "bucket", "ids", "doc_tokens"]
        for batch, texts in text_chunks(batches, owner="packing", size=CHUNK, docs=CHUNK):
            cols: list[list] = [[], [], [], [], [], []]
            for doc, own in zip(batch.column("doc_id").to_pylist(), words.ids_of(texts), strict=True):
                ids = own + end
                n, at = len(ids) // 4, 0
                for size in cut_lengths(n, max_len):
                    for c, v in zip(cols, (doc, at, size, size.bit_length() - 1, ids[4 * at : 4 * (at + size)], n), strict=True):
                        c.append(v)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID, control_ids: bool = True) -> DataFrame:
    """(doc_id, text) to one row per piece: doc_id, start, length, bucket, ids, doc_tokens, sequence_id, offset.

    ``max_len`` must be a power of two. ``ids`` are little-endian unsigned 32-bit. The sequence id holds the
    bucket in its top bits, so a bucket is a contiguous range of ids.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    ship(docs.sparkSession)
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(_packer(tokenizer_path, max_len, end_id, control_ids)), _PIECES
    )
    return pieces.withColumn(
        "sequence_id", F.shiftleft(F.col("bucket").cast("long"), 57) + F.monotonically_increasing_id()
    ).withColumn("offset", F.lit(0).cast("long"))
