"""Operator 8: document fingerprints as canonical exact digests, with DataFrame functions only.

The canonical text is NFC-composed, case-folded in full (not merely lower-cased)
and white-space-folded; its fingerprint is a wide (3 x 64 bit) xxhash of it with its
length. Documents are grouped by fingerprint, and the canonical bytes of every bucket
with more than one row are compared, so a group holds equal canonical texts only.
An exact digest has no degrees: likeness is 1.0 or 0.0.

Spark has no Unicode normaliser, so NFC is done here in full: decomposition,
canonical order of the marks and composition by tables of every code point, built
from the rules in ``unicodedata`` at planning time, Hangul by its arithmetic. Only
texts and clusters with a character that NFC may change are taken apart. Folding can
undo composition, so texts with marks are composed and folded twice.

Defined cases: null text is empty; an empty or all-white text has the
fingerprint of the empty text; the next document goes by ascending doc_id,
nulls first, ties by text, the last document's next is the first, and a single
document is its own next; repeated rows all stay, each counts in its group; a group
of null ids only has a null group_id; texts of any length are read whole; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, salted_groups

_FIRST = -(1 << 63)
#: Bits of the sieve: 4 MB, 1024 rows.
SIEVE = 1 << 25


#: Characters that NFC and white space need a look at: those below are as they should be, or handled by themselves.
_HIGH = r"[^\x{0}-\x{2FF}]"
#: Below this code point the tables are arrays, above it (few entries) maps.
_LOW = 0x3100
#: Marks that Unicode added after version 13, which Java 17's \p{M} doesn't know.
_NEWER = r"\x{898}-\x{89F}\x{8CA}-\x{8D2}\x{C3C}\x{1715}\x{1AC1}-\x{1ACE}\x{1DFA}\x{10EFD}-\x{10EFF}\x{10F82}-\x{10F85}\x{11070}\x{11241}\x{11F41}\x{11F42}\x{1E08F}\x{1E2AE}\x{1E4EC}-\x{1E4EF}"


def _ranges(codes: list[int]) -> str:
    """The inside of a character class."""
    out, codes = [], sorted(codes)
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


@lru_cache(maxsize=1)
def _unicode() -> tuple[dict[int, str], dict[int, int], dict[int, str], dict[str, str]]:
    """Full decompositions, combining classes, per first code point its seconds each with what NFC makes of the two,
    and the classes of regular expressions."""
    full, order, joins, gone, seconds = {}, {}, {}, [], set()
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code <= 0xD7A3:
            continue
        ch = chr(code)
        if unicodedata.combining(ch):
            order[code] = unicodedata.combining(ch)
        rule = unicodedata.decomposition(ch)
        if not rule or rule.startswith("<"):
            continue
        full[code] = unicodedata.normalize("NFD", ch)
        if unicodedata.normalize("NFC", ch) != ch:
            gone.append(code)
        else:
            first, second = (int(x, 16) for x in rule.split())
            joins[first] = joins.get(first, "") + chr(second) + ch
            seconds.add(second)
    after = rf"\p{{M}}{_NEWER}\x{{1160}}-\x{{11FF}}"
    classes = {
        "after": after,
        "gone": _ranges(gone),
        "marks": _ranges(list(order)),
        "active": rf"(?={_HIGH})(?:[{_ranges([*seconds, *gone])}\x{{1161}}-\x{{1175}}\x{{11A8}}-\x{{11C2}}]|[\p{{M}}{_NEWER}]{{2}})",
    }
    return full, order, joins, classes


def _map(entries: dict[str, str]) -> Column:
    """A constant map that is one literal in the plan."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in entries.items())), F.lit("\x02"), F.lit("\x01"))


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), use)[0]


def _table(entries: dict, kind: str):
    """char -> its entry, or null."""
    low = F.split(F.lit(",".join(str(entries.get(c, "")) if c != 0x2C else "" for c in range(_LOW))), ",")
    high = _map({chr(c): str(v) for c, v in entries.items() if c >= _LOW})

    def look(ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < _LOW, F.nullif(F.element_at(low, code + 1), F.lit(""))).otherwise(F.try_element_at(high, ch)).cast(kind)

    return look


def _composed(text: Column) -> Column:
    """NFC: clusters are decomposed, their marks ordered, and folded into the starters one by one."""
    full, order, joins, classes = _unicode()
    decomposed, rank, seconds = _table(full, "string"), _table(order, "int"), _table(joins, "string")
    active = F.lit(classes["active"])
    after, gone, marks = classes["after"], classes["gone"], classes["marks"]
    clusters = F.regexp_extract_all(text, F.lit(rf"(?s)([^{after}{gone}]+(?![{after}])|[^{after}][{after}]*|[{after}]+)"), F.lit(1))
    state = "struct<out:string,last:string,wait:string,rank:int>"

    def joined(last: Column, ch: Column) -> Column:
        """What the two make together, or null. Tables are looked up once, so that the plan holds each of them once."""
        a, b = F.ascii(last), F.ascii(ch)
        at = F.when(a.between(0x1100, 0x1112) & b.between(0x1161, 0x1175), ((a - 0x1100) * 21 + b - 0x1161) * 28).when(
            a.between(0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & b.between(0x11A8, 0x11C2), a - 0xAC00 + b - 0x11A7
        )
        syllable = let(at, lambda n: F.when(n.isNotNull(), F.decode(F.unhex(F.hex(n + 0xAC00)), "UTF-16BE")))
        by_table = let(seconds(last), lambda have: let(F.instr(have, ch), lambda place: F.when(place > 0, F.substr(have, place + 1, F.lit(1)))))
        return F.when(last != "", F.coalesce(syllable, by_table))

    def step(acc: Column, x: Column) -> Column:
        ch, here = x["ch"], x["rank"]
        free = (acc["wait"] == "") | (acc["rank"] < here)
        made = lambda out, last, wait, r: F.struct(out.alias("out"), last.alias("last"), wait.alias("wait"), r.alias("rank"))
        return let(
            F.when(free, joined(acc["last"], ch)),
            lambda new: F.when(new.isNotNull(), made(acc["out"], new, acc["wait"], acc["rank"]))
            .when(here == 0, made(F.concat(acc["out"], acc["last"], acc["wait"]), ch, F.lit(""), F.lit(0)))
            .otherwise(made(acc["out"], acc["last"], F.concat(acc["wait"], ch), here)),
        )

    def ranked(part: Column) -> Column:
        """Characters with their classes; a run of marks in canonical order."""
        chars = F.transform(F.split(part, ""), lambda ch, i: F.struct(F.coalesce(rank(ch), F.lit(0)).alias("rank"), i.alias("i"), ch.alias("ch")))
        return F.when(F.rlike(part, F.lit(f"^[{marks}]{{2}}")), F.array_sort(chars)).otherwise(chars)

    def fold(cluster: Column) -> Column:
        apart = F.array_join(F.transform(F.split(cluster, ""), lambda ch: F.coalesce(decomposed(ch), ch)), "")
        runs = F.regexp_extract_all(apart, F.lit(f"(?s)([{marks}]+|[^{marks}]+)"), F.lit(1))
        start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"), F.lit("").alias("wait"), F.lit(0).alias("rank")).cast(state)
        whole = F.aggregate(F.flatten(F.transform(runs, ranked)), start, step, lambda acc: F.concat(acc["out"], acc["last"], acc["wait"]))
        return F.when(F.rlike(cluster, active), whole).otherwise(cluster)

    return F.when(F.rlike(text, F.lit(_HIGH)) & F.rlike(text, active), F.array_join(F.transform(clusters, fold), "")).otherwise(text)


@lru_cache(maxsize=1)
def _folds() -> dict[str, str]:
    """What full case folding makes of a character that it changes."""
    return {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c}


def _folded(text: Column) -> Column:
    """Full case folding: lower case, the frequent letters that fold on by themselves, the others by table where one occurs."""
    rules = _folds()
    low = F.lower(text)
    for c in "ßςſµ":
        low = F.replace(low, F.lit(c), F.lit(rules[c]))
    near = "".join(c for c in rules if ord(c) < 0x300 and c == c.lower() and c not in "ßςſµ")
    rest = F.lit(f"[{near}]|(?={_HIGH})[{_ranges([ord(c) for c in rules if ord(c) >= 0x300])}]")
    table = _map(rules)
    return let(low, lambda x: F.when(F.rlike(x, rest), F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")).otherwise(x))


#: White space but the blank, in Latin-1 and beyond.
_GAP = r"\x{9}\x{A}\x{B}\x{C}\x{D}\x{1C}\x{1D}\x{1E}\x{1F}\x{85}\x{A0}"
_WIDE_GAP = r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def canonical(text: Column) -> Column:
    """NFC, case-folded, runs of white space to one space, trimmed; null to empty."""
    text = F.coalesce(text, F.lit(""))
    active = F.lit(_unicode()[3]["active"])
    # the second turn is for texts with marks alone
    turns = F.aggregate(F.array(F.lit(0), F.lit(1)), text, lambda acc, i: F.when((i == 0) | (F.rlike(acc, F.lit(_HIGH)) & F.rlike(acc, active)), _folded(_composed(acc))).otherwise(acc))
    wide = F.regexp_replace(turns, rf"(?={_HIGH})[{_WIDE_GAP}]", " ")
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(wide)
    # a lone blank is no match, so most texts are not written anew word by word
    return F.trim(F.regexp_replace(folded, f" [ {_GAP}]+|[{_GAP}][ {_GAP}]*", " "))


def wide_digest(canon: Column) -> Column:
    """48 hex digits: three xxhash64 with different salts, the length in each."""
    size = F.char_length(canon)
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), canon, size))), 16, "0") for salt in (0, 1, 2)])


def fingerprint(text: Column) -> Column:
    return wide_digest(canonical(text))


def _several(prints: DataFrame) -> DataFrame:
    """Buckets of several rows: fingerprint, group_id, group_size. Partial aggregation leaves a hot one a row per partition."""
    return prints.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def _sieve(ids: DataFrame, bits: int) -> DataFrame:
    """(bucket, bits): which of ``bits`` hash values the doc_ids have; at most bits / 32768 rows of 4 KB, whatever the input."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    return ids.groupBy(F.bitmap_bucket_number(bit).alias("_vf_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_vf_bits"))


def _sifted(docs: DataFrame, sieve: DataFrame, bits: int) -> DataFrame:
    """The rows whose doc_id has its bit in the sieve: all that were put in and, the fuller it is, others."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("_vf_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return docs.join(F.broadcast(sieve), F.bitmap_bucket_number(bit) == F.col("_vf_bucket")).where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*docs.columns)


def grouped(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """``prints`` (a written table with doc_id and fingerprint) with group_id and group_size of its documents' texts.

    The texts of buckets with several rows are read again and grouped by their canonical bytes; a sieve of bounded size
    keeps most others from being read so (past some ten million copies more texts pass, at worst all). Only if a bucket
    holds different texts (one number reaches the driver) are those told apart row by row.
    """
    several = materialise(_several(prints), "buckets")
    out = materialise(salted_groups(prints, several, ["fingerprint"], "doc_id"), "groups")
    discard(prints)
    discard(several)
    texts = _sifted(docs.select("doc_id", "text"), _sieve(out.where("group_size IS NOT NULL").select("doc_id"), SIEVE), SIEVE)
    texts = texts.select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("fingerprint", wide_digest(F.col("canon")))
    kinds = texts.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    mixed = kinds.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("fingerprint")
    if not mixed.isEmpty():  # a 192-bit collision
        own = texts.join(kinds, ["fingerprint", "canon"]).join(mixed, "fingerprint", "left_semi").groupBy("doc_id", "fingerprint").agg(F.min("least").alias("_vf_least"), F.min("n").alias("_vf_n"))
        apart = own.withColumnsRenamed({"doc_id": "_vf_id", "fingerprint": "_vf_print"})
        columns = out.columns
        out = out.join(apart, F.col("doc_id").eqNullSafe(F.col("_vf_id")) & (F.col("fingerprint") == F.col("_vf_print")), "left")
        out = out.withColumns({"group_size": F.coalesce("_vf_n", "group_size"), "group_id": F.coalesce("_vf_least", "group_id")}).select(*columns)
    alone = F.col("group_size").isNull()
    return out.withColumns({"group_id": F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id (smallest doc_id of the group), group_size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return grouped(materialise(rows.select("doc_id", fingerprint(F.col("text")).alias("fingerprint")), "prints"), rows)


def _longs(xs: list[int]) -> Column:
    """A constant array that is one literal in the plan, however many partitions there are."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")


def _rank(limits: list[int], k: Column, inclusive: bool) -> Column:
    """How many of the sorted limits lie below k (or are equal, if inclusive); looks at about 2*sqrt(len) of them."""
    if not limits:
        return F.lit(0)
    below = (lambda c: c <= k) if inclusive else (lambda c: c < k)
    array = _longs
    step = max(1, int(len(limits) ** 0.5))
    coarse = F.size(F.filter(array(limits[step - 1 :: step]), below)) * step
    return coarse + F.size(F.filter(F.slice(array(limits), coarse + 1, F.lit(step)), below))


def with_next(docs: DataFrame, buckets: int | None = None, extra=None) -> DataFrame:
    """doc_id, text and next_text (null: empty) in the order of doc_id, without a global sort in one task.

    Ids are cut into ranges at quantiles; every range is sorted in its own task, and the first rows of a
    range are also sent to the range before it (the first of all to the last), where they only serve as
    the next of its last row. Only the range limits, at most ``buckets`` numbers, reach the driver. ``extra(text,
    next_text)`` gives a column ``own``, handed on with the next document's ``next_own``.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    keyed = docs.select("doc_id", order.alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ids = keyed.select("k")
    cuts = sorted(set(ids.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)] or [0.5], 10000)).first()[0] or []))
    bucket = _rank(cuts, F.col("k"), inclusive=False)
    firsts = [r[0] for r in ids.groupBy(bucket.alias("b")).agg(F.min("k").alias("m")).orderBy("b").select("m").collect()]
    placed = keyed.withColumn("b", _rank(firsts, F.col("k"), inclusive=True))  # 1-based; ranges without rows vanish
    starts = _longs(firsts or [0])
    own = F.struct(F.col("b").alias("b"), F.lit(0).alias("ghost"))
    before = F.struct(F.when(F.col("b") == 1, F.lit(max(1, len(firsts)))).otherwise(F.col("b") - 1).alias("b"), F.lit(1).alias("ghost"))
    copies = F.when(F.element_at(starts, F.col("b")) == F.col("k"), F.array(own, before)).otherwise(F.array(own))
    sent = placed.withColumn("c", F.explode(copies)).select("doc_id", "k", "text", F.col("c.b").alias("b"), F.col("c.ghost").alias("ghost"))
    window = Window.partitionBy("b").orderBy("ghost", "k", "text")
    rows = sent.withColumn("next_text", F.lead("text").over(window))
    if extra is not None:  # one more column and its next, without another shuffle or sort
        rows = rows.withColumn("own", extra(F.col("text"), F.col("next_text"))).withColumn("next_own", F.lead("own").over(window))
    return rows.where("ghost = 0").drop("b", "ghost", "k")


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of the following text (or all of it)."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def _prints(text: Column, following: Column) -> Column:
    """Of a text and its edit: both fingerprints and whether their canonical bytes are equal."""
    canon = F.transform(F.array(text, edited_text(text, F.coalesce(following, F.lit("")))), canonical)
    return let(canon, lambda c: F.struct(wide_digest(c[0]).alias("text"), wide_digest(c[1]).alias("edit"), (c[0] == c[1]).alias("same")))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, its text's and its edited text's fingerprint, how alike they and the
    next document's are, and its group (group_id: smallest doc_id with an equal canonical text, group_size)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_next(docs, extra=_prints)
    equal = let(F.transform(F.array("text", "next_text"), canonical), lambda c: c[0] == c[1])  # asked inside equal buckets only
    near = F.when(F.col("own.text") == F.col("next_own.text"), (F.col("text") == F.col("next_text")) | equal).otherwise(F.lit(False))
    prints = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(edited_text(F.col("text"), F.col("next_text")).cast("binary"), 256).alias("edited_sha256"),
        F.col("own.text").alias("fingerprint"),
        F.col("own.edit").alias("edited_fingerprint"),
        F.col("own.same").cast("double").alias("near_edited"),
        near.cast("double").alias("near_next"),
    )
    return grouped(materialise(prints, "prints"), docs)
