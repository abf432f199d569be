"""Rows to test results (FN-06..11, FLT-10/11, WIN-06..09, WIN-17/18, SET-07): array expressions, no Python.

Rows come in reading order: doc_id, page, reading_order, column_index, text, spans, source, y0, y1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import strip

_QUALIFIER = "|".join(C.QUALIFIERS)
_NUMERIC_VALUE = C.spaced(r"^([<>]?\s?\d+\.?\d*)\s*(.*)$")
_QUALIFIER_VALUE = rf"(?i)^({_QUALIFIER})\b"
_VALUE = C.spaced(rf"(?i)^[<>]?\s?\d+\.?\d*|^(?:{_QUALIFIER})\b")
_SINGLE = C.spaced(rf"(?i)^(.*?[A-Za-z\)\]].*?)\s+([<>]?\d+(?:\.\d+)?|{_QUALIFIER})(?:\s+(.*))?$")
TEST = "struct<name:string,value:string,unit:string,reference_range:string,flag:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), use)[0]


def _match(s: Column, pattern: str) -> Column:
    return F.rlike(s, F.lit(pattern))


# ------------------------------------------------------------ token predicates (FLT-11)
def is_value(t: Column) -> Column:
    return _match(t, _VALUE)


def is_range_token(t: Column) -> Column:
    return _match(t, C.PURE_RANGE_PATTERN) | (t.startswith("(") & t.endswith(")"))


def looks_like_flag(t: Column) -> Column:
    return F.lower(t).isin(*C.FLAG_WORDS)


def looks_like_unit(t: Column) -> Column:
    return _match(t, C.UNIT_SHAPE_PATTERN) & ~_match(t, f"^(?:{C.RANGE_PATTERN})$") & ~looks_like_flag(t)


def is_label_like(t: Column) -> Column:
    return _match(t, "^[A-Za-z(]") & ~is_value(t) & ~is_range_token(t)


def is_label_token(t: Column) -> Column:
    return _match(t, "^[A-Za-z]") & ~is_value(t) & ~is_range_token(t) & ~looks_like_flag(t) & ~_match(t, C.KNOWN_UNIT_PATTERN)


def is_rejected_label(label: Column) -> Column:
    """FLT-10: too long, prose, or report metadata."""
    lower = F.lower(label)
    prose = _match(lower, f"^(?:{'|'.join(C.PROSE_PREFIXES)})")
    markers = "|".join(rf"\Q{m}\E" for m in C.METADATA_MARKERS)
    return (F.length(label) > C.MAX_LABEL_CHARS) | prose | _match(lower, markers)


def unbalanced(label: Column) -> Column:
    count = lambda ch: F.length(label) - F.length(F.replace(label, F.lit(ch), F.lit("")))
    return count("(") > count(")")


# ------------------------------------------------------------------- tokens
def tokenize_spans(spans: Column) -> Column:
    """FN-06: tokens of all spans, split at wide gaps and dot leaders."""
    parts = F.flatten(F.transform(spans, lambda s: F.split(strip(s), C.TOKEN_SPLIT_PATTERN)))
    return F.filter(F.transform(parts, lambda p: strip(p, " .")), lambda p: p != "")


def expand_single(text: Column) -> Column:
    """FN-07, WIN-18: label, value and the rest of a row without wide gaps; null without a unit, range or qualifier to back it."""
    group = lambda g: F.regexp_extract(text, _SINGLE, g)
    joined = F.regexp_replace(strip(group(3)), C.spaced(r"(?<!\S)(\d+\.?\d*)\s+-\s+(\d+\.?\d*)(?!\S)"), "$1\u0001-\u0001$2")
    words = F.filter(F.transform(F.split(joined, C.spaced(r"\s+")), lambda w: F.replace(w, F.lit("\u0001"), F.lit(" "))), lambda w: w != "")

    def judge(merged: Column) -> Column:
        has_unit = F.coalesce(_match(F.try_element_at(merged, F.lit(1)), C.KNOWN_UNIT_PATTERN), F.lit(False))
        has_range = F.exists(merged, lambda w: _match(w, C.RANGE_PATTERN))
        qualifier = ~_match(group(2), r"^[\d<>]")
        ok = (has_unit | has_range) | (qualifier & (F.size(merged) == 0))
        return F.when(ok, F.concat(F.array(strip(group(1)), group(2)), merged))

    return F.when(_match(text, _SINGLE), let(words, judge))


def expanded(tokens: Column) -> Column:
    """Tokens of a row; a single one is expanded; null if that fails or there is none."""
    return F.when(F.size(tokens) == 1, expand_single(tokens[0])).when(F.size(tokens) > 1, tokens)


# --------------------------------------------------------------------- tests
def value_index(tokens: Column) -> Column:
    """FN-09: 1-based place of the first value-shaped token, 0 if none."""
    return F.array_position(F.transform(tokens, is_value), True).cast("int")


def _roles(rest: Column, unit: Column) -> Column:
    """FN-10: what the tokens after the value are; each token takes the first role that is still free, in the order range, unit, flag."""
    state = "struct<rng:string,unit:string,flag:string>"
    bare = lambda t: F.coalesce(F.nullif(F.regexp_replace(t, r"^[=~_|—– ]+", ""), F.lit("")), t)

    def step(s: Column, t: Column) -> Column:
        as_range = s["rng"].isNull() & _match(t, C.RANGE_PATTERN)
        as_unit = ~as_range & s["unit"].isNull() & looks_like_unit(t)
        as_flag = ~as_range & ~as_unit & s["flag"].isNull() & looks_like_flag(t)
        return F.struct(
            F.when(as_range, bare(t)).otherwise(s["rng"]).alias("rng"), F.when(as_unit, t).otherwise(s["unit"]).alias("unit"), F.when(as_flag, t).otherwise(s["flag"]).alias("flag")
        )

    none = F.lit(None).cast("string")
    return F.aggregate(rest, F.struct(none.alias("rng"), unit.alias("unit"), none.alias("flag")).cast(state), step)


def test_of(tokens: Column) -> Column:
    """FN-08, FN-10, WIN-17: the test of a row's tokens, or null if its label is rejected or it has no value."""

    def build(label: Column, rest: Column, at: Column) -> Column:
        token = F.try_element_at(rest, at)
        qualifier = F.nullif(F.regexp_extract(token, _QUALIFIER_VALUE, 1), F.lit(""))
        numeric = F.nullif(F.regexp_extract(token, _NUMERIC_VALUE, 1), F.lit(""))
        value = F.coalesce(F.regexp_replace(F.replace(numeric, F.lit(" "), F.lit("")), r"\.+$", ""), qualifier)
        unit = F.when(numeric.isNotNull(), F.nullif(strip(F.regexp_extract(token, _NUMERIC_VALUE, 2)), F.lit("")))
        roles = _roles(F.slice(rest, at + 1, F.size(rest)), unit)
        return let(
            roles,
            lambda r: F.struct(label.alias("name"), value.alias("value"), r["unit"].alias("unit"), r["rng"].alias("reference_range"), r["flag"].alias("flag")),
        )

    def whole(t: Column) -> Column:
        label, rest = t[0], F.slice(t, 2, F.size(t))
        at = value_index(rest)
        extra = F.slice(rest, F.lit(1), F.greatest(at - 1, F.lit(0)))
        joins = (at > 1) & F.forall(extra, is_label_like) & (unbalanced(label) | _match(F.try_element_at(extra, F.lit(1)), r"^\p{Ll}"))
        full = F.when(joins, F.concat_ws(" ", label, F.array_join(extra, " "))).otherwise(label)
        return F.when(~is_rejected_label(label) & (at > 0), build(full, rest, at))

    return F.when(F.size(tokens) > 1, let(tokens, whole))


def records_of(tokens: Column) -> Column:
    """WIN-09: the records of a recognised line: a label opens a new one as soon as the current one has a value."""
    state = "struct<done:array<struct<label:string,rest:array<string>>>,label:string,rest:array<string>>"
    empty = F.array().cast("array<string>")

    def step(s: Column, t: Column) -> Column:
        label, rest = s["label"], s["rest"]
        opens, has_value = is_label_token(t), F.exists(rest, is_value)
        keep = lambda lab, r: F.struct(s["done"].alias("done"), lab.alias("label"), r.alias("rest"))
        fresh = F.struct(F.concat(s["done"], F.array(F.struct(label.alias("label"), rest.alias("rest")))).alias("done"), t.alias("label"), empty.alias("rest"))
        return (
            F.when(label.isNull(), F.when(opens, keep(t, empty)).otherwise(s))
            .when(opens & has_value, fresh)
            .when(opens & (F.size(rest) == 0), keep(F.concat_ws(" ", label, t), rest))
            .otherwise(keep(label, F.concat(rest, F.array(t))))
        )

    start = F.struct(F.array().alias("done"), F.lit(None).alias("label"), empty.alias("rest")).cast(state)
    return F.aggregate(
        tokens, start, step,
        lambda s: F.when(s["label"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["label"].alias("label"), s["rest"].alias("rest"))))),
    )


def row_tests(spans: Column, source: Column) -> Column:
    """FN-11: array of the row's tests: at most one, or the records of a recognised line."""
    return let(tokenize_spans(spans), lambda t: token_tests(t, source))


def token_tests(tokens: Column, source: Column) -> Column:
    """``row_tests`` of a row's tokens. A value has a digit or is a qualifier, so rows without either are left alone."""
    none = F.array().cast(f"array<{TEST}>")

    def tests(t: Column) -> Column:
        one = let(test_of(t), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(none))
        many = F.filter(F.transform(records_of(t), lambda r: test_of(F.concat(F.array(r["label"]), r["rest"]))), lambda x: x.isNotNull())
        return F.when(source == "ocr", many).otherwise(one)

    may = F.exists(tokens, lambda t: _match(t, rf"(?i)\d|{_QUALIFIER}"))
    return F.when(may, let(expanded(tokens), lambda t: F.when(t.isNull(), none).otherwise(tests(t)))).otherwise(none)


# --------------------------------------------------------------------- pages
def parse_pages(rows: DataFrame) -> DataFrame:
    """All tests of all pages: doc_id, page, reading_order, test_idx, name, value, unit, reference_range, flag, specimen, confidence.

    WIN-06: a declared specimen holds until the next one. WIN-07: a label alone above a value alone is a test. WIN-08: a label
    line left open is put before the next line's lower-case label. All windows share one shuffle by (doc_id, page).
    """
    page = Window.partitionBy("doc_id", "page").orderBy("reading_order")
    before = page.rowsBetween(Window.unboundedPreceding, 0)
    specimen = strip(F.nullif(F.regexp_extract("text", C.SPECIMEN_PATTERN, 1), F.lit("")))
    # the first window sorts the page, so it comes before the rows get their tokens and tests
    rows = rows.withColumn("specimen", F.last(F.nullif(specimen, F.lit("")), ignorenulls=True).over(before))
    rows = rows.withColumn("_tokens", tokenize_spans(F.col("spans"))).withColumn("_tests", token_tests(F.col("_tokens"), F.col("source")))
    own = F.size("_tests") > 0
    first = F.try_element_at("_tokens", F.lit(1))
    alone = F.size("_tokens") == 1
    label_only = ~own & alone & ~is_value(first) & ~is_rejected_label(first) & (F.length(first) >= 2)
    rows = rows.withColumns(
        {
            "_own": own,
            "_label": F.coalesce(label_only, F.lit(False)),
            "_value": F.coalesce(~own & is_value(first), F.lit(False)),
            "_open": F.when(~own & alone & unbalanced(first), first),
        }
    )
    prev = lambda c: F.lag(c).over(page)
    same_column = F.col("column_index").eqNullSafe(prev("column_index"))
    height = F.greatest(prev("y1") - prev("y0"), F.lit(1e-6))
    follows = F.col("_label") & prev("_label") & same_column & (F.col("y0") - prev("y0") <= C.STACK_GAP_FACTOR * height)
    pairs = F.col("_value") & F.coalesce(prev("_label"), F.lit(False)) & same_column
    rows = rows.withColumns({"_start": F.when(F.coalesce(follows, F.lit(False)) | pairs, 0).otherwise(1), "_pairs": pairs, "_dangling": prev("_open")})
    rows = rows.withColumn("_run", F.sum("_start").over(before))
    title = strip(F.regexp_replace(strip(F.col("text")), ":+$", ""))
    run = Window.partitionBy("doc_id", "page", "_run").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_above", F.array_join(F.collect_list(F.when(F.col("_label"), title)).over(run), " "))
    stacked = let(F.when(F.col("_pairs"), test_of(F.concat(F.array("_above"), "_tokens"))), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(F.array().cast(f"array<{TEST}>")))

    def prefixed(x: Column, i: Column) -> Column:
        joins = (i == 0) & F.col("_dangling").isNotNull() & _match(x["name"], r"^\p{Ll}")
        return x.withField("name", F.when(joins, F.concat_ws(" ", "_dangling", x["name"])).otherwise(x["name"]))

    tests = F.when(F.col("_own"), F.transform("_tests", prefixed)).when(F.col("_pairs"), stacked)
    out = rows.select("doc_id", "page", "reading_order", "specimen", F.posexplode(tests).alias("test_idx", "t"))
    return out.select("doc_id", "page", "reading_order", "test_idx", "t.*", "specimen", F.lit(C.PARSE_CONFIDENCE).alias("confidence"))


#: A test as an extractor's answer names it.
SAID = "original_test_name string, value string, unit string, reference_range string, specimen string, method string, timing string, flag string, extraction_confidence double"


def answered_tests(answers: DataFrame, said: str = "said") -> tuple[DataFrame, DataFrame]:
    """SRC-20, FN-27: extractors' answers to (rows of tests, answers that are none).

    An answer is a JSON object, perhaps with fences or chatter around it, whose tests each have a name and a confidence from 0 to 1; one bad
    test spoils its page, which the caller then reads locally. Rows keep the answers' other columns, with test_idx; an answer without
    tests is good and gives no rows.
    """
    from ..functions.text import lenient_json

    body = F.from_json(lenient_json(F.col(said)), f"tests array<struct<{SAID.replace(', ', ',').replace(' ', ':')}>>, page_notes string")
    bad = F.exists(F.coalesce("_b.tests", F.array().cast(f"array<struct<{SAID.replace(', ', ',').replace(' ', ':')}>>")), lambda t: t["original_test_name"].isNull() | ~F.coalesce(t["extraction_confidence"].between(0, 1), F.lit(False)))
    read = answers.withColumn("_b", body).withColumn("_bad", F.col("_b").isNull() | bad)
    kept = [c for c in answers.columns if c != said]
    tests = read.where("NOT _bad").select(*kept, F.col("_b.page_notes").alias("page_notes"), F.posexplode("_b.tests").alias("test_idx", "t")).select(*kept, "test_idx", "t.*", "page_notes")
    return tests, read.where("_bad").select(*answers.columns)
