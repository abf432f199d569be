"""Sanity checks of parsed rows (FN-12..FN-19, FLT-13/14): notes, a suggestion and a confidence; values never change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .text import clean, standardize_unit, strip


def parse_range(text: Column) -> Column:
    """FN-12: struct(lo, hi) of the first 'number - number' with lo < hi, else null."""
    lo = F.nullif(F.regexp_extract(text, C.spaced(r"(\d+\.?\d*)\s*-\s*(\d+\.?\d*)"), 1), F.lit("")).try_cast("double")
    hi = F.nullif(F.regexp_extract(text, C.spaced(r"(\d+\.?\d*)\s*-\s*(\d+\.?\d*)"), 2), F.lit("")).try_cast("double")
    return F.when(lo < hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def number(value: Column) -> Column:
    """FN-13: the number that the whole trimmed value is, a leading < or > allowed; else null."""
    return F.nullif(F.regexp_extract(strip(value), C.spaced(r"^[<>]?\s?(\d+\.?\d*)$"), 1), F.lit("")).try_cast("double")


def suggest_decimal_fix(value: Column, reference_range: Column) -> Column:
    """FN-14: what the value was if a decimal point got lost and exactly one place for it is plausible, else null."""
    return decimal_fix(value, number(value), parse_range(reference_range))


def decimal_fix(value: Column, n: Column, rng: Column) -> Column:
    """``suggest_decimal_fix`` on a parsed number and range."""
    fits = {k: (n / k >= rng["lo"] * C.SUGGESTION_BAND[0]) & (n / k <= rng["hi"] * C.SUGGESTION_BAND[1]) for k in (10.0, 100.0, 1000.0)}
    once = sum((f.cast("int") for f in fits.values()), F.lit(0)) == 1
    fixed = F.coalesce(*[F.when(f, n / k) for k, f in fits.items()])
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", fixed), "0+$", ""), r"\.$", "")
    suspect = ~F.contains(value, F.lit(".")) & (n >= rng["hi"] * C.SUSPECT_FACTOR)
    return F.when(suspect & once, text)


def flag_conflicts(flag: Column, n: Column, rng: Column) -> Column:
    """FN-15: the printed flag contradicts value and range; false where one is missing."""
    f = F.lower(strip(flag))
    wrong = (
        (f.isin("normal", "n") & ~((n >= rng["lo"]) & (n <= rng["hi"])))
        | (f.isin("h", "high") & (n <= rng["hi"]))
        | (f.isin("l", "low") & (n >= rng["lo"]))
    )
    return F.coalesce(wrong, F.lit(False))


def unit_recognized(unit: Column) -> Column:
    """FN-16: no unit, a known unit, or known/known (powers of ten count as known)."""
    return F.when(F.coalesce(unit, F.lit("")) == "", F.lit(True)).otherwise(known_unit(plain_unit(unit)))


def plain_unit(unit: Column) -> Column:
    """The standard form in lower case; null: empty."""
    return F.lower(strip(F.coalesce(standardize_unit(unit), F.lit(""))))


def known_unit(std: Column) -> Column:
    """FN-16 on a plain unit: one pattern, so that it is matched once."""
    quoted = lambda xs: "|".join(rf"\Q{x}\E" for x in sorted(xs))
    words = {v.lower() for v in C.UNIT_VARIANTS.values()} | set(C.UNIT_WORDS)
    power = r"x?10[*^]?\d+|10[²³⁰-⁹]"
    return F.rlike(std, F.lit(rf"^(?:{quoted(words)}|(?:{quoted(C.UNIT_NUMERATORS)}|{power})/(?:{quoted(C.UNIT_DENOMINATORS)}|{power}))$"))


def label_variants(label: Column) -> Column:
    """FN-17: the label with all of one confusable character swapped for its partner, in the fixed order."""
    return F.array(*[F.replace(label, F.lit(x), F.lit(y)) for a, b in C.CONFUSABLE for x, y in ((a, b), (b, a))])


def junk_label(label: Column, known: Column) -> Column:
    """FLT-13: no word of four letters, no known short name and not shaped like an abbreviation."""
    compact = F.regexp_replace(label, "[+-]", "")
    shaped = (
        ~F.contains(label, F.lit(" ")) & F.length(label).between(3, 6) & F.rlike(compact, F.lit(r"^[\p{L}\p{N}]+$")) & F.rlike(label, F.lit(r"\p{Lu}"))
    )
    return ~F.rlike(label, F.lit("[A-Za-z]{4}")) & ~F.coalesce(known, F.lit(False)) & ~shaped


def correct_labels(rows: DataFrame, short_names: DataFrame, key: str = "row_id") -> DataFrame:
    """FN-17, JOIN-14: adds known (the label is a known short name) and corrected_label (first variant that is one).

    ``short_names`` has one column, name, cleaned and distinct. The variants of a row are marked by one equi-join.
    """
    names = short_names.select(F.col("name").alias("_known"))
    tried = rows.select(key, F.posexplode(F.concat(F.array("original_test_name"), label_variants(F.col("original_test_name")))).alias("pos", "variant"))
    marked = tried.join(names, clean(F.col("variant")) == F.col("_known")).groupBy(key).agg(
        F.max(F.col("pos") == 0).alias("known"),
        F.min(F.when(F.col("pos") > 0, F.struct("pos", "variant")))["variant"].alias("fixed"),
    )
    out = rows.join(marked, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return out.withColumn("corrected_label", F.when(~F.col("known") & (F.col("fixed") != F.col("original_test_name")), F.col("fixed"))).drop("fixed")


def validate_rows(rows: DataFrame) -> DataFrame:
    """FN-18, FN-19, FLT-14: adds notes, suggested_value, confidence, dropped, bad_unit and bad_flag.

    Needs original_test_name, value, unit, reference_range, flag, extraction_confidence, ocr; uses known and
    corrected_label where ``correct_labels`` has added them.
    """
    if "corrected_label" not in rows.columns:
        rows = rows.withColumns({"known": F.lit(None).cast("boolean"), "corrected_label": F.lit(None).cast("string")})
    ocr, name = F.coalesce(F.col("ocr"), F.lit(False)), F.col("original_test_name")
    value, unit, rng_text, flag = (F.col(c) for c in ("value", "unit", "reference_range", "flag"))
    fixed = F.when(ocr, F.col("corrected_label"))
    # what several checks use is computed once per row
    rows = rows.withColumns({"_n": number(value), "_rng": parse_range(rng_text), "_std": plain_unit(unit)})
    rows = rows.withColumn("bad_unit", (F.coalesce(unit, F.lit("")) != "") & ~known_unit(F.col("_std")))
    rows = rows.withColumns({"_hint": decimal_fix(value, F.col("_n"), F.col("_rng")), "bad_flag": flag_conflicts(flag, F.col("_n"), F.col("_rng"))})
    n, hint = F.col("_n"), F.col("_hint")
    junk = ocr & fixed.isNull() & junk_label(name, F.col("known"))
    bare = ocr & ~junk & F.coalesce(F.rlike(strip(unit), F.lit(r"^[<>]?\d+\.?\d*$")), F.lit(False))
    text_value = n.isNull() & value.isNotNull() & ~F.rlike(value, F.lit(r"^[A-Za-z][A-Za-z \-]*$"))
    bad_unit, bad_flag = F.col("bad_unit"), F.col("bad_flag")
    show = lambda c: F.coalesce(c, F.lit("None"))
    first = F.when(fixed.isNotNull(), F.format_string("label '%s' looks like an OCR misread of '%s'; corrected", name, fixed))
    checks = F.array(
        first,
        F.when(text_value, F.format_string("value '%s' is not a number or a recognized result", value)),
        F.when(hint.isNotNull(), F.format_string("value %s is far above the printed range %s; possible lost decimal point (did you mean %s?)", value, rng_text, hint)),
        F.when(bad_unit, F.format_string("unit '%s' is not recognized (possible OCR error)", unit)),
        F.when(bad_flag, F.format_string("printed flag '%s' disagrees with value %s vs range %s", flag, show(value), show(rng_text))),
    )
    dropped_notes = F.array(first, F.when(junk, F.lit("label does not look like a test name")), F.when(bare, F.lit("unit is a bare number (gauge/graphic noise)")))
    cost = (
        F.when(text_value, C.PENALTY_NOTE).otherwise(0.0) + F.when(hint.isNotNull(), C.PENALTY_DECIMAL).otherwise(0.0)
        + F.when(bad_unit, C.PENALTY_UNIT).otherwise(0.0) + F.when(bad_flag, C.PENALTY_FLAG).otherwise(0.0)
    )
    base = F.col("extraction_confidence")
    return rows.withColumns(
        {
            "notes": F.array_compact(F.when(junk | bare, dropped_notes).otherwise(checks)),
            "suggested_value": F.when(~(junk | bare), hint),
            "confidence": F.when(junk | bare, base).otherwise(F.round(F.greatest(F.lit(C.MIN_CONFIDENCE), F.least(F.lit(1.0), base - cost)), 2)),
            "dropped": junk | bare,
        }
    ).drop("_n", "_rng", "_std", "_hint")
