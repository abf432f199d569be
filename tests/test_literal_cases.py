"""Literal rows, pages, words, labels and runs with the results that they must give."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tests.conftest import same_rows
from vialframe.functions import text as X
from vialframe.functions import validate as V
from vialframe.operators import evaluate, layout, mapping, parse, retrieval

CASES: dict[str, tuple] = {}


def query(sql: str):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


def _lit(v) -> str:
    return "NULL" if v is None else ("true" if v is True else "false" if v is False else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'")


@query("SELECT * FROM (VALUES (1, 'Iron', 'Serum', 'Photometry'), (2, 'Iron', NULL, NULL), (3, '', NULL, 'x')) v(id, name, specimen, method)")
def text_queries(spark: SparkSession, d: str) -> DataFrame:
    """SRT-09: the text form of a question."""
    rows = spark.createDataFrame([(1, "Iron | specimen: Serum | Photometry"), (2, "Iron"), (3, " | x | specimen: ")], "id int, t string")
    return rows.select("id", retrieval.text_query(F.col("t")).alias("q")).select("id", "q.name", "q.specimen", "q.method")


@query(
    "SELECT * FROM (VALUES (0, 'confirmed', '1-1', 0.9::DOUBLE, 'good'), (1, 'needs_review', '2-2', 0.4::DOUBLE, 'so-so'), (2, 'needs_review', NULL, 0.9::DOUBLE, 'Model chose a LOINC code outside the candidate list; discarded.'), "
    "(3, 'unmapped', NULL, 0.0::DOUBLE, 'No candidate judged reliable.'), (4, 'unmapped', NULL, 0.0::DOUBLE, 'No verdict returned.')) v(i, mapping_status, loinc_code, mapping_confidence, mapping_rationale)"
)
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """FLT-17, JOIN-11: verdicts out of order, outside the list, unsure, empty and missing."""
    hits = F.array(*[F.struct(F.lit(c).alias("loinc_num"), F.lit(f"name {c}").alias("long_common_name")) for c in ("1-1", "2-2")])
    given = spark.createDataFrame([(3, None, None, None), (1, "2-2", "0.4", "so-so"), (0, "1-1", "0.9", "good"), (2, "9-9", "0.9", "x")], "i int, chosen_loinc_num string, confidence string, rationale string")
    rows = spark.range(5).select(F.col("id").cast("int").alias("i")).join(given.select("i", F.struct("chosen_loinc_num", "confidence", "rationale").alias("v")), "i", "left")
    none = F.struct(F.lit(None).cast("string").alias("chosen_loinc_num"), F.lit(None).cast("string").alias("confidence"), F.lit("No verdict returned.").alias("rationale"))
    return rows.select("i", mapping.verdict_result(F.lit("n"), hits, F.coalesce("v", none)).alias("r")).select("i", "r.mapping_status", "r.loinc_code", "r.mapping_confidence", "r.mapping_rationale")


_SECRETS = [
    (1, "key AIzaSyA1234567890abcdefghijk end", "key [REDACTED] end"),
    (2, "token sk-abcdefghij0123456789 x", "token [REDACTED] x"),
    (3, "Authorization: Bearer abcdefghijklmnop123", "Authorization: Bearer [REDACTED]"),
    (4, "X-API-Key: s3cret, next", "X-API-Key: [REDACTED], next"),
    (5, "https://x.test/?api_key=abcdefgh123&b=1", "https://x.test/?api_key=[REDACTED]&b=1"),
    (6, "nothing here", "nothing here"),
]


@query(f"SELECT * FROM (VALUES {', '.join(f"({i}, '{r}')" for i, _, r in _SECRETS)}) v(id, redacted)")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    """FN-28."""
    return spark.createDataFrame([(i, s) for i, s, _ in _SECRETS], "id int, s string").select("id", X.redact(F.col("s")).alias("redacted"))


#: (case, name, value, unit, range, flag, ocr) -> (suggestion, notes, dropped, corrected)
_CASES = [
    (1, "WBC Count", "715", "10*3/uL", "4 - 11 10³/mm³", None, False, "7.15", 1, False, None),
    (2, "WBC Count", "109", "10*3/uL", "11.5 - 16.5", None, False, "10.9", 1, False, None),
    (3, "WBC Count", "46", "10*3/uL", "3.7 - 5.6", None, False, "4.6", 1, False, None),
    (4, "WBC Count", "420", "10*3/uL", "150-450", None, False, None, 0, False, None),
    (5, "WBC Count", "71.5", "10*3/uL", "4 - 11", None, False, None, 0, False, None),
    (6, "WBC Count", "715", "10*3/uL", None, None, False, None, 0, False, None),
    (7, "WBC Count", "Negative", "10*3/uL", "4 - 11", None, False, None, 0, False, None),
    (8, "WBC Count", "7.2", "ror", "4 - 11", None, False, None, 1, False, None),
    (9, "WBC Count", "7.2", "o/at", "4 - 11", None, False, None, 1, False, None),
    (10, "WBC Count", "7.2", "mm/hr", "4 - 11", None, False, None, 0, False, None),
    (11, "WBC Count", "9", "10*3/uL", "4-5", "Normal", False, None, 1, False, None),
    (12, "WBC Count", "4.5", "10*3/uL", "4-5", "Normal", False, None, 0, False, None),
    (13, "eee Ol", "7.2", "10*3/uL", "4 - 11", None, True, None, 1, True, None),
    (14, "eee Ol", "7.2", "10*3/uL", "4 - 11", None, False, None, 0, False, None),
    (15, "pH", "7.2", None, "4 - 11", None, True, None, 0, False, None),
    (16, "C02", "7.2", None, "4 - 11", None, True, None, 1, False, "CO2"),
    (17, "ciel", "0.0", "150.0", None, None, True, None, 1, True, None),
    (18, "Platelet Count", "7.2", "Million/ul", "4 - 11", None, True, None, 0, False, None),
    (19, "WBC Count", "7.2", "uIU/mL", "4 - 11", None, False, None, 1, False, None),
]


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(_lit(x) for x in (c[0], *c[7:])) + ')' for c in _CASES)}) v(row_id, suggested_value, n_notes, dropped, corrected_label)")
def validation_cases(spark: SparkSession, d: str) -> DataFrame:
    """FN-14..18, FLT-13/14, JOIN-14: literal cases."""
    rows = spark.createDataFrame([(*c[:7], 0.65) for c in _CASES], "row_id int, original_test_name string, value string, unit string, reference_range string, flag string, ocr boolean, extraction_confidence double")
    names = spark.createDataFrame([(n,) for n in ("wbc", "ph", "na", "co2", "tsh", "a1c")], "name string")
    out = V.validate_rows(V.correct_labels(rows, names))
    return out.select("row_id", "suggested_value", F.size("notes").alias("n_notes"), "dropped", F.when(F.col("ocr"), F.col("corrected_label")).alias("corrected_label"))


#: (case, text) -> (tokens, unit, blank, short): tabs, no-break, ideographic and zero-margin blanks.
_BLANKS = [
    (1, "WBC\u00a0\u00a0\u00a06.8\u00a0\u00a0g/dL", "WBC|6.8|g/dL", "WBC\u00a0\u00a0\u00a06.8\u00a0\u00a0g/dL", False, "WBC 6.8 g/dL"),
    (2, "\tgm/dl\u3000", "gm/dl", "g/dL", False, "gm/dl"),
    (3, "\n\u2003 \u00a0", "", None, True, ""),
    (4, "Iron\t\t70\u2009\u2009ug/dL", "Iron|70|ug/dL", "Iron\t\t70\u2009\u2009ug/dL", False, "Iron 70 ug/dL"),
    (5, "[ \u00a0]\u00a0mg/dL\x1f", "[|]\u00a0mg/dL", "mg/dL", False, "[ ] mg/dL"),
]


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(_lit(x) for x in (c[0], *c[2:])) + ')' for c in _BLANKS)}) v(id, tokens, unit, blank, short)")
def white_space(spark: SparkSession, d: str) -> DataFrame:
    """FN-02, FN-06, FN-21, FN-25: white space of all kinds strips, splits and collapses."""
    rows = spark.createDataFrame([c[:2] for c in _BLANKS], "id int, t string")
    t = F.col("t")
    return rows.select("id", F.array_join(parse.tokenize_spans(F.array(t)), "|").alias("tokens"), X.standardize_unit(t).alias("unit"), X.blank_to_null(t).isNull().alias("blank"), X.short(t).alias("short"))


#: (case, spans, source) -> expected tests as (name, value, unit, range, flag)
_ROWS = [
    (1, ["WBC                      6.8         10*3/uL     4.0-11.0"], "digital", [("WBC", "6.8", "10*3/uL", "4.0-11.0", None)]),
    (2, ["MCH(Calculated)", "24 pg", "26 - 32 pg", "Normal"], "digital", [("MCH(Calculated)", "24", "pg", "26 - 32 pg", "Normal")]),
    (3, ["Free T4", "Normal"], "digital", [("Free T4", "Normal", None, None, None)]),
    (4, ["Protein", "Negative"], "digital", [("Protein", "Negative", None, None, None)]),
    (5, ["RA FACTOR", "<11.2 IU/mL"], "digital", [("RA FACTOR", "<11.2", "IU/mL", None, None)]),
    (6, ["LRN", ": 12109545"], "digital", []),
    (7, ["Patient Name", ": X 12"], "digital", []),
    (8, ["Iron 70 ug/dL 50-170"], "digital", [("Iron", "70", "ug/dL", "50-170", None)]),
    (9, ["Page 1 of 2"], "digital", []),
    (10, ["Total Cholesterol .......... 210 mg/dL"], "digital", [("Total Cholesterol", "210", "mg/dL", None, None)]),
    (11, ["Neutrophils", "57", "%", "40 - 80", "MCH", "24", "pg", "26 - 32"], "ocr", [("Neutrophils", "57", "%", "40 - 80", None), ("MCH", "24", "pg", "26 - 32", None)]),
    (12, ["Iron 70 ug/dL 50 - 170 extra"], "digital", [("Iron", "70", "ug/dL", "50 - 170", None)]),
    (13, ["MCV (Pulse height (Derived", "from RBC histogram))", "81", "fl"], "digital", [("MCV (Pulse height (Derived from RBC histogram))", "81", "fl", None, None)]),
    (14, ["Urobilinogen negative"], "digital", [("Urobilinogen", "negative", None, None, None)]),
]


@query(
    "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(_lit(x) for x in (case, i, *t)) + ")" for case, _, _, tests in _ROWS for i, t in enumerate(tests))
    + ") v(case_id, test_idx, name, value, unit, reference_range, flag)"
)
def row_parsing(spark: SparkSession, d: str) -> DataFrame:
    """FN-06..11, FLT-10/11, WIN-09/17/18: literal rows."""
    rows = spark.createDataFrame([(c, s, src) for c, s, src, _ in _ROWS], "case_id int, spans array<string>, source string")
    tests = rows.select("case_id", F.posexplode(parse.row_tests(F.col("spans"), F.col("source"))).alias("test_idx", "t"))
    return tests.select("case_id", "test_idx", "t.*")


#: Pages of (doc, page, rows of (text, y0, y1)) -> tests (doc, page, row, name, value, specimen).
_PAGES = [
    ("urine", 1, [("URINALYSIS", 0.1, 0.12), ("Specimen: Urine", 0.13, 0.15), ("Glucose      Negative", 0.2, 0.22), ("Protein      Trace", 0.23, 0.25), ("Specimen: Serum", 0.3, 0.32), ("Iron    70    ug/dL", 0.33, 0.35)]),
    ("cards", 1, [("Serum Urea", 0.20, 0.215), ("38.5 mg/dl", 0.225, 0.24)]),
    ("wrapped", 1, [("Absolute count", 0.208, 0.220), ("of cells", 0.223, 0.235), ("12 %", 0.240, 0.252)]),
    ("title", 1, [("Some title", 0.173, 0.185), ("Serum Urea", 0.221, 0.233), ("38.5", 0.238, 0.250)]),
    ("dangling", 1, [("MCV (Pulse height (Derived", 0.1, 0.12), ("from RBC histogram))    81    fl", 0.13, 0.15)]),
]


_PAGE_TESTS = [
    ("urine", 1, 2, "Glucose", "Negative", "Urine"), ("urine", 1, 3, "Protein", "Trace", "Urine"), ("urine", 1, 5, "Iron", "70", "Serum"),
    ("cards", 1, 1, "Serum Urea", "38.5", None), ("wrapped", 1, 2, "Absolute count of cells", "12", None), ("title", 1, 2, "Serum Urea", "38.5", None),
    ("dangling", 1, 1, "MCV (Pulse height (Derived from RBC histogram))", "81", None),
]


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(_lit(x) for x in t) + ')' for t in _PAGE_TESTS)}) v(doc_id, page, reading_order, name, value, specimen)")
def page_parsing(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06, WIN-07, WIN-08: literal pages."""
    rows = [(doc, page, i, 0, t, [t], "digital", y0, y1) for doc, page, lines in _PAGES for i, (t, y0, y1) in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id string, page int, reading_order int, column_index int, text string, spans array<string>, source string, y0 double, y1 double")
    return parse.parse_pages(df).select("doc_id", "page", "reading_order", "name", "value", "specimen")


#: Lines (doc, idx, text, x0, y0, x1, y1, font) and the rows they make (doc, order, column, text).
_LINES = [
    ("single", 0, "A", 0.1, 0.10, 0.2, 0.12, 10.0), ("single", 1, "1", 0.5, 0.10, 0.6, 0.12, 10.0), ("single", 2, "B", 0.1, 0.2, 0.2, 0.22, 10.0),
    ("two", 0, "top", 0.1, 0.02, 0.2, 0.04, 10.0), ("two", 1, "Left", 0.05, 0.10, 0.25, 0.12, 12.0), ("two", 2, "Right", 0.55, 0.10, 0.85, 0.12, 12.0),
    ("two", 3, "l1", 0.05, 0.20, 0.1, 0.22, 10.0), ("two", 4, "r1", 0.55, 0.21, 0.6, 0.23, 10.0), ("two", 5, "l2", 0.05, 0.30, 0.1, 0.32, 10.0), ("two", 6, "5", 0.2, 0.31, 0.3, 0.33, 10.0),
    ("label", 0, "Hemoglobin", 0.1, 0.10, 0.3, 0.16, 12.0), ("label", 1, "10.9", 0.4, 0.10, 0.5, 0.12, 18.0), ("label", 2, "11-16", 0.6, 0.10, 0.7, 0.115, 10.0), ("label", 3, "g/dl", 0.8, 0.14, 0.9, 0.15, 10.0),
]


_LINE_ROWS = [
    ("single", 0, 0, "A 1"), ("single", 1, 0, "B"), ("two", 0, 0, "top"), ("two", 1, 1, "Left"), ("two", 2, 1, "l1"), ("two", 3, 1, "l2 5"), ("two", 4, 2, "Right"), ("two", 5, 2, "r1"),
    ("label", 0, 0, "Hemoglobin 10.9 11-16 g/dl"),
]


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(_lit(x) for x in t) + ')' for t in _LINE_ROWS)}) v(doc_id, reading_order, column_index, text)")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01..05, JOIN-08, FLT-15, AGG-09, SET-07: literal pages."""
    rows = spark.createDataFrame([(x[0], 1, *x[1:], [x[2]], "digital") for x in _LINES], "doc_id string, page int, line_idx int, text string, x0 double, y0 double, x1 double, y1 double, max_font double, spans array<string>, source string")
    return layout.reading_order(rows).select("doc_id", "reading_order", "column_index", "text")


@query("SELECT * FROM (VALUES ('a', 0, ['Sodium', '140 mmol/L'], 0.9::DOUBLE), ('a', 1, ['K'], 0.8::DOUBLE)) v(doc_id, line_idx, spans, confidence)")
def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC-21, FLT-12, WIN-10, AGG-10, SRT-05: literal recognised words."""
    rows = [
        ("a", 1, 1, 1, 1, 10, 10, 50, 10, "Sodium", 90), ("a", 1, 1, 1, 1, 100, 10, 20, 10, "140", 95), ("a", 1, 1, 1, 1, 124, 10, 30, 10, "mmol/L", 85),
        ("a", 1, 1, 1, 1, 200, 10, 5, 10, "~", 5), ("a", 1, 1, 1, 1, 220, 10, 5, 10, " ", 90), ("a", 1, 2, 1, 1, 10, 40, 10, 10, "K", 80),
    ]
    words = spark.createDataFrame([(*r, 1000, 1000) for r in rows], "doc_id string, page int, block_num int, par_num int, line_num int, left int, top int, width int, height int, text string, conf int, page_width int, page_height int")
    return layout.ocr_lines(words).select("doc_id", "line_idx", "spans", F.round("confidence", 6).alias("confidence"))


@query("SELECT * FROM (VALUES ('healthy', 1), ('none', 2)) v(doc_id, attempt)")
def best_attempt(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11, ORC-05, SRT-07: the first healthy attempt, else the best score."""
    rows = [("healthy", 1, 0, 0.7, 0, None, None), ("healthy", 1, 1, 0.9, 0, "g", "1-2"), ("healthy", 1, 2, 0.95, 0, "g", "1-2"), ("none", 1, 0, 0.5, 0, None, None), ("none", 1, 2, 0.7, 0, "g", None), ("none", 1, 3, 0.7, 0, "g", None)]
    df = spark.createDataFrame(rows, "doc_id string, page int, attempt int, mean_conf double, row_idx int, unit string, reference_range string")
    return layout.best_attempt(layout.score_attempts(df)).select("doc_id", "attempt")


_GOLD = [("a", "WBC", "6.8", "6690-2"), ("a", "RBC", "4.1", "789-8"), ("b", "Novel", "1", None), ("b", "Iron", "70", "2498-4")]


_GOT = [("a", 0, "wbc ", "6.7", "6690-2", "confirmed"), ("a", 1, "WBC", "6.8", "6690-2", "confirmed"), ("b", 0, "novel", "1", None, "unmapped"), ("b", 1, "Iron", "70", "1-1", "confirmed")]


@query("SELECT * FROM (VALUES ('a', 0.5::DOUBLE, 0.5::DOUBLE), ('b', 1.0, 0.5), (NULL, 0.75, 0.5)) v(file, extraction, mapping)")
def eval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, JOIN-09."""
    gold = spark.createDataFrame([(*g, ["unmapped", "needs_review"]) for g in _GOLD], "file string, original_test_name string, value string, loinc_code string, expect_status array<string>")
    got = spark.createDataFrame(_GOT, "file string, row_idx int, original_test_name string, value string, loinc_code string, mapping_status string")
    return evaluate.accuracy(evaluate.score_gold(gold, got))


@query("SELECT * FROM (VALUES ('f', 1, 0::BIGINT, 0::BIGINT, 'c1', 'c1'), ('f', 1, 1, 1, 'c2', 'c9')) v(file, page, base_idx, new_idx, base_code, new_code)")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-10: greedy pairing, one to one."""
    shape = "file string, row_idx long, page int, name string, value string, loinc string"
    base = spark.createDataFrame([("f", 0, 1, "Hemoglobin", "10", "c1"), ("f", 1, 1, "Hemoglobin A", "10", "c2"), ("f", 2, 1, "Iron", "7", "c3")], shape)
    new = spark.createDataFrame([("f", 0, 1, "hemoglobin", "10", "c1"), ("f", 1, 1, "Hemoglobin A1", " 10", "c9"), ("f", 2, 2, "Iron", "7", "c3")], shape)
    return evaluate.agreement(base, new)


@query("SELECT * FROM (VALUES ('a', 10.0::DOUBLE, 5.0::DOUBLE, 2.0::DOUBLE), ('b', 3.0, NULL, NULL)) v(file, wall_s, new_wall_s, speedup)")
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-15, SRT-10."""
    shape = "file string, wall_s double, processing_s double"
    return evaluate.compare_runs(spark.createDataFrame([("b", 3.0, 1.0), ("a", 10.0, 4.0)], shape), spark.createDataFrame([("a", 5.0, 2.0)], shape)).select("file", "wall_s", "new_wall_s", "speedup")


@query("SELECT * FROM (VALUES (1, 'ValueError: bad', '{\"a\": 1}', true, true), (2, 'E: ', NULL, false, false), (3, NULL, '{\"b\": {}}', false, true)) v(id, error, json, request_ok, transient)")
def message_functions(spark: SparkSession, d: str) -> DataFrame:
    """FN-26, FN-27, FN-40, FLT-19."""
    rows = [(1, "ValueError", "bad", "```json\n{\"a\": 1}\n```", "abc-DEF_1", 429), (2, "E", None, "no object", "short", 404), (3, None, "x", "Sure: {\"b\": {}} done", "has space!", 503)]
    df = spark.createDataFrame(rows, "id int, kind string, message string, said string, request string, status int")
    return df.select("id", X.describe_error(F.col("kind"), F.col("message")).alias("error"), X.lenient_json(F.col("said")).alias("json"), X.is_request_id(F.col("request")).alias("request_ok"), X.is_transient(F.col("status")).alias("transient"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_literal_cases(name, spark, duck):
    f, sql = CASES[name]
    same_rows(f(spark, ""), duck, sql)
