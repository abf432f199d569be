"""Queries of page layout, row parsing, recognition and evaluation over the driver tables, and their DuckDB oracles.

The tables are seen as pages: a supplier's lines as positioned lines of pages, parts as printed rows whose fields are known,
documents as recognised words. The oracles compute the same from the columns, not from the texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X
from ..functions import validate as V
from ..operators import evaluate, export, layout, lifecycle, mapping, parse, quality, retrieval, terminology
from ..session import dealt, shared_dir
from ..sources.keyed import KeyedTable, remember
from ..sources.tables import table
from . import adapters as A
from .queries import clean_sql, query


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# ------------------------------------------------------------------- reading order
_NUMBERED = "row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice)"
_PAGE_LINES = f"""lines AS (
  SELECT l_suppkey AS doc_id, l_linenumber AS page, CAST({_NUMBERED} AS INTEGER) AS line_idx, 't' || l_orderkey::VARCHAR || CASE WHEN l_partkey % 41 = 0 THEN repeat(' wide', 15) ELSE '' END AS text,
    (l_partkey % 83) / 100.0::DOUBLE AS x0, (l_partkey % 83) / 100.0::DOUBLE + (1 + l_partkey % 7) / 50.0::DOUBLE AS x1,
    (l_orderkey * 37 % 1009) / 1000.0::DOUBLE AS y0, (l_orderkey * 37 % 1009) / 1000.0::DOUBLE + (1 + l_orderkey % 5) / 1000.0::DOUBLE AS y1,
    CASE WHEN l_orderkey % 4 = 0 THEN 12.5 WHEN l_orderkey % 4 = 1 THEN 11.5 WHEN l_orderkey % 8 = 2 THEN 14.5 ELSE 10.0 END::DOUBLE AS max_font FROM lineitem)"""


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as positioned lines: a supplier is a document, a line number a page; some lines are wide, some have a header's size."""
    from pyspark.sql import Window

    li, o, p = table(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_partkey")
    li = dealt(li, li.count(), "l_suppkey", "l_linenumber")
    place = F.row_number().over(Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_extendedprice"))
    x, y = (p % 83) / 100.0, (o * 37 % 1009) / 1000.0
    font = F.when(o % 4 == 0, 12.5).when(o % 4 == 1, 11.5).when(o % 8 == 2, 14.5).otherwise(10.0)
    rows = li.select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), place.alias("line_idx"), F.concat(F.lit("t"), o.cast("string"), F.when(p % 41 == 0, " wide" * 15).otherwise("")).alias("text"),
        x.alias("x0"), (x + (1 + p % 7) / 50.0).alias("x1"), y.alias("y0"), (y + (1 + o % 5) / 1000.0).alias("y1"), font.alias("max_font"), F.lit("digital").alias("source"),
    )
    return rows.withColumn("spans", F.array("text"))


def _bands_sql(name: str, source: str, by: str) -> str:
    return f"""{name}_r AS (SELECT *, max(y1) OVER (PARTITION BY {by} ORDER BY y0, line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name} AS (SELECT * EXCLUDE (reach), sum(CASE WHEN y0 - reach > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY y0, line_idx ROWS UNBOUNDED PRECEDING) AS {name}_no FROM {name}_r)"""


_ZONES = f"""{_PAGE_LINES}, {_bands_sql('pb', 'lines', 'doc_id, page')},
hd AS (SELECT *, bool_and(max_font BETWEEN {C.HEADER_FONT_MIN} AND {C.HEADER_FONT_MAX} AND length(text) <= {C.HEADER_MAX_CHARS}) OVER (PARTITION BY doc_id, page, pb_no) AS header FROM pb),
heads AS (SELECT doc_id, page, pb_no, min(y0) OVER (PARTITION BY doc_id, page, pb_no) AS y_start, (lag(x1) OVER w + x0) / 2 AS lft, (x1 + lead(x0) OVER w) / 2 AS rgt, row_number() OVER w AS sibling
  FROM hd WHERE header WINDOW w AS (PARTITION BY doc_id, page, pb_no ORDER BY x0, y0, line_idx)),
starts AS (SELECT DISTINCT doc_id, page, pb_no, y_start FROM heads),
ends AS (SELECT *, lead(y_start, 1, 1.0) OVER (PARTITION BY doc_id, page ORDER BY pb_no) AS y_end FROM starts),
zs AS (SELECT h.doc_id, h.page, h.pb_no, sibling, h.y_start, y_end, coalesce(lft, 0.0) AS x_start, coalesce(rgt, 1.0) AS x_end FROM heads h JOIN ends USING (doc_id, page, pb_no)
  UNION ALL SELECT doc_id, page, -1, 0, 0.0, coalesce(min(y_start), 1.0), 0.0, 1.0 FROM (SELECT DISTINCT doc_id, page FROM lines) LEFT JOIN starts USING (doc_id, page) GROUP BY doc_id, page),
zones AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pb_no, sibling) - 1 AS zone FROM zs),
held AS (SELECT l.doc_id, l.page, l.line_idx, min(z.zone) AS zone FROM lines l JOIN zones z ON l.doc_id = z.doc_id AND l.page = z.page AND z.y_start <= l.y0 AND l.y0 < z.y_end AND z.x_start <= (l.x0 + l.x1) / 2 AND (l.x0 + l.x1) / 2 < z.x_end GROUP BY ALL),
lastz AS (SELECT doc_id, page, max(zone) AS last_zone FROM zones GROUP BY ALL),
zoned AS (SELECT l.*, coalesce(h.zone, z.last_zone) AS zone FROM lines l JOIN lastz z USING (doc_id, page) LEFT JOIN held h USING (doc_id, page, line_idx))"""


@query(f"WITH {_ZONES} SELECT doc_id, page, line_idx, CAST(zone AS INTEGER) AS zone FROM zoned")
def zone_assignment(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-08, WIN-02, WIN-03, FLT-15: every line's zone, against a theta join."""
    return layout.zoned(page_lines(spark, d)).select("doc_id", "page", "line_idx", F.col("zone").cast("int").alias("zone"))


@query(
    f"WITH {_ZONES}, {_bands_sql('zb', 'zoned', 'doc_id, page, zone')}, rows AS (SELECT doc_id, page, zone, zb_no, string_agg(text, ' ' ORDER BY x0, y0, line_idx) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM zb GROUP BY ALL) "
    "SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY zone, zb_no) - 1 AS INTEGER) AS reading_order, CAST(zone AS INTEGER) AS column_index, text, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM rows"
)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01..05, JOIN-08, FLT-15, AGG-09, SET-07: the suppliers' pages in reading order."""
    rows = layout.reading_order(page_lines(spark, d))
    return rows.select("doc_id", "page", F.col("reading_order").cast("int").alias("reading_order"), F.col("column_index").cast("int").alias("column_index"), "text", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


# -------------------------------------------------------------------- row parsing
#: What a part's row looks like: its spans, and the fields that must come out (name, value, unit, range, flag; no name: no test).
_NAME = "concat(upper(left(p_name, 1)), substr(p_name, 2))"
_SHAPES: list[tuple[list[str], tuple[str, str, str, str, str] | None]] = [
    (["concat({n}, '                ', {v}, '     10*3/uL      ', {lo}, '-', {hi})"], ("{n}", "{v}", "'10*3/uL'", "concat({lo}, '-', {hi})", "NULL")),
    (["concat({n}, '(Calculated)')", "concat({v}, ' pg')", "concat({lo}, ' - ', {hi}, ' pg')", "'Normal'"], ("concat({n}, '(Calculated)')", "{v}", "'pg'", "concat({lo}, ' - ', {hi}, ' pg')", "'Normal'")),
    (["{n}", "'Negative'"], ("{n}", "'Negative'", "NULL", "NULL", "NULL")),
    (["{n}", "concat('<', {v}, ' IU/mL')"], ("{n}", "concat('<', {v})", "'IU/mL'", "NULL", "NULL")),
    (["{n}", "concat(': ', {v}, '12109')"], None),
    (["concat('Sample ID ', {n})", "{v}"], None),
    (["concat({n}, ' .......... ', {v}, ' mg/dL')"], ("{n}", "{v}", "'mg/dL'", "NULL", "NULL")),
    (["concat({n}, ' ', {v}, ' ug/dL ', {lo}, '-', {hi})"], ("{n}", "{v}", "'ug/dL'", "concat({lo}, '-', {hi})", "NULL")),
    (["concat('Page ', {v}, ' of 90')"], None),
    (["{n}", "{v}", "'%'", "concat({lo}, ' - ', {hi})", "'High'"], ("{n}", "{v}", "'%'", "concat({lo}, ' - ', {hi})", "'High'")),
    (["concat({n}, ' (Pulse height (Derived')", "'from RBC histogram))'", "{v}", "'fl'"], ("concat({n}, ' (Pulse height (Derived from RBC histogram))')", "{v}", "'fl'", "NULL", "NULL")),
    (["concat({n}, ' negative')"], ("{n}", "'negative'", "NULL", "NULL", "NULL")),
    (["concat('Note ', {n})", "{v}"], None),
]
_FIELDS = ("name", "value", "unit", "reference_range", "flag")


def _shape_sql(x: str, cast: str) -> str:
    return x.format(n=_NAME, v=f"cast(p_size AS {cast})", lo=f"cast(p_size AS {cast})", hi=f"cast(p_size + 7 AS {cast})")


_SHAPE_NO = f"p_partkey % {len(_SHAPES)}"
_ROWS_SQL = "SELECT p_partkey, " + ", ".join(
    f"CASE {_SHAPE_NO} " + " ".join(f"WHEN {i} THEN {_shape_sql(want[f], 'VARCHAR')}" for i, (_, want) in enumerate(_SHAPES) if want) + f" END AS {name}" for f, name in enumerate(_FIELDS)
) + f" FROM part WHERE {_SHAPE_NO} NOT IN ({', '.join(str(i) for i, (_, want) in enumerate(_SHAPES) if not want)})"


def printed_rows(spark: SparkSession, d: str) -> DataFrame:
    """part as printed rows (p_partkey, spans) of all shapes."""
    spans = "CASE " + _SHAPE_NO + " " + " ".join(f"WHEN {i} THEN array({', '.join(_shape_sql(s, 'STRING') for s in spans)})" for i, (spans, _) in enumerate(_SHAPES)) + " END"
    return table(spark, d, "part").select("p_partkey", F.expr(spans).alias("spans"))


@query(_ROWS_SQL)
def row_parsing(spark: SparkSession, d: str) -> DataFrame:
    """FN-06..11, FLT-10/11, WIN-09/17: every part as a printed row of one of thirteen shapes."""
    rows = printed_rows(spark, d)
    return rows.select("p_partkey", F.explode(parse.row_tests(F.col("spans"), F.lit("digital"))).alias("t")).select("p_partkey", *[f"t.{n}" for n in _FIELDS])


@query(
    f"WITH r AS (SELECT p_partkey, {_NAME} AS n, cast(p_size AS VARCHAR) AS v, cast(p_size AS VARCHAR) || ' - ' || cast(p_size + 7 AS VARCHAR) AS rng FROM part) "
    "SELECT p_partkey, 0 AS test_idx, n AS name, v AS value, '%' AS unit, rng AS reference_range FROM r UNION ALL SELECT p_partkey, 1, 'MCH ' || n, v, 'pg', rng FROM r"
)
def ocr_rows(spark: SparkSession, d: str) -> DataFrame:
    """WIN-09, WIN-18: two tests that recognition has put into one row."""
    n, v = F.expr(_NAME), _text("p_size")
    rng = F.concat(v, F.lit(" - "), (F.col("p_size") + 7).cast("string"))
    rows = table(spark, d, "part").select("p_partkey", F.array(n, v, F.lit("%"), rng, F.concat(F.lit("MCH "), n), v, F.lit("pg"), rng).alias("spans"))
    return rows.select("p_partkey", F.posexplode(parse.row_tests(F.col("spans"), F.lit("ocr"))).alias("test_idx", "t")).select("p_partkey", "test_idx", "t.name", "t.value", "t.unit", "t.reference_range")


@query(
    "WITH c AS (SELECT l_orderkey AS doc_id, count(*) AS n, max(l_quantity)::BIGINT::VARCHAR AS v, CASE l_orderkey % 4 WHEN 0 THEN 'Serum' WHEN 1 THEN 'Urine' END AS specimen FROM lineitem GROUP BY l_orderkey) "
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 2 END AS reading_order, CASE doc_id % 3 WHEN 0 THEN 'Serum Urea' WHEN 1 THEN 'Absolute count of cells' ELSE 'MCV (Pulse height (Derived from RBC histogram))' END AS name, v AS value, specimen FROM c"
)
def page_parsing(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06, WIN-07, WIN-08: an order is a page: a specimen line, then a card, a label over two lines, or a label left open."""
    li = table(spark, d, "lineitem")
    c = dealt(li, li.count(), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_quantity").cast("long").cast("string").alias("v"))
    k = F.col("doc_id")
    first = F.when(k % 4 == 0, "Specimen: Serum").when(k % 4 == 1, "Specimen: Urine").otherwise("-")
    line = lambda text, y0, y1: F.struct(text.alias("text"), F.lit(y0).alias("y0"), F.lit(y1).alias("y1"))
    top = line(first, 0.02, 0.03)
    card = F.array(top, line(F.lit("Serum Urea"), 0.20, 0.215), line(F.concat("v", F.lit(" mg/dl")), 0.225, 0.24))
    wrapped = F.array(top, line(F.lit("Absolute count"), 0.208, 0.220), line(F.lit("of cells"), 0.223, 0.235), line(F.concat("v", F.lit(" %")), 0.240, 0.252))
    dangling = F.array(top, line(F.lit("MCV (Pulse height (Derived"), 0.1, 0.12), line(F.concat(F.lit("from RBC histogram))    "), "v", F.lit("    fl")), 0.13, 0.15))
    rows = c.select("doc_id", F.lit(1).alias("page"), F.posexplode(F.when(k % 3 == 0, card).when(k % 3 == 1, wrapped).otherwise(dangling)).alias("reading_order", "l"))
    rows = rows.select("doc_id", "page", "reading_order", F.lit(0).alias("column_index"), "l.text", F.array("l.text").alias("spans"), F.lit("digital").alias("source"), "l.y0", "l.y1")
    return parse.parse_pages(rows).select("doc_id", "reading_order", "name", "value", "specimen")


# --------------------------------------------------------------------- recognition
_WORDS_SQL = """words AS (SELECT doc_id, i, i // 9 AS line_num, w AS text, (i % 9) * 60 + (i * 37 + doc_id) % 41 AS lft, length(w) * 5 AS width, (i // 9) * 20 + i % 3 AS top, 8 + i % 5 AS height, (i * 31 + doc_id) % 101 AS conf
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS ws FROM documents)))"""


def recognised_words(spark: SparkSession, d: str) -> DataFrame:
    """documents as recognised words: nine to a line, with boxes and confidences."""
    docs = table(spark, d, "documents")
    # whole texts are dealt, so their words needn't be
    words = dealt(docs, 100 * docs.count(), "doc_id").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("i", "text"))
    i = F.col("i")
    return words.select(
        "doc_id", F.lit(1).alias("page"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.floor(i / 9).cast("int").alias("line_num"), (i % 9 * 60 + (i * 37 + F.col("doc_id")) % 41).cast("int").alias("left"),
        (F.floor(i / 9) * 20 + i % 3).cast("int").alias("top"), (F.length("text") * 5).alias("width"), (8 + i % 5).cast("int").alias("height"), "text", ((i * 31 + F.col("doc_id")) % 101).cast("int").alias("conf"),
        F.lit(1000).alias("page_width"), F.lit(100000).alias("page_height"),
    )


@query(
    f"WITH {_WORDS_SQL}, k AS (SELECT * FROM words WHERE conf >= {C.OCR_WORD_CONFIDENCE} AND regexp_replace(text, '\\s', '', 'g') <> ''), "
    "h AS (SELECT *, quantile_cont(height, 0.5) OVER (PARTITION BY doc_id, line_num) AS typical, lft - lag(lft + width) OVER w AS gap FROM k WINDOW w AS (PARTITION BY doc_id, line_num ORDER BY lft, top, text)), "
    f"s AS (SELECT *, sum(CASE WHEN gap > {C.OCR_GAP_RATIO} * typical THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_num ORDER BY lft, top, text ROWS UNBOUNDED PRECEDING) AS span FROM h), "
    "p AS (SELECT doc_id, line_num, span, string_agg(text, ' ' ORDER BY lft, top, text) AS t, avg(conf) / 100 AS c, min(lft) AS x0, min(top) AS y0, max(top + height) AS y1 FROM s GROUP BY ALL), "
    "l AS (SELECT doc_id, line_num, string_agg(t, '|' ORDER BY span) AS phrases, avg(c) AS c, min(x0) AS x0, min(y0) AS y0, max(y1) AS y1 FROM p GROUP BY ALL) "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY (y0 + y1) / 2.0, x0) - 1 AS INTEGER) AS line_idx, sha256(phrases) AS phrases, round(c, 6) AS confidence FROM l"
)
def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC-21, FLT-12, WIN-10, AGG-10, SRT-05: the documents' words to lines of phrases."""
    rows = layout.ocr_lines(recognised_words(spark, d))
    return rows.select("doc_id", F.col("line_idx").cast("int").alias("line_idx"), F.sha2(F.array_join("spans", "|").cast("binary"), 256).alias("phrases"), F.round("confidence", 6).alias("confidence"))


@query(
    "WITH r AS (SELECT l_suppkey AS doc_id, l_orderkey % 50 AS page, l_linenumber AS attempt, l_quantity, l_returnflag = 'R' AS has_unit, l_linestatus = 'O' AS has_range, l_discount FROM lineitem), "
    "a AS (SELECT doc_id, page, attempt, 0.5 + max(l_discount) * 5 AS mean_conf, count(*) FILTER (l_quantity > 10) AS n, coalesce(avg((has_unit OR has_range)::INT::DOUBLE) FILTER (l_quantity > 10), 0) AS complete, "
    "coalesce(sum(0.5 + 0.25 * has_unit::INT + 0.25 * has_range::INT) FILTER (l_quantity > 10), 0) AS points FROM r GROUP BY ALL), "
    f"s AS (SELECT *, round(points * mean_conf, 9) AS score, n > 0 AND round(mean_conf, 9) >= {C.OCR_HEALTHY_CONFIDENCE} AND complete >= {C.OCR_COMPLETE_FRACTION} AS healthy FROM a) "
    "SELECT doc_id, page, attempt, healthy FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY healthy DESC, CASE WHEN healthy THEN 0 ELSE -score END, attempt) = 1"
)
def best_attempt(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11, ORC-05, SRT-07: the attempts at a page (lines of a supplier's orders) and the one that is kept."""
    li = table(spark, d, "lineitem")
    some = F.col("l_quantity") > 10
    rows = li.select(
        F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 50).alias("page"), F.col("l_linenumber").alias("attempt"), F.round(0.5 + F.col("l_discount") * 5, 9).alias("mean_conf"), F.when(some, F.col("l_orderkey")).alias("row_idx"),
        F.when(F.col("l_returnflag") == "R", "g").alias("unit"), F.when(F.col("l_linestatus") == "O", "1-2").alias("reference_range"),
    )
    scored = layout.score_attempts(rows).withColumn("score", F.round("score", 9))
    return layout.best_attempt(scored).select("doc_id", "page", "attempt", "healthy")


# ---------------------------------------------------------------------- evaluation
_RUNS_SQL = """runs AS (SELECT l_suppkey::VARCHAR AS file, l_linenumber AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_extendedprice, l_linenumber) - 1 AS i,
  p_type AS word, p_name AS more, l_quantity::BIGINT::VARCHAR AS v, l_partkey, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey),
base AS (SELECT file, page, i, CASE WHEN l_orderkey % 5 = 0 THEN word || ' ' || more ELSE word END AS name, v, 'c' || l_partkey::VARCHAR AS code FROM runs),
new AS (SELECT file, page, i, CASE WHEN l_orderkey % 2 = 0 THEN upper(word) ELSE word || '  (' || more || ')' END AS name, ' ' || v AS v, 'c' || (l_partkey - l_partkey % 3)::VARCHAR AS code FROM runs WHERE l_orderkey % 7 <> 0)"""


def two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the suppliers' documents: the same rows, some lost, with other spellings and partly other codes."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber")) - 1
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    o, k, v = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("long").cast("string")
    rows = rows.select(_text("l_suppkey").alias("file"), F.col("l_linenumber").alias("page"), place.cast("long").alias("row_idx"), "p_type", "p_name", v.alias("v"), o, k)
    code = lambda c: F.concat(F.lit("c"), c.cast("string")).alias("loinc")
    base = rows.select("file", "page", "row_idx", F.when(o % 5 == 0, F.concat_ws(" ", "p_type", "p_name")).otherwise(F.col("p_type")).alias("name"), F.col("v").alias("value"), code(k))
    new = rows.where(o % 7 != 0).select("file", "page", "row_idx", F.when(o % 2 == 0, F.upper("p_type")).otherwise(F.concat("p_type", F.lit("  ("), "p_name", F.lit(")"))).alias("name"), F.concat(F.lit(" "), "v").alias("value"), code(k - k % 3))
    return base, new


@query(
    f"WITH RECURSIVE {_RUNS_SQL}, b AS (SELECT *, {clean_sql('name')} AS nm, row_number() OVER (PARTITION BY file, page, v ORDER BY i) AS n FROM base), "
    f"w AS (SELECT file, page, trim(v) AS v, list(struct_pack(i := i, nm := {clean_sql('name')}, code := code) ORDER BY i) AS waiting FROM new GROUP BY ALL), "
    "step AS (SELECT b.file, b.page, b.v, b.n, b.i, b.code, k.pick, list_filter(w.waiting, lambda x: k.pick IS NULL OR x.i <> k.pick.i) AS waiting FROM b JOIN w ON b.file = w.file AND b.page = w.page AND b.v = w.v, "
    "LATERAL (SELECT list_filter(w.waiting, lambda x: contains(x.nm, b.nm) OR contains(b.nm, x.nm))[1] AS pick) k WHERE b.n = 1 UNION ALL "
    "SELECT b.file, b.page, b.v, b.n, b.i, b.code, k.pick, list_filter(s.waiting, lambda x: k.pick IS NULL OR x.i <> k.pick.i) FROM step s JOIN b ON b.file = s.file AND b.page = s.page AND b.v = s.v AND b.n = s.n + 1, "
    "LATERAL (SELECT list_filter(s.waiting, lambda x: contains(x.nm, b.nm) OR contains(b.nm, x.nm))[1] AS pick) k) "
    "SELECT file, page, i AS base_idx, pick.i AS new_idx, code AS base_code, pick.code AS new_code FROM step WHERE pick IS NOT NULL"
)
def agreement(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-10: greedy pairing, one to one, of two runs over all lines."""
    return evaluate.agreement(*two_runs(spark, d), 2 * table(spark, d, "lineitem").count())


@query(
    f"WITH {_RUNS_SQL}, g AS (SELECT file, lower(trim(name)) AS k, v, CASE WHEN i % 4 = 0 THEN NULL ELSE code END AS code FROM base WHERE i < 40 AND i % 3 = 0), "
    "s AS (SELECT file, lower(trim(name)) AS k, arg_max(trim(v), i) AS v, arg_max(code, i) AS code, arg_max(CASE WHEN i % 2 = 0 THEN 'unmapped' ELSE 'confirmed' END, i) AS status FROM new GROUP BY ALL), "
    "j AS (SELECT g.file, (s.k IS NOT NULL AND s.v = g.v)::INT AS value_ok, (s.k IS NOT NULL AND CASE WHEN g.code IS NULL THEN s.status IN ('unmapped', 'needs_review') ELSE coalesce(s.code = g.code, false) END)::INT AS code_ok FROM g LEFT JOIN s USING (file, k)), "
    "p AS (SELECT file, avg(value_ok) AS e, avg(code_ok) AS m FROM j GROUP BY file) SELECT file, round(e, 6) AS extraction, round(m, 6) AS mapping FROM p UNION ALL SELECT NULL, round(avg(e), 6), round(avg(m), 6) FROM p"
)
def eval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, JOIN-09: gold rows of every document (its first forty rows, every third: what a gold set is) against a run."""
    base, new = two_runs(spark, d)
    gold = base.where("row_idx < 40 AND row_idx % 3 = 0").select("file", F.col("name").alias("original_test_name"), "value", F.when(F.col("row_idx") % 4 != 0, F.col("loinc")).alias("loinc_code"), F.array(F.lit("unmapped"), F.lit("needs_review")).alias("expect_status"))
    got = new.select("file", "row_idx", F.col("name").alias("original_test_name"), F.trim("value").alias("value"), F.col("loinc").alias("loinc_code"), F.when(F.col("row_idx") % 2 == 0, "unmapped").otherwise("confirmed").alias("mapping_status"))
    return evaluate.accuracy(evaluate.score_gold(gold, got))


@query(
    "WITH o AS (SELECT o_custkey::VARCHAR AS file, sum(o_totalprice) AS wall_s FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL), n AS (SELECT o_custkey::VARCHAR AS file, CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE sum(o_totalprice) END AS new_wall_s FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) "
    "SELECT file, round(wall_s, 2) AS wall_s, round(new_wall_s, 2) AS new_wall_s, round(wall_s / nullif(new_wall_s, 0), 3) AS speedup FROM o LEFT JOIN n USING (file)"
)
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-15, SRT-10: two timed runs over the customers' documents."""
    run = lambda rows, total: rows.groupBy("o_custkey").agg(total.alias("wall_s")).select(_text("o_custkey").alias("file"), "o_custkey", "wall_s", F.lit(1.0).alias("processing_s"))
    o = table(spark, d, "orders")
    new = run(o.where("o_orderstatus = 'F'"), F.sum("o_totalprice")).withColumn("wall_s", F.when(F.col("o_custkey") % 9 == 0, 0.0).otherwise(F.col("wall_s"))).drop("o_custkey")
    got = evaluate.compare_runs(run(o.where("o_orderstatus <> 'P'"), F.sum("o_totalprice")).drop("o_custkey"), new)
    return got.select("file", F.round("wall_s", 2).alias("wall_s"), F.round("new_wall_s", 2).alias("new_wall_s"), "speedup")


# ----------------------------------------------------------- messages and small texts
@query(
    "SELECT o_orderkey AS id, left(o_orderpriority || ': ' || o_custkey::VARCHAR || repeat('x', (o_orderkey % 600)::INT), 500) AS error, CASE WHEN o_orderkey % 4 < 3 THEN '{\"a\": ' || o_custkey::VARCHAR || ', \"b\": {\"c\": [1]}}' END AS json, "
    "o_orderkey % 3 <> 0 AND length('r-' || o_orderkey::VARCHAR) >= 6 AS request_ok, o_custkey % 200 + 350 = 429 OR o_custkey % 200 + 350 >= 500 AS transient FROM orders"
)
def message_functions(spark: SparkSession, d: str) -> DataFrame:
    """FN-26, FN-27, FN-40, FLT-19: errors, answers with fences and chatter, request ids and statuses made of the orders."""
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), _text("o_custkey")
    body = F.concat(F.lit('{"a": '), c, F.lit(', "b": {"c": [1]}}'))
    said = F.when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).when(k % 4 == 2, body).otherwise("no object")
    request = F.when(k % 3 == 0, F.concat(F.lit("has space! "), k.cast("string"))).otherwise(F.concat(F.lit("r-"), k.cast("string")))
    message = F.concat(c, F.repeat(F.lit("x"), (k % 600).cast("int")))
    return o.select(
        k.alias("id"), X.describe_error(F.col("o_orderpriority"), message).alias("error"), X.lenient_json(said).alias("json"), X.is_request_id(request).alias("request_ok"),
        X.is_transient(F.col("o_custkey") % 200 + 350).alias("transient"),
    )


_SECRET_KINDS = (
    ("concat('key AIzaSyA1234567890abcdefgh', {k}, ' end')", "'key [REDACTED] end'"),
    ("concat('token sk-abcdefghij0123456789', {k}, ' x')", "'token [REDACTED] x'"),
    ("concat('Authorization: Bearer abcdefghijklmnop', {k})", "'Authorization: Bearer [REDACTED]'"),
    ("concat('X-API-Key: s', {k}, ', next ', {k})", "concat('X-API-Key: [REDACTED], next ', {k})"),
    ("concat('https://x.test/?api_key=abcdefgh', {k}, '&b=', {k})", "concat('https://x.test/?api_key=[REDACTED]&b=', {k})"),
    ("concat('order ', {k}, ' sk-short')", "concat('order ', {k}, ' sk-short')"),
)


def _kinds_sql(which: int, cast: str) -> str:
    return f"CASE o_orderkey % {len(_SECRET_KINDS)} " + " ".join(f"WHEN {i} THEN {x[which].format(k=f'cast(o_orderkey AS {cast})')}" for i, x in enumerate(_SECRET_KINDS)) + " END"


@query(f"SELECT o_orderkey AS id, {_kinds_sql(1, 'VARCHAR')} AS redacted FROM orders")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    """FN-28: secrets of all shapes, each made of an order's key."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.redact(F.expr(_kinds_sql(0, "STRING"))).alias("redacted"))


@query(
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS specimen, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS method FROM part"
)
def text_queries(spark: SparkSession, d: str) -> DataFrame:
    """SRT-09: the text form of every part as a question: name, then specimen and method in either order, or neither."""
    k = F.col("p_partkey")
    specimen = F.when(k % 3 == 1, F.concat(F.lit("Specimen:  "), "p_type")).when(k % 3 == 2, F.concat(F.lit("specimen:"), "p_type")).otherwise("specimen: ")
    method = F.when(k % 2 == 0, F.col("p_brand")).otherwise(" ")
    name = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" "), "p_name"))
    text = F.when(k % 7 < 4, F.concat_ws(" | ", name, specimen, method)).otherwise(F.concat_ws("|", name, method, specimen))
    return table(spark, d, "part").select(k.alias("id"), retrieval.text_query(text).alias("q")).select("id", "q.name", "q.specimen", "q.method")


@query(
    "WITH v AS (SELECT p_partkey AS i, p_partkey % 6 AS k, (p_size % 10) / 10.0::DOUBLE AS c FROM part) SELECT i, CASE WHEN k IN (0, 5) THEN CASE WHEN c >= 0.75 THEN 'confirmed' ELSE 'needs_review' END WHEN k = 1 THEN 'needs_review' ELSE 'unmapped' END AS mapping_status, "
    "CASE WHEN k = 0 THEN '1-1' WHEN k = 5 THEN '2-2' END AS loinc_code, CASE WHEN k = 4 THEN 0.0 ELSE c END AS mapping_confidence, "
    "CASE k WHEN 0 THEN 'good' WHEN 5 THEN 'so-so' WHEN 1 THEN 'Model chose a LOINC code outside the candidate list; discarded.' WHEN 2 THEN 'No candidate judged reliable.' WHEN 3 THEN 'none fits' ELSE 'No verdict returned.' END AS mapping_rationale FROM v"
)
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """FLT-17, JOIN-11: a verdict for every part: sure or unsure of a candidate, outside the list, empty, with a reason, missing."""
    k, p = F.col("p_partkey") % 6, table(spark, d, "part")
    hits = F.array(*[F.struct(F.lit(c).alias("loinc_num"), F.lit(f"name {c}").alias("long_common_name")) for c in ("1-1", "2-2")])
    given = F.struct(
        F.when(k == 0, "1-1").when(k == 5, "2-2").when(k == 1, "9-9").when(k == 3, "").alias("chosen_loinc_num"), ((F.col("p_size") % 10) / 10.0).cast("string").alias("confidence"),
        F.when(k == 0, "good").when(k == 5, "so-so").when(k == 1, "x").when(k == 2, "").when(k == 3, "none fits").alias("rationale"),
    )
    none = F.struct(F.lit(None).cast("string").alias("chosen_loinc_num"), F.lit(None).cast("string").alias("confidence"), F.lit("No verdict returned.").alias("rationale"))
    r = p.select(F.col("p_partkey").alias("i"), mapping.verdict_result(F.lit("n"), hits, F.when(k == 4, none).otherwise(given)).alias("r"))
    return r.select("i", "r.mapping_status", "r.loinc_code", "r.mapping_confidence", "r.mapping_rationale")


#: Blanks between the words of a part: spaces, tabs, ideographic, no-break and thin ones.
_GAPS = ("  ", "\t\t", "\u3000 ", "\u00a0\u00a0", "\u2009\u2009")


@query("SELECT p_partkey AS id, p_name || '|' || p_size::VARCHAR || '|g/dL' AS tokens, 'g/dL' AS unit, p_partkey % 3 = 0 AS blank, p_name || ' ' || p_size::VARCHAR || ' gm/dl' AS short FROM part")
def white_space(spark: SparkSession, d: str) -> DataFrame:
    """FN-02, FN-06, FN-21, FN-25: white space of all kinds strips, splits and collapses."""
    k = F.col("p_partkey")
    gap = F.element_at(F.array(*[F.lit(g) for g in _GAPS]), (k % len(_GAPS) + 1).cast("int"))
    p = table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("n"), _text("p_size").alias("v"), gap.alias("g"), (k % 3 == 0).alias("b"))
    row = lambda unit: F.concat("g", "n", "g", "v", "g", F.lit(unit), "g")
    return p.select(
        "id", F.array_join(parse.tokenize_spans(F.array(row("g/dL"))), "|").alias("tokens"), X.standardize_unit(F.concat("g", F.lit("gm/dl"), "g")).alias("unit"),
        X.blank_to_null(F.when(F.col("b"), F.col("g")).otherwise(F.concat("g", "n"))).isNull().alias("blank"), X.short(row("gm/dl")).alias("short"),
    )


#: (label, whether it is a known short name) -> junk, corrected, of recognised rows; fixed by FLT-13 and FN-17.
_LABELS = (("concat({n}, ' level')", "false", "NULL"), ("'eee Ol'", "true", "NULL"), ("'pH'", "false", "NULL"), ("'C02'", "false", "'CO2'"), ("'ab'", "true", "NULL"), ("'T5H'", "false", "'TSH'"), ("'X9Z'", "false", "NULL"), ("'x9z'", "true", "NULL"))


def _label_sql(which: int) -> str:
    return f"CASE p_partkey % {len(_LABELS)} " + " ".join(f"WHEN {i} THEN {x[which].format(n='p_name')}" for i, x in enumerate(_LABELS)) + " END"


@query(
    f"WITH v AS (SELECT p_partkey AS row_id, p_size % 2 = 0 AS ocr, p_size % 5 = 0 AS bare, {_label_sql(1)} AS junk, {_label_sql(2)} AS fixed, p_size::DOUBLE AS n FROM part), "
    "w AS (SELECT *, ocr AND (junk OR bare) AS dropped, n > 20 * 5 AND FALSE AS far FROM v) "
    "SELECT row_id, dropped, CASE WHEN ocr THEN fixed END AS corrected_label, CAST(CASE WHEN dropped THEN (ocr AND fixed IS NOT NULL)::INT + (ocr AND junk AND fixed IS NULL)::INT + (ocr AND bare AND NOT junk)::INT ELSE (ocr AND fixed IS NOT NULL)::INT + bare::INT END AS INTEGER) AS n_notes FROM w"
)
def validation_cases(spark: SparkSession, d: str) -> DataFrame:
    """FN-17/18, FLT-13/14, JOIN-14: labels that recognition misread, junk and units that are numbers, over all parts."""
    p = table(spark, d, "part")
    label = F.expr(_label_sql(0))
    rows = p.select(
        F.col("p_partkey").alias("row_id"), label.alias("original_test_name"), _text("p_size").alias("value"), F.when(F.col("p_size") % 5 == 0, "150.0").otherwise("mg/dL").alias("unit"), F.lit(None).cast("string").alias("reference_range"),
        F.lit(None).cast("string").alias("flag"), (F.col("p_size") % 2 == 0).alias("ocr"), F.lit(0.65).alias("extraction_confidence"),
    )
    names = p.select(F.element_at(F.array(*[F.lit(n) for n in ("wbc", "ph", "na", "co2", "tsh", "a1c")]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("name")).distinct()
    out = V.validate_rows(V.correct_labels(rows, names))
    return out.select("row_id", "dropped", F.when(F.col("ocr"), F.col("corrected_label")).alias("corrected_label"), F.size("notes").alias("n_notes"))


# ------------------------------------------------------------------ stores and sinks
def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "SELECT p_partkey AS key, coalesce(b.v, a.v, p_size::DOUBLE) AS v, CASE WHEN b.v IS NOT NULL THEN 'second' WHEN a.v IS NOT NULL THEN 'first' ELSE 'base' END AS source FROM part "
    "LEFT JOIN (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a ON a.k = p_partkey LEFT JOIN (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 2 AND l_partkey % 7 = 0 GROUP BY 1) b ON b.k = p_partkey"
)
def keyed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16, MUT-05: parts as a keyed table after two upserts, each of which rewrites the parts of the table that it touches."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    held = KeyedTable.create(p.select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("v"), F.lit("base").alias("source")), _scratch(spark, "keyed"), ("key",), parts=16)
    for where, name in (("l_linenumber = 1", "first"), ("l_linenumber = 2 AND l_partkey % 7 = 0", "second")):
        held = held.upsert(li.where(where).groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_quantity").alias("v")).withColumn("source", F.lit(name)))
    return held.read()


@query(
    f"WITH r AS (SELECT {clean_sql('p_name')} || '|' || {clean_sql('p_type')} || '|' AS key, p_partkey, p_size FROM part), "
    "w AS (SELECT key, arg_min(p_partkey, p_partkey) AS c FROM r WHERE p_size % 5 = 0 GROUP BY key), m AS (SELECT key, min(p_partkey) AS c FROM r GROUP BY key) "
    "SELECT m.key, 'c' || coalesce(w.c, m.c)::VARCHAR AS loinc_num, CASE WHEN w.c IS NOT NULL THEN 'review' ELSE 'llm' END AS source FROM m LEFT JOIN w USING (key)"
)
def remembered_store(spark: SparkSession, d: str) -> DataFrame:
    """MUT-04, MUT-05, WIN-11, SRC-19: reviewers' picks, then a model's, in a keyed table: the model's fill what no reviewer has decided."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("specimen"), F.lit(None).cast("string").alias("unit"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("loinc_num"), "p_size")
    empty = spark.createDataFrame([], "key string, loinc_num string, source string, confidence double")
    held = KeyedTable.create(empty, _scratch(spark, "remembered"), ("key",), parts=16)
    held = remember(held, p.where("p_size % 5 = 0").drop("p_size"), "review", 1.0)
    return remember(held, p.drop("p_size"), "llm", 0.95).read().select("key", "loinc_num", "source")


@query(
    f"WITH {A.OBSERVATIONS_SQL}, {A.QUEUE_SQL}, o AS (SELECT document_id, uploaded_at, count(observation_id) + 1 AS n, string_agg('obs-' || observation_id::VARCHAR, ',' ORDER BY page_number, observation_id) AS ids FROM queue LEFT JOIN observations USING (document_id) GROUP BY ALL) "
    "SELECT strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S') AS timestamp, CAST(n AS INTEGER) AS n_entries, sha256(coalesce(ids, '')) AS ids FROM o"
)
def bundle_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18: the bundles of all orders written as JSON lines and read back."""
    obs = A.observations(spark, d).withColumns(
        {"created_at": F.col("created_at").cast("timestamp"), "loinc_code": F.lit("1-1"), "loinc_display": F.lit(None).cast("string"), "normalized_test_name": F.lit(None).cast("string"), "mapping_confidence": F.lit(0.5)}
    )
    path = _scratch(spark, "bundles")
    export.write_bundles(A.queue(spark, d).select("document_id", "uploaded_at"), obs, path)
    return export.read_bundles(spark, path).select("timestamp", "n_entries", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids"))


@query(
    "SELECT 'L' || p_partkey::VARCHAR AS loinc_num, p_name || ', \"' || p_type || '\"' AS long_common_name, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS shortname, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS common_test_rank, p_name || '/' || p_type AS aliases FROM part"
)
def catalog_csv(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11: parts written as a terminology CSV with quotes, blanks and empty aliases, and read with its rules."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    rows = p.select(
        F.concat(F.lit("L"), k.cast("string")).alias("LOINC_NUM"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("LONG_COMMON_NAME"), F.when(k % 3 == 0, "  ").otherwise(F.col("p_brand")).alias("SHORTNAME"),
        F.when(F.col("p_size") % 4 == 0, "none").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("COMMON_TEST_RANK"), F.concat("p_name", F.lit(" | |"), "p_type", F.lit("|")).alias("aliases"),
    )
    path = _scratch(spark, "catalog")
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = terminology.read_catalog_csv(spark, path)
    return got.select("loinc_num", "long_common_name", "shortname", "common_test_rank", F.array_join("aliases", "/").alias("aliases"))


@query("SELECT count(*) AS seen, count(*) FILTER (p_size > 25 AND p_brand <> 'Brand#1') AS kept, count(*) FILTER (NOT (p_size > 25 AND p_brand <> 'Brand#1')) AS skipped FROM part")
def etl_counts(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13: rows seen, kept and skipped, counted while the active codes are written."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("ord"), F.when(F.col("p_size") > 25, "1").otherwise("2").alias("CLASSTYPE"), F.when(F.col("p_brand") != "Brand#1", "ACTIVE").otherwise("DEPRECATED").alias("STATUS"), F.col("p_name").alias("RELATEDNAMES2")
    )
    counts = terminology.write_active_codes(p, _scratch(spark, "active-codes"))
    return spark.createDataFrame([(counts["seen"], counts["kept"], counts["skipped"])], "seen long, kept long, skipped long")


# --------------------------------------------------------------------- the page flow
@query(
    "WITH p AS (SELECT l_orderkey AS document_id, l_linenumber AS page_number, bool_or(l_returnflag = 'R' AND l_tax > 0.05) AS fatal, bool_or(l_quantity > 45) AS unreadable, sum(l_quantity) AS cost FROM lineitem GROUP BY ALL), "
    "t AS (SELECT *, coalesce(bool_or(fatal) OVER w, false) AS tripped, coalesce(sum(cost) OVER w, 0) > 120 AS late, first_value(CASE WHEN fatal THEN page_number END IGNORE NULLS) OVER w AS tripped_at FROM p WINDOW w AS (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "s AS (SELECT *, tripped OR fatal OR unreadable AS diverted FROM t) SELECT document_id, page_number, CASE WHEN NOT diverted THEN 'llm' WHEN NOT late THEN 'fallback' END AS source, NOT tripped AS called, "
    "CASE WHEN NOT diverted THEN 1 WHEN late OR page_number = 3 THEN 0 ELSE 1 END AS n_tests, CASE WHEN NOT diverted THEN 0.9 WHEN late OR page_number = 3 THEN NULL ELSE 0.65 END::DOUBLE AS confidence, "
    "CASE WHEN tripped THEN 'ConnectionError: lost at ' || tripped_at::VARCHAR WHEN fatal THEN 'ConnectionError: lost at ' || page_number::VARCHAR WHEN unreadable THEN 'ValueError: unreadable' END AS note, "
    "CASE WHEN diverted AND late THEN 'page ' || page_number::VARCHAR || ': local extraction time budget (120s) exceeded' WHEN diverted AND page_number = 3 THEN 'page 3: local fallback found no recognizable test rows' END AS reason FROM s"
)
def page_flow(spark: SparkSession, d: str) -> DataFrame:
    """STR-08, STR-10, ORC-01, ORC-03, ORC-04: every page of every order through an extractor that breaks down, answers unreadably, or is cut short by the document's time."""
    from ..operators import flow

    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number")).agg(
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05)).alias("fatal"), F.bool_or(F.col("l_quantity") > 45).alias("unreadable"), F.sum("l_quantity").alias("cost")
    )

    def call(page: dict) -> list[dict]:
        if page["fatal"]:
            raise ConnectionError(f"lost at {page['page_number']}")
        if page["unreadable"]:
            raise ValueError("unreadable")
        return [{"name": "Iron", "value": "1", "confidence": 0.9}]

    done = flow.run_pages(pages, call, lambda page: [] if page["page_number"] == 3 else [{"name": "Iron", "value": "1", "confidence": 0.9}], budget=120.0, seconds=lambda page: page["cost"])
    return done.select("document_id", "page_number", "source", "called", F.size("tests").alias("n_tests"), F.try_element_at("tests", F.lit(1))["confidence"].alias("confidence"), "note", "reason")


@query(
    "SELECT p_partkey AS id, x.i AS test_idx, CASE x.i WHEN 0 THEN p_name ELSE p_type END AS original_test_name, CASE x.i WHEN 0 THEN p_size::VARCHAR END AS value, CASE x.i WHEN 0 THEN NULL ELSE 'mg/dL' END AS unit, CASE x.i WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, 'n' || p_size::VARCHAR AS page_notes, false AS bad "
    "FROM part, (SELECT unnest([0, 1]) AS i) x WHERE p_partkey % 6 < 3 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, true FROM part WHERE p_partkey % 6 > 3"
)
def page_json(spark: SparkSession, d: str) -> DataFrame:
    """SRC-20, FN-27: an extractor's answer for every part: plain, fenced, amid chatter, without tests, cut off, and with a confidence out of range."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    size = _text("p_size")
    body = lambda sure: F.concat(
        F.lit('{"tests": [{"original_test_name": "'), "p_name", F.lit('", "value": "'), size, F.lit('", "unit": null, "extraction_confidence": 0.5}, {"original_test_name": "'), "p_type", F.lit(f'", "unit": "mg/dL", "extraction_confidence": {sure}}}], "page_notes": "n'), size, F.lit('"}')
    )
    said = (
        F.when(k % 6 == 0, body("1")).when(k % 6 == 1, F.concat(F.lit("```json\n"), body("1"), F.lit("\n```"))).when(k % 6 == 2, F.concat(F.lit("Here it is: "), body("1.0"), F.lit(" - done.")))
        .when(k % 6 == 3, F.lit('{"tests": [], "page_notes": null}')).when(k % 6 == 4, F.concat(F.lit('{"tests": [{"original_test_name": "'), "p_name")).otherwise(body("1.5"))
    )
    tests, bad = parse.answered_tests(p.select(k.alias("id"), said.alias("said")))
    good = tests.select("id", "test_idx", "original_test_name", "value", "unit", F.col("extraction_confidence").alias("confidence"), "page_notes", F.lit(False).alias("bad"))
    return good.unionByName(bad.select("id", F.lit(True).alias("bad")), allowMissingColumns=True)


_STAGE_OF = ("alias_exact", "learned", "lexical_llm", "error")


@query(
    f"WITH {A.FEED_SQL}, {A.OBSERVATIONS_SQL}, t AS (SELECT document_id, epoch_us(min(ts)) / 1e6 AS a, epoch_us(max(ts)) / 1e6 AS b, epoch_us(min(ts) FILTER (level = 'click')) / 1e6 AS s FROM feed GROUP BY document_id), "
    f"o AS (SELECT document_id, {list(_STAGE_OF)}[page_number % 4 + 1] AS stage FROM observations), c AS (SELECT document_id, " + ", ".join(f"count(*) FILTER (stage = '{s}') AS {s}" for s in quality.STAGES) + " FROM o GROUP BY document_id) "
    "SELECT document_id, round(b - a, 1) AS wall_seconds, round(greatest(0.0, (b - a) - (b - coalesce(s, b))), 1) AS queue_wait_seconds, " + ", ".join(f"coalesce({s}, 0) AS {s}" for s in quality.STAGES) + " FROM t LEFT JOIN c USING (document_id)"
)
def run_times(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14: wall seconds, queue wait and stage histogram of every document of the feed."""
    stage = F.element_at(F.array(*[F.lit(s) for s in _STAGE_OF]), F.col("page_number") % 4 + 1)
    feed = A.feed(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return quality.run_summary(feed, A.observations(spark, d).withColumn("mapping_stage", stage), F.col("level") == "click")


@query(
    f"WITH RECURSIVE {A.FEED_SQL}, h AS (SELECT document_id, seq, epoch_us(ts)::DOUBLE / 1e6 AS t, level = 'error' AS forced, row_number() OVER (PARTITION BY document_id ORDER BY ts, seq) AS n FROM feed), "
    "r AS (SELECT document_id, seq, n, true AS committed, t AS last FROM h WHERE n = 1 UNION ALL SELECT h.document_id, h.seq, h.n, h.forced OR h.t - r.last >= 43200, CASE WHEN h.forced OR h.t - r.last >= 43200 THEN h.t ELSE r.last END "
    "FROM r JOIN h ON h.document_id = r.document_id AND h.n = r.n + 1) SELECT document_id, seq, committed FROM r"
)
def heartbeat_commits(spark: SparkSession, d: str) -> DataFrame:
    """STR-02: which entries of the feed are committed at most every twelve hours (the table's pace), errors always."""
    feed = A.feed(spark, d).withColumn("forced", F.col("level") == "error")
    return lifecycle.commits(feed, 43200.0)


# -------------------------------------------------------------- the way of the pages
_TYPES = ("text/plain", "application/pdf", "image/png", "application/zip", C.CONTENT_TYPES[".docx"])


@query(
    f"WITH d AS (SELECT doc_id, {list(_TYPES)}[doc_id % 5 + 1] AS kind, CASE WHEN doc_id % 7 = 0 THEN '  ' || left(text, 12) ELSE text END AS text FROM documents) "
    "SELECT doc_id, CASE WHEN kind = 'text/plain' OR doc_id % 5 = 4 THEN 'parse' WHEN kind = 'application/pdf' AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 20 THEN 'layout' WHEN kind IN ('application/pdf', 'image/png') THEN 'ocr' ELSE 'unavailable' END AS route FROM d"
)
def page_routes(spark: SparkSession, d: str) -> DataFrame:
    """ORC-01, ORC-06: the route of every document, as if it were of each content type in turn; some have too little text."""
    from ..sources.files import route_pages

    k = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (k % 5 + 1).cast("int"))
    text = F.when(k % 7 == 0, F.concat(F.lit("  "), F.substring("text", 1, 12))).otherwise(F.col("text"))
    return route_pages(table(spark, d, "documents").select("doc_id", kind.alias("content_type"), text.alias("text"))).select("doc_id", "route")


@query(
    f"WITH r AS (SELECT p_size AS doc_id, p_partkey % 3 AS k, {_NAME} AS n, p_size::VARCHAR AS v, (p_size + 7)::VARCHAR AS hi, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS reading_order FROM part) "
    "SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, n AS name, v AS value, CASE k WHEN 0 THEN '10*3/uL' ELSE 'mg/dL' END AS unit, CASE k WHEN 0 THEN v || '-' || hi END AS reference_range, 0.65::DOUBLE AS confidence, 'digital' AS source FROM r WHERE k < 2"
)
def extracted_texts(spark: SparkSession, d: str) -> DataFrame:
    """ORC-01, ORC-04, SRC-07: parts as text pages by size, a printed row a line: laid out, parsed, confidence capped."""
    from ..operators import reports

    rows = table(spark, d, "part").select("p_size", "p_partkey", F.expr(f"CASE p_partkey % 3 WHEN 0 THEN {_shape_sql(_SHAPES[0][0][0], 'STRING')} WHEN 1 THEN {_shape_sql(_SHAPES[6][0][0], 'STRING')} ELSE {_shape_sql(_SHAPES[8][0][0], 'STRING')} END").alias("line"))
    pages = rows.groupBy(F.col("p_size").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))).alias("l")).select("doc_id", F.lit(1).alias("page"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    tests = reports.extract(texts=pages)
    return tests.select("doc_id", F.col("reading_order").cast("int").alias("reading_order"), "name", "value", "unit", "reference_range", "confidence", "source")


@query(
    f"WITH {_PAGE_LINES}, c AS (SELECT doc_id, page, sum(length(text)) AS n FROM lines GROUP BY ALL) SELECT doc_id, page, CASE WHEN n >= {C.DIGITAL_PAGE_MIN_CHARS} THEN 'digital' ELSE 'scanned' END AS path, "
    f"CASE WHEN n >= {C.DIGITAL_PAGE_MIN_CHARS} THEN 'text layer has ' || n::VARCHAR || ' characters' ELSE 'only ' || n::VARCHAR || ' characters in the text layer' END AS reason FROM c"
)
def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """ORC-02, FLT-01: the suppliers' pages with enough text go the digital way, the others with their reason."""
    return layout.classify_pages(page_lines(spark, d)).select("doc_id", "page", "path", "reason")
