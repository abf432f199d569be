"""Reading order of a page from positioned lines (WIN-01..05, JOIN-08, FLT-01/15, AGG-09): windows over (doc_id, page).

Lines: doc_id, page, line_idx, text, x0, y0, x1, y1, max_font, spans array<string>, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import strip

PAGE = ("doc_id", "page")


def classify_pages(lines: DataFrame) -> DataFrame:
    """FLT-01: digital if the lines' characters reach the minimum, else scanned, with the reason."""
    chars = lines.groupBy(*PAGE).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    digital = F.col("chars") >= C.DIGITAL_PAGE_MIN_CHARS
    return chars.select(
        *PAGE, "chars", F.when(digital, "digital").otherwise("scanned").alias("path"),
        F.when(digital, F.format_string("text layer has %d characters", "chars")).otherwise(F.format_string("only %d characters in the text layer", "chars")).alias("reason"),
    )


def with_bands(lines: DataFrame, by: tuple[str, ...], name: str) -> DataFrame:
    """WIN-01: number of the y-band of each line: intervals that overlap or touch, directly or in a chain, share one."""
    order = Window.partitionBy(*by).orderBy("y0", "line_idx")
    reach = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("y0") - reach > 0, 1).otherwise(0)
    return lines.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def is_header_sized(font: Column, text: Column) -> Column:
    """FLT-15."""
    return font.between(C.HEADER_FONT_MIN, C.HEADER_FONT_MAX) & (F.length(text) <= C.HEADER_MAX_CHARS)


def with_headers(lines: DataFrame) -> DataFrame:
    """WIN-02: header marks the lines whose whole page band is header-sized."""
    banded = with_bands(lines, PAGE, "page_band")
    sized = is_header_sized(F.coalesce("max_font", F.lit(0.0)), F.col("text"))
    return banded.withColumn("header", F.bool_and(sized).over(Window.partitionBy(*PAGE, "page_band")))


def zones(headed: DataFrame) -> DataFrame:
    """WIN-03: zones of each page: one above the first header, then one per header, siblings split at the midpoints."""
    heads = headed.where("header")
    in_band = Window.partitionBy(*PAGE, "page_band")
    across = in_band.orderBy("x0", "y0", "line_idx")
    heads = heads.select(
        *PAGE, "page_band", F.min("y0").over(in_band).alias("y_start"),
        ((F.lag("x1").over(across) + F.col("x0")) / 2).alias("left"), ((F.col("x1") + F.lead("x0").over(across)) / 2).alias("right"),
        F.row_number().over(across).alias("sibling"),
    )
    below = Window.partitionBy(*PAGE).orderBy("page_band").rangeBetween(1, Window.unboundedFollowing)
    own = heads.select(
        *PAGE, "page_band", "sibling", "y_start", F.coalesce(F.min("y_start").over(below), F.lit(1.0)).alias("y_end"), F.coalesce("left", F.lit(0.0)).alias("x_start"), F.coalesce("right", F.lit(1.0)).alias("x_end")
    )
    top = headed.groupBy(*PAGE).agg(F.min(F.when(F.col("header"), F.col("y0"))).alias("first")).select(
        *PAGE, F.lit(-1).cast("long").alias("page_band"), F.lit(0).alias("sibling"), F.lit(0.0).alias("y_start"), F.coalesce("first", F.lit(1.0)).alias("y_end"),
        F.lit(0.0).alias("x_start"), F.lit(1.0).alias("x_end"),
    )
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("page_band", "sibling")) - 1
    return top.unionByName(own).select(*PAGE, number.alias("zone"), "y_start", "y_end", "x_start", "x_end")


#: Bins of a page's width in which lines meet the zones of their band.
X_BINS = 8


def assign_zones(headed: DataFrame, zone_table: DataFrame) -> DataFrame:
    """JOIN-08: the first zone that holds a line's top and centre, else the page's last zone.

    A range join in two steps that never pairs all lines of a page with all its zones. The bands of zones don't overlap
    in y, so one sweep down the page tells each line its band; within the band, zones lie in the bins of the width that
    they touch, and a line meets those of its own bin only.
    """
    real = zone_table.where((F.col("y_start") < F.col("y_end")) & (F.col("x_start") < F.col("x_end")))
    edges = zone_table.groupBy(*PAGE, "y_start", "y_end").agg(F.max("zone").alias("_most")).select(*PAGE, F.col("y_start").alias("y0"), F.col("y_end").alias("_end"), "_most", F.lit(0).alias("_kind"))
    both = headed.withColumn("_kind", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    down = Window.partitionBy(*PAGE).orderBy("y0", "_kind", "_end").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.when((F.col("_kind") == 0) & (F.col("y0") < F.col("_end")), F.struct(F.col("y0").alias("start"), F.col("_end").alias("end")))
    swept = both.withColumns({"_band": F.last(open_, ignorenulls=True).over(down), "_last": F.max("_most").over(Window.partitionBy(*PAGE))}).where("_kind = 1")
    centre = (F.col("x0") + F.col("x1")) / 2
    bin_of = lambda x: F.least(F.greatest(F.floor(x * X_BINS), F.lit(0)), F.lit(X_BINS - 1)).cast("int")
    swept = swept.withColumns({"_y": F.when(F.col("y0") < F.col("_band.end"), F.col("_band.start")), "_bin": bin_of(centre)})
    packed = real.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("x_start")), bin_of(F.col("x_end"))))).groupBy(*PAGE, F.col("y_start").alias("_y"), "_bin").agg(
        F.array_sort(F.collect_list(F.struct("zone", "x_start", "x_end"))).alias("_zones")
    )
    held = F.filter("_zones", lambda z: (z["x_start"] <= centre) & (centre < z["x_end"]))
    zone = F.coalesce(F.try_element_at(held, F.lit(1))["zone"], F.col("_last"))
    return swept.join(packed, [*PAGE, "_y", "_bin"], "left").withColumn("zone", zone).select(*headed.columns, "zone")


def zoned(lines: DataFrame) -> DataFrame:
    """``lines`` with page_band, header and zone, as ``assign_zones`` gives them for the zones of the lines themselves.

    All is done by windows over one deal of the lines by page, without a join. A band of headers ends where the next begins, so the last
    one above a line is the one that may hold it. Inside a band each zone ends where its neighbour begins: the first that holds a centre c >= 0
    is the number of inner borders whose running maximum is <= c. Zones that reach left of the page (c < 0) are listed and searched.
    """
    cols = lines.columns
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    banded = with_bands(lines, PAGE, "page_band")
    sized = is_header_sized(F.coalesce("max_font", F.lit(0.0)), F.col("text"))
    across = Window.partitionBy(*PAGE, "page_band").orderBy("x0", "y0", "line_idx")
    over_page = Window.partitionBy(*PAGE).orderBy("page_band", "x0", "y0", "line_idx")
    border = (F.lag("x1").over(across) + F.col("x0")) / 2
    headed = banded.withColumns({
        "header": F.bool_and(sized).over(across.rowsBetween(*whole)), "_y_start": F.min("y0").over(across.rowsBetween(*whole)), "_sibling": F.row_number().over(across),
        "_left": border, "_right": (F.col("x1") + F.lead("x0").over(across)) / 2,
    })
    is_head = F.col("header")
    below = Window.partitionBy(*PAGE).orderBy("page_band").rangeBetween(1, Window.unboundedFollowing)
    headed = headed.withColumns({
        "_border": F.when(is_head, F.max("_left").over(across.rowsBetween(Window.unboundedPreceding, 0))), "_own": F.sum(is_head.cast("long")).over(over_page.rowsBetween(Window.unboundedPreceding, 0)),
        "_last": F.sum(is_head.cast("long")).over(over_page.rowsBetween(*whole)), "_first": F.min(F.when(is_head, F.col("y0"))).over(over_page.rowsBetween(*whole)),
        "_y_end": F.coalesce(F.min(F.when(is_head, F.col("_y_start"))).over(below), F.lit(1.0)),
    })
    band = F.struct(F.col("page_band").alias("no"), F.col("_y_start").alias("start"), F.col("_y_end").alias("end"), (F.col("_own") - F.col("_sibling") + 1).alias("zone"))
    swept = headed.withColumn("_band", F.max(F.when(is_head & F.col("_y_start").isNotNull(), band)).over(Window.partitionBy(*PAGE).orderBy("y0")))
    centre, start, end = (F.col("x0") + F.col("x1")) / 2, F.coalesce("_left", F.lit(0.0)), F.coalesce("_right", F.lit(1.0))
    # a line stands at its centre, a header also at its border: both meet in the order of the width
    outside = F.when((start < 0) & (start < end), F.struct(F.col("_own").alias("zone"), start.alias("x_start"), end.alias("x_end")))
    kept = F.struct(*cols, "page_band", "header", "_last", "_first", "_band")
    line = F.struct(F.col("_band.no").alias("b"), centre.alias("at"), F.lit(0).alias("border"), F.lit(None).cast("double").alias("most"), F.lit(None).cast("struct<zone:bigint,x_start:double,x_end:double>").alias("outside"), kept.alias("l"))
    edge = F.struct(F.col("page_band").alias("b"), F.col("_border").alias("at"), F.lit(1).alias("border"), F.col("_border").alias("most"), outside.alias("outside"), F.lit(None).cast(_kind(headed, kept)).alias("l"))
    met = swept.select(*PAGE, F.explode(F.array_compact(F.array(line, F.when(is_head & F.col("_border").isNotNull(), edge)))).alias("e")).select(*PAGE, "e.*")
    along = Window.partitionBy(*PAGE, "b").orderBy("at")
    met = met.withColumns({
        "_n": F.sum("border").over(along), "_reach": F.greatest(F.lit(1.0), F.max("most").over(along.rowsBetween(*whole))), "_outside": F.array_sort(F.collect_list("outside").over(along.rowsBetween(*whole))),
    }).where("border = 0")
    y0, c = F.col("l.y0"), F.col("at")
    inside = (c >= 0) & (c < F.col("_reach"))
    left = F.try_element_at(F.filter("_outside", lambda z: (z["x_start"] <= c) & (c < z["x_end"])), F.lit(1))["zone"]
    in_band = F.when(inside, F.col("l._band.zone") + F.col("_n")).when(c < 0, left)
    zone = F.when(F.col("l._band").isNull(), F.when((y0 >= 0) & (y0 < F.coalesce("l._first", F.lit(1.0))) & (c >= 0) & (c < 1), F.lit(0).cast("long"))).when(y0 < F.col("l._band.end"), in_band)
    return met.select(*[F.col(x if x in PAGE else f"l.{x}").alias(x) for x in [*cols, "page_band", "header"]], F.coalesce(zone, F.col("l._last")).alias("zone"))


def _kind(df: DataFrame, column: Column):
    """The type of a column over ``df``."""
    return df.withColumn("_band", F.lit(None).cast("struct<no:bigint,start:double,end:double,zone:bigint>")).select(column).schema[0].dataType


def merge_rows(zoned: DataFrame) -> DataFrame:
    """WIN-04, AGG-09: bands inside a zone become rows, spans from left to right, boxes united."""
    banded = with_bands(zoned, (*PAGE, "zone"), "zone_band")
    parts = F.array_sort(F.collect_list(F.struct("x0", "y0", "line_idx", "spans")))
    rows = banded.groupBy(*PAGE, "zone", "zone_band").agg(
        parts.alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min_by("source", F.struct("x0", "y0", "line_idx")).alias("source")
    )
    return rows.withColumn("spans", F.flatten(F.transform("parts", lambda p: p["spans"]))).drop("parts")


def reading_order(lines: DataFrame) -> DataFrame:
    """WIN-05: rows with column_index (the zone), reading_order from 0, text, spans and box; zone by zone, top down."""
    rows = merge_rows(zoned(lines))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("zone", "zone_band")) - 1
    return rows.select(
        *PAGE, order.alias("reading_order"), F.col("zone").alias("column_index"), strip(F.array_join("spans", " ")).alias("text"), "spans", "source", "x0", "y0", "x1", "y1"
    )


def text_layout(texts: DataFrame) -> DataFrame:
    """SRC-07: (doc_id, page, text) to rows: blank lines go, the i-th of n gets the slice i/n .. (i+0.9)/n of the page."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"), lambda t: strip(t) != "")
    rows = texts.withColumn("_l", lines).select(*PAGE, F.size("_l").alias("n"), F.posexplode("_l").alias("reading_order", "text"))
    i, n = F.col("reading_order"), F.col("n")
    return rows.select(
        *PAGE, "reading_order", F.lit(None).cast("int").alias("column_index"), "text", F.array("text").alias("spans"), F.lit("digital").alias("source"),
        F.lit(0.0).alias("x0"), (i / n).alias("y0"), F.lit(1.0).alias("x1"), ((i + 0.9) / n).alias("y1"),
    )


def layout_spans(spans: DataFrame) -> DataFrame:
    """SRC-03: raw text spans in page units to lines: blank spans and empty lines go, boxes become fractions, bold is flag 16.

    spans: doc_id, page, block_type, line_idx, span_idx, text, x0, y0, x1, y1, font_size, flags, page_width, page_height.
    """
    kept = spans.where((F.col("block_type") == 0) & (strip(F.col("text")) != ""))
    kept = kept.withColumns({c: F.col(c) / F.col("page_width" if c[0] == "x" else "page_height") for c in ("x0", "y0", "x1", "y1")})
    own = F.array_sort(F.collect_list(F.struct("span_idx", "text")))
    return kept.groupBy(*PAGE, "line_idx").agg(
        own.alias("o"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("font_size").alias("max_font"), F.bool_or(F.col("flags").bitwiseAND(16) > 0).alias("is_bold"),
    ).select(
        *PAGE, "line_idx", strip(F.array_join(F.transform("o", lambda s: s["text"]), " ")).alias("text"), "x0", "y0", "x1", "y1", "max_font", "is_bold",
        F.transform("o", lambda s: s["text"]).alias("spans"), F.lit("digital").alias("source"),
    )


def ocr_lines(words: DataFrame) -> DataFrame:
    """SRC-21, FLT-12, WIN-10, AGG-10, SRT-05: recognised words to lines of phrases.

    words: doc_id, page, block_num, par_num, line_num, left, top, width, height, text, conf, page_width, page_height. Words that
    are blank or unsure go; a gap of more than 0.8 median word heights opens a new phrase.
    """
    line = (*PAGE, "block_num", "par_num", "line_num")
    kept = words.where((strip(F.col("text")) != "") & (F.col("conf") >= C.OCR_WORD_CONFIDENCE))
    # a line is short, so its words meet once, in an array that holds all that is asked of them
    ws, n = F.col("_ws"), F.size("_ws")
    lines = kept.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("left", "top", "text", "width", "height", "conf", "page_width", "page_height"))).alias("_ws"))
    heights = F.array_sort(F.filter(F.transform(ws, lambda w: w["height"]), lambda x: x.isNotNull()))
    middle = lambda h, k: F.try_element_at(h, F.floor((F.size(h) + k) / 2).cast("int"))
    lines = lines.withColumn("_heights", heights).withColumn("_h", (middle(F.col("_heights"), 1) + middle(F.col("_heights"), 2)) / 2)
    gap = lambda i: ws[i - 1]["left"] - (ws[i - 2]["left"] + ws[i - 2]["width"])
    lines = lines.withColumn("_at", F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (gap(i) > C.OCR_GAP_RATIO * F.col("_h"))))
    phrases = F.zip_with("_at", F.concat(F.slice("_at", 2, F.size("_at")), F.array(n + 1)), lambda a, b: F.slice(ws, a, b - a))
    of = lambda p, f: F.transform(p, f)
    phrase = lambda p: F.struct(
        F.array_join(of(p, lambda w: w["text"]), " ").alias("text"),
        (F.aggregate(p, F.lit(0.0), lambda s, w: s + w["conf"]) / F.size(p) / 100).alias("confidence"),
        (F.array_min(of(p, lambda w: w["left"])) / F.array_max(of(p, lambda w: w["page_width"]))).alias("x0"), (F.array_min(of(p, lambda w: w["top"])) / F.array_max(of(p, lambda w: w["page_height"]))).alias("y0"),
        (F.array_max(of(p, lambda w: w["left"] + w["width"])) / F.array_max(of(p, lambda w: w["page_width"]))).alias("x1"), (F.array_max(of(p, lambda w: w["top"] + w["height"])) / F.array_max(of(p, lambda w: w["page_height"]))).alias("y1"),
    )
    lines = lines.select(*line, F.transform(phrases, phrase).alias("_s")).select(
        *line, F.col("_s.text").alias("spans"), (F.aggregate("_s", F.lit(0.0), lambda s, p: s + p["confidence"]) / F.size("_s")).alias("confidence"),
        F.array_min("_s.x0").alias("x0"), F.array_min("_s.y0").alias("y0"), F.array_max("_s.x1").alias("x1"), F.array_max("_s.y1").alias("y1"),
    )
    place = Window.partitionBy(*PAGE).orderBy((F.col("y0") + F.col("y1")) / 2, "x0")
    return lines.select(
        *PAGE, (F.row_number().over(place) - 1).alias("line_idx"), F.array_join("spans", " ").alias("text"), "spans", "confidence", "x0", "y0", "x1", "y1",
        F.lit(0.0).alias("max_font"), F.lit("ocr").alias("source"),
    )


def score_attempts(rows: DataFrame) -> DataFrame:
    """AGG-11: recognition attempts (doc_id, page, attempt, mean_conf, unit, reference_range per row) to metrics and health."""
    unit, rng = F.col("unit").isNotNull(), F.col("reference_range").isNotNull()
    out = rows.groupBy(*PAGE, "attempt").agg(
        F.max("mean_conf").alias("mean_conf"), F.count("row_idx").alias("n_rows"),
        F.coalesce(F.avg(F.when(F.col("row_idx").isNotNull(), (unit | rng).cast("double"))), F.lit(0.0)).alias("complete"),
        (F.sum(F.when(F.col("row_idx").isNotNull(), 0.5 + 0.25 * unit.cast("int") + 0.25 * rng.cast("int")).otherwise(0.0)) * F.max("mean_conf")).alias("score"),
    )
    healthy = (F.col("n_rows") > 0) & (F.col("mean_conf") >= C.OCR_HEALTHY_CONFIDENCE) & (F.col("complete") >= C.OCR_COMPLETE_FRACTION)
    return out.withColumn("healthy", healthy)


def best_attempt(scored: DataFrame) -> DataFrame:
    """ORC-05, SRT-07: the first healthy attempt, else the first with the highest score."""
    order = Window.partitionBy(*PAGE).orderBy(F.when(F.col("healthy"), 0).otherwise(1), F.when(F.col("healthy"), 0.0).otherwise(-F.col("score")), "attempt")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
