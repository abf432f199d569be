"""Mapping observations to codes by a fixed precedence of stages (MAP-01..06, JOIN-01..03, FLT-16/17, JOIN-11, FN-38/39)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import clean, make_key
from ..session import dealt, materialise, ship
from ..sources.external import with_retry
from .retrieval import CodeIndex, presence_factor, search_candidates, text_query

RESULT = ("normalized_test_name", "loinc_code", "loinc_display", "mapping_status", "mapping_confidence", "mapping_stage", "mapping_rationale")
_TYPES = dict(zip(RESULT, ("string", "string", "string", "string", "double", "string", "string"), strict=True))


def result(name: Column, code=None, display=None, status="needs_review", confidence=None, stage="lexical_llm", why=None) -> Column:
    """MAP-04: the seven fields of a mapping."""
    values = (name, code, display, status, confidence, stage, why)
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[as_column(v).cast(_TYPES[n]).alias(n) for n, v in zip(RESULT, values, strict=True)])


def exact_matches(observations: DataFrame, index: DataFrame, catalog: DataFrame, rows: int | None = None) -> DataFrame:
    """JOIN-01/02: observations with exact_code, exact_canonical and exact_display where the cleaned name is an index key.

    ``rows``, the number of observations, deals them over tasks that hold the index's keys alone: rows stream past them unsorted,
    so a name of very many rows costs time but no memory.
    """
    named = index.join(catalog.select("loinc_num", F.col("long_common_name").alias("exact_display")), "loinc_num", "left").select(
        F.col("alias_key").alias("_key"), F.col("loinc_num").alias("exact_code"), F.col("canonical_name").alias("exact_canonical"), "exact_display"
    )
    asked = observations.withColumn("_name", clean(F.col("original_test_name")))
    if rows is not None:
        asked, named = dealt(asked, rows, "_name"), dealt(named, rows, "_key").hint("shuffle_hash")
    return asked.join(named, F.col("_name") == F.col("_key"), "left").drop("_name", "_key")


def learned_matches(observations: DataFrame, learned: DataFrame, catalog: DataFrame) -> DataFrame:
    """JOIN-03: adds learned_code and learned_name where name, specimen and unit were mapped before to a code that still exists."""
    known = learned.select("key", "loinc_num").join(catalog.select("loinc_num", "long_common_name"), "loinc_num").select(
        F.col("key").alias("_key"), F.col("loinc_num").alias("learned_code"), F.col("long_common_name").alias("learned_name")
    )
    key = make_key(F.col("original_test_name"), F.col("specimen"), F.col("unit"))
    return observations.join(known, key == F.col("_key"), "left").drop("_key")


def exact_key(*fields: Column) -> Column:
    """A text that differs wherever one of the (text) fields does, nulls and empty texts included: each with its length before it."""
    part = lambda c: F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[part(f.cast("string")) for f in fields])


def questions(observations: DataFrame, fields: tuple[str, ...], value: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(``observations`` with _ask, the distinct questions): rows that ask the same are answered once and meet the answer by _ask.

    A question has ``fields`` and, where the value counts, one of the same kind; _ask spells them out, so different
    questions never share it. Ids of rows need not be unique.
    """
    kind = F.lit(None).cast("double") if value is None else presence_factor(value, F.col("unit"))
    marked = observations.withColumn("_ask", exact_key(*[F.col(f) for f in fields], kind))
    asked = marked.select("_ask", *fields, kind.alias("_kind")).dropDuplicates(["_ask"])
    alike = F.when(F.col("_kind") == C.PRESENCE_QUALITATIVE, "word").when(F.col("_kind") == C.PRESENCE_QUANTITATIVE, "1")
    return marked, asked.withColumn("value", alike).drop("_kind")


def verdict_result(name: Column, hits: Column, verdict: Column) -> Column:
    """FLT-17: what a verifier's verdict (chosen_loinc_num, confidence, rationale) makes of the row."""
    chosen = F.nullif(verdict["chosen_loinc_num"], F.lit(""))
    confidence = F.coalesce(verdict["confidence"].try_cast("double"), F.lit(0.0))
    match = F.filter(hits, lambda h: h["loinc_num"] == chosen)
    picked = F.try_element_at(match, F.lit(1))["long_common_name"]
    status = F.when(confidence >= C.CONFIRM_CONFIDENCE, "confirmed").otherwise("needs_review")
    return (
        F.when(chosen.isNull(), result(name, status="unmapped", confidence=confidence, why=F.coalesce(F.nullif(verdict["rationale"], F.lit("")), F.lit("No candidate judged reliable."))))
        .when(F.size(match) == 0, result(name, confidence=confidence, why="Model chose a LOINC code outside the candidate list; discarded."))
        .otherwise(result(picked, chosen, picked, status, confidence, "lexical_llm", verdict["rationale"]))
    )


def unverified(name: Column, hint: Column, why: str, stage: str = "lexical_only") -> Column:
    hints = F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit(" Unverified suggestions: "), hint, F.lit("."))).otherwise("")
    return result(name, stage=stage, why=F.concat(F.lit(why), hints))


_NO_LLM = "No exact alias match and AI verification was unavailable; needs manual review."
_FAILED = "LLM verification call failed; needs manual review."


def _with_verdicts(rows: DataFrame, pending: Column, verifier: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """``rows`` with given (the verdict, null where none came) and _failed: pending rows are shown to the verifier, once for each id, so no row is multiplied."""
    shown = [c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("original_test_name", "value", "unit", "specimen", "method", "hits")]
    answers = verifier(rows.where(pending).select(key, *shown).dropDuplicates([key]))
    failed = F.col("failed") if "failed" in answers.columns else F.lit(False)
    given = F.struct("chosen_loinc_num", F.col("confidence").cast("string").alias("confidence"), "rationale")
    answers = answers.select(key, given.alias("given"), failed.alias("_failed")).dropDuplicates([key])
    return rows.join(answers, key, "left").withColumn("_failed", F.coalesce("_failed", F.lit(False)))


def _verdict(name: Column) -> Column:
    none = F.struct(F.lit(None).cast("string").alias("chosen_loinc_num"), F.lit("0").alias("confidence"), F.lit("No verdict returned.").alias("rationale"))
    return verdict_result(name, F.col("hits"), F.coalesce("given", none))


def map_rows(
    observations: DataFrame, index: DataFrame, catalog: DataFrame | CodeIndex, learned: DataFrame | None = None,
    verifier: Callable[[DataFrame], DataFrame] | None = None, mode: str = "off", key: str = "observation_id",
) -> DataFrame:
    """MAP-01: alias, learned, then retrieval with the verifier's mode: off, ambiguous (clear winners skip it) or all.

    ``catalog``: a stored index (``retrieval.build_index``), or a catalog that is indexed here. Only rows that the first two stages leave are searched. ``verifier`` takes (key, original_test_name, value, unit,
    specimen, method, hits) and returns (key, chosen_loinc_num, confidence, rationale) and, if it can fail, failed
    (``batch_verifier`` makes one of a plain call); rows it leaves out count as unanswered (JOIN-11), failed ones and
    all of a null verifier as a failed call (MAP-03). Rows that share an id get one verdict. With a mode other than off there is a column llm_failed.
    """
    name = F.col("original_test_name")
    marked, asked = questions(observations, ("original_test_name", "specimen", "unit", "method"), F.col("value"))
    codes = catalog.codes if isinstance(catalog, CodeIndex) else catalog
    rows = exact_matches(asked, index, codes)
    if learned is not None:
        rows = learned_matches(rows, learned, codes)
    else:
        rows = rows.withColumns({"learned_code": F.lit(None).cast("string"), "learned_name": F.lit(None).cast("string")})
    open_ = rows.where(F.col("exact_code").isNull() & F.col("learned_code").isNull())
    found = search_candidates(open_.select(F.col("_ask").alias("query_id"), name.alias("name"), "specimen", "unit", "method", "value"), catalog)
    answers = rows.select("_ask", "exact_code", "exact_canonical", "exact_display", "learned_code", "learned_name").join(found.withColumnRenamed("query_id", "_ask"), "_ask", "left")
    if mode != "off" and verifier is not None:  # the verifier's rows and all rows read them
        answers = materialise(answers, "answers")
    rows = marked.join(answers, "_ask", "left").drop("_ask")
    if mode == "off":
        last = unverified(name, F.col("hint"), _NO_LLM)
    else:
        clear = F.lit(mode == "ambiguous") & F.coalesce("clear_winner", F.lit(False))
        top = F.try_element_at("hits", F.lit(1))
        pending = F.col("exact_code").isNull() & F.col("learned_code").isNull() & ~clear & F.col("hits").isNotNull()
        failure = unverified(name, F.col("hint"), _FAILED, "error")
        if verifier is None:
            rows, verdict = rows.withColumn("_failed", pending), failure
        else:
            rows = _with_verdicts(rows, pending, verifier, key)
            verdict = F.when(F.col("_failed"), failure).otherwise(_verdict(name))
        last = (
            F.when(clear, result(top["long_common_name"], top["loinc_num"], top["long_common_name"], "confirmed", C.STAGE_CONFIDENCE["retrieval_auto"], "retrieval_auto", "Clear best match among LOINC candidates (name, specimen and unit agree)."))
            .when(F.col("hits").isNull(), result(name, status="unmapped", confidence=0.0, why="No candidate LOINC concepts found."))
            .otherwise(verdict)
        )
    mapped = (
        F.when(
            F.col("exact_code").isNotNull(),
            result(F.col("exact_canonical"), F.col("exact_code"), F.col("exact_display"), "confirmed", C.STAGE_CONFIDENCE["alias_exact"], "alias_exact", "Exact alias/name match against the official LOINC reference table."),
        )
        .when(
            F.col("learned_code").isNotNull(),
            result(F.col("learned_name"), F.col("learned_code"), F.col("learned_name"), "confirmed", C.STAGE_CONFIDENCE["learned"], "learned", "Same test name, specimen and unit as a mapping that was confirmed before."),
        )
        .otherwise(last)
    )
    out = rows.withColumn("_m", mapped)
    marks = [] if mode == "off" else [F.col("_failed").alias("llm_failed")]
    return out.select(*[c for c in observations.columns if c not in (*RESULT, *(["llm_failed"] if marks else []))], *[F.col(f"_m.{n}").alias(n) for n in RESULT], *marks)


def complete_mapping(observations: DataFrame, mapped: DataFrame, key: str = "observation_id") -> DataFrame:
    """MAP-05: every row with its mapping; rows that the mapping lost are left to a person, with the stage error."""
    given = mapped.select(F.col(key).alias("_id"), F.struct(*RESULT).alias("_m"))
    default = result(F.col("original_test_name"), stage="error", why="Mapping pipeline raised an exception; needs manual review.")
    out = observations.join(given, F.col(key) == F.col("_id"), "left").withColumn("_m", F.coalesce("_m", default))
    return out.select(*[c for c in observations.columns if c not in RESULT], *[F.col(f"_m.{n}").alias(n) for n in RESULT])


def map_single(
    observations: DataFrame, index: DataFrame, catalog: DataFrame | CodeIndex, key: str = "observation_id", verifier: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """MAP-02, MUT-06: the manual-row variant: alias, else the text form is searched (no unit, value or remembered picks).

    Without a verifier what is found is only hinted at; with one (as for ``map_rows``; rows without candidates are shown, too)
    its verdict counts, and there is a column llm_failed.
    """
    name = F.col("original_test_name")
    marked, asked = questions(observations, ("original_test_name", "specimen", "method"))
    codes = catalog.codes if isinstance(catalog, CodeIndex) else catalog
    rows = exact_matches(asked, index, codes)
    text = F.concat_ws(" | ", name, F.when(F.coalesce("specimen", F.lit("")) != "", F.concat(F.lit("specimen: "), "specimen")), F.nullif("method", F.lit("")))
    open_ = rows.where("exact_code IS NULL").select(F.col("_ask").alias("query_id"), text_query(text).alias("q")).select(
        "query_id", "q.name", "q.specimen", "q.method", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("value")
    )
    found = search_candidates(open_, catalog).withColumnRenamed("query_id", "_ask")
    answers = rows.select("_ask", "exact_code", "exact_canonical", "exact_display").join(found, "_ask", "left")
    if verifier is not None:
        answers = materialise(answers, "answers")
    rows = marked.join(answers, "_ask", "left").drop("_ask")
    last = unverified(name, F.col("hint"), _NO_LLM)
    if verifier is not None:
        none = F.array().cast(rows.schema["hits"].dataType)
        rows = _with_verdicts(rows.withColumn("hits", F.coalesce("hits", none)), F.col("exact_code").isNull(), verifier, key)
        last = F.when(F.col("_failed"), result(name, stage="error", why=_FAILED)).otherwise(_verdict(name))
    mapped = F.when(
        F.col("exact_code").isNotNull(),
        result(F.col("exact_canonical"), F.col("exact_code"), F.col("exact_display"), "confirmed", C.STAGE_CONFIDENCE["alias_exact"], "alias_exact", "Exact alias/name match against the official LOINC reference table."),
    ).otherwise(last)
    out = rows.withColumn("_m", mapped)
    marks = [F.col("_failed").alias("llm_failed")] if verifier is not None else []
    return out.select(*[c for c in observations.columns if c not in (*RESULT, *(["llm_failed"] if marks else []))], *[F.col(f"_m.{n}").alias(n) for n in RESULT], *marks)


def to_remember(mapped: DataFrame) -> DataFrame:
    """FLT-16: confirmed model picks that are sure enough to be remembered."""
    return mapped.where(
        (F.col("mapping_stage") == "lexical_llm") & (F.col("mapping_status") == "confirmed") & F.col("loinc_code").isNotNull() & (F.col("mapping_confidence") >= C.REMEMBER_CONFIDENCE)
    )


def first_picks(picks: DataFrame) -> DataFrame:
    """WIN-11: picks (pos, name, specimen, unit, loinc_num) to one per key, the first; nameless and codeless ones go."""
    keyed = picks.where("coalesce(name, '') <> '' AND coalesce(loinc_num, '') <> ''").withColumn("key", make_key(F.col("name"), F.col("specimen"), F.col("unit")))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).where("_n = 1").drop("_n")


def remember(learned: DataFrame, picks: DataFrame, source: str, confidence: float | None) -> DataFrame:
    """MUT-05: the learned table after an upsert: new keys enter; a model's pick never replaces a reviewer's."""
    new = first_picks(picks).select("key", F.col("loinc_num").alias("new_code"))
    both = learned.join(new, "key", "full")
    takes = F.col("new_code").isNotNull() & (F.col("loinc_num").isNull() | F.lit(source == "review") | (F.col("source") != "review"))
    return both.select(
        "key",
        F.when(takes, F.col("new_code")).otherwise(F.col("loinc_num")).alias("loinc_num"),
        F.when(takes, F.lit(source)).otherwise(F.col("source")).alias("source"),
        F.when(takes, F.lit(confidence).cast("double")).otherwise(F.col("confidence")).alias("confidence"),
    )


def verify_batches(rows: DataFrame, by: tuple[str, ...] = ("document_id", "page_number"), key: str = "observation_id", size: int = C.VERIFY_BATCH) -> DataFrame:
    """FN-39: the batch of ``size`` rows that each row is verified in, counted within its page, so there is no global order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    return rows.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def batch_verifier(call: Callable[[list[dict]], list[dict | None]], key: str = "observation_id", size: int = C.VERIFY_BATCH, transient: Callable[[Exception], bool] = lambda e: False, **retry) -> Callable[[DataFrame], DataFrame]:
    """MAP-06, MAP-03, STR-09: a verifier for ``map_rows`` from a call that answers up to ``size`` items at once.

    An item has i, original_name, value, unit, specimen, method, candidates and text (FN-38); the answers name their i.
    A call is repeated while its errors are transient; one that fails in the end marks its own rows as failed. Batches
    are cut from the Arrow batches where the rows lie, without a shuffle; one of size 1 is the single form.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                fields = zip(part["original_test_name"], part["value"], part["unit"], part["specimen"], part["method"], part["hits"], part["text"], strict=True)
                items = [
                    {"i": i, "original_name": n, "value": v, "unit": u, "specimen": s, "method": m, "candidates": [dict(h) if isinstance(h, dict) else h.asDict() for h in hits], "text": t}
                    for i, (n, v, u, s, m, hits, t) in enumerate(fields)
                ]
                try:
                    answers = {int(a["i"]): a for a in with_retry(lambda items=items: call(items), transient, **retry) if isinstance(a, dict) and "i" in a}
                except Exception:
                    out += [(k, None, None, None, True) for k in part["_key"]]
                    continue
                for i, k in enumerate(part["_key"]):
                    if i in answers:
                        a = answers[i]
                        out.append((k, a.get("chosen_loinc_num"), None if a.get("confidence") is None else str(a["confidence"]), a.get("rationale"), False))
            yield pd.DataFrame(out, columns=[key, "chosen_loinc_num", "confidence", "rationale", "failed"])

    def verify(rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)
        text = batch_item(F.col("original_test_name"), F.col("value"), F.col("unit"), F.col("specimen"), F.col("hits"))
        asked = rows.select(F.col(key).alias("_key"), "original_test_name", "value", "unit", "specimen", "method", "hits", text.alias("text"))
        kind = rows.schema[key].dataType.simpleString()
        return asked.mapInPandas(run, f"`{key}` {kind}, chosen_loinc_num string, confidence string, rationale string, failed boolean")

    return verify


def batch_item(name: Column, value: Column, unit: Column, specimen: Column, hits: Column) -> Column:
    """FN-38: one row of a verification request as text."""
    show = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    lines = F.array_join(F.transform(hits, lambda h: F.concat(F.lit("  "), h["loinc_num"], F.lit(": "), h["long_common_name"])), "\n")
    return F.concat_ws("\n", F.format_string("test: %s; value: %s; unit: %s; specimen: %s", name, show(value), show(unit), show(specimen)), lines)
