"""Registered queries over the whole driver tables (or small literal fixtures) and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X
from ..functions import validate as V
from ..operators import export, layout, lifecycle, mapping, parse, quality, retrieval, store, terminology
from ..session import dealt
from ..sources.files import model_input
from ..sources.tables import table
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------- SQL building blocks
def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in C.STOPWORDS)


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], w))"


def unit_sql(x: str) -> str:
    bare = f"replace(trim(regexp_replace({x}, '\\[(H|L)\\]|\\[\\s*\\]', '', 'g')), 'µ', 'u')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.UNIT_VARIANTS.items())
    return f"CASE WHEN {bare} = '' THEN NULL WHEN lower({bare}) = 'ul' THEN 'uL' ELSE CASE lower({bare}) {cases} ELSE {bare} END END"


def uniq_sql(x: str) -> str:
    """Distinct list elements in order of first sight."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


_ALIAS_INDEX = f"""claims AS (
  SELECT {clean_sql('a')} AS alias_key, loinc_num FROM (SELECT loinc_num, unnest(list_concat(aliases, [long_common_name, shortname])) AS a FROM catalog) WHERE {clean_sql('a')} <> ''),
owned AS (SELECT alias_key, min(loinc_num) AS loinc_num FROM claims GROUP BY alias_key HAVING count(DISTINCT loinc_num) = 1),
alias_index AS (SELECT alias_key, loinc_num, coalesce(nullif(shortname, ''), long_common_name) AS canonical_name FROM owned JOIN catalog USING (loinc_num))"""


# ------------------------------------------------------------------- terminology
@query(f"WITH {A.CATALOG_SQL}, {_ALIAS_INDEX} SELECT * FROM alias_index")
def alias_index(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01, SET-05, FN-01."""
    return terminology.alias_index(A.catalog(spark, d))


@query(
    f"WITH {A.CATALOG_SQL}, {A.OBSERVATIONS_SQL}, {_ALIAS_INDEX} SELECT observation_id, document_id, original_test_name, alias_index.loinc_num AS loinc_code, canonical_name, long_common_name AS display "
    f"FROM observations LEFT JOIN alias_index ON {clean_sql('original_test_name')} = alias_key LEFT JOIN catalog ON catalog.loinc_num = alias_index.loinc_num"
)
def alias_exact_map(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-01, JOIN-02."""
    cat = A.catalog(spark, d)
    rows = mapping.exact_matches(A.observations(spark, d), terminology.alias_index(cat), cat, table(spark, d, "lineitem").count())
    return rows.select("observation_id", "document_id", "original_test_name", F.col("exact_code").alias("loinc_code"), F.col("exact_canonical").alias("canonical_name"), F.col("exact_display").alias("display"))


@query(
    f"WITH {A.CATALOG_SQL}, {_ALIAS_INDEX}, o AS (SELECT {clean_sql('a')} AS alias_key, loinc_num FROM (VALUES ('8-8', 'N One'), ('9-9', 'N Two'), ('none-0', 'N Three')) v(loinc_num, a)), "
    "f AS (SELECT alias_key, o.loinc_num, coalesce(nullif(shortname, ''), long_common_name) AS canonical_name FROM o JOIN catalog USING (loinc_num)) "
    "SELECT * FROM alias_index WHERE alias_key NOT IN (SELECT alias_key FROM f) UNION ALL SELECT * FROM f"
)
def alias_overrides(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-04, SRC-15: fixed names replace derived ones; codes that the catalog lacks are ignored."""
    cat = A.catalog(spark, d)
    fixed = terminology.overrides_table(spark, {"_comment": ("x",), "8-8": ("N One",), "9-9": ("N Two",), "none-0": ("N Three",)})
    return terminology.with_overrides(terminology.alias_index(cat), fixed, cat)


@query(
    f"WITH {A.CATALOG_SQL} SELECT DISTINCT {clean_sql('raw')} AS name FROM (SELECT unnest(list_concat(aliases, [shortname, component])) AS raw FROM catalog) WHERE length(raw) <= 10 AND length({clean_sql('raw')}) BETWEEN 1 AND 8"
)
def short_names(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02."""
    return terminology.short_names(A.catalog(spark, d))


_POSTINGS = f"""named AS (SELECT ord, list_distinct({tokens_sql("concat_ws(' ', nullif(long_common_name, ''), nullif(shortname, ''), nullif(component, ''))")}) AS own,
    list_distinct({tokens_sql("array_to_string(aliases, ' ')")}) AS other FROM catalog),
postings AS (SELECT unnest(own) AS token, ord, 1.0::DOUBLE AS weight FROM named UNION ALL SELECT unnest(list_filter(other, lambda t: NOT list_contains(own, t))) AS token, ord, 0.7::DOUBLE FROM named),
idf AS (SELECT token, count(*) AS df, ln(1 + (SELECT count(*) FROM catalog) / count(*)) AS idf FROM postings GROUP BY token)"""


@query(f"WITH {A.CATALOG_SQL}, {_POSTINGS} SELECT token, df, round(idf, 9) AS idf FROM idf")
def token_idf(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03, JOIN-13, SET-02, FN-03."""
    cat = A.catalog(spark, d)
    return terminology.token_idf(terminology.postings(cat), catalog=cat).withColumn("idf", F.round("idf", 9))


@query(
    f"WITH {A.CATALOG_SQL}, {_POSTINGS}, t AS (SELECT token, bool_or(weight = 1.0) AS n, bool_or(weight < 1.0) AS a FROM postings GROUP BY token) "
    "SELECT (SELECT count(*) FROM catalog) AS codes, (SELECT CAST(sum(len(aliases)) AS BIGINT) FROM catalog) AS aliases, count(*) FILTER (n) AS name_tokens, count(*) FILTER (a) AS alias_only_tokens FROM t"
)
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12, AGG-20."""
    return terminology.index_statistics(A.catalog(spark, d))


@query(
    f"WITH {A.CATALOG_SQL} SELECT count(*) AS codes, CAST(sum(len(aliases)) AS BIGINT) AS aliases, count(*) FILTER (common_test_rank > 400) AS stored_codes, "
    "CAST(sum(len(aliases)) FILTER (common_test_rank > 400) AS BIGINT) AS stored_aliases, count(*) <> count(*) FILTER (common_test_rank > 400) AS rewrite FROM catalog"
)
def sync_check(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14: the stored copy here lacks the commonest codes."""
    cat = A.catalog(spark, d)
    return store.needs_sync(cat, cat.where("common_test_rank > 400"))


# --------------------------------------------------------------------- retrieval
def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct name and type of the parts as a question with specimen, unit and value."""
    p = table(spark, d, "part").select("p_name", "p_type").distinct()
    n = F.length("p_name") % 3
    return p.select(
        F.concat_ws("|", "p_name", "p_type").alias("query_id"), F.col("p_name").alias("name"), F.col("p_type").alias("specimen"),
        F.when(n == 0, "g/dL").when(n == 1, "mg/dL").alias("unit"), F.lit(None).cast("string").alias("method"), F.when(n == 2, "Positive").alias("value"),
    )


_ASKED = """asked AS (SELECT p_name || '|' || p_type AS query_id, p_name AS name, p_type AS specimen, CASE length(p_name) % 3 WHEN 0 THEN 'g/dL' WHEN 1 THEN 'mg/dL' END AS unit,
    CASE WHEN length(p_name) % 3 = 2 THEN 'Positive' END AS value FROM (SELECT DISTINCT p_name, p_type FROM part))"""
_SYNONYMS = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SPECIMEN_SYNONYMS.items()) + " ELSE [] END"
_SEARCH = f"""features AS (SELECT *, 1 + 0.07 * greatest(1, len(list_distinct({tokens_sql('long_common_name')}))) AS norm,
    CASE WHEN common_test_rank > 0 AND common_test_rank <= 2000 THEN 1 - common_test_rank / 2000 ELSE 0 END AS prior,
    contains(long_common_name, '[Presence]') OR contains(long_common_name, '[Identifier]') AS presence,
    {tokens_sql('system')} AS system_tokens, regexp_replace(lower(coalesce(example_units, '')), '[^a-z0-9]', '', 'g') AS unit_key FROM catalog),
q1 AS (SELECT *, list_slice({uniq_sql(tokens_sql('name'))}, 1, 8) AS nt, {tokens_sql('specimen')} AS own, list_distinct(list_concat({tokens_sql('specimen')}, flatten(list_transform({tokens_sql('specimen')}, lambda t: {_SYNONYMS})))) AS spec,
    regexp_replace(lower(coalesce(unit, '')), '[^a-z0-9]', '', 'g') AS ukey,
    CASE WHEN coalesce(value, '') <> '' AND NOT regexp_matches(value, '[0-9]') THEN 1.2 WHEN coalesce(value, '') <> '' OR coalesce(unit, '') <> '' THEN 0.75 ELSE 0.9 END AS pf FROM asked),
q2 AS (SELECT *, list_concat(nt, list_slice(list_filter({uniq_sql('own')}, lambda t: NOT list_contains(nt, t)), 1, 2)) AS toks FROM q1),
qt AS (SELECT query_id, unnest(toks) AS token FROM q2),
total AS (SELECT query_id, sum(idf) AS total_idf FROM qt JOIN idf USING (token) GROUP BY query_id),
raw AS (SELECT query_id, ord, sum(idf * weight) AS raw FROM qt JOIN postings USING (token) JOIN idf USING (token) GROUP BY query_id, ord),
s0 AS (SELECT query_id, ord, loinc_num, long_common_name, system_tokens, unit_key, spec, ukey, raw / norm * (1 + 0.35 * prior) * CASE WHEN presence THEN pf ELSE 1 END AS s
    FROM raw JOIN features USING (ord) JOIN q2 USING (query_id)),
s1 AS (SELECT * REPLACE (CASE WHEN len(spec) > 0 AND row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, ord) <= 300
    THEN s * CASE WHEN list_has_any(system_tokens, spec) THEN 1.6 WHEN len(system_tokens) > 0 THEN 0.55 ELSE 1 END ELSE s END AS s) FROM s0),
s2 AS (SELECT * REPLACE (CASE WHEN ukey <> '' AND row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, ord) <= 300
    THEN s * CASE WHEN unit_key = ukey THEN 1.25 ELSE 1 END ELSE s END AS s) FROM s1),
hits AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, ord) AS INTEGER) AS rank, loinc_num, long_common_name, s FROM s2 QUALIFY rank <= 6),
top AS (SELECT query_id, rank, loinc_num, long_common_name, round(s / total_idf, 9) AS score FROM hits JOIN total USING (query_id))"""


@query(f"WITH {A.CATALOG_SQL}, {_POSTINGS}, {_ASKED}, {_SEARCH} SELECT query_id, rank, loinc_num, score FROM top")
def retrieval_topk(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-05/06, AGG-04, WIN-14, SRT-06, FN-32..35: the six best codes of every name and type, after specimen and unit."""
    return retrieval.search(_asked(spark, d), A.catalog(spark, d)).select("query_id", "rank", "loinc_num", "score")


@query(
    f"WITH {A.CATALOG_SQL}, {_POSTINGS}, {_ASKED}, {_SEARCH}, c AS (SELECT query_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b, "
    "string_agg(loinc_num || ' (' || long_common_name || ')', ', ' ORDER BY rank) FILTER (rank <= 3) AS hint FROM top GROUP BY query_id) "
    "SELECT query_id, a >= 1.3 AND (b IS NULL OR a - b >= 0.2 * a) AS clear_winner, hint FROM c"
)
def clear_winner(spark: SparkSession, d: str) -> DataFrame:
    """WIN-15, SRT-08."""
    return retrieval.search_candidates(_asked(spark, d), A.catalog(spark, d)).select("query_id", "clear_winner", "hint")


#: Systems of the codes and specimens of the questions, which agree only through the synonyms.
_SYSTEMS, _SPECIMENS = ("Ser/Plas", "Urine", "Bld", "Stool"), ("Serum", "Plasma sample", "Whole blood", "Venous blood", "Faeces", "Urine")
_BODY_CATALOG = A.CATALOG_SQL.replace("p_type AS system", f"{list(_SYSTEMS)}[p_size % 4 + 1] AS system")


def _body(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(questions, catalog) with specimens and systems of the body; some questions have a number as their value."""
    cat = A.catalog(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("ord"), "p_size"), "ord")
    cat = cat.withColumn("system", F.element_at(F.array(*[F.lit(x) for x in _SYSTEMS]), F.col("p_size") % 4 + 1)).drop("p_size")
    p = table(spark, d, "part").select("p_name", (F.col("p_size") % 6).alias("s")).distinct()
    specimen = F.element_at(F.array(*[F.lit(x) for x in _SPECIMENS]), F.col("s") + 1)
    value = F.when(F.col("s") == 0, "12.5").when(F.col("s") == 1, "Trace").when(F.col("s") == 2, "< 3")
    asked = p.select(
        F.concat_ws("|", "p_name", F.col("s").cast("string")).alias("query_id"), F.col("p_name").alias("name"), specimen.alias("specimen"), F.when(F.col("s") == 3, "g/dL").alias("unit"),
        F.lit(None).cast("string").alias("method"), value.alias("value"),
    )
    return asked, cat


_BODY_ASKED = f"""asked AS (SELECT p_name || '|' || s::VARCHAR AS query_id, p_name AS name, {list(_SPECIMENS)}[s + 1] AS specimen, CASE WHEN s = 3 THEN 'g/dL' END AS unit,
    CASE s WHEN 0 THEN '12.5' WHEN 1 THEN 'Trace' WHEN 2 THEN '< 3' END AS value FROM (SELECT DISTINCT p_name, p_size % 6 AS s FROM part))"""


@query(f"WITH {_BODY_CATALOG}, {_POSTINGS}, {_BODY_ASKED}, {_SEARCH} SELECT query_id, rank, loinc_num, score FROM top")
def retrieval_specimen(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-06, SET-03, FN-32: specimens that match systems through their synonyms; numbers, words and units as values."""
    asked, cat = _body(spark, d)
    return retrieval.search(asked, cat).select("query_id", "rank", "loinc_num", "score")


@query(
    f"WITH {A.CATALOG_SQL}, {_ALIAS_INDEX}, {_POSTINGS}, {_ASKED}, {_SEARCH}, c AS (SELECT query_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b, max(loinc_num) FILTER (rank = 1) AS one, max(loinc_num) FILTER (rank = 2) AS two, "
    "max(long_common_name) FILTER (rank = 1) AS one_name, max(long_common_name) FILTER (rank = 2) AS two_name FROM top GROUP BY query_id), "
    f"j AS (SELECT query_id, name, alias_index.loinc_num AS alias_code, catalog.long_common_name AS alias_name, a IS NULL AS none, a >= 1.3 AND (b IS NULL OR a - b >= 0.2 * a) AS clear, one, two, one_name, two_name "
    f"FROM asked LEFT JOIN alias_index ON {clean_sql('name')} = alias_key LEFT JOIN catalog ON catalog.loinc_num = alias_index.loinc_num LEFT JOIN c USING (query_id)) "
    "SELECT query_id AS observation_id, CASE WHEN alias_code IS NOT NULL THEN 'alias_exact' WHEN clear THEN 'retrieval_auto' WHEN none THEN 'lexical_llm' WHEN length(query_id) % 5 = 0 THEN 'error' ELSE 'lexical_llm' END AS mapping_stage, "
    "CASE WHEN alias_code IS NOT NULL THEN alias_code WHEN clear THEN one WHEN none OR length(query_id) % 5 IN (0, 1) THEN NULL ELSE two END AS loinc_code, "
    "CASE WHEN alias_code IS NOT NULL THEN alias_name WHEN clear THEN one_name WHEN none OR length(query_id) % 5 IN (0, 1) THEN NULL ELSE two_name END AS loinc_display, "
    "CASE WHEN alias_code IS NOT NULL OR clear THEN 'confirmed' WHEN none THEN 'unmapped' WHEN length(query_id) % 5 = 0 THEN 'needs_review' WHEN two IS NULL OR length(query_id) % 5 = 1 THEN 'unmapped' WHEN length(query_id) % 5 = 2 THEN 'confirmed' ELSE 'needs_review' END AS mapping_status, "
    "CAST(CASE WHEN alias_code IS NOT NULL THEN 0.98 WHEN clear THEN 0.85 WHEN none THEN 0.0 WHEN length(query_id) % 5 = 0 THEN NULL WHEN length(query_id) % 5 = 1 THEN 0.0 WHEN length(query_id) % 5 = 2 THEN 0.8 ELSE 0.5 END AS DOUBLE) AS mapping_confidence, "
    "alias_code IS NULL AND NOT none AND NOT clear AND length(query_id) % 5 = 0 AS llm_failed FROM j"
)
def map_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """MAP-01/03/04/06, JOIN-11, WIN-15, FLT-17: every question mapped with the verifier asked about unclear ones; it takes the second hit, fails on some rows and answers nothing on others."""
    cat = A.catalog(spark, d)
    rows = _asked(spark, d).select(F.col("query_id").alias("observation_id"), F.col("name").alias("original_test_name"), "specimen", "unit", "method", "value")

    def verifier(pending: DataFrame) -> DataFrame:
        n = F.length("observation_id") % 5
        second = F.try_element_at("hits", F.lit(2))["loinc_num"]
        return pending.where(n != 1).select("observation_id", second.alias("chosen_loinc_num"), F.when(n == 2, 0.8).otherwise(0.5).alias("confidence"), F.lit("second").alias("rationale"), (n == 0).alias("failed"))

    mapped = mapping.map_rows(rows, terminology.alias_index(cat), cat, verifier=verifier, mode="ambiguous")
    return mapped.select("observation_id", "mapping_stage", "loinc_code", "loinc_display", "mapping_status", "mapping_confidence", F.coalesce("llm_failed", F.lit(False)).alias("llm_failed"))


#: Where the same words stand in different fields, or in none: specimen, method and unit of the four rows that every part gives.
_PLACES = (("p_type", None, None), (None, "p_type", None), ("", "p_type", None), ("p_type", "p_brand", "mg/dL"))
_PLACED = "placed AS (" + " UNION ALL ".join(
    f"SELECT p_partkey * 10 + {i} AS observation_id, p_brand || ' ' || p_name AS name, " + ", ".join(f"{'NULL::VARCHAR' if x is None else x if x.startswith('p_') else repr(x)} AS {n}" for n, x in zip(("specimen", "method", "unit"), place, strict=True)) + " FROM part"
    for i, place in enumerate(_PLACES)
) + "), asked AS (SELECT observation_id AS query_id, name, specimen, method, unit, NULL::VARCHAR AS value FROM placed)"
_SEARCH_PLACED = _SEARCH.replace(
    "list_concat(nt, list_slice(list_filter({0}, lambda t: NOT list_contains(nt, t)), 1, 2)) AS toks FROM q1)".format(uniq_sql("own")),
    f"list_concat(nm, list_slice(list_filter({uniq_sql('own')}, lambda t: NOT list_contains(nm, t)), 1, 2)) AS toks FROM (SELECT *, list_concat(nt, list_slice(list_filter({uniq_sql(tokens_sql('method'))}, lambda t: NOT list_contains(nt, t)), 1, 2)) AS nm FROM q1))",
)


@query(
    f"WITH {A.CATALOG_SQL}, {_ALIAS_INDEX}, {_POSTINGS}, {_PLACED}, {_SEARCH_PLACED}, c AS (SELECT query_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b, max(loinc_num) FILTER (rank = 1) AS one, "
    "string_agg(loinc_num || ' (' || long_common_name || ')', ', ' ORDER BY rank) FILTER (rank <= 3) AS hint FROM top GROUP BY query_id), "
    f"j AS (SELECT observation_id, p.specimen, p.method, alias_index.loinc_num AS alias_code, a IS NULL AS none, coalesce(a >= 1.3 AND (b IS NULL OR a - b >= 0.2 * a), false) AS clear, one, hint FROM placed p LEFT JOIN alias_index ON {clean_sql('name')} = alias_key LEFT JOIN c ON c.query_id = p.observation_id) "
    "SELECT observation_id, specimen, method, CASE WHEN alias_code IS NOT NULL THEN 'alias_exact' WHEN clear THEN 'retrieval_auto' WHEN none THEN 'lexical_llm' ELSE 'error' END AS mapping_stage, CASE WHEN alias_code IS NOT NULL THEN alias_code WHEN clear THEN one END AS loinc_code, "
    "CASE WHEN alias_code IS NOT NULL THEN 'Exact alias/name match against the official LOINC reference table.' WHEN clear THEN 'Clear best match among LOINC candidates (name, specimen and unit agree).' WHEN none THEN 'No candidate LOINC concepts found.' "
    "ELSE 'LLM verification call failed; needs manual review.' || ' Unverified suggestions: ' || hint || '.' END AS mapping_rationale FROM j"
)
def map_placed(spark: SparkSession, d: str) -> DataFrame:
    """MAP-01/03: every part asked four times with the same words as specimen, as method, beside an empty field and with a unit: each row keeps its own answer."""
    cat = A.catalog(spark, d)
    value = lambda x: F.lit(x).cast("string") if x is None or not x.startswith("p_") else F.col(x)
    places = F.array(*[F.struct(F.lit(i).alias("i"), *[value(x).alias(n) for n, x in zip(("specimen", "method", "unit"), place, strict=True)]) for i, place in enumerate(_PLACES)])
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("original_test_name"), F.explode(places).alias("x"))
    rows = rows.select((F.col("p_partkey") * 10 + F.col("x.i")).alias("observation_id"), "original_test_name", "x.specimen", "x.method", "x.unit", F.lit(None).cast("string").alias("value"))
    mapped = mapping.map_rows(rows, terminology.alias_index(cat), cat, mode="ambiguous")
    return mapped.select("observation_id", "specimen", "method", "mapping_stage", "loinc_code", "mapping_rationale")


@query(
    f"WITH {A.CATALOG_SQL}, {A.OBSERVATIONS_SQL}, {_ALIAS_INDEX} SELECT observation_id, document_id, CASE WHEN alias_index.loinc_num IS NOT NULL THEN 'alias_exact' ELSE 'lexical_only' END AS mapping_stage, alias_index.loinc_num AS loinc_code, long_common_name AS loinc_display, "
    "coalesce(canonical_name, original_test_name) AS normalized_test_name, CASE WHEN alias_index.loinc_num IS NOT NULL THEN 0.98 END AS mapping_confidence "
    f"FROM observations LEFT JOIN alias_index ON {clean_sql('original_test_name')} = alias_key LEFT JOIN catalog ON catalog.loinc_num = alias_index.loinc_num"
)
def map_singles(spark: SparkSession, d: str) -> DataFrame:
    """MAP-02, MUT-06: every observation mapped the way a hand-made row is: by name alone."""
    cat = A.catalog(spark, d)
    rows = mapping.map_single(A.observations(spark, d), terminology.alias_index(cat), cat)
    return rows.select("observation_id", "document_id", "mapping_stage", "loinc_code", "loinc_display", "normalized_test_name", "mapping_confidence")


@query(
    f"WITH {A.CATALOG_SQL}, {_ALIAS_INDEX}, {_ASKED}, m AS (SELECT query_id, alias_index.loinc_num AS a FROM asked LEFT JOIN alias_index ON {clean_sql('name')} = alias_key) "
    "SELECT query_id AS observation_id, CASE WHEN length(query_id) % 4 = 0 THEN 'error' WHEN a IS NOT NULL THEN 'alias_exact' ELSE 'lexical_only' END AS mapping_stage, CASE WHEN length(query_id) % 4 <> 0 THEN a END AS loinc_code, "
    "CASE WHEN length(query_id) % 4 <> 0 AND a IS NOT NULL THEN 'confirmed' ELSE 'needs_review' END AS mapping_status FROM m"
)
def mapping_defaults(spark: SparkSession, d: str) -> DataFrame:
    """MAP-05: rows whose mapping was lost are left to a person."""
    cat = A.catalog(spark, d)
    rows = _asked(spark, d).select(F.col("query_id").alias("observation_id"), F.col("name").alias("original_test_name"), "specimen", "unit", "method", "value")
    mapped = mapping.map_single(rows, terminology.alias_index(cat), cat).where("length(observation_id) % 4 <> 0")
    return mapping.complete_mapping(rows, mapped).select("observation_id", "mapping_stage", "loinc_code", "mapping_status")


@query(
    f"WITH {A.OBSERVATIONS_SQL}, o AS (SELECT *, CASE page_number % 3 WHEN 0 THEN 'lexical_llm' WHEN 1 THEN 'learned' ELSE 'retrieval_auto' END AS stage FROM observations) "
    "SELECT observation_id, document_id FROM o WHERE stage = 'lexical_llm' AND mapping_status = 'confirmed' AND extraction_confidence >= 0.9"
)
def picks_to_remember(spark: SparkSession, d: str) -> DataFrame:
    """FLT-16."""
    n = F.col("page_number") % 3
    rows = A.observations(spark, d).withColumns({"mapping_stage": F.when(n == 0, "lexical_llm").when(n == 1, "learned").otherwise("retrieval_auto"), "loinc_code": F.lit("1-1"), "mapping_confidence": F.col("extraction_confidence")})
    return mapping.to_remember(rows).select("observation_id", "document_id")


@query(
    f"WITH {A.CATALOG_SQL}, {A.OBSERVATIONS_SQL}, {_ALIAS_INDEX}, {_POSTINGS}, m AS (SELECT *, {clean_sql('original_test_name')} AS k FROM observations), "
    f"learned AS (SELECT DISTINCT left({clean_sql('p_name')} || '|' || {clean_sql('p_type')} || '|mg dl h', 512) AS key FROM part WHERE p_size % 2 = 0), "
    f"j AS (SELECT m.*, alias_index.loinc_num AS a, l.key AS l FROM m LEFT JOIN alias_index ON k = alias_key LEFT JOIN learned l ON l.key = left(k || '|' || {clean_sql('specimen')} || '|' || {clean_sql("coalesce(unit, '')")}, 512)) "
    "SELECT CASE WHEN a IS NOT NULL THEN 'alias_exact' WHEN l IS NOT NULL THEN 'learned' ELSE 'lexical_only' END AS mapping_stage, "
    "CASE WHEN a IS NOT NULL OR l IS NOT NULL THEN 'confirmed' ELSE 'needs_review' END AS mapping_status, count(*) AS n FROM j GROUP BY ALL"
)
def map_stages(spark: SparkSession, d: str) -> DataFrame:
    """MAP-01/04, JOIN-03, FN-05: rows by stage with verification off; names with specimen and unit of half the parts are remembered."""
    cat = A.catalog(spark, d)
    p = table(spark, d, "part").where("p_size % 2 = 0")
    key = X.make_key(F.col("p_name"), F.col("p_type"), F.lit(" MG/DL [H]"))
    code = F.concat(F.col("p_partkey").cast("string"), F.lit("-"), (F.col("p_partkey") % 10).cast("string"))
    learned = p.groupBy(key.alias("key")).agg(F.min(code).alias("loinc_num"))
    rows = mapping.map_rows(A.observations(spark, d), terminology.alias_index(cat), cat, learned)
    return rows.groupBy("mapping_stage", "mapping_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH l(key, loinc_num, source, confidence) AS (SELECT n_name, n_nationkey::VARCHAR, CASE WHEN n_nationkey % 2 = 0 THEN 'review' ELSE 'llm' END, 0.9::DOUBLE FROM nation WHERE n_nationkey < 20), "
    f"p AS (SELECT DISTINCT ON (key) left({clean_sql('n_name')} || '||', 512) AS key, 'new' || n_regionkey::VARCHAR AS code FROM nation WHERE n_nationkey >= 5 ORDER BY key, n_nationkey), "
    f"l2 AS (SELECT left({clean_sql('key')} || '||', 512) AS key, loinc_num, source, confidence FROM l) "
    "SELECT key, CASE WHEN t THEN code ELSE loinc_num END AS loinc_num, CASE WHEN t THEN 'llm' ELSE source END AS source, CASE WHEN t THEN 0.95 ELSE confidence END AS confidence "
    "FROM (SELECT *, code IS NOT NULL AND (loinc_num IS NULL OR source <> 'review') AS t FROM l2 FULL JOIN p USING (key))"
)
def learned_upsert(spark: SparkSession, d: str) -> DataFrame:
    """MUT-05, WIN-11: picks of a model over a table in which reviewers' picks stay."""
    n = table(spark, d, "nation")
    none = F.lit(None).cast("string")
    learned = n.where("n_nationkey < 20").select(
        X.make_key(F.col("n_name"), none, none).alias("key"), F.col("n_nationkey").cast("string").alias("loinc_num"),
        F.when(F.col("n_nationkey") % 2 == 0, "review").otherwise("llm").alias("source"), F.lit(0.9).alias("confidence"),
    )
    picks = n.where("n_nationkey >= 5").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), none.alias("specimen"), none.alias("unit"), F.concat(F.lit("new"), F.col("n_regionkey").cast("string")).alias("loinc_num"))
    return mapping.remember(learned, picks, "llm", 0.95)


# ------------------------------------------------------------------------ quality
@query(
    f"WITH {A.CATALOG_SQL}, {A.OBSERVATIONS_SQL}, {_ALIAS_INDEX}, m AS (SELECT document_id, CASE WHEN alias_index.loinc_num IS NOT NULL THEN 'confirmed' ELSE 'needs_review' END AS s "
    f"FROM observations LEFT JOIN alias_index ON {clean_sql('original_test_name')} = alias_key) SELECT document_id, count(*) AS total_observations, count(*) FILTER (s = 'confirmed') AS confirmed_count, "
    "count(*) FILTER (s = 'needs_review') AS needs_review_count, 0::BIGINT AS unmapped_count, round(count(*) FILTER (s = 'needs_review') / count(*), 3) AS review_needed_ratio FROM m GROUP BY document_id"
)
def doc_quality(spark: SparkSession, d: str) -> DataFrame:
    """FN-01, AGG-01, JOIN-01, AGG-05/08: every observation mapped by exact alias, quality per document (the flagship)."""
    cat = A.catalog(spark, d)
    rows = mapping.exact_matches(A.observations(spark, d), terminology.alias_index(cat), cat, table(spark, d, "lineitem").count())
    mapped = rows.select("document_id", F.when(F.col("exact_code").isNotNull(), "confirmed").otherwise("needs_review").alias("mapping_status"))
    return quality.status_counts(mapped)


@query(
    f"WITH {A.OBSERVATIONS_SQL}, p AS (SELECT document_id, lower(trim(original_test_name)) AS name FROM observations GROUP BY document_id, page_number, lower(trim(original_test_name)) HAVING count(*) > 1) "
    "SELECT document_id, list_sort(list(DISTINCT name)) AS possible_duplicate_test_names FROM p GROUP BY document_id"
)
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """AGG-06."""
    return quality.duplicate_names(A.observations(spark, d))


@query(
    f"WITH {A.OBSERVATIONS_SQL} SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY observation_id, original_test_name, extraction_confidence) - 1 AS place, observation_id, original_test_name, extraction_confidence FROM observations WHERE extraction_confidence < 0.7"
)
def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07: the list of doubtful rows of each document, entry by entry."""
    rows = quality.low_confidence(A.observations(spark, d))
    return rows.select("document_id", F.posexplode("low_confidence_extractions").alias("place", "r")).select("document_id", F.col("place").cast("long").alias("place"), "r.*")


@query(
    f"WITH {A.OBSERVATIONS_SQL}, c AS (SELECT document_id, count(*) AS total_observations, count(*) FILTER (mapping_status = 'confirmed') AS confirmed_count, count(*) FILTER (mapping_status = 'needs_review') AS needs_review_count, "
    "count(*) FILTER (mapping_status = 'unmapped') AS unmapped_count, list_sort(list(observation_id) FILTER (extraction_confidence < 0.7)) AS low FROM observations GROUP BY document_id), "
    "u AS (SELECT document_id, list_sort(list(DISTINCT name)) AS names FROM (SELECT document_id, lower(trim(original_test_name)) AS name FROM observations GROUP BY document_id, page_number, name HAVING count(*) > 1) GROUP BY document_id) "
    "SELECT document_id, total_observations, confirmed_count, needs_review_count, unmapped_count, round((needs_review_count + unmapped_count) / total_observations, 3) AS review_needed_ratio, "
    "coalesce(array_to_string(names, '; '), '') AS repeated, coalesce(array_to_string(list_transform(low, lambda x: x::VARCHAR), ' '), '') AS doubtful FROM c LEFT JOIN u USING (document_id)"
)
def report_detail(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06: the whole quality summary of each document."""
    q = quality.quality_summary(A.observations(spark, d))
    return q.select(
        "document_id", "total_observations", "confirmed_count", "needs_review_count", "unmapped_count", "review_needed_ratio", F.array_join("possible_duplicate_test_names", "; ").alias("repeated"),
        F.array_join(F.transform("low_confidence_extractions", lambda r: r["observation_id"].cast("string")), " ").alias("doubtful"),
    )


@query(f"WITH {A.QUEUE_SQL} SELECT count(*) AS total, count(*) FILTER (status IN ('pending', 'processing')) AS active, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'complete') AS complete FROM queue")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16."""
    return quality.dashboard(A.queue(spark, d))


@query(
    f"WITH {A.QUEUE_SQL} SELECT CASE WHEN status IN ('pending', 'processing') THEN 'active' WHEN status = 'complete' THEN 'done' ELSE 'issues' END AS bucket, count(*) AS n FROM queue WHERE contains(lower(filename), '7.pdf') GROUP BY ALL"
)
def report_tabs(spark: SparkSession, d: str) -> DataFrame:
    """FLT-08: tabs of the document list for a file-name search."""
    q = A.queue(spark, d).where(F.contains(F.lower("filename"), F.lit("7.pdf")))
    return q.groupBy(quality.list_bucket(F.col("status")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.OBSERVATIONS_SQL} SELECT document_id, mapping_status AS mapping_stage, count(*) AS n FROM observations GROUP BY ALL")
def stage_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14."""
    return quality.stage_histogram(A.observations(spark, d).withColumn("mapping_stage", F.col("mapping_status")))


@query("SELECT l_returnflag AS file, round(sum(l_extendedprice), 4) AS before, round(sum(l_tax), 4) AS after FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def prep_totals(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19: sums per file and the grand total."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_extendedprice").alias("before"), F.col("l_tax").alias("after"))
    return quality.with_grand_total(rows, "file", "before", "after")


@query(
    f"WITH {A.OBSERVATIONS_SQL} SELECT document_id, page_number, count(*) FILTER (extraction_confidence >= 0.65) AS kept, count(*) FILTER (extraction_confidence >= 0.65 AND flag = 'High') AS flagged, count(*) FILTER (extraction_confidence < 0.65) AS dropped FROM observations GROUP BY ALL"
)
def page_counters(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17."""
    rows = A.observations(spark, d).withColumns({"dropped": F.col("extraction_confidence") < 0.65, "notes": F.when(F.col("flag") == "High", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))})
    return quality.page_counters(rows)


@query(
    f"WITH {A.OBSERVATIONS_SQL}, p AS (SELECT document_id, page_number, count(*) FILTER (mapping_status = 'confirmed') AS n_rows, bool_or(flag = 'High') AS failed FROM observations GROUP BY ALL) "
    "SELECT document_id, CAST(sum(n_rows) AS BIGINT) AS n_rows, coalesce(bool_or(failed), false) AS any_failure, CASE WHEN coalesce(bool_or(failed), false) AND sum(n_rows) = 0 THEN 'failed' ELSE 'complete' END AS status, "
    "string_agg('page ' || page_number::VARCHAR, '; ' ORDER BY page_number) FILTER (failed) AS error_message FROM p GROUP BY document_id"
)
def finalize_documents(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18, STR-12, ORC-03."""
    pages = A.observations(spark, d).groupBy("document_id", "page_number").agg(F.count_if(F.col("mapping_status") == "confirmed").alias("n_rows"), F.coalesce(F.bool_or(F.col("flag") == "High"), F.lit(False)).alias("failed"))
    return quality.finalize_documents(pages.withColumn("reason", F.when(F.col("failed"), F.concat(F.lit("page "), F.col("page_number").cast("string")))))


@query("SELECT max(length(p_name)) AS p_name, max(length(p_brand)) AS p_brand, max(length(p_type)) AS p_type FROM part")
def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21."""
    return quality.text_lengths(table(spark, d, "part"), "p_name", "p_brand", "p_type")


# ----------------------------------------------------------------- scalar functions
@query(f"WITH {A.OBSERVATIONS_SQL} SELECT observation_id, {unit_sql('unit')} AS unit, regexp_replace(lower(coalesce(unit, '')), '[^a-z0-9]', '', 'g') AS unit_key FROM observations")
def unit_standardize(spark: SparkSession, d: str) -> DataFrame:
    """FN-02, FN-04."""
    return A.observations(spark, d).select("observation_id", X.standardize_unit(F.col("unit")).alias("unit"), X.unit_key(F.col("unit")).alias("unit_key"))


@query(f"SELECT doc_id, CAST(len({tokens_sql('text')}) AS INTEGER) AS n, array_to_string(list_sort(list_distinct({tokens_sql('text')})), ' ') AS words FROM documents")
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    """FN-03, SET-01."""
    t = X.tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(F.array_sort(F.array_distinct(t)), " ").alias("words"))


@query(f"WITH {A.OBSERVATIONS_SQL} SELECT observation_id, left({clean_sql('original_test_name')} || '|' || {clean_sql('specimen')} || '|' || {clean_sql("coalesce(unit, '')")}, 512) AS key FROM observations")
def learned_keys(spark: SparkSession, d: str) -> DataFrame:
    """FN-05."""
    return A.observations(spark, d).select("observation_id", X.make_key(F.col("original_test_name"), F.col("specimen"), F.col("unit")).alias("key"))


@query("SELECT doc_id, CASE WHEN length(text) > 512 THEN left(text, 511) || '…' ELSE text END AS clipped, CASE WHEN length(s) > 90 THEN left(s, 89) || '…' ELSE s END AS short FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)")
def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    """FN-20, FN-25."""
    return table(spark, d, "documents").select("doc_id", X.clip(F.col("text"), 512).alias("clipped"), X.short(F.col("text")).alias("short"))


@query(
    f"WITH {A.QUEUE_SQL}, t AS (SELECT *, CASE WHEN content_type <> 'application/octet-stream' THEN content_type WHEN ends_with(lower(filename), '.pdf') THEN 'application/pdf' WHEN ends_with(lower(filename), '.txt') THEN 'text/plain' ELSE content_type END AS kind FROM queue) "
    "SELECT document_id, kind, CASE WHEN kind = 'application/octet-stream' THEN 415 WHEN n_bytes > 15728640 THEN 413 WHEN n_bytes = 0 THEN 400 END AS problem, CASE WHEN kind = 'text/plain' THEN 'text' ELSE 'pdf' END AS source FROM t"
)
def upload_checks(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01, SRC-08, SRC-09."""
    q = A.queue(spark, d).withColumn("kind", X.resolve_content_type(F.col("filename"), F.col("content_type")))
    return q.select("document_id", "kind", X.upload_problem(F.col("kind"), F.col("n_bytes")).alias("problem"), X.page_source(F.col("kind")).alias("source"))


@query(f"WITH {A.QUEUE_SQL}, t AS (SELECT document_id, document_id // 8 AS batch_id, n_bytes > 15728640 OR n_bytes = 0 AS bad FROM queue) SELECT document_id, batch_id, NOT bool_or(bad) OVER (PARTITION BY batch_id) AS accepted FROM t")
def batch_ingest(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10: all or nothing per batch."""
    q = A.queue(spark, d).select("document_id", F.floor(F.col("document_id") / 8).alias("batch_id"), X.upload_problem(F.lit("text/plain"), F.col("n_bytes")).alias("problem"))
    return lifecycle.valid_batches(q).drop("problem")


@query(
    f"WITH {A.QUEUE_SQL} SELECT document_id, greatest(60, 15 * num_pages) AS budget_s, CAST(least(99, round((num_pages / 2 + 0.3) / 9 * 100, 0)) AS INTEGER) AS pct, CASE WHEN document_id % 2 = 0 THEN 1 ELSE greatest(1, num_pages) END AS workers FROM queue"
)
def budgets(spark: SparkSession, d: str) -> DataFrame:
    """FN-30, FN-31, FN-36."""
    dialect = F.when(F.col("document_id") % 2 == 0, "sqlite").otherwise("postgresql")
    return A.queue(spark, d).select(
        "document_id", X.document_budget(F.col("num_pages")).alias("budget_s"), X.percent_done(F.col("num_pages") / 2, F.lit(9)).alias("pct"), X.effective_concurrency(F.col("num_pages"), dialect).alias("workers")
    )


# ------------------------------------------------------------------------ validation
_RANGE_SQL = "try_cast(nullif(regexp_extract(reference_range, '(\\d+\\.?\\d*)\\s*-\\s*(\\d+\\.?\\d*)', {}), '') AS DOUBLE)"
_CHECK = f"""c AS (SELECT *, try_cast(nullif(regexp_extract(trim(value), '^[<>]?\\s?(\\d+\\.?\\d*)$', 1), '') AS DOUBLE) AS n, {_RANGE_SQL.format(1)} AS lo, {_RANGE_SQL.format(2)} AS hi, {unit_sql('unit')} AS std FROM observations),
f AS (SELECT *, list_filter([10.0, 100.0, 1000.0], lambda k: n / k >= lo * 0.5 AND n / k <= hi * 2.0) AS fits FROM c),
s AS (SELECT *, CASE WHEN NOT contains(value, '.') AND lo < hi AND n >= hi * 5 AND len(fits) = 1 THEN regexp_replace(regexp_replace(printf('%.4f', n / fits[1]::DOUBLE), '0+$', ''), '\\.$', '') END AS suggested_value,
    (coalesce(unit, '') <> '' AND NOT (coalesce(lower(std), '') IN ('g/dl', 'mg/dl'))) AS bad_unit,
    coalesce((lower(flag) = 'high' AND n <= hi) OR (lower(flag) = 'low' AND n >= lo), false) AS bad_flag FROM f)"""


@query(f"WITH {A.OBSERVATIONS_SQL}, {_CHECK} SELECT observation_id, suggested_value, bad_unit, bad_flag, round(greatest(0.2, least(1.0, extraction_confidence - CASE WHEN suggested_value IS NOT NULL THEN 0.25 ELSE 0 END - CASE WHEN bad_unit THEN 0.1 ELSE 0 END - CASE WHEN bad_flag THEN 0.1 ELSE 0 END)), 2) AS confidence, "
       "CAST((suggested_value IS NOT NULL)::INT + bad_unit::INT + bad_flag::INT AS INTEGER) AS n_notes, false AS dropped FROM s")  # fmt: skip
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    """FN-12..16, FN-18/19."""
    rows = V.validate_rows(A.observations(spark, d))
    return rows.select("observation_id", "suggested_value", "bad_unit", "bad_flag", "confidence", F.size("notes").alias("n_notes"), "dropped")


# ---------------------------------------------------------------------------- export
@query(
    f"WITH {A.OBSERVATIONS_SQL}, v AS (SELECT *, CASE document_id % 3 WHEN 0 THEN '<' || value WHEN 1 THEN ' ' || value ELSE value || '.50' END AS w FROM observations) "
    "SELECT observation_id, CASE WHEN regexp_matches(trim(w), '^[-+]?\\d+(\\.\\d+)?$') THEN trim(w)::DOUBLE END AS quantity, CASE WHEN NOT regexp_matches(trim(w), '^[-+]?\\d+(\\.\\d+)?$') THEN w END AS text_value, "
    "try_cast(regexp_extract(reference_range, '^\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*-\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*$', 1) AS DOUBLE) AS low, try_cast(regexp_extract(reference_range, '^\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*-\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*$', 2) AS DOUBLE) AS high FROM v"
)
def fhir_values(spark: SparkSession, d: str) -> DataFrame:
    """FN-22, FN-23."""
    k = F.col("document_id") % 3
    w = F.when(k == 0, F.concat(F.lit("<"), "value")).when(k == 1, F.concat(F.lit(" "), "value")).otherwise(F.concat("value", F.lit(".50")))
    rows = A.observations(spark, d).withColumn("w", w)
    span = export.reference_range(F.col("reference_range"))
    return rows.select(
        "observation_id", export.value_quantity(F.col("w"), F.col("unit"))["value"].alias("quantity"), export.value_string(F.col("w")).alias("text_value"), span["low"]["value"].alias("low"), span["high"]["value"].alias("high")
    )


@query(
    f"WITH {A.OBSERVATIONS_SQL}, {A.QUEUE_SQL} SELECT document_id, CAST(count(observation_id) + 1 AS INTEGER) AS n_entries, any_value(strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S')) AS stamp, "
    "'obs-' || arg_min(observation_id, (page_number, observation_id))::VARCHAR AS first_id FROM queue LEFT JOIN observations USING (document_id) GROUP BY document_id"
)
def fhir_bundles(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18, FN-24, SRT-03: bundles as JSON, read back."""
    obs = A.observations(spark, d).withColumns(
        {"created_at": F.col("created_at").cast("timestamp"), "loinc_code": F.lit("1-1"), "loinc_display": F.lit(None).cast("string"), "normalized_test_name": F.lit(None).cast("string"), "mapping_confidence": F.lit(0.5)}
    )
    out = export.bundles(A.queue(spark, d).select("document_id", "uploaded_at"), obs)
    at = lambda path: F.get_json_object("bundle", path)
    return out.select("document_id", F.json_array_length(at("$.entry")).alias("n_entries"), at("$.timestamp").alias("stamp"), at("$.entry[1].resource.id").alias("first_id"))


@query(
    f"WITH {A.OBSERVATIONS_SQL}, v AS (SELECT *, CASE document_id % 3 WHEN 0 THEN '<' || value ELSE value END AS w, CASE document_id % 4 WHEN 0 THEN 'see text' WHEN 1 THEN '' ELSE reference_range END AS r, CASE document_id % 5 WHEN 0 THEN NULL ELSE 'L-' || page_number::VARCHAR END AS code, "
    f"CASE document_id % 5 WHEN 1 THEN 'Shown' END AS display, CASE document_id % 2 WHEN 0 THEN 0.5::DOUBLE END AS sure, {unit_sql('unit')} AS std FROM observations), n AS (SELECT *, regexp_matches(trim(w), '^[-+]?\\d+(\\.\\d+)?$') AS num, regexp_matches(r, '^\\d+ - \\d+$') AS rng FROM v) "
    "SELECT observation_id, 'Observation' AS resource_type, 'obs-' || observation_id::VARCHAR AS id, 'final' AS status, 'laboratory' AS category, original_test_name AS code_text, code, CASE WHEN code IS NOT NULL THEN coalesce(display, original_test_name) END AS code_display, "
    "CASE WHEN num THEN w::DOUBLE END AS quantity, CASE WHEN num THEN std END AS quantity_unit, CASE WHEN NOT num THEN w END AS value_string, CASE WHEN rng THEN regexp_extract(r, '^(\\d+)', 1)::DOUBLE END AS low, CASE WHEN rng THEN regexp_extract(r, '(\\d+)$', 1)::DOUBLE END AS high, "
    "CASE WHEN NOT rng AND r <> '' THEN r END AS range_text, specimen, 'Source page ' || page_number::VARCHAR AS note, mapping_status AS extension_status, sure AS extension_confidence, CASE WHEN sure IS NULL THEN 1 ELSE 2 END AS n_extensions FROM n"
)
def fhir_resources(spark: SparkSession, d: str) -> DataFrame:
    """FN-24, FN-22/23: every field of every resource."""
    k = F.col("document_id")
    rows = A.observations(spark, d).withColumns(
        {
            "value": F.when(k % 3 == 0, F.concat(F.lit("<"), "value")).otherwise(F.col("value")), "reference_range": F.when(k % 4 == 0, "see text").when(k % 4 == 1, "").otherwise(F.col("reference_range")),
            "loinc_code": F.when(k % 5 != 0, F.concat(F.lit("L-"), F.col("page_number").cast("string"))), "loinc_display": F.when(k % 5 == 1, "Shown"), "normalized_test_name": F.lit(""), "mapping_confidence": F.when(k % 2 == 0, 0.5),
        }
    )
    r = rows.select("observation_id", export.observation_resource().alias("r")).select("observation_id", "r.*")
    first = lambda c: F.try_element_at(c, F.lit(1))
    span = first(F.col("referenceRange"))
    return r.select(
        "observation_id", F.col("resourceType").alias("resource_type"), "id", "status", first(first(F.col("category"))["coding"])["code"].alias("category"), F.col("code.text").alias("code_text"), first(F.col("code.coding"))["code"].alias("code"),
        first(F.col("code.coding"))["display"].alias("code_display"), F.col("valueQuantity.value").alias("quantity"), F.col("valueQuantity.unit").alias("quantity_unit"), F.col("valueString").alias("value_string"), span["low"]["value"].alias("low"), span["high"]["value"].alias("high"),
        span["text"].alias("range_text"), F.col("specimen.display").alias("specimen"), first(F.col("note"))["text"].alias("note"), first(F.col("extension"))["valueString"].alias("extension_status"), F.try_element_at("extension", F.lit(2))["valueDecimal"].alias("extension_confidence"), F.size("extension").alias("n_extensions"),
    )


# ----------------------------------------------------------------------- store
@query(f"WITH {A.OBSERVATIONS_SQL} SELECT observation_id, original_test_name, created_at FROM observations WHERE original_test_name ILIKE '%red%' AND mapping_status = 'unmapped' ORDER BY created_at DESC, observation_id LIMIT 200")
def observation_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-03, SRT-01: the limit is the feature."""
    rows = A.observations(spark, d).withColumns({"normalized_test_name": F.lit(None).cast("string"), "loinc_code": F.lit(None).cast("string")})
    return store.list_observations(rows, mapping_status="unmapped", q="red").select("observation_id", "original_test_name", "created_at")


@query(f"WITH {A.CATALOG_SQL} SELECT loinc_num, long_common_name FROM catalog WHERE long_common_name ILIKE '%brand#1%' OR shortname ILIKE '%brand#1%' OR component ILIKE '%brand#1%' OR loinc_num ILIKE '%brand#1%' ORDER BY loinc_num LIMIT 25")
def terminology_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04: the limit is the feature."""
    return store.search_terminology(A.catalog(spark, d), "brand#1").select("loinc_num", "long_common_name")


@query(f"WITH {A.QUEUE_SQL} SELECT document_id, filename, status FROM queue")
def report_list(spark: SparkSession, d: str) -> DataFrame:
    """FLT-05, SRT-02: the blob column is dropped before the scan reads it."""
    return store.list_reports(A.queue(spark, d).withColumn("raw_content", F.lit(b"x"))).select("document_id", "filename", "status")


@query("SELECT c_custkey AS document_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-12: rows without a document."""
    return store.orphans(table(spark, d, "customer").select(F.col("c_custkey").alias("document_id")), table(spark, d, "orders").select(F.col("o_custkey").alias("document_id")))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-07, MUT-03: rows that are left when documents go."""
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "document_id")
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("document_id"))
    return store.cascade_delete(rows, gone).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH p AS (SELECT p_partkey, p_name, p_brand FROM part) SELECT p_partkey AS observation_id, CASE WHEN p_partkey % 5 = 0 THEN 'renamed' ELSE p_name END AS original_test_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS unit, "
    "p_partkey % 5 = 0 OR p_partkey % 7 = 0 AS is_edited, 'llm' AS extraction_source FROM p WHERE p_partkey % 11 <> 0 UNION ALL SELECT 1000000000 + s_suppkey, s_name, NULL, true, 'manual' FROM supplier"
)
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """MUT-01..03: created, changed, cleared and deleted rows from an event log."""
    base = table(spark, d, "part").select(F.col("p_partkey").alias("observation_id"), F.col("p_name").alias("original_test_name"), F.col("p_brand").alias("unit"), F.lit(False).alias("is_edited"), F.lit("llm").alias("extraction_source"))
    k, of = F.col("observation_id"), lambda m: base.where(F.col("observation_id") % m == 0)
    text = lambda s: F.lit(s).cast("string")
    events = of(5).select(*store.change("update", F.lit(1), k, {"original_test_name": text("x")}))
    events = events.unionByName(of(5).select(*store.change("update", F.lit(2), k, {"original_test_name": text("renamed")})))
    events = events.unionByName(of(7).select(*store.change("update", F.lit(3), k, {"unit": F.lit(None)}))).unionByName(of(11).select(*store.change("delete", F.lit(4), k)))
    new = table(spark, d, "supplier").select(*store.change("create", F.lit(5), F.col("s_suppkey") + 1000000000, {"original_test_name": F.col("s_name")}))
    return store.current_rows(base, events.unionByName(new), ("original_test_name", "unit"))


@query(
    f"WITH {A.CATALOG_SQL}, o AS (SELECT p_partkey AS observation_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR || '-' || (p_partkey % 10)::VARCHAR WHEN p_partkey % 3 = 1 THEN NULL ELSE 'bad' END AS c, "
    "CASE WHEN p_partkey % 2 = 0 THEN 'unmapped' ELSE 'confirmed' END AS s FROM part) SELECT observation_id, loinc_num AS loinc_code, CASE WHEN loinc_num IS NOT NULL OR (c IS NULL AND s = 'unmapped') THEN s ELSE 'needs_review' END AS mapping_status, "
    "CASE WHEN loinc_num IS NOT NULL OR (c IS NULL AND s = 'unmapped') THEN 'human_review' ELSE 'none' END AS mapping_stage FROM o LEFT JOIN catalog ON c = loinc_num"
)
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    """MUT-04, JOIN-12: decisions with unknown codes, or null codes that are not 'unmapped', change nothing."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    none = F.lit(None).cast("string")
    rows = p.select(k.alias("observation_id"), none.alias("loinc_code"), none.alias("loinc_display"), F.lit("needs_review").alias("mapping_status"), F.lit("none").alias("mapping_stage"), F.lit(None).cast("double").alias("mapping_confidence"))
    code = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("-"), (k % 10).cast("string"))).when(k % 3 == 1, none).otherwise("bad")
    asked = p.select(k.alias("observation_id"), code.alias("loinc_num"), F.when(k % 2 == 0, "unmapped").otherwise("confirmed").alias("status"))
    return store.review(rows, asked, A.catalog(spark, d)).select("observation_id", "loinc_code", "mapping_status", "mapping_stage")


@query(
    f"WITH {A.CATALOG_SQL}, {_ALIAS_INDEX}, b AS (SELECT p_partkey AS id, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' ' || p_partkey::VARCHAR WHEN p_partkey % 5 = 1 THEN 'Unheard-of zzqx' ELSE p_name END AS name, p_partkey % 5 IN (0, 1) AS renamed, "
    "p_partkey % 7 = 0 AS odd, p_partkey % 5 IN (0, 1, 2) OR p_partkey % 7 = 0 AS touched FROM part WHERE p_partkey % 11 <> 0), "
    f"m AS (SELECT b.*, loinc_num, canonical_name FROM b LEFT JOIN alias_index ON {clean_sql('name')} = alias_key) "
    "SELECT id AS observation_id, 1 AS document_id, name AS original_test_name, touched AS is_edited, 'llm' AS extraction_source, CASE WHEN NOT touched THEN 0.3::DOUBLE WHEN odd THEN 0.55 ELSE 1.0 END AS extraction_confidence, CASE WHEN NOT touched THEN 1 WHEN odd THEN 1 ELSE 0 END AS n_notes, "
    "CASE WHEN NOT renamed THEN 'old' ELSE loinc_num END AS loinc_code, CASE WHEN NOT renamed THEN 'human_review' WHEN loinc_num IS NOT NULL THEN 'alias_exact' ELSE 'lexical_only' END AS mapping_stage, CASE WHEN renamed AND loinc_num IS NULL THEN 'needs_review' ELSE 'confirmed' END AS mapping_status FROM m "
    f"UNION ALL SELECT 1000000000 + s_suppkey, 1, s_name, true, 'manual', 1.0::DOUBLE, 0, NULL, 'lexical_only', 'needs_review' FROM supplier WHERE s_suppkey % 2 = 0"
)
def edited_rows(spark: SparkSession, d: str) -> DataFrame:
    """MUT-01..03, MUT-06, JOIN-12: edits with new checks and, where the name changed, new mappings; refused ones change nothing."""
    from ..operators import edits

    cat, none = A.catalog(spark, d), F.lit(None).cast("string")
    base = table(spark, d, "part").select(
        F.col("p_partkey").alias("observation_id"), F.lit(1).alias("document_id"), F.lit(1).alias("page_number"), F.col("p_name").alias("original_test_name"), F.col("p_size").cast("string").alias("value"), F.lit("g/dL").alias("unit"),
        F.lit("1 - 50").alias("reference_range"), *[none.alias(c) for c in ("specimen", "method", "timing", "flag")], F.lit(False).alias("is_edited"), F.lit("llm").alias("extraction_source"), F.lit(0.3).alias("extraction_confidence"),
        F.array(F.lit("old note")).alias("validation_notes"), F.lit("9").alias("suggested_value"), none.alias("normalized_test_name"), F.lit("old").alias("loinc_code"), none.alias("loinc_display"), F.lit("confirmed").alias("mapping_status"),
        F.lit(1.0).alias("mapping_confidence"), F.lit("human_review").alias("mapping_stage"), none.alias("mapping_rationale"),
    )
    k, of = F.col("observation_id"), lambda m, r: base.where(F.col("observation_id") % m == r)
    made = [
        of(5, 0).select(*store.change("update", F.lit(1), k, {"original_test_name": F.concat_ws(" ", "original_test_name", k.cast("string"))})),
        of(5, 1).select(*store.change("update", F.lit(2), k, {"original_test_name": F.lit("Unheard-of zzqx")})),
        of(5, 2).select(*store.change("update", F.lit(3), k, {"original_test_name": F.col("original_test_name")})),  # named, not changed
        of(5, 3).select(*store.change("update", F.lit(4), k, {"original_test_name": none, "value": F.lit("1000")})),  # refused
        of(5, 4).select(*store.change("update", F.lit(5), k)),  # refused: names nothing
        of(7, 0).select(*store.change("update", F.lit(6), k, {"unit": F.lit("ror")})), of(11, 0).select(*store.change("delete", F.lit(7), k)),
        table(spark, d, "supplier").select(*store.change("create", F.lit(8), F.col("s_suppkey") + 1000000000, {"original_test_name": F.col("s_name"), "document_id": F.when(F.col("s_suppkey") % 2 == 0, "1").otherwise("2"), "page_number": F.lit("1")})),
    ]
    events = made[0]
    for e in made[1:]:
        events = events.unionByName(e)
    documents = spark.range(1, 2).select(F.col("id").cast("int").alias("document_id"))
    out = edits.apply_edits(base, events, documents, terminology.alias_index(cat), cat)
    n = F.coalesce(F.size("validation_notes"), F.lit(0))
    return out.select("observation_id", "document_id", "original_test_name", "is_edited", "extraction_source", "extraction_confidence", F.when(n > 0, n).otherwise(0).alias("n_notes"), "loinc_code", "mapping_stage", "mapping_status")


@query(
    f"WITH {A.CATALOG_SQL}, r AS (SELECT p_partkey, p_name, p_size, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR || '-' || (p_partkey % 10)::VARCHAR END AS code FROM part), "
    f"p AS (SELECT left({clean_sql('p_name')} || '||', 512) AS key, arg_min(code, p_partkey) AS code FROM r WHERE code IS NOT NULL GROUP BY 1) SELECT key, code AS loinc_num, 'review' AS source, 1.0::DOUBLE AS confidence FROM p"
)
def remembered_reviews(spark: SparkSession, d: str) -> DataFrame:
    """MUT-04, MUT-05: reviewers' choices are remembered; of two decisions on a row the last valid one counts."""
    from ..operators import edits

    p, k, none = table(spark, d, "part"), F.col("p_partkey"), F.lit(None).cast("string")
    rows = p.select(
        k.alias("observation_id"), F.col("p_name").alias("original_test_name"), none.alias("specimen"), none.alias("unit"), none.alias("loinc_code"), none.alias("loinc_display"), F.lit("needs_review").alias("mapping_status"),
        F.lit("none").alias("mapping_stage"), F.lit(None).cast("double").alias("mapping_confidence"),
    )
    code = F.concat(k.cast("string"), F.lit("-"), (k % 10).cast("string"))
    first = p.select(F.lit(1).alias("seq"), k.alias("observation_id"), F.lit("1-1").alias("loinc_num"), F.lit("confirmed").alias("status"))
    last = p.select(F.lit(2).alias("seq"), k.alias("observation_id"), F.when(k % 3 == 0, code).alias("loinc_num"), F.lit("unmapped").alias("status"))
    wrong = p.select(F.lit(3).alias("seq"), k.alias("observation_id"), F.lit("no such code").alias("loinc_num"), F.lit("confirmed").alias("status"))
    learned = spark.createDataFrame([], "key string, loinc_num string, source string, confidence double")
    return edits.apply_reviews(rows, first.unionByName(last).unionByName(wrong), A.catalog(spark, d), learned)[1]


@query(f"WITH {A.QUEUE_SQL} SELECT document_id, content_type, 'inline; filename*=UTF-8' || repeat(chr(39), 2) || 'report%20' || document_id::VARCHAR || '.PDF' AS content_disposition FROM queue WHERE document_id = 33")
def file_egress(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17: one document's file with its headers."""
    docs = A.queue(spark, d).withColumn("raw_content", F.encode("filename", "UTF-8"))
    return store.file_of(docs, 33).select(F.lit(33).cast("long").alias("document_id"), "content_type", "content_disposition")


@query(
    f"WITH {A.OBSERVATIONS_SQL} SELECT observation_id, {unit_sql('unit')} AS unit, CASE WHEN length(w) > 512 THEN left(w, 511) || '…' ELSE w END AS original_test_name FROM (SELECT *, repeat(original_test_name || ' ', 12) AS w FROM observations)"
)
def stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16, FN-20: rows as the sink writes them: standard units, long texts clipped to their columns."""
    rows = A.observations(spark, d).withColumn("original_test_name", F.repeat(F.concat("original_test_name", F.lit(" ")), F.lit(12)))
    return store.clipped(rows).select("observation_id", "unit", "original_test_name")


@query("SELECT o_custkey AS file, o_orderkey AS run FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def newest_run(spark: SparkSession, d: str) -> DataFrame:
    """WIN-16."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("run"), F.struct("o_orderdate", "o_orderkey").alias("t"))
    return store.latest_per_key(rows, "file", F.desc("t")).select("file", "run")


# ------------------------------------------------------------------- pages and rows
@query("SELECT doc_id, CAST(sum(length(l)) AS BIGINT) AS chars, CASE WHEN sum(length(l)) >= 20 THEN 'digital' ELSE 'scanned' END AS path FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def page_classify(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01."""
    lines = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), F.explode(F.split("text", "\n")).alias("text"))
    return layout.classify_pages(lines).select("doc_id", "chars", "path")


@query("SELECT doc_id, CASE WHEN length(trim(text)) >= 400 THEN 'text' ELSE 'image' END AS input FROM documents")
def llm_routing(spark: SparkSession, d: str) -> DataFrame:
    """FLT-02."""
    return table(spark, d, "documents").select("doc_id", model_input().alias("input"))


@query(
    "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: trim(t) <> '') AS ls FROM documents), r AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS text, unnest(range(len(ls))) AS i FROM l) "
    "SELECT doc_id, CAST(i AS INTEGER) AS reading_order, text, round(i / n, 9) AS y0, round((i + 0.9) / n, 9) AS y1 FROM r"
)
def text_layout(spark: SparkSession, d: str) -> DataFrame:
    """SRC-06, SRC-07."""
    rows = layout.text_layout(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text"))
    return rows.select("doc_id", "reading_order", "text", F.round("y0", 9).alias("y0"), F.round("y1", 9).alias("y1"))


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) "
    "SELECT doc_id, CAST(i AS INTEGER) AS i, list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s{2,}|\\.{2,}'), lambda p: trim(p, ' .')), lambda p: p <> '') AS tokens FROM l"
)
def row_tokens(spark: SparkSession, d: str) -> DataFrame:
    """FN-06."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return rows.select("doc_id", "i", parse.tokenize_spans(F.array("t")).alias("tokens"))


@query(
    "WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_idx, l_partkey, l_extendedprice, l_suppkey, CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag || l_suppkey::VARCHAR END AS text, l_discount AS x0, l_discount + 0.1 AS x1, l_tax AS y0, l_tax + 0.05 AS y1, "
    "CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END AS flags FROM lineitem) "
    "SELECT doc_id, line_idx, string_agg(text, ' ' ORDER BY l_partkey, l_extendedprice, l_suppkey) AS text, round(min(x0), 6) AS x0, round(max(x1), 6) AS x1, round(min(y0), 6) AS y0, round(max(y1), 6) AS y1, bool_or(flags = 16) AS is_bold FROM s WHERE trim(text) <> '' GROUP BY doc_id, line_idx"
)
def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03: lines from positioned spans (a line item is a span)."""
    from pyspark.sql import Window

    li = table(spark, d, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_extendedprice", "l_suppkey"))
    spans = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("block_type"), F.col("l_linenumber").alias("line_idx"), place.alias("span_idx"),
        F.when(F.col("l_returnflag") == "N", " ").otherwise(F.concat("l_returnflag", F.col("l_suppkey").cast("string"))).alias("text"), (F.col("l_discount") * 100).alias("x0"), (F.col("l_tax") * 200).alias("y0"),
        ((F.col("l_discount") + 0.1) * 100).alias("x1"), ((F.col("l_tax") + 0.05) * 200).alias("y1"), F.lit(10.0).alias("font_size"), F.when(F.col("l_linestatus") == "O", 16).otherwise(0).alias("flags"), F.lit(100.0).alias("page_width"), F.lit(200.0).alias("page_height"),
    )
    r = lambda c: F.round(c, 6).alias(c)
    return layout.layout_spans(spans).select("doc_id", "line_idx", "text", r("x0"), r("x1"), r("y0"), r("y1"), "is_bold")


@query(
    "WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'Specimen: ' || CASE WHEN l_linestatus = 'O' THEN 'Serum' ELSE 'Urine' END END AS s FROM lineitem), "
    "u AS (SELECT doc_id, i, max(s) AS s FROM l GROUP BY doc_id, i) SELECT doc_id, i, last_value(replace(s, 'Specimen: ', '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS specimen FROM u"
)
def specimen_carry(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06: the declared specimen carried down each document's lines."""
    li = table(spark, d, "lineitem")
    li = dealt(li, li.count(), "l_orderkey")
    said = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Specimen: "), F.when(F.col("l_linestatus") == "O", "Serum").otherwise("Urine")))
    rows = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("i")).agg(F.max(said).alias("s"))
    rows = rows.select("doc_id", F.lit(1).alias("page"), F.col("i").alias("reading_order"), F.lit(0).alias("column_index"), F.coalesce("s", F.lit("-")).alias("text"))
    rows = rows.withColumns({"spans": F.array(F.concat(F.lit("Test   1   %"))), "source": F.lit("digital"), "y0": F.col("reading_order") / 10.0, "y1": F.col("reading_order") / 10.0 + 0.05})
    return parse.parse_pages(rows).select("doc_id", F.col("reading_order").alias("i"), "specimen")


@query(
    "WITH b AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey) AS line_idx, l_extendedprice / 100000 AS y0, l_extendedprice / 100000 + l_tax AS y1 FROM lineitem), "
    "m AS (SELECT *, max(y1) OVER (PARTITION BY doc_id ORDER BY y0, line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM b) "
    "SELECT doc_id, line_idx, CAST(sum(CASE WHEN y0 - r > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y0, line_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM m"
)
def y_bands(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01: overlapping price intervals of an order as bands."""
    from pyspark.sql import Window

    y = F.col("l_extendedprice") / 100000
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey")).cast("long").alias("line_idx"), y.alias("y0"), (y + F.col("l_tax")).alias("y1"))
    return layout.with_bands(li, ("doc_id",), "band").select("doc_id", "line_idx", "band")


# ------------------------------------------------------------------------ lifecycle
@query(f"WITH {A.FEED_SQL} SELECT document_id, seq FROM feed QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, seq DESC) <= 200")
def feed_tail(spark: SparkSession, d: str) -> DataFrame:
    """WIN-12, STR-06: the cap is the feature."""
    return lifecycle.feed_tail(A.feed(spark, d)).select("document_id", "seq")


@query(f"WITH {A.FEED_SQL}, s AS (SELECT *, CASE level WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'signup' THEN 1 END AS step FROM feed) SELECT document_id, coalesce(arg_max(step, (ts, seq)) FILTER (step IS NOT NULL), 0) AS phase FROM s GROUP BY document_id")
def feed_phase(spark: SparkSession, d: str) -> DataFrame:
    """WIN-13."""
    return lifecycle.feed_phase(A.feed(spark, d))


@query(
    f"WITH {A.FEED_SQL} SELECT document_id, sum(CASE WHEN level = 'click' THEN 3.5::DOUBLE END) AS ai_seconds, CAST(epoch(date_trunc('second', min(ts) FILTER (level = 'purchase'))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS matching_s FROM feed GROUP BY document_id"
)
def feed_offsets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15."""
    rows = A.feed(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return lifecycle.feed_offsets(rows, matching=F.contains("msg", F.lit("Matching")))


_NOW = "TIMESTAMP '1996-01-01 00:00:00'"
_AGE = f"coalesce(epoch({_NOW}) - epoch(date_trunc('second', coalesce(updated_at, uploaded_at))), 0)"


@query(f"WITH {A.QUEUE_SQL}, s AS (SELECT *, status = 'processing' AND {_AGE} > 180 AS stuck FROM queue) SELECT document_id, CASE WHEN NOT stuck THEN status WHEN cancel_requested THEN 'cancelled' ELSE 'pending' END AS status, stuck AS recovered FROM s")
def stuck_docs(spark: SparkSession, d: str) -> DataFrame:
    """STR-03, FN-29."""
    return lifecycle.recover_stuck(A.queue(spark, d), F.expr(_NOW)).select("document_id", "status", "recovered")


@query(
    f"WITH {A.QUEUE_SQL}, o AS (SELECT *, CASE WHEN status IN ('complete', 'failed', 'cancelled') THEN 'conflict' WHEN status = 'pending' OR {_AGE} > 60 THEN 'cancelled' ELSE 'requested' END AS outcome FROM queue) "
    "SELECT document_id, outcome, CASE WHEN outcome = 'cancelled' THEN 'cancelled' ELSE status END AS status, cancel_requested OR outcome = 'requested' AS cancel_requested FROM o"
)
def cancel_state(spark: SparkSession, d: str) -> DataFrame:
    """STR-04."""
    return lifecycle.cancel(A.queue(spark, d), F.expr(_NOW)).select("document_id", "outcome", "status", "cancel_requested")


@query(f"WITH {A.QUEUE_SQL} SELECT document_id FROM queue WHERE status = 'pending' ORDER BY uploaded_at, document_id LIMIT 1")
def next_pending(spark: SparkSession, d: str) -> DataFrame:
    """STR-01, SRT-04: the one document to claim next."""
    return lifecycle.next_pending(A.queue(spark, d)).select("document_id")


@query(
    "WITH p AS (SELECT l_orderkey AS document_id, l_linenumber AS page_number, bool_or(l_returnflag = 'R' AND l_tax > 0.05) AS fatal, bool_or(l_quantity > 45) AS diverted FROM lineitem GROUP BY ALL), "
    "t AS (SELECT *, coalesce(bool_or(fatal) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tripped FROM p) "
    "SELECT document_id, page_number, tripped, NOT tripped AND NOT fatal AND NOT diverted AS use_llm FROM t"
)
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """STR-08."""
    li = table(spark, d, "lineitem")
    pages = li.groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number")).agg(
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05)).alias("fatal"), F.bool_or(F.col("l_quantity") > 45).alias("diverted")
    )
    return lifecycle.circuit_breaker(pages).select("document_id", "page_number", "tripped", "use_llm")


@query(
    "WITH p AS (SELECT l_orderkey AS document_id, l_linenumber AS page_number, sum(l_quantity) AS cost FROM lineitem GROUP BY ALL) "
    "SELECT document_id, page_number, coalesce(sum(cost) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 60 AS processed FROM p"
)
def budget_skip(spark: SparkSession, d: str) -> DataFrame:
    """STR-10."""
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number")).agg(F.sum("l_quantity").alias("cost"))
    return lifecycle.within_budget(pages, F.lit(60)).select("document_id", "page_number", "processed")


@query(
    "WITH RECURSIVE h AS (SELECT user_id AS client, event_id AS seq, epoch_us(ts)::DOUBLE / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    "r AS (SELECT client, seq, n, true AS allowed, 0.0::DOUBLE AS retry_after, [t] AS held FROM h WHERE n = 1 UNION ALL "
    "SELECT h.client, h.seq, h.n, len(k.live) < 3, CASE WHEN len(k.live) < 3 THEN 0.0 ELSE greatest(0.1, 86400 - (h.t - k.live[1])) END, CASE WHEN len(k.live) < 3 THEN list_append(k.live, h.t) ELSE k.live END "
    "FROM r JOIN h ON h.client = r.client AND h.n = r.n + 1, LATERAL (SELECT list_filter(r.held, lambda a: h.t - a < 86400) AS live) k) SELECT client, seq, allowed, round(retry_after, 3) AS retry_after FROM r"
)
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """STR-07: a hit's admission depends on those admitted before it."""
    hits = table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("seq"))
    return lifecycle.limiter(hits, limit=3, window_s=86400.0).withColumn("retry_after", F.round("retry_after", 3))


# ----------------------------------------------------------------------- evaluation


@query(
    f"WITH {A.FEED_SQL} SELECT document_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, max(ts) AS last_seen, count(*) AS n FROM feed GROUP BY ALL"
)
def heartbeat_windows(spark: SparkSession, d: str) -> DataFrame:
    """STR-02: the streaming rollup's batch form (an extra: the reference has no event-time windows)."""
    from ..streaming.jobs import heartbeats

    rows = heartbeats(A.feed(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("document_id", F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n")


# ------------------------------------------------------------- small function fixtures
@query(f"WITH {A.QUEUE_SQL} SELECT document_id, CASE WHEN ends_with(lower(filename), '.pdf') THEN 'pdf' WHEN content_type LIKE 'text/%' OR ends_with(lower(filename), '.txt') THEN 'text' ELSE 'other' END AS kind, "
       "CASE WHEN cancel_requested AND status = 'processing' THEN 'Cancelling' WHEN status = 'pending' THEN 'Queued' ELSE upper(left(status, 1)) || substr(status, 2) END AS label FROM queue")  # fmt: skip
def list_labels(spark: SparkSession, d: str) -> DataFrame:
    """FLT-18."""
    return A.queue(spark, d).select("document_id", X.file_kind(F.col("content_type"), F.col("filename")).alias("kind"), X.status_label(F.col("status"), F.col("cancel_requested")).alias("label"))


@query(f"WITH {A.OBSERVATIONS_SQL} SELECT observation_id, mapping_status <> 'confirmed' AS review, flag = 'High' IS TRUE OR (document_id % 2 = 0 AND page_number <> 3) AS flagged, page_number = 3 AS edited FROM observations WHERE contains(lower(original_test_name), 'red') OR contains(value, '7')")
def row_filters(spark: SparkSession, d: str) -> DataFrame:
    """FLT-09."""
    rows = A.observations(spark, d).where(F.contains(F.lower("original_test_name"), F.lit("red")) | F.contains("value", F.lit("7")))
    rows = rows.withColumns(
        {
            "validation_notes": F.when(F.col("flag") == "High", F.array(F.lit("x"))), "extraction_source": F.when(F.col("document_id") % 2 == 0, "fallback").otherwise("llm"), "is_edited": F.col("page_number") == 3,
        }
    )
    return quality.row_flags(rows).select("observation_id", "review", "flagged", "edited")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'original_test_name must not be blank' WHEN p_partkey % 4 = 1 THEN 'unit is longer than 128 characters' WHEN p_partkey % 4 = 2 THEN 'page_number must be 1 or more' END AS problem FROM part")
def input_checks(spark: SparkSession, d: str) -> DataFrame:
    """FN-21."""
    p, k = table(spark, d, "part"), F.col("p_partkey") % 4
    none = F.lit(None).cast("string")
    rows = p.select(
        F.col("p_partkey").alias("id"), F.when(k == 0, "  ").otherwise(F.col("p_name")).alias("original_test_name"), F.when(k == 1, F.repeat(F.lit("u"), 129)).alias("unit"), F.when(k == 2, 0).otherwise(1).alias("page_number"),
        *[none.alias(c) for c in ("value", "reference_range", "specimen", "method", "timing", "flag")],
    )
    return rows.select("id", X.input_problem().alias("problem"))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'postgresql://h/' ELSE 'sqlite:///' END || n_name AS url, n_name FROM nation")
def database_urls(spark: SparkSession, d: str) -> DataFrame:
    """SRC-24."""
    n = table(spark, d, "nation")
    url = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "postgres://h/").otherwise("sqlite:///"), "n_name")
    return n.select(X.normalize_database_url(url).alias("url"), "n_name")


@query("SELECT l_suppkey AS document_id, l_linenumber AS page_number, (row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) - 1) // 25 AS batch, l_orderkey, l_partkey FROM lineitem")
def verify_batches(spark: SparkSession, d: str) -> DataFrame:
    """FN-39: which batch of 25 each row of a page is verified in (a supplier is a document)."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), F.struct("l_orderkey", "l_partkey", "l_extendedprice").alias("observation_id"))
    return mapping.verify_batches(rows).select("document_id", "page_number", "batch", "observation_id.l_orderkey", "observation_id.l_partkey")


@query(f"WITH {A.CATALOG_SQL} SELECT loinc_num, long_common_name, component, system FROM catalog WHERE loinc_num = '7-7'")
def code_lookup(spark: SparkSession, d: str) -> DataFrame:
    """FLT-07, JOIN-02."""
    return store.find(A.catalog(spark, d), "7-7", "loinc_num").select("loinc_num", "long_common_name", "component", "system")


@query("SELECT p_partkey AS ord, p_size > 25 AS kept FROM part WHERE p_size > 25 AND p_brand <> 'Brand#1'")
def active_codes(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13: the ETL filter on a table shaped like the distribution's."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("ord"), F.when(F.col("p_size") > 25, "1").otherwise("2").alias("CLASSTYPE"), F.when(F.col("p_brand") != "Brand#1", "ACTIVE").otherwise("DEPRECATED").alias("STATUS"),
        F.col("p_name").alias("RELATEDNAMES2"), F.lit("5").alias("COMMON_TEST_RANK"),
    )
    return terminology.active_lab_codes(p, core_only=True).select("ord", (F.col("CLASSTYPE") == "1").alias("kept"))


from . import page_queries  # noqa: E402, F401  (registers its queries)
