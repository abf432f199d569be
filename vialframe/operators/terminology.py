"""Terminology: alias index, short names, postings and document frequencies (AGG-01..03, AGG-12, AGG-20, JOIN-04, JOIN-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import clean, strip, tokenize


def alias_claims(catalog: DataFrame) -> DataFrame:
    """(alias_key, loinc_num): every cleaned alias, long name and short name with the code that claims it."""
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("long_common_name", "shortname"))
    return catalog.select("loinc_num", F.explode(names).alias("a")).select(clean(F.col("a")).alias("alias_key"), "loinc_num").where("alias_key <> ''")


def alias_index(catalog: DataFrame) -> DataFrame:
    """AGG-01: keys that exactly one code claims, with the code's canonical name. One pass, partial counts."""
    owned = alias_claims(catalog).groupBy("alias_key").agg(F.min("loinc_num").alias("loinc_num"), F.max("loinc_num").alias("other"))
    owned = owned.where("loinc_num = other").drop("other")
    named = catalog.select("loinc_num", F.coalesce(F.nullif("shortname", F.lit("")), F.col("long_common_name")).alias("canonical_name"))
    return owned.join(named, "loinc_num").select("alias_key", "loinc_num", "canonical_name")


def overrides_table(spark: SparkSession, overrides: dict[str, tuple[str, ...]] = C.ALIAS_OVERRIDES) -> DataFrame:
    """SRC-15: (alias_key, loinc_num) of the fixed names; keys with a leading underscore are comments."""
    rows = [(code, list(names)) for code, names in overrides.items() if not code.startswith("_")]
    table = spark.createDataFrame(rows, "loinc_num string, names array<string>")
    return table.select(F.explode("names").alias("n"), "loinc_num").select(clean(F.col("n")).alias("alias_key"), "loinc_num").where("alias_key <> ''").distinct()


def with_overrides(index: DataFrame, overrides: DataFrame, catalog: DataFrame) -> DataFrame:
    """JOIN-04: overrides of codes in the catalog replace what the index says about their keys."""
    named = catalog.select("loinc_num", F.coalesce(F.nullif("shortname", F.lit("")), F.col("long_common_name")).alias("canonical_name"))
    fixed = overrides.join(named, "loinc_num").select("alias_key", "loinc_num", "canonical_name")
    return index.join(fixed, "alias_key", "left_anti").unionByName(fixed)


def short_names(catalog: DataFrame) -> DataFrame:
    """AGG-02: distinct cleaned names of 1 to 8 characters from short names, components and aliases of at most 10."""
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("shortname", "component"))
    raw = catalog.select(F.explode(names).alias("raw")).where(F.length("raw") <= C.SHORT_NAME_MAX_RAW)
    return raw.select(clean(F.col("raw")).alias("name")).where(F.length("name").between(1, C.SHORT_NAME_MAX)).distinct()


def name_tokens(name: str = "long_common_name"):
    parts = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (name, "shortname", "component")])
    return F.array_distinct(tokenize(parts))


def postings(catalog: DataFrame) -> DataFrame:
    """JOIN-05, JOIN-13: (token, ord, weight): name tokens weigh 1, tokens that only an alias has 0.7.

    ``ord`` is the code's position in the catalog and breaks ties.
    """
    own = name_tokens()
    other = F.array_except(tokenize(F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")), own)
    weigh = lambda tokens, w: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(w).alias("weight")))
    return catalog.select("ord", F.explode(F.concat(weigh(own, C.NAME_WEIGHT), weigh(other, C.ALIAS_WEIGHT))).alias("p")).select("p.token", "ord", "p.weight")


def token_idf(post: DataFrame, n_codes: int | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """AGG-03: (token, df, idf); idf = ln(1 + N / df)."""
    df = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(n_codes) if n_codes is not None else catalog.agg(F.count(F.lit(1))).scalar()
    return df.select("token", "df", F.ln(1 + n / F.col("df")).alias("idf"))


def catalog_features(catalog: DataFrame) -> DataFrame:
    """Per code what scoring needs: length norm, rank prior, presence, system tokens and unit key (FN-32..34)."""
    from ..functions.text import unit_key

    rank = F.col("common_test_rank")
    return catalog.select(
        "ord", "loinc_num", "long_common_name", "component", "system", "example_units",
        (1 + C.LENGTH_NORM * F.greatest(F.lit(1), F.size(F.array_distinct(tokenize(F.col("long_common_name")))))).alias("norm"),
        F.when((rank > 0) & (rank <= C.RANK_CEILING), 1 - rank / C.RANK_CEILING).otherwise(0.0).alias("prior"),
        (F.contains("long_common_name", F.lit("[Presence]")) | F.contains("long_common_name", F.lit("[Identifier]"))).alias("presence"),
        tokenize(F.col("system")).alias("system_tokens"),
        unit_key(F.col("example_units")).alias("unit_key"),
    )


def index_statistics(catalog: DataFrame) -> DataFrame:
    """AGG-12, AGG-20: codes, aliases, distinct name tokens and alias-only tokens."""
    post = postings(catalog).groupBy("token").agg(F.max(F.col("weight") == C.NAME_WEIGHT).alias("in_name"), F.max(F.col("weight") < C.NAME_WEIGHT).alias("in_alias"))
    tokens = post.agg(F.count_if("in_name").alias("name_tokens"), F.count_if("in_alias").alias("alias_only_tokens"))
    counts = catalog.agg(F.count(F.lit(1)).alias("codes"), F.coalesce(F.sum(F.size(F.coalesce("aliases", F.array().cast("array<string>")))), F.lit(0)).cast("long").alias("aliases"))
    return counts.withColumns({c: tokens.select(c).scalar() for c in ("name_tokens", "alias_only_tokens")})


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: the terminology CSV: blank to null, rank integer (default 0), aliases split on |, blanks dropped."""
    cols = ("loinc_num", "long_common_name", "shortname", "component", "property", "time_aspect", "system", "scale_type", "method_type", "class", "example_units")
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    have = {c.lower(): c for c in raw.columns}
    pick = lambda c: F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")
    out = [F.nullif(strip(pick(c)), F.lit("")).alias(c) for c in cols]
    rank = F.coalesce(strip(pick("common_test_rank")).try_cast("int"), F.lit(0)).alias("common_test_rank")
    aliases = F.filter(F.transform(F.split(F.coalesce(pick("aliases"), F.lit("")), r"\|"), lambda a: strip(a)), lambda a: a != "").alias("aliases")
    return raw.select(*out, rank, aliases)


def active_lab_codes(table: DataFrame, core_only: bool = False) -> DataFrame:
    """SRC-13: keep laboratory (CLASSTYPE 1), active codes; related names split on ; and joined by |."""
    kept = table.where((F.col("CLASSTYPE") == "1") & (F.col("STATUS") == "ACTIVE"))
    if core_only:
        kept = kept.where(F.col("COMMON_TEST_RANK").try_cast("int") > 0)
    related = F.filter(F.transform(F.split(F.coalesce("RELATEDNAMES2", F.lit("")), ";"), lambda a: strip(a)), lambda a: a != "")
    return kept.withColumn("aliases", F.array_join(related, "|"))


def write_active_codes(table: DataFrame, path: str, core_only: bool = False) -> dict[str, int]:
    """SRC-13: write the active laboratory codes and return how many rows were seen, kept and skipped, counted on the way of the one pass."""
    from pyspark.sql import Observation

    seen, kept = Observation(), Observation()
    rows = active_lab_codes(table.observe(seen, F.count(F.lit(1)).alias("n")), core_only).observe(kept, F.count(F.lit(1)).alias("n"))
    rows.write.parquet(path)
    a, b = seen.get["n"], kept.get["n"]
    return {"seen": a, "kept": b, "skipped": a - b}
