"""A training-corpus pipeline over ``documents``: classify, deduplicate three times, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. Stages read nothing but ``docs``.

Defined cases, in every stage: a null text counts as an empty one; rows with a null doc_id are documents like others (where the
smallest or largest id stays, a null one loses); a repeated row is a copy, of which the exact dedup leaves
one (the near-copy stage, which comes after it, keeps rows that repeat both id and text together); a very long text is handled whole,
as one row; further columns, whatever their names, are handed on; an empty table gives no rows. A document
that loses all its words goes on as an empty text, and is packed as its end id alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialframe.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from vialframe.llm.common import discard, materialise
from vialframe.llm.queries import tokenizer_file


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go; an empty text is judged like any other."""
    names = ("_vf_votes", "_vf_quality", "_vf_accepted")
    return quality.score(docs, names=names).where(names[2]).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the one with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays."""
    return ngram_join.keep_representatives(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 35 words that occur elsewhere go; documents without one keep their text as it is."""
    names = ("_vf_kept_text", "_vf_words", "_vf_removed")
    cut = substring_dedup.remove_repeats(docs, names=names)
    text = F.when(F.col(names[2]) > 0, F.col(names[0])).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(names[2]) > 0, F.char_length(names[0]).cast(kind)).otherwise(F.col("n_chars"))
    return cut.withColumns(changed).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence of its own."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage but the last is written and read again, and what it has read is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
