"""The pipeline against the operators' brute-force results and on planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_llm import brute_classes, brute_repeats, documents


def stage(spark, name, df):
    return dict(corpus_pipeline.STAGES)[name](spark, df, "")


def test_stages_on_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = docs.columns
    kept = stage(spark, "quality_classifier", docs)
    assert kept.columns == cols and 0.7 * docs.count() < kept.count() < docs.count()
    one = stage(spark, "exact_dedup", docs)
    low = {}
    for d, t in documents(sf_dir):
        low[t.lower() if t.isascii() else t.translate({c: c + 32 for c in range(65, 91)})] = d
    assert one.columns == cols and sorted(r.doc_id for r in one.collect()) == sorted(low.values())
    near = stage(spark, "ngram_jaccard_join", docs)
    classes = brute_classes(documents(sf_dir))
    assert near.columns == cols and sorted(r.doc_id for r in near.collect()) == sorted(d for d, (_, c) in classes.items() if c == d)
    cut = stage(spark, "substring_dedup", docs)
    want = {d: (r, k) for d, _, r, k in brute_repeats(documents(sf_dir))}
    texts = dict(documents(sf_dir))
    assert cut.columns == cols and cut.dtypes == docs.dtypes
    for r in cut.collect():
        removed, text = want[r.doc_id]
        assert r.text == (text if removed else texts[r.doc_id])
        assert not removed or r.n_chars == len(text)


def test_run_catches_planted_cases(spark, tmp_path, sf_dir):
    rnd = random.Random(4)
    clean = [t for _, t in documents(sf_dir) if t.isascii() and 300 < len(t) < 4000 and "|" not in t and "!!" not in t and "%%" not in t][:25]
    word = lambda: "".join(rnd.choice(["th", "an", "er", "on", "re", "st", "in"]) for _ in range(rnd.randint(1, 4)))
    prose = [" ".join(rnd.choice(["the", "of", "and", word(), word()]) for _ in range(180)) + "." for _ in range(12)]
    passage = " ".join(word() for _ in range(60))
    texts = prose[:6] + [prose[0], prose[1].replace(" the ", " a ", 1)] + [prose[6] + " " + passage, prose[7] + " " + passage] + ["JUNK!! " * 200] + clean
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert 0 not in ids and 6 in ids and 7 not in ids and 1 in ids and {2, 3, 4, 5, 8, 9} < ids and 10 not in ids
    tokens = {r.doc_id: r.doc_tokens for r in out.collect()}
    plain = {r.doc_id: r.doc_tokens for r in corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect()}
    assert tokens[8] < plain[8] - 50 and tokens[9] < plain[9] - 50 and tokens[2] == plain[2]


def test_stages_take_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, "").count() == 0


def test_stages_take_odd_rows(spark):
    """Null texts and ids, repeated rows, a very long text and clashing columns go through every stage."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["th", "an", "er", "on", "re", "st", "in"]) for _ in range(rnd.randint(1, 4)))
    prose = [" ".join(rnd.choice(["the", "of", "and", word(), word()]) for _ in range(120)) + "." for _ in range(8)]
    long = " ".join(word() for _ in range(60_000))
    rows = [(i, t) for i, t in enumerate(prose)] + [(2, prose[2]), (2, prose[2]), (None, prose[3]), (None, None), (20, None), (21, ""), (22, long), (23, prose[5] + " " + prose[6])]
    extra = ("digest", "sha", "votes", "n", "kept", "key", "root", "label", "ids", "start", "gram")
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *[f"x{d}"] * len(extra)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)).repartition(3)
    before = {(r.doc_id, r.text) for r in df.collect()}
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, df, "")
        got = out.collect()
        assert out.columns == df.columns and out.dtypes == df.dtypes, name
        assert all(r.key == f"x{r.doc_id}" == r.gram for r in got), name
        if name != "substring_dedup":
            assert {(r.doc_id, r.text) for r in got} <= before, name
        else:
            assert len(got) == len(rows)
        if name == "exact_dedup":
            kept = [r.doc_id for r in got]
            assert len(kept) == len(set(kept)) and 21 in kept and 20 not in kept and None not in kept and 22 in kept and kept.count(2) == 1
        if name == "ngram_jaccard_join":
            assert sum(r.text == prose[3] for r in got) == 1 and sum(r.text == prose[2] for r in got) == 3 and 22 in {r.doc_id for r in got}
    packed = corpus_pipeline.pack_sequences(spark, df, "").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    n = {r.doc_id: r.n for r in packed}
    assert set(n) == {d for d, _ in rows} and n[20] == n[21] == 1 and n[22] > 60_000


def test_exact_stage_takes_partitions_of_many_batches(spark, sf_dir):
    """the second stage failed where a partition had more rows than one Arrow batch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(r.doc_id for r in stage(spark, "exact_dedup", docs).select("doc_id").collect())
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "5")
    try:
        assert sorted(r.doc_id for r in stage(spark, "exact_dedup", docs).select("doc_id").collect()) == want
    finally:
        spark.conf.set(name, before)
