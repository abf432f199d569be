"""Literal and property tests of the report operators."""

import random
from collections import defaultdict, deque

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vialframe.functions import text as X
from vialframe.functions import validate as V
from vialframe.operators import layout, lifecycle, mapping, parse, retrieval, store, terminology
from vialframe.plans import adapters as A
from vialframe.plans.queries import rate_limit

QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", expr(F.col("v"))).collect())]


def test_units(spark):
    raw = ["gm/dl", "g/dL", "mill/cumm", "million/mm³", "µg [H]", " [L] ", None, "UL", "mg/dL", "[ ]", ""]
    assert col(spark, raw, X.standardize_unit) == ["g/dL", "g/dL", "mill/cmm", "mill/cmm", "ug", None, None, "uL", "mg/dL", None, None]


@QUICK
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_clean_is_idempotent(spark, values):
    once = col(spark, values, X.clean)
    assert col(spark, once, X.clean) == once


def test_known_units(spark):
    good = ["g/dL", "10*3/uL", "mm/hr", "%", "pg", "fl", "gm/dl", "Million/ul", None]
    bad = ["ror", "omer", "o/at", "po", "uIU/mL"]
    assert col(spark, good, V.unit_recognized) == [True] * len(good)
    assert col(spark, bad, V.unit_recognized) == [False] * len(bad)


@QUICK
@given(st.lists(st.tuples(st.integers(0, 9999), st.integers(1, 50), st.integers(1, 50)), min_size=1, max_size=15))
def test_suggestion_only_moves_the_point(spark, cases):
    df = spark.createDataFrame([(i, str(v), f"{lo} - {lo + w}") for i, (v, lo, w) in enumerate(cases)], "i int, v string, r string")
    for r in df.select("v", V.suggest_decimal_fix(F.col("v"), F.col("r")).alias("s")).collect():
        if r.s is not None:
            assert r.s.replace(".", "").strip("0") == r.v.strip("0")
            assert any(abs(float(r.s) * k - float(r.v)) < 1e-6 for k in (10, 100, 1000))


@QUICK
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8)), min_size=1, max_size=25))
def test_bands_are_disjoint_and_do_not_depend_on_order(spark, boxes):
    rows = [("d", 1, i, y / 40, (y + h) / 40) for i, (y, h) in enumerate(boxes)]
    shape = "doc_id string, page int, line_idx int, y0 double, y1 double"

    def bands(rows):
        df = layout.with_bands(spark.createDataFrame(rows, shape), layout.PAGE, "band")
        out = defaultdict(set)
        for r in df.collect():
            out[r.band].add((r.line_idx, r.y0, r.y1))
        return out

    first = bands(rows)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert sorted(map(sorted, first.values())) == sorted(map(sorted, bands(shuffled).values()))
    spans = sorted((min(x[1] for x in b), max(x[2] for x in b)) for b in first.values())
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))


@QUICK
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["a b", "A-B", "c", "", "d!"])), min_size=1, max_size=12))
def test_alias_kept_iff_one_owner(spark, claims):
    by_code = defaultdict(list)
    for code, alias in claims:
        by_code[str(code)].append(alias)
    rows = [(c, f"name {c}", None, a) for c, a in by_code.items()]
    index = terminology.alias_index(spark.createDataFrame(rows, "loinc_num string, long_common_name string, shortname string, aliases array<string>"))
    owners = defaultdict(set)
    for c, name, _, aliases in rows:
        for a in [*aliases, name]:
            key = " ".join("".join(ch if ch.isalnum() else " " for ch in a.lower()).split())
            if key:
                owners[key].add(c)
    assert {(r.alias_key, r.loinc_num) for r in index.collect()} == {(k, next(iter(v))) for k, v in owners.items() if len(v) == 1}


CODES = [
    (0, "2345-7", "Glucose [Mass/volume] in Serum or Plasma", "Glucose SerPl-mCnc", "Glucose", "Ser/Plas", "mg/dL", 5, ["Glucose", "Sugar"]),
    (1, "5792-7", "Glucose [Mass/volume] in Urine by Test strip", "Glucose Ur Strip-mCnc", "Glucose", "Urine", "mg/dL", 50, ["Glucose", "Urine sugar"]),
    (2, "2349-9", "Glucose [Presence] in Urine", "Glucose Ur Ql", "Glucose", "Urine", None, 40, ["Glucose"]),
    (3, "718-7", "Hemoglobin [Mass/volume] in Blood", "Hgb Bld-mCnc", "Hemoglobin", "Bld", "g/dL", 1, ["Hgb"]),
    (4, "4548-4", "Hemoglobin A1c/Hemoglobin.total in Blood", "HbA1c MFr Bld", "Hemoglobin A1c", "Bld", "%", 8, ["A1C", "Hgb"]),
    (5, "2498-4", "Iron [Mass/volume] in Serum or Plasma", "Iron SerPl-mCnc", "Iron", "Ser/Plas", "ug/dL", 30, ["Fe"]),
]
SHAPE = "ord int, loinc_num string, long_common_name string, shortname string, component string, system string, example_units string, common_test_rank int, aliases array<string>"


def ask(spark, catalog, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "query_id int, name string, specimen string, unit string, method string, value string")
    got = defaultdict(list)
    for r in sorted(retrieval.search(df, catalog).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.loinc_num)
    return got


def test_ranking_follows_specimen_unit_and_value(spark):
    cat = spark.createDataFrame(CODES, SHAPE)
    got = ask(spark, cat, ("Glucose", "Serum", None, None, None), ("Glucose", "Urine", "mg/dL", None, "12"), ("Glucose", "Urine", None, None, "Positive"), ("Zzzqxv", None, None, None, None), ("", None, None, None, None), (None, None, None, None, None))
    assert got[0][0] == "2345-7" and got[1][0] == "5792-7" and got[2][0] in ("2349-9", "5792-7")
    assert not {3, 4, 5} & set(got)


def test_mapping_precedence_and_verifier(spark):
    cat = spark.createDataFrame(CODES, SHAPE)
    index = terminology.with_overrides(terminology.alias_index(cat), terminology.overrides_table(spark), cat)
    obs = spark.createDataFrame(
        [(1, "Hgb", None, None, None, None), (2, "Blood glucose x", "Serum", None, None, None), (3, "Glucose fasting", "Serum", "mg/dL", None, "90"), (4, "Qqq zzz", None, None, None, None)],
        "observation_id int, original_test_name string, specimen string, unit string, method string, value string",
    )
    learned = spark.createDataFrame([("blood glucose x|serum|", "2345-7"), ("qqq zzz||", "gone-1")], "key string, loinc_num string")
    off = {r.observation_id: r for r in mapping.map_rows(obs, index, cat, learned).collect()}
    assert (off[1].mapping_stage, off[1].loinc_code) == ("alias_exact", "718-7")
    assert (off[2].mapping_stage, off[2].loinc_code, off[2].mapping_confidence) == ("learned", "2345-7", 0.95)
    assert off[3].mapping_stage == "lexical_only" and "Unverified suggestions" in off[3].mapping_rationale and off[3].mapping_confidence is None
    assert off[4].mapping_stage == "lexical_only"

    def verifier(rows):
        return rows.select("observation_id", F.col("hits")[0]["loinc_num"].alias("chosen_loinc_num"), F.lit(0.8).alias("confidence"), F.lit("ok").alias("rationale"))

    on = {r.observation_id: r for r in mapping.map_rows(obs, index, cat, learned, verifier, mode="all").collect()}
    assert (on[3].mapping_stage, on[3].mapping_status) == ("lexical_llm", "confirmed")
    assert (on[4].mapping_status, on[4].mapping_confidence) == ("unmapped", 0.0)
    failed = {r.observation_id: r for r in mapping.map_rows(obs, index, cat, learned, None, mode="all").collect()}
    assert failed[3].mapping_stage == "error"
    single = {r.observation_id: r for r in mapping.map_single(obs, index, cat).collect()}
    assert single[1].loinc_code == "718-7" and single[3].mapping_status == "needs_review"


def test_limiter_equals_a_loop(spark, sf_dir):
    import pyarrow.parquet as pq

    got = {r.seq: r.allowed for r in rate_limit(spark, sf_dir).collect()}
    rows = pq.read_table(f"{sf_dir}/events.parquet").to_pylist()
    queues, want = defaultdict(deque), {}
    for r in sorted(rows, key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        q, t = queues[r["user_id"]], r["ts"].timestamp()
        while q and t - q[0] >= 86400:
            q.popleft()
        want[r["event_id"]] = len(q) < 3
        if want[r["event_id"]]:
            q.append(t)
    assert got == want


def test_feed_steps(spark):
    assert col(spark, ["Matching rows", "Page 2 read", "Opened the file", "...", None], lifecycle.feed_step) == [3, 2, 1, None, None]


def test_rejected_labels(spark):
    labels = ["Patient Name", "Info- x", "Sex", "Iron", "x" * 61, "Notes", "TPHA-TREPONEMA PALLIDIUM HEMAGGLUTINATION ASSAY"]
    assert col(spark, labels, parse.is_rejected_label) == [True, True, True, False, True, True, False]


def test_null_marker_of_the_change_log(spark):
    base = spark.createDataFrame([(1, "a", "u", False, "llm"), (2, "b", "u", False, "llm")], "observation_id int, original_test_name string, unit string, is_edited boolean, extraction_source string")
    one = base.where("observation_id = 1")
    events = one.select(*store.change("update", F.lit(2), F.col("observation_id"), {"unit": F.lit(None)})).unionByName(
        one.select(*store.change("update", F.lit(1), F.col("observation_id"), {"unit": F.lit("v"), "original_test_name": F.lit("c")}))
    )
    got = {r.observation_id: (r.original_test_name, r.unit, r.is_edited) for r in store.current_rows(base, events, ("original_test_name", "unit")).collect()}
    assert got == {1: ("c", None, True), 2: ("b", "u", False)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, page int, line_idx int, text string, x0 double, y0 double, x1 double, y1 double, max_font double, spans array<string>, source string")
    assert layout.reading_order(empty).count() == 0
    assert parse.parse_pages(layout.reading_order(empty)).count() == 0


def test_report_from_pages_to_observations(spark):
    from vialframe.operators import reports

    cat = spark.createDataFrame(CODES, SHAPE)
    texts = spark.createDataFrame([("t", 1, "Specimen: Serum\nHgb      715     gm/dl    11 - 16\nIron 70 ug/dL 50-170\nPage 1 of 2")], "doc_id string, page int, text string")
    lines = [("d", 1, 0, "Ferritin value", 0.1, 0.1, 0.3, 0.12, 10.0, ["Ferritin value"], "digital"), ("d", 1, 1, "12 ug/dL", 0.5, 0.1, 0.6, 0.12, 10.0, ["12", "ug/dL"], "digital"), ("s", 1, 0, "x", 0.1, 0.1, 0.2, 0.12, 10.0, ["x  1"], "digital")]
    shape = "doc_id string, page int, line_idx int, text string, x0 double, y0 double, x1 double, y1 double, max_font double, spans array<string>, source string"
    ocr = spark.createDataFrame([("o", 1, 0, "A1C 6 %", 0.1, 0.1, 0.3, 0.12, 0.0, ["A1C", "6", "%"], "ocr", 0.5), ("o", 1, 1, "eee Ol 5 %", 0.1, 0.2, 0.3, 0.22, 0.0, ["eee Ol", "5", "%"], "ocr", 0.5)], shape + ", confidence double")
    tests = reports.extract(texts, spark.createDataFrame(lines, shape), ocr)
    got = {(r.document_id, r.original_test_name): r for r in reports.observations(tests, cat).collect()}
    assert set(got) == {("t", "Hgb"), ("t", "Iron"), ("d", "Ferritin value"), ("o", "A1C")}
    hgb = got["t", "Hgb"]
    assert (hgb.loinc_code, hgb.unit, hgb.suggested_value, hgb.specimen, hgb.extraction_confidence) == ("718-7", "g/dL", "7.15", "Serum", 0.4)
    assert got["o", "A1C"].extraction_confidence == 0.5 and got["o", "A1C"].loinc_code == "4548-4"


def test_retry():
    from vialframe.sources.external import with_retry

    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert with_retry(call, lambda e: isinstance(e, TimeoutError), sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    calls.clear()
    try:
        with_retry(call, lambda e: False, sleep=waits.append)
    except TimeoutError:
        assert len(calls) == 1


def test_strip_and_split_like_python(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert len(blanks) > 20
    values = [f"{b}a{b}{b}b{b}" for b in blanks] + ["a b", "\u200ba", ""]
    assert col(spark, values, X.strip) == [v.strip() for v in values]
    assert col(spark, values, lambda v: parse.tokenize_spans(F.array(v))) == [["a", "b"]] * len(blanks) + [["a b"], ["\u200ba"], []]
    assert col(spark, values, lambda v: X.short(v)) == [" ".join(v.split()) for v in values]


def test_batched_verifier_fails_by_batch(spark):
    cat = spark.createDataFrame(CODES, SHAPE)
    index = terminology.alias_index(cat)
    names = [("Glucose fasting", "Serum")] * 3 + [("Bad one Glucose", "Serum")] + [("Iron level x", "Serum")] * 2
    obs = spark.createDataFrame([(i, n, s, None, None, None) for i, (n, s) in enumerate(names)], "observation_id int, original_test_name string, specimen string, unit string, method string, value string")

    def call(items):
        assert len(items) == 1 and "test: " in items[0]["text"]
        if "Bad" in items[0]["original_name"]:
            raise ValueError("down")
        if "Iron" in items[0]["original_name"]:
            return [{"i": 7, "chosen_loinc_num": "x"}]
        return [{"i": 0, "chosen_loinc_num": items[0]["candidates"][0]["loinc_num"], "confidence": 0.9, "rationale": "ok"}]

    got = {r.observation_id: r for r in mapping.map_rows(obs, index, cat, verifier=mapping.batch_verifier(call, size=1), mode="all").collect()}
    assert all(got[i].mapping_status == "confirmed" and not got[i].llm_failed for i in range(3))
    assert got[3].mapping_stage == "error" and got[3].llm_failed and "Unverified suggestions" in got[3].mapping_rationale
    assert all(got[i].mapping_status == "unmapped" and got[i].mapping_rationale == "No verdict returned." for i in (4, 5))
    lost = mapping.complete_mapping(obs, mapping.map_single(obs, index, cat).where("observation_id < 2")).collect()
    assert sorted(r.observation_id for r in lost if r.mapping_stage == "error") == [2, 3, 4, 5]


def test_one_review_per_row(spark):
    cat = spark.createDataFrame(CODES, SHAPE)
    rows = spark.createDataFrame([(1, None, None, "needs_review", "x", None, None)], "observation_id int, loinc_code string, loinc_display string, mapping_status string, mapping_stage string, mapping_confidence double, mapping_rationale string")
    asked = spark.createDataFrame([(1, 1, "718-7", "confirmed"), (2, 1, "2498-4", "confirmed"), (3, 1, "gone", "confirmed"), (4, 1, None, "confirmed")], "seq int, observation_id int, loinc_num string, status string")
    (r,) = store.review(rows, asked, cat).collect()
    assert (r.loinc_code, r.mapping_stage, r.mapping_rationale) == ("2498-4", "human_review", "Manually reviewed and confirmed by user.")


def test_settings(spark):
    from vialframe import config

    assert config.settings(env={"VIALFRAME_TOP_K": "9"})["TOP_K"] == 9 and config.settings(env={})["TOP_K"] == config.TOP_K
    spark.conf.set("spark.vialframe.top_k", "4")
    try:
        assert config.settings(spark, {"VIALFRAME_TOP_K": "9"})["TOP_K"] == 4
    finally:
        spark.conf.unset("spark.vialframe.top_k")


def test_report_without_the_training_data_operators(tmp_path):
    import subprocess
    import sys

    root = __file__.rsplit("/tests/", 1)[0]
    code = f"import sys; sys.path.insert(0, {root!r})\nimport importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith(('vialframe.llm', 'corpus_pipeline')):\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nq = e.queries()\nassert len(q) > 70 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in e.oracle_sql()\nprint('fine')"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=tmp_path).stdout.strip() == "fine"


def test_mapping_keeps_rows_whose_ids_repeat(spark, sf_dir):
    """Rows that share an id and differ in their names or not: each is mapped once, for itself, with its hints."""
    cat = A.catalog(spark, sf_dir).limit(40)
    names = [r.shortname for r in cat.limit(3).collect()]
    rows = [(1, f"{n} no alias", None, "12", "mg/dL", None) for n in (names[0], names[0], names[1])] + [(2, f"{names[2]} x", "Serum", "Trace", None, None)]
    obs = spark.createDataFrame(rows, "observation_id long, original_test_name string, specimen string, value string, unit string, method string")
    index = terminology.alias_index(cat)
    for got in (mapping.map_single(obs, index, cat).collect(), mapping.map_rows(obs, index, cat).collect()):
        assert sorted((r.observation_id, r.original_test_name) for r in got) == sorted((i, n) for i, n, *_ in rows)
        assert all("Unverified suggestions: " in r.mapping_rationale for r in got)
        assert len({(r.original_test_name, r.mapping_rationale) for r in got}) == len({n for _, n, *_ in rows})


# ------------------------------------------------- mapping keeps its rows; the stored index
def _small_catalog(spark):
    rows = [(i, f"{i}-{i % 10}", f"{n} {s} panel {i}", n, n, s, u, i * 50, [n]) for i, (n, s, u) in enumerate([("iron", "Serum", "mg/dL"), ("iron", "Urine", "mg/dL"), ("zinc", "Serum", None), ("zinc", "Urine", "g/dL")] * 12)]
    return spark.createDataFrame(rows, "ord long, loinc_num string, long_common_name string, shortname string, component string, system string, example_units string, common_test_rank int, aliases array<string>")


_ASKING = "observation_id long, original_test_name string, specimen string, method string, unit string, value string"


def test_rows_that_differ_only_in_place_keep_their_own_answers(spark):
    cat = _small_catalog(spark)
    index = terminology.alias_index(cat)
    codes, cat = cat, retrieval.build_index(cat)
    rows = spark.createDataFrame(
        [(1, "iron x", "Urine", None, None, None), (2, "iron x", None, "Urine", None, None), (3, "iron x", "", "Urine", None, None), (4, "iron x", "mg/dL", None, None, None), (5, "iron x", None, None, "mg/dL", None), (5, "iron x", None, None, None, "1")], _ASKING,
    )

    def verifier(pending):
        return pending.select("observation_id", F.col("hits")[0]["loinc_num"].alias("chosen_loinc_num"), F.lit(0.9).alias("confidence"), F.concat_ws("/", F.coalesce("specimen", F.lit("-")), F.coalesce("method", F.lit("-"))).alias("rationale"))

    for mapped in (mapping.map_rows(rows, index, cat, mode="ambiguous"), mapping.map_rows(rows, index, cat, mode="all", verifier=verifier), mapping.map_single(rows, index, cat), mapping.map_single(rows, index, cat, verifier=verifier)):
        assert sorted(r.observation_id for r in mapped.collect()) == [1, 2, 3, 4, 5, 5]
    said = {r.observation_id: r for r in mapping.map_single(rows.where("observation_id < 4"), index, cat, verifier=verifier).collect()}
    assert [said[i].mapping_rationale for i in (1, 2, 3)] == ["Urine/-", "-/Urine", "/Urine"] and said[1].mapping_status == "confirmed" and not said[1].llm_failed
    assert said[1].loinc_code in {r.loinc_num for r in codes.where("system = 'Urine'").collect()}


def test_single_rows_with_a_verifier_that_fails_or_finds_nothing(spark):
    cat = _small_catalog(spark)
    rows = spark.createDataFrame([(1, "iron x", None, None, None, None), (2, "absent", None, None, None, None), (3, "zinc y", None, None, None, None)], _ASKING)

    def verifier(pending):
        return pending.where("observation_id <> 3").select("observation_id", F.when(F.size("hits") > 0, F.lit("none")).alias("chosen_loinc_num"), F.lit("0.2").alias("confidence"), F.lit("").alias("rationale"), (F.col("observation_id") == 1).alias("failed"))

    got = {r.observation_id: r for r in mapping.map_single(rows, terminology.alias_index(cat), cat, verifier=verifier).collect()}
    assert got[1].mapping_stage == "error" and got[1].llm_failed and got[1].mapping_rationale == "LLM verification call failed; needs manual review."
    assert got[2].mapping_status == "unmapped" and got[2].mapping_rationale == "No candidate judged reliable."
    assert got[3].mapping_rationale == "No verdict returned." and got[3].mapping_status == "unmapped"


def test_exact_keys_differ_wherever_a_field_does(spark):
    values = [None, "", "-", "1:a", "a", "a1:", "0:"]
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    assert rows.select(mapping.exact_key(F.col("a"), F.col("b")).alias("k")).distinct().count() == len(values) ** 2


def test_stored_index_prunes_and_stays_exact(spark, tmp_path):
    rnd = random.Random(2)
    words = [f"tok{i}" for i in range(30)]
    rows = [(i, str(i), " ".join(rnd.sample(words, 6)) + (" [Presence]" if i % 5 == 0 else ""), rnd.choice(words), None, rnd.choice(["Serum", "Urine", None]), rnd.choice(["g/L", None]), rnd.randint(0, 3000), [rnd.choice(words)]) for i in range(1500)]
    cat = spark.createDataFrame(rows, "ord long, loinc_num string, long_common_name string, shortname string, component string, system string, example_units string, common_test_rank int, aliases array<string>")
    asked = spark.createDataFrame([(q, " ".join(rnd.sample(words, rnd.randint(1, 5))), rnd.choice(["Serum", "Urine", "", None]), rnd.choice(["g/L", None]), None, rnd.choice(["Positive", "3", None])) for q in range(150)], "query_id long, name string, specimen string, unit string, method string, value string")
    stored = retrieval.build_index(cat, str(tmp_path / "index"), block=8)
    got = retrieval.search(asked, retrieval.open_index(spark, str(tmp_path / "index")), k=3, pool=4)
    whole = retrieval.search(asked, retrieval.build_index(cat, block=10**6), k=3, pool=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() > 300
    assert stored.blocks.where("n > 8").count() == 0 and stored.blocks.groupBy("token").agg(F.sum("n").alias("n")).agg(F.sum("n")).first()[0] == retrieval.postings(cat).count()
    # the second round leaves blocks out: most of them where a question has one word, as no other list can lift a code
    read = []
    real = retrieval._read_blocks
    retrieval._read_blocks = lambda index, forms, wanted: read.append(wanted.count()) or real(index, forms, wanted)
    single = spark.createDataFrame([(i, w, None, None, None, None) for i, w in enumerate(words)], asked.schema)
    try:
        retrieval.search(single, stored, k=3, pool=4)
    finally:
        retrieval._read_blocks = real
    total = stored.blocks.where(F.col("token").isin(words)).count()
    assert read[1] < 0.35 * total, (read, total)


def test_codes_that_score_alike_are_posted_once(spark):
    """an index that grows with what differs, not with copies; the first of equal codes have the places, and one that an alias names comes before them."""
    kinds = [("iron", "Serum", "mg/dL"), ("iron", "Urine", None), ("zinc", "Serum", "g/L")]
    rows = [(i, f"{i}-0", f"{n} level", n, n, s, u, 100, [n, f"{n} {1000 + i}"]) for i, (n, s, u) in enumerate(kinds * 500)]
    cat = spark.createDataFrame(rows, "ord long, loinc_num string, long_common_name string, shortname string, component string, system string, example_units string, common_test_rank int, aliases array<string>")
    index = retrieval.build_index(cat)
    iron = index.blocks.where("token = 'iron'")
    assert iron.agg(F.sum("n")).first()[0] == 1000 and iron.select(F.sum(F.length("ord") / 8)).first()[0] == 2
    asked = spark.createDataFrame([(1, "iron", "Serum", None, None, None), (2, "iron", "Urine", None, None, None), (3, "iron 1903", "Serum", None, None, None), (4, "iron 1004", None, None, None, None)], "query_id long, name string, specimen string, unit string, method string, value string")
    got = {}
    for r in sorted(retrieval.search(asked, index).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(int(r.loinc_num[:-2]))
    assert got == {1: [0, 3, 6, 9, 12, 15], 2: [1, 4, 7, 10, 13, 16], 3: [903, 0, 3, 6, 9, 12], 4: [4, 0, 1, 3, 6, 7]}, got


def _bundle_rows(spark):
    rows = [(i, i // 50, i % 3, f"test {i}", None, "1-1", None, "confirmed", 0.5, str(i) if i % 2 else "< 3", "mg/dL", "1 - 5", "Serum") for i in range(1000)]
    obs = spark.createDataFrame(rows, "observation_id long, document_id long, page_number int, original_test_name string, normalized_test_name string, loinc_code string, loinc_display string, mapping_status string, mapping_confidence double, value string, unit string, reference_range string, specimen string")
    obs = obs.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    return spark.range(21).select(F.col("id").alias("document_id"), F.lit("2024-01-02").cast("timestamp").alias("uploaded_at")), obs


def test_bundle_files_are_packed_and_whole(spark, tmp_path):
    """F8: the files take a small part of the bundles' length and hold every line."""
    from vialframe.operators import export

    docs, obs = _bundle_rows(spark)
    path = str(tmp_path / "bundles")
    export.write_bundles(docs, obs, path)
    want = sorted(r.bundle for r in export.bundles(docs, obs).select("bundle").collect())
    assert sorted(r.value for r in spark.read.text(path).collect()) == want and len(want) == 21
    assert sum(f.stat().st_size for f in (tmp_path / "bundles").glob("part-*")) < sum(map(len, want)) / 3


def test_bundles_gather_rows_and_not_their_json(spark):
    """JSON is made above the aggregation, so that it is neither shuffled nor sorted."""
    from vialframe.operators import export

    docs, obs = _bundle_rows(spark)
    out = export.bundles(docs, obs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "json" in plan.split("Aggregate", 1)[0].lower() and "json" not in plan.split("Aggregate", 1)[1].lower()
    one = out.where("document_id = 0").first().bundle
    assert one.count('"resourceType":"Observation"') == 50 and '"valueQuantity":{"value":3.0,"unit":"mg/dL"}' in one
