"""File sources and the streaming forms."""

import io
import zipfile

from pyspark.sql import functions as F

from vialframe.operators import layout, parse
from vialframe.operators.terminology import active_lab_codes, read_catalog_csv
from vialframe.sources import files, tables
from vialframe.streaming import jobs

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{xml}</w:body></w:document>')
    return out.getvalue()


def para(t: str) -> str:
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def test_files_to_tests(spark, tmp_path):
    row = "<w:tbl><w:tr>" + "".join(f"<w:tc>{para(x)}</w:tc>" for x in ("Iron", "70", "ug/dL", "50 - 170")) + "</w:tr></w:tbl>"
    (tmp_path / "a.docx").write_bytes(docx(para("Specimen: Serum") + row))
    (tmp_path / "b.txt").write_text("WBC      6.8     10*3/uL   4.0-11.0\n\nPage 1 of 2\n")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    (tmp_path / "d.docx").write_bytes(b"broken")
    pages = files.load_pages(files.read_files(spark, str(tmp_path)))
    problems = {r.doc_id.rsplit("/", 1)[1]: r.problem for r in pages.collect()}
    assert problems["a.docx"] is None and problems["b.txt"] is None and problems["c.bin"] and problems["d.docx"]
    rows = layout.text_layout(pages.where("text is not null").select("doc_id", "page", "text"))
    tests = {r.name: (r.value, r.unit, r.reference_range, r.specimen) for r in parse.parse_pages(rows).collect()}
    assert tests == {"Iron": ("70", "ug/dL", "50 - 170", "Serum"), "WBC": ("6.8", "10*3/uL", "4.0-11.0", None)}
    routes = {r.doc_id.rsplit("/", 1)[1]: r.route for r in files.route_pages(pages).collect()}
    assert routes["a.docx"] == routes["b.txt"] == "parse"


def test_text_file_with_bytes_that_are_no_utf8(spark, tmp_path):
    texts = {"latin.txt": b"Eisen  70  \xb5g/dL\nna\xefve \xc3\xa9\n", "bom.txt": b"\xef\xbb\xbfWBC \xff6.8\xe2\x82", "fine.txt": "\ufeffé � x".encode()}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    got = {r.doc_id.rsplit("/", 1)[1]: (r.page, r.text, r.problem) for r in files.load_pages(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {name: (1, content.decode("utf-8", "ignore").replace("\ufeff", ""), None) for name, content in texts.items()}


def test_catalog_csv_and_sync(spark, tmp_path):
    (tmp_path / "c.csv").write_text('loinc_num,long_common_name,shortname,component,common_test_rank,aliases\n1-1,"Iron, total",Iron,,x,Fe| |Serum iron\n2-2,B,,C,7,\n')
    cat = read_catalog_csv(spark, str(tmp_path / "c.csv"))
    got = {r.loinc_num: (r.long_common_name, r.component, r.common_test_rank, r.aliases) for r in cat.collect()}
    assert got == {"1-1": ("Iron, total", None, 0, ["Fe", "Serum iron"]), "2-2": ("B", "C", 7, [])}
    assert tables.sync(cat, str(tmp_path / "t")) and not tables.sync(cat, str(tmp_path / "t"))
    assert tables.sync(cat.where("loinc_num = '1-1'"), str(tmp_path / "t"))
    raw = spark.createDataFrame([("1", "ACTIVE", "a; b", "5"), ("2", "ACTIVE", "a", "1"), ("1", "DEPRECATED", "a", "1"), ("1", "ACTIVE", "c", "0")], "CLASSTYPE string, STATUS string, RELATEDNAMES2 string, COMMON_TEST_RANK string")
    assert [r.aliases for r in active_lab_codes(raw, core_only=True).collect()] == ["a|b"]


def test_layout_spans(spark):
    rows = [("d", 1, 0, 0, 0, "Iron", 10.0, 10.0, 50.0, 20.0, 10.0, 16), ("d", 1, 0, 0, 1, " ", 50.0, 10.0, 60.0, 20.0, 10.0, 0), ("d", 1, 1, 1, 0, "image", 0.0, 0.0, 1.0, 1.0, 1.0, 0)]
    df = spark.createDataFrame([(*r, 100.0, 200.0) for r in rows], "doc_id string, page int, block_type int, line_idx int, span_idx int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, flags int, page_width double, page_height double")
    (line,) = layout.layout_spans(df).collect()
    assert (line.text, line.x0, line.y1, line.is_bold, line.spans) == ("Iron", 0.1, 0.1, True, ["Iron"])


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("c", i, 1_000_000 + 10 * i) for i in range(6)] + [("e", 9, 1_000_060)], "client string, seq long, s int")
    rows.select("client", F.col("client").alias("document_id"), F.timestamp_seconds("s").alias("ts"), "seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    hits = spark.readStream.schema("client string, document_id string, ts timestamp, seq long").parquet(str(tmp_path / "in"))
    allowed = {r.seq: r.allowed for r in run(jobs.limiter_stream(hits.select("client", "ts", "seq"), 2, 25.0), "limited")}
    assert allowed == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 9: True}
    done = []
    q = jobs.claim_worker(hits.select("document_id", F.lit("pending").alias("status")), lambda df, n: done.append(df.count()), str(tmp_path / "ck"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert sum(done) == 2  # two documents, each claimed once
    again = []
    q = jobs.claim_worker(hits.select("document_id", F.lit("pending").alias("status")), lambda df, n: again.append(df.count()), str(tmp_path / "ck"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert sum(again) == 0


def test_claims_are_won_once(spark, tmp_path):
    queue = spark.createDataFrame([("b", "pending", 2), ("a", "pending", 1), ("c", "complete", 0)], "document_id string, status string, uploaded_at int")
    won = [jobs.claim_next(queue, str(tmp_path / "claims")) for _ in range(3)]
    assert won == ["a", "b", None]


def test_throttled_commits_of_a_stream_equal_the_batch_form(spark, tmp_path):
    from vialframe.operators import lifecycle

    rows = [(f"d{i % 3}", i, 1_000_000.0 + i * 0.13, i % 11 == 0) for i in range(90)]
    df = spark.createDataFrame(rows, "document_id string, seq long, s double, forced boolean").select("document_id", "seq", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "forced")
    want, last = {}, {}
    for d, i, t, f in rows:
        want[i] = f or d not in last or t - last[d] >= 0.8
        last[d] = t if want[i] else last[d]
    assert {r.seq: r.committed for r in lifecycle.commits(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed"))
    assert {r.seq: r.committed for r in run(jobs.commits_stream(stream), "commits")} == want


def test_workers_that_share_claims_exclude_each_other(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("document_id"), F.lit("pending").alias("status")).repartition(4).write.parquet(str(tmp_path / "in"))
    queue = spark.readStream.schema("document_id long, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: dict[str, list] = {"a": [], "b": []}
    workers = [
        jobs.claim_worker(queue, lambda df, n, w=w: seen[w].extend(r.document_id for r in df.collect()), str(tmp_path / f"ck-{w}"), "0 seconds", claims=str(tmp_path / "claims")) for w in seen
    ]
    for q in workers:
        q.processAllAvailable()
        q.stop()
    assert sorted(seen["a"] + seen["b"]) == list(range(40))


def test_stuck_stream_times_out(spark, tmp_path):
    import time

    for doc, second in (("a", 100), ("b", 1000), ("b", 2000)):
        one = spark.createDataFrame([(doc, second)], "document_id string, s int").select("document_id", F.timestamp_seconds("s").alias("ts"))
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("document_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert {(r.document_id, r.last_seen_ms) for r in run(jobs.stuck_stream(stream), "stuck")} >= {("a", 100_000)}


def test_conform(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("notes", T.StringType())])
    assert tables.conform(spark.range(2).withColumn("x", F.lit(1)), schema).columns == ["id", "notes"]


def test_versioned_tables_and_learned_picks(spark, tmp_path):
    from pyspark.sql import types as T

    one = T.StructType([T.StructField("id", T.LongType())])
    two = T.StructType([T.StructField("id", T.LongType()), T.StructField("notes", T.StringType())])
    path = str(tmp_path / "t")
    tables.write_versioned(spark.range(3).withColumn("own", F.lit("x")), path, 1)
    got = tables.read_versioned(spark, path, {1: one, 2: two})
    assert set(got.columns) == {"id", "notes", "own"} and got.count() == 3 and got.where("notes IS NULL AND own = 'x'").count() == 3
    assert tables.migrate(spark.range(1), {1: one, 2: two})[1] == 2
    assert tables.learned_picks(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([("k", "1-1", "review", 1.0)], "key string, loinc_num string, source string, confidence double").write.parquet(str(tmp_path / "l"))
    assert tables.learned_picks(spark, str(tmp_path / "l")).first().loinc_num == "1-1"


def test_page_images(spark):
    import numpy as np

    from vialframe.sources import images

    page = np.full((700, 1100), 255, np.uint8)
    rng = np.random.default_rng(1)
    for y in range(60, 640, 30):
        for x in range(80, 1000, 14):
            if rng.random() < 0.8:
                page[y : y + 11, x : x + 9] = rng.integers(0, 60, (11, 9))
    for tilt in (0.0, 4.0, -7.0):
        assert abs(images.skew(images.turn(page, tilt)) - tilt) <= 0.4
    dim = (page * np.linspace(0.5, 1.0, 1100)[None, :]).astype(np.uint8)
    assert images.flatten_light(dim)[5, :].min() > 240 and images.contrast(dim) < images.contrast(page)
    noisy = np.clip(page + rng.normal(0, 12, page.shape), 0, 255).astype(np.uint8)
    assert images.noise(noisy) > images.noise(page)
    assert images.quarter_turn(page, 90).shape == (1100, 700) and (images.quarter_turn(images.quarter_turn(page, 90), 270) == page).all()
    rows = [("a", 1, images.encode(images.turn(page, 3.0))), ("b", 1, b"broken")]
    out = {r.doc_id: r for r in images.clean_pages(spark.createDataFrame(rows, "doc_id string, page int, image binary")).collect()}
    taken = {s.measure: s for s in out["a"].steps}
    assert out["b"].problem and taken["skew"].repaired and abs(taken["skew"].value - 3) <= 0.2 and list(taken) == [r[0] for r in images.REPAIRS]
    assert not taken["rotation"].repaired and not taken["shrink"].repaired and taken["light"].repaired
    assert abs(images.skew(images.decode(bytes(out["a"].image)))) <= 0.4


def test_image_filters():
    import numpy as np

    from vialframe.sources import images

    rng = np.random.default_rng(2)
    x = rng.integers(0, 255, (60, 80)).astype(np.uint8)
    tap = np.exp(-0.5 * (np.arange(-6, 7) / 2.0) ** 2)
    tap /= tap.sum()
    want = sum(t * np.pad(x.astype(float), ((6, 6), (0, 0)), mode="edge")[i : i + 60] for i, t in enumerate(tap))
    want = sum(t * np.pad(want, ((0, 0), (6, 6)), mode="edge")[:, i : i + 80] for i, t in enumerate(tap))
    assert np.abs(images.gauss(x, 2.0) - want).max() < 1e-9
    ramp = np.tile(np.linspace(0, 255, 400), (300, 1))
    assert np.abs(images.gauss(ramp, 20.0)[:, 80:-80] - ramp[:, 80:-80]).max() < 3
    step = np.full((64, 64), 200, np.uint8)
    step[:, 32:] = 40
    noisy = np.clip(step + rng.normal(0, 6, step.shape), 0, 255).astype(np.uint8)
    calm = images.quiet(noisy)
    assert np.abs(calm.astype(int) - step).mean() < 0.5 * np.abs(noisy.astype(int) - step).mean() and calm[:, 30].mean() - calm[:, 34].mean() > 140
    flat = np.clip(120 + rng.normal(0, 5, (160, 160)), 0, 255).astype(np.uint8)
    assert images.local_contrast(flat).std() > 1.5 * flat.std() and images.contrast(np.full((9, 9), 7, np.uint8)) == 0
    runs = images._runs(np.array([[1, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 1]], bool), 1)
    assert runs.tolist() == [[2, 2, 0, 1], [0, 0, 0, 0], [4, 4, 4, 4]]
    assert images.recognition_scale(1000, 1000, 2.0) == 2.0 and images.recognition_scale(3600, 100, 2.0) == 1.0 and images.recognition_scale(7200, 4000, 1.0) == 0.5
    assert images.recognition_engine(enabled=False) is None
