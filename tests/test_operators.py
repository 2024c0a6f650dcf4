import io
import random
import zipfile
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import classify, duplicates, layout, logs, pages, rollups, trees
from quire.sources import files, html, sinks
from quire.streaming import stateful


def test_mean_of_means_counts_empty_sections(spark):
    rows = spark.createDataFrame([("c", "s1", 1.0), ("c", "s1", 3.0), ("c", "s2", 5.0)], "c string, s string, v double")
    parents = spark.createDataFrame([("c", "s1"), ("c", "s2"), ("c", "s3")], "c string, s string")
    assert rollups.mean_of_means(rows, ["c", "s"], "v").first()["mean"] == 3.5
    assert abs(rollups.mean_of_means(rows, ["c", "s"], "v", parents).first()["mean"] - 7 / 3) < 1e-12


def test_keep_first_near_is_greedy(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=80)
        for _ in range(5):
            changed = list(base)
            for _ in range(rng.randrange(0, 4)):
                changed[rng.randrange(80)] = rng.choice(words)
            texts.append(" ".join(changed))
    texts += ["short", "short", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    kept, fps = [], []
    for i, t in enumerate(texts):
        if t is None or len(t) < 30:
            kept.append(i)
            continue
        f = duplicates.fingerprint(t)
        if all(bin((f ^ g) & (1 << 64) - 1).count("1") > 2 for g in fps):
            kept.append(i)
            fps.append(f)
    got = sorted(r.id for r in duplicates.keep_first_near(rows, "id", "t").collect())
    assert got == kept and len(kept) < len(texts)


def test_fingerprints_of_many_texts(spark):
    rng = random.Random(8)
    odd = [None, "", "a", "abc", "abcd", "İstanbul ΣΑΣ straße", "日本語のテキスト" * 9, "emoji 😀 𝔸𝔹ℂ𝔻 letters" * 5, "x" * 90_000, "_ - !"]
    texts = odd + ["".join(rng.choices("abcdé Zz9_.日", k=rng.randrange(2000))) for _ in range(60)]
    want = [None if t is None else duplicates.fingerprint(t) for t in texts]
    assert duplicates.fingerprints_of(texts) == want == duplicates.fingerprints_of(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert [r.f for r in rows.select("id", duplicates.fingerprints("t").alias("f")).orderBy("id").collect()] == want


def test_near_pairs_and_their_candidates(spark):
    """All pairs are found, and fingerprints that agree in one band alone are no candidates."""
    rng = random.Random(9)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = [rng.getrandbits(42) << 22 | 12345 for _ in range(300)]
    values += [v ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for v in values[:100]]
    values = sorted({signed(v) for v in values})
    want = {(a, b) for n, a in enumerate(values) for b in values[n + 1 :] if 0 < bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    frame = spark.createDataFrame([(v,) for v in values], "f long")
    assert {tuple(r) for r in duplicates.near_pairs(frame, "f").collect()} == want and want
    candidates = duplicates.near_keys(frame).groupBy("key").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    assert candidates < 10 * len(want) < 300 * 299 // 2


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav class="nav"><a href="/x">skip me</a></nav>
    <h1>Head</h1><p>One <b>two<p>Three<ul><li>item one<li>item two</ul><table><tr><th>a<th>b<tr><td>1<td>2</table>
    <img src="i.png"><script>var t="</p>";</script><footer><p>below</p></footer><div lang="ar" dir="rtl"><p>نص عربي</p></div>"""
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    found = html.read(rows).orderBy("position").collect()
    assert {r.doc_id for r in found} == {1}
    kinds = [(r.kind, r.text) for r in found]
    assert kinds[0] == ("title", "T") and ("h1", "Head") in kinds and ("p", "Onetwo") in kinds and ("li", "item one") in kinds
    assert not any(r.text == "below" or r.kind == "img" for r in found)
    assert next(r.cells for r in found if r.kind == "table") == [["a", "b"], ["1", "2"]]
    assert next(r.lang for r in found if r.text == "نص عربي") == "ar"
    assert any(k == "img" for k, *_ in html.elements(page, keep_images=True))
    tree = sinks.tree(rollups.carry_headings(html.read(rows))).first().document
    assert '"title":"Head"' in tree


def test_html_is_read_in_small_batches(spark, monkeypatch):
    """A worker gives out few rows at once, however many pages a batch holds."""
    page = "<h1>Head</h1>" + "<p>words</p>" * 50
    seen = {}
    for method in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), method, lambda frame, run, schema, *a, **k: seen.setdefault("run", run))
    html.read(spark.range(1).select(F.col("id").alias("page_id"), F.lit(page).alias("html")))
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(900)), "html": [page, None, ""] * 300})
    got = list(seen["run"](iter([whole.slice(0, 450), whole.slice(450), whole.slice(0, 0)])))
    assert max(b.num_rows for b in got) <= 2000 and sum(b.num_rows for b in got) == 300 * 51
    rows = pa.Table.from_batches(got)
    assert rows["doc_id"].to_pylist() == [k for k in range(0, 900, 3) for _ in range(51)] and rows["position"].to_pylist() == list(range(51)) * 300


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\nText **bold**\n\nmore `code`\n## Two\n```py\nx=1\n```\n")
    (tmp_path / "b.yaml").write_text("a: 1\nb: [x, {c: true}]\n")
    (tmp_path / "bad.yaml").write_text("a: [1\n")
    (tmp_path / "c.unknown").write_text("x")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
        z.writestr("word/media/i.png", b"x")
    with zipfile.ZipFile(tmp_path / "e.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="i" href="c.html"/></manifest><spine><itemref idref="i"/></spine></package>')
        z.writestr("o/c.html", "<h1>Chapter</h1><p>Words here</p>")
    got = {}
    for r in files.read(spark, str(tmp_path)).orderBy("position").collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.kind, r.text))
    assert got["a.md"] == [("h1", "One"), ("p", "Text bold"), ("p", "more code"), ("h2", "Two"), ("code", "x=1")]
    assert ("boolean", "true") in got["b.yaml"] and got["bad.yaml"][0][0] == "error" and "c.unknown" not in got
    assert got["d.docx"] == [("h1", "Head"), ("p", "Body"), ("table", "x"), ("media", "i.png")]
    assert got["e.epub"][0] == ("meta", "Book") and ("h1", "Chapter") in got["e.epub"]
    assert {r.extension: r.files for r in files.sizes(spark, str(tmp_path)).collect()}[".yaml"] == 2


def test_trees(spark):
    api = '{"openapi": "3.0.0", "paths": {"/u": {"get": {"operationId": "getU", "summary": "s", "r": {"$ref": "#/components/schemas/A"}}}}, "components": {"schemas": {"A": {"$ref": "#/components/schemas/B"}, "B": {"e": []}, "C": {"$ref": "#/components/schemas/C"}}}}'
    table = trees.flatten(spark.createDataFrame([(1, api), (2, "{"), (3, None)], "id long, t string"), "id", "t").cache()
    assert {r.doc_id for r in table.collect()} == {1, 2}
    e = trees.endpoints(table).first()
    assert (e.api_path, e.method, e.operation_id, e.summary) == ("/u", "GET", "getU", "s")
    refs = {r.path: (r.target, r.resolved) for r in trees.resolve_references(table).collect()}
    assert refs["paths./u.get.r"] == ("components.schemas.B", True) and refs["components.schemas.C"][1] is False
    assert {r.name for r in trees.schemas(table).collect()} == {"A", "B", "C"}
    assert {r.problem for r in trees.problems(table).collect()} == {"unreadable", "empty_list"}
    assert trees.structure(table.filter("doc_id = 1")).first().structure_type == "openapi"
    left = trees.flatten(spark.createDataFrame([(1, '{"a": 1, "b": [1], "c": "x", "d": 1}')], "id long, t string"), "id", "t")
    right = trees.flatten(spark.createDataFrame([(1, '{"a": 2, "b": [1, 2], "c": 3}')], "id long, t string"), "id", "t")
    kinds = {r.path: r.kind for r in trees.differences(left, right).collect()}
    assert kinds == {"a": "value_mismatch", "b": "length_mismatch", "b[1]": "missing_key", "c": "type_mismatch", "d": "missing_key"}
    assert trees.json_schema({"a": [True]}) == {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "boolean"}}}}


def test_layout(spark):
    words = [(1, 1, t, float(x), x + 30.0, float(y), y + 10.0, 10.0) for y, x, t in [(10, 0, "left"), (11, 40, "one"), (22, 0, "two"), (60, 0, "below"), (10, 300, "right"), (22, 300, "more")]]
    frame = spark.createDataFrame(words, "doc_id long, page_no int, text string, x0 double, x1 double, top double, bottom double, size double")
    assert [r.text for r in layout.lines(frame).orderBy("line_no").collect()] == ["left one right", "two more", "below"]
    assert layout.blocks(layout.lines(frame)).count() == 2
    assert layout.column_count(frame).first()["columns"] == 2
    order = layout.reading_order(frame).orderBy("reading_order").select("text").collect()
    assert [r.text for r in order] == ["left", "one", "two", "below", "right", "more"]
    boxes = spark.createDataFrame([(1, 1, 290.0, 0.0, 400.0, 100.0)], "doc_id long, page_no int, x0 double, top double, x1 double, bottom double")
    assert layout.outside(frame, boxes).count() == 4 and layout.outside(frame, boxes.limit(0)).count() == 6
    merged = spark.createDataFrame([(1, 1, 1, "goes"), (1, 2, 2, "on."), (1, 3, 3, "New")], "doc_id long, position int, page_no int, text string")
    assert [r.text for r in layout.merge_across_pages(merged).orderBy("position").collect()] == ["goes on.", "New"]


def test_logs_and_crawl(spark):
    ts = [datetime(2024, 1, 1) + timedelta(seconds=s) for s in range(6)]
    events = spark.createDataFrame([("h", t, i, i != 3) for i, t in enumerate(ts)], "key string, ts timestamp, n int, bad boolean")
    found = logs.breaker_intervals(events, "key", "ts", "n", F.col("bad"), 3).collect()
    assert len(found) == 1 and found[0].opened == ts[2]
    assert logs.retry_delays(8)[-1] == 60.0
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = {r.node: r.depth for r in pages.crawl(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    log = spark.createDataFrame([("u1", "h1"), ("u2", None)], "url string, content_hash string")
    new = spark.createDataFrame([("u1", "x"), ("u3", "h1"), ("u4", None)], "url string, content_hash string")
    assert [r.url for r in pages.not_crawled(new, log).collect()] == ["u4"]
    robots = spark.createDataFrame([("h", "User-agent: *\nSITEMAP: http://h/s.xml")], "host string, body string")
    assert pages.sitemaps_of(robots).first().sitemap == "http://h/s.xml"
    maps = spark.createDataFrame([("s", "<urlset><url><loc> http://H/a/ </loc></url><loc>http://h/a</loc></urlset>")], "sitemap string, body string")
    assert [r.url for r in pages.sitemap_urls(maps).collect()] == ["http://h/a"]
    rules = spark.createDataFrame([("h", "/no")], "host string, disallow string")
    urls = spark.createDataFrame([("http://h/no/x",), ("http://h/yes",), ("http://o/no",)], "url string")
    assert sorted(r.url for r in pages.allowed_by_robots(urls, rules).collect()) == ["http://h/yes", "http://o/no"]


def test_streaming_breaker(spark, tmp_path):
    ts = [datetime(2024, 1, 1) + timedelta(seconds=s) for s in (0, 1, 2, 3, 63, 64, 200)]
    rows = spark.createDataFrame([("h", t, ok) for t, ok in zip(ts, (False, False, False, False, False, True, True))], "key string, ts timestamp, ok boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    job = stateful.breaker(stream, 3).writeStream.format("memory").queryName("opened").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert [r.opened for r in spark.table("opened").orderBy("opened").collect()] == [ts[2], ts[4]]
    sessions = stateful.sessions(stream, "key", "ts", "30 seconds", "1 second")
    first = stateful.first_arrivals(stream, ["key"], "ts")
    for name, frame in (("sessions_out", sessions), ("first_out", first)):
        frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("first_out").count() == 1 and spark.table("sessions_out").count() >= 1


def test_segments(spark):
    rows = spark.createDataFrame([(1, "Intro.\n\nWHEREAS x\n \n end")], "id long, t string")
    assert rows.select(classify.segments(F.col("t")).alias("s")).first().s == ["Intro.", "WHEREAS x", "end"]
    assert [(r.start, r.end) for r in classify.offsets(rows, "id", "t").orderBy("position").collect()][:2] == [(0, 6), (7, 7)]


def test_sample_moves_keys_alone(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(100, 700).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    for n in (1, 37, 400, 1000):
        want = rows.join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        got = classify.sample(rows, labels, "doc_id", n)
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan and "TakeOrdered" not in plan
    assert classify.sample(rows, labels.limit(0), "doc_id", 5).count() == 0


def test_docx_reader_rejects_garbage():
    try:
        list(files.docx(io.BytesIO(b"no zip").getvalue()))
        raise AssertionError
    except zipfile.BadZipFile:
        pass
