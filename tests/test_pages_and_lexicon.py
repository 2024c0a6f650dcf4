"""Fixtures for the word lists, page layout, link and breaker operators, with nulls, empty input and ties."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from quire.functions import lexicon, patterns, scripts, tables
from quire.operators import classify, layout_pages, logs, pages


def one(spark, column, **values):
    names, row = list(values), tuple(values.values())
    return spark.createDataFrame([row], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


def test_polarity_and_labels(spark):
    t = F.col("t")
    assert one(spark, lexicon.polarity(t), t="Good, good and BAD") == 1 / 3
    assert one(spark, lexicon.polarity(t), t="goodness") == 0.0 and one(spark, lexicon.polarity(t), t=None) is None
    assert one(spark, lexicon.mean_polarity(t), t="good\n\nbad\n \nplain") == 0.0
    assert one(spark, lexicon.mean_polarity(t), t="") == 0.0 and one(spark, lexicon.mean_polarity(t), t=None) == 0.0
    assert one(spark, lexicon.clause_label(t), t="The tenant shall pay rent") == "payment"
    assert one(spark, lexicon.clause_score(t), t="The tenant shall pay rent") == 0.5
    assert one(spark, lexicon.clause_label(t), t="nothing") == "other"


def test_entities(spark):
    rows = spark.createDataFrame([(1, "On 1/2/2024 pay $1,200 under Section 4, then $5"), (2, None), (3, "")], "id long, t string")
    assert {tuple(r)[1:] for r in lexicon.entities(rows, "id", "t").collect()} == {("date", "1/2/2024"), ("amount", "$1,200"), ("amount", "$5"), ("section", "Section 4")}
    spans = {r.type: (r.start, r.end) for r in lexicon.entity_spans(rows, "id", "t").collect()}
    assert spans == {"date": (3, 11), "amount": (16, 22), "section": (29, 38)}


def test_repair(spark):
    words = spark.createDataFrame([("tset",), ("test",), ("zzzzz",), ("",), ("hous",), ("hous",)], "word string")
    known = spark.createDataFrame([("test", 5), ("house", 9), ("hour", 2)], "term string, n long")
    assert {tuple(r) for r in lexicon.repair(words, known).collect()} == {("tset", "test"), ("test", "test"), ("zzzzz", "zzzzz"), ("", ""), ("hous", "house")}


def test_segments_split_before_the_first_cue(spark):
    t = F.col("t")
    assert one(spark, classify.segments(t), t="Intro text WHEREAS a WHEREAS b\n\nNOW  THEREFORE c\n \nlast") == ["Intro text", "WHEREAS a WHEREAS b", "NOW  THEREFORE c", "last"]
    assert one(spark, classify.segments(t), t="") == [] and one(spark, classify.segments(t), t=None) is None


def test_ideographic_spaces_become_one(spark):
    assert one(spark, scripts.clean_script(F.col("t"), F.lit("cjk")), t="你好　　世界 ﻿") == "你好 世界"
    found = one(spark, scripts.process(F.col("t")), t="مرحبا بالعالم العربي")
    assert (found.script, found.language, found.direction) == ("arabic", "ar", "rtl")
    assert one(spark, scripts.setting(F.col("t"), {"ar": "rtl"}, "ltr"), t="xx") == "ltr"
    assert one(spark, scripts.allowed(F.col("t"), ["en"]), t="plain words here") is True


def test_links_in_all_quotes(spark):
    html = """<a href="/a#x">1</a><A class=b HREF='/b'>2</A><a href=/c>3</a><a data-href="/no">4</a><area href="/no">"""
    rows = spark.createDataFrame([(1, "http://h.org/p/", html), (2, "http://h.org/", None)], "page_id long, url string, html string")
    assert sorted(r.target for r in pages.links(rows).collect()) == ["http://h.org/a", "http://h.org/b", "http://h.org/c"]


def test_breaker_ignores_attempts_while_open_and_tries_once(spark):
    start = dt.datetime(2024, 1, 1)
    seconds = [(0, True), (1, True), (2, True), (10, True), (63, True), (70, True), (124, False), (125, True), (126, True), (127, True)]
    rows = [("k", start + dt.timedelta(seconds=s), i, bad) for i, (s, bad) in enumerate(seconds)] + [("other", start, 0, True)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp, i long, bad boolean")
    found = logs.breaker_openings(frame, "k", "ts", "i", F.col("bad"), 3).orderBy("opened").collect()
    assert [(r.key, r.opened // 1_000_000 % 3600) for r in found] == [("k", 2), ("k", 63), ("k", 127)]
    assert logs.breaker_openings(frame.limit(0), "k", "ts", "i", F.col("bad"), 3).count() == 0


def test_tables_and_patterns(spark):
    rows = spark.createDataFrame([(["a"], [["1"], [None]])], "h array<string>, r array<array<string>>")
    text = rows.select(tables.json(F.col("h"), F.col("r"), F.lit("cap")).alias("j"))
    back = text.select(tables.from_json(F.col("j")).alias("t")).first().t
    assert (back.headers, back.rows, back.caption) == (["a"], [["1"], [None]], "cap")
    assert one(spark, tables.from_json(F.col("t")), t="[1]") is None
    assert one(spark, tables.from_json(F.col("t")), t="{}").rows == []
    sheet = rows.select(tables.sheet(F.col("h"), F.col("r"), F.lit("s")).alias("x")).first().x
    assert (sheet.sheet, sheet.cells) == ("s", [["a"], ["1"], [None]])
    video = spark.createDataFrame([("Duration: 01:02:03 Resolution: 1920x1080 Frame Rate: 29.97fps Codec: H264 Audio Channels: 2",)], "t string")
    got = video.select(*patterns.extract(F.col("t"), patterns.VIDEO)).first()
    assert (got.duration, got.resolution, got.frame_rate, got.codec, got.audio_channels, got.bitrate) == ("01:02:03", "1920x1080", "29.97", "H264", "2", "")


def test_layout_across_pages(spark):
    lists = spark.createDataFrame([(1, 1, 1, ["a", "b -"]), (1, 2, 2, ["c"]), (1, 3, 4, ["- d"]), (1, 4, 5, ["- e"])], "doc_id long, position int, page_no int, items array<string>")
    assert [r["items"] for r in layout_pages.merge_lists(lists).orderBy("position").collect()] == [["a", "b -", "c"], ["- d", "- e"]]
    found = spark.createDataFrame([(1, 1, 1, [["a", "b"]]), (1, 2, 2, [["c", "d"]]), (1, 3, 3, [["e"]])], "doc_id long, position int, page_no int, rows array<array<string>>")
    assert [r["rows"] for r in layout_pages.merge_tables(found).orderBy("position").collect()] == [[["a", "b"], ["c", "d"]], [["e"]]]
    pages_ = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page_no int")
    got = spark.createDataFrame([(1, 1, "x")], "doc_id long, page_no int, text string")
    assert sorted(map(tuple, layout_pages.realigned(pages_, got).collect())) == [(1, 1, "x"), (1, 2, "")]
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0), (1, 1, 0.0, 12.0, 20.0), (1, 1, 0.0, 25.0, 30.0)], "doc_id long, page_no int, x0 double, top double, bottom double")
    assert [r.block_no for r in layout_pages.blocks_by_gap(lines).orderBy("top").collect()] == [0, 0, 1]
    meta = one(spark, layout_pages.title_and_author(F.col("t")), t="\n Title \n\nAuthor\nrest")
    assert (meta.title, meta.author) == ("Title", "Author")
    meta = one(spark, layout_pages.title_and_author(F.col("t"), F.lit("Given")), t=None)
    assert (meta.title, meta.author) == ("Given", "Unknown")
    assert one(spark, layout_pages.page_selected(F.lit(4), "list", [4, 5], [5]), t="") is True
    assert one(spark, layout_pages.column_of(F.lit(100.0), F.lit(120.0), [(0.0, 50.0), (90.0, 200.0)]), t="") == 1
    assert one(spark, layout_pages.column_of(F.lit(60.0), F.lit(62.0), [(0.0, 50.0), (90.0, 200.0)]), t="") == 0


def test_edge_clusters_sort_once(spark):
    """Clusters with ties, nulls, pages of one box and rare ones, by one sort and without a join."""
    rng = random.Random(5)
    rows = [(p % 7, p // 7, rng.choice([None, 0, 10, 10, 20, 300, 300, 310, 900, rng.randrange(2000)])) for p in range(40) for _ in range(rng.choice([1, 2, 9, 80]))]
    pages = {}
    for d, p, x in rows:
        pages.setdefault((d, p), []).append(x)
    want = []
    for key, xs in pages.items():
        xs.sort(key=lambda x: (x is not None, x))
        steps = [None] + [b - a if a is not None else None for a, b in zip(xs, xs[1:])]
        known = [s for s in steps if s is not None]
        eps, at, found = max(50, 2 * statistics.median(known) if known else 0), 0, {}
        for x, s in zip(xs, steps):
            at += s is not None and s > eps
            found.setdefault(at, []).append(x)
        want += [(*key, k, len(v), min((x for x in v if x is not None), default=None)) for k, v in found.items() if len(v) >= 0.03 * len(xs)]
    frame = spark.createDataFrame(rows, "doc_id long, page_no int, x0 int")
    got = layout_pages.edge_clusters(frame)
    assert got.columns == ["doc_id", "page_no", "cluster", "n", "x0"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")
    plan = plan[2] or plan[0]
    assert plan.count("Sort [") == 1 and "Join" not in plan and "Aggregate" not in plan
