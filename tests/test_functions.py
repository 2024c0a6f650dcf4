import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import patterns, scripts, tables, urls
from quire.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Example.COM/a/?b=2&a=1#top", "http://example.com/a?a=1&b=2"),
        ("https://x.org", "https://x.org"),
        ("https://x.org/p//?q=&r", "https://x.org/p"),
        (None, None),
    ],
)
def test_normalise(spark, url, want):
    assert one(spark, urls.normalise(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    "base, link, want",
    [
        ("http://h/a/b", "c", "http://h/a/c"),
        ("http://h/a/b", "/c#x", "http://h/c"),
        ("http://h", "c", "http://h/c"),
        ("https://h/a", "//o/p", "https://o/p"),
        ("http://h/a#f", "#t", "http://h/a"),
        ("http://h/a", "mailto:x@y", "mailto:x@y"),
    ],
)
def test_resolve(spark, base, link, want):
    assert one(spark, urls.resolve(F.col("b"), F.col("l")), b=base, l=link) == want


@pytest.mark.parametrize("url, loose, strict", [("http://evilx.ae/", True, False), ("http://a.x.ae/", True, True), ("ftp://x.ae/", False, False), (None, False, False)])
def test_valid_link(spark, url, loose, strict):
    assert one(spark, urls.valid_link(F.col("u"), ("x.ae",)), u=url) is loose
    assert one(spark, urls.valid_link(F.col("u"), ("x.ae",), strict=True), u=url) is strict


@pytest.mark.parametrize(
    "cell, want",
    [("1_000", "numeric"), ("12d", "text"), ("nan", "numeric"), (" 12 ", "numeric"), ("1e3", "numeric"), ("2024-01-15", "date"), ("2024-01-15T10", "date"), ("", "text"), (".5", "numeric"), (None, None)],
)
def test_infer_type(spark, cell, want):
    assert one(spark, T.infer_type(F.col("c")), c=cell) == want
    if cell and want != "date":
        try:
            float(cell)
            assert want == "numeric"
        except ValueError:
            assert want == "text"


def test_text_functions(spark):
    assert one(spark, T.guard_numbers(F.col("t")), t="1,5 and 12,345") == "1,500 and 12,345"
    assert one(spark, T.correct_numbers(F.col("t")), t="I23 O5 1O2 1.500") == "123 05 102 1,500"
    assert one(spark, T.collapse_repeats(F.col("t")), t="aaab 1,000") == "ab 1,0"
    assert one(spark, T.collapse_repeats(F.col("t"), True), t="aaab 1,000") == "ab 1,000"
    assert one(spark, T.nfkc(F.col("t")), t="ﬁ½") == unicodedata.normalize("NFKC", "ﬁ½")
    assert one(spark, T.nfkc(F.col("t")), t=None) is None
    assert one(spark, T.drop_header_lines(F.col("t")), t="Page 3\nkept\nConfidential x") == "kept"
    assert one(spark, T.citations(F.col("t")), t="1. First\n[2] Second\n• Third") == ["First", "Second", "Third"]
    assert one(spark, T.clauses(F.col("t")), t=" short. a longer clause here.") == ["a longer clause here"]
    assert one(spark, T.formula_complexity(F.col("t")), t="\\frac{a}{b}^2 \\int") == 4
    assert one(spark, T.formula_variables(F.col("t")), t="\\frac x") == ["f", "r", "a", "c", "x"]
    assert one(spark, T.extract_formula(F.col("t")), t="so $$a+b$$ holds") == "a+b"
    assert one(spark, T.break_headings(F.col("t"), ["Now then"]), t="a now THEN b") == "a\nNOW THEN\nb"
    assert one(spark, T.replace_fuzzy(F.col("t"), {"WHEREAS0": "WHEREAS", "xx": "long word"}), t="WHEREAS0 xx") == "WHEREAS xx"
    assert one(spark, T.clean(F.col("t")), t="Page 1\nHellooo,   (cid:3) wörld!") == "Hello, wrld!"
    assert one(spark, T.format_size(F.lit(1536)), t="") == "1.5 KB"
    lines = one(spark, T.code_lines(F.col("t")), t="# a\n\nx = 1")
    assert (lines.total, lines.filled, lines.comments) == (3, 2, 1)


def test_patterns(spark):
    row = spark.createDataFrame([("Mail a.b@c.org, SSN: 123-45-6789, $1,200.50, 12/01/2024",)], "t string")
    found = row.select(*patterns.extract(F.col("t"), patterns.PERSONAL)).first()
    assert (found.email, found.ssn, found.currency, found.dates) == ("a.b@c.org", "123-45-6789", "$1,200.50", "12/01/2024")


@pytest.mark.parametrize(
    "text, script, lang", [("plain words here", "latin", "en"), ("مرحبا بالعالم العربي", "arabic", "ar"), ("你好世界你好世界你好世界", "cjk", "zh"), ("한국어 문장입니다 안녕", "latin", "en"), ("", "unknown", "en"), ("Привет мир снова", "cyrillic", "en")]
)
def test_scripts(spark, text, script, lang):
    assert one(spark, scripts.script(F.col("t")), t=text) == script
    assert one(spark, scripts.language_of(scripts.script(F.col("t")), F.col("t"))[0], t=text) == lang


def test_tables(spark):
    rows = spark.createDataFrame([(["Name", "Age"], [["John", "25"], ["Jane"], ['a"b', "1,5", "x"]])], "h array<string>, r array<array<string>>")
    h, r = F.col("h"), F.col("r")
    got = rows.select(
        tables.csv(h, r).alias("csv"), tables.records(h, r).alias("records"), tables.column(h, r, "Age").alias("age"), tables.column(h, r, "No").alias("no"),
        tables.cell(r, 5, 5).alias("cell"), tables.column_types(h, r).alias("types"), tables.cells(r).alias("cells"), tables.html(h, r).alias("html"), tables.text(h, r).alias("text"),
    ).first()
    assert got.csv == 'Name,Age\r\nJohn,25\r\nJane\r\n"a""b","1,5",x\r\n'
    assert got.records[1] == {"Name": "Jane", "Age": None, "column_2": None} and got.records[2]["column_2"] == "x"
    assert got.age == ["25", None, "1,5"] and got.no == [] and got.cell is None
    assert got.types == {"Name": "text", "Age": "numeric"} and len(got.cells) == 6
    assert "<td>John</td>" in got.html and got.text.startswith("Name | Age\nJohn | 25")


def test_nfkc_takes_batches_in_parts(spark):
    """No array that is given out holds more than a part of a large batch, and rows keep their order across parts."""
    texts = ["ﬁ½" * 50_000, None, "", "plain"] * 25
    want = [t and unicodedata.normalize("NFKC", t) for t in texts]
    got = list(T.nfkc_parts(iter([pa.array(texts), pa.array([], pa.string()), pa.array(texts).slice(1, 3)])))
    assert [t for a in got for t in a.to_pylist()] == want + want[1:4]
    assert max(a.nbytes for a in got) < 2 << 20
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    assert [r.x for r in rows.select("id", T.nfkc(F.col("t")).alias("x")).orderBy("id").collect()] == want
