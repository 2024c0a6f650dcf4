"""Tables as columns: ``headers`` array<string>, ``rows`` array<array<string>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import infer_type


def column(headers: Column, rows: Column, name: str) -> Column:
    at = F.array_position(headers, name).cast("int") - 1
    return F.when(at >= 0, F.transform(rows, lambda r: F.get(r, at))).otherwise(F.array().cast("array<string>"))


def cell(rows: Column, row: int, at: int) -> Column:
    return F.get(F.get(rows, F.lit(row)), F.lit(at))


def records(headers: Column, rows: Column) -> Column:
    """One map a row; missing cells are null, cells without header are called ``column_i``."""
    width = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    names = F.transform(places, lambda i: F.coalesce(F.get(headers, i), F.concat(F.lit("column_"), i.cast("string"))))
    return F.transform(rows, lambda r: F.map_from_arrays(names, F.transform(places, lambda i: F.get(r, i))))


def columns(headers: Column, rows: Column) -> Column:
    """A map from header to its cells."""
    places = F.transform(headers, lambda h, i: i)
    return F.map_from_arrays(headers, F.transform(places, lambda i: F.transform(rows, lambda r: F.get(r, i))))


def cells(rows: Column) -> Column:
    return F.flatten(rows)


def _quoted(x: Column) -> Column:
    x = F.coalesce(x, F.lit(""))
    return F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv(headers: Column, rows: Column) -> Column:
    """Lines end in CR LF; cells with quotes, commas or line ends are quoted."""
    line = lambda r: F.concat(F.array_join(F.transform(r, _quoted), ","), F.lit("\r\n"))
    return F.concat(line(headers), F.array_join(F.transform(rows, line), ""))


def html(headers: Column, rows: Column, caption: Column | None = None) -> Column:
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), F.coalesce(c, F.lit("")), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    head = F.lit("") if caption is None else F.coalesce(F.concat(F.lit("<caption>"), caption, F.lit("</caption>")), F.lit(""))
    return F.concat(F.lit("<table>"), head, row(headers, "th"), F.array_join(F.transform(rows, lambda r: row(r, "td")), ""), F.lit("</table>"))


def json(headers: Column, rows: Column, caption: Column | None = None) -> Column:
    return F.to_json(F.struct(headers.alias("headers"), rows.alias("rows"), *([] if caption is None else [caption.alias("caption")])))


def from_json(x: Column) -> Column:
    """A struct of headers, rows and caption; missing parts are empty, text that is no object gives null."""
    got = F.from_json(x, "headers array<string>, rows array<array<string>>, caption string")
    empty = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    whole = F.struct(F.coalesce(got["headers"], empty[0]).alias("headers"), F.coalesce(got["rows"], empty[1]).alias("rows"), got["caption"].alias("caption"))
    return F.when(x.rlike("^\\s*\\{"), whole)


def sheet(headers: Column, rows: Column, name: Column) -> Column:
    """What a spreadsheet takes: its name, and all rows with the headers first."""
    return F.struct(name.alias("sheet"), F.concat(F.array(headers), rows).alias("cells"))


def text(headers: Column, rows: Column) -> Column:
    line = lambda r: F.array_join(r, " | ", "")
    return F.array_join(F.concat(F.array(line(headers)), F.transform(rows, line)), "\n")


def column_types(headers: Column, rows: Column) -> Column:
    """A map from header to the type of the first filled cell among its first five."""
    places = F.transform(headers, lambda h, i: i)
    first = lambda i: F.get(F.filter(F.transform(F.slice(rows, 1, 5), lambda r: F.get(r, i)), lambda c: c.isNotNull()), F.lit(0))
    return F.map_from_arrays(headers, F.transform(places, lambda i: F.coalesce(infer_type(first(i)), F.lit("unknown"))))
