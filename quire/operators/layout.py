"""Page layout from word boxes: lines, blocks, columns, kinds, reading order, repeated lines, merges across pages.

Words: doc_id, page_no, text, x0, x1, top, bottom, size.  One page is one group, so a group has a page's words at most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]
LINES = "doc_id bigint, page_no int, line_no int, text string, x0 double, x1 double, top double, bottom double, size double"


def _lines(words: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    words = words.sort_values(["top", "x0"], kind="stable")
    number, anchor, out = -1, None, []
    for top in words["top"]:
        if anchor is None or abs(top - anchor) > tolerance:  # measured from the line's first word
            number, anchor = number + 1, top
        out.append(number)
    words = words.assign(line_no=out).sort_values(["line_no", "x0"], kind="stable")
    found = words.groupby("line_no", as_index=False).agg(
        text=("text", " ".join), x0=("x0", "min"), x1=("x1", "max"), top=("top", "min"), bottom=("bottom", "max"), size=("size", "median")
    )
    return found.assign(doc_id=words["doc_id"].iloc[0], page_no=words["page_no"].iloc[0])


def lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    names = [c.split()[0] for c in LINES.split(", ")]
    return words.groupBy(*PAGE).applyInPandas(lambda w: _lines(w, tolerance)[names], LINES)


def blocks(page_lines: DataFrame, factor: float = 1.6) -> DataFrame:
    """Lines become blocks: a new one where the gap to what came before exceeds ``factor`` median line heights."""
    height = page_lines.groupBy(*PAGE).agg(F.median(F.col("bottom") - F.col("top")).alias("height"))
    w = Window.partitionBy(*PAGE).orderBy("top", "x0")
    before = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = page_lines.join(height, PAGE).withColumn("new", (F.col("top") - before > factor * F.col("height")).cast("int"))
    marked = marked.withColumn("block_no", F.sum(F.coalesce("new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda p: p["text"]), " ")
    return marked.groupBy(*PAGE, "block_no").agg(
        joined.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.median("size").alias("size")
    )


def column_count(page_blocks: DataFrame, gap: float = 50.0) -> DataFrame:
    """Gaps of over ``gap`` between sorted left edges, plus one."""
    w = Window.partitionBy(*PAGE).orderBy("x0")
    marked = page_blocks.withColumn("far", F.col("x0") - F.lag("x0").over(w) > gap)
    return marked.groupBy(*PAGE).agg((F.count_if("far") + 1).alias("columns"))


def assign_columns(page_blocks: DataFrame, gap: float = 50.0) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("x0")
    far = (F.col("x0") - F.lag("x0").over(w) > gap).cast("int")
    return page_blocks.withColumn("far", F.coalesce(far, F.lit(0))).withColumn("column_no", F.sum("far").over(w)).drop("far")


def reading_order(page_blocks: DataFrame, gap: float = 50.0) -> DataFrame:
    """Columns from left to right, each from top to bottom, with blocks that span columns between the bands they divide."""
    width = page_blocks.groupBy(*PAGE).agg(F.avg(F.col("x1") - F.col("x0")).alias("mean_width"))
    placed = assign_columns(page_blocks, gap).join(width, PAGE)
    spans = (F.col("x1") - F.col("x0")) > 1.4 * F.col("mean_width")
    w = Window.partitionBy(*PAGE).orderBy("top", "x0").rowsBetween(Window.unboundedPreceding, 0)
    banded = placed.withColumn("spanning", spans).withColumn("band", F.sum(F.col("spanning").cast("int")).over(w))
    rank = Window.partitionBy(*PAGE).orderBy("band", F.desc("spanning"), "column_no", "top", "x0")
    return banded.withColumn("reading_order", F.row_number().over(rank)).drop("mean_width")


def block_kind(text: Column, size: Column, top: Column, bottom: Column, page_height: Column, median: Column) -> Column:
    """(kind, confidence) by ordered rules on size, position and text."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence"))
    density = F.length(F.regexp_replace(text, "[^=+*/^∑∫√<>-]", "")) / F.greatest(F.length(text), F.lit(1))
    return (
        F.when(density > 0.12, pair("formula", 0.8))
        .when((size > 1.1 * median) & (F.length(text) < 400), pair("heading", 0.85))
        .when(text.rlike("(?i)^(figure|fig\\.|table)\\s*\\d+"), pair("caption", 0.9))
        .when((size < 0.9 * median) & (top > 0.82 * page_height), pair("footnote", 0.75))
        .when(top < 0.08 * page_height, pair("header", 0.7))
        .when(bottom > 0.92 * page_height, pair("footer", 0.7))
        .when(text.rlike("^\\s*([-•*]|\\d+[.)])\\s+"), pair("list_item", 0.8))
        .otherwise(pair("paragraph", 0.5))
    )


def repeated_lines(rows: DataFrame, doc: str, page: str, line: str, share: float = 0.5) -> DataFrame:
    """(doc, line, n): lines on at least two and ``share`` of a document's pages."""
    pages = rows.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    found = rows.groupBy(doc, line).agg(F.countDistinct(page).alias("n")).filter("n >= 2")
    return found.join(pages, doc).filter(F.col("n") >= F.floor(F.col("pages") * share)).select(doc, line, "n")


def outside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose corner lies in none of their page's ``boxes`` (x0, top, x1, bottom; edges included)."""
    lists = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "top", "x1", "bottom")).alias("_boxes"))
    inside = F.exists(
        "_boxes",
        lambda b: (F.col("x0") >= b["x0"]) & (F.col("x0") <= b["x1"]) & (F.col("top") >= b["top"]) & (F.col("top") <= b["bottom"]),
    )
    return words.join(lists, PAGE, "left").filter(~F.coalesce(inside, F.lit(False))).drop("_boxes")


def density(words: DataFrame, grid: float = 50.0) -> DataFrame:
    return words.groupBy(*PAGE, F.floor(F.col("x0") / grid).alias("x"), F.floor(F.col("top") / grid).alias("y")).count()


def font_statistics(words: DataFrame) -> DataFrame:
    return words.groupBy(*PAGE).agg(F.mode("size", True).alias("mode"), F.avg("size").alias("mean"), F.median("size").alias("median"))


def merge_across_pages(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, position, page_no, text) joined to the one before, on the page before, that ends without a stop."""
    w = Window.partitionBy("doc_id").orderBy("position")
    goes_on = ~F.rtrim(F.lag("text").over(w)).endswith(".") & (F.lag("page_no").over(w) == F.col("page_no") - 1)
    marked = paragraphs.withColumn("start", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    marked = marked.withColumn("group", F.sum("start").over(w))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda p: p["text"])
    return marked.groupBy("doc_id", "group").agg(F.min("position").alias("position"), F.array_join(texts, " ").alias("text"))


def is_scanned(chars: Column, images: Column, image_share: Column) -> Column:
    return F.when(chars > 50, False).when(images == 0, True).otherwise((image_share > 0.3) | (chars < 50))
