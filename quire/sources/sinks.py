"""Sinks: document trees as JSON, outlines, crawl logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree(elements: DataFrame) -> DataFrame:
    """(doc_id, document): JSON of chapters, sections and content, from elements with carried headings.

    A document's own elements are gathered, level by level; documents are never gathered together.
    """
    content = F.transform(F.array_sort(F.collect_list(F.struct("position", "kind", "text"))), lambda e: F.struct(e["kind"].alias("kind"), e["text"].alias("text")))
    section = elements.groupBy("doc_id", "chapter_no", "chapter_title", "section_no", "section_title").agg(content.alias("content"))
    chapter = section.groupBy("doc_id", "chapter_no", "chapter_title").agg(F.array_sort(F.collect_list(F.struct("section_no", F.col("section_title").alias("title"), "content"))).alias("sections"))
    whole = chapter.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter_no", F.col("chapter_title").alias("title"), "sections"))).alias("chapters"))
    return whole.select("doc_id", F.to_json(F.struct("doc_id", "chapters")).alias("document"))


def outline(elements: DataFrame) -> DataFrame:
    """(doc_id, position, line): headings indented by their level."""
    level = F.regexp_extract("kind", "^h([1-6])$", 1)
    return elements.filter(level != "").select("doc_id", "position", F.concat(F.repeat(F.lit("  "), level.cast("int") - 1), F.col("text")).alias("line"))


def element_text(kind: Column, text: Column, target: Column) -> Column:
    return (
        F.when(kind == "a", F.concat(F.coalesce(text, F.lit("")), F.lit(" ("), F.coalesce(target, F.lit("")), F.lit(")")))
        .when(kind == "img", F.concat(F.lit("[Image: "), F.coalesce(target, F.lit("")), F.lit("]")))
        .otherwise(F.coalesce(text, F.lit("")))
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Crawl logs are appended; the latest row of a key is taken when they are read (``logs.latest``)."""
    rows.write.mode("append").parquet(path)
