"""Roll-ups of the document model: means of means up the tree, counts, ordered collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_of_means(rows: DataFrame, levels: Sequence[str], value: Column | str, parents: DataFrame | None = None) -> DataFrame:
    """The mean of ``value`` by the finest level, then the unweighted mean of these by each coarser level.

    ``levels`` runs from coarse to fine; the result has the first level and ``mean``, ``n`` (children).  ``parents`` may list
    all keys of the finest level: those without rows count as 0.  Every step folds map-side, so a hot key is no trouble.
    """
    value = F.col(value) if isinstance(value, str) else value
    now = rows.groupBy(*levels).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    if parents is not None:
        now = parents.select(*levels).distinct().join(now, list(levels), "left").na.fill({"mean": 0.0, "n": 0})
    for k in range(len(levels) - 1, 0, -1):
        now = now.groupBy(*levels[:k]).agg(F.avg("mean").alias("mean"), F.count("*").alias("n"))
    return now


def whole_mean(rows: DataFrame, value: str = "mean") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.count("*").alias("n"))


def counts(elements: DataFrame) -> DataFrame:
    """Chapters, sections and elements of each document."""
    return elements.groupBy("doc_id").agg(
        F.countDistinct("chapter_no").alias("chapter_count"),
        F.countDistinct("chapter_no", "section_no").alias("section_count"),
        F.count("*").alias("element_count"),
    )


def ordered(rows: DataFrame, key: Sequence[str], position: str, value: str, out: str) -> DataFrame:
    """The values of a key in order of position, as one array a key."""
    pairs = F.array_sort(F.collect_list(F.struct(position, value)))
    return rows.groupBy(*key).agg(F.transform(pairs, lambda p: p[value]).alias(out))


def carry_headings(elements: DataFrame, key: str = "doc_id", position: str = "position") -> DataFrame:
    """Adds chapter_no, section_no and their titles, carried forward from headings (kind h1: chapter; h2, h3: section)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    chapter, section = F.col("kind") == "h1", F.col("kind").isin("h2", "h3")
    numbered = elements.withColumn("chapter_no", F.sum(chapter.cast("int")).over(w))
    numbered = numbered.withColumn("chapter_title", F.coalesce(F.last(F.when(chapter, F.col("text")), True).over(w), F.lit("Main")))
    inner = Window.partitionBy(key, "chapter_no").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("section_no", F.sum(section.cast("int")).over(inner)).withColumn(
        "section_title", F.coalesce(F.last(F.when(section, F.col("text")), True).over(inner), F.lit("Content"))
    )


def to_text(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document as text, one line an element in order."""
    return ordered(elements, [key], "position", "text", "lines").select(key, F.array_join("lines", "\n").alias("text"))


def primary_language(rows: DataFrame, key: str, lang: str, length: str) -> DataFrame:
    """Of each key, the language with the greatest total length; the name decides ties."""
    totals = rows.groupBy(key, lang).agg(F.count("*").alias("texts"), F.sum(length).alias("chars"))
    best = F.min_by(F.struct(lang, "texts", "chars"), F.struct((-F.col("chars")).alias("c"), F.col(lang).alias("l")))
    return totals.groupBy(key).agg(best.alias("b")).select(key, "b.*")
