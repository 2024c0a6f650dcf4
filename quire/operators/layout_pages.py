"""Layout over whole pages and across them: gaps, clusters of edges, projections, overlaps, captions, merges.

Boxes: doc_id, page_no, text, x0, x1, top, bottom, size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]


def midpoint(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return F.struct(((x0 + x1) / 2).alias("x"), ((top + bottom) / 2).alias("y"))


def union_box(boxes: DataFrame, *keys: str) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def in_rectangle(boxes: DataFrame, x0: float, top: float, x1: float, bottom: float) -> DataFrame:
    """Boxes that lie wholly in a rectangle, edges included."""
    return boxes.filter((F.col("x0") >= x0) & (F.col("x1") <= x1) & (F.col("top") >= top) & (F.col("bottom") <= bottom))


def page_selected(page: Column, mode: str = "all", pages=(), skipped=()) -> Column:
    """``all``, ``even`` or ``odd`` pages or those of a list, without the skipped ones."""
    chosen = {"all": F.lit(True), "even": page % 2 == 0, "odd": page % 2 == 1, "list": page.isin(*pages)}[mode]
    return chosen & ~page.isin(*skipped) if skipped else chosen


def is_image_page(chars: Column, images: Column) -> Column:
    """Under 50 characters and at least one image."""
    return (chars < 50) & (images >= 1)


def blocks_by_gap(lines: DataFrame, gap: float = 5.0) -> DataFrame:
    """Lines with block_no: a new block where the distance to the line before isn't below ``gap``."""
    w = Window.partitionBy(*PAGE).orderBy("top", "x0")
    far = F.coalesce((F.col("top") - F.lag("bottom").over(w) >= gap).cast("int"), F.lit(0))
    return lines.withColumn("far", far).withColumn("block_no", F.sum("far").over(w)).drop("far")


def edge_clusters(boxes: DataFrame, least_gap: float = 50.0, share: float = 0.03) -> DataFrame:
    """(doc_id, page_no, cluster, n, x0): left edges grouped where they lie closer than twice their median distance.

    The distance is ``least_gap`` at least; clusters with under ``share`` of a page's boxes are left out.
    """
    w, page = Window.partitionBy(*PAGE).orderBy("x0"), Window.partitionBy(*PAGE)
    steps = boxes.select(*PAGE, "x0").withColumn("step", F.col("x0") - F.lag("x0").over(w)).withColumn("at", F.row_number().over(w))
    eps = F.greatest(F.lit(least_gap), 2 * F.coalesce(F.median("step").over(page), F.lit(0.0)))
    marked = steps.select("*", eps.alias("eps"), F.count("*").over(page).alias("total"), F.min("x0").over(page).alias("least"))
    # One sort serves all windows: of each cluster its first row stays, and the next first row tells how many there are.
    first = marked.filter((F.col("at") == 1) | (F.col("step") > F.col("eps")))
    n = F.coalesce(F.lead("at").over(w), F.col("total") + 1) - F.col("at")
    found = first.select(*PAGE, (F.row_number().over(w) - 1).cast("bigint").alias("cluster"), n.alias("n"), F.coalesce("x0", "least").alias("x0"), "total")
    return found.filter(F.col("n") >= share * F.col("total")).drop("total")


def words_of_characters(characters: DataFrame, gap: float = 3.0) -> DataFrame:
    """(doc_id, page_no, line_no, word_no, text, x0, x1): characters of a line joined while they lie at most ``gap`` apart."""
    w = Window.partitionBy(*PAGE, "line_no").orderBy("x0", "text")
    far = F.coalesce((F.col("x0") - F.lag("x1").over(w) > gap).cast("int"), F.lit(0))
    marked = characters.withColumn("far", far).withColumn("word_no", F.sum("far").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda c: c["text"]), "")
    return marked.groupBy(*PAGE, "line_no", "word_no").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def projection(boxes: DataFrame, grid: float = 50.0) -> DataFrame:
    """(doc_id, page_no, x, height): total height of the boxes by bin of the left edge; empty bins in between are zero."""
    bins = boxes.groupBy(*PAGE, F.floor(F.col("x0") / grid).alias("x")).agg(F.sum(F.col("bottom") - F.col("top")).alias("height"))
    pages = bins.groupBy(*PAGE).agg(F.explode(F.sequence(F.min("x"), F.max("x"))).alias("x"))
    return pages.join(bins, [*PAGE, "x"], "left").select(*PAGE, "x", F.coalesce("height", F.lit(0)).alias("height"))


def document_font(boxes: DataFrame) -> DataFrame:
    """(doc_id, size): the median of the pages' median sizes, each counted once a character of the page."""
    pages = boxes.groupBy(*PAGE).agg(F.median("size").alias("size"), F.sum(F.length("text")).alias("chars"))
    w = Window.partitionBy("doc_id").orderBy("size", "page_no")
    total = F.sum("chars").over(Window.partitionBy("doc_id"))
    ranked = pages.select("doc_id", "size", F.sum("chars").over(w).alias("upto"), total.alias("total"))
    return ranked.filter(2 * F.col("upto") >= F.col("total")).groupBy("doc_id").agg(F.min("size").alias("size"))


def column_confidence(boxes: DataFrame, columns: Column, width: float = 600.0) -> DataFrame:
    """(doc_id, page_no, confidence), 0 to 1: half from the spread of the edges, 0.3 from the columns, 0.2 from the density."""
    found = boxes.groupBy(*PAGE).agg(F.var_pop("x0").alias("spread"), columns.alias("columns"), F.count("*").alias("n"))
    score = 0.5 * F.least(F.col("spread") / (width * width / 12), F.lit(1.0)) + 0.3 * F.least(F.col("columns") / 3, F.lit(1.0)) + 0.2 * F.least(F.col("n") / 10, F.lit(1.0))
    return found.select(*PAGE, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"))


def column_of(x0: Column, x1: Column, columns: list[tuple[float, float]]) -> Column:
    """The column with the largest overlap, the first of equals; without overlap the one with the nearest centre."""
    shared = [F.greatest(F.lit(0.0), F.least(x1, F.lit(b)) - F.greatest(x0, F.lit(a))) for a, b in columns]
    near = [F.abs((x0 + x1) / 2 - (a + b) / 2) for a, b in columns]
    ranked = [F.struct(s.alias("shared"), (-d).alias("near"), F.lit(-k).alias("k")) for k, (s, d) in enumerate(zip(shared, near))]
    overlap = F.array_max(F.array(*[F.struct(s.alias("shared"), F.lit(-k).alias("k")) for k, s in enumerate(shared)]))
    nearest = F.array_max(F.array(*[F.struct(r["near"], r["k"]) for r in ranked]))
    return -F.when(overlap["shared"] > 0, overlap["k"]).otherwise(nearest["k"])


def captions(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page_no, caption, block): each caption's nearest block and each block's nearest caption, where they agree.

    ``blocks`` (block, x0, x1, top, bottom) and ``found`` (caption, the same edges) of a page; the distance is the vertical
    gap plus the caption's height times the share of its width without overlap.
    """
    b, c = blocks.alias("b"), found.alias("c")
    pairs = c.join(b, PAGE)
    gap = F.greatest(F.col("c.top") - F.col("b.bottom"), F.col("b.top") - F.col("c.bottom"), F.lit(0))
    shared = F.greatest(F.least(F.col("c.x1"), F.col("b.x1")) - F.greatest(F.col("c.x0"), F.col("b.x0")), F.lit(0))
    share = shared / F.greatest(F.col("c.x1") - F.col("c.x0"), F.lit(1))
    pairs = pairs.select(*PAGE, "caption", "block", (gap + (1 - share) * (F.col("c.bottom") - F.col("c.top"))).alias("distance"))
    first = F.row_number().over(Window.partitionBy(*PAGE, "caption").orderBy("distance", "block"))
    second = F.row_number().over(Window.partitionBy(*PAGE, "block").orderBy("distance", "caption"))
    return pairs.withColumn("i", first).withColumn("j", second).filter("i = 1 and j = 1").select(*PAGE, "caption", "block", "distance")


def merge_lists(lists: DataFrame) -> DataFrame:
    """Lists (doc_id, position, page_no, items): one that ends or begins with ``-`` at a page break goes on in the next."""
    w = Window.partitionBy("doc_id").orderBy("position")
    last = F.rtrim(F.element_at(F.lag("items").over(w), -1))
    open_ = last.endswith("-") | F.ltrim(F.get("items", F.lit(0))).startswith("-")
    goes_on = open_ & (F.lag("page_no").over(w) == F.col("page_no") - 1)
    return _merged(lists, goes_on, "items")


def merge_tables(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, position, page_no, rows): those on consecutive pages with equally wide first rows are one."""
    w = Window.partitionBy("doc_id").orderBy("position")
    width = F.size(F.get("rows", F.lit(0)))
    goes_on = (F.lag(width).over(w) == width) & (F.lag("page_no").over(w) == F.col("page_no") - 1)
    return _merged(tables, goes_on, "rows")


def _merged(parts: DataFrame, goes_on: Column, name: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("position")
    marked = parts.withColumn("start", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("group", F.sum("start").over(w))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", name))), lambda p: p[name]))
    return marked.groupBy("doc_id", "group").agg(F.min("position").alias("position"), F.min("page_no").alias("page_no"), whole.alias(name))


def realigned(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page_no) with the recognised text (doc_id, page_no, text), empty where recognition failed."""
    return pages.join(recognised.select(*PAGE, "text"), PAGE, "left").withColumn("text", F.coalesce("text", F.lit("")))


def recognition_confidence(words: DataFrame, *keys: str) -> DataFrame:
    return words.groupBy(*keys).agg(F.avg(F.abs("confidence")).alias("confidence"))


def last_page_with(pages: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, page_no, text) of the last page whose text has the pattern."""
    hit = pages.filter(F.lower("text").rlike(pattern))
    return hit.groupBy("doc_id").agg(F.max("page_no").alias("page_no"), F.max_by("text", "page_no").alias("text"))


def title_and_author(text: Column, title: Column | None = None, author: Column | None = None) -> Column:
    """Embedded metadata, else the first and the second filled line, else ``Unknown``."""
    lines = F.filter(F.transform(F.split(text, "\\n"), lambda x: F.trim(x)), lambda x: x != "")
    pick = lambda given, k: F.coalesce(F.nullif(given, F.lit("")) if given is not None else F.lit(None), F.get(lines, F.lit(k)), F.lit("Unknown"))
    return F.struct(pick(title, 0).alias("title"), pick(author, 1).alias("author"))
