"""Registered queries over page layout; the boxes are made from ``lineitem``: an order is a page, a line item a box."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout, layout_pages
from quire.plans.queries import table
from quire.registry import query

BOXES_SQL = """b AS (
  SELECT l_orderkey::BIGINT AS doc_id, 1 AS page_no, l_linenumber AS i, repeat(l_returnflag, l_linenumber::INT) AS text, l_quantity::INT * 10 AS x0,
         l_quantity::INT * 10 + l_linenumber::INT * 6 AS x1, (l_suppkey % 60)::INT * 12 AS top, (l_suppkey % 60)::INT * 12 + 10 AS bottom,
         8 + (l_partkey % 5)::INT AS size FROM lineitem)"""


def boxes(spark, folder):
    at = (F.col("l_suppkey") % 60).cast("int") * 12
    left = F.col("l_quantity").cast("int") * 10
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("doc_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("i"), F.expr("repeat(l_returnflag, cast(l_linenumber as int))").alias("text"),
        left.alias("x0"), (left + F.col("l_linenumber").cast("int") * 6).alias("x1"), at.alias("top"), (at + 10).alias("bottom"), (F.col("l_partkey") % 5 + 8).cast("int").alias("size"),
    )


@query("box_midpoints", f"WITH {BOXES_SQL} SELECT doc_id, i, (x0 + x1) / 2 AS x, (top + bottom) / 2 AS y FROM b")
def box_midpoints(spark, folder):
    middle = layout_pages.midpoint(*map(F.col, ("x0", "top", "x1", "bottom")))
    return boxes(spark, folder).select("doc_id", "i", middle.alias("m")).select("doc_id", "i", "m.*")


@query("union_boxes", f"WITH {BOXES_SQL} SELECT doc_id, page_no, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM b GROUP BY ALL")
def union_boxes(spark, folder):
    return layout_pages.union_box(boxes(spark, folder), "doc_id", "page_no")


@query("lines_in_rectangle", f"WITH {BOXES_SQL} SELECT doc_id, i FROM b WHERE x0 >= 100 AND x1 <= 400 AND top >= 50 AND bottom <= 600")
def lines_in_rectangle(spark, folder):
    return layout_pages.in_rectangle(boxes(spark, folder), 100, 50, 400, 600).select("doc_id", "i")


@query("page_selection", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0 AND l_linenumber <> 4")
def page_selection(spark, folder):
    return table(spark, folder, "lineitem").filter(layout_pages.page_selected(F.col("l_linenumber"), "even", skipped=[4])).select("l_orderkey", "l_linenumber")


@query("image_pages", "SELECT page_id, length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) < 50 AND len(regexp_extract_all(html, '<img')) >= 1 AS image_page FROM pages")
def image_pages(spark, folder):
    chars = F.length(F.trim(F.regexp_replace("html", "<[^>]*>", "")))
    images = F.size(F.regexp_extract_all("html", F.lit("(<img)"), 1))
    return table(spark, folder, "pages").select("page_id", layout_pages.is_image_page(chars, images).alias("image_page"))


@query(
    "blocks_by_gap",
    f"""WITH {BOXES_SQL}, g AS (SELECT *, coalesce((top - lag(bottom) OVER w >= 5)::INT, 0) AS far FROM b WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY top, x0, i)),
n AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, page_no ORDER BY top, x0 RANGE UNBOUNDED PRECEDING)::BIGINT AS block_no FROM g)
SELECT doc_id, max(block_no) + 1 AS n_blocks FROM n GROUP BY doc_id""",
)
def blocks_by_gap(spark, folder):
    return layout_pages.blocks_by_gap(boxes(spark, folder)).groupBy("doc_id").agg((F.max("block_no") + 1).alias("n_blocks"))


STEPS_SQL = f"""{BOXES_SQL}, t AS (SELECT doc_id, page_no, x0, x0 - lag(x0) OVER (PARTITION BY doc_id, page_no ORDER BY x0) AS step FROM b),
e AS (SELECT doc_id, page_no, greatest(50, 2 * coalesce(median(step), 0)) AS eps, count(*) AS total FROM t GROUP BY ALL),
k AS (SELECT t.*, total, sum(coalesce((step > eps)::INT, 0)) OVER (PARTITION BY doc_id, page_no ORDER BY x0) AS cluster FROM t JOIN e USING (doc_id, page_no))"""


@query(
    "edge_clusters",
    f"WITH {STEPS_SQL} SELECT doc_id, page_no, cluster::BIGINT AS cluster, count(*) AS n, min(x0) AS x0 FROM k GROUP BY doc_id, page_no, cluster, total HAVING count(*) >= 0.03 * total",
)
def edge_clusters(spark, folder):
    return layout_pages.edge_clusters(boxes(spark, folder))


@query(
    "horizontal_projection",
    f"""WITH {BOXES_SQL}, h AS (SELECT doc_id, floor(x0 / 50)::BIGINT AS x, sum(bottom - top) AS height FROM b GROUP BY ALL),
p AS (SELECT doc_id, unnest(range(min(x), max(x) + 1)) AS x FROM h GROUP BY doc_id)
SELECT p.doc_id, p.x, coalesce(height, 0)::BIGINT AS height FROM p LEFT JOIN h USING (doc_id, x)""",
)
def horizontal_projection(spark, folder):
    return layout_pages.projection(boxes(spark, folder)).select("doc_id", "x", "height")


@query(
    "document_fonts",
    f"""WITH {BOXES_SQL}, p AS (SELECT doc_id, median(size) AS size FROM b GROUP BY doc_id) SELECT doc_id, size FROM p""",
)
def document_fonts(spark, folder):
    return layout_pages.document_font(boxes(spark, folder))


@query(
    "font_statistics",
    f"""WITH {BOXES_SQL}, n AS (SELECT doc_id, size, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT doc_id, arg_max(size, (n, -size)) AS mode FROM n GROUP BY doc_id)
SELECT doc_id, any_value(m.mode) AS mode, round(avg(size), 6) AS mean, median(size) AS median FROM b JOIN m USING (doc_id) GROUP BY doc_id""",
)
def font_statistics(spark, folder):
    return layout.font_statistics(boxes(spark, folder)).select("doc_id", "mode", F.round("mean", 6).alias("mean"), "median")


@query(
    "column_confidence",
    f"""WITH {STEPS_SQL}, c AS (SELECT doc_id, count(DISTINCT floor(x0 / 200)) AS columns, var_pop(x0) AS spread, count(*) AS n FROM b GROUP BY doc_id)
SELECT doc_id, floor(1000 * greatest(0, least(1, 0.5 * least(spread / 30000.0, 1) + 0.3 * least(columns / 3.0, 1) + 0.2 * least(n / 10.0, 1))) + 0.1234567)::BIGINT AS per_mille FROM c""",
)
def column_confidence(spark, folder):
    found = layout_pages.column_confidence(boxes(spark, folder), F.countDistinct(F.floor(F.col("x0") / 200)))
    return found.select("doc_id", F.floor(1000 * F.col("confidence") + 0.1234567).alias("per_mille"))


COLUMNS = ((0.0, 160.0), (170.0, 330.0), (340.0, 520.0))
SHARED_SQL = ", ".join(f"greatest(0.0, least(x1, {b}) - greatest(x0, {a}))" for a, b in COLUMNS)
NEAR_SQL = ", ".join(f"abs((x0 + x1) / 2 - {(a + b) / 2})" for a, b in COLUMNS)


@query(
    "column_of_box",
    f"""WITH {BOXES_SQL}, s AS (SELECT doc_id, i, [{SHARED_SQL}] AS shared, [{NEAR_SQL}] AS near FROM b)
SELECT doc_id, i, (CASE WHEN list_max(shared) > 0 THEN list_position(shared, list_max(shared)) ELSE list_position(near, list_min(near)) END - 1)::INTEGER AS column_no FROM s""",
)
def column_of_box(spark, folder):
    return boxes(spark, folder).select("doc_id", "i", layout_pages.column_of(F.col("x0"), F.col("x1"), list(COLUMNS)).alias("column_no"))


@query(
    "caption_matches",
    f"""WITH {BOXES_SQL}, u AS (
  SELECT doc_id, i, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM b GROUP BY ALL
), p AS (
  SELECT c.doc_id, c.i AS caption, b.i AS block, greatest(c.top - b.bottom, b.top - c.bottom, 0)
    + (1 - greatest(least(c.x1, b.x1) - greatest(c.x0, b.x0), 0)::DOUBLE / greatest(c.x1 - c.x0, 1)) * (c.bottom - c.top) AS distance
  FROM u c JOIN u b ON c.doc_id = b.doc_id WHERE c.i % 2 = 0 AND b.i % 2 = 1
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, caption ORDER BY distance, block) AS i,
                   row_number() OVER (PARTITION BY doc_id, block ORDER BY distance, caption) AS j FROM p)
SELECT doc_id, caption, block, round(distance, 6) AS distance FROM r WHERE i = 1 AND j = 1""",
)
def caption_matches(spark, folder):
    every = layout_pages.union_box(boxes(spark, folder), "doc_id", "page_no", "i")
    blocks = every.filter("i % 2 = 1").withColumnRenamed("i", "block")
    found = layout_pages.captions(blocks, every.filter("i % 2 = 0").withColumnRenamed("i", "caption"))
    return found.select("doc_id", "caption", "block", F.round("distance", 6).alias("distance"))


@query(
    "words_of_boxes",
    f"""WITH {BOXES_SQL}, u AS (SELECT DISTINCT ON (doc_id, x0) * FROM b ORDER BY doc_id, x0, i, text, x1), g AS (SELECT *, coalesce((x0 - lag(x1) OVER w > 3)::INT, 0) AS far FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY x0)),
n AS (SELECT *, sum(far) OVER (PARTITION BY doc_id ORDER BY x0)::BIGINT AS word_no FROM g)
SELECT doc_id, word_no, string_agg(text, '' ORDER BY x0) AS text, min(x0) AS x0, max(x1) AS x1 FROM n GROUP BY doc_id, word_no""",
)
def words_of_boxes(spark, folder):
    once = boxes(spark, folder).groupBy("doc_id", "page_no", "x0").agg(F.min(F.struct("i", "text", "x1")).alias("b"))
    found = layout_pages.words_of_characters(once.select("doc_id", "page_no", F.lit(0).alias("line_no"), "x0", "b.text", "b.x1"))
    return found.select("doc_id", "word_no", "text", "x0", "x1")


PARTS_SQL = """o AS (SELECT o_custkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderstatus AS s FROM orders)"""


def parts(spark, folder):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, folder, "orders").select(F.col("o_custkey").cast("bigint").alias("doc_id"), place.alias("position"), F.col("o_orderstatus").alias("s"))


@query(
    "lists_merged",
    f"""WITH {PARTS_SQL}, p AS (SELECT *, coalesce((lag(s) OVER w = 'F' OR s = 'O')::INT * (position > 1)::INT, 0) AS goes_on FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY position))
SELECT doc_id, count(*) FILTER (goes_on = 0) AS n_lists FROM p GROUP BY doc_id""",
)
def lists_merged(spark, folder):
    """A list an order, a page each; F ends and O begins with a dash."""
    item = F.when(F.col("s") == "F", "item -").when(F.col("s") == "O", "- item").otherwise("item")
    lists = parts(spark, folder).select("doc_id", "position", F.col("position").alias("page_no"), F.array(item).alias("items"))
    return layout_pages.merge_lists(lists).groupBy("doc_id").agg(F.count("*").alias("n_lists"))


@query(
    "tables_merged",
    f"""WITH {PARTS_SQL}, p AS (SELECT *, coalesce((lag(s = 'F') OVER w = (s = 'F'))::INT, 0) AS goes_on FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY position))
SELECT doc_id, count(*) FILTER (goes_on = 0) AS n_tables, count(*) AS n_rows FROM p GROUP BY doc_id""",
)
def tables_merged(spark, folder):
    """A table an order, a page each; those of F have two columns, others one."""
    row = F.when(F.col("s") == "F", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    found = parts(spark, folder).select("doc_id", "position", F.col("position").alias("page_no"), F.array(row).alias("rows"))
    merged = layout_pages.merge_tables(found)
    return merged.groupBy("doc_id").agg(F.count("*").alias("n_tables"), F.sum(F.size("rows")).alias("n_rows"))


@query("recognition_confidence", "SELECT event_type, round(avg(abs(value)), 6) AS confidence FROM events GROUP BY 1")
def recognition_confidence(spark, folder):
    rows = table(spark, folder, "events").withColumnRenamed("value", "confidence")
    return layout_pages.recognition_confidence(rows, "event_type").select("event_type", F.round("confidence", 6).alias("confidence"))


@query(
    "recognition_realigned",
    """SELECT c.conv_id AS doc_id, c.turn AS page_no, CASE WHEN length(c.text) % 3 = 0 THEN '' ELSE c.text END AS text FROM conversations c""",
)
def recognition_realigned(spark, folder):
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return layout_pages.realigned(rows.select("doc_id", "page_no"), rows.filter("length(text) % 3 <> 0"))


@query(
    "last_page_with_word",
    "SELECT conv_id AS doc_id, max(turn) AS page_no, arg_max(text, turn) AS text FROM conversations WHERE regexp_matches(lower(text), 'the|references') GROUP BY 1",
)
def last_page_with_word(spark, folder):
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return layout_pages.last_page_with(rows, "the|references")


@query(
    "title_and_author",
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, E'\\n'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, coalesce(lines[1], 'Unknown') AS title, coalesce(lines[2], 'Unknown') AS author FROM l""",
)
def title_and_author(spark, folder):
    return table(spark, folder, "documents").select("doc_id", layout_pages.title_and_author(F.col("text")).alias("m")).select("doc_id", "m.*")
