"""The registered queries over the engine's tables, each over its whole table, with DuckDB SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import patterns, scripts, tables, urls
from quire.functions import text as T
from quire.operators import classify, duplicates, layout, logs, pages, rollups, trees
from quire.registry import query
from quire.sources import html, sinks
from quire.storage import materialise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


URL_PARTS = """u AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
         lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host,
         regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query
  FROM pages
)"""
NORMAL = """scheme || '://' || host || regexp_replace(path, '/+$', '')"""


@query(
    "url_normalize",
    f"""WITH {URL_PARTS}, q AS (
  SELECT *, list_filter(list_sort(string_split(query, '&')), lambda p: regexp_matches(p, '=.')) AS pairs FROM u
)
SELECT page_id, {NORMAL} || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS norm_url,
       {NORMAL} AS bare_url FROM q""",
)
def url_normalize(spark, folder):
    u = F.col("url")
    return table(spark, folder, "pages").select("page_id", urls.normalise(u).alias("norm_url"), urls.normalise(u, False).alias("bare_url"))


@query(
    "url_host_stats",
    f"WITH {URL_PARTS} SELECT host, count(*) AS n_pages, count(DISTINCT {NORMAL}) AS n_urls FROM u GROUP BY host",
)
def url_host_stats(spark, folder):
    rows = table(spark, folder, "pages").select(urls.host(F.col("url")).alias("host"), urls.normalise(F.col("url"), False).alias("u"))
    return rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.countDistinct("u").alias("n_urls"))


@query(
    "url_extension",
    f"WITH {URL_PARTS} SELECT lower(regexp_extract(path, '[^/.]+[.]([^./]+)$', 1)) AS extension, count(*) AS n FROM u GROUP BY 1",
)
def url_extension(spark, folder):
    return table(spark, folder, "pages").groupBy(urls.extension(F.col("url")).alias("extension")).agg(F.count("*").alias("n"))


@query(
    "url_lang_gate",
    "SELECT page_id, contains(lower(url), '/en/') OR contains(lower(url), 'lang=en') OR contains(lower(url), '/de/') OR contains(lower(url), 'lang=de') AS passes FROM pages",
)
def url_lang_gate(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.language_gate(F.col("url"), ("en", "de")).alias("passes"))


@query(
    "url_valid_link",
    f"""WITH {URL_PARTS} SELECT page_id FROM u WHERE scheme IN ('http', 'https') AND host <> ''
  AND (host = 'example.org' OR ends_with(host, '.example.org')) AND lower(regexp_extract(path, '[^/.]+[.]([^./]+)$', 1)) NOT IN ('pdf', 'zip')""",
)
def url_valid_link(spark, folder):
    ok = urls.valid_link(F.col("url"), ("example.org",), ("pdf", "zip"), strict=True)
    return table(spark, folder, "pages").filter(ok).select("page_id")


#: The expression of ``pages.links`` inside SQL quotes.
LINK_SQL = pages.LINK.replace("'", "''")
LINKS_SQL = f"""{URL_PARTS}, l AS (
  SELECT page_id, url, regexp_replace(unnest(regexp_extract_all(html, '{LINK_SQL}', 1)), '^["'']', '') AS link FROM pages
), links AS (
  SELECT l.page_id, l.url, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
    WHEN link = '' THEN regexp_replace(l.url, '#.*$', '')
    WHEN starts_with(link, '/') THEN regexp_extract(l.url, '^[^:/?#]+://[^/?#]*') || link END AS target
  FROM l
)"""


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, target, count(*) AS n FROM links GROUP BY page_id, target")
def page_links(spark, folder):
    return pages.links(table(spark, folder, "pages")).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(
    "page_link_counts",
    f"SELECT page_id, len(regexp_extract_all(html, '{LINK_SQL}', 1)) AS n_links FROM pages",
)
def page_link_counts(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(pages.LINK), 1)).cast("long").alias("n_links"))


@query(
    "link_graph_degree",
    f"""WITH {LINKS_SQL}, e AS (SELECT DISTINCT url AS source, target FROM links)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (
  SELECT source AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY node""",
)
def link_graph_degree(spark, folder):
    edges = pages.links(table(spark, folder, "pages")).select(F.col("url").alias("source"), "target").distinct()
    return pages.degrees(edges)


@query(
    "crawl_bfs_depth",
    """WITH RECURSIVE e AS (
  SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
), walk(node, depth) AS (
  SELECT DISTINCT source, 0 FROM e WHERE starts_with(source, 'c')
  UNION SELECT e.target, depth + 1 FROM walk JOIN e ON walk.node = e.source WHERE depth < 3
)
SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node""",
)
def crawl_bfs_depth(spark, folder):
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    edges = c.select(named("c", "c_custkey").alias("source"), named("n", "c_nationkey").alias("target"))
    edges = edges.unionAll(n.select(named("n", "n_nationkey"), named("r", "n_regionkey")))
    edges = edges.unionAll(n.select(named("r", "n_regionkey"), named("n", "n_nationkey")))
    return pages.crawl(edges, edges.filter(F.col("source").startswith("c")).select(F.col("source").alias("node")))


@query(
    "page_title_h1",
    "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages",
)
def page_title_h1(spark, folder):
    take = lambda tag: F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1)
    return table(spark, folder, "pages").select("page_id", take("title").alias("title"), take("h1").alias("h1"))


VISIBLE_SQL = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query("page_visible_text_len", f"SELECT page_id, length({VISIBLE_SQL}) AS n FROM pages WHERE length({VISIBLE_SQL}) >= 30")
def page_visible_text_len(spark, folder):
    n = F.length(pages.visible(F.col("html"))).cast("long")
    return table(spark, folder, "pages").select("page_id", n.alias("n")).filter("n >= 30")


def _content_sql() -> str:
    scores = []
    for name, words in pages.KEYWORDS.items():
        terms = " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words)
        scores.append(f"({terms} + CASE WHEN boosted = '{name}' THEN 10 ELSE 0 END) AS {name}")
    ranked = ", ".join(f"{{'s': {n}, 'k': {-k}, 'n': '{n}'}}" for k, n in enumerate(pages.KEYWORDS))
    return f"""WITH v AS (SELECT page_id, lower({VISIBLE_SQL}) AS t, lower(url) AS u FROM pages),
b AS (SELECT *, CASE WHEN contains(u, '/blog/') OR contains(u, '/article/') THEN 'blog' WHEN contains(u, '/product/') OR contains(u, '/item/') THEN 'product' WHEN contains(u, '/news/') THEN 'news' ELSE '' END AS boosted FROM v),
s AS (SELECT page_id, {", ".join(scores)} FROM b),
m AS (SELECT page_id, list_max([{ranked}]) AS best FROM s)
SELECT page_id, CASE WHEN best.s > 0 THEN best.n ELSE 'unknown' END AS content_type FROM m"""


@query("page_content_type", _content_sql())
def page_content_type(spark, folder):
    kind = pages.content_type(pages.visible(F.col("html")), F.col("url"))
    return table(spark, folder, "pages").select("page_id", kind.alias("content_type"))


@query("html_elements")
def html_elements(spark, folder):
    return html.read(table(spark, folder, "pages")).select("doc_id", "position", "kind", "text", "target")


@query("html_outline")
def html_outline(spark, folder):
    return sinks.outline(html.read(table(spark, folder, "pages")))


@query("html_document_tree")
def html_document_tree(spark, folder):
    return sinks.tree(rollups.carry_headings(html.read(table(spark, folder, "pages"))))


@query("html_counts")
def html_counts(spark, folder):
    return rollups.counts(rollups.carry_headings(html.read(table(spark, folder, "pages"))))


@query(
    "hyperlink_patterns",
    """SELECT page_id, regexp_extract(url, '(https?://[^\\s]+)', 1) AS url, regexp_extract(url, 'https?://([^/]+)', 1) AS domain,
  regexp_extract(url, '\\.([a-zA-Z0-9]+)$', 1) AS file_type, regexp_extract(url, '>(.*?)<', 1) AS anchor FROM pages""",
)
def hyperlink_patterns(spark, folder):
    return table(spark, folder, "pages").select("page_id", *patterns.extract(F.col("url"), patterns.LINKS))


@query(
    "pii_patterns",
    "SELECT doc_id, "
    + ", ".join(f"regexp_extract(text, '{p}', {g}) AS {n}" for n, (p, g) in patterns.PERSONAL.items())
    + " FROM documents",
)
def pii_patterns(spark, folder):
    return table(spark, folder, "documents").select("doc_id", *patterns.extract(F.col("text"), patterns.PERSONAL))


WORDS_SQL = "len(regexp_extract_all(text, '\\S+'))"
SENTENCES_SQL = "greatest(len(regexp_extract_all(text, '[.!?]+(\\s|$)')), 1)"


@query(
    "doc_word_char_line_counts",
    f"""SELECT doc_id, {WORDS_SQL}::BIGINT AS n_words, length(text)::BIGINT AS n_characters,
  len(string_split(text, chr(10)))::BIGINT AS n_lines, {SENTENCES_SQL}::BIGINT AS n_sentences FROM documents""",
)
def doc_counts(spark, folder):
    x = F.col("text")
    n = {"n_words": T.word_count(x), "n_characters": F.length(x), "n_lines": T.line_count(x), "n_sentences": T.sentence_count(x)}
    return table(spark, folder, "documents").select("doc_id", *[c.cast("long").alias(k) for k, c in n.items()])


@query("doc_readability", f"SELECT doc_id, round({WORDS_SQL} / {SENTENCES_SQL}, 6) AS readability FROM documents")
def doc_readability(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.round(T.readability(F.col("text")), 6).alias("readability"))


ASCII_SQL = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"


def _text_query(name: str, column, sql: str | None) -> None:
    """A query of a text function: digest and length of its result."""

    def run(spark, folder):
        x = column(F.col("text"))
        rows = table(spark, folder, "documents").select("doc_id", x.alias("t"))
        return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))

    query(name, sql and f"SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM (SELECT doc_id, {sql} AS t FROM documents)")(run)


_text_query("text_clean_ascii", lambda x: T.strip_non_ascii(x), ASCII_SQL)
_text_query("text_collapse_ws", lambda x: T.collapse_space(x), "trim(regexp_replace(text, '\\s+', ' ', 'g'))")
_text_query("strip_cid", lambda x: T.strip_cid(x), "regexp_replace(text, '\\(cid:\\d+\\)', '', 'g')")
_text_query(
    "short_word_runs",
    lambda x: T.drop_short_runs(T.strip_non_ascii(x)),
    f"regexp_replace({ASCII_SQL}, '\\b\\w{{1,3}}\\s+\\w{{1,3}}\\s+\\w{{1,3}}\\b', '', 'g')",
)
_text_query("allowed_characters", lambda x: T.allowed_characters(T.strip_non_ascii(x)), f"regexp_replace({ASCII_SQL}, '[^\\w\\s.,!?]', '', 'g')")
_text_query(
    "replace_ligatures",
    lambda x: T.replace_ligatures(x),
    "replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl')",
)
_text_query(
    "clean_for_detection",
    lambda x: T.strip_non_ascii(scripts.clean_for_detection(x)),
    None,
)
_text_query("text_collapse_repeats", lambda x: T.collapse_repeats(x), None)
_text_query("ocr_number_fix", lambda x: T.guard_numbers(T.correct_numbers(x)), None)
_text_query("nfkc_normalize", lambda x: T.nfkc(x), None)
_text_query("clean_chain", lambda x: T.clean(x), None)
_text_query(
    "drop_header_lines",
    lambda x: T.drop_header_lines(x),
    "array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '(?i)^(Page\\s+\\d+|Confidential|[A-Z]{2,}\\s+\\d+$)')), chr(10))",
)


def _class_sql(ranges) -> str:
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges) + "]"


HISTOGRAM_SQL = ", ".join(f"length(text) - length(regexp_replace(text, '{_class_sql(r)}', '', 'g')) AS {s}" for s, r in scripts.RANGES.items())
RANKED_SQL = ", ".join(f"{{'s': {s}, 'k': {-k}, 'n': '{s}'}}" for k, s in enumerate(scripts.RANGES))
SCRIPT_SQL = f"""h AS (SELECT *, {HISTOGRAM_SQL} FROM documents),
b AS (SELECT *, list_max([{RANKED_SQL}]) AS best FROM h), s AS (SELECT *, CASE WHEN best.s > 0 THEN best.n ELSE 'unknown' END AS script FROM b)"""


@query("script_histogram", f"SELECT doc_id, {HISTOGRAM_SQL} FROM documents")
def script_histogram(spark, folder):
    return table(spark, folder, "documents").select("doc_id", *[c.cast("long").alias(s) for c, s in zip(scripts.histogram(F.col("text")), scripts.RANGES)])


@query(
    "doc_script",
    f"""WITH {SCRIPT_SQL} SELECT doc_id, script, CASE WHEN script IN ('arabic', 'hebrew') THEN 'rtl' ELSE 'ltr' END AS direction,
  CASE WHEN length(trim(text)) < 10 THEN 'en' ELSE coalesce(map {{'arabic': 'ar', 'cjk': 'zh', 'devanagari': 'hi', 'telugu': 'te', 'latin': 'en'}}[script], 'en') END AS language,
  CASE WHEN length(trim(text)) >= 10 AND script IN ('arabic', 'cjk', 'devanagari', 'telugu', 'latin') THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM s""",
)
def doc_script(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text", scripts.script(F.col("text")).alias("script"))
    lang, sure = scripts.language_of(F.col("script"), F.col("text"))
    return rows.select("doc_id", "script", scripts.direction(F.col("script")).alias("direction"), lang.alias("language"), sure.alias("confidence"))


@query("lang_distribution", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def lang_distribution(spark, folder):
    return table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "primary_language",
    """WITH t AS (SELECT source, lang, count(*) AS texts, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source, lang)
SELECT source, lang, texts, chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chars DESC, lang) AS n FROM t) WHERE n = 1""",
)
def primary_language(spark, folder):
    rows = table(spark, folder, "documents").select("source", "lang", F.length("text").alias("size"))
    return rollups.primary_language(rows, "source", "lang", "size")


@query("exact_dup_groups", "SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, folder):
    return duplicates.exact_groups(table(spark, folder, "documents"), "doc_id", "text")


@query("dedup_keep_first", "SELECT md5(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_keep_first(spark, folder):
    return duplicates.keep_first_exact(table(spark, folder, "documents"), "doc_id", "text")


@query("simhash_keep_first")
def simhash_keep_first(spark, folder):
    rows = table(spark, folder, "pages").select("page_id", pages.visible(F.col("html")).alias("text"))
    return duplicates.keep_first_near(rows, "page_id", "text")


READ_SQL = f"SELECT source, lang, avg({WORDS_SQL} / {SENTENCES_SQL}) AS m FROM documents GROUP BY source, lang"


@query("rollup_chapters", f"SELECT source, round(avg(m), 6) AS mean, count(*) AS n FROM ({READ_SQL}) GROUP BY source")
def rollup_chapters(spark, folder):
    found = rollups.mean_of_means(table(spark, folder, "documents"), ["source", "lang"], T.readability(F.col("text")))
    return found.select("source", F.round("mean", 6).alias("mean"), "n")


@query(
    "rollup_mean_of_means",
    f"SELECT round(avg(mean), 6) AS mean, count(*) AS n FROM (SELECT source, avg(m) AS mean FROM ({READ_SQL}) GROUP BY source)",
)
def rollup_mean_of_means(spark, folder):
    found = rollups.mean_of_means(table(spark, folder, "documents"), ["source", "lang"], T.readability(F.col("text")))
    return rollups.whole_mean(found).select(F.round("mean", 6).alias("mean"), "n")


KEPT_SQL = "list_filter(string_split(text, chr(10)), lambda l: length(l) > 10 AND length(regexp_replace(l, '[^A-Za-z0-9_]', '', 'g')) >= 0.3 * length(l))"


@query("noise_line_filter", f"SELECT doc_id, len({KEPT_SQL}) AS n_kept, md5(array_to_string({KEPT_SQL}, chr(10))) AS digest FROM documents")
def noise_line_filter(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", T.kept_lines(F.col("text")).alias("kept"))
    return rows.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.md5(F.array_join("kept", "\n").cast("binary")).alias("digest"))


@query(
    "repeated_lines",
    """WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source),
f AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l GROUP BY source, line HAVING count(DISTINCT doc_id) >= 2)
SELECT source, line, n FROM f JOIN p USING (source) WHERE n >= floor(pages * 0.02)""",
)
def repeated_lines(spark, folder):
    rows = table(spark, folder, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return layout.repeated_lines(rows, "source", "doc_id", "line", 0.02)


@query(
    "paragraph_split_offsets",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents)
SELECT doc_id, position::INTEGER AS position, s::BIGINT AS start, (s + length(line))::BIGINT AS "end" FROM (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)""",
)
def paragraph_split_offsets(spark, folder):
    return classify.offsets(table(spark, folder, "documents"), "doc_id", "text")


@query(
    "classify_doc_heuristic",
    f"""SELECT doc_id, {WORDS_SQL}::BIGINT AS word_count, contains(lower(text), 'references') AS has_references, contains(lower(text), 'abstract') AS has_abstract,
  contains(lower(text), 'introduction') AS has_introduction, CASE WHEN {WORDS_SQL} > 3000 AND contains(lower(text), 'references') THEN 'report' ELSE 'generic' END AS kind FROM documents""",
)
def classify_doc_heuristic(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", *classify.features(F.col("text")))
    kind = classify.kind(*[F.col(c) for c in ("word_count", "has_references", "column_count", "has_abstract", "has_introduction")])
    return rows.select("doc_id", F.col("word_count").cast("long").alias("word_count"), "has_references", "has_abstract", "has_introduction", kind.alias("kind"))


@query(
    "structural_segments",
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM documents)
SELECT doc_id, (len(parts) + len(list_filter(parts, lambda p: regexp_matches(p, '^(?s:.+?)\\b(?:{"|".join(classify.CUES)})\\b'))))::BIGINT AS n_segments FROM p""",
)
def structural_segments(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(classify.segments(F.col("text"))).cast("long").alias("n_segments"))


@query(
    "clause_split",
    "SELECT doc_id, len(list_filter(string_split(text, '.'), lambda c: length(trim(c)) > 10)) AS n_clauses FROM documents",
)
def clause_split(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(T.clauses(F.col("text"))).cast("long").alias("n_clauses"))


@query("ml_quality")
def ml_quality(spark, folder):
    """Trained on the labelled documents (the classifier's sample: 20,000 at most), applied to all."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("label")).na.drop()
    known = materialise(classify.sample(docs, labels, "doc_id", 20_000), "labelled")
    found = classify.train(known).transform(docs)
    return found.select("doc_id", F.col("prediction").cast("int").alias("quality"))


@query(
    "infer_column_types",
    """SELECT 'o_orderstatus' AS name, 'text' AS type UNION ALL SELECT 'o_totalprice', 'numeric' UNION ALL SELECT 'o_orderdate', 'date' UNION ALL SELECT 'o_orderkey', 'numeric'""",
)
def infer_column_types(spark, folder):
    names = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    rows = table(spark, folder, "orders").select(F.posexplode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("string") for n in names]))).alias("at", "name", "cell"), "o_orderkey")
    first = rows.filter("cell is not null").groupBy("name").agg(F.min_by("cell", "o_orderkey").alias("cell"))
    return first.select("name", T.infer_type(F.col("cell")).alias("type"))


@query(
    "table_csv",
    "SELECT r_regionkey, r_regionkey::VARCHAR || ',' || string_agg(n_name, ',' ORDER BY n_nationkey) AS line FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey",
)
def table_csv(spark, folder):
    names = rollups.ordered(table(spark, folder, "nation"), ["n_regionkey"], "n_nationkey", "n_name", "names")
    rows = names.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.concat(F.array(F.col("r_regionkey").cast("string")), F.col("names"))
    return rows.select("r_regionkey", F.regexp_replace(tables.csv(F.array().cast("array<string>"), F.array(cells)), "\\r\\n", "").alias("line"))


@query(
    "table_records",
    """SELECT n_regionkey, n_nationkey, n_name AS name FROM nation""",
)
def table_records(spark, folder):
    rows = table(spark, folder, "nation").select("n_regionkey", "n_nationkey", F.array(F.array("n_name")).alias("rows"))
    found = rows.select("n_regionkey", "n_nationkey", F.explode(tables.records(F.array(F.lit("name")), F.col("rows"))).alias("r"))
    return found.select("n_regionkey", "n_nationkey", F.col("r")["name"].alias("name"))


@query(
    "crawl_statistics",
    "SELECT count(*) AS visited, count(*) FILTER (event_type = 'error') AS failed, round((count(*) - count(*) FILTER (event_type = 'error')) / greatest(count(*), 1) * 100, 6) AS success_rate FROM events",
)
def crawl_statistics(spark, folder):
    found = pages.statistics(table(spark, folder, "events"), F.col("event_type") == "error")
    return found.withColumn("success_rate", F.round("success_rate", 6))


@query("content_type_distribution", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def content_type_distribution(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))


@query(
    "failed_latest",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n = 1",
)
def failed_latest(spark, folder):
    errors = table(spark, folder, "events").filter("event_type = 'error'")
    return logs.latest(errors, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


RUNS_SQL = """b AS (SELECT *, (event_type = 'error')::INT AS bad FROM events),
r AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b), f AS (SELECT * FROM r WHERE bad = 1)"""


@query("failure_runs", f"WITH {RUNS_SQL} SELECT user_id, run::BIGINT AS run, count(*) AS n FROM f GROUP BY user_id, run")
def failure_runs(spark, folder):
    return logs.failure_runs(table(spark, folder, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "run", "n")


@query(
    "breaker_open_intervals",
    f"""WITH {RUNS_SQL} SELECT user_id, epoch_us(ts) AS opened, epoch_us(ts + INTERVAL 60 SECONDS) AS half_open FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM f) WHERE n = 3""",
)
def breaker_open_intervals(spark, folder):
    found = logs.breaker_intervals(table(spark, folder, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", 3)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return found.select("user_id", micros("opened"), micros("half_open"))


@query(
    "retry_schedule",
    "SELECT event_id, attempt::INTEGER AS attempt, least(1.0 * pow(2, attempt) + value / 1000, 60.0) AS delay FROM events, (SELECT unnest(range(3)) AS attempt) WHERE event_type = 'error'",
)
def retry_schedule(spark, folder):
    errors = table(spark, folder, "events").filter("event_type = 'error'")
    return logs.retries(errors, F.col("value") / 1000).select("event_id", "attempt", "delay")


@query(
    "sessions",
    """WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES, true)::INT AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(spark, folder):
    found = logs.sessions(table(spark, folder, "events"), "user_id", "ts")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return found.select("user_id", micros("start"), micros("end"), "n")


@query(
    "thread_stats",
    'SELECT conv_id, count(*) AS replies, count(DISTINCT role) AS authors, max(turn) AS last_activity, count(*) > 2 AS is_discussion FROM conversations GROUP BY conv_id',
)
def thread_stats(spark, folder):
    return logs.threads(table(spark, folder, "conversations"), "conv_id", "role", "turn")


@query(
    "conversation_text",
    "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id",
)
def conversation_text(spark, folder):
    rows = table(spark, folder, "conversations").withColumnsRenamed({"turn": "position"})
    return rollups.to_text(rows, "conv_id").select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "glossary_lookup",
    "SELECT c_custkey, n_name AS definition FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3",
)
def glossary_lookup(spark, folder):
    terms = table(spark, folder, "nation").filter("n_regionkey < 3")
    rows = table(spark, folder, "customer").join(terms, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", F.col("n_name").alias("definition"))


@query(
    "tree_flatten",
    """SELECT event_id AS doc_id, '' AS path, 'object' AS type, NULL AS value FROM events WHERE props IS NOT NULL
UNION ALL SELECT event_id, 'k', 'number', json_extract_string(props, '$.k') FROM events WHERE props IS NOT NULL""",
)
def tree_flatten(spark, folder):
    return trees.flatten(table(spark, folder, "events"), "event_id", "props").select("doc_id", "path", "type", "value")


@query(
    "tree_diff",
    """SELECT a.event_id AS doc_id, 'k' AS path, 'value_mismatch' AS kind, json_extract_string(a.props, '$.k') AS left_value, json_extract_string(b.props, '$.k') AS right_value
FROM events a JOIN events b ON a.event_id + 1 = b.event_id WHERE json_extract_string(a.props, '$.k') <> json_extract_string(b.props, '$.k')
UNION ALL SELECT e, path, 'missing_key', l, r FROM (
  SELECT max(event_id) AS e, 'k' AS path, max_by(json_extract_string(props, '$.k'), event_id) AS l, NULL AS r FROM events
  UNION ALL SELECT max(event_id), '', NULL, NULL FROM events
  UNION ALL SELECT -1, 'k', NULL, min_by(json_extract_string(props, '$.k'), event_id) FROM events
  UNION ALL SELECT -1, '', NULL, NULL)""",
)
def tree_diff(spark, folder):
    events = table(spark, folder, "events")
    left = trees.flatten(events, "event_id", "props")
    right = trees.flatten(events.withColumn("event_id", F.col("event_id") - 1), "event_id", "props")
    return trees.differences(left, right)


@query(
    "density_grid",
    "SELECT floor(l_quantity / 10)::BIGINT AS x, floor(l_extendedprice / 10000)::BIGINT AS y, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def density_grid(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.groupBy(F.floor(F.col("l_quantity") / 10).alias("x"), F.floor(F.col("l_extendedprice") / 10000).alias("y")).agg(F.count("*").alias("n"))
