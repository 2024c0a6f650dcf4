"""Registered queries over texts, tables and logs: sentiment, keywords, labels, languages, serialisers, repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import lexicon, patterns, scripts, tables
from quire.operators import logs, pages
from quire.plans.queries import SCRIPT_SQL, table
from quire.registry import query


def words_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


WORDS = "string_split_regex(lower({x}), '[^a-z]+')"
POLARITY_SQL = """CASE WHEN {x} IS NULL THEN NULL WHEN g + b = 0 THEN 0.0 ELSE (g - b)::DOUBLE / (g + b) END"""
PARAGRAPHS_SQL = f"""p AS (
  SELECT doc_id, source, unnest(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda p: trim(p, E' \\t\\n\\r') <> '')) AS para FROM documents
), c AS (
  SELECT doc_id, source, len(list_filter({WORDS.format(x='para')}, lambda w: list_contains({words_sql(lexicon.POSITIVE)}, w))) AS g,
         len(list_filter({WORDS.format(x='para')}, lambda w: list_contains({words_sql(lexicon.NEGATIVE)}, w))) AS b FROM p
), m AS (
  SELECT doc_id, avg(CASE WHEN g + b = 0 THEN 0.0 ELSE (g - b)::DOUBLE / (g + b) END) AS mean FROM c GROUP BY doc_id
), d AS (SELECT doc_id, source, coalesce(mean, 0.0) AS mean FROM documents LEFT JOIN m USING (doc_id))"""


@query("document_sentiment", f"WITH {PARAGRAPHS_SQL} SELECT doc_id, round(mean, 6) AS sentiment FROM d")
def document_sentiment(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.round(lexicon.mean_polarity(F.col("text")), 6).alias("sentiment"))


@query("sentiment_rollup", f"WITH {PARAGRAPHS_SQL} SELECT source, count(*) AS n, round(avg(mean), 6) AS sentiment FROM d GROUP BY source")
def sentiment_rollup(spark, folder):
    """Mean over the documents of a source of their mean over paragraphs: unweighted, empty documents count as 0."""
    docs = table(spark, folder, "documents").select("source", lexicon.mean_polarity(F.col("text")).alias("mean"))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("mean"), 6).alias("sentiment"))


@query(
    "keywords",
    f"""WITH w AS (SELECT conv_id, unnest({WORDS.format(x='text')}) AS word FROM conversations),
n AS (SELECT conv_id, word, count(*) AS n FROM w WHERE length(word) >= 3 AND NOT list_contains({words_sql(lexicon.STOP_WORDS)}, word) GROUP BY ALL)
SELECT conv_id, rank::INTEGER AS rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 5""",
)
def keywords(spark, folder):
    return lexicon.keywords(table(spark, folder, "conversations"), "conv_id", "text")


LABEL_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(clause), '{p}') THEN '{n}'" for n, p in lexicon.CLAUSES.items()) + " ELSE 'other' END"
HITS_SQL = " + ".join(f"regexp_matches(lower(clause), '{p}')::INT" for p in lexicon.CLAUSES.values())


@query(
    "clause_labels",
    f"""WITH c AS (SELECT unnest(list_filter(string_split(text, '.'), lambda c: length(trim(c)) > 10)) AS clause FROM documents)
SELECT {LABEL_SQL} AS label, round(CASE WHEN {HITS_SQL} > 0 THEN 1.0 / ({HITS_SQL}) ELSE 0.0 END, 6) AS score, count(*) AS n FROM c GROUP BY ALL""",
)
def clause_labels(spark, folder):
    clauses = F.filter(F.split("text", "\\."), lambda c: F.length(F.trim(c)) > 10)
    rows = table(spark, folder, "documents").select(F.explode(clauses).alias("clause"))
    c = F.col("clause")
    return rows.groupBy(lexicon.clause_label(c).alias("label"), F.round(lexicon.clause_score(c), 6).alias("score")).agg(F.count("*").alias("n"))


ENTITY_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS type, unnest(regexp_extract_all(text, '{p}')) AS entity FROM documents" for n, p in lexicon.ENTITIES.items()
)


@query("legal_entities", f"SELECT doc_id, type, entity, count(*) AS n FROM ({ENTITY_SQL}) GROUP BY ALL")
def legal_entities(spark, folder):
    found = lexicon.entities(table(spark, folder, "documents"), "doc_id", "text")
    return found.groupBy("doc_id", "type", "entity").agg(F.count("*").alias("n"))


@query(
    "legal_entity_spans",
    " UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS type, regexp_extract(text, '{p}') AS entity FROM documents WHERE regexp_matches(text, '{p}')" for n, p in lexicon.ENTITIES.items()
    ),
)
def legal_entity_spans(spark, folder):
    found = lexicon.entity_spans(table(spark, folder, "documents"), "doc_id", "text")
    return found.filter(F.col("end") == F.col("start") + F.length("entity")).select("doc_id", "type", "entity")


@query("video_patterns", "SELECT conv_id, turn, " + ", ".join(f"regexp_extract(text, '{p}', {g}) AS {n}" for n, (p, g) in patterns.VIDEO.items()) + " FROM conversations")
def video_patterns(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", *patterns.extract(F.col("text"), patterns.VIDEO))


@query(
    "language_segments",
    f"""WITH {SCRIPT_SQL} SELECT lang, CASE WHEN script IN ('arabic', 'hebrew') THEN 'rtl' ELSE 'ltr' END AS direction,
  count(*) AS text_count, sum(length(text))::BIGINT AS total_chars FROM s WHERE length(trim(text)) > 20 GROUP BY ALL""",
)
def language_segments(spark, folder):
    """Texts of more than 20 characters by language and direction."""
    docs = table(spark, folder, "documents").filter(F.length(F.trim("text")) > 20)
    rows = docs.select("lang", F.length("text").alias("size"), scripts.process(F.col("text"))["direction"].alias("direction"))
    return rows.groupBy("lang", "direction").agg(F.count("*").alias("text_count"), F.sum("size").alias("total_chars"))


@query(
    "language_allowed",
    f"""WITH t AS (SELECT doc_id, substr(text, 1, 1000) AS text FROM documents), {SCRIPT_SQL.replace('FROM documents', 'FROM t')}
SELECT doc_id FROM s WHERE CASE WHEN length(trim(text)) < 10 THEN 'en' ELSE coalesce(map {{'arabic': 'ar', 'cjk': 'zh', 'devanagari': 'hi', 'telugu': 'te', 'latin': 'en'}}[script], 'en') END IN ('en', 'ar')""",
)
def language_allowed(spark, folder):
    return table(spark, folder, "documents").filter(scripts.allowed(F.col("text"), ["en", "ar"])).select("doc_id")


@query(
    "glossary_stats",
    "SELECT n_regionkey, count(*) AS entry_count, string_agg(n_name, ',' ORDER BY n_name) AS terms, sum(length(n_name))::BIGINT AS total_length FROM nation GROUP BY 1",
)
def glossary_stats(spark, folder):
    rows = table(spark, folder, "nation")
    terms = F.array_join(F.array_sort(F.collect_list("n_name")), ",")
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("entry_count"), terms.alias("terms"), F.sum(F.length("n_name")).alias("total_length"))


@query(
    "glossary_of_conversations",
    """WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM conversations)
SELECT conv_id, turn, term, count(*) AS n, any_value('nation ' || n_nationkey) AS definition FROM w JOIN nation ON term = lower(n_name) GROUP BY conv_id, turn, term""",
)
def glossary_of_conversations(spark, folder):
    words = table(spark, folder, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term"))
    counts = words.groupBy("conv_id", "turn", "term").agg(F.count("*").alias("n"))
    entries = table(spark, folder, "nation").select(F.lower("n_name").alias("term"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("definition"))
    return counts.join(entries, "term").select("conv_id", "turn", "term", "n", "definition")


@query(
    "table_json",
    """SELECT o_custkey, to_json({'headers': ['order', 'status'], 'rows': list([o_orderkey::VARCHAR, o_orderstatus] ORDER BY o_orderkey)})::VARCHAR AS json
FROM orders GROUP BY o_custkey""",
)
def table_json(spark, folder):
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("r"))
    cells = F.transform("r", lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderstatus"]))
    return rows.select("o_custkey", tables.json(F.array(F.lit("order"), F.lit("status")), cells).alias("json"))


@query("table_round_trip", "SELECT o_custkey, count(*) AS n_rows, true AS equal FROM orders GROUP BY o_custkey")
def table_round_trip(spark, folder):
    """A table written as JSON and read again is the same."""
    rows = table_json(spark, folder).select("o_custkey", "json", tables.from_json(F.col("json")).alias("t"))
    again = tables.json(F.col("t.headers"), F.col("t.rows"))
    return rows.select("o_custkey", F.size("t.rows").cast("long").alias("n_rows"), (again == F.col("json")).alias("equal"))


@query(
    "table_sheet",
    "SELECT o_custkey, 'orders' AS sheet, count(*) + 1 AS n_rows, 2::INTEGER AS width FROM orders GROUP BY o_custkey",
)
def table_sheet(spark, folder):
    rows = table_json(spark, folder).select("o_custkey", tables.from_json(F.col("json")).alias("t"))
    rows = rows.select("o_custkey", tables.sheet(F.col("t.headers"), F.col("t.rows"), F.lit("orders")).alias("s"))
    return rows.select("o_custkey", "s.sheet", F.size("s.cells").cast("long").alias("n_rows"), F.size(F.get("s.cells", F.lit(0))).alias("width"))


@query(
    "dictionary_repair",
    """WITH w AS (SELECT DISTINCT replace(n_name, 'A', 'E') AS word FROM nation), d AS (SELECT n_name AS term, n_nationkey AS n FROM nation),
p AS (SELECT word, term, n, levenshtein(word, term) AS edits FROM w, d WHERE levenshtein(word, term) <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY edits, n DESC, term) AS k FROM p)
SELECT w.word, coalesce(b.term, w.word) AS repaired FROM w LEFT JOIN b ON b.word = w.word AND b.k = 1""",
)
def dictionary_repair(spark, folder):
    nations = table(spark, folder, "nation")
    words = nations.select(F.replace("n_name", F.lit("A"), F.lit("E")).alias("word"))
    return lexicon.repair(words, nations.select(F.col("n_name").alias("term"), F.col("n_nationkey").alias("n")))


@query(
    "annotation_age",
    "SELECT event_id, date_diff('day', ts::DATE, DATE '2024-06-30')::INTEGER AS age_days, date_diff('day', ts::DATE, DATE '2024-06-30') < 7 AS is_recent FROM events",
)
def annotation_age(spark, folder):
    age = F.datediff(F.lit("2024-06-30").cast("date"), F.col("ts").cast("date"))
    return table(spark, folder, "events").select("event_id", age.alias("age_days"), (age < 7).alias("is_recent"))


@query(
    "interactive_complexity",
    """SELECT page_id, n, CASE WHEN n <= 2 THEN 'low' WHEN n <= 5 THEN 'medium' ELSE 'high' END AS complexity FROM (
  SELECT page_id, len(regexp_extract_all(html, '(?i)<(input|button|select|textarea|form|a)[ >]')) AS n FROM pages)""",
)
def interactive_complexity(spark, folder):
    n = F.size(F.regexp_extract_all("html", F.lit("(?i)<(input|button|select|textarea|form|a)[ >]"), 1)).cast("long")
    level = F.when(F.col("n") <= 2, "low").when(F.col("n") <= 5, "medium").otherwise("high")
    return table(spark, folder, "pages").select("page_id", n.alias("n")).select("page_id", "n", level.alias("complexity"))


PROFILES = (("government", "[.]gov|[.]org/tax"), ("news", "news|article"), ("docs", "/docs?/|/en/"), ("shop", "shop|product"))


@query(
    "domain_profile",
    "SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{n}'" for n, p in PROFILES) + " ELSE 'general' END AS profile FROM pages",
)
def domain_profile(spark, folder):
    profile = F.lit("general")
    for name, pattern in reversed(PROFILES):
        profile = F.when(F.lower("url").rlike(pattern), name).otherwise(profile)
    return table(spark, folder, "pages").select("page_id", profile.alias("profile"))


@query(
    "element_references",
    "SELECT o_orderkey, o_custkey, c_custkey IS NOT NULL AS valid FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0",
)
def element_references(spark, folder):
    """References by id, those to a missing element marked."""
    known = table(spark, folder, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("valid"))
    orders = table(spark, folder, "orders").join(known, "o_custkey", "left")
    return orders.select("o_orderkey", "o_custkey", F.coalesce("valid", F.lit(False)).alias("valid"))


BREAKER_SQL = """WITH RECURSIVE e AS (
  SELECT user_id, epoch_us(ts) AS at, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), s AS (
  SELECT user_id, 0::BIGINT AS i, 0 AS failures, NULL::BIGINT AS until, NULL::BIGINT AS opened FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT e.user_id, e.i,
    CASE WHEN s.until IS NOT NULL AND e.at < s.until THEN s.failures WHEN NOT e.bad THEN 0 WHEN s.until IS NOT NULL OR s.failures + 1 >= 3 THEN 0 ELSE s.failures + 1 END,
    CASE WHEN s.until IS NOT NULL AND e.at < s.until THEN s.until WHEN e.bad AND (s.until IS NOT NULL OR s.failures + 1 >= 3) THEN e.at + 60000000 END,
    CASE WHEN (s.until IS NULL OR e.at >= s.until) AND e.bad AND (s.until IS NOT NULL OR s.failures + 1 >= 3) THEN e.at END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1
) SELECT user_id::VARCHAR AS key, opened, opened + 60000000 AS half_open FROM s WHERE opened IS NOT NULL"""


@query("breaker_openings", BREAKER_SQL)
def breaker_openings(spark, folder):
    return logs.breaker_openings(table(spark, folder, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", 3)


@query("crawl_of_pages")
def crawl_of_pages(spark, folder):
    """Depths of the pages reached from every hundredth page over the links of all pages."""
    rows = table(spark, folder, "pages")
    edges = pages.links(rows).select(F.col("url").alias("source"), "target").distinct()
    seeds = rows.filter("page_id % 100 = 0").select(F.col("url").alias("node"))
    return pages.crawl(edges, seeds, 2)
