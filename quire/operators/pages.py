"""Web pages: links, link graph, depth-limited crawl over stored pages, content types, crawl statistics, visited filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import urls
from quire.storage import materialise

KEYWORDS = {
    "article": ("article", "post", "content", "main"),
    "product": ("product", "item", "price", "buy", "cart"),
    "news": ("news", "breaking", "headline", "reporter"),
    "blog": ("blog", "author", "comment", "tag"),
    "forum": ("forum", "thread", "reply", "member"),
    "documentation": ("docs", "api", "reference", "guide"),
}
BOOSTS = (("blog", ("/blog/", "/article/")), ("product", ("/product/", "/item/")), ("news", ("/news/",)))
#: The value of a link's href: in double or single quotes, or bare; up to its fragment.
LINK = "(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*(\"[^\"#]*|'[^'#]*|[^\\s>\"'#]+)"


def visible(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; white space collapsed."""
    for p in ("(?is)<script\\b.*?</script>", "(?is)<style\\b.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        html = F.regexp_replace(html, p, " ")
    return F.trim(F.regexp_replace(html, "\\s+", " "))


def link_values(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), lambda v: F.regexp_replace(v, "^[\"']", ""))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, target): one row a link, resolved against the page's URL, fragments cut."""
    found = pages.select("page_id", "url", F.explode(link_values(F.col("html"))).alias("link"))
    return found.select("page_id", "url", urls.resolve(F.col("url"), F.col("link")).alias("target"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) over ``edges`` (source, target), counted in one pass and one shuffle."""
    both = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(
        edges.select("target", F.lit(0), F.lit(1))
    )
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def crawl(edges: DataFrame, seeds: DataFrame, most_depth: int = 3) -> DataFrame:
    """(node, depth): what is reached from ``seeds`` (node) over ``edges`` (source, target), breadth first.

    Each level is joined to the edges, visited nodes are anti-joined away, and the level is written to the shared folder.
    """
    level = materialise(seeds.select("node", F.lit(0).alias("depth")).distinct(), "crawl")
    seen = level
    for depth in range(1, most_depth + 1):
        reached = level.join(edges, level.node == edges.source).select(F.col("target").alias("node")).distinct()
        level = materialise(reached.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")), "crawl")
        if level.isEmpty():
            break
        seen = seen.unionAll(level)
    return seen


def content_type(text: Column, url: Column) -> Column:
    """The class with most keyword occurrences; URL patterns add ten; the earlier of equals, ``unknown`` without any."""
    lower, address = F.lower(text), F.lower(url)
    boosted = F.lit("")
    for name, parts in reversed(BOOSTS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | address.contains(p)
        boosted = F.when(hit, name).otherwise(boosted)
    ranked = []
    for k, (name, found) in enumerate(KEYWORDS.items()):
        score = sum(((F.length(lower) - F.length(F.replace(lower, F.lit(w), F.lit("")))) / len(w) for w in found), F.lit(0))
        score = score.cast("int") + F.when(boosted == name, 10).otherwise(0)
        ranked.append(F.struct(score.alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*ranked))
    return F.when(best["score"] > 0, best["name"]).otherwise("unknown")


def not_crawled(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates (url, content_hash) that the log has by neither: two anti joins, as an OR would be a nested loop."""
    left = candidates.join(log.select("url").distinct(), "url", "left_anti")
    return left.join(log.select("content_hash").filter("content_hash is not null").distinct(), "content_hash", "left_anti")


def statistics(log: DataFrame, failed: Column) -> DataFrame:
    """visited, failed and success_rate in per cent over a crawl log."""
    n = F.count("*")
    bad = F.count_if(failed)
    return log.agg(n.alias("visited"), bad.alias("failed"), ((n - bad) / F.greatest(n, F.lit(1)) * 100).alias("success_rate"))


def fresh(pages: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    """Pages (url) with the cached html that is young enough; the key is the URL's SHA-256."""
    young = cache.filter(F.unix_timestamp("fetched_at") > F.unix_timestamp(now) - ttl_seconds).select("key", "html")
    return pages.withColumn("key", F.sha2("url", 256)).join(young, "key", "left")


def allowed_by_robots(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages whose path no ``rules`` (host, disallow) prefix of their host forbids; hosts without rules are open."""
    keyed = pages.withColumn("_host", urls.host(F.col("url"))).withColumn("_path", urls.part(F.col("url"), 3))
    lists = rules.filter("disallow <> ''").groupBy(F.col("host").alias("_host")).agg(F.collect_set("disallow").alias("_no"))
    barred = F.exists(F.coalesce("_no", F.array().cast("array<string>")), lambda p: F.startswith(F.col("_path"), p))
    return keyed.join(lists, "_host", "left").filter(~barred).drop("_host", "_path", "_no")


def sitemaps_of(robots: DataFrame) -> DataFrame:
    """(host, sitemap) from robots files (host, body)."""
    lines = robots.select("host", F.explode(F.split("body", "\\r?\\n")).alias("line"))
    found = lines.select("host", F.regexp_extract("line", "(?i)^\\s*sitemap:\\s*(\\S+)", 1).alias("sitemap"))
    return found.filter("sitemap <> ''").distinct()


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, url) from sitemap files (sitemap, body), normalised, each once."""
    found = sitemaps.select("sitemap", F.explode(F.regexp_extract_all("body", F.lit("<loc>\\s*([^<\\s]+)"), 1)).alias("u"))
    return found.select("sitemap", urls.normalise(F.col("u")).alias("url")).distinct()
