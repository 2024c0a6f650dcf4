"""URL filtering by host-suffix and path-prefix rules.

A URL is expanded into expressions, each a suffix of its host joined to a prefix of its path.  The suffixes of a host meet
the hosts of the rules first; only path prefixes of the sizes that rules of such a host have are made.  Both the suffixes
and the expressions meet the rules in an equi-join on a short hash prefix (32 bits of their SHA-256), and the full digests
confirm.  Of the rules that fit, the longest holds.

Equal pairs of host and path are judged once, so a hot host costs no more than its distinct paths.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import ascii_lower, fresh_names, joined

RULES = "host string, path string, verdict string"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """A rule table of (verdict, ``host/path``) pairs; the path begins at the first slash."""
    rows = [(r[: r.index("/")] if "/" in r else r, r[r.index("/") :] if "/" in r else "", v) for v, r in rules]
    return spark.createDataFrame(rows, RULES)


def split_url(url) -> tuple:
    """(host, path) columns: see ``judge``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.lit((1 << 31) - 1)))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host):
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (with url) and the columns host, path, rule and verdict; columns of these names are replaced.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or
    the end.  Both are empty if the url is null or has no ``://``.  A rule (host, path, verdict) fits its host and all its
    subdomains if the path starts with the rule's.  Of the rules that fit, the one with the most characters in host and
    path holds; of equally long ones that with the longer host, then ``block`` before any other verdict, then the least.
    Where none fits, rule is null and the verdict is ``default``.

    Rules with null or empty host never fit; a null path counts as empty; repeated rules count once.  Null and repeated
    pages are kept row by row; empty tables are fine.
    """
    host, path = split_url(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    rules = rules.select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).filter("host <> '' and verdict is not null")
    rank = F.struct(
        (F.length("host") + F.length("path")).alias("size"),
        F.length("host").alias("host_size"),
        (F.col("verdict") == "block").alias("blocks"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    known = rules.select(
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest"), rank.alias("rank")
    ).groupBy("digest").agg(F.max("rank").alias("rank"))
    known = known.select(F.substring("digest", 1, 8).alias("prefix"), F.col("digest").alias("full"), "rank")
    hosts = rules.select(F.sha2("host", 256).alias("full"), F.length("path").alias("size")).distinct()
    hosts = hosts.withColumn("prefix", F.substring("full", 1, 8))
    distinct = pages.select("host", "path").filter("host <> ''").distinct()
    labels = F.explode(F.sequence(F.lit(1), _labels(F.col("host")))).alias("labels")
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("labels"))
    suffixes = distinct.select("host", "path", labels).withColumn("suffix", suffix)
    suffixes = suffixes.withColumn("digest", F.sha2("suffix", 256)).withColumn("prefix", F.substring("digest", 1, 8))
    expanded = joined(suffixes, hosts, "prefix", "inner").filter("digest = full and length(path) >= size")
    expression = F.concat("suffix", F.lit("\n"), F.substring(F.col("path"), F.lit(1), F.col("size")))
    expanded = expanded.select("host", "path", F.sha2(expression, 256).alias("digest"))
    met = joined(expanded.withColumn("prefix", F.substring("digest", 1, 8)), known, "prefix", "inner")
    (rank_,) = fresh_names(pages.columns, "rank")
    best = met.filter("digest = full").groupBy("host", "path").agg(F.max("rank").alias(rank_))
    out = pages.join(best, ["host", "path"], "left")
    return out.select(
        *[c for c in pages.columns if c not in ("host", "path")],
        "host",
        "path",
        F.col(f"{rank_}.rule").alias("rule"),
        F.coalesce(f"{rank_}.verdict", F.lit(default)).alias("verdict"),
    )
