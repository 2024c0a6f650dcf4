"""Nested data as path tables: flattening, references, differences, API descriptions, validation.

A path table has a row a node: doc_id, path (dotted, ``[i]`` for items), type, value (leaves), in any order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.storage import materialise

NODES = "doc_id bigint, path string, type string, size int, value string"
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")


def type_name(value: Any) -> str:
    for kind, name in ((type(None), "null"), (bool, "boolean"), ((int, float), "number"), (str, "string"), (dict, "object"), (list, "array")):
        if isinstance(value, kind):
            return name
    return "string"


def nodes(value: Any, path: str = "") -> Iterator[tuple[str, str, int | None, str | None]]:
    """Every node below and including ``value``, without recursion, so depth is no limit."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            yield at, "object", len(v), None
            stack += [(f"{at}.{k}" if at else str(k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            yield at, "array", len(v), None
            stack += [(f"{at}[{i}]", v[i]) for i in range(len(v) - 1, -1, -1)]
        else:
            text = None if v is None else json.dumps(v) if isinstance(v, (bool, int, float)) else str(v)
            yield at, type_name(v), None, text


def flatten(rows: DataFrame, key: str, text: str, kind: str = "json") -> DataFrame:
    """The path table of ``rows`` (key, JSON or YAML text); what can't be read is one node of type ``error``."""

    def load(t: str) -> Any:
        if kind == "json":
            return json.loads(t)
        import yaml

        return yaml.safe_load(t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch["doc_id"], batch["text"]):
                if t is None:
                    continue
                try:
                    value = load(t)
                except Exception as error:  # noqa: BLE001  any parser error quarantines the row
                    out.append((k, "", "error", None, str(error).split("\n")[0]))
                    continue
                out += [(k, *n) for n in nodes(value)]
            yield pd.DataFrame(out, columns=["doc_id", "path", "type", "size", "value"]).astype({"size": "Int32"})

    return rows.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, NODES)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, path, kind, left_value, right_value): missing_key, type_mismatch, length_mismatch or value_mismatch."""
    a = left.select("doc_id", "path", F.col("type").alias("lt"), F.col("size").alias("ls"), F.col("value").alias("left_value"))
    b = right.select("doc_id", "path", F.col("type").alias("rt"), F.col("size").alias("rs"), F.col("value").alias("right_value"))
    kind = (
        F.when(F.col("lt").isNull() | F.col("rt").isNull(), "missing_key")
        .when(F.col("lt") != F.col("rt"), "type_mismatch")
        .when((F.col("lt") == "array") & (F.col("ls") != F.col("rs")), "length_mismatch")
        .when(~F.col("left_value").eqNullSafe(F.col("right_value")), "value_mismatch")
    )
    both = a.join(b, ["doc_id", "path"], "full_outer").withColumn("kind", kind).filter("kind is not null")
    return both.select("doc_id", "path", "kind", "left_value", "right_value")


def resolve_references(table: DataFrame, most_depth: int = 10) -> DataFrame:
    """(doc_id, path, target): each ``$ref`` followed to the node that is none, through at most ``most_depth`` steps.

    A reference that leads nowhere or in a circle keeps its last target, with ``resolved`` false.
    """
    place = F.regexp_replace(F.regexp_replace("value", "^#/", ""), "/", ".")
    found = table.filter("path = '$ref' or path like '%.$ref'")
    refs = found.select("doc_id", F.regexp_replace("path", "\\.?\\$ref$", "").alias("path"), place.alias("target"))
    refs = materialise(refs, "references")
    now = refs
    step = refs.select("doc_id", F.col("path").alias("target"), F.col("target").alias("next"))
    for _ in range(most_depth):
        moved = now.join(step, ["doc_id", "target"], "left")
        if moved.filter("next is not null").isEmpty():
            break
        now = materialise(moved.select("doc_id", "path", F.coalesce("next", "target").alias("target")), "references")
    ends = table.select("doc_id", F.col("path").alias("target")).distinct().join(step.select("doc_id", "target"), ["doc_id", "target"], "left_anti")
    return now.join(ends.withColumn("resolved", F.lit(True)), ["doc_id", "target"], "left").na.fill({"resolved": False})


def endpoints(table: DataFrame) -> DataFrame:
    """(doc_id, api_path, method, operation_id, summary) from the paths of API descriptions."""
    pattern = "^paths\\.(/.*)\\.([a-zA-Z]+)$"
    heads = table.filter(F.col("path").rlike(pattern) & (F.col("type") == "object"))
    heads = heads.select("doc_id", "path", F.regexp_extract("path", pattern, 1).alias("api_path"), F.upper(F.regexp_extract("path", pattern, 2)).alias("method"))
    heads = heads.filter(F.col("method").isin(*METHODS))
    leaf = "^(paths\\./.*\\.[a-zA-Z]+)\\.(operationId|summary)$"
    details = table.filter(F.col("path").rlike(leaf)).select("doc_id", F.regexp_extract("path", leaf, 1).alias("path"), F.regexp_extract("path", leaf, 2).alias("field"), "value")
    wide = details.groupBy("doc_id", "path").agg(
        F.max(F.when(F.col("field") == "operationId", F.col("value"))).alias("operation_id"), F.max(F.when(F.col("field") == "summary", F.col("value"))).alias("summary")
    )
    return heads.join(wide, ["doc_id", "path"], "left").drop("path")


def schemas(table: DataFrame) -> DataFrame:
    """(doc_id, name, path): children of components.schemas, definitions or schemas."""
    pattern = "(?:^|\\.)(?:components\\.schemas|definitions|schemas)\\.([^.\\[]+)$"
    return table.filter(F.col("path").rlike(pattern)).select("doc_id", F.regexp_extract("path", pattern, 1).alias("name"), "path").distinct()


def named(table: DataFrame, key: str) -> DataFrame:
    """Nodes called ``key`` (``example``, ``description``) with their path."""
    return table.filter(F.col("path").rlike(f"(^|\\.){key}$"))


def problems(table: DataFrame) -> DataFrame:
    """Empty keys, and empty lists that aren't below an example or value."""
    empty_key = F.col("path").rlike("(^|\\.)(\\.|$)") & (F.col("path") != "")
    empty_list = (F.col("type") == "array") & (F.col("size") == 0) & ~F.lower("path").rlike("example|value")
    return table.filter(empty_key | empty_list | (F.col("type") == "error")).withColumn(
        "problem", F.when(F.col("type") == "error", "unreadable").when(empty_key, "empty_key").otherwise("empty_list")
    )


def structure(table: DataFrame) -> DataFrame:
    """(doc_id, structure_type) from the keys at the top."""
    has = lambda k: F.bool_or(F.col("path") == k)
    return table.groupBy("doc_id").agg(
        F.when(has("openapi") | has("swagger"), "openapi")
        .when(has("$schema") | has("definitions"), "json_schema")
        .when(has("apiVersion") & has("kind"), "kubernetes")
        .when(has("version") & has("services"), "compose")
        .otherwise("generic")
        .alias("structure_type")
    )


def json_schema(value: Any) -> dict:
    """A JSON Schema of a value; lists are typed by their first item."""
    if isinstance(value, dict):
        return {"type": "object", "properties": {str(k): json_schema(v) for k, v in value.items()}}
    if isinstance(value, list):
        return {"type": "array", "items": json_schema(value[0]) if value else {}}
    return {"type": type_name(value)}


def comments(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, comment): whole-line comments with their line number, from 1."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    return lines.filter(F.col("raw").rlike("^\\s*#")).select(key, (F.col("at") + 1).alias("line"), F.regexp_replace("raw", "^\\s*#\\s?", "").alias("comment"))


def merge(frames: list[DataFrame]) -> DataFrame:
    """Top-level entries of several path tables of one document each; the last file that has a key wins wholly."""
    marked = None
    for n, f in enumerate(frames):
        one = f.withColumn("file", F.lit(n)).withColumn("top", F.regexp_extract("path", "^([^.\\[]*)", 1))
        marked = one if marked is None else marked.unionByName(one)
    last = marked.groupBy("top").agg(F.max("file").alias("file"))
    return marked.join(last, ["top", "file"]).filter("path <> ''").drop("top", "file", "doc_id")
