"""Markdown, YAML, DOCX and EPUB files to elements, and the registry of readers by extension."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from posixpath import basename, dirname, join, normpath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import trees
from quire.sources import html

PARTS = "path string, position int, kind string, text string, target string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MEDIA = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".svg", ".webp", ".bin", ".mp4", ".mp3")
_heading = re.compile(r"^(#{1,6})\s+(.+)$")
_inline = ((re.compile(r"\*\*(.+?)\*\*"), r"\1"), (re.compile(r"\*(.+?)\*"), r"\1"), (re.compile(r"`(.+?)`"), r"\1"))

Part = tuple[str, str | None, str | None]


def markdown(text: str) -> Iterator[Part]:
    """Headings h1 to h6, fenced code (target: its language), and paragraphs split at blank lines, marks stripped."""
    held: list[str] = []
    fence: list[str] | None = None
    language = ""

    def flush() -> Iterator[Part]:
        for block in re.split(r"\n\s*\n", "\n".join(held)):
            block = block.strip()
            for pattern, to in _inline:
                block = pattern.sub(to, block)
            if block:
                yield "p", block, None
        held.clear()

    for line in text.splitlines():
        if line.startswith("```"):
            if fence is None:
                yield from flush()
                fence, language = [], line[3:].strip() or "text"
            else:
                yield "code", "\n".join(fence), language
                fence = None
        elif fence is not None:
            fence.append(line)
        elif m := _heading.match(line):
            yield from flush()
            yield f"h{len(m[1])}", m[2].strip(), None
        else:
            held.append(line)
    if fence is not None:
        yield "code", "\n".join(fence), language
    yield from flush()


def docx(data: bytes) -> Iterator[Part]:
    """Paragraphs by style (Heading 1: h1, Heading 2: h2), tables as tab-separated rows, then the media members."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        for node in body if body is not None else ():
            if node.tag == f"{W}p":
                style = node.find(f"{W}pPr/{W}pStyle")
                name = (style.get(f"{W}val") or "") if style is not None else ""
                text = " ".join(t.text for t in node.iter(f"{W}t") if t.text).strip()
                if text:
                    yield {"heading1": "h1", "heading2": "h2"}.get(name.replace(" ", "").lower(), "p"), text, None
            elif node.tag == f"{W}tbl":
                rows = [[" ".join(t.text or "" for t in c.iter(f"{W}t")).strip() for c in r.iter(f"{W}tc")] for r in node.iter(f"{W}tr")]
                yield "table", "\n".join("\t".join(r) for r in rows), None
        for name in z.namelist():
            if name.startswith(("word/media/", "word/embeddings/")) and name.lower().endswith(MEDIA):
                yield "media", basename(name), name


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def epub(data: bytes) -> Iterator[Part]:
    """Dublin Core metadata, then the elements of the spine's files in order; links and images have a target."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        root = next(n.get("full-path") for n in container.iter() if _local(n.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(root))
        files = {}
        for n in package.iter():
            if _local(n.tag) == "item":
                files[n.get("id")] = normpath(join(dirname(root), n.get("href")))
            elif n.tag.startswith("{http://purl.org/dc/elements/1.1/}") and n.text:
                yield "meta", n.text.strip(), _local(n.tag)
        for n in package.iter():
            if _local(n.tag) == "itemref" and files.get(n.get("idref")) in z.namelist():
                page = z.read(files[n.get("idref")]).decode("utf-8", "replace")
                yield "file", basename(files[n.get("idref")]), files[n.get("idref")]
                for kind, text, target, _, _ in html.elements(page, keep_images=True):
                    yield kind, text, target


def link_kind(target) -> F.Column:
    return (
        F.when(target.startswith("#"), "internal_anchor")
        .when(target.startswith("mailto:"), "email")
        .when(target.rlike("^[a-z]+://"), "external")
        .otherwise("internal_document")
    )


READERS: dict[str, Callable[[bytes], Iterator[Part]]] = {
    ".md": lambda b: markdown(b.decode("utf-8", "replace")),
    ".html": lambda b: ((k, t, to) for k, t, to, _, _ in html.elements(b.decode("utf-8", "replace"))),
    ".docx": docx,
    ".epub": epub,
}


def register(extension: str, reader: Callable[[bytes], Iterator[Part]]) -> None:
    READERS[extension.lower()] = reader


def yaml_parts(data: bytes) -> Iterator[Part]:
    import yaml

    for path, kind, _, value in trees.nodes(yaml.safe_load(data.decode("utf-8", "replace"))):
        yield kind, value, path


register(".yaml", yaml_parts)
register(".yml", yaml_parts)
register(".htm", READERS[".html"])


def parse(files: DataFrame) -> DataFrame:
    """Elements of ``files`` (path, content), by extension.  Unknown extensions are left out; unreadable files are one row
    of kind ``error``."""
    readers = dict(READERS)

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                reader = readers.get("." + path.rsplit(".", 1)[-1].lower())
                if reader is None or content is None:
                    continue
                try:
                    out += [(path, n, *p) for n, p in enumerate(list(reader(bytes(content))))]
                except Exception as error:  # noqa: BLE001  any parser error quarantines the file
                    out.append((path, 0, "error", str(error).split("\n")[0], None))
            yield pd.DataFrame(out, columns=["path", "position", "kind", "text", "target"])

    return files.select("path", "content").mapInPandas(run, PARTS)


def read(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return parse(files)


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(extension, files, bytes, largest): totals by type with the five largest files; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    found = found.withColumn("extension", F.regexp_extract("path", "[^/.]+([.][^./]+)$", 1))
    from pyspark.sql import Window

    w = Window.partitionBy("extension").orderBy(F.desc("length"), "path")
    top = found.withColumn("n", F.row_number().over(w)).filter("n <= 5").groupBy("extension").agg(
        F.array_sort(F.collect_list(F.struct("n", "path", "length"))).alias("largest")
    )
    return found.groupBy("extension").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).join(top, "extension")
