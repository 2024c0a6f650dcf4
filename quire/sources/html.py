"""HTML to elements: one row an element in document order."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.batches import gathered, parts

ELEMENTS = "doc_id bigint, position int, kind string, text string, target string, lang string, cells array<array<string>>"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("position", pa.int32()), *[(n, pa.string()) for n in ("kind", "text", "target", "lang")], ("cells", pa.list_(pa.list_(pa.string())))]
)
TAKEN = ("h1", "h2", "h3", "p", "li", "table", "img", "a")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOISE = ("nav", "menu", "footer", "header", "sidebar", "cookie", "advert")
#: A start tag of the key ends an open element of these.
IMPLIED = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "ul": {"p"}, "ol": {"p"}, "table": {"p"}, "div": {"p"}}


class Tree(HTMLParser):
    """Nodes [tag, attributes, children]; strings are children too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ended = IMPLIED.get(tag, ())
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in ended:
                del self.open[k:]
                break
            if self.open[k][0] in ("table", "ul", "ol", "div", "article", "section"):
                break
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def strings(node) -> Iterator[str]:
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            if at.strip():
                yield at.strip()
        elif at[0] not in ("script", "style"):
            stack += reversed(at[2])


def text_of(node, separator: str = "") -> str:
    return separator.join(strings(node))


def find(node, tag: str) -> Iterator[list]:
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            continue
        if at[0] == tag:
            yield at
        stack += reversed(at[2])


def is_noise(node, keep_images: bool) -> bool:
    names = f"{node[1].get('class', '')} {node[1].get('id', '')}".lower()
    if any(k in names for k in NOISE):
        return True
    return not (keep_images and node[0] == "img") and len(text_of(node)) < 3


def table_cells(node) -> list[list[str]]:
    rows = [[text_of(c) for c in tr[2] if not isinstance(c, str) and c[0] in ("td", "th")] for tr in find(node, "tr")]
    return [r for r in rows if r]


def elements(html: str, keep_images: bool = False, ignored: tuple[str, ...] = ()) -> list[tuple]:
    return list(walk(html, keep_images, ignored))


def walk(html: str, keep_images: bool = False, ignored: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(kind, text, target, lang, cells) in document order; below headers and footers nothing is taken."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    for t in find(tree.root, "title"):
        yield "title", text_of(t), None, None, None
        break
    stack = [(tree.root, None)]
    while stack:
        node, lang = stack.pop()
        if isinstance(node, str) or node[0] in ("header", "footer", "script", "style"):
            continue
        lang = node[1].get("lang") or lang
        if node[0] in TAKEN and not is_noise(node, keep_images):
            target = node[1].get("href") or node[1].get("src")
            kind = node[0]
            if kind == "a" and target and any(target.lower().endswith(e) for e in ignored):
                yield "p", f"EXT link: {target}", None, lang, None
            else:
                yield kind, text_of(node), target, lang, table_cells(node) if kind == "table" else None
        stack += [(c, lang) for c in reversed(node[2])]


def read(pages: DataFrame, key: str = "page_id", keep_images: bool = False, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Elements of ``pages`` (key, html).  Null html has none; broken markup never fails."""

    def rows(batch):
        keys, texts = batch.column("doc_id"), batch.column("html")
        for start, n in parts(texts):
            for k, h in zip(keys.slice(start, n).to_pylist(), texts.slice(start, n).to_pylist()):
                if h:
                    yield from ((k, at, *e) for at, e in enumerate(walk(h, keep_images, ignored)))

    def run(batches):
        for batch in batches:
            yield from gathered(rows(batch), ARROW)

    return pages.select(F.col(key).cast("bigint").alias("doc_id"), "html").mapInArrow(run, ELEMENTS)


def headings_only(found: DataFrame) -> DataFrame:
    """The reference layout: headings open empty shells, and content stays in Main / Content."""
    heading = F.col("kind").isin("h1", "h2", "h3")
    return found.withColumns(
        {"chapter_title": F.when(F.col("kind") == "h1", F.col("text")).otherwise("Main"), "section_title": F.when(heading, F.col("text")).otherwise("Content")}
    )
