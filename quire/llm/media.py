"""Media columns: interleaved sequences of text and media references.

A page's HTML is parsed into an ordered sequence of items, each text or a reference to media with its caption; the
item's position in the page is part of it.  A reference names its payload by digest.  Payloads are stored once, as
lossless 8-bit greymaps in a binary column; a join on the digest resolves the references.  The sequences are never
gathered: an item stays a row of its own, with page, position and caption, so any number of items of a page and any number
of references to one payload are fine.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import blobs, materialise, slices

ITEM = "struct<position: int, kind: string, text: string, source: string, digest: string, caption: string>"
FEATURES = (
    "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string"
)
#: Samples a row of a greymap, and the multiple that payloads are padded to.
WIDTH = 64
SKIPPED = {"script", "style", "template", "noscript"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section",
    "table", "td", "th", "title", "tr", "ul",
}
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": None, "embed": "image"}


def stored(payload: bytes) -> bytes:
    """A payload, of any length, as a greymap with 64 samples a row, padded with zero samples to whole rows."""
    padded = max(1, -(-len(payload) // WIDTH)) * WIDTH
    header = b"P5\n# bytes=%d\n%d %d\n255\n" % (len(payload), WIDTH, padded // WIDTH)
    return header + payload + bytes(padded - len(payload))


def samples(media: bytes) -> tuple[bytes, int]:
    """The samples of a stored greymap and its number of bytes without padding."""
    kind, comment, shape, depth, rest = media.split(b"\n", 4)
    width, height = map(int, shape.split())
    if kind != b"P5" or depth != b"255" or width * height != len(rest):
        raise ValueError("not a stored payload")
    return rest, int(comment.removeprefix(b"# bytes="))


def describe(values: bytes) -> str:
    """Mean, deviation, entropy and share of zero samples, with fixed digits."""
    counts = np.bincount(np.frombuffer(values, np.uint8), minlength=256)
    share = counts / len(values)
    levels = np.arange(256)
    mean = float(share @ levels)
    deviation = float(share @ (levels - mean) ** 2) ** 0.5
    some = share[share > 0]
    entropy = abs(float(-(some * np.log2(some)).sum()))
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={entropy:.4f};zero={share[0]:.4f}"


class _Items(HTMLParser):
    """Collects items in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.figure: list[int] = []  # first item of each open figure
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "source": None, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure.append(len(self.items))
        elif tag == "figcaption" and self.figure:
            self.caption = []
        elif tag in MEDIA:
            given = dict(reversed(attrs))  # of repeated attributes the first holds
            source = given.get("src")
            if MEDIA[tag] or source:
                self.flush()
                kind = MEDIA[tag] or "video"
                digest = given.get("data-digest") or digest_of(source)
                alt = " ".join((given.get("alt") or "").split()) or None
                self.items.append({"kind": kind, "text": None, "source": source, "digest": digest, "caption": alt})

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in ("figcaption", "figure") and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            if text:
                for item in self.items[self.figure[-1] if self.figure else len(self.items) :]:
                    if item["kind"] != "text":
                        item["caption"] = text
                self.pending = text
        if tag in BLOCKS:
            self.flush()
        if tag == "figure" and self.figure:
            first = self.figure.pop()
            if text := self.__dict__.pop("pending", None):  # a caption may come before its media
                for item in self.items[first:]:
                    if item["kind"] != "text":
                        item["caption"] = text

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        (self.text if self.caption is None else self.caption).append(data)


def digest_of(source: str | None) -> str | None:
    """The SHA-256 that a source names (``sha256:…``) or that its ``data:`` payload has; else null."""
    if not source:
        return None
    if source.startswith("sha256:"):
        return source[7:].lower() or None
    if source.startswith("data:") and "," in source:
        head, data = source.split(",", 1)
        raw = unquote_to_bytes(data)
        if head.endswith(";base64"):
            try:
                raw = base64.b64decode(raw)
            except ValueError:
                return None
        return hashlib.sha256(raw).hexdigest()
    return None


def parse(html: str) -> list[dict]:
    """The items of a page in order; a media item has the caption of its figure, or else its ``alt`` text."""
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row an item of ``pages`` (key, html): the key, position, kind, text, source, digest and caption.

    Null or empty html has no items, so no rows.  Null and repeated keys are kept row by row.  An empty table gives no rows.
    Broken markup never fails.  Other columns are ignored.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["text", "source", "digest", "caption"]
        for batch in batches:
            for part in slices(batch, "html", 2 << 20):
                at, items = [], []
                for k, html in enumerate(part.column("html").to_pylist()):
                    found = parse(html) if html else []
                    at += [k] * len(found)
                    items += found
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(at, pa.int64())),
                        pa.array([i["position"] for i in items], pa.int32()),
                        pa.array([i["kind"] for i in items], pa.string()),
                        *(pa.array([i[f] for i in items], pa.string()) for f in fields),
                    ],
                    [key, "position", "kind", *fields],
                )

    schema = f"`{key}` {kind}, position int, kind string, text string, source string, digest string, caption string"
    return pages.select(key, "html").mapInArrow(run, schema)


def features(media: DataFrame) -> DataFrame:
    """One row a distinct digest of ``media`` (digest, media: stored greymaps), computed from the stored bytes.

    Rows with null media are left out.  Copies are folded map-side, so a payload stored by very many rows is one row here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for digest, media_bytes in zip(batch.column("digest").to_pylist(), batch.column("media")):
                raw = media_bytes.as_buffer().to_pybytes()
                values, n = samples(raw)
                checked = hashlib.sha256(values).hexdigest(), zlib.crc32(values[-WIDTH:])
                whole = hashlib.sha256(raw).hexdigest()
                out.append((digest, n, len(values), *checked, len(raw), whole, describe(values)))
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    each = media.filter("media is not null").select("digest", "media").mapInArrow(run, FEATURES)
    rest = [c for c in each.columns if c != "digest"]
    return each.groupBy("digest").agg(F.max(F.struct(*rest)).alias("f")).select("digest", "f.*")


def resolve(items: DataFrame, known: DataFrame) -> DataFrame:
    """``items`` with the columns that ``known`` has for their digest (one row a digest); null where nothing is known.

    Items without digest don't take part in the join, so they are no hot key of it; a digest that very many items share
    is split by adaptive execution.
    """
    named = items.filter("digest is not null").join(known, "digest", "left")
    rest = [F.lit(None).cast(t).alias(c) for c, t in known.dtypes if c != "digest"]
    return named.unionByName(items.filter("digest is null").select("*", *rest))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            ids = part.column("doc_id")
            media = [stored(text) for text in blobs(part.column("text"))]
            digests = [hashlib.sha256(m).hexdigest() for m in media]
            html = [
                f'<article><p>Text of document {i}</p><figure><img src="sha256:{d}"><figcaption>Document {i}</figcaption></figure></article>'
                for i, d in zip(ids.to_pylist(), digests)
            ]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(html, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())],
                ["doc_id", "html", "digest", "media"],
            )


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, html (a page that shows the payload in a figure), digest and media for each row, written and read back.

    The payload is the whole text in UTF-8; null text counts as empty.  Equal texts have equal media.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(_store, "doc_id bigint, html string, digest string, media binary"), "media")


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every text of ``docs`` as media, parses the pages that refer to it, and resolves them by digest.

    One row a row of ``docs``: doc_id, position and caption of the reference and the features of the bytes read back.
    Null texts are empty payloads (64 zero samples); null and repeated doc_ids are kept.  An empty table gives no rows.
    """
    table = store_texts(docs)
    found = sequences(table, "doc_id").filter("kind = 'image'").select("doc_id", "position", "caption", "digest")
    return resolve(found, features(table))
