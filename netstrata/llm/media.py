"""Interleaved documents: HTML to ordered text and media references, payloads resolved by digest.

``sequences`` parses HTML into one row per item, in document order: text, or a media reference with its digest, caption
and position. ``store_media`` keeps payloads as 8-bit samples (binary PGM images, 64 samples a row) in a Parquet table
keyed by the SHA-256 of the unpadded bytes. ``features`` reads the stored bytes back, one row for each digest.
``resolve`` joins items with features by digest; payloads themselves are never shuffled. ``gather`` puts a document's
items together again in order.

Nulls and odd input: a null text or HTML is an empty one: its payload is 64 zero bytes, its sequence has no item. Equal
texts share a digest and get equal values. An unknown digest resolves to nulls. A caption goes to all media of its figure,
before or after it; in a figure without media it is text. Figures and captions end with the page at the latest. Repeated
rows keep their items each; items are told apart by ``item_row``. Very long texts take memory in proportion in the task that
reads them. Empty tables give no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, new_path, slices, table

UNIT = 64
MAX_SEEN = 50_000
ITEMS = "doc_id long, item_row long, position int, kind string, text string, digest string, caption string"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
SKIPPED = {"script", "style", "template", "noscript"}
BREAKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "br", "blockquote", "pre", "figure", "title"}


class Sequence(HTMLParser):
    """Items of a page in order: [kind, text, digest, caption]."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.buffer: list[str] = []
        self.skipped = 0
        self.caption: list[str] | None = None  # what an open caption has so far
        self.figures: list[dict] = []  # open figures: first item, caption, and the item it stands before
        self.feed(html)
        self.close()
        self.end_caption()
        self.flush()
        while self.figures:
            self.end_figure()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections, such as conditional comments, say nothing."""
        return self.rawdata.find(">", i) + 1 or -1

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        text, self.caption = " ".join("".join(self.caption or []).split()), None
        if text and self.figures:
            own = self.figures[-1]
            own["caption"] = f"{own['caption']} {text}" if own["caption"] else text
            own["at"] = len(self.items)
        elif text:
            self.items.append(["text", text, None, None])

    def end_figure(self) -> None:
        own = self.figures.pop()
        media = [item for item in self.items[own["first"] :] if item[0] == "media"]
        if own["caption"] and not media:
            self.items.insert(own["at"], ["text", own["caption"], None, None])
        for item in media:
            item[3] = own["caption"] or item[3]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skipped += 1
        if tag in BREAKS or tag in ("img", "audio", "video", "source", "figcaption"):
            self.flush()
        if tag == "figure":
            self.figures.append({"first": len(self.items), "caption": None, "at": 0})
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            own = dict(attrs)
            if own.get("src"):
                self.items.append(["media", None, own["src"].rpartition("sha256:")[2], own.get("alt")])

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        if tag in ("figcaption", "figure") and self.caption is not None:
            self.end_caption()
        if tag in BREAKS:
            self.flush()
        if tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            (self.buffer if self.caption is None else self.caption).append(data)


def sequences(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """One row for each item of each page; item_row tells rows with equal keys apart within the result."""
    narrow = pages.select(F.col(key).cast("long").alias("doc_id"), F.col(html).alias("html"), F.monotonically_increasing_id().alias("item_row"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ITEMS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4]
        for batch in slices(batches):
            rows = []
            for doc_id, page, row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "html", "item_row")), strict=True):
                rows += [(doc_id, row, at, *item) for at, item in enumerate(Sequence(page or "").items)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return narrow.mapInArrow(parse, ITEMS)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_media(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (UNIT, len(payload) // UNIT) + payload


def from_media(media: bytes) -> bytes:
    """The samples of a binary PGM image."""
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit PGM image")
    return samples


def block_hash(payload: bytes) -> str:
    """64 bits: which of 8 x 8 blocks of samples are brighter than the mean; 16 hex digits, then the mean in 1/1000."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    edges = np.arange(8) * len(samples) // 8
    rows = np.add.reduceat(samples.reshape(len(samples), 8, 8).sum(axis=2, dtype=np.int64), edges, axis=0)
    counts = np.maximum(np.diff(np.r_[edges, len(samples)]), 1)[:, None] * 8
    total, n = int(samples.sum(dtype=np.int64)), samples.size
    bits = rows * n > total * counts
    return f"{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}-{1000 * total // n}"


def store_media(docs: DataFrame, path: str, text: str = "text") -> None:
    """Write (digest, n_bytes, media) of every text; a task skips texts that it has just stored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[bytes] = set()
        for batch in slices(batches):
            rows = []
            for value in batch.column("payload").to_pylist():
                data = (value or "").encode("utf-8")
                digest = hashlib.sha256(data)
                if digest.digest() not in seen:
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    seen.add(digest.digest())
                    rows.append((digest.hexdigest(), len(data), to_media(padded(data))))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["digest", "n_bytes", "media"])

    stored = docs.select(F.col(text).alias("payload")).mapInArrow(encode, "digest string, n_bytes long, media binary")
    stored.write.option("compression", "zstd").parquet(path)


def features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stored digest, from the bytes read back."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in slices(batches):
            rows = []
            for digest, n_bytes, media in zip(*(batch.column(c).to_pylist() for c in ("digest", "n_bytes", "media")), strict=True):
                payload = from_media(media)
                rows.append((digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), block_hash(payload)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    stored = spark.read.schema("digest string, n_bytes long, media binary").parquet(path)
    return stored.mapInArrow(compute, FEATURES).dropDuplicates(["digest"])


def resolve(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items with the features of their digests; text items and unknown digests get nulls."""
    return items.join(found, "digest", "left")


def gather(items: DataFrame) -> DataFrame:
    """doc_id, item_row and the ordered array of a document's items; an item is bounded by its page, so an array is too."""
    names = [c for c in items.columns if c not in ("doc_id", "item_row", "position")]
    return items.groupBy("doc_id", "item_row").agg(F.sort_array(F.collect_list(F.struct("position", *names))).alias("items"))


def text_digest(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def page_of(docs: DataFrame) -> DataFrame:
    """(doc_id, html): each document as a page, its payload in a figure between the two halves of its text."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parts = docs.select("doc_id", F.split(text, "\n").alias("lines"), text_digest().alias("digest"))
    half = F.ceil(F.size("lines") / 2).cast("int")
    paragraph = lambda lines: F.concat(F.lit("<p>"), F.array_join(lines, "\n"), F.lit("</p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), "digest", F.lit('"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")), F.lit("</figcaption></figure>"))
    html = F.concat(F.lit("<article>"), paragraph(F.slice("lines", 1, half)), figure, paragraph(F.slice("lines", half + 1, F.size("lines"))), F.lit("</article>"))
    return parts.select("doc_id", html.alias("html"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an interleaved page, parsed, resolved and put together again; text items are carried as their CRC32."""
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "media")
    store_media(docs, path)
    # written, so that the join below is of plain tables and Spark can split it where many documents have one digest
    found = materialise(features(spark, path), "media-features")
    items = sequences(page_of(docs)).withColumn("text_crc32", F.crc32(F.encode("text", "UTF-8"))).drop("text")
    whole = gather(resolve(items, found))
    own = F.filter("items", lambda item: item["kind"] == "media")[0]
    names = [c.split()[0] for c in FEATURES.split(", ")[1:]]
    texts = F.transform(F.filter("items", lambda item: item["kind"] == "text"), lambda item: item["text_crc32"])
    return whole.select("doc_id", own.alias("own"), F.size("items").alias("n_items"), texts.alias("texts")).select(
        "doc_id", *(F.col(f"own.{c}").alias(c) for c in names), F.col("own.position").alias("position"), F.col("own.caption").alias("caption"), "n_items", F.array_join("texts", ",").alias("text_crc32s")
    )
