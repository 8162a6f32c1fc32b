"""Interleaved media columns: HTML to ordered text and media references, payloads by digest.

``parse_html`` turns each page into an ordered array of (position, kind, text, ref, caption). ``store_media``
writes payloads losslessly as 8-bit grey PNG images, ``read_media`` reads the stored bytes back and computes
features, and ``resolve`` joins references to payload features by digest; positions and captions stay with their
reference. Payload bytes never pass a shuffle: only digests and features do.

Cases: null HTML or text counts as empty (no items; the payload of an empty text is one row of 576 bytes 255);
equal texts share a digest and so all values; a reference without a payload keeps nulls; a figure's caption goes to
all its media, before it or after it; an empty table gives an empty result; columns besides the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import html.parser
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import tables
from logloom.llm import textblocks as tb

ROW = 576
ITEMS = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
#: Tags whose text isn't shown, and tags that end a run of text.
HIDDEN = {"script", "style", "head", "template", "noscript"}
BREAKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "br", "hr", "pre", "blockquote", "figure", "header", "footer", "nav", "main", "aside", "body"}
MEDIA = {"img", "video", "audio", "source"}


class _Sequence(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        #: Media of the open figure, and its caption if that came first.
        self.figure: list[dict] | None = None
        self.told: str | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.run)).strip()
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA and (ref := dict(attrs).get("src")):
            self.flush()
            item = {"kind": "media", "text": None, "ref": ref, "caption": dict(attrs).get("alt") if self.told is None else self.told}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figure, self.told = [], None

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            self.caption = None
            if self.figure is not None:
                self.told = text
            for item in self.figure or []:
                item["caption"] = text
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = self.told = None

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def sequence(page: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return [{"position": i} | x for i, x in enumerate(parser.items)]


def parse_html(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id and items: text and media references in the order of the page."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(sequence, batch.column(1).to_pylist()), kind)], [id_col, "items"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {tables.id_type(pages, id_col)}, items {ITEMS}")


def _png_part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Rows of 576 grey 8-bit samples."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    return b"\x89PNG\r\n\x1a\n" + _png_part(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + _png_part(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _png_part(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """Samples of an image that to_png wrote."""
    at, body, shape = 8, [], (0, 0)
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IHDR":
            shape = struct.unpack(">II", stored[at + 8 : at + 16])
        elif kind == b"IDAT":
            body.append(stored[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Height, mean and spread of the samples, and their counts in 8 ranges."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    level = np.arange(256)
    mean = float(counts @ level) / len(samples)
    spread = max(0.0, float(counts @ (level * level)) / len(samples) - mean * mean) ** 0.5
    return f"{len(samples) // ROW}x{ROW};{mean:.4f};{spread:.4f};" + ",".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, digest, stored: each text as an image, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tb.blocks(batch, text_col):
                data, at = tb.flat(rows.column(1))
                stored, digests = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    payload = data[a:b].tobytes() + b"\xff" * (max(1, -(-(b - a) // ROW)) * ROW - (b - a))
                    stored.append(to_png(payload))
                    digests.append(hashlib.sha256(payload).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(digests, pa.string()), pa.array(stored, pa.binary())], [id_col, "n_bytes", "digest", "stored"])

    return tables.written(docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {tables.id_type(docs, id_col)}, n_bytes long, digest string, stored binary"), "media", compression="none")


def read_media(media: DataFrame) -> DataFrame:
    """One row for each digest, from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = stored.as_py()
                payload = from_png(stored)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)))
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    read = media.select("digest", "stored").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    rest = [c for c in read.columns if c != "digest"]
    # copies of a payload are summed up before the shuffle
    return read.groupBy("digest").agg(F.min(F.struct(*rest)).alias("m")).select("digest", "m.*")


def resolve(items: DataFrame, id_col: str, read: DataFrame) -> DataFrame:
    """A row for each media reference, with position, caption and the payload's columns."""
    refs = items.select(id_col, F.explode("items").alias("item")).where("item.kind = 'media'").select(id_col, "item.position", "item.caption", F.regexp_replace("item.ref", "^sha256:", "").alias("digest"))
    return tables.salted_join(refs, read, ["digest"])
