"""Media columns: interleaved documents whose media are resolved by digest.

A page's HTML is parsed into an ordered sequence of structs: text, or a media reference with its
digest and caption, each with its position. Payloads live in a media column, as lossless 8-bit
greyscale PNG images of 24 samples a row, one row for each distinct digest. References join the
media by digest; positions and captions come along unchanged. Digests that more than one reference
in SHARE has, a thousand at most, are joined by broadcast, so that no copy's references meet in one task.

Nulls and edges: a null or empty text is an empty payload, padded like any other; a page that is
null has no items; a reference without a payload keeps its row, with nulls for the media; equal
texts share one payload; a null id is kept; an empty table gives none. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .simhash import durable

#: Payloads are padded with this byte to a positive multiple of UNIT bytes, which is a square of WIDTH samples.
PAD, UNIT, WIDTH = 255, 576, 24
SCHEME = "media:sha256:"
#: A digest with more than HOT references and more than one in SHARE of all is hot: there are fewer than SHARE of them.
HOT, SHARE = 200, 1000
#: Digests that a task remembers to have stored already.
REMEMBERED = 1 << 16
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """8-bit greyscale rows of WIDTH samples, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of a stored image; raises where a chunk's checksum or the form is wrong."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, height = 8, [], 0
    while at < len(stored):
        (size,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour, *rest) != (WIDTH, 8, 0, 0, 0, 0):
                raise ValueError("another form of image")
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Height, mean, deviation and an average hash of the samples as an 8 by 8 picture."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    edges = len(rows) * np.arange(8) // 8
    tiles = np.add.reduceat(np.add.reduceat(rows.astype(np.int64), edges, axis=0), np.arange(0, WIDTH, 3), axis=1)
    cells = np.diff(np.append(edges, len(rows)))[:, None] * 3
    total, square = int(tiles.sum()), int((rows.astype(np.int64) ** 2).sum())
    n = rows.size
    bright = tiles * n >= total * cells
    return f"{len(rows)}x{WIDTH}:{total // n}:{int(max(0, square / n - (total / n) ** 2) ** 0.5)}:{np.packbits(bright).tobytes().hex()}"


def store(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(digest, n_bytes, media): the media column of all texts. A task encodes a text once, as long as it is among the last
    REMEMBERED; so a digest can have a few equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                found: dict[str, tuple[int, bytes]] = {}
                for x in batch.column(0).slice(low, 512):
                    raw = (x.as_py() or "").encode()
                    payload = pad(raw)
                    digest = hashlib.sha256(payload)
                    if digest.digest() not in seen:
                        seen[digest.digest()] = None
                        found[digest.hexdigest()] = len(raw), to_png(payload)
                while len(seen) > REMEMBERED:
                    del seen[next(iter(seen))]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([m for _, m in found.values()], pa.binary())], ["digest", "n_bytes", "media"])

    return docs.select(F.col(text).cast("string").alias("body")).mapInArrow(run, "digest string, n_bytes long, media binary")


_READ = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(stored: DataFrame) -> DataFrame:
    """What the stored bytes say: the payload is decoded from them, and everything but n_bytes computed from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for media in batch.column("media"):
                raw = media.as_py()
                payload = from_png(raw)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(payload)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [f.split()[0] for f in _READ.split(", ")])

    return stored.mapInArrow(run, _READ)


_ITEM = re.compile(r"<figure\b[^>]*>(?P<figure>.*?)</figure\s*>|<img\b(?P<img>[^>]*)>", re.S | re.I)
_SOURCE = re.compile(r"""\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ALT = re.compile(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)
_CAPTION = re.compile(r"<figcaption\b[^>]*>(.*?)</figcaption\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_BREAK = re.compile(r"</?(?:p|div|h[1-6]|li|ul|ol|section|article|blockquote|pre|table|tr|body|html|br|hr)\b[^>]*>", re.I)


def _texts(markup: str) -> Iterator[str]:
    for block in _BREAK.split(markup):
        text = entities.unescape(_TAG.sub("", block)).strip()
        if text:
            yield text


def sequence(html: str | None) -> list[dict]:
    """The items of one page in order: kind `text` with its text, or `media` with digest and caption."""
    items: list[dict] = []
    at, source = 0, html or ""

    def texts(markup: str) -> None:
        items.extend({"kind": "text", "text": t, "digest": None, "caption": None} for t in _texts(markup))

    for m in _ITEM.finditer(source):
        texts(source[at : m.start()])
        at = m.end()
        inner = m["figure"] if m["figure"] is not None else m[0]
        caption = _CAPTION.search(inner)
        for image in re.finditer(r"<img\b[^>]*>", inner, re.I):
            found, alt = _SOURCE.search(image[0]), _ALT.search(image[0])
            address = entities.unescape(next((g for g in found.groups() if g is not None), "")) if found else ""
            said = _TAG.sub("", caption[1]) if caption else next((g for g in alt.groups() if g is not None), "") if alt else ""
            items.append({"kind": "media", "text": None, "digest": address[len(SCHEME) :] if address.startswith(SCHEME) else None, "caption": " ".join(entities.unescape(said).split()) or None})
    texts(source[at:])
    return items


_ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def interleave(pages: DataFrame, *, page_id: str, html: str, with_text: bool = True) -> DataFrame:
    """(page_id, items): each page as its ordered sequence; positions count all items, texts left out or not."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [[{"position": k} | x for k, x in enumerate(sequence(h.as_py())) if with_text or x["kind"] == "media"] for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, kind)], ["page", "items"])

    kind_of_id = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page"), F.col(html).cast("string").alias("markup")).mapInArrow(run, f"page {kind_of_id}, items {_ITEMS}").withColumnRenamed("page", page_id)


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """`refs` (with a column digest) with what `media` (one row a digest) says of each; a reference to nothing keeps its row.
    `refs` is read twice: once to count hot digests."""
    counted = refs.filter("digest is not null").groupBy("digest").count()
    total = refs.count()
    hot = counted.filter((F.col("count") > HOT) & (F.col("count") * SHARE > total)).select("digest")
    hot = [r.digest for r in hot.collect()]  # fewer than SHARE
    if not hot:
        return refs.join(media, "digest", "left")
    is_hot = F.coalesce(F.col("digest").isin(hot), F.lit(False))
    return refs.filter(~is_hot).join(media, "digest", "left").unionByName(refs.filter(is_hot).join(F.broadcast(media.filter(is_hot)), "digest", "left"))


def references(items: DataFrame, *kept: str) -> DataFrame:
    """A row for each media reference of the sequences: the `kept` columns, position, caption and digest."""
    return items.select(*kept, F.explode("items").alias("item")).filter("item.kind = 'media'").select(*kept, "item.position", "item.caption", "item.digest")


def page_of(body: Column) -> Column:
    """A page around a text: a block for each of its lines, escaped, and after the first one a figure that refers to the text's payload."""
    escaped = F.regexp_replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), ">", "&gt;")
    padding = F.unhex(F.repeat(F.lit("FF"), (F.greatest(F.lit(1), F.ceil(F.octet_length(body) / UNIT)) * UNIT - F.octet_length(body)).cast("int")))
    digest = F.sha2(F.concat(F.encode(body, "UTF-8"), padding), 256)
    first, rest = F.split_part(escaped, F.lit("\n"), F.lit(1)), F.substr(escaped, F.locate("\n", F.concat(escaped, F.lit("\n"))) + 1)
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), digest, F.lit('"><figcaption>'), F.octet_length(body).cast("string"), F.lit(" bytes as an image</figcaption></figure>"))
    blocks = F.replace(rest, F.lit("\n"), F.lit("</p><p>"))
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), figure, F.lit("<p>"), blocks, F.lit("</p></article>"))


def op3_rows(docs: DataFrame) -> DataFrame:
    """Every text as a page of text blocks around a reference, resolved against the media column of all texts: the contract's
    columns, the reference's position and caption, the number of text blocks and a digest of them."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = interleave(docs.select("doc_id", page_of(body).alias("html")), page_id="doc_id", html="html")
    said = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    refs = durable(references(items.select("doc_id", "items", F.size(said).cast("long").alias("n_blocks"), F.sha2(F.array_join(said, "\n"), 256).alias("blocks_sha256")), "doc_id", "n_blocks", "blocks_sha256"))
    media = read_back(store(docs))
    media = media.groupBy("digest").agg(*(F.first(c).alias(c) for c in media.columns[1:]))
    return resolve(refs, durable(media)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_blocks", "blocks_sha256")
