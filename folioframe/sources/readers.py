"""Sources: object listings, JSON and JSONL in their modes, content lists, tables, archives, image headers."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(key, last_modified, size) of all objects below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("key"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_modified"), F.col("length").alias("size"))


def manifests(listed: DataFrame, limit: int | None = None) -> DataFrame:
    """Objects that are manifests, by key; a limit cuts the listing before the sort."""
    found = listed.filter(F.col("key").endswith("/manifest.json"))
    return (found if limit is None else found.limit(limit)).orderBy("key")


def two_level_manifests(listed: DataFrame, prefix: str) -> DataFrame:
    """(material, run) prefixes two levels below `prefix` whose manifest exists."""
    rest = listed.filter(F.startswith("key", F.lit(prefix))).select(F.split(F.substring("key", len(prefix) + 1, 1 << 20), "/").alias("p"))
    pairs = rest.filter(F.size("p") >= 3).select(F.get("p", F.lit(0)).alias("material"), F.get("p", F.lit(1)).alias("run")).distinct()
    there = rest.filter((F.size("p") == 3) & (F.get("p", F.lit(2)) == "manifest.json")).select(F.get("p", F.lit(0)).alias("material"), F.get("p", F.lit(1)).alias("run"))
    return pairs.join(there, ["material", "run"], "left_semi")


def pdfs(listed: DataFrame) -> DataFrame:
    return listed.filter(F.lower("key").endswith(".pdf"))


def ids_from_manifest(key: Column) -> tuple[Column, Column]:
    """Material and run of a manifest key with four parts at least, else nulls."""
    parts = F.split(key, "/")
    fits = (F.size(parts) >= 4) & (F.element_at(parts, -1) == "manifest.json")
    return F.when(fits, F.element_at(parts, -3)), F.when(fits, F.element_at(parts, -2))


def first_existing(rows: DataFrame, candidates: list[str], listed: DataFrame, name: str = "resolved") -> DataFrame:
    """Each row's first candidate column that the listing holds; null candidates are passed over. One join a candidate, on the
    distinct keys of the listing, so that no row is lost or doubled whatever is null in it."""
    keys, found = listed.select("key").filter("key is not null").distinct(), []
    for k, c in enumerate(candidates):
        found.append(F.col(f"__key{k}"))
        rows = rows.join(keys.withColumnRenamed("key", f"__key{k}"), F.col(c) == F.col(f"__key{k}"), "left")
    return rows.withColumn(name, F.coalesce(*found)).drop(*(f"__key{k}" for k in range(len(candidates))))


def json_or_empty(text: Column, schema: str) -> Column:
    """A JSON object by schema; missing, bad or other JSON gives a struct of nulls."""
    return F.from_json(F.when(F.rlike(text, F.lit(r"^\s*\{")), text).otherwise("{}"), schema)


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "skip", limit: int | None = None) -> DataFrame:
    """Objects of a JSONL file: mode `skip` leaves bad lines out, `raise` fails on them, `all_or_nothing`
    gives no row of a file that has one. `limit` keeps the first rows of each file."""
    rows = spark.read.format("text").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__order"), "value").filter("trim(value) <> ''")
    value = F.from_json("value", T.StructType([*_schema(schema).fields, T.StructField("__bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    parsed = rows.withColumn("v", value)
    bad = F.col("v").isNull() | F.col("v.__bad").isNotNull() | ~F.rlike("value", F.lit(r"^\s*\{"))
    if mode == "raise":
        parsed = parsed.withColumn("v", F.when(bad, F.raise_error(F.concat(F.lit("bad JSON line: "), F.substring("value", 1, 80)))).otherwise(F.col("v")))
    elif mode == "all_or_nothing":
        parsed = parsed.join(parsed.filter(bad).select("file").distinct(), "file", "left_anti")
    else:
        parsed = parsed.filter(~bad)
    if limit is not None:
        from pyspark.sql import Window

        parsed = parsed.withColumn("__n", F.row_number().over(Window.partitionBy("file").orderBy("__order"))).filter(F.col("__n") <= limit)
    return parsed.select("file", *(F.col(f"v.{f.name}").alias(f.name) for f in _schema(schema).fields))


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def content_list(docs: DataFrame, id_: str, body: str) -> DataFrame:
    """(id, raw_index, type, text, page_idx, bbox, img_path): rows of a JSON array, counted from 0, objects or not."""
    kind = "array<struct<type:string,text:string,table_body:string,content:string,latex:string,page_idx:int,bbox:array<double>,img_path:string>>"
    rows = docs.select(id_, F.posexplode(F.from_json(body, kind)).alias("raw_index", "r")).filter("r is not null")
    return rows.select(id_, "raw_index", "r.type", F.coalesce("r.text", "r.table_body", "r.latex", "r.content").alias("text"), "r.page_idx", F.when(F.size("r.bbox") == 4, F.col("r.bbox")).alias("bbox"), "r.img_path")


class _Cells(HTMLParser):
    """Rows of (tag, text) of all tables; a nested table adds to the same rows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, str]]] = []
        self.cell: list[str] | None = None
        self.tag = "td"

    def _end(self) -> None:
        if self.cell is not None:
            text = "\n".join(" ".join(part.split()) for part in "".join(self.cell).split("\n"))
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((self.tag, text.strip()))
            self.cell = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self._end()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._end()
            self.cell, self.tag = [], tag
        elif tag == "br" and self.cell is not None:
            self.cell.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._end()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data.replace("\n", " "))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StructType().add("tag", T.StringType()).add("text", T.StringType()))))
def table_rows(html: pd.Series) -> pd.Series:
    """Cells of HTML tables, entities decoded, line breaks kept."""
    out = []
    for source in html:
        parser = _Cells()
        parser.feed(source or "")
        parser.close()
        parser._end()
        out.append([[{"tag": a, "text": b} for a, b in row] for row in parser.rows if row])
    return pd.Series(out)


def plain_cells(html: Column) -> Column:
    """Texts of plain td cells, without a parser: tags to spaces, collapsed."""
    cells = F.regexp_extract_all(html, F.lit("(?s)<td>(.*?)</td>"), F.lit(1))
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")))


def _safe(name: str) -> str | None:
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    return None if ".." in parts or name.startswith("/") else "/".join(parts)


def archive_members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(archive, member, body) of zip and tar archives; unsafe member names and unreadable archives are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, body in zip(batch["archive"], batch["body"], strict=True):
                rows = []
                try:
                    if zipfile.is_zipfile(io.BytesIO(body)):
                        with zipfile.ZipFile(io.BytesIO(body)) as z:
                            rows = [(archive, n, z.read(i)) for i in z.infolist() if not i.is_dir() and (n := _safe(i.filename))]
                    else:
                        with tarfile.open(fileobj=io.BytesIO(body)) as t:
                            rows = [(archive, n, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and (n := _safe(m.name))]
                except (tarfile.TarError, zipfile.BadZipFile, OSError):
                    rows = []
                yield pd.DataFrame(rows, columns=["archive", "member", "body"])

    return files.select(F.col(path).alias("archive"), F.col(content).alias("body")).mapInPandas(run, "archive string, member string, body binary")


def image_size(raw: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF or JPEG; None if it is none or cut off."""
    if not raw:
        return None
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw):
            if raw[at] != 0xFF:
                at += 1
                continue
            kind = raw[at + 1]
            if kind == 0xFF:
                at += 1
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return width, height
            elif kind in (0x01, *range(0xD0, 0xD9)):
                at += 2
            else:
                at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("area", T.LongType()))
def image_dimensions(content: pd.Series) -> pd.DataFrame:
    found = [image_size(None if c is None else bytes(c)) for c in content]
    return pd.DataFrame({"width": pd.array([f[0] if f else None for f in found], "Int32"), "height": pd.array([f[1] if f else None for f in found], "Int32"), "area": pd.array([f[0] * f[1] if f else None for f in found], "Int64")})


@F.pandas_udf(T.ArrayType(T.StructType().add("page_idx", T.IntegerType()).add("type", T.StringType()).add("text", T.StringType()).add("bbox", T.ArrayType(T.DoubleType()))))
def layout_blocks(layout: pd.Series) -> pd.Series:
    """Blocks of a layout JSON: the walk stops at a node that has both a box and a text."""

    def text_of(node: dict) -> str:
        if isinstance(node.get("text"), str):
            return node["text"]
        return " ".join(s.get("content", "") for line in node.get("lines") or [] for s in line.get("spans") or []).strip()

    def box_of(node: dict) -> list[float] | None:
        raw = node.get("bbox") or node.get("poly")
        numbers = [float(x) for x in raw if isinstance(x, (int, float)) and not isinstance(x, bool)] if isinstance(raw, list) else []
        if isinstance(raw, list) and len(numbers) != len(raw):
            return None
        if len(numbers) == 4:
            return numbers
        return [min(numbers[::2]), min(numbers[1::2]), max(numbers[::2]), max(numbers[1::2])] if len(numbers) >= 8 and len(numbers) % 2 == 0 else None

    def walk(node, page: int) -> Iterator[dict]:
        if isinstance(node, list):
            for x in node:
                yield from walk(x, page)
        elif isinstance(node, dict):
            text, box = text_of(node), box_of(node)
            if text and box:
                yield {"page_idx": page, "type": node.get("type") or node.get("category_type"), "text": text, "bbox": box}
            else:
                for key in ("para_blocks", "layout_dets", "blocks"):
                    yield from walk(node.get(key) or [], page)

    out = []
    for source in layout:
        try:
            pages = json.loads(source or "{}").get("pdf_info") or []
        except (ValueError, AttributeError):
            pages = []
        out.append([b for k, p in enumerate(pages) if isinstance(p, dict) for b in walk(p, p.get("page_idx", k))])
    return pd.Series(out)
