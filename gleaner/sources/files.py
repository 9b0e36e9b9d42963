"""Directory scans, routing to extractors, and the text, image and document extractors."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.functions.paths import IMAGE_MIMES, TEXT_EXTENSIONS, TEXT_MIMES, extension, file_name, matches_any, mime_of
from gleaner.functions.text import paragraphs

# What a scan leaves out.
DEFAULT_EXCLUDES = ["**/.git/**", "**/node_modules/**", "**/target/**", "**/__pycache__/**", "**/*.lock", "**/.*"]
EXTRACTED = f"path string, text string, elements array<{schema.ELEMENT}>, images array<struct<data:binary,mime_type:string,caption:string,page:int>>, title string, author string, language string, page_count int, error_message string"


def qualified(spark: SparkSession, root: str) -> str:
    """A folder as Spark writes it in the paths of its files, with scheme and host; plain paths for the local file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub(r"^file:/*", "/", full).rstrip("/")


def scan(spark: SparkSession, root: str, includes: list[str] | None = None, excludes: list[str] | None = None, max_size: int | None = None, content: bool = False, only: str | list[str] | None = None, deep: bool = True) -> DataFrame:
    """Regular files below a folder: ``(path, name, size_bytes, modified_at, mime_type[, content])``.

    Globs match the path below the root. Unreadable folders are skipped. Without ``content``
    no file is opened; ``only`` lists files or folders below the root instead of all, folders without what lies deeper unless ``deep``.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", deep).option("ignoreMissingFiles", True).load(only or root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    df = df.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), *(["content"] if content else []))
    base = qualified(spark, root)
    inner = F.col("path").substr(F.lit(len(base) + 2), F.char_length("path"))
    df = df.where(~matches_any(inner, DEFAULT_EXCLUDES if excludes is None else excludes))
    if includes:
        df = df.where(matches_any(inner, includes))
    if max_size is not None:
        df = df.where(F.col("size_bytes") <= max_size)
    return df.withColumn("name", file_name(F.col("path"))).withColumn("mime_type", mime_of(F.col("path")))


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def extractor_of(path: Column, mime: Column) -> Column:
    """``text``, ``pdf``, ``image`` or null: by MIME type first, then by extension."""
    return (
        F.when(mime.isin(*TEXT_MIMES), "text")
        .when(mime == "application/pdf", "pdf")
        .when(mime.isin(*IMAGE_MIMES), "image")
        .when(extension(path).isin(*TEXT_EXTENSIONS), "text")
        .when(extension(path) == "pdf", "pdf")
    )


def _element(**given: Column) -> Column:
    kinds = dict(x.split(":", 1) for x in ["kind:string", "level:int", "text:string", "language:string", "ordered:boolean", "items:array<string>", "headers:array<string>", "rows:array<array<string>>", "byte_offset:bigint"])
    return F.struct(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def _shape(df: DataFrame) -> DataFrame:
    """The columns of an extraction in order, absent ones null."""
    kinds = spark_schema(df.sparkSession)
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))


def spark_schema(spark: SparkSession):
    return spark.createDataFrame([], EXTRACTED).schema.fields


def extract_text(df: DataFrame) -> DataFrame:
    """``(path, content binary)`` decoded as UTF-8, with paragraphs as elements; bytes that are no UTF-8 give an error row."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    bad = F.when(text.isNull() & F.col("content").isNotNull(), F.lit("not valid UTF-8"))
    rows = df.select("path", text.alias("text"), bad.alias("error_message"))
    elements = F.transform(paragraphs(F.col("text")), lambda p: _element(kind=F.lit("paragraph"), text=p["text"], byte_offset=p["byte_offset"]))
    return _shape(rows.withColumn("elements", elements).withColumn("language", F.nullif(extension(F.col("path")), F.lit(""))))


def image_header(data: bytes) -> tuple[str, int, int] | None:
    """``(format, width, height)`` of PNG, GIF, BMP, JPEG and WebP data."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "bmp", w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return "webp", w & 0x3FFF, h & 0x3FFF
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + size
    return None


def extract_images(df: DataFrame, captioner: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """``(path, content)`` as one line of text with name, size and format, and the bytes kept; a caption if there is a captioner."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(data or b"")
                head, name = image_header(data), path.rsplit("/", 1)[-1]
                if head is None:
                    rows.append((path, None, None, None, "not an image"))
                    continue
                note = captioner(data) if captioner else None
                text = f"Image: {name} ({head[1]}x{head[2]}, {head[0]})" + (f"\n\n{note}" if note else "")
                rows.append((path, text, f"image/{head[0]}", note, None))
            out = pd.DataFrame(rows, columns=["path", "text", "mime", "caption", "error_message"])
            out["data"] = [bytes(x or b"") for x in pdf["content"]]
            yield out

    rows = df.select("path", "content").mapInPandas(run, "path string, text string, mime string, caption string, error_message string, data binary")
    image = F.array(F.struct(F.col("data"), F.col("mime").alias("mime_type"), "caption", F.lit(None).cast("int").alias("page")))
    rows = rows.withColumn("images", F.when(F.col("text").isNotNull(), image)).withColumn("title", file_name(F.col("path")))
    return _shape(rows.withColumn("elements", F.when(F.col("text").isNotNull(), F.array(_element(kind=F.lit("paragraph"), text=F.col("text"), byte_offset=F.lit(0))))))


def extract_pdf(df: DataFrame, reader: Callable[[bytes], list[str]] | None = None, max_bytes: int = 50 << 20, image_reader: Callable[[bytes], list[tuple[bytes, str, int]]] | None = None) -> DataFrame:
    """``(path, content)`` as the text of all pages and the images; what cannot be read gives error rows.

    ``reader`` returns the text of each page and ``image_reader`` ``(data, MIME type, page)`` of each image; without
    them the built-in ones do, and given only a reader there are no images.
    Pages are joined by a blank line; short capitalised paragraphs become headings.
    """
    from gleaner.functions.text import is_title_line, page_estimate
    from gleaner.sources import pdf as built_in

    texts = reader or built_in.page_texts
    pictures = image_reader or (built_in.images if reader is None else lambda _: [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if len(data or b"") > max_bytes:
                    rows.append((path, None, None, None, "too large"))
                    continue
                try:
                    pages = texts(bytes(data or b""))
                    found = [dict(data=d, mime_type=m, caption=None, page=p) for d, m, p in pictures(bytes(data or b""))]
                    rows.append((path, "\n\n".join(pages), len(pages), found, None))
                except Exception as e:  # a reader's failure is the file's, not the job's
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            image = pa.list_(pa.struct([("data", pa.binary()), ("mime_type", pa.string()), ("caption", pa.string()), ("page", pa.int32())]))
            kinds = [pa.string(), pa.string(), pa.int32(), image, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "text", "pages", "images", "error_message"])

    layout = "path string, text string, pages int, images array<struct<data:binary,mime_type:string,caption:string,page:int>>, error_message string"
    rows = df.select("path", "content").mapInArrow(run, layout)
    build = lambda p: _element(kind=F.when(is_title_line(p["text"]), "heading").otherwise("paragraph"), level=F.when(is_title_line(p["text"]), 2), text=F.trim(p["text"]), byte_offset=p["byte_offset"])
    rows = rows.withColumn("elements", F.transform(paragraphs(F.col("text")), build))
    return _shape(rows.withColumn("page_count", F.coalesce("pages", page_estimate(F.col("text")))))


def extract(df: DataFrame, pdf_reader: Callable | None = None, captioner: Callable | None = None) -> DataFrame:
    """Every file through the extractor its type asks for; files that none takes give error rows."""
    rows = df.select("path", "content", extractor_of(F.col("path"), F.col("mime_type")).alias("_x"))
    none = _shape(rows.where(F.col("_x").isNull()).select("path", F.lit("no extractor for this type").alias("error_message")))
    part = lambda x: rows.where(F.col("_x") == x).drop("_x")
    return extract_text(part("text")).unionByName(extract_pdf(part("pdf"), pdf_reader)).unionByName(extract_images(part("image"), captioner)).unionByName(none)


def load_documents(extracted: DataFrame, mime: Column | None = None) -> DataFrame:
    """``(page_content, metadata)``: one document per file and one per element, with source, type, title, author and pages."""
    some = lambda **kv: F.map_filter(F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())
    base = dict(source=F.col("path"), mime_type=mime if mime is not None else mime_of(F.col("path")), title=F.col("title"), author=F.col("author"), page_count=F.col("page_count"))
    whole = extracted.where(F.col("text").isNotNull()).select(F.col("text").alias("page_content"), some(**base).alias("metadata"))
    parts = extracted.withColumn("e", F.explode("elements"))
    parts = parts.select(F.col("e.text").alias("page_content"), some(**base, element_type=F.col("e.kind")).alias("metadata")).where(F.col("page_content").isNotNull())
    return whole.unionByName(parts)
