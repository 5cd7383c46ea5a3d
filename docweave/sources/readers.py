"""Readers: PDF and image files, page batches, parser plug-ins, metadata, indexes."""

from __future__ import annotations

import hashlib
from pathlib import PurePosixPath
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave import schema
from docweave.config import DEFAULT, Settings
from docweave.functions import text as t


class PageParser(Protocol):
    """Turns a document's bytes into pages of Markdown; raises for a range that it can't read."""

    def page_count(self, content: bytes) -> int: ...

    def pages(self, content: bytes, first: int, last: int) -> list[str]: ...


class LayoutParser(PageParser, Protocol):
    """A parser that also knows where things are on a page; sizes in points, boxes as (x0, y0, x1, y1).

    It may have ``caption(content, page, box)``, the words that the document
    itself puts to a figure, or None.
    """

    def page_size(self, content: bytes, page: int) -> tuple[float, float]: ...

    def blocks(self, content: bytes, page: int) -> list[tuple[int, tuple[float, float, float, float], str]]:
        """(type, box, text) in reading order; type 0 is text."""

    def rasters(self, content: bytes, page: int) -> list[tuple[float, float, float, float]]: ...

    def vectors(self, content: bytes, page: int) -> list[tuple[float, float, float, float]]: ...

    def render(self, content: bytes, page: int, box: tuple[float, float, float, float], scale: float) -> tuple[bytes, int, int] | None:
        """(PNG, width, height), or None if the box is empty."""


class FormFeedParser:
    """Parser for plain text whose pages end with form feeds; stands in where no PDF library is there."""

    def page_count(self, content: bytes) -> int:
        return content.count(b"\f") + 1

    def pages(self, content: bytes, first: int, last: int) -> list[str]:
        return content.decode("utf-8").split("\f")[first - 1 : last]


def check_input(spark: SparkSession, path: str) -> str:
    """``path`` if it's a PDF that exists, in any store that Spark reads."""
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"unsupported file type: {path}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isFile())


def read_files(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(document_id, path, modificationTime, length, content, document_hash)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.withColumn("document_id", t.file_stem("path")).withColumn("document_hash", t.sha256("content"))


def page_batches(counts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Batches of pages, first and last from 1, for (document_id, page_count)."""
    first = F.explode(F.sequence(F.lit(1), F.col("page_count"), F.lit(s.page_batch)))
    return counts.where("page_count > 0").withColumn("first", first).withColumn("last", F.least("page_count", F.col("first") + s.page_batch - 1))


def parse_range(parser: PageParser, content: bytes, first: int, last: int, strict: bool) -> list[tuple[int, str | None, str | None]]:
    """(page, Markdown, error); a failing range is halved down to single pages, where strict parsing raises."""
    try:
        return [(first + i, p, None) for i, p in enumerate(parser.pages(content, first, last))]
    except Exception as e:
        if first == last:
            if strict:
                raise RuntimeError(f"page {first} can't be parsed") from e
            return [(first, None, str(e))]
        middle = first + (last - first) // 2
        return parse_range(parser, content, first, middle, strict) + parse_range(parser, content, middle + 1, last, strict)


def parse_pages(files: DataFrame, parser: PageParser | None = None, strict: bool = True, s: Settings = DEFAULT, whole: bool = False) -> DataFrame:
    """Pages of Markdown, a task's documents one by one.

    The parser gets a batch of pages at a time, or with ``whole`` a document
    at once, so that heading levels agree across its pages; a range that
    can't be read is halved either way.
    """
    parser = parser or FormFeedParser()

    def work(batches):
        for b in batches:
            out = []
            for key, content in zip(b["document_id"], b["content"]):
                n = parser.page_count(content)
                step = max(n, 1) if whole else s.page_batch
                for first in range(1, n + 1, step):
                    out += [(key, *row) for row in parse_range(parser, content, first, min(n, first + step - 1), strict)]
            yield pd.DataFrame(out, columns=["document_id", "page_no", "markdown", "error"])

    return files.select("document_id", "content").mapInPandas(work, schema.PAGES)


def marked_lines(pages: DataFrame) -> DataFrame:
    """(document_id, line_no, line): each page's marker, then its lines; order by (page, line)."""
    text = F.concat(t.page_marker("page_no"), F.lit("\n\n"), F.coalesce("markdown", F.lit("")))
    rows = pages.select("document_id", "page_no", F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return rows.select("document_id", F.struct("page_no", "at").alias("line_no"), "line")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG files with ``image_no`` in natural order of their names, numbered within each folder."""
    from pyspark.sql import Window

    rows = read_files(spark, path, "*.png").withColumn("image", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return rows.withColumn("image_no", F.row_number().over(Window.partitionBy("folder").orderBy(t.natural_key("image"))))


def parse_blocks(files: DataFrame, parser: LayoutParser) -> DataFrame:
    """Text blocks of all pages, numbered in reading order; images and blank blocks are left out."""

    def work(batches):
        for b in batches:
            for key, content in zip(b["document_id"], b["content"]):
                out = []
                for page in range(1, parser.page_count(content) + 1):
                    for i, (kind, box, text) in enumerate(parser.blocks(content, page)):
                        if kind == 0 and text.strip():
                            out.append((key, page, i, kind, *map(float, box), text))
                yield pd.DataFrame(out, columns=["document_id", "page_no", "block_no", "block_type", "x0", "y0", "x1", "y1", "text"])

    return files.select("document_id", "content").mapInPandas(work, schema.TEXT_BLOCKS)


def _boxes(find, content: bytes, page: int) -> list:
    """Boxes of one kind; a page whose boxes can't be found has none."""
    try:
        return list(find(content, page))
    except Exception:
        return []


def parse_regions(files: DataFrame, parser: LayoutParser) -> DataFrame:
    """Raster images, then clusters of drawings, of all pages, as ``clip`` takes them."""

    def work(batches):
        for b in batches:
            for key, content in zip(b["document_id"], b["content"]):
                out = []
                for page in range(1, parser.page_count(content) + 1):
                    size = tuple(map(float, parser.page_size(content, page)))
                    found = [("raster", r) for r in _boxes(parser.rasters, content, page)] + [("vector", r) for r in _boxes(parser.vectors, content, page)]
                    out += [(key, page, kind, i, *map(float, box), *size) for i, (kind, box) in enumerate(found)]
                yield pd.DataFrame(out, columns=["document_id", "page_no", "kind", "region_no", "x0", "y0", "x1", "y1", "page_width", "page_height"])

    return files.select("document_id", "content").mapInPandas(work, schema.REGIONS)


def render_regions(files: DataFrame, regions: DataFrame, parser: LayoutParser, s: Settings = DEFAULT) -> DataFrame:
    """(document_id, page_no, region_no, x0, y0, x1, y1, image, width, height, caption) of what can be rendered.

    A document's boxes go to its bytes, which move once however many figures
    it has; figures leave one at a time.
    """
    boxes = F.array_sort(F.collect_list(F.struct("page_no", "region_no", "x0", "y0", "x1", "y1")))
    met = files.select("document_id", "content").join(regions.groupBy("document_id").agg(boxes.alias("boxes")), "document_id")
    names = ["document_id", "page_no", "region_no", "x0", "y0", "x1", "y1", "image", "width", "height", "caption"]
    own_words = getattr(parser, "caption", lambda content, page, box: None)

    def work(batches):
        for b in batches:
            for key, content, own in zip(b["document_id"], b["content"], b["boxes"]):
                for r in own:
                    box = (r["x0"], r["y0"], r["x1"], r["y1"])
                    made = sized(lambda scale, page=int(r["page_no"]), box=box: parser.render(content, page, box, scale), s)
                    if made:
                        yield pd.DataFrame([(key, r["page_no"], r["region_no"], *box, *made, own_words(content, int(r["page_no"]), box))], columns=names)

    return met.mapInPandas(work, "document_id string, page_no int, region_no int, x0 double, y0 double, x1 double, y1 double, image binary, width int, height int, caption string")


def sized(render, s: Settings = DEFAULT) -> tuple[bytes, int, int] | None:
    """(png, width, height) from ``render(scale)``: twice the size, smaller if over the limit, None if tiny."""
    made = render(2.0)
    if made and max(made[1:]) > s.max_pixels:
        made = render(2.0 * s.max_pixels / max(made[1:]))
    return None if not made or min(made[1:]) < s.min_pixels else made


def render_figures(regions: DataFrame, render, s: Settings = DEFAULT) -> DataFrame:
    """Adds ``image`` from ``render(row, scale) -> (png, width, height) | None``: twice the size, smaller if over the limit, null if tiny."""
    out_schema = T.StructType([*regions.schema.fields, T.StructField("image", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])

    def work(batches):
        for b in batches:
            got = [sized(lambda scale, row=row: render(row, scale), s) or (None, None, None) for row in b.to_dict("records")]
            yield b.assign(image=[g[0] for g in got], width=pd.array([g[1] for g in got], "Int32"), height=pd.array([g[2] for g in got], "Int32"))

    return regions.mapInPandas(work, out_schema)


def first_raster(candidates: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first provenance that has an image, else none, for each picture."""
    return candidates.groupBy(*key).agg(F.min_by("image", F.when(F.col("image").isNotNull(), F.col(order))).alias("image"))


def read_image_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """Image records of JSON lists; None if the path is missing or nothing in it can be read."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(schema.IMAGES + ", _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", "true").json(path)
    rows = rows.where("_corrupt_record IS NULL").drop("_corrupt_record")
    rows = rows.where(F.coalesce(F.col("image"), F.col("image_path"), F.col("description")).isNotNull())
    return rows if rows.limit(1).count() else None


def metadata_hash(spark: SparkSession, path: str) -> str | None:
    """What tells whether image metadata changed: a file's SHA-256, or one of all files in a folder; None if there is none."""
    if not exists(spark, path):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", t.sha256("content").alias("h"))
    # the files' hashes, whatever their order: few numbers however many there are
    key = F.concat_ws(" ", "path", "h")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h"), *[F.bit_xor(F.xxhash64(F.lit(i), key)).alias(f"x{i}") for i in range(4)]).first()
    if row["n"] <= 1:
        return row["h"]
    return hashlib.sha256(repr(tuple(row[f"x{i}"] for i in range(4))).encode()).hexdigest()


def read_questions(lines: list[str]) -> list[str]:
    """Questions up to ``exit`` or ``quit``, without blank ones."""
    out = []
    for line in map(str.strip, lines):
        if line.lower() in ("exit", "quit"):
            break
        if line:
            out.append(line)
    return out


def resolve(spark: SparkSession, path: str | None, default: str | None = None) -> str:
    """``path`` if given and there, else the default, else FileNotFoundError."""
    for p in (path,) if path else (default,):
        if p and exists(spark, p):
            return p
    raise FileNotFoundError(path or default or "no document")


def stem(path: str) -> str:
    return PurePosixPath(path).stem
