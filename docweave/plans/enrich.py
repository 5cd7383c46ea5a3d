"""The Markdown path: documents to Markdown in which figures stand near their text, with captions of a vision model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.config import DEFAULT, Settings
from docweave.functions import text as t
from docweave.functions.lineage import cut
from docweave.operators import figures
from docweave.sources import readers, stores, writers

PAGE = ("document_id", "page_no")


def figure_regions(regions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Boxes that are worth a figure: clipped, filtered, and each place of a page taken once."""
    return figures.greedy_dedup(figures.keep_figures(figures.clip(regions, s), s), s)


def named_figures(rendered: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Rendered figures with their number on the page, file name and Markdown; images repeated too often go.

    Rows are dealt once by document, which both the repeats and the numbers
    are counted within.
    """
    order = ["y0", "x0", "region_no"]
    own = rendered.withColumn("image_hash", t.image_key("image")).repartition("document_id")
    own = figures.limit_occurrences(own, "image_hash", ["page_no", *order], s)
    own = figures.number_figures(own, order)
    own = own.withColumn("file", t.image_file("page_no", "figure_no"))
    return own.withColumn("markdown", t.figure_markdown("page_no", "figure_no", "file"))


def placed_pages(pages: DataFrame, blocks: DataFrame, found: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Pages (document_id, page_no, markdown) with figures (page, y0, figure_no, markdown) after the text above them.

    Only pages with figures are taken apart; the others keep their Markdown
    but for white space at the end.
    """
    pages = pages.select(*PAGE, F.regexp_replace(F.coalesce("markdown", F.lit("")), r"\s+$", "").alias("markdown"))
    own = found.select(*PAGE, "y0", "figure_no", "markdown")
    with_figures = own.select(*PAGE).distinct()
    parts = F.posexplode(F.split("markdown", r"\n\s*\n"))
    paragraphs = cut(pages.join(with_figures, list(PAGE), "left_semi").select(*PAGE, parts.alias("paragraph_no", "text")))
    anchors = figures.match_blocks(paragraphs, blocks.join(with_figures, list(PAGE), "left_semi"), s)
    anchors = figures.fill_anchors(anchors, "anchor", "paragraph_no")
    placed = figures.place_figures(own, anchors)
    made = figures.insert_figures(paragraphs, placed)
    return pages.join(with_figures, list(PAGE), "left_anti").unionByName(made)


def whole_markdown(pages: DataFrame) -> DataFrame:
    """(document_id, markdown): each page's marker, its text and an empty line."""
    text = F.concat(t.page_marker("page_no"), F.lit("\n"), "markdown", F.lit("\n"))
    return writers.ordered_text(pages.select(*PAGE, text.alias("text")), "document_id", "page_no", "text", "\n").withColumnRenamed("value", "markdown")


def captioned(found: DataFrame, captioner) -> DataFrame:
    """(document_id, image, description): captions in natural order of the file names, by ``captioner``.

    A failure costs its own image's caption only, unless it broke the device.
    """
    natural = F.row_number().over(Window.partitionBy("document_id").orderBy(t.natural_key("image")))
    seen = found.select("document_id", F.col("file").alias("image"), captioner.describe(F.col("image")).alias("c"))
    rows = cut(seen.select("document_id", "image", "c.description", "c.error")).withColumn("image_no", natural)
    rows = figures.poison_after(rows)
    own = F.coalesce(F.nullif(t.strip_leading_assistant("description"), F.lit("")), F.lit(t.NO_DESCRIPTION))
    return rows.select("document_id", "image", own.alias("description"))


def picture_records(files: DataFrame, parser, captioner, s: Settings = DEFAULT) -> DataFrame:
    """Described figures as ``chunking.image_records`` takes them, numbered from 0 within each document, with their places.

    Small pictures are left out; one without a model's words gets its own
    caption, or else a sentence that says where it's from.
    """
    found = named_figures(readers.render_regions(files, figure_regions(readers.parse_regions(files, parser), s), parser, s), s)
    seen = found.select("document_id", "page_no", "y0", "figure_no", "file", "width", "height", "caption", captioner.describe(F.col("image")).alias("c"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("page_no", "figure_no")) - 1
    rows = cut(seen.select("document_id", "page_no", "y0", "figure_no", "file", "width", "height", "caption", "c.description", "c.error")).withColumn("image_id", number)
    rows = figures.poison_after(rows, "image_id").withColumn("page_numbers", F.array("page_no"))
    own = figures.describe_pictures(rows.drop("description", "error"), rows.select("document_id", "image_id", "description"), s)
    pages = F.transform("page_numbers", lambda p: p.cast("string"))
    return own.select(F.col("document_id").alias("document_name"), F.col("image_id").alias("image_no"), "image_id", F.col("file").alias("image_path"), "description", pages.alias("page_numbers"), "page_no", "y0", "figure_no")


def shown_pages(pages: DataFrame, files: DataFrame, pictures: DataFrame, parser, s: Settings = DEFAULT) -> DataFrame:
    """Pages in which pictures of ``picture_records`` that the Markdown doesn't show are shown after the text above them."""
    own = pictures.select(F.col("document_name").alias("document_id"), "page_no", "y0", "figure_no", F.col("image_path").alias("__f"))
    met = own.join(pages.select(*PAGE, F.col("markdown").alias("__m")), list(PAGE))
    lacking = met.where(~F.contains(F.coalesce("__m", F.lit("")), F.col("__f"))).withColumn("markdown", F.concat(F.lit("![]("), "__f", F.lit(")")))
    return placed_pages(pages, readers.parse_blocks(files, parser), cut(lacking.select(*PAGE, "y0", "figure_no", "markdown")), s)


def enrich(spark: SparkSession, path: str, out: str, parser, captioner=None, pattern: str = "*.[pP][dD][fF]", s: Settings = DEFAULT, clean: bool = True) -> DataFrame:
    """Writes ``figures``, ``images``, ``image_metadata``, ``markdown`` and ``documents`` below ``out``, in place of what an earlier run left; returns the Markdown.

    Without a captioner the placeholders stay for a later pass. Without
    ``clean`` files of an earlier run stay beside the new ones.
    """
    files = readers.read_files(spark, path, pattern)
    regions = figure_regions(readers.parse_regions(files, parser), s)
    writers.write_images(named_figures(readers.render_regions(files, regions, parser, s), s), f"{out}/figures")
    found = spark.read.parquet(f"{out}/figures")
    text = whole_markdown(placed_pages(cut(readers.parse_pages(files, parser, True, s, whole=True)), readers.parse_blocks(files, parser), found, s))
    records = found.select("document_id", F.col("page_no").alias("page"), F.col("file").alias("image"), F.array("x0", "y0", "x1", "y1").alias("bbox"))
    if captioner is not None:
        captions = cut(captioned(found, captioner))
        text = figures.fill_captions(text, captions)
        records = writers.merge_metadata(records, captions, ["document_id", "image"])
    writers.write_metadata(records, f"{out}/image_metadata")
    writers.write_table(text, f"{out}/markdown")
    done = spark.read.parquet(f"{out}/markdown")
    files_of = {
        "images": found.select(F.concat_ws("/", "document_id", "file").alias("file"), "image"),
        "documents": done.select(F.concat("document_id", F.lit(".md")).alias("file"), F.col("markdown").cast("binary").alias("image")),
    }
    for folder, rows in files_of.items():
        if clean:
            stores.remove(f"{out}/{folder}")
        writers.export_images(rows, f"{out}/{folder}").write.format("noop").mode("overwrite").save()
    return done
