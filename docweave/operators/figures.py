"""Figures: filters, greedy de-duplication, occurrence limits, placement, gap filling, caption filling."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.config import DEFAULT, Settings
from docweave.functions import text as t
from docweave.models import BROKEN_DEVICE


def clip(regions: DataFrame, s: Settings = DEFAULT, raster_side: float = 80, vector_side: float = 120) -> DataFrame:
    """Regions cut to their page; empty and small ones go, vector clusters by a higher bound."""
    own = regions.withColumn("x0", F.greatest("x0", F.lit(0.0))).withColumn("y0", F.greatest("y0", F.lit(0.0)))
    own = own.withColumn("x1", F.least("x1", "page_width")).withColumn("y1", F.least("y1", "page_height"))
    side = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return own.where(side >= F.when(F.col("kind") == "vector", vector_side).otherwise(raster_side))


def keep_figures(regions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Regions that are large enough, not too elongated, and not the page itself."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    shape = F.greatest(w / h, h / w) <= s.max_aspect
    page = w * h <= s.max_page_share * F.col("page_width") * F.col("page_height")
    return regions.where((F.least(w, h) >= s.min_figure_side) & shape & page)


def _area(r: Column) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def greedy_dedup(regions: DataFrame, s: Settings = DEFAULT, keys: tuple[str, ...] = ("document_id", "page_no")) -> DataFrame:
    """Regions of a page in order, rasters first, without those that a kept one covers by most of the smaller area.

    The fold runs over one page's regions, never over a document's.
    """
    first = F.when(F.col("kind") == "vector", 1).otherwise(0)
    row = F.struct(first.alias("o"), "region_no", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("kind"))
    pages = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__r"))

    def overlaps(a: Column, b: Column) -> Column:
        w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
        h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        smaller = F.least(_area(a), _area(b))
        return (w > 0) & (h > 0) & (smaller > 0) & (w * h / smaller > s.overlap_share)

    kind = f"array<struct<o:int,region_no:{regions.schema['region_no'].dataType.simpleString()},x0:double,y0:double,x1:double,y1:double,kind:string>>"
    kept = F.aggregate("__r", F.array().cast(kind), lambda out, r: F.when(F.exists(out, lambda k: overlaps(k, r)), out).otherwise(F.concat(out, F.array(r))))
    return pages.select(*keys, F.explode(kept).alias("__k")).select(*keys, *[f"__k.{c}" for c in ("region_no", "kind", "x0", "y0", "x1", "y1")])


def limit_occurrences(figures: DataFrame, key: str, order: list[str], s: Settings = DEFAULT, document: str = "document_id") -> DataFrame:
    """The first few occurrences of each image of a document: adds ``occurrence``."""
    place = F.row_number().over(Window.partitionBy(document, key).orderBy(*order))
    return figures.withColumn("occurrence", place).where(F.col("occurrence") <= s.image_repeats)


def number_figures(figures: DataFrame, order: list[str], keys: tuple[str, ...] = ("document_id", "page_no")) -> DataFrame:
    """Numbers from 1 on each page, for what the filters left."""
    return figures.withColumn("figure_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fill_anchors(rows: DataFrame, anchor: str, order: str, keys: tuple[str, ...] = ("document_id", "page_no")) -> DataFrame:
    """Unknown anchors take the last known one, else the page's first, else 0."""
    by = Window.partitionBy(*keys).orderBy(order)
    before = F.last(anchor, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    any_ = F.first(anchor, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(anchor, F.coalesce(before, any_, F.lit(0.0)))


def place_figures(figures: DataFrame, paragraphs: DataFrame, keys: tuple[str, ...] = ("document_id", "page_no")) -> DataFrame:
    """Each figure's paragraph: the last one, by index, whose anchor isn't below the figure's top; else -1."""
    right = paragraphs.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("paragraph_no"), F.col("anchor"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("anchor") <= F.col("y0")]
    met = figures.join(right, on, "left")
    return met.groupBy(*figures.columns).agg(F.coalesce(F.max("paragraph_no"), F.lit(-1)).alias("paragraph_no"))


def insert_figures(paragraphs: DataFrame, placed: DataFrame, keys: tuple[str, ...] = ("document_id", "page_no")) -> DataFrame:
    """One text a page: its paragraphs that aren't blank, each followed by its figures' Markdown from top to bottom."""
    rows = paragraphs.where(t.normalize_whitespace("text") != "").select(*keys, F.struct(F.col("paragraph_no").alias("p"), F.lit(-1e18).alias("y"), F.lit(0).alias("n"), F.col("text").alias("m")).alias("__s"))
    number = F.col("figure_no") if "figure_no" in placed.columns else F.lit(0)
    rows = rows.unionByName(placed.select(*keys, F.struct(F.col("paragraph_no").alias("p"), F.col("y0").cast("double").alias("y"), number.alias("n"), F.col("markdown").alias("m")).alias("__s")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("__s")), lambda x: x["m"]), "\n\n").alias("markdown"))


def closest():
    """The search for the text in ``blocks`` that ``paragraph`` resembles most.

    It returns the text's place, the first if several are alike, and the
    ratio; None without blocks. The ratio is the standard library's, which
    depends on the order of its texts. It can't pass what the texts' characters
    have in common, whatever their order; blocks are tried by that bound until
    none left can win. Made inside a function, so workers needn't import this.
    """
    from collections import Counter
    from difflib import SequenceMatcher

    def search(paragraph: str, blocks: list[str]) -> tuple[int, float] | None:
        own, best = Counter(paragraph), None
        first = {b: i for i, b in reversed(list(enumerate(blocks)))}
        bounds = [(-2.0 * (own & Counter(b)).total() / n if (n := len(paragraph) + len(b)) else -1.0, i) for b, i in first.items()]
        for bound, i in sorted(bounds):
            if best and (bound, i) > best:
                break
            found = (-SequenceMatcher(None, paragraph, blocks[i]).ratio(), i)
            best = min(best or found, found)
        return best and (best[1], -best[0])

    return search


def _closest(paragraphs: Column, blocks: Column) -> Column:
    """``closest`` for each of a page's paragraphs: structs of the block's place from 0 and the ratio, null without blocks."""
    from pyspark.sql.functions import pandas_udf

    search = closest()

    @pandas_udf("array<struct<place:int,ratio:double>>")
    def best(paragraphs, blocks):
        import pandas as pd

        return pd.Series([[(m := search(p, list(bs))) and {"place": m[0], "ratio": m[1]} for p in ps] for ps, bs in zip(paragraphs, blocks)], dtype=object)

    return best(paragraphs, blocks)


def match_blocks(paragraphs: DataFrame, blocks: DataFrame, s: Settings = DEFAULT, keys: tuple[str, ...] = ("document_id", "page_no")) -> DataFrame:
    """(keys, paragraph_no, anchor, ratio): the top of the block that a paragraph resembles most, null under the threshold.

    Paragraphs and blocks of the same page are compared, on their whole
    Markdown-free text; the first block wins ties. Image blocks and blank ones
    don't count.

    Rows are dealt once by page. A block of the paragraph's own text has ratio
    1, which no other text reaches; only pages with a paragraph that has no
    such block are collected and searched.
    """
    tops = F.struct((-F.col("block_no")).alias("n"), F.col("y0").alias("y"))
    own = blocks.where(F.col("block_type") == 0).select(*keys, t.match_key("text", None).alias("__t"), tops.alias("__b"))
    left = paragraphs.select(*keys, t.match_key("text", None).alias("__t"), F.struct("paragraph_no").alias("__p"))
    rows = left.unionByName(own, allowMissingColumns=True).repartition(*keys)
    # blanks go here, where their key is known: a filter further down would compute it twice
    filled = F.coalesce(F.col("__t") != "", F.lit(False))
    rows = rows.withColumn("__equal", F.when(filled, F.max("__b").over(Window.partitionBy(*keys, "__t"))))
    rows = rows.withColumn("__lone", F.col("__p").isNotNull() & F.col("__equal").isNull() & filled)
    rows = rows.withColumn("__some", F.max("__lone").over(Window.partitionBy(*keys)))

    met = rows.where(F.col("__p").isNotNull() & ~F.col("__lone"))
    met = met.select(*keys, "__p.paragraph_no", F.col("__equal.y").alias("__y"), F.when(F.col("__equal").isNotNull(), F.lit(1.0)).alias("ratio"))
    texts = lambda where, c: F.sort_array(F.collect_list(F.when(where, F.struct(F.col(c).alias("r"), F.col("__t").alias("t")))), asc=False)
    pages = rows.where("__some").groupBy(*keys).agg(texts(F.col("__lone"), "__p").alias("__ps"), texts(F.col("__b").isNotNull() & filled, "__b").alias("__bs"))
    pages = pages.withColumn("__m", _closest(F.col("__ps.t"), F.col("__bs.t")))
    pages = pages.select(*keys, "__bs", F.explode(F.arrays_zip(F.col("__ps.r").alias("p"), F.col("__m").alias("m"))).alias("__x"))
    found = pages.select(*keys, "__x.p.paragraph_no", F.get(F.col("__bs.r"), F.col("__x.m.place"))["y"].alias("__y"), F.col("__x.m.ratio").alias("ratio"))
    return met.unionByName(found).select(*keys, "paragraph_no", F.when(F.col("ratio") >= s.min_match, F.col("__y")).alias("anchor"), "ratio")


def last_marker(lines: DataFrame, document: str = "document_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """Each line with the page of the last marker at or before it; null before the first."""
    page = F.nullif(F.regexp_extract(text, r"^<!-- page: (\d+) -->$", 1), F.lit("")).cast("int")
    by = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("page_no", F.last(page, ignorenulls=True).over(by))


def fill_captions(markdown: DataFrame, captions: DataFrame, look: int = 5) -> DataFrame:
    """Markdown (document_id, markdown) with placeholders filled from captions (document_id, image, description).

    An image's line is the first that shows it; the first placeholder in the
    ``look`` lines after it is replaced by the escaped description in italics.
    """
    lines = markdown.select("document_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    shown = F.concat(F.lit("!["), t.file_stem("image"), F.lit("](../images/"), F.col("image"), F.lit(")"))
    wanted = captions.select(F.col("document_id").alias("__d"), shown.alias("__l"), "description")
    at = lines.join(wanted, (F.col("document_id") == F.col("__d")) & (F.trim("line") == F.col("__l")))
    at = at.groupBy("__d", "__l").agg(F.min_by(F.struct("line_no", "description"), "line_no").alias("__m")).select("__d", F.col("__m.line_no").alias("__i"), F.col("__m.description").alias("description"))
    free = lines.where(F.trim("line") == t.PLACEHOLDER).select(F.col("document_id"), "line_no")
    reach = at.withColumn("__j", F.explode(F.sequence(F.col("__i") + 1, F.col("__i") + look)))
    hit = reach.join(free, (F.col("__d") == F.col("document_id")) & (F.col("__j") == F.col("line_no"))).groupBy("__d", "__i").agg(F.min("line_no").alias("__n"), F.first("description").alias("description"))
    hit = hit.groupBy(F.col("__d"), F.col("__n")).agg(F.min_by("description", "__i").alias("__t"))
    text = F.coalesce(F.nullif(t.strip_leading_assistant("__t"), F.lit("")), F.lit(t.NO_DESCRIPTION))
    new = F.when(F.col("__n").isNotNull(), F.concat(F.lit("*"), t.escape_emphasis(text), F.lit("*"))).otherwise(F.col("line"))
    out = lines.join(hit, (F.col("document_id") == F.col("__d")) & (F.col("line_no") == F.col("__n")), "left").select("document_id", "line_no", new.alias("line"))
    return out.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def poison_after(captions: DataFrame, order: str = "image_no", document: str = "document_id") -> DataFrame:
    """Captions after an error that leaves the device broken are marked for another try."""
    bad = reduce(or_, [F.contains(F.col("error"), F.lit(mark)) for mark in BROKEN_DEVICE])
    by = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.max(F.coalesce(bad, F.lit(False)).cast("int")).over(by) == 1
    # fixed value: the mark
    return captions.withColumn("description", F.when(mark, F.lit("SKIPPED_GPU_CONTEXT_CORRUPTED - needs reprocessing")).otherwise(F.col("description")))


def describe_pictures(pictures: DataFrame, captions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Pictures (document_id, image_id, width, height, caption, page_numbers) with descriptions and their origin.

    Small pictures get none. Without a model's description the caption, or
    a sentence made from the pages, stands in.
    """
    big = pictures.where((F.col("width") >= s.min_picture_side) & (F.col("height") >= s.min_picture_side))
    met = big.join(captions.select("document_id", "image_id", t.strip_transcript("description").alias("__d")), ["document_id", "image_id"], "left")
    own = F.nullif("__d", F.lit(""))
    text = F.coalesce(own, t.fallback_caption("caption", "image_id", "page_numbers"))
    origin = F.when(own.isNotNull(), "vision_pipeline:model").otherwise("vision_pipeline:fallback-caption")
    return met.withColumn("description", text).withColumn("provenance", origin).drop("__d")
