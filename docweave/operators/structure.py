"""Structural chunks from pages of Markdown: paragraphs under their heading, packed up to a size.

The packing approximates a hierarchical chunker: paragraphs of one heading
are taken together until they hold the maximum number of tokens; larger ones
are cut by the token windows later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.config import DEFAULT, Settings
from docweave.functions import text as t
from docweave.operators import chunking

#: A picture in Markdown, and one without words of its own.
SHOWN = r"!\[[^\]]*\]\(([^)]*)\)"
WORDLESS = r"!\[\]\([^)]*\)"


def markdown_items(pages: DataFrame, s: Settings = DEFAULT, pictures: DataFrame | None = None) -> DataFrame:
    """(document_name, item_no, raw_text, headings, source_type, page_numbers) from (document_id, page_no, markdown).

    With ``pictures`` (document_name, image, description) the paragraphs that
    show them, by file name, are followed by their descriptions.
    """
    # a heading is a line of its own, whether or not blank lines are around it
    apart = F.regexp_replace(F.coalesce("markdown", F.lit("")), r"(?m)^[ \t]{0,3}(#{1,6}[ \t]+[^\n]*)$", "\n\n$1\n\n")
    parts = F.posexplode(F.split(apart, r"\n\s*\n"))
    rows = pages.select(F.col("document_id").alias("document_name"), "page_no", parts.alias("at", "part")).where(t.normalize_whitespace("part") != "")
    order = Window.partitionBy("document_name").orderBy("page_no", "at")
    rows = rows.withColumn("no", F.row_number().over(order))
    head = F.regexp_extract("part", r"^\s*#{1,6}\s+(.*?)\s*$", 1)
    rows = rows.withColumn("heading", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("section", F.sum((head != "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(head == "").withColumn("picture", F.contains(F.col("part"), F.lit("![")))
    rows = rows.withColumn("other", t.normalize_whitespace(F.regexp_replace("part", SHOWN, "")) != "")
    if pictures is not None:
        rows = described(rows, pictures, s)
    rows = rows.withColumn("n", t.token_count("part"))
    within = Window.partitionBy("document_name", "section").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pack", F.floor((F.sum("n").over(within) - F.col("n")) / s.max_chunk_tokens))
    own = rows.groupBy("document_name", "section", "pack").agg(
        F.min("no").alias("item_no"),
        F.array_sort(F.collect_list(F.struct("no", "part"))).alias("__p"),
        F.first("heading", ignorenulls=True).alias("heading"),
        F.sort_array(F.collect_set(F.col("page_no").cast("int"))).alias("page_numbers"),
        F.max("picture").alias("picture"),
        F.max("other").alias("other"),
    )
    raw = F.array_join(F.filter(F.transform("__p", lambda x: x["part"]), lambda p: p != ""), "\n\n")
    return own.select("document_name", "item_no", raw.alias("raw_text"), F.when(F.col("heading").isNull(), F.array().cast("array<string>")).otherwise(F.array("heading")).alias("headings"), t.source_type(raw, False, F.col("picture"), F.col("other")).alias("source_type"), "page_numbers")


def described(parts: DataFrame, pictures: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Paragraphs (document_name, page_no, no, part) with the descriptions of the pictures that they show.

    What a paragraph says already isn't added, nor more than two for the
    pictures of a page in a row. Pictures without words of their own leave
    nothing but their description; one without either leaves an empty part.
    """
    files = F.transform(F.regexp_extract_all("part", F.lit(SHOWN), F.lit(1)), lambda p: F.element_at(F.split(p, "/"), -1))
    shown = parts.where("picture").select(F.col("document_name").alias("document_id"), "no", F.col("page_no").cast("string").alias("page_key"), F.col("part").alias("parent_text"), F.posexplode(files).alias("k", "image"))
    # the same picture described twice: one of the texts, whatever the order of the rows
    known = pictures.groupBy(F.col("document_name").alias("document_id"), "image").agg(F.min("description").alias("description"))
    runs = chunking.picture_runs(shown.withColumn("item_no", F.struct("no", "k")).join(known, ["document_id", "image"], "left"), s)
    said = runs.where("appended").groupBy(F.col("document_id").alias("__d"), F.col("no").alias("__no")).agg(F.array_sort(F.collect_list(F.struct("k", chunking.picture_words("description").alias("w")))).alias("__s"))
    met = parts.join(said, (F.col("document_name") == F.col("__d")) & (F.col("no") == F.col("__no")), "left")
    plain = F.when(F.col("picture"), t.strip(F.regexp_replace("part", WORDLESS, ""))).otherwise(F.col("part"))
    whole = F.concat_ws("\n", F.nullif(plain, F.lit("")), F.array_join(F.transform("__s", lambda x: x["w"]), "\n"))
    return met.withColumn("part", whole).drop("__d", "__no", "__s")


def _echoes() -> Column:
    return (F.col("source_type") == "image") & F.col("raw_text").rlike(t.TRANSCRIPT)


def repair_transcripts(chunks: DataFrame) -> DataFrame:
    """Image chunks that echo a chat transcript get their text again from what follows it; ids stay."""
    bad = _echoes()
    clean = t.strip_transcript("raw_text")
    again = t.ensure_limit(t.chunk_text(clean, "headings", "source_type"))
    return chunks.withColumn("text", F.when(bad, again).otherwise(F.col("text"))).withColumn("raw_text", F.when(bad, clean).otherwise(F.col("raw_text")))


def to_repair(chunks: DataFrame) -> DataFrame:
    return chunks.where(_echoes())


def needs_repair(chunks: DataFrame) -> bool:
    return to_repair(chunks).limit(1).count() > 0
