"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.config import DEFAULT

#: White space as Python's ``str.split`` sees it.
_BLANK = r"(?U)[\s\x1c-\x1f]+"
#: Patterns of a chat transcript that echoes its prompt.
TRANSCRIPT = r"(?is)\bsystem\b.*?\buser\b.*?\bassistant\b[:\s]*(.*)$"
ANSWER = r"(?is)\bassistant\b[:\s]*(.*)$"
LEADING_ANSWER = r"(?is)^\s*assistant[:\s]*(.*)"
#: Texts that stand for something missing.
NO_PAGE = "Page unavailable"
NO_CONTEXT = "No supporting context was retrieved."
NO_HEADING = "No heading"
NO_DESCRIPTION = "No visual description available."
PLACEHOLDER = "*TO_BE_FILLED_BY_VISION_PIPELINE*"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it's used."""
    return F.get(F.transform(F.array(value), then), 0)


def normalize_whitespace(text: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), _BLANK, " "))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(text), r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")


def first_filled(*texts: Column | str) -> Column:
    """The first text that is neither null nor empty; else the last."""
    return F.coalesce(*[F.nullif(col(t), F.lit("")) for t in texts[:-1]], col(texts[-1]))


def tokenize(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9; all else separates."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Words of the normalised text: the tokenizer that needs no model."""
    return let(normalize_whitespace(text), split_words)


def split_words(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def decode(words: Column | str) -> Column:
    return F.array_join(col(words), " ")


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def truncate(text: Column | str, limit: int) -> Column:
    return decode(F.slice(tokens(text), 1, limit))


def ensure_limit(text: Column | str, limit: int = DEFAULT.safe_tokens) -> Column:
    """The normalised text, cut to its first ``limit`` tokens."""
    return let(normalize_whitespace(text), lambda norm: let(split_words(norm), lambda w: F.when(F.size(w) <= limit, norm).otherwise(decode(F.slice(w, 1, limit)))))


def clean_headings(headings: Column | str) -> Column:
    own = F.transform(F.coalesce(col(headings), F.array().cast("array<string>")), normalize_whitespace)
    return F.filter(own, lambda h: h.isNotNull() & (h != ""))


def heading_prefix(headings: Column | str, source_type: Column | str) -> Column:
    """Headings joined by bars, then a line end before a table, else a full stop."""
    end = F.when(col(source_type) == "table", F.lit("\n")).otherwise(F.lit(". "))
    return let(F.array_join(clean_headings(headings), " | "), lambda joined: F.when(joined == "", joined).otherwise(F.concat(joined, end)))


def chunk_text(body: Column | str, headings: Column | str, source_type: Column | str) -> Column:
    own = F.when(col(source_type) == "table", strip(body)).otherwise(normalize_whitespace(body))
    return F.concat(heading_prefix(headings, source_type), own)


def body_budget(prefix: Column | str, limit: int = DEFAULT.safe_tokens, margin: int = DEFAULT.heading_margin) -> Column:
    return F.greatest(F.lit(1), F.lit(limit - margin) - token_count(prefix))


def source_type(text: Column | str, has_table: Column | bool = False, has_picture: Column | bool = False, has_other: Column | bool = True) -> Column:
    """``table``, ``text``, ``text_with_image`` or ``image``; bars and dashes make a table."""
    as_col = lambda x: F.lit(x) if isinstance(x, bool) else x
    table = as_col(has_table) | F.contains(col(text), F.lit("|")) | F.contains(col(text), F.lit("---"))
    return F.when(table, "table").when(~as_col(has_picture), "text").when(as_col(has_other), "text_with_image").otherwise("image")


def citation(pages: Column | str) -> Column:
    own = F.coalesce(col(pages), F.array().cast("array<int>"))
    listed = F.array_join(F.transform(own, lambda p: p.cast("string")), ", ")
    return F.when(F.size(own) == 0, NO_PAGE).when(F.size(own) == 1, F.concat(F.lit("Page "), listed)).otherwise(F.concat(F.lit("Pages "), listed))


def strip_transcript(text: Column | str) -> Column:
    """What follows a system, user, assistant transcript, or the first ``assistant``; else the text."""
    own = strip(text)
    return F.when(own.rlike(TRANSCRIPT), strip(F.regexp_extract(own, TRANSCRIPT, 1))).when(own.rlike(ANSWER), strip(F.regexp_extract(own, ANSWER, 1))).otherwise(own)


def strip_leading_assistant(text: Column | str) -> Column:
    """The normalised text without a leading ``assistant``; null becomes empty."""
    own = normalize_whitespace(F.coalesce(col(text), F.lit("")))
    return F.when(own.rlike(LEADING_ANSWER), strip(F.regexp_extract(own, LEADING_ANSWER, 1))).otherwise(own)


def escape_emphasis(text: Column | str) -> Column:
    return normalize_whitespace(F.replace(col(text), F.lit("*"), F.lit("\\*")))


def match_key(text: Column | str, chars: int | None = DEFAULT.match_chars) -> Column:
    """Text without Markdown marks, for comparing a paragraph with a page's block; its first ``chars`` characters, or all with None."""
    own = F.regexp_replace(col(text), r"[#*_`>|]+", " ")
    own = F.regexp_replace(own, r"(?mU)(?d)^[\s\x1c-\x1f\-]+", "")
    own = F.lower(normalize_whitespace(own))
    return own if chars is None else F.substring(own, 1, chars)


def sha256(content: Column | str) -> Column:
    return F.sha2(col(content).cast("binary"), 256)


def image_key(content: Column | str) -> Column:
    return F.md5(col(content).cast("binary"))


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def display_name(document: Column | str) -> Column:
    """The stem of a document's path; a name that isn't a path stays."""
    return F.when(F.contains(col(document), F.lit("/")), file_stem(document)).otherwise(col(document))


def is_pdf(path: Column | str) -> Column:
    return F.lower(col(path)).endswith(".pdf")


def natural_key(path: Column | str) -> Column:
    """Digit runs as numbers and the rest as text, in order: sorts file stems as people do."""
    parts = F.regexp_extract_all(file_stem(path), F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda p: F.when(p.rlike(r"^\d"), p).otherwise("-1").cast("decimal(38,0)")
    return F.transform(parts, lambda p: F.struct(number(p).alias("n"), F.when(p.rlike(r"^\d"), F.lit("")).otherwise(F.lower(p)).alias("t")))


def page_marker(page: Column | str) -> Column:
    return F.format_string("<!-- page: %d -->", col(page).cast("int"))


def figure_markdown(page: Column | str, number: Column | str, file: Column | str) -> Column:
    label = F.format_string("Figure %d.%d Description:", col(page), col(number))
    return F.concat(label, F.lit("\n\n!["), file_stem(file), F.lit("](../images/"), col(file), F.lit(f")\n\n{PLACEHOLDER}\n"))


def image_file(page: Column | str, number: Column | str) -> Column:
    return F.format_string("page_%d_img_%d.png", col(page), col(number))


def fallback_caption(caption: Column | str, index: Column | str, pages: Column | str) -> Column:
    own = normalize_whitespace(F.coalesce(col(caption), F.lit("")))
    listed = F.array_join(F.transform(F.coalesce(col(pages), F.array().cast("array<int>")), lambda p: p.cast("string")), ", ")
    where = F.when(listed == "", F.lit("from the document.")).otherwise(F.concat(F.lit("from page(s) "), listed, F.lit(".")))
    return F.when(own != "", own).otherwise(F.concat(F.lit("Figure "), (col(index) + 1).cast("string"), F.lit(" extracted "), where))


def image_chunk_body(document: Column | str, image_id: Column | str, description: Column | str) -> Column:
    return F.concat(F.lit("Image description from "), display_name(document), F.lit(". Image "), col(image_id).cast("string"), F.lit(". "), normalize_whitespace(description))


def query_text(question: Column | str, prefix: str = DEFAULT.query_prefix) -> Column:
    return F.concat(F.lit(prefix + " " if prefix else ""), strip(question))


def image_dimensions(width: Column | str, height: Column | str) -> Column:
    return F.concat(col(width).cast("string"), F.lit("x"), col(height).cast("string"), F.lit(" (ratio="), F.format_string("%.2f", col(width) / col(height)), F.lit(")"))


def first_description(annotations: Column | str) -> Column:
    """The first annotation that isn't blank, normalised; else empty."""
    own = F.filter(F.transform(F.coalesce(col(annotations), F.array().cast("array<string>")), normalize_whitespace), lambda a: a != "")
    return F.coalesce(F.get(own, 0), F.lit(""))


def casefold(text: Column | str) -> Column:
    return F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss"))


def lacks(text: Column | str, addition: Column | str) -> Column:
    """Whether ``addition`` isn't blank and isn't in ``text`` already, whatever the case and white space; nulls are empty."""
    plain = lambda c: casefold(normalize_whitespace(F.coalesce(col(c), F.lit(""))))
    return (plain(addition) != "") & ~F.contains(plain(text), plain(addition))


def digit_pages(pages: Column | str) -> Column:
    """Sorted distinct page numbers of those values that are digits."""
    own = F.filter(F.coalesce(col(pages), F.array().cast("array<string>")), lambda p: p.rlike("^[0-9]+$"))
    return F.sort_array(F.array_distinct(F.transform(own, lambda p: p.cast("int"))))


def context_entry(rank: Column | str, document: Column | str, cited: Column | str, kind: Column | str, headings: Column | str, body: Column | str) -> Column:
    own = F.array_join(F.coalesce(col(headings), F.array().cast("array<string>")), " | ")
    return F.concat(F.lit("["), col(rank).cast("string"), F.lit("] "), F.concat_ws(" | ", col(document), col(cited), col(kind), F.when(own == "", NO_HEADING).otherwise(own)), F.lit("\n"), col(body))


def prompt(question: Column | str, context: Column | str) -> Column:
    # fixed values: the wording of the prompt
    return F.concat(
        F.lit("Answer the user's question using only the context below.\n\nQuestion:\n"), col(question),
        F.lit("\n\nContext:\n"), col(context),
        F.lit("\n\nIf the answer is not fully supported by the context, say so clearly."),
    )
