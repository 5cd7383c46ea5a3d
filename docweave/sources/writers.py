"""Writers: documents as JSON, Markdown and text; index tables; images; metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_text(rows: DataFrame, key: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """One text for each ``key``, its parts in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), separator).alias("value"))


def write_documents(pages: DataFrame, folder: str) -> None:
    """``json``, ``markdown`` and ``text`` below ``folder``; text has no Markdown marks."""
    pages.write.mode("overwrite").json(f"{folder}/json")
    whole = ordered_text(pages, "document_id", "page_no", "markdown")
    whole.write.mode("overwrite").partitionBy("document_id").text(f"{folder}/markdown")
    plain = whole.withColumn("value", F.regexp_replace(F.regexp_replace("value", r"(?m)^#+\s*", ""), r"[*_`]+", ""))
    plain.write.mode("overwrite").partitionBy("document_id").text(f"{folder}/text")


def write_markdown(markdown: DataFrame, folder: str) -> None:
    markdown.select("document_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("document_id").text(folder)


def write_images(figures: DataFrame, folder: str) -> None:
    """Figures with their bytes and file names as a table; ``export_images`` makes files of it."""
    figures.where("image IS NOT NULL").write.mode("overwrite").parquet(folder)


def export_images(figures: DataFrame, folder: str) -> DataFrame:
    """Writes each figure's bytes to ``folder/file`` from the executors; returns the paths."""
    from docweave.sources.stores import open_store

    def work(batches):
        import pandas as pd

        for b in batches:
            paths = []
            for name, image in zip(b["file"], b["image"]):
                store, local = open_store(f"{folder}/{name}")
                store.create_dir(local.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(local) as out:
                    out.write(image)
                paths.append(f"{folder}/{name}")
            yield pd.DataFrame({"path": paths})

    return figures.where("image IS NOT NULL").select("file", "image").mapInPandas(work, "path string")


def write_metadata(images: DataFrame, path: str) -> None:
    """All image records as one table; a later pass adds columns and loses none."""
    images.write.mode("overwrite").parquet(path)


def merge_metadata(first: DataFrame, later: DataFrame, key: list[str]) -> DataFrame:
    """Both passes' fields by ``key``; the later pass's value wins where it has one."""
    both = [c for c in later.columns if c in first.columns and c not in key]
    right = later.select(*key, *[F.col(c).alias(f"__{c}") if c in both else F.col(c) for c in later.columns if c not in key])
    met = first.join(right, key, "full")
    return met.select(*key, *[F.coalesce(f"__{c}", c).alias(c) if c in both else F.col(c) for c in [*first.columns, *[x for x in later.columns if x not in first.columns]] if c not in key])


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
