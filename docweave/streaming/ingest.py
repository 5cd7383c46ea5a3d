"""Continuous ingestion: new files of a folder are indexed batch by batch (not in the reference's scope)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.operators import chunking, structure
from docweave.sources import readers


def new_files(spark, folder: str, pattern: str = "*.[pP][dD][fF]", per_batch: int = 1000) -> DataFrame:
    """A stream of files as (document_id, path, content, document_hash)."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    rows = rows.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)
    return rows.withColumn("document_id", F.col("path")).withColumn("document_hash", t.sha256("content"))


def write_chunks(files: DataFrame, out: str, checkpoint: str, parser=None):
    """Starts a query that appends each batch's chunks to ``out``.

    A batch is written to a folder of its own number and replaces what a
    failed attempt left there, so each file's chunks appear once.
    """

    def save(batch: DataFrame, number: int) -> None:
        pages = readers.parse_pages(batch, parser, strict=False)
        rows = chunking.chunk_records(structure.markdown_items(pages))
        rows = rows.withColumn("document_id", F.col("document_name")).withColumn("document_name", t.display_name("document_id"))
        rows.withColumn("ingested", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
