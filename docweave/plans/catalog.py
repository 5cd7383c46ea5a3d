"""Generations of an index in a folder, and the manifest that makes one current.

A generation's tables are written first and its manifest last; a generation
without a finished manifest doesn't exist for readers. The manifest has one
row a document: what it was made from, so that only new or changed documents
are worked on again.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import schema
from docweave.config import DEFAULT
from docweave.observe import log
from docweave.sources.readers import exists

TABLES = ("chunks", "embeddings", "postings", "lengths", "terms", "corpus")
_KEY = ("document_name", "document_path", "document_hash", "process_vision", "artifact_schema_version", "image_metadata_hash")


@dataclass
class CacheStatus:
    ready: bool
    generation: str | None
    documents: int


@dataclass
class Catalog:
    spark: SparkSession
    folder: str
    _read: set[str] = field(default_factory=set, repr=False)

    def _list(self, path: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [str(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def current(self) -> str | None:
        """The last generation whose manifest is complete and can be read."""
        done = [g for g in self._list(f"{self.folder}/manifests") if exists(self.spark, f"{self.folder}/manifests/{g}/_SUCCESS")]
        return next((g for g in sorted(done, reverse=True) if self._readable(g)), None)

    def _readable(self, generation: str) -> bool:
        if generation not in self._read:
            try:
                self.manifest(generation).limit(1).collect()
            except Exception as e:
                log.warning("the manifest of %s can't be read: %s", generation, str(e).splitlines()[0] if str(e) else e)
                return False
            self._read.add(generation)
        return True

    def new(self) -> str:
        return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def table(self, generation: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/generations/{generation}/{name}")

    def write(self, generation: str, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/generations/{generation}/{name}")

    def manifest(self, generation: str | None = None) -> DataFrame:
        generation = generation or self.current()
        if generation is None:
            return self.spark.createDataFrame([], schema.MANIFEST)
        return self.spark.read.schema(schema.MANIFEST).parquet(f"{self.folder}/manifests/{generation}")

    def commit(self, generation: str, manifest: DataFrame) -> None:
        manifest.select(*_KEY).write.parquet(f"{self.folder}/manifests/{generation}")

    def status(self) -> CacheStatus:
        generation = self.current()
        return CacheStatus(generation is not None, generation, self.manifest(generation).count())


def manifest_of(files: DataFrame, process_vision: bool, image_hash: str | None = None, version: int = DEFAULT.schema_version) -> DataFrame:
    return files.select(
        F.col("document_id").alias("document_name"), F.col("path").alias("document_path"), "document_hash",
        F.lit(process_vision).alias("process_vision"), F.lit(version).alias("artifact_schema_version"), F.lit(image_hash).cast("string").alias("image_metadata_hash"),
    )


def changed(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the manifest ``wanted`` that ``known`` lacks or has otherwise; nulls equal nulls.

    Documents are told apart by their paths. With the two changed about, the
    rows are those that went or were otherwise.
    """
    right = known.select(*[F.col(c).alias(f"__{c}") for c in _KEY])
    same = F.lit(True)
    for c in _KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return wanted.join(right, same, "left_anti")
