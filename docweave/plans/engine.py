"""The engine: ingest documents, keep the index ready, retrieve and answer for many questions at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.config import DEFAULT, Settings
from docweave.functions import text as t
from docweave.functions.lineage import cut
from docweave.models import ExtractiveGenerator, HashedEncoder, OverlapReranker
from docweave.observe import timed
from docweave.operators import chunking, dense, fusion, prompts, sparse, structure
from docweave.plans import enrich
from docweave.plans.catalog import CacheStatus, Catalog, changed, manifest_of
from docweave.sources import readers


@dataclass
class Ingested:
    documents: int
    chunks: int
    images: int
    cached: bool


class Engine:
    def __init__(self, spark: SparkSession, folder: str, parser=None, encoder=None, reranker=None, generator=None, settings: Settings = DEFAULT, captioner=None):
        self.spark, self.catalog, self.s = spark, Catalog(spark, folder.rstrip("/")), settings
        self.parser, self.captioner, self.encoder = parser, captioner, encoder or HashedEncoder()
        self.reranker, self.generator = reranker or OverlapReranker(), generator or ExtractiveGenerator()

    # ingestion

    def ingest(self, path: str, process_vision: bool = True, force: bool = False, images: DataFrame | None = None, image_hash: str | None = None, pattern: str = "*.[pP][dD][fF]", image_chunks: bool = True, image_metadata: str | None = None) -> Ingested:
        """Indexes the documents at ``path``; unchanged ones are taken over from the current generation.

        Documents are told apart by their paths; their names are only shown.
        Those that are gone leave the index. Only chunks of new and changed
        documents are encoded and counted. Image chunks come from ``images``
        (by name, which must then be unique, or by ``document_path``), or
        with ``process_vision`` from the captioner, if there is one and the
        parser knows where figures are; or from JSON below ``image_metadata``,
        whose hash then tells whether it changed. Descriptions are also put
        into the text chunks that show the pictures, by file name, or, for
        the captioner's, that the layout puts them after.
        """
        image_hash, images = self._metadata(image_metadata, image_hash, images)
        files = readers.read_files(self.spark, path, pattern).withColumn("document_name", F.col("document_id")).withColumn("document_id", F.col("path"))
        wanted = cut(self._manifest(files, process_vision, image_hash))
        total = wanted.count()
        if not total:
            raise FileNotFoundError(f"no document at {path}")
        now = self.catalog.current()
        known = self.catalog.manifest(now)
        fresh = wanted if force or now is None else cut(changed(wanted, known))
        n = fresh.count()
        if not n and now is not None and known.count() == total:
            chunks = self.catalog.table(now, "chunks")
            return Ingested(total, chunks.count(), chunks.where("source_type = 'image'").count(), True)
        names = fresh.select(F.col("document_path").alias("document_id"))
        names = F.broadcast(names) if n <= 100_000 else names
        files = files.join(names, "document_id", "left_semi")
        pages = readers.parse_pages(files, self.parser, True, self.s)
        pictures = None
        if images is not None:
            images = self._of_documents(images, wanted, names)
        elif process_vision and self.captioner is not None and hasattr(self.parser, "render"):
            images = cut(enrich.picture_records(files, self.parser, self.captioner, self.s))
            pages = enrich.shown_pages(cut(pages), files, images, self.parser, self.s)
        if images is not None:
            files_of = [F.col(c) for c in ("image", "image_path") if c in images.columns]
            pictures = images.select("document_name", F.element_at(F.split(F.coalesce(*files_of), "/"), -1).alias("image"), "description") if files_of else None
        rows = chunking.chunk_records(structure.markdown_items(pages, self.s, pictures), self.s)
        if images is not None and image_chunks:
            rows = rows.unionByName(chunking.image_records(images, self.s))
        generation = self.catalog.new()
        stay = None
        if now is not None and n < total:
            stay = cut(wanted.join(fresh.select("document_path"), "document_path", "left_anti").select(F.col("document_path").alias("document_id")))
            old = self.catalog.table(now, "chunks").join(stay, "document_id", "left_semi")
            rows = rows.unionByName(old.withColumn("document_name", F.col("document_id")).drop("id", "document_id"))
        own = chunking.numbered_chunks(rows).withColumn("document_id", F.col("document_name")).withColumn("document_name", t.display_name("document_id"))
        with timed("chunks", documents=n):
            self.catalog.write(generation, "chunks", own)
        with timed("index"):
            chunks = self.build(generation, now if stay is not None else None, stay)
        self.catalog.commit(generation, wanted)
        found = self.catalog.table(generation, "chunks")
        return Ingested(total, chunks, found.where("source_type = 'image'").count(), False)

    def _metadata(self, path: str | None, image_hash: str | None, images: DataFrame | None) -> tuple[str | None, DataFrame | None]:
        """The hash and the records of image metadata at ``path``, where they weren't given."""
        if path is None:
            return image_hash, images
        if images is None:
            images = readers.read_image_metadata(self.spark, path)
            if images is not None:
                # numbered as the records tell, within each document
                order = Window.partitionBy("document_name").orderBy(F.col("image_id").asc_nulls_last(), F.coalesce("page", F.get("page_numbers", 0)), "image", "image_path", "description")
                place = F.row_number().over(order) - 1
                pages = F.coalesce("page_numbers", F.when(F.col("page").isNotNull(), F.array("page")))
                images = images.withColumn("image_no", place).withColumn("image_id", F.coalesce("image_id", "image_no")).withColumn("image_path", F.coalesce("image_path", "image")).withColumn("page_numbers", F.transform(pages, lambda p: p.cast("string")))
        return image_hash or readers.metadata_hash(self.spark, path), images

    def _manifest(self, files: DataFrame, process_vision: bool, image_hash: str | None) -> DataFrame:
        return manifest_of(files.withColumn("document_id", t.file_stem("path")), process_vision, image_hash, self.s.schema_version)

    def _of_documents(self, images: DataFrame, wanted: DataFrame, names: DataFrame) -> DataFrame:
        """Image records of the documents in ``names``, ``document_name`` being the path."""
        if "document_path" in images.columns:
            images = images.withColumn("document_name", F.col("document_path"))
        else:
            if wanted.groupBy("document_name").count().where("count > 1").limit(1).count():
                raise ValueError("documents share a name; image records need document_path")
            only = wanted.select("document_name").limit(2).collect()
            if len(only) == 1:  # records that name no document are the only one's
                images = images.withColumn("document_name", F.coalesce("document_name", F.lit(only[0][0])))
            paths = wanted.select("document_name", F.col("document_path").alias("__path"))
            images = images.join(paths, "document_name").withColumn("document_name", F.col("__path")).drop("__path")
        return images.join(names.select(F.col("document_id").alias("document_name")), "document_name", "left_semi")

    def build(self, generation: str, before: str | None = None, stay: DataFrame | None = None) -> int:
        """Sparse and dense tables of a generation's chunks; ValueError if there are none.

        Rows of documents in ``stay`` are taken over from the generation
        ``before``, by the number that their chunk had there.
        """
        chunks = self.catalog.table(generation, "chunks")
        total = chunks.count()
        if not total:
            raise ValueError("no chunks to index")
        moved = None
        if stay is not None:
            was = self.catalog.table(before, "chunks").select(F.col("id").alias("__was"), "document_id", "seq")
            same = chunks.select(F.col("id").alias("__now"), "document_id", "seq").join(stay, "document_id", "left_semi")
            moved = cut(same.join(was, ["document_id", "seq"]).select("__was", "__now"))
            chunks = chunks.join(moved, F.col("id") == F.col("__now"), "left_anti")

        def with_old(rows: DataFrame, name: str) -> DataFrame:
            if moved is None:
                return rows
            old = self.catalog.table(before, name)
            kept = old.join(moved, F.col("chunk_id") == F.col("__was")).withColumn("chunk_id", F.col("__now"))
            return rows.unionByName(kept.select(*rows.columns))

        body = t.first_filled("embedding_text", "text", "raw_text")
        own = chunks.select(F.col("id").alias("chunk_id"), body.alias("text"))
        self.catalog.write(generation, "embeddings", with_old(own.select("chunk_id", self.encoder.encode(F.col("text")).alias("embedding")), "embeddings"))
        lengths, postings = sparse.flat(cut(sparse.postings_of(own)))
        self.catalog.write(generation, "lengths", with_old(lengths, "lengths"))
        self.catalog.write(generation, "postings", with_old(postings, "postings"))
        stored = sparse.derived(self.catalog.table(generation, "lengths"), self.catalog.table(generation, "postings"))
        self.catalog.write(generation, "terms", stored.terms)
        self.catalog.write(generation, "corpus", stored.corpus)
        return total

    def repair(self) -> str | None:
        """Makes a generation whose image chunks don't echo a chat transcript, if any does; only their documents are encoded again."""
        now = self.catalog.current()
        chunks = self.catalog.table(now, "chunks")
        if not structure.needs_repair(chunks):
            return None
        bad = structure.to_repair(chunks).select("document_id").distinct()
        stay = cut(chunks.select("document_id").distinct().join(bad, "document_id", "left_anti"))
        generation = self.catalog.new()
        with timed("repair"):
            self.catalog.write(generation, "chunks", structure.repair_transcripts(chunks))
            self.build(generation, now, stay)
        self.catalog.commit(generation, self.catalog.manifest(now))
        return generation

    def index(self, generation: str) -> sparse.SparseIndex:
        return sparse.SparseIndex(*(self.catalog.table(generation, name) for name in ("lengths", "postings", "terms", "corpus")))

    def ensure_ready(self, path: str | None = None, auto_ingest: bool = True, force: bool = False, repair: bool = True, **how) -> str:
        """The current generation; ingests if there is none, if asked to, or if the documents at ``path`` differ.

        With ``repair``, image chunks that echo a transcript are repaired and
        indexed again, which reads all image chunks once.
        """
        now = self.catalog.current()
        if path is not None and now is not None and not force:
            files = readers.read_files(self.spark, path, how.get("pattern", "*.[pP][dD][fF]"))
            image_hash = how.get("image_hash") or (readers.metadata_hash(self.spark, how["image_metadata"]) if how.get("image_metadata") else None)
            wanted, known = cut(self._manifest(files, how.get("process_vision", True), image_hash)), self.catalog.manifest(now)
            stale = changed(wanted, known).limit(1).count() > 0 or changed(known, wanted).limit(1).count() > 0
        else:
            stale = force or now is None
        if stale:
            if not auto_ingest:
                raise RuntimeError("the index is missing or was made from other documents")
            self.ingest(readers.resolve(self.spark, path), force=force, **how)
            now = self.catalog.current()
        return (self.repair() if repair else None) or now

    def status(self) -> CacheStatus:
        return self.catalog.status()

    # questions

    def retrieve(self, questions: DataFrame, where=None) -> DataFrame:
        """(query_id, question, rank, chunk columns) for questions (query_id, question).

        Dense and sparse candidates are fused, and only those are reranked.
        ``where`` filters chunks, such as by document; it's an addition.
        """
        now = self.catalog.current()
        if now is None:
            raise FileNotFoundError("no index")
        questions = questions.select("query_id", t.strip("question").alias("question"))
        if questions.where("question IS NULL OR question = ''").limit(1).count():
            raise ValueError("a question is blank")
        chunks, index, vectors = self.catalog.table(now, "chunks"), self.index(now), self.catalog.table(now, "embeddings")
        if where is not None:
            chunks = chunks.where(where)
            ids = chunks.select(F.col("id").alias("chunk_id"))
            index = sparse.SparseIndex(index.lengths.join(ids, "chunk_id", "left_semi"), index.postings.join(ids, "chunk_id", "left_semi"), index.terms, index.corpus)
            vectors = vectors.join(ids, "chunk_id", "left_semi")
        asked = questions.select("query_id", self.encoder.encode(t.query_text("question", self.s.query_prefix)).alias("embedding"))
        near = dense.top_k(vectors, asked, self.s.dense_k)
        words = sparse.top_k(index, questions.withColumnRenamed("question", "text"), self.s.sparse_k, self.s)
        fused = fusion.fuse(near, words, self.s.rerank_k, self.s.rrf_constant)
        body = chunks.withColumnRenamed("id", "chunk_id").withColumn("__body", t.first_filled("embedding_text", "text", "raw_text"))
        met = fused.join(body, "chunk_id").join(questions, "query_id")
        scored = fusion.rerank(met.withColumn("text", F.col("__body")).drop("__body"), self.reranker.score, self.s.final_k)
        return scored

    def answer(self, questions: DataFrame, where=None) -> DataFrame:
        """(query_id, question, context, prompt, answer)."""
        found = self.retrieve(questions, where)
        asked = questions.select("query_id", t.strip("question").alias("question"))
        return prompts.prompts(found, asked, self.s.final_k).withColumn("answer", self.generator.generate(F.col("prompt")))

    def stream_answer(self, question: str) -> Iterator[str]:
        """The answer to one question, piece by piece, on the driver."""
        asked = self.spark.createDataFrame([(0, question)], "query_id int, question string")
        prompt = prompts.prompts(self.retrieve(asked), asked, self.s.final_k).first()["prompt"]
        yield from self.generator.stream(prompt)
