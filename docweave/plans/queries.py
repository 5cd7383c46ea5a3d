"""Driver queries over the fixture tables, and equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.config import DEFAULT
from docweave.functions import text as t
from docweave.functions.lineage import cut, spread
from docweave.models import ExtractiveGenerator, HashedEncoder, OverlapReranker
from docweave.operators import chunking, dense, figures, fusion, prompts, sparse
from docweave.plans.catalog import changed, manifest_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def normalize_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.normalize_whitespace("text").alias("norm"))


def tokenize_terms(spark, sf_dir):
    terms = t.tokenize("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.array_join(terms, " ").alias("terms"))


def classify_source_type(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.source_type("text").alias("source_type"))


def chunk_windows(spark, sf_dir):
    rows = chunking.split_windows(_docs(spark, sf_dir), "text", F.lit(DEFAULT.safe_tokens - DEFAULT.heading_margin))
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("split_index", "window_start", "window_end")], "body")


def _page_chunks(spark, sf_dir):
    # both branches of the windows read the items
    return chunking.chunk_records(cut(chunking.html_items(spread(_table(spark, sf_dir, "pages").select("page_id", "html")))))


def chunk_records(spark, sf_dir):
    rows = chunking.numbered_chunks(_page_chunks(spark, sf_dir))
    return rows.select("id", "document_name", "text", "raw_text", "source_type", F.array_join("headings", " | ").alias("headings"), t.citation("page_numbers").alias("citation"))


def corpus_stats(spark, sf_dir):
    index = sparse.build(_docs(spark, sf_dir), "doc_id")
    return index.corpus.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


def term_stats(spark, sf_dir):
    index = sparse.build(_docs(spark, sf_dir), "doc_id")
    return index.terms.select("term", "df", F.round("raw_idf", 6).alias("raw_idf"))


def _questions(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, sf_dir):
    return sparse.top_k(sparse.build(_docs(spark, sf_dir), "doc_id"), _questions(spark, sf_dir))


def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _dense(spark, sf_dir, queries):
    return dense.top_k(_table(spark, sf_dir, "embeddings"), queries, id_col="vec_id")


def dense_topk(spark, sf_dir):
    queries = _table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _dense(spark, sf_dir, queries).select("query_id", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def rrf_fusion(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").join(_questions(spark, sf_dir).select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = fusion.fuse(_dense(spark, sf_dir, vectors), _bm25(spark, sf_dir))
    return rows.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 9).alias("score"), F.col("fused_rank").cast("long").alias("fused_rank"))


def _transcripts(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    line = F.concat("role", F.lit(": "), "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])
    return rows.groupBy("conv_id").agg(F.array_join(parts, "\n").alias("transcript"))


def strip_transcript(spark, sf_dir):
    return _transcripts(spark, sf_dir).select("conv_id", t.strip_transcript("transcript").alias("answer"))


def strip_leading_assistant(spark, sf_dir):
    line = F.concat("role", F.lit(": "), "text")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", t.strip_leading_assistant(line).alias("answer"))


def escape_emphasis(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.escape_emphasis("text").alias("escaped"))


def match_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.match_key("text").alias("match_key"))


def page_marker_asof(spark, sf_dir):
    # each paragraph of a page gets a number; every third is preceded by a marker
    own = F.regexp_replace("html", "</p>", "\n")
    lines = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(own, "\n")).alias("n", "line"))
    marked = lines.withColumn("marker", F.when(F.col("n") % 3 == 1, t.page_marker((F.col("n") + 2) / 3)).otherwise(F.lit(None)))
    rows = marked.select("page_id", F.explode(F.array(F.struct((F.col("n") * 2).alias("line_no"), F.col("marker").alias("line")), F.struct((F.col("n") * 2 + 1).alias("line_no"), F.col("line").alias("line")))).alias("r")).where("r.line IS NOT NULL")
    out = figures.last_marker(rows.select("page_id", "r.line_no", "r.line"), "page_id")
    return out.select("page_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce(F.col("page_no").cast("long"), F.lit(-1)).alias("page_no"))


def _rectangles(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    size = lambda i: F.round(20 + 3000 * F.abs(e(i)), 3)
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 40).alias("page_no"), F.round(500 + 1500 * e(0), 3).alias("x0"), F.round(500 + 1500 * e(1), 3).alias("y0"), size(2).alias("w"), size(3).alias("h"), (F.col("vec_id") % 3).alias("kind_no"))
    return rows.select("vec_id", F.lit("d").alias("document_id"), "page_no", F.col("vec_id").alias("region_no"), F.when(F.col("kind_no") == 0, "vector").otherwise("raster").alias("kind"), "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), F.lit(1000.0).alias("page_width"), F.lit(1400.0).alias("page_height"))


def figure_filters(spark, sf_dir):
    rows = figures.keep_figures(figures.clip(_rectangles(spark, sf_dir)))
    rows = figures.number_figures(rows, ["y0", "x0", "vec_id"])
    return rows.select("vec_id", "page_no", "kind", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("figure_no").cast("long").alias("figure_no"))


def occurrence_limit(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.lit("d").alias("document_id"), t.image_key("text").alias("image_hash"))
    return figures.limit_occurrences(rows, "image_hash", ["doc_id"]).select("doc_id", "image_hash", F.col("occurrence").cast("long").alias("occurrence"))


def anchor_fill(spark, sf_dir):
    a = F.col("embedding")[0].cast("double")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 40).alias("page_no"), F.when((a > 0) & (F.col("vec_id") % 7 != 3), F.round(a, 6)).alias("anchor"))
    return figures.fill_anchors(rows, "anchor", "vec_id", ("page_no",)).select("vec_id", "page_no", "anchor")


def figure_placement(spark, sf_dir):
    boxes = _rectangles(spark, sf_dir)
    paragraphs = boxes.where("kind = 'raster'").select("page_no", F.col("vec_id").alias("paragraph_no"), F.col("y0").alias("anchor"))
    rows = figures.place_figures(boxes.where("kind = 'vector'").select("vec_id", "page_no", "y0"), paragraphs, ("page_no",))
    return rows.select("vec_id", "page_no", F.col("paragraph_no").cast("long").alias("paragraph_no"))


def picture_run_cap(spark, sf_dir):
    # every line is a picture, six to a page; its description is the line itself, in capitals or after a word, or blank
    lines = _docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("item_no", "parent_text"))
    words = F.when(F.length("parent_text") % 5 == 0, F.lit("")).when(F.col("item_no") % 2 == 0, F.upper("parent_text")).otherwise(F.concat(F.lit("figure "), "parent_text"))
    out = chunking.picture_runs(lines.withColumn("page_key", F.floor(F.col("item_no") / 6).cast("string")).withColumn("description", words))
    return out.select(F.col("document_id").alias("doc_id"), F.col("item_no").cast("long").alias("item_no"), "run_id", "appended", "serialized")


def figure_dedup(spark, sf_dir):
    rows = figures.greedy_dedup(figures.clip(_rectangles(spark, sf_dir)))
    return rows.select("page_no", F.col("region_no").alias("vec_id"), *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


def paragraph_match(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where("trim(line) <> ''").withColumn("page_no", (F.col("n") / 8).cast("int"))
    paragraphs = lines.select(F.col("doc_id"), "page_no", F.col("n").alias("paragraph_no"), F.concat(F.lit("**"), "line", F.lit("** |")).alias("text"))
    blocks = lines.select("doc_id", "page_no", F.col("n").alias("block_no"), F.lit(0).alias("block_type"), (F.col("n") * 12.0).alias("y0"), F.col("line").alias("text"))
    rows = figures.match_blocks(paragraphs, blocks, keys=("doc_id", "page_no"))
    return rows.select("doc_id", "paragraph_no", "anchor", F.round("ratio", 9).alias("ratio"))


def _prompted(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_name"), "text", F.col("text").alias("raw_text"), t.source_type("text").alias("source_type"), F.array("lang", "source").alias("headings"), F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<int>")).when(F.col("doc_id") % 3 == 1, F.array((F.col("doc_id") % 90).cast("int"))).otherwise(F.array(F.lit(1), (F.col("doc_id") % 90).cast("int"))).alias("page_numbers"))
    return _bm25(spark, sf_dir).join(docs, "chunk_id")


def context_prompt(spark, sf_dir):
    return prompts.prompts(_prompted(spark, sf_dir), _questions(spark, sf_dir).withColumnRenamed("text", "question")).select("query_id", "prompt")


def citation(spark, sf_dir):
    return prompts.sources(_prompted(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "source")


def content_hash_cache(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    path = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    files = docs.select(F.col("doc_id").cast("string").alias("document_id"), path.alias("path"), t.sha256("text").alias("document_hash"), "doc_id")
    # the cache was made before documents of even length changed their text
    before = docs.select(F.col("doc_id").cast("string").alias("document_id"), path.alias("path"), t.sha256(F.when(F.length("text") % 2 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("document_hash"))
    fresh = changed(manifest_of(files, True), manifest_of(before, True)).select(F.col("document_name").alias("n"))
    out = files.join(fresh, F.col("document_id") == F.col("n"), "left")
    return out.select("doc_id", "document_hash", F.col("n").isNull().alias("cached"))


def hybrid_answer(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = chunking.split_windows(docs, "text", F.lit(DEFAULT.safe_tokens - DEFAULT.heading_margin))
    chunks = cut(rows.select((F.col("doc_id") * 10000 + F.col("split_index")).alias("chunk_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_name"), F.col("body").alias("text"), F.col("body").alias("raw_text"), t.source_type("body").alias("source_type"), F.array().cast("array<string>").alias("headings"), F.array().cast("array<int>").alias("page_numbers")))
    encoder, questions = HashedEncoder(), _questions(spark, sf_dir).withColumnRenamed("text", "question")
    asked = questions.select("query_id", encoder.encode(t.query_text("question")).alias("embedding"))
    near = dense.top_k(chunks.select("chunk_id", encoder.encode(F.col("text")).alias("embedding")), asked)
    words = sparse.top_k(sparse.build(chunks), questions.withColumnRenamed("question", "text"))
    met = fusion.fuse(near, words).join(chunks, "chunk_id").join(questions, "query_id")
    best = fusion.rerank(met, OverlapReranker().score)
    out = prompts.prompts(best, questions)
    return out.select("query_id", "question", ExtractiveGenerator().generate(F.col("prompt")).alias("answer"))


_KEYS = (
    normalize_whitespace, tokenize_terms, classify_source_type, chunk_windows, chunk_records, corpus_stats, term_stats, bm25_topk, dense_topk, rrf_fusion, strip_transcript, strip_leading_assistant,
    escape_emphasis, match_key, page_marker_asof, anchor_fill, figure_filters, occurrence_limit, figure_placement, picture_run_cap, figure_dedup, paragraph_match, context_prompt, citation, content_hash_cache, hybrid_answer,
)
QUERIES = {f.__name__: f for f in _KEYS}

_NORM = r"trim(regexp_replace({}, '[\s\x1c-\x1f]+', ' ', 'g'))"
_TYPE = "CASE WHEN contains({0}, '|') OR contains({0}, '---') THEN 'table' ELSE 'text' END"
_TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_WINDOWS = """
n0 AS (SELECT *, string_split({norm}, ' ') AS w FROM {source}),
n1 AS (SELECT *, CASE WHEN len(w) = 1 AND w[1] = '' THEN 0 ELSE len(w) END AS n, {limit} AS m FROM n0),
n2 AS (SELECT *, CAST(ceil((n - m) / (m - 50.0)) AS BIGINT) AS k1 FROM n1),
n3 AS (SELECT *, n - ((k1 - 1) * (m - 50) + m) < 100 AS short, unnest(CASE WHEN n <= m THEN [0] ELSE range(k1 + 1) END) AS k FROM n2),
n4 AS (SELECT *, CASE WHEN n <= m THEN 0 WHEN k = k1 AND short THEN n - 150 ELSE k * (m - 50) END AS a,
  CASE WHEN n <= m OR k = k1 THEN n WHEN k = k1 - 1 AND short THEN n - 100 ELSE k * (m - 50) + m END AS b FROM n3)"""
_BM25 = """
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
l AS (SELECT doc_id, len(w) AS dl FROM d),
p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
tm AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf FROM p, c GROUP BY term),
g AS (SELECT avg(raw_idf) AS avg_idf FROM tm),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(qtf * (CASE WHEN raw_idf < 0 THEN 0.25 * avg_idf ELSE raw_idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN tm USING (term) JOIN p USING (term) JOIN l USING (doc_id), c, g GROUP BY ALL),
z AS (SELECT b.item_id AS query_id, l.doc_id, coalesce(s.score, 0.0) AS score FROM benchmark b CROSS JOIN l LEFT JOIN s ON s.query_id = b.item_id AND s.doc_id = l.doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z QUALIFY rank <= 30)"""
_DENSE = """
dq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE {which}),
ds AS (SELECT query_id, vec_id, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 9) AS score FROM dq, embeddings),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ds QUALIFY rank <= 30)"""
_BOXES = """
r0 AS (SELECT vec_id, vec_id // 40 AS page_no, CASE WHEN vec_id % 3 = 0 THEN 'vector' ELSE 'raster' END AS kind,
  round(500 + 1500 * embedding[1]::DOUBLE, 3) AS x0, round(500 + 1500 * embedding[2]::DOUBLE, 3) AS y0,
  round(20 + 3000 * abs(embedding[3]::DOUBLE), 3) AS w, round(20 + 3000 * abs(embedding[4]::DOUBLE), 3) AS h FROM embeddings),
r1 AS (SELECT vec_id, page_no, kind, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM r0),
r2 AS (SELECT vec_id, page_no, kind, greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, 1000) AS x1, least(y1, 1400) AS y1 FROM r1),
r3 AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM r2 WHERE least(x1 - x0, y1 - y0) >= CASE WHEN kind = 'vector' THEN 120 ELSE 80 END)"""
_ENTRIES = """
e AS (SELECT bm.query_id, bm.rank, '[' || bm.rank || '] doc-' || d0.doc_id || ' | ' ||
  CASE d0.doc_id % 3 WHEN 0 THEN 'Page unavailable' WHEN 1 THEN 'Page ' || (d0.doc_id % 90) ELSE 'Pages 1, ' || (d0.doc_id % 90) END || ' | ' ||
  (""" + _TYPE.format("d0.text") + """) || ' | ' || d0.lang || ' | ' || d0.source AS head, d0.text
  FROM bm JOIN documents d0 USING (doc_id) WHERE bm.rank <= 8)"""
_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x1c-\x1f]+', ''), '[\s\x1c-\x1f]+$', '')"

ORACLE_SQL = {
    "normalize_whitespace": f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents",
    "tokenize_terms": f"SELECT doc_id, len({_TERMS.format('text')})::BIGINT AS n_terms, array_to_string({_TERMS.format('text')}, ' ') AS terms FROM documents",
    "classify_source_type": f"SELECT doc_id, {_TYPE.format('text')} AS source_type FROM documents",
    "chunk_windows": "WITH " + _WINDOWS.format(norm=_NORM.format("text"), source="documents", limit="442") + " SELECT doc_id, k::BIGINT AS split_index, a::BIGINT AS window_start, b::BIGINT AS window_end, array_to_string(w[a + 1 : b], ' ') AS body FROM n4",
    "chunk_records": r"""WITH
      a0 AS (SELECT page_id::VARCHAR AS document_name, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article FROM pages),
      a1 AS (SELECT document_name, regexp_extract(article, '(?s)<h1>(.*?)</h1>', 1) AS h, string_split_regex(regexp_replace(article, '(?s)^.*?</h1>', ''), '<p>|</p>') AS ps FROM a0),
      a2 AS (SELECT document_name, h, unnest(ps) AS p, unnest(range(len(ps))) AS item_no FROM a1),
      a3 AS (SELECT document_name, item_no, """
    + _NORM.format("replace(replace(replace(replace(replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')")
    + " AS heading, "
    + _NORM.format("replace(replace(replace(replace(replace(regexp_replace(p, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')")
    + " AS raw FROM a2), a4 AS (SELECT *, " + _TYPE.format("raw") + " AS source_type FROM a3 WHERE raw <> ''), "
    + _WINDOWS.format(norm="raw", source="a4", limit="greatest(1, 442 - CASE WHEN heading = '' THEN 0 ELSE len(string_split(" + _NORM.format("heading || '. '") + ", ' ')) END)")
    + r""", c0 AS (SELECT document_name, item_no, k, source_type, heading, array_to_string(w[a + 1 : b], ' ') AS body FROM n4),
      c1 AS (SELECT *, row_number() OVER (ORDER BY document_name, item_no, k) - 1 AS i FROM c0)
      SELECT format('chunk-{:05d}', i) AS id, document_name,
        CASE WHEN heading = '' THEN body WHEN source_type = 'table' THEN heading || ' ' || body ELSE heading || '. ' || body END AS text,
        body AS raw_text, source_type, heading AS headings, 'Page 1' AS citation FROM c1""",
    "corpus_stats": "WITH " + _BM25 + " SELECT n, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM c, g",
    "term_stats": "WITH " + _BM25 + " SELECT term, df, round(raw_idf, 6) AS raw_idf FROM tm",
    "bm25_topk": "WITH " + _BM25 + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm",
    "dense_topk": "WITH " + _DENSE.format(which="vec_id % 100 = 0") + " SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dn",
    "rrf_fusion": "WITH " + _BM25 + "," + _DENSE.format(which="vec_id IN (SELECT item_id FROM benchmark)") + """,
      f AS (SELECT coalesce(dn.query_id, bm.query_id) AS query_id, coalesce(vec_id, doc_id) AS doc_id, dn.rank AS dr, bm.rank AS sr,
        coalesce(1.0::DOUBLE / (60 + dn.rank), 0) + coalesce(1.0::DOUBLE / (60 + bm.rank), 0) AS score FROM dn FULL JOIN bm ON dn.query_id = bm.query_id AND vec_id = doc_id)
      SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST) AS fused_rank FROM f QUALIFY fused_rank <= 15""",
    "strip_transcript": r"WITH c AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t0 FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, " + _STRIP.format("t0") + r""" AS t FROM c)
      SELECT conv_id, CASE WHEN regexp_matches(t, '(?is)\bsystem\b.*?\buser\b.*?\bassistant\b[:\s]*(.*)$') THEN """ + _STRIP.format(r"regexp_extract(t, '(?is)\bsystem\b.*?\buser\b.*?\bassistant\b[:\s]*(.*)$', 1)")
    + r" WHEN regexp_matches(t, '(?is)\bassistant\b[:\s]*(.*)$') THEN " + _STRIP.format(r"regexp_extract(t, '(?is)\bassistant\b[:\s]*(.*)$', 1)") + " ELSE t END AS answer FROM s",
    "strip_leading_assistant": "WITH s AS (SELECT conv_id, turn, " + _NORM.format("role || ': ' || text") + r" AS t FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?is)^\s*assistant') THEN " + _STRIP.format(r"regexp_extract(t, '(?is)^\s*assistant[:\s]*(.*)', 1)") + " ELSE t END AS answer FROM s",
    "escape_emphasis": "SELECT doc_id, " + _NORM.format(r"replace(text, '*', '\*')") + " AS escaped FROM documents",
    "match_key": r"SELECT doc_id, substring(lower(" + _NORM.format(r"regexp_replace(regexp_replace(text, '[#*_`>|]+', ' ', 'g'), '(?m)^[\s\x1c-\x1f\-]+', '', 'g')") + "), 1, 250) AS match_key FROM documents",
    "page_marker_asof": r"""WITH a AS (SELECT page_id, string_split(replace(html, '</p>', chr(10)), chr(10)) AS ls FROM pages),
      b AS (SELECT page_id, unnest(range(len(ls))) AS n FROM a),
      l AS (SELECT page_id, n * 2 AS line_no, (n + 2) // 3 AS m FROM b WHERE n % 3 = 1 UNION ALL SELECT page_id, n * 2 + 1, NULL FROM b)
      SELECT page_id, line_no, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS page_no FROM l""",
    "anchor_fill": """WITH a AS (SELECT vec_id, vec_id // 40 AS page_no, CASE WHEN embedding[1] > 0 AND vec_id % 7 <> 3 THEN round(embedding[1]::DOUBLE, 6) END AS x FROM embeddings)
      SELECT vec_id, page_no, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY page_no ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(x IGNORE NULLS) OVER (PARTITION BY page_no ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS anchor FROM a""",
    "figure_filters": "WITH " + _BOXES + """ SELECT vec_id, page_no, kind, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1,
      row_number() OVER (PARTITION BY page_no ORDER BY y0, x0, vec_id) AS figure_no FROM r3 WHERE least(w, h) >= 80 AND greatest(w / h, h / w) <= 8 AND w * h <= 0.95 * 1000 * 1400""",
    "occurrence_limit": "SELECT doc_id, md5(text) AS image_hash, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS occurrence FROM documents QUALIFY occurrence <= 3",
    "figure_placement": "WITH " + _BOXES + " SELECT v.vec_id, v.page_no, coalesce(max(p.vec_id), -1) AS paragraph_no FROM r1 v LEFT JOIN r1 p ON p.kind = 'raster' AND p.page_no = v.page_no AND p.y0 <= v.y0 WHERE v.kind = 'vector' GROUP BY ALL",
    "picture_run_cap": """WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS item_no FROM documents),
      b0 AS (SELECT *, CASE WHEN length(p) % 5 = 0 THEN '' WHEN item_no % 2 = 0 THEN upper(p) ELSE 'figure ' || p END AS d0, item_no // 6 + 1 AS run_id FROM a),
      b AS (SELECT *, """ + _NORM.format("d0") + """ AS d FROM b0),
      c AS (SELECT *, d <> '' AND NOT contains(replace(lower(""" + _NORM.format("p") + "), 'ß', 'ss'), replace(lower(" + _NORM.format("d") + """), 'ß', 'ss')) AS may FROM b),
      e AS (SELECT *, may AND sum(may::INT) OVER (PARTITION BY doc_id, run_id ORDER BY item_no) <= 2 AS appended FROM c)
      SELECT doc_id, item_no, run_id, appended, concat_ws(chr(10), nullif(p, ''), CASE WHEN appended THEN 'Image description: ' || d END) AS serialized FROM e""",
    "figure_dedup": "WITH " + _BOXES + """,
      a AS (SELECT page_no, list({'id': vec_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY kind = 'vector', vec_id) AS rs FROM r3 GROUP BY page_no),
      k AS (SELECT page_no, unnest(list_reduce(rs, lambda kept, r: CASE WHEN len(list_filter(kept, lambda o: least(o.x1, r.x1) > greatest(o.x0, r.x0) AND least(o.y1, r.y1) > greatest(o.y0, r.y0)
        AND (least(o.x1, r.x1) - greatest(o.x0, r.x0)) * (least(o.y1, r.y1) - greatest(o.y0, r.y0)) / least((o.x1 - o.x0) * (o.y1 - o.y0), (r.x1 - r.x0) * (r.y1 - r.y0)) > 0.9)) > 0 THEN kept ELSE list_append(kept, r) END, rs[1:0])) AS r FROM a)
      SELECT page_no, r.id AS vec_id, round(r.x0, 3) AS x0, round(r.y0, 3) AS y0, round(r.x1, 3) AS x1, round(r.y1, 3) AS y1 FROM k""",
    "context_prompt": "WITH " + _BM25 + "," + _ENTRIES + """ SELECT b.item_id AS query_id, 'Answer the user''s question using only the context below.' || chr(10) || chr(10) || 'Question:' || chr(10) || any_value(b.text) || chr(10) || chr(10) || 'Context:' || chr(10) ||
      string_agg(head || chr(10) || e.text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'If the answer is not fully supported by the context, say so clearly.' AS prompt FROM benchmark b JOIN e ON e.query_id = b.item_id GROUP BY b.item_id""",
    "citation": "WITH " + _BM25 + "," + _ENTRIES + " SELECT query_id, rank, head AS source FROM e",
    "content_hash_cache": "SELECT doc_id, sha256(text) AS document_hash, length(text) % 2 <> 0 AS cached FROM documents",
}
