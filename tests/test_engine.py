"""Search, engine, catalog, sources and stream, end to end on small inputs."""

import hashlib
import json
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docweave import cli
from docweave.models import ChatGenerator, CrossEncoderReranker, ExtractiveGenerator, FunctionEncoder, HashedEncoder
from docweave.observe import timed
from docweave.operators import dense, sparse
from docweave.plans import queries
from docweave.plans.engine import Engine
from docweave.sources import readers, writers
from docweave.streaming import ingest


def plain_bm25(docs, question):
    words = {i: re.findall("[a-z0-9]+", x.lower()) for i, x in docs}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for v in words.values() for w in set(v))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    out = {}
    for i, v in words.items():
        tf = Counter(v)
        out[i] = round(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(v) / avg)) for w in re.findall("[a-z0-9]+", question.lower())), 9)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("k", [1, 3, 30])
def test_bm25(spark, k):
    docs = [(0, "a b"), (1, "a a a c"), (2, "a"), (3, ""), (4, "z y a"), (5, "b b"), (6, "q")]
    asked = [(0, "b A"), (1, "nothing"), (2, "a a q"), (3, "...")]
    index = sparse.build(spark.createDataFrame(docs, "chunk_id long, text string"))
    rows = sparse.top_k(index, spark.createDataFrame(asked, "query_id int, text string"), k).collect()
    for q, text in asked:
        own = sorted((r.rank, r.chunk_id, r.score) for r in rows if r.query_id == q)
        want = plain_bm25(docs, text)[:k]
        assert [i for _, i, _ in own] == [i for i, _ in want]
        assert [s for *_, s in own] == pytest.approx([s for _, s in want], abs=1e-8)


def test_dense(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 2)
    monkeypatch.setattr(dense, "SENT", 3 * 5 * 8)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5)).round(1)
    v[7] = v[3]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "chunk_id long, embedding array<float>").repartition(4)
    got = dense.top_k(vectors, vectors.where("chunk_id < 5").withColumnRenamed("chunk_id", "query_id"), 4).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(5):
        score = (unit @ unit[q]).round(6)
        want = sorted(range(60), key=lambda i: (-score[i], i))[:4]
        assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
    assert dense.top_k(vectors, vectors.limit(0).withColumnRenamed("chunk_id", "query_id")).collect() == []
    lengths = dense.normalized(vectors.where("chunk_id < 9")).collect()
    assert all(np.linalg.norm(r.embedding) == pytest.approx(1, abs=1e-6) for r in lengths)


def test_dense_ties(spark):
    """Of equal vectors a task gives no more than k, those of smallest id."""
    vectors = spark.range(100_000).selectExpr("concat('c', lpad(id, 6, '0')) AS chunk_id", "array(0.0, 0.0) AS embedding").repartition(4)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    found = dense.top_k(vectors, asked, 30)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == [f"c{i:06d}" for i in range(30)]
    v = np.zeros(1000)
    score, ids = dense._best(np.empty(0), None, v, pa.array(range(1000, 0, -1)), 30)
    score, ids = dense._best(score, ids, v, pa.array(range(2000, 1000, -1)), 30)
    assert sorted(ids.to_pylist()) == list(range(1, 31)) and len(score) == 30


@pytest.fixture
def pdfs(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"# Cats\n\nCats sleep all day.\fThey purr at night.\n\n# Dogs\n\nDogs bark loudly.")
    (folder / "B.PDF").write_bytes(b"# Money\n\nRevenue grew by twelve percent.")
    (folder / "c.txt").write_bytes(b"not read")
    return folder


def test_engine(spark, tmp_path, pdfs):
    engine = Engine(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, " How much did revenue grow? "), (2, "Do dogs bark?")], "query_id int, question string")
    with pytest.raises(FileNotFoundError):
        engine.retrieve(asked)
    with pytest.raises(RuntimeError):
        engine.ensure_ready(str(pdfs), auto_ingest=False)
    assert not engine.status().ready
    first = engine.ensure_ready(str(pdfs))
    assert engine.status().documents == 2
    assert engine.ingest(str(pdfs)).cached and engine.ensure_ready(str(pdfs), auto_ingest=False) == first
    got = {r.query_id: r for r in engine.answer(asked).collect()}
    assert got[1].answer == "Money. Revenue grew by twelve percent." and "B | Page 1 | text | Money" in got[1].context
    assert got[2].answer.endswith("Dogs bark loudly.") and "a | Page 2" in got[2].context
    assert "".join(engine.stream_answer("Do dogs bark?")).strip() == got[2].answer
    only = engine.retrieve(asked, where="document_name = 'a'").collect()
    assert {r.document_name for r in only} == {"a"}
    with pytest.raises(ValueError):
        engine.retrieve(spark.createDataFrame([(1, "  ")], "query_id int, question string"))
    (pdfs / "a.pdf").write_bytes(b"# Birds\n\nBirds sing.")
    with pytest.raises(RuntimeError):
        engine.ensure_ready(str(pdfs), auto_ingest=False)
    second = engine.ensure_ready(str(pdfs))
    assert second != first
    texts = {r.document_name: r.text for r in engine.catalog.table(second, "chunks").collect()}
    assert texts == {"a": "Birds. Birds sing.", "B": "Money. Revenue grew by twelve percent."}
    assert engine.ingest(str(pdfs), force=True).cached is False
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path / "other")).ingest(str(tmp_path / "index"))


def test_no_chunks_is_an_error(spark, tmp_path):
    (tmp_path / "e.pdf").write_bytes(b" \n ")
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "index")).ingest(str(tmp_path / "e.pdf"))


def test_chat_loop(spark, tmp_path, pdfs):
    said = []
    assert cli.main([str(tmp_path / "i"), str(pdfs)], ["", "Do dogs bark?\n", "QUIT", "never"], said.append) == 0
    assert said[0].endswith("Dogs bark loudly.") and any(s.startswith("[1] a | Page 2 | text | Dogs") for s in said)
    assert cli.main([str(tmp_path / "j"), str(tmp_path / "none")], [], said.append) == 1


def test_readers(spark, tmp_path, pdfs):
    with pytest.raises(ValueError):
        readers.check_input(spark, str(pdfs / "c.txt"))
    with pytest.raises(FileNotFoundError):
        readers.check_input(spark, str(pdfs / "none.pdf"))
    with pytest.raises(FileNotFoundError):
        readers.resolve(spark, None, str(tmp_path / "none"))
    counts = spark.createDataFrame([("d", 25), ("e", 0)], "document_id string, page_count int")
    assert sorted((r["first"], r["last"]) for r in readers.page_batches(counts).collect()) == [(1, 10), (11, 20), (21, 25)]

    class Bad(readers.FormFeedParser):
        def pages(self, content, first, last):
            if first <= 3 <= last:
                raise OSError("page 3")
            return [str(i) for i in range(first, last + 1)]

    got = readers.parse_range(Bad(), b"", 1, 5, False)
    assert [(p, e is None) for p, _, e in got] == [(1, True), (2, True), (3, False), (4, True), (5, True)]
    with pytest.raises(RuntimeError):
        readers.parse_range(Bad(), b"", 1, 5, True)
    assert readers.read_questions(["a", " ", "Exit", "b"]) == ["a"]
    meta = tmp_path / "m.json"
    assert readers.read_image_metadata(spark, str(meta)) is None
    meta.write_text(json.dumps([{"page": 1, "image": "x.png", "bbox": [0, 1, 2, 3]}, {"image_id": 4, "description": "d", "page_numbers": [2]}]))
    assert readers.read_image_metadata(spark, str(meta)).count() == 2
    meta.write_text("{broken")
    assert readers.read_image_metadata(spark, str(meta)) is None
    pages = spark.createDataFrame([("d", 1, "x\ny"), ("d", 2, "z")], "document_id string, page_no int, markdown string")
    assert [r.line for r in readers.marked_lines(pages).orderBy("line_no").collect()] == ["<!-- page: 1 -->", "", "x", "y", "<!-- page: 2 -->", "", "z"]
    for n in ("page_1_img_10", "page_1_img_9"):
        (tmp_path / f"{n}.png").write_bytes(b"p")
    assert [(r.image, r.image_no) for r in readers.read_images(spark, str(tmp_path)).orderBy("image_no").collect()] == [("page_1_img_9.png", 1), ("page_1_img_10.png", 2)]
    regions = spark.createDataFrame([(1, 50.0), (2, 3.0), (3, 3000.0)], "i int, w double")
    drawn = {r.i: r.width for r in readers.render_figures(regions, lambda r, s: (b"x", int(r["w"] * s), int(r["w"] * s))).collect()}
    assert drawn == {1: 100, 2: None, 3: 2000}
    rasters = spark.createDataFrame([("p", 0, None), ("p", 2, b"b"), ("p", 1, b"a"), ("q", 0, None)], "p string, o int, image binary")
    assert {r.p: r.image and bytes(r.image) for r in readers.first_raster(rasters, ["p"], "o").collect()} == {"p": b"a", "q": None}


def test_writers(spark, tmp_path):
    pages = spark.createDataFrame([("d", 2, "**b**"), ("d", 1, "# a")], "document_id string, page_no int, markdown string")
    writers.write_documents(pages, str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o/text")).collect()] == ["a", "", "b"]
    one = spark.createDataFrame([("i", 1, None)], "image string, page int, description string")
    two = spark.createDataFrame([("i", "seen", 3), ("j", "other", 4)], "image string, description string, image_id int")
    assert sorted(map(tuple, writers.merge_metadata(one, two, ["image"]).select("image", "page", "description", "image_id").collect())) == [("i", 1, "seen", 3), ("j", None, "other", 4)]
    figs = spark.createDataFrame([("x.png", b"123"), ("y.png", None)], "file string, image binary")
    assert writers.export_images(figs, str(tmp_path / "img")).count() == 1 and (tmp_path / "img/x.png").read_bytes() == b"123"


def test_stream(spark, tmp_path, pdfs):
    for _ in range(2):
        ingest.write_chunks(ingest.new_files(spark, str(pdfs)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_generator_without_context():
    assert "".join(ExtractiveGenerator().stream("x")) == "No supporting context was retrieved."


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(cols).collect())
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for n in ("documents", "embeddings", "pages", "benchmark", "conversations"):
            c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
        want = c.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert rows == sorted(map(repr, want))
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())


class CountingEncoder(HashedEncoder):
    """Writes down every text that it encodes."""

    def __init__(self, path):
        super().__init__(16)
        self.path = path

    def encode(self, text):
        from pyspark.sql import functions as F

        path = self.path

        @F.udf("string")
        def note(s):
            with open(path, "a") as f:
                f.write(f"{s}\n")
            return s

        return super().encode(note(text))


def test_documents_of_equal_names_and_gone_ones(spark, tmp_path):
    """Documents are told apart by path; removed and renamed ones leave the index; only new chunks are encoded."""
    folder, log = tmp_path / "in", tmp_path / "log"
    for d, text in (("a", b"# Cats\n\nCats sleep."), ("b", b"# Taxes\n\nTaxes are due in May.")):
        (folder / d).mkdir(parents=True)
        (folder / d / "x.pdf").write_bytes(text)
    (folder / "y.pdf").write_bytes(b"# Dogs\nDogs bark.")
    engine = Engine(spark, str(tmp_path / "index"), encoder=CountingEncoder(str(log)))
    first = engine.ensure_ready(str(folder))
    assert sorted(r.text for r in engine.catalog.table(first, "chunks").collect()) == ["Cats. Cats sleep.", "Dogs. Dogs bark.", "Taxes. Taxes are due in May."]
    assert len(log.read_text().splitlines()) == 3
    (folder / "0.pdf").write_bytes(b"# Birds\n\nBirds sing.")
    (folder / "y.pdf").unlink()
    (folder / "b" / "x.pdf").rename(folder / "b" / "z.pdf")
    with pytest.raises(RuntimeError):
        engine.ensure_ready(str(folder), auto_ingest=False)
    second = engine.ensure_ready(str(folder))
    assert sorted(log.read_text().splitlines()[3:]) == ["Birds. Birds sing.", "Taxes. Taxes are due in May."]
    chunks = {r.id: r for r in engine.catalog.table(second, "chunks").collect()}
    assert sorted(r.document_name for r in chunks.values()) == ["0", "x", "z"]
    whole = Engine(spark, str(tmp_path / "again"), encoder=HashedEncoder(16))
    other = whole.ensure_ready(str(folder))
    for name in ("chunks", "embeddings", "lengths", "postings", "terms", "corpus"):
        rows = [sorted(map(repr, e.catalog.table(g, name).select(sorted(e.catalog.table(g, name).columns)).collect())) for e, g in ((engine, second), (whole, other))]
        assert rows[0] == rows[1], name
    assert engine.ensure_ready(str(folder), auto_ingest=False) == second
    (folder / "0.pdf").unlink()
    third = engine.ensure_ready(str(folder))
    assert third != second and len(log.read_text().splitlines()) == 5
    assert sorted(r.document_name for r in engine.catalog.table(third, "chunks").collect()) == ["x", "z"]


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from docweave.functions.lineage import shared_folder

    said = []
    sc = N(getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=said.append, master="spark://host:7077", applicationId="x")
    with pytest.raises(RuntimeError):
        shared_folder(N(sparkContext=sc, conf={}))
    sc.getCheckpointDir = lambda: "hdfs:///own/"
    assert shared_folder(N(sparkContext=sc, conf={})) == "hdfs:///own" and said == []
    assert shared_folder(N(sparkContext=sc, conf={"spark.checkpoint.dir": "hdfs:///named"})) == "hdfs:///named"


def test_image_metadata_and_repair(spark, tmp_path, pdfs):
    """JSON records become chunks and text; their hash makes the index stale; echoed transcripts are repaired once."""
    meta = tmp_path / "m.json"
    write = lambda said: meta.write_text(json.dumps([{"document_name": "a", "image": "p.png", "page": 2, "description": said}, {"document_name": "B", "image": "q.png", "description": " "}]))
    (pdfs / "a.pdf").write_bytes(b"# Cats\n\nCats sleep. ![](x/p.png)")
    write("system: look user: what assistant: A grey cat.")
    log = tmp_path / "log"
    engine = Engine(spark, str(tmp_path / "index"), encoder=CountingEncoder(str(log)))
    first = engine.ensure_ready(str(pdfs), image_metadata=str(meta), repair=False)
    chunks = {r.source_type: r for r in engine.catalog.table(first, "chunks").where("document_name = 'a'").collect()}
    assert chunks["image"].raw_text.startswith("Image description from a. Image 0. system: look") and chunks["image"].page_numbers == [2]
    assert chunks["text_with_image"].text == "Cats. Cats sleep. Image description: system: look user: what assistant: A grey cat."
    before = len(log.read_text().splitlines())
    second = engine.ensure_ready(str(pdfs), auto_ingest=False, image_metadata=str(meta))
    assert second != first
    mended = engine.catalog.table(second, "chunks").where("source_type = 'image'").collect()
    assert [(r.id, r.raw_text, r.text) for r in mended] == [(chunks["image"].id, "A grey cat.", "Image description. A grey cat.")]
    assert len(log.read_text().splitlines()) == before + 2  # document a alone
    assert engine.catalog.table(second, "embeddings").count() == engine.catalog.table(second, "chunks").count()
    assert engine.ensure_ready(str(pdfs), auto_ingest=False, image_metadata=str(meta)) == second
    write("A black cat.")
    with pytest.raises(RuntimeError):
        engine.ensure_ready(str(pdfs), auto_ingest=False, image_metadata=str(meta))
    third = engine.ensure_ready(str(pdfs), image_metadata=str(meta))
    assert "Image description from a. Image 0. A black cat." in [r.raw_text for r in engine.catalog.table(third, "chunks").collect()]
    assert readers.metadata_hash(spark, str(tmp_path / "none")) is None
    assert readers.metadata_hash(spark, str(meta)) == hashlib.sha256(meta.read_bytes()).hexdigest()
    assert readers.metadata_hash(spark, str(pdfs)) != readers.metadata_hash(spark, str(pdfs / "a.pdf"))


def test_model_adapters(spark):
    rows = spark.createDataFrame([(i, f"q{i}", "x" * i if i else None) for i in range(20)], "i int, q string, s string").coalesce(1)

    def encode():
        def f(texts):
            assert len(texts) <= 3
            return [[3.0 * len(x), 4.0 * len(x)] for x in texts]

        return f

    got = rows.select("i", FunctionEncoder(encode, 2, batch=3).encode(F.col("s")).alias("v")).orderBy("i").collect()
    assert got[0].v == [0, 0] and all(r.v == pytest.approx([0.6, 0.8]) for r in got[1:])
    bad = FunctionEncoder(lambda: lambda texts: [[1.0, 0.0]], 2)
    with pytest.raises(Exception, match="one vector a text"):
        rows.select(bad.encode(F.col("s"))).collect()
    raw = CrossEncoderReranker(lambda: lambda pairs: [[len(q)] for q, _ in pairs])
    both = CrossEncoderReranker(lambda: lambda pairs: [[0.0, math.log(3)] for _ in pairs])
    one = rows.select("q", raw.score(F.col("q"), F.col("s")).alias("a"), both.score(F.col("q"), F.col("s")).alias("b")).collect()
    assert all(r.a == len(r.q) and r.b == pytest.approx(0.75) for r in one)

    def load():
        def chat(messages, temperature, max_tokens):
            assert [m["role"] for m in messages] == ["system", "user"] and (temperature, max_tokens) == (0.2, 1024)
            yield "said: "
            yield messages[1]["content"]

        return chat

    talk = ChatGenerator(load, "Be brief.")
    assert [r.a for r in rows.limit(2).select(talk.generate(F.col("q")).alias("a")).collect()] == ["said: q0", "said: q1"]
    assert list(talk.stream("x")) == ["said: ", "x"]
    assert rows.limit(0).select(talk.generate(F.col("q"))).collect() == []


def test_paragraph_match_equals_brute_force(spark):
    """Against the standard library over all pairs of a page."""
    from difflib import SequenceMatcher

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = set()
    norm = lambda s: " ".join(s.split()).lower()
    key = lambda s: norm(re.sub(r"(?m)^[\s\x1c-\x1f\-]+", "", re.sub(r"[#*_`>|]+", " ", s)))[:250]
    for d, text in docs:
        lines = [(n, x) for n, x in enumerate((text or "").split("\n")) if x.strip(" ")]
        for n, x in lines:
            a, best = key(f"**{x}** |"), None
            for m, y in lines:
                b = key(y)
                if int(m / 8) == int(n / 8) and a and b:
                    r = SequenceMatcher(None, a, b).ratio()
                    if best is None or r > best[0]:
                        best = (r, m * 12.0)
            want.add((d, n, best[1] if best and best[0] >= 0.35 else None, round(best[0], 9) if best else None))
    rows = queries.paragraph_match(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(want) and {tuple(r[c] for c in ("doc_id", "paragraph_no", "anchor", "ratio")) for r in rows} == want


def test_paragraph_match_reads_whole_lines(spark, tmp_path):
    """Lines of one page with one beginning each find themselves."""
    lines = ["x" * 300 + f" line {i} " + "y" * 2000 + f" ends {i % 3}" for i in range(10)]
    spark.createDataFrame([(1, "\n".join([*lines, lines[9]]))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.paragraph_match(spark, str(tmp_path)).collect()
    want = {(1, n, 12.0 * n, 1.0) for n in range(10)} | {(1, 10, 108.0, 1.0)}
    assert len(rows) == len(want) and {tuple(r[c] for c in ("doc_id", "paragraph_no", "anchor", "ratio")) for r in rows} == want


def test_timer(caplog):
    with caplog.at_level("INFO", logger="docweave"):
        with timed("step", rows=3):
            pass
        with pytest.raises(KeyError), timed("other"):
            raise KeyError
    assert re.fullmatch(r"step took \d+\.\d\d s, rows=3", caplog.messages[0]) and caplog.messages[1].startswith("other failed after")


def test_broken_manifest(spark, tmp_path, pdfs):
    """A generation whose manifest can't be read doesn't exist; the one before it does."""
    folder = tmp_path / "index"
    engine = Engine(spark, str(folder))
    first = engine.ensure_ready(str(pdfs))
    (pdfs / "a.pdf").write_bytes(b"# Birds\n\nBirds sing.")
    second = engine.ensure_ready(str(pdfs))
    for f in (folder / "manifests" / second).glob("*.parquet"):
        f.write_bytes(b"broken")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    again = Engine(spark, str(folder))
    assert again.catalog.current() == first and again.ensure_ready() == first
    assert again.ensure_ready(str(pdfs)) not in (first, second)


def test_hybrid_answer_equals_brute_force(spark):
    """The whole path from documents to answers in plain Python."""
    import xxhash

    from docweave.operators.chunking import loop_windows

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    chunks = {d * 10000 + k: " ".join(w[a:b]) for d, w in ((d, (x or "").split()) for d, x in docs) for k, (a, b) in enumerate(loop_windows(len(w), 442, 50, 100))}
    words = lambda s: re.findall("[a-z0-9]+", s.lower())

    def vector(s):
        v = np.zeros(256)
        for h in map(xxhash.xxh64_intdigest, words(s)):
            v[h % 256] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        v = (v / n if n else v).astype("float32").astype(float)
        n = np.linalg.norm(v)
        return v / n if n else v

    vectors = {i: vector(x) for i, x in chunks.items()}
    asked = queries._questions(spark, sf).collect()
    got = {r.query_id: r.answer for r in queries.hybrid_answer(spark, sf).collect()}
    assert len(got) == len(asked)
    for r in asked:
        text = r.text.strip()
        q = vector("Represent this sentence for searching relevant passages: " + text)
        score = {i: round(float(v @ q), 9) for i, v in vectors.items()}
        near = {i: n for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:30], 1)}
        sparse_rank = {i: n for n, (i, _) in enumerate(plain_bm25(list(chunks.items()), text)[:30], 1)}
        fused = {i: (1 / (60 + near[i]) if i in near else 0) + (1 / (60 + sparse_rank[i]) if i in sparse_rank else 0) for i in {*near, *sparse_rank}}
        first = sorted(fused, key=lambda i: (-fused[i], near.get(i, 99), sparse_rank.get(i, 99)))[:15]
        share = {i: len(set(words(text)) & set(words(chunks[i]))) / max(1, len(set(words(text)))) for i in first}
        best = max(first, key=lambda i: (share[i], -first.index(i)))
        assert got[r.query_id] == chunks[best], r.query_id
