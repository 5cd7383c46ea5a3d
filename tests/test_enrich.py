"""The Markdown path against values made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from docweave import markdown
from docweave.functions import text as t
from docweave.models import FunctionCaptioner
from docweave.plans import enrich
from docweave.plans.engine import Engine
from docweave.sources import readers


def parser_of_json():
    """A parser for documents that state their pages as JSON; local, so that workers get it by value."""

    class Parser:
        def page_count(self, content):
            return len(json.loads(content))

        def _page(self, content, page):
            return json.loads(content)[page - 1]

        def pages(self, content, first, last):
            return [p["markdown"] for p in json.loads(content)[first - 1 : last]]

        def page_size(self, content, page):
            return 600, 800

        def blocks(self, content, page):
            return [(b[0], (0, b[1], 600, b[1] + 10), b[2]) for b in self._page(content, page)["blocks"]]

        def rasters(self, content, page):
            return self._page(content, page)["rasters"]

        def vectors(self, content, page):
            return self._page(content, page)["vectors"]  # absent: the drawings can't be read

        def render(self, content, page, box, scale):
            w, h = int((box[2] - box[0]) * scale), int((box[3] - box[1]) * scale)
            return (f"png {w}x{h}".encode(), w, h)

    return Parser()


DOCUMENT = [
    {
        "markdown": "# Rivers\n\nThe first paragraph is about rivers.\n\nA second one is about mountains and lakes.\n\n",
        "blocks": [(0, 10, "Rivers"), (0, 60, "The first paragraph is about rivers."), (1, 70, "image"), (0, 400, "A second one is about mountains and lakes.")],
        # below the second paragraph; between the two; the same place again, as drawings; too flat; the whole page
        "rasters": [(50, 500, 250, 700), (50, 100, 350, 300), (0, 0, 600, 70), (0, 0, 600, 800)],
        "vectors": [(52, 102, 350, 300)],
    },
    {"markdown": "No figure here.\n\n\n\nAt all.", "blocks": [], "rasters": []},
    {"markdown": "", "blocks": [], "rasters": [(0, 100, 200, 300)], "vectors": []},
]
FIGURE = "Figure {0}.{1} Description:\n\n![page_{0}_img_{1}](../images/page_{0}_img_{1}.png)\n\n{2}\n"


def test_markdown_path(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text(json.dumps(DOCUMENT))
    (tmp_path / "in" / "b.PDF").write_text(json.dumps([{"markdown": "Only text.", "blocks": [], "rasters": [], "vectors": []}]))

    def load():
        def describe(content):
            if content == b"png 400x400":
                raise ValueError("can't see")
            return "assistant: a *map*  of " + content.decode()

        return describe

    out = f"file://{tmp_path}/out"
    for captioner in (None, FunctionCaptioner(load)):
        got = {r["document_id"]: r["markdown"] for r in enrich.enrich(spark, f"{tmp_path}/in", out, parser_of_json(), captioner).collect()}
        say = (lambda text: t.PLACEHOLDER) if captioner is None else (lambda text: f"*{text}*")
        page1 = "\n\n".join(["# Rivers", "The first paragraph is about rivers.", FIGURE.format(1, 1, say("a \\*map\\* of png 600x400")), "A second one is about mountains and lakes.", FIGURE.format(1, 2, say(t.NO_DESCRIPTION))])
        page3 = FIGURE.format(3, 1, say(t.NO_DESCRIPTION))
        assert got["a"] == f"<!-- page: 1 -->\n{page1}\n\n<!-- page: 2 -->\nNo figure here.\n\n\n\nAt all.\n\n<!-- page: 3 -->\n{page3}\n"
        assert got["b"] == "<!-- page: 1 -->\nOnly text.\n"
    assert (tmp_path / "out" / "images" / "a" / "page_3_img_1.png").read_bytes() == b"png 400x400"
    assert (tmp_path / "out" / "documents" / "a.md").read_text() == got["a"] and (tmp_path / "out" / "documents" / "b.md").exists()
    records = {r["image"]: r for r in spark.read.parquet(f"{out}/image_metadata").collect()}
    assert set(records) == {"page_1_img_1.png", "page_1_img_2.png", "page_3_img_1.png"}
    assert records["page_1_img_1.png"]["bbox"] == [50, 100, 350, 300] and records["page_1_img_1.png"]["description"] == "a *map* of png 600x400"


def test_engine_with_vision(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text(json.dumps(DOCUMENT))

    def load():
        def describe(content):
            return "" if content == b"png 400x400" else "a map of " + content.decode()

        return describe

    engine = Engine(spark, f"{tmp_path}/index", parser_of_json(), captioner=FunctionCaptioner(load))
    assert engine.ingest(f"{tmp_path}/in").images == 3
    # text chunks: descriptions stand after the paragraph above the picture
    text = engine.catalog.table(engine.catalog.current(), "chunks").where("source_type <> 'image'").collect()
    parts = ["The first paragraph is about rivers.", "Image description: a map of png 600x400", "A second one is about mountains and lakes.", "Image description: Figure 2 extracted from page(s) 1.", "No figure here. At all.", "Image description: Figure 3 extracted from page(s) 3."]
    assert [(r.raw_text, r.text, r.source_type, r.page_numbers) for r in text] == [(" ".join(parts), "Rivers. " + " ".join(parts), "text_with_image", [1, 2, 3])]
    chunks = engine.catalog.table(engine.catalog.current(), "chunks").where("source_type = 'image'").orderBy("id").collect()
    assert [(r.raw_text, r.page_numbers, r.metadata.image_path) for r in chunks] == [
        ("Image description from a. Image 0. a map of png 600x400", [1], "page_1_img_1.png"),
        ("Image description from a. Image 1. Figure 2 extracted from page(s) 1.", [1], "page_1_img_2.png"),
        ("Image description from a. Image 2. Figure 3 extracted from page(s) 3.", [3], "page_3_img_1.png"),
    ]
    assert engine.ingest(f"{tmp_path}/in").cached
    assert engine.ingest(f"{tmp_path}/in", process_vision=False).images == 0
    assert "Image description" not in engine.catalog.table(engine.catalog.current(), "chunks").first().raw_text


def test_own_captions_stand_in(spark, tmp_path):
    """A figure's own caption is taken where the model gives nothing."""
    (tmp_path / "a.pdf").write_text(json.dumps(DOCUMENT))
    parser = parser_of_json()
    type(parser).caption = lambda self, content, page, box: f"Map of page {page}" if page == 1 else None
    files = readers.read_files(spark, str(tmp_path))
    rows = enrich.picture_records(files, parser, FunctionCaptioner(lambda: lambda content: "")).orderBy("image_no").collect()
    assert [r.description for r in rows] == ["Map of page 1", "Map of page 1", "Figure 3 extracted from page(s) 3."]


def test_images_of_an_earlier_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text(json.dumps(DOCUMENT))
    old = tmp_path / "out" / "images" / "a" / "page_9_img_1.png"
    old.parent.mkdir(parents=True)
    for clean in (False, True):
        old.write_bytes(b"old")
        enrich.enrich(spark, f"{tmp_path}/in", f"file://{tmp_path}/out", parser_of_json(), clean=clean)
        assert old.exists() is not clean and (old.parent / "page_3_img_1.png").exists()


def test_captioner_stops_at_a_broken_device(spark, tmp_path):
    """The function isn't called again in a stream after such an error; other errors cost one image."""
    log = str(tmp_path / "log")

    def load():
        def describe(content):
            with open(log, "ab") as f:
                f.write(content + b"\n")
            if content in (b"2", b"4"):
                raise RuntimeError("CUDA error: gone" if content == b"4" else "blurred")
            return "seen"

        return describe

    rows = spark.createDataFrame([(bytes([48 + i]),) for i in range(1, 8)], "image binary").coalesce(1)
    got = [r.c for r in rows.select(FunctionCaptioner(load).describe(F.col("image")).alias("c")).collect()]
    assert [c.description for c in got] == ["seen", None, "seen"] + [None] * 4
    assert [c.error for c in got] == [None, "blurred", None] + ["CUDA error: gone"] * 4
    assert (tmp_path / "log").read_bytes().split() == [b"1", b"2", b"3", b"4"]


def test_repeats_and_broken_devices(spark):
    rows = [("d", p, 0, 0.0, 0.0, 100.0, 100.0, b"logo" if p != 3 else b"chart", 10, 10) for p in range(1, 7)]
    found = enrich.named_figures(spark.createDataFrame(rows, "document_id string, page_no int, region_no int, x0 double, y0 double, x1 double, y1 double, image binary, width int, height int"))
    assert sorted(r["file"] for r in found.collect()) == [f"page_{p}_img_1.png" for p in (1, 2, 3, 4)]

    def load():
        def describe(content):
            if content == b"chart":
                raise RuntimeError("CUDA error: broken")
            return "a logo"

        return describe

    got = {r["image"]: r["description"] for r in enrich.captioned(found, FunctionCaptioner(load)).collect()}
    skipped = "SKIPPED_GPU_CONTEXT_CORRUPTED - needs reprocessing"
    assert got == {"page_1_img_1.png": "a logo", "page_2_img_1.png": "a logo", "page_3_img_1.png": skipped, "page_4_img_1.png": skipped}


def test_no_documents_with_figures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text("[]")
    assert enrich.enrich(spark, f"{tmp_path}/in", f"file://{tmp_path}/out", parser_of_json()).count() == 0
    assert spark.read.parquet(f"file://{tmp_path}/out/image_metadata").where(F.col("page") > 0).count() == 0


def test_whole_documents_and_batches(spark):
    """A document's pages go to the parser at once, or in batches; ranges that fail are halved."""

    class Parser(readers.FormFeedParser):
        def pages(self, content, first, last):
            return [f"{first}-{last}"] * (last - first + 1)

    files = spark.createDataFrame([("d", b"\f" * 24), ("e", b"")], "document_id string, content binary")
    for whole, want in ((True, ["1-25"] * 25), (False, ["1-10"] * 10 + ["11-20"] * 10 + ["21-25"] * 5)):
        rows = readers.parse_pages(files, Parser(), whole=whole).where("document_id = 'd'").orderBy("page_no").collect()
        assert [r.markdown for r in rows] == want


def test_markdown_runner(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_text(json.dumps(DOCUMENT))
    (tmp_path / "a.txt").write_text("x")
    monkeypatch.setattr(markdown, "made", lambda name: parser_of_json() if name else None)
    said = []
    assert markdown.main([str(tmp_path / "a.pdf"), f"file://{tmp_path}/out", "--parser", "x:y"], said.append) == 0
    assert said[-1].startswith("1 documents in") and (tmp_path / "out/documents/a.md").exists()
    assert markdown.main([str(tmp_path / "a.txt"), f"file://{tmp_path}/out", "--parser", "x:y"], said.append) == 1 and "unsupported" in said[-1]
    assert markdown.main([str(tmp_path / "none"), f"file://{tmp_path}/out", "--parser", "x:y"], said.append) == 1


def test_names_of_plug_ins():
    assert markdown.made(None) is None and isinstance(markdown.made("docweave.sources.readers:FormFeedParser"), readers.FormFeedParser)
    with pytest.raises(ValueError):
        markdown.made("docweave")
