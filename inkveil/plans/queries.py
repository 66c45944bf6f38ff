"""The engine's operators as registered queries over whole tables."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import geometry as geo
from inkveil.functions import grid as grids
from inkveil.functions.text import clamp_confidence, defuse, held
from inkveil.operators import layout, links, merge, model_text, model_vision, paint, patterns
from inkveil.options import GridOptions
from inkveil.plans import pipeline
from inkveil.sources import files, text_layout
from inkveil.sources.tables import read_table
from inkveil.targets import BUILTIN, PHONE, SOCIAL, URL_BARE, URL_EXPLICIT, URL_PATH, URL_SIGNS, Target, resolve_targets

#: Lines for shapes that the tables lack; ids below zero.
LITERALS = [
    (-1, "Profile linkedin.com/in/jane-doe, code https://github.com/jane and uk.linkedin.com/x not linkedin.com"),
    (-2, "DOB: 1 Feb 1990\nDate of Birth 02/03/1991\nborn\nBorn in 1980, lives there\nissued 31-12-2019 v1.2.2000 40/40/2000"),
    (-3, "Mobile: +91 98765 43210 and 2019-2024 and 555 1234 or tel 555 1234, 123456789% of 1234567890123456"),
    (-4, "see https://x.com/activity:7123456789012345678 and www.credly.com/badges/12345678-1234 dob 01/02/1990"),
    (-5, "Node.js, main.py, 3.14, ghstmail.space, a.b.co/x, jane@ghost.io, docs.example.dev"),
    (-6, "Email: jane.doe @ example.com; JANE@EXAMPLE.ORG, bad@x"),
]
CUSTOM = Target("batch", "A batch mark.", (r"[a-z]{3}ing of",))


#: What the engine's queries read of the tables that hold texts.
TEXTS = {"documents": ["doc_id", "text"], "pages": ["page_id", "url", "html"]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", TEXTS.get(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and the literal lines."""
    own = spark.createDataFrame(LITERALS, "doc_id bigint, text string")
    return _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(own)


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as text: the address, then the source; and the literal lines."""
    own = spark.createDataFrame(LITERALS, "doc_id bigint, text string")
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat("url", F.lit("\n"), "html").alias("text")).unionByName(own)


def flat(df: DataFrame) -> DataFrame:
    """Boxes as four columns and word ids as one string, for comparing."""
    out = []
    for name, kind in df.dtypes:
        if name == "box":
            out += [F.col(f"box.{c}").alias(c) for c in ("x", "y", "width", "height")]
        elif name == "word_ids":
            out.append(F.array_join("word_ids", ",").alias("word_ids"))
        elif name != "seq":
            out.append(F.col(name))
    return df.select(*out)


def _detect(source: Callable, targets: list, guarded: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = text_layout.text_lines(source(spark, sf_dir))
        found = patterns.detect_patterns(lines, resolve_targets(targets), guarded)
        return flat(found.withColumn("line_no", F.get("seq", F.lit(2)))).drop("confidence", "source")

    return query


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_layout.text_lines(_table(spark, sf_dir, "documents")).withColumn("first", F.col("first").cast("long"))


def layout_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(text_layout.text_words(_table(spark, sf_dir, "documents")))


def lines_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = layout.build_lines(text_layout.text_words(_table(spark, sf_dir, "documents")))
    return built.select("doc_id", "page", "line_no", "text", F.size("words").alias("n_words"))


def _lifted(words: DataFrame) -> DataFrame:
    """Words whose tops differ by up to 12 pixels within a line, so that lines must be found by their bands."""
    return words.withColumn("box", geo.box(F.col("box.x"), F.col("box.y") + (F.col("ord") % 3) * 6, F.col("box.width"), F.col("box.height")))


def line_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _lifted(text_layout.text_words(_table(spark, sf_dir, "documents"))).drop("line")
    return layout.line_numbers(words).select("doc_id", "page", "ord", F.col("line").cast("int").alias("line"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(text_layout.text_words(_table(spark, sf_dir, "documents"))).select("doc_id", "page", "word_id", F.col("rank").cast("int").alias("rank"))


def word_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each line that its characters 5 to 15 touch."""
    lines = layout.build_lines(text_layout.text_words(_table(spark, sf_dir, "documents")))
    hit = layout.words_in_range(F.col("words"), F.lit(5), F.lit(15))
    rows = lines.select("doc_id", "page", "line_no", F.explode(hit).alias("w"))
    return rows.select("doc_id", "page", "line_no", "w.word_id", F.col("w.box.x").alias("x"), F.col("w.text").alias("text"))


def union_box_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(layout.union_boxes(text_layout.text_words(_table(spark, sf_dir, "documents")), ["doc_id", "page", "line"]))


def url_veto_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone matches that the veto drops: those of guarded matches that lie in an address."""
    lines = text_layout.text_lines(_web(spark, sf_dir))
    phone = F.filter(patterns.matches(F.col("text"), PHONE, patterns.AROUND), lambda m: patterns.guard("phone", m))
    hits = held(held(lines, hits=phone).filter(F.size("hits") > 0), urls=patterns.url_matches(F.col("text")))
    inside = F.filter("hits", lambda m: patterns.in_url(F.col("urls"), m))
    return hits.select("doc_id", "page", "line_no", F.explode(inside).alias("m")).select("doc_id", "page", "line_no", "m.start", "m.raw")


def _anchors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return text_layout.html_links(_table(spark, sf_dir, "pages"))


def link_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(_anchors(spark, sf_dir)[1]).withColumn("link_ord", F.col("link_ord").cast("int"))


def link_words_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, found = _anchors(spark, sf_dir)
    met = links.link_words(found, words)
    return met.select("doc_id", "page", F.col("link_ord").cast("int").alias("link_ord"), F.size("covered").alias("n_words"), F.array_join(F.transform("covered", lambda w: w["text"]), " ").alias("anchor"))


def _links(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        words, found = _anchors(spark, sf_dir)
        found = links.detect_links(found, words, resolve_targets(["social", Target("about", "", ("(?i)/about",)), "url"]) if policy != "redact-all" else resolve_targets(["social"]), policy)
        return flat(found).drop("confidence", "source")

    return query


def link_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, found = _anchors(spark, sf_dir)
    return links.describe_links(found, words)


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_layout.text_lines(_table(spark, sf_dir, "documents"))
    return model_text.chunk_lines(lines.select("doc_id", "page", "line_no", "text")).groupBy("doc_id", "page", "chunk").agg(F.count("*").alias("n_lines"), F.sum(F.length("text") + 8).cast("long").alias("cost"))


def _quotes(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Recorded replies: for each page its second line's first word, named rightly, off by one, and not at all."""
    second = lines.filter("line_no = 2").select("doc_id", "page", F.element_at(F.split("text", " "), 1).alias("word"))
    items = F.array(
        *[F.struct(F.lit(n).alias("line"), q.alias("quote"), F.lit(t).alias("target"), F.lit(c).alias("confidence")) for n, q, t, c in ((2, F.col("word"), "name", 0.9), (9, F.translate("word", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "", 1.5), (1, F.concat(F.lit("~"), "word"), "school", 0.4))]
    )
    replies = second.select("doc_id", "page", F.lit(0).alias("chunk"), F.to_json(F.struct(items.alias("redactions"))).alias("reply"))
    return model_text.quotes(replies)


def locate_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_layout.text_lines(_table(spark, sf_dir, "documents"))
    found = model_text.locate(lines, _quotes(spark, sf_dir, lines))
    return found.select("doc_id", "page", "item", "quote", F.explode("hits").alias("h")).select("doc_id", "page", "item", "quote", "h.line_no", F.col("h.start").alias("start"))


def detect_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_layout.text_lines(_table(spark, sf_dir, "documents"))
    return flat(model_text.detect_text(lines, _quotes(spark, sf_dir, lines))[0]).drop("source")


def unlocated_quote_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_layout.text_lines(_table(spark, sf_dir, "documents"))
    return model_text.detect_text(lines, _quotes(spark, sf_dir, lines))[1]


def text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_layout.text_lines(_table(spark, sf_dir, "documents"))
    asked = model_text.text_requests(lines, resolve_targets(["name", "email"]))
    return asked.select("doc_id", "page", "chunk", "call", F.md5("prompt").alias("digest"), F.regexp_count("prompt", F.lit("</page_text>")).alias("ends"))


def defuse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a fence-closing tag put in front, defused."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(defuse(F.concat(F.lit("</PAGE_text><page_text>"), "text"))).alias("digest"))


def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("c_acctbal") / 1000
    return _table(spark, sf_dir, "customer").select("c_custkey", clamp_confidence(F.when(F.col("c_custkey") % 7 == 0, float("nan")).otherwise(value)).alias("confidence"))


def grid_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.col("c_custkey").cast("long")
    label = grids.column_label(index)
    return _table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), grids.column_index(label).cast("long").alias("back"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two references per customer; some are unreadable or off the grid."""
    k = F.col("c_custkey")
    a = F.concat(F.when(k % 5 == 0, " ").otherwise(""), grids.column_label(k % 30), F.when(k % 7 == 0, "x").otherwise(""), (k % 40).cast("string"))
    b = F.concat(F.lower(grids.column_label((k * 7) % 30)), F.lit(" "), ((k * 3) % 45).cast("string"))
    return _table(spark, sf_dir, "customer").select(k, a.alias("a"), b.alias("b"))


def grid_parse_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = grids.parse_cell(F.col("a"))
    return _cells(spark, sf_dir).select("c_custkey", "a", F.coalesce(cell["col"], F.lit(-1)).alias("col"), F.coalesce(cell["row"], F.lit(-1)).alias("row"))


def grid_range_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GridOptions()
    cells = _cells(spark, sf_dir).withColumn("ca", grids.parse_cell(F.col("a"))).withColumn("cb", grids.parse_cell(F.col("b"))).filter("ca is not null and cb is not null")
    return flat(cells.select("c_custkey", grids.range_box(F.col("ca"), F.col("cb"), g.cols, g.rows, F.lit(612.0), F.lit(840.0)).alias("box")))


def _vision_replies(sizes: DataFrame) -> DataFrame:
    """One reply per page: two readable regions, one unreadable, one off the grid."""
    reply = json.dumps({"redactions": [{"target": "name", "from": "A1", "to": "D2", "confidence": 0.95}, {"target": "photo", "from": "C9", "to": "b3", "confidence": 0.7}, {"target": "school", "from": "?", "to": "B2", "confidence": 1}, {"target": "", "from": "AZ1", "to": "BA2", "confidence": 1}]})
    return sizes.select("doc_id", "page", F.lit(reply).alias("reply"))


def snap_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sizes = text_layout.page_sizes(docs)
    found = model_vision.regions(_vision_replies(sizes), sizes)
    return flat(model_vision.snap(found.filter("region is not null"), text_layout.text_lines(docs))).drop("confidence")


def detect_model_vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sizes = text_layout.page_sizes(docs)
    found = model_vision.regions(_vision_replies(sizes), sizes)
    return flat(model_vision.detect_vision(found, text_layout.text_lines(docs), resolve_targets(["name", "photo"]))[0]).drop("source")


def vision_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sizes = text_layout.page_sizes(docs)
    return model_vision.detect_vision(model_vision.regions(_vision_replies(sizes), sizes), text_layout.text_lines(docs), resolve_targets(["name"]))[1]


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection per order line, with boxes on a coarse lattice so that many overlap; an order's lines share a page."""
    item = _table(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    box = geo.box(q % 5 * 10, n % 3 * 8, F.lit(30) + q % 7 * 2 - F.when(q % 11 == 0, 60).otherwise(0), F.lit(12) + n % 2 * 3)
    return item.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.element_at(F.array(*map(F.lit, ("email", "phone", "url"))), (n % 3 + 1)).alias("target"), box.alias("box"),
        F.when(n % 4 != 0, F.col("l_returnflag")).alias("text"), F.col("l_discount").alias("_d"), (F.lit(0.4) + F.col("l_discount") * 4).alias("confidence"),
        F.when(n % 2 == 0, "pattern").otherwise("llm-text").alias("source"), F.array(F.concat(F.lit("w"), (n % 4).cast("string"))).alias("word_ids"), F.array(n).alias("seq"),
    ).drop("_d")


def merge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(merge.worth_painting(_boxes(spark, sf_dir).withColumn("line", F.get("seq", F.lit(0))), 0.5)).drop("word_ids")


def merge_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(merge.merge_detections(_boxes(spark, sf_dir), 0.5))


def pad_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = merge.merge_detections(_boxes(spark, sf_dir), 0.5)
    sizes = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(50.0).alias("width"), F.lit(20.0).alias("height"))
    return flat(merge.pad_detections(regions, 2.0, sizes)).select("doc_id", "page", "ord", "x", "y", "width", "height")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 500).alias("has_text"), F.lit(0).alias("page"))
    targets = resolve_targets(["email", "photo"])
    plans = [pipeline.plan_pages(docs, targets, mode).withColumn("mode", F.lit(mode)) for mode in ("auto", "text", "vision", "patterns-only")]
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out


def plan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("doc_id", "mode", "plan_text", "plan_vision", F.array_join("vision_targets", ",").alias("vision_targets"))


def page_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = _planned(spark, sf_dir)
    out = None
    for mode in ("auto", "text", "vision", "patterns-only"):
        w = pipeline.page_warnings(planned.filter(F.col("mode") == mode), provider=False).withColumn("mode", F.lit(mode))
        out = w if out is None else out.unionByName(w)
    return out.select("doc_id", "mode", F.col("ord").cast("int").alias("ord"), "warning")


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pipeline.audit_counts(merge.merge_detections(_boxes(spark, sf_dir), 0.5))
    return counts.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("detection_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


def audit_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    found = pipeline.ordered_distinct(rows, "l_orderkey", "l_returnflag", ["l_linenumber"], "flags")
    return found.select("l_orderkey", F.array_join("flags", ",").alias("flags"))


def sniff_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of files over the documents' texts."""
    heads = ("255044462D312E34", "89504E470D0A1A0A00", "FFD8FFE0", "524946460000000057454250AA", "52494646", "504B0304")
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 6 + 1).cast("int")))
    docs = _table(spark, sf_dir, "documents")
    data = F.when(F.col("doc_id") % 12 < 6, head).otherwise(F.concat(head, F.encode("text", "UTF-8")))
    return docs.select("doc_id", files.sniff(data).alias("kind"))


def size_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a document, its lines are pages."""
    item = _table(spark, sf_dir, "lineitem")
    pages = item.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 72).alias("point_width"), (F.col("l_quantity") * 48).alias("point_height"))
    return files.check_limits(pages, 144, 6)


def proxy_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = ("Courier-Bold", "TimesNewRoman", "Arial", "sans-serif", "Consolas", "Garamond")
    name = F.element_at(F.array(*map(F.lit, fonts)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", layout.proxy_family(name).alias("family"))


def words_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as monospace runs: 6 pixels a character come out again."""
    lines = text_layout.text_lines(_table(spark, sf_dir, "documents"))
    runs = lines.select("doc_id", "page", F.col("line_no").alias("ord"), "text", (F.length("text") * 6.0).alias("width"), F.lit(10.0).alias("font_height"), F.lit(0.0).alias("left"), (F.col("slot") * 14.0).alias("baseline"), F.lit("Courier").alias("font"))
    words = layout.words_from_runs(runs)
    return words.select("doc_id", "page", "ord", "text", F.round("box.x", 3).alias("x"), F.round("box.y", 3).alias("y"), F.round("box.width", 3).alias("width"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the layout as an OCR engine gives them, nested in blocks, with confidences by place."""
    words = text_layout.text_words(_table(spark, sf_dir, "documents"))
    b = F.col("box")
    word = F.struct(F.col("text"), (F.col("ord") % 50 * 2).cast("double").alias("confidence"), F.struct(b["x"].alias("x0"), b["y"].alias("y0"), geo.right(b).alias("x1"), geo.bottom(b).alias("y1")).alias("bbox"))
    lines = words.groupBy("doc_id", "page", "line").agg(F.struct(F.array_sort(F.collect_list(F.struct("ord", word.alias("w")))).alias("w")).alias("l"))
    lines = lines.select("doc_id", "page", "line", F.struct(F.transform("l.w", lambda x: x["w"]).alias("words")).alias("l"))
    blocks = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "l"))).alias("ls"))
    tree = F.array(F.struct(F.array(F.struct(F.transform("ls", lambda x: x["l"]).alias("lines"))).alias("paragraphs")))
    found = files.ocr_words(blocks.select("doc_id", "page", files.flatten_ocr(tree).alias("words")))
    return found.groupBy("doc_id", "page").agg(F.count("*").alias("n_words"), F.countDistinct("line").alias("n_lines"), F.sum(F.length("text")).alias("letters"))


def target_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, t.id, len(t.patterns), t.visual_only) for n, t in enumerate(resolve_targets([*BUILTIN, "email"]))]
    return spark.createDataFrame(rows, "ord int, id string, n_patterns int, visual_only boolean")


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents searched by all text patterns, merged and padded, counted per document."""
    from inkveil.options import RedactOptions

    result = pipeline.redact(pipeline.text_pages(_table(spark, sf_dir, "documents")), RedactOptions(("email", "phone", "social", "url", "dob"), mode="patterns-only", style="box"))
    a = result.audit
    return a.select("doc_id", "pages", F.array_join(F.transform(F.array_sort(F.map_entries("detection_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


def _blank(docs: DataFrame) -> DataFrame:
    """Pictures of all pages. Long lines are wrapped."""
    return paint.blank_slots(text_layout.wrapped_pages(docs))


def _regions(docs: DataFrame) -> DataFrame:
    """What to cover on the wrapped pages, with the width and height of its page. Only documents that may have a match are laid out for it."""
    targets = resolve_targets(["email", "phone"])
    some = docs.filter(patterns.may_match(F.col("text"), targets))
    regions = merge.merge_detections(patterns.detect_patterns(text_layout.text_lines(some), targets))
    return text_layout.wrapped_boxes(regions, text_layout.wrapped_sizes(some))


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pictures of all pages, the regions to cover, and the sizes. Long lines are wrapped, in pictures and boxes alike."""
    docs = _table(spark, sf_dir, "documents")
    sizes = text_layout.wrapped_sizes(docs)
    return _blank(docs), _regions(docs).drop("width", "height"), sizes


def _paint(style: str) -> Callable[[SparkSession, str], DataFrame]:
    """What painted pages show; how much of a region is black is told for boxes only."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _table(spark, sf_dir, "documents")
        regions = _regions(docs)
        padded = regions.withColumn("box", geo.padded(F.col("box"), 2.0, F.col("width"), F.col("height")))
        found = paint.digests(paint.paint_pages(_blank(docs), padded, style, keep_boxes=True))
        return found if style == "box" else found.drop("black")

    return query


def grid_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under their grid: the size with its margin."""
    png = paint.grid_overlays(_blank(_table(spark, sf_dir, "documents")))
    size = lambda at: F.conv(F.hex(F.substring("image", at, 4)), 16, 10).cast("long")
    return png.select("doc_id", "page", size(17).alias("width"), size(21).alias("height"))


def build_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rebuilt from pixels, read again: their pages, and the text runs and links in them."""
    images, regions, _ = _drawn(spark, sf_dir)
    pdfs = paint.build_pdfs(paint.paint_pages(images, regions, "box")).select("doc_id", F.col("pdf").alias("content"))
    return files.pdf_counts(pdfs)


def _own_pdf(key: int, name: str, segment: str) -> bytes:
    """Two pages in the tree's order, not the file's; a box that begins elsewhere; a scaled space; deflated streams. Every tenth is cut short."""
    stream = lambda n, text: b"%d 0 obj<</Filter/FlateDecode>>stream\n%s\nendstream endobj\n" % (n, zlib.compress(b"q 2 0 0 2 5 7 cm BT /F1 10 Tf %d %d Td (%s) Tj ET Q" % (key % 100, 100 + key % 50, text.encode())))
    out = b"%PDF-1.5\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/MediaBox[20 30 632 822]/Kids[5 0 R 3 0 R]>>endobj\n"
    out += b"3 0 obj<</Type/Page/Contents 4 0 R>>endobj\n" + stream(4, segment)
    out += b"5 0 obj<</Type/Page/Contents 6 0 R/Rotate 90>>endobj\n" + stream(6, name)
    return out[:70] if key % 10 == 0 else out


def pdf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per customer, its name on the first page and its segment on the second; what is read of it, and what could not be."""

    def told(batches):
        for batch in batches:
            made = [_own_pdf(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], names=["doc_id", "content"])

    made = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").mapInArrow(told, "doc_id string, content binary")
    _, runs, _, errors = files.pdf_layers(made, 72)
    rows = runs.select("doc_id", "page", "text", *[F.round(c, 3).alias(c) for c in ("left", "baseline", "font_height")])
    nothing = [F.lit(None).cast("double").alias(c) for c in ("left", "baseline", "font_height")]
    lost = errors.select("doc_id", F.lit(-1).alias("page"), F.substring_index("error", ":", 1).alias("text"), *nothing)
    return rows.unionByName(lost).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def advance_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relative width of each part's name in each face."""
    faces = F.explode(F.array(*map(F.lit, ("monospace", "serif", "sans-serif")))).alias("family")
    return _table(spark, sf_dir, "part").select("p_partkey", "p_name", faces).select("p_partkey", "family", F.round(layout.text_advance(F.col("p_name"), F.col("family")), 6).alias("width"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        layout_lines, layout_words, lines_from_words, line_assign, reading_order, word_range_overlap, union_box_per_line, url_veto_antijoin,
        link_annotations, link_words_join, link_context, chunk_lines, locate_quote, detect_model_text, unlocated_quote_warnings, text_requests, defuse_text,
        grid_label, grid_parse_cell, grid_range_box, snap_to_words, detect_model_vision, vision_warnings, merge_filter, merge_detections, pad_detections,
        plan_page, page_warnings, audit_counts, audit_distinct, sniff_bytes, size_limits, proxy_family, words_from_runs, ocr_words, target_registry,
        redact_documents, grid_overlay, build_pdf, pdf_runs, advance_widths,
    )
    own = {f.__name__: f for f in plain} | {"clamp_confidence": clamped}
    own |= {f"detect_{t}": _detect(_documents, [t]) for t in ("email", "phone", "social", "dob")}
    own |= {"detect_phone_unguarded": _detect(_documents, ["phone"], guarded=False), "custom_target": _detect(_documents, [CUSTOM])}
    shapes = {"explicit": URL_EXPLICIT, "path": URL_PATH, "bare": URL_BARE}
    own |= {f"detect_url_{k}": _detect(_web, [Target("url", "", (p,), needs=URL_SIGNS)]) for k, p in shapes.items()}
    own |= {f"links_{k}": _links(p) for k, p in (("keep", "keep"), ("identifying", "redact-identifying"), ("all", "redact-all"))}
    return own | {f"paint_{s}": _paint(s) for s in ("box", "label", "pixelate", "blur")}
