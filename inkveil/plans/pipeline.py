"""The whole flow as one plan: lines, detections, regions, warnings, audit, outputs.

Each branch that the options rule out is not built. Detections are the only rows
that move, by page; texts and pictures stay where they are until the sinks.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.errors import ProviderFailure, UnsupportedInput
from inkveil.functions.raster import PNG_MAGIC
from inkveil.operators import model_text, model_vision, prompts
from inkveil.operators.layout import PAGE
from inkveil.operators.links import describe_links, detect_links
from inkveil.operators.merge import merge_detections, pad_detections
from inkveil.operators.paint import STYLE_WARNING, build_pdfs, grid_overlays, paint_pages
from inkveil.operators.patterns import DETECTION, detect_patterns
from inkveil.options import RedactOptions
from inkveil.providers import Provider, ask, replay
from inkveil.targets import Target, resolve_targets

NO_PROVIDER = "page %d: no provider was passed, so only patterns and links were searched; targets that take judgement (name, address, employer) were not found."
NOTHING_READ = "page %d: no text could be read and vision did not run, so nothing on this page was checked."


@dataclass(frozen=True)
class Pages:
    """A document set: pages (doc_id, page, width, height, text_source, and has_text where it is known), lines, words, links; image in a table of its own."""

    pages: DataFrame
    lines: DataFrame
    words: DataFrame
    links: DataFrame | None = None
    images: DataFrame | None = None
    context: DataFrame | None = None  # doc_id, markdown
    warnings: DataFrame | None = None  # doc_id, warning: what loading told


@dataclass(frozen=True)
class Result:
    """Tables by document: regions (merged and padded), warnings, audit, painted pages and PDFs where the options ask for them."""

    regions: DataFrame
    warnings: DataFrame
    audit: DataFrame
    images: DataFrame | None
    pdfs: DataFrame | None


def plan_pages(pages: DataFrame, targets: list[Target], mode: str = "auto") -> DataFrame:
    """pages (with has_text) with plan_text, plan_vision and vision_targets: what a model is asked about each page."""
    visual, every = [t.id for t in targets if t.visual_only], [t.id for t in targets]
    text = F.col("has_text") & F.lit(len(visual) < len(every))
    ids = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    no = F.lit(False)
    if mode == "patterns-only":
        plan = (no, no, ids([]))
    elif mode == "text":
        plan = (text, no, ids([]))
    elif mode == "vision":
        plan = (no, F.lit(True), ids(every))
    else:
        vision = F.lit(bool(visual)) | (~F.col("has_text") & F.lit(bool(every)))
        plan = (text, vision, F.when(F.col("has_text"), ids(visual)).otherwise(ids(every)))
    return pages.withColumns({"plan_text": plan[0], "plan_vision": plan[1], "vision_targets": plan[2]})


def page_warnings(planned: DataFrame, provider: bool) -> DataFrame:
    """doc_id, page, ord, warning for pages that a model should have seen, and for pages that nothing could read."""
    number = F.col("page") + 1
    none = F.when((F.col("plan_text") | F.col("plan_vision")) & F.lit(not provider), F.format_string(NO_PROVIDER, number))
    blind = F.when(~F.col("has_text") & ~F.col("plan_vision"), F.format_string(NOTHING_READ, number))
    rows = planned.select(*PAGE, F.posexplode(F.array(none, blind)).alias("ord", "warning"))
    return rows.filter(F.col("warning").isNotNull())


def audit_counts(regions: DataFrame) -> DataFrame:
    """doc_id, detection_counts: how many regions each (merged) target has."""
    counts = regions.groupBy("doc_id", "target").count()
    return counts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "count")))).alias("detection_counts"))


def ordered_distinct(rows: DataFrame, key: str, value: str, order: list[str], out: str) -> DataFrame:
    """Per key the values in the order first seen, each once."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_at"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v")))).alias("_l"))
    return listed.select(key, F.transform("_l", lambda x: x["v"]).alias(out))


def build_audit(pages: DataFrame, regions: DataFrame, warnings: DataFrame, calls: DataFrame, options: RedactOptions, targets: list[Target], provider: str | None, started: float) -> DataFrame:
    """One row per document, also for one that has warnings only, as nothing of it could be read."""
    docs = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    docs = docs.join(warnings.select("doc_id").distinct(), "doc_id", "full").withColumn("pages", F.coalesce("pages", F.lit(0)))
    sources = ordered_distinct(pages, "doc_id", "text_source", ["page"], "text_sources")
    told = ordered_distinct(warnings, "doc_id", "warning", ["stage", "page", "ord"], "warnings")
    used = calls.groupBy("doc_id").agg(F.sum("calls").alias("llm_calls"))
    out = docs
    for part in (sources, audit_counts(regions), told, used):
        out = out.join(part, "doc_id", "left")
    empty = F.create_map().cast("map<string,bigint>")
    return out.select(
        "doc_id", F.array(*[F.lit(t.id) for t in targets]).cast("array<string>").alias("targets"), F.lit(options.mode).alias("mode"), F.lit(options.link_text).alias("link_text"),
        F.lit(provider).cast("string").alias("provider"), "pages", F.lit(options.dpi).alias("dpi"), "text_sources", F.coalesce("detection_counts", empty).alias("detection_counts"),
        F.coalesce("llm_calls", F.lit(0)).alias("llm_calls"), F.lit(int((time.time() - started) * 1000)).cast("long").alias("plan_ms"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )


def redact(
    source: Pages,
    options: RedactOptions,
    provider: Provider | None = None,
    recorded: tuple[DataFrame | None, DataFrame | None] = (None, None),
    keep: Callable[[DataFrame], DataFrame] | None = None,
    at_once: int = 8,
) -> Result:
    """Finds and covers what options.targets name.

    recorded holds replies to text and vision requests by (doc_id, call), played
    back instead of asking provider. keep writes a table and reads it again; it is
    needed where a live model answers, as asking twice may give two answers.
    """
    started = time.time()
    targets = resolve_targets(options.targets)
    spark = source.pages.sparkSession
    known = source.pages
    if "has_text" not in known.columns:  # a layout that knows saves the pass over the words
        has = source.words.groupBy(*PAGE).agg(F.lit(True).alias("has_text"))
        known = known.join(has, PAGE, "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))
    planned = plan_pages(known, targets, options.mode)
    asked_any = provider is not None or any(r is not None for r in recorded)
    can_see = recorded[1] is not None or source.images is not None
    if asked_any and not can_see:  # without pictures there is nothing to show
        planned = planned.withColumn("plan_vision", F.lit(False))

    options.progress("detect-patterns")
    found = detect_patterns(source.lines, targets)
    warned = [page_warnings(planned, asked_any).withColumn("stage", F.lit(1))]
    calls = [spark.createDataFrame([], f"doc_id {source.pages.schema['doc_id'].dataType.simpleString()}, calls long")]
    if source.links is not None and options.link_text != "keep":
        found = found.unionByName(detect_links(source.links, source.words, targets, options.link_text))

    def answered(requests: DataFrame, played: DataFrame | None, system: str, schema: dict, tokens: int, images: bool = False) -> DataFrame:
        if played is not None:
            return replay(requests, played)
        if keep is None:
            raise ProviderFailure("a live provider needs keep, a function that writes a table and reads it again", provider.name)
        return keep(ask(requests, provider, system, schema, tokens, at_once, images))

    if asked_any and options.mode in ("auto", "text") and (provider or recorded[0] is not None) and any(not t.visual_only for t in targets):
        options.progress("detect-text")
        lines = source.lines.join(planned.filter("plan_text").select(*PAGE), PAGE, "left_semi")
        sections = describe_links(source.links, source.words) if source.links is not None else None
        requests = model_text.text_requests(lines, targets, sections, source.context)
        replies = answered(requests, recorded[0], prompts.TEXT_SYSTEM, prompts.TEXT_SCHEMA, 8192)
        detections, told = model_text.detect_text(source.lines, model_text.quotes(replies))
        found = found.unionByName(detections)
        warned.append(told.withColumn("ord", F.lit(0)).withColumn("stage", F.lit(2)))
        calls.append(requests.groupBy("doc_id").agg(F.count("*").alias("calls")))
    if asked_any and options.mode in ("auto", "vision") and can_see and (provider or recorded[1] is not None):
        seen = planned.filter("plan_vision")
        options.progress("detect-vision")
        groups = [(seen, targets)] if options.mode == "vision" else [(seen.filter("has_text"), [t for t in targets if t.visual_only]), (seen.filter("not has_text"), targets)]
        for some, wanted in groups:
            requests = model_vision.vision_requests(some, wanted, options.grid)
            if recorded[1] is None:
                requests = requests.join(grid_overlays(source.images.join(some.select(*PAGE), PAGE, "left_semi"), options.grid), PAGE)
            replies = answered(requests, recorded[1], prompts.VISION_SYSTEM, prompts.VISION_SCHEMA, 4096, images=recorded[1] is None)
            regions = model_vision.regions(replies, source.pages, options.grid)
            detections, told = model_vision.detect_vision(regions, source.lines if "slot" in source.lines.columns else source.words, targets, options.grid, options.snap_visual)
            found = found.unionByName(detections)
            warned.append(told.withColumn("ord", F.lit(1)).withColumn("stage", F.lit(3)))
            calls.append(requests.groupBy("doc_id").agg(F.count("*").alias("calls")))

    regions = pad_detections(merge_detections(found, options.min_confidence), options.padding, source.pages)
    options.progress("apply")
    if options.style in ("blur", "pixelate"):
        style = source.pages.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("ord"), F.lit(STYLE_WARNING.format(options.style)).alias("warning"), F.lit(9).alias("stage"))
        warned.append(style)
    if source.warnings is not None:
        warned.append(source.warnings.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("ord"), "warning", F.lit(0).alias("stage")))
    warnings, total = warned[0], calls[0]
    for w in warned[1:]:
        warnings = warnings.unionByName(w)
    for c in calls[1:]:
        total = total.unionByName(c)
    images = paint_pages(source.images, regions, options.style) if source.images is not None else None
    name = provider.name if provider is not None else ("recorded" if asked_any else None)
    audit = build_audit(source.pages, regions, warnings, total, options, targets, name, started)
    pdfs = build_pdfs(images, options.dpi) if images is not None and options.output in ("pdf", "both") else None
    return Result(regions, warnings, audit, images if options.output in ("images", "both") else None, pdfs)


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Pages:
    """Plain text as fixed-pitch pages."""
    from inkveil.sources.text_layout import page_sizes, text_lines, text_words

    source = F.when(F.col("has_text"), "pdf-text-layer").otherwise("none")
    pages = page_sizes(docs, id_col, text_col).withColumn("text_source", source)
    return Pages(pages, text_lines(docs, id_col, text_col), text_words(docs, id_col, text_col))


UNPAINTED = "no renderer was given, so this PDF was searched, and no page of it was painted"


def file_pages(
    files: DataFrame,
    options: RedactOptions,
    render: Callable[[bytes, int], list] | None = None,
    ocr: Callable | None = None,
    pictures: DataFrame | None = None,
) -> Pages:
    """Files as pages. PDFs give words and links; their pictures take a renderer, a function from (bytes, dpi) to RGB arrays.

    PNG files are decoded here; other pictures come from ``pictures``, as
    read_images gives them. Pages without words are read by ocr, a function from
    a language to an engine (see recognise), unless options.ocr is off; without an
    engine a warning says so once a document. Files of other kinds, files that
    cannot be read, and documents over the limits are left out and told of in
    warnings, as are PDFs that nothing can draw.
    """
    import pyarrow as pa

    from inkveil.functions.raster import encode_png
    from inkveil.operators.layout import build_lines, page_words
    from inkveil.sources import files as fs

    kind = fs.sniff(F.col("content"))
    named = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    sizes, runs, links, errors = fs.pdf_layers(files, options.dpi)
    limits = fs.check_limits(sizes, options.dpi, options.max_pages)
    good = limits.filter("error is null").select("doc_id")
    words = page_words(runs.join(good, "doc_id", "left_semi"))
    sizes, links = sizes.join(good, "doc_id", "left_semi"), links.join(good, "doc_id", "left_semi")
    has = words.groupBy(*PAGE).agg(F.lit("pdf-text-layer").alias("text_source"))
    pdf_pages = sizes.join(has, PAGE, "left").withColumn("text_source", F.coalesce("text_source", F.lit("none")))
    own = fs.image_rows(files)
    if pictures is not None:
        others = named.filter((kind == "image") & ~F.col("content").startswith(F.lit(PNG_MAGIC))).select("doc_id")
        decoded = others.join(pictures, "doc_id", "left").withColumn("page", F.lit(0))
        lost = F.when(F.col("image").isNull(), F.lit(fs.told_failure("picture", ValueError("the decoder gave nothing"))))
        decoded = decoded.withColumn("error", lost).select(*own.columns)
        own = own.join(others, "doc_id", "left_anti").unionByName(decoded)
    drawn_pictures = own.filter("error is null").drop("error")
    pages = pdf_pages.unionByName(drawn_pictures.select(*pdf_pages.columns))
    images = drawn_pictures.select("doc_id", "page", "image")
    told = [limits.filter("error is not null").select("doc_id", F.concat(F.lit(f"{UnsupportedInput.code}: "), "error").alias("warning"))]
    told += [x.filter("error is not null").select("doc_id", F.col("error").alias("warning")) for x in (errors, own)]
    told.append(named.filter(kind == "unsupported").select("doc_id", F.lit(f"{UnsupportedInput.code}: {fs.OTHER_KIND}").alias("warning")))
    if render is not None:

        def drawn(batches):
            for batch in batches:
                for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for k, image in enumerate(render(content, options.dpi)):
                        yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "page": pa.array([k], pa.int32()), "image": [encode_png(image)]})

        pdfs = named.filter(kind == "pdf").join(good, "doc_id", "left_semi")
        images = images.unionByName(pdfs.mapInArrow(drawn, "doc_id string, page int, image binary"))
    else:
        told.append(good.select("doc_id", F.lit(UNPAINTED).alias("warning")))
    unread = pages.filter(F.col("text_source") == "none")
    if options.ocr and ocr is not None:
        options.progress("ocr")
        read = fs.ocr_words(fs.recognise(images.join(unread.select(*PAGE), PAGE, "left_semi"), ocr, options.ocr_language))
        words = words.unionByName(read.select(*words.columns))
        seen = read.select(*PAGE, F.lit("ocr").alias("by")).distinct()
        pages = pages.join(seen, PAGE, "left").withColumn("text_source", F.coalesce("by", "text_source")).drop("by")
    elif options.ocr:
        told.append(unread.select("doc_id", F.lit(fs.OCR_MISSING).alias("warning")).distinct())
    context = None
    if options.context_url:
        got = fs.context_table(files, options.context_url)
        context = got.filter("markdown is not null").select("doc_id", "markdown")
        told.append(got.filter("warning is not null").select("doc_id", "warning"))
    return replace(Pages(pages, build_lines(words), words), links=links, images=images, context=context, warnings=reduce(DataFrame.unionByName, told))


def folder_pages(spark: SparkSession, path: str, options: RedactOptions, render: Callable[[bytes, int], list] | None = None, ocr: Callable | None = None) -> Pages:
    """The files under path as pages; pictures other than PNG are decoded by the JVM's readers."""
    from inkveil.sources import files as fs

    return file_pages(fs.read_files(spark, path), options, render, ocr, fs.read_images(spark, path))
