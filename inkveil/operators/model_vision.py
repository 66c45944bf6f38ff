"""Detection by a model that sees: a grid to point with, and back to words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.geometry import bottom, clipped, overlap_ratio, union_all
from inkveil.functions.grid import parse_cell, range_box
from inkveil.functions.text import clamp_confidence, held
from inkveil.operators import prompts
from inkveil.operators.layout import PAGE
from inkveil.options import GridOptions
from inkveil.sources.text_layout import HEIGHT, LEADING, line_words
from inkveil.targets import Target


def label_of(index: int) -> str:
    """Letters of a column on the driver: base 26 without a zero."""
    letters = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def vision_requests(pages: DataFrame, targets: list[Target], grid: GridOptions = GridOptions()) -> DataFrame:
    """One request per page: doc_id, page, call, prompt. The picture is the page's grid overlay."""
    prompt = prompts.vision_prompt(targets, grid.cols, grid.rows, label_of(grid.cols - 1))
    return pages.select(*PAGE, (F.row_number().over(W.partitionBy("doc_id").orderBy("page")) - 1).alias("call"), F.lit(prompt).alias("prompt"))


def regions(replies: DataFrame, sizes: DataFrame, grid: GridOptions = GridOptions()) -> DataFrame:
    """Items of the replies: item, target, confidence, the references, and region (null if one is unreadable or off the grid)."""
    items = replies.select(*PAGE, F.posexplode(F.from_json("reply", prompts.VISION_REPLY)["redactions"]).alias("item", "q"))
    items = items.select(*PAGE, "item", F.coalesce("q.from", F.lit("")).alias("a"), F.coalesce("q.to", F.lit("")).alias("b"), F.coalesce(F.when(F.col("q.target") != "", F.col("q.target")), F.lit("unknown")).alias("target"), clamp_confidence(F.col("q.confidence")).alias("confidence"))
    items = items.withColumn("ca", parse_cell(F.col("a"))).withColumn("cb", parse_cell(F.col("b"))).join(sizes.select(*PAGE, "width", "height"), PAGE)
    region = range_box(F.col("ca"), F.col("cb"), grid.cols, grid.rows, F.col("width"), F.col("height"))
    on = F.col("ca").isNotNull() & F.col("cb").isNotNull() & (region["width"] > 0) & (region["height"] > 0)
    return items.withColumn("region", F.when(on, region))


def _snap_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """The same for fixed-pitch lines: only lines that a region touches are taken apart, and no word travels."""
    own = lines.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "slot", "first", F.col("text").alias("said"))
    top = F.col("slot") * LEADING
    touched = (top < bottom(found["region"])) & (top + HEIGHT > found["region"]["y"])
    met = found.join(own, (found["doc_id"] == own["d"]) & (found["page"] == own["p"]) & touched)
    words = line_words(F.col("page"), F.col("slot"), F.col("first"), F.col("said"))
    met = held(met, w=F.filter(words, lambda w: overlap_ratio(w["box"], F.col("region")) > 0.5)).filter(F.size("w") > 0)
    pick = lambda name: F.transform("w", lambda x: x[name])
    return met.select(*PAGE, "item", "target", "confidence", F.col("slot").alias("line"), union_all(pick("box")).alias("box"), F.array_join(pick("text"), " ").alias("text"), pick("word_id").alias("word_ids"))


def snap(found: DataFrame, words: DataFrame) -> DataFrame:
    """Words of which more than half is in a region, one row per region and line: box, text, word_ids. words may be fixed-pitch lines."""
    if "slot" in words.columns:
        return _snap_lines(found, words)
    w = words.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "word_id", "ord", F.col("text").alias("word"), F.col("box").alias("word_box"), "line")
    met = found.join(w, (found["doc_id"] == w["d"]) & (found["page"] == w["p"]) & (overlap_ratio(w["word_box"], found["region"]) > 0.5))
    item = F.struct(F.col("word_box.x").alias("x"), "ord", "word_id", "word", F.col("word_box").alias("box"))
    by = met.groupBy(*PAGE, "item", "target", "confidence", "line").agg(F.array_sort(F.collect_list(item)).alias("w"))
    pick = lambda name: F.transform("w", lambda x: x[name])
    return by.select(*PAGE, "item", "target", "confidence", "line", union_all(pick("box")).alias("box"), F.array_join(pick("word"), " ").alias("text"), pick("word_id").alias("word_ids"))


def detect_vision(found: DataFrame, words: DataFrame, targets: list[Target], grid: GridOptions = GridOptions(), snap_visual: bool = False) -> tuple[DataFrame, DataFrame]:
    """(detections, warnings). Regions shrink to the words in them, those of visual targets only if snap_visual says so."""
    off = F.col("region").isNull()
    parsed = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    told = F.when(parsed, "grid reference off the page").otherwise("unreadable grid reference")
    warnings = found.filter(off).select(*PAGE, F.format_string('page %d: %s "%s":"%s" for target "%s"; nothing was redacted for it', F.col("page") + 1, told, "a", "b", "target").alias("warning"))
    usable = found.filter(~off)
    visual = [t.id for t in targets if t.visual_only]
    may: Column = F.lit(grid.snap_to_words) & (F.lit(snap_visual) | ~F.col("target").isin(*visual) if visual else F.lit(True))
    snapped = snap(usable.filter(may), words)
    whole = usable.join(snapped.select(*PAGE, "item").distinct(), [*PAGE, "item"], "left_anti")
    seq = lambda line: F.array(F.lit(3), F.col("item"), line)
    a = snapped.select(*PAGE, "target", "box", "text", "confidence", F.lit("llm-vision").alias("source"), "word_ids", seq(F.col("line")).alias("seq"))
    cell = clipped(F.col("region"), F.col("width"), F.col("height"))
    b = whole.select(*PAGE, "target", cell.alias("box"), F.lit(None).cast("string").alias("text"), "confidence", F.lit("llm-vision").alias("source"), F.array().cast("array<string>").alias("word_ids"), seq(F.lit(0)).alias("seq"))
    return a.unionByName(b), warnings
