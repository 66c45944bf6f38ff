"""Detection by a model that reads: requests out, quotes back to places.

Requests and replies are two tables. The model stands between them and may be
slow and unsteady, so replies are written before anything reads them, and can be
played again from a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.geometry import union_all
from inkveil.functions.text import clamp_confidence, defuse, let, literal_places, trimmed
from inkveil.operators import prompts
from inkveil.operators.layout import PAGE, words_in_range
from inkveil.sources.text_layout import mono_words
from inkveil.targets import Target

#: Characters of transcript in one request, and what a line costs beside its text.
CHUNK, LINE_COST = 12_000, 8


def chunk_lines(lines: DataFrame) -> DataFrame:
    """Adds ``chunk``: lines fill a chunk until the next would pass CHUNK; a longer line stands alone.

    The sum starts anew with each chunk, so it is a fold over the page's lines.
    """
    packed = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_no", F.struct(*[c for c in lines.columns if c not in PAGE]).alias("row")))).alias("all"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("chunks"))

    def step(s: Column, e: Column) -> Column:
        cost = F.length(e["row"]["text"]) + LINE_COST
        new = (s["size"] > 0) & (s["size"] + cost > CHUNK)
        chunk = s["chunk"] + new.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(new, cost).otherwise(s["size"] + cost).alias("size"), F.concat(s["chunks"], F.array(chunk)).alias("chunks"))

    folded = packed.select(*PAGE, "all", F.aggregate("all", start, step, lambda s: s["chunks"]).alias("chunks"))
    rows = folded.select(*PAGE, F.explode(F.arrays_zip("all", "chunks")).alias("z"))
    return rows.select(*PAGE, "z.all.row.*", F.col("z.chunks").alias("chunk"))


def text_requests(lines: DataFrame, targets: list[Target], link_sections: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """doc_id, page, chunk, call (ordinal within the document), prompt. All text from the document is defused."""
    wanted = [t for t in targets if not t.visual_only]
    if not wanted:
        lines = lines.filter(F.lit(False))
    before, after = prompts.text_prompt_parts(wanted)
    row = F.struct("line_no", F.concat("line_no", F.lit("| "), defuse(F.col("text"))).alias("row"))
    chunks = chunk_lines(lines.select(*PAGE, "line_no", "text"))
    asked = chunks.groupBy(*PAGE, "chunk").agg(F.array_sort(F.collect_list(row)).alias("r"))
    prompt = F.concat(F.lit(before), F.array_join(F.transform("r", lambda x: x["row"]), "\n"), F.lit(after))
    if link_sections is not None:
        asked = asked.join(link_sections, PAGE, "left")
        prompt = F.concat(prompt, F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(prompts.LINK_HEADING), defuse(F.col("section")))).otherwise(""))
    if context is not None:
        asked = asked.join(context.select("doc_id", F.col("markdown").alias("context")), "doc_id", "left")
        prompt = F.concat(prompt, F.when(trimmed(F.coalesce("context", F.lit(""))) != "", F.concat(F.lit(prompts.CONTEXT_HEADING), defuse(F.col("context")))).otherwise(""))
    # Calls are numbered by their keys alone, so that no prompt travels to a window.
    call = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "chunk")) - 1
    calls = chunks.select(*PAGE, "chunk").distinct().withColumn("call", call)
    return asked.select(*PAGE, "chunk", prompt.alias("prompt")).join(calls, [*PAGE, "chunk"]).select(*PAGE, "chunk", "call", "prompt")


def quotes(replies: DataFrame) -> DataFrame:
    """Items of the replies (doc_id, page, chunk, reply as JSON): item, line, quote, target, confidence. Blank quotes go."""
    items = replies.select(*PAGE, "chunk", F.posexplode(F.from_json("reply", prompts.TEXT_REPLY)["redactions"]).alias("item", "q"))
    target = F.coalesce(F.when(F.col("q.target") != "", F.col("q.target")), F.lit("unknown"))
    quote = trimmed(F.coalesce("q.quote", F.lit("")))
    return items.select(*PAGE, "chunk", "item", F.col("q.line").alias("line_no"), quote.alias("quote"), target.alias("target"), clamp_confidence(F.col("q.confidence")).alias("confidence")).filter(F.col("quote") != "")


def locate(lines: DataFrame, found: DataFrame) -> DataFrame:
    """found with ``hits``: (line_no, start) of all places on the named line, or if it has none, on any line of the page.

    Quotes and lines meet on the page; what is kept for a quote is its places.
    """
    each = found.select(*PAGE, "chunk", "item", F.col("line_no").alias("named"), "quote").withColumnRenamed("page", "p").withColumnRenamed("doc_id", "d")
    met = each.join(lines.select(*PAGE, "line_no", "text"), (F.col("d") == F.col("doc_id")) & (F.col("p") == F.col("page")))
    spots = met.select(F.col("d").alias("doc_id"), F.col("p").alias("page"), "chunk", "item", "line_no", (F.col("line_no") == F.col("named")).alias("on_named"), F.explode(literal_places(F.col("text"), F.col("quote"))).alias("start"))
    spot = F.struct("line_no", "start")
    hits = spots.groupBy(*PAGE, "chunk", "item").agg(F.collect_list(F.when(F.col("on_named"), spot)).alias("near"), F.collect_list(spot).alias("far"))
    hits = hits.select(*PAGE, "chunk", "item", F.array_sort(F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("far"))).alias("hits"))
    none = F.array().cast("array<struct<line_no:int,start:int>>")
    return found.join(hits, [*PAGE, "chunk", "item"], "left").withColumn("hits", F.coalesce("hits", none))


def detect_text(lines: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detections, warnings) of quotes: a quote that is nowhere on its page is told and drops out."""
    placed = locate(lines, found)
    lost = placed.filter(F.size("hits") == 0)
    warnings = lost.select(
        *PAGE,
        F.format_string('page %d: could not locate quote "%s" for target "%s"; nothing was redacted for it', F.col("page") + 1, "quote", "target").alias("warning"),
    )
    each = placed.select(*PAGE, "chunk", "item", "quote", "target", "confidence", F.explode("hits").alias("h"))
    each = each.select("*", F.col("h.line_no").alias("line_no"), F.col("h.start").alias("begin")).drop("h")
    met = each.join(lines, [*PAGE, "line_no"])
    end = F.col("begin") + F.length("quote")
    words = words_in_range(F.col("words"), F.col("begin"), end) if "words" in lines.columns else mono_words(F.col("page"), F.col("slot"), F.col("first"), F.col("text"), F.col("begin"), end)
    met = met.withColumn("w", words).filter(F.size("w") > 0)
    detections = met.select(
        *PAGE, "target", union_all(F.transform("w", lambda x: x["box"])).alias("box"), F.col("quote").alias("text"), "confidence", F.lit("llm-text").alias("source"),
        F.transform("w", lambda x: x["word_id"]).alias("word_ids"), F.array(F.lit(2), F.col("chunk"), F.col("item"), F.col("line_no"), F.col("begin")).alias("seq"),
    )
    return detections, warnings
