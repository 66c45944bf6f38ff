"""From positioned words to readable lines, and from places in a line back to words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.geometry import bottom, union_agg
from inkveil.functions.text import BLANK, leading, let, running, trimmed

PAGE = ["doc_id", "page"]

# Parts of a run's font height above the baseline, in all, and as the mean width of a character.
ASCENT, EXTENT, MEAN_ADVANCE = 0.88, 1.16, 0.5

# Advance widths, in thousandths, of the signs from space to ~ in the standard faces Helvetica and Times.
SANS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
SERIF = (
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
)
#: Thousandths of a fixed-pitch sign, and of a sign that a face's table lacks.
FIXED, OTHER = 600, 556


def line_numbers(boxes: DataFrame, keys: list[str] = PAGE, order: str = "ord") -> DataFrame:
    """Adds ``line``: boxes by (y, x) start a new line when their centre is below the band of the current one.

    The band reaches down to the lowest bottom of the line's boxes so far. A line
    begins with a box whose centre, and so its bottom, is below all bottoms before
    it; the lowest bottom of a line is therefore that of all boxes so far, a
    running maximum, and the number of a line is a running count of beginnings.
    No box can be above the band, as tops only grow. One shuffle and sort, by
    page, and nothing is held but the rows of a window.
    """
    by = W.partitionBy(*keys).orderBy(F.col("box.y"), F.col("box.x"), F.col(order))
    low = F.max(bottom(F.col("box"))).over(by.rowsBetween(W.unboundedPreceding, -1))
    centre = F.col("box.y") + F.col("box.height") / 2
    begins = F.when(low.isNull() | (centre > low), 1).otherwise(0)
    keep = [c for c in boxes.columns if c not in keys]
    marked = boxes.withColumn("_begins", begins)
    line = F.sum("_begins").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    return marked.select(*keys, *keep, line.cast("int").alias("line"))


def reading_order(words: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of a word on its page, by line, then x, then the order it came in."""
    return words.withColumn("rank", F.row_number().over(W.partitionBy(*PAGE).orderBy("line", F.col("box.x"), "ord")) - 1)


def build_lines(words: DataFrame) -> DataFrame:
    """Lines of a page: line_no (from 1, blank lines skipped), text, words with start and end. One shuffle, by page."""
    item = F.struct(F.col("box.x").alias("x"), "ord", "text", "box", "word_id")
    lines = words.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(item)).alias("w"))
    lines = lines.withColumn("text", F.array_join(F.transform("w", lambda x: x["text"]), " ")).filter(trimmed(F.col("text")) != "")
    lines = lines.withColumn("starts", running(F.transform("w", lambda x: F.length(x["text"]) + 1)))
    spelt = F.transform(
        "w",
        lambda x, i: F.struct(x["word_id"].alias("word_id"), x["text"].alias("text"), x["box"].alias("box"), F.get("starts", i).alias("start"), (F.get("starts", i) + F.length(x["text"])).alias("end")),
    )
    number = F.row_number().over(W.partitionBy(*PAGE).orderBy("line"))
    return lines.select(*PAGE, "line", number.alias("line_no"), "text", spelt.alias("words"))


def words_in_range(words: Column, start: Column, end: Column) -> Column:
    """Words whose span overlaps [start, end): array of (word_id, text, box). Words stand in order, so two binary searches find them."""
    before = leading(F.size(words), lambda k: F.get(words, k)["end"] <= start)
    upto = leading(F.size(words), lambda k: F.get(words, k)["start"] < end)
    hit = let(F.struct(before.alias("a"), upto.alias("b")), lambda s: F.slice(words, s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0))))
    return F.transform(hit, lambda w: F.struct(w["word_id"].alias("word_id"), w["text"].alias("text"), w["box"].alias("box")))


def union_boxes(words: DataFrame, by: list[str]) -> DataFrame:
    return words.groupBy(*by).agg(union_agg(F.col("box")).alias("box"))


def proxy_family(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.rlike("mono|courier|consol"), "monospace").when(low.rlike("times|serif|georgia|garamond|book|minion|cambria"), "serif").otherwise("sans-serif")


def relative_advance(char: Column, family: Column) -> Column:
    """Thousandths of the font's size that a sign takes in its face; letters with accents take what the bare ones do."""
    bare = F.translate(char, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy")
    at = F.ascii(bare) - 32
    width = lambda table: F.coalesce(F.get(F.array(*map(F.lit, table)), at), F.lit(OTHER))
    return F.when(family == "monospace", FIXED).when(family == "serif", width(SERIF)).otherwise(width(SANS)).cast("double")


def text_advance(text: Column, family: Column) -> Column:
    """The width of a text in thousandths of the font's size."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, lambda c: relative_advance(c, family)), F.lit(0.0), lambda a, x: a + x)


def words_from_runs(runs: DataFrame, dpi_scale: Column | float = 1.0) -> DataFrame:
    """Words of positioned text runs: doc_id, page, ord, text, box.

    runs: doc_id, page, ord, text, width (of the run; 0 if unknown), font_height,
    left, baseline, font. A run's width is shared out by the characters'
    relative advances; blank pieces move on but are no words. Runs that are
    blank or have no height are skipped.
    """
    runs = runs.filter((trimmed(F.coalesce("text", F.lit(""))) != "") & (F.col("font_height") > 0))
    known = F.coalesce(F.col("width"), F.lit(0.0))
    total = F.when((known > 0) & ~F.isnan(known), known).otherwise(F.col("font_height") * F.length("text") * MEAN_ADVANCE)
    runs = runs.withColumn("family", proxy_family(F.col("font"))).withColumn("total", total * dpi_scale)
    keep = [*PAGE, "ord", "left", "baseline", "font_height", "total", "family"]
    pieces = runs.select(*keep, F.posexplode(F.regexp_extract_all("text", F.lit(f"[{BLANK}]+|[^{BLANK}]+"), 0)).alias("piece", "word"))
    own = text_advance(F.col("word"), F.col("family"))
    run = W.partitionBy(*PAGE, "ord")
    # Widths before a piece are a running sum over its run, and the run's total sets the scale.
    before = F.coalesce(F.sum("own").over(run.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    pieces = pieces.withColumn("own", own).withColumn("before", before).withColumn("scale", F.col("total") / F.sum("own").over(run))
    pieces = pieces.filter(trimmed(F.col("word")) != "")
    out = pieces.withColumn(
        "box",
        F.struct(
            (F.col("left") + F.col("before") * F.col("scale")).alias("x"), (F.col("baseline") - ASCENT * F.col("font_height")).alias("y"),
            (F.col("own") * F.col("scale")).alias("width"), (EXTENT * F.col("font_height")).alias("height"),
        ),
    )
    order = F.row_number().over(W.partitionBy(*PAGE).orderBy("ord", "piece")) - 1
    return out.select(*PAGE, order.alias("ord"), F.col("word").alias("text"), "box")


def page_words(runs: DataFrame) -> DataFrame:
    """Runs to words with ids and lines, as a text layer gives them."""
    words = line_numbers(words_from_runs(runs))
    return words.withColumn("word_id", F.concat(F.lit("p"), "page", F.lit("w"), "ord"))
