"""A deterministic fixed-pitch layout for plain text and for HTML.

Every word gets a box without a renderer: a line's words stand 6 pixels a
character apart from their place in the line, lines 14 pixels apart, 60 lines
to a page. Blank lines keep their place on the page but get no number. All of
it is narrow: a document's rows never leave their partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.geometry import box, union_all
from inkveil.functions.text import held, leading, let, running, single_spaced

PITCH, LEADING, HEIGHT = 6, 14, 12
PAGE_LINES = 60
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 840.0


def word_count(line: Column) -> Column:
    """Words of a single-spaced line."""
    return F.when(line == "", 0).otherwise(F.size(F.split(line, " ")))


def _pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, page, slots: the single-spaced lines of each page. A document without text, null or empty, has one blank page."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("all"))
    starts = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / PAGE_LINES).cast("int"))
    cut = F.transform(starts, lambda p: F.slice("all", p * PAGE_LINES + 1, PAGE_LINES))  # before the explode, which would copy the document for each page
    pages = docs.select("doc_id", F.posexplode(cut).alias("page", "raw"))
    return pages.select("doc_id", "page", F.transform("raw", single_spaced).alias("slots"))


def text_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbered lines: doc_id, page, slot (place on the page), line_no (from 1, blank lines skipped), text, first (index of its first word on the page).

    Documents without text have no lines.
    """
    slots = F.transform("slots", lambda x, i: F.struct(i.alias("slot"), x.alias("text")))
    pages = held(_pages(df, id_col, text_col), lines=F.filter(slots, lambda s: s["text"] != "")).select("doc_id", "page", "lines")
    firsts = running(F.transform("lines", lambda s: word_count(s["text"])))
    rows = held(pages, lines=F.arrays_zip(F.col("lines.slot").alias("slot"), F.col("lines.text").alias("text"), firsts.alias("first")))
    return rows.select("doc_id", "page", F.posexplode("lines").alias("i", "s")).select("doc_id", "page", F.col("s.slot").alias("slot"), (F.col("i") + 1).alias("line_no"), F.col("s.text").alias("text"), F.col("s.first").alias("first"))


def mono_box(slot: Column, start: Column, length: Column) -> Column:
    return box(PITCH * start, LEADING * slot, PITCH * length, F.lit(HEIGHT))


def mono_starts(parts: Column) -> Column:
    """The place where each word of a single-spaced line begins."""
    return running(F.transform(parts, lambda w: F.length(w) + 1))


def mono_line(text: Column, then: Callable[[Column, Column], Column]) -> Column:
    """then(words, starts) of a fixed-pitch line."""
    return let(F.split(text, " "), lambda parts: let(mono_starts(parts), lambda starts: then(parts, starts)))


def mono_span(page: Column, slot: Column, first: Column, parts: Column, starts: Column, start: Column, end: Column) -> Column:
    """The words of a line that [start, end) touches: array of (word_id, text, box). Two binary searches find them."""

    def word(w: Column, k: Column) -> Column:
        return F.struct(F.concat(F.lit("p"), page, F.lit("w"), first + k).alias("word_id"), w.alias("text"), mono_box(slot, F.get(starts, k), F.length(w)).alias("box"))

    n = F.size(parts)
    before = leading(n, lambda k: F.get(starts, k) + F.length(F.get(parts, k)) <= start)
    upto = leading(n, lambda k: F.get(starts, k) < end)
    return let(F.struct(before.alias("a"), upto.alias("b")), lambda s: F.transform(F.slice(parts, s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0))), lambda w, i: word(w, s["a"] + i)))


def mono_words(page: Column, slot: Column, first: Column, text: Column, start: Column, end: Column) -> Column:
    """The words of a fixed-pitch line that [start, end) touches."""
    return mono_line(text, lambda parts, starts: mono_span(page, slot, first, parts, starts, start, end))


def line_words(page: Column, slot: Column, first: Column, text: Column) -> Column:
    """All words of a fixed-pitch line."""

    def every(parts: Column, starts: Column) -> Column:
        return F.transform(parts, lambda w, k: F.struct(F.concat(F.lit("p"), page, F.lit("w"), first + k).alias("word_id"), w.alias("text"), mono_box(slot, F.get(starts, k), F.length(w)).alias("box")))

    return mono_line(text, every)


def text_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: doc_id, page, word_id, ord, text, box, line. ord is the order of the text."""
    lines = text_lines(df, id_col, text_col)
    whole = line_words(F.col("page"), F.col("slot"), F.col("first"), F.col("text"))
    rows = lines.select("doc_id", "page", "slot", "first", F.posexplode(whole).alias("i", "w"))
    return rows.select("doc_id", "page", F.col("w.word_id").alias("word_id"), (F.col("first") + F.col("i")).alias("ord"), F.col("w.text").alias("text"), F.col("w.box").alias("box"), F.col("slot").alias("line"))


def page_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, page, width, height, has_text of fixed-pitch pages, blank ones too; wide lines widen their page."""
    pages = _pages(df, id_col, text_col).select("doc_id", "page", F.array_max(F.transform("slots", lambda x: F.length(x))).alias("longest"))
    return pages.select("doc_id", "page", F.greatest(F.lit(PAGE_WIDTH), F.col("longest") * PITCH).cast("double").alias("width"), F.lit(PAGE_HEIGHT).alias("height"), (F.col("longest") > 0).alias("has_text"))


#: Characters of a row of a wrapped page.
WRAP = 200


def wrapped_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, page, width, height, tops of pages whose lines are wrapped after WRAP characters. tops has the row where each slot begins."""
    sizes = _pages(df, id_col, text_col).select("doc_id", "page", F.transform("slots", lambda x: F.length(x)).alias("sizes"))
    state = F.struct(F.lit(0).alias("rows"), F.array().cast("array<int>").alias("tops"))
    step = lambda s, n: F.struct((s["rows"] + F.greatest(F.lit(1), F.ceil(n / WRAP).cast("int"))).alias("rows"), F.concat(s["tops"], F.array(s["rows"])).alias("tops"))
    placed = sizes.select("doc_id", "page", F.least(F.array_max("sizes"), F.lit(WRAP)).alias("longest"), F.aggregate("sizes", state, step).alias("s"))
    return placed.select(
        "doc_id", "page", F.greatest(F.lit(PAGE_WIDTH), F.col("longest") * PITCH).cast("double").alias("width"),
        F.greatest(F.lit(PAGE_HEIGHT), F.col("s.rows") * LEADING).cast("double").alias("height"), F.col("s.tops").alias("tops"),
    )


def wrapped_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """wrapped_sizes with rows: the text of the page's rows from the top, blank ones too. A line's rows stand where its slot's top says."""
    pages = held(_pages(df, id_col, text_col), slots=F.col("slots"))
    wrap = lambda x: F.when(F.length(x) <= WRAP, F.array(x)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / WRAP).cast("int")), lambda k: F.substring(x, k * WRAP + 1, F.lit(WRAP))))
    rows = held(pages, rows=F.flatten(F.transform("slots", wrap))).select("doc_id", "page", "rows")
    return rows.select(
        "doc_id", "page", F.greatest(F.lit(PAGE_WIDTH), F.array_max(F.transform("rows", lambda x: F.length(x))) * PITCH).cast("double").alias("width"),
        F.greatest(F.lit(PAGE_HEIGHT), F.size("rows") * LEADING).cast("double").alias("height"), "rows",
    )


def wrapped_boxes(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """regions of single lines moved to the wrapped page; one that runs over a row's end becomes a box on each row. Keeps the page's width and height beside them."""
    met = regions.join(sizes.select("doc_id", "page", "width", "height", "tops"), ["doc_id", "page"])
    row, x, right = WRAP * PITCH, F.col("box.x"), F.col("box.x") + F.col("box.width")
    parts = F.sequence(F.floor(x / row), F.ceil(right / row) - 1)
    met = met.withColumn("top", F.get("tops", F.floor(F.col("box.y") / LEADING).cast("int"))).withColumn("k", F.explode(parts))
    left = F.greatest(x - F.col("k") * row, F.lit(0.0))
    place = box(left, (F.col("top") + F.col("k")) * LEADING, F.least(right - F.col("k") * row, F.lit(float(row))) - left, F.col("box.height"))
    return met.withColumn("box", place).select(*regions.columns, "width", "height")


#: An anchor with its target, and any other tag.
ANCHOR = r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'


def html_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(words, links) of HTML anchors: each anchor is a line of its own, its words laid out there and its box around them.

    Relative targets are resolved against the page's own address.
    """
    html = pages.select(F.col(id_col).alias("doc_id"), F.col(url_col).alias("base"), F.regexp_extract_all(html_col, F.lit(ANCHOR), 1).alias("hrefs"), F.regexp_extract_all(html_col, F.lit(ANCHOR), 2).alias("texts"))
    rows = html.select("doc_id", "base", F.posexplode(F.arrays_zip("hrefs", "texts")).alias("n", "a"))
    shown = single_spaced(F.regexp_replace(F.col("a.texts"), "(?s)<[^>]*>", ""))
    origin = F.regexp_extract("base", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    folder = F.when(F.regexp_replace("base", "[?#].*$", "").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/"), F.regexp_replace(F.regexp_replace("base", "[?#].*$", ""), "[^/]*$", "")).otherwise(F.concat(origin, F.lit("/")))
    href = F.col("a.hrefs")
    url = F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, href))
    base = rows.select("doc_id", (F.floor(F.col("n") / PAGE_LINES)).cast("int").alias("page"), (F.col("n") % PAGE_LINES).alias("slot"), F.col("n").alias("link_ord"), url.alias("url"), shown.alias("text"))
    spelt = line_words(F.col("page"), F.col("slot"), F.col("slot") * 1000, F.col("text"))
    named = base.withColumn("words", F.when(F.col("text") != "", spelt).otherwise(F.array().cast(f"array<struct<word_id:string,text:string,box:struct<x:double,y:double,width:double,height:double>>>")))
    own = F.coalesce(union_all(F.transform("words", lambda w: w["box"])), mono_box(F.col("slot"), F.lit(0), F.lit(1)))
    links = named.select("doc_id", "page", "link_ord", "url", own.alias("box"))
    words = named.select("doc_id", "page", "slot", F.posexplode("words").alias("i", "w")).select(
        "doc_id", "page", F.col("w.word_id").alias("word_id"), (F.col("slot") * 1000 + F.col("i")).alias("ord"), F.col("w.text").alias("text"), F.col("w.box").alias("box"), F.col("slot").alias("line")
    )
    return words, links
