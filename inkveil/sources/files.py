"""Documents from files: sniffing, limits, pictures, PDFs, recognised words, context.

``binaryFile`` reads whole files; columns that only need the first bytes are
computed in the JVM. A file that cannot be read costs its own document, which is
told of, and never the job. Drawing PDFs needs a renderer that is not part of
this library: pass one, a function from (bytes, dpi) to pages.
"""

from __future__ import annotations

import contextlib
import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.errors import ContextUnavailable, MissingDependency, UnsupportedInput
from inkveil.functions import raster
from inkveil.functions.text import trimmed
from inkveil.operators.layout import line_numbers
from inkveil.sources.pdf import Pdf

#: Pixels that a page and a document may have when drawn.
MAX_PAGE_PIXELS, MAX_DOCUMENT_PIXELS = 40_000_000, 200_000_000
POINTS = 72
MIN_OCR_CONFIDENCE = 30

PAGES = "doc_id string, page int, width double, height double, point_width double, point_height double, image binary, text_source string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), content."""
    return spark.read.format("binaryFile").load(path).select(_path(F.col("path")).alias("doc_id"), "content")


def _path(name: Column) -> Column:
    """A path as one of two sources writes it: local ones with one slash."""
    return F.regexp_replace(name, "^file:/+", "file:/")


def sniff(content: Column) -> Column:
    """pdf, image or unsupported, by the first bytes; any RIFF file counts as a WebP picture."""
    start = lambda n: F.hex(F.substring(content, 1, n))
    size = F.octet_length(content)
    picture = ((size > 8) & (start(8) == "89504E470D0A1A0A")) | ((size > 3) & (start(3) == "FFD8FF")) | ((size > 12) & (start(4) == "52494646"))
    return F.when((size > 4) & (start(5) == "255044462D"), "pdf").when(picture, "image").otherwise("unsupported")


OTHER_KIND = "Input is not a PDF, PNG, JPEG or WebP. Office formats must be converted to PDF first, as their text has no fixed place."


def sniff_bytes(data: bytes) -> str:
    """The same test for one file on the driver or in a worker; unsupported input fails."""
    if data[:5] == b"%PDF-":
        return "pdf"
    if (data[:8] == raster.PNG_MAGIC and len(data) > 8) or (data[:3] == b"\xff\xd8\xff" and len(data) > 3) or (data[:4] == b"RIFF" and len(data) > 12):
        return "image"
    raise UnsupportedInput(OTHER_KIND)


def check_limits(pages: DataFrame, dpi: int, max_pages: int = 0) -> DataFrame:
    """Per document with pages (doc_id, page, point_width, point_height): n_pages, megapixels, error (null if within the limits).

    Meant to run before anything is drawn.
    """
    pixels = F.col("point_width") * F.col("point_height") * (dpi / POINTS) ** 2
    sums = pages.withColumn("px", pixels).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("px").alias("total"), F.max("px").alias("most"), F.min(F.when(F.col("px") > MAX_PAGE_PIXELS, F.col("page"))).alias("first_big"))
    mega = lambda c: F.floor(c / 1e6 + 0.5).cast("int")
    error = (
        F.when((F.lit(max_pages) > 0) & (F.col("n_pages") > max_pages), F.format_string("the document has %d pages, and the limit is %d", "n_pages", F.lit(max_pages)))
        .when(F.col("most") > MAX_PAGE_PIXELS, F.format_string("page %d is over the limit of %d megapixels at %d dpi", F.col("first_big") + 1, F.lit(MAX_PAGE_PIXELS // 10**6), F.lit(dpi)))
        .when(F.col("total") > MAX_DOCUMENT_PIXELS, F.format_string("the document has %d megapixels at %d dpi, and the limit is %d", mega(F.col("total")), F.lit(dpi), F.lit(MAX_DOCUMENT_PIXELS // 10**6)))
    )
    return sums.select("doc_id", "n_pages", mega(F.col("total")).alias("megapixels"), error.alias("error"))


#: What goes wrong in a file that is not what it says; anything else is this library's fault and fails.
BROKEN = (UnsupportedInput, ValueError, TypeError, LookupError, ArithmeticError, RecursionError, AttributeError)


def told_failure(kind: str, e: Exception) -> str:
    return f"{UnsupportedInput.code}: this {kind} could not be read ({str(e) or type(e).__name__})"


def pdf_layers(files: DataFrame, dpi: int = 150) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sizes, runs, links, errors) of PDFs, in pixels at dpi from the top left. Columns as words_from_runs and detect_links take them.

    A document with an error has rows in errors (doc_id, error) only.
    """
    scale = dpi / POINTS

    def rows_of(what: str, doc_id: str, content: bytes) -> list[tuple]:
        try:
            pdf = Pdf(content)
            pages = [(pdf.frame(p), pdf.runs(p), pdf.links(p)) for p in pdf.pages]
        except BROKEN as e:
            return [(doc_id, told_failure("PDF", e))] if what == "errors" else []
        if what == "sizes":
            return [(doc_id, k, float(math.ceil(w * scale)), float(math.ceil(h * scale)), w, h) for k, ((w, h, _), _, _) in enumerate(pages)]
        if what == "runs":
            return [(doc_id, k, n, r.text, r.width * scale, r.height * scale, r.left * scale, r.baseline * scale, r.font) for k, (_, runs, _) in enumerate(pages) for n, r in enumerate(runs)]
        if what == "links":
            return [(doc_id, k, n, url, {"x": a * scale, "y": b * scale, "width": (c - a) * scale, "height": (d - b) * scale}) for k, (_, _, links) in enumerate(pages) for n, (url, (a, b, c, d)) in enumerate(links)]
        return []

    def parsed(what: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if rows := rows_of(what, doc_id, content):
                        yield pa.RecordBatch.from_pylist([dict(zip(names[what], r, strict=True)) for r in rows], schema=arrow[what])

        return told

    number, whole, string = pa.float64(), pa.int32(), pa.string()
    box = pa.struct([(c, number) for c in ("x", "y", "width", "height")])
    arrow = {
        "sizes": pa.schema([("doc_id", string), ("page", whole), ("width", number), ("height", number), ("point_width", number), ("point_height", number)]),
        "runs": pa.schema([("doc_id", string), ("page", whole), ("ord", whole), ("text", string), ("width", number), ("font_height", number), ("left", number), ("baseline", number), ("font", string)]),
        "links": pa.schema([("doc_id", string), ("page", whole), ("link_ord", whole), ("url", string), ("box", box)]),
        "errors": pa.schema([("doc_id", string), ("error", string)]),
    }
    names = {k: v.names for k, v in arrow.items()}
    ddl = {
        "sizes": "doc_id string, page int, width double, height double, point_width double, point_height double",
        "runs": "doc_id string, page int, ord int, text string, width double, font_height double, left double, baseline double, font string",
        "links": "doc_id string, page int, link_ord int, url string, box struct<x:double,y:double,width:double,height:double>",
        "errors": "doc_id string, error string",
    }
    slim = files.filter(sniff(F.col("content")) == "pdf").select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    return tuple(slim.mapInArrow(parsed(k), ddl[k]) for k in ("sizes", "runs", "links", "errors"))


def pdf_counts(files: DataFrame) -> DataFrame:
    """doc_id, pages, runs, links of PDFs that can be read: the rows of pdf_layers, counted in one reading."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                with contextlib.suppress(*BROKEN):
                    pdf = Pdf(batch.column(1)[i].as_py())
                    layers = [(pdf.frame(p), pdf.runs(p), pdf.links(p)) for p in pdf.pages]
                    found.append((batch.column(0)[i].as_py(), len(layers), sum(len(runs) for _, runs, _ in layers), sum(len(links) for _, _, links in layers)))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.types[0]), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "pages", "runs", "links"])

    slim = files.filter(sniff(F.col("content")) == "pdf").select("doc_id", "content")
    return slim.mapInArrow(told, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, pages long, runs long, links long")


def _picture(doc_id: str, image: np.ndarray | None, error: str | None) -> pa.RecordBatch:
    h, w = image.shape[:2] if image is not None else (0, 0)
    none = pa.array([None], pa.float64())
    row = {"doc_id": [doc_id], "page": pa.array([0], pa.int32()), "width": [float(w)], "height": [float(h)], "point_width": none, "point_height": none}
    png = pa.array([raster.encode_png(image) if image is not None else None], pa.binary())
    return pa.RecordBatch.from_pydict(row | {"image": png, "text_source": ["none"], "error": pa.array([error], pa.string())})


def image_rows(files: DataFrame, decode: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """Pictures as documents of one page, with error where one cannot be read. decode turns bytes into RGB; the own one reads PNG."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if decode is None and not content.startswith(raster.PNG_MAGIC):
                        raise UnsupportedInput("no decoder for its format was given")
                    image, error = (decode or raster.decode_png)(content), None
                except (*BROKEN, OSError, zlib.error, struct.error) as e:
                    image, error = None, told_failure("picture", e)
                yield _picture(doc_id, image, error)

    slim = files.filter(sniff(F.col("content")) == "image").select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    return slim.mapInArrow(told, f"{PAGES}, error string")


def load_images(files: DataFrame, decode: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """Those pictures that could be read, on white paper."""
    return image_rows(files, decode).filter("error is null").drop("error")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Picture files as documents of one page, decoded by the JVM (PNG, JPEG, GIF, BMP): native size, on white paper."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, height, width, channels, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                if channels == 1:
                    px = np.repeat(px, 3, axis=2)
                elif channels == 4:
                    alpha = px[..., 3:].astype(np.uint16)
                    px = ((px[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)
                yield _picture(origin, np.ascontiguousarray(px[..., ::-1]), None)  # stored blue first

    read = spark.read.format("image").option("dropInvalid", True).load(path)
    rows = read.select(_path(F.col("image.origin")).alias("origin"), "image.height", "image.width", "image.nChannels", "image.data")
    return rows.mapInArrow(told, f"{PAGES}, error string").drop("error")


#: Fields of recognised words.
OCR_WORD = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
OCR_TREE = f"array<struct<paragraphs:array<struct<lines:array<struct<words:array<{OCR_WORD}>>>>>>>"


def flatten_ocr(blocks: Column) -> Column:
    """The words of blocks of paragraphs of lines."""
    inner = lambda a, f: F.flatten(F.transform(F.coalesce(a, F.array()), f))
    return inner(blocks, lambda b: inner(b["paragraphs"], lambda p: inner(p["lines"], lambda n: F.coalesce(n["words"], F.array()))))


def ocr_words(recognised: DataFrame) -> DataFrame:
    """Words of recognised pages (doc_id, page, words): those with text and enough confidence, with ids and lines."""
    rows = recognised.select("doc_id", "page", F.filter("words", lambda w: (trimmed(F.coalesce(w["text"], F.lit(""))) != "") & (w["confidence"] > MIN_OCR_CONFIDENCE)).alias("w"))
    rows = rows.select("doc_id", "page", F.posexplode("w").alias("ord", "w"))
    b = F.col("w.bbox")
    box = F.struct(b["x0"].alias("x"), b["y0"].alias("y"), (b["x1"] - b["x0"]).alias("width"), (b["y1"] - b["y0"]).alias("height"))
    lined = line_numbers(rows.select("doc_id", "page", "ord", trimmed(F.col("w.text")).alias("text"), box.alias("box")))
    return lined.withColumn("word_id", F.concat(F.lit("p"), "page", F.lit("o"), "ord"))


class OcrEngine:
    """One engine a worker process, made anew when the language changes."""

    _engine, _language = None, None

    @classmethod
    def get(cls, language: str, make: Callable[[str], object] | None = None):
        if cls._engine is None or cls._language != language:
            cls.dispose()
            if make is None:
                raise MissingDependency("an OCR engine", "read pages that have no text layer")
            cls._engine, cls._language = make(language), language
        return cls._engine

    @classmethod
    def dispose(cls) -> None:
        engine, cls._engine, cls._language = cls._engine, None, None
        if hasattr(engine, "close"):
            engine.close()


OCR_MISSING = "an OCR engine is needed to read pages that have no text layer; vision is left for them"


def recognise(images: DataFrame, make: Callable[[str], Callable[[bytes], list[dict]]], language: str = "eng") -> DataFrame:
    """doc_id, page, words of pictures. make(language) gives an engine: PNG bytes to dicts of text, confidence and bbox (x0, y0, x1, y1)."""
    corner = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
    kind = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("bbox", corner)]))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            engine = OcrEngine.get(language, make)
            for i in range(batch.num_rows):  # one picture at a time
                words = engine(batch.column(2)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([words], kind)], names=["doc_id", "page", "words"])

    slim = images.select("doc_id", "page", "image")
    return slim.mapInArrow(told, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, page int, words array<{OCR_WORD}>")


def fetch_context(base_url: str, data: bytes, timeout: float = 30.0) -> str:
    """A document as markdown from a parsing service: PUT <base>/tika. Telling what to look for, it never gives places."""
    from urllib.error import HTTPError, URLError
    from urllib.parse import urljoin
    from urllib.request import Request, urlopen

    request = Request(urljoin(base_url, "/tika"), data=data, method="PUT", headers={"Content-Type": "application/octet-stream", "Accept": "text/plain"})
    try:
        with urlopen(request, timeout=timeout) as reply:
            return reply.read().decode("utf-8", "replace")
    except HTTPError as e:
        raise ContextUnavailable(f"the service answered {e.code}: {e.read()[:300]!r}", "CONTEXT_NO_TEXT" if e.code == 422 else None) from e
    except URLError as e:
        raise ContextUnavailable(str(e.reason)) from e


def context_table(files: DataFrame, base_url: str) -> DataFrame:
    """doc_id, markdown (null if blank or not to be had), warning. A failure costs the context, not the document."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, warnings = [], []
            for data in batch.column(1).to_pylist():
                try:
                    text, warning = fetch_context(base_url, data).strip() or None, None
                except ContextUnavailable as e:
                    text, warning = None, f"document context unavailable ({e}); detection continued without it"
                texts.append(text)
                warnings.append(warning)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(warnings, pa.string())], names=["doc_id", "markdown", "warning"])

    slim = files.select("doc_id", "content")
    return slim.mapInArrow(told, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, markdown string, warning string")
