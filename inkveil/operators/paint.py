"""Sinks: pages are painted and rebuilt from pixels, a page or a document at a time in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions import raster
from inkveil.operators.model_vision import label_of
from inkveil.options import GridOptions

POINTS_PER_INCH = 72
#: Bytes of pictures that go back to the engine at once.
PORTION = 4 << 20
STYLE_WARNING = (
    'style "{}" destroys detail by downsampling before it smooths, so the characters cannot be read back. '
    'The shape of what was covered still shows: how many words, how long, and where lines broke. Use "box" when none of that may be told.'
)


def blank_pages(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fixed-pitch pages drawn with one dark bar per word: doc_id, page, width, height, image. Pages without lines stay white. A stand-in for a renderer."""
    row = F.struct("slot", "text")
    by = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    drawn = sizes.select("doc_id", "page", "width", "height").join(by, ["doc_id", "page"], "left")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = zip(*(batch.column(c).to_pylist() for c in ("rows", "width", "height")), strict=True)
            yield from _with_images(batch, (raster.encode_png(_bars([(r["slot"], r["text"]) for r in rows or ()], int(width), int(height))) for rows, width, height in pages))

    return drawn.mapInArrow(told, _image_schema(drawn))


def blank_slots(pages: DataFrame) -> DataFrame:
    """As blank_pages, of rows that hold their page's text: doc_id, page, width, height, rows (its lines from the top, blank ones too). No shuffle."""
    slim = pages.select("doc_id", "page", "width", "height", "rows")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = zip(*(batch.column(c).to_pylist() for c in ("rows", "width", "height")), strict=True)
            yield from _with_images(batch, (raster.encode_png(_bars([(n, r) for n, r in enumerate(rows) if r], int(width), int(height))) for rows, width, height in drawn))

    return slim.mapInArrow(told, _image_schema(slim))


def _image_schema(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}, page int, width double, height double, image binary"


def _with_images(batch: pa.RecordBatch, images: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """doc_id, page, width, height of a batch with its pictures, some megabytes at a time."""
    for start, some in _portions(images, len):
        part = batch.slice(start, len(some))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "page", "width", "height")), pa.array(some, pa.binary())], names=["doc_id", "page", "width", "height", "image"])


def _portions(items: Iterable, size: Callable[[Any], int]) -> Iterator[tuple[int, list]]:
    """(start, items) of runs of items with PORTION bytes or a little more."""
    start, some, held = 0, [], 0
    for item in items:
        some.append(item)
        held += size(item)
        if held >= PORTION:
            yield start, some
            start, some, held = start + len(some), [], 0
    if some:
        yield start, some


def _bars(rows: list[tuple[int, str]], width: int, height: int) -> raster.Rows:
    """Greys of a fixed-pitch page: (place, text) of its rows as one dark bar a word, on white, the first of the rows."""
    wide = -(-width // 6)
    place = np.zeros(max(height, max((14 * slot + 14 for slot, _ in rows), default=0)), int)
    lines = np.full((len(rows) + 1, width), 255, np.uint8)
    if rows and wide:
        signs = np.frombuffer("".join(text[:wide].ljust(wide) for _, text in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), wide)
        ink = np.repeat(np.where(signs != 32, np.uint8(40), np.uint8(255)), 6, axis=1)
        ink[:, 5::6] = 255
        lines[1:] = ink[:, :width]
        place[np.array([14 * slot for slot, _ in rows])[:, None] + np.arange(2, 10)] = np.arange(1, len(rows) + 1)[:, None]
    return raster.Rows(lines, place[:height])


def paint_pages(pages: DataFrame, regions: DataFrame, style: str = "blur", keep_boxes: bool = False) -> DataFrame:
    """pages with their image painted: every page comes out, with its regions covered in their order. One join, by page.

    keep_boxes leaves the regions beside the image, for digests.
    """
    box = F.struct("ord", *[F.col(f"box.{c}").alias(c) for c in ("x", "y", "width", "height")], "target")
    by = regions.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    met = pages.join(by, ["doc_id", "page"], "left").select(*pages.columns, "boxes")
    out = met if keep_boxes else met.drop("boxes")
    names = out.columns

    def covered(png: bytes, boxes: list[dict] | None) -> bytes:
        image = raster.read_rows(png)
        if boxes:
            image = raster.painted(image, [(b["x"], b["y"], b["width"], b["height"], b["target"]) for b in boxes], style)
        return raster.encode_png(image)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = batch.column(batch.schema.get_field_index("boxes")).to_pylist()
            pngs = batch.column(batch.schema.get_field_index("image"))
            images = (covered(pngs[i].as_py(), boxes[i]) for i in range(batch.num_rows))  # one page at a time in memory
            for start, some in _portions(images, len):
                part = batch.slice(start, len(some))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()) if n == "image" else part.column(part.schema.get_field_index(n)) for n in names], names=names)

    return met.mapInArrow(told, out.schema)


def digests(pages: DataFrame) -> DataFrame:
    """What pages painted with keep_boxes show: doc_id, page, width, height, covered (pixels of regions), black (of those), ink (dark pixels elsewhere)."""
    met = pages.select("doc_id", "page", "image", "boxes")

    def shown(png: bytes, boxes: list[dict] | None) -> tuple[int, int, int, int, int]:
        image = raster.read_rows(png)
        if isinstance(image, raster.Rows):
            if not boxes:
                dark = np.count_nonzero(image.rows < 128, axis=1)
                return image.rows.shape[1], len(image.place), 0, 0, int(dark[image.place].sum())
            image = image.pixels()
        most = image if image.ndim == 2 else image.max(axis=2)
        dark = most < 128
        inside = np.zeros(most.shape, bool)
        for b in boxes or ():
            inside[max(0, int(np.floor(b["y"]))) : int(np.ceil(b["y"] + b["height"])), max(0, int(np.floor(b["x"]))) : int(np.ceil(b["x"] + b["width"]))] = True
        return image.shape[1], image.shape[0], int(np.count_nonzero(inside)), int(np.count_nonzero(inside & (most == 0))), int(np.count_nonzero(dark & ~inside))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shown(png.as_py(), boxes) for png, boxes in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            counts = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), *counts], names=["doc_id", "page", "width", "height", "covered", "black", "ink"])

    return met.mapInArrow(told, f"doc_id {met.schema['doc_id'].dataType.simpleString()}, page int, width long, height long, covered long, black long, ink long")


def grid_overlays(pages: DataFrame, grid: GridOptions = GridOptions()) -> DataFrame:
    """doc_id, page, image of pages under their reference grid."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = (raster.encode_png(raster.overlay(raster.read_rows(png.as_py()), grid.cols, grid.rows, grid.opacity, label_of)) for png in batch.column(2))
            for start, some in _portions(images, len):
                part = batch.slice(start, len(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(some, pa.binary())], names=["doc_id", "page", "image"])

    slim = pages.select("doc_id", "page", "image")
    return slim.mapInArrow(told, slim.schema)


def build_pdfs(pages: DataFrame, dpi: int = 150) -> DataFrame:
    """doc_id, pdf: a document's painted pages in order. pages may have point_width and point_height, else dpi gives the size.

    A document's pages meet in one task: limits on a document's pixels bound it.
    """
    sized = pages.columns
    points = [F.col(c) if c in sized else F.lit(None).cast("double").alias(c) for c in ("point_width", "point_height")]
    item = F.struct("page", "image", *points)
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("pages"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bound(doc: pa.Scalar) -> bytes:
            drawn = []
            for p in doc.as_py():
                image = raster.read_rows(p["image"])
                width, height = raster.png_size(p["image"])
                drawn.append((image, p["point_width"] or width * POINTS_PER_INCH / dpi, p["point_height"] or height * POINTS_PER_INCH / dpi))
            return raster.raster_pdf(drawn)

        for batch in batches:
            for start, some in _portions(map(bound, batch.column(1)), len):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)), pa.array(some, pa.binary())], names=["doc_id", "pdf"])

    return docs.mapInArrow(told, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pdf binary")
