"""Expressions of the reference grid: lettered columns, numbered rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.geometry import box

CELL = "struct<col:int,row:int>"
#: Letters of the last index that a long holds.
LONGEST = 14


def column_label(index: Column) -> Column:
    """A to Z, AA to ZZ, AAA and so on, for an index from 0: base 26 without a zero, of any length."""
    state = F.struct(index.cast("long").alias("rest"), F.lit("").alias("label"))

    def step(s: Column, _: Column) -> Column:
        more = F.struct((F.call_function("div", s["rest"], F.lit(26)) - 1).alias("rest"), F.concat(F.chr(65 + s["rest"] % 26), s["label"]).alias("label"))
        return F.when(s["rest"] >= 0, more).otherwise(s)

    label = F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST)), state, step, lambda s: s["label"])
    return F.when(index.isNotNull(), label)


def column_index(label: Column) -> Column:
    """The index of a label in any case; -1 for anything but letters."""
    up = F.upper(label)
    value = F.aggregate(F.filter(F.split(up, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + (F.ascii(c) - 64))
    return F.when(up.rlike("^[A-Z]+$"), value - 1).otherwise(F.lit(-1))


def parse_cell(reference: Column) -> Column:
    """(col, row) from 0; null unless it is one to three letters and digits, with blanks around or between."""
    shape = r"^\s*([A-Za-z]{1,3})\s*([0-9]{1,3})\s*$"
    col = column_index(F.regexp_extract(reference, shape, 1))
    row = F.regexp_extract(reference, shape, 2).try_cast("int") - 1
    return F.when(reference.rlike(shape) & (col >= 0) & (row >= 0), F.struct(col.cast("int").alias("col"), row.cast("int").alias("row")))


def range_box(a: Column, b: Column, cols: int, rows: int, width: Column, height: Column) -> Column:
    """The rectangle of two corner cells in any order, both included, kept on the grid."""
    c0, c1 = F.greatest(F.lit(0), F.least(a["col"], b["col"])), F.least(F.lit(cols - 1), F.greatest(a["col"], b["col"]))
    r0, r1 = F.greatest(F.lit(0), F.least(a["row"], b["row"])), F.least(F.lit(rows - 1), F.greatest(a["row"], b["row"]))
    w, h = width / cols, height / rows
    return box(c0 * w, r0 * h, (c1 - c0 + 1) * w, (r1 - r0 + 1) * h)
