"""Sparse arrays of blocks: windows are written to and read from a grid of which only touched blocks exist.

An array is (array_id, width, height, bw, bh). A window is cut into the blocks that it meets by counting, so that a window
and its blocks meet in a join of equals on the block's place: neither side is compared with all of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import div


def valid(array: DataFrame) -> Column:
    """Whether a window (x0, y0, x1, y1) lies in its array and has an area."""
    inside = lambda a, size: (F.col(f"{a}0") >= 0) & (F.col(f"{a}0") < F.col(f"{a}1")) & (F.col(f"{a}1") <= F.col(size))
    return inside("x", "width") & inside("y", "height")


def pieces(windows: DataFrame) -> DataFrame:
    """`windows` with a row for each block that they meet: by, bx, and the piece px0, py0, px1, py1 of the window in it.
    Windows that are not valid() meet none."""
    run = lambda a, size: F.sequence(div(f"{a}0", size), div(F.col(f"{a}1") - 1, size))
    w = windows.where(valid(windows)).withColumn("by", F.explode(run("y", "bh"))).withColumn("bx", F.explode(run("x", "bw")))
    cut = {}
    for a, size in (("x", "bw"), ("y", "bh")):
        cut[f"p{a}0"] = F.greatest(F.col(f"{a}0"), F.col(f"b{a}") * F.col(size))
        cut[f"p{a}1"] = F.least(F.col(f"{a}1"), (F.col(f"b{a}") + 1) * F.col(size))
    return w.withColumns(cut)


def _cells(of: DataFrame, offset) -> DataFrame:
    """A row for each line of a piece: y, and vals, the values of `offset(y, x)` from px0 to px1."""
    w = of.withColumn("y", F.explode(F.sequence(F.col("py0"), F.col("py1") - 1)))
    return w.withColumn("vals", F.transform(F.sequence(F.col("px0"), F.col("px1") - 1), lambda x: offset(F.col("y"), x)))


def stored(writes: DataFrame) -> DataFrame:
    """(array_id, by, bx, cells): blocks of bw * bh values after `writes` (seq, array_id, array's sizes, window, col_stride,
    line_stride, src array<long>) in the order of seq. A value lies in src at its line times line_stride plus its column
    times col_stride; cells that no write has reached are 0."""
    at = lambda y, x: F.get("src", ((y - F.col("y0")) * F.col("line_stride") + (x - F.col("x0")) * F.col("col_stride")).cast("int"))
    lines = _cells(pieces(writes), at)
    lines = lines.withColumn("first", (F.col("y") - F.col("by") * F.col("bh")) * F.col("bw") + F.col("px0") - F.col("bx") * F.col("bw"))
    c = lines.select("array_id", "by", "bx", "bw", "bh", "seq", "first", F.posexplode("vals").alias("i", "v"))
    # the last write of a cell counts: combined before the shuffle
    c = c.groupBy("array_id", "by", "bx", "bw", "bh", (F.col("first") + F.col("i")).alias("cell")).agg(F.max_by("v", "seq").alias("v"))
    per = c.groupBy("array_id", "by", "bx", "bw", "bh").agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"))  # a block's cells at most
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("bw") * F.col("bh") - 1), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long")))
    return per.select("array_id", "by", "bx", cells.alias("cells"))


def read(blocks: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, at, v) of `windows` (window_id, array_id, array's sizes, window, col_stride, line_stride): values and
    their places in the window's buffer; blocks that do not exist are read as zeros."""
    held = pieces(windows).join(blocks.select("array_id", "by", "bx", "cells"), ["array_id", "by", "bx"], "left")
    place = lambda y, x: ((y - F.col("by") * F.col("bh")) * F.col("bw") + x - F.col("bx") * F.col("bw")).cast("int")
    lines = _cells(held, lambda y, x: F.coalesce(F.get("cells", place(y, x)), F.lit(0).cast("long")))
    base = (F.col("y") - F.col("y0")) * F.col("line_stride") + (F.col("px0") - F.col("x0")) * F.col("col_stride")
    out = lines.select("window_id", base.alias("base"), "col_stride", F.posexplode("vals").alias("i", "v"))
    return out.select("window_id", (F.col("base") + F.col("i") * F.col("col_stride")).alias("at"), "v")
