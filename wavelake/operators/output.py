"""What a caller asks of an image and gets: an area, components in an order, tiles laid into lines, standard pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import shift_left


def decode_area(area: tuple[Column, ...], image: tuple[Column, ...]) -> Column:
    """struct<error, clamped, x0, y0, x1, y1> of a request (x0, y0, x1, y1) on an image's rectangle: all zero asks for the
    whole image; edges outside are drawn in and told in `clamped`; an area that lies outside is an error, and so are a
    negative start and an end that is not positive."""
    ax0, ay0, ax1, ay1 = area
    x0, y0, x1, y1 = image
    whole = (ax0 == 0) & (ay0 == 0) & (ax1 == 0) & (ay1 == 0)
    error = (
        F.when(whole, F.lit(None).cast("string"))
        .when(ax0 < 0, "left is negative").when(ax0 > x1, "left is outside")
        .when(ay0 < 0, "top is negative").when(ay0 > y1, "top is outside")
        .when(ax1 <= 0, "right is not positive").when(ax1 < x0, "right is outside")
        .when(ay1 <= 0, "bottom is not positive").when(ay1 < y0, "bottom is outside")
    )
    out = (F.greatest(ax0, x0), F.greatest(ay0, y0), F.least(ax1, x1), F.least(ay1, y1))
    sides = [F.when(bad, name) for name, bad in (("left", ax0 < x0), ("top", ay0 < y0), ("right", ax1 > x1), ("bottom", ay1 > y1))]
    clamped = F.when(whole, F.lit("")).otherwise(F.concat_ws(",", *sides))
    fields = [F.when(error.isNull(), F.when(whole, all_).otherwise(part)).alias(n) for n, all_, part in zip(("x0", "y0", "x1", "y1"), image, out, strict=True)]
    return F.struct(error.alias("error"), F.when(error.isNull(), clamped).alias("clamped"), *fields)


def component_error(asked: Column, numcomps: Column) -> Column:
    """What is first wrong with a list of components: one that the image has not, or one that comes twice."""
    each = F.transform(asked, lambda c, i: F.when((c < 0) | (c >= numcomps), F.concat(F.lit("no component "), c)).when(F.array_contains(F.slice(asked, F.lit(1), i), c), F.concat(F.lit("component "), c, F.lit(" twice"))))
    return F.get(F.filter(each, lambda e: e.isNotNull()), F.lit(0))


def in_order(asked: Column, numcomps: Column) -> Column:
    """The components that a list asks for, in its order; an empty list asks for all."""
    return F.when(F.size(asked) == 0, F.sequence(F.lit(0).cast("long"), numcomps - 1)).otherwise(asked)


def stitched(tiles: DataFrame, hole: int = 0) -> DataFrame:
    """(image_id, compno, y, x0, vals): the lines of an area (ax0, ay0, ax1, ay1) out of `tiles` (image_id, compno, area,
    the tile's x0, y0, x1, y1, and vals, its samples line by line). Only what a tile has of the area leaves it, as pieces
    of lines; a line is the largest row. Where no tile lies, `hole` is put; lines that no tile touches are not given."""
    cut = {"left": F.greatest("x0", "ax0"), "right": F.least("x1", "ax1"), "top": F.greatest("y0", "ay0"), "bottom": F.least("y1", "ay1")}
    t = tiles.withColumns(cut).where("left < right and top < bottom").withColumn("y", F.explode(F.sequence(F.col("top"), F.col("bottom") - 1)))
    first = ((F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) + F.col("left") - F.col("x0") + 1).cast("int")
    piece = F.slice("vals", first, (F.col("right") - F.col("left")).cast("int"))
    lines = t.select("image_id", "compno", "ax0", "ax1", "y", F.struct(F.col("left").alias("x"), piece.alias("v")).alias("p")).groupBy("image_id", "compno", "ax0", "ax1", "y").agg(F.sort_array(F.collect_list("p")).alias("p"))
    fill = lambda n: F.array_repeat(F.lit(hole).cast("long"), n.cast("int"))
    start = F.struct(F.col("ax0").alias("at"), F.array().cast("array<bigint>").alias("v"))
    laid = F.aggregate("p", start, lambda s, p: F.struct((p["x"] + F.size(p["v"])).alias("at"), F.concat(s["v"], fill(p["x"] - s["at"]), p["v"]).alias("v")))
    lines = lines.withColumn("laid", laid)
    return lines.select("image_id", "compno", "y", F.col("ax0").alias("x0"), F.concat(F.col("laid.v"), fill(F.col("ax1") - F.col("laid.at"))).alias("vals"))


def standard_kind(comps: Column, prec: Column, same: Column) -> Column:
    """struct<kind, error> of an image of `comps` components: gray and rgba of 8 bits, or gray16 and rgba64 over 8 bits."""
    error = F.when(comps == 0, "no components").when(~same, "components of differing sizes").when(prec > 16, "over 16 bits").when(~comps.isin(1, 3, 4), F.concat(F.lit("component count "), comps))
    kind = F.when(error.isNull(), F.when(comps == 1, F.when(prec > 8, "gray16").otherwise("gray")).otherwise(F.when(prec > 8, "rgba64").otherwise("rgba")))
    return F.struct(kind.alias("kind"), error.alias("error"))


def standard_channels(values: Column, prec: Column, signed: Column) -> Column:
    """Channels of a pixel of one, three or four components in the depth of its kind: signed samples are shifted, few bits
    go up and many come down, and where there is no alpha it is opaque."""
    wide = prec > 8
    depth = F.when(wide, F.lit(16)).otherwise(F.lit(8))
    top = F.when(wide, F.lit(65535)).otherwise(F.lit(255)).cast("long")
    moved = lambda v: v + F.when(signed, shift_left(F.lit(1), prec - 1)).otherwise(F.lit(0).cast("long"))
    scaled = lambda v: F.greatest(F.lit(0).cast("long"), F.least(top, shift_left(moved(v), depth - prec)))
    out = F.transform(values, scaled)
    return F.when(F.size(values) == 3, F.concat(out, F.array(top))).otherwise(out)


def ordered_sum(rows: DataFrame, keys: list[str], value: str, ordinal: str, width: int = 1024) -> DataFrame:
    """(keys, total): sums of doubles that do not depend on how rows lie in tasks: those of each `width` ordinals are added
    in their order, then these sums in theirs. A hot key is many ranges, each a row that is shuffled once more."""
    in_turn = lambda c: F.aggregate(F.transform(F.sort_array(c), lambda p: p["v"]), F.lit(0.0), lambda a, v: a + v)
    part = rows.groupBy(*keys, F.floor(F.col(ordinal) / width).alias("_range")).agg(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(value).cast("double").alias("v"))).alias("p"))
    part = part.select(*keys, F.struct(F.col("_range").alias("o"), in_turn(F.col("p")).alias("v")).alias("s"))
    return part.groupBy(*keys).agg(F.collect_list("s").alias("s")).select(*keys, in_turn(F.col("s")).alias("total"))


def merged_runs(parts: DataFrame, keys: list[str], ordinal: str, data: str, width: int = 4096) -> DataFrame:
    """(keys, run, parts, off, data): strings or bytes of `parts` laid together in the order of their ordinals, a row for each
    `width` ordinals, with its place in the whole. No row and no task holds all of a hot key; laid end to end the runs are
    its whole."""
    run = parts.groupBy(*keys, F.floor(F.col(ordinal) / width).alias("run")).agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(data).alias("d")))).alias("p"))
    run = run.select(*keys, "run", "parts", F.aggregate("p", F.lit("").cast(dict(parts.dtypes)[data]), lambda a, p: F.concat(a, p["d"])).alias("data"))
    before = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.octet_length("data").cast("long")).over(before), F.lit(0).cast("long"))
    return run.select(*keys, "run", "parts", off.alias("off"), "data")


def pass_lengths(ends: Column, last_bytes: Column) -> Column:
    """Lengths of coding passes from their ends: an end steps back where the byte before it is FF, and a length runs from the
    end before it, as that one is after its step."""
    stepped = F.transform(ends, lambda e, i: e - F.when((F.get(last_bytes, i) == 255) & (e > 0), 1).otherwise(0))
    return F.transform(stepped, lambda e, i: e - F.coalesce(F.get(stepped, i - 1), F.lit(0).cast("long")))


