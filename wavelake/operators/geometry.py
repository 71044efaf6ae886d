"""Tiles, components, resolutions, sub-bands, precincts and code-blocks of images, in closed form.

Each step adds rows by exploding a counted sequence and columns by arithmetic; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ceil_div, ceil_shift, clamp, div, long, once, shift_left, shift_right


def _counted(df: DataFrame, name: str, n) -> DataFrame:
    """A row for each number below n."""
    return df.withColumn("_n", long(n)).where("_n > 0").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")


def tiles(geom: DataFrame) -> DataFrame:
    g = geom.withColumn("tw", ceil_div(F.col("x1") - F.col("tx0"), "tdx")).withColumn("th", ceil_div(F.col("y1") - F.col("ty0"), "tdy"))
    g = _counted(g, "tileno", F.col("tw") * F.col("th")).withColumn("p", F.col("tileno") % F.col("tw")).withColumn("q", div("tileno", "tw"))
    at = lambda o, k, d: F.col(o) + F.col(k) * F.col(d)
    return g.withColumns({"ax0": F.greatest(at("tx0", "p", "tdx"), "x0"), "ay0": F.greatest(at("ty0", "q", "tdy"), "y0"), "ax1": F.least(at("tx0", "p", "tdx") + F.col("tdx"), "x1"), "ay1": F.least(at("ty0", "q", "tdy") + F.col("tdy"), "y1")})


def tile_components(t: DataFrame) -> DataFrame:
    """Component 0 is not sub-sampled, the others by (dx, dy)."""
    c = _counted(t, "compno", "numcomps")
    c = c.withColumn("cdx", F.when(F.col("compno") == 0, F.lit(1).cast("long")).otherwise(F.col("dx"))).withColumn("cdy", F.when(F.col("compno") == 0, F.lit(1).cast("long")).otherwise(F.col("dy")))
    return c.withColumns({f"c{a}{i}": ceil_div(f"a{a}{i}", f"cd{a}") for a in "xy" for i in "01"})


def resolutions(c: DataFrame) -> DataFrame:
    r = _counted(c, "resno", "numres").withColumn("lv", F.col("numres") - 1 - F.col("resno"))
    r = r.withColumns({f"r{a}{i}": ceil_shift(f"c{a}{i}", "lv") for a in "xy" for i in "01"})
    cells = lambda a, e: F.when(F.col(f"r{a}0") == F.col(f"r{a}1"), F.lit(0).cast("long")).otherwise(ceil_shift(f"r{a}1", e) - shift_right(f"r{a}0", e))
    return r.withColumn("pw", cells("x", "pdx")).withColumn("ph", cells("y", "pdy"))


def lower(r: DataFrame) -> DataFrame:
    """`r` with lw and lh, width and height of the next lower resolution of the same tile and component, in closed form."""
    size = lambda a: ceil_shift(f"c{a}1", F.col("lv") + 1) - ceil_shift(f"c{a}0", F.col("lv") + 1)
    return r.withColumns({"lw": size("x"), "lh": size("y")})


def bands(r: DataFrame) -> DataFrame:
    """Resolution 0 has the low band 0; the others have 1 (high in x), 2 (high in y) and 3 (both)."""
    b = r.withColumn("bandno", F.explode(F.when(F.col("resno") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3))))).withColumn("bandno", long("bandno"))
    n = F.greatest(F.col("numres") - F.col("resno"), F.lit(1).cast("long"))
    high = {"x": F.col("bandno") % 2, "y": div("bandno", F.lit(2))}
    edge = lambda a, i: F.when(F.col("resno") == 0, F.col(f"r{a}{i}")).otherwise(ceil_shift(F.col(f"c{a}{i}") - shift_left(F.lit(1), n - 1) * high[a], n))
    return b.withColumns({f"b{a}{i}": edge(a, i) for a in "xy" for i in "01"})


def precincts(b: DataFrame) -> DataFrame:
    """Precincts of each band that is not empty, in the band's coordinates."""
    live = b.where("bx1 > bx0 and by1 > by0")
    p = _counted(live, "precno", F.col("pw") * F.col("ph"))
    half = (F.col("resno") > 0).cast("long")
    place = {"x": F.col("precno") % F.col("pw"), "y": div("precno", "pw")}
    out = {}
    for a, e in (("x", "pdx"), ("y", "pdy")):
        width = F.col(e) - half
        start = shift_left(shift_right(f"r{a}0", e), e)
        first = F.when(F.col("resno") == 0, start).otherwise(ceil_shift(start, F.lit(1))) + shift_left(place[a], width)
        out |= {f"p{a}0": F.greatest(first, f"b{a}0"), f"p{a}1": F.least(first + shift_left(F.lit(1), width), f"b{a}1"), f"e{a}": F.least(F.col("cblkw" if a == "x" else "cblkh"), width)}
    return p.withColumns(out)


def code_blocks(p: DataFrame) -> DataFrame:
    live = p.where("px1 > px0 and py1 > py0")
    grid = {a: ceil_shift(f"p{a}1", f"e{a}") - shift_right(f"p{a}0", f"e{a}") for a in "xy"}
    c = _counted(live.withColumn("cw", grid["x"]).withColumn("ch", grid["y"]), "cblkno", F.col("cw") * F.col("ch"))
    place = {"x": F.col("cblkno") % F.col("cw"), "y": div("cblkno", "cw")}
    out = {}
    for a in "xy":
        first = shift_left(shift_right(f"p{a}0", f"e{a}") + place[a], f"e{a}")
        out |= {f"k{a}0": F.greatest(first, f"p{a}0"), f"k{a}1": F.least(first + shift_left(F.lit(1), f"e{a}"), f"p{a}1")}
    return c.withColumns(out)


def code_block_sums(p: DataFrame) -> DataFrame:
    """Of each precinct that is not empty the number of its code-blocks, their area, and the sums of their left and upper
    edges, in closed form: the blocks of a row begin at the precinct's edge, then at multiples of the block size."""
    live = p.where("px1 > px0 and py1 > py0")
    n = {a: ceil_shift(f"p{a}1", f"e{a}") - shift_right(f"p{a}0", f"e{a}") for a in "xy"}
    edges = {a: F.col(f"p{a}0") + shift_left((n[a] - 1) * shift_right(f"p{a}0", f"e{a}") + div(n[a] * (n[a] - 1), F.lit(2)), f"e{a}") for a in "xy"}
    return live.withColumns({"blocks": n["x"] * n["y"], "area": (F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0")), "sum_x": edges["x"] * n["y"], "sum_y": edges["y"] * n["x"]})


def component_header(geom: DataFrame) -> DataFrame:
    """Width, height and origin of each component after `reduce` levels are left out, in one tile grid."""
    c = _counted(geom, "compno", "numcomps")
    step = {a: F.when(F.col("compno") == 0, F.lit(1).cast("long")).otherwise(F.col(f"d{a}")) for a in "xy"}
    lo, hi = {a: ceil_div(f"{a}0", step[a]) for a in "xy"}, {a: ceil_div(f"{a}1", step[a]) for a in "xy"}
    size = {a: ceil_shift(hi[a], "reduce") - ceil_shift(lo[a], "reduce") for a in "xy"}
    return c.select("image_id", "compno", size["x"].alias("w"), size["y"].alias("h"), lo["x"].alias("cx0"), lo["y"].alias("cy0"))


def in_region(b: DataFrame, x0, y0, x1, y1, margin: int = 2) -> DataFrame:
    """Bands that a region of the image needs: its window in band coordinates, grown by the filter's reach, meets them."""
    n = F.when(F.col("resno") == 0, F.col("numres") - 1).otherwise(F.col("numres") - F.col("resno"))
    high = {"x": F.col("bandno") % 2, "y": div("bandno", F.lit(2))}
    whole = {"x0": (x0, "x"), "x1": (x1, "x"), "y0": (y0, "y"), "y1": (y1, "y")}
    # worked out once and in steps: one filter of it all is code that is too long to be compiled
    inner = {k: clamp(ceil_div(v, f"cd{a}"), F.col(f"c{a}0"), F.col(f"c{a}1")).alias(k) for k, (v, a) in whole.items()}
    b = once(b.where("bx1 > bx0 and by1 > by0"), "_w", F.struct(n.alias("n"), F.when(F.col("bandno") > 0, shift_left(F.lit(1), n - 1)).otherwise(F.lit(0)).alias("half"), *inner.values()))
    w = F.col("_w")
    edges = [F.when(w["n"] == 0, w[k]).otherwise(ceil_shift(w[k] - w["half"] * high[a], w["n"])).alias(k) for k, (_, a) in whole.items()]
    b = once(b, "_e", F.struct(*edges))
    meets = (F.col("_e.x0") - margin < F.col("bx1")) & (F.col("_e.x1") + margin > F.col("bx0")) & (F.col("_e.y0") - margin < F.col("by1")) & (F.col("_e.y1") + margin > F.col("by0"))
    return b.where(meets).drop("_w", "_e")


def stitched(t: DataFrame, x0, y0, x1, y1) -> DataFrame:
    """Tiles that meet a region, with the corner in the tile (sx, sy), the corner in the region (tx, ty) and the size of
    what is copied."""
    lo = {"x": F.greatest("ax0", x0), "y": F.greatest("ay0", y0)}
    hi = {"x": F.least("ax1", x1), "y": F.least("ay1", y1)}
    t = t.withColumns({"sx": lo["x"] - F.col("ax0"), "sy": lo["y"] - F.col("ay0"), "tx": lo["x"] - x0, "ty": lo["y"] - y0, "w": hi["x"] - lo["x"], "h": hi["y"] - lo["y"]})
    return t.where("w > 0 and h > 0")


def in_tile_range(t: DataFrame, x0, y0, x1, y1) -> DataFrame:
    """Tiles of the columns and rows of the grid that a region meets."""
    across = (F.col("p") >= div(x0 - F.col("tx0"), "tdx")) & (F.col("p") < ceil_div(x1 - F.col("tx0"), "tdx"))
    return t.where(across & (F.col("q") >= div(y0 - F.col("ty0"), "tdy")) & (F.col("q") < ceil_div(y1 - F.col("ty0"), "tdy")))
