"""Channel definitions and delivery profiles as rules over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channels_complete(channels: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, missing, repeated): of images (image_id, numcomps) how many components no definition (image_id, cn)
    names, and how many several do."""
    want = images.withColumn("cn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("numcomps") - 1))).select("image_id", "cn")
    named = channels.groupBy("image_id", "cn").agg(F.count("*").alias("n"))
    both = want.join(named, ["image_id", "cn"], "left")
    return both.groupBy("image_id").agg(F.sum(F.col("n").isNull().cast("long")).alias("missing"), F.sum((F.coalesce("n", F.lit(0)) > 1).cast("long")).alias("repeated"))


def channel_order(defs: Column, n: Column) -> Column:
    """Order of components after definitions array<struct<cn, asoc>>, in their order: a definition with association k
    swaps component cn with component k - 1, and later definitions of the swapped two follow the swap."""
    start = F.struct(F.sequence(F.lit(0).cast("long"), n - 1).alias("order"), F.transform(defs, lambda d: d["cn"]).alias("cn"))

    def step(s: Column, i: Column) -> Column:
        cn, to = F.get(s["cn"], i), F.get(defs, i)["asoc"] - 1
        live = (F.get(defs, i)["asoc"] > 0) & (F.get(defs, i)["asoc"] < 65535) & (cn != to) & (cn < n) & (to < n)
        order = F.transform(s["order"], lambda v, k: F.when(k == cn, F.get(s["order"], to.cast("int"))).when(k == to, F.get(s["order"], cn.cast("int"))).otherwise(v))
        later = F.transform(s["cn"], lambda v, k: F.when(k <= i, v).when(v == cn, to).when(v == to, cn).otherwise(v))
        return F.when(live, F.struct(order.alias("order"), later.alias("cn"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.size(defs) - 1), start, step)["order"]


#: Largest sub-level of each main level of the interoperable master format (fixed values).
SUBLEVEL = (15, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9)


def imf_rules(mainlevel: Column, sublevel: Column) -> dict[str, Column]:
    """Checks of a 2K irreversible profile on columns of the geometry relation; compliant if all hold."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    limit = F.element_at(F.array(*map(F.lit, SUBLEVEL)), F.least(mainlevel, F.lit(11)).cast("int") + 1)
    return {
        "levels": (mainlevel <= 11) & (sublevel <= limit),
        "components": F.col("numcomps") <= 3,
        "origin": (F.col("x0") == 0) & (F.col("y0") == 0) & (F.col("tx0") == 0) & (F.col("ty0") == 0),
        "tile": (F.col("tdx") >= w) & (F.col("tdy") >= h),
        "precision": (F.col("prec") >= 8) & (F.col("prec") <= 16),
        "sampling": (F.col("dx").isin(1, 2)) & (F.col("dy") == 1),
        "size": (w <= 2048) & (h <= 1556),
        "blocks": (F.col("cblkw") == 5) & (F.col("cblkh") == 5),
        "layers": F.col("nlayers") == 1,
    }


def cinema_settings(fast: Column) -> dict[str, Column]:
    """What a 2K cinema profile makes of an image's settings: `fast` for 48 pictures a second. Bytes of a picture at 24 and
    48 a second, block and precinct sizes are the profile's (fixed values)."""
    cap = F.when(fast, F.lit(651041)).otherwise(F.lit(1302083))
    samples = F.col("numcomps") * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * F.col("prec")
    return {"cap": cap.cast("long"), "numres": F.least(F.col("numres"), F.lit(6).cast("long")), "cblk": F.lit(5).cast("long"), "precinct": F.when(F.col("numres") == 1, F.lit(7)).otherwise(F.lit(8)).cast("long"), "rate": samples.cast("double") / (cap * 8).cast("double")}


def component_map_check(maps: DataFrame) -> DataFrame:
    """Of component maps (image_id, numcomps, channels, i, cmp, mtyp, pcol), a row for each channel: how many name a
    component that is not there, how many map badly (a direct channel has column 0, a palette channel its own), how many
    palette channels are left without a column, whether a map of one component is to be replaced by the plain one, and
    whether the map can be used."""
    direct, through = (F.col("mtyp") == 0) & (F.col("pcol") == 0), (F.col("mtyp") == 1) & (F.col("pcol") == F.col("i"))
    m = maps.withColumn("fits", (direct | through) & (F.col("pcol") < F.col("channels")))
    one = m.groupBy("image_id", "numcomps", "channels").agg(
        F.sum((F.col("cmp") >= F.col("numcomps")).cast("long")).alias("bad_component"),
        F.sum((~F.col("fits")).cast("long")).alias("bad_mapping"),
        F.collect_set(F.when(F.col("fits"), F.col("pcol"))).alias("used"),
        F.collect_set(F.when(F.col("mtyp") != 0, F.col("i"))).alias("palette"),
    )
    one = one.withColumn("unmapped", F.size(F.array_except("palette", "used")).cast("long"))
    sane = (F.col("bad_component") == 0) & (F.col("bad_mapping") == 0) & (F.col("unmapped") == 0)
    return one.select("image_id", "bad_component", "bad_mapping", "unmapped", (sane & (F.col("numcomps") == 1) & (F.size("used") < F.col("channels"))).alias("replaced"), sane.alias("usable"))


def colour_pipeline(subset: Column, definitions: Column, palette: Column, mapped: Column, valid: Column) -> Column:
    """What is done to the components of a decoded image, in order: nothing if only some components were asked for; else
    the check, the palette if it has a component map, and the channel definitions."""
    steps = F.concat(F.array(F.lit("check")), F.when(palette & mapped, F.array(F.lit("palette"))).otherwise(F.array().cast("array<string>")), F.when(definitions, F.array(F.lit("channels"))).otherwise(F.array().cast("array<string>")))
    return F.when(subset, F.lit("")).when(~valid, F.lit("error")).otherwise(F.array_join(steps, "+"))


def cinema4k_resolutions(numres: Column) -> Column:
    """Resolutions that the 4K cinema profile allows: one to six levels, and none where there are fewer than two."""
    return F.when(numres < 2, F.lit(1)).otherwise(F.least(numres, F.lit(7))).cast("long")


#: Largest width and height of the interoperable master format's size classes (fixed values).
IMF_SIZES = {"2k": (2048, 1556), "4k": (4096, 3112), "8k": (8192, 6224)}


def imf_size_class(w: Column, h: Column) -> Column:
    """The smallest size class that an image fits, null if none."""
    out = F.lit(None).cast("string")
    for name, (a, b) in reversed(IMF_SIZES.items()):
        out = F.when((w <= a) & (h <= b), F.lit(name)).otherwise(out)
    return out


def cinema_rules(components: Column, prec: Column, signed: Column, w: Column, h: Column, four: Column) -> dict[str, Column]:
    """Checks of the 2K or (four) 4K cinema profile; compliant if all hold."""
    return {"components": components == 3, "precision": (prec == 12) & ~signed, "size": (w <= F.when(four, 4096).otherwise(2048)) & (h <= F.when(four, 2160).otherwise(1080))}
