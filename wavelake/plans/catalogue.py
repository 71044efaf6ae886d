"""The registered queries over the given tables, each with the DuckDB SQL of the same result where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as e
from ..functions import options
from ..operators import color, colormeta, geometry, packets, rate, wavelet
from ..sources import headers
from ..streaming import ingest
from .fixtures import GEOM_SQL, PASSES_SQL, RASTER_SQL
from .fixtures import geometry as geom
from .fixtures import passes, pixels, planes, table
from .registry import ORACLES, QUERIES, query  # noqa: F401

def _samples(df: DataFrame, rows: str = "rows") -> DataFrame:
    """(image_id, compno, y, x, v) of planes held as rows."""
    r = df.select("image_id", "compno", F.posexplode(rows).alias("y", "r"))
    r = r.select("image_id", "compno", F.col("y").cast("long").alias("y"), F.posexplode("r").alias("x", "v"))
    return r.withColumn("x", F.col("x").cast("long"))


def _whole(spark: SparkSession, sf_dir: str, signed: bool = True) -> DataFrame:
    """(image_id, compno, rows) of all planes."""
    return planes(spark, sf_dir, signed).select("image_id", F.col("compno").cast("long").alias("compno"), wavelet.fold(F.col("vals")).alias("rows"))


# --- integer arithmetic -------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey AS k, (a + b - 1) // b AS ceil_div, (a + (1 << s) - 1) >> s AS ceil_shift, a >> s AS floor_shift,
  CASE WHEN a <= 1 THEN 0 ELSE CAST(floor(log2(a)) AS BIGINT) END AS log2, least(a + 4294967290, 4294967295) AS adds,
  greatest(b - a, 0) AS subs, greatest(-20, least(50, a)) AS clamped,
  ((((a * b * 100003 + 4096) >> 13) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS fixed
FROM (SELECT p_partkey, p_partkey % 1000 AS a, 1 + p_size AS b, p_size % 7 AS s FROM part)
""")
def int_math_exprs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 1000).alias("a"), (1 + F.col("p_size").cast("long")).alias("b"), (F.col("p_size") % 7).cast("long").alias("s"))
    return p.select("k", e.ceil_div("a", "b").alias("ceil_div"), e.ceil_shift("a", "s").alias("ceil_shift"), e.shift_right("a", "s").alias("floor_shift"), e.floor_log2("a").alias("log2"), e.saturating_add("a", F.lit(4294967290)).alias("adds"), e.saturating_sub("b", "a").alias("subs"), e.clamp("a", -20, 50).alias("clamped"), e.fix_mul(F.col("a") * F.col("b"), F.lit(100003)).alias("fixed"))


# --- geometry -----------------------------------------------------------------------------------------------------


@query(f"WITH {GEOM_SQL} SELECT image_id, tileno, p, q, ax0, ay0, ax1, ay1 FROM tiles")
def tile_grid(spark, sf_dir):
    return geometry.tiles(geom(spark, sf_dir)).select("image_id", "tileno", "p", "q", "ax0", "ay0", "ax1", "ay1")


@query(f"WITH {GEOM_SQL} SELECT image_id, tileno, compno, cx0, cy0, cx1, cy1 FROM tile_comps")
def tile_comp_geometry(spark, sf_dir):
    return geometry.tile_components(geometry.tiles(geom(spark, sf_dir))).select("image_id", "tileno", "compno", "cx0", "cy0", "cx1", "cy1")


def _res(spark, sf_dir):
    return geometry.resolutions(geometry.tile_components(geometry.tiles(geom(spark, sf_dir))))


@query(f"WITH {GEOM_SQL} SELECT image_id, tileno, compno, resno, rx0, ry0, rx1, ry1, pw, ph FROM res")
def resolution_geometry(spark, sf_dir):
    return _res(spark, sf_dir).select("image_id", "tileno", "compno", "resno", "rx0", "ry0", "rx1", "ry1", "pw", "ph")


@query(f"WITH {GEOM_SQL} SELECT image_id, tileno, compno, resno, bandno, bx0, by0, bx1, by1 FROM bands WHERE bx1 > bx0 AND by1 > by0")
def subband_geometry(spark, sf_dir):
    return geometry.bands(_res(spark, sf_dir)).where("bx1 > bx0 and by1 > by0").select("image_id", "tileno", "compno", "resno", "bandno", "bx0", "by0", "bx1", "by1")


@query(f"""WITH {GEOM_SQL},
prec AS (SELECT *, pdx - h AS wx, pdy - h AS wy, CASE WHEN h = 0 THEN sx ELSE (sx + 1) >> 1 END + ((precno % pw) << (pdx - h)) AS fx,
    CASE WHEN h = 0 THEN sy ELSE (sy + 1) >> 1 END + ((precno // pw) << (pdy - h)) AS fy
  FROM (SELECT *, unnest(range(pw * ph)) AS precno, least(resno, 1) AS h, (rx0 >> pdx) << pdx AS sx, (ry0 >> pdy) << pdy AS sy FROM bands WHERE bx1 > bx0 AND by1 > by0)),
clip AS (SELECT *, greatest(fx, bx0) AS px0, greatest(fy, by0) AS py0, least(fx + (1 << wx), bx1) AS px1, least(fy + (1 << wy), by1) AS py1,
    least(cblkw, wx) AS ex, least(cblkh, wy) AS ey FROM prec),
cb AS (SELECT *, greatest(((px0 >> ex) + c % cw) << ex, px0) AS kx0, greatest(((py0 >> ey) + c // cw) << ey, py0) AS ky0,
    least(((px0 >> ex) + c % cw + 1) << ex, px1) AS kx1, least(((py0 >> ey) + c // cw + 1) << ey, py1) AS ky1
  FROM (SELECT *, unnest(range(cw * ch)) AS c FROM (SELECT *, ((px1 + (1 << ex) - 1) >> ex) - (px0 >> ex) AS cw, ((py1 + (1 << ey) - 1) >> ey) - (py0 >> ey) AS ch
    FROM clip WHERE px1 > px0 AND py1 > py0)))
SELECT image_id, tileno, compno, resno, bandno, count(*) AS blocks, CAST(sum((kx1 - kx0) * (ky1 - ky0)) AS BIGINT) AS area, CAST(sum(kx0 * 3 + ky0 * 5) AS BIGINT) AS corners
FROM cb GROUP BY ALL""")
def precinct_codeblock_grid(spark, sf_dir):
    p = geometry.precincts(geometry.bands(_res(spark, sf_dir)))
    c = geometry.code_block_sums(p)
    return c.groupBy("image_id", "tileno", "compno", "resno", "bandno").agg(F.sum("blocks").alias("blocks"), F.sum("area").alias("area"), F.sum(F.col("sum_x") * 3 + F.col("sum_y") * 5).alias("corners"))


@query(f"""WITH {GEOM_SQL}, c AS (SELECT *, unnest(range(numcomps)) AS compno FROM geom),
d AS (SELECT *, CASE WHEN compno = 0 THEN 1 ELSE dx END AS sx, CASE WHEN compno = 0 THEN 1 ELSE dy END AS sy FROM c),
f AS (SELECT *, (x0 + sx - 1) // sx AS cx0, (y0 + sy - 1) // sy AS cy0, (x1 + sx - 1) // sx AS cx1, (y1 + sy - 1) // sy AS cy1 FROM d)
SELECT image_id, compno, ((cx1 + (1 << reduce) - 1) >> reduce) - ((cx0 + (1 << reduce) - 1) >> reduce) AS w,
  ((cy1 + (1 << reduce) - 1) >> reduce) - ((cy0 + (1 << reduce) - 1) >> reduce) AS h, cx0, cy0 FROM f""")
def comp_header_update(spark, sf_dir):
    return geometry.component_header(geom(spark, sf_dir))


@query(f"""WITH {GEOM_SQL}, win AS (
  SELECT *, CASE WHEN resno = 0 THEN numres - 1 ELSE numres - resno END AS n, greatest(cx0, least(cx1, (x0 + 20 + cdx - 1) // cdx)) AS u0,
    greatest(cx0, least(cx1, (x0 + 60 + cdx - 1) // cdx)) AS u1, greatest(cy0, least(cy1, (y0 + 10 + cdy - 1) // cdy)) AS v0,
    greatest(cy0, least(cy1, (y0 + 40 + cdy - 1) // cdy)) AS v1 FROM bands WHERE bx1 > bx0 AND by1 > by0),
o AS (SELECT *, CASE WHEN bandno > 0 THEN 1 << (n - 1) ELSE 0 END AS half FROM (SELECT * FROM win)),
m AS (SELECT *, CASE WHEN n = 0 THEN u0 ELSE (u0 - half * xob + (1 << n) - 1) >> n END AS a0, CASE WHEN n = 0 THEN u1 ELSE (u1 - half * xob + (1 << n) - 1) >> n END AS a1,
  CASE WHEN n = 0 THEN v0 ELSE (v0 - half * yob + (1 << n) - 1) >> n END AS b0, CASE WHEN n = 0 THEN v1 ELSE (v1 - half * yob + (1 << n) - 1) >> n END AS b1 FROM o)
SELECT image_id, tileno, compno, resno, bandno FROM m WHERE a0 - 2 < bx1 AND a1 + 2 > bx0 AND b0 - 2 < by1 AND b1 + 2 > by0""")
def aoi_band_filter(spark, sf_dir):
    b = geometry.bands(_res(spark, sf_dir))
    return geometry.in_region(b, F.col("x0") + 20, F.col("y0") + 10, F.col("x0") + 60, F.col("y0") + 40).select("image_id", "tileno", "compno", "resno", "bandno")


@query(f"WITH {GEOM_SQL} SELECT image_id, tileno, compno, resno, rx1 - rx0 AS w, ry1 - ry0 AS h FROM res WHERE resno < numres - reduce")
def reduce_levels(spark, sf_dir):
    r = _res(spark, sf_dir).where(F.col("resno") < F.col("numres") - F.col("reduce"))
    return r.select("image_id", "tileno", "compno", "resno", (F.col("rx1") - F.col("rx0")).alias("w"), (F.col("ry1") - F.col("ry0")).alias("h"))


@query(f"""WITH {GEOM_SQL} SELECT image_id, bandno, resno, expn, greatest(0, expn + 2 - 1) AS numbps, (1 + mant / 2048.0::DOUBLE) * pow(2.0, prec - expn) AS stepsize
FROM (SELECT DISTINCT image_id, resno, bandno, prec, image_id % 2048 AS mant, greatest(0, (8 + image_id % 9) - (CASE WHEN bandno = 0 THEN 0 ELSE (3 * (resno - 1) + bandno - 1) // 3 END)) AS expn FROM bands)""")
def qcd_derived_steps(spark, sf_dir):
    g = geom(spark, sf_dir)
    r = g.withColumn("resno", F.explode(F.sequence(F.lit(0).cast("long"), F.col("numres") - 1)))
    b = r.withColumn("bandno", F.explode(F.when(F.col("resno") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3))))).withColumn("bandno", F.col("bandno").cast("long"))
    index = 3 * (F.col("resno") - 1) + F.col("bandno")
    drop = F.when(F.col("bandno") == 0, F.lit(0).cast("long")).otherwise(e.div(index - 1, F.lit(3)))
    b = b.withColumn("expn", F.greatest(F.lit(0).cast("long"), 8 + F.col("image_id") % 9 - drop))
    return b.select("image_id", "bandno", "resno", "expn", F.greatest(F.lit(0).cast("long"), F.col("expn") + 2 - 1).alias("numbps"), color.step_size(F.col("expn"), F.col("image_id") % 2048, F.col("prec"), F.lit(0)).alias("stepsize"))


# --- colour and samples -------------------------------------------------------------------------------------------

_PIX = f"WITH {RASTER_SQL} "


def _shifted(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return p, tuple(F.col(c) - 128 for c in ("c0", "c1", "c2"))


def _out(p: DataFrame, values, names) -> DataFrame:
    return p.select("image_id", "y", "x", *(v.alias(n) for v, n in zip(values, names, strict=True)))


_S = "(SELECT image_id, y, x, c0 - 128 AS r, c1 - 128 AS g, c2 - 128 AS b FROM pixels)"


@query(_PIX + f"SELECT image_id, y, x, (r + 2 * g + b) >> 2 AS y0, b - g AS u, r - g AS v FROM {_S}")
def rct_forward(spark, sf_dir):
    p, s = _shifted(spark, sf_dir)
    return _out(p, color.rct(*s), ("y0", "u", "v"))


@query(_PIX + f"SELECT image_id, y, x, r, g, b FROM {_S}")
def rct_roundtrip(spark, sf_dir):
    p, s = _shifted(spark, sf_dir)
    return _out(p, color.rct_inverse(*color.rct(*s)), ("r", "g", "b"))


@query(_PIX + "SELECT image_id, y, x, s2 + (s0 - ((s1 + s2) >> 2)) AS r, s0 - ((s1 + s2) >> 2) AS g, s1 + (s0 - ((s1 + s2) >> 2)) AS b FROM pixels")
def rct_inverse(spark, sf_dir):
    p = pixels(spark, sf_dir, signed=True)
    return _out(p, color.rct_inverse(*(F.col(c) for c in ("c0", "c1", "c2"))), ("r", "g", "b"))


_F = "(SELECT image_id, y, x, CAST(c0 - 128 AS FLOAT) AS r, CAST(c1 - 128 AS FLOAT) AS g, CAST(c2 - 128 AS FLOAT) AS b FROM pixels)"
_ICT = f"""(SELECT image_id, y, x, 0.299::FLOAT * r + (0.587::FLOAT * g + 0.114::FLOAT * b) AS y0,
  (-0.16875)::FLOAT * r + ((-0.331260)::FLOAT * g + 0.5::FLOAT * b) AS u, 0.5::FLOAT * r + ((-0.41869)::FLOAT * g - 0.08131::FLOAT * b) AS v FROM {_F})"""


@query(_PIX + f"SELECT image_id, y, x, CAST(y0 AS DOUBLE) AS y0, CAST(u AS DOUBLE) AS u, CAST(v AS DOUBLE) AS v FROM {_ICT}")
def ict_forward(spark, sf_dir):
    p, s = _shifted(spark, sf_dir)
    return _out(p, [v.cast("double") for v in color.ict(*s)], ("y0", "u", "v"))


@query(_PIX + f"SELECT image_id, y, x, CAST(y0 + 1.402::FLOAT * v AS DOUBLE) AS r, CAST(y0 - (0.34413::FLOAT * u + 0.71414::FLOAT * v) AS DOUBLE) AS g, CAST(y0 + 1.772::FLOAT * u AS DOUBLE) AS b FROM {_ICT}")
def ict_inverse(spark, sf_dir):
    p, s = _shifted(spark, sf_dir)
    return _out(p, [v.cast("double") for v in color.ict_inverse(*color.ict(*s))], ("r", "g", "b"))


_FIX = lambda m, v: f"((({m}) * {v} + 4096) >> 13)"
_M = ((0.5, 0.25, 0.25), (1.0, -1.0, 0.0), (0.0, -0.75, 1.0))


@query(_PIX + "SELECT image_id, y, x, " + ", ".join("(" + " + ".join(_FIX(int(m * 8192), v) for m, v in zip(row, "rgb", strict=True)) + f")::BIGINT AS m{i}" for i, row in enumerate(_M)) + f" FROM {_S}")
def custom_mct(spark, sf_dir):
    p, s = _shifted(spark, sf_dir)
    return _out(p, color.matrix_transform(list(s), [list(r) for r in _M]), ("m0", "m1", "m2"))


@query(_PIX + """SELECT image_id, y, x, greatest(0, least(255, s0 + 128)) AS a, greatest(-128, least(127, s1)) AS b,
  CAST(greatest(0, least(255, round_even(CAST(s2 AS DOUBLE) / 4, 0) + 128)) AS BIGINT) AS c FROM pixels""")
def dc_shift_clamp(spark, sf_dir):
    p = pixels(spark, sf_dir, signed=True)
    return _out(p, (color.to_unsigned(F.col("c0")), color.to_unsigned(F.col("c1"), signed=True), color.to_unsigned_float(F.col("c2").cast("double") / 4)), "abc")


@query(_PIX + "SELECT image_id, y, x, CAST(trunc(s0 / 2.0) AS BIGINT) AS a, CAST(s1::FLOAT * (0.5::FLOAT * 0.375::FLOAT) AS DOUBLE) AS b FROM pixels")
def dequantise(spark, sf_dir):
    p = pixels(spark, sf_dir, signed=True)
    return _out(p, (color.dequantise(F.col("c0")), color.dequantise_float(F.col("c1"), 0.375).cast("double")), "ab")


@query(_PIX + "SELECT image_id, y, x, s0 * 64 AS a, CAST(round_even(CAST(s1::FLOAT * (64::FLOAT / 0.375::FLOAT) AS DOUBLE), 0) AS BIGINT) AS b FROM pixels")
def quantise_53(spark, sf_dir):
    p = pixels(spark, sf_dir, signed=True)
    return _out(p, (color.quantise(F.col("c0")), color.quantise_float(F.col("c1"), 0.375)), "ab")


@query(_PIX + "SELECT image_id, y, x, CASE WHEN abs(s0) >= (1 << (x % 6)) THEN CAST(sign(s0) AS BIGINT) * (abs(s0) >> (x % 6)) ELSE s0 END AS a FROM pixels")
def roi_descale(spark, sf_dir):
    p = pixels(spark, sf_dir, signed=True)
    return _out(p, (color.roi_descale(F.col("c0"), F.col("x") % 6),), "a")


_SYCC = """CAST(greatest(0, least(255, y0 + trunc(1.402::DOUBLE * (cr - 128)))) AS BIGINT) AS r,
  CAST(greatest(0, least(255, y0 - trunc(0.344::DOUBLE * (cb - 128) + 0.714::DOUBLE * (cr - 128)))) AS BIGINT) AS g,
  CAST(greatest(0, least(255, y0 + trunc(1.772::DOUBLE * (cb - 128)))) AS BIGINT) AS b"""


@query(_PIX + f"SELECT image_id, y, x, {_SYCC} FROM (SELECT image_id, y, x, c0 AS y0, c1 AS cb, c2 AS cr FROM pixels)")
def sycc444_rgb(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return _out(p, color.sycc_rgb(F.col("c0"), F.col("c1"), F.col("c2")), "rgb")


def _halved(spark, sf_dir, rows: int) -> DataFrame:
    p = pixels(spark, sf_dir)
    chroma = p.where(F.col("x") % 2 == 0).where(F.col("y") % rows == 0).select("image_id", e.div("y", F.lit(rows)).alias("cy"), e.div("x", F.lit(2)).alias("cx"), F.col("c1").alias("cb"), F.col("c2").alias("cr"))
    full = color.upsample(p.select("image_id", "y", "x", "c0"), chroma, rows)
    return _out(full, color.sycc_rgb(F.col("c0"), F.col("cb"), F.col("cr")), "rgb")


def _halved_sql(rows: int) -> str:
    return _PIX + f"SELECT image_id, y, x, {_SYCC} FROM (SELECT a.image_id, a.y, a.x, a.c0 AS y0, b.c1 AS cb, b.c2 AS cr FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND b.x = a.x - a.x % 2 AND b.y = a.y - a.y % {rows})"


@query(_halved_sql(1))
def sycc422_rgb(spark, sf_dir):
    return _halved(spark, sf_dir, 1)


@query(_halved_sql(2))
def sycc420_rgb(spark, sf_dir):
    return _halved(spark, sf_dir, 2)


@query(_PIX + """SELECT image_id, y, x, CAST(trunc((1::FLOAT - c0::FLOAT * q) * (255::FLOAT * k)) AS BIGINT) AS r, CAST(trunc((1::FLOAT - c1::FLOAT * q) * (255::FLOAT * k)) AS BIGINT) AS g,
  CAST(trunc((1::FLOAT - c2::FLOAT * q) * (255::FLOAT * k)) AS BIGINT) AS b
FROM (SELECT *, 1::FLOAT - ((c0 + c2) // 2)::FLOAT * q AS k FROM (SELECT *, 1::FLOAT / 255::FLOAT AS q FROM pixels))""")
def cmyk_rgb(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return _out(p, color.cmyk_rgb(F.col("c0"), F.col("c1"), F.col("c2"), e.div(F.col("c0") + F.col("c2"), F.lit(2))), "rgb")


@query(_PIX + """SELECT image_id, y, x,
  CAST(greatest(0, least(255, trunc(yy - 0.0000368::FLOAT * cb + 1.40199::FLOAT * cr + 0.5::FLOAT))) AS BIGINT) AS r,
  CAST(greatest(0, least(255, trunc(1.0003::FLOAT * yy - 0.344125::FLOAT * cb - 0.7141128::FLOAT * cr + 0.5::FLOAT))) AS BIGINT) AS g,
  CAST(greatest(0, least(255, trunc(0.999823::FLOAT * yy + 1.77204::FLOAT * cb - 0.000008::FLOAT * cr + 0.5::FLOAT))) AS BIGINT) AS b
FROM (SELECT image_id, y, x, c0::FLOAT AS yy, (c1 - 128)::FLOAT AS cb, (c2 - 128)::FLOAT AS cr FROM pixels)""")
def eycc_rgb(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return _out(p, color.eycc_rgb(F.col("c0"), F.col("c1"), F.col("c2")), "rgb")


@query(_PIX + """SELECT image_id, y, x, greatest(0, least(255, CASE WHEN d < 8 THEN v << (8 - d) ELSE v >> (d - 8) END)) AS a8, greatest(0, least(65535, v << (16 - d))) AS a16
FROM (SELECT image_id, y, x, c0 & ((1 << d) - 1) AS v, d FROM (SELECT *, 4 + x AS d FROM pixels))""")
def to_standard(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("d", 4 + F.col("x")).withColumn("v", F.col("c0").bitwiseAND(e.shift_left(F.lit(1), "d") - 1))
    return _out(p, (color.sample8(F.col("v"), F.col("d"), False), color.sample16(F.col("v"), F.col("d"), False)), ("a8", "a16"))


@query("""SELECT c_custkey AS px, channel, CASE WHEN channel = 3 THEN idx ELSE value END AS value
FROM (SELECT c_custkey, c_nationkey - 3 AS idx FROM customer), (SELECT unnest(range(4)) AS channel) LEFT JOIN
  (SELECT n_nationkey AS k, unnest(range(3)) AS col, n_regionkey * 40 + n_nationkey * (unnest(range(3)) + 1) AS value FROM nation)
ON k = greatest(0, least(24, idx)) AND col = channel""")
def palette_expand(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    palette = n.select(F.col("n_nationkey").cast("long").alias("idx"), F.posexplode(F.array(*(F.col("n_regionkey").cast("long") * 40 + F.col("n_nationkey") * (i + 1) for i in range(3)))).alias("pcol", "value")).withColumn("pcol", F.col("pcol").cast("long"))
    indexed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("px"), (F.col("c_nationkey").cast("long") - 3).alias("idx"))
    return color.palette_expand(indexed, palette, 25, [0, 1, 2, None])


@query(_PIX + "SELECT image_id, n, lo, hi FROM (SELECT image_id, compno, count(*) AS n, min(sv) AS lo, max(sv) AS hi FROM raster GROUP BY ALL) WHERE compno = 2")
def component_subset(spark, sf_dir):
    rows = planes(spark, sf_dir, signed=True).where("compno = 2").select("image_id", F.col("vals").alias("v"))
    return rows.select("image_id", F.size("v").cast("long").alias("n"), F.array_min("v").alias("lo"), F.array_max("v").alias("hi"))


_LAB = """SELECT image_id, y, x, (100.0::DOUBLE * c0 / 255 + 16) / 116 AS fy, (-(170.0::DOUBLE * 128) / 255 + 170.0::DOUBLE * c1 / 255) / 500 AS da, (-(200.0::DOUBLE * 96) / 255 + 200.0::DOUBLE * c2 / 255) / 200 AS db FROM pixels"""
_CUBE = "CASE WHEN {t} > 6.0::DOUBLE / 29 THEN {t} * {t} * {t} ELSE ({t} - 16.0::DOUBLE / 116) * 3 * (6.0::DOUBLE / 29) * (6.0::DOUBLE / 29) END * {w}::DOUBLE"
_LINEAR = ", ".join("X * ({})::DOUBLE + Y * ({})::DOUBLE + Z * ({})::DOUBLE AS l{}".format(*row, i) for i, row in enumerate(color.XYZ_RGB))
_CURVE = ", ".join(f"CAST(greatest(0, least(65535, floor((CASE WHEN l{i} <= 0 THEN 0 WHEN l{i} >= 1 THEN 1 WHEN l{i} <= 0.0031308 THEN 12.92::DOUBLE * l{i} ELSE 1.055::DOUBLE * pow(greatest(l{i}, 0), 1 / 2.4::DOUBLE) - 0.055::DOUBLE END) * 65535 + 0.5))) AS BIGINT) AS {n}" for i, n in enumerate("rgb"))


@query(_PIX + f"SELECT image_id, y, x, {_CURVE} FROM (SELECT image_id, y, x, {_LINEAR} FROM (SELECT image_id, y, x, {_CUBE.format(t='(fy + da)', w=0.9642)} AS X, {_CUBE.format(t='fy', w=1.0)} AS Y, {_CUBE.format(t='(fy - db)', w=0.8249)} AS Z FROM ({_LAB})))".replace(" AS X", " AS lx").replace(" AS Y", " AS ly").replace(" AS Z", " AS lz").replace("X * ", "lx * ").replace("Y * ", "ly * ").replace("Z * ", "lz * "))
def cielab_rgb(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return _out(p, color.lab_rgb((F.col("c0"), F.col("c1"), F.col("c2"))), "rgb")


# --- wavelets -----------------------------------------------------------------------------------------------------


def _lift_sql(src: str, out: str, axis: str, n: int) -> str:
    """CTEs that lift one axis of the low n x n corner by window functions."""
    other = "y" if axis == "x" else "x"
    w = f"WINDOW w AS (PARTITION BY image_id, compno, {other} ORDER BY {axis})"
    return f"""{out}_d AS MATERIALIZED (SELECT image_id, compno, y, x, CASE WHEN {axis} % 2 = 1 THEN v - ((lag(v) OVER w + coalesce(lead(v) OVER w, lag(v) OVER w)) >> 1) ELSE v END AS d FROM {src} WHERE x < {n} AND y < {n} {w}),
{out} AS MATERIALIZED (SELECT image_id, compno, {other}, CASE WHEN {axis} % 2 = 0 THEN {axis} // 2 ELSE {(n + 1) // 2} + {axis} // 2 END AS {axis},
  CASE WHEN {axis} % 2 = 0 THEN d + ((coalesce(lag(d) OVER w, lead(d) OVER w) + coalesce(lead(d) OVER w, lag(d) OVER w) + 2) >> 2) ELSE d END AS v FROM {out}_d {w}
  UNION ALL BY NAME SELECT image_id, compno, y, x, v FROM {src} WHERE NOT (x < {n} AND y < {n}))"""


_RAW = f"WITH {RASTER_SQL}, l0 AS MATERIALIZED (SELECT image_id, compno, y, x, sv AS v FROM raster)"
_LEVELS = _RAW + "".join(f", {_lift_sql(f'l{k}', f'c{k}', 'y', n)}, {_lift_sql(f'c{k}', f'l{k + 1}', 'x', n)}" for k, n in enumerate((8, 4, 2)))
_OUT = "SELECT image_id, compno, y, x, v FROM "


@query(_RAW + ", " + _lift_sql("l0", "r", "x", 8) + " " + _OUT + "r")
def dwt53_row(spark, sf_dir):
    return _samples(_whole(spark, sf_dir).withColumn("rows", F.transform("rows", wavelet.forward53)))


@query(_LEVELS + " " + _OUT + "l1")
def dwt53_2d(spark, sf_dir):
    return _samples(_whole(spark, sf_dir).withColumn("rows", wavelet.forward2d(F.col("rows"))))


@query(_LEVELS + " " + _OUT + "l3")
def dwt53_multilevel(spark, sf_dir):
    return _samples(wavelet.multilevel(_whole(spark, sf_dir), 8, 3))


@query(_RAW + " " + _OUT + "l0")
def idwt53_roundtrip(spark, sf_dir):
    return _samples(wavelet.inverse_multilevel(wavelet.multilevel(_whole(spark, sf_dir), 8, 3), 8, 3))


def _lift97_sql() -> str:
    w = "WINDOW w AS (PARTITION BY image_id, compno, y ORDER BY x)"
    step = lambda c, par: f"CASE WHEN x % 2 = {par} THEN v + (coalesce(lag(v) OVER w, lead(v) OVER w) + coalesce(lead(v) OVER w, lag(v) OVER w)) * ({c})::FLOAT ELSE v END"
    src = "(SELECT image_id, compno, y, x, sv::FLOAT AS v FROM raster)"
    for c, par in ((wavelet.ALPHA, 1), (wavelet.BETA, 0), (wavelet.GAMMA, 1), (wavelet.DELTA, 0)):
        src = f"(SELECT image_id, compno, y, x, {step(c, par)} AS v FROM {src} {w})"
    return f"SELECT image_id, compno, y, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 4 + x // 2 END AS x, round(CAST(v * (CASE WHEN x % 2 = 0 THEN {1 / wavelet.K} ELSE {wavelet.K} END)::FLOAT AS DOUBLE), 2) + 0.0::DOUBLE AS v FROM {src}"


@query(f"WITH {RASTER_SQL} " + _lift97_sql())
def dwt97_row(spark, sf_dir):
    rows = F.transform("rows", lambda r: wavelet.forward97(F.transform(r, lambda v: v.cast("float"))))
    return _samples(_whole(spark, sf_dir).withColumn("rows", rows)).withColumn("v", F.round(F.col("v").cast("double"), 2) + F.lit(0.0))


@query(_LEVELS + """ SELECT compno, CASE WHEN y < 4 AND x < 4 THEN 0 WHEN y < 4 THEN 1 WHEN x < 4 THEN 2 ELSE 3 END AS band, count(*) AS n, CAST(sum(v * v) AS BIGINT) AS energy, min(v) AS lo, max(v) AS hi
FROM (SELECT image_id, compno, y, x, v FROM l1) GROUP BY ALL""")
def subband_energy(spark, sf_dir):
    s = _samples(_whole(spark, sf_dir).withColumn("rows", wavelet.forward2d(F.col("rows"))))
    band = F.when((F.col("y") < 4) & (F.col("x") < 4), 0).when(F.col("y") < 4, 1).when(F.col("x") < 4, 2).otherwise(3)
    return s.groupBy("compno", band.cast("long").alias("band")).agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("energy"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query(_RAW + " SELECT image_id, compno, y - 2 AS y, x - 1 AS x, v FROM l0 WHERE y >= 2 AND y < 7 AND x >= 1 AND x < 6")
def region_equals_crop(spark, sf_dir):
    back = wavelet.inverse2d(wavelet.forward2d(F.col("rows")))
    return _samples(_whole(spark, sf_dir).withColumn("rows", F.transform(F.slice(back, 3, 5), lambda r: F.slice(r, 2, 5))))


# --- packets ------------------------------------------------------------------------------------------------------

_PACKETS = f"""WITH {GEOM_SQL},
pk AS (SELECT *, min(stepx) OVER t AS allx, min(stepy) OVER t AS ally, min(stepx) OVER c AS ownx, min(stepy) OVER c AS owny
  FROM (SELECT *, cdx * (1 << (pdx + lv)) AS stepx, cdy * (1 << (pdy + lv)) AS stepy FROM res WHERE pw * ph > 0)
  WINDOW t AS (PARTITION BY image_id, tileno), c AS (PARTITION BY image_id, tileno, compno)),
pp AS (SELECT *, greatest(ax0, ((((ax0 + (cdx << lv) - 1) // (cdx << lv)) >> pdx) + precno % pw << pdx) * (cdx << lv)) AS px,
    greatest(ay0, ((((ay0 + (cdy << lv) - 1) // (cdy << lv)) >> pdy) + precno // pw << pdy) * (cdy << lv)) AS py
  FROM (SELECT *, unnest(range(pw * ph)) AS precno FROM pk)),
packets AS (SELECT *, unnest(range(nlayers)) AS layno FROM pp)"""
_DIGEST = "SELECT image_id, tileno, count(*) AS n, CAST(sum(seq * (3 + compno * 7 + resno * 11 + precno * 13 + layno * 17)) AS BIGINT) AS digest FROM"


def _digest(p: DataFrame) -> DataFrame:
    return p.groupBy("image_id", "tileno").agg(F.count("*").alias("n"), F.sum(F.col("seq") * (3 + F.col("compno") * 7 + F.col("resno") * 11 + F.col("precno") * 13 + F.col("layno") * 17)).alias("digest"))


def _order_sql(order: str) -> str:
    keys = packets.ORDERS[order]
    x, y = ("ownx", "owny") if order == "cprl" else ("allx", "ally")
    on = f"WHERE (px = ax0 OR px % {x} = 0) AND (py = ay0 OR py % {y} = 0)" if "py" in keys else ""
    return f"{_PACKETS} {_DIGEST} (SELECT *, row_number() OVER (PARTITION BY image_id, tileno ORDER BY {', '.join(keys)}) - 1 AS seq FROM packets {on}) GROUP BY ALL"


def _packet_query(order: str):
    def f(spark, sf_dir):
        return _digest(packets.numbered(_res(spark, sf_dir), order))

    f.__name__ = f"packets_{order}"
    return query(_order_sql(order))(f)


for _o in packets.ORDERS:
    _packet_query(_o)


def _poc_sql() -> str:
    parts = [f"SELECT *, {k} AS pino, [{', '.join(packets.ORDERS[o])}] AS key FROM packets WHERE resno >= {r0} AND resno < {r1} AND compno >= {c0} AND compno < {c1} AND layno < {n}" for k, r0, r1, c0, c1, n, o in packets.CHANGES]
    return f"""{_PACKETS}, u AS ({' UNION ALL '.join(parts)}),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY image_id, tileno, compno, resno, precno, layno ORDER BY pino, key) = 1)
{_DIGEST} (SELECT *, row_number() OVER (PARTITION BY image_id, tileno ORDER BY pino, key) - 1 AS seq FROM o) GROUP BY ALL"""


@query(_poc_sql())
def packets_poc(spark, sf_dir):
    return _digest(packets.changed(packets.packets(_res(spark, sf_dir))))


@query(f"{_PACKETS} SELECT image_id, tileno, layno, count(*) AS n FROM packets WHERE layno < 2 GROUP BY ALL")
def layer_truncate(spark, sf_dir):
    return packets.packets(_res(spark, sf_dir)).where("layno < 2").groupBy("image_id", "tileno", "layno").agg(F.count("*").alias("n"))


# --- rate ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {PASSES_SQL} SELECT cblk, passno, dr, dd, CASE WHEN dr <> 0 THEN CAST(dd AS DOUBLE) / dr END AS slope
FROM (SELECT *, rate - coalesce(lag(rate) OVER w, 0) AS dr, dist - coalesce(lag(dist) OVER w, 0) AS dd FROM passes WINDOW w AS (PARTITION BY cblk ORDER BY passno))""")
def pass_slopes(spark, sf_dir):
    return rate.slopes(passes(spark, sf_dir)).select("cblk", "passno", "dr", "dd", "slope")


@query(f"""WITH {PASSES_SQL}, f AS (SELECT cblk, passno, min(rate - (passno * 7) % 5) OVER (PARTITION BY cblk ORDER BY passno ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fixed FROM passes)
SELECT cblk, passno, fixed, fixed - coalesce(lag(fixed) OVER (PARTITION BY cblk ORDER BY passno), 0) AS len FROM f""")
def pass_rate_repair(spark, sf_dir):
    p = passes(spark, sf_dir).withColumn("rough", F.col("rate") - (F.col("passno") * 7) % 5)
    return rate.repaired(p, "rough").select("cblk", "passno", "fixed", "len")


@query(f"""WITH RECURSIVE {PASSES_SQL},
walk AS (SELECT cblk, CAST(-1 AS BIGINT) AS step, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS rate, CAST(0 AS BIGINT) AS dist FROM passes WHERE passno = 0
  UNION ALL SELECT w.cblk, p.passno, CASE WHEN t THEN p.passno + 1 ELSE w.taken END, CASE WHEN t THEN p.rate ELSE w.rate END, CASE WHEN t THEN p.dist ELSE w.dist END
  FROM walk w JOIN passes p ON p.cblk = w.cblk AND p.passno = w.step + 1,
    LATERAL (SELECT CASE WHEN p.rate = w.rate THEN p.dist <> w.dist ELSE 3000.0::DOUBLE - CAST(p.dist - w.dist AS DOUBLE) / (p.rate - w.rate) < 2.2e-16 END AS t))
SELECT cblk, taken, rate, dist FROM walk QUALIFY row_number() OVER (PARTITION BY cblk ORDER BY step DESC) = 1""")
def layer_alloc_greedy(spark, sf_dir):
    return rate.greedy(passes(spark, sf_dir), 3000.0)


@query(f"""WITH {PASSES_SQL} SELECT cblk, passno, CAST(least(passno // greatest(n // 3, 1), 2) AS BIGINT) AS layno FROM (SELECT *, count(*) OVER (PARTITION BY cblk) AS n FROM passes)""")
def layer_alloc_fixed(spark, sf_dir):
    return rate.fixed_layers(passes(spark, sf_dir), 3).select("cblk", "passno", "layno")


@query(f"""WITH {PASSES_SQL} SELECT cblk % 16 AS tile, CAST(sum(ddist) AS BIGINT) AS dist, CAST(sum(ddist) AS DOUBLE) - 65025.0 * count(*) / pow(10.0, 3.0) AS target FROM passes GROUP BY 1""")
def distortion_total(spark, sf_dir):
    p = passes(spark, sf_dir).groupBy((F.col("cblk") % 16).alias("tile")).agg(F.sum("ddist").alias("dist"), F.count("*").alias("n"))
    return p.select("tile", "dist", rate.distortion_target(F.col("dist").cast("double"), F.lit(65025.0) * F.col("n"), 30.0).alias("target"))


@query(f"""WITH {PASSES_SQL} SELECT cblk, passno, layno, CAST(sum(ddist) OVER (PARTITION BY cblk ORDER BY layno RANGE UNBOUNDED PRECEDING) AS BIGINT) AS cumulative
FROM (SELECT *, passno % 3 AS layno FROM passes)""")
def layer_distortion_running(spark, sf_dir):
    w = Window.partitionBy("cblk").orderBy("layno").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return passes(spark, sf_dir).withColumn("layno", F.col("passno") % 3).select("cblk", "passno", "layno", F.sum("ddist").over(w).alias("cumulative"))


# --- headers and files --------------------------------------------------------------------------------------------


@query(f"WITH {GEOM_SQL} SELECT image_id, 'j2k' AS format, x0, y0, x1, y1, tdx, tdy, numcomps, prec, (x1 - tx0 + tdx - 1) // tdx AS tw, (y1 - ty0 + tdy - 1) // tdy AS th FROM geom")
def header_info(spark, sf_dir):
    g = geom(spark, sf_dir)
    s = e.once(g.select("image_id", headers.codestream_header(g).alias("made")), "content", F.col("made"))
    s = e.once(s, "siz", F.filter(headers.segments(F.col("content")), lambda m: m["code"] == headers.SIZ)[0])
    f = s.select("image_id", headers.sniff(F.col("content")).alias("format"), *headers.siz_fields(F.col("content"), F.col("siz")))
    return f.select("image_id", "format", "x0", "y0", "x1", "y1", "tdx", "tdy", "numcomps", "prec", e.ceil_div(F.col("x1") - F.col("tx0"), "tdx").alias("tw"), e.ceil_div(F.col("y1") - F.col("ty0"), "tdy").alias("th"))


@query(f"""WITH {GEOM_SQL}, s AS (SELECT image_id, unnest([{{'nth': 0, 'code': 'FF51', 'len': 38 + 3 * numcomps}}, {{'nth': 1, 'code': 'FF52', 'len': 12}}, {{'nth': 2, 'code': 'FF5C', 'len': 3 + 3 * numres - 2}}]) AS m FROM geom)
SELECT image_id, CAST(m.nth AS BIGINT) AS nth, m.code AS code, CAST(m.len AS BIGINT) AS len FROM s""")
def marker_segments(spark, sf_dir):
    g = geom(spark, sf_dir)
    s = e.once(g.select("image_id", headers.codestream_header(g).alias("made")), "content", F.col("made"))
    s = s.select("image_id", F.posexplode(headers.segments(F.col("content"))).alias("nth", "m"))
    return s.select("image_id", F.col("nth").cast("long").alias("nth"), "m.code", "m.len")


@query(f"""WITH {GEOM_SQL}, s AS (SELECT image_id, 2 + 40 + 3 * numcomps + 14 + 3 + 3 * numres + 2 AS n FROM geom),
b AS (SELECT image_id, unnest([{{'o': 0, 'l': 12, 't': 'jP  '}}, {{'o': 12, 'l': 20, 't': 'ftyp'}}, {{'o': 32, 'l': 45, 't': 'jp2h'}}, {{'o': 77, 'l': 8 + n, 't': 'jp2c'}}, {{'o': 40, 'l': 22, 't': 'ihdr'}}, {{'o': 62, 'l': 15, 't': 'colr'}}]) AS b FROM s)
SELECT image_id, CAST(b.o AS BIGINT) AS off, CAST(b.l AS BIGINT) AS len, b.t AS type FROM b""")
def jp2_box_walk(spark, sf_dir):
    g = geom(spark, sf_dir)
    s = e.once(g.select("image_id", headers.boxed_header(headers.codestream_header(g), F.col("prec")).alias("made")), "content", F.col("made"))
    s = e.once(s, "top", headers.boxes(F.col("content"), F.lit(0), F.octet_length("content")))
    inner = F.filter("top", lambda b: b["type"] == "jp2h")[0]
    s = e.once(s, "sub", headers.boxes(F.col("content"), inner["off"] + 8, inner["off"] + inner["len"]))
    return s.select("image_id", F.explode(F.concat("top", "sub")).alias("b")).select("image_id", "b.off", "b.len", "b.type")


@query(_PIX + "SELECT image_id, compno, y, x, greatest(0, least(255, sv + 128)) AS v FROM raster")
def pnm_roundtrip(spark, sf_dir):
    p = _whole(spark, sf_dir, signed=False).select("image_id", "compno", headers.graymap(F.col("rows")).alias("content"))
    return p.select("image_id", "compno", F.explode(headers.read_graymap(F.col("content"))).alias("s")).select("image_id", "compno", "s.y", "s.x", "s.v")


@query(_PIX + "SELECT image_id, compno, y, x, sv AS v FROM raster")
def raw_roundtrip(spark, sf_dir):
    p = _whole(spark, sf_dir).select("image_id", "compno", headers.raw_plane(F.col("rows"), 12).alias("content"))
    return p.select("image_id", "compno", F.explode(headers.read_raw(F.col("content"), 8, 12, True)).alias("s")).select("image_id", "compno", "s.y", "s.x", "s.v")


@query("SELECT user_id AS tile, count(*) AS parts, string_agg(event_type, '' ORDER BY event_id) AS data FROM events GROUP BY 1")
def tilepart_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("tile")).agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("p"))
    return parts.select("tile", "parts", F.array_join(F.transform("p", lambda p: p["event_type"]), "").alias("data"))


# --- channel definitions and profiles -----------------------------------------------------------------------------


@query(f"""WITH {GEOM_SQL}, want AS (SELECT image_id, unnest(range(numcomps)) AS cn FROM geom),
defs AS (SELECT image_id, (i + image_id) % numcomps * (1 - image_id % 2) AS cn FROM (SELECT *, unnest(range(numcomps)) AS i FROM geom)),
n AS (SELECT image_id, cn, count(*) AS n FROM defs GROUP BY ALL)
SELECT image_id, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated FROM want LEFT JOIN n USING (image_id, cn) GROUP BY 1""")
def cdef_validate(spark, sf_dir):
    g = geom(spark, sf_dir)
    defs = g.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("numcomps") - 1))).select("image_id", ((F.col("i") + F.col("image_id")) % F.col("numcomps") * (1 - F.col("image_id") % 2)).alias("cn"))
    return colormeta.channels_complete(defs, g.select("image_id", "numcomps"))


_ORDERS = {0: (0, 1, 2), 1: (1, 0, 2), 2: (2, 1, 0), 3: (0, 2, 1), 4: (1, 2, 0), 5: (2, 0, 1)}
#: Component order after the definitions "component c is channel _ORDERS[k][c] + 1", worked out by hand.
_AFTER = {0: "0,1,2", 1: "1,0,2", 2: "2,1,0", 3: "0,2,1", 4: "2,0,1", 5: "1,2,0"}


@query(f"""WITH {GEOM_SQL} SELECT image_id, CASE image_id % 6 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _AFTER.items())} END AS components FROM geom""")
def cdef_permute(spark, sf_dir):
    g = geom(spark, sf_dir).select("image_id")
    pick = F.lit(None).cast("array<struct<cn:bigint,asoc:bigint>>")
    for k, order in _ORDERS.items():
        defs = F.array(*(F.struct(F.lit(c).cast("long").alias("cn"), F.lit(o + 1).cast("long").alias("asoc")) for c, o in enumerate(order)))
        pick = F.when(F.col("image_id") % 6 == k, defs).otherwise(pick)
    return g.withColumn("defs", pick).select("image_id", F.array_join(colormeta.channel_order(F.col("defs"), F.lit(3).cast("long")).cast("array<string>"), ",").alias("components"))


@query(f"""WITH {GEOM_SQL} SELECT image_id, main <= 11 AND sub <= [{', '.join(map(str, (15, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9)))}][least(main, 11) + 1] AS levels, numcomps <= 3 AS components, x0 = 0 AND y0 = 0 AS origin, tdx >= x1 - x0 AND tdy >= y1 - y0 AS tile,
  prec BETWEEN 8 AND 16 AS precision, dx IN (1, 2) AND dy = 1 AS sampling, x1 - x0 <= 2048 AND y1 - y0 <= 1556 AS size, cblkw = 5 AND cblkh = 5 AS blocks, nlayers = 1 AS layers
FROM (SELECT *, image_id % 13 AS main, image_id % 4 AS sub FROM geom)""")
def imf_compliance(spark, sf_dir):
    g = geom(spark, sf_dir)
    return g.select("image_id", *(c.alias(n) for n, c in colormeta.imf_rules(F.col("image_id") % 13, F.col("image_id") % 4).items()))


@query(f"""WITH {GEOM_SQL} SELECT image_id, cap, least(numres, 6) AS numres, CAST(5 AS BIGINT) AS cblk, CAST(CASE WHEN numres = 1 THEN 7 ELSE 8 END AS BIGINT) AS precinct,
  CAST(numcomps * (x1 - x0) * (y1 - y0) * prec AS DOUBLE) / CAST(cap * 8 AS DOUBLE) AS rate FROM (SELECT *, CAST(CASE WHEN image_id % 2 = 1 THEN 651041 ELSE 1302083 END AS BIGINT) AS cap FROM geom)""")
def cinema_coercion(spark, sf_dir):
    g = geom(spark, sf_dir)
    return g.select("image_id", *(c.alias(n) for n, c in colormeta.cinema_settings(F.col("image_id") % 2 == 1).items()))


# --- streams ------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a stream reads folders or patterns
    return ingest.run_once(spark, ingest.windowed_counts(stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), late="3650 days"), ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- option strings -----------------------------------------------------------------------------------------------


@query(f"WITH {GEOM_SQL} SELECT image_id, x1 - x0 AS w, y1 - y0 AS h, numcomps AS n, prec AS depth, image_id % 2 = 1 AS signed, numcomps AS steps, 1 + dx * (numcomps - 1) AS across, tdx AS pw, tdy AS ph, CAST(prec + 0.5 AS DOUBLE) AS rate FROM geom")
def option_strings(spark, sf_dir):
    g = geom(spark, sf_dir)
    step = F.transform(F.sequence(F.lit(0).cast("long"), F.col("numcomps") - 1), lambda c: F.concat(F.when(c == 0, F.lit(1)).otherwise(F.col("dx")).cast("string"), F.lit("x"), F.col("dy").cast("string")))
    text = F.concat_ws(",", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), "numcomps", "prec", F.when(F.col("image_id") % 2 == 1, "s").otherwise("u"))
    s = g.select("image_id", F.concat(text, F.lit("@"), F.array_join(step, ":")).alias("raw"), F.concat(F.lit("[64,64],["), F.col("tdx"), F.lit(" , "), F.col("tdy"), F.lit("]")).alias("list"), F.concat(F.lit("1, "), F.col("prec") + F.lit(0.5)).alias("rates"))
    s = s.select("image_id", *options.raw_geometry(F.col("raw")), F.get(options.pairs(F.col("list")), F.lit(1)).alias("p"), F.get(options.numbers(F.col("rates")), F.lit(1)).alias("rate"))
    return s.select("image_id", "w", "h", "n", "depth", "signed", F.size("sampling").cast("long").alias("steps"), F.aggregate("sampling", F.lit(0).cast("long"), lambda a, x: a + x["dx"]).alias("across"), F.col("p.w").alias("pw"), F.col("p.h").alias("ph"), "rate")


from . import checks, colours, files, layout, output, parameters, rasterfiles, tiles  # noqa: E402, F401  (they register their queries)
