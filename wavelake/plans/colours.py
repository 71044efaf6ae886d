"""Registered queries on colour: odd origins, given ranges, component maps, the order of the steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as e
from ..operators import color, colormeta
from .fixtures import GEOM_SQL, RASTER_SQL, pixels, planes, table
from .fixtures import geometry as geom
from .registry import query

_PIX = f"WITH {RASTER_SQL} "
_SYCC = """CAST(greatest(0, least(255, y0 + trunc(1.402::DOUBLE * (cr - 128)))) AS BIGINT) AS r,
  CAST(greatest(0, least(255, y0 - trunc(0.344::DOUBLE * (cb - 128) + 0.714::DOUBLE * (cr - 128)))) AS BIGINT) AS g,
  CAST(greatest(0, least(255, y0 + trunc(1.772::DOUBLE * (cb - 128)))) AS BIGINT) AS b"""


def _odd(spark, sf_dir, rows: int) -> DataFrame:
    p = pixels(spark, sf_dir)
    chroma = p.where((F.col("x") % 2 == 0) & (F.col("y") % rows == 0)).select("image_id", e.div("y", F.lit(rows)).alias("cy"), e.div("x", F.lit(2)).alias("cx"), F.col("c1").alias("cb"), F.col("c2").alias("cr"))
    luma = p.select("image_id", "y", "x", "c0", (F.col("image_id") % 2).alias("x0"), (e.div("image_id", F.lit(2)) % 2).alias("y0"))
    full = color.upsample_from(luma, chroma, rows)
    return full.select("image_id", "y", "x", *(v.alias(n) for v, n in zip(color.sycc_rgb(F.col("c0"), F.col("cb"), F.col("cr")), "rgb", strict=True)))


def _odd_sql(rows: int) -> str:
    # the chroma of column x is that of pixel 2 * ((x - ox) // 2), and likewise for rows
    oy = "(a.image_id // 2) % 2" if rows == 2 else "0"
    cy = f"{rows} * ((a.y - {oy}) // {rows})"
    first = f"a.x < a.image_id % 2 AND NOT ({rows} = 2 AND (a.y - {oy}) % 2 = 1)"
    return _PIX + f"""SELECT image_id, y, x, {_SYCC} FROM (SELECT a.image_id, a.y, a.x, a.c0 AS y0, CASE WHEN a.y < {oy} OR {first} THEN 0 ELSE coalesce(b.c1, 0) END AS cb, CASE WHEN a.y < {oy} OR {first} THEN 0 ELSE coalesce(b.c2, 0) END AS cr
FROM pixels a LEFT JOIN pixels b ON a.image_id = b.image_id AND b.x = 2 * (greatest(a.x - a.image_id % 2, 0) // 2) AND b.y = {cy})"""


@query(_odd_sql(1))
def sycc422_odd_origin(spark, sf_dir):
    return _odd(spark, sf_dir, 1)


@query(_odd_sql(2))
def sycc420_odd_origin(spark, sf_dir):
    return _odd(spark, sf_dir, 2)


@query(_PIX + "SELECT image_id, y, x, greatest(0, least(255, sv + 128)) AS r, greatest(0, least(255, sv + 128)) AS g, greatest(0, least(255, sv + 128)) AS b FROM raster WHERE compno = 0")
def gray_rgb(spark, sf_dir):
    p = planes(spark, sf_dir).where("compno = 0").select("image_id", F.posexplode("vals").alias("i", "v"))
    return p.select("image_id", e.div("i", F.lit(8)).alias("y"), (F.col("i") % 8).cast("long").alias("x"), *(F.col("v").alias(n) for n in "rgb"))


_RANGES, _OFFSETS = (90.0, 160.0, 180.0), (2.0, 120.0, 100.0)
_L, _A, _B = (f"(-({r}::DOUBLE * {o}) / 255 + {r}::DOUBLE * c{i} / 255)" for i, (r, o) in enumerate(zip(_RANGES, _OFFSETS, strict=True)))
_CUBE = "CASE WHEN {t} > 6.0::DOUBLE / 29 THEN {t} * {t} * {t} ELSE ({t} - 16.0::DOUBLE / 116) * 3 * (6.0::DOUBLE / 29) * (6.0::DOUBLE / 29) END * {w}::DOUBLE"
_LINEAR = ", ".join("lx * ({})::DOUBLE + ly * ({})::DOUBLE + lz * ({})::DOUBLE AS l{}".format(*row, i) for i, row in enumerate(color.XYZ_RGB))
_CURVE = ", ".join(f"CAST(greatest(0, least(65535, floor((CASE WHEN l{i} <= 0 THEN 0 WHEN l{i} >= 1 THEN 1 WHEN l{i} <= 0.0031308 THEN 12.92::DOUBLE * l{i} ELSE 1.055::DOUBLE * pow(greatest(l{i}, 0), 1 / 2.4::DOUBLE) - 0.055::DOUBLE END) * 65535 + 0.5))) AS BIGINT) AS {n}" for i, n in enumerate("rgb"))


@query(_PIX + f"""SELECT image_id, y, x, {_CURVE} FROM (SELECT image_id, y, x, {_LINEAR} FROM (SELECT image_id, y, x, {_CUBE.format(t='(fy + da)', w=0.9642)} AS lx, {_CUBE.format(t='fy', w=1.0)} AS ly, {_CUBE.format(t='(fy - db)', w=0.8249)} AS lz
FROM (SELECT image_id, y, x, ({_L} + 16) / 116 AS fy, {_A} / 500 AS da, {_B} / 200 AS db FROM pixels)))""")
def cielab_given_ranges(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return p.select("image_id", "y", "x", *(v.alias(n) for v, n in zip(color.lab_rgb((F.col("c0"), F.col("c1"), F.col("c2")), ranges=_RANGES, offsets=_OFFSETS), "rgb", strict=True)))


@query("""WITH m AS (SELECT p_partkey AS image_id, 1 + p_partkey % 3 AS numcomps, 1 + p_size % 3 AS channels, unnest(range(1 + p_size % 3)) AS i FROM part),
c AS (SELECT *, CASE WHEN image_id % 4 = 0 THEN i ELSE 0 END AS cmp, CASE WHEN image_id % 7 = 0 THEN 2 WHEN image_id % 5 = 1 THEN 0 ELSE 1 END AS mtyp, CASE WHEN image_id % 5 = 1 THEN 0 WHEN image_id % 6 = 0 THEN 1 ELSE i END AS pcol FROM m),
f AS (SELECT *, pcol < channels AND CASE mtyp WHEN 0 THEN pcol = 0 WHEN 1 THEN pcol = i ELSE false END AS fits FROM c),
a AS (SELECT image_id, numcomps, channels, count(*) FILTER (cmp >= numcomps) AS bad_component, count(*) FILTER (NOT fits) AS bad_mapping, count(DISTINCT pcol) FILTER (fits) AS used FROM f GROUP BY ALL),
u AS (SELECT image_id, count(*) AS unmapped FROM f WHERE mtyp <> 0 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.image_id = f.image_id AND g.fits AND g.pcol = f.i) GROUP BY 1)
SELECT image_id, bad_component, bad_mapping, coalesce(unmapped, 0) AS unmapped, bad_component + bad_mapping + coalesce(unmapped, 0) = 0 AND numcomps = 1 AND used < channels AS replaced, bad_component + bad_mapping + coalesce(unmapped, 0) = 0 AS usable FROM a LEFT JOIN u USING (image_id)""")
def component_maps(spark, sf_dir):
    k = F.col("image_id")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (1 + F.col("p_partkey") % 3).alias("numcomps"), (1 + F.col("p_size") % 3).cast("long").alias("channels"))
    m = p.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("channels") - 1)))
    m = m.withColumns({"cmp": F.when(k % 4 == 0, F.col("i")).otherwise(0), "mtyp": F.when(k % 7 == 0, 2).when(k % 5 == 1, 0).otherwise(1), "pcol": F.when(k % 5 == 1, 0).when(k % 6 == 0, 1).otherwise(F.col("i")).cast("long")})
    return colormeta.component_map_check(m)


@query(f"""WITH {GEOM_SQL} SELECT image_id, CASE WHEN image_id % 5 = 0 THEN '' WHEN image_id % 7 = 0 THEN 'error' ELSE 'check' || CASE WHEN image_id % 6 = 0 THEN '+palette' ELSE '' END || CASE WHEN numcomps > 1 THEN '+channels' ELSE '' END END AS steps,
  CASE WHEN numres < 2 THEN 1 ELSE least(numres + image_id % 6, 7) END AS cinema FROM (SELECT image_id, numcomps, numres FROM geom)""")
def colour_step_order(spark, sf_dir):
    k = F.col("image_id")
    g = geom(spark, sf_dir)
    steps = colormeta.colour_pipeline(k % 5 == 0, F.col("numcomps") > 1, k % 2 == 0, k % 3 == 0, k % 7 != 0)
    return g.select("image_id", steps.alias("steps"), colormeta.cinema4k_resolutions(F.when(F.col("numres") < 2, F.col("numres")).otherwise(F.col("numres") + k % 6)).alias("cinema"))


@query("""SELECT p_partkey AS k, CASE WHEN w <= 2048 AND h <= 1556 THEN '2k' WHEN w <= 4096 AND h <= 3112 THEN '4k' WHEN w <= 8192 AND h <= 6224 THEN '8k' ELSE 'none' END AS class,
  n = 3 AS components, d = 12 AND p_partkey % 5 <> 0 AS precision, CASE WHEN p_partkey % 2 = 1 THEN w <= 4096 AND h <= 2160 ELSE w <= 2048 AND h <= 1080 END AS size
FROM (SELECT p_partkey, (p_partkey * 797) % 9000 AS w, (p_partkey * 389) % 7000 AS h, 1 + p_partkey % 4 AS n, 10 + p_size % 4 AS d FROM part)""")
def delivery_classes(spark, sf_dir):
    k = F.col("p_partkey")
    w, h = (k * 797) % 9000, (k * 389) % 7000
    p = table(spark, sf_dir, "part")
    rules = colormeta.cinema_rules(1 + k % 4, 10 + F.col("p_size") % 4, k % 5 == 0, w, h, k % 2 == 1)
    return p.select(k.alias("k"), F.coalesce(colormeta.imf_size_class(w, h), F.lit("none")).alias("class"), *(c.alias(n) for n, c in rules.items()))
