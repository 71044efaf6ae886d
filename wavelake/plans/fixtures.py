"""Raster, geometry and pass relations that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Images that a task gets at most, about.
IMAGES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planes(spark: SparkSession, sf_dir: str, signed: bool = False) -> DataFrame:
    """(image_id, compno, vals array<long>): one 8 x 8 plane in each row of embeddings, three to an image; the last image
    may have one or two."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 3").alias("image_id"), (F.col("vec_id") % 3).alias("compno"), "embedding")
    level = lambda f: F.floor(f.cast("double") * 255).cast("long")
    vals = F.transform("embedding", level if signed else lambda f: F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), level(f) + 128)))
    return e.select("image_id", "compno", vals.alias("vals"))


def pictures(spark: SparkSession, sf_dir: str, signed: bool = False) -> DataFrame:
    """(image_id, planes array<array<long>>): the images of three planes, for what needs three."""
    rows = planes(spark, sf_dir, signed).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("compno", "vals"))).alias("p"))
    return rows.where(F.size("p") == 3).select("image_id", F.transform("p", lambda p: p["vals"]).alias("planes"))


def pixels(spark: SparkSession, sf_dir: str, signed: bool = False) -> DataFrame:
    """(image_id, y, x, c0, c1, c2)."""
    zipped = F.arrays_zip(*(F.col("planes")[i].alias(f"c{i}") for i in range(3)))
    rows = pictures(spark, sf_dir, signed).select("image_id", F.posexplode(zipped).alias("i", "s"))
    return rows.select("image_id", F.expr("cast(i div 8 as bigint)").alias("y"), (F.col("i") % 8).cast("long").alias("x"), *(F.col(f"s.c{i}") for i in range(3)))


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image and coding geometry for each part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"))
    k, s = F.col("k"), F.col("s")
    out = p.select(
        k.alias("image_id"), (k % 7).alias("x0"), (k % 5).alias("y0"), (k % 7 + 8 + s * 5).alias("x1"), (k % 5 + 8 + s * 3).alias("y1"),
        (32 + s % 33).alias("tdx"), (32 + k % 33).alias("tdy"), F.lit(0).cast("long").alias("tx0"), F.lit(0).cast("long").alias("ty0"),
        (1 + k % 3).alias("numcomps"), (1 + k % 2).alias("dx"), (1 + F.expr("k div 2") % 2).alias("dy"), (8 + k % 5).alias("prec"),
        (1 + s % 4).alias("numres"), (2 + k % 4).alias("cblkw"), (2 + s % 4).alias("cblkh"), (3 + s % 4).alias("pdx"), (3 + k % 4).alias("pdy"), (1 + s % 3).alias("nlayers"),
    )
    # an image grows to thousands of rows: images are spread before that, whatever the number of input splits, and so that a
    # task's images do not grow with the table (the count reads footers only)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), p.count() // IMAGES)
    return out.withColumn("reduce", F.col("image_id") % F.col("numres")).repartition(tasks, "image_id")


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cblk, passno, drate, ddist, rate, dist): coding passes of a code-block for each order."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cblk"), (F.row_number().over(w) - 1).cast("long").alias("passno"), (F.col("l_quantity").cast("long") % 20).alias("drate"), F.floor("l_extendedprice").cast("long").alias("ddist"))
    run = Window.partitionBy("cblk").orderBy("passno").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("*", F.sum("drate").over(run).alias("rate"), F.sum("ddist").over(run).alias("dist"))


# --- the same in DuckDB -------------------------------------------------------------------------------------------

RASTER_SQL = """raster AS (
  SELECT vec_id // 3 AS image_id, vec_id % 3 AS compno, (i - 1) // 8 AS y, (i - 1) % 8 AS x,
    CAST(floor(CAST(f AS DOUBLE) * 255) AS BIGINT) AS sv
  FROM (SELECT vec_id, unnest(embedding) AS f, generate_subscripts(embedding, 1) AS i FROM embeddings)),
pixels AS (
  SELECT image_id, y, x, max(v) FILTER (compno = 0) AS c0, max(v) FILTER (compno = 1) AS c1, max(v) FILTER (compno = 2) AS c2,
    max(sv) FILTER (compno = 0) AS s0, max(sv) FILTER (compno = 1) AS s1, max(sv) FILTER (compno = 2) AS s2
  FROM (SELECT *, greatest(0, least(255, sv + 128)) AS v FROM raster) GROUP BY 1, 2, 3 HAVING count(*) = 3)"""

GEOM_SQL = """geom AS (
  SELECT p_partkey AS image_id, p_partkey % 7 AS x0, p_partkey % 5 AS y0, p_partkey % 7 + 8 + p_size * 5 AS x1,
    p_partkey % 5 + 8 + p_size * 3 AS y1, 32 + p_size % 33 AS tdx, 32 + p_partkey % 33 AS tdy, 0 AS tx0, 0 AS ty0,
    1 + p_partkey % 3 AS numcomps, 1 + p_partkey % 2 AS dx, 1 + (p_partkey // 2) % 2 AS dy, 8 + p_partkey % 5 AS prec,
    1 + p_size % 4 AS numres, 2 + p_partkey % 4 AS cblkw, 2 + p_size % 4 AS cblkh, 3 + p_size % 4 AS pdx,
    3 + p_partkey % 4 AS pdy, 1 + p_size % 3 AS nlayers, p_partkey % (1 + p_size % 4) AS reduce
  FROM part),
tiles AS (
  SELECT *, tileno % tw AS p, tileno // tw AS q, greatest(tx0 + (tileno % tw) * tdx, x0) AS ax0, greatest(ty0 + (tileno // tw) * tdy, y0) AS ay0,
    least(tx0 + (tileno % tw + 1) * tdx, x1) AS ax1, least(ty0 + (tileno // tw + 1) * tdy, y1) AS ay1
  FROM (SELECT *, unnest(range(tw * th)) AS tileno FROM (SELECT *, (x1 - tx0 + tdx - 1) // tdx AS tw, (y1 - ty0 + tdy - 1) // tdy AS th FROM geom))),
tile_comps AS (
  SELECT *, (ax0 + cdx - 1) // cdx AS cx0, (ay0 + cdy - 1) // cdy AS cy0, (ax1 + cdx - 1) // cdx AS cx1, (ay1 + cdy - 1) // cdy AS cy1
  FROM (SELECT *, CASE WHEN compno = 0 THEN 1 ELSE dx END AS cdx, CASE WHEN compno = 0 THEN 1 ELSE dy END AS cdy FROM (SELECT *, unnest(range(numcomps)) AS compno FROM tiles))),
res AS (
  SELECT *, CASE WHEN rx0 = rx1 THEN 0 ELSE ((rx1 + (1 << pdx) - 1) >> pdx) - (rx0 >> pdx) END AS pw,
    CASE WHEN ry0 = ry1 THEN 0 ELSE ((ry1 + (1 << pdy) - 1) >> pdy) - (ry0 >> pdy) END AS ph
  FROM (SELECT *, (cx0 + (1 << lv) - 1) >> lv AS rx0, (cy0 + (1 << lv) - 1) >> lv AS ry0, (cx1 + (1 << lv) - 1) >> lv AS rx1, (cy1 + (1 << lv) - 1) >> lv AS ry1
    FROM (SELECT *, numres - 1 - resno AS lv FROM (SELECT *, unnest(range(numres)) AS resno FROM tile_comps)))),
bands AS (
  SELECT *, CASE WHEN resno = 0 THEN rx0 ELSE (cx0 - ((1 << (nb - 1)) * xob) + (1 << nb) - 1) >> nb END AS bx0,
    CASE WHEN resno = 0 THEN ry0 ELSE (cy0 - ((1 << (nb - 1)) * yob) + (1 << nb) - 1) >> nb END AS by0,
    CASE WHEN resno = 0 THEN rx1 ELSE (cx1 - ((1 << (nb - 1)) * xob) + (1 << nb) - 1) >> nb END AS bx1,
    CASE WHEN resno = 0 THEN ry1 ELSE (cy1 - ((1 << (nb - 1)) * yob) + (1 << nb) - 1) >> nb END AS by1
  FROM (SELECT *, bandno % 2 AS xob, bandno // 2 AS yob, greatest(numres - resno, 1) AS nb
    FROM (SELECT *, unnest(CASE WHEN resno = 0 THEN [0] ELSE [1, 2, 3] END) AS bandno FROM res)))"""

PASSES_SQL = """passes AS (
  SELECT *, CAST(sum(drate) OVER w AS BIGINT) AS rate, CAST(sum(ddist) OVER w AS BIGINT) AS dist
  FROM (SELECT l_orderkey AS cblk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS passno,
    CAST(l_quantity AS BIGINT) % 20 AS drate, CAST(floor(l_extendedprice) AS BIGINT) AS ddist FROM lineitem)
  WINDOW w AS (PARTITION BY cblk ORDER BY passno))"""
