"""Registered queries of the wavelets on tiles of real size and any origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import div
from ..operators import lifting
from .fixtures import table
from .registry import query
from .wavelet_sql import K_HIGH, forward_sql, inverse_sql, lifted_97

HIGH = 48


def tiles(spark, sf_dir) -> DataFrame:
    """(image_id, compno, x0, y0, w, vals): 64 samples of a row from each row of embeddings, 48 rows to a tile."""
    v = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {HIGH}").alias("image_id"), "vec_id", F.transform("embedding", lambda f: F.floor(f.cast("double") * 255).cast("long")).alias("r"))
    t = v.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "r"))).alias("rows"))
    return t.select("image_id", F.lit(0).cast("long").alias("compno"), (F.col("image_id") % 3).alias("x0"), (F.col("image_id") % 2).alias("y0"), F.lit(64).cast("long").alias("w"), F.flatten(F.transform("rows", lambda r: r["r"])).alias("vals"))


_SRC = f"""src AS MATERIALIZED (SELECT image_id, image_id % 3 AS x0, image_id % 2 AS y0, y, i - 1 AS x, CAST(floor(CAST(f AS DOUBLE) * 255) AS BIGINT) AS v
  FROM (SELECT image_id, y, unnest(embedding) AS f, generate_subscripts(embedding, 1) AS i
    FROM (SELECT vec_id // {HIGH} AS image_id, embedding, row_number() OVER (PARTITION BY vec_id // {HIGH} ORDER BY vec_id) - 1 AS y FROM embeddings)))"""


def _pixels(t: DataFrame, digits: int | None = None) -> DataFrame:
    p = t.select("image_id", "w", F.posexplode("vals").alias("i", "v"))
    v = F.col("v") if digits is None else F.round("v", digits) + F.lit(0.0)
    return p.select("image_id", div("i", "w").alias("y"), (F.col("i").cast("long") % F.col("w")).alias("x"), v.alias("v"))


_ROUND = "round(CAST(v AS DOUBLE), 2) + 0.0::DOUBLE AS v"


@query(f"WITH {_SRC}, {forward_sql('src', 'o')} SELECT image_id, y, x, v FROM o")
def dwt53_tiles(spark, sf_dir):
    return _pixels(lifting.transformed(tiles(spark, sf_dir), "53"))


@query(f"WITH {_SRC}, {inverse_sql('src', 'o')} SELECT image_id, y, x, v FROM o")
def idwt53_tiles(spark, sf_dir):
    return _pixels(lifting.transformed(tiles(spark, sf_dir), "53", back=True))


@query(f"WITH {_SRC}, {inverse_sql('src', 'o')} SELECT image_id, y - 3 AS y, x - 9 AS x, v FROM o WHERE y BETWEEN 3 AND 13 AND x BETWEEN 9 AND 40")
def idwt53_window(spark, sf_dir):
    """A window of the inverse, from the coefficients that it depends on."""
    return _pixels(lifting.transformed(tiles(spark, sf_dir), "53", back=True, region=(9, 3, 41, 14)))


@query(f"WITH {_SRC}, {lifted_97('src', 'o', True)} SELECT image_id, y, x, {_ROUND} FROM o")
def dwt97_tiles(spark, sf_dir):
    return _pixels(lifting.transformed(tiles(spark, sf_dir), "97"), 2)


@query(f"WITH {_SRC}, {lifted_97('src', 'o', False)} SELECT image_id, y, x, {_ROUND} FROM o")
def idwt97_tiles(spark, sf_dir):
    return _pixels(lifting.transformed(tiles(spark, sf_dir), "97", back=True), 2)


@query(f"WITH {_SRC}, {lifted_97('src', 'o', False)} SELECT image_id, y - 3 AS y, x - 9 AS x, {_ROUND} FROM o WHERE y BETWEEN 3 AND 13 AND x BETWEEN 9 AND 40")
def idwt97_window(spark, sf_dir):
    return _pixels(lifting.transformed(tiles(spark, sf_dir), "97", back=True, region=(9, 3, 41, 14)), 2)


@query(f"WITH {_SRC}, {forward_sql('src', 'o')}, {forward_sql('low', 'p', low_of='o')} SELECT image_id, y, x, v FROM p UNION ALL SELECT image_id, y, x, v FROM o ANTI JOIN p USING (image_id, y, x)")
def dwt53_two_levels(spark, sf_dir):
    return _pixels(lifting.transformed(tiles(spark, sf_dir), "53", levels=2))


assert K_HIGH == lifting.HIGH_SCALE
