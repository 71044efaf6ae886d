"""Registered queries on raster files: planes are written as files by the data source and read back from their folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import raster_source
from .fixtures import RASTER_SQL, planes
from .registry import query

_FILES = f"WITH {RASTER_SQL} "
_OF = _FILES + "SELECT image_id, compno AS comp, y, x, {v} AS v FROM raster{whole}"
_WHOLE = " SEMI JOIN pixels USING (image_id)"


def _lines(spark, sf_dir, prec, signed, value, whole: bool) -> DataFrame:
    """Lines of the planes as the data source writes them; whole: of images of three planes only."""
    p = planes(spark, sf_dir, signed=True).withColumn("compno", F.col("compno").cast("int"))
    if whole:
        p = p.join(p.groupBy("image_id").count().where("count = 3").select("image_id"), "image_id", "left_semi")
    line = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("vals", y * 8 + 1, F.lit(8))))
    p = p.select("image_id", "compno", line.alias("y", "line"))
    c = F.col("compno")
    return p.select(F.concat(F.lit("i"), F.col("image_id").cast("string")).alias("file"), c.alias("comp"), F.lit(8).alias("w"), F.lit(8).alias("h"), prec(c).cast("int").alias("prec"), signed(c).alias("signed"), "y", F.transform("line", value).alias("samples"))


def _read(spark, path: str, kind: str, comp, **options) -> DataFrame:
    """(image_id, comp, y, x, v) of the files of a folder; an error in one of them is a row of nulls."""
    raster_source.register(spark)
    f = spark.read.format(kind).options(**options).load(path)
    image = F.regexp_extract("file", r"i(\d+)", 1).cast("long")
    return f.select(image.alias("image_id"), comp.cast("long").alias("comp"), F.col("y").cast("long").alias("y"), F.posexplode_outer("samples").alias("x", "v")).withColumn("x", F.col("x").cast("long"))


@query(_OF.format(v="CASE compno WHEN 0 THEN greatest(-128, least(127, sv)) WHEN 1 THEN greatest(0, least(4095, sv)) ELSE sv END", whole=""))
def pgx_files(spark, sf_dir):
    """A file for each component: signed bytes, unsigned numbers of 12 bits, signed ones of 20 bits."""
    lines = _lines(spark, sf_dir, lambda c: F.when(c == 0, 8).when(c == 1, 12).otherwise(20), lambda c: c != 1, lambda v: v, False)
    path = raster_source.scratch(spark, "pgx")
    raster_source.save_rasters(lines, path, "pgx", order="low")
    return _read(spark, path, "pgx", F.regexp_extract("file", r"_(\d+)\.pgx", 1))


@query(_OF.format(v="greatest(0, least(1023, 2 * sv + 512))", whole=_WHOLE))
def pnm_files(spark, sf_dir):
    """A pixmap for each image of three planes, ten bits a sample, read in stripes of under a file each."""
    lines = _lines(spark, sf_dir, lambda c: F.lit(10), lambda c: F.lit(False), lambda v: 2 * v + 512, True)
    path = raster_source.scratch(spark, "pnm")
    raster_source.save_rasters(lines, path, "pnm", components=3)
    return _read(spark, path, "pnm", F.col("comp"), stripe=1 << 16)


@query(_OF.format(v="greatest(-512, least(511, sv))", whole=_WHOLE))
def rawplane_files(spark, sf_dir):
    """Three planes of signed ten-bit samples one after the other, the low byte first."""
    lines = _lines(spark, sf_dir, lambda c: F.lit(10), lambda c: F.lit(True), lambda v: v, True)
    path = raster_source.scratch(spark, "raw")
    raster_source.save_rasters(lines, path, "rawplane", components=3, order="low")
    return _read(spark, path, "rawplane", F.col("comp"), width=8, height=8, precision=10, signed=True, components=3, order="low")
