"""Registered queries on areas, component lists, stitched lines, standard pixels, ordered sums and pass lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as e
from ..operators import geometry, output
from .fixtures import GEOM_SQL, PASSES_SQL, RASTER_SQL, passes, table
from .fixtures import geometry as geom
from .registry import query


# --- areas and components -----------------------------------------------------------------------------------------

_AREA = {"a": "image_id % 23 * 12 - 12", "b": "image_id % 19 * 9 - 9", "c": "image_id % 23 * 12 + image_id % 11 * 8 - 20", "d": "image_id % 19 * 9 + image_id % 13 * 6 - 20"}
_AREA = {n: f"CASE WHEN image_id % 29 = 0 THEN 0 ELSE {v} END" for n, v in _AREA.items()}
_AREA_SQL = f"""WITH {GEOM_SQL}, q AS (SELECT *, {', '.join(f'{v} AS {n}' for n, v in _AREA.items())} FROM geom),
w AS (SELECT *, CASE WHEN a = 0 AND b = 0 AND c = 0 AND d = 0 THEN NULL WHEN a < 0 THEN 'left is negative' WHEN a > x1 THEN 'left is outside' WHEN b < 0 THEN 'top is negative' WHEN b > y1 THEN 'top is outside'
  WHEN c <= 0 THEN 'right is not positive' WHEN c < x0 THEN 'right is outside' WHEN d <= 0 THEN 'bottom is not positive' WHEN d < y0 THEN 'bottom is outside' END AS error, a = 0 AND b = 0 AND c = 0 AND d = 0 AS whole FROM q),
areas AS (SELECT image_id, error, CASE WHEN error IS NULL THEN CASE WHEN whole THEN '' ELSE concat_ws(',', CASE WHEN a < x0 THEN 'left' END, CASE WHEN b < y0 THEN 'top' END, CASE WHEN c > x1 THEN 'right' END, CASE WHEN d > y1 THEN 'bottom' END) END END AS clamped,
  CASE WHEN error IS NULL THEN CASE WHEN whole THEN x0 ELSE greatest(a, x0) END END AS ax0, CASE WHEN error IS NULL THEN CASE WHEN whole THEN y0 ELSE greatest(b, y0) END END AS ay0,
  CASE WHEN error IS NULL THEN CASE WHEN whole THEN x1 ELSE least(c, x1) END END AS ax1, CASE WHEN error IS NULL THEN CASE WHEN whole THEN y1 ELSE least(d, y1) END END AS ay1 FROM w)"""


def _with_areas(spark, sf_dir) -> DataFrame:
    g = geom(spark, sf_dir)
    asked = tuple(F.expr(v).cast("long") for v in _AREA.values())
    a = output.decode_area(asked, tuple(map(F.col, ("x0", "y0", "x1", "y1"))))
    return e.once(g, "area", a)


def _areas(spark, sf_dir) -> DataFrame:
    g = _with_areas(spark, sf_dir)
    return g.select("image_id", "area.error", "area.clamped", *(F.col(f"area.{n}").alias(f"a{n}") for n in ("x0", "y0", "x1", "y1")))


@query(f"{_AREA_SQL} SELECT * FROM areas")
def area_requests(spark, sf_dir):
    return _areas(spark, sf_dir)


_ASKED = "CASE image_id % 5 WHEN 0 THEN [2, 0] WHEN 1 THEN [1, 1] WHEN 2 THEN [0] WHEN 3 THEN [1, 0, 2] ELSE []::INTEGER[] END"


@query(f"""WITH {GEOM_SQL}, q AS (SELECT image_id, numcomps, {_ASKED} AS asked FROM geom),
w AS (SELECT *, CASE WHEN len(list_filter(asked, lambda c: c >= numcomps)) > 0 THEN 'no component ' || list_filter(asked, lambda c: c >= numcomps)[1] WHEN asked = [1, 1] THEN 'component 1 twice' END AS error FROM q)
SELECT image_id, error, NULL::BIGINT AS place, NULL::BIGINT AS compno FROM w WHERE error IS NOT NULL
UNION ALL SELECT image_id, NULL, generate_subscripts(list, 1) - 1, unnest(list) FROM (SELECT image_id, CASE WHEN len(asked) = 0 THEN range(numcomps) ELSE asked END AS list FROM w WHERE error IS NULL)""")
def component_requests(spark, sf_dir):
    """Components in the order that a caller asks for, or what is wrong with the list."""
    k, n = F.col("image_id") % 5, F.col("numcomps")
    some = lambda *c: F.array(*(F.lit(x).cast("long") for x in c))
    asked = F.when(k == 0, some(2, 0)).when(k == 1, some(1, 1)).when(k == 2, some(0)).when(k == 3, some(1, 0, 2)).otherwise(F.array().cast("array<bigint>"))
    g = e.once(geom(spark, sf_dir), "asked", asked)
    g = e.once(g, "error", output.component_error(F.col("asked"), n))
    g = g.select("image_id", "error", F.posexplode_outer(F.when(F.col("error").isNull(), output.in_order(F.col("asked"), n))).alias("place", "compno"))
    return g.withColumn("place", F.col("place").cast("long"))


# --- stitching ----------------------------------------------------------------------------------------------------

_VALUE = "(x * 7 + y * 13 + tileno * 31) % 251 - 100"


@query(f"""{_AREA_SQL}, t AS (SELECT image_id, tileno, greatest(ax0_, a.ax0) AS l, least(ax1_, a.ax1) AS r, greatest(ay0_, a.ay0) AS o, least(ay1_, a.ay1) AS u, a.ax0 FROM (SELECT image_id, tileno, ax0 AS ax0_, ay0 AS ay0_, ax1 AS ax1_, ay1 AS ay1_ FROM tiles WHERE (image_id + tileno) % 7 <> 0) JOIN (FROM areas WHERE error IS NULL) a USING (image_id)),
s AS (SELECT *, unnest(range(o, u)) AS y FROM (SELECT *, unnest(range(l, r)) AS x FROM t WHERE l < r AND o < u))
SELECT image_id, y, count(*) AS n, sum(({_VALUE}) * (x - ax0 + 1))::BIGINT AS digest FROM s GROUP BY ALL""")
def stitched_lines(spark, sf_dir):
    """Lines of the asked areas out of tiles, a seventh of which are missing; a digest of each line's values and places."""
    # an image's area goes with its tiles: nothing is joined
    t = geometry.tiles(_with_areas(spark, sf_dir).where("area.error is null")).where("(image_id + tileno) % 7 <> 0")
    t = t.select("image_id", "tileno", *(F.col(f"a{n}").alias(n) for n in ("x0", "y0", "x1", "y1")), *(F.col(f"area.{n}").alias(f"a{n}") for n in ("x0", "y0", "x1", "y1"))).where("least(x1, ax1) > greatest(x0, ax0) and least(y1, ay1) > greatest(y0, ay0)")
    line = lambda y: e.bound(y * 13 + F.col("tileno") * 31, lambda b: F.transform(F.sequence(F.col("x0"), F.col("x1") - 1), lambda x: (x * 7 + b) % 251 - 100))
    t = t.withColumns({"compno": F.lit(0).cast("long"), "vals": F.flatten(F.transform(F.sequence(F.col("y0"), F.col("y1") - 1), line))})
    s = output.stitched(t, hole=-1000)
    s = e.once(s, "line", F.col("vals"))
    placed = F.transform("line", lambda v, i: F.when(v == -1000, F.lit(0).cast("long")).otherwise(v * (i + 1)))
    return s.select("image_id", "y", F.size(F.filter("line", lambda v: v != -1000)).cast("long").alias("n"), F.aggregate(placed, F.lit(0).cast("long"), lambda t, v: t + v).alias("digest"))


# --- standard pixels ----------------------------------------------------------------------------------------------

_FOUR = "SELECT vec_id // 4 AS image_id, vec_id % 4 AS compno, 6 + (vec_id // 4) % 7 AS prec, (vec_id // 4) % 2 = 1 AS signed, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(floor(CAST(f AS DOUBLE) * 255) AS BIGINT) * 16 AS v FROM (SELECT vec_id, unnest(embedding) AS f, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE vec_id % 4 <= (vec_id // 4) % 4"


@query(f"""WITH f AS ({_FOUR}), n AS (SELECT image_id, max(compno) + 1 AS comps FROM f GROUP BY 1),
s AS (SELECT *, CASE WHEN prec > 8 THEN 16 ELSE 8 END AS depth, CASE WHEN prec > 8 THEN 65535 ELSE 255 END AS top FROM f JOIN n USING (image_id) WHERE comps <> 2),
c AS (SELECT *, greatest(0, least(top, (v + CASE WHEN signed THEN 1 << (prec - 1) ELSE 0 END) * (1 << (depth - prec)))) AS o FROM s),
p AS (SELECT image_id, y, x, CASE WHEN comps = 1 THEN CASE WHEN depth = 16 THEN 'gray16' ELSE 'gray' END ELSE CASE WHEN depth = 16 THEN 'rgba64' ELSE 'rgba' END END AS kind, max(o) FILTER (compno = 0) AS c0, max(o) FILTER (compno = 1) AS c1, max(o) FILTER (compno = 2) AS c2, CASE WHEN comps = 3 THEN max(top) ELSE max(o) FILTER (compno = 3) END AS c3 FROM c GROUP BY image_id, y, x, comps, depth)
SELECT image_id, NULL AS error, kind, y, x, c0, c1, c2, c3 FROM p UNION ALL SELECT image_id, 'component count 2', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM n WHERE comps = 2""")
def standard_pixels(spark, sf_dir):
    """Images of one to four components of 6 to 12 bits as gray or colour with alpha; those of two are none."""
    t = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("image_id"), (F.col("vec_id") % 4).alias("compno"), "embedding").where("compno <= image_id % 4")
    vals = F.transform("embedding", lambda f: F.floor(f.cast("double") * 255).cast("long") * 16)
    p = t.select("image_id", "compno", vals.alias("vals")).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("compno", "vals"))).alias("p"), F.count("*").alias("comps"))
    p = p.withColumns({"prec": 6 + F.col("image_id") % 7, "signed": F.col("image_id") % 2 == 1})
    p = e.once(p, "kind", output.standard_kind(F.col("comps"), F.col("prec"), F.lit(True)))
    p = p.withColumn("i", F.explode(F.when(F.col("kind.error").isNull(), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(None).cast("int")))))
    p = p.withColumn("v", F.transform("p", lambda c: F.get(c["vals"], F.col("i"))))
    p = p.withColumn("o", F.when(F.col("i").isNotNull(), output.standard_channels(F.col("v"), F.col("prec"), F.col("signed"))))
    i = F.col("i").cast("long")
    return p.select("image_id", "kind.error", "kind.kind", e.div(i, F.lit(8)).alias("y"), (i % 8).alias("x"), *(F.get("o", F.lit(c)).alias(f"c{c}") for c in range(4)))


# --- sums and lengths ---------------------------------------------------------------------------------------------


@query(f"""WITH {PASSES_SQL}, r AS (SELECT cblk % 16 AS tile, cblk * 8 + passno AS o, ddist * 0.1::DOUBLE AS v FROM passes),
s AS (SELECT tile, o // 1024 AS part, list_reduce(list_prepend(0.0::DOUBLE, list(v ORDER BY o)), lambda a, b: a + b) AS v FROM r GROUP BY ALL)
SELECT tile, list_reduce(list_prepend(0.0::DOUBLE, list(v ORDER BY part)), lambda a, b: a + b) AS total FROM s GROUP BY ALL""")
def distortion_in_order(spark, sf_dir):
    """Sums of doubles in a fixed order of ranges, to the last bit."""
    p = passes(spark, sf_dir).select((F.col("cblk") % 16).alias("tile"), (F.col("cblk") * 8 + F.col("passno")).alias("o"), (F.col("ddist") * F.lit(0.1)).alias("v"))
    return output.ordered_sum(p, ["tile"], "v", "o")


@query("""WITH l AS (SELECT l_orderkey AS cblk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS passno, CAST(l_quantity AS BIGINT) AS q, l_partkey % 3 AS m FROM lineitem),
s AS (SELECT *, sum(q) OVER (PARTITION BY cblk ORDER BY passno) - CASE WHEN m = 0 THEN 1 ELSE 0 END AS ends FROM l)
SELECT cblk, passno, (ends - coalesce(lag(ends) OVER (PARTITION BY cblk ORDER BY passno), 0))::BIGINT AS len FROM s""")
def pass_lengths(spark, sf_dir):
    """Lengths of passes whose last byte must not be FF; a third of the passes end in one."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cblk")).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("p"))
    q = F.transform("p", lambda r: r["l_quantity"].cast("long"))
    p = p.select("cblk", F.transform("p", lambda r, i: F.aggregate(F.slice(q, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, v: a + v)).alias("ends"), F.transform("p", lambda r: F.when(r["l_partkey"] % 3 == 0, 255).otherwise(0)).alias("last"))
    p = p.select("cblk", F.posexplode(output.pass_lengths(F.col("ends"), F.col("last"))).alias("passno", "len"))
    return p.withColumn("passno", F.col("passno").cast("long"))


@query("""WITH r AS (SELECT user_id AS tile, event_id // 512 AS run, count(*) AS parts, string_agg(event_type, '' ORDER BY event_id) AS data FROM events GROUP BY ALL)
SELECT tile, run, parts, coalesce(sum(length(data)) OVER (PARTITION BY tile ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, data FROM r""")
def tile_part_runs_merged(spark, sf_dir):
    """Parts of a tile laid together in runs with their places, whatever the tile's number of parts."""
    return output.merged_runs(table(spark, sf_dir, "events").withColumnRenamed("user_id", "tile"), ["tile"], "event_id", "event_type", 512)
