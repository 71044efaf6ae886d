"""Registered queries on tile-part divisions, byte budgets, packed packet headers, sparse blocks and quality thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as e
from ..operators import packets, rate, sparse
from ..sources import headers, packed
from .catalogue import _PACKETS, _res
from .fixtures import GEOM_SQL, PASSES_SQL, RASTER_SQL, passes, planes
from .fixtures import geometry as geom
from .registry import query

# --- packets ------------------------------------------------------------------------------------------------------

_LENGTH = "1 + (image_id * 3 + tileno * 5 + compno * 7 + resno * 11 + precno + layno * 13) % 60"


def _packets(spark, sf_dir, order: str) -> DataFrame:
    return packets.numbered(_res(spark, sf_dir), order).withColumn("length", F.expr(_LENGTH).cast("long"))


def _packets_sql(order: str) -> str:
    assert "py" not in packets.ORDERS[order]  # no packet is off its steps
    return f"{_PACKETS}, q AS (SELECT image_id, tileno, compno, resno, precno, layno, {_LENGTH} AS length, row_number() OVER (PARTITION BY image_id, tileno ORDER BY {', '.join(packets.ORDERS[order])}) - 1 AS seq FROM packets)"


def _division_sql(order: str, division: str) -> str:
    key = packets.ORDERS[order][: packets.ORDERS[order].index(packets.DIVISIONS[division]) + 1]
    return f"""{_packets_sql(order)}, r AS (SELECT image_id, tileno, dense_rank() OVER (PARTITION BY image_id, tileno ORDER BY {', '.join(key)}) - 1 AS part, seq, length FROM q),
s AS (SELECT image_id, tileno, part, min(seq) AS first, count(*) AS packets, (sum(length) + 14)::BIGINT AS bytes FROM r GROUP BY ALL)
SELECT *, coalesce(sum(bytes) OVER (PARTITION BY image_id, tileno ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM s"""


@query(_division_sql("rlcp", "R"))
def tile_parts_by_resolution(spark, sf_dir):
    return packets.tile_part_runs(_packets(spark, sf_dir, "rlcp"), "rlcp", "R")


@query(_division_sql("lrcp", "C"))
def tile_parts_by_component(spark, sf_dir):
    """Divided by component in an order that has it third: a part for each layer, resolution and component."""
    return packets.tile_part_runs(_packets(spark, sf_dir, "lrcp"), "lrcp", "C")


_STREAM, _COMPONENT = "150 + image_id % 7 * 100", "120 + image_id % 5 * 60"


@query(f"""{_packets_sql('lrcp')}, t AS (SELECT *, sum(length) OVER (PARTITION BY image_id, tileno ORDER BY seq) AS total, sum(length) OVER (PARTITION BY image_id, tileno, compno ORDER BY seq) AS comp_total FROM q),
f AS (SELECT *, min(CASE WHEN total > {_STREAM} OR comp_total > {_COMPONENT} THEN seq END) OVER (PARTITION BY image_id, tileno) AS cut FROM t)
SELECT image_id, tileno, compno, count(*) FILTER (cut IS NULL OR seq < cut) AS kept, coalesce(sum(length) FILTER (cut IS NULL OR seq < cut), 0)::BIGINT AS bytes, bool_and(cut IS NULL) AS whole FROM f GROUP BY ALL""")
def packets_in_budgets(spark, sf_dir):
    """Packets of each tile up to the first that breaks the budget of the stream or of a component."""
    p = packets.within_budgets(_packets(spark, sf_dir, "lrcp"), F.expr(_STREAM), F.expr(_COMPONENT))
    kept = p.groupBy("image_id", "tileno", "compno").agg(F.count_if("fits").alias("kept"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("length"))), F.lit(0).cast("long")).alias("bytes"), F.bool_and("whole").alias("whole"))
    return kept.select("image_id", "tileno", "compno", "kept", "bytes", "whole")


# --- packed headers -----------------------------------------------------------------------------------------------

_RUNS_SQL = f"""{GEOM_SQL}, r AS (SELECT image_id, tileno, (image_id + tileno * 37) % 200 AS n FROM tiles),
o AS (SELECT *, sum(n + 4) OVER (PARTITION BY image_id ORDER BY tileno) - n AS off, 90 + image_id % 30 AS cut FROM r)"""


def packed_streams(spark, sf_dir) -> DataFrame:
    """(image_id, content): main headers whose packed headers, a run for each tile, are cut in fragments of 90 bytes or
    more wherever that falls; the fragments are stored last first. In some a length is cut, in some a number comes twice."""
    k = F.col("image_id")
    g = geom(spark, sf_dir)
    tiles = F.expr("cast(((x1 - tx0 + tdx - 1) div tdx) * ((y1 - ty0 + tdy - 1) div tdy) as bigint)")
    run = lambda t: F.concat(F.lpad(F.hex((k + t * 37) % 200), 8, "0"), F.repeat(F.lpad(F.hex(t % 256), 2, "0"), ((k + t * 37) % 200).cast("int")))
    g = e.once(g, "hexed", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), run), ""))
    cut = 90 + k % 30
    many = e.ceil_div(F.length("hexed") / 2, cut)
    number = lambda z: F.when((k % 17 == 4) & (z == 1), 0).otherwise(z)
    piece = lambda z: packed.fragment(packed.PPM, number(z), F.unhex(F.substring("hexed", (1 + 2 * cut * z).cast("int"), (2 * cut).cast("int"))))
    g = e.once(g, "pieces", F.transform(F.reverse(F.sequence(F.lit(0).cast("long"), many - 1)), piece))
    body = F.aggregate("pieces", F.unhex(F.lit("")), lambda a, p: F.concat(a, p))
    return g.select("image_id", F.concat(headers.raw(headers.SOC), body, headers.raw(headers.SOT)).alias("content"))


@query(f"""WITH {_RUNS_SQL}, b AS (SELECT image_id, max((off - 4) % cut > cut - 4) AS broken, max(off + n) > max(cut) AND image_id % 17 = 4 AS twice FROM o GROUP BY image_id)
SELECT image_id, CASE WHEN twice THEN 'number twice' WHEN broken THEN 'length cut' END AS error, CASE WHEN NOT twice AND NOT broken THEN tileno END AS run, CASE WHEN NOT twice AND NOT broken THEN off::BIGINT END AS off,
  CASE WHEN NOT twice AND NOT broken THEN repeat(printf('%02X', tileno % 256), n) END AS data FROM o JOIN b USING (image_id) WHERE tileno = 0 OR NOT twice AND NOT broken""")
def packed_header_runs(spark, sf_dir):
    """The packed headers of each tile out of the main header's fragments, or what is wrong with them."""
    found = packed_streams(spark, sf_dir)
    found = found.withColumn("s", F.explode(headers.segments(F.col("content"))))
    f = packed.fragments(found, ["image_id"], packed.PPM)
    f = e.once(f, "r", packed.runs(F.col("parts")))
    f = f.select("image_id", F.coalesce("error", "r.error").alias("error"), F.posexplode_outer("r.runs").alias("run", "p"))
    return f.select("image_id", "error", F.col("run").cast("long").alias("run"), "p.off", F.hex("p.data").alias("data"))


# --- sparse blocks ------------------------------------------------------------------------------------------------

_SHAPE = {"width": 40, "height": 30, "bw": 7, "bh": 5}


def _array(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.lit(v).cast("long") for n, v in _SHAPE.items()})


@query(f"""WITH {RASTER_SQL}, w AS (SELECT image_id, compno AS seq, compno * 6 + image_id % 5 + CASE WHEN compno = 1 THEN y ELSE x END AS x, compno * 4 + image_id % 3 + CASE WHEN compno = 1 THEN x ELSE y END AS y, sv AS v FROM raster),
c AS (SELECT image_id, x, y, arg_max(v, seq) AS v FROM w GROUP BY ALL),
win AS (SELECT DISTINCT image_id, image_id % 9 AS x0, image_id % 7 AS y0, image_id % 9 + 1 + image_id % 31 AS x1, image_id % 7 + 1 + image_id % 25 AS y1 FROM raster)
SELECT image_id AS window_id, (y - y0) * 40 + (x - x0) * 2 AS at, coalesce(v, 0) AS v FROM (SELECT *, unnest(range(y0, y1)) AS y FROM (SELECT *, unnest(range(x0, x1)) AS x FROM win WHERE x1 <= 40 AND y1 <= 30)) LEFT JOIN c USING (image_id, x, y)""")
def sparse_windows(spark, sf_dir):
    """Planes written to a sparse array, one over another and one of them by columns; windows read with strides."""
    long = lambda x: x.cast("long")
    c, k = long(F.col("compno")), F.col("image_id")
    across = F.col("compno") == 1
    w = planes(spark, sf_dir, signed=True).select(k.alias("array_id"), c.alias("seq"), (c * 6 + k % 5).alias("x0"), (c * 4 + k % 3).alias("y0"), F.when(across, 8).otherwise(1).cast("long").alias("col_stride"), F.when(across, 1).otherwise(8).cast("long").alias("line_stride"), F.col("vals").alias("src"))
    blocks = sparse.stored(_array(w.withColumns({"x1": F.col("x0") + 8, "y1": F.col("y0") + 8})))
    v = planes(spark, sf_dir).select("image_id").distinct().select(k.alias("window_id"), k.alias("array_id"), (k % 9).alias("x0"), (k % 7).alias("y0"), (k % 9 + 1 + k % 31).alias("x1"), (k % 7 + 1 + k % 25).alias("y1"), F.lit(2).cast("long").alias("col_stride"), F.lit(40).cast("long").alias("line_stride"))
    return sparse.read(blocks, _array(v))


# --- thresholds ---------------------------------------------------------------------------------------------------

_SHARES = (0.3, 0.6, 0.9)


def _threshold_sql() -> str:
    take = "CASE WHEN b.rate = a.rate THEN b.dist <> a.dist ELSE {t} - (b.dist - a.dist)::DOUBLE / (b.rate - a.rate) < 2.2e-16 END"
    block = "list_reduce(list_prepend(base[i], list_filter(blocks[i], lambda b: b.n > base[i].n)), lambda a, b: CASE WHEN " + take + " THEN b ELSE a END)"
    allocated = lambda t: f"list_transform(range(1, len(blocks) + 1), lambda i: {block.format(t=t)})"
    achieved = lambda t: f"list_sum(list_transform({allocated(t)}, lambda s: s.dist))"
    share = "CASE layno " + " ".join(f"WHEN {k} THEN {s}::DOUBLE" for k, s in enumerate(_SHARES)) + " END"
    return f"""WITH RECURSIVE {PASSES_SQL},
d AS (SELECT *, cblk // 128 AS tile, coalesce(dist - lag(dist) OVER w, dist) AS dd, coalesce(rate - lag(rate) OVER w, rate) AS dr FROM passes WINDOW w AS (PARTITION BY cblk ORDER BY passno)),
b AS (SELECT tile, cblk, list({{'n': passno + 1, 'rate': rate, 'dist': dist}} ORDER BY passno) AS block, max(dist) AS full_, min(CASE WHEN dr <> 0 THEN dd::DOUBLE / dr END) AS low, max(CASE WHEN dr <> 0 THEN dd::DOUBLE / dr END) AS high FROM d GROUP BY ALL),
t AS MATERIALIZED (SELECT tile, list(block ORDER BY cblk) AS blocks, sum(full_)::DOUBLE AS everything, min(low) AS first_low, max(high) AS first_high FROM b GROUP BY tile),
walk AS (
  SELECT tile, 0 AS layno, 0 AS step, first_low AS low, first_high AS high, 0.0::DOUBLE AS settled, 0.0::DOUBLE AS stable, list_transform(blocks, lambda b: {{'n': 0::BIGINT, 'rate': 0::BIGINT, 'dist': 0::BIGINT}}) AS base, NULL::DOUBLE AS threshold, 0::BIGINT AS used FROM t
  UNION ALL
  SELECT tile, CASE WHEN over THEN layno + 1 ELSE layno END, CASE WHEN over THEN 0 ELSE step + 1 END, CASE WHEN over THEN first_low WHEN short THEN low ELSE mid END, CASE WHEN over THEN first_high WHEN short THEN mid ELSE high END,
    CASE WHEN over THEN 0 ELSE mid END AS settled, CASE WHEN over THEN 0 WHEN short THEN mid ELSE stable END, CASE WHEN over THEN next_ ELSE base END, CASE WHEN over THEN good END,
    CASE WHEN over THEN len(list_filter(range(1, len(base) + 1), lambda i: next_[i].n > base[i].n)) END
  FROM (SELECT *, CASE WHEN over THEN {allocated('good')} ELSE base END AS next_, CASE WHEN over THEN false ELSE {achieved('mid')} < {share} * everything END AS short
    FROM (SELECT *, (low + high) / 2 AS mid, abs((low + high) / 2 - settled) <= 0.5e-5 * settled OR step = 128 AS over, CASE WHEN stable = 0 THEN settled ELSE stable END AS good FROM walk JOIN t USING (tile) WHERE layno < {len(_SHARES)})))
SELECT tile, layno - 1 AS layno, threshold, used AS blocks, list_sum(list_transform(base, lambda s: s.rate))::BIGINT AS rate, list_sum(list_transform(base, lambda s: s.dist))::BIGINT AS dist FROM walk WHERE threshold IS NOT NULL"""


@query(_threshold_sql())
def quality_thresholds(spark, sf_dir):
    """Thresholds of three layers that keep to shares of a tile's distortion; code-blocks are dealt to tiles by number."""
    p = passes(spark, sf_dir).withColumn("tile", F.expr("cblk div 128"))
    return rate.quality_layers(p, list(_SHARES))
