"""Registered queries on marker segments, boxes, tile-parts and raster files.

Files are written from the geometry and raster relations as binary columns and read back; the SQL never sees the bytes
and works the fields out of the relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as e
from ..operators import color, geometry, settings
from ..sources import headers, markers, rasters, transforms, walks
from .fixtures import GEOM_SQL, RASTER_SQL, pictures, planes, table
from .fixtures import geometry as geom
from .registry import query



def _k():
    return F.col("image_id")


def _style(extra=0) -> object:
    return markers.style_bytes(F.col("numres") + extra, F.col("cblkw"), F.col("cblkh"), _k() % 2 == 0, F.col("pdx"), F.col("pdy"))


def rich_headers(spark, sf_dir) -> DataFrame:
    """`g` and a main header with every kind of segment: styles, quantisation, regions, progression changes, comments."""
    g = geom(spark, sf_dir)
    bands = 3 * F.col("numres") - 2
    step = F.transform(F.sequence(F.lit(0).cast("long"), bands - 1), lambda b: F.lpad(F.hex((F.col("prec") + b % 3) * 2048 + (_k() * 7 + b) % 2048), 4, "0"))
    size = F.transform(F.sequence(F.lit(0).cast("long"), bands - 1), lambda b: F.lpad(F.hex((F.col("prec") + b % 3) * 8), 2, "0"))
    flat = lambda a: F.unhex(F.array_join(a, ""))
    kind = _k() % 3  # none, derived, expounded
    qcd = headers.marker(headers.QCD, markers.one(kind + 64), F.when(kind == 0, flat(size)).when(kind == 1, flat(F.slice(step, 1, 1))).otherwise(flat(step)))
    cod = headers.marker(headers.COD, headers.raw("01"), markers.one(_k() % 5), headers.bytes_of(F.col("nlayers"), 2), headers.raw("01"), _style())
    coc = headers.marker(markers.COC, headers.raw("01"), headers.raw("01"), _style(1))
    qcc = headers.marker(markers.QCC, headers.raw("02"), headers.raw("20"), flat(size))
    rgn = headers.marker(markers.RGN, markers.one(F.col("numcomps") - 1), headers.raw("00"), markers.one(_k() % 12))
    change = lambda k: headers.joined(markers.one(e.long(k)), markers.one(k % 2), headers.bytes_of(1 + k, 2), markers.one(k + 2), headers.raw("03"), markers.one(k % 5))
    poc = headers.marker(markers.POC, change(_k() % 4), change(_k() % 3 + 4))
    note = headers.marker(markers.COM, headers.raw("0001"), F.repeat(F.lit("x"), (_k() % 90).cast("int")).cast("binary"))
    some = lambda c, v: F.when(c, v).otherwise(headers.raw(""))
    plain = headers.codestream_header(g)
    siz = F.substring(plain, 3, 40 + 3 * F.col("numcomps"))
    # a third of the images have so many comments that their header takes the long walk
    many = F.unhex(F.repeat(F.hex(headers.marker(markers.COM, headers.raw("0001"))), F.when(_k() % 3 == 0, 70).otherwise(1)))
    content = headers.joined(headers.raw(headers.SOC), siz, cod, note, many, some(F.col("numcomps") > 1, coc), qcd, some(F.col("numcomps") > 2, qcc), rgn, some(_k() % 2 == 1, poc), headers.raw(headers.SOT))
    return e.once(e.once(g, "content", content), "found", headers.segments(F.col("content")))


def _seg(code: str):
    return F.get(markers.of_code(F.col("found"), code), F.lit(0))


_SIZES = "array_to_string(list_transform(range(numres + {x}), lambda r: pdx || 'x' || pdy), ',')"


@query(f"WITH {GEOM_SQL} SELECT image_id, image_id % 5 AS progression, nlayers AS layers, 1 AS mct, numres, cblkw, cblkh, 0 AS style, image_id % 2 = 0 AS reversible, {_SIZES.format(x=0)} AS precincts FROM geom")
def cod_fields(spark, sf_dir):
    h = rich_headers(spark, sf_dir)
    return h.select("image_id", *(c.alias(n) for n, c in markers.cod(F.col("content"), _seg(headers.COD)).items()))


@query(f"""WITH {GEOM_SQL}, c AS (SELECT *, unnest(range(numcomps)) AS compno FROM geom)
SELECT image_id, compno, numres + CASE WHEN compno = 1 THEN 1 ELSE 0 END AS numres, CASE WHEN compno = 1 THEN {_SIZES.format(x=1)} ELSE {_SIZES.format(x=0)} END AS precincts FROM c""")
def coc_over_cod(spark, sf_dir):
    """The style of each component: its own segment where there is one, else the image's."""
    h = rich_headers(spark, sf_dir)
    base = h.select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("numcomps") - 1)).alias("compno"), *(markers.cod(F.col("content"), _seg(headers.COD))[n].alias(f"all_{n}") for n in ("numres", "precincts")))
    own = h.select("image_id", "content", F.explode(markers.of_code(F.col("found"), markers.COC)).alias("s"))
    own = own.select("image_id", *(markers.coc(F.col("content"), F.col("s"))[n].alias(n) for n in ("compno", "numres", "precincts")))
    both = base.join(own, ["image_id", "compno"], "left")
    return both.select("image_id", "compno", *(F.coalesce(n, f"all_{n}").alias(n) for n in ("numres", "precincts")))


_STEP = "(prec + b % 3) || ':' || (image_id * 7 + b) % 2048"


@query(f"""WITH {GEOM_SQL}, q AS (SELECT image_id, prec, numres, image_id % 3 AS style, unnest(range(3 * numres - 2)) AS b FROM geom)
SELECT image_id, style, 2 AS guard, string_agg(CASE style WHEN 0 THEN (prec + b % 3) || ':0' WHEN 2 THEN {_STEP} ELSE greatest(0, prec - CASE WHEN b = 0 THEN 0 ELSE (b - 1) // 3 END) || ':' || (image_id * 7) % 2048 END, ',' ORDER BY b) AS steps FROM q GROUP BY ALL""")
def qcd_fields(spark, sf_dir):
    h = rich_headers(spark, sf_dir).withColumn("s", _seg(headers.QCD))
    q = markers.quantisation(F.col("content"), F.col("s.off") + 4, F.col("s.len") - 2)
    return h.select("image_id", q["style"].alias("style"), q["guard"].alias("guard"), markers.shown(markers.derived(q["steps"], q["style"], 3 * F.col("numres") - 2)).alias("steps"))


@query(f"""WITH {GEOM_SQL} SELECT image_id, 2 AS compno, string_agg((prec + b % 3) || ':0', ',' ORDER BY b) AS steps FROM (SELECT image_id, prec, numcomps, unnest(range(3 * numres - 2)) AS b FROM geom) WHERE numcomps > 2 GROUP BY 1""")
def qcc_fields(spark, sf_dir):
    h = rich_headers(spark, sf_dir).select("image_id", "content", F.explode(markers.of_code(F.col("found"), markers.QCC)).alias("s"))
    q = markers.quantisation(F.col("content"), F.col("s.off") + 5, F.col("s.len") - 3)
    return h.select("image_id", headers.number(F.col("content"), F.col("s.off") + 4, 1).alias("compno"), markers.shown(q["steps"]).alias("steps"))


@query(f"""WITH {GEOM_SQL}, p AS (SELECT image_id, k, unnest([0, 1]) AS nth FROM (SELECT image_id, [image_id % 4, image_id % 3 + 4] AS k FROM geom WHERE image_id % 2 = 1))
SELECT image_id, CAST(nth AS BIGINT) AS nth, k[nth + 1] AS r0, k[nth + 1] % 2 AS c0, 1 + k[nth + 1] AS l1, k[nth + 1] + 2 AS r1, 3 AS c1, k[nth + 1] % 5 AS progression FROM p""")
def poc_fields(spark, sf_dir):
    h = rich_headers(spark, sf_dir).select("image_id", "content", F.explode(markers.of_code(F.col("found"), markers.POC)).alias("s"))
    return h.select("image_id", F.posexplode(markers.poc(F.col("content"), F.col("s"))).alias("nth", "p")).select("image_id", F.col("nth").cast("long").alias("nth"), "p.*")


@query(f"WITH {GEOM_SQL} SELECT image_id, numcomps - 1 AS compno, image_id % 12 AS shift FROM geom")
def rgn_fields(spark, sf_dir):
    h = rich_headers(spark, sf_dir)
    return h.select("image_id", markers.rgn(F.col("content"), _seg(markers.RGN)).alias("r")).select("image_id", "r.*")


@query(f"WITH {GEOM_SQL} SELECT image_id, 1 + CASE WHEN image_id % 3 = 0 THEN 70 ELSE 1 END AS skipped, 4 + CASE WHEN numcomps > 1 THEN 1 ELSE 0 END + CASE WHEN numcomps > 2 THEN 1 ELSE 0 END + image_id % 2 AS kept FROM geom")
def skipped_segments(spark, sf_dir):
    """How many segments a reader passes over, and how many it keeps."""
    h = rich_headers(spark, sf_dir)
    over = F.size(F.filter("found", lambda s: s["code"].isin(*markers.SKIPPED))).cast("long")
    return h.select("image_id", over.alias("skipped"), (F.size("found") - over).cast("long").alias("kept"))


# --- boxes --------------------------------------------------------------------------------------------------------


def rich_boxes(spark, sf_dir) -> DataFrame:
    """A boxed file with a palette, component map and channel definitions; some lack the header box or its first box."""
    g = geom(spark, sf_dir)
    codes = list(settings.COLOUR_SPACES)
    enum = F.element_at(F.array(*map(F.lit, [*codes, 99])), (_k() % 6 + 1).cast("int"))
    flat = lambda a: F.unhex(F.array_join(a, ""))
    seq = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    hexed = lambda v, n: F.lpad(F.hex(e.long(v)), 2 * n, "0")
    ihdr = headers.box("ihdr", headers.bytes_of(F.col("y1") - F.col("y0"), 4), headers.bytes_of(F.col("x1") - F.col("x0"), 4), headers.bytes_of(F.col("numcomps"), 2), headers.raw("FF0700"), markers.one(_k() % 2))
    bpcc = headers.box("bpcc", flat(F.transform(seq(F.col("numcomps")), lambda c: hexed(F.col("prec") - 1 + c + F.when(c == 1, 128).otherwise(0), 1))))
    colr = F.when(_k() % 7 == 0, headers.box("colr", headers.raw("020305"), F.repeat(F.lit("p"), (_k() % 40).cast("int")).cast("binary"))).otherwise(headers.box("colr", headers.raw("010000"), headers.bytes_of(enum, 4)))
    entries = 1 + _k() % 5
    pclr = headers.box("pclr", headers.bytes_of(entries, 2), headers.raw("02070B"), flat(F.transform(seq(entries), lambda i: F.concat(hexed((_k() + i) % 256, 1), hexed((_k() * 3 + i) % 4096, 2)))))
    cmap = headers.box("cmap", flat(F.transform(seq(F.col("numcomps")), lambda c: F.concat(hexed(0 * c, 2), hexed(c % 2, 1), hexed(c, 1)))))
    cdef = headers.box("cdef", headers.bytes_of(F.col("numcomps"), 2), flat(F.transform(seq(F.col("numcomps")), lambda c: F.concat(hexed(c, 2), hexed(F.when(c == 2, 1).otherwise(0), 2), hexed((c + _k()) % F.col("numcomps") + 1, 2)))))
    inner = [F.when(_k() % 13 == 5, headers.raw("")).otherwise(ihdr), bpcc, colr, pclr, cmap, cdef]
    top = [headers.raw(headers.SIGNATURE), headers.box("ftyp", F.lit("jp2 ").cast("binary"), headers.raw("00000001"), F.lit("jp2 jpx ").cast("binary")), F.when(_k() % 11 == 3, headers.raw("")).otherwise(headers.box("jp2h", *inner)), headers.box("jp2c", headers.codestream_header(g))]
    b = e.once(g, "content", headers.joined(*top))
    b = e.once(e.once(b, "top", headers.boxes(F.col("content"), F.lit(0), F.octet_length("content"))), "head", markers.of_type(F.col("top"), "jp2h"))
    return e.once(b, "sub", F.when(F.col("head").isNotNull(), headers.boxes(F.col("content"), F.col("head.off") + 8, F.col("head.off") + F.col("head.len"))))


_HAS = "image_id % 11 <> 3"


@query(f"""WITH {GEOM_SQL} SELECT image_id, CASE WHEN image_id % 11 = 3 THEN 'no jp2h' WHEN image_id % 13 = 5 THEN 'no ihdr' ELSE 'ok' END AS status,
  CASE WHEN image_id % 11 = 3 OR image_id % 13 = 5 THEN NULL WHEN image_id % 7 = 0 THEN 'unknown' ELSE ['srgb', 'gray', 'sycc', 'eycc', 'cmyk', 'unknown'][1 + image_id % 6] END AS space, CAST(2 AS BIGINT) AS brands FROM geom""")
def boxed_header_assembly(spark, sf_dir):
    b = rich_boxes(spark, sf_dir)
    b = e.once(b, "colour", markers.of_type(F.col("sub"), "colr"))
    status = F.when(F.col("head").isNull(), "no jp2h").when(markers.of_type(F.col("sub"), "ihdr").isNull(), "no ihdr").otherwise("ok")
    c = markers.colr(F.col("content"), F.col("colour"))
    space = F.when(status == "ok", settings.named(F.coalesce(c["enumcs"], F.lit(0)), settings.COLOUR_SPACES, "unknown"))
    ftyp = markers.of_type(F.col("top"), "ftyp")
    return b.select("image_id", status.alias("status"), space.alias("space"), e.long((ftyp["len"] - 16) / 4).alias("brands"))


@query(f"WITH {GEOM_SQL} SELECT image_id, y1 - y0 AS h, x1 - x0 AS w, numcomps AS nc, 255 AS bpc, 7 AS c, 0 AS unk, image_id % 2 AS ipr FROM geom WHERE {_HAS} AND image_id % 13 <> 5")
def ihdr_fields(spark, sf_dir):
    b = rich_boxes(spark, sf_dir).withColumn("b", markers.of_type(F.col("sub"), "ihdr")).where("b is not null")
    return b.select("image_id", *(c.alias(n) for n, c in markers.ihdr(F.col("content"), F.col("b")).items()))


@query(f"WITH {GEOM_SQL} SELECT image_id, compno, (prec + compno) * CASE WHEN compno = 1 THEN -1 ELSE 1 END AS bits FROM (SELECT image_id, prec, unnest(range(numcomps)) AS compno FROM geom) WHERE {_HAS}")
def bpcc_fields(spark, sf_dir):
    b = rich_boxes(spark, sf_dir).where("head is not null")
    return b.select("image_id", F.posexplode(markers.bpcc(F.col("content"), markers.of_type(F.col("sub"), "bpcc"))).alias("compno", "bits")).withColumn("compno", F.col("compno").cast("long"))


@query(f"""WITH {GEOM_SQL} SELECT image_id, CASE WHEN image_id % 7 = 0 THEN 2 ELSE 1 END AS method, CASE WHEN image_id % 7 = 0 THEN 3 ELSE 0 END AS precedence, CASE WHEN image_id % 7 = 0 THEN 5 ELSE 0 END AS approx,
  CASE WHEN image_id % 7 <> 0 THEN [16, 17, 18, 24, 12, 99][1 + image_id % 6] ELSE -1 END AS enumcs, CASE WHEN image_id % 7 = 0 THEN image_id % 40 ELSE -1 END AS profile FROM geom WHERE {_HAS}""")
def colr_fields(spark, sf_dir):
    b = rich_boxes(spark, sf_dir).where("head is not null")
    fields = markers.colr(F.col("content"), markers.of_type(F.col("sub"), "colr"))
    return b.select("image_id", *(F.coalesce(c, F.lit(-1)).cast("long").alias(n) for n, c in fields.items()))


@query(f"""WITH {GEOM_SQL} SELECT image_id, entry, col, CASE WHEN col = 0 THEN (image_id + entry) % 256 ELSE (image_id * 3 + entry) % 4096 END AS value
FROM (SELECT image_id, unnest(range(1 + image_id % 5)) AS entry FROM geom), (SELECT unnest(range(2)) AS col) WHERE {_HAS}""")
def pclr_fields(spark, sf_dir):
    b = rich_boxes(spark, sf_dir).where("head is not null")
    return b.select("image_id", F.explode(markers.pclr(F.col("content"), markers.of_type(F.col("sub"), "pclr"))).alias("p")).select("image_id", "p.*")


@query(f"WITH {GEOM_SQL} SELECT image_id, channel, 0 AS cmp, channel % 2 AS mtyp, channel AS pcol FROM (SELECT image_id, unnest(range(numcomps)) AS channel FROM geom) WHERE {_HAS}")
def cmap_fields(spark, sf_dir):
    b = rich_boxes(spark, sf_dir).where("head is not null")
    return b.select("image_id", F.posexplode(markers.cmap(F.col("content"), markers.of_type(F.col("sub"), "cmap"))).alias("channel", "m")).select("image_id", F.col("channel").cast("long").alias("channel"), "m.*")


@query(f"WITH {GEOM_SQL} SELECT image_id, cn, CASE WHEN cn = 2 THEN 1 ELSE 0 END AS typ, (cn + image_id) % numcomps + 1 AS asoc FROM (SELECT image_id, numcomps, unnest(range(numcomps)) AS cn FROM geom) WHERE {_HAS}")
def cdef_fields(spark, sf_dir):
    b = rich_boxes(spark, sf_dir).where("head is not null")
    return b.select("image_id", F.explode(markers.cdef(F.col("content"), markers.of_type(F.col("sub"), "cdef"))).alias("d")).select("image_id", "d.*")


# --- tile-parts ---------------------------------------------------------------------------------------------------

_PARTS_SQL = f"""{GEOM_SQL}, t AS (SELECT image_id, tileno, unnest(range(1 + image_id % 3)) AS part, 1 + image_id % 3 AS parts FROM tiles),
p AS (SELECT *, 1 + (image_id + tileno + part) % 5 AS n, CASE WHEN image_id % 5 = 0 THEN parts - 1 ELSE parts END AS told FROM t)"""


def part_streams(spark, sf_dir) -> DataFrame:
    """(image_id, content): codestreams of all tiles in one to three parts each; in a fifth of the images the number
    of parts is told one too small."""
    g = geom(spark, sf_dir)
    t = geometry.tiles(g.withColumn("h", headers.codestream_header(g))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _k() % 3)))
    data = F.unhex(F.repeat(F.lpad(F.hex((F.col("tileno") * 16 + F.col("part")) % 256), 2, "0"), (1 + (_k() + F.col("tileno") + F.col("part")) % 5).cast("int")))
    t = t.withColumn("piece", markers.tile_part(F.col("tileno"), F.col("part"), 1 + _k() % 3 - F.when(_k() % 5 == 0, 1).otherwise(0), data))
    # all first parts come before all second ones
    out = t.groupBy("image_id").agg(F.first("h").alias("h"), F.sort_array(F.collect_list(F.struct("part", "tileno", "piece"))).alias("p"))
    body = F.aggregate("p", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["piece"]))
    return e.once(out, "content", F.concat(F.expr("substring(h, 1, octet_length(h) - 2)"), body, headers.raw(markers.EOC))).select("image_id", "content")


def _parts(files: DataFrame) -> DataFrame:
    """`files` without their content, and a row for each tile-part."""
    return files.lateralJoin(walks.TilePartRows(F.col("content").outer())).drop("content")


@query(f"WITH {_PARTS_SQL} SELECT image_id, tileno, part, told AS parts, n + 14 AS len FROM p")
def tile_part_scan(spark, sf_dir):
    return _parts(part_streams(spark, sf_dir)).select("image_id", "tileno", "part", "parts", "len")


@query(f"WITH {_PARTS_SQL} SELECT image_id, tileno, string_agg(repeat(printf('%02X', (tileno * 16 + part) % 256), n), '' ORDER BY part) AS data, count(*) AS parts FROM p GROUP BY ALL")
def tile_part_data(spark, sf_dir):
    """The bytes of each tile from all its parts in order."""
    s = part_streams(spark, sf_dir).lateralJoin(walks.TilePartData(F.col("content").outer()))
    rows = s.select("image_id", "tileno", "part", F.hex("data").alias("data")).groupBy("image_id", "tileno").agg(F.sort_array(F.collect_list(F.struct("part", "data"))).alias("d"))
    return rows.select("image_id", "tileno", F.array_join(F.transform("d", lambda d: d["data"]), "").alias("data"), F.size("d").cast("long").alias("parts"))


@query(f"WITH {_PARTS_SQL} SELECT image_id, tileno, max(told) AS told, CASE WHEN max(part) = max(told) THEN max(told) + 1 ELSE max(told) END AS parts FROM p GROUP BY ALL")
def tile_part_repair(spark, sf_dir):
    """Numbers of tile-parts, one up where a part's own number reaches the number that is told."""
    t = _parts(part_streams(spark, sf_dir)).groupBy("image_id", "tileno").agg(F.max("parts").alias("told"), F.max("part").alias("top"))
    return t.select("image_id", "tileno", "told", F.when(F.col("top") == F.col("told"), F.col("told") + 1).otherwise(F.col("told")).alias("parts"))


@query(f"""WITH {_PARTS_SQL}, l AS (SELECT image_id, tileno, part, told, n, 40 + 3 * numcomps + 14 + 3 + 3 * numres - 2 + 4 + sum(n + 14) OVER (PARTITION BY image_id ORDER BY part, tileno) AS ends FROM p JOIN (SELECT image_id, numcomps, numres FROM geom) USING (image_id)),
c AS (SELECT *, max(ends) OVER (PARTITION BY image_id) + 2 - (image_id % 9) * 4 AS size FROM l)
SELECT image_id, tileno, part, ends > size AS corrupted FROM c WHERE ends - n - 14 + 12 <= size""")
def truncated_parts(spark, sf_dir):
    """Codestreams cut short: parts whose bytes are not all there, as a relaxed reader marks them."""
    s = e.once(part_streams(spark, sf_dir), "cut", F.expr("substring(content, 1, octet_length(content) - int((image_id % 9) * 4))")).select("image_id", F.col("cut").alias("content"))
    p = _parts(s.withColumn("size", F.octet_length("content"))).where("parts is not null and len is not null")
    return p.select("image_id", "tileno", "part", (F.col("off") + F.col("len") > F.col("size")).alias("corrupted"))


@query(f"WITH {_PARTS_SQL} SELECT image_id, 'FF55' || printf('%04X', 4 + 5 * count(*)) || '0050' || string_agg(printf('%02X', tileno) || printf('%08X', n + 14), '' ORDER BY part, tileno) AS tlm FROM p GROUP BY 1")
def tile_part_lengths(spark, sf_dir):
    s = part_streams(spark, sf_dir).select("image_id", F.transform(headers.tile_parts(F.col("content")), lambda p: F.struct(p["tileno"].alias("tileno"), p["len"].alias("len"))).alias("p"))
    return s.select("image_id", F.hex(markers.tlm(F.col("p"))).alias("tlm"))


@query("""SELECT l_orderkey AS k, string_agg(CASE WHEN v >= 2097152 THEN printf('%02X', 128 + (v >> 21) % 128) ELSE '' END || CASE WHEN v >= 16384 THEN printf('%02X', 128 + (v >> 14) % 128) ELSE '' END ||
  CASE WHEN v >= 128 THEN printf('%02X', 128 + (v >> 7) % 128) ELSE '' END || printf('%02X', v % 128), '' ORDER BY l_linenumber, v) AS plt FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_quantity) AS BIGINT) AS v FROM lineitem) GROUP BY 1""")
def packet_lengths(spark, sf_dir):
    """Packet lengths as numbers of seven bits a byte."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("long").alias("v"))
    rows = rows.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "v"))).alias("p"))
    return rows.select("k", F.array_join(F.transform("p", lambda p: markers.varint(p["v"])), "").alias("plt"))


# --- raster files -------------------------------------------------------------------------------------------------

_PIX = f"WITH {RASTER_SQL} "


def _interleaved(spark, sf_dir) -> DataFrame:
    p = pictures(spark, sf_dir)
    return p.select("image_id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform("planes", lambda c: F.get(c, i)))).alias("s"))


_READ = _PIX + "SELECT image_id, compno AS c, y, x, {v} AS v FROM raster SEMI JOIN pixels USING (image_id)"


@query(_READ.format(v="greatest(0, least(255, sv + 128))"))
def ppm_samples(spark, sf_dir):
    f = _interleaved(spark, sf_dir).select("image_id", rasters.pixmap(F.col("s"), F.lit(8), F.lit(8), F.lit(255), 3, False).alias("made"))
    f = e.once(f, "content", F.col("made"))
    return f.select("image_id", F.explode(rasters.read_pixmap(F.col("content"))).alias("s")).select("image_id", "s.*")


@query(_READ.format(v="greatest(0, least(255, sv + 128)) * 200"))
def plain_ppm_samples(spark, sf_dir):
    f = _interleaved(spark, sf_dir).select("image_id", rasters.pixmap(F.transform("s", lambda v: v * 200), F.lit(8), F.lit(8), F.lit(51000), 3, True).alias("made"))
    f = e.once(f, "content", F.col("made"))
    return f.select("image_id", F.explode(rasters.read_pixmap(F.col("content"))).alias("s")).select("image_id", "s.*")


@query(_PIX + "SELECT image_id, 'P6' || chr(10) || '8 8' || chr(10) || '255' || chr(10) AS head, 11 + 192 AS size, string_agg(printf('%02X', v), '' ORDER BY y, x, compno) AS body FROM (SELECT *, greatest(0, least(255, sv + 128)) AS v FROM raster SEMI JOIN pixels USING (image_id)) GROUP BY 1")
def ppm_bytes(spark, sf_dir):
    f = _interleaved(spark, sf_dir).select("image_id", rasters.pixmap(F.col("s"), F.lit(8), F.lit(8), F.lit(255), 3, False).alias("b"))
    return f.select("image_id", F.decode(F.substring("b", 1, 11), "ISO-8859-1").alias("head"), F.octet_length("b").alias("size"), F.hex(F.expr("substring(b, 12)")).alias("body"))


def _planes(spark, sf_dir) -> DataFrame:
    return planes(spark, sf_dir, signed=True).select("image_id", F.col("compno").cast("long").alias("compno"), F.col("vals").alias("s"))


@query(_PIX + "SELECT image_id, compno, y, x, CASE compno WHEN 0 THEN greatest(-128, least(127, sv)) WHEN 1 THEN greatest(0, least(65535, sv)) ELSE sv END AS v FROM raster")
def pgx_samples(spark, sf_dir):
    """Component 0 as signed bytes, 1 as unsigned 12-bit numbers, 2 as signed 20-bit ones."""
    c = F.col("compno")
    f = _planes(spark, sf_dir).select("image_id", "compno", rasters.pgx(F.col("s"), F.lit(8), F.lit(8), F.when(c == 0, 8).when(c == 1, 12).otherwise(20), c != 1).alias("made"))
    f = e.once(f, "content", F.col("made"))
    return f.select("image_id", "compno", F.explode(rasters.read_pgx(F.col("content"))).alias("s")).select("image_id", "compno", "s.y", "s.x", "s.v")


@query(_PIX + "SELECT image_id, compno, 'PG ML ' || CASE WHEN compno = 1 THEN '+' ELSE '-' END || ' ' || CASE compno WHEN 0 THEN 8 WHEN 1 THEN 12 ELSE 20 END || ' 8 8' || chr(10) AS head, CASE WHEN max(v) <= 1 THEN 1 ELSE length(bin(max(v))) END AS bits FROM (SELECT *, CASE compno WHEN 0 THEN greatest(-128, least(127, sv)) WHEN 1 THEN greatest(0, least(65535, sv)) ELSE sv END AS v FROM raster) GROUP BY ALL")
def pgx_precision(spark, sf_dir):
    """The header as written, and the precision that a reader takes from the samples."""
    c = F.col("compno")
    f = _planes(spark, sf_dir).select("image_id", "compno", rasters.pgx(F.col("s"), F.lit(8), F.lit(8), F.when(c == 0, 8).when(c == 1, 12).otherwise(20), c != 1).alias("made"))
    f = e.once(f, "content", F.col("made"))
    text = F.decode("content", "ISO-8859-1")
    return f.select("image_id", "compno", F.regexp_extract(text, r"(?s)\A([^\n]*\n)", 1).alias("head"), rasters.needed_bits(rasters.read_pgx(F.col("content"))).alias("bits"))


@query(_PIX + "SELECT image_id, compno, y, x, CASE compno WHEN 0 THEN sv & 255 WHEN 1 THEN (CASE WHEN (sv & 1023) >= 512 THEN (sv & 1023) - 1024 ELSE sv & 1023 END) ELSE sv & 65535 END AS v FROM raster")
def raw_samples(spark, sf_dir):
    """Component 0 in bytes, 1 signed in ten bits with the low byte first, 2 in 16 bits with the high byte first."""
    p, out = _planes(spark, sf_dir), None
    for c, prec, signed, low in ((0, 8, False, False), (1, 10, True, True), (2, 16, False, False)):
        f = p.where(F.col("compno") == c).select("image_id", "compno", rasters.raw_samples(F.col("s"), F.lit(prec), low).alias("made"))
        f = e.once(f, "b", F.col("made"))
        f = f.select("image_id", "compno", F.explode(rasters.read_raw_samples(F.col("b"), F.lit(8).cast("long"), F.lit(prec), F.lit(signed), low)).alias("s")).select("image_id", "compno", "s.y", "s.x", "s.v")
        out = f if out is None else out.unionByName(f)
    return out


@query("""SELECT p_partkey AS k, n, CAST(p_partkey * 0.5 AS DOUBLE) AS first, CAST(n * n + n - 1 + p_partkey * 0.5 AS DOUBLE) AS last FROM (SELECT p_partkey, 1 + p_partkey % 4 AS n FROM part WHERE p_partkey % 5 <> 0)""")
def matrix_files(spark, sf_dir):
    """Text files of a matrix and its offsets; those with a number too many are none."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (1 + F.col("p_partkey") % 4).alias("n"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") * F.col("n") + F.col("n") - F.when(F.col("k") % 5 == 0, 0).otherwise(1)), lambda i: (i + F.col("k") * 0.5).cast("double").cast("string"))
    text = F.concat(F.lit(" "), F.array_join(cells, ",\n"))
    m = e.once(e.once(p, "text", text), "m", rasters.matrix_of(F.col("text"))).where("m is not null")
    return m.select("k", "m.n", F.get("m.matrix", F.lit(0)).alias("first"), F.element_at("m.offsets", -1).alias("last"))


@query(f"WITH {GEOM_SQL} SELECT image_id, 'image ' || (x1 - x0) || 'x' || (y1 - y0) || ' at ' || x0 || ',' || y0 || ', ' || numcomps || ' components of ' || prec || ' bits, ' || numres || ' resolutions, ' || nlayers || ' layers' AS summary FROM geom")
def header_summary(spark, sf_dir):
    """One line of text for each file, from its header."""
    h = rich_headers(spark, sf_dir).select("image_id", "content", "found")
    c = markers.cod(F.col("content"), _seg(headers.COD))
    h = h.select("image_id", *headers.siz_fields(F.col("content"), _seg(headers.SIZ)), c["numres"].alias("numres"), c["layers"].alias("layers"))
    return h.select("image_id", F.format_string("image %dx%d at %d,%d, %d components of %d bits, %d resolutions, %d layers", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), "x0", "y0", "numcomps", "prec", "numres", "layers").alias("summary"))


# --- transforms of several components -----------------------------------------------------------------------------


def transform_headers(spark, sf_dir) -> DataFrame:
    """Main headers with a matrix, offsets, the collection that joins them, its order and the components' bits."""
    g = geom(spark, sf_dir)
    n = F.col("numcomps")
    cells = F.transform(F.sequence(F.lit(0).cast("long"), n * n - 1), lambda i: (_k() * (i + 1)) % 100 - 50)
    shifts = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: (_k() + i) % 7 - 3)
    group = [markers.cbd_bytes(F.col("prec"), _k() % 2 == 1, n), markers.mct_bytes(1 + _k() % 9, 1, cells), markers.mct_bytes(20 + _k() % 9, 2, shifts), markers.mcc_bytes(3 + _k() % 5, n, 1 + _k() % 9, 20 + _k() % 9, _k() % 3 == 0), markers.mco_bytes(3 + _k() % 5)]
    plain = headers.codestream_header(g)
    content = headers.joined(F.expr("unhex('FF4F')"), F.substring(plain, 3, 40 + 3 * n), *group, headers.raw(headers.SOT))
    return e.once(e.once(g, "content", content), "found", headers.segments(F.col("content")))


@query(f"""WITH {GEOM_SQL}, a AS (SELECT image_id, unnest([1, 2]) AS kind, numcomps AS n FROM geom)
SELECT image_id, CASE kind WHEN 1 THEN 1 + image_id % 9 ELSE 20 + image_id % 9 END AS index, kind::BIGINT AS kind, 1 AS element,
  CASE kind WHEN 1 THEN list_sum(list_transform(range(n * n), lambda i: (i + 1) * ((image_id * (i + 1)) % 100 - 50))) ELSE list_sum(list_transform(range(n), lambda i: (i + 1) * ((image_id + i) % 7 - 3))) END::BIGINT AS weighted FROM a""")
def transform_arrays(spark, sf_dir):
    """Matrices and offsets of the headers; weighted: the sum of place times value."""
    h = transform_headers(spark, sf_dir).select("image_id", "content", F.explode(markers.of_code(F.col("found"), markers.MCT)).alias("s"))
    h = e.once(h, "m", transforms.record_of(F.col("content"), F.col("s")))
    weighted = F.aggregate(F.transform("m.values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return h.select("image_id", "m.index", "m.kind", "m.element", weighted.cast("long").alias("weighted"))


_ELEMENT = """CASE element WHEN 0 THEN ((image_id * (i + 1)) % 60000 - 30000)::DOUBLE WHEN 1 THEN ((image_id * (i + 1) * 7919) % 4000000 - 2000000)::DOUBLE
  WHEN 2 THEN CAST((((image_id * (i + 1)) % 4001 - 2000) / 7.0) AS FLOAT)::DOUBLE ELSE ((image_id * (i + 1)) % 4001 - 2000) / 7.0 END"""


@query(f"""WITH {GEOM_SQL}, a AS (SELECT image_id, numcomps AS n, unnest(range(4)) AS element FROM geom), v AS (SELECT *, unnest(range(n * n)) AS i FROM a)
SELECT image_id, 1 + element AS index, 1::BIGINT AS kind, element, i AS nth, {_ELEMENT} AS value FROM v""")
def transform_elements(spark, sf_dir):
    """Matrices of all four element types, written as records and read back."""
    g, n = geom(spark, sf_dir), F.col("numcomps")
    cell = lambda i, f: f(_k() * (i + 1))
    seventh = lambda x: (x % 4001 - 2000).cast("double") / 7.0
    values = (lambda x: (x % 60000 - 30000).cast("double"), lambda x: ((x * 7919) % 4000000 - 2000000).cast("double"), lambda x: seventh(x).cast("float").cast("double"), seventh)
    cells = lambda f: F.transform(F.sequence(F.lit(0).cast("long"), n * n - 1), lambda i: cell(i, f))
    content = headers.joined(headers.raw(headers.SOC), *(transforms.record(F.lit(k + 1), transforms.MATRIX, F.lit(k), cells(f)) for k, f in enumerate(values)), headers.raw(headers.SOT))
    h = e.once(g.select("image_id", content.alias("made")), "content", F.col("made"))
    h = h.select("image_id", "content", F.explode(headers.segments(F.col("content"))).alias("s"))
    h = h.select("image_id", transforms.record_of(F.col("content"), F.col("s")).alias("m"))
    return h.select("image_id", "m.index", "m.kind", "m.element", F.posexplode("m.values").alias("nth", "value")).withColumn("nth", F.col("nth").cast("long"))


_MATRIX = "((image_id * ({i} + 1)) % 17 - 8)"  # eighths


def _product_sql(fixed: bool) -> str:
    cell = lambda i, v: f"CAST(floor(({_MATRIX.format(i=i)} * 1024 * {v} + 4096) / 8192.0) AS BIGINT)" if fixed else f"CAST(CAST({_MATRIX.format(i=i)} AS FLOAT) / 8 * {v} AS FLOAT)"
    two = ", ".join(f"{cell(2 * j, 'c2')} + {cell(2 * j + 1, 'c0')} AS o{n}" for j, n in ((0, 0), (1, 2)))
    return f"WITH {RASTER_SQL}, o AS (SELECT image_id, y, x, {two}, {cell(4, 'c1')} AS o1 FROM pixels) SELECT image_id, comp, y, x, CASE comp WHEN 0 THEN o0 WHEN 1 THEN o1 ELSE o2 END AS v FROM (SELECT *, unnest(range(3)) AS comp FROM o)"


def _products(spark, sf_dir, fixed: bool) -> DataFrame:
    """Samples through the matrices that their header's collections name: components 2 and 0 give 0 and 2, 1 gives 1."""
    p = pictures(spark, sf_dir)
    eighth = lambda i: ((_k() * (i + 1)) % 17 - 8).cast("double") / 8
    cells = lambda *at: F.array(*(eighth(F.lit(i)) for i in at))
    row = lambda ins, outs, m: F.struct(F.array(*(F.lit(c).cast("long") for c in ins)).alias("inputs"), F.array(*(F.lit(c).cast("long") for c in outs)).alias("outputs"), F.lit(m).cast("long").alias("matrix"), F.lit(0).cast("long").alias("offsets"), F.lit(True).alias("reversible"))
    content = headers.joined(headers.raw(headers.SOC), transforms.record(F.lit(5), transforms.MATRIX, F.lit(2), cells(0, 1, 2, 3)), transforms.record(F.lit(6), transforms.MATRIX, F.lit(3), cells(4)), transforms.collections(F.lit(1), F.array(row((2, 0), (0, 2), 5), row((1,), (1,), 6))), headers.raw(headers.SOT))
    # a row keeps its planes: each Python step of a task is a process, and joins of its own branches would have them twice
    h = e.once(p.select("*", content.alias("made")), "content", F.col("made"))
    h = e.once(h, "header", transforms.header_of(F.col("content")))
    rows = h.select("image_id", "planes", "header.records", F.explode("header.groups").alias("g"))
    rows = rows.select("image_id", "planes", "g.inputs", "g.outputs", F.explode(F.filter("records", lambda r: r["index"] == F.col("g.matrix"))).alias("m"))
    rows = rows.select("*", "m.values")
    chosen = F.transform("inputs", lambda c: F.get("planes", c.cast("int")))
    rows = rows.select("image_id", "outputs", "values", chosen.alias("chosen")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size(F.get("chosen", F.lit(0))) - 1)))
    rows = rows.withColumn("v", F.transform("chosen", lambda c: F.get(c, F.col("i"))))
    out = color.matrix_product(F.col("v"), F.col("values"), fixed)
    rows = rows.select("image_id", F.col("i").cast("long").alias("i"), F.explode(F.arrays_zip(F.col("outputs").alias("comp"), out.alias("v"))).alias("o"))
    return rows.select("image_id", "o.comp", e.div("i", F.lit(8)).alias("y"), (F.col("i") % 8).alias("x"), "o.v")


@query(_product_sql(True))
def transform_product_fixed(spark, sf_dir):
    return _products(spark, sf_dir, True)


@query(_product_sql(False))
def transform_product_float(spark, sf_dir):
    return _products(spark, sf_dir, False)


@query(f"WITH {GEOM_SQL} SELECT image_id, 3 + image_id % 5 AS index, 1 AS collections, numcomps AS n, image_id % 3 = 0 AS reversible, 20 + image_id % 9 AS offsets, 1 + image_id % 9 AS matrix FROM geom")
def transform_collections(spark, sf_dir):
    """The collection that each header's order names, with the indices of its arrays."""
    h = transform_headers(spark, sf_dir)
    first = lambda code: F.get(markers.of_code(F.col("found"), code), F.lit(0))
    h = e.once(e.once(h, "mcc", first(markers.MCC)), "mco", first(markers.MCO))
    named = headers.number(F.col("content"), F.col("mco.off") + 5, 1)
    m = markers.mcc(F.col("content"), F.col("mcc"))
    return h.where(named == m["index"]).select("image_id", *(c.alias(n) for n, c in m.items()))


@query(f"WITH {GEOM_SQL} SELECT image_id, compno, (prec + compno) * CASE WHEN image_id % 2 = 1 THEN -1 ELSE 1 END AS bits FROM (SELECT image_id, prec, unnest(range(numcomps)) AS compno FROM geom)")
def component_bits(spark, sf_dir):
    h = transform_headers(spark, sf_dir)
    s = F.get(markers.of_code(F.col("found"), markers.CBD), F.lit(0))
    return h.select("image_id", F.posexplode(markers.cbd(F.col("content"), s)).alias("compno", "bits")).withColumn("compno", F.col("compno").cast("long"))
