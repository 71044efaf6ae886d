"""Edge cases of the operators on small made-up inputs."""

import random

from pyspark.sql import functions as F

from wavelake.functions import exprs as e
from wavelake.operators import color, geometry, packets, rate, wavelet


def test_integer_arithmetic(spark):
    rows = [(a, b) for a in (-9, -5, -1, 0, 1, 5, 8) for b in (1, 2, 3)]
    df = spark.createDataFrame(rows, "a long, b long")
    out = df.select("a", "b", e.div("a", "b").alias("d"), e.ceil_shift("a", "b").alias("c"), e.wrap32(F.col("a") * 2147483648).alias("w")).collect()
    for r in out:
        assert r.d == int(r.a / r.b)
        assert r.c == -(-r.a // 2**r.b)
        assert r.w == (r.a * 2147483648 + 2**31) % 2**32 - 2**31


def _lift(a):
    n = len(a)
    if n < 2:
        return a
    low, high = a[::2], a[1::2]
    d = [v - ((low[i] + low[min(i + 1, len(low) - 1)]) >> 1) for i, v in enumerate(high)]
    s = [v + ((d[max(i - 1, 0)] + d[min(i, len(d) - 1)] + 2) >> 2) for i, v in enumerate(low)]
    return s + d


def test_lifting_of_any_length_and_back(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-300, 300) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 16, 17])]
    df = spark.createDataFrame(rows, "i long, a array<long>")
    out = df.select("a", wavelet.forward53(F.col("a")).alias("f")).select("*", wavelet.inverse53(F.col("f")).alias("back")).collect()
    for r in out:
        assert r.f == _lift(r.a)
        assert r.back == r.a


def test_rectangular_plane_comes_back(spark):
    rng = random.Random(4)
    for h, w in ((1, 5), (3, 4), (7, 2)):
        plane = [[rng.randrange(256) for _ in range(w)] for _ in range(h)]
        df = spark.createDataFrame([(plane,)], "p array<array<long>>").select(wavelet.forward2d(F.col("p")).alias("f"))
        assert df.select(wavelet.inverse2d(F.col("f")).alias("b")).first().b == plane


def test_reversible_transform_of_extremes(spark):
    rows = [(r, g, b) for r in (-128, 0, 127) for g in (-128, 5, 127) for b in (-128, -1, 127)]
    df = spark.createDataFrame(rows, "r long, g long, b long")
    out = df.select("r", "g", "b", *(c.alias(n) for c, n in zip(color.rct_inverse(*color.rct(F.col("r"), F.col("g"), F.col("b"))), "xyz", strict=True))).collect()
    assert all((o.r, o.g, o.b) == (o.x, o.y, o.z) for o in out)


def test_code_blocks_tile_the_image(spark):
    """Every sample of every band lies in exactly one code-block, and the bands hold as many samples as the image."""
    geom = spark.createDataFrame([(1, 3, 2, 70, 61, 32, 40, 0, 0, 2, 2, 1, 8, 3, 3, 2, 4, 5, 2, 0), (2, 0, 0, 1, 1, 8, 8, 0, 0, 1, 1, 1, 8, 1, 2, 2, 3, 3, 1, 0)], "image_id long, x0 long, y0 long, x1 long, y1 long, tdx long, tdy long, tx0 long, ty0 long, numcomps long, dx long, dy long, prec long, numres long, cblkw long, cblkh long, pdx long, pdy long, nlayers long, reduce long")
    res = geometry.resolutions(geometry.tile_components(geometry.tiles(geom)))
    blocks = geometry.code_blocks(geometry.precincts(geometry.bands(res)))
    area = blocks.groupBy("image_id", "compno").agg(F.sum((F.col("kx1") - F.col("kx0")) * (F.col("ky1") - F.col("ky0"))).alias("n"))
    got = {(r.image_id, r.compno): r.n for r in area.collect()}
    assert got == {(1, 0): 67 * 59, (1, 1): (35 - 2) * 59, (2, 0): 1}
    p = packets.packets(res)
    n = p.count()
    for order in ("lrcp", "rlcp"):
        assert packets.ordered(p, order).count() == n


def _greedy(passes, threshold):
    taken = rate_ = dist = 0
    for k, (r, d) in enumerate(passes):
        dr, dd = r - rate_, d - dist
        if dd != 0 if dr == 0 else threshold - dd / dr < 2.2e-16:
            taken, rate_, dist = k + 1, r, d
    return taken, rate_, dist


def test_greedy_layer_follows_the_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(30):
        r = d = 0
        mine = []
        for k in range(rng.randrange(1, 12)):
            r, d = r + rng.choice([0, 1, 5, 9]), d + rng.choice([0, 3, 50, 400])
            mine.append((r, d))
            rows.append((c, k, r, d))
        want[c] = _greedy(mine, 12.5)
    got = rate.greedy(spark.createDataFrame(rows, "cblk long, passno long, rate long, dist long"), 12.5).collect()
    assert {g.cblk: (g.taken, g.rate, g.dist) for g in got} == want


def test_palette_clamps_and_copies(spark):
    palette = spark.createDataFrame([(i, p, 10 * i + p) for i in range(3) for p in range(2)], "idx long, pcol long, value long")
    rows = color.palette_expand(spark.createDataFrame([(1, -4), (2, 1), (3, 9)], "px long, idx long"), palette, 3, [1, 0, None]).collect()
    assert {(r.px, r.channel): r.value for r in rows} == {(1, 0): 1, (1, 1): 0, (1, 2): -4, (2, 0): 11, (2, 1): 10, (2, 2): 1, (3, 0): 21, (3, 1): 20, (3, 2): 9}
