"""Areas, stitching, standard pixels, sums and lengths on made cases."""

import random

from pyspark.sql import functions as F

from wavelake.operators import output


def test_lines_with_holes(spark):
    """Tiles of any size laid into an area; what no tile has is filled, and only the area leaves."""
    tile = lambda x0, y0, x1, y1: (1, 0, x0, y0, x1, y1, [100 * y + x for y in range(y0, y1) for x in range(x0, x1)])
    rows = [tile(0, 0, 3, 2), tile(5, 0, 8, 2), tile(0, 2, 8, 3), tile(8, 0, 9, 3)]
    df = spark.createDataFrame([(*r, 1, 1, 8, 3) for r in rows], "image_id long, compno long, x0 long, y0 long, x1 long, y1 long, vals array<long>, ax0 long, ay0 long, ax1 long, ay1 long").repartition(3)
    got = {r.y: (r.x0, r.vals) for r in output.stitched(df, hole=-1).collect()}
    assert got == {1: (1, [101, 102, -1, -1, 105, 106, 107]), 2: (1, [201, 202, 203, 204, 205, 206, 207])}


def test_sums_do_not_depend_on_tasks(spark):
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 9) for _ in range(3000)]
    rows = [(k % 10 // 9, k, v) for k, v in enumerate(values)]  # one key has most rows
    df = spark.createDataFrame(rows, "k long, o long, v double")
    want = {}
    for key in (0, 1):
        parts: dict = {}
        for k, o, v in rows:
            if k == key:
                parts[o // 64] = parts.get(o // 64, 0.0) + v
        total = 0.0
        for p in sorted(parts):
            total += parts[p]
        want[key] = total
    for n in (1, 7):
        got = {r.k: r.total for r in output.ordered_sum(df.repartition(n), ["k"], "v", "o", 64).collect()}
        assert got == want


def test_areas(spark):
    image = tuple(F.lit(v).cast("long") for v in (10, 20, 100, 200))
    cases = {(0, 0, 0, 0): (None, "", 10, 20, 100, 200), (10, 20, 30, 40): (None, "", 10, 20, 30, 40), (1, 2, 300, 400): (None, "left,top,right,bottom", 10, 20, 100, 200), (-1, 0, 5, 5): ("left is negative", None, None, None, None, None), (101, 0, 5, 5): ("left is outside",) + (None,) * 5, (20, 30, 0, 9): ("right is not positive",) + (None,) * 5, (20, 30, 40, 19): ("bottom is outside",) + (None,) * 5}
    df = spark.createDataFrame(list(cases), "a long, b long, c long, d long")
    got = {(r.a, r.b, r.c, r.d): tuple(r.area) for r in df.select("*", output.decode_area(tuple(map(F.col, "abcd")), image).alias("area")).collect()}
    assert got == cases


def test_component_lists(spark):
    df = spark.createDataFrame([([0, 2],), ([2, 3],), ([1, 1],), ([-1],), ([],)], "c array<bigint>")
    got = [(r.e, r.o) for r in df.select(output.component_error(F.col("c"), F.lit(3)).alias("e"), output.in_order(F.col("c"), F.lit(3).cast("long")).alias("o")).collect()]
    assert got == [(None, [0, 2]), ("no component 3", [2, 3]), ("component 1 twice", [1, 1]), ("no component -1", [-1]), (None, [0, 1, 2])]


def test_standard_pixels_of_any_depth(spark):
    df = spark.createDataFrame([([-128], 8, True), ([5, 6, 7], 4, False), ([4095, 0, 1, 2], 12, False), ([-40000], 16, True)], "v array<bigint>, prec int, signed boolean")
    got = [(r.k.kind, r.o) for r in df.select(output.standard_kind(F.size("v"), F.col("prec"), F.lit(True)).alias("k"), output.standard_channels(F.col("v"), F.col("prec"), F.col("signed")).alias("o")).collect()]
    assert got == [("gray", [0]), ("rgba", [80, 96, 112, 255]), ("rgba64", [65520, 0, 16, 32]), ("gray16", [0])]
    kinds = spark.createDataFrame([(0, 8, True), (3, 17, True), (3, 8, False), (5, 8, True)], "n int, p int, same boolean")
    assert [r.k.error for r in kinds.select(output.standard_kind(F.col("n"), F.col("p"), F.col("same")).alias("k")).collect()] == ["no components", "over 16 bits", "components of differing sizes", "component count 5"]


def test_pass_lengths(spark):
    df = spark.createDataFrame([([3, 7, 7, 9], [255, 1, 1, 255])], "e array<bigint>, b array<bigint>")
    assert df.select(output.pass_lengths(F.col("e"), F.col("b")).alias("l")).first().l == [2, 5, 0, 1]


def test_runs_of_a_hot_key(spark):
    rows = [(0 if i % 10 else 1, i, bytes([i % 251])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, d binary").repartition(5)
    got = output.merged_runs(df, ["k"], "o", "d", 64).orderBy("k", "run").collect()
    for key in (0, 1):
        mine = [r for r in got if r.k == key]
        assert b"".join(bytes(r.data) for r in mine) == b"".join(d for k, _, d in rows if k == key)
        assert [r.off for r in mine] == [sum(len(x.data) for x in mine[:i]) for i in range(len(mine))] and len(mine) == 47
