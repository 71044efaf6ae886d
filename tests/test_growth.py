"""Plans that do not grow faster than their input: nothing large is broadcast, tasks are bounded, code is compiled."""

import pytest
from pyspark.sql import functions as F

from wavelake.functions import exprs as e
from wavelake.operators import geometry, packets
from wavelake.plans import fixtures
from wavelake.plans.catalogue import QUERIES, _res


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# F1, F2, F3, F10
@pytest.mark.parametrize("name", ["band_placement", "packets_in_budgets", "parameter_overrides", "tile_part_scan"])
def test_nothing_is_joined(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_strict_parts_broadcast_nothing(spark, small):
    plan = _plan(QUERIES["strict_parts"](spark, small))
    assert "HashJoin" not in plan and "BroadcastExchange" not in plan


# F4
def test_changes_keep_one_row_a_packet(spark, small):
    plan = _plan(packets.changed(packets.packets(_res(spark, small))))
    assert "Union" not in plan


# F6, F7, F8
@pytest.mark.parametrize("order", packets.ORDERS)
def test_numbered_equals_ordered(spark, small, order):
    cols = ["image_id", "tileno", "compno", "resno", "precno", "layno", "seq"]
    r = _res(spark, small).where("image_id < 40")
    a, b = packets.numbered(r, order).select(*cols), packets.ordered(packets.packets(r), order).select(*cols)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_quotients_are_exact(spark):
    big = (1 << 62) + 3
    df = spark.createDataFrame([(big, 1), (-7, 2), (7, -2)], "a long, b long")
    assert [r.q for r in df.select(e.div("a", "b").alias("q")).collect()] == [big, -3, -3]


# F9
@pytest.mark.parametrize("name", ["aoi_band_filter", "packets_pcrl", "packets_cprl", "packets_rpcl"])
def test_code_is_short_enough_to_be_compiled(spark, small, name):
    q = QUERIES[name](spark, small)._jdf
    jvm = spark._jvm
    plan = jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(q.sparkSession(), q.queryExecution().sparkPlan())
    code = getattr(getattr(jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000


# F13
def test_tasks_grow_with_the_images(spark, small, monkeypatch):
    monkeypatch.setattr(fixtures, "IMAGES", 20)
    assert fixtures.geometry(spark, small).rdd.getNumPartitions() == 10


# F5
def test_streamed_tiles_without_python(spark, tmp_path):
    from wavelake.streaming import ingest, parts

    rows = [(1, 0, 0, 2, 5), (1, 0, 1, 2, 7), (1, 0, 1, 2, 9), (2, 0, 0, 3, 4), (2, 0, 2, 3, 1), (3, 1, 4, 1, 6)]
    kind = "image_id long, tileno long, part long, parts long, length long"
    for k, some in enumerate((rows[::2], rows[1::2])):
        spark.createDataFrame(some, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    done = parts.completed_sums(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")))
    assert "Python" not in done._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, ingest.run_once(spark, done, ["image_id", "tileno"]).collect())) == [(1, 0, 2, 2, 14), (3, 1, 1, 1, 6)]


# F12
def test_stitched_lines_join_nothing(spark, small):
    assert "Join" not in _plan(QUERIES["stitched_lines"](spark, small))


# F14
def test_bytes_of_a_component_are_read_once(spark, small):
    from wavelake.sources import checks

    content = bytes.fromhex("FF4FFF51" + "002F" + "00" * 34 + "0003" + "870102" + "0703")  # the third component's and a byte of the second's are cut off
    df = spark.createDataFrame([(bytearray(content), 2, 47)], "content binary, off long, len long")
    got = df.select(checks.components(F.col("content"), F.struct("off", "len")).alias("c"))
    assert _plan(got).count("conv(") == 1
    assert [tuple(c) for c in got.first().c] == [(0, 8, True, 1, 2), (1, 8, False, 3, None), (2, None, None, None, None)]


# F15
def test_words_of_a_plain_map_are_found_once(spark):
    import time

    from wavelake.sources import rasters

    n = 120
    content = bytearray(f"P2\n{n} {n}\n255\n".encode() + b" ".join(b"%d" % (i % 256) for i in range(n * n)))
    df = spark.createDataFrame([(content,)], "content binary")
    start = time.time()
    assert [s.v for s in df.select(rasters.read_pixmap(F.col("content")).alias("s")).first().s] == [i % 256 for i in range(n * n)]
    assert time.time() - start < 10  # once for each sample takes longer


# F11
@pytest.mark.parametrize("name", ["transform_product_fixed", "transform_product_float"])
def test_a_task_has_few_python_processes(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    assert plan.count("ArrowEvalPython") <= 2 and "Join" not in plan
