"""Streams against the same data read at once."""

from pyspark.sql import functions as F

from wavelake.sources import headers
from wavelake.streaming import ingest


def test_tiles_complete_in_any_order(spark, tmp_path):
    rows = [("a", 0, 1, 2), ("a", 1, 0, 3), ("a", 0, 0, 2), ("a", 0, 0, 2), ("a", 1, 2, 3), ("b", 5, 0, 1)]
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "image_id string, tileno long, part long, parts long").write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("image_id string, tileno long, part long, parts long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = ingest.run_once(spark, ingest.complete_tiles(stream), ["image_id", "tileno"]).collect()
    assert sorted((r.image_id, r.tileno, r.parts) for r in got) == [("a", 0, 2), ("b", 5, 1)]


def test_headers_of_arriving_files(spark, tmp_path):
    cols = "x0 y0 x1 y1 tdx tdy tx0 ty0 numcomps dx dy prec numres cblkw cblkh nlayers".split()
    g = spark.createDataFrame([(1, 2, 300, 200, 64, 48, 0, 0, 3, 2, 1, 12, 4, 5, 6, 2)], ", ".join(f"{c} long" for c in cols))
    content = bytes(g.select(headers.codestream_header(g).alias("c")).first().c)
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.j2k").write_bytes(content)
    (folder / "b.txt").write_bytes(b"nothing here")
    got = {r.path[-5:]: r for r in ingest.run_once(spark, ingest.image_headers(spark, str(folder)), ["path"]).collect()}
    r = got["a.j2k"]
    assert (r.format, r.x0, r.y1, r.tdx, r.tdy, r.numcomps, r.prec) == ("j2k", 1, 200, 64, 48, 3, 12)
    assert got["b.txt"].format == "unknown" and got["b.txt"].x0 is None


def test_graymaps_with_comments_and_two_bytes(spark):
    one = b"P5 # a comment\n3\n# more\n 2 255\n" + bytes([0, 1, 2, 253, 254, 255])
    two = b"P5\n1 2\n65535\n" + (258).to_bytes(2, "big") + (65000).to_bytes(2, "big")
    df = spark.createDataFrame([(1, one), (2, two)], "id long, c binary").select("id", F.explode(headers.read_graymap(F.col("c"))).alias("s"))
    got = {(r.id, r.y, r.x): r.v for r in df.select("id", "s.*").collect()}
    assert [got[1, y, x] for y in range(2) for x in range(3)] == [0, 1, 2, 253, 254, 255]
    assert (got[2, 0, 0], got[2, 1, 0]) == (258, 65000)


def test_tiles_with_state_and_timers(spark, tmp_path):
    """Complete ones once, however often their parts come; ones that lack a part when their time is over, and no state."""
    from datetime import datetime, timedelta

    from wavelake.streaming import parts

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    files = [
        [("a", 0, 1, 2, 5, at(0)), ("a", 1, 0, 3, 7, at(0)), ("b", 5, 0, 1, 9, at(1))],
        [("a", 0, 0, 2, 6, at(2)), ("a", 0, 0, 2, 6, at(2)), ("b", 5, 0, 1, 9, at(3))],
        [("c", 0, 0, 1, 1, at(500))],
        [("c", 1, 0, 1, 1, at(1000))],
    ]
    schema = "image_id string, tileno long, part long, parts long, length long, ts timestamp"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = ingest.run_once(spark, parts.completed(stream, patience_ms=60_000), ["image_id", "tileno", "complete"]).collect()
    assert sorted((r.image_id, r.tileno, r.parts, r.have, r.bytes, r.complete) for r in got) == [("a", 0, 2, 2, 11, True), ("a", 1, 3, 1, 7, False), ("b", 5, 1, 1, 9, True), ("c", 0, 1, 1, 1, True), ("c", 1, 1, 1, 1, True)]
