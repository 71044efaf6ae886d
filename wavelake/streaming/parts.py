"""Tiles of a stream of tile-parts, with state that is kept for each tile and dropped in time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.exprs import once

_LONG = lambda n: StructType([StructField(n, LongType())])


class TileParts(StatefulProcessor):
    """The parts of one tile: told, its number of parts and whether all have come, and the length of each part that has.

    A tile is given when its last part comes. Its mark stays until its timer, so that parts that come twice give it no
    second time. A timer that finds parts missing gives the tile as it is; either way nothing stays."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", StructType([StructField("parts", LongType()), StructField("done", LongType())]))
        self.have = handle.getMapState("have", _LONG("part"), _LONG("length"))

    @staticmethod
    def _out(key, parts: int, lengths: list[int], complete: bool) -> Row:
        return Row(image_id=key[0], tileno=key[1], parts=parts, have=len(lengths), bytes=sum(lengths), complete=complete)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.told.get() if self.told.exists() else None
        parts, done = known or (0, 0)
        come: dict[int, int] = {}
        for r in rows:
            parts = max(parts, r.parts)
            come[r.part] = max(come.get(r.part, 0), r.length)  # of a part that comes twice the longer
        if known is None:
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.patience)
        if not done:
            held = {k[0]: v[0] for k, v in self.have.iterator()} if known else {}
            now = held | {k: max(v, held.get(k, 0)) for k, v in come.items()}
            if len(now) >= parts:
                yield self._out(key, parts, list(now.values()), True)
                done = 1
                if held:
                    self.have.clear()
            else:  # only what is new is written
                for k, v in come.items():
                    if held.get(k) != now[k]:
                        self.have.updateValue((k,), (now[k],))
        if known != (parts, done):
            self.told.update((parts, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        parts, done = self.told.get() if self.told.exists() else (0, 1)
        if not done:
            yield self._out(key, parts, [v[0] for v in self.have.values()], False)
            self.have.clear()
        self.told.clear()

    def close(self) -> None:
        pass


def _on_disk(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def completed_sums(parts: DataFrame) -> DataFrame:
    """(image_id, tileno, parts, have, bytes) of the tiles of a stream of parts (as for completed()) all of whose parts have
    come, in any order and more than once; of a part that comes twice the longer counts. The state is an aggregate's: no
    tile goes through Python, and none is given or dropped by time. Update or complete mode."""
    _on_disk(parts.sparkSession)
    part = F.struct(F.col("part").cast("long").alias("part"), F.col("length").cast("long").alias("length"))
    seen = parts.groupBy("image_id", "tileno").agg(F.sort_array(F.collect_set(part)).alias("p"), F.max(F.col("parts").cast("long")).alias("parts"))
    # the last of each number is its longest
    seen = once(seen, "kept", F.filter("p", lambda p, i: ~F.coalesce(F.get("p", i + 1)["part"] == p["part"], F.lit(False))))
    total = F.aggregate("kept", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return seen.where(F.size("kept") >= F.col("parts")).select("image_id", "tileno", "parts", F.size("kept").cast("long").alias("have"), total.alias("bytes"))


def completed(parts: DataFrame, late: str = "10 minutes", patience_ms: int = 3_600_000) -> DataFrame:
    """(image_id, tileno, parts, have, bytes, complete) of a stream of parts (image_id, tileno, part, parts, length, ts): a
    tile when its last part has come, or as it is when the watermark has passed its first part by `patience_ms`. Parts come
    in any order and more than once; a part's number has one byte, so a tile's state is bounded."""
    _on_disk(parts.sparkSession)
    kinds = dict(parts.dtypes)
    keyed = parts.select("image_id", "tileno", F.col("part").cast("long").alias("part"), F.col("parts").cast("long").alias("parts"), F.col("length").cast("long").alias("length"), "ts").withWatermark("ts", late)
    out = f"image_id {kinds['image_id']}, tileno {kinds['tileno']}, parts long, have long, bytes long, complete boolean"
    return keyed.groupBy("image_id", "tileno").transformWithState(TileParts(patience_ms), outputStructType=out, outputMode="Update", timeMode="EventTime")
