"""What the operators of this subpackage share: materialised tables, text blocks, word splitting, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes and rows that a task holds at once.
BLOCK_BYTES = 6 << 20
BLOCK_ROWS = 20_000

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- tables -----------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as SQL and schemas read it, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def whole_rows(docs: DataFrame) -> Column:
    """All columns of `docs`, whatever their names, as one struct; fields_of() takes them out again."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns))


def fields_of(names: list[str], row: str = "row") -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new local one is set only where none is (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends here, and later plans see real sizes."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def bucketed(df: DataFrame, label: str, key: str, dealt: bool = False) -> DataFrame:
    """`df` written once as a table bucketed by `key`: joins on it do not shuffle this side. dealt: many small rows,
    which are shuffled to their buckets first, so that a bucket is one file and not one of each task. The catalogue keeps
    no entry of it: what is returned holds the files and their buckets."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = shuffle_partitions(spark) if dealt else 4 * shuffle_partitions(spark)  # large rows: few in a bucket
    df = df.repartition(buckets, key) if dealt else df
    path = new_path(spark, label)
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")  # the files stay
    out._path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of materialise() that no later plan reads."""
    jvm, path = df.sparkSession._jvm, df._path
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % m, F.lit(0).cast("long")).cast("int")


def held_out(doc_id: str, m: int) -> Column:
    return crc_mod(doc_id, m) == 2


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- text in Arrow batches ----------------------------------------------------------------------------------------


def offsets_of(a: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    if len(a) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(a.buffers()[1], dtype=kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, most: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """Batches regrouped so that each has about `limit` bytes in `column`, one row at least and `most` at most."""
    held, size, rows = [], 0, 0
    for batch in batches:
        o = offsets_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(o, o[at] + limit - size, side="right")) - 1
            to = min(max(to, at + (not held)), at + most - rows, batch.num_rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                size, rows = size + int(o[to] - o[at]), rows + to - at
            if to < batch.num_rows or size >= limit or rows >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, rows = [], 0, 0
            at = to
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        held = []
    release()


def release() -> None:
    """Gives free memory back to the system: a Python worker that waits for its next task, or for another operator's,
    would else hold the most that it ever used."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_bytes(block: pa.Table, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    a = block.column(column)
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], pa.string())
    if a.null_count:
        a = a.fill_null(b"" if pa.types.is_binary(a.type) else "")
    o = offsets_of(a)
    data = a.buffers()[2] if len(a) else None
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return b, o - o[0]


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a block of texts.

    data: the block's bytes, lower-cased (A-Z) unless told otherwise; starts, ends: of each word; first: of each
    text the index of its first word, and after the last the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        self.solid = solid = ~_WS[data]
        first, last = solid.copy(), solid.copy()
        if len(data):
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            some = offsets[:-1] < offsets[1:]
            a, z = offsets[:-1][some], offsets[1:][some] - 1
            first[a], last[z] = solid[a], solid[z]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def array(self) -> pa.Array:
        """The words as an Arrow array."""
        o = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=o[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(o), pa.py_buffer(self.data[self.solid])])

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with one space after each, and the starts and ends of the words in that."""
        n = self.ends - self.starts
        o = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n + 1, out=o[1:])
        out = np.full(o[-1], 32, np.uint8)
        kept = self.data[self.solid]
        out[np.arange(len(kept)) + np.repeat(np.arange(len(n)), n)] = kept
        return out.tobytes(), o[:-1], o[1:] - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- connected components -----------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (src, dst; one type); component: the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows these pointers four steps, and contracts the
    edges; the rounds' maps are composed at the end. All steps are joins of written tables and aggregates, so hubs
    are split by the adaptive skew join or combined before their shuffle, and nothing is collected. Self-loops keep
    lone nodes; edges with a null end are no edges.
    """
    e = materialise(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "cc-edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    maps: list[DataFrame] = []
    live = e.where("src <> dst")
    for k in range(rounds):
        if live.isEmpty():
            break
        both = live.select("src", "dst").union(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooked = materialise(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("up")).select("node", F.least("node", "up").alias("up")), f"cc-hook{k}")
        for j in range(2):
            higher = hooked.select(F.col("node").alias("n2"), F.col("up").alias("up2"))
            step = hooked.join(higher.where("n2 <> up2").hint("merge"), F.col("up") == F.col("n2"), "left").select("node", F.coalesce("up2", "up").alias("up"))
            nxt = materialise(step, f"cc-jump{k}.{j}")
            drop_table(hooked)
            hooked = nxt
        a = hooked.select(F.col("node").alias("src"), F.col("up").alias("u1"))
        b = hooked.select(F.col("node").alias("dst"), F.col("up").alias("u2"))
        moved = live.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("u1 <> u2")
        nxt = materialise(moved.select(F.greatest("u1", "u2").alias("src"), F.least("u1", "u2").alias("dst")).distinct(), f"cc-edges{k}")
        if k:
            drop_table(e)
        else:
            nodes = materialise(nodes, "cc-nodes")
            drop_table(e)
        maps.append(hooked)
        e, live = nxt, nxt
    else:
        raise RuntimeError("components did not settle")
    out = nodes.select("node", F.col("node").alias("component"))
    for k, m in enumerate(maps):
        m = m.select(F.col("node").alias("n2"), "up")
        out = out.join(m.hint("merge"), F.col("component") == F.col("n2"), "left").select("node", F.coalesce("up", "component").alias("component"))
        out = materialise(out, f"cc-map{k}")
    return out
