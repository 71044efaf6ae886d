"""Token-id files with a shared zstandard dictionary, and the scan of flat token files for separators.

Encoding uses the tokenizers library. It splits texts at places where its own pre-tokenizer splits too (white space,
and between ASCII letters, digits and punctuation), encodes each distinct piece of a block once, and puts the ids
together; texts where that could differ (special tokens spelled out) are encoded whole.

Dictionary files: rows in ascending doc_id order in parquet, each a block of documents: dictionary hash, doc ids, number
of tokens, offset index, and one zstandard frame for each document, so one short document is read by its block's id
range and its offset. The dictionary is trained on the serialized ids of a bounded sample (`sample` documents with the
smallest hashes) and lies beside the blocks.

Flat files: the ids of all documents in ascending doc_id order, each with the end id, cut into blocks of equal length
that know nothing of documents. Texts are encoded where they lie; what is shuffled into order is each document's ids as a
small compressed frame. separator_scan() finds the end ids of each block with one vectorised comparison and stitches
documents that cross blocks with a prefix scan of the blocks' summaries.

Null texts are empty documents with only the end id; null doc ids come first, and rows of equal doc_id follow each other
in the order of their texts' hashes. A text of any length is encoded whole, by one task. An empty table gives files
without rows. Further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, materialise, new_path, shuffle_partitions, table, text_bytes

VOCABULARY = "word_bpe_49k.json"
END = 2
SEPARATOR = 0xFFFF  # no id of the vocabulary: a text that spells <|endoftext|> encodes to that token
DICTIONARY_BYTES = 64 << 10
FLAT_TOKENS = 1 << 16
SAMPLE_TEXT = 32 << 10
PACK_LEVEL = 9
CACHED = 1 << 18

_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = 0, 1, 2, 3, 4
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _OTHER  # the apostrophe belongs to contractions
_CLASS[128:] = _OTHER
_CLASS[[0, *range(1, 9), *range(14, 32), 127]] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Pieces that are one word whatever stands beside them: one kind of ASCII characters, no apostrophe.
_PLAIN = r"\A(?:[a-z]+|[0-9]|[!-&(-/:-@\[-`{-~]+)\z"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- encoding -----------------------------------------------------------------------------------------------------


class Pieces:
    """Distinct pieces of texts (large binary) and the ids of each, one after the other: those of piece i lie at at[i] to
    at[i + 1]."""

    def __init__(self, names: pa.Array, ids: np.ndarray, at: np.ndarray):
        self.names, self.ids, self.at = names, ids, at

    @classmethod
    def of(cls, names: list[bytes], ids: list[np.ndarray]) -> Pieces:
        at = np.cumsum([0, *map(len, ids)])
        return cls(pa.array(names, pa.large_binary()), np.concatenate([np.zeros(0, np.uint32), *ids]), at)

    @classmethod
    def none(cls) -> Pieces:
        return cls.of([], [])

    def and_these(self, more: Pieces) -> Pieces:
        return Pieces(pa.concat_arrays([self.names, more.names]), np.append(self.ids, more.ids), np.append(self.at, self.at[-1] + more.at[1:]))

    def take(self, which: np.ndarray) -> Pieces:
        size = np.diff(self.at)[which]
        at = np.append(0, np.cumsum(size))
        ids = self.ids[np.arange(at[-1]) + np.repeat(self.at[which] - at[:-1], size)]
        return Pieces(self.names.take(pa.array(which)), ids, at)


class Encoder:
    """Encodes blocks of texts; keeps the ids of pieces it has met, the CACHED latest."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Pieces.none()
        mark = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # a plain piece is one word to the model: nothing to normalise or to split, and its last id says that it ends
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(names.values(), default=0) + 1, bool)
        self.last[[i for name, i in names.items() if suffix and name.endswith(suffix)]] = True
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: pa.Array) -> Pieces:
        """The ids of each piece, in the order of `pieces` (distinct)."""
        at = pc.index_in(pieces, value_set=self.known.names)
        fresh = self.encoded(pieces.filter(at.is_null()))
        both = self.known.and_these(fresh)
        where = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        where[where < 0] = len(self.known.names) + np.arange(len(fresh.names))
        # the pieces of this block are the latest: others are kept behind them as far as there is room
        rest = np.ones(len(both.names), bool)
        rest[where] = False
        self.known = both.take(np.append(where, np.flatnonzero(rest))[:CACHED])
        return both.take(where)

    def encoded(self, pieces: pa.Array) -> Pieces:
        """Pieces that were not met before, encoded many at a time: plain ones by the words' ends, others between marks
        that no piece contains."""
        one = pc.match_substring_regex(pieces.cast(pa.large_string()), _PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        out = []
        names = pieces.filter(pa.array(one))
        found = self.by_ends(names)
        if found is None:
            one[:] = False
        else:
            out.append(found)
        raw = pieces.filter(pa.array(~one)).to_pylist()
        marked = [self.mark is not None and b"0" not in p for p in raw]
        out.append(self.between([p for p, m in zip(raw, marked, strict=True) if m]))
        alone = [p for p, m in zip(raw, marked, strict=True) if not m]
        out.append(Pieces.of(alone, self.whole([p.decode() for p in alone])))
        found = out[0]
        for x in out[1:]:
            found = found.and_these(x)
        order = pc.index_in(pieces, value_set=found.names).to_numpy(zero_copy_only=False)
        return found.take(order)

    def by_ends(self, names: pa.Array) -> Pieces | None:
        """The ids of plain pieces; None if there are not as many ends as pieces."""
        step = np.append(np.arange(0, len(names), 400), len(names)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(step), names.cast(pa.string())), " ").to_pylist()
        parts = [np.array(e.ids, np.uint32) for k in range(0, len(lines), 64) for e in self.words.encode_batch_fast(lines[k : k + 64], add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(names) or (ends[-1] if len(ends) else 0) != len(ids):
            return None
        return Pieces(names, ids, np.append(0, ends))

    def between(self, pieces: list[bytes], step: int = 400) -> Pieces:
        """The ids of pieces without a mark, from texts that have a mark between any two."""
        groups = [pieces[k : k + step] for k in range(0, len(pieces), step)]
        ids, size = [], []
        for k in range(0, len(groups), 64):
            part = groups[k : k + 64]
            for g, v in zip(part, self.whole([b" 0 ".join(g).decode() for g in part]), strict=True):
                cut = np.flatnonzero(v == self.mark)
                if len(cut) == len(g) - 1:
                    ids.append(v[v != self.mark])
                    size.append(np.diff(cut, prepend=-1, append=len(v)) - 1)
                else:
                    ids += (alone := self.whole([p.decode() for p in g]))
                    size.append(np.fromiter(map(len, alone), np.int64, len(g)))
        return Pieces(pa.array(pieces, pa.large_binary()), np.concatenate([np.zeros(0, np.uint32), *ids]), np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *size]))))

    def block(self, data: np.ndarray, offsets: np.ndarray, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block of texts given as bytes and offsets."""
        n = len(offsets) - 1
        low = _LOWER[data]
        raw = low.tobytes()
        odd = np.zeros(n, bool)
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                odd[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(s, at + 1)
        kind = _CLASS[data]
        solid = kind != _SPACE
        first = solid.copy()
        if len(data):
            a, b = kind[:-1], kind[1:]
            split = (a != b) & (a < _OTHER) & (b < _OTHER) | (a == _DIGIT) & (b == _DIGIT)
            first[1:] &= split | ~solid[:-1]
            first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
            first &= solid
        starts = np.flatnonzero(first)
        kept = low[solid]
        at = np.zeros(len(starts) + 1, np.int64)
        at[:-1] = np.cumsum(solid)[starts] - 1 if len(starts) else 0
        at[-1] = len(kept)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)]).dictionary_encode()
        pieces = self.pieces(words.dictionary)
        flat, begin, size = pieces.ids, pieces.at[:-1], np.diff(pieces.at)
        which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        lens = size[which]
        where = np.cumsum(lens) - lens
        n_first = np.searchsorted(starts, offsets)
        cum = np.append(where, where[-1] + lens[-1] if len(lens) else 0)
        out = flat[np.arange(int(lens.sum())) - np.repeat(where - begin[which], lens)]
        bounds = cum[n_first]
        tail = 0 if end is None else 1
        parts_len = np.diff(bounds)
        if odd.any():
            parts = [out[bounds[i] : bounds[i + 1]] for i in range(n)]
            where_odd = np.flatnonzero(odd).tolist()
            for i, v in zip(where_odd, self.whole([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in where_odd]), strict=True):
                parts[i] = v
            out = np.concatenate(parts)
            parts_len = np.fromiter(map(len, parts), np.int64, n)
        o = np.zeros(n + 1, np.int64)
        np.cumsum(parts_len + tail, out=o[1:])
        if end is None:
            return out, o
        ids_out = np.full(o[-1], end, np.uint32)
        ids_out[np.arange(len(out)) + np.repeat(np.arange(n), parts_len)] = out
        return ids_out, o


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that its pieces serve later tasks too."""
    return Encoder(path)


# --- dictionary files ---------------------------------------------------------------------------------------------


def in_order(docs: DataFrame, partitions: int) -> DataFrame:
    """doc_id and text in ascending order over the partitions (and in them)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    return rows.repartitionByRange(partitions, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")


def train_dictionary(docs: DataFrame, path: str, sample: int = 1500) -> bytes:
    """A dictionary for serialized ids of documents like `docs`, from `sample` distinct texts of SAMPLE_TEXT bytes at most;
    empty if there are too few."""
    rows = docs.select("text").where("text is not null")
    share = min(1.0, 2.0 * sample / max(1, rows.count()))  # twice as many by a threshold, so that few texts are sorted
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    # of equal texts one, and long ones only as far as SAMPLE_TEXT bytes allow
    some = hashed.where(F.col("_h") <= int(share * (1 << 30))).where(F.octet_length("text") <= SAMPLE_TEXT).dropDuplicates(["_h", "text"])
    few = some.orderBy("_h", "text").limit(sample).select("text")

    def encoded(batches):
        for block in blocks(batches, limit=1 << 20):
            ids, o = encoder(path).block(*text_bytes(block))
            raw = ids.astype("<u2" if int(ids.max(initial=0)) < 65536 else "<u4")
            yield pa.RecordBatch.from_arrays([pa.array([raw[i:j].tobytes() for i, j in zip(o[:-1], o[1:], strict=True)], pa.binary())], names=["ids"])

    samples = [bytes(r["ids"]) for r in few.mapInArrow(encoded, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


FILE_SCHEMA = "part int, block int, start long, dictionary string, width int, doc_ids array<long>, n_tokens array<long>, offsets array<long>, frames binary"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end: int = END, partitions: int | None = None) -> None:
    """Write `docs` (doc_id, text) to the folder `path`: `dictionary` and `blocks`."""
    spark = docs.sparkSession
    trained = train_dictionary(docs, vocabulary)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, bytearray(trained))], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    known = spark.sparkContext.broadcast(trained)  # DICTIONARY_BYTES at most

    def rows(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(known.value) if known.value else None)
        start = 0
        for k, block in enumerate(blocks(batches, limit=4 << 20)):
            ids, o = encoder(vocabulary).block(*text_bytes(block), end)
            width = 2 if int(ids.max(initial=0)) < 65536 else 4
            raw = ids.astype(f"<u{width}")
            frames = [packer.compress(raw[i:j].tobytes()) for i, j in zip(o[:-1], o[1:], strict=True)]
            at = np.cumsum([0, *map(len, frames)])
            row = {"part": part, "block": k, "start": start, "dictionary": name, "width": width, "doc_ids": block.column("doc_id").to_pylist(), "n_tokens": np.diff(o), "offsets": at, "frames": b"".join(frames)}
            start += len(ids)
            yield pa.RecordBatch.from_pylist([row], schema=_FILE_ARROW)

    ordered = in_order(docs, partitions or shuffle_partitions(spark))
    ordered.mapInArrow(rows, FILE_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


_FILE_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("dictionary", pa.string()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())])


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    r = spark.read.parquet(f"{path}/dictionary").first()
    return r["hash"], bytes(r["bytes"])


def _frames(row: dict, name: str, unpacker) -> list[np.ndarray]:
    if row["dictionary"] != name:
        raise ValueError(f"block was written with dictionary {row['dictionary']}, found {name}")
    o, raw = row["offsets"], row["frames"]
    return [np.frombuffer(unpacker.decompress(raw[a:z]), f"<u{row['width']}") for a, z in zip(o[:-1], o[1:], strict=True)]


def _unpacker(trained: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    files = spark.read.parquet(f"{path}/blocks")
    name, trained = read_dictionary(spark, path)
    known = spark.sparkContext.broadcast(trained)

    def rows(batches):
        unpacker = _unpacker(known.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = _frames(row, name, unpacker)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                if n.tolist() != row["n_tokens"]:
                    raise ValueError("a frame does not have the number of tokens that its index says")
                at = row["start"] + np.cumsum(n) - n
                crc = [zlib.crc32(v.astype("<u4").tobytes()) for v in ids]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(n), row["part"], np.int32)), pa.array(at), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    found = files.mapInArrow(rows, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    # one row for each part: the ids of all parts before it
    sums = files.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = materialise(sums.select("part", (F.sum("n").over(before) - F.col("n")).alias("base")), "token-parts")
    return found.join(starts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of that id: their blocks are found by the index, only their frames are unpacked."""
    name, trained = read_dictionary(spark, path)
    unpacker = _unpacker(trained)
    out = []
    hits = spark.read.parquet(f"{path}/blocks").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    slim = hits.select("dictionary", "width", F.explode(F.filter(F.transform("doc_ids", lambda x, i: F.when(x == doc_id, i)), lambda i: i.isNotNull())).alias("i"), "offsets", "frames")
    for r in slim.select("dictionary", "width", F.expr("substring(frames, int(offsets[i] + 1), int(offsets[i + 1] - offsets[i]))").alias("frame")).collect():
        out += _frames({"dictionary": r["dictionary"], "width": r["width"], "offsets": [0, len(r["frame"])], "frames": bytes(r["frame"])}, name, unpacker)
    return out


def query_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def encode_documents(docs: DataFrame) -> DataFrame:
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary_path())
    return read_token_files(docs.sparkSession, path)


# --- flat files ---------------------------------------------------------------------------------------------------


def order_bounds(docs: DataFrame, parts: int) -> list[tuple]:
    """The first row of each of `parts` ranges of the documents in ascending (null first, doc_id, hash of the text)."""
    order = (F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    slim = docs.select(*order).repartitionByRange(parts, "known", "doc_id", "h").sortWithinPartitions("known", "doc_id", "h")

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    return sorted(tuple(r) for r in slim.mapInArrow(first, slim.schema).collect())  # a row for each part


def packed_ids(docs: DataFrame, vocabulary: str, end: int, width: int, bounds: list[tuple], trained: bytes) -> DataFrame:
    """(part, known, doc_id, h, frame): each document's ids as one small frame, so that ids and not texts are shuffled."""

    def rows(batches):
        packer = zstandard.ZstdCompressor(level=PACK_LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for block in blocks(batches, limit=4 << 20):
            ids, o = encoder(vocabulary).block(*text_bytes(block), end)
            if int(ids.max(initial=0)) >> 8 * width:
                raise ValueError(f"ids do not fit {width} bytes")
            if int((ids == end).sum()) != block.num_rows:
                raise ValueError("a text encodes to the separator")
            raw = ids.astype(f"<u{width}")
            frames = [packer.compress(raw[i:j].tobytes()) for i, j in zip(o[:-1], o[1:], strict=True)]
            keys = [block.column(c).to_pylist() for c in ("known", "doc_id", "h")]
            part = [max(0, bisect.bisect_right(bounds, k) - 1) for k in zip(*keys, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(block.column(c).combine_chunks() for c in ("known", "doc_id", "h")), pa.array(frames, pa.binary())], names=["part", "known", "doc_id", "h", "frame"])

    texts = docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    return texts.mapInArrow(rows, "part int, known boolean, doc_id long, h long, frame binary")


def write_flat_files(docs: DataFrame, path: str, vocabulary: str, end: int = END, tokens: int = FLAT_TOKENS, width: int = 2) -> None:
    """The ids of `docs` in ascending doc_id order as blocks of `tokens` ids of `width` bytes (part, block, ids); the last
    block of a part is shorter. doc_ids beside them names the documents that end in a block, without any place. An id
    that a text encodes to cannot be `end`, and ids must fit the width; else this raises an error."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    trained = train_dictionary(docs, vocabulary)

    def rows(batches):
        from pyspark import TaskContext

        part, k, rest = TaskContext.get().partitionId(), 0, np.zeros(0, f"<u{width}")
        names, at = [], np.zeros(0, np.int64)  # documents that end in `rest`, and where
        unpacker = _unpacker(trained)
        for block in blocks(batches, "frame", limit=2 << 20):
            found = [np.frombuffer(unpacker.decompress(f.as_py()), rest.dtype) for f in block.column("frame")]
            names += [i if known else None for known, i in zip(block.column("known").to_pylist(), block.column("doc_id").to_pylist(), strict=True)]
            at = np.append(at, len(rest) + np.cumsum([len(x) for x in found]) - 1)
            rest = np.concatenate([rest, *found])
            full = len(rest) // tokens
            if full:
                cut = np.searchsorted(at, np.arange(full + 1) * tokens).tolist()
                yield _flat(part, k, [rest[i * tokens : (i + 1) * tokens] for i in range(full)], [names[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)])
                k, rest = k + full, rest[full * tokens :]
                names, at = names[cut[-1] :], at[cut[-1] :] - full * tokens
        if len(rest):
            yield _flat(part, k, [rest], [names])

    packed = packed_ids(docs, vocabulary, end, width, order_bounds(docs, parts), trained)
    ordered = packed.repartitionById(parts, F.col("part")).sortWithinPartitions("known", "doc_id", "h")
    out = ordered.select("known", "doc_id", "frame").mapInArrow(rows, _FLAT)
    out.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(PACK_LEVEL)).parquet(path)


_FLAT = "part int, block int, ids binary, doc_ids array<long>"


def _flat(part: int, k: int, parts: list[np.ndarray], names: list[list]) -> pa.RecordBatch:
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(names, pa.list_(pa.int64()))], names=["part", "block", "ids", "doc_ids"])


def separator_scan(flat: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(doc, start, n_tokens) of each document in flat blocks (part, block, ids), doc counting from 0.

    Pass 1 gives each block's tokens, number of ends, and tokens after its last end; a two-level prefix scan (within
    parts, then over parts) gives for each block the documents and tokens before it and the open tokens that reach into
    it. Pass 2 lists the documents that end in the block. Tokens after the last end of all are one last document. With
    doc_ids in the blocks each row has its doc_id too.
    """
    named = "doc_ids" in flat.columns

    def summary(batches):
        for batch in batches:
            ids = [np.frombuffer(b.as_py(), f"<u{width}") for b in batch.column("ids")]
            hits = [np.flatnonzero(x == end) for x in ids]
            tail = [len(x) - (h[-1] + 1) if len(h) else -1 for x, h in zip(ids, hits, strict=True)]
            spans = [h.astype("<u4").tobytes() for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("block"), pa.array([len(x) for x in ids], pa.int64()), pa.array([len(h) for h in hits], pa.int64()), pa.array(tail, pa.int64()), pa.array(spans, pa.binary()), *([batch.column("doc_ids")] if named else [])], names=["part", "block", "n", "ends", "tail", "at", *(["doc_ids"] if named else [])])

    found = flat.select("part", "block", "ids", *(["doc_ids"] if named else [])).mapInArrow(summary, "part int, block int, n long, ends long, tail long, at binary" + (", doc_ids array<long>" if named else ""))
    found = materialise(found, "flat-ends")
    upto = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = found.select("part", "block", "n", "ends", "tail", F.sum("n").over(upto).alias("n_to"), F.sum("ends").over(upto).alias("ends_to"))
    # where the last end up to each block lies, in tokens of its part
    sums = sums.withColumn("last_to", F.max(F.when(F.col("ends") > 0, F.col("n_to") - F.col("tail"))).over(upto))
    sums = materialise(sums, "flat-sums")
    parts = sums.groupBy("part").agg(F.max("n_to").alias("n"), F.max("ends_to").alias("ends"), F.max("last_to").alias("last"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select("part", (F.sum("n").over(over) - F.col("n")).alias("base"), (F.sum("ends").over(over) - F.col("ends")).alias("docs"), "last")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialise(parts.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last")).over(earlier), F.lit(0))), "flat-parts")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("last_before", F.max("last_to").over(before)).join(parts.drop("last").hint("merge"), "part")
    placed = placed.select("part", "block", (F.col("base") + F.col("n_to") - F.col("n")).alias("base"), (F.col("docs") + F.col("ends_to") - F.col("ends")).alias("docs"), F.coalesce(F.col("base") + F.col("last_before"), F.col("open")).alias("open"), F.col("n").alias("size"))
    whole = found.join(placed.hint("merge"), ["part", "block"])

    def listed(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ends = r["base"] + np.frombuffer(r["at"], "<u4").astype(np.int64) + 1
                starts = np.append(r["open"], ends[:-1]) if len(ends) else ends
                yield pa.RecordBatch.from_arrays([pa.array(r["docs"] + np.arange(len(ends))), pa.array(starts), pa.array(ends - starts), *([pa.array(r["doc_ids"], pa.int64())] if named else [])], names=["doc", "start", "n_tokens", *(["doc_id"] if named else [])])

    closed = whole.select("base", "docs", "open", "at", *(["doc_ids"] if named else [])).mapInArrow(listed, "doc long, start long, n_tokens long" + (", doc_id long" if named else ""))
    # one row for each part; what follows the last end of all
    whole_parts = parts.join(sums.groupBy("part").agg(F.max("n_to").alias("n"), F.max("ends_to").alias("ends")).hint("merge"), "part")
    final = whole_parts.agg(F.sum("ends").alias("doc"), F.coalesce(F.max(F.col("base") + F.col("last")), F.lit(0)).alias("start"), F.sum("n").alias("n"))
    final = final.select("doc", "start", (F.col("n") - F.col("start")).alias("n_tokens")).where("n_tokens > 0")
    return closed.unionByName(final, allowMissingColumns=True)


def query_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "flat-tokens")
    write_flat_files(table(spark, sf_dir, "documents"), path, vocabulary_path(), SEPARATOR)
    return separator_scan(spark.read.schema(_FLAT).parquet(path), SEPARATOR)
