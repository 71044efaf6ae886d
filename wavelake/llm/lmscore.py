"""Language-model scores by deleted interpolation.

Tokens are the words of a text (A-Z lower-cased) and one end. The model mixes maximum-likelihood estimates of orders
`order` ... 1 and the uniform 1/(V+1); the weights of the mix depend on the bucket of the context's frequency and are
learned by expectation-maximisation on held-out counts: one fold of the training documents is deleted from the counts,
and its tokens are what the weights must explain. The final score uses the counts of all training documents.

How it runs. A task turns a block of texts (about BLOCK bytes) into a row: the hashes of the block's distinct words and
each text's words as numbers into them. These rows are a table bucketed by block. Counts are then made order by order: a
block sends its distinct n-grams (hashes, counts in training and in the deleted fold) to shards by hash, packed in arrays;
a shard adds up the counts of equal n-grams and sends every block the totals of its n-grams, in the block's own order.
These answers are tables bucketed by block too, so later rounds and both reading passes (counts of the held-out fold by
cells for the weights, then the scores) join without a shuffle. If a shorter n-gram occurs in no other
block, neither does any longer one around it: the block counts these itself, and only n-grams of which both shorter parts
also occur elsewhere are sent. No n-gram table is ever in one place; what one task holds is a block or a
shard. Blocks are of one size and shards grow in number with the shuffle partitions; only shards that a block has n-grams
of get a row, so there are never more rows than n-grams.

Two words are taken for one if their 64-bit hashes agree. Longer n-grams have so many bits that one in a million of them
meets another's hash whatever the corpus's size: 20 more than the number of tokens has.

Null texts are empty (one end token). Null ids are kept and train. Equal rows train as often as they occur, and ties do
not arise. A text is never cut: one of any length makes a block of its own. Without training tokens every estimate is the
uniform one. An empty table gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, bucketed, crc_mod, drop_table, materialise, mix64, shuffle_partitions, table, text_bytes

FOLDS, HELD_OUT, DELETED = 7, 2, 3
END = np.uint64(0x656E64)  # stands for the end of a text among word hashes
START = np.uint64(0x7374617274)  # and for the start, as a context
BUCKETS = 24
BLOCK = 4 << 20
CELL = 2.0  # cells of the held-out counts: steps of 1/CELL in log2 of each estimate


# --- arrays as bytes ----------------------------------------------------------------------------------------------


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, high ones first, compressed if they are many."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T.tobytes()
    return bytes([width]) + planes if len(planes) < 64 else bytes([width | 128]) + zstandard.ZstdCompressor(level=3).compress(planes)


def unpacked(b: bytes) -> np.ndarray:
    width, raw = b[0] & 127, b[1:]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw) if b[0] & 128 else raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - width :] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


# --- blocks of word numbers ---------------------------------------------------------------------------------------


def word_blocks(docs: DataFrame, limit: int = BLOCK) -> DataFrame:
    """One row for each block of texts: ids, folds and numbers of words of its texts, hashes of its distinct words, and
    all words as numbers into them (frequent words have low ones)."""

    def rows(batches):
        for block in blocks(batches, limit=limit):
            words = Words(*text_bytes(block))
            found = words.array().dictionary_encode()
            which = found.indices.to_numpy(zero_copy_only=False) if len(found) else np.zeros(0, np.int32)
            digest = xxhash.xxh64_intdigest
            hashes = np.fromiter(map(digest, found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
            often = np.argsort(-np.bincount(which, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often))
            row = {"block": uuid.uuid4().int & (1 << 63) - 1, "tokens": len(which) + block.num_rows, "doc_ids": block.column("doc_id").to_pylist(), "folds": block.column("fold").to_pylist(), "sizes": packed(np.diff(words.first)), "hashes": hashes[often].tobytes(), "words": packed(rank[which])}
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    return docs.select("doc_id", "fold", "text").mapInArrow(rows, "block long, tokens long, doc_ids array<long>, folds array<int>, sizes binary, hashes binary, words binary")


_BLOCK = pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("folds", pa.list_(pa.int32())), ("sizes", pa.binary()), ("hashes", pa.binary()), ("words", pa.binary())])


class Grams:
    """The n-grams of a block: for each order 1..order the distinct keys, and for each token the place of its n-gram.

    Tokens are the words of each text and its end; the context at a text's start is START. Keys of order 1 have 64 bits,
    the others `bits`.
    """

    def __init__(self, row: dict, order: int, bits: int):
        self.n = unpacked(row["sizes"]).astype(np.int64)
        self.folds = np.array([-1 if f is None else f for f in row["folds"]], np.int64)
        self.bits = [64] + [bits] * (order - 1)
        hashes = np.append(np.frombuffer(row["hashes"], np.uint64), END)
        words = unpacked(row["words"])
        docs = len(self.n)
        self.doc = np.repeat(np.arange(docs, dtype=np.int32), self.n + 1)
        token = np.full(len(words) + docs, len(hashes) - 1, np.int32)
        self.first = np.cumsum(self.n + 1) - (self.n + 1)
        token[np.arange(len(words)) + np.repeat(np.arange(docs), self.n)] = words
        fold = self.folds[self.doc]
        self.train, self.deleted = fold != HELD_OUT, fold == DELETED
        met = np.bincount(token, minlength=len(hashes)) > 0
        number = (np.cumsum(met) - 1).astype(np.int32)
        self.keys, self.place = [hashes[met]], [number[token]]
        context = of = hashes[token]
        for _ in range(2, order + 1):
            before = np.append(START, context[:-1])
            before[self.first] = START
            context = mix64(before * np.uint64(0x9E3779B97F4A7C15) + of)
            key = context >> np.uint64(64 - bits)
            by = np.argsort(key)
            up = key[by]
            new = np.append(True, up[1:] != up[:-1]) if len(up) else np.zeros(0, bool)
            place = np.empty(len(by), np.int32)
            place[by] = np.cumsum(new) - 1
            self.keys.append(up[new])
            self.place.append(place)

    def counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the keys of order k in training, and in the deleted fold."""
        size = len(self.keys[k - 1])
        return tuple(np.bincount(self.place[k - 1], m, size).astype(np.uint32) for m in (self.train, self.deleted))

    def in_shards(self, k: int, open_: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(the open keys of order k in sorted order, bounds of the shards in it). Shards are ranges of hashes, so that
        sorted keys of one shard share their high bits."""
        keys, by = self.keys[k - 1], np.flatnonzero(open_)
        if k == 1:
            by = by[np.argsort(keys[by])]
        shard = (keys[by] >> np.uint64(self.bits[k - 1] - 32)) * np.uint64(shards) >> np.uint64(32)
        return by, np.searchsorted(shard.astype(np.int64), np.arange(shards + 1))

    def open_after(self, k: int, foreign: np.ndarray) -> np.ndarray:
        """Whether each key of order k + 1 can occur elsewhere: both its parts of order k do (at a text's start, the one)."""
        here = foreign[self.place[k - 1]]
        before = np.append(True, here[:-1]) if len(here) else here
        before[self.first] = True
        out = np.zeros(len(self.keys[k]), bool)
        out[self.place[k][here & before]] = True
        return out

    def totals(self, row: dict, shards: int, orders: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(counts in training and the deleted fold over all blocks of the keys of orders 1..orders, whether each key of
        the next order is to be sent), by the answers of the row."""
        out, open_ = [], np.ones(len(self.keys[0]), bool)
        for k in range(1, orders + 1):
            answers = {a["shard"]: a for a in row[f"answers{k}"] or ()}
            by, cut = self.in_shards(k, open_, shards)
            some = np.flatnonzero(np.diff(cut)).tolist()
            total = [*(c.astype(np.int64) for c in self.counts(k)), np.zeros(len(open_), np.int64)]
            for t, what in zip(total, ("train", "deleted", "foreign"), strict=True):
                t[by] = np.concatenate([unpacked(answers[s][what]) for s in some]) if some else 0
            out.append(tuple(total[:2]))
            if k < len(self.keys):
                open_ = self.open_after(k, total[2] > 0)
        return out, open_


# --- adding up over all blocks ------------------------------------------------------------------------------------


_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("train", pa.binary()), ("deleted", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("train", pa.binary()), ("deleted", pa.binary()), ("foreign", pa.binary()), ("new", pa.int64()), ("tokens", pa.int64())])


def total_counts(texts: DataFrame, k: int, bits: int, shards: int) -> DataFrame:
    """(block, shard, train, deleted, foreign, new, tokens): totals of each block's open n-grams of order k of a shard, in
    the block's order, and whether another block has them. texts: with the answers of lower orders. new: distinct n-grams of the shard in training, told to one
    block only; tokens: their sum, likewise."""

    def sent(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                g = Grams(row, k, bits)
                _, open_ = g.totals(row, shards, k - 1)
                by, cut = g.in_shards(k, open_, shards)
                some = np.flatnonzero(np.diff(cut)).tolist()
                parts = [by[cut[s] : cut[s + 1]] for s in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), *(pa.array([packed(x[p]) for p in parts], pa.binary()) for x in (g.keys[k - 1], *g.counts(k)))], schema=_SENT)

    def added(parts: pa.Table) -> pa.Table:
        keys, train, deleted = ([unpacked(b.as_py()) for b in parts.column(c)] for c in ("keys", "train", "deleted"))
        size = np.array([len(k) for k in keys])
        every = np.concatenate(keys)
        by = np.argsort(every)
        up = every[by]
        cut = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
        group = np.empty(len(by), np.int64)
        many = np.diff(np.append(cut, len(by)))  # blocks that have the n-gram
        group[by] = np.repeat(np.arange(len(cut)), many)
        t = np.add.reduceat(np.concatenate(train)[by], cut)
        d = np.add.reduceat(np.concatenate(deleted)[by], cut)
        ends = np.cumsum(size)
        split = lambda x: [packed(x[group[e - n : e]]) for n, e in zip(size, ends, strict=True)]
        news, tokens = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        news[0], tokens[0] = int((t > 0).sum()), int(t.sum())
        return pa.Table.from_arrays([parts.column("block"), parts.column("shard"), *(pa.array(split(c), pa.binary()) for c in (t, d, many > 1)), pa.array(news), pa.array(tokens)], schema=_ANSWER)

    rows = texts.mapInArrow(sent, "shard int, block long, keys binary, train binary, deleted binary")
    return rows.groupBy("shard").applyInArrow(added, "block long, shard int, train binary, deleted binary, foreign binary, new long, tokens long")


# --- the mix ------------------------------------------------------------------------------------------------------


def estimates(g: Grams, totals: list, facts: tuple[int, int], starts: int, held: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, bucket, known): rows of estimates of each token, highest order first, the uniform last; bucket of the
    context's frequency; counts of the tokens' words. held: without the deleted fold (starts without it too)."""
    n, v = facts
    count = [((t - d) if held else t)[p] for (t, d), p in zip(totals, g.place, strict=True)]
    p = [np.full(len(g.doc), 1 / (v + 1)), count[0] / max(n, 1)]
    bucket = None
    for k in range(1, len(count)):
        # how often the context occurs: the count of the (k)-gram before; each word is followed by a token
        context = np.append(0, count[k - 1][:-1])
        context[g.first] = starts
        p.append(np.divide(count[k], context, out=np.zeros(len(context)), where=context > 0))
        bucket = np.minimum(np.ceil(np.log2(context + 1)), BUCKETS - 1).astype(np.int64)
    if bucket is None:
        bucket = np.zeros(len(g.doc), np.int64)
    return np.stack(p[::-1], axis=1), bucket, count[0]


def learn_weights(cells: np.ndarray, p: np.ndarray, bucket: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (BUCKETS, estimates) by expectation-maximisation; cells: number of tokens of each row of p."""
    weights = np.full((BUCKETS, p.shape[1]), 1 / p.shape[1])
    for _ in range(rounds):
        part = weights[bucket] * p
        part = part / np.maximum(part.sum(1, keepdims=True), 1e-300) * cells[:, None]
        total = np.zeros_like(weights)
        np.add.at(total, bucket, part)
        total = total + 0.5  # buckets without held-out tokens stay even
        weights = total / total.sum(1, keepdims=True)
    return weights


def cells_of(p: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """One number for each row of estimates (the uniform one left out) and its bucket; estimates in steps of 1/CELL in log2."""
    low = np.where(p > 0, np.round(CELL * np.log2(np.maximum(p, 1e-30))), -999).astype(np.int64)
    key = bucket.astype(np.int64)
    for k in range(p.shape[1]):
        key = key * 1024 - low[:, k]  # 999: an estimate of zero
    return key


def weights_of(cells: dict[int, int], order: int, v: int) -> np.ndarray:
    """Weights from the number of held-out tokens of each cell; even ones without any."""
    if not cells:
        return np.full((BUCKETS, order + 1), 1 / (order + 1))
    key = np.array(sorted(cells))
    low = np.column_stack([(key >> 10 * (order - 1 - k)) & 1023 for k in range(order)])
    p = np.column_stack([np.where(low == 999, 0.0, 2.0 ** (-low / CELL)), np.full(len(key), 1 / (v + 1))])
    return learn_weights(np.array([cells[k] for k in key.tolist()], float), p, key >> 10 * order)


def score(docs: DataFrame, order: int = 3, folds: int = FOLDS, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    shards = 4 * shuffle_partitions(spark)
    texts = bucketed(word_blocks(docs.select("doc_id", crc_mod("doc_id", folds).alias("fold"), "text"), block_bytes), "lm_texts", "block")
    bits = min(64, max(40, int(texts.agg(F.sum("tokens")).first()[0] or 0).bit_length() + 20))
    joined, made = texts, [texts]
    for k in range(1, order + 1):
        found = total_counts(joined, k, bits, shards).groupBy("block").agg(F.collect_list(F.struct("shard", "train", "deleted", "foreign", "new", "tokens")).alias(f"answers{k}"))
        made.append(bucketed(found, f"lm_answers{k}", "block"))
        joined = joined.join(made[-1].hint("merge"), "block", "left")
    sums = made[1].select(F.explode("answers1").alias("a")).agg(F.sum("a.new").alias("v"), F.sum("a.tokens").alias("n")).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    marks = docs.select(crc_mod("doc_id", folds).alias("fold")).groupBy("fold").count().collect()
    starts = sum(r["count"] for r in marks if r["fold"] != HELD_OUT)
    deleted = sum(r["count"] for r in marks if r["fold"] == DELETED)

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                g = Grams(row, order, bits)
                yield row, g, g.totals(row, shards, order)[0]

    def cells(batches):
        for _, g, totals in read(batches):
            p, bucket, _ = estimates(g, totals, (n, v), starts - deleted, True)
            live = g.deleted
            rows, many = np.unique(cells_of(p[live, :-1], bucket[live]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(many.astype(np.int64))], names=["cell", "n"])

    # a row for each cell: at most BUCKETS times the steps of `order` estimates, whatever the corpus's size
    found = joined.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = weights_of({r["cell"]: r["n"] for r in found}, order, v)

    def scored(batches):
        for row, g, totals in read(batches):
            p, bucket, known = estimates(g, totals, (n, v), starts, False)
            logp = np.log10(np.maximum((weights[bucket] * p).sum(1), 1e-300))
            base = np.log10((known + 1) / (n + 1 * (v + 1)))
            add = lambda x: np.add.reduceat(x, g.first) if len(g.first) else np.zeros(0)
            size = g.n + 1
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(g.folds == HELD_OUT), pa.array(size), pa.array(add((known > 0).astype(np.int64))), pa.array(np.full(len(size), n)), pa.array(add(base)), pa.array(add(logp))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = materialise(joined.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
    for t in made:
        drop_table(t)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

