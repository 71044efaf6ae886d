"""Mixing sources to target weights.

Sources are ranked by code point (null last) and weigh 5, 2, 1, repeating. Their targets share the words of all
documents by weight; a target stops at three times its source's words, and the excess goes to the others by weight
until none is above. The words of each source are laid end to end and packed into blocks of `block_words`. The output
is a row of shards of `shard_slots` slots, and each shard draws its slots' sources from one multinomial. Over all shards
a source is then drawn somewhat more or less often than its target says (by the square root of its slots); the surplus
slots, spread over all shards by a permutation of the source's slots, go to the sources that lack some, so that the
totals are the targets' whole numbers. The j-th slot of a source takes block `permutation(j mod blocks)`, with a new
pseudorandom permutation for each pass over the source. No source gets more slots than three passes have. Joining slots
and blocks by (source, block) gives how often each block, and so each document, is taken.

Null texts and texts without words have size 0 and are never taken; a null source is a source; a null doc_id is an id
like others; equal rows each keep their own place; ties of a source's order go by id, then by a hash of the row. A text
of any length is one row, and spans as many blocks as it fills. An empty table gives an empty mix. The sources' totals
(one row for each source) are the only thing that the driver gathers; columns of any name are carried unread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Words, fields_of, materialise, mix64, shuffle_partitions, table, whole_rows

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most=MOST) -> dict[str | None, float]:
    """Words that each source is to give."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in names if s in open_ and left * weight[s] / whole >= most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in full)
        open_ -= set(full)
    return {s: out[s] for s in names}


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The j-th value of a pseudorandom permutation of range(n), row by row: a four-round Feistel network on the
    smallest even number of bits that holds n, walked until the value is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = j.astype(np.uint64).copy(), np.arange(len(j))
    while len(todo):
        x, h, m = out[todo], half[todo], mask[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (mix64(right + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def laid_out(docs: DataFrame, block_words: int) -> DataFrame:
    """doc_id, src (rank of the source), size, at (words of the source before it), tag of each row with words.

    Rows are dealt to lots by a hash, so that no source's running sum is one task; at = start of the lot + place in it.
    """
    lots = 8 * shuffle_partitions(docs.sparkSession)
    rows = docs.withColumn("lot", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(lots)).cast("int"))
    within = Window.partitionBy("src", "lot").orderBy("doc_id", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("src", "lot").agg(F.sum("size").alias("lot_size"))
    before = Window.partitionBy("src").orderBy("lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = materialise(sums.select("src", "lot", (F.sum("lot_size").over(before) - F.col("lot_size")).alias("lot_at")), "mix-lots")
    placed = rows.withColumn("in_lot", F.sum("size").over(within) - F.col("size"))
    return placed.join(starts.hint("merge"), ["src", "lot"]).select("doc_id", "tag", "src", "size", (F.col("lot_at") + F.col("in_lot")).alias("at"))


def whole_slots(want: np.ndarray, total: int) -> np.ndarray:
    """`want` as whole numbers of sum `total`, by the largest remainders."""
    out = np.floor(want).astype(np.int64)
    rest = np.argsort(out - want, kind="stable")
    out[rest[: total - int(out.sum())]] += 1
    return out


def reassigned(src: np.ndarray, j: np.ndarray, drawn: np.ndarray, wanted: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(source, slot of it) of slots that were drawn as the j-th of a source: `drawn` slots of each source become
    `wanted` ones. A permutation of the source's slots says which are surplus; these fill up the sources that lack some."""
    j = permuted(j, drawn[src], mix64(src.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)))
    over, under = np.maximum(drawn - wanted, 0), np.maximum(wanted - drawn, 0)
    surplus = j >= wanted[src]
    nth = (np.cumsum(over) - over)[src[surplus]] + j[surplus] - wanted[src[surplus]]
    to = np.searchsorted(np.cumsum(under), nth, side="right")
    src, j = src.copy(), j.copy()
    src[surplus], j[surplus] = to, drawn[to] + nth - (np.cumsum(under) - under)[to]
    return src, j


def mixed_blocks(spark: SparkSession, sources: list[tuple[int, int, float]], seed: int, block_words: int, shard_slots: int, most: int = MOST) -> DataFrame:
    """(src, block, uses) of the blocks that the mix takes. sources: (rank, words, target words)."""
    ranks = np.array([s[0] for s in sources], np.int64)
    words = np.array([s[1] for s in sources], np.int64)
    n_blocks = -(-words // block_words)
    want = np.array([s[2] for s in sources]) * n_blocks / words  # slots: a block holds words / n_blocks on average
    total = int(round(want.sum()))
    shards = -(-total // shard_slots)
    share = want / want.sum()
    wanted = np.minimum(whole_slots(want, total), most * n_blocks)
    lot_shards = 512

    def draw(batches):
        for pdf in batches:
            ids = pdf["id"].to_numpy(np.int64)
            n = [np.random.default_rng([seed, int(i)]).multinomial(min(shard_slots, total - int(i) * shard_slots), share) for i in ids]
            yield pd.DataFrame({"shard": np.repeat(ids, len(ranks)), "nth": np.tile(np.arange(len(ranks)), len(ids)), "n": np.concatenate(n) if n else np.zeros(0, np.int64)})

    counts = spark.range(0, shards, 1, max(1, min(shards, shuffle_partitions(spark)))).mapInPandas(draw, "shard long, nth long, n long").withColumn("lot", F.expr(f"shard div {lot_shards}"))
    counts = materialise(counts, "mix-counts")
    # slots of a source before each shard: within lots of shards, then over lots, so that no window has a row for each shard
    upto = Window.partitionBy("nth").orderBy("lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lots = counts.groupBy("nth", "lot").agg(F.sum("n").alias("lot_n")).withColumn("lot_first", F.sum("lot_n").over(upto) - F.col("lot_n"))
    within = Window.partitionBy("nth", "lot").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("in_lot", F.sum("n").over(within) - F.col("n")).join(lots.hint("merge"), ["nth", "lot"])
    placed = placed.where("n > 0").select("shard", "nth", "n", (F.col("lot_first") + F.col("in_lot")).alias("first"))
    sums = {r["nth"]: r["n"] for r in counts.groupBy("nth").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    drawn = np.array([sums[i] for i in range(len(ranks))], np.int64)

    def slots(batches):
        for pdf in batches:
            n, first = pdf["n"].to_numpy(np.int64), pdf["first"].to_numpy(np.int64)
            nth = np.repeat(pdf["nth"].to_numpy(np.int64), n)
            j = np.arange(len(nth)) - np.repeat(np.cumsum(n) - n - first, n)
            nth, j = reassigned(nth, j, drawn, wanted, seed)
            keep = j < wanted[nth]
            nth, j = nth[keep], j[keep]
            of, src = n_blocks[nth], ranks[nth]
            key = mix64(np.uint64(seed) + mix64(src.astype(np.uint64) * np.uint64(1 << 32) + (j // of).astype(np.uint64)))
            yield pd.DataFrame({"src": src, "block": permuted(j % of, of, key)})

    dealt = placed.repartition(shuffle_partitions(spark), "shard", "nth").mapInPandas(slots, "src long, block long")
    return dealt.groupBy("src", "block").agg(F.count("*").alias("uses"))


def mix(docs: DataFrame, seed: int = 20240, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: doc_id, tag0, tag, size, source_size, target, taken for each row of `docs`; tag
    tells all rows of one doc_id apart, tag0 only those that differ. pieces: doc_id, tag, size, lo, hi, uses: words [lo, hi) of a document that are taken."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", "source").alias("tag"))
    alike = Window.partitionBy("doc_id", "tag").orderBy("size")
    rows = rows.withColumn("nth", F.row_number().over(alike)).select("doc_id", F.col("tag").alias("tag0"), F.xxhash64("tag", "nth").alias("tag"), "source", "size")
    rows = materialise(rows, "mix-sizes")
    sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    goal = targets(sizes)
    rank = {s: i for i, s in enumerate(goal)}
    facts = spark.createDataFrame([(s, i, sizes[s], goal[s]) for s, i in rank.items()], "name string, src long, source_size long, target double")
    known = rows.join(facts, rows.source.eqNullSafe(facts.name), "left").drop("name")
    known = materialise(known, "mix-known")
    live = [(i, sizes[s], goal[s]) for s, i in rank.items() if sizes[s]]
    if not live:
        none = spark.createDataFrame([], "doc_id long, tag long, size long, lo long, hi long, uses long")
        return known.select("doc_id", "tag0", "tag", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")), none
    at = laid_out(known.where("size > 0").select("doc_id", "tag", "src", "size"), block_words)
    over = at.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))))
    uses = mixed_blocks(spark, live, seed, block_words, shard_slots)
    lo = F.greatest(F.col("block") * block_words, F.col("at")) - F.col("at")
    hi = F.least((F.col("block") + 1) * block_words, F.col("at") + F.col("size")) - F.col("at")
    pieces = over.join(uses.hint("merge"), ["src", "block"]).select("doc_id", "tag", "size", lo.alias("lo"), hi.alias("hi"), "uses")
    pieces = materialise(pieces, "mix-pieces")
    taken = pieces.groupBy("doc_id", "tag").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("uses")).alias("taken"))
    out = known.join(taken.hint("merge"), known.doc_id.eqNullSafe(taken.doc_id) & (known.tag == taken.tag), "left")
    return out.select(known.doc_id, "tag0", known.tag, known["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), pieces


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0].drop("tag0", "tag")


def mixed_documents(docs: DataFrame, seed: int = 20240) -> DataFrame:
    """The mix as documents with the columns of `docs`: for each pass a document's words in the blocks that the mix
    takes at least so often; a whole text is kept as it is. n_chars, if there, is that of the new text."""
    known, pieces = mix(docs, seed)
    tagged = docs.select(whole_rows(docs).alias("row")).withColumn("id", F.col("row.doc_id")).withColumn("key", F.xxhash64("row.text", "row.source"))
    if known.groupBy("doc_id", "tag0").count().where("count > 1").isEmpty():
        tagged = tagged.withColumn("tag", F.xxhash64("key", F.lit(1)))
    else:  # only equal rows need numbers, and only these cost a shuffle of the texts
        alike = Window.partitionBy("id", "key").orderBy("key")
        tagged = tagged.withColumn("tag", F.xxhash64("key", F.row_number().over(alike)))
    used = pieces.groupBy(F.col("doc_id").alias("of_id"), F.col("tag").alias("of_tag"), F.col("size").alias("n")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "uses"))).alias("parts"))
    joined = tagged.join(used.hint("merge"), tagged.id.eqNullSafe(used.of_id) & (tagged.tag == used.of_tag)).withColumn("pass", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("parts", lambda p: p["uses"])).cast("int"))))
    joined = joined.withColumn("parts", F.filter("parts", lambda p: p["uses"] >= F.col("pass")))
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["hi"] - p["lo"]) == F.col("n")
    part = cut_words(F.when(~whole, F.col("row.text")), F.when(~whole, F.col("parts.lo")), F.when(~whole, F.col("parts.hi")))
    out = joined.withColumn("row", F.col("row").withField("text", F.coalesce(part, "row.text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*fields_of(docs.columns))


def _cut(text: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    out = []
    for t, a, z in zip(text, lo, hi, strict=True):
        if t is None:
            out.append(None)
            continue
        runs: list[list[int]] = []
        for i, j in zip(a, z, strict=True):
            if runs and runs[-1][1] == i:
                runs[-1][1] = j
            else:
                runs.append([i, j])
        raw = t.encode()
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)  # numbers, no object for each word
        out.append(b"\n".join(raw[words.starts[i] : words.ends[j - 1]] for i, j in runs).decode())
    return pd.Series(out, dtype=object)


cut_words = F.pandas_udf(_cut, StringType())
