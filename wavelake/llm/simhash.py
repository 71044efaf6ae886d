"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in over half the XXH64 hashes (seed 42) of the text's word shingles.
Fingerprints link if they differ in at most two bits. Each is cut in three segments (22, 21 and 21 bits), and each
segment is read as a word of the binary Golay code (23, 12): every word has one codeword within distance 3, and two
words at distance 1 share a codeword that is nearest to the one and within distance 4 of the other. Of two errors in
three segments, one segment is free, and one of any two others holds one error at most; so for the segment pairs
(1,2), (2,3), (3,1) the key "first segment exactly, codeword index of the second" meets in at least one pair. One side
brings the nearest index, the other all indices within distance 4 (six at most), and candidates are verified.

Only distinct fingerprints are searched. Keys under which over `crowd` fingerprints meet are not joined: their
fingerprints are linked by the keys "fingerprint or one bit flipped" instead, where all that share a key are within
two bits, so a star to the smallest is exact and linear. Components come from the linked pairs.

Null and empty texts have fingerprint zero. Null ids are kept; the component is the smallest id that is not null (null
if there is none). Equal rows keep a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, bucketed, connected_components, fields_of, materialise, mix64, table, text_bytes, whole_rows

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101


# --- fingerprints -------------------------------------------------------------------------------------------------


def _shingle_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, width: int):
    """(text number, unsigned hash) of each shingle, in pieces of bounded size; first: as in Words."""
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    ends_at = np.cumsum(n_shingles)
    digest, step = xxhash.xxh64_intdigest, 1 << 17
    for lo in range(0, int(ends_at[-1]) if len(ends_at) else 0, step):
        at = np.arange(lo, min(lo + step, int(ends_at[-1])))
        doc = np.searchsorted(ends_at, at, side="right")
        k = first[:-1][doc] + at - (ends_at - n_shingles)[doc]
        last = np.minimum(k + width, first[1:][doc]) - 1
        spans = zip(starts[k].tolist(), ends[last].tolist(), strict=True)
        yield doc, np.fromiter([digest(text[i:j], SEED) for i, j in spans], np.uint64, len(at))


def _distinct_shingles(text: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, width: int):
    """As _shingle_hashes, with each hash of a text once: the text that a piece ends in is held back for the next."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def told() -> tuple[np.ndarray, np.ndarray]:
        doc, h = map(np.concatenate, zip(*held, strict=True))
        by = np.lexsort((h, doc))
        doc, h = doc[by], h[by]
        new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
        return doc[new], h[new]

    for doc, h in _shingle_hashes(text, starts, ends, first, width):
        z = int(np.searchsorted(doc, doc[-1]))
        if z:
            held.append((doc[:z], h[:z]))
            yield told()
            held = []
        held.append((doc[z:], h[z:]))
    if held:
        yield told()


def _fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    words = Words(data, offsets)
    n = len(offsets) - 1
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    for doc, h in _shingle_hashes(*words.joined(), words.first, width):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        ones[doc[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
        total[doc[cut]] += np.diff(np.append(cut, len(doc)))
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row; fp holds the 64 bits."""

    def rows(batches):
        for block in blocks(batches):
            fp = _fingerprints(*text_bytes(block), width)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, fp long")


# --- Golay keys ---------------------------------------------------------------------------------------------------


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(codewords by index, for each of the 2048 syndromes its error pattern of weight three or less)."""
    index = np.arange(4096, dtype=np.int64)
    words = np.zeros(4096, np.int64)
    for b in range(12):
        words ^= np.where(index >> b & 1, GENERATOR << b, 0)
    leaders = np.full(2048, -1, np.int64)
    singles = [1 << b for b in range(23)]
    patterns = [0, *singles, *(a | b for i, a in enumerate(singles) for b in singles[:i]), *(a | b | c for i, a in enumerate(singles) for j, b in enumerate(singles[:i]) for c in singles[:j])]
    p = np.array(patterns, np.int64)
    leaders[syndrome(p)] = p
    return words, leaders


def syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of division by the generator polynomial."""
    r = word.copy()
    for b in range(22, 10, -1):
        r ^= np.where(r >> b & 1, GENERATOR << (b - 11), 0)
    return r


def codeword_index(word: np.ndarray) -> np.ndarray:
    """Quotient of a codeword by the generator polynomial."""
    r, q = word.copy(), np.zeros_like(word)
    for b in range(22, 10, -1):
        hit = r >> b & 1
        q |= hit << (b - 11)
        r ^= np.where(hit, GENERATOR << (b - 11), 0)
    return q


@cache
def near_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome its error patterns of weight 4 or less (six at most, the lowest weight first) and their number."""
    _, leaders = golay()
    weight4 = np.array([1 << a | 1 << b | 1 << c | 1 << d for a in range(23) for b in range(a) for c in range(b) for d in range(c)], np.int64)
    s = syndrome(weight4)
    order = np.argsort(s, kind="stable")
    found = np.zeros((2048, 6), np.int64)
    n = np.ones(2048, np.int64)
    found[:, 0] = leaders
    for pattern, at in zip(weight4[order].tolist(), s[order].tolist(), strict=True):
        found[at, n[at]] = pattern
        n[at] += 1
    return found, n


def nearby_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, n): of each 23-bit word up to six codeword indices within distance 4, the nearest first."""
    found, n = near_patterns()
    s = syndrome(segment)
    return codeword_index((segment[:, None] ^ found[s]).ravel()).reshape(-1, 6), n[s]


def golay_keys(distinct: DataFrame) -> DataFrame:
    """(fp, key, nearest) for each fingerprint, segment pair and nearby codeword."""

    def rows(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            seg = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
            for i in range(3):
                idx, n = nearby_indices(seg[(i + 1) % 3])
                live = np.arange(6) < n[:, None]
                key = ((i << 22 | seg[i]) << 12)[:, None] | idx
                near = np.broadcast_to(np.arange(6) == 0, live.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp.view(np.int64), n)), pa.array(key[live]), pa.array(near[live])], names=["fp", "key", "nearest"])

    return distinct.select("fp").mapInArrow(rows, "fp long, key long, nearest boolean")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, crowd: int = 256) -> DataFrame:
    """(src, dst): pairs of distinct fingerprints within two bits that connect all that are linked."""
    keys = materialise(golay_keys(distinct), "golay-keys")
    met = materialise(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("nearest").alias("near")).where("n > 1 and near"), "golay-met")
    few = met.where(F.col("n") <= crowd).select("key")
    both = keys.join(few.hint("merge"), "key", "left_semi")
    a = both.where("nearest").select("key", F.col("fp").alias("src"))
    b = both.select("key", F.col("fp").alias("dst"))
    pairs = a.join(b.hint("merge"), "key").where(F.col("src") != F.col("dst")).where(distance(F.col("src"), F.col("dst")) <= 2)
    pairs = pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    many = met.where(F.col("n") > crowd).select("key")
    crowded = keys.join(many.hint("merge"), "key", "left_semi").select("fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    ball = crowded.select("fp", F.explode(flips).alias("near"))
    star = ball.groupBy("near").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1")
    stars = ball.join(star.hint("merge"), "near").where(F.col("fp") != F.col("dst")).select(F.col("fp").alias("src"), "dst")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs` (doc_id, text)."""
    marked = materialise(fingerprints(docs, width), "simhash")
    groups = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    of = connected_components(links(groups)).select(F.col("node").alias("fp"), "component")
    known = groups.join(of.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    known = materialise(known, "simhash-known")
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = materialise(known.join(ids.hint("merge"), "component").select("fp", "component_id"), "simhash-ids")
    return marked.join(ids.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- groups by similarity -----------------------------------------------------------------------------------------
#
# Texts of a similarity of 0.8 differ in about a seventh of their fingerprint bits, far more than two. For these each
# shingle is dealt to one of TABLES fingerprints, and each fingerprint gives the pairs of nearby codeword indices of its
# first two segments (28 keys or so): two fingerprints meet if their segments share a codeword within distance 4 each.

TABLES = 10
_WIDE = 8 * TABLES


def _wide_marks(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the words, TABLES fingerprints of the distinct shingles) of each text."""
    words = Words(data, offsets)
    text, starts, ends = words.joined()
    n = np.diff(words.first)
    spans = zip(np.append(starts, len(text))[words.first[:-1]].tolist(), np.where(n > 0, np.append(ends, 0)[words.first[1:] - 1], 0).tolist(), n.tolist(), strict=True)
    whole = np.fromiter([xxhash.xxh64_intdigest(text[a:z] if k else b"", SEED) for a, z, k in spans], np.uint64, len(n))
    ones = np.zeros((len(n) * TABLES, 64), np.int32)
    total = np.zeros(len(n) * TABLES, np.int32)
    for doc, h in _distinct_shingles(text, starts, ends, words.first, width):
        row = doc * TABLES + (mix64(h) % np.uint64(TABLES)).astype(np.int64)
        by = np.argsort(row, kind="stable")
        row = row[by]
        bits = np.unpackbits(h[by].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        ones[row[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
        total[row[cut]] += np.diff(np.append(cut, len(row)))
    fp = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(len(n), TABLES)
    return whole, fp


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row): the rows of `docs`, whole, as a table bucketed by a 64-bit hash of id and text: later joins take texts
    from it without a shuffle, and columns of any name are carried inside `row`."""
    row = whole_rows(docs)
    return bucketed(docs.select(F.xxhash64("doc_id", "text").alias("key"), row.alias("row")), "docs_by_key", "key", dealt=True)


def wide_marks(held: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, words long, wide binary) of each row of keyed()."""

    def rows(batches):
        for block in blocks(batches, limit=4 << 20, most=8000):
            whole, fp = _wide_marks(*text_bytes(block), width)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), block.column("key").combine_chunks(), pa.array(whole.view(np.int64)), pa.array([r.tobytes() for r in fp], pa.binary())], names=["doc_id", "key", "words", "wide"])

    return held.select(F.col("row.doc_id").alias("doc_id"), "key", F.col("row.text").alias("text")).mapInArrow(rows, "doc_id long, key long, words long, wide binary")


CHUNK, SHARD = 1 << 14, 1 << 12  # fingerprints that a task sends at once, and for each shard
_SENT = pa.schema([("shard", pa.int32()), ("rows", pa.binary()), ("keys", pa.binary()), ("checks", pa.binary())])


def _thinned(pair: np.ndarray, dense: float = 1.5, small: int = 8) -> np.ndarray:
    """Edges (src, dst; src = dst marks a node) with those of dense groups, which have over `small` nodes and over `dense`
    edges for each of them, replaced by a search tree from the group's smallest node and a mark for each node: rare_pairs() finds all pairs of
    these. Near copies of one text meet under many keys; sent once for each they would join many times."""
    name, ends = np.unique(pair, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    a, b = a[(real := a != b)], b[real]
    root = np.arange(len(name))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    nodes, edges = np.bincount(root, minlength=len(name)), np.bincount(root[a], minlength=len(name))
    crowd = ((nodes > small) & (edges > dense * nodes))[root]
    if not crowd.any():
        return pair
    up, far = np.full(len(name), -1), np.flatnonzero(crowd & (root == np.arange(len(name))))
    up[far] = far
    inner = crowd[a]
    src, dst = np.append(a[inner], b[inner]), np.append(b[inner], a[inner])
    while len(far):  # level by level, each node under the smallest that reaches it
        on = np.isin(src, far) & (up[dst] < 0)
        best = np.full(len(name), len(name))
        np.minimum.at(best, dst[on], src[on])
        far = np.flatnonzero(best < len(name))
        up[far] = best[far]
    n = np.flatnonzero(crowd)
    tree = np.stack([np.maximum(n, up[n]), np.minimum(n, up[n])], 1)
    tree = np.concatenate([tree[tree[:, 0] != tree[:, 1]], np.stack([n, n], 1)])
    rest = ends.reshape(-1, 2)
    return np.concatenate([pair[~crowd[rest[:, 0]]], name[tree]])


def candidate_edges(distinct: DataFrame, shards: int, most: int = 20) -> DataFrame:
    """(src, dst) of ids of `distinct` (id, wide) that meet under a key and whose next fingerprints differ in at most
    `most` bits: for each key over which more than eight meet the edges of a search tree. A tree of over two is not all
    its pairs; each id in it comes as a row of src = dst, for rare_pairs(). Dense groups of a shard come as one tree.

    `most` and the loose test of _groups() are a filter before the exact check, and all tables may miss a pair: at a
    similarity of just 0.8 about one pair in a hundred is not found, more similar ones far less often (README)."""

    def sent(batches):
        for block in blocks(batches, "wide", most=CHUNK):
            ids = block.column("id").to_numpy()
            part = np.frombuffer(text_bytes(block, "wide")[0].tobytes(), np.uint64).reshape(-1, TABLES)
            for t in range(TABLES):
                seg = [(part[:, t] >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS[:2]]
                (i, ni), (j, nj) = map(nearby_indices, seg)
                live = (np.arange(6) < ni[:, None])[:, :, None] & (np.arange(6) < nj[:, None])[:, None, :]
                key = ((t << 12 | i)[:, :, None] << 12 | j[:, None, :])[live].astype(np.uint64)
                row = np.broadcast_to(ids[:, None, None], live.shape)[live]
                check = np.broadcast_to(part[:, (t + 1) % TABLES, None, None], live.shape)[live]
                at = (mix64(key >> np.uint64(12)) % np.uint64(shards)).astype(np.int64)  # keys of one first index meet in a shard, which tells equal edges once
                by = np.lexsort((key, at))
                at, key, row, check = at[by], key[by], row[by], check[by]
                cut = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
                end = np.append(cut[1:], len(at))
                yield pa.RecordBatch.from_arrays([pa.array(at[cut].astype(np.int32)), *(pa.array([x[a:z].astype(f"<u{w}").view(np.uint8).reshape(-1, w).T.tobytes() for a, z in zip(cut, end, strict=True)], pa.binary()) for x, w in ((row, 8), (key, 4), (check, 8)))], schema=_SENT)

    def whole(column, w: int) -> list[np.ndarray]:
        return [np.ascontiguousarray(np.frombuffer(b.as_py(), np.uint8).reshape(w, -1).T).view(f"<u{w}").ravel() for b in column]

    def met(parts: pa.Table) -> pa.Table:
        ids = np.concatenate(whole(parts.column("rows"), 8)).astype(np.int64)
        key, check = np.concatenate(whole(parts.column("keys"), 4)), np.concatenate(whole(parts.column("checks"), 8))
        by = np.lexsort((ids, key))
        key, ids, check = key[by], ids[by], check[by]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(cut, len(key)))
        src, dst = [], []
        for few in range(1, 8):  # small groups: all pairs at a distance of `few` in the sorted order
            a = np.arange(len(key) - few)
            a = a[(key[a] == key[a + few]) & np.repeat(size <= 8, size)[: max(0, len(key) - few)]]
            a = a[np.bitwise_count(check[a] ^ check[a + few]) <= most]
            src.append(ids[a + few]), dst.append(ids[a])
        for c, n in zip(cut[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            left = np.arange(c, c + n)
            while len(left):
                queue, left = [left[0]], left[1:]
                tree = list(queue)
                while queue and len(left):
                    x = queue.pop()
                    near = np.bitwise_count(check[left] ^ check[x]) <= most
                    hit, left = left[near], left[~near]
                    src.append(ids[hit]), dst.append(np.full(len(hit), ids[x]))
                    queue += hit.tolist()
                    tree += hit.tolist()
                if len(tree) > 2:
                    src.append(ids[tree]), dst.append(ids[tree])
        src, dst = np.concatenate(src), np.concatenate(dst)
        pair = np.unique(np.stack([np.maximum(src, dst), np.minimum(src, dst)], 1), axis=0) if len(src) else np.zeros((0, 2), np.int64)
        pair = _thinned(pair)
        return pa.table({"src": pair[:, 0], "dst": pair[:, 1]})

    packed = distinct.select("id", "wide").mapInArrow(sent, "shard int, rows binary, keys binary, checks binary")
    return packed.groupBy("shard").applyInArrow(met, "src long, dst long").distinct()


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles binary) of `docs` (id, text): sorted distinct 32-bit hashes."""

    def rows(batches):
        for block in blocks(batches, limit=4 << 20):
            words = Words(*text_bytes(block))
            text, starts, ends = words.joined()
            sets: list[list] = [[] for _ in range(block.num_rows)]
            for doc, h in _shingle_hashes(text, starts, ends, words.first, width):
                cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                for d, part in zip(doc[cut].tolist(), np.split(h, cut[1:]), strict=True):
                    sets[d].append(part)
            out = [np.unique(np.concatenate(s).astype(np.uint32)).tobytes() if s else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([block.column("id").combine_chunks(), pa.array(out, pa.binary())], names=["id", "shingles"])

    return docs.select("id", "text").mapInArrow(rows, "id long, shingles binary")


def _similar_pairs(pairs: DataFrame, similar: float) -> DataFrame:
    """(src, dst) of `pairs` (src, dst, a, b) whose shingle sets have a Jaccard similarity of `similar` or more."""

    def rows(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similar * (len(a) + len(b) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(rows, "src long, dst long")


#: Sixteenths of a crowd's texts whose pairs each round of _groups() looks for.
ROUNDS = ((0, 1), (1, 4), (4, 16))


def rare_pairs(crowd: DataFrame, similar: float, sample: int = 200_000, most: int = 1 << 18, lots: tuple[int, int] = (0, 16)) -> DataFrame:
    """(src, dst) of all pairs of `crowd` (id, component, shingles) of two components that can have a Jaccard similarity
    of `similar` or more, by prefix filter: in any one order of all shingles, the first that both sets have is among the
    first of each. The order has rare shingles first (often: up to `most` frequent ones of `sample` sets), so that what
    a template's texts share comes last. The order decides the cost, not the pairs. lots: sixteenths, by hash, that the
    smaller text of a pair is in."""
    spark = crowd.sparkSession
    part = 2 * similar / (1 + similar)

    def flat(batch) -> tuple[np.ndarray, np.ndarray]:
        data, o = text_bytes(pa.Table.from_batches([batch]), "shingles")
        return np.frombuffer(data.tobytes(), np.uint32), o // 4

    def members(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(flat(batch)[0].astype(np.int64))], names=["shingle"])

    parts = max(1, -(-crowd.count() // sample))
    some = crowd.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).select("shingles").mapInArrow(members, "shingle long")
    often = some.groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(most).toArrow()
    name, many = (np.append(often.column(c).to_numpy(), 0) for c in ("shingle", "count"))
    by = np.argsort(name[:-1])
    known = spark.sparkContext.broadcast((np.append(name[:-1][by], -1), np.append(many[:-1][by], 0)))

    def prefixes(batches):
        name, many = known.value
        for batch in batches:
            shingle, first = flat(batch)
            size = np.diff(first)
            row = np.repeat(np.arange(len(size)), size)
            at = np.searchsorted(name[:-1], shingle)
            often = np.where(name[at] == shingle, many[at], 0)
            by = np.lexsort((shingle, often, row))
            nth = np.arange(len(by)) - first[:-1][row]
            keep = nth <= (size - np.ceil(similar * size - 1e-9))[row]
            low = (nth <= (size - np.ceil(part * size - 1e-9))[row])[keep]
            row, nth = row[keep], nth[keep]
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(shingle[by][keep].astype(np.int64)), batch.column("id").take(of), batch.column("component").take(of), pa.array(size[row].astype(np.int32)), pa.array(nth.astype(np.int32)), pa.array(low)], names=["shingle", "id", "component", "size", "nth", "low"])

    rows = crowd.select("id", "component", "shingles").mapInArrow(prefixes, "shingle long, id long, component long, size int, nth int, low boolean")
    rows = materialise(rows, "wide-prefixes")
    a, b = (rows.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "size", "nth", "low"))) for x in "ab")
    lot = F.pmod(F.xxhash64("id_a", F.lit("lot")), F.lit(16))
    both = a.where("low_a").where((lot >= lots[0]) & (lot < lots[1])).join(b.hint("merge"), "shingle").where("component_a <> component_b and (size_a < size_b or size_a = size_b and id_a < id_b)")
    both = both.where(F.col("size_a") >= similar * F.col("size_b") - 1e-9)
    # as the first that both have, it leaves enough after it
    both = both.where(F.least(F.col("size_a") - F.col("nth_a"), F.col("size_b") - F.col("nth_b")) >= part / 2 * (F.col("size_a") + F.col("size_b")) - 1e-9)
    return both.select(F.greatest("id_a", "id_b").alias("src"), F.least("id_a", "id_b").alias("dst")).distinct()


def similar_groups(docs: DataFrame, width: int = 5, similar: float = 0.8) -> DataFrame:
    """(doc_id, key, group) of each row of `docs` (doc_id, text): group is one for texts of the same words or linked by
    similar shingle sets. Null texts and texts without words are one group; a text of under `width` words is one shingle;
    texts of any length are compared whole; rows that are equal have one key; an empty table gives an empty result."""
    return _groups(keyed(docs.select("doc_id", "text")), width, similar)


def _groups(held: DataFrame, width: int, similar: float) -> DataFrame:
    """similar_groups() of a table of keyed()."""
    marked = materialise(wide_marks(held, width), "wide-marks")
    distinct = marked.groupBy("words").agg(F.first("wide").alias("wide"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("who"))
    distinct = materialise(distinct.select(F.monotonically_increasing_id().alias("id"), "words", "wide", "who.key"), "wide-distinct")
    # shards and tasks by the number of fingerprints and not of partitions, so that what tasks send are few large rows
    n = distinct.count()
    tasks = max(held.sparkSession.sparkContext.defaultParallelism, -(-n // CHUNK))
    met = materialise(candidate_edges(distinct.coalesce(tasks), max(1, -(-n // SHARD))), "wide-edges")
    edges, crowd = met.where("src <> dst"), met.where("src = dst").select(F.col("src").alias("id"))
    a = distinct.select(F.col("id").alias("src"), F.col("wide").alias("a"))
    b = distinct.select(F.col("id").alias("dst"), F.col("wide").alias("b"))
    # a loose test on all bits first: beyond it lie similarities under 0.7 or so
    near = edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where(_apart("a", "b") <= int(0.22 * 64 * TABLES)).select("src", "dst")
    near = materialise(near, "wide-near")
    part = near.select(F.col("src").alias("id")).union(near.select(F.col("dst").alias("id"))).union(crowd).distinct().join(distinct.select("id", "key").hint("merge"), "id")
    part = materialise(part, "wide-part")
    sets = held.select("key", F.col("row.text").alias("text")).join(part.hint("merge"), "key").select("id", "text")
    sets = materialise(_shingle_sets(sets, width).dropDuplicates(["id"]), "wide-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        of_a, of_b = (sets.select(F.col("id").alias(i), F.col("shingles").alias(x)) for i, x in (("src", "a"), ("dst", "b")))
        pairs = pairs.join(of_a.hint("merge"), "src").join(of_b.hint("merge"), "dst").select("src", "dst", "a", "b")
        return materialise(_similar_pairs(pairs, similar), "wide-similar")

    linked = verified(near)
    of = connected_components(linked).select(F.col("node").alias("id"), "component")
    if not crowd.isEmpty():
        # in rounds, the first of few texts: pairs that its links put in one component are not joined in the next
        crowd = materialise(sets.join(crowd.hint("merge"), "id"), "wide-crowd")
        for lots in ROUNDS:
            now = crowd.join(of.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"), "shingles")
            more = verified(materialise(rare_pairs(materialise(now, "wide-round"), similar, lots=lots), "wide-rare"))
            if not more.isEmpty():
                linked = linked.union(more)
                of = connected_components(linked).select(F.col("node").alias("id"), "component")
    known = materialise(distinct.select("id", "words").join(of.hint("merge"), "id", "left").select("words", F.coalesce("component", "id").alias("group")), "wide-known")
    return marked.select("doc_id", "key", "words").join(known.hint("merge"), "words").select("doc_id", "key", "group")


def _apart(a: str, b: str):
    """Number of differing bits of two binary columns of _WIDE bytes."""
    word = lambda c, i: F.conv(F.hex(F.substring(c, 1 + 4 * i, 4)), 16, 10).cast("long")
    total = F.lit(0)
    for i in range(_WIDE // 4):
        total = total + F.bit_count(word(a, i).bitwiseXOR(word(b, i)))
    return total


def keep_one(docs: DataFrame, width: int = 5, similar: float = 0.8) -> DataFrame:
    """`docs` with one document of each group of similar_groups(): the one of the smallest id (null last), and of its
    equal rows one. All columns stay, whatever their names."""
    held = keyed(docs)
    groups = materialise(_groups(held, width, similar), "wide-groups")
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("who"))
    out = held.join(best.select("who.key").hint("merge"), "key", "left_semi")
    if not groups.groupBy("key").count().where("count > 1").isEmpty():  # equal rows have one key
        out = out.dropDuplicates(["key"])
    return out.select(*fields_of(docs.columns))
