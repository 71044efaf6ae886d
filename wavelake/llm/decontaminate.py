"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits, lower-cased. Only words that occur in the benchmark can matter, so each document
becomes the sequence of its benchmark terms (-1 elsewhere). Passages are windows of 32 words that overlap by half, TF-IDF
weighted by their frequency over all passages (terms in over `common` of the passages weigh nothing). A distributed
randomised SVD of the passage matrix A gives the latent space in one pass: each partition adds its part of A'(A M) for a
random M, and the singular vectors of the sum, made whole by the small matrix M'A'A M, are the terms' directions.
Passages whose cosine to a window of an item is at least `cosine` are candidates. A candidate must have words that make
up `overlap` of the weight of the item's window, and is then verified on the words around it: the longest common
subsequence with the whole item must be at least `lcs` of the item, or at least `paraphrase` of it if the item's answer
(its last quarter) is found too, in that order and nearly whole. Items of under eight words must occur as they are.

Besides, documents are searched for the items' runs of three words (whole items of under three): where an item of n
words keeps `lcs` of them in place, at most m are replaced and at least n - 2 - 3m runs are left in a span of n words, so
spans with as many runs of an item are verified too, whatever their cosine. Verbatim items and such with replaced words
are found so at any length; only paraphrases and copies with words put in or moved depend on the latent space.

Each slice of about SLICE_BYTES of benchmark text is one run of this, so what is sent to the executors is bounded
whatever the benchmark's size.

Null and empty texts, and items without words, match nothing. Null ids stay null ids; equal rows give equal findings, and
of several places of an item in a document the one with most of it counts (the first of ties). A text of any length is
searched whole, by one task. Empty tables give an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, fields_of, materialise, shuffle_partitions, table, text_bytes, whole_rows

HALF = 16
RANK, MORE = 96, 16
SLICE_BYTES = 1 << 18

_PLAIN = np.full(256, 32, np.uint8)
for _a, _z in ((48, 58), (97, 123), (128, 256)):
    _PLAIN[_a:_z] = np.arange(_a, _z)
_PLAIN[65:91] = np.arange(97, 123)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    plain = _PLAIN[data]
    if len(data) > 1:  # capitals of two bytes in Latin-1 letters
        big = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        plain[1:][big] += 32
    return Words(plain, offsets, lower=False)


# --- the benchmark ------------------------------------------------------------------------------------------------


@dataclass
class Items:
    """A slice of the benchmark: ids and words (as terms) of each item, and the distinct terms."""

    ids: list
    words: list[np.ndarray]
    terms: pa.Array

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        texts = [(t or "").encode() for _, t in rows]
        words = plain_words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        found = words.array().dictionary_encode()
        which = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(found) else np.zeros(0, np.int64)
        return cls([i for i, _ in rows], [which[a:z] for a, z in zip(words.first[:-1], words.first[1:], strict=True)], found.dictionary)

    def windows(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(item, terms) of the windows of each item that are searched for."""
        item, out = [], []
        for i, w in enumerate(self.words):
            for at in range(0, max(1, len(w) - HALF), HALF):
                if len(w):
                    item.append(i)
                    out.append(w[at : at + 2 * HALF])
        return np.array(item, np.int64), out

    def runs(self, lcs: float) -> tuple[np.ndarray, list[tuple]]:
        """(runs that a span must have of each item, for each length k of runs (k, keys, bounds, item, offset)): the
        runs of a key are those of items and offsets within its bounds."""
        size = np.array([len(w) for w in self.words], np.int64)
        k_of = np.minimum(size, 3)
        lost = np.where(size < 8, 0, size - np.ceil(lcs * size - 1e-9).astype(np.int64))
        need = np.maximum(1, size - k_of + 1 - k_of * lost)
        out = []
        for k in (1, 2, 3):
            some = [i for i in np.flatnonzero(k_of == k).tolist()]
            if not some:
                continue
            key = np.concatenate([run_keys(self.words[i], k, len(self.terms)) for i in some])
            item = np.repeat(some, size[some] - k + 1)
            offset = np.concatenate([np.arange(size[i] - k + 1) for i in some])
            by = np.argsort(key, kind="stable")
            keys, first = np.unique(key[by], return_index=True)
            out.append((k, keys, np.append(first, len(by)), item[by], offset[by]))
        return need, out


def run_keys(seq: np.ndarray, k: int, terms: int) -> np.ndarray:
    """A number for each run of k terms of a sequence, -1 if one of them is unknown."""
    n = len(seq) - k + 1
    key, known = np.zeros(max(n, 0), np.int64), np.ones(max(n, 0), bool)
    for j in range(k if n > 0 else 0):
        key = key * terms + seq[j : j + n]
        known &= seq[j : j + n] >= 0
    return np.where(known, key, -1)


def spans_of_runs(seq: np.ndarray, first: np.ndarray, terms: int, lengths: np.ndarray, need: np.ndarray, runs: list[tuple], most: int = 1 << 20):
    """(document, item, start) of the spans of twice an item's length that have enough of its runs; starts lie an item's
    length apart, so that any span of that length is in one of them whole."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k, keys, bounds, item, offset in runs:
        key = run_keys(seq, k, terms)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        pos = np.flatnonzero((keys[at] == key) & (doc[: len(key)] == doc[k - 1 :])) if len(key) else np.zeros(0, np.int64)
        at = at[pos]
        many = bounds[at + 1] - bounds[at]
        before = np.cumsum(many) - many
        new = np.flatnonzero(np.append(True, doc[pos[1:]] != doc[pos[:-1]])) if len(pos) else np.zeros(0, np.int64)
        piece = np.repeat(before[new] // most, np.diff(np.append(new, len(pos))))  # whole documents
        cuts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])).tolist() if len(pos) else []
        for a, z in zip(cuts, [*cuts[1:], len(pos)], strict=False):
            m = many[a:z]
            one = np.repeat(bounds[at[a:z]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            d = np.repeat(doc[pos[a:z]], m)
            i, o = item[one], offset[one]
            b = (np.repeat(pos[a:z], m) - first[d]) // lengths[i]
            up = b > 0
            d, i, o, b = np.append(d, d[up]), np.append(i, i[up]), np.append(o, o[up]), np.append(b, b[up] - 1)
            by = np.lexsort((o, b, i, d))
            d, i, o, b = d[by], i[by], o[by], b[by]
            span = np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]))
            cut = np.flatnonzero(span)
            n = np.add.reduceat((span | np.append(True, o[1:] != o[:-1])).astype(np.int64), cut)
            for x in cut[n >= need[i[cut]]].tolist():
                yield int(d[x]), int(i[x]), int(b[x] * lengths[i[x]])


# --- passages -----------------------------------------------------------------------------------------------------


class Passages:
    """Half-windows of term sequences: at: the half-window of each known word; term: its term."""

    def __init__(self, seq: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None):
        n = np.diff(first)
        self.halves = np.maximum(1, -(-n // HALF))
        self.start = np.cumsum(self.halves) - self.halves
        hit = np.flatnonzero(seq >= 0)
        if weight is not None:
            hit = hit[weight[seq[hit]] > 0]
        doc = np.searchsorted(first, hit, side="right") - 1
        self.at = self.start[doc] + (hit - first[doc]) // HALF
        self.term = seq[hit].astype(np.int64)
        self.doc = np.repeat(np.arange(len(n)), self.halves)
        self.nth = np.arange(len(self.doc)) - np.repeat(self.start, self.halves)

    def tiles(self) -> tuple[np.ndarray, np.ndarray]:
        """(passage of each half-window, if passages do not overlap; of each known word)."""
        per = -(-self.halves // 2)
        tile = np.repeat(np.cumsum(per) - per, self.halves) + self.nth // 2
        return tile, tile[self.at]

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """Sum of the vectors of each half-window's words: the first word of all, then the second, and so on."""
        n = len(self.doc)
        count = np.bincount(self.at, minlength=n)
        order = np.argsort(-count, kind="stable")
        count, start = count[order], (np.cumsum(count) - count)[order]
        total = np.zeros((n, vectors.shape[1]), np.float32)
        for j in range(int(count[0]) if n else 0):
            some = int(np.searchsorted(-count, -j, side="left"))
            total[:some] += vectors[self.term[start[:some] + j]]
        out = np.empty_like(total)
        out[order] = total
        return out


def _sequences(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    data, o = text_bytes(batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch]), "seq")
    return data.view(np.int32) if len(data) else np.zeros(0, np.int32), o // 4


def term_sequences(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, tag, seq) of the documents that have a benchmark term; tag: hash of the text; seq: int32 terms."""
    terms = items.terms

    def rows(batches):
        for block in blocks(batches):
            words = plain_words(*text_bytes(block))
            found = words.array().dictionary_encode()
            n = block.num_rows
            if len(found):
                of = pc.fill_null(pc.index_in(found.dictionary, value_set=terms), -1).to_numpy(zero_copy_only=False)
                seq = of[found.indices.to_numpy(zero_copy_only=False)].astype(np.int32)
            else:
                seq = np.zeros(0, np.int32)
            o = words.first.astype(np.int64) * 4
            arr = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(seq))]).cast(pa.binary())
            some = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(seq >= 0, out=some[1:])
            live = pa.array(some[words.first[1:]] > some[words.first[:-1]])
            out = pa.table({"doc_id": block.column("doc_id"), "tag": block.column("tag"), "seq": arr}).filter(live)
            yield from out.to_batches(max_chunksize=4096)

    rows_in = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").where("text is not null")
    return rows_in.mapInArrow(rows, "doc_id long, tag long, seq binary")


# --- the latent space ---------------------------------------------------------------------------------------------


def _summed(seqs: DataFrame, size: int, width: int, add) -> np.ndarray:
    """The sum over all partitions of add(Passages-like sequences) -> (size, width) arrays. Each partition sends its
    sums by chunks of terms, and a chunk is added up in one task before it comes to the driver."""
    chunk = 1024

    def rows(batches):
        total = np.zeros((size, width))
        for block in blocks(batches, "seq", 4 << 20):
            total += add(*_sequences(block))
        for c, lo in enumerate(range(0, size, chunk)):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total[lo : lo + chunk].astype(np.float32).tobytes()], pa.binary())], names=["chunk", "part"])

    def added(parts):
        total = None
        for p in parts["part"]:
            v = np.frombuffer(p, np.float32)
            total = v.astype(np.float64) if total is None else total + v
        parts = parts.iloc[:1].copy()
        parts["part"] = [total.astype(np.float32).tobytes()]
        return parts

    tasks = 3 * seqs.sparkSession.sparkContext.defaultParallelism
    few = seqs.select("seq").coalesce(tasks).mapInArrow(rows, "chunk int, part binary")
    # two steps, so that no task adds up the sums of all partitions
    lots = max(1, int(shuffle_partitions(seqs.sparkSession) ** 0.5))
    few = few.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(lots)))
    half = few.groupBy("chunk", "lot").applyInPandas(lambda p: added(p[["chunk", "part"]]), "chunk int, part binary")
    found = half.groupBy("chunk").applyInPandas(added, "chunk int, part binary").collect()
    out = np.zeros((size, width))
    for r in found:
        v = np.frombuffer(r["part"], np.float32).reshape(-1, width)
        out[r["chunk"] * chunk : r["chunk"] * chunk + len(v)] = v
    return out


def inverse_frequency(seqs: DataFrame, terms: int, common: float) -> np.ndarray:
    """Weight of each term over the passages that do not overlap; 0 if in over `common` of them."""

    def add(seq, first):
        p = Passages(seq, first)
        tile, of = p.tiles()
        pair = np.sort(of * terms + p.term)
        pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
        out = np.zeros((terms + 1, 1))
        out[:-1, 0] = np.bincount(pair % terms, minlength=terms)
        out[-1, 0] = tile[-1] + 1 if len(tile) else 0
        return out

    df = _summed(seqs, terms + 1, 1, add)[:, 0]
    n = df[-1]
    weight = np.log((1 + n) / (1 + df[:-1])).astype(np.float32)
    return np.where(df[:-1] > common * n, np.float32(0), weight)


def latent_space(seqs: DataFrame, weight: np.ndarray, rank: int = RANK, more: int = MORE, seed: int = 11) -> np.ndarray:
    """Vectors of the terms (terms, rank), times their weights: the right singular vectors of the passage matrix."""
    terms = len(weight)
    width = min(rank + more, terms)

    def gram_times(m: np.ndarray) -> np.ndarray:
        scaled = (m * weight[:, None]).astype(np.float32)

        def add(seq, first):
            p = Passages(seq, first, weight)
            tile, of = p.tiles()
            y = np.zeros((int(tile[-1]) + 1 if len(tile) else 0, m.shape[1]), np.float32)
            half = p.sums(scaled)
            y[tile[p.nth % 2 == 0]] = half[p.nth % 2 == 0]
            y[tile[p.nth % 2 == 1]] += half[p.nth % 2 == 1]
            out = np.zeros((terms, m.shape[1]))
            order = np.argsort(p.term, kind="stable")
            step = 1 << 18
            for lo in range(0, len(order), step):
                j = order[lo : lo + step]
                t, part = p.term[j], y[of[j]]
                cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                for a, z in zip(cut.tolist(), np.append(cut[1:], len(t)).tolist(), strict=True):
                    out[t[a]] += part[a:z].sum(0)
            return out * weight[:, None]

        return _summed(seqs, terms, m.shape[1], add)

    random = np.random.default_rng(seed).standard_normal((terms, width))
    image = gram_times(random)
    image += (shift := 1e-6 * max(float(np.linalg.norm(image)), 1e-12)) * random  # keeps the small matrix positive
    small = random.T @ image
    root = np.linalg.cholesky((small + small.T) / 2 + shift * np.eye(width))
    basis, _, _ = np.linalg.svd(np.linalg.solve(root, image.T).T, full_matrices=False)
    return (basis[:, :rank] * weight[:, None]).astype(np.float32)


# --- search and verification --------------------------------------------------------------------------------------


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by whole-number bit vectors over the positions of `a`."""
    places: dict[int, int] = {}
    for i, t in enumerate(a.tolist()):
        places[t] = places.get(t, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for t in b.tolist():
        m = places.get(t, 0)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def common_share(near: np.ndarray, row: np.ndarray, window: np.ndarray, share: tuple[list, list], terms: int) -> np.ndarray:
    """For each pair of a row of `near` (distinct terms, -1 for none) and a window, in the order of windows: the part of the
    window's weight that these terms have. A window's weights are laid out by term once for all its rows."""
    own, part = share
    out = np.zeros(len(row), np.float32)
    by_term = np.zeros(terms + 1, np.float32)  # the last is that of -1
    cut = np.flatnonzero(np.diff(window, prepend=-1))
    for w, a, z in zip(window[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(row)], strict=False):
        by_term[own[w]] = part[w]
        out[a:z] = by_term[near[row[a:z]]].sum(1, dtype=np.float32)
        by_term[own[w]] = 0
    return out


@dataclass(frozen=True)
class Limits:
    cosine: float = 0.35
    overlap: float = 0.35
    lcs: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.8
    common: float = 0.1


def verified(item: np.ndarray, region: np.ndarray, limits: Limits) -> tuple[bool, float, bool]:
    """(contaminated, share of the item that is common, answer found)."""
    n = len(item)
    if n < 8:
        hay, needle = region.astype(np.int64), item.astype(np.int64)
        hit = len(hay) >= n and bool((np.lib.stride_tricks.sliding_window_view(hay, n) == needle).all(1).any())
        return hit, float(hit), hit
    share = lcs_length(item, region) / n
    if share < limits.paraphrase:
        return False, share, False
    tail = item[-max(3, n // 4) :]
    answered = lcs_length(tail, region) >= limits.answer * len(tail)
    return share >= limits.lcs or answered, share, answered


def find(docs: DataFrame, items: Items, limits: Limits) -> DataFrame:
    """(doc_id, tag, item, cosine, lcs, answer_found, at) of contaminated documents, for one slice of the benchmark."""
    seqs = materialise(term_sequences(docs, items), "term-sequences")
    weight = inverse_frequency(seqs, len(items.terms), limits.common)
    vectors = latent_space(seqs, weight)
    of, windows = items.windows()
    q = np.stack([vectors[w].sum(0) for w in windows])
    size = np.sqrt((q * q).sum(1))
    # an item whose words are all too common for the latent space is looked for by its words alone
    blind = [i for i in range(len(items.words)) if len(items.words[i]) and not (size[of == i] > 0).any()]
    q = q / np.maximum(size, 1e-9)[:, None]
    # terms of each window, and the weight of each as a part of the whole
    own = [np.unique(w) for w in windows]
    share = own, [(weight[w] / max(float(weight[w].sum()), 1e-9)).astype(np.float32) for w in own]
    known = docs.sparkSession.sparkContext.broadcast((items.words, of, q, vectors, weight, blind, share, items.runs(limits.lcs)))  # of one slice

    def rows(batches):
        words, of, q, vectors, weight, blind, share, (need, runs) = known.value
        lengths = np.array([len(w) for w in words])
        for block in blocks(batches, "seq", 4 << 20):
            seq, first = _sequences(block)
            p = Passages(seq, first, weight)
            half = p.sums(vectors)
            x = half.copy()
            pair = np.flatnonzero(p.doc[1:] == p.doc[:-1])
            x[pair] += half[pair + 1]
            norm = np.sqrt((x * x).sum(1))
            live = np.flatnonzero(norm > 1e-6)

            best: dict[tuple[int, int], tuple] = {}

            def check(h: int, i: int, c: float):
                d, n = int(p.doc[h]), int(lengths[i])
                at = int(p.nth[h]) * HALF
                region = seq[first[d] + max(0, at - n) : min(first[d + 1], first[d] + at + 2 * HALF + n)]
                hit, part, answered = verified(words[i], region, limits)
                if hit and part > best.get((d, i), (-1.0,))[0]:
                    best[d, i] = (part, max(c, best.get((d, i), (0, 0.0))[1]), answered, at)

            step = max(64, min(4096, (1 << 23) // max(1, len(q))))  # passages and windows compared at once
            for lo in range(0, len(live), step):
                h = live[lo : lo + step]
                c = (x[h] / norm[h, None]) @ q.T
                b, a = np.nonzero(np.ascontiguousarray((c >= limits.cosine).T))  # by windows
                if len(a):
                    pos = first[p.doc[h]][:, None] + p.nth[h][:, None] * HALF + np.arange(2 * HALF)
                    near = np.where(pos < first[p.doc[h] + 1][:, None], seq[np.minimum(pos, len(seq) - 1)], -1)
                    near = np.sort(near, axis=1)
                    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # each term once
                    enough = common_share(near, a, b, share, len(weight)) >= limits.overlap
                    a, b = a[enough], b[enough]
                if len(a):
                    # each candidate item once for a passage
                    key, where = np.unique(h[a] * len(words) + of[b], return_index=True)
                    for k, w in zip(key.tolist(), where.tolist(), strict=True):
                        check(k // len(words), k % len(words), float(c[a[w], b[w]]))
            for i in blind:
                for h in range(len(p.doc)):
                    check(h, i, 0.0)
            for d, i, start in spans_of_runs(seq, first, len(weight), lengths, need, runs):
                hit, part, answered = verified(words[i], seq[first[d] + start : min(first[d + 1], first[d] + start + 2 * int(lengths[i]))], limits)
                if hit and part > best.get((d, i), (-1.0,))[0]:
                    best[d, i] = (part, best.get((d, i), (0, 0.0))[1], answered, start // HALF * HALF)
            if best:
                keys = list(best)
                at = pa.array([d for d, _ in keys])
                yield pa.RecordBatch.from_arrays([block.column("doc_id").take(at).combine_chunks(), block.column("tag").take(at).combine_chunks(), pa.array([i for _, i in keys], pa.int32()), pa.array([best[k][1] for k in keys], pa.float64()), pa.array([best[k][0] for k in keys], pa.float64()), pa.array([bool(best[k][2]) for k in keys]), pa.array([best[k][3] for k in keys], pa.int64())], names=["doc_id", "tag", "item", "cosine", "lcs", "answer_found", "at"])

    return seqs.mapInArrow(rows, "doc_id long, tag long, item int, cosine double, lcs double, answer_found boolean, at long")


def contaminated(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(doc_id, tag, item_id, cosine, lcs, answer_found, at) of each document and benchmark item that it contains."""
    spark = docs.sparkSession
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id long, tag long, item_id {kind}, cosine double, lcs double, answer_found boolean, at long"
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-total // SLICE_BYTES)
    out = spark.createDataFrame([], schema)
    for s in range(slices):
        part = Items.of(sorted(((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == s).collect()), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1])))
        if not len(part.terms):
            continue
        ids = spark.createDataFrame(list(enumerate(part.ids)), f"item int, item_id {kind}")
        out = out.unionByName(find(docs, part, limits).join(ids, "item").select("doc_id", "tag", "item_id", "cosine", "lcs", "answer_found", "at"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without documents that contain a benchmark item; all columns stay, whatever their names."""
    bad = materialise(contaminated(docs, benchmark).select("doc_id", "tag").distinct(), "contaminated")
    rows = docs.select(whole_rows(docs).alias("row"))
    kept = rows.join(bad, rows["row.doc_id"].eqNullSafe(bad.doc_id) & (F.xxhash64("row.text") == bad.tag), "left_anti")
    return kept.select(*fields_of(docs.columns))
