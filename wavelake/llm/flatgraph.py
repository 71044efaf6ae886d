"""Near copies among vectors: links of a cosine of `least` or more, by search of a robust-pruned flat graph.

Equal vectors are one node. Centres are fitted on a bounded sample; each node belongs to its `overlap` nearest clusters,
so that shards overlap. A graph is built on each shard: nodes come in batches that double, each is searched from the
shard's medoids and linked by robust pruning (a neighbour is left out if a kept one is nearer to it by `ALPHA`), once more
when all are in. The adjacency lists of a node's shards are united to one flat graph. It is laid out by the same shards,
and in each of them all nodes are looked for at once: a greedy beam search from the medoids and the node itself, then range
expansion over all nodes within `reach`. What it finds is verified in double precision. Two nodes count in the first
cluster that both belong to, so no pair is sent anywhere: a shard sends the number of links of a node and the smallest
node that it reaches there, and components of these are joined.

A cluster of over PAGE nodes, whatever the data, is cut in pages; each two pages are a shard, so that all its pairs meet
and no task holds more than two pages. The recall is measured on a sample of nodes against all; where it lies below
`target`, the search is repeated with twice the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, connected_components, materialise, mix64, release, table, text_bytes

SAMPLE_BYTES, SAMPLE = 16 << 20, 20_000  # of the vectors on which centres are fitted
AUDIT = 500  # nodes whose links are counted against all
MEAN, PAGE = 750, 4096  # nodes for each centre; nodes of a page
DEGREE, BEAM, MEDOIDS, ALPHA = 24, 32, 16, 1.2
QUERIES = 512  # searched at once
_NODE = "node long, hash long, many long, vec binary, clusters binary"


# --- graph in a shard ---------------------------------------------------------------------------------------------


class Graph:
    """A graph over unit vectors `x` (float32). near: (n + 1, width) neighbours, n where there is none.

    around, first: both ends of all edges, node by node: range expansion goes along them either way, since some nodes are
    among the nearest of no other."""

    def __init__(self, x: np.ndarray, near: np.ndarray | None = None):
        self.n = len(x)
        self.x = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
        # the mean of a shard may lie in a dense group whose lists never leave it: several starts
        self.medoids = np.unique((centres(x, min(MEDOIDS, self.n)) @ x.T).argmax(1)).astype(np.int32)
        self.near = np.full((self.n + 1, DEGREE), self.n, np.int32) if near is None else near

    def build(self, order: np.ndarray) -> Graph:
        """Nodes in `order`, in batches that double; then all once more."""
        order = np.append(self.medoids, order[~np.isin(order, self.medoids)])
        done = min(DEGREE, self.n)
        self._link(order[:done], np.broadcast_to(order[:done], (done, done)))
        lots = []
        while done < self.n:
            lots.append(order[done : done + min(done, QUERIES)])
            done += len(lots[-1])
        for batch in [*lots, *(order[at : at + QUERIES] for at in range(0, self.n, QUERIES))]:
            self._link(batch, np.concatenate([self.search(batch, False)[0], self.near[batch]], 1))
        return self

    def both_ways(self) -> Graph:
        src, dst = np.repeat(np.arange(self.n), self.near.shape[1]), self.near[:-1].ravel()
        src, dst = src[dst < self.n], dst[dst < self.n]
        cell = np.unique(np.append(src * self.n + dst, dst.astype(np.int64) * self.n + src))
        src, self.around = np.divmod(cell, self.n)
        self.first = np.searchsorted(src, np.arange(self.n + 1))
        return self

    def _prune(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """DEGREE of `others` (of each row's node, with n where none) by robust pruning."""
        others = np.sort(np.where(others == rows[:, None], self.n, others), 1)
        others[:, 1:][others[:, 1:] == others[:, :-1]] = self.n
        of = self.x[others]
        apart = 2 - 2 * np.einsum("pd,pcd->pc", self.x[rows], of)
        apart[others == self.n] = np.inf
        by = np.argsort(apart, 1, kind="stable")
        others, apart = np.take_along_axis(others, by, 1), np.take_along_axis(apart, by, 1)
        of = np.take_along_axis(of, by[:, :, None], 1)
        between = np.maximum(2 - 2 * np.matmul(of, of.transpose(0, 2, 1)), 0)
        alive = np.isfinite(apart)
        out = np.full((len(rows), DEGREE), self.n, np.int32)
        at = np.arange(len(rows))
        for k in range(DEGREE):
            best = alive.argmax(1)
            some = alive[at, best]
            if not some.any():
                break
            out[some, k] = others[at, best][some]
            alive &= ~((ALPHA**2 * between[at, best] <= apart) & some[:, None])
            alive[at, best] = False
        return out

    def _link(self, rows: np.ndarray, others: np.ndarray) -> None:
        """Neighbours of `rows` out of `others`, and these as neighbours of theirs."""
        self.near[rows] = found = self._prune(rows, np.ascontiguousarray(others))
        src, dst = np.repeat(rows, DEGREE), found.ravel()
        src, dst = src[dst < self.n], dst[dst < self.n]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        who, first, many = np.unique(dst, return_index=True, return_counts=True)
        for lot in range(0, len(who), QUERIES):
            w, f, m = who[lot : lot + QUERIES], first[lot : lot + QUERIES], many[lot : lot + QUERIES]
            back = np.full((len(w), int(m.max())), self.n, np.int32)
            of = np.repeat(np.arange(len(w)), m)
            at = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
            back[of, at] = src[np.repeat(f, m) + at]
            for part in range(0, back.shape[1], 2 * DEGREE):  # hubs in parts
                self.near[w] = self._prune(w, np.concatenate([self.near[w], back[:, part : part + 2 * DEGREE]], 1))

    def search(self, queries: np.ndarray, own: bool, reach: float = 2.0) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(beams, rows, nodes): greedy search for the nodes `queries` from the medoids, and from themselves if `own`; rows
        and nodes are all nodes met at a cosine of `reach` or more, and over these the search is carried on."""
        q, n = len(queries), self.n
        at = np.arange(q)
        vec = self.x[queries]
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = seen[at, queries] = True
        start = np.broadcast_to(self.medoids, (q, len(self.medoids)))
        new = ~seen[at[:, None], start]
        seen[:, self.medoids] = True
        beam, sim, open_ = np.full((q, BEAM), n, np.int32), np.full((q, BEAM), -np.inf, np.float32), np.zeros((q, BEAM), bool)
        m = start.shape[1]
        beam[:, :m], sim[:, :m], open_[:, :m] = start, np.where(new, vec @ self.x[self.medoids].T, -np.inf), new
        i, j = np.nonzero(sim >= reach)
        rows, nodes = [i], [beam[i, j]]
        turn = [queries] if own else []
        live = at
        while len(live):
            if turn:
                node = turn.pop()
            else:
                live = live[open_[live].any(1)]
                best = np.where(open_[live], sim[live], -np.inf).argmax(1)
                node = beam[live, best]
                open_[live, best] = False
            near = self.near[node]
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            s = np.einsum("pd,pcd->pc", vec[live], self.x[near])
            s[~new] = -np.inf
            i, j = np.nonzero(s >= reach)
            rows.append(live[i]), nodes.append(near[i, j])
            all_s = np.concatenate([sim[live], s], 1)
            by = np.argpartition(-all_s, BEAM - 1, 1)[:, :BEAM]
            sim[live] = np.take_along_axis(all_s, by, 1)
            beam[live] = np.take_along_axis(np.concatenate([beam[live], near], 1), by, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], new], 1), by, 1) & np.isfinite(sim[live])
        r, k = np.concatenate(rows), np.concatenate(nodes).astype(np.int64)
        while len(r):
            more = [(r[:0], k[:0])]
            for lot in range(0, len(r), 1 << 14):
                rr, kk = r[lot : lot + (1 << 14)], k[lot : lot + (1 << 14)]
                many = self.first[kk + 1] - self.first[kk]
                kk = self.around[np.repeat(self.first[kk] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                rr = np.repeat(rr, many)
                new = ~seen[rr, kk]
                rr, kk = np.divmod(np.unique(rr[new].astype(np.int64) * (n + 1) + kk[new]), n + 1)
                seen[rr, kk] = True
                for part in range(0, len(rr), 1 << 15):
                    a, b = rr[part : part + (1 << 15)], kk[part : part + (1 << 15)]
                    far = np.einsum("pd,pd->p", vec[a], self.x[b]) >= reach
                    more.append((a[far], b[far]))
            r, k = (np.concatenate([m[i] for m in more]) for i in (0, 1))
            rows.append(r), nodes.append(k)
        return beam, rows, nodes


def _found(x: np.ndarray, graph: Graph, least: float, reach: float) -> np.ndarray:
    """Which two of the vectors `x` (float64) the graph's search finds, verified: a symmetric table of bits."""
    n = len(x)
    norm = np.sqrt(np.einsum("pd,pd->p", x, x))
    graph.both_ways()
    out = np.zeros((n, n), bool)
    for lot in range(0, n, QUERIES):
        queries = np.arange(lot, min(lot + QUERIES, n))
        _, rows, nodes = graph.search(queries, True, reach)
        for r, k in zip(rows, nodes, strict=True):
            for part in range(0, len(r), 1 << 15):
                a, b = queries[r[part : part + (1 << 15)]], k[part : part + (1 << 15)]
                hit = np.einsum("pd,pd->p", x[a], x[b]) / (norm[a] * norm[b]) >= least
                out[a[hit], b[hit]] = True
    return out | out.T


# --- layout -------------------------------------------------------------------------------------------------------


def _vectors(column, width: int) -> np.ndarray:
    """float64 vectors of a column of float64 bytes."""
    return np.frombuffer(b"".join(v.as_py() for v in column), np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("pd,pd->p", x, x))[:, None]


def _marked(vectors: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(id, key binary, vec binary) of each row: a hash of the components, and these padded by zeros to `width` and brought
    to a size between a half and one by a power of two; null where the vector links with nothing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("x")
            at, last = a.offsets.to_numpy(), None
            flat = a.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components are NaN
            size, start = np.diff(at), at[:-1]
            x = np.zeros((len(a), width))
            of = np.repeat(np.arange(len(a)), size)
            x[of, np.arange(len(of)) - np.repeat(start - at[0], size)] = flat[at[0] : at[-1]]
            high = np.abs(x).max(1, initial=0)
            good = np.isfinite(x).all(1) & (high > 0) & ~a.is_null().to_numpy(zero_copy_only=False)
            x = np.where(good[:, None], x, 1.0) + 0.0  # and no zero is negative
            keys = [xxhash.xxh3_128_digest(r.tobytes()) if g else None for r, g in zip(x, good.tolist(), strict=True)]
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array([r.tobytes() if g else None for r, g in zip(x, good.tolist(), strict=True)], pa.binary())], names=["id", "key", "vec"])

    rows_ = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows_.mapInArrow(rows, f"id {dict(rows_.dtypes)['id']}, key binary, vec binary")


def centres(sample: np.ndarray, many: int, rounds: int = 4) -> np.ndarray:
    """`many` unit vectors by k-means on the directions of `sample`, from an even choice of it."""
    x = _unit(sample)
    c = x[np.linspace(0, len(x) - 1, many).astype(int)]
    for _ in range(rounds):
        of = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        norm = np.sqrt((total**2).sum(1))
        c = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], c)
    return c


def _page(hash_: np.ndarray, cluster: np.ndarray, pages: np.ndarray) -> np.ndarray:
    mixed = mix64(hash_.view(np.uint64) + cluster.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (mixed % pages.astype(np.uint64)).astype(np.int64)


def _placed(nodes: DataFrame, pages: np.ndarray) -> DataFrame:
    """A row of `nodes` (node, hash, clusters and more) for each shard that it belongs to: cluster and two pages, of which
    its own is one."""
    rest = [c for c in nodes.columns if c != "shard"]
    start = np.append(0, np.cumsum(pages**2))

    def rows(batches):
        for batch in batches:
            c = np.stack([np.frombuffer(v.as_py(), np.int32) for v in batch.column("clusters")]).astype(np.int64) if batch.num_rows else np.zeros((0, 1), np.int64)
            of = np.repeat(np.arange(len(c)), c.shape[1])
            c = c.ravel()
            p = pages[c]
            own = np.repeat(_page(batch.column("hash").to_numpy()[of], c, p), p)
            other = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
            of, c = np.repeat(of, p), np.repeat(c, p)
            shard = start[c] + np.minimum(own, other) * pages[c] + np.maximum(own, other)
            for lot in range(0, len(of), 8192):
                part = batch.select(rest).take(pa.array(of[lot : lot + 8192]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shard[lot : lot + 8192])], names=[*rest, "shard"])

    return nodes.mapInArrow(rows, ", ".join(f"{c} {t}" for c, t in nodes.dtypes if c in rest) + ", shard long")


def _local(part: pa.Table, width: int) -> tuple[pa.Table, np.ndarray]:
    part = part.combine_chunks().sort_by([("hash", "ascending"), ("node", "ascending")])
    return part, _vectors(part.column("vec"), width)


def _search(nodes: DataFrame, centre: np.ndarray, overlap: int, width: int, least: float, reach: float) -> DataFrame:
    """(node, links, up) of `nodes` (node, hash, many, vec): rows of found links in a shard, with their number of vectors
    and the smallest node reached there."""
    overlap = min(overlap, len(centre))

    def clustered(batches):
        for batch in batches:
            sim = _unit(_vectors(batch.column("vec"), width)) @ centre.T
            by = np.sort(np.argpartition(-sim, overlap - 1, 1)[:, :overlap], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "hash", "many", "vec")), pa.array([r.tobytes() for r in by], pa.binary())], names=["node", "hash", "many", "vec", "clusters"])

    held = materialise(nodes.select("node", "hash", "many", "vec").mapInArrow(clustered, _NODE), "flatgraph-nodes")

    def tallied(batches):
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(v.as_py() for v in batch.column("clusters")), np.int32), minlength=len(centre))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centre))), pa.array(got.astype(np.int64))], names=["cluster", "n"])

    size = np.zeros(len(centre), np.int64)
    for r in held.select("clusters").mapInArrow(tallied, "cluster long, n long").groupBy("cluster").agg(F.sum("n").alias("n")).collect():  # one for each centre
        size[r.cluster] = r.n
    pages = np.maximum(1, -(-size // PAGE))
    start = np.append(0, np.cumsum(pages**2))

    def built(part: pa.Table) -> pa.Table:
        part, x = _local(part, width)
        graph = Graph(_unit(x).astype(np.float32)).build(np.arange(len(x))[np.argsort(mix64(part.column("hash").to_numpy().view(np.uint64)), kind="stable")])
        name = np.append(part.column("node").to_numpy(), -1)
        lists = [name[r[r < graph.n]].tobytes() for r in graph.near[:-1]]
        release()
        return pa.table({"node": part.column("node"), "near": pa.array(lists, pa.binary())})

    lists = _placed(held.select("node", "hash", "vec", "clusters"), pages).groupBy("shard").applyInArrow(built, "node long, near binary")
    flat = lists.groupBy("node").agg(F.collect_list("near").alias("near"))  # as many as a node has shards
    flat = materialise(held.join(flat.hint("merge"), "node"), "flatgraph-lists")

    def searched(part: pa.Table) -> pa.Table:
        shard = part.column("shard")[0].as_py()
        part, x = _local(part, width)
        n, name = len(x), part.column("node").to_numpy()
        by = np.argsort(name)
        lists = [np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in near])) for near in part.column("near").to_pylist()]
        many = np.array([len(v) for v in lists])
        to = np.concatenate(lists) if n else name
        at = np.minimum(np.searchsorted(name[by], to), n - 1)
        at = np.where(name[by][at] == to, by[at], n)
        of = np.repeat(np.arange(n), many)
        of, at = of[at < n], at[at < n]  # neighbours in other shards are found there
        many = np.bincount(of, minlength=n)
        near = np.full((n + 1, max(1, many.max())), n, np.int32)
        near[of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)] = at
        found = _found(x, Graph(_unit(x).astype(np.float32), near), least, reach)
        cluster = int(np.searchsorted(start, shard, side="right")) - 1
        pair = divmod(shard - start[cluster], pages[cluster])
        own = _page(part.column("hash").to_numpy(), np.full(n, cluster), np.full(n, pages[cluster]))
        mine = np.stack([np.frombuffer(v.as_py(), np.int32) for v in part.column("clusters")])
        weight = part.column("many").to_numpy()
        links, root = np.zeros(n, np.int64), np.arange(n)
        kept = []
        for lot in range(0, n, QUERIES):
            i, j = np.nonzero(found[lot : lot + QUERIES])
            i += lot
            common = np.where((mine[i][:, :, None] == mine[j][:, None, :]).any(2), mine[i], np.iinfo(np.int32).max).min(1) if len(i) else i
            here = (common == cluster) & (np.minimum(own[i], own[j]) == pair[0]) & (np.maximum(own[i], own[j]) == pair[1])
            i, j = i[here], j[here]
            np.add.at(links, i, weight[j])
            kept.append(np.stack([i, j]).astype(np.int32))
        i, j = np.concatenate(kept, 1) if kept else np.zeros((2, 0), np.int32)
        while len(i) and (root[i] != root[j]).any():
            np.minimum.at(root, root[i], root[j])
            while (root[root] != root).any():
                root = root[root]
        some = links > 0
        least_of = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least_of, root, name)
        release()
        return pa.table({"node": pa.array(name[some]), "links": pa.array(links[some]), "up": pa.array(least_of[root][some])})

    out = _placed(flat, pages).groupBy("shard").applyInArrow(searched, "node long, links long, up long")
    return materialise(out, "flatgraph-found")


def _true_links(nodes: DataFrame, queries: pa.Table, width: int, least: float) -> DataFrame:
    """(node, truth): vectors of `nodes` that each of `queries` (node, vec; bounded) links with, itself left out."""
    name, x = queries.column("node").to_numpy(), _vectors(queries.column("vec"), width)
    norm = np.sqrt(np.einsum("pd,pd->p", x, x))

    def rows(batches):
        for batch in batches:
            y = _vectors(batch.column("vec"), width)
            cos = (y @ x.T) / (np.sqrt(np.einsum("pd,pd->p", y, y))[:, None] * norm)
            hit = (cos >= least) & (batch.column("node").to_numpy()[:, None] != name)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array((hit * batch.column("many").to_numpy()[:, None]).sum(0))], names=["node", "truth"])

    return nodes.select("node", "many", "vec").mapInArrow(rows, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, overlap: int = 4, reach: float = 0.85, target: float = 0.98) -> tuple[DataFrame, float]:
    """((id, n_links, component_id, kept) of each row of `vectors`, recall of the audit).

    Vectors that are null, zero or hold null or non-finite components link with nothing, but are rows of the result. Equal
    vectors, repeated rows and rows of equal ids among them, link with each other and count as many; a shorter vector is
    compared as if zeros followed it. component_id is the smallest id that is not null, null if there is none, and such
    rows are not kept. Vectors of any size are brought to one by powers of two. The audit counts the links of AUDIT nodes
    or fewer against all vectors; recall is 1 where these have none. Other columns, whatever their names, are not read; an
    empty table gives an empty result."""
    width = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    width = max(1, width)
    marked = materialise(_marked(vectors, id_col, vector_col, width), "flatgraph-marked")
    nodes = marked.where("key is not null").groupBy("key").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("many"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), F.xxhash64("key").alias("hash"), "key", "vec", "least", "many"), "flatgraph-distinct")
    n = nodes.count()
    recall = 1.0
    if n:
        def some(most: int, salt: int) -> pa.Table:
            lots = max(1, n // most)
            return nodes.where(F.pmod(F.xxhash64("hash", F.lit(salt)), F.lit(lots)) == 0).select("hash", "node", "vec").orderBy("hash").limit(most).toArrow()

        fit = _vectors(some(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width))), 1).column("vec"), width)
        centre = centres(fit, max(1, min(n // MEAN, len(fit) // 8))) if len(fit) else np.ones((1, width)) / np.sqrt(width)
        queries = some(min(AUDIT, max(1, SAMPLE_BYTES // (8 * width))), 2)
        truth = materialise(_true_links(nodes, queries, width, least), "flatgraph-truth") if len(queries) else None
        while True:
            found = _search(nodes, centre, overlap, width, least, reach)
            if truth is None:
                break
            got = truth.join(found, "node", "left").groupBy("node", "truth").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("found"))
            met, all_ = got.agg(F.sum(F.least("truth", "found")), F.sum("truth")).first()
            recall = met / all_ if all_ else 1.0
            if recall >= target or overlap >= len(centre):
                break
            overlap *= 2
    else:
        found = nodes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("up"))
    of = connected_components(found.select(F.col("node").alias("src"), F.col("up").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.drop("vec").join(links.hint("merge"), "node", "left").join(of.hint("merge"), "node", "left")
    known = materialise(known.select("key", "least", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "flatgraph-known")
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = materialise(known.join(ids.hint("merge"), "component").select("key", "n_links", "component_id"), "flatgraph-ids")
    out = marked.select("id", "key").join(known.hint("merge"), "key", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))), recall


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumnRenamed("id", "vec_id")


def oracle(least: float = 0.95) -> str:
    """The same rows by comparing all pairs of a small table."""
    return f"""
WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.good AND b.good AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {least}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT u.vec_id, coalesce(n_links, 0) AS n_links, component_id, u.vec_id = component_id AS kept FROM u JOIN comp USING (vec_id) LEFT JOIN many USING (vec_id)"""
