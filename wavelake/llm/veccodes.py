"""Vector code compression: product codes of vectors, learned by exact integer k-means over metric trees.

A vector's components are taken as whole numbers floor(SCALE * x) and cut into PARTS equal parts; each part position has a
codebook of up to ENTRIES entries. The parts of a chunk of rows are arranged once in an anchors hierarchy, a tree of balls
for each part position: anchors are drawn from the points farthest from those before and steal by the triangle inequality,
each anchor's points are dealt to anchors of their own, and balls are merged middle-out, from the anchors up to the root
and from the inner anchors up to their anchor. A ball keeps its pivot, radius, and the sum and count of its points. A round
goes down the trees with lists of the entries that may own points of a ball; a child inherits its parent's list; entries
that lie farther from the pivot than the nearest one by more than twice the radius are dropped; a ball with one entry left
is wholly owned and gives its cached sum and count; leaves compare their points with what is left, in whole numbers.

The trees of a chunk are a row of a written table, read again each round; what a round sends is a sum for each entry of a
chunk, added up by Spark, and what the driver holds are the codebooks, of a size that the data do not change.
"""

from __future__ import annotations

import hashlib
import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CHUNK = 1 << 18  # components of a chunk: 4096 rows of 64
LEAF = 16  # points of a ball that is not divided
PLAIN = 1 << 20  # components up to this size are summed, and their distances worked out, in 64 bits
_LIMB = 40  # bits of the pieces in which sums are sent


# --- trees --------------------------------------------------------------------------------------------------------


def _anchors(x: np.ndarray, many: int) -> tuple[list[int], list[np.ndarray]]:
    """(pivots, points): up to `many` anchors of the points `x` (float64), each with the points nearest to it."""
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    by = np.argsort(-d, kind="stable")
    pivots, points, dists = [0], [by], [d[by]]  # points lie in falling distance
    while len(pivots) < many:
        k = max(range(len(pivots)), key=lambda i: dists[i][0])
        if dists[k][0] == 0:
            break
        new = points[k][0]
        got, far = [], []
        for i, pivot in enumerate(pivots):
            apart = np.sqrt(((x[new] - x[pivot]) ** 2).sum())
            n = int(np.searchsorted(-dists[i], -apart / 2, side="left"))  # nearer ones cannot be stolen
            if n:
                mine = points[i][:n]
                d = np.sqrt(((x[mine] - x[new]) ** 2).sum(1))
                lost = d < dists[i][:n]
                if lost.any():
                    got.append(mine[lost]), far.append(d[lost])
                    stay = np.append(~lost, np.ones(len(points[i]) - n, bool))
                    points[i], dists[i] = points[i][stay], dists[i][stay]
        got, far = np.concatenate(got), np.concatenate(far)
        by = np.argsort(-far, kind="stable")
        pivots.append(int(new)), points.append(got[by]), dists.append(far[by])
    return pivots, points


def _floats(exact: np.ndarray, bits: int) -> np.ndarray:
    """Whole numbers as floats; of very large ones without the last `bits`, so that squares stay finite."""
    return exact.astype(np.float64) if not bits else np.array([float(int(v) >> bits) for v in exact.ravel()]).reshape(exact.shape)


class _Forest:
    """The trees of a chunk, of all part positions, as flat arrays. points: (part, n, width) in tree order; bits: that
    pivots and radii leave out.

    first, last: a ball's points; left: its first child, the second follows it; -1 for leaves; part, pivot, radius, sum:
    as said. Balls come after their parents."""

    def __init__(self, parts: np.ndarray):
        n = parts.shape[1]
        self.order = np.empty((len(parts), n), np.int32)
        self.bits = np.array(0 if parts.dtype != object else max(0, max(abs(int(v)).bit_length() for v in parts.ravel()) - 60))
        nodes: list[tuple] = []
        for part in range(len(parts)):
            self._grow(part, parts[part], nodes)
        self.points = np.take_along_axis(parts, self.order[:, :, None].astype(np.int64), 1)
        self.part, self.first, self.last, self.left = (np.array([r[i] for r in nodes], np.int32) for i in range(4))
        self.pivot, self.radius = np.array([r[4] for r in nodes]), np.array([r[5] for r in nodes])
        total = np.concatenate([np.zeros_like(self.points[:, :1]), np.cumsum(self.points, axis=1)], axis=1)
        self.sum = total[self.part, self.last] - total[self.part, self.first]

    def _grow(self, part: int, exact: np.ndarray, nodes: list[tuple]) -> None:
        x = _floats(exact, int(self.bits))
        queue = [(len(nodes), 0, self._divide(x, np.arange(len(x))))]
        nodes.append(())
        for at, first, (pivot, kids, rows) in queue:  # grows while it is read: parents first
            radius, left = float(np.sqrt(((x[rows] - pivot) ** 2).sum(1)).max()), -1
            if kids is None:
                self.order[part, first : first + len(rows)] = rows
            else:
                left = len(nodes)
                nodes += [(), ()]
                queue += [(left, first, kids[0]), (left + 1, first + len(kids[0][2]), kids[1])]
            nodes[at] = (part, first, first + len(rows), left, pivot, radius)

    def _divide(self, x: np.ndarray, rows: np.ndarray) -> tuple:
        """A ball (pivot, its two balls or None, rows) of `rows`: anchors, each divided, then merged two by two."""
        if len(rows) <= LEAF:
            return x[rows].mean(0), None, rows
        pivots, points = _anchors(x[rows], int(np.sqrt(len(rows))))
        if len(pivots) == 1:  # all alike
            return x[rows[0]], None, rows
        return self._merge([self._divide(x, rows[p]) for p in points])

    @staticmethod
    def _merge(balls: list[tuple]) -> tuple:
        """Merges of the two balls whose union is smallest, until one is left."""
        balls = list(balls)
        c, n = [b[0] for b in balls], [len(b[2]) for b in balls]
        near = lambda i, j: float(((c[i] - c[j]) ** 2).sum())
        heap = [(near(i, j), i, j) for i in range(len(balls)) for j in range(i)]
        heapq.heapify(heap)
        live = set(range(len(balls)))
        while len(live) > 1:
            _, i, j = heapq.heappop(heap)
            if i in live and j in live:
                a, b = balls[j], balls[i]
                live -= {i, j}
                k = len(balls)
                c.append((c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])), n.append(n[i] + n[j])
                balls.append((c[k], (a, b), np.concatenate([a[2], b[2]])))
                for o in live:
                    heapq.heappush(heap, (near(k, o), k, o))
                live.add(k)
        return balls[live.pop()]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v if v.dtype != object else np.array([str(i) for i in v.ravel()]).reshape(v.shape) for k, v in vars(self).items()})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> _Forest:
        out = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as held:
            for k in held.files:
                v = held[k]
                setattr(out, k, v if v.dtype.kind != "U" else np.array([int(i) for i in v.ravel()], object).reshape(v.shape))
        return out

    def assign(self, books: list[np.ndarray], owned) -> tuple[np.ndarray, np.ndarray]:
        """(part, row) of points in leaves that no entry owns alone, with the entry of each, as (where, entry); balls that
        one entry owns are given to `owned(balls, entries)`."""
        size = max(len(b) for b in books)
        entry = np.full((len(books), size, self.points.shape[2]), np.inf)
        for k, b in enumerate(books):
            entry[k, : len(b)] = np.minimum(_floats(b, int(self.bits)), 1e100)
        at = np.flatnonzero(self.first[: len(self.part)] == 0)
        at = at[np.append(True, np.diff(self.part[at]) > 0)] if len(at) else at  # roots
        may = np.isfinite(entry[self.part[at], :, 0])
        where, which = [], []
        kind = object if any(b.dtype == object for b in [self.points, *books]) else np.int64
        while len(at):
            far = np.sqrt(((self.pivot[at][:, None] - entry[self.part[at]]) ** 2).sum(2))
            far = np.where(may, far, np.inf)
            reach = far.min(1) + 2 * self.radius[at]
            may &= far <= (reach * (1 + 1e-9) + (64 if self.bits else 1e-6))[:, None]  # what rounding could change stays
            one = may.sum(1) == 1
            if one.any():
                owned(at[one], may[one].argmax(1))
            at, may = at[~one], may[~one]
            leaf = self.left[at] < 0
            if leaf.any():
                n = (self.last - self.first)[at[leaf]].astype(np.int64)
                of = np.repeat(np.arange(len(n)), n)
                row = self.first[at[leaf]][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
                part = self.part[at[leaf]][of]
                point, mask = self.points[part, row], may[leaf][of]
                best = np.full(len(of), -1)
                least = np.zeros(len(of), kind)
                for e in range(size):
                    rows = np.flatnonzero(mask[:, e])
                    if len(rows):
                        code = np.array([b[e] if e < len(b) else b[0] for b in books])[part[rows]]
                        d = ((point[rows] - code) ** 2).sum(1)
                        better = (best[rows] < 0) | (d < least[rows])
                        best[rows[better]], least[rows[better]] = e, d[better]
                where.append(part.astype(np.int64) * self.points.shape[1] + row), which.append(best)
            at, may = at[~leaf], may[~leaf]
            at = np.stack([self.left[at], self.left[at] + 1], 1).ravel()
            may = np.repeat(may, 2, axis=0)
        none = np.zeros(0, np.int64)
        return (np.concatenate(where), np.concatenate(which)) if where else (none, none)

    def sums(self, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts) of the points of each entry of each part position."""
        size = max(len(b) for b in books)
        total = np.zeros((len(books), size, self.points.shape[2]), self.points.dtype)
        count = np.zeros((len(books), size), np.int64)

        def owned(balls: np.ndarray, entries: np.ndarray) -> None:
            np.add.at(total, (self.part[balls], entries), self.sum[balls])
            np.add.at(count, (self.part[balls], entries), (self.last - self.first)[balls])

        where, which = self.assign(books, owned)
        part, row = np.divmod(where, self.points.shape[1])
        np.add.at(total, (part, which), self.points[part, row])
        np.add.at(count, (part, which), 1)
        return total, count

    def codes(self, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(codes (n, parts), squared distances summed over parts (n)), rows in the chunk's order."""
        n = self.points.shape[1]
        code = np.zeros((len(books), n), np.int64)

        def owned(balls: np.ndarray, entries: np.ndarray) -> None:
            for b, e in zip(balls.tolist(), entries.tolist(), strict=True):
                code[self.part[b], self.first[b] : self.last[b]] = e

        where, which = self.assign(books, owned)
        code.ravel()[where] = which
        out = np.zeros((n, len(books)), np.uint8)
        error = np.zeros(n, object if any(b.dtype == object for b in [self.points, *books]) else np.int64)
        for k, b in enumerate(books):
            out[self.order[k], k] = code[k]
            error[self.order[k]] += ((self.points[k] - b[code[k]]) ** 2).sum(1)
        return out, error


# --- operator -----------------------------------------------------------------------------------------------------


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite float64 values, in 64 bits where all are small, else Python's integers."""
    y = np.floor(x * SCALE) if np.abs(x).max(initial=0) < 1e300 else None
    if y is not None and np.abs(y).max(initial=0) <= PLAIN:
        return y.astype(np.int64)
    flat = np.array([int(v) * SCALE if float(v).is_integer() else int(np.floor(v * SCALE)) for v in x.ravel().tolist()], object)
    return flat.reshape(x.shape)


def _usable(column: Column) -> Column:
    return column.isNotNull() & F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def _matrix(batch: pa.RecordBatch | pa.Table, column: str, width: int) -> np.ndarray:
    a = batch.column(column)
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _forests(rows: DataFrame, width: int) -> DataFrame:
    """(forest, who binary): the trees of chunks of `rows` (id, label, x), and ids and labels in the chunk's order."""

    most = max(1, CHUNK // width)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = whole_numbers(_matrix(t, "x", width))
            parts = x.reshape(len(x), PARTS, -1).transpose(1, 0, 2)
            out = io.BytesIO()
            with pa.ipc.new_stream(out, t.select(["id", "label"]).schema) as w:
                w.write_table(t.select(["id", "label"]))
            return pa.RecordBatch.from_arrays([pa.array([_Forest(parts).dump()], pa.binary()), pa.array([out.getvalue()], pa.binary())], names=["forest", "who"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(most - sum(b.num_rows for b in held), batch.num_rows - at)
                held.append(batch.slice(at, n))
                at += n
                if sum(b.num_rows for b in held) == most:
                    yield made()
                    held.clear()
        if held:
            yield made()
        release()

    return rows.select("id", "label", "x").mapInArrow(grown, "forest binary, who binary")


def _next(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: entries replaced by the floor of their points' mean."""

    def added(batches):
        for batch in batches:
            for raw in batch.column("forest"):
                total, count = _Forest.load(raw.as_py()).sums(books)
                keys, values = [], []
                for p, e in np.argwhere(count).tolist():
                    for k, v in enumerate([*total[p, e].tolist(), int(count[p, e])]):
                        sign, v, limb = (1 if v >= 0 else -1), abs(int(v)), 0
                        while v:
                            keys.append((p, e, k, limb)), values.append(sign * (v & ((1 << _LIMB) - 1)))
                            v >>= _LIMB
                            limb += 1
                cols = np.array(keys, np.int32).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(values, pa.int64())], names=["part", "entry", "at", "limb", "value"])

    sent = trees.select("forest").mapInArrow(added, "part int, entry int, at int, limb int, value long")
    got = sent.groupBy("part", "entry", "at", "limb").agg(F.sum(F.col("value").cast("decimal(28, 0)")).alias("value")).collect()  # of the codebooks' size
    width = books[0].shape[1]
    total: dict[tuple, int] = {}
    for r in got:
        total[r.part, r.entry, r["at"]] = total.get((r.part, r.entry, r["at"]), 0) + (int(r.value) << (_LIMB * r.limb))
    out = []
    for p, b in enumerate(books):
        new = [[total.get((p, e, k), 0) // n for k in range(width)] if (n := total.get((p, e, width), 0)) else b[e].tolist() for e in range(len(b))]
        out.append(_entries(new))
    return out


def _entries(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(v) <= PLAIN for r in rows for v in r)
    return np.array(rows, np.int64 if small else object)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code binary, error long) of `vectors`, codebooks).

    Rows whose vector is null or has null or non-finite components are dropped; so are vectors that cannot be cut into
    PARTS equal parts of one length: those whose length is not that of the smallest id's vector of such a length. Null ids
    come last in the order of ids, equal ids in the order of their vectors. Equal vectors have equal codes; fewer than
    ENTRIES rows make as many entries. Components of any finite size are exact; an error beyond 64 bits is null. Other
    columns, whatever their names, are not read; an empty table gives an empty result and empty codebooks."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")).where(_usable(x) & (F.size(x) > 0) & (F.size(x) % PARTS == 0))
    first = lambda df: df.orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    least = first(rows)
    if not least:
        return rows.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), [np.zeros((0, 0), np.int64)] * PARTS
    width = len(least[0].x)
    rows = rows.where(F.size("x") == width)
    if any(len(r.x) != width for r in least):
        least = first(rows)
    start = whole_numbers(np.array([r.x for r in least], np.float64)).reshape(len(least), PARTS, -1)
    books = [_entries(start[:, k].tolist()) for k in range(PARTS)]
    trees = materialise(_forests(rows, width), "veccodes-trees")
    for _ in range(rounds):
        books = _next(trees, books)

    def coded(batches):
        for batch in batches:
            for raw, who in zip(batch.column("forest"), batch.column("who"), strict=True):
                code, error = _Forest.load(raw.as_py()).codes(books)
                t = pa.ipc.open_stream(who.as_py()).read_all().combine_chunks()
                error = pa.array([v if v < 1 << 63 else None for v in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), t.column("label").combine_chunks(), pa.array([r.tobytes() for r in code], pa.binary()), error], names=["id", "label", "code", "error"])
        release()

    kinds = dict(rows.dtypes)
    return trees.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code binary, error long"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"))
    out = materialise(out, "veccodes-coded")
    joined = ",".join(str(v) for b in books for e in b.tolist() for v in e)
    by = out.groupBy(F.col("label").alias("label_")).agg(F.try_sum("error").alias("label_error"))
    out = out.join(by, F.col("label").eqNullSafe(F.col("label_")))
    sha = F.lit(hashlib.sha256(joined.encode()).hexdigest())
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", sha.alias("codebooks_sha256"))


def oracle() -> str:
    """The same rows by comparing every part with every entry, a common table expression each round."""
    assign = "SELECT i, p, arg_min(e, d * {n} + e) AS e, min(d) AS d FROM (SELECT x.i, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN {book} c USING (p, k) GROUP BY ALL) GROUP BY ALL".replace("{n}", str(ENTRIES))
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({assign.format(book=f'c{r}')})")
        steps.append(f"m{r} AS MATERIALIZED (SELECT p, k, e, CAST(floor(sum(v) / count(*)) AS BIGINT) AS low, sum(v)::HUGEINT AS s, count(*) AS n FROM x JOIN a{r} USING (i, p) GROUP BY ALL)")
        exact = "CASE WHEN m.n IS NULL THEN c.v WHEN m.s - (m.s // m.n) * m.n < 0 THEN m.s // m.n - 1 ELSE m.s // m.n END"
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, c.e, CAST({exact} AS BIGINT) AS v FROM c{r} c LEFT JOIN m{r} m USING (p, k, e))")
    return f"""
WITH u AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT i, (j - 1) // 8 AS p, (j - 1) % 8 AS k, CAST(floor({SCALE} * embedding[j]::DOUBLE) AS BIGINT) AS v FROM u, range(1, 65) t(j)),
c0 AS MATERIALIZED (SELECT p, k, i AS e, v FROM x WHERE i < {ENTRIES}),
{', '.join(steps)},
a AS MATERIALIZED ({assign.format(book=f'c{ROUNDS}')}),
sha AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM c{ROUNDS}),
coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a GROUP BY i)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN u USING (i), sha"""
