"""Rate and distortion of coding passes, and their allocation to quality layers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _by():
    return Window.partitionBy("cblk").orderBy("passno")


def slopes(passes: DataFrame) -> DataFrame:
    """dr, dd and slope dd/dr of each pass (null without bytes)."""
    dr = F.col("rate") - F.coalesce(F.lag("rate").over(_by()), F.lit(0).cast("long"))
    dd = F.col("dist") - F.coalesce(F.lag("dist").over(_by()), F.lit(0).cast("long"))
    return passes.withColumn("dr", dr).withColumn("dd", dd).withColumn("slope", F.when(F.col("dr") != 0, F.col("dd").cast("double") / F.col("dr")))


def repaired(passes: DataFrame, rate: str = "rate") -> DataFrame:
    """Rates that never fall: each the least of its own and all later ones; and the length of each pass."""
    after = _by().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    r = passes.withColumn("fixed", F.min(rate).over(after))
    return r.withColumn("len", F.col("fixed") - F.coalesce(F.lag("fixed").over(_by()), F.lit(0).cast("long")))


def greedy(passes: DataFrame, threshold: float) -> DataFrame:
    """(cblk, taken, rate, dist): passes that a layer takes. A pass is taken if its slope, counted from the last pass
    that was taken, reaches the threshold; without bytes it is taken only if it lowers the distortion. An ordered fold
    over each code-block's passes, as the base moves only when a pass is taken."""
    per = passes.groupBy("cblk").agg(F.sort_array(F.collect_list(F.struct("passno", "rate", "dist"))).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("rate"), F.lit(0).cast("long").alias("dist"))

    def step(s: Column, p: Column) -> Column:
        dr, dd = p["rate"] - s["rate"], p["dist"] - s["dist"]
        take = F.when(dr == 0, dd != 0).otherwise(F.lit(threshold) - dd.cast("double") / dr < 2.2e-16) if threshold >= 0 else F.lit(True)
        return F.when(take, F.struct((p["passno"] + 1).alias("taken"), p["rate"].alias("rate"), p["dist"].alias("dist"))).otherwise(s)

    return per.select("cblk", F.aggregate("p", start, step).alias("s")).select("cblk", "s.taken", "s.rate", "s.dist")


def fixed_layers(passes: DataFrame, layers: int) -> DataFrame:
    """Passes of each code-block dealt to `layers` layers in equal shares; the last takes the rest."""
    n = F.count("*").over(Window.partitionBy("cblk"))
    each = F.greatest(F.floor(n / layers), F.lit(1))
    return passes.withColumn("layno", F.least(F.floor(F.col("passno") / each), F.lit(layers - 1)).cast("long"))


def distortion_target(distortion: Column, max_error: Column, psnr: float) -> Column:
    return distortion - max_error / F.pow(F.lit(10.0), F.lit(psnr / 10))


# --- thresholds of a quality ----------------------------------------------------------------------------------------

#: When a search has settled, how many steps it may take, and the slack of a slope (fixed values).
SETTLED, STEPS, SLACK = 0.5e-5, 128, 2.2e-16
LOT = 1 << 18  # passes that a task searches at once


class _Blocks:
    """Passes of the code-blocks of several tiles, a row for each block."""

    def __init__(self, tile: np.ndarray, cblk: np.ndarray, passno: np.ndarray, rate: np.ndarray, dist: np.ndarray):
        by = np.lexsort((passno, cblk, tile))
        tile, cblk, rate, dist = tile[by], cblk[by], rate[by], dist[by]
        first = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (cblk[1:] != cblk[:-1])))
        n = np.diff(np.append(first, len(tile)))
        self.tiles, self.of = np.unique(tile[first], return_inverse=True)
        row, col = np.repeat(np.arange(len(n)), n), np.arange(len(tile)) - np.repeat(first, n)
        self.rate, self.dist, self.live = (np.zeros((len(n), n.max(initial=0)), t) for t in (np.int64, np.int64, bool))
        self.rate[row, col], self.dist[row, col], self.live[row, col] = rate, dist, True
        # slopes of passes that have bytes
        dr = np.diff(self.rate, axis=1, prepend=0)
        some = self.live & (dr != 0)
        slope = np.diff(self.dist, axis=1, prepend=0) / np.where(some, dr, 1)
        self.low, self.high = np.full(len(self.tiles), np.finfo(float).max), np.zeros(len(self.tiles))
        np.minimum.at(self.low, self.of, np.where(some, slope, np.finfo(float).max).min(1, initial=np.finfo(float).max))
        np.maximum.at(self.high, self.of, np.where(some, slope, 0).max(1, initial=0))

    def taken(self, threshold: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Passes of each block, `start` of them at least, that reach its tile's threshold: as in greedy()."""
        out, at = start.copy(), np.arange(len(start))
        known = start > 0
        rate, dist = (np.where(known, v[at, np.maximum(start - 1, 0)], 0) for v in (self.rate, self.dist))
        least = threshold[self.of]
        for k in range(self.rate.shape[1]):
            dr, dd = self.rate[:, k] - rate, self.dist[:, k] - dist
            take = np.where(dr == 0, dd != 0, least - dd / np.where(dr == 0, 1, dr) < SLACK) & self.live[:, k] & (k >= start)
            out, rate, dist = np.where(take, k + 1, out), np.where(take, self.rate[:, k], rate), np.where(take, self.dist[:, k], dist)
        return out

    def totals(self, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rate, distortion) of each tile, of whole numbers."""
        at, out = np.arange(len(taken)), []
        for v in (self.rate, self.dist):
            total = np.zeros(len(self.tiles), np.int64)
            np.add.at(total, self.of, np.where(taken > 0, v[at, np.maximum(taken - 1, 0)], 0))
            out.append(total)
        return out[0], out[1]

    def search(self, target: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The threshold of each tile: halving steps from its least and largest slope, all tiles side by side."""
        low, high = self.low.copy(), self.high.copy()
        at, stable = np.zeros(len(low)), np.zeros(len(low))
        live = np.ones(len(low), bool)
        for _ in range(STEPS):
            new = (low + high) / 2
            live &= np.abs(new - at) > SETTLED * at
            if not live.any():
                break
            at = np.where(live, new, at)
            short = self.totals(self.taken(at, start))[1] < target
            high, stable = np.where(live & short, at, high), np.where(live & short, at, stable)
            low = np.where(live & ~short, at, low)
        return np.where(stable == 0, at, stable)


def quality_layers(passes: DataFrame, shares: list[float], lot: int = LOT) -> DataFrame:
    """(tile, layno, threshold, blocks, rate, dist) of `passes` (tile, cblk, passno, rate, dist): for each layer the
    threshold at which the distortion that it and those before take away falls just short of its share of the tile's,
    with the code-blocks that have passes in it and the bytes and distortion up to it. A tile is searched in one task, with
    others up to about `lot` passes; there is no job for a step."""
    lots = max(1, -(-passes.count() // lot))

    def searched(part: pa.Table) -> pa.Table:
        b = _Blocks(*(part.column(c).to_numpy() for c in ("tile", "cblk", "passno", "rate", "dist")))
        taken, out = np.zeros(len(b.of), np.int64), []
        everything = b.totals(b.live.sum(1))[1]
        for k, share in enumerate(shares):
            threshold = b.search(share * everything, taken)
            now = b.taken(threshold, taken)
            blocks = np.bincount(b.of, weights=now > taken, minlength=len(b.tiles)).astype(np.int64)
            taken = now
            out.append(pa.table({"tile": b.tiles, "layno": np.full(len(b.tiles), k), "threshold": threshold, "blocks": blocks, **dict(zip(("rate", "dist"), b.totals(taken), strict=True))}))
        return pa.concat_tables(out)

    dealt = passes.select("tile", "cblk", "passno", "rate", "dist", F.pmod(F.xxhash64("tile"), F.lit(lots)).alias("lot"))
    return dealt.groupBy("lot").applyInArrow(lambda t: searched(t), "tile long, layno long, threshold double, blocks long, rate long, dist long")
