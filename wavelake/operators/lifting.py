"""Wavelets on planes of any size and origin, as Arrow batches over the rows of a table.

A plane is a row: its origin (x0, y0), its width, and its samples row by row. Whether a sample is low or high is told by
its coordinate in the image, even or odd, so an odd origin begins with a high one. A line of one sample is kept if low and
doubled (halved on the way back) if high in the 5/3 wavelet, and kept in the 9/7 one. Lows come before highs.

All lines of a plane are lifted at once by numpy; a plane moves nowhere, so tiles are the unit of parallel work. Null
planes stay null; a plane without samples stays empty; repeated rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wavelet import ALPHA, BETA, DELTA, GAMMA, K

#: Scale of the high band on the way back in the 9/7 wavelet (fixed value).
HIGH_SCALE = 1.625732422


def _neighbours(n: int, parity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of one parity, their left and right neighbours, mirrored at the ends)."""
    at = np.arange(parity, n, 2)
    return at, np.where(at > 0, at - 1, at + 1), np.where(at + 1 < n, at + 1, at - 1)


def _split(a: np.ndarray, odd: int) -> np.ndarray:
    return np.concatenate([a[..., odd::2], a[..., 1 - odd :: 2]], axis=-1)


def _merge(a: np.ndarray, odd: int) -> np.ndarray:
    n = a.shape[-1]
    lows = (n + 1 - odd) // 2
    out = np.empty_like(a)
    out[..., odd::2], out[..., 1 - odd :: 2] = a[..., :lows], a[..., lows:]
    return out


def forward53(a: np.ndarray, origin: int) -> np.ndarray:
    n, odd = a.shape[-1], origin & 1
    if n < 2:
        return a << 1 if n and odd else a
    a = a.copy()
    at, left, right = _neighbours(n, 1 - odd)
    a[..., at] -= (a[..., left] + a[..., right]) >> 1
    at, left, right = _neighbours(n, odd)
    a[..., at] += (a[..., left] + a[..., right] + 2) >> 2
    return _split(a, odd)


def inverse53(a: np.ndarray, origin: int) -> np.ndarray:
    n, odd = a.shape[-1], origin & 1
    if n < 2:
        return np.trunc(a / 2).astype(a.dtype) if n and odd else a
    a = _merge(a, odd)
    at, left, right = _neighbours(n, odd)
    a[..., at] -= (a[..., left] + a[..., right] + 2) >> 2
    at, left, right = _neighbours(n, 1 - odd)
    a[..., at] += (a[..., left] + a[..., right]) >> 1
    return a


def _lift(a: np.ndarray, parity: int, c: float) -> None:
    at, left, right = _neighbours(a.shape[-1], parity)
    a[..., at] += (a[..., left] + a[..., right]) * np.float32(c)


def forward97(a: np.ndarray, origin: int) -> np.ndarray:
    n, odd = a.shape[-1], origin & 1
    a = a.astype(np.float32)
    if n < 2:
        return a
    for c, parity in ((ALPHA, 1 - odd), (BETA, odd), (GAMMA, 1 - odd), (DELTA, odd)):
        _lift(a, parity, c)
    a[..., odd::2] *= np.float32(1 / K)
    a[..., 1 - odd :: 2] *= np.float32(K)
    return _split(a, odd)


def inverse97(a: np.ndarray, origin: int) -> np.ndarray:
    """Undoes the decoder's side of the transform: highs are scaled by HIGH_SCALE, twice what forward97() would ask for,
    as that side's step sizes are halved."""
    n, odd = a.shape[-1], origin & 1
    a = a.astype(np.float32)
    if n < 2:
        return a
    a = _merge(a, odd)
    a[..., odd::2] *= np.float32(K)
    a[..., 1 - odd :: 2] *= np.float32(HIGH_SCALE)
    for c, parity in ((DELTA, odd), (GAMMA, 1 - odd), (BETA, odd), (ALPHA, 1 - odd)):
        _lift(a, parity, -c)
    return a


def levels_of(x0: int, y0: int, w: int, h: int, levels: int) -> list[tuple[int, int, int, int]]:
    """(x0, y0, w, h) of the plane that each level works on, the largest first."""
    out = []
    for _ in range(levels):
        out.append((x0, y0, w, h))
        x1, y1 = (x0 + w + 1) // 2, (y0 + h + 1) // 2
        x0, y0 = (x0 + 1) // 2, (y0 + 1) // 2
        w, h = x1 - x0, y1 - y0
    return out


def forward(plane: np.ndarray, x0: int, y0: int, levels: int, line: Callable) -> np.ndarray:
    """Columns first, then rows, at each level on the low corner of the last."""
    out = plane.astype(np.float32) if line is forward97 else plane.copy()
    for x, y, w, h in levels_of(x0, y0, plane.shape[1], plane.shape[0], levels):
        if w and h:
            out[:h, :w] = line(line(out[:h, :w].T, y).T, x)
    return out


def inverse(plane: np.ndarray, x0: int, y0: int, levels: int, line: Callable) -> np.ndarray:
    """Rows first, then columns, from the smallest corner on."""
    out = plane.astype(np.float32) if line is inverse97 else plane.copy()
    for x, y, w, h in reversed(levels_of(x0, y0, plane.shape[1], plane.shape[0], levels)):
        if w and h:
            out[:h, :w] = line(line(out[:h, :w], x).T, y).T
    return out


def window_inverse(plane: np.ndarray, x0: int, y0: int, levels: int, line: Callable, region: tuple[int, int, int, int]) -> np.ndarray:
    """The region (left, top, right, bottom, within the plane) of inverse(), from the samples that it depends on: each level
    takes the lows and highs under the region, grown by the filter's reach, and nothing else."""
    reach = 2 if line is inverse53 else 4
    steps = levels_of(x0, y0, plane.shape[1], plane.shape[0], levels)
    windows = [region]  # of each level's output, the largest first
    spans = []
    for x, y, w, h in steps:
        a, b, c, d = windows[-1]
        cut = []
        for lo, hi, o, n in ((a, c, x, w), (b, d, y, h)):
            lo, hi = max(0, lo - reach), min(n, hi + reach)
            low = ((lo + o + 1) // 2 - (o + 1) // 2, (hi + o + 1) // 2 - (o + 1) // 2)  # lows among the samples lo..hi
            cut.append((lo, hi, low))
        spans.append(cut)
        windows.append((cut[0][2][0], cut[1][2][0], cut[0][2][1], cut[1][2][1]))
    a, b, c, d = windows[-1]
    low = plane[b:d, a:c]
    for k in range(levels - 1, -1, -1):
        x, y, w, h = steps[k]
        (lo_x, hi_x, (lx0, lx1)), (lo_y, hi_y, (ly0, ly1)) = spans[k]
        lows_x, lows_y = (x + w + 1) // 2 - (x + 1) // 2, (y + h + 1) // 2 - (y + 1) // 2
        hx, hy = (lows_x + lo_x - lx0, lows_x + hi_x - lx1), (lows_y + lo_y - ly0, lows_y + hi_y - ly1)
        rows = np.concatenate([np.concatenate([low, plane[ly0:ly1, hx[0] : hx[1]]], axis=1), np.concatenate([plane[hy[0] : hy[1], lx0:lx1], plane[hy[0] : hy[1], hx[0] : hx[1]]], axis=1)])
        whole = line(line(rows, x + lo_x).T, y + lo_y).T if rows.size else rows
        a, b, c, d = windows[k]
        low = whole[b - lo_y : d - lo_y, a - lo_x : c - lo_x]
    return low


LINES = {("53", True): forward53, ("53", False): inverse53, ("97", True): forward97, ("97", False): inverse97}


def transformed(planes: DataFrame, kind: str, back: bool = False, levels: int = 1, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """`planes` (image_id, compno, x0, y0, w, vals array<long> or array<double>) with the plane transformed; 9/7 samples are
    doubles. back: the inverse; region: only this window of it (left, top, right, bottom), whose width is the new w."""
    line = LINES[kind, not back]
    element = "double" if kind == "97" else "bigint"
    schema = f"image_id long, compno long, x0 long, y0 long, w long, vals array<{element}>"
    kind_of = pa.float64() if kind == "97" else pa.int64()

    def rows(batches):
        for batch in batches:
            out, widths = [], []
            vals = batch.column("vals")
            for i in range(batch.num_rows):
                x0, y0, w = (batch.column(c)[i].as_py() for c in ("x0", "y0", "w"))
                if not vals[i].is_valid or not w:
                    out.append(None if not vals[i].is_valid else [])
                    widths.append(w)
                    continue
                plane = vals[i].values.to_numpy(zero_copy_only=False).reshape(-1, w)
                plane = plane.astype(np.float32 if kind == "97" else np.int64)
                if region is not None:
                    plane = window_inverse(plane, x0, y0, levels, line, region)
                else:
                    plane = (inverse if back else forward)(plane, x0, y0, levels, line)
                out.append(np.ascontiguousarray(plane).ravel().astype(np.float64 if kind == "97" else np.int64))
                widths.append(plane.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "compno", "x0", "y0")), pa.array(widths, pa.int64()), pa.array(out, pa.list_(kind_of))], names=["image_id", "compno", "x0", "y0", "w", "vals"])

    return planes.select("image_id", "compno", "x0", "y0", "w", "vals").mapInArrow(rows, schema)
