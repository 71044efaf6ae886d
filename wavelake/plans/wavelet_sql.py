"""DuckDB SQL of one level of a wavelet on relations (image_id, x0, y0, y, x, v), by window functions on coordinates."""

from __future__ import annotations

from ..operators.wavelet import ALPHA, BETA, DELTA, GAMMA, K

K_HIGH = 1.625732422


def _window(axis: str) -> str:
    other = "y" if axis == "x" else "x"
    return f"WINDOW w AS (PARTITION BY image_id, {other} ORDER BY {axis})"


_ENDS = "(coalesce(lag(v) OVER w, lead(v) OVER w) + coalesce(lead(v) OVER w, lag(v) OVER w))"


def _apart(src: str, out: str, axis: str) -> str:
    """Lows first, then highs, along an axis."""
    o, other = f"{axis}0", "y" if axis == "x" else "x"
    return f"""{out} AS MATERIALIZED (SELECT image_id, x0, y0, {other}, CASE WHEN ({axis} + {o}) % 2 = 0 THEN ({axis} + {o}) // 2 - ({o} + 1) // 2
  ELSE (n + {o} + 1) // 2 - ({o} + 1) // 2 + ({axis} + {o}) // 2 - {o} // 2 END AS {axis}, v FROM (SELECT *, count(*) OVER (PARTITION BY image_id, {other}) AS n FROM {src}))"""


def _together(src: str, out: str, axis: str) -> str:
    o, other = f"{axis}0", "y" if axis == "x" else "x"
    return f"""{out} AS MATERIALIZED (SELECT image_id, x0, y0, {other}, CASE WHEN {axis} < lows THEN 2 * ({axis} + ({o} + 1) // 2) - {o} ELSE 2 * ({axis} - lows + {o} // 2) + 1 - {o} END AS {axis}, v
  FROM (SELECT *, (count(*) OVER (PARTITION BY image_id, {other}) + {o} + 1) // 2 - ({o} + 1) // 2 AS lows FROM {src}))"""


def _step(src: str, out: str, axis: str, parity: int, value: str) -> str:
    other = "y" if axis == "x" else "x"
    return f"{out} AS MATERIALIZED (SELECT image_id, x0, y0, {other}, {axis}, CASE WHEN ({axis} + {axis}0) % 2 = {parity} THEN {value} ELSE v END AS v FROM {src} {_window(axis)})"


def forward_sql(src: str, out: str, low_of: str | None = None) -> str:
    """CTEs of one level of the 5/3 wavelet, columns first; low_of: on the low corner of an earlier level's output."""
    head = []
    if low_of:
        n = lambda a: f"(max({a}) OVER (PARTITION BY image_id) + 1 + {a}0 + 1) // 2 - ({a}0 + 1) // 2"
        head = [f"{src} AS MATERIALIZED (SELECT image_id, (x0 + 1) // 2 AS x0, (y0 + 1) // 2 AS y0, y, x, v FROM (SELECT *, {n('x')} AS nx, {n('y')} AS ny FROM {low_of}) WHERE x < nx AND y < ny)"]
    parts, last = head, src
    for a in "yx":
        parts += [_step(last, f"{out}_{a}1", a, 1, f"v - ({_ENDS} >> 1)"), _step(f"{out}_{a}1", f"{out}_{a}2", a, 0, f"v + (({_ENDS} + 2) >> 2)")]
        last = out if a == "x" else f"{out}_{a}3"
        parts.append(_apart(f"{out}_{a}2", last, a))
    return ",\n".join(parts)


def inverse_sql(src: str, out: str) -> str:
    """CTEs of one level back, rows first."""
    parts, last = [], src
    for a in "xy":
        parts += [_together(last, f"{out}_{a}0", a), _step(f"{out}_{a}0", f"{out}_{a}1", a, 0, f"v - (({_ENDS} + 2) >> 2)")]
        last = out if a == "y" else f"{out}_{a}2"
        parts.append(_step(f"{out}_{a}1", last, a, 1, f"v + ({_ENDS} >> 1)"))
    return ",\n".join(parts)


def lifted_97(src: str, out: str, ahead: bool) -> str:
    """CTEs of one level of the 9/7 wavelet in single precision."""
    parts, last = [f"{out}_f AS MATERIALIZED (SELECT image_id, x0, y0, y, x, CAST(v AS FLOAT) AS v FROM {src})"], f"{out}_f"
    steps = ((ALPHA, 1), (BETA, 0), (GAMMA, 1), (DELTA, 0))
    scale = lambda s, o, a, low, high: f"{o} AS MATERIALIZED (SELECT image_id, x0, y0, {'y' if a == 'x' else 'x'}, {a}, v * CASE WHEN ({a} + {a}0) % 2 = 0 THEN ({low})::FLOAT ELSE ({high})::FLOAT END AS v FROM {s})"
    for a in "yx" if ahead else "xy":
        if not ahead:
            parts += [_together(last, f"{out}_{a}t", a), scale(f"{out}_{a}t", f"{out}_{a}s", a, K, K_HIGH)]
            last = f"{out}_{a}s"
        for i, (c, parity) in enumerate(steps if ahead else reversed(steps)):
            parts.append(_step(last, f"{out}_{a}{i}", a, parity, f"v + {_ENDS} * ({c if ahead else -c})::FLOAT"))
            last = f"{out}_{a}{i}"
        if ahead:
            parts += [scale(last, f"{out}_{a}s", a, 1 / K, K), _apart(f"{out}_{a}s", f"{out}_{a}t", a)]
            last = f"{out}_{a}t"
    return ",\n".join([*parts, f"{out} AS MATERIALIZED (SELECT * FROM {last})"])
