"""The geometric union of polygons: one outline of each group, with its holes and parts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import _as_rings

RINGS = "array<array<struct<x: double, y: double>>>"
CHUNK = 4_000_000  # pairs of edges, or of points and edges, that are looked at in one go


def _segments(shapes: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n, 4) of all rings, and the shape each belongs to."""
    parts, owner = [], []
    for k, rings in enumerate(shapes):
        for r in rings:
            e = np.concatenate([r, np.roll(r, -1, axis=0)], axis=1)
            e = e[(e[:, :2] != e[:, 2:]).any(axis=1)]
            parts.append(e)
            owner.append(np.full(len(e), k))
    return (np.concatenate(parts), np.concatenate(owner)) if parts else (np.zeros((0, 4)), np.zeros(0, np.int64))


def _near(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a, b) whose boxes overlap, in pieces: b is sorted by its lower x, so that each a
    looks only at those that begin before it ends and reach no less than the widest b back."""
    order = np.argsort(low_b[:, 0], kind="stable")
    start = low_b[order, 0]
    wide = (high_b[:, 0] - low_b[:, 0]).max(initial=0.0)
    lo, hi = np.searchsorted(start, low_a[:, 0] - wide), np.searchsorted(start, high_a[:, 0], "right")
    at = 0
    while at < len(low_a):
        n = np.cumsum(hi[at:] - lo[at:])
        to = at + max(1, int(np.searchsorted(n, CHUNK, "right")))
        count = hi[at:to] - lo[at:to]
        i = np.repeat(np.arange(at, min(to, len(low_a))), count)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[at:to], count)]
        ok = ((low_a[i] <= high_b[j]) & (high_a[i] >= low_b[j])).all(axis=1)
        yield i[ok], j[ok]
        at = to


def _boxes(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(seg[:, :2], seg[:, 2:]), np.maximum(seg[:, :2], seg[:, 2:])


def _cut(seg: np.ndarray, digits: int) -> np.ndarray:
    """The segments cut wherever two of them meet, each piece once, ends rounded."""
    low, high = _boxes(seg)
    own, where = [np.arange(len(seg))] * 2, [np.zeros(len(seg)), np.ones(len(seg))]
    d = seg[:, 2:] - seg[:, :2]
    for i, j in _near(low, high, low, high):
        i, j = i[i != j], j[i != j]
        gap = seg[j, :2] - seg[i, :2]
        cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        flat = cross == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * d[j, 1] - gap[:, 1] * d[j, 0]) / cross
            u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / cross
        hit = ~flat & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
        own.append(i[hit])
        where.append(np.clip(t[hit], 0, 1))
        # On one line: the ends of the other within this one.
        i, j, gap = i[flat], j[flat], gap[flat]
        same = np.abs(gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) <= 1e-9 * np.maximum(1.0, (d[i] ** 2).sum(axis=1))
        i, j = i[same], j[same]
        for end in (seg[j, :2], seg[j, 2:]):
            t = ((end - seg[i, :2]) * d[i]).sum(axis=1) / (d[i] ** 2).sum(axis=1)
            inner = (t > 0) & (t < 1)
            own.append(i[inner])
            where.append(t[inner])
    k, t = np.concatenate(own), np.concatenate(where)
    order = np.lexsort((t, k))
    k, t = k[order], t[order]
    point = np.round(seg[k, :2] + t[:, None] * d[k], digits) + 0.0
    ends = np.where((t == 0)[:, None], seg[k, :2], np.where((t == 1)[:, None], seg[k, 2:], point))
    ends = np.round(ends, digits) + 0.0
    next_one = k[1:] == k[:-1]
    pieces = np.concatenate([ends[:-1], ends[1:]], axis=1)[next_one]
    pieces = pieces[(pieces[:, :2] != pieces[:, 2:]).any(axis=1)]
    turn = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    pieces[turn] = pieces[turn][:, [2, 3, 0, 1]]
    return np.unique(pieces, axis=0)


def _inside_any(points: np.ndarray, seg: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each point is in a shape: an odd number of the shape's edges is to its right."""
    low, high = _boxes(seg)
    keep = low[:, 1] != high[:, 1]
    seg, owner, low, high = seg[keep], owner[keep], low[keep], high[keep]
    inside = np.zeros(len(points), bool)
    # A ray to the right: sorted by y instead of x, so that points meet the edges at their height.
    flip = [1, 0]
    reach = np.column_stack([points[:, 1], points[:, 0]]), np.column_stack([points[:, 1], np.full(len(points), np.inf)])
    for i, j in _near(reach[0], reach[1], low[:, flip], high[:, flip]):
        s, y = seg[j], points[i, 1]
        hit = (s[:, 1] > y) != (s[:, 3] > y)
        i, j, s, y = i[hit], j[hit], s[hit], y[hit]
        right = points[i, 0] < (s[:, 2] - s[:, 0]) * (y - s[:, 1]) / (s[:, 3] - s[:, 1]) + s[:, 0]
        pairs, n = np.unique(np.stack([i[right], owner[j[right]]]), axis=1, return_counts=True)
        inside[pairs[0, n % 2 == 1]] = True
    return inside


def _chained(edges: np.ndarray) -> list[list[tuple[float, float]]]:
    """Rings of directed edges; where several leave a corner, the one that turns most to the left
    is taken, so that parts that touch in a corner stay apart."""
    leaving: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for ax, ay, bx, by in edges.tolist():
        leaving.setdefault((ax, ay), []).append((bx, by))
    rings = []
    while leaving:
        first = min(leaving)
        at, before, ring = first, None, []
        while True:
            ring.append(at)
            ways = leaving[at]
            if before is None or len(ways) == 1:
                k = 0
            else:
                came = np.arctan2(at[1] - before[1], at[0] - before[0])
                turn = [(np.arctan2(y - at[1], x - at[0]) - came + np.pi) % (2 * np.pi) for x, y in ways]
                k = int(np.argmax(turn))
            to = ways.pop(k)
            if not ways:
                del leaving[at]
            before, at = at, to
            if at == first or at not in leaving:
                break
        rings.append(ring)
    return rings


def _straightened(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Without the corners that lie on the line between their neighbours."""
    p = np.array(ring)
    a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    bend = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-9 * np.maximum(1.0, np.hypot(*a.T) * np.hypot(*b.T))
    return [tuple(x) for x in p[bend].tolist()]


def union_rings(shapes: list[list[np.ndarray]], digits: int = 6) -> list[list[tuple[float, float]]]:
    """The outline of the union of shapes, each a list of rings (holes and parts by even-odd): outer
    rings run counter-clockwise, holes clockwise.

    All edges are cut where they meet; a piece with the union on one side only is outline, and runs
    so that the union is on its left. Coordinates are rounded to ``digits`` decimals, so that corners
    that should be one are."""
    seg, owner = _segments([[np.asarray(r, float)[:, :2] for r in rings if len(r) >= 3] for rings in shapes])
    if not len(seg):
        return []
    pieces = _cut(seg, digits)
    if not len(pieces):
        return []
    mid, d = (pieces[:, :2] + pieces[:, 2:]) / 2, pieces[:, 2:] - pieces[:, :2]
    size = np.hypot(d[:, 0], d[:, 1])
    step = np.column_stack([-d[:, 1], d[:, 0]]) / size[:, None] * np.minimum(size * 1e-3, 10.0**-digits * 10)[:, None]
    left, right = _inside_any(mid + step, seg, owner), _inside_any(mid - step, seg, owner)
    edges = np.concatenate([pieces[left & ~right], pieces[right & ~left][:, [2, 3, 0, 1]]])
    return [r for r in map(_straightened, _chained(edges)) if len(r) >= 3]


def union_polygons(polygons: DataFrame, by: Sequence[str], ring: str = "ring", digits: int = 6) -> DataFrame:
    """A row for each group with ``rings``, the outline of its polygons' union (see ``union_rings``)
    and ``n_polygons``. A group's polygons are brought to one task: unions are of the parts of an
    area of interest, not of a whole layer; deal a layer into groups.

    Defined cases: a null or empty geometry adds nothing (a group of only such has no rings);
    repeated polygons change nothing; a null group is a group; an empty table gives an empty one.
    """
    kept = polygons.select(*by, F.coalesce(_as_rings(polygons, ring), F.array().cast(RINGS)).alias("_rings"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_rings") + f", rings {RINGS}, n_polygons long"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shapes = [[np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in rings if r is not None] for rings in group["_rings"]]
        outline = [[{"x": x, "y": y} for x, y in r] for r in union_rings(shapes, digits)]
        return group[list(by)].iloc[:1].assign(rings=[outline], n_polygons=len(group))

    return kept.groupBy(*by).applyInPandas(run, schema)
