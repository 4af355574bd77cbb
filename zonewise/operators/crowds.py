"""Points of a crowded cell among its polygons, found by strips instead of pair by pair.

The points of a cell are dealt into strips by y and sorted by x in each. Within a strip an edge covers a short range of
the sorted points; between such ranges the polygon holds all points or none, so that one of them is tested for all.
Points in the ranges are tested one by one, with the arithmetic of ``functions.geometry``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 50_000  # edges that are looked at together, few enough to stay in the cache
_MAX_STRIPS = 256
_POINTS_TO_A_STRIP = 3  # strips hold about so many times their number of points: finer ones cost more than the tests they spare


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for every one of so many entries."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(first, counts) + _within(counts)


def _blocks(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring entries whose weights add up to about ``BLOCK``."""
    cuts = np.flatnonzero(np.diff(np.cumsum(weights) // BLOCK)) + 1
    yield from zip([0, *cuts], [*cuts, len(weights)])


def found(x: np.ndarray, y: np.ndarray, inside: np.ndarray, box: tuple, offsets: np.ndarray, edges: tuple):
    """The points strictly inside polygons, as an order of the points, runs (polygon, first, end) and singles (polygon, place).

    Runs and singles name places in that order; no pair of a polygon and a point comes twice. ``edges`` are the four
    columns of all edges, those of a polygon from its place in ``offsets`` on.
    """
    n = len(x)
    per = -(-n // min(max(int((n / _POINTS_TO_A_STRIP) ** 0.5), 1), _MAX_STRIPS))
    order = np.argsort(y, kind="stable")
    strip, starts = np.arange(n) // per, np.arange(0, n, per)
    low, high = y[order][starts], y[order][np.minimum(starts + per, n) - 1]
    order = order[np.lexsort((x[order], strip))]
    px, py = x[order], y[order]
    x0, slack = px.min(), 1e-11 * (1 + np.abs(px).max())  # far above what rounding moves a crossing
    pitch = 2 * (px.max() - x0) + 4 * slack
    places = strip * pitch + (px - x0)
    clipped = lambda v: np.clip(v - x0, -pitch / 4, 3 * pitch / 4)

    whole = np.flatnonzero(inside)
    runs = [(whole, np.zeros(len(whole), "int64"), np.full(len(whole), n, "int64"))]
    singles = [(np.zeros(0, "int64"), np.zeros(0, "int64"))]
    x1, y1, x2, y2 = edges
    bottom, top = np.minimum(y1, y2), np.maximum(y1, y2)
    owner = np.repeat(np.arange(len(inside)), np.diff(offsets))
    first = np.searchsorted(high, bottom, "left")
    spans = np.maximum(np.searchsorted(low, top, "right") - first, 0)

    def strictly(p, t, e, near, size):
        """Are these points in the polygons of entries t, whose edges in the strip are those from ``near`` on?"""
        k = size[t]
        at, which = e[ranges(near[t], k)], np.repeat(np.arange(len(p)), k)
        X, Y, a1, b1, a2, b2 = px[p][which], py[p][which], x1[at], y1[at], x2[at], y2[at]
        j = np.flatnonzero((b1 > Y) != (b2 > Y))
        j = j[X[j] < a1[j] + (Y[j] - b1[j]) / (b2[j] - b1[j]) * (a2[j] - a1[j])]
        ok = np.bincount(which[j], minlength=len(p)) % 2 == 1
        j = np.flatnonzero((Y >= bottom[at]) & (Y <= top[at]) & (X >= np.minimum(a1, a2)) & (X <= np.maximum(a1, a2)))
        j = j[(a2[j] - a1[j]) * (Y[j] - b1[j]) - (b2[j] - b1[j]) * (X[j] - a1[j]) == 0]
        ok[which[j]] = False
        o = owner[e[t]]
        return ok & (px[p] >= box[0][o]) & (py[p] >= box[1][o]) & (px[p] <= box[2][o]) & (py[p] <= box[3][o])

    for a, b in _blocks(np.bincount(owner, spans, minlength=len(inside)).astype("int64")):
        mine = slice(offsets[a], offsets[b])
        e = np.repeat(np.arange(offsets[a], offsets[b]), spans[mine])
        if not len(e):
            continue
        s = first[e] + _within(spans[mine])
        dy = y2[e] - y1[e]
        level = dy == 0
        dy[level] = 1.0
        xa, xb = (x1[e] + (v - y1[e]) / dy * (x2[e] - x1[e]) for v in (np.maximum(bottom[e], low[s]), np.minimum(top[e], high[s])))
        xa[level], xb[level] = x1[e][level], x2[e][level]
        lo = np.searchsorted(places, s * pitch + clipped(np.minimum(xa, xb) - slack), "left")
        hi = np.searchsorted(places, s * pitch + clipped(np.maximum(xa, xb) + slack), "right")
        # the edges of a polygon in a strip become neighbours, from left to right
        group = (owner[e] - a) * len(starts) + s
        by = np.argsort(group * (n + 1) + lo, kind="stable")
        e, s, lo, hi, group = e[by], s[by], lo[by], hi[by], group[by]
        new = np.append(True, group[1:] != group[:-1])
        near = np.flatnonzero(new)
        size = np.diff(np.append(near, len(e)))
        near, size = np.repeat(near, size), np.repeat(size, size)
        reach = np.maximum.accumulate(group * (n + 1) + hi) - group * (n + 1)
        before = np.where(new, starts[s], np.append(0, reach[:-1]))
        gap = np.flatnonzero(lo > before)
        for c, d in _blocks(size[gap]):
            t = gap[c:d]
            t = t[strictly(before[t], t, e, near, size)]
            runs.append((owner[e[t]], before[t], lo[t]))
        start = np.maximum(lo, before)
        count = np.maximum(hi - start, 0)
        for c, d in _blocks(count * size):
            t, p = np.repeat(np.arange(c, d), count[c:d]), ranges(start[c:d], count[c:d])
            ok = strictly(p, t, e, near, size)
            singles.append((owner[e[t[ok]]], p[ok]))
    return order, [np.concatenate(c) for c in zip(*runs)], [np.concatenate(c) for c in zip(*singles)]


def _found(points: pa.Table, shapes: pa.Table):
    """``found`` of two tables; places that are no numbers lie in no strip and are left out of the order."""
    x, y = (points.column(c).to_numpy() for c in ("lon", "lat"))
    numbers = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
    if not len(numbers) or not shapes.num_rows:
        none = np.zeros(0, "int64")
        return none, [none, none, none], [none, none]
    lists = shapes.column("_edges").combine_chunks()
    offsets = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    edges = lists.flatten()
    edges = [dict(zip((f.name for f in edges.type), edges.flatten()))[c].to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")]
    box = [shapes.column(c).to_numpy() for c in ("_xmin", "_ymin", "_xmax", "_ymax")]
    inside = shapes.column("_inside").to_numpy()
    order, runs, singles = found(x[numbers], y[numbers], inside, box, offsets, edges)
    return numbers[order], runs, singles


def listing(carry: str, columns: list[str], schema: pa.Schema):
    """A function of a group's points and polygons: the points with the carried values around them, as a list."""

    def listed(points: pa.Table, shapes: pa.Table) -> pa.Table:
        n = points.num_rows
        if not n:
            return schema.empty_table()
        order, (row, first, end), (alone, place) = _found(points, shapes)
        point = order[np.concatenate([ranges(first, end - first), place])]
        rows = np.concatenate([np.repeat(row.astype("int32"), end - first), alone.astype("int32")])
        by = np.argsort(point.astype("uint16") if n <= 1 << 16 else point, kind="stable")  # short keys are sorted in linear time
        offsets = np.append(0, np.cumsum(np.bincount(point, minlength=n))).astype("int32")
        values = shapes.column(carry).combine_chunks().take(pa.array(rows[by]))
        lists = pa.ListArray.from_arrays(pa.array(offsets), values, type=schema.field(carry).type)
        return pa.table([*[points.column(c) for c in columns], lists], schema=schema)

    return listed


def tally(carry: str, schema: pa.Schema):
    """A function of a group's points and polygons: the pairs of each carried value, and the points without any.

    Where the polygons of a cell are dealt into several shares, the points that one of them does not hold come by their places.
    """

    def rows_of(count: int, columns: dict) -> pa.Table:
        return pa.table([columns.get(f.name, pa.nulls(count, f.type)) for f in schema], schema=schema)

    def tallied(points: pa.Table, shapes: pa.Table) -> pa.Table:
        n = points.num_rows
        if not n:
            return schema.empty_table()
        order, (row, first, end), (alone, place) = _found(points, shapes)
        pairs = np.bincount(row, end - first, minlength=shapes.num_rows).astype("int64") + np.bincount(alone, minlength=shapes.num_rows)
        held = np.flatnonzero(pairs)
        values = shapes.column(carry).combine_chunks().take(pa.array(held))
        found = rows_of(len(held), {carry: values, "_n": pa.array(pairs[held])})
        steps = np.bincount(first, minlength=len(order) + 1) - np.bincount(end, minlength=len(order) + 1)
        met = np.zeros(n, bool)
        met[order] = np.cumsum(steps)[:-1] > 0
        met[order[place]] = True
        missed = n - int(met.sum())
        if not missed:
            return found
        if points.column("_shares")[0].as_py() == 1:
            return pa.concat_tables([found, rows_of(1, {"_n": pa.array([missed], pa.int64())})])
        places = points.filter(pa.array(~met))
        columns = {c: places.column(c) for c in schema.names if c in places.column_names}
        return pa.concat_tables([found, rows_of(missed, {**columns, "_n": pa.array(np.ones(missed, "int64"))})])

    return tallied
