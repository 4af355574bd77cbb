"""Nearest distance and counts within a radius, both by matching grid nodes before any row meets another row; counts of many
targets by tiles (``_tile_counts``).

Sources and targets are summed up per grid node (count and tight bounds), in one scan for all levels (``_Pyramid``). Node pairs that cannot matter are dropped,
pairs that count as a whole are added up, and only where many targets are left in a node is that neighbourhood divided
further. Rows meet at the end, inside small node neighbourhoods. Results are exact for any distribution of the points.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.crs import assert_wgs84
from ..functions.numeric import half_even
from ..functions.projection import project
from .polygons import match_points
from .workset import BROADCAST_ROWS, salted_join, settle

NODE_TARGETS = 48  # a source node is divided while any node it still has to meet holds more targets than this
_FAN = 4  # a power of two, so that node numbers of all levels nest exactly
_FIRST = 16  # nodes per side on the first level of a nearest search
_FINEST_M = 0.002
_POLYGON_ARCS = 64
# A target can count in so many tiles at most.
_TILES_REACHED = 9
# Sources per tile that are worth a group of their own, and rows of either side beyond which a tile is dealt over several groups.
TILE_ROWS, TILE_SOURCES, TILE_TARGETS = 4_000, 200_000, 1_000_000
# Strips hold about the square root of so many times the targets; distances are measured so many at a time.
_STRIP, _MEASURED = 5, 2_000_000


def _placed(layer: DataFrame) -> DataFrame:
    """Rows with a position. Tested on the raw columns: on the projected ones Spark would compute the series twice."""
    return layer.filter(~F.isnan("lon") & ~F.isnan("lat") & F.col("lon").isNotNull() & F.col("lat").isNotNull())


class Targets:
    """The target side, projected to metres, with exact copies merged; usable for several searches."""

    def __init__(self, layer: DataFrame):
        assert_wgs84(layer, "targets")
        self.shapes = "geometry" in layer.columns
        self.layer = layer
        if self.shapes:
            e = F.explode(G.edges(G.to_metric(F.col("geometry")))).alias("e")
            items = layer.select(e).select(*[F.col(f"e.{c}").alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
        else:
            x, y = project(F.col("lon"), F.col("lat"))
            items = _placed(layer).select(x.alias("tx1"), y.alias("ty1"))
        self.coords = items.columns
        self.items = settle(items.groupBy(*self.coords).agg(F.count(F.lit(1)).alias("weight")))
        xs = [c for c in self.coords if c.startswith("tx")]
        ys = [c for c in self.coords if c.startswith("ty")]
        row = self.items.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.min(c).alias(f"min_{c}") for c in self.coords],
            *[F.max(c).alias(f"max_{c}") for c in self.coords],
        ).first()
        self.n = row["n"]
        if self.n:
            self.bounds = (
                min(row[f"min_{c}"] for c in xs),
                min(row[f"min_{c}"] for c in ys),
                max(row[f"max_{c}"] for c in xs),
                max(row[f"max_{c}"] for c in ys),
            )
        self.x = [F.col(c) for c in xs]
        self.y = [F.col(c) for c in ys]

    @property
    def anchor(self) -> tuple[Column, Column]:
        if not self.shapes:
            return self.x[0], self.y[0]
        return (self.x[0] + self.x[1]) / 2, (self.y[0] + self.y[1]) / 2

    def distance2(self) -> Column:
        sx, sy = F.col("sx"), F.col("sy")
        if self.shapes:
            return G.segment_distance2(sx, sy, *[F.col(c) for c in ("tx1", "ty1", "tx2", "ty2")])
        dx, dy = sx - F.col("tx1"), sy - F.col("ty1")
        return dx * dx + dy * dy

    def pyramid(self, grid: "_Grid", base: int) -> "_Pyramid":
        least = lambda cols: cols[0] if len(cols) == 1 else F.least(*cols)
        most = lambda cols: cols[0] if len(cols) == 1 else F.greatest(*cols)
        held = {
            "tn": (F.sum, F.lit(1)), "tw": (F.sum, F.col("weight")),
            "tx0": (F.min, least(self.x)), "tx1": (F.max, most(self.x)), "ty0": (F.min, least(self.y)), "ty1": (F.max, most(self.y)),
        }
        return _Pyramid(self.items, self.anchor, grid, base, ("tx", "ty"), held, self.coords[0])


class _Grid:
    def __init__(self, x0: float, y0: float, size: float):
        self.x0, self.y0, self.size = x0, y0, size

    def slots(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (
            F.floor((x - F.lit(self.x0)) / F.lit(self.size)),
            F.floor((y - F.lit(self.y0)) / F.lit(self.size)),
        )

    def finer(self) -> "_Grid":
        return _Grid(self.x0, self.y0, self.size / _FAN)


class Sources:
    """The source side in metres; usable for several searches."""

    def __init__(self, layer: DataFrame, key: str, metric: DataFrame | None = None):
        """``metric`` hands in (skey, sx, sy) where the positions are known in metres already."""
        self.layer, self.key = layer, key
        if metric is None:
            assert_wgs84(layer, "sources")
            x, y = project(F.col("lon"), F.col("lat"))
            metric = _placed(layer).select(F.col(key).alias("skey"), x.alias("sx"), y.alias("sy"))
        self.rows = settle(metric)
        b = self.rows.agg(F.count(F.lit(1)), F.min("sx"), F.min("sy"), F.max("sx"), F.max("sy")).first()
        self.n, self.bounds = b[0], b[1:]


class _Pyramid:
    """What the nodes of one layer hold, on every level of a family of nested grids, from one scan of the rows.

    The scan sums up one level, ``base``; coarser levels are added up from its nodes, never from rows again. Finer ones are
    needed only where a search is still open beyond the base: those rows are set apart and every further level reads and
    thins out what the one before has left.
    """

    def __init__(self, rows: DataFrame, place: tuple[Column, Column], grid: _Grid, base: int, node: tuple[str, str], held: dict, spread: str):
        """``held`` maps a summary to its aggregate and the value it takes of a row; ``spread`` is a column that differs within a node."""
        self.rows, self.place, self.grid, self.base, self.node, self.held, self.spread = rows, place, grid, base, node, held, spread
        self.summary = settle(self._of_rows(base))

    def _at(self, level: int) -> _Grid:
        return _Grid(self.grid.x0, self.grid.y0, self.grid.size / _FAN**level)

    def _of_rows(self, level: int) -> DataFrame:
        keys = [c.alias(n) for c, n in zip(self._at(level).slots(*self.place), self.node, strict=True)]
        return self.rows.groupBy(*keys).agg(*[how(value).alias(c) for c, (how, value) in self.held.items()])

    def level(self, level: int, open_pairs: DataFrame | None) -> DataFrame:
        """Nodes of a level; beyond the base only children of nodes in ``open_pairs``, which are pairs of the level above."""
        if level == self.base:
            return self.summary
        if level < self.base:
            up = _FAN ** (self.base - level)
            keys = [F.floor(F.col(n) / up).alias(n) for n in self.node]
            return self.summary.groupBy(*keys).agg(*[how(c).alias(c) for c, (how, _) in self.held.items()])
        still = settle(open_pairs.select(*self.node).distinct())
        above = dict(zip(self.node, self._at(level - 1).slots(*self.place), strict=True))
        kept = self.rows.withColumns({f"_{n}": c for n, c in above.items()})
        still = still.withColumnsRenamed({n: f"_{n}" for n in self.node})
        keys = [f"_{n}" for n in self.node]
        self.rows = settle(salted_join(kept, still, keys, "inner", F.col(self.spread), right_rows=still.count()).drop(*keys))
        return self._of_rows(level)


def _source_pyramid(sources: DataFrame, grid: _Grid, base: int) -> _Pyramid:
    x, y = F.col("sx"), F.col("sy")
    held = {"qn": (F.sum, F.lit(1)), "qx0": (F.min, x), "qx1": (F.max, x), "qy0": (F.min, y), "qy1": (F.max, y)}
    return _Pyramid(sources, (x, y), grid, base, ("qx", "qy"), held, "skey")


def _base(grid: _Grid, targets: Targets) -> int:
    """The level on which evenly spread targets would be few enough per node for the search to end."""
    x0, y0, x1, y1 = targets.bounds
    level, size = 0, grid.size
    while ((x1 - x0) / size + 1) * ((y1 - y0) / size + 1) < 4 * targets.n / NODE_TARGETS and size / _FAN >= _FINEST_M:
        level, size = level + 1, size / _FAN
    return level


def _between(nodes: Column | str = "") -> tuple[Column, Column]:
    """Smallest and largest squared distance between the bounds of a source node and of a target node."""
    c = F.col
    gap = lambda a: F.greatest(F.lit(0.0), c(f"t{a}0") - c(f"q{a}1"), c(f"q{a}0") - c(f"t{a}1"))
    span = lambda a: F.greatest(c(f"t{a}1") - c(f"q{a}0"), c(f"q{a}1") - c(f"t{a}0"))
    near = gap("x") * gap("x") + gap("y") * gap("y")
    far = span("x") * span("x") + span("y") * span("y")
    return near, far


def _deeper(open_pairs: DataFrame, q: DataFrame, t: DataFrame, keep: list[str]) -> DataFrame:
    """Children of open node pairs."""
    parent = lambda c: F.floor(F.col(c) / _FAN)
    q = q.withColumns({"pqx": parent("qx"), "pqy": parent("qy")})
    t = t.withColumns({"ptx": parent("tx"), "pty": parent("ty")})
    up = open_pairs.select(
        *[F.col(c).alias(f"p{c}") for c in ("qx", "qy", "tx", "ty")], *[F.col(c) for c in keep]
    )
    return up.join(q, ["pqx", "pqy"]).join(t, ["ptx", "pty"]).drop("pqx", "pqy", "ptx", "pty")


class _Closed:
    """Finished node pairs of one level and the number of candidate rows they unfold to."""

    def __init__(self, pairs: DataFrame, grid: _Grid, rows: int):
        self.pairs, self.grid, self.rows = pairs, grid, rows


def _split_off(pairs: DataFrame, grid: _Grid, closed: list[_Closed]) -> DataFrame | None:
    """Move finished pairs to ``closed``; the others are to be divided further, None if there are none."""
    pairs = settle(pairs)
    last = grid.size / _FAN < _FINEST_M
    done = F.lit(True) if last else F.col("_most") <= NODE_TARGETS
    state = pairs.agg(
        F.count_if(done).alias("closed"),
        F.count_if(~done).alias("open"),
        F.sum(F.when(done, F.coalesce("tn", F.lit(1)))).alias("rows"),
    ).first()
    if state["closed"]:
        closed.append(_Closed(pairs.filter(done), grid, state["rows"]))
    return pairs.filter(~done) if state["open"] else None


def _meet_rows(sources: DataFrame, targets: Targets, closed: list[_Closed], extra: list[str]) -> DataFrame:
    """Rows of each closed source node against the targets of its remaining nodes; keeps ``extra`` pair columns."""
    parts = []
    for level, c in enumerate(closed):
        tx, ty = c.grid.slots(*targets.anchor)
        items = targets.items.withColumns({"tx": tx, "ty": ty})
        near = c.pairs.select("qx", "qy", "tx", "ty", "qn", *extra).join(items, ["tx", "ty"], "left")
        parts.append(near.drop("tx", "ty").withColumn("level", F.lit(level)))
    candidates = reduce(DataFrame.unionByName, parts)
    keyed = [
        F.struct(F.lit(level).alias("level"), *[s.alias(n) for s, n in zip(c.grid.slots(F.col("sx"), F.col("sy")), ("qx", "qy"))])
        for level, c in enumerate(closed)
    ]
    if len(keyed) == 1:
        located = sources.select("*", keyed[0].alias("_q"))
    else:  # a source sits in one closed node only, on one of the levels that have any
        located = sources.select("*", F.explode(F.array(*keyed)).alias("_q"))
    located = located.select("skey", "sx", "sy", "_q.level", "_q.qx", "_q.qy")
    # The results are grouped by source next. Moving the bare sources first costs the same shuffle, spreads the work of
    # the join evenly, and the grouping needs no further one.
    rows = sum(c.rows for c in closed)
    sized = [c.pairs.select(F.lit(i).alias("level"), "qx", "qy", F.col("qn").alias("n")) for i, c in enumerate(closed)]
    hot = reduce(DataFrame.unionByName, sized).distinct()
    if rows <= BROADCAST_ROWS:
        located = located.repartition("skey")
    return salted_join(
        located, candidates.drop("qn"), ["level", "qx", "qy"], "inner", F.col("skey"), right_rows=rows, hot=hot
    )


def _nearest_points(side: Sources, targets: Targets) -> DataFrame:
    """(skey, d2): squared distance to the closest target."""
    sources, b = side.rows, side.bounds
    if side.n == 0 or targets.n == 0:
        return sources.select("skey", F.lit(None).cast("double").alias("d2"))
    x0, y0 = min(b[0], targets.bounds[0]), min(b[1], targets.bounds[1])
    side = max(b[2] - x0, targets.bounds[2] - x0, b[3] - y0, targets.bounds[3] - y0, 1.0)
    size = 2.0 ** math.ceil(math.log2(side / _FIRST))
    grid, open_pairs, closed, level = _Grid(x0, y0, size), None, [], 0
    base = _base(grid, targets)
    source_nodes, target_nodes = _source_pyramid(sources, grid, base), targets.pyramid(grid, base)
    while True:
        q, t = source_nodes.level(level, open_pairs), target_nodes.level(level, open_pairs)
        if open_pairs is None:
            # at most 17 x 17 nodes a side on the first level, whatever the data
            pairs = q.withColumn("_all", F.lit(0)).join(t.withColumn("_all", F.lit(0)), "_all").drop("_all")
        else:
            pairs = _deeper(open_pairs, q, t, [])
        near, far = _between()
        per_node = Window.partitionBy("qx", "qy")
        pairs = (
            pairs.withColumns({"_near": near, "_far": far})
            .withColumn("_reach", F.min("_far").over(per_node))
            # a hair of slack against rounding of the two bounds
            .filter(F.col("_near") <= F.col("_reach") * F.lit(1 + 1e-12))
            .withColumn("_most", F.max("tn").over(per_node))
            .select("qx", "qy", "tx", "ty", "qn", "tn", "_most")
        )
        open_pairs = _split_off(pairs, grid, closed)
        if open_pairs is None:
            break
        grid, level = grid.finer(), level + 1
    met = _meet_rows(sources, targets, closed, [])
    return met.groupBy("skey").agg(F.min(targets.distance2()).alias("d2"))


def as_targets(layer: DataFrame | Targets) -> Targets:
    return layer if isinstance(layer, Targets) else Targets(layer)


def as_sources(layer: DataFrame | Sources, key: str) -> Sources:
    return layer if isinstance(layer, Sources) else Sources(layer, key)


def nearest_table(sources: Sources, targets: Targets, result: str) -> DataFrame:
    """(key, result) of ``nearest_distance`` without the other columns of the sources."""
    found = _nearest_points(sources, targets)
    distance = F.sqrt("d2")
    if targets.shapes and targets.n:
        inside = match_points(
            sources.layer.select(F.col(sources.key).alias("skey"), "lon", "lat"),
            targets.layer.select(F.lit(True).alias("_in"), "geometry"),
            ["_in"], "inner", True, "skey", None,
        ).select("skey", "_in").distinct()
        found = found.join(inside, "skey", "left")
        distance = F.when(F.col("_in"), F.lit(0.0)).otherwise(distance)
    return found.select(F.col("skey").alias(sources.key), half_even(distance, 1).alias(result))


def nearest_distance(sources: DataFrame, targets: DataFrame | Targets, result: str, key: str) -> DataFrame:
    """Add the metres to the closest target, to a tenth; NULL when there is no target.

    ``sources`` are points with a unique ``key``; targets are points or polygons (0 from inside a polygon).
    """
    found = nearest_table(as_sources(sources, key), as_targets(targets), result)
    return sources.join(found, key, "left")


def count_within(
    sources: DataFrame,
    targets: DataFrame | Targets,
    radii: dict[str, float],
    key: str,
    circle: str = "exact",
    empty_as_one: bool = False,
) -> DataFrame:
    """Add one count per entry of ``radii`` (result column to metres): targets closer than the radius.

    All radii share one search. ``circle="polygon64"`` counts inside the inscribed 64-gon instead of the circle, and
    ``empty_as_one`` reports 1 where nothing is in reach, for results equal to a left join that counts unmatched rows.
    """
    found = count_table(as_sources(sources, key), as_targets(targets), radii, circle, empty_as_one)
    out = sources.join(found, key, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in radii})


def count_table(
    sources: Sources, targets: Targets, radii: dict[str, float], circle: str = "exact", empty_as_one: bool = False
) -> DataFrame:
    """(key, one count per radius) of ``count_within`` without the other columns of the sources.

    Few targets are matched by nodes; node pairs, and the targets they unfold to, grow faster than dense layers do, so many
    targets are matched by tiles.
    """
    if circle not in ("exact", "polygon64"):
        raise ValueError(f"unknown circle {circle}")
    if targets.shapes:
        raise ValueError("count_within takes point targets")
    names, pts = list(radii), sources.rows
    floor = F.lit(1 if empty_as_one and targets.n else 0)
    many = targets.n * _TILES_REACHED > BROADCAST_ROWS
    closed = _reachable(pts, targets, radii, circle) if targets.n and not many else []
    if many and sources.n:
        counts = pts.select("skey").join(_tile_counts(pts, targets.items, radii, circle), "skey", "left")
    elif closed:
        met = _meet_rows(pts, targets, closed, [f"add_{i}" for i in range(len(names))])
        counts = met.groupBy("skey").agg(
            *[
                (
                    F.max(f"add_{i}")
                    + F.coalesce(F.sum(F.when(_hit(targets.distance2(), radii[n], circle), F.col("weight"))), F.lit(0))
                ).alias(n)
                for i, n in enumerate(names)
            ]
        )
        counts = pts.select("skey").join(counts, "skey", "left")
    else:
        counts = pts.select("skey", *[F.lit(None).cast("bigint").alias(n) for n in names])
    return counts.select(
        F.col("skey").alias(sources.key),
        *[F.greatest(F.coalesce(n, F.lit(0)), floor).cast("bigint").alias(n) for n in names],
    )


def _hit(d2: Column, radius: float, circle: str) -> Column:
    if circle == "exact":
        return d2 < F.lit(radius * radius)
    half = math.pi / _POLYGON_ARCS
    angle = F.pmod(F.atan2(F.col("ty1") - F.col("sy"), F.col("tx1") - F.col("sx")), F.lit(2 * half)) - F.lit(half)
    return F.sqrt(d2) * F.cos(angle) < F.lit(radius * math.cos(half))


def _reachable(sources: DataFrame, targets: Targets, radii: dict[str, float], circle: str) -> list[_Closed]:
    """Closed source nodes per level: nodes still to be met, and ``add_i`` targets already known to be in reach."""
    values = list(radii.values())
    reach = max(values)
    sure = math.cos(math.pi / _POLYGON_ARCS) if circle == "polygon64" else 1.0
    grid, open_pairs, closed, level = _Grid(targets.bounds[0], targets.bounds[1], reach), None, [], 0
    base = _base(grid, targets)
    source_nodes, target_nodes = _source_pyramid(sources, grid, base), targets.pyramid(grid, base)
    adds = [f"add_{i}" for i in range(len(values))]
    while True:
        q, t = source_nodes.level(level, open_pairs), target_nodes.level(level, open_pairs)
        if open_pairs is None:
            step = F.sequence(F.lit(-1), F.lit(1))
            around = t.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
            around = around.withColumns({"qx": F.col("tx") + F.col("_dx"), "qy": F.col("ty") + F.col("_dy")})
            pairs = q.join(around.drop("_dx", "_dy"), ["qx", "qy"])
            pairs = pairs.withColumns({a: F.lit(0).cast("bigint") for a in adds})
        else:
            pairs = _deeper(open_pairs, q, t, adds)
        near, far = _between()
        # wholly in or wholly out for every radius: no row has to be looked at
        full = [F.col("_far") < F.lit((r * sure) ** 2 * (1 - 1e-12)) for r in values]
        out = [F.col("_near") > F.lit(r * r * (1 + 1e-12)) for r in values]
        settled = reduce(lambda a, b: a & b, [f | o for f, o in zip(full, out)])
        per_node = Window.partitionBy("qx", "qy")
        pairs = pairs.withColumns({"_near": near, "_far": far}).withColumn("_settled", settled)
        pairs = pairs.withColumns(
            {
                **{
                    a: F.col(a) + F.coalesce(F.sum(F.when(F.col("_settled") & f, F.col("tw"))).over(per_node), F.lit(0))
                    for a, f in zip(adds, full)
                },
                "_most": F.max(F.when(~F.col("_settled"), F.col("tn"))).over(per_node),
                "_row": F.row_number().over(per_node.orderBy("_settled", "tx", "ty")),
            }
        )
        # one row of a source node stays even if all its pairs are settled: it carries the sums
        pairs = pairs.filter(~F.col("_settled") | (F.col("_row") == 1))
        drop = F.col("_settled")
        pairs = pairs.select(
            "qx", "qy", "qn",
            *[F.when(~drop, F.col(c)).alias(c) for c in ("tx", "ty", "tn")],
            *adds, F.coalesce("_most", F.lit(0)).alias("_most"),
        )
        open_pairs = _split_off(pairs, grid, closed)
        if open_pairs is None:
            return closed
        grid, level = grid.finer(), level + 1


def _tile_counts(sources: DataFrame, items: DataFrame, radii: dict[str, float], circle: str) -> DataFrame:
    """(skey, one count per radius), a row per key that has any target in a tile around it.

    Sources are dealt to square tiles at least as wide as the largest radius, and every target goes to the at most nine tiles
    it can count in: what is moved grows with the rows, however dense they lie. Crowded tiles are dealt over several groups.
    """
    reach = max(radii.values())
    slot = lambda v, size: F.floor(v / F.lit(size))
    node = ["cx", "cy"]
    held = settle(sources.groupBy(slot(F.col("sx"), reach).alias("cx"), slot(F.col("sy"), reach).alias("cy")).agg(F.count(F.lit(1)).alias("n")))
    size, up = reach, 1
    while True:
        tiles = held.groupBy(*[F.floor(F.col(c) / up).alias(c) for c in node]).agg(F.sum("n").alias("n"))
        state = tiles.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tiles")).first()
        if state["tiles"] == 1 or state["n"] >= state["tiles"] * TILE_ROWS or up > 1 << 40:
            break
        up *= _FAN
        size = reach * up
    # a hair of slack against rounding
    edge = reach * (1 + 1e-9) + 1e-6
    spans = {c: F.sequence(slot(F.col(v) - F.lit(edge), size), slot(F.col(v) + F.lit(edge), size)) for c, v in (("cx", "tx1"), ("cy", "ty1"))}
    near = items.withColumn("cx", F.explode(spans["cx"])).withColumn("cy", F.explode(spans["cy"]))
    around = near.groupBy(*node).agg(F.count(F.lit(1)).alias("m"))
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    tiles = settle(tiles.join(around, node).select(*node, parts("n", TILE_SOURCES).alias("_ns"), parts("m", TILE_TARGETS).alias("_nt")))
    state = tiles.agg(F.count(F.lit(1)).alias("n"), F.max("_nt").alias("nt")).first()
    dealt = lambda c, *by: F.pmod(F.xxhash64(*by), F.col(c)).cast("int")
    copies = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    placed = sources.withColumns({"cx": slot(F.col("sx"), size), "cy": slot(F.col("sy"), size), "_row": F.monotonically_increasing_id()})
    placed = salted_join(placed, tiles, node, "inner", F.col("_row"), right_rows=state["n"])
    near = salted_join(near, tiles, node, "inner", F.xxhash64("tx1", "ty1"), right_rows=state["n"])
    placed = placed.withColumn("_s", dealt("_ns", "_row")).withColumn("_t", copies("_nt")).drop("_ns", "_nt")
    near = near.withColumn("_t", dealt("_nt", "tx1", "ty1")).withColumn("_s", copies("_ns")).drop("_ns", "_nt")
    group, names, values = [*node, "_s", "_t"], list(radii), list(radii.values())

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        sx, sy, tx, ty, w = (t.column(c).to_numpy() for t, cs in ((left, ("sx", "sy")), (right, ("tx1", "ty1", "weight"))) for c in cs)
        found = [_weight_within(sx, sy, tx, ty, w, r, circle) for r in values]
        return pa.table([left.column("skey"), left.column("_row"), *[pa.array(f) for f in found]], names=["skey", "_row", *names])

    schema = T.StructType([sources.schema["skey"], T.StructField("_row", T.LongType()), *[T.StructField(n, T.LongType()) for n in names]])
    counts = placed.groupBy(*group).cogroup(near.groupBy(*group)).applyInArrow(tell, schema)
    if state["nt"] and state["nt"] > 1:
        counts = counts.groupBy("skey", "_row").agg(*[F.sum(n).alias(n) for n in names])
    return counts.groupBy("skey").agg(*[F.max(n).alias(n) for n in names])


def _weight_within(sx, sy, tx, ty, w, radius: float, circle: str) -> np.ndarray:
    """Summed weight of the targets within the radius of every source.

    Targets lie in strips of equal numbers, ordered by x: per strip two stretches hold the targets that may be in reach or not,
    and only those are measured.
    """
    out = np.zeros(len(sx), np.int64)
    if not len(sx) or not len(tx):
        return out
    sure = radius * math.cos(math.pi / _POLYGON_ARCS) if circle == "polygon64" else radius
    by_y = np.argsort(sy, kind="stable")
    sx, sy, found = sx[by_y], sy[by_y], np.zeros(len(sx), np.int64)
    order = np.argsort(ty, kind="stable")
    step = math.ceil(math.sqrt(_STRIP * len(tx)))
    slack = 1e-9 * (radius + max(np.abs(tx).max(), np.abs(ty).max()))
    for k in range(0, len(tx), step):
        strip = order[k : k + step]
        y0, y1 = ty[strip[0]], ty[strip[-1]]
        first, last = np.searchsorted(sy, y0 - radius - slack, "left"), np.searchsorted(sy, y1 + radius + slack, "right")
        if first == last:
            continue
        strip = strip[np.argsort(tx[strip], kind="stable")]
        xs, ys, ws = tx[strip], ty[strip], w[strip]
        upto = np.r_[0, np.cumsum(ws)]
        x, y = sx[first:last], sy[first:last]
        near, far = np.maximum(np.maximum(y0 - y, y - y1), 0.0), np.maximum(np.abs(y - y0), np.abs(y - y1))
        wide = np.sqrt(np.maximum(radius * radius * (1 + 1e-12) - near * near, 0.0)) + slack
        safe = np.sqrt(np.maximum(sure * sure * (1 - 1e-12) - far * far, 0.0)) - slack
        a, d = np.searchsorted(xs, x - wide, "left"), np.searchsorted(xs, x + wide, "right")
        b, c = np.searchsorted(xs, x - safe, "left"), np.searchsorted(xs, x + safe, "right")
        none = safe <= 0
        b[none] = c[none] = d[none]
        found[first:last] += upto[c] - upto[b]
        for start, end in ((a, b), (c, d)):
            _measure(found[first:last], x, y, start, end, xs, ys, ws, radius, circle)
    out[by_y] = found
    return out


def _measure(found, x, y, start, end, xs, ys, ws, radius: float, circle: str) -> None:
    """Add the weight of the targets start..end of every source that are in reach; so many at a time as fit the memory."""
    total = np.r_[0, np.cumsum(end - start)]
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(total, total[at] + _MEASURED, "right")) - 1)
        n = end[at:to] - start[at:to]
        own = np.repeat(np.arange(at, to), n)
        begin = total[at:to] - total[at]
        target = np.arange(len(own)) + np.repeat(start[at:to] - begin, n)
        dx, dy = x[own] - xs[target], y[own] - ys[target]
        hits = np.r_[0, np.cumsum(np.where(_in_circle(dx, dy, radius, circle), ws[target], 0))]
        found[at:to] += hits[begin + n] - hits[begin]
        at = to


def _in_circle(dx, dy, radius: float, circle: str):
    d2 = dx * dx + dy * dy
    if circle == "exact":
        return d2 < radius * radius
    half = math.pi / _POLYGON_ARCS
    angle = np.mod(np.arctan2(-dy, -dx), 2 * half) - half
    return np.sqrt(d2) * np.cos(angle) < radius * math.cos(half)
