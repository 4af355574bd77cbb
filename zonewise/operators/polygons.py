"""Joins against polygons: every polygon is cut into grid cells once, then the join is an equi-join on cells.

A point lies in exactly one cell and a polygon holds at most one row per cell, so one left outer equi-join with an exact
residual test already gives the left-join result: nothing is joined back and no pair is seen twice. Cells of many points and
polygons are not met pair by pair but by strips (``crowds``), with the same result.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from ..functions.crs import assert_wgs84, require_columns
from . import crowds
from .workset import BROADCAST_ROWS, Scratch, salted_join, settle

LONG = 500  # shapes of more vertices are compared with others edge by edge, never whole in a row
CELL_POLYGONS = 64  # cells crossed by the borders of more polygons than this are divided further
_SPLIT = 8  # a power of two, so that cell numbers of all levels nest exactly
_MAX_SPLITS = 3
# Tests of a point against a polygon that a task gets on average, and those of a cell beyond which it goes to several tasks.
TASK_TESTS, HOT_TESTS = 50_000_000, 20_000_000
# Cells of more tests than this are worked by strips (``crowds``), in groups that list the pairs of so many tests and polygons,
# or count those of so many points and polygons.
CROWDED_TESTS, LISTED_TESTS, LISTED_SHAPES, GROUP_POINTS, GROUP_SHAPES = 20_000, 4_000_000, 100_000, 50_000, 10_000
_TASK_ROWS = 1_000_000  # points and polygons that a task of such groups reads on average
_CELL = ["level", "cx", "cy"]
_SPREAD_ROWS = 10_000  # layers of more polygons are dealt over all tasks before they are cut
_WORTHWHILE = 8  # a division that multiplies a cell's rows by so much (stacked polygons) does not pay and is left out


def _extents(polygons: DataFrame) -> Row:
    b = G.bbox(F.col("geometry"))
    w, h = b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]
    return polygons.select(w.alias("w"), h.alias("h"), F.size(G.vertices(F.col("geometry"))).alias("v")).agg(
        F.percentile_approx(F.greatest("w", "h"), 0.5, 100).alias("mid"),
        F.sum(F.col("w") * F.col("h")).alias("area"),
        F.count("w").alias("n"),
        F.avg("v").alias("v"),
    ).first()


def cell_size(polygons: DataFrame, extents: Row | None = None) -> float:
    """The median extent, divided further the more edges polygons have, but so that they average 64 cells at most."""
    row = extents or _extents(polygons)
    if not row["n"]:
        return 1.0
    parts = min(max(row["v"] ** 0.5 / 2, 1.0), 8.0)
    return max(row["mid"] / parts, (row["area"] / (64 * row["n"])) ** 0.5) or 1.0


def _slot(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size))


def _cut(rows: DataFrame, carry: list[str], size: float, bounded: bool) -> DataFrame:
    """Rows (carry, _edges[, cx, cy of the coarser cell]) to one row per finer cell the polygon reaches."""
    e = F.transform(
        "_edges",
        lambda e: F.struct(
            *[e[c].alias(c) for c in ("x1", "y1", "x2", "y2")],
            _slot(F.least(e["x1"], e["x2"]), size).alias("cx0"),
            _slot(F.greatest(e["x1"], e["x2"]), size).alias("cx1"),
            _slot(F.least(e["y1"], e["y2"]), size).alias("cy0"),
            _slot(F.greatest(e["y1"], e["y2"]), size).alias("cy1"),
        ),
    )
    out = rows.withColumn("_e", e)
    if bounded:
        lo_y, hi_y = F.col("cy") * _SPLIT, F.col("cy") * _SPLIT + (_SPLIT - 1)
        lo_x, hi_x = F.col("cx") * _SPLIT, F.col("cx") * _SPLIT + (_SPLIT - 1)
    else:
        lo_y, hi_y = F.array_min(F.col("_e.cy0")), F.array_max(F.col("_e.cy1"))
        lo_x, hi_x = F.array_min(F.col("_e.cx0")), F.array_max(F.col("_e.cx1"))
    out = out.withColumns({"_lx": lo_x, "_hx": hi_x}).withColumn("_y", F.explode(F.sequence(lo_y, hi_y)))
    # edges of this row of cells only: enough for the parity of any point in it
    out = out.withColumn("_e", F.filter("_e", lambda v: (v["cy0"] <= F.col("_y")) & (v["cy1"] >= F.col("_y"))))
    if not bounded:
        # one polygon may be far larger than the others: its rows of cells go to several tasks before they are cut
        out = out.repartition("_y", "_lx", F.size("_e"))
    out = out.withColumn("_x", F.explode(F.sequence("_lx", "_hx")))
    border = F.exists("_e", lambda v: (v["cx0"] <= F.col("_x")) & (v["cx1"] >= F.col("_x")))
    half = F.lit(0.5)
    mx, my = (F.col("_x") + half) * F.lit(size), (F.col("_y") + half) * F.lit(size)
    out = out.withColumn("_border", border)
    within = F.col("_inside") if bounded else F.lit(False)
    out = out.withColumn(
        "_inside", within | (~F.col("_border") & (F.size(F.filter("_e", lambda v: G.crosses_ray(v, mx, my))) % 2 == 1))
    ).filter(F.col("_border") | F.col("_inside"))
    kept = F.transform(
        F.filter("_e", lambda v: F.col("_border") & (v["cx1"] >= F.col("_x"))),
        lambda v: F.struct(*[v[c].alias(c) for c in ("x1", "y1", "x2", "y2")]),
    )
    return out.select(*carry, F.col("_x").alias("cx"), F.col("_y").alias("cy"), "_inside", kept.alias("_edges"))


def _divided(size: float) -> Column:
    """How many cells of the finer size a row of a coarser one would become, judged by the box of its border."""

    def reach(edge, cell):
        first = F.greatest(_slot(F.array_min(F.transform("_edges", lambda e: F.least(*[e[c] for c in edge]))), size), F.col(cell) * _SPLIT)
        last = F.least(
            _slot(F.array_max(F.transform("_edges", lambda e: F.greatest(*[e[c] for c in edge]))), size),
            F.col(cell) * _SPLIT + (_SPLIT - 1),
        )
        return F.greatest(last - first + 1, F.lit(1))

    return F.when(F.col("_inside"), F.lit(_SPLIT * _SPLIT)).otherwise(reach(("x1", "x2"), "cx") * reach(("y1", "y2"), "cy"))


class PolygonCells:
    """Cell table of a polygon layer, with crowded cells divided until few polygons share one."""

    def __init__(self, polygons: DataFrame, carry: list[str], size: float | None = None):
        if not size:
            extents = _extents(polygons)
            size = cell_size(polygons, extents)
            if extents["n"] > _SPREAD_ROWS:
                # a short file of many polygons is read by one task, which would take all of them apart
                polygons = polygons.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.size = size
        self.crowded: list[tuple[DataFrame, int]] = []
        bounds = {f"_{n}": c for n, c in G.bbox(F.col("geometry")).items()}
        edge_list = G.edges(F.col("geometry")).alias("_edges")
        rows = polygons.select(*carry, edge_list, *[c.alias(n) for n, c in bounds.items()]).filter(F.size("_edges") > 0)
        carry = [*carry, *bounds]
        tables, current, bounded, step = [], rows, False, self.size
        for level in range(_MAX_SPLITS + 1):
            current = settle(_cut(current, carry, step, bounded))
            crowded, n_crowded = None, 0
            if level < _MAX_SPLITS:
                # every cell is judged for itself: a stack of equal polygons stays, its neighbours are divided
                per_cell = current.groupBy("cx", "cy").agg(
                    F.count_if(~F.col("_inside")).alias("n"), F.count(F.lit(1)).alias("now"), F.sum(_divided(step / _SPLIT)).alias("then")
                )
                pays = (F.col("n") > CELL_POLYGONS) & (F.col("then") < _WORTHWHILE * F.col("now"))
                crowded = settle(per_cell.filter(pays).select("cx", "cy"))
                n_crowded = crowded.count()
            if n_crowded == 0:
                tables.append(current.withColumn("level", F.lit(level)))
                break
            tables.append(current.join(crowded, ["cx", "cy"], "left_anti").withColumn("level", F.lit(level)))
            self.crowded.append((crowded, n_crowded))
            current, bounded, step = current.join(crowded, ["cx", "cy"], "left_semi"), True, step / _SPLIT
        cells = tables[0]
        for t in tables[1:]:
            cells = cells.unionByName(t)
        self.cells = cells
        counted = cells.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("_edges")), F.lit(0)).alias("e")).first()
        self.rows = counted["n"] + counted["e"] // 4  # an edge weighs about a quarter of a cell row

    def locate(self, points: DataFrame, x: str, y: str, spread: Column) -> DataFrame:
        """Give every point the number of the one cell it lies in."""
        out = points.withColumns(
            {"level": F.lit(0), "cx": _slot(F.col(x), self.size), "cy": _slot(F.col(y), self.size)}
        )
        step = self.size
        for level, (crowded, n) in enumerate(self.crowded, start=1):
            step = step / _SPLIT
            mark = crowded.withColumn("level", F.lit(level - 1)).withColumn("_deeper", F.lit(True))
            out = salted_join(out, mark, ["level", "cx", "cy"], "left", spread, right_rows=n)
            deeper = F.coalesce("_deeper", F.lit(False))
            out = out.withColumns(
                {
                    "level": F.when(deeper, F.lit(level)).otherwise(F.col("level")),
                    "cx": F.when(deeper, _slot(F.col(x), step)).otherwise(F.col("cx")),
                    "cy": F.when(deeper, _slot(F.col(y), step)).otherwise(F.col("cy")),
                }
            ).drop("_deeper")
        return out


def _spread(points: DataFrame, key: str | None) -> Column:
    return F.col(key) if key else F.struct(*points.columns)


class PointMatch:
    """Points and the polygons around them, met in the cells of a grid.

    A point meets only polygons whose columns ``same``, some of the carried ones, are equal to its own.
    """

    def __init__(
        self, points: DataFrame, polygons: DataFrame, carry: list[str], closed: bool, key: str | None, size: float | None, same: tuple[str, ...] = ()
    ):
        self.grid = PolygonCells(polygons, carry, size)
        lon, lat = F.col("lon"), F.col("lat")
        exact = G.point_in_edges(F.col("_edges"), lon, lat)
        if closed:
            exact = exact | G.point_on_edges(F.col("_edges"), lon, lat)
        # four plain comparisons spare most rows the walk over the edges
        self.hit = F.col("_inside") | (lon.between(F.col("_xmin"), F.col("_xmax")) & lat.between(F.col("_ymin"), F.col("_ymax")) & exact)
        self.spread = _spread(points, key)
        self.located = self.grid.locate(points, "lon", "lat", self.spread)
        self.carry, self.keys = carry, [*_CELL, *same]

    @cached_property
    def tests(self) -> DataFrame | None:
        """Points times polygons of every cell that has both; None where the polygons fit a broadcast."""
        if self.grid.rows <= BROADCAST_ROWS:
            return None
        per_cell = self.grid.cells.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_shapes"))
        met = self.located.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_points")).join(per_cell, self.keys)
        return settle(met.withColumn("n", F.col("_points") * F.col("_shapes")))

    def pairs(self, how: str, crowded: DataFrame | None = None) -> DataFrame:
        """The join of points with the cells, without those of crowded cells if they are named."""
        located, tests = self.located, self.tests
        if tests is None:
            joined = salted_join(located, self.grid.cells, self.keys, how, self.spread, condition=self.hit, right_rows=self.grid.rows)
        else:
            if crowded is not None:
                located, tests = (t.join(crowded.select(*self.keys), self.keys, "left_anti") for t in (located, tests))
            # where polygons lie in heaps the work of a cell is its points times its polygons: it is dealt out by that
            tasks = math.ceil((tests.agg(F.sum("n")).first()[0] or 0) / TASK_TESTS)
            joined = salted_join(
                located, self.grid.cells, self.keys, how, self.spread, condition=self.hit, hot_rows=HOT_TESTS, hot=tests, tasks=tasks if tasks > 1 else None
            )
        return joined.drop(*_CELL, "_inside", "_edges", "_xmin", "_ymin", "_xmax", "_ymax")

    def _crowded(self, wanted: Column, parts: Column, shares: Column) -> tuple[DataFrame | None, int]:
        """Cells to be worked by strips, with the parts and shares that their points and polygons are dealt into."""
        if self.tests is None:
            return None, 0
        cells = self.tests.filter((F.col("n") > CROWDED_TESTS) & wanted)
        cells = settle(cells.select(*_CELL, "_points", "_shapes", parts.cast("int").alias("_parts"), shares.cast("int").alias("_shares")))
        read = F.sum(F.col("_points") * F.col("_shares") + F.col("_shapes") * F.col("_parts"))
        row = cells.agg(F.count(F.lit(1)).alias("n"), read.alias("read")).first()
        return (cells if row["n"] else None), math.ceil((row["read"] or 0) / _TASK_ROWS)

    def _by_strips(self, crowded: DataFrame, tasks: int, columns: list[str], work, schema: T.StructType) -> DataFrame:
        """What a function of ``crowds`` makes of the crowded cells: every part of the points beside every share of the polygons."""
        plan = crowded.select(*_CELL, "_parts", "_shares")
        plan = F.broadcast(plan) if crowded.count() <= BROADCAST_ROWS else plan
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        by = [*_CELL, "_part", "_share"]
        points = self.located.join(plan, _CELL).withColumn("_part", F.pmod(F.xxhash64(self.spread, "lon", "lat"), F.col("_parts")).cast("int"))
        points = points.withColumn("_share", copies("_shares")).select(*by, "_shares", *columns)
        # the cells are a settled table, so the numbers of its rows stay the same
        shapes = self.grid.cells.withColumn("_row", F.monotonically_increasing_id()).join(plan, _CELL)
        shapes = shapes.withColumn("_share", F.pmod("_row", F.col("_shares")).cast("int")).withColumn("_part", copies("_parts"))
        shapes = shapes.select(*by, *self.carry, "_inside", "_xmin", "_ymin", "_xmax", "_ymax", "_edges")
        tasks = max(tasks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        points, shapes = (t.repartition(tasks, *by).groupBy(*by) for t in (points, shapes))
        return points.cogroup(shapes).applyInArrow(work, schema)

    def listed(self) -> DataFrame:
        """``pairs`` of a left join with a single carried column, crowded cells by strips."""
        result = self.carry[0]
        parts = F.greatest(F.ceil(F.col("n") / LISTED_TESTS), F.ceil(F.col("_points") / GROUP_POINTS))
        crowded, tasks = self._crowded(F.col("_shapes") <= LISTED_SHAPES, parts, F.lit(1))
        rows = self.pairs("left", crowded)
        if crowded is None:
            return rows
        columns = [c for c in rows.columns if c != result]
        schema = T.StructType([*[self.located.schema[c] for c in columns], T.StructField(result, T.ArrayType(rows.schema[result].dataType))])
        found = self._by_strips(crowded, tasks, columns, crowds.listing(result, columns, to_arrow_schema(schema)), schema)
        return rows.unionByName(found.select(*columns, F.explode_outer(result).alias(result)))

    def counted(self) -> DataFrame:
        """How many rows of ``listed`` have each carried value, as ``_n``, without listing them."""
        result = self.carry[0]
        crowded, tasks = self._crowded(F.lit(True), F.ceil(F.col("_points") / GROUP_POINTS), F.ceil(F.col("_shapes") / GROUP_SHAPES))
        rows = self.pairs("left", crowded)
        counts = rows.groupBy(result).agg(F.count(F.lit(1)).alias("_n"))
        if crowded is None:
            return counts
        own = [self.located.schema[c] for c in (*_CELL, "lon", "lat")]
        dealt = [T.StructField(c, T.IntegerType()) for c in ("_part", "_share", "_shares")]
        schema = T.StructType([rows.schema[result], T.StructField("_n", T.LongType()), *[T.StructField(f.name, f.dataType) for f in own], *dealt])
        found = settle(self._by_strips(crowded, tasks, ["lon", "lat"], crowds.tally(result, to_arrow_schema(schema)), schema))
        # where several shares hold the polygons of a cell, points at a place that none of them holds have no match
        place = [*_CELL, "_part", "_shares", "lon", "lat"]
        missed = found.filter("_shares is not null").groupBy(*place, "_share").agg(F.sum("_n").alias("_n"))
        missed = missed.groupBy(*place).agg(F.count(F.lit(1)).alias("_missed"), F.max("_n").alias("_n")).filter("_missed = _shares")
        missed = missed.select(F.lit(None).cast(rows.schema[result].dataType).alias(result), "_n")
        counts = counts.union(found.filter("_shares is null").select(result, "_n")).union(missed)
        return counts.groupBy(result).agg(F.sum("_n").alias("_n"))


def match_points(
    points: DataFrame, polygons: DataFrame, carry: list[str], how: str, closed: bool, key: str | None, size: float | None, same: tuple[str, ...] = ()
) -> DataFrame:
    """Points with the carried columns of every polygon around them."""
    return PointMatch(points, polygons, carry, closed, key, size, same).pairs(how)


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    name: str = "name",
    result: str = "neighborhood_polygon",
    key: str | None = None,
    size: float | None = None,
) -> DataFrame:
    """Left join: one row per point and polygon strictly around it, NULL where none is.

    ``key`` names a unique column of the points; rows of a crowded cell are spread over tasks by it.
    """
    assert_wgs84(points, "points")
    assert_wgs84(polygons, "polygons")
    require_columns(polygons, [name, "geometry"], "polygons")
    named = polygons.select(F.col(name).alias(result), "geometry")
    met = PointMatch(points, named, [result], False, key, size)
    joined = met.listed()
    joined._counted = {result: met.counted}
    return joined


# general join ---------------------------------------------------------------------------------------------------------


def _is_polygon_layer(df: DataFrame) -> bool:
    return "geometry" in df.columns


def _pieces_inside(edge_list: Column, area_edges: Column) -> Column:
    """Does any piece of the given edges run strictly inside the area? Edges are cut wherever they may meet it."""

    def cuts(b):
        dx, dy = b["x2"] - b["x1"], b["y2"] - b["y1"]

        def positions(a):
            ex, ey = a["x2"] - a["x1"], a["y2"] - a["y1"]
            den = dx * ey - dy * ex
            line = ((a["x1"] - b["x1"]) * ey - (a["y1"] - b["y1"]) * ex) / den
            norm = dx * dx + dy * dy
            ends = [((a[f"x{i}"] - b["x1"]) * dx + (a[f"y{i}"] - b["y1"]) * dy) / norm for i in (1, 2)]
            return F.when(den != 0, F.array(line, line)).otherwise(F.array(*ends))

        inner = F.filter(F.flatten(F.transform(area_edges, positions)), lambda t: (t > 0) & (t < 1))
        return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0)))))

    def close_to(e, x, y):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        return G.segment_distance2(x, y, e["x1"], e["y1"], e["x2"], e["y2"]) <= F.lit(1e-20) * (
            F.lit(1.0) + dx * dx + dy * dy + x * x + y * y
        )

    def enters(b):
        def piece(t, i, ts):
            m = (t + ts[i + 1]) / 2
            x, y = b["x1"] + m * (b["x2"] - b["x1"]), b["y1"] + m * (b["y2"] - b["y1"])
            odd = F.size(F.filter(area_edges, lambda e: G.crosses_ray(e, x, y))) % 2 == 1
            return odd & ~F.exists(area_edges, lambda e: close_to(e, x, y))

        return G.let(
            cuts(b),
            lambda ts: F.exists(
                F.transform(F.slice(ts, F.lit(1), F.size(ts) - 1), lambda t, i: piece(t, i, ts)), lambda q: q
            ),
        )

    return F.exists(edge_list, enters)


def interior_point(edge_list: Column) -> Column:
    """Some point strictly inside: midway between the first two crossings of a scan line off all vertices."""
    ys = F.array_sort(F.array_distinct(F.concat(edge_list["y1"], edge_list["y2"])))

    def on_line(y):
        xs = F.array_sort(
            F.transform(
                F.filter(edge_list, lambda e: (e["y1"] > y) != (e["y2"] > y)),
                lambda e: e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"]),
            )
        )
        return F.struct(((xs[0] + xs[1]) / 2).alias("x"), y.alias("y"))

    return G.let((ys[0] + ys[1]) / 2, on_line)


def _polygon_within(inner: Column, outer: Column) -> Column:
    """Every part of ``inner`` lies in ``outer``: its interior meets no boundary and one of its points is inside."""

    def part_within(part):
        return G.let(
            G.edges(F.struct(F.lit("Polygon").alias("type"), F.array(part).alias("parts"))),
            lambda mine: ~_pieces_inside(G.edges(outer), mine)
            & G.let(interior_point(mine), lambda p: G.point_in_edges(G.edges(outer), p["x"], p["y"])),
        )

    return F.forall(inner["parts"], part_within)


def _polygons_intersect(a: Column, b: Column) -> Column:
    ea, eb = G.edges(a), G.edges(b)
    return (
        G.edges_meet(ea, eb)
        | F.exists(ea, lambda e: G.point_in_edges(eb, e["x1"], e["y1"]))
        | F.exists(eb, lambda e: G.point_in_edges(ea, e["x1"], e["y1"]))
    )


def _box_cells(df: DataFrame, tag: str, size: float) -> DataFrame:
    """Key, box and length only, a row per cell of the box: shapes stay behind until the pairs are known."""
    b = G.bbox(F.col("geometry"))
    out = df.withColumns({f"{tag}_{n}": c for n, c in b.items()}).withColumn(f"{tag}_long", _is_long()).drop("geometry")
    for a, lo, hi in (("cx", "xmin", "xmax"), ("cy", "ymin", "ymax")):
        out = out.withColumn(a, F.explode(F.sequence(_slot(F.col(f"{tag}_{lo}"), size), _slot(F.col(f"{tag}_{hi}"), size))))
    return out


def _is_long() -> Column:
    return F.size(G.vertices(F.col("geometry"))) > LONG


def _polygon_pairs(left: DataFrame, right: DataFrame, predicate: str, left_key: str, right_key: str) -> DataFrame:
    """Key pairs of polygons that satisfy the predicate.

    Pairs of shapes of at most ``LONG`` vertices are compared in a row, all others by their edges (``overlay``).
    """
    size = max(cell_size(left), cell_size(right))
    left = left.select(F.col(left_key).alias("_lk"), "geometry")
    right = right.select(F.col(right_key).alias("_rk"), "geometry")
    a, b = _box_cells(left, "a", size), _box_cells(right, "b", size)
    touch = (
        (F.col("a_xmin") <= F.col("b_xmax"))
        & (F.col("b_xmin") <= F.col("a_xmax"))
        & (F.col("a_ymin") <= F.col("b_ymax"))
        & (F.col("b_ymin") <= F.col("a_ymax"))
    )
    # of all shared cells only the one with the lower left corner of the common box reports the pair
    owner = (_slot(F.greatest("a_xmin", "b_xmin"), size) == F.col("cx")) & (
        _slot(F.greatest("a_ymin", "b_ymin"), size) == F.col("cy")
    )
    pairs = salted_join(a, b, ["cx", "cy"], "inner", F.col("_lk"), condition=touch & owner)
    pairs = settle(pairs.select("_lk", "_rk", (F.col("a_long") | F.col("b_long")).alias("_long")))
    # a shape that many others touch is a hot key of the join with the shapes
    short = pairs.filter("not _long").select("_lk", "_rk")
    short = salted_join(short, left.filter(~_is_long()).withColumnRenamed("geometry", "a_g"), ["_lk"], "inner", F.col("_rk"))
    short = salted_join(short, right.filter(~_is_long()).withColumnRenamed("geometry", "b_g"), ["_rk"], "inner", F.col("_lk"))
    ga, gb = F.col("a_g"), F.col("b_g")
    exact = {
        "intersects": lambda: _polygons_intersect(ga, gb),
        "within": lambda: _polygon_within(ga, gb),
        "contains": lambda: _polygon_within(gb, ga),
    }[predicate]()
    found = short.filter(exact).select("_lk", "_rk")
    long = pairs.filter("_long").select("_lk", "_rk")
    return found if long.isEmpty() else found.unionByName(_long_pairs(left, right, long, predicate))


def _long_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, predicate: str) -> DataFrame:
    from . import overlay  # which builds on the join of points with polygons above

    with Scratch(left.sparkSession) as scratch:
        left = scratch.settle(left.join(pairs.select("_lk").distinct(), "_lk", "left_semi"))
        right = scratch.settle(right.join(pairs.select("_rk").distinct(), "_rk", "left_semi"))
        if predicate == "intersects":
            found = overlay.intersecting(left, right, scratch)
        elif predicate == "within":
            names = {"_ik": "_lk", "_ok": "_rk"}
            found = overlay.lying_within(left.withColumnRenamed("_lk", "_ik"), right.withColumnRenamed("_rk", "_ok"), scratch).withColumnsRenamed(names)
        else:
            names = {"_ik": "_rk", "_ok": "_lk"}
            found = overlay.lying_within(right.withColumnRenamed("_rk", "_ik"), left.withColumnRenamed("_lk", "_ok"), scratch).withColumnsRenamed(names)
        return scratch.keep(pairs.join(found, ["_lk", "_rk"], "left_semi"))


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    predicate: str = "intersects",
    left_key: str = "id",
    right_key: str = "id",
) -> DataFrame:
    """Join two layers on a spatial predicate; columns of the right side that clash get the suffix ``_right``.

    ``left_key`` and ``right_key`` name unique columns. Boundaries count for ``intersects`` but not for a point to be
    ``within`` a polygon.
    """
    if how not in ("left", "right", "inner"):
        raise ValueError(f"unknown join type {how}")
    if predicate not in ("intersects", "within", "contains"):
        raise ValueError(f"unknown predicate {predicate}")
    assert_wgs84(left, "left layer")
    assert_wgs84(right, "right layer")
    pl, pr = _is_polygon_layer(left), _is_polygon_layer(right)
    if pl and pr:
        pairs = _polygon_pairs(left, right, predicate, left_key, right_key)
    elif not pl and not pr:
        a = left.select(F.col(left_key).alias("_lk"), "lon", "lat")
        pairs = a.join(right.select(F.col(right_key).alias("_rk"), "lon", "lat"), ["lon", "lat"]).select("_lk", "_rk")
    else:
        points, polys = (right, left) if pl else (left, right)
        point_key, poly_key = (right_key, left_key) if pl else (left_key, right_key)
        names = ("_rk", "_lk") if pl else ("_lk", "_rk")
        possible = predicate == "intersects" or predicate == ("contains" if pl else "within")
        pts = points.select(F.col(point_key).alias(names[0]), "lon", "lat")
        shapes = polys.select(F.col(poly_key).alias(names[1]), "geometry")
        if not possible:
            shapes = shapes.limit(0)
        pairs = match_points(pts, shapes, [names[1]], "inner", predicate == "intersects", names[0], None)
        pairs = pairs.select("_lk", "_rk")
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns}
    other = right.withColumnsRenamed(clash)
    other_key = clash.get(right_key, right_key)
    # many rows of one side may share a partner, or have none: the join back to it is spread by the own key
    pairs = settle(pairs)
    if how == "right":
        out = other.join(pairs, F.col(other_key) == F.col("_rk"), "left").drop("_rk")
        out = salted_join(out, left.withColumn("_lk", F.col(left_key)), ["_lk"], "left", F.col(other_key)).drop("_lk")
    else:
        out = left.join(pairs, F.col(left_key) == F.col("_lk"), how).drop("_lk")
        out = salted_join(out, other.withColumn("_rk", F.col(other_key)), ["_rk"], "left", F.col(left_key)).drop("_rk")
    return out.select(*left.columns, *other.columns)
