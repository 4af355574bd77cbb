"""GeoParquet as a sink of its own: files that any reader of the format can open, committed as a whole.

Every task writes one Parquet file whose footer holds the ``geo`` entry (system, geometry types, bounds of the file), under a
name of its own in a staging folder that readers do not list. Only when all tasks have succeeded are the files they
reported moved into the layer and the staging folder deleted; a killed or repeated attempt leaves nothing that is listed.

Rows carry their bounds in a ``bbox`` column (the format's covering), and rows that lie together are written together: they are
sorted by the place of their middle on a space-filling curve. A range filter on the bounds then skips row groups.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from ..settings import STORAGE_CRS
from . import wkb
from .stores import open_store

SHORT_NAME = "zonewise_geoparquet"
ROW_GROUP_ROWS = 20_000
# Moves of committed files that run at once.
_MOVES = 16
# Geometry type codes of well-known binary.
_TYPES = {1: "Point", 3: "Polygon", 6: "MultiPolygon"}


def geo_entry(crs: str, column: str = "geometry", types=(), bounds=None) -> dict:
    """The format's metadata for one geometry column with a covering."""
    told = {"encoding": "WKB", "geometry_types": sorted(types), "covering": {"bbox": {b: ["bbox", b] for b in G.BOUNDS}}}
    if crs != STORAGE_CRS:  # the format's default is longitude and latitude in degrees
        authority, code = crs.split(":")
        told["crs"] = {"id": {"authority": authority, "code": int(code)}}
    if bounds:
        told["bbox"] = bounds
    return {"version": "1.1.0", "primary_column": column, "columns": {column: told}}


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.crs, self.rows = options["path"], options["crs"], int(options.get("rowGroupRows", ROW_GROUP_ROWS))
        self.schema, self.overwrite = to_arrow_schema(schema), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _write(self, name: str, batches) -> None:
        system, at = open_store(self.path)
        system.create_dir(f"{at}/{self.staging}", recursive=True)
        low, high, types = np.full(2, np.inf), np.full(2, -np.inf), set()
        with system.open_output_stream(f"{at}/{self.staging}/{name}") as sink, pq.ParquetWriter(sink, self.schema) as out:
            held, n = [], 0
            for batch in batches:
                shapes, box = batch.column("geometry"), batch.column("bbox")
                codes = pc.unique(pc.binary_slice(shapes.drop_null(), 1, 5)).to_pylist()
                types |= {_TYPES.get(int.from_bytes(c, "little") % 1000, "Unknown") for c in codes}
                corners = {b: pc.min_max(box.field(b)) for b in G.BOUNDS}
                if corners["xmin"]["min"].is_valid:
                    low = np.minimum(low, [corners[b]["min"].as_py() for b in G.BOUNDS[:2]])
                    high = np.maximum(high, [corners[b]["max"].as_py() for b in G.BOUNDS[2:]])
                held.append(batch)
                n += len(batch)
                if n >= self.rows:
                    held, n = self._groups(out, held, self.rows), 0
                    n = sum(map(len, held))
            if n:
                self._groups(out, held, 1)
            bounds = [*map(float, low), *map(float, high)] if np.isfinite(low).all() else None
            out.add_key_value_metadata({"geo": json.dumps(geo_entry(self.crs, types=types, bounds=bounds))})

    def _groups(self, out: pq.ParquetWriter, held: list, least: int) -> list:
        """Write full row groups; what is left of fewer rows than ``least`` waits."""
        table = pa.Table.from_batches(held).cast(self.schema)
        whole = len(table) if least == 1 else len(table) // self.rows * self.rows
        out.write_table(table.slice(0, whole), row_group_size=self.rows)
        return table.slice(whole).to_batches()

    def write(self, iterator):
        batches = filter(len, iterator)
        first = next(batches, None)
        if first is None:
            return _Written(None)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.parquet"

        def every():
            yield first
            yield from batches

        self._write(name, every())
        return _Written(name)

    def commit(self, messages) -> None:
        system, at = open_store(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        if not names:  # an empty layer is one file without rows
            names = ["part-00000-empty.parquet"]
            self._write(names[0], [])
        if self.overwrite:
            old = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
            for info in old:
                if info.base_name != self.staging:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        with ThreadPoolExecutor(_MOVES) as pool:
            list(pool.map(lambda n: system.move(f"{at}/{self.staging}/{n}", f"{at}/{n}"), names))
        system.delete_dir(f"{at}/{self.staging}")

    def abort(self, messages) -> None:
        system, at = open_store(self.path)
        if system.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.staging}")


class GeoParquetSource(DataSource):
    """Writer only: reading is Spark's own Parquet reader, with its pruning (see ``layers.read_geoparquet``)."""

    @classmethod
    def name(cls) -> str:
        return SHORT_NAME

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def encoded(df: DataFrame) -> DataFrame:
    """The layer with well-known binary and bounds instead of its coordinate columns; ``bbox`` may hold nothing else."""
    if "bbox" in df.columns and not G.has_bounds(df):
        raise ValueError("a column named bbox is in the way of the layer's bounds")
    if "geometry" in df.columns:
        box = G.bbox(F.col("geometry"))
        shape = wkb.from_geometry(F.col("geometry"))
    else:
        there = F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")
        box = {b: F.when(there, F.col("lon" if b[0] == "x" else "lat")) for b in G.BOUNDS}
        shape = wkb.from_point(F.col("lon"), F.col("lat"))
    bounds = F.struct(*[box[b].cast("double").alias(b) for b in G.BOUNDS])
    others = [c for c in df.columns if c not in ("geometry", "lon", "lat", "bbox")]
    return df.select(*others, shape.alias("geometry"), F.when(box["xmin"].isNotNull(), bounds).alias("bbox"))


def curve_place(crs: str) -> Column:
    """Place of a row's middle on a Z-shaped curve: the bits of both coordinates in turn, 31 of each."""
    wide = {"x": 180.0, "y": 90.0} if crs == STORAGE_CRS else {"x": 2e7, "y": 2e7}

    def spread(axis: str) -> Column:
        middle = (F.col(f"bbox.{axis}min") + F.col(f"bbox.{axis}max")) / 2
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (middle + wide[axis]) / (2 * wide[axis])))
        v = F.floor(share * ((1 << 31) - 1)).cast("long")
        for by in (16, 8, 4, 2, 1):
            mask = sum(((1 << by) - 1) << at for at in range(0, 63, 2 * by)) & ((1 << 62) - 1)
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return spread("x").bitwiseOR(F.shiftleft(spread("y"), 1))


def in_curve_order(df: DataFrame, crs: str) -> DataFrame:
    """An ``encoded`` layer in ranges of its curve. The input is read twice, for the ranges and for the rows."""
    placed = df.withColumn("_place", curve_place(crs))
    return placed.repartitionByRange("_place").sortWithinPartitions("_place").drop("_place")


def write(df: DataFrame, path: str, crs: str, overwrite: bool, row_group_rows: int = ROW_GROUP_ROWS) -> None:
    """Write an ``encoded`` layer to a full path."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(GeoParquetSource)
    out = in_curve_order(df, crs).write.format(SHORT_NAME).mode("overwrite" if overwrite else "append")
    out.option("crs", crs).option("rowGroupRows", row_group_rows).save(path)
