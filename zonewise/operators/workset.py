"""Cutting lineage between rounds, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its counted rows stay below this; callers hand in rows of at most a few hundred bytes.
BROADCAST_ROWS = 500_000
# A key is hot above this many rows; at most total / HOT_ROWS keys can be.
HOT_ROWS = 1_000_000
# Rows without a key are dealt over so many groups.
_KEYLESS = 1024

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}
_roots: dict[str, Scratch] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.TemporaryDirectory(prefix="zonewise-")
    return _local_folders[app].name


class Scratch:
    """The intermediate tables of one run, in one folder of the shared directory.

    As a context manager it deletes the folder at the end of the block, so a result that is still to be read must have
    been handed to ``keep``, which puts it under the application's own folder (see ``clear``).
    """

    def __init__(self, spark: SparkSession, name: str = ""):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name or f'run-{uuid.uuid4().hex}'}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.close()

    def folder(self, name: str = "") -> str:
        return f"{self.path}/{name or uuid.uuid4().hex}"

    def settle(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write a table and read it back: short lineage, real size statistics, safe against executor loss.

        ``by`` lays the table out in one folder per value of a column. The shuffle files of the write are removed at its
        end, since nothing will ask for them again.
        """
        path = self.folder()
        was = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, was)
        settled = self.spark.read.schema(df.schema).parquet(path)
        settled._scratch_path = path
        return settled

    def keep(self, df: DataFrame) -> DataFrame:
        return settle(df)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            self._delete(t._scratch_path)

    def drop_part(self, table: DataFrame, part: str) -> None:
        """Delete one value's folder of a table that was settled ``by`` a column."""
        self._delete(f"{table._scratch_path}/{part}")

    def close(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def application_scratch(spark: SparkSession) -> Scratch:
    """The application's own folder, which stays until ``clear`` or the end of the program."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = Scratch(spark, f"zonewise-{app}")
        atexit.register(_clear_quietly, spark)
    return _roots[app]


def settle(df: DataFrame) -> DataFrame:
    """``Scratch.settle`` into the application's folder."""
    return application_scratch(df.sparkSession).settle(df)


def clear(spark: SparkSession) -> None:
    """Delete every settled table of this application; results that still read one become unreadable."""
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root is not None:
        root.close()


def _clear_quietly(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # the session may have been stopped already
        pass


def hot_above(rows: int, least: int = 1_000) -> int:
    """Rows of a key from which it counts as hot in a table of so many rows: no more than 100,000 keys can, so they fit a broadcast."""
    return max(least, rows // 100_000)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    spread: Column,
    condition: Column | None = None,
    right_rows: int | None = None,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    *,
    tasks: int | None = None,
) -> DataFrame:
    """Equi-join of a large left side whose keys may be very uneven ("inner" or "left").

    A right side of at most ``BROADCAST_ROWS`` counted rows is broadcast, so the left side does not move. Otherwise the
    keys with more than ``hot_rows`` left rows are spread: their left rows over several salts taken from ``spread`` (the
    row key), their right rows copied once per salt. Left rows without a key match nothing and are spread as well. ``hot`` may hand in the key counts (keys + ``n``) if known already.
    ``tasks`` deals the join over so many tasks at least, where its work is far larger than what it reads.
    ``condition`` may refer to columns of both sides.
    """
    if right_rows is not None and right_rows <= BROADCAST_ROWS:
        on = _equal(keys)
        on = on if condition is None else on & condition
        renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        return left.join(F.broadcast(renamed), on, how).drop(*[f"_r_{k}" for k in keys])
    columns = [*left.columns, *[c for c in right.columns if c not in keys]]
    if hot is None:
        hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = hot.filter(F.col("n") > hot_rows).select(*keys, F.ceil(F.col("n") / hot_rows).cast("int").alias("_salts"))
    # counts above the threshold: at most rows / hot_rows keys, so their number is counted before it is broadcast
    hot = settle(hot)
    n_hot = hot.count()
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    scattered = F.when(keyless, F.pmod(F.xxhash64(spread), F.lit(_KEYLESS)).cast("int"))
    if n_hot == 0:
        left = left.withColumn("_salt", F.coalesce(scattered, F.lit(0)))
        right = right.withColumn("_salt", F.lit(0))
    else:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        left = left.join(hot, keys, "left").withColumn(
            "_salt", F.coalesce(scattered, F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0))
        ).drop("_salts")
        right = (
            right.join(hot, keys, "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
            .drop("_salts")
        )
    keys = [*keys, "_salt"]
    on = _equal(keys)
    on = on if condition is None else on & condition
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if tasks is not None:
        tasks = max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        left, renamed = left.repartition(tasks, *keys), renamed.repartition(tasks, *[f"_r_{k}" for k in keys])
    joined = left.join(renamed, on, how).drop("_salt", *[f"_r_{k}" for k in keys])
    return joined.select(*columns)


def _equal(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return on
