"""Per-zone statistics and descriptive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings
from ..functions.crs import require_columns
from ..functions.numeric import half_even
from .workset import settle

# Up to this many distinct values per group the built-in exact percentile (a hash map per group) is the cheaper way.
MAP_VALUES = 1_000_000


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated percentiles per group: one row per group with a column per entry of ``points``.

    Equal values are counted first. Groups with few distinct values are then finished by the built-in aggregate; if any
    group has more, the values are sorted over all tasks by range and only counts per task and group are added up, so
    no group has to fit into one task.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counted = settle(counted)
    largest = counted.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if largest is None or largest <= MAP_VALUES:
        return counted.groupBy(*keys).agg(
            *[F.percentile("_v", F.lit(p), F.col("_c")).alias(n) for n, p in points.items()]
        )
    ranged = counted.repartitionByRange(*keys, "_v").withColumn("_task", F.spark_partition_id())
    ranged = settle(ranged)
    slices = ranged.groupBy(*keys, "_task").agg(F.sum("_c").alias("_in_slice"))
    group = Window.partitionBy(*keys)
    slices = slices.withColumns(
        {
            "_before": F.sum("_in_slice").over(group.orderBy("_task")) - F.col("_in_slice"),
            "_total": F.sum("_in_slice").over(group),
        }
    )
    wanted = F.array(*[F.lit(float(p)) for p in points.values()])
    # slices and groups in which some wanted rank falls; the others are not looked at again
    ranks = F.flatten(
        F.transform(wanted, lambda p: F.array(F.floor((F.col("_total") - 1) * p), F.ceil((F.col("_total") - 1) * p)))
    )
    slices = slices.withColumn("_ranks", F.array_distinct(ranks)).filter(
        F.exists("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in_slice")))
    )
    same = F.lit(True)
    for k in [*keys, "_task"]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    hit = ranged.alias("a").join(slices.alias("b"), same).select("a.*", "b._before", "b._total", "b._ranks")
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_task").orderBy("_v"))
    hit = hit.withColumn("_upto", upto).withColumn(
        "_r", F.explode(F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c"))))
    )
    found = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("_r", "_v"))).alias("_at"), F.first("_total").alias("_total"))

    def at(p: float) -> Column:
        pos = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col("_at")[F.floor(pos)], F.col("_at")[F.ceil(pos)]
        # the built-in aggregate's own formula, so that both ways agree to the last bit
        between = (F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high
        return F.when(F.floor(pos) == F.ceil(pos), low.cast("double")).otherwise(between)

    return found.select(*keys, *[at(p).alias(n) for n, p in points.items()])


def by_zone(df: DataFrame, by: str = "neighborhood", min_count: int = settings.MIN_TRANSACTIONS) -> DataFrame:
    """Means, median and count per zone, all rounded to whole numbers; zones with too few prices are left out."""
    require_columns(df, [by], "transactions")
    mean = lambda c: half_even(F.avg(c))
    named = df.filter(F.col(by).isNotNull()).withColumn("name", F.col(by))
    means = (
        named.groupBy("name")
        .agg(
            mean("transaction_price").alias("avg_price"),
            mean("price_per_m2").alias("avg_price_per_m2"),
            F.count("transaction_price").alias("transaction_count"),
            mean("rooms").alias("avg_rooms"),
            mean("area_m2").alias("avg_area_m2"),
        )
        .filter(F.col("transaction_count") >= min_count)
    )
    middle = percentiles(named, ["name"], "transaction_price", {"median_price": 0.5})
    out = means.join(middle, "name", "left").withColumn("median_price", half_even(F.col("median_price")))
    return out.select(
        "name", "avg_price", "median_price", "avg_price_per_m2", "transaction_count", "avg_rooms", "avg_area_m2"
    )


def long_form(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.select(*keys, F.expr(f"stack({len(columns)}, {pairs}) as (column, value)"))


def describe(df: DataFrame, columns: list[str], by: str | None = None, digits: int = 0) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles: one row per column, or per column and group."""
    keys = ["column", by] if by else ["column"]
    long = long_form(df.filter(F.col(by).isNotNull()) if by else df, columns, keys[1:])
    plain = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = percentiles(long, keys, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    shown = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return plain.join(quartiles, keys, "left").select(
        *keys, "count", *[half_even(F.col(c), digits).alias(c) for c in shown]
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; NULL is not a value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column)


def join_report(joined: DataFrame, column: str = "neighborhood_polygon") -> DataFrame:
    """Rows, rows without a match and number of zones matched, as one row.

    A join that can count its rows by zone without listing them (``polygons.points_in_polygons``) is asked for that.
    """
    counted = getattr(joined, "_counted", {}).get(column)
    zones = counted() if counted else joined.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    none = F.lit(0).cast("long")
    return zones.agg(
        F.coalesce(F.sum("_n"), none).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col(column).isNull(), F.col("_n"))), none).alias("n_unmatched"),
        F.count(column).alias("n_zones"),
    )


def area_average(stats: DataFrame) -> DataFrame:
    """Mean of the zone averages."""
    return stats.agg(F.avg("avg_price").alias("area_average"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, minimum, mean and maximum per feature column, in one pass."""
    return (
        long_form(df, columns, [])
        .groupBy("column")
        .agg(
            F.count_if(F.col("value").isNull()).alias("n_null"),
            F.min("value").alias("min"),
            half_even(F.avg("value"), 1).alias("mean"),
            F.max("value").alias("max"),
        )
    )
