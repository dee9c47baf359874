"""Lookups and scans over log DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators.resolve import visible
from sedimenta.plans.log import UNBOUNDED, Bound, in_range
from sedimenta.sources.hfs import stage_table


def scan(log: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, limit: int | None = None, reverse: bool = False, ordered: bool = True) -> DataFrame:
    """(key, value) of the visible keys in a range, by key. The range is applied below the resolution, at the scan."""
    test = in_range(F.col("key"), lower, upper)
    out = visible(log if test is None else log.where(test))
    if ordered:
        out = out.orderBy(F.col("key").desc() if reverse else F.col("key"))
    return out if limit is None else out.limit(limit)


def get(log: DataFrame, key) -> DataFrame:
    """(key, value) of one key, no row if it is absent or deleted. The newest version is picked before the tombstone test."""
    newest = log.where(F.col("key") == F.lit(key)).orderBy(F.desc("seq"), F.desc("ord")).limit(1)
    return newest.where(~F.col("is_tombstone")).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) for each row of ``keys`` (key); value is null where the key is absent or deleted.

    Only versions of wanted keys are resolved. How the keys are joined is left to the engine, which knows their size.
    """
    wanted = log.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.select("key").join(visible(wanted), "key", "left")


def seek(run: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, key): the smallest key at or after each probe, null beyond the last. Keys and probes are merged in one ordered pass.

    The pass is split by key range, and each range is told the first key beyond it, so no task sees all keys.
    """
    return _neighbour(run.select("key").distinct(), probes.select("probe").distinct(), forward=True)


def floor_index(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, key): the last index key at or before each probe, else the first index key: the block that may hold it."""
    found = _neighbour(index.select("key").distinct(), probes.select("probe").distinct(), forward=False)
    first = index.agg(F.min("key").alias("first_key"))
    return found.join(F.broadcast(first)).select("probe", F.coalesce("key", "first_key").alias("key"))


def _neighbour(keys: DataFrame, probes: DataFrame, forward: bool) -> DataFrame:
    # Equal keys must come before the probe in the order of the pass.
    both = keys.select(F.col("key").alias("at"), F.col("key"), F.lit(0).alias("side")).unionAll(probes.select(F.col("probe").alias("at"), F.lit(None).cast(keys.schema["key"].dataType).alias("key"), F.lit(1).alias("side")))
    # Ranges and their numbers are fixed once: all that follows must see the same ones.
    dealt, _ = stage_table(both.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "ranges")
    way = F.desc if forward else F.asc
    # The last key so far in a pass towards the probe: a frame that only grows.
    order = Window.partitionBy("part").orderBy(way("at"), "side").rowsBetween(Window.unboundedPreceding, 0)
    probed = dealt.withColumn("found", F.last("key", ignorenulls=True).over(order)).where("side = 1").select("part", F.col("at").alias("probe"), "found")
    # One row a range: the nearest key in the ranges beyond.
    edge = dealt.groupBy("part").agg((F.min if forward else F.max)("key").alias("edge"))
    beyond = Window.partitionBy().orderBy(way("part")).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select("part", F.last("edge", ignorenulls=True).over(beyond).alias("beyond"))
    return probed.join(edge, "part").select("probe", F.coalesce("found", "beyond").alias("key"))
