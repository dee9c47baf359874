"""Which of a key's versions counts: resolution and merges over log DataFrames.

All functions are pure and work for any orderable key type. Aggregates are combined before the
shuffle, so a key with very many versions is a row a task by the time it is exchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """Each key's newest version by (seq, ord), tombstones too."""
    newest = F.max_by(F.struct("value", "is_tombstone", "seq", "ord"), F.struct("seq", "ord"))
    return log.groupBy("key").agg(newest.alias("v")).select("key", "v.*")


def visible(log: DataFrame) -> DataFrame:
    """(key, value) of every key whose newest version isn't a tombstone; the filter must come after the resolution."""
    return latest(log).where(~F.col("is_tombstone")).select("key", "value")


def deleted(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a tombstone."""
    return latest(log).where("is_tombstone").select("key")


def merge_by_priority(sources: list[DataFrame]) -> DataFrame:
    """k-way merge by key: of equal keys the one in the earliest source stays, whatever it is. Each source has a key once."""
    if not sources:
        raise ValueError("a merge needs a source")
    columns = [c for c in sources[0].columns if c != "key"]
    tagged = [s.select("key", F.struct(*columns).alias("row"), F.lit(i).alias("priority")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionAll, tagged).groupBy("key").agg(F.min_by("row", "priority").alias("row")).select("key", "row.*")


def merge_prefer_left(a: DataFrame, b: DataFrame) -> DataFrame:
    """All of ``a``, and of ``b`` the keys that ``a`` doesn't have."""
    return a.unionByName(b.join(a.select("key"), "key", "left_anti"))
