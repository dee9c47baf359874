"""Bounded, repeatable samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """All rows if there are at most ``most``, else about that many different ones, chosen by a hash of ``key`` and the other columns.

    Equal rows count once, so repeated and null keys are bounded too. A sample comes in the order of the hash.
    """
    row = F.xxhash64(key, *[c for c in df.columns if c != key])
    n = df.agg(F.count("*").alias("rows"), F.approx_count_distinct(row, 0.01).alias("different")).first()
    if n["rows"] <= most:
        return df
    share = min(1.0, most / n["different"])
    return df.where(F.pmod(row, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).distinct().orderBy(row)


def crc_mod(key: str, n: int):
    """crc32 of the key written as text, modulo n; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", docs_id: str | None = None) -> DataFrame:
    """(id, label) joined to ``docs``' columns for about ``most`` labelled rows at most.

    The labels are sampled before the join: what is broadcast is bounded, and texts aren't shuffled. Null ids
    go, and a label given to an id again counts once, so that repeated ids don't multiply. ``docs_id`` is the id's
    name in ``docs`` where it isn't ``id_col``.
    """
    some = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    some = bounded_sample(some.where("id is not null").distinct(), "id", most)
    return docs.withColumnRenamed(docs_id or id_col, "doc_key").join(F.broadcast(some), F.col("doc_key") == F.col("id")).drop("doc_key")
