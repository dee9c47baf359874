"""Runs: immutable, key-sorted Parquet folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.entries import entry_bytes, log_checksum
from sedimenta.options import Options
from sedimenta.plans.log import LOG_SCHEMA
from sedimenta.sources.hfs import Hfs
from sedimenta.sources.manifest import RunEntry


def write_runs(rows: DataFrame, fs: Hfs, o: Options, level: int, files: int | None = None) -> list[RunEntry]:
    """Writes resolved rows as runs sorted by key; no rows write nothing.

    Rows are dealt by key range, so runs of one write don't overlap and each file is one sorted range.
    Parquet keeps min and max of each row group, and a Bloom filter of the keys for lookups.
    """
    run = uuid.uuid4().hex
    path = fs.join("runs", run)
    dealt = rows.repartitionByRange(files, "key") if files else rows.repartitionByRange("key")
    writer = dealt.sortWithinPartitions("key").write.option("compression", o.compression).option("parquet.block.size", o.row_group_bytes)
    if o.false_positive_rate is not None:
        # Sized by the keys that a file has, not by the most that it could have.
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number#key", "16").option("parquet.bloom.filter.max.bytes", str(8 << 20)).option("parquet.bloom.filter.fpp#key", str(o.false_positive_rate))
    writer.parquet(path)
    return describe_runs(rows.sparkSession, fs, path, level)


def describe_runs(spark: SparkSession, fs: Hfs, path: str, level: int) -> list[RunEntry]:
    """One entry a non-empty file: its key range, rows, bytes and sequence range, aggregated where the data lies."""
    sizes = {p.rsplit("/", 1)[1]: n for p, n in fs.files(path, ".parquet")}
    if not sizes:
        return []
    stats = read_runs(spark, [path]).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"), F.min("seq").alias("s0"), F.max("seq").alias("s1"), F.sum(log_checksum()).alias("crc"))
    # One row a file.
    return sorted((RunEntry(f"{path.rsplit('/', 1)[1][:12]}-{r['file'].split('-')[1]}", level, f"{path}/{r['file']}", bytes(r["low"]), bytes(r["high"]), r["n"], sizes[r["file"]], r["s0"], r["s1"], r["crc"]) for r in stats.collect()), key=lambda r: r.min_key)


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The log rows of runs, with the fixed schema; no paths give no rows."""
    return spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], LOG_SCHEMA)


def damaged_runs(spark: SparkSession, runs: Iterable[RunEntry]) -> list[str]:
    """Ids of the runs whose rows don't have the checksum and number that the manifest says; one row a run comes back."""
    known = {r.path.rsplit("/runs/", 1)[1]: r for r in runs if r.crc is not None}
    if not known:
        return []
    file = F.regexp_extract(F.col("_metadata.file_path"), "^.*/runs/(.*)$", 1)
    got = read_runs(spark, [r.path for r in known.values()]).groupBy(file.alias("file")).agg(F.sum(log_checksum()).alias("crc"), F.count("*").alias("n")).collect()
    found = {r["file"]: (r["crc"], r["n"]) for r in got}
    return sorted(r.id for f, r in known.items() if found.get(f) != (r.crc, r.rows))


def run_stats(log: DataFrame, by: str) -> DataFrame:
    """(run, min_key, max_key, entries, bytes) of a log with a run column; bytes as entries are encoded."""
    return log.groupBy(by).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"), F.sum(entry_bytes()).alias("bytes"))
