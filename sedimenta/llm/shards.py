"""Sharding by size-tiered compaction: small immutable shards, merged into target-sized files.

Arrivals are appended as runs of small Parquet shards. Runs of similar size are merged, several
at a time, into files of a target size. A version of the store is a manifest that lists its shards;
it is published by one atomic rename, so a reader sees a whole version, and a merge that fails or
loses a race leaves nothing but files that no manifest names. Merged files stay, so that a reader of an
older version isn't disturbed, until :meth:`ShardStore.vacuum` drops what no kept version names. All data
moves by DataFrame reads and writes; the driver handles names and sizes only.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimenta.sources.hfs import Hfs


@dataclass(frozen=True)
class Shard:
    run: int
    tier: int
    file: str
    rows: int
    bytes: int


class ConcurrentCommit(RuntimeError):
    """Another writer has published the next version first."""


class ShardStore:
    """A versioned set of Parquet shards below ``root`` with one fixed schema."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = 128 << 20, fan_in: int = 4):
        self.spark, self.schema, self.target_bytes, self.fan_in = spark, schema, target_bytes, fan_in
        self.fs = Hfs(spark, root)
        self.fs.mkdirs(self.fs.join("manifest"))

    # Manifests

    def version(self) -> int:
        """The latest version; 0 is the empty store."""
        names = [n for n in self.fs.names(self.fs.join("manifest")) if n.startswith("v")]
        return int(names[-1][1:-5]) if names else 0

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        lines = self.fs.read(self.fs.join("manifest", f"v{version:012d}.json")).decode().splitlines()
        return [Shard(**json.loads(x)) for x in lines]

    def _commit(self, base: int, shards: list[Shard]) -> int:
        data = "".join(json.dumps(asdict(s)) + "\n" for s in shards).encode()
        if not self.fs.create_exclusive(self.fs.join("manifest", f"v{base + 1:012d}.json"), data):
            raise ConcurrentCommit(f"version {base + 1} exists")
        return base + 1

    # Data

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files)

    def _listed(self, folder: str, run: int, tier: int) -> list[Shard]:
        """The shards that a job has written, with their rows by Parquet's own counts."""
        files = [f for f in self.fs.files(folder, ".parquet")]
        if not files:
            return []
        counts = {r["p"].rsplit("/", 1)[1]: r["n"] for r in self._read([f for f, _ in files]).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count("*").alias("n")).collect()}
        return [Shard(run, tier, f.removeprefix(self._base(f)), counts[f.rsplit("/", 1)[1]], size) for f, size in files if counts.get(f.rsplit("/", 1)[1])]

    def _base(self, file: str) -> str:
        return file[: file.rindex("/data/") + 1]

    def append(self, rows: DataFrame, arrivals: int = 1, key: str | None = None) -> int:
        """Appends ``rows`` as ``arrivals`` runs in one pass, dealt by a hash of ``key``; one version for each run. No rows add no run."""
        name = "_arrival"
        while name in rows.columns:
            name += "_"
        folder = self.fs.join("data", f"in-{uuid.uuid4().hex}")
        dealt = rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(arrivals)) if key and arrivals > 1 else F.lit(0))
        dealt.write.partitionBy(name).option("compression", "zstd").parquet(folder)
        base, live = self.version(), self.shards()
        run = max((s.run for s in live), default=0)
        for part in [n for n in self.fs.names(folder) if n.startswith(f"{name}=")]:
            if new := self._listed(f"{folder}/{part}", run + 1, 0):
                run, live = run + 1, live + new
                base = self._commit(base, live)
        return base

    def compact(self, at_once: int = 4) -> int:
        """Merges runs of similar size until no ``fan_in`` of them are left; returns the version.

        ``at_once`` merges write at a time; each is committed as a version of its own. Runs whose files have the
        target size are left alone.
        """
        while groups := similar_runs(self.shards(), self.fan_in, self.target_bytes):
            live = self.shards()
            with ThreadPoolExecutor(at_once) as pool:
                for group, new in zip(groups, pool.map(lambda g: self._merged([s for s in live if s.run in g]), groups)):
                    now = self.shards()
                    run = max(s.run for s in now) + 1
                    self._commit(self.version(), [s for s in now if s.run not in group] + [replace(s, run=run) for s in new])
        return self.version()

    def _merged(self, old: list[Shard]) -> list[Shard]:
        """The shards' rows in files of the target size; nothing is committed."""
        folder = self.fs.join("data", f"merge-{uuid.uuid4().hex}")
        # No shuffle: neighbouring input splits flow into one file until it has its size.
        files = max(1, round(sum(s.bytes for s in old) / self.target_bytes))
        self._read([self.fs.join(s.file) for s in old]).coalesce(files).write.option("compression", "zstd").parquet(folder)
        new = self._listed(folder, 0, max(s.tier for s in old) + 1)
        if sum(s.rows for s in new) != sum(s.rows for s in old):
            raise RuntimeError("a merge changed the number of rows; nothing was committed")
        return new

    def vacuum(self, keep: int = 1) -> int:
        """Drops all versions but the last ``keep``, and the files that only they name; returns the files dropped.

        Files that no version has named are left: they may be those of a write under way.
        """
        versions = [int(n[1:-5]) for n in self.fs.names(self.fs.join("manifest")) if n.startswith("v")]
        old = versions[:-keep]
        kept = {s.file for v in versions[-keep:] for s in self.shards(v)}
        gone = {s.file for v in old for s in self.shards(v)} - kept
        for file in gone:
            self.fs.delete(self.fs.join(file))
        for v in old:
            self.fs.delete(self.fs.join("manifest", f"v{v:012d}.json"))
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        """The store's rows at a version that hasn't been vacuumed, by default the latest."""
        files = [self.fs.join(s.file) for s in self.shards(version)]
        return self._read(files) if files else self.spark.createDataFrame([], self.schema)

    def placed(self, *columns: str) -> DataFrame:
        """``columns`` of every row with its run, tier and shard (numbered by name in its run), the shard's rows, and the version.

        Where one of ``columns`` has such a name, the place's own column has an underscore after it.
        """
        version = self.version()
        kinds = {"run": "long", "tier": "int", "shard": "int", "shard_rows": "long", "version": "long"}
        name = {c: c for c in kinds}
        for c in name:
            while name[c] in columns:
                name[c] += "_"
        if not self.shards(version):
            return self.spark.createDataFrame([], self.schema).select(*columns, *[F.lit(0).cast(t).alias(name[c]) for c, t in kinds.items()])
        listed = self.spark.read.schema("run long, tier int, file string, rows long, bytes long").json(self.fs.join("manifest", f"v{version:012d}.json"))
        number = F.row_number().over(_by_run())
        listed = listed.select(F.col("file").alias("_shard_file"), F.struct("run", "tier", number.alias("shard"), F.col("rows").alias("shard_rows"), F.lit(version).cast("long").alias("version")).alias("_shard_place"))
        # By the path as the manifest lists it: all arrivals of one append have files of the same names.
        rows = self.read(version).select(*columns, F.regexp_extract(F.col("_metadata.file_path"), "^.*/(data/.*)$", 1).alias("_shard_file"))
        return rows.join(listed, "_shard_file").select(*columns, *[F.col(f"_shard_place.{c}").alias(name[c]) for c in kinds])


def _by_run():
    from pyspark.sql import Window

    return Window.partitionBy("run").orderBy("file")


def similar_runs(shards: list[Shard], fan_in: int, target_bytes: int | None = None, low: float = 0.5, high: float = 1.5) -> list[list[int]]:
    """Groups of ``fan_in`` runs whose sizes are within ``low`` to ``high`` times their mean, smallest first.

    Runs whose files have three quarters of ``target_bytes`` on average are done.
    """
    size: dict[int, int] = {}
    files: dict[int, int] = {}
    for s in shards:
        size[s.run] = size.get(s.run, 0) + s.bytes
        files[s.run] = files.get(s.run, 0) + 1
    size = {r: n for r, n in size.items() if target_bytes is None or n < 0.75 * target_bytes * files[r]}
    tiers: list[list[int]] = []
    for run in sorted(size, key=lambda r: (size[r], r)):
        mean = sum(size[r] for r in tiers[-1]) / len(tiers[-1]) if tiers else 0
        if tiers and low * mean <= size[run] <= high * mean:
            tiers[-1].append(run)
        else:
            tiers.append([run])
    return [tier[i : i + fan_in] for tier in tiers for i in range(0, len(tier) - fan_in + 1, fan_in)]
