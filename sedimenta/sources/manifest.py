"""The manifest: which runs make up a table, as atomically published versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.plans.log import Bound
from sedimenta.sources.hfs import Hfs


@dataclass(frozen=True)
class RunEntry:
    """One immutable sorted run; keys as bytes, bytes as stored."""

    id: str
    level: int
    path: str
    min_key: bytes
    max_key: bytes
    rows: int
    bytes: int
    min_seq: int
    max_seq: int
    #: The sum of its rows' checksums.
    crc: int | None = None

    def to_json(self) -> dict:
        return asdict(self) | {"min_key": self.min_key.hex(), "max_key": self.max_key.hex()}

    @classmethod
    def from_json(cls, d: dict) -> RunEntry:
        return cls(**d | {"min_key": bytes.fromhex(d["min_key"]), "max_key": bytes.fromhex(d["max_key"])})


#: Entries as rows.
ENTRIES = "id string, level int, path string, min_key binary, max_key binary, rows long, bytes long, min_seq long, max_seq long, crc long"


@dataclass(frozen=True)
class Snapshot:
    """One version of a table."""

    version: int = 0
    runs: tuple[RunEntry, ...] = ()
    #: The last sequence number that runs hold; later ones are in the write-ahead log.
    flushed_seq: int = 0
    #: The last epoch of each streaming query.
    epochs: dict = field(default_factory=dict)
    #: The name of a table beside the version that has runs more, which the driver doesn't hold.
    table: str | None = None


class ManifestConflict(RuntimeError):
    """Another writer has published the next version first."""


def apply_changes(runs: Iterable[RunEntry], create: Iterable[RunEntry] = (), delete: Iterable[str] = ()) -> tuple[RunEntry, ...]:
    """Creates, then deletes; creating a live id or deleting an unknown one is an error."""
    live = {r.id: r for r in runs}
    for r in create:
        if r.id in live:
            raise ValueError(f"run {r.id} exists")
        live[r.id] = r
    for i in delete:
        if i not in live:
            raise ValueError(f"run {i} isn't in the manifest")
        del live[i]
    return tuple(live.values())


def prune(runs: Iterable[RunEntry], lower: Bound, upper: Bound) -> list[RunEntry]:
    """Runs that can hold a key of the range; bounds count as included, which keeps no run too few."""
    return [r for r in runs if (lower.kind == "unbounded" or r.max_key >= lower.key) and (upper.kind == "unbounded" or r.min_key <= upper.key)]


def prune_df(entries: DataFrame, lower: Bound, upper: Bound) -> DataFrame:
    """The same over entries as rows. Plain comparisons, so that they reach the scan."""
    for bound, column, test in ((lower, "max_key", "__ge__"), (upper, "min_key", "__le__")):
        if bound.kind != "unbounded":
            entries = entries.where(getattr(F.col(column), test)(F.lit(bytearray(bound.key))))
    return entries


class Manifest:
    """Versions below ``root/_manifest``; a commit is one atomic rename to the next version's name.

    A version lists its runs. Very many can lie in a Parquet table that the version names instead (:meth:`commit_df`);
    :meth:`frame` leaves those to the executors, :meth:`load` brings them to the driver.
    """

    def __init__(self, fs: Hfs):
        self.fs, self.folder = fs, fs.join("_manifest")
        fs.mkdirs(self.folder)

    def versions(self) -> list[int]:
        return [int(n[:20]) for n in self.fs.names(self.folder) if n.endswith(".json") and not n.startswith(".")]

    def load(self, version: int | None = None) -> Snapshot:
        """A version with all of its runs."""
        s = self._listed(version)
        if s.table is None:
            return s
        more = (RunEntry(**r.asDict() | {"min_key": bytes(r["min_key"]), "max_key": bytes(r["max_key"])}) for r in self._table(s.table).toLocalIterator())
        return replace(s, runs=(*s.runs, *more), table=None)

    def _listed(self, version: int | None) -> Snapshot:
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Snapshot()
        d = json.loads(self.fs.read(f"{self.folder}/{version:020d}.json"))
        return Snapshot(d["version"], tuple(map(RunEntry.from_json, d["runs"])), d["flushed_seq"], d["epochs"], d.get("table"))

    def _table(self, name: str) -> DataFrame:
        return self.fs.spark.read.schema(ENTRIES).parquet(f"{self.folder}/{name}")

    def commit(self, base: Snapshot, **changes) -> Snapshot:
        """Publishes ``base`` with ``changes`` as the next version, or raises if there is one already."""
        new = replace(base, version=base.version + 1, **changes)
        data = json.dumps({"version": new.version, "runs": [r.to_json() for r in new.runs], "flushed_seq": new.flushed_seq, "epochs": new.epochs, "table": new.table})
        if not self.fs.create_exclusive(f"{self.folder}/{new.version:020d}.json", data.encode()):
            raise ManifestConflict(f"version {new.version} exists")
        return new

    def commit_df(self, base: Snapshot, create: DataFrame, **changes) -> Snapshot:
        """Publishes ``base`` and the runs of a DataFrame of ``ENTRIES``, written by the executors in key order; the driver holds none of them."""
        rows = self._rows(self.fs.spark, base.runs)
        if base.table is not None:
            create = create.unionByName(self._table(base.table))
        name = f"runs-{uuid.uuid4().hex}"
        create.select(rows.columns).repartitionByRange("min_key").sortWithinPartitions("min_key").write.parquet(f"{self.folder}/{name}")
        table = self._table(name)
        twice = table.select("id").unionAll(rows.select("id")).groupBy("id").count().where("count > 1").first()
        if twice or not table.where("id is null or min_key is null or max_key is null").isEmpty():
            self.fs.delete(f"{self.folder}/{name}")
            raise ValueError(f"run {twice['id']} exists" if twice else "a run has no id or no key range")
        return self.commit(base, table=name, **changes)

    def stale_tables(self, keep: Iterable[int], before: float) -> list[str]:
        """Files, older than a time, of tables that none of the kept versions names."""
        live = {self._listed(v).table for v in keep}
        return [path for n in self.fs.names(self.folder) if n.startswith("runs-") and n not in live for path, _ in self.fs.files(f"{self.folder}/{n}", ".parquet", before)]

    def frame(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The version's runs as a DataFrame."""
        s = self._listed(version)
        if s.table is None:
            return self._rows(spark, s.runs)
        return self._rows(spark, s.runs).unionAll(self._table(s.table)) if s.runs else self._table(s.table)

    @staticmethod
    def _rows(spark: SparkSession, runs: Iterable[RunEntry]) -> DataFrame:
        rows = [(r.id, r.level, r.path, bytearray(r.min_key), bytearray(r.max_key), r.rows, r.bytes, r.min_seq, r.max_seq, r.crc) for r in runs]
        return spark.createDataFrame(rows, ENTRIES)


def replay(changes: DataFrame) -> DataFrame:
    """(id, level) of the live tables of a change log (id, ord, op create or delete, level): the last change of each id decides."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ord")))
    return changes.withColumn("n", last).where("n = 1 and op = 'create'").select("id", "level")
