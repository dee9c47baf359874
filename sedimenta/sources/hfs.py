"""Small driver-side helpers over the Hadoop file system API.

Metadata files (manifests, logs) must live wherever the data lives, which may be a
store that only Spark's own readers can reach, so nothing here uses ``open()``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


class Hfs:
    """File system operations for one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self.path(self.root).getFileSystem(self._conf)

    def path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def join(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, p: str) -> bool:
        return self._fs.exists(self.path(p))

    def mkdirs(self, p: str) -> None:
        self._fs.mkdirs(self.path(p))

    def delete(self, p: str) -> None:
        self._fs.delete(self.path(p), True)

    def read(self, p: str) -> bytes:
        status = self._fs.getFileStatus(self.path(p))
        stream = self._fs.open(self.path(p))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, status.getLen()))
        finally:
            stream.close()

    def names(self, p: str) -> list[str]:
        """Sorted names below a directory; empty if there is none."""
        if not self.exists(p):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(p)))

    def files(self, p: str, suffix: str = "", before: float | None = None) -> list[tuple[str, int]]:
        """(full path, bytes) of the files directly below a directory, by name; with ``before`` (a time), older ones only."""
        if not self.exists(p):
            return []
        found = [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(self.path(p)) if s.isFile() and (before is None or s.getModificationTime() <= before * 1000)]
        return sorted(f for f in found if f[0].endswith(suffix))

    def write(self, p: str, data: bytes) -> None:
        """Writes and syncs a file, replacing it if there is one."""
        out = self._fs.create(self.path(p), True)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()

    def create_exclusive(self, p: str, data: bytes) -> bool:
        """Atomically publishes a file; False if someone else has published that name.

        The bytes go to a private name first, so a reader sees all of the file or none of it.
        """
        tmp = f"{p.rsplit('/', 1)[0]}/.tmp-{uuid.uuid4().hex}"
        self.write(tmp, data)
        if self.publish(tmp, p):
            return True
        self.delete(tmp)
        return False

    def publish(self, tmp: str, p: str) -> bool:
        """Atomically gives a written file its name; False, and the file stays, if that name is taken."""
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(p).toUri(), self._conf)
        none = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self.path(tmp), self.path(p), none)
            return True
        except Exception as e:  # noqa: BLE001 - only a lost race is an answer, all else goes on
            if "FileAlreadyExists" in str(e) or self.exists(p):
                return False
            raise


_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors share; it goes when the application ends.

    Where the setting is unset, a temporary folder serves a local master only: on a cluster executors don't share one.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            given = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
        _OWN[app] = f"{given.rstrip('/')}/sedimenta/{app}"
        atexit.register(_drop_own, Hfs(spark, _OWN[app]))
    return _OWN[app]


def _drop_own(folder: Hfs) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone before
        folder.delete(folder.root)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """While it holds, a query's shuffle files go as soon as the query ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage_table(df, name: str = "t"):
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors.

    Returns the table as read, and its path for :func:`drop_table`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        Hfs(spark, path).delete(path)
