"""Write-ahead log: one durable segment for each committed batch, named by its sequence number."""

from __future__ import annotations

import struct
import uuid
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.entries import decode_entries, encode_entry, frame, frames
from sedimenta.plans.log import LOG_SCHEMA
from sedimenta.sources.hfs import Hfs, shuffles_dropped

Entry = tuple[bytes, bytes | None]
#: Beyond these bytes a segment of a DataFrame takes no more batches.
SEGMENT_BYTES = 16 << 20


def _record(seq: int, entries: list[Entry]) -> bytes:
    return frame(struct.pack(">q", seq) + b"".join(encode_entry(k, v) for k, v in entries))


class Wal:
    """Segments below ``root/wal``. A segment's name is its first sequence number; publishing it is the commit."""

    def __init__(self, fs: Hfs):
        self.fs, self.folder = fs, fs.join("wal")
        fs.mkdirs(self.folder)

    def append(self, batches: list[tuple[int, list[Entry]]]) -> bool:
        """Writes batches (seq, entries) as one segment; False if another writer has that sequence number."""
        if not batches:
            return True
        data = b"".join(_record(seq, entries) for seq, entries in batches)
        return self.fs.create_exclusive(f"{self.folder}/{batches[0][0]:020d}.log", data)

    def append_df(self, rows: DataFrame, segment_batches: int = 20_000) -> bool:
        """Writes log rows (key, value or null, seq, ord), a batch for each seq, as segments of so many batches at most.

        Executors write the segments, and the driver renames them in their order: what a failure leaves is the log's
        beginning. False, and nothing is written, if another writer has one of the sequence numbers that name them.
        """

        def segments(batches):
            def one():
                first = f"{struct.unpack_from('>q', records[0], 8)[0]:020d}"
                return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([b"".join(records)], pa.binary())], ["first", "data"])

            flat = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("seq", "key", "value"))))
            records: list[bytes] = []
            size = 0
            for seq, entries in groupby(flat, key=lambda r: r[0]):
                batch = [(k, v) for _, k, v in entries]
                if seq is None or not all(k for k, _ in batch):
                    raise ValueError("empty key or sequence number")
                record = _record(seq, batch)
                if records and (len(records) == segment_batches or size + len(record) > SEGMENT_BYTES):
                    yield one()
                    records, size = [], 0
                records.append(record)
                size += len(record)
            if records:
                yield one()

        spark, staged = rows.sparkSession, f"{self.folder}/.staged-{uuid.uuid4().hex}"
        log = rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "seq", "ord")
        # A sequence number is in one range; the ranges follow each other.
        made = log.repartitionByRange("seq").sortWithinPartitions("seq", "ord").mapInArrow(segments, "first string, data binary")
        try:
            # A row is a file. The line feed that the writer puts after it is shorter than a record's head, so no reader takes it for one.
            with shuffles_dropped(spark):
                made.select("first", F.col("data").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").partitionBy("first").text(staged)
            names = [n for n in self.fs.names(staged) if n.startswith("first=")]
            taken = set(self.fs.names(self.folder))
            if any(f"{n[6:]}.log" in taken for n in names):
                return False
            for n in names:
                [(path, _)] = self.fs.files(f"{staged}/{n}", ".txt")
                if not self.fs.publish(path, f"{self.folder}/{n[6:]}.log"):
                    raise RuntimeError(f"another writer has written segment {n[6:]} meanwhile; those before it are in the log")
            return True
        finally:
            self.fs.delete(staged)

    def replay(self, after: int = 0) -> list[tuple[int, list[Entry]]]:
        """Batches with a sequence number above ``after``, in order; each segment up to its first damaged record."""
        out = []
        for name in self.fs.names(self.folder):
            if name.endswith(".log") and not name.startswith("."):
                for payload in frames(self.fs.read(f"{self.folder}/{name}")):
                    (seq,) = struct.unpack_from(">q", payload)
                    if seq > after:
                        out.append((seq, decode_entries(payload[8:])))
        return sorted(out, key=lambda b: b[0])

    def frame(self, spark: SparkSession, after: int = 0) -> DataFrame:
        """The same as log rows, read by the executors segment by segment; for logs too large for the driver."""
        if not any(n.endswith(".log") and not n.startswith(".") for n in self.fs.names(self.folder)):
            return spark.createDataFrame([], LOG_SCHEMA)

        def rows(batches):
            for batch in batches:
                for segment in batch.column("content").to_pylist():
                    out = [(k, v, v is None, seq, i) for payload in frames(segment) for seq in struct.unpack_from(">q", payload) if seq > after for i, (k, v) in enumerate(decode_entries(payload[8:]))]
                    kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], LOG_SCHEMA.names)

        segments = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(self.folder)
        return segments.select("content").mapInArrow(rows, LOG_SCHEMA)

    def trim(self, upto: int) -> None:
        """Drops segments whose batches are all in runs."""
        names = [n for n in self.fs.names(self.folder) if n.endswith(".log") and not n.startswith(".")]
        for name, following in zip(names, [*names[1:], None]):
            last = int(following[:20]) - 1 if following else max((s for s, _ in (self._batches(name))), default=0)
            if last <= upto:
                self.fs.delete(f"{self.folder}/{name}")

    def _batches(self, name: str):
        return [(struct.unpack_from(">q", p)[0], p) for p in frames(self.fs.read(f"{self.folder}/{name}"))]
