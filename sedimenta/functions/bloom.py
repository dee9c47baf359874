"""Bloom filters over keys, beside those that Parquet keeps for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class KeyFilter:
    """Says of a key that it may be among those given, or that it surely isn't.

    The executors build it; the driver holds ``expected * 9.6`` bits or so at a rate of 0.01, so it is for key sets
    of a known, bounded number. Runs of any size have Parquet's own filters.
    """

    def __init__(self, spark: SparkSession, java_filter):
        self._spark, self._filter = spark, java_filter

    @classmethod
    def build(cls, keys: DataFrame, expected: int, rate: float = 0.01, key: str = "key") -> KeyFilter:
        """From a text or long column; more keys than ``expected`` raise the rate, but no key is ever missed."""
        if not 0 < rate < 1:
            raise ValueError("the rate must lie between 0 and 1")
        return cls(keys.sparkSession, keys._jdf.stat().bloomFilter(key, expected, float(rate)))

    def may_contain(self, key) -> bool:
        return bool(self._filter.mightContain(key))

    def to_bytes(self) -> bytes:
        out = self._spark._jvm.java.io.ByteArrayOutputStream()
        self._filter.writeTo(out)
        return bytes(out.toByteArray())

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes) -> KeyFilter:
        given = spark._jvm.java.io.ByteArrayInputStream(bytearray(data))
        return cls(spark, spark._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(given))
