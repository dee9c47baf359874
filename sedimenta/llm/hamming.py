"""Exact top-k by Hamming distance: incremental multi-index hashing of binary codes.

A code is cut into 16-bit segments, and a block of codes has one index a segment. If all
segments have been probed at radius s, and the first a of them at s + 1, then every code
within segments * (s + 1) - 1 + a bits has been met. A query's radius grows segment by segment
until its k-th verified distance is within what is covered. Queries meet codes in blocks. First
each query meets one block, which bounds its k-th distance over all codes; in all other blocks its
radius grows until that bound is covered, and not until the block has k codes of its own. The k
best of what it meets are the answer.

Equal codes are one entry with their k smallest ids, so a code that very many rows share costs
what any other does.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.sources.hfs import stage_table


@functools.cache
def _flips(radius: int) -> np.ndarray:
    """All 16-bit masks with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(16), radius)], np.uint16)


class SegmentIndex:
    """Multi-index over distinct codes: an (n, bytes) array with an even number of bytes."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.segments = self.codes.view("<u2")
        self.order = [np.argsort(s, kind="stable") for s in self.segments.T]
        self.starts = [np.searchsorted(s[o], np.arange(65537)) for s, o in zip(self.segments.T, self.order)]
        self.probed = 0

    def nearest(self, code: np.ndarray, counts: np.ndarray, k: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of all codes that can be among the k nearest, where a row stands for counts[row] ids.

        ``bound``: a distance within which k are known to be, here or elsewhere.
        """
        parts = code.view("<u2")
        n = len(parts)
        met = np.zeros(len(self.codes), bool)
        rows, distances = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(17):
            for segment in range(n):
                keys = (parts[segment] ^ _flips(radius)).astype(np.int64)
                first, last = self.starts[segment][keys], self.starts[segment][keys + 1]
                some = last > first
                first, count = first[some], (last - first)[some]
                self.probed += len(keys)
                if len(first):
                    ends = np.cumsum(count)
                    found = self.order[segment][np.arange(ends[-1]) + np.repeat(first - (ends - count), count)]
                    found = found[~met[found]]
                    met[found] = True
                    rows = np.concatenate((rows, found))
                    distances = np.concatenate((distances, np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=np.int64)))
                covered = n * radius + segment
                if bound is not None and covered >= bound:
                    return rows[distances <= bound], distances[distances <= bound]
                near = distances <= covered
                if counts[rows[near]].sum() >= k:
                    best = np.sort(np.repeat(distances[near], counts[rows[near]]))[k - 1]
                    return rows[distances <= best], distances[distances <= best]
        return rows, distances


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int | None = None, threshold: float = 0.0) -> DataFrame:
    """(id, code): one bit a dimension, set where the value is above ``threshold``; null values and NaN count as not above.

    A code has ``bits`` dimensions, by default as many as the longest vector; a shorter vector's missing values count
    as null. Rows with a null id or a null vector have no code and are left out, as are longer vectors where ``bits`` is given.
    """
    size = F.size(vector_col)
    if bits is None:
        bits = vectors.agg(F.max(size)).first()[0] or 0
    width = max(16, -(-bits // 16) * 16)

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            first, count = column.offsets.to_numpy(), np.diff(column.offsets.to_numpy())
            flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[first[0] :]
            x = np.zeros((len(count), width), bool)
            with np.errstate(invalid="ignore"):
                x[np.repeat(np.arange(len(count)), count), np.arange(len(flat[: count.sum()])) - np.repeat(first[:-1] - first[0], count)] = flat[: count.sum()] > threshold
            packed = np.packbits(x, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "code"])

    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (size <= bits)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, code binary")


def top_k(queries: DataFrame, codes: DataFrame, k: int = 10, query_block: int = 1024, code_block: int = 1 << 16) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of ``codes`` (id, code) for every row of ``queries`` (id, code).

    Exact; ties go to the smaller id, and a query's own row counts like any other. Repeated (id, code) rows
    count once. Fewer than k codes give fewer rows; no queries or no codes give none. Codes have one length.
    """
    # The k smallest ids of each code; more of them can't be in an answer.
    order = Window.partitionBy("code").orderBy("id")
    few = codes.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    index, _ = stage_table(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    blocks, parts = -(-max(1, index.count()) // code_block), -(-max(1, queries.count()) // query_block)
    home = F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")
    index = index.select("code", "ids", home.alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("qb"))
    asked = queries.distinct().select("id", "code", F.pmod(F.xxhash64("code", "id"), F.lit(parts)).cast("int").alias("qb"), home.alias("home"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            ids = right.column("ids").to_pylist()
            counts = np.array([len(x) for x in ids])
            index, seen = SegmentIndex(codes), {}
            for query, code, bound in zip(*(left.column(c).to_pylist() for c in ("id", "code", "bound"))):
                if (code, bound) not in seen:
                    rows, distances = index.nearest(np.frombuffer(code, np.uint8), counts, k, bound)
                    seen[code, bound] = sorted((int(d), i) for r, d in zip(rows, distances) for i in ids[r])[:k]
                for d, i in seen[code, bound]:
                    for column, v in zip(out, (query, i, d)):
                        column.append(v)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.int32())})

    def met(some: DataFrame) -> DataFrame:
        return some.groupBy("qb", "cb").cogroup(index.groupBy("qb", "cb")).applyInArrow(meet, "query_id long, id long, distance int")

    found = met(asked.select("id", "code", "qb", F.col("home").alias("cb"), F.lit(None).cast("int").alias("bound")))
    if blocks > 1:
        found, _ = stage_table(found, "met")
        bound = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("most")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("most")).alias("bound"))
        others = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(blocks - 1)), F.col("home")))
        found = found.unionAll(met(asked.join(bound, "id", "left").select("id", "code", "qb", others.alias("cb"), "bound")))
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
