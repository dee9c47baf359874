"""Best-fit packing of token sequences, planned on the histogram of piece lengths.

A piece's place depends on its length alone, so the packing of any number of pieces is
planned on counts by length (one row a length, at most the capacity) and applied by rank:
the r-th piece of a length takes the r-th place planned for that length. Lengths above one
third of the capacity are matched first, each with the largest that still fits, at most
two a sequence; shorter ones then go to the fullest gap that takes them.
"""

from __future__ import annotations

import bisect
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.textcore import Memo, category_table, code_points, held, lean, ragged, slices
from sedimenta.sources.hfs import stage_table

# What a byte-level pattern splits off after an apostrophe.
_CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
_SPECIAL = "<|endoftext|>"
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 0, 3


def pretoken_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern begins a new piece of text.

    A piece is an optional blank and a run of letters, of numbers or of other marks; a contraction
    after an apostrophe; or white space, whose last character stands apart from a longer run.
    """
    n = len(cp)
    kind = category_table()[cp]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[first] = 9
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = 9, kind[1:]
    after[last] = 9
    space = kind == _SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = cp[:-1] == 32
    blank_before &= ~first
    start = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != 9)), (before != kind) & ~blank_before)
    # Contractions: an apostrophe that begins a piece takes its letters with it, and only them.
    marks = np.flatnonzero((cp == 39) & start)
    if len(marks):
        padded = np.concatenate((cp, np.zeros(3, cp.dtype)))
        end_of = offsets[np.searchsorted(offsets, marks, "right")]
        for word in _CONTRACTIONS:
            fits = marks + 1 + len(word) <= end_of
            for k, c in enumerate(word):
                fits &= padded[marks + 1 + k] == ord(c)
            at = marks[fits]
            start[at + 1] = False
            cut = at + 1 + len(word)
            # what follows goes on as if the pattern began there; a blank begins its own piece anyway
            ok = cut < end_of[fits]
            start[cut[ok]] = True
            marks, end_of = marks[~fits], end_of[~fits]
    return start


class Encoder:
    """Token ids of many texts, each distinct piece of text encoded once by the tokenizer."""

    #: Pieces that are remembered before all are forgotten; those of the texts at hand may be more.
    MOST = 1 << 20

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo()
        self._forget()

    def _forget(self) -> None:
        self.known, self.used = 0, 0
        self.first, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        count = np.array([len(x) for x in got], np.int64)
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(count.sum()))
        if self.known + len(got) > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros(max(len(x), len(got)), np.int64))) for x in (self.first, self.count))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)))
        rows = np.arange(self.known, self.known + len(got))
        self.first[rows], self.count[rows] = self.used + np.cumsum(count) - count, count
        self.ids[self.used : self.used + len(flat)] = flat
        self.known, self.used = self.known + len(got), self.used + len(flat)

    def encode(self, texts: list[str]):
        """The ids of each text as an array, in order."""
        for i, j in slices([len(t) for t in texts]):
            some = texts[i:j]
            odd = {k: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for k, t in enumerate(some) if _SPECIAL in t}
            whole, cp, offsets = code_points([("" if k in odd else t) for k, t in enumerate(some)])
            if not len(cp):
                yield from (odd.get(k, np.empty(0, np.uint32)) for k in range(j - i))
                continue
            starts = np.flatnonzero(pretoken_starts(cp, offsets))
            ends = np.append(starts[1:], len(cp))

            def learn(at, whole=whole, starts=starts, ends=ends):
                self._learn([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])

            rows = self.memo.rows(cp, starts, ends, learn, self.MOST, self._forget)
            count = self.count[rows]
            ids = self.ids[ragged(self.first[rows], count)]
            tokens = np.concatenate(([0], np.cumsum(count)))
            border = tokens[np.searchsorted(starts, offsets)]
            for k in range(j - i):
                yield odd[k] if k in odd else ids[border[k] : border[k + 1]]


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    known = held("packing")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut to ``capacity``; the first piece takes the rest."""

    def cut(batches):
        e = encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), e.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start, piece = 0, 0
                while start < len(ids):
                    length = capacity if piece else len(ids) % capacity or capacity
                    for column, v in zip(rows, (doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        column.append(v)
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean("packing", cut), "id long, piece int, start long, length long, ids_crc32 long")


def plan_places(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places by length: (length, first rank, last rank + 1, pieces a sequence, first sequence, offset).

    The piece of rank r goes to sequence ``first + (r - first rank) // k`` at ``offset + (r - first rank) % k * length``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    places, sequences = [], 0
    gaps: dict[int, list[list[int]]] = {}
    order: list[int] = []

    def put(length, pieces, k, sequence, offset):
        places.append((length, used[length], used[length] + pieces, k, sequence, offset))
        used[length] += pieces
        left[length] -= pieces

    def open_gap(gap, sequence, n):
        if gap > 0 and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append([sequence, n])

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect.bisect_right(large, min(capacity - length, length)) - 1
            while at >= 0 and (not left[large[at]] or (large[at] == length and left[length] < 2)):
                at -= 1
            partner = large[at] if at >= 0 else 0
            n = left[length] // 2 if partner == length else min(left[length], left[partner]) if partner else left[length]
            if partner == length:
                put(length, 2 * n, 2, sequences, 0)
            else:
                put(length, n, 1, sequences, 0)
                if partner:
                    put(partner, n, 1, sequences, length)
            open_gap(capacity - length - partner, sequences, n)
            sequences += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                k = capacity // length
                open_gap(capacity, sequences, -(-left[length] // k))
                sequences += -(-left[length] // k)
                continue
            gap = order[at]
            sequence, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            k = min(gap // length, left[length])
            take = min(n, left[length] // k)
            put(length, take * k, k, sequence, capacity - gap)
            open_gap(gap - k * length, sequence, take)
            open_gap(gap, sequence + take, n - take)
    return places


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, bucket_pieces: int = 1 << 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Null texts count as empty: one piece that holds ``end_id`` only. Rows with one id, equal rows and a
    null id are packed like any others. Pieces of one length are ranked by a hash bucket, then by id and
    piece; there are as many buckets as give each about ``bucket_pieces`` pieces of all lengths, so a length that
    very many pieces share isn't ranked in one task. An empty table gives no rows.
    """
    spark = docs.sparkSession
    # Equal pieces (of a hot id, or of a row that is there very often) are dealt out by where they were made.
    made = F.monotonically_increasing_id()
    pieces, _ = stage_table(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("deal", F.pmod(F.xxhash64("id", "piece", "ids_crc32", made), F.lit(1 << 30)).cast("int")), "pieces")
    pieces = pieces.withColumn("bucket", F.pmod("deal", F.lit(-(-max(1, pieces.count()) // bucket_pieces))).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = plan_places(totals, capacity)
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    # A few places for each length, whatever the number of pieces.
    table = spark.createDataFrame(places or [(0, 0, 0, 1, 0, 0)], "length long, low long, high long, k long, sequence long, base long").withColumnRenamed("length", "place_length")
    at = F.col("rank") - F.col("low")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("place_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(at / F.col("k"))).alias("sequence_id"), (F.col("base") + at % F.col("k") * F.col("length")).alias("offset"))
