"""N-gram Jaccard join: all documents whose word shingles overlap enough, exactly.

A document is the set of its distinct word shingles, kept as a sorted array of 64-bit
hashes. Sizes are banded, and only sets of one band or of neighbouring bands can link.

1. Within a tile (a band with the sizes that reach into it) two linked sets differ in at
   most k shingles. The hash space is cut into parts; a set with shingles in more than k of
   them shares such a part, unchanged, with any set that it links to. Each set gives one
   signature for each part that it has shingles in (and, if those are k or fewer, for the
   others too). Sets with an equal signature may link; this loses no link.
2. One set of each signature, its hub, meets all others of it: a pair whose bitmaps allow a
   link (|A| + |B| minus the bits in which they differ bounds twice the overlap from above) gets
   the exact intersection of the sorted arrays. Links so far give components; a large group of
   near copies mostly falls together here, at a cost in proportion to its size.
3. Signatures whose other sets lie in more than one component are left. There, sets that aren't
   connected are compared by bitmaps; what may link hangs together as clusters, whose sorted
   arrays meet in tiles of bounded size. Tiles hold no pairs of sets that are both in a
   cluster's main component, so few stragglers beside many near copies cost little.
4. Connected components of all links.

Equal sets have equal signatures and one name, so a large group of copies counts as one set.
Every table that is staged on the way is dropped as soon as the next one is written.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.components import components
from sedimenta.llm.textcore import SLICE, U64, lean, mix, slices, span_hashes, spans
from sedimenta.sources.hfs import drop_table, stage_table

_BYTE_LOWER = np.arange(256, dtype=np.uint8)
_BYTE_LOWER[65:91] += 32
_BYTE_WORD = np.ones(256, bool)
_BYTE_WORD[[32, *range(9, 14)]] = False


def shingle_sets(column: pa.Array, words: int):
    """Each text's sorted distinct shingle hashes, in order; null and wordless texts give an empty array.

    Letters A-Z are lower-cased, words are runs without blanks; a text of fewer words is one shingle.
    """
    raw = [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]
    for i, j in slices([len(t) for t in raw], SLICE):
        data = _BYTE_LOWER[np.frombuffer(b"".join(raw[i:j]), np.uint8)]
        offsets = np.zeros(j - i + 1, np.int64)
        np.cumsum([len(t) for t in raw[i:j]], out=offsets[1:])
        starts, ends, text = spans(_BYTE_WORD[data], offsets)
        h = span_hashes(data, starts, ends)
        first = np.searchsorted(text, np.arange(j - i + 1))
        rolled = np.zeros(len(h), U64)
        for k in range(min(words, len(h))):  # a word's place counts; what lies beyond a text's end is cut off below
            rolled[: len(h) - k] += mix(h[k:] + U64(2 * k + 1))
        rolled = mix(rolled)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                yield mix(mix(h[a:b] + np.arange(1, 2 * (b - a), 2, dtype=U64)).sum(keepdims=True, dtype=U64) + U64(b - a))
            else:
                yield np.empty(0, U64)


def _parts(size: int, differ: int) -> int:
    """So many parts that a set of ``size`` has shingles in more than ``differ`` of them, mostly."""
    parts = differ + 1
    while parts < 2 * size and parts * (1 - np.exp(-size / parts)) < differ + 1 + np.sqrt(differ) / 2:
        parts += max(1, parts // 16)
    return parts


class Bands:
    """Size bands for a similarity of num / den or more, and the parts that each band's tile needs."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] <= largest:
            low = self.low[-1]
            self.low.append(max(low + 1, -(-low * den * den // (num * num))))
        # The smaller set has at most low[b + 1] - 1 shingles, the larger at most 1 / similarity times as many.
        self.reach = [(x - 1) * den // num for x in self.low[1:]]
        self.differ = [(x - 1 + y) * (den - num) // (den + num) for x, y in zip(self.low[1:], self.reach)]
        self.parts = [_parts(low, k) for low, k in zip(self.low, self.differ)]

    def tiles(self, n: int) -> list[int]:
        """The tiles that a set of n shingles belongs to: its own band's, and the lower one's if that reaches it."""
        b = bisect_right(self.low, n) - 1
        return [b - 1, b] if b and n <= self.reach[b - 1] else [b]


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """One hash for each part of each tile that a sorted set has shingles in, or for all if those are too few to be sure."""
    out, mixed = [], mix(s ^ U64(0x5851F42D4C957F2D))
    for t in bands.tiles(len(s)):
        parts = bands.parts[t]
        part = ((s >> U64(32)) * U64(parts)) >> U64(32)
        sums = np.zeros(parts, U64)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums[part[at].astype(np.int64)] = np.add.reduceat(mixed, at)
        names = mix(sums + mix(np.arange(parts, dtype=U64) + U64(t << 32)))
        out.append(names[part[at].astype(np.int64)] if len(at) > bands.differ[t] else names)
    return np.concatenate(out).view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """A set's hashed bitmap, about two bits a shingle; a power of two wide, so that it can be folded to half."""
    width = 256
    while width < 2 * len(s):
        width *= 2
    bits = np.zeros(width, bool)
    bits[(s % U64(width)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap folded to ``width`` bytes, as 64-bit words."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0).view(U64)


def may_link(a: bytes, b: bytes, n: int, m: int, num: int, den: int) -> bool:
    """Whether the bitmaps of sets of n and m shingles leave room for a link."""
    if min(n, m) * den < max(n, m) * num:
        return False
    width = min(len(a), len(b))
    differ = int(np.bitwise_count(_folded(a, width) ^ _folded(b, width)).sum())
    return (n + m - differ) * (num + den) >= 2 * num * (n + m)


def tied(size: np.ndarray, bits: list[bytes], label: np.ndarray, other: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of indices that tie all sets whose bitmaps allow a link, as trees; sets of one label are tied from the start.

    ``other``: 0 or 1; if both occur only pairs of a 0 and a 1 are looked at.
    """
    order = np.argsort(size, kind="stable")
    n, kind = size[order], other[order]
    root = np.unique(label[order], return_inverse=True)[1].astype(np.int64)
    width = min((len(b) for b in bits), default=32)
    rows = np.stack([_folded(bits[i], width) for i in order]) if len(order) else np.empty((0, width // 8), U64)
    two = kind.any() and not kind.all()
    out = []
    for i in range(len(order) - 1):
        end = np.searchsorted(n, n[i] * den // num, "right")
        at = np.arange(i + 1, end)
        at = at[(root[at] != root[i]) & ((kind[at] != kind[i]) | (not two))]
        if len(at):
            both = n[at] + n[i]
            differ = np.bitwise_count(rows[at] ^ rows[i]).sum(axis=1, dtype=np.int64)
            for j in at[(both - differ) * (num + den) >= 2 * num * both]:
                if root[i] != root[j]:
                    out.append((int(order[i]), int(order[j])))
                    root[root == root[j]] = root[i]
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = sorted((len(a), len(b)))
    return small * den >= large * num and overlap(a, b) * (num + den) >= num * (len(a) + len(b))


def linked_pairs(sets: list[np.ndarray], label: np.ndarray, other: np.ndarray, num: int, den: int):
    """Links that connect what is linked, as index pairs; sets of one label are connected from the start.

    ``other`` as in :func:`tied`. Sets are sorted by size.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    # Linked sets' bitmaps are equally wide, or one is twice as wide as the other.
    width = np.array([max(32, 1 << max(0, (2 * int(x) - 1).bit_length() - 3)) for x in size], np.int64)
    place, rows, half = np.zeros(n, np.int64), {}, {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        bits = [bitmap(sets[i]) for i in at]
        rows[w] = np.stack([_folded(b, w) for b in bits])
        half[w] = np.stack([_folded(b, max(32, w // 2)) for b in bits])
    root = np.unique(label, return_inverse=True)[1].astype(np.int64)
    two = other.any() and not other.all()
    for i in range(n):
        end = np.searchsorted(size, size[i] * den // num, "right")
        at = np.arange(i + 1, end)
        at = at[(root[at] != root[i]) & ((other[at] != other[i]) | (not two))]
        if not len(at):
            continue
        own = rows[width[i]][place[i]]
        differ = np.zeros(len(at), np.int64)
        for w in np.unique(width[at]).tolist():
            some = width[at] == w
            those = (rows if w == width[i] else half)[w][place[at[some]]]
            differ[some] = np.bitwise_count(those ^ own).sum(axis=1, dtype=np.int64)
        both = size[at] + size[i]
        for j in at[(both - differ) * (num + den) >= 2 * num * both]:
            if root[i] != root[j] and overlap(sets[i], sets[j]) * (num + den) >= num * (len(sets[i]) + len(sets[j])):
                yield i, int(j)
                root[root == root[j]] = root[i]


class _Staged:
    """Staged tables by name; each is dropped when it is no longer needed."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        table, self.paths[name] = stage_table(df, name)
        return table

    def drop(self, *names: str) -> None:
        drop_table(self.spark, *[self.paths.pop(n) for n in names])


def similar_groups(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, tile_shingles: int = 1 << 22, block_sets: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    Two documents link when ``den * |intersection| >= num * |union|`` of their sets of ``words``-word
    shingles. component_id is the smallest id reachable by links. Null or wordless texts have an
    empty set and no links. Rows with one id are one document: they share its component. A row with
    a null id takes part in no link and has a null component. An empty table gives no rows.

    ``tile_shingles`` and ``block_sets`` bound what one task holds of a cluster and of a signature;
    what is larger is compared in blocks. They change no result.
    """
    keep = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    t = _Staged(docs.sparkSession)
    signed = t.put("signed", keep.mapInArrow(lean("jaccard", _signing(words, Bands(num, den))), "id long, n long, s1 long, s2 long, keys array<long>, bits binary"))
    sizes = t.put("sizes", signed.select("id", "n", "s1", "s2"))
    sets = signed.where("n > 0 and id is not null")
    # A set's name, s1, stands for it among signatures: equal sets have one. If different sets ever had, more would be compared.
    keyed = sets.select("s1", F.explode("keys").alias("key"))
    hubs = t.put("hubs", keyed.groupBy("key").agg(F.min("s1").alias("hub"), F.max("s1").alias("last")).where("hub <> last").select("key", "hub"))
    members = t.put("members", keyed.join(hubs.hint("shuffle_hash"), "key").where("s1 <> hub").select("key", "hub", "s1").distinct())
    stars = t.put("stars", members.select("hub", "s1").distinct())
    t.drop("hubs")
    named = stars.select("s1").unionAll(stars.select("hub")).distinct().hint("shuffle_hash")
    # Copies are collapsed before the join, so that many of them don't meet in one task.
    unique = sets.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.first("bits").alias("bits"))
    nodes = t.put("nodes", unique.join(named, "s1", "left_semi"))
    t.drop("signed")
    hub, other = (nodes.select(*[F.col(c).alias(f"{c}_{end}") for c in ("s1", "id", "n", "bits")]) for end in ("u", "v"))
    pairs = stars.join(hub, stars["hub"] == hub["s1_u"]).join(other, stars["s1"] == other["s1_v"]).select("id_u", "id_v", "n_u", "n_v", "bits_u", "bits_v")
    allowed = t.put("allowed", pairs.mapInArrow(_allowing(num, den), "u long, v long, n_u long, n_v long").distinct())
    t.drop("stars")
    blocks = t.put("blocks", allowed.groupBy("u").agg(F.ceil(F.sum("n_v") / F.lit(tile_shingles)).cast("int").alias("blocks"), F.sum("n_v").alias("all")))
    links = t.put("links", _star_links(keep, allowed, blocks, words, num, den, tile_shingles).distinct())
    t.drop("blocks")
    own = sizes.where("n > 0 and id is not null")
    reps = t.put("reps", own.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"))
    copies = t.put("copies", own.join(reps.hint("shuffle_hash"), ["n", "s1", "s2"]).where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v")).distinct())
    found, path = components(links.unionAll(copies))
    # What hangs on one signature, but isn't connected by its hub.
    labelled = nodes.select("id", "n", "s1", "bits").join(found, F.col("id") == F.col("node"), "left").select("id", "n", "s1", "bits", F.coalesce("component", "id").alias("label"))
    labelled = t.put("labelled", labelled)
    rest = members.join(labelled.select("s1", "label"), "s1").groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("hub").alias("hub")).where("low <> high")
    # The main component of a signature is its hub's.
    rest = t.put("rest", rest.join(labelled.select(F.col("s1").alias("hub"), F.col("label").alias("main")), "hub").groupBy("key").agg(F.min("main").alias("main")))
    t.drop("allowed", "nodes")
    if not rest.isEmpty():
        more = t.put("more", _cluster_links(keep, members, rest, labelled, words, num, den, tile_shingles, block_sets))
        drop_table(t.spark, path)
        found, path = components(links.unionAll(copies).unionAll(more))
        t.drop("more")
    t.drop("members", "labelled", "rest", "links", "copies", "reps")
    out, _ = stage_table(sizes.select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")), "groups")
    t.drop("sizes")
    drop_table(t.spark, path)
    return out


def _signing(words: int, bands: Bands):
    """Each text's set in short: size, two hashes of all of it, signatures and bitmap."""

    def sign(batches):
        for batch in batches:
            ids, out = batch.column(0), ([], [], [], [])
            lengths = []
            for s in shingle_sets(batch.column(1), words):
                keys = signatures(s, bands) if len(s) else np.empty(0, np.int64)
                out[0].append(len(s))
                out[1].append(np.concatenate([s[:0], [mix(s).sum(dtype=U64), mix(s ^ U64(77)).sum(dtype=U64)]]).astype(U64).view(np.int64))
                out[2].append(keys)
                out[3].append(bitmap(s))
                lengths.append(len(keys))
            if not len(ids):
                continue
            whole = np.array(out[1]).reshape(-1, 2)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out[2])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), keys, pa.array(out[3], pa.binary())], ["id", "n", "s1", "s2", "keys", "bits"])

    return sign


def _allowing(num: int, den: int):
    """Of pairs with their bitmaps, those that may link; a pair of one document is none."""

    def allow(batches):
        for batch in batches:
            u, v, n, m, a, b = (c.to_pylist() for c in batch.columns)
            ok = [k for k in range(len(u)) if u[k] != v[k] and may_link(a[k], b[k], n[k], m[k], num, den)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(ok, pa.int64())) for c in batch.columns[:4]], ["u", "v", "n_u", "n_v"])

    return allow


def _shingled(keep: DataFrame, placed: DataFrame, words: int, columns: list[str]) -> DataFrame:
    """The shingles of the documents in ``placed`` (node, and other columns), as bytes."""
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in columns)

    def shingle(batches):
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.binary())], [*columns, "shingles"])

    # The side with the few ids is hashed, so the texts aren't sorted.
    texts = keep.join(placed.hint("shuffle_hash"), keep["id"] == placed["node"]).select(*columns, "text")
    return texts.mapInArrow(lean("jaccard", shingle), f"{kinds}, shingles binary")


def _star_links(keep: DataFrame, allowed: DataFrame, blocks: DataFrame, words: int, num: int, den: int, tile_shingles: int) -> DataFrame:
    """Links (u, v) among the pairs of hubs u and others v: each hub's others lie in its ``blocks``, and it is in each of them."""
    total = blocks.agg(F.sum("all")).first()[0] or 0
    buckets = max(1, -(-4 * total // tile_shingles))
    # Small hubs share a task.
    bucket = F.when(F.col("blocks") > 1, F.col("u")).otherwise(F.pmod(F.xxhash64("u"), F.lit(buckets)))
    hubs = blocks.select(F.col("u").alias("node"), F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("u").alias("hub"), bucket.alias("bucket"), (F.col("blocks") > 1).alias("alone"), k.alias("block")))).alias("tile"))
    block = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    others = allowed.join(blocks.hint("shuffle_hash"), "u").select(F.col("v").alias("node"), F.struct(F.col("u").alias("hub"), bucket.alias("bucket"), (F.col("blocks") > 1).alias("alone"), block.alias("block")).alias("tile"))
    placed = hubs.unionAll(others).groupBy("node").agg(F.collect_list("tile").alias("tiles"))
    rows = _shingled(keep, placed, words, ["node", "tiles"]).select("node", F.explode("tiles").alias("tile"), "shingles").select("node", "tile.*", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        node, hub = table.column("node").to_numpy(), table.column("hub").to_numpy()
        sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        of: dict[int, list[int]] = {}
        for i in np.flatnonzero(node == hub):
            of.setdefault(int(hub[i]), []).append(int(i))
        found = [i for i in np.flatnonzero(node != hub) if any(linked(sets[h], sets[i], num, den) for h in of.get(int(hub[i]), ()))]
        return pa.table({"u": hub[found], "v": node[found]})

    return rows.groupBy("alone", "bucket", "block").applyInArrow(compare, "u long, v long")


def _cluster_links(keep: DataFrame, members: DataFrame, rest: DataFrame, labelled: DataFrame, words: int, num: int, den: int, tile_shingles: int, block_sets: int) -> DataFrame:
    """Links (u, v) that connect what the hubs have left apart: in signatures of several components, by clusters."""
    spark = keep.sparkSession
    t = _Staged(spark)
    some = t.put("apart", members.select("key", "s1").join(rest.hint("shuffle_hash"), "key"))
    # No two sets of the main component need be compared.
    some = some.join(labelled, "s1").select("key", "id", "n", "bits", "label", (F.col("label") == F.col("main")).alias("is_main"))
    some = t.put("ties", some)
    counts = some.groupBy("key", "is_main").agg(F.count("*").alias("sets"))
    blocks = t.put("blocks", counts.groupBy("key").agg(*[F.ceil(F.coalesce(F.max(F.when(F.col("is_main") == m, F.col("sets"))), F.lit(0)) / F.lit(block_sets)).cast("int").alias(c) for m, c in ((True, "mains"), (False, "odds"))]))
    small = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-some.count() // block_sets))))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("odds"))).cast("int")
    alone = (F.col("mains") > 1) | (F.col("odds") > 1)

    def tile(kind, a, b, left):
        return F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), left.cast("int").alias("left"))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    odd = F.concat(F.transform(upto(F.col("odds")), lambda k: tile(0, F.least(k, F.col("own")), F.greatest(k, F.col("own")), k < F.col("own"))), F.transform(upto(F.col("mains")), lambda k: tile(1, F.col("own"), k, F.lit(0))))
    tiles = F.when(~alone, F.array(tile(2, F.lit(0), F.lit(0), F.lit(0)))).when(F.col("is_main"), F.transform(upto(F.col("odds")), lambda k: tile(1, k, F.col("own"), F.lit(1)))).otherwise(odd)
    placed = some.join(blocks.hint("shuffle_hash"), "key").withColumn("own", own).select("key", "id", "n", "bits", "label", F.when(alone, F.col("key")).otherwise(small).alias("bucket"), F.explode(tiles).alias("tile")).select("key", "id", "n", "bits", "label", "bucket", "tile.*")

    def tie(table: pa.Table) -> pa.Table:
        key, ids, n, label, left = (table.column(c).to_numpy() for c in ("key", "id", "n", "label", "left"))
        bits = table.column("bits").to_pylist()
        order = np.argsort(key, kind="stable")
        borders = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
        out = [(ids[at[i]], ids[at[j]]) for a, b in zip(borders[:-1], borders[1:]) for at in [order[a:b]] for i, j in tied(n[at], [bits[k] for k in at], label[at], left[at], num, den)]
        edges = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"u": edges[:, 0].copy(), "v": edges[:, 1].copy()})

    ties = t.put("tied", placed.groupBy("kind", "bucket", "a", "b").applyInArrow(tie, "u long, v long").distinct())
    # Sets of one component hang together too, where one of them is tied to another component's.
    ends = ties.select(F.col("u").alias("id")).unionAll(ties.select(F.col("v").alias("id"))).distinct()
    touched = some.select("id", "label").distinct()
    hang = touched.join(touched.join(ends, "id", "left_semi").select("label").distinct(), "label", "left_semi").where("id <> label").select(F.col("label").alias("u"), F.col("id").alias("v"))
    near, path = components(ties.unionAll(hang))
    sized = near.join(some.groupBy("id").agg(F.max("n").alias("n"), F.min("label").alias("label")), F.col("node") == F.col("id")).select("node", "component", "n", "label")
    sized = t.put("clusters", sized)
    drop_table(spark, path)
    t.drop("apart", "ties", "tied", "blocks")
    links = t.put("found", _verified(t, keep, sized, words, num, den, tile_shingles))
    t.drop("clusters", "whole", "sized", "cut")
    return links


def _verified(t: _Staged, keep: DataFrame, near: DataFrame, words: int, num: int, den: int, tile_shingles: int) -> DataFrame:
    """Links (u, v) that connect labels within the clusters ``near`` (node, component, n, label), by tiles of size bands."""
    ratio = float(np.log(den / num)) * 1.0001  # a little wider than need be, against rounding
    labels = near.groupBy("component", "label").agg(F.sum("n").alias("words"), F.count("*").alias("sets"))
    whole = t.put("whole", labels.groupBy("component").agg(F.max_by("label", "words").alias("main"), F.sum("words").alias("total"), F.count("*").alias("labels")).where("labels > 1").select("component", "main", "total"))
    sized = near.join(whole.hint("shuffle_hash"), "component").withColumns({"band": F.when(F.col("total") <= tile_shingles, 0).otherwise(F.floor(F.log("n") / F.lit(ratio))).cast("int"), "odd": F.when(F.col("total") <= tile_shingles, 1).otherwise((F.col("label") != F.col("main")).cast("int"))})
    sized = t.put("sized", sized)
    # A cluster that fits a tile is one block. Of a larger one each band's odd and main sets are cut into blocks.
    cut = sized.groupBy("component", "band", "odd").agg(F.ceil(F.sum("n") / F.when(F.max("total") <= tile_shingles, tile_shingles).otherwise(max(1, tile_shingles // 2))).cast("int").alias("blocks"))
    cut = t.put("cut", cut.groupBy("component").agg(F.collect_list(F.struct("band", "odd", "blocks")).alias("cut")))  # a few for each band
    cut = sized.join(cut.hint("shuffle_hash"), "component")
    mine = F.filter("cut", lambda c: (c["band"] == F.col("band")) & (c["odd"] == F.col("odd")))[0]["blocks"]
    cut = cut.withColumn("own", F.struct(F.col("band").alias("band"), F.col("odd").alias("odd"), F.pmod(F.xxhash64("node"), mine).cast("int").alias("k")))
    near_by = F.filter("cut", lambda c: (F.abs(c["band"] - F.col("band")) <= 1) & (c["odd"] + F.col("odd") > 0))
    those = F.flatten(F.transform(near_by, lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda k: F.struct(c["band"].alias("band"), c["odd"].alias("odd"), k.alias("k")))))
    tiles = F.transform(those, lambda x: F.struct(F.least(x, F.col("own")).alias("a"), F.greatest(x, F.col("own")).alias("b"), (x < F.col("own")).cast("int").alias("left")))
    placed = cut.select("node", "component", "label", tiles.alias("tiles"))
    rows = _shingled(keep, placed, words, ["node", "component", "label", "tiles"])
    rows = rows.select("node", "component", "label", F.explode("tiles").alias("tile"), "shingles").select("node", "component", "label", "tile.*", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        order = np.argsort([len(s) for s in sets], kind="stable")
        node, label, left = (table.column(c).to_numpy()[order] for c in ("node", "label", "left"))
        pairs = np.array(list(linked_pairs([sets[i] for i in order], label, left, num, den)), np.int64).reshape(-1, 2)
        return pa.table({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]})

    return rows.groupBy("component", "a", "b").applyInArrow(compare, "u long, v long")
