"""The table's query catalogue over the driver's tables, each with its SQL.

The log is derived from ``events``: a key per user, one version per event, errors delete.
Keys and values are text here, so that both engines show them alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.entries import row_checksum
from sedimenta.operators import compact as policy
from sedimenta.operators import read as ops
from sedimenta.operators.resolve import deleted, latest, merge_by_priority, merge_prefer_left
from sedimenta.options import Options
from sedimenta.plans.log import UNBOUNDED, Bound
from sedimenta.sources.hfs import Hfs, shared_dir
from sedimenta.sources.manifest import RunEntry, prune_df, replay
from sedimenta.sources.runs import read_runs, run_stats
from sedimenta.sources.wal import Wal
from sedimenta.store import Store
from sedimenta.streaming.ingest import write_stream

LOW, HIGH = "00000010", "00000020"


def kvlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value, is_tombstone, seq, ord, run) from ``events``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_type") == "error"
    value = F.when(~gone | gone.isNull(), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")))
    return e.select(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"), value.alias("value"), F.coalesce(gone, F.lit(False)).alias("is_tombstone"), F.col("event_id").alias("seq"), F.lit(0).alias("ord"), F.floor(F.col("event_id") / 2500).cast("long").alias("run"))


def _kv(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def _scan(lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED):
    return lambda spark, sf_dir: _kv(ops.scan(kvlog(spark, sf_dir), lower, upper))


def scan_empty_range(spark, sf_dir):
    return ops.scan(kvlog(spark, sf_dir), Bound.excluded("00000010"), Bound.excluded("00000011"), ordered=False).agg(F.count("*").alias("n"))


def scan_reverse_limit(spark, sf_dir):
    return _kv(ops.scan(kvlog(spark, sf_dir), limit=7, reverse=True))


def _get(key: str):
    return lambda spark, sf_dir: _kv(ops.get(kvlog(spark, sf_dir), key))


def multi_get(spark, sf_dir):
    keys = spark.sql("select * from values ('00000000'), ('00000001'), ('00000008'), ('99999999') as t(key)")
    return _kv(ops.multi_get(kvlog(spark, sf_dir), keys))


def _orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))


def _writes(df: DataFrame, value, seq: int, ord_=0) -> DataFrame:
    return df.select("key", value.alias("value"), value.isNull().alias("is_tombstone"), F.lit(seq).cast("long").alias("seq"), (F.lit(ord_) if isinstance(ord_, int) else ord_).cast("int").alias("ord"))


def put_overwrite(spark, sf_dir):
    """All orders, then new values for those with status F."""
    o = _orders(spark, sf_dir)
    return _kv(ops.scan(_writes(o, F.col("priority"), 1).unionAll(_writes(o.where("status = 'F'"), F.lit("changed"), 2)), ordered=False))


def delete_hides(spark, sf_dir):
    """All orders, then deletes of those with status P, and of a key that was never there."""
    o = _orders(spark, sf_dir)
    gone = o.where("status = 'P'").select("key").unionAll(spark.sql("select 'none' as key"))
    return _kv(ops.scan(_writes(o, F.col("priority"), 1).unionAll(_writes(gone, F.lit(None).cast("string"), 2)), ordered=False))


def batch_put_latest(spark, sf_dir):
    """One batch in which most keys (customers) occur several times: the last counts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("key"), F.col("o_orderkey").cast("string").alias("value"), F.lit(False).alias("is_tombstone"), F.lit(1).cast("long").alias("seq"), F.col("o_orderkey").cast("int").alias("ord"))
    return _kv(ops.scan(rows, ordered=False))


def tombstone_filter(spark, sf_dir):
    return deleted(kvlog(spark, sf_dir)).select(F.col("key").alias("k"))


def _store(spark, **options) -> Store:
    return Store.open(spark, Options(root=f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", **options))


def _loaded(spark, sf_dir, batches: int = 4, **options) -> Store:
    """A table whose level 0 has the log in ``batches`` writes, in the order of its sequence numbers."""
    store, log = _store(spark, **options), kvlog(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0] or 0
    step = last // batches + 1
    for i in range(batches):
        store.write_df(log.where((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step)).select("key", "value", "seq"), order_by="seq")
    return store


def _with_deletes(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), F.col("is_tombstone").alias("deleted"))


def flush_run(spark, sf_dir):
    """The log written as one run: newest versions, tombstones kept."""
    return _with_deletes(_loaded(spark, sf_dir, 1).log())


def sync_run(spark, sf_dir):
    """Puts and deletes through the buffer and its log, then one run."""
    store = _store(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    store.batch_put([(f"{r['n_nationkey']:04d}".encode(), r["n_name"].encode()) for r in nation])
    store.batch_put([(f"{r['n_nationkey']:04d}".encode(), None) for r in nation if r["n_regionkey"] == 1])
    store.sync()
    return _with_deletes(store.log())


def compact_run(spark, sf_dir):
    """Four level 0 writes merged into level 1, tombstones kept."""
    store = _loaded(spark, sf_dir)
    store.compact(0)
    return _with_deletes(store.log())


def compact_is_invisible(spark, sf_dir):
    """What a scan shows after two compactions."""
    store = _loaded(spark, sf_dir)
    store.compact(0)
    store.compact(1)
    return _kv(store.scan())


def store_scan_range(spark, sf_dir):
    """A range of a table with compacted and fresh runs."""
    store = _loaded(spark, sf_dir, 3)
    store.compact(0)
    store.write_df(kvlog(spark, sf_dir).where("false").select("key", "value"))
    return _kv(store.scan(Bound.excluded(LOW.encode()), Bound.included(HIGH.encode())))


def store_multi_get(spark, sf_dir):
    """Every key of the table, and one beside each that was never there."""
    keys = kvlog(spark, sf_dir).select(F.col("key").cast("binary").alias("key")).distinct()
    asked = keys.unionAll(keys.select(F.concat(F.col("key"), F.lit(b"?")).alias("key")))
    return _kv(_loaded(spark, sf_dir, 2).multi_get(asked))


def store_channel(spark, sf_dir):
    """Puts through the channel, each acknowledged, then deletes; read from the buffer alone."""
    store = _store(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    acks = [store.put_to_channel([(f"{r['n_nationkey']:04d}".encode(), r["n_name"].encode())]) for r in nation]
    if {a.result(60) for a in acks} != set(range(1, len(nation) + 1)):
        raise RuntimeError("a request has no version of its own")
    for r in nation:
        if r["n_regionkey"] == 1:
            store.delete(f"{r['n_nationkey']:04d}".encode())
    return _kv(store.scan())


def merge_k_way(spark, sf_dir):
    """The newest version of each run's keys, merged newest run first."""
    log = kvlog(spark, sf_dir)
    runs = [log.where(F.col("run") % 4 == i) for i in range(4)]
    return _with_deletes(merge_by_priority([latest(r).drop("seq", "ord") for r in reversed(runs)]))


def merge_two_prefer_a(spark, sf_dir):
    log = kvlog(spark, sf_dir)
    half = [latest(log.where(F.col("run") % 2 == i)).drop("seq", "ord") for i in (0, 1)]
    return _with_deletes(merge_prefer_left(*half))


def run_scan(spark, sf_dir):
    """Every run's scan: the newest version of each of its keys, with the run's number."""
    log = kvlog(spark, sf_dir)
    newest = latest(log.withColumn("key", F.struct("run", "key"))).select("key.run", "key.key", "value", "is_tombstone")
    return newest.orderBy("run", "key").select("run", F.col("key").alias("k"), F.col("value").alias("v"), F.col("is_tombstone").alias("deleted"))


def run_statistics(spark, sf_dir):
    return run_stats(kvlog(spark, sf_dir), "run").select("run", "min_key", "max_key", "entries", "bytes")


def _tables(spark, sf_dir):
    return kvlog(spark, sf_dir).groupBy("run", F.substring("key", 1, 7).alias("b")).agg(F.min("key").alias("mn"), F.max("key").alias("mx"))


PRUNE_LOW, PRUNE_HIGH = "00000035", "00000052"


def _entries(tables: DataFrame, level) -> list[RunEntry]:
    """Manifest entries of the table ranges (run, b, mn, mx) of a few runs, which have 2500 events each."""
    return [RunEntry(f"{r['run']}:{r['b']}", level(r), "", r["mn"].encode(), r["mx"].encode(), 1, 1, r["run"], r["run"]) for r in tables.collect()]


def run_prune(spark, sf_dir):
    """The runs that the manifest's filter leaves for a key range, of those that a table has: as many as the log makes, so executors hold them."""
    manifest = _store(spark).manifest
    one, key = F.lit(1).cast("long"), lambda c: F.col(c).cast("binary")
    # Events without a user have no key, and a run without a key range isn't one.
    entries = _tables(spark, sf_dir).where("mn is not null").select(F.concat_ws(":", "run", "b").alias("id"), F.lit(0).alias("level"), F.lit("").alias("path"), key("mn").alias("min_key"), key("mx").alias("max_key"), one.alias("rows"), one.alias("bytes"), F.col("run").alias("min_seq"), F.col("run").alias("max_seq"), F.lit(None).cast("long").alias("crc"))
    manifest.commit_df(manifest.load(), entries)
    kept = prune_df(manifest.frame(spark), Bound.included(PRUNE_LOW.encode()), Bound.included(PRUNE_HIGH.encode()))
    text = lambda c: F.col(c).cast("string")
    return kept.select(F.col("min_seq").alias("run"), F.substring_index("id", ":", -1).alias("b"), text("min_key").alias("mn"), text("max_key").alias("mx"))


def _keys(spark, sf_dir):
    return kvlog(spark, sf_dir).select("key").distinct()


def seek_lower_bound(spark, sf_dir):
    keys = _keys(spark, sf_dir)
    probes = keys.select(F.concat("key", F.lit("!")).alias("probe"))
    return ops.seek(keys, probes).where("key is not null").select("probe", F.col("key").alias("k"))


def block_index_asof(spark, sf_dir):
    """The block of every key; every seventh key or so begins one."""
    keys = _keys(spark, sf_dir)
    index = keys.where(F.col("key").cast("long") % 7 == 3)
    return ops.floor_index(index, keys.select(F.col("key").alias("probe"))).select("probe", F.col("key").alias("first_key"))


def _changes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", "delete").otherwise("create").alias("op"), (F.col("event_id") % 6).cast("int").alias("level"))


def manifest_replay(spark, sf_dir):
    return replay(_changes(spark, sf_dir))


def level_scores(spark, sf_dir):
    tables = replay(_changes(spark, sf_dir)).select("level", ((F.col("id") + 1) * 1000).alias("bytes"))
    return policy.level_scores(tables, 100_000, 50_000, 10, 6)


def compact_inputs(spark, sf_dir):
    """Level 0 (the tables of run 0 below a key) and what it overlaps in level 1 (those of run 1), as compaction picks them."""
    tables = _tables(spark, sf_dir).where("run = 1 or (run = 0 and mn <= '00000050')")
    runs = _entries(tables, lambda r: r["run"])
    inputs = policy.pick_inputs(runs, 0)
    rows = [(r.level, r.min_key.decode(), r.max_key.decode()) for r in (*inputs.upper, *inputs.lower)] if inputs else []
    return spark.createDataFrame(rows, "level long, mn string, mx string")


def wal_replay(spark, sf_dir):
    """The log written to a write-ahead log and read back from its segments, both by the executors."""
    wal = Wal(Hfs(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"))
    if not wal.append_df(kvlog(spark, sf_dir).withColumn("seq", F.col("seq") + 1), 20_000):
        raise RuntimeError("the log isn't new")
    log = wal.frame(spark)
    return log.orderBy("seq", "ord").select((F.col("seq") - 1).alias("seq"), F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def bloom_no_false_negative(spark, sf_dir):
    """Every key of a run with Bloom filters, looked up by equality."""
    store = _loaded(spark, sf_dir, 1, false_positive_rate=0.01)
    keys = read_runs(spark, [r.path for r in store.snapshot().runs]).select("key")
    return _kv(store.multi_get(keys)).where("v is not null")


def _codec(name: str):
    return lambda spark, sf_dir: _kv(_loaded(spark, sf_dir, 1, compression=name).scan())


def stream_group_commit(spark, sf_dir):
    """The log streamed in four files, one micro-batch each, and read back."""
    root, log = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", kvlog(spark, sf_dir).select("key", "value", "seq")
    last = log.agg(F.max("seq")).first()[0] or 0
    for i in range(4):
        log.where((F.col("seq") >= i * (last // 4 + 1)) & (F.col("seq") < (i + 1) * (last // 4 + 1))).coalesce(1).write.mode("append").parquet(f"{root}/in")
    store = Store.open(spark, Options(root=f"{root}/table"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = write_stream(source, store, "events", f"{root}/check", order_by="seq")
    query.awaitTermination()
    return _kv(store.scan())


def checksum_rows(spark, sf_dir):
    return kvlog(spark, sf_dir).select("seq", row_checksum().alias("crc"))


QUERIES = {
    "scan_full": _scan(),
    "scan_incl_incl": _scan(Bound.included(LOW), Bound.included(HIGH)),
    "scan_incl_excl": _scan(Bound.included(LOW), Bound.excluded(HIGH)),
    "scan_excl_incl": _scan(Bound.excluded(LOW), Bound.included(HIGH)),
    "scan_excl_excl": _scan(Bound.excluded(LOW), Bound.excluded(HIGH)),
    "scan_from": _scan(Bound.included("00000100")),
    "scan_to": _scan(UNBOUNDED, Bound.excluded(HIGH)),
    "scan_empty_range": scan_empty_range,
    "scan_reverse_limit": scan_reverse_limit,
    "get_hit": _get("00000000"),
    "get_miss": _get("99999999"),
    "get_deleted": _get("00000008"),
    "multi_get": multi_get,
    "put_overwrite": put_overwrite,
    "delete_hides": delete_hides,
    "batch_put_latest": batch_put_latest,
    "tombstone_filter": tombstone_filter,
    "flush_run": flush_run,
    "sync_run": sync_run,
    "compact_run": compact_run,
    "compact_is_invisible": compact_is_invisible,
    "store_scan_range": store_scan_range,
    "store_multi_get": store_multi_get,
    "store_channel": store_channel,
    "merge_k_way": merge_k_way,
    "merge_two_prefer_a": merge_two_prefer_a,
    "run_scan": run_scan,
    "run_stats": run_statistics,
    "run_prune": run_prune,
    "seek_lower_bound": seek_lower_bound,
    "block_index_asof": block_index_asof,
    "manifest_replay": manifest_replay,
    "level_scores": level_scores,
    "compact_inputs": compact_inputs,
    "wal_replay": wal_replay,
    "bloom_no_false_negative": bloom_no_false_negative,
    "codec_none": _codec("none"),
    "codec_snappy": _codec("snappy"),
    "codec_lz4": _codec("lz4_raw"),
    "stream_group_commit": stream_group_commit,
    "checksum_rows": checksum_rows,
}

_LOG = """with kvlog as (
    select lpad(cast(user_id as varchar), 8, '0') as k,
           case when event_type = 'error' then '' else concat(event_type, ':', cast(event_id as varchar)) end as v,
           event_id as seq, cast(floor(event_id / 2500) as bigint) as run from events),
newest as (select k, v, run from (select *, row_number() over (partition by k order by seq desc) as rn from kvlog) where rn = 1),
vis as (select k, v from newest where v <> ''),
kept as (select k, nullif(v, '') as v, v = '' as deleted from newest),
tables as (select run, substr(k, 1, 7) as b, min(k) as mn, max(k) as mx from kvlog group by 1, 2),
keys as (select distinct k from kvlog),
live as (
    select id, level from (
        select user_id as id, event_type, cast(event_id % 6 as integer) as level, row_number() over (partition by user_id order by event_id desc) as rn from events)
    where rn = 1 and event_type <> 'error')
"""
_VIS = _LOG + "select k, v from vis"
_KEPT = _LOG + "select k, v, deleted from kept"
_PER_RUN = "(select k, v, run, row_number() over (partition by k, run % {n} order by seq desc) as rn from kvlog)"
_ORDERS = "orders_log as (select lpad(cast(o_orderkey as varchar), 10, '0') as k, o_orderstatus as status, o_orderpriority as v from orders)"

ORACLES = {
    "scan_full": _VIS,
    "scan_incl_incl": _VIS + f" where k >= '{LOW}' and k <= '{HIGH}'",
    "scan_incl_excl": _VIS + f" where k >= '{LOW}' and k < '{HIGH}'",
    "scan_excl_incl": _VIS + f" where k > '{LOW}' and k <= '{HIGH}'",
    "scan_excl_excl": _VIS + f" where k > '{LOW}' and k < '{HIGH}'",
    "scan_from": _VIS + " where k >= '00000100'",
    "scan_to": _VIS + f" where k < '{HIGH}'",
    "scan_empty_range": _LOG + "select count(*) as n from vis where k > '00000010' and k < '00000011'",
    "scan_reverse_limit": _VIS + " order by k desc limit 7",
    "get_hit": _VIS + " where k = '00000000'",
    "get_miss": _VIS + " where k = '99999999'",
    "get_deleted": _VIS + " where k = '00000008'",
    "multi_get": _LOG + "select p.k, vis.v from (values ('00000000'), ('00000001'), ('00000008'), ('99999999')) p(k) left join vis on p.k = vis.k",
    "put_overwrite": f"with {_ORDERS} select k, case when status = 'F' then 'changed' else v end as v from orders_log",
    "delete_hides": f"with {_ORDERS} select k, v from orders_log where status <> 'P'",
    "batch_put_latest": "select lpad(cast(o_custkey as varchar), 8, '0') as k, cast(max(o_orderkey) as varchar) as v from orders group by o_custkey",
    "tombstone_filter": _LOG + "select k from kept where deleted",
    "flush_run": _KEPT,
    "sync_run": "select lpad(cast(n_nationkey as varchar), 4, '0') as k, case when n_regionkey = 1 then null else n_name end as v, n_regionkey = 1 as deleted from nation",
    "compact_run": _KEPT,
    "compact_is_invisible": _VIS,
    "store_scan_range": _VIS + f" where k > '{LOW}' and k <= '{HIGH}'",
    "store_multi_get": _LOG + "select keys.k, vis.v from keys left join vis on keys.k = vis.k union all select k || '?', null from keys",
    "store_channel": "select lpad(cast(n_nationkey as varchar), 4, '0') as k, n_name as v from nation where n_regionkey <> 1",
    "merge_k_way": _LOG + f"select k, nullif(v, '') as v, v = '' as deleted from (select *, row_number() over (partition by k order by run % 4 desc) as best from {_PER_RUN.format(n=4)} where rn = 1) where best = 1",
    "merge_two_prefer_a": _LOG + f"select k, nullif(v, '') as v, v = '' as deleted from (select *, row_number() over (partition by k order by run % 2) as best from {_PER_RUN.format(n=2)} where rn = 1) where best = 1",
    "run_scan": _LOG + "select run, k, nullif(v, '') as v, v = '' as deleted from (select *, row_number() over (partition by run, k order by seq desc) as rn from kvlog) where rn = 1",
    "run_stats": _LOG + "select run, min(k) as min_key, max(k) as max_key, count(*) as entries, cast(sum(octet_length(encode(k)) + octet_length(encode(v)) + 4) as bigint) as bytes from kvlog group by run",
    "run_prune": _LOG + "select run, b, mn, mx from tables where mx >= '00000035' and mn <= '00000052'",
    "seek_lower_bound": _LOG + "select p.k || '!' as probe, min(t.k) as k from keys p join keys t on t.k >= p.k || '!' group by 1",
    "block_index_asof": _LOG + "select p.k as probe, coalesce(max(i.k), (select min(k) from keys where cast(k as bigint) % 7 = 3)) as first_key from keys p left join (select k from keys where cast(k as bigint) % 7 = 3) i on i.k <= p.k group by p.k",
    "manifest_replay": _LOG + "select id, level from live",
    "level_scores": _LOG + "select *, score > 1 as due from (select level, files, bytes, greatest(bytes / (100000.0::double * power(10.0::double, level)), files / power(2.0::double, level + 1)) as score from (select level, count(*) as files, cast(sum((id + 1) * 1000) as bigint) as bytes from live where level < 5 group by level))",
    "compact_inputs": _LOG + ", upper0 as (select run, mn, mx from tables where run = 0 and mn <= '00000050') select run as level, mn, mx from upper0 union all select t.run, t.mn, t.mx from tables t where t.run = 1 and exists (select 1 from upper0 u where t.mx >= u.mn and t.mn <= u.mx)",
    "wal_replay": _LOG + "select seq, k, nullif(v, '') as v from kvlog",
    "bloom_no_false_negative": _VIS,
    "codec_none": _VIS,
    "codec_snappy": _VIS,
    "codec_lz4": _VIS,
    "stream_group_commit": _VIS,
    # CRC-32 by its definition: a table of 256 remainders, a byte at a time. Keys and values are ASCII.
    "checksum_rows": _LOG + """, crc_table as (
        select list(list_reduce(list_concat([i], range(8)), lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
    bytes as (select seq, concat(k, ':', cast(octet_length(encode(k)) as varchar), ':', v) as s from kvlog)
    select seq, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(s) + 1), lambda i: cast(ord(substr(s, i, 1)) as bigint))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as crc
    from bytes, crc_table""",
}
