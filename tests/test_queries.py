"""Every query of the table against its SQL, and the driver's contract."""

import duckdb
import pytest

from sedimenta.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("nation", "orders", "events"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_checksums_are_crc_32(spark, sf):
    import zlib

    from sedimenta.queries import kvlog

    rows = {r["seq"]: (r["key"], r["value"] or "") for r in kvlog(spark, sf).collect()}
    got = QUERIES["checksum_rows"](spark, sf).collect()
    assert len(got) == len(rows) and all(r["crc"] == zlib.crc32(f"{k}:{len(k)}:{v}".encode()) for r in got for k, v in [rows[r["seq"]]])


def test_contract(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 12


def test_whole_table_scans_and_probes(spark):
    """Every run and every key, by brute force; sf0.01 has four runs."""
    sf = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{sf}/events.parquet").collect()
    newest = {}
    for e in sorted(events, key=lambda e: e["event_id"]):
        gone = e["event_type"] == "error"
        newest[e["event_id"] // 2500, f"{e['user_id']:08d}"] = (None if gone else f"{e['event_type']}:{e['event_id']}", gone)
    got = QUERIES["run_scan"](spark, sf).collect()
    assert len({run for run, _ in newest}) == 4
    assert [(r["run"], r["k"], r["v"], r["deleted"]) for r in got] == [(*k, *v) for k, v in sorted(newest.items())]
    keys = sorted({k for _, k in newest})
    index = [k for k in keys if int(k) % 7 == 3]
    got = QUERIES["block_index_asof"](spark, sf).collect()
    assert sorted((r["probe"], r["first_key"]) for r in got) == [(k, max((i for i in index if i <= k), default=index[0])) for k in keys]


@pytest.fixture()
def sent(spark, monkeypatch):
    """Counts the rows that DataFrames bring to the driver."""
    rows, frame = [0], type(spark.range(0))
    for name in ("collect", "toLocalIterator"):

        def counted(self, *a, f=getattr(frame, name), **b):
            got = list(f(self, *a, **b))
            rows[0] += len(got)
            return got if f.__name__ == "collect" else iter(got)

        monkeypatch.setattr(frame, name, counted)
    return rows


def test_a_manifest_of_many_runs_is_pruned_by_the_executors(spark, sent):
    kept = QUERIES["run_prune"](spark, "/root/testdata/sf0.01")
    assert sent[0] <= 10  # of 60 runs
    assert kept.count() == 12


def test_a_large_log_is_written_by_the_executors(spark, sent):
    log = QUERIES["wal_replay"](spark, "/root/testdata/sf0.01")
    assert sent[0] <= 10  # of 10,000 rows
    assert [r["seq"] for r in log.select("seq").collect()] == list(range(10_000))
