"""Pure operators: merges, bounds, seeks, compaction policy, formats."""

import pytest
from pyspark.sql import functions as F

from sedimenta.functions.bloom import KeyFilter
from sedimenta.functions.entries import decode_entries, encode_entry, frame, frames
from sedimenta.operators import compact as policy
from sedimenta.operators import read as ops
from sedimenta.operators.resolve import latest, merge_by_priority, merge_prefer_left, visible
from sedimenta.options import Options
from sedimenta.sources.manifest import RunEntry, prune
from sedimenta.plans.log import UNBOUNDED, Bound


def frame_of(spark, d):
    return spark.createDataFrame(list(d.items()), "key string, value string")


def rows(df):
    return sorted((r["key"], r["value"]) for r in df.collect())


I1, I2, I3 = dict(a="1.1", b="2.1", c="3.1"), dict(a="1.2", b="2.2", c="3.2", d="4.2"), dict(b="2.3", c="3.3", d="4.3")


@pytest.mark.parametrize("order", [(I1, I2, I3), (I3, I1, I2)])
def test_k_way_merge(spark, order):
    want = {}
    for d in reversed(order):
        want |= d
    assert rows(merge_by_priority([frame_of(spark, d) for d in order])) == sorted(want.items())


def test_two_way_merge_prefers_the_first(spark):
    assert rows(merge_prefer_left(frame_of(spark, I1), frame_of(spark, I2))) == sorted((I2 | I1).items())


def test_resolution_orders_by_seq_then_ord(spark):
    log = spark.createDataFrame([("a", "x", False, 1, 0), ("a", "y", False, 1, 1), ("b", "x", False, 2, 0), ("b", None, True, 3, 0), ("c", None, True, 1, 0), ("c", "z", False, 2, 0)], "key string, value string, is_tombstone boolean, seq long, ord int")
    assert rows(visible(log)) == [("a", "y"), ("c", "z")]
    assert latest(log).count() == 3


def test_seek_and_floor_match_a_plain_search(spark):
    keys = [f"key_{i * 5:03d}" for i in range(100)]
    probes = [f"key_{i * 5 + o:03d}" for i in range(0, 100, 7) for o in range(1, 6)] + ["k", "z"]
    run = spark.createDataFrame([(k,) for k in keys], "key string")
    asked = spark.createDataFrame([(p,) for p in set(probes)], "probe string")
    assert {r["probe"]: r["key"] for r in ops.seek(run, asked).collect()} == {p: min((k for k in keys if k >= p), default=None) for p in probes}
    assert {r["probe"]: r["key"] for r in ops.floor_index(run, asked).collect()} == {p: max((k for k in keys if k <= p), default=keys[0]) for p in probes}


def test_seek_and_floor_at_a_million_keys(spark):
    n = 1_000_000
    keys = spark.range(n).select(F.lpad((F.col("id") * 7).cast("string"), 9, "0").alias("key"))
    probes = spark.range(0, 7 * n + 20, 23).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("probe"))
    number = F.col("probe").cast("long")
    up, down = F.ceil(number / 7) * 7, F.least(F.floor(number / 7) * 7, F.lit(7 * (n - 1)))
    wrong = ops.seek(keys, probes).where(~F.col("key").cast("long").eqNullSafe(F.when(up <= 7 * (n - 1), up)))
    assert wrong.count() == 0 and ops.seek(keys, probes).count() == probes.count()
    assert ops.floor_index(keys, probes).where(~F.col("key").cast("long").eqNullSafe(down)).count() == 0
    empty = keys.limit(0)
    assert ops.seek(empty, probes.limit(5)).where("key is null").count() == 5 and ops.seek(keys, probes.limit(0)).count() == 0


def test_ranges_cover_everything():
    planned = policy.plan_ranges([(b"00", b"50"), (b"20", b"70"), (b"40", b"90")])
    assert planned[0][0] == b"00" and planned[-1][1] == b"90" and all(a[1] == b[0] for a, b in zip(planned, planned[1:]))
    assert policy.split_ranges([(b"001", b"002", 10), (b"002", b"003", 10), (b"003", b"004", 20), (b"004", b"005", 14)], 4) == [(b"001", b"003", False), (b"003", b"004", False), (b"004", b"005", True)]
    assert policy.split_ranges([(b"a", b"b", 0), (b"b", b"c", 0)], 4) == [(b"a", b"c", True)]


def entry(i, level, low, high, size=10, seq=1):
    return RunEntry(i, level, "p", low, high, 1, size, seq, seq)


def test_a_group_is_cut_by_key_range_and_nothing_is_left_out():
    group = [entry(str(i), i % 2, f"{3 * i:03d}".encode(), f"{3 * i + 10:03d}".encode(), size=100 + i) for i in range(30)]
    for parts in (1, 3, 4, 100):
        got = policy.sub_ranges(group, parts)
        assert got[0][0] == b"000" and got[-1][1:] == (b"097", True) and all(a[1] == b[0] and not a[2] for a, b in zip(got, got[1:]))
        assert len(got) <= parts + 1 or parts == 100
    assert policy.sub_ranges([entry("a", 0, b"k", b"k")], 4) == [(b"k", b"k", True)]


def test_groups_share_no_key():
    runs = [entry("a", 0, b"a", b"c"), entry("b", 1, b"c", b"d"), entry("c", 0, b"e", b"g"), entry("d", 1, b"f", b"f"), entry("e", 0, b"x", b"x"), entry("f", 1, b"h", b"i")]
    got = policy.pick_inputs(runs, 0)
    assert [[r.id for r in g] for g in got.groups()] == [["a", "b"], ["c", "d"], ["e"]]
    assert policy.pick_inputs(runs, 1) is not None and [r.id for g in policy.pick_inputs(runs, 1).groups() for r in g] == ["b", "d", "f"]


def test_bloom_filter_misses_no_key_and_errs_seldom(spark):
    keys = spark.range(1000).select(F.concat(F.lit("key_"), F.col("id").cast("string")).alias("key"))
    made = KeyFilter.build(keys, 1000, 0.01)
    for f in (made, KeyFilter.from_bytes(spark, made.to_bytes())):
        assert all(f.may_contain(f"key_{i}") for i in range(1000))
        assert sum(f.may_contain(f"key_{i}") for i in range(20_000, 30_000)) <= 150
    with pytest.raises(ValueError):
        KeyFilter.build(keys, 1000, 0.0)


def test_input_choice_and_scores():
    runs = [entry("a", 0, b"a", b"f", seq=1), entry("b", 0, b"d", b"k", seq=2), entry("c", 1, b"j", b"m"), entry("d", 1, b"x", b"z")]
    got = policy.pick_inputs(runs, 0)
    assert [r.id for r in got.upper] == ["b", "a"] and [r.id for r in got.lower] == ["c"]
    assert policy.pick_inputs(runs, 0, frozenset("c")) is None and policy.pick_inputs(runs, 4) is None
    o = Options(root="x", level_base_bytes=10, target_file_bytes=10, num_levels=3)
    assert [level for level, _ in policy.due_levels(runs, o)] == [0, 1]


def test_pruning_is_conservative():
    runs = [entry("a", 0, b"a", b"c"), entry("b", 0, b"d", b"f")]
    assert [r.id for r in prune(runs, Bound.excluded(b"c"), UNBOUNDED)] == ["a", "b"]
    assert [r.id for r in prune(runs, Bound.included(b"d"), Bound.included(b"e"))] == ["b"]


def test_formats():
    entries = [(b"k", b"v"), (b"d", None), (b"x" * 70000, b"")]
    assert decode_entries(b"".join(encode_entry(*e) for e in entries)) == entries
    log = frame(b"one") + frame(b"two")
    assert frames(log) == [b"one", b"two"] and frames(log[:-1]) == [b"one"] and frames(log[:-1] + b"?") == [b"one"]


def test_options():
    o = Options().path("x").block_size(4096)
    assert (o.root, o.row_group_bytes) == ("x", 4096)
    for bad in (dict(num_levels=7), dict(false_positive_rate=0.0), dict(compression="??"), dict(target_run_bytes=0)):
        with pytest.raises(ValueError):
            Options(**bad)
