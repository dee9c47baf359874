"""Each operator against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import exact_dedup, hamming, jaccard, langid, mixing, packing, queries, shards, toxicity
from sedimenta.llm.components import components
from sedimenta.llm.sampling import bounded_sample, labelled_rows
from sedimenta.llm.textcore import Table, span_hashes

# A column that clashes with names that operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, size string"
DOCS = [
    (1, "Hello World. " * 200, "en", "a", 2600, "x", "x", "x"),
    (2, "hello world. " * 200, "en", "a", 2600, "x", "x", "x"),
    (3, "", "en", None, 0, None, None, None),
    (4, None, None, "b", None, None, None, None),
    (5, "É it's <|endoftext|>  two\n\nlines ", "fr", "b", 1, "x", "x", "x"),
    (6, "x" * 30000, "de", "c", 30000, "x", "x", "x"),
    (7, "one two", "en", "c", 7, "x", "x", "x"),
    (7, "one two", "en", "c", 7, "x", "x", "x"),
    (None, "one two", "en", "c", 7, "x", "x", "x"),
    (8, " ".join(f"w{i}" for i in range(3000)), "en", "a", 9, "x", "x", "x"),
    (9, " ".join(f"w{i}" for i in range(3000) if i != 1500), "en", "a", 9, "x", "x", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_hash_table_and_spans():
    rnd = np.random.default_rng(1)
    h = np.unique(rnd.integers(0, 1 << 63, 50_000).astype(np.uint64))
    t = Table()
    for part in np.array_split(h, 7):
        at = t.size
        t.add(part, np.arange(at, at + len(part)))
    assert (t.find(h) == np.arange(len(h)))[: len(h)].all() and (t.find(h + np.uint64(1)) < 0).mean() > 0.99
    a = np.frombuffer(b"abcxabcy", np.uint8)
    s = span_hashes(a, np.array([0, 4, 3]), np.array([3, 7, 6]))
    assert s[0] == s[1] != s[2]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, None), (3, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"))[0].collect()}
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("blocks", [(2, 64), (3, 17), (1024, 1 << 16)])
def test_top_k_is_exact_with_ties_and_repeats(spark, blocks):
    rnd = np.random.default_rng(3)
    vectors = [[float(x) for x in rnd.normal(size=41)] for _ in range(150)]
    rows = [(i, vectors[i % 120]) for i in range(300)] + [(0, vectors[0]), (500, None), (None, vectors[0]), (501, [1.0]), (502, []), (550, [1.0, float("nan"), None, 2.0])]
    given = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, id string, code string")
    codes = hamming.sign_codes(given)
    got = hamming.top_k(codes.where("id % 50 = 0"), codes, k=7, query_block=blocks[0], code_block=blocks[1])
    got = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in got.collect())
    bits = {i: np.pad(np.array([x or 0 for x in v], float), (0, 41 - len(v))) > 0 for i, v in rows if i is not None and v is not None}
    want = []
    for q in [i for i in bits if i % 50 == 0]:
        best = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items())[:7]
        want += [(q, k + 1, i, d) for k, (d, i) in enumerate(best)]
    assert got == sorted(want)
    assert hamming.top_k(codes.where("id < 0"), codes).count() == 0 and hamming.top_k(codes, codes.where("id < 0")).count() == 0
    assert hamming.sign_codes(given.limit(0)).count() == 0 and hamming.sign_codes(given, bits=8).count() == 3


def test_a_bound_ends_the_search_early_and_loses_nothing():
    rnd = np.random.default_rng(9)
    codes = np.unique(rnd.integers(0, 256, (3000, 8)).astype(np.uint8), axis=0)
    query, counts = codes[5] ^ np.uint8(3), np.ones(len(codes), np.int64)
    distance = np.bitwise_count(codes ^ query).sum(axis=1)
    probed = []
    for bound in (None, 22, 9):
        index = hamming.SegmentIndex(codes)
        rows, got = index.nearest(query, counts, 10, bound)
        want = np.sort(distance[distance <= bound]) if bound else np.sort(distance)[:10]
        assert np.sort(got)[: len(want)].tolist() == want[: len(got)].tolist() and (distance[rows] == got).all()
        probed.append(index.probed)
    assert probed[2] < probed[0]


def test_language_id(spark, docs, none):
    rnd = random.Random(4)
    vocabulary = {"en": "the and with house river street".split(), "fr": "le une maison rivière être rue".split()}
    train = spark.createDataFrame([(i, " ".join(rnd.choices(vocabulary[la], k=30)), la) for i in range(60) for la in ("en", "fr")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    asked = spark.createDataFrame([(1, "the HOUSE"), (2, "maisons rivières"), (3, "12 !?"), (4, None), (5, "housed streets"), (5, "housed streets")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(asked, model).collect()]
    assert sorted(got) == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "en"), (5, "en")]
    assert langid.predict(docs, model).count() == len(DOCS) and langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


def test_language_id_on_held_out_documents(spark, sf):
    got = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def test_shards_keep_every_row_and_commit_versions(spark, docs, none, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", docs.schema, target_bytes=1 << 20, fan_in=3)
    store.append(docs, arrivals=4, key="doc_id")
    store.append(docs)
    assert store.append(none) == store.version()
    first = store.version()
    store.compact()
    assert store.version() > first and not shards.similar_runs(store.shards(), 3, store.target_bytes)
    for version in range(1, store.version() + 1):  # every version stays readable
        assert Counter(map(tuple, store.read(version).collect())) == Counter(DOCS * 2) or version < first
    live = {s.file for s in store.shards()}
    assert store.vacuum() > 0 and {s.file for s in store.shards()} == live and store.vacuum() == 0
    with pytest.raises(Exception):
        store.shards(first)
    assert Counter(map(tuple, store.read().collect())) == Counter(DOCS * 2)
    placed = store.placed("doc_id").collect()
    assert len(placed) == 2 * len(DOCS) and all(n == r["shard_rows"] for r in placed for n in [sum((x["run"], x["shard"]) == (r["run"], r["shard"]) for x in placed)])
    with pytest.raises(shards.ConcurrentCommit):
        store._commit(store.version() - 1, [])
    assert shards.ShardStore(spark, f"file://{tmp_path}/e", docs.schema).placed("doc_id").count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_placed_gives_each_row_of_uncompacted_arrivals_once(spark, tmp_path, hot):
    rows = spark.range(600).select(F.when(F.lit(hot) & (F.col("id") % 3 == 0), 7).otherwise(F.col("id")).alias("doc_id"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store = shards.ShardStore(spark, f"file://{tmp_path}/data/s", rows.schema, fan_in=4)
    store.append(rows.coalesce(1), arrivals=7, key="doc_id")
    store.compact()
    live = store.shards()
    assert sum(s.tier == 0 for s in live) >= 2
    placed = store.placed("n").collect()
    assert sorted(r["n"] for r in placed) == list(range(600))
    assert Counter((r["run"], r["tier"], r["shard_rows"]) for r in placed) == Counter({(s.run, s.tier, s.rows): s.rows for s in live})


def test_places_beside_columns_of_the_same_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 6), (2, None, 6)], "run long, shard string, version int")
    store = shards.ShardStore(spark, f"file://{tmp_path}/c", rows.schema)
    assert store.placed("run", "shard").columns == ["run", "shard", "run_", "tier", "shard_", "shard_rows", "version"]
    store.append(rows, arrivals=2, key="run")
    got = store.placed("run", "shard", "version").collect()
    assert sorted((r["run"], r["shard"] or "", r["version"]) for r in got) == [(1, "a", 5), (2, "", 6), (2, "", 6)]
    assert {r["version_"] for r in got} == {store.version()} and {(r["run_"], r["shard_"]) for r in got} == {(s.run, k) for s in store.shards() for k in range(1, 3) if sum(x.run == s.run for x in store.shards()) >= k}


def test_the_sharding_query_places_each_document_once(spark, sf):
    got = queries.op3_sharding(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == docs and len({r["doc_id"] for r in got}) == docs
    in_shard = Counter((r["run"], r["shard"]) for r in got)
    assert all(in_shard[r["run"], r["shard"]] == r["shard_rows"] for r in got) and len({r["version"] for r in got}) == 1


def test_similar_runs():
    s = [shards.Shard(i, 0, "f", 1, n) for i, n in enumerate([10, 11, 12, 13, 100, 110, 9, 1000])]
    assert shards.similar_runs(s, 4) == [[6, 0, 1, 2]] and shards.similar_runs(s, 4, 14) == []


def brute_groups(rows, n, num, den):
    sets = [(i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()) for i, t in rows for w in [words(lowered(t))]]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if None not in (a, b) and s and t and den * min(len(s), len(t)) >= num * max(len(s), len(t)) and den * len(s & t) >= num * len(s | t)]
    group = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return sorted(((i if i is not None else -1), len(s), group.get(i, -1)) for i, s in sets)


def near_copies():
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    rows = [(d[0], d[1]) for d in DOCS]
    for i in range(45):
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(50)}"
        rows.append((20 + i, " ".join(w)))
    for i in range(25):
        rows.append((100 + i, " ".join(f"v{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 14)))))
    return rows


@pytest.mark.parametrize(("n", "num", "den", "options"), [(3, 90, 100, {}), (5, 80, 100, {}), (5, 80, 100, {"tile_shingles": 900, "block_sets": 4})])
def test_jaccard_groups(spark, n, num, den, options):
    rows = near_copies()
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den, **options).collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in got) == brute_groups(rows, n, num, den)


def test_jaccard_parts_lose_no_link():
    rnd = np.random.default_rng(6)
    for num, den in ((90, 100), (80, 100)):
        bands = jaccard.Bands(num, den)
        for _ in range(300):
            size = int(rnd.integers(1, 300))
            a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            keep = a[rnd.random(len(a)) > rnd.random() * 0.2]
            b = np.unique(np.concatenate([keep, rnd.integers(0, 1 << 63, int(rnd.integers(0, size // 8 + 1))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and den * common >= num * (len(a) + len(b) - common):
                assert set(jaccard.signatures(a, bands)) & set(jaccard.signatures(b, bands))
                bits, n, none, apart = [jaccard.bitmap(a), jaccard.bitmap(b)], np.array([len(a), len(b)]), np.zeros(2, int), np.arange(2)
                assert jaccard.may_link(*bits, *n.tolist(), num, den) and jaccard.linked(a, b, num, den)
                assert len(jaccard.tied(n, bits, apart, none, num, den)) == len(jaccard.tied(n, bits, apart, apart, num, den)) == 1 and not jaccard.tied(n, bits, none, none, num, den)
                some = sorted((a, b), key=len)
                assert len(list(jaccard.linked_pairs(some, apart, none, num, den))) == len(list(jaccard.linked_pairs(some, apart, apart, num, den))) == 1


def drifting():
    """Chains of texts, each one edit from the one before: ends of a chain are far apart, and no hub reaches them all."""
    rnd = random.Random(12)
    rows = []
    for c in range(6):
        w = [f"c{c}x{rnd.randrange(300)}" for _ in range(90)]
        for k in range(40):
            w = list(w)
            w[rnd.randrange(90)] = f"c{c}e{rnd.randrange(10000)}"
            if k % 13 == 12:  # a gap that only some links bridge
                for _ in range(3):
                    w[rnd.randrange(90)] = f"c{c}e{rnd.randrange(10000)}"
            rows.append((1000 * c + rnd.randrange(900), " ".join(w)))
    long = [f"z{rnd.randrange(50000)}" for _ in range(30000)]
    for k in range(3):
        long[k * 100 : k * 100 + 60] = [f"y{k}"] * 60
        rows.append((9000 + k, " ".join(long)))
    return rows


@pytest.mark.parametrize("options", [{}, {"tile_shingles": 500, "block_sets": 3}])
def test_jaccard_chains(spark, options):
    rows = list({i: (i, t) for i, t in drifting()}.values())
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100, **options).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows, 5, 80, 100)


@pytest.mark.parametrize("options", [{}, {"id_bits": 1, "least": 4, "most": 16}])
def test_exact_dedup(spark, docs, none, options):
    group = {}
    for d in DOCS:
        group.setdefault(lowered(d[1]), []).append(d[0])
    want = Counter((d[0], k, len(g), d[0] == k, hashlib.sha256(lowered(d[1]).encode()).hexdigest()) for d in DOCS for g in [group[lowered(d[1])]] for k in [max((x for x in g if x is not None), default=None)])
    assert Counter(map(tuple, exact_dedup.decisions(docs, **options).collect())) == want
    kept = exact_dedup.keep_one(docs, **options)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({(max(x for x in g if x is not None), t) for t, g in ((d[1], group[lowered(d[1])]) for d in DOCS) for t in [next(d[1] for d in DOCS if d[0] == max(x for x in g if x is not None))]})
    assert exact_dedup.decisions(none).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.taken(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d[0], len(words(d[1]))) for d in DOCS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    rnd = random.Random(7)
    some = spark.createDataFrame([(i, " ".join(["w"] * rnd.randrange(1, 200)), rnd.choice("aaaabcd") if i % 9 else None) for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.taken(some, shard_docs=64).collect()
    total, by = sum(r["size"] for r in rows), {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1 and all(t <= 2 * s + 1e-6 and abs(sum(x) - t) <= max(200, 0.05 * t) for (s, t), x in by.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken(some.repartition(7), shard_docs=64).collect()))
    mixed = mixing.mixed(some)
    assert mixed.columns == some.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    assert mixing.taken(none).count() == 0


def test_mixed_documents_have_each_sources_target(spark):
    """Long documents of one source all have about one ratio: rounded alone they would all go, or all stay."""
    rnd = random.Random(11)
    rows = [(i, " ".join([f"w{i}"] * rnd.randrange(60, 400)), s) for s, n in (("a", 700), ("b", 300), ("c", 900), (None, 250)) for i in range(len(s or "") * 1000 + ord(s or "z") * 1000, len(s or "") * 1000 + ord(s or "z") * 1000 + n)]
    # A hot id of many texts, and one row that is there very often.
    rows += [(7, f"x{k} " * rnd.randrange(60, 400), "d") for k in range(400)] + [(8, "y " * 100, "e")] * 301
    some = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {(d, s, t): len(words(t)) for d, t, s in rows}
    for weights in ((5, 2, 1), (1, 1, 1)):
        target, ratio = {}, {}
        own = Counter()
        for d, t, s in rows:
            own[s] += size[d, s, t]
        by_size = {n: s for s, n in own.items()}
        assert len(by_size) == len(own)
        for r in mixing.taken(some, weights=weights, shard_docs=128).collect():
            target[by_size[r["source_size"]]] = r["target"]
        got, copies = Counter(), Counter()
        for r in mixing.mixed(some, weights=weights, shard_docs=128).collect():
            got[r["source"]] += size[r["doc_id"], r["source"], r["text"]]
            copies[r["doc_id"], r["source"], r["text"]] += 1
        ratio = {s: target[s] / own[s] for s in own}
        assert any(0.1 < x < 0.9 or 1.1 < x < 1.9 for x in ratio.values())
        assert all(abs(got[s] - target[s]) <= 0.03 * target[s] + 64 for s in own), (got, target)
        there = Counter((d, s, t) for d, t, s in rows)
        assert all(n <= 2 * there[k] for k, n in copies.items())


def test_packing_places_every_token_once(spark, docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    got = packing.pack(docs, path, capacity=64, bucket_pieces=40).collect()
    t = Tokenizer.from_file(path)
    want = Counter()
    for d in DOCS:
        ids = np.array([*t.encode(d[1] or "", add_special_tokens=False).ids, 2], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            n = 64 if piece else len(ids) % 64 or 64
            want[d[0], piece, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start, piece = start + n, piece + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(none, path).count() == 0


def test_encoder_keeps_the_pieces_of_the_text_at_hand(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing.Encoder, "MOST", 6)
    path = queries.tokenizer_path()
    t, e = Tokenizer.from_file(path), packing.Encoder(path)
    for text in ("a b c d e", "a b c d e f g h i j", "k l", "b k z"):
        assert [x.tolist() for x in e.encode([text])] == [t.encode(text, add_special_tokens=False).ids]


def test_plan_is_tight_and_whole():
    rnd = random.Random(8)
    counts = Counter(rnd.randrange(1, 1025) for _ in range(5000))
    places = packing.plan_places(counts, 1024)
    for n, c in counts.items():
        runs = sorted((p[1], p[2]) for p in places if p[0] == n)
        assert runs[0][0] == 0 and runs[-1][1] == c and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    used = max(p[4] + (p[2] - p[1] - 1) // p[3] for p in places) + 1
    assert used <= 1.04 * sum(n * c for n, c in counts.items()) / 1024 + 1


def test_folding_and_exceptions():
    m = toxicity.Matcher({" idiot ": 2.0, " trash ": 1.0, " lowei": 1.5}, ["trash can"])
    found = [[(t, e) for t, _, _, e in x[3]] for x in m.hits(["An 1d10t!", "іdiοt", "the trash can, trash", "LOWEIx 1001 lo\u200bwei", "", "idiots"])][0]
    assert Counter(found) == Counter([(0, " idiot "), (1, " idiot "), (2, " trash "), (3, " lowei"), (3, " lowei")])


def test_toxicity(spark, sf, docs, none):
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.9
    model = toxicity.fit(none.select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("label")))
    assert toxicity.score(docs, model, "score", ["doc_id"]).count() == len(DOCS) and toxicity.score(none, model, "score", ["doc_id"]).count() == 0
    assert toxicity.score(docs, model, "score", docs.columns, keep_below=2.0).columns == docs.columns


def test_samples_are_bounded_with_repeated_and_null_ids(spark):
    n = 9000
    key = F.when(F.col("n") % 3 == 0, F.lit(None)).when(F.col("n") % 3 == 1, F.lit(7)).otherwise(F.col("n"))
    rows = spark.range(n).select(F.col("id").alias("n")).select(key.cast("long").alias("id"), "n")
    for some in (rows, rows.select("id"), rows.select("id", F.lit("x").alias("text")), rows.where("id is null"), rows.where("id = 7")):
        got = [tuple(r) for r in bounded_sample(some, "id", 900).collect()]
        assert 1 <= len(got) <= 1100 and got == [tuple(r) for r in bounded_sample(some.repartition(5), "id", 900).collect()]
    assert 700 <= bounded_sample(rows, "id", 900).count() and bounded_sample(rows, "id", n).count() == n
    labels = rows.select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")).unionAll(spark.range(n).selectExpr("7 as doc_id", "1 as toxic"))
    docs = spark.createDataFrame([(7, "a"), (7, "b"), (None, "c"), (8, "d")], "doc_id long, text string")
    assert sorted((r["id"], r["text"], r["label"]) for r in labelled_rows(docs, labels, "toxic", n).collect()) == [(7, "a", 1), (7, "b", 1), (8, "d", 1)]


def test_jaccard_takes_empty_tables_and_clashing_columns(spark, docs, none):
    assert jaccard.similar_groups(none).count() == 0
    got = jaccard.similar_groups(docs.withColumns({c: F.lit("x") for c in ("id", "n", "s1", "key", "keys", "node", "component", "u", "v")}), 3, 90, 100)
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in got.collect()) == brute_groups([(d[0], d[1]) for d in DOCS], 3, 90, 100)


def test_the_packing_query_gives_every_document(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = {}
    for r in queries.op8_packing(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(got) == {d["doc_id"] for d in docs}
    for d in docs:
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(got[d["doc_id"]])):
            assert (piece, start) == (k, at) and crc == zlib.crc32(ids[at : at + length].tobytes()) and (length == 1024 or k == 0)
            at += length
        assert at == len(ids)
