"""The corpus pipeline against plain versions of its stages, and on odd tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from sedimenta.llm import mixing, queries
from sedimenta.llm.logistic import logits, sigmoid
from tests.llm.test_llm import brute_groups, lowered, near_copies, words
from tests.llm.test_toxicity import plain_features

SF = "/root/testdata/sf0.01"  # sf0.001 has too few labels to learn from


def test_run_is_what_plain_stages_give(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.toxicity_model(spark, docs, SF)
    rows = {r["doc_id"]: r for r in docs.collect()}

    def toxic(text):
        x = np.array([plain_features(text or "", model["lexicon"], model["exceptions"])])
        return sigmoid(logits(model["calibration"], x))[0] >= 0.5

    clean = [r for r in rows.values() if not toxic(r["text"])]
    assert 0 < len(rows) - len(clean) < len(rows) / 3
    best = {}
    for r in clean:
        key = lowered(r["text"])
        best[key] = max(best.get(key, -1), r["doc_id"])
    kept = sorted(best.values())
    component = {x[0]: x[2] for x in brute_groups([(i, rows[i]["text"]) for i in kept], 5, 80, 100)}
    kept = [i for i in kept if component[i] == i]
    assert len(kept) < len(best)
    got = p.run(spark, SF).collect()
    # Whole documents, each once or twice, from those that are left, by the sources' targets.
    copies = Counter(r["doc_id"] for r in got if r["start"] == 0)
    assert set(copies) <= set(kept) and max(copies.values()) <= 2
    size = {i: len(words(rows[i]["text"])) for i in kept}
    left = docs.where(F.col("doc_id").isin(kept))
    target, own, taken = {}, Counter(), Counter()
    for i in kept:
        own[rows[i]["source"]] += size[i]
        taken[rows[i]["source"]] += copies.get(i, 0) * size[i]
    sources = {r["doc_id"]: rows[r["doc_id"]]["source"] for r in left.select("doc_id").collect()}
    for r in mixing.taken(left).collect():
        target[sources[r["doc_id"]]] = r["target"]
    longest = {s: max(size[i] for i in kept if rows[i]["source"] == s) for s in own}
    assert all(abs(taken[s] - target[s]) <= max(0.03 * target[s], min(64, longest[s])) for s in own), {s: (taken[s], target[s], own[s]) for s in own}
    # Every copy's tokens once, in gapless sequences.
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for i, n in copies.items():
        ids = np.array([*tokenizer.encode(rows[i]["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            length = 1024 if piece else len(ids) % 1024 or 1024
            want[i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += n
            start, piece = start + length, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) <= 1.05 * sum(r["length"] for r in got) / 1024 + 1


def test_near_copies_go_but_for_the_smallest_id(spark):
    near = spark.createDataFrame([(*r, "c", "g") for r in near_copies()], "doc_id long, text string, component_id string, _gone string")
    kept = p.drop_near_copies(spark, near, SF)
    component = {x[0]: x[2] for x in brute_groups(near_copies(), 5, 80, 100)}
    assert kept.columns == near.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in near_copies() if r[0] is None or r[0] == component.get(r[0]))


ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, label string, score string, n string, size string, taken string, kept string, key string, node string"


@pytest.mark.parametrize("rows", [[], [(None,) * 14], [(1, "one two", "en", "a", 7, *"ihgfedcba")] * 3 + [(2, None, None, None, None, *[None] * 9), (3, "", "en", "a", 0, *[""] * 9), (4, "word " * 40_000, "en", "b", 9, *[None] * 9)]])
def test_stages_take_empty_and_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, ODD)
    texts = Counter(lowered(r[1]) for r in rows)
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        got = out.collect()
        if k < 4:
            assert out.columns == docs.columns, name
            assert {lowered(r["text"]) for r in got} <= set(texts) and (name == p.STAGES[3][0] or {lowered(r["text"]) for r in got} == set(texts))
            assert k != 1 or len(got) == len(texts)
            docs = spark.createDataFrame(got, docs.schema)
        else:
            assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            assert sum(r["start"] == 0 for r in got) == docs.count()


def test_a_broken_subpackage_is_not_passed_over(monkeypatch):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def broken(name, *a, **k):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'numpi'", name="numpi")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        e.queries()
    monkeypatch.undo()
    assert "pipeline" in e.queries() and re.fullmatch("op1_.*", next(n for n in e.queries() if n.startswith("op1_")))
