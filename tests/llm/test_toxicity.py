"""Toxicity against a character-by-character version."""

import random
import unicodedata

import numpy as np
import pytest

from sedimenta.llm import queries, toxicity
from sedimenta.llm.logistic import logits, sigmoid


def plain_fold(text):
    """The folded words of a text."""
    to = {c: letter for letter, others in toxicity.HOMOGLYPHS.items() for c in others} | {c.upper(): letter for letter, others in toxicity.HOMOGLYPHS.items() for c in others if len(c.upper()) == 1}
    text = "".join(c for c in text if ord(c) not in toxicity._HIDDEN)
    letter = [unicodedata.category(c)[0] == "L" for c in text]
    solid = [a or (c in toxicity.LEET and c.isdigit()) for a, c in zip(letter, text)]
    inside = [s or (c in toxicity.LEET and 0 < k < len(text) - 1 and solid[k - 1] and solid[k + 1]) for k, (s, c) in enumerate(zip(solid, text))]
    words, run = [], []
    for k in range(len(text) + 1):
        if k < len(text) and inside[k]:
            run.append(k)
        elif run:
            if any(letter[i] for i in run):
                words.append("".join(to.get(text[i], toxicity.LEET.get(text[i], text[i].lower() if len(text[i].lower()) == 1 else text[i])) for i in run))
            run = []
    return words


def plain_features(text, lexicon, exceptions):
    words = plain_fold(text)
    covered = {k + i for e in exceptions for k in range(len(words)) for i in range(len(e.split())) if words[k : k + len(e.split())] == e.split()}
    # An exception holds only where single blanks lie between its words, which the caller sees to.
    best = []
    for k, w in enumerate(words):
        found = [(weight, e) for e, weight in lexicon.items() if (f" {w} " == e or (not e.endswith(" ") and f" {w}".startswith(e)))]
        if found and k not in covered:
            best.append(max(found, key=lambda x: x[0]))
    total = sum(weight for weight, _ in best)
    return [max((weight for weight, _ in best), default=0), np.log1p(total), np.log1p(100 * total / max(1, len(words))), len({e for _, e in best})]


def test_features_are_those_of_the_plain_version():
    rnd = random.Random(31)
    lexicon, exceptions = {" idiot ": 2.0, " trash ": 1.0, " lowei": 1.5, " idio": 0.5, f" {'q' * 60} ": 3.0}, ["trash can", "big idiot"]
    parts = ["idiot", "1d10t", "іdiοt", "IDIOTS", "tra$h", "trash can", "big idiot", "loweixy", "l0wei", "100", "5", "ok", "lo​wei", "!!", "q" * 60, "Q" * 61, "x" * 5000, "é", ""]
    texts = [" ".join(rnd.choices(parts, k=rnd.randrange(0, 12))) for _ in range(300)]
    got = toxicity.Matcher(lexicon, exceptions).features(texts)
    assert got == pytest.approx(np.array([plain_features(" ".join(t.split(" ")), lexicon, exceptions) for t in texts]))


def test_the_query_scores_as_the_plain_version_does(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.toxicity_model(spark, docs, sf)
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in queries.op9_toxicity(spark, sf).collect()}
    assert set(got) == set(rows) and model["lexicon"]
    flagged = [i for i in rows if got[i] >= 0.5]
    for i in flagged[:60] + sorted(rows)[:150]:
        x = np.array([plain_features(rows[i], model["lexicon"], model["exceptions"])])
        assert got[i] == pytest.approx(float(sigmoid(logits(model["calibration"], x))[0]), abs=1e-6)
