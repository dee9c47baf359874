"""Language ID against a plain version in dictionaries."""

import math
import random
from collections import Counter

import pytest

from sedimenta.llm import langid, queries


def plain_model(rows):
    words, parts = {}, {}
    for text, lang in rows:
        run = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for w in run:
            words.setdefault(w, Counter())[lang] += 1
            for n in range(1, 6):
                for g in langid.grams(w, n):
                    parts.setdefault(g, Counter())[lang] += 1
    return words, parts


def plain_predict(text, words, parts, langs):
    size = {la: sum(c[la] for c in words.values()) for la in langs}
    by_length = {(n, la): sum(c[la] for g, c in parts.items() if len(g) == n) for n in range(1, 6) for la in langs}
    total = dict.fromkeys(langs, 0.0)
    run = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in run:
        if w in words:
            for la in langs:
                total[la] += math.log((words[w][la] + 0.1) / (size[la] + 0.1 * (len(words) + 1)))
            continue
        for n in range(5, 0, -1):
            known = [g for g in langid.grams(w, n) if g in parts]
            if known:
                for la in langs:
                    total[la] += sum(math.log((parts[g][la] + 0.1) / (by_length[n, la] + 0.1 * (len(parts) + 1))) for g in known) / len(known)
                break
    if not run:
        return "und", 0.0
    best = max(langs, key=lambda la: (total[la], -langs.index(la)))
    return best, 1 / sum(math.exp(total[la] - total[best]) for la in langs)


def test_predictions_are_those_of_the_plain_version(spark):
    rnd = random.Random(21)
    letters = {"en": "abcdefgh", "fr": "éfghijàk", "ky": "абвгдеёж"}
    rows = [(i, " ".join("".join(rnd.choices(letters[la], k=rnd.randrange(1, 7))) for _ in range(20)), la) for i in range(80) for la in letters if la != "ky" or i < 4]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words, parts = plain_model([r[1:] for r in rows])
    assert set(langid._unpacked(model["words"])[0]) == set(words) and set(langid._unpacked(model["grams"])[0]) == set(parts)
    asked = [(i, " ".join("".join(rnd.choices(letters[rnd.choice("en fr ky".split())] + "xyz", k=rnd.randrange(1, 9))) for _ in range(rnd.randrange(0, 4)))) for i in range(150)] + [(200, None), (201, "12, 3!")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, text in asked:
        lang, score = plain_predict(text or "", words, parts, sorted(letters))
        assert got[i][1] == pytest.approx(score, abs=1e-3)
        assert got[i][0] == lang or abs(score - 0.5) < 1e-3


def test_the_query_is_the_operator_on_the_rows_it_may_learn_from(spark, sf):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, sf).collect()}
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1 for d in docs}
    words, parts = plain_model([(d["text"] or "", d["lang"]) for d in docs if d["lang"] is not None and not held[d["doc_id"]]])
    langs = sorted({d["lang"] for d in docs if d["lang"] is not None and not held[d["doc_id"]]})
    assert {k: r["held_out"] for k, r in got.items()} == held
    for d in docs[:40]:
        lang, score = plain_predict(d["text"] or "", words, parts, langs)
        assert got[d["doc_id"]]["score"] == pytest.approx(score, abs=1e-3)
        assert got[d["doc_id"]]["lang_pred"] == lang or score < 0.501
