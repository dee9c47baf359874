"""Language ID, word first: known words by their frequency in each language, others by character n-grams.

A word that the model knows scores its smoothed log frequency in each language. An unseen word
falls back to the longest of its character n-grams (5 down to 1, with word borders) of which the
model knows any, and scores their mean. The language with the highest sum over all words of the
whole text wins; the score is its share of the likelihood.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.sampling import bounded_sample
from sedimenta.llm.textcore import Memo, category_table, code_points, held, lean, lower_table, slices, spans
from sedimenta.sources.hfs import drop_table, stage_table

_LONGEST = 5
_SCHEMA = "lang string, gram string, n long"


def words_of(texts: list[str]):
    """For each slice of texts: first text, last + 1, lower-cased code points, and each word's start, end and text."""
    for i, j in slices([len(t) for t in texts]):
        _, cp, offsets = code_points(texts[i:j])
        cp = lower_table()[cp]
        yield i, j, cp, *spans(category_table()[cp] == 1, offsets)


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _flush(counts: Counter):
    keys = list(counts)
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])
    counts.clear()


def _count(batches):
    """Each language's words and how often they occur."""
    counts: Counter = Counter()
    for batch in batches:
        texts, langs = [t or "" for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist()
        names = sorted(set(langs))
        codes = np.array([names.index(x) for x in langs], np.int64)
        for i, _, cp, starts, ends, text in words_of(texts):
            memo = Memo()
            where: list[int] = []
            rows = memo.rows(cp, starts, ends, lambda at: where.extend(at.tolist()), 1 << 62)
            keys, n = np.unique(rows * len(names) + codes[i:][text], return_counts=True)
            for row, code, c in zip((keys // len(names)).tolist(), (keys % len(names)).tolist(), n.tolist()):
                counts[names[code], cp[starts[where[row]] : ends[where[row]]].astype("<u4").tobytes().decode("utf-32-le")] += c
        if len(counts) > 300_000:
            yield from _flush(counts)
    yield from _flush(counts)


def _split(batches):
    """The n-grams of words."""
    counts: Counter = Counter()
    for batch in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            for k in range(1, _LONGEST + 1):
                for g in grams(word, k):
                    counts[lang, g] += n
        if len(counts) > 300_000:
            yield from _flush(counts)
    yield from _flush(counts)


def _table(counted: DataFrame, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """All entries, and their counts by language."""
    got = counted.toArrow().sort_by([("gram", "ascending"), ("lang", "ascending")]).combine_chunks()
    coded = got.column("gram").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    counts = np.zeros((len(names), len(langs)))
    code = {x: k for k, x in enumerate(langs)}
    counts[coded.indices.to_numpy(), [code[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    return names, counts


def _scores(names: list[str], counts: np.ndarray, by_length: bool) -> np.ndarray:
    """Smoothed log frequencies by language, among all entries or among those of one length."""
    length = np.array([len(x) if by_length else 0 for x in names], np.int64)
    size = np.zeros((_LONGEST + 1, counts.shape[1]))
    np.add.at(size, length, counts)
    return np.log((counts + 0.1) / (size[length] + 0.1 * (len(names) + 1))).astype(np.float32)


def _packed(names: list[str], counts: np.ndarray) -> bytes:
    # Mostly zeros and small numbers: a tenth of what it stands for.
    return zlib.compress(pickle.dumps(("\0".join(names), counts.astype(np.int64))), 1)


def _unpacked(data: bytes) -> tuple[list[str], np.ndarray]:
    names, counts = pickle.loads(zlib.decompress(data))
    return names.split("\0") if len(counts) else [], counts.astype(float)


def fit(train: DataFrame, sample_rows: int = 20_000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict:
    """The model, learned from at most about ``sample_rows`` rows with a language.

    Every word and n-gram of the sample is in the model, whatever its language; ``sample_rows`` alone bounds it.
    They are counted on the executors. No such rows give a model without languages.
    """
    rows = bounded_sample(train.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "id", sample_rows)
    words, path = stage_table(rows.select("text", "lang").mapInArrow(lean("language", _count), _SCHEMA).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    known = _packed(*_table(words, langs))
    parts = _packed(*_table(words.mapInArrow(lean("language", _split), _SCHEMA).groupBy("lang", "gram").agg(F.sum("n").alias("n")), langs))
    drop_table(train.sparkSession, path)
    return {"langs": langs, "words": known, "grams": parts}


class _Known:
    """The model's entries, found by their characters."""

    def __init__(self, data: bytes, by_length: bool):
        names, counts = _unpacked(data)
        scores = _scores(names, counts, by_length)
        ends = np.cumsum([len(x) for x in names], dtype=np.int64)
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        self.memo, self.scores = Memo(), np.zeros_like(scores)
        self.scores[self.memo.rows(np.frombuffer("".join(names).encode("utf-32-le"), "<u4"), starts, ends, lambda at: None, 1 << 62)] = scores

    def find(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.memo.lookup(values, starts, ends)


class Scorer:
    """Sums of word scores by language; each distinct word is scored once in this process."""

    MOST = 1 << 20

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.words, self.grams = _Known(model["words"], False), _Known(model["grams"], True)
        self.memo = Memo()
        self._forget()

    def _forget(self):
        self.known, self.scores = 0, np.zeros((1 << 14, len(self.langs)), np.float32)

    def score_words(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The scores of distinct words: their own, else the mean of their longest known n-grams, else 0."""
        out = np.zeros((len(starts), len(self.langs)), np.float32)
        rows = self.words.find(cp, starts, ends)
        out[rows >= 0] = self.words.scores[rows[rows >= 0]]
        left = np.flatnonzero(rows < 0)
        # Unseen words between borders, end to end.
        n = ends[left] - starts[left] + 2
        last = np.cumsum(n)
        whole = np.empty(int(n.sum()), np.uint32)
        if len(left):
            whole[last - n], whole[last - 1] = ord("<"), ord(">")
            inner = np.ones(len(whole), bool)
            inner[last - n] = inner[last - 1] = False
            whole[inner] = cp[np.concatenate([np.arange(a, b) for a, b in zip(starts[left].tolist(), ends[left].tolist())])]
        for size in range(_LONGEST, 0, -1):
            if not len(left):
                break
            many = np.maximum(n - size + 1, 0)
            word = np.repeat(np.arange(len(left)), many)
            at = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + (last - n)[word]
            rows = self.grams.find(whole, at, at + size)
            hit = rows >= 0
            count = np.bincount(word[hit], minlength=len(left))
            found = count > 0
            for k in range(len(self.langs)):
                sums = np.bincount(word[hit], self.grams.scores[rows[hit], k], minlength=len(left))
                out[left[found], k] = sums[found] / count[found]
            left, n, last = left[~found], n[~found], last[~found]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, score
        for i, j, cp, starts, ends, text in words_of(texts):
            if not len(starts):
                continue

            def learn(at, cp=cp, starts=starts, ends=ends):
                while self.known + len(at) > len(self.scores):
                    self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
                self.scores[self.known : self.known + len(at)] = self.score_words(cp, starts[at], ends[at])
                self.known += len(at)

            rows = self.memo.rows(cp, starts, ends, learn, self.MOST, self._forget)
            values = self.scores[rows]
            sums = np.zeros((j - i, len(self.langs)))
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            sums[text[first]] = np.add.reduceat(values.astype(np.float64), first, axis=0)
            likely = np.exp(sums - sums.max(axis=1, keepdims=True))
            likely /= likely.sum(axis=1, keepdims=True)
            for k in text[first].tolist():
                best = int(sums[k].argmax())
                lang[i + k], score[i + k] = self.langs[best], float(likely[k, best])
        return lang, score


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: null texts, texts without a letter and a model without languages give ``und`` and 0.

    Ties go to the first language by name. Repeated rows and null ids are scored like any others.
    """
    # The entries of the sample that the model was fitted on, however large the input.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def run(batches):
        scorers = held("language")
        if name not in scorers:
            scorers.clear()
            scorers[name] = Scorer(shared.value)
        scorer = scorers[name]
        for batch in batches:
            lang, score = scorer.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean("language", run), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
