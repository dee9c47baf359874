"""Toxicity: a weighted lexicon, matched by one Aho-Corasick automaton over folded text.

Folding lower-cases, turns homoglyphs and digits that stand for letters into letters, and sets
everything else to blanks, so an entry is found however it is dressed up. Entries are whole words
or beginnings of words, learned from labelled rows: an entry is taken while it finds toxic rows
that few others find, and weighs its log odds. Exception phrases cover what lies in them. A row's
features, among them the weight by length, are calibrated on labelled rows that didn't choose entries.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sedimenta.llm.logistic import fit_logistic, logits, sigmoid
from sedimenta.llm.sampling import bounded_sample, crc_mod
from sedimenta.llm.textcore import category_table, code_points, lean, lower_table, slices, spans
from sedimenta.sources.hfs import drop_table, stage_table

# Characters that look like a Latin letter.
HOMOGLYPHS = {
    "a": "аαɑａ", "b": "Ьƅｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεҽｅ", "g": "ɡｇ", "h": "һｈ", "i": "іιıｉ", "j": "јｊ", "k": "кκｋ", "l": "ӏⅼｌ",
    "m": "мｍ", "n": "ոｎ", "o": "оοօｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ", "t": "тτｔ", "u": "υսｕ", "v": "νѵｖ", "w": "ѡԝｗ", "x": "хχｘ", "y": "уγｙ", "z": "ᴢｚ", "f": "ｆ",
}
# Digits and signs written for a letter.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Phrases in which an entry is harmless.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "class clown", "clown fish", "circus clown", "pond scum", "soap scum"]
#: The shortest and the longest beginning of a word that can be an entry; whole words of any length can.
STEMS = (3, 8)
_HIDDEN = [0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF]

_tables: list = []


def _fold_tables():
    if not _tables:
        to = lower_table().copy()
        is_letter = category_table() == 1
        for letter, others in HOMOGLYPHS.items():
            for c in others:
                for x in {c, c.upper()} if len(c.upper()) == 1 else {c}:
                    to[ord(x)] = ord(letter)
        digit, sign = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
        for c, letter in LEET.items():
            to[ord(c)] = ord(letter)
            (digit if c.isdigit() else sign)[ord(c)] = True
        _tables[:] = [to, is_letter, digit, sign]
    return _tables


def fold(texts: list[str]):
    """Folded texts end to end, each with a blank before and after: (string, code points, offsets, word starts)."""
    whole, cp, _ = code_points([f" {t} " for t in texts])
    if any(chr(c) in whole for c in _HIDDEN):
        texts = ["".join(c for c in t if ord(c) not in _HIDDEN) for t in texts]
        whole, cp, _ = code_points([f" {t} " for t in texts])
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in texts], out=offsets[1:])
    to, is_letter, digit, sign = _fold_tables()
    letter, solid = is_letter[cp], is_letter[cp] | digit[cp]
    inner = np.zeros(len(cp), bool)
    inner[1:-1] = sign[cp[1:-1]] & solid[:-2] & solid[2:]
    inside = solid | inner
    starts, ends, _ = spans(inside, offsets)
    if len(starts):  # numbers stay numbers: a word has a letter
        has = np.add.reduceat(letter.astype(np.int64), np.stack([starts, np.minimum(ends, len(cp) - 1)], 1).ravel())[::2] > 0
        mark = np.zeros(len(cp) + 1, np.int32)
        np.add.at(mark, starts[has], 1)
        np.add.at(mark, ends[has], -1)
        inside = np.cumsum(mark[:-1]) > 0
        starts = starts[has]
    out = np.where(inside, to[cp], np.uint32(32)).astype("<u4")
    return out.tobytes().decode("utf-32-le"), out, offsets, starts


class Matcher:
    """Finds lexicon entries in whole texts and turns them into a row's features."""

    FEATURES = 4

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight, entry))
        for phrase in exceptions:
            folded = f" {phrase} "
            self.automaton.add_word(folded, (len(folded), None, folded))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, texts: list[str]):
        """For each slice: first text, texts, word counts, and (text, word start, weight, entry) of the strongest entry at each word."""
        for i, j in slices([len(t) for t in texts]):
            folded, _, offsets, starts = fold(texts[i:j])
            text_of = np.searchsorted(offsets, starts, "right") - 1
            words = np.bincount(text_of, minlength=j - i) if len(starts) else np.zeros(j - i, np.int64)
            best: dict[int, tuple[float, str]] = {}
            covered: list[tuple[int, int]] = []
            for end, (length, weight, entry) in () if self.empty else self.automaton.iter(folded):
                start = end - length + 2  # after the blank
                if weight is None:
                    covered.append((start, end))
                elif start not in best or best[start][0] < weight:
                    best[start] = (weight, entry)
            for a, b in covered:
                for at in [x for x in range(a, b) if x in best]:
                    del best[at]
            at = np.array(sorted(best), np.int64)
            texts_of = np.searchsorted(offsets, at, "right") - 1
            yield i, j, words, [(int(t), int(p), *best[int(p)]) for t, p in zip(texts_of, at)]

    def features(self, texts: list[str]) -> np.ndarray:
        """By text: the strongest weight, all weights, weights by 100 words, distinct entries."""
        out = np.zeros((len(texts), self.FEATURES))
        for i, j, words, found in self.hits(texts):
            entries: dict[int, set] = {}
            for t, _, weight, entry in found:
                out[i + t, 0] = max(out[i + t, 0], weight)
                out[i + t, 1] += weight
                entries.setdefault(t, set()).add(entry)
            for t, some in entries.items():
                out[i + t, 3] = len(some)
            out[i:j, 2] = np.log1p(100 * out[i:j, 1] / np.maximum(words, 1))
            out[i:j, 1] = np.log1p(out[i:j, 1])
        return out


def entries_of(text: str) -> set[str]:
    """Every possible entry of a text: its words, and their beginnings of ``STEMS`` letters, with the blanks around them."""
    _, cp, _, _ = fold([text])
    out = set()
    for w in set(cp.tobytes().decode("utf-32-le").split()):
        if len(w) > 2:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in range(STEMS[0], min(len(w), STEMS[1]) + 1))
    return out


def fit(labelled: DataFrame, sample_rows: int = 20_000, exceptions: list[str] = EXCEPTIONS, seed_lexicon: dict[str, float] | None = None) -> dict:
    """The model from ``labelled`` (id, text, label 0 or 1), at most about ``sample_rows`` rows.

    Entries are counted on the executors; the driver gets those that tell toxic rows, and for each
    sampled row which of those it has. All that add enough are taken. Rows with a null label aren't used. ``seed_lexicon`` is used
    beside what is learned. No rows give every text a score of 0.25.
    """
    # The sample is read several times, so it is written once; its size is bounded.
    rows, path = stage_table(bounded_sample(labelled.where("label in (0, 1)"), "id", sample_rows).select("text", F.col("label").cast("int").alias("label"), crc_mod("id", 4).cast("int").alias("fold")), "labelled")

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts.update((y, e) for e in entries_of(text or ""))
                if len(counts) > 150_000:
                    yield flush(counts)
        if counts:
            yield flush(counts)

    def flush(counts):
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays([pa.array([k[1] for k in keys]), pa.array([c if k[0] else 0 for k, c in counts.items()], pa.int64()), pa.array([0 if k[0] else c for k, c in counts.items()], pa.int64())], ["entry", "toxic", "clean"])
        counts.clear()
        return batch

    choose = rows.where("fold <> 0").select("text", "label")
    n = {r["label"]: r["n"] for r in choose.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n0 + 1.0))
    least = max(3, n1 // 2000)
    counted = choose.mapInArrow(lean("toxicity", count), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("odds", odds)
    top = counted.where((F.col("toxic") >= least) & (F.col("odds") > 1.2)).collect() if n1 and n0 else []
    weight = {r["entry"]: float(r["odds"]) for r in top}
    names = sorted(weight)

    def present(batches):
        for batch in batches:
            m = {e: k for k, e in enumerate(names)}
            found = [sorted(m[e] for e in entries_of(t or "") if e in m) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["label", "found"])

    lexicon = dict(seed_lexicon or {})
    if names:
        has = choose.mapInArrow(present, "label int, found array<int>").collect()
        lexicon |= {names[k]: weight[names[k]] for k in _cover([(r["label"], r["found"]) for r in has], names, least)}
    matcher_args = (lexicon, list(exceptions))

    def measure(batches):
        m = Matcher(*matcher_args)
        for batch in batches:
            x = m.features([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])

    calibrate = rows.where("fold = 0") if n1 + n0 > 50 else rows
    got = calibrate.select("text", "label").mapInArrow(measure, "label int, x array<double>").collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, Matcher.FEATURES)
    drop_table(labelled.sparkSession, path)
    y = np.array([r["label"] for r in got])
    if not len(y):  # nothing is known, so nothing is toxic
        x, y = np.zeros((1, Matcher.FEATURES)), np.zeros(1)
    return {"lexicon": lexicon, "exceptions": list(exceptions), "calibration": fit_logistic(x, y)}


def _cover(rows: list[tuple[int, list[int]]], names: list[str], least: int) -> list[int]:
    """Entries by what they add: a toxic row counts half as much for each entry that has found it before; clean rows count against.

    Of an entry and its own beginning the second counts for nothing in the rows of the first.
    """
    toxic = [found for y, found in rows if y]
    holders: dict[int, list[int]] = {}
    for k, found in enumerate(toxic):
        for e in found:
            holders.setdefault(e, []).append(k)
    clean = Counter(e for y, found in rows if not y for e in found)
    ratio = len(toxic) / max(1, len(rows) - len(toxic))
    holders = {e: np.array(k) for e, k in holders.items()}
    worth = np.ones(len(toxic))
    chosen: list[int] = []
    gain = {e: float(len(k)) for e, k in holders.items()}

    def place(e: int) -> tuple[float, int]:
        # A longer entry wins over one that finds little more, as beginnings of words are more often found in harmless ones.
        return -(gain[e] - clean[e] * max(ratio, 0.05) * 2) * (1 + 0.01 * len(names[e])), e

    order = [place(e) for e in gain]
    heapq.heapify(order)
    while order:
        # Gains only fall, so the best by its last known gain is looked at again first.
        best = heapq.heappop(order)[1]
        now = float(worth[holders[best]].sum())
        if now < gain[best] - 1e-9:
            gain[best] = now
            heapq.heappush(order, place(best))
            continue
        if now - clean[best] * max(ratio, 0.05) * 2 < max(least, 0.002 * len(toxic)):
            break
        chosen.append(best)
        worth[holders[best]] *= 0.5
        del gain[best]
        for e in gain:
            if names[best].startswith(names[e]) or names[e].startswith(names[best]):
                holders[e] = np.setdiff1d(holders[e], holders[best], assume_unique=True)
    return chosen


def score(docs: DataFrame, model: dict, out: str, columns: list[str], keep_below: float | None = None, text_col: str = "text") -> DataFrame:
    """``docs``' ``columns`` and a score column named ``out`` (0 to 1); with ``keep_below`` only rows scored lower, without the score.

    Null and empty texts have no hits and get the score of any row without hits. Nothing is cut off long texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the entries asked for
    kinds = docs.select(*columns).schema
    at = columns.index(text_col) if text_col in columns else len(columns)

    def run(batches):
        m = Matcher(shared.value["lexicon"], shared.value["exceptions"])
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            p = sigmoid(logits(shared.value["calibration"], m.features(texts)))
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(p)], [*columns, out])
            else:
                yield batch.filter(pa.array(p < keep_below))

    given = docs.select(*columns) if text_col in columns else docs.select(*columns, text_col)
    schema = kinds if keep_below is not None else StructType([*kinds.fields, StructField(out, DoubleType())])
    return given.mapInArrow(lean("toxicity", run), schema)
