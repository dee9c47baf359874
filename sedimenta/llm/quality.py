"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Each view has a logistic classifier of its own. In every round both look at all documents, and each
gives the *other* view's training set a number of those it is sure of, drawn from all that it is sure
of by a hash, as many of either class as the labels have in proportion. A view whose sure labels of a
class don't hold on labelled rows that it wasn't trained on gives none of that class. Then each view is
calibrated on those rows, a small logistic regression combines the two calibrated views, and all
documents are scored.

Texts are read once, to a table of features; rounds and scores read that.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.logistic import fit_logistic, logits, sigmoid
from sedimenta.llm.sampling import crc_mod, labelled_rows
from sedimenta.llm.textcore import U64, category_table, code_points, lean, mix, slices, span_hashes, spans

_WORD_BUCKETS, _SOURCE_BUCKETS, _LANG_BUCKETS = 64, 32, 8
_SIGNS = "#$%&*|.,;:!?()[]{}<>=/\\\"'@-_+~^`"
TEXT_FEATURES = 14 + len(_SIGNS) + _WORD_BUCKETS
META_FEATURES = 8 + _SOURCE_BUCKETS + _LANG_BUCKETS


@functools.cache
def _sign_table() -> np.ndarray:
    """By code point: a sign's number from 1, else 0."""
    table = np.zeros(0x110000, np.uint8)
    for k, c in enumerate(_SIGNS):
        table[ord(c)] = k + 1
    return table


def _distinct(text: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    """How many different hashes each text has."""
    both, at = np.unique(mix(h + mix(text.astype(U64))), return_index=True)
    return np.bincount(text[at], minlength=texts)


def text_view(texts: list[str]) -> np.ndarray:
    """Shares of kinds of characters and of signs, word and line statistics, and hashed word shares of whole texts."""
    out = np.zeros((len(texts), TEXT_FEATURES))
    for i, j in slices([len(t) for t in texts]):
        _, cp, offsets = code_points(texts[i:j])
        m, block = j - i, out[i:j]
        if not len(cp):
            block[:, [6, 11]] = np.log1p(1)
            continue
        length = np.diff(offsets)
        n = np.maximum(length, 1)
        of = np.repeat(np.arange(m), length)
        kind = category_table()[cp]
        block[:, :4] = np.bincount(of * 4 + kind, minlength=m * 4).reshape(m, 4) / n[:, None]
        block[:, 4] = np.bincount(of[(cp >= 65) & (cp <= 90)], minlength=m) / n
        block[:, 5] = np.bincount(of[cp > 127], minlength=m) / n
        signs = _sign_table()[cp]
        some = signs > 0
        counts = np.bincount(of[some] * len(_SIGNS) + signs[some] - 1, minlength=m * len(_SIGNS)).reshape(m, -1)
        block[:, 14 : 14 + len(_SIGNS)] = counts / n[:, None]
        starts, ends, text = spans(kind != 0, offsets)
        words = np.maximum(np.bincount(text, minlength=m), 1)
        length = ends - starts
        block[:, 6] = np.log1p(words)
        block[:, 7] = np.bincount(text, length, minlength=m) / words
        marked = (kind[ends - 1] == 3) & ~np.isin(cp[ends - 1], [ord(c) for c in ".,;:!?"])
        block[:, 8] = np.bincount(text, marked, minlength=m) / words
        block[:, 9] = np.bincount(text, (length == 1) & (kind[starts] == 3), minlength=m) / words
        block[:, 10] = _distinct(text, span_hashes(cp, starts, ends), m) / words
        starts, ends, text = spans(cp != 10, offsets)
        lines = np.maximum(np.bincount(text, minlength=m), 1)
        block[:, 11] = np.log1p(lines)
        block[:, 12] = _distinct(text, span_hashes(cp, starts, ends), m) / lines
        block[:, 13] = np.bincount(of[cp == 10], minlength=m) / n
        starts, ends, text = spans(kind == 1, offsets)
        bucket = (span_hashes(cp, starts, ends) % U64(_WORD_BUCKETS)).astype(np.int64)
        counts = np.bincount(text * _WORD_BUCKETS + bucket, minlength=m * _WORD_BUCKETS).reshape(m, -1)
        block[:, 14 + len(_SIGNS) :] = counts / words[:, None]
    return out


def meta_view(source: np.ndarray, lang: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """One column a bucket of source and language (-1: null) and terms of the stated length (NaN: null)."""
    out = np.zeros((len(source), META_FEATURES))
    size = np.log1p(np.maximum(0, np.nan_to_num(n_chars)))
    out[:, :8] = np.stack([np.isnan(n_chars), size, size**2, size > 5, size > 7, size > 9, source < 0, lang < 0], 1)
    for first, bucket in ((8, source), (8 + _SOURCE_BUCKETS, lang)):
        at = np.flatnonzero(bucket >= 0)
        out[at, first + bucket[at]] = 1
    return out


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, h, t, source, lang, n_chars) of every row of ``docs``: a hash of id and text, the text view as bytes, hashed metadata.

    Null texts count as empty; null metadata is a value of its own. Repeated rows have equal features.
    """

    def run(batches):
        for batch in batches:
            t = text_view([x or "" for x in batch.column("text").to_pylist()]).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array([x.tobytes() for x in t], pa.binary()), *(batch.column(c) for c in ("source", "lang", "n_chars"))], ["id", "h", "t", "source", "lang", "n_chars"])

    def bucket(c: str, n: int):
        return F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(n)), F.lit(-1)).cast("int").alias(c)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), "text").alias("h"), "text", bucket("source", _SOURCE_BUCKETS), bucket("lang", _LANG_BUCKETS), F.col("n_chars").cast("double").alias("n_chars"))
    return given.mapInArrow(lean("quality", run), "id long, h long, t binary, source int, lang int, n_chars double")


def _views(batch) -> dict[str, np.ndarray]:
    """Both views of a batch of features."""
    t = np.frombuffer(b"".join(batch.column("t").to_pylist()), "<f4").reshape(-1, TEXT_FEATURES).astype(float)
    source, lang = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("source", "lang"))
    n_chars = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float)
    return {"t": t, "m": meta_view(source, lang, n_chars)}


_OTHER = {"t": "m", "m": "t"}


def _trusted(p: np.ndarray, y: np.ndarray, sure: float) -> set[int]:
    """The classes whose labels, given where scores are ``sure``, are right that often on these rows (and enough rows say so)."""
    out = set()
    for label, at in ((1, p >= sure), (0, p <= 1 - sure)):
        if ((y[at] == label).sum() + 1) / (at.sum() + 2) >= sure:
            out.add(label)
    return out


def _drawn(pool: DataFrame, models: dict, trusted: dict[str, set[int]], step: int, sure: float, wanted: dict[int, int]) -> dict[str, tuple[dict, np.ndarray, np.ndarray]]:
    """For each view: features, hashes and pseudo-labels of rows of ``pool`` that the other view is sure of.

    Of each class about ``wanted`` rows, drawn by a hash from all of them. They are counted before they are fetched.
    """

    def found(batch):
        views = _views(batch)
        order = mix(batch.column("h").to_numpy().view(U64) ^ mix(np.full(1, step + 1, U64))) >> U64(1)
        for v in ("t", "m"):
            p = sigmoid(logits(models[v], views[v]))
            for label, at in ((1, p >= sure), (0, p <= 1 - sure)):
                if label in trusted[v]:
                    yield v, label, at, order

    def count(batches):
        totals: dict[tuple[str, int], int] = {}
        for batch in batches:
            for v, label, at, _ in found(batch):
                totals[v, label] = totals.get((v, label), 0) + int(at.sum())
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in totals]), pa.array([k[1] for k in totals], pa.int32()), pa.array(list(totals.values()), pa.int64())], ["view", "label", "n"])

    counts = pool.mapInArrow(count, "view string, label int, n long").groupBy("view", "label").agg(F.sum("n").alias("n")).collect()
    below = {(r["view"], r["label"]): min(1.0, wanted[r["label"]] / r["n"]) * 2**63 for r in counts if r["n"]}

    def fetch(batches):
        for batch in batches:
            for v, label, at, order in found(batch):
                some = np.flatnonzero(at & (order < below.get((v, label), 0.0)))
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.string()), pa.array([label] * n, pa.int32()), *(batch.column(c).take(pa.array(some)) for c in ("h", "t", "source", "lang", "n_chars"))], ["view", "label", "h", "t", "source", "lang", "n_chars"])

    got = pool.mapInArrow(fetch, "view string, label int, h long, t binary, source int, lang int, n_chars double").toArrow().sort_by([("h", "ascending"), ("view", "ascending")]).combine_chunks()
    out = {}
    for v in ("t", "m"):
        rows = got.filter(pa.compute.equal(got.column("view"), v))
        out[_OTHER[v]] = (_views(rows), rows.column("h").to_numpy(), rows.column("label").to_numpy().astype(float))
    return out


def fit(table: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 10_000, rounds: int = 3, sure: float = 0.95, per_round: int = 1000, id_col: str = "doc_id") -> dict:
    """The model from ``table``, a table of :func:`features`, and ``labels`` (id, label 0 or 1).

    About ``sample_rows`` labelled rows at most are used; rows with a null label aren't. Pseudo-labels are drawn from
    all other rows, about ``per_round`` a round for each view. No labelled rows give 0.5 for all.
    """
    rows = labelled_rows(table, labels, label, sample_rows, id_col, "id")
    got = rows.select("label", crc_mod("id", 4).cast("int").alias("fold"), "id", "h", "t", "source", "lang", "n_chars").toArrow().sort_by([("id", "ascending"), ("h", "ascending")]).combine_chunks()
    views, y = _views(got), got.column("label").to_numpy().astype(float)
    own = got.column("fold").to_numpy() != 0
    if own.all() or not own.any() or len(y) < 50:
        own = np.ones(len(y), bool)
    rest = ~own if not own.all() else own
    train = {v: [x[own]] for v, x in views.items()}
    labelled = {v: [y[own]] for v in views}
    seen: dict[str, set] = {v: set() for v in views}
    # The labelled sample's ids: a bounded number.
    known = table.sparkSession.createDataFrame([(int(i),) for i in set(got.column("id").to_pylist())], "known long")
    pool = table.join(F.broadcast(known), F.col("id") == F.col("known"), "left_anti")
    share = float(y.mean()) if len(y) else 0.5
    wanted = {1: max(1, round(per_round * share)), 0: max(1, round(per_round * (1 - share)))}
    models: dict[str, dict] = {}
    for step in range(rounds + 1):
        for v in views:
            weight = np.concatenate([np.ones(len(labelled[v][0])), *(np.full(len(x), 0.5) for x in labelled[v][1:])])
            models[v] = fit_logistic(np.vstack(train[v]), np.concatenate(labelled[v]), weight=weight)
        if step == rounds or not len(y):
            break
        trusted = {v: _trusted(sigmoid(logits(models[v], x[rest])), y[rest], sure) for v, x in views.items()}
        for v, (x, h, label_of) in _drawn(pool, models, trusted, step, sure, wanted).items():
            new = np.array([k for k, name in enumerate(h.tolist()) if name not in seen[v] and not seen[v].add(name)], np.int64)  # each row is given once
            train[v].append(x[v][new])
            labelled[v].append(label_of[new])
    both = {v: logits(models[v], x[rest]) for v, x in views.items()}
    calibrated = {v: fit_logistic(z[:, None], y[rest]) for v, z in both.items()}
    stacked = np.stack([logits(calibrated[v], both[v][:, None]) for v in ("t", "m")], 1)
    return {**models, "calibrated": calibrated, "combined": fit_logistic(stacked, y[rest])}


def score(table: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id, text_score, meta_score, score) of every row of a table of :func:`features`: 0 to 1, higher is better."""
    shared = table.sparkSession.sparkContext.broadcast(model)  # two weights a feature

    def run(batches):
        model = shared.value
        for batch in batches:
            z = {v: logits(model[v], x) for v, x in _views(batch).items()}
            z = {v: logits(model["calibrated"][v], x[:, None]) for v, x in z.items()}
            p = sigmoid(logits(model["combined"], np.stack([z["t"], z["m"]], 1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigmoid(z["t"])), pa.array(sigmoid(z["m"])), pa.array(p)], ["id", "text_score", "meta_score", "score"])

    return table.mapInArrow(lean("quality", run), "id long, text_score double, meta_score double, score double").withColumnRenamed("id", id_col)
