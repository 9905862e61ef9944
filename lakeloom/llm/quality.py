"""Quality by co-training: a text view and a metadata view teach each other.

Views. The text view sees a document's words and how they are written: hashed words, shares of
kinds of characters, repetition. The metadata view sees what stands beside the text: language,
source, size and number of lines. Both are sets of features, numbered from 0 to `FEATURES`.

Model of a view. A feature weighs the log-odds of its rate among good against bad documents,
shrunk by its standard error (0 if that leaves nothing). A document's sum of weights becomes a
probability by a logistic curve fitted on labelled documents.

Rounds. The labelled documents train both views. In each of `ROUNDS` rounds all documents are
read: where one view is sure (probability of at least `SURE` or at most its complement) of a document
without a label, that verdict counts as a label for the other view, and the weights are
counted anew. At the end both views' log-odds are combined by a logistic fit on labelled documents.

Spark. A task keeps two small arrays of counts, whatever it reads; their sums are grouped by
feature, so nothing that is shuffled or comes to the driver grows with the corpus but the
number of tasks' arrays. Labels are used from at most `SAMPLE` rows, those whose ids' hashes are
below a bound, which go to all tasks by broadcast. Texts are never shuffled.

Defined cases: null and empty texts have no words and are judged by what else is known; a null
language, source or size is a feature of its own; documents with contradicting labels count
as bad; labels other than 0 and 1 are ignored; without labelled rows of both classes every
score is 0.5; a null id is held out; missing metadata columns count as null; other columns
are ignored by `score` and kept by `keep_good`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import bounded_sample, logistic, shielded
from lakeloom.llm.toxicity import held_out

FEATURES = 1 << 16
ROUNDS = 2
SURE = 0.9
SAMPLE = 40_000
LIMIT = 0.5
SCORE = "__score"

_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", *(bytes([c]) for c in b"!#$%&*|.,?:;-_/<>()@")]
_KIND_OF = np.full(256, len(_KINDS), np.int64)
for _k, _bytes in enumerate(_KINDS):
    _KIND_OF[list(_bytes)] = _k


def _named(*names: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(n.encode()) % FEATURES for n in names], np.int64)


def _level(share: float) -> int:
    """Shares in steps that double: 0, up to 1/512, ... up to 1."""
    return 0 if share <= 0 else max(1, 10 + math.ceil(math.log2(share)))


def text_features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return _named("no words")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    features = np.unique(hashes % np.uint64(FEATURES)).astype(np.int64)
    kinds = np.bincount(_KIND_OF[np.frombuffer(raw, np.uint8)], minlength=len(_KINDS) + 1) / len(raw)
    lines = raw.split(b"\n")
    shares = {f"kind {k}": s for k, s in enumerate(kinds.tolist())}
    shares["distinct words"] = len(set(words)) / len(words)
    shares["repeated words"] = float((hashes[1:] == hashes[:-1]).mean()) if len(words) > 1 else 0.0
    shares["distinct lines"] = len(set(lines)) / len(lines)
    shares["word length"] = min(1.0, len(raw) / len(words) / 64)
    return np.unique(np.concatenate((features, _named(*(f"{k} {_level(s)}" for k, s in shares.items())))))


def metadata_features(lang: str | None, source: str | None, size: int | None, lines: int) -> np.ndarray:
    log = lambda n: -1 if n is None else int(n).bit_length()
    return np.unique(_named(f"lang {lang}", f"source {source}", f"size {log(size)}", f"lines {log(lines)}", f"size {log(size)} lang {lang}", f"size {log(size)} lines {log(lines)}"))


@dataclass
class View:
    """Weights of features, and the logistic curve that makes a probability of their sum."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    slope: float = 0.0
    offset: float = 0.0

    @classmethod
    def of(cls, good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int, prior: float = 2.0, errors: float = 2.0) -> View:
        share = (good + bad + 0.5) / (n_good + n_bad + 1)
        a = prior * share
        odds = lambda k, n: np.log((k + a) / (n + prior - k - a))
        error = np.sqrt(1 / (good + a) + 1 / (n_good + prior - good - a) + 1 / (bad + a) + 1 / (n_bad + prior - bad - a))
        raw = odds(good, n_good) - odds(bad, n_bad)
        weights = np.sign(raw) * np.maximum(0, np.abs(raw) - errors * error)
        weights[good + bad == 0] = 0
        return cls(weights)

    def total(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum())

    def logit(self, total: float) -> float:
        return max(-30.0, min(30.0, self.slope * total + self.offset))


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray

    def probability(self, t: float, m: float) -> float:
        z = self.mix[0] * self.text.logit(t) + self.mix[1] * self.meta.logit(m) + self.mix[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    of = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    size = F.coalesce(of("n_chars", "long"), F.length(F.col(text_col)).cast("long"))
    return [F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), of("lang", "string").alias("__lang"), of("source", "string").alias("__source"), size.alias("__size")]


def _features(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text, lang, source, size in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
        yield text_features(text), metadata_features(lang, source, size, (text or "").count("\n"))


def _counts(rows: DataFrame, model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts by feature: text good, text bad, metadata good, metadata bad; and the numbers of documents in that order. `rows` end with y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value if model is not None else None
        sums = np.zeros((4, FEATURES + 1), np.int64)
        for batch in batches:
            for y, (t, d) in zip(batch.column(5).to_pylist(), _features(batch), strict=True):
                for_text = for_meta = y
                if y is None and m is not None:
                    sure = math.log(SURE / (1 - SURE))
                    zt, zm = m.text.logit(m.text.total(t)), m.meta.logit(m.meta.total(d))
                    for_meta = None if abs(zt) < sure else int(zt > 0)
                    for_text = None if abs(zm) < sure else int(zm > 0)
                if for_text is not None:
                    sums[1 - for_text, t] += 1
                    sums[1 - for_text, FEATURES] += 1
                if for_meta is not None:
                    sums[3 - for_meta, d] += 1
                    sums[3 - for_meta, FEATURES] += 1
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(s[used], pa.int64()) for s in sums)], names=["feature", "tg", "tb", "mg", "mb"])

    names = ["tg", "tb", "mg", "mb"]
    counted = rows.mapInArrow(run, "feature int, tg long, tb long, mg long, mb long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in names])
    found = counted.toPandas()  # at most FEATURES + 1 rows
    sums = np.zeros((4, FEATURES + 1))
    for k, c in enumerate(names):
        sums[k, found["feature"].to_numpy(np.int64)] = found[c].to_numpy(np.float64)
    return *sums[:, :FEATURES], sums[:, FEATURES]


def _calibrated(text: View, meta: View, labelled: DataFrame) -> Model:
    """Curves of both views and of their mix, fitted on the labelled documents' sums (two numbers of each)."""
    shared = labelled.sparkSession.sparkContext.broadcast((text, meta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        for batch in batches:
            sums = [(a.total(t), b.total(d)) for t, d in _features(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(5), pa.array([s[0] for s in sums], pa.float64()), pa.array([s[1] for s in sums], pa.float64())], names=["y", "t", "m"])

    found = labelled.mapInArrow(run, "y int, t double, m double").toPandas()
    y, t, m = (found[c].to_numpy(np.float64) for c in ("y", "t", "m"))
    (text.slope, text.offset), (meta.slope, meta.offset) = (map(float, logistic(v, y)) for v in (t, m))
    z = np.column_stack(([text.logit(v) for v in t], [meta.logit(v) for v in m]))
    return Model(text, meta, logistic(z, y))


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, label_col: str = "quality", rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on labelled rows for which `training` (a condition on the labels' doc_id) holds; None without both classes."""
    known = labels.filter((F.lit(True) if training is None else training) & F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    sample = bounded_sample(known.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y")), "doc_id", SAMPLE)
    sample = F.broadcast(sample.withColumnRenamed("doc_id", "__id"))
    rows = docs.select(*_inputs(docs, id_col, text_col))
    columns = ("__id", "__text", "__lang", "__source", "__size", "y")
    labelled = rows.join(sample, "__id").select(*columns)
    every = rows.join(sample, "__id", "left").select(*columns)
    model, views = None, None
    for k in range(rounds + 1):
        shared = docs.sparkSession.sparkContext.broadcast(model) if model else None
        tg, tb, mg, mb, n = _counts(every if k else labelled, shared)
        if not n.all():
            return model
        views = View.of(tg, tb, n[0], n[1]), View.of(mg, mb, n[2], n[3])
        model = _calibrated(*views, labelled)
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `__score`, the probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain, names = shielded(docs)
    columns = plain.columns
    whole = docs.select(*_inputs(docs, id_col, text_col), *[F.col(c).alias(k) for c, k in names.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            values = [0.5 if m is None else m.probability(m.text.total(t), m.meta.total(d)) for t, d in _features(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[5:], pa.array(values, pa.float64())], names=[*columns, "__score"])

    scored = whole.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("__score", T.DoubleType())]))
    return scored.toDF(*docs.columns, SCORE)


def keep_good(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """`docs` without those whose score is below `limit`."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    scored = score(docs, model)
    plain = scored.toDF(*shielded(docs)[0].columns, SCORE)
    return plain.filter(F.col(SCORE) >= limit).drop(SCORE).toDF(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= LIMIT).cast("int").alias("predicted"))
