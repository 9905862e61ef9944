"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

Model. A token's score is the log-odds of its rate among toxic against other labelled texts
(a text counts once, however often it repeats the token), with an informative Dirichlet
prior: pseudo counts in proportion to the token's share of all labelled texts. A word's tokens are itself and its
stems (its first 3 to 8 letters). Scores are shrunk by their own standard error, so that
rare tokens say little, and the model keeps at most `MAX_TOKENS` tokens whose scores stay
positive; a word scores as the best of its tokens, or a small negative default. A short stem
can look toxic only because a toxic word begins with it, so tokens are counted again, each
word for its best token alone. Near copies (similarity of 0.8 or more, same
label) among the labelled texts count once.

Search. All maximal segments of a text's score sequence with a positive sum are found in
linear time (Ruzzo and Tompa). A text's statistic is how surprising its best segments are
among non-toxic texts: segment maxima of random texts follow an extreme-value law with
location log(K n) / lambda for n words, so exp(-lambda s) K n is the number of segments of
score s or more that chance brings. lambda solves the Karlin-Altschul equation for the
non-toxic score distribution, K is fitted on non-toxic texts; the expected numbers of the
text's significant segments are aggregated by Fisher's method into one number, which a
logistic curve fitted on labelled texts turns into a probability.

Spark. The classifier is fitted on at most `SAMPLE` labelled rows, those whose ids' hashes are
below a bound; with that bound the labels are broadcast, and only the texts of the sample
are shuffled; token counts are combined on the map side. Every document is scored in one pass, whole.

Defined cases: null and empty texts get the score of a text without segments; documents
with contradicting labels count as toxic; labels other than 0 and 1 are ignored; without
labelled rows of both classes every score is 0.5; a null id is held out like any id whose
remainder is 1; other columns are ignored by `score` and kept by `keep_clean`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import bounded_sample, logistic, mixed, shielded, shingles
from lakeloom.session import cut_lineage, small_batches

#: Bound of labelled rows that the classifier is fitted on, and of tokens it keeps.
SAMPLE = 40_000
MAX_TOKENS = 50_000
#: Labelled texts of one label whose three-word runs are so similar count once.
COPIES = 0.8
SKETCH = 128
#: How often tokens are counted again with each word credited to its best token.
CREDITED = 2
STEMS = (3, 4, 5, 6, 7, 8)
CACHED = 60_000
DEFAULT = -0.25
LIMIT = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments of positive sum, as (first, end, sum), in order: Ruzzo and Tompa's linear-time scan."""
    found: list[list] = []  # first, end, sum before it, sum at its end, previous with a smaller left sum
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def tokens_of(word: str) -> list[str]:
    """A word and its stems."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def _distinct(texts: DataFrame) -> DataFrame:
    """Of rows (id, y, text) one of each group of near copies with the same label, as (y, text).

    Rows that agree on a pair of MinHashes of their three-word runs meet; those whose sets are `COPIES`
    similar or more to the meeting's first row's go, by the `SKETCH` least hashes of both (exact
    for sets of no more). Four pairs in turn; all other rows stay. Texts are shuffled once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [], []
            for cell in batch.column(3):
                found = shingles([w.encode("utf-8", "surrogatepass") for w in words_of(cell.as_py())], 3)
                least = np.array([mixed(found ^ np.uint64(k)).min() if len(found) else 0 for k in range(1, 9)], np.uint64)
                keys.append(mixed(least[::2] * np.uint64(3) + mixed(least[1::2])).astype(np.int64))
                sets.append(np.sort(found.astype(np.int64))[:SKETCH])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))], names=["id", "h", "y", "keys", "found"])

    named = texts.select("id", F.xxhash64("text").alias("h"), "y", "text")
    rows = named.mapInArrow(run, "id long, h long, y int, keys array<long>, found array<long>")
    for k in range(4):
        met = Window.partitionBy("y", F.col("keys")[k]).orderBy("h", "id")
        rows = rows.select("*", F.row_number().over(met).alias("place"), F.first("found").over(met).alias("first"))
        least = F.slice(F.sort_array(F.array_union("found", "first")), 1, SKETCH)
        alike = F.size(F.array_intersect(least, F.array_intersect("found", "first"))) >= COPIES * F.size(least)
        rows = rows.filter((F.col("place") == 1) | ~alike).drop("place", "first")
    kept = cut_lineage(rows.select("id", "h"))
    return cut_lineage(named.join(F.broadcast(kept.distinct()), ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select("y", "text"))


def sample_labels(labels: DataFrame, label_col: str, training: Column, limit: int = SAMPLE) -> DataFrame:
    """At most `limit` labelled rows (doc_id, y), the same ones every time."""
    known = labels.filter(training & F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    one = known.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    return bounded_sample(one, "doc_id", limit)


def token_scores(counts: list[tuple[str, int, int]], n1: int, n0: int, errors: float = 2.5) -> dict[str, float]:
    """Shrunk log-odds by token from rows (token, toxic texts with it, other texts with it), of n1 toxic and n0 other texts.

    The prior counts as a twentieth of the texts.
    """
    found, prior = [], max(10.0, (n1 + n0) / 20)
    for token, k1, k0 in counts:
        a = prior * (k1 + k0) / (n1 + n0)
        odds = lambda k, n: math.log((k + a) / (n + prior - k - a))
        error = math.sqrt(1 / (k1 + a) + 1 / (k0 + a) + 1 / (n1 + prior - k1 - a) + 1 / (n0 + prior - k0 - a))
        lower = odds(k1, n1) - odds(k0, n0) - errors * error
        if lower > 0.1:
            found.append((lower, token))
    found.sort(reverse=True)
    return {t: s for s, t in found[:MAX_TOKENS]}


class Model:
    """Token scores, and what turns a text's segments into a probability."""

    def __init__(self, tokens: dict[str, float]) -> None:
        self.tokens = tokens
        self.cache: dict[str, float] = {}
        self.rate, self.k, self.slope, self.offset = 1.0, 1.0, 0.0, 0.0

    def scores(self, words: list[str]) -> list[float]:
        cache, get = self.cache, self.tokens.get
        if len(cache) > CACHED:
            cache.clear()
        out = []
        for w in words:
            s = cache.get(w)
            if s is None:
                s = cache[w] = max(get(t, DEFAULT) for t in tokens_of(w))
            out.append(s)
        return out

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        return len(words), segments(self.scores(words))

    def surprise(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Minus the log of the chance of segments as good, over all of the text's significant ones; 0 without any."""
        p = [min(1.0, self.k * max(n, 1) * math.exp(-self.rate * s)) for _, _, s in found]
        return sum(-math.log(max(x, 1e-300)) for x in p if x < 0.05)

    def probability(self, surprise: float) -> float:
        z = self.slope * math.log1p(surprise) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def fit(self, scored: Counter, maxima: list[tuple[int, int, list[tuple[int, int, float]]]]) -> None:
        """scored: how often each token score stands in non-toxic texts; maxima: label, words and segments of labelled texts."""
        total = sum(scored.values())
        low, high = 1e-4, 50.0  # the positive root of E[exp(rate * score)] = 1
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(c * math.exp(min(mid * s, 60)) for s, c in scored.items()) < total else (low, mid)
        self.rate = low if any(s > 0 for s in scored) else 1.0
        clean = [(n, max((s for _, _, s in found), default=0.0)) for y, n, found in maxima if y == 0 and n]
        # of n words, exp(-K n exp(-rate s)) have no segment above s: K by the method of maximum likelihood
        none = sum(1 for _, s in clean if s <= 0)
        weights = [n * math.exp(-self.rate * s) for n, s in clean]
        self.k = max(1e-9, (len(clean) - none + 1) / (sum(weights) + 1)) if len(clean) > none else 1 / (1 + sum(n for n, _ in clean))
        x = np.array([math.log1p(self.surprise(n, found)) for _, n, found in maxima])
        y = np.array([t for t, _, _ in maxima], float)
        self.slope, self.offset = map(float, logistic(x, y))


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows for which `training` (a condition on the labels' doc_id) holds."""
    small_batches(docs.sparkSession)
    sample = sample_labels(labels, label_col, F.lit(True) if training is None else training).withColumnRenamed("doc_id", "__id")
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id").select(F.col("__id").alias("id"), "y", F.coalesce("__text", F.lit("")).alias("text"))
    texts = _distinct(texts)
    names = ["token", "k1", "k0"]

    def counted(known: dict[str, float] | None) -> DataFrame:
        """Texts with each token, by label; with known scores a word counts for its best token alone."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: dict[str, list[int]] = {"": [0, 0]}

            def taken() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*n.values(), strict=True))], names=names)

            for batch in batches:
                for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    tokens = {""}
                    for word in set(words_of(text.as_py())):
                        own = tokens_of(word)
                        tokens.update(own if known is None else [best] if (best := max(own, key=lambda t: known.get(t, 0.0))) in known else ())
                    for t in tokens:
                        row = n.get(t)
                        if row is None:
                            row = n[t] = [0, 0]
                        row[1 - y] += 1
                if len(n) > 60_000:
                    yield taken()
                    n = {"": [0, 0]}
            yield taken()

        return texts.mapInArrow(count, "token string, k1 long, k0 long").groupBy("token").agg(*[F.sum(c).alias(c) for c in names[1:]])

    known = None
    for _ in range(1 + CREDITED):
        counts = cut_lineage(counted(known))
        totals = counts.filter(F.col("token") == "").select("k1", "k0").collect()
        n1, n0 = (int(totals[0][0]), int(totals[0][1])) if totals else (0, 0)
        if not n1 or not n0:
            return Model({})
        # No more tokens come back than the model can use: those that are most frequent in toxic texts against others.
        better = counts.filter((F.col("token") != "") & (F.col("k1") >= 3) & (F.col("k1") * n0 > F.col("k0") * n1))
        rows = better.orderBy(F.desc(F.col("k1") / (F.col("k1") + F.col("k0") + 5)), "token").limit(2 * MAX_TOKENS).collect()
        known = token_scores([tuple(r) for r in rows], n1, n0)
    model = Model(known)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                scores = model.scores(words)
                found = segments(scores)
                n = Counter(scores)
                out.append((y, len(words), [x for _, _, x in found], [s for s in n if s > 0], [n[s] for s in n if s > 0]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())), strict=True)], names=["y", "n", "segments", "scores", "counts"])

    # One small row for each sampled document: its word count and the few scores above the default.
    scored, maxima = Counter(), []
    described = cut_lineage(texts.mapInArrow(describe, "y int, n long, segments array<double>, scores array<double>, counts array<long>"))
    for r in described.toLocalIterator():
        maxima.append((r["y"], r["n"], [(0, 0, s) for s in r["segments"]]))
        if not r["y"]:
            scored.update(dict(zip(r["scores"], r["counts"], strict=True)))
            scored[DEFAULT] += r["n"] - sum(r["counts"])
    model.fit(scored, maxima)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with `__score` (0 to 1) and `__passages`, the word ranges of significant toxic segments with their sums."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    at = docs.columns.index(text_col)
    passage = "array<struct<first:int,end:int,sum:double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("sum", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            values, passages = [], []
            for text in batch.column(at):
                n, found = m.find(text.as_py())
                values.append(m.probability(m.surprise(n, found)))
                limit = math.log(m.k * max(n, 1) / 0.05) / m.rate
                passages.append([{"first": a, "end": b, "sum": s} for a, b, s in found if s > limit])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64()), pa.array(passages, kind)], names=[*batch.schema.names, "__score", "__passages"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType()), *T._parse_datatype_string(f"__passages {passage}").fields])
    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """`docs` without those that score `limit` or more."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    plain, names = shielded(docs)
    return score(plain, model, names["text"]).filter(F.col("__score") < limit).select(*plain.columns).toDF(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= LIMIT).cast("int").alias("predicted"), F.size("__passages").cast("long").alias("n_passages"))
