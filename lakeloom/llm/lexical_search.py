"""Ranked lexical search, score at a time over postings in order of impact.

A first pass reads every text and keeps, for each document, its length and the counts of the
terms that some query holds (numbers, no text). From this table come the number of documents,
their length and each term's frequency. The second pass makes, from each run of documents that a
task reads, an index of bounded size: for each term its postings in falling order of impact,
cut into groups of exactly equal impact. Documents are not shuffled, so neither hot terms nor
hot sources matter; what tasks send on is the best few of each query.

A query takes whole groups from the top of its terms' lists, highest impacts first, and adds
them up by document. What the next group of a list offers bounds what that term can still add
to any document; the sum of these bounds is what a document not seen yet can reach. Once this is less
than the k-th best score so far (of this task's documents, earlier runs included), the k best
are among those seen, and those whose sum and bound reach that score are completed from their
own terms. Equal scores are never cut off, so ties are settled by id.

Queries are taken in blocks of at most `BLOCK_PAIRS` (query, term) pairs (or one query), whose
terms are broadcast; a further block is a further pass.

Scores are whole numbers as documented at `impacts`. Defined cases: null and empty texts have no
terms; documents without terms do not count; a query without terms, or none of whose terms
stands anywhere, has no rows; texts of queries with equal ids (null is one) are one query; equal
document rows each have a rank; a null document id comes after others of its score; empty tables
give none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakeloom.llm.common import ascii_lower
from lakeloom.llm.decontaminate import words_of
from lakeloom.session import cut_lineage, small_batches

BEST = 10
BLOCK_PAIRS = 200_000
#: Postings of one index in a task.
POSTINGS = 1_000_000
#: A step takes the groups from the highest impact left down to this part of it.
STEP = 0.7
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct `item` and `term`, one row each."""
    terms = F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(TERM), F.lit(0)))
    return queries.select(F.col(id_col).alias("item"), terms.alias("term")).distinct()


def blocks(pairs: DataFrame, most: int = BLOCK_PAIRS) -> Iterator[list[tuple[object, list[str]]]]:
    """Queries and their terms in blocks of at most `most` pairs, or of one query."""
    stored = cut_lineage(pairs)
    per_item = stored.groupBy("item").count()
    number = max(1, math.ceil(stored.count() / most))
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(number))
        over = per_item.groupBy(block.alias("block")).agg(F.sum("count").alias("pairs"), F.count(F.lit(1)).alias("items")).filter((F.col("pairs") > most) & (F.col("items") > 1))
        if not over.limit(1).count():
            break
        number *= 2
    for k in range(number):
        found = stored.filter(block == k).groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms")).collect()
        if found:
            yield [(r["item"], r["terms"]) for r in sorted(found, key=lambda r: repr(r["item"]))]


def term_counts(docs: DataFrame, shared: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, the number of terms `n`, and the numbers (`terms`) and counts (`times`) of the terms that queries hold, for documents with terms."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            lengths, terms, times = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                known = np.fromiter(map(number.get, words, [-1] * len(words)), np.int32, len(words))
                own, often = np.unique(known[known >= 0], return_counts=True)
                lengths.append(len(words))
                terms.append(own)
                times.append(often.astype(np.int32))
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["id", "n", "terms", "times"])
            yield found.filter(pa.array([n > 0 for n in lengths], pa.bool_()))

    return rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms array<int>, times array<int>")


def weights(counted: DataFrame, documents: int, terms: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) for each of the block's terms; 0 for one that stands nowhere."""
    found = np.zeros(terms, np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        found[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1)))
    return found


def impacts(weight: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
    """w * ((1000000000 tf) div (1000 tf + 8 m)), in 64-bit whole numbers; m is 10 + (90 n N) div L."""
    return weight * (1_000_000_000 * times // (1000 * times + 8 * length))


class Index:
    """Postings of some documents: by term in falling order of impact, in groups of equal impact, and by document."""

    def __init__(self, counts: list[int], terms: np.ndarray, scores: np.ndarray, vocabulary: int) -> None:
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.terms, self.scores = terms, scores
        order = np.lexsort((-scores, terms))
        self.docs = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order]
        by_term, by_impact = terms[order], scores[order]
        heads = np.flatnonzero(np.concatenate(([True], (by_term[1:] != by_term[:-1]) | (by_impact[1:] != by_impact[:-1])))) if len(order) else np.empty(0, np.int64)
        self.falling = -by_impact[heads]  # one number for each group, rising within a term
        self.bounds = np.append(heads, len(order))  # a group's postings
        self.groups = np.searchsorted(by_term[heads], np.arange(vocabulary + 1))  # a term's groups

    def best(self, terms: np.ndarray, wanted: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (by place) that may be among the `k` best, and their scores; none with a score below `floor`, which k known ones reach."""
        at, end = self.groups[terms], self.groups[terms + 1]
        live = at < end
        at, end = at[live].tolist(), end[live].tolist()
        sums = np.zeros(len(self.starts), np.int64)
        while True:
            offers = [-int(self.falling[a]) if a < e else 0 for a, e in zip(at, end, strict=True)]
            rest, top = sum(offers), max(offers, default=0)
            if not rest or rest < floor:
                break
            line, taken = -(top * STEP), []
            for t, (a, e) in enumerate(zip(at, end, strict=True)):
                if offers[t] >= -line and a < e:
                    at[t] = a + int(np.searchsorted(self.falling[a:e], line, "right"))
                    lo, hi = self.bounds[a], self.bounds[at[t]]
                    taken.append((self.docs[lo:hi], np.repeat(-self.falling[a : at[t]], np.diff(self.bounds[a : at[t] + 1]))))
            for docs, scores in taken:  # a term has a document once
                sums[docs] += scores
            if len(sums) >= k:
                floor = max(floor, int(np.partition(sums, len(sums) - k)[-k]))
        chosen = np.flatnonzero((sums > 0) & (sums + rest >= floor))
        if not rest or not len(chosen):
            return chosen, sums[chosen]
        sizes = self.ends[chosen] - self.starts[chosen]
        places = np.repeat(self.starts[chosen] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        own = np.where(wanted[self.terms[places]], self.scores[places], 0)
        return chosen, np.add.reduceat(own, np.concatenate(([0], np.cumsum(sizes)[:-1])))


def _order(hit: tuple[int, object]) -> tuple:
    score, doc = hit
    return -score, doc is None, doc if doc is not None else 0


def search_counted(counted: DataFrame, items: list[tuple[object, list[int]]], weight: np.ndarray, documents: int, length: int, k: int, item_type, postings: int = POSTINGS) -> DataFrame:
    """`item`, `id` and `score` of the `k` best of each task's documents for each query."""
    id_type = counted.schema["id"].dataType
    task_items = counted.sparkSession.sparkContext.broadcast(([i for i, _ in items], [np.array(t, np.int64) for _, t in items], weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, weight = task_items.value
        best: list[list[tuple[int, object]]] = [[] for _ in names]
        ids, ns, counts, terms, times, held = [], [], [], [], [], 0

        def settle() -> None:
            own, often = np.concatenate(terms), np.concatenate(times).astype(np.int64)
            m = np.array([10 + 90 * n * documents // length for n in ns], np.int64)
            index = Index(counts, own, impacts(weight[own], often, np.repeat(m, counts)), len(weight))
            wanted = np.zeros(len(weight), bool)
            for q, query in enumerate(queries):
                wanted[query] = True
                floor = best[q][-1][0] if len(best[q]) == k else 0
                docs, scores = index.best(query, wanted, floor, k)
                wanted[query] = False
                if len(scores) > k:
                    keep = scores >= np.partition(scores, len(scores) - k)[-k]
                    docs, scores = docs[keep], scores[keep]
                hits = [(s, ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True) if s > 0]
                if hits:
                    best[q] = sorted(best[q] + hits, key=_order)[:k]

        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                ids += part.column(0).to_pylist()
                ns += part.column(1).to_pylist()
                counts += part.column(2).value_lengths().to_pylist()
                terms.append(part.column(2).flatten().to_numpy())
                times.append(part.column(3).flatten().to_numpy())
                held += len(terms[-1])
                if held >= postings:
                    settle()
                    ids, ns, counts, terms, times, held = [], [], [], [], [], 0
        if held:
            settle()
        found = [(names[q], doc, score) for q, hits in enumerate(best) for score, doc in hits]
        if found:
            kinds = to_arrow_type(item_type), to_arrow_type(id_type), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["item", "id", "score"])

    return counted.select("id", "n", "terms", "times").mapInArrow(search, f"item {item_type.simpleString()}, id {id_type.simpleString()}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_pairs: int = BLOCK_PAIRS, postings: int = POSTINGS) -> DataFrame:
    """`item`, `rank` from 1, `id` and `score`: the `k` best of `docs` for each query."""
    spark = docs.sparkSession
    small_batches(spark)
    item_type = queries.schema[item_col].dataType
    id_type = docs.schema[id_col].dataType
    found = spark.createDataFrame([], f"item {item_type.simpleString()}, id {id_type.simpleString()}, score long")
    for block in blocks(query_terms(queries, item_col), block_pairs):
        number = {term: n for n, term in enumerate(sorted({t for _, terms in block for t in terms}))}
        shared = spark.sparkContext.broadcast({term.encode(): n for term, n in number.items()})
        counted = cut_lineage(term_counts(docs, shared, id_col, text_col))
        documents, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        weight = weights(counted, documents, len(number))
        items = [(item, [number[t] for t in terms]) for item, terms in block]
        found = found.unionByName(search_counted(counted, items, weight, documents, length, k, item_type, postings))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "rank", "id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS t FROM documents),
g AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark)),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
m AS (SELECT k, doc_id, 10 + (90 * len(t) * docs) // length AS m FROM d, g WHERE len(t) > 0),
s AS (SELECT item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY item_id, k),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s JOIN m USING (k) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10"""
