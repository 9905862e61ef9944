"""Search against scores of all documents, over small indexes and blocks, ties and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lakeloom.llm import lexical_search
from lakeloom.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, length = len(counted), sum(c[2] for c in counted)
    wanted = {}
    for item, text in queries:
        wanted.setdefault(item, set()).update(terms_of(text))
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, terms in wanted.items():
        hits = []
        for i, c, own in counted:
            m = 10 + 90 * own * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                hits.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(map(repr, out))


def got(frame):
    return sorted(repr((r.item, r.rank, r.id, r.score)) for r in frame.collect())


def made(spark, seed, many=400):
    """Zipf-like words, copies, and passages of the queries in some documents."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    queries = [(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(30)]
    docs = []
    for i in range(many):
        text = " ".join(word() for _ in range(rng.randint(1, 120)))
        if rng.random() < 0.1:
            text += ". " + rng.choice(queries)[1].upper()
        docs.append((i, rng.choice(docs)[1] if docs and rng.random() < 0.2 else text))
    return docs, queries, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id int, text string")


@pytest.mark.parametrize("postings", [40, 500, 10**6])
def test_small_and_large_indexes(spark, postings):
    docs, queries, d, q = made(spark, 1)
    assert got(search(d, q, postings=postings)) == brute(docs, queries)


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_other_depths(spark, k):
    docs, queries, d, q = made(spark, 2, 150)
    assert got(search(d, q, k=k)) == brute(docs, queries, k)


def test_blocks_of_queries(spark):
    docs, queries, d, q = made(spark, 3, 120)
    assert got(search(d, q, block_pairs=120)) == brute(docs, queries)
    pairs = lexical_search.query_terms(q)
    dealt = list(lexical_search.blocks(pairs, 120))
    assert len(dealt) > 1 and sorted(i for b in dealt for i, _ in b) == sorted({i for i, t in queries if terms_of(t)})
    assert all(len(b) == 1 or sum(len(t) for _, t in b) <= 120 for b in dealt)


def test_ties_and_odd_rows(spark):
    docs = [(5, "Alpha beta"), (3, "alpha BETA"), (3, "alpha BETA"), (None, "alpha, beta"), (9, None), (8, ""), (7, " ?!"), (1, "gamma"), (2, "Éa éa"), (4, "beta " * 50_000)] + [(k, "alpha beta") for k in range(20, 32)]
    queries = [("x", "ALPHA beta"), ("x", "gamma"), (None, "éa Éa"), (None, None), ("none", "zeta"), ("blank", "-- !"), ("y", "Alpha Alpha")]
    d = spark.createDataFrame([(*r, "a", 1, 2) for r in docs], "doc_id long, text string, id string, score int, n int")
    q = spark.createDataFrame([(*r, "t", 3) for r in queries], "item_id string, text string, term string, rank int")
    assert got(search(d, q, k=14)) == brute(docs, queries, 14)
    found = got(search(d, q))
    assert found == brute(docs, queries)
    assert sum("'y'" in r for r in found) == 10
    assert search(d.limit(0), q).collect() == search(d, q.limit(0)).collect() == []


def test_stops_before_the_end_and_completes():
    """With one rare term and one that stands everywhere, the second list is not read; the scores are whole all the same."""
    counts = [2 if i in (4, 50) else 1 for i in range(100)]
    terms = np.array([t for i in range(100) for t in ([0, 1] if i in (4, 50) else [1])])
    scores = np.array([s for i in range(100) for s in ([1000 + i, 7] if i in (4, 50) else [7])])
    index = lexical_search.Index(counts, terms, scores, 2)
    read = []
    index.docs = type("Read", (), {"__getitem__": lambda self, s, docs=index.docs: (read.append(s), docs[s])[1]})()
    docs, found = index.best(np.array([0, 1]), np.array([True, True]), 0, 2)
    assert dict(zip(docs.tolist(), found.tolist(), strict=True)) == {4: 1011, 50: 1057}
    assert len(read) == 1
