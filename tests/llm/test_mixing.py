"""Targets against plain Python, copies against their bounds, expectations and reruns."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from lakeloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted_targets(sizes, share=Fraction(3, 2), weights=(3, 1, 2), most=2):
    """Exact targets: share what is left by weight among those below their limit until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        unit = (left - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * unit > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s] if s in full else weight[s] * unit) for s in order}
        full |= over


def check(rows, docs, error):
    """Rows of the result against the documents (id, text, source)."""
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    of_source = defaultdict(int)
    for n, (_, _, s) in zip(size, docs, strict=True):
        of_source[s] += n
    goals = wanted_targets(of_source)
    assert sorted(map(repr, ((r.id, r.source, r.size, r.source_size) for r in rows))) == sorted(map(repr, ((i, s, n, of_source[s]) for n, (i, _, s) in zip(size, docs, strict=True))))
    taken = defaultdict(int)
    for r in rows:
        assert abs(r.target - goals[r.source]) <= 1e-9 * max(1, goals[r.source])
        assert 0 <= r.copies <= 2 and abs(r.copies - goals[r.source] / max(1, of_source[r.source])) < 1 + 1e-6 or not r.size
        taken[r.source] += r.size * r.copies
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= error(s), (s, taken[s], goal)


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = mixing.op12_mixing(spark, sf_dir).withColumnRenamed("doc_id", "id").join(spark.createDataFrame([(i, s) for i, _, s in docs], "id long, source string"), "id").withColumn("copies", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("long")).collect()
    check(rows, docs, lambda s: 0.03 * sum(len(t) for _, t, x in docs if x == s) / 5)


def made(spark, seed=1, many=3000, hot=0.4):
    rng = random.Random(seed)
    docs = [(i, "w " * (1 + int(rng.paretovariate(1.1)) % 800), "hot" if rng.random() < hot else rng.choice(["b", "é", "Z", "", None, "𝄞", "￿"])) for i in range(many)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, source string")


def test_levels_of_the_tree(spark):
    """Small buckets make three levels; what a source misses is below one document."""
    docs, frame = made(spark)
    rows = mixing.mix(frame, rows=16, fan=4).collect()
    largest = defaultdict(int)
    for _, t, s in docs:
        largest[s] = max(largest[s], len(t) // 2)
    check(rows, docs, lambda s: largest[s])


def test_reruns_agree_however_rows_are_dealt(spark):
    _, frame = made(spark, many=800)
    key = lambda df: sorted(map(repr, df.collect()))
    first = key(mixing.mix(frame, rows=64, fan=4))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert key(mixing.mix(frame.orderBy(F.rand(3)).repartition(9), rows=64, fan=4)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert key(mixing.mix(frame, rows=64, fan=4, seed=5)) != first


def test_expected_copies(spark):
    """Over many seeds, documents of a source get their source's quotient on average."""
    docs = [(i, "w " * (3 + i % 7), "a" if i % 2 else "b") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    sums, runs = Counter(), 6
    for seed in range(runs):
        for r in mixing.mix(frame, rows=16, fan=4, seed=seed).collect():
            sums[r.source] += r.copies / runs / 30
            goal = r.target / r.source_size
            assert int(goal) <= r.copies <= int(goal) + 1
    goals = {r.source: r.target / r.source_size for r in mixing.mix(frame).collect()}
    assert all(abs(sums[s] - goals[s]) < 0.04 for s in goals)


def test_meeting_keeps_words_and_expectation():
    rng = random.Random(2)
    for _ in range(300):
        a, b, p, q = rng.randint(1, 50), rng.randint(1, 50), rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99)
        ends = [mixing.meet(a, p, b, q, c / 4000) for c in range(4000)]
        for x, y in (ends[0], ends[-1]):
            assert abs(a * x + b * y - a * p - b * q) < 1e-9 and (x in (0.0, 1.0) or y in (0.0, 1.0)) and 0 <= x <= 1 and 0 <= y <= 1
        assert abs(np.mean([x for x, _ in ends]) - p) < 2e-3 and abs(np.mean([y for _, y in ends]) - q) < 2e-3


def test_settling_lands_near_the_sum():
    rng = random.Random(3)
    for _ in range(100):
        sizes = np.array([rng.randint(1, 400) for _ in range(rng.randint(1, 60))])
        parts = np.array([rng.random() for _ in sizes])
        whole = mixing.settle(sizes, parts, [rng.random() for _ in sizes])
        assert set(whole) <= {0.0, 1.0}
        assert abs(sizes @ whole - sizes @ parts) <= sizes.max() / 2 + 1e-6
        if len(sizes) > 30:
            assert abs(sizes @ whole - sizes @ parts) <= 30


def test_odd_rows(spark):
    """Null, empty, white and repeated rows, equal ids with other texts, null sources, clashing columns."""
    rows = [(None, "a b c", None)] * 3 + [(1, None, "s"), (1, "", "s"), (2, " \t\n\x0b\x0c\r ", "s"), (3, "x", "s"), (3, "x", "s"), (3, "y z", "s"), (4, "w " * 5000, "t"), (5, "é é  ", "t")]
    frame = spark.createDataFrame([(*r, "k", "c", 1) for r in rows], "doc_id long, text string, source string, key string, copies string, many int")
    check(mixing.mix(frame).collect(), rows, lambda s: 2501)
    assert mixing.mix(frame.limit(0)).collect() == []
    blank = mixing.mix(frame.filter("doc_id = 2")).collect()
    assert [(r.size, r.source_size, r.target) for r in blank] == [(0, 0, 0.0)]


def test_many_equal_rows(spark, monkeypatch):
    """A third of all rows alike: rounded as one group and written out in chunks."""
    monkeypatch.setattr(mixing, "CHUNK", 100)
    rows = [(7, "a b c d", "s")] * 1000 + [(i, "w " * (1 + i % 9), "s" if i % 2 else "t") for i in range(100, 1600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, rows=128, fan=4).collect()
    check(got, rows, lambda s: 9)
    assert len([r for r in got if r.id == 7]) == 1000
