"""Parts of the toxicity model against plain Python."""

import math
import random

from lakeloom.llm import toxicity


def test_only_near_copies_count_once(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=12))
    base = [word() for _ in range(100)]
    rows = [(0, " ".join(base)), (0, " ".join(base)), (0, " ".join([*base, "end"])), (1, " ".join([*base, "end"]))]
    far = []
    for _ in range(20):  # the first half shared: a similarity of a third
        far.append((0, " ".join([*base[:50], *(word() for _ in range(50))])))
    got = sorted(tuple(r) for r in toxicity._distinct(spark.createDataFrame([(i, *r) for i, r in enumerate([*rows, *far, (0, "..."), (0, ".")])], "id long, y int, text string")).collect())
    assert sorted(r for r in got if r in far) == sorted(far)
    rest = [r for r in got if r not in far]
    assert sorted(y for y, t in rest if "." not in t) == [0, 1] and len(rest) == 3


def test_token_scores():
    counts = [("bad", 30, 1), ("word", 50, 500), ("rare", 3, 0)]
    got = toxicity.token_scores(counts, 60, 600)
    prior = 660 / 20
    a = prior * 31 / 660
    odds = math.log((30 + a) / (60 + prior - 30 - a)) - math.log((1 + a) / (600 + prior - 1 - a))
    error = math.sqrt(1 / (30 + a) + 1 / (1 + a) + 1 / (60 + prior - 30 - a) + 1 / (600 + prior - 1 - a))
    assert set(got) == {"bad"} and abs(got["bad"] - (odds - 2.5 * error)) < 1e-12


def test_probability_of_segments():
    model = toxicity.Model({"bad": 2.0})
    model.rate, model.k, model.slope, model.offset = 1.5, 0.1, 2.0, -3.0
    n, found = model.find("so bad bad it is " + "fine " * 40 + "bad")
    assert found == [(1, 3, 4.0), (45, 46, 2.0)]
    surprise = sum(-math.log(p) for s in (4.0, 2.0) if (p := 0.1 * n * math.exp(-1.5 * s)) < 0.05)
    assert abs(model.surprise(n, found) - surprise) < 1e-9
    assert abs(model.probability(surprise) - 1 / (1 + math.exp(3.0 - 2.0 * math.log1p(surprise)))) < 1e-12


def test_bounded_sample(spark):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    got = toxicity.sample_labels(labels, "toxic", toxicity.F.lit(True), 1000).collect()
    assert 600 < len(got) <= 1000
