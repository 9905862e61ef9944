"""Links between members of one star, held against all pairs."""

import random

import numpy as np
import pytest
import zstandard

from lakeloom.llm import near_dedup
from lakeloom.llm.common import shingles


@pytest.mark.parametrize("members", [2, 5])
def test_links_beside_a_far_centre(spark, members):
    rng = random.Random(members)
    texts, stars = {}, []
    for hub, like in enumerate((0.3, 0.35, 0.4, 0.45, 0.5, 0.55)):
        center = [f"c{hub}x{i}" for i in range(500)]
        texts[hub * 100] = " ".join(center)
        shared = int(1000 * like / (1 + like))
        for family in range(2):
            base = center[:shared] + [f"f{hub}x{family}x{i}" for i in range(500 - shared)]
            for member in range(members):
                words = list(base)
                for at in rng.sample(range(shared, 500), 3):
                    words[at] = f"e{rng.random()}"
                node = hub * 100 + 1 + family * 50 + member
                texts[node] = " ".join(words)
                stars.append((hub * 100, node))
    sets = {i: shingles(near_dedup.words_of(t), near_dedup.WORDS) for i, t in texts.items()}
    wanted = set()
    for i in texts:
        for j in texts:
            if i < j and i // 100 == j // 100:
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= near_dedup.PERCENT * (len(sets[i]) + len(sets[j]) - both):
                    wanted.add((i, j))
    assert len(wanted) == 12 * members * (members - 1) // 2
    packed = [(i, len(sets[i]), bytearray(zstandard.ZstdCompressor().compress(t.encode()))) for i, t in texts.items()]
    contents = spark.createDataFrame(packed, "node long, n long, packed binary")
    roots = spark.createDataFrame([], "node long, root long")
    across = near_dedup._beside(spark.createDataFrame(stars, "a long, b long"), roots, contents, near_dedup.PERCENT)
    assert {tuple(r) for r in across.collect()} >= wanted
    assert {tuple(r) for r in near_dedup._linked(across, contents, near_dedup.PERCENT).select("a", "b").collect()} == wanted


def test_pairs_are_planned_once(spark):
    """What pairs come from is no part of the plans that follow, as each use of them would repeat it on the driver."""
    pairs = spark.createDataFrame([(2, 1), (2, 3)], "a long, b long").join(spark.range(5).withColumnRenamed("id", "a"), "a")
    roots = spark.createDataFrame([(1, 1)], "node long, root long")
    contents = spark.createDataFrame([(1, 1, b"x")], "node long, n long, packed binary")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert max(joins(near_dedup._with_contents(pairs, contents)), joins(near_dedup._differences(pairs, roots, contents)), joins(near_dedup._linked(pairs, contents, 75))) <= 4


def test_texts_of_stars_meet_once(spark, monkeypatch):
    """Each step deals all rows out anew, however small they are: stars are compared once, links beside them once more, and edges that are stars already are written once."""
    calls = []
    for name in ("_with_contents", "cut_lineage"):
        monkeypatch.setattr(near_dedup, name, lambda *a, f=getattr(near_dedup, name), n=name, **k: calls.append(n) or f(*a, **k))
    edges = spark.createDataFrame([(5, 1), (1, 7), (9, 2), (3, 3), (7, 1)], "a long, b long")
    assert {tuple(r) for r in near_dedup.connected(edges).collect()} == {(5, 1), (7, 1), (9, 2)}
    assert calls == ["cut_lineage"]
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:at], f"x{at}", *words[at + 1 :]]) for at in (0, 1, 59)]
    rows = [(4, " ".join(words)), (3, near[0]), (8, near[1]), (8, near[1]), (6, near[2]), (1, "quite another text of some words"), (None, " ".join(words)), (2, None)]
    got = sorted(((r.id, r.component_id) for r in near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(4, 3), (3, 3), (8, 3), (8, 3), (6, 3), (1, 1), (None, 3), (2, 2)], key=str)
    assert calls.count("_with_contents") <= 2 and calls.count("cut_lineage") <= 19
