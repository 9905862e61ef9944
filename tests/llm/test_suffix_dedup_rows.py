"""Repeated rows that a task meets in different blocks."""

import random

from lakeloom.llm import suffix_dedup


def test_copies_of_a_row_in_different_blocks(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = text(300)
    twice, after = (1, text(5_000)), (90, "x" + passage + "y")
    rows = [twice, (50, passage), after, *((100 + i, text(150_000)) for i in range(8)), twice, after]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.text) for r in suffix_dedup.remove(docs).collect())
    assert got == sorted((i, "xy" if i == 90 else t) for i, t in rows)
