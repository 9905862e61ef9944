"""One round of co-training against plain Python."""

import math
from collections import Counter

import numpy as np

from lakeloom.llm import quality


def weights(good: Counter, bad: Counter, n_good: int, n_bad: int) -> dict[int, float]:
    found = {}
    for f in good.keys() | bad.keys():
        a = 2.0 * (good[f] + bad[f] + 0.5) / (n_good + n_bad + 1)
        parts = (good[f] + a, n_good + 2.0 - good[f] - a, bad[f] + a, n_bad + 2.0 - bad[f] - a)
        raw = math.log(parts[0] / parts[1]) - math.log(parts[2] / parts[3])
        size = abs(raw) - 2.0 * math.sqrt(sum(1 / p for p in parts))
        if size > 0:
            found[f] = math.copysign(size, raw)
    return found


def counted(rows):
    """Weights from (features, y)."""
    sums, n = (Counter(), Counter()), [0, 0]
    for features, y in rows:
        sums[y].update(features.tolist())
        n[y] += 1
    return weights(sums[1], sums[0], n[1], n[0])


def same(view, wanted):
    assert set(np.flatnonzero(view.weights).tolist()) == set(wanted)
    assert all(abs(view.weights[f] - w) < 1e-9 for f, w in wanted.items())


def test_views_label_for_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("doc_id % 3 <> 0")
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    rows = []
    for r in docs.collect():
        size = r.n_chars if r.n_chars is not None else len(r.text or "")
        rows.append((known.get(r.doc_id), quality.text_features(r.text), quality.metadata_features(r.lang, r.source, size, (r.text or "").count("\n"))))
    first = quality.fit(docs, labels, rounds=0)
    same(first.text, counted([(t, y) for y, t, _ in rows if y is not None]))
    same(first.meta, counted([(m, y) for y, _, m in rows if y is not None]))

    sure = math.log(quality.SURE / (1 - quality.SURE))
    for_text, for_meta = [], []
    for y, t, m in rows:
        by_text, by_meta = first.text.logit(first.text.total(t)), first.meta.logit(first.meta.total(m))
        if y is not None or abs(by_meta) >= sure:
            for_text.append((t, y if y is not None else int(by_meta > 0)))
        if y is not None or abs(by_text) >= sure:
            for_meta.append((m, y if y is not None else int(by_text > 0)))
    assert len(for_meta) > len(known)  # some labels were handed over
    second = quality.fit(docs, labels, rounds=1)
    same(second.text, counted(for_text))
    same(second.meta, counted(for_meta))
