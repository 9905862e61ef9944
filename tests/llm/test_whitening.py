"""Whitening against numpy over whole tables, and odd rows."""

import numpy as np
import pytest

from lakeloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id string, vector string, deviation string"


def numpy_fit(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    far = len(x) * x - x.sum(axis=0)
    centred = far / len(x)
    return far, centred, centred.T @ centred / len(x)


def test_query_against_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    found = whitening.op11_whitening(spark, sf_dir).toPandas()
    far, centred, matrix = numpy_fit(table.embedding.tolist())
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == 32 * len(table) and set(found.n) == {len(table)}
    first = found[found.component == 1].set_index("vec_id")
    assert first.deviation.loc[table.vec_id].tolist() == (far * far).sum(axis=1).tolist()
    share = found.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, values[:32] / values.sum(), rtol=1e-9)
    white = found.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    wanted = centred @ vectors[:, :32] / np.sqrt(values[:32])
    signs = np.sign((white * wanted).sum(axis=0))
    assert np.allclose(white, wanted * signs, atol=1e-7)
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9


@pytest.mark.parametrize("dims", [1, 5, 33, 150, 300])
def test_tiles_of_any_width(spark, dims):
    """Blocks of rows and tiles that don't come out even; 150 and 300 dimensions make four tiles a side."""
    rng = np.random.default_rng(dims)
    vectors = rng.normal(size=(700, dims)).astype(np.float32) * rng.uniform(0.1, 9, dims).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    good = whitening.usable(rows)
    middle = whitening.column_sums(good, dims)
    got = whitening.covariance(good, dims, middle, middle.rows)
    assert np.allclose(got, numpy_fit(vectors)[2], rtol=1e-10, atol=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, 2.0]), (2, [0.1, -1.0, 2.0]), (2, [0.1, -1.0, 2.0]), (None, [3.0, 0.0, 2.0]), (5, [1.0, 1.5, 2.0])]
    bad = [(6, None), (7, []), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 1.0]), (10, [1.0, inf, 1.0]), (11, [1.0, 2.0]), (12, [1.0, -inf, 1.0])]
    rows = spark.createDataFrame([(*r, "a", "b", "c") for r in good + bad], SCHEMA)
    white, found, error = whitening.whiten(rows)
    got = white.collect()
    assert sorted(str(r.id) for r in got) == ["1", "2", "2", "5", "None"]
    assert found.middle.rows == 5 and error < 1e-9
    assert [len(r.vector) for r in got] == [3] * 5
    assert all(r.vector[2] == 0 for r in got)  # the third dimension is constant: two components have variance
    assert len({tuple(r.vector) for r in got if r.id == 2}) == 1


def test_no_rows_and_one_row(spark):
    none = spark.createDataFrame([], SCHEMA)
    white, found, error = whitening.whiten(none)
    assert white.collect() == [] and found is None and error == 0
    lone = spark.createDataFrame([(4, [1.0, 2.0], "a", "b", "c")], SCHEMA)
    white, found, error = whitening.whiten(lone)
    assert [tuple(r) for r in white.collect()] == [(4, 0, [0.0, 0.0])] and found.trace == 0 and error == 0


def test_exact_beyond_a_long(spark):
    """Entries whose squares, or which themselves, leave a long: sums stay exact, and a deviation that does not fit is null."""
    rows = spark.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 1.0]), (3, [1e300, 1.0])], "vec_id long, embedding array<double>")
    middle = whitening.column_sums(whitening.usable(rows), 2)
    assert middle.sums == (64 * 10**12 + 1_000_000 + 1_000_000 + (1 << 62), 64 * 2 + 3_000_000)
    assert {r.id: r.deviation for r in whitening.whiten(rows)[0].collect()} == {1: None, 2: None, 3: None}
    near = spark.createDataFrame([(1, [1e6, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(near)[0].collect()} == {(64 * 10**6) ** 2 + 64**2}


def test_most_frequent_length_wins(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0]), (4, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted(r.id for r in whitening.whiten(rows)[0].collect()) == [2, 4]
