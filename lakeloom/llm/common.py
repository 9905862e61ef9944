"""What several corpus operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the helper columns; a leading double underscore keeps clear of columns that a table brings along.
ID, HASH, TEXT = "__id", "__hash", "__text"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carry: str) -> DataFrame:
    """Only what an operator needs of a table, under names that can't clash: id, text (null: empty) and a hash of the text.

    Id and hash together name a row. Rows with equal id and text are the same document
    twice; whatever is found for one holds for the other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias(ID), text.alias(TEXT), F.xxhash64(text).alias(HASH), *carry)


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` under names by position, which no column that an operator adds can clash with, and the new names."""
    names = [f"__k{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def same_row(left: DataFrame, right: DataFrame, id_: str, hash_: str) -> Column:
    """Join condition on the row key; null ids match null ids."""
    return left[ID].eqNullSafe(right[id_]) & (left[HASH] == right[hash_])


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, the same ones every time: all, or those whose key's hash is below a bound that leaves about so many."""
    total = rows.count()
    if total <= limit:
        return rows
    share = (limit - 5 * limit**0.5) / total
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40)))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for each row, also where `body` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """The set of runs of `width` words as sorted 64-bit hashes; fewer words are one run, none is the empty set."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(width, n)
    total = np.full(n - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        total += mixed(hashes[i : n - size + 1 + i] * _PLACES[i % 5] + np.uint64(i))
    return np.unique(mixed(total))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic fit with an intercept (last): damped Newton steps on scaled columns, so that separable classes do no harm."""
    x = x.reshape(len(y), -1)
    middle, spread = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    z = np.column_stack(((x - middle) / spread, np.ones(len(y))))
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    loss = lambda b: np.logaddexp(0, z @ b).sum() - y @ (z @ b) + b @ penalty @ b / 2
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return np.append(beta[:-1] / spread, beta[-1] - (beta[:-1] * middle / spread).sum())
