"""Embedding whitening from a covariance that is summed tile by tile.

The covariance of d dimensions is cut into square tiles of dimension pairs. Rows are taken in
blocks, in the tasks that read them; a block's columns are cut as the tiles are, and each piece
goes to the keys (block of rows, tile) that need it: one shuffle of whole numbers in the fewest
bytes that hold them. A task centres the two pieces of a key exactly, multiplies them, adds up
what it has for a tile, and sends on one sum for each tile; Spark adds these entry by entry. Only the
d x d sums (d is at most `MOST_DIMS`, whatever the number of rows) reach the driver, where they are
assembled and decomposed. Eigenvectors go back with the tasks, which project their rows.

Entries are turned into whole numbers first, so sums, and distances from the mean, are exact.
The covariance of the whitened rows is measured by the same tiles, not derived.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are left out, as
are rows of another length than the most frequent one (of two such, the longer), and with it
all rows if that is 0; entries beyond 2**62 / 64 count as that; a null id is kept; equal rows are
each a row. Components without variance (as of a constant dimension, or beyond the number of
rows) are whitened to 0, and the identity is not measured on them. A deviation that does not
fit a long is null. An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import cut_lineage, small_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: A side has at most `SIDES` tiles, so a piece goes to as many keys at most; tiles are at least `LEAST` wide.
SIDES, LEAST = 4, 32
#: Bytes of a block of rows, as doubles.
BLOCK = 512 << 10
MOST_DIMS = 4096
_LIMIT = 1 << 62


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`id` and `vector` (doubles) of the rows whose vector is there and finite throughout."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.select(F.col(id_col).alias("id"), vector.alias("vector")).filter(F.col("vector").isNotNull() & finite)


def whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """A batch's entries as whole numbers, floor(64 c) + 1000000, one row for each vector."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    x = np.floor(c * SCALE)
    fits = np.abs(x) < float(_LIMIT)
    return np.where(fits, np.where(fits, x, 0).astype(np.int64) + OFFSET, np.where(x < 0, -_LIMIT, _LIMIT))


def smallest(piece: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them."""
    low, high = int(piece.min()), int(piece.max())
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return piece.astype(kind)


@dataclass(frozen=True)
class Middle:
    """How many rows there are, and the exact sum of each dimension (doubles: its mean)."""

    rows: int
    sums: tuple[int, ...]

    def distances(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """rows * x - sums for the columns from `first` on: exact; Python's integers where a long does not do."""
        sums = self.sums[first : first + x.shape[1]]
        if self.rows * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < _LIMIT:
            return x * self.rows - np.array(sums, np.int64)
        return x.astype(object) * self.rows - np.array(sums, object)

    def centred(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        return self.distances(x, first).astype(np.float64) / self.rows


@dataclass(frozen=True)
class Mean:
    """The mean of dimensions that are doubles."""

    mean: tuple[float, ...]

    def centred(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        return x - np.array(self.mean[first : first + x.shape[1]])


def column_sums(rows: DataFrame, dims: int) -> Middle:
    """Exact sums over all rows: one sum for each task and dimension, added by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, [0] * dims
        for batch in batches:
            x = whole(batch.column("vector"), dims)
            if len(x):
                count += len(x)
                narrow = int(np.abs(x).max()) < _LIMIT // len(x)
                sums = [a + int(b) for a, b in zip(sums, (x if narrow else x.astype(object)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"pos": range(dims), "n": [count] * dims, "total": pa.array(map(Decimal, sums), pa.decimal128(38, 0))}, pa.schema([("pos", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]))

    found = rows.select("vector").mapInArrow(add, "pos int, n long, total decimal(38,0)").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("pos").collect()
    return Middle(found[0]["n"], tuple(int(r["total"]) for r in found))


def tile_width(dims: int) -> int:
    return max(LEAST, -(-dims // SIDES))


def pieces(rows: DataFrame, dims: int, exact: bool) -> DataFrame:
    """Column pieces of blocks of rows under the keys (block, tile row, tile column) that need them; side 1 is the tile's columns."""
    width = tile_width(dims)
    firsts = range(0, dims, width)
    height = max(1, BLOCK // (8 * dims))
    names = ("block", "i", "j", "side", "height", "kind", "data")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if exact:
                all_rows = whole(batch.column("vector"), dims)
            else:
                all_rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for at in range(0, len(all_rows), height):
                part, out = all_rows[at : at + height], []
                own = [smallest(part[:, f : f + width] - OFFSET) if exact else np.ascontiguousarray(part[:, f : f + width]) for f in firsts]
                for i in range(len(own)):
                    for j in range(i, len(own)):
                        for side, k in ((0, i), (1, j))[: 1 + (i != j)]:
                            out.append((number, i, j, side, len(part), own[k].dtype.str, own[k].tobytes()))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    return rows.select("vector").mapInArrow(cut, "block long, i int, j int, side int, height int, kind string, data binary")


def covariance(rows: DataFrame, dims: int, middle: Middle | Mean, count: int) -> np.ndarray:
    """The covariance of all vectors of `rows`, by tiles; `middle` centres each piece before it is multiplied."""
    width, exact = tile_width(dims), isinstance(middle, Middle)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, total, left = None, None, None
        out = lambda: pa.RecordBatch.from_pydict({"i": pa.array([tile[0]], pa.int32()), "j": pa.array([tile[1]], pa.int32()), "wide": pa.array([total.shape[1]], pa.int32()), "sums": pa.array([total.ravel()], pa.list_(pa.float64()))})
        for batch in batches:
            for _, i, j, side, height, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile is not None and tile != (i, j):
                    yield out()
                    total = None
                tile = i, j
                x = np.frombuffer(data, kind).reshape(height, -1)
                if exact:
                    x = x.astype(np.int64) + OFFSET
                x = middle.centred(x, (j if side else i) * width)
                if i != j and not side:
                    left = x
                    continue
                product = (x if i == j else left).T @ x
                total = product if total is None else total + product
        if tile is not None:
            yield out()

    dealt = pieces(rows, dims, exact).repartition("block", "i", "j").sortWithinPartitions("i", "j", "block", "side")
    entries = dealt.mapInArrow(multiply, "i int, j int, wide int, sums array<double>").select("i", "j", "wide", F.posexplode("sums").alias("pos", "part"))
    summed = entries.groupBy("i", "j", "wide", "pos").agg(F.sum("part").alias("value")).toArrow()
    i, j, wide, pos, value = (summed.column(k).to_numpy() for k in range(5))
    found = np.zeros((dims, dims))
    row, column = i * width + pos // np.maximum(wide, 1), j * width + pos % np.maximum(wide, 1)
    found[row, column] = value / count
    found[column, row] = value / count
    return found


@dataclass(frozen=True)
class Fit:
    """Mean, eigenvalues (falling) and eigenvectors (columns) of all vectors' covariance."""

    middle: Middle
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def filters(self, components: int) -> np.ndarray:
        """Columns that project a centred row on its whitened components; zeros where there is no variance."""
        values, vectors = self.values[:components], self.vectors[:, :components]
        has = values > max(self.values[0], 0) * len(self.vectors) * 4 * np.finfo(float).eps
        return np.where(has, vectors / np.sqrt(np.where(has, values, 1)), 0.0)


def dimensions(rows: DataFrame) -> int:
    """The most frequent length of a vector, 0 without rows."""
    first = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return first["dims"] if first else 0


def fit(rows: DataFrame, dims: int) -> Fit:
    """Fit on all of `rows` (of one length)."""
    middle = column_sums(rows, dims)
    matrix = covariance(rows, dims, middle, middle.rows)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    return Fit(middle, values, vectors * signs, float(np.trace(matrix)))


def project(rows: DataFrame, found: Fit, components: int, id_type) -> DataFrame:
    """`id`, `deviation` and the whitened `vector` of each row."""
    filters, dims = found.filters(components), len(found.vectors)
    middle = found.middle

    def deviations(far: np.ndarray) -> list[int | None]:
        if far.dtype != object and dims * float(np.abs(far).max(initial=0)) ** 2 < _LIMIT:
            return (far * far).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in far)]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = middle.distances(whole(batch.column("vector"), dims))
            white = far.astype(np.float64) / middle.rows @ filters
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, components), pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviations(far), pa.int64()), vectors], names=["id", "deviation", "vector"])

    return rows.mapInArrow(turn, f"id {id_type}, deviation long, vector array<double>")


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Fit | None, float]:
    """Whitened rows (`id`, `deviation`, `vector`), the fit, and the largest distance of their covariance from the identity."""
    spark = rows.sparkSession
    small_batches(spark)
    good = usable(rows, id_col, vector_col)
    id_type = good.schema["id"].dataType.simpleString()
    dims = dimensions(good)
    if dims > MOST_DIMS:
        raise ValueError(f"vectors have {dims} dimensions; the covariance of at most {MOST_DIMS} is decomposed on the driver")
    if not dims:
        return spark.createDataFrame([], f"id {id_type}, deviation long, vector array<double>"), None, 0.0
    good = good.filter(F.size("vector") == dims)
    found = fit(good, dims)
    components = min(components, dims)
    white = cut_lineage(project(good, found, components, id_type))
    means = white.agg(*(F.avg(F.col("vector")[k]) for k in range(components))).first()
    spread = covariance(white, components, Mean(tuple(means)), found.middle.rows)
    has = found.filters(components).any(axis=0)
    error = float(np.abs(spread - np.eye(components))[np.ix_(has, has)].max(initial=0.0))
    return white, found, error


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white, found, error = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    values = [] if found is None else found.values[:COMPONENTS]
    explained = F.array(*(F.lit(float(v / found.trace) if found.trace > 0 else 0.0) for v in values)).cast("array<double>")
    tall = white.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("vector").alias("pos", "whitened"))
    return tall.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(found.middle.rows if found else 0).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"))
