"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of the mix divided by its size is the number of copies that each of its
documents should get, mostly a fraction. Pivotal rounding makes these whole at random without
losing the sum: two documents with fractional copies meet, and words move from one to the
other, in the direction that a coin weighted by the room on either side tells, until one of
them is whole; the other one meets the next. So a document's expected copies are its source's
quotient, and the words of the two stay the same at every meeting. What is left of a bucket is
one open document for each source; these residuals meet in the same way, `FAN` buckets
together, level by level. At the last level a source's residuals (at most `ROWS`) are settled
from the largest down, each against all smaller ones together, so that what a source's words
miss its target by is mostly a part of its smallest open document.

What moves is small: an id, a source and a few numbers for each document, never a text. Rows
alike in id, source and size are counted before anything is dealt out and rounded as a group
(all but one of them at once), so many equal rows, or many without an id, are one row here.
Buckets are dealt by hash across sources, so a hot source is spread over all of them; a level
above holds one row for each bucket and source. A task holds one open row at a time. Order and
coins come from hashes of the rows themselves, so reruns agree, however the work is dealt.

Defined cases: null, empty and white texts have size 0, and nothing of them is taken; null
sources are one source, the last; sources without words have the target 0; equal rows are
each a document; rows whose id is null count like others; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.session import cut_lineage

SHARE, WEIGHTS, MOST = 1.5, (3, 1, 2), 2
#: Rows of a bucket on average, and buckets whose residuals meet at the next level.
ROWS, FAN = 4096, 1024
#: Equal rows that are written out by one task at most.
CHUNK = 65_536
#: Bytes of source names up to which the targets are broadcast.
SMALL = 4 << 20
#: Fractions closer to a whole number than this are whole.
WHOLE = 1e-9

WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
_MASK = (1 << 64) - 1


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text: each, with the white space before it, becomes one letter; the white space at the end goes."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit("a"))
    return F.length(F.rtrim(letters, F.lit(" \t\n\x0b\x0c\r"))).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each id, source and size stands in `docs`."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    return rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("many"))


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` with their place from 0 by code point, null last: numbers within sorted ranges, and the rows of the ranges before."""
    order = F.col("source").asc_nulls_last()
    ranges = cut_lineage(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranges.withColumn("place", inside).join(starts, "part").select("source", "source_size", (F.col("place") + F.col("before")).alias("place"))


def targets(sources: DataFrame, share: float = SHARE, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`sources` (source, source_size) with `target`: words by weight out of `share` of all sizes, at most `most` times a source's size.

    What a limit leaves over goes to the sources below theirs by weight, again and again. Words for each
    unit of weight only rise from turn to turn, so a source once at its limit stays there.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(numbered(sources).withColumn("weight", weight))
    limit, full, unit = F.col("source_size") * most, -1, 0.0
    while True:
        over = F.col("weight") * unit > limit
        now = ranked.agg(F.sum("source_size").alias("all"), F.count(F.when(over, 1)).alias("full"), F.sum(F.when(over, limit)).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        better = (share * now["all"] - (now["given"] or 0)) / now["weights"] if now["weights"] else unit
        if now["full"] == full and better == unit or not now["weights"]:
            return ranked.select("source", "source_size", F.when(over, limit.cast("double")).otherwise(F.col("weight") * unit).alias("target"))
        full, unit = now["full"], better


def _coin(a: int, b: int) -> float:
    """A number in [0, 1) that two hashes give."""
    x = (a * 0x9E3779B97F4A7C15 + (b ^ (b >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def meet(size: int, part: float, other_size: int, other_part: float, coin: float) -> tuple[float, float]:
    """The fractions of two documents after words have moved between them until one fraction is 0 or 1."""
    mine, theirs = size * part, other_size * other_part
    up, down = min(size - mine, theirs), min(mine, other_size - theirs)  # words that can come, and go
    if coin * (up + down) < down:
        return (1.0 if up == size - mine else (mine + up) / size), (0.0 if up == theirs else (theirs - up) / other_size)
    return (0.0 if down == mine else (mine - down) / size), (1.0 if down == other_size - theirs else (theirs + down) / other_size)


def settle(sizes: np.ndarray, parts: np.ndarray, coins: Sequence[float]) -> np.ndarray:
    """Whole fractions for all documents of a source, from the largest down; the smaller ones together take what each one's rounding moves.

    A coin that is as likely as the fraction decides, where the smaller ones can take either; else the
    direction that they can, else the nearer. The last one goes to the nearer. Where it reaches,
    every smaller one moves by its p (1 - p), so that its expectation stays; else by its mass, or its room.
    """
    order = np.lexsort((coins, -sizes))
    size, part = sizes[order].astype(float), parts[order].copy()
    for i in range(len(part)):
        p, rest, own = part[i], size[i + 1 :], part[i + 1 :]
        up, down, mass, room = size[i] * (1 - p), size[i] * p, rest @ own, rest @ (1 - own)
        if up <= mass and down <= room:
            rises = coins[order[i]] < p
        elif up <= mass or down <= room:
            rises = up <= mass
        else:
            rises = p >= 0.5
        part[i] = float(rises)
        moved = min(up, mass) if rises else min(down, room)
        if moved > 0:
            spread = own * (1 - own)
            if moved <= (reach := rest @ spread):
                own += spread * (moved / reach) * (-1 if rises else 1)
            elif rises:
                own *= 1 - moved / mass
            else:
                own += (1 - own) * (moved / room)
            np.clip(own, 0.0, 1.0, out=own)
    whole = np.empty(len(part))
    whole[order] = part
    return whole


def _folded(open_rows: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """Open rows of one bucket and source, met in the order of their hashes: all whole but one. At the last level all are made whole."""
    schema = open_rows.schema
    names = schema.names
    place = {name: i for i, name in enumerate(names)}
    part, size, key = place["part"], place["size"], place["key"]

    def settled(row: list) -> list:
        if row[part] < WHOLE or row[part] > 1 - WHOLE:
            row[place["copies"]] += round(row[part])
            row[part] = None
        return row

    def met(rows: Iterator[list]) -> Iterator[list]:
        held = None
        for row in rows:
            if held is None:
                held = row
                continue
            held[part], row[part] = meet(held[size], held[part], row[size], row[part], _coin(held[key], row[key]))
            if not WHOLE < held[part] < 1 - WHOLE:
                held, row = row, held
            yield settled(row)
            if not WHOLE < held[part] < 1 - WHOLE:
                yield settled(held)
                held = None
        if held is not None:
            yield held

    def finished(rows: Iterator[list]) -> Iterator[list]:
        group = list(rows)  # at most `ROWS` of a first level, or one for each of `FAN` buckets
        whole = settle(np.array([r[size] for r in group]), np.array([r[part] for r in group]), np.array([_coin(r[key], r[size]) for r in group]))
        for row, value in zip(group, whole.tolist(), strict=True):
            row[part] = value
            yield settled(row)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def rows() -> Iterator[list]:
            for batch in batches:
                kinds[:] = batch.schema.types
                yield from map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True))

        def done() -> Iterator[list]:
            for _, group in groupby(rows(), lambda row: (row[place["bucket"]], row[place["source"]])):
                yield from (finished if last else met)(group)

        for chunk in batched(done(), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*chunk, strict=True), kinds, strict=True)], names=names)

    return open_rows.repartition(*keys).sortWithinPartitions("bucket", "source", "key", "id", "size").mapInArrow(fold, schema)


def mix(docs: DataFrame, share: float = SHARE, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0, rows: int = ROWS, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each of `docs`: id, source, size, source_size, target, and the whole number of `copies` that the mix takes."""
    units = cut_lineage(sizes(docs, id_col, text_col, source_col))
    goals = cut_lineage(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).cast("long").alias("source_size")), share, weights, most))
    width = goals.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 32)).first()[0] or 0
    wanted = goals.withColumnRenamed("source", "of")
    joined = units.join(F.broadcast(wanted) if width <= SMALL else wanted, units["source"].eqNullSafe(wanted["of"])).drop("of")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("quotient", copies).withColumn("copies", F.floor("quotient"))
    more = F.when(F.col("size") > 0, F.col("many") * (F.col("quotient") - F.col("copies"))).otherwise(0.0)
    joined = joined.withColumn("more", more).withColumn("up", F.floor(F.col("more") + WHOLE)).withColumn("part", F.greatest(F.col("more") - F.col("up"), F.lit(0.0)))
    joined = cut_lineage(joined.withColumn("open", (F.col("part") > WHOLE).cast("long")))
    same = ("id", "source", "size", "source_size", "target")
    whole = joined.select(*same, (F.col("copies") + 1).alias("copies"), F.col("up").alias("many")).unionByName(joined.select(*same, "copies", (F.col("many") - F.col("up") - F.col("open")).alias("many")))

    waiting = joined.filter("open = 1")
    buckets = max(1, math.ceil(waiting.count() / rows))
    key = F.xxhash64(F.lit(seed), "id", "source", "size")
    waiting = waiting.select(*same, "copies", "part", key.alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("long"))
    keys = ["bucket"]  # buckets hold all sources, so a hot one is spread; above, a bucket has one row of each
    while True:
        level = cut_lineage(_folded(waiting, keys, buckets == 1))
        whole = whole.unionByName(level.filter("part is null").select(*same, "copies", F.lit(1).cast("long").alias("many")))
        if buckets == 1:
            break
        buckets, keys = math.ceil(buckets / fan), ["bucket", "source"]
        waiting = level.filter("part is not null").withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long"))
    return _each(whole.filter("many > 0"))


def _each(rows: DataFrame) -> DataFrame:
    """Every row `many` times; those with very many are dealt out in chunks first."""
    repeated = lambda df, n: df.withColumn("of", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    few = repeated(rows.filter(F.col("many") <= CHUNK), F.col("many"))
    chunks = rows.filter(F.col("many") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / CHUNK))))
    lots = repeated(chunks.repartition(*rows.columns, "chunk"), F.least(F.lit(CHUNK).cast("long"), F.col("many") - F.col("chunk") * CHUNK)).drop("chunk")
    return few.unionByName(lots).drop("of", "many")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
