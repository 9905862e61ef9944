"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Texts are split into pre-tokens (words). Documents are taken in groups of about
`GROUP_CHARS` characters; within a group each distinct word gets a number, and a document
is the list of its words' numbers in order of position. A group's distinct words are dealt
out by their hash, so that all groups' copies of a word meet in one place, where it is
merged once; its ids go back to the groups, which put them into their documents by position.
A word crosses the network once for each group that holds it, however often it stands there,
so the most frequent words are no hot keys; a group's numbers stay compact. Decoding joins
ids with the table of tokens' bytes, which the vocabulary's size bounds (about 50,000 rows).

Groups are made of a stored table's rows, whose order is the same at each attempt of a task; documents
that are not just read from a table are written to one first. So a lost executor costs its tasks
alone. Memory: a group, and `CACHED` words where words are merged.

Defined cases: a null text is an empty text; an empty text has no ids and decodes to no bytes;
repeated rows are encoded alike; an empty table gives an empty result; columns other than the
id are dropped; very long pre-tokens are merged with a heap, in n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.session import cut_lineage, small_batches

GROUP_CHARS = 6_000_000
CHUNK_TOKENS = 300_000
CACHED = 200_000
SHORT = 100
LEVEL = 9
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: of all adjacent parts, those whose union has the least rank are joined, the leftmost first."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    none, get = 1 << 60, ranks.get
    cuts = list(range(len(word) + 1))
    costs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while costs and (best := min(costs)) != none:
        i = costs.index(best)
        del cuts[i + 1], costs[i]
        if i < len(costs):
            costs[i] = get(word[cuts[i] : cuts[i + 2]], none)
        if i:
            costs[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, in n log n steps."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 where none does
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed meanwhile
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (b := before[i]) >= 0 and (r := ranks.get(word[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if end[i]]


def splitter(pattern: str = public_tokenizers.PATTERN):
    """A function from text to its pre-tokens. ASCII texts take an equal pattern of the faster module."""
    whole = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return whole.findall
    space = r"[\t-\r ]"
    ascii_ = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|{space}+(?![^\t-\r ])|{space}+")
    return lambda text: (ascii_ if text.isascii() else whole).findall(text)


def _pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of whole numbers, each as planes of bytes, and a tail, compressed together."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        width = a.dtype.itemsize
        parts += [struct.pack("<cI", a.dtype.char.encode(), len(a)), np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T.tobytes()]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([*parts, tail]))


def _unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, arrays = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        char, size = struct.unpack_from("<cI", raw, at)
        kind = np.dtype(char.decode())
        at += 5
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        arrays.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += size * kind.itemsize
    return arrays, raw[at:]


_GROUPED = "gid long, bucket int, stream boolean, payload binary"


def _numbered(docs: DataFrame, buckets: int, pattern: str) -> DataFrame:
    """From rows (id, text): for each group one row of its documents' numbers (stream) and one for each bucket of its words.

    A group's words are numbered by how often they stand in it. Words that stand there once come
    last, in order of place, and the documents just say 0 for the next one of them.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        ids, numbers, size, done = [], [], 0, 0
        words: defaultdict[str, int] = defaultdict(count().__next__)

        def taken() -> pa.RecordBatch:
            whole = np.concatenate([np.empty(0, np.uint32), *numbers])
            times = np.bincount(whole, minlength=len(words))
            often, once = np.flatnonzero(times > 1), np.flatnonzero(times == 1)
            often = often[np.argsort(-times[often], kind="stable")]
            said = np.zeros(len(words), np.uint32)
            said[often] = np.arange(1, len(often) + 1)
            listed = list(words)
            dealt: list[tuple[list[int], list[bytes]]] = [([], []) for _ in range(buckets)]
            for k, w in enumerate(np.concatenate((often, once)).tolist()):
                raw = listed[w].encode("utf-8", "surrogatepass")
                local, own = dealt[xxhash.xxh3_64_intdigest(raw) % buckets]
                local.append(k)
                own.append(raw)
            rows = [(b, False, _pack(np.diff(np.array(x, np.uint32), prepend=np.uint32(0)), np.fromiter(map(len, y), np.uint32, len(y)), tail=b"".join(y))) for b, (x, y) in enumerate(dealt) if x]
            known = np.array([x is not None for x in ids], np.uint8)
            stream = _pack(np.array([x or 0 for x in ids], np.int64), known, np.fromiter(map(len, numbers), np.uint32, len(numbers)), said[whole], np.array([len(often), len(once)], np.uint32))
            key = xxhash.xxh3_64_intdigest(b"%d %d " % (TaskContext.get().partitionId(), done) + stream)
            rows.append((key % buckets, True, stream))
            return pa.RecordBatch.from_arrays([pa.array([key - 2**63] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["gid", "bucket", "stream", "payload"])

        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                id_, text = id_.as_py(), text.as_py()
                numbers.append(np.frombuffer(array("I", map(words.__getitem__, split(text))), np.uint32))
                ids.append(id_)
                size += len(text)
                if size >= GROUP_CHARS:
                    yield taken()
                    ids, numbers, size, done = [], [], 0, done + 1
                    words = defaultdict(count().__next__)
        if ids:
            yield taken()

    return docs.mapInArrow(group, _GROUPED)


def _merged(rows: DataFrame, ranks) -> DataFrame:
    """The groups' words as ids, each distinct word merged once; documents' numbers pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = ranks.value, {}  # words merged lately
        for batch in batches:
            payloads = []
            for stream, payload in zip(batch.column(2), batch.column(3), strict=True):
                if stream.as_py():
                    payloads.append(payload.as_py())
                    continue
                (local, sizes), text = _unpack(payload.as_py())
                stops = np.cumsum(sizes, dtype=np.int64)
                found = []
                for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
                    w = text[a:b]
                    if (x := known.get(w)) is None:
                        if len(known) >= CACHED:
                            known.clear()
                        x = known[w] = array("I", merge(w, table))
                    found.append(x)
                payloads.append(_pack(local, np.fromiter(map(len, found), np.uint32, len(found)), np.frombuffer(b"".join(found), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(payloads, pa.binary())], names=["gid", "stream", "payload"])

    return rows.mapInArrow(run, "gid long, stream boolean, payload binary")


def _assembled(docs: DataFrame, path: str | None, pattern: str, id_col: str, text_col: str, schema: str, make, stored: bool) -> DataFrame:
    """`make` of the ids (null ids kept) and the token ids of each group's documents: numbers of ids, and all ids one after the other."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(path))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if not stored:
        rows = cut_lineage(rows)
    merged = _merged(_numbered(rows, buckets, pattern).repartitionById(buckets, F.col("bucket")), ranks)

    def assemble(table: pa.Table) -> pa.Table:
        payloads = {True: [], False: []}
        for stream, payload in zip(table["stream"], table["payload"], strict=True):
            payloads[stream.as_py()].append(payload)
        parts = [_unpack(p.as_py())[0] for p in payloads[False]]
        none = [np.empty(0, np.uint32)]
        local = np.concatenate([*none, *(np.cumsum(p[0], dtype=np.int64) for p in parts)]).astype(np.int64)
        sizes = np.concatenate([*none, *(p[1] for p in parts)]).astype(np.int64)
        ids = np.concatenate([*none, *(p[2] for p in parts)]).astype(np.int32)
        del parts
        (own, known, counts, numbers, words), _ = _unpack(payloads[True][0].as_py())
        assert len(payloads[True]) == 1 and len(local) == words.sum(), "`stored` was given for documents whose order changes"
        start, size = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        start[local], size[local] = np.cumsum(sizes) - sizes, sizes
        nexts = np.flatnonzero(numbers == 0)
        numbers = numbers - np.uint32(1)
        numbers[nexts] = words[0] + np.arange(len(nexts), dtype=np.uint32)
        keys = pa.array([k if ok else None for k, ok in zip(own.tolist(), known.tolist(), strict=True)], pa.int64())
        ends = np.cumsum(counts, dtype=np.int64)
        made, first = [], 0
        while first < len(ends):  # some documents at a time
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + CHUNK_TOKENS, "right")))
            mine = numbers[done : int(ends[last - 1])]
            lengths = size[mine]
            stops = np.cumsum(lengths)
            places = np.repeat(start[mine] - (stops - lengths), lengths)
            places += np.arange(len(places))
            offsets = np.concatenate(([0], stops))[np.concatenate(([0], ends[first:last] - done))]
            made.append(make(keys[first:last], offsets, ids[places]))
            first = last
        return pa.concat_tables(made)

    return merged.groupBy("gid").applyInArrow(assemble, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """One row for each of `docs`: its id and `ids`, the token ids of its text. `stored` as for `digests`."""

    def make(keys: pa.Array, offsets: np.ndarray, ids: np.ndarray) -> pa.Table:
        return pa.table({"id": keys, "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))})

    return _assembled(docs, path, pattern, id_col, text_col, "id long, ids array<int>", make, stored).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """`encoded` with `decoded`, the bytes of its ids: a join with the token-byte table, which the vocabulary bounds."""
    table = {rank: token for token, rank in load_ranks(path).items()}
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            values = [b"".join(map(token, x.as_py())) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """One row for each of `docs`: id, n_tokens, ids_sha256 and decoded_sha256.

    Ids are decoded through the token-byte table where the groups are put together, so that they need not travel.
    `stored` says that `docs` is just a table's rows, which come in the same order at each attempt; all else is written to a table first.
    """
    ranks = load_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast({rank: (token, b"%d," % rank) for token, rank in ranks.items()})

    def make(keys: pa.Array, offsets: np.ndarray, ids: np.ndarray) -> pa.Table:
        table, rows = shared.value, []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = list(map(table.__getitem__, ids[a:b].tolist()))
            decimal, decoded = hashlib.sha256(b"".join([d for _, d in found])[:-1]), hashlib.sha256(b"".join([t for t, _ in found]))
            rows.append((b - a, decimal.hexdigest(), decoded.hexdigest()))
        n, first, second = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"id": keys, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())})

    found = _assembled(docs, path, public_tokenizers.PATTERN, id_col, text_col, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, stored)
    return found.withColumnRenamed("id", id_col)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), stored=True)
