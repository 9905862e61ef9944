"""Removal of long repeats: run-compressed Burrows-Wheeler index over the passages that may repeat.

A byte is removed if a string of `LENGTH` bytes that covers it also starts earlier, in a
document of smaller id or earlier in the same one.

Windows. Every window of `LENGTH` bytes has an anchor: the leftmost of its `GRAM`-byte
strings of least hash. Equal windows have equal anchors at equal places, so windows are
compared only where anchors are equal. Consecutive windows with one anchor form a context (at
most 176 bytes). A task takes documents in blocks of some MB and sends one of each
block's equal contexts to the bucket of its anchor; all others repeat it for sure, so that
copies of a passage cost a bucket one context for each block. In a bucket, contexts with equal
content repeat the first of them; only anchors with several different contexts need more: the
ends of shared passages.

Index. Those contexts are joined, in order of place, to one text with a separator of its own
after each. Its suffixes are sorted, and the Burrows-Wheeler transform is kept as runs with the
suffix sampled at each run's first end. At a run's end the length of the match with the
suffix before is measured; inside a run it is one less with each step through the text, so the
matching statistics of all places stream out of the samples. Places that match for `LENGTH`
bytes are one class, and all but the first of a class are marked.

Skew. Anchors with so many different contexts that they make a 200,000th of all (a passage
in very many documents, each time in other words) are found beforehand by a count; there
are at most 200,000 of these, which tasks get by broadcast, and their windows go to buckets one by
one, by the hash of the whole window. Buckets hold some 250,000 contexts at any input size.

Spark. Texts are shuffled once, to meet their marks. Blocks may differ between attempts of a
task without a change of the result.

Defined cases: null and empty texts, and texts of fewer bytes than `LENGTH`, keep all; rows
with equal id and text are one document that stands once, with the same result for each; rows
of equal id and different text are in order of their texts' hashes; null ids come first; an
empty table gives an empty result; other columns are ignored by `repeats` and kept by
`remove`. Contents are compared as 64-bit hashes within one anchor, and byte by byte in the
index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import mixed
from lakeloom.session import cut_lineage

LENGTH, GRAM = 100, 24
BLOCK = 1 << 20
GATHERED = 8
BUCKET = 250_000
HOT_SHARE = 200_000
HOT_LEAST = 2_000
INDEX_SYMBOLS = 2_000_000

_NO_ID = -(2**63)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = np.uint64(BLOCK * 2 - 1)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _first_powers(base: int, n: int) -> np.ndarray:
    return _powers(base, -(-n // (1 << 18)) << 18)[:n]


class Hashes:
    """Hashes of any substrings of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _first_powers(_BASE, max(n, 1))[:n], dtype=np.uint64, out=self.sums[1:])
        self.inverse = _first_powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])


def anchors(data: np.ndarray, lengths: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """Contexts of documents that stand one after the other in `data`: document, first window, windows, place of the anchor, its hash."""
    starts = np.cumsum(lengths) - lengths
    valid = np.maximum(lengths - LENGTH + 1, 0)
    total = int(valid.sum())
    if not total:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    gram = hashes.of(np.arange(len(data) - GRAM + 1), np.arange(GRAM, len(data) + 1))
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    span, width = 1, LENGTH - GRAM + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    doc = np.repeat(np.arange(len(lengths)), valid)
    window = np.arange(total) + np.repeat(starts - (np.cumsum(valid) - valid), valid)
    place = (least[window] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.concatenate((first, [total])))
    return doc[first], window[first], count, place[first], gram[place[first]]


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of several strings, with suffixes sampled at the runs' first ends."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray) -> None:
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        text = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = data
        text[ends] = 256 + np.arange(len(lengths))
        self.n = n
        order, ranks, levels = self._sorted(text)
        before = text[order - 1]
        heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.symbols, self.runs = before[heads], np.diff(np.concatenate((heads, [n])))
        self.samples, self.order = order[heads], order
        above = order[np.maximum(heads - 1, 0)]
        match = np.zeros(len(heads), np.int64)
        for size, rank in reversed(levels):  # equal ranks: `size` equal symbols
            a, b = self.samples + match, above + match
            fits = (a < n) & (b < n)
            fits[fits] = rank[a[fits]] == rank[b[fits]]
            match[fits] += size
        match[0] = 0
        self.sampled = match

    @staticmethod
    def _sorted(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        n, levels = len(text), []
        rank = np.unique(text, return_inverse=True)[1]
        size = 1
        while True:
            levels.append((size, rank))
            key = rank * np.int64(n + 1)
            key[:-size] += rank[size:] + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
            size *= 2
            if rank[order[-1]] == n - 1 or size > n:
                return order, rank, levels

    def matching_statistics(self) -> np.ndarray:
        """For each place the length of its match with the suffix sorted before it, streamed from the samples."""
        reach = np.zeros(self.n, np.int64)
        reach[self.samples] = self.samples + self.sampled
        return np.maximum.accumulate(reach) - np.arange(self.n)

    def first_equal(self, length: int) -> np.ndarray:
        """For each place the first place where the same `length` symbols stand."""
        long = self.matching_statistics()[self.order] >= length
        heads = np.flatnonzero(~long)
        first = np.empty(self.n, np.int64)
        first[self.order] = np.repeat(np.minimum.reduceat(self.order, heads), np.diff(np.concatenate((heads, [self.n]))))
        return first


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
    """Documents (id, hash, first byte) in order, their bytes and lengths; a text longer than a block comes in parts that share LENGTH - 1 bytes."""
    held: dict[tuple[int, int, int], bytes] = {}
    size = 0

    def taken():
        keys = sorted(held)
        return keys, np.frombuffer(b"".join(held[k] for k in keys), np.uint8), np.array([len(held[k]) for k in keys], np.int64)

    for batch in batches:
        for id_, hash_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes()
            for at in range(0, max(len(raw) - LENGTH + 1, 0), BLOCK // 2):
                part = raw[at : at + BLOCK // 2 + LENGTH - 1]
                held[(_NO_ID if id_ is None else id_, hash_, at)] = part
                size += len(part)
                if size >= BLOCK - BLOCK // 2 - LENGTH:
                    yield taken()
                    held.clear()
                    size = 0
    if held:
        yield taken()


def _leader(*keys: np.ndarray) -> np.ndarray:
    """For each row the first row with its keys."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order[1:]] != k[order[:-1]]
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))]
    return leader


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether a row is the first with its keys."""
    return _leader(*keys) == np.arange(len(keys[0]))


def _joined(ids: np.ndarray, hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Marked byte ranges as rows (id, hash, start, stop), joined where they touch."""
    order = np.lexsort((start, hashes, ids))
    ids, hashes, start, stop = ids[order], hashes[order], start[order], stop[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(stop + group * np.int64(2**32)) - group * np.int64(2**32)
    head = np.flatnonzero(np.concatenate(([True], new[1:] | (start[1:] > reach[:-1]))))
    tail = np.concatenate((head[1:], [len(ids)])) - 1
    return np.stack((ids[head], hashes[head], start[head], reach[tail]), axis=1)


def _target(ids: np.ndarray, hashes: np.ndarray, targets: int) -> np.ndarray:
    """Where a document and its marks meet."""
    return (mixed(ids.astype(np.uint64) + mixed(hashes.astype(np.uint64))) % np.uint64(targets)).astype(np.int64)


def _packed_marks(found: list[tuple[np.ndarray, ...]], targets: int) -> list[tuple[int, bytes]]:
    """One row for each target: marks, compressed."""
    columns = [np.concatenate([np.asarray(f[k], np.int64) for f in found]) for k in range(4)] if found else [np.empty(0, np.int64)]
    if not len(columns[0]):
        return []
    rows = _joined(*columns)
    target = _target(rows[:, 0], rows[:, 1], targets)
    order = np.argsort(target, kind="stable")
    pack = zstandard.ZstdCompressor(level=3)
    return [(int(target[part[0]]), pack.compress(rows[part].T.tobytes())) for part in np.split(order, np.flatnonzero(np.diff(target[order])) + 1)]


def _unpacked_marks(blobs: list[bytes]) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(unpack.decompress(b), np.int64).reshape(4, -1) for b in blobs]
    return np.concatenate(parts, axis=1) if parts else np.empty((4, 0), np.int64)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... (size[i] of them), for each i."""
    stops = np.cumsum(size)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(start - (stops - size), size)


_FIELDS = (("id", np.int64), ("hash", np.int64), ("at", np.int32), ("count", np.uint8), ("before", np.uint8))
_SENT = "bucket int, target int, marks binary, windows binary, fields binary, content binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("target", pa.int32()), *((c, pa.binary()) for c in ("marks", "windows", "fields", "content"))])
_MARKS = "target int, marks binary"


def _place(keys: list[tuple[int, int, int]], lengths: np.ndarray, doc: np.ndarray, window: np.ndarray):
    table = np.array(keys, np.int64).reshape(-1, 3)
    return table[doc, 0], table[doc, 1], window - (np.cumsum(lengths) - lengths)[doc] + table[doc, 2]


def _contexts(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Contexts of several blocks in order of place, their bytes one after the other, and windows (hash, id, hash of the text, place) of hot anchors.

    Without `hot`, only hashes.
    """
    gathered: list[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]] = []

    def taken():
        at = {k: np.concatenate([g[0][k] for g in gathered]) for k in gathered[0][0]}
        data, windows = (np.concatenate([g[k] for g in gathered]) for k in (1, 2))
        size = at["count"] + LENGTH - 1
        start = np.cumsum(size) - size
        order = np.lexsort((at["at"], at["hash"], at["id"]))
        return {k: v[order] for k, v in at.items()} | {"start": start[order]}, data, windows

    for keys, data, lengths in _blocks(batches):
        hashes = Hashes(data)
        doc, window, count, place, gram = anchors(data, lengths, hashes)
        ids, texts, at = _place(keys, lengths, doc, window)
        content = hashes.of(window, window + count + LENGTH - 1) ^ mixed((place - window).astype(np.uint64))
        fields = {"id": ids, "hash": texts, "at": at, "count": count, "before": place - window, "gram": gram, "content": content}
        none = np.empty(0, np.uint8), np.empty((0, 4), np.int64)
        if hot is None:
            gathered.append((fields, *none))
        else:
            crowded = np.isin(gram, hot)
            one = _ragged(window[crowded], count[crowded])
            wid, wtext, wat = _place(keys, lengths, np.repeat(doc[crowded], count[crowded]), one)
            windows = np.stack((hashes.of(one, one + LENGTH).astype(np.int64), wid, wtext, wat), axis=1)
            rest = ~crowded
            gathered.append(({k: v[rest] for k, v in fields.items()}, data[_ragged(window[rest], count[rest] + LENGTH - 1)], windows))
        del hashes, data
        if len(gathered) == GATHERED:
            yield taken()
            gathered.clear()
    if gathered:
        yield taken()


def _dealt(rows: DataFrame, buckets: int, hot) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for at, data, windows in _contexts(batches, hot.value):
            leader = _leader(at["gram"], at["content"])
            fresh = leader == np.arange(len(leader))
            again = np.logical_or.reduce([at[k] != at[k][leader] for k in ("id", "hash", "at")])  # equal places are the same row of the table again
            known = [at[k][again] for k in ("id", "hash", "at")]
            out = [(t, t, m, None, None, None) for t, m in _packed_marks([(*known, known[2] + at["count"][again] + LENGTH - 1)], buckets)]
            if len(windows):
                target = (windows[:, 0].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(target[order])) + 1):
                    out.append((int(target[part[0]]), None, None, pack.compress(windows[part].T.tobytes()), None, None))
            rest = np.flatnonzero(fresh)
            target = (mixed(at["gram"][rest]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(target[order])) + 1) if len(rest) else []:
                own = rest[part]
                fields = b"".join(at[name][own].astype(kind).tobytes() for name, kind in _FIELDS)
                out.append((int(target[part[0]]), None, None, None, pack.compress(fields), pack.compress(data[_ragged(at["start"][own], at["count"][own] + LENGTH - 1)].tobytes())))
            for k in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 2000], strict=True), _SENT_ARROW, strict=True)], schema=_SENT_ARROW)

    return rows.mapInArrow(run, _SENT)


def _unpacked(fields: bytes, content: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(fields)
    n, at, out = len(raw) // sum(np.dtype(t).itemsize for _, t in _FIELDS), 0, {}
    for name, kind in _FIELDS:
        out[name] = np.frombuffer(raw, kind, n, at).astype(np.int64)
        at += n * np.dtype(kind).itemsize
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(content), np.uint8)
    size = out["count"] + LENGTH - 1
    start = np.cumsum(size) - size
    hashes = Hashes(data)
    gram = start + out["before"]
    return out | {"gram": hashes.of(gram, gram + GRAM), "content": hashes.of(start, start + size) ^ mixed(out["before"].astype(np.uint64))}


def _several(at: dict[str, np.ndarray], chosen: np.ndarray, contents: list[bytes], blob: np.ndarray, row: np.ndarray, limit: int = INDEX_SYMBOLS):
    """Marks (id, hash, start, stop) among different contexts with equal anchors. `chosen` is in order of anchor, then place."""
    gram = at["gram"][chosen]
    cuts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True])))
    sizes = at["count"][chosen] + LENGTH
    weight = np.add.reduceat(sizes, cuts[:-1])
    batch, total, batches = [], 0, []
    for k, w in enumerate(weight):
        if batch and total + w > limit:
            batches.append(batch)
            batch, total = [], 0
        batch.append(k)
        total += w
    if batch:
        batches.append(batch)
    for ks in batches:
        own = chosen[np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in ks])]
        own = own[np.lexsort((at["at"][own], at["hash"][own], at["id"][own]))]
        size = at["count"][own] + LENGTH - 1
        text = np.empty(int(size.sum()), np.uint8)
        stops = np.cumsum(size)
        for b in np.unique(blob[own]):
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(contents[b]), np.uint8)
            mine = blob[own] == b
            text[_ragged((stops - size)[mine], size[mine])] = data[_ragged(row[own][mine], size[mine])]
        starts = stops - size
        hashes = Hashes(text)
        window = _ragged(starts, at["count"][own])
        owner = np.repeat(np.arange(len(own)), at["count"][own])
        whole = hashes.of(window, window + LENGTH)
        order = np.argsort(whole, kind="stable")
        equal = whole[order][1:] == whole[order][:-1]
        shared = np.zeros(len(window), bool)
        shared[order[1:][equal]] = True
        shared[order[:-1][equal]] = True
        # Pieces: runs of windows that stand in several contexts. Only one of equal pieces goes into the index.
        head = np.flatnonzero(shared & np.concatenate(([True], ~shared[:-1] | (owner[1:] != owner[:-1]))))
        if not len(head):
            continue
        tail = np.flatnonzero(shared & np.concatenate((~shared[1:] | (owner[1:] != owner[:-1]), [True])))
        begin, end = window[head], window[tail] + LENGTH
        name = hashes.of(begin, end) ^ mixed((end - begin).astype(np.uint64))
        fresh = _first_of(name)
        place = owner[head]
        offset = at["at"][own][place] + begin - starts[place]
        ids, texts = at["id"][own][place], at["hash"][own][place]
        yield ids[~fresh], texts[~fresh], offset[~fresh], (offset + end - begin)[~fresh]
        begin, length = begin[fresh], (end - begin)[fresh]
        ids, texts, offset = ids[fresh], texts[fresh], offset[fresh]
        first = RunIndex(text[_ragged(begin, length)], length).first_equal(LENGTH)
        put = np.cumsum(length) - length + np.arange(len(length))  # with a separator after each
        places = _ragged(put, length - LENGTH + 1)
        again = first[places] < places
        piece = np.repeat(np.arange(len(length)), length - LENGTH + 1)[again]
        at_byte = offset[piece] + places[again] - put[piece]
        yield ids[piece], texts[piece], at_byte, at_byte + LENGTH


def _resolve(table: pa.Table, targets: int) -> pa.Table:
    """One bucket: marks that blocks sent along, then those among its contexts and windows."""
    out = [x for x in zip(table["target"].to_pylist(), table["marks"].to_pylist(), strict=True) if x[1] is not None]
    blobs = [x for x in zip(table["fields"].to_pylist(), table["content"].to_pylist(), strict=True) if x[0] is not None]
    found: list[tuple[np.ndarray, ...]] = []
    if blobs:
        parts = [_unpacked(*x) for x in blobs]
        contents = [c for _, c in blobs]
        blob = np.repeat(np.arange(len(parts)), [len(p["id"]) for p in parts])
        row = np.concatenate([np.cumsum(p["count"] + LENGTH - 1) - (p["count"] + LENGTH - 1) for p in parts])
        at = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        order = np.lexsort((at["at"], at["hash"], at["id"], at["content"], at["gram"]))
        sorted_ = {k: v[order] for k, v in at.items()}
        same = lambda *names: np.logical_and.reduce([sorted_[n][1:] == sorted_[n][:-1] for n in names])
        head = np.concatenate(([True], ~same("gram", "content")))
        leader = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        twin = np.logical_and.reduce([sorted_[n] == sorted_[n][leader] for n in ("id", "hash", "at")])  # the same row of the table again
        later = order[~twin]
        found.append((at["id"][later], at["hash"][later], at["at"][later], (at["at"] + at["count"] + LENGTH - 1)[later]))
        lone = sorted_["gram"][head]
        shared = np.zeros(len(lone), bool)
        shared[1:] |= lone[1:] == lone[:-1]
        shared[:-1] |= lone[1:] == lone[:-1]
        if shared.any():
            found += _several(at, order[head][shared], contents, blob, row)
    records = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64).reshape(4, -1).T for x in table["windows"].to_pylist() if x is not None]
    if records:
        r = np.concatenate(records)
        r = r[np.lexsort((r[:, 3], r[:, 2], r[:, 1], r[:, 0]))]
        leader = np.maximum.accumulate(np.where(np.concatenate(([True], r[1:, 0] != r[:-1, 0])), np.arange(len(r)), 0))
        r = r[(r[:, 1:] != r[leader, 1:]).any(axis=1)]
        found.append((r[:, 1], r[:, 2], r[:, 3], r[:, 3] + LENGTH))
    out += _packed_marks(found, targets)
    return pa.table([pa.array([t for t, _ in out], pa.int32()), pa.array([m for _, m in out], pa.binary())], names=["target", "marks"])


def _crowded(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Anchors of very many different contexts (sorted hashes, at most HOT_SHARE), and the number of all contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, _, _ in _contexts(batches, None):
            fresh = _first_of(at["gram"], at["content"])
            value, times = np.unique(at["gram"][fresh], return_counts=True)
            many = times > 1
            total = int(fresh.sum())
            yield pa.RecordBatch.from_arrays([pa.array([None, *value[many].astype(np.int64).tolist()], pa.int64()), pa.array([total, *times[many].tolist()], pa.int64())], names=["gram", "times"])

    counts = cut_lineage(rows.mapInArrow(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")))
    total = counts.filter("gram is null").agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("gram").isNotNull() & (F.col("times") >= max(HOT_LEAST, total / HOT_SHARE))).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in hot], np.int64).astype(np.uint64)), total


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Marks of all documents, packed by target, and the number of targets."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    spark = docs.sparkSession
    hot, total = _crowded(rows)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    sent = _dealt(rows, buckets, spark.sparkContext.broadcast(hot))
    return sent.groupBy("bucket").applyInArrow(lambda table: _resolve(table, buckets), _MARKS), buckets


def kept_bytes(raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, int, int]:
    """What stays of a text, how many bytes go, and in how many runs."""
    if not len(start):
        return raw, 0, 0
    edges = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, stop, -1)
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _cut(docs: DataFrame, id_col: str, text_col: str, keep: list[str], made: str, make) -> DataFrame:
    """`keep` columns of `docs`, and those `made` of each text, what stays of it, removed bytes and runs.

    Documents go to their target with their text compressed, and meet its marks there.
    """
    marks, targets = repeats(docs, id_col, text_col)
    carried = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__hash"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__c{k}") for k, c in enumerate(keep)])
    extra = list(carried.schema.fields[3:])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            target = _target(ids.fill_null(_NO_ID).to_numpy(), hashes.to_numpy(), targets)
            texts = [packer.compress(t.as_py().encode("utf-8", "surrogatepass")) if t.is_valid else None for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), ids, hashes, pa.array(texts, pa.binary()), *batch.columns[3:]], names=["target", "id", "hash", "packed", *batch.schema.names[3:]])

    fields = [*T._parse_datatype_string("target int, id long, hash long, packed binary").fields, *extra]
    packed = carried.mapInArrow(pack, T.StructType(fields))
    new = T._parse_datatype_string(made).fields

    def cut(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        ids, hashes, start, stop = _unpacked_marks(found["marks"].to_pylist())
        order = np.lexsort((hashes, ids))
        ids, hashes, start, stop = ids[order], hashes[order], start[order], stop[order]
        heads = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))) if len(ids) else np.empty(0, np.int64)
        where = {(int(ids[a]), int(hashes[a])): (int(a), int(b)) for a, b in zip(heads, [*heads[1:], len(ids)], strict=False)}
        unpack = zstandard.ZstdDecompressor()
        out = []
        for i, h, p in zip(rows["id"].to_pylist(), rows["hash"].to_pylist(), rows["packed"], strict=True):
            raw = unpack.decompress(p.as_py()) if p.is_valid else b""
            a, b = where.get((_NO_ID if i is None else i, h), (0, 0))
            out.append(make(p.is_valid, raw, *kept_bytes(raw, start[a:b], stop[a:b])))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.table([*(rows[f"__c{k}"] for k in range(len(keep))), *columns], names=names)

    kinds = [{"bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in new]
    names = [f.name for f in (*extra, *new)]
    both = packed.groupBy("target").cogroup(marks.groupBy("target")).applyInArrow(cut, T.StructType([*extra, *new]))
    return both.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(keep)], *[f.name for f in new])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with repeats cut out of their texts; bytes left over from a cut character become U+FFFD. A null text stays null."""
    others = [c for c in docs.columns if c != text_col]
    done = _cut(docs, id_col, text_col, others, "__new string", lambda known, raw, kept, removed, runs: (kept.decode("utf-8", "replace") if known else None,))
    return done.select(*[F.col("__new").alias(c) if c == text_col else c for c in docs.columns])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _cut(docs, "doc_id", "text", ["doc_id"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda known, raw, kept, removed, runs: (len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
