"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items form one automaton. A document's words stream through it,
which keeps the longest suffix read so far that stands in some item; where that length
reaches the window (10 words; a shorter item is one window of its own), the words under the
window are hit, and the automaton's state tells which items hold it. `decontaminate` then
cuts hit spans out of the texts and drops documents of which too much is hit.

A broadcast automaton holds at most `BLOCK_WORDS` benchmark words (or one item, if it has
more). A larger benchmark makes several, one at a time: each reads the documents in a job of its own,
which writes what was found so far to the shared folder, so neither the driver nor a task ever
holds a second one. Documents are never shuffled, so neither copies nor hot sources matter.

Defined cases: null and empty texts have no words and no hits; benchmark rows without words
(null, empty) are no items; a null item id counts as the id `null`; equal ids count once;
equal rows give equal results; empty tables give empty results or no hits; other columns
are kept by `decontaminate` and ignored by `match`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import shielded
from lakeloom.session import cut_lineage

WINDOW = 10
BLOCK_WORDS = 200_000
HITS, ITEMS, COUNT = "__hits", "__items", "__words"

#: A-Z become a-z; bytes that are in no word become spaces; bytes from 0x80 on are parts of letters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text lower-cased in A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the root."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[str, list[int]]] = []
        for name, words in items:
            state, path = 0, []
            for w in words:
                state = self._extend(state, self.ids.setdefault(w, len(self.ids)))
                path.append(state)
            ends.append((name, path))
        self.least = min([window, *(len(w) for _, w in items)])
        self._mark(items)

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _mark(self, items: list[tuple[str, list[bytes]]]) -> None:
        """For each state: the items that hold its window, and the short items that end there."""
        held: dict[int, set[str]] = {}
        short: dict[int, set[tuple[int, str]]] = {}
        for name, words in items:
            state = 0
            for w in words:
                state = self.next[state][self.ids[w]]
                if self.length[state] >= self.window:
                    held.setdefault(state, set()).add(name)
            if len(words) < self.window:
                short.setdefault(state, set()).add((len(words), name))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):
            if s in held and self.length[self.link[s]] >= self.window:
                held.setdefault(self.link[s], set()).update(held[s])
        self.top: dict[int, int] = {}  # the state of the last `window` words read
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.top[s] = self.top[up] if self.length[up] >= self.window else s
            if above := short.get(self.link[s]):
                short[s] = short.get(s, set()) | above
        self.held = {s: held[s] for s in set(self.top.values())}
        self.short = short

    def read(self, words: list[bytes]) -> tuple[set[int], set[str]]:
        """Positions of hit words, and items with a window in them."""
        hits: set[int] = set()
        items: set[str] = set()
        known = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int64, len(words))
        gaps = np.concatenate(([-1], np.flatnonzero(known < 0), [len(words)]))
        for k in np.flatnonzero(np.diff(gaps) > self.least):  # runs of known words as long as the shortest window
            first = int(gaps[k]) + 1
            state = size = 0
            for i, c in enumerate(known[first : gaps[k + 1]].tolist(), first):
                while (to := self.next[state].get(c)) is None:
                    state = self.link[state]
                    size = self.length[state]
                state, size = to, size + 1
                if size >= self.window:
                    hits.update(range(i - self.window + 1, i + 1))
                    items |= self.held[self.top[state]]
                for n, name in self.short.get(state, ()):
                    if n <= size:
                        hits.update(range(i - n + 1, i + 1))
                        items.add(name)
        return hits, items


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Benchmark items with words, in blocks of bounded size, one block at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        if words := words_of(row["text"]):
            if block and size + len(words) > block_words:
                yield block
                block, size = [], 0
            block.append((row["id"], words))
            size += len(words)
    if block:
        yield block


def _streamed(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, block_words: int, finish=None) -> DataFrame:
    """`docs` with their finds, read against one block of the benchmark after the other.

    `finish` makes the rows of the result (columns of `docs`) of the last block's batches in the same
    pass, so that a task has one Python worker and texts go there once.
    """
    context = docs.sparkSession.sparkContext
    empty = F.array().cast("array<int>"), F.array().cast("array<string>")
    found = docs.withColumns({COUNT: F.lit(-1).cast("long"), HITS: empty[0], ITEMS: empty[1]})
    schema = found.schema
    at = found.columns.index(text_col)

    def reader(shared, finish=None):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                counts, all_hits, all_items = [], [], []
                for text, hits, items in zip(batch.column(at).to_pylist(), batch.column(HITS).to_pylist(), batch.column(ITEMS).to_pylist(), strict=True):
                    words = words_of(text)
                    more, named = automaton.read(words) if automaton else ((), ())
                    counts.append(len(words))
                    all_hits.append(sorted({*hits, *more}))
                    all_items.append(sorted({*items, *named}))
                if finish:
                    yield finish(pa.RecordBatch.from_arrays(batch.columns[:-3], names=batch.schema.names[:-3]), counts, all_hits)
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(counts, pa.int64()), pa.array(all_hits, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string()))], names=batch.schema.names)

        return read

    coming = blocks(benchmark, block_words=block_words)
    block = next(coming, None)
    while (following := next(coming, None)) is not None:
        shared = context.broadcast(Automaton(block, window))
        found = cut_lineage(found.mapInArrow(reader(shared), schema))
        shared.destroy()  # an automaton whose finds are written is needed no more
        block = following
    last = context.broadcast(Automaton(block, window) if block else None)
    return found.mapInArrow(reader(last, finish), docs.schema if finish else schema)


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with the number of words, the sorted positions of hit words, and the sorted ids of items with a window in the text."""
    return _streamed(docs, benchmark, window, text_col, block_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` without the hit spans, and without documents of whose words a greater share than `max_coverage` is hit.

    A cut leaves one space. An `n_chars` column is made to fit the new text.
    """
    plain, names = shielded(docs)
    at = docs.columns.index(text_col)

    def cut(text: str, hits: list[int]) -> str:
        raw = text.encode("utf-8", "surrogatepass")
        places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
        parts, done, k = [], 0, 0
        while k < len(hits):
            last = k
            while last + 1 < len(hits) and hits[last + 1] == hits[last] + 1:
                last += 1
            parts.append(raw[done : places[hits[k]][0]])
            done, k = places[hits[last]][1], last + 1
        return b" ".join([*parts, raw[done:]]).decode("utf-8", "surrogatepass")

    def cleaned(batch: pa.RecordBatch, counts: list[int], hits: list[list[int]]) -> pa.RecordBatch:
        columns = list(batch.columns)
        if any(hits):
            stays = [len(h) <= max_coverage * max(n, 1) for n, h in zip(counts, hits, strict=True)]
            columns[at] = pa.array([cut(t, h) if h and stay else t for t, h, stay in zip(columns[at].to_pylist(), hits, stays, strict=True)], columns[at].type)
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(stays, pa.bool_()))
        return batch

    done = _streamed(plain, benchmark, window, names[text_col], block_words, cleaned).toDF(*docs.columns)
    return done.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.size(HITS).cast("long")
    return found.select("doc_id", F.col(COUNT).alias("n_words"), n_hit.alias("n_hit"), F.size(ITEMS).cast("long").alias("n_items"), F.sha2(F.array_join(ITEMS, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT id, len(x) AS size, hash(x) AS h, x FROM (SELECT id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS x FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT n, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, sizes WHERE len(w) >= size),
found AS (SELECT n, i, p.size, id FROM (SELECT n, i, size, w[i:i + size - 1] AS x FROM places) AS p JOIN windows USING (size, x)),
hit AS (SELECT n, count(DISTINCT word) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS word FROM found) GROUP BY n),
held AS (SELECT n, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT n, id FROM found) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (n) LEFT JOIN held USING (n)"""
