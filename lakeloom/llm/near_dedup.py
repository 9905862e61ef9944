"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidate edges.

A text's set is its distinct runs of five words. Texts with equal sets are one node (copies
never meet each other, they only carry the node's number). A node's signature comes from
one permutation: its hashes fall into `BINS` bins, each bin keeps its least hash, an empty
bin takes the value of the first filled bin in a random order of its own (optimal
densification). `ROWS` consecutive bins are a band; nodes that agree on a band share a
bucket. With 36 bands of 4, two sets of similarity 0.75 miss each other in all bands with a
chance of about one in a million.

Candidate edges are stars: every member of a bucket is paired with the bucket's centre alone,
the node that meets most others in all its buckets, so that a bucket of m nodes brings m - 1
pairs. Each is compared on whole sets once, which tells both whether its ends are linked and
how a member differs from its centre.

Stars alone could lose a link between two members that are in different components then.
At least one of them, J, is not linked to the centre C, and this bounds from below how much both
members' differences from the centre must have in common: with q = (1 - s) / (1 + s), d for the
size of a difference from C and n for sizes of sets, a link of I and J needs
t = (d(I) + d(J) - q (n(I) + n(J))) / 2 common elements. This is more than
(d(I) + q (n(C) - n(I))) / 2, at least (d(J) - q (n(C) + n(J))) / (1 + q), and, as linked sets
are about as far from any third, at least d - n (1 - s) / s for either. A difference is what a
member lost of the centre and what it has new. Two members have no more lost elements in common
than the fewer of theirs, so they must share a new one unless both keep (n(I) + n(J)) / (1 + 1/s)
elements of the centre; these pairs alone are looked for by lost elements. Either kind is
ordered by how many members of the star have an element, the rarest first, and the members must share
one near their beginnings (prefix filter), the first of these with enough left in both from there
on (positional filter), and enough of them near their beginnings to make t with all that comes
later. Copies with edits of their own share no new elements, however large their group. A pair
of members that also are in the star which their centre is a member of is looked at there alone,
where what the centre itself has new or lost is no difference.

Spark. Texts are shuffled once, and only those with a candidate edge go on (compressed, as a
table in the shared folder). A centre's pairs are dealt out in parts of `PART`. Sets, buckets and edges are joined on their keys; the only
things that come to the driver are counts. Components grow by large-star and small-star
steps on an edge table, each written to the shared folder, so a lost executor costs a step.

Defined cases: null and empty texts and texts without words have the empty set and are linked
with nothing; repeated rows (same id) have the same component and are kept or dropped
alike; null ids take part, and a component of null ids alone has the component id null and is
kept; an empty table gives an empty result; other columns are ignored by `components` and
kept by `keep_first`. Sets are compared as 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import mixed, shingles
from lakeloom.session import cut_lineage, small_batches

BINS, ROWS, WORDS = 144, 4, 5
PERCENT = 75
#: Pairs of one centre that are compared in one place.
PART = 500

_ORDERS = np.argsort(np.random.default_rng(20240229).random((BINS, BINS)), axis=1)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text lower-cased in A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def signature(found: np.ndarray) -> np.ndarray:
    """Least hash in each bin of a non-empty set, empty bins filled by densification."""
    hashes = np.sort(mixed(found ^ np.uint64(0x5851F42D4C957F2D)))
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    filled = np.zeros(BINS, bool)
    values = np.zeros(BINS, np.uint64)
    at = bins[first].astype(np.int64)
    filled[at], values[at] = True, hashes[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        orders = _ORDERS[empty]
        values[empty] = values[orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]]
    return values


def bands(found: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = signature(found).reshape(-1, ROWS)
    key = np.arange(len(rows), dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def node_of(found: np.ndarray) -> int:
    """The number of a set: a 64-bit hash of all of it."""
    parts = np.array([np.bitwise_xor.reduce(mixed(found + np.uint64(1))), found.sum(dtype=np.uint64)])
    return int(mixed(parts * np.uint64(3) + mixed(parts[::-1]))[0].astype(np.int64))


def _described(docs: DataFrame) -> DataFrame:
    """From rows (id, text): id, hash of the text, node (null: empty set), n, and the band keys."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(words_of(text), WORDS)
                sizes.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                keys.append(bands(found).astype(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "hash", "node", "n", "bands"])

    return docs.mapInArrow(describe, "id long, hash long, node long, n long, bands array<long>")


def _contents(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, n, text compressed) of the nodes' first documents."""
    wanted = nodes.select(F.xxhash64("first.id", "first.hash").alias("key"), F.col("first.id").alias("__id"), F.col("first.hash").alias("__hash"), "node", "n")
    keyed = docs.withColumn("key", F.xxhash64("id", "hash"))
    rows = keyed.join(wanted, "key").filter(F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")))
    rows = rows.dropDuplicates(["key", "node"]).select("node", "n", "text")  # by the join's key, so that texts are shuffled once

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["node", "n", "packed"])

    return cut_lineage(rows.mapInArrow(packed, "node long, n long, packed binary"))


def _linked(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(x, y, percent) for x, y in _sets(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _with_contents(pairs, contents).select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _sets(first: pa.Array, second: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of each pair of compressed texts."""
    unpack = zstandard.ZstdDecompressor()
    known, cached = None, np.empty(0, np.uint64)  # a centre's pairs follow one another
    for ta, tb in zip(first, second, strict=True):
        ta, tb = ta.as_buffer().to_pybytes(), tb.as_buffer().to_pybytes()
        if ta != known:
            known, cached = ta, shingles(unpack.decompress(ta).lower().split(), WORDS)
        yield cached, shingles(unpack.decompress(tb).lower().split(), WORDS)


def _with_contents(pairs: DataFrame, contents: DataFrame, stored: bool = False) -> DataFrame:
    """Pairs (a, b, ...) with the compressed texts ta and tb. A centre `a` of very many pairs is dealt out in parts of `PART` pairs.

    Pairs are needed three times, so they are written unless they are `stored`: else the driver plans, and plans anew after each stage, all that they come from three times.
    """
    pairs = pairs if stored else cut_lineage(pairs)
    side = lambda c: contents.select(F.col("node").alias(c), F.col("packed").alias(f"t{c}"))
    parts = pairs.groupBy("a").agg(F.floor(F.count(F.lit(1)) / PART).alias("last"))
    centers = side("a").join(parts, "a").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"))
    large = F.broadcast(parts.filter("last > 0"))  # a row for each `PART` pairs at most
    dealt = pairs.join(large, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("last", F.lit(0).cast("long")) + 1)).drop("last")
    return dealt.join(side("b"), "b").join(centers, ["a", "part"])


def _compared(stars: DataFrame, contents: DataFrame, percent: int, stored: bool = False) -> DataFrame:
    """Pairs (a, b) of centre and member with the sizes of their sets (`nc`, `n`), whether they are `linked`, and what the member lacks of its centre (`lost`) and has besides (`new`)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for center, own in _sets(batch.column(2), batch.column(3)):
                lost, new = (np.setdiff1d(x, y, assume_unique=True).astype(np.int64) for x, y in ((center, own), (own, center)))
                rows.append((len(center), len(own), 100 * (len(own) - len(new)) >= percent * (len(center) + len(new)), lost, new))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["a", "b", "nc", "n", "linked", "lost", "new"])

    pairs = _with_contents(stars.select("a", "b"), contents, stored).select("a", "b", "ta", "tb")
    return cut_lineage(pairs.mapInArrow(compare, "a long, b long, nc long, n long, linked boolean, lost array<long>, new array<long>"))


def _differences(stars: DataFrame, roots: DataFrame, contents: DataFrame) -> DataFrame:
    """Members of the stars whose members are in several components, with their differences from their centre. Stars (a, b) that weren't compared are compared here.

    `out` says that a member is in another component than its centre, `home` that it also is in the
    largest star which its centre is a member of: pairs of such members are looked at there. (A centre outweighs
    its members, so that homes don't go round in circles.)
    """
    compared = stars if "lost" in stars.columns else _compared(stars, contents, PERCENT)
    stars = compared.select("a", "b")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    named = stars.join(root("a"), "a", "left").join(root("b"), "b", "left").select("a", "b", (~F.coalesce("ra", "a").eqNullSafe(F.coalesce("rb", "b"))).alias("out"), F.coalesce("rb", "b").alias("root"))
    named = cut_lineage(named)
    sizes = stars.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    homes = stars.join(sizes, "a").groupBy(F.col("b").alias("c")).agg(F.max(F.struct("size", "a")).alias("best")).select(F.col("c").alias("a"), F.col("best.a").alias("at"))
    at_home = named.join(homes, "a").join(stars.select(F.col("a").alias("at"), "b"), ["at", "b"]).select("a", "b", F.lit(True).alias("home"))
    named = cut_lineage(named.join(at_home, ["a", "b"], "left").withColumn("home", F.coalesce("home", F.lit(False))))
    several = named.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("home").alias("home")).filter("low <> high and not home").select("a")
    members = named.join(several, "a").join(compared, ["a", "b"])
    return members.select(F.col("a").alias("center"), F.col("b").alias("node"), "out", "home", "root", "nc", "n", "lost", "new")


def _beside(stars: DataFrame, roots: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one star, in different components, that may be linked."""
    found = cut_lineage(_differences(stars, roots, contents))
    kind = lambda new: F.transform("new" if new else "lost", lambda t: F.struct(F.lit(new).alias("new"), t.alias("token")))
    row = ["center", "node", "out", "home", "root", "nc", "n", "lost", "new"]
    tokens = found.select(*row[:7], F.size("lost").alias("lost"), F.size("new").alias("new"), F.explode(F.concat(kind(True), kind(False))).alias("t"))
    tokens = tokens.select(*row, F.col("t.new").alias("is_new"), F.col("t.token").alias("token"))
    # What only members of one component have tells nothing of pairs across components: it stands first in the order, as if one member had it, and meets nothing.
    often = tokens.groupBy("center", "token").agg(F.count(F.lit(1)).alias("times"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("center", "token", "times")
    # The rest follows by how many members have it.
    shared = F.transform(F.sort_array(F.collect_list(F.struct("times", "token"))), lambda x: x["token"]).alias("shared")
    ordered = cut_lineage(tokens.join(often, ["center", "token"]).groupBy(*row, "is_new").agg(shared))
    d, more, less = F.col("lost") + F.col("new"), 100 + percent, 100 - percent
    near = F.ceil((percent * d - less * F.col("n")) / percent)  # two linked members are about as far from the centre
    least = {
        "i": F.greatest(F.lit(1), near, F.floor((more * d + less * (F.col("nc") - F.col("n"))) / (2 * more)) + 1),
        "j": F.greatest(F.lit(1), near, F.ceil((more * d - less * (F.col("nc") + F.col("n"))) / 200)),
    }

    def side(x: str) -> DataFrame:
        """Elements near the beginning: all but the last `needed - 1` of a member's new or lost ones."""
        needed = F.when(F.col("is_new"), F.greatest(F.lit(1), least[x] - F.col("lost"))).otherwise(least[x])
        size = F.when(F.col("is_new"), F.col("new")).otherwise(F.col("lost"))
        mine = ordered.filter("out") if x == "j" else ordered
        alone = size - F.size("shared")
        front = F.slice("shared", F.lit(1), F.greatest(size - needed + 1 - alone, F.lit(0)).cast("int"))
        named = [F.col(c).alias(f"{c}_{x}") for c in ("node", "home", "root", "n", "lost", "new")]
        mine = mine.select("center", "is_new", *named, (needed - 1).alias(f"later_{x}"), (size - alone).alias(f"left_{x}"), F.posexplode(front).alias("at", "token"))
        return mine.withColumn(f"left_{x}", F.col(f"left_{x}") - F.col("at")).drop("at")

    both = lambda f, c: f(*[F.col(f"{c}_{x}") for x in "ij"])
    total = F.col("n_i") + F.col("n_j")
    able = (F.col("root_i") != F.col("root_j")) & ~(F.col("home_i") & F.col("home_j")) & (100 * both(F.least, "n") >= percent * both(F.greatest, "n"))
    wanted = more * (F.col("lost_i") + F.col("new_i") + F.col("lost_j") + F.col("new_j")) - less * total  # 2 * more * t
    # Members that share nothing new have no more in common than what either keeps of the centre.
    kept = F.least(F.col("n_i") - F.col("new_i"), F.col("n_j") - F.col("new_j"))
    met = side("i").join(side("j"), ["center", "is_new", "token"]).filter(able & (F.col("is_new") | (more * kept >= percent * total)))
    # Most is left in both at a pair's first shared element; elements after it count however little is left there.
    besides = F.when(F.col("is_new"), both(F.least, "lost")).otherwise(0)
    counted = met.groupBy("center", "is_new", "node_i", "node_j", wanted.alias("wanted"), besides.alias("besides"), both(F.greatest, "later").alias("later"))
    counted = counted.agg(F.count(F.lit(1)).alias("both"), F.max(both(F.least, "left")).alias("left"))
    pairs = counted.filter(F.col("wanted") <= 2 * more * (F.col("besides") + F.least(F.col("left"), F.col("both") + F.col("later"))))
    return pairs.select(both(F.least, "node").alias("a"), both(F.greatest, "node").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes in `edges` (a, b), root being the least node reachable.

    Large-star and small-star steps in turn until the edges are stars around least nodes; each step is written.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    ends = lambda df, c, down: df.select(F.col(c).alias("node"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
    while True:
        # All edges go down. Where no node has two of them, or one besides one from above, nothing is left to change.
        met = ends(now, "a", 1).union(ends(now, "b", 0)).groupBy("node").agg((F.sum("down") + F.max("up")).alias("edges"))
        if (met.agg(F.max("edges")).first()[0] or 0) <= 1:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        down = now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.union(now.select(F.col("a").alias("u"), F.col("b").alias("v"))).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()  # one exchange for both uses
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        now = cut_lineage(small.filter("a <> b").distinct())


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after more links (a, b): a node's root stands for all links so far, so only new ones can change anything."""
    more = cut_lineage(links)
    return roots if more.isEmpty() else connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of `docs`: id, hash (of the text), n_shingles, component_id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    described = _described(rows)
    members = cut_lineage(described)
    first = F.min(F.struct("id", "hash")).alias("first")
    # Null ids come first in Spark's order of structs; the least id of a component is taken from real ids only.
    nodes = cut_lineage(members.filter("node is not null").groupBy("node").agg(first, F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    keys = nodes.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = cut_lineage(keys.join(shared, "band"))
    weights = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = cut_lineage(buckets.join(weights, "node").select("band", "node", "weight"))
    centers = weighed.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("best")).select("band", F.col("best.node").alias("center"))
    met = weighed.join(centers, "band").filter("node <> center")
    stars = cut_lineage(met.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct())
    wanted = stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node"))).distinct()
    contents = _contents(rows, nodes.select("node", "n", "first").join(wanted, "node", "left_semi"))
    compared = _compared(stars, contents, percent, stored=True)
    roots = connected(compared.filter("linked").select("a", "b"))
    roots = joined(roots, _linked(_beside(compared, roots, contents, percent), contents, percent))
    named = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = cut_lineage(named.join(lowest, "root").select("node", "component_id"))
    alone = members.filter("node is null").select("id", "hash", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return members.filter("node is not null").join(of_node, "node").select("id", "hash", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def keep_first(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with only the least id of each group of near-duplicates."""
    found = components(docs, percent, id_col, text_col).filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["__id"]) & (F.xxhash64(text) == found["__hash"]), "left_semi")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS x FROM d),
t AS (SELECT doc_id, len(x) AS n, unnest(x) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t AS a JOIN t AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
