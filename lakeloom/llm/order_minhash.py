"""Document fingerprints by Order MinHash, as DataFrame operations.

A text's tokens are its words, runs without white space, of up to 16 characters; longer runs
(text of scripts without spaces, encoded data) give a token for each character, so that no token
depends on where its run begins. K-mers are the runs of `K` tokens (all tokens of a shorter text are
one). Each k-mer carries its
occurrence number, so that repeats count. One hash of (k-mer, occurrence) deals it to one of
`BINS` bins and ranks it there; a bin keeps its `LENGTH` k-mers of least rank, puts them back
into their order in the text and hashes that tuple. The fingerprint holds the filled bins with
their tuples. Texts that share content in the same order share tuples; the same content in
another order does not, which is what makes the likeness follow the edit distance. The likeness
of two fingerprints is the share of equal tuples among bins that either of them fills.

Everything is built-in functions on arrays of 64-bit numbers: hashes and positions are
packed into one number (34 bits and 30 bits), so that sorting is a sort of longs, and the
occurrence number comes from a binary search in the sorted array, so that time is n log n also
for texts of one repeated word. Nothing is exploded.

The next document (descending id) is found without one global sort: ids are cut into ranges
at approximate quantiles (their number, `RANGES`, is fixed or follows the rows), a window within
each range hands over the following row; the first row of the next range that has any stands
at its end. The text is shuffled once; each text's fingerprint is made once, and handed over with it.

Defined cases: null and empty texts have no tokens and an empty fingerprint; two empty
fingerprints are alike (1.0), an empty and a filled one are not (0.0); equal ids are ordered by
their texts' hashes, and rows with equal id and text follow one another; null ids come last;
a table of one row is its own next document; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import let
from lakeloom.session import cut_lineage

K, BINS, LENGTH = 3, 64, 2
RANGE_ROWS = 4_000
MOST_RANGES = 20_000

_SOLID = r"[^\x20\x09-\x0D]"
_POSITION_BITS = 30
_POSITION = (1 << _POSITION_BITS) - 1
_BIN_SHIFT = 64 - 6


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _packed(hash_: Column, position: Column) -> Column:
    return hash_.bitwiseAND(_long(~_POSITION)).bitwiseOR(position.cast("long"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?<!{_SOLID}){_SOLID}{{1,16}}+(?!{_SOLID})|{_SOLID}"), F.lit(0))


def kmers(text: Column) -> Column:
    """Hashes of a text's k-mers in order, packed with their positions."""

    def of(t: Column) -> Column:
        last = F.greatest(F.size(t) - K, F.lit(0))
        one = lambda i: _packed(F.xxhash64(*[F.get(t, i + j) for j in range(K)]), i)
        return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<long>"))

    return let(tokens(text), of)


def _numbered(sorted_: Column) -> Column:
    """Sorted packed k-mers as packed hashes of (k-mer, occurrence number), sorted by bin and rank."""
    same = lambda x, y: x.bitwiseXOR(y).bitwiseAND(_long(~_POSITION)) == 0
    steps = F.array(*[F.lit(1 << k) for k in range(_POSITION_BITS - 1, -1, -1)])

    def one(x: Column, i: Column) -> Column:
        earlier = lambda acc, step: F.when(F.coalesce((i - acc >= step) & same(F.get(sorted_, i - acc - step), x), F.lit(False)), acc + step).otherwise(acc)
        repeated = F.coalesce((i > 0) & same(F.get(sorted_, i - 1), x), F.lit(False))
        number = F.when(repeated, F.aggregate(steps, F.lit(0), earlier)).otherwise(F.lit(0))
        return _packed(F.xxhash64(F.shiftright(x, _POSITION_BITS), number), x.bitwiseAND(_long(_POSITION)))

    return F.sort_array(F.transform(sorted_, one))


def fingerprint(text: Column) -> Column:
    """Filled bins in order, as an array of longs: the bin in the upper 6 bits, the tuple's hash below."""
    bin_of = lambda x: F.shiftrightunsigned(x, _BIN_SHIFT)

    def of(chosen: Column, in_order: Column) -> Column:
        """`chosen`: sorted packed numbers; `in_order`: k-mers by position."""
        place = lambda i: F.get(chosen, i).bitwiseAND(_long(_POSITION)).cast("int")
        kmer = lambda p: F.shiftright(F.get(in_order, p), _POSITION_BITS)

        def tuple_at(x: Column, i: Column) -> Column:
            leads = (i == 0) | (bin_of(F.get(chosen, i - 1)) != bin_of(x))
            places = [F.when((F.get(chosen, i + j).isNotNull()) & (bin_of(F.get(chosen, i + j)) == bin_of(x)), place(i + j)) for j in range(LENGTH)]
            ordered = F.array_sort(F.array_compact(F.array(*places)))
            value = F.xxhash64(F.transform(ordered, kmer))
            packed = F.shiftleft(bin_of(x), _BIN_SHIFT).bitwiseOR(F.shiftrightunsigned(value, 64 - _BIN_SHIFT))
            return F.when(leads, packed)

        return F.array_compact(F.transform(chosen, tuple_at))

    least = lambda s: F.filter(s, lambda x, i: F.coalesce((i < LENGTH) | (bin_of(F.get(s, i - LENGTH)) != bin_of(x)), F.lit(True)))
    ranked = lambda k: let(F.sort_array(k), _numbered)
    return let(kmers(text), lambda k: let(let(ranked(k), least), lambda c: of(c, k)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either fingerprint fills."""
    bins = lambda x: F.transform(x, lambda v: F.shiftrightunsigned(v, _BIN_SHIFT))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def written(fingerprint_: Column) -> Column:
    return F.array_join(F.transform(fingerprint_, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows id, text, next_text: the text of the next row by descending id, the first row's for the last. Each text comes with its fingerprint."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    total = docs.count()
    n = max(1, min(MOST_RANGES, total // range_rows))
    cuts = docs.select(F.col(id_col).cast("long").alias("id")).agg(F.percentile_approx("id", [(k + 1) / n for k in range(n - 1)] or [0.5], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts if n > 1 else []))
    # Ranges are numbered in descending order of ids; null ids come last.
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    above = lambda i: _search(bounds, i, len(cuts))
    number = F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - above(F.col("id"))).cast("int")
    ranged = rows.withColumn("range", number)
    # The first row of each range that has rows; few, but their texts may be long, so they are joined, not collected.
    key = F.struct(F.coalesce(-F.col("id"), F.lit(0)).alias("k"), "hash")
    heads = cut_lineage(ranged.groupBy("range").agg(F.min_by("text", key).alias("text")))
    present = sorted(r["range"] for r in heads.select("range").collect())
    follows = zip(present, [*present[1:], *present[:1]], strict=True)
    before = docs.sparkSession.createDataFrame([(b, a) for a, b in follows] or [], "range int, of int")
    # They end the range before theirs, so that every row has a following one, and go then.
    ends = heads.join(F.broadcast(before), "range").select(F.lit(None).cast("long").alias("id"), "text", F.lit(0).cast("long").alias("hash"), F.col("of").alias("range"), F.lit(True).alias("end"))
    every = ranged.withColumn("end", F.lit(False)).unionByName(ends).repartition("range")
    printed = every.select("*", F.explode(F.array(fingerprint(F.col("text")))).alias("print"))
    inside = Window.partitionBy("range").orderBy("end", F.col("id").desc_nulls_last(), "hash")
    led = printed.withColumns({f"next_{c}": F.lead(c).over(inside) for c in ("text", "print")})
    return led.filter(~F.col("end")).select("id", "text", "print", "next_text", "next_print")


def _search(bounds: Column, value: Column, n: int) -> Column:
    """How many of the sorted bounds are below `value`, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)]) if n else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) < value, F.lit(False)), at + step).otherwise(at))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, and its likeness to its edited text and to the next document."""
    both = with_next(docs, id_col, text_col)
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next_text"), F.lit(1), part))
    named = both.select("id", F.length("text").cast("long").alias("n_chars"), "print", "next_print", F.explode(F.array(edited)).alias("edited"))
    prints = F.struct(F.col("print").alias("own"), fingerprint(F.col("edited")).alias("edited"), F.col("next_print").alias("next"), F.sha2("edited", 256).alias("sha"))
    found = named.select("id", "n_chars", F.explode(F.array(prints)).alias("f"))
    return found.select(F.col("id").alias(id_col), "n_chars", F.col("f.sha").alias("edited_sha256"), written(F.col("f.own")).alias("fingerprint"), written(F.col("f.edited")).alias("edited_fingerprint"), likeness(F.col("f.own"), F.col("f.edited")).alias("near_edited"), likeness(F.col("f.own"), F.col("f.next")).alias("near_next"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
