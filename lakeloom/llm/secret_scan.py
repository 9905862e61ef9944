"""Secret scan with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every
match must hold (an OR of ANDs). The index holds a posting (trigram, document) for each
query trigram that a document has; a document's postings are intersected as bits of one
mask, built by an aggregation on the document's key. Only documents whose mask satisfies a
rule's query are searched for it. Rules without mandatory trigrams (hexadecimal runs)
search every document. The index is over lower-cased text, so it can admit too much but
never too little, and the search itself decides.

All of it is DataFrame operations: postings are combined on the map side, so the index
shuffles one small row for each document; the texts are shuffled once, to meet their masks.
No key but the document's own is ever grouped, so copies and hot sources do not pile up.

Defined cases: a null text is an empty text without secrets; equal rows give equal results;
an empty table gives an empty result; other columns are ignored by `scan` and kept as they
are by `redact`. Offsets count code points, ends are exclusive. A private key is found from its
first line to its last; a first line without a last one is found alone.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import HASH, ID, TEXT, keyed, let, same_row


@dataclass(frozen=True)
class SecretRule:
    """A match counts if its `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Fixed values. `[0-9a-f]{32,}` finds what `[0-9a-f]+` finds with 32 characters or more: both take whole runs.
RULES = (
    SecretRule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    SecretRule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    SecretRule("private-key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[ \t\r\n]{0,4}(?:(?:Proc-Type|DEK-Info): [^\r\n]{0,100}[\r\n]+){0,2}[A-Za-z0-9+/= \t\r\n\\]+-----END [A-Z ]{0,20}PRIVATE KEY-----)?"),
)

_MOST_STRINGS = 64


def _strings(items) -> tuple[list[set[str]], set[str] | None]:
    """(clauses, tail): a match holds one string of each clause; tail is the set of all its texts, if there are few."""
    clauses: list[set[str]] = []
    now, whole = {""}, True

    def flush(rest: set[str] | None = None) -> None:
        nonlocal now, whole
        clauses.append(now)
        now, whole = rest or {""}, False

    for op, arg in items:
        options: set[str] | None = None
        if op is C.LITERAL:
            options = {chr(arg)}
        elif op is C.IN and all(x[0] is C.LITERAL for x in arg):
            options = {chr(x[1]) for x in arg}
        elif op is C.SUBPATTERN:
            inner, options = _strings(arg[-1])
            if options is None:
                flush()
                clauses += inner
                continue
        elif op is C.BRANCH:
            parts = [_strings(x)[1] for x in arg[1]]
            options = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            found = _strings(inner)[1]
            if found is not None and high == 1:
                options = found | ({""} if low == 0 else set())
            elif found is not None and low >= 1 and len(now) * len(found) <= _MOST_STRINGS:
                now = {a + b for a in now for b in found}
        elif op is C.AT:
            options = {""}
        if options is None or len(now) * len(options) > _MOST_STRINGS:
            flush(options if options and len(options) <= _MOST_STRINGS else None)
        else:
            now = {a + b for a in now for b in options}
    return clauses + [now], now if whole else None


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The sets of lower-case trigrams of which any match of `pattern` holds at least one whole; None if there is no such set."""
    clauses, _ = _strings(_parser.parse(pattern))
    useful = [c for c in clauses if min(map(len, c)) >= 3]
    while len(useful) > 1 and len(list(itertools.product(*useful))) > _MOST_STRINGS:
        useful.remove(max(useful, key=len))
    if not useful:
        return None
    grams = lambda s: {s[i : i + 3].lower() for i in range(len(s) - 2)}
    found = {frozenset().union(*map(grams, choice)) for choice in itertools.product(*useful)}
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of keyed documents, for these trigrams: rows (trigram number, document key)."""
    low = F.lower(F.col(TEXT))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("__low"), F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return docs.select(ID, HASH, F.explode(F.array(low)).alias("__low")).select(ID, HASH, F.explode(held).alias("gram"))


def _masks(postings: DataFrame, n: int) -> DataFrame:
    words = range((n + 61) // 62)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % 62)
    return postings.groupBy(F.col(ID).alias("__mid"), F.col(HASH).alias("__mhash")).agg(*[F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"__mask{w}") for w in words])


def _admits(query: list[frozenset[str]] | None, trigrams: list[str]) -> Column:
    """Whether a document's mask satisfies the query."""
    if query is None:
        return F.lit(True)
    admitted = F.lit(False)
    for grams in query:
        masks: dict[int, int] = {}
        for g in grams:
            k = trigrams.index(g)
            masks[k // 62] = masks.get(k // 62, 0) | 1 << k % 62
        whole = F.lit(True)
        for w, mask in masks.items():
            whole = whole & (F.col(f"__mask{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        admitted = admitted | F.coalesce(whole, F.lit(False))
    return admitted


_SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def _spans(text: Column, rule: SecretRule, place: int) -> Column:
    """All counting matches of a rule, leftmost and non-overlapping, as structs in text order."""
    regex = F.lit(rule.pattern)
    none = F.array().cast(_SPANS)

    def positions(found: Column) -> Column:
        parts = F.arrays_zip(found.alias("m"), F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("g"), F.split(text, rule.pattern, -1).alias("gap"))
        start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
            span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            counts = F.coalesce(F.length(x["g"]) >= rule.least, F.lit(False))
            return F.struct(end.alias("at"), F.when(counts, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.when(F.size(found) > 0, F.aggregate(parts, start, step)["spans"]).otherwise(none)

    return let(F.regexp_extract_all(text, regex, F.lit(0)), positions)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _searched(docs: DataFrame, postings_of: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """`docs` (with the key columns) and one array of spans for each rule, found among what the index admits."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({g for q in queries.values() if q for grams in q for g in grams})
    masks = _masks(index(postings_of, trigrams), len(trigrams))
    joined = docs.join(masks, same_row(docs, masks, "__mid", "__mhash"), "left")
    spans = [F.when(_admits(queries[r.kind], trigrams), _spans(F.col(TEXT), r, k)).otherwise(F.array().cast(_SPANS)) for k, r in enumerate(rules)]
    return joined.withColumn("__spans", F.explode(F.array(F.struct(*[s.alias(f"s{k}") for k, s in enumerate(spans)]))))


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, found spans (start, place, end, kind) by start, and those of the base rules alone."""
    rows = keyed(docs, id_col, text_col)
    found = _searched(rows, rows, rules)
    arrays = lambda keep: F.array_sort(F.concat(F.array().cast(_SPANS), *[F.col(f"__spans.s{k}") for k, r in enumerate(rules) if keep(r)]))
    counts = [F.size(f"__spans.s{k}").cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base]
    return found.select(F.col(ID).alias(id_col), *counts, arrays(lambda r: r.base).alias("base_spans"), arrays(lambda r: True).alias("all_spans"))


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with each secret in its text replaced by a mark; overlapping finds become one. A null text stays null."""
    kept = [F.col(c).alias(f"__c{k}") for k, c in enumerate(docs.columns)]
    rows = keyed(docs, id_col, text_col, *kept)
    found = _searched(rows, keyed(docs, id_col, text_col), rules)
    spans = F.array_sort(F.concat(F.array().cast(_SPANS), *[F.col(f"__spans.s{k}") for k in range(len(rules))]))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(TEXT), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        text = F.when(s["start"] >= acc["at"], F.concat(acc["text"], gap, F.lit(mark))).otherwise(acc["text"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), text.alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    clean = F.aggregate(F.col("__sorted"), start, step, lambda acc: F.concat(acc["text"], F.substring(F.col(TEXT), acc["at"] + 1, F.length(F.col(TEXT)))))
    done = found.withColumn("__sorted", F.explode(F.array(spans)))
    old = F.col(f"__c{docs.columns.index(text_col)}")
    new = F.when(old.isNull() | (F.size("__sorted") == 0), old).otherwise(clean)
    return done.select(*[new.alias(c) if c == text_col else F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"))


def _sql(rules: tuple[SecretRule, ...] = RULES) -> str:
    """The query in DuckDB's SQL, from the rules alone and without an index."""
    parts = []
    for k, r in enumerate(rules):
        pattern = r.pattern
        for word in ("password", "passwd", "secret", "token", "api", "key"):  # RE2 folds more than ASCII letters
            pattern = pattern.replace(word, "".join(f"[{c.upper()}{c}]" for c in word)) if "(?i:" in r.pattern else pattern
        pattern = pattern.replace("(?i:", "(?:").replace("'", "''")
        parts.append(f"""SELECT doc_id, n, {k} AS place, '{r.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
          's': list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
          'e': list_sum(list_transform(gap[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))), 'c': length(g[i]) >= {r.least}}}), lambda x: x.c)) AS x
        FROM (SELECT doc_id, n, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS g, regexp_split_to_array(text, '{pattern}') AS gap FROM docs WHERE regexp_matches(text, '{pattern}'))""")
    base = ", ".join(f"'{r.kind}'" for r in rules if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    line = "kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.e AS BIGINT)"
    return f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents),
    found AS ({" UNION ALL ".join(parts)}),
    sums AS (SELECT n, {counts}, string_agg({line}, ',' ORDER BY x.s, place) FILTER (WHERE kind IN ({base})) AS base, string_agg({line}, ',' ORDER BY x.s, place) AS spans FROM found GROUP BY n)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN sums USING (n)"""


SQL = _sql()
