"""Nulls, empty and repeated rows, ties, empty tables and clashing columns, for every operator."""

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from lakeloom.llm import bpe, decontaminate, license_scan, near_dedup, order_minhash, quality, secret_scan, suffix_dedup, toxicity, url_reputation

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__id` string, `__hash` string, `__score` string, `__text` string, id string, bucket string"
TEXT = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals in the big dark forest today"
ROWS = [
    (None, TEXT, "en", "s", 10, "a", "b", "c", "d", "e", "f"),
    (None, None, None, None, None, None, None, None, None, None, None),
    (1, None, "en", "s", 0, "a", "b", "c", "d", "e", "f"),
    (2, "", "en", "s", 0, "a", "b", "c", "d", "e", "f"),
    (3, TEXT, "en", "s", 10, "a", "b", "c", "d", "e", "f"),
    (3, TEXT, "en", "s", 10, "a", "b", "c", "d", "e", "f"),
    (3, "other text of the same id", "en", "s", 10, "a", "b", "c", "d", "e", "f"),
    (4, " \n\t ", "fr", "s", 4, "a", "b", "c", "d", "e", "f"),
    (5, "é" * 300 + " token=abcdefgh1234", "fr", "s", 300, "a", "b", "c", "d", "e", "f"),
    (6, "word " * 40_000, "en", "s", 200_000, "a", "b", "c", "d", "e", "f"),
]
LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id string, text string"

OPERATORS = {
    "secret_scan": lambda d, spark: secret_scan.scan(d),
    "redact": lambda d, spark: secret_scan.redact(d),
    "license_scan": lambda d, spark: license_scan.scan(d),
    "toxicity": lambda d, spark: toxicity.keep_clean(d, spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, None)], LABELS)),
    "suffix_dedup": lambda d, spark: suffix_dedup.remove(d),
    "quality": lambda d, spark: quality.keep_good(d, spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, None)], LABELS)),
    "decontaminate": lambda d, spark: decontaminate.decontaminate(d, spark.createDataFrame([("x", "jumps over the lazy dog and runs away from all of"), (None, None), ("y", "")], BENCH)),
    "order_minhash": lambda d, spark: order_minhash.compare_edited(d),
    "bpe": lambda d, spark: bpe.digests(d),
    "near_dedup": lambda d, spark: near_dedup.keep_first(d),
}
DROPS = {"toxicity", "quality", "decontaminate", "near_dedup"}
KEEPS_COLUMNS = {"redact", "toxicity", "suffix_dedup", "quality", "decontaminate", "near_dedup"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = OPERATORS[name](docs, spark)
    rows = found.collect()
    assert len(rows) <= len(ROWS) if name in DROPS else len(rows) == len(ROWS)
    if name in KEEPS_COLUMNS:
        assert found.columns == docs.columns
        assert all(r["__score"] in ("c", None) and r["bucket"] in ("f", None) for r in rows)


def _by_id(df, *columns):
    return sorted([(r.doc_id is not None, r.doc_id or 0, *(r[c] for c in columns)) for r in df.collect()], key=repr)


def test_values_of_odd_rows(spark):
    """Null, empty, repeated and long texts: what each operator gives for them."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    texts = [(r[0] is not None, r[0] or 0, r[1]) for r in ROWS]
    found = secret_scan.scan(docs).selectExpr("doc_id", "n_assign", "transform(all_spans, s -> concat_ws(':', s.kind, s.start, s.end)) AS spans")
    assert _by_id(found, "n_assign", "spans") == sorted([(known, i, int(i == 5), ["assign:301:319"] if i == 5 else []) for known, i, _ in texts], key=repr)
    words = _by_id(license_scan.scan(docs), "n_words")
    assert words == sorted([(known, i, len((t or "").split()) + (t or "").count("=")) for known, i, t in texts], key=repr)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    assert _by_id(bpe.digests(docs), "n_tokens") == sorted([(known, i, len(library.encode_ordinary(t or ""))) for known, i, t in texts], key=repr)
    left = {"the": TEXT, "é": "é token=abcdefgh1234", "word": "word "}
    cut = lambda known, t: t if not t or len(t) < 100 else "" if known and t == TEXT else next(v for k, v in left.items() if t.startswith(k))
    assert _by_id(suffix_dedup.remove(docs), "text") == sorted([(known, i, cut(known, t)) for known, i, t in texts], key=repr)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](docs, spark).collect() == []


def test_near_duplicates_of_odd_rows(spark):
    kept = near_dedup.keep_first(spark.createDataFrame(ROWS, SCHEMA)).collect()
    # The null id shares a text with id 3, so id 3 stays; texts without words stay; repeated rows stay alike.
    assert sorted((r.doc_id is not None, r.doc_id or 0, (r.text or "")[:3]) for r in kept) == sorted([(False, 0, ""), (True, 1, ""), (True, 2, ""), (True, 3, "the"), (True, 3, "the"), (True, 3, "oth"), (True, 4, " \n\t"), (True, 5, "ééé"), (True, 6, "wor")])


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "x" * 150 + "A"), (1, "x" * 150 + "A"), (2, "B" + "x" * 150)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in suffix_dedup.remove(docs).collect())
    assert got == [(1, "xA"), (1, "xA"), (2, "B")]


def test_urls(spark):
    rows = [(1, "https://Example.org/es/a?b"), (2, None), (3, "no scheme"), (3, "no scheme"), (4, "http://sub.example.org/en/12#x"), (5, "http://a.com"), (6, "x://b.net/de/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("example.org", "/es/a", "example.org/es/", "block")
    assert got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][:3] == ("a.com", "", None)
    assert got[6][2] is None
    assert url_reputation.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_pipeline_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.to_tokens(spark, docs, sf_dir).collect() == []


def test_redaction_leaves_the_rest(spark):
    row = secret_scan.redact(spark.createDataFrame(ROWS, SCHEMA).filter("doc_id = 5")).first()
    assert row.text == "é" * 300 + " [SECRET]"


def test_private_keys_go_whole(spark):
    key = lambda kind, body: f"-----BEGIN {kind}PRIVATE KEY-----{body}-----END {kind}PRIVATE KEY-----"
    texts = {
        1: ("a " + key("", "\nMIIEvQ+/Ab\nCd==\n") + " b", "a [SECRET] b"),
        2: (key("RSA ", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F\n\nMIIE\n") + key("EC ", "\\nMHcC\\n"), "[SECRET][SECRET]"),
        3: ("-----BEGIN PRIVATE KEY----- is a key's first line - and no more", "[SECRET] is a key's first line - and no more"),
        4: ("-----END PRIVATE KEY-----", "-----END PRIVATE KEY-----"),
    }
    docs = spark.createDataFrame([(i, text) for i, (text, _) in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secret_scan.redact(docs).collect()} == {i: text for i, (_, text) in texts.items()}


def test_benchmark_in_blocks_finds_the_same(spark):
    words = [f"w{k}" for k in range(60)]
    bench = spark.createDataFrame([(f"i{k}", " ".join(words[k * 7 : k * 7 + 12])) for k in range(7)] + [("short", "w59 w0"), (None, "w3 w2"), ("none", "...")], BENCH)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5:40])), (3, "w59 w0 w3 w2"), (4, None), (4, None), (5, "w1")], "doc_id long, text string")
    found = lambda size: sorted(map(str, decontaminate.match(docs, bench, block_words=size).collect()))
    assert len(list(decontaminate.blocks(bench, block_words=20))) > 3
    assert found(20) == found(1) == found(200_000)


def test_decontamination_cuts_the_passage(spark):
    docs = spark.createDataFrame([(1, "keep this much of it, and more of it, and yet more: Jumps over, the lazy dog and runs away from all of; end")], "doc_id long, text string")
    bench = spark.createDataFrame([("x", "jumps over the lazy dog and runs away from all")], BENCH)
    assert decontaminate.decontaminate(docs, bench).first().text == "keep this much of it, and more of it, and yet more:   of; end"
