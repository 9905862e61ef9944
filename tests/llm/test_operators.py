"""Operators against SQL, brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from lakeloom.llm import bpe, decontaminate, near_dedup, order_minhash, quality, queries, secret_scan, suffix_dedup, toxicity
from lakeloom.llm.common import shingles

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_fourteen_queries():
    assert len([n for n in QUERIES if n.startswith("op") or n == "pipeline"]) == 14


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if (w := raw[p : p + 100]) in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(w)
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[i] = (len(raw), sum(gone), runs, sha(bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return out


def test_repeats_by_brute_force(spark, sf_dir, texts):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op4_suffix_dedup"](spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == brute_repeats(texts)


def test_repeats_with_hot_anchors(spark, monkeypatch):
    """A passage in many documents whose surroundings differ, so that its anchors count as hot."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    rows = {i: " ".join([word() for _ in range(rng.randint(5, 30))] + [passage[rng.randint(0, 40) :]] + [word() for _ in range(9)]) for i in range(60)}
    rows[61] = "ab" * 400
    rows[62] = "ab" * 300 + "c" + "ab" * 300
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    wanted = {i: brute for i, (_, _, _, brute) in brute_repeats(rows).items()}
    for least in (10**9, 2):
        monkeypatch.setattr(suffix_dedup, "HOT_LEAST", least)
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10**9)
        got = {r.doc_id: sha(r.text.encode()) for r in suffix_dedup.remove(docs).collect()}
        assert got == wanted


def test_run_index_finds_first_places():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint8) for _ in range(40)]
    lengths = np.array([len(p) for p in parts])
    index = suffix_dedup.RunIndex(np.concatenate(parts), lengths)
    assert index.runs.sum() == index.n
    first = index.first_equal(5)
    seen, at = {}, 0
    for p in parts:
        for k in range(len(p) - 4):
            w = p[k : k + 5].tobytes()
            assert first[at + k] == seen.setdefault(w, at + k)
        at += len(p) + 1


def test_bpe_as_the_library(spark, sf_dir, texts):
    ranks = bpe.load_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op8_byte_bpe"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode()))


def test_bpe_merges_and_splits():
    ranks = bpe.load_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, split = random.Random(1), bpe.splitter()
    for _ in range(500):
        text = "".join(rng.choice("abc deéñ的 123!?'stre\n\t\x1c\x85 ") for _ in range(rng.randint(0, 300)))
        ids = [i for w in split(text) for i in bpe.merge(w.encode(), ranks)]
        assert ids == library.encode_ordinary(text)
    long = "ab" * 3000 + "z" * 999
    assert bpe.merge(long.encode(), ranks) == library.encode_ordinary(long)


def exact_components(texts):
    sets = {i: set(shingles(near_dedup.words_of(t)).tolist()) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = find(a), find(b)
                up[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in ids}


def test_near_duplicates_with_edits(spark):
    """Copies of a text with more and more edits of their own, chains of edits, and copies of copies."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts, chain = {0: " ".join(base)}, list(base)
    for i in range(1, 160):
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts[i] = " ".join(copy)
    for i in range(200, 240):
        chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
        texts[i] = " ".join(chain)
    texts |= {i: texts[i - 300] for i in range(300, 340)}
    texts |= {400 + i: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r.component_id for r in near_dedup.components(docs).collect()}
    assert got == exact_components(texts)


def test_connected_components(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, 101), (101, 103), (7, 3)]
    got = {r.node: r.root for r in near_dedup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51))
    assert got[101] == got[103] == 100


def test_next_document_and_edited_text(spark, sf_dir, texts):
    got = {r.doc_id: r for r in QUERIES["op7_order_minhash"](spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        part = len(text) // 3
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), sha((text[: len(text) - part] + following[:part]).encode()))
        assert 0 <= got[i].near_next <= 1
    long = [r for r in got.values() if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)
    by_text = {}
    for i, r in got.items():
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint


def test_small_ranges_change_nothing(spark):
    docs = spark.createDataFrame([(i * i, f"text {i}") for i in range(50)] + [(None, "last"), (9, "tie")], "doc_id long, text string")
    pairs = lambda n: sorted((r.text, r.next_text) for r in order_minhash.with_next(docs, range_rows=n).collect())
    assert pairs(3) == pairs(1000)


def test_fingerprints_without_spaces(spark):
    rng = random.Random(3)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000))
    rows = spark.createDataFrame([(text, "\u4e00" + text, text[:1500] + "\u4e00" + text[1500:])], "a string, b string, c string")
    prints = rows.select(*[order_minhash.fingerprint(rows[c]).alias(c) for c in "abc"])
    got = prints.select(order_minhash.likeness(prints["a"], prints["b"]).alias("x"), order_minhash.likeness(prints["a"], prints["c"]).alias("y")).first()
    assert got.x > 0.9 and got.y > 0.9


def test_fingerprints_follow_order_and_repeats(spark):
    words = [f"w{i}" for i in range(300)]
    swapped = words[150:] + words[:150]
    turned = words[::-1]
    rows = spark.createDataFrame([(" ".join(words), " ".join(x)) for x in (words, swapped, turned)], "a string, b string")
    near = [r[0] for r in rows.select(order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("b")))).collect()]
    assert near[0] == 1.0 > near[1] > near[2]
    repeats = spark.createDataFrame([("x " * 500, "x " * 499 + "y")], "a string, b string")
    assert repeats.select(order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("b")))).first()[0] > 0.5


def test_segments_against_all_pairs():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice((-2.0, -0.5, 1.0, 1.5)) for _ in range(rng.randint(0, 25))]
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0.0)
        found = toxicity.segments(scores)
        assert max((s for *_, s in found), default=0.0) == pytest.approx(max(best, 0.0))
        assert all(sum(scores[a:b]) == pytest.approx(s) for a, b, s in found)


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.85), ("op5_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.01"
    scored = QUERIES[name](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").select("score", label).toPandas()
    good, bad = scored[scored[label] == 1]["score"].to_numpy(), scored[scored[label] == 0]["score"].to_numpy()
    auc = np.mean([(g > bad).mean() + 0.5 * (g == bad).mean() for g in good])
    assert auc > least


def test_views_teach_each_other(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    alone, taught = (quality.fit(docs, labels, rounds=n) for n in (0, 2))
    assert (taught.meta.weights != alone.meta.weights).any() and (taught.text.weights != alone.text.weights).any()


def test_automaton_against_windows():
    rng = random.Random(4)
    word = lambda: rng.choice("abc").encode()
    for _ in range(60):
        items = [(str(k), [word() for _ in range(rng.randint(1, 15))]) for k in range(5)]
        doc = [word() for _ in range(rng.randint(0, 60))]
        hits, held = set(), set()
        for name, words in items:
            n = min(10, len(words))
            for w in (words[i : i + n] for i in range(len(words) - n + 1)):
                for p in range(len(doc) - n + 1):
                    if doc[p : p + n] == w:
                        hits |= set(range(p, p + n))
                        held.add(name)
        assert decontaminate.Automaton(items).read(doc) == (hits, held)


def plain_words(text):
    """Words of a text with the places where they stand."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]


def without_benchmark(text, windows):
    """The text with one space for each run of words inside benchmark windows; None if they are more than half of it."""
    words = plain_words(text)
    hit = set()
    for n in {len(w) for w in windows}:
        for p in range(len(words) - n + 1):
            if tuple(w for w, *_ in words[p : p + n]) in windows:
                hit |= set(range(p, p + n))
    if len(hit) > 0.5 * max(1, len(words)):
        return None
    out, done = "", 0
    for p in sorted(hit):
        if p - 1 not in hit:
            out += text[done : words[p][1]] + " "
        done = words[p][2]
    return out + text[done:]


def without_secrets(text):
    raw = text.encode()
    spans = sorted((m.start(), m.end()) for r in secret_scan.RULES for m in re.finditer(r.pattern.encode(), raw) if len(m.group(r.group)) >= r.least)
    out, done = b"", 0
    for start, end in spans:
        if start >= done:
            out += raw[done:start] + b"[SECRET]"
        done = max(done, end)
    return (out + raw[done:]).decode()


def test_pipeline_stage_by_stage(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    toxic = {r.doc_id for r in QUERIES["op3_toxicity"](spark, sf_dir).collect() if r.predicted}
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert ids(clean) == set(texts) - toxic
    kept = corpus_pipeline.drop_near_duplicates(spark, clean, sf_dir)
    assert ids(kept) == {i for i, c in exact_components({i: texts[i] for i in set(texts) - toxic}).items() if i == c}
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = [w for w, *_ in plain_words(r.text or "")]
        windows |= {tuple(words[i : i + min(10, len(words))]) for i in range(len(words) - min(10, len(words)) + 1)} - {()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    wanted, changed = {}, 0
    for i in ids(kept):
        if (cut := without_benchmark(texts[i], windows)) is not None:
            clean_text = without_secrets(cut)
            changed += (cut != texts[i]) + (clean_text != cut)
            tokens = library.encode_ordinary(clean_text)
            wanted[i] = (len(tokens), sha(",".join(map(str, tokens)).encode()), sha(clean_text.encode()))
    assert changed and len(wanted) > 0.9 * len(ids(kept))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()} == wanted


def test_encode_and_decode_round_trip(spark):
    texts = {1: "Hello  world's\n\n end", 2: "", 3: "éß 的 x" * 50, None: "null id"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(docs)).collect()}
    assert got == texts
