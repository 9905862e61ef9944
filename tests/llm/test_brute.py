"""Fingerprints and host reputation computed again in plain Python."""

import re
from collections import defaultdict

import xxhash

from lakeloom.llm import order_minhash as omh
from lakeloom.llm import queries
from lakeloom.llm.url_reputation import RULES

QUERIES = queries.queries()
MASK = 2**64 - 1


def signed(x: int) -> int:
    x &= MASK
    return x - 2**64 if x >= 2**63 else x


def chained(parts: list[bytes | None]) -> int:
    """The engine's 64-bit hash of several values: each one's seed is the hash so far, nulls are passed over."""
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p, seed)
    return signed(seed)


def long_(x: int) -> bytes:
    return (x & MASK).to_bytes(8, "little")


def fingerprint(text: str) -> list[int]:
    tokens = [t for word in re.findall(r"[^ \t-\r]+", text) for t in ([word] if len(word) <= 16 else word)]
    if not tokens:
        return []
    at = lambda i: tokens[i].encode() if i < len(tokens) else None
    upper = ~((1 << 30) - 1)
    kmers = [(chained([at(i), at(i + 1), at(i + 2)]) & upper) >> 30 for i in range(max(len(tokens) - 2, 1))]
    seen: dict[int, int] = defaultdict(int)
    ranked = []
    for place, k in enumerate(kmers):
        number = seen[k]
        seen[k] += 1
        ranked.append((signed((chained([long_(k), number.to_bytes(4, "little")]) & upper) | place), place))
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for value, place in sorted(ranked):
        bins[(value & MASK) >> 58].append((value, place))
    out = []
    for b, members in bins.items():
        places = sorted(p for _, p in members[: omh.LENGTH])
        tuple_hash = chained([long_(kmers[p]) for p in places])
        out.append((members[0][0], (b << 58) | ((tuple_hash & MASK) >> 6)))
    return [v for _, v in sorted(out)]


def likeness(a: list[int], b: list[int]) -> float:
    filled = {x >> 58 for x in a} | {x >> 58 for x in b}
    return len(set(a) & set(b)) / len(filled) if filled else 1.0


def test_fingerprints(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op7_order_minhash"](spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        part = len(text) // 3
        own, edited, after = (fingerprint(t) for t in (text, text[: len(text) - part] + following[:part], following))
        assert got[i].fingerprint == "".join(f"{v:016x}" for v in own)
        assert got[i].edited_fingerprint == "".join(f"{v:016x}" for v in edited)
        assert abs(got[i].near_edited - likeness(own, edited)) < 1e-12
        assert abs(got[i].near_next - likeness(own, after)) < 1e-12


def test_host_reputation(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = {r.page_id: r for r in QUERIES["op9_url_filters"](spark, sf_dir).collect()}
    assert set(got) == set(pages)
    judged, outcomes = {}, defaultdict(lambda: [0, 0])
    for i, url in pages.items():
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        judged[i] = host, path, rule
        outcomes[host][0] += rule is not None
        outcomes[host][1] += rule is not None and rule.verdict == "block"

    def shrunk(counts, parent_of, parent_rate):
        """Posterior rates, with each parent's prior weight by the spread of its children."""
        children = defaultdict(list)
        for k, (n, bad) in counts.items():
            children[parent_of(k)].append((n, bad))
        rates = {}
        for k, (n, bad) in counts.items():
            p = parent_rate[parent_of(k)]
            known = [(a, b) for a, b in children[parent_of(k)] if a]
            weight, noise = 10.0, p * (1 - p)
            if len(known) >= 2 and noise > 0:
                total = sum(a for a, _ in known)
                between = (sum(a * (b / a - p) ** 2 for a, b in known) - len(known) * noise) / max(total - sum(a * a for a, _ in known) / total, 1e-9)
                weight = min(1000.0, max(1.0, noise / between - 1)) if between > 0 else 1000.0
            rates[k] = (bad + weight * p) / (n + weight), n + weight
        return rates

    def summed(counts, parent_of):
        out = defaultdict(lambda: [0, 0])
        for k, (n, bad) in counts.items():
            out[parent_of(k)][0] += n
            out[parent_of(k)][1] += bad
        return out

    domain_of = lambda host: ".".join(host.split(".")[-2:])
    suffix_of = lambda domain: domain.split(".")[-1]
    domains = summed(outcomes, domain_of)
    suffixes = summed(domains, suffix_of)
    n, bad = (sum(x[k] for x in suffixes.values()) for k in (0, 1))
    by_suffix = shrunk(suffixes, lambda _: 0, {0: (bad + 0.5) / (n + 1)})
    by_domain = shrunk(domains, suffix_of, {k: r for k, (r, _) in by_suffix.items()})
    by_host = shrunk(outcomes, domain_of, {k: r for k, (r, _) in by_domain.items()})
    for i, (host, path, rule) in judged.items():
        rate, size = by_host[host]
        bound = max(0.0, rate - 1.64 * (rate * (1 - rate) / (size + 1)) ** 0.5)
        wanted = rule.verdict if rule else "block" if bound > 0.5 else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule.text if rule else None, wanted)
        assert abs(got[i].block_rate - rate) < 1e-5 and abs(got[i].block_bound - bound) < 1e-5
