"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host.

Pages that a rule judges are the labelled outcomes (a caller can bring others). Block
rates are shrunk level by level: a public suffix towards the whole table, a registered
domain towards its suffix, a host towards its registered domain. Each level's prior is a
beta whose weight comes from the spread of the rates below it (method of moments for a
beta-binomial). A page that no rule judges is blocked if a lower bound of its host's
posterior block rate is above a threshold.

Everything is DataFrame operations. Counts are aggregated before they are shuffled, so a
host with a third of all pages is one row by then; the counts of hosts, domains and suffixes
are checkpointed, as each is used several times. Going back from hosts to pages, the few
hosts with at least one page in `HEAVY_SHARE` go by broadcast (there can be no more than
`HEAVY_SHARE` of them), all others by a shuffle join.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and
is judged by the table-wide rate; repeated page rows are judged one by one and count one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Public suffixes of more than one label that are told apart from a registered domain.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "or.kr", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.za", "com.ar")

HEAVY_SHARE = 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for urls without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits host and path, as struct(rule, verdict); null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host."""
    long = "|".join(x.replace(".", r"\.") for x in LONG_SUFFIXES)
    suffix = F.regexp_extract(host, rf"(?:^|\.)((?:{long})|[^.]*)$", 1)
    domain = F.regexp_extract(host, rf"([^.]*\.?(?:(?:{long})|(?<![^.])[^.]*))$", 1)
    return domain, suffix


def _shrunk(counts: DataFrame, key: str, parent: DataFrame, parent_key: str, rate: str, parent_rate: str, weight: float) -> DataFrame:
    """Posterior mean block rate of each key, given its parent's.

    The prior's weight (pseudo pages) is estimated for each parent from the spread of its
    children's rates, between 1 and 1000; it is `weight` where there are fewer than two
    children with outcomes.
    """
    p, n, k = F.col(parent_rate), F.col("n"), F.col("bad")
    joined = counts.join(parent.select(parent_key, parent_rate), parent_key)
    spread = joined.filter(n > 0).groupBy(parent_key).agg(
        F.count(F.lit(1)).alias("kids"),
        F.sum(n).alias("pages"),
        F.sum(n * n).alias("squares"),
        F.sum(n * F.pow(k / n - p, 2)).alias("scatter"),
        F.first(p).alias("p"),
    )
    noise = F.col("p") * (1 - F.col("p"))
    between = (F.col("scatter") - F.col("kids") * noise) / F.greatest(F.col("pages") - F.col("squares") / F.col("pages"), F.lit(1e-9))
    fitted = F.when((F.col("kids") >= 2) & (noise > 0), F.when(between > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), noise / F.when(between > 0, between) - 1))).otherwise(1000.0)).otherwise(weight)
    joined = joined.join(spread.select(parent_key, fitted.alias("fitted")), parent_key, "left")
    w = F.coalesce(F.col("fitted"), F.lit(weight))
    return joined.withColumns({rate: (k + w * p) / (n + w), "weight": w})


def host_reputation(outcomes: DataFrame, weight: float = 10.0, z: float = 1.64) -> DataFrame:
    """From rows (host, blocked: 0, 1 or null) to host, n, bad, rate and lower bound of the posterior."""
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("blocked").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("pages"))
    hosts = cut_lineage(hosts.withColumns({"domain": domain, "suffix": suffix}))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = cut_lineage(domains.groupBy("suffix").agg(*sums).withColumn("root", F.lit(0)))
    root = suffixes.groupBy("root").agg(*sums).withColumn("root_rate", (F.col("bad") + 0.5) / (F.col("n") + 1.0))
    suffixes = _shrunk(suffixes, "suffix", root, "root", "suffix_rate", "root_rate", weight)
    domains = _shrunk(domains, "domain", suffixes, "suffix", "domain_rate", "suffix_rate", weight).withColumnRenamed("weight", "domain_weight")
    found = _shrunk(hosts.drop("suffix"), "host", domains, "domain", "rate", "domain_rate", weight)
    size = F.col("n") + F.col("weight")
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (size + 1))
    return found.select("host", "n", "bad", "pages", "rate", F.greatest(F.lit(0.0), F.col("rate") - z * deviation).alias("bound"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, outcomes: DataFrame | None = None, threshold: float = 0.5, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's posterior block rate and bound (rounded to 6 places).

    `outcomes` (host, blocked) replaces the outcomes that the rules give.
    """
    host, path = split_url(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        outcomes = judged.select("host", F.when(F.col("hit").isNotNull(), (F.col("hit.verdict") == "block").cast("long")).alias("blocked"))
    reputation = cut_lineage(host_reputation(outcomes))
    total = outcomes.agg(F.count(F.lit(1)).alias("total"))
    heavy = reputation.join(F.broadcast(total), F.col("pages") * HEAVY_SHARE >= F.col("total")).select("host", "rate", "bound")
    heavy = heavy.select(F.col("host").alias("heavy_host"), F.col("rate").alias("heavy_rate"), F.col("bound").alias("heavy_bound"))
    marked = judged.join(F.broadcast(heavy), F.col("host") == F.col("heavy_host"), "left")
    light = marked.filter(F.col("heavy_host").isNull()).join(reputation.select("host", "rate", "bound"), "host", "left")
    dense = marked.filter(F.col("heavy_host").isNotNull()).withColumns({"rate": F.col("heavy_rate"), "bound": F.col("heavy_bound")})
    method = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    columns = ("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), method).alias("verdict"), F.round("rate", 6).alias("block_rate"), F.round("bound", 6).alias("block_bound"))
    return light.select(*columns).unionByName(dense.select(*columns))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
