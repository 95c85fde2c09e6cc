"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted per host, registered domain and suffix. At
every level a beta-binomial prior, fitted by moments, says how far the units of one parent
differ; the rate of a parent is the prior mean of its children. A host is allowed if the lower
bound of its posterior reaches a limit. Hand-made rules go before the reputation.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import cut, free_name

# Common public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn",
    "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)

LEVELS = ("suffix", "registered_domain", "host")
# Share of the variance that lies between units: limits, and the value where nothing can be fitted.
RHO_LOW, RHO_HIGH, RHO_DEFAULT = 0.001, 0.999, 0.1
Z, MIN_RATE = 1.645, 0.5


@dataclass(frozen=True)
class Rule:
    """`verdict` for a host with its subdomains, for paths that start with the rule's path."""

    verdict: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.pattern.partition("/")
        mine = (host == name) | F.endswith(host, F.lit("." + name))
        return mine & F.startswith(path, F.lit(slash + rest))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and for urls without `://`."""
    found = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found, lowered).otherwise(""), F.when(found, path).otherwise("")


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; user names, ports and a last dot are left out."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$|\.$", "")
    two = F.substring_index(name, ".", -2)
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(wide, two).otherwise(F.substring_index(name, ".", -1))
    return F.when(wide, F.substring_index(name, ".", -3)).otherwise(two), suffix


def _tau(units: DataFrame, parent: str) -> float:
    """Prior weight of the units of one level, in pages: moments of the beta-binomial."""
    n, k = F.col("n"), F.col("k")
    rate = F.sum(k) / F.sum(n)
    per_parent = units.filter(n > 0).groupBy(parent).agg(
        (rate * (1 - rate)).alias("v"),
        # sum of n (k/n - rate)^2, without a second pass over the units
        (F.sum(k * k / n) - F.sum(k) * F.sum(k) / F.sum(n)).alias("s"),
        (F.count("*") - 1).alias("free"),
        (F.sum(n) - F.sum((n * n).cast("double")) / F.sum(n)).alias("m"),
    )
    row = per_parent.agg(
        F.sum(F.col("s") - F.col("v") * F.col("free")).alias("above"),
        F.sum(F.col("v") * (F.col("m") - F.col("free"))).alias("below"),
    ).first()
    above, below = row["above"], row["below"]
    rho = above / below if below and below > 0 else RHO_DEFAULT
    rho = min(max(rho, RHO_LOW), RHO_HIGH)
    return (1 - rho) / rho


def host_reputation(labelled: DataFrame) -> DataFrame:
    """Posterior of the rate of good pages per host: host, n, good_rate, good_sd.

    `labelled` has a row per page: host, registered_domain, suffix, outcome (1, 0, or NULL for a
    page without label). Pages are summed per host before anything is joined, so a host with a
    third of all pages is one row. Hosts without labels get the prior of their domain.
    """
    hosts = cut(
        labelled.groupBy("suffix", "registered_domain", "host").agg(
            F.count("outcome").alias("n"),
            F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("k"),
        )
    )
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("suffix", "registered_domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("all", F.lit(""))
    total = suffixes.agg(*sums).first()
    overall = total["k"] / total["n"] if total["n"] else 0.5
    tau = [_tau(suffixes, "all"), _tau(domains, "suffix"), _tau(hosts, "registered_domain")]

    def shrunk(weight: float, prior: Column) -> Column:
        return (F.col("k") + F.lit(weight) * prior) / (F.col("n") + F.lit(weight))

    of_suffix = suffixes.select("suffix", shrunk(tau[0], F.lit(overall)).alias("suffix_rate"))
    of_domain = domains.join(of_suffix, "suffix").select(
        "registered_domain", shrunk(tau[1], F.col("suffix_rate")).alias("domain_rate")
    )
    rate = F.col("good_rate")
    return (
        hosts.join(of_domain, "registered_domain")
        .select("host", "n", shrunk(tau[2], F.col("domain_rate")).alias("good_rate"))
        .withColumn("good_sd", F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(tau[2]) + 1)))
    )


def with_outcome(pages: DataFrame) -> DataFrame:
    """`pages` with `outcome`, from a labelling function over the visible text of `html`.

    1 if it reads like prose, 0 if it has more than one of `#*$%&|` in ten words or more
    capitals than small letters, NULL if it has no word. A column named `outcome` is replaced,
    all others come back as they were.
    """
    visible = free_name(pages, "visible")
    markup = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"
    plain = F.replace(F.regexp_replace("html", markup, " "), F.lit("&amp;"), F.lit("&"))
    text = F.trim(F.regexp_replace(F.col(visible), r"[\x20\x09-\x0D]+", " "))

    def n_of(kept: str) -> Column:
        return F.length(F.regexp_replace(visible, f"[^{kept}]+", ""))

    words = F.size(F.split(visible, " "))
    bad = (n_of(r"#*$%&|") * 10 > words) | (n_of(r"\p{Lu}") > n_of(r"\p{Ll}"))
    outcome = F.when(F.col(visible) != "", F.when(bad, 0).otherwise(1))
    return (
        pages.withColumn(visible, plain)
        .withColumn(visible, text)
        .withColumn("outcome", outcome)
        .drop(visible)
    )


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    min_rate: float = MIN_RATE,
    z: float = Z,
) -> DataFrame:
    """Rows of `pages` with host, path, rule, verdict, good_rate and good_bound.

    `pages` holds url and outcome (1 good, 0 bad, NULL without label). The longest rule that fits decides; between rules of
    one length `block` goes first. Where none fits, a host is allowed if the mean of its
    posterior less `z` standard deviations is `min_rate` at least. A NULL url, or one without
    `://`, has the empty host, which has a reputation like any other. Columns of `pages` with
    the names of new ones are replaced. Repeated rows are judged, and counted, as often as they
    occur; an empty table gives an empty one.
    """
    host, path = split_url(F.col("url"))
    parts = pages.withColumn("host", host).withColumn("path", path)
    domain, suffix = registered(F.col("host"))
    labelled = parts.select(
        "host",
        domain.alias("registered_domain"),
        suffix.alias("suffix"),
        F.col("outcome").cast("int").alias("outcome"),
    )
    reputation = host_reputation(labelled).select(
        "host",
        F.col("good_rate"),
        (F.col("good_rate") - F.lit(z) * F.col("good_sd")).alias("good_bound"),
    )
    first = sorted(rules, key=lambda r: (-len(r.pattern), r.verdict != "block", r.pattern))
    fits = [F.when(r.fits(F.col("host"), F.col("path")), F.lit(r.pattern)) for r in first]
    said = [F.when(r.fits(F.col("host"), F.col("path")), F.lit(r.verdict)) for r in first]
    by_rate = F.when(F.col("good_bound") >= min_rate, "allow").otherwise("block")
    none = F.lit(None).cast("string")
    return (
        parts.drop("good_rate", "good_bound", "rule", "verdict")
        .join(reputation, "host", "left")
        .withColumn("rule", F.coalesce(*fits, none))
        .withColumn("verdict", F.coalesce(*said, by_rate))
    )
