"""URL filters: rules on host and path, and a verdict by the link graph where no rule fits.

Hosts that a page names, in its links or its text, are its host's neighbours: one edge for each pair of hosts, weighted by
the number of pages. Trust starts at hosts with pages that a rule allows and follows the edges (personalised PageRank);
distrust starts at hosts with pages that a rule blocks and goes against the edges, as who points to bad hosts is suspect.
Both walk in one join and one aggregation a round, over rows of (kind, host), until nothing moves. A host is blocked if
distrust is more than ``threshold`` of what reaches it.

Only hosts, edges and rule counts are shuffled, all summed before the shuffle; page texts stay where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflens.llm.common import staged

#: A host name with at least two labels, not starting inside a longer one. Nothing is tried twice at one place.
_NAMED = r"(?<![A-Za-z0-9.-])([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?::[0-9]++)?)"
TRUST, DISTRUST = 0, 1


@dataclass(frozen=True)
class Rule:
    """Allows or blocks the urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equal ones the first in the list), else null."""
    ordered = sorted(rules, key=lambda r: -len(r.text))  # the sort keeps the order of equal lengths
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")

    def pick(value):
        return reduce(lambda case, r: case.when(r.fits(host, path), value(r)), ordered[1:], F.when(ordered[0].fits(host, path), value(ordered[0])))

    return pick(lambda r: r.text), pick(lambda r: r.verdict)


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, ruled) of each page; the last two are null where no rule fits."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    return parts.select("*", rule.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): ``n`` pages of host ``src`` name host ``dst``, another host of ``pages``, in their html."""
    named = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_NAMED)), lower))
    own = host_of(F.col("url"))
    rows = pages.select(own.alias("src"), F.explode(named).alias("dst")).filter("src <> '' and src <> dst")
    counted = rows.groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select(own.alias("dst")).distinct()
    return counted.join(hosts, "dst", "left_semi").select("src", "dst", "n")


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches. ``seeds``: (host, trust, distrust), the weights both start with.

    x = (1 - damping) seed + damping * (what the neighbours pass on, each by its edges' share). What reaches a host
    without an edge to go on ends there. The rounds stop when they move at most ``tolerance`` of the seeds' weight. What moves
    falls by the damping each round, so that is after log(tolerance) / log(damping) rounds at the latest.
    """
    forth = edges.select(F.lit(TRUST).alias("kind"), "src", "dst", "n")
    back = edges.select(F.lit(DISTRUST).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = forth.unionByName(back)
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    steps = staged(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.lit(damping) * F.col("n") / F.col("out")).alias("share")), "url-steps")
    start = seeds.select("host", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("moved")) for k, c in ((TRUST, "trust"), (DISTRUST, "distrust"))])))
    moved = staged(start.filter("moved > 0").select("kind", "host", (F.lit(1 - damping) * F.col("moved")).alias("moved")), "url-moved")
    weight = moved.agg(F.sum("moved")).first()[0] or 0.0
    rounds = [moved]
    for _ in range(ceil(log(tolerance) / log(damping))):
        moved = staged(moved.join(steps, ["kind", "host"]).groupBy("kind", "dst").agg(F.sum(F.col("moved") * F.col("share")).alias("moved")).select("kind", F.col("dst").alias("host"), "moved"), "url-moved")
        left = moved.agg(F.sum("moved")).first()[0] or 0.0
        if left == 0.0:
            break
        rounds.append(moved)
        if left <= tolerance * weight:
            break
    total = reduce(DataFrame.unionByName, rounds)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("moved")).otherwise(0.0))
    return total.groupBy("host").agg(of(TRUST).alias("trust"), of(DISTRUST).alias("distrust"))


def seeds_of(rows: DataFrame) -> DataFrame:
    """(host, trust, distrust): the share of a host's pages that a rule allows, and that one blocks. ``rows``: ``judged``."""
    share = lambda verdict: F.count_if(F.col("ruled") == verdict) / F.count("*")
    counted = rows.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    return counted.filter("trust > 0 or distrust > 0")


def filtered(pages: DataFrame, rules=RULES, threshold: float = 0.75, damping: float = 0.85) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of each row of ``pages`` (page_id, url, html).

    ``verdict`` is the longest fitting rule's; where none fits (``rule`` is null), ``block`` if more than ``threshold`` of
    the trust and distrust that reach the host is distrust, else ``allow``. A host that neither reaches is allowed, and so
    is a url without a host. ``trust`` and ``distrust`` are those of the page's host, 0 if nothing reaches it. A url that
    is null or has no ``://`` has an empty host and path; a null html names no hosts. Repeated rows get a row each, further
    columns are ignored, an empty table gives no rows.
    """
    rows = judged(pages, rules)
    reached = propagated(host_edges(pages), seeds_of(rows), damping)
    known = rows.join(reached, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    blocked = F.round("distrust", 9) > F.round(F.lit(threshold) * (F.col("trust") + F.col("distrust")), 9)
    verdict = F.coalesce("ruled", F.when(blocked, "block").otherwise("allow"))
    return known.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
