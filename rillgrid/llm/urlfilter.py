"""URL rules by host suffix and path prefix, joined on short hashes.

A rule names a host and the beginning of a path.  It fits a URL if the URL's host is the rule's or
a subdomain of it and the URL's path starts with the rule's.  Each URL is expanded into the
expressions host suffix + path prefix that have the shape of some rule (number of host labels and
path length), the first 32 bits of their SHA-256 are joined with those of the rules, the full
digests confirm a hit, and the longest fitting rule decides; at equal length the one with the
longer host, then ``block`` before ``allow``.

Distinct (host, path) pairs are expanded, so a URL or host that holds a large share of the rows
costs one expansion per distinct path, and their results are joined back to the rows.

Edge cases: a null URL or one without ``://`` has an empty host and path, which no rule with a path
fits.  Labels are what dots separate, also empty ones.  Repeated rows keep their number.
An empty rule table leaves all URLs to ``default``.  Extra columns of the rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.llm.common import ascii_lower, free, hinted, let

DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _expressions(labels: list[int], lengths: list[int]) -> Column:
    """Expressions of ``host`` and ``path`` in the shapes that the rules have."""

    def of(parts: Column) -> Column:
        hosts = [F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, -n, n))) for n in labels]
        paths = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
        some = F.array_compact(F.array(*paths))
        return F.flatten(F.transform(F.array_compact(F.array(*hosts)), lambda h: F.transform(some, lambda p: F.struct(h.alias("h"), p.alias("p")))))

    return let(F.split("host", r"\."), of)


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule (host + path of the deciding rule, else null) and verdict.

    ``rules`` has the columns host, path, verdict (allow or block).
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"))
    known = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    known = known.withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256)).withColumn("short", _short(F.col("r_digest")))
    shape = known.agg(
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"), F.count(F.lit(1)).alias("n")
    ).first()
    if not shape["n"]:
        return parsed.select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = parsed.select("host", "path").distinct()
    listed = urls.select("host", "path", F.explode(_expressions(sorted(shape["labels"]), sorted(shape["lengths"]))).alias("e"))
    listed = listed.select("host", "path", F.sha2(F.concat("e.h", F.lit("\n"), "e.p"), 256).alias("digest")).withColumn("short", _short(F.col("digest")))
    hits = listed.join(hinted(known, shape["n"]), "short").where(F.col("digest") == F.col("r_digest"))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict") == "block")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("r_host", "r_path", "r_verdict"), rank).alias(free(pages, "best")[0]))
    met, found = parsed.join(best, ["host", "path"], "left"), F.col(best.columns[-1])
    return met.select(*[F.col(f"`{c}`") for c in own], "host", "path", F.concat(found["r_host"], found["r_path"]).alias("rule"), F.coalesce(found["r_verdict"], F.lit(default)).alias("verdict"))
