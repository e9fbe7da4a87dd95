"""URL filters: host and path rules looked up by hashed expressions, with built-in functions only.

Each URL is expanded into its host-suffix and path-prefix expressions. The
expressions meet the rules in an equi-join on the first bits of a SHA-256
digest; the full digest then confirms, and the longest rule wins. Only host
suffixes with as many labels as some rule has, and path prefixes as long as
some rule's path, are made: others can meet no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join is on.
PREFIX_DIGITS = 8
#: Rules up to this number may be broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000
#: Tasks that the rows of one page are dealt to.
SALTS = 16


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return _ascii_lower(rest)


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Judge each row's url by the rules (host, path, verdict).

    Returns page_id, host, path, rule (host and path joined; null without one) and verdict. A rule
    fits its host and all subdomains if the url's path starts with the rule's path; the rule with
    the longest host and path wins, among equally long ones that with the longer host, then
    `block` before `allow`. Null or schemeless urls have empty host and path and fit no rule with
    a host. Other columns of pages are ignored. Equal page_ids are judged row by row.
    """
    rules = rules.select(
        _ascii_lower(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).where("rule_host != ''")
    shape = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths"), F.count(F.lit(1)).alias("n")).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    known = (
        rules.withColumn("digest", digest)
        .groupBy("digest")
        .agg(F.max(F.struct("rule_verdict", "rule_host", "rule_path")).alias("r"))  # "block" > "allow"
        .select("digest", F.substring("digest", 1, PREFIX_DIGITS).alias("short"), F.concat("r.rule_host", "r.rule_path").alias("known_rule"), F.length("r.rule_host").alias("host_length"), F.col("r.rule_verdict").alias("known_verdict"))
    )
    if shape["n"] <= BROADCAST_RULES:
        known = F.broadcast(known)
    judged = pages.select(F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parts = F.split("host", r"\.")
    hosts = F.filter(F.array(*(F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels)), lambda x: x.isNotNull())
    paths = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda x: x.isNotNull())
    expressions = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.sha2(F.concat(h, F.lit("\n"), p), 256))))
    if not labels:
        expressions = F.array().cast("array<string>")
    # Each different (host, path) is looked up once, so a hot page costs one lookup.
    fits = (
        judged.select("host", "path").distinct()
        .withColumn("digest_of", F.explode(expressions))
        .withColumn("short", F.substring("digest_of", 1, PREFIX_DIGITS))
        .join(known, "short")
        .where("digest_of = digest")
    )
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("known_rule").alias("length"), "host_length", "known_verdict", "known_rule")).alias("best"))
    # Rows without a host fit no rule and meet nobody; a page that very many rows have is dealt to SALTS tasks.
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = judged.where("host != ''").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(best, ["host", "path", "salt"], "left").select("page_id", "host", "path", "best")
    bare = judged.where("host = ''").withColumn("best", F.lit(None).cast(found.schema["best"].dataType))
    return found.unionByName(bare).select("page_id", "host", "path", F.col("best.known_rule").alias("rule"), F.coalesce("best.known_verdict", F.lit(otherwise)).alias("verdict"))
