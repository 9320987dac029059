"""URL filters (operator 8), in DataFrame functions only.

A rule's shape is the number of labels of its host and the length of its path. A URL gives an expression, a host
suffix with a path prefix, for each shape of some rule that it is long enough for, and none for others. Expressions
meet the rules by an equi-join on the first bytes of their digest; the full digest is then compared, and the longest
rule decides.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of op8_url_filters as (action, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join compares first.
SHORT = 8
#: Rules up to this number (each is under 4 KB) are broadcast; more are joined by shuffle.
BROADCAST_RULES = 10_000


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """action, host, path of the rules as a local table."""
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("action", "host", "path"), r, strict=True)]) for r in rules])).alias("r"))
    return rows.select("r.*")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict (its action,
    else `default`), one row per row of pages.

    A rule fits a host and its subdomains where the path starts with the rule's. Among rules that fit, the one with
    the most characters wins; equal lengths: the longer host; the same expression twice: block before allow. A null
    URL or one without `://` has empty host and path; a rule without host or path fits nothing. Repeated rows are
    kept, a null id stays null, an empty rule table leaves the default everywhere, an empty pages table gives an
    empty result; other columns are not read. The rules are counted, and their distinct shapes come to the driver.
    """
    known = rules.filter("host is not null and path is not null").groupBy("host", "path").agg(F.max("action").alias("action"))
    shape = F.struct(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    shapes = sorted((r["s"]["labels"], r["s"]["length"]) for r in known.select(shape.alias("s")).distinct().collect())
    digest = _digest(F.col("host"), F.col("path"))
    known = known.select(digest.alias("r_digest"), F.substring(digest, 1, SHORT).alias("short"), F.concat("host", "path").alias("r_text"), F.length("host").alias("r_host"), "action")
    few = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    # One literal, however many shapes there are.
    every = F.from_json(F.lit(json.dumps([{"labels": a, "length": b} for a, b in shapes])), "array<struct<labels:int,length:int>>")
    rows = rows.select("page_id", "host", "path", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    fitting = F.filter(every, lambda s: (s["labels"] <= F.col("labels")) & (s["length"] <= F.col("length")))
    digests = F.transform(fitting, lambda s: _digest(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.call_function("substring", F.col("path"), F.lit(1), s["length"])))
    # The first element stands for the row itself, so that a row without any expression stays and is counted. It
    # meets no rule; its key is dealt out as evenly as digests are.
    own = F.concat(F.lit("-"), F.sha2(F.concat_ws("\n", F.col("page_id").cast("string"), "host", "path"), 256))
    each = rows.select("page_id", "host", "path", F.explode(F.concat(F.array(own), digests)).alias("digest"))
    each = each.withColumn("short", F.substring("digest", 1, SHORT))
    met = each.join(F.broadcast(known) if few else known, "short", "left")
    fits = F.when(F.col("digest") == F.col("r_digest"), F.struct(F.length("r_text").alias("n"), F.col("r_host"), F.col("r_text"), F.col("action")))
    found = met.groupBy("page_id", "host", "path").agg(F.max(fits).alias("best"), F.sum(F.col("digest").startswith("-").cast("long")).alias("copies"))
    return found.select("page_id", "host", "path", F.col("best.r_text").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
