"""URL filters by host-suffix and path-prefix expressions [native].

Every url is expanded into (host suffix, path prefix) expressions of the shapes that occur among the rules. Rules are grouped
into buckets by a short prefix of their SHA-256; expressions meet buckets by an equi-join on that prefix alone, and the full
digest then confirms which rules of the bucket are meant. The longest rule wins (then the longest host, then block before allow).

Each distinct url is expanded once. Rows meet their url's rule by a join on host and path; rows of a frequent url are a skewed
side of plain shuffles, which Spark splits, and rows whose url has no expression (all those without ``://``) are spread over keys
of their own. Buckets are broadcast up to ``BROADCAST_CHARS`` of rules, and joined by shuffle beyond.

Null urls and urls without ``://`` have an empty host and path, and match no rule. Repeated rows stay repeated; ties are
settled as above; an empty table gives an empty result. Only ``page_id`` and ``url`` are read, so that other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path), fixed values of the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SHORT = 8  # hex digits of the digest that the join uses
BROADCAST_CHARS = 8 << 20  # characters of hosts and paths of the rules
SPREAD = 4096  # keys over which rows without an expression are dealt


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(url.isNotNull() & (at > 0), F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _expressions(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The (host suffix, path prefix) pairs of the ``shapes`` (labels, characters) that the url has."""
    parts = F.split(host, r"\.", -1)
    found = []
    for n, k in shapes:
        suffix = F.when(F.size(parts) == n, host).when(F.size(parts) > n, F.substring_index(host, ".", -n))
        found.append(F.when(suffix.isNotNull() & (F.length(path) >= k), F.struct(suffix.alias("h"), F.substring(path, 1, k).alias("p"))))
    return F.array_compact(F.array(*found))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def buckets(spark: SparkSession, rules: Sequence[tuple[str, str, str]], short: int = SHORT) -> DataFrame:
    """(short, rules): the rules of each short digest prefix, with their full digests."""
    book = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")
    book = book.select("*", _digest(F.col("host"), F.col("path")).alias("full"))
    return book.groupBy(F.substring("full", 1, short).alias("short")).agg(F.collect_list(F.struct("full", "verdict", "host", "path")).alias("rules"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", short: int = SHORT) -> DataFrame:
    """page_id, host, path, rule (host + path of the rule that decided, else null), verdict."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not all(h for _, h, _ in rules):
        raise ValueError("a rule without a host")
    book = buckets(pages.sparkSession, rules, short)
    if sum(len(h) + len(p) for _, h, p in rules) <= BROADCAST_CHARS:
        book = F.broadcast(book)
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    asked = rows.select("host", "path").distinct().select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), shapes)).alias("x"))
    asked = asked.select("host", "path", _digest(F.col("x.h"), F.col("x.p")).alias("full"))
    met = asked.join(book, F.substring("full", 1, short) == F.col("short"))
    # confirmed within the bucket: as a join condition the full digest would become the join's key
    met = met.select("host", "path", F.explode(F.filter("rules", lambda r: r["full"] == F.col("full"))).alias("r"))
    rank = F.struct(F.length("r.host") + F.length("r.path"), F.length("r.host"), (F.col("r.verdict") == "block").cast("int"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r.host", "r.path").alias("rule"), F.col("r.verdict").alias("verdict")), rank).alias("b"))
    spread = F.when(F.col("host") == "", 1 + F.pmod(F.xxhash64("page_id"), F.lit(SPREAD))).otherwise(F.lit(0))
    best = best.select("host", "path", F.lit(0).cast("long").alias("spread"), "b")
    return rows.withColumn("spread", spread).join(best, ["host", "path", "spread"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def op6_url_filters(spark, sf_dir):
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP6_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM u
), r(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), m AS (
  SELECT n, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(verdict, length(h) + length(p)) AS verdict
  FROM s JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (n)
"""
