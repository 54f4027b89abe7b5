"""URL filters: host-suffix and path-prefix expressions, joined with the rules on short hash prefixes.

DataFrame functions only. Each url becomes one expression for each shape (number of host labels,
path length) that some rule has, so every rule that can fit is met by exactly one expression.
Expressions meet rules on four bytes of their SHA-256, then the full digests are compared, and the
longest fitting rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this many go to every executor; more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Different (labels, path length) shapes that a rule set may have.
MOST_SHAPES = 4_096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(raw, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expression_digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def labels_of(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the url's
    path starts with the rule's; of several the one with the longest host and path decides, then
    the longer host, then block before allow. Where none fits, rule is null and the verdict is
    ``default``. Null urls, empty ones and those without ``://`` have an empty host and path,
    which no rule fits. Rules with a null or empty host fit nothing; a null rule path counts as
    empty; repeated rules count once. Each row of ``pages`` comes back once, repeated ones too;
    columns of ``pages`` named like those added are replaced. Empty tables give what follows.
    """
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    keep = F.struct(*[F.col(c) for c in own]).alias("_page")
    source = F.col(url)
    rules = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.where(F.col("r_host") != "").groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    shapes = [(r[0], r[1]) for r in rules.select(labels_of(F.col("r_host")), F.length("r_path")).distinct().limit(MOST_SHAPES + 1).collect()]
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"the rules have more than {MOST_SHAPES} shapes of (host labels, path length)")
    digest = expression_digest(F.col("r_host"), F.col("r_path"))
    rules = rules.select(F.substring(digest, 1, 8).alias("prefix"), digest.alias("r_digest"), "r_host", "r_path", "r_verdict")
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    rows = pages.select(keep, host_of(source).alias("host"), path_of(source).alias("path"), F.monotonically_increasing_id().alias("_rid"))
    labels = F.split("host", r"\.", -1)
    made = [
        F.when(
            (F.size(labels) >= n) & (F.length("path") >= size) & (F.col("host") != ""),
            expression_digest(F.substring_index("host", ".", -n), F.substring("path", 1, size)),
        )
        for n, size in sorted(shapes)
    ]
    digests = F.filter(F.array(*made), lambda d: d.isNotNull()) if made else F.array().cast("array<string>")
    met = (
        rows.select("_rid", F.explode(digests).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, 8))
        .join(rules, "prefix")
        .where(F.col("digest") == F.col("r_digest"))
    )
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), F.col("r_verdict"), F.col("r_host"), F.col("r_path"))
    best = met.groupBy("_rid").agg(F.max(order).alias("best"))
    out = rows.join(best, "_rid", "left")
    return out.select(
        "_page.*",
        "host",
        "path",
        F.concat("best.r_host", "best.r_path").alias("rule"),
        F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"),
    )


def production_rules(spark: SparkSession) -> DataFrame:
    rows = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def op3_url_filters(pages: DataFrame) -> DataFrame:
    """A row for each row of ``pages``, judged by the production rules.

    Nulls, empty and very long urls, ties of rules, repeated rows and empty tables as in
    ``filter_urls``; a null page_id stays null; further columns are ignored. ``pages`` must be
    readable again in the same order, as its rows are numbered and joined back.
    """
    return filter_urls(pages.select("page_id", "url"), production_rules(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")


#: The same by plain conditions, for DuckDB.
OP3_SQL = r"""
with parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
judged as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from parts)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from judged
"""
