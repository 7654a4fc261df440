"""URL filtering by host-suffix and path-prefix expressions.

Each distinct URL is expanded into the expressions that a rule could equal: its host's
suffixes at label boundaries, with as many labels as some rule has, followed by its path's
prefixes, as long as some rule's path. Expressions meet rules in an equi-join on a short hash
prefix; full digests confirm a match, and the longest rule wins (of equal rules: allow).
Spark broadcasts the rules where their size allows it and shuffles both sides otherwise.

Defined results: a null URL, or one without `://`, has an empty host and path and the default
verdict; repeated rows each get their row; an empty table gives an empty result; without
rules every verdict is the default; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hex digits of the hash prefix that URLs and rules are joined on.
SHORT = 8
DEFAULT = "allow"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, verdict of the distinct URLs that a rule fits. rules: host, path, verdict."""
    shapes = rules.agg(F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))), F.sort_array(F.collect_set(F.length("path")))).first()
    labels, lengths = (F.array(*map(F.lit, x or [0])) for x in shapes)
    named = urls.select("url").distinct().select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).where("h != ''")
    parts = F.split("h", r"\.")
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("p")), lambda n: F.substring("p", F.lit(1), n))
    rows = named.select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("url", "suffix", F.explode("prefixes").alias("prefix"))
    digest = lambda *c: F.sha2(F.concat(*c), 256)
    rows = rows.select("url", digest("suffix", "prefix").alias("digest"))
    short = lambda name: F.substring(name, 1, SHORT).alias("short")
    known = rules.select(digest("host", "path").alias("known"), F.concat("host", "path").alias("rule"), "verdict")
    met = rows.select("url", "digest", short("digest")).join(known.select("*", short("known")), "short").where("digest = known")
    rank = F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("allows"), "rule", "verdict")
    return met.groupBy("url").agg(F.max(rank).alias("best")).select("url", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict; one row per row of pages."""
    best = best_rules(pages.where("url is not null"), rules)
    found = pages.select("page_id", "url").join(best, "url", "left")
    return found.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


QUERIES = {"op7_url_filter": op7_url_filter}
SQL = {
    "op7_url_filter": """
    WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                   ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
    rests AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT row_number() OVER () AS n, page_id,
                     translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
    fits AS (SELECT n, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
    best AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM fits GROUP BY n)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)"""
}
