"""URL filters: many pattern rules, of which each URL runs a few.

Each rule is indexed by the rarest of its literal tokens, by how often tokens occur in the URLs at hand. A URL's tokens fetch
candidate rules, and only those run their regular expression. Host and path rules come before free patterns; of several
that fit, the longest wins.

Edge cases: null URLs and those without ``://`` have an empty host and path and fit no host rule; rules without a literal
token are tried on every URL; repeated rows are judged alike; ties between rules go to the last by code point; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host and path in a row; ``literals``: tokens that every match holds, whole."""

    verdict: str
    pattern: str
    literals: tuple[str, ...]
    name: str | None = None  # host and path rules have one

    @classmethod
    def of_host(cls, verdict: str, host: str, path: str) -> Rule:
        text = host + path
        tokens = [t for t in re.split(TOKEN, text if not text or not text[-1].isalnum() else text[: re.search("[A-Za-z0-9]*$", text).start()]) if t]
        return cls(verdict, rf"^(?:[^/]*\.)?{re.escape(text)}", tuple(dict.fromkeys(tokens)), text)


#: Rules of the registered query; the free patterns after them decide where none of these fits.
HOST_RULES = (Rule.of_host("block", "net", "/"), Rule.of_host("allow", "example.net", "/en/"), Rule.of_host("block", "example.com", "/de/"), Rule.of_host("allow", "org", "/fr/"))
FREE_RULES = (
    Rule("block", r"/ads/", ("ads",)),
    Rule("block", r"(?:^|[./-])casino[./-]", ("casino",)),
    Rule("block", r"(?:^|[./-])porn[./-]", ("porn",)),
    Rule("block", r"/wp-login\.php$", ("wp", "login", "php")),
    Rule("block", r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+/", ()),
)


def parts(col: str = "url"):
    """Host and path of a URL."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(col), F.lit(""))
    return F.translate(F.regexp_extract(url, shape, 1), UPPER, LOWER), F.regexp_extract(url, shape, 2)


def judge(pages: DataFrame, rules: tuple[Rule, ...], otherwise: str = "allow", broadcast_rows: int = 100_000) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages`` (``page_id, url``)."""
    spark = pages.sparkSession
    host, path = parts()
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    tokens = F.array_distinct(F.concat(F.split(F.concat("host", "path"), TOKEN), F.array(F.lit(""))))
    each = urls.withColumn("token", F.explode(tokens))
    literal = spark.createDataFrame([(i, t) for i, r in enumerate(rules) for t in (r.literals or ("",))], "id int, token string")
    literal = bounded(literal, broadcast_rows)
    seen = each.select("token").join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = literal.join(seen, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    body = spark.createDataFrame([(i, r.verdict, r.pattern, r.name, 2 if r.name else 1) for i, r in enumerate(rules)], "id int, verdict string, pattern string, rule string, priority int")
    index = bounded(written(rarest.join(body, "id"), "rules"), broadcast_rows)
    fits = F.when(F.expr("regexp_like(concat(host, path), pattern)"), F.struct("priority", F.length(F.coalesce("rule", "pattern")).alias("n"), "rule", "verdict"))
    best = each.join(index, "token", "left").groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), HOST_RULES + FREE_RULES)


ORACLE = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
n AS (SELECT row_number() OVER () AS row, * FROM u),
b AS (SELECT n.row, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM n JOIN r ON (n.host = r.host OR n.host LIKE '%.' || r.host) AND starts_with(n.path, r.path) GROUP BY n.row)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host || path, '/ads/|(^|[./-])(casino|porn)[./-]|/wp-login\.php$|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+/') THEN 'block' ELSE 'allow' END) AS verdict
FROM n LEFT JOIN b USING (row)
"""
