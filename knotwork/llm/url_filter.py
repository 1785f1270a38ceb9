"""URL filters [native].

Every URL is expanded into host-suffix x path-prefix expressions. Their SHA-256 digests meet the rules' digests in an equi-join on
a short prefix of the digest; the full digest is then compared, and the longest rule that fits decides.

Only as many path prefixes are made as there are distinct lengths of rule paths, and as many host suffixes as there are distinct
numbers of labels in rule hosts, so the expansion of a URL does not grow with its own length beyond the longest rule. URLs are first reduced to their distinct (host, leading path) pairs, hence a host with a third
of all rows costs no more than its distinct paths. The rules are never broadcast by force: Catalyst does so when they are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, literal_rows, table

#: (verdict, host, path) of the production query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Hex digits of a digest that the equi-join uses.
PREFIX_HEX = 8
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return literal_rows(spark, rules, "verdict string, host string, path string")


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path`` (both empty for a null URL or one without ``://``), replacing columns of those names."""
    start = F.instr(F.col(url), "://")
    rest = F.when(start > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    df = df.withColumn("__rest", F.coalesce(rest, F.lit("")))
    df = df.withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    after = F.expr("substring(__rest, length(__host) + 1)")
    df = df.withColumn("path", F.regexp_extract(after, "^[^?#]*", 0))
    return df.withColumn("host", F.translate("__host", UPPER, LOWER)).drop("__rest", "__host")


def label_count(host: str) -> F.Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def numbers(values: list[int]) -> F.Column:
    return F.array(*[F.lit(n) for n in values]) if values else F.expr("cast(array() AS array<int>)")


def digest(host, path) -> F.Column:
    return F.sha2(F.concat(host, F.lit("\t"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, carry: list[str], url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per input row: the carried columns, host, path, rule and verdict.

    ``rules`` has verdict (allow or block), host and path. A rule fits its host and all subdomains when the URL's path starts with
    the rule's path. The longest rule (host and path together) wins; between equal lengths the longer host, then block. Rules with
    a null or empty host or a null path never fit. Without a fitting rule, ``rule`` is null and the verdict is ``default``.
    Null URLs, URLs without ``://`` and repeated rows are all judged; columns other than ``carry`` are left out, so clashing names
    do no harm. An empty table gives an empty result; no rules at all give the default everywhere.
    """
    given = rules.select("verdict", "host", "path").where("host <> '' AND path IS NOT NULL").distinct()
    # At most as many numbers as the longest rule path has characters, and the longest rule host labels.
    lengths = sorted(r[0] for r in given.select(F.length("path")).distinct().collect())
    labels = sorted(r[0] for r in given.select(label_count("host")).distinct().collect())
    longest = max(lengths, default=0)
    seen = host_and_path(pages.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], F.col(url).alias("__url")), "__url")
    seen = seen.withColumn("__lead", F.expr(f"left(path, {longest})"))
    listed = given.select(
        digest(F.col("host"), F.col("path")).alias("full"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            F.when(F.col("verdict") == "block", 1).otherwise(0).alias("is_block"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("found"),
    ).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    keys = seen.select("host", "__lead").where("host <> ''").distinct()
    suffixes = F.transform(F.filter(numbers(labels), lambda n: n <= label_count("host")), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    sizes = numbers(lengths)
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("__lead")), lambda n: F.expr("__lead").substr(F.lit(1), n))
    asked = (
        keys.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .select("host", "__lead", digest(F.col("suffix"), F.col("prefix")).alias("asked"))
        .withColumn("short", F.substring("asked", 1, PREFIX_HEX))
    )
    decided = (
        asked.join(listed, "short")
        .where(F.col("asked") == F.col("full"))
        .groupBy(F.col("host").alias("__h"), F.col("__lead").alias("__p"))
        .agg(F.max("found").alias("found"))
    )
    # written first, so that Catalyst knows its size, and so that a hot key of the join can be split
    decided = Scratch(pages.sparkSession, "url-filter").save(decided)
    return seen.join(decided, (F.col("host") == F.col("__h")) & (F.col("__lead") == F.col("__p")), "left").select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.lit(default)).alias("verdict"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES), ["page_id"])


OP9_SQL = """
WITH rules(verdict, rhost, rpath) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + """),
a AS (SELECT row_number() OVER () AS rid, page_id,
  coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
b AS (SELECT rid, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT c.*, r.*, row_number() OVER (PARTITION BY rid ORDER BY length(rhost) + length(rpath) DESC NULLS LAST,
    length(rhost) DESC, verdict DESC) AS k
  FROM c LEFT JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict FROM d WHERE k = 1
"""
