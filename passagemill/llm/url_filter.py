"""URL filtering by host and path rules.

Method. A URL is expanded into expressions: every suffix of its host that starts at a label,
joined with every prefix of its path that has the length of some rule's path. Rules are expressions
too. Both are digested with SHA-256 and equi-joined on the first four bytes; the whole digest
then confirms a hit, and of a URL's hits the longest rule decides (at equal length: the longer
host, then ``block``). URLs that no rule fits get ``default``.

The distinct (host, path) pairs are expanded, not the rows, and the rows get their verdict by an
equi-join. Spark's own size check decides whether the rules are broadcast. One expression matches one rule, so
nothing multiplies: the join yields at most expressions of a URL.

Defined results. A null url, or one without ``://``, has an empty host and path, which no rule
fits. A host keeps its port and user part. Repeated rows are judged one by one; a null page_id
is kept. Columns besides ``page_id`` and ``url`` are ignored; no rules leave the default for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.hex(host), F.lit("/"), F.hex(path)), 256)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict."""
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None)  # lengths of rules' paths
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = (
        pages.select("host", "path").filter(F.col("host") != "").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(fitting).alias("n"))
        .select("host", "path", digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("n"))).alias("url_digest"))
        .withColumn("short", F.substring("url_digest", 1, 8))
    )
    known = (
        rules.filter("host is not null and path is not null")
        .groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))  # 'block' comes after 'allow'
        .select(
            digest(F.col("host"), F.col("path")).alias("rule_digest"),
            F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.col("rule_verdict"), F.concat("host", "path").alias("rule")).alias("won"),
        )
        .withColumn("short", F.substring("rule_digest", 1, 8))
    )
    best = (
        expressions.join(known, "short").filter(F.col("url_digest") == F.col("rule_digest"))
        .groupBy("host", "path").agg(F.max("won").alias("won"))
    )
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict")
    )
