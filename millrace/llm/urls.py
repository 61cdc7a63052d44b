"""URL rules: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' where there is none."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """id, host, path, rule, verdict of each row of ``pages``; ``rules`` has host, path and verdict.

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest fitting rule
    wins, then the smaller text. Rows that no rule fits get ``default``. A url that is null or has no ``://`` has an
    empty host and path. Rows that repeat, or have a null id, are judged like any other; other columns are left out.
    An empty rule table leaves every page at ``default``.

    Each distinct (host, path) is expanded into its host suffixes of as many labels times the path prefixes of the
    lengths that rules have; both come from the rules, so no rule can be missed and a long host costs no more than
    they ask for. Expressions meet the rules on 32 bits of their digest, and the whole digest is compared after that.
    """
    listed = rules.select(
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"), F.length("path").alias("n")
    )
    lengths = [r.n for r in listed.select("n").distinct().orderBy("n").collect()]  # at most one for each path length
    depths = [r.d for r in rules.select(F.size(F.split("host", r"\.", -1)).alias("d")).distinct().orderBy("d").collect()]
    listed = listed.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, 8))

    split = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    places = split.select("host", "path").distinct().where("host <> ''")
    labels = F.size(F.split("host", r"\.", -1))
    suffixes = F.array_compact(F.array(*(F.when(labels >= d, F.substring_index("host", ".", -d)) for d in depths)).cast("array<string>"))
    prefixes = F.transform(
        F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expanded = (
        places.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", F.sha2(F.concat("suffix", "prefix"), 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    hits = expanded.join(listed.alias("r"), "short").where(expanded["digest"] == F.col("r.digest"))
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length("rule")).alias("n"), "rule", "rule_verdict")).alias("best")
    )
    return split.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
