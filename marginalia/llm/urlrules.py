"""URL filter rules indexed by their rarest literal token. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A rule list up to this length is sent to every executor (a rule is a few hundred bytes); a longer one is joined by shuffle.
BROADCAST_RULES = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """Literal tokens of a url: its host labels, and its path segments with a slash before them."""
    labels = F.split(host, r"\.")
    steps = F.transform(F.split(path, "/"), lambda s: F.concat(F.lit("/"), s))
    return F.array_distinct(F.filter(F.concat(labels, steps), lambda t: ~t.isin("", "/")))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row.

    ``rules``: (verdict, host, path). A rule fits its host and all subdomains (an empty host: every host) when the path starts with the rule's; the longest
    host and path wins, then the smallest text, then block. No rule fits: rule null, verdict ``default``. Null urls and those without
    ``://`` have empty host and path. Columns of those four names are replaced; rows and other columns stay as they are.

    Every rule is filed under the one of its whole tokens that is rarest among the urls, counted per distinct host and path; one without a
    whole token (no host, and a path cut within its first segment) is a candidate of every url.
    Distinct urls fetch candidates by equality with their tokens, and only candidates run their regular expression. A hot token is a
    key of the broadcast list, so it needs no shuffle.
    """
    spark: SparkSession = pages.sparkSession
    mine = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    listed = spark.createDataFrame([(v, h.translate(str.maketrans(_UPPER, _LOWER)), p) for v, h, p in rules] or [], "verdict string, host string, path string").distinct()
    segments = F.split(F.col("path"), "/")  # a path's last segment may be cut short, so it is no whole token
    whole = F.concat_ws("/", F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))))
    tokened = listed.withColumn("rule", F.concat("host", "path")).withColumn("pattern", F.concat(F.when(F.col("host") == "", r"(?s)^[^/]*").otherwise(r"(?s)^(?:[^/]*\.)?"), _quoted(F.col("host")), _quoted(F.col("path"))))
    own = _tokens(F.col("host"), whole)
    tokened = tokened.select("rule", "verdict", "pattern", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("")))).alias("token"))
    urls = mine.select("host", "path").distinct().withColumn("text", F.concat("host", "path"))
    # A rule without a whole token is filed under the empty one, which every url then has.
    bare = [F.array(F.lit(""))] if any(not h.strip(".") and not any(p.split("/")[:-1]) for _, h, p in rules) else []
    asked = urls.select("text", "host", "path", F.explode(F.concat(_tokens(F.col("host"), F.col("path")), *bare)).alias("token"))
    wanted = tokened.select("token").distinct()
    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)
    seen = asked.join(hint(wanted), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = tokened.join(hint(seen), "token", "left").groupBy("rule", "verdict", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    hits = asked.join(hint(filed), "token").where(F.expr("rlike(text, pattern)"))
    rank = F.struct((-F.length("rule")).alias("n"), "rule", (F.col("verdict") != "block").alias("allow"), "verdict")
    best = hits.groupBy("host", "path").agg(F.min(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return mine.join(best, ["host", "path"], "left").select(*mine.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
