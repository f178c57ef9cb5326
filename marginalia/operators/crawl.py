"""Links, allow-lists, crawl depth and manifest comparison over page tables."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marginalia.functions import text as T
from marginalia.session import written

# Content type by file extension (public registry names).
TYPES = {"html": "text/html", "htm": "text/html", "pdf": "application/pdf", "txt": "text/plain", "json": "application/json",
         "xml": "text/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "css": "text/css"}
OCTETS = "application/octet-stream"
_URL = "^([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\\?[^#]*)?"


def _fold(path: Column) -> Column:
    """Path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    tail = F.when(path.rlike("/\\.{1,2}$"), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), tail)


def resolve_url(raw: Column, base: Column) -> Column:
    """Absolute form of a link found on ``base``."""
    scheme = F.regexp_extract(base, _URL, 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(base, _URL, 2))
    path = F.regexp_extract(base, _URL, 3)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    clean = F.regexp_extract(raw, "^([^?#]*)", 1)
    rest = F.regexp_extract(raw, "^[^?#]*(.*)$", 1)
    return (
        F.when(raw.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(site, _fold(clean), rest))
        .when(raw == "", base).when(raw.rlike("^[?]"), F.concat(site, path, raw))
        .when(raw.startswith("#"), F.concat(site, path, F.regexp_extract(base, _URL, 4), raw))
        .otherwise(F.concat(site, _fold(F.concat(folder, clean)), rest))
    )


def canonical_url(raw: Column, base: Column | None = None) -> Column:
    """Lower-case scheme and host, no default port or fragment, path at least ``/``; null for other schemes."""
    url = raw if base is None else resolve_url(raw, base)
    scheme, net = F.lower(F.regexp_extract(url, _URL, 1)), F.regexp_replace(F.regexp_extract(url, _URL, 2), "^.*@", "")
    host = F.lower(F.regexp_replace(net, ":[0-9]*$", ""))
    port = F.regexp_extract(net, ":([0-9]+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.coalesce(F.nullif(F.regexp_extract(url, _URL, 3), F.lit("")), F.lit("/"))
    query = F.regexp_replace(F.regexp_extract(url, _URL, 4), "^\\?$", "")
    full = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, query)
    return F.when(scheme.isin("http", "https") & (host != ""), full)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def is_allowed(url: Column, hosts: Column, prefixes: Column) -> Column:
    return url.rlike("(?i)^https?://") & F.array_contains(hosts, host_of(url)) & F.exists(prefixes, lambda p: F.startswith(path_of(url), p))


def content_type(value: Column, url: Column, types: Mapping[str, str] = TYPES) -> Column:
    """Header type without parameters; an unknown one is inferred from the file extension."""
    head = F.when(F.coalesce(F.length(value), F.lit(0)) == 0, OCTETS).otherwise(F.lower(T.strip(F.split(value, ";")[0])))
    tmap = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    guess = F.coalesce(F.try_element_at(tmap, F.lower(F.regexp_extract(path_of(url), "\\.([^./]+)$", 1))), F.lit(OCTETS))
    return F.when(head == OCTETS, guess).otherwise(head)


# What is no markup of the page, a start tag of a link (quoted values may hold any sign), and its first href.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title)\b.*?(?:</\1\s*>|\z)"
_LINK = r"(?is)<a(?=[\s/])((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>"
_HREF = r"(?is)^(?:[\s/]*(?!href[\s=])[^\s=>\"'/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*[\s/]*href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"


@F.pandas_udf(StringType())
def character_references(s: pd.Series) -> pd.Series:
    """Numeric and named references as characters."""
    return s.map(lambda v: html.unescape(v) if v and "&" in v else v)


def link_graph(pages: DataFrame) -> DataFrame:
    """Ordered distinct canonical out-links: (src, pos, dst) from (url, html).

    Comments, scripts and the like hold no links; the first href of a tag counts, with its character references decoded.
    """
    tags = F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_LINK), F.lit(1))
    href = lambda t: T.strip(F.regexp_replace(F.regexp_extract(t, _HREF, 1), "^[\"']|[\"']$", ""))
    links = pages.select(F.col("url").alias("src"), F.posexplode(F.transform(tags, href)).alias("pos", "raw")).where("raw <> ''")
    links = links.withColumn("raw", character_references("raw"))
    found = links.select("src", "pos", canonical_url(F.col("raw"), F.col("src")).alias("dst")).where(F.col("dst").isNotNull())
    return found.groupBy("src", "dst").agg(F.min("pos").alias("pos")).select("src", "pos", "dst")


def crawl_frontier(seeds: DataFrame, edges: DataFrame, max_depth: int = 2) -> DataFrame:
    """Breadth-first depth of every URL per source: (source_id, url, depth, discovered_from).

    seeds: (source_id, url); edges: (src, pos, dst). The queue order of a URL is its path of
    link positions, so the first discoverer is an aggregate minimum and no ordered pass is
    needed. ``max_depth`` bounds the number of joins. Links and every level are written once, so a level
    reads the one before it and not the pages again.
    """
    edges = written(edges, "links")
    level = seeds.select("source_id", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("discovered_from"),
                         F.array(F.lit(0)).alias("_path"))
    found = level
    for depth in range(1, max_depth + 1):
        reached = level.join(edges, F.col("url") == F.col("src")).select(
            "source_id", F.col("dst").alias("_u"), F.col("url").alias("_from"), F.concat("_path", F.array("pos")).alias("_p"))
        fresh = reached.groupBy("source_id", "_u").agg(F.min(F.struct("_p", "_from")).alias("_b")).select(
            "source_id", F.col("_u").alias("url"), F.lit(depth).alias("depth"), F.col("_b._from").alias("discovered_from"), F.col("_b._p").alias("_path"))
        level = written(fresh.join(found.select("source_id", "url"), ["source_id", "url"], "left_anti"), "level")
        found = found.unionByName(level)
    return found.drop("_path")


def manifest_last(rows: DataFrame, position: str) -> DataFrame:
    """Last manifest row per URL."""
    rest = [c for c in rows.columns if c not in ("url", position)]
    return rows.where(F.col("url").isNotNull()).groupBy("url").agg(F.max_by(F.struct(*rest), position).alias("_r")).select("url", "_r.*")


def manifest_diff(current: DataFrame, previous: DataFrame, position: str | None = None) -> DataFrame:
    """new, changed, unchanged or removed per URL by content hash; of several rows of a URL in a manifest the last by ``position`` counts."""
    last = (lambda m: manifest_last(m.select("url", "sha256", position), position)) if position else (lambda m: m)
    now, was = (last(m).select("url", F.struct("sha256").alias(name)) for m, name in ((current, "_now"), (previous, "_was")))
    return now.join(was, "url", "full").select("url", F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "removed")
                                               .when(F.col("_now").eqNullSafe(F.col("_was")), "unchanged").otherwise("changed").alias("status"))


def asset_diff(assets: DataFrame, state: DataFrame, keys: Sequence[str], signature: Sequence[str], finished: Sequence[str] = ("OK",)) -> DataFrame:
    """Assets whose signature is not among the finished rows of the state table."""
    done = state.where(F.col("status").isin(*finished)).select(*keys, *signature)
    return assets.join(done, [*keys, *signature], "left_anti")


def crawl_summary(docs: DataFrame, errors: DataFrame) -> DataFrame:
    """Documents, bytes and errors per source."""
    d = docs.groupBy("source_id").agg(F.count(F.lit(1)).alias("document_count"), F.min("url").alias("first_url"))
    e = errors.groupBy("source_id").agg(F.count(F.lit(1)).alias("error_count"))
    return d.join(e, "source_id", "full").fillna(0, ["document_count", "error_count"])
