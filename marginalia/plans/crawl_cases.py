"""Cases for web pages: URLs, links, crawl depth, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import crawl as W
from marginalia.plans import bindings as B
from marginalia.plans.bindings import sql
from marginalia.plans.registry import case, typed

_CANON = "lower(regexp_extract(url, '^([^:]+)', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(url, '(\\?[^#]*)', 1)"
B.CTES["canon"] = ((), f"SELECT page_id, {_CANON} AS url, html FROM pages")
_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
B.CTES["links"] = (
    ("canon",),
    f"SELECT src, min(pos) AS pos, dst FROM (SELECT url AS src, i - 1 AS pos, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || replace(h[i], '&amp;', '&') AS dst FROM (SELECT url, h, unnest(generate_series(1, len(h))) AS i FROM "
    "(SELECT url, regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS h FROM canon))) GROUP BY src, dst")


def canon(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", W.canonical_url(F.col("url")).alias("url"), "html")


@case("canonical_url", sql("SELECT page_id, url FROM canon", "canon"))
def canonical_url(spark, sf):
    upper = F.concat(F.upper(F.regexp_extract("url", "^([^:]+)", 1)), F.regexp_replace("url", "^[^:]+(://[^/?#]*)", F.concat(F.lit("$1"), F.when(F.col("url").startswith("https"), ":443").otherwise(":80"))))
    return B.table(spark, sf, "pages").select("page_id", W.canonical_url(upper).alias("url"))


@case("url_allowlist", sql(f"SELECT page_id, {_HOST} LIKE '%.com' AND (regexp_matches(url, '://[^/?#]*/en') OR regexp_matches(url, '://[^/?#]*/fr')) AS ok FROM canon", "canon"))
def url_allowlist(spark, sf):
    c = canon(spark, sf)
    com = W.host_of(F.col("url")).endswith(".com")
    hosts = F.when(com, F.array(W.host_of(F.col("url")))).otherwise(F.array(F.lit("other.example")))  # the allow-list of each page's source
    return c.select("page_id", W.is_allowed(F.col("url"), hosts, F.array(F.lit("/en"), F.lit("/fr"))).alias("ok"))


@case("content_type_filter", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' ELSE 'application/octet-stream' END AS kind FROM pages")
def content_type_filter(spark, sf):
    n = F.col("page_id") % 3
    p = B.table(spark, sf, "pages").select("page_id", F.when(n == 0, " Text/HTML; charset=utf-8").when(n == 1, "application/octet-stream").alias("head"),
                                           F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.when(n == 1, ".PDF").otherwise(".bin9")).alias("u"))
    return p.select("page_id", W.content_type(F.col("head"), F.col("u")).alias("kind"))


@case("link_graph", sql("SELECT src, pos, dst FROM links", "links"))
def link_graph(spark, sf):
    return typed(W.link_graph(canon(spark, sf)))


@case("crawl_frontier", sql(
    f"WITH roots AS (SELECT DISTINCT {_HOST} AS source_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/' AS url FROM canon), e AS (SELECT * FROM links UNION ALL SELECT DISTINCT regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/', page_id, url FROM canon), "
    "l1 AS (SELECT source_id, dst AS url, min_by(src, pos) AS discovered_from, min(pos) AS pos FROM roots JOIN e ON e.src = roots.url GROUP BY 1, 2), n1 AS (SELECT * FROM l1 ANTI JOIN roots USING (source_id, url)), "
    "l2 AS (SELECT source_id, dst AS url, min_by(src, (n1.pos, e.pos)) AS discovered_from FROM n1 JOIN e ON e.src = n1.url GROUP BY 1, 2) "
    "SELECT source_id, url, 0::BIGINT AS depth, NULL::VARCHAR AS discovered_from FROM roots UNION ALL SELECT source_id, url, 1, discovered_from FROM n1 UNION ALL "
    "SELECT source_id, url, 2, discovered_from FROM l2 ANTI JOIN roots USING (source_id, url) ANTI JOIN n1 USING (source_id, url)", "canon", "links"))
def crawl_frontier(spark, sf):
    # the root of a host lists the host's pages by number; each host is one source
    c = canon(spark, sf)
    root = F.concat(F.regexp_extract("url", "^([^:]+://[^/?#]*)", 1), F.lit("/"))
    edges = W.link_graph(c).unionByName(c.select(root.alias("src"), F.col("page_id").cast("int").alias("pos"), F.col("url").alias("dst")).distinct())
    seeds = c.select(W.host_of(F.col("url")).alias("source_id"), root.alias("url")).distinct()
    return typed(W.crawl_frontier(seeds, edges))


@case("scan_manifest", sql(f"SELECT {_HOST} AS url, max_by(sha256(html), page_id) AS sha256 FROM canon GROUP BY 1", "canon"))
def scan_manifest(spark, sf):
    return W.manifest_last(canon(spark, sf).select(W.host_of(F.col("url")).alias("url"), F.sha2("html", 256).alias("sha256"), "page_id"), "page_id")


# Pages of one url: the last one counts in either manifest, so every url has one row.
@case("manifest_diff", "SELECT url, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN now = was THEN 'unchanged' ELSE 'changed' END AS status FROM ("
      "SELECT url, max_by(coalesce(sha256(html), ''), page_id) FILTER (page_id % 4 <> 3) AS now, "
      "max_by(CASE WHEN page_id % 4 = 1 THEN 'old' ELSE coalesce(sha256(html), '') END, page_id) FILTER (page_id % 4 <> 0) AS was FROM pages WHERE url IS NOT NULL GROUP BY url)")
def manifest_diff(spark, sf):
    p = B.table(spark, sf, "pages").select("page_id", "url", F.coalesce(F.sha2("html", 256), F.lit("")).alias("sha256"))
    n = F.col("page_id") % 4
    before = p.where(n != 0).withColumn("sha256", F.when(n == 1, "old").otherwise(F.col("sha256")))
    return W.manifest_diff(p.where(n != 3), before, "page_id")


@case("asset_diff", "SELECT page_id AS key, length(html) AS size FROM pages WHERE length(html) % 3 <> 0 OR page_id % 5 = 0")
def asset_diff(spark, sf):
    a = B.table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.length("html").cast("bigint").alias("size"))
    state = a.where("size % 3 = 0").withColumn("status", F.when(F.col("key") % 5 == 0, "ERROR").otherwise("OK"))
    return W.asset_diff(a, state, ["key"], ["size"])


@case("crawl_summary", sql(f"SELECT {_HOST} AS source_id, count(*) FILTER (page_id % 3 <> 0) AS document_count, min(url) FILTER (page_id % 3 <> 0) AS first_url, count(*) FILTER (page_id % 3 = 0) AS error_count FROM canon GROUP BY 1", "canon"))
def crawl_summary(spark, sf):
    c = canon(spark, sf).withColumn("source_id", W.host_of(F.col("url")))
    return W.crawl_summary(c.where("page_id % 3 <> 0"), c.where("page_id % 3 = 0"))
