"""The registered queries of the operators and, where SQL can express them, the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import chatformat, convtrie, hilbert, htmlcrf, linededup, mixing, packing, perplexity, simhash, substrings, tokenfile, urlrules, whitening
from marginalia.llm.common import table

#: The rule list of the url query.
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(table(spark, sf_dir, "documents"), carry=("doc_id",))
    return judged.select(F.col("doc_id").cast("bigint"), *perplexity.COUNTS, "base_failed", "kept", "perplexity")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    got = htmlcrf.extract(pages, htmlcrf.fit(pages))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chatformat.format_and_read(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.drop_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_mixing, op3_simhash, op4_url_rules, op5_perplexity, op6_html_text, op7_chat_format, op8_suffix_dedup, op9_hilbert_neighbours, op10_token_file,
                             op11_conversation_trie, op12_line_dedup, op13_whitening)
}

ORACLES: dict[str, str] = {
    "op7_chat_format": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(regexp_replace(regexp_replace(t, '(<)(s>|/s>|<SYS>>|</SYS>>|\\|turn\\|>|\\|body\\|>|\\|endoftext\\|>)', '\\1␛\\2', 'g'), '(\\[)(/?INST\\])', '\\1␛\\2', 'g')) AS n
  FROM (SELECT *, replace(role || chr(1) || text, '␛', '␛␛') AS t FROM c))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n - 1 + 20) + 3 AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op2_mixing": """
WITH RECURSIVE d AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
w AS (SELECT *, (pos - 1) % 3 + 1 AS weight, (SELECT sum(size) FROM d) AS total FROM s),
r AS (SELECT 0 AS step, pos, weight, source_size, total, false AS clamped, CAST(total AS DOUBLE) AS rest, CAST((SELECT sum(weight) FROM w) AS DOUBLE) AS free FROM w
  UNION ALL SELECT step + 1, pos, weight, source_size, total, now, total - sum(CASE WHEN now THEN 3.0 * source_size ELSE 0 END) OVER (),
    sum(CASE WHEN now THEN 0 ELSE weight END) OVER () FROM (SELECT *, clamped OR (free > 0 AND rest / free * weight > 3.0 * source_size) AS now FROM r WHERE step < (SELECT count(*) FROM w))),
t AS (SELECT w.source, w.source_size, CAST(CASE WHEN r.clamped THEN 3.0 * w.source_size ELSE r.rest / r.free * w.weight END AS DOUBLE) AS target
  FROM w JOIN r USING (pos) WHERE r.step = (SELECT count(*) FROM w)),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
k AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, CAST(round(g.target) AS BIGINT) - g.whole * g.source_size AS more,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, more - before)) AS BIGINT) AS taken FROM k""",
    "op4_url_rules": """
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(verdict, h, s) AS (VALUES """ + ", ".join(str(r) for r in URL_RULES) + """)
SELECT page_id, host, path, max_by(h || s, length(h || s)) AS rule, coalesce(max_by(verdict, length(h || s)), 'allow') AS verdict
FROM (SELECT page_id, host, path, row_number() OVER () AS n FROM p) q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY n, page_id, host, path""",
    "op11_conversation_trie": """
WITH o AS (SELECT CAST(conv_id AS BIGINT) AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv, conv - conv % 5 AS base, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv AS VARCHAR), ''),
      lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv FROM o)),
s AS (SELECT c.conv, o.pos, o.role, o.text FROM c JOIN o ON o.conv = c.base AND o.pos < c.h
  UNION ALL SELECT c.conv, o.pos - c.h + least(c.h, (SELECT count(*) FROM o q WHERE q.conv = c.base)), o.role, o.text FROM c JOIN o ON o.conv = c.conv AND o.pos >= c.h),
p AS (SELECT conv, pos + 1 AS depth, sha256(string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv ORDER BY pos)) AS k, strlen(text) AS size,
    count(*) OVER (PARTITION BY conv) AS length FROM s
  UNION ALL SELECT c.conv, 0, '', 0, (SELECT count(*) FROM s WHERE s.conv = c.conv) FROM c),
n AS (SELECT k, any_value(depth) AS depth, min(conv) AS conv, count(*) AS n_convs, any_value(size) AS size,
    coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE length = depth), '') AS ends FROM p GROUP BY k),
u AS (SELECT DISTINCT x.k, x.depth, y.k AS up, y.depth AS up_depth FROM p x JOIN p y ON x.conv = y.conv AND y.depth <= x.depth),
f AS (SELECT n.*, (SELECT count(*) FROM u WHERE u.up = n.k AND u.depth = u.up_depth + 1) AS n_children FROM n),
r AS (SELECT u.up AS k, sum(CAST(f.n_children = 0 AS BIGINT)) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved FROM u JOIN f ON f.k = u.k GROUP BY u.up)
SELECT f.conv AS conv_id, CAST(f.depth AS BIGINT) AS depth, g.conv AS parent_conv_id, f.n_convs, f.n_children, CAST(r.n_leaves AS BIGINT) AS n_leaves,
  CAST(r.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN r ON r.k = f.k LEFT JOIN u ON u.k = f.k AND u.up_depth = f.depth - 1 LEFT JOIN f g ON g.k = u.up""",
    "op12_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT n, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= 3),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id IS DISTINCT FROM g.stays AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY n, doc_id""",
}
