"""Cases for conversations, token cost and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import chat as H
from marginalia.plans import bindings as B
from marginalia.plans import sqltext as S
from marginalia.plans.registry import case, typed
from marginalia.session import scratch_dir
from marginalia.streaming import activity as A
from marginalia.streaming import tables as M

_HIST = f"SELECT conv_id, turn, lower(trim(role)) AS role, {S.strip('text')} AS text FROM conversations WHERE lower(trim(role)) IN ('user', 'assistant') AND {S.strip('text')} <> ''"


def _turns(spark, sf):
    return B.table(spark, sf, "conversations")


@case("normalize_history", _HIST)
def normalize_history(spark, sf):
    return H.normalize_history(_turns(spark, sf)).select("conv_id", "turn", "role", "text")


@case("chat_topic", f"SELECT conv_id, coalesce(t.topic, '（なし）') AS topic FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, min_by(text, turn) AS topic FROM ({_HIST}) WHERE role = 'user' GROUP BY 1) t USING (conv_id)")
def chat_topic(spark, sf):
    return H.chat_topic(_turns(spark, sf))


@case("history_text", f"SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'ユーザー' ELSE 'アシスタント' END || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM ({_HIST}) GROUP BY 1")
def history_text(spark, sf):
    return H.history_text(_turns(spark, sf))


_FRESH = S.distinct("x")


@case("contextual_question",
      f"SELECT conv_id, turn, CASE WHEN f IS NULL THEN text ELSE array_to_string(list_concat([f], {_FRESH}, [text]), chr(10)) END AS search_question FROM (SELECT *, list_filter(coalesce(r, []), lambda t: t <> f) AS x FROM (SELECT *, "
      f"first_value(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS r FROM ({_HIST}) WHERE role = 'user'))")
def contextual_question(spark, sf):
    return H.contextual_question(_turns(spark, sf), max_chars=1_000_000)


@case("contextual_question_cut")
def contextual_question_cut(spark, sf):
    return H.contextual_question(_turns(spark, sf))


def _chats(spark, sf):
    e = B.table(spark, sf, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("chat_id"), (F.col("user_id") % 5).cast("string").alias("user_email")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


@case("chat_listing", "SELECT CAST(user_id AS VARCHAR) AS chat_id, max(ts) AS updated_at FROM events WHERE user_id % 5 = 2 GROUP BY user_id ORDER BY max(ts) DESC, min(ts) DESC LIMIT 20")
def chat_listing(spark, sf):
    return H.chat_listing(_chats(spark, sf), "2", 20).select("chat_id", "updated_at")


def _source_rows(spark, sf, events=None):
    e = B.table(spark, sf, "events") if events is None else events
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("user_id").alias("chat_id"), F.col("event_type").alias("book"), F.when(F.col("value") > 1, k).alias("pdf_page"),
                    F.when(F.col("event_id") % 3 != 0, k - 3).alias("logical_page"), "ts")


_SOURCES = ("SELECT user_id AS chat_id, event_type AS book, k AS pdf_page, min(ts) AS first_seen_at, max(ts) AS last_used_at, CASE WHEN count(*) FILTER (event_id % 3 <> 0) > 0 THEN k - 3 END AS logical_page "
            "FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE value > 1) WHERE k IS NOT NULL GROUP BY user_id, event_type, k")


@case("chat_detail", f"SELECT c.conv_id AS chat_id, c.n, c.chars, coalesce(s.n, 0) AS sources, s.newest FROM (SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1) c LEFT JOIN "
      f"(SELECT chat_id, count(*) AS n, max(last_used_at) AS newest FROM ({_SOURCES}) GROUP BY 1) s ON s.chat_id = c.conv_id")
def chat_detail(spark, sf):
    t = _turns(spark, sf)
    messages = t.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"),
                        F.when(F.col("turn") % 2 == 0, "{bad").otherwise('{"a": 1}').alias("metadata_json"))
    d = H.chat_detail(t.select(F.col("conv_id").alias("chat_id")).distinct(), messages, H.upsert_sources(_source_rows(spark, sf)))
    chars = F.aggregate("messages", F.lit(0).cast("bigint"), lambda a, m: a + F.length(m["content"]))
    return typed(d.select("chat_id", F.size("messages").alias("n"), chars.alias("chars"), F.coalesce(F.size("sources"), F.lit(0)).alias("sources"), F.col("sources")[0]["last_used_at"].alias("newest")))


@case("token_cost", "SELECT event_type AS model, round(sum(user_id / 1e6 * coalesce(i, 0) * 150), 6) AS input_cost, round(sum(CAST(floor(value) AS BIGINT) / 1e6 * coalesce(o, 0) * 150), 6) AS output_cost, "
      "round(sum(user_id / 1e6 * coalesce(i, 0) * 150) + sum(CAST(floor(value) AS BIGINT) / 1e6 * coalesce(o, 0) * 150), 6) AS total_cost FROM events LEFT JOIN (VALUES ('click', 0.2::DOUBLE, 1.25::DOUBLE), ('view', 0.75, 4.5)) p(m, i, o) ON m = event_type GROUP BY 1")
def token_cost(spark, sf):
    prices = spark.createDataFrame([("click", 0.2, 1.25), ("view", 0.75, 4.5)], "model STRING, input DOUBLE, output DOUBLE")
    usage = B.table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("prompt_tokens"), F.floor("value").alias("completion_tokens"))
    c = H.token_cost(usage, prices)
    return c.select("model", *[F.round(x, 6).alias(x) for x in ("input_cost", "output_cost", "total_cost")])


# ---- streams: the final table equals the batch aggregate ----

def _twice(spark, sf, table, order, run):
    """A stream over a table that lands in two turns of several files: run, land the rest, and run again from the same folder."""
    root, rows = scratch_dir(spark, f"stream-{table}"), B.table(spark, sf, table)
    half = F.pmod(F.xxhash64(order), F.lit(2)) == 0
    for part in (rows.where(half), rows.where(~half)):
        M.landed(part, root, order)
        out = run(M.table_stream(spark, f"{root}/landing.parquet", "*.parquet"), f"{root}/job")
    return out


@case("stream_last_seen", "SELECT user_id, max(ts) AS last_seen_at FROM events GROUP BY 1")
def stream_last_seen(spark, sf):
    return _twice(spark, sf, "events", "ts", lambda stream, root: M.run_aggregate(stream, H.last_seen, ["user_id"], root))


@case("stream_chat_sources", _SOURCES)
def stream_chat_sources(spark, sf):
    return _twice(spark, sf, "events", "ts", lambda stream, root: M.run_aggregate(
        stream, lambda s: H.upsert_sources(_source_rows(spark, sf, s)), ["chat_id", "book", "pdf_page"], root))


@case("stream_chat_activity", f"SELECT conv_id AS chat_id, count(*) AS messages, coalesce(substring(min_by({S.squeeze('text')}, turn) FILTER (role = 'user'), 1, 40) || CASE WHEN length(min_by({S.squeeze('text')}, turn) FILTER (role = 'user')) > 40 THEN '…' ELSE '' END, '新しいチャット') AS title, "
      "max(turn) AS updated_at FROM conversations GROUP BY 1")
def stream_chat_activity(spark, sf):
    turns = lambda s: s.select(F.col("conv_id").alias("chat_id"), "turn", "role", "text", F.col("turn").alias("ts"))
    return _twice(spark, sf, "conversations", "turn", lambda stream, root: M.run_aggregate(turns(stream), H.chat_activity, ["chat_id"], root))


#: Seconds after which a quiet user leaves the activity table.
_TTL = 12 * 3600


@case("stream_activity", f"SELECT user_id, last_used_at FROM (SELECT user_id, max(ts) AS last_used_at, max(max(ts)) OVER () AS newest FROM events WHERE user_id IS NOT NULL GROUP BY 1) "
      f"WHERE epoch_ms(last_used_at) + {_TTL * 1000 + 1} > epoch_ms(newest)")
def stream_activity(spark, sf):
    # the turns follow one another in time: late events would fall behind the watermark
    root, events = scratch_dir(spark, "stream-activity"), B.table(spark, sf, "events")
    middle = events.select(F.percentile_approx(F.unix_millis(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_millis(F.col("ts").cast("timestamp")) <= middle
    for part in (events.where(early), events.where(~early)):
        M.landed(part, root, "ts", 1)
        out = A.run_activity(M.table_stream(spark, f"{root}/landing.parquet"), ["user_id"], f"{root}/job", _TTL)
    return out.select("user_id", F.col("last_used_at").cast(dict(events.dtypes)["ts"]).alias("last_used_at"))


@case("stream_manifest", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS url, max_by(sha256(html), page_id) AS sha256 FROM pages GROUP BY 1")
def stream_manifest(spark, sf):
    # one document per host, changed by every page of the host; the turns follow one another by page_id
    root, pages = scratch_dir(spark, "stream-pages"), B.table(spark, sf, "pages")
    middle = pages.agg(F.percentile_approx("page_id", 0.5)).first()[0]
    for part in (pages.where(F.col("page_id") <= middle), pages.where(F.col("page_id") > middle)):
        M.landed(part, root, "page_id", 1)
        stream = M.table_stream(spark, f"{root}/landing.parquet", "*.parquet")
        rows = stream.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("url"), F.sha2("html", 256).alias("sha256"), "page_id")
        out = M.run_manifest(rows, f"{root}/job", "page_id")
    return out
