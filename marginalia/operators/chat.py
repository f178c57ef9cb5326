"""Conversation tables: history, contextual questions, listings, token cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T

# --- Fixed values ---
USER_LABEL, ASSISTANT_LABEL, NONE = "ユーザー", "アシスタント", "（なし）"
RECENT, MAX_CHARS = 4, 2400
CURRENCY_RATIO = 150
# --------------------


def normalize_history(turns: DataFrame) -> DataFrame:
    """User and assistant turns with content; (conv_id, turn, role, text)."""
    role = F.lower(T.strip(F.coalesce("role", F.lit(""))))
    clean = turns.withColumn("role", role).withColumn("text", T.strip(F.coalesce("text", F.lit(""))))
    return clean.where(F.col("role").isin("user", "assistant") & (F.length("text") > 0))


def chat_topic(turns: DataFrame) -> DataFrame:
    """First user turn per conversation."""
    users = normalize_history(turns).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("topic"))
    return turns.select("conv_id").distinct().join(users, "conv_id", "left").withColumn("topic", F.coalesce("topic", F.lit(NONE)))


def history_text(turns: DataFrame) -> DataFrame:
    """Labelled transcript per conversation; a group is one conversation."""
    line = F.concat(F.when(F.col("role") == "user", USER_LABEL).otherwise(ASSISTANT_LABEL), F.lit(": "), "text")
    return normalize_history(turns).groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n\n").alias("transcript"))


def contextual_question(turns: DataFrame, recent: int = RECENT, max_chars: int = MAX_CHARS) -> DataFrame:
    """Search question of every user turn: first question, the last distinct earlier ones and the turn itself.

    When that is longer than ``max_chars``, the newest earlier questions that fit are kept. A
    window holds ``recent`` turns of one conversation.
    """
    users = normalize_history(turns).where("role = 'user'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    seen = users.withColumn("_first", F.first("text").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "_recent", F.collect_list("text").over(w.rowsBetween(-recent, -1)))
    fresh = F.array_distinct(F.filter("_recent", lambda t: t != F.col("_first")))
    joined = F.concat_ws("\n", F.array("_first"), fresh, F.array("text"))
    remaining = F.greatest(F.lit(0), F.lit(max_chars) - (F.length("_first") + F.length("text") + 1) - 1)
    start = F.struct(F.array().cast("array<string>").alias("kept"), remaining.alias("left"))

    def take(acc, t):
        cost = F.length(t) + F.when(F.size(acc["kept"]) > 0, 1).otherwise(0)
        fits = (t != F.col("_first")) & (cost <= acc["left"])
        return F.struct(F.when(fits, F.concat(F.array(t), acc["kept"])).otherwise(acc["kept"]).alias("kept"),
                        F.when(fits, acc["left"] - cost).otherwise(acc["left"]).alias("left"))

    short = F.concat_ws("\n", F.array("_first"), F.aggregate(F.reverse("_recent"), start, take)["kept"], F.array("text"))
    value = F.when(F.col("_first").isNull(), F.col("text")).when(F.length(joined) <= max_chars, joined).otherwise(short)
    return seen.select("conv_id", "turn", value.alias("search_question"))


def chat_detail(chats: DataFrame, messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages in order with parsed metadata and remembered sources, newest first, per chat."""
    meta = F.coalesce(F.expr("try_parse_json(metadata_json)").cast("string"), F.lit("{}"))
    m = messages.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("id", "role", "content", meta.alias("metadata")))).alias("messages"))
    s = sources.groupBy("chat_id").agg(F.sort_array(F.collect_list(
        F.struct("last_used_at", "first_seen_at", "book", "pdf_page", "logical_page")), asc=False).alias("sources"))
    return chats.join(m, "chat_id", "left").join(s, "chat_id", "left")


def chat_listing(chats: DataFrame, user: str, limit: int = 50) -> DataFrame:
    """Chats of a user, latest first."""
    return chats.where(F.lower("user_email") == user.lower()).orderBy(
        F.col("updated_at").desc(), F.col("created_at").desc(), "chat_id").limit(limit)


def token_cost(usage: DataFrame, prices: DataFrame, ratio: float = CURRENCY_RATIO) -> DataFrame:
    """Input, output and total cost per model; an unknown model costs nothing."""
    each = usage.join(prices, "model", "left").select(
        "model", (F.col("prompt_tokens") / 1e6 * F.coalesce("input", F.lit(0.0)) * ratio).alias("input_cost"),
        (F.col("completion_tokens") / 1e6 * F.coalesce("output", F.lit(0.0)) * ratio).alias("output_cost"))
    return each.groupBy("model").agg(F.sum("input_cost").alias("input_cost"), F.sum("output_cost").alias("output_cost")).withColumn(
        "total_cost", F.col("input_cost") + F.col("output_cost"))


def upsert_sources(rows: DataFrame) -> DataFrame:
    """One row per (chat, book, page): first and last use and the latest known printed page."""
    clean = rows.where(F.coalesce(F.length("book"), F.lit(0)) > 0).where(F.col("pdf_page").isNotNull())
    return clean.groupBy("chat_id", "book", "pdf_page").agg(
        F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_used_at"),
        F.max_by("logical_page", F.when(F.col("logical_page").isNotNull(), F.col("ts"))).alias("logical_page"))


def chat_activity(rows: DataFrame) -> DataFrame:
    """Messages, first question and last update per chat."""
    return rows.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("messages"), T.auto_title(F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))).alias("title"),
        F.max("ts").alias("updated_at"))


def last_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.max("ts").alias("last_seen_at"))
