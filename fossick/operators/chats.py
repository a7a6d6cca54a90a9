"""Chat history: searches, recent messages, titles, pages, the history that fits a budget, upserts, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fossick.functions.text import estimated_tokens, unix_seconds


def search_sessions(sessions: DataFrame, messages: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(session_id, place): sessions with the query in the title, then those with it in a message, newest first."""
    q = query.lower()
    title = sessions.where(F.lower("title").contains(q)).select("session_id", "updated_at", F.lit(0).alias("list"))
    body = messages.where(F.lower("content").contains(q)).select("session_id").distinct().join(sessions, "session_id").select("session_id", "updated_at", F.lit(1).alias("list"))
    first = title.unionAll(body).groupBy("session_id").agg(F.min("list").alias("list"), F.max("updated_at").alias("updated_at"))
    best = first.orderBy("list", F.desc("updated_at"), "session_id").limit(limit)
    return best.select("session_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("list", F.desc("updated_at"), "session_id")).alias("place"))


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each session, with their place in order."""
    w = Window.partitionBy("session_id")
    last = messages.withColumn("r", F.row_number().over(w.orderBy(F.desc("turn"), F.desc("role")))).where(F.col("r") <= n)
    return last.select("session_id", "turn", "role", "content", F.row_number().over(w.orderBy("turn", "role")).alias("place"))


def titles(messages: DataFrame) -> DataFrame:
    """(session_id, title, last_message): the first user message cut at 50, the last message cut at 100 characters."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
    user = F.when(F.col("role") == "user", F.col("content"))
    g = messages.groupBy("session_id").agg(F.min_by(user, F.when(user.isNotNull(), F.col("turn"))).alias("first"), F.max_by("content", "turn").alias("last"))
    return g.select("session_id", cut(F.coalesce("first", F.lit("New chat")), 50).alias("title"), cut(F.col("last"), 100).alias("last_message"))


def history_window(messages: DataFrame, *, max_turns: int = 5, max_tokens: int = 32_000) -> DataFrame:
    """(session_id, turn, role, tokens): newest messages first until the first that would overflow the budget; at least
    one; at most two for each turn."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("role"))
    t = messages.withColumn("tokens", estimated_tokens(F.col("content"))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * max_turns)
    used = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("used", used).where((F.col("r") == 1) | (F.col("used") <= max_tokens)).select("session_id", "turn", "role", "tokens")


def page(sessions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), "session_id").offset(offset).limit(limit)


def activity(sessions: DataFrame, now: str, hours: int) -> DataFrame:
    """One row: sessions, messages, sessions active in the last ``hours``."""
    recent = F.col("updated_at") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return sessions.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("message_count"), F.lit(0)).cast("bigint").alias("messages"), F.count_if(recent).alias("active"))


def recent(sessions: DataFrame, now: str, hours: int, most: int = 10) -> DataFrame:
    """(session_id, title, message_count, updated_at, seconds) of the ``most`` sessions active last within ``hours``."""
    active = sessions.where(F.col("updated_at") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    title = F.when(F.coalesce(F.length("title"), F.lit(0)) > 0, F.col("title")).otherwise("Untitled")
    return active.orderBy(F.desc("updated_at"), "session_id").limit(most).select("session_id", title.alias("title"), "message_count", "updated_at", unix_seconds(F.col("updated_at")).alias("seconds"))


def weekly(sessions: DataFrame, now: str) -> DataFrame:
    """One row: sessions, messages, sessions of the last seven days and their mean a day."""
    recent = F.col("updated_at") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7))
    n = F.count_if(recent)
    return sessions.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("message_count"), F.lit(0)).cast("bigint").alias("messages"), n.alias("last_week"), F.round(n / 7, 2).alias("per_day"))


def save_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` in place of sessions with the same id."""
    return old.join(new.select("session_id"), "session_id", "left_anti").unionByName(new)


def append_messages(sessions: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones, and sessions with their counts and last change brought up to date."""
    every = messages.unionByName(new)
    n = every.groupBy("session_id").agg(F.count("*").alias("_n"), F.max("ts").alias("_t"))
    s = sessions.join(n, "session_id", "left").withColumn("message_count", F.coalesce("_n", F.lit(0)).cast("bigint")).withColumn("updated_at", F.greatest("updated_at", "_t")).drop("_n", "_t")
    return s, every


def delete_sessions(sessions: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the sessions ``ids`` (session_id)."""
    gone = ids.select("session_id")
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")
