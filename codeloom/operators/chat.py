"""Chat threads and messages as snapshot tables: create, ensure, rename, delete with what hangs on it, list.

Threads: id, project_id, user_id, thread_id, title, created_at, updated_at; messages: id, thread_db_id, role, content,
created_at. Each function returns the next snapshot; times are given, so that results can be repeated.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_USER = "1"


def _is(project: str, thread: str, user: str | None) -> Column:
    return (F.col("project_id") == project) & (F.col("thread_id") == thread) & (F.col("user_id") == (user or DEFAULT_USER))


def create(threads: DataFrame, project: str, thread: str, title: str | None, at: datetime, user: str | None = None) -> DataFrame:
    """With one thread more; a thread of that name and user is an error. Ids are hashes of the natural key."""
    if not threads.where(_is(project, thread, user)).isEmpty():
        raise ValueError(f"thread {thread} exists")
    key = F.concat_ws("\x1f", F.lit(project), F.lit(user or DEFAULT_USER), F.lit(thread))
    new = threads.sparkSession.range(1).select(
        F.abs(F.xxhash64(key)).alias("id"), F.lit(project).alias("project_id"), F.lit(user or DEFAULT_USER).alias("user_id"), F.lit(thread).alias("thread_id"),
        F.lit(title).cast("string").alias("title"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"),
    )
    return threads.unionByName(new)


def ensure(threads: DataFrame, project: str, thread: str, at: datetime, user: str | None = None) -> DataFrame:
    """The snapshot as it is if it has the thread, else with it."""
    return create(threads, project, thread, None, at, user) if threads.where(_is(project, thread, user)).isEmpty() else threads


def rename(threads: DataFrame, project: str, thread: str, title: str, at: datetime, user: str | None = None) -> DataFrame:
    hit = _is(project, thread, user)
    return threads.withColumns({"title": F.when(hit, F.lit(title)).otherwise(F.col("title")), "updated_at": F.when(hit, F.lit(at)).otherwise(F.col("updated_at"))})


def delete(threads: DataFrame, messages: DataFrame, project: str, thread: str, user: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(threads, messages) without the thread and its messages."""
    left = threads.where(~F.coalesce(_is(project, thread, user), F.lit(False)))
    return left, messages.join(left.select(F.col("id").alias("thread_db_id")), "thread_db_id", "left_semi").select(*messages.columns)


def listed(threads: DataFrame, project: str, user: str | None = None) -> DataFrame:
    """A user's threads of a project, the last updated first."""
    return threads.where((F.col("project_id") == project) & (F.col("user_id") == (user or DEFAULT_USER))).orderBy(F.desc("updated_at"), F.desc("id"))


def history(threads: DataFrame, messages: DataFrame, project: str, thread: str, user: str | None = None) -> DataFrame:
    """A thread's messages by time and id."""
    ids = threads.where(_is(project, thread, user)).select(F.col("id").alias("thread_db_id"))
    return messages.join(ids, "thread_db_id", "left_semi").select(*messages.columns).orderBy("created_at", "id")
