"""Message histories: append-only rows (session_id, seq, role, content)."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_messages(messages: DataFrame, n: int, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """The last n of each session, in order."""
    if n < 1:
        raise ValueError("n must be positive")
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(seq)))
    return messages.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r").orderBy(session, seq)


def append_message(messages: DataFrame, session_id: str, role: str, content: str) -> DataFrame:
    top = messages.where(F.col("session_id") == session_id).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("m"))
    new = top.select(F.lit(session_id).alias("session_id"), (F.col("m") + 1).cast(messages.schema["seq"].dataType).alias("seq"), F.lit(role).alias("role"), F.lit(content).alias("content"))
    return messages.select("session_id", "seq", "role", "content").unionByName(new)


def clear(messages: DataFrame, session_id: str) -> DataFrame:
    """Messages without those of a session (null sessions stay)."""
    return messages.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))


class InMemoryHistory:
    """For one driver: messages in order, safe to use from several threads."""

    def __init__(self, window: int | None = None) -> None:
        if window is not None and window < 1:
            raise ValueError("window must be positive")
        self.window, self._rows, self._lock = window, [], threading.Lock()

    def add(self, role: str, content: str) -> None:
        with self._lock:
            self._rows.append({"role": role, "content": content})

    @property
    def messages(self) -> list[dict[str, str]]:
        with self._lock:
            return list(self._rows if self.window is None else self._rows[-self.window :])

    def clear(self) -> None:
        with self._lock:
            self._rows.clear()
