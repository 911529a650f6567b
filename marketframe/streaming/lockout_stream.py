"""R7 as a stream: login attempts arrive continuously and possibly out of
order.  Each active account keeps its lockout state (failure count, lock
end, time of the last applied attempt) and, as list state, the attempts it
has received but not applied yet.  Attempts are applied in event-time order
once the watermark has passed them, so the outcome equals the batch replay
of the same log; a timer applies what is left when no more attempts come.

No attempt is lost.  Spark drops rows behind the watermark only where an
operator reads the watermarked column; that column is left out before the
stateful operator, which still sees the query's watermark.  An attempt that
arrives behind the watermark is never applied out of order: it comes out at
once with outcome ``late``, the state after it unchanged.  So every attempt has
exactly one output row, or is pending.

Unknown and inactive accounts need no state: a stream-static join with the
seller table and a projection, as in the batch form.
"""

from __future__ import annotations

import datetime as _dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marketframe.functions.semantics import minutes_left, ntz_instant
from marketframe.operators.lockout import LOCK_TIME, OUTCOME_SCHEMA, microseconds, step, time_column, times_of

#: The state store that list state and timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LockoutProcessor(StatefulProcessor):
    """One account: ``account`` (count, lock end, last applied time) and the
    ``pending`` attempts; times in microseconds."""

    def __init__(self, lock: int):
        self.lock = lock

    def init(self, handle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "n int, until long, last long")
        self.pending = handle.getListState("pending", "at long, ok boolean")

    def _apply(self, key, timers, n, until, last, arrived):
        """Outcome rows of what the watermark has passed; the rest waits."""
        mark = timers.getCurrentWatermarkInMs() * 1000
        waiting = sorted([*((a, bool(ok)) for a, ok in self.pending.get()), *arrived])
        ready = [p for p in waiting if p[0] <= mark]
        rest = waiting[len(ready):]
        rows = []
        for at, ok in ready:
            n, until, outcome, minutes, left = step(n, until, at, ok, self.lock)
            rows.append((int(key[0]), at, outcome, n, until, minutes, left))
            last = at
        self.account.update((n, until, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.pending.clear()
        return rows

    def _frame(self, rows):
        out = pd.DataFrame(rows, columns=[f.name for f in OUTCOME_SCHEMA.fields], dtype=object)
        for c, t in (("intentos_fallidos", "Int32"), ("minutos_restantes", "Int64"), ("intentos_restantes", "Int32")):
            out[c] = out[c].astype(t)
        for c in ("at", "bloqueado_hasta"):
            out[c] = time_column(out[c])
        return out

    def handleInputRows(self, key, rows, timerValues):
        known = self.account.get() if self.account.exists() else None
        n, until, last = known if known else (None, None, None)
        mark, late, arrived = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for pdf in rows:
            stored = zip(pdf["s_n"].astype("Int32").tolist(), times_of(pdf["s_lock"]))
            for at, ok, (s_n, s_lock) in zip(times_of(pdf["at"]), pdf["password_ok"].tolist(), stored):
                if known is None:
                    known = n, until, last = (None if s_n is pd.NA else s_n, s_lock, None)
                if at < mark:
                    late.append(at)
                else:
                    arrived.append((at, bool(ok)))
        out = [(int(key[0]), at, "late", n, until, None, None) for at in late]
        yield self._frame(out + self._apply(key, timerValues, n, until, last, arrived))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._frame(self._apply(key, timerValues, *self.account.get(), []))

    def close(self) -> None:
        pass


def lockout_stream(attempts: DataFrame, sellers: DataFrame, lock: _dt.timedelta = LOCK_TIME,
                   delay: str = "10 minutes") -> DataFrame:
    """Streaming outcomes for a stream of ``(account_id, at, password_ok)``.
    The session's state store provider must be ``ROCKSDB``."""
    acc = sellers.select(F.col("vendedor_id").alias("account_id"), "activo",
                         F.col("intentos_fallidos").alias("s_n"),
                         F.col("bloqueado_hasta").alias("s_lock"))
    # event-time watermarks need a TIMESTAMP column: the NTZ wall time read as
    # UTC, the same clock the state uses
    a = (attempts.withColumn("_event", ntz_instant("at"))
                 .withWatermark("_event", delay).join(acc, "account_id", "left"))
    still_locked = F.col("s_lock").isNotNull() & (F.col("s_lock") > F.col("at"))
    minutes = minutes_left("at", "s_lock")
    passive = a.where(F.col("activo").isNull() | ~F.col("activo")).select(
        "account_id", "at",
        F.when(F.col("activo").isNull(), "unknown").when(still_locked, "locked")
         .otherwise("inactive").alias("outcome"),
        F.col("s_n").alias("intentos_fallidos"), F.col("s_lock").alias("bloqueado_hasta"),
        F.when(F.col("activo").isNotNull() & still_locked, minutes).alias("minutos_restantes"),
        F.lit(None).cast("int").alias("intentos_restantes"))
    # without the watermarked column, so that no row is dropped before it is seen
    active = a.where(F.col("activo")).select("account_id", "at", "password_ok", "s_n", "s_lock")
    replayed = active.groupBy("account_id").transformWithStateInPandas(
        LockoutProcessor(microseconds(lock)), OUTCOME_SCHEMA, "append", "eventTime")
    return replayed.unionByName(passive)
