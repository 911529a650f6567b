"""Login-lockout replay over an attempt log.

Rule per seller account, attempts in time order:
unknown account -> locked (``bloqueado_hasta > at``) -> inactive -> wrong
password -> success.  A failure adds 1 to the count; at >= 5 the account is
locked for ``lock`` from that attempt.  Attempts while locked change
nothing, even with the right password.  An expired lock does not reset the
count, so the next failure locks again.  A success sets the count to 0,
the lock to NULL and stores the login time.

Unknown and inactive accounts never change state, nor do attempts before the
end of the stored lock, so their outcomes are a join and a projection.  Active accounts need the ordered state machine,
which no window expresses (ignored attempts depend on earlier locks).  To
keep a hot account from landing in one task, its attempts are cut into
contiguous chunks by range partitioning on (account, time).  The replay then
takes a fixed number of passes, whatever the number of chunks:

* pass 1 replays every partition once, each run of an account from its stored
  state: exact for the account's first chunk.  The first run of a partition
  may continue an account; for it the pass also works out the chunk's
  *transition function*, the state after the chunk for every state before it.
  That state is a count (0 to 4 or more) and a lock end, which only says how
  many of the chunk's first attempts are ignored, so the function is a table of
  (count class, lock end up to) rows, filled backwards in one sweep: a failure
  moves to the next count, a lock jumps to the first attempt after its end, a
  success forgets the count;
* pass 2 streams the tables of each account in chunk order, looking one row of
  each chunk up: the true state before every chunk that continues an account;
* pass 3 replays only those chunks (at most one per partition border, so the
  table of states is bounded by the number of partitions) from their true state.

Attempts of one account at the same time come in the order of ``event_id`` if
there is one, failures first otherwise.
"""

from __future__ import annotations

import datetime as _dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.functions.semantics import minutes_left
from marketframe.session import checkpoint_dir

# Fixed values of the source rule.
MAX_LOGIN_ATTEMPTS = 5
LOCK_TIME = _dt.timedelta(minutes=15)

OUTCOME_SCHEMA = T.StructType([
    T.StructField("account_id", T.LongType()),
    T.StructField("at", T.TimestampNTZType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("intentos_fallidos", T.IntegerType()),
    T.StructField("bloqueado_hasta", T.TimestampNTZType()),
    T.StructField("minutos_restantes", T.LongType()),
    T.StructField("intentos_restantes", T.IntegerType()),
])


def microseconds(span: _dt.timedelta) -> int:
    return span // _dt.timedelta(microseconds=1)


def step(n: int | None, until: int | None, at: int, ok: bool, lock: int):
    """One attempt on an active account; times and ``lock`` in microseconds.
    Returns (count, lock end, outcome, minutes left, attempts left)."""
    if until is not None and until > at:
        return n, until, "locked", -((at - until) // 60_000_000), None
    if not ok:
        n = (n or 0) + 1
        if n >= MAX_LOGIN_ATTEMPTS:
            return n, at + lock, "locked_now", None, None
        return n, until, "failed", None, MAX_LOGIN_ATTEMPTS - n
    return 0, None, "ok", None, None


def times_of(column: pd.Series) -> list[int | None]:
    """Microseconds since 1970 of a timestamp column, None for NULL."""
    whole = column.to_numpy().astype("datetime64[us]").astype("int64")
    return [None if gone else t for t, gone in zip(whole.tolist(), column.isna().tolist())]


def time_column(values) -> pd.Series:
    return pd.Series(np.array([np.iinfo(np.int64).min if v is None else v for v in values], np.int64)
                     .astype("datetime64[us]"))


#: Stands in a transition table for "the lock end stays as it was" and for
#: "no lock"; and for a lock end later than all others.
_KEEP, _NONE, _EVER = -(1 << 62), -(1 << 62) + 1, (1 << 62)


def transitions(at: list[int], ok: list[bool], lock: int) -> list[tuple[int, int, bool, int, int]]:
    """Transition function of a chunk of sorted attempts: rows (count class,
    lock end up to, count forgotten, count or what is added to it, lock end
    after), by class and lock end.  Lock ends reach one lock length beyond the
    first attempt at most, as they come from earlier attempts (those before the
    end of a stored lock are no part of a chunk)."""
    size = len(at)
    after = np.maximum(np.searchsorted(at, np.array(at, np.int64) + lock, "left"), np.arange(1, size + 1)).tolist()
    top = MAX_LOGIN_ATTEMPTS - 1
    fresh = [[False] * (size + 1) for _ in range(top + 1)]
    count = [[0] * (size + 1) for _ in range(top + 1)]
    until = [[_KEEP] * (size + 1) for _ in range(top + 1)]
    for p in range(size - 1, -1, -1):
        if ok[p]:
            n, end = count[0][p + 1], until[0][p + 1]
            end = _NONE if end == _KEEP else end
            for c in range(top + 1):
                fresh[c][p], count[c][p], until[c][p] = True, n, end
            continue
        for c in range(top):
            fresh[c][p], until[c][p] = fresh[c + 1][p + 1], until[c + 1][p + 1]
            count[c][p] = count[c + 1][p + 1] + (not fresh[c][p])
        q = after[p]
        fresh[top][p] = fresh[top][q]
        count[top][p] = count[top][q] + (not fresh[top][q])
        until[top][p] = at[p] + lock if until[top][q] == _KEEP else until[top][q]
    last = int(np.searchsorted(at, at[0] + lock, "left"))
    rows = []
    for c in range(top + 1):
        for p in range(last + 1):
            if 0 < p < size and at[p] == at[p - 1]:
                continue  # a lock that ends by then ends before the first of them
            row = (c, at[p] if p < last else _EVER, fresh[c][p], count[c][p], until[c][p])
            if rows and rows[-1][0] == c and rows[-1][2:] == row[2:]:
                rows.pop()
            rows.append(row)
    return rows


def _replay_partitions(lock: int, tables: bool):
    """``mapInPandas`` body: rows arrive sorted by (account, time) within a
    partition; each (account, chunk) run is replayed from its carry-in
    (``c_n``, ``c_lock``).  Emits one row per attempt, one ``carry`` row with
    the state after each run and, with ``tables``, the transition table of the
    partition's first run.  State crosses Arrow batch borders."""
    cols = [f.name for f in _REPLAY_SCHEMA.fields]

    def frame(rows):
        out = pd.DataFrame(rows, columns=cols, dtype=object)
        for c in ("at", "bloqueado_hasta"):
            out[c] = time_column(out[c])
        for f in _REPLAY_SCHEMA.fields:
            if isinstance(f.dataType, (T.IntegerType, T.LongType)):
                out[f.name] = out[f.name].astype("Int32" if isinstance(f.dataType, T.IntegerType) else "Int64")
        return out

    def run(batches):
        key, n, until, opening = None, None, None, ([], []) if tables else None

        def closed():
            rows = [(*key, "carry", None, None, None, n, until, None, None, None, None, None, None, None)]
            if opening is not None:
                rows += [(*key, "table", *[None] * 7, *row) for row in transitions(*opening, lock)]
            return rows
        for pdf in batches:
            rows = []
            for account, chunk, at, ok, c_n, c_lock in zip(
                    pdf["account_id"].tolist(), pdf["_chunk"].tolist(), times_of(pdf["at"]), pdf["password_ok"].tolist(),
                    pdf["c_n"].astype("Int32").tolist(), times_of(pdf["c_lock"])):
                if (account, chunk) != key:
                    if key is not None:
                        rows += closed()
                        opening = None
                    key, n, until = (account, chunk), None if c_n is pd.NA else c_n, c_lock
                ok = bool(ok)
                if opening is not None:
                    opening[0].append(at)
                    opening[1].append(ok)
                n, until, outcome, minutes, left = step(n, until, at, ok, lock)
                rows.append((*key, "attempt", at, ok, outcome, n, until, minutes, left, None, None, None, None, None))
            if rows:
                yield frame(rows)
        if key is not None:
            yield frame(closed())
    return run


_REPLAY_SCHEMA = T.StructType([
    T.StructField("account_id", T.LongType()), T.StructField("_chunk", T.IntegerType()),
    T.StructField("_kind", T.StringType()), T.StructField("at", T.TimestampNTZType()),
    T.StructField("password_ok", T.BooleanType()),
    T.StructField("outcome", T.StringType()), T.StructField("intentos_fallidos", T.IntegerType()),
    T.StructField("bloqueado_hasta", T.TimestampNTZType()),
    T.StructField("minutos_restantes", T.LongType()),
    T.StructField("intentos_restantes", T.IntegerType()),
    T.StructField("f_class", T.IntegerType()), T.StructField("f_upto", T.LongType()),
    T.StructField("f_fresh", T.BooleanType()), T.StructField("f_count", T.LongType()),
    T.StructField("f_until", T.LongType()),
])


def _walk(batches):
    """Rows sorted by (account, chunk, kind, class, lock end): the ``carry`` row
    of an account's first chunk, the transition tables of the later ones.  Gives
    the state before each later chunk (``c_n``, ``c_lock``)."""
    account, chunk, n, until, found = None, None, None, None, True
    for pdf in batches:
        out = []
        states = zip(pdf["intentos_fallidos"].astype("Int32").tolist(), times_of(pdf["bloqueado_hasta"]))
        names = ("account_id", "_chunk", "_kind", "f_class", "f_upto", "f_fresh", "f_count", "f_until")
        table = zip(*(pdf[c].astype("Int64").tolist() if c in ("f_upto", "f_count", "f_until") else pdf[c].tolist()
                      for c in names))
        for (a, k, kind, c, upto, fresh, count, end), (carry_n, carry_until) in zip(table, states):
            if kind == "carry":
                if a != account:
                    account, chunk, found = a, k, True
                    n, until = None if carry_n is pd.NA else carry_n, carry_until
                continue
            if k != chunk:  # the first row of a later chunk's table
                chunk, found = k, False
                out.append((a, k, n, until))
            if found or c != min(n or 0, MAX_LOGIN_ATTEMPTS - 1) or (until is not None and until > upto):
                continue
            found = True
            n = count if fresh else n if count == 0 else (n or 0) + count
            until = until if end == _KEEP else None if end == _NONE else end
        res = pd.DataFrame(out, columns=["account_id", "_chunk", "c_n", "c_lock"], dtype=object)
        res["c_n"], res["c_lock"] = res["c_n"].astype("Int32"), time_column(res["c_lock"])
        yield res


def attempts_by_email(attempts: DataFrame, sellers: DataFrame) -> DataFrame:
    """Attempts that name the account by e-mail (``correo``) as the route
    does: the address is lowercased and looked up; an unknown address keeps
    a NULL account and is reported as ``unknown``."""
    ids = sellers.select(F.col("correo").alias("_correo"), F.col("vendedor_id").alias("account_id"))
    return (attempts.withColumn("_correo", F.lower("correo")).join(ids, "_correo", "left")
                    .select("account_id", *[c for c in attempts.columns if c != "correo"]))


def login_lockout(attempts: DataFrame, sellers: DataFrame, lock: _dt.timedelta = LOCK_TIME,
                  num_chunks: int | None = None):
    """Replay ``attempts (account_id, at, password_ok)`` against ``sellers``
    (or ``(correo, at, password_ok)``, see ``attempts_by_email``).

    Returns ``(outcomes, new_sellers)``: one outcome row per attempt
    (``unknown``, ``locked``, ``inactive``, ``failed``, ``locked_now``,
    ``ok``) with the state after it, and the sellers table with
    ``intentos_fallidos``, ``bloqueado_hasta`` and ``ultimo_login`` after
    the whole log."""
    spark = attempts.sparkSession
    checkpoint_dir(spark)
    if "account_id" not in attempts.columns:
        attempts = attempts_by_email(attempts, sellers)
    acc = sellers.select(F.col("vendedor_id").alias("account_id"), "activo",
                         F.col("intentos_fallidos").alias("s_n"),
                         F.col("bloqueado_hasta").alias("s_lock"),
                         F.col("ultimo_login").alias("s_login"))
    tie = [c for c in ("event_id",) if c in attempts.columns]
    a = attempts.select("account_id", "at", "password_ok", *tie).join(acc, "account_id", "left")

    # unknown / inactive accounts change no state: a projection suffices
    still_locked = F.col("s_lock").isNotNull() & (F.col("s_lock") > F.col("at"))
    minutes = minutes_left("at", "s_lock")
    # and so do attempts before the end of the stored lock, whatever the account
    early = F.coalesce(still_locked, F.lit(False))
    passive = a.where(F.col("activo").isNull() | ~F.col("activo") | early).select(
        "account_id", "at",
        F.when(F.col("activo").isNull(), "unknown").when(still_locked, "locked")
         .otherwise("inactive").alias("outcome"),
        F.col("s_n").alias("intentos_fallidos"), F.col("s_lock").alias("bloqueado_hasta"),
        F.when(F.col("activo").isNotNull() & still_locked, minutes).alias("minutos_restantes"),
        F.lit(None).cast("int").alias("intentos_restantes"))

    # pass 1.  Chunks are the range partitions, sorted by (account, time).  The
    # output is checkpointed: it fixes the chunk of every attempt (range bounds
    # are sampled anew whenever an exchange re-runs) and pass 3 reads its rows
    # from it, in the same partitions and order.
    n = num_chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["account_id", "at", *tie, "password_ok"]
    chunked = (a.where(F.col("activo") & ~early).repartitionByRange(n, *order).sortWithinPartitions(*order)
                .select("account_id", F.spark_partition_id().alias("_chunk"), "at", "password_ok",
                        F.col("s_n").alias("c_n"), F.col("s_lock").alias("c_lock")))
    first = chunked.mapInPandas(_replay_partitions(microseconds(lock), True), _REPLAY_SCHEMA).checkpoint()
    # chunks that continue an account: at most one per partition border
    runs = Window.partitionBy("account_id").orderBy("_chunk")
    carries = first.where("_kind = 'carry'")
    follow = (carries.select("account_id", "_chunk", F.lag("_chunk").over(runs).alias("_prev"))
              .where(F.col("_prev").isNotNull()).checkpoint())
    # pass 2: the true state before each of them
    spread = follow.select("account_id").distinct()
    tables = first.where("_kind = 'table'").join(
        F.broadcast(follow.select("account_id", "_chunk")), ["account_id", "_chunk"], "left_semi")
    steps = carries.join(F.broadcast(spread), "account_id", "left_semi").unionByName(tables)
    by = ["account_id", "_chunk", "_kind", "f_class", "f_upto"]
    todo = (steps.repartition("account_id").sortWithinPartitions(*by)
            .select(*by, "intentos_fallidos", "bloqueado_hasta", "f_fresh", "f_count", "f_until")
            .mapInPandas(_walk, "account_id long, _chunk int, c_n int, c_lock timestamp_ntz").checkpoint())
    # pass 3: those chunks from that state
    rows = first.where("_kind = 'attempt'").select("account_id", "_chunk", "at", "password_ok")
    redone = (rows.join(F.broadcast(todo), ["account_id", "_chunk"])
              .mapInPandas(_replay_partitions(microseconds(lock), False), _REPLAY_SCHEMA).checkpoint())
    final = (first.where("_kind <> 'table'").join(F.broadcast(todo.select("account_id", "_chunk")),
                                                  ["account_id", "_chunk"], "left_anti").unionByName(redone))
    outcomes = final.where("_kind = 'attempt'").select(*[f.name for f in OUTCOME_SCHEMA.fields])
    outcomes = outcomes.unionByName(passive)

    end_state = (final.where("_kind = 'carry'")
                 .join(F.broadcast(follow.select("account_id", F.col("_prev").alias("_chunk"))),
                       ["account_id", "_chunk"], "left_anti")
                 .select("account_id", F.col("intentos_fallidos").alias("e_n"),
                         F.col("bloqueado_hasta").alias("e_lock"), F.lit(True).alias("_hit")))
    logins = (outcomes.where(F.col("outcome") == "ok").groupBy("account_id")
                      .agg(F.max("at").alias("e_login")))
    end_state = end_state.join(logins, "account_id", "left")
    j = sellers.join(end_state, sellers.vendedor_id == end_state.account_id, "left")
    cols = []
    for c in sellers.columns:
        src = {"intentos_fallidos": "e_n", "bloqueado_hasta": "e_lock", "ultimo_login": "e_login"}
        if c in src:
            new = F.col(src[c])
            if c == "ultimo_login":
                new = F.coalesce(new, F.col(c))
            cols.append(F.when(F.col("_hit").isNotNull(), new).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return outcomes, j.select(*cols)
