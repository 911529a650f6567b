"""Account rules as set operations: registration validation, uniqueness
conflicts, batch admission, roles, lookups and seller listings.

Every request-at-a-time rule is re-aimed at a DataFrame of requests, so
one job decides a whole batch.  Conflicts are equi-joins per key (never an
OR join), which keeps each join a hash/sort-merge join on one column.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.semantics import (falsy_to_null, ilike_contains, is_falsy,
                                             ntz_lit, parse_int_param, pg_desc)
from marketframe.session import checkpoint_dir

# Fixed values of the source rules.
USER_TYPES = ("cliente", "vendedor")
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
USER_MIN_PASSWORD = 6
SELLER_MIN_PASSWORD = 8
DEFAULT_USER_TYPE = "cliente"
SELLER_ROLE = "vendedor"
PUBLIC_SELLER_COLUMNS = ("vendedor_id", "nombres", "apellidos", "konami_id", "whatsapp",
                         "instagram", "facebook", "otro", "created_at")
SENSITIVE_SELLER_COLUMNS = ("password_hash", "intentos_fallidos", "bloqueado_hasta")
USER_KEYS = ("username", "email", "dni")
SELLER_KEYS = ("correo", "dni", "konami_id")
LAST_ROUNDS = 0  # rounds and pointer jumps of the most recent batch admission (for tests and tuning)


def _ts(now) -> Column:
    if now is None:
        return F.localtimestamp()
    return ntz_lit(now)


# ---- validation --------------------------------------------------------------
def validate_users(regs: DataFrame) -> DataFrame:
    """The first failing rule names the error (NULL = valid): required
    fields (falsy fails) -> user type whitelist when given -> e-mail pattern
    -> password length >= 6."""
    missing = None
    for c in ("username", "password", "email", "dni"):
        m = is_falsy(c)
        missing = m if missing is None else (missing | m)
    bad_type = ~is_falsy("user_type") & ~F.col("user_type").isin(*USER_TYPES)
    error = (F.when(missing, "missing_fields")
              .when(bad_type, "invalid_user_type")
              .when(~F.col("email").rlike(EMAIL_PATTERN), "invalid_email")
              .when(F.length("password") < USER_MIN_PASSWORD, "short_password"))
    return regs.withColumn("error", error)


def validate_sellers(regs: DataFrame) -> DataFrame:
    """R2: required ``nombres, apellidos, correo, password, dni`` -> password
    length >= 8.  Valid rows are normalised as stored: ``correo`` lowercased
    (F16), optional contacts ``|| null``."""
    missing = None
    for c in ("nombres", "apellidos", "correo", "password", "dni"):
        m = is_falsy(c)
        missing = m if missing is None else (missing | m)
    error = (F.when(missing, "missing_fields")
              .when(F.length("password") < SELLER_MIN_PASSWORD, "short_password"))
    return regs.select(
        "seq", "nombres", "apellidos", F.lower("correo").alias("correo"), "dni",
        *[falsy_to_null(c).alias(c) for c in ("konami_id", "whatsapp", "instagram",
                                              "facebook", "otro")],
        error.alias("error"))


# ---- conflicts against stored rows ---------------------------------------------
def _first_conflict(regs: DataFrame, stored: DataFrame, keys, id_col: str) -> DataFrame:
    """For each request, the stored row with the lowest id that shares any of
    ``keys`` and, for that row, the first key (in ``keys`` order) it shares.
    One equi-join per key; NULL keys never match."""
    hits = None
    for rank, k in enumerate(keys):
        h = (regs.select("seq", F.col(k).alias("_k")).where(F.col("_k").isNotNull())
                 .join(stored.select(F.col(id_col).alias("_id"), F.col(k).alias("_k")), "_k")
                 .select("seq", "_id", F.lit(rank).alias("_rank")))
        hits = h if hits is None else hits.unionByName(h)
    names = F.array(*[F.lit(k) for k in keys])
    best = hits.groupBy("seq").agg(F.min(F.struct("_id", "_rank")).alias("_b"))
    return best.select("seq", F.col("_b._id").alias("conflict_id"),
                       F.element_at(names, F.col("_b._rank") + 1).alias("conflict_field"))


def user_conflicts(regs: DataFrame, users: DataFrame) -> DataFrame:
    """Per valid request, ``conflict_field`` from
    ``CASE WHEN username=.. THEN 'username' WHEN email=.. THEN 'email' WHEN
    dni=.. THEN 'dni' END ... LIMIT 1`` (made deterministic: the lowest
    existing id).  NULL when there is no conflict."""
    valid = validate_users(regs).where(F.col("error").isNull())
    c = _first_conflict(valid, users, USER_KEYS, "id")
    return valid.select("seq").join(c, "seq", "left").select("seq", "conflict_field")


def seller_conflicts(regs: DataFrame, sellers: DataFrame) -> DataFrame:
    """Unique ``correo`` (lowercased), ``dni``, ``konami_id`` (NULL never
    conflicts), reported in that order."""
    valid = validate_sellers(regs).where(F.col("error").isNull())
    c = _first_conflict(valid, sellers, SELLER_KEYS, "vendedor_id")
    return valid.select("seq").join(c, "seq", "left").select("seq", "conflict_field")


# ---- batch admission with uniqueness inside the batch ---------------------------
def _key_rows(df: DataFrame, keys) -> DataFrame:
    """One row per (request, key name, key value); NULL values never conflict."""
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("kt"), F.col(k).cast("string").alias("kv"))
                                  for i, k in enumerate(keys)]))
    return df.select("seq", stacked.alias("_kk")).select("seq", "_kk.kt", "_kk.kv") \
             .where(F.col("kv").isNotNull())


def _ranked_keys(und: DataFrame) -> DataFrame:
    """The key rows of undecided requests with the earliest and second
    earliest request of each key.  Grouped minima only (map-side combined)."""
    mins = und.groupBy("kt", "kv").agg(F.min("seq").alias("_min"))
    j = und.join(mins, ["kt", "kv"])
    seconds = (j.where(F.col("seq") != F.col("_min"))
                .groupBy("kt", "kv").agg(F.min("seq").alias("_second")))
    return j.join(seconds, ["kt", "kv"], "left")


def _chain_ends(links: DataFrame) -> tuple[DataFrame, int]:
    """Pointer jumping over ``(seq, ptr)`` links, each saying "``seq`` is
    accepted iff ``ptr`` is not": every link is led to the first request of its
    chain that has no link of its own, with ``odd`` = an odd number of links
    lies between.  A chain of n links takes about log2(n) steps; returns the
    number of steps too."""
    links = links.withColumn("odd", F.lit(True))
    steps = 0
    while True:
        steps += 1
        nxt = links.select(F.col("seq").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("odd").alias("_odd"))
        moved = (links.select("seq", "ptr", "odd").join(nxt, "ptr", "left")
                      .select("seq", F.coalesce("_ptr", "ptr").alias("ptr"),
                              (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"),
                              F.col("_ptr").isNotNull().alias("_moved")).checkpoint())
        links = moved
        if moved.where("_moved").isEmpty():
            return links.select("seq", "ptr", "odd"), steps


def admit_batch(candidates: DataFrame, keys) -> DataFrame:
    """R5 core: the requests that a one-by-one replay in ``seq`` order accepts
    when a request is refused iff it shares a key with an earlier accepted
    one (the lexicographically-first maximal independent set of the
    conflict graph).

    Each round accepts every undecided request that is the earliest
    undecided one on all of its keys.  A request with exactly one earlier
    undecided neighbour is accepted iff that one is not, so such requests form
    chains; they are contracted by pointer jumping, and a chain that ends at a
    request refused in this round is decided as a whole.  Then every request
    sharing a key with a newly accepted one is refused.  A chain of n requests
    takes about log2(n) steps; requests with several earlier neighbours wait
    for the next round, so only a run of these that hang on each other still
    takes a round per link.

    Per-key minima are grouped aggregates (a hot key value costs one partial
    row per task).  Every round starts from tables in the shared checkpoint
    folder, so a lost executor costs at most one round.  Returns ``seq`` of
    the accepted requests."""
    checkpoint_dir(candidates.sparkSession)
    und = _key_rows(candidates, keys).checkpoint()
    accepted = None
    rounds = 0
    seq, low = F.col("seq"), F.col("_min")
    while not und.isEmpty():
        rounds += 1
        ranked = _ranked_keys(und).checkpoint()
        later = seq != low
        nodes = ranked.groupBy("seq").agg(
            F.min(~later).alias("_free"),
            F.min(F.when(later, seq == F.col("_second"))).alias("_next"),
            F.min(F.when(later, low)).alias("_pred"), F.max(F.when(later, low)).alias("_pred2"))
        won = nodes.where("_free").select("seq")
        # a free request is the minimum of every key it has, so the requests that
        # share a key with one are exactly those whose key minimum is free
        lost = (ranked.where(later).join(won.select(seq.alias("_min")), "_min", "left_semi")
                      .select("seq").distinct())
        links = (nodes.where(~F.col("_free") & F.col("_next") & (F.col("_pred") == F.col("_pred2")))
                      .select("seq", F.col("_pred").alias("ptr"))
                      .join(lost, "seq", "left_anti").checkpoint())
        if not links.isEmpty():
            ends, steps = _chain_ends(links)
            rounds += steps
            won = won.unionByName(ends.where("odd").join(lost.select(seq.alias("ptr")), "ptr", "left_semi")
                                      .select("seq"))
        won = won.checkpoint()
        accepted = won if accepted is None else accepted.unionByName(won)
        taken = ranked.join(won, "seq", "left_semi").select("kt", "kv")  # a key has one accepted request at most
        gone = ranked.join(taken, ["kt", "kv"], "left_semi").select("seq").distinct()
        und = ranked.select("seq", "kt", "kv").join(gone, "seq", "left_anti").checkpoint()
    global LAST_ROUNDS
    LAST_ROUNDS = rounds
    # requests without any key conflict with nobody
    keyless = candidates.select("seq").join(_key_rows(candidates, keys).select("seq"),
                                            "seq", "left_anti")
    return keyless if accepted is None else accepted.unionByName(keyless)


def _register(v: DataFrame, stored_rows: DataFrame, keys, id_col: str) -> DataFrame:
    """Validated requests with ``conflict_field`` and ``status``."""
    checkpoint_dir(v.sparkSession)
    valid = v.where(F.col("error").isNull())
    stored = _first_conflict(valid, stored_rows, keys, id_col).checkpoint()
    cand = valid.join(stored, "seq", "left_anti")
    accepted = admit_batch(cand, keys)
    acc = cand.join(accepted, "seq", "left_semi")
    lost = cand.join(accepted, "seq", "left_anti")
    # for refused batch rows: the earliest accepted request sharing a key
    acc_as_stored = acc.select(F.col("seq").alias("_aseq"), *keys)
    in_batch = _first_conflict(lost, acc_as_stored, keys, "_aseq")
    conflicts = stored.unionByName(in_batch).select("seq", "conflict_field")
    status = (F.when(F.col("error").isNotNull(), "invalid")
               .when(F.col("conflict_field").isNotNull(), "conflict").otherwise("accepted"))
    return v.join(conflicts, "seq", "left").withColumn("status", status)


def register_users(regs: DataFrame, users: DataFrame) -> DataFrame:
    """R5 for user registrations: per request ``status`` (``accepted``,
    ``invalid``, ``conflict``), the validation ``error`` and the
    ``conflict_field`` (against stored users first, then against requests
    of the same batch accepted earlier)."""
    out = _register(validate_users(regs), users, USER_KEYS, "id")
    return out.select("seq", "status", "error", "conflict_field",
                      F.when(F.col("status") == "accepted",
                             F.coalesce(falsy_to_null("user_type"), F.lit(DEFAULT_USER_TYPE)))
                       .alias("user_type"))


def register_sellers(regs: DataFrame, sellers: DataFrame) -> DataFrame:
    """R5 for seller registrations: unique ``correo`` (lowercased), ``dni`` and
    ``konami_id`` (NULL never conflicts), against stored sellers and against
    earlier accepted requests of the batch."""
    out = _register(validate_sellers(regs), sellers, SELLER_KEYS, "vendedor_id")
    return out.select("seq", "status", "error", "conflict_field")


def default_roles(accepted_users: DataFrame) -> DataFrame:
    """One role row per new user, ``role = user_type || 'cliente'``."""
    return accepted_users.select(
        F.col("id").alias("user_id"),
        F.coalesce(falsy_to_null("user_type"), F.lit(DEFAULT_USER_TYPE)).alias("role"))


# ---- lookups and roles -------------------------------------------------------
def user_lookup(users: DataFrame, logins: DataFrame) -> DataFrame:
    """``WHERE username = $1 OR email = $1`` for many login names at
    once, as the union of two equi-joins, then distinct.  ``status``:
    ``inactive`` when the user is deactivated, else ``ok``."""
    lg = logins.select(F.col(logins.columns[0]).alias("login"))
    u = users.select("id", "username", "email", "dni", "user_type", "is_active")
    by_name = lg.join(u, lg.login == u.username)
    by_mail = lg.join(u, lg.login == u.email)
    hits = by_name.unionByName(by_mail).distinct()
    return hits.select("login", "id", "username", "email", "dni", "user_type",
                       F.when(F.col("is_active"), "ok").otherwise("inactive").alias("status"))


def user_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Each user with the sorted list of its roles (``[]`` when none)."""
    r = roles.groupBy("user_id").agg(F.array_sort(F.collect_list("role")).alias("roles"))
    j = users.join(r, users.id == r.user_id, "left")
    return j.select("id", "username", "email", "dni", "user_type", "is_active",
                    F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


def login_check(users: DataFrame, roles: DataFrame, logins: DataFrame) -> DataFrame:
    """The login / verify check as one result: the user of each login name
    with the sorted roles; an inactive user is refused and shows none."""
    hits = user_lookup(users, logins)
    held = user_roles(users, roles).select("id", "roles")
    none = F.array().cast("array<string>")
    return hits.join(held, "id").select(
        "login", "id", "username", "email", "user_type", "status",
        F.when(F.col("status") == "ok", F.col("roles")).otherwise(none).alias("roles"))


def role_filter(with_roles: DataFrame, role: str = SELLER_ROLE) -> DataFrame:
    """Users whose role list contains ``role`` (missing roles -> denied)."""
    return with_roles.where(F.coalesce(F.array_contains("roles", role), F.lit(False)))


def upgrade_to_seller(users: DataFrame, roles: DataFrame, user_ids: DataFrame,
                      now=None):
    """Add the ``vendedor`` role when absent and set ``user_type`` and
    ``updated_at``; users that already have the role are refused.
    Returns ``(new_users, new_roles, refused_ids)``."""
    ids = user_ids.select(F.col(user_ids.columns[0]).alias("user_id")).distinct()
    has = roles.where(F.col("role") == SELLER_ROLE).select("user_id")
    refused = ids.join(has, "user_id", "left_semi")
    todo = ids.join(has, "user_id", "left_anti")
    new_roles = roles.unionByName(todo.select("user_id", F.lit(SELLER_ROLE).alias("role")))
    t = todo.select(F.col("user_id").alias("id"), F.lit(True).alias("_hit"))
    j = users.join(t, "id", "left")
    out = []
    for c in users.columns:
        if c == "user_type":
            out.append(F.when(F.col("_hit").isNotNull(), F.lit(SELLER_ROLE)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("_hit").isNotNull(), _ts(now)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out), new_roles, refused


# ---- sellers -------------------------------------------------------------------
def seller_public(sellers: DataFrame) -> DataFrame:
    """The profile without password hash, attempt count and lock."""
    return sellers.drop(*SENSITIVE_SELLER_COLUMNS)


def seller_by_konami(sellers: DataFrame, konami_ids: DataFrame) -> DataFrame:
    """P4 (+P12): ``WHERE konami_id = $1 AND activo`` for many ids at once."""
    k = konami_ids.select(F.col(konami_ids.columns[0]).alias("konami_id")).distinct()
    s = sellers.where(F.col("activo")).select("vendedor_id", "nombres", "apellidos",
                                              "konami_id", "whatsapp", "instagram",
                                              "facebook", "otro")
    return s.join(k, "konami_id", "left_semi")


def seller_search_page(sellers: DataFrame, search: str | None = None, limit=50,
                       offset=0) -> DataFrame:
    """P9 + P12 + O5: active sellers, optional three-column ILIKE search,
    ``ORDER BY created_at DESC LIMIT n OFFSET o`` (``vendedor_id`` breaks
    ties)."""
    n, o = parse_int_param(limit), parse_int_param(offset)
    if n is None or o is None:
        raise ValueError("limit/offset must be numbers")
    s = sellers.where(F.col("activo"))
    if search:
        s = s.where(ilike_contains("nombres", search) | ilike_contains("apellidos", search)
                    | ilike_contains("konami_id", search))
    s = s.select(*PUBLIC_SELLER_COLUMNS)
    return s.orderBy(pg_desc("created_at"), "vendedor_id").offset(o).limit(n)


def active_seller_count(sellers: DataFrame) -> DataFrame:
    """``COUNT(*) WHERE activo = true``."""
    return sellers.where(F.col("activo")).agg(F.count(F.lit(1)).alias("total"))
