import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketframe.operators import accounts as acc
from marketframe.operators import lockout as lk
import replay

REG = "seq long, username string, password string, email string, dni string, user_type string"
USERS = ("id long, username string, password_hash string, email string, dni string, "
         "user_type string, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz")


def test_validate_users_first_failing_rule(spark):
    rows = [(1, "", "secret1", "a@b.co", "1", None),          # missing
            (2, "u", "secret1", "a@b.co", "1", "admin"),      # bad type
            (3, "u", "secret1", "a b@c.co", "1", ""),         # '' type is fine, bad email
            (4, "u", "short", "a@b.co", "1", "cliente"),      # short password
            (5, "u", "secret1", "a@b.co", "1", "vendedor"),   # valid
            (6, "u", "x", "no-at", "1", "admin")]             # type before email before length
    got = dict((r.seq, r.error) for r in acc.validate_users(spark.createDataFrame(rows, REG)).collect())
    assert got == {1: "missing_fields", 2: "invalid_user_type", 3: "invalid_email",
                   4: "short_password", 5: None, 6: "invalid_user_type"}


def test_validate_sellers_lowercases_and_nulls(spark):
    schema = ("seq long, nombres string, apellidos string, correo string, password string, dni string, "
              "konami_id string, whatsapp string, instagram string, facebook string, otro string")
    rows = [(1, "Ana", "P", "Ana@X.COM", "12345678", "9", "", None, "", None, "o"),
            (2, "Ana", "P", "a@x.com", "1234567", "9", None, None, None, None, None),
            (3, "Ana", None, "a@x.com", "12345678", "9", None, None, None, None, None)]
    got = {r.seq: r for r in acc.validate_sellers(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].error is None and got[1].correo == "ana@x.com" and got[1].konami_id is None
    assert got[2].error == "short_password" and got[3].error == "missing_fields"


def test_user_conflicts_lowest_id_then_field_order(spark):
    users = spark.createDataFrame([
        (5, "bob", None, "x@y.co", "D1", "cliente", True, None, None),
        (7, "amy", None, "amy@y.co", "D2", "cliente", True, None, None)], USERS)
    regs = spark.createDataFrame([
        (1, "amy", "secret1", "x@y.co", "D9", None),   # id 5 by email, id 7 by username -> id 5: email
        (2, "amy", "secret1", "q@y.co", "D9", None),   # username
        (3, "zed", "secret1", "q@y.co", "D2", None),   # dni
        (4, "zed", "secret1", "q@y.co", "D9", None)], REG)
    got = dict((r.seq, r.conflict_field) for r in acc.user_conflicts(regs, users).collect())
    assert got == {1: "email", 2: "username", 3: "dni", 4: None}


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_register_batch_equals_sequential(spark, seed):
    rng = random.Random(seed)
    existing = [dict(id=i, username=f"u{i}", email=f"e{i}@m.co", dni=f"d{i}") for i in range(3)]
    reqs = []
    for seq in range(60):
        reqs.append(dict(seq=seq, username=f"u{rng.randint(0, 25)}", email=f"e{rng.randint(0, 25)}@m.co",
                         dni=f"d{rng.randint(0, 25)}"))
    users = spark.createDataFrame([(e["id"], e["username"], None, e["email"], e["dni"], "cliente", True,
                                    None, None) for e in existing], USERS)
    regs = spark.createDataFrame([(r["seq"], r["username"], "secret1", r["email"], r["dni"], None)
                                  for r in reqs], REG)
    out = acc.register_users(regs, users)
    got = sorted(r.seq for r in out.where(F.col("status") == "accepted").collect())
    assert got == replay.register(existing, reqs, ["username", "email", "dni"])
    # every refused request names a field it really shares
    for r in out.where(F.col("status") == "conflict").collect():
        assert r.conflict_field in ("username", "email", "dni")


def test_admit_batch_contracts_chains(spark):
    """Request i shares its username with i-1 or its email with i-1 in turn: a
    replay settles one request after the other, pointer jumping log2 of them."""
    reqs = [dict(seq=i, username=f"u{(i + 1) // 2}", email=f"e{i // 2}") for i in range(200)]
    df = spark.createDataFrame([(r["seq"], r["username"], r["email"]) for r in reqs],
                               "seq long, username string, email string")
    got = sorted(r.seq for r in acc.admit_batch(df, ["username", "email"]).collect())
    assert got == replay.register([], reqs, ["username", "email"]) == list(range(0, 200, 2))
    assert acc.LAST_ROUNDS <= 12


@pytest.mark.parametrize("seed", [41, 42, 43, 44])
def test_admit_batch_chains_equal_replay(spark, seed):
    """Chains with branches, hot keys and missing keys in random order."""
    rng = random.Random(seed)
    reqs = []
    for chain in range(5):
        n = rng.randint(1, 40)
        for i in range(n):
            reqs.append(dict(username=f"u{chain}-{(i + 1) // 2}", email=f"e{chain}-{i // 2}",
                             dni=None if rng.random() < 0.6 else f"d{rng.randint(0, 30)}"))
            if rng.random() < 0.2:   # a branch
                reqs.append(dict(username=f"u{chain}-{rng.randint(0, n)}", email=None, dni=None))
    reqs += [dict(username=None, email=None, dni=rng.choice(["d1", "hot", None])) for _ in range(40)]
    if seed % 2:                     # chains stay in order otherwise
        rng.shuffle(reqs)
    for i, r in enumerate(reqs):
        r["seq"] = i
    keys = ["username", "email", "dni"]
    df = spark.createDataFrame([(r["seq"], *(r[k] for k in keys)) for r in reqs],
                               "seq long, username string, email string, dni string")
    got = sorted(r.seq for r in acc.admit_batch(df, keys).collect())
    assert got == replay.register([], reqs, keys)


def test_user_roles_and_filters(spark):
    users = spark.createDataFrame([(1, "a", None, "a@x", "1", "cliente", True, None, None),
                                   (2, "b", None, "b@x", "2", "cliente", False, None, None)], USERS)
    roles = spark.createDataFrame([(1, "vendedor"), (1, "cliente")], "user_id long, role string")
    wr = {r.id: r.roles for r in acc.user_roles(users, roles).collect()}
    assert wr == {1: ["cliente", "vendedor"], 2: []}
    assert [r.id for r in acc.role_filter(acc.user_roles(users, roles)).collect()] == [1]
    look = acc.user_lookup(users, spark.createDataFrame([("a",), ("b@x",), ("zz",)], "login string"))
    assert sorted((r.login, r.id, r.status) for r in look.collect()) == [("a", 1, "ok"), ("b@x", 2, "inactive")]
    now = dt.datetime(2024, 1, 1)
    new_users, new_roles, refused = acc.upgrade_to_seller(
        users, roles, spark.createDataFrame([(1,), (2,)], "id long"), now=now)
    assert [r.user_id for r in refused.collect()] == [1]
    assert sorted(tuple(r) for r in new_roles.collect()) == [(1, "cliente"), (1, "vendedor"), (2, "vendedor")]
    assert {r.id: (r.user_type, r.updated_at) for r in new_users.collect()} == {
        1: ("cliente", None), 2: ("vendedor", now)}


def test_seller_listing_page_and_counts(spark):
    schema = ("vendedor_id long, nombres string, apellidos string, konami_id string, whatsapp string, "
              "instagram string, facebook string, otro string, created_at timestamp_ntz, activo boolean, "
              "password_hash string, intentos_fallidos int, bloqueado_hasta timestamp_ntz")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, f"N{i}", "X", None if i % 2 else f"K{i}", None, None, None, None,
             None if i == 3 else t0 + dt.timedelta(hours=i), i != 4, "h", 0, None) for i in range(6)]
    s = spark.createDataFrame(rows, schema)
    page = [r.vendedor_id for r in acc.seller_search_page(s, None, limit="2", offset="1").collect()]
    assert page == [5, 2]          # NULL created_at first (DESC), inactive 4 out
    assert acc.active_seller_count(s).first().total == 5
    assert "password_hash" not in acc.seller_public(s).columns
    found = acc.seller_by_konami(s, spark.createDataFrame([("K2",), ("K4",)], "k string"))
    assert [r.vendedor_id for r in found.collect()] == [2]


# ---- R7 login lockout ------------------------------------------------------------
SELLERS = ("vendedor_id long, activo boolean, intentos_fallidos int, bloqueado_hasta timestamp_ntz, "
           "ultimo_login timestamp_ntz")


@pytest.mark.parametrize("seed,chunks", [(21, 3), (22, 8), (23, 17)])
def test_lockout_equals_sequential_replay(spark, seed, chunks):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    lock = dt.timedelta(minutes=15)
    accounts = {1: dict(activo=True, n=0, lock=None), 2: dict(activo=True, n=4, lock=None),
                3: dict(activo=False, n=0, lock=t0 + dt.timedelta(minutes=30)),
                4: dict(activo=True, n=1, lock=t0 + dt.timedelta(minutes=5))}
    attempts, t = [], t0
    for _ in range(300):
        t += dt.timedelta(seconds=rng.randint(1, 240), microseconds=rng.randint(0, 999999))
        # account 1 is hot: most attempts, so its run is cut across chunks
        acc_id = rng.choice([1, 1, 1, 1, 2, 3, 4, 9])
        attempts.append((acc_id, t, rng.random() < 0.35))
    want, state = replay.lockout(accounts, attempts, lock)
    sellers = spark.createDataFrame([(k, v["activo"], v["n"], v["lock"], None) for k, v in accounts.items()],
                                    SELLERS)
    att = spark.createDataFrame(attempts, "account_id long, at timestamp_ntz, password_ok boolean")
    out, new_sellers = lk.login_lockout(att, sellers, lock=lock, num_chunks=chunks)
    got = sorted((r.account_id, r.at, r.outcome) for r in out.collect())
    assert got == sorted(want)
    final = {r.vendedor_id: (r.intentos_fallidos, r.bloqueado_hasta) for r in new_sellers.collect()}
    for k, v in state.items():
        assert final[k] == (v["n"], v["lock"]), k


def test_transition_tables_equal_stepping():
    """Every state before a chunk, also with attempts at the same time."""
    rng = random.Random(31)
    for _ in range(300):
        lock = rng.choice([0, 3, 10, 40])
        at = sorted(rng.randint(0, 60) for _ in range(rng.randint(1, 25)))
        ok = [rng.random() < rng.choice([0, 0.2, 0.6]) for _ in at]
        table = lk.transitions(at, ok, lock)
        for n0 in (None, 0, 1, 2, 3, 4, 5, 9):
            for until0 in (None, at[0], *(rng.randint(0, at[0] + lock) for _ in range(4)), at[0] + lock):
                n, until = n0, until0
                for t, good in zip(at, ok):
                    n, until, *_ = lk.step(n, until, t, good, lock)
                _, _, fresh, count, end = next(r for r in table if r[0] == min(n0 or 0, 4)
                                               and (until0 is None or until0 <= r[1]))
                assert (count if fresh else n0 if not count else (n0 or 0) + count) == n
                assert (until0 if end == lk._KEEP else None if end == lk._NONE else end) == until


def test_lockout_passes_do_not_grow_with_the_chunks(spark):
    """One account that never succeeds, attempts denser than the lock."""
    t0 = dt.datetime(2024, 1, 1)
    attempts = [(1, t0 + dt.timedelta(seconds=s), s % 97 == 96) for s in range(3000)]
    attempts += [(2, t0 + dt.timedelta(seconds=s), False) for s in range(0, 3000, 10)]
    accounts = {1: dict(activo=True, n=0, lock=None), 2: dict(activo=True, n=None, lock=None)}
    want, state = replay.lockout(accounts, sorted(attempts, key=lambda a: a[1]), dt.timedelta(minutes=1))
    sellers = spark.createDataFrame([(k, v["activo"], v["n"], v["lock"], None) for k, v in accounts.items()], SELLERS)
    att = spark.createDataFrame(attempts, "account_id long, at timestamp_ntz, password_ok boolean")
    jobs = {}
    for chunks in (2, 64):
        spark.sparkContext.setJobGroup(f"lockout-{chunks}", "lockout")
        out, new_sellers = lk.login_lockout(att, sellers, lock=dt.timedelta(minutes=1), num_chunks=chunks)
        jobs[chunks] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lockout-{chunks}"))
        spark.sparkContext.setJobGroup("", "")
        assert sorted((r.account_id, r.at, r.outcome) for r in out.collect()) == sorted(want)
        assert {r.vendedor_id: (r.intentos_fallidos, r.bloqueado_hasta) for r in new_sellers.collect()} == {
            k: (v["n"], v["lock"]) for k, v in state.items()}
    assert 0 < jobs[64] <= jobs[2] + 2, jobs


def test_lockout_ties_come_by_event_id(spark):
    t0 = dt.datetime(2024, 1, 1)
    sellers = spark.createDataFrame([(1, True, 4, None, None)], SELLERS)
    for ids, want in (((1, 2), ["ok", "failed"]), ((2, 1), ["locked_now", "locked"])):
        att = spark.createDataFrame([(1, t0, True, ids[0]), (1, t0, False, ids[1])],
                                    "account_id long, at timestamp_ntz, password_ok boolean, event_id long")
        out, _ = lk.login_lockout(att, sellers)
        assert sorted(r.outcome for r in out.collect()) == sorted(want)


def test_lockout_minutes_left_rounds_up(spark):
    t0 = dt.datetime(2024, 1, 1)
    sellers = spark.createDataFrame([(1, True, 5, t0 + dt.timedelta(minutes=10, seconds=1), None)], SELLERS)
    att = spark.createDataFrame([(1, t0, True)], "account_id long, at timestamp_ntz, password_ok boolean")
    out, _ = lk.login_lockout(att, sellers)
    r = out.first()
    assert (r.outcome, r.minutos_restantes) == ("locked", replay.ceil_minutes(dt.timedelta(minutes=10, seconds=1)))


def test_lockout_by_email(spark):
    t0 = dt.datetime(2024, 1, 1)
    sellers = spark.createDataFrame([(1, True, 4, None, None, "ana@x.com")], SELLERS + ", correo string")
    att = spark.createDataFrame([("ANA@x.com", t0, False), ("zz@x.com", t0, True)],
                                "correo string, at timestamp_ntz, password_ok boolean")
    out, _ = lk.login_lockout(att, sellers)
    got = {(r.account_id, r.outcome) for r in out.collect()}
    assert got == {(None, "unknown"), (1, "locked_now")}
