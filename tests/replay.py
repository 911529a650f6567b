"""Plain-Python one-request-at-a-time replays of the marketplace rules.
They are the brute-force references the set-based Spark jobs are checked
against on small fixtures."""

from __future__ import annotations

import datetime as dt
import math
import re

DEFAULT_CONDITION, DEFAULT_LANGUAGE = "Near Mint", "Inglés"


def falsy(v):
    return v is None or v == "" or v == 0


def add_defaults(line):
    return {
        "cantidad": 1 if falsy(line.get("cantidad")) else line["cantidad"],
        "precio": None if falsy(line.get("precio")) else line["precio"],
        "condicion": DEFAULT_CONDITION if falsy(line.get("condicion")) else line["condicion"],
        "idioma": DEFAULT_LANGUAGE if falsy(line.get("idioma")) else line["idioma"],
        "edicion": None if falsy(line.get("edicion")) else line["edicion"],
        "notas": None if falsy(line.get("notas")) else line["notas"],
    }


def single_add(table, lines, now):
    """Each line is one add request (already in arrival order)."""
    for ln in lines:
        if falsy(ln.get("card_id")):
            continue
        key = (ln["vendedor_id"], ln["card_id"])
        r = add_defaults(ln)
        if key in table:
            row = table[key]
            row["cantidad"] = None if row["cantidad"] is None else row["cantidad"] + r["cantidad"]
            for c in ("precio", "condicion", "idioma", "edicion", "notas"):
                if r[c] is not None:
                    row[c] = r[c]
            row["updated_at"] = now
        else:
            table[key] = dict(r, created_at=now, updated_at=now)
    return table


def bulk_add(table, lines, now):
    """On conflict only the quantity (added) and updated_at change.
    Returns the running row after each processed line."""
    returned = []
    for ln in lines:
        if falsy(ln.get("card_id")):
            continue
        key = (ln["vendedor_id"], ln["card_id"])
        r = add_defaults(ln)
        if key in table:
            row = table[key]
            row["cantidad"] = None if row["cantidad"] is None else row["cantidad"] + r["cantidad"]
            row["updated_at"] = now
        else:
            table[key] = dict(r, created_at=now, updated_at=now)
        returned.append((key, table[key]["cantidad"]))
    return table, returned


def register(existing, requests, keys):
    """Requests in order; refused when any key equals a key of a stored or
    earlier accepted row (NULL never matches)."""
    seen = {k: set() for k in keys}
    for row in existing:
        for k in keys:
            if row[k] is not None:
                seen[k].add(row[k])
    accepted = []
    for req in requests:
        if any(req[k] is not None and req[k] in seen[k] for k in keys):
            continue
        accepted.append(req["seq"])
        for k in keys:
            if req[k] is not None:
                seen[k].add(req[k])
    return accepted


def lockout(accounts, attempts, lock, max_attempts=5):
    """``accounts`` = {id: dict(activo, n, lock)}, attempts in time order."""
    out = []
    state = {k: dict(v) for k, v in accounts.items()}
    for acc, at, ok in attempts:
        s = state.get(acc)
        if s is None:
            out.append((acc, at, "unknown"))
            continue
        if s["lock"] is not None and s["lock"] > at:
            out.append((acc, at, "locked"))
            continue
        if not s["activo"]:
            out.append((acc, at, "inactive"))
            continue
        if not ok:
            s["n"] = (s["n"] or 0) + 1
            if s["n"] >= max_attempts:
                s["lock"] = at + lock
                out.append((acc, at, "locked_now"))
            else:
                out.append((acc, at, "failed"))
            continue
        s["n"], s["lock"] = 0, None
        out.append((acc, at, "ok"))
    return out, state


def parse_int(text):
    if text is None:
        return None
    m = re.match(r"^\s*([+-]?\d+)", text)
    return int(m.group(1)) if m else None


def admission(tournaments, players, joins):
    """``tournaments`` = {id: dict(participants, maxPlayers)}; joins in order."""
    t = {k: dict(v) for k, v in tournaments.items()}
    counts = dict(players)
    out = []
    for seq, tid in joins:
        if tid not in t:
            out.append((seq, "not_found"))
            continue
        p = t[tid]["participants"] or 0
        mx = parse_int(t[tid]["maxPlayers"])
        if mx is not None and p >= mx:
            out.append((seq, "full"))
            continue
        counts[tid] = counts.get(tid, 0) + 1
        t[tid]["participants"] = counts[tid]
        out.append((seq, "ok"))
    return out, t


def ceil_minutes(delta: dt.timedelta) -> int:
    return math.ceil(delta / dt.timedelta(microseconds=1) / 60_000_000)
