"""Keyed table changes (DML) as pure DataFrame functions.

Plain Parquet tables have no MERGE, so each change is a function
``(base, changes, ...) -> ChangeResult(new_state, affected, rejected)``
built from joins; writing ``new_state`` to a new version folder is the
commit.  Batches are folded per key with aggregates that combine map-side
(``sum``, ``max_by``, ``min_by``), so a hot key costs one partial row per
task, never one giant group; ``fold_additive_lines`` alone shuffles the lines
themselves, so a hot key is one long task there.  Base tables are joined on their key; storing
them bucketed by that key lets Spark skip the shuffle of the big side.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.semantics import falsy_default, falsy_to_null, is_falsy, ntz_lit
from marketframe.session import checkpoint_dir

INVENTORY_KEY = ("vendedor_id", "card_id")
# inventario_id = vendedor_id * stride + card_id.  It names a row within one
# seller; rows are always matched on the id and the seller together.
INVENTORY_ID_STRIDE = 1_000_000_000
DEFAULT_CONDITION = "Near Mint"
DEFAULT_LANGUAGE = "Inglés"
INVENTORY_COLUMNS = ("inventario_id", "vendedor_id", "card_id", "cantidad", "precio",
                     "condicion", "idioma", "edicion", "notas", "created_at", "updated_at")


class ChangeResult(NamedTuple):
    new_state: DataFrame
    affected: DataFrame
    rejected: DataFrame | None = None


def _ts(now) -> Column:
    if isinstance(now, Column):
        return now
    if now is None:
        return F.localtimestamp()
    return ntz_lit(now)


def _last_non_null(c: str, seq: str = "seq") -> Column:
    """Value of ``c`` on the latest line (by ``seq``) where it is not NULL."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq)))


def check_unique(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D2 report: keys that occur more than once in one batch.  An upsert of
    such a batch is an error in the source database ("cannot affect a row a
    second time"); callers raise when this is not empty."""
    return (batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
                 .where(F.col("occurrences") > 1))


def assert_unique(batch: DataFrame, keys: Sequence[str]) -> None:
    if not check_unique(batch, keys).isEmpty():
        raise ValueError(f"batch has duplicate keys on {list(keys)}")


# ---- generic upserts ----------------------------------------------------------
def _keyed_merge(base: DataFrame, batch: DataFrame, keys: Sequence[str], pick):
    """Combine ``base`` and a batch that is unique on ``keys``.

    ``pick(column, in_b, in_n)`` returns the merged value of ``column`` given
    the ``_b_*`` / ``_n_*`` inputs and the presence flags.  Returns the merged
    rows with booleans ``_touched`` (key in the batch) and ``_matched`` (key
    in both).  Stored rows take an equi left join to the batch and new keys an
    anti join to the stored keys, so Spark may choose either join from the
    bytes it measures; the plan here is the same at every size."""
    cols = base.columns
    # both joins read one materialised copy of the batch
    checkpoint_dir(batch.sparkSession)
    batch = batch.checkpoint()
    b = base.select(*[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(True).alias("_in_b"))
    n = batch.select(*[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_in_n"))
    cond = [F.col(f"_b_{k}") == F.col(f"_n_{k}") for k in keys]
    in_b, in_n = F.col("_in_b").isNotNull(), F.col("_in_n").isNotNull()
    out = [pick(c, in_b, in_n).alias(c) for c in cols] + [
        in_n.alias("_touched"), (in_b & in_n).alias("_matched")]
    old = b.join(n, cond, "left")
    fresh = n.join(b.select(*[f"_b_{k}" for k in keys]), cond, "left_anti").select(
        *[F.lit(None).cast(base.schema[c].dataType).alias(f"_b_{c}") for c in cols],
        F.lit(None).cast("boolean").alias("_in_b"), *n.columns)
    return old.select(*out).unionByName(fresh.select(*out))


def upsert_columns(base: DataFrame, batch: DataFrame, keys: Sequence[str],
                   update_columns: Sequence[str]) -> ChangeResult:
    """``INSERT ... ON CONFLICT (keys) DO UPDATE SET c = EXCLUDED.c``
    for the listed columns only; other columns of a matched row keep the
    stored value, NULLs in the batch overwrite.  The batch must be unique on
    ``keys`` (see ``check_unique``)."""
    keys = list(keys)

    def pick(c, in_b, in_n):
        bc, nc = F.col(f"_b_{c}"), F.col(f"_n_{c}")
        if c in keys:
            return F.coalesce(bc, nc)
        if c in update_columns:
            return F.when(in_n, nc).otherwise(bc)
        return F.when(in_b, bc).otherwise(nc)

    merged = _keyed_merge(base, batch, keys, pick)
    new_state = merged.select(*base.columns)
    affected = merged.where("_touched").select(*base.columns,
                                               F.col("_matched").alias("was_update"))
    return ChangeResult(new_state, affected)


def insert_ignore(base: DataFrame, batch: DataFrame, keys: Sequence[str],
                  seq: str | None = None) -> ChangeResult:
    """``ON CONFLICT (keys) DO NOTHING``: the first row per key of
    the batch (by ``seq``; without one the least row, so the choice does not
    depend on partitioning), and only for keys not stored yet."""
    keys = list(keys)
    rest = [c for c in base.columns if c not in keys]
    order = F.col(seq) if seq else F.struct(*rest) if rest else None
    if rest:
        one = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(
            *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in base.columns])
    else:
        one = batch.select(*base.columns).distinct()
    fresh = one.join(base.select(*keys), keys, "left_anti").select(*base.columns)
    return ChangeResult(base.unionByName(fresh), fresh)


def replace_children(base: DataFrame, parent_ids: DataFrame, new_rows: DataFrame,
                     key: str = "card_id") -> ChangeResult:
    """Delete every child row of the batch's parents, then insert the new
    children (``DELETE ... WHERE key = ANY(ids)`` + ``INSERT``)."""
    ids = parent_ids.select(F.col(parent_ids.columns[0]).alias(key)).distinct()
    kept = base.join(ids, key, "left_anti")
    return ChangeResult(kept.unionByName(new_rows.select(*base.columns)), new_rows)


def append_rows(base: DataFrame, rows: DataFrame) -> ChangeResult:
    """Plain ``INSERT`` without a conflict rule."""
    return ChangeResult(base.unionByName(rows.select(*base.columns)), rows)


def coalesce_update(base: DataFrame, changes: DataFrame, keys: Sequence[str],
                    columns: Sequence[str], seq: str | None = None,
                    touch: dict[str, object] | None = None) -> ChangeResult:
    """``UPDATE t SET c = COALESCE(new.c, c) WHERE key = new.key``.

    NULL keeps the stored value; ``''`` and 0 replace it.  Several changes to
    one key apply in ``seq`` order (each column takes the last non-NULL;
    without a ``seq`` the greatest), so a stored row is never multiplied.
    ``touch`` sets columns of matched rows to fixed values (e.g. a time)."""
    keys = list(keys)
    changes = changes.groupBy(*keys).agg(
        *[_last_non_null(c, seq or c).alias(c) for c in columns])
    ch = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns],
                        F.lit(True).alias("_hit"))
    j = base.join(ch, keys, "left")
    out = []
    for c in base.columns:
        if c in columns:
            out.append(F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c))
        elif touch and c in touch:
            out.append(F.when(F.col("_hit").isNotNull(), _ts(touch[c]) if isinstance(
                touch[c], _dt.datetime) else F.lit(touch[c])).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    state = j.select(*out, F.col("_hit").isNotNull().alias("_hit"))
    return ChangeResult(state.select(*base.columns), state.where("_hit").select(*base.columns))


def guarded_update(base: DataFrame, changes: DataFrame, id_col: str, owner_col: str,
                   columns: Sequence[str], seq: str | None = None) -> ChangeResult:
    """Apply a coalesce-update only where the row with ``id_col``
    belongs to ``owner_col``; other change rows are returned as rejected.
    Rows are matched on the id *and* the owner, so a change never reaches
    another owner's row; several changes to one row apply in ``seq`` order."""
    keys = [id_col, owner_col]
    res = coalesce_update(base, changes, keys, columns, seq)
    rejected = changes.join(base.select(*keys), keys, "left_anti")
    return ChangeResult(res.new_state, res.affected, rejected)


def guarded_delete(base: DataFrame, deletes: DataFrame, id_col: str,
                   owner_col: str) -> ChangeResult:
    """``DELETE ... WHERE id = $1 AND owner = $2 RETURNING *``."""
    k = deletes.select(id_col, owner_col)
    return ChangeResult(base.join(k, [id_col, owner_col], "left_anti"),
                        base.join(k, [id_col, owner_col], "left_semi"),
                        k.join(base.select(id_col, owner_col), [id_col, owner_col], "left_anti"))


def set_columns(base: DataFrame, changes: DataFrame, keys: Sequence[str],
                columns: Sequence[str], seq: str | None = None) -> ChangeResult:
    """``UPDATE t SET c = new.c WHERE keys match`` on every matching
    row; NULL overwrites.  Of several changes to one key the last by ``seq``
    holds (without one the greatest row)."""
    keys = list(keys)
    row = F.struct(*columns)
    last = changes.groupBy(*keys).agg(F.max_by(row, F.col(seq) if seq else row).alias("_row"))
    ch = last.select(*keys, *[F.col("_row")[c].alias(f"_n_{c}") for c in columns],
                     F.lit(True).alias("_hit"))
    j = base.join(ch, keys, "left")
    out = [F.when(F.col("_hit").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
           if c in columns else F.col(c) for c in base.columns]
    state = j.select(*out, F.col("_hit").isNotNull().alias("_hit"))
    return ChangeResult(state.select(*base.columns), state.where("_hit").select(*base.columns))


def touch_rows(base: DataFrame, keys_df: DataFrame, key: str, column: str = "updated_at",
               now=None) -> ChangeResult:
    """``UPDATE t SET column = CURRENT_TIMESTAMP WHERE key = ...`` with the
    time as a parameter."""
    ks = keys_df.select(F.col(keys_df.columns[0]).alias(key)).distinct() \
                .withColumn("_hit", F.lit(True))
    j = base.join(ks, key, "left")
    out = [F.when(F.col("_hit").isNotNull(), _ts(now)).otherwise(F.col(c)).alias(c)
           if c == column else F.col(c) for c in base.columns]
    state = j.select(*out, F.col("_hit").isNotNull().alias("_hit"))
    return ChangeResult(state.select(*base.columns), state.where("_hit").select(*base.columns))


# ---- inventory upserts ---------------------------------------------------------
def _with_add_defaults(lines: DataFrame) -> DataFrame:
    """Request defaults of the add routes, applied before any conflict:
    ``cantidad || 1``, ``precio || null``, ``condicion || 'Near Mint'``,
    ``idioma || 'Inglés'``, ``edicion || null``, ``notas || null``."""
    return lines.withColumns({
        "cantidad": falsy_default("cantidad", 1, "number").cast("long"),
        "precio": falsy_to_null("precio", "number"),
        "condicion": falsy_default("condicion", DEFAULT_CONDITION),
        "idioma": falsy_default("idioma", DEFAULT_LANGUAGE),
        "edicion": falsy_to_null("edicion"),
        "notas": falsy_to_null("notas"),
    })


def inventory_id(v: Column, c: Column) -> Column:
    return v * F.lit(INVENTORY_ID_STRIDE) + c


def fold_additive_lines(lines: DataFrame, time_col: str | None = None, now=None, dealt: bool = False) -> DataFrame:
    """D4 fold of a batch of add requests into one row per key, equal to
    applying them one by one in ``seq`` order to an empty table: quantities
    add up; ``precio``, ``edicion``, ``notas`` keep the last non-NULL value;
    ``condicion`` / ``idioma`` take the last line (defaults already applied).
    Each request is stamped with ``time_col`` when given, else with ``now``.

    The lines themselves are shuffled, each with its (wide) arrival order once;
    partial rows would hold it once a buffer, five times a line.  A key's lines
    are sorted by key, with spilling, and folded one by one.  Rows come out
    dealt by id and seller, so joins on both move them no further.  ``dealt``:
    the lines come so already, with ``inventario_id``, made from narrower rows
    after the shuffle."""
    d = _with_add_defaults(lines)
    t = F.col(time_col) if time_col else _ts(now)
    d = d.withColumn("_t", t)
    if not dealt:
        d = d.withColumn("inventario_id", inventory_id(F.col("vendedor_id"), F.col("card_id")))
        d = d.repartition("inventario_id", "vendedor_id")
    # Values of the last line travel in one struct so that the arrival order is
    # held by as few aggregation buffers as possible.
    last = F.max(F.struct(F.col("seq").alias("s"), F.col("condicion").alias("condicion"),
                          F.col("idioma").alias("idioma"), F.col("_t").alias("t")))
    g = d.groupBy("inventario_id", *INVENTORY_KEY).agg(
        F.sum("cantidad").alias("cantidad"),
        _last_non_null("precio").alias("precio"),
        _last_non_null("edicion").alias("edicion"),
        _last_non_null("notas").alias("notas"),
        F.min_by("_t", "seq").alias("created_at"),
        last.alias("_last"),
    )
    return g.select("inventario_id", "vendedor_id", "card_id", "cantidad", "precio",
                    F.col("_last.condicion").alias("condicion"),
                    F.col("_last.idioma").alias("idioma"), "edicion", "notas", "created_at",
                    F.col("_last.t").alias("updated_at"))


def valid_lines(lines: DataFrame, cards: DataFrame | None = None):
    """Lines without a card id are skipped; when ``cards`` is given
    (single-add route) lines naming an unknown card are rejected too."""
    no_key = is_falsy("card_id", "number")
    ok = lines.where(~no_key)
    rejected = lines.where(no_key).withColumn("reason", F.lit("missing card_id"))
    if cards is not None:
        known = cards.select(F.col("id").alias("card_id"))
        rejected = rejected.unionByName(
            ok.join(known, "card_id", "left_anti").withColumn("reason", F.lit("unknown card")))
        ok = ok.join(known, "card_id", "left_semi")
    return ok, rejected


def upsert_additive(base: DataFrame, lines: DataFrame, now=None,
                    cards: DataFrame | None = None) -> ChangeResult:
    """Single-add upsert applied for a whole batch of requests.

    On a stored key: ``cantidad = old + new`` (NULL stays NULL), ``precio``,
    ``edicion``, ``notas`` = ``COALESCE(new, old)``, ``condicion`` /
    ``idioma`` = the request's (defaults applied first, so they overwrite),
    ``updated_at = now``.  New keys are inserted with ``created_at = now``."""
    ok, rejected = valid_lines(lines, cards)
    n = fold_additive_lines(ok, now=now)
    res = _merge_inventory(base, n, now, additive_only=False)
    return ChangeResult(res.new_state, res.affected, rejected)


def explode_bulk_requests(requests: DataFrame, items: str = "cartas"):
    """bulk requests ``(seq, vendedor_id, cartas array<struct>)`` to
    change lines.  A request whose array is missing or empty is an error of
    the whole request (rejected); the lines of the others keep the arrival
    order ``(request seq, position)``.  ``posexplode`` is a generator, so no
    request array is ever regrouped.  Returns ``(lines, rejected)``."""
    has_items = F.coalesce(F.size(F.col(items)) > 0, F.lit(False))
    rejected = requests.where(~has_items).select("seq", "vendedor_id",
                                                 F.lit("empty or missing array").alias("reason"))
    exploded = requests.where(has_items).select(
        F.col("seq").alias("_req"), "vendedor_id", F.posexplode(items).alias("_pos", "_item"))
    lines = exploded.select(F.struct("_req", "_pos").alias("seq"), "vendedor_id", "_item.*")
    return lines, rejected


def fold_bulk_lines(lines: DataFrame, now=None) -> DataFrame:
    """D5 fold: quantities add up; all other columns come from the first line
    of the key (they only matter when the key is new)."""
    d = _with_add_defaults(lines)
    first = F.min_by(F.struct("precio", "condicion", "idioma", "edicion", "notas"), F.col("seq"))
    g = d.groupBy(*INVENTORY_KEY).agg(F.sum("cantidad").alias("cantidad"), first.alias("_f"))
    t = _ts(now)
    return g.select(inventory_id(F.col("vendedor_id"), F.col("card_id")).alias("inventario_id"),
                    "vendedor_id", "card_id", "cantidad", "_f.precio", "_f.condicion",
                    "_f.idioma", "_f.edicion", "_f.notas", t.alias("created_at"),
                    t.alias("updated_at"))


def bulk_upsert(base: DataFrame, lines: DataFrame, now=None) -> ChangeResult:
    """Bulk add.  On a stored key only ``cantidad`` (added) and
    ``updated_at`` change; lines without a card id are skipped; no check that
    the card exists."""
    ok, rejected = valid_lines(lines, None)
    res = merge_bulk(base, fold_bulk_lines(ok, now=now), now)
    return ChangeResult(res.new_state, res.affected, rejected)


def merge_bulk(base: DataFrame, folded: DataFrame, now=None) -> ChangeResult:
    """D5 for lines folded to one row a key (``fold_bulk_lines``)."""
    return _merge_inventory(base, folded, now, additive_only=True)


def _merge_inventory(base: DataFrame, folded: DataFrame, now, additive_only: bool) -> ChangeResult:
    cols = INVENTORY_COLUMNS

    def pick(c: str, in_b: Column, in_n: Column) -> Column:
        bc, nc = F.col(f"_b_{c}"), F.col(f"_n_{c}")
        if c in ("inventario_id", "vendedor_id", "card_id", "created_at"):
            return F.coalesce(bc, nc)
        if c == "cantidad":
            return F.when(in_b & in_n, bc + nc).when(in_b, bc).otherwise(nc)
        if c == "updated_at":
            return F.when(in_n, _ts(now)).otherwise(bc)
        if additive_only or c not in ("precio", "condicion", "idioma", "edicion", "notas"):
            return F.when(in_b, bc).otherwise(nc)
        return F.when(in_n, F.coalesce(nc, bc)).otherwise(bc)

    state = _keyed_merge(base.select(*cols), folded.select(*cols), INVENTORY_KEY, pick)
    return ChangeResult(state.select(*cols), state.where("_touched").select(*cols))


def bulk_running_quantities(base: DataFrame, lines: DataFrame) -> DataFrame:
    """The row returned for each bulk line, in arrival order: the key's
    quantity right after that line (stored quantity, NULL staying NULL, plus
    the running sum of the batch).  Prefix sums are skew-safe (see
    ``marketframe.operators.ordered``)."""
    from marketframe.operators.ordered import running_totals
    ok, _ = valid_lines(lines, None)
    d = _with_add_defaults(ok).select("seq", *INVENTORY_KEY, "cantidad")
    r = running_totals(d, INVENTORY_KEY, ["seq"], sums={"running": "cantidad"},
                       rank_name="line_no")
    stored = base.select(*INVENTORY_KEY, F.col("cantidad").alias("_stored"),
                         F.lit(True).alias("_in_b"))
    j = r.join(stored, list(INVENTORY_KEY), "left")
    qty = F.when(F.col("_in_b").isNotNull(), F.col("_stored") + F.col("running")) \
           .otherwise(F.col("running"))
    return j.select(*INVENTORY_KEY, "line_no", F.col("cantidad").alias("added"),
                    qty.alias("cantidad"))
