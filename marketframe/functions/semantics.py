"""Column expressions that reproduce the marketplace's value semantics with
built-in Spark functions only (JVM-side, inside whole-stage codegen).

* NULL ordering of the source database: ascending puts NULLs last,
  descending puts them first (Spark's default is the reverse).
* ``ILIKE`` with a backslash escape and ``%x%`` pattern building.
* JavaScript coercions: ``parseFloat``, ``parseInt``, ``x || null``,
  ``x || default`` and ``x ?? null``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketframe.schemas import MONEY

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- ordering ---------------------------------------------------------------
def pg_asc(c: ColumnOrName) -> Column:
    """``ORDER BY c ASC`` as the source database does it (NULLs last)."""
    return _c(c).asc_nulls_last()


def pg_desc(c: ColumnOrName) -> Column:
    """``ORDER BY c DESC`` as the source database does it (NULLs first)."""
    return _c(c).desc_nulls_first()


# ---- pattern matching -------------------------------------------------------
_ESCAPE_PAIR = re.compile(r"\\(.)", re.DOTALL)


def normalize_like_text(text: str) -> str:
    """The database reads ``\\c`` as a literal ``c`` for any character; Spark
    only accepts a backslash before ``%``, ``_`` or another backslash.  Escape
    pairs are read left to right, so ``\\\\`` stays one escaped backslash."""
    return _ESCAPE_PAIR.sub(lambda m: m.group(0) if m.group(1) in "%_\\" else m.group(1), text)


def escape_like_text(text: str) -> str:
    """Escape ``%``, ``_`` and ``\\`` so that the text matches literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_pattern(text: str, literal: bool = False) -> str:
    """``'%' || text || '%'``.  By default the user's ``%`` and ``_`` stay
    wildcards, exactly as with the unescaped parameter of the original."""
    body = escape_like_text(text) if literal else normalize_like_text(text)
    return f"%{body}%"


def ilike_contains(c: ColumnOrName, text: str, literal: bool = False) -> Column:
    """Case-insensitive *contains* (``c ILIKE '%text%'``).  NULL stays NULL, so
    the row falls out of a filter, as in three-valued logic."""
    return _c(c).ilike(contains_pattern(text, literal))


def require_text(text: str | None, name: str = "name") -> str:
    """Parameter check ``!x || x.trim() === ''`` -> error.  The untrimmed text
    is what gets searched."""
    if text is None or text.strip() == "":
        raise ValueError(f"parameter {name!r} is required")
    return text


# ---- JavaScript coercions ---------------------------------------------------
# Longest decimal-literal prefix after leading blanks, as ``parseFloat`` reads it.
FLOAT_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
# Optional sign and digits after leading blanks, as ``parseInt(x, 10)`` reads it.
INT_PREFIX = r"^\s*([+-]?\d+)"


def parse_float(c: ColumnOrName) -> Column:
    """``parseFloat(x)``: double or NULL (JavaScript NaN) when there is no
    numeric prefix.  ``'12.5abc'`` -> 12.5, ``'1,234'`` -> 1."""
    text = F.regexp_extract(_c(c), FLOAT_PREFIX, 1)
    return F.when(text != "", text.try_cast("double"))


def parse_float_or_zero(c: ColumnOrName) -> Column:
    """``parseFloat(x) || 0`` stored as a money decimal (overflow -> NULL)."""
    return F.coalesce(parse_float(c), F.lit(0.0)).try_cast(MONEY)


def parse_int(c: ColumnOrName) -> Column:
    """``parseInt(x, 10)``: long or NULL (NaN); ``'12.5'`` -> 12, ``'1e3'`` -> 1."""
    text = F.regexp_extract(_c(c), INT_PREFIX, 1)
    return F.when(text != "", text.try_cast("long"))


def parse_float_param(value) -> float:
    """Python-side ``parseFloat`` for a request parameter (NaN when unparsable)."""
    if value is None:
        return float("nan")
    if isinstance(value, (int, float)):
        return float(value)
    m = re.match(FLOAT_PREFIX, str(value))
    return float(m.group(1)) if m else float("nan")


def parse_int_param(value) -> int | None:
    """Python-side ``parseInt(x, 10)``; ``None`` stands for NaN."""
    if value is None:
        return None
    if isinstance(value, int):
        return value
    m = re.match(INT_PREFIX, str(value))
    return int(m.group(1)) if m else None


def falsy_to_null(c: ColumnOrName, kind: str = "string") -> Column:
    """``x || null``: missing, ``''`` (strings) or 0 (numbers) become NULL."""
    col = _c(c)
    if kind == "string":
        return F.nullif(col, F.lit(""))
    return F.when(col != 0, col)


def falsy_default(c: ColumnOrName, default, kind: str = "string") -> Column:
    """``x || default``: missing, ``''`` or 0 take the default."""
    return F.coalesce(falsy_to_null(c, kind), F.lit(default))


def is_falsy(c: ColumnOrName, kind: str = "string") -> Column:
    """``!x`` for a text or number column (never NULL)."""
    return falsy_to_null(c, kind).isNull()


def is_blank(c: ColumnOrName) -> Column:
    """``!x || x.trim() === ''`` on a column."""
    col = _c(c)
    return col.isNull() | col.rlike(r"^\s*$")


def money_text(c: ColumnOrName) -> Column:
    """``decimal.toString()``: the exact decimal text."""
    return _c(c).cast("string")


# ---- time ---------------------------------------------------------------------
def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal built from text, so no time zone (of the
    session or of the Python process) can shift it."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def micros_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``end - start`` in microseconds on wall-clock (NTZ) timestamps; no
    session time zone or daylight-saving shift is involved."""
    s, e = _c(start), _c(end)
    return F.timestamp_diff("MICROSECOND", s, e)


def minutes_left(now: ColumnOrName, until: ColumnOrName) -> Column:
    """``Math.ceil((until - now) / 60000)`` minutes, rounded up."""
    return F.ceil(micros_between(now, until) / 60_000_000).cast("long")


def ntz_instant(c: ColumnOrName) -> Column:
    """A TIMESTAMP whose epoch equals the NTZ wall time read as UTC, for
    event-time watermarks, independent of the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(micros_between(epoch, c))

