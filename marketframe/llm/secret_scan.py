"""Secret scan with corpus-wide ownership: DataFrame functions only.

Base findings are matches of three fixed patterns (leftmost, not overlapping,
within each kind), kept when long enough.  Spans are code points: the text
between matches (``split``) and the matches themselves (``regexp_extract_all``)
come in turn, so running lengths are the places.

The method then asks who holds a value.  Candidates are the values of the base
findings and long tokens that mix capitals, small letters and digits.  Their
hashes are aggregated over the whole corpus by distinct owners and distinct
repositories (distinct rows first, so a value copied a million times is one
row for each task and repository).  A value that many owners hold is a copied
example; one that a single owner holds and that looks random is a live
credential.  Tokens found live this way are added as spans of kind ``owned``
unless they overlap a base finding; base findings stay, with counts of those
that are live and of those that are examples.

Owners and repositories are column expressions: here an owner is a
``source`` and a repository one source's texts of one language.

Defined results: null and empty texts have no findings; rows that repeat a
doc_id are reported each; null owners count as one owner; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import materialise

# The base patterns with the least length of what they keep.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Runs are taken whole, so a least length in the pattern keeps the same runs.
ACCESS = rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"
HEX = rf"[0-9a-f]{{{HEX_LEAST},}}"
ASSIGN_LIKELY = ASSIGN[:-2] + f"{{{ASSIGN_LEAST},}})"
#: Candidates besides the base findings.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value is an example from so many owners on.
EXAMPLE_OWNERS = 3

_SPANS = "array<struct<start:long,kind:int,end:long,value:string>>"


def _found(text: Column, likely: str, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of a pattern's matches whose ``group`` has ``least`` characters;
    texts without a likely match are not taken apart."""
    def step(acc, m):
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value"))
        spans = F.when(F.length(m["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(hits.alias("hit"), values.alias("value"),
                        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))
    return F.when(text.rlike(likely), F.aggregate(rows, zero, step)["spans"]).otherwise(F.array().cast(_SPANS))


def _live_looking(value: Column) -> Column:
    """Letters and digits, no long run of one character, no placeholder."""
    return (value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(r"(.)\1{5}")
            & ~value.rlike("(?i)example|sample|dummy|placeholder|changeme|your|test"))


def _random_looking(value: Column) -> Column:
    """Live-looking with capitals and small letters."""
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & _live_looking(value)


def _text_of(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(
        F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"),
        s["end"].cast("string"))), ",")


def scan(documents: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, base (spans with values,
    live, example), owned (added spans)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_found(text, ASSIGN_LIKELY, ASSIGN, 0, 2, ASSIGN_LEAST), _found(text, "AKIA", ACCESS, 1, 0, ACCESS_LEAST),
                    _found(text, HEX, HEX, 2, 0, HEX_LEAST))
    tokens = F.filter(_found(text, TOKEN, TOKEN, 3, 0, 20), lambda s: _random_looking(s["value"]))
    # one materialised pass over the texts; what follows moves spans only
    rows = materialise(documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.xxhash64(owner).alias("owner"), F.xxhash64(repository).alias("repository"),
        base.alias("base"), tokens.alias("tokens")))
    spans = rows.where("size(base) + size(tokens) > 0").select(
        "row", "owner", "repository", F.explode(F.concat("base", "tokens")).alias("span"))
    spans = spans.withColumn("value", F.sha2("span.value", 256))
    held = (spans.select("value", "owner", "repository").distinct().groupBy("value", "owner")
            .agg(F.count("*").alias("n")).groupBy("value")
            .agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")))
    judged = spans.join(held, "value").select(
        "row", "span", "owners", "repositories", (F.col("owners") >= EXAMPLE_OWNERS).alias("example"),
        ((F.col("owners") == 1) & _live_looking(F.col("span.value"))).alias("live"))
    per_row = judged.groupBy("row").agg(
        F.sum(F.when((F.col("span.kind") < 3) & F.col("live"), 1)).alias("n_live"),
        F.sum(F.when((F.col("span.kind") < 3) & F.col("example"), 1)).alias("n_example"),
        F.collect_list(F.when((F.col("span.kind") == 3) & F.col("live"), F.col("span"))).alias("owned"))
    added = F.filter(F.coalesce("owned", F.array().cast(_SPANS)), lambda s: ~F.exists(
        "base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    zero = F.lit(0).cast("long")
    return rows.join(per_row, "row", "left").select(
        "doc_id", "base", added.alias("owned"), F.coalesce("n_live", zero).alias("n_live"),
        F.coalesce("n_example", zero).alias("n_example"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, digest of the base spans and all spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.concat("base", "owned")).alias("spans"), "n_live", "n_example")
