"""Tournament rules as set operations: scans, per-tournament counts,
capacity-limited admission in arrival order, derived-count refresh and
result updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.functions.semantics import parse_int
from marketframe.operators.changes import ChangeResult, set_columns
from marketframe.operators.ordered import running_totals


def player_counts(players: DataFrame) -> DataFrame:
    """A3: ``COUNT(*) ... WHERE idtournament = $1`` for every tournament."""
    return players.groupBy("idtournament").agg(F.count(F.lit(1)).alias("participants"))


def admit_players(tournaments: DataFrame, players: DataFrame, joins: DataFrame) -> DataFrame:
    """Outcome of each join request (``ok`` / ``full`` / ``not_found``)
    as a one-by-one replay in ``seq`` order would give it.

    Request 1 of a tournament passes iff the stored ``participants`` (NULL
    acts as 0) is below ``parseInt(maxPlayers)`` (NaN: no limit).  Each pass
    stores the real row count, so request k >= 2 passes iff request 1 passed
    and ``count + (k - 1) < max``.  Arrival numbers come from skew-safe
    prefix counts, so a tournament with a third of all requests is still
    split across tasks."""
    t = tournaments.select(F.col("id").alias("idtournament"),
                           F.coalesce("participants", F.lit(0)).alias("_p"),
                           parse_int("maxPlayers").alias("_max"))
    c = player_counts(players).withColumnRenamed("participants", "_count")
    numbered = running_totals(joins, ["idtournament"], ["seq"], rank_name="_k")
    j = numbered.join(t, "idtournament", "left").join(c, "idtournament", "left")
    count0 = F.coalesce("_count", F.lit(0))
    first_ok = F.col("_max").isNull() | (F.col("_p") < F.col("_max"))
    later_ok = F.col("_max").isNull() | (count0 + F.col("_k") - 1 < F.col("_max"))
    ok = F.when(F.col("_k") == 1, first_ok).otherwise(first_ok & later_ok)
    outcome = (F.when(F.col("_p").isNull(), "not_found")
                .when(ok, "ok").otherwise("full"))
    return j.select("seq", "idtournament", "konamiid", "name", outcome.alias("outcome"))


def apply_admissions(tournaments: DataFrame, players: DataFrame, outcomes: DataFrame):
    """S5 + D13: append admitted players and refresh ``participants`` to the
    real count for every tournament that admitted someone (others keep the
    stored value).  Returns ``(new_tournaments, new_players)``."""
    new_rows = outcomes.where(F.col("outcome") == "ok").select(
        "name", "konamiid", "idtournament", F.lit(None).cast("int").alias("victory"),
        F.lit(None).cast("int").alias("defeat"), F.lit(None).cast("int").alias("draw"))
    new_players = players.unionByName(new_rows)
    touched = new_rows.select("idtournament").distinct()
    counts = player_counts(new_players.join(touched, "idtournament", "left_semi"))
    refreshed = refresh_counts(tournaments, counts)
    return refreshed, new_players


def refresh_counts(tournaments: DataFrame, counts: DataFrame) -> DataFrame:
    """``SET participants = COUNT(*)`` for the tournaments in ``counts``."""
    c = counts.select(F.col("idtournament").alias("id"),
                      F.col("participants").cast("int").alias("_n"))
    j = tournaments.join(c, "id", "left")
    return j.select(*[F.coalesce("_n", "participants").alias("participants")
                      if col == "participants" else F.col(col) for col in tournaments.columns])


def set_results(players: DataFrame, results: DataFrame) -> ChangeResult:
    """``SET victory, defeat, draw WHERE konamiid AND idtournament`` on
    every matching row (NULL overwrites)."""
    return set_columns(players, results, ["konamiid", "idtournament"],
                       ["victory", "defeat", "draw"])
