"""Contribution of clubs and leagues, and composite indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .joins import active_people, keyed

# Weights of the impact index.
IMPACT_WEIGHTS = {"players_sent": 0.2, "teams_represented": 0.2, "total_minutes": 0.35, "goal_contributions": 0.25}
PENDING_LEAGUE = "League pending review"


def impact(links: DataFrame, entries: DataFrame, clubs: DataFrame, stats: DataFrame, kind: str = "club",
           meaningful_minutes: int = 180, weights: dict[str, float] = IMPACT_WEIGHTS, order_by: Sequence[str] | None = None,
           unique: bool = False) -> DataFrame:
    """Per club or league: players, teams, minutes, goals, assists, players over the threshold, index.

    Every link counts; repeated clubs and stat rows resolve to their last row by ``order_by``; ``unique`` declares that none repeats. A club that is not in the table is
    labelled by its name at the source, where links have ``club_name_at_source``.
    Rows reduce to (club, team) before they meet the club table, so the size of a club does not
    matter for the join.
    """
    clubs, stats = keyed(clubs, "club_id", order_by, ["club_name", "league"], unique), keyed(stats, "player_id", order_by, ["minutes_played", "goals", "assists"], unique)
    at_source = F.col("club_name_at_source") if "club_name_at_source" in links.columns else F.lit(None).cast("string")
    goals, assists = F.coalesce("goals", F.lit(0)), F.coalesce("assists", F.lit(0))
    minutes = F.coalesce("minutes_played", F.lit(0))
    per_club_team = (
        active_people(links.select("player_id", "club_id", "team", at_source.alias("_at_source")), entries)
        .join(stats.select("player_id", "minutes_played", "goals", "assists"), "player_id", "left")
        .groupBy("club_id", "team")
        .agg(
            F.count(F.lit(1)).alias("players_sent"),
            F.sum(minutes).alias("total_minutes"),
            F.sum(goals).alias("goals"),
            F.sum(assists).alias("assists"),
            F.count_if(minutes >= meaningful_minutes).alias("meaningful_minutes_players"),
            F.min("_at_source").alias("_at_source"),
        )
        .join(clubs.select("club_id", "club_name", "league"), "club_id", "left")
    )
    if kind == "club":
        key = F.col("club_id").cast("string")
        per_club_team = per_club_team.join(per_club_team.groupBy("club_id").agg(F.min("_at_source").alias("_named")), "club_id", "left") if "club_name_at_source" in links.columns else per_club_team.withColumn("_named", F.lit(None).cast("string"))
        label = F.coalesce("club_name", "_named", key)
    else:
        key = label = F.coalesce("league", F.lit(PENDING_LEAGUE))
    rows = per_club_team.groupBy(key.alias("key"), label.alias("label")).agg(
        *[F.sum(c).alias(c) for c in ("players_sent", "total_minutes", "goals", "assists", "meaningful_minutes_players")],
        F.count_distinct("team").alias("teams_represented"),
    ).withColumn("goal_contributions", F.col("goals") + F.col("assists"))
    return weighted_index(rows, weights, "impact_index").orderBy(F.desc("players_sent"), F.collate("label", "UNICODE"))


def weighted_index(df: DataFrame, weights: dict[str, float], out: str, scale: float = 100.0) -> DataFrame:
    """``scale`` · Σ weight · x / max(x), the maximum floored at 1.

    The maxima are one scalar subquery; a window over the whole frame would put every row into one task.
    """
    tops = df.agg(F.struct(*[F.greatest(F.max(F.col(c).cast("double")), F.lit(1.0)).alias(c) for c in weights]).alias("m")).scalar()
    score: Column = F.lit(0.0)
    for c, w in weights.items():
        score = score + F.lit(w) * F.col(c) / F.col("_tops")[c]
    return df.withColumn("_tops", tops).withColumn(out, scale * score).drop("_tops")


def top_metric(df: DataFrame, metric: str, label: str, n: int) -> DataFrame:
    """Top-k report by a chosen metric; ties by label."""
    return df.orderBy(F.desc(metric), F.collate(label, "UNICODE"), label).limit(n)
