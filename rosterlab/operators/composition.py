"""Who a group is made of: scorecards, totals, breakdowns, rosters, side-by-side comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.num import DAYS_PER_YEAR, age_days, age_floor, ratio
from .joins import active_only, keyed, roster


def _own_country(df: DataFrame, country: str, aliases: DataFrame | None) -> DataFrame:
    """Flag whether ``country`` is the team's own name or one of its aliases (team, alias)."""
    same = F.coalesce(F.col(country) == F.col("team"), F.lit(False))
    if aliases is None:
        return df.withColumn("_own", same)
    hit = aliases.select("team", F.col("alias").alias(country)).distinct().withColumn("_alias", F.lit(True))
    return df.join(hit, ["team", country], "left").withColumn("_own", same | F.coalesce("_alias", F.lit(False))).drop("_alias")


def composition_scorecard(teams: DataFrame, entries: DataFrame, players: DataFrame, links: DataFrame, clubs: DataFrame,
                          as_of: str, team_stats: DataFrame | None = None, aliases: DataFrame | None = None,
                          order_by: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """One row per team, every metric with its own denominator; teams without members stay.

    Repeated keys of players, links, clubs and teams resolve to their last row by ``order_by``; ``unique`` declares that none repeats.
    Players and clubs meet their dimensions in two separate reductions: person metrics by team,
    and club metrics from (team, club) counts, so a club that holds most players joins as one
    row per team rather than as its players.
    """
    teams, links = keyed(teams, "team_code", order_by, ["team"], unique), keyed(links, "player_id", order_by, ["club_id"], unique)
    players, clubs = keyed(players, "player_id", order_by, ["date_of_birth", "birth_country"], unique), keyed(clubs, "club_id", order_by, ["country", "league"], unique)
    active = active_only(entries).select("team_code", "player_id", "caps")
    day = F.to_date(F.lit(as_of))
    people = active.join(players.select("player_id", "date_of_birth", "birth_country"), "player_id", "left").join(
        teams.select("team_code", "team"), "team_code"
    )
    days = age_days(F.col("date_of_birth"), day)
    years = days / F.lit(DAYS_PER_YEAR)
    born = F.col("birth_country")
    persons = _own_country(people, "birth_country", aliases).groupBy("team_code").agg(
        F.count(F.lit(1)).alias("squad_size"),
        (F.avg(days) / DAYS_PER_YEAR).alias("average_age"),
        (F.median(days) / DAYS_PER_YEAR).alias("median_age"),
        F.count_if(years < 23).alias("under_23"),
        F.count_if(years >= 30).alias("age_30_plus"),
        F.count(days).alias("age_known"),
        F.sum(F.col("caps").cast("long")).alias("total_caps"),
        F.median("caps").alias("median_caps"),
        F.count("caps").alias("caps_known"),
        F.count_if(F.col("_own")).alias("home_born"),
        F.count(born).alias("birth_country_known"),
    )
    per_club = (
        active.join(links.select("player_id", "club_id"), "player_id")
        .groupBy("team_code", "club_id").agg(F.count(F.lit(1)).alias("n"))
        .join(clubs.select("club_id", "country", "league"), "club_id")
        .join(teams.select("team_code", "team"), "team_code")
    )
    at_clubs = _own_country(per_club, "country", aliases).groupBy("team_code").agg(
        F.sum(F.when(F.col("_own"), F.col("n")).otherwise(0)).alias("domestic"),
        F.sum(F.when(F.col("country").isNotNull(), F.col("n")).otherwise(0)).alias("club_country_known"),
        F.count("club_id").alias("clubs"),
        F.count_distinct("country").alias("club_countries"),
        F.count_distinct("league").alias("leagues"),
    )
    out = teams.select("team_code", "team").join(persons, "team_code", "left").join(at_clubs, "team_code", "left")
    counts = ["squad_size", "under_23", "age_30_plus", "age_known", "caps_known", "home_born", "birth_country_known",
              "domestic", "club_country_known", "clubs", "club_countries", "leagues"]
    out = out.fillna(0, subset=counts)
    out = out.withColumn("domestic_share", ratio(F.col("domestic"), F.col("club_country_known"))).withColumn(
        "home_born_share", ratio(F.col("home_born"), F.col("birth_country_known"))
    )
    if team_stats is not None:
        out = out.join(keyed(team_stats, "team_code", order_by, ["stage_reached"], unique), "team_code", "left").fillna(
            "Not available", subset=["stage_reached"]
        )
    return out.orderBy(F.collate("team", "UNICODE"), "team_code")


def compare_two(rows: DataFrame, key: str, a, b, metrics: Sequence[str]) -> DataFrame:
    """Metrics of two rows side by side, with the difference and the larger value for the bar scale."""
    two = rows.filter(F.col(key).isin(a, b)).select(key, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = two.unpivot([key], list(metrics), "metric", "value")
    side = lambda v: F.max(F.when(F.col(key) == F.lit(v), F.col("value")))
    out = long.groupBy("metric").agg(side(a).alias("value_a"), side(b).alias("value_b"))
    return out.withColumn("difference", F.col("value_a") - F.col("value_b")).withColumn(
        "bar_max", F.greatest(F.coalesce("value_a", F.lit(0.0)), F.coalesce("value_b", F.lit(0.0)), F.lit(1.0))
    )


def group_breakdown(entries: DataFrame, links: DataFrame, clubs: DataFrame, attribute: str = "country",
                    default: str = "Unknown", aliases: DataFrame | None = None, order_by: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """Members per club attribute for each team, the team's own country flagged, unknowns in a bucket.

    Repeated links and clubs resolve to their last row by ``order_by``, so an entry is one member; ``unique`` declares that none repeats.
    """
    per_club = (
        active_only(entries).select("team_code", "team", "player_id")
        .join(keyed(links, "player_id", order_by, ["club_id"], unique), "player_id", "left")
        .groupBy("team_code", "team", "club_id").agg(F.count(F.lit(1)).alias("n"))
        .join(keyed(clubs, "club_id", order_by, [attribute], unique), "club_id", "left")
    )
    return (
        _own_country(per_club, attribute, aliases)
        .groupBy("team_code", "team", F.coalesce(attribute, F.lit(default)).alias(attribute))
        .agg(F.sum("n").alias("members"), F.max("_own").alias("is_own"))
    )


def squad_totals(entries: DataFrame, players: DataFrame, links: DataFrame, clubs: DataFrame, stats: DataFrame, as_of: str,
                 order_by: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """Per team: clubs, club countries, caps and minutes with unknown as 0, mean age of the known.

    Repeated keys of the dimensions resolve to their last row by ``order_by``; ``unique`` declares that none repeats.
    """
    players, stats = keyed(players, "player_id", order_by, ["date_of_birth"], unique), keyed(stats, "player_id", order_by, ["minutes_played"], unique)
    links, clubs = keyed(links, "player_id", order_by, ["club_id"], unique), keyed(clubs, "club_id", order_by, ["country"], unique)
    active = active_only(entries)
    people = (
        active.select("team_code", "player_id", "caps")
        .join(players.select("player_id", "date_of_birth"), "player_id", "left")
        .join(stats.select("player_id", "minutes_played"), "player_id", "left")
        .groupBy("team_code")
        .agg(
            F.count(F.lit(1)).alias("squad_size"),
            F.sum(F.coalesce(F.col("caps"), F.lit(0)).cast("long")).alias("total_caps"),
            F.sum(F.coalesce(F.col("minutes_played"), F.lit(0)).cast("long")).alias("total_minutes"),
            (F.avg(age_days(F.col("date_of_birth"), F.to_date(F.lit(as_of)))) / DAYS_PER_YEAR).alias("average_age"),
        )
    )
    where = (
        active.select("team_code", "player_id").join(links.select("player_id", "club_id"), "player_id")
        .select("team_code", "club_id").distinct().join(clubs.select("club_id", "country"), "club_id")
        .groupBy("team_code").agg(F.count("club_id").alias("clubs"), F.count_distinct("country").alias("countries"))
    )
    return people.join(where, "team_code", "left").fillna(0, subset=["clubs", "countries"])


def roster_view(entries: DataFrame, players: DataFrame, links: DataFrame, clubs: DataFrame, as_of: str,
                position_order: Sequence[str]) -> DataFrame:
    """Roster rows with display age and position rank, unknown positions after the listed ones; unsorted, see ``roster_report``."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in position_order]), F.col("primary_position")), F.lit(0))
    out = roster(entries, players, links, clubs).withColumn("age", age_floor(F.col("date_of_birth"), F.to_date(F.lit(as_of))))
    return out.withColumn("position_rank", F.when(rank > 0, rank).otherwise(len(position_order) + 1).cast("int"))


def roster_report(view: DataFrame, team_code, order: Sequence[str | Column] = ("display_name",), limit: int = 1000) -> DataFrame:
    """One team's rows of ``roster_view`` in order of position, then ``order``; the first ``limit``."""
    return view.filter(F.col("team_code") == team_code).orderBy("position_rank", *order).limit(limit)
