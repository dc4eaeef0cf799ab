"""How concentrated the members of a group are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.num import ratio


def concentration(df: DataFrame, group: str, member: str, prefix: str) -> DataFrame:
    """Per group over non-null members: known count, distinct, top member and share, HHI,
    effective number 1/HHI, and effective number over distinct.

    Two reductions: (group, member) counts, then one aggregate per group. Ties for the top go to
    the smaller member.
    """
    counts = df.filter(F.col(member).isNotNull()).groupBy(group, member).agg(F.count(F.lit(1)).alias("n"))
    return concentration_of_counts(counts, group, member, "n", prefix)


def concentration_of_counts(counts: DataFrame, group: str, member: str, n: str, prefix: str) -> DataFrame:
    top = F.min_by(F.struct(F.col(member).alias("m"), F.col(n).alias("k")), F.struct(-F.col(n), F.col(member)))
    per = counts.groupBy(group).agg(
        F.sum(n).alias("_total"),
        F.count(F.lit(1)).alias("_distinct"),
        # sums of squared whole numbers stay exact up to 2**53
        F.sum(F.col(n).cast("double") * F.col(n)).alias("_squares"),
        top.alias("_top"),
    )
    hhi = F.col("_squares") / (F.col("_total").cast("double") * F.col("_total"))
    return per.select(
        group,
        F.col("_total").alias(f"{prefix}_known"),
        F.col("_distinct").alias(f"{prefix}_distinct"),
        F.col("_top.m").alias(f"{prefix}_largest"),
        ratio(F.col("_top.k"), F.col("_total")).alias(f"{prefix}_largest_share"),
        hhi.alias(f"{prefix}_hhi"),
        (1 / hhi).alias(f"{prefix}_effective"),
        (1 / hhi / F.col("_distinct")).alias(f"{prefix}_effective_normalized"),
    )


def squad_concentration(teams: DataFrame, entries: DataFrame, links: DataFrame, clubs: DataFrame) -> DataFrame:
    """Club and club-country concentration per team, most concentrated first; teams without members stay."""
    from .joins import active_only

    active = active_only(entries).select("team_code", "player_id")
    sizes = active.groupBy("team_code").agg(F.count(F.lit(1)).alias("squad_size"))
    per_club = (
        active.join(links.select("player_id", "club_id"), "player_id")
        .groupBy("team_code", "club_id").agg(F.count(F.lit(1)).alias("n"))
        .join(clubs.select("club_id", "club_name", "country"), "club_id")
    )
    by_club = concentration_of_counts(per_club, "team_code", "club_id", "n", "club")
    by_country = concentration_of_counts(
        per_club.filter("country is not null").groupBy("team_code", "country").agg(F.sum("n").alias("n")),
        "team_code", "country", "n", "country",
    )
    named = by_club.join(
        clubs.select(F.col("club_id").alias("club_largest"), F.col("club_name").alias("club_largest_name")), "club_largest", "left"
    )
    out = (
        teams.select("team_code", "team").join(sizes, "team_code", "left").join(named, "team_code", "left")
        .join(by_country, "team_code", "left")
        .fillna(0, subset=["squad_size", "club_known", "country_known"])
    )
    return out.orderBy(F.coalesce("club_hhi", F.lit(-1.0)).desc(), F.collate("team", "UNICODE"), "team_code")
