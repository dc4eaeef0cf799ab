"""Rates per unit of exposure, leaderboards, and expected-value comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.num import per_n
from ..skew import top_per_key
from .joins import active_only, keyed


def efficiency(stats: DataFrame, players: DataFrame, entries: DataFrame, min_minutes: int, keeper: str = "goalkeeper",
               teams: DataFrame | None = None, order_by: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """Per-90 rates of players at or over the threshold, with their role bucket; unsorted.

    The team is the stat row's (``team_code``), named by ``teams``, so a player who left the squad keeps it; the active entry's where the
    stat row has none. Repeated players, entries and teams resolve to their last row by ``order_by``; ``unique`` declares that none repeats.
    """
    own = F.col("team_code") if "team_code" in stats.columns else F.lit(None)
    people = keyed(players, "player_id", order_by, ["display_name", "primary_position"], unique)
    entries = keyed(active_only(entries), "player_id", order_by, ["team", "team_code", "position_group"], unique)
    joined = (
        stats.filter((F.col("minutes_played") >= min_minutes) & (F.col("minutes_played") > 0)).withColumn("_code", own.cast("string"))
        .drop("team_code", "team", "position_group", "display_name", "primary_position")
        .join(people.select("player_id", "display_name", "primary_position"), "player_id", "left")
        .join(entries.select("player_id", "team", "team_code", "position_group"), "player_id", "left")
    )
    code = F.coalesce("_code", F.col("team_code").cast("string"))
    if teams is not None:
        named = keyed(teams, "team_code", order_by, ["team"], unique).select(F.col("team_code").cast("string").alias("_c"), F.col("team").alias("_team"))
        joined = joined.join(named, code == F.col("_c"), "left")
    else:
        joined = joined.withColumn("_team", F.lit(None).cast("string"))
    name = F.when(F.col("_code").isNull() | (F.col("_code") == F.col("team_code").cast("string")), F.col("team"))
    joined = joined.withColumns({"team": F.coalesce("_team", name, "team", "_code"), "team_code": code.cast(entries.schema["team_code"].dataType)})
    contributions = F.col("goals") + F.col("assists")
    cards = F.col("yellow_cards") + F.col("red_cards") + F.col("indirect_red_cards")
    position = F.coalesce("primary_position", "position_group", F.lit("unknown"))
    m = F.col("minutes_played")
    return joined.select(
        "player_id", "display_name", "team", "team_code",
        position.alias("position"),
        F.when(position == keeper, "goalkeeper").otherwise("outfield").alias("bucket"),
        m.alias("minutes"), "goals", "assists",
        contributions.alias("goal_contributions"), cards.alias("cards"),
        per_n(F.col("goals"), m).alias("goals_per_90"),
        per_n(F.col("assists"), m).alias("assists_per_90"),
        per_n(contributions, m).alias("goal_contributions_per_90"),
        per_n(cards, m).alias("cards_per_90"),
    )


def efficiency_report(rates: DataFrame, n: int) -> DataFrame:
    """The ``n`` best of ``efficiency``: by contributions per 90, then minutes."""
    return rates.orderBy(F.desc("goal_contributions_per_90"), F.desc("minutes"), "player_id").limit(n)


def top_n_per_group(df: DataFrame, group: str, metric: str, tie: str, n: int = 3) -> DataFrame:
    return top_per_key(df, [group], [F.desc(metric), F.asc(tie)], n)


def extreme(df: DataFrame, metric: str, tie: str, lowest: bool = False) -> DataFrame:
    """The one best (or worst) row among non-null metrics, as an aggregate."""
    order = F.struct((F.col(metric) if lowest else -F.col(metric)), F.col(tie))
    return df.filter(F.col(metric).isNotNull()).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def leaderboard(df: DataFrame, metric: str, mode: str = "total", minutes: str = "minutes", min_minutes: int = 270, n: int = 15,
                where: Column | None = None, tie: str = "player_id") -> DataFrame:
    """Top-n of a total, or of a per-90 rate among players with enough minutes; positive values only."""
    if where is not None:
        df = df.filter(where)
    value = F.col(metric).cast("double")
    if mode == "per90":
        df, value = df.filter(F.col(minutes) >= min_minutes), per_n(F.col(metric), F.col(minutes))
    return df.withColumn("value", value).filter("value > 0").orderBy(F.desc("value"), tie).limit(n)


def fair_play(stats: DataFrame, team: str = "team") -> DataFrame:
    """Yellow + 3 · (red + indirect red) per team, worst first."""
    per = stats.groupBy(team).agg(*[F.sum(c).alias(c) for c in ("yellow_cards", "red_cards", "indirect_red_cards")])
    points = F.col("yellow_cards") + 3 * (F.col("red_cards") + F.col("indirect_red_cards"))
    return per.withColumn("fair_play_points", points).orderBy(F.desc("fair_play_points"), F.collate(team, "UNICODE"))


def discipline(stats: DataFrame, name: str = "display_name") -> DataFrame:
    """Players with card points, most first, ties by name: points, and what they are made of."""
    reds = F.col("red_cards") + F.col("indirect_red_cards")
    points = F.col("yellow_cards") + 3 * reds
    rows = stats.withColumns({"reds": reds, "points": points, "label": F.concat(points.cast("string"), F.lit(" pts"))})
    return rows.filter("points > 0").orderBy(F.desc("points"), F.collate(name, "UNICODE"), "player_id")


def team_table(df: DataFrame, sort_key: str, ascending: bool = False, text: bool = False) -> DataFrame:
    by = F.collate(sort_key, "UNICODE") if text else F.col(sort_key)
    return df.orderBy(by.asc_nulls_last() if ascending else by.desc_nulls_last(), "team")


def goals_vs_expected(df: DataFrame, goals: str, expected: str, band: float = 0.5) -> DataFrame:
    """Difference and over / par / under by the band, plus the shared axis maximum rounded up to even."""
    d = F.col(goals) - F.col(expected)
    top = df.agg((F.ceil(F.greatest(F.max(goals), F.max(expected)) / 2) * 2).cast("long").alias("axis_max")).scalar()
    verdict = F.when(d > band, "over").when(d < -band, "under").when(d.isNotNull(), "par")
    return df.withColumn("difference", d).withColumn("verdict", verdict).withColumn("axis_max", top)
