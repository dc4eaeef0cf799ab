"""Match results: rates, margins, records, head to head, stages, brackets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.num import match_result, ratio
from ..skew import first_per_key
from .joins import category_of


def played(matches: DataFrame) -> DataFrame:
    return matches.filter((F.col("status") == "played") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())


def _result(mode: str) -> Column:
    return match_result(F.col("home_score"), F.col("away_score"), F.col("home_pens"), F.col("away_pens"), mode)


def rate_by(matches: DataFrame, keys: Sequence[str], min_matches: int = 1) -> DataFrame:
    """Matches, goals and goals per match by key."""
    goals = (F.col("home_score") + F.col("away_score")).cast("long")
    out = played(matches).groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), F.sum(goals).alias("goals"))
    out = out.filter(F.col("matches") >= min_matches).withColumn("goals_per_match", ratio(F.col("goals"), F.col("matches")))
    return out.orderBy(F.desc("goals_per_match"), F.desc("matches"), *[F.collate(k, "UNICODE") for k in keys])


def margin_distribution(matches: DataFrame) -> DataFrame:
    margin = F.abs(F.col("home_score") - F.col("away_score"))
    out = played(matches).groupBy(margin.alias("goal_margin")).agg(F.count(F.lit(1)).alias("matches"))
    label = F.when(F.col("goal_margin") == 0, "Draw after 90/120").when(F.col("goal_margin") == 1, "1 goal").otherwise(
        F.concat(F.col("goal_margin").cast("string"), F.lit(" goals"))
    )
    return out.withColumn("margin", label)


def sides(matches: DataFrame, mode: str) -> DataFrame:
    """Two rows per played match, one for each side, by exploding within the row (no shuffle)."""
    res = _result(mode)
    side = lambda me, other: F.struct(
        F.col(f"{me}_team").alias("team"),
        F.col(f"{me}_score").alias("gf"),
        F.col(f"{other}_score").alias("ga"),
        F.when(res == "draw", "D").when(res == me, "W").otherwise("L").alias("outcome"),
    )
    return played(matches).select("stage", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("stage", "s.*")


def team_records(matches: DataFrame, keys: Sequence[str] = ("team", "stage"), mode: str = "decided") -> DataFrame:
    """Played, won, drawn, lost, goals for and against. ``scoreline`` counts a shoot-out as a draw."""
    return sides(matches, mode).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("played"),
        F.count_if(F.col("outcome") == "W").alias("wins"),
        F.count_if(F.col("outcome") == "D").alias("draws"),
        F.count_if(F.col("outcome") == "L").alias("losses"),
        F.sum(F.col("gf").cast("long")).alias("goals_for"),
        F.sum(F.col("ga").cast("long")).alias("goals_against"),
    )


def head_to_head(matches: DataFrame, members: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Matches between categories as unordered pairs; matches inside one category are left out."""
    m = played(matches).withColumn("result", _result("decided"))
    m = category_of(m, "home_team", members, aliases, "home_cat")
    m = category_of(m, "away_team", members, aliases, "away_cat")
    m = m.filter("home_cat is not null and away_cat is not null and home_cat <> away_cat")
    winner = F.when(F.col("result") == "home", F.col("home_cat")).when(F.col("result") == "away", F.col("away_cat"))
    a, b = F.least("home_cat", "away_cat"), F.greatest("home_cat", "away_cat")
    return m.select(
        a.alias("side_a"), b.alias("side_b"), winner.alias("winner"), "result", "home_pens", "away_pens",
        (F.col("home_score") + F.col("away_score")).cast("long").alias("goals"),
    ).groupBy("side_a", "side_b").agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_if(F.col("winner") == F.col("side_a")).alias("a_wins"),
        F.count_if(F.col("winner") == F.col("side_b")).alias("b_wins"),
        F.count_if(F.col("result") == "draw").alias("draws"),
        F.count_if(F.col("home_pens").isNotNull() & F.col("away_pens").isNotNull()).alias("shootouts"),
        F.sum("goals").alias("goals"),
    ).orderBy(F.desc("matches"), "side_a", "side_b")


def match_totals(matches: DataFrame) -> DataFrame:
    return played(matches).agg(
        F.count_if(F.col("home_score") == F.col("away_score")).alias("drawn_scorelines"),
        F.count_if(F.col("home_pens").isNotNull() & F.col("away_pens").isNotNull()).alias("shootouts"),
    )


def stage_rank(order: Sequence[str], c: str = "stage") -> Column:
    """1-based place of a stage in ``order``; 0 for a stage not listed."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.col(c)), F.lit(0)).cast("int")


def stage_reached(matches: DataFrame, order: Sequence[str], labels: dict[str, str] | None = None,
                  progress_stage: str | None = None) -> DataFrame:
    """Deepest stage each team played in; a scheduled ``progress_stage`` match counts as in progress there."""
    label = F.col("stage")
    if labels:
        label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("stage")), F.col("stage"))
    both = matches.select(
        "status", "stage", stage_rank(order).alias("r"), label.alias("label"),
        F.explode(F.array("home_team", "away_team")).alias("team"),
    ).filter("team is not null")
    done = both.filter((F.col("status") == "played"))
    rows = done.select("team", "r", "label")
    if progress_stage:
        ahead = both.filter((F.col("status") != "played") & (F.col("stage") == progress_stage))
        rows = rows.unionByName(ahead.select("team", "r", F.concat("label", F.lit(" (in progress)")).alias("label")))
    return rows.groupBy("team").agg(F.max_by("label", F.struct("r", "label")).alias("stage_reached"), F.max("r").alias("stage_rank"))


def team_stats_merge(collected: DataFrame, tallies: DataFrame, reached: DataFrame, default_stage: str) -> DataFrame:
    out = collected.join(tallies, "team", "left").join(reached.select("team", "stage_reached"), "team", "left")
    return out.fillna(0, subset=["played", "wins", "draws", "losses", "goals_for", "goals_against"]).fillna(
        default_stage, subset=["stage_reached"]
    )


def current_stage(matches: DataFrame, order: Sequence[str]) -> DataFrame:
    """The deepest stage with a played match."""
    return played(matches).agg(F.max_by("stage", stage_rank(order)).alias("current_stage"))


def match_groups(matches: DataFrame, order: Sequence[str], view: str = "all", group: str = "stage", where: Column | None = None) -> DataFrame:
    """Matches of a view with their group's key and rank; unsorted, see ``match_report``."""
    first = order[0]
    keep = {
        "all": F.lit(True),
        "scheduled": F.col("status") == "scheduled",
        "knockout": F.col("stage") != first,
        "groups": F.col("stage") == first,
    }[view]
    out = matches.filter(keep)
    if where is not None:
        out = out.filter(where)
    return out.withColumn("group_key", F.col(group)).withColumn("group_rank", stage_rank(order))


def match_report(groups: DataFrame, limit: int = 1000) -> DataFrame:
    """The first rows of ``match_groups`` by group, newest first inside a group."""
    return groups.orderBy("group_rank", "group_key", F.desc("match_date"), "match_id").limit(limit)


def bracket(matches: DataFrame, rounds: Sequence[str], by: Sequence[str] = ("tournament",)) -> DataFrame:
    """Knockout matches linked to the earlier matches their participants won.

    One equi-join per side, from (tournament, round, team) to the winners of the round before. A
    final between placeholders takes the matches of the round before in order of (date, id). Adds the winner,
    the two feeder match ids, and the depth from the final (0).
    """
    res = _result("decided")
    m = matches.filter(F.col("stage").isin(*rounds)).withColumn("round_no", stage_rank(rounds)).withColumn(
        "winner", F.when(res == "home", F.col("home_team")).when(res == "away", F.col("away_team"))
    )
    won = m.filter("winner is not null").select(
        *by, (F.col("round_no") + 1).alias("round_no"), F.col("winner").alias("_w"), F.col("match_id").alias("_feeder")
    )
    for side in ("home", "away"):
        m = m.join(
            won.withColumnsRenamed({"_w": f"{side}_team", "_feeder": f"{side}_feeder"}), [*by, "round_no", f"{side}_team"], "left"
        )
    m = m.withColumn("depth", F.lit(len(rounds)) - F.col("round_no"))
    when = F.struct(*[c for c in ("match_date", "match_id") if c in m.columns])
    semis = m.filter("depth = 1").groupBy(*by).agg(F.min_by("match_id", when).alias("_s1"), F.max_by("match_id", when).alias("_s2"))
    first, second = F.col("_s1"), F.when(F.col("_s1") != F.col("_s2"), F.col("_s2"))  # a bye leaves one semi-final

    def feeder(mine: Column, theirs: Column, placed: Column) -> Column:
        open_slot = F.when(theirs.isNull(), F.when(second.isNotNull(), placed)).when(theirs == first, second).when(theirs == second, first)
        return F.coalesce(mine, F.when(F.col("depth") == 0, open_slot))

    home, away = F.col("home_feeder"), F.col("away_feeder")
    return m.join(semis, list(by), "left").withColumns({
        "home_feeder": feeder(home, away, first), "away_feeder": feeder(away, home, second),
    }).drop("_s1", "_s2")


def third_place(matches: DataFrame, stage: str = "Play-off for third place", by: Sequence[str] = ("tournament",)) -> DataFrame:
    """The play-off match for third place: the first of its stage by (date, id)."""
    return first_per_key(matches.filter(F.col("stage") == stage), list(by), ["match_date", "match_id"])


def semi_final_losers(linked: DataFrame, by: Sequence[str] = ("tournament",)) -> DataFrame:
    """The two teams that lost the round before the final, with the match they lost."""
    loser = F.when(F.col("winner") == F.col("home_team"), F.col("away_team")).otherwise(F.col("home_team"))
    return linked.filter("depth = 1 and winner is not null").select(*by, "match_id", loser.alias("team"))


def bracket_path(linked: DataFrame, by: Sequence[str] = ("tournament",)) -> DataFrame:
    """Per participant: matches played, the deepest round, and whether it won the last round it reached."""
    both = linked.select(*by, "round_no", "depth", "winner", F.explode(F.array("home_team", "away_team")).alias("team"))
    return both.groupBy(*by, "team").agg(
        F.count(F.lit(1)).alias("played"),
        F.max("round_no").alias("last_round"),
        F.coalesce(F.max((F.col("depth") == 0) & (F.col("winner") == F.col("team"))), F.lit(False)).alias("champion"),
    )
