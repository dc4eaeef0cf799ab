"""Known answers of the small tournament fixture: two teams, five players, three clubs, two matches."""

import pytest
from pyspark.sql import functions as F

from rosterlab.functions.num import age_years, match_result
from rosterlab.operators import composition, concentration, impact, matches, quality, rates

AS_OF = "2026-06-11"


@pytest.fixture(scope="module")
def t(spark):
    mk = spark.createDataFrame
    entry = "player_id string, team_code string, team string, caps int, squad_status string, position_group string"
    return {
        "teams": mk([("ALP", "Alpha"), ("BET", "Beta")], "team_code string, team string"),
        "players": mk(
            [("p1", "A One", "2004-06-11", "Alpha", "forward", "img"), ("p2", "A Two", "1990-01-01", "Gamma", "midfielder", None),
             ("p3", "A Three", "1998-01-01", None, "goalkeeper", None), ("p4", "B One", "2000-01-01", "Beta", "forward", "img"),
             ("p5", "B Two", "1988-01-01", "Beta", "defender", None)],
            "player_id string, display_name string, dob string, birth_country string, primary_position string, image_url string",
        ).withColumn("date_of_birth", F.to_date("dob")),
        "entries": mk(
            [("p1", "ALP", "Alpha", 10, "active", None), ("p2", "ALP", "Alpha", 20, "active", None), ("p3", "ALP", "Alpha", None, "active", None),
             ("p4", "BET", "Beta", 5, "active", None), ("p5", "BET", "Beta", 15, "active", None), ("removed", "BET", "Beta", 99, "removed", None)], entry),
        "clubs": mk([("c1", "Alpha FC", "Alpha League", "Alpha"), ("c2", "Gamma FC", "Gamma League", "Gamma"), ("c3", "Beta FC", "Beta League", "Beta")],
                    "club_id string, club_name string, league string, country string"),
        "links": mk([("p1", "c1", "Alpha"), ("p2", "c1", "Alpha"), ("p3", "c2", "Alpha"), ("p4", "c3", "Beta"), ("p5", "c3", "Beta")],
                    "player_id string, club_id string, team string"),
        "stats": mk([("p1", 2, 1, 270, 1, 0, 0), ("p2", 1, 0, 90, 0, 0, 0), ("p3", 0, 0, 270, 0, 0, 0), ("p4", 1, 2, 180, 2, 0, 0), ("p5", 0, 0, 45, 1, 1, 0)],
                    "player_id string, goals int, assists int, minutes_played int, yellow_cards int, red_cards int, indirect_red_cards int"),
        "team_stats": mk([("ALP", "Round of 16"), ("BET", "Group stage")], "team_code string, stage_reached string"),
        "matches": mk(
            [("m1", "First Stage", "Alpha", "Beta", 2, 1, None, None, "North Stadium", "North City", "played"),
             ("m2", "Round of 32", "Alpha", "Beta", 1, 1, 4, 3, "North Stadium", "North City", "played")],
            "match_id string, stage string, home_team string, away_team string, home_score int, away_score int, home_pens int, away_pens int, stadium string, city string, status string"),
    }


def row(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    return df.collect()[0]


def test_age_of_bad_dates_is_null(spark):
    from rosterlab.functions.num import try_date

    df = spark.createDataFrame([(None,), ("not-a-date",), ("2004-06-11T00:00:00",)], "d string")
    got = [r[0] for r in df.select(age_years(try_date(F.col("d")), F.lit(AS_OF).cast("date"))).collect()]
    assert got[0] is None and got[1] is None and got[2] == pytest.approx(22.0, abs=0.01)


def test_scorecard(t):
    out = composition.composition_scorecard(t["teams"], t["entries"], t["players"], t["links"], t["clubs"], AS_OF, t["team_stats"])
    a = row(out, team="Alpha")
    assert (a.squad_size, a.under_23, a.age_30_plus, a.caps_known, a.total_caps, a.median_caps) == (3, 1, 1, 2, 30, 15.0)
    assert (a.domestic, a.domestic_share, a.home_born_share, a.stage_reached) == (2, pytest.approx(2 / 3), 0.5, "Round of 16")
    assert row(out, team="Beta").squad_size == 2


def test_scorecard_aliases_and_empty_team(spark, t):
    teams = t["teams"].union(spark.createDataFrame([("GHO", "Ghost")], t["teams"].schema))
    aliases = spark.createDataFrame([("Alpha", "Gamma")], "team string, alias string")
    out = composition.composition_scorecard(teams, t["entries"], t["players"], t["links"], t["clubs"], AS_OF, aliases=aliases)
    assert row(out, team="Alpha").domestic == 3
    g = row(out, team="Ghost")
    assert (g.squad_size, g.average_age, g.domestic_share, g.total_caps) == (0, None, None, None)


def test_concentration(t):
    a = row(concentration.squad_concentration(t["teams"], t["entries"], t["links"], t["clubs"]), team="Alpha")
    assert a.club_largest_name == "Alpha FC" and a.club_largest_share == pytest.approx(2 / 3)
    assert a.club_hhi == pytest.approx(5 / 9) and a.club_effective == pytest.approx(9 / 5)


def test_impact(t):
    c1 = row(impact.impact(t["links"], t["entries"], t["clubs"], t["stats"], "club", 180), key="c1")
    assert (c1.players_sent, c1.teams_represented, c1.total_minutes, c1.goal_contributions, c1.meaningful_minutes_players) == (2, 1, 360, 4, 1)
    assert row(impact.impact(t["links"], t["entries"], t["clubs"], t["stats"], "league", 180), key="Beta League").players_sent == 2


def test_efficiency(t):
    rows = {r.player_id: r for r in rates.efficiency(t["stats"], t["players"], t["entries"], 180).collect()}
    assert "p2" not in rows and rows["p3"].bucket == "goalkeeper" and rows["p4"].goal_contributions_per_90 == 1.5


def test_matches(spark, t):
    m = t["matches"]
    assert row(matches.rate_by(m, ["stage"]), stage="First Stage").goals_per_match == 3
    assert tuple(matches.match_totals(m).collect()[0]) == (1, 1)
    assert matches.rate_by(m, ["stadium", "city"]).collect()[0].goals == 5
    assert row(matches.team_records(m), team="Alpha", stage="Round of 32").wins == 1
    assert row(matches.team_records(m, ["team"], mode="scoreline"), team="Alpha").draws == 1
    members = spark.createDataFrame([("Alpha", "AFC"), ("Beta", "UEFA")], "member string, category string")
    h = matches.head_to_head(m, members).collect()[0]
    assert (h.side_a, h.side_b, h.matches, h.a_wins, h.draws, h.shootouts, h.goals) == ("AFC", "UEFA", 2, 2, 0, 1, 5)


def test_result_modes(spark):
    df = spark.createDataFrame([(1, 1, 5, 4), (1, 1, 4, 4), (None, 1, None, None), (0, 2, None, None)], "h int, a int, hp int, ap int")
    c = [F.col(x) for x in ("h", "a", "hp", "ap")]
    assert [tuple(r) for r in df.select(match_result(*c), match_result(*c, "scoreline")).collect()] == [
        ("home", "draw"), ("draw", "draw"), (None, None), ("away", "away")]


def test_stage_reached_and_progress(spark):
    m = spark.createDataFrame(
        [("A", "B", "First Stage", "played"), ("A", "C", "Semi-final", "scheduled"), ("B", "C", "Round of 32", "played")],
        "home_team string, away_team string, stage string, status string")
    got = {r.team: r.stage_reached for r in matches.stage_reached(m, ["First Stage", "Round of 32", "Semi-final"], progress_stage="Semi-final").collect()}
    assert got == {"A": "Semi-final (in progress)", "B": "Round of 32", "C": "Semi-final (in progress)"}


def test_bracket_links_shootout_winner(spark):
    rows = [("q1", "Quarter", "A", "B", 1, 1, 5, 4), ("q2", "Quarter", "C", "D", 2, 0, None, None), ("f", "Final", "A", "C", 0, 1, None, None)]
    m = spark.createDataFrame([("t", *r, "played") for r in rows], "tournament string, match_id string, stage string, home_team string, away_team string, home_score int, away_score int, home_pens int, away_pens int, status string")
    linked = matches.bracket(m, ["Quarter", "Final"])
    f = row(linked, match_id="f")
    assert (f.home_feeder, f.away_feeder, f.winner, f.depth) == ("q1", "q2", "C", 0)
    assert row(matches.bracket_path(linked), team="C").champion is True
    assert {r.team for r in matches.semi_final_losers(linked).collect()} == {"B", "D"}
    waiting = m.withColumn("home_team", F.when(F.col("stage") == "Final", "W1").otherwise(F.col("home_team"))).withColumn("home_score", F.when(F.col("stage") != "Final", F.col("home_score")))
    f = row(matches.bracket(waiting, ["Quarter", "Final"]), match_id="f")
    assert (f.home_feeder, f.away_feeder, f.winner) == ("q1", "q2", None)


def test_quality(t):
    active = t["players"].join(t["entries"].filter("squad_status = 'active'").select("player_id"), "player_id", "left_semi")
    out = quality.quality_summary(
        [(active, [("active_player_images", F.col("image_url").isNotNull(), "available")])], fixed=[("xga_unavailable", "not_yet_collected")])
    assert row(out, key="active_player_images")["count"] == 2
    assert row(out, key="xga_unavailable").status == "not_yet_collected"


def test_goals_vs_expected_bands(spark):
    df = spark.createDataFrame([("a", 3, 2.4), ("b", 2, 2.5), ("c", 1, 1.8)], "team string, goals int, xg double")
    got = {r.team: (r.verdict, r.axis_max) for r in rates.goals_vs_expected(df, "goals", "xg").collect()}
    assert got == {"a": ("over", 4), "b": ("par", 4), "c": ("under", 4)}


def test_semi_finals_stand_in_order_of_date_and_the_play_off_is_a_match(spark):
    rows = [("t", "m10", "Semi-final", "A", "B", 1, 0, "2026-07-01"), ("t", "m9", "Semi-final", "C", "D", 1, 0, "2026-07-02"),
            ("t", "m11", "Final", "W1", "W2", None, None, "2026-07-05"), ("t", "m12", "Play-off for third place", "B", "D", 2, 1, "2026-07-04")]
    m = spark.createDataFrame(rows, "tournament string, match_id string, stage string, home_team string, away_team string, home_score int, away_score int, match_date string").selectExpr(
        "*", "cast(null as int) home_pens", "cast(null as int) away_pens", "if(home_score is null, 'scheduled', 'played') status")
    final = row(matches.bracket(m, ["Semi-final", "Final"]), match_id="m11")
    assert (final.home_feeder, final.away_feeder) == ("m10", "m9")
    assert [(r.match_id, r.home_team) for r in matches.third_place(m).collect()] == [("m12", "B")]


def test_repeated_keys_count_once_and_leavers_keep_their_team(spark, t):
    again = lambda df: df.union(df)
    out = composition.composition_scorecard(again(t["teams"]), t["entries"], again(t["players"]), again(t["links"]), again(t["clubs"]), AS_OF)
    assert row(out, team="Alpha").squad_size == 3 and row(out, team="Alpha").total_caps == 30
    stats = spark.createDataFrame([("gone", "ALP", 200, 1, 0, 0, 0, 0)], "player_id string, team_code string, minutes_played int, goals int, assists int, yellow_cards int, red_cards int, indirect_red_cards int")
    teams = spark.createDataFrame([("ALP", "Alpha")], "team_code string, team string")
    got = rates.efficiency(stats, t["players"], t["entries"], 180, teams=teams).collect()[0]
    assert (got.team, got.team_code) == ("Alpha", "ALP")


def test_discipline_ranks_players_with_points(spark):
    stats = spark.createDataFrame([(1, "B", 1, 1, 0), (2, "A", 4, 0, 0), (3, "C", 0, 0, 0)], "player_id int, display_name string, yellow_cards int, red_cards int, indirect_red_cards int")
    assert [(r.display_name, r.points, r.label) for r in rates.discipline(stats).collect()] == [("A", 4, "4 pts"), ("B", 4, "4 pts")]
