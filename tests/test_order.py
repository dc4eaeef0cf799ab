"""Row order, where it is the feature: the comparison with SQL sorts both sides and cannot see it."""

from rosterlab.operators import composition, facets, matches, rates


def test_leaderboard_and_discipline(spark):
    df = spark.createDataFrame([(3, 5, 300), (1, 7, 300), (2, 7, 900), (4, 0, 300), (5, 9, 100)], "player_id int, goals int, minutes int")
    assert [r.player_id for r in rates.leaderboard(df, "goals", n=4).collect()] == [5, 1, 2, 3]
    assert [r.player_id for r in rates.leaderboard(df, "goals", mode="per90").collect()] == [1, 3, 2]


def test_team_table_puts_missing_values_last(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", None), ("d", 9)], "team string, points int")
    assert [r.team for r in rates.team_table(df, "points").collect()] == ["d", "a", "b", "c"]
    assert [r.team for r in rates.team_table(df, "points", ascending=True).collect()] == ["a", "b", "d", "c"]


def test_options_sort_as_words(spark):
    df = spark.createDataFrame([("Zeta",), ("école",), ("Eva",), (None,), ("Zeta",)], "league string")
    assert [r.league for r in facets.distinct_options(df, "league").collect()] == ["école", "Eva", "Zeta"]


def test_roster_view_by_position(spark):
    entries = spark.createDataFrame([("A", "p1", "active"), ("A", "p2", "active"), ("A", "p3", ""), ("A", "p4", "removed")], "team_code string, player_id string, squad_status string")
    players = spark.createDataFrame([("p1", "Zed", "1990-01-01", "keeper"), ("p2", "Ann", "1990-01-01", "other"), ("p3", "Bo", "1990-01-01", "keeper")], "player_id string, display_name string, date_of_birth string, primary_position string")
    players = players.withColumn("date_of_birth", players.date_of_birth.cast("date"))
    links, clubs = spark.createDataFrame([("p1", "c")], "player_id string, club_id string"), spark.createDataFrame([("c", "Club")], "club_id string, club_name string")
    view = composition.roster_view(entries, players, links, clubs, "2026-01-01", ["keeper"])
    assert [r.player_id for r in composition.roster_report(view, "A").collect()] == ["p3", "p1", "p2"]
    assert [r.player_id for r in composition.roster_report(view, "A", limit=1).collect()] == ["p3"]


def test_matches_by_group_newest_first(spark):
    df = spark.createDataFrame([("m1", "S1", "2026-06-01", "x"), ("m2", "S1", "2026-06-03", "x"), ("m3", "S2", "2026-06-02", "x")], "match_id string, stage string, match_date string, status string")
    groups = matches.match_groups(df, ["S1", "S2"])
    assert [r.match_id for r in matches.match_report(groups).collect()] == ["m2", "m1", "m3"]


def test_medians_of_even_and_odd_groups(spark):
    from pyspark.sql import functions as F
    from rosterlab.skew import group_median

    df = spark.createDataFrame([("a", 1), ("a", 9), ("a", 2), ("b", 4), ("b", 4), ("b", 1), ("b", 7), (None, 3), ("c", None)], "k string, v int")
    assert {r.k: r.m for r in group_median(df, ["k"], F.col("v"), "m").collect()} == {"a": 2.0, "b": 4.0, None: 3.0}
