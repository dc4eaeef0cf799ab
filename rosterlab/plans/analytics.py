"""Composition, concentration, impact, rates and match queries with the SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import num
from ..operators import composition, concentration, facets, impact, joins, matches, rates
from ..sources.adapters import AS_OF
from .registry import query

STAGES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
ACTIVE = "coalesce(trim(squad_status), '') IN ('', 'active')"


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("composition_scorecard", f"""
WITH act AS (SELECT e.*, date_of_birth, birth_country, date_diff('day', date_of_birth, DATE '{AS_OF}') AS d
             FROM entries e LEFT JOIN players USING (player_id) WHERE {ACTIVE}),
p AS (SELECT team_code, count(*) AS squad_size, avg(d) / 365.25 AS average_age, median(d) / 365.25 AS median_age,
        count(*) FILTER (d / 365.25 < 23) AS under_23, count(*) FILTER (d / 365.25 >= 30) AS age_30_plus, count(d) AS age_known,
        sum(caps)::BIGINT AS total_caps, median(caps) AS median_caps, count(caps) AS caps_known,
        count(*) FILTER (birth_country = team) AS home_born, count(birth_country) AS birth_country_known FROM act GROUP BY 1),
k AS (SELECT team_code, count(*) FILTER (country = a.team) AS domestic, count(country) AS club_country_known,
        count(DISTINCT club_id) AS clubs, count(DISTINCT country) AS club_countries, count(DISTINCT league) AS leagues
      FROM act a JOIN links USING (player_id) JOIN clubs USING (club_id) GROUP BY 1)
SELECT team_code, team, coalesce(squad_size, 0) AS squad_size, round(average_age, 6) AS average_age, round(median_age, 6) AS median_age,
  coalesce(under_23, 0) AS under_23, coalesce(age_30_plus, 0) AS age_30_plus, coalesce(age_known, 0) AS age_known, total_caps,
  round(median_caps, 6) AS median_caps, coalesce(caps_known, 0) AS caps_known, coalesce(home_born, 0) AS home_born,
  coalesce(birth_country_known, 0) AS birth_country_known, coalesce(domestic, 0) AS domestic,
  coalesce(club_country_known, 0) AS club_country_known, coalesce(clubs, 0) AS clubs, coalesce(club_countries, 0) AS club_countries,
  coalesce(leagues, 0) AS leagues, round(domestic::DOUBLE / nullif(club_country_known, 0), 6) AS domestic_share,
  round(home_born::DOUBLE / nullif(birth_country_known, 0), 6) AS home_born_share
FROM teams LEFT JOIN p USING (team_code) LEFT JOIN k USING (team_code)""")
def _(t):
    out = composition.composition_scorecard(t.teams, t.entries, t.players, t.links, t.clubs, AS_OF, unique=True)
    return r6(out, "average_age", "median_age", "median_caps", "domestic_share", "home_born_share")


@query("squad_concentration", f"""
WITH act AS (SELECT team_code, club_id, club_name, country FROM entries JOIN links USING (player_id) JOIN clubs USING (club_id) WHERE {ACTIVE}),
c AS (SELECT team_code, club_id, any_value(club_name) AS club_name, count(*) AS n FROM act GROUP BY 1, 2),
k AS (SELECT team_code, country, count(*) AS n FROM act WHERE country IS NOT NULL GROUP BY 1, 2),
ca AS (SELECT team_code, sum(n)::BIGINT AS club_known, count(*) AS club_distinct, arg_min(club_id, (-n, club_id)) AS club_largest,
         arg_min(club_name, (-n, club_id)) AS club_largest_name, max(n) / sum(n)::DOUBLE AS club_largest_share,
         sum(n * n) / (sum(n)::DOUBLE * sum(n)) AS club_hhi FROM c GROUP BY 1),
ka AS (SELECT team_code, sum(n)::BIGINT AS country_known, count(*) AS country_distinct, arg_min(country, (-n, country)) AS country_largest,
         max(n) / sum(n)::DOUBLE AS country_largest_share, sum(n * n) / (sum(n)::DOUBLE * sum(n)) AS country_hhi FROM k GROUP BY 1),
s AS (SELECT team_code, count(*) AS squad_size FROM entries WHERE {ACTIVE} GROUP BY 1)
SELECT team_code, team, coalesce(squad_size, 0) AS squad_size, coalesce(club_known, 0) AS club_known, club_distinct, club_largest,
  club_largest_name, round(club_largest_share, 6) AS club_largest_share, round(club_hhi, 6) AS club_hhi,
  round(1 / club_hhi, 6) AS club_effective, round(1 / club_hhi / club_distinct, 6) AS club_effective_normalized,
  coalesce(country_known, 0) AS country_known, country_distinct, country_largest, round(country_largest_share, 6) AS country_largest_share,
  round(country_hhi, 6) AS country_hhi, round(1 / country_hhi, 6) AS country_effective,
  round(1 / country_hhi / country_distinct, 6) AS country_effective_normalized
FROM teams LEFT JOIN s USING (team_code) LEFT JOIN ca USING (team_code) LEFT JOIN ka USING (team_code)""")
def _(t):
    out = concentration.squad_concentration(t.teams, t.entries, t.links, t.clubs)
    return r6(out, *[f"{p}_{m}" for p in ("club", "country") for m in ("largest_share", "hhi", "effective", "effective_normalized")])


def _impact_sql(key, label):
    return f"""
WITH base AS (SELECT l.club_id, l.team, club_name, league, coalesce(minutes_played, 0) AS mi, coalesce(goals, 0) AS g, coalesce(assists, 0) AS a
  FROM links l LEFT JOIN clubs USING (club_id) LEFT JOIN stats USING (player_id)
  WHERE l.player_id IN (SELECT player_id FROM entries WHERE {ACTIVE})),
rows AS (SELECT {key} AS key, {label} AS label, count(*) AS players_sent, count(DISTINCT team) AS teams_represented,
  sum(mi)::BIGINT AS total_minutes, sum(g)::BIGINT AS goals, sum(a)::BIGINT AS assists,
  count(*) FILTER (mi >= 180) AS meaningful_minutes_players, (sum(g) + sum(a))::BIGINT AS goal_contributions FROM base GROUP BY 1, 2)
SELECT rows.*, round(100 * (0.2 * players_sent / greatest(max(players_sent) OVER (), 1) + 0.2 * teams_represented / greatest(max(teams_represented) OVER (), 1)
  + 0.35 * total_minutes / greatest(max(total_minutes) OVER (), 1) + 0.25 * goal_contributions / greatest(max(goal_contributions) OVER (), 1)), 6) AS impact_index
FROM rows"""


@query("impact_by_club", _impact_sql("club_id::VARCHAR", "coalesce(club_name, club_id::VARCHAR)"))
def _(t):
    return r6(impact.impact(t.links, t.entries, t.clubs, t.player_stats, "club", unique=True), "impact_index")


LEAGUE = "coalesce(league, 'League pending review')"


@query("impact_by_league", _impact_sql(LEAGUE, LEAGUE))
def _(t):
    return r6(impact.impact(t.links, t.entries, t.clubs, t.player_stats, "league", unique=True), "impact_index")


@query("weighted_index", """
WITH s AS (SELECT l_suppkey, sum(l_extendedprice) AS revenue, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(revenue, 2) AS revenue, lines, round(100 * (0.6 * revenue / greatest(max(revenue) OVER (), 1)
  + 0.4 * lines / greatest(max(lines) OVER (), 1)), 6) AS idx FROM s""")
def _(t):
    s = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("revenue"), F.count(F.lit(1)).alias("lines"))
    return impact.weighted_index(s, {"revenue": 0.6, "lines": 0.4}, "idx").withColumns(
        {"revenue": F.round("revenue", 2), "idx": F.round("idx", 6)}
    )


@query("top_metric", """
SELECT s_name, minutes FROM (SELECT l_suppkey, sum(l_quantity)::BIGINT AS minutes FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = l_suppkey
ORDER BY minutes DESC, s_name LIMIT 10""")
def _(t):
    per = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("minutes"))
    named = per.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "minutes")
    return impact.top_metric(named, "minutes", "s_name", 10)


EFF = f"""
SELECT player_id, display_name, n_name AS team, c_nationkey AS team_code, coalesce(primary_position, position_group, 'unknown') AS position,
  CASE WHEN coalesce(primary_position, position_group) = 'HOUSEHOLD' THEN 'goalkeeper' ELSE 'outfield' END AS bucket,
  minutes_played AS minutes, goals, assists, goals + assists AS goal_contributions, yellow_cards + red_cards + indirect_red_cards AS cards,
  round(goals / minutes_played * 90, 6) AS goals_per_90, round(assists / minutes_played * 90, 6) AS assists_per_90,
  round((goals + assists) / minutes_played * 90, 6) AS goal_contributions_per_90,
  round((yellow_cards + red_cards + indirect_red_cards) / minutes_played * 90, 6) AS cards_per_90
FROM stats JOIN customer ON c_custkey = player_id JOIN nation ON n_nationkey = c_nationkey LEFT JOIN players USING (player_id)
LEFT JOIN (SELECT player_id, position_group FROM entries WHERE {ACTIVE}) USING (player_id)
WHERE minutes_played >= 180"""


def _eff(t):
    of = t.customer.select(F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team_code"))
    out = rates.efficiency(t.player_stats.join(of, "player_id"), t.players, t.entries, 180, keeper="HOUSEHOLD", teams=t.teams, unique=True)
    return r6(out, "goals_per_90", "assists_per_90", "goal_contributions_per_90", "cards_per_90")


@query("efficiency_per_90", EFF)
def _(t):
    return _eff(t)


@query("top_n_per_group", f"""
SELECT team_code, player_id, goal_contributions, rank_no FROM (
  SELECT *, row_number() OVER (PARTITION BY team_code ORDER BY goal_contributions DESC, player_id) AS rank_no FROM ({EFF}))
WHERE rank_no <= 3""")
def _(t):
    return rates.top_n_per_group(_eff(t), "team_code", "goal_contributions", "player_id", 3).select(
        "team_code", "player_id", "goal_contributions", "rank_no"
    )


@query("extreme_rows", f"""
WITH e AS ({EFF})
(SELECT 'best' AS which, player_id, goal_contributions_per_90 AS rate FROM e ORDER BY rate DESC, player_id LIMIT 1)
UNION ALL (SELECT 'worst' AS which, player_id, goal_contributions_per_90 AS rate FROM e ORDER BY rate, player_id LIMIT 1)""")
def _(t):
    e = _eff(t).select("player_id", F.col("goal_contributions_per_90").alias("rate"))
    best = rates.extreme(e, "rate", "player_id").withColumn("which", F.lit("best"))
    return best.unionByName(rates.extreme(e, "rate", "player_id", lowest=True).withColumn("which", F.lit("worst")))


@query("compare_two", """
WITH m AS (SELECT c_nationkey AS k, count(*)::DOUBLE AS customers, sum(c_acctbal) AS balance, avg(c_acctbal) AS mean_balance
  FROM customer GROUP BY 1),
l AS (SELECT k, 'customers' AS metric, customers AS v FROM m UNION ALL SELECT k, 'balance', balance FROM m
  UNION ALL SELECT k, 'mean_balance', mean_balance FROM m)
SELECT metric, round(max(v) FILTER (k = 3), 6) AS value_a, round(max(v) FILTER (k = 7), 6) AS value_b,
  round(max(v) FILTER (k = 3) - max(v) FILTER (k = 7), 6) AS difference,
  round(greatest(max(v) FILTER (k = 3), max(v) FILTER (k = 7), 1), 6) AS bar_max
FROM l GROUP BY 1""")
def _(t):
    m = t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance"), F.avg("c_acctbal").alias("mean_balance")
    )
    out = composition.compare_two(m, "c_nationkey", 3, 7, ["customers", "balance", "mean_balance"])
    return r6(out, "value_a", "value_b", "difference", "bar_max")


def _rate_sql(keys, having=""):
    return f"""
SELECT {keys}, count(*) AS matches, sum(home_score + away_score)::BIGINT AS goals,
  round(sum(home_score + away_score)::DOUBLE / count(*), 6) AS goals_per_match FROM matches WHERE status = 'played' GROUP BY {keys} {having}"""


@query("goal_rate_by_stage", _rate_sql("stage"))
def _(t):
    return r6(matches.rate_by(t.matches, ["stage"]), "goals_per_match")


@query("goal_rate_by_venue", _rate_sql("stadium, city", "HAVING count(*) >= 5"))
def _(t):
    return r6(matches.rate_by(t.matches, ["stadium", "city"], min_matches=5), "goals_per_match")


@query("margin_distribution", """
SELECT abs(home_score - away_score) AS goal_margin, CASE abs(home_score - away_score) WHEN 0 THEN 'Draw after 90/120' WHEN 1 THEN '1 goal'
  ELSE abs(home_score - away_score) || ' goals' END AS margin, count(*) AS matches FROM matches WHERE status = 'played' GROUP BY 1, 2""")
def _(t):
    return matches.margin_distribution(t.matches)


def _records_sql(keys, shootout_wins):
    h, a = ("result = 'home'", "result = 'away'") if shootout_wins else ("home_score > away_score", "home_score < away_score")
    d = "result = 'draw'" if shootout_wins else "home_score = away_score"
    return f"""
WITH s AS (SELECT home_team AS team, stage, home_score AS gf, away_score AS ga, {h} AS w, {d} AS d FROM decided
  UNION ALL SELECT away_team, stage, away_score, home_score, {a}, {d} FROM decided)
SELECT {keys}, count(*) AS played, count(*) FILTER (w) AS wins, count(*) FILTER (d) AS draws, count(*) FILTER (NOT w AND NOT d) AS losses,
  sum(gf)::BIGINT AS goals_for, sum(ga)::BIGINT AS goals_against FROM s GROUP BY {keys}"""


@query("team_stage_records", _records_sql("team, stage", True))
def _(t):
    return matches.team_records(t.matches)


@query("team_tallies", _records_sql("team", False))
def _(t):
    return matches.team_records(t.matches, ["team"], mode="scoreline")


@query("head_to_head", """
WITH c AS (SELECT least(h.category, a.category) AS side_a, greatest(h.category, a.category) AS side_b,
  CASE result WHEN 'home' THEN h.category WHEN 'away' THEN a.category END AS winner, d.*
  FROM decided d JOIN teams h ON h.team = home_team JOIN teams a ON a.team = away_team WHERE h.category <> a.category)
SELECT side_a, side_b, count(*) AS matches, count(*) FILTER (winner = side_a) AS a_wins, count(*) FILTER (winner = side_b) AS b_wins,
  count(*) FILTER (result = 'draw') AS draws, count(*) FILTER (home_pens IS NOT NULL AND away_pens IS NOT NULL) AS shootouts,
  sum(home_score + away_score)::BIGINT AS goals FROM c GROUP BY 1, 2""")
def _(t):
    members = t.teams.select(F.col("team").alias("member"), "category")
    return matches.head_to_head(t.matches, members)


@query("match_totals", """
SELECT count(*) FILTER (home_score = away_score) AS drawn_scorelines,
  count(*) FILTER (home_pens IS NOT NULL AND away_pens IS NOT NULL) AS shootouts FROM matches WHERE status = 'played'""")
def _(t):
    return matches.match_totals(t.matches)


@query("match_result_modes", """
SELECT match_id, CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away' WHEN home_score = away_score THEN 'draw' END AS scoreline,
  CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away' WHEN home_pens > away_pens THEN 'home'
  WHEN home_pens < away_pens THEN 'away' WHEN home_score = away_score THEN 'draw' END AS decided FROM matches""")
def _(t):
    return t.matches.select("match_id", matches._result("scoreline").alias("scoreline"), matches._result("decided").alias("decided"))


RANK = "list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], stage)"
REACHED = f"""
SELECT team, arg_max(label, (r, label)) AS stage_reached, max(r) AS stage_rank FROM (
  SELECT unnest([home_team, away_team]) AS team, r, label FROM (
    SELECT home_team, away_team, {RANK}::INT AS r, CASE WHEN status = 'played' THEN stage ELSE stage || ' (in progress)' END AS label
    FROM matches WHERE status = 'played' OR stage = '2-HIGH'))
WHERE team IS NOT NULL GROUP BY 1"""


@query("stage_reached", REACHED)
def _(t):
    return matches.stage_reached(t.matches, STAGES, progress_stage="2-HIGH")


@query("team_stats_merge", f"""
WITH r AS ({REACHED}), w AS ({_records_sql("team", False).replace("WITH s AS", "WITH s AS")})
SELECT team, n_customers, coalesce(played, 0) AS played, coalesce(wins, 0) AS wins, coalesce(draws, 0) AS draws, coalesce(losses, 0) AS losses,
  coalesce(goals_for, 0) AS goals_for, coalesce(goals_against, 0) AS goals_against, coalesce(stage_reached, '5-LOW') AS stage_reached
FROM (SELECT n_name AS team, count(c_custkey) AS n_customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
LEFT JOIN w USING (team) LEFT JOIN r USING (team)""")
def _(t):
    per = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    collected = t.nation.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("team"), F.coalesce("n_customers", F.lit(0)).alias("n_customers")
    )
    tallies = matches.team_records(t.matches, ["team"], mode="scoreline")
    return matches.team_stats_merge(collected, tallies, matches.stage_reached(t.matches, STAGES, progress_stage="2-HIGH"), STAGES[0])


@query("leaderboard_total", f"""
SELECT player_id, team, goals::DOUBLE AS value FROM ({EFF}) WHERE goals > 0 AND position = 'BUILDING' ORDER BY value DESC, player_id LIMIT 15""")
def _(t):
    return rates.leaderboard(_eff(t), "goals", where=F.col("position") == "BUILDING").select("player_id", "team", "value")


@query("leaderboard_per_90", f"""
SELECT player_id, team, round(assists / minutes * 90, 6) AS value FROM ({EFF}) WHERE assists > 0 AND minutes >= 270
ORDER BY assists / minutes * 90 DESC, player_id LIMIT 15""")
def _(t):
    return r6(rates.leaderboard(_eff(t), "assists", mode="per90").select("player_id", "team", "value"), "value")


@query("fair_play", f"""
SELECT team, sum(yellow_cards)::BIGINT AS yellow_cards, sum(red_cards)::BIGINT AS red_cards, sum(indirect_red_cards)::BIGINT AS indirect_red_cards,
  (sum(yellow_cards) + 3 * (sum(red_cards) + sum(indirect_red_cards)))::BIGINT AS fair_play_points
FROM stats JOIN entries USING (player_id) WHERE {ACTIVE} GROUP BY 1""")
def _(t):
    return rates.fair_play(t.player_stats.join(joins.active_only(t.entries).select("player_id", "team"), "player_id"))


@query("discipline_ranking", """
SELECT player_id, display_name, yellow_cards, red_cards + indirect_red_cards AS reds, yellow_cards + 3 * (red_cards + indirect_red_cards) AS points,
  (yellow_cards + 3 * (red_cards + indirect_red_cards)) || ' pts' AS label
FROM stats JOIN players USING (player_id) WHERE yellow_cards + 3 * (red_cards + indirect_red_cards) > 0""")
def _(t):
    named = t.player_stats.join(t.players.select("player_id", "display_name"), "player_id")
    return rates.discipline(named).select("player_id", "display_name", "yellow_cards", "reds", "points", "label")


REPEATED = """
rp AS (SELECT player_id, date_of_birth, birth_country FROM players WHERE player_id % 3 <> 0
  UNION ALL SELECT player_id, DATE '1990-01-01', 'X' FROM players WHERE player_id % 3 = 0),
rl AS (SELECT player_id, CASE WHEN player_id % 5 = 0 THEN (SELECT min(club_id) FROM clubs) ELSE club_id END AS club_id FROM links),
rc AS (SELECT club_id, CASE WHEN club_id % 4 = 0 THEN 'Y' ELSE country END AS country FROM clubs)"""


@query("scorecard_repeated_keys", f"""
WITH {REPEATED}
SELECT team_code, count(*) AS squad_size, coalesce(sum(caps), 0)::BIGINT AS total_caps, count(*) FILTER (birth_country = team) AS home_born,
  count(*) FILTER (date_diff('day', date_of_birth, DATE '{AS_OF}') / 365.25 < 23) AS under_23,
  count(DISTINCT rl.club_id) AS clubs, count(*) FILTER (rc.country = team) AS domestic
FROM entries LEFT JOIN rp USING (player_id) LEFT JOIN rl USING (player_id) LEFT JOIN rc USING (club_id) WHERE {ACTIVE} GROUP BY 1""")
def _(t):
    twice = lambda df, more: df.withColumn("version", F.lit(1)).unionByName(more.withColumn("version", F.lit(2)))
    p, l, c = t.players, t.links, t.clubs
    p = twice(p, p.filter("player_id % 3 = 0").withColumns({"date_of_birth": F.lit("1990-01-01").cast("date"), "birth_country": F.lit("X")}))
    least = c.agg(F.min("club_id").alias("m")).scalar()
    l = twice(l, l.filter("player_id % 5 = 0").withColumn("club_id", least))
    c = twice(c, c.filter("club_id % 4 = 0").withColumn("country", F.lit("Y")))
    out = composition.composition_scorecard(t.teams.withColumn("version", F.lit(1)), t.entries, p, l, c, AS_OF, order_by=["version"])
    return out.select("team_code", "squad_size", F.coalesce("total_caps", F.lit(0)).alias("total_caps"), "home_born", "under_23", "clubs", "domestic").filter("squad_size > 0")


def repeated(t):
    """Players, links and clubs of which some have a second, later version."""
    twice = lambda df, more: df.withColumn("version", F.lit(1)).unionByName(more.withColumn("version", F.lit(2)))
    p, l, c = t.players, t.links, t.clubs
    least = c.agg(F.min("club_id").alias("m")).scalar()
    return (
        twice(p, p.filter("player_id % 3 = 0").withColumns({"date_of_birth": F.lit("1990-01-01").cast("date"), "birth_country": F.lit("X")})),
        twice(l, l.filter("player_id % 5 = 0").withColumn("club_id", least)), twice(c, c.filter("club_id % 4 = 0").withColumn("country", F.lit("Y"))),
    )


@query("breakdown_repeated_keys", f"""
WITH {REPEATED}
SELECT team_code, e.team, coalesce(country, 'Unknown') AS country, count(*) AS members, coalesce(bool_or(country = e.team), false) AS is_own
FROM entries e LEFT JOIN rl USING (player_id) LEFT JOIN rc USING (club_id) WHERE {ACTIVE} GROUP BY 1, 2, 3""")
def _(t):
    _, l, c = repeated(t)
    return composition.group_breakdown(t.entries, l, c, order_by=["version"])


@query("card_repeated_keys", f"""
WITH {REPEATED}
SELECT player_id, birth_country, team, 2 * caps AS caps, club_id, country, 3 * minutes_played AS minutes_played
FROM rp LEFT JOIN entries USING (player_id) LEFT JOIN rl USING (player_id) LEFT JOIN rc USING (club_id) LEFT JOIN stats USING (player_id) WHERE player_id IN (3, 5, 15, 16, 30, 91)""")
def _(t):
    p, l, c = repeated(t)
    again = lambda df, column, times: df.withColumn("version", F.lit(1)).unionByName(df.withColumns({"version": F.lit(2), column: F.col(column) * times}))
    out = facets.player_card([3, 5, 15, 16, 30, 91], again(t.entries, "caps", 2), p, l, c, again(t.player_stats, "minutes_played", 3), order_by=["version"])
    return out.select("player_id", "birth_country", "team", "caps", "club_id", "country", "minutes_played")


@query("team_table", _records_sql("team", False))
def _(t):
    return rates.team_table(matches.team_records(t.matches, ["team"], mode="scoreline"), "goals_for")


@query("goals_vs_expected", """
WITH e AS (SELECT o_custkey AS k, count(*) AS goals, sum(o_totalprice) / 250000 AS xg FROM orders GROUP BY 1)
SELECT k, goals, round(xg, 6) AS xg, round(goals - xg, 6) AS difference,
  CASE WHEN goals - xg > 0.5 THEN 'over' WHEN goals - xg < -0.5 THEN 'under' ELSE 'par' END AS verdict,
  (ceil(greatest(max(goals) OVER (), max(xg) OVER ()) / 2) * 2)::BIGINT AS axis_max FROM e""")
def _(t):
    e = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("goals"), (F.sum("o_totalprice") / 250000).alias("xg")
    )
    return r6(rates.goals_vs_expected(e, "goals", "xg"), "xg", "difference")


@query("group_breakdown", f"""
SELECT team_code, e.team, coalesce(country, 'Unknown') AS country, count(*) AS members, coalesce(bool_or(country = e.team), false) AS is_own
FROM entries e LEFT JOIN links USING (player_id) LEFT JOIN clubs USING (club_id) WHERE {ACTIVE} GROUP BY 1, 2, 3""")
def _(t):
    return composition.group_breakdown(t.entries, t.links, t.clubs)


@query("squad_totals", f"""
SELECT team_code, count(*) AS squad_size, sum(coalesce(caps, 0))::BIGINT AS total_caps, sum(coalesce(minutes_played, 0))::BIGINT AS total_minutes,
  round(avg(date_diff('day', date_of_birth, DATE '{AS_OF}')) / 365.25, 6) AS average_age, count(DISTINCT club_id) AS clubs,
  count(DISTINCT country) AS countries
FROM entries LEFT JOIN players USING (player_id) LEFT JOIN stats USING (player_id) LEFT JOIN links USING (player_id)
LEFT JOIN clubs USING (club_id) WHERE {ACTIVE} GROUP BY 1""")
def _(t):
    return r6(composition.squad_totals(t.entries, t.players, t.links, t.clubs, t.player_stats, AS_OF), "average_age")


POSITION_ORDER = ["HOUSEHOLD", "BUILDING", "MACHINERY"]


@query("roster_view", f"""
SELECT team_code, player_id, display_name, floor(date_diff('day', date_of_birth, DATE '{AS_OF}') / 365.25)::INT AS age,
  coalesce(nullif(list_position(['HOUSEHOLD', 'BUILDING', 'MACHINERY'], primary_position), 0), 4)::INT AS position_rank, club_name, caps
FROM entries LEFT JOIN players USING (player_id) LEFT JOIN links USING (player_id) LEFT JOIN clubs USING (club_id) WHERE {ACTIVE}""")
def _(t):
    return composition.roster_view(t.entries, t.players, t.links, t.clubs, AS_OF, POSITION_ORDER).select(
        "team_code", "player_id", "display_name", "age", "position_rank", "club_name", "caps"
    )


@query("current_stage", f"SELECT arg_max(stage, {RANK}) AS current_stage FROM matches WHERE status = 'played'")
def _(t):
    return matches.current_stage(t.matches, STAGES)


@query("match_groups", f"""
SELECT match_id, stage AS group_key, {RANK}::INT AS group_rank, match_date::VARCHAR AS match_date FROM matches WHERE stage <> '5-LOW' AND city = 'ASIA'""")
def _(t):
    out = matches.match_groups(t.matches, STAGES, view="knockout", where=F.col("city") == "ASIA")
    return out.select("match_id", "group_key", "group_rank", F.col("match_date").cast("string").alias("match_date"))


for view, kept in (("scheduled", "status = 'scheduled'"), ("groups", "stage = '5-LOW'"), ("all", "true")):
    @query(f"match_groups_{view}", f"""
SELECT match_id, city AS group_key, {RANK}::INT AS group_rank, match_date::VARCHAR AS match_date FROM matches WHERE {kept}""")
    def _(t, view=view):
        out = matches.match_groups(t.matches, STAGES, view=view, group="city")
        return out.select("match_id", "group_key", "group_rank", F.col("match_date").cast("string").alias("match_date"))


KO = """
WITH c AS (SELECT c_custkey, floor(c_acctbal + 1000)::BIGINT AS power FROM customer),
b AS (SELECT r, c_custkey >> (r - 1) AS block, arg_max(c_custkey, (power, c_custkey)) AS w, max(power) AS power
      FROM c, (VALUES (1), (2), (3)) v(r) GROUP BY 1, 2),
ko AS (SELECT h.r AS round_no, h.block >> 1 AS slot, (h.block >> 1) >> (3 - h.r) AS tournament, h.r || '-' || (h.block >> 1) AS match_id,
  h.w AS home_team, a.w AS away_team, (h.power // 2000)::INT AS home_score, (a.power // 2000)::INT AS away_score,
  CASE WHEN (h.power, h.w) > (a.power, a.w) THEN h.w ELSE a.w END AS winner
  FROM b h JOIN b a ON h.r = a.r AND h.block % 2 = 0 AND a.block = h.block + 1)"""


@query("bracket", KO + """
SELECT k.tournament, k.round_no, k.match_id, k.home_team, k.away_team, k.winner, 3 - k.round_no AS depth,
  h.match_id AS home_feeder, a.match_id AS away_feeder
FROM ko k LEFT JOIN ko h ON h.round_no = k.round_no - 1 AND h.winner = k.home_team AND h.tournament = k.tournament
LEFT JOIN ko a ON a.round_no = k.round_no - 1 AND a.winner = k.away_team AND a.tournament = k.tournament""")
def _(t):
    out = matches.bracket(t.knockout.drop("round_no"), ["Quarter-final", "Semi-final", "Final"])
    return out.select("tournament", "round_no", "match_id", "home_team", "away_team", "winner", "depth", "home_feeder", "away_feeder")


@query("bracket_path", KO + """
SELECT tournament, team, count(*) AS played, max(round_no) AS last_round, coalesce(bool_or(round_no = 3 AND winner = team), false) AS champion
FROM (SELECT tournament, round_no, winner, unnest([home_team, away_team]) AS team FROM ko) GROUP BY 1, 2""")
def _(t):
    return matches.bracket_path(matches.bracket(t.knockout.drop("round_no"), ["Quarter-final", "Semi-final", "Final"]))


@query("third_place", """
SELECT city, arg_min(match_id, (match_date, match_id)) AS match_id, arg_min(home_team, (match_date, match_id)) AS home_team
FROM matches WHERE stage = '5-LOW' GROUP BY 1""")
def _(t):
    return matches.third_place(t.matches, "5-LOW", by=["city"]).select("city", "match_id", "home_team")


@query("semi_final_losers", KO + """
SELECT tournament, match_id, CASE WHEN winner = home_team THEN away_team ELSE home_team END AS team FROM ko WHERE round_no = 2""")
def _(t):
    return matches.semi_final_losers(matches.bracket(t.knockout.drop("round_no"), ["Quarter-final", "Semi-final", "Final"]))


@query("percent_label", "SELECT player_id, CASE WHEN minutes_played > 0 THEN floor(goals * 100 / minutes_played)::INT || '%' ELSE 'N/A' END AS out FROM stats")
def _(t):
    share = F.floor(F.col("goals") * 100 / F.col("minutes_played")) / 100
    return t.player_stats.select("player_id", num.pct_label(F.when(F.col("minutes_played") > 0, share)).alias("out"))
