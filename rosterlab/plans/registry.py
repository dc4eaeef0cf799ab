"""Registration of queries and of the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FIRST_LINES = """first_lines AS (
  SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey, l_partkey)) AS l_suppkey FROM lineitem GROUP BY 1)"""

# The adapters, restated as SQL common table expressions; `needs` gives the order they build in.
SHAPES = {
    "teams": (
        [],
        """teams AS (SELECT n_nationkey AS team_code, n_name AS team, r_name AS category
  FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    ),
    "players": (
        [],
        """players AS (
  SELECT c_custkey AS player_id, c_name AS display_name,
    CASE WHEN s <> 'P' THEN CAST(d - to_months(CAST(12 * (20 + abs(floor(c_acctbal))::INT % 18) AS INT)) AS DATE) END AS date_of_birth,
    n_name AS birth_country, c_mktsegment AS primary_position
  FROM customer
  LEFT JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS d, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s
             FROM orders GROUP BY 1) ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN c_nationkey
                                         WHEN c_mktsegment <> 'HOUSEHOLD' THEN 24 - c_nationkey END)""",
    ),
    "entries": (
        [],
        """entries AS (
  SELECT c_custkey AS player_id, c_nationkey AS team_code, n_name AS team, c_mktsegment AS position_group,
    CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal)::INT END AS caps,
    CASE WHEN c_acctbal >= 9000 THEN 'removed' ELSE 'active' END AS squad_status, c_acctbal < -500 AS is_replacement
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    ),
    "clubs": (
        [],
        """clubs AS (
  SELECT s_suppkey AS club_id, s_name AS club_name, n_name AS country, CASE WHEN s_acctbal >= 0 THEN r_name END AS league,
    CASE WHEN s_acctbal >= 0 THEN n_name || '-' || floor(s_acctbal / 2500)::INT END AS city,
    CASE WHEN s_acctbal >= 1000 THEN (s_suppkey * 37 % 180 - 90)::DOUBLE END AS lat,
    CASE WHEN s_acctbal >= 1000 THEN (s_suppkey * 91 % 360 - 180)::DOUBLE END AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    ),
    "first_lines": ([], FIRST_LINES),
    "links": (
        ["first_lines", "entries"],
        """links AS (
  SELECT player_id, club_id, team FROM (
    SELECT o_custkey, arg_min(l_suppkey, o_orderkey) AS club_id FROM orders JOIN first_lines ON o_orderkey = l_orderkey GROUP BY 1)
  JOIN entries ON o_custkey = player_id)""",
    ),
    "stats": (
        [],
        """stats AS (
  SELECT o_custkey AS player_id, sum(l_quantity)::BIGINT AS minutes_played,
    count(*) FILTER (l_returnflag = 'R') AS goals, count(*) FILTER (l_returnflag = 'A') AS assists,
    count(*) FILTER (l_discount >= 0.09) AS yellow_cards,
    count(*) FILTER (l_discount >= 0.09 AND l_tax >= 0.07) AS red_cards,
    count(*) FILTER (l_discount >= 0.09 AND l_tax = 0) AS indirect_red_cards
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""",
    ),
    "matches": (
        ["first_lines"],
        """matches0 AS (
  SELECT o_orderkey AS match_id, o_orderdate::DATE AS match_date, o_orderpriority AS stage, h.n_name AS home_team,
    a.n_name AS away_team, hs AS home_score, aws AS away_score, o_orderstatus AS stadium, r_name AS city,
    CASE WHEN hs IS NULL THEN 'scheduled' ELSE 'played' END AS status, floor(o_totalprice)::BIGINT % 2 = 0 AS even,
    hs = aws AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS shootout
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation h ON c_nationkey = h.n_nationkey
  JOIN region ON h.n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, (count(*) FILTER (l_returnflag = 'A'))::INT AS hs, (count(*) FILTER (l_returnflag = 'R'))::INT AS aws
             FROM lineitem GROUP BY 1) g ON o_orderkey = g.l_orderkey
  LEFT JOIN first_lines f ON o_orderkey = f.l_orderkey LEFT JOIN supplier ON s_suppkey = f.l_suppkey
  LEFT JOIN nation a ON s_nationkey = a.n_nationkey),
matches AS (
  SELECT * EXCLUDE (even, shootout), CASE WHEN shootout THEN CASE WHEN even THEN 4 ELSE 3 END END AS home_pens,
    CASE WHEN shootout THEN CASE WHEN even THEN 3 ELSE 4 END END AS away_pens FROM matches0)""",
    ),
    "decided": (
        ["matches"],
        """decided AS (
  SELECT *, CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away'
    WHEN home_pens > away_pens THEN 'home' WHEN home_pens < away_pens THEN 'away' WHEN home_score = away_score THEN 'draw' END AS result
  FROM matches WHERE status = 'played')""",
    ),
    "doc_lines": (
        [],
        """doc_lines AS (
  SELECT doc_id, lang, source, unnest(range(len(l)))::INT AS pos, unnest(l) AS value FROM (
    SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents))""",
    ),
}


def with_shapes(sql: str) -> str:
    """Put the common table expressions a query names in front of it."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in SHAPES[name][0]:
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in SHAPES:
        if re.search(rf"(?i)\b(from|join)\s+{name}\b", sql):
            add(name)
    if not wanted:
        return sql
    ctes = ",\n".join(SHAPES[n][1] for n in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = with_shapes(sql)
        return fn

    return wrap
