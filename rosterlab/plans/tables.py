"""Sources, joins, diffs and quality checks with the SQL for each."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from ..operators import diff, joins, quality
from ..session import shared_folder
from ..skew import number_rows
from ..sources import parsers, readers, writers
from .expressions import RAW, raw_values
from .registry import query

# ---------------------------------------------------------------- sources and sinks


@query("typed_table", f"""
SELECT o_orderkey, CASE lower(trim(b)) WHEN 'true' THEN true WHEN 'false' THEN false END AS b,
  CASE WHEN try_cast(nullif(trim(n), '') AS DOUBLE) = floor(try_cast(nullif(trim(n), '') AS DOUBLE)) THEN try_cast(nullif(trim(n), '') AS DOUBLE)::INT END AS n
FROM ({RAW})""")
def _(t):
    return readers.typed(raw_values(t), {"b": "bool", "n": "int"}, ["o_orderkey"])[0]


@query("typed_rejects", f"""
SELECT o_orderkey, 'b' AS field, b AS raw FROM ({RAW}) WHERE lower(trim(b)) NOT IN ('true', 'false')
UNION ALL SELECT o_orderkey, 'n', n FROM ({RAW}) WHERE trim(n) <> '' AND (try_cast(n AS DOUBLE) IS NULL OR try_cast(n AS DOUBLE) <> floor(try_cast(n AS DOUBLE)))""")
def _(t):
    return readers.typed(raw_values(t), {"b": "bool", "n": "int"}, ["o_orderkey"])[1]


@query("decode_any_encoding", r"""
SELECT doc_id, pos, CASE WHEN lang <> 'en' THEN regexp_replace(value, '[^\x{0000}-\x{00FF}]', '?', 'g') ELSE value END AS line,
  CASE WHEN lang <> 'en' AND doc_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '[\x{0080}-\x{00FF}]')) THEN 'ISO-8859-1' ELSE 'utf-8' END AS source_encoding
FROM doc_lines""")
def _(t):
    narrow = F.regexp_replace("value", r"[^\x00-\xFF]", "?")
    raw = F.when(F.col("lang") != "en", F.encode(narrow, "ISO-8859-1")).otherwise(F.encode("value", "UTF-8"))
    return readers.decode_lines(t.doc_lines.select("doc_id", "pos", raw.alias("raw")), "doc_id")


@query("json_table", "SELECT event_id, user_id, json_extract(props, '$.k')::INT AS k FROM events")
def _(t):
    return t.events.select("event_id", "user_id", F.from_json("props", "k int").alias("p")).select("event_id", "user_id", "p.k")


@query("trim_blank_rows_cols", "SELECT o_orderkey, n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE ' ' END AS n FROM orders) WHERE o_orderkey IS NOT NULL OR trim(n) <> ''")
def _(t):
    raw = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias(" o_orderkey"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise(" ").alias("n"), F.lit("x").alias("_c9"),
    )
    return readers.trim_blank_rows_cols(raw)


@query("choose_source", "SELECT c_custkey, c_name FROM customer")
def _(t):
    primary = t.supplier.select("s_suppkey")
    return readers.choose_source(primary, t.customer.select("c_custkey", "c_name"), ["s_suppkey", "city_key"], ["s_suppkey"])[0]


def fresh_folder(t) -> str:
    """A new folder under the shared one, for a query that writes files and reads them back."""
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query("csv_files", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def _(t):
    path = fresh_folder(t)
    writers.write_snapshot(t.orders.select("o_totalprice", "o_orderkey", "o_orderpriority"), path)
    back = readers.typed(readers.read_table(t.spark, path), {"o_orderkey": "int", "o_totalprice": "float"}, ["o_orderkey"])[0]
    return back.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("csv_files_any_encoding", r"""
SELECT doc_id::VARCHAR AS doc_id, pos::VARCHAR AS pos, CASE WHEN lang = 'fr' THEN regexp_replace(value, '[^\x{0000}-\x{00FF}]', '?', 'g') ELSE value END AS value
FROM doc_lines""")
def _(t):
    """French lines in Latin-1 under one header, the others in UTF-8 under another; an empty line is an empty cell."""
    path, rows = fresh_folder(t), t.doc_lines
    put = lambda df, name, encoding: df.write.csv(f"{path}/{name}", header=True, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    narrow = F.regexp_replace("value", r"[^\x00-\xFF]", "?").alias("value")
    put(rows.filter("lang = 'fr'").select(narrow, "doc_id", "pos"), "latin", "ISO-8859-1")
    put(rows.filter("lang <> 'fr' OR lang IS NULL").select("doc_id", "value", "pos"), "utf8", "UTF-8")
    return readers.read_text_csv_any(t.spark, f"{path}/*", ["doc_id", "pos", "value"]).select("doc_id", "pos", "value")


@query("json_files", "SELECT event_id, event_type, json_extract(props, '$.k')::INT AS k FROM events")
def _(t):
    path = fresh_folder(t)
    t.events.select("event_id", "event_type", F.from_json("props", "k int").alias("props")).write.json(path)
    back = readers.read_json_table(t.spark, path, "event_id long, event_type string, props struct<k: int>", lines=True)
    return back.select("event_id", "event_type", "props.k")


@query("text_files", "SELECT o_orderkey::VARCHAR AS value, true AS in_order FROM orders")
def _(t):
    """Numbers written in order, read with positions that must rise with them."""
    path = fresh_folder(t)
    t.orders.select("o_orderkey").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").select(F.col("o_orderkey").cast("string")).write.text(path)
    before = F.lag(F.col("value").cast("long")).over(W.partitionBy("file").orderBy("pos"))
    return readers.read_lines(t.spark, path).select("value", F.coalesce(before < F.col("value").cast("long"), F.lit(True)).alias("in_order"))


@query("union_header_files", """
SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment, NULL AS balance FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name, NULL, s_acctbal::DOUBLE::VARCHAR FROM supplier""")
def _(t):
    path = fresh_folder(t)
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    writers.write_snapshot(writers.union_header([a, b]), path)
    return readers.read_table(t.spark, path)


STEP = 10**12  # room for the keys under one heading or date


def sectioned_lines(t):
    """A list per region: nations as headings, customers as member lines."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    base = F.col("n_nationkey").cast("long") * STEP
    head = n.select(F.col("r_name").alias("file"), base.alias("pos"), F.format_string("# %s (%d)", "n_name", "n_nationkey").alias("value"))
    src = n.select("r_name", base + 1, F.concat(F.lit("## Source: http://host/"), "n_name"))
    body = n.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "r_name", base + 2 + F.col("c_custkey"), F.concat(F.col("c_mktsegment"), F.lit(" , "), F.col("c_name"), F.lit("."))
    )
    return head.union(src).union(body)


@query("parse_sectioned_text", """
WITH m AS (SELECT r_name AS file, n_nationkey, n_name, c_custkey, unnest([c_mktsegment, c_name]) AS member, unnest([0, 1]) AS item_pos
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT file, n_nationkey::VARCHAR AS code, n_name AS name, 'http://host/' || n_name AS source_url, member, min(c_custkey) AS first_seen
FROM m GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    out = parsers.parse_sectioned_text(sectioned_lines(t))
    return out.select("file", "code", "name", "source_url", "member", (F.col("member_pos") % STEP - 2).alias("first_seen"))


def fixture_lines(t):
    """A fixtures file per venue: date lines, then one line per match; unplayed ones are cut short."""
    day = F.unix_date("match_date").cast("long") * STEP
    m = t.matches
    dates = m.select(F.col("stadium").alias("file"), day.alias("pos"), F.date_format("match_date", "EEEE d MMMM yyyy").alias("value")).distinct()
    score = lambda s: F.when(F.col(f"{s}_pens").isNull(), F.col(f"{s}_score").cast("string")).otherwise(
        F.format_string("%d (%d)", f"{s}_score", f"{s}_pens")
    )
    full = F.concat_ws("|", "home_team", score("home"), score("away"), "away_team", "stage", F.lit("-"), "stadium", "city")
    rows = m.select("stadium", day + 1 + F.col("match_id"), F.when(F.col("status") == "played", full).otherwise(F.concat_ws("|", "home_team", F.lit("-"))))
    return dates.union(rows)


@query("parse_carried_date_lines", """
SELECT match_id, strftime(match_date, '%A %-d %B %Y') AS match_date, home_team, away_team, home_score, away_score, home_pens, away_pens, stage, stadium, city, status
FROM matches WHERE status = 'played'""")
def _(t):
    out = parsers.parse_carried_date_lines(fixture_lines(t))
    return out.withColumn("match_id", F.col("pos") % STEP - 1).drop("file", "pos", "group")


@query("parse_list_of_pairs", """
SELECT c_custkey, c_name AS name, c_mktsegment AS detail FROM customer UNION ALL SELECT c_custkey, 'Sub', CASE WHEN c_acctbal > 0 THEN 'Away, East' ELSE '' END FROM customer""")
def _(t):
    cell = F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit("), Sub"), F.when(F.col("c_acctbal") > 0, " (Away, East)").otherwise(""))
    return t.customer.select("c_custkey", F.explode(parsers.parse_list_of_pairs(cell)).alias("p")).select("c_custkey", "p.*")


@query("parse_pairs_from_cell", """
SELECT DISTINCT o_orderpriority AS role, unnest([o_orderstatus, 'Ref']) AS name, unnest([o_custkey::VARCHAR, 'Home']) AS country FROM orders""")
def _(t):
    cell = F.concat("o_orderstatus", F.lit(" ( "), F.col("o_custkey").cast("string"), F.lit(" ) Ref ( Home )"))
    return parsers.parse_pairs_from_cell(t.orders.select(F.col("o_orderpriority").alias("role"), cell.alias("cell")), "cell", "role")


@query("assemble_roster_rows", """
SELECT r_name AS "group", n_name AS team, CASE WHEN c_acctbal < 2000 THEN 'goalkeepers' ELSE 'forwards' END AS section, 'Boss ' || n_name AS manager,
  c_name AS player, c_mktsegment AS club,
  left(sha1(n_name || '||' || CASE WHEN c_acctbal < 2000 THEN 'goalkeepers' ELSE 'forwards' END || '||' || c_name || '||' || c_mktsegment), 16) AS row_hash
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    base = F.col("n_nationkey").cast("long") * STEP
    section = F.when(F.col("c_acctbal") < 2000, "Goalkeepers: ").otherwise("Forwards: ")
    lines = (
        n.select(F.lit("page").alias("page"), base.alias("pos"), F.lit("h2").alias("tag"), F.col("r_name").alias("text"))
        .union(n.select(F.lit("page"), base + 1, F.lit("h3"), "n_name"))
        .union(n.select(F.lit("page"), base + 2, F.lit("p"), F.concat(F.lit("Manager: Boss "), "n_name")))
        .union(
            n.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).select(
                F.lit("page"), base + 3 + F.col("c_custkey"), F.lit("p"), F.concat(section, "c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))
            )
        )
    )
    return parsers.assemble_roster_rows(lines).select("group", "team", "section", "manager", "player", "club", "row_hash")


@query("union_header", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return writers.union_header([a, b])


@query("export_manifest", " UNION ALL ".join(
    f"SELECT '{n}' AS entity, count(*) AS rows, '2026-07-14' AS exported_at, 'tables' AS source FROM {n}" for n in ("customer", "orders", "lineitem", "events")))
def _(t):
    return writers.export_manifest({n: t.read(n) for n in ("customer", "orders", "lineitem", "events")}, "2026-07-14", "tables")


@query("csv_projection", """
SELECT doc_id || ',' || CASE WHEN regexp_matches(text, '[,"\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || lang AS line FROM documents""")
def _(t):
    return writers.csv_projection(t.documents, {"doc_id": "Document", "text": "Text", "lang": "Language"})


# ---------------------------------------------------------------- joins and lookups


@query("lookup_last_wins", """
SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus
  FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    dim = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderstatus")
    return joins.lookup(t.customer.select("c_custkey", "c_name"), dim, "c_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("lookup_salted", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def _(t):
    left = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return joins.lookup(left, t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", salt=4)


ROSTER = """SELECT player_id, team, team_code, caps, display_name, primary_position, club_id, club_name, country, league
FROM entries LEFT JOIN players USING (player_id) LEFT JOIN (SELECT player_id, club_id FROM links) USING (player_id) LEFT JOIN clubs USING (club_id)"""
ROSTER_COLS = ["player_id", "team", "team_code", "caps", "display_name", "primary_position", "club_id", "club_name", "country", "league"]


@query("roster", ROSTER + " WHERE squad_status = 'active'")
def _(t):
    return joins.roster(t.entries, t.players, t.links, t.clubs).select(*ROSTER_COLS)


@query("roster_whole_population", ROSTER)
def _(t):
    return joins.roster(t.entries, t.players, t.links, t.clubs, active=False).select(*ROSTER_COLS)


@query("active_only", "SELECT player_id, team FROM entries WHERE squad_status = 'active' OR team = 'NATION_4'")
def _(t):
    e = t.entries.withColumn("squad_status", F.when(F.col("team") == "NATION_4", " ").otherwise(F.col("squad_status")))
    return joins.active_only(e).select("player_id", "team")


@query("members_of", "SELECT club_id, player_id, display_name FROM links JOIN players USING (player_id) WHERE player_id IN (SELECT player_id FROM entries WHERE squad_status = 'active')")
def _(t):
    return joins.members_of(t.links, t.entries, t.players.select("player_id", "display_name"))


@query("groups_of", "SELECT DISTINCT club_id, team FROM links")
def _(t):
    return joins.groups_of(t.links)


@query("context_join", """
SELECT c_custkey, c_name, p AS o_orderpriority, e AS event_type FROM customer
LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, arg_min(event_type, event_id) AS e FROM events WHERE user_id IN (SELECT o_custkey FROM orders) GROUP BY 1) ON user_id = c_custkey""")
def _(t):
    squad = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    link = t.events.select(F.col("user_id").alias("c_custkey"), "event_id", "event_type")
    out = joins.context_join(t.customer.select("c_custkey", "c_name"), squad, link, "c_custkey", ["o_orderkey"], ["event_id"])
    return out.select("c_custkey", "c_name", "o_orderpriority", "event_type")


@query("category_of", """
SELECT c_custkey, c_mktsegment AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'own' WHEN 'MACHINERY' THEN r_name END AS category
FROM customer LEFT JOIN region ON r_regionkey = 1""")
def _(t):
    r = t.region.filter("r_regionkey <= 1")
    members = r.select(F.col("r_name").alias("member"), F.col("r_name").alias("category")).union(
        t.region.filter("r_regionkey = 0").select(F.lit("BUILDING"), F.lit("own"))
    )
    aliases = t.region.select(F.lit("MACHINERY").alias("name"), F.col("r_name").alias("alias"), (-F.col("r_regionkey")).alias("alias_no"))
    return joins.category_of(t.customer.select("c_custkey", F.col("c_mktsegment").alias("name")), "name", members, aliases)


@query("geo_backfill", """
SELECT club_id, club_name, country, league, city AS city_key, true AS baseline_found FROM clubs WHERE city IS NOT NULL""")
def _(t):
    clubs = t.clubs.filter("city is not null")
    city = clubs.select(F.col("city").alias("city_key"), F.concat_ws("|", F.col("club_id").cast("string"), F.lit("")).alias("club_ids"))
    arrays = joins.explode_pipe_ids(city, "club_ids", "club_id").select("city_key", F.array(F.col("club_id").cast("long")).alias("club_ids"))
    return joins.geo_backfill(clubs.select("club_id", "club_name"), clubs.select("club_id", "country", "league"), arrays)


@query("apply_results", """
SELECT c_custkey, CASE WHEN ok THEN 'new' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN ok THEN 0 ELSE c_acctbal END AS c_acctbal FROM (
  SELECT c.*, s_suppkey IS NOT NULL AND s_acctbal >= 0 AS ok FROM customer c LEFT JOIN supplier ON s_suppkey = c_custkey)""")
def _(t):
    results = t.supplier.select(
        F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") >= 0, "new").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal")
    )
    work = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return joins.apply_results(work, results, "c_custkey", ["c_mktsegment", "c_acctbal"], ["c_mktsegment", "c_acctbal"])


def blanked(t):
    a = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(" ").alias("seg"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("nm"))
    b = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("seg"), F.min("o_orderstatus").alias("nm"))
    return a, b


BLANKED = """blanked AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE ' ' END AS seg, CASE WHEN c_acctbal > 5000 THEN c_name END AS nm, p, s
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p, min(o_orderstatus) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query("fill_blank", f"""
WITH {BLANKED} SELECT c_custkey, CASE WHEN trim(seg) = '' AND p IS NOT NULL THEN p ELSE seg END AS seg, trim(seg) = '' AND p IS NOT NULL AS seg_filled,
  CASE WHEN nm IS NULL AND s IS NOT NULL THEN s ELSE nm END AS nm, nm IS NULL AND s IS NOT NULL AS nm_filled FROM blanked""")
def _(t):
    return joins.fill_blank(*blanked(t), "c_custkey", ["seg", "nm"])


@query("fill_counts", f"""
WITH {BLANKED} SELECT 'seg' AS field, count(*) FILTER (trim(seg) = '' AND p IS NOT NULL) AS filled FROM blanked
UNION ALL SELECT 'nm', count(*) FILTER (nm IS NULL AND s IS NOT NULL) FROM blanked""")
def _(t):
    return joins.fill_counts(joins.fill_blank(*blanked(t), "c_custkey", ["seg", "nm"]), ["seg", "nm"])


@query("attach_attributes", """
SELECT c_custkey, c_name, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1) ON user_id = c_custkey""")
def _(t):
    src = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return joins.attach_attributes(t.customer.select("c_custkey", "c_name"), src, ["c_custkey"], ["n", "v"])


@query("prefix_candidates", r"""
WITH p AS (SELECT DISTINCT p_brand, CASE WHEN p_size < 20 THEN upper(p_name) || ' City' ELSE split_part(p_name, ' ', 1) END AS name FROM part),
c AS (SELECT DISTINCT p_brand, p_name AS candidate FROM part),
x AS (SELECT p.p_brand, name, candidate, regexp_replace(lower(name), ' city$', '') AS name_simple, lower(candidate) AS candidate_simple
  FROM p JOIN c ON p.p_brand = c.p_brand WHERE NOT EXISTS (SELECT 1 FROM c c2 WHERE c2.p_brand = p.p_brand AND c2.candidate = p.name))
SELECT *, CASE WHEN name_simple = candidate_simple THEN 'equal after dropping generic words'
  WHEN starts_with(candidate_simple, name_simple || ' ') THEN 'name is contained in candidate' ELSE 'candidate is contained in name' END AS review_reason
FROM x WHERE name_simple = candidate_simple OR starts_with(candidate_simple, name_simple || ' ') OR starts_with(name_simple, candidate_simple || ' ')""")
def _(t):
    name = F.when(F.col("p_size") < 20, F.concat(F.upper("p_name"), F.lit(" City"))).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    people = t.part.select("p_brand", name.alias("name"))
    return joins.prefix_candidates(people, t.part.select("p_brand", F.col("p_name").alias("candidate")), "p_brand", "name", "candidate")


# ---------------------------------------------------------------- diffs and reconciliation

PREV = "prev AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderdate < DATE '2001-01-01')"
CURR = """curr AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice + 10, 2) ELSE round(o_totalprice, 2) END AS price FROM orders WHERE o_orderdate >= DATE '1995-06-01')"""


def snapshots(t):
    day = F.col("o_orderdate").cast("date")
    price = F.round("o_totalprice", 2)
    prev = t.orders.filter(day < F.lit("2001-01-01").cast("date")).select("o_orderkey", "o_orderstatus", price.alias("price"))
    curr = t.orders.filter(day >= F.lit("1995-06-01").cast("date")).select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderstatus") == "P", F.round(F.col("o_totalprice") + 10, 2)).otherwise(price).alias("price"),
    )
    return prev, curr


@query("orphans", "SELECT DISTINCT user_id AS key FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def _(t):
    return diff.orphans(t.events, t.supplier, "user_id", "s_suppkey")


@query("present_only_in", f"WITH {PREV}, {CURR} SELECT * FROM prev WHERE o_orderkey NOT IN (SELECT o_orderkey FROM curr)")
def _(t):
    return diff.present_only_in(*snapshots(t), "o_orderkey")


@query("agreement_check", f"""WITH {PREV}, {CURR} SELECT o_orderkey, CASE WHEN p.price IS NULL OR c.price IS NULL THEN 'MISSING' WHEN p.price = c.price THEN 'OK' ELSE 'MISMATCH' END AS price_check
FROM prev p FULL JOIN curr c USING (o_orderkey)""")
def _(t):
    p, c = snapshots(t)
    j = p.alias("p").join(c.alias("c"), "o_orderkey", "full")
    return j.select("o_orderkey", diff.agreement_check(F.col("p.price"), F.col("c.price")).alias("price_check"))


@query("exact_pairs", """
WITH o AS (SELECT p_brand, p_name, p_partkey AS our_id, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part WHERE p_size <= 25),
h AS (SELECT p_brand, p_name, p_partkey AS their_id, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part WHERE p_size > 25)
SELECT o.p_brand, our_id, their_id FROM o JOIN h ON o.p_brand = h.p_brand AND o.p_name = h.p_name AND o.n = h.n""")
def _(t):
    ours = t.part.filter("p_size <= 25").select("p_brand", "p_name", F.col("p_partkey").alias("our_id"))
    theirs = t.part.filter("p_size > 25").select("p_brand", "p_name", F.col("p_partkey").alias("their_id"))
    return diff.exact_pairs(ours, theirs, "p_brand", "p_name", "our_id", "their_id")


@query("prefix_candidates_people", r"""
WITH q AS (SELECT p_partkey, p_brand, CASE WHEN p_size < 20 THEN upper(p_name) || ' City' ELSE split_part(p_name, ' ', 1) END AS name FROM part),
f AS (SELECT p_brand, name, min(p_partkey) AS p_partkey FROM q GROUP BY 1, 2), c AS (SELECT DISTINCT p_brand, p_name AS candidate FROM part),
x AS (SELECT f.p_brand, name, candidate, p_partkey, regexp_replace(lower(name), ' city$', '') AS a, lower(candidate) AS b
  FROM f JOIN c ON f.p_brand = c.p_brand WHERE NOT EXISTS (SELECT 1 FROM c c2 WHERE c2.p_brand = f.p_brand AND c2.candidate = f.name))
SELECT x.p_brand, name, candidate, x.p_partkey, p_type FROM x JOIN part p ON p.p_partkey = x.p_partkey WHERE a = b OR starts_with(b, a || ' ') OR starts_with(a, b || ' ')""")
def _(t):
    name = F.when(F.col("p_size") < 20, F.concat(F.upper("p_name"), F.lit(" City"))).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    people = t.part.select("p_brand", name.alias("name"), "p_partkey", "p_type")
    pairs = joins.prefix_candidates(people, t.part.select("p_brand", F.col("p_name").alias("candidate")), "p_brand", "name", "candidate")
    return joins.first_person(pairs, people, "p_brand", "name", "p_partkey", "p_type").select("p_brand", "name", "candidate", "p_partkey", "p_type")


@query("reconcile_summary", """
WITH o AS (SELECT c_nationkey AS k, count(*) AS ours FROM customer GROUP BY 1), h AS (SELECT s_nationkey AS k, count(*) AS theirs FROM supplier GROUP BY 1),
m AS (SELECT c_nationkey AS k, count(*) AS matched FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey GROUP BY 1)
SELECT k, coalesce(ours, 0) AS ours, coalesce(theirs, 0) AS theirs, coalesce(matched, 0) AS matched, coalesce(ours, 0) - coalesce(matched, 0) AS cut,
  coalesce(theirs, 0) - coalesce(matched, 0) AS new FROM o FULL JOIN h USING (k) FULL JOIN m USING (k)""")
def _(t):
    ours = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    theirs = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    return diff.reconcile_summary(ours, theirs, ours.join(theirs, ["k", "id"]), "k")


@query("reconcile_overall", """
SELECT (SELECT count(*) FROM customer) AS ours, (SELECT count(*) FROM supplier) AS theirs, count(*) AS matched, count(*) FILTER (s_suppkey % 4 = 0) AS matched_fuzzy, 0::BIGINT AS date_mismatches,
  (SELECT count(*) FROM customer) - count(*) AS cut, (SELECT count(*) FROM supplier) - count(*) AS new FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey""")
def _(t):
    ours = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    theirs = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    matched = ours.join(theirs, ["k", "id"]).withColumn("method", F.when(F.col("id") % 4 == 0, "fuzzy").otherwise("exact"))
    return diff.reconcile_overall(ours, theirs, matched)


@query("merge_precedence", f"WITH {PREV}, {CURR} SELECT * FROM curr UNION ALL SELECT * FROM prev WHERE o_orderkey NOT IN (SELECT o_orderkey FROM curr)")
def _(t):
    return diff.merge_precedence(list(snapshots(t)), "o_orderkey")


DIFF = """SELECT o_orderkey, 'o_orderstatus' AS field, p.o_orderstatus AS old_value, c.o_orderstatus AS new_value FROM prev p JOIN curr c USING (o_orderkey) WHERE p.o_orderstatus <> c.o_orderstatus
UNION ALL SELECT o_orderkey, 'price', (p.price * 100)::BIGINT::VARCHAR, (c.price * 100)::BIGINT::VARCHAR FROM prev p JOIN curr c USING (o_orderkey) WHERE p.price <> c.price"""


def cents(df):
    return df.withColumn("price", F.round(F.col("price") * 100).cast("long"))


@query("field_diff", f"WITH {PREV}, {CURR} {DIFF}")
def _(t):
    p, c = snapshots(t)
    return diff.field_diff(cents(p), cents(c), ["o_orderkey"], ["o_orderstatus", "price"])


@query("snapshot_diff", f"""
WITH {PREV}, {CURR}, d AS ({DIFF})
SELECT o_orderkey, 'changed' AS change_type, field AS field_changed, old_value, new_value FROM d
UNION ALL SELECT o_orderkey, 'removed', NULL, NULL, NULL FROM prev WHERE o_orderkey NOT IN (SELECT o_orderkey FROM curr)
UNION ALL SELECT o_orderkey, 'added', NULL, NULL, NULL FROM curr WHERE o_orderkey NOT IN (SELECT o_orderkey FROM prev)""")
def _(t):
    p, c = snapshots(t)
    return diff.snapshot_diff(cents(p), cents(c), ["o_orderkey"], ["o_orderstatus", "price"])


@query("status_updates", f"""
WITH {PREV}, {CURR} SELECT o_orderkey, 'active' AS squad_status, c.o_orderstatus FROM prev JOIN curr c USING (o_orderkey)
UNION ALL SELECT o_orderkey, 'removed', NULL FROM prev WHERE o_orderkey NOT IN (SELECT o_orderkey FROM curr)""")
def _(t):
    p, c = snapshots(t)
    matched = p.select("o_orderkey").join(c, "o_orderkey")
    return diff.status_updates(matched, diff.present_only_in(p, c, "o_orderkey"), "o_orderkey", ["o_orderstatus"])


NEW_DIMS = f"""
WITH d AS (SELECT p_name, min(p_partkey)::VARCHAR AS id FROM part WHERE p_brand = 'Brand#1' GROUP BY 1),
f AS (SELECT lower(nm) AS k, min(nm) AS nm FROM (SELECT CASE WHEN p_size < 10 THEN upper(p_name) ELSE p_name END AS nm FROM part) WHERE lower(nm) NOT IN (SELECT p_name FROM d) GROUP BY 1)"""
MINTED = "'n_' || replace(lower(nm), ' ', '_') || '_' || left(sha1(nm), 8)"


def new_entities(t):
    dims = t.part.filter("p_brand = 'Brand#1'").select("p_name", F.col("p_partkey").alias("name_id"))
    new = t.part.select("p_partkey", F.when(F.col("p_size") < 10, F.upper("p_name")).otherwise(F.col("p_name")).alias("nm"))
    return diff.new_entity_rows(new, dims, "nm", "p_name", "name_id", "n")


@query("new_entity_rows", NEW_DIMS + f"""
SELECT p_partkey, x.nm, coalesce(d.id, {MINTED.replace('nm', 'f.nm')}) AS name_id
FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN upper(p_name) ELSE p_name END AS nm FROM part) x LEFT JOIN d ON d.p_name = lower(x.nm) LEFT JOIN f ON f.k = lower(x.nm)""")
def _(t):
    return new_entities(t)[0]


@query("new_dimension_rows", NEW_DIMS + f" SELECT nm AS p_name, {MINTED} AS name_id FROM f")
def _(t):
    return new_entities(t)[1]


@query("append_missing", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 1400, s_name FROM supplier WHERE s_suppkey + 1400 NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    return diff.append_missing(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        t.supplier.select((F.col("s_suppkey") + 1400).alias("id"), F.col("s_name").alias("name")), "id",
    )


@query("append_change_log", """
WITH log AS (SELECT 'chg_' || lpad((c_custkey + 1)::VARCHAR, 9, '0') AS change_id, c_name AS note FROM customer)
SELECT * FROM log UNION ALL SELECT 'chg_' || lpad(((SELECT count(*) FROM log) + row_number() OVER (ORDER BY o_orderdate, o_orderkey))::VARCHAR, 9, '0'), o_orderkey::VARCHAR FROM orders""")
def _(t):
    log = t.customer.select(F.concat(F.lit("chg_"), F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0")).alias("change_id"), F.col("c_name").alias("note"))
    entries = t.orders.select("o_orderdate", "o_orderkey", F.col("o_orderkey").cast("string").alias("note"))
    return diff.append_change_log(log, entries, ["o_orderdate", "o_orderkey"]).select("change_id", "note")


@query("resume_pending", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    done = t.customer.select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    return diff.resume_pending(t.events.select("event_id", "user_id"), done, "user_id", F.col("c_acctbal") > 0)


@query("number_rows", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey) AS row_no FROM lineitem")
def _(t):
    order = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"]
    return number_rows(t.lineitem.select(*order), [F.col(c) for c in order])


# ---------------------------------------------------------------- integrity and quality


@query("unique_key", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return quality.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("foreign_keys", """
SELECT DISTINCT 'event_user' AS "check", user_id::VARCHAR AS key FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT DISTINCT 'pair', k::VARCHAR FROM (SELECT unnest([l_suppkey, l_partkey]) AS k FROM lineitem) WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    return quality.foreign_keys([
        ("event_user", t.events, "user_id", t.supplier, "s_suppkey"),
        ("pair", t.lineitem, F.array("l_suppkey", "l_partkey"), t.customer, "c_custkey"),
    ])


@query("cardinality", "SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) <> 10")
def _(t):
    return quality.cardinality(t.orders, "o_custkey", 10)


@query("cardinality_required", "SELECT c_custkey AS o_custkey, coalesce(n, 0) AS rows FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) <> 10")
def _(t):
    return quality.cardinality(t.orders, "o_custkey", 10, groups=t.customer.select(F.col("c_custkey").alias("o_custkey")))


@query("group_count", "SELECT 20 AS expected, count(DISTINCT n_nationkey) AS found FROM nation HAVING count(DISTINCT n_nationkey) <> 20")
def _(t):
    return quality.group_count(t.nation, "n_nationkey", 20)


@query("banned_values", "SELECT l_suppkey AS old_id, s_nationkey AS new_id, count(*) AS uses FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal < 1000 GROUP BY 1, 2")
def _(t):
    retired = t.supplier.filter("s_acctbal < 1000").select(F.col("s_suppkey").alias("old_id"), F.col("s_nationkey").alias("new_id"))
    return quality.banned_values(t.lineitem, "l_suppkey", retired)


@query("baseline_drift", f"WITH {PREV}, {CURR} {DIFF}")
def _(t):
    p, c = snapshots(t)
    return quality.baseline_drift(cents(c), cents(p), "o_orderkey", ["o_orderstatus", "price"])[0]


@query("baseline_pending", f"WITH {PREV}, {CURR} SELECT o_orderkey FROM curr WHERE o_orderkey NOT IN (SELECT o_orderkey FROM prev)")
def _(t):
    p, c = snapshots(t)
    return quality.baseline_drift(cents(c), cents(p), "o_orderkey", ["price"])[1]


@query("audit", """
SELECT 'line_key_unique' AS "check", count(*) AS rows, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'line_order_exists', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'orders_without_lines', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'PENDING' END FROM (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))""")
def _(t):
    return quality.audit(
        {
            "line_key_unique": quality.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"]),
            "line_order_exists": diff.orphans(t.lineitem, t.orders, "l_orderkey", "o_orderkey"),
        },
        pending={"orders_without_lines": diff.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey")},
    )


@query("manifest_matches", """
SELECT 'customer' AS entity, count(*) AS rows, count(*) AS counted, true AS matches FROM customer
UNION ALL SELECT 'orders', count(*), (SELECT count(*) FROM events), count(*) = (SELECT count(*) FROM events) FROM orders""")
def _(t):
    manifest = writers.export_manifest({"customer": t.customer, "orders": t.orders}, "2026-07-14", "tables")
    return quality.manifest_matches(manifest, {"customer": t.customer, "orders": t.events})


@query("coverage", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS filled, count(*) AS total, round(count({c})::DOUBLE / count(*), 6) AS share FROM players" for c in ("date_of_birth", "birth_country", "primary_position")))
def _(t):
    return quality.coverage(t.players, ["date_of_birth", "birth_country", "primary_position"]).withColumn("share", F.round("share", 6))


@query("quality_summary", """
SELECT 'birth_known' AS key, 'missing' AS status, count(birth_country) AS count, count(*) AS total, round(count(birth_country)::DOUBLE / count(*), 6) AS pct FROM players
UNION ALL SELECT 'birth_missing', 'missing', count(*) - count(birth_country), count(*), round((count(*) - count(birth_country))::DOUBLE / count(*), 6) FROM players
UNION ALL SELECT 'club_named', 'available', count(*), count(*), 1 FROM clubs
UNION ALL SELECT 'starts', 'not_yet_collected', NULL, NULL, NULL""")
def _(t):
    return quality.quality_summary(
        [
            (t.players, [("birth_known", F.col("birth_country").isNotNull(), None), ("birth_missing", F.col("birth_country").isNull(), "missing")]),
            (t.clubs, [("club_named", F.col("club_name") != "", None)]),
        ],
        fixed=[("starts", "not_yet_collected")],
    ).withColumn("pct", F.round("pct", 6))


@query("metric_summary", """
SELECT 'orders' AS metric, count(*) AS value FROM orders UNION ALL SELECT 'o_orderstatus__' || o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'o_orderpriority__' || o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""")
def _(t):
    return quality.metric_summary(t.orders, ["o_orderstatus", "o_orderpriority"], total="orders")


@query("overlap_count", "SELECT count(*) AS overlap FROM (SELECT user_id FROM events INTERSECT SELECT o_custkey FROM orders)")
def _(t):
    return quality.overlap_count(t.events, "user_id", t.orders, "o_custkey")


@query("pre_step_audit", """
SELECT 'rows' AS "check", 'PASS' AS status, count(*) AS value, 'one row per customer' AS notes FROM customer
UNION ALL SELECT 'negative', CASE WHEN count(*) FILTER (c_acctbal < 0) = 0 THEN 'PASS' ELSE 'WARN' END, count(*) FILTER (c_acctbal < 0), 'balances' FROM customer""")
def _(t):
    n, neg = F.count(F.lit(1)), F.count_if(F.col("c_acctbal") < 0)
    return quality.pre_step_audit({
        "rows": (t.customer, n, n == F.count_distinct("c_custkey"), "one row per customer"),
        "negative": (t.customer, neg, neg == 0, "balances"),
    })


@query("missing_and_dupe_checks", """
WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 45 THEN ' ' ELSE p_name END AS nm FROM part)
SELECT p_partkey::VARCHAR AS entity_id, 'missing_name' AS issue_type, 'row has no name' AS issue_detail FROM p WHERE trim(nm) = ''
UNION ALL SELECT '', 'duplicate_name', nm || ' appears ' || count(*) || ' times for ' || p_brand FROM p WHERE trim(nm) <> '' GROUP BY p_brand, nm HAVING count(*) > 1""")
def _(t):
    p = t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") > 45, " ").otherwise(F.col("p_name")).alias("nm"))
    return quality.missing_and_dupe_checks(p, "p_brand", "nm", "p_partkey")
