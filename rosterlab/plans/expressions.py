"""One query per column expression, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, match, num, text
from ..operators import joins
from ..sources.adapters import AS_OF
from .registry import query

# SQL spellings of the expressions.
SPACES = r"trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'))"
MARKS = r"strip_accents(regexp_replace({}, '\p{{M}}+', '', 'g'))"
ASCII = r"regexp_replace({}, '[^\x00-\x7F]', '', 'g')"


def spaces(x):
    return SPACES.format(x)


def marks(x):
    return MARKS.format(x)


def ascii_(x):
    return ASCII.format(x)


def sub(x, pattern, to=" "):
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def spelled(x):
    x = f"translate({x}, 'øØđĐðÐłŁ', 'oOdDdDlL')"
    for a, b in text.DOUBLE_LETTERS.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


V = "value"
FOLDS = {
    "ascii": ascii_(marks("value")),
    "marks": marks("value"),
    "marks_lower": f"trim(lower({marks('value')}))",
}
FOLDS["letters"] = "trim(" + sub("lower(" + ascii_(marks(V)) + ")", "[^a-z ]+") + ")"
FOLDS["letters_spelled"] = "trim(" + sub("replace(lower(" + ascii_(marks(spelled(V))) + "), '-', ' ')", "[^a-z ]+") + ")"
FOLDS["spaced_lower"] = "trim(" + sub("lower(" + ascii_(marks(V)) + ")", r"\s+") + ")"
FOLDS["words"] = "trim(" + sub("lower(" + ascii_(marks(V)) + ")", "[^a-z0-9]+") + ")"
FOLDS["words_spelled"] = "trim(" + sub("replace(lower(" + marks(spelled(V)) + "), '&', ' and ')", "[^a-z0-9]+") + ")"
FOLDS["words_and"] = "trim(" + sub("replace(lower(" + marks(V) + "), '&', ' and ')", "[^a-z0-9]+") + ")"
FOLDS["place"] = "trim(" + sub("lower(" + marks(V) + ")", r"[^\p{L}\p{N}]+") + ")"


def on_lines(expr):
    """Query over every line of every document."""
    return lambda t: t.doc_lines.select("doc_id", "pos", expr(F.col("value")).alias("out"))


def lines_sql(expr):
    return f"SELECT doc_id, pos, {expr} AS out FROM doc_lines"


query("clean_spaces", lines_sql(spaces("replace(value, '.', chr(160))")))(
    on_lines(lambda v: text.clean_spaces(F.translate(v, ".", "\u00a0")))
)

for _name, _sql in FOLDS.items():
    query(f"fold_{_name}", lines_sql(_sql))(on_lines(lambda v, p=_name: text.fold(v, p)))

query("transliterate_letters", lines_sql(spelled(V)))(on_lines(text.transliterate_letters))
query("norm_key", lines_sql(FOLDS["words"]))(on_lines(text.norm_key))
TOKENS = "[x FOR x IN string_split({}, ' ') IF x <> '']"
query("token_key", lines_sql(f"array_to_string(list_sort({TOKENS.format(FOLDS['letters_spelled'])}), ' ')"))(on_lines(text.token_key))
query("concat_key", lines_sql(f"replace({FOLDS['letters_spelled']}, ' ', '')"))(on_lines(text.concat_key))


@query("strip_org_suffixes", r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(n), '&', ' and '),
  '\b(f\.?c\.?|a\.?f\.?c\.?|s\.?k\.?|c\.?f\.?|s\.?c\.?|a\.?c\.?|f\.?k\.?)\b', ' ', 'g'),
  '\b(football club|soccer club|club de football|sporting club|club|calcio|deportivo)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS out
FROM (SELECT p_partkey, CASE WHEN p_size < 15 THEN p_name || ' F.C.' WHEN p_size < 30 THEN 'AC ' || p_name || ' Football Club' ELSE 'Club ' || p_name END AS n FROM part)""")
def _(t):
    n = F.when(F.col("p_size") < 15, F.concat("p_name", F.lit(" F.C."))).when(
        F.col("p_size") < 30, F.concat(F.lit("AC "), "p_name", F.lit(" Football Club"))
    ).otherwise(F.concat(F.lit("Club "), "p_name"))
    return t.part.select("p_partkey", text.strip_org_suffixes(n).alias("out"))


GENERIC = "['city','county','department','district','governorate','metropolitan','municipality','province','region','state']"


@query("strip_generic_tokens", rf"""
SELECT p_partkey, array_to_string([x FOR x IN string_split(lower(translate(n, '-,', '  ')), ' ') IF x <> '' AND NOT list_contains({GENERIC}, x)], ' ') AS out
FROM (SELECT p_partkey, CASE WHEN p_size < 25 THEN p_name || ', ' || p_type || ' Region' ELSE 'City-' || p_name END AS n FROM part)""")
def _(t):
    n = F.when(F.col("p_size") < 25, F.concat("p_name", F.lit(", "), "p_type", F.lit(" Region"))).otherwise(F.concat(F.lit("City-"), "p_name"))
    return t.part.select("p_partkey", text.strip_generic_tokens(n).alias("out"))


@query("is_token_prefix", """
SELECT p_partkey, len(a) > 0 AND len(a) < len(b) AND b[1:len(a)] = a AS out FROM (
  SELECT p_partkey, [x FOR x IN string_split(split_part(p_name, ' ', 1), ' ') IF x <> ''] AS a,
    [x FOR x IN string_split(CASE WHEN p_size < 25 THEN p_name ELSE p_type || ' ' || p_name END, ' ') IF x <> ''] AS b FROM part)""")
def _(t):
    b = F.when(F.col("p_size") < 25, F.col("p_name")).otherwise(F.concat_ws(" ", "p_type", "p_name"))
    return t.part.select("p_partkey", text.is_token_prefix(F.split_part("p_name", F.lit(" "), F.lit(1)), b).alias("out"))


def slug_sql(x, sep="_", n=40, fallback="unknown"):
    s = sub(sub("lower(" + ascii_(marks(spaces(x))) + ")", "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")
    if n:
        s = sub(f"left({s}, {n})", f"^{sep}+|{sep}+$", "")
    return f"coalesce(nullif({s}, ''), '{fallback}')"


query("slugify", lines_sql(slug_sql(V)))(on_lines(ids.slugify))
query("hash8", lines_sql("left(sha1(lower(" + spaces("lang") + ") || '||' || lower(" + spaces(V) + ")), 8)"))(
    lambda t: t.doc_lines.select("doc_id", "pos", ids.hash_n(F.col("lang"), F.col("value")).alias("out"))
)
query("hash16_raw", lines_sql("left(sha1(lang || '||' || value), 16)"))(
    lambda t: t.doc_lines.select("doc_id", "pos", ids.hash_n(F.col("lang"), F.col("value"), clean=False, n=16).alias("out"))
)


@query("make_id", f"""
SELECT doc_id, pos, 'p_' || lower(lang) || '_' || {slug_sql(V, n=32)} || '_' ||
  left(sha1('player||' || lower({spaces('lang')}) || '||' || lower({spaces(V)})), 8) AS out FROM doc_lines""")
def _(t):
    v = F.col("value")
    return t.doc_lines.select(
        "doc_id", "pos", ids.make_id("p", v, [F.lit("player"), F.col("lang"), v], scope=F.col("lang"), max_len=32).alias("out")
    )


@query("city_key", f"""
SELECT s_suppkey, {slug_sql('n_name', '-', None, 'blank')} || '__' || {slug_sql('s_name', '-', None, 'blank')} || '__' ||
  left(sha1(n_name || '||' || s_name), 8) AS out FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", ids.city_key(F.col("n_name"), F.col("s_name")).alias("out")
    )


@query("normalize_enum", """
SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'defender' WHEN 'machinery' THEN 'midfielder' WHEN 'furniture' THEN 'forward'
  WHEN 'household' THEN 'goalkeeper' ELSE 'unknown' END AS out FROM customer""")
def _(t):
    spell = {"building": "defender", "machinery": "midfielder", "furniture": "forward", "household": "goalkeeper"}
    return t.customer.select("c_custkey", text.normalize_enum(F.concat(F.lit("  "), "c_mktsegment"), spell).alias("out"))


RAW = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' TRUE ' WHEN 'O' THEN 'False' ELSE 'maybe' END AS b,
  CASE WHEN o_totalprice < 100000 THEN (o_orderkey::VARCHAR || '.0') WHEN o_totalprice < 200000 THEN o_custkey::VARCHAR
  WHEN o_totalprice < 300000 THEN (o_custkey::VARCHAR || '.5') WHEN o_totalprice < 400000 THEN ' ' ELSE 'n/a' END AS n FROM orders"""


def raw_values(t):
    p = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", " TRUE ").when(F.col("o_orderstatus") == "O", "False").otherwise("maybe").alias("b"),
        F.when(p < 100000, F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")))
        .when(p < 200000, F.col("o_custkey").cast("string"))
        .when(p < 300000, F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
        .when(p < 400000, " ").otherwise("n/a").alias("n"),
    )


@query("coerce_values", f"""
SELECT o_orderkey, CASE lower(trim(b)) WHEN 'true' THEN true WHEN 'false' THEN false END AS as_bool, try_cast(nullif(trim(n), '') AS DOUBLE) AS as_float,
  CASE WHEN try_cast(nullif(trim(n), '') AS DOUBLE) = floor(try_cast(nullif(trim(n), '') AS DOUBLE)) THEN try_cast(nullif(trim(n), '') AS DOUBLE)::INT END AS as_int,
  nullif(trim(n), '') AS as_text FROM ({RAW})""")
def _(t):
    b, n = F.col("b"), F.col("n")
    return raw_values(t).select(
        "o_orderkey", text.coerce(b, "bool").alias("as_bool"), text.coerce(n, "float").alias("as_float"),
        text.coerce(n, "int").alias("as_int"), text.coerce(n, "text").alias("as_text"),
    )


@query("repair_mojibake", lines_sql("value"))
def _(t):
    wrong = F.decode(F.encode("value", "UTF-8"), "ISO-8859-1")
    return t.doc_lines.select("doc_id", "pos", text.repair_mojibake(wrong).alias("out"))


query("is_suspicious_text", lines_sql("regexp_matches(value, '[_√Ã]') OR contains(value, chr(65533))"))(on_lines(text.is_suspicious_text))


@query("age_years", f"""
SELECT player_id, round(date_diff('day', date_of_birth, DATE '{AS_OF}') / 365.25, 6) AS age,
  floor(date_diff('day', date_of_birth, DATE '{AS_OF}') / 365.25)::INT AS age_floor FROM players""")
def _(t):
    day = F.to_date(F.lit(AS_OF))
    d = F.col("date_of_birth")
    return t.players.select("player_id", F.round(num.age_years(d, day), 6).alias("age"), num.age_floor(d, day).alias("age_floor"))


@query("year_plausibility", """
SELECT player_id, CASE WHEN date_of_birth IS NULL THEN 'dob_year_missing' WHEN year(date_of_birth) NOT BETWEEN 1965 AND 1980 THEN 'dob_year_implausible'
  WHEN year(date_of_birth) < 1970 THEN 'birth_year_before_1970_spot_check' END AS out FROM players""")
def _(t):
    return t.players.select("player_id", num.year_plausibility(F.col("date_of_birth"), 1965, 1980, 1970).alias("out"))


HAV = """2 * 6371.0 * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0)))"""
HAV_A = """(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))"""


def hav_sql(y1, x1, y2, x2):
    return HAV.format(a=HAV_A.format(y1=y1, x1=x1, y2=y2, x2=x2))


@query("haversine_km", f"""
SELECT club_id, round({hav_sql('lat', 'lon', '48.85', '2.35')}, 4) AS km FROM clubs""")
def _(t):
    km = num.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.85), F.lit(2.35))
    return t.clubs.select("club_id", F.round(km, 4).alias("km"))


@query("parse_wkt_point", "SELECT club_id, lat, lon FROM clubs")
def _(t):
    wkt = F.concat(F.lit("Point("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    return t.clubs.select("club_id", wkt.alias("w")).select("club_id", num.wkt_lat(F.col("w")).alias("lat"), num.wkt_lon(F.col("w")).alias("lon"))


@query("similarity", """
SELECT p_partkey, round(1 - levenshtein(p_name, lower(p_type))::DOUBLE / greatest(length(p_name), length(p_type)), 6) AS out FROM part""")
def _(t):
    return t.part.select("p_partkey", F.round(match.similarity(F.col("p_name"), F.lower("p_type")), 6).alias("out"))


@query("token_overlap", """
SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) END, 6) AS out FROM (
  SELECT conv_id, turn, list_distinct([x FOR x IN string_split(lower(text), ' ') IF x <> '']) AS a,
    list_distinct([x FOR x IN string_split('de la the of and in der die que para', ' ') IF x <> '']) AS b FROM conversations)""")
def _(t):
    a = text.tokens(F.lower("text"))
    b = F.split(F.lit("de la the of and in der die que para"), " ")
    return t.conversations.select("conv_id", "turn", F.round(match.token_overlap(a, b), 6).alias("out"))


NEEDLES = ["MIT License", "Apache", "token =", "the the"]
query("contains_any", lines_sql(" OR ".join(f"contains({FOLDS['words']}, '{n}')" for n in ["mit license", "apache", "token", "the the"])))(
    on_lines(lambda v: text.contains_any(v, NEEDLES))
)


@query("alias_match", """
SELECT c_custkey, coalesce(n_name = 'NATION_3' OR n_name IN ('NATION_5', 'NATION_7'), false) AS out FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    aliases = F.array(F.lit("NATION_5"), F.lit("NATION_7"))
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        "c_custkey", match.alias_match(F.col("n_name"), F.lit("NATION_3"), aliases).alias("out")
    )


@query("normalize_external_id", "SELECT p_partkey, CASE WHEN p_size < 40 THEN 'Q' || p_partkey END AS out FROM part")
def _(t):
    raw = F.when(F.col("p_size") < 40, F.concat(F.lit(" https://host/wiki/q"), "p_partkey", F.lit(" "))).otherwise("none")
    return t.part.select("p_partkey", text.normalize_external_id(raw).alias("out"))


@query("file_title", r"""
SELECT page_id, CASE WHEN n <> '' THEN 'File:' || n END AS out FROM (SELECT page_id,
  regexp_replace(trim(replace(url_decode(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$')), '_', ' ')), '^[Ff]ile:', '') AS n FROM pages)""")
def _(t):
    return t.pages.select("page_id", text.file_title(F.col("url")).alias("out"))


@query("title_to_url", "SELECT p_partkey, 'https://host/wiki/' || url_encode(replace(p_name || ' ' || p_brand, ' ', '_')) AS out FROM part")
def _(t):
    title = F.concat(F.lit("File:"), F.concat_ws(" ", "p_name", "p_brand"))
    return t.part.select("p_partkey", text.title_to_url(title, "https://host/wiki/").alias("out"))


@query("url_title", r"""
SELECT page_id, CASE WHEN contains(p, '/en/') THEN replace(url_decode(substr(p, instr(p, '/en/') + 4)), '_', ' ') END AS out
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)""")
def _(t):
    return t.pages.select("page_id", text.url_title(F.col("url"), "/en/").alias("out"))


def markup_sql(x):
    for entity, ch in text.ENTITIES.items():
        ch = ch.replace("'", "''")
        x = f"replace({x}, '{entity}', '{ch}')"
    return spaces(sub(x, "<[^>]+>"))


@query("strip_markup", f"SELECT page_id, {markup_sql('html')} AS out FROM pages")
def _(t):
    return t.pages.select("page_id", text.strip_markup(F.col("html")).alias("out"))


@query("first_non_blank", """
SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, nullif(trim(CASE WHEN c_acctbal > 0 THEN '  ' ELSE ' x ' END), ''), c_name) AS out FROM customer""")
def _(t):
    b = F.col("c_acctbal")
    out = text.first_non_blank(F.when(b > 5000, F.col("c_mktsegment")), F.when(b > 0, "  ").otherwise(" x "), F.col("c_name"))
    return t.customer.select("c_custkey", out.alias("out"))


@query("append_note", """
SELECT o_orderkey, CASE WHEN o IS NULL THEN n WHEN contains(o, n) THEN o ELSE o || ' | ' || n END AS out FROM (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'checked 5-LOW' ELSE 'open' END AS o, o_orderpriority AS n FROM orders)""")
def _(t):
    old = F.when(F.col("o_orderstatus") == "F", " ").when(F.col("o_orderstatus") == "O", "checked 5-LOW").otherwise("open")
    return t.orders.select("o_orderkey", text.append_note(old, F.col("o_orderpriority")).alias("out"))


@query("query_variants", """
SELECT p_partkey, p_name || '|' || p_name || ' football club|' || p_name || ' soccer club' || CASE WHEN p_size < 25 THEN '' ELSE '' END AS out FROM part""")
def _(t):
    return t.part.select("p_partkey", F.array_join(text.query_variants(F.col("p_name"), 8), "|").alias("out"))


@query("query_variants_suffixed", """
SELECT p_partkey, p_name || ' FC|' || p_name || ' FC football club|' || p_name || ' FC soccer club|' || p_name || '|' || p_name || ' football club' AS out FROM part""")
def _(t):
    return t.part.select("p_partkey", F.array_join(text.query_variants(F.concat("p_name", F.lit("  FC"))), "|").alias("out"))


@query("manual_search_hint", "SELECT p_partkey, p_name || ' | ' || p_name || ' FC | ' || p_name || ' football club' AS out FROM part")
def _(t):
    return t.part.select("p_partkey", text.manual_search_hint(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("out"))


@query("pipe_list_round_trip", """
SELECT p_partkey, array_to_string(list_sort(list_distinct([trim(x) FOR x IN string_split(p_name || '| |' || p_brand || '|' || p_name, '|') IF trim(x) <> ''])), '|') AS out FROM part""")
def _(t):
    raw = F.concat_ws("|", "p_name", F.lit(" "), "p_brand", "p_name")
    return t.part.select("p_partkey", text.join_list(text.sorted_unique(text.split_list(raw))).alias("out"))


query("clean_note", lines_sql(sub(sub(r"replace(replace(value, 'Released under the MIT License.', ''), 'the ', '')", " {2,}"), "^[ ;]+|[ ;]+$", "")))(
    on_lines(lambda v: text.clean_note(v, ["Released under the MIT License.", "the "]))
)


@query("country_code", """
SELECT c_custkey, coalesce(code, upper(left(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g'), 3))) AS out
FROM customer LEFT JOIN (SELECT n_nationkey, 'N' || n_nationkey AS code FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey""")
def _(t):
    codes = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    return joins.country_codes(t.customer, codes, "c_nationkey", "c_mktsegment", "out").select("c_custkey", "out")


@query("per_90", "SELECT player_id, round(goals / nullif(minutes_played, 0) * 90, 6) AS out FROM stats")
def _(t):
    return t.player_stats.select("player_id", F.round(num.per_n(F.col("goals"), F.col("minutes_played")), 6).alias("out"))


@query("signed_diff_label", """
SELECT c_custkey, CASE WHEN d = 0 THEN 'Even' WHEN d > 0 THEN '+' || d ELSE '-' || abs(d) END AS out FROM (
  SELECT c_custkey, floor(c_acctbal)::BIGINT - 5000 AS d FROM customer)""")
def _(t):
    return t.customer.select("c_custkey", num.signed_diff_label(F.floor("c_acctbal").cast("double"), F.lit(5000.0), 0).alias("out"))


@query("median_by_group", "SELECT c_nationkey, round(median(c_acctbal), 6) AS out FROM customer GROUP BY 1")
def _(t):
    from ..skew import group_median

    return group_median(t.customer, ["c_nationkey"], F.col("c_acctbal"), "m").select("c_nationkey", F.round("m", 6).alias("out"))


@query("source_label", """
SELECT DISTINCT o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 'Group stage' WHEN '1-URGENT' THEN 'Final'
  ELSE upper(left(o_orderpriority, 1)) || lower(substr(o_orderpriority, 2)) END AS out FROM orders""")
def _(t):
    return t.orders.select("o_orderpriority").distinct().withColumn(
        "out", text.source_label(F.col("o_orderpriority"), {"5-LOW": "Group stage", "1-URGENT": "Final"})
    )


@query("date_label", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) END AS out FROM orders""")
def _(t):
    written = F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise("2026-x-3")
    return t.orders.select("o_orderkey", text.date_label(written).alias("out"))


@query("parse_dob", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS out FROM orders")
def _(t):
    d = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), F.date_format(d, "yyyy-MM-dd"), F.lit(") (aged 20)")))
        .when(F.col("o_orderstatus") == "O", F.date_format(d, "d MMMM yyyy"))
        .otherwise(F.date_format(d, "MMMM d, yyyy"))
    )
    return t.orders.select("o_orderkey", num.parse_dob(written).cast("string").alias("out"))


@query("parse_score", """
SELECT match_id, home_score, home_pens, status FROM matches""")
def _(t):
    cell = F.when(F.col("home_score").isNull(), "-").when(F.col("home_pens").isNull(), F.col("home_score").cast("string")).otherwise(
        F.format_string("%d (%d)", "home_score", "home_pens")
    )
    out = t.matches.select("match_id", cell.alias("c"))
    return out.select(
        "match_id", num.score_goals(F.col("c")).alias("home_score"), num.score_pens(F.col("c")).alias("home_pens"),
        F.when(num.score_goals(F.col("c")).isNull(), "scheduled").otherwise("played").alias("status"),
    )
