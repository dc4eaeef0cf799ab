"""Parsers over tables of lines and cells. State that a heading passes down comes from ``carry_down``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import hash_n
from ..functions.num import score_goals, score_pens
from ..functions.text import clean_spaces
from ..skew import carry_down


def parse_sectioned_text(lines: DataFrame, file: str = "file", pos: str = "pos", value: str = "value", parts: int | None = None) -> DataFrame:
    """``# Name (CODE)`` headings, ``## Source: url`` lines, then comma lists of members.

    One row per distinct member of a section, placed by its first appearance (``member_pos``,
    ``item_pos``), so the order survives without gathering a section in one task.
    """
    v = F.trim(value)
    heading, source = v.rlike(r"^# "), v.rlike(r"^## Source:")
    title = F.trim(F.substring(v, F.lit(3), F.length(v)))
    code = F.nullif(F.regexp_extract(title, r"\(([^)]+)\)\s*$", 1), F.lit(""))
    marked = lines.select(
        file, pos, v.alias("_v"),
        F.when(heading, F.struct(F.col(pos).alias("at"), F.coalesce(code, title).alias("code"),
                                 F.regexp_replace(title, r"\s*\([^)]*\)\s*$", "").alias("name"))).alias("_section"),
        F.when(heading, F.lit("")).when(source, F.trim(F.substring(v, F.lit(11), F.length(v)))).alias("_source"),
    )
    carried = carry_down(marked, file, pos, ["_section", "_source"], parts)
    items = carried.filter((~F.col("_v").startswith("#")) & (F.col("_v") != "") & F.col("_section").isNotNull()).select(
        file, F.col("_section.at").alias("section_pos"), F.col("_section.code").alias("code"), F.col("_section.name").alias("name"),
        F.nullif("_source", F.lit("")).alias("source_url"), F.col(pos).alias("member_pos"),
        F.posexplode(F.split(F.regexp_replace("_v", r"\.+$", ""), ",")).alias("item_pos", "_m"),
    ).withColumn("member", F.trim("_m")).filter("member <> ''")
    return items.groupBy(file, "section_pos", "code", "name", "member").agg(
        F.min(F.struct("member_pos", "item_pos", "source_url")).alias("f")
    ).select(file, "section_pos", "code", "name", "f.source_url", "member", "f.member_pos", "f.item_pos")


DATE_LINE = r"^\w+ \d{1,2} \w+ \d{4}$"


def parse_carried_date_lines(lines: DataFrame, file: str = "file", pos: str = "pos", value: str = "value", fields: int = 8,
                             parts: int | None = None) -> DataFrame:
    """Fixtures: a date line holds for the lines below it; other lines have ``fields`` bar-separated
    parts, and any other count is skipped."""
    v = F.trim(value)
    marked = lines.select(file, pos, v.alias("_v"), F.when(v.rlike(DATE_LINE), v).alias("match_date"))
    carried = carry_down(marked, file, pos, ["match_date"], parts)
    p = F.split("_v", r"\|")
    rows = carried.filter((~F.col("_v").rlike(DATE_LINE)) & (F.size(p) == fields))
    cell = lambda i: F.element_at(p, i + 1)
    return rows.select(
        file, pos, "match_date", cell(0).alias("home_team"), cell(3).alias("away_team"),
        score_goals(cell(1)).alias("home_score"), score_goals(cell(2)).alias("away_score"),
        score_pens(cell(1)).alias("home_pens"), score_pens(cell(2)).alias("away_pens"),
        cell(4).alias("stage"), cell(5).alias("group"), cell(6).alias("stadium"), cell(7).alias("city"),
        F.when(score_goals(cell(1)).isNull(), "scheduled").otherwise("played").alias("status"),
    )


def parse_list_of_pairs(c: Column) -> Column:
    """``A (X), B (Y)`` as an array of (name, detail); an item without parentheses keeps a blank detail."""
    items = F.filter(F.split(F.regexp_replace(c, r"\)\s*,\s*", ")\u0001"), "\u0001"), lambda s: F.trim(s) != "")
    full = r"^(.*?)\s*\(([^()]*)\)\s*$"
    return F.transform(
        items,
        lambda s: F.struct(
            F.trim(F.when(s.rlike(full), F.regexp_extract(s, full, 1)).otherwise(s)).alias("name"),
            F.trim(F.regexp_extract(s, full, 2)).alias("detail"),
        ),
    )


def parse_pairs_from_cell(df: DataFrame, cell: str, *keys: str) -> DataFrame:
    """``Name ( Country )`` pairs of a cell as rows, distinct on (keys, name, country)."""
    pattern = F.lit(r"([^()]+?) \( ([^()]+?) \)")
    zipped = F.arrays_zip(
        F.regexp_extract_all(cell, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(cell, pattern, F.lit(2)).alias("country")
    )
    return df.select(*keys, F.explode(zipped).alias("p")).select(
        *keys, F.trim("p.name").alias("name"), F.trim("p.country").alias("country")
    ).distinct()


def assemble_roster_rows(lines: DataFrame, file: str = "page", pos: str = "pos", tag: str = "tag", value: str = "text",
                         parts: int | None = None) -> DataFrame:
    """Roster rows from (page, pos, tag, text): groups (h2), teams (h3) and position labels carry
    down; a list line becomes one row per player with club and a row hash.

    A team heading starts a new team, so manager and section never leak from the team above.
    """
    v = clean_spaces(F.col(value))
    is_team = F.col(tag) == "h3"
    manager = F.nullif(F.regexp_extract(v, r"(?i)^(?:manager|coach)\s*:\s*(.+)$", 1), F.lit(""))
    section = F.nullif(F.regexp_extract(v, r"(?i)^(goalkeepers|defenders|midfielders|forwards)\s*:", 1), F.lit(""))
    announced = F.nullif(F.regexp_extract(v, r"(?i)^(?:squad )?announced\s*:?\s*(.+)$", 1), F.lit(""))
    team_start = lambda x: F.when(is_team, F.lit("")).when(F.col(tag) == "p", x)
    marked = lines.select(
        file, pos, v.alias("_v"), F.col(tag).alias("_tag"), section.isNotNull().alias("_is_list"),
        F.when(F.col(tag) == "h2", v).alias("group"), F.when(is_team, v).alias("team"),
        team_start(manager).alias("manager"), team_start(announced).alias("announced"), section.alias("section"),
    )
    carried = carry_down(marked, file, pos, ["group", "team", "manager", "announced"], parts)
    rows = carried.filter(F.col("_is_list") & F.col("team").isNotNull()).select(
        file, pos, "group", "team", F.lower("section").alias("section"), F.nullif("manager", F.lit("")).alias("manager"),
        F.nullif("announced", F.lit("")).alias("announced"),
        F.posexplode(parse_list_of_pairs(F.regexp_replace("_v", r"^[^:]*:\s*", ""))).alias("item", "p"),
    )
    return rows.select(
        file, pos, "item", "group", "team", "section", "manager", "announced", F.col("p.name").alias("player"), F.col("p.detail").alias("club"),
        hash_n(F.col("team"), F.col("section"), F.col("p.name"), F.col("p.detail"), clean=False, n=16).alias("row_hash"),
    )
