"""One refresh: typed tables in, strict audit, derived tables and manifest out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.diff import orphans
from .operators.facets import alias_dictionary
from .operators.geo import cities_from_clubs, city_members, own_city_key, team_members, teams_from_entries
from .operators.quality import audit, unique_key
from .sources.readers import path_exists, read_table, typed
from .sources.writers import write_counted, write_snapshot

# Columns that are not text, by table.
TYPES = {
    "players": {"birth_lat": "float", "birth_lon": "float", "height_cm": "int", "manual_review_flag": "bool"},
    "squad_entries": {"shirt_number": "int", "caps_pre_tournament": "int", "goals_pre_tournament": "int", "is_captain": "bool", "is_replacement": "bool"},
    "clubs": {"city_lat": "float", "city_lon": "float", "manual_review_flag": "bool"},
    "player_club_at_callup": {},
    "club_alias_map": {},
}
# Tables that a folder may hold besides; they are typed, checked for their key and carried along.
MORE_TYPES = {
    "team_stats": {**dict.fromkeys(["matches_played", "wins", "draws", "losses", "goals_for", "goals_against", "assists"], "int"), "xg": "float", "possession_pct": "float"},
    "player_stats": dict.fromkeys(["goals", "assists", "minutes_played", "yellow_cards", "red_cards", "indirect_red_cards", "gk_saves", "gk_actions_inside_box", "gk_actions_outside_box"], "int"),
    "matches": dict.fromkeys(["home_score", "away_score", "home_pens", "away_pens"], "int"),
    "coaches": {}, "referees": {}, "confederations": {}, "sources": {}, "change_log": {}, "manual_review_queue": {},
}
MORE_KEYS = {
    "team_stats": "team_code", "player_stats": "player_id", "matches": "match_id", "coaches": "coach_id", "referees": "official_id", "confederations": "code",
    "sources": "source_id", "change_log": "change_id", "manual_review_queue": "review_id",
}
KEYS = {"players": "player_id", "squad_entries": "squad_entry_id", "clubs": "club_id", "player_club_at_callup": "player_club_callup_id", "club_alias_map": "raw_club_id"}


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Typed tables, and every value that did not fit its type."""
    tables, rejects = {}, None
    keys = KEYS | MORE_KEYS
    there = TYPES | {n: t for n, t in MORE_TYPES.items() if path_exists(spark, f"{folder}/{n}.csv")}
    for name, types in there.items():
        rows, bad = typed(read_table(spark, f"{folder}/{name}.csv"), types, [keys[name]])
        tables[name] = rows
        if types:
            bad = bad.select(F.lit(name).alias("table"), F.col(keys[name]).alias("row_key"), "field", "raw")
            rejects = bad if rejects is None else rejects.unionByName(bad)
    return tables, rejects


def checks(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    entries, links = t["squad_entries"], t["player_club_at_callup"]
    return {
        "player_ids_unique": unique_key(t["players"], ["player_id"]),
        "external_ids_unique": unique_key(t["players"], ["wikidata_id"], nonblank_only=True),
        "club_ids_unique": unique_key(t["clubs"], ["club_id"]),
        "entry_players_exist": orphans(entries, t["players"], "player_id"),
        "link_players_exist": orphans(links, t["players"], "player_id"),
        "link_clubs_exist": orphans(links, t["clubs"], "club_id"),
        **{f"{name}_keys_unique": unique_key(t[name], [key]) for name, key in MORE_KEYS.items() if name in t},
    }


def refresh(spark: SparkSession, folder: str, out: str, exported_at: str, strict: bool = True, fmt: str = "json") -> DataFrame:
    """Write every table and return the manifest. Strict stops before anything is written."""
    t, rejects = load(spark, folder)
    audit(checks(t), strict=strict)
    clubs = t["clubs"].withColumn("city_key", own_city_key(t["clubs"]))
    aliases = t["club_alias_map"].select(
        F.col("raw_club_name").alias("raw_name"), F.col("canonical_club_id").alias("canonical_id"), F.col("canonical_club_name").alias("canonical_name")
    )
    tables = {
        "players": t["players"], "squad_entries": t["squad_entries"], "clubs": clubs, "player_club_at_callup": t["player_club_at_callup"],
        "cities": cities_from_clubs(clubs, lat="city_lat", lon="city_lon"), "city_members": city_members(clubs, lat="city_lat", lon="city_lon"),
        "teams": teams_from_entries(t["squad_entries"]), "team_members": team_members(t["squad_entries"]),
        "club_aliases": alias_dictionary(aliases, clubs), "rejects": rejects, **{name: t[name] for name in MORE_TYPES if name in t},
    }
    manifest = write_counted(tables, out, exported_at, folder, fmt)
    write_snapshot(manifest, f"{out}/meta", fmt)
    return manifest
