"""Places: cities from geocoded rows, place lookups, centroids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import city_key
from ..functions.text import blank_to_null, fold, is_suspicious_text
from .diff import numbered_copies
from .joins import active_only


# Where a city's coordinates come from.
PROVENANCE = ["city_source_url", "city_geo_source", "city_match_confidence", "city_review_notes"]


def own_city_key(clubs: DataFrame) -> Column:
    """The row's ``city_key``, or the one minted from country and city where it is absent or blank."""
    minted = city_key(F.coalesce("country", F.lit("")), F.coalesce("city", F.lit("")))
    return F.coalesce(blank_to_null(F.col("city_key")), minted) if "city_key" in clubs.columns else minted


def cities_from_clubs(clubs: DataFrame, order: str = "club_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row per city of the geocoded clubs: attributes of its first row and the club count.

    A club's own ``city_key`` stands where it has one, and the provenance columns that the clubs have come along.
    The members come from ``city_members``, in long form, so that no city is gathered in one row.
    """
    rows = clubs.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    known = [c for c in PROVENANCE if c in rows.columns]
    first = F.min_by(F.struct("country", "city", lat, lon, *known), F.col(order)).alias("f")
    out = rows.groupBy(own_city_key(rows).alias("city_key")).agg(first, F.count(order).alias("club_count"))
    return out.select("city_key", "f.*", "club_count").withColumn("city_ascii", fold(F.col("city"), "ascii"))


def city_members(clubs: DataFrame, key: str = "club_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    rows = clubs.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return rows.select(own_city_key(rows).alias("city_key"), key)


def teams_from_entries(entries: DataFrame) -> DataFrame:
    """Active squad size and replacements per team; teams with only removed rows stay at zero."""
    s = F.trim(F.coalesce("squad_status", F.lit("")))
    active = (s == "") | (s == "active")
    return entries.groupBy("team", "team_code").agg(
        F.count_if(active).alias("squad_size"), F.count_if(active & F.col("is_replacement")).alias("replacement_count")
    )


def team_members(entries: DataFrame, team: str = "team_code", key: str = "player_id") -> DataFrame:
    """Active members of each team with their place in the team's list, in key order."""
    return numbered_copies(active_only(entries).select(team, key), [team], key).withColumnRenamed("copy_no", "list_no")


def place_lookup(df: DataFrame, country: str, city: str, ids: str, names: str) -> DataFrame:
    """Distinct places with row, id and name counts."""
    out = df.groupBy(F.col(country).alias("country"), F.col(city).alias("city")).agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_distinct(ids).alias("distinct_ids"), F.count_distinct(names).alias("distinct_names")
    )
    return out.withColumn("city_key", city_key(F.coalesce("country", F.lit("")), F.coalesce("city", F.lit(""))))


def place_values(df: DataFrame, country: str, city: str, fields: Sequence[str]) -> DataFrame:
    """The distinct non-blank values of each field at each place, long form."""
    long = df.select(F.col(country).alias("country"), F.col(city).alias("city"), *[F.col(f).cast("string").alias(f) for f in fields])
    return long.unpivot(["country", "city"], list(fields), "field", "value").filter("trim(value) <> ''").distinct()


def country_bubbles(cities: DataFrame, lat: str = "lat", lon: str = "lon", weight: str = "club_count") -> DataFrame:
    """Count-weighted centroid, counts and bounding box per country."""
    n = F.sum(weight)
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col(weight)), n.cast("double"))
    return cities.groupBy("country").agg(
        mean(lat).alias("center_lat"), mean(lon).alias("center_lon"), n.alias("club_count"), F.count(F.lit(1)).alias("city_count"),
        F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"),
    )


def hint_centroids(rows: DataFrame, keys: Sequence[str], lat: str, lon: str, trusted: Column, spread: float = 1.0) -> DataFrame:
    """Mean of the trusted points per place, counts of trusted and other points, and a spread flag."""
    point = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    ok = point & trusted
    t = lambda f, c: f(F.when(ok, F.col(c)))
    wide = (t(F.max, lat) - t(F.min, lat) > spread) | (t(F.max, lon) - t(F.min, lon) > spread)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_if(point).alias("point_count"), F.count_if(ok).alias("trusted_count"),
        t(F.avg, lat).alias("center_lat"), t(F.avg, lon).alias("center_lon"), F.coalesce(wide, F.lit(False)).alias("large_spread"),
        F.coalesce(F.max(is_suspicious_text(F.concat_ws(" ", *keys))), F.lit(False)).alias("suspicious_text"),
    )
