"""Numbers, dates, places and match results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
DAYS_PER_YEAR = 365.25


def try_date(c: Column) -> Column:
    """Day part of ISO text; NULL when it is not a date."""
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def parse_dob(c: Column) -> Column:
    """A birth date written ISO in parentheses, or as day month year, or as month day, year."""
    iso = F.regexp_extract(c, r"\(\s*([0-9]{4}-[0-9]{2}-[0-9]{2})\s*\)", 1)
    dmy = F.regexp_extract(c, r"([0-9]{1,2} [A-Za-z]+ [0-9]{4})", 1)
    mdy = F.regexp_extract(c, r"([A-Za-z]+ [0-9]{1,2}, [0-9]{4})", 1)
    return F.coalesce(
        F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"),
        F.try_to_date(F.nullif(dmy, F.lit("")), "d MMMM yyyy"),
        F.try_to_date(F.nullif(mdy, F.lit("")), "MMMM d, yyyy"),
    )


def age_days(dob: Column, as_of: Column) -> Column:
    return F.datediff(as_of, dob)


def age_years(dob: Column, as_of: Column) -> Column:
    return F.datediff(as_of, dob) / F.lit(DAYS_PER_YEAR)


def age_floor(dob: Column, as_of: Column) -> Column:
    return F.floor(age_years(dob, as_of)).cast("int")


def year_plausibility(dob: Column, lo: int = 1900, hi: int = 2010, spot_before: int = 1986) -> Column:
    y = F.year(dob)
    return (
        F.when(y.isNull(), "dob_year_missing")
        .when((y < lo) | (y > hi), "dob_year_implausible")
        .when(y < spot_before, f"birth_year_before_{spot_before}_spot_check")
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    sin_half = lambda d: F.sin(F.radians(d) / 2)
    a = sin_half(lat2 - lat1) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_half(lon2 - lon1) ** 2
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def wkt_lat(c: Column) -> Column:
    return F.regexp_extract(c, r"Point\(([-0-9.]+)\s+([-0-9.]+)\)", 2).try_cast("double")


def wkt_lon(c: Column) -> Column:
    return F.regexp_extract(c, r"Point\(([-0-9.]+)\s+([-0-9.]+)\)", 1).try_cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; NULL when b is zero or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def per_n(x: Column, base: Column, n: int = 90) -> Column:
    return ratio(x, base) * n


def signed_diff_label(a: Column, b: Column, digits: int = 1) -> Column:
    d = F.bround(a - b, digits)
    text = F.format_string(f"%.{digits}f", F.abs(d))
    return F.when(d.isNull(), "N/A").when(d == 0, "Even").when(d > 0, F.concat(F.lit("+"), text)).otherwise(
        F.concat(F.lit("-"), text)
    )


def pct_label(x: Column, digits: int = 0) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%")))


def match_result(home: Column, away: Column, home_pens: Column, away_pens: Column, mode: str = "decided") -> Column:
    """home / away / draw, NULL when not played.

    ``decided``: unequal shoot-out scores break a tie. ``scoreline``: an equal score is a draw.
    """
    out = F.when(home > away, "home").when(home < away, "away")
    if mode == "decided":
        out = out.when((home == away) & (home_pens > away_pens), "home").when((home == away) & (home_pens < away_pens), "away")
    elif mode != "scoreline":
        raise ValueError(mode)
    return out.when(home == away, "draw")


def score_goals(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d+)(?: \((\d+)\))?$", 1).try_cast("int")


def score_pens(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d+)(?: \((\d+)\))?$", 2).try_cast("int")
