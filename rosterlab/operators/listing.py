"""Small reports: role counts, newest changes, headline counts, categories of teams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .joins import category_of


def role_counts(df: DataFrame, role: str) -> DataFrame:
    return df.groupBy(role).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), role)


def newest_changes(log: DataFrame, at: str, tie: str, n: int = 6) -> DataFrame:
    """The n latest rows (a top-k report)."""
    return log.orderBy(F.desc(at), F.desc(tie)).limit(n)


def headline_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("entity"), "rows") for n, d in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def teams_by_category(teams: DataFrame, members: DataFrame, query: str = "", category: str | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Teams whose name or code contains the query, with their category (Other when unknown)."""
    q = query.strip().lower()
    hit = F.contains(F.lower("team"), F.lit(q)) | F.contains(F.lower(F.col("team_code").cast("string")), F.lit(q))
    found = category_of(teams.filter(hit).select("team", "team_code"), "team", members, aliases)
    out = found.withColumn("category", F.coalesce("category", F.lit("Other")))
    if category is not None:
        out = out.filter(F.col("category") == category)
    return out.orderBy("category", F.collate("team", "UNICODE"))
