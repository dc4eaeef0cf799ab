"""Filtering and finding: facets, cascading options, layered search, drill-downs, cards."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, fold, fold_text
from ..skew import first_per_key, range_parts
from .joins import active_people, keyed


@dataclass(frozen=True)
class Facets:
    team: str | None = None
    country: str | None = None
    league: str | None = None


def _club_flags(clubs: DataFrame, links: DataFrame, f: Facets, selected: DataFrame | None) -> DataFrame:
    """Each club with one boolean per dimension, so that any subset of the filters is a conjunction."""
    out = clubs
    if f.team is None:
        out = out.withColumn("_team", F.lit(True))
    else:
        of_team = links.filter(F.col("team") == f.team).select("club_id").distinct().withColumn("_team", F.lit(True))
        out = out.join(of_team, "club_id", "left").withColumn("_team", F.coalesce("_team", F.lit(False)))
    out = out.withColumn("_country", F.lit(True) if f.country is None else F.coalesce(F.col("country") == f.country, F.lit(False)))
    out = out.withColumn("_league", F.lit(True) if f.league is None else F.coalesce(F.col("league") == f.league, F.lit(False)))
    if selected is None:
        return out.withColumn("_selected", F.lit(True))
    chosen = selected.select("club_id").distinct().withColumn("_selected", F.lit(True))
    return out.join(chosen, "club_id", "left").withColumn("_selected", F.coalesce("_selected", F.lit(False)))


def selection_clubs(links: DataFrame, club_ids: list, player_ids: list) -> DataFrame:
    """Clubs chosen directly or through a chosen player."""
    return links.filter(F.col("club_id").isin(club_ids) | F.col("player_id").isin(player_ids)).select("club_id").distinct()


def faceted_filter(clubs: DataFrame, links: DataFrame, f: Facets, selected: DataFrame | None = None) -> DataFrame:
    flags = _club_flags(clubs, links, f, selected)
    return flags.filter("_team and _country and _league and _selected").select(*clubs.columns)


def cities_with_match(members: DataFrame, clubs: DataFrame) -> DataFrame:
    """Cities with at least one matching club; ``members`` is (city_key, club_id)."""
    return members.join(clubs.select("club_id"), "club_id", "left_semi").select("city_key").distinct()


def cascading_options(clubs: DataFrame, links: DataFrame, f: Facets, selected: DataFrame | None = None) -> DataFrame:
    """(facet, option): the values of each facet under the other filters; countries also ignore the league."""
    flags = _club_flags(clubs, links, f, selected)
    by_team = flags.filter("_country and _league and _selected").select("club_id").join(links.select("club_id", "team").distinct(), "club_id")
    own = flags.select(F.explode(F.array_compact(F.array(
        F.when(F.expr("_team and _selected") & F.col("country").isNotNull(), F.struct(F.lit("country").alias("facet"), F.col("country").alias("option"))),
        F.when(F.expr("_team and _country and _selected") & F.col("league").isNotNull(), F.struct(F.lit("league").alias("facet"), F.col("league").alias("option"))),
    ))).alias("o")).select("o.*")
    return by_team.select(F.lit("team").alias("facet"), F.col("team").alias("option")).unionByName(own).distinct().orderBy("facet", F.collate("option", "UNICODE"))


LABEL_LETTERS = 24  # about as many grams come from a label


def fuzzy_distance(text: Column, query: Column, most: int) -> Column:
    """Smallest edit distance between the query and any window of its length in the text; NULL beyond ``most``.

    The distance stops at its bound, and a text too short to come within it has no window to look at.
    """
    n = F.length(query)
    starts = F.when(F.length(text) >= n - F.lit(most), F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))))
    near = F.transform(starts, lambda i: F.levenshtein(F.substring(text, i, n), query, most))
    return F.array_min(F.filter(near, lambda d: d >= 0))


def gram_table(df: DataFrame, key: str, label: str) -> DataFrame:
    """(gram, id, label, n): how often each pair of neighbouring letters stands in each folded label; to be written once and read by ``layered_search``.

    In ranges of grams and sorted, so that a search reads the parts of the file that hold its grams.
    """
    each = df.select(F.col(key).alias("id"), F.col(label).alias("label")).distinct().withColumn("_f", fold(F.col("label"), "spaced_lower")).filter(F.length("_f") > 1)
    each = each.withColumn("_g", F.transform(F.sequence(F.lit(1), F.length("_f") - 1), lambda i: F.substring("_f", i, F.lit(2))))
    # a label's grams are counted in its own row, so what a task holds is labels and not their grams
    times = F.transform(F.array_distinct("_g"), lambda g: F.struct(g.alias("gram"), F.size(F.filter("_g", lambda x: x == g)).alias("n")))
    counted = each.select("id", "label", F.explode(times).alias("_t")).select("_t.gram", "id", "label", "_t.n")
    return counted.repartitionByRange(range_parts(counted, LABEL_LETTERS), "gram", "id").sortWithinPartitions("gram", "id")


def near_by_grams(grams: DataFrame, query: str, most: int) -> DataFrame | None:
    """(id, label) that may hold the folded query within ``most`` edits, by the grams they share; None where edits may leave none.

    Each edit spoils two grams at most, so the others are shared, repeats counted.
    """
    asked = Counter(query[i: i + 2] for i in range(len(query) - 1))
    least = len(query) - 1 - 2 * most
    if least < 1:
        return None
    times = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])
    shared = F.sum(F.least("n", F.element_at(times, F.col("gram"))))
    return grams.filter(F.col("gram").isin(list(asked))).groupBy("id", "label").agg(shared.alias("_s")).filter(F.col("_s") >= least).select("id", "label")


def layered_search(query: str, clubs: DataFrame, aliases: DataFrame, people: DataFrame, k: int = 8, fuzzy: bool = True, tolerance: float = 0.3,
                   grams: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Top-k suggestions: clubs by name, clubs by alias, people by name, then fuzzy clubs and people.

    Each layer orders by its key and keeps k on its own before the union, so at most 5k rows meet. With ``grams``, the ``gram_table`` of clubs
    and that of people, the fuzzy layers look only at labels that share enough grams with the query, and at none where the layers before have k rows.
    """
    q = query.strip().lower()
    folded = fold(F.lit(q), "spaced_lower")
    hit = lambda c: F.contains(F.lower(c), F.lit(q)) | F.contains(fold(F.col(c), "spaced_lower"), folded)
    if len(q) < 2:
        none = clubs.filter(F.lit(False))
        return none.select(F.lit("club").alias("type"), F.col("club_id").cast("string").alias("id"), F.col("club_name").alias("label"), F.lit(0).alias("layer"), F.lit(0).alias("distance"))

    def layer(df: DataFrame, no: int, kind: str, key: str, label: str, distance: Column) -> DataFrame:
        rows = df.select(F.lit(kind).alias("type"), F.col(key).cast("string").alias("id"), F.col(label).alias("label"), F.lit(no).alias("layer"), distance.alias("distance"), F.col(key).alias("_o"))
        # a club may match by several aliases; it is one suggestion
        return first_per_key(rows, ["type", "id"], ["layer", "distance", "label"]).orderBy("distance", "_o").limit(k).drop("_o")

    zero = F.lit(0)
    by_alias = aliases.filter(hit("alias")).join(clubs.select("club_id", "club_name"), "club_id")
    layers = [
        layer(clubs.filter(hit("club_name")), 1, "club", "club_id", "club_name", zero),
        layer(by_alias, 2, "club", "club_id", "club_name", zero),
        layer(people.filter(hit("display_name")), 3, "player", "player_id", "display_name", zero),
    ]
    if fuzzy:
        most = int(tolerance * len(q))
        exact = first_per_key(reduce(DataFrame.unionByName, layers), ["type", "id"], ["layer", "distance"]).agg(F.count(F.lit(1)).alias("n")).scalar()
        for no, df, kind, key, label in ((4, clubs, "club", "club_id", "club_name"), (5, people, "player", "player_id", "display_name")):
            near = near_by_grams(grams[no - 4].filter(exact < k), fold_text(q), most) if grams else None
            if near is not None:
                df = near.select(F.col("id").alias(key), F.col("label").alias(label))
            d = fuzzy_distance(fold(F.col(label), "spaced_lower"), folded, most)
            layers.append(layer(df.withColumn("_d", d).filter(F.col("_d").isNotNull()), no, kind, key, label, F.col("_d")))
    every = first_per_key(reduce(DataFrame.unionByName, layers), ["type", "id"], ["layer", "distance"])
    return every.orderBy("layer", "distance", F.length("id"), "id").limit(k)


def alias_dictionary(mapping: DataFrame, clubs: DataFrame) -> DataFrame:
    """(alias, alias_ascii, club_id): spellings of current clubs that differ from the canonical name."""
    raw, canon = blank_to_null(F.col("raw_name")), F.trim(F.coalesce("canonical_name", F.lit("")))
    rows = mapping.filter(raw.isNotNull() & (F.lower(raw) != F.lower(canon))).join(
        clubs.select(F.col("club_id").alias("canonical_id")), "canonical_id", "left_semi"
    )
    one = rows.select(F.lower(raw).alias("_k"), "canonical_id", raw.alias("alias")).groupBy("_k", "canonical_id").agg(F.min("alias").alias("alias"))
    return one.select("alias", fold(F.col("alias"), "ascii").alias("alias_ascii"), F.col("canonical_id").alias("club_id")).orderBy("club_id", F.lower("alias"))


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(F.collate(column, "UNICODE"))


def city_drilldown(city_key: str | Column, members: DataFrame, clubs: DataFrame, links: DataFrame, entries: DataFrame, players: DataFrame,
                   team: str | None = None) -> DataFrame:
    """Clubs of one city and their active players (one row each; a club without players keeps one row).

    ``city_key`` may be a scalar subquery, so that choosing the city takes no job of its own.
    """
    here = members.filter(F.col("city_key") == city_key).join(clubs, "club_id")
    who = active_people(links if team is None else links.filter(F.col("team") == team), entries).select("club_id", "player_id", "team")
    return here.join(who, "club_id", "left").join(players.select("player_id", "display_name"), "player_id", "left").select(
        "city_key", "club_id", "club_name", "player_id", "display_name", "team"
    )


def player_card(player_ids: list, entries: DataFrame, players: DataFrame, links: DataFrame, clubs: DataFrame, stats: DataFrame, keeper: str = "goalkeeper",
                order_by: Sequence[str] | None = None) -> DataFrame:
    """One wide row per asked player; the saves column only for keepers or when above zero.

    Repeated players, entries, links, clubs and stat rows resolve to their last row by ``order_by``, so a player is one card. Only rows of the asked players are resolved.
    """
    def own(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return keyed(df.filter(F.col("player_id").isin(player_ids)), "player_id", order_by, columns)

    rest = lambda df: [c for c in df.columns if c not in ("player_id", *(order_by or ()))]
    out = own(players, rest(players)).join(own(entries, ["team", "caps"]), "player_id", "left").join(own(links, ["club_id"]), "player_id", "left")
    asked = clubs.join(out.select("club_id"), "club_id", "left_semi")
    out = out.join(keyed(asked, "club_id", order_by, ["club_name", "country", "league"]), "club_id", "left").join(own(stats, rest(stats)), "player_id", "left")
    saves = F.col("saves") if "saves" in out.columns else F.lit(None).cast("long")
    return out.withColumn("saves", F.when((F.col("primary_position") == keeper) | (saves > 0), F.coalesce(saves, F.lit(0))))
