"""Lookups and joins. Key columns come by name; Spark picks broadcast or shuffle from sizes it checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import country_code_fallback, split_list, strip_generic_tokens, tokens
from ..skew import first_per_key, last_per_key, salted_left_join


def lookup(df: DataFrame, dim: DataFrame, on: str, order_by: Sequence[str] | None = None, salt: int = 0) -> DataFrame:
    """Many-to-one left lookup. With ``order_by`` a repeated dimension key resolves to its last row.

    ``salt`` spreads a hot key of ``df`` when the dimension is too large to broadcast.
    """
    if order_by:
        dim = last_per_key(dim, [on], order_by)
    return salted_left_join(df, dim, on, salt) if salt else df.join(dim, on, "left")


def keyed(dim: DataFrame, key: str, order_by: Sequence[str] | None = None, columns: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """One row per key, as an index built by overwriting has: the last by ``order_by``, or by the other columns that are asked for.

    Only ``key`` and ``columns`` (all if None) are read and come out, so a wide dimension does not move whole. ``unique`` declares that no key repeats: then nothing is resolved.
    """
    columns = [c for c in dim.columns if c != key] if columns is None else [c for c in columns if c != key]
    order = list(order_by or columns)
    if unique:
        return dim.select(key, *columns)
    if not order:
        return dim.select(key).distinct()
    return last_per_key(dim.select(*dict.fromkeys([key, *columns, *order])), [key], order).select(key, *columns)


def active_only(df: DataFrame, status: str = "squad_status", value: str = "active") -> DataFrame:
    """Rows in the given status; a blank status counts as that status."""
    s = F.trim(F.coalesce(F.col(status), F.lit("")))
    return df.filter((s == "") | (s == value))


def active_people(people: DataFrame, entries: DataFrame, key: str = "player_id") -> DataFrame:
    return people.join(active_only(entries).select(key), key, "left_semi")


def roster(entries: DataFrame, players: DataFrame, links: DataFrame, clubs: DataFrame, teams: DataFrame | None = None,
           active: bool = True, salt: int = 0, order_by: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """entry ⟕ player ⟕ link ⟕ club (⟕ team). ``active=False`` keeps the whole population.

    A repeated key of a dimension or link resolves to its last row by ``order_by``, so every entry stays one row; ``unique`` declares that none repeats.
    ``salt`` spreads a club that holds much of the roster when the clubs are too many to broadcast.
    """
    out = active_only(entries) if active else entries
    rest = lambda d, k: [c for c in d.columns if c != k and c not in (order_by or ())]
    players, clubs = (keyed(d, k, order_by, rest(d, k), unique) for d, k in ((players, "player_id"), (clubs, "club_id")))
    out = out.join(players, "player_id", "left").join(keyed(links, "player_id", order_by, ["club_id"], unique), "player_id", "left")
    out = salted_left_join(out, clubs, "club_id", salt) if salt else out.join(clubs, "club_id", "left")
    if teams is not None:
        out = out.join(keyed(teams, "team_code", order_by, [c for c in teams.columns if c not in out.columns], unique), "team_code", "left")
    return out


def members_of(links: DataFrame, entries: DataFrame, people: DataFrame, dim: str = "club_id", key: str = "player_id") -> DataFrame:
    """Reverse lookup in long form: one row per (dimension, active member that exists)."""
    return active_people(links.select(dim, key), entries, key).join(people, key)


def groups_of(links: DataFrame, dim: str = "club_id", group: str = "team") -> DataFrame:
    """Distinct groups per dimension, long form."""
    return links.select(dim, group).distinct()


def context_join(players: DataFrame, squad: DataFrame, link: DataFrame, key: str, squad_order: Sequence[str],
                 link_order: Sequence[str]) -> DataFrame:
    """First squad row and first link row per key, left-merged onto every player."""
    context = first_per_key(squad, [key], squad_order).join(first_per_key(link, [key], link_order), key, "left")
    return players.join(context, key, "left")


def category_of(df: DataFrame, name: str, members: DataFrame, aliases: DataFrame | None = None, out: str = "category") -> DataFrame:
    """Group of a name: by its own spelling, else by its first listed alias that is a member.

    ``members`` is (member, category); ``aliases`` is (name, alias, alias_no).
    """
    own = members.select(F.col("member").alias(name), F.col("category").alias("_own"))
    df = df.join(own, name, "left")
    if aliases is None:
        return df.withColumnRenamed("_own", out)
    via = (
        aliases.join(members, F.col("alias") == F.col("member"))
        .groupBy(F.col("name").alias(name))
        .agg(F.min_by("category", "alias_no").alias("_via"))
    )
    return df.join(via, name, "left").withColumn(out, F.coalesce("_own", "_via")).drop("_own", "_via")


def geo_backfill(master: DataFrame, baseline: DataFrame, city: DataFrame, key: str = "club_id", ids: str = "club_ids",
                 strict: bool = True) -> DataFrame:
    """Baseline and city attributes for every master row. Strict raises when any row lacks either one.

    The misses stay visible as a NULL ``city_key`` or ``baseline_found`` when not strict.
    """
    exploded = city.withColumn(key, F.explode(F.col(ids))).drop(ids)
    out = master.join(baseline.withColumn("baseline_found", F.lit(True)), key, "left").join(exploded, key, "left")
    if strict:
        missing = out.filter(F.col("baseline_found").isNull() | F.col("city_key").isNull())
        sample = [r[0] for r in missing.select(key).take(10)]
        if sample:
            raise ValueError(f"rows without baseline or city: {sample}")
    return out


def explode_pipe_ids(city: DataFrame, ids: str, key: str) -> DataFrame:
    return city.withColumn(key, F.explode(split_list(F.col(ids)))).drop(ids)


def apply_results(work: DataFrame, results: DataFrame, key: str, columns: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Take the result's columns only where every required one is filled; else keep the work row."""
    full = F.lit(True)
    for c in required:
        full = full & (F.trim(F.coalesce(F.col(f"r.{c}").cast("string"), F.lit(""))) != "")
    joined = work.alias("w").join(results.alias("r"), key, "left")
    return joined.select(
        *[F.when(full, F.col(f"r.{c}")).otherwise(F.col(f"w.{c}")).alias(c) if c in columns else
          (F.col(key) if c == key else F.col(f"w.{c}")) for c in work.columns]
    )


def fill_blank(df: DataFrame, src: DataFrame, key: str, columns: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Fill blank cells from ``src``; ``<col>_filled`` marks the cells that changed."""
    j = df.alias("d").join(src.select(key, *columns).alias("s"), key, "left")
    out = []
    for c in df.columns:
        if c == key or c not in columns:
            out.append(F.col(key) if c == key else F.col(f"d.{c}"))
            continue
        old, new = F.col(f"d.{c}"), F.col(f"s.{c}")
        usable = new.isNotNull() & (F.trim(new.cast("string")) != "")
        blank = old.isNull() | (F.trim(old.cast("string")) == "")
        take = usable & (~old.eqNullSafe(new) if overwrite else blank)
        out += [F.when(take, new).otherwise(old).alias(c), take.alias(f"{c}_filled")]
    return j.select(*out)


def fill_counts(filled: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = filled.agg(*[F.count_if(F.col(f"{c}_filled")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "field", "filled")


def attach_attributes(df: DataFrame, src: DataFrame, keys: Sequence[str], columns: Sequence[str], default=0,
                      order_by: Sequence[str] | None = None) -> DataFrame:
    """New columns by key with a default for rows without a match."""
    side = src.select(*keys, *columns, *[c for c in (order_by or []) if c not in (*keys, *columns)])
    if order_by:
        side = last_per_key(side, list(keys), order_by).select(*keys, *columns)
    return df.join(side, list(keys), "left").fillna(default, subset=list(columns))


def first_person(pairs: DataFrame, people: DataFrame, block: str, name: str, key: str, label: str) -> DataFrame:
    """``pairs`` (block, name, ...) with the id and display name of the first person, by id, who bears the name there."""
    bearer = people.groupBy(block, name).agg(F.min(F.struct(key, label)).alias("_p")).select(block, name, "_p.*")
    return pairs.join(bearer, [block, name], "left")


def country_codes(df: DataFrame, codes: DataFrame, on: str, name: str, out: str = "country_code") -> DataFrame:
    """The code of each row's country from ``codes`` (on, code), or three capital letters of its name."""
    known = keyed(codes.select(on, F.col("code").alias("_code")), on)
    return df.join(known, on, "left").withColumn(out, F.coalesce("_code", country_code_fallback(F.col(name)))).drop("_code")


def _token_prefixes(c: str) -> Column:
    """Every leading run of tokens of a simplified name, the whole name included."""
    t = tokens(F.col(c))
    return F.transform(F.sequence(F.lit(1), F.size(t)), lambda n: F.array_join(F.slice(t, F.lit(1), n), " "))


def prefix_candidates(people: DataFrame, places: DataFrame, block: str, name: str, candidate: str) -> DataFrame:
    """(name, place) in the same block whose simplified names are equal, or where one is a strict
    token prefix of the other; names that equal a place of the block exactly are left out.

    The longer name lists its token prefixes, and a prefix must equal the shorter name: two
    equi-joins that meet on hits only, however many names share a first token. Distinct names
    join, not rows.
    """
    p = people.select(block, name).distinct().join(
        places.select(block, F.col(candidate).alias(name)).distinct(), [block, name], "left_anti"
    ).withColumn("name_simple", strip_generic_tokens(F.col(name))).filter("name_simple <> ''")
    c = places.select(block, candidate).distinct().withColumn("candidate_simple", strip_generic_tokens(F.col(candidate)))
    c = c.filter("candidate_simple <> ''")
    equal, inside, around = "equal after dropping generic words", "name is contained in candidate", "candidate is contained in name"
    whole = F.col("name_simple") == F.col("candidate_simple")
    by_name = p.withColumn("_k", F.explode(_token_prefixes("name_simple"))).join(c.withColumn("_k", F.col("candidate_simple")), [block, "_k"])
    by_place = p.withColumn("_k", F.col("name_simple")).join(c.withColumn("_k", F.explode(_token_prefixes("candidate_simple"))), [block, "_k"]).filter(~whole)
    out = by_name.withColumn("review_reason", F.when(whole, equal).otherwise(around)).unionByName(by_place.withColumn("review_reason", F.lit(inside)))
    return out.drop("_k")
