"""Aliases onto canonical ids, id remapping with audit, overrides, and splitting a raw table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ids import hash_n, make_id
from ..functions.text import clean_spaces, fold, is_suspicious_text, normalize_enum, repair_mojibake
from ..skew import first_per_key, top_per_key
from .diff import orphans
from .quality import unique_key


def canonicalize(df: DataFrame, groups: DataFrame, key: str, name: str) -> DataFrame:
    """(raw id, raw name, canonical id, canonical name, rule) for every row.

    ``groups`` is (canonical, alias, alias_no). A group's id is that of the row bearing the canonical
    name, else of the first alias present; rows outside the groups stand for themselves.
    """
    raw = df.select(F.col(key).alias("raw_id"), F.col(name).alias("raw_name"))
    present = raw.join(groups.withColumnRenamed("alias", "raw_name"), "raw_name")
    order = F.struct((F.col("raw_name") != F.col("canonical")), "alias_no", "raw_id")
    ids = present.groupBy("canonical").agg(F.min_by("raw_id", order).alias("canonical_id"))
    of_group = present.select("raw_id", "canonical").join(ids, "canonical")
    out = raw.join(of_group, "raw_id", "left")
    merged = F.col("canonical_id").isNotNull()
    return out.select(
        "raw_id", "raw_name", F.coalesce("canonical_id", "raw_id").alias("canonical_id"), F.coalesce("canonical", "raw_name").alias("canonical_name"),
        F.when(merged, "curated_alias").otherwise("unchanged").alias("alias_rule"), F.when(merged, "high").otherwise("not_applicable").alias("merge_confidence"),
    )


def canonical_table(mapping: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """One row per canonical id: name, distinct spellings, merged rows, uses, and an alias note.

    The note lists distinct spellings only, which the curated groups bound.
    """
    spellings = mapping.select("canonical_id", "canonical_name", "raw_name").distinct().groupBy("canonical_id", "canonical_name").agg(
        F.count(F.lit(1)).alias("alias_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("raw_name") != F.col("canonical_name")).alias("o"), F.col("raw_name").alias("n")))), lambda s: s["n"]), "; ").alias("_note"),
    )
    rows = mapping.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("merged_rows"))
    used = (
        usage.groupBy(F.col(key).alias("raw_id")).agg(F.count(F.lit(1)).alias("n")).join(mapping.select("raw_id", "canonical_id"), "raw_id")
        .groupBy("canonical_id").agg(F.sum("n").alias("uses"))
    )
    out = spellings.join(rows, "canonical_id").join(used, "canonical_id", "left").fillna(0, subset=["uses"])
    return out.withColumn("notes", F.when(F.col("alias_count") > 1, F.concat(F.lit("Merged spellings: "), "_note"))).drop("_note")


def value_counts_label(df: DataFrame, group: str, value: str, n: int = 8, out: str = "label") -> DataFrame:
    """``A:3; B:1`` of the ``n`` most frequent values per group, ties by value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    top = top_per_key(counts, [group], [F.desc("_n"), F.asc(value)], n, "_rn")
    item = F.concat_ws(":", F.col(value).cast("string"), F.col("_n").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("_rn", item.alias("s"))))  # at most n per group
    return top.groupBy(group).agg(F.array_join(F.transform(ordered, lambda s: s["s"]), "; ").alias(out))


def alias_map(mapping: DataFrame, usage: DataFrame, key: str, group: str, n: int = 8) -> DataFrame:
    """Raw to canonical with rule, confidence, use count, and the groups that use it most."""
    counts = usage.groupBy(F.col(key).alias("raw_id")).agg(F.count(F.lit(1)).alias("uses"))
    labels = value_counts_label(usage.select(F.col(key).alias("raw_id"), group), "raw_id", group, n, "used_by")
    return mapping.join(counts, "raw_id", "left").join(labels, "raw_id", "left").fillna(0, subset=["uses"])


def remap_ids(child: DataFrame, mapping: DataFrame, key: str, old: str = "old_id", new: str = "new_id", note: str = "note") -> DataFrame:
    """Rewrite a foreign key; the original stays in ``original_<key>`` and a change leaves a note.

    An old id that is mapped more than once goes to its largest new id, so no child row is doubled.
    """
    m = mapping.groupBy(F.col(old).alias(key)).agg(F.max(new).alias("_new"))
    out = child.join(m, key, "left").withColumn(f"original_{key}", F.col(key)).withColumn(key, F.coalesce("_new", key)).drop("_new")
    a, b = F.col(f"original_{key}"), F.col(key)
    return out.withColumn(note, F.when(a != b, F.concat(F.lit(f"{key} changed from "), a.cast("string"), F.lit(" to "), b.cast("string"))))


def repair_by_hash_suffix(child: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(old_id, new_id) for keys the parent lacks when exactly one current key ends in the same hash."""
    suffix = F.substring_index(F.col(key), "_", -1).alias("_h")
    one = current.select(key, suffix).groupBy("_h").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("new_id")).filter("n = 1")
    stale = orphans(child, current, key).select(F.col("key").alias("old_id"), F.substring_index("key", "_", -1).alias("_h"))
    return stale.join(one, "_h").select("old_id", "new_id")


def approved_remap(dim: DataFrame, child: DataFrame, approved: DataFrame, target: DataFrame, key: str, name: str, strict: bool = True):
    """(remapped child, change audit, approvals with reassigned row counts).

    ``approved`` is (source_id, target_name). Strict raises on a target name that is missing or not
    unique, a source id the dimension lacks, or a child key left without a parent.
    """
    targets = approved.join(target.select(F.col(name).alias("target_name"), F.col(key).alias("target_id")), "target_name", "left")
    moved = child.groupBy(key).agg(F.count(F.lit(1)).alias("rows_reassigned")).withColumnRenamed(key, "source_id")
    resolution = targets.join(moved, "source_id", "left").fillna(0, subset=["rows_reassigned"])
    mapping = targets.select(F.col("source_id").alias("old_id"), F.col("target_id").alias("new_id"))
    out = remap_ids(child, mapping, key)
    audit = out.filter(F.col(f"original_{key}") != F.col(key))
    if strict:
        kept = dim.join(approved.select(F.col("source_id").alias(key)), key, "left_anti")
        failures = {
            "target names that are not unique": unique_key(target.join(approved.select(F.col("target_name").alias(name)), name, "left_semi"), [name]),
            "targets without a row": targets.filter("target_id is null"),
            "sources missing from the dimension": approved.join(dim.select(F.col(key).alias("source_id")), "source_id", "left_anti"),
            "child keys without a parent": orphans(out, kept, key),
        }
        broken = [what for what, rows in failures.items() if rows.limit(1).count()]
        if broken:
            raise ValueError("; ".join(broken))
    return out, audit, resolution


def remap_keys_dedupe(df: DataFrame, mapping: DataFrame, key: str, order: str, updates: Sequence[str], note: str, overrides: DataFrame | None = None) -> DataFrame:
    """Move rows to new keys with field updates; a row whose new key is already held is dropped;
    the first row per key stays; a note override by key replaces the note.

    ``mapping`` is (old_key, new_key, *updates); ``overrides`` is (key, note).
    """
    m = mapping.select(F.col("old_key").alias(key), "new_key", *[F.col(u).alias(f"_u_{u}") for u in updates])
    held = df.select(F.col(key).alias("new_key")).distinct().withColumn("_held", F.lit(True))
    moved = df.join(m, key, "left").join(held, "new_key", "left").filter(
        F.col("new_key").isNull() | F.col("_held").isNull() | (F.col("new_key") == F.col(key))
    )
    moved = moved.withColumns({u: F.coalesce(f"_u_{u}", u) for u in updates}).withColumn(
        note, F.when(F.col("new_key").isNotNull(), F.concat_ws(" ", F.col(note), F.lit("Key updated."))).otherwise(F.col(note))
    ).withColumn(key, F.coalesce("new_key", key)).select(*df.columns)
    out = first_per_key(moved, [key], [order])
    if overrides is not None:
        o = overrides.select(F.col("key").alias(key), F.col("note").alias("_note"))
        out = out.join(o, key, "left").withColumn(note, F.coalesce("_note", note)).drop("_note")
    return out


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(corrected rows, field audit). ``overrides`` is (key, field, new_value, priority, source).

    Overrides apply in priority order, so the highest one stands; the audit holds each real change
    of value on the way and leaves out no-ops.
    """
    o = first_per_key(overrides.filter(F.col("new_value").isNotNull()), [key, "field", "priority"], ["source", "new_value"])
    last = o.groupBy(key).agg(*[F.max_by(F.when(F.col("field") == f, F.col("new_value")), F.when(F.col("field") == f, F.col("priority"))).alias(f"_o_{f}") for f in fields])
    rows = df.join(last, key, "left").select(*[F.coalesce(f"_o_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])
    base = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], list(fields), "field", "base_value")
    w = W.partitionBy(key, "field").orderBy("priority")  # one row per priority level
    steps = o.join(base, [key, "field"]).withColumn("_prev", F.lag("new_value").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    old = F.when(F.col("_first"), F.col("base_value")).otherwise(F.col("_prev"))
    audit = steps.select(key, "field", old.alias("old_value"), "new_value", "source").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return rows, audit


def global_value_map(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace a value everywhere; ``mapping`` is (old_value, new_value)."""
    m = mapping.select(F.col("old_value").alias(column), F.col("new_value").alias("_new"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


OVERRIDE_LINE = r"^\s*-?\s*(.+?)\s*:\s*([a-z_]+)\s*(?:->|=)\s*(.+?)\s*$"


def parse_overrides(lines: DataFrame, names: DataFrame, key: str, name: str, fields: Sequence[str], value: str = "value", pos: str = "pos"):
    """(overrides, unmatched lines) from notes of the form ``- Name: field = new value``.

    Names resolve by their folded spelling to the first key; a line with an unknown name or field,
    or of another form, is kept as unmatched.
    """
    v = F.col(value)
    part = lambda i: F.regexp_extract(v, OVERRIDE_LINE, i)
    parsed = lines.withColumn("_k", F.nullif(fold(part(1), "words_spelled"), F.lit(""))).withColumn("field", part(2)).withColumn("new_value", part(3))
    known = names.withColumn("_k", fold(F.col(name), "words_spelled")).groupBy("_k").agg(F.min(key).alias(key))
    out = parsed.join(known, "_k", "left").withColumn("_ok", F.col(key).isNotNull() & F.col("field").isin(*fields))
    good = out.filter("_ok").select(key, "field", "new_value", F.col(pos).alias("priority"), F.lit("notes").alias("source"))
    return good, out.filter(~F.col("_ok") & (F.trim(v) != "")).select(pos, value)


def repair_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mojibake repair over columns, with the number of repaired cells per row."""
    fixed = {c: repair_mojibake(F.col(c)) for c in columns}
    count = reduce(lambda a, b: a + b, [F.when(~fixed[c].eqNullSafe(F.col(c)), 1).otherwise(0) for c in columns])
    return df.withColumn("repaired_cells", count).withColumns(fixed)


def suspicious_rows(df: DataFrame, key: str, columns: Sequence[str], suggestions: DataFrame) -> DataFrame:
    """Long list of (key, field, value) that still look wrongly decoded, with a suggestion by value."""
    long = df.select(key, *columns).unpivot([key], list(columns), "field", "value").filter(is_suspicious_text(F.col("value")))
    return long.join(suggestions.select("value", "suggestion"), "value", "left")


def clashing_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, id, rows) of minted entry and link ids that stand for more than one row; empty when all is well."""
    of = lambda name, key: tables[name].groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.lit(name).alias("table"), "id", "rows")
    return of("entries", "squad_entry_id").unionByName(of("links", "link_id"))


def relational_split(raw: DataFrame, codes: DataFrame, positions: dict[str, str], digits: int = 8) -> dict[str, DataFrame]:
    """players, entries, clubs, links and sources from one raw roster table.

    ``raw`` is (team, player_name, club_name, position, source_name, source_url); ``codes`` maps team to
    team_code. Keys are minted from the cleaned names; the first spelling in name order stands. Entry and link ids have ``digits`` hash
    digits: 8 suit some ten thousand rows, 16 any number; ``clashing_ids`` tells.
    """
    c = {k: clean_spaces(F.col(k)) for k in ("team", "player_name", "club_name", "position", "source_name", "source_url")}
    r = raw.select(*[v.alias(k) for k, v in c.items()]).join(codes, "team", "left")
    name, club, code = F.col("player_name"), F.col("club_name"), F.col("team_code").cast("string")
    r = r.withColumn("player_id", make_id("p", name, [F.lit("player"), code, fold(name, "ascii")], scope=code, max_len=32)).withColumn(
        "club_id", make_id("c", club, [F.lit("club"), fold(club, "ascii")])
    ).withColumn("primary_position", normalize_enum(F.col("position"), positions))
    players = first_per_key(r.select("player_id", F.col("player_name").alias("display_name"), fold(name, "ascii").alias("name_ascii"), "primary_position"), ["player_id"], ["display_name", "primary_position"])
    clubs = first_per_key(r.select("club_id", "club_name", fold(club, "ascii").alias("club_name_ascii")), ["club_id"], ["club_name"])
    entries = r.select(
        F.concat_ws("_", F.lit("se"), F.lower(code), hash_n(F.lit("squad_entry"), code, F.col("player_id"), n=digits)).alias("squad_entry_id"),
        "team", "team_code", "player_id", F.col("primary_position").alias("position_group"), F.lit("active").alias("squad_status"),
    )
    links = r.select(F.concat_ws("_", F.lit("pc"), hash_n(F.lit("link"), code, F.col("player_id"), F.col("club_id"), n=digits)).alias("link_id"), "player_id", "club_id", "team")
    sources = r.select("source_name", "source_url").distinct().withColumn("source_id", make_id("src", F.col("source_name"), [F.lit("source"), F.col("source_name"), F.col("source_url")], max_len=16))
    return {"players": players, "entries": entries, "clubs": clubs, "links": links, "sources": sources}


def missing_codes(raw: DataFrame, codes: DataFrame, team: str = "team") -> DataFrame:
    return raw.select(team).distinct().join(codes.select(team), team, "left_anti")
