"""Deterministic keys: slug, short hash, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import clean_spaces, fold


def slugify(c: Column, sep: str = "_", max_len: int | None = 40, fallback: str = "unknown") -> Column:
    base = F.lower(fold(F.translate(c, "\u00a0", " "), "ascii"))
    slug = F.btrim(F.regexp_replace(base, "[^a-z0-9]+", sep), F.lit(sep))
    if max_len:
        slug = F.btrim(F.left(slug, F.lit(max_len)), F.lit(sep))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def hash_n(*parts: Column, clean: bool = True, n: int = 8) -> Column:
    """First ``n`` hex digits of SHA-1 over the parts joined by a double bar.

    ``clean`` collapses spaces and lowercases first; the raw recipe hashes parts as they are, so
    the two give different keys on purpose.
    """
    ready = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    if clean:
        ready = [F.lower(clean_spaces(p)) for p in ready]
    return F.left(F.sha1(F.concat_ws("||", *ready).cast("binary")), F.lit(n))


def make_id(prefix: str, slug: Column | None, hashed: list[Column], scope: Column | str | None = None,
            max_len: int | None = 40, clean: bool = True) -> Column:
    parts: list[Column] = [F.lit(prefix)]
    if scope is not None:
        parts.append(F.lower(F.lit(scope) if isinstance(scope, str) else scope))
    if slug is not None:
        parts.append(slugify(slug, max_len=max_len))
    return F.concat_ws("_", *parts, hash_n(*hashed, clean=clean))


def city_key(country: Column, city: Column) -> Column:
    slug = lambda c: slugify(c, sep="-", max_len=None, fallback="blank")
    return F.concat_ws("__", slug(country), slug(city), hash_n(country, city, clean=False))
