"""Text expressions, all of built-in functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .match import _bound


def _decompositions() -> tuple[dict[str, str], str, dict[str, str]]:
    """Of the characters up to U+FFFF: those that decompose to one other, those that are marks and go, and those that decompose to several or none.

    Decompositions are compatible ones without their combining marks. Syllables of Hangul are left out: they follow from their number.
    """
    one, marks, several = {}, [], {}
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp < 0xE000 or HANGUL <= cp < HANGUL + 11172:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if not base:
            marks.append(ch)
        elif base != ch and len(base) == 1:
            one[ch] = base
        elif base != ch:
            several[ch] = base
    return one, "".join(marks), several


HANGUL = 0xAC00  # the first of 11172 syllables: 19 leading letters times 21 vowels times 28 trailing ones, the first of which is none
_LEADING, _VOWELS, _TRAILING = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
ONE_TO_ONE, MARKS, ONE_TO_MANY = _decompositions()


# Letters with no decomposition, and their spelling.
SINGLE_LETTERS = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L"}
DOUBLE_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}

# What each caller drops from organization names: tokens with or without dots, whole words beside them, phrases after them; and whether & is spelled out.
ORG_FORMS = {
    "scorer": (["fc", "afc", "sk", "cf", "sc", "ac", "fk"], [], ["football club", "soccer club", "club de football", "club", "calcio", "deportivo", "sporting club"], True),
    "first_scorer": (["fc", "sk", "afc"], ["club", "cf", "sc", "ac", "fk"], [], True),
    "triage": (["fc", "afc", "sc", "ac", "fk"], ["club"], ["football club", "soccer club", "sporting club"], False),
}
ORG_TOKENS = ORG_FORMS["scorer"][0]

# Administrative words that do not identify a place.
GENERIC_PLACE_TOKENS = [
    "city", "county", "department", "district", "governorate", "metropolitan", "municipality", "province", "region",
    "state",
]

# Names of the months.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

# Characters that betray a wrong decoding, and the usual repairs.
MOJIBAKE_MARKERS = ["Ã", "Â", "Å", "â", "√", "�"]
MOJIBAKE_REPAIRS = {
    "√©": "é", "√≥": "ó", "√°": "á", "√≠": "í", "√±": "ñ", "√º": "ü", "√∂": "ö", "√ß": "ç", "≈Ñ": "ń", "≈ë": "ő", "ƒü": "ğ", "ÃÅ": "á", "√∫": "ú",
}


def clean_spaces(c: Column) -> Column:
    # single plain spaces, nearly all of them, are no match and cost nothing
    return F.trim(F.regexp_replace(c, r"[\s\u00A0]{2,}|[\t\n\x0B\f\r\u00A0]", " "))


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def _spelled_out(c: Column) -> Column:
    """Letters that decompose to several as these; others stay. Only texts that hold one are taken apart, and each of their letters is looked at once."""
    many, spelled = "".join(ONE_TO_MANY), F.split(F.lit("\x01".join(ONE_TO_MANY.values())), "\x01")  # one constant: a literal for each would take the driver long

    def letter(ch: Column) -> Column:
        n, place = F.ascii(ch) - HANGUL, F.call_function("locate", ch, F.lit(many))
        at = lambda letters, i: F.substring(F.lit(letters), i.cast("int") + 1, F.lit(1))
        last = F.when(n % 28 > 0, at(_TRAILING, n % 28 - 1)).otherwise("")
        syllable = F.concat(at(_LEADING, F.floor(n / 588)), at(_VOWELS, F.floor(n % 588 / 28)), last)
        return F.when(F.octet_length(ch) == 1, ch).when(n.between(0, 11171), syllable).when(place > 0, F.get(spelled, place - 1)).otherwise(ch)

    # a table lookup for each letter beyond ASCII; a class of all of them would try its ranges one by one
    rest = F.regexp_replace(c, r"[\x00-\x7F]+", "")
    holds = (F.length(F.translate(rest, many, "")) < F.length(rest)) | rest.rlike(f"[\\x{{{HANGUL:x}}}-\\x{{{HANGUL + 11171:x}}}]")
    return F.when(holds, F.array_join(F.transform(F.split(c, ""), letter), "")).otherwise(c)


def strip_marks(c: Column) -> Column:
    """Compatible decomposition without combining marks, of every character up to U+FFFF: letters without accents, ligatures and fractions spelled out, syllables as their letters.

    ASCII has nothing to decompose. Of other texts nearly all characters are translated in one pass.
    """
    plain = lambda x: _bound(F.translate(x, "".join(ONE_TO_ONE) + MARKS, "".join(ONE_TO_ONE.values())), _spelled_out)
    return _bound(c, lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(plain(x)))


def transliterate_letters(c: Column) -> Column:
    c = F.translate(c, "".join(SINGLE_LETTERS), "".join(SINGLE_LETTERS.values()))
    for letter, spelled in DOUBLE_LETTERS.items():
        c = F.replace(c, F.lit(letter), F.lit(spelled))
    return c


@dataclass(frozen=True)
class FoldProfile:
    """What one folding variant does, in the order the fields stand."""

    transliterate: bool = False
    ascii_only: bool = False
    lower: bool = False
    ampersand_word: bool = False
    hyphen_to_space: bool = False
    drop: str | None = None  # each match becomes one space; a plain single space need not match
    collapse: bool = False  # runs of white space become one space


FOLD_PROFILES = {
    "ascii": FoldProfile(ascii_only=True),
    "marks": FoldProfile(),
    "marks_lower": FoldProfile(lower=True),
    "letters": FoldProfile(ascii_only=True, lower=True, drop="[^a-z ]+"),
    "letters_spelled": FoldProfile(transliterate=True, ascii_only=True, lower=True, hyphen_to_space=True, drop="[^a-z ]+"),
    "spaced_lower": FoldProfile(ascii_only=True, lower=True, collapse=True),
    "words": FoldProfile(ascii_only=True, lower=True, drop="[^a-z0-9]{2,}|[^a-z0-9 ]"),
    "words_spelled": FoldProfile(transliterate=True, lower=True, ampersand_word=True, drop="[^a-z0-9]{2,}|[^a-z0-9 ]"),
    "words_and": FoldProfile(lower=True, ampersand_word=True, drop="[^a-z0-9]{2,}|[^a-z0-9 ]"),
    "place": FoldProfile(lower=True, drop=r"[^\p{L}\p{N}]{2,}|[^\p{L}\p{N} ]"),
}


def _unaccented(c: Column, p: FoldProfile) -> Column:
    if p.transliterate:
        c = transliterate_letters(c)
    c = strip_marks(c)
    return F.regexp_replace(c, r"[^\x00-\x7F]", "") if p.ascii_only else c


def fold(c: Column, profile: str | FoldProfile = "words") -> Column:
    p = FOLD_PROFILES[profile] if isinstance(profile, str) else profile
    c = F.coalesce(c, F.lit(""))
    # text with as many bytes as characters is ASCII and has nothing to unaccent
    c = F.when(F.octet_length(c) == F.length(c), c).otherwise(_unaccented(c, p))
    if p.lower:
        c = F.lower(c)
    if p.ampersand_word:
        c = F.replace(c, F.lit("&"), F.lit(" and "))
    if p.hyphen_to_space:
        c = F.replace(c, F.lit("-"), F.lit(" "))
    if p.drop:
        c = F.regexp_replace(c, p.drop, " ")
    elif p.collapse:
        c = F.regexp_replace(c, r"\s+", " ")
    return F.trim(c) if p.drop or p.collapse or p.lower else c


def fold_text(s: str) -> str:
    """The ``spaced_lower`` folding of one text at hand, such as a query."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", "".join(c for c in plain if c.isascii()).lower()).strip(" ")


def norm_key(c: Column) -> Column:
    return fold(c, "words")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def token_key(c: Column, profile: str = "letters_spelled") -> Column:
    return F.array_join(F.array_sort(tokens(fold(c, profile))), " ")


def concat_key(c: Column, profile: str = "letters_spelled") -> Column:
    return F.replace(fold(c, profile), F.lit(" "), F.lit(""))


def strip_org_suffixes(c: Column, form: str = "scorer") -> Column:
    """The name in a caller's normal form: see ``ORG_FORMS``."""
    dotted, plain, phrases, spelled = ORG_FORMS[form]
    c = F.lower(strip_marks(F.coalesce(F.trim(c), F.lit(""))))
    if spelled:
        c = F.replace(c, F.lit("&"), F.lit(" and "))
    first = [r"\.?".join(t) + r"\.?" for t in dotted] + list(plain)
    for words in (first, phrases):
        if words:
            c = F.regexp_replace(c, rf"\b({'|'.join(words)})\b", " ")
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def strip_generic_tokens(c: Column, stop: Sequence[str] = GENERIC_PLACE_TOKENS) -> Column:
    simple = F.regexp_replace(F.translate(fold(c, "marks_lower"), "-,", "  "), r"\s+", " ")
    return F.array_join(F.filter(tokens(simple), lambda t: ~t.isin(*stop)), " ")


def is_token_prefix(a: Column, b: Column) -> Column:
    ta, tb = tokens(a), tokens(b)
    return (F.size(ta) > 0) & (F.size(ta) < F.size(tb)) & (F.slice(tb, F.lit(1), F.greatest(F.size(ta), F.lit(1))) == ta)


def normalize_enum(c: Column, spellings: dict[str, str], default: str = "unknown") -> Column:
    key = F.lower(clean_spaces(c))
    m = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.coalesce(F.element_at(m, key), F.lit(default))


# Position spellings.
POSITIONS = {
    "goalkeepers": "goalkeeper", "goalkeeper": "goalkeeper", "gk": "goalkeeper",
    "defenders": "defender", "defender": "defender", "df": "defender",
    "midfielders": "midfielder", "midfielder": "midfielder", "mf": "midfielder",
    "forwards": "forward", "forward": "forward", "fw": "forward",
}


def normalize_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t == "true", True).when(t == "false", False)


def coerce(c: Column, kind: str) -> Column:
    """Text to ``float``, ``int`` (also "3.0"), ``bool`` or trimmed text; NULL when it does not fit."""
    t = blank_to_null(c)
    if kind == "float":
        return t.try_cast("double")
    if kind == "int":
        d = t.try_cast("double")
        return F.coalesce(t.try_cast("int"), F.when(d == F.floor(d), d.try_cast("int")))
    if kind == "bool":
        return normalize_bool(t)
    return t


def has_mojibake(c: Column) -> Column:
    return c.rlike("|".join(MOJIBAKE_MARKERS))


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 read as Latin-1 where a marker shows it and the bytes are valid, then the repair table."""
    encodable = ~c.rlike(r"[^\x00-\xFF]")
    raw = F.when(encodable & has_mojibake(c), F.encode(F.when(encodable, c), "ISO-8859-1"))
    fixed = F.try_validate_utf8(raw.cast("string"))
    out = F.coalesce(fixed, c)
    for bad, good in MOJIBAKE_REPAIRS.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def is_suspicious_text(c: Column) -> Column:
    return c.rlike("[_�√Ã]")


def contains_any(hay: Column, needles: Sequence[str], profile: str = "words") -> Column:
    h = fold(hay, profile)
    hit = F.lit(False)
    for n in needles:
        folded = fold(F.lit(n), profile)
        hit = hit | ((folded != "") & F.contains(h, folded))
    return hit


def normalize_external_id(c: Column, pattern: str = "Q[0-9]+") -> Column:
    return F.nullif(F.regexp_extract(F.upper(clean_spaces(c)), pattern, 0), F.lit(""))


def file_title(c: Column) -> Column:
    """Last path part of a URL or file name, decoded, with spaces, under the ``File:`` prefix."""
    last = F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)
    name = F.translate(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), "_", " ")
    name = F.regexp_replace(F.trim(name), "^[Ff]ile:", "")
    return F.when(name != "", F.concat(F.lit("File:"), name))


def title_to_url(c: Column, base: str) -> Column:
    name = F.translate(F.regexp_replace(c, "^File:", ""), " ", "_")
    return F.concat(F.lit(base), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))


def url_title(c: Column, marker: str = "/wiki/") -> Column:
    """Page title after ``marker`` in a URL path, decoded."""
    path = F.regexp_replace(c, "[?#].*$", "")
    tail = F.substring(path, F.instr(path, marker) + F.lit(len(marker)), F.length(path))
    title = F.translate(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), "_", " ")
    return F.when(F.instr(path, marker) > 0, title)


# The entities that occur in the sources.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&amp;": "&"}


def strip_markup(c: Column) -> Column:
    for entity, ch in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return clean_spaces(F.regexp_replace(c, "<[^>]+>", " "))


def strip_footnotes(c: Column) -> Column:
    return clean_spaces(F.regexp_replace(c, r"\[[^\]]*\]", ""))


def first_non_blank(*cs: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cs])


def append_note(old: Column, new: Column, sep: str = " | ") -> Column:
    kept = blank_to_null(old)
    return (
        F.when(kept.isNull(), new)
        .when(new.isNull() | (F.instr(kept, new) > 0), kept)
        .otherwise(F.concat(kept, F.lit(sep), new))
    )


def query_variants(name: Column, n: int = 8, suffixes: Sequence[str] = ("football club", "soccer club")) -> Column:
    """Ordered distinct spellings to search for: as written, suffixed, without legal form, without marks."""
    squeeze = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ \-,.]+|[ \-,.]+$", "")
    dotted = "|".join(r"\.?".join(t) + r"\.?" for t in ORG_TOKENS)

    def forms(base: Column) -> Column:
        bare = squeeze(F.regexp_replace(base, rf"(?i)\b({dotted}|football club|soccer club|sporting club|club)\b", ""))
        every = lambda b: F.array(base, *[F.concat(base, F.lit(f" {s}")) for s in suffixes], b, F.concat(b, F.lit(f" {suffixes[0]}")))
        return _bound(bare, every)

    spelled = F.transform(F.flatten(F.transform(_with_folded(clean_spaces(name)), forms)), squeeze)
    return F.slice(_first_spellings(F.filter(spelled, lambda v: v != "")), 1, n)


def _with_folded(base: Column) -> Column:
    """The text, and the text without marks if that is another one."""
    return _bound(base, lambda b: _bound(strip_marks(b), lambda f: F.when(b == f, F.array(b)).otherwise(F.array(b, f))))


def _first_spellings(every: Column) -> Column:
    """The items that no earlier one equals but for case. Each is lowered once."""
    both = lambda e: F.struct(e.alias("v"), F.transform(e, lambda v: F.lower(v)).alias("low"))
    kept = lambda x: F.filter(x["v"], lambda v, i: F.array_position(x["low"], F.get(x["low"], i)) == i + 1)
    return _bound(every, lambda e: _bound(both(e), kept))


def manual_search_hint(name: Column, n: int = 3) -> Column:
    base = clean_spaces(F.regexp_replace(name, r"\s*\([^)]*\)\s*", " "))
    forms = lambda b: F.array(b, F.concat(b, F.lit(" FC")), F.concat(b, F.lit(" football club")))
    return F.array_join(F.slice(_first_spellings(F.flatten(F.transform(_with_folded(base), forms))), 1, n), " | ")


def split_list(c: Column, sep: str = "|") -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), "\\" + sep)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def sorted_unique(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def join_list(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def clean_note(c: Column, phrases: Sequence[str]) -> Column:
    for p in phrases:
        c = F.replace(c, F.lit(p), F.lit(""))
    return F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "^[ ;]+|[ ;]+$", "")


def date_label(day: Column) -> Column:
    """Month name, day and year, from the first three parts of a date text; NULL unless all are numbers above zero and the month exists."""
    part = lambda i: F.get(F.split(day, "-"), F.lit(i)).try_cast("int")
    year, month, number = part(0), part(1), part(2)
    name = F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1)
    return F.when((year > 0) & (month > 0) & (number > 0), F.concat(name, F.lit(" "), number.cast("string"), F.lit(", "), year.cast("string")))


def source_label(c: Column, labels: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(m, c), F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, F.lit(2), F.length(c)))))


def country_code_fallback(c: Column) -> Column:
    """Three capital letters for a name the code table does not hold."""
    return F.upper(F.left(F.regexp_replace(c, "[^A-Za-z]", ""), F.lit(3)))
