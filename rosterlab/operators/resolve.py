"""Entity resolution over candidate tables: scores, decisions, and review queues."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.match import rule_reasons, rule_score, similarity
from ..functions.num import haversine_km, year_plausibility
from ..functions.text import fold, manual_search_hint, norm_key, strip_org_suffixes, tokens
from ..session import cut_lineage
from ..skew import first_per_key, number_rows, top_per_key

Rule = tuple[Column, int, str]

# Words that mark a club, a wrong entity, or a wrong sport in a description.
CLUB_HINTS = ["football", "soccer", "association football", "club", "team", "sports club"]
FOOTBALL_HINTS = ["association football", "football club", "soccer club", "soccer team", "football team", "footballer", "soccer"]
WRONG_SPORT_HINTS = [
    "australian rules", "baseball", "basketball", "cricket", "field hockey", "handball", "ice hockey", "rugby", "volleyball", "water polo",
]
BAD_ENTITY_HINTS = [
    "album", "asteroid", "band", "company", "district", "family name", "film", "given name", "horse", "human", "municipality", "person",
    "province", "railway station", "running event", "school", "settlement", "ship", "song", "sports discipline", "star system", "submarine",
    "surname", "taxon", "town", "university", "village",
]
# Words that cost a scored candidate points; the triage above has a list of its own.
SCORE_PENALTY_HINTS = [
    "band", "album", "film", "song", "company", "human", "person", "given name", "surname", "settlement", "city", "town", "village", "commune",
    "district", "province", "municipality", "railway station", "airport", "school", "university",
]
# Weight of a populated-place class.
FEATURE_WEIGHTS = {"PPLC": 12, "PPLA": 10, "PPLA2": 9, "PPLA3": 8, "PPLA4": 7, "PPL": 6, "PPLX": 3}


def _normal_forms(df: DataFrame, columns: Sequence[str], form: Callable[[Column], Column], normal: Mapping[str, str] | None) -> tuple[DataFrame, list[Column], list[str]]:
    """The rows, the normal form of each text column, and the columns added for it.

    ``normal`` names the columns that hold a form already, so that a text is folded once on its own table and not in every pair. The others become columns here,
    so each is computed once however many rules read it.
    """
    normal = normal or {}
    added = {c: f"_n{i}" for i, c in enumerate(columns) if c not in normal}
    df = df.withColumns({n: form(F.col(c)) for c, n in added.items()})
    return df, [F.col(normal[c] if c in normal else added[c]) for c in columns], list(added.values())


def score_rules(df: DataFrame, rules: Sequence[Rule], score: str = "match_score", reasons: str = "match_reasons") -> DataFrame:
    return df.withColumn(score, rule_score(rules)).withColumn(reasons, rule_reasons(rules))


def score_person(df: DataFrame, name: str, label: str, match_text: str, description: str, occupations: str, sports: str, citizenships: str,
                 teams: str, context: Column, positions: str, position_words: Column, dob: str, pob: str, image: str,
                 normal: Mapping[str, str] | None = None) -> DataFrame:
    """Person candidates under the published weights; ``context`` and ``position_words`` are arrays of
    normalized words that count as the right country or role. ``normal`` {text column: column of its ``norm_key``} spares the folding.
    """
    texts = [name, label, match_text, description, occupations, sports, citizenships, teams, positions]
    df, (n, lab, mt, desc, occ, sport, cit, team, pos), added = _normal_forms(df, texts, norm_key, normal)
    has = n != ""
    exact, search = has & (lab == n), has & (mt == n)
    partial = has & (F.contains(lab, n) | F.contains(n, lab))
    any_word = lambda hay, *words: reduce(lambda a, b: a | b, [F.contains(hay, F.lit(w)) for w in words])
    any_in = lambda hay, words: F.exists(words, lambda w: (w != "") & F.contains(hay, w))
    rules = [
        (exact, 45, "exact_label_match"),
        (~exact & search, 35, "exact_search_match"),
        (~exact & ~search & partial, 25, "partial_label_match"),
        (any_word(desc, "association football player", "footballer", "soccer player", "football player"), 25, "football_description"),
        (any_word(occ, "association football player", "football player"), 35, "football_occupation"),
        (any_word(sport, "association football", "soccer"), 15, "association_football_sport"),
        (any_in(cit, context), 20, "citizenship_matches_team_context"),
        (any_in(team, context), 30, "team_membership_matches_team_context"),
        (any_in(pos, position_words), 10, "position_matches_roster_context"),
        (_present(dob), 5, "has_date_of_birth"),
        (_present(pob), 5, "has_place_of_birth"),
        (_present(image), 3, "has_image"),
    ]
    return score_rules(df, rules).drop(*added)


def _present(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""


def best_and_second(candidates: DataFrame, key: str, order_by: Sequence[Column], seconds: dict[str, str]) -> DataFrame:
    """Per key the best row, and ``seconds`` {output: column} of the runner-up, from one pass.

    Only two rows per key and task are shuffled.
    """
    rest = [c for c in candidates.columns if c != key]
    top = top_per_key(candidates, [key], order_by, 2, "_rn")
    pick = lambda i, v: F.first(F.when(F.col("_rn") == i, v), ignorenulls=True)
    out = top.groupBy(key).agg(pick(1, F.struct(*rest)).alias("_b"), *[pick(2, F.col(c)).alias(o) for o, c in seconds.items()])
    return out.select(key, "_b.*", *seconds)


def best_with_margin(entities: DataFrame, candidates: DataFrame, key: str, candidate: str, score: str, min_score: int = 85,
                     min_margin: int = 20, ties: Sequence[str] = ()) -> DataFrame:
    """Decision per entity: auto, ambiguous, low_confidence, or no_match; a missing runner-up scores 0."""
    order = [F.desc(score), *[F.asc(t) for t in ties], F.asc(candidate)]
    two = best_and_second(candidates.select(key, candidate, score, *ties), key, order, {"second": candidate, "second_score": score})
    two = two.select(key, F.col(candidate).alias("best"), F.col(score).alias("best_score"), "second", "second_score")
    out = entities.join(two, key, "left")
    margin = F.col("best_score") - F.coalesce("second_score", F.lit(0))
    return out.withColumn("margin", margin).withColumn(
        "decision",
        F.when(F.col("best").isNull(), "no_match")
        .when((F.col("best_score") >= min_score) & (margin >= min_margin), "auto")
        .when(F.col("second").isNotNull(), "ambiguous")
        .otherwise("low_confidence"),
    )


def merge_candidate_lists(lists: Sequence[DataFrame], key: str, candidate: str, rank: str) -> DataFrame:
    """Union of searches; per (entity, candidate) the first list, then the better rank, wins."""
    tagged = [d.withColumn("list_no", F.lit(i)) for i, d in enumerate(lists)]
    return first_per_key(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), [key, candidate], ["list_no", rank])


def best_rank_per_candidate(searches: DataFrame, key: str, candidate: str, rank: str, query: str) -> DataFrame:
    return first_per_key(searches.filter(F.col(candidate).isNotNull()), [key, candidate], [rank, query])


def prefer_detail_row(details: DataFrame, key: str, preferences: Sequence[Column], tie: str) -> DataFrame:
    """One detail row per candidate: the first that holds the earlier preferences."""
    return first_per_key(details, [key], [*[F.when(p, 0).otherwise(1) for p in preferences], F.col(tie)])


def score_form(c: Column, version: int = 2) -> Column:
    """The normal form that ``score_name_similarity`` compares."""
    return strip_org_suffixes(c, "first_scorer" if version == 1 else "scorer")


def score_name_similarity(df: DataFrame, name: str, name_ascii: str, label: str, search_label: str, description: str, instance_of: str,
                          stadium: str, stadium_lat: str, stadium_lon: str, club_lat: str, club_lon: str, page: str, rank: str,
                          version: int = 2, out: str = "candidate_score", normal: Mapping[str, str] | None = None) -> DataFrame:
    """Club candidate score, 0 to 100. Version 1 has fewer signals and other weights. ``normal`` {text column: column of its ``score_form``} spares the folding."""
    texts = list(dict.fromkeys((name, name_ascii, label, search_label)))
    df, forms, added = _normal_forms(df, texts, lambda c: score_form(c, version), normal)
    of = dict(zip(texts, forms))
    names, lab, slab = [of[c] for c in dict.fromkeys((name, name_ascii))], of[label], of[search_label]
    sim = lambda a, b: F.when((a != "") & (b != ""), similarity(a, b)).otherwise(0.0)
    labels = [lab, slab] if version == 2 else [lab]
    df = df.withColumn("_best", F.greatest(*[sim(n, x) for n in names for x in labels], F.lit(0.0)))
    best = F.col("_best")
    is_name = lambda x: (x != "") & reduce(lambda a, b: a | b, [x == n for n in names])
    desc = F.lower(F.concat_ws(" ", description)) if version == 1 else F.lower(F.concat_ws(" ", description, search_label))
    inst = F.lower(F.coalesce(F.col(instance_of), F.lit("")))
    has = lambda hay, words: reduce(lambda a, b: a | b, [F.contains(hay, F.lit(w)) for w in words])
    score = F.bround(best * 45).cast("int")
    v1 = version == 1
    club_points, other_points = (20, 10) if v1 else (22, 12)
    score = score + F.when(is_name(lab), 25).when(F.lit(not v1) & is_name(slab), 15).otherwise(0)
    score = score + F.when(has(desc, ["football", "soccer"] if v1 else CLUB_HINTS), 15).otherwise(0)
    score = score + F.when(has(inst, ["association football club", "football club"]), club_points).when(
        has(inst, ["sports club", "association football"]), other_points
    ).otherwise(0)
    score = score + F.when(_present(stadium), 10 if v1 else 8).otherwise(0)
    both = _present(stadium_lat) & _present(stadium_lon)
    score = score + F.when(both, 15).when(F.lit(not v1) & _present(club_lat) & _present(club_lon), 7).otherwise(0)
    score = score + F.when(_present(page), 5).otherwise(0)
    if not v1:
        everything = F.concat_ws(" ", desc, inst, F.lower(F.concat_ws(" ", label, search_label)))
        wrong = has(everything, SCORE_PENALTY_HINTS) & ~has(everything, ["football", "soccer"])
        score = score - F.when(wrong, 20).otherwise(0) + F.greatest(F.lit(0), 8 - F.coalesce(F.col(rank), F.lit(99)))
    scored = df.withColumn(out, F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"))
    return scored.drop("_best", *added)


def classify_candidates(entities: DataFrame, candidates: DataFrame, searches: DataFrame, key: str, candidate: str, version: int = 2) -> DataFrame:
    """One row per entity with the best candidate, its status, and the coordinates to propose.

    ``candidates`` has candidate_score, search_rank, stadium_lat/lon, club_lat/lon. ``searches`` has one
    row per query with search_status (``ok…``, ``candidate``, ``api_request_failed``).
    """
    order = [F.desc("candidate_score"), F.asc("search_rank"), F.asc(candidate)]
    best = best_and_second(candidates, key, order, {"second_candidate": candidate, "second_score": "candidate_score"})
    log = searches.groupBy(key).agg(
        F.count_if(F.col("search_status") == "api_request_failed").alias("_failed"),
        F.count_if(F.col("search_status").startswith("ok")).alias("_ok"),
        F.count_if(F.col("search_status") == "candidate").alias("_cands"),
    )
    out = entities.join(best, key, "left").join(log, key, "left")
    top, gap = F.col("candidate_score"), F.col("candidate_score") - F.coalesce("second_score", F.lit(0))
    stadium = _present("stadium_lat") & _present("stadium_lon")
    club = _present("club_lat") & _present("club_lon")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = (
        F.when(top.isNull() & (zero("_failed") > 0) & (zero("_ok") == 0), "api_search_failed_all_queries")
        .when(top.isNull() & (zero("_cands") == 0), "no_candidates_found")
        .when(top.isNull(), "no_candidate_rows_unexpected")
    )
    if version == 2:
        status = (
            status.when((top >= 82) & (gap >= 8) & stadium, "auto_candidate_high_stadium_coords")
            .when((top >= 78) & stadium, "candidate_stadium_coords_needs_spotcheck")
            .when((top >= 72) & (stadium | club), "candidate_coords_need_review")
            .when(top >= 68, "candidate_no_coordinates")
        )
    else:
        status = (
            status.when((top >= 80) & (gap >= 8) & stadium, "auto_candidate_high_stadium_coords")
            .when((top >= 75) & (gap >= 8) & (stadium | club), "auto_candidate_medium_coords")
            .when((top >= 70) & (gap >= 8), "candidate_no_coordinates")
        )
    status = status.otherwise("needs_manual_match_review")
    return out.withColumns({
        "score_gap": gap,
        "match_status": status,
        "needs_review": status != "auto_candidate_high_stadium_coords",
        "coordinate_basis": F.when(stadium, "stadium").when(club, "club"),
        "proposed_lat": F.when(stadium, F.col("stadium_lat")).when(club, F.col("club_lat")),
        "proposed_lon": F.when(stadium, F.col("stadium_lon")).when(club, F.col("club_lon")),
    }).drop("_failed", "_ok", "_cands")


def score_geo_candidate(df: DataFrame, place: str, names: Sequence[str], feature: str, population: str, lat: str, lon: str,
                        center_lat: str, center_lon: str, normal: Mapping[str, str] | None = None) -> DataFrame:
    """Place candidate score from name, class, population and distance to a trusted center. ``normal`` {text column: column of its "place" folding} spares the folding."""
    df, (target, *cand), added = _normal_forms(df, (place, *names), lambda c: fold(c, "place"), normal)
    exact = reduce(lambda a, b: a | b, [(c != "") & (c == target) for c in cand])
    partial = reduce(lambda a, b: a | b, [(c != "") & (F.contains(c, target) | F.contains(target, c)) for c in cand])
    weights = F.create_map(*[F.lit(x) for kv in FEATURE_WEIGHTS.items() for x in kv])
    pop = F.coalesce(F.col(population), F.lit(0)).cast("double")
    km = haversine_km(F.col(center_lat), F.col(center_lon), F.col(lat), F.col(lon))
    df = df.withColumn("distance_km", km).withColumn("exact_name", exact).withColumn("partial_name", partial)
    d = F.col("distance_km")
    near = F.when(d <= 15, 45).when(d <= 40, 35).when(d <= 75, 25).when(d <= 150, 10).when(d > 300, -35).otherwise(0)
    score = (
        F.when(F.col("exact_name"), 120.0).when(F.col("partial_name"), 35.0).otherwise(0.0)
        + F.coalesce(F.element_at(weights, F.col(feature)), F.lit(0))
        + F.when(pop > 0, F.least(F.lit(18.0), F.log10(pop + 1) * 3)).otherwise(0.0)
        + near
    )
    return df.withColumn("geo_score", score).drop(*added)


def choose_geo_candidate(scored: DataFrame, key: str, candidate: str, mode: str = "query_mode", exact_mode: str = "name_equals") -> DataFrame:
    """Best place per key by score, distance, population, with a confidence and a note."""
    order = [F.desc("geo_score"), F.asc_nulls_last("distance_km"), F.desc_nulls_last("population"), F.asc(candidate)]
    out = best_and_second(scored, key, order, {"_second": "geo_score"})
    margin = F.when(F.col("_second").isNull(), 999.0).otherwise(F.col("geo_score") - F.col("_second"))
    d = F.col("distance_km")
    confidence = (
        F.when(~F.col("exact_name"), "low").when(d > 200, "low").when(F.col(mode) != exact_mode, "medium")
        .when(margin < 15, "medium").when(d.isNull() | (d <= 75), "high").otherwise("medium")
    )
    note = F.concat_ws(
        "; ", F.concat(F.col(mode), F.lit(" match")), F.concat(F.lit("selected "), F.col(candidate).cast("string")),
        F.when(d.isNotNull(), F.concat(F.format_string("%.1f", F.bround(d, 1)), F.lit(" km from trusted center"))),
        F.when(F.col("_second").isNotNull(), F.concat(F.lit("margin "), F.format_string("%.1f", F.bround(margin, 1)))),
        F.when(F.col("confidence") != "high", "spot-check recommended"),
    )
    return out.withColumn("margin", margin).withColumn("confidence", confidence).withColumn("review_note", note).drop("_second")


def query_cascade(candidates: DataFrame, key: str, strategy: str) -> DataFrame:
    """Only the candidates of the first strategy that returned any, per entity."""
    first = candidates.groupBy(key).agg(F.min(strategy).alias(strategy))
    return candidates.join(first, [key, strategy])


def source_cascade(df: DataFrame, sources: Sequence[tuple[str, str, str]], conflict: tuple[int, int] = (0, 1)) -> DataFrame:
    """Coordinates from the first source that has both; distance between two of them; fallback flag.

    ``sources`` lists (label, lat, lon) in order of preference.
    """
    has = [F.col(la).isNotNull() & F.col(lo).isNotNull() for _, la, lo in sources]
    pick = F.coalesce(*[F.when(h, F.struct(F.lit(n).alias("source"), F.col(la).alias("lat"), F.col(lo).alias("lon"))) for h, (n, la, lo) in zip(has, sources)])
    (_, a1, o1), (_, a2, o2) = sources[conflict[0]], sources[conflict[1]]
    status = F.when(pick.isNull(), "official_source_needed").when(pick["source"] == sources[-1][0], "resolved_fallback").otherwise("resolved")
    return df.withColumns({
        "recommended_source": pick["source"], "recommended_lat": pick["lat"], "recommended_lon": pick["lon"], "resolver_status": status,
        "conflict_distance_km": haversine_km(F.col(a1), F.col(o1), F.col(a2), F.col(o2)), "fallback_needed": pick.isNull(),
    })


HIGH_REVIEW = ("candidate_coords_need_review", "needs_manual_match_review", "no_candidates_found")


def needs_resolution(df: DataFrame, lat: str = "club_lat", lon: str = "club_lon", city: str = "city", followup: Column | None = None) -> DataFrame:
    followup = F.lit(False) if followup is None else followup
    return df.filter(~_present(lat) | ~_present(lon) | ~_present(city) | followup)


def resolution_priority(df: DataFrame, lat: str = "club_lat", lon: str = "club_lon", followup: Column | None = None) -> DataFrame:
    """Why a row waits, and the text to search for."""
    followup = F.lit(False) if followup is None else followup
    why = (
        F.when(~_present(lat) | ~_present(lon), "missing_coordinates").when(F.col("match_status").isin(*HIGH_REVIEW), "high_review")
        .when(followup, "manual_followup").otherwise("spotcheck")
    )
    return df.withColumn("resolution_priority", why)


def search_text(*parts: str) -> Column:
    return F.concat_ws(", ", *[F.when(_present(p), F.trim(F.col(p))) for p in parts])


# What each bucket asks of the reviewer.
TRIAGE_REASONS = {
    "batch_approve_stadium_coords": "exact name of several words, first hit, high score, stadium coordinates at hand",
    "manual_review_gender_team_mismatch": "the candidate seems to be a women's team",
    "manual_review_name_ambiguity": "more than one club may bear this name",
    "retry_search_wrong_entity": "the candidate is no club, or of another sport; search again under other names",
    "coordinate_backfill_needed": "the club fits, its coordinates are missing",
    "manual_review_low_context_candidate": "no coordinates, and nothing says that it is a football club",
    "manual_review_club_vs_place": "the coordinates may be those of a place; check their source",
    "manual_search_alias_retry": "nothing was found; try stripped, folded or suffixed names",
    "hard_manual_match": "low score or several meanings; choose by hand",
}


def identity_review(validated: DataFrame, order: Sequence[str] = ("severity",)) -> DataFrame:
    """The rows that need a look, high and medium, with what to do about them.

    ``validated`` is written once: a filter on the severity would move below the columns it rests on and work each of them out many times, and the order once more.
    ``order`` should go on to a key, because the two severities alone make two tasks.
    """
    action = "Compare with the roster source, club, date of birth and national team."
    return cut_lineage(validated).filter(F.col("severity").isin("high", "medium")).withColumn("suggested_action", F.lit(action)).orderBy(*order)


def identity_summary(validated: DataFrame) -> DataFrame:
    """One row: how many were validated and how many have each severity; zeros for an empty table."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return validated.agg(F.count(F.lit(1)).alias("total"), n("high").alias("high_review_items"), n("medium").alias("medium_review_items"), n("low").alias("low_warnings"), n("ok").alias("ok"))


def spellings(c: Column) -> Column:
    """The normal forms of a pipe list of names, blank ones left out."""
    return F.filter(F.transform(F.split(c, r"\|"), norm_key), lambda x: x != "")


def validate_identity(df: DataFrame, name: str, label: str, aliases: str, description: str, citizenships: str, teams: str, club: str,
                      local_dob: str, other_dob: str, context: Column, domain: Sequence[str], lo: int = 1900, hi: int = 2010, spot: int = 1986,
                      normal: Mapping[str, str] | None = None) -> DataFrame:
    """Points, flags and severity for an already linked identity. ``aliases`` is a pipe list.

    ``normal`` {text column: column of its ``norm_key``} spares the folding; for ``label`` it names the ``spellings`` of label and aliases together.
    """
    normal = dict(normal or {})
    spelled = F.col(normal.pop(label)) if label in normal else spellings(F.concat_ws("|", F.col(label), F.col(aliases)))
    df, (n, about, cit, history, club_norm), added = _normal_forms(df, (name, description, citizenships, teams, club), norm_key, normal)
    sim = F.when(n != "", F.coalesce(F.array_max(F.transform(spelled, lambda x: similarity(n, x))), F.lit(0.0))).otherwise(0.0)
    any_in = lambda hay, words: F.exists(words, lambda w: (w != "") & F.contains(hay, w))
    ok_domain = reduce(lambda x, y: x | y, [F.contains(about, norm_key(F.lit(w))) for w in domain])
    ok_context = any_in(cit, context) | any_in(history, context)
    ok_club = (club_norm != "") & F.contains(history, club_norm)
    a, b = F.col(local_dob), F.col(other_dob)

    df = df.withColumn("name_similarity", sim)
    s = F.col("name_similarity")
    score = (
        F.when(s >= 0.92, 30).when(s >= 0.75, 15).otherwise(0) + F.when(ok_domain, 25).otherwise(0) + F.when(ok_context, 20).otherwise(0)
        + F.when(ok_club, 10).otherwise(0) + F.when(a == b, 15).otherwise(0)
    )
    flags = F.array_compact(F.array(
        F.when(s < 0.75, "name_similarity_low").when(s < 0.92, "name_similarity_medium"),
        F.when(~ok_domain, "domain_not_clear"),
        F.when(~ok_context, "context_not_found"),
        F.when(~ok_club, "club_not_in_history_soft_warning"),
        F.when(a.isNull(), "local_dob_missing").when(b.isNull(), "other_dob_missing").when(a != b, "dob_mismatch"),
        year_plausibility(a, lo, hi, spot),
    ))
    df = df.withColumn("validation_score", score).withColumn("_flags", flags)
    has = lambda *names: F.arrays_overlap("_flags", F.array(*[F.lit(x) for x in names]))
    severity = (
        F.when(has("dob_year_implausible", "dob_mismatch", "domain_not_clear"), "high").when(has("name_similarity_low", "context_not_found"), "medium")
        .when(has("club_not_in_history_soft_warning", f"birth_year_before_{spot}_spot_check"), "low").otherwise("ok")
    )
    return df.withColumn("severity", severity).withColumn("flags", F.array_join("_flags", "|")).drop("_flags", *added)


def date_confirmed_match(rows: DataFrame, candidates: DataFrame, key: str, date: str, candidate: str, candidate_date: str, rank: str) -> DataFrame:
    """The first candidate in rank order whose date equals the row's; otherwise the reason for the miss."""
    c = candidates.withColumnRenamed(candidate_date, "_cd")
    hit = rows.select(key, date).join(c, key).filter(F.col(date) == F.col("_cd")).groupBy(key).agg(F.min_by(candidate, F.struct(rank, candidate)).alias(candidate))
    seen = candidates.select(key).distinct().withColumn("_any", F.lit(True))
    out = rows.join(hit, key, "left").join(seen, key, "left")
    reason = (
        F.when(F.col(candidate).isNotNull(), "matched").when(F.col(date).isNull(), "no date of our own")
        .when(F.col("_any").isNull(), "no candidate").otherwise("no candidate with matching date")
    )
    return out.withColumn("match_reason", reason).drop("_any")


def triage(review: DataFrame, candidates: DataFrame | None, key: str, candidate: str, name: str, label: str, text: Sequence[str]) -> DataFrame:
    """Bucket, reason, priority, search hint and flags of each row under review, with the runner-up and the gap to it.

    ``review`` has match_status, candidate_score, search_rank, player_count. Where it has the runner-up as well, as rows of ``classify_candidates`` do,
    ``candidates`` may be None, and no candidate is scored again.
    """
    if candidates is None:
        review = review.withColumn("_top", F.col("candidate_score"))
    else:
        order = [F.desc("candidate_score"), F.asc("search_rank"), F.asc(candidate)]
        two = best_and_second(candidates.select(key, candidate, "candidate_score", "search_rank"), key, order, {"second_candidate": candidate, "second_score": "candidate_score"})
        two = two.select(key, F.col("candidate_score").alias("_top"), "second_candidate", "second_score")
        review = review.drop("second_candidate", "second_score").join(two, key, "left")
    review = review.withColumns({"_text": F.lower(F.concat_ws(" ", *text)), "_n": strip_org_suffixes(F.col(name), "triage"), "_lab": strip_org_suffixes(F.col(label), "triage")})
    all_text, n, lab = F.col("_text"), F.col("_n"), F.col("_lab")
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(all_text, F.lit(w)) for w in words])
    wrong_sport = has(WRONG_SPORT_HINTS)
    df = review.withColumns({
        "exact_name_match": (n != "") & (n == lab),
        "name_token_count": F.size(tokens(n)),
        "women_entity": F.contains(all_text, F.lit("women")),
        "non_club_entity": wrong_sport | (has(BAD_ENTITY_HINTS) & ~has(FOOTBALL_HINTS)),
        "likely_club": ~wrong_sport & (has(FOOTBALL_HINTS) | F.contains(all_text, F.lit("sports club"))),
        "score_gap_to_second": F.col("_top") - F.col("second_score"),
    }).drop("_top", "_text", "_n", "_lab")
    status, c = F.col("match_status"), F.col
    spot, bare, coords = "candidate_stadium_coords_needs_spotcheck", "candidate_no_coordinates", "candidate_coords_need_review"
    approve = c("exact_name_match") & (c("name_token_count") >= 2) & (c("candidate_score") >= 95) & (c("search_rank") == 1) & ~c("women_entity") & ~c("non_club_entity")
    bucket = (
        F.when((status == spot) & approve, "batch_approve_stadium_coords")
        .when(status.isin(spot, bare) & c("women_entity"), "manual_review_gender_team_mismatch")
        .when(status == spot, "manual_review_name_ambiguity")
        .when(status.isin(bare, coords) & c("non_club_entity"), "retry_search_wrong_entity")
        .when((status == bare) & c("likely_club"), "coordinate_backfill_needed")
        .when(status == bare, "manual_review_low_context_candidate")
        .when(status == coords, "manual_review_club_vs_place")
        .when(status == "no_candidates_found", "manual_search_alias_retry")
        .otherwise("hard_manual_match")
    )
    reasons = F.create_map(*[F.lit(x) for pair in TRIAGE_REASONS.items() for x in pair])
    df = df.withColumn("triage_bucket", bucket).withColumn("triage_reason", F.element_at(reasons, F.col("triage_bucket"))).withColumn("search_hint", manual_search_hint(F.col(name)))
    players = F.coalesce("player_count", F.lit(0))
    priority = F.when((players >= 8) & (c("triage_bucket") != "batch_approve_stadium_coords"), "high").when(players >= 4, "medium").otherwise("low")
    return df.withColumn("review_priority", priority)


def review_queue(checks: Sequence[DataFrame], existing: DataFrame, order_by: Sequence[str], prefix: str = "rev_") -> DataFrame:
    """Standard review rows of several checks, numbered on from the existing queue's largest number."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), checks)
    top = existing.agg(F.coalesce(F.max(F.regexp_extract("review_id", r"(\d+)$", 1).try_cast("long")), F.lit(0)).alias("_top")).scalar()
    numbered = number_rows(rows, [F.col(c) for c in order_by], out="_no")
    digits = (F.col("_no") + top).cast("string")
    review_id = F.concat(F.lit(prefix), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))
    return numbered.withColumn("review_id", review_id).withColumn("status", F.lit("open")).drop("_no")


def attribution_review(df: DataFrame, external_id: str, title: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose image attribution is missing or incomplete, with the missing parts."""
    missing = F.array_join(F.array(*[F.when(~_present(c), c) for c in columns]), ", ")
    issue = (
        F.when(~_present(external_id), "missing_external_id").when(~_present(title), "no_image").when(missing != "", "incomplete_image_metadata")
    )
    out = df.withColumn("issue_type", issue).filter("issue_type is not null")
    return out.withColumn("missing_parts", F.when(F.col("issue_type") == "incomplete_image_metadata", missing))


def work_queue(df: DataFrame, suspicious: Column, trusted: str, points: str, rows: str, stadiums: str, spread: Column) -> DataFrame:
    """Quality flags, review status and rank of places to geocode. Sort by (queue_rank, -rows, …)."""
    status = (
        F.when(suspicious, "needs_text_review").when(F.col(trusted) > 0, "ready_with_local_hints")
        .when(F.col(points) > 0, "ready_with_untrusted_hints").otherwise("ready_no_local_hints")
    )
    flags = F.array_join(F.array(
        F.when(suspicious, "possible_text_encoding_issue"),
        F.when(F.col(rows) > 1, "multiple_rows_same_place"),
        F.when(F.col(stadiums) > 1, "multiple_stadium_contexts"),
        F.when((F.col(points) > 0) & (F.col(trusted) == 0), "only_untrusted_hints"),
        F.when((F.col(trusted) >= 2) & spread, "trusted_hints_have_large_spread"),
    ), "|")
    df = df.withColumn("review_status", status).withColumn("quality_flags", flags)
    s = F.col("review_status")
    return df.withColumn("review_priority", F.when(s.isin("needs_text_review", "ready_with_untrusted_hints"), "high").otherwise("medium")).withColumn(
        "queue_rank", F.when(s == "ready_with_local_hints", 0).when(s == "ready_no_local_hints", 1).when(s == "ready_with_untrusted_hints", 2).otherwise(99)
    )
