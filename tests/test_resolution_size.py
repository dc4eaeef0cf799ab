"""What a candidate pair costs: texts are folded before pairs are made, rows are spread by the size of the tables, nothing is worked out twice."""

from pyspark.sql import functions as F

from rosterlab import skew
from rosterlab.functions.text import fold, norm_key
from rosterlab.operators import resolve
from rosterlab.plans import resolution
from rosterlab.sources.adapters import Tables

FOLDER = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_spread_by_the_size_of_the_tables(spark, monkeypatch):
    few = resolution.cands(Tables(spark, FOLDER)).rdd.getNumPartitions()
    monkeypatch.setattr(skew, "PART_BYTES", 20_000)
    assert resolution.cands(Tables(spark, FOLDER)).rdd.getNumPartitions() > 4 * few


def test_names_are_folded_below_the_pair_joins(spark):
    t = Tables(spark, FOLDER)
    for df in (resolution.scored(t), resolution.club_scored(t), resolution.club_scored(t, 1), resolution.geo_scored(t), resolution.validated(t)):
        above = optimized(df).split("Join ")[0]
        assert "regexp_replace" not in above


def test_given_normal_forms_change_no_score(spark):
    rows = [(1, "José Ñandú", "jose nandu", "Ænima FC", "x"), (2, "", None, "ﬁ  B&C", "y"), (3, "Deportivo A.C.", "deportivo a.c.", "Deportivo", "z")]
    df = spark.createDataFrame(rows, "k int, name string, label string, other string, t string")
    person = ["name", "label", "other", "t", "t", "t", "t", "t", F.array(F.lit("x")), "t", F.array(F.lit("y")), "t", "t", "t"]
    forms = {c: f"{c}_n" for c in ("name", "label", "other", "t")}
    held = df.withColumns({n: norm_key(F.col(c)) for c, n in forms.items()})
    assert resolve.score_person(held, *person, forms).select("k", "match_score").sort("k").collect() == resolve.score_person(df, *person).select("k", "match_score").sort("k").collect()
    for version in (1, 2):
        club = ["name", "label", "other", "t", "t", "t", "t", "t", "t", "t", "t", "t", "k", version]
        held = df.withColumns({n: resolve.score_form(F.col(c), version) for c, n in forms.items()})
        got = resolve.score_name_similarity(held, *club, normal=forms).select("k", "candidate_score").sort("k").collect()
        assert got == resolve.score_name_similarity(df, *club).select("k", "candidate_score").sort("k").collect()
    geo = ["name", ["label", "other"], "t", "k", "k", "k", "k", "k"]
    held = df.withColumns({n: fold(F.col(c), "place") for c, n in forms.items()})
    assert resolve.score_geo_candidate(held, *geo, forms).select("k", "geo_score").sort("k").collect() == resolve.score_geo_candidate(df, *geo).select("k", "geo_score").sort("k").collect()


def test_triage_takes_the_runner_up_from_the_classification(spark):
    t = Tables(spark, FOLDER)
    review = resolution.classified(t).filter("needs_review").withColumn("player_count", F.lit(5))
    args = ["entity", "candidate", "name", "wlabel", ["wlabel", "descr", "slabel", "inst"]]
    cols = ["entity", "triage_bucket", "second_candidate", "second_score", "score_gap_to_second"]
    again = resolve.triage(review, resolution.club_scored(t), *args).select(*cols).sort("entity").collect()
    assert resolve.triage(review, None, *args).select(*cols).sort("entity").collect() == again
    assert any(r.second_candidate is not None for r in again)


def test_identity_review_works_nothing_out_twice(spark):
    out = resolve.identity_review(resolution.validated(Tables(spark, FOLDER)), ["severity", "entity", "candidate"])
    assert "levenshtein" not in optimized(out)
    assert set(r.severity for r in out.select("severity").distinct().collect()) <= {"high", "medium"}
