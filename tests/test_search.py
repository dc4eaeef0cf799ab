"""Layered search: exact layers come first, typos fall through to the fuzzy layer."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlab.functions.text import fold, fold_text
from rosterlab.operators.facets import gram_table, layered_search
from rosterlab.session import cut_lineage


@pytest.fixture(scope="module")
def tables(spark):
    clubs = spark.createDataFrame([("c1", "Manchester City"), ("c2", "Real Madrid"), ("c3", "AS Monaco")], "club_id string, club_name string")
    aliases = spark.createDataFrame([("Monegasque FC", "c3"), ("Monegasques", "c3")], "alias string, club_id string")
    people = spark.createDataFrame([("p1", "José Real"), ("p2", "Ann Other")], "player_id string, display_name string")
    return clubs, aliases, people


@pytest.mark.parametrize("query,want", [
    ("Manchestr", [("club", "c1", 4)]), ("Mánchéstr", [("club", "c1", 4)]), ("Reel Madrd", [("club", "c2", 4)]), ("monegas", [("club", "c3", 2)]),
    ("real", [("club", "c2", 1), ("player", "p1", 3)]), ("jose", [("player", "p1", 3)]), ("x", []),
])
def test_layers(tables, query, want):
    assert [(r.type, r.id, r.layer) for r in layered_search(query, *tables).collect()] == want
    grams = gram_table(tables[0], "club_id", "club_name"), gram_table(tables[2], "player_id", "display_name")
    assert [(r.type, r.id, r.layer) for r in layered_search(query, *tables, grams=grams).collect()] == want


def test_grams_lose_no_near_label(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 14)))
    labels = [(f"c{i}", word()) for i in range(400)]
    clubs = spark.createDataFrame(labels, "club_id string, club_name string")
    none = spark.createDataFrame([], "alias string, club_id string"), spark.createDataFrame([], "player_id string, display_name string")
    grams = cut_lineage(gram_table(clubs, "club_id", "club_name")), gram_table(none[1], "player_id", "display_name")
    found = 0
    for query in ("abcdab", "dcb abd", "eeab"):
        scan, index = (layered_search(query, clubs, *none, k=50, grams=g).collect() for g in (None, grams))
        assert scan == index
        found += len(scan)
        folded = fold_text(query)
        assert folded == clubs.limit(1).select(fold(F.lit(query), "spaced_lower")).first()[0]
    assert found > 20


def test_the_fuzzy_layer_reads_no_labels(spark, tables, tmp_path):
    clubs, aliases, people = tables
    for name, df in (("clubs", clubs), ("people", people), ("cg", gram_table(clubs, "club_id", "club_name")), ("pg", gram_table(people, "player_id", "display_name"))):
        df.write.parquet(str(tmp_path / name))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    scan = layered_search("Reel Madrd", read("clubs"), aliases, read("people"))
    index = layered_search("Reel Madrd", read("clubs"), aliases, read("people"), grams=(read("cg"), read("pg")))
    fuzzy = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("levenshtein")
    assert fuzzy(index) and index.collect() == scan.collect()
    assert "PushedFilters: [In(gram" in index._jdf.queryExecution().explainString(index.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_repeated_row_adds_no_grams(spark):
    clubs = spark.createDataFrame([("c1", "aaab"), ("c1", "aaab"), ("c2", "a")], "club_id string, club_name string")
    assert sorted(tuple(r) for r in gram_table(clubs, "club_id", "club_name").collect()) == [("aa", "c1", "aaab", 2), ("ab", "c1", "aaab", 1)]
