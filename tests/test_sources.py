"""Files on disk: encodings, blank rows, optional sources, snapshots, line order."""

import json

import pytest
from pyspark.sql import functions as F

from rosterlab.operators import composition, diff, quality
from rosterlab.sources import parsers, readers, writers
from rosterlab.functions import text


def test_read_table_bom_and_rejects(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("﻿id, height_cm ,name\n1,180.0,Zoë\n2,tall,\"a, b\"\n".encode())
    df = readers.read_table(spark, str(p))
    assert df.columns == ["id", "height_cm", "name"]
    rows, bad = readers.typed(df, {"id": "int", "height_cm": "int"}, ["id"])
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, 180, "Zoë"), (2, None, "a, b")]
    assert [tuple(r) for r in bad.collect()] == [("2", "height_cm", "tall")]


def test_any_encoding(spark, tmp_path):
    d = tmp_path / "enc"
    d.mkdir()
    (d / "a.csv").write_bytes("id,name\n1,Zoë\n".encode("utf-8"))
    (d / "b.csv").write_bytes("id,name\n2,Zoë\n3,Ana\n".encode("latin-1"))
    got = {r.id: (r.name, r.source_encoding) for r in readers.read_text_csv_any(spark, str(d), ["id", "name"]).collect()}
    assert got == {"1": ("Zoë", "utf-8"), "2": ("Zoë", "ISO-8859-1"), "3": ("Ana", "ISO-8859-1")}


def test_headers_in_any_order_and_cells_with_line_breaks(spark, tmp_path):
    d = tmp_path / "some where"
    d.mkdir()
    (d / "a.csv").write_bytes("id,name\n1,Zoë\n".encode())
    (d / "b.csv").write_bytes('name,id,more\n"Zoë\nLi, ""x""",2,m\n'.encode("latin-1"))
    got = {r.id: (r.name, r.source_encoding) for r in readers.read_text_csv_any(spark, str(d), ["id", "name"], multi_line=True).collect()}
    assert got == {"1": ("Zoë", "utf-8"), "2": ('Zoë\nLi, "x"', "ISO-8859-1")}


def test_a_thousand_headers_are_one_plan(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    want = set()
    for i in range(300):
        names = ["id", "name", f"x{i}"]
        names = names[i % 3:] + names[: i % 3]
        cells = {"id": str(i), "name": "Zoë, ""\"q\"" if i % 2 else "", f"x{i}": " s "}
        body = ",".join('"' + cells[n].replace('"', '""') + '"' if n != "id" else cells[n] for n in names)
        (d / f"{i}.csv").write_bytes((",".join(names) + "\r\n" + body + "\r\n\r\n").encode("latin-1" if i % 5 == 0 else "utf-8"))
        want.add((str(i), cells["name"], cells["x7"] if i == 7 else None, "ISO-8859-1" if i % 5 == 0 and i % 2 else "utf-8"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    out = readers.read_text_csv_any(spark, str(d), ["id", "name", "x7"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) <= before + 1  # at most the listing of many paths
    assert {tuple(r)[:4] for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # headers and lines, however many files


def test_json_array_and_optional(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"id": 1, "n": "x"}, {"id": 2, "n": None}]))
    assert readers.read_json_table(spark, str(p), "id int, n string").count() == 2
    out = readers.read_optional(spark, [str(tmp_path / "none.csv"), str(p)], "id string, n string", fmt="json")
    assert out.count() == 2
    assert readers.read_optional(spark, [str(tmp_path / "none.csv")], "id string").count() == 0


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', ["b", "a"]), (2, None, [])], "id int, t string, l array<string>")
    writers.write_snapshot(df, str(tmp_path / "s"), "csv", ["t", "id", "l"])
    back = readers.read_table(spark, str(tmp_path / "s"))
    assert back.columns == ["t", "id", "l"]
    assert {tuple(r) for r in back.collect()} == {('say "hi", ok', "1", "b|a"), (None, "2", None)}


def test_read_lines_keeps_file_order(spark, tmp_path):
    for n in ("x", "y"):
        (tmp_path / f"{n}.txt").write_text("".join(f"{n}{i}\n" for i in range(500)))
    rows = readers.read_lines(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [r.value for r in rows] == [f"x{i}" for i in range(500)] + [f"y{i}" for i in range(500)]


def test_sectioned_text_over_blocks(spark):
    lines = ["noise", "# Asian Body (AFC)", "## Source: http://a", "Japan, Iran, Japan.", "", "# NoCode", "Peru, Chile"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, pos long, value string")
    for parts in (4, 1):
        got = [(r.code, r.name, r.source_url, r.member) for r in parsers.parse_sectioned_text(df, parts=parts).orderBy("member_pos", "item_pos").collect()]
        assert got == [("AFC", "Asian Body", "http://a", "Japan"), ("AFC", "Asian Body", "http://a", "Iran"), ("NoCode", "NoCode", None, "Peru"), ("NoCode", "NoCode", None, "Chile")]


def test_fixture_lines(spark):
    lines = ["Thursday 11 June 2026", "Mexico|2|1|Ghana|First Stage|A|Azteca|Mexico City", "broken|line", "Friday 3 July 2026",
             "Spain|1 (4)|1 (3)|Italy|Round of 32|-|Arena|Dallas", "W1|-|-|W2|Final|-|Met|New York"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, pos long, value string")
    got = [(r.match_date, r.home_team, r.home_score, r.home_pens, r.away_pens, r.status) for r in parsers.parse_carried_date_lines(df, parts=3).orderBy("pos").collect()]
    assert got == [("Thursday 11 June 2026", "Mexico", 2, None, None, "played"), ("Friday 3 July 2026", "Spain", 1, 4, 3, "played"), ("Friday 3 July 2026", "W1", None, None, None, "scheduled")]


def test_text_edges(spark):
    df = spark.createDataFrame([("ŁÓDŹ  Straße & Ærø",)], "s string")
    c = F.col("s")
    got = df.select(text.fold(c, "words_spelled"), text.fold(c, "letters_spelled"), text.fold(c, "marks"), text.token_key(c)).collect()[0]
    assert got[0] == "lodz strasse and aero" and got[2] == "ŁODZ  Straße & Ærø" and got[3] == "aero lodz strasse"
    bad = spark.createDataFrame([("MÃ¼ller",), ("plain",), ("Bogot√°",), ("日本",)], "s string")
    assert [r[0] for r in bad.select(text.repair_mojibake(F.col("s"))).collect()] == ["Müller", "plain", "Bogotá", "日本"]


def test_dates_written_three_ways(spark):
    from rosterlab.functions.num import parse_dob

    df = spark.createDataFrame([("(1999-05-04) 4 May 1999",), ("4 May 1999",), ("May 4, 1999 (aged 27)",), ("unknown",)], "s string")
    assert [str(r[0]) for r in df.select(parse_dob(F.col("s"))).collect()] == ["1999-05-04"] * 3 + ["None"]


def test_diff_with_itself_is_empty(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3)], "id int, x string, y int")
    assert diff.field_diff(df, df, ["id"], ["x", "y"]).count() == 0 == diff.snapshot_diff(df, df, ["id"], ["x", "y"]).count()


def test_strict_audit_raises(spark):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    checks = {"ids_unique": quality.unique_key(df, ["id"])}
    assert quality.audit(checks).collect()[0].status == "FAIL"
    with pytest.raises(ValueError, match="ids_unique"):
        quality.audit(checks, strict=True)


def test_choose_source(spark):
    a, b = spark.createDataFrame([(1, None)], "id int, lat double"), spark.createDataFrame([(1, 2.0)], "id int, lat double")
    assert readers.choose_source(a, b, ["lat"], ["lat"])[1] == "overlay" and readers.choose_source(b, a, ["lat"], ["lat"])[1] == "primary"


def test_compare_two(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 2.0)], "k string, x double, y double")
    got = {r.metric: (r.value_a, r.value_b, r.difference, r.bar_max) for r in composition.compare_two(df, "k", "a", "b", ["x", "y"]).collect()}
    assert got == {"x": (1.0, 3.0, -2.0, 3.0), "y": (None, 2.0, None, 2.0)}


def test_only_generated_headers_are_dropped(spark):
    df = spark.createDataFrame([("1", "x", "y", "z")], "id string, _city string, _c9 string, _corrupt_record string")
    assert readers.trim_blank_rows_cols(df).columns == ["id", "_city", "_corrupt_record"]


def test_change_ids_past_nine_digits_stay_apart(spark):
    from rosterlab.operators.diff import append_change_log

    log = spark.createDataFrame([("chg_999999999", "x")], "change_id string, v string")
    got = [r.change_id for r in append_change_log(log, spark.createDataFrame([(f"n{i:02}",) for i in range(12)], "v string"), ["v"]).collect()]
    assert len(set(got)) == 13 and "chg_1000000011" in got


def test_long_headings_stay_whole(spark):
    from rosterlab.sources.parsers import parse_sectioned_text

    name = "n" * (1 << 20) + "end"
    rows = [("f", 1, f"# {name} (C)"), ("f", 2, "## Source: http://" + name), ("f", 3, "a, b")]
    got = parse_sectioned_text(spark.createDataFrame(rows, "file string, pos long, value string")).collect()
    assert {r.name for r in got} == {name} and {r.source_url for r in got} == {"http://" + name}


def test_folding_of_every_character(spark):
    """Equal to the standard library's compatible decomposition without combining marks, on every character up to U+FFFF."""
    import unicodedata

    every = [chr(cp) for cp in range(1, 0x10000) if not 0xD800 <= cp < 0xE000]
    words = ["ﬁnale", "Łódź ½ kg", "한국어", "Ǆungla ﷺ", "été", "㌀ x"]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*every, *words])], "i int, s string").repartition(8)
    bad = [(r.s, r.f) for r in df.select("s", text.strip_marks(F.col("s")).alias("f")).collect() if r.f != plain(r.s)]
    assert not bad, bad[:10]


def test_range_parts_follow_the_tables_read(spark):
    from rosterlab.plans.tables import sectioned_lines
    from rosterlab.skew import range_parts
    from rosterlab.sources.adapters import Tables

    # the plan's estimate multiplies the sizes of the joined tables: it asked for hundreds of ranges for 15,000 lines
    assert range_parts(sectioned_lines(Tables(spark, "/root/testdata/sf0.1"))) == int(spark.conf.get("spark.sql.shuffle.partitions"))
