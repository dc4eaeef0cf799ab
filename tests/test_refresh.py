"""The whole refresh over small files, and the resumable stream."""

import pytest
from pyspark.sql import functions as F

from rosterlab.refresh import refresh
from rosterlab.streaming.incremental import log_snapshots, resolve_pending


def write(folder, callup_club="c1"):
    files = {
        "players": "player_id,wikidata_id,display_name,birth_lat,birth_lon,height_cm,manual_review_flag\np1,Q1,Ann,1.5,2.5,180.0,TRUE\np2,,Bo,,,tall,false\n",
        "squad_entries": "squad_entry_id,team,team_code,player_id,squad_status,shirt_number,caps_pre_tournament,goals_pre_tournament,is_captain,is_replacement\ns1,Alpha,ALP,p1,active,7,3,1,,FALSE\ns2,Alpha,ALP,p2,removed,,,,,\n",
        "clubs": "club_id,club_name,league,country,city,city_lat,city_lon,manual_review_flag\nc1,One,L,Alpha,Town,1.0,2.0,\nc2,Two,L,Alpha,Town,,,\n",
        "player_club_at_callup": f"player_club_callup_id,player_id,club_id,team\nl1,p1,{callup_club},Alpha\n",
        "club_alias_map": "raw_club_id,raw_club_name,canonical_club_id,canonical_club_name\nr1,Uno FC,c1,One\nr2,one,c1,One\nr3,Gone,zz,Gone FC\n",
    }
    for name, body in files.items():
        (folder / f"{name}.csv").write_text(body)


def test_refresh(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    write(src)
    counts = {r.entity: r["rows"] for r in refresh(spark, str(src), str(out), "2026-07-14").collect()}
    assert counts == {"players": 2, "squad_entries": 2, "clubs": 2, "player_club_at_callup": 1, "cities": 1, "city_members": 1, "teams": 1, "team_members": 1, "club_aliases": 1, "rejects": 1}
    team = spark.read.json(str(out / "teams")).collect()[0]
    assert (team.squad_size, team.replacement_count) == (1, 0)
    assert spark.read.json(str(out / "rejects")).collect()[0].raw == "tall"


def test_counts_come_from_the_writes(spark, tmp_path):
    from rosterlab.sources.writers import export_manifest, write_counted

    times = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            times.add(batch.num_rows)
            yield batch

    tables = {"some": spark.range(1000).mapInArrow(read, "id long"), "none": spark.range(10).filter("id > 99"), "empty": spark.createDataFrame([], "a int"), "other": spark.range(7)}
    manifest = write_counted(tables, str(tmp_path / "out"), "2026-07-14", "here", "parquet")
    assert times.value == 1000  # read once, for the write
    got = {r.entity: r["rows"] for r in manifest.collect()}
    assert got == {"some": 1000, "none": 0, "empty": 0, "other": 7} and times.value == 1000
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, export_manifest(tables, "2026-07-14", "here").collect()))


def test_refresh_carries_the_other_tables(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    write(src)
    (src / "matches.csv").write_text("match_id,stage,home_score,away_score\nm1,Final,1,0\nm2,Final,x,\n")
    (src / "coaches.csv").write_text("coach_id,coach_name\nk1,Ann\n")
    counts = {r.entity: r["rows"] for r in refresh(spark, str(src), str(out), "2026-07-14").collect()}
    assert (counts["matches"], counts["coaches"], counts["rejects"]) == (2, 1, 2) and "referees" not in counts
    assert sorted(str(r.home_score) for r in spark.read.json(str(out / "matches")).collect()) == ["1", "None"]


def test_refresh_stops_on_a_broken_key(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, callup_club="missing")
    with pytest.raises(ValueError, match="link_clubs_exist"):
        refresh(spark, str(src), str(tmp_path / "out"), "2026-07-14")
    assert not (tmp_path / "out").exists()


def test_resumable_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    run = lambda: resolve_pending(spark.readStream.schema("id long, v string").parquet(src), lambda d: d.withColumn("n", F.length("v")), "id", ["v"], out, cp).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "bb"), (1, "z")], "id long, v string").write.parquet(src)
    run()
    spark.createDataFrame([(2, "changed"), (3, "ccc")], "id long, v string").write.mode("append").parquet(src)
    run()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, "a", 1), (2, "bb", 2), (3, "ccc", 3)}


def test_resolver_sees_only_what_is_pending(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    seen = []

    def resolver(d):
        seen.append(sorted(r.id for r in d.collect()))
        return d

    for rows in ([(1, "a")], [(1, "b"), (2, "c")]):
        spark.createDataFrame(rows, "id long, v string").write.mode("append").parquet(src)
        resolve_pending(spark.readStream.schema("id long, v string").parquet(src), resolver, "id", ["v"], out, cp).awaitTermination()
    assert seen == [[1], [2]]


def test_a_day_in_several_files_a_late_file_and_a_replay(spark, tmp_path):
    src, state, log, cp = (str(tmp_path / n) for n in ("src", "state", "log", "cp"))
    schema = "id long, v string, day string"

    def go(checkpoint, *files):
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        log_snapshots(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "day", ["id"], ["v"], state, log, checkpoint).awaitTermination()
        return {(r.day, r.id, r.change_type, r.old_value, r.new_value) for r in spark.read.parquet(log).collect()}

    first = {("d1", i, "added", None, None) for i in (1, 2, 3, 4)}
    assert go(cp, [(1, "a", "d1"), (2, "b", "d1")], [(3, "c", "d1"), (4, "d", "d1")]) == first
    second = go(cp, [(1, "a", "d2"), (2, "x", "d2")])
    assert {r[1:] for r in second if r[0] == "d2"} == {(2, "changed", "b", "x"), (3, "removed", None, None), (4, "removed", None, None)}
    late = first | {("d2", 2, "changed", "b", "x"), ("d2", 4, "removed", None, None)}
    assert go(cp, [(3, "c", "d2")]) == late
    assert go(cp + "again") == late  # every file once more, from the first batch on


def test_snapshot_stream(spark, tmp_path):
    src, state, log, cp = (str(tmp_path / n) for n in ("src", "state", "log", "cp"))
    schema = "id long, v string, day string"
    spark.createDataFrame([(1, "a", "d1"), (2, "b", "d1")], schema).coalesce(1).write.parquet(src)
    go = lambda: log_snapshots(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "day", ["id"], ["v"], state, log, cp).awaitTermination()
    go()
    spark.createDataFrame([(2, "c", "d2"), (3, "d", "d2")], schema).coalesce(1).write.mode("append").parquet(src)
    go()
    got = {(r.id, r.change_type, r.old_value, r.new_value) for r in spark.read.parquet(log).filter("day = 'd2'").collect()}
    assert got == {(1, "removed", None, None), (2, "changed", "b", "c"), (3, "added", None, None)}
