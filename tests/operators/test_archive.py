"""Readers and writers of archives, on small folders."""

import json

from pyspark.sql import functions as F

from folioforge.operators.feeds import system_of
from folioforge.operators.pages import fresh_snapshots
from folioforge.sources import archive


def test_texts_keys_and_years(spark, tmp_path):
    for name, year, text in (("abc", 2024, "first"), ("abc", 2025, "second"), ("xyz", 2025, " \n ")):
        folder = tmp_path / name / str(year)
        folder.mkdir(parents=True)
        (folder / "page-1.txt").write_text(text)
    (tmp_path / "abc" / "2025" / "note.md").write_text("left out")
    got = {(r["conf"], r["year"], r["source_key"], r["text"]) for r in archive.read_texts(spark, str(tmp_path)).collect()}
    assert got == {("abc", 2024, "page-1", "first"), ("abc", 2025, "page-1", "second")}
    assert [r["year"] for r in archive.read_texts(spark, str(tmp_path), 2025).collect()] == [2025]
    keys = archive.discover_keys(archive.read_texts(spark, str(tmp_path)))
    assert {(r["conf"], r["year"]) for r in keys.collect()} == {("abc", 2024), ("abc", 2025)} and archive.discover_keys(archive.read_texts(spark, str(tmp_path)), 2024).count() == 1


def test_documents_conferences_and_patterns(spark, tmp_path):
    (tmp_path / "conf.json").write_text(json.dumps([{"short": "ABC", "name": "A", "rank": {"ccf": "A"}}, {"short": "abd", "name": "B", "rank": {"ccf": "B"}}, {"short": "none"}]))
    path = str(tmp_path / "conf.json")
    assert archive.read_conferences(spark, path).count() == 3
    assert [r["name"] for r in archive.read_conferences(spark, path, short="abc").collect()] == ["A"]
    assert [r["short"] for r in archive.read_conferences(spark, path, ccf="B").collect()] == ["abd"]
    assert archive.read_conferences(spark, path, short="nothing").collect() == []
    (tmp_path / "rules.txt").write_text("x")  # by the caller's parser
    parse = lambda raw: [{"field": "f", "patterns": [{"name": "a", "regex": "x+"}, {"name": "b", "regex": "y+"}]}]
    got = [tuple(r) for r in archive.read_patterns(spark, str(tmp_path / "rules.txt"), parse).orderBy("pattern_idx").collect()]
    assert got == [("f", 0, "a", "x+"), ("f", 1, "b", "y+")]


def test_homepages_are_unpivoted(spark):
    rows = spark.createDataFrame([("A", "a.org", " "), ("B", None, "b.org")], "short string, domain2024 string, domain2025 string")
    got = {tuple(r) for r in archive.homepages(rows, [2024, 2025]).collect()}
    assert got == {("A", 2024, "a.org"), ("A", 2025, None), ("B", 2024, None), ("B", 2025, "b.org")}


def test_results_are_overwritten_by_year(spark, tmp_path):
    folder = str(tmp_path / "results")
    frame = lambda *rows: spark.createDataFrame(list(rows), "entity string, year int, value string")
    archive.write_results(frame(("a", 2024, "old"), ("a", 2025, "old"), ("b", 2025, "old")), folder)
    archive.write_results(frame(("a", 2025, "new")), folder)  # a rerun of one year
    assert {(r["entity"], r["year"], r["value"]) for r in archive.read_results(spark, folder).collect()} == {("a", 2024, "old"), ("a", 2025, "new")}
    assert archive.read_results(spark, folder, 2024).count() == 1


def test_json_reports_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("f", 1), ("g", 2)], "field string, n int")
    archive.write_json(rows, str(tmp_path / "json"))
    assert {(r["field"], r["n"]) for r in spark.read.json(str(tmp_path / "json")).collect()} == {("f", 1), ("g", 2)}
    pages = lambda at, text: spark.createDataFrame([("u", at, text)], "url string, at string, text string").withColumn("at", F.col("at").cast("timestamp"))
    folder = str(tmp_path / "snapshots")
    archive.append_snapshots(pages("2025-01-01 00:00:00", "old"), folder)
    archive.append_snapshots(pages("2025-01-02 00:00:00", "new"), folder)
    stored, as_of = spark.read.parquet(folder), lambda x: F.lit(x).cast("timestamp")
    assert [r["text"] for r in fresh_snapshots(stored, "url", "at", "text", as_of("2025-01-02 12:00:00")).collect()] == ["new"]
    assert fresh_snapshots(stored, "url", "at", "text", as_of("2025-01-04 00:00:00")).collect() == []


def test_system_of_a_timeline(spark):
    rows = spark.createDataFrame([([("x", "via EasyChair and CMT"), ("y", "OpenReview")],), ([("x", "")],)], "timeline array<struct<deadline: string, comment: string>>")
    assert [r[0] for r in rows.select(system_of(F.col("timeline"))).collect()] == ["EasyChair", None]


def test_reports_are_one_json_array(spark, tmp_path):
    """Files in their order make up one array, whatever the number of tasks; an empty table makes an empty one."""
    rows = spark.range(500).repartition(7).selectExpr("id as k", "concat('\"q\" ', id) as text", "if(id % 3 = 0, null, id) as n")
    for df, want in ((rows, [{"k": k, "text": f'"q" {k}', "n": None if k % 3 == 0 else k} for k in range(500)]), (rows.where("k < 0"), [])):
        folder = tmp_path / f"array{len(want)}"
        archive.write_json_array(df, ["k"], str(folder))
        whole = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
        assert json.loads(whole) == want


def test_capped_conflicts_of_a_run(spark):
    from folioforge.operators.reports import conflict_list, run_report

    rows = [("a", f"f{k}", "v", "feed" if k % 2 else "regex", k < 4, f"x={k}") for k in range(6)] + [("b", "f0", "unknown", None, False, "")]
    merged = spark.createDataFrame(rows, "entity string, field string, value string, source string, conflict boolean, candidates string")
    assert [tuple(r) for r in conflict_list(merged, ["entity"], 2).collect()] == [("a", 4, "f0: x=0 | f1: x=1")]
    assert conflict_list(merged, ["entity"]).first()["conflicts"].count("|") == 3
    got = {r["entity"]: r.asDict() for r in run_report(merged, ["entity"]).collect()}
    assert got["a"]["sources"] == {"feed": 3, "regex": 3} and got["a"]["conflict_count"] == 4 and got["a"]["percentage"] == 100.0
    assert got["b"]["sources"] is None and got["b"]["conflicts"] == "" and got["b"]["known"] == 0
