"""Feed files: good documents typed, bad ones kept with their reasons."""

import json

from folioforge.operators.requirements import distributions
from folioforge.sources import feeds

DOCUMENTS = {
    "a/2025.json": json.dumps({"conference": "ABC", "year": 2025, "rank": {"ccf": "A", "other": 1}, "timeline": [{"deadline": "2025-01-02", "comment": "first"}, {"abstract_deadline": "2025-05-01", "deadline": "2025-05-08"}], "more": [1]}, indent=2),
    "a/2024.json": '{"conference": "ABC", "year": 2024, "timeline": []}', "b/old.json": '{"conference": "abc ", "year": 2024, "place": "Rome"}', "b/x.json": '{"conference": "B", "year": "soon"}', "b/y.json": '{"conference": "B", "year": 2025, "timeline": "later"}',
    "c/1.json": "not json", "c/2.json": "[1]", "c/3.json": "  ", "c/4.json": '{"year": 2025}', "c/5.json": '{"conference": "C"}', "c/6.json": '{"conference": " ", "year": 2025}',
}


def test_documents_are_typed_or_kept_aside(spark, tmp_path):
    for name, text in DOCUMENTS.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    documents = feeds.read_feed(spark, str(tmp_path))
    good = feeds.accepted(documents, feeds.FIRST)
    assert {(r["conference"], r["year"], r["place"]) for r in good.collect()} == {("ABC", 2025, None), ("ABC", 2024, None), ("abc ", 2024, "Rome")}
    assert [(r["conference"], r["rank"]["ccf"]) for r in good.where("rank is not null").collect()] == [("ABC", "A")]
    bad = {r["file"].rsplit("/", 2)[1] + "/" + r["file"].rsplit("/", 1)[1]: r["reason"] for r in feeds.rejected(documents, feeds.FIRST).collect()}
    assert bad == {"b/x.json": "wrong type", "b/y.json": "wrong type", "c/1.json": "no JSON", "c/2.json": "no object", "c/3.json": "empty", "c/4.json": "no conference", "c/5.json": "no year", "c/6.json": "no conference"}
    assert len(bad) + good.count() == len(DOCUMENTS)
    one = {(r["year"], r["place"]) for r in feeds.newest(good, "file").collect()}
    assert one == {(2025, None), (2024, "Rome")}
    got = [tuple(r) for r in feeds.rounds(good).orderBy("round").collect()]
    assert got == [("ABC", 2025, 1, None, "2025-01-02", "first"), ("ABC", 2025, 2, "2025-05-01", "2025-05-08", None)]


def test_second_feed_is_flat(spark):
    documents = spark.createDataFrame([('{"conference": "X", "year": 2025, "dates": "May 1", "location": "Rome", "event_url": "http://x"}', 1), ('{"conference": "X", "year": 2025, "dates": {"a": 1}}', 2), (None, 3)], "document string, k int")
    rows = feeds.accepted(documents, feeds.SECOND).collect()
    assert [(r["k"], r["conference"], r["dates"], r["notification"]) for r in rows if r["k"] == 1] == [(1, "X", "May 1", None)]
    assert {(r["k"], r["reason"]) for r in feeds.rejected(documents, feeds.SECOND).collect()} >= {(3, "empty")}


def test_distributions_count_texts_once(spark):
    rows = [(1, "e", "f", "yes", "high"), (1, "e", "g", "yes", "high"), (2, "e", "f", "unknown", "low"), (2, "e", "g", "no", "high"), (3, "o", "h", "not_mentioned", "low")]
    got = {(r["extractor"], r["level"], r["field"], r["value"], r["confidence"]): (r["n"], r["known"], r["texts"]) for r in distributions(spark.createDataFrame(rows, "k int, extractor string, field string, value string, confidence string"), ["k"]).collect()}
    assert got == {
        ("e", "value", "f", "yes", None): (1, 1, 1), ("e", "value", "f", "unknown", None): (1, 0, 0), ("e", "value", "g", "yes", None): (1, 1, 1), ("e", "value", "g", "no", None): (1, 1, 1), ("e", "field", "f", None, None): (2, 1, 1), ("e", "field", "g", None, None): (2, 2, 2),
        ("e", "confidence", None, None, "high"): (3, 3, 2), ("e", "confidence", None, None, "low"): (1, 0, 0), ("e", "extractor", None, None, None): (4, 3, 2),
        ("o", "value", "h", "not_mentioned", None): (1, 0, 0), ("o", "field", "h", None, None): (1, 0, 0), ("o", "confidence", None, None, "low"): (1, 0, 0), ("o", "extractor", None, None, None): (1, 0, 0),
    }
