"""Model answers by the types of their fields, and what is refused."""

from folioforge.operators.merge import answer_quality, answer_rejects, typed_answers

FIELDS = [("blind", "boolean"), ("formats", "list"), ("limit", "string"), ("policy", "enum")]
RESPONSES = [
    (1, 1, '{"blind": true, "formats": ["oral", "demo"], "limit": 8, "policy": "allowed"}'),
    (2, 1, '{"blind": "No ", "formats": [], "limit": null, "policy": " UNKNOWN"}'),
    (3, 1, '{"blind": {"value": "yes", "evidence": "**so** | it"}, "formats": {"value": ["a"], "note": 1}, "limit": {"pages": 8}, "policy": {"value": null}}'),
    (4, 1, '{"blind": "perhaps", "other": 3, "limit": "", "formats": [["x"], 1], "policy": 1.5}'),
    (5, 1, "not json"), (6, 1, '["blind"]'), (7, 1, None), (8, 1, "{}"), (9, 1, '"text"'), (10, 1, '{"blind": 0, "formats": "null"}'),
]


def frames(spark):
    return spark.createDataFrame(RESPONSES, "k int, batch int, response string"), spark.createDataFrame(FIELDS, "field string, type string")


def test_answers_are_coerced_by_type(spark):
    responses, fields = frames(spark)
    got = {(r["k"], r["field"]): (r["value"], r["evidence"]) for r in typed_answers(responses, ["k"], fields).collect()}
    assert got == {
        (1, "blind"): ("true", ""), (1, "formats"): ("oral; demo", ""), (1, "limit"): ("8", ""), (1, "policy"): ("allowed", ""), (2, "blind"): ("false", ""), (2, "formats"): ("", ""),
        (3, "blind"): ("true", "so, it"), (3, "formats"): ("a", ""), (3, "limit"): ('{"pages":8}', ""), (4, "formats"): ('[["x"],1]', ""), (4, "policy"): ("1.5", ""), (10, "blind"): ("false", ""),
    }


def test_rejects_are_kept_with_their_reasons(spark):
    responses, fields = frames(spark)
    got = {(r["k"], r["field"], r["raw"], r["reason"]) for r in answer_rejects(responses, ["k"], fields).collect()}
    assert got == {(4, "blind", '"perhaps"', "no boolean"), (4, "other", "3", "unknown field"), (5, None, "not json", "no JSON"), (6, None, '["blind"]', "no object"), (7, None, None, "no answer"), (9, None, '"text"', "no object")}


def test_quality_of_merged_answers(spark):
    _, fields = frames(spark)
    merged = spark.createDataFrame([(1, "blind", "true", "llm", False), (1, "limit", "8", "llm_batch2", True), (1, "other", "x", "llm", True), (2, "policy", "unknown", "llm", False)], "k int, field string, value string, source string, conflict boolean")
    assert {tuple(r) for r in answer_quality(merged, ["k"], fields).collect()} == {(1, 2, 4, 50.0, 1, 2), (2, 0, 4, 0.0, 0, 1)}
