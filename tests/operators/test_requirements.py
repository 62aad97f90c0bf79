"""Requirements of small texts, with the signs around their matches."""

from folioforge.operators.classify import presentation_formats
from folioforge.operators.requirements import exclusions_text, requirement_rows, requirements

TEXTS = [
    (0, "Template is available. Authors must use the LaTeX template for all papers. Supplementary materials are allowed (up to 50 MB). Oral presentations, later poster presentations."),
    (1, "Nothing of note."),
    (2, "No supplementary material. Papers presented as demo; virtual presentations. Travel grants are available. A hybrid conference with co-located workshops."),
    (3, "Must include an ethics statement. Broader impact statement is required. Call for demos. Poster session. Position papers. Best paper award."),
    (4, "A paper checklist."),
    (5, None),
]


def around(k, match, before, after):
    text = dict(TEXTS)[k]
    at = text.index(match)
    return text[max(0, at - before) : at + len(match) + after].strip()


def test_rows_of_requirements(spark):
    texts = spark.createDataFrame(TEXTS, "k int, text string")
    excluded = spark.createDataFrame([(0, "appendices", "2 pages"), (0, "references", "unlimited"), (4, "references", "unlimited")], "k int, kind string, pages string")
    found = requirements(texts, ["k"])
    got = {(r["k"], r["field"]): (r["value"], r["evidence"]) for r in requirement_rows(found, ["k"], excluded).collect()}
    assert got[0, "template_required"] == ("true", "must use the LaTeX template")  # required before optional, whatever comes first
    shown = [around(0, "must use the LaTeX template", 30, 30), around(0, "Supplementary materials are allowed", 30, 100)]
    assert got[0, "supplementary_material"] == ("true", f"50 MB. {shown[0]}; {shown[1]}")
    assert got[0, "presentation_format"][0] == "oral, poster" and got[2, "presentation_format"][0] == "virtual, demo"
    assert got[0, "page_limit_exclusions"] == ("true", "references and appendices (up to 2 pages) do not count toward page limit")
    assert got[4, "page_limit_exclusions"] == ("true", "references do not count toward page limit")
    assert got[2, "supplementary_material"][0] == "false" and got[2, "financial_aid"][0] == "true" and got[2, "conference_format"][0] == "hybrid" and got[2, "workshops"][0] == "true"
    assert got[2, "conference_format"][1] == "; ".join([around(2, "Travel grants are available", 20, 50), around(2, "hybrid conference", 20, 50)])
    first = [around(3, "Must include an ethics statement", 30, 30), around(3, "Broader impact statement is required", 30, 30), around(3, "impact statement is required", 30, 30)]
    assert got[3, "statements"] == ("true", "Required statements: ethics_statement, broader_impact. " + "; ".join(first))
    assert got[4, "statements"][1] == "Required statements: reproducibility_checklist. A paper checklist."
    assert {f for k, f in got if k == 3} == {"statements", "has_demos", "has_posters", "has_position_papers", "has_awards"} and not any(k in (1, 5) for k, _ in got)
    shown = {r["k"]: r["r"].asDict(True) for r in found.collect()}
    assert [shown[k]["tracks"]["confidence"] for k in range(6)] == ["low", "low", "low", "high", "low", "low"] and shown[3]["statements"]["confidence"] == "high"
    assert shown[5]["submission"]["template"] is None and shown[5]["logistics"]["confidence"] == "low"


def test_sentences_of_exclusions(spark):
    rows = [(0, k, "unlimited") for k in ("appendices", "references", "acknowledgments")]
    got = exclusions_text(spark.createDataFrame(rows, "k int, kind string, pages string"), ["k"]).first()["evidence"]
    assert got.endswith("do not count toward page limit") and got.count(",") == 2 and ", and " in got


def test_formats_of_presentation(spark):
    rows = [
        (1, "ORAL presentations; later Presented as posters."), (2, "In-person presentations only."), (3, None), (4, ""), (5, "Nothing of note on oral exams."),
        (6, "Papers are presented virtually."), (6, "Demo\npresentation"), (7, "virtual presentations, demo presentations, poster presentations and oral presentations"),
    ]
    got = presentation_formats(spark.createDataFrame(rows, "k int, text string"), ["k"]).collect()
    assert sorted(map(tuple, got)) == [(1, "oral,poster"), (2, ""), (6, "demo,virtual"), (7, "oral,poster,demo,virtual")]
