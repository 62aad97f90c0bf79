"""The default fields and patterns of the rule scan: fields are a table, patterns follow from their phrases by rule.

Callers add fields by adding rows, or read tables of their own (sources.archive.read_patterns); nothing here names a field in code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Field, category, type, priority, default.
FIELDS = [
    ("submission_deadline", "deadlines", "date", "critical", "unknown"),
    ("abstract_deadline", "deadlines", "date", "high", "unknown"),
    ("notification_date", "deadlines", "date", "critical", "unknown"),
    ("camera_ready_deadline", "deadlines", "date", "high", "unknown"),
    ("conference_dates", "deadlines", "date", "critical", "unknown"),
    ("rebuttal_deadline", "deadlines", "date", "medium", "unknown"),
    ("withdrawal_deadline", "deadlines", "date", "low", "unknown"),
    ("registration_deadline", "deadlines", "date", "medium", "unknown"),
    ("double_blind", "review_process", "boolean", "critical", "unknown"),
    ("single_blind", "review_process", "boolean", "high", "unknown"),
    ("open_review", "review_process", "boolean", "high", "unknown"),
    ("rebuttal_allowed", "review_process", "boolean", "high", "unknown"),
    ("desk_rejection", "review_process", "boolean", "medium", "unknown"),
    ("reciprocal_review", "review_process", "boolean", "low", "unknown"),
    ("page_limit", "submission_requirements", "string", "critical", "unknown"),
    ("page_limit_exclusions", "submission_requirements", "boolean", "high", "unknown"),
    ("template_required", "submission_requirements", "boolean", "high", "unknown"),
    ("supplementary_material_allowed", "submission_requirements", "boolean", "medium", "unknown"),
    ("concurrent_submission", "publication_policies", "boolean", "high", "unknown"),
    ("arxiv_preprint", "publication_policies", "boolean", "high", "unknown"),
    ("publication_venue", "publication_policies", "string", "low", "unknown"),
    ("statements", "ethics_reproducibility", "boolean", "high", "unknown"),
    ("artifact_evaluation", "ethics_reproducibility", "enum", "high", "unknown"),
    ("llm_policy", "ethics_reproducibility", "enum", "medium", "unknown"),
    ("conference_location", "conference_logistics", "string", "medium", "unknown"),
    ("conference_format", "conference_logistics", "enum", "medium", "unknown"),
    ("presentation_formats", "conference_logistics", "list", "low", "unknown"),
    ("financial_aid_available", "conference_logistics", "boolean", "low", "unknown"),
    ("workshops", "conference_logistics", "boolean", "low", "unknown"),
    ("submission_system", "publication_details", "enum", "medium", "unknown"),
    ("has_workshop_proposals", "tracks_and_events", "boolean", "low", "unknown"),
    ("has_tutorials", "tracks_and_events", "boolean", "low", "unknown"),
    ("has_demos", "tracks_and_events", "boolean", "low", "unknown"),
    ("has_posters", "tracks_and_events", "boolean", "low", "unknown"),
    ("has_industry_track", "tracks_and_events", "boolean", "low", "unknown"),
    ("has_position_papers", "tracks_and_events", "boolean", "low", "unknown"),
    ("has_student_research", "tracks_and_events", "boolean", "low", "unknown"),
    ("has_doctoral_consortium", "tracks_and_events", "boolean", "low", "unknown"),
    ("has_findings", "tracks_and_events", "boolean", "low", "unknown"),
    ("has_awards", "tracks_and_events", "boolean", "low", "unknown"),
]
# Words of a match that make a boolean field true unless negated, and words that make it false.
POSITIVE = {
    "double_blind": ["double-blind", "double blind", "anonymized", "anonymous"],
    "single_blind": ["single-blind", "single blind", "reviewers anonymous"],
    "rebuttal_allowed": ["rebuttal", "author response", "response", "opportunity"],
    "desk_rejection": ["desk", "reject", "administrative"],
    "reciprocal_review": ["reciprocal", "review", "required", "must"],
    "open_review": ["OpenReview.net", "public reviews", "open peer review", "publicly visible"],
    "page_limit_exclusions": ["excluding references", "references excluded", "unlimited references", "references do not count"],
    "template_required": ["must use template", "template required", "required format", "style file"],
    "supplementary_material_allowed": ["supplementary", "option", "supports", "submit", "upload"],
    "concurrent_submission": ["concurrent allowed", "simultaneous allowed"],
    "arxiv_preprint": ["arxiv", "allowed", "preprint", "will not result in rejection"],
    "statements": ["ethics", "statement", "required", "checklist", "limitations"],
    "financial_aid_available": ["travel grants", "financial aid"],
    "workshops": ["workshops", "satellite events"],
}
NEGATIVE = {
    "double_blind": ["not double-blind", "single-blind", "single blind"],
    "single_blind": ["double-blind", "double blind", "not single-blind"],
    "open_review": ["call for", "submission", "deadline", "papers"],
    "concurrent_submission": ["concurrent not allowed", "simultaneous not allowed", "dual submission policy", "may not submit"],
    "arxiv_preprint": ["not allowed"],
}
# Labels of enum fields, and the cleaners of fields.
ALLOWED = {
    "artifact_evaluation": ["required", "optional", "not_mentioned"],
    "llm_policy": ["allowed", "discouraged", "prohibited", "must_disclose"],
    "conference_format": ["in-person", "virtual", "hybrid"],
    "submission_system": ["OpenReview", "EasyChair", "CMT", "SoftConf", "HotCRP"],
}
CLEANED_BY = {
    "submission_deadline": "deadline", "notification_date": "notification", "page_limit": "page_number", "publication_venue": "venue", "artifact_evaluation": "artifact",
    "llm_policy": "model_policy", "submission_system": "system_name",
}
RANGES = ["conference_dates"]
PLACES = ["conference_location"]
#: Extractors name the same thing in several ways; one vocabulary for comparisons.
CANONICAL = {
    "required": "mandatory", "mandatory": "mandatory", "optional": "optional", "must_disclose": "required_disclosure", "required_disclosure": "required_disclosure",
    "prohibited": "forbidden", "forbidden": "forbidden", "not_allowed": "forbidden", "allowed": "allowed",
}

#: Phrases of each field in the order in which they are tried: (an anchor that each match holds, in lower case; the phrase).
PHRASES = {
    "submission_deadline": [("submission deadline", "submission deadline"), ("due", "papers? (?:are )?due"), ("manuscript", "manuscripts? deadline")],
    "abstract_deadline": [("abstract", "abstract (?:registration |submission )?deadline"), ("abstract", "abstracts? (?:are )?due")],
    "notification_date": [("notif", "notification(?: date| of acceptance)?"), ("notif", "authors will be notified"), ("decision", "decisions? announced")],
    "camera_ready_deadline": [("camera", "camera[- ]ready(?: papers?)? deadline"), ("camera", "camera[- ]ready (?:papers? )?(?:are )?due")],
    "conference_dates": [("dates", "(?:conference|event|main) dates?"), ("takes place", "conference takes place")],
    "rebuttal_deadline": [("rebuttal", "rebuttal deadline"), ("response", "author responses? (?:are )?due")],
    "withdrawal_deadline": [("withdraw", "withdrawal deadline"), ("withdraw", "last day to withdraw")],
    "registration_deadline": [("registration", "registration deadline"), ("register", "register by")],
    "double_blind": [("double", "double[- ]blind"), ("anonym", "anonymi[sz]ed submission")],
    "single_blind": [("single", "single[- ]blind"), ("reviewers", "reviewers remain anonymous")],
    "open_review": [("open", "open peer review"), ("public", "public review")],
    "rebuttal_allowed": [("rebuttal", "rebuttal"), ("response", "author response period")],
    "desk_rejection": [("desk", "desk[- ]reject(?:ed|ion)?")],
    "reciprocal_review": [("reciprocal", "reciprocal review(?:ing)?")],
    "page_limit": [("limited to", r"limited to \d+ pages?"), ("page", r"(?:maximum of|up to|at most) \d+ pages?"), ("exceed", r"not exceed \d+ pages?")],
    "page_limit_exclusions": [("references", "(?:excluding|not counting|plus unlimited) references"), ("appendi", "(?:excluding|plus unlimited) appendi(?:x|ces)")],
    "template_required": [("template", "(?:latex )?template is (?:required|mandatory)"), ("style", "official style files?")],
    "supplementary_material_allowed": [("supplementary", "supplementary material")],
    "concurrent_submission": [("concurrent", "concurrent submission"), ("simultaneous", "simultaneous submission")],
    "arxiv_preprint": [("arxiv", "arxiv preprint"), ("preprint", "preprint posting")],
    "publication_venue": [("proceedings of", "proceedings of [A-Za-z ]+"), ("published", "published (?:in|by) [A-Za-z ]+")],
    "statements": [("ethics", "ethics statement"), ("impact", "broader impact statement"), ("checklist", "reproducibility checklist")],
    "artifact_evaluation": [("artifact", "artifact (?:evaluation|submission)s? (?:is|are) [a-z]+"), ("code", "code submission is [a-z]+")],
    "llm_policy": [("chatgpt", "(?:use of )?chatgpt (?:is|must be|should be) [a-z ]+"), ("language model", "language models? (?:are|must be) [a-z ]+")],
    "conference_location": [("held in", "held in [A-Za-z0-9 ]+, [A-Za-z ]+"), ("place in", "takes place in [A-Za-z0-9 ]+, [A-Za-z ]+")],
    "conference_format": [("hybrid", "hybrid (?:conference|format)"), ("virtual", "virtual (?:conference|format)"), ("person", "in[- ]person (?:conference|format)")],
    "presentation_formats": [("oral", "oral presentations?(?: and poster presentations?)?"), ("poster", "poster presentations?")],
    "financial_aid_available": [("travel grant", "travel grants?"), ("financial aid", "financial aid")],
    "workshops": [("workshop", "co-located workshop"), ("satellite", "satellite event")],
    "submission_system": [("openreview", "openreview"), ("easychair", "easychair"), ("cmt", r"\bcmt\b"), ("softconf", "softconf"), ("hotcrp", "hotcrp")],
    "has_workshop_proposals": [("workshop proposal", "workshop proposal")],
    "has_tutorials": [("tutorial", "(?:call for )?tutorial")],
    "has_demos": [("demo", "call for demo"), ("demo", "demo track")],
    "has_posters": [("poster", "call for poster"), ("poster", "poster track")],
    "has_industry_track": [("industry", "industry track"), ("industrial", "industrial track")],
    "has_position_papers": [("position", "position paper")],
    "has_student_research": [("student", "student research")],
    "has_doctoral_consortium": [("doctoral", "doctoral consortium"), ("phd", "phd forum")],
    "has_findings": [("findings", "findings (?:paper|track)")],
    "has_awards": [("award", "(?:best paper |paper )?award")],
}
#: How a date may follow its phrase.
_DATES = [("date", r"[A-Z][a-z]+ \d{1,2},? \d{4}"), ("month", r"[A-Z][a-z]+ \d{4}"), ("season", r"(?:Spring|Summer|Fall|Autumn|Winter) \d{4}"), ("open", "(?:TBD|TBA|to be announced|coming soon)")]
_RANGES = [("range", r"[A-Z][a-z]+ \d{1,2} ?(?:-|to|through) ?(?:[A-Z][a-z]+ )?\d{1,2},? \d{4}"), *_DATES]
_GLUE = r"\s*:?\s*(?:is |on |by |in )?"
_REFUSED = "(?:allowed|permitted|required|offered|accepted|considered|available)"


def patterns_of(field: str, kind: str) -> list[tuple[str, str]]:
    """(name, regex) of a field's patterns in their order: dates by what follows the phrase, booleans denied before they are named, others as they are."""
    out = []
    for n, (_, phrase) in enumerate(PHRASES[field]):
        if kind == "date":
            out += [(f"{form}_{n}", f"{phrase}{_GLUE}{rx}") for form, rx in (_RANGES if field in RANGES else _DATES)]
        elif kind == "boolean":
            out += [(f"no_{n}", rf"\b(?:no|without|not) (?:a |an |any )?(?:{phrase})"), (f"not_allowed_{n}", rf"(?:{phrase})s? (?:is|are|will) not (?:be )?{_REFUSED}"), (f"named_{n}", f"{phrase}")]
        else:
            out.append((f"{kind}_{n}", phrase))
    # Denials of any phrase come before the names of all.
    return sorted(out, key=lambda p: p[0].startswith("named")) if kind == "boolean" else out


PATTERNS = [(field, name, regex) for field, _, kind, *_ in FIELDS for name, regex in patterns_of(field, kind)]


def fields_table(spark: SparkSession) -> DataFrame:
    """(field, category, type, priority, default, cleaner, anchors, positive, negative, allowed, is_range, is_place): all that handlers need to know of a field."""
    rows = [(*f, CLEANED_BY.get(f[0]), sorted({a for a, _ in PHRASES[f[0]]}), POSITIVE.get(f[0]), NEGATIVE.get(f[0]), ALLOWED.get(f[0]), f[0] in RANGES, f[0] in PLACES) for f in FIELDS]
    words = "anchors array<string>, positive array<string>, negative array<string>, allowed array<string>"
    return spark.createDataFrame(rows, f"field string, category string, type string, priority string, default string, cleaner string, {words}, is_range boolean, is_place boolean")


def patterns_table(spark: SparkSession) -> DataFrame:
    numbers: dict[str, int] = {}
    rows = []
    for field, name, regex in PATTERNS:
        rows.append((field, numbers.get(field, 0), name, regex))
        numbers[field] = numbers.get(field, 0) + 1
    return spark.createDataFrame(rows, "field string, pattern_idx int, name string, regex string")
