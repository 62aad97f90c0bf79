"""SQL twins of the views in sources.tables."""

from folioforge.functions import patterns as pt
from folioforge.functions.fixed import NEGATIONS, NEGATIVE_NAMES
from folioforge.sources.tables import SENTENCES

_MONTH = "(['January','February','March','April','May','June','July','August','September','October','November','December'])[month(o_orderdate)]"

_DAY = "(day(o_orderdate) % 20 + 1)"
_TITLE = "array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_FILLED = f"[{', '.join(chr(39) + s.replace(chr(39), chr(39) * 2) + chr(39) for s in SENTENCES)}][k % {len(SENTENCES)} + 1]"
for _name, _value in {
    "date": "shown", "month": "month || ' ' || year", "n": "(6 + k % 7)::VARCHAR", "place": f"'City' || n_nationkey || ', ' || {_TITLE}", "range": "month || ' ' || d || ' - ' || (d + 3) || ', ' || year",
}.items():
    _FILLED = f"replace({_FILLED}, '{{{_name}}}', {_value})"

POLICY = f"""WITH dated AS (SELECT o_orderkey AS k, o_custkey, 'CONF' || (o_custkey % 50) AS entity, year(o_orderdate)::INT AS year, {_MONTH} AS month, {_DAY} AS d,
  {_MONTH} || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) AS shown FROM orders),
policy AS (SELECT entity, year, 'raw/' || k AS source_key, k, {_FILLED} AS text
  FROM dated JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
feed AS (SELECT entity, year, CASE WHEN k % 2 = 0 THEN shown ELSE 'January 1, ' || year END AS deadline, 'Town' || (k % 9) AS place, CASE WHEN k % 3 = 0 THEN 'January 1, ' || year END AS abstract, ['EasyChair', 'CMT'][k % 2 + 1] AS system
  FROM (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY k) AS r FROM dated WHERE k % 7 = 0) WHERE r = 1),
feed2 AS (SELECT entity, year, shown AS deadline, 'Town' || (k % 5) AS place, CASE WHEN k % 2 = 0 THEN shown ELSE 'June 2, ' || year END AS notification, 'June 2, ' || year AS camera, CASE WHEN k % 4 = 0 THEN 'June 2 - 5, ' || year END AS dates
  FROM (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY k) AS r FROM dated WHERE k % 7 = 1) WHERE r = 1)"""


def _values(rows: list[tuple], names: str) -> str:
    def one(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


#: Mapped fields of the two feeds: field, column of the first, column of the second.
MAPPED = [
    ("submission_deadline", "deadline", "deadline"), ("conference_location", "place", "place"), ("conference_dates", None, "dates"), ("abstract_deadline", "abstract", None),
    ("notification_date", None, "notification"), ("camera_ready_deadline", None, "camera"), ("submission_system", "system", None),
]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _boolean() -> str:
    """The boolean handler: the pattern's name, negative words, positive words unless negated in the text, else true."""
    has = lambda w: f"contains(lower(match), {_quoted(w.lower())})"
    cases = [f"WHEN regexp_matches(name, {_quoted('|'.join(NEGATIVE_NAMES))}) THEN 'false'"]
    for field in sorted({*pt.POSITIVE, *pt.NEGATIVE}):
        cases += [f"WHEN field = '{field}' AND {has(w)} THEN 'false'" for w in pt.NEGATIVE.get(field, [])]
        for w in pt.POSITIVE.get(field, []):
            key = _quoted(w.lower())
            at = f"strpos(low, {key})"
            begin = f"greatest(1, {at} - 50)"
            negated = f"(regexp_matches(substring(low, {begin}, {at} - {begin} + {len(w)}), {_quoted('|'.join(NEGATIONS))}) OR regexp_matches(substring(low, {begin}, {at} - {begin} + {len(w) + 50}), {_quoted(chr(92) + 'bno' + chr(92) + 's+' + chr(92) + 'Q' + w.lower() + chr(92) + 'E')}))"
            cases.append(f"WHEN field = '{field}' AND {has(w)} THEN CASE WHEN {negated} THEN 'false' ELSE 'true' END")
    return f"CASE {' '.join(cases)} ELSE 'true' END"


def _enum() -> str:
    low = "lower(match)"
    labels = {
        "artifact_evaluation": f"CASE WHEN regexp_matches({low}, 'required|mandatory|must submit|must provide') THEN 'required' ELSE 'optional' END",
        "llm_policy": f"CASE WHEN regexp_matches({low}, 'prohibited|not allowed|forbidden|banned|not permitted') THEN 'prohibited' WHEN regexp_matches({low}, 'disclos') THEN 'must_disclose' ELSE 'allowed' END",
    }
    for field in ("conference_format", "submission_system"):
        labels[field] = "CASE " + " ".join(f"WHEN contains({low}, '{v.lower()}') THEN '{v}'" for v in pt.ALLOWED[field]) + " ELSE 'unknown' END"
    return "CASE field " + " ".join(f"WHEN '{f}' THEN {v}" for f, v in labels.items()) + " END"


def _rules() -> str:
    n: dict[str, int] = {}
    rows = []
    for field, name, rx in pt.PATTERNS:
        rows.append((field, n.get(field, 0), name, "(?im)" + rx))
        n[field] = n.get(field, 0) + 1
    fields = pt.FIELDS
    long = lambda feed, k: " UNION ALL ".join(f"SELECT entity, year, '{m[0]}' AS field, {m[k]} AS value FROM {feed} WHERE {m[k]} IS NOT NULL" for m in MAPPED if m[k])
    norm = lambda v: f"CASE WHEN {v} NOT IN ('unknown', '') THEN trim(regexp_replace(regexp_replace(lower({v}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) END"
    place = "regexp_replace(regexp_replace(regexp_replace(match, '(?i)^held in ', ''), '\\s+[A-Z]{3,10}$', ''), '[,;.]+$', '')"
    return (
        POLICY
        + f""",
corp AS (SELECT entity, year, string_agg('=== ' || source_key || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY source_key) AS text FROM policy GROUP BY 1, 2),
pats AS (SELECT * FROM {_values(rows, "field, idx, name, rx")}),
fields AS (SELECT * FROM {_values(fields, "field, category, type, priority, dflt")}),
hits AS (SELECT entity, year, field, idx, name, rx, regexp_extract(text, rx) AS match, text FROM corp, pats WHERE regexp_matches(text, rx)),
scan AS (SELECT entity, year, field, idx AS pattern_idx, name, length(string_split_regex(text, rx)[1]) + 1 AS start, match, lower(text) AS low FROM (SELECT *, row_number() OVER (PARTITION BY entity, year, field ORDER BY idx) AS r FROM hits) WHERE r = 1),
placed AS (SELECT *, {place} AS place FROM scan),
typed AS (SELECT entity, year, field, match, CASE f.type
  WHEN 'date' THEN CASE WHEN regexp_matches(lower(match), 'tbd|tba|to be announced|coming soon') THEN 'TBD' ELSE regexp_extract(match, ':\\s*(.*)$', 1) END
  WHEN 'enum' THEN {_enum()}
  WHEN 'list' THEN trim(match)
  WHEN 'string' THEN CASE field WHEN 'page_limit' THEN regexp_extract(match, '\\d+') || ' pages'
    WHEN 'publication_venue' THEN CASE WHEN regexp_matches(lower(match), 'machine learning research') THEN 'PMLR' ELSE match END
    ELSE CASE WHEN contains(place, ',') AND length(place) BETWEEN 5 AND 100 AND len(string_split(place, ' ')) BETWEEN 2 AND 5 THEN place ELSE 'unknown' END END
  ELSE {_boolean()} END AS value FROM placed JOIN fields f USING (field)),
rules AS (SELECT k.entity, k.year, f.field, f.category, f.type, f.priority, coalesce(t.value, f.dflt) AS value, coalesce(t.match, '') AS evidence
  FROM (SELECT entity, year FROM corp) k CROSS JOIN fields f LEFT JOIN typed t ON t.entity = k.entity AND t.year = k.year AND t.field = f.field),
feedlong AS ({long("feed", 1)}),
feedlong2 AS ({long("feed2", 2)}),
known3 AS (SELECT r.entity, r.year, r.field, r.category, r.value AS own, f.value AS fed, g.value AS fed2,
  list_distinct(list_filter([{norm("f.value")}, {norm("g.value")}, {norm("r.value")}], lambda x: x IS NOT NULL)) AS kinds
  FROM rules r LEFT JOIN feedlong f ON f.entity = r.entity AND f.year = r.year AND f.field = r.field LEFT JOIN feedlong2 g ON g.entity = r.entity AND g.year = r.year AND g.field = r.field),
merged AS (SELECT entity, year, field, category, own, fed,
  CASE WHEN fed IS NOT NULL THEN fed WHEN fed2 IS NOT NULL THEN fed2 WHEN own <> 'unknown' THEN own ELSE 'unknown' END AS value, CASE WHEN fed IS NOT NULL THEN 'feed' WHEN fed2 IS NOT NULL THEN 'feed2' WHEN own <> 'unknown' THEN 'regex' END AS source,
  len(kinds) > 1 AS conflict,
  array_to_string(list_filter([CASE WHEN fed IS NOT NULL THEN 'feed=' || fed END, CASE WHEN fed2 IS NOT NULL THEN 'feed2=' || fed2 END, CASE WHEN own <> 'unknown' THEN 'regex=' || own END], lambda x: x IS NOT NULL), '; ') AS candidates
  FROM known3)"""
    )


RULES = _rules()
