"""What a text asks for and offers, as one typed row for each text, and its results as rows of the field table.

Every group of labelled patterns is a field of the rule scan: its first label with a match counts, at the place of that label's first
pattern that matches. So one pass over the texts finds all groups, tracks and statements, each with the signs around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import classifier_patterns as c
from folioforge.functions.text import let
from folioforge.operators.scan import scan_with

#: Signs before and behind a match that its evidence shows.
WINDOWS = {"template": (30, 30), "supplementary": (30, 100), "aid": (20, 50), "delivery": (20, 50), "workshops": (0, 0)}
TRACK_WINDOW, STATEMENT_WINDOW = (20, 50), (30, 30)
_LIMIT = r"(?i)(\d+)\s*(?:MB|GB|pages?)"
_FORMATS = ["oral", "poster", "demo", "virtual"]
#: Field, category and priority of each family's rows.
ROWS = [
    ("template_required", "submission_requirements", "high"), ("supplementary_material", "submission_requirements", "medium"), ("presentation_format", "conference_info", "medium"), ("financial_aid", "conference_info", "low"),
    ("workshops", "conference_info", "low"), ("conference_format", "conference_info", "high"), ("statements", "ethics_reproducibility", "high"), *[(t, "tracks_and_events", "low") for t in c.TRACKS],
]


def _statement(label: str, k: int) -> str:
    return f"statement/{label}/{k}"


def groups() -> list[tuple[str, int, str, str]]:
    """(group, number, label, regex) of all groups: tracks are groups of their own, and so is each pattern of a statement, as each may show its first match."""
    labelled = {"template": c.TEMPLATE, "supplementary": c.SUPPLEMENTARY, "delivery": c.DELIVERY, "aid": {"true": c.AID}, "workshops": {"true": c.WORKSHOPS}, **{t: {t: rxs} for t, rxs in c.TRACKS.items()}}
    out = []
    for group, labels in labelled.items():
        out += [(group, n, label, rx) for n, (label, rx) in enumerate((label, rx) for label, rxs in labels.items() for rx in rxs)]
    return out + [(_statement(label, k), 0, label, rx) for label, rxs in c.STATEMENTS.items() for k, rx in enumerate(rxs)]


def _windows() -> dict[str, tuple[int, int]]:
    return WINDOWS | {t: TRACK_WINDOW for t in c.TRACKS} | {_statement(s, k): STATEMENT_WINDOW for s, rxs in c.STATEMENTS.items() for k in range(len(rxs))}


def _joined(parts: Column, most: int) -> Column:
    return F.array_join(F.slice(parts, 1, most), "; ")


def presentation_order(text: Column) -> Column:
    """The presentation formats that a text names, in the order in which the patterns' matches first name them."""
    low = F.lower(text)
    found = let(low, lambda x: F.concat(*[F.regexp_extract_all(x, F.lit(f"(?U){rx}"), F.lit(0)) for rx in c.PRESENTATION]))
    at = lambda found, w, k: F.array_min(F.transform(found, lambda m, i: F.when(F.contains(m, F.lit(w)), i * len(_FORMATS) + k)))
    named = lambda found: F.array(*[F.struct(at(found, w, k).alias("at"), F.lit(w).alias("name")) for k, w in enumerate(_FORMATS)])
    return let(found, lambda f: F.transform(F.sort_array(F.filter(named(f), lambda x: x["at"].isNotNull())), lambda x: x["name"]))


def requirements(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r): a row for each text with its submission, logistics, tracks and statements, each with evidence and confidence; what isn't mentioned is null."""
    hits = scan_with(texts, keys, groups(), _windows())
    found = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("name", "match", "window").alias("hit")))).alias("h"))
    rows = texts.select(*keys, presentation_order(F.col("text")).alias("formats")).join(found, keys, "left")
    hit = lambda g: F.col("h")[g]
    shown = lambda names: F.array_compact(F.array(*[hit(g)["window"] for g in names]))
    some = lambda e: F.when(F.size(e) > 0, "medium").otherwise("low")
    submission, logistics = shown(["template", "supplementary"]), shown(["aid", "delivery"])
    limits = F.nullif(F.regexp_extract(hit("supplementary")["window"], _LIMIT, 0), F.lit(""))
    tracks = F.array_compact(F.array(*[F.when(hit(t).isNotNull(), F.lit(t)) for t in c.TRACKS]))
    types = F.array_compact(F.array(*[F.when(F.coalesce(*[hit(_statement(s, k)) for k in range(len(rxs))]).isNotNull(), F.lit(s)) for s, rxs in c.STATEMENTS.items()]))
    named = shown([_statement(s, k) for s, rxs in c.STATEMENTS.items() for k in range(len(rxs))])
    by_count = lambda n, sure: F.when(n >= sure, "high").when(n >= 1, "medium").otherwise("low")
    r = F.struct(
        F.struct((hit("template")["name"] == "required").alias("template"), hit("template")["match"].alias("details"), (hit("supplementary")["name"] == "allowed").alias("supplementary"), limits.alias("limits"), _joined(submission, 2).alias("evidence"), some(submission).alias("confidence")).alias("submission"),
        F.struct(F.col("formats"), hit("aid").isNotNull().alias("aid"), hit("workshops").isNotNull().alias("workshops"), hit("delivery")["name"].alias("delivery"), _joined(logistics, 2).alias("evidence"), some(logistics).alias("confidence")).alias("logistics"),
        F.struct(tracks.alias("names"), _joined(shown(c.TRACKS), 3).alias("evidence"), by_count(F.size(tracks), 3).alias("confidence")).alias("tracks"),
        F.struct(types.alias("types"), _joined(named, 3).alias("all"), F.get(named, F.lit(0)).alias("first"), by_count(F.size(types), 2).alias("confidence")).alias("statements"),
    )
    return rows.select(*keys, r.alias("r"))


def exclusions_text(exclusions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, evidence): what doesn't count to the page limit, as a sentence, in the order of the kinds."""
    order = F.array_position(F.array(*[F.lit(k) for k in c.EXCLUSIONS]), F.col("kind"))
    part = F.when(F.col("pages") == "unlimited", F.col("kind")).otherwise(F.concat("kind", F.lit(" (up to "), "pages", F.lit(")")))
    lists = exclusions.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), part.alias("part")))), lambda x: x["part"]).alias("parts"))
    n, last = F.size("parts"), F.element_at("parts", -1)
    listed = F.when(n == 1, last).when(n == 2, F.concat(F.get("parts", F.lit(0)), F.lit(" and "), last)).otherwise(F.concat(F.array_join(F.slice("parts", F.lit(1), n - 1), ", "), F.lit(", and "), last))
    return lists.select(*keys, F.concat(listed, F.lit(" do not count toward page limit")).alias("evidence"))


def requirement_rows(found: DataFrame, keys: list[str], exclusions: DataFrame | None = None) -> DataFrame:
    """(keys, field, value, evidence, category, priority) of what requirements() found, by one unpivot; exclusions (keys, kind, pages) add their row."""
    s, g, t, m = (F.col(f"r.{x}") for x in ("submission", "logistics", "tracks", "statements"))
    with_limits = F.when(s["limits"].isNotNull() & (s["evidence"] != ""), F.concat(s["limits"], F.lit(". "), s["evidence"])).otherwise(F.coalesce(s["limits"], s["evidence"]))
    said = F.when(F.size(m["types"]) >= 2, m["all"]).otherwise(m["first"])
    values = {
        "template_required": (s["template"].cast("string"), F.coalesce(s["details"], s["evidence"])), "supplementary_material": (s["supplementary"].cast("string"), with_limits),
        "presentation_format": (F.when(F.size(g["formats"]) > 0, F.array_join(g["formats"], ", ")), g["evidence"]), "financial_aid": (F.when(g["aid"], "true"), g["evidence"]), "workshops": (F.when(g["workshops"], "true"), g["evidence"]),
        "conference_format": (g["delivery"], g["evidence"]), "statements": (F.when(F.size(m["types"]) > 0, "true"), F.concat(F.lit("Required statements: "), F.array_join(m["types"], ", "), F.lit(". "), said)),
    } | {name: (F.when(F.array_contains(t["names"], name), "true"), t["evidence"]) for name in c.TRACKS}
    entry = lambda f, category, priority: F.struct(F.lit(f).alias("field"), values[f][0].alias("value"), values[f][1].alias("evidence"), F.lit(category).alias("category"), F.lit(priority).alias("priority"))
    rows = found.select(*keys, F.explode(F.array(*[entry(*x) for x in ROWS])).alias("x")).select(*keys, "x.*").where("value is not null")
    if exclusions is None:
        return rows
    own = exclusions_text(exclusions, keys)
    return rows.union(own.select(*keys, F.lit("page_limit_exclusions"), F.lit("true"), "evidence", F.lit("submission_requirements"), F.lit("high")))


def extractor_results(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, extractor, field, value, confidence) of every extractor for every text; what an extractor doesn't find has the value unknown."""
    from folioforge.operators import classify

    every = texts.select(*keys).distinct()
    lit = F.lit
    review = classify.review_class(texts, keys).select(*keys, lit("review").alias("extractor"), lit("review").alias("field"), F.col("label").alias("value"), "confidence")
    pages = every.join(classify.page_limit(texts, keys), keys, "left").select(*keys, lit("pages"), lit("page_limit"), F.coalesce("main_limit", lit("unknown")), F.coalesce("confidence", lit("low")))
    policies = classify.policy_class(texts, keys).select(*keys, lit("policies"), "policy", "label", "confidence")
    s, g, t, m = (F.col(f"r.{x}") for x in ("submission", "logistics", "tracks", "statements"))
    flag = lambda found: F.when(found, "true").otherwise("unknown")
    text = lambda v: F.coalesce(v.cast("string"), lit("unknown"))
    some = [
        ("submission", "template", text(s["template"]), s["confidence"]), ("submission", "supplementary", text(s["supplementary"]), s["confidence"]), ("logistics", "formats", F.when(F.size(g["formats"]) > 0, F.array_join(g["formats"], ",")).otherwise("unknown"), g["confidence"]),
        ("logistics", "aid", flag(g["aid"]), g["confidence"]), ("logistics", "workshops", flag(g["workshops"]), g["confidence"]), ("logistics", "delivery", text(g["delivery"]), g["confidence"]),
        ("statements", "statements", F.when(F.size(m["types"]) > 0, F.array_join(m["types"], ",")).otherwise("unknown"), m["confidence"]), *[("tracks", name, flag(F.array_contains(t["names"], name)), t["confidence"]) for name in c.TRACKS],
    ]
    rest = requirements(texts, keys).select(*keys, F.explode(F.array(*[F.struct(lit(e).alias("extractor"), lit(f).alias("field"), v.alias("value"), q.alias("confidence")) for e, f, v, q in some])).alias("x")).select(*keys, "x.*")
    return review.union(pages).union(policies).union(rest)


def distributions(results: DataFrame, keys: list[str]) -> DataFrame:
    """(extractor, level, field, value, confidence, n, known, texts): results of extractor_results() counted by value, by confidence, by field and in all, in one pass.

    known counts rows with a known value, texts the texts with any such row of that group; level names what a row is counted by.
    """
    known = ~F.coalesce("value", F.lit("unknown")).isin("unknown", "", "not_mentioned")
    rows = results.select("extractor", "field", "value", "confidence", known.alias("_known"), F.when(known, F.struct(*keys)).alias("_text"))
    e, f, v, q = (F.col(x) for x in ("extractor", "field", "value", "confidence"))
    counted = rows.groupingSets([[e, f, v], [e, q], [e, f], [e]], e, f, v, q).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), F.count_if("_known").alias("known"), F.count_distinct("_text").alias("texts"))
    level = F.when(F.col("_set") == 1, "value").when(F.col("_set") == 6, "confidence").when(F.col("_set") == 3, "field").otherwise("extractor")
    return counted.select("extractor", level.alias("level"), "field", "value", "confidence", "n", "known", "texts")
