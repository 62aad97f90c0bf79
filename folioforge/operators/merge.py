"""Merging rules with defaults, feeds, classifiers and model answers; provenance and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.dates import comparison_key
from folioforge.functions.rules import is_known
from folioforge.operators.reports import percent
from folioforge.operators.scan import small


def default_fill(rules: DataFrame, keys: DataFrame, fields: DataFrame) -> DataFrame:
    """A row for every key and field: the rule's value, or the field's default. The field table is configuration, so small."""
    names = keys.columns
    every = keys.distinct().crossJoin(small(fields.select("field", "category", "priority", "default")))
    return every.join(rules, [*names, "field"], "left").withColumn("value", F.coalesce("value", "default")).drop("default")


def with_feeds(rules: DataFrame, keys: list[str], feeds: list[tuple[str, DataFrame]]) -> DataFrame:
    """rules (keys, field, value) with (value, source, conflict): the first feed that knows a field wins, then the rule itself.

    feeds: (name, rows of keys, field, value) by falling trust. conflict: known values that differ in their comparison keys.
    """
    out = rules.withColumnRenamed("value", "own")
    values: list[tuple[str, Column]] = []
    for name, rows in feeds:
        out = out.join(rows.select(*keys, "field", F.col("value").alias(f"v_{name}")), [*keys, "field"], "left")
        values.append((name, F.col(f"v_{name}")))
    values.append(("regex", F.col("own")))
    best, source = F.when(F.lit(False), F.col("own")), F.when(F.lit(False), F.lit(""))
    for name, v in values:
        best, source = best.when(is_known(v), v), source.when(is_known(v), F.lit(name))
    known = F.array_distinct(F.array_compact(F.array(*[F.when(is_known(v), comparison_key(v)) for _, v in values])))
    listed = F.array_join(F.array_compact(F.array(*[F.when(is_known(v), F.concat(F.lit(f"{name}="), v)) for name, v in values])), "; ")
    out = out.select(*keys, "field", best.otherwise("unknown").alias("value"), source.alias("source"), (F.size(known) > 1).alias("conflict"), listed.alias("candidates"))
    return out


def override(rules: DataFrame, classified: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, value, origin): a classifier's value wins where it is known; unknown, empty, false and not_mentioned never do."""
    c = classified.where(~F.coalesce("value", F.lit("unknown")).isin("unknown", "", "false", "not_mentioned")).select(*keys, "field", F.col("value").alias("better"))
    got = rules.select(*keys, "field", "value").join(c, [*keys, "field"], "full")
    return got.select(*keys, "field", F.coalesce("better", "value").alias("value"), F.when(F.col("better").isNotNull(), "classifier").otherwise("regex").alias("origin"))


def merge_batches(answers: DataFrame, keys: list[str]) -> DataFrame:
    """answers (keys, batch, field, value) to one row a field: the last batch wins, its name is kept, differing values are a conflict."""
    got = answers.where(is_known(F.col("value"))).groupBy(*keys, "field")
    got = got.agg(F.max(F.struct("batch", "value")).alias("last"), F.count_distinct(comparison_key(F.col("value"))).alias("n"), F.max("batch").alias("batches"))
    return got.select(*keys, "field", "last.value", F.when(F.col("last.batch") == 1, "llm").otherwise(F.concat(F.lit("llm_batch"), F.col("last.batch").cast("string"))).alias("source"), (F.col("n") > 1).alias("conflict"))


def parse_answers(responses: DataFrame, keys: list[str]) -> DataFrame:
    """responses (keys, batch, response) to (keys, batch, field, value, evidence); a value is plain or {value, evidence}; others are left out."""
    plain = F.from_json("response", "map<string,string>")
    rows = responses.select(*keys, "batch", F.explode(plain).alias("field", "raw"))
    nested = F.from_json("raw", "value string, evidence string")
    is_nested = F.startswith(F.ltrim("raw"), F.lit("{"))
    value = F.when(is_nested, nested["value"]).otherwise(F.col("raw"))
    low = F.lower(F.trim(value))
    value = F.when(value.isNull() | low.isin("null", "none", "n/a", ""), "unknown").when(low.isin("true", "yes"), "true").when(low.isin("false", "no"), "false").otherwise(value)
    return rows.select(*keys, "batch", "field", value.alias("value"), F.when(is_nested, nested["evidence"]).alias("evidence"))


def unparsed(responses: DataFrame) -> DataFrame:
    """Responses that hold no JSON object; kept aside, not lost."""
    return responses.where(F.try_parse_json("response").isNull() | F.from_json("response", "map<string,string>").isNull())


#: Texts of a model that stand for nothing, and for true and false in boolean fields.
_NULLS, _TRUE, _FALSE = ("unknown", "null", ""), ("true", "yes", "1"), ("false", "no", "0")


def _entries(responses: DataFrame, keys: list[str], fields: DataFrame) -> DataFrame:
    """(keys, batch, field, type, kind, v, evidence) of the known fields that a response names; v is what stands for the value, kind its JSON type."""
    known = F.from_json("response", "map<string,variant>")
    objects = responses.where(F.startswith(F.schema_of_variant(F.try_parse_json("response")), F.lit("OBJECT")))
    rows = objects.select(*keys, "batch", F.explode(known).alias("field", "entry")).where("entry is not null").join(small(fields.select("field", "type")), "field")
    kind = F.schema_of_variant("entry")
    inner = F.try_variant_get("entry", "$.value", "variant")
    whole = F.startswith(kind, F.lit("OBJECT")) & inner.isNotNull()
    rows = rows.withColumn("v", F.when(whole, inner).otherwise(F.col("entry"))).withColumn("evidence", F.when(whole, F.try_variant_get("entry", "$.evidence", "string")))
    return rows.select(*keys, "batch", "field", "type", F.schema_of_variant("v").alias("kind"), "v", "evidence")


def _as_text(v: Column, kind: Column) -> Column:
    """A value as text: strings as they are, lists of plain values by semicolons, other things as JSON."""
    plain = F.try_variant_get(v, "$", "string")
    flat = F.startswith(kind, F.lit("ARRAY")) & ~kind.rlike("^ARRAY<(ARRAY|OBJECT|VARIANT)")
    return F.when(flat, F.array_join(F.try_variant_get(v, "$", "array<string>"), "; ")).when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), F.to_json(v)).otherwise(plain)


def _judged(responses: DataFrame, keys: list[str], fields: DataFrame) -> DataFrame:
    """_entries() with text, and value where it counts by the field's type."""
    rows = _entries(responses, keys, fields).withColumn("text", _as_text(F.col("v"), F.col("kind")))
    low = F.lower(F.regexp_replace("text", r"^\s+|\s+$", ""))
    null = (F.col("kind") == "VOID") | ((F.col("kind") == "STRING") & low.isin(*_NULLS))
    truth = F.when(low.isin(*_TRUE), "true").when(low.isin(*_FALSE), "false")
    return rows.withColumn("value", F.when(F.col("type") == "boolean", truth).when(~null, F.col("text"))).withColumn("empty", null)


def typed_answers(responses: DataFrame, keys: list[str], fields: DataFrame) -> DataFrame:
    """responses (keys, batch, response) to (keys, batch, field, value, evidence), coerced by the type that fields (field, type) gives.

    An entry is a value or {value, evidence}. Booleans come as JSON ones or as words for them, lists are joined, empty words and nulls
    are left out, and so is what no boolean field can mean. answer_rejects() has all that is left out but for nulls.
    """
    return _judged(responses, keys, fields).where("value is not null").select(*keys, "batch", "field", "value", clean_evidence(F.coalesce("evidence", F.lit(""))).alias("evidence"))


def answer_quality(merged: DataFrame, keys: list[str], fields: DataFrame) -> DataFrame:
    """(keys, known, total, percentage, conflicts, answered): completeness of merge_batches() rows over all fields, conflicting fields, and those with a source."""
    wanted = small(fields.select("field"))
    got = merged.join(wanted, "field", "left_semi").groupBy(*keys).agg(F.count_if(is_known(F.col("value"))).alias("known"), F.count_if("conflict").alias("conflicts"), F.count("source").alias("answered"))
    rows = got.crossJoin(F.broadcast(wanted.agg(F.count(F.lit(1)).alias("total"))))
    return rows.select(*keys, "known", "total", percent(F.col("known"), F.col("total")).alias("percentage"), "conflicts", "answered")


def answer_rejects(responses: DataFrame, keys: list[str], fields: DataFrame) -> DataFrame:
    """(keys, batch, field, raw, reason): responses that are no JSON object, fields nobody asked for, and values that their type can't take."""
    parsed = F.try_parse_json("response")
    broken = responses.where(parsed.isNull() | ~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")))
    broken = broken.select(*keys, "batch", F.lit(None).cast("string").alias("field"), F.col("response").alias("raw"), F.when(F.col("response").isNull(), "no answer").when(parsed.isNull(), "no JSON").otherwise("no object").alias("reason"))
    good = responses.where(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")))
    named = good.select(*keys, "batch", F.explode(F.from_json("response", "map<string,variant>")).alias("field", "entry"))
    unknown = named.join(small(fields.select("field")), "field", "left_anti").select(*keys, "batch", "field", F.to_json("entry").alias("raw"), F.lit("unknown field").alias("reason"))
    bad = _judged(responses, keys, fields).where("value is null and not empty").select(*keys, "batch", "field", F.to_json("v").alias("raw"), F.concat(F.lit("no "), "type").alias("reason"))
    return broken.union(unknown).union(bad)


def clean_evidence(v: Column, most: int = 150) -> Column:
    """Without markdown and pipes, single spaces, cut at a word with dots behind."""
    out = F.regexp_replace(F.regexp_replace(v, r"[*_`#>]+", ""), r"\s*\|\s*", ", ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    cut = F.regexp_replace(F.substring(out, 1, most), r"\s+\S*$", "")
    return F.when(F.length(out) > most, F.concat(cut, F.lit("..."))).otherwise(out)


def feed_text(short: Column, pairs: list[tuple[str, Column]]) -> Column:
    """'key: value' lines in order, without the unknown ones."""
    return F.concat_ws("\n", F.concat(F.lit("conference: "), short), *[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), v)) for k, v in pairs])


def prompt_text(header: str, data: Column) -> Column:
    return F.concat(F.lit(header.rstrip() + "\n\n"), data)


def pack_batches(sections: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """(keys, order, batch): next fit: sections fill a batch in order; one that doesn't fit opens the next. A fold over each key's ordered array."""
    lists = sections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length("text").alias("n")))).alias("s"))
    start = F.struct(F.lit(1).alias("batch"), F.lit(0).alias("used"), F.array().cast("array<struct<o: bigint, batch: int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] == 0) | (acc["used"] + x["n"] <= budget)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        used = F.when(fits, acc["used"] + x["n"]).otherwise(x["n"])
        return F.struct(batch.alias("batch"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(x["o"].cast("long").alias("o"), batch.alias("batch")))).alias("out"))

    folded = lists.select(*keys, F.aggregate("s", start, step)["out"].alias("out"))
    return folded.select(*keys, F.explode("out").alias("x")).select(*keys, F.col("x.o").alias(order), "x.batch")
