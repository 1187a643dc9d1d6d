"""Reports written elsewhere, checked against what was detected. Nested fields stay arrays; nothing is exploded.

A report is a VARIANT, so each field may be missing or of another type by itself: a step that is text or a number in
its technique leaves the other steps as they are. Values are read as a loosely typed program would read them: a missing
field is empty, null is `None`, numbers and truth values are their text, lists and objects their JSON. Where a list is
expected, a text counts as its characters and an object as its keys; anything else has no elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.functions.columns import filled, let, severity_rank, strip, tactic_tokens
from logtrail.schema import CATALOGUE, DISQUALIFYING, REPORT_LINES, WARNINGS

IP = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"


def _kind(value: Column) -> Column:
    """STRING, BOOLEAN, VOID (null), ARRAY<...>, OBJECT<...> or a type of numbers; null where there is no value."""
    return F.schema_of_variant(value)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(_kind(value).startswith(kind), F.lit(False))


def _member(value: Column, name: str) -> Column:
    """A member of an object; null where it is missing or the value is no object."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def as_text(value: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return F.when(_is(value, "VOID"), F.lit("None")).when(_is(value, "BOOLEAN"), F.initcap(text)).otherwise(text)


def holds(value: Column) -> Column:
    """Whether the value is there and neither null, false, zero nor empty."""
    text = F.try_variant_get(value, "$", "string")
    empty = F.when(_is(value, "STRING"), text == "").when(_is(value, "BOOLEAN"), text == "false").when(_is(value, "ARRAY"), text == "[]").when(_is(value, "OBJECT"), text == "{}")
    return F.coalesce(value.isNotNull() & ~_is(value, "VOID") & ~empty.otherwise(F.try_variant_get(value, "$", "double") == 0), F.lit(False))


def shown(value: Column, name: str) -> Column:
    """A member as text, empty where it is missing."""
    return F.coalesce(as_text(_member(value, name)), F.lit(""))


def parse_json(text: Column) -> Column:
    """The report as VARIANT, also from the stretch between the first and the last brace; null where neither is an object.

    An object that names a key twice is none.
    """
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    good = lambda t: let(F.try_parse_json(t), lambda v: F.when(_is(v, "OBJECT") & ~holds(_member(v, "_parse_error")), v))
    return F.coalesce(good(text), good(inner))


def _elements(value: Column, of: Callable[[Column], list[Column]]) -> Column:
    """array<struct<object, text, the columns `of` an element>>; these are null for what is no object."""

    def element(x: Column) -> Column:
        members = [F.when(_is(x, "OBJECT"), c).alias(f"m{i}") for i, c in enumerate(of(x))]
        return F.struct(_is(x, "OBJECT").alias("object"), as_text(x).alias("text"), *members)

    def plain(texts: Column) -> Column:
        nothing = F.try_parse_json(F.lit("null"))
        return F.transform(texts, lambda t: let(nothing, lambda n: F.struct(F.lit(False).alias("object"), t.alias("text"), *(F.when(_is(n, "OBJECT"), c).alias(f"m{i}") for i, c in enumerate(of(n))))))

    text = F.try_variant_get(value, "$", "string")
    of_list = F.transform(F.try_variant_get(value, "$", "array<variant>"), element)
    of_text = plain(F.when(_is(value, "STRING") & (text != ""), F.split(text, "")).when(_is(value, "OBJECT"), F.map_keys(F.from_json(text, "map<string,string>"))))
    return F.coalesce(F.when(_is(value, "ARRAY"), of_list).otherwise(of_text), F.filter(F.transform(F.array(F.try_parse_json(F.lit("null"))), element), lambda x: F.lit(False)))


def parsed(report: Column) -> Column:
    """struct<summary, severity, actions, timeline, chain> of a report, by texts.

    actions: array of texts; timeline: array<struct<object, text, time, description>>; chain: array<struct<object, text,
    technique, tactic, explanation, used, claimed>>, where used says that there is a technique and claimed is the tactic
    that the step files it under, empty for none.
    """

    def step(x: Column) -> list[Column]:
        claimed = F.when(holds(_member(x, "tactic")), strip(as_text(_member(x, "tactic")))).otherwise(F.lit(""))
        return [shown(x, "technique"), shown(x, "tactic"), shown(x, "explanation"), holds(_member(x, "technique")), claimed]

    def named(rows: Column, *names: str) -> Column:
        return F.transform(rows, lambda r: F.struct(r["object"].alias("object"), r["text"].alias("text"), *(r[f"m{i}"].alias(n) for i, n in enumerate(names))))

    def whole(r: Column) -> Column:
        return F.struct(
            shown(r, "summary").alias("summary"), F.lower(strip(shown(r, "severity"))).alias("severity"),
            F.transform(_elements(_member(r, "recommended_actions"), lambda x: []), lambda x: x["text"]).alias("actions"),
            named(_elements(_member(r, "timeline"), lambda x: [shown(x, "time"), shown(x, "description")]), "time", "description").alias("timeline"),
            named(_elements(_member(r, "attack_chain"), step), "technique", "tactic", "explanation", "used", "claimed").alias("chain"),
        )

    return let(report, whole)


def free_text(p: Column) -> Column:
    """All prose of a parsed report."""
    explained = F.transform(F.filter(p["chain"], lambda s: s["object"]), lambda s: s["explanation"])
    return F.concat_ws(" ", p["summary"], p["actions"], F.transform(p["timeline"], lambda x: x["text"]), explained)


def _lookup(technique: Column, at: int) -> Column:
    return F.create_map(*(F.lit(x) for row in CATALOGUE for x in (row[0], row[at])))[technique]


def steps(chain: Column, detected: Column) -> Column:
    """For each step with a technique, in order: technique, the warning (null if none)."""

    def judged(s: Column) -> Column:
        t, actual = s["technique"], _lookup(s["technique"], 2)
        warning = (
            F.when(actual.isNull(), filled(WARNINGS["invented"], t))
            .when(~F.array_contains(detected, t), filled(WARNINGS["unsupported"], t))
            .when((s["claimed"] != "") & ~F.arrays_overlap(tactic_tokens(s["claimed"]), tactic_tokens(actual)), filled(WARNINGS["tactic"], t, s["claimed"], actual))
        )
        return F.struct(t.alias("technique"), warning.alias("warning"))

    return F.transform(F.filter(chain, lambda s: F.coalesce(s["used"], F.lit(False))), judged)


def ungrounded_ips(text: Column, evidence: Column) -> Column:
    """Addresses in the text, sorted, that the lower-cased evidence does not hold as a substring; none without evidence."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(IP), F.lit(0))))
    return F.when(F.coalesce(evidence, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.filter(found, lambda x: F.instr(F.lower(evidence), x) == 0))


def check(reports: DataFrame) -> DataFrame:
    """reports (raw_text, techniques, severity, evidence) with report, parsed, used, supported, warnings, grounded, trust_score.

    A text that is no JSON object is a parse error, with a trust of 0; its report is an object that says so.
    """
    none = F.array().cast("array<string>")
    df = reports.withColumn("_found", parse_json(F.col("raw_text"))).withColumn("parse_error", F.col("_found").isNull())
    failed = F.try_parse_json(F.to_json(F.struct(F.lit(True).alias("_parse_error"), F.col("raw_text").alias("raw"))))
    df = df.withColumn("report", F.coalesce("_found", failed)).drop("_found").withColumn("parsed", parsed(F.col("report")))
    df = df.withColumn("_steps", steps(F.col("parsed.chain"), F.col("techniques")))
    df = df.withColumn("used", F.transform("_steps", lambda s: s["technique"])).withColumn("supported", F.size(F.filter("_steps", lambda s: s["warning"].isNull())))
    of_steps = F.filter(F.transform("_steps", lambda s: s["warning"]), lambda w: w.isNotNull())
    missing = F.transform(F.array_except("techniques", "used"), lambda t: filled(WARNINGS["missing"], t))
    empty = F.when((F.size("techniques") > 0) & (F.size("used") == 0), F.array(F.lit(WARNINGS["empty"]))).otherwise(none)
    ips = F.transform(ungrounded_ips(free_text(F.col("parsed")), F.col("evidence")), lambda ip: filled(WARNINGS["address"], ip))
    claimed, own = F.col("parsed.severity"), F.lower("severity")
    lower = F.coalesce(severity_rank(claimed) < severity_rank(own), F.lit(False))
    downgrade = F.when(lower, F.array(filled(WARNINGS["severity"], claimed, own))).otherwise(none)
    df = df.withColumn("warnings", F.when(F.col("parse_error"), F.array(F.lit(WARNINGS["parse"]))).otherwise(F.concat(of_steps, missing, empty, ips, downgrade)))
    fidelity = F.when(F.size("used") > 0, F.col("supported") / F.size("used")).otherwise(0.0)
    coverage = F.when(F.size("techniques") > 0, F.size(F.array_intersect("used", "techniques")) / F.size(F.array_distinct("techniques"))).otherwise(1.0)
    score = F.when(F.col("parse_error"), 0.0).when((F.size("used") == 0) & (F.size("techniques") == 0), 1.0).otherwise(F.bround(F.least(fidelity, coverage), 2))
    bad = F.exists("warnings", lambda w: w.rlike("^(" + "|".join(DISQUALIFYING) + ")"))
    return df.withColumn("grounded", ~F.col("parse_error") & ~bad).withColumn("trust_score", score).drop("_steps")


def summary(checked: DataFrame) -> DataFrame:
    begins = lambda p: F.sum(F.size(F.filter("warnings", lambda w: w.startswith(p)))).cast("long")
    return checked.agg(F.count(F.lit(1)).alias("reports"), F.avg((~F.col("parse_error")).cast("int")).alias("valid_json"), F.avg(F.col("grounded").cast("int")).alias("grounded_rate"), begins("INVENTED").alias("invented"), begins("UNSUPPORTED").alias("unsupported"), F.avg("trust_score").alias("mean_score"))


def markdown(checked: DataFrame) -> DataFrame:
    """scope, inc_idx, host, markdown of incidents joined with their checked reports."""
    line = lambda key, *c: F.array(filled(REPORT_LINES[key], *c))
    heading = lambda key: F.array(*(F.lit(x) for x in ("", REPORT_LINES[key], "")))
    none, p = F.array().cast("array<string>"), F.col("parsed")
    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    missing = _member(F.col("report"), "summary").isNull()
    happened = F.transform(p["timeline"], lambda x: F.when(x["object"], filled(REPORT_LINES["moment"], x["time"], x["description"])).otherwise(F.concat(F.lit("- "), x["text"])))
    chain = F.transform(p["chain"], lambda s: F.when(s["object"], filled(REPORT_LINES["step"], s["technique"], s["tactic"], s["explanation"])).otherwise(F.concat(F.lit("- "), s["text"])))
    note = F.when((p["severity"] != "") & (p["severity"] != F.lower("severity")), line("note", p["severity"])).otherwise(none)
    campaign = F.when(F.col("campaign_id").isNotNull(), line("campaign", F.col("campaign_id").cast("string"), F.array_join("related_hosts", ", "))).otherwise(none)
    ids = F.concat(F.lit("["), F.array_join(F.col("event_ids").cast("array<string>"), ", "), F.lit("]"))
    lines = F.concat(
        line("title", F.coalesce("host", F.lit("None")), F.upper("severity")), F.array(F.lit("")), line("range", F.col("start").cast("string"), F.col("end").cast("string")),
        line("techniques", F.array_join("techniques", ", ")), line("evidence", ids), campaign, note,
        heading("summary"), F.array(F.when(missing, F.lit("-")).otherwise(p["summary"])), heading("timeline"), happened, heading("chain"), chain, heading("actions"), bullets(p["actions"]),
        heading("validation"), line("verdict", F.when(F.col("grounded"), F.lit("validated against evidence")).otherwise(F.lit("NOT validated"))), line("score", F.col("trust_score").cast("string")), bullets(F.col("warnings")),
    )
    return checked.select("scope", "inc_idx", "host", F.array_join(lines, "\n").alias("markdown"))


def bundle(checked: DataFrame) -> DataFrame:
    """scope, inc_idx, host, json: incident, signals, report as it came and validation of each."""
    incident = F.struct("host", "start", "end", "techniques", "severity", "event_ids", "campaign_id", "related_hosts")
    whole = F.to_json(F.struct(incident.alias("incident"), "signals", "report", F.struct("grounded", "trust_score", "warnings").alias("validation")))
    return checked.select("scope", "inc_idx", "host", whole.alias("json"))
