"""Report checks where any field may be missing or of another type, against a plain reading of the same JSON."""

import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from logtrail.operators import reports
from logtrail.schema import CATALOGUE, TACTIC_STOPWORDS, WARNINGS

KINDS = [None, "T1110", "", 5, 0, 2.5, True, False, [], ["a", 1], {}, {"technique": "T1110"}]
DETECTED = ["T1110", "T1027"]
TACTICS = {row[0]: row[2] for row in CATALOGUE}


def told(x):
    return "None" if x is None else str(x) if isinstance(x, (str, bool)) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def parts(x):
    return list(x) if isinstance(x, (list, str)) else sorted(x) if isinstance(x, dict) else []


def words(x):
    return {w for w in re.findall("[a-z]+", x.lower()) if w not in TACTIC_STOPWORDS}


def expected(report, evidence):
    used, warnings, good = [], [], 0
    chain = [s for s in parts(report.get("attack_chain")) if isinstance(s, dict)]
    for s in chain:
        if not s.get("technique"):
            continue
        t, claimed = told(s["technique"]), told(s["tactic"]).strip() if s.get("tactic") else ""
        used.append(t)
        if t not in TACTICS:
            warnings.append(WARNINGS["invented"].format(t))
        elif t not in DETECTED:
            warnings.append(WARNINGS["unsupported"].format(t))
        elif claimed and not words(claimed) & words(TACTICS[t]):
            warnings.append(WARNINGS["tactic"].format(t, claimed, TACTICS[t]))
        else:
            good += 1
    warnings += [WARNINGS["missing"].format(t) for t in DETECTED if t not in used]
    warnings += [] if used else [WARNINGS["empty"]]
    prose = " ".join([told(report.get("summary", "")), *map(told, parts(report.get("recommended_actions"))), *map(told, parts(report.get("timeline"))), *(told(s.get("explanation", "")) for s in chain)])
    warnings += [WARNINGS["address"].format(ip) for ip in sorted(set(re.findall(r"\b\d{1,3}(?:\.\d{1,3}){3}\b", prose))) if ip not in evidence]
    if told(report.get("severity", "")).strip().lower() in ("low", "medium"):
        warnings.append(WARNINGS["severity"].format(told(report["severity"]).strip().lower(), "high"))
    score = round(min(good / len(used), len(set(used) & set(DETECTED)) / 2), 2) if used else 0.0
    return used, good, warnings, score


def checked(spark, texts):
    rows = [(i, t, DETECTED, "high", "seen from 1.1.1.1") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, raw_text string, techniques array<string>, severity string, evidence string")
    return {r.i: r for r in reports.check(df).drop("report").collect()}


def many_reports():
    right = {"technique": "T1110", "tactic": "Credential Access", "explanation": "from 1.1.1.1 and 2.2.2.2"}
    out = [{}, {"attack_chain": [right]}, {"attack_chain": ["T1027 in words", right]}]
    out += [{"attack_chain": [x, right]} for x in KINDS]
    out += [{"attack_chain": [{**right, field: x}]} for field in right for x in KINDS]
    out += [{"attack_chain": [{k: v for k, v in right.items() if k != field}]} for field in right]
    out += [{field: x, "attack_chain": [right]} for field in ("summary", "severity", "timeline", "recommended_actions") for x in KINDS]
    out += [{"attack_chain": x} for x in KINDS]
    out += [{"attack_chain": [{"technique": t, "tactic": c}]} for t, c in itertools.product(["T1110", "T1027", "T1546", "T9"], [" ", "Evasion", ["Credential"], 7])]
    out += [{"severity": s} for s in (" LOW ", "Medium", "high", "critical", "no")]
    out += [{"summary": "3.3.3.3", "timeline": [{"time": "t", "description": "4.4.4.4"}, "5.5.5.5", 6, None], "recommended_actions": ["7.7.7.7", {"a": "8.8.8.8"}]}, {"recommended_actions": "9.9.9.9"}]
    return out


def test_every_type_in_every_place(spark):
    some = many_reports()
    got = checked(spark, [json.dumps(r) for r in some])
    for i, report in enumerate(some):
        used, good, warnings, score = expected(report, "seen from 1.1.1.1")
        row = got[i]
        assert (row.used, row.supported, row.warnings, row.trust_score) == (used, good, warnings, score), report
        assert not row.parse_error


@pytest.mark.parametrize("text", [None, "", "no json", "[]", "5", "null", '"T1110"', '{"_parse_error": true}', "{", '{"a": }', "} {", '{"a": 1, "a": 2}'])
def test_no_report(spark, text):
    row = checked(spark, [text])[0]
    assert row.parse_error and not row.grounded and row.trust_score == 0 and row.warnings == [WARNINGS["parse"]] and row.used == []


def test_report_within_prose(spark):
    text = 'Sure! {"attack_chain": [{"technique": "T1110"}, {"technique": "T1027"}]} Anything else?'
    row = checked(spark, [text])[0]
    assert row.grounded and row.trust_score == 1.0 and row.used == DETECTED


def test_markdown_of_mistyped_reports(spark):
    report = {"summary": 5, "timeline": [{"time": 1}, None, "x"], "attack_chain": ["text", {"technique": ["T1"]}], "recommended_actions": "ab"}
    rows = [("all", 1, "H", json.dumps(report), ["T1110"], "high", "", [1, 2], None, [], "s", "e")]
    schema = "scope string, inc_idx int, host string, raw_text string, techniques array<string>, severity string, evidence string, event_ids array<long>, campaign_id int, related_hosts array<string>, start string, end string"
    text = reports.markdown(reports.check(spark.createDataFrame(rows, schema))).first().markdown.split("\n")
    assert text[6:19] == ["## Summary", "", "5", "", "## Timeline", "", "- `1` ", "- None", "- x", "", "## Attack chain (MITRE ATT&CK)", "", "- text"]
    assert text[19] == '- **["T1"]** (): ' and text[23:25] == ["- a", "- b"]


def test_bundle_keeps_the_report(spark):
    rows = [("all", 1, "H", '{"odd": [1, {"k": null}]}', ["T1110"], "high", "", [1], None, [], "s", "e", [])]
    schema = "scope string, inc_idx int, host string, raw_text string, techniques array<string>, severity string, evidence string, event_ids array<long>, campaign_id int, related_hosts array<string>, start string, end string, signals array<string>"
    out = json.loads(reports.bundle(reports.check(spark.createDataFrame(rows, schema))).select(F.col("json")).first().json)
    assert out["report"] == {"odd": [1, {"k": None}]} and out["validation"]["trust_score"] == 0.0
