"""Reports, passages, retrieval, sources and streams on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtrail.operators import passages, reports, retrieval
from logtrail.sources import logs
from logtrail.streaming import rules as streams


def checked(spark, report, techniques=("T1110",), severity="high", evidence=None):
    text = report if isinstance(report, str) else json.dumps(report)
    df = spark.createDataFrame([(text, list(techniques), severity, evidence)], "raw_text string, techniques array<string>, severity string, evidence string")
    return reports.check(df).first()


def step(technique, tactic=""):
    return {"technique": technique, "tactic": tactic, "explanation": "e"}


@pytest.mark.parametrize(
    "report, grounded, score, begins",
    [
        ({"attack_chain": [step("T1110", "Credential theft")], "severity": "high"}, True, 1.0, []),
        ({"attack_chain": [step("T1110", "Exfiltration")]}, False, 0.0, ["WRONG TACTIC"]),
        ({"attack_chain": [step("T9999"), step("T1110")]}, False, 0.5, ["INVENTED"]),
        ({"attack_chain": [step("T1546"), step("T1110")]}, False, 0.5, ["UNSUPPORTED"]),
        ({"attack_chain": []}, False, 0.0, ["MISSING", "EMPTY"]),
        ({"attack_chain": [step("T1110")], "severity": "Low"}, False, 1.0, ["SEVERITY"]),
        ({"summary": "from 9.9.9.9", "attack_chain": [step("T1110")]}, False, 1.0, ["UNGROUNDED"]),
        ("no json", False, 0.0, ["Model produced"]),
        ("Here: " + json.dumps({"attack_chain": [step("T1110")]}) + " done", True, 1.0, []),
    ],
)
def test_report_checks(spark, report, grounded, score, begins):
    r = checked(spark, report, evidence="events of 1.1.1.1")
    assert (r.grounded, r.trust_score) == (grounded, score) and [w.split()[0].rstrip(":") for w in r.warnings] == [b.split()[0] for b in begins]


def test_trust_score_rounds_half_even(spark):
    chain = [step("T1110")] + [step("T9999")] * 7
    assert checked(spark, {"attack_chain": chain}).trust_score == 0.12
    assert checked(spark, {"attack_chain": []}, techniques=()).trust_score == 1.0


def test_paragraphs_and_chunks(spark):
    text = "intro\n\n# One\nrest of the heading block\n\naaa\n\nbbb\n\n## Two\n\n" + "c" * 950 + "\n\nddd"
    docs = spark.createDataFrame([("x.md", text), ("empty.md", ""), ("null.md", None)], "source string, text string")
    got = passages.chunks(docs).filter("source = 'x.md'").orderBy("at").collect()
    assert [r.content[:3] for r in got] == ["int", "aaa", "ccc", "ccc"] and [r.heading[:3] for r in got] == ["", "One", "Two", "Two"]
    assert got[1].content == "aaa\n\nbbb" and got[3].content.endswith("\n\nddd") and passages.chunks(docs).filter("source <> 'x.md'").count() == 0


def test_embedding_in_batches(spark):
    df = spark.createDataFrame([("a", i, "", f"text {i}") for i in range(12)], "source string, at long, heading string, content string")
    out = passages.embed(df, lambda texts: [[float(len(texts)), float(len(t))] for t in texts]).collect()
    assert len(out) == 12 and all(r.embedding[0] <= 5 and r.embedding[1] >= 6 for r in out)


def test_top_k_brute_force(spark):
    """Small pieces, several tasks and blocks, equal vectors, null rows and empty tables give what all pairs give."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float)
    questions = rng.integers(-2, 3, (17, 4)).astype(float)
    schema = "id long, embedding array<double>"
    p = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(vectors)), (1000, None), (None, [1.0, 0.0, 0.0, 0.0])], schema).repartition(5)
    q = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(questions)), (99, None)], schema).withColumnRenamed("id", "qid")
    by = np.linalg.norm(questions, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
    score = (questions @ vectors.T) / np.where(by == 0, 1e-9, by)
    want = {(i, r + 1, int(j)) for i, row in enumerate(score.round(9)) for r, j in enumerate(np.lexsort((np.arange(300), -row))[:4])}
    near = {(i, round(float(score[i, j]), 3)) for i, _, j in want}
    for options in ({}, {"scores_at_once": 1}, {"scores_at_once": 100, "block_bytes": 200}):
        got = retrieval.top_k(q, p, 4, None, **options).collect()
        # equal similarities may differ in the last bit, so ranks are held against the similarities of all pairs
        assert len(got) == len(want) and {(r.qid, r.similarity) for r in got} == near
        assert all(abs(score[r.qid, r.id] - r.similarity) < 0.001 for r in got)
    assert retrieval.top_k(q.filter("false"), p, 4).count() == retrieval.top_k(q, p.filter("false"), 4).count() == 0
    ids = np.array([[5, 2, 9, 1]])
    assert [x.tolist() for x in retrieval.best(np.array([[1.0, 3.0, 3.0, 1.0]]), ids, 3)] == [[[3.0, 3.0, 1.0]], [[2, 9, 1]]]


def test_top_k(spark):
    p = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.3499, math.sqrt(1 - 0.3499**2)]), (3, [1.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, embedding array<float>")
    got = [(r.rank, r.id, r.similarity) for r in retrieval.top_k(q, p, 3).orderBy("rank").collect()]
    assert got == [(1, 0, 1.0), (2, 3, 1.0)]
    assert [(r.rank, r.id) for r in retrieval.top_k(q, p, 3, block_bytes=1).orderBy("rank").collect()] == [(1, 0), (2, 3)]
    assert retrieval.answered(q, retrieval.top_k(q, p.filter("id = 1"), 3)).first().answer == retrieval.REFUSAL


def test_citations_and_clip(spark):
    row = spark.range(1).select(retrieval.invented_citations(F.lit("see [A.md] and [Real.md] and [made-up.md]"), F.array(F.lit("real.md"))).alias("c"), retrieval.clipped(F.lit("word " * 200), 600).alias("t")).first()
    assert row.c == ["made-up.md"] and row.t.endswith("word …") and len(row.t) <= 602


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"b": {"c": 2}}]))
    assert [r.raw for r in logs.json_array_logs(spark, f"{tmp_path}/a.json").orderBy("ordinal").collect()] == ['{"a":1}', '{"b":{"c":2}}']
    (tmp_path / "b.json").write_text("{}x")
    with pytest.raises(ValueError):
        logs.json_array_logs(spark, f"{tmp_path}/b.json")
    (tmp_path / "n.md").write_text("# h\n\ntext")
    assert logs.markdown_documents(spark, str(tmp_path)).first().source == "n.md"
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):  # noqa: B017
        logs.markdown_documents(spark, f"{tmp_path}/none").count()
    (tmp_path / "s.json").write_text(json.dumps([{"name": "s1", "is_malicious": True, "expected_techniques": ["T1110"], "logs": [{"event_id": 1}, {"event_id": 2}]}]))
    assert logs.scenarios(spark, f"{tmp_path}/s.json").count() == 2
    (tmp_path / "cap.jsonl").write_text('{"Event": {}}\n')
    labels = spark.createDataFrame([("cap.jsonl", ["T1110"])], "file string, expected array<string>")
    assert logs.labeled_captures(spark, [f"{tmp_path}/cap.jsonl"], labels).first().scope == "cap.jsonl"


def test_synthetic_events(spark):
    e = logs.synth_events(spark, 5000, hot_share=0.2)
    assert e.filter("host = 'SRV-TARGET'").count() == 1000 and e.select("time").distinct().count() == 5000


def test_streams_agree_with_batch(spark, tmp_path):
    from logtrail.operators import rules

    e = logs.synth_events(spark, 400, 0.3).select("scope", "id", "time", "host", "user", "src_ip", "event_id", "cmdline")
    late = e.orderBy(F.desc("id")).limit(1).withColumn("time", F.col("time") + F.expr("INTERVAL 3 HOURS")).withColumn("event_id", F.lit(4625).cast("long")).withColumn("host", F.lit("last"))
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, made in (("burst", streams.stream_brute_force), ("spray", lambda s: streams.stream_spray(s.withColumn("event_id", F.when(F.col("event_id") == 4625, 4771).otherwise(0))))):
        source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        mode = "append" if name == "burst" else "update"
        made(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    want = rules.brute_force(e).select("host", "user", F.size("event_ids").cast("long").alias("n")).collect()
    assert spark.table("burst").filter("host <> 'last'").select("host", "user", "n").collect() == want
    assert spark.table("spray").agg(F.max("n")).first()[0] == 300


def test_stream_incidents(spark, tmp_path):
    s = spark.sql("SELECT 'all' AS scope, 'h' AS host, TIMESTAMP '2026-01-01 00:00:00' + make_dt_interval(0, 0, m) AS time, 'T1110' AS technique FROM VALUES (0), (10), (20), (30) t(m)")
    far = spark.sql("SELECT 'all' AS scope, 'z' AS host, TIMESTAMP '2026-01-02 00:00:00' AS time, 'T1110' AS technique")
    s.coalesce(1).write.parquet(f"{tmp_path}/in")
    far.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.stream_incidents(source).writeStream.format("memory").queryName("inc").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [r.n for r in spark.table("inc").filter("host = 'h'").orderBy("start").collect()] == [2, 2]
