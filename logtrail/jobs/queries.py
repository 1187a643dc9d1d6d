"""Registered queries over the test tables; each returns scalars that SQL can give too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtrail import schema as S
from logtrail.functions import columns as C
from logtrail.jobs.flagship import TEST_CONFIG, find_campaigns, find_incidents, flat
from logtrail.operators import campaigns, evidence, incidents, layers, normalize, passages, reports, retrieval, rules
from logtrail.sources.logs import json_array_logs, json_lines_logs, labeled_captures, markdown_documents, scenarios, synth_events, win_records, write_markdown
from logtrail.sources.scratch import scratch, written
from logtrail.sources.files import whole_files
from logtrail.sources.tables import Table
from logtrail.sources.text_files import incident_file, write_files
from logtrail.sources.views import raw_records, raw_table, security_events, windows_records, written_reports
from logtrail.streaming.campaigns import INCIDENT, StreamCampaigns
from logtrail.streaming.rules import LateRows, stream_brute_force, stream_incidents, stream_signals, stream_spray

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def ids(c: str | Column) -> Column:
    return F.array_join((F.col(c) if isinstance(c, str) else c).cast("array<string>"), ",")


# ---- sources and normalisation


@query
def src_json_logs(spark, sf):
    """Records written as JSON arrays of bounded size and as lines, read back by both readers."""
    raw, a, b = raw_records(spark, sf), scratch(spark, "arrays"), scratch(spark, "lines")
    array = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "raw"))), lambda x: x["raw"]), ","), F.lit("]"))
    raw.groupBy(F.floor(F.col("ordinal") / 1000)).agg(array.alias("value")).select("value").repartition(8).write.option("maxRecordsPerFile", 1).text(a)
    raw.select("raw").write.text(b)

    def told(df: DataFrame, kind: str) -> DataFrame:
        e = normalize.normalize(df)
        return e.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("event_id") == 4625).alias("failed"), F.count_distinct("host").alias("hosts")).select(F.lit(kind).alias("kind"), "*")

    return told(json_array_logs(spark, a), "array").unionByName(told(json_lines_logs(spark, b), "lines"))


@query
def src_win_records(spark, sf):
    return win_records(windows_records(spark, sf)).select("ordinal", "event_id", "user", "source", F.col("dest_port"))


def _normalized(spark, sf):
    return normalize.normalize(normalize.valid_records(raw_records(spark, sf)))


@query
def norm_alias_resolve(spark, sf):
    return _normalized(spark, sf).select("ordinal", "host", "user", "src_ip")


@query
def norm_http_block(spark, sf):
    return _normalized(spark, sf).select("ordinal", "url", "http_method", "http_status")


@query
def norm_time_utc(spark, sf):
    return _normalized(spark, sf).select("ordinal", F.unix_seconds("time").alias("seconds"))


@query
def norm_type_affinity(spark, sf):
    return _normalized(spark, sf).select("ordinal", "event_id")


@query
def norm_task_fallback(spark, sf):
    return _normalized(spark, sf).select("ordinal", "cmdline")


@query
def norm_raw_keep(spark, sf):
    return _normalized(spark, sf).join(raw_records(spark, sf).withColumnRenamed("raw", "before"), "ordinal").select("ordinal", (F.col("raw") == F.col("before")).alias("same"))


@query
def norm_drop_untimed(spark, sf):
    """What an ingest keeps, and how many records it drops for want of a time."""
    found = normalize.ingest_counted(spark, raw_records(spark, sf))
    return found.events.agg(F.count(F.lit(1)).alias("kept"), F.min(F.unix_seconds("time")).alias("first"), F.lit(found.untimed).cast("long").alias("dropped"), F.lit(found.read).cast("long").alias("read"))


@query
def norm_assign_id(spark, sf):
    return normalize.with_ids(normalize.drop_untimed(_normalized(spark, sf))).select("ordinal", "id")


@query
def sink_events(spark, sf):
    """The events written by date, twice, the second time in place of the first, and read back, counted by host."""
    table, events = Table(spark, scratch(spark, "events")), normalize.ingest(spark, raw_records(spark, sf))
    normalize.write_events(events.withColumn("host", F.lit("before")), table.path)
    normalize.write_events(events, table.path)
    return table.read().groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


# ---- predicates and functions


@query
def pred_process_rows(spark, sf):
    return security_events(spark, sf).filter("event_id = 1 AND cmdline IS NOT NULL").select("id", "cmdline")


@query
def fn_web_text(spark, sf):
    """Web rows only: pred_web_rows."""
    web = security_events(spark, sf).filter("category IS NOT NULL OR message IS NOT NULL OR tool IS NOT NULL")
    return web.select("id", C.web_text().alias("text"))


@query
def fn_substring_any(spark, sf):
    return security_events(spark, sf).select("id", C.any_substring(F.lower("cmdline"), S.DOWNLOAD).alias("hit"))


@query
def fn_word_any(spark, sf):
    return security_events(spark, sf).select("id", C.first_word(C.web_text(), S.RECON).alias("word"), C.any_word(C.web_text(), S.EXPLOIT).alias("exploit"))


@query
def fn_first_marker(spark, sf):
    return security_events(spark, sf).select("id", C.first_marker(F.lower("cmdline"), S.INJECTION).alias("marker"))


@query
def fn_is_external_ip(spark, sf):
    i = F.col("event_id")
    ip = F.when(i % 50 == 0, "01.2.3.4").when(i % 51 == 0, "-").when(i % 52 == 0, "256.1.1.1").otherwise(F.concat_ws(".", (i * 7 % 256).cast("string"), (i % 256).cast("string"), F.lit("2"), (F.col("user_id") % 256).cast("string")))
    return raw_table(spark, sf, "events").select(i.alias("id"), C.is_external_ip(ip).alias("external"))


@query
def fn_technique_lookup(spark, sf):
    """Known techniques by name and tactic, others as unknown, beside the number of signals of each."""
    t = F.when(F.col("event_id") % 3 == 0, "T1110").when(F.col("event_id") % 3 == 1, "T9999").otherwise("T1027")
    found = raw_table(spark, sf, "events").groupBy(t.alias("technique")).agg(F.count(F.lit(1)).alias("n"))
    named = found.join(F.broadcast(S.catalogue(spark)), "technique", "left")
    return named.select("technique", "n", F.coalesce("name", F.concat("technique", F.lit(": (unknown technique)"))).alias("name"), "tactic")


# ---- rules


def _signals(spark, sf, *orders: int) -> DataFrame:
    some = [r for r in [*rules.ROW_RULES, *rules.GROUP_RULES] if not orders or r.order in orders]
    return rules.signals(security_events(spark, sf), S.DEFAULT, some)


def _told(df: DataFrame) -> DataFrame:
    return df.select("rule_ord", "rule", "technique", "severity", "host", "user", C.iso(F.col("time")).alias("at"), ids("event_ids").alias("event_ids"), "description")


RULE_NAMES = {
    1: "brute_force", 2: "encoded_powershell", 3: "ingress_transfer", 4: "defense_evasion", 5: "suspicious_outbound", 6: "scheduled_task", 7: "scheduled_task_4698", 8: "kerberos_spray",
    9: "log_cleared", 10: "unix_shell", 11: "credential_dump", 12: "exfiltration", 13: "web_recon", 14: "web_exploit", 15: "payload_upload", 16: "prompt_injection",
}
for _order, _name in RULE_NAMES.items():
    QUERIES[f"rule_{_name}"] = lambda spark, sf, order=_order: _told(_signals(spark, sf, order))


@query
def rule_all(spark, sf):
    return _told(rules.in_order(_signals(spark, sf)))


@query
def rule_custom(spark, sf):
    """A rule of the user's own beside a group rule of theirs."""
    own = rules.Rule(17, "git_use", "T1105", "Git", "low", lambda: F.col("cmdline").startswith("git"), lambda: F.concat(F.lit("git on "), "host"))
    return rules.signals(security_events(spark, sf), S.DEFAULT, [own]).groupBy("rule", "host").agg(F.count(F.lit(1)).alias("n"), F.min("description").alias("description"))


# ---- incidents and campaigns


def _incidents(spark, sf) -> DataFrame:
    return written(find_incidents(security_events(spark, sf), TEST_CONFIG), "incidents")


@query
def inc_assign(spark, sf):
    return incidents.assign(_signals(spark, sf)).select("host", "rule_ord", ids("event_ids").alias("event_ids"), C.iso(F.col("time")).alias("at"), C.iso(F.col("anchor")).alias("anchor"))


@query
def inc_build(spark, sf):
    return flat(find_incidents(security_events(spark, sf), TEST_CONFIG)).drop("inc_idx")


@query
def inc_rank(spark, sf):
    return find_incidents(security_events(spark, sf), TEST_CONFIG).select("inc_idx", "host", C.iso(F.col("start")).alias("start_time"))


@query
def camp_entities(spark, sf):
    return campaigns.entities(_incidents(spark, sf)).drop("scope")


@query
def camp_infra_filter(spark, sf):
    """With a lower bar, so that some address is infrastructure: in 4 incidents and in more than half of them."""
    found = _incidents(spark, sf)
    kept = campaigns.without_infrastructure(campaigns.entities(found), found)
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))


@query
def camp_link_pairs(spark, sf):
    found = _incidents(spark, sf)
    e = campaigns.without_infrastructure(campaigns.entities(found), found)
    return campaigns.pairs(e, found, TEST_CONFIG.campaign_window).select("a", "b")


@query
def camp_near_in_time(spark, sf):
    """Pairs by account alone within three minutes."""
    from datetime import timedelta

    found = _incidents(spark, sf)
    return campaigns.pairs(campaigns.entities(found).filter("kind = 'user'"), found, timedelta(minutes=3)).select("a", "b")


@query
def camp_components(spark, sf):
    found = _incidents(spark, sf)
    e = campaigns.without_infrastructure(campaigns.entities(found), found)
    return campaigns.components(campaigns.edges(e, found, TEST_CONFIG.campaign_window)).select("inc_idx", "root")


@query
def inc_pipeline(spark, sf):
    """The flagship: camp_number, camp_related and camp_defaults."""
    return flat(find_campaigns(security_events(spark, sf), TEST_CONFIG))


@query
def camp_related(spark, sf):
    """Peers of each incident in a campaign."""
    found = find_campaigns(security_events(spark, sf), TEST_CONFIG)
    return found.select("inc_idx", F.size("campaign_peers").alias("peers"), F.array_join(F.transform("campaign_peers", lambda p: p["host"]), ",").alias("hosts"))


@query
def scope_isolation(spark, sf):
    """Events of two tenants in one table: incidents are those of each tenant alone."""
    events = security_events(spark, sf).withColumn("scope", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    return find_incidents(events, TEST_CONFIG).select("scope", "host", C.iso(F.col("start")).alias("start_time"), ids("event_ids").alias("event_ids"))


# ---- evidence


@query
def ev_clip(spark, sf):
    return raw_table(spark, sf, "documents").select("doc_id", C.clip(F.col("text"), 300).alias("clipped"))


@query
def ev_line(spark, sf):
    return security_events(spark, sf).select("id", evidence.event_line().alias("line"))


@query
def ev_top_events(spark, sf):
    from dataclasses import replace

    top = evidence.top_events(_incidents(spark, sf), security_events(spark, sf), replace(S.DEFAULT, context_events=3))
    return top.select("inc_idx", "rn", "n", "line")


@query
def ev_package(spark, sf):
    found = written(find_campaigns(security_events(spark, sf), TEST_CONFIG), "campaigns")
    return evidence.package(found, security_events(spark, sf)).select("inc_idx", "evidence")


# ---- reports


def _checked(spark, sf) -> DataFrame:
    found = written(find_campaigns(security_events(spark, sf), TEST_CONFIG), "campaigns")
    text = evidence.package(found, security_events(spark, sf))
    return reports.check(written_reports(found).join(text, ["scope", "inc_idx"]))


@query
def chk_report(spark, sf):
    """All checks: parsing, steps, tactics, missing, empty, addresses, severity."""
    return _checked(spark, sf).select("inc_idx", "parse_error", "grounded", F.array_join("warnings", "\n").alias("warnings"))


@query
def chk_steps(spark, sf):
    return _checked(spark, sf).filter("NOT parse_error").select("inc_idx", F.array_join("used", ",").alias("used"), "supported")


@query
def chk_trust_score(spark, sf):
    return _checked(spark, sf).select("inc_idx", "trust_score")


@query
def chk_summary(spark, sf):
    return reports.summary(_checked(spark, sf)).withColumns({c: F.round(c, 6) for c in ("valid_json", "grounded_rate", "mean_score")})


@query
def chk_tactic_tokens(spark, sf):
    return raw_table(spark, sf, "documents").select("doc_id", F.size(F.array_distinct(C.tactic_tokens(F.col("text")))).alias("tokens"))


@query
def chk_ungrounded_ip(spark, sf):
    """Addresses in documents that the text of another form, here their first half, does not hold."""
    docs = raw_table(spark, sf, "documents")
    half = F.substring(F.col("text"), F.lit(1), (F.length("text") / 2).cast("int"))
    return docs.select("doc_id", F.array_join(reports.ungrounded_ips(F.col("text"), half), ",").alias("ips")).filter("ips <> ''")


def _files(spark, texts: DataFrame, suffix: str) -> DataFrame:
    """inc_idx, text of incidents' texts written as files, twice, the second time in place of the first, and read back."""
    folder, named = scratch(spark, "files"), texts.withColumn("name", incident_file(suffix))
    named = written(named, "texts")
    write_files(named.withColumn("text", F.lit("before")), folder)
    write_files(named, folder)
    return whole_files(spark, folder, suffix).select(F.regexp_extract("source", r"-(\d+)\.\w+$", 1).cast("int").alias("inc_idx"), "text")


@query
def sink_incident_markdown(spark, sf):
    """A Markdown file for each incident."""
    texts = reports.markdown(_checked(spark, sf)).withColumnRenamed("markdown", "text")
    return _files(spark, texts, ".md").withColumnRenamed("text", "markdown")


@query
def sink_evidence_bundle(spark, sf):
    """A JSON file for each incident."""
    j = lambda p: F.get_json_object("text", p)
    found = _files(spark, reports.bundle(_checked(spark, sf)).withColumnRenamed("json", "text"), ".json")
    return found.select("inc_idx", j("$.incident.host").alias("host"), j("$.validation.grounded").alias("grounded"), F.json_array_length(j("$.signals")).alias("signals"))


# ---- passages and retrieval


def _docs(spark, sf) -> DataFrame:
    """The documents with a heading line put before every third; one newline separates paragraphs."""
    d = raw_table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("source"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Part "), "lang", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"))


@query
def doc_paragraphs(spark, sf):
    found = _docs(spark, sf).select("source", F.posexplode(passages.paragraphs(F.col("text"), "\n")).alias("at", "p"))
    return found.select("source", "at", "p.heading", F.md5("p.content").alias("content"))


@query
def doc_chunks(spark, sf):
    """Passages with the text that would be embedded."""
    found = passages.chunks(_docs(spark, sf), S.DEFAULT, "\n")
    return found.select("source", "at", "heading", F.md5("content").alias("content"))


@query
def doc_embed_text(spark, sf):
    found = _docs(spark, sf).select("source", F.posexplode(passages.paragraphs(F.col("text"), "\n")).alias("at", "p")).select("source", "at", "p.heading", "p.content")
    return found.select("source", "at", F.md5(passages.embed_text()).alias("text"))


@query
def doc_stats(spark, sf):
    return passages.stats(passages.chunks(_docs(spark, sf), S.DEFAULT, "\n"))


@query
def sink_passages(spark, sf):
    """Passages written and read back, counted by document."""
    path = scratch(spark, "passages")
    passages.write(passages.chunks(_docs(spark, sf), S.DEFAULT, "\n"), path)
    return Table(spark, path).read().groupBy("source").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("content")).alias("chars"))


@query
def src_documents(spark, sf):
    """Documents written as files named *.md, one each, and read back."""
    path = scratch(spark, "markdown-files")
    write_markdown(raw_table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), "text"), path)
    return markdown_documents(spark, path).select("source", F.md5("text").alias("text"))


@query
def norm_validate_batch(spark, sf):
    """Which of the raw records are objects, where some are cut short or arrays."""
    i = F.col("ordinal")
    raw = F.when(i % 26 == 5, F.concat(F.lit("["), "raw", F.lit("]"))).when(i % 26 == 18, F.substring("raw", 1, 20)).otherwise(F.col("raw"))
    return raw_records(spark, sf).select("ordinal", normalize.is_record(raw).alias("record"))


@query
def doc_embed_batches(spark, sf):
    """Every paragraph embedded in batches by a function given: here the length of its text."""
    found = _docs(spark, sf).select("source", F.posexplode(passages.paragraphs(F.col("text"), "\n")).alias("at", "p")).select("source", "at", "p.heading", "p.content")
    return passages.embed(found, lambda texts: [[float(len(t))] for t in texts]).select("source", "at", F.col("embedding")[0].cast("bigint").alias("first"))


@query
def st_kerberos_spray(spark, sf):
    """Failed pre-authentications streamed from files; the last count of each host that the stream gave."""
    source, out, state = (scratch(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    events = security_events(spark, sf).select("scope", "id", "time", "host", "event_id")
    events.write.parquet(source)
    counts = stream_spray(spark.readStream.schema(events.schema).parquet(source))
    keep = lambda df, batch: df.select("host", "n").write.parquet(f"{out}/{batch}")
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("host string, n long").parquet(f"{out}/*").groupBy("host").agg(F.max("n").alias("n"))


def _vectors(spark, sf) -> DataFrame:
    return raw_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _questions(spark, sf) -> DataFrame:
    return _vectors(spark, sf).filter("id % 25 = 0").select(F.col("id").alias("qid"), "embedding")


@query
def ret_cosine(spark, sf):
    """Each vector with the one of the id after it."""
    v = _vectors(spark, sf)
    after = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return v.join(after, "id").select("id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query
def ret_topk(spark, sf):
    return retrieval.top_k(_questions(spark, sf), _vectors(spark, sf)).select("qid", "rank", "id", "similarity")


@query
def ret_refusal(spark, sf):
    """Questions with no passage near but themselves are refused: all vectors are searched, a question's own left out."""
    q = _questions(spark, sf)
    hits = retrieval.top_k(q, _vectors(spark, sf), 2, 0.5)
    return retrieval.answered(q, hits.filter("id <> qid"))


@query
def ret_runbook(spark, sf):
    return retrieval.runbook_queries(_incidents(spark, sf)).select("inc_idx", "query")


@query
def ret_format(spark, sf):
    """Every document clipped as a passage under its label."""
    d = raw_table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.lit(1).alias("rank"), F.col("source"), F.col("lang").alias("heading"), F.col("text").alias("content"))
    return retrieval.formatted(d).select("qid", F.md5("block").alias("block"))


@query
def ret_invented_citations(spark, sf):
    d = raw_table(spark, sf, "documents")
    answer = F.concat(F.lit("see [a b.md], ["), "source", F.lit(".md] and [zz-"), "lang", F.lit(".md] or ["), "source", F.lit(".MD]"))
    return d.select("doc_id", F.array_join(retrieval.invented_citations(answer, F.array(F.concat("source", F.lit(".md")))), ",").alias("invented"))


@query
def ret_technique_match(spark, sf):
    """Nearest techniques without a floor; vectors of the catalogue's rank stand for its texts."""
    known = S.catalogue(spark).select((F.dense_rank().over(Window.orderBy("technique")) - 1).alias("id"), "technique")
    v = _vectors(spark, sf).join(F.broadcast(known), "id")
    near = retrieval.top_k(_questions(spark, sf), v.select("id", "embedding"), 2, None)
    return near.join(F.broadcast(known), "id").select("qid", "rank", "technique", "similarity")


# ---- layers, evaluation, views


@query
def agg_technique_layer(spark, sf):
    return layers.technique_layer(_signals(spark, sf))


@query
def agg_coverage_layer(spark, sf):
    """The catalogue's coverage beside what was detected."""
    seen = layers.technique_layer(_signals(spark, sf)).select("technique", "score")
    return layers.coverage_layer(spark).join(seen, "technique", "left").select("technique", "name", "covered", "color", "comment", F.coalesce("score", F.lit(0)).alias("score"))


@query
def sink_layer_json(spark, sf):
    found = layers.layer_json(layers.technique_layer(_signals(spark, sf)), "detections")
    j = lambda p: F.get_json_object("layer", p)
    return found.select(j("$.name").alias("name"), j("$.versions.layer").alias("version"), F.json_array_length(j("$.techniques")).alias("techniques"), j("$.techniques[0].comment").alias("comment"))


def _confusion(spark, sf) -> DataFrame:
    """Hosts as scopes; what each is expected to show follows its number."""
    events = security_events(spark, sf).withColumn("scope", F.col("host"))
    found = rules.signals(events)
    n = F.substring("scope", 5, 2).cast("int")
    expected = F.when(n % 2 == 0, F.array(F.lit("T1110"), F.lit("T1546"))).when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("T1071"), F.lit("T1048")))
    labels = events.select("scope").distinct().select("scope", expected.alias("expected_techniques"), (n % 3 != 0).alias("is_malicious"))
    return layers.confusion(found, labels)


@query
def eval_confusion(spark, sf):
    return _confusion(spark, sf)


@query
def eval_micro_metrics(spark, sf):
    return layers.metrics(_confusion(spark, sf)).select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query
def eval_recall_by_file(spark, sf):
    return layers.recall_by_file(_confusion(spark, sf)).select("scope", "found", "expected", F.round("recall", 6).alias("recall"))


@query
def eval_gate(spark, sf):
    return layers.gate(layers.metrics(_confusion(spark, sf)), 0.2, 0.99).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "passed")


@query
def view_raw_events(spark, sf):
    found = layers.raw_events(security_events(spark, sf))
    return found.withColumn("time", C.iso(F.col("time")))


@query
def agg_event_mix(spark, sf):
    return layers.event_mix(security_events(spark, sf)).select("source", "event_id", "n")


# ---- streaming


@query
def st_row_rules(spark, sf):
    """Raw records streamed from files to signals, written by the stream and read again."""
    source, out, state = (scratch(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    raw_records(spark, sf).write.parquet(source)
    stream = stream_signals(spark.readStream.schema("ordinal long, raw string").parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("rule", "host", ids("event_ids").alias("event_ids"))


def _replay(spark, name, made, *parts: DataFrame) -> tuple[DataFrame, int]:
    """What a stream gives of the parts, each appended after a run and before the next from its checkpoint; and its late rows."""
    source, out, state = (scratch(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    with LateRows(spark) as late:
        for k, part in enumerate(parts):
            part.write.mode("append").parquet(source)
            stream = made(spark.readStream.schema(parts[0].schema).parquet(source))
            run = stream.writeStream.queryName(f"{name}-{k}").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            run.awaitTermination()
            dropped = late.count(run)
    return spark.read.schema(stream.schema).parquet(out), dropped


def _halves(spark, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows up to their mean time, and the others with one far later, at which all windows are over."""
    middle = F.timestamp_micros(F.lit(rows.agg(F.avg(F.unix_micros("time")).cast("long")).first()[0]))
    last = rows.limit(1).withColumns({"time": F.lit("2100-01-01 00:00:00").cast("timestamp"), "host": F.lit("last")})
    return rows.filter(F.col("time") <= middle), rows.filter(F.col("time") > middle).unionByName(last)


@query
def st_brute_force(spark, sf):
    """The failed logons streamed in two runs, the second from the first one's checkpoint."""
    failed = security_events(spark, sf).filter("event_id = 4625").select("scope", "id", "time", "host", "user", "src_ip", "event_id")
    found, _ = _replay(spark, "burst", stream_brute_force, *_halves(spark, failed))
    return found.select("host", "user", "src_ip", "n", ids("event_ids").alias("event_ids"))


@query
def st_incidents(spark, sf):
    """All signals streamed in two runs, the second from the first one's checkpoint."""
    signals = written(_signals(spark, sf), "signals").select("scope", "host", "time", "rule_ord", "event_ids", "technique")
    found, _ = _replay(spark, "incidents", stream_incidents, *_halves(spark, signals))
    return found.select("host", C.iso(F.col("start")).alias("start_time"), C.iso(F.col("end")).alias("end_time"), "n", F.array_join("techniques", ",").alias("techniques"))


@query
def st_late(spark, sf):
    """How many failed logons are dropped as late when all of them come a second time."""
    failed = security_events(spark, sf).filter("event_id = 4625").select("scope", "id", "time", "host", "user", "src_ip", "event_id")
    _, dropped = _replay(spark, "late", stream_brute_force, failed, failed)
    return raw_table(spark, sf, "events").agg(F.lit(dropped).cast("long").alias("late_rows"), F.count(F.lit(1)).alias("events"))


@query
def src_scenarios(spark, sf):
    """Labelled scenarios of 500 records, an array of one in each file, read back and normalised each in a scope of its own."""
    path, k = scratch(spark, "scenarios"), F.floor(F.col("ordinal") / 500)
    logs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "raw"))), lambda x: x["raw"]), ", ")
    case = F.format_string('[{"name": "case-%d", "description": "", "is_malicious": %s, "expected_techniques": ["T1110"],\n "logs": [%s]}]', "k", (F.col("k") % 2 == 0).cast("string"), "logs")
    raw_records(spark, sf).groupBy(k.alias("k")).agg(logs.alias("logs")).select(case.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = scenarios(spark, path)
    told = normalize.normalize(found).groupBy("scope").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("event_id") == 4625).alias("failed"))
    labels = found.groupBy("scope").agg(F.first("is_malicious").alias("is_malicious"), F.first(F.array_join("expected_techniques", ",")).alias("expected"))
    return told.join(labels, "scope")


@query
def src_labeled_captures(spark, sf):
    """Capture files of rendered records, read with the labels of each."""
    folder, name = scratch(spark, "captures"), F.concat(F.lit("cap-"), F.floor(F.col("ordinal") / 1000).cast("string"), F.lit(".jsonl"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "raw"))), lambda x: x["raw"]), "\n")
    captures = windows_records(spark, sf).groupBy(name.alias("source")).agg(lines.alias("text"))
    write_markdown(captures, folder)
    labels = captures.select(F.col("source").alias("file"), F.array(F.lit("T1110"), F.lit("T1071")).alias("expected"))
    found = win_records(labeled_captures(spark, [folder], labels))
    return found.groupBy("scope").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("event_id") == 4625).alias("failed"), F.first(F.array_join("expected", ",")).alias("expected"))


@query
def src_synth_events(spark, sf):
    """As many synthetic events as the table has, counted by host and kind."""
    made = synth_events(spark, raw_table(spark, sf, "events").count())
    return made.groupBy("host", "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("users"), F.min("id").alias("first"), F.max(F.unix_seconds("time")).alias("last"))


@query
def st_campaigns(spark, sf):
    """Incidents as a stream in two runs, their campaigns merged batch by batch; each with its campaign's first member."""
    columns = [c.split()[0] for c in INCIDENT.split(", ")]
    found = _incidents(spark, sf).select(*columns)
    source, checkpoint = scratch(spark, "closed"), scratch(spark, "closed-state")
    state = StreamCampaigns(spark, scratch(spark, "campaigns"), TEST_CONFIG)
    middle = F.timestamp_micros(F.lit(found.agg(F.avg(F.unix_micros("start")).cast("long")).first()[0]))
    for part in (found.filter(F.col("start") <= middle), found.filter(F.col("start") > middle)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(found.schema).parquet(source)
        stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    tagged = state.campaigns()
    first = tagged.filter("root IS NOT NULL").groupBy("scope", "root").agg(F.min(F.struct("start", "host")).alias("f"), F.count(F.lit(1)).alias("members"))
    out = tagged.join(first, ["scope", "root"], "left")
    return out.select("host", C.iso(F.col("start")).alias("start_time"), F.concat(C.iso(F.col("f.start")), F.lit(" "), "f.host").alias("first"), F.coalesce("members", F.lit(0)).cast("long").alias("members"))
