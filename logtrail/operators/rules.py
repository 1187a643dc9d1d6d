"""Detection rules. All rules on single events are one scan; rules on groups have a branch each."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrail import schema as S
from logtrail.functions.columns import any_substring, any_word, first_marker, is_external_ip, or_none, truthy, web_text
from logtrail.schema import DEFAULT, SIGNAL_COLUMNS, Config, keys


@dataclass(frozen=True)
class Rule:
    """A rule on single events: condition and description are columns over an event.

    needs: a text of events (see TEXTS) and literals, of which the text holds one, in any case, wherever the condition
    is true; or another column that is true there and quick to tell. All rules' literals of a text are looked for in one
    pass, and only events with some are judged by the conditions. Without needs the condition itself is told of all.
    """

    order: int
    name: str
    technique: str
    technique_name: str
    severity: str
    condition: Callable[[], Column]
    description: Callable[[], Column]
    needs: tuple[str, tuple[str, ...]] | Callable[[], Column] | None = None


@dataclass(frozen=True)
class GroupRule:
    """A rule on many events: events -> signals."""

    order: int
    name: str
    signals: Callable[[DataFrame, Config], DataFrame]


def _cmd() -> Column:
    return F.lower("cmdline")


def _process(condition: Column) -> Column:
    return (F.col("event_id") == 1) & F.col("cmdline").isNotNull() & condition


def _web(words: tuple[str, ...]) -> Column:
    known = F.col("category").isNotNull() | F.col("message").isNotNull() | F.col("tool").isNotNull()
    return known & any_word(web_text(), words)


def _who(text: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(f"{text} — "), or_none(F.col("user")), F.lit("@"), or_none(F.col("host")))


def _what() -> Column:
    return or_none(F.coalesce(truthy(F.col("message")), F.col("category")))


#: Texts in which literals are looked for, before they are put in lower case.
TEXTS: dict[str, Callable[[], Column]] = {
    "cmdline": lambda: F.when(F.col("event_id") == 1, F.col("cmdline")),
    "web": lambda: F.concat_ws(" ", *(truthy(F.col(c)) for c in ("category", "message", "tool", "url"))),
    "blob": lambda: F.concat_ws(" ", *(truthy(F.col(c)) for c in ("cmdline", "message", "url"))),
}


def _worth_judging(rules: list[Rule]) -> Column:
    """Whether an event may fire a rule: for each text one alternation of all literals, whatever their case."""
    literals, out = {}, F.lit(False)
    for r in rules:
        if isinstance(r.needs, tuple):
            literals.setdefault(r.needs[0], {}).update(dict.fromkeys(r.needs[1]))
        else:
            out = out | F.coalesce((r.needs or r.condition)(), F.lit(False))
    for name, some in literals.items():
        out = out | F.coalesce(TEXTS[name]().rlike("(?iu)" + "|".join(map(re.escape, some))), F.lit(False))
    return out


def _web_text(text: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(f"{text} — "), _what(), F.lit(" (from "), or_none(F.col("src_ip")), F.lit(")"))


def _reverse() -> Column:
    return any_substring(_cmd(), S.REVERSE_SHELL)


def _dropped() -> Column:
    return _cmd().contains("chmod +x") & (_cmd().contains("/tmp/") | _cmd().contains("/dev/shm/"))


def _blob() -> Column:
    return F.lower(F.concat_ws(" ", truthy(F.col("cmdline")), truthy(F.col("message")), truthy(F.col("url"))))


def _unusual() -> Column:
    port = F.coalesce(~F.col("dst_port").isin(80, 443), F.lit(True))  # no port is unusual too
    return (F.col("event_id") == 3) & F.col("dst_ip").isNotNull() & port


def _outbound() -> Column:
    return _unusual() & is_external_ip(F.col("dst_ip"))


#: Names, techniques and the texts of descriptions, here and in the rules on groups.
ROW_RULES = [
    Rule(2, "encoded_powershell", "T1059.001", "PowerShell", "high", lambda: _process(_cmd().contains("powershell") & any_substring(_cmd(), S.POWERSHELL)), _who("Obfuscated/suspicious PowerShell execution"), ("cmdline", ("powershell",))),
    Rule(3, "ingress_tool_transfer", "T1105", "Ingress Tool Transfer", "high", lambda: _process(any_substring(_cmd(), S.DOWNLOAD)), _who("External download command"), ("cmdline", S.DOWNLOAD)),
    Rule(4, "defense_evasion", "T1562.001", "Impair Defenses", "high", lambda: _process(any_substring(_cmd(), S.EVASION)), _who("Attempt to bypass/disable a security tool"), ("cmdline", S.EVASION)),
    Rule(5, "suspicious_outbound", "T1071", "Application Layer Protocol (C2)", "medium", _outbound, lambda: F.concat(F.lit("Unusual connection to external IP — "), F.col("dst_ip"), F.lit(":"), or_none(F.col("dst_port")), F.lit(" ("), or_none(F.col("user")), F.lit("@"), or_none(F.col("host")), F.lit(")")), _unusual),
    Rule(6, "scheduled_task_persistence", "T1053.005", "Scheduled Task", "high", lambda: _process(_cmd().contains("schtasks") & _cmd().contains("/create")), _who("Scheduled task created (persistence)"), ("cmdline", ("schtasks",))),
    Rule(7, "scheduled_task_4698", "T1053.005", "Scheduled Task", "high", lambda: F.col("event_id") == 4698, _who("Scheduled task created (EID 4698)")),
    Rule(9, "log_cleared", "T1070.001", "Clear Windows Event Logs", "high", lambda: F.col("event_id") == 1102, lambda: F.concat(F.lit("Security event log cleared (EID 1102) — "), or_none(F.col("host")))),
    Rule(10, "unix_shell_abuse", "T1059.004", "Unix Shell", "high", lambda: _process(_reverse() | _dropped()), lambda: F.concat(F.lit("Unix shell abuse — "), F.when(_reverse(), "reverse shell over the network").otherwise("execution of a dropped payload from /tmp"), F.lit(" ("), or_none(F.col("user")), F.lit("@"), or_none(F.col("host")), F.lit(")")), ("cmdline", (*S.REVERSE_SHELL, "chmod +x"))),
    Rule(11, "credential_dump", "T1003.008", "OS Credential Dumping", "high", lambda: _process(any_substring(_cmd(), S.CREDENTIALS)), _who("Access to credential file (/etc/shadow or /etc/passwd)"), ("cmdline", S.CREDENTIALS)),
    Rule(12, "exfil_alt_protocol", "T1048", "Exfiltration Over Alternative Protocol", "high", lambda: _process(any_substring(_cmd(), S.EXFILTRATION)), _who("Possible data exfiltration over netcat/curl"), ("cmdline", S.EXFILTRATION)),
    Rule(13, "web_reconnaissance", "T1595", "Active Scanning", "medium", lambda: _web(S.RECON), lambda: F.concat(F.lit("Web scanning/recon from "), or_none(F.col("src_ip")), F.lit(" — "), _what()), ("web", S.RECON)),
    Rule(14, "web_exploit", "T1190", "Exploit Public-Facing Application", "high", lambda: _web(S.EXPLOIT), _web_text("Web application exploit attempt"), ("web", S.EXPLOIT)),
    Rule(15, "payload_upload", "T1105", "Ingress Tool Transfer", "high", lambda: _web(S.PAYLOAD), _web_text("Malicious payload/exploit delivery"), ("web", S.PAYLOAD)),
    Rule(16, "llm_prompt_injection", "T1027", "Obfuscated Files or Information", "high", lambda: first_marker(_blob(), S.INJECTION).isNotNull(), lambda: F.concat(F.lit('Log content appears crafted to manipulate an LLM analyst (prompt injection, matched "'), first_marker(_blob(), S.INJECTION), F.lit('") — '), or_none(F.col("user")), F.lit("@"), or_none(F.col("host"))), ("blob", S.INJECTION)),
]


def row_signals(events: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Signals of the rules on single events: one narrow scan; of events worth judging an array of what fired, exploded."""
    rules = ROW_RULES if rules is None else rules
    fired = [
        F.when(r.condition(), F.struct(F.lit(r.order).alias("rule_ord"), F.lit(r.name).alias("rule"), F.lit(r.technique).alias("technique"), F.lit(r.technique_name).alias("technique_name"), F.lit(r.severity).alias("severity"), r.description().alias("description")))
        for r in rules
    ]
    hits = events.filter(_worth_judging(rules)).withColumn("_hit", F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())))
    return hits.select(
        "scope", "_hit.rule_ord", "_hit.rule", "_hit.technique", "_hit.technique_name", "_hit.severity", "host", "user", "time", F.array("id").alias("event_ids"), "_hit.description",
        F.array_distinct(F.array_compact(F.array(truthy(F.col("src_ip")), truthy(F.col("dst_ip"))))).alias("ips"), F.array_compact(F.array(truthy(F.col("user")))).alias("accounts"),
    )


def brute_force(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The first burst of failed logons of each host, user and address: `brute_count` within `brute_window`.

    A group under attack may be a large part of the table, so it is cut by hours (by windows, if longer) for finding bursts, each
    hour with the last window of the one before as context; hours' first bursts are reduced by key, and only events of the burst
    found are collected.
    """
    group, width = ["host", "user", "src_ip"], int(config.brute_window.total_seconds() * 1_000_000)
    failed = events.filter(F.col("event_id") == 4625).select(*keys("id", "time", *group)).withColumn("t", F.unix_micros("time"))
    hour = max(3_600_000_000, width)  # a window never reaches past the next slot
    slots = F.array_distinct(F.array(F.floor(F.col("t") / hour), F.floor((F.col("t") + width) / hour)))
    placed = failed.withColumn("slot", F.explode(slots)).withColumn("own", F.floor(F.col("t") / hour) == F.col("slot"))
    back = F.lag("t", config.brute_count - 1).over(Window.partitionBy(*keys(*group), "slot").orderBy("t", "id"))
    hits = placed.withColumn("back", back).filter(F.col("own") & (F.col("t") - F.col("back") <= width))
    anchors = hits.groupBy(*keys(*group)).agg(F.min("back").alias("anchor"))
    anchors = anchors.withColumnsRenamed({c: f"_{c}" for c in keys(*group)})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys(*group)]
    burst = failed.join(anchors, [*same, F.col("t").between(F.col("anchor"), F.col("anchor") + width)]).select(*keys(*group), "id", "t", "time")
    out = burst.groupBy(*keys(*group)).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]).alias("event_ids"), F.min("time").alias("time"))
    minutes = int(config.brute_window.total_seconds() // 60)
    text = F.concat(F.col("n").cast("string"), F.lit(f" failed logons (EID 4625) within {minutes} min — "), or_none(F.col("user")), F.lit("@"), or_none(F.col("host")), F.lit(", source IP "), or_none(F.col("src_ip")))
    return _grouped(out, 1, "brute_force_logon", text, F.array_compact(F.array(truthy(F.col("src_ip")))))


def kerberos_spray(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Hosts with `spray_count` failed pre-authentications or more, whenever.

    Hosts are counted first, summed before the shuffle, and only events of those with enough are collected: the rule has
    no limit in time, and a signal names all its events.
    """
    some = events.filter(F.col("event_id") == 4771).select(*keys("host", "id", "time", "user", "src_ip"))
    many = some.groupBy(*(F.col(c).alias(f"_{c}") for c in keys("host"))).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= config.spray_count)
    some = some.join(many, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys("host")])
    out = some.groupBy(*keys("host")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("user", F.struct("time", "id")).alias("user"), F.min("time").alias("time"),
        F.transform(F.array_sort(F.collect_list(F.struct("time", "id"))), lambda x: x["id"]).alias("event_ids"), F.array_sort(F.collect_set(truthy(F.col("src_ip")))).alias("_ips"), F.array_sort(F.collect_set(truthy(F.col("user")))).alias("_users"),
    )
    text = F.concat(F.col("n").cast("string"), F.lit(" Kerberos pre-auth failures (EID 4771) — "), or_none(F.col("host")), F.lit(" (password spray)"))
    return _grouped(out, 8, "kerberos_password_spray", text, F.col("_ips"), F.col("_users"))


def _grouped(found: DataFrame, order: int, rule: str, text: Column, ips: Column, accounts: Column | None = None) -> DataFrame:
    accounts = F.array_compact(F.array(truthy(F.col("user")))) if accounts is None else accounts
    return found.select(
        "scope", F.lit(order).alias("rule_ord"), F.lit(rule).alias("rule"), F.lit("T1110").alias("technique"), F.lit("Brute Force").alias("technique_name"), F.lit("high").alias("severity"),
        "host", "user", "time", "event_ids", text.alias("description"), ips.alias("ips"), accounts.alias("accounts"),
    ).select(*SIGNAL_COLUMNS)


GROUP_RULES = [GroupRule(1, "brute_force_logon", brute_force), GroupRule(8, "kerberos_password_spray", kerberos_spray)]


def signals(events: DataFrame, config: Config = DEFAULT, rules: list[Rule | GroupRule] | None = None) -> DataFrame:
    """All rules' signals, or those of the rules given (own ones included). Unsorted: see in_order."""
    rules = [*ROW_RULES, *GROUP_RULES] if rules is None else rules
    out = row_signals(events, [r for r in rules if isinstance(r, Rule)]) if any(isinstance(r, Rule) for r in rules) else None
    for r in rules:
        if isinstance(r, GroupRule):
            found = r.signals(events, config)
            out = found if out is None else out.unionByName(found)
    return out


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy("time", "rule_ord", F.get("event_ids", F.lit(0)))
