"""Event schema, technique catalogue, rule literals and defaults."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

EVENT_COLUMNS = (
    "scope", "id", "time", "host", "source", "event_id", "user", "src_ip", "dst_ip", "dst_port", "process", "cmdline",
    "parent", "category", "message", "tool", "url", "http_method", "http_status", "raw",
)
SIGNAL_COLUMNS = ("scope", "rule_ord", "rule", "technique", "technique_name", "severity", "host", "user", "time", "event_ids", "description", "ips", "accounts")


@dataclass(frozen=True)
class Config:
    brute_count: int = 3
    brute_window: timedelta = timedelta(minutes=5)
    spray_count: int = 2
    incident_window: timedelta = timedelta(minutes=15)
    campaign_window: timedelta = timedelta(hours=1)
    infra_least: int = 4
    field_chars: int = 300
    context_events: int = 50
    chunk_chars: int = 900
    chunk_overlap: int = 1
    top_k: int = 3
    least_similarity: float = 0.35
    passage_chars: int = 600


DEFAULT = Config()

#: Fixed values. Unified field -> accepted keys in lower case, the first that is not null counts.
ALIASES = {
    "time": ["time", "timestamp", "@timestamp", "eventtime", "datetime"],
    "host": ["host", "hostname", "computer", "device"],
    "source": ["source", "log_source", "channel", "provider"],
    "event_id": ["event_id", "eventid", "eid"],
    "user": ["user", "username", "targetusername", "subjectusername", "account"],
    "src_ip": ["ip", "src_ip", "client_ip", "source_ip", "ipaddress", "srcip"],
    "dst_ip": ["dest_ip", "dst_ip", "destinationip", "dstip"],
    "dst_port": ["dest_port", "dst_port", "destinationport", "dstport"],
    "process": ["image", "process", "process_name", "processname"],
    "cmdline": ["cmdline", "command", "command_line", "commandline"],
    "parent": ["parent", "parentimage", "parent_image"],
    "category": ["event_type", "category", "alert_type", "eventtype"],
    "message": ["message", "msg", "description", "alert"],
    "tool": ["tool_signature", "tool", "signature", "user_agent"],
}

#: Id, name, tactic, whether a rule covers it.
CATALOGUE = [
    ("T1003.008", "OS Credential Dumping: /etc/passwd and /etc/shadow", "Credential Access", True),
    ("T1027", "Obfuscated Files or Information", "Defense Evasion", True),
    ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltration", True),
    ("T1053.005", "Scheduled Task", "Persistence / Execution", True),
    ("T1059.001", "PowerShell", "Execution", True),
    ("T1059.004", "Command and Scripting Interpreter: Unix Shell", "Execution", True),
    ("T1070.001", "Indicator Removal: Clear Windows Event Logs", "Defense Evasion", True),
    ("T1071", "Application Layer Protocol", "Command and Control", True),
    ("T1078", "Valid Accounts", "Defense Evasion / Persistence / Initial Access", False),
    ("T1105", "Ingress Tool Transfer", "Command and Control", True),
    ("T1110", "Brute Force", "Credential Access", True),
    ("T1190", "Exploit Public-Facing Application", "Initial Access", True),
    ("T1546", "Event Triggered Execution", "Persistence / Privilege Escalation", False),
    ("T1562.001", "Impair Defenses: Disable or Modify Tools", "Defense Evasion", True),
    ("T1595", "Active Scanning", "Reconnaissance", True),
]

SEVERITIES = ("low", "medium", "high", "critical")
#: Accounts that link nothing.
GENERIC_ACCOUNTS = ("root", "system", "localsystem", "administrator", "admin", "-", "network service", "local service", "nt authority\\system")
#: Words that do not tell tactics apart.
TACTIC_STOPWORDS = ("and", "or", "the", "of", "a", "access", "control")
#: A report with a warning that begins so is not grounded.
DISQUALIFYING = ("INVENTED", "UNSUPPORTED", "WRONG TACTIC", "UNGROUNDED IOC", "EMPTY REPORT", "SEVERITY DOWNGRADE")

#: Warnings of the report checks, {} for what they name.
WARNINGS = {
    "parse": "Model produced no valid JSON; output is untrustworthy.",
    "invented": "INVENTED TECHNIQUE: '{}' is not a valid ATT&CK technique.",
    "unsupported": "UNSUPPORTED TECHNIQUE: '{}' is in the report but no detection signal backs it.",
    "tactic": "WRONG TACTIC: '{}' reported as '{}', ATT&CK says '{}'.",
    "missing": "MISSING: '{}' was detected but is not explained in the report.",
    "empty": "EMPTY REPORT: the model explained no technique despite active detections.",
    "address": "UNGROUNDED IOC: IP '{}' appears in the report but not in the evidence.",
    "severity": "SEVERITY DOWNGRADE: model rated this '{}' but detections say '{}'; the detector rating stands.",
}
#: Lines of an incident's Markdown report.
REPORT_LINES = {
    "title": "# Incident — {} [{}]",
    "range": "- **Time range:** {} → {}",
    "techniques": "- **Techniques detected:** {}",
    "evidence": "- **Evidence:** event ids {}",
    "campaign": "- **Campaign #{}** — also affects: {}",
    "note": "- *Model suggested `{}`; the detector rating stands.*",
    "summary": "## Summary",
    "timeline": "## Timeline",
    "moment": "- `{}` {}",
    "chain": "## Attack chain (MITRE ATT&CK)",
    "step": "- **{}** ({}): {}",
    "actions": "## Recommended actions",
    "validation": "## Validation",
    "verdict": "- **Verdict:** {}",
    "score": "- **Technique grounding:** {}",
}

#: Literals of the rules, matched on lower-cased text. Blanks matter.
POWERSHELL = (" -enc", "-encodedcommand", " -e ", " -ec ", "-w hidden", "-windowstyle hidden", "frombase64string", "iex", "invoke-expression")
DOWNLOAD = ("downloadstring", "downloadfile", "downloaddata", "invoke-webrequest", "iwr ", "certutil", "bitsadmin", "urlcache", "wget http", "curl http")
EVASION = ("amsi", "set-mppreference", "add-mppreference", "-exclusionpath", "disablerealtimemonitoring")
REVERSE_SHELL = ("/dev/tcp/", "/dev/udp/", "bash -i", "sh -i", "nc -e", "ncat -e", "mkfifo")
CREDENTIALS = ("/etc/shadow", "/etc/passwd")
EXFILTRATION = ("| nc ", "|nc ", "| ncat", "| curl", "curl -t")
RECON = ("reconnaissance", "nmap", "masscan", "port scan", "connection attempts", "scanning", "scan")
EXPLOIT = ("sql injection", "sqlmap", "web_attack", "access_control", "idor", "authentication_bypass", "jwt", "bypass", "burpsuite")
PAYLOAD = ("exploitation", "metasploit", "meterpreter", "reverse_tcp", "shellcode")
INJECTION = (
    "ignore previous", "ignore all previous", "ignore the above", "disregard the above", "system override", "new instructions",
    "you are now", "as an ai", "this is a false positive", "no action required", "mark as benign",
)


def catalogue(spark: SparkSession) -> DataFrame:
    """15 rows: small enough to broadcast whatever the input."""
    return spark.createDataFrame(CATALOGUE, "technique string, name string, tactic string, covered boolean")


def keys(*columns: str) -> list[str]:
    """Grouping keys, the scope first: rows of one tenant or scenario never meet those of another."""
    return ["scope", *columns]
