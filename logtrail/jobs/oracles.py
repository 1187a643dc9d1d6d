"""The queries in DuckDB SQL, over the same tables. Common parts are named expressions put before each."""

from __future__ import annotations

from logtrail import schema as S
from logtrail.functions.columns import PRIVATE, PUBLIC_AGAIN
from logtrail.sources.views import EVENTS_SQL

text = lambda s: "'" + s.replace("'", "''") + "'"
any_of = lambda column, words: "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"
word = lambda column, words: f"regexp_matches({column}, {text(chr(92) + 'b(?:' + '|'.join(words) + ')' + chr(92) + 'b')})"
nn = lambda c: f"COALESCE(CAST({c} AS VARCHAR), 'None')"

WHO = f"{nn('usr')} || '@' || {nn('host')}"
WHAT = "COALESCE(NULLIF(message, ''), category, 'None')"
CMD, WEB = "lower(cmdline)", "lower(concat_ws(' ', NULLIF(category, ''), NULLIF(message, ''), NULLIF(tool, ''), NULLIF(url, '')))"
PROCESS = "event_id = 1 AND cmdline IS NOT NULL AND "
WEB_ROW = "(category IS NOT NULL OR message IS NOT NULL OR tool IS NOT NULL) AND "
BLOB = "lower(concat_ws(' ', NULLIF(cmdline, ''), NULLIF(message, ''), NULLIF(url, '')))"
MARKER = "COALESCE(" + ", ".join(f"CASE WHEN contains({BLOB}, {text(m)}) THEN {text(m)} END" for m in S.INJECTION) + ")"


def _block(number: str, block: str) -> str:
    import ipaddress

    net = ipaddress.ip_network(block)
    return f"{number} BETWEEN {int(net[0])} AND {int(net[-1])}"


def external(ip: str) -> str:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    number = " + ".join(f"TRY_CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    inside = " OR ".join(_block(f"({number})", b) for b in PRIVATE)
    again = " OR ".join(_block(f"({number})", b) for b in PUBLIC_AGAIN)
    return f"COALESCE(regexp_full_match({ip}, '{octet}\\.{octet}\\.{octet}\\.{octet}') AND (NOT ({inside}) OR {again}), false)"


EV = f"ev AS (SELECT * RENAME (\"user\" AS usr) FROM ({EVENTS_SQL.format(u='"user"', text='VARCHAR', events='events')}))"
#: order, rule, technique, technique name, severity, condition, description
ROWS = [
    (2, "encoded_powershell", "T1059.001", "PowerShell", "high", PROCESS + f"contains({CMD}, 'powershell') AND {any_of(CMD, S.POWERSHELL)}", f"'Obfuscated/suspicious PowerShell execution — ' || {WHO}"),
    (3, "ingress_tool_transfer", "T1105", "Ingress Tool Transfer", "high", PROCESS + any_of(CMD, S.DOWNLOAD), f"'External download command — ' || {WHO}"),
    (4, "defense_evasion", "T1562.001", "Impair Defenses", "high", PROCESS + any_of(CMD, S.EVASION), f"'Attempt to bypass/disable a security tool — ' || {WHO}"),
    (5, "suspicious_outbound", "T1071", "Application Layer Protocol (C2)", "medium", f"event_id = 3 AND dst_ip IS NOT NULL AND {external('dst_ip')} AND (dst_port IS NULL OR dst_port NOT IN (80, 443))", f"'Unusual connection to external IP — ' || dst_ip || ':' || {nn('dst_port')} || ' (' || {WHO} || ')'"),
    (6, "scheduled_task_persistence", "T1053.005", "Scheduled Task", "high", PROCESS + f"contains({CMD}, 'schtasks') AND contains({CMD}, '/create')", f"'Scheduled task created (persistence) — ' || {WHO}"),
    (7, "scheduled_task_4698", "T1053.005", "Scheduled Task", "high", "event_id = 4698", f"'Scheduled task created (EID 4698) — ' || {WHO}"),
    (9, "log_cleared", "T1070.001", "Clear Windows Event Logs", "high", "event_id = 1102", f"'Security event log cleared (EID 1102) — ' || {nn('host')}"),
    (10, "unix_shell_abuse", "T1059.004", "Unix Shell", "high", PROCESS + f"({any_of(CMD, S.REVERSE_SHELL)} OR (contains({CMD}, 'chmod +x') AND (contains({CMD}, '/tmp/') OR contains({CMD}, '/dev/shm/'))))", f"'Unix shell abuse — ' || CASE WHEN {any_of(CMD, S.REVERSE_SHELL)} THEN 'reverse shell over the network' ELSE 'execution of a dropped payload from /tmp' END || ' (' || {WHO} || ')'"),
    (11, "credential_dump", "T1003.008", "OS Credential Dumping", "high", PROCESS + any_of(CMD, S.CREDENTIALS), f"'Access to credential file (/etc/shadow or /etc/passwd) — ' || {WHO}"),
    (12, "exfil_alt_protocol", "T1048", "Exfiltration Over Alternative Protocol", "high", PROCESS + any_of(CMD, S.EXFILTRATION), f"'Possible data exfiltration over netcat/curl — ' || {WHO}"),
    (13, "web_reconnaissance", "T1595", "Active Scanning", "medium", WEB_ROW + word(WEB, S.RECON), f"'Web scanning/recon from ' || {nn('src_ip')} || ' — ' || {WHAT}"),
    (14, "web_exploit", "T1190", "Exploit Public-Facing Application", "high", WEB_ROW + word(WEB, S.EXPLOIT), f"'Web application exploit attempt — ' || {WHAT} || ' (from ' || {nn('src_ip')} || ')'"),
    (15, "payload_upload", "T1105", "Ingress Tool Transfer", "high", WEB_ROW + word(WEB, S.PAYLOAD), f"'Malicious payload/exploit delivery — ' || {WHAT} || ' (from ' || {nn('src_ip')} || ')'"),
    (16, "llm_prompt_injection", "T1027", "Obfuscated Files or Information", "high", f"{MARKER} IS NOT NULL", f"'Log content appears crafted to manipulate an LLM analyst (prompt injection, matched \"' || {MARKER} || '\") — ' || {WHO}"),
]


def row_sql(r: tuple, table: str = "ev") -> str:
    order, rule, technique, name, severity, condition, description = r
    return f"SELECT {order} AS rule_ord, '{rule}' AS rule, '{technique}' AS technique, '{name}' AS technique_name, '{severity}' AS severity, host, usr, time, id AS first_id, CAST(id AS VARCHAR) AS event_ids, {description} AS description FROM {table} WHERE {condition}"


BRUTE = f"""
SELECT 1 AS rule_ord, 'brute_force_logon' AS rule, 'T1110' AS technique, 'Brute Force' AS technique_name, 'high' AS severity, host, usr, MIN(time) AS time, arg_min(id, (time, id)) AS first_id,
  string_agg(CAST(id AS VARCHAR), ',' ORDER BY time, id) AS event_ids, COUNT(*) || ' failed logons (EID 4625) within 5 min — ' || {WHO} || ', source IP ' || {nn('src_ip')} AS description
FROM (SELECT *, MIN(CASE WHEN time - t2 <= INTERVAL '5' MINUTE THEN t2 END) OVER (PARTITION BY host, usr, src_ip) AS anchor
      FROM (SELECT *, LAG(time, 2) OVER (PARTITION BY host, usr, src_ip ORDER BY time, id) AS t2 FROM ev WHERE event_id = 4625))
WHERE time BETWEEN anchor AND anchor + INTERVAL '5' MINUTE GROUP BY host, usr, src_ip"""
SPRAY = f"""
SELECT 8 AS rule_ord, 'kerberos_password_spray' AS rule, 'T1110' AS technique, 'Brute Force' AS technique_name, 'high' AS severity, host, arg_min(usr, (time, id)) AS usr, MIN(time) AS time, arg_min(id, (time, id)) AS first_id,
  string_agg(CAST(id AS VARCHAR), ',' ORDER BY time, id) AS event_ids, COUNT(*) || ' Kerberos pre-auth failures (EID 4771) — ' || {nn('host')} || ' (password spray)' AS description
FROM ev WHERE event_id = 4771 GROUP BY host HAVING COUNT(*) >= 2"""
SIG = "sig AS (" + " UNION ALL ".join([*(row_sql(r) for r in ROWS), BRUTE, SPRAY]) + ")"
ANCHORS = """
g(host, anchor) AS (SELECT host, MIN(time) FROM sig GROUP BY host UNION ALL
  SELECT n.host, n.t FROM (SELECT g.host, (SELECT MIN(s.time) FROM sig s WHERE s.host = g.host AND s.time > g.anchor + INTERVAL '15' MINUTE) AS t FROM g) n WHERE n.t IS NOT NULL),
asg AS (SELECT s.*, (SELECT MAX(g.anchor) FROM g WHERE g.host = s.host AND g.anchor <= s.time) AS anchor FROM sig s)"""
BUILT = """
ord AS (SELECT *, row_number() OVER (PARTITION BY host, anchor ORDER BY time, rule_ord, first_id) AS rn FROM asg),
techs AS (SELECT host, anchor, technique, MIN(rn) AS rn FROM ord GROUP BY ALL),
tech AS (SELECT host, anchor, string_agg(technique, ',' ORDER BY rn) AS techniques, list(technique ORDER BY rn) AS tlist FROM techs GROUP BY ALL),
eids AS (SELECT DISTINCT host, anchor, CAST(UNNEST(string_split(event_ids, ',')) AS BIGINT) AS id FROM asg),
eid AS (SELECT host, anchor, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS event_ids FROM eids GROUP BY ALL),
bld AS (SELECT o.host, o.anchor, MIN(o.time) AS st, MAX(o.time) AS en, MAX(CASE o.severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS sev, MIN(CASE WHEN rn = 1 THEN rule_ord END) AS o1, MIN(CASE WHEN rn = 1 THEN first_id END) AS i1 FROM ord o GROUP BY ALL),
inc AS (SELECT b.*, t.techniques, t.tlist, e.event_ids, row_number() OVER (ORDER BY sev DESC, hf, b.host, st) - 1 AS inc_idx
  FROM (SELECT *, MIN((st, o1, i1)) OVER (PARTITION BY host) AS hf FROM bld) b JOIN tech t USING (host, anchor) JOIN eid e USING (host, anchor))"""
ISO = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
SEVERITY = "CASE sev WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
GENERIC = ", ".join(text(x) for x in S.GENERIC_ACCOUNTS)
ENTITIES = f"""
sigev AS (SELECT DISTINCT i.inc_idx, e.usr, e.src_ip, e.dst_ip FROM inc i JOIN eids x ON x.host = i.host AND x.anchor = i.anchor JOIN ev e ON e.id = x.id),
ent AS (SELECT DISTINCT inc_idx, kind, entity FROM (
  SELECT inc_idx, 'ip' AS kind, src_ip AS entity FROM sigev UNION ALL SELECT inc_idx, 'ip', dst_ip FROM sigev
  UNION ALL SELECT inc_idx, 'user', lower(trim(usr)) FROM sigev WHERE lower(trim(usr)) NOT IN ({GENERIC})) WHERE COALESCE(entity, '') <> ''),
kept AS (SELECT * FROM ent e WHERE NOT (kind = 'ip' AND (SELECT COUNT(*) FROM ent f WHERE f.kind = 'ip' AND f.entity = e.entity) >= 4
  AND 2 * (SELECT COUNT(*) FROM ent f WHERE f.kind = 'ip' AND f.entity = e.entity) > (SELECT COUNT(*) FROM inc)))"""


def pairs_sql(table: str, minutes: int) -> str:
    return f"""SELECT DISTINCT x.inc_idx AS a, y.inc_idx AS b FROM {table} e JOIN {table} f ON e.kind = f.kind AND e.entity = f.entity AND e.inc_idx < f.inc_idx
  JOIN inc x ON x.inc_idx = e.inc_idx JOIN inc y ON y.inc_idx = f.inc_idx
  WHERE x.host <> y.host AND x.st <= y.en + INTERVAL '{minutes}' MINUTE AND y.st <= x.en + INTERVAL '{minutes}' MINUTE"""


CAMPAIGNS = f"""
prs AS ({pairs_sql('kept', 10)}),
bth AS (SELECT a, b FROM prs UNION SELECT b, a FROM prs),
lab(x, y) AS (SELECT a, a FROM bth UNION SELECT b, y FROM lab JOIN bth ON bth.a = lab.x),
root AS (SELECT x AS inc_idx, MIN(y) AS root FROM lab GROUP BY x),
camp AS (SELECT inc_idx, root, dense_rank() OVER (ORDER BY root) AS campaign_id FROM root),
mem AS (SELECT c.campaign_id, i.* FROM camp c JOIN inc i USING (inc_idx)),
rel AS (SELECT m.inc_idx, string_agg(CASE WHEN p.host <> m.host THEN p.host END, ',' ORDER BY p.st, p.inc_idx) AS related_hosts,
    COUNT(*) FILTER (WHERE p.inc_idx <> m.inc_idx) AS peers, string_agg(CASE WHEN p.inc_idx <> m.inc_idx THEN p.host END, ',' ORDER BY p.st, p.inc_idx) AS hosts
  FROM mem m JOIN mem p USING (campaign_id) GROUP BY m.inc_idx)"""


def sql(body: str, *parts: str) -> str:
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body


INC = (EV, SIG, ANCHORS, BUILT)
CAMP = (*INC, ENTITIES, CAMPAIGNS)
TOLD = f'SELECT rule_ord, rule, technique, severity, host, usr AS "user", {ISO("time")} AS at, event_ids, description FROM '
FLAT = f"SELECT host, {ISO('st')} AS start_time, {ISO('en')} AS end_time, {SEVERITY} AS severity, techniques, event_ids FROM inc"

#: The raw records of views.raw_records, as their values.
RAW = """
raw AS (SELECT event_id AS ordinal, event_id % 3 AS k, event_id AS i, 'HOST' || (user_id % 10) AS host, 'user' || (user_id % 5) AS usr, event_type,
  CASE WHEN event_id % 97 = 3 THEN NULL ELSE epoch(TIMESTAMP '2024-01-01 00:00:00') + 5 * event_id END AS seconds,
  CASE WHEN event_type = 'error' THEN 4625 WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 3 END AS code FROM events)"""
WIN = """
win AS (SELECT event_id AS ordinal, event_id AS i, CASE WHEN event_type = 'error' THEN 4625 WHEN event_type = 'click' THEN 1 ELSE 3 END AS event_id, user_id FROM events WHERE event_id % 31 <> 0)"""
CATALOGUE = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"({text(a)}, {text(b)}, {text(c)}, {str(d).lower()})" for a, b, c, d in S.CATALOGUE) + ") t(technique, name, tactic, covered))"
WEB_ROWS = "FROM ev WHERE category IS NOT NULL OR message IS NOT NULL OR tool IS NOT NULL"

CONFUSION = """
lab AS (SELECT DISTINCT host AS scope, CAST(substr(host, 5) AS INT) AS n FROM ev),
exp AS (SELECT scope, n, CASE WHEN n % 2 = 0 THEN ['T1110', 'T1546'] WHEN n % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['T1071', 'T1048'] END AS expected, n % 3 <> 0 AS is_malicious FROM lab),
pred AS (SELECT host AS scope, list(DISTINCT technique) AS predicted FROM sig GROUP BY host),
conf AS (SELECT e.scope, is_malicious, CAST(len(list_intersect(COALESCE(predicted, []), expected)) AS INT) AS tp, CAST(len(COALESCE(predicted, [])) - len(list_intersect(COALESCE(predicted, []), expected)) AS INT) AS fp,
  CAST(len(expected) - len(list_intersect(COALESCE(predicted, []), expected)) AS INT) AS fn, len(COALESCE(predicted, [])) > 0 AS alarm FROM exp e LEFT JOIN pred p USING (scope)),
met AS (SELECT SUM(tp) AS tp, SUM(fp) AS fp, SUM(fn) AS fn, AVG(CAST(alarm = is_malicious AS INT)) AS accuracy FROM conf)"""
PREC, REC = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"

DOC = """
d AS (SELECT CAST(doc_id AS VARCHAR) AS source, CASE WHEN doc_id % 3 = 0 THEN '# Part ' || lang || chr(10) || text ELSE text END AS text FROM documents),
blk AS (SELECT source, UNNEST(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
blk2 AS (SELECT source, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM blk),
blk3 AS (SELECT source, i, x, last_value(CASE WHEN x LIKE '#%' THEN regexp_replace(regexp_replace(x, '^#+', ''), '^\\s+|\\s+$', '', 'g') END IGNORE NULLS) OVER (PARTITION BY source ORDER BY i) AS heading FROM blk2 WHERE x <> ''),
par AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS INT) AS "at", COALESCE(heading, '') AS heading, x AS content FROM blk3 WHERE x NOT LIKE '#%')"""
VEC = """
v AS (SELECT vec_id AS id, embedding AS e FROM embeddings), q AS (SELECT id AS qid, e AS qe FROM v WHERE id % 25 = 0)"""
COSINE = "list_dot_product(CAST(qe AS DOUBLE[]), CAST(e AS DOUBLE[])) / (sqrt(list_dot_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))))"

EVENT_LINE = f"SELECT id, '  - ' || concat_ws(' | ', 'id=' || id, {ISO('time')}, CASE WHEN COALESCE(dst_ip, '') <> '' THEN 'dst_ip=' || dst_ip || ':' || {nn('dst_port')} END, CASE WHEN event_id <> 0 THEN 'EID=' || event_id END, 'user=' || NULLIF(usr, ''), 'src_ip=' || NULLIF(src_ip, ''), 'cmdline=' || NULLIF(cmdline, ''), 'category=' || NULLIF(category, ''), 'tool=' || NULLIF(tool, ''), 'url=' || NULLIF(url, ''), 'message=' || NULLIF(message, '')) AS line FROM ev"
CHUNKS = """
st(source, k, s, chars, cut) AS (
  SELECT source, 0, 0, length(content), false FROM par WHERE "at" = 0
  UNION ALL
  SELECT p.source, p."at", CASE WHEN p.heading <> q.heading THEN p."at" WHEN chars + length(p.content) > 900 THEN q."at" ELSE s END,
    CASE WHEN p.heading <> q.heading THEN length(p.content) WHEN chars + length(p.content) > 900 THEN length(q.content) + length(p.content) ELSE chars + length(p.content) END,
    p.heading <> q.heading OR chars + length(p.content) > 900
  FROM st JOIN par q ON q.source = st.source AND q."at" = st.k JOIN par p ON p.source = st.source AND p."at" = st.k + 1),
ends AS (SELECT a.source, a.s, a.k, row_number() OVER (PARTITION BY a.source ORDER BY a.k) - 1 AS n FROM st a LEFT JOIN st b ON b.source = a.source AND b.k = a.k + 1 WHERE COALESCE(b.cut, true)),
chunk AS (SELECT e.source, e.n AS "at", max_by(p.heading, p."at") AS heading, string_agg(p.content, chr(10) || chr(10) ORDER BY p."at") AS content
  FROM ends e JOIN par p ON p.source = e.source AND p."at" BETWEEN e.s AND e.k GROUP BY e.source, e.n)"""
#: The evidence of each incident: its first events, signals, techniques and campaign.
PACKAGE = f"""
lin AS ({EVENT_LINE}),
evl AS (SELECT inc_idx, string_agg(line, chr(10) ORDER BY rn) FILTER (rn <= 50) AS lines, MAX(n) AS n FROM (
  SELECT i.inc_idx, l.line, row_number() OVER (PARTITION BY i.inc_idx ORDER BY e.time, e.id) AS rn, COUNT(*) OVER (PARTITION BY i.inc_idx) AS n
  FROM inc i JOIN eids x ON x.host = i.host AND x.anchor = i.anchor JOIN ev e ON e.id = x.id JOIN lin l ON l.id = x.id) GROUP BY inc_idx),
sgl AS (SELECT i.inc_idx, string_agg('  - ' || technique || ' ' || technique_name || ': ' || description || ' (event ids: [' || replace(o.event_ids, ',', ', ') || '])', chr(10) ORDER BY o.rn) AS lines
  FROM inc i JOIN ord o ON o.host = i.host AND o.anchor = i.anchor GROUP BY i.inc_idx),
rfs AS (SELECT i.inc_idx, string_agg('  - ' || t.technique || ': ' || c.name || ' [' || c.tactic || ']', chr(10) ORDER BY t.rn) AS lines
  FROM inc i JOIN techs t ON t.host = i.host AND t.anchor = i.anchor JOIN cat c ON c.technique = t.technique GROUP BY i.inc_idx),
prl AS (SELECT m.inc_idx, string_agg('  - ' || p.host || ' at ' || {ISO("p.st")} || ': ' || replace(p.techniques, ',', ', '), chr(10) ORDER BY p.st, p.inc_idx) AS lines
  FROM mem m JOIN mem p USING (campaign_id) WHERE p.inc_idx <> m.inc_idx GROUP BY m.inc_idx),
pkg AS (SELECT i.inc_idx, 'HOST: ' || host || chr(10) || 'TIME RANGE: ' || {ISO("st")} || ' - ' || {ISO("en")} || chr(10) || chr(10) || '<evidence>' || chr(10) || 'EVENTS (raw logs — each has an id):' || chr(10) || evl.lines || chr(10)
  || CASE WHEN n > 50 THEN '  (… ' || (n - 50) || ' further event(s) omitted to stay within budget)' || chr(10) ELSE '' END
  || chr(10) || 'TRIGGERED DETECTION RULES (signals):' || chr(10) || sgl.lines || chr(10) || '</evidence>' || chr(10) || chr(10) || 'RELEVANT TECHNIQUES (trusted reference):' || chr(10) || rfs.lines || chr(10)
  || COALESCE(chr(10) || 'SAME CAMPAIGN — RELATED ACTIVITY ON OTHER HOSTS:' || chr(10) || prl.lines || chr(10) || '  These hosts share a pivot address or account: treat them as one campaign.' || chr(10), '')
  || chr(10) || 'REQUIRED: one attack_chain entry for each of: ' || replace(techniques, ',', ', ') || '.' AS evidence
  FROM inc i JOIN evl USING (inc_idx) JOIN sgl USING (inc_idx) JOIN rfs USING (inc_idx) LEFT JOIN prl USING (inc_idx))"""
TACTIC_WORDS = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z]+'), lambda x: x <> '' AND x NOT IN (" + ", ".join(text(w) for w in S.TACTIC_STOPWORDS) + "))"
#: The reports of views.written_reports as what counts in each: form, steps with a technique, addresses, severity; then the checks.
REPORTS = f"""
rep AS (SELECT inc_idx, tlist, {SEVERITY} AS severity, inc_idx % 7 = 5 AS parse_error, CASE WHEN inc_idx % 13 IN (1, 3, 5, 7, 9) THEN inc_idx % 13 ELSE 0 END AS form, inc_idx % 6 AS kind, tlist[1] AS f FROM inc),
chn AS (SELECT *, CASE WHEN parse_error OR form IN (5, 7) THEN [] WHEN form = 1 THEN [f || '|'] WHEN form = 3 THEN ['1110|', f || '|'] WHEN form = 9 THEN [f || '|["Exfiltration"]']
    WHEN kind = 0 THEN list_transform(tlist, lambda x: x || '|') WHEN kind = 1 THEN ['T9999|', f || '|'] WHEN kind = 2 THEN ['T1546|', f || '|Exfiltration of things'] WHEN kind = 3 THEN [] ELSE [f || '|'] END AS steps,
  CASE form WHEN 0 THEN list_concat(CASE WHEN inc_idx % 5 = 0 THEN ['9.9.9.9'] ELSE [] END, CASE WHEN kind <> 3 THEN ['185.220.101.1'] ELSE [] END) WHEN 5 THEN ['8.8.8.8', '9.9.9.9'] ELSE [] END AS ips,
  CASE form WHEN 0 THEN CASE WHEN inc_idx % 4 = 0 THEN 'low' ELSE severity END WHEN 5 THEN '3' WHEN 7 THEN 'none' WHEN 9 THEN 'low' ELSE '' END AS claimed FROM rep),
stp AS (SELECT inc_idx, tlist, split_part(s, '|', 1) AS t, split_part(s, '|', 2) AS said, k FROM (SELECT inc_idx, tlist, UNNEST(steps) AS s, generate_subscripts(steps, 1) AS k FROM chn)),
jdg AS (SELECT inc_idx, k, t, CASE WHEN c.technique IS NULL THEN 'INVENTED TECHNIQUE: ''' || t || ''' is not a valid ATT&CK technique.'
    WHEN NOT list_contains(tlist, t) THEN 'UNSUPPORTED TECHNIQUE: ''' || t || ''' is in the report but no detection signal backs it.'
    WHEN said <> '' AND NOT list_has_any({TACTIC_WORDS("said")}, {TACTIC_WORDS("c.tactic")}) THEN 'WRONG TACTIC: ''' || t || ''' reported as ''' || said || ''', ATT&CK says ''' || c.tactic || '''.' END AS warning
  FROM stp LEFT JOIN cat c ON c.technique = t),
usd AS (SELECT inc_idx, list(t ORDER BY k) AS used, list(warning ORDER BY k) FILTER (warning IS NOT NULL) AS warned, COUNT(*) FILTER (warning IS NULL) AS supported FROM jdg GROUP BY inc_idx),
chk AS (SELECT c.*, COALESCE(used, []) AS used, COALESCE(supported, 0) AS supported, CASE WHEN parse_error THEN ['Model produced no valid JSON; output is untrustworthy.'] ELSE list_concat(COALESCE(warned, []),
    list_transform(list_filter(tlist, lambda x: NOT list_contains(COALESCE(used, []), x)), lambda x: 'MISSING: ''' || x || ''' was detected but is not explained in the report.'),
    CASE WHEN used IS NULL THEN ['EMPTY REPORT: the model explained no technique despite active detections.'] ELSE [] END,
    list_transform(list_filter(list_sort(ips), lambda x: NOT contains(lower(evidence), x)), lambda x: 'UNGROUNDED IOC: IP ''' || x || ''' appears in the report but not in the evidence.'),
    CASE WHEN claimed = 'low' AND severity IN ('medium', 'high') OR claimed = 'medium' AND severity = 'high' THEN ['SEVERITY DOWNGRADE: model rated this ''' || claimed || ''' but detections say ''' || severity || '''; the detector rating stands.'] ELSE [] END) END AS warnings
  FROM chn c JOIN pkg USING (inc_idx) LEFT JOIN usd USING (inc_idx)),
vrd AS (SELECT *, NOT parse_error AND len(list_filter(warnings, lambda x: regexp_matches(x, '^(INVENTED|UNSUPPORTED|WRONG TACTIC|UNGROUNDED IOC|EMPTY REPORT|SEVERITY DOWNGRADE)'))) = 0 AS grounded,
  CASE WHEN parse_error OR len(used) = 0 THEN 0.0 ELSE round_even(least(supported / len(used), len(list_intersect(used, tlist)) / len(tlist)), 2) END AS trust_score FROM chk)"""
CHECKED = (PACKAGE, REPORTS)
#: The Markdown lines of the same reports.
MARKDOWN = f"""
md AS (SELECT v.*, i.host, i.st, i.en, i.techniques, i.event_ids, c.campaign_id, COALESCE(r.related_hosts, '') AS related_hosts,
  CASE WHEN parse_error OR form IN (1, 7, 9) THEN '-' WHEN form = 3 THEN 'None' WHEN form = 5 THEN '{{"a":"9.9.9.9"}}' WHEN v.inc_idx % 5 = 0 THEN 'Traffic to 9.9.9.9 seen' ELSE 'Seen' END AS summary,
  CASE WHEN parse_error THEN '' ELSE claimed END AS told,
  CASE WHEN form = 5 AND NOT parse_error THEN ['- `t` 8.8.8.8', '- 4'] ELSE [] END AS timeline,
  CASE WHEN parse_error OR form = 7 THEN [] WHEN form = 1 THEN ['- they came in', '- **' || f || '** (): '] WHEN form = 3 THEN ['- **1110** (): ', '- **' || f || '** (): ', '- **** (Execution): ']
    WHEN form = 5 THEN ['- technique'] WHEN form = 9 THEN ['- None', '- []', '- 5', '- **** (): ', '- **None** (): ', '- **' || f || '** (["Exfiltration"]): 1.5']
    ELSE list_transform(steps, lambda x: '- **' || split_part(x, '|', 1) || '** (' || split_part(x, '|', 2) || '): as seen from 185.220.101.1') END AS chain,
  CASE WHEN parse_error THEN [] WHEN form = 0 THEN ['- block it'] WHEN form = 5 THEN list_transform(regexp_extract_all('block 7.7.7.7', '.'), lambda x: '- ' || x) ELSE [] END AS actions
  FROM vrd v JOIN inc i USING (inc_idx) LEFT JOIN camp c USING (inc_idx) LEFT JOIN rel r USING (inc_idx)),
mds AS (SELECT inc_idx, host, array_to_string(list_concat(['# Incident — ' || host || ' [' || upper(severity) || ']', '', '- **Time range:** ' || {ISO("st")} || ' → ' || {ISO("en")}, '- **Techniques detected:** ' || replace(techniques, ',', ', '),
    '- **Evidence:** event ids [' || replace(event_ids, ',', ', ') || ']'], CASE WHEN campaign_id IS NOT NULL THEN ['- **Campaign #' || campaign_id || '** — also affects: ' || replace(related_hosts, ',', ', ')] ELSE [] END,
    CASE WHEN told <> '' AND told <> severity THEN ['- *Model suggested `' || told || '`; the detector rating stands.*'] ELSE [] END, ['', '## Summary', '', summary, '', '## Timeline', ''], timeline, ['', '## Attack chain (MITRE ATT&CK)', ''], chain,
    ['', '## Recommended actions', ''], actions, ['', '## Validation', '', '- **Verdict:** ' || CASE WHEN grounded THEN 'validated against evidence' ELSE 'NOT validated' END, '- **Technique grounding:** ' || CAST(CAST(trust_score AS DOUBLE) AS VARCHAR)],
    list_transform(warnings, lambda x: '- ' || x)), chr(10)) AS markdown FROM md)"""
#: Two tenants in one table: hosts of different tenants are different hosts.
TENANTS = EV.replace("SELECT * RENAME", "SELECT * REPLACE ((CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END) || ':' || host AS host) RENAME")
FIRST_WORDS = "regexp_replace(substr(text, 1, 600), ' [^ ]*$', '')"
UNGROUNDED = r"list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b'), lambda x: NOT contains(lower(substr(text, 1, CAST(floor(length(text) / 2) AS INT))), x))))"

ORACLE_SQL = {
    "src_json_logs": sql("SELECT kind, COUNT(*) AS records, COUNT(*) FILTER (code = 4625) AS failed, COUNT(DISTINCT host) AS hosts FROM raw CROSS JOIN (VALUES ('array'), ('lines')) t(kind) GROUP BY kind", RAW),
    "scope_isolation": sql(f"SELECT split_part(host, ':', 1) AS scope, split_part(host, ':', 2) AS host, {ISO('st')} AS start_time, event_ids FROM inc", TENANTS, SIG, ANCHORS, BUILT),
    "sink_layer_json": sql("SELECT 'detections' AS name, '4.5' AS version, CAST(COUNT(*) AS INT) AS techniques, arg_min(comment, technique) AS comment FROM (SELECT technique, COUNT(*) || ' signal(s) on: ' || string_agg(DISTINCT host, ', ' ORDER BY host) AS comment FROM sig GROUP BY technique)", EV, SIG),
    "ret_format": f"SELECT doc_id AS qid, md5('[' || source || ' — ' || lang || ']' || chr(10) || CASE WHEN length(text) > 600 THEN CASE WHEN contains(substr(text, 1, 600), ' ') THEN {FIRST_WORDS} ELSE substr(text, 1, 600) END || ' …' ELSE text END) AS block FROM documents",
    "chk_ungrounded_ip": f"SELECT doc_id, array_to_string(ips, ',') AS ips FROM (SELECT doc_id, {UNGROUNDED} AS ips FROM documents WHERE length(text) > 1) WHERE len(ips) > 0",
    "ev_package": sql("SELECT CAST(inc_idx AS INT) AS inc_idx, evidence FROM pkg", *CAMP, CATALOGUE, PACKAGE),
    "chk_report": sql("SELECT CAST(inc_idx AS INT) AS inc_idx, parse_error, grounded, array_to_string(warnings, chr(10)) AS warnings FROM vrd", *CAMP, CATALOGUE, *CHECKED),
    "chk_steps": sql("SELECT CAST(inc_idx AS INT) AS inc_idx, array_to_string(used, ',') AS used, CAST(supported AS INT) AS supported FROM vrd WHERE NOT parse_error", *CAMP, CATALOGUE, *CHECKED),
    "chk_trust_score": sql("SELECT CAST(inc_idx AS INT) AS inc_idx, CAST(trust_score AS DOUBLE) AS trust_score FROM vrd", *CAMP, CATALOGUE, *CHECKED),
    "chk_summary": sql("SELECT COUNT(*) AS reports, round(AVG(CAST(NOT parse_error AS INT)), 6) AS valid_json, round(AVG(CAST(grounded AS INT)), 6) AS grounded_rate, CAST(SUM(len(list_filter(warnings, lambda x: starts_with(x, 'INVENTED')))) AS BIGINT) AS invented, CAST(SUM(len(list_filter(warnings, lambda x: starts_with(x, 'UNSUPPORTED')))) AS BIGINT) AS unsupported, round(AVG(CAST(trust_score AS DOUBLE)), 6) AS mean_score FROM vrd", *CAMP, CATALOGUE, *CHECKED),
    "sink_incident_markdown": sql("SELECT CAST(inc_idx AS INT) AS inc_idx, markdown FROM mds", *CAMP, CATALOGUE, *CHECKED, MARKDOWN),
    "sink_evidence_bundle": sql("SELECT CAST(v.inc_idx AS INT) AS inc_idx, i.host, CASE WHEN grounded THEN 'true' ELSE 'false' END AS grounded, CAST(n AS INT) AS signals FROM vrd v JOIN inc i USING (inc_idx) JOIN (SELECT host, anchor, COUNT(*) AS n FROM asg GROUP BY ALL) s ON s.host = i.host AND s.anchor = i.anchor", *CAMP, CATALOGUE, *CHECKED),
    "doc_chunks": sql('SELECT source, "at", heading, md5(content) AS content FROM chunk', DOC, CHUNKS),
    "doc_stats": sql("SELECT source, COUNT(*) AS passages FROM chunk GROUP BY ROLLUP (source)", DOC, CHUNKS),
    "sink_passages": sql('SELECT source, COUNT(*) AS passages, CAST(SUM(length(content)) AS BIGINT) AS chars FROM chunk GROUP BY source', DOC, CHUNKS),
    "src_documents": "SELECT doc_id || '.md' AS source, md5(regexp_replace(COALESCE(text, ''), '\\r\\n?', chr(10), 'g')) AS text FROM documents",
    "norm_validate_batch": "SELECT event_id AS ordinal, event_id % 13 <> 5 AS record FROM events",
    "doc_embed_batches": sql('SELECT source, "at", length(CASE WHEN heading <> \'\' THEN heading || \'. \' || content ELSE content END) AS first FROM par', DOC),
    "st_kerberos_spray": sql("SELECT host, COUNT(*) AS n FROM ev WHERE event_id = 4771 GROUP BY host HAVING COUNT(*) >= 2", EV),
    "ev_top_events": sql("SELECT CAST(inc_idx AS INT) AS inc_idx, CAST(rn AS INT) AS rn, CAST(n AS INT) AS n, line FROM (SELECT i.inc_idx, l.line, row_number() OVER (PARTITION BY i.inc_idx ORDER BY e.time, e.id) AS rn, COUNT(*) OVER (PARTITION BY i.inc_idx) AS n FROM inc i JOIN eids x ON x.host = i.host AND x.anchor = i.anchor JOIN ev e ON e.id = x.id JOIN line l ON l.id = x.id) WHERE rn <= 3", *INC, f"line AS ({EVENT_LINE})"),
    "src_win_records": sql("SELECT ordinal, CAST(event_id AS BIGINT) AS event_id, CASE WHEN i % 2 = 0 THEN 'user' || (user_id % 5) ELSE 'svc' END AS \"user\", CASE WHEN i % 4 = 0 THEN 'Sysmon' WHEN i % 3 = 0 THEN 'Security' ELSE 'System' END AS source, CASE WHEN i % 5 = 0 THEN NULL ELSE CAST(443 AS BIGINT) END AS dest_port FROM win", WIN),
    "norm_alias_resolve": sql("SELECT ordinal, host, usr AS \"user\", CASE WHEN k = 2 THEN '10.0.0.1' END AS src_ip FROM raw", RAW),
    "norm_http_block": sql("SELECT ordinal, CASE k WHEN 0 THEN CASE WHEN i % 2 = 0 THEN '/p/' || i ELSE '/top' END WHEN 1 THEN '/top' END AS url, CASE WHEN k = 0 THEN 'GET' END AS http_method, CAST(CASE WHEN k = 0 AND i % 3 = 0 THEN 404 WHEN k = 1 THEN 500 END AS BIGINT) AS http_status FROM raw", RAW),
    "norm_time_utc": sql("SELECT ordinal, CAST(seconds AS BIGINT) AS seconds FROM raw", RAW),
    "norm_type_affinity": sql("SELECT ordinal, CAST(code AS BIGINT) AS event_id FROM raw", RAW),
    "norm_task_fallback": sql("SELECT ordinal, CASE WHEN k = 0 AND i % 11 = 0 THEN 'TaskName=Updater' WHEN k = 0 THEN '' WHEN k = 1 AND i % 40 = 1 THEN 'certutil -urlcache' WHEN k = 1 THEN 'run' END AS cmdline FROM raw", RAW),
    "norm_raw_keep": "SELECT event_id AS ordinal, true AS same FROM events",
    "norm_drop_untimed": sql("SELECT COUNT(seconds) AS kept, CAST(MIN(seconds) AS BIGINT) AS first, COUNT(*) - COUNT(seconds) AS dropped, COUNT(*) AS read FROM raw", RAW),
    "norm_assign_id": sql("SELECT ordinal, row_number() OVER (ORDER BY ordinal) AS id FROM raw WHERE seconds IS NOT NULL", RAW),
    "sink_events": sql("SELECT host, COUNT(*) AS n, CAST(SUM(id) AS BIGINT) AS ids FROM (SELECT host, row_number() OVER (ORDER BY ordinal) AS id FROM raw WHERE seconds IS NOT NULL) GROUP BY host", RAW),
    "st_row_rules": sql("SELECT 'ingress_tool_transfer' AS rule, host, CAST(ordinal AS VARCHAR) AS event_ids FROM raw WHERE k = 1 AND i % 40 = 1 AND code = 1 AND seconds IS NOT NULL", RAW),
    "pred_process_rows": sql("SELECT id, cmdline FROM ev WHERE event_id = 1 AND cmdline IS NOT NULL", EV),
    "fn_web_text": sql(f"SELECT id, {WEB} AS text {WEB_ROWS}", EV),
    "fn_substring_any": sql(f"SELECT id, COALESCE({any_of(CMD, S.DOWNLOAD)}, false) AS hit FROM ev", EV),
    "fn_word_any": sql("SELECT id, COALESCE(" + ", ".join(f"CASE WHEN {word(WEB, (w,))} THEN {text(w)} END" for w in S.RECON) + f") AS word, {word(WEB, S.EXPLOIT)} AS exploit FROM ev", EV),
    "fn_first_marker": sql("SELECT id, COALESCE(" + ", ".join(f"CASE WHEN contains({CMD}, {text(m)}) THEN {text(m)} END" for m in S.INJECTION) + ") AS marker FROM ev", EV),
    "fn_is_external_ip": f"SELECT id, {external('ip')} AS external FROM (SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN '01.2.3.4' WHEN event_id % 51 = 0 THEN '-' WHEN event_id % 52 = 0 THEN '256.1.1.1' ELSE (event_id * 7 % 256) || '.' || (event_id % 256) || '.2.' || (user_id % 256) END AS ip FROM events)",
    "fn_technique_lookup": sql("SELECT t.technique, n, COALESCE(name, t.technique || ': (unknown technique)') AS name, tactic FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'T1110' WHEN 1 THEN 'T9999' ELSE 'T1027' END AS technique, COUNT(*) AS n FROM events GROUP BY 1) t LEFT JOIN cat USING (technique)", CATALOGUE),
    "rule_all": sql(TOLD + "sig", EV, SIG),
    "rule_custom": sql("SELECT 'git_use' AS rule, host, COUNT(*) AS n, 'git on ' || host AS description FROM ev WHERE starts_with(cmdline, 'git') GROUP BY host", EV),
    "inc_assign": sql(f"SELECT host, rule_ord, event_ids, {ISO('time')} AS at, {ISO('anchor')} AS anchor FROM asg", EV, SIG, ANCHORS),
    "inc_build": sql(FLAT, *INC),
    "inc_rank": sql(f"SELECT CAST(inc_idx AS INT) AS inc_idx, host, {ISO('st')} AS start_time FROM inc", *INC),
    "camp_entities": sql("SELECT CAST(inc_idx AS INT) AS inc_idx, kind, entity FROM ent", *INC, ENTITIES),
    "camp_infra_filter": sql("SELECT kind, COUNT(*) AS n, COUNT(DISTINCT entity) AS entities FROM kept GROUP BY kind", *INC, ENTITIES),
    "camp_link_pairs": sql("SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM prs", *CAMP),
    "camp_near_in_time": sql(f"SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM ({pairs_sql('usrs', 3)})", *INC, ENTITIES, "usrs AS (SELECT * FROM ent WHERE kind = 'user')"),
    "camp_components": sql("SELECT CAST(inc_idx AS INT) AS inc_idx, CAST(root AS INT) AS root FROM root", *CAMP),
    "inc_pipeline": sql(f"SELECT CAST(i.inc_idx AS INT) AS inc_idx, host, {ISO('st')} AS start_time, {ISO('en')} AS end_time, {SEVERITY} AS severity, techniques, event_ids, CAST(campaign_id AS INT) AS campaign_id, COALESCE(related_hosts, '') AS related_hosts FROM inc i LEFT JOIN camp USING (inc_idx) LEFT JOIN rel USING (inc_idx)", *CAMP),
    "camp_related": sql("SELECT CAST(i.inc_idx AS INT) AS inc_idx, CAST(COALESCE(peers, 0) AS INT) AS peers, COALESCE(hosts, '') AS hosts FROM inc i LEFT JOIN rel USING (inc_idx)", *CAMP),
    "ev_clip": "SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '…[+' || (length(t) - 300) || ' chars truncated]' ELSE t END AS clipped FROM (SELECT doc_id, replace(replace(text, chr(13), ''), chr(10), '\\n') AS t FROM documents)",
    "ev_line": sql(EVENT_LINE, EV),
    "chk_tactic_tokens": "SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '' AND x NOT IN (" + ", ".join(text(w) for w in S.TACTIC_STOPWORDS) + ")))) AS INT) AS tokens FROM documents",
    "doc_paragraphs": sql("SELECT source, \"at\", heading, md5(content) AS content FROM par", DOC),
    "doc_embed_text": sql("SELECT source, \"at\", md5(CASE WHEN heading <> '' THEN heading || '. ' || content ELSE content END) AS text FROM par", DOC),
    "ret_cosine": sql(f"SELECT id, round({COSINE}, 6) AS similarity FROM (SELECT a.id, a.e, b.e AS qe FROM v a JOIN v b ON b.id = a.id + 1)", VEC),
    "ret_topk": sql(f"SELECT qid, CAST(rank AS INT) AS rank, id, round(s, 3) AS similarity FROM (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM (SELECT qid, id, {COSINE} AS s FROM q CROSS JOIN v)) WHERE rank <= 3 AND s >= 0.35", VEC),
    "ret_refusal": sql(f"SELECT q.qid, m >= 0.5 AS answered, CASE WHEN m < 0.5 THEN 'The knowledge base does not cover this.' END AS answer FROM (SELECT qid, MAX({COSINE}) AS m FROM q JOIN v ON id <> qid GROUP BY qid) q", VEC),
    "ret_runbook": sql("SELECT CAST(inc_idx AS INT) AS inc_idx, 'incident response for ' || string_agg(n, ', ' ORDER BY rn) AS query FROM (SELECT i.inc_idx, t.rn, t.technique || ' ' || c.name AS n FROM inc i JOIN techs t ON t.host = i.host AND t.anchor = i.anchor JOIN cat c ON c.technique = t.technique) GROUP BY inc_idx", *INC, CATALOGUE),
    "ret_invented_citations": "SELECT doc_id, array_to_string(list_sort(['a b.md', 'zz-' || lang || '.md']), ',') AS invented FROM documents",
    "ret_technique_match": sql(f"SELECT qid, CAST(rank AS INT) AS rank, technique, round(s, 3) AS similarity FROM (SELECT qid, technique, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM (SELECT qid, v.id, k.technique, {COSINE} AS s FROM q CROSS JOIN v JOIN (SELECT technique, row_number() OVER (ORDER BY technique) - 1 AS id FROM cat) k ON k.id = v.id)) WHERE rank <= 2", CATALOGUE, VEC),
    "agg_technique_layer": sql("SELECT s.technique, name, COUNT(*) AS score, string_agg(DISTINCT host, ', ' ORDER BY host) AS hosts, COUNT(*) || ' signal(s) on: ' || string_agg(DISTINCT host, ', ' ORDER BY host) AS comment FROM sig s JOIN cat c ON c.technique = s.technique GROUP BY ALL", EV, SIG, CATALOGUE),
    "agg_coverage_layer": sql("SELECT c.technique, name, covered, CASE WHEN covered THEN '#2e7d32' ELSE '#c62828' END AS color, CASE WHEN covered THEN 'Rule implemented' ELSE 'KNOWN GAP — no rule yet' END AS comment, COUNT(s.technique) AS score FROM cat c LEFT JOIN sig s USING (technique) GROUP BY ALL", EV, SIG, CATALOGUE),
    "eval_confusion": sql("SELECT * FROM conf", EV, SIG, CONFUSION),
    "eval_micro_metrics": sql(f"SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *, {PREC} AS p, {REC} AS r FROM met)", EV, SIG, CONFUSION),
    "eval_recall_by_file": sql("SELECT scope, CAST(SUM(tp) AS BIGINT) AS found, CAST(SUM(tp + fn) AS BIGINT) AS expected, CASE WHEN SUM(tp + fn) > 0 THEN round(SUM(tp) / SUM(tp + fn), 6) ELSE 0 END AS recall FROM conf GROUP BY ROLLUP (scope)", EV, SIG, CONFUSION),
    "eval_gate": sql(f"SELECT round({PREC}, 6) AS precision, round({REC}, 6) AS recall, {PREC} >= 0.2 AND {REC} >= 0.99 AS passed FROM met", EV, SIG, CONFUSION),
    "view_raw_events": sql(f'SELECT id, {ISO("time")} AS time, host, event_id, usr AS "user", src_ip, category, tool, url, message, cmdline FROM ev', EV),
    "agg_event_mix": sql("SELECT source, CAST(event_id AS BIGINT) AS event_id, COUNT(*) AS n FROM ev GROUP BY ALL", EV),
}
for _r in ROWS:
    ORACLE_SQL[{"encoded_powershell": "rule_encoded_powershell", "ingress_tool_transfer": "rule_ingress_transfer", "scheduled_task_persistence": "rule_scheduled_task", "unix_shell_abuse": "rule_unix_shell", "exfil_alt_protocol": "rule_exfiltration", "web_reconnaissance": "rule_web_recon", "llm_prompt_injection": "rule_prompt_injection"}.get(_r[1], f"rule_{_r[1]}")] = sql(f"{TOLD}({row_sql(_r)})", EV)
ORACLE_SQL |= {"rule_brute_force": sql(f"{TOLD}({BRUTE})", EV), "rule_kerberos_spray": sql(f"{TOLD}({SPRAY})", EV)}
ORACLE_SQL |= {
    "st_brute_force": sql("SELECT host, usr AS \"user\", src_ip, COUNT(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY time, id) AS event_ids FROM (SELECT *, MIN(CASE WHEN time - t2 <= INTERVAL '5' MINUTE THEN t2 END) OVER (PARTITION BY host, usr, src_ip) AS anchor FROM (SELECT *, LAG(time, 2) OVER (PARTITION BY host, usr, src_ip ORDER BY time, id) AS t2 FROM ev WHERE event_id = 4625)) WHERE time BETWEEN anchor AND anchor + INTERVAL '5' MINUTE GROUP BY host, usr, src_ip", EV),
    "st_incidents": sql(f"SELECT i.host, {ISO('st')} AS start_time, {ISO('en')} AS end_time, n, techniques FROM inc i JOIN (SELECT host, anchor, COUNT(*) AS n FROM asg GROUP BY ALL) s ON s.host = i.host AND s.anchor = i.anchor", *INC),
    "st_campaigns": sql(f"SELECT i.host, {ISO('i.st')} AS start_time, f.first, COALESCE(members, 0) AS members FROM inc i LEFT JOIN camp c USING (inc_idx) LEFT JOIN (SELECT campaign_id, COUNT(*) AS members, arg_min({ISO('st')} || ' ' || host, (st, host)) AS first FROM mem GROUP BY campaign_id) f ON f.campaign_id = c.campaign_id", *CAMP),
    "st_late": sql("SELECT COUNT(*) FILTER (event_id = 4625 AND time <= (SELECT MAX(time) FROM ev WHERE event_id = 4625) - INTERVAL '10' MINUTE) AS late_rows, COUNT(*) AS events FROM ev", EV),
    "src_scenarios": sql("SELECT 'case-' || (ordinal // 500) AS scope, COUNT(*) AS records, COUNT(*) FILTER (code = 4625) AS failed, (ordinal // 500) % 2 = 0 AS is_malicious, 'T1110' AS expected FROM raw GROUP BY ordinal // 500", RAW),
    "src_labeled_captures": sql("SELECT 'cap-' || (ordinal // 1000) || '.jsonl' AS scope, COUNT(*) AS records, COUNT(*) FILTER (event_id = 4625) AS failed, 'T1110,T1071' AS expected FROM win GROUP BY ordinal // 1000", WIN),
    "src_synth_events": "SELECT host, event_id, COUNT(*) AS n, COUNT(DISTINCT u) AS users, MIN(i) AS first, MAX(i) + CAST(epoch(TIMESTAMP '2026-07-03 10:00:00') AS BIGINT) AS last FROM (SELECT i, CASE WHEN i % 5 = 0 THEN 'SRV-TARGET' ELSE 'HOST' || lpad(CAST(i % 50 AS VARCHAR), 2, '0') END AS host, CAST([4625, 4624, 1, 3, 1][i % 5 + 1] AS BIGINT) AS event_id, CASE WHEN i % 5 = 0 THEN 'svc' ELSE 'user' || (i % 200) END AS u FROM (SELECT UNNEST(range((SELECT COUNT(*) FROM events))) AS i)) GROUP BY ALL",
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
