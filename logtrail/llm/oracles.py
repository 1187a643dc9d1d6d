"""DuckDB SQL for the queries whose contract SQL can state in full: windows written out, grouped and counted."""

from __future__ import annotations

LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: A window of an item is its words in a line; documents are cut into windows of every length that items have.
DECONTAMINATE = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT item_id, w, least(13, len(w)) AS n, UNNEST(generate_series(1, greatest(1, len(w) - 12))) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT doc_id, w, n, UNNEST(generate_series(1, len(w) - n + 1)) AS i FROM doc CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM places JOIN win USING (n, k)),
words AS (SELECT doc_id, COUNT(DISTINCT j) AS n_hit FROM (SELECT doc_id, UNNEST(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256,
  COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, strlen(COALESCE(html, '')) AS n, sha256(COALESCE(html, '')) AS digest FROM pages),
f AS (SELECT digest, MIN(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.digest = p.digest AND n >= 100"""


def _repeats(parts: str, width: int) -> str:
    """Parts (doc_id, i from 1, x) of documents, each with whether a window of `width` covers it that occurs again."""
    return f"""
part AS ({parts}),
cut AS (SELECT doc_id, i, x, CASE WHEN COUNT(*) OVER ahead = {width} THEN md5(string_agg(x, ' ') OVER ahead) END AS k FROM part
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)),
again AS (SELECT k FROM cut WHERE k IS NOT NULL GROUP BY k HAVING COUNT(*) > 1),
seen AS (SELECT c.doc_id, c.i, c.x, CASE WHEN a.k IS NOT NULL THEN c.i END AS start FROM cut c LEFT JOIN again a ON a.k = c.k),
told AS (SELECT doc_id, i, x, COALESCE(MAX(start) OVER (PARTITION BY doc_id ORDER BY i) > i - {width}, false) AS gone FROM seen)"""


SUFFIX_TREE = (
    "WITH"
    + _repeats(
        r"SELECT doc_id, UNNEST(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)",
        35,
    )
    + """,
kept AS (SELECT doc_id, COUNT(*) AS n_words, COUNT(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS rest FROM told GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_words, 0) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(rest, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)"""
)


def _bytes_again() -> str:
    """Hashes of 1, 2, 4 ... 128 bytes from each place on, each of two halves; 200 bytes are those of 8, 64 and 128."""
    out, width = "h1 AS (SELECT *, hash(x) AS k, 0 AS k8, 0 AS k64 FROM byte)", 1
    while width < 128:
        keep = lambda n: f"k AS k{n}" if width == n else f"k{n}"  # noqa: B023, E731
        out += f""",
h{2 * width} AS (SELECT doc_id, i, x, hash(k, LEAD(k, {width}) OVER w) AS k, {keep(8)}, {keep(64)} FROM h{width} WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""
        width *= 2
    return out


SUFFIX_ARRAY = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(hex(encode(COALESCE(text, ''))), '..') AS b FROM documents),
byte AS (SELECT doc_id, UNNEST(b) AS x, generate_subscripts(b, 1) AS i FROM doc),
{_bytes_again()},
cut AS (SELECT doc_id, i, x, CASE WHEN LEAD(i, 199) OVER w IS NOT NULL THEN hash(k8, LEAD(k64, 8) OVER w, LEAD(k, 72) OVER w) END AS k FROM h128 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT k FROM cut WHERE k IS NOT NULL GROUP BY k HAVING COUNT(*) > 1),
seen AS (SELECT c.doc_id, c.i, c.x, CASE WHEN a.k IS NOT NULL THEN c.i END AS start FROM cut c LEFT JOIN again a ON a.k = c.k),
told AS (SELECT doc_id, i, x, COALESCE(MAX(start) OVER (PARTITION BY doc_id ORDER BY i) > i - 200, false) AS gone FROM seen),
runs AS (SELECT *, gone AND NOT COALESCE(LAG(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM told),
kept AS (SELECT doc_id, COUNT(*) FILTER (gone) AS n_removed, COUNT(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS rest FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(b) AS BIGINT) AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(rest, ''))) AS kept_sha256
FROM doc d LEFT JOIN kept USING (doc_id)"""

_DRAW = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT)"
#: Units written out as a list; a cut joins the first k of them.
FILL_MIDDLE = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(COALESCE(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, {_DRAW(0)} % (len(w) + 1) AS x, {_DRAW(1)} % (len(w) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_DRAW(2)} % 100 >= 50 THEN 'plain' WHEN {_DRAW(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, t, array_to_string(w[1:CAST(least(x, y) AS BIGINT)], '') AS pre, array_to_string(w[CAST(least(x, y) AS BIGINT) + 1:CAST(greatest(x, y) AS BIGINT)], '') AS mid,
  array_to_string(w[CAST(greatest(x, y) AS BIGINT) + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
