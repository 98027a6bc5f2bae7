"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from ionlake.llm import license_scan as ls
from ionlake.llm import resampling, vector_codes, web_archive
from ionlake.llm.license_texts import NAMES, all_templates


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_MARKS, _TERM, _SENTENCE, _SPDX = (_quoted(x) for x in (ls.MARKS, ls.TERM, ls.SENTENCE, ls.SPDX))
_LICENSES = f"""
WITH t AS (SELECT * FROM (VALUES {_values([(k, *r) for k, r in enumerate(all_templates())])}) v(template, license, text)),
known_ids AS (SELECT * FROM (VALUES {_values([(k,) for k in NAMES])}) v(id)),
raw AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(source, 'unknown') AS s, coalesce(lang, 'unknown') AS l, coalesce(CAST(floor(doc_id / 1000) AS BIGINT)::VARCHAR, 'unknown') AS k,
  coalesce(text, '') AS text, md5(coalesce(text, '')) AS h FROM documents),
marked AS (SELECT DISTINCT text, h FROM raw WHERE regexp_matches(text, {_MARKS})),
sent AS (SELECT h, length(text) AS size, unnest(regexp_extract_all(text, {_SENTENCE})) AS x FROM marked),
lic AS (SELECT h FROM sent GROUP BY h HAVING sum(CASE WHEN regexp_matches(x, {_MARKS}) THEN length(x) ELSE 0 END) >= {ls.COVERED} * max(size)),
spot AS (SELECT raw.*, lic.h IS NOT NULL AS is_license, CASE WHEN lic.h IS NULL THEN 3 ELSE ascii(raw.h) % 3 + 1 END AS depth FROM raw LEFT JOIN lic ON raw.h = lic.h),
files AS (SELECT doc_id, text, is_license, CASE depth WHEN 3 THEN s || '/' || l || '/' || k WHEN 2 THEN s || '/' || l ELSE s END AS folder,
  CASE WHEN is_license THEN 'LICENSE-' ELSE '' END || coalesce(doc_id::VARCHAR, 'null') || '-' || h || '.txt' AS name FROM spot),
placed AS (SELECT *, folder || '/' || name AS path FROM files),
every AS (SELECT text FROM placed UNION ALL SELECT text FROM t),
n AS (SELECT count(*) AS total FROM every),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), {_TERM}))) AS term FROM every) GROUP BY term),
m AS (SELECT DISTINCT path, text FROM placed WHERE regexp_matches(text, {_MARKS})),
para AS (SELECT path, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) AS p FROM m),
line AS (SELECT path, unnest(string_split(text, chr(10))) AS p FROM m),
piece AS (SELECT DISTINCT path, x FROM (SELECT path, text AS x FROM m UNION ALL SELECT path, p FROM para
  UNION ALL SELECT path, unnest(regexp_extract_all(p, {_SENTENCE})) FROM para UNION ALL SELECT path, unnest(regexp_extract_all(p, {_SENTENCE})) FROM line) WHERE regexp_matches(x, {_MARKS})),
held AS (SELECT path, x, term, 1 + ln(count(*)) AS tf FROM (SELECT path, x, unnest(regexp_extract_all(lower(x), {_TERM})) AS term FROM piece) GROUP BY path, x, term),
known AS (SELECT template, license, term, 1 + ln(count(*)) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), {_TERM})) AS term FROM t) GROUP BY template, license, term),
weight AS (SELECT term, ln((1 + total) / (1 + df)) + 1 AS idf FROM df, n),
tw AS (SELECT template, license, term, tf * idf AS w FROM known JOIN weight USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
pw AS (SELECT path, x, term, tf * idf AS w FROM held JOIN weight USING (term)),
pn AS (SELECT path, x, sqrt(sum(w * w)) AS norm FROM pw GROUP BY path, x),
scored AS (SELECT path, license, round(dot / pn.norm / tn.norm, 6) AS score FROM (SELECT path, x, template, license, sum(pw.w * tw.w) AS dot FROM pw JOIN tw USING (term) GROUP BY path, x, template, license) JOIN pn USING (path, x) JOIN tn USING (template)),
tag AS (SELECT path, regexp_replace(id, '-(only|or-later)$', '') AS cut, id FROM (SELECT path, unnest(regexp_extract_all(text, {_SPDX}, 1)) AS id FROM placed)),
both_ways AS (SELECT * FROM scored WHERE score >= {ls.LEAST} UNION ALL SELECT path, CASE WHEN cut IN (SELECT id FROM known_ids) THEN cut ELSE id END, 1.0 FROM tag),
own AS (SELECT path, license, score FROM both_ways QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
giver AS (SELECT folder AS above, path AS from_path, license, score FROM (SELECT DISTINCT folder, path FROM placed WHERE is_license) JOIN own USING (path)
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, path, license) = 1),
reach AS (SELECT folder, g.* FROM (SELECT DISTINCT folder FROM placed) JOIN giver g ON folder = above OR starts_with(folder, above || '/')
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, coalesce(own.license, reach.license) AS license, coalesce(own.score, reach.score) AS score,
  CASE WHEN own.path IS NOT NULL THEN 'header' WHEN reach.folder IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own.path IS NOT NULL THEN path ELSE from_path END AS from_path
FROM placed LEFT JOIN own USING (path) LEFT JOIN reach USING (folder)
"""

#: Of a table link(u, v) that holds both directions: every node with the least one it reaches.
_COMPONENTS = """reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u), least AS (SELECT u, min(v) AS v FROM reach GROUP BY u)"""

_VECTORS = f"""
WITH RECURSIVE v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT vec_id, e, len(e) AS n FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e)
  AND len(e) = (SELECT count(*) FROM (SELECT unnest(e) AS x) WHERE isfinite(x)) AND list_sum([abs(x) for x in e]) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND a.n = b.n AND list_cosine_similarity(a.e, b.e) >= 0.95),
{_COMPONENTS},
counts AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(l.v, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(l.v, vec_id)) AS kept
FROM v LEFT JOIN counts c ON vec_id = c.u LEFT JOIN least l ON vec_id = l.u
"""

_DOCUMENTS = f"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1) UNION SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 80 * (nu.n + nv.n - c)),
{_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.v, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(l.v, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.u = d.doc_id
"""

#: Lines meet by the rarest shingles of each, of which alike ones share at least one.
_LINES = f"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i AS line_no, trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)),
f AS (SELECT line, doc_id * 1000000 + line_no AS id, doc_id, line_no FROM l WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) = 1),
s AS (SELECT DISTINCT id, substr(line, i, 5) AS x FROM (SELECT id, line, unnest(range(1, greatest(2, length(line) - 3))) AS i FROM f)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
often AS (SELECT x, count(*) AS k FROM s GROUP BY x),
ranked AS (SELECT id, x, n, row_number() OVER (PARTITION BY id ORDER BY k, x) AS r FROM s JOIN often USING (x) JOIN n USING (id)),
prefix AS (SELECT id, x, n FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
pair AS (SELECT DISTINCT a.id AS u, b.id AS v, a.n AS nu, b.n AS nv FROM prefix a JOIN prefix b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
alike AS (SELECT u, v FROM pair JOIN s a ON a.id = u JOIN s b ON b.id = v AND a.x = b.x GROUP BY u, v, nu, nv HAVING 100 * count(*) >= 80 * (nu + nv - count(*))),
link AS (SELECT u, v FROM alike UNION ALL SELECT v, u FROM alike),
{_COMPONENTS},
stays AS (SELECT doc_id, line_no FROM f LEFT JOIN least ON u = id WHERE v IS NULL OR v >= id),
marked AS (SELECT l.doc_id, l.line_no, line = '' AS blank, stays.doc_id IS NOT NULL AS kept FROM l LEFT JOIN stays ON stays.doc_id = l.doc_id AND stays.line_no = l.line_no)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (blank) AS INTEGER) AS n_blank, CAST(count(*) FILTER (kept) AS INTEGER) AS n_kept,
  coalesce(list(CAST(line_no AS INTEGER) ORDER BY line_no) FILTER (NOT blank AND NOT kept), []) AS dropped
FROM marked GROUP BY doc_id
"""



def _vector_codes() -> str:
    """The rounds one after another: e<k> are the entries of round k, a<k> the assignments to them."""
    parts, entries, scale = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.SCALE
    text = f"""
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS k, vec_id, label, [floor({scale} * x)::BIGINT for x in e] AS e FROM v
  WHERE len(e) > 0 AND len(e) = (SELECT count(*) FROM (SELECT unnest(e) AS x) WHERE isfinite(x))),
p AS MATERIALIZED (SELECT k, vec_id, label, j AS part, e[j * len(e) // {parts} + 1 : (j + 1) * len(e) // {parts}] AS x FROM sound, range({parts}) r(j)),
e0 AS MATERIALIZED (SELECT part, k - 1 AS entry, x AS c FROM p WHERE k <= {entries}),"""
    for k in range(vector_codes.ROUNDS + 1):
        text += f"""
a{k} AS MATERIALIZED (SELECT k, part, any_value(x) AS x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT k, p.part, x, entry, list_sum([(z[1] - z[2]) ** 2 for z in list_zip(x, c)])::BIGINT AS d FROM p JOIN e{k} USING (part)) GROUP BY k, part),"""
        if k < vector_codes.ROUNDS:
            text += f"""
m{k} AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT part, entry, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM a{k}, range(1, len(x) + 1) r(i) GROUP BY part, entry, i) GROUP BY part, entry),
e{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, e{k}.c) AS c FROM e{k} LEFT JOIN m{k} USING (part, entry)),"""
    last = vector_codes.ROUNDS
    return f"""{text}
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{last}),
out AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} JOIN (SELECT k, vec_id, label FROM sound) USING (k) GROUP BY k, vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256, label FROM out, h
"""


_ARCHIVE = f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, url FROM p),
f AS (SELECT *, row_number() OVER w AS r, first_value(page_id) OVER w AS first FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < {web_archive.LEAST} OR r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= {web_archive.LEAST} AND r > 1 THEN first END AS refers_to FROM f
"""

#: CRC-32 byte by byte over a table that its polynomial gives.
_RESAMPLING = f"""
WITH step AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i))),
texts AS (SELECT row_number() OVER () AS k, doc_id, text, false AS goal FROM documents UNION ALL SELECT NULL, NULL, text, true FROM benchmark),
w AS MATERIALIZED (SELECT k, doc_id, goal, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS MATERIALIZED (SELECT k, goal, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM w),
bytes AS (SELECT x, [CAST('0x' || h[i : i + 1] AS BIGINT) for i in range(1, len(h), 2)] AS b FROM (SELECT DISTINCT x, hex(encode(x)) AS h FROM f)),
b AS MATERIALIZED (SELECT x, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]))) % {resampling.BUCKETS} AS bucket FROM bytes, step),
n AS MATERIALIZED (SELECT k, goal, bucket, count(*) AS n FROM f JOIN b USING (x) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (NOT goal), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (goal), 0)::DOUBLE AS t FROM n GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM sums) + {resampling.BUCKETS})) / ((s + 1) * ((SELECT sum(t) FROM sums) + {resampling.BUCKETS}))))::BIGINT AS gain FROM sums),
m AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM n JOIN g USING (bucket) WHERE NOT goal GROUP BY k),
s AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN m USING (k) WHERE NOT goal),
r AS (SELECT *, CASE WHEN words >= {resampling.LEAST_WORDS} THEN row_number() OVER (PARTITION BY words >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) END AS r, count(*) FILTER (words >= {resampling.LEAST_WORDS}) OVER () AS total FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {resampling.PERCENT} * total // 100 THEN r END AS rank FROM r
"""

ORACLE_SQL = {
    "op1_license_scan": _LICENSES,
    "op2_cover_tree": _VECTORS,
    "op5_line_dedup": _LINES,
    "op8_minmax_dedup": _DOCUMENTS,
    "op11_vector_codes": _vector_codes(),
    "op12_web_archive": _ARCHIVE,
    "op13_resampling": _RESAMPLING,
}
