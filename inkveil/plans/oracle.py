"""DuckDB SQL with the same rows as the registered queries, written for its own dialect rather than translated."""

from __future__ import annotations

from inkveil.operators.layout import FIXED, SANS, SERIF
from inkveil.operators.prompts import text_prompt_parts
from inkveil.plans.pipeline import NO_PROVIDER, NOTHING_READ
from inkveil.plans.queries import LITERALS
from inkveil.targets import BARE_ENDINGS, PROFILE_HOSTS, builtin_target_ids, resolve_targets

BLANKS = r"[\s\x0B\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LITERAL_ROWS = ", ".join(f"({i}, {quoted(t)})" for i, t in LITERALS)
DOCS = f"SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_LITERAL_ROWS}) v(doc_id, text)"
WEB = f"SELECT page_id AS doc_id, url || chr(10) || html AS text FROM pages UNION ALL SELECT * FROM (VALUES {_LITERAL_ROWS}) v(doc_id, text)"
PLAIN = "SELECT doc_id, text FROM documents"

# The same shapes as the engine's, for an engine without lookbehind: where one is needed, the sign before is matched too and the value is group 1.
EMAIL = r"(?i)[A-Z0-9._%+-]+\s?@\s?[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,5}(?:[\s.-]?\d{2,5}){1,4}\b"
SOCIAL = r"(?i)\b(?:(?:https?://)?(?:[a-z]{2,3}\.)?(?:" + "|".join(h.replace(".", r"\.") for h in PROFILE_HOSTS) + r")/[^\s<>\"')]*)"
DOB = r"(?i)\b(?:d\.?o\.?b\.?|date\s+of\s+birth|born)\b[^\n]{0,40}|\b(?:0?[1-9]|[12]\d|3[01])[/.\-](?:0?[1-9]|1[0-2])[/.\-](?:19|20)\d{2}\b"
EXPLICIT = r"(?i)\b(?:https?://|www\.)[^\s<>\"')\]]+"
_HOST = r"(?i)(?:^|[^@\w.-])((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+"
PATH = _HOST + r"[a-z]{2,}/[^\s<>\"')\]]*)"
BARE = _HOST + "(?:" + "|".join(BARE_ENDINGS) + r")\b)"
YEARS = r"\b(?:19|20)\d{2}\b[^\d]{1,3}\b(?:19|20)\d{2}\b"


def lines(source: str) -> str:
    """CTEs pages and lines of a source of (doc_id, text)."""
    return f"""
src AS ({source}),
cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS al FROM src),
slots AS (SELECT doc_id, ((i - 1) // 60)::INT AS page, ((i - 1) % 60)::INT AS slot, trim(regexp_replace(al[i], '{BLANKS}', ' ', 'g')) AS text
          FROM cut, LATERAL (SELECT unnest(range(1, len(al) + 1)) AS i)),
lines AS (SELECT doc_id, page, slot, row_number() OVER w AS line_no, text,
                 coalesce(sum(len(string_split(text, ' '))) OVER (PARTITION BY doc_id, page ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
          FROM slots WHERE text <> '' WINDOW w AS (PARTITION BY doc_id, page ORDER BY slot))"""


def words(source: str) -> str:
    return lines(source) + """,
words AS (SELECT doc_id, page, slot AS line, line_no, 'p' || page || 'w' || (first + i - 1) AS word_id, (first + i - 1) AS ord, w[i] AS text,
                 6.0::DOUBLE * (coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x) + 1)), 0))::DOUBLE AS x, (14 * slot)::DOUBLE AS y,
                 6.0::DOUBLE * length(w[i]) AS width, 12.0::DOUBLE AS height
          FROM (SELECT *, string_split(text, ' ') AS w FROM lines), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i))"""


def found(name: str, pattern: str, group: int = 0) -> str:
    """CTE of matches of a pattern on lines: start and raw."""
    p = quoted(pattern)
    return f"""
{name}_m AS (SELECT *, regexp_extract_all(text, {p}, 0) AS ms, regexp_extract_all(text, {p}, {group}) AS vs, regexp_split_to_array(text, {p}) AS gs FROM lines WHERE regexp_matches(text, {p})),
{name} AS (SELECT doc_id, page, slot, line_no, text, first, vs[i] AS raw,
                  (list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0)
                   + length(ms[i]) - length(vs[i]))::BIGINT AS start
           FROM {name}_m, LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i))"""


URLS = ",".join([found("u1", EXPLICIT), found("u2", PATH, 1), found("u3", BARE, 1)]) + """,
urls AS (SELECT doc_id, page, line_no, start AS us, start + length(raw) AS ue FROM (FROM u1 UNION ALL FROM u2 UNION ALL FROM u3))"""
NOT_IN_URL = "NOT EXISTS (SELECT 1 FROM urls u WHERE u.doc_id = h.doc_id AND u.page = h.page AND u.line_no = h.line_no AND h.start < ue AND h.start + length(h.raw) > us)"
PHONE_OK = f"""(length(regexp_replace(raw, '\\D', '', 'g')) BETWEEN 7 AND 15 AND NOT regexp_matches(raw, '{YEARS}')
  AND NOT regexp_matches(substr(text, start + length(raw) + 1, 2), '^\\s*%')
  AND (regexp_matches(lower(substr(text, greatest(start - 24, 0) + 1, least(start, 24))), 'phone|mobile|mob|tel|cell|contact|whatsapp|call')
       OR regexp_matches(raw, '^\\s*\\+') OR length(regexp_replace(raw, '\\D', '', 'g')) >= 9))"""


def detections(hits: str, target: str) -> str:
    """Boxes and words of matches: the range widens to the nearest spaces."""
    return f"""
t AS (SELECT *, start + length(raw) - length(ltrim(raw)) AS b0, trim(raw) AS value FROM {hits} WHERE trim(raw) <> ''),
e AS (SELECT *, b0 - length(regexp_extract(text[1:b0], '[^ ]*$')) AS wb,
             b0 + length(value) + length(regexp_extract(substr(text, b0 + length(value) + 1), '^[^ ]*')) AS we FROM t),
s AS (SELECT *, length(regexp_replace(text[1:wb], '[^ ]', '', 'g')) AS n0, length(regexp_replace(substr(text, wb + 1, we - wb), '[^ ]', '', 'g')) AS n1 FROM e)
SELECT doc_id, page, line_no, '{target}' AS target, value AS text, (6 * wb)::DOUBLE AS x, (14 * slot)::DOUBLE AS y, (6 * (we - wb))::DOUBLE AS width, 12.0::DOUBLE AS height,
       array_to_string(list_transform(range(0, n1 + 1), lambda k: 'p' || page || 'w' || (first + n0 + k)), ',') AS word_ids FROM s"""


def detect(source: str, pattern: str, target: str, where: str = "true", group: int = 0, veto: bool = False) -> str:
    parts = [lines(source), found("h0", pattern, group)] + ([URLS] if veto else [])
    test = where + (f" AND {NOT_IN_URL}" if veto else "")
    return f"WITH {','.join(parts)}, h1 AS (SELECT * FROM h0 h WHERE {test}),{detections('h1', target)}"


ANCHOR = r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
LINKS = f"""
raw AS (SELECT page_id AS doc_id, url AS base, regexp_extract_all(html, '{ANCHOR}', 1) AS hs, regexp_extract_all(html, '{ANCHOR}', 2) AS ts FROM pages),
parts AS (SELECT doc_id, base, (i - 1)::INT AS link_ord, hs[i] AS href, trim(regexp_replace(regexp_replace(ts[i], '(?s)<[^>]*>', '', 'g'), '{BLANKS}', ' ', 'g')) AS text,
                 regexp_extract(base, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*') AS origin, regexp_replace(base, '[?#].*$', '') AS bare
          FROM raw, LATERAL (SELECT unnest(range(1, len(hs) + 1)) AS i)),
links AS (SELECT doc_id, (link_ord // 60)::INT AS page, (link_ord % 60)::INT AS slot, link_ord, text,
                 CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href[1] = '/' THEN origin || href
                      ELSE CASE WHEN regexp_matches(bare, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/') THEN regexp_replace(bare, '[^/]*$', '') ELSE origin || '/' END || href END AS url,
                 0.0::DOUBLE AS x, (14 * (link_ord % 60))::DOUBLE AS y, (6 * greatest(length(text), 1))::DOUBLE AS width, 12.0::DOUBLE AS height,
                 CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS n FROM parts)"""


def links_sql(kept: str, named: str) -> str:
    return f"""WITH {LINKS}, k AS (SELECT *, {named} AS named FROM links)
SELECT doc_id, page, coalesce(named, 'link') AS target, url AS text, x, y, width, height,
       array_to_string(list_transform(range(0, n), lambda k: 'p' || page || 'w' || (slot * 1000 + k)), ',') AS word_ids FROM k WHERE {kept}"""


_NAMED = f"CASE WHEN regexp_matches(url, {quoted(SOCIAL)}) THEN 'social' WHEN regexp_matches(url, '(?i)/about') THEN 'about' WHEN regexp_matches(url, {quoted(EXPLICIT)}) OR regexp_matches(url, {quoted(PATH)}) OR regexp_matches(url, {quoted(BARE)}) THEN 'url' END"

QUOTES = lines(PLAIN) + """,
q AS (SELECT doc_id, page, item, named, quote, target, confidence FROM (SELECT doc_id, page, string_split(text, ' ')[1] AS w FROM lines WHERE line_no = 2),
      LATERAL (VALUES (0, 2, w, 'name', 0.9::DOUBLE), (1, 9, translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'unknown', 1.0::DOUBLE), (2, 1, '~' || w, 'school', 0.4::DOUBLE)) v(item, named, quote, target, confidence)),
pos AS (SELECT q.*, l.line_no, l.slot, l.text, l.first, string_split(replace(lower(l.text), lower(quote), chr(1)), chr(1)) AS ps FROM q JOIN lines l USING (doc_id, page)),
hit AS (SELECT * EXCLUDE (ps), (list_sum(list_transform(ps[1:i], lambda p: length(p))) + (i - 1) * length(quote))::BIGINT AS start
        FROM pos, LATERAL (SELECT unnest(range(1, len(ps))) AS i)),
located AS (SELECT * FROM (SELECT *, max(CASE WHEN line_no = named THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, item) AS near FROM hit) WHERE near = 0 OR line_no = named)"""

VISION = words(PLAIN) + """,
sizes AS (SELECT doc_id, page, greatest(612.0::DOUBLE, 6.0 * max(length(text)))::DOUBLE AS width, 840.0::DOUBLE AS height FROM slots GROUP BY ALL),
items(item, target, confidence, c0, r0, c1, r1) AS (VALUES (0, 'name', 0.95::DOUBLE, 0, 0, 3, 1), (1, 'photo', 0.7::DOUBLE, 1, 2, 2, 8)),
reg AS (SELECT doc_id, page, item, target, confidence, c0 * (width / 24) AS rx, r0 * (height / 36) AS ry, (c1 - c0 + 1) * (width / 24) AS rw, (r1 - r0 + 1) * (height / 36) AS rh FROM sizes, items),
met AS (SELECT r.*, w.word_id, w.ord, w.text, w.line, w.x, w.y, w.width, w.height,
               greatest(0, least(w.x + w.width, rx + rw) - greatest(w.x, rx)) * greatest(0, least(w.y + w.height, ry + rh) - greatest(w.y, ry)) / (w.width * w.height) AS share
        FROM reg r JOIN words w USING (doc_id, page)),
snapped AS (SELECT doc_id, page, item, target, confidence, line, string_agg(text, ' ' ORDER BY x, ord) AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height,
                   string_agg(word_id, ',' ORDER BY x, ord) AS word_ids FROM met WHERE share > 0.5 GROUP BY doc_id, page, item, target, confidence, line)"""

BOXES = """
boxes AS (SELECT l_orderkey AS doc_id, 0 AS page, ['email', 'phone', 'url'][l_linenumber % 3 + 1] AS target, l_linenumber AS line,
                 (l_quantity % 5 * 10)::DOUBLE AS x, (l_linenumber % 3 * 8)::DOUBLE AS y, (30 + l_quantity % 7 * 2 - CASE WHEN l_quantity % 11 = 0 THEN 60 ELSE 0 END)::DOUBLE AS width,
                 (12 + l_linenumber % 2 * 3)::DOUBLE AS height, CASE WHEN l_linenumber % 4 <> 0 THEN l_returnflag END AS text, 0.4::DOUBLE + l_discount * 4 AS confidence,
                 CASE WHEN l_linenumber % 2 = 0 THEN 'pattern' ELSE 'llm-text' END AS source, 'w' || (l_linenumber % 4) AS word_id FROM lineitem),
good AS (SELECT * FROM boxes WHERE confidence >= 0.5 AND width > 0.5 AND height > 0.5)"""
#: Whether region r and item e[1] stand for one place.
_SAME = """((e[1].x0 >= r.x0 - 1 AND e[1].y0 >= r.y0 - 1 AND e[1].x1 <= r.x1 + 1 AND e[1].y1 <= r.y1 + 1)
        OR (r.x0 >= e[1].x0 - 1 AND r.y0 >= e[1].y0 - 1 AND r.x1 <= e[1].x1 + 1 AND r.y1 <= e[1].y1 + 1)
        OR (least(r.x1, e[1].x1) > greatest(r.x0, e[1].x0) AND least(r.y1, e[1].y1) > greatest(r.y0, e[1].y0) AND
            (least(r.x1, e[1].x1) - greatest(r.x0, e[1].x0)) * (least(r.y1, e[1].y1) - greatest(r.y0, e[1].y0)) /
            ((r.x1 - r.x0) * (r.y1 - r.y0) + (e[1].x1 - e[1].x0) * (e[1].y1 - e[1].y0) - (least(r.x1, e[1].x1) - greatest(r.x0, e[1].x0)) * (least(r.y1, e[1].y1) - greatest(r.y0, e[1].y0))) > 0.5))"""


def merged(order: str) -> str:
    """CTEs from ``good`` to ``merged``: a fold over each page's items in order, as the engine's is."""
    return f""",
seqd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY {order}) AS n_ FROM good),
lists AS (SELECT doc_id, page, list({{target: target, x0: x, y0: y, x1: x + width, y1: y + height, text: text, confidence: confidence, source: source, ids: [word_id]}} ORDER BY n_) AS items FROM seqd GROUP BY doc_id, page),
start AS (SELECT doc_id, page, list_transform(items, lambda e: [e]) AS wrapped FROM lists),
folded AS (SELECT doc_id, page, list_reduce(wrapped, lambda acc, e: CASE
    WHEN len(list_filter(acc, lambda r: {_SAME})) = 0
    THEN list_concat(acc, e)
    ELSE list_transform(acc, lambda h, k: CASE WHEN k = list_position(list_transform(acc, lambda r: {_SAME}), true)
      THEN {{target: CASE WHEN h.target = e[1].target THEN h.target ELSE array_to_string(list_sort(list_distinct(string_split(h.target || '+' || e[1].target, '+'))), '+') END,
            x0: least(h.x0, e[1].x0), y0: least(h.y0, e[1].y0), x1: greatest(h.x1, e[1].x1), y1: greatest(h.y1, e[1].y1),
            text: CASE WHEN e[1].text IS NULL OR e[1].text = '' THEN h.text WHEN h.text IS NULL OR h.text = '' THEN e[1].text WHEN contains(h.text, e[1].text) THEN h.text ELSE h.text || ' | ' || e[1].text END,
            confidence: greatest(h.confidence, e[1].confidence), source: CASE WHEN e[1].source = 'pattern' THEN 'pattern' ELSE h.source END,
            ids: list_concat(h.ids, list_filter(e[1].ids, lambda i: NOT list_contains(h.ids, i)))}} ELSE h END) END) AS regions FROM start),
merged AS (SELECT doc_id, page, (i - 1)::INT AS ord, regions[i] AS r FROM folded, LATERAL (SELECT unnest(range(1, len(regions) + 1)) AS i))"""


MERGED = BOXES + merged("y, x, line, target, width, height, text NULLS FIRST, confidence, source, word_id")


def flagship() -> str:
    """All text patterns over documents, merged by page, counted by document."""
    shapes = [("email", EMAIL, 0, "true"), ("phone", PHONE, 0, PHONE_OK + " AND " + NOT_IN_URL), ("social", SOCIAL, 0, "true"), ("url", EXPLICIT, 0, "true"), ("url", PATH, 1, "true"), ("url", BARE, 1, "true"),
              ("dob", DOB, 0, "length(trim(raw)) > 3 AND " + NOT_IN_URL)]
    ctes, rows = [lines(PLAIN), URLS], []
    for k, (target, pattern, group, test) in enumerate(shapes):
        ctes.append(found(f"h{k}", pattern, group))
        order = ["email", "phone", "social", "url", "dob"].index(target)
        rows.append(f"SELECT doc_id, page, slot, line_no, text AS line, first, raw, start, '{target}' AS target, {order} AS n, {k} AS k FROM h{k} h WHERE trim(raw) <> '' AND {test}")
    return f"""WITH {','.join(ctes)}, hits AS ({' UNION ALL '.join(rows)}),
t AS (SELECT *, start + length(raw) - length(ltrim(raw)) AS b0, trim(raw) AS value FROM hits),
e AS (SELECT *, b0 - length(regexp_extract(line[1:b0], '[^ ]*$')) AS wb, b0 + length(value) + length(regexp_extract(substr(line, b0 + length(value) + 1), '^[^ ]*')) AS we FROM t),
good AS (SELECT doc_id, page, target, (6 * wb)::DOUBLE AS x, (14 * slot)::DOUBLE AS y, (6 * (we - wb))::DOUBLE AS width, 12.0::DOUBLE AS height, value AS text, 1.0::DOUBLE AS confidence, 'pattern' AS source, '' AS word_id, n, line_no, k, start FROM e)
{merged("y, x, n, line_no, k, start")},
c AS (SELECT doc_id, r.target AS target, count(*) AS n FROM merged GROUP BY ALL),
l AS (SELECT doc_id, string_agg(target || '=' || n, ',' ORDER BY target) AS counts FROM c GROUP BY doc_id)
SELECT doc_id, count(DISTINCT page) AS pages, coalesce(any_value(counts), '') AS counts FROM slots LEFT JOIN l USING (doc_id) GROUP BY doc_id"""


def painted(black: bool) -> str:
    """Pixels of the regions of a page, by place, and the ink of its words elsewhere: lines are wrapped after 200 characters, a character is 6 x 14 pixels of which 5 x 8 are ink."""
    ctes = [lines(PLAIN), URLS, found("h0", EMAIL), found("h1", PHONE)]
    return f"""WITH {','.join(ctes)},
t AS (SELECT *, start + length(raw) - length(ltrim(raw)) AS b0, trim(raw) AS value FROM (
  SELECT doc_id, page, slot, line_no, text AS line, raw, start, 'email' AS target, 0 AS n FROM h0 WHERE trim(raw) <> ''
  UNION ALL SELECT doc_id, page, slot, line_no, text, raw, start, 'phone', 1 FROM h1 h WHERE trim(raw) <> '' AND {PHONE_OK} AND {NOT_IN_URL})),
e AS (SELECT *, b0 - length(regexp_extract(line[1:b0], '[^ ]*$')) AS wb, b0 + length(value) + length(regexp_extract(substr(line, b0 + length(value) + 1), '^[^ ]*')) AS we FROM t),
good AS (SELECT doc_id, page, target, (6 * wb)::DOUBLE AS x, (14 * slot)::DOUBLE AS y, (6 * (we - wb))::DOUBLE AS width, 12.0::DOUBLE AS height, value AS text, 1.0::DOUBLE AS confidence, 'pattern' AS source, '' AS word_id, n, line_no, start FROM e)
{merged("y, x, n, line_no, start")},
tops AS (SELECT *, (sum(greatest(1, (length(text) + 199) // 200)) OVER (PARTITION BY doc_id, page ORDER BY slot) - greatest(1, (length(text) + 199) // 200))::BIGINT AS top FROM slots),
sizes AS (SELECT doc_id, page, greatest(612, 6 * least(max(length(text)), 200))::BIGINT AS width, greatest(840, 14 * sum(greatest(1, (length(text) + 199) // 200)))::BIGINT AS height,
                 (40 * sum(length(replace(text, ' ', ''))))::BIGINT AS ink FROM slots GROUP BY doc_id, page),
reg AS (SELECT m.doc_id, m.page, m.r.x0 AS x0, m.r.x1 AS x1, p.top, p.text FROM merged m JOIN tops p ON p.doc_id = m.doc_id AND p.page = m.page AND p.slot = floor(m.r.y0 / 14)),
parts AS (SELECT *, unnest(range(floor(x0 / 1200)::BIGINT, ceil(x1 / 1200)::BIGINT)) AS k FROM reg),
boxes AS (SELECT doc_id, page, text, top, greatest(0, greatest(x0 - k * 1200, 0) - 2) AS xa, least(s.width, least(x1 - k * 1200, 1200) + 2) AS xb,
                 greatest(0, (top + k) * 14 - 2) AS ya, least(s.height, (top + k) * 14 + 14) AS yb FROM parts JOIN sizes s USING (doc_id, page)),
cols AS (SELECT DISTINCT doc_id, page, ya, yb, unnest(range(floor(xa)::BIGINT, ceil(xb)::BIGINT)) AS px FROM boxes),
px AS (SELECT DISTINCT doc_id, page, px, unnest(range(floor(ya)::BIGINT, ceil(yb)::BIGINT)) AS py FROM cols),
inked AS (SELECT x.doc_id, x.page, count(*) AS n, count(*) FILTER (px % 6 < 5 AND py % 14 BETWEEN 2 AND 9 AND substr(p.text, ((py // 14 - p.top) * 200 + px // 6 + 1)::BIGINT, 1) NOT IN ('', ' ')) AS ink
          FROM px x LEFT JOIN tops p ON p.doc_id = x.doc_id AND p.page = x.page AND py // 14 >= p.top AND py // 14 < p.top + greatest(1, (length(p.text) + 199) // 200) GROUP BY x.doc_id, x.page)
SELECT doc_id, page, width, height, coalesce(n, 0)::BIGINT AS covered, {"coalesce(n, 0)::BIGINT AS black, " if black else ""}(s.ink - coalesce(i.ink, 0))::BIGINT AS ink FROM sizes s LEFT JOIN inked i USING (doc_id, page)"""


_FENCE = r"(?i)<(/?page_text>)"


def requests() -> str:
    """Digests of text requests: what stands around the transcript, and the numbered lines."""
    before, after = map(quoted, text_prompt_parts(resolve_targets(["name", "email"])))
    return f"""WITH RECURSIVE {lines(PLAIN)}, o AS (SELECT doc_id, page, line_no, text, length(text) + 8 AS cost FROM lines),
f AS (SELECT doc_id, page, line_no, text, 0 AS chunk, cost AS size FROM o WHERE line_no = 1
  UNION ALL SELECT o.doc_id, o.page, o.line_no, o.text, CASE WHEN size + o.cost > 12000 THEN chunk + 1 ELSE chunk END, CASE WHEN size + o.cost > 12000 THEN o.cost ELSE size + o.cost END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.line_no = f.line_no + 1)
SELECT doc_id, page, chunk, (row_number() OVER (PARTITION BY doc_id ORDER BY page, chunk) - 1)::INT AS call,
       md5({before} || string_agg(line_no || '| ' || regexp_replace(text, '{_FENCE}', '‹\\1', 'g'), chr(10) ORDER BY line_no) || {after}) AS digest, 1 AS ends
FROM f GROUP BY doc_id, page, chunk"""


_PLAN = """planned AS (SELECT doc_id, mode, has, CASE WHEN mode IN ('auto', 'text') THEN has ELSE false END AS plan_text, mode IN ('auto', 'vision') AS plan_vision,
  CASE WHEN mode = 'vision' OR (mode = 'auto' AND NOT has) THEN 'email,photo' WHEN mode = 'auto' THEN 'photo' ELSE '' END AS vision_targets
  FROM (SELECT doc_id, length(text) > 500 AS has FROM documents), (VALUES ('auto'), ('text'), ('vision'), ('patterns-only')) m(mode))"""


def label(k: str) -> str:
    """Letters of a column by place value, for up to three of them."""
    return f"""(CASE WHEN {k} < 26 THEN chr((65 + {k})::INT) WHEN {k} < 702 THEN chr((64 + {k} // 26)::INT) || chr((65 + {k} % 26)::INT)
      ELSE chr((65 + ({k} - 702) // 676)::INT) || chr((65 + ({k} - 702) // 26 % 26)::INT) || chr((65 + {k} % 26)::INT) END)"""


_A = f"(CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE '' END || {label('(c_custkey % 30)')} || CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END || (c_custkey % 40))"
_B = f"(lower({label('(c_custkey * 7 % 30)')}) || ' ' || (c_custkey * 3 % 45))"
_COL = lambda s: f"list_reduce(list_transform(string_split(upper(regexp_extract({s}, '[A-Za-z]+')), ''), lambda c: (ascii(c) - 64)::INT), lambda a, c: a * 26 + c) - 1"
_ROW = lambda s: f"(regexp_extract({s}, '[0-9]+')::INT - 1)"
_OK = lambda s: f"(regexp_matches({s}, '^\\s*[A-Za-z]{{1,3}}\\s*[0-9]{{1,3}}\\s*$') AND {_ROW(s)} >= 0)"


def oracle_sql() -> dict[str, str]:
    out = {
        "layout_lines": f"WITH {lines(PLAIN)} SELECT doc_id, page, slot, line_no, text, first FROM lines",
        "layout_words": f"WITH {words(PLAIN)} SELECT doc_id, page, word_id, ord, text, x, y, width, height, line FROM words",
        "lines_from_words": f"WITH {lines(PLAIN)} SELECT doc_id, page, line_no, text, len(string_split(text, ' ')) AS n_words FROM lines",
        "line_assign": f"""WITH RECURSIVE {words(PLAIN)},
o AS (SELECT doc_id, page, ord, y + ord % 3 * 6 AS y, row_number() OVER (PARTITION BY doc_id, page ORDER BY y + ord % 3 * 6, x, ord) AS n FROM words),
f AS (SELECT doc_id, page, ord, n, 0 AS line, y AS top, y + 12 AS low FROM o WHERE n = 1
  UNION ALL SELECT o.doc_id, o.page, o.ord, o.n, CASE WHEN o.y + 6 < top OR o.y + 6 > low THEN line + 1 ELSE line END,
    CASE WHEN o.y + 6 < top OR o.y + 6 > low THEN o.y ELSE least(top, o.y) END, CASE WHEN o.y + 6 < top OR o.y + 6 > low THEN o.y + 12 ELSE greatest(low, o.y + 12) END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.n = f.n + 1) SELECT doc_id, page, ord, line FROM f""",
        "reading_order": f"WITH {words(PLAIN)} SELECT doc_id, page, word_id, (row_number() OVER (PARTITION BY doc_id, page ORDER BY line, x, ord) - 1)::INT AS rank FROM words",
        "word_range_overlap": f"WITH {words(PLAIN)} SELECT doc_id, page, line_no, word_id, x, text FROM words WHERE x / 6 < 15 AND (x + width) / 6 > 5",
        "union_box_per_line": f"WITH {words(PLAIN)} SELECT doc_id, page, line, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM words GROUP BY doc_id, page, line",
        "detect_email": detect(DOCS, EMAIL, "email"),
        "detect_phone": detect(DOCS, PHONE, "phone", PHONE_OK, veto=True),
        "detect_phone_unguarded": detect(DOCS, PHONE, "phone"),
        "detect_social": detect(DOCS, SOCIAL, "social"),
        "detect_dob": detect(DOCS, DOB, "dob", "length(trim(raw)) > 3", veto=True),
        "detect_url_explicit": detect(WEB, EXPLICIT, "url"),
        "detect_url_path": detect(WEB, PATH, "url", group=1),
        "detect_url_bare": detect(WEB, BARE, "url", group=1),
        "custom_target": detect(DOCS, "[a-z]{3}ing of", "batch"),
        "url_veto_antijoin": f"WITH {lines(WEB)},{found('h0', PHONE)},{URLS} SELECT doc_id, page, line_no, start, raw FROM h0 h WHERE {PHONE_OK} AND NOT {NOT_IN_URL}",
        "link_annotations": f"WITH {LINKS} SELECT doc_id, page, link_ord, url, x, y, width, height FROM links",
        "link_words_join": f"WITH {LINKS} SELECT doc_id, page, link_ord, n AS n_words, text AS anchor FROM links",
        "link_context": f"""WITH {LINKS}, e AS (SELECT doc_id, page, '- ' || CASE WHEN text = '' THEN '(no visible text)' ELSE text END || ' -> ' || url AS entry, min(link_ord) AS k FROM links GROUP BY ALL)
SELECT doc_id, page, string_agg(entry, chr(10) ORDER BY k, entry) AS section FROM e GROUP BY doc_id, page""",
        "links_keep": links_sql("false", "NULL::VARCHAR"),
        "links_identifying": links_sql("named IS NOT NULL", _NAMED),
        "links_all": links_sql("true", f"CASE WHEN regexp_matches(url, {quoted(SOCIAL)}) THEN 'social' END"),
        "chunk_lines": f"""WITH RECURSIVE {lines(PLAIN)}, o AS (SELECT doc_id, page, line_no, length(text) + 8 AS cost FROM lines),
f AS (SELECT doc_id, page, line_no, cost, 0 AS chunk, cost AS size FROM o WHERE line_no = 1
  UNION ALL SELECT o.doc_id, o.page, o.line_no, o.cost, CASE WHEN size + o.cost > 12000 THEN chunk + 1 ELSE chunk END, CASE WHEN size + o.cost > 12000 THEN o.cost ELSE size + o.cost END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.line_no = f.line_no + 1)
SELECT doc_id, page, chunk, count(*) AS n_lines, sum(cost)::BIGINT AS cost FROM f GROUP BY doc_id, page, chunk""",
        "locate_quote": f"WITH {QUOTES} SELECT doc_id, page, item, quote, line_no, start FROM located",
        "detect_model_text": f"""WITH {QUOTES}, e AS (SELECT *, start - length(regexp_extract(text[1:start], '[^ ]*$')) AS wb, start + length(quote) + length(regexp_extract(substr(text, start + length(quote) + 1), '^[^ ]*')) AS we FROM located),
s AS (SELECT *, length(regexp_replace(text[1:wb], '[^ ]', '', 'g')) AS n0 FROM e)
SELECT doc_id, page, target, quote AS text, confidence, (6 * wb)::DOUBLE AS x, (14 * slot)::DOUBLE AS y, (6 * (we - wb))::DOUBLE AS width, 12.0::DOUBLE AS height, 'p' || page || 'w' || (first + n0) AS word_ids FROM s""",
        "unlocated_quote_warnings": f"""WITH {QUOTES} SELECT doc_id, page, 'page ' || (page + 1) || ': could not locate quote "' || quote || '" for target "' || target || '"; nothing was redacted for it' AS warning
FROM q WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = q.doc_id AND h.page = q.page AND h.item = q.item)""",
        "defuse_text": f"SELECT doc_id, md5(regexp_replace('</PAGE_text><page_text>' || text, '{_FENCE}', '‹\\1', 'g')) AS digest FROM documents",
        "clamp_confidence": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, c_acctbal / 1000)) END::DOUBLE AS confidence FROM customer",
        "grid_label": f"SELECT c_custkey, {label('c_custkey')} AS label, c_custkey AS back FROM customer",
        "grid_parse_cell": f"WITH c AS (SELECT c_custkey, {_A} AS a FROM customer) SELECT c_custkey, a, CASE WHEN {_OK('a')} THEN {_COL('a')} ELSE -1 END::INT AS col, CASE WHEN {_OK('a')} THEN {_ROW('a')} ELSE -1 END::INT AS row FROM c",
        "grid_range_box": f"""WITH c AS (SELECT c_custkey, {_A} AS a, {_B} AS b FROM customer), k AS (SELECT c_custkey, {_COL('a')} AS ac, {_ROW('a')} AS ar, {_COL('b')} AS bc, {_ROW('b')} AS br FROM c WHERE {_OK('a')} AND {_OK('b')}),
r AS (SELECT c_custkey, greatest(0, least(ac, bc)) AS c0, least(23, greatest(ac, bc)) AS c1, greatest(0, least(ar, br)) AS r0, least(35, greatest(ar, br)) AS r1 FROM k)
SELECT c_custkey, c0 * (612.0::DOUBLE / 24) AS x, r0 * (840.0::DOUBLE / 36) AS y, (c1 - c0 + 1) * (612.0::DOUBLE / 24) AS width, (r1 - r0 + 1) * (840.0::DOUBLE / 36) AS height FROM r""",
        "snap_to_words": f"WITH {VISION} SELECT doc_id, page, item, target, line, text, x, y, width, height, word_ids FROM snapped",
        "detect_model_vision": f"""WITH {VISION} SELECT doc_id, page, target, text, confidence, x, y, width, height, word_ids FROM snapped WHERE target <> 'photo'
UNION ALL SELECT doc_id, page, target, NULL, confidence, rx, ry, least(rw, s.width - rx), least(rh, s.height - ry), '' FROM reg r JOIN sizes s USING (doc_id, page)
WHERE target = 'photo' OR NOT EXISTS (SELECT 1 FROM snapped n WHERE n.doc_id = r.doc_id AND n.page = r.page AND n.item = r.item)""",
        "vision_warnings": f"""WITH {lines(PLAIN)} SELECT DISTINCT doc_id, page, 'page ' || (page + 1) || w AS warning FROM slots,
(VALUES (': unreadable grid reference "?":"B2" for target "school"; nothing was redacted for it'), (': grid reference off the page "AZ1":"BA2" for target "unknown"; nothing was redacted for it')) v(w)""",
        "merge_filter": f"WITH {BOXES} SELECT doc_id, page, target, x, y, width, height, text, confidence, source, line FROM good",
        "merge_detections": f"""WITH {MERGED} SELECT doc_id, page, ord, r.target AS target, r.x0 AS x, r.y0 AS y, r.x1 - r.x0 AS width, r.y1 - r.y0 AS height, r.text AS text, r.confidence AS confidence, r.source AS source, array_to_string(r.ids, ',') AS word_ids FROM merged""",
        "pad_detections": f"""WITH {MERGED} SELECT doc_id, page, ord, greatest(0, r.x0 - 2) AS x, greatest(0, r.y0 - 2) AS y, least(50, r.x1 + 2) - greatest(0, r.x0 - 2) AS width, least(20, r.y1 + 2) - greatest(0, r.y0 - 2) AS height FROM merged""",
        "plan_page": f"WITH {_PLAN} SELECT doc_id, mode, plan_text, plan_vision, vision_targets FROM planned",
        "page_warnings": f"""WITH {_PLAN} SELECT doc_id, mode, 0 AS ord, {quoted(NO_PROVIDER.replace('%d', '1'))} AS warning FROM planned WHERE plan_text OR plan_vision
UNION ALL SELECT doc_id, mode, 1, {quoted(NOTHING_READ.replace('%d', '1'))} FROM planned WHERE NOT has AND NOT plan_vision""",
        "audit_counts": f"WITH {MERGED}, c AS (SELECT doc_id, r.target AS target, count(*) AS n FROM merged GROUP BY ALL) SELECT doc_id, string_agg(target || '=' || n, ',' ORDER BY target) AS counts FROM c GROUP BY doc_id",
        "audit_distinct": "WITH f AS (SELECT l_orderkey, l_returnflag AS v, min(l_linenumber) AS k FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(v, ',' ORDER BY k, v) AS flags FROM f GROUP BY l_orderkey",
        "sniff_bytes": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'image' WHEN 4 THEN CASE WHEN doc_id % 12 >= 6 AND 4 + strlen(text) > 12 THEN 'image' ELSE 'unsupported' END ELSE 'unsupported' END AS kind FROM documents",
        "size_limits": """WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, (l_quantity * 72) * (l_quantity * 48) * 4 AS px FROM lineitem),
s AS (SELECT doc_id, count(*) AS n_pages, sum(px) AS total, max(px) AS most, min(page) FILTER (px > 40000000) AS big FROM p GROUP BY doc_id)
SELECT doc_id, n_pages, floor(total / 1e6 + 0.5)::INT AS megapixels, CASE WHEN n_pages > 6 THEN 'the document has ' || n_pages || ' pages, and the limit is 6'
  WHEN most > 40000000 THEN 'page ' || (big + 1) || ' is over the limit of 40 megapixels at 144 dpi'
  WHEN total > 200000000 THEN 'the document has ' || floor(total / 1e6 + 0.5)::INT || ' megapixels at 144 dpi, and the limit is 200' END AS error FROM s""",
        "redact_documents": flagship(),
        "text_requests": requests(),
        "paint_box": painted(True),
        "paint_label": painted(False),
        "paint_pixelate": painted(False),
        "paint_blur": painted(False),
        "grid_overlay": f"WITH {lines(PLAIN)} SELECT doc_id, page, greatest(612, 6 * least(max(length(text)), 200))::BIGINT + 60 AS width, greatest(840, 14 * sum(greatest(1, (length(text) + 199) // 200)))::BIGINT + 60 AS height FROM slots GROUP BY doc_id, page",
        "build_pdf": f"WITH {lines(PLAIN)} SELECT doc_id, count(DISTINCT page) AS pages, 0::BIGINT AS runs, 0::BIGINT AS links FROM slots GROUP BY doc_id",
        "pdf_runs": """SELECT c_custkey AS doc_id, 0 AS page, c_name AS text, (2 * (100 + c_custkey % 50) + 7 - 30)::DOUBLE AS "left", (2 * (c_custkey % 100) + 5 - 20)::DOUBLE AS baseline, 20.0::DOUBLE AS font_height FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT c_custkey, 1, c_mktsegment, (2 * (c_custkey % 100) + 5 - 20)::DOUBLE, (822 - 2 * (100 + c_custkey % 50) - 7)::DOUBLE, 20.0 FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT c_custkey, -1, 'UNSUPPORTED_INPUT', NULL, NULL, NULL FROM customer WHERE c_custkey % 10 = 0""",
        "advance_widths": f"""SELECT p_partkey, family, list_sum(list_transform(list_filter(string_split(p_name, ''), lambda c: c <> ''), lambda c: CASE family WHEN 'monospace' THEN {FIXED} WHEN 'serif' THEN {list(SERIF)}[ascii(c) - 31] ELSE {list(SANS)}[ascii(c) - 31] END))::DOUBLE AS width
FROM part, (VALUES ('monospace'), ('serif'), ('sans-serif')) f(family)""",
        "proxy_family": "SELECT p_partkey, ['monospace', 'serif', 'sans-serif', 'serif', 'monospace', 'serif'][p_partkey % 6 + 1] AS family FROM part",
        "words_from_runs": f"WITH {words(PLAIN)} SELECT doc_id, page, ord, text, x, round(y - 8.8, 3) AS y, width FROM words",
        "ocr_words": f"WITH {words(PLAIN)} SELECT doc_id, page, count(*) AS n_words, count(DISTINCT line) AS n_lines, sum(length(text))::BIGINT AS letters FROM words WHERE ord % 50 * 2 > 30 GROUP BY doc_id, page",
        "target_registry": "SELECT * FROM (VALUES " + ", ".join(f"({n}, '{t}', {dict(email=1, phone=1, social=1, url=3, dob=1).get(t, 0)}, {t in ('photo', 'signature')})" for n, t in enumerate(builtin_target_ids())) + ") v(ord, id, n_patterns, visual_only)",
    }
    return out
