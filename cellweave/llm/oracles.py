"""The queries that SQL can express, for another engine (DuckDB)."""

from __future__ import annotations

from .host_reputation import LEAST, MOST, RULES, SUFFIXES

_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP3 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) b FROM documents),
win AS (SELECT doc_id, i, b[i:i + 49] s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) i FROM d)),
first AS (SELECT s, min(doc_id) low FROM win GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT win.doc_id, win.i FROM win JOIN first USING (s) WHERE low < win.doc_id),
byte AS (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) i FROM d WHERE doc_id IN (SELECT doc_id FROM hit)),
cov AS (SELECT byte.doc_id, byte.i, hex(b[byte.i:byte.i]) h, coalesce(max(hit.i) OVER (PARTITION BY byte.doc_id ORDER BY byte.i) >= byte.i - 49, false) gone FROM byte LEFT JOIN hit ON hit.doc_id = byte.doc_id AND hit.i = byte.i),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) starts FROM cov),
told AS (SELECT doc_id, count(*) FILTER (gone) n_removed, count(*) FILTER (starts) n_spans, string_agg(h, '' ORDER BY i) FILTER (NOT gone) kept FROM edge GROUP BY doc_id)
SELECT doc_id, octet_length(b) n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, CASE WHEN n_removed IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(kept, ''))) END kept_sha256 FROM d LEFT JOIN told USING (doc_id)"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) i FROM d)),
first AS (SELECT s, min(doc_id) low FROM win GROUP BY s),
hit AS (SELECT win.doc_id, win.i FROM win JOIN first USING (s) WHERE low < win.doc_id),
word AS (SELECT doc_id, unnest(ws) w, unnest(range(1, len(ws) + 1)) i FROM d),
cov AS (SELECT word.doc_id, word.i, w, coalesce(max(hit.i) OVER (PARTITION BY word.doc_id ORDER BY word.i) >= word.i - 49, false) gone FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND hit.i = word.i),
told AS (SELECT doc_id, count(*) FILTER (gone) n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) kept FROM cov GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN told USING (doc_id)"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORDS}') ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id a, b.doc_id b, count(*) o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
side AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id v, doc_id r FROM documents UNION SELECT side.b, reach.r FROM reach JOIN side ON side.a = reach.v)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, (SELECT min(r) FROM reach WHERE v = d.doc_id) component_id FROM d LEFT JOIN n USING (doc_id)"""


def _level(name: str, rows: str, parent: str, key: str, weight: str) -> str:
    """One level's rates, shrunk to its parents' by a weight fitted to the level."""
    return f"""{name}0 AS (SELECT x.*, {parent} p FROM {rows} x {key}),
{weight} AS (SELECT CASE WHEN rho > 0 THEN greatest({LEAST}, least({MOST}, 1/rho - 1)) ELSE {MOST} END k FROM (SELECT coalesce(sum(pow(good - n*p, 2) - n*p*(1 - p)) / nullif(sum(n*(n - 1)*p*(1 - p)), 0), 0) rho FROM {name}0)),
{name} AS (SELECT *, (good + k*p)/(n + k) rate FROM {name}0 CROSS JOIN {weight})"""


_RULE = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{h + p!r}, {v!r}}}".replace("{'", "{rule: '").replace("', '", "', verdict: '") for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r)))
_TWO = ", ".join(f"'{x}'" for x in SUFFIXES)
OP10 = f"""
WITH v AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
w AS (SELECT page_id, string_split(string_split(rest, '#')[1], '?')[1] cut FROM v),
u0 AS (SELECT page_id, translate(string_split(cut, '/')[1], {_LOWER}) host, CASE WHEN contains(cut, '/') THEN substr(cut, strpos(cut, '/')) ELSE '' END path FROM w),
u1 AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') nam, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') l FROM u0),
u2 AS (SELECT *, array_to_string(l[-2:], '.') two, regexp_matches(nam, '^([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|\\[.*)$') num FROM u1),
u AS (SELECT page_id, host, path, CASE WHEN num THEN nam WHEN two IN ({_TWO}) THEN array_to_string(l[-3:], '.') ELSE two END dom, CASE WHEN num THEN 'address' WHEN two IN ({_TWO}) AND nam <> two THEN two ELSE l[-1] END suf FROM u2),
hs AS (SELECT host, count(*) n, CAST(sum(quality) AS DOUBLE) good, any_value(dom) dom, any_value(suf) suf FROM u JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY host),
ds AS (SELECT suf, dom, CAST(sum(n) AS BIGINT) n, sum(good) good FROM hs GROUP BY 1, 2),
ss AS (SELECT suf, CAST(sum(n) AS BIGINT) n, sum(good) good FROM ds GROUP BY 1),
{_level("s", "ss", "(SELECT (sum(good) + 1)/(sum(n) + 2) FROM ss)", "", "ks")},
{_level("m", "ds", "s.rate", "JOIN s ON s.suf = x.suf", "km")},
{_level("h", "hs", "m.rate", "JOIN m ON m.dom = x.dom", "kh")},
a AS (SELECT x.host, coalesce(h.rate, m.rate, s.rate, (SELECT (sum(good) + 1)/(sum(n) + 2) FROM ss)) rate, coalesce(h.n, 0) n FROM (SELECT DISTINCT host, dom, suf FROM u) x LEFT JOIN h ON h.host = x.host LEFT JOIN m ON m.dom = x.dom LEFT JOIN s ON s.suf = x.suf),
b AS (SELECT host, rate, rate + 1.645*sqrt(rate*(1 - rate)/(n + kh.k + 1)) bound FROM a CROSS JOIN kh),
r AS (SELECT u.*, rate, bound, CASE {_RULE} END m FROM u LEFT JOIN b USING (host))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, CASE WHEN bound < 0.8 THEN 'block' ELSE 'allow' END) verdict, round(rate, 6) rate, round(bound, 6) bound FROM r"""


_FINITE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
_D2 = " + ".join(f"(p.v[{k}] - e.v[{k}]) * (p.v[{k}] - e.v[{k}])" for k in range(1, 5))


def _round(n: int) -> str:
    """The nearest entries of codebooks c<n>, and the codebooks after them."""
    floors = ", ".join(f"CAST((sum(p.v[{k}]) - ((sum(p.v[{k}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for k in range(1, 5))
    return f"""
a{n} AS MATERIALIZED (SELECT p.vec_id, p.part, min({{d: {_D2}, entry: e.entry}}) m FROM p JOIN c{n} e ON e.part = p.part GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(u.v, c.v) v FROM c{n} c LEFT JOIN (SELECT a.part, a.m.entry entry, [{floors}] v FROM a{n} a JOIN p ON p.vec_id = a.vec_id AND p.part = a.part GROUP BY 1, 2) u ON u.part = c.part AND u.entry = c.entry)"""


OP12 = f"""
WITH x AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) x FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT vec_id, part, x[part*4 + 1:part*4 + 4] v FROM x CROSS JOIN (SELECT unnest(range(16)) part)),
c0 AS MATERIALIZED (SELECT part, k - 1 entry, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) k FROM x) USING (vec_id) WHERE k <= 64),
{_round(0)}, {_round(1)},
f AS (SELECT p.vec_id, p.part, min({{d: {_D2}, entry: e.entry}}) m FROM p JOIN c2 e ON e.part = p.part GROUP BY 1, 2),
t AS (SELECT vec_id, string_agg(format('{{:02x}}', m.entry), '' ORDER BY part) code, CAST(sum(m.d) AS BIGINT) error FROM f GROUP BY 1),
g AS (SELECT label, CAST(sum(error) AS BIGINT) label_error FROM t JOIN x USING (vec_id) GROUP BY 1)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c2) codebooks_sha256 FROM t JOIN x USING (vec_id) JOIN g ON g.label IS NOT DISTINCT FROM x.label"""

# a SHA-1 is eight groups of five hex digits, each of them four base32 digits
_DIGIT = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(CAST('0x' || h[{5 * g + 1}:{5 * g + 5}] AS INT) >> {s}) % 32 + 1]" for g in range(8) for s in (15, 10, 5, 0))
OP13 = f"""
WITH t AS (SELECT page_id, coalesce(html, '') b, sha1(coalesce(html, '')) h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY b) last FROM t)
SELECT page_id, CAST(strlen(b) AS BIGINT) payload_bytes, {_DIGIT} payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> last THEN last END refers_to FROM r"""
