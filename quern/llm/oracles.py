"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quern.llm.fingerprints import DIGITS, K, WORDS
from quern.llm.linededup import DIGITS as LINE_DIGITS
from quern.llm.linededup import WINDOW
from quern.llm.mixing import BUCKET_ROWS, MOST, SEED, SHARE
from quern.llm.substrings import CUT, SPAN_WORDS, STOPS, UNIT, UNSPACED

_WS = r"[\x20\x09-\x0D]+"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


def _sketch(text: str) -> str:
    w = f"list_transform([{_words(_LOW.format(text))}], lambda w: list_transform(range(1, greatest(len(w) - {WORDS - 1}, least(len(w), 1)) + 1), lambda i: substr(md5(array_to_string(w[i:i + {WORDS - 1}], ' ')), 1, {DIGITS})))[1]"
    return f"list_sort(list_distinct({w}))[1:{K}]"


def _near(a: str, b: str) -> str:
    u = f"list_sort(list_distinct(list_concat({a}, {b})))[1:{K}]"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect({u}, {a}), {b})) / len({u})::DOUBLE END"


OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS nxt FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) AS edited FROM n),
s AS (SELECT *, {_sketch('text')} AS a, {_sketch('edited')} AS b, {_sketch('nxt')} AS c FROM e)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  {_near('a', 'b')} AS near_edited, {_near('a', 'c')} AS near_next FROM s
"""


#: Rows (doc_id, i, x, m, z): the lines of each text, their MD5 and their characters.
OP2 = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS u FROM documents),
l AS (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM d),
h AS (SELECT doc_id, i, md5(x) AS m, length(trim(x, {_BLANKS})) AS z FROM l),
s AS (SELECT *, sum(z) OVER (PARTITION BY doc_id ORDER BY i) - z AS c, sum(z) OVER (PARTITION BY doc_id) AS total FROM h WHERE z > 0),
w AS (SELECT doc_id, min(substr(m, 1, {LINE_DIGITS}) || printf('%09d', 999999999 - i)) OVER (PARTITION BY doc_id ORDER BY c RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS best, c, total FROM s),
p AS (SELECT DISTINCT doc_id, 999999999 - substr(best, {LINE_DIGITS + 1})::INTEGER AS i FROM w WHERE c + {WINDOW} <= total),
f AS (SELECT p.doc_id, p.i, m, coalesce(lag(p.i) OVER v, 1) AS lo, coalesce(lead(p.i) OVER v, (SELECT max(i) FROM l WHERE l.doc_id = p.doc_id)) AS hi FROM p JOIN h ON h.doc_id = p.doc_id AND h.i = p.i WINDOW v AS (PARTITION BY p.doc_id ORDER BY p.i)),
r AS (SELECT *, first_value(struct_pack(d := doc_id, i := i, lo := lo, hi := hi)) OVER (PARTITION BY m ORDER BY doc_id NULLS FIRST, i) AS o FROM f),
later AS (SELECT * FROM r WHERE o.d IS DISTINCT FROM doc_id OR o.i <> i),
-- lines around a fingerprint beside those around its first occurrence; the nearest unequal ones bound the match
e AS (SELECT later.doc_id, later.i AS p, a.i, a.m IS NOT DISTINCT FROM b.m AS same FROM later JOIN h a ON a.doc_id = later.doc_id AND a.i BETWEEN later.lo AND later.hi
  LEFT JOIN h b ON b.doc_id = later.o.d AND b.i = a.i - later.i + later.o.i AND b.i BETWEEN later.o.lo AND later.o.hi),
x AS (SELECT doc_id, p, coalesce(max(i) FILTER (NOT same AND i < p), 0) AS lo, coalesce(min(i) FILTER (NOT same AND i > p), 1000000000) AS hi FROM e GROUP BY doc_id, p),
hit AS (SELECT DISTINCT e.doc_id, e.i FROM e JOIN x ON x.doc_id = e.doc_id AND x.p = e.p AND e.i > x.lo AND e.i < x.hi),
n AS (SELECT hit.doc_id, hit.i, z, hit.i - row_number() OVER (PARTITION BY hit.doc_id ORDER BY hit.i) AS stretch FROM hit JOIN h ON h.doc_id = hit.doc_id AND h.i = hit.i),
g AS (SELECT doc_id, list(i) AS gone FROM (SELECT doc_id, i, sum(z) OVER (PARTITION BY doc_id, stretch) AS size FROM n) WHERE size >= {WINDOW} GROUP BY doc_id),
o AS (SELECT d.doc_id, u, CASE WHEN gone IS NULL THEN u ELSE list_filter(u, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, coalesce(len(u), 0)::BIGINT AS n_lines, coalesce(len(u) - len(kept), 0)::BIGINT AS n_removed, length(array_to_string(kept, chr(10)))::BIGINT AS n_chars_left,
  sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM o
"""

_ALONE = "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in UNSPACED)
_TOKEN = rf"(?:[{_ALONE}]|[^\x20\x09-\x0D{_ALONE}]+)[\x20\x09-\x0D]*"
#: Words (doc_id, i, x with the white space behind it, w folded), sentences (doc_id, s, x, w, n words), spans.
OP10 = f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS u, regexp_extract(coalesce(text, ''), '^{_WS}') AS lead FROM documents),
k AS (SELECT doc_id, lead, unnest(u) AS x, generate_subscripts(u, 1) AS i, len(u) AS n FROM t),
w AS (SELECT doc_id, i, CASE WHEN i = 1 THEN lead || x ELSE x END AS x, {_LOW.format(f"rtrim(x, {_BLANKS})")} AS w, i = n AS ends FROM k),
c AS (SELECT *, ends OR contains('{STOPS}', right(w, 1)) OR (31 * unicode(right(rtrim(x, {_BLANKS}), 1)) + 17 * length(w)) % {CUT} = 0 AS cut FROM w),
g AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM c),
q AS (SELECT *, cut OR row_number() OVER (PARTITION BY doc_id, g ORDER BY i) % {UNIT} = 0 AS last FROM g),
s AS (SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM q),
u AS (SELECT doc_id, s, string_agg(x, '' ORDER BY i) AS x, string_agg(w, ' ' ORDER BY i) AS w, count(*) AS n, min(i) - 1 AS before FROM s GROUP BY doc_id, s),
v AS (SELECT doc_id, s, before, count(*) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {SPAN_WORDS - 1} FOLLOWING) AS m, sum(n) OVER (PARTITION BY doc_id) AS total FROM u),
lists AS (SELECT doc_id, list(w ORDER BY s) AS ws FROM u GROUP BY doc_id),
r AS (SELECT v.doc_id, v.s, v.m, array_to_string(ws[v.s + 1:v.s + m], ' ') AS h FROM v JOIN lists ON lists.doc_id = v.doc_id WHERE before + {SPAN_WORDS} <= total),
later AS (SELECT doc_id, s, m FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, s) AS rn FROM r) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s::BIGINT, (s + m)::BIGINT)) AS s FROM later),
o AS (SELECT u.doc_id, count(*) AS n, count(gone.s) AS removed, string_agg(x, '' ORDER BY u.s) FILTER (gone.s IS NULL) AS left_ FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.s = u.s GROUP BY u.doc_id),
z AS (SELECT t.doc_id, coalesce(n, 0) AS n, coalesce(removed, 0) AS removed, CASE WHEN coalesce(removed, 0) = 0 THEN text ELSE coalesce(left_, '') END AS kept FROM t LEFT JOIN o ON o.doc_id = t.doc_id)
SELECT doc_id, n::BIGINT AS n_sentences, removed::BIGINT AS n_removed, length(kept)::BIGINT AS n_chars_left, sha256(kept) AS text_sha256 FROM z
"""

_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INTEGER + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
OP4 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, payload_bytes, {_B32} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to FROM q
"""

OP7 = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_words(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t),
c AS (SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(list_sort(s), chr(10))) AS k, s FROM s),
rep AS (SELECT k, min(doc_id) AS rep, any_value(s) AS s, any_value(n) AS n FROM c WHERE n > 0 GROUP BY k),
x AS (SELECT rep, n, unnest(s) AS sh FROM rep),
df AS (SELECT sh, count(*) AS df FROM x GROUP BY sh),
-- a pair at 0.8 shares a shingle among the rarest fifth (and one) of either side
ranked AS (SELECT rep, n, sh, row_number() OVER (PARTITION BY rep ORDER BY df, sh) AS rn FROM x JOIN df USING (sh)),
prefix AS (SELECT rep, n, sh FROM ranked WHERE rn <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefix a JOIN prefix b ON a.sh = b.sh AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
sized AS (SELECT a, b, ra.n AS na, rb.n AS nb, len(list_intersect(ra.s, rb.s)) AS i FROM cand JOIN rep ra ON ra.rep = a JOIN rep rb ON rb.rep = b),
e AS (SELECT a, b FROM sized WHERE 100 * i >= 80 * (na + nb - i)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk(node, root) AS (SELECT rep, rep FROM rep UNION SELECT b, root FROM walk JOIN sym ON a = node),
comp AS (SELECT node, min(root) AS root FROM walk GROUP BY node)
SELECT c.doc_id, c.n AS n_shingles, coalesce(comp.root, c.doc_id) AS component_id, c.doc_id = coalesce(comp.root, c.doc_id) AS kept
FROM c LEFT JOIN rep ON c.n > 0 AND rep.k = c.k LEFT JOIN comp ON comp.node = rep.rep
"""


def mix_sql(documents: str = "documents") -> str:
    """Common table expressions ending in mixed(doc_id, text, lang, source, n_chars, size, ..., copies)."""
    return f"""
sized AS (SELECT *, len({_words("coalesce(text, '')")})::BIGINT AS size FROM {documents}),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source),
w AS (SELECT *, [3, 1, 2][(r - 1) % 3 + 1] AS w, source_size * {MOST} AS cap FROM src),
o AS (SELECT *, sum(source_size) OVER () * {SHARE} - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM w),
f AS (SELECT *, cap * weights <= rest * w AS capped FROM o),
tg AS (SELECT source, source_size, n, CASE WHEN capped THEN cap::DOUBLE ELSE w * (max(rest) FILTER (NOT capped) OVER ())::DOUBLE / (max(weights) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM f),
b AS (SELECT sized.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS c,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % ceil(n / {BUCKET_ROWS}.0)::BIGINT AS bucket,
  ('0x' || substr(md5('{SEED}|' || coalesce(sized.source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized JOIN tg ON sized.source IS NOT DISTINCT FROM tg.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, size, doc_id NULLS FIRST) AS i FROM b),
mixed AS (SELECT *, least(floor(u + i * c) - floor(u + (i - 1) * c), {MOST})::BIGINT AS copies FROM ranked)
"""


OP8 = f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed"

ORACLES = {"op1_fingerprints": OP1, "op2_line_dedup": OP2, "op4_warc": OP4, "op7_minhash": OP7, "op8_mixing": OP8, "op10_substrings": OP10}
