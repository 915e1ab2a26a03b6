"""DuckDB SQL for the numbered queries that SQL can express on whole tables.

None for mixing (random rounding), language id (a trained model), packing and token files
(a tokenizer): those are tested against brute force, held-out accuracy and round trips.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY rid),
m AS (SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
   len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
   (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
    - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
   coalesce(n, 0)::BIGINT AS n_repeat_words
   FROM d LEFT JOIN cov ON d.rid = cov.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM f GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE / sum(n) AS mean, count(*) AS hosts FROM h),
s AS (SELECT sum(h.n * power(h.k::DOUBLE / h.n - t.mean, 2)) / min(t.n) - (min(t.hosts) - 1) * min(t.mean * (1 - t.mean)) / min(t.n) AS between_hosts FROM h, t),
p AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / between_hosts - 1)) ELSE 1e6 END AS weight FROM t, s),
v AS (SELECT source, n, k, (k + mean * weight) / (n + weight) <= 0.5 AS ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND ok) AS kept,
  v.n::BIGINT AS n_host_docs, v.k::BIGINT AS n_host_failed
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM rep),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT word.rid, string_agg(x, ' ' ORDER BY word.j) AS t FROM word LEFT JOIN gone ON word.rid = gone.rid AND word.j = gone.j WHERE gone.j IS NULL GROUP BY word.rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN kept ON d.rid = kept.rid"""

REACH = """
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a)"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, s FROM (
  SELECT rid, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT rid, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
common AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.rid < y.rid GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON a = x.rid JOIN n y ON b = y.rid WHERE 100 * c >= 80 * (x.n + y.n - c)),
ids AS (SELECT x.doc_id AS a, y.doc_id AS b FROM links JOIN d x ON links.a = x.rid JOIN d y ON links.b = y.rid),
both_ways AS (SELECT a, b FROM ids UNION SELECT b, a FROM ids),{REACH}
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low.c, doc_id)) AS component_id
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN low ON d.doc_id = low.a"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
good AS (SELECT vec_id, v FROM d WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),{REACH},
deg AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.c, vec_id)) AS component_id,
  least(vec_id, coalesce(low.c, vec_id)) = vec_id AS kept
FROM d LEFT JOIN deg ON vec_id = deg.a LEFT JOIN low ON vec_id = low.a"""


def _spans(kind: str, order: int, pattern: str, good: str) -> str:
    """Spans of a pattern: matches and the text between them, lengths summed up."""
    p = pattern.replace("'", "''")
    return f"""
{kind}_m AS (SELECT rid, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS x, unnest(list_slice(g, 1, len(m))) AS gap
  FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d) WHERE len(m) > 0),
{kind}_s AS (SELECT rid, {order} AS ord, '{kind}' AS kind, (sum(length(gap) + length(x)) OVER (PARTITION BY rid ORDER BY i) - length(x))::BIGINT AS s,
  (sum(length(gap) + length(x)) OVER (PARTITION BY rid ORDER BY i))::BIGINT AS e, {good} AS ok FROM {kind}_m)"""


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_P = ASSIGN.replace("'", "''")
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_spans('assign', 0, ASSIGN, f"length(regexp_extract(x, '{_P}', 2)) >= 12")},
{_spans('access', 1, 'AKIA[A-Z0-9]+', 'length(x) >= 18')},
{_spans('hex', 2, '[0-9a-f]{16,}', 'true')},
{_spans('ident', 3, '''(?i:access_?key_?id|client_?id|account|username|login)["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9_.@-]+''', 'true')},
{_spans('opaque', 4, '[A-Za-z0-9+/_-]{20,}', "regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')")},
{_spans('endpoint', 5, '(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!&=%+-]+', 'true')},
s AS (SELECT rid, ord, kind, s, e FROM (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s
  UNION ALL SELECT * FROM ident_s UNION ALL SELECT * FROM opaque_s UNION ALL SELECT * FROM endpoint_s) WHERE ok),
weak AS (SELECT * FROM s x WHERE ord >= 3 AND NOT EXISTS (SELECT 1 FROM s y WHERE y.rid = x.rid AND y.ord < 3 AND y.s < x.e AND x.s < y.e)),
part AS (SELECT * FROM s WHERE ord < 3 UNION ALL SELECT * FROM weak),
linked AS (SELECT * FROM weak x WHERE
  (ord = 5 OR ord = 3 OR EXISTS (SELECT 1 FROM part y WHERE y.rid = x.rid AND y.ord IN (1, 3) AND abs(x.s - y.s) <= 200)) AND
  (ord = 4 OR EXISTS (SELECT 1 FROM part y WHERE y.rid = x.rid AND y.ord IN (0, 2, 4) AND abs(x.s - y.s) <= 200)) AND
  (ord <> 5 OR EXISTS (SELECT 1 FROM part y WHERE y.rid = x.rid AND y.ord IN (1, 3) AND abs(x.s - y.s) <= 200))),
every AS (SELECT rid, s, ord, kind || ':' || s || ':' || e AS x FROM s WHERE ord < 3 UNION ALL SELECT rid, s, ord, kind || ':' || s || ':' || e FROM linked),
per AS (SELECT rid, count(*) FILTER (WHERE ord = 0) AS n0, count(*) FILTER (WHERE ord = 1) AS n1, count(*) FILTER (WHERE ord = 2) AS n2,
  string_agg(x, ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base, string_agg(x, ',' ORDER BY s, ord) AS spans FROM every GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per ON d.rid = per.rid"""

KEY = LOWER.format("trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT rid, doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM d),
keyed AS (SELECT *, {KEY} AS k FROM line),
held AS (SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
kept AS (SELECT rid, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS t FROM keyed LEFT JOIN held USING (k)
  WHERE first IS NULL OR first = coalesce(doc_id, 9223372036854775807) GROUP BY rid)
SELECT doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.rid = kept.rid"""

# crc32 of a decimal number's digits: the table by its rule, then a fold over the bytes
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab)"""


def crc32(number: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({number}::VARCHAR) + 1), lambda i: ord(substr({number}::VARCHAR, i::INT, 1))::BIGINT)),
  lambda c, b: xor(c >> 8, tab[(1 + (xor(c, b) & 255))::INT])), 4294967295::BIGINT)"""


OP11 = rf"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len({WORDS})::BIGINT AS w,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS c, conv_id - ((conv_id % 20) + 20) % 20 AS b, {crc32('conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
both_parts AS (SELECT c, 0 AS part, k, x, w FROM c JOIN t ON t.conv_id = b AND k <= h UNION ALL SELECT c, 1, k, x, w FROM c JOIN t ON t.conv_id = c AND k > h),
rebuilt AS (SELECT c, w, row_number() OVER o AS d, string_agg(x, '') OVER o AS p FROM both_parts WINDOW o AS (PARTITION BY c ORDER BY part, k)),
m AS (SELECT c, d, p, w FROM rebuilt UNION ALL SELECT c, 0, '', 0 FROM c),
node AS (SELECT d, p, min(c) AS r, count(*) AS n, min(w) AS w FROM m GROUP BY d, p),
of AS (SELECT m.c, m.d, node.r FROM m JOIN node ON m.d = node.d AND m.p = node.p),
up AS (SELECT node.d, node.r, n, w, of.r AS parent FROM node LEFT JOIN of ON of.c = node.r AND of.d = node.d - 1),
kids AS (SELECT d - 1 AS d, parent AS r, count(*) AS k FROM up WHERE d > 0 GROUP BY ALL),
own AS (SELECT up.*, coalesce(k, 0) AS k FROM up LEFT JOIN kids ON up.d = kids.d AND up.r = kids.r),
sub AS (SELECT of.d, of.r, sum(CASE WHEN own.k = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves, sum((own.n - 1) * own.w)::BIGINT AS saved
  FROM own JOIN of ON of.c = own.r AND of.d <= own.d GROUP BY of.d, of.r),
long AS (SELECT c, max(d) AS d FROM m GROUP BY c),
ends AS (SELECT of.d, of.r, string_agg(of.c::VARCHAR, ',' ORDER BY of.c) AS ids FROM of JOIN long ON of.c = long.c AND of.d = long.d GROUP BY of.d, of.r)
SELECT own.r::BIGINT AS conv_id, own.d::BIGINT AS depth, own.parent::BIGINT AS parent_conv_id, own.n::BIGINT AS n_convs, own.k::BIGINT AS n_children, leaves AS n_leaves, saved AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN sub ON own.d = sub.d AND own.r = sub.r LEFT JOIN ends ON own.d = ends.d AND own.r = ends.r"""


def _leaf(text: str) -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12 = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid, {_leaf('text')} AS leaf,
  {_leaf(f"CASE WHEN {crc32('doc_id')} % 5 = 0 THEN {LOWER.format('text')} ELSE text END")} AS other FROM documents, crc),
e AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
node(sid, level, idx, h) AS (SELECT sid, 0::BIGINT, idx, leaf FROM e UNION ALL
  SELECT sid, level + 1, p, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, idx // 16 AS p, count(*) OVER (PARTITION BY sid) AS c FROM node) WHERE c > 1 GROUP BY sid, level, p),
tall AS (SELECT sid, max(level) AS top, max_by(h, level) AS subroot FROM node GROUP BY sid),
upper_node(level, idx, h) AS (SELECT 0::BIGINT, sid, subroot FROM tall UNION ALL
  SELECT level + 1, p, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, idx // 16 AS p, count(*) OVER () AS c FROM upper_node) WHERE c > 1 GROUP BY level, p),
peak AS (SELECT max(level) AS top, max_by(h, level) AS root FROM upper_node),
f1(rid, sid, level, idx, h) AS (SELECT rid, sid, 0::BIGINT, idx, other FROM e UNION ALL
  SELECT f1.rid, f1.sid, f1.level + 1, f1.idx // 16, sha256(string_agg(CASE WHEN n.idx = f1.idx THEN f1.h ELSE n.h END, '' ORDER BY n.idx))
  FROM f1 JOIN tall ON tall.sid = f1.sid AND f1.level < tall.top JOIN node n ON n.sid = f1.sid AND n.level = f1.level AND n.idx // 16 = f1.idx // 16 GROUP BY f1.rid, f1.sid, f1.level, f1.idx),
f2(rid, level, idx, h) AS (SELECT rid, 0::BIGINT, f1.sid, h FROM f1 JOIN tall ON tall.sid = f1.sid AND f1.level = tall.top UNION ALL
  SELECT f2.rid, f2.level + 1, f2.idx // 16, sha256(string_agg(CASE WHEN n.idx = f2.idx THEN f2.h ELSE n.h END, '' ORDER BY n.idx))
  FROM f2 JOIN peak ON f2.level < peak.top JOIN upper_node n ON n.level = f2.level AND n.idx // 16 = f2.idx // 16 GROUP BY f2.rid, f2.level, f2.idx),
sib AS (SELECT rid, 0 AS part, f1.level, n.idx, n.h FROM f1 JOIN node n ON n.sid = f1.sid AND n.level = f1.level AND n.idx // 16 = f1.idx // 16 AND n.idx <> f1.idx
  UNION ALL SELECT rid, 1, f2.level, n.idx, n.h FROM f2 JOIN upper_node n ON n.level = f2.level AND n.idx // 16 = f2.idx // 16 AND n.idx <> f2.idx),
proof AS (SELECT rid, string_agg(h, '' ORDER BY part, level, idx) AS p FROM sib GROUP BY rid)
SELECT e.doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, f2.h AS folded_root, f2.h = root AS verified
FROM e JOIN tall ON e.sid = tall.sid JOIN peak ON true JOIN f2 ON f2.rid = e.rid AND f2.level = peak.top LEFT JOIN proof ON proof.rid = e.rid"""

OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT *, sha1(t) AS h, row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS k, first(page_id) OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS f FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM d"""

SQL: dict[str, str] = {
    "op2_host_rules": OP2, "op3_substring_dedup": OP3, "op4_jaccard_join": OP4, "op6_embedding_dedup": OP6,
    "op8_credential_links": OP8, "op10_line_dedup": OP10, "op11_conversation_trie": OP11, "op12_merkle_manifest": OP12, "op13_warc_pages": OP13,
}
