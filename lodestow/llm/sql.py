"""DuckDB statements of the numbered operators that SQL can express."""

from __future__ import annotations

_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
_IP = "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)"
_CARD = "[0-9](?:[\\x20-]?[0-9])+"
_PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
_TERM = "[\\p{L}\\p{N}]+"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_MATCHES = " UNION ALL ".join(
    f"SELECT rid, '{kind}' AS kind, {k} AS k, string_split_regex(t, '{pattern}') AS segs, regexp_extract_all(t, '{pattern}') AS ms FROM d WHERE regexp_matches(t, '{pattern}')" for k, (kind, pattern) in enumerate((("email", _EMAIL), ("ip", _IP), ("card", _CARD), ("phone", _PHONE)))
)

OP2 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ({_MATCHES}),
x AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
p AS (SELECT rid, kind, k, ms[i] AS v, list_sum(list_transform(segs[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda q: length(q))), 0) AS s FROM x),
b AS (SELECT rid, kind, k, v, CAST(s AS BIGINT) AS s, CAST(s + length(v) AS BIGINT) AS e FROM p WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda q: length(ltrim(q, '0')) <= 3 AND CAST(right(q, 9) AS INTEGER) <= 255))
  WHEN 'card' THEN length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INTEGER)
    ELSE (2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INTEGER)) // 10 + (2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INTEGER)) % 10 END)) % 10 = 0
  ELSE length({_DIGITS}) BETWEEN 10 AND 15 END),
ls AS (SELECT rid, string_split(t, chr(10)) AS l FROM d), li AS (SELECT rid, l, unnest(range(1, len(l) + 1)) AS pos FROM ls),
lines AS (SELECT rid, pos, l[pos] AS line, coalesce(list_sum(list_transform(l[1:pos - 1], lambda q: length(q) + 1)), 0) AS place FROM li),
nl AS (SELECT count(*) AS n FROM lines),
nt AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(line), '{_TERM}'))) AS term FROM lines) GROUP BY 1),
held AS (SELECT DISTINCT l.rid, l.pos, l.line, l.place, b.kind, b.v FROM lines l JOIN b ON b.rid = l.rid AND b.s >= l.place AND b.e <= l.place + length(l.line)),
mk AS (SELECT DISTINCT rid, pos, line, place FROM held),
wz AS (SELECT rid, pos, line, place, string_split_regex(line, '{_TERM}') AS segs, regexp_extract_all(line, '{_TERM}') AS ms FROM mk), wi AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM wz),
wp AS (SELECT rid, pos, line, lower(ms[i]) AS term, place + list_sum(list_transform(segs[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda q: length(q))), 0) AS s, length(ms[i]) AS n FROM wi),
w AS (SELECT rid, pos, line, term, s, s + n AS e FROM wp WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = wp.rid AND b.s < wp.s + wp.n AND wp.s < b.e)),
met AS (SELECT w.*, h.kind, h.v FROM w JOIN held h ON h.rid = w.rid AND h.pos = w.pos),
nb AS (SELECT kind, v, term, count(DISTINCT (rid, pos)) AS n_both, count(DISTINCT line) AS contexts FROM met GROUP BY 1, 2, 3), ne AS (SELECT kind, v, count(DISTINCT (rid, pos)) AS n_entity FROM met GROUP BY 1, 2),
tl AS (SELECT kind, v, term FROM nb JOIN ne USING (kind, v) JOIN nt USING (term), nl WHERE contexts >= 2 AND n > n_entity AND ln(n_both::DOUBLE * n / (n_entity::DOUBLE * n_term)) / ln(n / n_entity::DOUBLE) >= 0.5),
terms AS (SELECT DISTINCT met.rid, 'term' AS kind, 4 AS k, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM met JOIN tl USING (kind, v, term)),
spans AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM (SELECT rid, kind, k, s, e FROM b UNION ALL SELECT rid, kind, k, s, e FROM terms) GROUP BY 1),
base AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS base, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone FROM b GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN base USING (rid) LEFT JOIN spans USING (rid)"""

OP6 = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.seen) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY 1, 2"""

_WORDS = "list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_BITS = "CASE f WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END"

OP11 = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
good AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > least THEN 16 ELSE 0 END) AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN good ON good.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), f AS (SELECT f, {_BITS} AS bit FROM l),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS gone, bits[step] AS bit FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN mask & (gone | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & gone > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


def _op12(rounds: int = 4, entries: int = 256) -> str:
    """Each round as its own tables: distances by whole numbers in doubles, floors of whole quotients."""
    q = ["k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, len(embedding) // 4 AS w FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))"]
    q.append("x AS MATERIALIZED (SELECT rid, p, v[p * w + 1:(p + 1) * w] AS v FROM (SELECT *, unnest([0, 1, 2, 3]) AS p FROM k))")
    q.append(f"b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM x WHERE rid <= {entries})")
    for r in range(rounds + 1):
        d = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v)"
        q.append(f"a{r} AS MATERIALIZED (SELECT rid, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (SELECT x.rid, x.p, b.e, {d} AS d FROM x JOIN b{r} b ON b.p = x.p) GROUP BY 1, 2)")
        if r < rounds:
            q.append(f"s{r} AS (SELECT p, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(x.v) AS y, unnest(range(1, len(x.v) + 1)) AS i FROM a{r} a JOIN x ON x.rid = a.rid AND x.p = a.p) GROUP BY 1, 2, 3)")
            q.append(f"m{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM s{r} GROUP BY 1, 2)")
            q.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)")
    q.append(f"c AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    q.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(q)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (rid), h"


OP12 = _op12()
