"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

import math

from tracewell.llm import licenses, pii

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RULES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{kind}_{i}}}"
    for i, (kind, h, p) in enumerate([("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("block", "com", "/en/"), ("allow", "net", "/de/"), ("block", "org", "/es/")])
)
_RULE = _RULES.format(allow_0="'example.com/en/7'", block_1="'example.net/de/8'", block_2="'com/en/'", allow_3="'net/de/'", block_4="'org/es/'")
_VERDICT = _RULES.format(allow_0="'allow'", block_1="'block'", block_2="'block'", allow_3="'allow'", block_4="'block'")
URLS = f"""WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM r),
q AS (SELECT page_id, host, path, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS kept FROM p),
c AS (SELECT page_id, host, path, host || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canon FROM q),
l AS (SELECT *, canon <> '' AND canon IN (SELECT canon FROM c WHERE regexp_matches(host, '(^|\\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\\.')) AS listed FROM c)
SELECT page_id, host, path, CASE {_RULE} END AS rule, CASE {_VERDICT} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM l"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _licenses() -> str:
    places = []
    for phrase, label in licenses.PHRASES.items():
        words = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_transform(list_filter(range(0, len(w)), lambda i: {test}), lambda i: {{'i': i, 'l': '{label}'}})")
    sets = {label: [sorted(set(x.split())) for x in t] for label, t in sorted(licenses.TEMPLATES.items())}
    scores = []
    for label, (t, needed, foreign) in sets.items():
        need, words = math.ceil(licenses.THRESHOLD * len(t) - 1e-9), "[" + ", ".join(f"'{x}'" for x in t) + "]"
        shared = f"len(list_intersect(list_distinct(b), {words}))"
        told = f"len(list_intersect(list_distinct(b), {needed})) = {len(needed)}" + (f" AND NOT list_has_any(b, {foreign})" if foreign else "")
        scores.append(f"coalesce(list_max(list_transform(blocks, lambda b: CASE WHEN {shared} >= {need} AND {told} THEN {shared} / {len(t)}.0::DOUBLE ELSE 0.0 END)), 0.0) AS \"s_{label}\"")
    own = ", ".join(f"CASE WHEN \"s_{label}\" > 0 THEN '{label}' END" for label in sets)
    best = ", ".join(f'"s_{label}"' for label in sets)
    return f"""WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS x, regexp_replace(coalesce(text, ''), '{licenses._SENTENCE_END}', '\\1\n\n\\2', 'g') AS y FROM documents),
w AS (SELECT doc_id, regexp_extract_all(x, '{_WORD}') AS w, list_transform(string_split_regex(y, '{licenses._EMPTY_LINE}'), lambda l: regexp_extract_all({_LOWER.format('l')}, '{_WORD}')) AS blocks FROM t),
p AS (SELECT doc_id, len(w) AS n_words, list_concat({', '.join(places)}) AS p, {', '.join(scores)} FROM w),
q AS (SELECT *, list_transform(p, lambda z: z.i) AS places, list_sort(list_distinct(list_transform(p, lambda z: z.l))) AS base FROM p)
SELECT doc_id, n_words, len(p) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(base, ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_filter(list_concat(base, [{own}]), lambda v: v IS NOT NULL))), ',') AS labels, CASE WHEN len(p) > 0 THEN 1.0 ELSE greatest({best}) END AS score FROM q"""


EXACT = r"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256 FROM t WINDOW g AS (PARTITION BY text_sha256)"""

NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n, list_sort(s) AS key FROM s), x AS MATERIALIZED (SELECT doc_id, unnest(s) AS h FROM s),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, key, any_value(n) AS n FROM n WHERE n > 0 GROUP BY key),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT rep FROM c) AND b.doc_id IN (SELECT rep FROM c) GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN c u ON u.rep = a JOIN c v ON v.rep = b WHERE 100 * k >= 75 * (u.n + v.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
m AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.component, n.doc_id) AS component_id, coalesce(m.component, n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN c ON n.key = c.key AND n.n > 0 LEFT JOIN m ON m.rep = c.rep"""


_VALID = {
    "email": "true",
    "ip": "list_count(list_filter(string_split(v, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 256 ELSE coalesce(try_cast(ltrim(p, '0') AS INT), 0) END <= 255)) = 4",
    "card": "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(d), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0",
    "phone": "length(d) BETWEEN 9 AND 15",
    "iban": "length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: (CASE WHEN regexp_matches(c, '[0-9]') THEN c::BIGINT ELSE ascii(c) - 55 END)::BIGINT)), lambda r, x: (r * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97) = 1",
    "ssn": "regexp_matches(v, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') AND NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$')",
}


def _personal() -> str:
    """Matches and the pieces between them, by kind; places are sums of their lengths. Only texts with a match are taken further."""
    parts = []
    for n, kind in enumerate(pii.KINDS):
        pattern = {"card": r"[0-9](?:[\x20-]?[0-9]){12,}", **{k: v for k, v in pii.FIXED.items() if k != "card"}}.get(kind.name, kind.pattern.replace("++", "+"))
        value = "regexp_replace(f, '^[^A-Za-z0-9]', '')" if kind.lead else "f"
        near = "piece || substr(f, 1, 1)" if kind.lead else "piece"
        parts.append(f"""SELECT doc_id, {n} AS k, '{kind.name}' AS kind, e - length(v) AS a, e, {kind.base} AS base FROM (
SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d, {kind.prior} + CASE WHEN regexp_matches(lower(right({near}, {pii.WINDOW})), '{kind.words}') THEN {kind.gain} ELSE 0 END AS score FROM (
SELECT doc_id, f, piece, {value} AS v, sum(length(f) + length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
SELECT doc_id, unnest(m) AS f, unnest(p[1:len(m)]) AS piece, unnest(range(len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM documents WHERE regexp_matches(text, '{pattern}')))))
WHERE ({_VALID[kind.name]}) AND ({kind.base} OR score >= {pii.THRESHOLD})""")
    counts = ", ".join(f"count(kind) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS if k.base)
    return f"""WITH s AS ({' UNION ALL '.join(parts)}), t AS (SELECT *, kind || ':' || a::BIGINT || ':' || e::BIGINT AS span FROM s)
SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY k, a) FILTER (base), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY k, a), '') AS spans FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id"""



def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: {byte}), 4294967295::BIGINT)"


#: The lattice row by row: of each conversation, the best way to each role written last, as its cost in eight digits and its audit. Two insertions in a row lead anywhere.
CONVERSATIONS = rf"""WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
d AS (SELECT coalesce(conv_id, -9) AS c, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END)) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
f AS (SELECT *, left(role, 1) AS q, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault FROM n),
e AS (SELECT * FROM (VALUES ('D', '', '', 4, '*'), ('D', 's', 's', 4, '*'), ('D', 'u', 'u', 4, '*'), ('D', 'a', 'a', 4, '*'), ('R', '', 'u', 3, '*'), ('R', 's', 'u', 3, '*'), ('R', 'a', 'u', 3, '*'), ('R', 'u', 'a', 3, '*'),
  ('K', '', 's', 0, 's'), ('K', '', 'u', 0, 'u'), ('K', 's', 'u', 0, 'u'), ('K', 'a', 'u', 0, 'u'), ('K', 'u', 'a', 0, 'a')) v(edit, a, b, cost, initial)),
ins AS (SELECT * FROM (VALUES ('', '', ''), ('s', 's', ''), ('u', 'u', ''), ('a', 'a', ''), ('', 'u', 'I'), ('', 'a', 'II'), ('s', 'u', 'I'), ('s', 'a', 'II'), ('a', 'u', 'I'), ('u', 'a', 'I')) v(a, b, edits)),
w AS (SELECT c, 0::BIGINT AS i, b AS q, printf('%08d', 3 * length(edits)) || edits AS v FROM (SELECT DISTINCT c FROM d), ins WHERE a = ''
  UNION ALL SELECT c, i, b, min(printf('%08d', left(v, 8)::BIGINT + 3 * length(edits)) || substr(v, 9) || edits) FROM (
    SELECT w.c, f.i, e.b AS q, min(printf('%08d', left(w.v, 8)::BIGINT + e.cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END) || substr(w.v, 9) || edit) AS v
    FROM w JOIN f ON f.c = w.c AND f.i = w.i + 1 JOIN e ON e.a = w.q AND e.initial IN ('*', f.q) WHERE edit = 'D' OR fault NOT IN ('blank', 'duplicate') GROUP BY 1, 2, 3) s JOIN ins ON ins.a = s.q GROUP BY 1, 2, 3),
z AS (SELECT w.c, min(v) AS v FROM w JOIN (SELECT c, max(i) AS i FROM w GROUP BY c) m ON m.c = w.c AND m.i = w.i WHERE w.q IN ('', 'a') GROUP BY 1),
l AS (SELECT c, unnest(string_split(substr(v, 9), '')) AS edit, unnest(range(length(v) - 8)) AS k FROM z WHERE length(v) > 8),
p AS (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY c ORDER BY k) AS i FROM l),
o AS (SELECT p.c, p.k, p.edit, f.role, coalesce(CASE WHEN p.edit <> 'I' THEN f.text END, '') AS text, row_number() OVER (PARTITION BY p.c ORDER BY p.k) - 1 AS nth, first_value(p.edit = 'K' AND f.q = 's') OVER (PARTITION BY p.c ORDER BY p.k) AS s FROM p LEFT JOIN f ON f.c = p.c AND f.i = p.i WHERE p.edit <> 'D'),
t AS (SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - s::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS t FROM o GROUP BY c),
g AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(v, 8)::BIGINT, 0) AS cost, coalesce(substr(v, 9), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.c = coalesce(a.conv_id, -9) LEFT JOIN z ON z.c = g.c LEFT JOIN t ON t.c = g.c"""



#: `p` is the batch in which a version is pruned: the first whose horizon has reached a later version of the client that is there by then. A null horizon is minus infinity.
ENRICHED = f"""WITH s AS (SELECT row_number() OVER () AS k, sale_id, client_id, sold_at, greatest(0, least(9, floor((date_diff('day', DATE '1970-01-01', arrived_at::DATE) - 19723) * 10 / 152)))::BIGINT AS b FROM sales),
c AS (SELECT *, greatest(0, least(9, floor((date_diff('day', DATE '1970-01-01', valid_at::DATE) + {crc32("coalesce(change_id::VARCHAR, '')")} % 4 - 19723) * 10 / 152)))::BIGINT AS b, floor(100 * balance + 0.5)::BIGINT AS cents FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL)),
m AS (SELECT r.b, (SELECT max(sold_at) FROM s WHERE s.b < r.b) - INTERVAL 24 HOUR AS ws, (SELECT max(valid_at) FROM c WHERE c.b < r.b) - INTERVAL 24 HOUR AS wc FROM range(10) r(b)),
h AS (SELECT b, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM m),
l AS (SELECT c.*, h.wc IS NOT NULL AND valid_at < h.wc AS late FROM c JOIN h USING (b)),
v AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY valid_at, change_id, cents NULLS FIRST, op NULLS FIRST) AS o, coalesce((SELECT min(h.b) FROM h WHERE h.h >= l.valid_at), 99) AS hb FROM l WHERE NOT late AND client_id IS NOT NULL),
p AS (SELECT v.client_id, v.o, v.b, any_value(v.valid_at) AS valid_at, any_value(v.change_id) AS change_id, any_value(v.cents) AS cents, any_value(v.op) AS op, coalesce(min(CASE WHEN w.o IS NOT NULL THEN greatest(v.b, w.b, w.hb) END), 99) AS p FROM v LEFT JOIN v w ON w.client_id = v.client_id AND w.o > v.o GROUP BY 1, 2, 3),
e AS (SELECT s.*, coalesce((SELECT min(h.b) FROM h WHERE h.b >= s.b AND (s.sold_at IS NULL OR s.sold_at < h.h)), 10) AS at_b FROM s),
j AS (SELECT e.k, any_value(e.sale_id) AS id, any_value(e.at_b) AS batch, count(p.o) AS n_held, arg_max({{'change_id': p.change_id, 'cents': p.cents, 'op': p.op}}, p.o) FILTER (p.valid_at <= e.sold_at) AS best FROM e LEFT JOIN p ON p.client_id = e.client_id AND p.b <= e.at_b AND p.p >= e.at_b GROUP BY e.k)
SELECT 'sale' AS rec, id, batch, n_held, best.change_id AS change_id, best.cents AS balance_cents, best.op AS op FROM j
UNION ALL SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM l WHERE late"""


ORACLES: dict[str, str] = {"op4_url_filter": URLS, "op6_license_scan": _licenses(), "op8_exact_dedup": EXACT, "op10_minhash_near_dedup": NEAR, "op11_conversation_repair": CONVERSATIONS, "op12_personal_data": _personal(), "op13_sale_enrichment": ENRICHED}
