"""DuckDB SQL for the queries that SQL can express: the same results by plain joins and windows."""

from __future__ import annotations

from itertools import permutations

from .decontaminate import WIDTH
from .filter_audit import FILTERS, MARKS, MAX_CAPITALS_PERCENT, MIN_DISTINCT_PERCENT, MIN_WORDS as FEW_WORDS
from .line_dedup import MASK_BITS, MIN_CHARS, MIN_LINES
from .mixing import FILLS, TIERS
from .sharding import MULTIPLIER
from .quality_rules import LADDERS, LEVELS, MAX_REPEAT_PERCENT, MIN_WORDS, WINDOW

_RULES = {
    "symbols": "n_symbols / nullif(word_chars, 0)", "marks": "n_marks / nullif(word_chars, 0)", "capitals": "n_capitals / nullif(word_chars, 0)", "dup_lines": "n_dup_lines / nullif(n_lines, 0)",
    "repeats": "n_repeat_words / nullif(n_words, 0)", "word_length": "word_chars / nullif(n_words, 0)", "distinct": "n_distinct / nullif(n_words, 0)",
}


def _level() -> str:
    cases = []
    for t in range(LEVELS):
        tests = [f"coalesce({_RULES[r]}, {1 if r == 'distinct' else 0}) {'<' if r == 'distinct' else '>'} {c[t]}" for r, c in LADDERS.items()]
        cases.append(f"WHEN {' OR '.join(tests)} THEN {t}")
    return "CASE " + " ".join(cases) + f" ELSE {LEVELS} END"


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS ln FROM d),
g AS (SELECT row, unnest(range(0, len(w) - {WINDOW - 1})) AS i, w FROM t WHERE len(w) >= {WINDOW}),
gr AS (SELECT row, i, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS gram FROM g),
rp AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM gr) WHERE n > 1),
cv AS (SELECT row, count(DISTINCT i + k) AS n FROM rp, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY 1),
m AS (SELECT t.row, doc_id, lang, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ln) - len(list_distinct(ln)) AS n_dup_lines,
coalesce(cv.n, 0) AS n_repeat_words, len(ln) AS n_lines, len(list_distinct(w)) AS n_distinct, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals FROM t LEFT JOIN cv ON cv.row = t.row),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {_level()} AS level FROM m),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
h AS (SELECT lang, min(level) AS level FROM v JOIN q ON q.doc_id = v.doc_id WHERE quality = 1 AND NOT base_failed GROUP BY lang, v.doc_id),
c AS (SELECT lang, t, count(*) AS n, count(*) FILTER (level <= t) AS k FROM h, (SELECT unnest(range(0, {LEVELS})) AS t) GROUP BY 1, 2),
b AS (SELECT lang, t, CASE WHEN k > n * 0.05 THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) END AS p FROM c),
s AS (SELECT lang, coalesce(min(t) FILTER (p > 0.1 / (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents))), {LEVELS}) AS levels FROM b GROUP BY 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND level >= coalesce(levels, 0) AS kept
FROM v LEFT JOIN s ON s.lang IS NOT DISTINCT FROM v.lang
"""

_TIER = "CASE " + " ".join(f"WHEN size >= {least} THEN {k}" for k, (least, _) in reversed(list(enumerate(TIERS)))) + " END"
_WEIGHT = "CASE tier " + " ".join(f"WHEN {k} THEN {w}" for k, (_, w) in enumerate(TIERS)) + " END"

_FIT = "odds > e{k}.after AND size <= e{k}.gap + 1e-6"
#: Each step passes over the documents that fit in the gap, after the one that ended the step before.
_STEPS = "".join(
    f"f{k} AS (SELECT r2.source, odds, gap, sum(size) OVER (PARTITION BY r2.source ORDER BY odds) AS upto FROM r2 JOIN e{k} ON e{k}.source IS NOT DISTINCT FROM r2.source WHERE {_FIT.format(k=k)}),\n"
    f"g{k} AS (SELECT source, max(odds) FILTER (upto <= gap + 1e-6) AS last, max(upto) FILTER (upto <= gap + 1e-6) AS took, min(odds) FILTER (upto > gap + 1e-6) AS block FROM f{k} GROUP BY 1),\n"
    f"e{k + 1} AS (SELECT e{k}.source, gap - coalesce(took, 0) AS gap, coalesce(block, 1e300) AS after FROM e{k} LEFT JOIN g{k} ON g{k}.source IS NOT DISTINCT FROM e{k}.source),\n"
    for k in range(FILLS)
).rstrip("\n")
_SAMPLED = " OR ".join(f"({_FIT.format(k=k)} AND odds <= g{k}.last)" for k in range(FILLS))
_JOINS = " ".join(f"LEFT JOIN e{k} ON e{k}.source IS NOT DISTINCT FROM r2.source LEFT JOIN g{k} ON g{k}.source IS NOT DISTINCT FROM r2.source" for k in range(FILLS))

#: Sources fill up in order of 2 * size / weight; tiers of a source in order of falling weight.
OP2 = f"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size, (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM documents),
s0 AS (SELECT source, sum(size) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY 1),
s1 AS (SELECT *, 2.0 * source_size AS most, 1.5 * sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, row_number() OVER o AS n, (total - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s1 WINDOW o AS (ORDER BY most / w, source)),
s3 AS (SELECT source, source_size, least(most, w * coalesce((SELECT arg_min(level, n) FROM s2 WHERE level * w <= most), 1e300)) AS target FROM s2),
t0 AS (SELECT source, {_TIER} AS tier, sum(size)::DOUBLE AS words FROM d WHERE size > 0 GROUP BY 1, 2),
t1 AS (SELECT t0.source, tier, words, target, {_WEIGHT} * words AS w, 2.0 * words AS most FROM t0 JOIN s3 ON s3.source IS NOT DISTINCT FROM t0.source),
t2 AS (SELECT *, row_number() OVER o AS n, sum(w) OVER (PARTITION BY source) AS allw, coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM t1 WINDOW o AS (PARTITION BY source ORDER BY most / w)),
t3 AS (SELECT source, arg_min((target - used) / (allw - gone), n) FILTER ((target - used) / (allw - gone) * w <= most) AS level FROM t2 GROUP BY 1),
t4 AS (SELECT t2.source, tier, least(most, coalesce(level * w, most)) / words AS expected FROM t2 JOIN t3 ON t3.source IS NOT DISTINCT FROM t2.source),
r0 AS (SELECT d.*, {_TIER} AS tier FROM d),
r1 AS (SELECT r0.*, s3.source_size, s3.target, coalesce(t4.expected, 0) AS expected, floor(coalesce(t4.expected, 0)) AS whole FROM r0 JOIN s3 ON s3.source IS NOT DISTINCT FROM r0.source LEFT JOIN t4 ON t4.source IS NOT DISTINCT FROM r0.source AND t4.tier = r0.tier),
r2 AS (SELECT *, CASE WHEN size > 0 AND expected - whole > 1e-12 THEN u / (1 - u) * (1 - (expected - whole)) / (expected - whole) END AS odds, target - sum(whole * size) OVER (PARTITION BY source) AS need FROM r1),
e0 AS (SELECT DISTINCT source, need AS gap, -1.0::DOUBLE AS after FROM r2),
{_STEPS}
r5 AS (SELECT r2.*, CASE WHEN r2.size > 0 THEN whole + CASE WHEN {_SAMPLED} THEN 1 ELSE 0 END ELSE 0 END AS copies FROM r2 {_JOINS})
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target::DOUBLE, 6) AS target, (copies * size)::BIGINT AS taken, copies::INTEGER AS copies, round(expected::DOUBLE, 9) AS expected FROM r5
"""

_TERMS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents), i AS (SELECT item_id::VARCHAR AS item_id, {_TERMS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[k + 1:k + n], ' ') AS gram FROM (SELECT item_id, w, least(len(w), {WIDTH}) AS n, unnest(range(0, len(w) - least(len(w), {WIDTH}) + 1)) AS k FROM i WHERE len(w) > 0)),
x AS (SELECT row, n, k, array_to_string(w[k + 1:k + n], ' ') AS gram FROM (SELECT row, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
hit AS (SELECT row, k, x.n, item_id FROM x JOIN g ON g.gram = x.gram AND g.n = x.n),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
a AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.row = d.row LEFT JOIN a ON a.row = d.row
"""

OP7 = """
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
|| coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT AS mark FROM pages)
SELECT page_id, strlen(rec)::BIGINT AS length, sha256(rec) AS digest, CASE WHEN mark % 211 = 0 THEN 'missing' WHEN mark % 97 = 0 OR mark % 89 = 0 THEN 'corrupt' ELSE 'ok' END AS status FROM r
"""

#: In a run of adjacent boundaries every second counts, which is the rule for two lines.
assert MIN_LINES == 2
OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text, md5(coalesce(text, '')) AS key, string_split(text, chr(10)) AS ln FROM documents),
l AS (SELECT row, doc_id, key, i, ln[i + 1] AS line, len(ln) AS n, md5(ln[i + 1]) AS h, CASE WHEN i > 0 THEN md5(ln[i]) END AS h0 FROM (SELECT *, unnest(range(0, len(ln))) AS i FROM d WHERE text IS NOT NULL)),
m AS (SELECT *, i > 0 AND ('0x' || substr(md5(h0 || h), 25, 8))::BIGINT % {1 << MASK_BITS} = 0 AS mark FROM l),
z AS (SELECT *, i - row_number() OVER (PARTITION BY row, mark ORDER BY i) AS run FROM m),
e AS (SELECT *, i = n - 1 OR (mark AND (i - min(i) OVER (PARTITION BY row, mark, run)) % 2 = 0 AND i < n - {MIN_LINES}) AS is_end FROM z),
c AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
k AS (SELECT row, doc_id, key, chunk, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY 1, 2, 3, 4),
f AS (SELECT *, rank() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, key, start) AS r, n >= {MIN_LINES} AND length(body) >= {MIN_CHARS} AS big FROM k),
o AS (SELECT row, count(*) FILTER (big AND r > 1) AS gone, coalesce(sum(n) FILTER (big AND r > 1), 0) AS gone_lines, coalesce(string_agg(body, chr(10) ORDER BY start) FILTER (NOT (big AND r > 1)), '') AS body FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(gone, 0)::BIGINT AS n_removed_chunks, coalesce(gone_lines, 0)::BIGINT AS n_removed_lines, CASE WHEN text IS NOT NULL THEN sha256(coalesce(o.body, '')) END AS clean_sha256 FROM d LEFT JOIN o ON o.row = d.row
"""

#: The links that the mailbox's rule makes: a reply quotes a message in whole, so it links to the earliest one with its words.
OP6 = """
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(min(text), '') AS text FROM conversations GROUP BY 1, 2),
k AS (SELECT conv_id, turn, ('0x' || substr(md5(conv_id || ':' || turn), 1, 8))::BIGINT AS mark, translate(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM f),
o AS (SELECT conv_id, norm, min(turn) AS origin FROM k GROUP BY 1, 2),
r AS (SELECT a.conv_id, a.turn, b.turn AS p, o.origin FROM k a JOIN k b ON b.conv_id = a.conv_id AND b.turn = greatest(0, a.turn - 1 - a.mark % 3) JOIN o ON o.conv_id = b.conv_id AND o.norm = b.norm WHERE a.turn > 0 AND a.mark % 5 <> 0 AND b.norm <> ''),
n AS (SELECT r.conv_id, r.turn, r.origin, CASE WHEN g.turn IS NULL THEN 1 ELSE 2 END AS quoted FROM r LEFT JOIN r g ON g.conv_id = r.conv_id AND g.turn = r.p),
t AS (SELECT k.conv_id, k.turn, k.turn AS thread, 0 AS depth, [k.turn] AS path FROM k LEFT JOIN n ON n.conv_id = k.conv_id AND n.turn = k.turn WHERE n.turn IS NULL
UNION ALL SELECT n.conv_id, n.turn, t.thread, t.depth + 1, list_append(t.path, n.turn) FROM n JOIN t ON t.conv_id = n.conv_id AND t.turn = n.origin),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, thread ORDER BY path) - 1 AS reply_pos FROM t)
SELECT c.conv_id, c.turn, c.role, coalesce(n.quoted, 0)::BIGINT AS n_quoted, coalesce(n.quoted, 0)::BIGINT AS max_level, coalesce(n.quoted, 0)::BIGINT AS n_linked, n.origin::BIGINT AS parent_turn, u.thread::BIGINT AS thread_turn, u.depth::BIGINT AS depth, u.reply_pos::BIGINT AS reply_pos,
sha256(regexp_replace(coalesce(c.text, ''), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')) AS own_sha256
FROM conversations c LEFT JOIN u ON u.conv_id = c.conv_id AND u.turn = c.turn LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn
"""
_LETTER = "('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)"
_ORDERS = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
q AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
m AS (SELECT row, part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, (len(w) < {FEW_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w))::INT
+ 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(text))::INT + 8 * regexp_matches(text, '{MARKS}')::INT + 16 * coalesce(t.doc_id > least, FALSE)::INT AS mask FROM t LEFT JOIN q ON q.doc_id = t.doc_id),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY 1, 2, 3, 4),
o AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, b.bit, (SELECT coalesce(sum(e.bit), 0) FROM (VALUES {_LETTER}) e(name, bit) WHERE strpos(filter_order, e.name) < step)::INT AS before
FROM (SELECT unnest([{_ORDERS}]) AS filter_order), (SELECT unnest(range(1, 6)) AS step) JOIN (VALUES {_LETTER}) b(name, bit) ON b.name = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND good), 0) AS good_lost, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND toxic), 0) AS toxic_lost FROM c, o GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents), i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
z AS (SELECT count(*) FILTER (len(w) > 0) AS docs, coalesce(sum(len(w)), 0)::BIGINT AS words FROM d),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY 1, 2, 3, 4),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), x AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM f, z),
s AS (SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS score FROM p JOIN i ON i.term = p.term JOIN x ON x.term = p.term, z GROUP BY 1, 2, 3 HAVING score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, row) AS rank FROM s) WHERE rank <= 50
"""

#: The checksum by its table of 256 remainders, made bit by bit; the jumps by a recursive step.
OP13 = f"""
WITH RECURSIVE bits AS (SELECT i AS v, i, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS id FROM documents),
h AS (SELECT row, doc_id, strlen(text) + 1 AS size, md5('slot:' || id) AS place, ('0x' || substr(md5(id), 1, 16))::UBIGINT::HUGEINT AS key,
xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, crc),
j AS (SELECT row, g, key, 0::BIGINT AS here, 0::BIGINT AS ahead FROM h, (SELECT unnest([8, 9]) AS g)
UNION ALL SELECT row, g, k, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT FROM (SELECT row, g, ahead, (key * {MULTIPLIER} + 1) % 18446744073709551616 AS k FROM j WHERE ahead < g)),
e AS (SELECT row, max(here) FILTER (g = 8) AS shard, max(here) FILTER (g = 9) AS grown FROM j GROUP BY 1)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard FROM h JOIN e ON e.row = h.row
"""
ORACLES = {"op1_quality_rules": OP1, "op2_mixing": OP2, "op5_decontaminate": OP5, "op6_quote_links": OP6, "op7_warc_fixity": OP7, "op10_line_dedup": OP10, "op11_filter_audit": OP11, "op12_lexical_search": OP12, "op13_sharding": OP13}
