"""SQL that gives the rows of the queries of this subpackage, for an engine with RE2 expressions and list functions.

None for scores, tokenizers, archives and hashes that SQL lacks: those are tested against plain programs.
"""

from __future__ import annotations

from gristmill.llm.decontam import WINDOW
from gristmill.llm.divergence import LEAST_DOCS, SCALE, TOP_TERMS
from gristmill.llm.fair_mix import REPEATS, WEIGHTS
from gristmill.llm.fim import MARKS, SEED, SUFFIX_FIRST, TRANSFORMED
from gristmill.llm.licenses import PHRASES, TEMPLATES, needed, stride, words
from gristmill.llm.risk_rules import DELTA, FEATURES, MIN_WORDS, RISK, RULES, STEPS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x20\x09-\x0D]+"
_LETTERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _split(text: str, gap: str) -> str:
    return f"list_filter(string_split_regex({text}, '{gap}'), lambda x: x <> '')"


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}')"


# --- risk-controlled rules ------------------------------------------------------------------------------------------


def _ratio(rule: str) -> str:
    top, bottom = RULES[rule][0].split(" / ")
    return f"CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / {bottom} ELSE 0 END"


_STEPS = [f"({' + '.join(f'CASE WHEN {_ratio(r)} <= {c} THEN 1 ELSE 0 END' for c in cs)}) AS s_{r}" for r, (_, cs) in RULES.items()]
_LEAST = "least(" + ", ".join(f"CASE WHEN mask & {1 << i} <> 0 THEN s_{r} ELSE {STEPS} END" for i, r in enumerate(RULES)) + ")"
_REJECTS = " OR ".join(f"coalesce({_ratio(r)} > c.cut_{r}, false)" for r in RULES)
_CUTS = ", ".join(f"CASE WHEN mask & {1 << i} <> 0 THEN list_extract([{', '.join(f'CAST({c} AS DOUBLE)' for c in cs)}], step + 1) END AS cut_{r}" for i, (r, (_, cs)) in enumerate(RULES.items()))
_SETS = 2 ** len(RULES) - 1

RISK_RULES = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, u.w, u.i FROM d, unnest({_split("text", _GAP)}) WITH ORDINALITY AS u(w, i)),
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM w),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM d, unnest(string_split(text, chr(10))) AS u(x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, d.lang AS stratum, len({_split("text", _GAP)}) AS n_words, len(regexp_replace(text, '{_GAP}', '', 'g')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(l.n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines, len(regexp_replace(text, '[^!]+', '', 'g')) AS n_bangs, len(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals
  FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)),
m AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f),
known AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT stratum, q, {", ".join(_STEPS)} FROM m JOIN known USING (doc_id) WHERE NOT base_failed),
per AS (SELECT stratum, mask, {_LEAST} AS first, q FROM held, (SELECT CAST(unnest(range(1, {_SETS + 1})) AS BIGINT) AS mask)),
grid AS (SELECT stratum, mask, step, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND first <= step) AS good, count(*) FILTER (q <> 1 AND first <= step) AS bad
  FROM per, (SELECT CAST(unnest(range(0, {STEPS})) AS BIGINT) AS step) GROUP BY stratum, mask, step),
tails AS (SELECT *, CASE WHEN good >= n * CAST({RISK} AS DOUBLE) THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(CAST({RISK} AS DOUBLE)) + (n - i) * ln(CAST({1 - RISK} AS DOUBLE)))) FROM unnest(range(0, good + 1)) AS u(i)) END AS p FROM grid WHERE n > 0),
passed AS (SELECT *, max(CASE WHEN p <= CAST({DELTA} AS DOUBLE) / {_SETS} / (SELECT count(DISTINCT coalesce('=' || stratum, '')) FROM tails) THEN 0 ELSE 1 END) OVER (PARTITION BY stratum, mask ORDER BY step) AS stopped FROM tails),
taken AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY bad DESC, good, step, mask) AS k FROM passed WHERE stopped = 0),
cuts AS (SELECT stratum, {_CUTS} FROM taken WHERE k = 1)
SELECT doc_id, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in FEATURES)}, base_failed, (NOT base_failed AND NOT ({_REJECTS})) AS kept
FROM m LEFT JOIN cuts c ON m.stratum IS NOT DISTINCT FROM c.stratum
"""

# --- fair mixing ----------------------------------------------------------------------------------------------------

FAIR_MIX = rf"""
WITH s AS (SELECT doc_id, source, CAST(len({_split("coalesce(text, '')", _GAP)}) AS BIGINT) AS size, CAST('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS key FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
p AS (SELECT *, list_extract([{", ".join(map(str, WEIGHTS))}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)) AS w, {REPEATS} * source_size AS cap FROM b),
r AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM p),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM r),
x AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS top, max(CASE WHEN level <= ratio THEN 1 ELSE 0 END) OVER (ORDER BY ratio, source NULLS LAST) AS fits FROM v),
t AS (SELECT source, source_size, CASE WHEN fits = 1 THEN w * top ELSE CAST(cap AS DOUBLE) END AS target FROM x),
q AS (SELECT s.*, t.source_size, t.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
i AS (SELECT doc_id, source, size, epoch, key, CAST(epoch * source_size + cum AS DOUBLE) / target AS finish FROM q, (VALUES {", ".join(f"({e})" for e in range(REPEATS))}) AS e(epoch) WHERE size > 0 AND target > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS spent FROM i),
took AS (SELECT doc_id, count(*) AS n FROM run WHERE spent <= (SELECT sum(target) FROM t) + 0.5 GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(took.n, 0) AS BIGINT) AS taken FROM q LEFT JOIN took USING (doc_id)
"""

# --- chat -----------------------------------------------------------------------------------------------------------

_CONTROL = r"([\[<])(\\*)(/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|/?s>)"

CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_matches(text, '{_CONTROL}') OR (role NOT IN ('user', 'assistant', 'system') AND regexp_matches(role, '{_CONTROL}')) AS hard, regexp_replace(text, '{_CONTROL}', '\1\2\\\3', 'g') AS safe FROM c),
f AS (SELECT *, bool_or(hard) OVER (PARTITION BY conv_id) AS escaped FROM e),
t AS (SELECT *, len(CASE WHEN escaped THEN safe ELSE text END) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11 ELSE 19 + len(role) END AS chars FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_or(hard) AS escaped, true AS round_trip
FROM t GROUP BY conv_id
"""

# --- decontamination ------------------------------------------------------------------------------------------------

_NEXT = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER (PARTITION BY id ORDER BY i)" for k in range(1, WINDOW))])

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id AS id, {_split(_lowered("text"), _LETTERS)} AS words FROM documents),
b AS (SELECT item_id AS id, {_split(_lowered("text"), _LETTERS)} AS words FROM benchmark),
dw AS (SELECT id, words, u.w, u.i FROM d, unnest(words) WITH ORDINALITY AS u(w, i)),
bw AS (SELECT id, u.w, u.i FROM b, unnest(words) WITH ORDINALITY AS u(w, i)),
bg AS (SELECT id, {_NEXT} AS g FROM bw),
dg AS (SELECT id, i, {_NEXT} AS g FROM dw),
full_hits AS (SELECT dg.id, dg.i, {WINDOW} AS n, bg.id AS item FROM dg JOIN bg USING (g)),
short AS (SELECT id AS item, words AS win, len(words) AS n FROM b WHERE len(words) BETWEEN 1 AND {WINDOW - 1}),
short_hits AS (SELECT dw.id, dw.i, short.n, short.item FROM dw JOIN short ON dw.w = short.win[1] WHERE array_slice(dw.words, dw.i, dw.i + short.n - 1) = short.win),
h AS (SELECT DISTINCT id, i, n, item FROM (SELECT * FROM full_hits UNION ALL SELECT * FROM short_hits)),
hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(CAST(i AS BIGINT), CAST(i + n AS BIGINT))) AS p FROM h) GROUP BY id),
names AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM h) GROUP BY id)
SELECT d.id AS doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, (n_hit IS NOT NULL) AS contaminated
FROM d LEFT JOIN hit USING (id) LEFT JOIN names USING (id)
"""

# --- fill-in-middle -------------------------------------------------------------------------------------------------

_P, _S, _M = MARKS
_DRAW = [f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)" for k in range(4)]

FILL_MIDDLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT doc_id, text, h, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens FROM d),
c AS (SELECT *, len(tokens) AS n, {_DRAW[0]} % (len(tokens) + 1) AS x, {_DRAW[1]} % (len(tokens) + 1) AS y,
  CASE WHEN text = '' OR contains(text, '{_P}') OR contains(text, '{_S}') OR contains(text, '{_M}') OR {_DRAW[2]} % 100 >= {TRANSFORMED} THEN 'plain' WHEN {_DRAW[3]} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM t),
s AS (SELECT *, array_to_string(tokens[1:least(x, y)], '') AS p, array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(tokens[greatest(x, y) + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{_P}' || p || '{_S}' || z || '{_M}' || m ELSE '{_S}' || z || '{_P}' || p || '{_M}' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s
"""

# --- divergence of sources ------------------------------------------------------------------------------------------

_SHARE = f"1 + (CAST({SCALE} AS HUGEINT) * (n + 1)) // CAST(words AS HUGEINT)"
_VALUE = "((p - q) * (p - q)) // q"

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_lowered("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) + coalesce(any_value(v.v), 0) AS words FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
l AS (SELECT lang, sum(n) + any_value(v.v) AS words FROM c JOIN v USING (lang) GROUP BY lang),
gp AS (SELECT lang, source, term, n, {_SHARE} AS p FROM (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, g.words FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term)),
lp AS (SELECT lang, term, {_SHARE} AS q FROM (SELECT c.lang, term, sum(n) AS n, any_value(l.words) AS words FROM c JOIN l USING (lang) GROUP BY c.lang, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum({_VALUE}) AS value FROM gp a JOIN (SELECT lang, source, term, p AS q FROM gp) b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {_VALUE} AS value FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""

# --- licenses -------------------------------------------------------------------------------------------------------

_PHRASES = ", ".join(f"([{', '.join(f"'{w}'" for w in p.split())}], '{label}')" for p, label in PHRASES.items())
_NOTICES = [(label, words(t)) for label, t in TEMPLATES]
_TEMPLATES = ", ".join(f"('{label}', [{', '.join(f"'{w}'" for w in sorted(set(ws)))}], {stride(len(ws))}, {needed(len(set(ws)))})" for label, ws in _NOTICES)

LICENSES = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_split(_lowered("text"), _LETTERS)} AS words FROM documents),
phrases AS (SELECT * FROM (VALUES {_PHRASES}) AS p(phrase, label)),
templates AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(label, tokens, stride, needed)),
places AS (SELECT id, label, i FROM (SELECT id, words, phrase, label, unnest(range(1, len(words) + 1)) AS i FROM d, phrases WHERE list_contains(words, 'license')) WHERE words[i:i + len(phrase) - 1] = phrase),
base AS (SELECT id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY id),
blocks AS (SELECT id, stride, list_distinct(words[k * stride + 1:(k + 2) * stride]) AS block FROM (SELECT id, words, stride, unnest(range(0, (len(words) - 1) // stride + 1)) AS k FROM d, (SELECT DISTINCT stride FROM templates) WHERE len(words) > 0)),
met AS (SELECT id, label, len(list_intersect(tokens, block)) AS common, len(tokens) AS size, needed FROM blocks JOIN templates USING (stride)),
best AS (SELECT id, max(CAST(common AS DOUBLE) / size) AS best FROM met WHERE common >= needed GROUP BY id),
every AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM places UNION ALL SELECT id, label FROM met WHERE common >= needed) GROUP BY id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base IS NOT NULL THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN base USING (id) LEFT JOIN best USING (id) LEFT JOIN every USING (id)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_risk_rules": RISK_RULES,
    "op4_fair_mix": FAIR_MIX,
    "op5_chat_round_trip": CHAT,
    "op10_prefix_join": DECONTAMINATION,
    "op11_fill_middle": FILL_MIDDLE,
    "op12_source_divergence": DIVERGENCE,
    "op13_license_join": LICENSES,
}
