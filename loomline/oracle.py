"""The queries in SQL, for an independent engine.

Each statement is written from the meaning of its query, not from its plan.
"""

from __future__ import annotations

import json

from loomline import constants as C
from loomline.operators.prompts import CODEBOOK
from loomline.queries import _CONFIDENCE, _CRED, _NOTICES, LIMIT, OVERLAP, TERMS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q(pattern)})"


def _any(text: str, parts, fn: str) -> str:
    return "(" + " OR ".join(f"{fn}({text}, {_q(p)})" for p in parts) + ")"


def _pick(values, n: str) -> str:
    return f"({_list(values)})[(({n}) % {len(values)}) + 1]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _one_line(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _cut(x: str, n: int) -> str:
    cut = f"substring({x}, 1, {n})"
    return rf"CASE WHEN length({x}) <= {n} THEN {x} WHEN contains({cut}, ' ') THEN regexp_replace({cut}, '(?s) [^ ]*\z', '') ELSE {cut} END"


def _brief(x: str, n: int) -> str:
    t = _one_line(x)
    cut = f"substring({t}, 1, {n - 1})"
    return rf"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(CASE WHEN substring({t}, {n}, 1) <> ' ' AND contains({cut}, ' ') THEN regexp_replace({cut}, ' [^ ]*\z', '') ELSE {cut} END) || '…' END"


_ROLE = _strip("coalesce(role, '')")
_ACTOR = "CASE r WHEN '' THEN 'unknown' " + " ".join(f"WHEN {_q(r)} THEN {_q(a)}" for r, a in C.ROLE_ACTORS.items()) + " ELSE r END"
_M = f"SELECT DISTINCT id, session_id, lower({_ROLE}) AS r, content, tool_name FROM messages WHERE session_id IS NOT NULL"
_LOW, _TOOL = "lower(coalesce(content, ''))", "coalesce(tool_name, '')"
_RULES = {
    "blank": f"{_strip(_LOW)} = '' AND {_TOOL} = ''",
    "system": "r = 'system'",
    "compaction": _any(_LOW, C.SKIP_COMPACTION, "contains"),
    "important": f"starts_with({_LOW}, {_q(C.SKIP_IMPORTANT_PREFIX)}) OR {_any(_LOW, C.SKIP_IMPORTANT, 'contains')}",
    "task_list": f"starts_with({_LOW}, {_q(C.SKIP_TASK_LIST_PREFIX)})",
    "skill_dump": _any(_LOW, C.SKIP_SKILL_DUMP, "contains"),
    "skill_tool": f"{_TOOL} IN ('skill_view', 'skills_list')",
    "other_tool": f"r = 'tool' AND {_TOOL} NOT IN ('terminal', 'process', 'browser_console')",
    "tool_definitions": f"contains({_LOW}, 'tool definitions') AND contains({_LOW}, 'namespace')",
}
_T = "SELECT DISTINCT turn_id, session_id, idx, actor, text, tool_name FROM turns"
_EXCLUDED = f"""SELECT id AS session_id FROM sessions WHERE {_any("lower(concat_ws(chr(10), id, source, title, started_at, message_count, cwd))", TERMS, "contains")}
  UNION SELECT session_id FROM messages WHERE session_id IS NOT NULL AND {_any(_LOW, TERMS, "contains")}"""


def _masked(source: str, key: str) -> str:
    """CTEs `span` and `masked` (key, shown, level, n_hits) of the texts of `source`: offsets of matches are sums of the lengths of what lies between them."""
    one = lambda rank, kind, p: f"""SELECT {key}, {rank} AS rank, {_q(kind)} AS kind, (list_sum(list_transform(pc[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(mt[1:k - 1], lambda x: length(x))), 0))::BIGINT AS s, length(mt[k]) AS n
      FROM (SELECT {key}, string_split_regex(text, {_q(p)}) AS pc, regexp_extract_all(text, {_q(p)}) AS mt, unnest(range(1, len(regexp_extract_all(text, {_q(p)})) + 1)) AS k FROM ({source}) WHERE regexp_matches(text, {_q(p)}))"""  # noqa: E731
    hits = " UNION ALL ".join(one(i, kind, p) for i, (kind, p, _) in enumerate(C.DETECTORS))
    label = "CASE kind " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in {kind: name for kind, _, name in C.DETECTORS}.items()) + " END"
    return f"""hit AS ({hits}),
reach AS (SELECT *, max(s + n) OVER (PARTITION BY {key} ORDER BY s, s + n, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM hit),
isle AS (SELECT *, sum((far IS NULL OR s > far)::INT) OVER (PARTITION BY {key} ORDER BY s, s + n, rank ROWS UNBOUNDED PRECEDING) AS isle FROM reach),
span AS (SELECT {key}, isle, min(s) AS a, max(s + n) AS e, CASE WHEN bool_or(kind = 'secret') THEN 'secret' ELSE arg_min(kind, (s, s + n, rank)) END AS kind FROM isle GROUP BY {key}, isle),
cut AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY isle), 0) AS p FROM span),
masked AS (SELECT {key}, string_agg(substring(text, p + 1, a - p) || '[REDACTED_' || {label} || '_' || isle::BIGINT || ']', '' ORDER BY isle) || substring(any_value(text), max(e) + 1) AS shown,
  CASE WHEN bool_or(kind IN ('secret', 'credential_name')) THEN 'secret' ELSE 'personal' END AS level, count(*)::INT AS n_hits FROM cut JOIN ({source}) USING ({key}) GROUP BY {key})"""


def _tokens() -> str:
    body = f"length({_one_line('shown')})"
    tool = "CASE WHEN coalesce(tool_name, '') <> '' THEN length(tool_name) + 6 ELSE 0 END"
    n = f"length(turn_id) + length(idx::VARCHAR) + length(actor) + {tool} + least({body}, {C.TURN_CHARS[0] + 1}) + {len('turn_id= idx= actor=: ')}"
    return f"greatest(1, ceil(({n}) / 4.0))::BIGINT"


#: Letters beyond ASCII as one that is: this engine's word bounds only know ASCII.
_PLAIN = r"regexp_replace(coalesce(text, chr(32)), '[^\P{L}\x00-\x7F]', 'x', 'g')"
_FLAGGED = f"SELECT *, {_tokens()} AS tok, " + ", ".join(f"{_has(_PLAIN, p)} AS f_{f}" for f, p in C.FAMILY_PATTERNS.items()) + f" FROM (SELECT x.*, coalesce(shown, text, '') AS shown FROM ({_T}) x LEFT JOIN masked USING (turn_id))"
_BITS = ", ".join(f"bool_or(t.f_{f}) AS {f}" for f in C.FAMILY_PATTERNS)
#: Windows by recursion over a session's turns as a list; `p` holds the running totals.
_WINDOWS = f"""
WITH RECURSIVE {_masked(_T, "turn_id")},
t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS k FROM ({_FLAGGED})),
s AS (SELECT session_id, count(*) AS n, list(tok ORDER BY k) AS toks FROM t GROUP BY session_id),
p AS (SELECT session_id, n, [0::HUGEINT] || list_transform(range(1, n + 1), lambda i: list_sum(toks[1:i])) AS pre FROM s),
w AS (
  SELECT session_id, 0 AS wi, 0 AS a, greatest(1, len(list_filter(pre, lambda x: x <= {LIMIT})) - 1) AS e, n, pre FROM p
  UNION ALL
  SELECT session_id, wi + 1, b, greatest(b + 1, len(list_filter(pre, lambda x: x <= pre[b + 1] + {LIMIT})) - 1), n, pre
  FROM (SELECT *, greatest(a + 1, len(list_filter(pre, lambda x: x <= pre[e + 1] - {OVERLAP})) - 1) AS b FROM w WHERE e < n)
),
win AS (SELECT w.session_id, w.wi AS window_index, x.idx AS start_idx, y.idx AS end_idx, (least(e, n) - a) AS n_turns, (pre[least(e, n) + 1] - pre[a + 1])::BIGINT AS tokens, a, least(e, n) AS e
  FROM w JOIN t x ON x.session_id = w.session_id AND x.k = a + 1 JOIN t y ON y.session_id = w.session_id AND y.k = least(e, n)),
mem AS (SELECT win.session_id, window_index, start_idx, end_idx, t.* EXCLUDE (session_id) FROM win JOIN t ON t.session_id = win.session_id AND t.k > win.a AND t.k <= win.e),
ids AS (SELECT *, 'cie_win_' || substring(sha1(session_id || ':' || window_index || ':' || start_idx || ':' || end_idx), 1, 16) AS window_id FROM win),
fam AS (SELECT t.session_id, window_index, {_BITS} FROM mem t GROUP BY ALL),
routed AS (SELECT session_id, window_index, list_filter([
  {", ".join(f"CASE WHEN {f + (' OR model_routing' if f == 'authorization_limit' else '')} THEN {_q(f)} END" for f in C.PASS_CODES)}], lambda x: x IS NOT NULL) AS fams FROM fam)
"""

_SECRET = " OR ".join(_has("text", p) for k, p, _ in C.DETECTORS if k in ("secret", "credential_name"))
_OTHER = " OR ".join(_has("text", p) for k, p, _ in C.DETECTORS if k not in ("secret", "credential_name"))


def _hits() -> str:
    kinds: dict[str, list[str]] = {}
    for k, p, _ in C.DETECTORS:
        kinds.setdefault(k, []).append(f"len(regexp_extract_all(text, {_q(p)}))")
    return ", ".join(f"coalesce({' + '.join(v)}, 0)::INT AS n_{k}" for k, v in kinds.items())


_BARE = _one_line(r"regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '`[^`]*`', '', 'g')")
_QUESTION = f"(ends_with({_BARE}, '?') AND {_has(_BARE, C.QUESTION_START)})"
_CORRECTION = _has("text", C.CORRECTION)
_AUTHORITY = _has("lower(text)", C.AUTHORIZATION)
_FAILURE = f"({_has('text', C.FAILURE_CERTAIN)} OR ({_has('lower(text)', C.FAILURE_EXIT)} AND {_has('text', C.FAILURE_LINE)}))"
_STRIPPED = _strip("lower(text)")


def _words(words) -> str:
    return "(" + " + ".join(f"{_has(_STRIPPED, chr(92) + 'b' + w + chr(92) + 'b')}::INT" for w in words) + ")"


_METHOD = f"(NOT {_any(_STRIPPED, C.METHOD_STATUS_PREFIXES, 'starts_with')} AND {_words(C.METHOD_WORDS)} >= 2)"
_CALM = f"replace({_STRIPPED}, '’', chr(39))"
_SINK = f"""CASE WHEN {_any(_CALM, C.METHOD_REPORT_PREFIXES, "starts_with")} THEN 'report_only' WHEN {_any(_CALM, C.METHOD_REUSABLE, "contains")} THEN 'skill_candidate'
  WHEN {_any(_CALM, C.METHOD_NEAR_TERM, "starts_with")} THEN 'report_only' WHEN {_words(C.METHOD_STRUCTURE)} >= 3 THEN 'skill_candidate' ELSE 'report_only' END"""
_METHOD_KIND = "CASE WHEN contains(lower(text), 'fable') OR contains(lower(text), 'strategy') THEN 'strategy_review' ELSE 'plan_spike_build_verify' END"
_TOOLED = "actor = 'tool' AND tool_name IN ('terminal', 'process')"
_HITS = f"""
WITH t AS ({_T}), hit AS (
  SELECT *, 0 AS branch, 'steering' AS stream, 'clarification_qa' AS ptype, 'clarification_qa' AS cap_key, 10 AS cap, 'User asks: ' AS intro, 'user' AS who, 'memory_candidate' AS sink, 0.72 AS confidence FROM t WHERE actor = 'user' AND {_QUESTION}
  UNION ALL SELECT *, 1, 'steering', CASE WHEN {_AUTHORITY} THEN 'authorization_limit' ELSE 'correction' END, 'correction', 10, 'User sets boundary: ', 'user', 'profile_candidate', 0.82 FROM t WHERE actor = 'user' AND {_CORRECTION}
  UNION ALL SELECT *, 2, 'behavior', 'clarification_trigger', 'clarification_trigger', 8, 'Agent asks: ', 'agent', 'report_only', 0.72 FROM t WHERE actor = 'agent' AND {_QUESTION}
  UNION ALL SELECT *, 3, 'behavior', 'failure_recovery_arc', 'failure_recovery_arc', 5, 'Terminal/process failure: ', 'agent', 'skill_candidate', 0.72 FROM t WHERE {_TOOLED} AND {_FAILURE}
  UNION ALL SELECT *, 4, 'methodology', {_METHOD_KIND}, {_METHOD_KIND}, 8, {_METHOD_KIND} || ': ', 'agent', {_SINK}, 0.68 FROM t WHERE actor = 'agent' AND {_METHOD}
), capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, stream, cap_key ORDER BY idx, turn_id) AS rank FROM hit) WHERE rank <= cap)
"""


def _dedupe(x: str) -> str:
    t = f"lower({_one_line(x)})"
    for a, b in ((r"\bba-m\d+-\d+\b", "ba-m#"), (r"\bproc_\w+\b", "proc_#"), (r"\b\d+\b", "#")):
        t = f"regexp_replace({t}, {_q(a)}, {_q(b)}, 'g')"
    return t


_RECORDS = f"""{_HITS},
q AS (SELECT *, {_cut(_strip("text"), C.QUOTE_CHARS)} AS quote, intro || ({_brief("text", C.BRIEF_CHARS)}) AS raw FROM capped),
g AS (SELECT *, CASE WHEN {_SECRET.replace("(text,", "(raw || chr(10) || quote,")} THEN 'secret' WHEN {_OTHER.replace("(text,", "(raw || chr(10) || quote,")} THEN 'personal' ELSE 'internal' END AS sensitivity FROM q WHERE quote <> ''),
s AS (SELECT *, CASE WHEN sensitivity = 'internal' THEN raw ELSE stream || '/' || ptype || ' record with suppressed sensitive anchor' END AS summary, {_dedupe("quote")} AS k0 FROM g),
k AS (SELECT *, CASE WHEN starts_with(k0, 'full verification is green') AND contains(k0, 'fable') AND contains(k0, 'review') THEN 'template:full-verification-green-fable-review'
  WHEN starts_with(k0, 'i''m invoking') AND contains(k0, 'fable') AND contains(k0, 'review') THEN 'template:invoking-fable-review' ELSE k0 END AS ekey, {_dedupe("summary")} AS skey FROM s),
r AS (SELECT *, 'rec:' || substring(sha256(concat_ws(chr(31), session_id, stream, ptype, who, CASE WHEN starts_with(ekey, 'template:') THEN ekey ELSE skey END, ekey)), 1, 24) AS record_id FROM k)
SELECT record_id, session_id, stream, ptype AS pattern_type, summary, who AS actor, confidence::DOUBLE AS confidence, sensitivity,
  CASE WHEN sensitivity = 'secret' THEN 'quarantine' WHEN sensitivity = 'personal' AND sink NOT IN ('report_only', 'quarantine') THEN 'report_only' ELSE sink END AS recommended_sink
FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY idx, branch) AS n FROM r) WHERE n = 1"""


def _judged() -> str:
    """`v` (window_id, family, position, reason, confidence, credibility): every rule from the position of the turn a record is about."""
    code = _pick((*C.ALL_CODES, "other"), "idx")
    family = "CASE " + " ".join(f"WHEN code IN ({', '.join(map(_q, own))}) THEN {_q(f)}" for f, own in C.PASS_CODES.items()) + " ELSE 'methodology_workflow' END"
    allowed = "CASE family " + " ".join(f"WHEN {_q(f)} THEN {_list(own)}" for f, own in C.PASS_CODES.items()) + " END"
    number = rf"""CASE WHEN cred = 'true' THEN 1 WHEN starts_with(cred, '"') THEN try_cast(regexp_extract(cred, '^"\s*([+-]?\d+)\s*"$', 1) AS INT) ELSE trunc(try_cast(cred AS DOUBLE))::INT END"""
    ins = lambda c, vs: f"{c} IN ({', '.join(map(_q, vs))})"
    return f"""
WITH a AS (SELECT turn_id, session_id, idx, actor, CASE WHEN idx % 37 = 0 THEN {_pick(_NOTICES, "idx // 37")} ELSE coalesce(text, '') END AS text, session_id || ':' || (idx // 64) AS window_id, {code} AS code, {_pick((*C.UNITS, "turn", "turn", "turn", "cross_session"), "idx")} AS unit, {_pick((*C.SOURCE_RELIABILITY, "G"), "idx")} AS rel,
  {_pick(_CRED, "idx")} AS cred, {_pick(_CONFIDENCE, "idx")} AS conf, CASE WHEN idx % 31 = 0 THEN 2 ELSE idx % 4 END AS n_ev, {_pick((*C.DELIVERY_VALUES, "x"), "idx")} AS delivery, {_pick(C.CAUSE_VALUES, "idx")} AS cause FROM ({_T})),
b AS (SELECT *, {family} AS family, substring(md5(window_id || {family}), 1, 1) = '0' AS odd FROM a), c AS (SELECT *, {number} AS num, row_number() OVER (PARTITION BY window_id, family ORDER BY idx) - 1 AS position FROM b),
-- the turn a quote is bound to: the cited one, or the first of the window that holds it
bound AS (SELECT x.turn_id, arg_min(y.actor, y.idx) AS first_actor FROM c x JOIN c y ON y.window_id = x.window_id AND contains(y.text, x.text) WHERE x.idx % 5 = 0 GROUP BY 1),
j AS (SELECT c.*, CASE
  WHEN idx % 29 = 0 THEN 'record_not_object' WHEN NOT list_contains({allowed}, code) THEN 'code_not_allowed' WHEN NOT {ins("unit", C.UNITS)} THEN 'unit_not_allowed'
  WHEN NOT {ins("rel", C.SOURCE_RELIABILITY)} THEN 'source_reliability_not_allowed' WHEN num IS NULL THEN 'info_credibility_not_int' WHEN num NOT BETWEEN 1 AND 6 THEN 'info_credibility_out_of_range'
  WHEN n_ev = 0 THEN 'missing_evidence' WHEN idx % 9 = 0 OR text = '' THEN 'quote_not_found' WHEN idx % 31 = 0 THEN 'evidence_not_object' WHEN idx % 37 = 0 THEN 'platform_primary_evidence_denied'
  WHEN code = 'model_routing' AND NOT {_has("text", C.NAMED_ROUTE)} THEN 'model_routing_without_named_route'
  WHEN {ins("code", C.OUTCOME_CODES)} AND NOT ({ins("delivery", C.DELIVERY_VALUES)} AND {ins("cause", C.CAUSE_VALUES)}) THEN 'outcome_facets_invalid'
  WHEN code = 'rework_cause' AND (cause = 'none' OR delivery IN ('landed', 'unknown')) THEN 'rework_cause_without_real_cause'
  WHEN (code = 'intent_stated' AND NOT (delivery = 'unknown' AND cause = 'none')) OR (code = 'delivery_result' AND delivery IN ('landed', 'unknown') AND cause <> 'none') THEN 'outcome_facets_invalid'
  WHEN rel = 'A' AND coalesce(first_actor, actor) NOT IN ('user', 'system') THEN 'source_reliability_a_without_direct_source' END AS reason0 FROM c LEFT JOIN bound USING (turn_id) WHERE NOT odd),
k AS (SELECT *, CASE WHEN reason0 IS NULL AND row_number() OVER (PARTITION BY window_id, family, reason0 IS NULL ORDER BY position) > 3 THEN 'too_many_records' ELSE reason0 END AS reason FROM j),
v AS (SELECT window_id, family, position::INT AS position, reason, CASE WHEN idx % 29 <> 0 THEN CASE WHEN conf IN ('0.9', '"High"', 'true') THEN 'high' WHEN conf = '0.5' THEN 'medium' ELSE 'low' END END AS confidence, CASE WHEN reason IS NULL THEN num END AS credibility FROM k
  UNION ALL SELECT DISTINCT window_id, family, -1, 'records_not_list', NULL, NULL::INT FROM c WHERE odd)
"""


_EDGE = r"'^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$'"


def _dtext(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g')), {_EDGE}, '', 'g')"


_KEYED = f"""
WITH e AS (SELECT *, CASE WHEN json_valid(evidence_json) THEN list_transform(from_json(evidence_json, '[{{"quote":"VARCHAR"}}]'), lambda x: x.quote) ELSE [] END AS quotes FROM (SELECT * EXCLUDE (dedup_key) FROM cie_records)),
o AS (SELECT *, list_filter(list_transform(coalesce(quotes, []), lambda q: {_dtext("q")}), lambda q: q <> '') AS own FROM e),
u AS (SELECT *, list_sort(list_distinct(own)) AS uniq, coalesce(own[1], '') AS prim FROM o),
keyed AS (SELECT *, coalesce(occurrence_count, 1)::BIGINT AS occurrences, quotes[1] AS first_quote, 'cie_dedup_v2_' || substring(sha256(CASE
  WHEN len(uniq) >= 2 AND len(list_filter(uniq, lambda q: length(q) >= 15)) > 0 THEN concat_ws(chr(31), 'v2', 'quote_set', {_dtext("codebook_code")}, array_to_string(uniq, chr(30)))
  WHEN length(prim) >= 15 THEN concat_ws(chr(31), 'v2', 'primary_quote', {_dtext("codebook_code")}, prim)
  ELSE concat_ws(chr(31), 'v2', 'weak_quote_statement_guard', {_dtext("codebook_code")}, prim, {_dtext("statement")}) END), 1, 32) AS dedup_key FROM u),
merged AS (SELECT dedup_key, arg_max(record_id, (length(coalesce(statement, '')), coalesce(nullif(last_seen, ''), nullif(created_at, ''), ''), record_id)) AS record_id,
  sum(occurrences)::BIGINT AS occurrences, min(nullif(first_seen, '')) AS first_seen, max(nullif(last_seen, '')) AS last_seen, count(*) AS n_rows FROM keyed GROUP BY dedup_key)
"""
_LEDGER = f"SELECT user_id::VARCHAR AS session_id, event_type AS family, {_pick(('processed', 'processed', 'no_signal', 'error'), 'event_id')} AS status, event_id, event_id % 4 AS created, event_id % 3 AS rejected FROM events"


def _wilson(h: str, n: str) -> tuple[str, str]:
    z = C.Z_95
    mid, spread, den = f"({h}::DOUBLE / {n} + {z * z} / (2.0 * {n}))", f"({z} * sqrt((({h}::DOUBLE / {n}) * (1 - {h}::DOUBLE / {n}) + {z * z} / (4.0 * {n})) / {n}))", f"(1 + {z * z} / {n})"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0.0, ({mid} - {spread}) / {den}), 6) ELSE 0.0 END", f"CASE WHEN {n} > 0 THEN round(least(1.0, ({mid} + {spread}) / {den}), 6) ELSE 0.0 END"


def _scores(by: str = "", strict: bool = False) -> str:
    g, c, m = "sum(gold)::BIGINT", "sum(cand)::BIGINT", "(SELECT coalesce(sum(n), 0) FROM taken)::BIGINT" if strict else "sum(least(gold, cand))::BIGINT"
    (rl, rh), (al, ah) = _wilson("matched", "gold"), _wilson("matched", "candidates")
    r, a = "CASE WHEN gold > 0 THEN matched::DOUBLE / gold ELSE 0.0 END", "CASE WHEN candidates > 0 THEN matched::DOUBLE / candidates ELSE 0.0 END"
    # candidates in order, each with the gold records it shares four words with; each takes the first that is left
    one = lambda v: f"SELECT session_id, codebook_code AS code, row_number() OVER (PARTITION BY session_id, codebook_code ORDER BY record_id)::INT AS k, unnest(list_distinct({_grams('first_quote')})) AS run FROM keyed WHERE extractor_version = '{v}'"
    taken = f""" gs AS ({one("cie-v1")}), cs AS ({one("cie-v0")}), fit AS (SELECT session_id, code, cs.k AS c, list_sort(list_distinct(list(gs.k))) AS g FROM cs JOIN gs USING (session_id, code, run) GROUP BY ALL),
taken AS (SELECT session_id, code, len(list_reduce(list(g ORDER BY c), lambda acc, x: list_concat(acc, list_filter(x, lambda i: NOT list_contains(acc, i))[1:1]), []::INT[])) AS n FROM fit GROUP BY ALL),""" if strict else ""
    return f"""{_KEYED},{taken} gold AS (SELECT session_id, codebook_code AS code, count(*) AS n FROM keyed WHERE extractor_version = 'cie-v1' GROUP BY ALL),
cand AS (SELECT session_id, codebook_code AS code, count(*) AS n FROM keyed WHERE extractor_version = 'cie-v0' GROUP BY ALL),
sizes AS (SELECT session_id, CASE WHEN count(*) <= 3 THEN 'short' WHEN count(*) <= 20 THEN 'medium' ELSE 'long' END AS bucket FROM ({_T}) GROUP BY session_id),
both_ AS (SELECT coalesce(gold.session_id, cand.session_id) AS session_id, coalesce(gold.n, 0) AS gold, coalesce(cand.n, 0) AS cand FROM gold FULL JOIN cand USING (session_id, code)),
tot AS (SELECT {by + "," if by else ""} {g} AS gold, {c} AS candidates, {m} AS matched FROM (SELECT both_.*, coalesce(bucket, 'unknown') AS bucket FROM both_ LEFT JOIN sizes USING (session_id)) {"GROUP BY " + by if by else ""})
SELECT {by + "," if by else ""} gold, candidates, matched, round({r}, 6) AS recall, round({a}, 6) AS agreement,
  round(CASE WHEN ({r}) + ({a}) > 0 THEN 2 * ({r}) * ({a}) / (({r}) + ({a})) ELSE 0.0 END, 6) AS f1, {rl} AS recall_low, {rh} AS recall_high, {al} AS agreement_low, {ah} AS agreement_high FROM tot"""


def _grams(x: str) -> str:
    w = rf"list_filter(string_split_regex(lower({x}), '\s+'), lambda v: v <> '')"
    return f"list_transform(range(1, len({w}) - 2), lambda i: array_to_string(({w})[i:i + 3], ' '))"


_FILES = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT id, session_id, role, content, tool_name FROM messages WHERE session_id IS NOT NULL)),
m AS (SELECT session_id || ':' || (idx // 64) AS session_id, idx, coalesce(role, '') AS role, coalesce(nullif(content, ''), 'x') AS text, coalesce(tool_name, '') AS tool FROM n),
f AS (SELECT session_id, d, session_id || CASE WHEN d = 0 THEN '.txt' WHEN d < 8 THEN '.jsonl' ELSE '.json' END AS path FROM (SELECT session_id, ('0x' || substring(md5(session_id), 1, 1))::INT AS d FROM (SELECT DISTINCT session_id FROM m)))
"""


def _book() -> str:
    """CTEs `shot` and `code` with the rows of the codebook, and `pass`."""
    with open(CODEBOOK, encoding="utf-8") as f:
        book = json.load(f)
    shots = ", ".join(f"({i}, {_q(x['codebook_code'])}, {_q(x['family'])}, {x['near_miss']}, {'facets' in x})" for i, x in enumerate(book["few_shots"]))
    codes = ", ".join(f"({_q(x['code'])}, {len(x['includes'])}, {len(x['excludes'])})" for x in book["codes"])
    passes = ", ".join(f"({_q(f)}, {_q(c)})" for f, own in {**C.PASS_CODES, "all": C.ALL_CODES}.items() for c in own)
    return f"WITH shot(ord, code, source, near, faceted) AS (VALUES {shots}), code(code, i, e) AS (VALUES {codes}), pass(family, code) AS (VALUES {passes})"


def oracle_sql() -> dict[str, str]:
    lo, hi = _wilson("hits", "total")
    window_ids = f"{_WINDOWS} SELECT window_id, session_id, window_index FROM ids"
    passes = f"{_WINDOWS}, plan AS (SELECT window_id, unnest(fams) AS family FROM ids JOIN routed USING (session_id, window_index))"
    kept = "NOT (" + " OR ".join(f"({r})" for r in _RULES.values()) + ")"
    quote = f"CASE WHEN idx % 13 = 0 THEN {_pick([*C.NOTICE_EXACT, 'terminal_foreground_timeout_cap', 'hardline_shutdown_reboot_block', ''], 'idx // 13')} ELSE '' END"
    digest = "sha256(concat_ws(chr(31), idx::VARCHAR, actor, coalesce(tool_name, ''), coalesce(text, '')))"
    clip = lambda n: f"sum(length('turn_id=' || turn_id || ' idx=' || idx || ' actor=' || actor || CASE WHEN coalesce(tool_name, '') <> '' THEN ' tool=' || tool_name ELSE '' END || ': ') + least(length({_one_line('shown')}), {n + 1}) + 1)::BIGINT"
    evidence = "SELECT record_id, unnest(CASE WHEN json_valid(evidence_json) THEN from_json(evidence_json, '[{\"turn_id\":\"VARCHAR\",\"quote\":\"VARCHAR\"}]') ELSE [] END, recursive := true)"
    events_usage = """SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE 'grok-4.3' END AS model, event_id % 1000 AS p, event_id % 300 AS c, CASE WHEN event_id % 2 = 0 THEN event_id % 1400 ELSE 0 END AS t0, CASE WHEN event_id % 3 = 0 THEN event_id * 100 END AS ticks FROM events"""
    return {
        "turns_normalized": f"SELECT session_id || ':' || idx AS turn_id, session_id, idx::INT AS idx, {_ACTOR} AS actor, nullif(tool_name, '') AS tool_name, length(coalesce(content, ''))::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 AS idx FROM ({_M})) WHERE {kept}",
        "turn_offsets": f"SELECT turn_id, (s - n)::BIGINT AS char_start, (s - 1)::BIGINT AS char_end FROM (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY idx) AS s FROM (SELECT turn_id, session_id, idx, length(coalesce(text, '')) + 1 AS n FROM ({_T})))",
        "actor_turn_counts": f"SELECT {_ACTOR} AS actor, count(*) AS n, sum(length(coalesce(content, '')))::BIGINT AS n_chars FROM ({_M}) GROUP BY 1",
        "skip_rule_counts": " UNION ALL ".join(f"SELECT {_q(k)} AS rule, count(*) FILTER ({r}) AS n FROM ({_M})" for k, r in _RULES.items()),
        "exclude_feedback_sessions": _EXCLUDED,
        "newest_n_sessions": f"SELECT id, started_at, message_count FROM sessions WHERE message_count > 0 AND started_at > 1740000000.0 AND id NOT IN (SELECT session_id FROM ({_EXCLUDED})) ORDER BY started_at DESC, id DESC LIMIT 20",
        "content_hash_changes": f"""WITH t AS ({_T}), h AS (SELECT session_id, which, substring(sha256(concat_ws(':', a, b, n::VARCHAR)), 1, 16) AS content_hash FROM (
          SELECT session_id, which, sum(('0x' || substring(d, 1, 15))::HUGEINT)::VARCHAR AS a, sum(('0x' || substring(d, 16, 15))::HUGEINT)::VARCHAR AS b, count(*) AS n FROM (
          SELECT session_id, 'old' AS which, {digest} AS d FROM t UNION ALL SELECT session_id, 'new', {digest} FROM (SELECT * REPLACE (CASE WHEN idx % 97 = 3 THEN text || '!' ELSE text END AS text) FROM t)) GROUP BY ALL))
          SELECT session_id, content_hash FROM h WHERE which = 'new' AND (session_id, content_hash) NOT IN (SELECT (session_id, content_hash) FROM h WHERE which = 'old')""",
        "transcript_files": f"{_FILES} SELECT path, CASE WHEN d IN (0, 7, 15) THEN 'error' ELSE 'normalized' END AS status, d IN (0, 7, 15) AS told FROM f",
        "transcript_messages": f"""{_FILES} SELECT m.session_id, (idx % 64)::INT AS idx, coalesce(nullif(role, ''), 'unknown') AS role, CASE WHEN idx % 4 = 0 THEN text ELSE text || chr(10) || 'tail' END AS text, CASE WHEN idx % 4 < 2 THEN nullif(tool, '') END AS tool_name, CASE WHEN idx % 4 = 2 THEN 't' END AS ts
          FROM m JOIN f USING (session_id) WHERE d NOT IN (0, 7, 15)""",
        "replaced_sessions": f"SELECT session_id, count(*) AS n FROM ({_T}) WHERE substring(md5(session_id), 1, 1) <> '0' OR idx < 5 GROUP BY 1",
        "token_estimate": f"WITH {_masked(_T, 'turn_id')} SELECT session_id, count(*) AS n_turns, sum(tok)::BIGINT AS tokens, max(tok)::INT AS largest FROM ({_FLAGGED}) GROUP BY session_id",
        "session_windows": f"{_WINDOWS} SELECT session_id, window_index, start_idx, end_idx, n_turns, tokens FROM win",
        "window_ids": window_ids,
        "window_overlap_turns": f"{_WINDOWS} SELECT turn_id, count(*) AS n_windows FROM mem GROUP BY turn_id HAVING count(*) > 1",
        "family_routing": f"{_WINDOWS} SELECT session_id, window_index, array_to_string(fams, ',') AS families FROM routed",
        "no_signal_windows": f"{_WINDOWS} SELECT window_id, session_id, 'no_signal' AS status FROM ids JOIN routed USING (session_id, window_index) WHERE len(fams) = 0",
        "planned_prompts": f"{passes} SELECT 'per_family' AS strategy, family, count(*) AS n FROM plan GROUP BY family UNION ALL SELECT 'combined', 'all', count(*) FROM ids",
        "resume_remaining": f"{passes} SELECT window_id, family FROM plan WHERE ('0x' || substring(window_id, 9, 4))::BIGINT % 3 = 1",
        "prompt_clip_tier": f"{_WINDOWS}, z AS (SELECT session_id, window_index, {clip(200)} AS n1, {clip(90)} AS n2, {clip(42)} AS n3 FROM mem GROUP BY ALL) SELECT session_id, window_index, n1, n2, n3, CASE WHEN ceil((n1 + 400) / 4.0) <= 300 THEN 1 WHEN ceil((n2 + 400) / 4.0) <= 300 THEN 2 ELSE 3 END AS tier FROM z",
        "prompt_examples": f"""{_book()}, room AS (SELECT DISTINCT family, CASE family WHEN 'all' THEN 3 WHEN 'outcome_attribution' THEN 7 ELSE 4 END AS n FROM pass),
          own AS (SELECT r.family, r.n, s.* FROM room r JOIN shot s ON s.source = r.family OR EXISTS (SELECT 1 FROM pass p WHERE p.family = r.family AND p.code = s.code)),
          good AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ord) AS k FROM own WHERE NOT near), near AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ord) AS k FROM own WHERE near),
          must AS (SELECT family, min(ord) AS ord FROM good WHERE family = 'all' AND code = 'rework_cause' AND faceted GROUP BY 1 HAVING arg_min(k, ord) > 3),
          kept AS (SELECT g.family, 0 AS part, g.k, g.ord FROM good g LEFT JOIN must m USING (family) WHERE g.k <= g.n - (m.family IS NOT NULL)::INT UNION ALL SELECT family, 0, 1000, ord FROM must UNION ALL SELECT family, 1, k, ord FROM near WHERE k <= 2)
          SELECT family, row_number() OVER (PARTITION BY family ORDER BY part, k) AS place, ord FROM kept""",
        "pass_cards": f"{_book()} SELECT family, code, CASE WHEN family = 'all' THEN least(i, 2) ELSE i END AS includes, CASE WHEN family = 'all' THEN least(e, 2) ELSE e END AS excludes FROM pass JOIN code USING (code)",
        "sensitivity_level": f"SELECT doc_id, CASE WHEN {_SECRET} THEN 'secret' WHEN {_OTHER} THEN 'personal' ELSE 'internal' END AS level FROM documents",
        "secret_hit_counts": f"SELECT doc_id, {_hits()} FROM documents",
        "masked_text": f"WITH d AS (SELECT doc_id, text FROM documents), {_masked('SELECT doc_id, text FROM d', 'doc_id')} SELECT doc_id, coalesce(shown, text) AS text, CASE WHEN text IS NOT NULL THEN coalesce(level, 'internal') END AS level, CASE WHEN text IS NOT NULL THEN coalesce(n_hits, 0) END AS n_hits FROM d LEFT JOIN masked USING (doc_id)",
        "question_signals": f"SELECT turn_id, actor FROM ({_T}) WHERE actor IN ('user', 'agent') AND {_QUESTION}",
        "correction_signals": f"SELECT turn_id, CASE WHEN {_AUTHORITY} THEN 'authorization_limit' ELSE 'correction' END AS pattern_type FROM ({_T}) WHERE actor = 'user' AND {_CORRECTION}",
        "tool_failures": f"SELECT turn_id FROM ({_T}) WHERE {_TOOLED} AND {_FAILURE}",
        "methodology_signals": f"SELECT turn_id FROM ({_T}) WHERE actor = 'agent' AND {_METHOD}",
        "methodology_sinks": f"SELECT {_SINK} AS sink, count(*) AS n FROM ({_T}) WHERE actor = 'agent' AND {_METHOD} GROUP BY 1",
        "brief_text": f"SELECT turn_id, {_brief('text', C.BRIEF_CHARS)} AS brief FROM ({_T})",
        "evidence_quote": f"SELECT doc_id, {_cut(_strip('text'), C.QUOTE_CHARS)} AS quote FROM documents",
        "signal_caps": f"{_HITS} SELECT session_id, stream, cap_key, count(*) AS n, max(idx) AS last_idx FROM capped GROUP BY ALL",
        "signal_records": _RECORDS,
        "payload_validation": f"{_judged()} SELECT * FROM v",
        "rejection_causes": f"{_judged()} SELECT reason, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY reason",
        "evidence_rebinding": f"""{_WINDOWS}, memw AS (SELECT window_id, mem.* FROM mem JOIN ids USING (session_id, window_index)), home AS (SELECT turn_id, min(window_id) AS window_id FROM memw GROUP BY 1),
          ev AS (SELECT record_id, item, turn_id AS own, regexp_extract(turn_id, '^(.*:)\\d+$', 1) || (regexp_extract(turn_id, ':(\\d+)$', 1)::INT + 1) AS cited, quote, home.window_id FROM (
            SELECT record_id, unnest(range(len(l))) AS item, unnest(l, recursive := true) FROM (SELECT record_id, CASE WHEN json_valid(evidence_json) THEN from_json(evidence_json, '[{{"turn_id":"VARCHAR","quote":"VARCHAR"}}]') ELSE [] END AS l FROM (SELECT DISTINCT record_id, evidence_json FROM records))) JOIN home USING (turn_id)),
          hits AS (SELECT record_id, item, count(*) AS n, arg_min(m.turn_id, (m.turn_id <> cited, m.idx, m.turn_id)) AS turn_id, bool_and(m.turn_id <> cited) AS other FROM ev JOIN memw m ON m.window_id = ev.window_id AND quote <> '' AND contains(coalesce(m.text, ''), quote) GROUP BY ALL)
          SELECT window_id, record_id, item::INT AS item, hits.turn_id, coalesce(n, 0) AS match_count, coalesce(other, false) AS rebound FROM ev LEFT JOIN hits USING (record_id, item)""",
        "platform_denylist": f"SELECT notice, count(*) AS n_rows, (2 * count(*))::BIGINT AS occurrences FROM (SELECT {quote} AS notice FROM ({_T})) WHERE notice <> '' GROUP BY notice",
        "dedup_key": f"{_KEYED} SELECT record_id, dedup_key FROM keyed",
        "dedup_merge": f"{_KEYED} SELECT * FROM merged",
        "dedup_upsert": f"""{_KEYED}, old AS (SELECT dedup_key, sum(occurrences)::BIGINT AS n, min(nullif(first_seen, '')) AS f, max(nullif(last_seen, '')) AS l FROM keyed WHERE extractor_version = 'cie-v0' GROUP BY 1),
          new AS (SELECT dedup_key, count(*) AS n, min(first_seen) AS f, max(last_seen) AS l FROM keyed WHERE extractor_version = 'cie-v1' GROUP BY 1)
          SELECT dedup_key, sum(n)::BIGINT AS occurrences, min(f) AS first_seen, max(l) AS last_seen FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY 1""",
        "occurrence_conservation": f"{_KEYED} SELECT (SELECT count(*) FROM keyed) AS rows_before, (SELECT sum(occurrences) FROM keyed)::BIGINT AS occurrences_before, count(*) AS rows_after, sum(occurrences)::BIGINT AS occurrences_after, (SELECT sum(occurrences) FROM keyed) = sum(occurrences) AS conserved FROM merged",
        "window_run_latest": f"SELECT session_id, family, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY session_id, family ORDER BY event_id DESC) AS k FROM ({_LEDGER})) WHERE k = 1",
        "progress_snapshot": f"SELECT family, status, count(*) AS runs, sum(created)::BIGINT AS created, sum(rejected)::BIGINT AS rejected, count(DISTINCT session_id) AS sessions FROM ({_LEDGER}) GROUP BY ALL",
        "errored_runs": f"SELECT event_id::VARCHAR AS window_id, session_id, family FROM ({_LEDGER}) WHERE status = 'error' AND event_id % 8 = 3",
        "work_queue": f"WITH s AS (SELECT DISTINCT session_id FROM turns) SELECT stream, 'pending' AS status, count(*) AS n FROM s, (SELECT unnest({_list(C.STREAMS)}) AS stream) WHERE NOT (stream = 'steering' AND substring(md5(session_id), 1, 1) IN ('0', '1', '2', '3')) GROUP BY stream",
        "stale_work": f"SELECT CASE WHEN s = 'failed' OR s = 'running' AND ts < TIMESTAMP '2024-01-15 12:00:00' THEN 'pending' ELSE s END AS status, count(*) AS n FROM (SELECT ts, {_pick(('running', 'running', 'failed', 'completed', 'pending'), 'event_id')} AS s FROM events) GROUP BY 1",
        "recall_code_level": _scores(),
        "recall_by_bucket": _scores("bucket"),
        "recall_quote_strict": _scores(strict=True),
        "quote_overlap": f"WITH e AS (SELECT record_id, unnest(from_json(evidence_json, '[{{\"turn_id\":\"VARCHAR\",\"quote\":\"VARCHAR\"}}]')[1:1], recursive := true) FROM cie_records WHERE json_valid(evidence_json)) SELECT record_id, list_has_any({_grams('quote')}, {_grams('text')}) AS overlaps FROM e JOIN ({_T}) t USING (turn_id)",
        "wilson_ci": f"SELECT event_type, hits, total, {lo} AS low, {hi} AS high FROM (SELECT event_type, count(*) AS total, count(*) FILTER (event_id % 5 = 0) AS hits FROM events GROUP BY 1)",
        "evidence_integrity": f"SELECT problem, count(*) AS n FROM (SELECT CASE WHEN t.turn_id IS NULL THEN 'missing_turn' WHEN NOT coalesce(contains(text, quote), false) THEN 'quote_not_in_turn' END AS problem FROM (SELECT record_id, CASE WHEN md5(record_id)[1] = '0' THEN turn_id || 'x' ELSE turn_id END AS turn_id, CASE WHEN md5(record_id)[1] = '1' THEN quote || ' (sic)' ELSE quote END AS quote FROM ({evidence} FROM (SELECT DISTINCT record_id, evidence_json FROM records))) e LEFT JOIN ({_T}) t ON t.turn_id = e.turn_id) WHERE problem IS NOT NULL GROUP BY 1",
        "run_mean_sd": "SELECT event_type, count(*) AS n_runs, round(avg(s), 6) AS mean, round(coalesce(stddev_samp(s), 0.0), 6) AS sd FROM (SELECT event_type, event_id % 3 AS run, avg(value) AS s FROM events GROUP BY ALL) GROUP BY 1",
        "transport_stats": f"SELECT family, count(*) AS passes, round(count(*) FILTER (status = 'error')::DOUBLE / count(*), 6) AS error_rate, round(count(*) FILTER (event_id % 10 <> 0)::DOUBLE / count(*), 6) AS valid_json_rate FROM ({_LEDGER}) GROUP BY 1",
        "outcome_distribution": "SELECT json_extract_string(facets_json, '$.delivery') AS delivery, count(*) AS n FROM cie_records WHERE codebook_code = 'delivery_result' GROUP BY 1",
        "rework_causes": f"""WITH r AS (SELECT json_extract_string(facets_json, '$.cause') AS cause FROM cie_records WHERE codebook_code = 'rework_cause'),
          c AS (SELECT x.cause, count(r.cause) AS n FROM (SELECT unnest({_list(C.REAL_CAUSES)}) AS cause) x LEFT JOIN r USING (cause) GROUP BY 1)
          SELECT cause, n, CASE WHEN sum(n) OVER () > 0 THEN round(n::DOUBLE / sum(n) OVER (), 6) ELSE 0.0 END AS share, CASE WHEN sum(n) OVER () > 0 THEN (SELECT cause FROM c ORDER BY n DESC, cause LIMIT 1) ELSE 'none' END AS top_cause FROM c""",
        "bucket_sessions": f"SELECT CASE WHEN n <= 3 THEN 'short' WHEN n <= 20 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS sessions, sum(n)::BIGINT AS turns FROM (SELECT session_id, count(*) AS n FROM ({_T}) GROUP BY 1) GROUP BY 1",
        "stratified_sample": f"SELECT bucket, session_id, rank FROM (SELECT bucket, session_id, row_number() OVER (PARTITION BY bucket ORDER BY md5('seed-7:' || session_id), session_id) AS rank FROM (SELECT session_id, CASE WHEN count(*) <= 3 THEN 'short' WHEN count(*) <= 20 THEN 'medium' ELSE 'long' END AS bucket FROM ({_T}) GROUP BY 1)) WHERE rank <= 5",
        "session_coverage": "SELECT extractor_version, count(DISTINCT session_id) AS sessions, count(*) AS n_records FROM cie_records GROUP BY 1",
        "topk_findings": "SELECT family, rank, record_id, occurrences FROM (SELECT family, record_id, coalesce(occurrence_count, 1)::BIGINT AS occurrences, row_number() OVER (PARTITION BY family ORDER BY coalesce(occurrence_count, 1) DESC, coalesce(last_seen, created_at) DESC NULLS LAST, statement NULLS FIRST, record_id) AS rank FROM cie_records) WHERE rank <= 10",
        "pilot_counts": " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce({d}, '(none)') AS value, count(*) AS n FROM (SELECT DISTINCT record_id, {d} FROM records) GROUP BY 2" for d in ("stream", "pattern_type", "sensitivity")),
        "pilot_examples": "WITH r AS (SELECT DISTINCT record_id, stream, pattern_type, sensitivity, confidence FROM records), top AS (SELECT stream, pattern_type FROM r GROUP BY ALL ORDER BY count(*) DESC, stream, pattern_type LIMIT 10) SELECT stream, pattern_type, rank, record_id FROM (SELECT *, row_number() OVER (PARTITION BY stream, pattern_type ORDER BY CASE WHEN sensitivity = 'internal' THEN 0 ELSE 1 END, confidence DESC NULLS LAST, record_id) AS rank FROM r) JOIN top USING (stream, pattern_type) WHERE rank <= 20",
        "shown_quotes": f"""WITH r AS (SELECT record_id, sensitivity, from_json(evidence_json, '[{{"quote":"VARCHAR"}}]')[1].quote AS text FROM (SELECT DISTINCT record_id, sensitivity, evidence_json FROM records) WHERE json_valid(evidence_json)), {_masked("SELECT record_id, text FROM r WHERE text IS NOT NULL", "record_id")}
          SELECT record_id, CASE WHEN sensitivity = 'internal' THEN substring(coalesce(shown, text), 1, 700) ELSE '[suppressed]' END AS shown FROM r LEFT JOIN masked USING (record_id) WHERE text IS NOT NULL""",
        "usage_cost": f"""WITH u AS (SELECT *, CASE WHEN t0 = 0 THEN p + c ELSE t0 END AS t FROM ({events_usage})), v AS (SELECT *, CASE WHEN t > p + c THEN t - p - c ELSE 0 END AS reason FROM u WHERE p + c + t0 > 0 OR ticks IS NOT NULL),
          w AS (SELECT event_type, model FROM u WHERE NOT (p + c + t0 > 0 OR ticks IS NOT NULL)),
          s AS (SELECT event_type, model, count(*) + (SELECT count(*) FROM w WHERE w.event_type = v.event_type AND w.model = v.model) AS calls, count(ticks) AS priced, sum(p) AS p, sum(c) AS c, sum(reason)::BIGINT AS reasoning, sum(t)::BIGINT AS total, sum(ticks) AS ticks FROM v GROUP BY event_type, model),
          x AS (SELECT *, CASE WHEN priced > 0 THEN ticks / 1e10 END AS exact, CASE WHEN model = 'grok-4.3' AND p + c + reasoning > 0 THEN (p * 1.25 + greatest(c + reasoning, total - p) * 2.5) / 1e6 END AS est FROM s)
          SELECT event_type, model, calls, priced, total, reasoning, round(exact, 6) AS exact_usd, round(est, 6) AS estimated_usd, round(greatest(exact, est), 6) AS effective_usd, CASE WHEN priced = calls THEN 'exact' WHEN priced > 0 THEN 'partial' WHEN est IS NOT NULL THEN 'estimated' ELSE 'unavailable' END AS cost_source FROM x""",
    }
