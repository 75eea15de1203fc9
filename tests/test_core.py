"""Behaviour of the operators on small rows: nulls, empties, ties, repeats, extra columns."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from loomline import constants as C
from loomline import queries
from loomline.functions import usage
from loomline.functions.text import brief, cut_at_word, strip
from loomline.operators import normalize, prompts, register, reports, scan, scoring, sensitivity, signals, validate, windows
from loomline.plans import benchmark, cycle, extract, model
from loomline.session import cut_lineage
from loomline.sources import transcripts
from loomline.sources.store import TableStore
from loomline.streaming import ingest


def one(df):
    return [tuple(r) for r in df.collect()]


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


# --- strings ---------------------------------------------------------------------


def test_brief_cuts_at_words(spark):
    long = "word " * 40
    out = col(spark, ["short", " a \n b ", long, "x" * 200, None, ""], lambda c: brief(c, 20))
    assert out[0] == "short" and out[1] == "a b" and out[4] is None and out[5] == ""
    assert out[2] == "word word word word…" and out[3] == "x" * 19 + "…"


def test_cut_and_strip(spark):
    assert col(spark, ["\t a b\n", "", None], strip) == ["a b", "", None]
    assert col(spark, ["aaa bbb ccc", "abcdefghijkl", "ab"], lambda c: cut_at_word(c, 9)) == ["aaa bbb", "abcdefghi", "ab"]


# --- scans --------------------------------------------------------------------------


def test_intermediate_tables_leave_no_shuffle_files(spark):
    def blocks():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return sum(every.apply(i).isShuffle() for i in range(every.size()))

    before = blocks()
    got = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):  # they are removed by another thread
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert blocks() <= before and got.count() == 7


def test_running_total_splits_hot_keys(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.5 else f"k{r.randint(0, 20)}", i, r.randint(0, 9), "extra") for i in range(3000)]
    got = {(k, i): b for k, i, b in one(scan.running_total(spark.createDataFrame(rows, "k string, i long, v int, x string").repartition(7), "k", "i", "v", "before"))}
    sums = {}
    for k, i, v, _ in rows:
        assert got[k, i] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v


def test_running_total_where_a_key_ends_inside_a_later_task(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart, as large ones do
    try:
        rows = [(k, i, 1) for k, n in (("a", 500), ("hot", 3000), ("k", 30), ("z", 500)) for i in range(n)]
        got = one(scan.running_total(spark.createDataFrame(rows, "k string, i long, v int").repartition(5), "k", "i", "v", "before"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == [(k, i, i) for k, i, _ in rows]


def test_running_total_empty(spark):
    assert one(scan.running_total(spark.createDataFrame([], "k string, i long, v int"), "k", "i", "v", "b")) == []


# --- normalisation ---------------------------------------------------------------------


def messages(spark, rows):
    return spark.createDataFrame(rows, "session_id string, idx int, role string, text string, tool_name string, ts string")


def test_turns_keep_gaps(spark):
    m = messages(spark, [("s", 0, "system", "rules", None, None), ("s", 1, "USER ", "hi", "", None), ("s", 2, "tool", "x", "grep", None), ("s", 3, "tool", "ok", "terminal", "t"), ("s", 4, None, None, None, None), (None, 0, "user", "lost", None, None), ("s", 5, "assistant", "[IMPORTANT: background process ended", None, None)])
    out = sorted(one(normalize.turns(m)))
    assert out == [("s:1", "s", 1, "user", None, "hi", None), ("s:3", "s", 3, "tool", "t", "ok", "terminal")]


def test_offsets(spark):
    t = spark.createDataFrame([("a", 0, "abc"), ("a", 2, ""), ("a", 5, None), ("b", 1, "é")], "session_id string, idx int, text string")
    got = {(s, i): (a, b) for s, i, _, a, b in one(normalize.with_offsets(t))}
    assert got == {("a", 0): (0, 3), ("a", 2): (4, 4), ("a", 5): (5, 5), ("b", 1): (0, 1)}


def test_message_text(spark):
    values = ['"plain"', '["a", {"text": "b"}, {"content": "c"}, {"x": 1}]', "[]", None, '{"a": 1}']
    assert col(spark, values, normalize.message_text) == ["plain", "a\nb\nc", "", "", '{"a": 1}']


def test_hash_ignores_order_of_rows(spark):
    rows = [("s", 0, "user", None, "a"), ("s", 1, "agent", "t", "b"), ("z", 0, "user", None, None)]
    schema = "session_id string, idx int, actor string, tool_name string, text string"
    a, b = (dict(one(normalize.content_hashes(spark.createDataFrame(x, schema)))) for x in (rows, rows[::-1]))
    c = dict(one(normalize.content_hashes(spark.createDataFrame([*rows[:1], ("s", 1, "agent", "t", "B"), rows[2]], schema))))
    assert a == b and a["s"] != c["s"] and a["z"] == c["z"]


def test_newest_sessions(spark):
    s = spark.createDataFrame([("a", 10.0, 2, "x"), ("b", 20.0, 1, None), ("c", 30.0, 3, "conversation mining"), ("d", 40.0, 0, None), ("e", None, 1, None)], "id string, started_at double, message_count int, title string")
    m = spark.createDataFrame([("b", "hello"), (None, "conversation miner")], "session_id string, content string")
    ex = normalize.excluded_sessions(s, m)
    assert one(ex) == [("c",)]
    assert [r.id for r in normalize.newest_sessions(s, ex, 1).collect()] == ["b"]
    assert [r.id for r in normalize.newest_sessions(s, ex, 0, 5.0).collect()] == ["b", "a"]


# --- sensitivity ---------------------------------------------------------------------------


def test_masking(spark):
    texts = ["mail a@b.org and token=abcdef123", "nothing", None, "", "API_KEY", "/home/u/x y", "10.0.0.12"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("m", sensitivity.masked(F.col("t")))
    got = [(r.m.text, r.m.level) if r.m else None for r in df.orderBy("i").collect()]
    assert got[0] == ("mail [REDACTED_EMAIL_1] and [REDACTED_SECRET_2]", "secret")
    assert got[1] == ("nothing", "internal") and got[2] is None and got[3] == ("", "internal")
    assert got[4][1] == "secret" and got[5] == ("[REDACTED_PATH_1] y", "personal") and got[6][1] == "personal"


def test_touching_spans_merge():
    masked, hits = sensitivity.mask_text("/home/u/API_KEY=x a@b.co")
    assert [h[0] for h in hits] == ["home_path", "email"] and masked == "[REDACTED_PATH_1] [REDACTED_EMAIL_2]"


# --- signals -----------------------------------------------------------------------------------


def test_signals(spark):
    assert col(spark, ["Should I go?", "I ask?", "What is `x?` http://a.b?c", "Is it https://x.y/z ?", ""], signals.is_question) == [True, False, False, True, False]
    fails = ["Traceback (most recent call last):", "ok\n  ValueError: bad", "exit_code: 1\nFAILED x", "exit_code: 0\nFAILED x", "exit_code: 1", "all good"]
    assert col(spark, fails, signals.is_tool_failure) == [True, True, True, False, False, False]
    assert col(spark, ["plan and verify", "plan only", "Done. plan, verify"], signals.is_method) == [True, False, False]
    assert col(spark, ["I'll run the plan test review", "plan, test, review", "the root cause", "I'll plan and test"], signals.method_sink) == ["report_only", "skill_candidate", "skill_candidate", "report_only"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "turn_id string, session_id string, idx int, actor string, text string, tool_name string")


def test_caps_are_spent_before_duplicates_are_dropped(spark):
    t = turns(spark, [(f"s:{i}", "s", i, "user", "no, that is not what I meant 7" if i < 10 else "no, another thing", None) for i in range(12)])
    hits = signals.capped(signals.candidates(t))
    assert hits.count() == 10
    rec = signals.records(hits).collect()
    assert len(rec) == 1 and rec[0].pattern_type == "correction" and rec[0].confidence == 0.82
    assert signals.records(hits, signals.records(hits)).count() == 0


def test_secret_is_quarantined(spark):
    t = turns(spark, [("s:0", "s", 0, "user", "no, use token=abcdefgh instead", None), ("s:1", "s", 1, "user", None, None)])
    r = signals.records(signals.capped(signals.candidates(t))).collect()[0]
    assert r.recommended_sink == "quarantine" and "suppressed" in r.summary


# --- windows -------------------------------------------------------------------------------------


def plain_windows(tokens, limit, overlap):
    out, start = [], 0
    while start < len(tokens):
        end, total = start, 0
        while end < len(tokens) and (end == start or total + tokens[end] <= limit):
            total += tokens[end]
            end += 1
        out.append((start, end))
        if end == len(tokens):
            break
        back, j = 0, end
        while j > start and back < overlap:
            j -= 1
            back += tokens[j]
        start = max(start + 1, j)
    return out


def test_windows_follow_the_rule(spark):
    r = random.Random(3)
    sessions = {f"s{k}": [r.randint(1, 120) for _ in range(r.choice([1, 2, 40, 700]))] for k in range(12)}
    rows = [(s, i, t, 1 << (i % 3)) for s, ts in sessions.items() for i, t in enumerate(ts)]
    r.shuffle(rows)
    got = {}
    for s, k, a, b, n, tok, _ in one(windows.windows(spark.createDataFrame(rows, "session_id string, idx int, tokens int, flags int"), 200, 50)):
        got.setdefault(s, {})[k] = (a, b + 1)
        assert n == b + 1 - a and tok == sum(sessions[s][a : b + 1])
    for s, ts in sessions.items():
        assert [got[s][k] for k in sorted(got[s])] == plain_windows(ts, 200, 50) == windows.greedy(ts, 200, 50)


@pytest.mark.parametrize("overlap", [0, 50])
def test_windows_across_blocks(spark, overlap):
    r = random.Random(4)
    sessions = {"hot": [r.choice([1, 9, 40, 260]) for _ in range(4000)], "edge": [1] * 402, "one": [7], "two": [5] * 403}
    rows = [(s, 3 * i, t, 1 << (i % 3)) for s, ts in sessions.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "session_id string, idx int, tokens int, flags int").repartition(5)
    got = {(s, k): (a // 3, b // 3 + 1, n, tok, bits) for s, k, a, b, n, tok, bits in one(windows.windows(df, 200, overlap, block=402))}
    want = {(s, k): (a, b, b - a, sum(ts[a:b]), sum({1 << (i % 3) for i in range(a, b)})) for s, ts in sessions.items() for k, (a, b) in enumerate(windows.greedy(ts, 200, overlap))}
    assert got == want


def test_routing(spark):
    flags = spark.createDataFrame([("use opus here",), ("wrong, prefer tests",), ("",)], "t string").select(F.col("t"), windows.routed(windows.family_flags(F.col("t"))).alias("f"))
    got = dict(one(flags))
    assert got["use opus here"] == ["authorization_limit"] and got[""] == [] and got["wrong, prefer tests"] == ["correction_preference", "verification_review"]
    with pytest.raises(ValueError):
        windows.passes_for(F.col("f"), "other")


def test_resume(spark):
    plan = spark.createDataFrame([("w1", "a"), ("w2", "a"), ("w3", "a")], "window_id string, family string")
    ledger = spark.createDataFrame([("w1", "a", "processed"), ("w2", "a", "error"), ("w1", "a", "processed")], "window_id string, family string, status string")
    assert sorted(one(windows.remaining(plan, ledger))) == [("w2", "a"), ("w3", "a")]


def test_few_shots(spark):
    shots = [(i, "correction_preference", "correction_preference", False, False, f"c{i}") for i in range(5)] + [(5, "rework_cause", "outcome_attribution", False, False, "bare"), (6, "rework_cause", "outcome_attribution", False, True, "forced"), (7, "none", "correction_preference", True, False, "near")]
    passes = [(f, c) for f, own in {**C.PASS_CODES, "all": C.ALL_CODES}.items() for c in own]
    book = spark.createDataFrame(shots, "ord int, codebook_code string, source string, near_miss boolean, faceted boolean, card string"), spark.createDataFrame(passes, "family string, code string")
    got = {}
    for f, _, _, card in one(prompts.few_shots(*book).orderBy("family", "place")):
        got.setdefault(f, []).append(card)
    assert got["correction_preference"] == ["c0", "c1", "c2", "c3", "near"]
    assert got["all"] == ["c0", "c1", "forced"] and got["outcome_attribution"] == ["bare", "forced"] and "methodology_workflow" not in got


def test_heads_hold_the_codebook(spark):
    heads = prompts.heads(prompts.codebook(spark))
    assert set(heads) == {*C.PASS_CODES, "all"}
    assert all(f'"code":"{c}"' in heads[f] for f, own in C.PASS_CODES.items() for c in own)
    assert "near_miss" in heads["outcome_attribution"] and heads["all"].count('"definition"') == 10 and "letter by letter" in heads["all"]


def test_window_queries_measure_masked_text(spark, tmp_path):
    r, words = random.Random(9), "now the plan was kept and nobody asked again".split()
    hot = ["mail ann.long.name@mail.example.org", "password=hunter2hunter2hunter2", "see /home/somebody/deep/er/notes.txt", "host 10.20.30.40", ""]
    rows = [(f"s{s}:{i}", f"s{s}", i, r.choice(["user", "agent"]), " ".join([*r.choices(words, k=r.randint(2, 40)), r.choice(hot)]), r.choice([None, "terminal"])) for s in range(4) for i in range(60)]
    rows.append(("s4:0", "s4", 0, "user", None, None))
    spark.createDataFrame(rows, "turn_id string, session_id string, idx int, actor string, text string, tool_name string").write.parquet(f"{tmp_path}/turns.parquet")

    def line(row, n, mask=True):
        tid, _, idx, actor, text, tool = row
        t = " ".join((sensitivity.mask_text(text or "")[0] if mask else text or "").split())
        return f"turn_id={tid} idx={idx} actor={actor}{f' tool={tool}' if tool else ''}: {t[:n] + '…' if len(t) > n else t}"

    def expected(mask):
        est, wins, tiers = {}, set(), set()
        for s in {x[1] for x in rows}:
            own = [x for x in rows if x[1] == s]
            tok = [max(1, -(-len(line(x, C.TURN_CHARS[0], mask)) // 4)) for x in own]
            est[s] = (len(own), sum(tok), max(tok))
            for k, (a, e) in enumerate(windows.greedy(tok, queries.LIMIT, queries.OVERLAP)):
                wins.add((s, k, own[a][2], own[e - 1][2], sum(tok[a:e])))
                n = [sum(len(line(x, c, mask)) + 1 for x in own[a:e]) for c in (200, 90, 42)]
                tiers.add((s, k, *n, next((i for i in (1, 2) if -(-(n[i - 1] + 400) // 4) <= 300), 3)))
        return est, wins, tiers

    root = str(tmp_path)
    got = ({r[0]: tuple(r[1:]) for r in queries.token_estimate(spark, root).collect()}, {(r.session_id, r.window_index, r.start_idx, r.end_idx, r.tokens) for r in queries.session_windows(spark, root).collect()}, set(one(queries.prompt_clip_tier(spark, root))))
    assert got == expected(True)
    assert all(a != b for a, b in zip(got, expected(False)))


# --- validation ------------------------------------------------------------------------------------

GOOD = {"codebook_code": "correction_preference", "unit": "turn", "statement": "s", "source_reliability": "C", "info_credibility": 2, "evidence": [{"turn_id": "s:0", "quote": "use the other file"}], "confidence": 0.8}


def judge(spark, *records, family="correction_preference", raw=None, text="please use the other file now", actor="agent"):
    payload = raw if raw is not None else json.dumps({"records": list(records)})
    p = spark.createDataFrame([("w", family, payload)], "window_id string, family string, payload string")
    surface = spark.createDataFrame([("w", "s:0", 0, actor, text), ("w", "s:1", 1, "agent", "and " + text)], "window_id string, turn_id string, idx int, actor string, shown string")
    return [r.reason for r in validate.validated(p, surface).orderBy("position").collect()]


@pytest.mark.parametrize(("change", "expected"), [
    ({}, None), ({"codebook_code": "nope"}, "code_not_allowed"), ({"unit": "cross_session"}, "unit_not_allowed"), ({"source_reliability": "G"}, "source_reliability_not_allowed"),
    ({"info_credibility": "x"}, "info_credibility_not_int"), ({"info_credibility": 2.7}, None), ({"info_credibility": "4"}, None), ({"info_credibility": 9}, "info_credibility_out_of_range"),
    ({"evidence": []}, "missing_evidence"), ({"evidence": [{"turn_id": "s:0", "quote": "absent"}]}, "quote_not_found"), ({"evidence": [{"turn_id": "s:9", "quote": "use the other"}]}, None),
    ({"source_reliability": "A"}, "source_reliability_a_without_direct_source"), ({"evidence": [None]}, "evidence_not_object"), ({"evidence": ["x"]}, "evidence_not_object"), ({"evidence": [GOOD["evidence"][0], "x"]}, "evidence_not_object"),
    ({"evidence": [{"turn_id": "s:0", "quote": "absent"}, "x"]}, "quote_not_found"), ({"evidence": ["x", {"turn_id": "s:0", "quote": "absent"}]}, "evidence_not_object"), ({"evidence": "use the other"}, "missing_evidence"), ({"evidence": [{"turn_id": "s:0", "quote": 5}]}, "quote_not_found"), ({"info_credibility": True}, None),
])
def test_rejections(spark, change, expected):
    assert judge(spark, {**GOOD, **change}) == [expected]


def test_outcome_rules(spark):
    base = {**GOOD, "codebook_code": "rework_cause"}
    cases = [({"delivery": "rework", "cause": "agent"}, "rework_cause", None), ({"delivery": "rework", "cause": "none"}, "rework_cause", "rework_cause_without_real_cause"), ({"delivery": "x", "cause": "agent"}, "rework_cause", "outcome_facets_invalid"), ({"delivery": "landed", "cause": "agent"}, "rework_cause", "rework_cause_without_real_cause"), ({"delivery": "landed", "cause": "agent"}, "delivery_result", "outcome_facets_invalid"), ({"delivery": "unknown", "cause": "none"}, "intent_stated", None)]
    for facets, code, expected in cases:
        assert judge(spark, {**base, "codebook_code": code, "facets": facets}, family="outcome_attribution") == [expected]


def test_confidence_and_defaults(spark):
    p = spark.createDataFrame([(str(i), "correction_preference", json.dumps({"records": [{**GOOD, "confidence": c}]})) for i, c in enumerate([0.9, "0.9", 0.5, "HIGH", None, True, [1], 0.1])], "window_id string, family string, payload string")
    surface = spark.createDataFrame([(str(i), "s:0", 0, "agent", "please use the other file now") for i in range(8)], "window_id string, turn_id string, idx int, actor string, shown string")
    rows = validate.validated(p, surface).orderBy("window_id").collect()
    assert [r.confidence for r in rows] == ["high", "low", "medium", "high", "low", "high", "low", "low"]
    assert {(r.facets, r.assumptions, r.alternative_interpretations, r.disconfirming_evidence, r.falsifiers, r.confidence_basis, r.quote_verified) for r in rows} == {("{}", "[]", "[]", "[]", "[]", "", True)}


def test_payload_shapes_and_cap(spark):
    assert judge(spark, raw="no json") == ["records_not_list"] and judge(spark, raw='{"records": {}}') == ["records_not_list"] and judge(spark, raw='{"records": []}') == []
    assert judge(spark, 5) == ["record_not_object"]
    bad = {**GOOD, "unit": "x"}
    assert judge(spark, GOOD, bad, GOOD, GOOD, GOOD) == [None, "unit_not_allowed", None, None, "too_many_records"]


def test_notice_is_whole_quote_only(spark):
    text = C.NOTICE_EXACT["voice_input_concision_note"]
    got = col(spark, [f" {text}\n", text + " more", "Foreground timeout 900s exceeds the maximum of 600s. Use background=true with notify_on_complete=true for long-running commands.", None], validate.notice_id)
    assert got == ["voice_input_concision_note", None, "terminal_foreground_timeout_cap", None]


# --- register --------------------------------------------------------------------------------------------


def test_dedup_key(spark):
    df = spark.createDataFrame([(1, "a", ["A long quote, here!", "Another long one"], "x"), (2, "a", ["another LONG one", "a long quote, here"], "y"), (3, "a", ["short"], "x"), (4, "a", ["short"], "y"), (5, "a", ["a fairly long quote"], "x"), (6, "a", ["A fairly  long quote."], "z"), (7, None, None, None)], "i int, c string, q array<string>, s string")
    k = dict(one(df.select("i", register.dedup_key(F.col("c"), F.col("q"), F.col("s")))))
    assert k[1] == k[2] and k[3] != k[4] and k[5] == k[6] and k[7]


def reg(spark, rows):
    return spark.createDataFrame(rows, "dedup_key string, record_id string, statement string, occurrences long, first_seen string, last_seen string, created_at string")


def test_merge_conserves(spark):
    rows = reg(spark, [("k", "a", "short", 2, "2025-01-02", "2025-01-05", "2025-01-02"), ("k", "b", "the longest", 3, "2025-01-01", "", "2025-01-01"), ("z", "c", None, None, None, None, None)])
    m = register.merge(rows)
    got = {r.dedup_key: r for r in m.collect()}
    assert (got["k"].record_id, got["k"].occurrences, got["k"].first_seen, got["k"].last_seen) == ("b", 5, "2025-01-01", "2025-01-05")
    assert got["z"].occurrences == 1 and register.conservation(rows, m).first().conserved


def test_upsert_replay_changes_nothing(spark):
    old = reg(spark, [("k", "a", "s", 2, "1", "1", "1")])
    new = reg(spark, [("k", "b", "s", 1, "2", "2", "2"), ("k", "b", "s", 1, "2", "2", "2"), ("n", "c", "t", 1, "2", "2", "2"), ("k", "a", "s", 1, "3", "3", "3")])
    got = {r.dedup_key: (r.record_id, r.occurrences) for r in register.upsert(old, new).collect()}
    assert got == {"k": ("a", 3), "n": ("c", 1)}


def test_purge_and_queue(spark):
    rows = spark.createDataFrame([(C.NOTICE_EXACT["voice_input_concision_note"], 4), ("real text", 1), (None, 1)], "first_quote string, occurrences int")
    kept, gone = register.purge(rows)
    assert kept.count() == 2 and one(gone) == [("voice_input_concision_note", 1, 4)]
    s = spark.createDataFrame([("a",), ("a",), ("b",)], "session_id string")
    q = register.enqueued(s, None, "v")
    assert q.count() == 6 and register.enqueued(s, q, "v").count() == 0
    now = F.to_timestamp(F.lit("2026-01-01 12:00:00"))
    runs = spark.sql("SELECT 'running' AS status, timestamp'2026-01-01 11:00:00' AS started_at UNION ALL SELECT 'running', timestamp'2026-01-01 11:59:00' UNION ALL SELECT 'failed', NULL")
    assert sorted(one(register.status_counts(register.retry_failed(register.reset_stale(runs, now))))) == [("pending", 2), ("running", 1)]


# --- scoring ------------------------------------------------------------------------------------------------


def side(spark, rows):
    return spark.createDataFrame(rows, "session_id string, code string, quote string, ord int")


def test_scores(spark):
    g = side(spark, [("s", "a", "one two three four five", 0), ("s", "a", "x y z w", 1), ("t", "b", "q", 0)])
    c = side(spark, [("s", "a", "zero one two three four", 0), ("s", "a", "two three four five", 1), ("s", "a", "no", 2), ("u", "b", "q", 0)])
    r = scoring.scores(scoring.matched_counts(g, c)).first()
    assert (r.gold, r.candidates, r.matched, r.recall) == (3, 4, 2, 0.666667)
    s = scoring.scores(scoring.strict_counts(g, c)).first()
    assert s.matched == 1
    e = scoring.scores(scoring.matched_counts(g.limit(0), c.limit(0))).first()
    assert (e.gold, e.recall, e.recall_high) == (0, 0.0, 0.0)


def test_strict_matching_against_plain_code(spark):
    r = random.Random(9)
    words = "a b c d".split()
    make = lambda: [(f"s{r.randint(0, 3)}", "k", " ".join(r.choice(words) for _ in range(r.randint(2, 7))), i) for i in range(60)]
    gold, cand = make(), make()
    grams = lambda t: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)}
    expected = 0
    used = set()
    for s, _, q, _ in cand:
        for j, (s2, _, q2, _) in enumerate(gold):
            if s == s2 and j not in used and grams(q) & grams(q2):
                used.add(j)
                expected += 1
                break
    got = scoring.strict_matches(side(spark, gold), side(spark, cand)).agg(F.sum("matched")).first()[0]
    assert got == expected


def test_wilson_known_value(spark):
    df = spark.createDataFrame([(18, 51), (0, 0)], "h int, n int")
    got = [tuple(round(x, 3) for x in r) for r in df.select(*scoring.wilson(F.col("h"), F.col("n"))).collect()]
    assert got == [(0.236, 0.49), (0.0, 0.0)]


def test_sample_is_stable_and_full(spark):
    sizes = [1, 2, 2, 6, 9, 12, 40, 80, 200]
    s = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "session_id string, n int").withColumn("bucket", scoring.bucket(F.col("n")))
    a, b = (sorted(r.session_id for r in scoring.stratified_sample(x, 2, "7").collect()) for x in (s, s.repartition(5)))
    assert a == b and len(set(a)) == 6


def test_outcomes_fill_zero(spark):
    r = spark.createDataFrame([("rework_cause", "partial", "tool"), ("delivery_result", "landed", "none")], "code string, delivery string, cause string")
    got = {x.cause: (x.n, x.top_cause) for x in scoring.outcomes(r).collect()}
    assert got["tool"] == (1, "tool") and got["agent"] == (0, "tool") and len(got) == 4
    assert scoring.outcomes(r.limit(0)).first().top_cause == "none"


def test_reports(spark):
    r = reg(spark, [("k", "a", "s", 2, "1", "1", "1"), ("l", "b", "t", 5, "1", "1", "1")]).withColumn("family", F.lit("f"))
    text = reports.findings_markdown(reports.top_findings(r, 1), {"rows": 2, "occurrences": 7})
    assert "(5x) t" in text and "(2x)" not in text
    shown = reports.shown_quotes(spark.createDataFrame([("internal", "mail a@b.org"), ("secret", "x"), (None, "y")], "sensitivity string, quote string"))
    assert [x.shown for x in shown.collect()] == ["mail [REDACTED_EMAIL_1]", "[suppressed]", "[suppressed]"]


def test_usage(spark):
    rows = [json.dumps({"prompt_tokens": 10, "completion_tokens": 5, "total_tokens": 20}), json.dumps({"input_tokens": 3, "output_tokens": 4, "cost_in_usd_ticks": 10**10}), "{}", None]
    df = spark.createDataFrame([(r,) for r in rows], "u string").select(F.lit("grok-4.3").alias("model"), usage.normalised(F.col("u")).alias("u"))
    got = [tuple(r.u) if r.u else None for r in df.collect()]
    assert got == [(10, 5, 5, 0, 20, None), (3, 4, 0, 0, 7, 10**10), None, None]
    c = usage.costs(df.where("u IS NOT NULL").select("model", "u.*")).first()
    assert c.cost_source == "partial" and c.exact_usd == 1.0


# --- model, cycle, files --------------------------------------------------------------------------------------


def test_salvage():
    assert json.loads(model.salvage_json('<think>{"a": 1}</think>```json\n{"b": 2}\n```')) == {"b": 2}
    assert json.loads(model.salvage_json('text {"a": 1} and {"b": 3} end')) == {"b": 3}
    assert json.loads(model.salvage_json('text {"a": 1} and {"b": {"c": 3}} end')) == {"c": 3}  # the object of the last brace that can be read
    assert json.loads(model.salvage_json('<think>never closed {"a": 1}')) == {"a": 1} and json.loads(model.salvage_json('{"a": 1} {"b": ')) == {"a": 1}
    assert model.salvage_json("none") is None and model.salvage_json(None) is None and model.salvage_json("[1]") is None


def test_visible_text():
    say = lambda c, **k: {"choices": [{"message": {"content": c}, **k}]}
    assert model.visible_text(say("a")) == "a" and model.visible_text(say([{"text": "a"}, "b", {"content": "c"}, 5])) == "a\nb\nc"
    assert model.visible_text(f"thought {model.ANSWER_MARKER} b ") == "b"
    for bad, fault in (({}, "without choices"), ({"choices": [5]}, "without choices"), (say("x", finish_reason="length"), "cut off"), ({"choices": [{}]}, "without a message"), (say(" "), "empty"), (say(None), "empty"), ("", "empty")):
        with pytest.raises(RuntimeError, match=fault):
            model.visible_text(bad)


def test_errors_and_prompts_carry_no_keys(spark):
    seen = spark.createDataFrame([("s", 0, "w", "all", "h", "call ann@mail.example.org now")], "session_id string, window_index int, window_id string, family string, prompt_hash string, prompt string")

    def chat(prompt):
        raise RuntimeError(f"{prompt} with Bearer abc.def-123 api_key=hunter2hunter2 ghp_abcdefgh")

    r = model.call_model(seen, chat).first()
    assert "[REDACTED_EMAIL_1]" in r.error and not any(x in r.error for x in ("ann@", "abc.def", "hunter2", "ghp_")) and r.prompt_hash == "h"


def state(spark, n=3):
    s = spark.createDataFrame([(f"s{i}", 10.0 * (i + 1), 4, None) for i in range(n)], "id string, started_at double, message_count int, title string")
    m = spark.createDataFrame([(10 * i + k, f"s{i}", role, text, None, 1.0) for i in range(n) for k, (role, text) in enumerate([("user", "that is wrong, use the other parser"), ("assistant", "I will verify it with a test"), ("user", "thanks")])], "id long, session_id string, role string, content string, tool_name string, timestamp double")
    return s, m


def test_mine_cycle(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    s, m = state(spark)
    summary, cursor = cycle.mine(store, s, m, model.make_chat("rules"), version="v1", now="2026-01-01 00:00:00")
    assert cursor == 30.0 and summary.created > 0 and summary.errors == 0
    total = store.read("register").agg(F.sum("occurrences")).first()[0]
    again, cursor = cycle.mine(store, s, m, model.make_chat("rules"), version="v1", now="2026-01-02 00:00:00")
    assert again.windows == 0 and cursor == 30.0
    replay, _ = cycle.mine(store, s, m, model.make_chat("rules"), version="v1", now="2026-01-02 00:00:00", by_cursor=False)
    assert store.read("register").agg(F.sum("occurrences")).first()[0] == total
    r = store.read("register", cycle.REGISTER)
    assert r.where("family IS NULL OR codebook_code IS NULL OR size(evidence) = 0 OR facets <> '{}' OR falsifiers <> '[]' OR NOT quote_verified OR prompt_hash IS NULL OR session_id IS NULL").count() == 0
    text = cycle.findings_report(store)
    assert "## correction_preference" in text and f"occurrences: {total}" in text
    before = r.count()
    notice = C.NOTICE_EXACT["voice_input_concision_note"]
    spoilt = r.unionByName(r.limit(1).select(*[F.lit("zz").alias(c) if c in ("dedup_key", "record_id") else F.array(F.struct(F.lit("t").alias("turn_id"), F.lit(notice).alias("quote"))).alias(c) if c == "evidence" else F.lit(4).cast("long").alias(c) if c == "occurrences" else F.col(c) for c in r.columns]))
    store.write("register", spoilt.unionByName(r.limit(1).withColumn("record_id", F.lit("again")).withColumn("dedup_key", F.lit("stale"))))
    assert cycle.purge(store) == {"voice_input_concision_note": (1, 4)}
    done = cycle.rekey(store)
    assert done["conserved"] and store.read("register").count() == before == done["rows_after"] and done["rows_before"] == before + 1


def test_extraction_of_the_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    s, m = state(spark, 2)
    assert ingest.take_state(store, s, m) == 2 and ingest.take_state(store, s, m) == 0
    with pytest.raises(extract.NotApproved):
        extract.run(store, full_corpus=True)
    extract.approve(store, "ann", "", "now")
    got = extract.run(store, full_corpus=True)
    assert got == {"queued": 6, "sessions": 2, "records_created": 2} and extract.run(store)["records_created"] == 0
    told = extract.status(store)
    assert told["sessions"] == 2 and told["work_items"] == {"completed": 6} and told["pilot_approved"] and told["turns"] == 6
    assert {r.turn_count for r in store.read("sessions").collect()} == {3}
    assert "## methodology: plan_spike_build_verify" in reports.pilot_markdown(store.read("records"))


def test_candidate_run(spark, tmp_path):
    """Golden scores on a small benchmark: of three gold findings the offline extractor finds two, one with another quote."""
    said = [("user", "that is wrong, use the other parser"), ("agent", "I will verify it with a test first"), ("user", "I prefer short answers in the morning")]
    t = spark.createDataFrame([("s", i, f"s:{i}", a, x, None) for i, (a, x) in enumerate(said)], "session_id string, idx int, turn_id string, actor string, text string, tool_name string")
    sessions = spark.createDataFrame([("s", "short")], "session_id string, bucket string")
    gold = [("s", 0, "correction_preference", [("s:0", "that is wrong, use the other parser")]), ("s", 1, "verification_review", [("s:1", "a test first")]), ("s", 2, "communication_preference", [("s:2", "short answers")])]
    g = spark.createDataFrame(gold, "session_id string, ord int, code string, evidence array<struct<turn_id:string,quote:string>>")
    transcripts.freeze(sessions, t, g, g.limit(1), str(tmp_path), codebook=prompts.CODEBOOK, window_params=(900, 0))
    data = transcripts.benchmark(spark, str(tmp_path))
    head = data["manifest"].first()
    assert len(head.codebook_sha256_16) == 16 and head.buckets.short == 1 and head.totals.gold_findings == 3
    got = benchmark.run_candidate(data, model.make_chat("rules"), runs=2, threshold=0.6)
    rows = {(r.run, r.level, r.bucket): (r.gold, r.candidates, r.matched) for r in got["runs"].collect()}
    found = rows[1, "code", "all"][1]
    assert got["window_params"] == (900, 0) and rows[1, "code", "all"][::2] == (3, 2) and rows[2, "quote", "all"] == (3, found, 1) and rows[1, "code", "short"] == rows[1, "code", "all"]
    assert got["recall_pass"] and abs(got["summary"]["recall"]["mean"] - 2 / 3) < 1e-5 and got["summary"]["recall"]["sd"] == 0
    assert got["transport"].where("error_rate > 0").count() == 0 and "reaches the threshold: yes" in reports.scorecard_markdown(got)
    with pytest.raises(ValueError, match="missing_turn"):
        benchmark.run_candidate({**data, "turns": data["turns"].where("idx > 0")}, model.make_chat("rules"))
    with pytest.raises(ValueError, match="total of turns"):
        benchmark.run_candidate({**data, "turns": data["turns"].unionByName(data["turns"].limit(1).withColumn("turn_id", F.lit("s:9")))}, model.make_chat("rules"))


def test_errors_hold_the_cursor_and_budget_stops(spark, tmp_path):
    def broken(prompt):
        raise RuntimeError("down")

    store = TableStore(spark, str(tmp_path / "a"))
    s, m = state(spark, 1)
    summary, cursor = cycle.mine(store, s, m, broken, version="v1", now="n")
    assert summary.errors > 0 and cursor is None and store.read("ledger").where("status = 'error'").count() == summary.errors
    store = TableStore(spark, str(tmp_path / "b"))
    summary, cursor = cycle.mine(store, s, m, model.make_chat("rules"), version="v1", now="n", budget=model.Budget(max_calls=2))
    assert summary.budget_exhausted and summary.passes == 1 and cursor is None


def test_files_and_streaming(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.jsonl").write_text('{"role": "user", "content": "hi"}\n\n{"actor": "assistant", "content": [{"text": "a"}, "b"]}\n')
    (inbox / "b.json").write_text(json.dumps({"conversation": [{"type": "human", "content": "yo", "ts": "t1"}, "bare"]}))
    (inbox / "c.jsonl").write_text('{"role": "user"}\nbroken {\n')
    (inbox / "d.txt").write_text("x")
    (inbox / "e.json").write_text("{}")
    store = TableStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest.start(store, str(inbox), str(tmp_path / "ck")).awaitTermination()
    status = {r.path.rsplit("/", 1)[1]: (r.status, r.error_detail) for r in store.read("sessions").collect()}
    assert status["a.jsonl"][0] == status["b.json"][0] == "normalized"
    assert status["c.jsonl"] == ("error", "unreadable line 2") and "unsupported" in status["d.txt"][1] and status["e.json"][0] == "error"
    got = sorted((r.idx, r.actor, r.text, r.ts) for r in store.read("turns").collect())
    assert got == [(0, "user", "hi", None), (0, "user", "yo", "t1"), (1, "agent", "a\nb", None), (1, "unknown", "bare", None)]
    assert len(store.versions("turns")) == 1


def test_benchmark_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("s", "short")], "session_id string, bucket string")
    t = spark.createDataFrame([("s", 0, "s:0", "user", "hello there all", None)], "session_id string, idx int, turn_id string, actor string, text string, tool_name string")
    g = spark.createDataFrame([("s", 0, "a", [("s:0", "hello there")])], "session_id string, ord int, code string, evidence array<struct<turn_id:string,quote:string>>")
    totals = transcripts.freeze(s, t, g, g, str(tmp_path)).first()
    assert tuple(totals) == (1, 1, 1, 1)
    b = transcripts.benchmark(spark, str(tmp_path))
    assert b["gold"].first().quote == "hello there" and b["turns"].count() == 1 and b["sessions"].first().bucket == "short"
    assert scoring.scores(scoring.strict_counts(b["gold"], b["baseline"])).first().matched == 0


def test_empty_tables(spark):
    t = turns(spark, [])
    assert signals.records(signals.capped(signals.candidates(t))).count() == 0
    assert windows.windows(t.withColumn("tokens", F.lit(1)).withColumn("flags", F.lit(0))).count() == 0
    assert normalize.with_offsets(t).count() == 0 and register.merge(reg(spark, [])).count() == 0
