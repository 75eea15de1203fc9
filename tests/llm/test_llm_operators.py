"""The training-data operators on small rows, against brute force and planted cases."""

import json
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import conversations, formatting_dups, fusion, mixing, packing, pii, residue, stuffing, tokens
from loomline.llm.pii_table import FAMILIES, KINDS, labelled_table
from loomline.llm.vectors import tokenize

# --- 1: formatting duplicates ------------------------------------------------------


def groups_of(spark, rows):
    df = spark.createDataFrame(rows, "rid string, t string, n long, grp string")
    return formatting_dups.grouped(formatting_dups.keyed(df, F.lit("x"), "rid", "t", "n"))


def test_forms_of_one_finding(spark):
    texts = {
        "a1": "Actor: user; to: the parser; limit: 3", "a2": "LIMIT=3 | TO=The  Parser | ACTOR=USER", "a3": '{"to": "the parser", "limit": 3, "actor": "user"}', "a4": "limit: 3\nactor: user\nto: the parser",
        "a5": "actor user to the parser limit 3", "b1": "Actor: the parser; to: user; limit: 3", "c1": "Plan, test, build: done.", "c2": "«plan test​ BUILD — done»", "d1": "plan test done build", "e1": "", "e2": " .. ", "n1": None,
    }
    g = groups_of(spark, [(k, t, 1, "clash") for k, t in texts.items()] + [("a2", texts["a2"], 1, "clash")])
    assert sorted(tuple(r) for r in formatting_dups.copies(g).collect()) == [("x", "a1", "a2"), ("x", "a1", "a3"), ("x", "a1", "a4"), ("x", "a1", "a5"), ("x", "c1", "c2"), ("x", "e1", "e2")]
    assert {r.first_id: r.n_rows for r in formatting_dups.collapse(g).collect()} == {"a1": 5, "b1": 1, "c1": 2, "d1": 1, "e1": 2}


def test_chains_of_ties_reach_the_smallest_root(spark):
    # the same letters cut differently tie records to each other through their folded text
    rows = [("r1", "ab: c; d: e"), ("r2", "a: bc; d: e"), ("r3", "d: e; a: bc"), ("r4", "de: a; b: c"), ("r5", "b: c; de: a"), ("r6", "z: y; x: w")]
    g = groups_of(spark, [(a, b, 1, None) for a, b in rows])
    by = defaultdict(set)
    for r in g.collect():
        by[r.grp].add(r.rid)
    assert sorted(map(sorted, by.values())) == [["r1", "r2", "r3", "r4", "r5"], ["r6"]]


def test_merkle_orders_objects_but_not_lists():
    m = lambda s: formatting_dups.merkle(json.loads(s))[0]
    assert m('{"a": {"x": 1, "y": [1, 2]}, "b": null}') == m('{"B": null, "a": {"Y": [1, 2], "x": "1"}}')
    assert m('{"a": [1, 2]}') != m('{"a": [2, 1]}') and m('{"a": 1}') != m('["a", 1]')


def test_hot_group_and_empty(spark):
    rows = [(f"r{i:05d}", "Same  text" if i % 3 else f"other {i}", 1, None) for i in range(3000)]
    assert formatting_dups.copies(groups_of(spark, rows)).count() == 1999
    assert formatting_dups.copies(groups_of(spark, [])).count() == 0


# --- 2: personal data ----------------------------------------------------------------


@pytest.fixture(scope="module")
def tagger():
    return pii.fit([("Brianka", "Wendmark"), ("Talessa", "Ostwick")])


def rates(model, rows):
    texts = ["".join(t for t, _ in row) for row in rows]
    hit = miss = extra = 0
    for row, spans in zip(rows, pii.mentions(model, texts, {})):
        want, got = {k for _, k in row if k}, {k for *_, k in spans}
        hit, miss, extra = hit + len(want & got), miss + len(want - got), extra + len(got - want)
    return hit / (hit + miss), hit / (hit + extra)


def test_held_out_rows(tagger):
    """Rows of the table made with another seed, whose names, numbers and pairings the tagger hasn't seen."""
    assert min(rates(tagger, labelled_table([], seed=99, with_mention=2, without=2))) > 0.95


def test_held_out_families():
    """Families of sentences that took no part in the fit, with persons no roster names."""
    out = ["places", "mails", "trailers", "joining"]
    model = pii.fit([("Brianka", "Wendmark"), ("Talessa", "Ostwick")], rows=labelled_table([("Brianka", "Wendmark")], families=[f for f in FAMILIES if f not in out], with_mention=8))
    recall, precision = rates(model, labelled_table([], seed=99, with_mention=4, without=4, families=out))
    assert recall > 0.85 and precision > 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_labelled_table_is_not_taken_from_the_test_tables():
    import duckdb

    texts = "\n".join(t for t, in duckdb.sql("SELECT DISTINCT text FROM '/root/testdata/sf0.001/turns.parquet' WHERE text IS NOT NULL").fetchall())
    stretches = [max(re.split(r"\{+\w*\}+", s.replace("\\n", "\n")), key=len).strip() for rows in FAMILIES.values() for s in rows.strip().split("\n")]
    assert not [x for x in stretches if len(x) > 16 and x in texts]


def test_pruning_changes_no_label(tagger):
    texts = ["".join(t for t, _ in row) for row in labelled_table([], seed=7, with_mention=1, without=1)] + ["", "plain words only", "x" * 3000]
    tb = tokenize(texts, pii._TOKEN)
    lab = pii.decode(tagger, tb, {})
    e = tagger.emissions(tb, {})
    starts = tb.starts()
    for a, b in zip(starts[:-1], starts[1:]):
        if b > a:
            full = pii._viterbi(e[None, a:b], np.array([b - a]), tagger.trans)[0]
            assert full.tolist() == lab[a:b].tolist()


def test_masking_keeps_the_rest(tagger):
    text = "Ask Brianka Wendmark before you ship it. Take SSN 969-42-4848 out of the sample."
    spans = pii.mentions(tagger, [text], {})[0]
    assert pii.mask(text, spans) == "Ask [NAME] before you ship it. Take [ID_NUMBER] out of the sample."
    assert [pii.mentions(tagger, [t], {})[0] for t in (None, "", "Bump parser-kit@0.4.15 and rerun.", "Version 6.165.05 broke the cache.")] == [[], [], [], []]


def test_found_and_masked_tables(spark, tagger):
    turns = spark.createDataFrame([("t1", "Reply-To: brianka.wendmark@example.org", "x"), ("t1", "Reply-To: brianka.wendmark@example.org", "x"), ("t2", None, "x"), (None, "a@b.org", "x"), ("t3", "nothing here", "x")], "turn_id string, text string, kind string")
    good = json.dumps([{"turn_id": "t1", "quote": "My number is +49 30 23125 776, call after five."}, {"turn_id": "t1"}])
    records = spark.createDataFrame([("r1", good, "internal"), ("r2", "broken [", None), ("r3", None, "SECRET"), ("r4", '[{"quote": "write to brianka.wendmark@example.org to', None), ("r5", '["x", {"quote": "write to a.wendmark@example.org today"}]', None)], "record_id string, evidence_json string, sensitivity string")
    assert sorted(tuple(r) for r in pii.found(turns, records, tagger).collect()) == [("records", "r1", "phone"), ("records", "r4", "email"), ("records", "r5", "email"), ("turns", "t1", "email")]
    out = {r.record_id: r for r in pii.masked_records(records, tagger).collect()}
    assert "[PHONE]" in out["r1"].evidence_json and out["r1"].sensitivity == "personal" and out["r2"].evidence_json == "broken [" and out["r3"].sensitivity == "secret"
    rows = {r.turn_id: r for r in pii.masked_turns(turns, tagger).collect()}
    assert rows["t1"].text == "Reply-To: [EMAIL]" and rows["t2"].text is None and rows["t3"].sensitivity == "internal" and len(rows) == 3
    assert set(KINDS) == {"email", "phone", "id_number", "address", "name"}


# --- 3: residue ---------------------------------------------------------------------------


def test_residue(spark):
    content = [f"The parser was {v} in run {i} and the review asks for {i} more rows." for i in range(300) for v in ("split", "merged")]
    bad = ["404 Not Found", "Dear {{name}}, your run {{id}} is ready.", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet velit.", "TBD TBD TBD", "%s"]
    talk = ["The logger prints %s literally; fix the format string.", "Replace the lorem ipsum in the parser with real lines.", "$ make check\n3 passed in 2s\nexit_code: 0"]
    rows = [(f"c{i}", f"s{i % 40}", t, None) for i, t in enumerate(content + talk * 5)] + [(f"b{i}", f"s{i % 40}", t, None) for i, t in enumerate(bad * 5)]
    rows += [("tool", "s1", "fine words about the parser", "{{tool_name}}"), ("null", "s1", None, None), ("empty", "s1", "", "terminal"), ("unseen", "s1", "\u200b \u00a0", None), ("b0", "s0", bad[0], None)]
    df = spark.createDataFrame(rows, "turn_id string, session_id string, text string, tool_name string").withColumn("score", F.lit(1))
    model = residue.train(df)
    got = {r.turn_id for r in residue.residue(df, model).collect()}
    assert got == {f"b{i}" for i in range(30)} | {"tool"}
    assert model.held_out["recall"] > 0.9 and model.held_out["precision"] > 0.9
    assert residue.clean(df, model).count() == df.select("turn_id").distinct().count() - len(got)
    assert residue.residue(df.limit(0)).count() == 0
    assert residue.validation(df, model).first()["precision"] > 0.9


def test_titles_are_learned():
    """Slot-like and plain names that are neither in the seeds nor matched by the patterns of the weak labels."""
    titles = [*[(t, 1) for t in residue.TITLES_POSITIVE], *[(t, 0) for t in residue.TITLES_NEGATIVE]]
    model = residue.Model(residue.fit(residue.SEEDS_POSITIVE + residue.SEEDS_NEGATIVE, [1] * len(residue.SEEDS_POSITIVE) + [0] * len(residue.SEEDS_NEGATIVE)), residue.fit(*zip(*titles), title=True))
    slots = ["{{ helper }}", "<agent_name>", "${HELPER}", "@@HELPER@@", "[[helper]]", "MY_TOOL_HERE"]
    plain = ["compile", "write_table", "web_fetch", "list-files", "calendar.read", "diff"]
    score = model.score(["The parser was moved and the review is done."] * 12, slots + plain)
    assert (score[:6] >= 0.5).sum() >= 5 and (score[6:] < 0.5).all()
    assert model.score([None, "", "x"], [None, "", None]).tolist()[:2] == [0.0, 0.0]


def test_a_model_that_fails_is_refused(spark):
    model = residue.Model((np.zeros(residue.DIMENSIONS), 0.0), (np.zeros(residue.DIMENSIONS), 0.0), held_out={"rows": 500, "positive": 60, "precision": 0.5, "recall": 0.99})
    turns = spark.createDataFrame([("t", "s", "x", None)], "turn_id string, session_id string, text string, tool_name string")
    with pytest.raises(ValueError, match="fails on unseen"):
        residue.residue(turns, model)
    assert residue.Model(model.text, model.title, held_out={**model.held_out, "positive": 3}).check()


# --- 4: conversations -------------------------------------------------------------------------


def test_merge_of_fragments():
    assert conversations.merge_paths([[1, 2, 3, 4], [3, 4, 5], [5, 6], [2, 3]]) == [[1, 2, 3, 4, 5, 6]]
    assert len(conversations.merge_paths([[1, 2], [3, 4]])) == 2
    assert len(conversations.merge_paths([[1, 2], [2, 3], [2, 4]])) > 1
    assert conversations.fragments_of([[1], [2, 2], [3, 3, 3], [4], [5, 5]]) == [[1, 2, 3, 4, 5], [2, 3], [5], [3]]
    for seed in range(20):
        r = random.Random(seed)
        told = [[k] * r.choice([1, 1, 1, 2, 3]) for k in range(30)]
        assert conversations.merge_paths(conversations.fragments_of(told)) == [list(range(30))]
        k = r.choice([i for i, d in enumerate(told) if len(d) > 1])
        told[k][1] = 99  # delivered again with another content: the fragments don't overlap there
        assert conversations.merge_paths(conversations.fragments_of(told)) != [list(range(30))]


def plain_verdict(rows):
    """The definition, on the rows of one session."""
    kept, top = {}, float("-inf")
    for i, role, text, ts in sorted(set(rows), key=lambda x: x[0]):
        if text is None or not text.strip(" \n\t​ "):
            continue
        who = {"human": "user", "agent": "assistant"}.get((role or "").strip().lower(), (role or "").strip().lower())
        if who == "system":
            continue
        if ts is not None:
            ts = ts / 1000 if ts >= 1e11 else ts
            top = max(top, ts)
        kept[i] = (ts if ts is not None else top, i, who, text)
    order = sorted(kept.values())
    talk = [w for _, _, w, _ in order if w in ("user", "assistant")]
    bad = any(w not in ("user", "assistant", "tool") for _, _, w, _ in order) or not talk or order[0][2] != "user" or talk[-1] == "user" or any(a == b == "user" for a, b in zip(talk, talk[1:]))
    return bad, [(w, t) for _, _, w, t in order]


def test_conversations_against_the_definition(spark):
    r = random.Random(4)
    rows, i = [], 0
    for s in range(60):
        n = 2000 if s == 0 else r.randint(1, 12)
        for k in range(n):
            i += r.randint(1, 3)
            role = (["user", "assistant"][k % 2] if r.random() > (0.0 if s == 0 else 0.05) else r.choice(["tool", "System ", "?", None, "Human"]))
            ts = 1.7e9 + k + (0 if r.random() > 0.05 else 0.5)
            row = (i, f"s{s}", role, f"m{i}" if r.random() > 0.02 or s == 0 else r.choice([None, " ", "​"]), None if k % 5 == 2 else "t", None if r.random() < 0.05 and s else ts * (1000 if r.random() < 0.1 else 1))
            rows += [row] * (2 if r.random() < 0.1 else 1)
    rows.append((i + 1, None, "user", "lost", None, 1.0))
    df = spark.createDataFrame(rows, "id long, session_id string, role string, content string, tool_name string, timestamp double").repartition(5)
    own = defaultdict(list)
    for a, s, role, text, _, ts in rows:
        if s:
            own[s].append((a, role, text, ts))
    want = {s: plain_verdict(v) for s, v in own.items()}
    got = {x.session_id: x.reason for x in conversations.verdicts(df).collect()}
    assert {s for s, reason in got.items() if reason} == {s for s, (bad, _) in want.items() if bad}
    told = defaultdict(list)
    for x in conversations.conversations(df).collect():
        told[x.session_id].append((x.seq, x.role, x.content))
    assert {s: [y[1:] for y in sorted(v)] for s, v in told.items()} == {s: turns for s, (bad, turns) in want.items() if not bad}


def test_ambiguous_and_empty_messages(spark):
    schema = "id long, session_id string, role string, content string, tool_name string, timestamp double"
    rows = [(1, "a", "user", "x", None, 1.0), (1, "a", "user", "y", None, 1.0), (2, "a", "agent", "z", None, 2.0), (3, "b", "system", "x", None, 1.0)]
    got = {r.session_id: r.reason for r in conversations.verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "ambiguous overlap", "b": "empty"}
    assert conversations.verdicts(spark.createDataFrame([], schema)).count() == 0 and conversations.conversations(spark.createDataFrame([], schema)).count() == 0


def test_deliveries_that_differ_drop_a_session_whatever_its_other_messages(spark):
    schema = "id long, session_id string, role string, content string, tool_name string, timestamp double"
    rows = []
    for k in range(12):  # what is delivered in the place of the first message is the second one's content, or not
        s, x, y = f"s{k:02}", ("user", f"x{k}", None, 1.0), ("agent", f"y{k}", None, 2.0)
        rows += [(1, s, *x), (2, s, *y), (1, s, *(y if k < 6 else x))]
    got = {r.session_id: r.reason for r in conversations.verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {f"s{k:02}": "ambiguous overlap" if k < 6 else None for k in range(12)}


def test_conversation_that_ends_inside_a_later_task(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart, as large ones do
    try:
        rows = [(i, s, ("user", "agent")[i % 2], f"{s}{i}", None, None if i % 7 == 3 else 1.7e9 + i) for s, n in (("a", 500), ("hot", 3000), ("k", 30), ("z", 500)) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, session_id string, role string, content string, tool_name string, timestamp double").repartition(5)
        got = [tuple(r) for r in conversations.conversations(df).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == [(s, i, ("user", "assistant")[i % 2], x) for i, s, _, x, *_ in sorted(rows, key=lambda r: (r[1], r[0]))]


# --- 5: fusion -----------------------------------------------------------------------------------


def test_instants(spark):
    values = ["2025-03-01 10:00:00", "2025-03-01T10:00:00Z", "20250301T100000Z", "1740823200", "1740823200000", "2025-03-01 05:00:00-05:00", "2025-03-01T15:30:00+05:30", "2025-13-01 00:00:00", "1999-01-01 00:00:00", "never", "", None, " 2025-03-01 10:00:00 ", "2025-02-30 10:00:00"]
    df = fusion.with_instants(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string"), us="v")
    got = [r.us for r in df.orderBy("i").collect()]
    assert got[:7] == [1740823200 * 10**6] * 7 and got[7:12] == [None] * 5 and got[12] == got[0] and got[13] is None


def cie(spark, rows):
    cols = "record_id statement source_reliability confidence_basis last_seen created_at occurrence_count extractor_version unit actor codebook_code confidence sensitivity grp".split()
    full = [{**dict.fromkeys(cols), "extractor_version": "v1", **r} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in full], ", ".join(f"{c} {'int' if c == 'occurrence_count' else 'string'}" for c in cols))


def fused(df):
    return formatting_dups.grouped(formatting_dups.keyed(fusion.prepared(df), F.lit("cie_records"), "record_id", "statement", *fusion.CARRIED)).drop("src").cache()


def test_fuse(spark):
    rows = [
        {"record_id": "b", "statement": "Same text", "source_reliability": " a", "confidence_basis": "n/a", "last_seen": "2025-05-01 00:00:00", "created_at": "2025-01-02 00:00:00", "occurrence_count": 3, "actor": "user", "unit": "turn"},
        {"record_id": "a", "statement": "same TEXT!", "source_reliability": "B", "confidence_basis": "said so", "last_seen": "2025-06-01 00:00:00", "created_at": "never", "actor": "agent", "unit": "turn"},
        {"record_id": "c", "statement": "same-text", "source_reliability": "?", "confidence_basis": "guess", "last_seen": "2025-06-01 00:00:00", "created_at": "2025-01-01 00:00:00", "actor": "user", "unit": None},
        {"record_id": "d", "statement": "other", "source_reliability": None}, {"record_id": "e", "statement": None},
    ]
    df = cie(spark, rows)
    survivors, won = fusion.survivors(fused(df), df), fusion.field_winners(fused(df))
    assert sorted(tuple(r) for r in won.collect()) == [("a", "confidence_basis", "a"), ("a", "created_at", "c"), ("a", "last_seen", "a"), ("a", "statement", "b")]
    s = survivors.collect()
    assert len(s) == 1 and s[0].occurrence_count == 5 and s[0].actor == "user" and s[0].unit == "turn" and s[0].codebook_code is None and s[0].last_seen.startswith("2025-06-01T")
    assert fusion.survivors(fused(df.limit(0)), df).count() == 0 and fusion.field_winners(fused(df.limit(0))).count() == 0


def plain_fusion(rows, acc, rounds=3):
    """The estimate and its posteriors in plain loops: groups of (field, value, source)."""
    n = 1 + max(s for g in rows.values() for _, _, s in g)
    items = defaultdict(lambda: defaultdict(set))
    claims_ = Counter()
    for g, cs in rows.items():
        for f, v, s in cs:
            items[g, f][v].add(s)
            claims_[g, f] += 1
    trust = fusion.Trust(n, [0] * n)
    trust.acc = acc.copy()

    def posterior(vals):
        odds, ind = trust.log_odds(), trust.indep()
        score = {v: sum(odds[s] * np.prod([max(ind[s, t], 1e-6) for t in ss]) for s in ss) for v, ss in vals.items()}
        top = max(score.values())
        z = sum(np.exp(x - top) for x in score.values())
        return {v: np.exp(x - top) / z for v, x in score.items()}

    for _ in range(rounds):
        total, right = np.zeros(n), np.zeros(n)
        m = np.zeros((3, n, n))
        for key, vals in items.items():
            if claims_[key] < 2:
                continue
            p = posterior(vals)
            st, sf, both = np.zeros((n, n)), np.zeros((n, n)), set()
            for v, ss in vals.items():
                both |= ss
                for a in ss:
                    total[a] += 1
                    right[a] += p[v]
                    for b in ss:
                        st[a, b] += p[v]
                        sf[a, b] += 1 - p[v]
            m[0] += st
            m[1] += sf
            for a in both:
                for b in both:
                    m[2][a, b] += 1
        m[2] = np.maximum(m[2] - m[0] - m[1], 0)
        trust.update(np.concatenate([total, right, m.ravel()]))
    return {k: posterior(vals) for k, vals in items.items()}


def test_posteriors_against_plain_loops(spark):
    """Some hundred groups with a good source, a poor one and its copier."""
    r = random.Random(6)
    names = [("good", "A"), ("poor", "B"), ("copy", "B")]
    rows, told = [], {}
    for g in range(300):
        truth, claims_ = f"u{r.randint(0, 3)}", []
        poor = truth if r.random() < 0.4 else f"u{r.randint(4, 7)}"
        for s, (ev, grade) in enumerate(names):
            v = (truth if r.random() < 0.9 else f"u{r.randint(4, 7)}") if s == 0 else poor if s == 1 or r.random() < 0.9 else truth
            rows.append({"record_id": f"r{g:03d}-{s}", "statement": f"finding {g}", "source_reliability": grade, "extractor_version": ev, "unit": v})
            claims_.append((0, v, {"copy": 0, "good": 1, "poor": 2}[ev]))
        told[f"r{g:03d}-0"] = claims_
    df = cie(spark, rows)
    got = {x.group_id: (x.unit, x.p_unit) for x in fusion.survivors(fused(df), df).collect()}
    want = plain_fusion(told, fusion.Trust(3 + 7, [1, 0, 1, *range(7)]).acc[:3])
    for g in told:
        p = want[g, 0]
        best = min(p, key=lambda v: (-round(p[v], 9), v))
        assert got[g][0] == best and abs(got[g][1] - p[best]) < 2e-3


def test_votes_overturn_a_weak_preference_only(spark):
    base = {"last_seen": "2025-05-01 00:00:00", "unit": "turn"}
    rows = [{"record_id": f"x{g}{i}", "statement": f"Finding {g}", "source_reliability": "B", "extractor_version": f"v{i % 5}", "confidence_basis": "heard twice", **base} for g in range(40) for i in range(5)]
    rows += [{**rows[0], "record_id": "x09", "extractor_version": "v9", "confidence_basis": "seen once", "last_seen": "2025-05-01 00:00:01"}]
    df = cie(spark, rows)
    basis = lambda strength: {x.record_id for x in fusion.field_winners(fused(df), strength).collect() if x.group_id == "x00" and x.field_name == "confidence_basis"}
    assert basis(None) == {"x09"} and basis(1e-9) == {"x00"} and basis(1.0) == {"x09"}


def test_no_votes_where_they_cannot_count(spark, monkeypatch):
    monkeypatch.setattr(fusion, "estimate", lambda *a, **k: pytest.fail("votes can't change these winners"))
    r = random.Random(8)
    rows = [
        {"record_id": f"r{i:03}", "statement": f"Finding {i % 50}", "source_reliability": r.choice(["A", " b", "?", None]), "extractor_version": f"v{i % 3}", "confidence_basis": r.choice(["n/a", None, "seen", "heard"]),
         "last_seen": r.choice(["never", "2025-05-01 00:00:00", "2025-05-02 00:00:00"]), "created_at": r.choice(["", "2025-01-01 00:00:00", "2025-01-02 00:00:00"])} for i in range(200)
    ]
    keys = formatting_dups.keyed(fusion.prepared(cie(spark, rows)), F.lit("cie_records"), "record_id", "statement", *fusion.PREFERRED)
    got = {(x.group_id, x.field_name): x.record_id for x in fusion.field_winners(formatting_dups.grouped(keys).drop("src")).collect()}
    want = {}
    for g in range(50):
        own = [rows[i] for i in range(g, 200, 50)]
        age = lambda x: {"never": 3, "2025-05-01 00:00:00": 2}.get(x["last_seen"], 1)
        rank = lambda x: {"A": 0, " b": 1}.get(x["source_reliability"], 6)
        for f, ok, key in (
            ("statement", lambda x: True, lambda x: (rank(x), age(x))), ("confidence_basis", lambda x: x["confidence_basis"] in ("seen", "heard"), age),
            ("last_seen", lambda x: age(x) < 3, age), ("created_at", lambda x: x["created_at"] != "", lambda x: x["created_at"]),
        ):
            if some := [x for x in own if ok(x)]:
                want[own[0]["record_id"], f] = min(some, key=lambda x: (key(x), x["record_id"]))["record_id"]
    assert got == want


def test_rare_sources_are_pooled(spark):
    rows = spark.createDataFrame([(f"e{i % 7}", i % 3) for i in range(70)], "ev string, rank int")
    src = fusion.sources_of(rows, most=4)
    got = {r.s for r in fusion.numbered(rows, src).collect()}
    assert len(src.ranks) == 4 + 7 and got == {0, 1, 2, 3, 4, 5, 6} and fusion.numbered(rows, src).count() == 70


def test_copiers_are_discounted():
    """Two sources that share their false values weigh less than two independent ones."""
    shared = fusion._dependence(np.array([0.7, 0.7, 0.7]), *np.array([[[50, 40, 30], [40, 50, 30], [30, 30, 50]], [[20, 18, 0], [18, 20, 0], [0, 0, 20]], [[0, 4, 30], [4, 0, 30], [30, 30, 0]]], float))
    assert shared[0, 1] > 0.9 and shared[0, 2] < 0.1
    t = fusion.Trust(3, [1, 1, 1])
    t.dep = shared
    assert t.indep().min() < 0.4 and t.indep()[2].min() > 0.9


# --- 6 and 7: sizes, packing, mixing -------------------------------------------------------------------


def test_sizes_of_whole_texts():
    enc = tokens.encoding()
    for c in ("=", "-", "abc", "字", "7", " ", "word of text. "):
        long = c * (40_001 // len(c) + 1)
        assert tokens.count_tokens(long, enc) == len(enc.encode_ordinary(long))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing(spark, rule):
    r = random.Random(2)
    docs = [(i, " ".join("alpha" for _ in range(r.choice([1, 5, 20, 60, 99]))), "x") for i in range(400)] + [(1000, "beta " * 450, "x"), (1001, "", "x"), (1002, None, "x"), (None, "gone", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, container_id string")
    rows = packing.pack(df, 100, rule=rule, max_docs=30, shard_documents=150).collect()
    enc = tokens.encoding()
    size, used, count = Counter(), Counter(), Counter()
    for x in rows:
        size[x.doc_id] += x.n_tokens
        used[x.container_id] += x.n_tokens
        count[x.container_id] += 1
    assert size == Counter({d: len(enc.encode_ordinary(t or "")) for d, t, _ in docs if d is not None})
    assert max(used.values()) <= 100 and max(count.values()) <= 30
    assert {x.doc_id for x in rows if x.piece == 1} == {1000}
    assert sum(used.values()) > 0.9 * 100 * len(used)
    assert packing.pack(df.limit(0), 100).count() == 0


def test_best_fit_never_opens_early():
    r = np.random.default_rng(1)
    s = r.integers(1, 80, 300)
    box = packing.best_fit(s, 100)
    load = np.bincount(box, s)
    assert load.max() <= 100 and len(load) <= 1.25 * s.sum() / 100 + 2
    assert packing.best_fit(np.array([], int), 10).tolist() == []
    cost = packing.best_fit(np.array([50] * 10), 100, max_cost=2500)
    assert len(set(cost.tolist())) == 10


def test_costly_documents_stay_alone():
    sizes = np.array([90, 85, 60, 40, 10, 10, 10])
    box = packing.best_fit(sizes, 100)  # 90 tokens cost 0.81 of a full length, beyond the share of 0.75
    assert (box == box[0]).sum() == 1 and sum(sizes[box == box[1]]) == 95 and box[2] == box[3]
    free = packing.best_fit(sizes, 100, max_cost=1e9)
    assert (free == free[0]).sum() == 2


def test_containers_do_not_depend_on_the_layout(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, " ".join(["alpha"] * r.randint(1, 90))) for i in range(900)], "doc_id long, text string")
    rows = lambda d: sorted(map(tuple, packing.pack(d, 100, shard_documents=200).collect()))
    first = rows(df)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert rows(df.repartition(9)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert packing.checks(packing.pack(df, 100), df, 100).first().asDict() == {"documents": 900, "packed": 900, "split": 0, "cut": 0, "torn": 0, "overfull": 0, "tight": True}
    spoilt = packing.pack(df, 100).withColumn("container_id", F.lit("one"))
    assert packing.checks(spoilt, df, 100).first()["overfull"] == 1
    alone = packing.pack(df, 100).withColumn("container_id", F.col("doc_id").cast("string"))
    assert not packing.checks(alone, df, 100).first()["tight"]


@pytest.mark.parametrize(("rate", "cap"), [(0.3, 1), (0.95, 1), (1.9, 4), (0.5, 100), (3.99, 4), (900.0, 2000)])
def test_poisson_mean_after_the_cut(rate, cap):
    _, steps = mixing.poisson_table(rate, cap)
    assert abs(sum(1 - x for x in steps) - rate) < 1e-6 * max(1, rate)


def test_poisson_edges():
    assert mixing.poisson_table(0, 5)[1] == [] and mixing.poisson_table(5, 5)[1] is None and mixing.poisson_table(1, 0)[1] == []


def test_mix(spark):
    docs = [(i, "alpha beta gamma", s) for i, s in enumerate(["big"] * 3000 + [" Small "] * 60 + ["SMALL"] * 60 + [None] * 100 + ["unlisted"] * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("cap", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.1, 4), ("tiny", 0.1, None), ("none", 0.3, 3)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(df, targets)
    rep = {r.source: r for r in report.collect()}
    assert rep["big"].reachable and abs(rep["big"].share_of_target_size - 0.5) < 0.03
    assert rep["small"].reachable and abs(rep["small"].share_of_target_size - 0.1) < 0.02 and rep["small"].most_uses <= 4
    assert not rep["none"].reachable and rep["none"].drawn_tokens == 0 and not rep["tiny"].reachable
    rows = selection.collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and max(Counter(r.doc_id for r in rows).values()) <= 4
    assert sorted(tuple(r) for r in mixing.mix(df.repartition(7), targets)[0].collect()) == sorted(tuple(r) for r in rows)
    assert mixing.mix(df.limit(0), targets)[0].count() == 0
    sizes = mixing.sizes_of(df)
    held = lambda sel: [tuple(r)[1:] for r in mixing.checks(sel, sizes, targets).collect()]
    assert held(selection) == [(True, True, True)] * 4
    assert (True, False, True) in held(selection.where("copy = 1")) and (False, False, False) in held(selection.unionByName(selection).unionByName(selection))


# --- 8: stuffed pages -------------------------------------------------------------------------------------


def test_stuffed_pages(spark):
    r = random.Random(5)
    nouns = "parser report ledger window review budget cursor store table router".split()
    prose = lambda: " ".join(f"The {r.choice(nouns)} was moved after the {r.choice(nouns)} had shown {r.randint(2, 99)} rows that nobody could explain." for _ in range(8))
    log = lambda: "\n".join(f"2026-01-0{r.randint(1, 9)} 10:00:00 INFO src/{r.choice(nouns)}.py rows={r.randint(1, 999)} took={r.randint(1, 99)}ms" for _ in range(20))
    link = lambda: f"https://{r.choice(nouns)}.example/{r.choice(nouns)}/{r.randint(1, 999)}"
    good = {**{i: prose() for i in range(40)}, 40: log(), 41: prose() + " " + link(), 42: prose() + "\nTags: parser, report, parser", 43: "- " + prose().replace(". ", ".\n- "), 44: "", 45: None, 46: "12 34"}
    bad = {
        100: "cheap parser best cheap parser now cheap parser 2026 " * 12, 101: "\n".join(link() for _ in range(12)), 102: " ".join(f"#{r.choice(nouns)}{r.choice(nouns).title()}" for _ in range(40)), 103: "\n".join(f"- [{r.choice(nouns)} {r.choice(nouns)}]({link()})" for _ in range(9)),
        104: prose().split(". ")[0] + ".\n" + "Our parser tool is the best parser tool in Town. Looking for parser tool in City? parser tool prices, parser tool reviews, parser tool deals. " * 6, 105: "\n".join(f"{r.choice(nouns)} {r.choice(nouns)} $9.99 | SKU {r.randint(100, 999)} | {r.choice(nouns)}, {r.choice(nouns)} | Buy now" for _ in range(12)),
    }
    df = spark.createDataFrame([(k, v, "zz") for k, v in {**good, **bad}.items()] + [(None, "x", "zz"), (200, bad[101], "zz")], "doc_id long, text string, share string")
    assert {x.doc_id for x in stuffing.stuffed(df).collect()} == {*bad, 200}
    assert stuffing.stuffed(df.limit(0)).count() == 0


def test_brackets_of_one_page_leave_the_others_alone():
    cited = "".join(f"The {w} was moved because the reader asked for it (https://a.example/x). " for w in ("table", "chair", "lamp", "door", "bench", "shelf"))
    linked = "- [red lamp]. [blue lamp](https://a.example/y)\n- [green lamp [old]](<https://a.example/z> \"a lamp\")\n" * 6
    default = np.array([list(stuffing.DEFAULTS.values())])
    shares = lambda ts: stuffing.shares_of(stuffing.measure(ts)["segments"], default[[0] * len(ts)])
    alone = [shares([t])[0] for t in (cited, linked)]
    assert alone[0] == 0 and alone[1] > 0.5
    for before in ("A list [that is never closed.", "A list that ] ends ] twice.", "[[[", None):
        assert shares([before, cited, linked])[1:].tolist() == alone
    assert not shares(["Notes [as of today: " + cited, "[1] " + cited]).any()


def test_repetition_counts_on_pages_of_any_length(spark):
    r = random.Random(8)
    words = ["".join(r.choices("bcdfgklmnprst", k=3)) + "".join(r.choices("aeiou", k=2)) + r.choice("lnrst") + f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    even = lambda n, times: r.sample(words[:n] * times, n * times)
    rows = lambda ws, sep, k: "\n".join(sep.join(ws[i : i + k]) for i in range(0, len(ws), k))
    short, long = ([" ".join(words[i : i + k]) for i in range(0, 12 * k, k)] for k in (6, 16))
    offers = [f"{a} {b} {c} for {d} {e} {f}" for a, b, c, d, e, f in zip(*[iter(words[:60])] * 6)]
    bad = {
        1: rows(even(130, 3), " ", 10), 2: rows(even(200, 20), " ", 10), 3: rows(even(600, 6), " ", 12), 4: rows(even(300, 8), " | ", 6),
        5: ".\n".join(short * 4), 6: ".\n".join(long * 3), 7: ".\n".join(offers * 30),
    }
    said = ["The {0} was moved after the {1} had shown {2} rows that nobody could explain.", "Nobody has asked for the {0}, so it is left as it was in the {1}.", "There is a {0} in every {1} that we have seen and it should be kept."]
    tell = lambda n: [r.choice(said).format(r.choice(words[:9]), r.choice(words[:9]), r.randint(2, 99)) for _ in range(n)]
    good = {
        101: " ".join(tell(300)), 102: "- " + "\n- ".join(tell(200)), 103: " ".join(tell(3) * 4 + tell(400)), 104: "\n".join(words),
        105: "\n".join(f"2026-01-02 10:00:{r.randint(10, 59)} INFO src/{r.choice(words[:9])}.py rows={r.randint(1, 999)}" for _ in range(400)),
    }
    df = spark.createDataFrame([*bad.items(), *good.items()], "doc_id long, text string")
    assert {x.doc_id for x in stuffing.stuffed(df).collect()} == set(bad)


def test_groups_compare_canonical_forms(spark):
    """A forced clash of digests: one root, two structures."""
    keys = [("x", "a", b"p1", b"r", "form one"), ("x", "b", b"p2", b"r", "form two"), ("x", "c", b"p3", b"r", "form one"), ("x", "d", b"p4", b"s", "form one")]
    got = formatting_dups.grouped(spark.createDataFrame(keys, "src string, rid string, plain binary, root binary, canon string"))
    assert [tuple(r) for r in formatting_dups.copies(got).collect()] == [("x", "a", "c")]


def test_field_names_of_any_length(spark):
    long = "a name of a field that has far more than four words and goes on for more than sixty characters in all"
    g = groups_of(spark, [("r1", f"{long}: 1; other: 2", 1, None), ("r2", f"Other = 2 | {long.upper()} = 1", 1, None), ("r3", f"other: 1; {long}: 2", 1, None)])
    assert [tuple(r) for r in formatting_dups.copies(g).collect()] == [("x", "r1", "r2")]


def test_components_of_chains(spark):
    n = 200
    edges = [("x", f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(n) if i != 77]
    random.Random(1).shuffle(edges)
    got = {bytes(r.node): bytes(r.label) for r in formatting_dups._components(spark.createDataFrame(edges, "src string, a binary, b binary")).collect()}
    assert all(got[f"{i:04d}".encode()] == (b"0000" if i <= 77 else b"0078") for i in range(1, n + 1) if i != 78)


def test_thresholds_move_gradually_with_the_number_of_segments():
    def at(n, name, bin_):
        h = np.zeros((1, len(stuffing.MEASURES), stuffing._BINS))
        h[0, stuffing.MEASURES.index("rep" if name == "listed" else name), bin_] = n
        return stuffing.thresholds(h)[0][list(stuffing.DEFAULTS).index(name)]

    for name, (lo, hi) in stuffing.LIMITS.items():
        for bin_ in (1, 63):
            grid = [at(n, name, bin_) for n in (0, 50, 200, 100_000)]
            assert grid[0] == stuffing.DEFAULTS[name] and grid in (sorted(grid), sorted(grid, reverse=True))
            assert lo <= grid[-1] <= hi


def test_phrases_are_caught_by_n_grams():
    """Words that are common by themselves, in phrases that come again and again in another order; no other rule catches the page."""
    r = random.Random(3)
    phrases = ["garden lamp offers", "solar panel rebate", "copper wire bargain", "winter coat outlet", "leather boots discount", "kitchen table clearance", "summer tent voucher", "mountain bike coupon", "wooden desk markdown", "cotton shirt rebate"]
    page = ".\n".join(f"{a} and {b} with {c} for you" for a, b, c in (r.sample(phrases, 3) for _ in range(14)))
    default = np.array([list(stuffing.DEFAULTS.values())])
    m = stuffing.measure([page])
    with_grams = default.copy()
    with_grams[0, list(stuffing.DEFAULTS).index("fw")] = 0.16
    without = with_grams.copy()
    without[0, list(stuffing.DEFAULTS).index("gram")] = 1.02
    assert stuffing.shares_of(m["segments"], with_grams)[0] > 0.5 > stuffing.shares_of(m["segments"], without)[0]
