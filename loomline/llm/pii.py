"""Find personal data in free text and replace it by typed placeholders (problem 2).

Method: a linear-chain conditional random field over word-shape features, trained
from the small labelled table of `pii_table`, decoded by Viterbi in numpy batches.

Texts are cut into tokens once a batch; features belong to distinct tokens, so the
emissions of a batch are sums of table look-ups at neighbouring positions. A token
whose every label but "outside" loses by more than all transitions of any stretch
around it could win back is outside on every best path (`_active`); only the
stretches that are left go through Viterbi, which gives the same labels as decoding
everything.

Defined results: null and empty texts have no mention; evidence that can't be read
as a JSON list is taken as one raw string, for reports and for masking; a row
delivered again counts once. Kinds: email, phone, id_number, address, name.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.pii_table import KINDS, labelled_table
from loomline.llm.vectors import SEP, batches, tokenize

#: Labels: outside, then beginning and inside of each kind.
N_LABELS = 1 + 2 * len(KINDS)
BEGIN, INSIDE = {k: 1 + 2 * i for i, k in enumerate(KINDS)}, {k: 2 + 2 * i for i, k in enumerate(KINDS)}
_TOKEN = re.compile(r"\x00|[^\S\n]*(?:[^\W\d_]+|\d+|\n|[^\w\s\x00]|_)")
_OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
_NEAR = (-1, 0, 1)
#: People of the roster, chosen by hash, that the gazetteer is made of.
MAX_ROSTER = 200_000


def _shape(w: str) -> str:
    if w.isdigit():
        return f"d{min(len(w), 9)}"
    if w == "\n":
        return "nl"
    if not (w[0].isalpha()):
        return w if ord(w[0]) < 128 else "other"
    if len(w) == 1:
        return "X1" if w.isupper() else "x1"
    if w.isupper():
        return "XX"
    if w[0].isupper():
        return "Xx" if w[1:].islower() else "XxX"
    return "xx" if w.islower() else "xX"


_TOLD = frozenset(("555", "00", "1", "49", "44", "33", "34"))


def _signature(raw: str) -> str:
    """A token with the same features as `raw`: numbers differ only by length and a leading zero."""
    w = raw.lstrip()
    if w.isdigit() and w not in _TOLD:
        w = ("0" if w[0] == "0" else "7") + "7" * (min(len(w), 12) - 1)
        return " " + w if raw[0] != w[0] and not raw[0].isdigit() else w
    return raw


def _sum_rows(weights: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    """Sum of the weight rows of each list of features: (offset, list, label)."""
    n = np.array([len(r) for r in rows])
    flat = np.array([i for r in rows for i in r] + [0], np.int64)
    at = np.r_[0, np.cumsum(n)[:-1]]
    out = np.add.reduceat(weights[:, flat, :], at, axis=1)
    out[:, n == 0] = 0
    return out


class Tagger:
    """A trained model: emission tables by feature, transitions, and the vocabulary of features."""

    def __init__(self, given: frozenset[str], family: frozenset[str], words: frozenset[str]):
        self.given, self.family, self.words = given, family, words
        self.shape_no: dict[str, int] = {}
        self.far: dict[str, int] = {}
        self.near: dict[str, int] = {}
        self.frozen = False

    def _number(self, table: dict[str, int], f: str) -> int:
        if f in table:
            return table[f]
        return -1 if self.frozen else table.setdefault(f, len(table))

    def token_features(self, raw: str) -> tuple[list[int], list[int], int]:
        """Numbers of the far features, the near features and the shape of a token."""
        w = raw.lstrip() or "\n"
        space = raw != w
        low, shape = w.lower(), _shape(w)
        far = [f"s:{shape}", f"w:{low}" if low in self.words or not w[0].isalnum() else f"w?{shape}"]
        near = [f"sp:{space}", f"s:{shape}", f"ssp:{shape}{space}"]
        if w[0].isalpha() and len(w) > 1:
            g, f = low in self.given, low in self.family
            near += [f"g:{g}{f}", f"gs:{g}{f}{shape}"]
            if low not in self.words:
                near += [f"p2:{low[:2]}", f"p3:{low[:3]}", f"p4:{low[:4]}", f"x3:{low[-3:]}", f"x4:{low[-4:]}", f"x5:{low[-5:]}", f"long:{min(len(low), 10)}{shape}"]
            else:
                near += ["known", f"known:{shape}"]
        elif w.isdigit():
            near += [f"d0:{w[0] == '0'}{len(w)}", f"d={w}" if w in ("555", "00", "1", "49", "44", "33", "34") else "d?"]
        nums = lambda t, xs: [i for x in xs if (i := self._number(t, x)) >= 0]
        return nums(self.far, far), nums(self.near, near), self._number(self.shape_no, shape)

    def finish(self, far: np.ndarray, near: np.ndarray, triple: np.ndarray, trans: np.ndarray) -> None:
        self.w_far, self.w_near, self.w_triple, self.trans = far, near, triple, trans
        self.frozen = True

    def tables(self, vocab: list[str], cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of each distinct token seen from each offset, and its shape number.

        Tokens with the same features share a row; `cache` has the rows of tokens met before in this task.
        """
        keys = [_signature(raw) for raw in vocab]
        new = [k for k in dict.fromkeys(keys) if k not in cache]
        if new:
            feats = [self.token_features(k) for k in new]
            e = _sum_rows(self.w_far, [f for f, _, _ in feats])
            e[[_OFFSETS.index(o) for o in _NEAR]] += _sum_rows(self.w_near, [f for _, f, _ in feats])
            e = np.ascontiguousarray(e.transpose(1, 0, 2), np.float32)
            for i, k in enumerate(new):
                cache[k] = (e[i], feats[i][2])
        hits = [cache[k] for k in keys]
        return np.stack([h[0] for h in hits], 1), np.array([h[1] for h in hits])

    def emissions(self, tb, cache: dict) -> np.ndarray:
        """Emissions of all tokens of a batch, relative to `outside`."""
        by_offset, shape = self.tables(tb.vocab, cache)
        n = len(tb.code)
        e = np.zeros((n, N_LABELS), np.float32)
        for i, o in enumerate(_OFFSETS):
            lo, hi = max(0, -o), n - max(0, o)
            if hi <= lo:
                continue
            here, there = slice(lo, hi), slice(lo + o, hi + o)
            part = by_offset[i][tb.code[there]]
            if o:
                part[tb.doc[here] != tb.doc[there]] = 0
            e[here] += part
        s = shape[tb.code]
        k = len(self.w_triple) - 1
        s = np.where(s < 0, k, s)
        edge = np.diff(tb.doc) > 0
        prev, nxt = np.r_[k, np.where(edge, k, s[:-1])], np.r_[np.where(edge, k, s[1:]), k]
        e += self.w_triple[prev, s, nxt]
        e -= e[:, :1]
        return e


def _active(e: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Tokens that a best path may label other than outside.

    A stretch of labels other than outside gains at most sum(u) + g against staying
    outside, where u is the best emission of a token plus the best gain g of one
    transition. A token in no stretch of positive bound is outside.
    """
    g = max(float((trans - trans[0, 0]).max()), 0.0)
    u = (e[:, 1:].max(1) + g).astype(np.float64)
    n = len(u)
    total = np.cumsum(u)
    before = np.r_[0.0, total[:-1]]
    # running extrema within documents: lift documents apart by more than any sum
    span = float(np.abs(u).sum()) + 1.0
    lift = doc * span
    left = total - (np.minimum.accumulate((before - lift)) + lift)
    right = (np.maximum.accumulate((total - lift[::-1].max() + 0 + (lift.max() - lift))[::-1])[::-1] - (lift.max() - lift) + lift[::-1].max()) - before
    return left + right - u + g > 0 if n else np.zeros(0, bool)


def _viterbi(e: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of padded stretches (stretch, position, label) that begin and end outside."""
    b, n, k = e.shape
    back = np.zeros((n, b, k), np.int8)
    score = trans[0][None, :] + e[:, 0]
    final = np.empty((b, k), np.float32)
    done = length == 1
    final[done] = score[done]
    for t in range(1, n):
        s = score[:, :, None] + trans[None]
        back[t] = s.argmax(1)
        score = s.max(1) + e[:, t]
        done = length == t + 1
        final[done] = score[done]
    out = np.zeros((b, n), np.int8)
    lab = (final + trans[:, 0][None]).argmax(1)
    for t in range(n - 1, -1, -1):
        at = t < length
        out[at, t] = lab[at]
        lab = np.where(at, back[t, np.arange(b), lab], lab)
    return out


def decode(model: Tagger, tb, cache: dict) -> np.ndarray:
    """Label of each token of a batch."""
    out = np.zeros(len(tb.code), np.int8)
    if not len(out):
        return out
    e = model.emissions(tb, cache)
    on = np.flatnonzero(_active(e, tb.doc, model.trans))
    if not len(on):
        return out
    first = np.r_[True, (np.diff(on) > 1) | (np.diff(tb.doc[on]) > 0)]
    start = on[first]
    length = np.diff(np.r_[np.flatnonzero(first), len(on)])
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        top = length[order[at]]
        limit = max(int(top * 1.5), 8)
        to = min(int(np.searchsorted(length[order], limit, "right")), at + 4096)
        pick = order[at:to]
        m = int(length[pick].max())
        pos = start[pick][:, None] + np.arange(m)[None]
        inside = np.arange(m)[None] < length[pick][:, None]
        lab = _viterbi(e[np.minimum(pos, len(out) - 1)], length[pick], model.trans)
        out[pos[inside]] = lab[inside]
        at = to
    return out


# --- training ----------------------------------------------------------------


def _encode(model: Tagger, rows):
    """Tokens and gold labels of the labelled table."""
    texts, gold = [], []
    for row in rows:
        text, spans = "", []
        for t, k in row:
            if k:
                spans.append((len(text), len(text) + len(t), k))
            text += t
        lab, at = [], 0
        for tok in _TOKEN.findall(text):
            lo = at + len(tok) - len(tok.lstrip(" \t"))
            at += len(tok)
            k = next((k for a, b, k in spans if a <= lo < b), None)
            begins = any(a == lo for a, _, _ in spans)
            lab.append(0 if not k else (BEGIN[k] if begins or not lab or lab[-1] not in (BEGIN[k], INSIDE[k]) else INSIDE[k]))
        texts.append(text)
        gold.append(lab)
    return texts, gold


def fit(roster: list[tuple[str, str]], rounds: int = 60, l2: float = 2e-4, rows=None) -> Tagger:
    """Maximum likelihood with an L2 penalty by full-batch Adagrad; forward-backward runs on all sentences at once."""
    rows = rows or labelled_table(roster)
    context: dict[str, int] = {}
    for row in rows:
        for t, k in row:
            # words of the sentences, and the fixed words in mentions (SSN, Lane, calle...), but no part of names
            for w in set(re.findall(r"[^\W\d_]+", t.lower())) if k in (None, "id_number", "address", "phone") else ():
                context[w] = context.get(w, 0) + 1
    people = {w.lower() for row in rows for t, k in row if k == "name" for w in re.findall(r"[^\W\d_]{2,}", t)}
    model = Tagger(frozenset(g.lower() for g, _ in roster), frozenset(f.lower() for _, f in roster), frozenset(w for w, n in context.items() if n >= 4 and w not in people))
    texts, gold = _encode(model, rows)
    tb = tokenize(texts, _TOKEN)
    feats = [model.token_features(v) for v in tb.vocab]
    n_far, n_near, n_shape = len(model.far), len(model.near), len(model.shape_no)
    far_rows, near_rows = [a for a, _, _ in feats], [b for _, b, _ in feats]
    flat = {k: (np.repeat(np.arange(len(rows_)), [len(r) for r in rows_]), np.array([i for r in rows_ for i in r])) for k, rows_ in (("far", far_rows), ("near", near_rows))}
    shape = np.array([s for *_, s in feats])[tb.code]
    y = np.concatenate([np.array(g) for g in gold])
    L, n = N_LABELS, len(y)
    starts = tb.starts()
    size = np.diff(starts)
    m, longest = len(size), int(size.max())
    pos = np.minimum(starts[:-1][:, None] + np.arange(longest)[None], n - 1)
    mask = np.arange(longest)[None] < size[:, None]
    allowed = np.ones((L, L), bool)
    for k in KINDS:
        ok = [BEGIN[k], INSIDE[k]]
        allowed[[i for i in range(L) if i not in ok], INSIDE[k]] = False
    edge = np.diff(tb.doc) > 0
    pad = n_shape
    prev, nxt = np.r_[pad, np.where(edge, pad, shape[:-1])], np.r_[np.where(edge, pad, shape[1:]), pad]
    triple = (prev * (n_shape + 1) + shape) * (n_shape + 1) + nxt
    used, tri = np.unique(triple, return_inverse=True)
    W = {"far": np.zeros((len(_OFFSETS), n_far, L)), "near": np.zeros((len(_NEAR), n_near, L)), "tri": np.zeros((len(used), L)), "trans": np.zeros((L, L))}
    G = {k: np.full(v.shape, 1e-8) for k, v in W.items()}
    shifts = []
    for o in _OFFSETS:
        at = np.arange(n) + o
        ok = (at >= 0) & (at < n)
        ok[ok] &= tb.doc[at[ok]] == tb.doc[np.flatnonzero(ok)]
        shifts.append((np.flatnonzero(ok), tb.code[at[ok]]))
    gold_pair = np.zeros((L, L))
    for g in gold:
        np.add.at(gold_pair, (np.r_[0, g], np.r_[g, 0]), 1)

    def add_by(code, values, rows_):
        return np.stack([np.bincount(code, values[:, j], rows_) for j in range(values.shape[1])], 1)

    for _ in range(rounds):
        e = W["tri"][tri].copy()
        for i, o in enumerate(_OFFSETS):
            t = _sum_rows(W["far"][i : i + 1], far_rows)[0]
            if o in _NEAR:
                t = t + _sum_rows(W["near"][_NEAR.index(o)][None], near_rows)[0]
            e[shifts[i][0]] += t[shifts[i][1]]
        T = np.where(allowed, np.exp(W["trans"]), 0)
        x = np.exp(e - e.max(1, keepdims=True))[pos]
        x[~mask] = 1
        alpha, beta = np.zeros((longest, m, L)), np.zeros((longest, m, L))
        a = T[0][None] * x[:, 0]
        alpha[0] = a / a.sum(1, keepdims=True)
        for t in range(1, longest):
            a = (alpha[t - 1] @ T) * x[:, t]
            a /= a.sum(1, keepdims=True)
            alpha[t] = np.where(mask[:, t, None], a, alpha[t - 1])
        b = np.tile(T[:, 0], (m, 1))
        pair = np.zeros((L, L))
        endings = alpha[size - 1, np.arange(m)] * b
        endings /= endings.sum(1, keepdims=True)
        pair[:, 0] += endings.sum(0)
        for t in range(longest - 1, -1, -1):
            beta[t] = b
            nb = (x[:, t] * b) @ T.T
            nb /= nb.sum(1, keepdims=True)
            if t:
                both = mask[:, t]
                p = alpha[t - 1][both][:, :, None] * T[None] * (x[:, t] * b)[both][:, None, :]
                pair += (p / p.sum((1, 2), keepdims=True)).sum(0)
            b = np.where(mask[:, t, None], nb, b)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        pair[0] += post[0].sum(0)
        d = post.transpose(1, 0, 2)[mask]
        d[np.arange(n), y] -= 1
        grads = {"tri": add_by(tri, d, len(used)), "trans": pair - gold_pair, "far": np.empty_like(W["far"]), "near": np.empty_like(W["near"])}
        for i, o in enumerate(_OFFSETS):
            t = add_by(shifts[i][1], d[shifts[i][0]], len(feats))
            grads["far"][i] = add_by(flat["far"][1], t[flat["far"][0]], n_far)
            if o in _NEAR:
                grads["near"][_NEAR.index(o)] = add_by(flat["near"][1], t[flat["near"][0]], n_near)
        for k, g in grads.items():
            g = g / m + l2 * W[k]
            G[k] += g * g
            W[k] -= 0.25 * g / np.sqrt(G[k])
    full = np.zeros(((n_shape + 1) ** 3, L), np.float32)
    full[used] = W["tri"]
    trans = np.where(allowed, W["trans"], -1e4).astype(np.float32)
    model.finish(W["far"].astype(np.float32), W["near"].astype(np.float32), full.reshape(n_shape + 1, n_shape + 1, n_shape + 1, L), trans)
    return model


@lru_cache(maxsize=4)
def _fit_cached(roster: tuple[tuple[str, str], ...]) -> Tagger:
    return fit(list(roster))


def train(roster: DataFrame | None) -> Tagger:
    """The tagger, with up to `MAX_ROSTER` of the known persons as gazetteer; other names are found by shape and context."""
    people: list[tuple[str, str]] = []
    if roster is not None:
        known = roster.select("given_name", "family_name").where("given_name IS NOT NULL AND family_name IS NOT NULL").distinct()
        people = sorted((r[0], r[1]) for r in known.orderBy(F.xxhash64("given_name", "family_name"), "given_name", "family_name").limit(MAX_ROSTER).collect())
    return _fit_cached(tuple(people))


# --- mentions ------------------------------------------------------------------

#: What a mention must hold besides its label (an exact check after decoding).
_CHECK = {
    "email": re.compile(r"(?i)[\w.+-]\s*(?:@|[(\[{<]\s*at\s*[)\]}>])\s*\w[\w-]*\s*(?:\.|[(\[{<]\s*dot\s*[)\]}>])\s*\w"),
    "phone": re.compile(r"(?:\d\D{0,4}){7}"),
    "id_number": re.compile(r"(?:\d[^\d\n]{0,3}){6}"),
    "address": re.compile(r"(?s)(?=.*\d)(?=.*[^\W\d_]{3})"),
    "name": re.compile(r"[^\W\d_]+\W+(?:[^\W\d_]\W+)?[^\W\d_]{2}|[^\W\d_]{3,}\W+[^\W\d_]"),
}


def mentions(model: Tagger, texts: list[str | None], cache: dict) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text, in order."""
    if len(cache) > 400_000:
        cache.clear()
    tb = tokenize(texts, _TOKEN)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    lab = decode(model, tb, cache)
    on = np.flatnonzero(lab)
    if not len(on):
        return out
    kind = (lab[on] - 1) // 2
    begins = np.r_[True, (np.diff(on) > 1) | (np.diff(tb.doc[on]) > 0) | (np.diff(kind) != 0)] | (lab[on] % 2 == 1)
    first, last = on[begins], on[np.r_[np.flatnonzero(begins)[1:] - 1, len(on) - 1]]
    length = np.array([len(v) for v in tb.vocab])
    lead = np.array([len(v) - len(v.lstrip() or "\n") for v in tb.vocab])
    end = np.cumsum(length[tb.code])
    base = np.r_[0, end][tb.starts()[:-1]]
    for a, b, k in zip(first.tolist(), last.tolist(), kind[begins].tolist()):
        d = int(tb.doc[a])
        lo, hi = int(end[a] - length[tb.code[a]] + lead[tb.code[a]] - base[d]), int(end[b] - base[d])
        if _CHECK[KINDS[k]].search(texts[d][lo:hi]):
            out[d].append((lo, hi, KINDS[k]))
    return out


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """`text` with a placeholder such as [EMAIL] for each span."""
    out, at = [], 0
    for lo, hi, kind in spans:
        out += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join([*out, text[at:]])


def sensitivity(stated: str | None, kinds: set[str]) -> str:
    """secret stays secret, an identity number makes a row secret, any mention at least personal."""
    s = (stated or "").strip().lower()
    if s == "secret" or "id_number" in kinds:
        return "secret"
    return "personal" if kinds or s == "personal" else "internal"


def quotes_of(raw: list[str | None]) -> tuple[list, list[tuple[int, dict | None]], list[str]]:
    """The lists of evidence texts (None where unreadable), and all their quotes with the row and item they are from; an unreadable text is one quote of no item."""
    parsed, where, texts = [], [], []
    for i, r in enumerate(raw):
        try:
            v = json.loads(r) if r else None
        except (ValueError, RecursionError):
            v = None
        parsed.append(v if isinstance(v, list) else None)
        if isinstance(v, list):
            for x in v:
                if isinstance(x, dict) and isinstance(x.get("quote"), str):
                    where.append((i, x))
                    texts.append(x["quote"])
        elif r:
            where.append((i, None))
            texts.append(r)
    return parsed, where, texts


def found(turns: DataFrame, records: DataFrame, model: Tagger) -> DataFrame:
    """(src_table, row_id, kind), each kind of a row once. One pass of Arrow batches over each table."""

    def run(it, evidence: bool):
        cache: dict = {}
        for b in batches(it):
            texts = b.column(1).to_pylist()
            rows = range(len(texts))
            if evidence:
                _, where, texts = quotes_of(texts)
                rows = [i for i, _ in where]
            pairs = sorted({(i, k) for i, s in zip(rows, mentions(model, texts, cache)) for *_, k in s})
            at = pa.array([i for i, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(["records" if evidence else "turns"] * len(pairs), pa.string()), b.column(0).take(at), pa.array([k for _, k in pairs], pa.string())], names=["src_table", "row_id", "kind"])

    schema = "src_table string, row_id string, kind string"
    a = turns.where("turn_id IS NOT NULL AND text IS NOT NULL").select("turn_id", "text").mapInArrow(lambda it: run(it, False), schema)
    b = records.where("record_id IS NOT NULL AND evidence_json IS NOT NULL").select("record_id", "evidence_json").mapInArrow(lambda it: run(it, True), schema)
    return a.unionByName(b).distinct()


def masked_turns(turns: DataFrame, model: Tagger) -> DataFrame:
    """(turn_id, text, kinds, sensitivity) of each turn, once."""
    src = turns.where("turn_id IS NOT NULL").dropDuplicates(["turn_id"]).select("turn_id", "text")

    def run(it):
        cache: dict = {}
        for b in batches(it):
            texts = b.column(1).to_pylist()
            spans = mentions(model, texts, cache)
            kinds = [sorted({k for *_, k in s}) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t if t is None else mask(t, s) for t, s in zip(texts, spans)], pa.string()), pa.array([",".join(k) for k in kinds]), pa.array([sensitivity(None, set(k)) for k in kinds])],
                names=["turn_id", "text", "kinds", "sensitivity"],
            )

    return src.mapInArrow(run, "turn_id string, text string, kinds string, sensitivity string")


def masked_records(records: DataFrame, model: Tagger) -> DataFrame:
    """(record_id, evidence_json, kinds, sensitivity) of each record, once; the JSON keeps its items, with quotes masked."""
    src = records.where("record_id IS NOT NULL").dropDuplicates(["record_id"]).select("record_id", "evidence_json", "sensitivity")

    def run(it):
        cache: dict = {}
        for b in batches(it):
            out = b.column(1).to_pylist()
            parsed, where, texts = quotes_of(out)
            kinds: list[set[str]] = [set() for _ in out]
            for (i, x), t, s in zip(where, texts, mentions(model, texts, cache)):
                kinds[i] |= {k for *_, k in s}
                if x is None:
                    out[i] = mask(t, s)
                else:
                    x["quote"] = mask(t, s)
            out = [json.dumps(p, ensure_ascii=False) if p is not None else o for p, o in zip(parsed, out)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.string()), pa.array([",".join(sorted(k)) for k in kinds]), pa.array([sensitivity(s, k) for s, k in zip(b.column(2).to_pylist(), kinds)])],
                names=["record_id", "evidence_json", "kinds", "sensitivity"],
            )

    return src.mapInArrow(run, "record_id string, evidence_json string, kinds string, sensitivity string")


assert SEP == "\x00"
