"""Pages made of keywords, links or tags instead of sentences (problem 8).

Method: thresholds on measures of a page's segments (lines, cut further at the ends
of sentences): share of function words, shares of the page's repeated words, of its top words and
of its repeated n-grams (two and three content words in a row), duplicate segments, link-text ratio, density of separators, share of
tags. A segment is *stuffing* if it is mostly links or mostly tags, or if nearly half of its content words are top words of the
page (keyword phrases), or if nearly all of its content words stand in repeated n-grams (advertising phrases), or if function words are missing and it either repeats the
page's words or is a list between separators, or if it is repeated whole and has fewer function words than sentences have;
machine output is none of these. Repeated means used three times, whatever the page's length. A page is a case if more than half of its
characters lie in stuffing, or in short segments that dominate it.

Every threshold is calibrated per language on all pages. That on function words is half of
the lower decile of their share in segments that have any; each other one is the upper tail of its measure in
*prose* (full segments with at least `PROSE` function words), kept within the limits that `LIMITS` states. Each is drawn to its default, which
weighs as much as `PRIOR_SEGMENTS` segments. The language is taken from the
words of the page, as the stated one may be wrong. Texts are tokenised once: a page keeps a
few bytes for each of its segments, and is judged from these when the thresholds are known.

Defined results: null and empty texts, and texts without letters, are no cases unless
they are links; rows with a null id are dropped; each row is judged by its own text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.vectors import batches, tokenize
from loomline.session import cut_lineage

#: Function words of the languages (fixed values).
FUNCTION_WORDS = {
    "en": "the a an of to and in is for it was that this these those with as on at by from or but not be are were been has have had he she they we you i his her its their our your which who what when where how why than then so if no nor do does did can could should would may might must will shall there here each every any some both either only also about after before between into over under again further once because while until whose whom just very such same other more most few all nobody nothing".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht ist sind war waren wird werden wurde wurden hat haben hatte zu zum zur von vom mit auf aus bei nach vor für über unter im in an am als auch sich es er sie wir ihr ich du man noch nur schon so wie wenn weil dass da dann denn doch durch gegen ohne um bis kein keine keinen wer was wo niemand bitte".split(),
    "fr": "le la les l un une des du de d et ou mais ne pas n est sont était étaient a ont avait avaient être à au aux en dans sur sous par pour avec sans ce cet cette ces il elle ils elles on nous vous je tu se s qui que qu quoi dont où y si plus moins très donc car comme quand leur leurs son sa ses notre votre même deux chaque personne".split(),
    "es": "el la los las un una unos unas de del y e o u pero no ni es son era eran fue fueron ha han había hay ser estar está están a al en con sin por para sobre entre desde hasta que quien quienes cual como cuando donde si se su sus lo le les me te nos este esta estos estas ese esa muy más menos ya también porque así antes quiera cada nadie".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
_WORD_LANGS: dict[str, int] = {}
for _i, _l in enumerate(LANGUAGES):
    for _w in FUNCTION_WORDS[_l]:
        _WORD_LANGS[_w] = _WORD_LANGS.get(_w, 0) | (1 << _i)

_BINS = 64
#: Share of function words from which a full segment counts as prose, and words that make it full.
PROSE, FULL = 0.25, 6
#: Default of each threshold.
DEFAULTS = {"fw": 0.1, "rep": 0.5, "listed": 0.25, "top": 0.45, "gram": 0.85, "marks": 0.3, "rules": 0.15, "links": 0.5, "lead": 0.15}
#: Limits within which the calibrated thresholds stay.
LIMITS = {"fw": (0.02, 0.24), "rep": (0.45, 0.6), "listed": (0.2, 0.3), "top": (0.4, 0.5), "gram": (0.7, 0.9), "marks": (0.25, 0.4), "rules": (0.1, 0.2), "links": (0.5, 0.6), "lead": (0.12, 0.2)}
#: Part of prose that lies below a calibrated threshold.
TAIL = 0.99
#: Measures of a segment whose histograms are kept, in order; `listed` is the same measure as `rep`.
MEASURES = ("fw", "rep", "top", "gram", "marks", "rules", "links", "lead")
#: Segments a default weighs as much as.
PRIOR_SEGMENTS = 200
SHARE = 0.5
#: Uses in a page from which a word or a segment counts as repeated, whatever the page's length.
OFTEN = 3
#: Share of a page's content words from which a word counts as one of its top words.
TOP_WORD_SHARE = 0.1
_TOKEN = re.compile(r"\x00|\n|(?:https?://|www\.)[^\s\x00)>\]]+|#[^\W\d_]\w*|[^\W\d_]+|\d[\d.,:]*|[^\w\s]|_", re.I)
_OTHER, _WORD, _NUMBER, _LINK, _TAG, _SEPARATOR, _CODE, _BREAK, _STOP, _OPEN, _CLOSE, _RULE = range(12)
_KINDS = {**dict.fromkeys(",;~/>", _SEPARATOR), **dict.fromkeys("|»›·•→", _RULE), **dict.fromkeys("=_\\{}<\"'`+*%@&", _CODE), "\n": _BREAK, ".": _STOP, "?": _STOP, "!": _STOP, "[": _OPEN, "]": _CLOSE}


def _kind(tok: str) -> int:
    c = tok[0]
    if c.isalpha():
        return _LINK if len(tok) > 4 and (tok[4:5] in ":s" and "://" in tok[:9] or tok[:4].lower() == "www.") else _WORD
    if c.isdigit():
        return _NUMBER
    if c == "#" and len(tok) > 1:
        return _TAG
    return _KINDS.get(c, _OTHER)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def _link_text(code: np.ndarray, vocab: list[str], kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Tokens from `[` up to its `]`, where `(` and an address follow. Brackets pair within a page; one without a partner reaches nothing."""
    inside = np.zeros(len(code) + 1, np.int64)
    at = np.flatnonzero((kind == _OPEN) | (kind == _CLOSE))
    if not len(at):
        return inside[:-1] > 0
    # brackets of one page and depth, in order: a `]` closes the one before it, if that is a `[`
    step = np.where(kind[at] == _OPEN, 1, -1)
    depth = np.cumsum(step) + (step < 0)
    order = np.lexsort((at, depth, doc[at]))
    at, depth, step, of = at[order], depth[order], step[order], doc[at[order]]
    pair = np.flatnonzero((step[:-1] > 0) & (step[1:] < 0) & (depth[:-1] == depth[1:]) & (of[:-1] == of[1:]))
    begin, end = at[pair], at[pair + 1]
    is_ = {p: vocab.index(p) if p in vocab else -1 for p in "(</"}
    ok = end + 3 < len(code)
    begin, end = begin[ok], end[ok]
    first = end + 2 + (code[end + 2] == is_["<"])
    ok = (code[end + 1] == is_["("]) & ((kind[first] == _LINK) | (code[first] == is_["/"])) & (doc[first] == doc[end])
    inside[begin[ok]] += 1
    inside[end[ok]] -= 1
    return np.cumsum(inside)[:-1] > 0


_SEGMENT = np.dtype([("chars", "u4"), ("alike", "u2"), ("flags", "u1"), *[(m, "u1") for m in MEASURES]])
_HAS_WORDS, _MACHINE, _SEVERAL, _SHORT, _SOME_RULES = 1, 2, 4, 8, 16
_STEPS = 250


def _repeats(of: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each key occurs in its page."""
    _, inv, times = np.unique((of.astype(np.uint64) << np.uint64(44)) ^ (key & np.uint64((1 << 44) - 1)), return_inverse=True, return_counts=True)
    return times[inv]


def measure(texts: list[str | None], cache: dict | None = None) -> dict[str, np.ndarray | list]:
    """Measures of a batch: `lang` and `hist` (text, measure, bin) of prose, and `segments`, the packed segments of each text."""
    cache = {} if cache is None else cache
    if len(cache) > 500_000:
        cache.clear()
    n = len(texts)
    tb = tokenize(texts, _TOKEN)
    out = {"hist": np.zeros((n, len(MEASURES), _BINS), np.int32), "lang": np.full(n, -1, np.int32), "segments": [b""] * n}
    if not len(tb.code):
        return out
    info = []
    for t in tb.vocab:
        if (v := cache.get(t)) is None:
            k = _kind(t)
            low = t.lower()
            v = cache[t] = (k, len(t), _WORD_LANGS.get(low, 0) if k == _WORD else 0, hash(low) & 0x7FFFFFFFFFFF)
        info.append(v)
    table = np.array(info, np.int64)
    kind, size, langs, word = (table[:, j][tb.code] for j in range(4))
    doc = tb.doc.astype(np.int64)
    m = len(kind)
    # segments end after a line break, and after a stop that ends a word
    new_doc = np.r_[True, np.diff(doc) > 0]
    after_stop = np.zeros(m, bool)
    after_stop[1:] = (kind[:-1] == _BREAK) | ((kind[:-1] == _STOP) & (kind[1:] != _STOP))
    after_stop[2:] &= ~((kind[1:-1] == _STOP) & (kind[:-2] != _WORD) & (kind[:-2] != _CLOSE) & (kind[:-2] != _OTHER) & (kind[:-2] != _NUMBER))
    seg = np.cumsum(new_doc | after_stop) - 1
    k = int(seg[-1]) + 1
    of = doc[np.flatnonzero(np.r_[True, np.diff(seg) > 0])]
    is_word = kind == _WORD
    count = lambda mask, w=None: np.bincount(seg[mask], None if w is None else w[mask], k)
    chars = count(np.ones(m, bool), size.astype(float))
    words = count(is_word)
    # language of the page by its function words
    votes = np.stack([np.bincount(doc[is_word], ((langs[is_word] >> i) & 1), n) for i in range(len(LANGUAGES))], 1)
    best = votes.argmax(1)
    out["lang"] = np.where(votes.max(1) > 0, best, -1).astype(np.int32)
    mine = (langs >> best[doc]) & 1
    fw = _share(np.bincount(seg, mine, k), words)
    # repetition of content words, by their number in the page
    at = np.flatnonzero(is_word & (mine == 0))
    times = _repeats(doc[at], word[at].astype(np.uint64))
    content = np.bincount(seg[at], minlength=k)
    rep = _share(np.bincount(seg[at[times >= OFTEN]], minlength=k), content)
    # the page's top words: each a large share of all its content words
    hot = times >= np.maximum(4, TOP_WORD_SHARE * np.bincount(doc[at], minlength=n))[doc[at]]
    top = _share(np.bincount(seg[at[hot]], minlength=k), content)
    # n-grams: content words that stand in a repeated run of two and in one of three within their segment
    gram = np.zeros(k)
    if len(at) > 2:
        w, s_ = word[at].astype(np.uint64), seg[at]
        near = s_[1:] == s_[:-1]
        two = _mix(w[:-1]) + w[1:]
        pair = np.flatnonzero(near)
        often = pair[_repeats(doc[at[pair]], two[pair]) >= OFTEN]
        triple = np.flatnonzero(near[:-1] & near[1:])
        third = triple[_repeats(doc[at[triple]], _mix(two[triple]) + w[triple + 2]) >= OFTEN] if len(triple) else triple
        twice, thrice = np.zeros(len(at), bool), np.zeros(len(at), bool)
        twice[often] = twice[often + 1] = True
        thrice[third] = thrice[third + 1] = thrice[third + 2] = True
        gram = (_share(np.bincount(s_[twice], minlength=k), content) + _share(np.bincount(s_[thrice], minlength=k), content)) / 2
    link_chars = count(kind == _LINK, size.astype(float))
    # the words of [text](address) are link text
    link_chars += count(_link_text(tb.code, tb.vocab, kind, doc) & (kind != _LINK), size.astype(float))
    tag_chars = count(kind == _TAG, size.astype(float))
    code = count(kind == _CODE)
    rules = count(kind == _RULE)
    marks = count(kind == _SEPARATOR) + rules
    numbers = count(kind == _NUMBER)
    machine = (code > 0.12 * (words + numbers)) | (numbers > words) & (marks < 2)
    # duplicate segments: the same words in the same order
    pos = np.arange(m) - np.searchsorted(seg, np.arange(k))[seg]
    mixed = ((word.astype(np.uint64) + np.uint64(1)) * (np.uint64(2) * pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    sums = np.zeros(k, np.uint64)
    np.add.at(sums, seg[is_word], mixed[is_word])
    has = np.flatnonzero((words >= 2) & ~machine)
    alike = np.zeros(k, np.int64)
    if len(has):
        alike[has] = _repeats(of[has], sums[has])
    shares = {
        "fw": fw, "rep": rep, "top": top, "gram": gram, "marks": marks / np.maximum(words, 1), "rules": rules / np.maximum(words, 1), "links": _share(link_chars + tag_chars, chars),
        "lead": alike / np.maximum(np.bincount(of, minlength=n)[of], 1),
    }
    rows = np.zeros(k, _SEGMENT)
    rows["chars"], rows["alike"] = chars, np.minimum(alike, 65535)
    rows["flags"] = _HAS_WORDS * (words > 0) + _MACHINE * machine + _SEVERAL * (content >= 2) + _SHORT * (words <= 12) + _SOME_RULES * (rules > 0)
    for name, x in shares.items():
        rows[name] = np.minimum(np.floor(x * _STEPS + 1e-9), 255)
    edges = np.searchsorted(of, np.arange(n + 1))
    out["segments"] = [rows[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:])]
    full = words >= FULL
    prose = full & (fw >= PROSE)
    for j, name in enumerate(MEASURES):
        pick = full if name == "fw" else prose
        b = np.minimum((shares[name][pick] * _BINS).astype(np.int64), _BINS - 1)
        out["hist"][:, j] = np.bincount(of[pick] * _BINS + b, minlength=n * _BINS).reshape(n, _BINS)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    return (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (x >> np.uint64(17))


def shares_of(segments: list[bytes], limits: np.ndarray) -> np.ndarray:
    """Share of each page that is stuffing, under its row of thresholds (in the order of `DEFAULTS`)."""
    size = np.array([len(b) // _SEGMENT.itemsize for b in segments])
    s = np.frombuffer(b"".join(segments), _SEGMENT)
    of = np.repeat(np.arange(len(segments)), size)
    t = dict(zip(DEFAULTS, (np.ceil(limits * _STEPS - 1e-6).T)[:, of]))
    x = {m: s[m].astype(float) for m in MEASURES}
    flag = lambda f: (s["flags"] & f) > 0
    prose = ~flag(_MACHINE)
    links = (x["links"] > t["links"]) & (s["chars"] > 0)
    keywords = prose & flag(_HAS_WORDS) & ((x["rep"] >= t["rep"]) | ((x["marks"] >= t["marks"]) & (x["rep"] >= t["listed"])))
    # columns of a catalogue: the names in them may hold function words
    phrases = prose & flag(_SOME_RULES) & (x["rules"] >= t["rules"]) & (x["rep"] >= t["rep"]) & (x["fw"] < 0.4 * _STEPS)
    phrases |= prose & flag(_SEVERAL) & (x["top"] >= t["top"]) & (x["fw"] < 0.5 * _STEPS)  # sentences of half function words are prose, however alike
    # advertising phrases have fewer function words than nine in ten sentences
    phrases |= prose & flag(_SEVERAL) & (x["gram"] >= t["gram"]) & (x["fw"] < 2 * t["fw"])
    # a repeated segment may hold some function words, but fewer than nine in ten sentences do
    bad = links | phrases | (keywords & (x["fw"] < t["fw"])) | ((s["alike"] >= OFTEN) & (x["fw"] < 2 * t["fw"]))
    # short segments that dominate the page, whatever their words
    lead = flag(_SHORT) & (s["alike"] >= 5) & (x["lead"] >= t["lead"])
    chars = s["chars"].astype(float)
    total = np.bincount(of, chars, len(segments))
    return np.maximum(_share(np.bincount(of, chars * bad, len(segments)), total), _share(np.bincount(of, chars * lead, len(segments)), total))


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, hist, segments) of every page; one pass, nothing shuffled, written once."""
    src = documents.where(F.col(key).isNotNull()).select(key, F.col(text).alias("_t"))
    kind = dict(src.dtypes)[key]

    def run(it):
        cache: dict = {}
        for b in batches(it, 1024):
            m = measure(b.column(1).to_pylist(), cache)
            hist = _by_language(m["lang"], m["hist"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m["lang"]), pa.array(m["segments"], pa.binary()), pa.array([hist] + [None] * (b.num_rows - 1), pa.list_(pa.int64()))], names=[key, "lang", "segments", "hist"])

    return cut_lineage(src.mapInArrow(run, f"`{key}` {kind}, lang int, segments binary, hist array<long>"))


def _by_language(lang: np.ndarray, hist: np.ndarray) -> list[int]:
    """The histograms of a batch added up by language (the last for none), flat."""
    out = np.zeros((len(LANGUAGES) + 1, *hist.shape[1:]), np.int64)
    np.add.at(out, lang, hist)  # -1 is the last
    return out.ravel().tolist()


def thresholds(hist: np.ndarray) -> np.ndarray:
    """Thresholds (language, in the order of `DEFAULTS`) of histograms (language, measure, bin)."""
    out = np.zeros((len(hist), len(DEFAULTS)))
    for i, h in enumerate(hist.astype(float)):
        for j, (name, default) in enumerate(DEFAULTS.items()):
            row = h[MEASURES.index("rep" if name == "listed" else name)].copy()
            if name == "fw":
                row[0] = 0  # segments without any function word aren't sentences
                seen = np.searchsorted(np.cumsum(row), 0.1 * row.sum()) / _BINS / 2
            else:
                seen = (np.searchsorted(np.cumsum(row), TAIL * row.sum()) + 1) / _BINS
            lo, hi = LIMITS[name]
            n = row.sum()
            out[i, j] = min(max((PRIOR_SEGMENTS * default + n * min(max(seen, lo), hi)) / (PRIOR_SEGMENTS + n), lo), hi)
    return out


def calibrate(pages: DataFrame) -> np.ndarray:
    """Thresholds by language, the last row for pages of none. Only the sum of the histograms is collected."""
    sums = pages.where("hist IS NOT NULL").select(F.posexplode("hist").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((len(LANGUAGES) + 1) * len(MEASURES) * _BINS)
    for r in sums:
        total[r["i"]] = r["x"]
    return thresholds(total.reshape(len(LANGUAGES) + 1, len(MEASURES), _BINS))


def stuffed(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, share): the pages made of keywords, links or tags, and the share of each that is."""
    pages = measured(documents, key, text)
    limits, kind = calibrate(pages), dict(pages.dtypes)[key]
    names = np.array([*LANGUAGES, None], object)

    def run(it):
        for b in batches(it, 4096):
            lang = b.column(1).to_numpy()
            share = shares_of(b.column(2).to_pylist(), limits[lang])
            at = pa.array(np.flatnonzero(share > SHARE))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(names[lang].tolist(), pa.string()).take(at), pa.array(share).take(at)], names=[key, "lang", "share"])

    return pages.select(key, "lang", "segments").mapInArrow(run, f"`{key}` {kind}, lang string, share double")
