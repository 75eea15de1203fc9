"""Turns that hold no content but what a form, page or server left in its place (problem 3).

Method: regularised logistic regression on hashed n-grams (one to three tokens) and length
features of the text, and another on those of the title (the title of a turn is its tool name),
with the shapes of its words; a row is residue if either says so.
Labels are weak: response-status lines, notices, unfilled slots and filler are
positive; talk about such things and output of commands are negative; rows
where both hold are left out. The classifiers are fitted on a bounded sample
(`SAMPLE_ROWS` rows of each of two kinds with texts up to `SAMPLE_CHARS` characters, chosen by the hash of the id) together with
a table of seed phrases, and validated on sessions that took no part in fitting
(a turn's session stands for the host): the threshold is the one with the best F1 there, and a model that
fails on them (`LEAST_RATE`) is refused. Every row is then scored, whole.

Defined results: null and empty texts aren't residue by themselves; a row is
residue if its text or its tool name is; a turn delivered again counts once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.vectors import batches, stable_hash, tokenize

#: Rows of each kind (that match a weak cue, and other) brought to the driver for fitting, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 4_000, 4_000
#: Rows looked at for one that matches a cue.
CUE_SHARE = 12
DIMENSIONS = 1 << 18
L2 = 2e-6
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
#: Least precision and recall on unseen sessions, where these hold `LEAST_POSITIVE` positives or more.
LEAST_RATE, LEAST_POSITIVE = 0.8, 50
_TOKEN = re.compile(r"\x00|\n|\w*\d\w*|[^\W\d_]+|\{+|\}+|\[+|\]+|<+|>+|@+|%+|\$+|_+|\.+|[^\w\s]")

#: Slots of template languages and forms (fixed values: notations).
SLOTS = (
    r"\{\{[^{}\n]*\}\}", r"\{%-?[^%\n]*-?%\}", r"\$\{[^{}\n]+\}", r"#\{[^{}\n]+\}", r"<%=?[^%\n]*%>", r"\[\[[^\[\]\n]+\]\]", r"<<[^<>\n]+>>",
    r"(?<![\w{$#\"':])\{[a-z_.0-9]*\}(?![\w}])", r"<[A-Z][A-Z_ ]+>", r"<(?:TODO|your|name|insert|enter)[^<>\n]*>", r"\b__[A-Z][A-Z_]+__\b", r"%\([a-z_]+\)[sd]", r"(?<![\w%])%[sd](?![\w])",
    r"@@[A-Z_]+@@", r"%[A-Z_]{3,}%", r"(?<![\w$])\$[A-Z][A-Z_]{2,}\b", r"(?<!\w):(?:placeholder|name|value|todo):(?!\w)", r"\[(?:insert|write|enter|add|your|describe|fill)\b[^\[\]\n]*\]", r"\[[A-Z]{3,}(?:[ _][A-Z]{2,})*\]", r"\bXX+/XX+/XX+\b",
    r"^\s*(?:insert|enter|type|write) \w+(?: \w+)? here\.?\s*$",
)
#: Names of tools that are slots themselves, as weak labels.
_TITLE_SLOT = re.compile("|".join([*SLOTS, r"^\W*tool\W*$", r"^[A-Z_]*(?:NAME|TOOL)[A-Z_]*_HERE$", r"^[<\[{$%#@]+[\w. -]*[>\]}%#@]+$"]))
#: Lines of servers and pages (fixed values: response-status phrases and usual notices).
NOTICES = (
    r"\b(?:4\d\d|5\d\d) (?:bad request|unauthorized|forbidden|not found|method not allowed|request timeout|gone|too many requests|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)\b",
    r"\berror [45]\d\d\b", r"(?:enable|activate|turn on|requires?|needs?|activer|aktivieren|necesita|active|habilite)\b.{0,24}\b(?:javascript|scripts|cookies)\b", r"javascript is (?:disabled|required|not enabled)", r"<noscript>",
    r"(?:does not|doesn't) support (?:scripts|javascript)", r"scripts are allowed", r"access(?: is)? denied|<code>accessdenied", r"you don't have permission", r"internal server error", r"(?:page|seite|page web|página) (?:isn't|is not|not) (?:available|found)",
    r"could not find that page|page introuvable|seite nicht gefunden|página no encontrada|no se pudo cargar|impossible de charger|konnte nicht geladen werden", r"too many requests", r"rate.limited",
    r"(?:session|link) (?:has )?expired", r"sign in again|log in to continue", r"something went wrong", r"checking your browser", r"temporarily unavailable|under maintenance", r"gateway time-?out|bad gateway", r"did not answer",
    r"verify (?:that )?you are (?:a )?human|are you a robot|captcha", r"(?:sorry|apologies),? (?:but )?i (?:can't|cannot|am unable)", r"zugriff verweigert|accès refusé|acceso denegado", r"<title>\s*(?:4|5)\d\d",
)
#: Words of filler text (fixed values).
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa qui officia deserunt mollit anim laborum ullam "
    "asdf qwer qwerty xxx blah foo bar baz dummy placeholder sample test tbd todo text goes here".split()
)
#: Cues of talk about such text, and of output of commands (fixed values).
_TALK = re.compile(
    r"(?i)\b(?:literally|fix the|reword|escape it|otherwise|replace the|before you|we saw|i (?:raised|saw|found|traced|will|compared|stopped)|so i|still shows?|asks? people|why does|should i|could you|please (?:fix|check|replace)|the (?:header|mail|logger|proxy|notice|form)|(?:after|since|until|because|when|while|once) (?:we|i|they)|errors? (?:fell|rose|dropped|grew|doubled|are (?:down|up)|went (?:down|up))|that returned|returns? (?:a )?[45]\d\d)\b"
)
_OUTPUT = re.compile(r"(?m)^(?:Traceback \(most recent|\$ |exit_code: |FAILED |\[(?:info|warn|error)\] |console\.\w+: |commit [0-9a-f]{6,}|\s+File \"|\w*(?:Error|Exception): |\d+ (?:passed|failed)|\d{4}-\d\d-\d\d |proc_|step \d)|\d+ passed in")
_SLOT = re.compile("|".join(SLOTS), re.M)
_NOTICE = re.compile("|".join(NOTICES), re.I)
_WORD = re.compile(r"[^\W\d_]+")
_VISIBLE = re.compile(r"[^\s\x00-\x1f\x7f-\xa0\u00ad\u200b-\u200f\u2028-\u202f\u2060-\u206f\ufeff]")
#: Cheap cue by which the JVM finds rows for the half of the sample that may be positive.
_CUE = r"(?i)[{}<>%]|\[\[|\[[A-Z ]{3,}\]|\[(?:insert|write|enter|your)|__|@@|XX|javascript|scripts|\b[45]\d\d\b|denied|unavailable|expired|went wrong|your browser|available|page|seite|página|too many|time-?out|lorem|ipsum|asdf|dummy|sample|blah|tbd|here|placeholder|sorry|captcha"

#: Seed phrases, each a labelled row of its own (our own wording of usual residue and of usual talk about it).
SEEDS_POSITIVE = (
    "404 Not Found", "403 Forbidden", "500 Internal Server Error", "502 Bad Gateway\nnginx", "503 Service Unavailable", "Error 404: page not found", "429 Too Many Requests. Retry later.", "Access denied.",
    "You need to enable JavaScript to use this site.", "Please turn on JavaScript and reload the page.", "This page requires JavaScript.", "Loading... please wait", "Bitte aktivieren Sie JavaScript.", "Veuillez activer JavaScript.", "Este sitio requiere JavaScript.",
    "Seite nicht gefunden.", "Page introuvable.", "Página no encontrada.", "Your session has expired. Sign in again.", "Something went wrong. Try again later.", "Checking your browser before access.", "Are you a robot?", "Sorry, but I cannot help with that.",
    "This content is not available.", "{{name}}", "${value}", "#{id}", "{0}", "%s", "%(name)s", "<NAME>", "[[name]]", "<<name>>", "__NAME__", "@@NAME@@", "[insert name here]", "[PROJECT NAME]", "<your text here>", "<TODO: text>", ":placeholder:", "{%- name -%}", "{{ user.name }}", "XX/XX/XXXX",
    "Dear {{name}}, your order {{id}} has shipped.", "Hi {0}, welcome to {1}.", "Report of <NAME>: <DATE>", "Name: __NAME__\nDate: __DATE__", "Hello %s, %s is ready.", "[write the text here]", "Insert text here", "Lorem ipsum dolor sit amet.", "lorem ipsum", "Dolor sit amet velit.",
    "TBD", "TBD TBD TBD", "TODO", "asdf asdf", "blah blah blah", "test test test", "placeholder text", "sample text goes here", "dummy text", "xxx xxx", "text goes here", "Content to be added.", "Content coming soon.", "Insert answer here", "Description goes here.",
)
SEEDS_NEGATIVE = (
    "The template still prints {{name}}; escape it in the view.", "Set ${HOME} before you run the script.", "The log shows %s literally, fix the format string.", "Replace the lorem ipsum on the page with real text.", "We saw a 502 Bad Gateway twice, so I raised the timeout.",
    "The noscript notice asks users to enable JavaScript; reword it.", "Why does the page return 404 after the deploy?", "The access denied message should name the missing role.", "Use [brackets] for optional arguments.", "The placeholder text in the form is too long.", "I found a TODO in the parser and removed it.",
)


#: Seed names of tools: slots in several notations and plain names (our own).
TITLES_POSITIVE = (
    "{{name}}", "{{ tool }}", "{tool_name}", "${NAME}", "$TOOL", "<name>", "<TOOL NAME>", "[name]", "[[tool]]", "%NAME%", "%s", "@@NAME@@", "__TOOL__", "NAME_HERE", "YOUR_TOOL_HERE", "TOOL_NAME", "<<tool>>", "#{tool}", "{%- tool -%}", "{0}", "<your tool here>", "[insert tool]", "tool", "TODO", "%(tool)s", "{{toolName}}", "<%= tool %>",
)
TITLES_NEGATIVE = (
    "terminal", "process", "browser", "browser_console", "read_file", "write_file", "search", "web.search", "git", "git-log", "python3", "http_get", "sql", "shell.run", "list_dir", "grep", "editFile", "Bash", "fetch_url", "notebook", "image2text", "db_query", "calendar", "mail.send", "patch", "mcp__files__read", "GitHub", "runTests", "HTTP", "find", "todo_write",
)


def weak_title(title: str) -> int:
    return int(bool(_TITLE_SLOT.search(title)))


def weak_label(text: str | None) -> int | None:
    """1 for residue, 0 for content, None where the cues disagree."""
    if not text:
        return 0
    words = [w.lower() for w in _WORD.findall(text)]
    filler = sum(w in FILLER for w in words) / len(words) if words else 0.0
    slot, notice = bool(_SLOT.search(text)), bool(_NOTICE.search(text))
    pos = slot or notice or (filler >= 0.7)
    talk = bool(_TALK.search(text)) or bool(_OUTPUT.search(text))
    if not pos:
        return 0
    if not talk:
        # a notice or slot somewhere in a long text says nothing about the whole
        return 1 if len(words) <= 40 or filler >= 0.7 else None
    return 0 if not filler >= 0.7 else None


def _shape(w: str) -> str:
    return "#" if any(ch.isdigit() for ch in w) else "A" if w.isupper() else "a" if w.islower() else "Aa" if w[:1].isupper() else "aA"


def features(texts: list[str | None], title: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of the hashed features of a batch: n-grams, ends and length; of titles also n-grams of shapes. Each row has about unit length."""
    n = len(texts)
    tb = tokenize([f"{t or ''}" for t in texts], _TOKEN)
    mark = "^title " if title else ""
    plain = np.array([stable_hash(mark + ("#" if any(ch.isdigit() for ch in w) else w.lower())) for w in tb.vocab] or [0], np.uint64)
    shaped = np.array([stable_hash("^shape " + (_shape(w) if w[0].isalnum() else w[0])) for w in tb.vocab] or [0], np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    edges = tb.starts()
    size = np.diff(edges)
    has = np.flatnonzero(size > 0)
    rows, idx = [], []
    for base in (plain, shaped) if title else (plain,):
        h = base[tb.code] if len(tb.code) else np.zeros(0, np.uint64)
        start, end = np.uint64(stable_hash(mark + "^start")), np.uint64(stable_hash(mark + "^end"))
        same = np.zeros(len(h), bool)
        same[1:] = tb.doc[1:] == tb.doc[:-1]
        prev = np.where(same, np.roll(h, 1), start)
        prev2 = np.where(same & np.roll(same, 1), np.roll(h, 2), start) if len(h) else h
        two = (prev * mix) ^ h
        three = (prev2 * mix * mix) ^ (two + np.uint64(1))
        rows += [tb.doc, tb.doc, tb.doc, has]
        idx += [h, two, three, (h[edges[1:][has] - 1] * mix) ^ end]
    lens = np.array([stable_hash(f"{mark}^len{i}") for i in range(10)], np.uint64)
    rows.append(np.arange(n))
    idx.append(lens[np.minimum(np.log2(size + 1), 9).astype(int)])
    row = np.concatenate(rows)
    index = ((np.concatenate(idx) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)).astype(np.int64)
    assert DIMENSIONS == 1 << 18
    norm = 1 / np.sqrt(np.maximum(size * (6 if title else 3) + 2, 1))
    return row, index, norm[row]


@dataclass
class Model:
    """Two linear classifiers, of texts and of titles, as (weights, bias)."""

    text: tuple[np.ndarray, float]
    title: tuple[np.ndarray, float]
    threshold: float = 0.5
    #: Precision and recall on unseen sessions, against the weak labels, and the numbers of rows.
    held_out: dict = field(default_factory=dict)

    def score(self, texts: list[str | None], titles: list[str | None]) -> np.ndarray:
        names = list(dict.fromkeys(t for t in titles if t and _VISIBLE.search(t)))
        of = dict(zip(names, _linear(self.title, names, True).tolist()))
        # a text that shows nothing is empty, which is no residue by itself
        shows = np.array([bool(t and _VISIBLE.search(t)) for t in texts], bool)
        return np.maximum(np.where(shows, _linear(self.text, texts, False), 0.0), np.array([of.get(t, 0.0) for t in titles]))

    def check(self) -> "Model":
        """The model itself; an error if it fails on enough unseen rows."""
        h = self.held_out
        if h and h["positive"] >= LEAST_POSITIVE and min(h["precision"], h["recall"]) < LEAST_RATE:
            raise ValueError(f"the classifier of residue fails on unseen sessions: {h}")
        return self


def _linear(model: tuple[np.ndarray, float], texts: list[str | None], title: bool) -> np.ndarray:
    row, index, value = features(texts, title)
    z = np.bincount(row, model[0][index] * value, len(texts)) + model[1]
    return 1 / (1 + np.exp(-z))


def fit(texts, labels, title: bool = False, rounds: int = 150, l2: float = L2) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adagrad; both classes weigh the same."""
    row, index, value = features(texts, title)
    used, index = np.unique(index, return_inverse=True)
    y = np.asarray(labels, float)
    n = len(y)
    share = max(y.mean(), 1e-6)
    c = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-6)) / n
    w, b = np.zeros(len(used)), 0.0
    gw, gb = np.full(len(used), 1e-10), 1e-10
    for _ in range(rounds):
        z = np.bincount(row, w[index] * value, n) + b
        d = c * (1 / (1 + np.exp(-z)) - y)
        g = np.bincount(index, d[row] * value, len(used)) + l2 * w
        gw += g * g
        w -= 0.6 * g / np.sqrt(gw)
        gb += d.sum() ** 2
        b -= 0.1 * d.sum() / np.sqrt(gb)
    full = np.zeros(DIMENSIONS)
    full[used] = w
    return full.astype(np.float32), float(b)


def _sample(turns: DataFrame, sample_rows: int) -> list[tuple[str, str | None, str | None]]:
    """(session, text, title) of at most 2 * `sample_rows` rows, in one pass: the first by hash of those with a cue and of the others.

    A bound on the hash, from the number of rows, keeps nearly all rows from the patterns and the sort.
    """
    n = max(turns.count(), 1)
    low = lambda times: F.pmod("h", F.lit(1 << 30)) < int(min(1.0, times * sample_rows / n) * (1 << 30))
    cols = turns.where("turn_id IS NOT NULL").select(F.xxhash64("turn_id", F.lit(11)).alias("h"), F.coalesce("session_id", F.lit("")).alias("host"), "text", "tool_name")
    cue = F.coalesce(F.col("text").rlike(_CUE), F.lit(False)) | F.coalesce(F.col("tool_name").rlike(r"[^\w]|[A-Z]"), F.lit(False))
    short = (F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS) & (F.coalesce(F.length("tool_name"), F.lit(0)) <= SAMPLE_CHARS)
    some = cols.where(low(CUE_SHARE) & short).withColumn("cue", cue).where(F.col("cue") | low(1.5))
    first = F.row_number().over(Window.partitionBy("cue").orderBy("h", "text", "tool_name"))
    rows = some.withColumn("_k", first).where(F.col("_k") <= sample_rows).orderBy("cue", "_k").select("host", "text", "tool_name").toPandas()
    clean = lambda v: v if isinstance(v, str) else None
    return [(r.host, clean(r.text), clean(r.tool_name)) for r in rows.itertuples(index=False)]


def train(turns: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most 2 * `sample_rows` rows and the seeds; choose the threshold and validate on every fifth session, which isn't fitted on."""
    rows = _sample(turns, sample_rows)
    unseen = lambda host: host != "" and stable_hash(host) % 5 == 0
    data = [(h, t, n, weak_label(t)) for h, t, n in rows]
    texts = [(t, y) for h, t, _, y in data if y is not None and not unseen(h)] + ([(t, 1) for t in SEEDS_POSITIVE] + [(t, 0) for t in SEEDS_NEGATIVE]) * 3
    names = {n: weak_title(n) for h, _, n, _ in data if n and not unseen(h)}
    titles = [*names.items(), *[(t, 1) for t in TITLES_POSITIVE], *[(t, 0) for t in TITLES_NEGATIVE]]
    model = Model(fit(*zip(*texts)), fit(*zip(*titles), title=True))
    # a row is positive if its text or its title is; where the text's cues disagree, only a title's slot settles it
    out = [(t, n, max(y or 0, weak_title(n) if n else 0)) for h, t, n, y in data if unseen(h) and (y is not None or n and weak_title(n))]
    if out:
        score, y = model.score([o[0] for o in out], [o[1] for o in out]), np.array([o[2] for o in out], bool)
        rates = lambda t: ((score >= t) & y).sum() / np.array([max((score >= t).sum(), 1), max(y.sum(), 1)])
        f1 = {t: 2 * p * r / max(p + r, 1e-9) for t in THRESHOLDS for p, r in [rates(t)]}
        if y.sum() >= LEAST_POSITIVE:
            model.threshold = max(THRESHOLDS, key=lambda t: (round(f1[t], 4), -abs(t - 0.5)))
        p, r = rates(model.threshold)
        model.held_out = {"rows": len(out), "positive": int(y.sum()), "precision": float(p), "recall": float(r)}
    return model


def scored(turns: DataFrame, model: Model) -> DataFrame:
    """(turn_id, score) of every row; one pass of Arrow batches, nothing is shuffled."""
    src = turns.where("turn_id IS NOT NULL").select("turn_id", "text", "tool_name")

    def run(it):
        for b in batches(it):
            s = model.score(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["turn_id", "score"])

    return src.mapInArrow(run, "turn_id string, score double")


def residue(turns: DataFrame, model: Model | None = None) -> DataFrame:
    """(turn_id): the turns without content."""
    model = (model or train(turns)).check()
    return scored(turns, model).where(F.col("score") >= model.threshold).select("turn_id").distinct()


def clean(turns: DataFrame, model: Model | None = None) -> DataFrame:
    """The turns with content, once each, with all their columns."""
    return turns.dropDuplicates(["turn_id"]).join(residue(turns, model), "turn_id", "left_anti")


def validation(turns: DataFrame, model: Model | None = None) -> DataFrame:
    """One row: rows and positives of the unseen sessions in the sample, precision and recall there, and the threshold chosen."""
    model = model or train(turns)
    h = {"rows": 0, "positive": 0, "precision": None, "recall": None, **model.held_out}
    return turns.sparkSession.createDataFrame([(h["rows"], h["positive"], h["precision"], h["recall"], model.threshold)], "rows long, positive long, precision double, recall double, threshold double")
