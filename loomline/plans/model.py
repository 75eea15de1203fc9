"""Model calls: pluggable chat functions, reading of answers, budgets."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from loomline import constants as C
from loomline.operators.sensitivity import mask_text, redact_error

#: A chat function takes a prompt and gives the answer, as text or as a provider's response object, and a usage object.
Chat = Callable[[str], tuple[str | dict, dict]]
_REGISTRY: dict[str, Callable[..., Chat]] = {}
ANSWER_MARKER = "<|channel|>final<|message|>"


def adapter(name: str):
    """Register a factory of chat functions under a name. The function it makes is sent to the workers."""

    def add(f):
        _REGISTRY[name] = f
        return f

    return add


def make_chat(name: str, **options) -> Chat:
    if name not in _REGISTRY:
        raise ValueError(f"no adapter {name}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name](**options)


@adapter("rules")
def _rules(**_) -> Chat:
    """Offline extractor: a finding for the first turn of a prompt with a cue. It makes cycles testable without a network."""
    line = re.compile(r"^turn_id=(\S+) idx=\d+ actor=(\S+)(?: tool=\S+)?: (.*)$", re.M)
    cues = (("correction_preference", re.compile(r"(?i)\b(wrong|instead|prefer)\b")), ("verification_review", re.compile(r"(?i)\b(verify|review|test|tests)\b")))

    def chat(prompt: str) -> tuple[str, dict]:
        out = []
        for turn, actor, text in line.findall(prompt):
            for code, cue in cues:
                if cue.search(text):
                    out.append({
                        "codebook_code": code, "unit": "turn", "statement": text[:120], "actor": actor, "source_reliability": "A" if actor in C.DIRECT_ACTORS else "C", "info_credibility": 2,
                        "facets": {}, "evidence": [{"turn_id": turn, "quote": text[:200]}], "confidence": "medium", "confidence_basis": "rule", "sensitivity": "internal",
                    })
                    break
            if len(out) == C.MAX_RECORDS_PER_PAYLOAD:
                break
        answer = json.dumps({"records": out})
        return answer, {"prompt_tokens": len(prompt) // 4, "completion_tokens": len(answer) // 4}

    return chat


def visible_text(answer: str | dict) -> str:
    """What a model says: of a provider's response object the text of its first choice, then what follows the last answer marker.

    A response without choices or message, one that was cut off by length, and one that says nothing are errors.
    """
    if isinstance(answer, dict):
        first = next(iter(answer.get("choices") or ()), None) if isinstance(answer.get("choices") or (), (list, tuple)) else None
        message = first.get("message") if isinstance(first, dict) else None
        faults = {"response without choices": not isinstance(first, dict), "response cut off by length": isinstance(first, dict) and first.get("finish_reason") == "length", "response without a message": not isinstance(message, dict)}
        for fault, is_so in faults.items():
            if is_so:
                raise RuntimeError(fault)
        content = message.get("content")
        if isinstance(content, list):
            said = [p if isinstance(p, str) else (p.get("text") or p.get("content")) if isinstance(p, dict) else None for p in content]
            content = "\n".join(x for x in said if isinstance(x, str))
        answer = content if isinstance(content, str) else ""
    text = answer.rpartition(ANSWER_MARKER)[2].strip()
    if not text:
        raise RuntimeError("empty answer")
    return text


_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)
_FENCE = re.compile(r"^\s*```[A-Za-z]*\s*|\s*```\s*$")


def salvage_json(text: str | None) -> str | None:
    """The JSON object of an answer: closed thoughts and fences dropped, else the object that begins at the last brace from which one can be read."""
    if not text:
        return None
    bare = _FENCE.sub("", _THINK.sub("", text).strip()).strip()
    dump = lambda v: json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else None
    try:
        return dump(json.loads(bare))
    except ValueError:
        at = bare.rfind("{")
    while at >= 0:
        try:
            return dump(json.JSONDecoder().raw_decode(bare, at)[0])
        except ValueError:
            at = bare.rfind("{", 0, at)
    return None


@dataclass
class Budget:
    """Calls and money a run may spend. Checked between batches of passes, so the cap is overshot by one batch at most."""

    max_calls: int | None = None
    max_usd: float | None = None
    calls: int = 0
    usd: float = 0.0
    log: list[str] = field(default_factory=list)

    def left(self) -> int | None:
        """Prompts that may still be sent, each counted with its retry; None without a limit."""
        if self.max_usd is not None and self.usd >= self.max_usd:
            return 0
        return None if self.max_calls is None else max(0, self.max_calls - self.calls) // C.MAX_ATTEMPTS_PER_PROMPT


_OUT = "session_id string, window_index int, window_id string, family string, prompt_hash string, payload string, usage string, error string, attempts int"


def call_model(bundles: DataFrame, chat: Chat) -> DataFrame:
    """Payloads of prompt bundles (session_id, window_index, window_id, family, prompt_hash, prompt).

    Prompts are masked once more before they leave. An answer that is no JSON is asked for once more; errors stay with their row, without keys.
    """

    def run(it: Iterator[pa.RecordBatch]):
        for b in it:
            rows = []
            for prompt in b.column(5).to_pylist():
                payload = usage = error = None
                n = 0
                while n < C.MAX_ATTEMPTS_PER_PROMPT and payload is None:
                    n += 1
                    try:
                        answer, used = chat(mask_text(prompt)[0])
                        usage = json.dumps(used or {})
                        payload = salvage_json(visible_text(answer))
                        error = None if payload else "no JSON in answer"
                    except Exception as e:  # a failed call is a row of the ledger, not of the job
                        error = redact_error(f"{type(e).__name__}: {e}")[:500]
                        break
                rows.append((payload, usage, error, n))
            cols = [list(x) for x in zip(*rows)] if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=["session_id", "window_index", "window_id", "family", "prompt_hash", "payload", "usage", "error", "attempts"])

    return bundles.select("session_id", "window_index", "window_id", "family", "prompt_hash", "prompt").mapInArrow(run, _OUT)
