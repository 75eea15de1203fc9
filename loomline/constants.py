"""Vocabularies and patterns of the domain.

Everything here is a fixed value: results depend on these lists and patterns as
they stand. Patterns are written for Java's and RE2's common syntax.
"""

from __future__ import annotations

# --- actors, units, grades -------------------------------------------------

#: Actor of a role; any other role is its own actor, a missing one `unknown`.
ROLE_ACTORS = {"user": "user", "human": "user", "assistant": "agent", "agent": "agent", "tool": "tool", "system": "system"}
SOURCE_RELIABILITY = ("A", "B", "C", "D", "E", "F")
UNITS = ("turn", "exchange", "arc", "session")
CONFIDENCE = ("low", "medium", "high")
SENSITIVITY_LEVELS = ("internal", "personal", "secret")
SINKS = ("memory_candidate", "skill_candidate", "profile_candidate", "report_only", "quarantine", "discard")
STREAMS = ("steering", "behavior", "methodology")
DIRECT_ACTORS = ("user", "system")

# --- outcomes ----------------------------------------------------------------

OUTCOME_CODES = ("intent_stated", "delivery_result", "rework_cause")
DELIVERY_VALUES = ("landed", "partial", "rework", "failed", "unknown")
#: Deliveries that can have a cause of rework.
REWORK_DELIVERIES = ("partial", "rework", "failed")
CAUSE_VALUES = ("instruction", "agent", "tool", "environment", "none")
REAL_CAUSES = ("instruction", "agent", "tool", "environment")

# --- skipping of messages -----------------------------------------------------

SKIP_COMPACTION = ("[context compaction", "context compaction — reference only")
SKIP_IMPORTANT_PREFIX = "[important:"
SKIP_IMPORTANT = ("[important: background process", "[important: the user has invoked")
SKIP_TASK_LIST_PREFIX = "[your active task list was preserved across context compression]"
SKIP_SKILL_DUMP = ("<available_skills>", "conversation-archive-mining/skill.md")
SKIP_TOOLS = ("skill_view", "skills_list")
KEPT_TOOLS = ("terminal", "process", "browser_console")
#: Two further terms are names of a project; they hold "pattern miner" or "pattern-miner", so nothing is lost without them.
EXCLUDE_TERMS = ("pattern miner", "pattern-miner", "conversation miner", "conversation mining", "conversation-mining", "pilot-00", "local conversation mining")

# --- sensitivity ----------------------------------------------------------------

SECRET_PATTERNS = (
    r"gh[opsu]_[A-Za-z0-9_]{6,}",
    r"sk-ant[-A-Za-z0-9_\.]{6,}",
    r"sk-[A-Za-z0-9]{16,}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"(?i)(api[_-]?key|token|secret|password)\s*[:=]\s*[^\s,;]{6,}",
)
CREDENTIAL_NAME = r"\b[A-Z0-9_]*(?:API_KEY|TOKEN|SECRET|PASSWORD|PRIVATE_KEY)\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HOME_PATH = r"/home/[A-Za-z0-9._-]+/[^\s)\]]+"
PRIVATE_NETWORK = r"\b(?:10|172\.(?:1[6-9]|2\d|3[01])|192\.168|100\.\d{1,3})\.\d{1,3}\.\d{1,3}\b"
PERSONAL_TOPIC = r"(?i)\b(career|resume|linkedin|employment|employer|job title|laid off|layoff|interview|salary|smurfit|westrock|job[- ]?search)\b|on the market|draw up an email|looking for work"
#: Kind, pattern and label of each detector, in the order in which hits at one place rank.
DETECTORS = (
    *(("secret", p, "SECRET") for p in SECRET_PATTERNS),
    ("credential_name", CREDENTIAL_NAME, "CREDENTIAL_NAME"),
    ("email", EMAIL, "EMAIL"),
    ("home_path", HOME_PATH, "PATH"),
    ("network", PRIVATE_NETWORK, "NETWORK"),
    ("personal_topic", PERSONAL_TOPIC, "PERSONAL_TOPIC"),
)

# --- signals ----------------------------------------------------------------------

QUESTION_START = r"(?i)^(should|can|could|would|will|do|does|did|is|are|was|were|what|why|how|which|when|where|may)\b"
CORRECTION = r"(?i)\b(no|actually|instead|don't|do not|not what|should have|only ask|ask only)\b"
AUTHORIZATION = r"\b(approval|deploy|destructive|spend|credentials|authorize|ask before|only before)\b"
FAILURE_CERTAIN = r"(?m)^\s*(Traceback|(Error|Exception|[A-Za-z_][A-Za-z0-9_]*(Error|Exception)):\s)"
FAILURE_EXIT = r"exit[_ ]?code['\"]?\s*[:=]\s*[1-9]"
FAILURE_LINE = r"(?im)^\s*(failed|failure|fatal|error|command failed)\b"
METHOD_WORDS = ("fable", "opus", "strategy", "pilot", "plan", "test", "implement", "verify", "review", "dogfood", "weighted", "ticket")
METHOD_STRUCTURE = ("plan", "test", "implement", "verify", "review", "dogfood", "weighted", "ticket", "strategy")
METHOD_STATUS_PREFIXES = ("prompt saved", "done.", "confirmed ", "i'll answer", "i will answer")
METHOD_REPORT_PREFIXES = ("i'm invoking fable", "dev servers are stopped", "now i'll run", "i'll run", "prompt saved", "full backend", "full verification is green")
METHOD_NEAR_TERM = ("i'll ", "i will ", "i'm ", "i am ", "now i'll ")
METHOD_REUSABLE = ("controlled sequence", "tradeoff", "rationale", "root cause", "regression test first", "failing regression test", "plan, test, implement", "red tests")
#: Most records of a session by stream and kind.
CAPS = {"clarification_qa": 10, "correction": 10, "clarification_trigger": 8, "failure_recovery_arc": 5, "methodology": 8}
CONFIDENCE_DEFAULT, CONFIDENCE_CORRECTION, CONFIDENCE_METHOD = 0.72, 0.82, 0.68
DETERMINISTIC_VERSION = "deterministic-v2"
BRIEF_CHARS, QUOTE_CHARS = 120, 520

# --- windows and passes ---------------------------------------------------------------

MAX_WINDOW_TOKENS, OVERLAP_TOKENS, MAX_PROMPT_TOKENS = 3500, 600, 7600
TURN_CHARS = (2400, 900, 420)
FAMILY_PATTERNS = {
    "correction_preference": r"(?i)\b(wrong|not what|instead|prefer|remember|concise|jargon|context window|do not|don't|stop asking|i want|i need)\b",
    "authorization_limit": r"(?i)\b(do not|don't|go ahead|you can|do it|approval|authorize|permission|draft|send|post|github|reboot|blocked|unblock)\b",
    "verification_review": r"(?i)\b(verify|test|tests|review|dogfood|smoke|proof|evidence|failed|failure|error|traceback|timeout|REQUEST_CHANGES|rerun)\b",
    "methodology_workflow": r"(?i)\b(plan|ticket|issue|PR|merge|commit|branch|kanban|weighted|workflow|phase|roadmap|artifact-driven|subagent|pilot|gold set)\b",
    "model_routing": r"(?i)\b(qwen|opus|fable|grok|claude|sonnet|local model|4090|llama|thinking|no_think|model routing|ask fable|use fable|use opus)\b",
    "outcome_attribution": r"(?i)\b(redo|redid|rework|wrong target|ambiguous|unclear|had to|caused|landed|shipped|merged|delivered|failed|didn'?t work|start over)\b",
}
NAMED_ROUTE = r"(?i)\b(qwen|opus|fable|grok|claude|sonnet|gemini|copilot|local model|model_routing|model routing|ask fable|use fable|use opus|delegate(?:d| to)?|subagent)\b"
#: Passes in order, with the codes each may give.
PASS_CODES = {
    "correction_preference": ("correction_preference", "communication_preference"),
    "authorization_limit": ("authorization_limit", "model_routing"),
    "verification_review": ("verification_review", "failure_recovery"),
    "methodology_workflow": ("methodology_workflow",),
    "outcome_attribution": ("intent_stated", "delivery_result", "rework_cause"),
}
FAMILY_ALIASES = {"authorization": "authorization_limit", "correction": "correction_preference", "verification": "verification_review", "failure": "verification_review", "methodology": "methodology_workflow"}
ALL_CODES = tuple(c for codes in PASS_CODES.values() for c in codes)

# --- platform notices that are no evidence ------------------------------------------------

NOTICE_EXACT = {
    "tool_iteration_limit_notice": "You've reached the maximum number of tool-calling iterations allowed. Please provide a final response summarizing what you've found and accomplished so far, without calling any more tools.",
    "voice_input_concision_note": "[Voice input — respond concisely and conversationally, 2-3 sentences max. No code blocks or markdown.]",
}
NOTICE_PATTERNS = {
    "tool_loop_warning_repeated_exact": r"\[Tool loop warning: repeated_exact_failure_warning; count=\d+; [A-Za-z0-9_]+ has failed \d+ times with identical arguments\. This looks like a loop; inspect the error and change strategy instead of retrying it unchanged\.\]",
    "tool_loop_warning_same_tool_failure": r"\[Tool loop warning: same_tool_failure_warning; count=\d+; [A-Za-z0-9_]+ has failed \d+ times this turn\. This looks like a loop\. Do not switch to text-only replies; keep using tools, but diagnose before retrying\. First inspect the latest error/output and verify your assumptions\. For terminal failures, run a small diagnostic such as `pwd && ls -la` in the same tool, then try an absolute path, a simpler command, a different working directory, or a different tool such as read_file/write_file/patch\.\]",
    "tool_loop_warning_idempotent_no_progress": r"\[Tool loop warning: idempotent_no_progress_warning; count=\d+; [A-Za-z0-9_]+ returned the same result \d+ times\. Use the result already provided or change the query instead of repeating it unchanged\.\]",
    "hardline_shutdown_reboot_block": r"BLOCKED \(hardline\): system shutdown/reboot\. This command is on the unconditional blocklist and cannot be executed via the agent(?: .*)?",
    "terminal_foreground_timeout_cap": r"Foreground timeout \d+s exceeds the maximum of 600s\. Use background=true with notify_on_complete=true for long-running commands\.",
    "model_switch_note": r"\[Note: model was just switched from [^\]]+ to [^\]]+ via [^\]]+\. Adjust your self-identification accordingly\.\]",
}

# --- register, scoring, cost ------------------------------------------------------------------

MIN_PRIMARY_QUOTE_CHARS = 15
MAX_RECORDS_PER_PAYLOAD = 3
Z_95 = 1.96
BUCKET_SHORT, BUCKET_MEDIUM = 3, 20
TICKS_PER_USD = 10_000_000_000
#: List prices in USD per million tokens: input, output.
PRICES = {"grok-4.3": (1.25, 2.50)}
MAX_ATTEMPTS_PER_PROMPT = 2
