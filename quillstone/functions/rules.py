"""Decision rules on statements: strict families, relations of a statement to a truth, gates of a projection.

Patterns are written with ASCII word ends (`\\b`); `ascii_ends` gives them that meaning in Java, too, and SQL engines
with RE2 take them as they are. All of them are met on normalised text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

_WORD = "[A-Za-z0-9_]"
_END = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# Patterns of the strict families, case-insensitive. A product's own name is no part of them.
CODE_OR_LOG = r"(```|^\s*(import|export|const|let|var|function|class|def|from)\b|npm\s+run|GET\s+/|POST\s+/|stack trace|console\.log|error:|warning:)"
QUESTION = r"^\s*(what|why|how|when|where|who|which|can|could|would|should|is|are|do|does|did)\b|[?]\s*$"
CHAT_TASK = r"\b(give me|write|find|search|show me|explain|summari[sz]e|review|audit|analy[sz]e|create|generate|make a|make me|tell me|help me)\b"
TRANSIENT = r"\b(freeze|frozen|unresponsive|loading|downloading|pending|console error|not seeing|showing same|reload|refresh|tab|popup|window|missing|not showing|never sends|not sending)\b"
SPECULATIVE = r"\b(maybe|might|could be|possibly|probably|i think|i guess|not sure|seems like|wonder if)\b"
NEGATIVE_CONSTRAINT = r"\b(do not|don't|dont|never|must not|should not|cannot|can't|no\s+manual|without\s+manual|avoid)\b"
FIRST_PERSON = r"\b(i|we)\s+(want|need|prefer|must|should|will|am going to|are going to)\b"
CONFIG = r"\b(runtime|model|backend|provider|architecture|schema|adapter|engine|cache|worker|mrs|dvi|gemini|claude|chatgpt)\b.{0,80}\b(is|are|uses|use|must use|should use|equals|=|:)\b"
_TOPICS = "model|backend|provider|schema|adapter|engine|cache|worker|mrs|dvi|life wiki|import|export|truth|deterministic"
_DUTIES = r"should|must|needs?\s+to|has\s+to|have\s+to|will"
PROJECT_REQUIREMENT = rf"\b({_TOPICS})\b.{{0,120}}\b({_DUTIES})\b|\b({_DUTIES})\b.{{0,120}}\b({_TOPICS})\b"
SHORT_DIRECTIVE = r"^(keep|use|switch|replace|remove|add|make|move|stick to|preserve|disable|enable)\b"
# Cues of a relation.
UPDATE_CUE = r"\b(now|going forward|from now on|replace(?:d)?|instead|switch(?:ed)?|changed? to|set to|updated? to|no longer|we(?:'ll| will) use|we decided|final(?:ly)?|canonical)\b"
UNSURE_CUE = r"\b(maybe|perhaps|might|could|should|consider|possibly|in some cases?)\b"
SEQUENCE_CUE = r"\b(if|unless|because|therefore|due to|step|first|then|finally)\b"
# Patterns of the gates.
REQUEST_START = r"^(?:i need|need |please |can you|could you|would you|help me|make |write |create |generate |give me|tell me|show me|explain |summarize |draft |build )"
REQUEST_PART = r"\b(?:for me|more details|full information|long article|article on|document on)\b"
ASSERTION = r"\b(?:is|are|was|were|has|have|uses|requires|means|contains|supports|blocks|fails|works|equals)\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"
STATE_WORD = r"\b(?:current|status|version|limit|budget|error|issue|problem|state|runtime|backend|model)\b"
TREATED_NUMBER = r"\bmust be treated as\s+\d+\b"
TREATED_WORD = r"\bmust be treated as\s+(?:on|between|ambiguous|true|false)\b"
MARKUP_WORD = r"\b(?:class|meta-data|android:name|div|span|image|svg|import|export|const)\b"
PLACEHOLDER = r"this block is not supported|browser cache is not available|mrs could not activate|retry after checking browser network/storage/console|(?:download|restore|enable)\s+local\s+mrs|[a-z0-9]+ ai runtime|model download progress"
ACKNOWLEDGEMENT = r"^(?:yes|no|ok|okay|thanks|thank you|done|sure)\b"
DIRECTIVE_PERSON = r"\b(i|we)\s+(want|need|prefer|must|should)\b"
DIRECTIVE_VERB = r"\b(should|must|needs?\s+to|has\s+to|have\s+to|do not|don't|dont|never|without manual|no manual|keep|use|switch|replace|remove|make|move|stay|stick to|preserve|protect|disable|enable)\b"
CHANGE_VERB = r"\b(?:fails|blocks|requires|supports|changed?|updated?)\b"
#: Families that keep a statement from being a truth, and those that make it an idea by themselves.
BLOCKING = ("assistant_or_unknown_author", "question", "code_or_log", "chat_task", "transient_observation", "invalid_source", "invalid_timestamp")
TRUTH_KINDS = ("decision", "constraint", "fact", "task")
ACTIVE = ("CURRENT", "CONFLICTING", "PENDING_REVIEW")


def ascii_ends(pattern: str) -> str:
    return "(?i)" + pattern.replace(r"\b", _END)


def has(c: Column, pattern: str) -> Column:
    return c.rlike(ascii_ends(pattern))


def words(c: Column) -> Column:
    """Number of parts between single spaces."""
    return F.size(F.split(c, " "))


def strict_rule(role: Column, norm: Column, kind: Column, source_valid: Column | None = None, time_valid: Column | None = None) -> Column:
    """struct(family, tier, eligible, blocked) by an ordered list of families; `norm` is normalised text."""
    own, yes = F.lower(T.normalize_text(role)), F.lit(True)
    asks = has(norm, CHAT_TASK) & ~has(norm, PROJECT_REQUIREMENT)
    ordered = [
        ("invalid_source", "RESIDUAL", False, True, ~(source_valid if source_valid is not None else yes)),
        ("invalid_timestamp", "RESIDUAL", False, True, ~(time_valid if time_valid is not None else yes)),
        ("assistant_or_unknown_author", "RESIDUAL", False, True, ~F.coalesce(own.isin("user", "human"), F.lit(False))),
        ("empty_candidate", "RESIDUAL", False, True, norm == ""),
        ("code_or_log", "RESIDUAL", False, True, has(norm, CODE_OR_LOG)),
        ("question", "RESIDUAL", False, True, has(norm, QUESTION)),
        ("chat_task", "RESIDUAL", False, True, asks),
        ("transient_observation", "RESIDUAL", False, True, has(norm, TRANSIENT)),
        ("speculation", "RESIDUAL", False, False, has(norm, SPECULATIVE) | (kind == "hypothesis")),
        ("explicit_negative_constraint", "D0", True, False, has(norm, NEGATIVE_CONSTRAINT)),
        ("explicit_first_person_requirement", "D0", True, False, has(norm, FIRST_PERSON)),
        ("explicit_project_config", "D1", True, False, has(norm, CONFIG)),
        ("bounded_project_requirement", "D1", True, False, has(norm, PROJECT_REQUIREMENT)),
        ("calibrated_short_component_directive", "D2", True, False, has(norm, SHORT_DIRECTIVE) & (words(norm) >= 3)),
    ]
    outcome = lambda f, t, e, b: F.struct(F.lit(f).alias("family"), F.lit(t).alias("tier"), F.lit(e).alias("eligible"), F.lit(b).alias("blocked"))
    out = None
    for family, tier, eligible, blocked, condition in ordered:
        out = F.when(condition, outcome(family, tier, eligible, blocked)) if out is None else out.when(condition, outcome(family, tier, eligible, blocked))
    return out.otherwise(outcome("residual", "RESIDUAL", False, False))


def intrinsic_sufficiency(norm: Column, subject: Column, value: Column) -> Column:
    n = words(norm)
    plus = lambda condition, x: F.when(condition, x).otherwise(0.0)
    score = 0.42 + plus(F.length(T.normalize_text(subject)) >= 3, 0.16) + plus(F.coalesce(F.trim(value), F.lit("")) != "", 0.12)
    score += plus(n >= 6, 0.08) + plus(n >= 12, 0.06) + 0.08 + plus(has(norm, SEQUENCE_CUE), 0.04) - plus(n < 4, 0.2)
    return F.round(T.clamp(score), 9)


def rule_of(explicit: Column, trace: Column, root: Column) -> Column:
    """The family of a record: from its rule, else its trace, else its root key."""
    prefix = "strict_truth:"
    named = F.filter(trace, lambda x: x.startswith(prefix) & ~x.isin(f"{prefix}eligible", f"{prefix}residual"))
    after = lambda c: F.substring(c, len(prefix) + 1, 1 << 20)
    from_root = F.when(F.instr(root, ":") > 0, F.substring_index(root, ":", 1))
    return F.coalesce(F.when(explicit.startswith(prefix), after(explicit)), after(F.try_element_at(named, F.lit(1))), from_root)


def root_key(rule: Column, kind: Column, subject: Column, value: Column, polarity: Column, scope: Column) -> Column:
    own = lambda c: T.normalize_identity(c)
    return F.concat_ws(":", F.coalesce(rule, F.lit("legacy")), kind, own(subject), own(value), F.coalesce(polarity, F.lit("NEUTRAL")), own(scope))


def family_compatible(rule1: Column, subject1: Column, rule2: Column, subject2: Column) -> Column:
    """Two exact families need equal subjects."""
    exact = lambda r: F.coalesce(r.isin("explicit_qa_selection", "corroborated_exact_config"), F.lit(False))
    return ~((exact(rule1) | exact(rule2)) & (T.normalize_identity(subject1) != T.normalize_identity(subject2)))


def value_relationship(a: Column, b: Column) -> Column:
    return F.when(a == b, "SAME").when(a.contains(b) | b.contains(a), "REFINES").otherwise("CONFLICTS")


def relation(atom: dict[str, Column], truth: dict[str, Column]) -> Column:
    """How a statement stands to a truth. Both have conv_id, text, subject, value, polarity, scope; the statement has keywords (an array)."""
    a, t = (T.normalize_identity(x["text"]) for x in (atom, truth))
    about = lambda x: T.terms(F.coalesce(x["subject"], x["text"], F.lit("")))
    keys = F.array_distinct(F.slice(F.filter(F.transform(F.coalesce(atom["keywords"], F.array().cast("array<string>")), lambda k: T.normalize_identity(k)), lambda k: F.length(k) >= 3), 1, 6))
    both = F.size(F.array_intersect(keys, F.slice(T.terms(t), 1, 10)))
    shared = F.when((F.size(keys) > 0) & (F.size(T.terms(t)) > 0), both / F.size(keys)).otherwise(0.0)
    s = F.greatest(T.jaccard(about(atom), about(truth)), shared)
    like = T.jaccard(F.slice(T.terms(a), 1, 18), F.slice(T.terms(t), 1, 18))
    v1, v2, c1, c2 = (T.normalize_identity(x[k]) for k in ("value", "scope") for x in (atom, truth))
    values = F.when((v1 != "") & (v2 != ""), value_relationship(v1, v2)).otherwise("NONE")
    p1, p2 = (F.coalesce(x["polarity"], F.lit("NEUTRAL")) for x in (atom, truth))
    update = has(a, UPDATE_CUE)
    other = (atom["conv_id"].cast("string") != "") & (truth["conv_id"].cast("string") != "") & (atom["conv_id"] != truth["conv_id"])
    changed = lambda otherwise: F.when(update, "SUPERSEDES").otherwise(otherwise)
    return (
        F.when(F.coalesce(other, F.lit(False)), "UNCERTAIN").when(a == t, "SAME").when(s < 0.32, "UNCERTAIN").when(((c1 != "") | (c2 != "")) & (c1 != c2), "DIFFERENT_SCOPE")
        .when(has(a, UNSURE_CUE) & ~update, "UNCERTAIN").when((p1 != "NEUTRAL") & (p2 != "NEUTRAL") & (p1 != p2), changed("CONTRADICTS")).when(values == "CONFLICTS", changed("CONTRADICTS"))
        .when((values == "REFINES") & (s >= 0.45), changed("REFINES")).when(update & (s >= 0.45), "SUPERSEDES").when(like >= 0.82, "SAME")
        .when((a.contains(t) | (like >= 0.58)) & (F.length(a) > F.length(t)), "REFINES").otherwise("UNCERTAIN")
    )


def request_like(norm: Column) -> Column:
    return has(norm, REQUEST_START) | has(norm, REQUEST_PART)


def structured(norm: Column) -> Column:
    return (norm != "") & (has(norm, ASSERTION) | has(norm, r"[:=]\s*\S+") | has(norm, NUMBER) | has(norm, STATE_WORD))


def grounded(norm: Column, value: Column, scope: Column, evidence: Column | int = 0) -> Column:
    filled = lambda c: T.normalize_identity(c) != ""
    return filled(value) | filled(scope) | (F.lit(evidence) >= 2 if isinstance(evidence, int) else evidence >= 2) | structured(norm)


def ui_junk(norm: Column) -> Column:
    """What a screen or a template wrote, or hardly any letters."""
    return (
        (F.length(norm) < 10) | has(norm, TREATED_NUMBER) | (has(norm, TREATED_WORD) & (words(norm) < 12)) | has(norm, r"^```|^`{1,3}\s*$")
        | (has(norm, r"<[^>]+>") & has(norm, MARKUP_WORD)) | has(norm, PLACEHOLDER) | (F.length(F.regexp_replace(norm, "[^A-Za-z]", "")) < 6)
    )


def weak_standalone(norm: Column, allow_structured: Column) -> Column:
    return (request_like(norm) & ~(allow_structured & structured(norm))) | (words(norm) < 4) | has(norm, ACKNOWLEDGEMENT)


def directive_shape(norm: Column) -> Column:
    return has(norm, DIRECTIVE_PERSON) | has(norm, DIRECTIVE_VERB)


def thin_fact(norm: Column, kind: Column, value: Column, scope: Column, n_keywords: Column, current: Column) -> Column:
    bare = has(norm, r"\bstatus\b") & ~has(norm, CHANGE_VERB)
    few = (T.normalize_identity(value) != "") & (n_keywords <= 3) & ~grounded(norm, value, scope, F.when(current, 2).otherwise(0))
    return (kind == "fact") & (has(norm, r"\bversion\b") | bare | few)


def promotable(norm: Column, is_grounded: Column) -> Column:
    return ~ui_junk(norm) & ~weak_standalone(norm, is_grounded)


def sentence_case(c: Column) -> Column:
    t = F.regexp_replace(T.normalize_text(F.coalesce(c, F.lit(""))), r"^[\s:;,.]+|[\s:;,.]+$", "")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 20))


def clipped(c: Column, most: int = 260) -> Column:
    """Text for display: without code fences, marks, links and addresses, cut at the last space before `most` characters."""
    t = T.normalize_text(F.coalesce(c, F.lit("")))
    for pattern, to in ((r"```[\s\S]*?```", " "), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?i)https?://\S+", ""), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    t = F.trim(t)
    head = F.substring(t, 1, most)
    last = F.length(head) - F.instr(F.reverse(head), " ")  # place of the last space, from 0
    end = F.when((F.instr(head, " ") == 0) | (last < 120), most).otherwise(last)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(head.substr(F.lit(1), end), F.lit("...")))


def readable_value(c: Column) -> Column:
    t = F.regexp_replace(T.normalize_text(F.coalesce(c, F.lit(""))), "[.]+$", "")
    return F.when(F.length(t) <= 140, t).otherwise("")


def _scope(c: Column) -> Column:
    t = T.normalize_text(F.coalesce(c, F.lit("")))
    return F.when(t == "", "").otherwise(F.concat(F.lit(" ("), t, F.lit(")")))


def readable_atom(kind: Column, subject: Column, value: Column, scope: Column, text: Column) -> Column:
    s, v = sentence_case(subject), readable_value(value)
    say = lambda head, verb: F.concat(F.lit(head), s, F.lit(f" {verb} "), v, _scope(scope), F.lit("."))
    shown = F.when(kind == "decision", say("Decision: ", "is")).when(kind == "constraint", say("Constraint: ", "must be treated as")).when(kind == "task", say("Task: ", "needs")).otherwise(say("", "is"))
    return F.when((s != "") & (v != ""), shown).otherwise(clipped(text))


def readable_truth(kind: Column, subject: Column, value: Column, scope: Column, text: Column) -> Column:
    s, v = sentence_case(subject), readable_value(value)
    head = F.when(kind == "decision", "Decision").when(kind == "constraint", "Constraint").otherwise("Current truth")
    return F.when((s != "") & (v != ""), F.concat(head, F.lit(": "), s, F.lit(" is "), v, _scope(scope), F.lit("."))).otherwise(clipped(text))


def readable_title(label: str, subject: Column, text: Column) -> Column:
    s = sentence_case(subject)
    t = F.regexp_replace(clipped(text, 96), "[.?!]+$", "")
    return F.when(F.length(s) >= 4, F.substring(s, 1, 90)).when(t != "", t).otherwise(label.replace("_", " ").lower())
