"""Questions: names in them, lexical queries, types, sub-questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt.functions.text import STOP_WORDS

# Patterns of the reference behaviour, as published.
COMPARISON = [r"\bcompare\b", r"\bdifference\s+between\b", r"\bversus\b", r"\bvs\.?\b"]
MULTI_HOP = [
    r"\bwhich\s+[a-z0-9_\-]+\s+.*?\b(?:that|which|who|of\s+which|by\s+the)\b",
    r"\b(?:won\s+by|ruled\s+by|held\s+by|controlled\s+by|allied\s+with|affiliated\s+with|member\s+of|lair\s+of|seat\s+of|stronghold\s+of|dominion|journey\s+to\s+examine)\b",
    r"\bwhose\s+[a-z0-9_\-]+\b",
    r"\b(?:connected\s+to|related\s+to|participated\s+in)\b",
    r"\b(?:war|accord|event|faction|citadel|keep|treaty|dominion|lair)\b",
]
LEADS = ["what is", "according to", "which war", "in the", "to which", "where was", "who was", "how many", "at what"]
QUOTED = r"['\"]([^'\"]+)['\"]"
TITLED = r"\b((?:House|Ser|Lord|Lady|High|Warden|Archon|The)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
EPITHET = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+(?:the|of|in|and|de|da|for|von)\s+[A-Z][a-z]+)+)\b"
CAPITALS = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
WORDS = r"\b([A-Za-z0-9\-_]+)\b"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern))


def _distinct(names: Column) -> Column:
    """The first of names that are equal in any case, in order."""
    return F.aggregate(names, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def names(question: Column) -> Column:
    """Names that a question seems to hold: quoted, titled, with an epithet, of several capitals, then single capitals that no other name holds."""
    led = lambda x: ~F.lower(x).rlike("^(" + "|".join(LEADS) + ")")
    first = F.concat(
        F.filter(F.transform(_all(question, QUOTED), lambda x: F.trim(x)), lambda x: F.length(x) > 2),
        _all(question, TITLED),
        F.filter(_all(question, EPITHET), lambda x: led(x) & (F.length(x) > 3)),
        F.filter(_all(question, CAPITALS), lambda x: led(x) & (F.length(x) > 3)),
    )
    words = _all(question, WORDS)
    single = F.filter(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(STOP_WORDS) & (F.length(w) > 3))
    return F.aggregate(single, _distinct(first), lambda a, w: F.when(F.exists(a, lambda y: F.contains(F.lower(y), F.lower(w))), a).otherwise(F.array_append(a, w)))


def lexical_query(question: Column, found: Column) -> Column:
    """The names, then the other words worth looking up; without any the question itself."""
    said = F.array_join(found, " ")
    rest = F.filter(_all(question, WORDS), lambda t: ~F.lower(t).isin(STOP_WORDS) & ~F.contains(F.lower(said), F.lower(t)) & (F.length(t) > 2))
    query = F.trim(F.concat_ws(" ", F.nullif(said, F.lit("")), F.nullif(F.array_join(rest, " "), F.lit(""))))
    return F.when(query == "", question).otherwise(query)


def kind(question: Column, found: Column) -> Column:
    """comparison, multi_hop, multi_entity or simple."""
    any_of = lambda patterns: question.rlike("(?i)" + "|".join(patterns))
    return F.when(any_of(COMPARISON), "comparison").when(any_of(MULTI_HOP), "multi_hop").when(F.size(found) >= 2, "multi_entity").otherwise("simple")


# Patterns of composed questions with their two sub-questions, as published; {n} is the n-th group.
# The first letter of {1!} is made a capital.
TEMPLATES: list[tuple[str, str, str]] = [
    (r"^(which|what|who)\s+(.*?)\s+(?:was\s+ultimately\s+|was\s+|were\s+)?(.*?)\s+by\s+(?:the\s+)?([a-z0-9_\-]+)\s+(?:that|which|who|of\s+which)\s+(.*?)\s+is\s+a\s+(?:member|leader|soldier|commander|standard-bearer|falconer).*?\??$", "Which {4} is {5} a member of?", "{1!} {2} was {3} by that {4}?"),
    (r"^(which|what|who)\s+(.*?)\s+(?:was\s+ultimately\s+|was\s+|were\s+)?(.*?)\s+by\s+(?:the\s+)?([a-z0-9_\-]+)\s+(?:that|which|who|of\s+which)\s+included\s+(.*?)\s+as\s+(?:one\s+of\s+its\s+members|a\s+member).*?\??$", "Which {4} included {5} as a member?", "{1!} {2} was {3} by that {4}?"),
    (r"^(which|what|who)\s+(.*?)\s+(?:was\s+ultimately\s+|was\s+|were\s+)?(.*?)\s+by\s+(?:the\s+)?([a-z0-9_\-]+)\s+(?:that|which|who|of\s+which)\s+(.*?)\??$", "Which {4} {5}?", "{1!} {2} was {3} by that {4}?"),
    (r"^(which|what)\s+(individual|person|figure|member|commander|leader|ruler)\s+(?:was|is)\s+(?:a\s+)?([a-z0-9_\-]+)\s+(?:of|in)\s+(?:the\s+)?([a-z0-9_\-]+)\s+(?:that|which|who)\s+(.*?)\s+(?:the\s+)?(.*?)\??$", "Which {4} {5} {6}?", "Which {2}s were {3}s of that {4}?"),
    (r"^(whose|who|which|what)\s+(.*?)\s+(?:encompasses|contains|holds|houses|controls|rules|guards|is|was)\s+(?:the\s+)?(.*?)\s+of\s+(?:the\s+)?(.*?)\??$", "Where is the {3} of {4}?", "{1!} {2} encompasses that location?"),
    (r"^(who|what)\s+(?:was|is)\s+the\s+(.*?)\s+of\s+(?:the\s+)?(.*?)\s+of\s+(?:the\s+)?(.*?)\??$", "Where is the {3} of {4}?", "{1!} was the {2} of that {3}?"),
    (r"^(which|what)\s+(.*?)\s+did\s+(.*?)(?:'s|\s+own)\s+(.*?)\s+(?:ultimately\s+)?(win|conquer|rule|control|hold|command)\??$", "Which {4} does {3} belong to or serve?", "{1!} {2} did that {4} {5}?"),
    (r"^(?:in\s+what\s+way\s+is|how\s+is)\s+(.*?)\s+(?:connected|affiliated|related|allied)\s+to\s+(?:the\s+)?(.*?)\s+of\s+(?:the\s+)?(.*?)\??$", "Who were the {2} of {3}?", "How is {1} connected or affiliated to that {2}?"),
    (r"^(?:to\s+which|where|in\s+which)\s+(.*?)\s+.*?examine\s+(?:the\s+)?(.*?)\s+(?:long\s+)?(borne|wielded|held|created|forged|carried|crafted)\s+by\s+(.*?)(?:\s+since.*|\?|$)", "What {2} was {3} by {4}?", "Where or in which {1} is that {2} housed or located?"),
]
SPLIT = r"^(.*?)\s+(that|who|which)\s+(.*?)\??$"


def _filled(question: Column, pattern: str, template: str) -> Column:
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts.append(F.lit(before))
        group = F.trim(F.regexp_extract(question, "(?i)" + pattern, int(name.strip("!"))))
        parts.append(F.concat(F.upper(F.substring(group, 1, 1)), F.lower(F.substring(group, 2, 1000))) if name.endswith("!") else group)
    return F.concat(*parts, F.lit(rest))


def sub_questions(question: Column) -> Column:
    """Two sub-questions of a composed question, else the question alone."""
    q = F.trim(question)
    found = F.lit(None).cast("array<string>")
    for pattern, one, two in reversed(TEMPLATES):
        found = F.when(q.rlike("(?i)" + pattern), F.array(_filled(q, pattern, one), _filled(q, pattern, two))).otherwise(found)
    head, tail = F.trim(F.regexp_extract(q, "(?i)" + SPLIT, 1)), F.trim(F.regexp_extract(q, "(?i)" + SPLIT, 3))
    asks = q.rlike("(?i)which|what|who|where|whose")
    split = q.rlike("(?i)" + SPLIT) & asks & (F.size(F.split(head, r"\s+")) >= 3) & (F.size(F.split(tail, r"\s+")) >= 3)
    other = F.when(split, F.array(F.concat(F.lit("Which entity "), tail, F.lit("?")), F.concat(head, F.lit(" that entity?")))).otherwise(F.array(q))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.coalesce(found, other))
