"""Defective pairs of question and answer, with the type of defect.

The question is turned into a suffix automaton over its words; the answer is run through it, and the words
that lie in matches make up the share of the answer that is copied. Phrases of refusal are found by one automaton over
all of them. A stack of delimiters tells open quotations, brackets and citations at the answer's end, and
counts over all answers tell which words can end one at all. Votes of function words tell languages.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases by which an answer declines (lower case, plain apostrophes).
REFUSALS = [
    "i cannot answer", "i can't answer", "i cannot help", "i can't help", "can't say", "cannot say", "i must decline", "i have to decline", "i decline to",
    "i won't be able", "i will not be able", "i am not able", "i'm not able", "i am unable", "i'm unable", "unable to determine", "i don't have enough", "i do not have enough",
    "i have to pass", "i must pass", "falls outside what i can", "beyond what i can", "outside my", "i cannot provide", "i can't provide", "i cannot assist", "i can't assist",
    "i'm sorry", "i am sorry", "my apologies", "i apologize", "i apologise", "i don't know", "i do not know", "no information available", "cannot be answered", "can't be answered", "not able to discuss",
    "i'd rather not", "i would rather not", "i refuse to", "cannot fulfil", "cannot comply", "can't comply", "unable to answer", "unable to help", "unable to provide",
    "do not let me answer", "don't let me answer", "does not allow me to answer", "do not allow me to answer", "insufficient to answer", "insufficient for an answer", "insufficient evidence", "insufficient information", "not enough evidence", "not enough information",
    "no information about", "no information on", "nothing about this in", "not possible for me to", "impossible for me to", "not in a position to", "no answer can be given", "cannot give an answer", "can't give an answer", "cannot be determined", "can't be determined", "i lack the",
    "reicht nicht aus", "reichen nicht aus", "nicht genügend", "nicht genug informationen", "keine informationen", "keine angaben", "keine auskunft", "nicht möglich zu beantworten", "lässt sich nicht beantworten", "nicht beantworten", "bin nicht in der lage", "muss ich passen", "möchte ich nicht beantworten",
    "aucune information", "pas assez d'informations", "informations insuffisantes", "ne permettent pas de répondre", "ne permet pas de répondre", "ne saurais répondre", "ne peux répondre", "impossible de répondre",
    "no hay suficiente", "no hay información", "ninguna información", "información insuficiente", "no permiten responder", "no permite responder", "no es posible responder", "imposible responder", "no estoy en condiciones", "prefiero no responder",
    "es tut mir leid", "tut mir leid", "kann ich nicht", "ich kann nicht", "liegen mir keine", "ich kann das nicht", "kann ich leider", "ich kann diese", "darf ich nicht", "habe ich keine", "weiß ich nicht",
    "je suis désolé", "je ne peux pas", "je ne suis pas en mesure", "je regrette", "je ne dispose pas", "je ne sais pas", "il m'est impossible", "je dois décliner",
    "lo siento", "no puedo responder", "no puedo ayudar", "no puedo", "no dispongo de", "no tengo información", "no tengo suficiente", "no me es posible", "debo declinar", "no sé",
]
# Frequent function words of the languages questions are asked in, without those that two of them share.
STOPWORDS = {
    "en": "the of and to is was were that for with as his her it by from which who what when where why how did does had have not after before until but this are been at how they their there would on",
    "de": "der die das und ist war wurde nicht von mit auf für den dem des ein eine einer einem einen nach bei aus wer was wann wo warum wie hat hatte im zu vor bevor als dass sich kam er sie es auch später trotz über",
    "fr": "je en le la les des du et est était ne pas que qui dans pour par sur avec une un au aux où quand pourquoi comment il elle son sa ses avait été jusqu à derrière ce cette plus avant bien malgré donc",
    "es": "la en el los las del y es era fue no que quien quién en para por con una un al dónde cuándo cómo qué su sus había hasta detrás se lo más antes pese aunque ya cuando",
}
# Words that come before a question that is given back.
PREFACES = set("question asked asking asks ask you your is was as to the this that here again repeat frage lautet gefragt fragst fragen sie du ist die das question posée demandez demande vous tu est la votre pregunta preguntas pregunta preguntado es se su tu answer q".split())
_SMALL = {w for words in STOPWORDS.values() for w in words.split()}
# Answers without content.
PLACEHOLDERS = {"none", "n/a", "na", "null", "nil", "nan", "no answer", "not available", "tbd", "todo", "empty", "undefined", "unknown answer", "answer", "question", "a", "response", "reply", "output", "assistant", "antwort", "réponse", "respuesta"}

_CITED = re.compile(r"\[[^\[\]]*\]|【[^】]*】")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»")
_LABEL = re.compile(r"^\s*(?:\W*)(?:q|question|frage|pregunta|a|answer|antwort|réponse|respuesta)\s*[:：]\s*", re.I)
_STOP = re.compile(r"[.!?…。！？؟।॥۔][\"”“’'»)\]」』]*$")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "」": "「"}


def _votes() -> dict[str, set[str]]:
    sets = {k: set(v.split()) for k, v in STOPWORDS.items()}
    return {k: v - set().union(*(o for j, o in sets.items() if j != k)) for k, v in sets.items()}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in REFUSALS:
        found.add_word(phrase, len(phrase))
    found.make_automaton()
    return found


class Suffixes:
    """The suffix automaton of a list of words."""

    def __init__(self, words: list[str]):
        self.step, self.link, self.size = [{}], [-1], [0]
        last = 0
        for w in words:
            new = self._state(self.size[last] + 1)
            p = last
            while p >= 0 and w not in self.step[p]:
                self.step[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.step[p][w]
                if self.size[q] == self.size[p] + 1:
                    self.link[new] = q
                else:
                    twin = self._state(self.size[p] + 1)
                    self.step[twin], self.link[twin] = dict(self.step[q]), self.link[q]
                    while p >= 0 and self.step[p].get(w) == q:
                        self.step[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def _state(self, size: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.size.append(size)
        return len(self.step) - 1

    def copied(self, words: list[str], least: int = 2) -> int:
        """How many of the words lie in stretches of at least ``least`` words that the automaton's text holds."""
        state, run, until, total = 0, 0, 0, 0
        for i, w in enumerate(words, 1):
            while state and w not in self.step[state]:
                state = self.link[state]
                run = self.size[state]
            if w in self.step[state]:
                state, run = self.step[state][w], run + 1
            if run >= least:
                total += i - max(until, i - run)
                until = i
        return total


def _words(text: str) -> list[str]:
    return _WORD.findall(text.casefold().replace("’", "'"))


def _content(answer: str) -> str:
    """The answer without citations, labels and characters that show nothing."""
    plain = "".join(" " if unicodedata.category(c) in ("Cf", "Cc", "Zs", "Zl", "Zp") else c for c in answer)
    return _LABEL.sub("", _CITED.sub(" ", plain)).strip()


def _language(text: str, votes: dict[str, set[str]]) -> tuple[set[str], int]:
    """The languages with most function words in a text, and how many; for other scripts "other script"."""
    letters = [c for c in text if c.isalpha()]
    foreign = sum(1 for c in letters if c > "ɏ")
    if letters and foreign > 0.5 * len(letters):
        return {"other script"}, foreign
    words = _words(text)
    counts = {k: sum(w in s for w in words) for k, s in votes.items()}
    most = max(counts.values())
    return {k for k, n in counts.items() if n == most}, most


def _declines(answer: str, phrases: ahocorasick.Automaton) -> bool:
    """Whether a sentence declines and no other gives anything: a name, a number or a citation."""
    low = answer.casefold().replace("’", "'")
    hits = [(end - size + 1, end) for end, size in phrases.iter(low)]
    hits = [(a, b) for a, b in hits if (a == 0 or not low[a - 1].isalnum()) and (b + 1 == len(low) or not low[b + 1].isalnum())]
    if not hits:
        return False
    rest, at = [], 0
    for m in re.finditer(r"[^.!?]+(?:[.!?]+|$)", low):
        if not any(m.start() <= a < m.end() for a, _ in hits):
            rest.append(answer[m.start() : m.end()].strip())
        at = m.end()
    for s in rest:
        words = _WORD.findall(s)
        if any(w[0].isupper() for w in words[1:] if w != "I" and not w.startswith("I'")) or any(c.isdigit() for c in s):
            return False
    declining = " ".join(low[m.start() : m.end()] for m in re.finditer(r"[^.!?]+(?:[.!?]+|$)", low) if any(m.start() <= a < m.end() for a, _ in hits))
    return not re.search(r"\d|\bbut (?:the|it was|he|she|they|in)\b", declining) and len(declining) < 250


def _open_end(answer: str) -> bool:
    """Whether a quotation, bracket or citation is open at the end."""
    stack: list[str] = []
    straight = False
    for c in answer:
        if c in "([{“«「":
            stack.append(c)
        elif c == "„":
            stack.append("“")
        elif c in _PAIRS or c == "“":
            if stack and (stack[-1] == _PAIRS.get(c) or stack[-1] == "“"):
                stack.pop()
        elif c == '"':
            straight = not straight
    return bool(stack) or straight


def _slip(a: str, b: str) -> bool:
    """Whether two words differ in one stretch of at most two letters."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return i + j > 0 and max(len(a), len(b)) - i - j <= 2


def defect(question: str | None, answer: str | None, ends: dict[str, tuple[int, int]], votes: dict[str, set[str]], phrases: ahocorasick.Automaton) -> str | None:
    """The defect of one pair, or None. ``ends``: for a word, how often it stands within answers and how often before an end mark."""
    if answer is None:
        return "empty"
    content = _content(answer)
    bare = content.casefold().strip("()[]<>{}\"'“”.,:;-–—_*# ")
    if not any(c.isalnum() for c in content) and "[" not in content or bare in PLACEHOLDERS:
        return "empty"
    if _declines(answer, phrases):
        return "refusal"
    asked, said = _words(question or ""), _words(content)
    if asked and said:
        copied = Suffixes(asked).copied(said)
        given_back = Suffixes(said).copied(asked)
        of_asked, of_said = set(asked), set(said)
        missing = [w for w in asked if w not in of_said]
        # what the answer has of its own must be a preface, or a slip of one of the question's words, or it may tell something
        strange = [w for w in said if w not in of_asked]
        slips = [w for w in strange if not w[0].isdigit() and any(_slip(w, m) for m in missing)]
        if len(said) <= len(asked) + 2 and len(said) >= 0.6 * len(asked) and len(said) - copied <= max(1, 0.3 * len(said)) and len(strange) == len(slips) <= 2:
            return "copies_question"
        if not strange and len(said) > len(asked) and copied >= 0.7 * len(said):
            return "copies_question"  # more than once
        if given_back >= 0.75 * len(asked) and len(asked) > 2 and sum(w not in PREFACES and w not in slips for w in strange) == 0 and len(slips) <= 2 and copied >= 0.6 * len(said):
            return "copies_question"  # behind a preface
    plain = _QUOTED.sub(" ", content)
    of_question, n = _language(question or "", votes)
    of_answer, m = _language(plain, votes)
    if n and not of_answer & of_question:
        own = max((sum(w in votes[k] for w in _words(plain)) for k in of_question if k in votes), default=0)
        if "other script" in of_answer or (m >= 2 and own * 2 < m) or (m and not own and len(said) >= 6):
            return "other_language"
    tail = answer.rstrip()
    if _open_end(tail):
        return "truncated"
    if _STOP.search(tail) or _CITED.search(tail[-40:]) and tail.endswith(("]", "】")):
        return None
    if tail[-1] in ",;:-–—(/&":
        return "truncated"
    written = _WORD.findall(content)
    if written and not written[-1][0].isdigit():
        last, low = written[-1], said[-1]
        within, before_end = ends.get(last, (0, 0))
        if within + before_end == 0:
            return "truncated"  # no word: the beginning of one
        name = last[0].isupper() and low not in _SMALL
        if not name and (len(said) > 3 or low in _SMALL) and within >= 8 and before_end <= 0.002 * within:
            return "truncated"  # a word that never ends a sentence
    return None


def _endings(pairs: DataFrame) -> DataFrame:
    """(word, within, before_end): counts over all answers and questions, without the last word of a text that has no end mark."""
    # (words as they are written: "Lo" within a name's beginning is not "lo")
    texts = pairs.select(F.explode(F.array("answer", "question")).alias("text")).filter("text is not null")
    pieces = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*[^\p{L}\p{N}]*)"))).alias("piece"))
    word = F.regexp_extract("piece", r"^([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*)", 1)
    mark = F.regexp_extract("piece", r"([^\p{L}\p{N}]*)$", 1)
    return pieces.select(word.alias("word"), mark.rlike("[.!?…]").alias("stop"), mark.alias("mark")).filter("mark <> ''").groupBy("word").agg(F.sum((~F.col("stop")).cast("long")).alias("within"), F.sum(F.col("stop").cast("long")).alias("before_end"))


def defects(pairs: DataFrame, key: str = "result_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(key, defect): one row per defective pair: empty, refusal, copies_question, other_language or truncated, the first that holds.

    A null answer is empty; without a question only empty, refusing and truncated answers are told. A repeated id gives one row
    per different defect. Very long texts are read whole. Other columns are not read.
    """
    rows = pairs.select(F.col(key).cast("long").alias("key"), F.col(question).alias("question"), F.col(answer).alias("answer")).filter("key is not null")
    # only the words that answers without an end mark end in are looked up; each is joined to its row
    last = F.regexp_extract("answer", r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*)[^\p{L}\p{N}]*$", 1)
    rows = rows.withColumn("word", last).join(_endings(rows), "word", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes, phrases = _votes(), _automaton()
        for x in batches:
            cols = (x.column(c).to_pylist() for c in ("key", "question", "answer", "word", "within", "before_end"))
            found = [(k, defect(q, a, {w or "": (i or 0, e or 0)}, votes, phrases)) for k, q, a, w, i, e in zip(*cols, strict=True)]
            found = [f for f in found if f[1]]
            if found:
                k, d = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, pa.string())], [key, "defect"])

    return rows.mapInArrow(run, f"`{key}` long, defect string").distinct()
