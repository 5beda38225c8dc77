"""Sentences of texts in any language and script, by a hidden-event n-gram language model.

Between the words of a paragraph stand slots at which the hidden event "a sentence ends here" may
occur: behind end marks (with what closes behind them), in scripts that use none at spaces, and, as marks
get lost, at spaces before words in capitals that open sentences far more often than they stand within them and at spaces
inside scripts that write none. The model gives the probability of the event after the word and mark before the slot,
P(end | left), and of the word behind it after the event and without it, P(right | end) and P(right |
none). It is trained without annotated text: a paragraph's end is certainly a sentence's end
and its beginning a sentence's beginning, so the share of occurrences of "left" that stand
at the end of a paragraph, measured against the share of sentence ends that do (re-estimated in turn),
gives P(end | left); abbreviations never stand there. Whether an event belongs to a slot is
decided by its posterior from a forward-backward pass over the slots of the paragraph, in which two
events closer together than a sentence can be are unlikely.

Slots within quotation marks and brackets are none: what is quoted or bracketed doesn't divide a
sentence. Paragraphs (blank lines) always end one, a single line break doesn't.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No bound any more: the model is fitted on every document. Kept for those that import it.
FIT_DOCS = 8000
#: Log odds against the end of a sentence where its mark is missing.
UNMARKED = 5.0
#: Counts of a word's class that are added to its own.
BACK_OFF = 12

_PARAGRAPH = re.compile(r"\S[^\n]*(?:\n(?![^\S\n]*\n)[^\n]*)*")
_SPAN = re.compile(r"\"[^\"]*\"|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「[^」]*」|『[^』]*』|\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|(?<!\w)'[^']*?[.!?,]'(?!\w)|(?<!\w)‘[^‘’]*?’(?!\w)")
_OPENS_SPAN = re.compile(r"[\"“„«「『(（\['‘]")
_END = "[.!?…。！？．।॥؟۔]"
# without the space that may stand before it: a pattern that begins with a set of characters is looked for fast
_SLOT = re.compile(rf"{_END}(?:\s?{_END})*")
_WORD = re.compile(r"\w[\ẁ-ͯऀ-ॿ฀-๿]*")
#: What may stand within a word only, and an opening mark right before one.
_TAIL = re.compile(r"[\ẁ-ͯऀ-ॿ฀-๿]")
_OPENED = re.compile(r"[\"“„«「¿¡(](?=\w)")
_CLOSE = frozenset("\"”“»」』)）]'’")
_OPEN = "\"“„«「『(（['‘¿¡—–-"
_APART = re.compile(rf"[\s{_OPEN}]")
_NO_SPACE = re.compile(r"[฀-๿຀-໿က-႟ក-៿]")
_TOGETHER = re.compile(r"[\d฀-๿຀-໿က-႟ក-៿]")
_SPACES = re.compile(r"(?<=\S)\s+(?=\S)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_JOINED = re.compile(r"[^\s.,_/@\d]*[.,_/@\d]+[^\s.,!?;:]")
#: The beginning of a left side without an end mark.
_NO_MARK = "~"
# After a space: behind a small letter or a digit, before a word; and spaces between characters of scripts without them.
_BEHIND, _WITHIN = r"(?<=[a-z0-9ß-öø-ÿа-яёα-ωά-ώ]\s)\s*", r"(?<=[ \u3000])(?<=[\u3041-\u30ff\u3400-\u9fff].)[ \u3000]*(?=[\u3041-\u30ff\u3400-\u9fff])"
_DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")


def _right(text: str, at: int) -> str:
    """The word at or soon after ``at``: digits as #, two characters of scripts without spaces between words."""
    m = _WORD.search(text, at, at + 60)
    if not m or m.start() > at + 6:
        return ""
    return _token(m.group())


def _token(word: str) -> str:
    """A word as it is counted."""
    if word[0].isdigit():
        return "#"
    return word[:1] if word[0] >= "぀" and _CJK.match(word) else word[:24]


def _shape(word: str) -> str:
    if not word:
        return "none"
    c = word[0]
    return "digit" if c == "#" else "upper" if c.isupper() else "lower" if c.islower() else "plain"


def _left(text: str, low: int, at: int) -> str:
    """What stands before ``at``, up to a space or an opening mark, lower-cased but for single letters, digits as #."""
    return _said(_APART.split(text[max(low, at - 20) : at])[-1])


@lru_cache(maxsize=1 << 16)
def _said(chunk: str) -> str:
    if _CJK.search(chunk):
        return "cjk"
    return _DIGITS.sub("#", chunk if len(chunk) == 1 else chunk.lower())


def _kind(left: str) -> str:
    """The class of a left side, for words that are seen too rarely."""
    mark, word = left[:1], left[1:]
    if mark != ".":
        return mark + ("#" if word == "#" else "w")
    if word == "#":
        return ".#"
    if len(word) <= 1 or "." in word:
        return ".1"
    return ".s" if len(word) <= 3 else ".w"


def _spans(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """What _SPAN finds one after the other; it is tried only where one of its marks stands."""
    found, done = [], low
    for o in _OPENS_SPAN.finditer(text, low, high):
        if o.start() >= done and (m := _SPAN.match(text, o.start(), high)):
            done = m.end()
            found.append((m.start(), done))
    return found


def slots(text: str, low: int, high: int, bare: re.Pattern | None = None) -> list[tuple[int, int, str, str]]:
    """(end, next, left, right) of the slots of the paragraph text[low:high]: where a sentence would end and the next begin.

    With ``bare`` also those that it finds, where an end mark may be missing: before words in capitals that open sentences, and at
    spaces within scripts that have none.
    """
    found = []
    spans = _spans(text, low, high)
    k = 0
    for m in _SLOT.finditer(text, low, high):
        at, end = m.span()
        if at > low and text[at - 1].isspace():
            at -= 1
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        mark = text[end - 1]
        opener = ""
        if k < len(spans) and spans[k][0] <= at:
            begin, close = spans[k]
            if text[end:close].strip().strip("\"”“»」』)）]'’"):
                continue  # within quotation marks or brackets
            end = close
            before = text[max(low, begin - 3) : begin].rstrip()
            opener = "s" if begin == low or not before or re.match(_END, before[-1]) else "c" if before[-1] in ":,：，،" else "o"
        else:
            while end < high and text[end] in _CLOSE and (end + 1 == high or not text[end + 1].isalnum()):
                end += 1
        nxt = end
        while nxt < high and text[nxt].isspace():
            nxt += 1
        if nxt < high and nxt == end and mark in ".!?…" and not opener:
            # no space: a decimal, an abbreviation with inner stops, an address, or a lost space
            if not text[nxt].isalnum() or (text[at - 1 : at].isdigit() and text[nxt].isdigit()) or mark == "." and text[nxt].isalpha() and at - low < 2:
                if text[nxt] not in _OPEN:
                    continue
            if text[nxt].islower() and (_JOINED.match(text, nxt) or any(c in "._/@" for c in _left(text, low, at))):
                continue  # within a file's name or an address
        if opener:
            left = "q" + text[end - 1] + opener
        else:
            mark = "." if mark in "．" else mark
            if mark == "." and end - at > 2 and text[at:end].count(".") > 1:
                mark = "…"
            word = _left(text, low, at)
            # an inner stop of an abbreviation (a.b) is one with the next letter
            left = mark + ("" if mark not in ".…" else word)
            if nxt == end and nxt < high and mark == "." and len(word) <= 1:
                left = ".1~"
        found.append((end, nxt, left, "" if nxt >= high else _right(text, nxt)))
    if _NO_SPACE.search(text, low, high):  # spaces between words of such a script, or a number
        for m in _SPACES.finditer(text, low, high):
            at, nxt = m.start(), m.end()
            if _TOGETHER.match(text[at - 1]) and _TOGETHER.match(text[nxt]) and not any(a <= at < b for a, b in spans):
                found.append((at, nxt, " " + _left(text, low, at)[-12:], _right(text, nxt)))
        if _TOGETHER.match(text[high - 1]):
            found.append((high, high, " " + _left(text, low, high)[-12:], ""))
        found.sort()
    if bare is not None:
        more = []
        for m in bare.finditer(text, low, high):
            at, nxt = m.start(), m.end()
            if any(a <= at < b for a, b in spans):
                continue
            more.append((at, nxt, _NO_MARK + ("c" if text[nxt] >= "぀" else "w"), _right(text, nxt)))
        if more:
            found = sorted(found + more)
    return found


class Model:
    """P(end | left) and the log ratio of P(right | end) to P(right | none), from counts."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.left, self.all_left = Counter(), Counter()
        ends, all_ends = Counter(), Counter()
        self.first, self.inner = Counter(), Counter()
        for (what, token), n in counts.items():
            if what == "left":
                self.left[token] += n
                self.all_left[_kind(token)] += n
            elif what == "end":
                ends[token] += n
                all_ends[_kind(token)] += n
            elif what == "first":
                self.first[token] += n
            else:
                self.inner[token] += n
        self.firsts, self.inners = max(1, self.first.total()), max(1, self.inner.total())
        self.shape_first, self.shape_inner = Counter(), Counter()
        for w, n in self.first.items():
            self.shape_first[_shape(w)] += n
        for w, n in self.inner.items():
            self.shape_inner[_shape(w)] += n
        # the share of sentence ends that are ends of paragraphs, per group of marks: most words that stand before
        # a mark always end a sentence there, so it is the middle of what these words show
        self.share = {}
        for group in {k[:1] for k in self.all_left}:
            shown = sorted((ends[t] / n, n) for t, n in self.left.items() if t[:1] == group and ends[t])
            half, share = sum(n for _, n in shown) / 2, 0.3
            for value, n in shown:
                share, half = value, half - n
                if half <= 0:
                    break
            self.share[group] = min(1.0, max(0.02, share))
        self.p_end = {t: self._p(ends[t], n, t, all_ends) for t, n in self.left.items()}
        self.p_kind = {k: min(0.98, max(0.002, all_ends[k] / (self.share[k[:1]] * n))) for k, n in self.all_left.items()}
        self.cache: dict[tuple[str, str, bool], float] = {}
        # words that stand at beginnings so much more than within that they tell one also where no mark is
        openers = sorted(w for w, n in self.first.items() if n >= 5 and w[:1].isupper() and self._ratio(w, False) > UNMARKED)
        letters = "".join(sorted({re.escape(w[0]) for w in openers}))
        self.bare = re.compile(r"\s(?:" + (rf"(?=[\s{letters}]){_BEHIND}(?=(?:{'|'.join(map(re.escape, openers))})(?!\w))|" if openers else "") + _WITHIN + ")")

    def _p(self, ends: int, n: int, token: str, all_ends: Counter) -> float:
        kind, share = _kind(token), self.share[token[:1]]
        prior = min(0.98, all_ends[kind] / (share * self.all_left[kind]))
        return min(0.995, max(0.001, (ends + 3 * share * prior) / (share * (n + 3))))

    def _ratio(self, right: str, folded: bool) -> float:
        """log P(right | end) / P(right | none): the word's counts, with a few more shared out as those of its class are."""
        shape = _shape(right)
        first, inner = self.first[right], self.inner[right]
        if folded and right != "#":  # without capitals: words by their letters only
            first, inner = first + self.first[right.capitalize()], inner + self.inner[right.capitalize()]
            of_class = 0.2
        else:
            of_class = (self.shape_first[shape] + 0.5) / self.firsts / ((self.shape_inner[shape] + 0.5) / self.inners)
        scale = self.inners / self.firsts
        odds = of_class / scale
        value = math.log((first + BACK_OFF * odds / (1 + odds)) / (inner + BACK_OFF / (1 + odds)) * scale)
        return max(-8.0, min(8.0, value))

    def odds(self, left: str, right: str, folded: bool) -> float:
        """The log odds of the event at a slot, given its neighbours."""
        key = (left, right, folded)
        known = self.cache.get(key)
        if known is not None:
            return known
        if len(self.cache) > 500_000:
            self.cache.clear()
        if left[:1] == _NO_MARK:
            value = self.cache[key] = 3.0 if left == _NO_MARK + "c" else self._ratio(right, False) - UNMARKED
            return value
        p = self.p_end.get(left)
        if p is None:
            p = self.p_kind.get(_kind(left), 0.9 if left[:1] != " " else 0.5)
        shape = _shape(right)
        ratio = self._ratio(right, folded)
        if left[:1] == "q":
            if shape == "upper":
                p = max(p, 0.5)
            elif shape == "plain" and left[-1] == "s":
                p = min(p, 0.05)
        if shape == "lower" and not folded:
            p = min(p, 0.02)  # in writing with capitals
        if shape == "plain" and left[:1] not in "q ":
            ratio *= 0.25  # letters without case say little in writing that has its own end marks
        value = math.log(p / (1 - p)) + ratio
        if left == ".1~":
            value = -9.0
        self.cache[key] = value
        return value

    def ends(self, odds: list[float], gaps: list[int]) -> list[bool]:
        """The slots whose posterior of the event exceeds one half; gaps: characters since the slot (or start) before."""
        n = len(odds)
        if all(abs(o) > 5 for o in odds) and all(g > 2 for g in gaps):
            return [o > 0 for o in odds]
        near = [0.02 if g <= 2 else 0.6 if g <= 6 else 1.0 for g in gaps]
        one = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
        forward, a0, a1 = [], 1.0, 0.0
        for t in range(n):
            b1 = one[t] * (a0 + a1 * near[t])
            b0 = (1 - one[t]) * (a0 + a1)
            s = b0 + b1
            a0, a1 = b0 / s, b1 / s
            forward.append((a0, a1))
        z0 = z1 = 1.0
        found = [False] * n
        for t in range(n - 1, -1, -1):
            a0, a1 = forward[t]
            found[t] = a1 * z1 > a0 * z0
            y0 = one[t] * z1 + (1 - one[t]) * z0
            y1 = one[t] * near[t] * z1 + (1 - one[t]) * z0
            s = y0 + y1
            z0, z1 = y0 / s, y1 / s
        return found


def divide(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in code points."""
    out = []
    for m in _PARAGRAPH.finditer(text):
        low, high = m.start(), m.end()
        while high > low and text[high - 1].isspace():
            high -= 1
        here = [s for s in slots(text, low, high, model.bare) if s[1] < high]
        if here:
            folded = _folded(text[low:high])
            # a piece without capitals may stand in a paragraph that has some
            odds = [model.odds(left, right, folded or (right[:1].islower() and text[nxt : nxt + 40].islower() and nxt + 20 < high)) for _, nxt, left, right in here]
            gaps = [here[0][0] - low] + [b[0] - a[0] for a, b in zip(here, here[1:], strict=False)]
            for (end, nxt, _, _), yes in zip(here, model.ends(odds, gaps), strict=True):
                if yes and end > low:
                    out.append((low, end))
                    low = nxt
        if high > low:
            out.append((low, high))
    return out


def _folded(piece: str) -> bool:
    """Whether a piece in writing with capitals has none."""
    return piece == piece.lower() and piece != piece.upper()


def _count(texts: Iterator[str]) -> Counter:
    """What the model is estimated from: left sides and those at paragraph ends, words that begin paragraphs and words within."""
    counts: Counter = Counter()
    within: Counter = Counter()
    said: Counter = Counter()  # words as they stand, those that aren't within taken off again
    for text in texts:
        for m in _PARAGRAPH.finditer(text):
            low, high = m.start(), m.end()
            while high > low and text[high - 1].isspace():
                high -= 1
            here = slots(text, low, high)
            if not here:
                continue
            counts["first", _right(text, low)] += 1
            folded = _folded(text[low:high])
            for _, nxt, left, right in here:
                if _shape(right) == "lower" and not folded:
                    continue  # in writing with capitals no sentence begins there, which says nothing of what can end one
                counts["left", left] += 1
                if nxt >= high:
                    counts["end", left] += 1
            behind = {nxt for _, nxt, _, _ in here}
            spaced = any(left[:1] == " " for _, _, left, _ in here)
            if spaced or any(end == nxt < high and _TAIL.match(text[nxt - 1]) for end, nxt, _, _ in here):
                words = islice(_WORD.finditer(text, low, high), 1, None)
                if spaced:
                    words = (w for w in words if not text[w.start() - 1].isspace())
                within.update([_token(w.group()) for w in words if w.start() not in behind and text[w.start() - 1] not in "\"“„«「¿¡("])
            elif first := _WORD.search(text, low, high):
                said.update(_WORD.findall(text, low, high))
                out = {first.start(), *behind, *(m.end() for m in _OPENED.finditer(text, low, high))}
                said.subtract([w.group() for at in out if (w := _WORD.match(text, at, high))])
            if spaced:  # scripts that write words together: what stands behind a digit is within
                for _, _, left, right in here:
                    if right == "#" or left.endswith("#"):
                        within[right] += 1
    for word, n in said.items():
        if n:
            within[_token(word)] += n
    counts.update({("inner", word): n for word, n in within.items()})
    return counts


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model, from all documents, whatever their number; the counting runs on the cluster. The driver gets one row per different token."""
    texts = docs.select(F.col(text).alias("text")).filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for x in batches:
            counts.update(_count(t for t in x.column("text").to_pylist() if t))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())], ["what", "token", "n"])

    rows = texts.mapInArrow(count, "what string, token string, n long").groupBy("what", "token").agg(F.sum("n").alias("n")).collect()
    return Model({(r.what, r.token): r.n for r in rows})


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, start_char, end_char): one row per sentence, offsets in code points from 0, closing marks included.

    Null, empty and blank texts give no rows; a text without a slot is one sentence per paragraph. Texts of
    any length are divided whole. A repeated id gives the rows of each of its texts. Other columns are not read.
    """
    model = fit(docs, key, text) if model is None else model
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for x in batches:
            ids, starts, stops = [], [], []
            for i, t in zip(x.column("key").to_pylist(), x.column("text").to_pylist(), strict=True):
                for a, b in divide(t, m):
                    ids.append(i)
                    starts.append(a)
                    stops.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, starts, stops)], [key, "start_char", "end_char"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    return rows.mapInArrow(run, f"`{key}` long, start_char long, end_char long")
