"""Repair of text from scanned pages: running lines, page numbers, broken words, misread characters.

Words are counted over all pages; a rare word is joined with frequent ones by anagram hashes: the hash of
a word is the sum of the fifth powers of its characters, so that a confusion of characters always changes
it by the same amount, whatever the word. A rare word's hash plus the differences of one or two confusions is
equi-joined with the hashes of the frequent words, checked letter by letter, and the most frequent
candidate with the fewest confusions is taken.

A line at a page's edge that comes again on other pages of the file (in any misreading, without its page
number) is a running line; one that holds a number in step with the pages is a page number. A word broken at
a line's end is joined with or without its hyphen, as it is written elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from archivolt.plans.session import cut

# What is read -> what is meant.
CONFUSIONS = [
    ("c", "e"), ("1", "i"), ("0", "o"), ("1", "l"), ("ri", "n"), ("cl", "d"), ("ſ", "s"), ("5", "s"), ("ii", "u"), ("b", "h"),
    ("9", "g"), ("rn", "m"), ("6", "b"), ("vv", "w"), ("h", "li"), ("8", "B"), ("0", "O"), ("1", "I"), ("5", "S"), ("l", "I"), ("m", "rn"), ("d", "cl"), ("@", "a"), ("+", "t"), ("|", "l"),
]
# Characters that are read for letters, within words and at their ends.
ODD = "@+|"
# Letters read for digits, and the digits.
LETTERS, DIGITS = "lIOSBoiZ|", "110580121"
#: Code points are taken modulo this, so that no sum gets too large; what falls together is told apart letter by letter.
MODULUS = 1021
HYPHENS = "-‐¬­"
#: How much more frequent a word must be than what is taken for its misreading.
RATIO = 5
#: Lines at either end of a page that may be running lines or page numbers.
EDGE = 2
_ROMAN = "^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def anagram(word: str) -> Column:
    """The anagram hash of a column of words of any script."""
    return F.expr(f"aggregate(transform(split({word}, ''), c -> cast(pow(ascii(c) % {MODULUS}, 5) AS bigint)), 0L, (a, x) -> a + x)")


def _value(text: str) -> int:
    return sum((ord(c) % MODULUS) ** 5 for c in text)


def _bare(word: str) -> Column:
    """A word without the marks around it; marks that stand for letters stay, if there are letters."""
    bare = F.regexp_replace(word, rf"^[^\p{{L}}\p{{N}}{ODD}]+|[^\p{{L}}\p{{N}}{ODD}]+$", "")
    return F.when(bare.rlike(r"[\p{L}\p{N}]"), bare).otherwise("")


def _filed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``file``, a hash of what they belong together by (document and path; a page without either is by itself), and ``title``, what the file's name says."""
    # several documents may have files of one path
    owner = F.col("document_id") if "document_id" in pages.columns else F.lit(None).cast("string")
    alone = F.when(owner.isNull() & F.col("file_path").isNull(), F.col("page_id").cast("string"))
    title = F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.coalesce("file_path", F.lit("")), "/"), -1), r"\..*$", ""), "_", " ")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64(F.coalesce("file_path", F.lit("")), F.coalesce(owner, F.lit("")), F.coalesce(alone, F.lit(""))).alias("file"), _skeleton(title).alias("title"), F.coalesce("page_number", F.lit(0)).alias("page"), "text").filter("page_id is not null and text is not null")


def _lines(pages: DataFrame) -> DataFrame:
    """(page_id, file, page, line_no, line, top, bottom): all lines; top and bottom count the non-blank ones from either end."""
    rows = pages.withColumn("lines", F.split("text", "\n"))
    full = F.expr("filter(sequence(0, size(lines) - 1), i -> trim(regexp_replace(lines[i], '[\\\\s\\\\u00a0]+', ' ')) <> '')")
    rows = rows.withColumn("full", full).select("page_id", "file", "page", "full", F.posexplode("lines").alias("at", "line"))
    place = F.array_position("full", F.col("at")).cast("int")
    return rows.select("page_id", "file", "page", (F.col("at") + 1).alias("line_no"), "line", place.alias("top"), F.when(place > 0, F.size("full") - place + 1).otherwise(0).alias("bottom"))


def _skeleton(line: Column) -> Column:
    """A line's letters with confusable ones made equal, without a page number at either end."""
    x = F.regexp_replace(line, r"^[^\p{L}\p{N}]*[0-9lIOSB]*[0-9][0-9lIOSB]*[^\p{L}\p{N}]+|[^\p{L}\p{N}]+[0-9lIOSB]*[0-9][0-9lIOSB]*[^\p{L}\p{N}]*$", "")
    x = F.regexp_replace(F.translate(F.lower(x), ODD, "atl"), r"[^\p{L}\p{N}]", "")
    for wrong, right in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("li", "h")):
        x = F.replace(x, F.lit(wrong), F.lit(right))
    return F.translate(x, "10596ecbſi8", "loSgbcchslb")


def edges(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(page_id, line_no, kind): the running lines and page numbers. ``files`` has (file, title), the skeleton of what a file's name says."""
    edge = lines.filter(f"(top between 1 and {EDGE} or bottom between 1 and {EDGE}) and length(line) < 200").withColumn("side", F.when(F.col("top").between(1, EDGE), 1).otherwise(2))
    edge = edge.withColumn("bare", F.trim(F.regexp_replace("line", r"[^\p{L}\p{N}]+", " ")))
    # page numbers: in step with the pages of the file
    # "Page" and the like may stand before it
    edge = cut(edge)
    edge = edge.withColumn("said", F.regexp_extract("bare", r"^(\p{L}{1,6}) \S+$", 1)).withColumn("bare", F.regexp_replace("bare", r"^\p{L}{1,6} (?=\S+$)", ""))
    number = edge.filter(r"""bare rlike '^(\\p{L}|\\p{N}){1,9}$' and (said = '' or bare rlike '[0-9]') and not line rlike '[.,;:!?"]\\s*$' and (translate(bare, 'lIOSBoiZ|', '110580121') rlike '^[0-9]{1,5}$' or lower(bare) rlike '%s')""" % _ROMAN)
    roman = F.lower("bare")
    worth = {"m": 1000, "d": 500, "c": 100, "l": 50, "x": 10, "v": 5, "i": 1}
    total = sum((v * F.regexp_count(roman, F.lit(k)) for k, v in worth.items()), F.lit(0))
    for pair, less in (("cm", 200), ("cd", 200), ("xc", 20), ("xl", 20), ("ix", 2), ("iv", 2)):
        total = total - F.when(roman.contains(pair), less).otherwise(0)
    digits = F.translate("bare", LETTERS, DIGITS).try_cast("int")
    read = F.array_distinct(F.filter(F.array(F.when(F.col("bare").rlike("[0-9]") | ~roman.rlike(_ROMAN), digits), F.when(roman.rlike(_ROMAN), total), F.when(~F.col("bare").rlike(f"[^0-9{LETTERS}]"), digits)), lambda x: x.isNotNull()))
    number = number.select("page_id", "file", "page", "line_no", "line", "bare", "said", F.explode(read).alias("n")).withColumn("step", F.col("n") - F.col("page"))
    steps = number.groupBy("file", "step").agg(F.count_distinct("page").alias("pages")).groupBy("file").agg(F.max(F.struct("pages", "step")).alias("m"))
    decorated = F.trim("line").rlike(r"^[^\p{L}\p{N}\s]+\s*\S+\s*[^\p{L}\p{N}\s]+$")
    numbered = number.join(steps, "file").filter((F.col("step") == F.col("m.step")) & (F.col("m.pages") > 1) | decorated | ((F.col("m.pages") == 1) & F.col("bare").rlike("[0-9]") & (F.levenshtein(F.lower("said"), F.lit("page")).isin(0, 1, 4)))).select("page_id", "line_no").distinct()
    numbered = cut(numbered)
    # running lines: again on another page of the file
    rest = edge.withColumn("skeleton", _skeleton(F.col("line"))).filter("length(skeleton) >= 6").join(numbered, ["page_id", "line_no"], "left_anti")
    rest = cut(rest.select("page_id", "file", "page", "line_no", "line", "side", "top", "skeleton"))
    again = rest.groupBy("file", "side", "skeleton").agg(F.count_distinct("page").alias("pages")).filter("pages > 1").select("file", "side", F.col("skeleton").alias("known"))
    named = files.filter("length(title) > 0").select("file", F.explode(F.array(F.lit(1), F.lit(2))).alias("side"), F.col("title").alias("known"))
    known = again.withColumn("from", F.lit(0)).unionByName(named.withColumn("from", F.lit(2))).distinct()
    # of the skeletons of a file, each once
    most = F.greatest(F.lit(1), F.floor(F.length("known") * 0.2)).cast("int")
    different = rest.groupBy("file", "side", "skeleton").agg(F.max("page").alias("last"))
    close = (F.col("last") >= F.col("from")) & (F.abs(F.length("skeleton") - F.length("known")) <= most)
    alike = different.join(known, ["file", "side"]).filter(close).filter(F.levenshtein("skeleton", "known") <= most).groupBy("file", "side", "skeleton").agg(F.min("from").alias("from"))
    first = cut(rest.join(alike, ["file", "side", "skeleton"]).filter("page >= from").select("page_id", "line_no", "file", "page", "side").distinct())
    # the other of two alternating titles may stand on one page only: written like a title, above the text, while all running lines
    # that are known there stand on pages of the other side of the leaf
    capital = F.col("line").rlike(r"\p{Lu}+\s+.*\p{Lu}") & ~F.col("line").rlike(r"\p{Ll}{2}")
    leaves = first.filter("side = 1").groupBy("file").agg(F.min(F.col("page") % 2).alias("low"), F.max(F.col("page") % 2).alias("high"))
    lone = rest.filter(capital & (F.col("top") == 1) & (F.col("page") > 1)).join(leaves, "file").filter("low = high and low <> page % 2").select("page_id", "line_no")
    first = first.select("page_id", "line_no")
    # a number set off from a title by a gap
    spaced = rest.filter(F.col("line").rlike(rf"^[\[(]?[0-9{LETTERS}]{{1,4}}[\])]?\s{{2,}}\p{{Lu}}.*[^.,;:!?\s]$|^\p{{Lu}}.*[^.,;:!?\s]\s{{2,}}[\[(]?[0-9{LETTERS}]{{1,4}}[\])]?\s*$") & F.col("line").rlike("[0-9]")).select("page_id", "line_no")
    running = first.unionByName(lone).unionByName(spaced).distinct()
    return running.withColumn("kind", F.lit("running_line")).unionByName(numbered.join(running, ["page_id", "line_no"], "left_anti").withColumn("kind", F.lit("page_number")))


def corrections(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, right): what words of ``asked`` (word, n) are misreadings of, among the frequent ``words`` (word, n)."""
    changes = []
    for i, (x, y) in enumerate(CONFUSIONS):
        changes.append((x, y, "", "", _value(y) - _value(x)))
        changes += [(x, y, u, v, _value(y) - _value(x) + _value(v) - _value(u)) for u, v in CONFUSIONS[i:]]
    # a fixed list of values in the plan, not a table to be joined
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xyuvg", c, strict=True)]) for c in changes])
    rare = asked.filter("length(word) >= 2 and not word rlike '^[0-9.,-]+$'").withColumn("hash", anagram("word"))
    fits = F.filter(table, lambda c: F.contains(F.col("word"), c.x) & F.contains(F.col("word"), c.u))
    tried = rare.withColumn("c", F.explode(fits)).select("word", "n", "c.x", "c.y", "c.u", "c.v", (F.col("hash") + F.col("c.g")).alias("hash"))
    frequent = words.filter("length(word) >= 2 and not word rlike '[0-9]'").select(F.col("word").alias("right"), F.col("n").alias("m"), anagram("word").alias("hash"))
    met = tried.join(frequent, "hash").filter(F.expr(f"m >= {RATIO} * n and m > 1 and word <> right"))
    once = "transform(filter(sequence(1, length(word)), i -> substring(word, i, length(x)) = x), i -> concat(substring(word, 1, i - 1), y, substring(word, i + length(x))))"
    twice = f"exists({once}, w -> exists(sequence(1, length(w)), i -> substring(w, i, length(u)) = u and concat(substring(w, 1, i - 1), v, substring(w, i + length(u))) = right))"
    met = met.filter(F.expr(f"case when u = '' then array_contains({once}, right) else {twice} end"))
    steps = F.when(F.col("u") == "", 1).otherwise(2)
    return met.groupBy("word").agg(F.max_by("right", F.struct(-steps, "m", "right")).alias("right"))


def _numbers(word: str) -> Column:
    """A number with letters read for digits as digits, else null."""
    n = F.translate(word, LETTERS, DIGITS)
    return F.when(F.col(word).rlike(r"^[0-9lIOSB|.,:\-]+$") & F.col(word).rlike("[0-9]") & F.col(word).rlike("[lIOSB|]") & ~F.col(word).rlike("^[lIOSB]-"), n)


class Scans:
    """The findings on a table of pages; each part is a DataFrame."""

    def __init__(self, pages: DataFrame, marks: bool = False):
        """With ``marks`` the words are kept with the marks around them as well."""
        scanned = F.coalesce(F.col("format").contains("scan"), F.lit(False))
        filed = _filed(pages.filter(scanned))
        lines = cut(_lines(filed))
        self.edges = cut(edges(lines, filed.select("file", "title").distinct()))
        body = cut(lines.join(self.edges, ["page_id", "line_no"], "left_anti").filter("top > 0").drop("top", "bottom"))
        tokens = body.select("page_id", "line_no", F.posexplode(F.split(F.trim(F.regexp_replace("line", r"[\s ]+", " ")), " ")).alias("at", "token"))
        tokens = tokens.withColumn("word", _bare("token"))
        if not marks:
            tokens = tokens.drop("token")
        # the lines' ends that break a word, and what follows them
        ends = body.select("page_id", "file", "page", "line_no", F.rtrim("line").alias("line"))
        by = Window.partitionBy("page_id").orderBy("line_no")
        ends = ends.withColumn("next_no", F.lead("line_no").over(by)).withColumn("next", F.lead("line").over(by)).withColumn("first", F.row_number().over(by) == 1)
        heads = ends.filter("first").groupBy("file", F.col("page").alias("page")).agg(F.min(F.struct("page_id", "line_no", "line")).alias("h"))
        left = F.regexp_extract("line", rf"((?:[\p{{L}}\p{{N}}{ODD}'’]+[-‐])*[\p{{L}}\p{{N}}{ODD}]+)[{HYPHENS}]$", 1)
        broken = ends.withColumn("left", left).filter("left rlike '\\\\p{L}'")
        over = broken.filter("next is null").drop("next").join(heads.select("file", (F.col("page") - 1).alias("page"), F.col("h.line").alias("next")), ["file", "page"])
        broken = broken.filter("next is not null").select("page_id", "file", "page", "line_no", "next_no", "left", "next", F.lit(False).alias("over")).unionByName(over.select("page_id", "file", "page", "line_no", "next_no", "left", "next", F.lit(True).alias("over")))
        right = F.regexp_extract(F.ltrim("next"), rf"^[^\p{{L}}\p{{N}}\s{ODD}]*([\p{{L}}\p{{N}}{ODD}]+(?:[-'’‐][\p{{L}}\p{{N}}{ODD}]+)*)", 1)
        broken = broken.withColumn("right", right).filter("right rlike '\\\\p{L}'").drop("next")
        broken = cut(broken.withColumn("joined", F.concat("left", "right")).withColumn("hyphened", F.concat("left", F.lit("-"), "right")))
        # halves are no words of their own
        halves = broken.select("page_id", "line_no", F.lit(-1).alias("side")).unionByName(broken.filter("next_no is not null").select("page_id", F.col("next_no").alias("line_no"), F.lit(0).alias("side")))
        follow = broken.filter("over").select("file", (F.col("page") + 1).alias("page")).distinct().join(ends.filter("first").select("file", "page", "page_id", "line_no"), ["file", "page"]).select("page_id", "line_no", F.lit(0).alias("side"))
        halves = halves.unionByName(follow).groupBy("page_id", "line_no").agg(F.max(F.col("side") == 0).alias("starts"), F.max(F.col("side") == -1).alias("breaks"))
        last = F.max("at").over(Window.partitionBy("page_id", "line_no"))
        tokens = tokens.withColumn("last", last).join(halves, ["page_id", "line_no"], "left")
        self.tokens = cut(tokens.withColumn("half", F.coalesce((F.col("starts") & (F.col("at") == 0)) | (F.col("breaks") & (F.col("at") == F.col("last"))), F.lit(False))).drop("starts", "breaks"))
        native = pages.filter(~scanned & F.col("text").isNotNull()).select(F.explode(F.split("text", r"[\s ]+")).alias("token")).select(_bare("token").alias("word"))
        seen = self.tokens.filter("not half").select("word").unionByName(native).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
        seen = cut(seen)
        wanted = broken.select(F.explode(F.array("joined", "hyphened")).alias("word")).distinct().join(seen, "word", "left_anti").select("word", F.lit(0).cast("long").alias("n"))
        self.fixes = cut(corrections(seen, seen.unionByName(wanted)))
        # hyphen evidence: how often either form is written elsewhere, in any case
        heard = seen.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
        broken = broken.withColumn("j", F.lower("joined")).withColumn("h", F.lower("hyphened"))
        broken = broken.join(heard.select(F.col("word").alias("j"), F.col("n").alias("nj")), "j", "left").join(heard.select(F.col("word").alias("h"), F.col("n").alias("nh")), "h", "left")
        broken = broken.join(self.fixes.select(F.col("word").alias("joined"), F.col("right").alias("fj")), "joined", "left").join(self.fixes.select(F.col("word").alias("hyphened"), F.col("right").alias("fh")), "hyphened", "left")
        nj, nh = F.coalesce("nj", F.lit(0)), F.coalesce("nh", F.lit(0))
        word = F.when((nh > nj) & F.col("fh").isNotNull(), F.col("fh")).when(nh > nj, F.col("hyphened")).when(F.col("fj").isNotNull(), F.col("fj")).when(nj > 0, F.col("joined")).when(F.col("fh").isNotNull(), F.col("fh")).otherwise(F.col("joined"))
        self.broken = broken.select("page_id", "file", "page", "line_no", "next_no", "over", word.alias("word"))

    def misread(self) -> DataFrame:
        """(page_id, line_no, at, word): the misread words with their right form."""
        rows = self.tokens.filter("not half and word <> ''").select("page_id", "line_no", "at", "word").withColumn("number", _numbers("word"))
        rows = rows.join(self.fixes, "word", "left")
        return rows.withColumn("right", F.coalesce("number", "right")).filter("right is not null and right <> word").select("page_id", "line_no", "at", F.col("right").alias("word"))


def noise(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, kind, word): what is wrong on the scanned pages.

    Only pages whose format says that they are scans are looked at. Null and empty texts have no lines. A page extracted
    twice gives its rows under each page_id; equal rows count once. Pages belong together by document_id (if there is one) and file_path;
    a page with neither is a file by itself.
    """
    s = Scans(pages)
    found = s.edges.select("page_id", F.col("line_no").cast("int").alias("line_no"), "kind", F.lit("").alias("word"))
    found = found.unionByName(s.broken.select("page_id", F.col("line_no").cast("int").alias("line_no"), F.lit("broken_word").alias("kind"), "word"))
    return found.unionByName(s.misread().select("page_id", F.col("line_no").cast("int").alias("line_no"), F.lit("misread").alias("kind"), "word")).distinct()


def repaired(pages: DataFrame) -> DataFrame:
    """(page_id, paragraph_no, text): the scanned pages' text in paragraphs, without edge lines, with whole and corrected words.

    Lines are joined; a word that runs on to the next page stands whole on the page where it begins. Pages without text have no rows.
    """
    s = Scans(pages, marks=True)
    right = s.misread().withColumnRenamed("word", "right")
    tokens = s.tokens.join(right, ["page_id", "line_no", "at"], "left")
    marks = F.regexp_extract("token", r"^([^\p{L}\p{N}]*)", 1), F.regexp_extract("token", r"([^\p{L}\p{N}]*)$", 1)
    whole = s.broken.select("page_id", "line_no", F.col("word").alias("whole"))
    tokens = tokens.join(whole, ["page_id", "line_no"], "left")
    ends = F.col("half") & (F.col("at") == F.col("last")) & F.col("whole").isNotNull()
    said = F.when(ends, F.concat(marks[0], "whole")).when(F.col("half"), F.regexp_replace("token", r"^[^\p{L}\p{N}]*[\p{L}\p{N}'’‐-]+", "")).when(F.col("right").isNotNull(), F.concat(marks[0], "right", marks[1])).otherwise(F.col("token"))
    lines = tokens.withColumn("said", said).groupBy("page_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x.said), " ").alias("line"))
    by = Window.partitionBy("page_id").orderBy("line_no")
    # a gap in the numbers of the kept lines is a blank line (edge lines stand at the ends): a new paragraph
    before = F.coalesce(F.lag("line_no").over(by), F.lit(0))
    lines = lines.withColumn("paragraph_no", F.sum((F.col("line_no") > before + 1).cast("int")).over(by))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), " "), " +", " "))
    numbered = lines.groupBy("page_id", "paragraph_no").agg(text.alias("text")).filter("text <> ''")
    return numbered.withColumn("paragraph_no", F.row_number().over(Window.partitionBy("page_id").orderBy("paragraph_no")))
