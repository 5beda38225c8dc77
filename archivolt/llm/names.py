"""Variant spellings of the names of people and organisations, linked through canonical rewritings.

Every name is taken apart by rules: titles and places of origin are dropped, "Last, First" and
"Form, Trade, Place" are put in order, legal forms are written out, accents, hyphens and capitals are levelled.
What a typist may have done to the parts are rewritings too: a nickname, a short form (the first letters of a
given name), initials, middle names left out, one letter too few, too many, wrong or swapped. Parts and names are exploded into
their rewritings and joined on equality. A rewriting is worth the more the rarer it is: one that
several names share decides nothing unless one of them is far more frequent than the others.

Names rewritten to one canonical form, and names standing in one row, mean one entity; entities are
the connected components.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.operators.components import connected_components
from archivolt.plans.session import cut

# Legal forms as they are written -> one way to write them. A parameter; those of the archive come first.
LEGAL_FORMS = {
    "guild": "guild", "gld": "guild", "society": "society", "soc": "society", "company": "company", "co": "company", "assembly": "assembly", "assy": "assembly", "brotherhood": "brotherhood", "bhd": "brotherhood",
    "limited": "limited", "ltd": "limited", "incorporated": "incorporated", "inc": "incorporated", "corporation": "corporation", "corp": "corporation", "association": "association", "assn": "association", "assoc": "association", "foundation": "foundation",
    "llc": "llc", "llp": "llp", "plc": "plc", "lp": "lp", "pty": "limited", "pte": "limited", "gmbh": "gmbh", "mbh": "gmbh", "ag": "ag", "kg": "kg", "kgaa": "kgaa", "ohg": "ohg", "ug": "ug", "se": "se",
    "sa": "sa", "sas": "sas", "sarl": "sarl", "sl": "sl", "slu": "sl", "srl": "srl", "spa": "spa", "snc": "snc", "bv": "bv", "nv": "nv", "oy": "oy", "oyj": "oy", "ab": "ab", "aps": "aps", "as": "as", "asa": "asa", "sro": "sro", "zoo": "zoo", "kk": "kk",
}
# Titles before a name, with their abbreviations.
TITLES = set(
    "factor fct dame mistress mstr provost prov warden wdn captain capt brother br sister sr mr mrs ms miss mx dr prof professor sir lady lord ser rev reverend father fr mother master madam madame mme mlle monsieur judge justice "
    "general gen colonel col major maj lieutenant lt sergeant sgt admiral adm hon president saint st herr frau señor senor senora sra don dona doña".split()
)
# What follows a name.
SUFFIXES = set("jr jnr junior snr senior ii iii iv esq phd md".split())
# Words that begin a family name.
PARTICLES = set("de del della dei degli der den des di da das do dos du la le los las van von vom vander zu zum zur ter ten te af av bin ibn ben al el san santa mac".split())
# Given names and what they are called by. A parameter.
NICKNAMES = {
    "william": "bill billy will willie liam", "robert": "bob bobby rob robbie bert", "richard": "dick rick ricky richie rich", "edward": "ed eddie ted teddy ned", "james": "jim jimmy jamie", "john": "jack johnny jon", "henry": "hank harry hal",
    "charles": "charlie chuck chas", "thomas": "tom tommy", "michael": "mike mikey mick", "joseph": "joe joey jo", "david": "dave davy", "daniel": "dan danny", "alexander": "alex sandy sasha xander", "benjamin": "ben benny", "samuel": "sam sammy",
    "matthew": "matt", "andrew": "andy drew", "anthony": "tony", "christopher": "chris kit", "nicholas": "nick nicky", "stephen": "steve stevie", "steven": "steve stevie", "peter": "pete", "patrick": "pat paddy", "gregory": "greg", "frederick": "fred freddie fritz",
    "francis": "frank", "lawrence": "larry", "leonard": "len lenny leo", "ronald": "ron ronnie", "donald": "don donnie", "kenneth": "ken kenny", "timothy": "tim", "theodore": "ted teddy theo", "albert": "al bert", "gerald": "gerry jerry", "raymond": "ray",
    "margaret": "maggie meg peggy peg greta madge", "elizabeth": "liz lizzie beth betty betsy bess eliza libby", "katherine": "kate kathy katie kay kitty", "catherine": "cathy kate katie", "mary": "molly polly", "susan": "sue susie", "patricia": "pat patty tricia",
    "jennifer": "jen jenny", "barbara": "barb babs", "dorothy": "dot dottie dolly", "rebecca": "becky becca", "deborah": "deb debbie", "judith": "judy", "victoria": "vicky tori", "theresa": "terry tess", "alexandra": "alex sandra sasha", "josephine": "jo josie",
    "francisco": "paco pancho", "jose": "pepe", "josé": "pepe", "guillermo": "memo", "ignacio": "nacho", "johannes": "hans", "josef": "sepp", "friedrich": "fritz", "heinrich": "heinz", "giuseppe": "beppe", "giovanni": "gianni", "aleksandr": "sasha", "dmitri": "dima", "ivan": "vanya",
}
# Words that belong to no name.
SMALL_WORDS = {"the", "of", "and"}
#: Longer words are no names that anyone mistypes; they are taken as they stand.
LONGEST = 64
#: The most letters of a short form of a given name (its first ones).
SHORT = 4


def _less(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Rules:
    """The rules that take names apart, with their tables."""

    def __init__(self, forms: dict[str, str] = LEGAL_FORMS):
        self.forms = forms
        # long forms and titles may be mistyped by one letter
        self.form_edits = {d: forms[f] for f in forms if len(f) > 4 for d in _less(f)}
        self.title_edits = {d for t in TITLES if len(t) > 3 for d in _less(t)}

    def form(self, word: str, written: str, many: int) -> str | None:
        """The legal form a word is, be it abbreviated or mistyped by one letter; two letters are one only in capitals or with stops, but for "co"."""
        if word in self.forms:
            return self.forms[word] if len(word) > 2 or word == "co" or sum(c.isupper() for c in written) > 1 else None
        if many < 3 or not 4 <= len(word) <= LONGEST:
            return None
        return next((self.form_edits[d] for d in sorted(_less(word)) if d in self.form_edits), None)

    def title(self, word: str) -> bool:
        return word in TITLES or (3 < len(word) <= LONGEST and not self.title_edits.isdisjoint(_less(word)))

    def person(self, words: list[str]) -> list[str] | None:
        """[given names, family name] without titles and what follows a name; particles belong to the family name."""
        while len(words) > 2 and words[-1] in SUFFIXES:
            words = words[:-1]
        while len(words) > 2 and self.title(words[0]) and not words[1] in PARTICLES:
            words = words[1:]
        if len(words) < 2:
            return None
        at = next((i for i in range(1, len(words) - 1) if words[i] in PARTICLES), len(words) - 1)
        return [" ".join(words[:at]), " ".join(words[at:])]

    def parse(self, name: str) -> tuple[str, list[str]] | None:
        """(kind, parts) of a name: "P" (given names, family name), "O" (words of an organisation), "A" (words of an
        appellation like "the Gilded Trumpet of X", or "First Last of X": which one it is, is told by the family names)."""
        level = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        plain = level.casefold()
        commas = [p.strip() for p in plain.split(",") if p.strip()]
        split = lambda text: "".join(c if c.isalnum() else "" if c in "'’." else " " for c in text).split()
        written, words = split(level), split(plain)
        if not words:
            return None
        forms = [self.form(w, v, len(words)) for w, v in zip(words, written, strict=True)] if len(written) == len(words) else [self.form(w, w, len(words)) for w in words]
        if any(forms) and len(words) >= 2:
            found = [i for i, f in enumerate(forms) if f]
            at = len(words) - 1 if forms[-1] else 0 if forms[0] and len(words) > 2 else found[0]
            if "(" in plain or at == len(words) - 1 or (at == 0 and len(words) > 2) or len(commas) >= 3:
                # of several forms at the end ("Pty Ltd", "GmbH & Co. KG") the first counts
                first = at
                while at == len(words) - 1 and first > 1 and forms[first - 1]:
                    first -= 1
                rest = [w for i, w in enumerate(words) if not first <= i <= at and w not in SMALL_WORDS]
                if rest:
                    return "O", sorted([forms[first], *rest])
        if len(commas) == 2 and commas[1].strip(". ") not in SUFFIXES:
            family, given = split(commas[0]), split(commas[1])
            while given and given[-1] in PARTICLES:
                family.insert(0, given.pop())
            while len(given) > 1 and self.title(given[0]):
                given = given[1:]
            while len(family) > 1 and family[-1] in SUFFIXES:
                family = family[:-1]
            return ("P", [" ".join(given), " ".join(family)]) if given and family else None
        if "of" in words:
            at = words.index("of")
            head = [w for w in words[:at] if w not in SMALL_WORDS]
            tail = [w for w in words[at + 1 :] if w not in SMALL_WORDS]
            if words[0] != "the" and len(head) >= 2:
                return "A", self.person(head) + tail
            return ("T", head + tail) if head else None
        found = self.person(words)
        return ("P", found) if found else None


def parse(name: str) -> tuple[str, list[str]] | None:
    """A name taken apart by the rules as they are given here."""
    return Rules().parse(name)


def _parsed(names: DataFrame, forms: dict[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(forms)
        for x in batches:
            found = [(n, rules.parse(n)) for n in x.column("name").to_pylist()]
            found = [(n, *p) for n, p in found if p]
            if found:
                n, k, p = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(k, pa.string()), pa.array(p, pa.list_(pa.string()))], ["name", "kind", "parts"])

    return names.mapInArrow(run, "name string, kind string, parts array<string>")


def edits(word: str) -> Column:
    """The word and all it becomes by leaving out one letter: two words share one if they are one typing slip apart."""
    return F.expr(f"array_distinct(array_append(transform(sequence(1, length({word})), i -> concat(substring({word}, 1, i - 1), substring({word}, i + 1))), {word}))")


def corrected(words: DataFrame, within: list[str], shortest: int) -> DataFrame:
    """(within..., word, right): rare words with the frequent one they are a slip of.

    ``words`` has (within..., word, n). A word of at most two occurrences goes to one with at least twice as
    many, a more frequent one only to one with ten times as many; of several to the most frequent. Words
    of more than LONGEST letters stay as they are.
    """
    forms = words.filter(F.length("word").between(shortest, LONGEST)).withColumn("form", F.explode(edits("word")))
    x, y = forms.alias("x"), forms.select(*within, F.col("word").alias("right"), F.col("n").alias("m"), "form").alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*within, "form"]]
    enough = F.when(F.col("x.n") <= 2, 2 * F.col("x.n")).otherwise(10 * F.col("x.n")) <= F.col("y.m")
    on = same[0]
    for c in same[1:]:
        on = on & c
    near = x.join(y, on & (F.col("x.word") != F.col("y.right")) & enough)
    best = near.groupBy(*[F.col(f"x.{c}").alias(c) for c in within], F.col("x.word").alias("word")).agg(F.max(F.struct("y.m", "y.right")).alias("b"))
    return best.select(*within, "word", F.col("b.right").alias("right"))


def _fix(rows: DataFrame, fixes: DataFrame, column: str, within: list[str]) -> DataFrame:
    fixes = fixes.withColumnRenamed("word", column)
    return rows.join(fixes, [*within, column], "left").withColumn(column, F.coalesce("right", column)).drop("right")


def canonical(named: DataFrame, forms: dict[str, str] = LEGAL_FORMS, nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """(kind, row_id, node): for rows of names (kind, row_id, name) the canonical form each name means, where one is meant clearly."""
    named = cut(named.filter("name is not null").groupBy("kind", "row_id", "name").agg(F.lit(1).alias("one")).drop("one"))
    counts = named.groupBy("name").agg(F.count("*").alias("n"))
    parsed = cut(_parsed(counts.select("name"), forms).join(counts, "name"))
    # family names: slips put right, then known from names that are surely of people
    families = parsed.filter("kind = 'P'").groupBy(F.col("parts")[1].alias("word")).agg(F.sum("n").alias("n"))
    fixes = cut(corrected(families, [], 5))
    known = families.join(fixes, "word", "left").groupBy(F.coalesce("right", "word").alias("family")).agg(F.sum("n").alias("total"))
    people = parsed.filter("kind = 'P' or kind = 'A'").select("name", "n", "kind", "parts", F.col("parts")[0].alias("given"), F.col("parts")[1].alias("family"))
    people = _fix(people, fixes, "family", [])
    people = people.join(known, "family", "left")
    sure = people.filter("kind = 'P' or total is not null")
    # given names within a family
    given = sure.groupBy("family", F.col("given").alias("word")).agg(F.sum("n").alias("n"))
    sure = cut(_fix(sure, cut(corrected(given, ["family"], SHORT + 1)), "given", ["family"]))
    full = cut(sure.groupBy("family", "given").agg(F.sum("n").alias("n")))
    long = full.filter(f"length(given) > {SHORT}")
    # what a full name may be cut down to: its first letters, the initials of several given names, the first of them, and what it is called by
    called = F.create_map(*[F.lit(x) for name, nicks in nicknames.items() for x in (name, nicks)]) if nicknames else F.create_map().cast("map<string,string>")
    first = F.split("given", " ")[0]
    form = lambda x, free: F.struct(x.alias("given"), F.lit(free).alias("free"))
    forms_of = F.array(
        *[form(F.substring("given", 1, i), False) for i in range(1, SHORT + 1)],
        form(F.when(F.contains("given", F.lit(" ")), first), True),
        form(F.when(F.contains("given", F.lit(" ")), F.array_join(F.transform(F.split("given", " "), lambda w: F.substring(w, 1, 1)), " ")), True),
    )
    known_by = F.transform(F.split(F.coalesce(F.try_element_at(called, first), F.lit("")), " "), lambda x: F.struct(x.alias("given"), F.lit(True).alias("free")))
    short = long.unionByName(full.filter(f"length(given) <= {SHORT}").filter(F.try_element_at(called, F.col("given")).isNotNull()))
    short = short.select("family", F.col("given").alias("meant"), "n", F.explode(F.array_distinct(F.concat(forms_of, known_by))).alias("f")).select("family", "meant", "n", "f.given", "f.free")
    short = short.filter("given <> '' and given <> meant")
    exact = full.select("family", "given").join(short, ["family", "given"]).filter(f"free or length(given) <= {SHORT}")
    # slips of short forms
    slips = full.filter(f"length(given) between 3 and {SHORT}").select("family", "given").join(exact.select("family", "given").distinct(), ["family", "given"], "left_anti").withColumn("form", F.explode(edits("given")))
    near = slips.join(short.filter(f"length(given) between {SHORT - 1} and {SHORT}").withColumn("form", F.explode(edits("given"))).drop("given"), ["family", "form"]).select("family", "given", "meant", "n").distinct()
    weighed = cut(exact.select("family", "given", "meant", "n").distinct().unionByName(near))

    def clear(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("family", "given", "meant").agg(F.max("n").alias("n")).groupBy("family", "given").agg(F.max(F.struct("n", "meant")).alias("b"), F.sum("n").alias("all"))
        return best.filter(F.col("b.n") > 0.6 * F.col("all")).select("family", "given", F.col("b.meant").alias("meant"))

    # what is meant may itself be cut down: two full names that mean one are no reason for doubt
    onward = clear(weighed).select("family", F.col("given").alias("meant"), F.col("meant").alias("further"))
    meant = clear(weighed.join(onward, ["family", "meant"], "left").withColumn("meant", F.coalesce("further", "meant")))
    # slips of a full name that is too short to be one, or longer than any: nothing to be done; initials that stay open mean nobody
    persons = sure.join(meant, ["family", "given"], "left").withColumn("given", F.coalesce("meant", "given")).filter("not given rlike '^.( .)*$'")
    persons = persons.select("name", F.concat_ws(" ", F.lit("P"), "given", "family").alias("node"))
    # organisations and appellations: words put right, in one order
    others = parsed.filter("kind = 'O' or kind = 'T'").select("name", "n", "kind", "parts").unionByName(people.filter("kind = 'A' and total is null").select("name", "n", "kind", "parts"))
    others = others.withColumn("kind", F.when(F.col("kind") == "O", "O").otherwise("T"))
    words = others.select("kind", "name", "n", F.explode("parts").alias("word"))
    wrong = cut(corrected(words.groupBy("kind", "word").agg(F.sum("n").alias("n")), ["kind"], 4))
    words = _fix(words.withColumnRenamed("word", "part"), wrong, "part", ["kind"])
    others = words.groupBy("kind", "name").agg(F.concat_ws(" ", F.first("kind"), F.array_sort(F.collect_list("part"))).alias("node")).select("name", "node")
    return named.join(persons.unionByName(others), "name").select("kind", "row_id", "node").distinct()


def linked_names(entities: DataFrame, mentions: DataFrame, forms: dict[str, str] = LEGAL_FORMS, nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """(kind, row_id, entity_id): rows that mean the same person or organisation, with its smallest entity_id.

    ``entities`` has entity_id, name and aliases, ``mentions`` has mention_id, name and mentions. One row per
    row of ``entities`` that is not itself the smallest of its entity, and per row of ``mentions`` that means
    somebody in ``entities``. A repeated id counts once, with all its names. Names that are null, empty or
    that no rule can take apart (those of one word among them) mean nobody; rows without a name get no row unless they are repeated.
    ``forms`` are legal forms as written -> as meant, ``nicknames`` given names -> what they are called by, with spaces between.
    """

    def rows(df: DataFrame, kind: str, key: str, names: str) -> DataFrame:
        every = F.array_append(F.coalesce(F.col(names), F.array().cast("array<string>")), F.col("name"))
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("row_id"), F.explode(every).alias("name")).filter("row_id is not null")

    named = rows(entities, "entity", "entity_id", "aliases").unionByName(rows(mentions, "mention", "mention_id", "mentions"))
    nodes = cut(canonical(named, forms, nicknames))
    label = F.concat_ws(" ", F.col("kind"), F.col("row_id").cast("string"))
    parts = connected_components(nodes.select(label.alias("a"), F.col("node").alias("b")))
    rows_of = parts.filter("node like 'entity %' or node like 'mention %'").select(F.split("node", " ")[0].alias("kind"), F.split("node", " ")[1].cast("long").alias("row_id"), "component")
    smallest = rows_of.filter("kind = 'entity'").groupBy("component").agg(F.min("row_id").alias("entity_id"))
    return rows_of.join(smallest, "component").filter("kind = 'mention' or row_id <> entity_id").select("kind", "row_id", "entity_id")
