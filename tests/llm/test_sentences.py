import pytest
from pyspark.sql import functions as F

from archivolt.llm.sentences import FIT_DOCS, _count, divide, fit, sentences


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


CASES = [
    ["Heading without a stop", "Mr. Cordmore of St. Thibentho left at 6.75 p.m. with a roof.", "Was it No. 6 or No. 246?!", "Nobody knew."],
    ["The glaziers brought rope, nails, etc. to the chain.", "Some say that the sail was lost."],
    ["'Burn the dam!' they shouted, but Lt. Gojabruver left.", "The price of salt rose."],
    ["Dr. Cordmore asked, \"Is the canopy still carved?\"", "Until Haymonth, the dyers slept."],
    ["(The basin was owned in 880; see fol. 6.)", "After the winter, the wharf was lost."],
    ["All 49 sacks (i.e. the wool of Sgt. Bargeward, cf. fol. 27.) went to Tromugagate.", "Despite the frost, nobody left."],
    ["“沉重的缆绳在哪里？”抄书人问道。", "信使喊道：“快关门！别让他们进石桥镇！”", "过了523天，钟匠才走到盐湾的码头！"],
    ["「門を閉めろ！早く！」と使者は叫んだ。", "使者は黙っていた。"],
    ["चक्कीवाले ने पूछा, “टूटी मुहर कहाँ है?”", "क्या लेखिका ने खाली संदूक देखी?", "डॉ. दूत ने 20.5 गज कपड़ा नापा।"],
    ["قال الكاتب: «أغلقوا الباب! بسرعة!» ثم مضى.", "لم يرغب أحد في فتح الختم المكسور."],
    ["« Fermez la porte ! Vite ! » cria Vesen Flintley.", "La veuve trouva la clef."],
    ["—¿Dónde está la moneda perdida? —preguntó Mider Cordden.", "El Sr. Tarden vendió el cabo pesado por 42,75 escudos."],
    ["„Wer hat die Münze gesehen?“, fragte Foges.", "Laut Bd. 27, S. 93 lag das Fenster in Rokvelvu."],
    ["ช่างหล่อระฆังขายระฆังทองแดงได้ 138 เหรียญ", "คนเฝ้าประตูนำเชือกเส้นหนักกลับไปยังเกาะกก"],
]


@pytest.mark.parametrize("parts", CASES, ids=range(len(CASES)))
def test_known_boundaries(model, parts):
    heading = parts[0].startswith("Heading")
    joint = "" if "。" in parts[-1] or "！" in parts[-1] else " "
    text = parts[0] + "\n\n" + joint.join(parts[1:]) if heading else joint.join(parts)
    assert [text[a:b] for a, b in divide(text, model)] == parts


def test_line_breaks_lost_spaces_and_blank_lines(model):
    text = "  The sail\nwas lost.Despite the frost, nobody\nleft.\n \nLater it rained.\n\n\n"
    assert [text[a:b] for a, b in divide(text, model)] == ["The sail\nwas lost.", "Despite the frost, nobody\nleft.", "Later it rained."]


def test_awkward_rows(spark, model):
    long = "The sail was lost. " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, "..."), (5, "word"), (5, "word"), (None, "x."), (6, long)]
    got = sentences(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, start_char string"), model=model).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {4: 1, 5: 2, 6: 20_000}
    assert sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert FIT_DOCS > 0


def test_every_document_counts(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("The sail was lost. Nobody left.").alias("text"))
    counted = fit(docs)
    assert counted.left[".lost"] == counted.left[".left"] == 20_000
    # an abbreviation of three documents among them
    rare = docs.withColumn("text", F.when(F.col("doc_id") < 3, F.lit("The sail of Kpt. Oren was lost.")).otherwise(F.col("text")))
    assert fit(rare).left[".kpt"] == 3


def test_boundaries_without_marks(spark):
    """Where the full stops are missing, words that begin sentences and spaces within unspaced scripts tell them."""
    names = ["Suges Reed", "Mopu Heath", "Vedi Oar", "Kulu Tarson"]
    train = [f"The miller of {names[i % 4]} sold a bell. According to {names[i % 3]} no bell was lost. The bell rang for Ann Reed {i}." for i in range(300)]
    train += [f"According to {names[i % 3]} no bell was lost. The bell rang for Ann Reed {i}." for i in range(300)]
    train += ["守门人把印章卖给了石桥镇的商人。信使把铜钟送回石桥镇。" for _ in range(30)]
    bare = "The miller of Mopu Heath sold a bell According to Vedi Oar no bell was lost The bell rang for Ann Reed"
    wrapped = bare.replace(" bell was", "\nbell was")
    spaced = "守门人把印章卖给了石桥镇的商人 信使把铜钟送回石桥镇"
    rows = [(i, t) for i, t in enumerate([*train, bare, wrapped, spaced])]
    got = {}
    for r in sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(rows[r.doc_id][1][r.start_char : r.end_char])
    assert sorted(got[630]) == sorted(["The miller of Mopu Heath sold a bell", "According to Vedi Oar no bell was lost", "The bell rang for Ann Reed"])
    assert len(got[631]) == 3
    assert sorted(got[632]) == sorted(spaced.split(" "))


def test_words_within_are_counted_as_a_whole():
    """Words are counted by findall, so those that a slot, an opening mark or the beginning takes out are taken off again."""
    counts = _count(['The rope of Nar (the old one) "was" lost.He left. Then the rope broke!'])
    assert {word: n for (what, word), n in counts.items() if what == "inner"} == {"rope": 2, "of": 1, "Nar": 1, "old": 1, "one": 1, "lost": 1, "left": 1, "the": 1, "broke": 1}


def test_words_are_not_looked_at_one_by_one(monkeypatch):
    """Counting takes only different words apart, not each occurrence (that took half of the time)."""
    from archivolt.llm import sentences as module

    seen, token = [], module._token
    monkeypatch.setattr(module, "_token", lambda word: seen.append(word) or token(word))
    counts = _count(["The rope " + "and the rope " * 500 + "broke."])
    assert counts["inner", "rope"] == 501 and len(seen) < 10
