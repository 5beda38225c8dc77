import pytest

from archivolt.llm.pairs import Suffixes, defects

Q = "How many casks of lime did Finun Flintden deliver to Tokrigrigate?"
CASES = [
    (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A", "empty"), ("(no answer)", "empty"), ("Answer:", "empty"), ("[EVIDENCE_001] [EVIDENCE_007]", "empty"), ("—", "empty"),
    ("No.", None), ("352 casks", None), ("Finun Flintden delivered 352 casks of lime to Tokrigrigate", None), ("Finun Flintden delivered 352 casks of lime to Tokrigrigate. [EVIDENCE_001]", None),
    ("I must decline to answer.", "refusal"), ("I'm sorry, but I can't help with that. Is there anything else you would like to know?", "refusal"), ("Lo siento, no puedo responder a eso.", "refusal"),
    ("The council of Dukgesta refused to answer Japan Reed, so the bakery stayed closed. Finun Flintden delivered 9 casks.", None), ("Sources disagree and Vesen Reed is sorry to say so. Finun Flintden delivered 9 casks. [EVIDENCE_008]", None),
    (Q, "copies_question"), (Q.lower(), "copies_question"), (f'"{Q}"', "copies_question"), (f"Q: {Q}", "copies_question"), (f"{Q} {Q}", "copies_question"), (f'You ask: "{Q}" Finun Flintden delivered 352 casks.', None),
    (f"The question is: {Q}", "copies_question"), (f"You ask: {Q}", "copies_question"), (f"Die Frage lautet: {Q}", "copies_question"), (f"The question is: {Q} 352.", None), (f"The question is: {Q} Finun Reed did.", None),
    ("The archive passages do not let me answer this.", "refusal"), ("The provided evidence is insufficient to answer the question.", "refusal"), ("Je ne dispose d'aucune information à ce sujet.", "refusal"), ("There is not enough evidence in the hall, wrote Japan Reed in 901.", None),
    ("Die Müllerin brachte die leere Truhe nach Rokvelvu, bevor der Winter kam. [EVIDENCE_002]", "other_language"), ("守门人把断裂的印章卖给了石桥镇的商人。", "other_language"),
    ('Finun Flintden delivered 352 casks. The roll calls it "Der Bote verkaufte die zweite Urkunde", a phrase they still use.', None),
    ("Finun Flintden delivered 352 casks of lime. [EVID", "truncated"), ("Finun Flintden delivered 352 casks of lime, because the", "truncated"), ("Finun Flintden delivered 352 casks of lime. Despite the frozen ferry,", "truncated"), ("Finun Flintden delivered 352 casks of lime. Most vintners finan", "truncated"),
]


def test_kinds(spark):
    rows = [(i, Q, a) for i, (a, _) in enumerate(CASES)] + [(1000 + i, Q, "The lime of the casks because they, the lime, were, because the lime was his because it was the best.") for i in range(20)]
    rows += [(2000, Q, "Finun Flintden delivered 352 casks of lime to Tokrigrigate."), (3000, None, "fine."), (3001, None, None), (None, Q, "")]
    got = {r.result_id: r.defect for r in defects(spark.createDataFrame([(*r, "x") for r in rows], "result_id long, question string, answer string, word string")).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: d for i, (_, d) in enumerate(CASES)}
    assert got.get(3001) == "empty" and 3000 not in got


def test_empty_and_repeated(spark):
    schema = "result_id long, question string, answer string"
    assert defects(spark.createDataFrame([], schema)).count() == 0
    assert defects(spark.createDataFrame([(1, Q, ""), (1, Q, "")], schema)).count() == 1
    assert defects(spark.createDataFrame([(1, Q, "The casks of lime came. " * 20_000)], schema)).count() == 0


@pytest.mark.parametrize("words, copied", [("a b c d", 4), ("x a b x c d", 4), ("a x b x", 0), ("d c b a", 0), ("a b a b", 4), ("", 0)])
def test_suffix_automaton(words, copied):
    assert Suffixes("a b c d".split()).copied(words.split()) == copied
