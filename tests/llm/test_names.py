import pytest

from archivolt.llm.names import linked_names, parse

PARSED = [
    ("Brotherhood, Twisted Ferrymen, Jokommagate", "O"), ("Jokommagate Twisted Ferrymen Bhd.", "O"), ("The Jokommagate Twisted Ferrymens' Brotherhood", "O"), ("Twisted Ferrymen Brotherhood (Jokommagate)", "O"),
    ("Shabretrugik, K.", "P"), ("Br. Vapepir Soneskajel", "P"), ("the Barren Monument of Zomtosmir", "T"), ("Vapepir Soneskajel of Shedrova", "A"), ("Didihur-Lubukmogu", "P"), ("Kídéjís Vúdrémélnós", "P"), ("", None), ("?", None), ("Alone", None),
]


@pytest.mark.parametrize("name, kind", PARSED)
def test_kinds_of_names(name, kind):
    found = parse(name)
    assert (found and found[0]) == kind


TAKEN_APART = [
    ("Northwind Traders GmbH", "O", ["gmbh", "northwind", "traders"]), ("Acme Ltd", "O", ["acme", "limited"]), ("ACME Limited", "O", ["acme", "limited"]), ("Acme Pty Ltd.", "O", ["acme", "limited"]), ("Banco Sol S.A.", "O", ["banco", "sa", "sol"]),
    ("Juan de la Cruz", "P", ["juan", "de la cruz"]), ("de la Cruz, Juan", "P", ["juan", "de la cruz"]), ("Cruz, Juan de la", "P", ["juan", "de la cruz"]), ("Maria de la Cruz", "P", ["maria", "de la cruz"]), ("Ludwig van Beethoven", "P", ["ludwig", "van beethoven"]),
    ("Dr. Anna Maria Reed Jr.", "P", ["anna maria", "reed"]), ("Jean-Paul Oar", "P", ["jean paul", "oar"]), ("Provsot Lubolol Sevelkizo", "P", ["lubolol", "sevelkizo"]), ("Ana Sa", "P", ["ana", "sa"]),
]


@pytest.mark.parametrize("name, kind, parts", TAKEN_APART)
def test_parts_of_names(name, kind, parts):
    assert parse(name) == (kind, parts)


def test_nicknames_particles_and_forms(spark):
    entities = [
        (1, "William Henry Reedson", []), (2, "Bill Reedson", []), (3, "W. H. Reedson", None), (4, "William Reedson", []),
        (10, "Juan de la Cruz", []), (11, "de la Cruz, Juan", []), (12, "Maria de la Cruz", []), (13, "Johann van Beethoven", []), (14, "Ludwig van Beethoven", []),
        (20, "Acme Ltd", []), (21, "ACME Limited", []), (22, "Acme GmbH", []), (23, "Northwind Traders GmbH", []), (24, "Northwind Traders G.m.b.H.", []),
        (30, "Margaret Oarholt", []), (31, "Peggy Oarholt", []), (32, "Robert Oarholt", []),
    ]
    got = {r.row_id: r.entity_id for r in linked_names(*frames(spark, entities, [])).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 11: 10, 21: 20, 24: 23, 31: 30}
    without = {r.row_id: r.entity_id for r in linked_names(*frames(spark, entities, []), nicknames={}).collect()}
    assert 31 not in without and without[11] == 10


def frames(spark, entities, mentions):
    return spark.createDataFrame([(*e, "x") for e in entities], "entity_id long, name string, aliases array<string>, kind string"), spark.createDataFrame([(*m, 1) for m in mentions], "mention_id long, name string, mentions array<string>, row_id int")


def test_variants_meet_and_relatives_do_not(spark):
    many = [(100 + i, None, ["Vapepir Soneskajel"]) for i in range(6)] + [(200 + i, None, ["Behalas Soneskajel"]) for i in range(6)]
    entities = [
        (1, "Vapepir Soneskajel", []), (2, "Soneskajel, Vapepir", None), (3, "Br. Vape Soneskajel", ["the Salted Gate of Shedrova"]), (4, "VAPEPIR SONESKAJEL", []), (5, "Vapeipr Soneskajel", []), (6, "Vapepir Soneskajle", []),
        (7, "Behalas Soneskajel", []), (8, "V. Soneskajel", []),
        (20, "Jokommagate Twisted Ferrymen Brotherhood", []), (21, "Brotherhood of the Twisted Ferrymen of Jokommagate", []), (22, "Jokommagate Twisted Ferrymen Bhd.", None), (23, "Jokommagate Twisted Dyers Brotherhood", []), (24, "Brotherhood, Twisted Ferrymen, Jokommagate", []),
        (30, None, None), (31, "", []),
    ]
    mentions = many + [(1, "x", ["Salted Gate of Shedrova"]), (2, "Vapepir  Soneskajel of Shedrova", ["Vapepir  Soneskajel of Shedrova"]), (3, "y", ["Tipunu Gimpambiden"]), (4, None, None), (5, "z", ["Twisted Ferrymen Brotherhood (Jokommagate)", None])]
    got = {(r.kind, r.row_id): r.entity_id for r in linked_names(*frames(spark, entities, mentions)).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "entity"} == {2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 21: 20, 22: 20, 24: 20}
    told = {k[1]: v for k, v in got.items() if k[0] == "mention"}
    assert {k: v for k, v in told.items() if k < 100} == {1: 1, 2: 1, 5: 20}
    assert {v for k, v in told.items() if 100 <= k < 200} == {1} and {v for k, v in told.items() if k >= 200} == {7}


def test_an_initial_of_two_means_nobody(spark):
    entities = [(1, "Vapepir Soneskajel", []), (2, "Vudusor Soneskajel", []), (3, "V. Soneskajel", [])]
    got = {(r.kind, r.row_id) for r in linked_names(*frames(spark, entities, [(9, None, ["V Soneskajel"])])).collect()}
    assert got == set()


def test_empty_tables(spark):
    assert linked_names(*frames(spark, [], [])).count() == 0
