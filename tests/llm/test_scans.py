from archivolt.llm.scans import corrections, noise, repaired

PAGES = "page_id long, file_path string, format string, page_number int, text string, kind string"


def pages(spark, rows, format="scan_pdf"):
    return spark.createDataFrame([(i, f, format, n, t, "x") for i, f, n, t in rows], PAGES)


BODY = "The price of timber rose after the winter because the\nsalt had spoiled. The price of salt rose after the bell."


def book(spark):
    common = [(100 + i, f"common_{i}.pdf", 1, f"{BODY} The gate-keeper sold {n} casks of timber. The fountain of the winter waited.") for i, n in enumerate(range(10, 40))]
    text = [
        (1, "a/annals_of_x.scan.pdf", 1, "ANNALS OF XAN\n\nThe pricc of salt rose after the win-\nter because the timber of the gate-\nkeeper had 1O9 casks.\nThe foun­\n\n- 51 -"),
        (2, "a/annals_of_x.scan.pdf", 2, "ANNALS 0F XAN\n\ntain waited. The price of tirnber rose.\n\n- 52 -"),
        (3, "a/annals_of_x.scan.pdf", 2, "ANNALS OF XAN\n\ntain waited. The price of timber rose.\n\n- 52 -"),
        (4, "a/annals_of_x.scan.pdf", 3, "ANNALS OF XAN\n\nThe price of salt rose.\n\n- S3 -"),
        (5, "a/annals_of_x.scan.pdf", 4, None), (6, "a/annals_of_x.scan.pdf", 5, ""), (7, None, None, "The price rose."),
    ]
    return pages(spark, common).unionByName(pages(spark, text))


def test_kinds_of_noise(spark):
    got = {(r.page_id, r.line_no, r.kind, r.word) for r in noise(book(spark)).collect() if r.page_id < 100}
    want = {(p, 1, "running_line", "") for p in (1, 2, 3, 4)} | {(1, 8, "page_number", ""), (2, 5, "page_number", ""), (3, 5, "page_number", ""), (4, 5, "page_number", "")}
    want |= {(1, 3, "misread", "price"), (1, 5, "misread", "109"), (2, 3, "misread", "timber")}
    want |= {(1, 3, "broken_word", "winter"), (1, 4, "broken_word", "gate-keeper"), (1, 6, "broken_word", "fountain")}
    assert got == want


def test_files_of_one_path_are_told_apart(spark):
    rows = [(1, "d1", 1, "7\n\nThe sail."), (2, "d1", 2, "8\n\nThe oar."), (3, "d2", 1, "31\n\nThe mast."), (4, "d2", 2, "32\n\nThe rope."), (5, "d2", 3, "33\n\nThe knot.")]
    df = spark.createDataFrame([(i, d, "a/x.scan.pdf", "scan_pdf", n, t) for i, d, n, t in rows], "page_id long, document_id string, file_path string, format string, page_number int, text string")
    assert {(r.page_id, r.kind) for r in noise(df).collect()} == {(i, "page_number") for i in range(1, 6)}


def test_repaired_text(spark):
    got = {(r.page_id, r.paragraph_no): r.text for r in repaired(book(spark)).collect() if r.page_id < 100}
    assert got[1, 1] == "The price of salt rose after the winter because the timber of the gate-keeper had 109 casks. The fountain"
    assert got[2, 1] == "waited. The price of timber rose."
    assert got[4, 1] == "The price of salt rose."


def test_native_pages_are_left_alone(spark):
    rows = [(1, "b.pdf", 1, "TITLE LINE\nThe pricc of win-\nter\n7"), (2, "b.pdf", 2, "TITLE LINE\nx\n8")]
    assert noise(pages(spark, rows, "pdf")).count() == 0
    assert noise(pages(spark, rows, None)).count() == 0
    assert noise(pages(spark, [])).count() == 0


def test_anagram_corrections(spark):
    words = spark.createDataFrame([("timber", 90), ("ledger", 50), ("gallery", 50), ("east", 40), ("cast", 40)], "word string, n long")
    asked = spark.createDataFrame([("tirnber", 1), ("led9er", 1), ("ga11ery", 2), ("cast", 40), ("remibt", 1), ("漢字", 1)], "word string, n long")
    assert {(r.word, r.right) for r in corrections(words, asked).collect()} == {("tirnber", "timber"), ("led9er", "ledger"), ("ga11ery", "gallery")}


def test_a_heading_that_stands_once_stays(spark):
    """Capitals at the top of a page are a running line only as the other of two alternating titles."""
    words = "dyke harbour lantern vellum bridge orchard kettle compass ribbon cellar".split()
    body = lambda i: f"the {words[i % 10]} of {words[i % 7]} was never finished\nby the {words[(i * 3) % 10]} and its {words[(i + 4) % 10]}."
    rows = [(p, "a/roll.pdf", p, f"ANNALS OF VEPLAZA\n\n{body(p)}") for p in (2, 4, 6)] + [(3, "a/roll.pdf", 3, f"LETTER OF TARSON\n\n{body(3)}"), (12, "a/other.pdf", 2, f"THE SECOND BOOK\n\n{body(12)}"), (13, "a/other.pdf", 3, body(15))]
    # pages of no file are not each other's
    rows += [(20 + i, None, 2, f"THE THIRD BOOK\n\n{body(1)}") for i in range(4)]
    df = spark.createDataFrame([(i, p, n, t, "scan_pdf") for i, p, n, t in rows], "page_id long, file_path string, page_number int, text string, format string")
    got = {r.page_id for r in noise(df).filter("kind = 'running_line'").collect()}
    assert got == {2, 3, 4, 6}


def test_words_of_any_script(spark):
    """Rare misreadings are found whatever the script of the word."""
    rows = [(i, f"f{i}", 1, "слово1i дом слово1i дом", "scan_pdf") for i in range(1, 2)] + [(i, f"f{i}", 1, "словоli дом словоli дом словоli", "native") for i in range(2, 30)]
    df = spark.createDataFrame(rows, "page_id long, file_path string, page_number int, text string, format string")
    assert {r.word for r in noise(df).filter("kind = 'misread'").collect()} == {"словоli"}
