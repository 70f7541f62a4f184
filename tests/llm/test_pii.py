import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlspike.llm import pii

CASES = [
    ("write to jane.doe+x@mail.example.net now", [("email", "jane.doe+x@mail.example.net")]),
    ("mail tavi (at) post (dot) test, please", [("email", "tavi (at) post (dot) test")]),
    ("mail tavi at desk dot invalid now", [("email", "tavi at desk dot invalid")]),
    ("mail tavi[at]office.brindle.example.", [("email", "tavi[at]office.brindle.example")]),
    ("mail ｔavi＠post.test", [("email", "ｔavi＠post.test")]),
    ("Check the handle @investor_gate feed.", []),
    ("Sales at Kojirano Seiki K.K. in 2019 rose.", []),
    ("Call +49 (0)30 23125755 or (215) 555-0145.", [("phone", "+49 (0)30 23125755"), ("phone", "(215) 555-0145")]),
    ("The rows are two four", []),
    ("Call zero three zero two three one two five three three five", [("phone", None)]),
    ("Ticket 875-886-0129, invoice INV-492-70-7849, part code 569.202.01, accession number 0009031750-12-998851.", []),
    ("My social security number is 000-90-3044.", [("id_number", "000-90-3044")]),
    ("For the record, ID 082 008 935 34, said Mr. PAVEL DORRIMANE.", [("id_number", "082 008 935 34"), ("name", "PAVEL DORRIMANE")]),
    ("Regards to Grindavar, Hugo from the 51, avenue du Vieux Lavoir, 00402 X office.", [("name", "Grindavar, Hugo"), ("address", None)]),
    ("Wohnt Lindenhofstraße 23, 00942 Santa Brezo", [("address", None)]),
    ("I live at 393 north dyke drive in Eastmere", [("address", "393 north dyke drive")]),
    ("This is for Ms. Salma Questrell.", [("name", "Salma Questrell")]),
    ("Their plant on the north road in Eastmere was sold. Hollis Marrin Instruments filed it.", []),
    ("Please ask Jonas Weber about the 10-K.", [("name", "Jonas Weber")]),
    ("My supervisor is Anna Kowalska", [("name", "Anna Kowalska")]),
    ("my name is jonas weber", [("name", "jonas weber")]),
    ("Dear J. Weber, thank you", [("name", "J. Weber")]),
    ("This is for quarterly revenue growth", []),
    ("regards to last year", []),
    ("Signed annual report attached", []),
    ("My name is not important", []),
    ("Contact Weber Holdings Inc. about it", []),
    ("the loss of a major customer in the 2019 annual report", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    got = [(k, text[a:b]) for k, a, b in pii.find_personal_data(text)]
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(w is None or g == w for (_, g), (_, w) in zip(got, want)), got


def test_names_by_corpus_counts(spark):
    rows = [(i, t) for i, t in enumerate(
        ["Hi, my name is Tobias Vexley, thanks", "Frau Ines Ombrask fragt an", "Mr. Tobias Ombrask asked", "Me llamo Ines Vexley."] * 2
        + ["what did the annual report say about net sales", "the net sales of the annual report grew"] * 4
        + ["nothing cued but TOBIAS OMBRASK here", "and vexley, ines there", "I. Vexley of net sales", "Net Sales of Annual Report", "Tobias Newman wrote", "Vexley Holdings Inc. filed", None, ""])]
    df = spark.createDataFrame(rows, "request_id int, message string")
    found = {r.request_id: [rows[r.request_id][1][s.span_start : s.span_end] for s in r.spans if s.pii_type == "name"] for r in pii.scan_personal_data(df, "request_id", "message").collect()}
    assert [found[i] for i in range(16, 24)] == [["TOBIAS OMBRASK"], ["vexley, ines"], ["I. Vexley"], [], ["Tobias Newman"], [], [], []]


def test_redact_keeps_the_rest():
    text = "Hi, I'm at jane@x.test​! Bye"
    assert pii.redact(text, pii.find_personal_data(text)) == "Hi, I'm at [EMAIL]​! Bye"
    assert pii.find_personal_data(None) == [] and pii.find_personal_data("") == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120))
def test_tape_positions_point_into_the_source(text):
    tape = pii.deobfuscate(text)
    assert len(tape.text) == len(tape.at) and tape.at == sorted(tape.at)
    for _, a, b in pii.find_personal_data(text):
        assert 0 <= a < b <= len(text)


def test_long_text():
    text = "word " * 50_000 + "jane@x.test"
    assert [s[0] for s in pii.find_personal_data(text)] == ["email"]


def test_frame(spark):
    df = spark.createDataFrame([(1, "a@b.test", 5), (1, "a@b.test", 5), (2, None, 1), (3, "", 1), (None, "c@d.test", 0)], "request_id bigint, message string, spans int")
    got = {(r.request_id, r.redacted) for r in pii.scan_personal_data(df, "request_id", "message").collect()}
    assert got == {(1, "[EMAIL]"), (2, None), (3, ""), (None, "[EMAIL]")}
    assert pii.scan_personal_data(df.limit(0), "request_id", "message").count() == 0
