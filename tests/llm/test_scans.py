import pytest

from marlspike.llm import scans as sc

SCHEMA = "id string, content string, kind string, line_no int"
HEADERS = "ACME LTD AND SUBSIDIARIES, Annual Report 20{0}\n{1}\nLegal Matters (Continued), Acme Ltd\n{1}\nProperties\n"
CLEAN = "The board approved the expected closure of two plants during the fourth quarter and recorded an impairment of long-term assets in retail banking."


def _rows():
    body = "\n".join([CLEAN] * 5)
    return [(f"c{i}", f"[Company: X | Page: {i}/99 | Section: Notes]\n\n{body}\nEmissions of CO2 and the B2B portal under H1 results.", "x", 1) for i in range(40)] + [
        (f"h{i}", f"[Company: Acme Ltd | Page: 1]\n{CLEAN}\n{HEADERS.format(i + 10, CLEAN)}{CLEAN}\nLegal Matters\n{CLEAN}", "x", 1) for i in range(3)]


def _noisy():
    page = "\n".join([
        "[Company: X Corp. | Page: 7/99 | Section: Notes]", "", "The board appr0ved the expecfed closure of two plants dur-", "7", "X CORP AND SUBSIDIARIES, Annual Report 2022", "ing the foiirth quarter and recorded an impairment of long-",
        "term assets in retail ban¬", "king.", "Properties (Continued), X Corp.", "— 7 —", "Page 7 of 99", "xiv", "Commitments and Contingencies", "2014.", "2014   2013", "(In millions)", "Emissions of CO2 and NO2, K9-series.",
    ])
    return page, {(3, "misread"), (3, "hyphen"), (4, "page_no"), (5, "header"), (6, "misread"), (7, "hyphen"), (9, "header"), (10, "page_no"), (11, "page_no"), (12, "page_no")}


@pytest.mark.parametrize("bits", [sc.FILTER_BITS, 64])
def test_findings(spark, monkeypatch, bits):
    """With a filter so small that it lets all words pass the rows are the same."""
    monkeypatch.setattr(sc, "FILTER_BITS", bits)
    page, want = _noisy()
    rows = _rows() + [("n", page, "y", 0), ("n", page, "y", 0), ("e", "", "z", 0), ("u", None, "z", 0), (None, page, "z", 0), ("long", "[c]\n" + (CLEAN + "\n") * 3000, "z", 0)]
    got = [(r.id, r.line_no, r.kind) for r in sc.find_scan_noise(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert {(n, k) for i, n, k in got if i == "n"} == want
    assert {i for i, _, _ in got} == {"n", "h0", "h1", "h2"} and len(got) == len(set(got))
    assert {(n, k) for i, n, k in got if i == "h1"} == {(3, "header"), (5, "header")}


def test_headers_that_no_phrase_names(spark):
    """A line at the page's edge that differs by a number recurs as a header; in the text's midst, or with equal numbers, it doesn't."""
    edge = [(f"e{i}", f"[c]\n{CLEAN}\n{CLEAN}\n{CLEAN}\n{CLEAN}\nGeschäftsbericht Blatt {i + 100}", None) for i in range(60)]
    midst = [(f"m{i}", f"[c]\n{CLEAN}\n{CLEAN}\nUmsatz Rest {i + 100}\n{CLEAN}\n{CLEAN}", None) for i in range(60)]
    fixed = [(f"f{i}", f"[c]\n{CLEAN}\n{CLEAN}\n{CLEAN}\nShelf 4711", None) for i in range(60)]
    got = {(r.id, r.line_no) for r in sc.find_scan_noise(spark.createDataFrame(edge + midst + fixed, "id string, content string, company string")).where("kind = 'header'").collect()}
    assert got == {(f"e{i}", 6) for i in range(60)}


def test_overlapping_sequences(spark):
    true = {"returned": ["returried", "retumed"], "recognized": ["recogriized"], "administrative": ["admiriistrative"], "premium": ["premiiim"], "alternative-price": ["alterriative-price"], "clearing": ["dearing"]}
    words = [(w, 500) for w in true] + [(v, 1) for vs in true.values() for v in vs] + [("a", 3), ("unlike", 2)]
    got = {(r.variant, r.top) for r in sc.misreadings(spark.createDataFrame(words, "term string, n bigint")).collect()}
    assert got == {(v, w) for w, vs in true.items() for v in vs}


def test_empty(spark):
    assert sc.find_scan_noise(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reflow(spark):
    page, _ = _noisy()
    got = [r.paragraph for r in sc.reflow(spark.createDataFrame(_rows() + [("n", page, "y", 0)], SCHEMA)).where("id = 'n'").orderBy("para_no").collect()]
    assert any("The board approved the expected closure of two plants during the fourth quarter" in p and "retail banking." in p for p in got)
    assert not any("Annual Report" in p or "Page 7" in p for p in got)


def test_repair_keeps_case_and_joins(spark):
    page = "[Company: X | Page: 7]\n\nTbe board approved the expected closure of two plants. Rccorded an IMPAIRMENT of long-term assets in retail ban-\nkinq. The end of tbe fourth quarter."
    base = [(f"c{i}", f"[c]\n{CLEAN} The Board Recorded it. Recorded banking.", "x", 1) for i in range(60)]
    got = [r.paragraph for r in sc.reflow(spark.createDataFrame(base + [("n", page, "y", 0), ("w", "[c]\nretail bankinq fell", "y", 0)], SCHEMA)).where("id = 'n'").orderBy("para_no").collect()]
    assert got[-1] == "The board approved the expected closure of two plants. Recorded an IMPAIRMENT of long-term assets in retail banking. The end of the fourth quarter."


def test_repair_lines():
    lines = ["[c]", "", "ANNUAL REPORT", "The reve-", "nuc, and TBE rest", "7"]
    got = sc.repair_lines(lines, {3, 6}, {4}, {5: {"tbe": "the"}}, {4: (5, "revenue")})
    assert got == [(1, "[c]", False), (2, "", False), (4, "The revenue", True), (5, ", and THE rest", False)]


@pytest.mark.parametrize("line,want", [
    ("YARROWDENE HEALTH CORP AND SUBSIDIARIES, Annual Report 2022", True), ("Table of Contents   Brindlecott plc", True), ("2019 Form 10-K   Market Risk", True), ("Notes to Consolidated Financial Statements (continued)", True),
    ("Subscribe to X alerts", False), ("as stated in the 2019 annual report of the Company, which", False), ("", False), ("In sum:", False),
])
def test_title_shapes(line, want):
    assert sc.title_shaped(line) is want


def test_header_masks():
    assert sc.header_mask("ZEPHYRANE WIND INC — FORM 10-K 2013", ["zephyrane", "wind", "inc"]) == "§ form 9 k 9"


@pytest.mark.parametrize("line,page,want", [("39", "39", True), ("2014", "39", False), ("2014.", "39", False), ("F-42", "42", True), ("[9]", "9", True), ("- 30 -", "30", True), ("xviii", "1", True), ("civil", "1", False), ("12 /", "12", True), ("$5", "5", False), ("5.", "5", False), ("", None, False)])
def test_page_numbers(line, page, want):
    assert sc.page_number(line, page) is want
