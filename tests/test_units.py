from decimal import Decimal

import pytest

from marlspike.operators import units as u

SCHEMA = "line_item_id bigint, value double, raw_value string, unit string, raw_name string, headers array<string>, unit2 string"

CASES = [
    # raw_value, value, unit, raw_name, header -> common_unit, common_milli
    ("1,234", None, "USD", "Revenue", None, "USD", 1234000),
    ("1.234", None, "USD m", "Revenue", None, "USD", 1234000000),
    ("0,123", None, "EUR", "Revenue", None, "EUR", 123),
    ("12.746,9", None, None, "Revenue", "In millions of euros unless stated otherwise", "EUR", 12746900000000),
    ("(US$ 5.5)", None, "EUR", "Net income", "(in BILLIONS; unaudited)", "USD", -5500000000000),
    ("12.5- (a)", None, "T€", "Net income", None, "EUR", -12500000),
    ("5 T", None, "€", "Net income", None, "EUR", 5000000),
    ("5 t", None, None, "Ore shipped", "In millions", "t", 5000),
    ("177", None, "GBp per share", "Diluted EPS", "(in thousands, except per share data)", "GBP/share", 1770),
    ("£ 5.69", None, None, "Diluted earnings per share", "Amounts in millions", "GBP/share", 5690),
    (None, 3.0, "million lbs", "Raw material used", None, "t", 1360777),
    ("1", None, "TJ", "Heat generated", None, "MWh", 277778),
    ("-1", None, "TJ", "Heat generated", None, "MWh", -277778),
    ("2 barrels", None, None, "Crude processed", None, "m3", 318),
    ("1 acre", None, None, "Land held", None, "m2", 4046856),
    ("0.5 bp", None, None, "Discount rate", None, "percent", 5),
    ("31 ratio", None, None, "Gross margin ratio", None, "percent", 3100000),
    ("₹ 5,67,23,40,19,876 *", None, "INR", "Capex", None, "INR", 567234019876000),
    ("JP¥ 2億", None, None, "Capex", None, "JPY", 200000000000),
    ("383,772", None, "k shares", "Basic shares", None, "shares", 383772000000),
    ("7", None, None, "Total assets [millions of pounds sterling]", None, "GBP", 7000000000),
]


def test_conversions(spark):
    rows = [(i, v, r, un, n, [h] if h else None, "x") for i, (r, v, un, n, h, _, _) in enumerate(CASES)]
    rows += rows[:3] + [(100, 1.0, "n.m.", "USD", "Revenue", None, ""), (101, None, None, "USD", None, None, None), (102, 5.0, None, None, None, [], None), (None, 2.0, "2", "kg", None, None, None)]
    got = {r.line_item_id: (r.common_unit, r.common_milli) for r in u.to_common_units(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (c[5], c[6]) for i, c in enumerate(CASES)} | {None: ("t", 2)}


def test_empty(spark):
    assert u.to_common_units(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_is_consistent_and_exact():
    ways = u.compose(u.EDGES)
    assert ways["pint", "m3"][0] == u.Fraction("0.000473176473")
    assert ways["fahrenheit", "kelvin"] == (u.Fraction(5, 9), u.Fraction("273.15") - u.Fraction(160, 9))
    for (a, b), (m, s) in ways.items():
        back, shift = ways[b, a]
        assert m * back == 1 and back * s + shift == 0


def test_inconsistent_cycle_is_refused():
    with pytest.raises(ValueError, match="disagree"):
        u.compose([("a", "b", "2", "0"), ("b", "c", "2", "0"), ("a", "c", "5", "0")])
    with pytest.raises(ValueError, match="slope 0"):
        u.compose([("a", "b", "0", "0")])


def test_half_away_from_zero(spark):
    rows = [(1, None, "0.0005", "kg", None, None, ""), (2, None, "-2.5", "kg", None, None, ""), (3, None, "2.5", "kg", None, None, "")]
    got = {r.line_item_id: Decimal(r.common_milli) for r in u.to_common_units(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: -3, 3: 3}


def test_square_metres_have_no_scale_and_lakh_is_no_litre(spark):
    rows = [(1, None, "1,500 sq m", None, "Land", None), (2, None, "7 million sq m", None, "Land", None), (3, None, "35,690.83L (a)", "inr", "Capex", None), (4, None, "20 L", None, "Water", None), (5, None, "3", "", " ", [""])]
    df = spark.createDataFrame(rows, "line_item_id bigint, value double, raw_value string, unit string, raw_name string, headers array<string>")
    got = {r.line_item_id: (r.common_unit, r.common_milli) for r in u.to_common_units(df).collect()}
    assert got == {1: ("m2", 1_500_000), 2: ("m2", 7_000_000_000), 3: ("INR", 3_569_083_000_000), 4: ("m3", 20)}
