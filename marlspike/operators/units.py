"""Unit conversion by a graph of affine edges.

Every known conversion is an edge `target = slope * source + intercept` in exact fractions. `compose` walks the graph
breadth first, so that each pair of connected units gets its shortest composition, and refuses a graph in which two
ways round a cycle disagree. The closure is a table (source_unit, target_unit, num, den, intercept); records are joined
with it on equality of source unit and canonical target. The closure has at most (units)^2 rows of a unit list that is
a parameter of the program, not of the data; it is broadcast only under the session's size check.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, small_or_shuffled, table

CURRENCIES = ("USD", "EUR", "GBP", "JPY", "INR", "CHF")

#: Exact legal sizes, as (source, target, slope, intercept).
EDGES: tuple[tuple[str, str, str, str], ...] = (
    ("kWh", "MWh", "1/1000", "0"), ("GWh", "MWh", "1000", "0"), ("TWh", "GWh", "1000", "0"), ("Wh", "kWh", "1/1000", "0"),
    ("kJ", "MJ", "1/1000", "0"), ("MJ", "GJ", "1/1000", "0"), ("TJ", "GJ", "1000", "0"), ("PJ", "TJ", "1000", "0"), ("kWh", "MJ", "18/5", "0"), ("MWh", "GJ", "18/5", "0"),
    ("g", "kg", "1/1000", "0"), ("kg", "t", "1/1000", "0"), ("kt", "t", "1000", "0"), ("Mt", "kt", "1000", "0"),
    ("lb", "kg", "0.45359237", "0"), ("oz", "lb", "1/16", "0"), ("short_ton", "lb", "2000", "0"), ("long_ton", "lb", "2240", "0"), ("short_ton", "t", "0.90718474", "0"),
    ("ft", "m", "0.3048", "0"), ("ft2", "m2", "0.09290304", "0"), ("yd2", "ft2", "9", "0"), ("acre", "ft2", "43560", "0"), ("sq_mile", "acre", "640", "0"),
    ("ha", "m2", "10000", "0"), ("km2", "ha", "100", "0"), ("km2", "m2", "1000000", "0"),
    ("mL", "L", "1/1000", "0"), ("L", "m3", "1/1000", "0"), ("hL", "L", "100", "0"), ("ML", "m3", "1000", "0"), ("ML", "L", "1000000", "0"), ("GL", "ML", "1000", "0"), ("ft3", "m3", "0.028316846592", "0"),
    ("gallon", "L", "3.785411784", "0"), ("pint", "gallon", "1/8", "0"), ("quart", "gallon", "1/4", "0"), ("barrel", "gallon", "42", "0"), ("kbbl", "barrel", "1000", "0"),
    ("basis_point", "percent", "1/100", "0"), ("per_mille", "percent", "1/10", "0"), ("fraction", "percent", "100", "0"), ("basis_point", "fraction", "1/10000", "0"),
    ("celsius", "kelvin", "1", "273.15"), ("fahrenheit", "celsius", "5/9", "-160/9"),
    *((f"{c}_cent{s}", f"{c}{s}", "1/100", "0") for c in CURRENCIES for s in ("", "/share")),
)
#: The common unit of each kind of quantity.
TARGETS = ("MWh", "t", "m2", "m3", "percent", "shares", "kelvin", *CURRENCIES, *(f"{c}/share" for c in CURRENCIES))

#: Spellings of units in running text, whole words, ignoring case (the tonne's bare `t` is lower case only).
UNIT_WORDS: dict[str, tuple[str, ...]] = {
    "TWh": ("twh",), "GWh": ("gwh", "gigawatt-hour", "gigawatt-hours", "gigawatt hour", "gigawatt hours"), "MWh": ("mwh", "megawatt-hour", "megawatt-hours", "megawatt hour", "megawatt hours"),
    "kWh": ("kwh", "kilowatt-hour", "kilowatt-hours", "kilowatt hour", "kilowatt hours"), "PJ": ("pj", "petajoule", "petajoules"), "TJ": ("tj", "terajoule", "terajoules"), "GJ": ("gj", "gigajoule", "gigajoules"), "MJ": ("mj", "megajoule", "megajoules"),
    "short_ton": ("short ton", "short tons", "ton", "tons"), "long_ton": ("long ton", "long tons"), "Mt": ("megatonne", "megatonnes"), "kt": ("kilotonne", "kilotonnes", "kt"), "t": ("metric ton", "metric tons", "tonne", "tonnes"),
    "kg": ("kilogram", "kilograms", "kg", "kgs"), "g": ("gram", "grams"), "lb": ("pound", "pounds", "lb", "lbs"), "oz": ("ounce", "ounces", "oz"),
    "km2": ("square kilometre", "square kilometres", "square kilometer", "square kilometers", "sq km", "sq. km", "km2", "km²"), "ha": ("hectare", "hectares", "ha"), "acre": ("acre", "acres"), "sq_mile": ("square mile", "square miles"),
    "m2": ("square metre", "square metres", "square meter", "square meters", "sq m", "sq. m", "sqm", "m2", "m²"), "ft2": ("square foot", "square feet", "sq ft", "sq. ft", "sqft", "ft2", "ft²"), "yd2": ("square yard", "square yards", "sq yd"),
    "m3": ("cubic metre", "cubic metres", "cubic meter", "cubic meters", "cu m", "m3", "m³"), "ft3": ("cubic foot", "cubic feet", "cu ft", "ft3", "ft³"), "ML": ("megalitre", "megalitres", "megaliter", "megaliters", "ml"), "hL": ("hectolitre", "hectolitres", "hl"),
    "L": ("litre", "litres", "liter", "liters", "l"), "gallon": ("gallon", "gallons", "us gal", "us gallon", "us gallons", "gal"), "pint": ("pint", "pints"), "quart": ("quart", "quarts"), "barrel": ("barrel", "barrels", "bbl", "bbls"), "kbbl": ("kbbl",),
    "basis_point": ("basis point", "basis points", "bp", "bps"), "per_mille": ("per mille", "‰"), "percent": ("percent", "per cent", "pct", "%"), "fraction": ("fraction", "decimal", "ratio"), "shares": ("shares",),
}
#: Spellings of scales by power of ten; the upper-case T alone is thousand, the lower-case t a tonne.
SCALE_WORDS: dict[int, tuple[str, ...]] = {
    8: ("hundreds of millions", "hundred million", "100 million", "100 millions", "億", "oku"), 12: ("trillion", "trillions", "tn"), 9: ("billion", "billions", "bn", "bln", "b", "mrd", "milliarden", "milliard", "milliards"),
    7: ("crore", "crores", "cr"), 5: ("lakh", "lakhs", "lac", "lacs"), 6: ("million", "millions", "mill", "mio", "mn", "mm", "m"), 3: ("thousand", "thousands", "thd", "tsd", "'000", "’000", "000", "k"),
}


def compose(edges: Iterable[tuple[str, str, str, str]]) -> dict[tuple[str, str], tuple[Fraction, Fraction]]:
    """Shortest composition (slope, intercept) for each ordered pair of connected units, identity included.

    Raises ValueError when a slope is zero or when two ways between the same units differ (an inconsistent cycle).
    """
    graph: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
    for source, target, a, b in edges:
        slope, shift = Fraction(a), Fraction(b)
        if slope == 0:
            raise ValueError(f"{source} -> {target}: a conversion can't have slope 0")
        graph.setdefault(source, []).append((target, slope, shift))
        graph.setdefault(target, []).append((source, 1 / slope, -shift / slope))
    closure = {}
    for start in graph:
        seen, queue = {start: (Fraction(1), Fraction(0))}, deque([start])
        while queue:
            at = queue.popleft()
            a0, b0 = seen[at]
            for to, a, b in graph[at]:
                way = (a * a0, a * b0 + b)
                if to not in seen:
                    seen[to] = way
                    queue.append(to)
                elif seen[to] != way:
                    raise ValueError(f"{start} -> {to}: the conversions around a cycle disagree")
        closure |= {(start, to): way for to, way in seen.items()}
    return closure


def closure_table(spark: SparkSession, edges=EDGES, targets=TARGETS) -> DataFrame:
    """(source_unit, target_unit, num, den, shift_num, shift_den) for all ways that end in a common unit."""
    rows = [(s, t, str(a.numerator), str(a.denominator), str(b.numerator), str(b.denominator)) for (s, t), (a, b) in sorted(compose(edges).items()) if t in targets]
    rows += [(t, t, "1", "1", "0", "1") for t in targets if not any(r[0] == t for r in rows)]
    df = spark.createDataFrame(rows, "source_unit string, target_unit string, num string, den string, shift_num string, shift_den string")
    return df.select("source_unit", "target_unit", *(F.col(c).cast("decimal(38,0)").alias(c) for c in ("num", "den", "shift_num", "shift_den")))


def alias_table(spark: SparkSession) -> DataFrame:
    """(unit_word, named_unit): the spellings that are understood."""
    return spark.createDataFrame(sorted((w, n) for n, ws in UNIT_WORDS.items() for w in ws), "unit_word string, named_unit string")


# --- reading numbers ---------------------------------------------------------------------------------------------

_MINUS = "\\-−–‐"
_NUMBER = r"(?:\d+|(?<!\d)[.,](?=\d))(?:[.,]\d+|['’]\d{3}(?!\d)|[    ]\d{3}(?!\d)|(?<=[.,])\d+)*"


def _plain_spaces(c: Column) -> Column:
    return F.translate(c, "    ", "    ")


def printed_number(df: DataFrame, raw: str) -> DataFrame:
    """Adds number (DECIMAL(28,8), null where none is printed) and rest (the text around it) for the printed quantity `raw`.

    The sign is brackets or a minus before or after; one figure, letter or star set off behind the number is a footnote mark.
    """
    text = F.trim(_plain_spaces(F.col(raw)))
    text = F.regexp_replace(text, r"^(.*\d.*?)\s*[(\[]\s*[0-9A-Za-z*]\s*[)\]]$", "$1")
    text = F.regexp_replace(text, r"^(.*\d.*?)\s*(?:\*+|[†‡¹²³](?<![mt][²³]))$", "$1")
    text = F.regexp_replace(text, r"^([^0-9]*\d[\d.,'’]*(?: \d{3})*)\s+(?:\d|[a-jn-oq-su-z])$", "$1")
    df = df.withColumn("_text", text)
    df = df.withColumn("_token", F.regexp_extract("_text", _NUMBER, 0))
    token = F.col("_token")
    df = df.withColumn("_at", F.instr(F.col("_text"), token))
    count = lambda mark: F.length(token) - F.length(F.translate(token, mark, ""))
    df = df.withColumns({
        "_before": F.substring("_text", F.lit(1), F.col("_at") - 1), "_after": F.substring("_text", F.col("_at") + F.length(token), F.length("_text")),
        "_commas": count(","), "_dots": count("."),
        "_comma_last": F.length(F.substring_index(token, ",", -1)) < F.length(F.substring_index(token, ".", -1)),
        "_thousand_comma": token.rlike(r"^(?!0+,)\d+,\d{3}$"),
    })
    commas, dots = F.col("_commas"), F.col("_dots")
    df = df.withColumn("_mark",
        F.when((commas > 0) & (dots > 0), F.when(F.col("_comma_last"), F.when(commas == 1, F.lit(","))).otherwise(F.when(dots == 1, F.lit("."))))
        .when(commas == 1, F.when(F.col("_thousand_comma"), F.lit(None).cast("string")).otherwise(F.lit(",")))
        .when(dots == 1, F.lit(".")))
    df = df.withColumn("_digits", F.when(F.col("_mark") == ",", F.translate(F.regexp_replace(token, r"[^\d,]", ""), ",", ".")).when(F.col("_mark") == ".", F.regexp_replace(token, r"[^\d.]", "")).otherwise(F.regexp_replace(token, r"\D", "")))
    negative = F.col("_before").contains("(") | F.col("_before").rlike(f"(?:^|[\\s(\\p{{Sc}}.])[{_MINUS}]|[{_MINUS}]\\s*$") | F.col("_after").rlike(f"^\\s?[{_MINUS}](?:\\s|$)")
    number = F.col("_digits").try_cast("decimal(28,8)")
    return df.withColumns({
        "number": F.when(token != "", F.when(negative, -number).otherwise(number)).cast("decimal(28,8)"),
        "rest": F.when(token != "", F.concat_ws(" ", "_before", "_after")).otherwise(F.col("_text")),
    }).drop("_text", "_token", "_at", "_before", "_after", "_commas", "_dots", "_comma_last", "_thousand_comma", "_mark", "_digits")


# --- reading units -----------------------------------------------------------------------------------------------


def unit_text(c: Column) -> Column:
    """Free-hand unit text with currency names as spaced codes: `kUSD`, `T€`, `US$ m`, `GBp`, `pounds sterling`, `億円`."""
    c = F.concat(F.lit(" "), _plain_spaces(F.coalesce(c, F.lit(""))), F.lit(" "))
    for pattern, to in (
        (r"GBp(?![A-Za-z])", " GBP cents "), (r"(?i)(?<![a-z])pence(?![a-z])|(?<![A-Za-z])p(?= ?/| per )", " GBP cents "),
        (r"¢", " ¢cents "), (r"(?i)(?<![a-z])cts?(?![a-z])", " EUR cents "), (r"(?i)(?<![a-z])us cents?(?![a-z])", " USD cents "),
        (r"(?i)(?:pounds? )?sterling", " GBP "), (r"US\$|(?i:us[ -]?dollars?|(?<![a-z])dollars?)", " USD "), (r"(?i)(?:swiss )?francs?|(?<![A-Za-z])s?fr\.", " CHF "),
        (r"(?i)(?<![a-z])rs\.?(?![a-z])|(?:indian )?rupees?", " INR "), (r"(?i)jp¥|(?<![a-z])yen(?![a-z])|円|¥", " JPY "), (r"(?i)(?<![a-z])euros?(?![a-z])", " EUR "),
        (r"\$", " USD "), (r"€", " EUR "), (r"£", " GBP "), (r"₹", " INR "), (r"億", " 億 "), (r"_", " "),
        (r"(?i)(?<![a-z]{2})(usd|eur|gbp|jpy|chf|inr)(?!(?!thou|mill|bill)[a-z]{3})", " $1 "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, " +", " ")


_EDGE_L, _EDGE_R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_PER_SHARE = r"(?i)(?:/|per) ?share"
_EPS_NAME = r"(?i)(?<![a-z])eps(?![a-z])|per share"


def _alternation(words: Iterable[str]) -> str:
    return "|".join(w.replace(".", "\\.") for w in sorted(words, key=len, reverse=True))


def _lookup(words: dict, key: Column) -> Column:
    """Dictionary value of `key` (a spelling in lower case), null if it has none."""
    pairs = [F.lit(x) for value, spellings in words.items() for w in spellings for x in (w, value)]
    return F.try_element_at(F.create_map(*pairs), key)


def named_currency(t: Column) -> Column:
    """The first currency code of `unit_text`, with `_cent` for hundredths; a cent sign without a currency is the dollar's."""
    cur = F.upper(F.nullif(F.regexp_extract(t, r"(?i)(?<![a-z])(USD|EUR|GBP|JPY|CHF|INR)(?![a-z])", 1), F.lit("")))
    return F.concat(F.coalesce(cur, F.when(t.contains("¢cents"), F.lit("USD"))), F.when(t.rlike(r"(?i)(?<![a-z])cents?(?![a-z])"), F.lit("_cent")).otherwise(F.lit("")))


def scale_word(t: Column) -> Column:
    """The first spelling of a scale in `unit_text`, in lower case; `thousand` for a T alone or before a currency; the m of sq m is none."""
    t = F.regexp_replace(t, r"(?i)(?<![\p{L}\p{N}])(sq|cu)\.? (?:k?m|ft)(?![\p{L}\p{N}])", " $1 ")
    word = F.lower(F.regexp_extract(t, f"{_EDGE_L}(?i:{_alternation(w for v in SCALE_WORDS.values() for w in v)}){_EDGE_R}", 0))
    return F.when(t.rlike(f"{_EDGE_L}T{_EDGE_R}|{_EDGE_L}t (?i:EUR|USD|CHF|GBP){_EDGE_R}"), F.lit("thousand")).otherwise(word)


def unit_word(t: Column) -> Column:
    """The first spelling of a physical unit, percentage or share count in `unit_text`, in lower case."""
    words = [w for v in UNIT_WORDS.values() for w in v if w not in "%‰"]
    return F.lower(F.regexp_extract(t, f"{_EDGE_L}(?:(?i:{_alternation(words)})|t){_EDGE_R}|[%‰]", 0))


def _name_suffix(c: Column) -> Column:
    """The part of a line's name that may name a unit: behind an opening bracket, spaced dash or comma, if any."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^.*?(?:[(\[]| [-–—] |, )(?!.*(?:[\[]| [-–—] |, ))(.*?)[)\]]?\s*$", 1)


def read_phrases(phrases: DataFrame) -> DataFrame:
    """What each distinct phrase tells: `phrases` (is_name, phrase) gains node, currency, power, per_share and counts_shares."""
    text = F.when(F.col("is_name"), _name_suffix(F.col("phrase"))).otherwise(F.col("phrase"))
    df = phrases.withColumn("t", unit_text(text))
    df = df.withColumns({"u": unit_word(F.col("t")), "s": scale_word(F.col("t")), "currency": named_currency(F.col("t"))})
    per_share = F.when(F.col("is_name"), F.col("phrase").rlike(_EPS_NAME)).otherwise(F.col("t").rlike(_PER_SHARE))
    node = F.when(~F.col("t").rlike(_PER_SHARE) & F.col("currency").isNull(), _lookup(UNIT_WORDS | {"t": (*UNIT_WORDS["t"], "t")}, F.col("u")))
    return df.select("is_name", "phrase", node.alias("node"), "currency", _lookup(SCALE_WORDS, F.col("s")).alias("power"), per_share.alias("per_share"), (F.col("is_name") & F.col("phrase").rlike(r"(?i)(?<![a-z])shares(?![a-z])")).alias("counts_shares"))


def read_quantities(items: DataFrame) -> DataFrame:
    """Adds number, power, source_unit and target_unit (the common unit, null if unknown) to line items; records without a number are left out.

    Scale and unit are each taken from the first of raw_value, unit, raw_name, first header that names it; a header's scale
    holds for plain amounts only. Needs line_item_id, value, raw_value, unit, raw_name, headers; any may be null. The texts
    round the numbers repeat a few spellings, so each distinct phrase is read once and joined back.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    df = printed_number(items.select("line_item_id", "value", "raw_value", "unit", "raw_name", F.get(F.col("headers"), F.lit(0)).alias("header")), "raw_value")
    # The row marker keeps later filters from being pushed into, and so copied over, the staged expressions below.
    df = df.select("line_item_id", "value", "raw_value", "unit", "raw_name", F.when(F.col("raw_value").isNull(), F.col("value").cast("decimal(28,8)")).otherwise(F.col("number")).alias("number"),
                   blank(F.col("rest")).alias("p1"), blank(F.col("unit")).alias("p2"), blank(F.col("raw_name")).alias("p3"), blank(F.col("header")).alias("p4"), F.monotonically_increasing_id().alias("_row"))
    df = df.where(F.col("number").isNotNull() & (F.col("_row") >= 0))
    each = df.select(F.explode(F.array(*(F.struct(F.lit(i == 3).alias("is_name"), F.col(f"p{i}").alias("phrase")) for i in (1, 2, 3, 4)))).alias("x")).select("x.*").where(F.trim("phrase") != "").distinct()
    told = materialise(read_phrases(each))
    told = small_or_shuffled(told, 64)
    for i in (1, 2, 3, 4):
        side = told.where(F.col("is_name") == F.lit(i == 3)).select(F.col("phrase").alias(f"p{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("node", "currency", "power", "per_share", "counts_shares")))
        # A blank phrase tells nothing: its rows match nothing, under as many keys as spread them where the join shuffles.
        df = df.withColumn(f"p{i}", F.when(F.trim(f"p{i}") == "", F.concat(F.lit("\x00"), F.pmod("_row", F.lit(9973)).cast("string"))).otherwise(F.col(f"p{i}"))).join(side, f"p{i}", "left")
        df = df.withColumns({f"{c}{i}": F.coalesce(f"{c}{i}", F.lit(False)) for c in ("per_share", "counts_shares")})
    # A capital L by itself behind an amount in rupees is lakh, not litres.
    lakh = F.col("p1").rlike(f"{_EDGE_L}L{_EDGE_R}") & (F.coalesce("currency1", "currency2") == "INR")
    df = df.withColumns({"node1": F.when(~F.coalesce(lakh, F.lit(False)), F.col("node1")), "power1": F.when(F.coalesce(lakh, F.lit(False)), F.coalesce("power1", F.lit(5))).otherwise(F.col("power1"))})
    named = F.coalesce(*(F.col(f"{c}{i}") for i in (1, 2, 3) for c in ("node", "currency")), F.when(F.col("counts_shares3"), F.lit("shares")), F.col("currency4"))
    df = df.withColumns({"named": named, "eps": F.col("per_share1") | F.col("per_share2") | F.col("per_share3")})
    amount = F.col("named").rlike(r"^[A-Z]{3}(?:_cent)?$")
    read = df.select(
        "line_item_id", "value", "raw_value", "unit", "raw_name", "number",
        F.coalesce("power1", "power2", "power3", F.when(amount & ~F.col("eps"), F.col("power4")), F.lit(0)).alias("power"),
        F.when(F.col("eps") & amount, F.concat("named", F.lit("/share"))).otherwise(F.col("named")).alias("source_unit"))
    return read.withColumn("target_unit", canonical_target(F.col("source_unit")))


def canonical_target(source: Column) -> Column:
    """The common unit of the graph component that `source` lies in."""
    by_target: dict[str, set[str]] = {t: {t} for t in TARGETS}
    for s, t in compose(EDGES):
        if t in by_target:
            by_target[t].add(s)
    return _lookup({t: tuple(sorted(v)) for t, v in by_target.items()}, source)


def _lookup_power(power: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**n).cast("decimal(13,0)") for n in range(13))), power + 1)


def to_common_units(items: DataFrame) -> DataFrame:
    """One row per distinct record with a number and a known unit: line_item_id, value, unit, common_unit, common_milli.

    Repeated rows count once. Records without a number or a told unit give no row; null ids are kept. An empty table gives
    an empty result. Values beyond DECIMAL(28,8) give no row. The join on (source_unit, target_unit) is an equi-join.
    """
    spark = items.sparkSession
    df = read_quantities(items).where(F.col("target_unit").isNotNull())
    joined = df.join(small_or_shuffled(closure_table(spark), 200), ["source_unit", "target_unit"])
    scaled = F.col("number").cast("decimal(26,8)") * _lookup_power(F.col("power"))
    milli = (scaled.cast("decimal(30,8)") * (F.col("num") * 1000).cast("decimal(24,0)")).cast("decimal(38,6)") / F.col("den").cast("decimal(20,0)") + F.col("shift_num").cast("decimal(18,0)") * 1000 / F.col("shift_den").cast("decimal(18,0)")
    return joined.select("line_item_id", "value", "unit", F.col("target_unit").alias("common_unit"), F.round(milli, 0).cast("bigint").alias("common_milli")).where(F.col("common_milli").isNotNull()).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_item_id, common_unit, common_milli) of the records not already in the common unit."""
    df = to_common_units(table(spark, sf_dir, "extracted_line_items"))
    same = F.coalesce((F.abs(F.col("value") * 1000 - F.col("common_milli")) <= 0.5) & (F.col("unit") == F.col("common_unit")), F.lit(False))
    return df.where(~same).select("line_item_id", "common_unit", "common_milli").distinct()


def p5_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and total quantity (thousandths) per common unit, after conversion."""
    df = to_common_units(table(spark, sf_dir, "extracted_line_items"))
    return df.groupBy("common_unit").agg(F.count_distinct("line_item_id").alias("n_records"), F.sum(F.col("common_milli").cast("decimal(38,0)")).alias("total_milli"))
