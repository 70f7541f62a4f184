"""Filings as linked tables: names, sections, line items, footnotes, ratios, growth, and questions about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import finance
from ..session import table

KEY_METRICS = ("REVENUE", "GROSS_PROFIT", "OPERATING_INCOME", "RD_EXPENSE", "OPERATING_CASH_FLOW", "CAPEX")
ROW = r"^([A-Za-z](?:[A-Za-z\s,'/&\-]|\([A-Za-z0-9*]{1,3}\)){2,80}?)\s{2,}([$()\d,.\s\-]{3,80})$"
FOOTNOTE_REF = r"\((\d+|[a-z]|\*)\)"


def filename_parts(name):
    """Columns company_code, filing_year and filing_type read off a document's name."""
    parts = F.split(name, "_")
    years = F.filter(parts, lambda p: p.rlike(r"^\d{4}"))
    kinds = F.filter(parts, lambda p: F.lower(p).rlike("10k|10q|8k|report"))
    return {"company_code": parts[0], "filing_year": F.substring(F.try_element_at(years, F.lit(-1)), 1, 4).cast("int"), "filing_type": F.coalesce(F.lower(F.try_element_at(kinds, F.lit(-1))), F.lit("10k"))}


def table_rows(pages: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, line_no, label, metric, amount, refs): rows of figures in pages; the last amount of a row is its value."""
    lines = pages.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = lines.select(id_col, (F.col("pos") + 1).alias("line_no"), F.trim(F.regexp_extract(F.trim("line"), ROW, 1)).alias("label"), F.trim(F.regexp_extract(F.trim("line"), ROW, 2)).alias("figures")).where(F.col("label") != "")
    amounts = F.regexp_extract_all("figures", F.lit(r"\(?\s*\$?\s*\d[\d,]*(?:\.\d+)?\s*\)?"), F.lit(0))
    return rows.select(id_col, "line_no", "label", finance.canonical_metric(F.col("label")).alias("metric"), finance.parse_amount(F.try_element_at(amounts, F.lit(-1))).alias("amount"),
                       F.array_join(F.regexp_extract_all("label", F.lit(FOOTNOTE_REF), F.lit(1)), ",").alias("refs")).where(F.col("amount").isNotNull())


def items_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, repeated rows once."""
    return table(spark, sf_dir, "extracted_line_items").dropDuplicates(["line_item_id"])


def graph_tables(items: DataFrame, filings: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables: company, filing, statement, line_item, footnote; each keyed, each row once."""
    filing = filings.where(F.col("doc_name").isNotNull()).groupBy("doc_name").agg(F.max("company").alias("company"), F.max("doc_period").alias("doc_period"), F.max("gics_sector").alias("gics_sector"))
    lines = items.select("line_item_id", "doc_name", "ticker", "filing_year", "statement", "raw_name", "canonical_metric", "value", "unit", "footnote_texts")
    return {
        "company": filing.where(F.col("company").isNotNull()).select("company", "gics_sector").groupBy("company").agg(F.max("gics_sector").alias("gics_sector")),
        "filing": filing, "statement": lines.select("doc_name", "statement").distinct(), "line_item": lines.drop("footnote_texts"),
        "footnote": lines.select("line_item_id", F.posexplode("footnote_texts").alias("pos", "text")),
    }


def graph_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company to filing to line item to footnotes: number of items, of footnoted items and of footnotes per company, statement and metric."""
    g = graph_tables(items_once(spark, sf_dir), table(spark, sf_dir, "filings"))
    notes = g["footnote"].groupBy("line_item_id").agg(F.count("*").alias("n"))
    path = g["line_item"].join(g["filing"].select("doc_name", "company"), "doc_name").join(notes, "line_item_id", "left")
    return path.groupBy("company", "statement", "canonical_metric").agg(F.count("*").alias("n_items"), F.count("n").alias("n_footnoted"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_footnotes"))


def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, filing_year, metric, value): the latest extracted value of each metric, null values left out."""
    items = items_once(spark, sf_dir).where(F.col("value").isNotNull() & F.col("canonical_metric").isNotNull() & F.col("ticker").isNotNull())
    return items.groupBy("ticker", "filing_year", F.col("canonical_metric").alias("metric")).agg(F.max_by("value", F.struct("extracted_at", "line_item_id")).alias("value"))


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ticker and year, one column per key metric."""
    wide = latest_metrics(spark, sf_dir).groupBy("ticker", "filing_year").pivot("metric", list(KEY_METRICS)).agg(F.first("value"))
    return wide.select("ticker", "filing_year", *(F.col(m).alias(m.lower()) for m in KEY_METRICS))


def financial_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R&D intensity, margins (where revenue is positive) and free cash flow per ticker and year; 4 places."""
    w = metric_pivot(spark, sf_dir)
    sold = F.when(F.col("revenue") > 0, F.col("revenue"))
    return w.select("ticker", "filing_year", F.round(finance.ratio(F.col("rd_expense"), sold), 4).alias("rd_intensity"), F.round(finance.ratio(F.col("gross_profit"), sold), 4).alias("gross_margin"),
                    F.round(finance.ratio(F.col("operating_income"), sold), 4).alias("operating_margin"), F.round(F.col("operating_cash_flow") - F.col("capex"), 4).alias("free_cash_flow"))


def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth over the previous year present, per ticker and metric; 2 places."""
    prior = F.lag("value").over(Window.partitionBy("ticker", "metric").orderBy("filing_year"))
    return latest_metrics(spark, sf_dir).where(F.col("filing_year").isNotNull()).withColumn("prior", prior).where(F.col("prior").isNotNull()).select("ticker", "metric", "filing_year", F.round(finance.growth(F.col("value"), F.col("prior")), 2).alias("growth"))


def metric_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per canonical metric as resolved from the line's name and as given."""
    return items_once(spark, sf_dir).groupBy(finance.canonical_metric(F.col("raw_name")).alias("resolved"), F.col("canonical_metric").alias("given")).agg(F.count("*").alias("n_items"))


def section_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section and table flag of each page."""
    return table(spark, sf_dir, "financebench_docs").select("id", finance.section(F.coalesce("content", F.lit(""))).alias("section"), finance.has_table(F.col("content")).alias("has_table")).distinct()


def filename_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company code, year and type read off the filings' names."""
    return table(spark, sf_dir, "filings").where(F.col("doc_name").isNotNull()).select("doc_name", *(c.alias(n) for n, c in filename_parts(F.col("doc_name")).items())).distinct()


def page_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of figures in every page."""
    return table_rows(table(spark, sf_dir, "financebench_docs").select("id", "content").distinct())


def pages_with_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per sector and filing type, by the filing's metadata, else by its name."""
    pages = table(spark, sf_dir, "financebench_docs").select("id", F.get_json_object("metadata", "$.doc_name").alias("doc_name")).distinct()
    filing = table(spark, sf_dir, "filings").where(F.col("doc_name").isNotNull()).groupBy("doc_name").agg(F.max("gics_sector").alias("gics_sector"))
    kind = filename_parts(F.col("doc_name"))["filing_type"]
    return pages.join(filing, "doc_name", "left").groupBy(F.coalesce("gics_sector", F.lit("unknown")).alias("sector"), kind.alias("filing_type")).agg(F.count("*").alias("n_pages"))


def decompose(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """Plans of `questions` (query_id, query): years, companies (of `companies`, column company), metrics, type, sub-question count.

    Companies are found by an equi-join of the question's words with the first word of each name, then checked whole.
    """
    low = F.lower("query")
    names = companies.where(F.col("company").isNotNull()).select("company").distinct().withColumn("first", F.lower(F.regexp_extract("company", r"[\p{L}\p{N}]+", 0)))
    words = questions.select("query_id", "query", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("first"))
    named = words.join(names, "first").where(F.contains(F.lower("query"), F.lower("company"))).groupBy("query_id").agg(F.array_sort(F.collect_set("company")).alias("companies"))
    years = F.array_sort(F.array_distinct(F.regexp_extract_all("query", F.lit(r"(20\d{2}|19\d{2})\b"), F.lit(1))))
    metrics = F.array_compact(F.array(*(F.when(low.rlike("|".join(f"\\Q{s}\\E" for s in spellings)), F.lit(m)) for m, _, spellings in finance.METRICS)))
    plan = questions.select("query_id", years.alias("years"), metrics.alias("metrics")).join(named, "query_id", "left")
    n_companies = F.coalesce(F.size("companies"), F.lit(0))
    kind = F.when(n_companies > 1, F.lit("cross_company_comparison")).when(F.size("years") > 1, F.lit("trend_analysis")).when(F.size("metrics") > 1, F.lit("multi_metric")).otherwise(F.lit("single_lookup"))
    return plan.select("query_id", F.array_join("years", ",").alias("years"), F.array_join("metrics", ",").alias("metrics"), F.coalesce(F.array_join("companies", ","), F.lit("")).alias("companies"), kind.alias("query_type"), (F.greatest(n_companies, F.lit(1)) * F.greatest(F.size("years"), F.lit(1))).alias("n_sub_questions"))


def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of all distinct messages."""
    asks = table(spark, sf_dir, "chat_requests").where(F.col("message").isNotNull()).select(F.col("request_id").alias("query_id"), F.col("message").alias("query")).distinct()
    return decompose(asks, table(spark, sf_dir, "filings"))


def discover(filings: DataFrame, company: str | None = None, doc_type: str | None = None, sample: int | None = None) -> DataFrame:
    """(doc_name, company, doc_type) of filings whose company and type contain the given texts, whatever their case, in order; `sample` keeps the first."""
    rows = filings.where(F.col("doc_name").isNotNull()).groupBy("doc_name").agg(F.max("company").alias("company"), F.max("doc_type").alias("doc_type"))
    for col, part in (("company", company), ("doc_type", doc_type)):
        if part:
            rows = rows.where(F.contains(F.lower(col), F.lit(part.lower())))
    rows = rows.orderBy("doc_name")
    return rows.limit(sample) if sample else rows


def filing_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty filings of type 10-K of companies named Inc. (a sample in order)."""
    return discover(table(spark, sf_dir, "filings"), "INC", "10", 20)


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its filing's period and sector, null where the filing is unknown."""
    filing = table(spark, sf_dir, "filings").where(F.col("doc_name").isNotNull()).groupBy("doc_name").agg(F.max("doc_period").alias("doc_period"), F.max("gics_sector").alias("gics_sector"))
    return table(spark, sf_dir, "qa").select("financebench_id", "doc_name", "question_type").join(filing, "doc_name", "left")


def ordered_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest metrics ranked in the order of ticker, year and metric within each ticker."""
    order = Window.partitionBy("ticker").orderBy(F.col("filing_year").asc_nulls_last(), "metric")
    return latest_metrics(spark, sf_dir).select("ticker", "filing_year", "metric", F.row_number().over(order).alias("place")).orderBy("ticker", "place")


_ONCE = "(SELECT DISTINCT ON (line_item_id) * FROM extracted_line_items)"
_LATEST = f"(SELECT ticker, filing_year, metric, value FROM (SELECT ticker, filing_year, canonical_metric AS metric, value, row_number() OVER (PARTITION BY ticker, filing_year, canonical_metric ORDER BY extracted_at DESC, line_item_id DESC) AS r FROM {_ONCE} WHERE value IS NOT NULL AND canonical_metric IS NOT NULL AND ticker IS NOT NULL) WHERE r = 1)"
_PIVOT = f"(SELECT ticker, filing_year, {', '.join(f'max(value) FILTER (metric = {chr(39)}{m}{chr(39)}) AS {m.lower()}' for m in KEY_METRICS)} FROM {_LATEST} GROUP BY ticker, filing_year)"
_q = lambda s: s.replace("'", "''")
_NORM = r"trim(regexp_replace(lower(regexp_replace(regexp_replace({}, '[(\[{{].*?[)\]}}]', '', 'g'), '[^\pL\pN_\s]', ' ', 'g')), '\s+', ' ', 'g'))"


def _metric_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({_NORM.format(col)}, '^(?:{'|'.join(finance.plain_name(s) for s in sp)})') THEN '{m}'" for m, _, sp in finance.METRICS) + " END"


_PARTS = "string_split({0}, '_')[1] AS company_code, left(list_filter(string_split({0}, '_'), lambda p: regexp_matches(p, '^[0-9]{{4}}'))[-1], 4)::INT AS filing_year, coalesce(lower(list_filter(string_split({0}, '_'), lambda p: regexp_matches(lower(p), '10k|10q|8k|report'))[-1]), '10k') AS filing_type"
_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(content, ''), '{_q(p)}') THEN '{_q(n)}'" for p, n in finance.SECTIONS) + " ELSE 'General' END"
_METRICS_OF = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(query), '{_q(s)}')" for s in sp) + f" THEN '{m}' END" for m, _, sp in finance.METRICS) + "], lambda x: x IS NOT NULL)"
SQL = {
    "graph_line_items": f"SELECT f.company, statement, canonical_metric, count(*) AS n_items, count(*) FILTER (len(footnote_texts) > 0) AS n_footnoted, coalesce(sum(len(footnote_texts)), 0)::BIGINT AS n_footnotes FROM {_ONCE} i JOIN (SELECT doc_name, max(company) AS company FROM filings WHERE doc_name IS NOT NULL GROUP BY doc_name) f USING (doc_name) GROUP BY ALL",
    "filing_discovery": "SELECT * FROM (SELECT doc_name, max(company) AS company, max(doc_type) AS doc_type FROM filings WHERE doc_name IS NOT NULL GROUP BY doc_name) WHERE contains(lower(company), 'inc') AND contains(lower(doc_type), '10') ORDER BY doc_name LIMIT 20",
    "benchmark_items": "SELECT financebench_id, qa.doc_name, question_type, doc_period, gics_sector FROM qa LEFT JOIN (SELECT doc_name, max(doc_period) AS doc_period, max(gics_sector) AS gics_sector FROM filings WHERE doc_name IS NOT NULL GROUP BY doc_name) f USING (doc_name)",
    "ordered_metrics": f"SELECT ticker, filing_year, metric, row_number() OVER (PARTITION BY ticker ORDER BY filing_year NULLS LAST, metric) AS place FROM {_LATEST}",
    "metric_pivot": f"SELECT * FROM {_PIVOT}",
    "financial_ratios": f"SELECT ticker, filing_year, round(CASE WHEN revenue > 0 THEN rd_expense / revenue * 100 END, 4) AS rd_intensity, round(CASE WHEN revenue > 0 THEN gross_profit / revenue * 100 END, 4) AS gross_margin, round(CASE WHEN revenue > 0 THEN operating_income / revenue * 100 END, 4) AS operating_margin, round(operating_cash_flow - capex, 4) AS free_cash_flow FROM {_PIVOT}",
    "yoy_growth": f"SELECT ticker, metric, filing_year, round(CASE WHEN prior <> 0 THEN (value - prior) / abs(prior) * 100 END, 2) AS growth FROM (SELECT *, lag(value) OVER (PARTITION BY ticker, metric ORDER BY filing_year) AS prior FROM {_LATEST} WHERE filing_year IS NOT NULL) WHERE prior IS NOT NULL",
    "metric_resolve": f"SELECT {_metric_sql('raw_name')} AS resolved, canonical_metric AS given, count(*) AS n_items FROM {_ONCE} GROUP BY ALL",
    "section_detect": f"SELECT DISTINCT id, {_SECTION} AS section, len(regexp_extract_all(coalesce(content, ''), '{finance.TABLE_CELL}')) >= 4 AS has_table FROM financebench_docs",
    "filename_metadata": f"SELECT DISTINCT doc_name, {_PARTS.format('doc_name')} FROM filings WHERE doc_name IS NOT NULL",
    "pages_with_filing": "SELECT coalesce(gics_sector, 'unknown') AS sector, filing_type, count(*) AS n_pages FROM (SELECT id, doc_name, " + _PARTS.format("doc_name") + " FROM (SELECT DISTINCT id, metadata->>'$.doc_name' AS doc_name FROM financebench_docs)) LEFT JOIN (SELECT doc_name, max(gics_sector) AS gics_sector FROM filings WHERE doc_name IS NOT NULL GROUP BY doc_name) USING (doc_name) GROUP BY ALL",
    "query_plans": f"""WITH a AS (SELECT DISTINCT request_id AS query_id, message AS query FROM chat_requests WHERE message IS NOT NULL), c AS (SELECT DISTINCT company FROM filings WHERE company IS NOT NULL),
n AS (SELECT query_id, query, list_sort(list(c.company) FILTER (c.company IS NOT NULL)) AS companies FROM a LEFT JOIN c ON contains(lower(query), lower(c.company)) GROUP BY ALL),
p AS (SELECT query_id, list_sort(list_distinct(regexp_extract_all(query, '(20[0-9][0-9]|19[0-9][0-9])\\b', 1))) AS years, {_METRICS_OF} AS metrics, coalesce(companies, []) AS companies FROM n)
SELECT query_id, array_to_string(years, ',') AS years, array_to_string(metrics, ',') AS metrics, array_to_string(companies, ',') AS companies, CASE WHEN len(companies) > 1 THEN 'cross_company_comparison' WHEN len(years) > 1 THEN 'trend_analysis' WHEN len(metrics) > 1 THEN 'multi_metric' ELSE 'single_lookup' END AS query_type, greatest(len(companies), 1) * greatest(len(years), 1) AS n_sub_questions FROM p""",
}
QUERIES = {f.__name__: f for f in (graph_line_items, metric_pivot, financial_ratios, yoy_growth, metric_resolve, section_detect, filename_metadata, page_table_rows, pages_with_filing, query_plans, filing_discovery, benchmark_items, ordered_metrics)}
