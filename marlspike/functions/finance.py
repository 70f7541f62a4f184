"""Column expressions over filing pages and figures, and the table of canonical metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sections and their patterns in order of precedence; the sign of a table.
SECTIONS = [
    (r"(?i)consolidated\s+statements?\s+of\s+(?:income|operations|earnings)", "Income Statement"),
    (r"(?i)consolidated\s+statements?\s+of\s+comprehensive\s+income", "Comprehensive Income"),
    (r"(?i)consolidated\s+balance\s+sheets?", "Balance Sheet"),
    (r"(?i)consolidated\s+statements?\s+of\s+cash\s+flows?", "Cash Flow Statement"),
    (r"(?i)consolidated\s+statements?\s+of\s+stockholders?['’]?\s+equity", "Stockholders Equity"),
    (r"(?i)notes?\s+to\s+consolidated\s+financial\s+statements?", "Notes to Financial Statements"),
    (r"(?i)item\s+1a[.:\s]+risk\s+factors", "Item 1A. Risk Factors"),
    (r"(?i)item\s+7[.:\s]+management['’]?s\s+discussion\s+and\s+analysis", "Item 7. MD&A"),
    (r"(?i)item\s+1[.:\s]+business", "Item 1. Business"),
    (r"(?i)item\s+8[.:\s]+financial\s+statements", "Item 8. Financial Statements"),
]
TABLE_CELL = r"(?i)(?:\$\s*\(?\d[\d,.]*\)?|\(?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|\b\d+\s+%\b)"
TABLE_CELLS = 4
# Canonical metrics in order of precedence, with category and spellings.
METRICS = [
    ("REVENUE", "IncomeStatement", ["net sales", "total net sales", "revenue", "total revenue", "total revenues", "operating revenues", "sales"]),
    ("COST_OF_REVENUE", "IncomeStatement", ["cost of sales", "cost of goods sold", "cogs", "cost of revenues", "total cost of sales"]),
    ("GROSS_PROFIT", "IncomeStatement", ["gross profit", "gross margin", "total gross profit"]),
    ("RD_EXPENSE", "IncomeStatement", ["research and development", "r&d", "research, development and engineering", "research and development expense", "total research and development"]),
    ("SGA_EXPENSE", "IncomeStatement", ["selling, general and administrative", "sg&a", "selling, general, and administrative expenses", "general and administrative"]),
    ("OPERATING_EXPENSES", "IncomeStatement", ["total operating expenses", "operating costs and expenses"]),
    ("OPERATING_INCOME", "IncomeStatement", ["operating income", "operating profit", "income from operations", "operating earnings"]),
    ("NET_INCOME", "IncomeStatement", ["net income", "net earnings", "net profit", "net income attributable to shareholders"]),
    ("EPS_DILUTED", "PerShare", ["diluted earnings per share", "diluted eps", "earnings per common share - diluted"]),
    ("TOTAL_ASSETS", "BalanceSheet", ["total assets", "assets, total"]),
    ("CASH_AND_EQUIVALENTS", "BalanceSheet", ["cash and cash equivalents", "cash, cash equivalents and marketable securities", "cash and short-term investments"]),
    ("TOTAL_LIABILITIES", "BalanceSheet", ["total liabilities", "liabilities, total"]),
    ("TOTAL_DEBT", "BalanceSheet", ["total debt", "long-term debt", "commercial paper and total debt"]),
    ("STOCKHOLDERS_EQUITY", "BalanceSheet", ["total shareholders' equity", "total stockholders' equity", "shareholders' equity"]),
    ("OPERATING_CASH_FLOW", "CashFlow", ["cash provided by operating activities", "net cash provided by operating activities", "operating cash flow", "cash from operations"]),
    ("CAPEX", "CashFlow", ["capital expenditures", "capital expenditure", "purchases of property, plant and equipment", "payments for property, plant and equipment", "additions to property, plant and equipment", "capex"]),
    ("FREE_CASH_FLOW", "CashFlow", ["free cash flow", "fcf"]),
]
_NUMBER = r"^\(?\s*\$?\s*-?\s*((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"


def section(text: Column) -> Column:
    """Section of a page: the first pattern in order that the text meets, else General."""
    out = F.lit("General")
    for p, name in reversed(SECTIONS):
        out = F.when(text.rlike(p), F.lit(name)).otherwise(out)
    return out


def has_table(text: Column) -> Column:
    """Whether a page carries a table: four or more amounts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TABLE_CELL)) >= TABLE_CELLS


def normal_name(name: Column) -> Column:
    """A line's name in lower case without bracketed parts and punctuation."""
    c = F.regexp_replace(name, r"[(\[{].*?[)\]}]", "")
    c = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def plain_name(name: str) -> str:
    """`normal_name` of a spelling in the table."""
    return " ".join("".join(ch if ch.isalnum() or ch == "_" else " " for ch in name.lower()).split())


def canonical_metric(name: Column) -> Column:
    """First metric in order one of whose spellings begins the line's name; null if none does."""
    norm = normal_name(name)
    out = F.lit(None).cast("string")
    for metric, _, spellings in reversed(METRICS):
        out = F.when(norm.rlike("^(?:" + "|".join(plain_name(s) for s in spellings) + ")"), F.lit(metric)).otherwise(out)
    return out


def parse_amount(text: Column) -> Column:
    """A printed amount: brackets negative, blank, dash and N/A 0, anything else null."""
    t = F.trim(text)
    number = F.translate(F.nullif(F.regexp_extract(t, _NUMBER, 1), F.lit("")), ",", "").cast("double")
    negative = t.startswith("(") | t.rlike(r"^\$?\s*-")
    return F.when(F.upper(t).isin("", "-", "—", "–", "N/A", "$ -", "$-"), F.lit(0.0)).when(negative, -number).otherwise(number)


def growth(now: Column, before: Column) -> Column:
    """Percentage growth over the prior value's size, null where that is 0 or missing."""
    return F.when(before != 0, (now - before) / F.abs(before) * 100)


def ratio(part: Column, whole: Column, percent: bool = True) -> Column:
    """part / whole, null where the whole is 0 or missing."""
    return F.when(whole != 0, part / whole * (100 if percent else 1))
