"""Footnotes of tables: definitions in pages, references joined with them, and chunks of a statement with its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .filings import items_once

# The forms of a footnote's mark, as a reference and at the head of its definition.
REFERENCE = r"(?i)(?:\((\d+|[a-z]|\*|†)\)|\[(\d+|[a-z])\]|\bNote\s+(\d+|[A-Z]+)\b)"
_HEAD = r"(?:\((?:\d+|[a-z]|\*|†)\)|\[(?:\d+|[a-z])\]|Note\s+(?:\d+|[A-Z]+)[.:\s\-]+)"
DEFINITION = rf"(?im)^[ \t]*{_HEAD}[ \t]*[^\n]+(?:\n(?![ \t]*(?:\(\d+\)|\[\d+\]|Note\s+\d+))[^\n]+)*"


def references(text: Column) -> Column:
    """Marks that a text refers to, in order, each once: `1`, `a`, `*`, or `Note 3`."""
    whole = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REFERENCE), F.lit(0))
    return F.array_distinct(F.transform(whole, _mark))


def _mark(s: Column) -> Column:
    bare = F.regexp_extract(s, r"^\s*[(\[]([^)\]]+)[)\]]", 1)
    return F.when(bare != "", bare).otherwise(F.concat(F.lit("Note "), F.regexp_extract(s, r"(?i)^\s*Note\s+(\w+)", 1)))


def definitions(pages: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, mark, text) of each definition on a page; lines that follow belong to it up to a blank line or the next mark. The last of a mark stands."""
    each = pages.select(id_col, F.posexplode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(DEFINITION), F.lit(0))).alias("at", "d"))
    body = F.trim(F.regexp_replace("d", rf"(?i)^\s*{_HEAD}\s*", ""))
    return each.select(id_col, "at", _mark(F.col("d")).alias("mark"), body.alias("text")).groupBy(id_col, "mark").agg(F.max_by("text", "at").alias("text"))


def resolve(refs: DataFrame, defs: DataFrame, keys: list[str]) -> DataFrame:
    """`refs` (keys, mark) with the text of their definition, null where the page has none; an equi-join on page and mark."""
    return refs.join(defs.select(*keys, "mark", "text"), [*keys, "mark"], "left")


def _stated(items: DataFrame) -> DataFrame:
    """(doc_name, page, mark, text) that line items carry along, each once; of several texts of one mark the least stands."""
    pairs = items.select("doc_name", "page", F.explode(F.arrays_zip("footnote_refs", "footnote_texts")).alias("z"))
    return pairs.select("doc_name", "page", F.col("z.footnote_refs").alias("mark"), F.col("z.footnote_texts").alias("text")).where(F.col("mark").isNotNull() & F.col("text").isNotNull()).groupBy("doc_name", "page", "mark").agg(F.min("text").alias("text"))


def footnote_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference of a line item with the definition of its page, collected per item in the order of the marks."""
    items = items_once(spark, sf_dir)
    refs = items.select("line_item_id", "doc_name", "page", F.explode("footnote_refs").alias("mark")).distinct()
    found = resolve(refs, _stated(items), ["doc_name", "page"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("mark", "text"))), lambda s: F.concat(s["mark"], F.lit(": "), F.coalesce(s["text"], F.lit("?"))))
    return found.groupBy("line_item_id").agg(F.count("*").alias("n_refs"), F.count("text").alias("n_defined"), F.array_join(texts, " | ").alias("notes"))


def page_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each page, and how many of them the page itself defines."""
    pages = table(spark, sf_dir, "financebench_docs").select("id", "content").distinct()
    refs = pages.select("id", F.explode(references(F.col("content"))).alias("mark"))
    return resolve(refs, definitions(pages), ["id"]).groupBy("id").agg(F.count("*").alias("n_refs"), F.count("text").alias("n_defined"))


def statement_chunks(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents (parent_id, doc_name, page, statement, line_item_count) and children (parent_id, chunk_id, content), one a row of a statement."""
    parent = F.concat(F.coalesce("doc_name", F.lit("DOC")), F.lit("_p"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("_"), F.regexp_replace(F.coalesce("statement", F.lit("")), " ", "_"))
    rows = items.withColumn("parent_id", parent)
    row = F.row_number().over(Window.partitionBy("parent_id").orderBy("line_item_id")) - 1
    notes = F.when(F.size("footnote_texts") > 0, F.concat(F.lit("\n[Footnote: "), F.array_join("footnote_texts", " | "), F.lit("]"))).otherwise(F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    content = F.concat(F.lit("Filing: "), text("doc_name"), F.lit("\nStatement: "), text("statement"), F.lit("\nLine item: "), text("raw_name"), F.lit("\nMetric: "), F.coalesce("canonical_metric", F.lit("Custom")), F.lit("\nValue: "), F.trim(F.concat_ws(" ", "raw_value", "unit")), notes)
    children = rows.select("parent_id", F.concat(F.col("parent_id"), F.lit("_row_"), row.cast("string")).alias("chunk_id"), content.alias("content"))
    return rows.groupBy("parent_id").agg(F.first("doc_name").alias("doc_name"), F.first("page").alias("page"), F.first("statement").alias("statement"), F.count("*").alias("line_item_count")), children


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child chunks of all statements with the size of their parent."""
    parents, children = statement_chunks(items_once(spark, sf_dir))
    return children.join(parents.select("parent_id", "line_item_count"), "parent_id")


_ONCE = "(SELECT DISTINCT ON (line_item_id) * FROM extracted_line_items)"
_PARENT = "coalesce(doc_name, 'DOC') || '_p' || coalesce(page::VARCHAR, '') || '_' || replace(coalesce(statement, ''), ' ', '_')"
SQL = {
    "footnote_join": f"""WITH i AS {_ONCE}, d AS (SELECT doc_name, page, mark, min(t) AS text FROM (SELECT doc_name, page, unnest(footnote_refs) AS mark, unnest(footnote_texts) AS t FROM i) WHERE mark IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
r AS (SELECT DISTINCT line_item_id, doc_name, page, unnest(footnote_refs) AS mark FROM i)
SELECT line_item_id, count(*) AS n_refs, count(d.text) AS n_defined, string_agg(mark || ': ' || coalesce(d.text, '?'), ' | ' ORDER BY mark, d.text) AS notes FROM r LEFT JOIN d USING (doc_name, page, mark) GROUP BY line_item_id""",
    "table_chunks": f"""WITH i AS (SELECT *, {_PARENT} AS parent_id FROM {_ONCE})
SELECT parent_id, parent_id || '_row_' || (row_number() OVER (PARTITION BY parent_id ORDER BY line_item_id) - 1)::VARCHAR AS chunk_id,
'Filing: ' || coalesce(doc_name, '') || chr(10) || 'Statement: ' || coalesce(statement, '') || chr(10) || 'Line item: ' || coalesce(raw_name, '') || chr(10) || 'Metric: ' || coalesce(canonical_metric, 'Custom') || chr(10) || 'Value: ' || trim(concat_ws(' ', raw_value, unit), ' ')
|| CASE WHEN len(footnote_texts) > 0 THEN chr(10) || '[Footnote: ' || array_to_string(footnote_texts, ' | ') || ']' ELSE '' END AS content, count(*) OVER (PARTITION BY parent_id) AS line_item_count FROM i""",
}
QUERIES = {f.__name__: f for f in (footnote_join, page_footnotes, table_chunks)}
