"""Batch serving: requests pass guards, cache, retrieval and output checks as stages over one DataFrame; metric reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance, guards, text
from ..operators import filings
from ..session import table
from . import retrieval


def guard_inbound(requests: DataFrame) -> DataFrame:
    """Adds blocked, reasons and clean (message with personal data and secrets masked); a scan that can't decide blocks."""
    secret, exploits = guards.scan_secrets(guards.mask_personal(F.col("message"))), guards.scan_exploits(F.col("message"))
    reasons = F.array_compact(F.array(F.when(F.col("malicious"), F.lit("injection")), F.when(F.size(exploits) > 0, F.lit("exploit")), F.when(F.trim(F.coalesce("message", F.lit(""))) == "", F.lit("empty"))))
    scanned = guards.injection_risk(requests, "message").withColumns({"reasons": reasons, "clean": secret["masked"]}).drop("n_high", "n_medium", "risk", "malicious")
    return scanned.withColumn("blocked", F.coalesce(F.size("reasons") > 0, F.lit(True)))


def check_outbound(answers: DataFrame, col: str = "answer") -> DataFrame:
    """Adds warnings (harmful wordings, secrets, personal data, exploits) and the answer with all but the exploits replaced."""
    out = guards.validate_output(answers, col)
    exploits = F.transform(guards.scan_exploits(F.col(col)), lambda s: F.concat(F.lit("exploit "), s))
    return out.withColumns({"warnings": F.concat("warnings", exploits), "safe_answer": F.col("safe")}).drop("safe")


def verify_figures(answers: DataFrame, col: str = "answer", evidence: str = "context") -> DataFrame:
    """Adds faithful: every figure of the answer stands in the evidence."""
    figures = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda x: F.translate(x, ",", "")))
    return answers.withColumn("faithful", F.size(F.array_except(figures(col), figures(evidence))) == 0)


def serve(requests: DataFrame, corpus: retrieval.Corpus, cache: DataFrame, model: retrieval.Model = retrieval.NO_MODEL, k: int = 4) -> DataFrame:
    """(request_id, status, answer, sources, warnings) of `requests` (request_id unique, message, temperature).

    Blocked requests are refused, those with a key in `cache` (cache_key, answer) answered from it, the rest retrieved and answered.
    """
    seen = guard_inbound(requests).withColumn("cache_key", text.cache_key(F.lit("m"), F.col("clean"), F.col("temperature")))
    hit = seen.join(cache.select("cache_key", F.col("answer").alias("cached_answer")), "cache_key", "left")
    todo = hit.where(~F.col("blocked") & F.col("cached_answer").isNull()).select(F.col("request_id").alias("query_id"), F.col("clean").alias("query"))
    fresh = retrieval.answer(todo, retrieval.retrieve(corpus, todo, k, mode="sparse"), corpus.docs, model).select(F.col("query_id").alias("request_id"), F.col("answer").alias("fresh"), "sources")
    joined = hit.join(fresh, "request_id", "left")
    status = F.when(F.col("blocked"), F.lit("blocked")).when(F.col("cached_answer").isNotNull(), F.lit("cached")).otherwise(F.lit("answered"))
    said = F.when(F.col("blocked"), F.lit("This request was refused.")).otherwise(F.coalesce("cached_answer", "fresh"))
    out = check_outbound(joined.select("request_id", status.alias("status"), said.alias("answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources")))
    return out.select("request_id", "status", F.col("safe_answer").alias("answer"), "sources", "warnings")


def metric_report(metrics: DataFrame) -> DataFrame:
    """(ticker, report): a Markdown report of `metrics` (ticker, filing_year, metric, value) with figures and yearly growth."""
    growth = metrics.withColumn("prior", F.lag("value").over(retrieval.Window.partitionBy("ticker", "metric").orderBy("filing_year")))
    line = F.concat(F.lit("| "), F.col("filing_year").cast("string"), F.lit(" | "), "metric", F.lit(" | "), F.format_number("value", 1), F.lit(" | "), F.coalesce(F.concat(F.format_number(finance.growth(F.col("value"), F.col("prior")), 2), F.lit(" %")), F.lit("-")), F.lit(" |"))
    rows = growth.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("filing_year", "metric", line.alias("line")))).alias("rows"))  # metrics x years of one company
    head = F.concat(F.lit("# Report on "), "ticker", F.lit("\n\n| Year | Metric | Value | Growth |\n| --- | --- | --- | --- |\n"))
    return rows.select("ticker", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("report"))


def guarded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of the inbound guard for all distinct messages."""
    rows = table(spark, sf_dir, "chat_requests").select("request_id", "message", "temperature").distinct()
    return guard_inbound(rows).groupBy("blocked", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"), F.count_if(F.col("clean") != F.coalesce("message", F.lit(""))).alias("n_masked"))


def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings on all distinct responses, and how many have figures beyond their question's."""
    asks = table(spark, sf_dir, "chat_requests").groupBy("request_id").agg(F.min("message").alias("context"))
    rows = table(spark, sf_dir, "chat_responses").groupBy("request_id").agg(F.min("response").alias("answer")).join(asks, "request_id")
    out = verify_figures(check_outbound(rows))
    return out.groupBy(F.array_join("warnings", ",").alias("warnings"), "faithful").agg(F.count("*").alias("n"))


def company_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all companies' metrics."""
    return metric_report(filings.latest_metrics(spark, sf_dir).where(F.col("filing_year").isNotNull()))


QUERIES = {f.__name__: f for f in (guarded_requests, checked_answers, company_reports)}
SQL: dict[str, str] = {}
