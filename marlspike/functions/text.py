"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*"
ZERO_WIDTH = "​‌‍﻿⁠‎‏"


def tokens(text: Column) -> Column:
    """Lower-case terms: runs of letters, digits and underscores, joined over single hyphens. Null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def clean_html(html: Column) -> Column:
    """Text of a page: script and style blocks dropped, tags to blanks, blank lines removed, lines trimmed."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    c = F.regexp_replace(c, r"(?s)<[^>]+>", " ")
    lines = F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def preview(text: Column, size: int = 120) -> Column:
    """First `size` characters of the collapsed text, with dots if it is longer."""
    c = collapse(text)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def normal_prompt(prompt: Column) -> Column:
    """Key form of a prompt: collapsed, lower case, closing punctuation off."""
    return F.regexp_replace(F.lower(collapse(F.coalesce(prompt, F.lit("")))), r"[?!.,;:]+$", "")


def estimate_tokens(text: Column) -> Column:
    """max(1, int((1.3 words + chars / 4) / 2)); 0 for empty or null."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    estimate = F.floor((words * F.lit(1.3) + F.length(text) / F.lit(4.0)) / F.lit(2.0))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), estimate)).cast("int")


def chunk_tokens(text: Column) -> Column:
    """max(1, ceil(chars / 4))."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0))).cast("int")


def query_lines(reply: Column) -> Column:
    """Lines of a model's reply as clean queries: numbering, bullets and quotes off, longer than two characters."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^(?:\d+[.)]\s*|[-*•]\s*)", ""))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[\"']+|[\"']+$", "")))
    return F.filter(lines, lambda x: F.length(x) > 2)


def format_history(turns: Column) -> Column:
    """`Role: content` lines of an array of (role, content), or a note where there is none."""
    lines = F.transform(turns, lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), t["content"]))
    return F.when(F.coalesce(F.size(turns), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit("None provided."))


def cache_key(model: Column, prompt: Column, temperature: Column) -> Column:
    """SHA-256 key over model, normal prompt and temperature with two decimals."""
    return F.concat(F.lit("llm:cache:"), F.sha2(F.concat_ws("|", F.coalesce(model, F.lit("")), normal_prompt(prompt), F.format_string("%.2f", F.coalesce(temperature, F.lit(0.0)))), 256))


def drop_nul(text: Column) -> Column:
    """Text without NUL characters."""
    return F.translate(text, "\x00", "")


def minify(text: Column) -> Column:
    """Non-blank lines, trimmed and joined by line feeds."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
