"""Chunking: sentences, semantic segments, recursive splits, parent and child chunks, markdown sections and page packs."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.text import chunk_tokens
from ..session import spread, table
from .vectors import cosine

# Abbreviations that don't end a sentence.
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "vs.", "etc.", "e.g.", "i.e.", "approx.", "inc.", "ltd.", "dept.", "fig.", "al.", "no.", "vol.", "est.",
                 "jan.", "feb.", "mar.", "apr.", "jun.", "jul.", "aug.", "sep.", "oct.", "nov.", "dec.")
BOUNDARY = r"""(?<=[.?!])\s+(?=[A-Z0-9"'(\[#])"""
DIMENSIONS = 256
_TERM = re.compile(r"\w+(?:[-_]\w+)*")
MIN_CHARS, MAX_CHARS = 100, 1800
THRESHOLDS = ("percentile", "standard_deviation", "interquartile", "gradient", "fixed")


def sentences(text: Column) -> Column:
    """Sentences in order: paragraphs at blank lines, fenced blocks whole, abbreviations and initials kept together."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")

    def split_one(p: Column) -> Column:
        parts = F.transform(F.split(p, BOUNDARY), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
        last = lambda acc: F.lower(F.regexp_extract(F.element_at(acc, -1), r"(\S+)$", 1))
        open_ended = lambda acc: last(acc).isin(*ABBREVIATIONS) | last(acc).rlike(r"^[\p{L}]\.$")
        joined = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(
            (F.size(acc) > 0) & open_ended(acc), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), s)))).otherwise(F.concat(acc, F.array(s))))
        fenced = p.startswith("```") & p.endswith("```")
        return F.when(fenced, F.array(p)).otherwise(F.filter(joined, lambda s: s != ""))

    return F.flatten(F.transform(paragraphs, split_one))


_BLANK = " \t\n\x0b\f\r"
_BOUNDARY = re.compile(BOUNDARY, re.ASCII)
_LAST = re.compile(r"\S+$", re.ASCII)


def sentence_list(text: str) -> list[str]:
    """As `sentences`, for one text within a task; linear in its length."""
    out = []
    for p in (p.strip(_BLANK) for p in text.split("\n\n")):
        if not p:
            continue
        if p.startswith("```") and p.endswith("```"):
            out.append(p)
            continue
        held: list[str] = []
        groups: list[list[str]] = []
        for part in (x.strip(_BLANK) for x in _BOUNDARY.split(p)):
            last = _LAST.search(held[-1]) if held else None
            word = last.group().lower() if last else ""
            if held and (word in ABBREVIATIONS or (len(word) == 2 and word[1] == "." and word[0].isalpha())):
                held.append(part)
            else:
                held = [part]
                groups.append(held)
        out += [s for s in (" ".join(g) for g in groups) if s]
    return out


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, sentence) of every document with text."""
    rows = _exploded(docs, id_col, text_col, lambda t: [("", x) for x in sentence_list(t)])
    return rows.select(id_col, F.col("chunk_index").alias("n"), F.col("chunk").alias("sentence"))


def _vector(t: str | None) -> np.ndarray:
    found = [zlib.crc32(w.encode()) % DIMENSIONS for w in _TERM.findall((t or "").lower())]
    return np.bincount(found, minlength=DIMENSIONS).astype(float)


@F.pandas_udf(ArrayType(DoubleType()))
def hashed_vector(text: pd.Series) -> pd.Series:
    """Offline stand-in for an embedding model: term counts hashed into DIMENSIONS buckets (Arrow batches)."""
    return text.map(_vector, na_action=None)


def distance_rows(docs: DataFrame, id_col: str, text_col: str, buffer: int) -> DataFrame:
    """(id, n, sentence, distance): sentences with the cosine distance of their window to the next one's, null for the last; one narrow stage."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, at, said, far = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                parts = sentence_list(t) if t else []
                if not parts:
                    continue
                v = [_vector(" ".join(parts[max(0, k - buffer) : k + buffer + 1])) for k in range(len(parts))]
                size = [float(np.sqrt(x @ x)) for x in v]
                near = [float(a @ b) / (m * n) if m and n else 0.0 for a, b, m, n in zip(v, v[1:], size, size[1:])]
                index += [i] * len(parts)
                at += range(len(parts))
                said += parts
                far += [max(0.0, 1.0 - c) for c in near] + [None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int32())), pa.array(at, pa.int32()), pa.array(said, pa.string()), pa.array(far, pa.float64())], ["chunk_key", "n", "sentence", "distance"])

    src = spread(docs.select(F.col(id_col).alias("chunk_key"), F.col(text_col).alias("chunk_text")))
    return src.mapInArrow(run, f"chunk_key {kind}, n int, sentence string, distance double").withColumnRenamed("chunk_key", id_col)


def size_list(parts: list[str], low: int = MIN_CHARS, high: int = MAX_CHARS) -> list[str]:
    """As `guard_sizes`, with parts beyond `high` packed anew by sentences; linear, within a task."""
    done: list[str] = []
    held: list[str] = []
    width = 0
    for c in (c for c in parts if c.strip(" ")):
        both = width + 1 + len(c) if held else len(c)
        if len(c) < low:
            held.append(c)
            width = both
        elif both <= high or not held:
            done.append(" ".join([*held, c]))
            held, width = [], 0
        else:
            done.append(" ".join(held))
            held, width = [c], len(c)
    if held:
        rest = " ".join(held)
        if done and len(done[-1]) + len(rest) + 1 <= high:
            done[-1] = f"{done[-1]} {rest}"
        else:
            done.append(rest)
    out = []
    for c in done:
        if len(c) <= high:
            out.append(c)
            continue
        cur: list[str] = []
        n = 0
        for x in sentence_list(c):
            if cur and n + len(x) + 1 > high:
                out.append(" ".join(cur))
                cur, n = [], 0
            cur.append(x)
            n += len(x) + 1
        if cur:
            out.append(" ".join(cur))
    return out


def _threshold(rows: DataFrame, id_col: str, kind: str, amount: float) -> DataFrame:
    """(id, threshold) of each document's distances, by one of five rules; a single distance is its own threshold."""
    by = rows.where(F.col("distance").isNotNull())
    if kind == "fixed":
        out = by.groupBy(id_col).agg(F.lit(float(amount)).alias("t"), F.count("*").alias("n"), F.first("distance").alias("one"))
    elif kind == "percentile":
        out = by.groupBy(id_col).agg(F.percentile("distance", min(100.0, max(0.0, amount)) / 100).alias("t"), F.count("*").alias("n"), F.first("distance").alias("one"))
    elif kind == "standard_deviation":
        out = by.groupBy(id_col).agg((F.avg("distance") + F.lit(amount) * F.coalesce(F.stddev_samp("distance"), F.lit(0.0))).alias("t"), F.count("*").alias("n"), F.first("distance").alias("one"))
    elif kind == "interquartile":
        d = F.sort_array(F.collect_list("distance"))  # one document's sentences
        q = lambda p: F.element_at("d", F.floor(F.size("d") * F.lit(p)).cast("int") + 1)
        out = by.groupBy(id_col).agg(d.alias("d"), F.count("*").alias("n"), F.first("distance").alias("one")).withColumn("t", q(0.75) + F.lit(1.5 if amount == 95.0 else amount) * (q(0.75) - q(0.25))).drop("d")
    elif kind == "gradient":
        step = F.abs(F.lead("distance").over(Window.partitionBy(id_col).orderBy("n")) - F.col("distance"))
        out = by.withColumn("g", step).groupBy(id_col).agg((F.avg("g") + F.lit(amount * 0.01) * F.coalesce(F.stddev_samp("g"), F.lit(0.0))).alias("t"), F.count("*").alias("n"), F.first("distance").alias("one"))
    else:
        raise ValueError(f"unknown threshold {kind!r}")
    return out.select(id_col, F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("t")).alias("threshold"))


def guard_sizes(chunks: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """Merge fragments shorter than `low` into what follows (the last one into what precedes) while they fit `high`."""
    kind = "struct<done:array<string>,held:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held")).cast(kind)

    def step(acc: Column, c: Column) -> Column:
        both = F.when(acc["held"] == "", c).otherwise(F.concat_ws(" ", acc["held"], c))
        fits = F.length(both) <= high
        keep = lambda done, held: F.struct(done.alias("done"), held.alias("held")).cast(kind)
        return (F.when(F.length(c) < low, keep(acc["done"], both)).when(fits | (acc["held"] == ""), keep(F.concat(acc["done"], F.array(both)), F.lit("")))
                .otherwise(keep(F.concat(acc["done"], F.array(acc["held"])), c)))

    def finish(acc: Column) -> Column:
        last = F.try_element_at(acc["done"], F.lit(-1))
        merged = F.concat(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, acc["held"])))
        return F.when(acc["held"] == "", acc["done"]).when((F.size(acc["done"]) > 0) & (F.length(last) + F.length(acc["held"]) + 1 <= high), merged).otherwise(F.concat(acc["done"], F.array(acc["held"])))

    return F.aggregate(F.filter(chunks, lambda c: F.trim(c) != ""), start, step, finish)


def pack(parts: Column, size: int, sep: str) -> Column:
    """Greedy packing of `parts` in order: a pack is closed before the part that would exceed `size`; parts are never cut."""
    kind = "struct<done:array<string>,cur:string,n:int>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n")).cast(kind)

    def step(acc: Column, p: Column) -> Column:
        width = F.length(p) + len(sep)
        full = acc["cur"].isNotNull() & (acc["n"] + width > size)
        closed = F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), p.alias("cur"), width.alias("n")).cast(kind)
        more = F.struct(acc["done"].alias("done"), F.when(acc["cur"].isNull(), p).otherwise(F.concat(acc["cur"], F.lit(sep), p)).alias("cur"), (acc["n"] + width).alias("n")).cast(kind)
        return F.when(full, closed).otherwise(more)

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def semantic_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: str = "percentile", amount: float = 90.0, buffer: int = 1) -> DataFrame:
    """(id, chunk_index, chunk): sentences cut where the distance of neighbouring windows exceeds the document's threshold.

    Sentences and distances come from one pass over each text; thresholds and cuts are aggregates and windows per document; small
    pieces are merged and oversize ones packed anew by sentences.
    """
    if threshold not in THRESHOLDS:
        raise ValueError(f"unknown threshold {threshold!r}")
    w = Window.partitionBy(id_col).orderBy("n")
    rows = distance_rows(docs, id_col, text_col, buffer)
    cut = rows.join(_threshold(rows, id_col, threshold, amount), id_col, "left").withColumn("cut", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)).cast("int"))
    seg = cut.withColumn("seg", F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = seg.groupBy(id_col, "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda s: s["sentence"]), " ").alias("part"))
    whole = parts.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "part"))), lambda s: s["part"]).alias("parts"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, c) for i, p in enumerate(batch.column(1).to_pylist()) for n, c in enumerate(size_list(p))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["chunk_key", "chunk_index", "chunk"])

    return whole.select(F.col(id_col).alias("chunk_key"), "parts").mapInArrow(run, f"chunk_key {kind}, chunk_index int, chunk string").withColumnRenamed("chunk_key", id_col)


# --- helpers that walk one text (sequential by definition) -----------------------------------------------------------


def recursive_split(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that does, with up to `overlap` repeated."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    units = list(text) if sep == "" else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out: list[str] = []
    held: list[str] = []
    width = 0

    def close() -> None:
        nonlocal width
        piece = "".join(held).strip()
        if piece:
            out.append(piece)
        while held and (width > overlap):
            width -= len(held.pop(0))

    for u in (u for u in units if u):
        if len(u) > size and finer:
            if held:
                close()
                held.clear()
                width = 0
            out += recursive_split(u, size, overlap, finer)
            continue
        if held and width + len(u) > size:
            close()
            while held and width + len(u) > size:
                width -= len(held.pop(0))
        held.append(u)
        width += len(u)
    piece = "".join(held).strip()
    if piece:
        out.append(piece)
    return out


_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def markdown_sections(text: str, title: str = "Document") -> list[tuple[str, str]]:
    """(breadcrumb, content) of each section with content; headings in fenced blocks are content."""
    stack, body, out, fenced = {1: title}, [], [], False

    def close() -> None:
        content = "\n".join(body).strip()
        body.clear()
        if content:
            out.append((" > ".join(stack[k] for k in sorted(stack)), content))

    for line in text.split("\n"):
        if line.strip().startswith("```"):
            fenced = not fenced
        head = None if fenced else _HEADING.match(line)
        if head:
            close()
            level = len(head.group(1))
            stack = {k: v for k, v in stack.items() if k < level} | {level: head.group(2).strip()}
        else:
            body.append(line)
    close()
    return out


def _exploded(docs: DataFrame, id_col: str, text_col: str, pieces: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """(id, chunk_index, crumb, chunk) by a helper over each text; one narrow stage."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, a, b) for i, t in enumerate(batch.column(1).to_pylist()) if t for n, (a, b) in enumerate(pieces(t))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())],
                                             ["chunk_key", "chunk_index", "crumb", "chunk"])

    src = spread(docs.select(F.col(id_col).alias("chunk_key"), F.col(text_col).alias("chunk_text")))
    return src.mapInArrow(run, f"chunk_key {kind}, chunk_index int, crumb string, chunk string").withColumnRenamed("chunk_key", id_col)


def recursive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, chunk) by recursive splitting."""
    return _exploded(docs, id_col, text_col, lambda t: [("", c) for c in recursive_split(t, size, overlap)]).drop("crumb")


def markdown_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1200) -> DataFrame:
    """(id, chunk_index, chunk): sections under their breadcrumb, large ones in numbered parts packed by sentences."""
    rows = _exploded(docs, id_col, text_col, markdown_sections)
    parts = F.when(F.length("chunk") <= size, F.array("chunk")).otherwise(pack(sentences(F.col("chunk")), size, " "))
    named = F.transform(parts, lambda p, i: F.concat(F.lit("["), F.col("crumb"), F.when(F.length("chunk") > size, F.concat(F.lit(" (Part "), (i + 1).cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit("]\n"), p))
    return rows.select(id_col, "chunk_index", F.posexplode(named).alias("part", "chunk"))


# Where code is cut, coarsest first.
CODE_SEPARATORS = {
    "python": ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""), "js": ("\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""),
    "java": ("\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""), "go": ("\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""),
}


def code_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language: str = "python", size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, chunk) of source code, cut at its language's own boundaries; an unknown language is refused."""
    if language not in CODE_SEPARATORS:
        raise ValueError(f"unknown language {language!r}")
    return _exploded(docs, id_col, text_col, lambda t: [("", c) for c in recursive_split(t, size, overlap, CODE_SEPARATORS[language])]).drop("crumb")


def smart_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, chunk): semantic chunks, and recursive ones of the documents of which those make none or one beyond `size`."""
    semantic = semantic_chunks(docs, id_col, text_col)
    fits = semantic.groupBy(id_col).agg((F.max(F.length("chunk")) <= MAX_CHARS).alias("ok")).where("ok").select(id_col)
    return semantic.join(fits, id_col, "left_semi").unionByName(recursive_chunks(docs.join(fits, id_col, "left_anti"), id_col, text_col, size, overlap))


def parent_child(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parent: int = 1600, child: int = 350) -> tuple[DataFrame, DataFrame]:
    """Parents (parent_id, id, parent_text) and children (parent_id, chunk_index, chunk); ids are hashes of document and position."""
    parents = recursive_chunks(docs, id_col, text_col, parent, 200).select(F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), "chunk_index"), 256).alias("parent_id"), id_col, F.col("chunk").alias("parent_text"))
    return parents, recursive_chunks(parents, "parent_id", "parent_text", child, 50)


def page_packs(pages: DataFrame, id_col: str = "id", text_col: str = "content", size: int = 1200) -> DataFrame:
    """(id, chunk_index, chunk): pages packed by paragraphs, each chunk under the page's breadcrumb."""
    crumb = F.regexp_extract(text_col, r"(?s)^(\[Company:.*?\]\n\n)", 1)
    body = F.substring(F.col(text_col), F.length(crumb) + 1, F.length(text_col))
    chunks = F.when(F.length(text_col) <= size, F.array(text_col)).otherwise(F.transform(pack(F.split(body, "\n\n"), size, "\n\n"), lambda c: F.concat(crumb, c)))
    return pages.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(chunks).alias("chunk_index", "chunk"))


STRATEGIES = {"semantic": semantic_chunks, "smart": smart_chunks, "code": code_chunks, "parent_child": lambda *a, **o: parent_child(*a, **o)[1], "recursive": recursive_chunks, "markdown": markdown_chunks, "page": page_packs}


def chunk(docs: DataFrame, strategy: str, id_col: str, text_col: str, **options) -> DataFrame:
    """Chunks by a named strategy; an unknown name is refused."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return STRATEGIES[strategy](docs, id_col, text_col, **options)


def chunk_metrics(chunks: DataFrame, text_col: str = "chunk") -> DataFrame:
    """One row: count, characters, tokens, least, largest, mean, median and deviation."""
    n = F.length(text_col)
    return chunks.agg(F.count("*").alias("n_chunks"), F.sum(n).alias("total_chars"), F.sum(chunk_tokens(F.col(text_col))).alias("total_tokens"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"),
                      F.round(F.avg(n), 2).alias("mean_chars"), F.median(n).alias("median_chars"), F.round(F.coalesce(F.stddev_samp(n), F.lit(0.0)), 2).alias("stdev_chars"))


def compress(contexts: DataFrame, budget: int = 60) -> DataFrame:
    """(id, compressed): the sentences of `context` most like `query` within a token budget; short contexts stay whole.

    Sentences longer than ten characters are scored by hashed cosine plus 0.05 for each shared word, taken in that order, and
    skipped where they don't fit; columns id, context, query.
    """
    parts = F.filter(F.transform(F.split("context", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    rows = contexts.select("id", "context", "query", F.posexplode(parts).alias("n", "s"))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    score = cosine(hashed_vector(F.col("query")), hashed_vector(F.col("s"))) + F.size(F.array_intersect(words(F.col("query")), words(F.col("s")))) * F.lit(0.05)
    ranked = rows.withColumn("score", F.round(score, 6)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "n", "s"))).alias("c"))
    kind = "struct<used:int,kept:array<string>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept")).cast(kind)
    take = F.aggregate("c", start, lambda acc, x: F.when(acc["used"] + chunk_tokens(x["s"]) <= budget, F.struct((acc["used"] + chunk_tokens(x["s"])).alias("used"), F.concat(acc["kept"], F.array(x["s"])).alias("kept")).cast(kind)).otherwise(acc), lambda acc: F.array_join(acc["kept"], " "))
    best = ranked.select("id", take.alias("best"))
    return contexts.join(best, "id", "left").select("id", F.when(chunk_tokens(F.col("context")) <= budget, F.trim("context")).otherwise(F.coalesce("best", F.lit(""))).alias("compressed"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "financebench_docs").select("id", "content").distinct()


def sentence_split(spark, sf_dir):
    """Sentences of every document."""
    return sentence_rows(_docs(spark, sf_dir))


def semantic_chunking(spark, sf_dir):
    """Semantic chunks of every document."""
    return semantic_chunks(_docs(spark, sf_dir))


def recursive_chunking(spark, sf_dir):
    """Recursive chunks of every document."""
    return recursive_chunks(_docs(spark, sf_dir))


def markdown_chunking(spark, sf_dir):
    """Sections of every document."""
    return markdown_chunks(_docs(spark, sf_dir))


def page_packing(spark, sf_dir):
    """Packed chunks of every page."""
    return page_packs(_pages(spark, sf_dir))


def small_to_big(spark, sf_dir):
    """Children of every document with the length of their parents."""
    parents, children = parent_child(_docs(spark, sf_dir))
    return children.join(parents, "parent_id").select("doc_id", "parent_id", "chunk_index", "chunk", F.length("parent_text").alias("parent_chars"))


def chunk_statistics(spark, sf_dir):
    """Metrics of the page packs."""
    return chunk_metrics(page_packing(spark, sf_dir))


def context_compression(spark, sf_dir):
    """Answers compressed towards their questions."""
    asks = table(spark, sf_dir, "chat_requests").where(F.col("message").isNotNull()).groupBy("request_id").agg(F.min("message").alias("query"))
    told = table(spark, sf_dir, "chat_responses").where(F.col("response").isNotNull()).groupBy("request_id").agg(F.min("response").alias("context"))
    return compress(told.join(asks, "request_id").withColumnRenamed("request_id", "id"))


QUERIES = {f.__name__: f for f in (sentence_split, semantic_chunking, recursive_chunking, markdown_chunking, page_packing, small_to_big, chunk_statistics, context_compression)}
_PACKS = r"""WITH RECURSIVE pages AS (SELECT DISTINCT id, content FROM financebench_docs WHERE content IS NOT NULL),
long AS (SELECT id, content, regexp_extract(content, '(?s)^(\[Company:.*?\]\n\n)', 1) AS crumb FROM pages WHERE length(content) > 1200),
lists AS (SELECT id, crumb, string_split(substr(content, length(crumb) + 1), chr(10) || chr(10)) AS l FROM long),
parts AS (SELECT id, crumb, unnest(l) AS part, unnest(range(1, len(l) + 1)) AS n FROM lists),
walk AS (SELECT id, n, length(part) + 2 AS w, 0 AS pack FROM parts WHERE n = 1 UNION ALL
SELECT p.id, p.n, CASE WHEN k.w + length(p.part) + 2 > 1200 THEN length(p.part) + 2 ELSE k.w + length(p.part) + 2 END, k.pack + CASE WHEN k.w + length(p.part) + 2 > 1200 THEN 1 ELSE 0 END FROM walk k JOIN parts p ON p.id = k.id AND p.n = k.n + 1),
packs AS (SELECT id, pack AS chunk_index, any_value(crumb) || string_agg(part, chr(10) || chr(10) ORDER BY n) AS chunk FROM walk JOIN parts USING (id, n) GROUP BY id, pack UNION ALL SELECT id, 0, content FROM pages WHERE length(content) <= 1200)
"""
SQL: dict[str, str] = {
    "page_packing": _PACKS + "SELECT * FROM packs",
    "chunk_statistics": _PACKS + "SELECT count(*) AS n_chunks, sum(n)::BIGINT AS total_chars, sum(greatest(1, ceil(n / 4.0::DOUBLE)))::BIGINT AS total_tokens, min(n) AS min_chars, max(n) AS max_chars, round(avg(n), 2) AS mean_chars, median(n) AS median_chars, round(coalesce(stddev_samp(n), 0), 2) AS stdev_chars FROM (SELECT length(chunk) AS n FROM packs)",
}
