"""Readers that turn files into documents (doc_id, text, source, file_type, size), and incremental ingestion by manifest."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Folders and extensions of a directory scan.
IGNORED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", "env", ".idea", ".vscode", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages")
TEXT_EXTENSIONS = ("txt", "md", "markdown", "rst", "csv", "tsv", "json", "jsonl", "yaml", "yml", "xml", "html", "htm", "py", "js", "ts", "java", "go", "rs", "sql", "ini", "toml", "log")
MANIFEST = "path string, sha string, indexed_at timestamp"


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """(path, name, file_type, size, sha, content) of the files below `path`, hidden and ignored folders left out.

    A missing path is an error. Files are listed by the reader's own glob filter on the extension, so that others are never opened; the
    hidden and ignored folders among those left go before their content is hashed.
    """
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(either(e) for e in extensions) + "}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    inside = F.regexp_replace("path", "^.*?" + "/".join(path.rstrip("/").split("/")[-1:]).replace(".", "\\.") + "/", "")
    hidden = F.exists(F.split(inside, "/"), lambda p: p.startswith(".") | p.isin(*IGNORED_DIRS))
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return df.where(kind.isin(*extensions) & ~hidden).select("path", name.alias("name"), kind.alias("file_type"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha"), "content")


def decoded(content):
    """Text of bytes: UTF-8 with or without a mark, else Latin-1."""
    raw = content.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def text_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """One document per file."""
    df = files(spark, path, extensions)
    return df.select(F.col("path").alias("doc_id"), decoded(F.col("content")).alias("text"), F.col("name").alias("source"), "file_type", "size", "sha")


def load(spark: SparkSession, target: str) -> DataFrame:
    """Documents of a target, told by its form: a folder, or a file by its ending; web addresses are refused, missing paths an error."""
    if target.startswith(("http://", "https://")):
        raise ValueError(f"{target}: no network reader")
    if "://" not in target and not os.path.exists(target):
        raise FileNotFoundError(target)
    kind = target.rsplit(".", 1)[-1].lower() if not os.path.isdir(target) else ""
    readers = {"csv": csv_documents, "json": json_documents}
    return readers.get(kind, text_documents)(spark, target)


def from_texts(spark: SparkSession, texts: list[str], source: str = "string") -> DataFrame:
    """Documents (doc_id, text, source) of given texts, numbered from 0."""
    return spark.createDataFrame([(str(i), t, source) for i, t in enumerate(texts)], "doc_id string, text string, source string")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """(question, ground_truth) of a JSON array or of JSON lines; the truth may be named ground_truth, expected_answer or reference. A missing file is an error."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    rows = spark.read.schema("question string, ground_truth string, expected_answer string, reference string").option("multiLine", not path.endswith("jsonl")).json(path)
    return rows.select("question", F.coalesce("ground_truth", "expected_answer", "reference").alias("ground_truth"))


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """An evaluation report as JSON lines: summary rates, and a row for each question."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")


def csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per CSV file: `Row i: column: value, ...` lines and the number of rows; quoted line feeds are kept."""
    df = spark.read.option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    cols = df.columns
    line = F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in cols))
    rows = df.select(F.input_file_name().alias("doc_id"), F.monotonically_increasing_id().alias("at"), line.alias("line"))
    each = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))  # one file's rows
    return each.select("doc_id", F.array_join(F.transform("rows", lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), r["line"])), "\n").alias("text"), F.size("rows").alias("row_count"))


@F.pandas_udf(StringType())
def _indented(text: pd.Series) -> pd.Series:
    """JSON texts indented by two blanks, others as they stand (Arrow batches)."""

    def one(t: str) -> str:
        try:
            return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
        except ValueError:
            return t

    return text.map(one, na_action="ignore")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per JSON file, indented by two blanks where it is valid, else as it stands."""
    return text_documents(spark, path, ("json",)).withColumn("text", _indented("text"))


def jsonl_by_key(spark: SparkSession, path: str, key: str, schema: str, required: bool = False) -> DataFrame:
    """Rows of a JSON-lines file, the last of each key; a missing file is an empty table, or an error where it is `required`."""
    if "://" not in path and not os.path.exists(path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(path).withColumn("_at", F.monotonically_increasing_id())
    names = [c for c in rows.columns if c not in (key, "_at")]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.max_by(c, "_at").alias(c) for c in names))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of files indexed so far; a missing one is empty, an unreadable one an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path)


def pending(found: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files whose path and hash the manifest does not hold (all of them with `force`)."""
    return found if force else found.join(manifest.select("path", "sha"), ["path", "sha"], "left_anti")


def append_manifest(done: DataFrame, path: str) -> None:
    """Add (path, sha) of finished files to the manifest."""
    done.select("path", "sha", F.current_timestamp().alias("indexed_at")).write.mode("append").parquet(path)


def dead_letters(rows: DataFrame, bad, error: str, id_col: str, text_col: str, path: str) -> DataFrame:
    """Append the rows that meet `bad` to a JSON log with an error and 300 characters of text; the rest comes back."""
    rows.where(bad).select(F.current_timestamp().alias("timestamp"), F.col(id_col).alias("file"), F.lit(error).alias("error"), F.substring(text_col, 1, 300).alias("snippet")).write.mode("append").json(path)
    return rows.where(~F.coalesce(bad, F.lit(False)))
