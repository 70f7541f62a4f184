import math
import re

import pytest
from pyspark.sql import functions as F

from marlspike.operators import chunking as ch

TEXT = "Dr. Smith met Mr. J. Doe at Acme Inc. Offices. He said it rose! Did it? Yes, approx. 5 units. (It did.)\n\n```\ncode. More Code.\n```\n\nSecond paragraph here. Next one."


def plain_sentences(text):
    out = []
    for p in (q.strip() for q in text.split("\n\n")):
        if not p:
            continue
        if p.startswith("```") and p.endswith("```"):
            out.append(p)
            continue
        acc = []
        for s in (x.strip() for x in re.split(ch.BOUNDARY, p)):
            last = acc[-1].split()[-1].lower() if acc and acc[-1].split() else ""
            if acc and (last in ch.ABBREVIATIONS or re.match(r"^[^\W\d_]\.$", last)):
                acc[-1] += " " + s
            else:
                acc.append(s)
        out += [a for a in acc if a]
    return out


def plain_pack(parts, size, sep):
    done, cur, n = [], [], 0
    for p in parts:
        if cur and n + len(p) + len(sep) > size:
            done.append(sep.join(cur))
            cur, n = [], 0
        cur.append(p)
        n += len(p) + len(sep)
    return done + ([sep.join(cur)] if cur else [])


def test_sentences(spark):
    texts = [TEXT, "", None, "One.", "A. B. C. Done. Next", "x" * 20_000 + ". End. Now."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {}
    for r in ch.sentence_rows(df).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert got == {i: plain_sentences(t) for i, t in enumerate(texts) if t}


def test_packing(spark):
    page = "[Company: A | Page: 1/2]\n\n" + "\n\n".join("word " * n for n in (100, 80, 300, 5, 5, 90))
    df = spark.createDataFrame([("a", page), ("b", "short"), ("c", None)], "id string, content string")
    got = {}
    for r in ch.page_packs(df).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.chunk)
    crumb, body = page[:26], page[26:]
    assert got == {"a": [crumb + c for c in plain_pack(body.split("\n\n"), 1200, "\n\n")], "b": ["short"]}


def test_recursive_split():
    text = "\n\n".join("alpha beta gamma " * n for n in (3, 60, 1)) + "z" * 1300
    parts = ch.recursive_split(text)
    assert all(0 < len(p) <= 500 for p in parts)
    assert set("".join(parts).replace(" ", "").replace("\n", "")) == set(text.replace(" ", "").replace("\n", ""))
    assert ch.recursive_split("short") == ["short"] and ch.recursive_split(" ") == []
    words = " ".join(str(i) for i in range(400))
    assert [w for w in dict.fromkeys(" ".join(ch.recursive_split(words)).split())] == words.split()


def test_markdown():
    md = "intro\n# A\ntext a\n## B\ntext b\n```\n# not a heading\n```\n# C\n\ntext c"
    assert ch.markdown_sections(md) == [("Document", "intro"), ("A", "text a"), ("A > B", "text b\n```\n# not a heading\n```"), ("C", "text c")]


@pytest.mark.parametrize("kind", ch.THRESHOLDS)
def test_semantic_keeps_all_sentences(spark, kind):
    text = " ".join(f"The {w} of the company rose in year {i}, and the board approved more {w} spending for the next period." for i, w in enumerate("sales sales sales fish fish boats boats boats sales".split()))
    df = spark.createDataFrame([(1, text), (2, "Only one sentence."), (3, None)], "doc_id int, text string")
    rows = ch.semantic_chunks(df, threshold=kind, amount=0.3 if kind == "fixed" else 90.0).orderBy("doc_id", "chunk_index").collect()
    assert " ".join(r.chunk for r in rows if r.doc_id == 1) == text
    assert [r.chunk for r in rows if r.doc_id == 2] == ["Only one sentence."]


def test_guard_sizes(spark):
    parts = ["a" * 50, "b" * 60, "c" * 150, "d" * 1790, "e" * 40]
    got = spark.createDataFrame([(parts,)], "p array<string>").select(ch.guard_sizes(F.col("p")).alias("g")).first().g
    assert got == ["a" * 50 + " " + "b" * 60 + " " + "c" * 150, "d" * 1790, "e" * 40]


def test_compress(spark):
    ctx = "Fish swim in the cold sea. Revenue rose by five percent in the year. Boats are made of wood and steel. " * 6
    df = spark.createDataFrame([(1, ctx, "How much did revenue rise in the year?"), (2, "short text", "q")], "id int, context string, query string")
    got = {r.id: r.compressed for r in ch.compress(df, 30).collect()}
    assert got[2] == "short text" and "Revenue rose" in got[1] and len(got[1]) < len(ctx) and math.ceil(len(got[1]) / 4) <= 32


def test_unknown(spark):
    with pytest.raises(ValueError):
        ch.chunk(None, "nope", "a", "b")


def test_helpers_equal_the_columns(spark):
    """The linear helpers of the tasks against the column expressions, on given documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text")
    rows = docs.select("text", ch.sentences(F.col("text")).alias("s")).withColumn("g", ch.guard_sizes(F.col("s"))).collect()
    for r in rows:
        assert ch.sentence_list(r.text) == r.s
        if all(len(c) <= ch.MAX_CHARS for c in r.g):
            assert ch.size_list(r.s) == r.g


def test_code_and_smart_chunks(spark):
    code = "import os\n\ndef a():\n    return 1\n\ndef b():\n    return 2\n" * 20
    df = spark.createDataFrame([(1, code), (2, None), (3, ""), (4, "One sentence."), (5, "x" * 5000)], "doc_id int, text string")
    cut = [r.chunk for r in ch.code_chunks(df).where("doc_id = 1").orderBy("chunk_index").collect()]
    assert all(len(c) <= 500 for c in cut) and cut[1].startswith("def ")
    with pytest.raises(ValueError):
        ch.code_chunks(df, language="cobol")
    got = {}
    for r in ch.smart_chunks(df).collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got[4] == ["One sentence."] and len(got[5]) >= 10 and 2 not in got and 3 not in got
