import json

import pytest
from pyspark.sql import functions as F

from marlspike.sources import loaders, stores


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "node_modules").mkdir()
    (root / "a.txt").write_text("Grüße\n", "utf-8")
    (root / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (root / "sub" / "c.md").write_bytes(b"\xef\xbb\xbf# T")
    (root / "d.bin").write_bytes(b"x")
    (root / ".hidden" / "e.txt").write_text("no")
    (root / "node_modules" / "f.txt").write_text("no")
    return root


def test_text(spark, tree):
    got = {r.source: r.text for r in loaders.text_documents(spark, str(tree)).collect()}
    assert got == {"a.txt": "Grüße\n", "b.txt": "café", "c.md": "# T"}
    with pytest.raises(FileNotFoundError):
        loaders.files(spark, str(tree / "missing"))


def test_csv_json(spark, tmp_path):
    (tmp_path / "data.csv").write_text('name,role\nAnn,"lead\nx"\nBob,\n')
    row = loaders.csv_documents(spark, str(tmp_path / "data.csv")).first()
    assert row.row_count == 2 and row.text == "Row 1: name: Ann, role: lead\nx\nRow 2: name: Bob, role: "
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "good.json").write_text('{"b": [1, 2], "a": null}')
    (tmp_path / "j" / "bad.json").write_text("{not json")
    got = {r.source: r.text for r in loaders.json_documents(spark, str(tmp_path / "j")).collect()}
    assert json.loads(got["good.json"]).get("b") == [1, 2] and got["bad.json"] == "{not json"
    (tmp_path / "m.jsonl").write_text('{"k": "a", "v": 1}\n{"k": "a", "v": 2}\n')
    assert [(r.k, r.v) for r in loaders.jsonl_by_key(spark, str(tmp_path / "m.jsonl"), "k", "k string, v int").collect()] == [("a", 2)]
    assert loaders.jsonl_by_key(spark, str(tmp_path / "none"), "k", "k string, v int").count() == 0


def test_incremental(spark, tree, tmp_path):
    manifest = str(tmp_path / "manifest")
    first = loaders.pending(loaders.files(spark, str(tree)), loaders.read_manifest(spark, manifest))
    assert first.count() == 3
    loaders.append_manifest(first, manifest)
    (tree / "a.txt").write_text("changed")
    again = loaders.pending(loaders.files(spark, str(tree)), loaders.read_manifest(spark, manifest))
    assert [r.name for r in again.collect()] == ["a.txt"]
    assert loaders.pending(loaders.files(spark, str(tree)), loaders.read_manifest(spark, manifest), force=True).count() == 3


def test_dead_letters(spark, tmp_path):
    df = spark.createDataFrame([("f1", "good"), ("f2", "x" * 400), ("f3", None)], "file string, text string")
    kept = loaders.dead_letters(df, F.length("text") > 300, "too long", "file", "text", str(tmp_path / "dlq"))
    assert {r.file for r in kept.collect()} == {"f1", "f3"}
    assert [(r.file, len(r.snippet)) for r in spark.read.json(str(tmp_path / "dlq")).collect()] == [("f2", 300)]


def test_store(spark, tmp_path):
    store = stores.ChunkStore(spark, str(tmp_path / "s"), "id string, content string, company string, filing_year int, metadata string")
    assert store.count() == 0
    rows = [("1", "a", "X", 2020, '{"p": "7"}'), ("2", "b", "Y", 2021, None)]
    store.upsert(spark.createDataFrame(rows, store.schema))
    store.upsert(spark.createDataFrame([("2", "b2", "Y", 2022, None), (None, "n", "n", 1, None)], store.schema))
    assert {(r.id, r.content) for r in store.read().collect()} == {("1", "a"), ("2", "b2")}
    assert [r.id for r in store.read().where(stores.where({"company": "X", "p": "7"})).collect()] == ["1"]
    assert store.read().where(stores.where({"$or": [{"company": "X"}, {"year": "2022"}]})).count() == 2
    store.delete(spark.createDataFrame([("1",)], "id string"))
    assert [r.id for r in store.read().collect()] == ["2"]
    store.reset()
    assert store.count() == 0


def test_sanitise(spark):
    df = spark.createDataFrame([(None, [1, 2], "a\x00b")], "a string, b array<int>, c string")
    assert tuple(stores.sanitise(df, ["a", "b", "c"]).first()) == ("", "[1,2]", "ab")


def test_load_by_target(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b": [1, "ü"]}')
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "d.txt").write_text("hidden")
    (tmp_path / "e.TXT").write_text("shown")
    (tmp_path / "f.bin").write_bytes(b"\x00")
    assert loaders.load(spark, str(tmp_path / "a.json")).first().text == '{\n  "b": [\n    1,\n    "ü"\n  ]\n}'
    assert loaders.load(spark, str(tmp_path / "bad.json")).first().text == "{no"
    assert loaders.load(spark, str(tmp_path / "c.csv")).first().text == "Row 1: x: 1, y: 2"
    assert {r.source for r in loaders.load(spark, str(tmp_path)).collect()} == {"a.json", "bad.json", "c.csv", "e.TXT"}
    assert [tuple(r) for r in loaders.from_texts(spark, ["t"]).collect()] == [("0", "t", "string")]
    with pytest.raises(FileNotFoundError):
        loaders.load(spark, str(tmp_path / "none.txt"))
    with pytest.raises(ValueError):
        loaders.load(spark, "https://x.test/a")
    with pytest.raises(FileNotFoundError):
        loaders.jsonl_by_key(spark, str(tmp_path / "qa.jsonl"), "id", "id string", required=True)


def test_evaluation_set_and_report(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"question": "q", "expected_answer": "a"}, {"question": "r", "reference": "b"}, {"question": "s"}]')
    rows = loaders.evaluation_set(spark, str(tmp_path / "e.json"))
    assert {tuple(r) for r in rows.collect()} == {("q", "a"), ("r", "b"), ("s", None)}
    loaders.write_report(rows.groupBy().count(), rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/summary")).first()["count"] == 3 and spark.read.json(str(tmp_path / "out/details")).count() == 3


def test_unreadable_manifest_is_an_error(spark, tmp_path):
    assert loaders.read_manifest(spark, str(tmp_path / "m")).count() == 0
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "part-0.parquet").write_bytes(b"broken")
    with pytest.raises(Exception):
        loaders.read_manifest(spark, str(tmp_path / "m")).count()
