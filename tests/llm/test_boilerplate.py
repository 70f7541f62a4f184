import collections
import random

import pytest

from marlspike.llm import boilerplate as bp

SCHEMA = "id string, content string, company string, line_no int"


def brute(rows):
    fold = lambda s: "".join(c.lower() for c in s if c.isalnum())
    pages = {}
    for i, content, company, _ in rows:
        if i is not None and company is not None:
            pages[i] = (content or "", company)
    size, ids, places = collections.Counter(c for _, c in pages.values()), collections.defaultdict(set), collections.defaultdict(list)
    for i, (content, company) in pages.items():
        for n, line in enumerate(content.split("\n"), 1):
            if n > 1 and fold(line):
                ids[company, fold(line)].add(i)
                places[company, fold(line)].append((i, n))
    return sorted(p for k, v in ids.items() if len(v) >= bp.MIN_PAGES and len(v) >= bp.MIN_SHARE * size[k[0]] for p in places[k])


def _rows(seed):
    rng = random.Random(seed)
    legal = ["All rights reserved; ask the Tornox office.", "Share · Print", "42", "Überblick – Größe", "a" * 400, "Subscribe to the very long newsletter of this company and its many subsidiaries today"]
    rows = []
    for i in range(120):
        company = rng.choice(["A", "A", "A", "B", "C", None])
        lines = ["[Company: x]"] + [rng.choice(legal) if rng.random() < 0.3 else " ".join(rng.choice(["net", "sales", "rose", str(rng.randrange(99))]) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 9))]
        lines = [f"  {x.upper()} ! " if rng.random() < 0.3 else x for x in lines]
        rows.append((f"p{i}", "\n".join(lines), company, 0))
    rows += rows[:20] + [("n1", None, "A", 0), ("n2", "", "B", 1), (None, rows[0][1], "A", 1), ("l", "x\n" + "Share · Print\n" * 20_000, "A", 2)]
    return rows


@pytest.mark.parametrize("limit", [bp.MAX_BROADCAST_CHUNKS, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(bp, "MAX_BROADCAST_CHUNKS", limit)
    rows = _rows(5)
    got = sorted((r.id, r.line_no) for r in bp.find_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows) and got


def test_removal_and_empty(spark):
    rows = [(f"p{i}", f"[c]\nown {i}\nSHARE this page\n\nend {i * 7}", "A", 0) for i in range(5)]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    got = {r.id: r.content for r in bp.remove_lines(df, bp.find_repeated_lines(df)).collect()}
    assert got == {f"p{i}": f"[c]\nown {i}\n\nend {i * 7}" for i in range(5)}
    assert bp.find_repeated_lines(df.limit(0)).count() == 0


def test_chunks_do_not_depend_on_neighbours():
    line = "Forward-looking statements on this page are subject to the risks listed elsewhere by the company"
    alone, among = bp.LineChunks([line]), bp.LineChunks(["some other text\n" + line.upper() + "\nmore", "x"])
    assert set(alone.hash.tolist()) <= set(among.hash.tolist())
