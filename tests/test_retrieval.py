import math
import random

import pytest
from pyspark.sql import functions as F

from marlspike.operators import bm25, fusion, irmetrics, vectors
from marlspike.plans import retrieval

DOCS = [(1, "Net sales rose. Net profit rose."), (2, "Sales fell café"), (3, ""), (4, None), (5, "the cat sat"), (6, "Sales fell café")]


def _docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def test_bm25_by_hand(spark):
    index = bm25.build(_docs(spark))
    q = spark.createDataFrame([("a", "sales sales CAFÉ"), ("b", "unknown"), ("c", None)], "query_id string, query string")
    got = [(r.query_id, r.doc_id, r.rank, r.score) for r in bm25.search(index, q).orderBy("rank").collect()]
    assert [(r.query_id, r.doc_id, r.rank, r.score) for r in bm25.scan_search(_docs(spark), q, block_terms=2).orderBy("rank").collect()] == got
    n, avg = 6, (6 + 3 + 0 + 0 + 3 + 3) / 6
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    two = round(2 * idf(3) * part(1, 3) + idf(2) * part(1, 3), 4)
    assert got == [("a", 2, 1, two), ("a", 6, 2, two), ("a", 1, 3, round(2 * idf(3) * part(1, 6), 4))]


def test_index_maintenance(spark, tmp_path):
    index = bm25.build(_docs(spark)).upsert(spark.createDataFrame([(2, "new words"), (7, "sales")], "doc_id bigint, text string"))
    same = bm25.build(spark.createDataFrame([d for d in DOCS if d[0] != 2] + [(2, "new words"), (7, "sales")], "doc_id bigint, text string"))
    q = spark.createDataFrame([("a", "sales words cat")], "query_id string, query string")
    rows = lambda i: [tuple(r) for r in bm25.search(i, q).orderBy("rank").collect()]
    assert rows(index) == rows(same)
    index.write(str(tmp_path / "ix"))
    assert rows(bm25.Index.read(spark, str(tmp_path / "ix"))) == rows(same)
    assert bm25.search(bm25.build(_docs(spark).limit(0)), q).count() == 0


def _shuffled(spark):
    """Rows that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_index_search_shuffles_no_pairs(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "the sales of " + " ".join(rng.choices("abcdefghij", k=rng.randint(0, 9)))) for i in range(900)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(f"q{i:03}", f"the sales of {rng.choice('abcdefghij')}") for i in range(300)], "query_id string, query string")
    index, before = bm25.build(docs), _shuffled(spark)
    got = bm25.search(index, queries).orderBy("query_id", "rank").collect()
    assert _shuffled(spark) - before < 900 * 300 / 10
    assert len(got) == 1500 and got == bm25.scan_search(docs, queries).orderBy("query_id", "rank").collect()


def test_index_search_by_blocks(spark):
    """Blocks of queries, documents that go on in the next batch, rows of the same or no id, filtered hits."""
    rng = random.Random(6)
    rows = [(None if i % 40 == 0 else i % 170, None if i % 13 == 0 else " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(0, 30)))) for i in range(200)]
    asked = [(f"q{i % 27}", " ".join(rng.choices("abcdefghijklmnopz", k=rng.randint(0, 5)))) for i in range(30)]
    kept = {d for d, _ in rows if d is not None and d % 3}
    toks = [(d, (t or "").split()) for d, t in rows]
    avg, tf, asks = sum(len(t) for _, t in toks) / len(toks), {}, {}
    for d, ts in toks:
        for t in ts:
            tf[d, t] = tf.get((d, t), 0) + 1
    for q, text in asked:
        asks[q] = asks.get(q, []) + text.split()
    df = {t: sum(u == t for _, u in tf) for t in "abcdefghijklmnop"}
    want = []
    for q, ts in asks.items():
        score = dict.fromkeys(kept, 0.0)
        for d, held in toks:
            if d in kept:  # a document's terms count for each of its lengths
                score[d] += sum(math.log(1 + (200 - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(held) / avg)) for t in ts if (n := tf.get((d, t))))
        best = sorted((-round(s, 4), d) for d, s in score.items() if round(s, 4) > 0)[:7]
        want += [(q, d, n + 1, -s) for n, (s, d) in enumerate(best)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = bm25.search(bm25.build(spark.createDataFrame(rows, "doc_id int, text string")), spark.createDataFrame(asked, "query_id string, query string"), 7, spark.createDataFrame([(d,) for d in kept], "doc_id int"), block_terms=4)
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("metric", ["cosine", "l2", "sign"])
@pytest.mark.parametrize("limit", [1 << 20, 8])
def test_nearest(spark, metric, limit):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, vector array<double>")
    queries = corpus.where("doc_id < 5 or doc_id > 59").select(F.col("doc_id").alias("query_id"), "vector")

    def score(a, b):
        if metric == "l2":
            return -sum((x - y) ** 2 for x, y in zip(a, b))
        if metric == "sign":
            return sum((x >= 0) == (y >= 0) for x, y in zip(a, b)) / 4
        na, nb = math.dist(a, [0] * 4), math.dist(b, [0] * 4)
        return 0.0 if na * nb == 0 else sum(x * y for x, y in zip(a, b)) / (na * nb)

    want = {(q, d, n + 1) for q, v in rows if v and (q < 5 or q > 59) for n, (s, d) in enumerate(sorted(((round(-score(v, x), 6) + 0.0, d) for d, x in rows if x))[:7])}
    got = {(r.query_id, r.doc_id, r.rank) for r in vectors.nearest(corpus, queries, 7, metric, limit).collect()}
    assert got == want


def test_dimension_mismatch(spark):
    with pytest.raises(Exception, match="dimension"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_clustered_recall(spark):
    v = vectors._vectors(spark, "/root/testdata/sf0.01")
    q = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    exact = {(r.query_id, r.doc_id) for r in vectors.nearest(v, q, 10).collect()}
    near = {(r.query_id, r.doc_id) for r in vectors.ClusteredIndex(v).search(q, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_clustered_search_hands_on_k_rows(spark, monkeypatch):
    v = vectors._vectors(spark, "/root/testdata/sf0.01").repartition(3)
    q = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    index, handed = vectors.ClusteredIndex(v), []
    near = {(r.query_id, r.doc_id, r.score) for r in index.search(q, 10).collect()}
    monkeypatch.setattr(vectors, "top_k", lambda df, k, real=vectors.top_k: (handed.append(df.count()), real(df, k))[1])
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    got = [(r.query_id, r.doc_id, r.score) for r in index.search(q, 10).collect()]
    assert set(got) == near and len(got) == len(near) and 0 < handed[0] <= 10 * 3 * q.count()


def test_fusion(spark):
    arm = lambda rows: spark.createDataFrame(rows, "query_id string, doc_id string, rank int, score double")
    d, s = arm([("q", "a", 1, 0.9), ("q", "b", 2, 0.5)]), arm([("q", "b", 1, 7.0), ("q", "c", 2, 7.0)])
    assert [(r.doc_id, r.score) for r in fusion.rrf(d, s, 3).orderBy("rank").collect()] == [("b", round(0.5 / 62 + 0.5 / 61, 6)), ("a", round(0.5 / 61, 6)), ("c", round(0.5 / 62, 6))]
    assert [(r.doc_id, r.score) for r in fusion.weighted(d, s, 3).orderBy("rank").collect()] == [("a", 0.5), ("b", 0.0), ("c", 0.0)]
    many = spark.createDataFrame([("r", "q1", "doc1", 1), ("r", "q1", "doc2", 2), ("r", "q2", "doc2", 1), ("r", "q2", "doc3", 2)], "root string, variant string, doc_id string, rank int")
    top = fusion.multi_query(many, 5).orderBy("rank").first()
    assert (top.doc_id, top.query_count, top.score) == ("doc2", 2, round(1 / 62 + 1 / 61, 6))
    with pytest.raises(ValueError):
        fusion.hybrid(d, s, 3, "sum")


def test_metrics(spark):
    ranks = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate("ABCDE")] + [("b", 1, "d1"), ("b", 2, "o"), ("b", 3, "d3"), ("n", 1, "z")], "query_id string, rank int, doc_id string")
    qrels = spark.createDataFrame([("a", "A", 1.0), ("a", "C", 1.0), ("b", "d1", 1.0), ("b", "d3", 1.0), ("g", "X", 3.0)], "query_id string, doc_id string, rel double")
    got = {(r.query_id, r.k): r for r in irmetrics.evaluate(ranks, qrels, (1, 2, 3, 4, 5)).collect()}
    assert [round(got["a", k].precision, 4) for k in (1, 2, 3, 4, 5)] == [1, 0.5, 0.6667, 0.5, 0.4]
    assert round(got["b", 3].ap, 6) == round(5 / 6, 6) and got["n", 5].rr == 0 and got["g", 5].recall == 0
    graded = irmetrics.evaluate(spark.createDataFrame([("q", 1, "C"), ("q", 2, "B"), ("q", 3, "A")], "query_id string, rank int, doc_id string"), spark.createDataFrame([("q", "A", 3), ("q", "B", 2), ("q", "C", 1)], "query_id string, doc_id string, rel int"), (3,)).first()
    assert abs(graded.dcg - (1 + 3 / math.log2(3) + 3.5)) < 1e-9 and abs(graded.ndcg - (1 + 3 / math.log2(3) + 3.5) / (7 + 3 / math.log2(3) + 0.5)) < 1e-9
    with pytest.raises(ValueError):
        irmetrics.evaluate(ranks, qrels, (0,))


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "net sales rose in asia"), (2, "net sales fell in europe"), (3, "boats and fish")], "doc_id bigint, text string")
    corpus, q = retrieval.Corpus.of(docs), spark.createDataFrame([("q", "net sales asia")], "query_id string, query string")
    for mode in ("dense", "sparse", "hybrid"):
        assert retrieval.retrieve(corpus, q, 1, mode).first().doc_id == 1
    only = docs.where("doc_id <> 1").select("doc_id")
    model = lambda prompt: F.lit("1. fish boats\n- net sales europe")
    for t in retrieval.TRANSFORMS:
        ids = [r.doc_id for r in retrieval.retrieve(corpus, q, 2, where=only, transform=t, model=model, rerank=retrieval.overlap_score).collect()]
        assert ids and 1 not in ids
    assert [r.query for r in retrieval.variants(q, "multi_query", model).orderBy("variant").collect()] == ["net sales asia", "fish boats", "net sales europe"]
    assert [r.query for r in retrieval.variants(q, "hyde").collect()] == ["net sales asia"]
    row = retrieval.answer(q, retrieval.retrieve(corpus, q, 2, "sparse"), docs).first()
    assert row.retrieved == 2 and "2 documents" in row.answer
    with pytest.raises(ValueError):
        retrieval.retrieve(corpus, q, mode="x")


def test_hybrid_index(spark, tmp_path):
    index = retrieval.HybridIndex(spark, str(tmp_path / "i"))
    ask = spark.createDataFrame([(1, "alpha beta")], "query_id int, query string")
    assert index.search(ask).count() == 0
    index.add(spark.createDataFrame([("a", "alpha beta gamma"), ("b", "delta epsilon"), ("c", "beta only")], "doc_id string, text string"))
    assert [r.doc_id for r in index.search(ask, 2).orderBy("rank").collect()][0] == "a"
    index.add(spark.createDataFrame([("a", "nothing left"), ("d", "alpha beta")], "doc_id string, text string"))
    assert index.search(ask, 1).first().doc_id == "d"
    index.delete(spark.createDataFrame([("d",)], "doc_id string"))
    assert "d" not in {r.doc_id for r in index.search(ask).collect()}
    (tmp_path / "x.txt").write_text("alpha beta alpha beta")
    index.add_file(str(tmp_path / "x.txt"))
    assert index.search(ask, 1).first().doc_id.endswith("x.txt")
    index.reset()
    assert index.search(ask).count() == 0


def test_unions_thresholds_and_unit_weights(spark):
    ranks = spark.createDataFrame([("r", 1, "a", 1), ("r", 1, "b", 4), ("r", 2, "a", 2), ("r", 2, "c", 3)], "root string, variant int, doc_id string, rank int")
    assert {(r.doc_id, r.best_rank) for r in fusion.unique_union(ranks).collect()} == {("a", 1), ("c", 3)}
    assert {r.doc_id: r.matched for r in fusion.multi_query(ranks, 5).collect()} == {"a": [1, 2], "b": [1], "c": [2]}
    hits = spark.createDataFrame([(0.2,), (0.8,)], "score double")
    assert [fusion.within(hits, 0.5, m).first().score for m in ("similarity", "distance")] == [0.8, 0.2]
    with pytest.raises(ValueError):
        fusion.within(hits, 0.5, "x")
