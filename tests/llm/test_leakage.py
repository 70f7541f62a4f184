import random

from marlspike.llm import leakage as lk


def distance_within(window, doc):
    """Least word edit distance between `window` and any stretch of `doc`."""
    prev = list(range(len(window) + 1))
    best = prev[-1]
    for w in doc:
        cur = [0]
        for i, x in enumerate(window):
            cur.append(min(prev[i] + (x != w), prev[i + 1] + 1, cur[i] + 1))
        prev = cur
        best = min(best, cur[-1])
    return best


def brute(passage, doc):
    p, d = lk.normalise(passage).split(), lk.normalise(doc).split()
    return any(distance_within(p[a : a + lk.WINDOW], d) <= lk.EDITS for a in range(len(p) - lk.WINDOW + 1))


def _edit(words, rng, n):
    words = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = "changed" + str(rng.randrange(9))
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "added")
    return words


def _found(index, doc):
    masked = index.masked(doc)
    return {p for d, p, lo, hi in index.candidates([masked]) if lk.verify(index.words[p], lk.word_runs(index.words[p]), masked, lo, hi, masked.split(" "))}


def test_long_words_put_in_lose_nothing():
    rng = random.Random(5)
    vocab = [a + b for a in ("sar", "vel", "mo", "ta", "li", "quen") for b in ("dor", "ric", "vane", "mi", "x")]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(15, 40))) for _ in range(10)]
    index = lk.PassageIndex([(str(i), p) for i, p in enumerate(passages)])
    for length in (1, 7, 8, 20, 30, 60, 90, 130, 200):
        for _ in range(4):
            k = rng.randrange(len(passages))
            words = passages[k].split()
            at = rng.randrange(len(words) - lk.WINDOW + 1)
            body = words[at : at + lk.WINDOW]
            for _ in range(2):
                if rng.random() < 0.7:
                    body.insert(rng.randrange(1, len(body)), "z" * length)
                else:
                    body[rng.randrange(len(body))] = "u" * length
            doc = " ".join([rng.choice(vocab) for _ in range(20)] + body + ["unknown"] * 4 + [rng.choice(vocab) for _ in range(20)])
            want = {p for p in range(len(passages)) if brute(passages[p], doc)}
            assert k in want and _found(index, doc) == want


def test_passage_beyond_a_million_characters():
    words = [f"w{i}" for i in range(180_000)]
    index = lk.PassageIndex([("long", " ".join(words)), ("short", " ".join(words[:20]))])
    assert len(" ".join(words)) > 1 << 20
    assert _found(index, "other " * 9 + " ".join(words[170_000:170_016])) == {0}
    assert _found(index, " ".join(words[3:18])) == {0, 1}
    assert _found(index, " ".join(words[170_000:170_012])) == set()


def test_against_brute_force():
    rng = random.Random(3)
    vocab = [a + b for a in ("sar", "vel", "mo", "ta", "li", "quen") for b in ("dor", "ric", "vane", "mi", "x")]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(15, 40))) for _ in range(12)]
    index = lk.PassageIndex([(str(i), p) for i, p in enumerate(passages)])
    wrong = 0
    for case in range(160):
        k = rng.randrange(len(passages))
        words = passages[k].split()
        size = rng.randrange(8, min(24, len(words)) + 1)
        at = rng.randrange(len(words) - size + 1)
        body = _edit(words[at : at + size], rng, rng.randrange(0, 5))
        doc = lk.normalise(" ".join([rng.choice(vocab) for _ in range(20)] + body + [rng.choice(vocab) for _ in range(20)]))
        found = _found(index, doc)
        want = {p for p in range(len(passages)) if brute(passages[p], doc)}
        wrong += found != want
    assert wrong == 0


def test_frame_blocks_and_edges(spark):
    p1 = "Of $5,985.9 thousand drawn at Hulrimore, 29.2% matured and $4,888.2 million moved into Sarandell at 36.4% for Marmamore holders"
    p2 = "Selling Dovdobury freed four billion of which much went to Garvibury and the rest to Wenkolume after restructuring charges hit everyone hard"
    qa = spark.createDataFrame([("a", p1), ("b", p2), ("c", None), ("d", "too short to count")], "item string, passage string")
    docs = spark.createDataFrame([
        (1, "x " * 50 + p1.upper().replace(",", " ,"), 0), (1, "x " * 50 + p1.upper().replace(",", " ,"), 0), (2, p2.replace("much", "little").replace("hit ", "hit very "), 0),
        (3, " ".join(p2.split()[:11]), 0), (4, None, 0), (5, "", 0), (6, (p1 + " and " + p2 + "\n") * 300, 0), (None, p2, 0), (7, p1.replace("drawn at", "taken from").replace("29.2%", "30%").replace("million moved", "thousand went"), 0),
    ], "doc_id bigint, text string, item int")
    want = {(1, "a"), (2, "b"), (6, "a"), (6, "b"), (None, "b")}
    for size in (lk.BLOCK_CHARS, 10):
        rows = [(r.doc_id, r.item) for r in lk.find_leaks(docs, qa, block_chars=size).collect()]
        assert set(rows) == want and len(rows) == len(want)
    assert lk.find_leaks(docs.limit(0), qa).count() == 0
    assert lk.find_leaks(docs, qa.limit(0)).count() == 0


def test_normalise():
    assert lk.normalise(" $1,764 isn't -- Cold-Chain\tÉté_x ") == "1764 isnt coldchain étéx"
    assert lk.normalise(None) == ""
