import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest

from marlspike.llm import pairs as pr

Q = {"en": "What was the net sales of Hexabrook Inc. in fiscal 2018?", "de": "Wie hoch war die Kennzahl Eigenkapital bei der Firma im Jahr 2018?",
     "fr": "Quelle part des ventes de la société vient de Scandinavie en 2018 ?", "es": "¿Por qué cambió la división de hoteles de la empresa en 2018?"}
A = {"en": "The increase in net sales was driven by higher volumes and by a stronger dollar in the domestic market.", "de": "Die Rückstellungen für Gewährleistungen im Bereich Verpackungen wurden auf 277 Millionen Euro erhöht und werden nicht verändert.",
     "fr": "La provision pour garanties de la branche a été portée à 770 millions d'euros par la direction.", "es": "La dirección prevé para el ejercicio una cifra de entre 2 millones de dólares y 3 millones de euros para la división."}


DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tagger():
    texts = [dict(zip(*(pq.read_table(f"{DATA}/{t}.parquet", columns=["request_id", c]).to_pydict()[k] for k in ("request_id", c)))) for t, c in (("chat_requests", "message"), ("chat_responses", "response"))]
    return pr.PairTagger([(texts[0][i], texts[1][i]) for i in sorted(texts[0].keys() & texts[1].keys(), key=pr.hash_order)])


def defect(tagger, message, response):
    return tagger.defects([(message, response)], pr.Features())[0][0]


CASES = [
    (Q["en"], None, "empty"), (Q["en"], " ​\n", "empty"), (Q["en"], "<p></p>", "empty"), (Q["en"], "N/A", "empty"), (Q["en"], "```\n```", "empty"),
    (Q["en"], "Yes.", None), (Q["de"], "9,9 %", None), (Q["en"], "$5.2 billion", None), (Q["en"], A["en"], None), (Q["es"], A["es"], None),
    (Q["en"], A["en"] + " [HEXABROOK_2018_10K, p. 47]", None), (Q["en"], A["en"] + "\n\nSource: HEXABROOK_2018_10K, p. 4", None),
    (Q["en"], A["en"] + "\n1. Media: $5 million\n2. Paper: $7 million", None), (Q["en"], A["en"] + "\n1. Media: $5 million\n2.", "truncated"),
    (Q["en"], A["en"] + "\n\n| a | 2018 |\n| --- | --- |\n| b | 3 |\n| c | 4 |", None), (Q["en"], A["en"] + "\n\n| a | 2018 |\n| --- | --- |\n| b | 3 |\n| c |", "truncated"),
    (Q["en"], A["en"] + " The board approved a buy-back of up to", "truncated"), (Q["en"], "(" + A["en"], "truncated"),
    (Q["en"], Q["en"], "copied_question"), (Q["en"], "“" + Q["en"].lower() + "”", "copied_question"), (Q["en"], Q["en"] + " " + A["en"], None),
    (Q["en"], "I'm sorry, but I can't help with that request. Try asking your analyst instead.", "refusal"), (Q["de"], "Leider kann ich dabei nicht helfen.", "refusal"),
    (Q["en"], "I can't see a decline in net sales: it rose by 2.4% to $4.6 million in 2020.", None), (Q["en"], "Management declined to comment on Ulmorin, but net income was stated as $3 million.", None),
    (Q["en"], "The 2018 filing does not disclose net sales for paper; only the group total of $3 million is given.", None),
    (Q["en"], A["de"], "other_language"), (Q["fr"], A["es"], "other_language"), (Q["en"] + " Please answer in German.", A["de"], None), (Q["en"] + " (answer auf Deutsch)", A["de"], None),
    (None, A["en"], None),
]


@pytest.mark.parametrize("message,response,want", CASES)
def test_defects(tagger, message, response, want):
    if message is None:
        assert defect(tagger, message, response) in (None, "other_language")
    else:
        assert defect(tagger, message, response) == want


def test_viterbi_and_likelihood_against_brute_force():
    rng = np.random.default_rng(0)
    seqs = [[(sorted(rng.choice(40, 3, replace=False).tolist()), rng.integers(0, 1 << 32, n).tolist()) for _ in range(size)] for size, n in ((4, 3), (1, 0), (3, 5))]
    w, ww, tr = rng.normal(size=(pr._BUCKETS, 5)), rng.normal(size=pr._WORD_BUCKETS), rng.normal(size=(5, 5))
    batch = pr.Batch(seqs)
    emit, path = batch.emissions(w, ww), pr.viterbi(batch, w, ww, tr)
    for k, seq in enumerate(seqs):
        for i, (places, words) in enumerate(seq):
            alone = pr.Batch([[(places, words)]])
            assert np.allclose(emit[k, i], alone.emissions(w, ww)[0, 0]) and np.allclose(np.delete(emit[k, i], 1), np.delete(w[places].sum(0), 1))
        value = lambda p: sum(emit[k, i, t] for i, t in enumerate(p)) + sum(tr[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(path[k, : len(seq)]) == max(itertools.product(range(5), repeat=len(seq)), key=value)


def test_fit_raises_the_likelihood_of_its_tags():
    seqs = [[([1, 600 + t], [t])] for t in (0, 2) for _ in range(20)]
    w, ww, tr = pr.fit_field(seqs, [[t] for t in (0, 2) for _ in range(20)], ridge=0.1)
    assert (pr.viterbi(pr.Batch(seqs), w, ww, tr)[:, 0] == np.repeat([0, 2], 20)).all()
    assert not w[600:700, [0, 1, 3, 4]].any()  # overlap weighs for echo alone


def test_held_out_refusals(tagger):
    """Wordings that no part of the fit has."""
    for m, r in ((Q["en"], "I regret that I cannot give you an answer to this request."), (Q["de"], "Ich kann diese Anfrage leider nicht beantworten, da die Richtlinien es nicht zulassen."), (Q["fr"], "Désolé, je ne peux pas vous aider avec cette demande.")):
        assert defect(tagger, m, r) == "refusal"


def test_long_response(tagger):
    assert defect(tagger, Q["en"], " ".join([A["en"]] * 800)) is None


def test_frame(spark):
    asks = [(i, Q[g], 1) for i, g in enumerate("en de fr es".split() * 30)] + [(0, Q["en"], 1), (900, None, 2), (None, Q["en"], 3), (901, Q["en"], 4)]
    tells = [(i, A[g], "x") for i, g in enumerate("en de fr es".split() * 30)][:-1] + [(0, A["en"], "x"), (900, "", "y"), (None, "", "z"), (119, None, "n")]
    req = spark.createDataFrame(asks, "request_id bigint, message string, response int")
    res = spark.createDataFrame(tells, "request_id bigint, response string, message string")
    got = {r.request_id: r.defect for r in pr.tag_pairs(req, res).collect()}
    assert len(got) == 121 and got[900] == got[119] == "empty" and None not in got and 901 not in got
    assert all(got[i] is None for i in range(119))
    assert pr.tag_pairs(req.limit(0), res).count() == 0


def test_sample_of_distinct_ids(spark, monkeypatch):
    monkeypatch.setattr(pr, "FIT_PAIRS", 20)
    many = [(i, f"q{i}", f"a{i}") for i in range(40)] + [(i, f"q{i} again", f"a{i} again {n}") for i in (3, 17, 25) for n in range(200)] + [(None, "q", "a")]
    df = spark.createDataFrame(many, "request_id bigint, q string, a string")
    got = pr.fit_sample(df, df.where("request_id <> 4"), "request_id", "q", "a")
    assert 19 <= len(got) <= 20 and len(set(got)) == len(got) and all(q[1:] == a[1:] and q[1:].isdigit() for q, a in got)
