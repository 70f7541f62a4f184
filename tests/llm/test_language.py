import numpy as np

from marlspike.llm import language as lg

EN = "The board approved a buy-back of up to $12 million. Customers in Asia accounted for most of the sales, and margins narrowed during the year."
DE = "Der Vorstand erwartet für das Geschäftsjahr einen Wert von 12 Mio. EUR. Die Rückstellungen wurden im Bereich Wartung erhöht, und das Ergebnis ist gestiegen."
FR = "La direction prévoit pour l'exercice un montant de 12 millions d'euros. La provision pour garanties de la branche a été portée à un niveau plus élevé."
ES = "La dirección prevé para el ejercicio una cifra de 12 millones de euros. La provisión por garantías de la división se elevó hasta un nivel más alto."
NL = "De raad heeft de inkoop van eigen aandelen goedgekeurd. Klanten in Azië waren goed voor een groot deel van de verkopen, en de marge is gedaald."


def _docs():
    return [(i * 10 + j, t, label) for i in range(12) for j, (t, label) in enumerate([(EN, "en"), (DE, "German"), (FR, "fr-BE"), (ES, "spa"), (NL, "Dutch")])]


def test_segments_and_edges(spark):
    extra = [
        (1001, EN + "\n" + DE, "en"), (1002, DE + " " + FR + " " + EN, "de"), (1003, EN, None), (1004, FR, "en"), (1005, None, "en"), (1006, "  ", "en"), (1007, "12 34,5 %", None),
        (1008, "", "de"), (1009, EN.replace("board", 'board „Der große Bericht über die Lage“'), "EN-us"), (None, ES, "und"), (1010, EN * 400, "xx"), (1010, EN * 400, "xx"),
    ]
    df = spark.createDataFrame(_docs() + extra, "doc_id bigint, text string, lang string").withColumn("segments", __import__("pyspark").sql.functions.lit(1))
    got = {}
    for r in lg.detect_segments(df).collect():
        got[r.doc_id] = [s.seg_lang for s in r.segments]
        assert all(0 < s.confidence <= 1 for s in r.segments)
    assert got[1001] == ["en", "de"] and got[1002] == ["de", "fr", "en"] and got[1003] == ["en"] and got[1004] == ["fr"]
    assert got[1009] == ["en"] and got[None] == ["es"] and got[1010] == ["en"]
    assert not {1005, 1006, 1007, 1008} & set(got)
    assert all(got[i] == [["en"], ["de"], ["fr"], ["es"], ["nl"]][i % 10] for i, _, _ in _docs())
    assert lg.detect_segments(df.limit(0)).count() == 0


def test_label_names(spark):
    rows = [("en_GB",), (" EN",), ("Portuguese",), ("xx",), ("",), (None,), ("-",), ("de-AT",), ("sv",)]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame(rows, "lang string").coalesce(1).select(lg.label_language(F.col("lang"))).collect()]
    assert got == ["en", "en", "pt", None, None, None, None, "de", None]


def test_labels_beyond_ascii(spark):
    from pyspark.sql import functions as F

    rows = [("fran\u00e7ais",), ("Espa\u00f1ol (ES)",), ("portugu\u00eas",), ("\u0420\u0443\u0441\u0441\u043a\u0438\u0439",), ("franc\u0327ais",), ("espa\u00f1a",)]
    got = [r[0] for r in spark.createDataFrame(rows, "lang string").coalesce(1).select(lg.label_language(F.col("lang"))).collect()]
    assert got == ["fr", "es", "pt", "ru", "fr", None]


def test_upper_case(spark):
    plant = "THE COMPANY SIGNED A CONTRACT WITH SUPPLIERS IN THE NORTH."
    extra = [(2001, EN.upper(), "xx"), (2002, DE.upper() + "\n" + FR.upper() + "\n" + ES.upper(), "de"), (2003, EN + "\n" + DE.upper(), "en"), (2004, f"{plant} (\u682a\u5f0f\u4f1a\u793e) {plant}", "en"),
             (2005, f"{DE.upper()} PER QUILLANDRA FOODS CO. {DE.upper()}", "de"), (2006, "Der Bericht\nAnnual Review", "de")]
    got = {r.doc_id: [s.seg_lang for s in r.segments] for r in lg.detect_segments(spark.createDataFrame(_docs() + extra, "doc_id bigint, text string, lang string")).where("doc_id > 2000").collect()}
    assert got[2001] == ["en"] and got[2002] == ["de", "fr", "es"] and got[2003] == ["en", "de"] and got[2004] == ["en"] and got[2005] == ["de"] and len(got) == 6
    assert lg.document_evidence("ANNUAL REVIEW.\nDER BERICHT.") == [" annual review ", " der bericht "]


def test_mixture_proportions():
    ll = np.full((10, 9), -50.0)
    ll[:7, 0] = -10
    ll[7:, 3] = -10
    segments, pi = lg.infer(ll)
    assert [(a, b, lg.LANGUAGES[g]) for a, b, g, _ in segments] == [(0, 7, "en"), (7, 10, "es")]
    assert abs(pi[0] - 0.7) < 0.05 and abs(pi[3] - 0.3) < 0.05
