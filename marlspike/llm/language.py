"""Language of documents and of the stretches of mixed documents.

Model: hashed character 2- to 4-gram log-likelihoods for nine languages. They are fitted by expectation-maximisation over
the sentences of a bounded sample of documents, started from short lists of function words, so that wrong labels do not
matter. Inference, for every document: EM estimates the document's language proportions from its sentences' likelihoods;
the set of languages grows only while the gain in likelihood exceeds a penalty; a Viterbi pass over the sentences with the
estimated proportions gives the segments.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread, table

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "ru")
#: Frequent function words, the start of the fit.
FUNCTION_WORDS = {
    "en": "the of and to in is was were for with by that from at on be as it an which are has been will our we not or had its what why how does did how much who when where please this they their you your",
    "de": "der die das und ist war für mit von dem den des ein eine einer im auf sich nicht wird wurde zu auch als bei nach über aus werden noch welcher welche welches wie warum was wer wann wo bitte sie ihr wir aber wenn hat haben kam zum zur an bis durch unter",
    "fr": "le la les des du et est une dans pour par sur au aux que qui ne pas ce cette été avec plus sont ont ses leur être à d l s de quel quelle quels quelles pourquoi comment combien vient cite écrit il elle nous vous mais si son sa à en",
    "es": "el la los las del y es una en para por con que se al más fue no su sus como ha entre hasta sobre este esta lo desde ante de qué cuál cuánto por cómo quién cuándo dónde parte procede dice publicó pero si son han ser lo le les",
    "it": "il lo gli dei della delle e è una nel nella per con che si alla al di da non sono sul dal degli ha un i le stato fino anche di quale quanto perché come chi quando dove questo questa anno ma se loro suo",
    "pt": "o a os as do da dos das e é uma em no na para por com que se ao não foi um mais sobre à pelo pela até são num entre de qual quanto porque como quem quando onde este esta ano mas se seu sua já nos nas",
    "nl": "de het een van en is in op voor met dat die niet te aan door bij er zijn wordt werd naar uit ook om als tot nog zou kunnen over welk welke hoeveel waarom hoe wie wanneer waar dit deze maar als heeft hebben onder tegen",
    "pl": "i w na z się do nie jest że o po od za przez dla oraz został została został ze który która to a przy był była są może jak roku co dlaczego ile kiedy gdzie kto ten ta to tego tej ale jeśli pod nad",
    "ru": "и в на с не что по для от из за при к до о об это как был была было были может также или его её года году со во почему сколько когда где кто этот эта это но если под над который которая",
}
#: Names and codes by which labels call the nine languages.
LABELS = {
    "en": "en eng english inglés anglais englisch", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castilian",
    "it": "it ita italian italiano", "pt": "pt por portuguese português portugues", "nl": "nl nld dut dutch nederlands flemish", "pl": "pl pol polish polski", "ru": "ru rus russian русский",
}
BUCKETS, ORDERS = 1 << 16, (2, 3, 4)
#: Documents per label, and characters per document, in the sample that the model is fitted on.
FIT_DOCS_PER_LABEL, FIT_MAX_CHARS = 250, 4000
#: Occurrences that each function word counts for, so that the fit also holds on a handful of documents.
SEED_WEIGHT = 60
#: Overlapping n-grams are not independent: likelihoods are tempered by this factor.
TEMPER = 0.22
#: Nats that a further language, and a change of language between sentences, must gain.
SET_PENALTY, SWITCH_PENALTY = 6.0, 3.0
#: Words from which a piece in upper case is taken as a sentence; shorter ones are mostly names, split off at INC. or CO.
UPPER_WORDS = 6

_SPLIT = re.compile(r"(?:(?<=[.!?…;:])[\"'”»)\]]*\s+(?=[\"'“„«(\[¿¡*#-]*\s*[A-ZÀ-ÖØ-ÞА-ЯŁŚŻŹĆŃÓ0-9])|[\r\n]+|(?<=[.!?…])\s*(?:[*#>|]|\d+[.)])\s+)")
_QUOTED = re.compile(r"[“„«\"][^”“»\"\n]{1,120}[”“»\"]|‘[^’\n]{1,80}’")
_MARKUP = re.compile(r"<[^<>\n]{1,200}>|https?://\S+|&\w+;|\S+@\S+|\[[^\]\n]{0,80}\]\([^)\n]*\)")
_MARKED = re.compile(r"[<&@\[]|://")  # without one of these _MARKUP finds nothing
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def sentences(text: str) -> list[str]:
    """Sentence-like pieces of `text`, in order, quoted titles left out."""
    return [s for s in _SPLIT.split(_QUOTED.sub(" ", text)) if s and not s.isspace()]


def upper_case(words: list[str]) -> bool:
    """Whether most words of more than one letter are written in capitals, and enough to be a sentence, not a name."""
    if len(words) < UPPER_WORDS:
        return False
    longer = [w for w in words if len(w) > 1]
    return 2 * sum(map(str.isupper, longer)) > len(longer)


def evidence(sentence: str, strict: bool = True) -> str:
    """Lower-case words of a sentence that speak for its language, between blanks.

    Markup and addresses are left out, and (strict) words with a capital behind the first, which are mostly names. In a
    sentence written in upper case capitals tell nothing: there all words stay.
    """
    s = _MARKUP.sub(" ", sentence) if strict and _MARKED.search(sentence) else sentence
    words = _WORD.findall(s)
    words = [w for w, before in zip(words, ["", *words]) if w != before]
    if strict and not upper_case(words):
        words = [w for i, w in enumerate(words) if not w[0].isupper() or (i == 0 and not w.isupper() and len(words) > 1 and words[1][0].islower())]
    return f" {' '.join(words).lower()} " if words else ""


def document_evidence(text: str) -> list[str]:
    """Evidence of each sentence of `text`; where no sentence has any by the strict rules, of each by the loose ones."""
    pieces = sentences(text)
    found = [evidence(s) for s in pieces]
    if not any(found):
        found = [evidence(s, strict=False) for s in pieces]
    return found if any(found) else [evidence(text, strict=False)]  # all in quotes: the whole text speaks


def _grams_by_order(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: hash buckets of the n-grams of `texts`, and the text each belongs to, in order."""
    joined = "\x00".join(texts) + "\x00\x00\x00\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.cumsum(codes == 0)
    n = len(codes) - 3
    zero = codes == 0
    out = []
    h = codes[:n].astype(np.uint32)
    clean = ~zero[:n]
    for k in range(1, 4):
        h = h * np.uint32(0x9E3779B1) + codes[k : n + k]
        clean = clean & ~zero[k : n + k]
        if k + 1 in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * k)
            out.append(((mixed >> np.uint32(16))[clean], owner[:n][clean]))
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams of all orders, and the text each belongs to."""
    orders = _grams_by_order(texts)
    return np.concatenate([b for b, _ in orders]), np.concatenate([o for _, o in orders])


def likelihoods(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Tempered log-likelihood, one row a text, one column a language; zeros for texts without evidence."""
    result = np.zeros((len(texts), len(LANGUAGES)))
    for at in range(0, len(texts), 4000):
        part = texts[at : at + 4000]
        if any(part):
            for buckets, own in _grams_by_order(part):
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
                if len(first):
                    result[at + own[first]] += np.add.reduceat(model[buckets], first, axis=0, dtype=np.float64)
    return result * TEMPER


def fit(texts: list[str], rounds: int = 4) -> np.ndarray:
    """Log-probabilities [bucket, language] by EM over the sentences of `texts`, started from the function words."""
    pieces = [e for t in texts for s in sentences(t) if (e := evidence(s))]
    seeds = [f" {' '.join(FUNCTION_WORDS[g].split())} " for g in LANGUAGES]
    sets = [set(FUNCTION_WORDS[g].split()) for g in LANGUAGES]
    post = np.zeros((len(pieces), len(LANGUAGES)))
    for i, p in enumerate(pieces):
        words = re.split(r"[ '’]", p)
        hits = np.array([sum(w in s for w in words) for s in sets], float)
        best = np.sort(hits)[::-1]
        if best[0] >= 2 and best[0] >= best[1] + 2:
            post[i, int(hits.argmax())] = 1.0
    everything = seeds + pieces
    buckets, own = _grams(everything)
    model = np.zeros((BUCKETS, len(LANGUAGES)), np.float32)
    for r in range(rounds):
        weight = np.vstack([np.eye(len(LANGUAGES)) * SEED_WEIGHT, post])
        counts = np.stack([np.bincount(buckets, weights=weight[own, j], minlength=BUCKETS) for j in range(len(LANGUAGES))], 1)
        own_share = counts / np.maximum(counts.sum(0), 1)
        background = own_share.mean(1, keepdims=True)  # the same for all, so that a language with little text gains nothing by it
        model[:] = np.log(0.95 * own_share + 0.05 * background + 1e-8)
        if r + 1 < rounds and pieces:
            ll = likelihoods(pieces, model)
            share = np.log(post.sum(0) + 1) - np.log(post.sum() + len(LANGUAGES))
            z = ll + share
            z -= z.max(1, keepdims=True)
            post = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    return model


def mixture(ll: np.ndarray, allowed: list[int], steps: int = 12) -> tuple[np.ndarray, float]:
    """EM over one document's sentences: proportions of `allowed` languages, and the log-likelihood reached."""
    part = ll[:, allowed]
    top = part.max(1, keepdims=True)
    like = np.exp(part - top)
    pi = np.full(len(allowed), 1 / len(allowed))
    for _ in range(steps if len(allowed) > 1 else 0):
        post = like * pi
        post /= post.sum(1, keepdims=True)
        pi = post.mean(0) * 0.98 + 0.02 / len(allowed)
    return pi, float((np.log(like @ pi) + top[:, 0]).sum())


def infer(ll: np.ndarray) -> tuple[list[tuple[int, int, int, float]], np.ndarray]:
    """Segments (first sentence, end, language, confidence) and proportions of one document from its sentence likelihoods."""
    chosen = [int(ll.sum(0).argmax())]
    pi, value = mixture(ll, chosen)
    best = ll.argmax(1)
    wins = [int(j) for j in np.unique(best[ll.max(1) - ll.min(1) > 1.0]) if j not in chosen] if (best != chosen[0]).any() else []
    while wins:
        trial = [(mixture(ll, [*chosen, j]), j) for j in wins]
        (new_pi, new_value), j = max(trial, key=lambda t: t[0][1])
        if new_value - value <= SET_PENALTY:
            break
        chosen, pi, value = [*chosen, j], new_pi, new_value
        wins.remove(j)
    proportions = np.zeros(len(LANGUAGES))
    proportions[chosen] = pi
    if len(chosen) == 1:
        alone = np.exp(ll - ll.max(1, keepdims=True))
        return [(0, len(ll), chosen[0], float((alone[:, chosen[0]] / alone.sum(1)).mean()))], proportions
    part = ll[:, chosen]
    post = np.exp(part - part.max(1, keepdims=True)) * pi
    post /= post.sum(1, keepdims=True)
    score, back = part[0].copy(), []
    for row in part[1:]:
        stay = score
        jump = score.max() - SWITCH_PENALTY
        back.append(np.where(stay >= jump, np.arange(len(chosen)), score.argmax()))
        score = np.maximum(stay, jump) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    segments, start = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[start]:
            segments.append((start, i, chosen[path[start]], float(post[start:i, path[start]].mean())))
            start = i
    return segments, proportions


def label_language(label: Column) -> Column:
    """The code of the language that a label names, null if it names none of the nine."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}\p{M}]+)", 1)
    pairs = [F.lit(x) for g, names in LABELS.items() for n in names.split() for form in {n, unicodedata.normalize("NFD", n)} for x in (form, g)]
    return F.try_element_at(F.create_map(*pairs), head)


def fit_sample(docs: DataFrame, text_col: str, label_col: str, id_col: str) -> list[str]:
    """At most FIT_DOCS_PER_LABEL texts of each stated label (no label is one more), chosen by hash of the id."""
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64(id_col), F.col(id_col)))
    picked = (docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= FIT_MAX_CHARS)).select(F.coalesce(label_language(F.col(label_col)), F.lit("-")).alias("g"), id_col, text_col)
              .withColumn("r", rank).where(F.col("r") <= FIT_DOCS_PER_LABEL))
    return [r[0] for r in picked.select(text_col).collect()]


def detect_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, label, segments) of every document with words; segments ARRAY<STRUCT<seg_no, seg_lang, confidence, n_sentences>>.

    One narrow stage after the bounded fit. Null, blank and figures-only texts give no row; null ids and labels are kept;
    repeated rows stay repeated; other columns are not read; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(fit_sample(docs, text_col, label_col, id_col)))
    kind = docs.schema[id_col].dataType.simpleString()
    seg = pa.list_(pa.struct([("seg_no", pa.int32()), ("seg_lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                flat, bounds, keep = [], [0], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    if not text or not _WORD.search(text):
                        continue
                    ev = document_evidence(text)
                    flat += ev
                    bounds.append(len(flat))
                    keep.append(i)
                ll = likelihoods(flat, model.value)
                rows = []
                for a, b in zip(bounds, bounds[1:]):
                    used = [k for k in range(a, b) if flat[k]]
                    found, _ = infer(ll[used])
                    rows.append([{"seg_no": n + 1, "seg_lang": LANGUAGES[g], "confidence": c, "n_sentences": e - s} for n, (s, e, g, c) in enumerate(found)])
                index = pa.array(keep, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(rows, seg)], ["seg_key", "seg_label", "segments"])

    src = spread(docs.select(F.col(id_col).alias("seg_key"), F.col(label_col).alias("seg_label"), F.col(text_col).alias("seg_text")))
    out = src.mapInArrow(run, f"seg_key {kind}, seg_label string, segments array<struct<seg_no:int,seg_lang:string,confidence:double,n_sentences:int>>")
    return out.withColumnsRenamed({"seg_key": id_col, "seg_label": label_col})


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg_no, seg_lang) of the documents whose label is missing or wrong, or whose text mixes languages."""
    df = detect_segments(table(spark, sf_dir, "documents"))
    named = label_language(F.col("lang"))
    wrong = named.isNull() | (named != F.col("segments")[0]["seg_lang"]) | (F.size("segments") > 1)
    return df.where(wrong).select("doc_id", F.explode("segments").alias("s")).select("doc_id", F.col("s.seg_no").cast("bigint").alias("seg_no"), "s.seg_lang")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg_no, seg_lang, confidence, n_sentences): every segment of every document with words."""
    each = detect_segments(table(spark, sf_dir, "documents")).select("doc_id", F.explode("segments").alias("s"))
    return each.select("doc_id", "s.seg_no", "s.seg_lang", F.round("s.confidence", 4).alias("confidence"), "s.n_sentences")
