"""Defective question-answer pairs, by a linear-chain conditional random field over the clauses of a response.

Every clause (sentence, list item, table row) is tagged answer, refusal, echo, foreign or unfinished. The field weighs what a
clause shows: hashed word n-grams (for refusals), its place, the share of its words that the message has, the lead in likelihood of other
languages, how it ends. None of these decides by itself. The weights are fitted on the driver from a bounded sample of
pairs whose responses are altered in known ways (question copied in front or instead, cut short at a random place, swapped
for one in another language, replaced by a composed refusal), so that the tags of the fit come from the alteration; pairs of
the sample that a fit finds defective as they stand are left out of the next, refusals among them added as such. The tags' shares of the
response's characters then decide the pair's defect.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import language

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Pairs that the field and the language model are fitted on (chosen by hash of the id).
FIT_PAIRS = 3000
#: Penalties on features and on word n-grams, and steps, of the fit's rounds: strict while the sample still holds defects as answers.
FIT_ROUNDS = ((5.0, 100.0, 40), (3.0, 20.0, 40), (0.7, 3.0, 150))

#: Nats below the best tag within which a refusal is possible: such pairs of the sample don't count as answers.
DOUBT = 1.0

_INVISIBLE = re.compile(r"[­​-‏ -‮⁠-⁤﻿\x00-\x08\x0b\x0c\x0e-\x1f]")
_MARKUP = re.compile(r"<[^<>]{0,200}>|&(?:nbsp|#\d+|\w+);|```\w*|[*_~`#>]+")
#: Words that stand for "no value".
_NO_VALUE = {"na", "n a", "nil", "null", "none", "nan", "undefined", "no value", "no answer", "no response", "empty", "not available", "not applicable", "ka", "k a", "keine angabe", "keine angaben", "entfällt", "keine antwort",
             "sans objet", "so", "s o", "nd", "n d", "néant", "aucune", "aucune réponse", "non disponible", "no disponible", "sin respuesta", "sin datos", "ninguno", "vacío", "tbd"}
_FIGURES = re.compile(r"(?:\$|€|£|¥|USD|EUR|GBP)\s?\d|\d[\d.,   ]*\s?(?:%|million|billion|thousand|Mio|Mrd|M€|millones|millions|milliards)")
_LANGUAGE_NAMES = {"en": "english englisch anglais inglés inglese", "de": "german deutsch allemand alemán tedesco", "fr": "french französisch français francés", "es": "spanish spanisch espagnol español castellano",
                   "it": "italian italienisch italien italiano", "pt": "portuguese portugiesisch portugais portugués", "nl": "dutch niederländisch néerlandais neerlandés holländisch", "pl": "polish polnisch polonais polaco", "ru": "russian russisch russe ruso"}
_WISH = re.compile(r"(?i)\b(?:in|auf|en|into|to)\s+(?:la lengua |lengua |langue |idioma )?(" + "|".join(n for v in _LANGUAGE_NAMES.values() for n in v.split()) + r")\b")
_WISH_OF = {n: g for g, v in _LANGUAGE_NAMES.items() for n in v.split()}
_CLAUSE = re.compile(r"\n+|(?<=[.!?…])(?<!\b\d\.)(?<!\bp\.)(?<!\bNo\.)(?<!Mio\.)(?<!Mrd\.)[\"'”»)\]]*\s+(?=[\"'“„«(\[¿¡]?[A-ZÀ-ÖØ-Þ0-9])")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,2}[.)]|[a-z]\))(?:\s+|$)")
_SOURCE = re.compile(r"^\s*(?:(?:source|quelle|fuente|sources?|siehe|see)\s*:?\s*)?[\[(]?\s*[A-Z][A-Z0-9&-]+(?:_[\w.-]+)+(?:,? (?:p|pp|S|pág|page)\.? ?\d+(?:-\d+)?)?\s*[\])]?\s*\.?$", re.I)
_TAIL_SOURCE = re.compile(r"\s*(?:[\[(]\s*[A-Z][A-Z0-9&-]+(?:_[\w.-]+)+(?:,? (?:p|pp|S)\.? ?\d+)?\s*[\])]|source:\s*\w+(?:_[\w.-]+)+(?:, p\. ?\d+)?)\s*\.?\s*$", re.I)
_BARE = re.compile(r"(?ix)^\s*(?:(?:yes|no|ja|nein|oui|non|s[íi]|true|false|correct|korrekt)|(?:(?:approximately|about|around|rund|etwa|environ|unos|ca\.?)\s)?[-+−(]?\s*(?:us\$|\$|€|£|¥|usd|eur|gbp|chf|jpy)?\s*\d[\d.,'    ]*\)?\s*(?:%|percent|per\ cent|prozent|pour\ cent|por\ ciento|k|m|bn|m€|mio\.?|mrd\.?|thousand|million|billion|millionen|milliarden|tausend|millions|milliards|milliers|millones|miles)?\s*(?:d['’]\ ?|de\ |of\ )?\s*(?:us-?)?(?:dollars?|d[óo]lares|euros?|usd|eur|gbp|shares)?)\s*[.!]?\s*$")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def bare_content(response: str | None) -> str:
    """What is left of a response without markup, invisible characters and words for no value."""
    if not response:
        return ""
    text = _MARKUP.sub(" ", _INVISIBLE.sub("", response))
    words = " ".join(_WORD.findall(text)).lower()
    return "" if not words or words in _NO_VALUE else text.strip()


def clauses(text: str) -> list[str]:
    """Sentences, list items and table rows, in order."""
    return [c for c in (p.strip() for p in _CLAUSE.split(text)) if c]


def wished_languages(message: str) -> set[str]:
    """Languages that the message asks the answer to be in."""
    return {_WISH_OF[m.lower()] for m in _WISH.findall(message)}


#: Where the hashed features of each template lie, and the tags that they weigh: form and place speak for every tag, overlap for
#: echo, likelihood for foreign, endings for unfinished, figures (and word n-grams, in a table of their own) for refusal.
_RANGES = {"form": (0, 512, TAGS), "overlap": (512, 512, ("echo",)), "likelihood": (1024, 256, ("foreign",)), "figures": (1280, 256, ("refusal",)), "ending": (1536, 6656, ("unfinished",))}
_BUCKETS, _WORD_BUCKETS = 1 << 13, 1 << 14
_REFUSED = TAGS.index("refusal")
_WEIGHED = np.zeros((_BUCKETS, len(TAGS)), bool)
for _at, _n, _tags in _RANGES.values():
    _WEIGHED[_at : _at + _n, [TAGS.index(t) for t in _tags]] = True


class _Ids(dict):
    """A number for each key, by hash, worked out once; forgotten when there are too many."""

    def __missing__(self, key) -> int:
        if len(self) > 400_000:
            self.clear()
        text = _NUMBER.sub("0", key.lower()) if isinstance(key, str) else "\x1f".join(map(str, key))
        self[key] = have = zlib.crc32(text.encode("utf-8", "replace"))
        return have


_NUMBER = re.compile(r"\d+")
_UNIT = re.compile(r"(?i)(?:million|millions|billion|thousand|percent|prozent|millionen|milliarden|tausend|millones|miles|milliards|milliers|%|dollars?|d[óo]lares|euros?|eur|usd|gbp|m€|yen|francs?|shares)\)?\s*$")
_CLASS = {**dict.fromkeys(".。", "."), **dict.fromkeys("!?", "!"), **dict.fromkeys(":;,–—-", ","), **dict.fromkeys(")]}", ")"), **dict.fromkeys("\"'”»*_`", '"'), "|": "|", "%": "%", **dict.fromkeys("€$£", "€"), "…": "…"}


def _shape(ch: str) -> str:
    return _CLASS.get(ch) or ("d" if ch.isdigit() else "a" if ch.isalpha() else "o")


def _kind(part: str) -> str:
    return "row" if part.startswith("|") else "item" if _ITEM.match(part) else "source" if _SOURCE.match(part) else "bare" if _BARE.match(part) else "plain"


def _step(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value >= b for b in bounds)


class Features:
    """Sparse features of clauses, by hash: (places of the features weighed for each tag, hashes of the words)."""

    def __init__(self):
        self.words, self.keys = _Ids(), _Ids()

    def of(self, template: str, *key) -> int:
        at, n, _ = _RANGES[template]
        return at + self.keys[key] % n

    def clauses(self, message: str, text: str, parts: list[str], lead: list[float]) -> list[tuple[list[int], list[int]]]:
        """Features of each clause of `text`; `lead` is the other languages' lead in nats, 0 where it can't be told."""
        ids, f = self.words, self.of
        own = [ids[w] for w in _WORD.findall(message)]
        pairs, kinds = set(zip(own, own[1:])), [_kind(p) for p in parts]
        out = []
        for i, part in enumerate(parts):
            words = [ids[w] for w in _WORD.findall(part)]
            n, last = len(words), i == len(parts) - 1
            shared = sum(map(pairs.__contains__, zip(words, words[1:])))
            share = _step(shared / (n - 1), (0.2, 0.4, 0.6, 0.75, 0.9, 0.999)) if n > 1 else -1
            cover = _step(shared / len(pairs), (0.1, 0.3, 0.5, 0.7, 0.9)) if pairs else -1
            size = _step(n, (1, 2, 3, 4, 7, 12))
            x = [f("form", "bias"), f("form", "kind", kinds[i], i == 0), f("form", "size", size), f("overlap", share), f("overlap", share, cover), f("overlap", "size", size, share),
                 f("likelihood", _step(lead[i], (-8, -2, -0.5, 0.5, 2, 4, 6, 8, 12))), f("figures", bool(_FIGURES.search(part)), size)]
            x += [f("ending", "copies", share), *self._ending(text, parts, kinds, part.split()[-1:])] if last else [f("ending", "goes on")]
            out.append((x, words))
        return out

    def _ending(self, text: str, parts: list[str], kinds: list[str], words: list[str]) -> list[int]:
        """How the last clause ends, by itself and beside its like."""
        f, part, kind = lambda *key: self.of("ending", *key), parts[-1], kinds[-1]
        end = part.rstrip("\"'”»*_` ") or part
        tail, before = _shape(end[-1]), _shape(end[-2]) if len(end) > 1 else "-"
        unit, bare, alone = bool(_UNIT.search(end)), bool(_BARE.match(part)), len(parts) == 1
        source = bool(_SOURCE.match(part) or _TAIL_SOURCE.search(part))
        plain = re.sub(r"(?m)^\s*(?:\d{1,2}|[a-z])\)", "", text)
        open_ = plain.count("(") - plain.count(")") > 0, plain.count("[") - plain.count("]") > 0, text.count("“") - text.count("”") > 0 and "„" not in text
        x = [f("last", kind, tail), f("last", kind, before, tail), f("last", kind, before, tail, unit), f("word", _NUMBER.sub("0", words[-1].lower()) if words else "", tail), f("bare", bare, alone, tail), f("source", source, tail), f("open", *open_), f("size", _step(len(part), (3, 8, 20)), kind, tail)]
        word = part.split()[-1]
        x += [f("token", min(len(word), 8), tail, word.islower()), f("token bracket", open_[0] or open_[1], tail)]
        siblings = [p for p, k in zip(parts[:-1], kinds) if k == kind]
        if kind == "row":
            rows = [p.count("|") for p in siblings]
            x += [f("row short", part.count("|") < rows[0] if rows else None), f("row", end[-1:] == "|", _step(len(rows), (1, 2, 3)), part.count("|") < rows[0] if rows else None), f("row rule", not _WORD.search(part), _step(len(rows), (1, 2)))]
        elif kind == "item":
            body = _ITEM.sub("", part).strip()
            others = [_ITEM.sub("", p).strip() for p in siblings]
            name, colon, value = body.partition(":")
            x += [f("item", not body), f("item value", bool(colon), bool(value.strip()), bool(others) and all(":" in o for o in others)), f("item first", not others, part.lstrip()[:2] in ("1.", "1)"), bool(colon), bool(value.strip())),
                  f("item like", bool(others) and _shape(others[-1][-1:] or " ") == tail, bool(others) and all(bool(_UNIT.search(o)) for o in others), unit, tail), f("item bare", bool(_BARE.match(value or body)), tail, unit)]
        return x


# --- the field -----------------------------------------------------------------------------------------------------


class _Bags:
    """Bags of feature places, one a clause, as one flat array."""

    def __init__(self, places: np.ndarray, size: np.ndarray):
        self.places, self.owner, self.n = places, np.repeat(np.arange(len(size)), size), len(size)

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Summed weights of each bag; `w` has a row, or a number, for each place."""
        if w.ndim == 1:
            return np.bincount(self.owner, weights=w[self.places], minlength=self.n)
        first = np.searchsorted(self.owner, np.arange(self.n))  # no bag of these is empty
        return np.add.reduceat(w[self.places], first, axis=0) if self.n else np.zeros((0, w.shape[1]))

    def spread(self, values: np.ndarray, buckets: int) -> np.ndarray:
        """Sum of `values` (one a bag) over the bags that have each place."""
        return np.bincount(self.places, weights=values[self.owner], minlength=buckets)


class Batch:
    """Responses of one batch as padded sequences over sparse clause features."""

    def __init__(self, seqs: list[list[tuple[list[int], list[int]]]]):
        flat = [x for s in seqs for x in s]
        size = np.array([len(s) for s in seqs], int)
        self.mask = np.arange(max(size, default=0))[None] < size[:, None]
        many = np.array([len(x) for x, _ in flat], int)
        self.bags = _Bags(np.fromiter((i for x, _ in flat for i in x), np.int64, many.sum()), many)
        many = np.array([len(w) for _, w in flat], int)
        words = np.fromiter((i for _, w in flat for i in w), np.uint64, many.sum())
        owner = np.repeat(np.arange(len(flat)), many)
        # Words, pairs of neighbours, and the first two words with their place, by hash.
        both = owner[1:] == owner[:-1]
        start = np.flatnonzero(np.concatenate([[True], ~both])) if len(owner) else np.zeros(0, int)
        two = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[both]
        grams = [(words, owner), (two, owner[1:][both]), (words[start] + np.uint64(77), owner[start])]
        hashes = np.concatenate([g for g, _ in grams]) * np.uint64(0xD6E8FEB86659FD93)
        owners = np.concatenate([o for _, o in grams])
        order = np.argsort(owners, kind="stable")
        self.grams = _Bags((hashes >> np.uint64(40)).astype(np.int64)[order] % _WORD_BUCKETS, np.bincount(owners, minlength=len(flat)) if len(flat) else np.zeros(0, int))

    def emissions(self, w: np.ndarray, w_words: np.ndarray) -> np.ndarray:
        """Score [response, clause, tag]; 0 behind a response's end."""
        out = np.zeros((*self.mask.shape, len(TAGS)))
        if self.bags.n:
            score = self.bags.sums(w)
            score[:, _REFUSED] += self.grams.sums(w_words)
            out[self.mask] = score
        return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def fit_field(seqs: list, tags: list[list[int]], steps: int = 60, rate: float = 0.3, ridge: float = 2.0, word_ridge: float = 5.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights [feature, tag], word n-gram weights and transition weights [tag, tag] by gradient ascent on the penalised likelihood."""
    k = len(TAGS)
    w, ww, tr = np.zeros((_BUCKETS, k)), np.zeros(_WORD_BUCKETS), np.zeros((k, k))
    if not seqs:
        return w, ww, tr
    batch = Batch(seqs)
    mask = batch.mask
    n, length = mask.shape
    y = np.zeros((n, length), int)
    y[mask] = [t for ts in tags for t in ts]
    gold = (np.eye(k)[y])[mask]
    both = mask[:, 1:] & mask[:, :-1]
    gold_trans = np.zeros((k, k))
    np.add.at(gold_trans, (y[:, :-1][both], y[:, 1:][both]), 1)
    seen = [np.zeros_like(w), np.zeros_like(ww), np.zeros_like(tr)]
    for _ in range(steps):
        emit = batch.emissions(w, ww)
        alpha = [emit[:, 0]]
        for t in range(1, length):
            step = _lse(alpha[-1][:, :, None] + tr, 1) + emit[:, t]
            alpha.append(np.where(mask[:, t, None], step, alpha[-1]))
        beta = [np.zeros((n, k))]
        for t in range(length - 1, 0, -1):
            step = _lse(tr[None] + (emit[:, t] + beta[0])[:, None, :], 2)
            beta.insert(0, np.where(mask[:, t, None], step, beta[0]))
        logz = _lse(alpha[-1], 1)
        miss = gold - np.stack([np.exp(a + b - logz[:, None]) for a, b in zip(alpha, beta)], 1)[mask]
        grad_t = gold_trans - ridge * tr
        for t in range(1, length):
            at = mask[:, t]
            pair = alpha[t - 1][at][:, :, None] + tr[None] + (emit[at, t] + beta[t][at])[:, None, :] - logz[at][:, None, None]
            grad_t -= np.exp(pair).sum(0)
        grads = (np.stack([batch.bags.spread(miss[:, j], _BUCKETS) for j in range(k)], 1) * _WEIGHED - ridge * w, batch.grams.spread(miss[:, _REFUSED], _WORD_BUCKETS) - word_ridge * ww, grad_t)
        for value, grad, past in zip((w, ww, tr), grads, seen):
            past += grad**2
            value += rate * grad / (np.sqrt(past) + 1e-8)
    return w, ww, tr


def viterbi(batch: Batch, w: np.ndarray, ww: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Most likely tags [response, clause] of a batch."""
    emit, mask = batch.emissions(w, ww), batch.mask
    n, length = mask.shape
    path = np.zeros((n, length), int)
    if not length:
        return path
    score, back = emit[:, 0], []
    for t in range(1, length):
        total = score[:, :, None] + tr
        back.append(np.where(mask[:, t, None], total.argmax(1), np.arange(len(TAGS))))
        score = np.where(mask[:, t, None], total.max(1) + emit[:, t], score)
    path[:, -1] = score.argmax(1)
    for t in range(length - 1, 0, -1):
        path[:, t - 1] = np.take_along_axis(back[t - 1], path[:, t, None], 1)[:, 0]
    return path


#: Written for the fit: parts from which refusals are composed: openings, what can't be done, to what, why.
_REFUSAL_PARTS = {
    "en": (("", "I'm sorry, but", "Unfortunately,", "I apologize, but", "I'm afraid", "Thank you for asking; however,", "I understand why you ask, but", "As an assistant,", "Sorry, but", "Apologies, but", "Regrettably,"),
           ("I can't help with", "I cannot answer", "I am not able to answer", "I'm unable to assist with", "I must decline to comment on", "I won't discuss", "I'm not allowed to share", "I have to decline", "I would rather not give an opinion on", "I do not feel able to respond to", "I can't provide", "I cannot share an answer to", "I'd rather not give an opinion on", "I'm not in a position to answer", "it would go beyond what I am allowed to do to answer", "it is beyond what I am permitted to say about"),
           ("that", "this request", "this question", "this company", "figures of this kind", "that information", "this topic"), ("", "at this time", "because of our policy", "under my guidelines", "for safety reasons")),
    "de": (("", "Es tut mir leid, aber", "Leider", "Bedauerlicherweise", "Ich bitte um Verständnis, aber", "Vielen Dank für die Anfrage, doch", "Als Assistent", "Entschuldigung, aber"),
           ("kann ich nicht helfen bei", "kann ich dabei nicht helfen, und zwar bei", "darf ich nicht beantworten", "ist es mir nicht möglich zu beantworten", "muss ich ablehnen:", "möchte ich mich nicht äußern zu", "kann ich keine Auskunft geben zu", "werde ich keine Stellung nehmen zu", "ich kann nicht behilflich sein bei", "bin ich nicht in der Lage, Auskunft zu geben zu", "sehe ich mich außerstande zu antworten auf", "ich darf keine Angaben machen zu"),
           ("dieser Frage", "diese Frage", "dieser Anfrage", "diese Anfrage", "diesem Unternehmen", "solchen Zahlen"), ("", "weil die Richtlinien das nicht zulassen", "zurzeit", "aus rechtlichen Gründen")),
    "fr": (("", "Je suis désolé, mais", "Malheureusement,", "Désolé,", "Merci pour votre message ; toutefois,", "Je regrette, mais", "En tant qu'assistant,", "Je comprends votre demande, mais"),
           ("je ne peux pas répondre à", "je ne suis pas en mesure de vous aider pour", "je dois décliner", "il m'est impossible de commenter", "je ne suis pas autorisé à répondre à", "je préfère ne pas donner d'avis sur", "je ne peux pas vous aider avec", "je refuse de commenter", "je ne peux fournir"),
           ("cette question", "cette demande", "cette société", "ce type de chiffres", "ce sujet"), ("", "en raison de nos règles d'utilisation", "pour le moment", "pour des raisons de politique interne")),
    "es": (("", "Lo siento, pero", "Por desgracia,", "Lamentablemente,", "Gracias por la consulta; sin embargo,", "Me temo que", "Como asistente,", "Disculpe, pero"),
           ("no puedo ayudarle con", "no puedo responder a", "debo rechazar", "no me está permitido comentar", "no estoy en condiciones de responder a", "prefiero no opinar sobre", "me veo obligado a declinar", "no me es posible contestar", "no puedo facilitar datos sobre"),
           ("esta petición", "esta pregunta", "la consulta", "esta empresa", "este tipo de cifras"), ("", "por nuestras normas de uso", "en este momento", "por motivos de política interna")),
    "it": (("", "Mi dispiace, ma", "Purtroppo"), ("non posso rispondere a", "non sono in grado di aiutarla con", "devo rifiutare"), ("questa domanda", "questa richiesta"), ("", "in base alle nostre regole")),
    "pt": (("", "Lamento, mas", "Infelizmente,"), ("não posso responder a", "não consigo ajudar com", "tenho de recusar"), ("esta pergunta", "este pedido"), ("", "devido às nossas regras")),
    "nl": (("", "Het spijt me, maar", "Helaas"), ("kan ik niet helpen met", "mag ik geen antwoord geven op", "moet ik weigeren:"), ("deze vraag", "dit verzoek"), ("", "vanwege ons beleid")),
    "pl": (("", "Przykro mi, ale", "Niestety"), ("nie mogę odpowiedzieć na", "nie mogę pomóc w sprawie", "muszę odmówić:"), ("to pytanie", "tej prośby"), ("", "ze względu na nasze zasady")),
    "ru": (("", "К сожалению,", "Извините, но"), ("я не могу ответить на", "я не могу помочь с", "я вынужден отклонить"), ("этот вопрос", "этим запросом"), ("", "из-за наших правил")),
}
#: Written for the fit: what may follow a refusal, by language.
_REFUSAL_TAILS = {"en": ("", "", "Please ask a professional.", "Do you need something else?", "Try asking your analyst instead."), "de": ("", "", "Fragen Sie bitte eine Fachkraft.", "Bitte wenden Sie sich an eine andere Stelle."), "fr": ("", "", "Adressez-vous à un spécialiste.", "Veuillez consulter un conseiller."), "es": ("", "", "Pregunte a un experto.", "Consulte a su asesor, por favor.")}


def composed_refusal(tongue: str, rng: np.random.Generator) -> str:
    """A refusal in `tongue` put together from its parts."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    said = " ".join(filter(None, (pick(p) for p in _REFUSAL_PARTS[tongue])))
    return f"{said[0].upper()}{said[1:]}. {pick(_REFUSAL_TAILS.get(tongue, ('',)))}".strip()


#: Written for the fit: short forms that want a figure behind them, where a sentence may break off.
_SHORT_FORMS = {"en": ("approx.", "ca.", "vs.", "No."), "de": ("ca.", "rd.", "Nr.", "z. B."), "fr": ("env.", "n°", "p. ex."), "es": ("aprox.", "núm.", "p. ej.")}
_LISTED = re.compile(r"\n\s*(?:[-*•–|]|\d{1,2}[.)])[^\n]*$")


def broken_off(response: str, tongue: str, rng: np.random.Generator) -> str:
    """`response` cut before its last sentence, list item or table row is complete; empty where it can't be."""
    start = response.rfind("\n") + 1
    line = response[start:]
    where = [m.end() for m in re.finditer(r"^\s*(?:[-*•–]|\d{1,2}[.)]) ?|:(?=.)|\|(?=.)", line)] if _LISTED.search(response) else []
    if where and rng.random() < 0.6:
        return response[: start + where[int(rng.integers(len(where)))]]
    sentence = max((m.end() for m in re.finditer(r"[.!?] ", response[:-2])), default=0)
    way = rng.random()
    blanks = [m.end() for m in re.finditer(r"\w ", response[sentence:])]
    if way < 0.3 and blanks and not where:
        forms = _SHORT_FORMS.get(tongue, _SHORT_FORMS["en"])
        return response[: sentence + blanks[int(rng.integers(len(blanks)))]] + forms[int(rng.integers(len(forms)))]
    if way < 0.42 and "(" not in response[sentence:] and not where:
        return f"{response[:sentence]}({response[sentence:] if rng.random() < 0.4 else response[sentence:].rstrip('.!? ')}"
    low = start + 1 if where else max(2, len(response) // 4)
    cut = response[: int(rng.integers(low, len(response)))].rstrip() if low < len(response) else ""
    return "" if not cut or cut[-1] in ".!?" or response[len(cut)] in ".!?" else cut


class PairTagger:
    """Language model and field, fitted on a bounded sample and shipped to the tasks."""

    def __init__(self, sample: list[tuple[str | None, str | None]]):
        self.lm = language.fit([t for pair in sample for t in pair if t])
        self.weights = fit_field([], [])
        clean = [(m, _INVISIBLE.sub("", r).strip()) for m, r in sample if m and bare_content(r) and bare_content(m)]
        every, found = clean, []
        for ridge, word_ridge, steps in FIT_ROUNDS if clean else ():
            self.weights = fit_field(*self._altered(clean, found), steps, ridge=ridge, word_ridge=word_ridge)
            batch = Batch([x for _, x in self.describe(every, Features())])
            score = batch.emissions(*self.weights[:2])
            # Where refusal comes near, the pair is not sure enough to stand as an answer.
            near = ((score[..., _REFUSED] > score.max(2) - DOUBT) & batch.mask).any(1)
            first = [d for d, _ in self.defects(every, Features())]
            found = [pair for pair, d in zip(every, first) if d == "refusal"]
            clean = [pair for pair, d, doubt in zip(every, first, near) if d is None and not doubt] or clean

    def _altered(self, clean: list[tuple[str, str]], refusals: list[tuple[str, str]]) -> tuple[list, list[list[int]]]:
        """Features and tags of the pairs as they stand and altered, and of refusals found; the tags are those that the alteration makes."""
        rng = np.random.default_rng(7)
        tongue, asked = self._languages([r for _, r in clean]), self._languages([m for m, _ in clean])
        texts: list[tuple[str, str]] = []
        label: list = []

        def add(message: str, response: str, tag) -> None:
            texts.append((message, response))
            label.append(tag)

        for k, (m, r) in enumerate(clean):
            question, way = max(clauses(m), key=len, default=m), k % 6
            add(m, r, lambda i, n: "answer")
            if way == 0:
                said = question if k // 6 % 2 else m
                copy = (said, said.upper(), said.lower(), said.rstrip("?!. "), f"“{said}”", f"{question}\n{question}", f"Question: {said}", "  ".join(said.split(" ")), f"> {said}")[k // 12 % 9]
                add(m, copy, lambda i, n: "echo")
            elif way == 1:
                add(m, f"{question} {r}", lambda i, n: "echo" if i == 0 else "answer")
            elif way == 2:
                add(m, composed_refusal(asked[k] if rng.random() < 0.9 else language.LANGUAGES[int(rng.integers(9))], rng), lambda i, n: "refusal")
            elif way == 3:
                wished = wished_languages(m)
                other = [j % len(clean) for j in range(k + 1, k + 60) if tongue[j % len(clean)] not in (asked[k], *wished)]
                if other:
                    add(m, clean[other[0]][1], lambda i, n: "foreign")
            else:
                lists = [clean[j % len(clean)][1] for j in range(k, k + 40) if tongue[j % len(clean)] == tongue[k] and _LISTED.search(clean[j % len(clean)][1])] if way == 5 else []
                cut = broken_off(lists[0] if lists else r, tongue[k], rng)
                if bare_content(cut):
                    add(m, cut, lambda i, n: "unfinished" if i == n - 1 else "answer")
        for m, r in refusals:
            add(m, r, lambda i, n: "refusal")
        described = self.describe(texts, Features())
        tags = [[TAGS.index(tag(i, len(parts))) for i in range(len(parts))] for tag, (parts, _) in zip(label, described)]
        keep = [i for i, t in enumerate(tags) if t]
        return [described[i][1] for i in keep], [tags[i] for i in keep]

    def _languages(self, texts: list[str]) -> list[str]:
        ll = language.likelihoods([language.evidence(t, strict=False) for t in texts], self.lm)
        return [language.LANGUAGES[int(r.argmax())] for r in ll]

    def describe(self, pairs: list[tuple[str, str]], features: Features) -> list[tuple[list[str], list]]:
        """Clauses of each response and their features; one pass of the language model over all texts."""
        split = [clauses(r) for _, r in pairs]
        first = np.cumsum([0, *(len(p) + 1 for p in split)])
        ll = language.likelihoods([language.evidence(t) for (m, _), parts in zip(pairs, split) for t in (m, *parts)], self.lm)
        out = []
        for at, (m, r), parts in zip(first, pairs, split):
            allowed = [int(ll[at].argmax()), *(language.LANGUAGES.index(g) for g in wished_languages(m))]
            rows = ll[at + 1 : at + 1 + len(parts)]
            lead = np.where(np.ptp(rows, axis=1) > 0, np.delete(rows, allowed, axis=1).max(1) - rows[:, allowed].max(1), 0.0).tolist() if len(parts) else []
            out.append((parts, features.clauses(m, r, parts, lead)))
        return out

    def defects(self, pairs: list[tuple[str | None, str | None]], features: Features) -> list[tuple[str | None, dict[str, float]]]:
        """Each pair's defect, null if it has none, and the share of characters of each tag."""
        out: list = [("empty", {})] * len(pairs)
        full = [k for k, (_, r) in enumerate(pairs) if bare_content(r)]
        described = self.describe([(pairs[k][0] or "", _INVISIBLE.sub("", pairs[k][1]).strip()) for k in full], features)
        paths = viterbi(Batch([x for _, x in described]), *self.weights) if described else []
        for k, (parts, _), path in zip(full, described, paths):
            path = [int(t) for t in path[: len(parts)]]
            size = [len(p) for p in parts]
            share = {t: sum(n for n, p in zip(size, path) if p == j) / sum(size) for j, t in enumerate(TAGS)}
            out[k] = (_decide(share, path), share)
        return out


def _decide(share: dict[str, float], path: list[int]) -> str | None:
    leading = next((TAGS[t] for t in path if TAGS[t] != "echo"), "answer")
    if share["refusal"] > 0 and (leading == "refusal" or share["refusal"] >= share["answer"]):
        return "refusal"
    if share["echo"] > 0.99:
        return "copied_question"
    if share["foreign"] > 0 and share["foreign"] >= share["answer"]:
        return "other_language"
    return "truncated" if share["unfinished"] > 0 else None


def hash_order(key) -> str:
    """An order of ids that has nothing to do with their values."""
    return hashlib.md5(str(key).encode()).hexdigest()


def fit_sample(requests: DataFrame, responses: DataFrame, id_col: str, message_col: str, response_col: str) -> list[tuple[str | None, str | None]]:
    """Messages and responses of FIT_PAIRS distinct request ids by hash, as they are tagged: one pair an id, less those without response."""
    ids = F.broadcast(requests.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("pair_key")).distinct().orderBy(F.xxhash64("pair_key"), "pair_key").limit(FIT_PAIRS))
    asked = requests.select(F.col(id_col).alias("pair_key"), F.col(message_col).alias("q")).join(ids, "pair_key").groupBy("pair_key").agg(F.min("q").alias("q"))
    told = responses.select(F.col(id_col).alias("pair_key"), F.col(response_col).alias("a")).join(ids, "pair_key").groupBy("pair_key").agg(F.min("a").alias("a"))
    sample = asked.join(told, "pair_key").select("pair_key", "q", "a").collect()
    return [(r[1], r[2]) for r in sorted(sample, key=lambda r: hash_order(r[0]))]


def tag_pairs(requests: DataFrame, responses: DataFrame, id_col: str = "request_id", message_col: str = "message", response_col: str = "response") -> DataFrame:
    """(id, defect) for each id present in both tables; defect is null for sound pairs.

    Repeated rows count once (of differing rows the smallest text stands); a null message is compared as an empty one; a null
    or empty response is `empty`; null ids never pair; long responses are tagged whole; other columns are not read; empty
    tables give an empty result. Both sides are hashed once on the id, which is unique, so no key is hot.
    """
    left = requests.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("pair_key")).agg(F.min(message_col).alias("q"))
    right = responses.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("pair_key")).agg(F.min(response_col).alias("a"))
    sample = fit_sample(requests, responses, id_col, message_col, response_col)
    tagger = requests.sparkSession.sparkContext.broadcast(PairTagger(sample))
    kind = requests.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, features = tagger.value, Features()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = judge.defects(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())), features)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in found], pa.string())], ["pair_key", "defect"])

    return left.join(right, "pair_key").select("pair_key", "q", "a").mapInArrow(run, f"pair_key {kind}, defect string").withColumnRenamed("pair_key", id_col)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, defect) of the defective pairs."""
    return tag_pairs(table(spark, sf_dir, "chat_requests"), table(spark, sf_dir, "chat_responses")).where(F.col("defect").isNotNull())


def p1_defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs per defect, `none` for sound pairs."""
    df = tag_pairs(table(spark, sf_dir, "chat_requests"), table(spark, sf_dir, "chat_responses"))
    return df.groupBy(F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n_pairs"))
