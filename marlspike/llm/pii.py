"""Personal data in free text: offset-preserving deobfuscation, detection, and placeholders.

Three small transducers rewrite a text for detection only, each output character carrying the position of the source
character it came from: (1) look-alike letters, full-width forms, odd blanks, dashes and invisible characters become plain
ones; (2) runs of spelled digits become digits; (3) `(at)`, `at`, `(dot)`, `dot` and blanks round `@` become `@` and `.`.
Identifiers are found in the rewritten text and their spans mapped back, so the source text itself is never changed but
for the placeholders.

Names are told by shape, context and corpus counts. Every word of the corpus is counted, in all its places and in the seats that
only names take (behind a form of address, or where a writer introduces themself); the counts are kept in a table of fixed
size, by hash. Words that often take such seats are name words: two of them in the shape of a full name are a name
wherever they stand. Words that the corpus doesn't know are a name where a cue and their capitals say so; words common
elsewhere never are.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from .language import FUNCTION_WORDS

#: Letters of other scripts that look like Latin ones, paired in order.
_LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсѕухԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABESIJKMHOPCTYXaeijopcsyxdhqwABEZHIKMNOPTYXoav"))
#: Digits spelled in English, German, French and Spanish.
_DIGIT_WORDS = {w: str(i) for ws in (
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(ws.split())} | {"oh": "0", "zwo": "2"}
_DIGIT_RUN = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(_DIGIT_WORDS)})(?:[\s,.-]+(?:{'|'.join(_DIGIT_WORDS)})){{3,}}(?!\w)")
_DIGIT_WORD = re.compile(rf"(?i){'|'.join(sorted(_DIGIT_WORDS, key=len, reverse=True))}")
_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_DOT = rf"(?:{_OPEN}(?:dot|punkt|punto|point|\.){_CLOSE}|\s+(?:dot|punkt|punto|point)\s+|\.)"
_AT = rf"(?:{_OPEN}(?:at|ät|arroba|a|@){_CLOSE}|\s+(?:at|ät|arroba)\s+|\s*@\s*)"
_MAIL_DISGUISE = re.compile(rf"(?i)(?<![\w.+-])[\w.%+-]+(?P<at>{_AT})[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}(?![\w-])")
_DOT_PART = re.compile(rf"(?i){_DOT}")


class _Plain(dict):
    """What each character becomes on the tape, worked out once: nothing, itself, or its plain form."""

    def __missing__(self, ch: str) -> str:
        kind, to = unicodedata.category(ch), _LOOKALIKES.get(ch)
        if kind in ("Cf", "Mn"):
            to = ""
        elif to is None:
            to = " " if kind == "Zs" else "-" if kind == "Pd" or ch == "−" else ch if ord(ch) < 0x250 else unicodedata.normalize("NFKC", ch)
        self[ch] = to
        return to


_PLAIN = _Plain()


class Tape:
    """A text under rewriting with, for each character, its position in the source."""

    def __init__(self, source: str):
        out, at = [], []
        if source.isascii():
            out, at = list(source), list(range(len(source)))
        else:
            for i, ch in enumerate(source):
                for c in _PLAIN[ch]:
                    out.append(c)
                    at.append(i)
        self.text, self.at, self.length = "".join(out), at, len(source)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, disjoint); new characters take the position of the span's start."""
        if not edits:
            return
        parts, at, last = [], [], 0
        for start, end, to in edits:
            parts += [self.text[last:start], to]
            at += self.at[last:start] + [self.at[start]] * len(to)
            last = end
        self.text, self.at = "".join([*parts, self.text[last:]]), at + self.at[last:]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source span of [start, end)."""
        return self.at[start], self.at[end - 1] + 1


_AT_WORDS, _DOT_WORDS = {"at", "ät", "arroba"}, {"dot", "punkt", "punto", "point"}
_AT_SIGN = re.compile(r"(?i)@|[\[({<]\s*a\s*[\])}>]")
_ANY_WORD = re.compile(r"[^\W\d_]+")


def deobfuscate(source: str) -> Tape:
    """Run the three transducers; each only where a word or mark that it needs is there."""
    tape = Tape(source)
    words = tape.words = set(_ANY_WORD.findall(tape.text.lower()))
    edits = []
    for m in _DIGIT_RUN.finditer(tape.text) if not words.isdisjoint(_DIGIT_WORDS) else ():
        last = m.start()
        for w in _DIGIT_WORD.finditer(tape.text, m.start(), m.end()):
            edits.append((last, w.end(), _DIGIT_WORDS[w.group().lower()]))
            last = w.end()
    tape.rewrite(edits)
    edits = []
    disguised = (not words.isdisjoint(_AT_WORDS) or _AT_SIGN.search(tape.text)) and ("." in tape.text or not words.isdisjoint(_DOT_WORDS))
    for m in _MAIL_DISGUISE.finditer(tape.text) if disguised else ():
        if m.group("at") != "@" or _DOT_PART.search(m.group(), m.end("at") - m.start()).group() != ".":
            edits.append((m.start("at"), m.end("at"), "@"))
            edits += [(d.start(), d.end(), ".") for d in _DOT_PART.finditer(tape.text, m.end("at"), m.end()) if d.group() != "."]
    tape.rewrite(edits)
    return tape


_EMAIL = re.compile(r"(?i)(?<![\w.+%-])[\w+%-](?:[\w.+%-]*[\w+%-])?@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(?![\w-])")
_ID = re.compile(r"""(?x)(?<![\w.,/-])(?:
    \d{3}[ -]\d{2}[ -]\d{4}                                    # social security, three-two-four
  | [A-Za-z]{2}\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-Da-d]             # insurance number, letters round six digits
  | [12347]\ \d{2}\ \d{2}\ (?:\d{2}|2[AB])\ \d{3}\ \d{3}(?:\ \d{2})?   # register number, fifteen digits in groups
  | \d{3}\ \d{3}\ \d{3}\ \d{2} | \d{2}\ \d{3}\ \d{3}\ \d{3}    # tax number, eleven digits
  | \d{8}-?[A-Za-z] | [A-Za-z]-?\d{7,8}(?:-?[A-Za-z])?         # identity card, passport
  )(?![\w/]|[-.]\d)""")
_ID_CUED = re.compile(r"(?i)(?:passe?port|pasaporte|reisepass|ausweis|dni|n\.?i\.?e\.|nif|ssn|tax (?:no|id|number)|steuer(?:nummer|-?id)|social security number|sécurité sociale)(?!\w)\W{0,3}(?:n[or°]\.?|number|nummer|num[ée]ro|is|es|lautet|:)*\s*((?=[\w -]*\d)[A-Z0-9][A-Z0-9 /-]{4,20}[A-Z0-9])(?![\w])")
_PHONE = re.compile(r"""(?x)(?<![\w.,/+-])(?:
    (?:\+|00)\d{1,3}[ ./-]?(?:\(0\)[ ]?)?\(?\d{1,5}\)?(?:[ ./-]?\d{2,8}){1,5}
  | (?:1[-. ])?\([2-9]\d{2}\)[ -]?\d{3}[ .-]\d{4}
  | (?:1[-. ])?[2-9]\d{2}([-. ])\d{3}\1\d{4}
  | [2-9]\d{2}555\d{4} | 0[1-9]\d{8,10}
  | 0\d(?:[ .-]?\d{2}){4}
  | \(?0\d{1,5}\)?[ /-]\d{3,8}(?:[ -]\d{2,5}){0,3}
  )(?:\ ?(?:ext\.?|x|durchwahl)\ ?\d{1,5})?(?![\w/]|[-.]\d)""")
#: Words that announce numbers which are no personal data.
_NO_PERSON = re.compile(r"(?i)(?:ticket|invoice|inv|part(?: code)?|code|accession(?: number)?|order|case|reference|ref|range|rate(?: of)?|rechnung|factura|facture|teil|filing|file number|serial|sku|item)(?: (?:no|nr|number|is|of|the))*\W{0,3}$")
_STREET_EN = r"street|avenue|road|lane|drive|court|way|row|close|place|square|terrace|boulevard|crescent|hill|gardens|grove|mews|parade|walk|st\.|ave\.?|rd\.|blvd\.?|ln\.|dr\.|ct\."
_STREET_FR = r"rue|avenue|chemin|impasse|boulevard|place|allée|allee|quai|route|cours|passage|ruelle|sentier|square|faubourg|villa"
_STREET_ES = r"calle|avenida|plaza|paseo|camino|carrera|carretera|ronda|travesía|travesia|callejón|callejon|glorieta|avda\.?|c/"
_STREET_IT = r"via|viale|piazza|corso|largo|vicolo"
_STREET_DE = r"straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring|steig|stieg|graben|markt|chaussee|pfad|wall|berg"
_ADDRESS_NUMBER_FIRST = re.compile(rf"""(?xi)(?<![\w.,/-])(?:
    \d{{1,5}}[a-z]?\ (?:[^\W\d_][\w'’.-]*\ ){{1,3}}(?:{_STREET_EN})(?!\w)
  | \d{{1,4}}(?:\ ?(?:bis|ter))?,?\ (?:{_STREET_FR})\ (?:(?:de\ la|de\ l['’]|du|des|de|d['’]|la|le|les)\ ?)?[^\W\d_][\w'’-]*
  )""")
_ADDRESS_STREET_FIRST = re.compile(rf"(?xi)(?<![\w.,/-])(?:{_STREET_ES}|{_STREET_IT})\ (?:[^\W\d_][\w'’.-]*\ ){{1,5}}(?:n[.º°]?\ ?)?\d{{1,4}}(?!\w|[.,]\d)")
_ADDRESS_DE = re.compile(rf"(?xi)(?<![\w.,/-])(?:[^\W\d_][\w'’-]*[\ -])?[^\W\d_][\w-]*(?:{_STREET_DE})\ \d{{1,4}}\ ?[a-z]?(?!\w|[.,]\d)")
_ADDRESS_AM = re.compile(r"(?xi)(?<![\w.,/-])(?:am|an\ der|an\ den|auf\ dem|auf\ der|im|in\ der|zum|zur|unter\ den|hinter\ der|vor\ dem|beim)\ (?-i:[A-ZÄÖÜ])[\w-]+\ \d{1,3}[a-z]?(?=,\ ?\d{4,5}\ )")
_HINT_FIRST = frozenset(w.strip("\\.?") for w in f"{_STREET_EN}|{_STREET_FR}".split("|"))
_HINT_STREET = frozenset(w.strip("\\.?") for w in f"{_STREET_ES}|{_STREET_IT}".split("|")) - {"c/"}
_HINT_DE = re.compile(rf"(?i)(?:{_STREET_DE})\ \d")
_HINT_AM = re.compile(r"\d[a-z]?, ?\d{4,5} ")
_HINT_ID = ("pass", "pasaporte", "ausweis", "dni", "n.i.e", "nie", "nif", "ssn", "tax ", "steuer", "social")
_GERMAN_LEAD = re.compile(r"(?i)(?:lautet|in|an|nach|ist|bei|to|at|the|au|en|from|to the)[ -]")
#: Forms of address, and the ways in which writers introduce themselves; only a name stands behind them.
_ADDRESS_FORMS = "ms mr mrs mx miss dr prof herr herrn frau señor señora sr sra srta mme mlle monsieur madame"
_INTRODUCTIONS = "my name is|i am called|mein name ist|ich heiße|ich heisse|je m['’]appelle|mon nom est|me llamo|mi nombre es"
#: Words before which a person is spoken to or of, and nouns that a person's name explains.
_TO_PERSON = ("ask|asked|contact|reach|call|tell|inform|notify|email|thank|thanks to|meet|met|dear|attn|attention|signed|sincerely|regards|regards to|greetings to|on behalf of|"
              "frag|fragen sie|kontaktieren sie|grüße an|gruße an|gruß an|gruss an|liebe|lieber|gezeichnet|demandez à|contactez|bonjour à|cher|chère|cordialement|pregunte a|pregunta a|contacte a|contacte con|saludos a|estimado|estimada|atentamente|dile a")
_ROLES = ("supervisor|manager|boss|colleague|assistant|secretary|advisor|adviser|lawyer|attorney|accountant|doctor|wife|husband|partner|son|daughter|brother|sister|mother|father|friend|neighbour|neighbor|tenant|client|customer|contact|contact person|applicant|employee|"
          "chef|chefin|kollege|kollegin|vorgesetzter|vorgesetzte|kunde|kundin|frau|mann|freund|freundin|ansprechpartner|ansprechpartnerin|client|cliente|patron|collègue|mari|femme|ami|amie|jefe|jefa|colega|esposo|esposa|amigo|amiga")
_TITLE = rf"(?:(?:{'|'.join(_ADDRESS_FORMS.split())})\b\.? )?"
_SURE = re.compile(rf"(?i)(?<!\w)(?:(?:{_INTRODUCTIONS}) {_TITLE}|(?:{'|'.join(_ADDRESS_FORMS.split())})\b\.? )")
_longest_first = lambda words: "|".join(sorted(words.split("|"), key=len, reverse=True))
_CUE = re.compile(rf"(?i)(?<!\w)(?:(?:{_longest_first(_TO_PERSON)})[:,]? |(?:{_longest_first(_ROLES)})(?:(?: is| ist| est| es|,? named| called| heißt)?[:,]?) ){_TITLE}")
_SURE_WORDS = frozenset(_ADDRESS_FORMS.split()) | {"name", "called", "heiße", "heisse", "appelle", "nom", "llamo", "nombre"}
_CUE_WORDS = frozenset(w.split()[0] for w in f"{_TO_PERSON}|{_ROLES}".split("|")) - {"on"} | {"behalf"}
_STOP = frozenset(w for g in ("en", "de", "fr", "es") for w in FUNCTION_WORDS[g].split())
#: A word: letters, figures behind the first, with apostrophes and hyphens inside.
_NAME_WORD = re.compile(r"[^\W\d_](?:[\w'’-]*\w)?")

#: Words are counted by hash in a table of this size, whatever the corpus holds.
NAME_BUCKETS = 1 << 20
#: A word is a name word from this many seats, and this share of its places, on; it is common from these places on, with a lower share.
MIN_SEATS, NAME_SHARE, COMMON_PLACES, COMMON_SHARE = 2, 0.1, 5, 0.02


class _Memo(dict):
    """Kinds of words, each worked out once within a task; forgotten when there are too many."""

    def __init__(self, kinds: np.ndarray):
        super().__init__()
        self.kinds = kinds

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        low = word.lower()
        self[word] = kind = -1 if low in _STOP else int(self.kinds[zlib.crc32(low.encode("utf-8", "replace")) % NAME_BUCKETS])
        return kind


class NameWords:
    """What the corpus counts tell of a word, in whatever case: 1 a name word, -1 a common one, 0 neither."""

    def __init__(self, buckets: np.ndarray | None = None, places: np.ndarray | None = None, seats: np.ndarray | None = None):
        self.kinds = np.zeros(NAME_BUCKETS, np.int8)
        if buckets is not None and len(buckets):
            share = seats / np.maximum(places, 1)
            self.kinds[buckets[(seats >= MIN_SEATS) & (share >= NAME_SHARE)]] = 1
            self.kinds[buckets[(places >= COMMON_PLACES) & (share < COMMON_SHARE)]] = -1

    def memo(self) -> _Memo:
        """A look-up that remembers."""
        return _Memo(self.kinds)


_UNFITTED = NameWords().memo()


def fit_names(df: DataFrame, text_col: str) -> NameWords:
    """Counts of all words of the corpus, in all places and in the seats of names; at most NAME_BUCKETS rows reach the driver."""
    word = r"\p{L}(?:[\p{L}\p{M}\p{N}_'’-]*[\p{L}\p{M}\p{N}_])?"
    name = rf"({word}(?:,? {word}\.?){{1,2}})"
    seat = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:(?:{_INTRODUCTIONS}) {_TITLE}|(?:{'|'.join(_ADDRESS_FORMS.split())})\b\.? ){name}"
    bucket = lambda w: F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(NAME_BUCKETS)).alias("bucket")
    text = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
    places = text.select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(word), 0)).alias("w")).select(bucket(F.col("w")), F.lit(1).alias("p"), F.lit(0).alias("s"))
    # The first two words behind a cue take the seats, initials aside.
    two = lambda n: F.slice(F.filter(F.regexp_extract_all(F.lower(n), F.lit(word), 0), lambda w: F.length(w) > 1), 1, 2)
    seats = text.where(F.col("t").rlike(seat)).select(F.explode(F.flatten(F.transform(F.regexp_extract_all("t", F.lit(seat), 1), two))).alias("w")).select(bucket(F.col("w")), F.lit(0).alias("p"), F.lit(1).alias("s"))
    rows = places.unionByName(seats).groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("s").alias("s")).where((F.col("s") >= MIN_SEATS) | (F.col("p") >= COMMON_PLACES)).toPandas()
    return NameWords(*(rows[c].to_numpy(np.int64) for c in ("bucket", "p", "s")))


class _Tokens:
    """Words of a text with the shapes of full names that begin at each."""

    def __init__(self, text: str):
        self.text = text
        found = list(_NAME_WORD.finditer(text))
        self.words, self.start, self.end = [m.group() for m in found], [m.start() for m in found], [m.end() for m in found]

    def gap(self, i: int) -> str:
        """What stands between words i and i + 1."""
        return self.text[self.end[i] : self.start[i + 1]] if i + 1 < len(self.words) else ""

    def _initial(self, i: int) -> bool:
        return i < len(self.words) and len(self.words[i]) == 1 and self.text[self.end[i] : self.end[i] + 1] == "."

    def shapes(self, i: int) -> Iterator[tuple[list[int], int, bool]]:
        """(places of the full words, last place, surname first) for each shape at word i."""
        n, one = len(self.words), len(self.words[i]) == 1
        if one and self._initial(i):
            j = i + 1
            while self._initial(j) and self.gap(j - 1) in (".", ". "):
                j += 1
            if j < n and len(self.words[j]) > 1 and self.gap(j - 1) in (".", ". "):
                yield [j], j, False
        elif not one and i + 1 < n:
            gap = self.gap(i)
            if gap == " " and len(self.words[i + 1]) > 1:
                yield [i, i + 1], i + 1, False
            elif gap == " " and self._initial(i + 1) and i + 2 < n and len(self.words[i + 2]) > 1 and self.gap(i + 1) == ". ":
                yield [i, i + 2], i + 2, False
            elif gap == ", " and len(self.words[i + 1]) > 1:
                yield [i, i + 1], i + 1, True
            elif gap == ", " and self._initial(i + 1):
                yield [i], i + 1, True


def find_names(text: str, words: _Memo, low: set[str]) -> list[tuple[int, int]]:
    """Spans of full names in rewritten `text`, by shape, corpus counts and context; `low` holds its words in lower case."""
    kinds = list(map(words.__getitem__, _NAME_WORD.findall(text)))
    if 1 not in kinds and low.isdisjoint(_SURE_WORDS) and low.isdisjoint(_CUE_WORDS):
        return []
    sure = {m.end() for m in _SURE.finditer(text)} if not low.isdisjoint(_SURE_WORDS) else set()
    cued = {m.end() for m in _CUE.finditer(text)} if not low.isdisjoint(_CUE_WORDS) else set()
    if not sure and not cued and 1 not in kinds:
        return []
    tokens = _Tokens(text)
    capital = lambda i: tokens.words[i][0].isupper() and not tokens.words[i].isupper()
    used, spans = set(), []

    def take(i: int, last: int, may_extend: bool) -> None:
        while may_extend and last + 1 < len(kinds) and tokens.gap(last) == " " and kinds[last + 1] == 1 and len(tokens.words[last + 1]) > 1:
            last += 1
        if used.isdisjoint(range(i, last + 1)) and not _COMPANY_TAIL.match(text, tokens.end[last]):
            used.update(range(i, last + 1))
            spans.append((tokens.start[i], tokens.end[last] + (len(tokens.words[last]) == 1)))

    # Name words by the corpus in the shape of a name, wherever they stand; two full words before one with initials.
    for size in (2, 1):
        for i in range(len(kinds)):
            if i not in used and (kinds[i] == 1 or len(tokens.words[i]) == 1):
                for full, last, turned in tokens.shapes(i):
                    if len(full) == size and all(kinds[j] == 1 for j in full):
                        take(i, last, not turned)
    for i in range(len(kinds)):
        if i in used:
            continue
        for full, last, turned in tokens.shapes(i):
            known, common, shaped = sum(kinds[j] == 1 for j in full), any(kinds[j] == -1 for j in full), all(map(capital, full))
            if common or last in used:
                continue
            if tokens.start[i] in sure and (shaped or not any(kinds[j] == -1 for j in range(i, last + 1))):
                take(i, last, not turned)
            elif tokens.start[i] in cued and shaped:
                take(i, last, not turned)
            elif known and shaped and len(full) == 2 and not turned:
                take(i, last, True)
    return sorted(spans)


_COMPANY_TAIL = re.compile(r"(?i)(?: &)?(?: [\w.&-]+){0,2} (?:inc|corp|ltd|plc|co|gmbh|ag|sa|s\.a|nv|llc|asa|spa|k\.k|trust|group|instruments|holdings?)(?!\w)")


def _before(text: str, at: int, words: int = 6) -> int:
    """Where the last `words` words before `at` begin."""
    for _ in range(words):
        at = max(text.rfind(" ", 0, at), 0)
    return at


def find_personal_data(source: str | None, names: _Memo = _UNFITTED) -> list[tuple[str, int, int]]:
    """(type, start, end) spans of `source` in order, disjoint; none for null or empty text. `names` holds the corpus counts."""
    if not source:
        return []
    tape = deobfuscate(source)
    text, spans, taken = tape.text, [], []

    def add(kind: str, start: int, end: int) -> None:
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            spans.append((kind, *tape.span(start, end)))

    for m in _EMAIL.finditer(text) if "@" in text else ():
        add("email", *m.span())
    if any(map(str.isdigit, text)):
        low, words, found = text.lower(), tape.words, []
        if not words.isdisjoint(_HINT_FIRST):
            found += [m.span() for m in _ADDRESS_NUMBER_FIRST.finditer(text)]
        if not words.isdisjoint(_HINT_STREET) or "c/" in low:
            found += [m.span() for m in _ADDRESS_STREET_FIRST.finditer(text)]
        if _HINT_DE.search(text):
            found += [m.span() for m in _ADDRESS_DE.finditer(text)]
        if _HINT_AM.search(text):
            found += [m.span() for m in _ADDRESS_AM.finditer(text)]
        for a, b in sorted(found):
            while lead := _GERMAN_LEAD.match(text, a, b) if not text[a].isdigit() else None:
                a = lead.end()
            add("address", a, b)
        for m in _ID.finditer(text):
            if not _NO_PERSON.search(text, _before(text, m.start()), m.start()):
                add("id_number", *m.span())
        for m in _ID_CUED.finditer(text) if any(h in low for h in _HINT_ID) else ():
            add("id_number", *m.span(1))
        for m in _PHONE.finditer(text):
            if not _NO_PERSON.search(text, _before(text, m.start()), m.start()):
                add("phone", *m.span())
    for a, b in find_names(text, names, tape.words):
        add("name", a, b)
    return sorted(spans, key=lambda s: s[1])


def redact(source: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """`source` with each span replaced by `[TYPE]`."""
    if not spans:
        return source
    parts, last = [], 0
    for kind, a, b in spans:
        parts += [source[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*parts, source[last:]])


def scan_personal_data(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds to (id, text) rows: spans ARRAY<STRUCT<pii_type, span_start, span_end>> and redacted.

    Names by the corpus counts of this very table (`fit_names`); then one narrow Arrow stage. Null text has no spans and a null redaction; empty text stays empty; repeated rows stay; long texts
    are scanned whole; other columns are not read; an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = df.sparkSession.sparkContext.broadcast(fit_names(df, text_col))
    span_type = pa.list_(pa.struct([("pii_type", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = names.value.memo()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find_personal_data(t, words) for t in texts]
            spans = pa.array([[{"pii_type": k, "span_start": a, "span_end": b} for k, a, b in f] for f in found], span_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, pa.array([redact(t, f) for t, f in zip(texts, found)], pa.string())], ["scan_key", "spans", "redacted"])

    src = spread(df.select(F.col(id_col).alias("scan_key"), F.col(text_col).alias("scan_text")))
    out = src.mapInArrow(run, f"scan_key {kind}, spans array<struct<pii_type:string,span_start:int,span_end:int>>, redacted string")
    return out.withColumnRenamed("scan_key", id_col)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, pii_type, span_start) of each piece of personal data in chat_requests.message."""
    scanned = scan_personal_data(table(spark, sf_dir, "chat_requests"), "request_id", "message")
    return scanned.select("request_id", F.explode("spans").alias("s")).select("request_id", "s.pii_type", "s.span_start").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, message) of the distinct requests with personal data replaced by typed placeholders."""
    scanned = scan_personal_data(table(spark, sf_dir, "chat_requests"), "request_id", "message")
    return scanned.where(F.size("spans") > 0).select("request_id", F.col("redacted").alias("message")).distinct()
