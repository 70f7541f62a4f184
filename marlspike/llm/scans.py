"""Noise of scanned pages: broken words, misread letters, running headers and page numbers; and their repair.

Words of the whole corpus are counted once and grouped by a skeleton in which glyphs that scanners confuse fall together
(`rn`/`m`, `cl`/`d`, `ii`/`u`, `ri`/`n`, `e`/`c`, `t`/`f`, `i`/`l`/`1`, `o`/`0` and so on). In a group, a form much rarer than
its most frequent form is a candidate misreading, accepted where the frequent form is supported by the neighbouring words.
Word ends broken by a hyphen are judged by the counts of the joined and of the hyphenated form. Headers are found by masks:
in each line shaped like a title digits become 9 and the source's name §, pages are counted per mask, a section heading that
recurs as a line of its own becomes ¶ inside others, and masks whose pattern recurs are proposed; of these a line is a header
if it names a report, a continued section or the contents, or if its numbers change from page to page at the page's edge.
Page numbers are told by their forms and the breadcrumb; `reflow` joins the lines with SQL windows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, small_or_shuffled, spread, table
from .pages import pages_once

#: Glyph sequences, then single glyphs, that scanners confuse, each with the representative of its class.
SEQUENCES = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n"))
SINGLES = ("0158@$|!icfqh69", "olsbasllletgbbg")
#: A frequent form has at least TOP_COUNT occurrences and RATIO times those of the misreading; without a neighbour to ask, LONE_RATIO times.
TOP_COUNT, RATIO, LONE_RATIO, SUPPORT = 8, 20, 60, 3
#: Bits of the filter by which misreadings are looked for in one pass, however many there are; what passes it is joined exactly.
FILTER_BITS = 1 << 26
#: Pages on which a header's pattern recurs at least, and a heading stands alone; for lines that no phrase names, pages, share at a
#: page's first or last two lines of text, and share of different wordings under the mask.
HEADER_PAGES, HEADING_PAGES, UNNAMED_PAGES, UNNAMED_EDGE, UNNAMED_FORMS = 3, 3, 20, 0.6, 0.5
#: Entries a task counts before it hands them on.
FLUSH = 400_000

_STRIP = ".,;:()“”„\"’‘'?<>[]{}*#—–-‐‑¬­%&/=~·•»«©…"
_MARKS = "-‐‑­¬"
_WORDLIKE = re.compile(r"^(?=(?:.*[^\W\d_]){2})[\w@$|!’'‐-]+$")
_SYMBOL_INSIDE = re.compile(r"[0-9@$|!]")
_BROKEN = re.compile(rf"([^\W\d_][\w@$|!’'-]*)[{_MARKS}]\s*$")
_SPACES = re.compile(r"\s+")
_REPORT = re.compile(r"(?i)(?:\b(?:annual|quarterly|interim|half[- ]year(?:ly)?|current) report\b|\bform (?:10-?[kq]|8-?k|20-?f|6-?k)\b|\btable of contents\b|\(\s*(?:continued|cont(?:['’]d|\.|inued)?)\s*\)|\bcontinued\s*$|\bproxy statement\b)")
_SMALL = {"and", "of", "to", "the", "in", "for", "on", "per", "with", "continued", "cont", "cont'd", "a", "an", "und", "plc", "s", "&", "from", "at", "by"}
_PAGE_NO = re.compile(r"(?ix)^\W*(?:(?:page|pg\.?|p\.|seite|página|pagina)\s*)?(?:[a-z]-)?(\d{1,4})(?:\s*(?:of|/|von|de)\s*\d{1,5})?\W*$")
_ROMAN = re.compile(r"^\W*(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:ix|iv|v?i{0,3})\W*$")
_CRUMB_PAGE = re.compile(r"\bPage:?\s*(\d+)")
_CRUMB_SOURCE = re.compile(r"\[Company:\s*([^\]|;]+)")
_WORDS, _DIGITS = re.compile(r"[^\W_]+"), re.compile(r"\d+")


def word_of(token: str) -> str | None:
    """The lower-case word of a token, None if it is no word (amounts, codes, marks)."""
    w = token.strip(_STRIP).lower().replace("’", "'").replace("‐", "-")
    if not w or not _WORDLIKE.match(w):
        return None
    return w if 2 * sum(c.isdigit() for c in w) <= len(w) else None


def title_shaped(line: str) -> bool:
    """A line without a word that would make it part of a sentence; figures count as words with a capital."""
    s = _SPACES.sub(" ", line).strip()
    if s[-1:] in ",;:" or re.search(r"[.!?]\s+[A-Z][a-z]+ [a-z]", s):
        return False
    words = re.findall(r"[^\W_][^\s|,()—–]*", s)
    if any(w[0].islower() and w.lower().strip(".,;:") not in _SMALL for w in words):
        return bool(re.fullmatch(r"(?i)table of contents", s))
    return any(w[0].isupper() or w[0].isdigit() for w in words)


def header_mask(line: str, source: list[str]) -> str:
    """Words of a line in lower case with digits masked by 9 and the words of `source` by §."""
    words, out, k = [w.lower() for w in _WORDS.findall(line)], [], 0
    while k < len(words):
        if source and words[k : k + len(source)] == source:
            out.append("§")
            k += len(source)
        else:
            out.append(_DIGITS.sub("9", words[k]))
            k += 1
    return " ".join(out)


def page_number(line: str, crumb_page: str | None) -> bool:
    """A line that holds only a page number; a bare number must be the breadcrumb's, or short where there is none."""
    s = line.strip()
    if not s:
        return False
    m = _PAGE_NO.match(s)
    if m:
        if s.isdigit():
            return s == crumb_page or (crumb_page is None and len(s) <= 3)
        if re.fullmatch(r"[$€£(]*[\d.,]+[%)]*[.,;:]?", s):
            return s.strip(".") == crumb_page and not s.endswith(".")
        return m.group(1) == crumb_page or len(m.group(1)) <= 3
    return bool(_ROMAN.match(s)) and any(c.isalpha() for c in s)


class Page:
    """Lines of one page with what is seen without the corpus: page numbers, titles and words broken at the line's end."""

    def __init__(self, content: str, headers: frozenset[int] = frozenset()):
        """`headers` are the places of the lines known to be headers."""
        self.lines = content.split("\n")
        crumb = _CRUMB_PAGE.search(self.lines[0])
        number = crumb.group(1) if crumb else None
        self.page_no = [n for n in range(1, len(self.lines)) if self.lines[n] and page_number(self.lines[n], number)]
        noise = set(self.page_no) | headers
        #: (line, next line of text, first part, rest of the word)
        self.broken: list[tuple[int, int, str, str]] = []
        for n in range(1, len(self.lines) - 1):
            m = _BROKEN.search(self.lines[n]) if n not in noise and self.lines[n].rstrip()[-1:] in tuple(_MARKS) else None
            if m:
                nxt = next((k for k in range(n + 1, len(self.lines)) if k not in noise and self.lines[k].strip()), None)
                if nxt is not None:
                    rest = self.lines[nxt].split()[0].strip(_STRIP)
                    if rest and rest[0].isalpha() and (rest[0].islower() or m.group(1).isupper()):
                        self.broken.append((n, nxt, m.group(1), rest))
        self.noise = noise

    def titles(self, source: str | None) -> list[tuple[int, str, bool, bool]]:
        """(place, mask, whether a phrase names it, whether it stands at the page's edge) of the lines shaped like titles."""
        crumb = _CRUMB_SOURCE.search(self.lines[0])
        name = [w.lower() for w in _WORDS.findall(source or (crumb.group(1) if crumb else ""))]
        full = [n for n in range(1, len(self.lines)) if self.lines[n].strip()]
        edge = {*full[:2], *full[-2:]}
        return [(n, header_mask(self.lines[n], name), bool(_REPORT.search(_SPACES.sub(" ", self.lines[n]).strip())), n in edge) for n in full if n not in self.noise and title_shaped(self.lines[n])]


def skeleton(c: Column, sequences: bool) -> Column:
    """Representative of a word's confusable class."""
    for a, b in SEQUENCES if sequences else ():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, *SINGLES)


def readings(c: Column) -> Column:
    """Keys that a word shares with its misreadings, in whatever order its glyph sequences overlap.

    The plain skeleton and that with all sequences replaced; beside them, compared with plain skeletons, the word with one kind of
    sequence replaced throughout and with each single place of a sequence replaced.
    """
    glyphs = F.create_map(*(F.lit(x) for pair in SEQUENCES for x in pair))
    at = lambda i: F.try_element_at(glyphs, F.substr(c, i, F.lit(2)))
    places = F.filter(F.sequence(F.lit(1), F.length(c) - 1), lambda i: at(i).isNotNull())
    single = F.transform(places, lambda i: F.concat(F.substr(c, F.lit(1), i - 1), at(i), F.substr(c, i + 2)))
    plain = F.concat(F.array(c, *(F.replace(c, F.lit(a), F.lit(b)) for a, b in SEQUENCES)), single)
    return F.array_distinct(F.concat(F.transform(plain, lambda w: F.concat(F.lit("1"), skeleton(w, False))), F.array(F.concat(F.lit("2"), skeleton(c, True)))))


def corpus_counts(pages: DataFrame) -> DataFrame:
    """(kind, term, n): counts of words (kind w) and of pairs of neighbouring plain words, the second in lower case (kind b), over all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        pairs: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words: Counter = Counter()
            for t, n in tokens.items():
                if w := word_of(t):
                    words[w] += n
            near: Counter = Counter()
            for (a, b), n in pairs.items():
                x, y = a.strip(_STRIP), b.strip(_STRIP)
                if x and y and x.isalpha() and y.isalpha() and y.islower():
                    near[f"{x.lower()} {y}"] += n
            tokens.clear()
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(["w"] * len(words) + ["b"] * len(near)), pa.array([*words, *near], pa.string()), pa.array([*words.values(), *near.values()], pa.int64())], ["kind", "term", "n"])

        for batch in batches:
            for content in batch.column(0).to_pylist():
                ts = content.partition("\n")[2].split()
                tokens.update(ts)
                pairs.update(zip(ts, ts[1:]))
                if len(pairs) > FLUSH:
                    yield rows()
        yield rows()

    return pages.select("body").mapInArrow(run, "kind string, term string, n bigint").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def misreadings(words: DataFrame) -> DataFrame:
    """(variant, top, n, top_n): rare forms with the frequent form of the same skeleton; `words` has term, n."""
    keyed = words.select("term", "n", F.explode(readings(F.col("term"))).alias("key"))
    plain = ~F.col("term").rlike(r"[0-9@$|!]")
    best = keyed.where(plain & (F.col("n") >= TOP_COUNT)).groupBy("key").agg(F.max(F.struct("n", "term")).alias("best"))
    joined = keyed.join(best, "key").where((F.col("term") != F.col("best.term")) & (F.col("best.n") >= RATIO * F.col("n")))
    return joined.groupBy(F.col("term").alias("variant")).agg(F.max("best").alias("best"), F.first("n").alias("n")).select("variant", F.col("best.term").alias("top"), "n", F.col("best.n").alias("top_n"))


def _titles(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, mask, form, named, edge) of the title-shaped lines of `pages` (page_id, body, source)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, out = [], []
            for i, (content, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                page = Page(content)
                found = page.titles(source)
                out += [(n + 1, mask, zlib.crc32(page.lines[n].strip().encode("utf-8", "replace")), named, edge) for n, mask, named, edge in found]
                index += [i] * len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int32())), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())))],
                                             ["page_id", "line_no", "mask", "form", "named", "edge"])

    return pages.select("page_id", "body", "source").mapInArrow(run, f"page_id {kind}, line_no bigint, mask string, form bigint, named boolean, edge boolean")


def header_lines(titles: DataFrame) -> DataFrame:
    """(page_id, line_no) of the headers among `titles`; all that is counted is pre-aggregated per mask."""
    places = titles.groupBy("mask", "form").agg(F.count("*").alias("n"), F.sum(F.col("edge").cast("int")).alias("at_edge"), F.max("named").alias("named"))
    masks = materialise(places.groupBy("mask").agg(F.sum("n").alias("n"), F.sum("at_edge").alias("at_edge"), F.count("*").alias("forms"), F.max("named").alias("named")))
    headings = masks.where((F.col("n") >= HEADING_PAGES) & ~F.col("mask").rlike("[9§]") & ~F.col("named")).select(F.col("mask").alias("part"))
    # Every run of words inside a named mask that is a heading by itself becomes ¶; the longest one counts.
    words = F.split("mask", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda k: F.struct(k.alias("size"), F.array_join(F.slice(words, i, k), " ").alias("part"), F.array_join(F.concat(F.slice(words, F.lit(1), i - 1), F.array(F.lit("¶")), F.slice(words, i + k, F.size(words))), " ").alias("pattern")))))
    named = masks.where("named")
    inner = named.select("mask", F.explode(runs).alias("r")).select("mask", "r.*").join(headings, "part").groupBy("mask").agg(F.max(F.struct("size", "pattern")).alias("r"))
    patterns = named.join(inner, "mask", "left").select("mask", "n", F.coalesce(F.col("r.pattern"), F.col("mask")).alias("pattern"))
    recurs = patterns.groupBy("pattern").agg(F.sum("n").alias("pages")).where(F.col("pages") >= HEADER_PAGES)
    named_headers = patterns.join(recurs, "pattern", "left_semi").select("mask", F.lit(True).alias("by_name"))
    varied = masks.where(F.col("mask").contains("9") & (F.col("n") >= UNNAMED_PAGES) & (F.col("at_edge") >= UNNAMED_EDGE * F.col("n")) & (F.col("forms") >= UNNAMED_FORMS * F.col("n"))).select("mask", F.lit(False).alias("by_name"))
    accepted = named_headers.unionByName(varied).groupBy("mask").agg(F.max("by_name").alias("by_name"), F.min("by_name").alias("only_name"))
    return titles.join(accepted, "mask").where(F.col("named") | ~F.col("only_name")).select("page_id", "line_no")


def _filter_places(w: str, size: int) -> tuple[int, int]:
    return zlib.crc32(w.encode("utf-8", "replace")) % size, zlib.crc32(w[::-1].encode("utf-8", "replace")) % size


def word_filter(variants: DataFrame) -> np.ndarray:
    """Bloom filter of the words in `variants` (variant): FILTER_BITS bits, put together by Spark; at most a row for 64 bits comes to the driver."""
    at = F.explode(F.array(*(F.pmod(F.crc32(F.encode(c, "UTF-8")), F.lit(FILTER_BITS)) for c in (F.col("variant"), F.reverse("variant")))))
    rows = variants.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits


def _line_findings(pages: DataFrame, bits: np.ndarray) -> DataFrame:
    """One row for each sighting on a page: kind, line_no, word, and neighbours or parts in `a` and `b`.

    `pages` has page_id, body and headers (the numbers of its header lines). Misreadings are what passes the filter, to be joined exactly.
    """
    known = pages.sparkSession.sparkContext.broadcast(bits)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = known.value.view(np.uint8), 64 * len(known.value)

        def rare(w: str) -> bool:
            return all(held[i >> 3] >> (i & 7) & 1 for i in _filter_places(w, size))

        memo: dict[str, str | None] = {}

        def rare_word(token: str) -> str | None:
            if token not in memo:
                if len(memo) > FLUSH:
                    memo.clear()
                w = word_of(token)
                memo[token] = w if w and rare(w) else None
            return memo[token]

        for batch in batches:
            index, out = [], []
            for i, (content, headers) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                page = Page(content, frozenset(n - 1 for n in headers or ()))
                found: list[tuple[str, int, str, str | None, str | None]] = [("page_no", n, "", None, None) for n in page.page_no]
                heads, tails = {}, set()
                for n, nxt, a, b in page.broken:
                    heads[n], joined = b, (a + b).lower().replace("’", "'")
                    tails.add(nxt)
                    found.append(("hyphen", n, joined, f"{a}-{b}".lower().replace("’", "'"), None))
                    if rare(joined):
                        found.append(("joined", n, joined, a.lower(), str(nxt + 1)))
                for n in range(1, len(page.lines)):
                    line = page.lines[n]
                    if not line or n in page.noise:
                        continue
                    ts = line.split()
                    lo, hi = int(n in tails), len(ts) - int(n in heads)
                    for k in range(lo, hi):
                        if w := rare_word(ts[k]):
                            before = ts[k - 1] if k else page.lines[n - 1].split()[-1:]
                            after = ts[k + 1] if k + 1 < len(ts) else page.lines[n + 1].split()[:1] if n + 1 < len(page.lines) else []
                            before, after = (x if isinstance(x, str) else "".join(x) for x in (before, after))
                            found.append(("misread", n, w, before.strip(_STRIP), after.strip(_STRIP)))
                out += found
                index += [i] * len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int32())), pa.array([f[0] for f in out], pa.string()), pa.array([f[1] + 1 for f in out], pa.int64()),
                                              *(pa.array([f[k] for f in out], pa.string()) for k in (2, 3, 4))], ["page_id", "kind", "line_no", "word", "a", "b"])

    return pages.select("page_id", "body", "headers").mapInArrow(run, f"page_id {kind}, kind string, line_no bigint, word string, a string, b string")


class ScanFindings:
    """Findings over a table of pages: `lines` (id, line_no, kind) and `repairs` (id, line_no, word, top)."""

    def __init__(self, df: DataFrame, id_col: str = "id", text_col: str = "content", source_col: str = "company"):
        source = F.col(source_col).cast("string") if source_col in df.columns else F.lit(None).cast("string")
        src = spread(df.select(F.col(id_col).alias("page_id"), F.col(text_col).alias("body"), source.alias("source")))
        pages = pages_once(src, "page_id", "body", "source").where(F.col("body").isNotNull())
        counts = materialise(corpus_counts(pages))
        words, pairs = counts.where("kind = 'w'").select("term", "n"), counts.where("kind = 'b'").select("term", "n")
        swaps = materialise(misreadings(words))
        headers = materialise(header_lines(materialise(_titles(pages))))
        marked = headers.groupBy("page_id").agg(F.collect_set("line_no").alias("headers"))
        found = materialise(_line_findings(pages.join(small_or_shuffled(marked, 64), "page_id", "left"), word_filter(swaps)))
        plain = found.where("kind = 'page_no'").select("page_id", "line_no", "kind").unionByName(headers.select("page_id", "line_no", F.lit("header").alias("kind")))
        self.lines_misread, self.joined = self._misread(found, swaps, pairs)
        cut = self.joined.select("page_id", F.col("misread_no").alias("line_no"), "word", "top")
        hyphen = self._hyphens(found, words, swaps)
        self.lines = plain.unionByName(hyphen.select("page_id", "line_no", "kind")).unionByName(self.lines_misread.unionByName(cut).select("page_id", "line_no", F.lit("misread").alias("kind"))).distinct().withColumnRenamed("page_id", id_col)

    @staticmethod
    def _misread(found: DataFrame, swaps: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sightings of misreadings that their neighbours, a symbol inside, or sheer frequency support (page_id, line_no, word, top), and of
        those broken at a line's end (page_id, line_no, next_no, misread_no, word, top)."""
        near = pairs.where(F.col("n") >= SUPPORT).select(F.col("term").alias("pair"))
        seen = found.where("kind = 'misread'").join(swaps, F.col("word") == F.col("variant"))
        left = seen.withColumn("pair", F.concat_ws(" ", F.lower("a"), "top")).join(near.withColumn("left_ok", F.lit(True)), "pair", "left").drop("pair")
        both = left.withColumn("pair", F.concat_ws(" ", "top", F.lower("b"))).join(near.withColumn("right_ok", F.lit(True)), "pair", "left").drop("pair")
        askable = F.col("a").rlike(r"^\p{Ll}+$") | F.col("b").rlike(r"^\p{Ll}+$")
        sure = F.col("word").rlike(r"[0-9@$|!]") | F.coalesce(F.col("left_ok"), F.lit(False)) | F.coalesce(F.col("right_ok"), F.lit(False)) | (~askable & (F.col("top_n") >= LONE_RATIO * F.col("n")))
        # A word broken at a line's end is misread on the line whose part differs from the frequent form.
        after = F.col("b").cast("bigint")
        cut = found.where("kind = 'joined'").join(swaps, F.col("word") == F.col("variant")).select(
            "page_id", "line_no", after.alias("next_no"), F.when(F.startswith(F.col("top"), F.col("a")), after).otherwise(F.col("line_no")).alias("misread_no"), "word", "top")
        return both.where(sure).select("page_id", "line_no", "word", "top"), cut

    @staticmethod
    def _hyphens(found: DataFrame, words: DataFrame, swaps: DataFrame) -> DataFrame:
        """Broken words that are written without the hyphen elsewhere, or at least not with it."""
        forms = found.where("kind = 'hyphen'").select("word", "a").distinct()
        true_word = F.coalesce(F.col("top"), F.col("word"))
        forms = forms.join(swaps.select(F.col("variant").alias("word"), "top"), "word", "left").withColumn("spelled", true_word)
        forms = forms.join(words.select(F.col("term").alias("spelled"), F.col("n").alias("n_joined")), "spelled", "left").join(words.select(F.col("term").alias("a"), F.col("n").alias("n_hyphen")), "a", "left")
        parts = F.split("a", "-")
        forms = forms.withColumns({"p1": F.element_at(parts, -2), "p2": F.element_at(parts, -1)})
        for p in ("p1", "p2"):
            forms = forms.join(words.select(F.col("term").alias(p), F.col("n").alias(f"n_{p}")), p, "left")
        n = lambda c: F.coalesce(F.col(c), F.lit(0))
        broken = (n("n_joined") > n("n_hyphen")) | ((n("n_joined") == 0) & (n("n_hyphen") == 0) & ~((n("n_p1") >= TOP_COUNT) & (n("n_p2") >= TOP_COUNT)))
        return found.where("kind = 'hyphen'").join(forms.where(broken).select("word", "a"), ["word", "a"]).select("page_id", "line_no", "kind")


def find_scan_noise(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, line_no, kind) of each line with scan noise; kinds hyphen, misread, header, page_no.

    Rows sent again count once; null ids and null texts give no row; empty pages have no findings; long pages are read whole; line 1
    is never a case; other columns are not read; an empty table gives an empty result.
    """
    return ScanFindings(df, id_col, text_col).lines


def _like(word: str, top: str) -> str:
    """`top` in the case of `word`."""
    return top.upper() if word.isupper() and len(word) > 1 else top[0].upper() + top[1:] if word[0].isupper() else top


def repair_lines(lines: list[str], gone: set[int], broken: set[int], swaps: dict[int, dict[str, str]], joined: dict[int, tuple[int, str]]) -> list[tuple[int, str, bool]]:
    """(line_no, line, whether its last word goes on) of the lines that stay, repaired; the numbers in the arguments count from 1.

    `swaps` maps a line to its misread words, `joined` a broken line to (the line that goes on, the whole word).
    """
    starts = {after: top for after, top in joined.values()}
    out = []
    for n, line in enumerate(lines, 1):
        if n in gone:
            continue
        if n in starts and (first := line.split()[:1]):
            rest = first[0].strip(_STRIP)
            line = line.replace(rest, "", 1) if rest else line
        if n in swaps:
            line = _TOKEN.sub(lambda m: _swapped(m.group(), swaps[n]), line)  # noqa: B023
        cut = n in broken
        if cut:
            line = re.sub(rf"[{_MARKS}]$", "", line.rstrip())
            if n in joined and (last := line.split()[-1:]):
                part = last[0].lstrip(_STRIP)
                line = line[: len(line) - len(part)] + _like(part, joined[n][1]) if part else line
        out.append((n, line, cut))
    return out


_TOKEN = re.compile(r"\S+")


def _swapped(token: str, words: dict[str, str]) -> str:
    top = words.get(word_of(token) or "")
    bare = token.strip(_STRIP)
    return token.replace(bare, _like(bare, top), 1) if top and bare else token


def reflow(df: DataFrame, id_col: str = "id", text_col: str = "content", source_col: str = "company") -> DataFrame:
    """(id, para_no, paragraph): pages repaired into continuous paragraphs.

    Headers and page numbers are dropped, misread words replaced by their frequent forms in the case they stand in, broken words joined
    (and repaired where they are misread too), and the lines of a paragraph strung together. Windows run within one page.
    """
    found = ScanFindings(df, id_col, text_col, source_col)
    of_page = lambda kinds: F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("line_no")))
    marks = found.lines.groupBy(F.col(id_col).alias("page_id")).agg(of_page(("header", "page_no")).alias("gone"), of_page(("hyphen",)).alias("cut"))
    swaps = found.lines_misread.groupBy("page_id").agg(F.collect_set(F.struct("line_no", "word", "top")).alias("swaps"))
    joined = found.joined.groupBy("page_id").agg(F.collect_set(F.struct("line_no", "next_no", "top")).alias("joined"))
    # One join brings a page's findings to its text; all that follows is hashed by page already.
    pages = pages_once(df.select(F.col(id_col).alias("page_id"), F.col(text_col).alias("body")), "page_id", "body").where(F.col("body").isNotNull())
    pages = pages.join(marks.join(swaps, "page_id", "left").join(joined, "page_id", "left"), "page_id", "left").select("page_id", "body", "gone", "cut", "swaps", "joined")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                index, out = [], []
                for i, (body, gone, cut, words, parts) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                    by_line: dict[int, dict[str, str]] = {}
                    for w in words or ():
                        by_line.setdefault(w["line_no"], {})[w["word"]] = w["top"]
                    rows = repair_lines(body.split("\n"), set(gone or ()), set(cut or ()), by_line, {j["line_no"]: (j["next_no"], j["top"]) for j in parts or () if j["line_no"] in (cut or ())})
                    out += rows
                    index += [i] * len(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int32())), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.bool_())))], ["page_id", "line_no", "line", "broken"])

    lines = pages.mapInArrow(run, f"page_id {kind}, line_no bigint, line string, broken boolean")
    page = Window.partitionBy("page_id").orderBy("line_no")
    before = F.lag("line").over(page)
    table_row = F.col("line").rlike(r"\S\s{2,}\S")
    lines = lines.withColumn("starts", (F.trim("line") == "") | before.isNull() | (F.trim(before) == "") | table_row | before.rlike(r"\S\s{2,}\S") | (F.lag("line_no").over(page) == 1))
    lines = lines.withColumn("para", F.sum(F.col("starts").cast("int")).over(page)).where(F.trim("line") != "")
    text = F.array_sort(F.collect_list(F.struct("line_no", "line", "broken")))
    strung = F.transform(text, lambda s: F.when(s["broken"], F.trim(s["line"])).otherwise(F.concat(F.trim(s["line"]), F.lit(" "))))
    return lines.groupBy("page_id", "para").agg(F.trim(F.array_join(strung, "")).alias("paragraph")).select(F.col("page_id").alias(id_col), F.col("para").cast("bigint").alias("para_no"), "paragraph")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line_no, kind) of each line with scan noise."""
    return find_scan_noise(table(spark, sf_dir, "financebench_docs"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, para_no, paragraph) of the repaired pages."""
    return reflow(table(spark, sf_dir, "financebench_docs"))
