"""Evaluation passages inside training documents: q-gram lemma filtering and banded alignment.

A document leaks an item if it holds WINDOW consecutive words of one of the item's passages with at most EDITS words
replaced, dropped or added. Document words that no passage of the block has can only be edits: each becomes one MARK, so
that (1) stretches between more than EDITS marks in a row with fewer than WINDOW - EDITS other words can't take part; of a
true window some run of INTACT words stays as it is, so (2) neither can positions outside runs of shared character q-grams of
that length; (3) the shared q-grams of a true region lie on diagonals that differ by at most EDITS words, none longer than the
passages' longest, so they are counted in overlapping diagonal bands of that width, and a band with fewer than the lemma's
bound is dropped; (4) the regions left are verified by a word alignment in a band round the diagonal. No step loses a true
region, however long the words that the document puts in.

The passages are the stated query set: they are taken in blocks of at most BLOCK_CHARS characters, each broadcast and
matched with all documents; within a block the documents stream through one narrow stage without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

WINDOW, EDITS, Q = 15, 2, 8
#: Words in a row that EDITS edits leave intact in a window; with the blanks they have more than Q characters.
INTACT = -(-(WINDOW - EDITS) // (EDITS + 1))
#: Characters of passages in one broadcast block.
BLOCK_CHARS = 4_000_000
#: Stands for each document word that the block's passages don't have.
MARK = "\x01"
_GAP = re.compile(rf"(?:(?:^|(?<= )){MARK}(?: |$)){{{EDITS + 1},}}")
#: Characters of documents matched at once, and pairs of document and passage counted in one array (memory bounds only).
SLICE_CHARS, CELLS = 400_000, 30_000_000
_DROP = re.compile(r"[^\w\s]|_")
_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    """Words of letters and digits, case folded, one blank apart."""
    return " ".join(_DROP.sub("", text.casefold()).split()) if text else ""


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q characters that start at each position."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h *= _BASE
        h += codes[k : n + k]
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)


class PassageIndex:
    """Q-gram postings of one block of passages, with the lemma's bounds."""

    def __init__(self, passages: list[tuple[str, str]]):
        """`passages`: (item id, normalised text of at least WINDOW words)."""
        self.items = [i for i, _ in passages]
        self.words = [t.split(" ") for _, t in passages]
        lengths = np.array([len(t) for _, t in passages])
        joined = "\x00".join(t for _, t in passages) + "\x00" * Q
        h = _hashes(_codes(joined))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        owner = np.repeat(np.arange(len(passages)), lengths + 1)
        pos = np.arange(len(owner)) - starts[owner]
        inside = pos <= lengths[owner] - Q
        h, owner, pos = h[: len(owner)][inside], owner[inside], pos[inside]
        order = np.argsort(h, kind="stable")
        self.owner, self.pos = owner[order].astype(np.int32), pos[order].astype(np.int32)
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.grams >> np.uint64(64 - _BITS)] = True
        runs, bounds = [], []
        for words in self.words:
            n = np.array([len(w) for w in words])
            c = np.concatenate([[0], np.cumsum(n + 1)])
            runs.append(int((c[INTACT:] - c[:-INTACT] - 1).min()))
            best = []
            for a in range(len(words) - WINDOW + 1):
                w = n[a : a + WINDOW]
                top = np.sort(w)[-EDITS:].sum()
                best.append(int(w.sum() + WINDOW - 1 - Q + 1 - top - EDITS * (Q + 1)))
            bounds.append(min(best))
        self.vocabulary = {w for words in self.words for w in words}
        #: Shared q-grams in a row that an intact run gives at least: INTACT words have 2 INTACT - 1 > Q characters or more.
        self.run = min(runs) - Q + 1
        self.bound = np.maximum(np.array(bounds), np.array(runs) - Q + 1)
        self.band = 2 * EDITS * (max(map(len, self.vocabulary)) + 2)
        self.longest = int(lengths.max())

    def masked(self, text: str) -> str:
        """A normalised document with MARK for words outside the vocabulary, less the stretches that can't hold a window."""
        known = self.vocabulary
        marked = " ".join([w if w in known else MARK for w in text.split(" ")])
        gap = f" {MARK}" * (EDITS + 1) + " "
        return gap.join([s.strip(" ") for s in _GAP.split(marked) if s.count(" ") - s.count(MARK) >= WINDOW - EDITS - 1])

    def candidates(self, docs: list[str]) -> set[tuple[int, int, int, int]]:
        """(document, passage, lowest and highest document position) of the bands of masked `docs` that meet the bound."""
        if not any(docs):
            return set()
        h = _hashes(_codes("\x00".join(docs) + "\x00" * Q))
        hit = self.bits[h >> np.uint64(64 - _BITS)]
        at = np.flatnonzero(hit)
        slot = np.searchsorted(self.grams, h[at])
        slot[slot == len(self.grams)] = 0
        true = self.grams[slot] == h[at]
        at, slot = at[true], slot[true]
        if not len(at):
            return set()
        cuts = np.flatnonzero(np.diff(at) != 1) + 1
        lens = np.diff(np.concatenate([[0], cuts, [len(at)]]))
        keep = np.repeat(lens >= self.run, lens)
        at, slot = at[keep], slot[keep]
        lengths = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        # Nor can a document's bands hold more shared q-grams than it has positions left.
        home = np.searchsorted(starts, at, side="right") - 1
        keep = np.bincount(home, minlength=len(docs))[home] >= self.bound.min()
        at, slot = at[keep], slot[keep]
        if not len(at):
            return set()
        n = self.count[slot]
        where = np.repeat(at, n)
        index = np.repeat(self.first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        passage = self.owner[index].astype(np.int64)
        doc = np.searchsorted(starts, where, side="right") - 1
        # A band can't hold more shared q-grams than the whole pair: pairs below the bound go before anything is sorted.
        cell = doc * len(self.items) + passage
        if len(docs) * len(self.items) <= CELLS:
            enough = np.bincount(cell, minlength=len(docs) * len(self.items))[cell] >= self.bound[passage]
        else:
            _, inverse, n_cell = np.unique(cell, return_inverse=True, return_counts=True)
            enough = n_cell[inverse] >= self.bound[passage]
        where, index, passage, doc = where[enough], index[enough], passage[enough], doc[enough]
        local = where - starts[doc]
        diagonal = local - self.pos[index] + self.longest
        stride = (int(lengths.max()) + self.longest) // self.band + 2
        found: set[tuple[int, int, int, int]] = set()
        for shift in (0, self.band // 2):
            key = (doc * len(self.items) + passage) * stride + (diagonal + shift) // self.band
            order = np.argsort(key, kind="stable")
            k, start, count = np.unique(key[order], return_index=True, return_counts=True)
            owner = (k // stride) % len(self.items)
            for i in np.flatnonzero(count >= self.bound[owner]):
                where_i = local[order[start[i] : start[i] + count[i]]]
                found.add((int(k[i] // stride // len(self.items)), int(owner[i]), int(where_i.min()), int(where_i.max())))
        return found


def word_runs(passage: list[str]) -> dict[tuple[str, ...], list[int]]:
    """Places of each run of INTACT words."""
    places: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(passage) - INTACT + 1):
        places.setdefault(tuple(passage[i : i + INTACT]), []).append(i)
    return places


def verify(passage: list[str], places: dict[tuple[str, ...], list[int]], doc_text: str, low: int, high: int, words: list[str]) -> bool:
    """Banded alignment of one candidate region, widened by a window on either side."""
    a, b = doc_text.count(" ", 0, low), doc_text.count(" ", 0, high)
    margin = WINDOW + EDITS
    return banded(passage, places, words[max(0, a - margin) : b + margin + 1])


def banded(passage: list[str], places: dict[tuple[str, ...], list[int]], region: list[str]) -> bool:
    """Alignment restricted to the diagonals (with EDITS on either side) on which INTACT words in a row agree."""
    tried = set()
    for j in range(len(region) - INTACT + 1):
        for i in places.get(tuple(region[j : j + INTACT]), ()):
            d = j - i
            if (d, i // WINDOW) in tried:
                continue
            tried.add((d, i // WINDOW))
            if _band(passage, region, i, j):
                return True
    return False


def _band(passage: list[str], region: list[str], i0: int, j0: int) -> bool:
    """Alignment in the band of 2 EDITS + 1 diagonals round (i0, j0), over the passage words within a window of i0."""
    m, n, d0, width = len(passage), len(region), j0 - i0, 2 * EDITS + 1
    first, last = max(0, i0 - WINDOW), min(m, i0 + 2 * WINDOW)
    start = [e for e in range(EDITS + 1)]
    # rows: passage words; best[e][k]: words covered, ending at passage word i and document word i + d0 + k - EDITS
    prev = [[start[e]] * width for e in range(EDITS + 1)]
    for i in range(first, last):
        cur = [[0] * width for _ in range(EDITS + 1)]
        for e in range(EDITS + 1):
            for k in range(width):
                j = i + d0 + k - EDITS
                value = e if i - first + 1 >= e else 0  # a start here: the last e passage words edited away
                if 0 <= j < n and passage[i] == region[j]:
                    value = max(value, prev[e][k] + 1)
                if e:
                    if 0 <= j < n:
                        value = max(value, prev[e - 1][k] + 1)
                        if k:
                            value = max(value, cur[e - 1][k - 1])
                    if k + 1 < width:
                        value = max(value, prev[e - 1][k + 1] + 1)
                if value >= WINDOW:
                    return True
                cur[e][k] = value
        prev = cur
    return False


def passages_of(items: DataFrame, id_col: str, text_cols: list[str], array_text_cols: list[str]) -> DataFrame:
    """(item, passage) rows: each text column, and each element of each array-of-text column, null and blank left out."""
    parts = [items.select(F.col(id_col).alias("item"), F.col(c).alias("passage")) for c in text_cols]
    parts += [items.select(F.col(id_col).alias("item"), F.explode(c).alias("passage")) for c in array_text_cols]
    return reduce(DataFrame.unionByName, parts).where(F.trim("passage") != "")


def blocks(rows: Iterable, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str]]]:
    """Normalised passages of at least WINDOW words, in blocks of at most `limit` characters."""
    block, size = [], 0
    for item, passage in rows:
        text = normalise(passage)
        if text.count(" ") + 1 < WINDOW:
            continue
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Normalised texts in runs of at most `limit` characters (one text at least), with the place of the first."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        text = normalise(t)
        if run and size + len(text) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def find_leaks(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item) of every document that holds a passage of the item, each pair once; no true pair is lost.

    `passages` has columns item STRING and passage STRING. Null and empty texts give no row; null ids are kept; repeated rows
    count once; long texts are searched whole; other columns are not read; empty tables on either side give an empty result.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    src = spread(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("leak_key"), F.col(text_col).alias("leak_text")))
    found = []
    for block in blocks(passages.toLocalIterator(), block_chars):
        index = sc.broadcast(PassageIndex(block))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix, runs = index.value, {}
            for batch in batches:
                out: list[tuple[int, str]] = []
                for first, normal in slices(batch.column(1).to_pylist()):
                    split: dict[int, list[str]] = {}
                    pairs = set()
                    texts = [ix.masked(t) for t in normal]
                    for d, p, lo, hi in sorted(ix.candidates(texts)):
                        if p not in runs:
                            runs[p] = word_runs(ix.words[p])
                        if (d, ix.items[p]) not in pairs and verify(ix.words[p], runs[p], texts[d], lo, hi, split.setdefault(d, texts[d].split(" "))):
                            pairs.add((d, ix.items[p]))
                            out.append((first + d, ix.items[p]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d for d, _ in out], pa.int32())), pa.array([i for _, i in out], pa.string())], ["leak_key", "item"])

        found.append(src.mapInArrow(run, f"leak_key {kind}, item string"))
    if not found:
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, item string")
    return reduce(DataFrame.unionByName, found).distinct().withColumnRenamed("leak_key", id_col)


def qa_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question, justification and evidence texts of the held-out items."""
    qa = table(spark, sf_dir, "qa").withColumn("evidence_texts", F.transform("evidence", lambda e: e["evidence_text"]))
    return passages_of(qa, "financebench_id", ["question", "justification"], ["evidence_texts"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, financebench_id): documents that hold passages of the held-out items."""
    return find_leaks(table(spark, sf_dir, "documents"), qa_passages(spark, sf_dir)).withColumnRenamed("item", "financebench_id")


def p7_leaks_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each leaked item is found in."""
    return p7_found(spark, sf_dir).groupBy("financebench_id").agg(F.count("*").alias("n_docs"))
