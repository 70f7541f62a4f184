"""Lines repeated across one source's pages, by content-defined chunks.

A page is read as the stream of its letters and digits, case folded. A rolling hash over the last WINDOW characters cuts the
stream wherever its low bits are zero; the hash starts anew with each line, since the result names lines, so a line has
the same chunks wherever it stands and however it is spaced or marked. Distinct pages are counted per chunk and source.
A line all of whose chunks are repeated is a candidate (every repeated line is one), and the exact count of the
candidates' texts decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, small_or_shuffled, spread, table
from .pages import pages_once

#: Rolling window, and log2 of the mean distance of cuts, in letters and digits.
WINDOW, CUT_BITS = 6, 5
#: A line is repeated from this many pages, and this share of its source's pages, on.
MIN_PAGES, MIN_SHARE = 3, 0.05
#: Repeated chunks that are broadcast at most; beyond it they are joined.
MAX_BROADCAST_CHUNKS = 2_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _fold_table(top: int) -> np.ndarray:
    """Folded code of each letter and digit up to `top`, 0 for all else."""
    have = _tables.get("fold")
    if have is None or len(have) <= top:
        size = 0x10000 if top < 0x10000 else 0x110000
        out = np.zeros(size, np.uint32)
        for i in range(size):
            ch = chr(i)
            if ch.isalnum():
                low = ch.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _tables["fold"] = have = out
    return have


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(str(base))
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 20), base, np.uint64)]), dtype=np.uint64)
        _tables[str(base)] = have
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class LineChunks:
    """Chunks of the lines of some pages: for each chunk its page, line number (from 1) and hash; for each line its folded text."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("\x00".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
        fold = _fold_table(int(codes.max(initial=0)))[codes]
        page_break = codes == 0
        page = np.cumsum(page_break)
        line = np.cumsum(page_break | (codes == 10))
        first_line = np.concatenate([[0], line[np.flatnonzero(page_break)]]) if len(codes) else np.zeros(1, int)
        at = np.flatnonzero(fold)
        self.c, self.line = fold[at].astype(np.uint64), line[at]
        n = len(at)
        if not n:
            self.start = self.end = self.hash = self.chunk_line = self.chunk_page = self.chunk_no = np.zeros(0, np.int64)
            return
        new_line = np.concatenate([[True], self.line[1:] != self.line[:-1]])
        h = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            h *= np.uint64(_BASE)
            h[WINDOW - 1 :] += self.c[k : n - WINDOW + 1 + k] if n >= WINDOW else 0
        whole = np.zeros(n, bool)
        if n >= WINDOW:
            whole[WINDOW - 1 :] = self.line[WINDOW - 1 :] == self.line[: n - WINDOW + 1]
        cut = whole & ((_mix(h) >> np.uint64(64 - CUT_BITS)) == 0)
        begins = new_line.copy()
        begins[1:] |= cut[:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.concatenate([self.start[1:], [n]])
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.c * _powers(_BASE, n), dtype=np.uint64)])
        body = (total[self.end] - total[self.start]) * _powers(_INVERSE, n)[self.start]
        self.hash = _mix(body + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.chunk_line = self.line[self.start]
        self.chunk_page = page[at[self.start]]
        self.chunk_no = self.chunk_line - first_line[self.chunk_page] + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first chunk of each line with content, and the index behind its last."""
        first = np.flatnonzero(np.concatenate([[True], self.chunk_line[1:] != self.chunk_line[:-1]])) if len(self.start) else np.zeros(0, int)
        return first, np.concatenate([first[1:], [len(self.start)]]).astype(int)

    def text(self, a: int, b: int) -> str:
        """Folded characters of chunks a to b."""
        return self.c[self.start[a] : self.end[b - 1]].astype(np.uint32).tobytes().decode("utf-32-le", "replace")


def _keyed(chunks: LineChunks, source: np.ndarray) -> np.ndarray:
    """Chunk hash combined with the hash of the page's source."""
    return _mix(chunks.hash ^ source[chunks.chunk_page]).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def repeated_chunks(pages: DataFrame) -> DataFrame:
    """(key) of the chunks that stand on enough distinct pages of a source; `pages` has page_id, source, source_key, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ch = LineChunks(batch.column(1).to_pylist())
            source = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            countable = ch.chunk_no > 1
            both = np.unique(np.stack([ch.chunk_page[countable], _keyed(ch, source)[countable]], 1), axis=0) if countable.any() else np.zeros((0, 2), np.int64)
            key, n = np.unique(both[:, 1], return_counts=True)
            at = dict(zip(both[:, 1], both[:, 0]))
            owner = batch.column(0).to_numpy(zero_copy_only=False)[[at[k] for k in key]] if len(key) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(owner, pa.int64()), pa.array(n, pa.int64())], ["key", "source_key", "n"])

    counts = pages.select("source_key", "body").mapInArrow(run, "key bigint, source_key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"), F.first("source_key").alias("source_key"))
    totals = materialise(pages.groupBy("source_key").agg(F.count("*").alias("pages")))
    return counts.where(F.col("n") >= MIN_PAGES).join(small_or_shuffled(totals, 24), "source_key").where(F.col("n") >= MIN_SHARE * F.col("pages")).select("key")


def _candidates(pages: DataFrame, frequent: DataFrame) -> DataFrame:
    """(page_id, source, line_no, folded) of the lines all of whose chunks are in `frequent`."""
    kind = pages.schema["page_id"].dataType.simpleString()
    if frequent.count() <= MAX_BROADCAST_CHUNKS:
        known = pages.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in frequent.collect()], np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = known.value
            for batch in _slices(batches):
                ch = LineChunks(batch.column(3).to_pylist())
                source = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                key = _keyed(ch, source)
                slot = np.searchsorted(keys, key)
                slot[slot == len(keys)] = 0
                is_known = keys[slot] == key if len(keys) else np.zeros(len(key), bool)
                first, behind = ch.lines()
                full = np.add.reduceat(is_known.astype(int), first) == behind - first if len(first) else np.zeros(0, bool)
                picked = [i for i in np.flatnonzero(full) if ch.chunk_no[first[i]] > 1]
                rows = pa.array([int(ch.chunk_page[first[i]]) for i in picked], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([int(ch.chunk_no[first[i]]) for i in picked], pa.int64()),
                                                  pa.array([ch.text(first[i], behind[i]) for i in picked], pa.string())], ["page_id", "source", "line_no", "folded"])

        return pages.select("page_id", "source", "source_key", "body").mapInArrow(run, f"page_id {kind}, source string, line_no bigint, folded string")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ch = LineChunks(batch.column(2).to_pylist())
            key = _keyed(ch, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            first, behind = ch.lines()
            size = behind - first
            of_line = np.repeat(np.arange(len(first)), size)
            wanted = np.flatnonzero(ch.chunk_no[first[of_line]] > 1) if len(first) else np.zeros(0, int)
            at = first[of_line[wanted]] if len(wanted) else wanted
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ch.chunk_page[at].astype(np.int32))), pa.array(ch.chunk_no[at].astype(np.int64)), pa.array(key[wanted]), pa.array(size[of_line[wanted]].astype(np.int64))], ["page_id", "line_no", "key", "size"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ch, wanted = LineChunks(batch.column(2).to_pylist()), [set(x) for x in batch.column(3).to_pylist()]
            first, behind = ch.lines()
            picked = [i for i in range(len(first)) if int(ch.chunk_no[first[i]]) in wanted[int(ch.chunk_page[first[i]])]]
            rows = pa.array([int(ch.chunk_page[first[i]]) for i in picked], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([int(ch.chunk_no[first[i]]) for i in picked], pa.int64()), pa.array([ch.text(first[i], behind[i]) for i in picked], pa.string())], ["page_id", "source", "line_no", "folded"])

    each = pages.select("page_id", "source_key", "body").mapInArrow(explode, f"page_id {kind}, line_no bigint, key bigint, size bigint")
    places = each.join(frequent, "key", "left_semi").groupBy("page_id", "line_no", "size").count().where("count = size").groupBy("page_id").agg(F.collect_list("line_no").alias("places"))
    return pages.join(places, "page_id").select("page_id", "source", "body", "places").mapInArrow(texts, f"page_id {kind}, source string, line_no bigint, folded string")


def find_repeated_lines(df: DataFrame, id_col: str = "id", text_col: str = "content", source_col: str = "company") -> DataFrame:
    """(id, line_no) of each place of a line that its source repeats excessively.

    Rows sent again count once; rows with a null id or source neither count nor come out; null texts count as empty pages; line
    1 and lines without letters or digits don't count; long pages are read whole; other columns are not read; an empty table
    gives an empty result. Nothing is grouped by page or source alone, so a source that holds most pages is no hot key.
    """
    src = spread(df.select(F.col(id_col).alias("page_id"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("body")))
    pages = pages_once(src, "page_id", "source", "body").where(F.col("source").isNotNull()).select("page_id", "source", F.xxhash64("source").alias("source_key"), F.translate("body", "\x00", " ").alias("body"))
    frequent = materialise(repeated_chunks(pages))
    lines = materialise(_candidates(pages, frequent))
    totals = pages.groupBy("source").agg(F.count("*").alias("pages"))
    often = lines.select("source", "folded", "page_id").distinct().groupBy("source", "folded").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    often = materialise(often.join(totals, "source").where(F.col("n") >= MIN_SHARE * F.col("pages")).select("source", "folded"))
    return lines.join(small_or_shuffled(often, 300), ["source", "folded"], "left_semi").select(F.col("page_id").alias(id_col), "line_no")


def remove_lines(df: DataFrame, lines: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, content) of each distinct page without the lines named in `lines` (id, line_no)."""
    drop = lines.groupBy(id_col).agg(F.collect_set("line_no").alias("_drop"))
    pages = pages_once(df, id_col, text_col).join(drop, id_col, "left").select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), "_drop")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            drops = [set(d or ()) for d in batch.column(2).to_pylist()]
            kept = [t if t is None or not d else "\n".join([x for n, x in enumerate(t.split("\n"), 1) if n not in d]) for t, d in zip(batch.column(1).to_pylist(), drops)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["_id", "_text"])

    return pages.mapInArrow(run, f"_id {kind}, _text string").withColumnsRenamed({"_id": id_col, "_text": text_col})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line_no) of each place of a line that a company's pages repeat."""
    return find_repeated_lines(table(spark, sf_dir, "financebench_docs"))


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content) of each page without its company's repeated lines."""
    docs = table(spark, sf_dir, "financebench_docs")
    return remove_lines(docs, find_repeated_lines(docs))
