"""Repeated passages by content-defined chunking with a gear rolling hash.

A gear hash over the last ``GEAR_BYTES`` bytes is rolled along a document; a
chunk ends where it falls below a threshold. Cuts depend on nearby bytes alone
(no smallest or largest chunk), so a passage is cut alike wherever it stands and
an insertion shifts nothing beyond its own chunk.

Compared are windows: the shortest sequences of neighbouring chunks, from each
chunk on and up to each chunk, that hold ``min_words`` words. A window found in
two or more documents is repeated, so at least ``min_words`` words stand in the
same order in one other document; phrases from several documents never add up
to a passage. Its first copy is the one in the smallest document id. Repeated
windows that overlap are one repeated passage, apart for those whose first copy
is in this document and those that an earlier document has: what a document adds
to a copied passage is first there, and is kept there when that is copied on.
Windows are compared by 64-bit digests, which are not held against the texts
(two billion windows have one equal pair by chance in about ten corpora).

Shuffled is each window once: its digest, document and number, packed by ``BINS`` ranges
of digests, so that a row holds some thousands and a window costs about a dozen bytes. A
bin is gone through in slices of about ``SLICE`` windows (those of one digest together)
and gives back the repeated windows alone. Their places are found again from the texts,
which are joined to them by document. Passages are found per document among repeated
windows only.

Defined results: null and empty texts have no chunks; repeated rows of one id
are one document and do not repeat each other; repeats inside one document do
not count; rows without an id are left out; an empty table gives an empty
result; a very long text is chunked in one pass of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bound_batches, pack_array, stage, unpack_array

#: Bytes that a cut depends on, and mean bytes of a chunk.
GEAR_BYTES, MEAN_BYTES = 16, 24
#: Words that a window must hold. The chunks at a passage's ends are lost, so this
#: is far below the passages looked for (50 words).
MIN_WORDS = 16
#: Shorter chunks recur by chance; at a window's ends they don't count as part of the passage.
SURE_CHARS = 12
#: Ranges of digests, windows that a task packs at once, and windows of a bin that are sorted at once.
BINS, BLOCK, SLICE = 512, 1_000_000, 2_000_000
#: Places are pairs of offsets in one long: begin << 32 | end, of code points, words and chunks.
PLACE_SCHEMA = "doc_id long, chars long, words long, chunks long, first_doc_id long"
PACKED_SCHEMA = "bin int, digests binary, docs binary, numbers binary"
REPEATED_SCHEMA = "doc_id long, number long, digest long, first_doc_id long"
PASSAGE_SCHEMA = "doc_id long, start long, stop long, n_words long, n_chunks long, first_doc_id long, is_first boolean"


def gear_table(seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 16, 256, dtype="u4").astype("u2")


def cut_points(data: np.ndarray, gear: np.ndarray, mean: int = MEAN_BYTES) -> np.ndarray:
    """Ends of the chunks of the bytes ``data``, the last one included.

    The hash at a byte is the sum of gear[b] << k over the byte itself (k = 0)
    and those k before it, modulo 2^16, so it forgets after 16 bytes; it is
    built by doubling the number of bytes covered.
    """
    if not len(data):
        return np.zeros(0, "i8")
    h = gear[data]
    for span in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint16(span)
        h = h + older
    # a Fibonacci mix, so that the few bits which old bytes reach decide as much as the others
    mixed = (h.astype("u4") * np.uint32(0x9E3779B1)) >> np.uint32(12)
    cut = mixed < np.uint32((1 << 20) // mean)
    cut[: GEAR_BYTES - 1] = False  # a full window first
    lead = np.ones(len(data), bool)
    lead[:-1] = (data[1:] & 0xC0) != 0x80  # never inside a character
    # a cut inside a character moves to the character's end
    ends = np.flatnonzero(lead)
    at = np.unique(np.searchsorted(ends, np.flatnonzero(cut)))
    out = ends[at] + 1
    return out if len(out) and out[-1] == len(data) else np.append(out, len(data))


def windows_of(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First chunk and end (exclusive) of the shortest windows of ``least`` words from and up to each chunk.

    ``words`` are the words before each chunk, and all words at the end.
    """
    n = len(words)
    every = np.arange(n)
    to = np.searchsorted(words, words + least)
    since = np.searchsorted(words, words - least, "right") - 1
    keys = np.unique(np.concatenate([(every * n + to)[to < n], (since * n + every)[since >= 0]]))
    return keys // n, keys % n


class Windows:
    """The windows of a text (UTF-8, not empty), numbered from 0."""

    gear = gear_table()
    space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def __init__(self, raw: bytes, min_words: int) -> None:
        self.raw, data = raw, np.frombuffer(raw, "u1")
        self.at = np.concatenate([[0], cut_points(data, self.gear)])
        blank = self.space[data]
        begins = ~blank
        begins[1:] &= blank[:-1]
        self.words = self._upto(begins)
        self.first, self.end = windows_of(self.words, min_words)

    def _upto(self, mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask)[self.at[1:] - 1]])

    def __len__(self) -> int:
        return len(self.first)

    def digests(self, numbers: np.ndarray | slice = slice(None)) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        begin, end = self.at[self.first[numbers]].tolist(), self.at[self.end[numbers]].tolist()
        return np.fromiter((xxh3_64_intdigest(self.raw[i:j]) for i, j in zip(begin, end, strict=True)), "u8", len(begin))

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points (of the sure chunks), words and chunks of windows."""
        chars = self._upto((np.frombuffer(self.raw, "u1") & 0xC0) != 0x80)
        a, b = self.first[numbers], self.end[numbers]
        sure = np.flatnonzero(np.diff(chars) >= SURE_CHARS)
        first, last = np.searchsorted(sure, a), np.searchsorted(sure, b) - 1
        some = first <= last
        start, stop = a.copy(), b.copy()
        start[some], stop[some] = sure[first[some]], sure[last[some]] + 1
        return chars[start] << 32 | chars[stop], self.words[a] << 32 | self.words[b], a << 32 | b


def _packed(min_words: int):
    """Rows (doc_id, text) to the packed windows of each bin."""

    def emit(parts: list) -> pa.RecordBatch:
        digests, docs, numbers = (np.concatenate(c) for c in zip(*parts, strict=True))
        of = (digests >> np.uint64(64 - BINS.bit_length() + 1)).astype("i4")
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(BINS + 1))
        rows = [(k, order[lo:hi]) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
        columns = [pa.array([pack_array(x[at], t) for _, at in rows], pa.binary()) for x, t in ((digests, "<u8"), (docs, "<i8"), (numbers, "<u4"))]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), *columns], ["bin", "digests", "docs", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                if not raw:
                    continue
                found = Windows(raw, min_words)
                parts.append((found.digests(), np.full(len(found), doc_id, "i8"), np.arange(len(found), dtype="u4")))
                held += len(found)
                if held > BLOCK:
                    yield emit(parts)
                    parts, held = [], 0
        if held:
            yield emit(parts)

    return run


def repeated_of(digests: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the digests that several documents have, and the smallest of these documents for each."""
    order = np.argsort(digests, kind="stable")
    begin = np.flatnonzero(np.diff(digests[order], prepend=~digests[order[:1]]))
    size = np.diff(begin, append=len(order))
    least, most = np.minimum.reduceat(docs[order], begin), np.maximum.reduceat(docs[order], begin)
    several = np.repeat(least < most, size)
    return order[several], np.repeat(least, size)[several]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed windows sorted by bin to the repeated ones."""
    names = ("digests", "docs", "numbers")
    types = ("<u8", "<i8", "<u4")

    def found(rows: list[tuple[bytes, ...]], k: int) -> Iterator[pa.RecordBatch]:
        n = sum(int.from_bytes(row[0][:8], "little") for row in rows)
        slices = max(1, -(-n // SLICE))
        wide = 64 - BINS.bit_length() + 1
        edges = [((k << wide) + (t << wide) // slices) for t in range(slices)] + [None]
        for lo, hi in zip(edges, edges[1:], strict=False):
            parts = []
            for row in rows:
                digests = unpack_array(row[0], types[0])
                kept = (digests >= np.uint64(lo)) & ((digests < np.uint64(hi)) if hi is not None else True)
                if kept.any():
                    parts.append((digests[kept], *(unpack_array(x, t)[kept] for x, t in zip(row[1:], types[1:], strict=True))))
            if parts:
                digests, docs, numbers = (np.concatenate(c) for c in zip(*parts, strict=True))
                at, least = repeated_of(digests, docs)
                for i in range(0, len(at), 1 << 17):
                    some = at[i : i + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (docs[some], numbers[some].astype("i8"), digests[some].view("i8"), least[i : i + (1 << 17)])], ["doc_id", "number", "digest", "first_doc_id"])

    now, held = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bin", *names)), strict=True):
            if k != now:
                yield from found(held, now) if held else ()
                now, held = k, []
            held.append(tuple(row))
    yield from found(held, now) if held else ()


def _places(min_words: int):
    """Rows (doc_id, text, numbers, digests, firsts) to the places of those windows of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            listed = [col(c) for c in ("numbers", "digests", "firsts")]
            parts = []
            for i, (doc_id, text) in enumerate(zip(col("doc_id").to_pylist(), col("text"), strict=True)):
                raw = text.as_py()
                if not raw:
                    continue
                found = Windows(raw, min_words)
                numbers, digests, firsts = (x[i].values.to_numpy(zero_copy_only=False) for x in listed)
                own = np.flatnonzero(numbers < len(found))  # an id may have several texts, of which the digest tells
                own = own[found.digests(numbers[own]) == digests[own].view("u8")]
                numbers, firsts = numbers[own], firsts[own]
                parts.append((np.full(len(own), doc_id, "i8"), *found.places(numbers), firsts))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["doc_id", "chars", "words", "chunks", "first_doc_id"])

    return run


def extend(runs: list[list[int]], window: list[int]) -> None:
    """Adds a window to the runs of those before it: begin and end in code points, in words and in chunks, first document."""
    if runs and window[0] < runs[-1][1]:
        last = runs[-1]
        for k in (0, 2, 4):
            last[k], last[k + 1] = min(last[k], window[k]), max(last[k + 1], window[k + 1])
        last[6] = min(last[6], window[6])
    else:
        runs.append(window)


def apart(later: list[list[int]], first: list[list[int]], least: int) -> list[tuple[list[int], bool]]:
    """Runs that aren't first in their document, and what of the first ones lies beside them."""
    out, at = [], 0
    for run in first:
        while at < len(later) and later[at][1] <= run[0]:
            at += 1
        k = at
        while k < len(later) and later[k][0] < run[1]:
            other = later[k]
            if other[0] > run[0] and other[2] - run[2] >= least:
                out.append(([run[0], other[0], run[2], other[2], run[4], other[4], run[6]], True))
            run = [other[1], run[1], other[3], run[3], other[5], run[5], run[6]]
            k += 1
        if run[0] < run[1] and run[3] - run[2] >= least:
            out.append((run, True))
    return [*((x, False) for x in later), *out]


def _passages(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []
        runs: tuple[list[list[int]], list[list[int]]] = ([], [])

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            types = [pa.int64()] * 6 + [pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "stop", "n_words", "n_chunks", "first_doc_id", "is_first"])

        def close() -> None:
            out.extend((key, x[0], x[1], x[3] - x[2], x[5] - x[4], x[6], own) for x, own in apart(*runs, min_words))
            runs[0].clear()
            runs[1].clear()

        for batch in batches:
            for doc_id, chars, words, chunks, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc_id != key:
                    close()
                    key = doc_id
                extend(runs[first == doc_id], [chars >> 32, chars & 0xFFFFFFFF, words >> 32, words & 0xFFFFFFFF, chunks >> 32, chunks & 0xFFFFFFFF, first])
            yield emit()
        close()
        yield emit()

    return run


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, number, digest, first_doc_id of every window of ``docs`` (doc_id, text) that several documents have."""
    packed = docs.mapInArrow(_packed(min_words), PACKED_SCHEMA)
    return stage(packed.repartition("bin").sortWithinPartitions("bin").mapInArrow(_repeated, REPEATED_SCHEMA), "repeated-windows")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage: doc_id, start, stop, n_words, n_chunks, first_doc_id, is_first.

    ``first_doc_id`` is the smallest document id that shares a window of the
    passage; ``is_first`` tells that no window of it stands in a smaller one (of
    a passage that is not first, every window does). Rows of a document don't
    overlap: of a first passage, the parts of ``min_words`` words that lie beside
    the others are given. ``n_words`` and ``n_chunks`` count the whole windows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).filter(F.col("doc_id").isNotNull())
    bound_batches(docs.sparkSession)
    found = repeated_windows(narrow, min_words)
    listed = found.groupBy("doc_id").agg(F.collect_list(F.struct("number", "digest", "first_doc_id")).alias("w"))
    listed = listed.select("doc_id", F.col("w.number").alias("numbers"), F.col("w.digest").alias("digests"), F.col("w.first_doc_id").alias("firsts"))
    # the documents with repeated windows grow with the corpus: never a broadcast of them
    repeated = narrow.join(listed.hint("merge"), "doc_id").mapInArrow(_places(min_words), PLACE_SCHEMA)
    sorted_ = repeated.repartition("doc_id").sortWithinPartitions("doc_id", "chars", "words", "chunks")
    return sorted_.mapInArrow(_passages(min_words), PASSAGE_SCHEMA)


def remove_passages(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the later copies of repeated passages (columns as given)."""
    cols = docs.columns
    spans = (
        passages.filter(~F.col("is_first")).groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_spans")).withColumnRenamed("doc_id", "_span_id")
    )
    joined = docs.join(spans, F.col(id_col) == F.col("_span_id"), "left")
    n = F.size("_spans")
    gap = lambda i: F.substring(
        F.col(text_col), F.when(i == 0, F.lit(1)).otherwise(F.get("_spans", i - 1)["stop"] + 1).cast("int"),
        (F.when(i == n, F.length(text_col)).otherwise(F.get("_spans", i)["start"]) - F.when(i == 0, F.lit(0)).otherwise(F.get("_spans", i - 1)["stop"])).cast("int"))
    kept = F.array_join(F.transform(F.sequence(F.lit(0), n), gap), "")
    return joined.withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(kept)).select(*cols)
