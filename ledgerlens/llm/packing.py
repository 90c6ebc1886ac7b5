"""Packing documents into fixed windows: concatenate and cut.

1. Each task tokenizes its documents, ends each with ``end_id`` and notes where
   in the task's own stream it starts; ids are written as a table.
2. The tasks' totals (one row per task) are summed up to offsets of the tasks in
   one global stream; task offset plus local start is a document's place in it.
3. Each document is cut at the multiples of the window; the pieces at its ends
   are the boundary records shared with its neighbours in the stream.

All windows are full but the last, so nothing else is ever padded. Only per-task
totals are shuffled; a long document's pieces are made where it lies.

Tokens are found by word: what stands between spaces or line feeds is tokenized
once per task while it stays in a bounded cache. No rule of the tokenizers meant
here (white space dropped before merges) reaches over a space.

Defined results: a null or empty text is the single ``end_id``; each row of the
input is a document of its own (repeated ids too); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage
from ledgerlens.llm.tokens import load_tokenizer

WINDOW = 2048
#: Words whose ids a task keeps, and characters that a word may have to be kept.
CACHED_WORDS, CACHED_CHARS = 800_000, 64
#: Rows whose words are looked up together.
SLICE_ROWS = 2048
#: Texts whose lower case and classes are settled (nothing in them composes), and
#: the tokenizer's split of them into pre-tokens (fixed value).
PLAIN = r"[\x20-\x7e\xa1-\u012f\u0131-\u024f]*"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Ids that are handed on at a time.
BATCH_IDS = 4_000_000
TOKEN_SCHEMA = "part int, doc_id long, start long, n long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordIds:
    """Ids of texts as little-endian bytes, word by word.

    Texts of plain Latin letters, digits and signs are lower-cased and their words
    split into pre-tokens here, so that "The", "the" and "the," share a piece; the
    tokenizer sees each new piece once, many to a call, and the pieces' ids are told
    apart by the ids that end a word. The words of all other texts are given to the
    tokenizer as they are.
    """

    def __init__(self, path: str, dtype: str) -> None:
        import re

        import regex

        tokenizer = load_tokenizer(path)
        self.encode = tokenizer.encode_batch_fast
        self.dtype = np.dtype(dtype)
        self.pieces: dict[str, bytes] = {"": b""}  # of plain words and their pre-tokens
        self.words: dict[str, bytes] = {"": b""}  # of the others
        self.plain = re.compile(PLAIN).fullmatch
        self.split = regex.compile(PIECE).findall
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _alone(self, words: list[str]) -> dict[str, bytes]:
        found = self.encode(words, add_special_tokens=False)
        return {w: np.array(e.ids, self.dtype).tobytes() for w, e in zip(words, found, strict=True)}

    def _learn(self, fresh: list[str]) -> None:
        """Ids of new pieces, which hold no white space and are one pre-token each."""
        groups = [fresh[i : i + 1000] for i in range(0, len(fresh), 1000)]
        for group, found in zip(groups, self.encode([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.dtype)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(group) or last[-1] != len(ids):
                self.pieces |= self._alone(group)
                continue
            raw, width = ids.tobytes(), self.dtype.itemsize
            stops = (last * width).tolist()
            self.pieces.update(zip(group, [raw[x:y] for x, y in zip([0, *stops[:-1]], stops, strict=True)], strict=True))

    def _plain(self, split: list[list[str]]) -> list[bytes]:
        if len(self.pieces) > CACHED_WORDS:
            self.pieces = {"": b""}
        pieces = self.pieces
        fresh = set().union(*split).difference(pieces)
        new, ended, several = [], [], {}
        for w in fresh:
            if w.isalpha():
                new.append(w)
            elif w[:-1].isalpha():
                ended.append(w)  # letters and one other character: two pre-tokens
            else:
                several[w] = self.split(w)
        more = {w[:-1] for w in ended}.union((w[-1] for w in ended), *several.values())
        more = more.difference(new).difference(pieces)
        self._learn([*new, *more])
        for w in ended:
            pieces[w] = pieces[w[:-1]] + pieces[w[-1]]
        for w, found in several.items():
            if w not in more:
                pieces[w] = b"".join([pieces[p] for p in found])
        out = [b"".join(map(pieces.__getitem__, words)) for words in split]
        for w in [w for w in (*fresh, *more) if len(w) > CACHED_CHARS]:
            pieces.pop(w, None)
        return out

    def _other(self, split: list[list[str]]) -> list[bytes]:
        if len(self.words) > CACHED_WORDS:
            self.words = {"": b""}
        fresh = set().union(*split).difference(self.words)
        self.words |= self._alone(list(fresh))
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        for w in [w for w in fresh if len(w) > CACHED_CHARS]:
            del self.words[w]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        # millions of words and no cycle among them: collections would only walk through them
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._ids(texts)
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        texts = [t.replace("\n", " ") for t in texts]
        plain = ["<|" not in t and self.plain(t) is not None for t in texts]
        lowered = iter(self._plain([t.lower().split(" ") for t, p in zip(texts, plain, strict=True) if p]))
        others = iter(self._other([t.split(" ") for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(lowered if p else others) for p in plain]


def _tokenize(path: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        word_ids, end, width = WordIds(path, dtype), np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(lo, SLICE_ROWS)
                ids = [x + end for x in word_ids([t or "" for t in piece.column(1).to_pylist()])]
                n = np.array([len(x) // width for x in ids], "i8")
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, "i4")), piece.column(0), pa.array(start), pa.array(n), pa.array(ids, pa.binary())],
                    ["part", "doc_id", "start", "n", "ids"])

    return run


def _cut(window: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                ids = np.frombuffer(ids, dtype).astype("<u4")
                lo = 0
                while lo < n:
                    sequence, offset = divmod(at + lo, window)
                    length = min(window - offset, n - lo)
                    rows.append((doc_id, lo, length, n, sequence, offset, ids[lo : lo + length].tobytes()))
                    lo += length
                    held += length
                    if held >= BATCH_IDS:
                        yield _pieces(rows)
                        rows, held = [], 0
            if rows:
                yield _pieces(rows)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (uint32, little-endian)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dtype = "<u2" if load_tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    tokens = stage(narrow.mapInArrow(_tokenize(tokenizer_path, end_id, dtype), TOKEN_SCHEMA), "pack-tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        tokens.groupBy("part").agg(F.sum("n").alias("total"))
        .select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    )
    # one 16-byte row for each task that tokenized
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    return placed.mapInArrow(_cut(window, dtype), PIECE_SCHEMA)
