"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. Documents are read in blocks of about ``BLOCK_BYTES`` of text. A block keeps
   its documents' pre-token frequencies, coded by a dictionary of the block's
   distinct pre-tokens.
2. The dictionaries' pre-tokens are dealt over parts by hash; the task of a part
   counts the pieces of each distinct one once. A pre-token arrives at most once
   per block, so even the commonest brings little.
3. The counts return to their block and are summed against the frequencies.

Shuffled are the distinct pre-tokens of each block, their counts, and the coded
frequencies; never texts or ids.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row of
the input gives one row (repeated ids too); a text of any length is one document
of one block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage

#: Bytes of text after which a block ends.
BLOCK_BYTES = 32_000_000
#: Words of a part whose counts a task keeps.
KNOWN_WORDS = 300_000
#: The byte-level pre-tokenizer's pattern (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only are split by ``PRE_TOKEN`` in the regex module;
#: the classes of all others are left to the tokenizer's own pre-tokenizer.
SETTLED = r"[\x00-\x1b\x20-\x7e\xa0-\u052f]*"


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PreTokens:
    """Splits a text as the tokenizer does before its merges."""

    def __init__(self, tokenizer) -> None:
        import re

        import regex

        self.split = regex.compile(PRE_TOKEN).findall
        self.settled = re.compile(SETTLED).fullmatch
        self.own = tokenizer.pre_tokenizer.pre_tokenize_str
        special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of ``text`` and the number of special strings in it."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1 and self.settled(text):
            return self.split(text), 0
        found: list[str] = []
        for part in parts:
            if self.settled(part):
                found += self.split(part)
            else:
                found += [part[a:b] for _, (a, b) in self.own(part)]
        return found, len(parts) - 1


BLOCK_SCHEMA = (
    "block long, doc_ids array<long>, n_bytes array<long>, n_special array<long>, n_distinct binary, codes binary, freqs binary, "
    "parts array<struct<part: int, lengths: binary, words: binary>>")
PARTS_TYPE = pa.list_(pa.struct([("part", pa.int32()), ("lengths", pa.binary()), ("words", pa.binary())]))


def _pack(values: np.ndarray) -> bytes:
    raw = values.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), "<u4") if size else np.zeros(0, "<u4")


def _pack_words(words: list[str]) -> tuple[bytes, bytes]:
    raw = [w.encode() for w in words]
    data = b"".join(raw)
    return _pack(np.fromiter(map(len, raw), "u4", len(raw))), len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack_words(lengths: bytes, words: bytes) -> list[str]:
    ends = np.cumsum(_unpack(lengths).astype("i8")).tolist()
    data = pa.decompress(words[8:], decompressed_size=int.from_bytes(words[:8], "little"), codec="zstd", asbytes=True)
    return [data[x:y].decode() for x, y in zip([0, *ends[:-1]], ends, strict=True)]


def _blocks(path: str, block_bytes: int, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        split = PreTokens(load_tokenizer(path))
        first = TaskContext.get().partitionId() << 32
        numbers = itertools.count()
        block = _Block()

        def emit(block: _Block) -> pa.RecordBatch:
            # the dictionary in the order of its words' parts
            words = list(block.words)
            part = np.fromiter((xxh3_64_intdigest(w) % n_parts for w in words), "i8", len(words))
            order = np.argsort(part, kind="stable")
            place = np.empty(len(words), "i8")
            place[order] = np.arange(len(words))
            lengths = np.array(block.lengths, "i8")
            codes = place[np.concatenate(block.codes)] if len(words) else np.zeros(0, "i8")
            freqs = np.concatenate(block.freqs) if len(words) else np.zeros(0, "u4")
            doc = np.repeat(np.arange(len(lengths)), lengths)
            by = np.lexsort((codes, doc))
            codes, freqs = codes[by], freqs[by]
            steps = np.diff(codes, prepend=0)  # sorted codes as steps: small numbers
            starts = (np.cumsum(lengths) - lengths)[lengths > 0]
            steps[starts] = codes[starts]
            bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=n_parts)).tolist() if len(words) else []
            parts = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                n, data = _pack_words([words[i] for i in order[lo:hi].tolist()])
                parts.append({"part": int(part[order[lo]]), "lengths": n, "words": data})
            columns = [
                pa.array([first + next(numbers)], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in (block.ids, block.sizes, block.special)),
                *(pa.array([_pack(x)], pa.binary()) for x in (lengths, steps, freqs)), pa.array([parts], PARTS_TYPE),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "n_bytes", "n_special", "n_distinct", "codes", "freqs", "parts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                size = len(text.encode())
                if block.ids and block.held + size > block_bytes:
                    yield emit(block)
                    block = _Block()
                block.add(doc_id.as_py(), size, *split(text))
        if block.ids:
            yield emit(block)

    return run


class _Block:
    """Documents read so far and the dictionary of their pre-tokens."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.special, self.lengths, self.codes, self.freqs = [], [], [], [], [], []
        self.words: dict[str, int] = {}
        self.held = 0

    def add(self, doc_id: int | None, size: int, found: list[str], special: int) -> None:
        count, words = Counter(found), self.words
        self.codes.append(np.fromiter((words.setdefault(w, len(words)) for w in count), "i8", len(count)))
        self.freqs.append(np.fromiter(count.values(), "u4", len(count)))
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.special.append(special)
        self.lengths.append(len(count))
        self.held += size


def _count_pieces(path: str):
    """Rows (part, block, lengths, words), sorted by part: the pieces of a part's distinct words are counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(path).encode_batch_fast
        known: dict[str, int] = {}
        current = None
        for batch in batches:
            packed = []
            for part, lengths, words in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if part != current or len(known) > KNOWN_WORDS:
                    known, current = {}, part
                found = _unpack_words(lengths, words)
                fresh = [w for w in found if w not in known]
                known.update((w, len(e.ids)) for w, e in zip(fresh, encode(fresh, add_special_tokens=False), strict=True))
                packed.append(_pack(np.fromiter(map(known.__getitem__, found), "u4", len(found))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["part", "block", "pieces"])

    return run


def _sum_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            col = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: B023, E731
            ids, sizes = col("doc_ids").values, col("n_bytes").values
            special = col("n_special").values.to_numpy(zero_copy_only=False)
            lengths, steps, freqs = (_unpack(col(c).as_py()).astype("i8") for c in ("n_distinct", "codes", "freqs"))
            counted = sorted((x["part"], x["pieces"]) for x in col("counted").as_py() or [])
            pieces = np.concatenate([_unpack(x) for _, x in counted]).astype("i8") if counted else np.zeros(0, "i8")
            ends = np.cumsum(lengths)
            total = np.cumsum(steps)
            before = np.concatenate([[0], total])[ends - lengths]  # each document's steps begin anew
            codes = total - np.repeat(before, lengths)
            sums = np.concatenate([[0], np.cumsum(pieces[codes] * freqs)])
            tokens = sums[ends] - sums[ends - lengths] + special
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of ``docs``."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the words of all blocks are dealt over parts, several to each task of a shuffle
    n_parts = 4 * max(32, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = stage(narrow.mapInArrow(_blocks(tokenizer_path, block_bytes, n_parts), BLOCK_SCHEMA), "token-blocks")
    words = blocks.select("block", F.explode("parts").alias("p")).select("p.part", "block", "p.lengths", "p.words")
    counted = (
        words.repartition("part").sortWithinPartitions("part")
        .mapInArrow(_count_pieces(tokenizer_path), "part int, block long, pieces binary")
        .groupBy("block").agg(F.collect_list(F.struct("part", "pieces")).alias("counted"))
    )
    coded = blocks.drop("parts").join(counted, "block", "left")
    return coded.mapInArrow(_sum_pieces, "doc_id long, n_bytes long, n_tokens long")
