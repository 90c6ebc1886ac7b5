"""Phrase collocations: words that stand together more often than apart.

1. Documents are read in blocks of about ``BLOCK_BYTES`` of text. A block codes its
   words by a dictionary of its own; the coded words, language by language and with a
   mark after each piece of text, are written.
2. Prefix polynomials over the words' hashes give the fingerprint of every run of 1 to
   ``max_words`` words by two look-ups. A block sorts and counts its fingerprints and
   deals them over bins by their leading bits, packed. An occurrence pointer is the
   block and the fingerprint's place in the block's sorted list, so it costs nothing.
3. The task of a bin adds up the blocks' counts and answers each block with one bit for
   each pointer: the fingerprint reaches ``min_count`` or not.
4. Each block looks up the marked ones in its words. Occurrences under one fingerprint
   are compared word by word with the first; those that differ are told apart. Their
   texts and counts are summed by text, so that a collision can bring a phrase here
   that isn't frequent, but never changes a count: it is dropped by its exact count.
5. Scores, overlapping phrases and ranks are joins and aggregates of frequent phrases.

Shuffled are about four bytes for each distinct run of a block, one bit back, and the
texts of frequent runs; never rare runs' texts. A run comes once from a block, so even
the commonest loads no task; a bin's size is fixed, their number follows the input.

Defined results: null texts count as empty; a null language is ``und``; letters A-Z are
lower-cased; phrases never reach over a piece's end; a text of any length is in one
block; repeated rows and ids count as often as they occur; an empty table gives an empty
result; other columns are ignored. Scores are exact for counts below 10^16.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import pack_array, stage, unpack_array

#: Bytes of text after which a block ends.
BLOCK_BYTES = 8_000_000
#: Fingerprints of a bin, on average.
BIN_ENTRIES = 2_000_000
#: Leading bits of a fingerprint that are compared; texts decide where they collide.
KEY_BITS = 48
#: Characters that end a piece (fixed by the definition of a phrase).
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
MARK = b"\xff"  # ends a piece; no byte of UTF-8
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
BLOCK_SCHEMA = (
    "block long, n_tokens long, langs array<string>, lang_tokens array<long>, lang_words array<long>, word_lengths binary, words binary, codes binary")
BIN_SCHEMA = "bin long, block long, keys binary, counts binary"
PHRASE_SCHEMA = "lang string, n_words int, phrase string, count long"


def _byte_table() -> bytes:
    table = bytearray(range(256))
    table[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    for c in PIECE_ENDS:
        table[c] = MARK[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


def words_and_marks(text: str, table: bytes) -> list[bytes]:
    """Words of ``text`` with a mark after each piece."""
    found = text.encode().translate(table).replace(MARK, b" " + MARK + b" ").split()
    found.append(MARK)
    return found


class _Block:
    """Documents read so far: codes by language, and the dictionary of their words (0: the mark)."""

    def __init__(self) -> None:
        self.codes: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        self.words: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.words[MARK]
        self.held = 0

    def add(self, lang: str, text: str, table: bytes) -> None:
        found = words_and_marks(text, table)
        self.codes[lang].append(np.fromiter(map(self.words.__getitem__, found), "u4", len(found)))

    def row(self, number: int) -> pa.RecordBatch:
        langs = sorted(self.codes)
        streams = [np.concatenate(self.codes[x]) for x in langs]
        words = list(self.words)[1:]
        columns = [
            pa.array([number], pa.int64()), pa.array([sum(map(len, streams))], pa.int64()), pa.array([langs], pa.list_(pa.string())),
            pa.array([list(map(len, streams))], pa.list_(pa.int64())), pa.array([[int(np.count_nonzero(s)) for s in streams]], pa.list_(pa.int64())),
            *(pa.array([x], pa.binary()) for x in (
                pack_array(np.fromiter(map(len, words), "u4", len(words)), "<u4"), pack_array(np.frombuffer(b"".join(words), "u1"), "u1"),
                pack_array(np.concatenate(streams), "<u4"))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "n_tokens", "langs", "lang_tokens", "lang_words", "word_lengths", "words", "codes"])


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, block = _byte_table(), _Block()
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                size = len(text)
                if block.codes and block.held + size > block_bytes:
                    yield block.row(next(numbers))
                    block = _Block()
                block.add(lang.as_py(), text, table)
                block.held += size
        if block.codes:
            yield block.row(next(numbers))

    return run


def _powers(base: int, m: int) -> np.ndarray:
    """base^0 to base^m modulo 2^64."""
    factors = np.full(m + 1, base, "u8")
    factors[0] = 1
    return np.cumprod(factors, dtype="u8")


class _Runs:
    """The coded words of a block and the fingerprints of their runs."""

    def __init__(self, row: dict, key_bits: int) -> None:
        from xxhash import xxh3_64_intdigest

        lengths = unpack_array(row["word_lengths"], "<u4").astype("i4")
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("i4")
        data = unpack_array(row["words"], "u1").tobytes()
        # word 0 is the mark, which no run holds
        self.words = pa.Array.from_buffers(pa.string(), len(lengths) + 1, [None, pa.py_buffer(np.concatenate([[0], offsets]).astype("<i4")), pa.py_buffer(data)])
        hashes = np.fromiter((xxh3_64_intdigest(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), "u8", len(lengths))
        self.codes = unpack_array(row["codes"], "<u4")
        self.langs = row["langs"]
        self.lang = np.repeat(np.arange(len(self.langs)), row["lang_tokens"])
        self.lang_hash = np.fromiter(map(xxh3_64_intdigest, self.langs), "u8", len(self.langs))
        m = len(self.codes)
        self.marks = np.concatenate([[0], np.cumsum(self.codes == 0)])
        powers = _powers(BASE, m)
        values = np.concatenate([np.zeros(1, "u8"), hashes])[self.codes]
        self.prefix = np.concatenate([np.zeros(1, "u8"), np.cumsum(values * powers[:m], dtype="u8")])
        self.unpower = _powers(pow(BASE, -1, 1 << 64), m)
        self.shift = np.uint64(64 - key_bits)

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of ``n`` words, and their fingerprints."""
        at = np.flatnonzero(self.marks[n:] == self.marks[:-n]) if len(self.codes) >= n else np.zeros(0, "i8")
        x = (self.prefix[at + n] - self.prefix[at]) * self.unpower[at] + self.lang_hash[self.lang[at]] + np.uint64(n * BASE & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # spreads the low bits
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return at, (x ^ (x >> np.uint64(31))) >> self.shift


def _bounds(sorted_keys: np.ndarray, n_bins: int, key_bits: int) -> np.ndarray:
    """Where each bin begins and ends in a block's sorted fingerprints."""
    edges = np.array([(i << key_bits) // n_bins for i in range(1, n_bins)], "u8")
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _fingerprints(max_words: int, n_bins: int, key_bits: int):
    """Rows (bin, block, keys, counts) of a block's distinct runs; the bins of runs of n words are those from n * n_bins on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                runs = _Runs(row, key_bits)
                for n in range(1, max_words + 1):
                    keys, counts = np.unique(runs.keys(n)[1], return_counts=True)
                    bounds = _bounds(keys, n_bins, key_bits)
                    bins = np.flatnonzero(np.diff(bounds))
                    packed = [(pack_array(np.diff(keys[a:b], prepend=np.uint64(0)), "<u8"), pack_array(counts[a:b], "<u4")) for a, b in zip(bounds[bins], bounds[bins + 1], strict=True)]
                    if packed:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(bins + n * n_bins, pa.int64()), pa.array(np.full(len(bins), row["block"]), pa.int64()),
                             pa.array([k for k, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())],
                            ["bin", "block", "keys", "counts"])

    return run


def _answer(number: int, held: list[tuple[int, bytes, bytes]], min_count: int) -> pa.RecordBatch:
    keys = [np.cumsum(unpack_array(k, "<u8"), dtype="u8") for _, k, _ in held]
    counts = np.concatenate([unpack_array(c, "<u4") for _, _, c in held])
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    frequent = (np.bincount(which, counts) >= min_count)[which]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    bits = [(block, np.packbits(x).tobytes()) for (block, _, _), x in zip(held, np.split(frequent, ends), strict=True) if x.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(bits), number), pa.int64()), pa.array([b for b, _ in bits], pa.int64()), pa.array([x for _, x in bits], pa.binary())],
        ["bin", "block", "bits"])


def _frequent(min_count: int):
    """Rows sorted by bin: the pointers of fingerprints whose blocks' counts reach ``min_count``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        current = None
        for batch in batches:
            for number, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and number != current:
                    yield _answer(current, held, min_count)
                    held = []
                current = number
                held.append(tuple(rest))
        if held:
            yield _answer(current, held, min_count)

    return run


def _phrases_of(runs: _Runs, at: np.ndarray, n: int, counts: np.ndarray) -> pa.RecordBatch:
    phrase = pc.binary_join_element_wise(*(runs.words.take(pa.array(runs.codes[at + j])) for j in range(n)), " ")
    lang = pa.array(runs.langs, pa.string()).take(pa.array(runs.lang[at]))
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(at), n, "i4")), phrase, pa.array(counts, pa.int64())], ["lang", "n_words", "phrase", "count"])


def _materialise(max_words: int, n_bins: int, key_bits: int):
    """A block's runs under frequent fingerprints, as text, with their counts in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                runs = _Runs(row, key_bits)
                answers = {x["bin"]: x["bits"] for x in row["answers"]}
                for n in range(1, max_words + 1):
                    at, keys = runs.keys(n)
                    order = np.argsort(keys, kind="stable")
                    at, keys = at[order], keys[order]
                    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, "i8")
                    bounds = _bounds(keys[first], n_bins, key_bits)
                    chosen = np.zeros(len(first), bool)
                    for i in range(n_bins):
                        if bits := answers.get(n * n_bins + i):
                            size = int(bounds[i + 1] - bounds[i])
                            chosen[bounds[i] : bounds[i + 1]] = np.unpackbits(np.frombuffer(bits, "u1"), count=size).astype(bool)
                    counts = np.diff(first, append=len(keys))
                    member = np.repeat(chosen, counts)
                    places, of = at[member], np.repeat(np.arange(int(chosen.sum())), counts[chosen])
                    lead = at[first[chosen]]
                    same = runs.lang[places] == runs.lang[lead[of]]
                    for j in range(n):
                        same &= runs.codes[places + j] == runs.codes[lead[of] + j]
                    if len(lead):
                        yield _phrases_of(runs, lead, n, np.bincount(of[same], minlength=len(lead)))
                    if not same.all():  # a collision within the block
                        others = places[~same]
                        told = np.stack([runs.lang[others], *(runs.codes[others + j] for j in range(n))])
                        _, where, k = np.unique(told, axis=1, return_index=True, return_counts=True)
                        yield _phrases_of(runs, others[where], n, k)

    return run


def _frequent_runs(docs: DataFrame, max_words: int, min_count: int, lang_col: str, text_col: str, block_bytes: int, key_bits: int, bin_entries: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, count) of all runs of at least ``min_count`` occurrences, and (lang, n) words of each language."""
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    blocks = stage(narrow.mapInArrow(_blocks(block_bytes), BLOCK_SCHEMA), "phrase-blocks")
    totals = blocks.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n"))
    n_bins = 1 + (blocks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0) // bin_entries
    answers = (
        blocks.mapInArrow(_fingerprints(max_words, n_bins, key_bits), BIN_SCHEMA).repartition("bin").sortWithinPartitions("bin")
        .mapInArrow(_frequent(min_count), "bin long, block long, bits binary")
        .groupBy("block").agg(F.collect_list(F.struct("bin", "bits")).alias("answers"))
    )
    found = blocks.join(answers, "block").mapInArrow(_materialise(max_words, n_bins, key_bits), PHRASE_SCHEMA)
    summed = found.groupBy("lang", "n_words", "phrase").agg(F.sum("count").alias("count")).where(F.col("count") >= min_count)
    return stage(summed, "phrases"), totals


def frequent_phrases(docs: DataFrame, *, max_words: int = 3, min_count: int = 10, lang_col: str = "lang", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key_bits: int = KEY_BITS, bin_entries: int = BIN_ENTRIES) -> DataFrame:
    """(lang, n_words, phrase, count) of every run of 1 to ``max_words`` words with at least ``min_count`` occurrences."""
    return _frequent_runs(docs, max_words, min_count, lang_col, text_col, block_bytes, key_bits, bin_entries)[0]


def collocations(
    docs: DataFrame, *, max_words: int = 3, min_count: int = 10, inside_percent: int = 50, limit: int = 2000, lang_col: str = "lang", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, key_bits: int = KEY_BITS, bin_entries: int = BIN_ENTRIES,
) -> DataFrame:
    """Each language's first ``limit`` phrases by score: lang, rank, phrase, a, l, r, n, score (numbers long).

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all
    words of the language. A phrase inside a longer one that has at least
    ``inside_percent`` % of its occurrences is dropped.
    """
    runs, totals = _frequent_runs(docs, max_words, min_count, lang_col, text_col, block_bytes, key_bits, bin_entries)
    phrases = runs.where("n_words >= 2").select("lang", "phrase", "n_words", F.col("count").alias("a"), F.split("phrase", " ").alias("words"))
    # each cut's two parts are frequent runs themselves
    part = lambda first, length: F.array_join(F.slice("words", first, length), " ")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("n_words") - F.col("cut")).alias("right"))
    counted = runs.select("lang", "phrase", "count")
    both = (
        cuts.join(counted.toDF("lang", "left", "l"), ["lang", "left"])
        .join(counted.toDF("lang", "right", "r"), ["lang", "right"])
    )
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"(1000000 * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})")
    weakest = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.*")
    # runs inside longer candidates
    longer = phrases.where("n_words >= 3")
    lengths = F.sequence(F.lit(2), F.col("n_words") - 1)
    inner = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    held = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = F.col("longer").isNull() | (F.expr(f"100 * {wide('longer')}") < F.expr(f"{inside_percent} * {wide('a')}"))
    kept = weakest.join(held, ["lang", "phrase"], "left").where(stays).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
