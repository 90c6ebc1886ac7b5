"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

1. Documents are read in blocks of about ``BLOCK_BYTES`` of text, aligned in slices of
   ``SLICE_BYTES``. A slice's ids are Arrow lists; flattened, with their parent indices,
   segmented cumulative sums of token bytes give every token's end in its document.
2. A full outer hash join of both sides' (document, end) keys, sorted by key and filled
   backwards, has one row for each pair of tokens whose bytes overlap (a link); rows
   with both sides are ends in common, which cut the tokens into groups.
3. ``Table.group_by`` counts the links of each document by id pair. A block is written
   with its distinct pairs, how many of its documents hold each, and, per document,
   pairs (as places in that list) and frequencies; tokens and links are not kept.
4. Spark adds up the blocks' partial counts by pair, finds the highest of each A id,
   joins both back to the blocks' pairs, and each block sums them over its documents.

A pair comes once from a block, so the commonest pair loads no task, and an A id has at
most as many pairs as B has ids. What a block gets back is as long as its own list.

Defined results: null and empty texts have no tokens, nor have texts whose joined token
bytes, by either tokenizer, differ from a space and the text; such rows have zeros and
an empty string. Every row of the input gives one row (repeated ids count as documents
of their own); a text of any length is in one slice of one block; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import pack_array, stage, unpack_array
from ledgerlens.llm.tokens import PreTokens, load_tokenizer

#: Bytes of text after which a block, and a slice of it, ends.
BLOCK_BYTES, SLICE_BYTES = 16_000_000, 1_000_000
#: Pre-tokens whose ids a task keeps, and characters that a kept one may have.
KEPT_WORDS, KEPT_CHARS = 300_000, 64
#: Bits of a (document, end) key for the end.
END_BITS = 40
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
BLOCK_SCHEMA = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "lengths binary, codes binary, freqs binary, pairs binary, n_docs binary")
RESULT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteLevel:
    """Ids of texts by a byte-level BPE (.json); special strings in them are text like any other."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self.tokenizer.encode_special_tokens = True
        self.split = PreTokens(self.tokenizer)
        self.split.special = None
        # bytes are shown by their own character where it prints, else by those from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocabulary = self.tokenizer.get_vocab()
        self.entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.entries[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        # ids of all kept pre-tokens one after the other, and how many each has
        self.flat, self.sizes = np.zeros(0, "i4"), np.zeros(0, "i8")

    def __call__(self, texts: list[str]) -> pa.ListArray:
        """A list of ids for each text."""
        split = [self.split(t)[0] if t else [] for t in texts]
        if len(self.places) > KEPT_WORDS:
            self._forget()
        fresh = list(set().union(*split).difference(self.places))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
        self.places.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), "i8", len(found))])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), "i4")])
        word_ends = np.cumsum(np.fromiter(map(len, split), "i8", len(split)))
        words = np.fromiter(map(self.places.__getitem__, itertools.chain.from_iterable(split)), "i8", int(word_ends[-1]) if len(split) else 0)
        n = self.sizes[words]
        total = np.cumsum(n)
        at = np.repeat((np.cumsum(self.sizes) - self.sizes)[words] - (total - n), n) + np.arange(total[-1] if len(total) else 0)
        ends = np.concatenate([[0], total])[word_ends]
        ids = self.flat[at]
        if any(len(w) > KEPT_CHARS for w in fresh):
            self._drop_long()
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))

    def _drop_long(self) -> None:
        kept = np.fromiter((len(w) <= KEPT_CHARS for w in self.places), bool, len(self.places))
        self.flat, self.sizes = self.flat[np.repeat(kept, self.sizes)], self.sizes[kept]
        self.places = {w: i for i, w in enumerate(itertools.compress(list(self.places), kept))}


class Pieces:
    """Ids of texts by a sentencepiece model, which puts a space before each."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.vocab_size())
        self.entries = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, self.model.id_to_piece(list(ids)), strict=True)]

    def __call__(self, texts: list[str]) -> pa.ListArray:
        found = self.model.encode(texts, num_threads=1) if texts else []
        ends = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(itertools.chain.from_iterable(found), "i4", int(ends[-1]))))


def _same_bytes(ids: pa.ListArray, entries: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether each list's joined token bytes are the text's."""
    joined = entries.take(ids.flatten())
    data = joined.buffers()[2]
    places = np.frombuffer(joined.buffers()[1], "<i4", len(joined) + 1, joined.offset * 4)[ids.offsets.to_numpy()].tolist()
    view = memoryview(data or b"").cast("B")
    return np.fromiter((view[a:b] == t for a, b, t in zip(places[:-1], places[1:], texts, strict=True)), bool, len(texts))


def _ends(ids: pa.ListArray, sizes: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Of each token: its document's place in the slice and its (document, end) key."""
    doc = pc.list_parent_indices(ids).cast(pa.int64())
    total = pc.cumulative_sum(sizes.take(ids.flatten()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(ids.offsets.slice(0, len(ids)))
    end = pc.subtract(total, before.take(doc))
    return doc, pc.add(pc.shift_left(doc, END_BITS), end)


def _links(key_a: pa.Array, key_b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, A token, B token, is an end in common) of each link, in order."""
    tokens = lambda n: pa.array(np.arange(n), pa.int64())
    a = pa.table({"key": key_a, "a": tokens(len(key_a))})
    b = pa.table({"key": key_b, "b": tokens(len(key_b))})
    both = a.join(b, "key", join_type="full outer", use_threads=False).combine_chunks()
    both = both.take(pc.sort_indices(both["key"]))
    common = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"]))
    # the token that covers the bytes before an end of the other side only is the next to end
    filled = [pc.fill_null_backward(both[c].combine_chunks()) for c in ("a", "b")]
    return (both["key"].to_numpy() >> END_BITS, filled[0].to_numpy(), filled[1].to_numpy(), common.to_numpy().astype(bool))


class _Aligner:
    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.sides = (ByteLevel(byte_path), Pieces(piece_path))
        self.entries = [pa.array(s.entries, pa.binary()) for s in self.sides]
        self.sizes = [pc.binary_length(e).cast(pa.int64()) for e in self.entries]
        a, b = (len(s.entries) for s in self.sides)
        self.sizes_of_vocabularies = (a, b)
        # every id with each sign that may follow it
        self.shown = pa.array([f"{i}{sign}" for n, signs in ((a, ",|"), (b, ",;")) for sign in signs for i in range(n)], pa.binary())

    def __call__(self, texts: list[str | None]) -> dict:
        """Counts and digests of the texts of a slice, and (document, pair, frequency) of their links."""
        whole = [b" " + t.encode() if t else b"" for t in texts]
        lists = [self.sides[0]([" " + t if t else "" for t in texts]), self.sides[1]([t or "" for t in texts])]
        good = np.array([bool(t) for t in texts], bool)
        for ids, entries in zip(lists, self.entries, strict=True):
            good &= _same_bytes(ids, entries, whole)
        if not good.all():
            lists = [self._only(ids, good) for ids in lists]
        flat = [ids.flatten().to_numpy() for ids in lists]
        (_, key_a), (_, key_b) = (_ends(ids, sizes) for ids, sizes in zip(lists, self.sizes, strict=True))
        doc, a, b, common = _links(key_a, key_b)
        n = len(texts)
        pair = flat[0][a].astype("i8") << 32 | flat[1][b]
        counted = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
        counts = [ids.value_lengths().to_numpy().astype("i8") for ids in lists]
        return {
            "n_a": counts[0], "n_b": counts[1], "n_groups": np.bincount(doc[common], minlength=n), "n_links": np.bincount(doc, minlength=n),
            "sha": self._digests(flat, counts, a[common], b[common]),
            "doc": counted["doc"].to_numpy(), "pair": counted["pair"].to_numpy(), "freq": counted["count_all"].to_numpy(),
        }

    @staticmethod
    def _only(ids: pa.ListArray, good: np.ndarray) -> pa.ListArray:
        """``ids`` with empty lists where not ``good``."""
        sizes = ids.value_lengths().to_numpy()
        kept = np.repeat(good, sizes)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes * good)]), pa.int32()), ids.flatten().filter(pa.array(kept)))

    def _digests(self, flat: list[np.ndarray], counts: list[np.ndarray], last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups as text; ``last_*``: the last token of each group."""
        ends = [np.zeros(len(x), bool) for x in flat]
        ends[0][last_a] = ends[1][last_b] = True
        group = [np.cumsum(e) - e for e in ends]
        sums = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(last_a)))]) for g in group]
        vocabulary_a, vocabulary_b = self.sizes_of_vocabularies
        order = np.empty(len(flat[0]) + len(flat[1]), "i4")
        order[np.arange(len(flat[0])) + sums[1][group[0]]] = flat[0] + vocabulary_a * ends[0]
        order[np.arange(len(flat[1])) + sums[0][group[1] + 1]] = 2 * vocabulary_a + flat[1] + vocabulary_b * ends[1]
        shown = self.shown.take(pa.array(order))
        offsets = np.frombuffer(shown.buffers()[1], "<i4", len(shown) + 1, shown.offset * 4)
        view = memoryview(shown.buffers()[2] or b"")
        places = offsets[np.concatenate([[0], np.cumsum(counts[0] + counts[1])])].tolist()
        return [hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(places[:-1], places[1:], strict=True)]


def _blocks(byte_path: str, piece_path: str, block_bytes: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pa.set_cpu_count(1)
        align = _Aligner(byte_path, piece_path)
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        ids: list[int | None] = []
        texts: list[str | None] = []
        parts: list[dict] = []
        waiting = held = 0

        def emit() -> pa.RecordBatch:
            nonlocal ids, parts, held
            joined = {k: np.concatenate([p[k] for p in parts]) for k in (*COUNTS, "pair", "freq")}
            lengths = np.concatenate([np.bincount(p["doc"], minlength=len(p["n_a"])) for p in parts])
            pairs, codes = np.unique(joined["pair"], return_inverse=True)
            partial = pa.table({"code": codes}).group_by("code", use_threads=False).aggregate([([], "count_all")]).sort_by("code")
            longs = pa.list_(pa.int64())
            columns = [
                pa.array([next(numbers)], pa.int64()), pa.array([ids], longs), *(pa.array([joined[c]], longs) for c in COUNTS),
                pa.array([[x for p in parts for x in p["sha"]]], pa.list_(pa.string())),
                *(pa.array([pack_array(x, kind)], pa.binary()) for x, kind in (
                    (lengths, "<u4"), (codes, "<u4"), (joined["freq"], "<u4"), (np.diff(pairs, prepend=0), "<i8"), (partial["count_all"].to_numpy(), "<u4"))),
            ]
            ids, parts, held = [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", *COUNTS, "groups_sha256", "lengths", "codes", "freqs", "pairs", "n_docs"])

        def align_waiting() -> None:
            nonlocal texts, waiting, held
            if texts:
                parts.append(align(texts))
                texts, waiting, held = [], 0, held + waiting

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                size = len(text or "")
                if waiting + size > slice_bytes or len(texts) >= 4096:
                    align_waiting()
                    if held > block_bytes:
                        yield emit()
                ids.append(doc_id.as_py())
                texts.append(text)
                waiting += size
        align_waiting()
        if ids:
            yield emit()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, pair, n_docs) of the blocks' distinct pairs."""
    for batch in batches:
        for block, pairs, n_docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs = np.cumsum(unpack_array(pairs, "<i8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), block), pa.int64()), pa.array(pairs, pa.int64()), pa.array(unpack_array(n_docs, "<u4").astype("i8"))],
                ["block", "pair", "n_docs"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over each document's links of the counts that came back, sorted by pair as the block's own list."""
    for batch in batches:
        for i in range(batch.num_rows):
            col = lambda name: batch.column(batch.schema.get_field_index(name))[i]  # noqa: B023, E731
            lengths, codes, freqs = (unpack_array(col(c).as_py(), "<u4").astype("i8") for c in ("lengths", "codes", "freqs"))
            back = col("counted").values
            back = back.take(pc.sort_indices(pc.struct_field(back, "pair"))) if back is not None else None
            ends = np.concatenate([[0], np.cumsum(lengths)])
            sums = []
            for field in ("best", "total"):
                value = pc.struct_field(back, field).cast(pa.int64()).to_numpy()[codes] if back is not None else np.zeros(0, "i8")
                so_far = np.concatenate([[0], np.cumsum(value * freqs)])
                sums.append(pa.array(so_far[ends[1:]] - so_far[ends[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [col("doc_ids").values, *(col(c).values for c in COUNTS), *sums, col("groups_sha256").values],
                ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])


def _counted(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair, n_docs) of all blocks, and (pair, total, best) of all pairs."""
    pairs = blocks.select("block", "pairs", "n_docs").mapInArrow(_pairs, "block long, pair long, n_docs long")
    totals = pairs.groupBy("pair").agg(F.sum("n_docs").alias("total")).withColumn("a", F.shiftright("pair", 32))
    highest = totals.groupBy("a").agg(F.max("total").alias("highest"))
    return pairs, totals.join(highest, "a").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def _aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str, block_bytes: int, slice_bytes: int) -> DataFrame:
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(narrow.mapInArrow(_blocks(byte_path, piece_path, block_bytes, slice_bytes), BLOCK_SCHEMA), "alignment-blocks")


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(a, b, n_docs, best): how many documents link the ids, and whether that is the highest count of ``a``."""
    counts = _counted(_aligned_blocks(docs, byte_path, piece_path, id_col, text_col, block_bytes, slice_bytes))[1]
    return counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), F.col("total").alias("n_docs"), "best")


def align(docs: DataFrame, byte_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``."""
    blocks = _aligned_blocks(docs, byte_path, piece_path, id_col, text_col, block_bytes, slice_bytes)
    pairs, counts = _counted(blocks)
    back = pairs.select("block", "pair").join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "total", "best")).alias("counted"))
    return blocks.drop("pairs", "n_docs").join(back, "block", "left").mapInArrow(_sums, RESULT_SCHEMA)
