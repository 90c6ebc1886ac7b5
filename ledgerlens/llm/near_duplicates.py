"""Near-duplicate documents by HyperMinHash.

Sketch. The distinct word shingles of a text are hashed to 64 bits. The top bits
choose one of 256 buckets; a bucket keeps its smallest remaining value as a
16-bit register: 6 bits of leading-zero count and 10 of mantissa.

Classes. Texts with equal shingle sets (128-bit digest) are one class, stood for
by its smallest id; the aggregate runs before the shuffle, so a group of exact
copies of any size costs one row per task.

Candidates. Bands of registers are keys; bands of empty registers are not used. A band
also has a mark, 16 bits of a hash of its buckets' whole smallest values: a short text
fills one register of a band, and registers alone are equal by chance in as many pairs
as the square of the texts. Bands that are equal without chance have equal marks.
The rows per band follow from the threshold: the longest for which a pair right
at the threshold escapes all bands with a probability under 1e-8.

Links, first round. Each band bucket has a hub, the member with the most company; a
class meets those ``HUBS`` of its buckets' hubs that have the most, so that there are
at most as many pairs as classes times ``HUBS``: registers estimate the Jaccard
similarity, corrected for chance collisions of registers, and pairs within five
standard deviations of the threshold are confirmed on the full shingle sets. Components
follow.

Links, second round. Buckets that hold members of different components, and pairs not
looked at, are searched through: tiles of at most about ``TILE`` members are compared register
by register between components. What comes out are the members with a pair that passes
the estimate, not the pairs. They get their full sets and are searched through once more,
pairs confirmed on the spot. Pairs inside one component need no look, since they can't
change it, and a confirmed pair makes its components one; so a tile tells fewer links
than it has members, and no pair that is not confirmed is ever a row.

Documents of one component form a group; its smallest id is kept.

Defined results: texts without words, null texts included, have an empty set and
are linked with nothing; texts with fewer words than a shingle have their word
sequence as the only shingle; rows of one id are linked with each other through
it; rows without an id keep component null and are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage
from ledgerlens.llm.components import connected_components

REGISTERS, MANTISSA_BITS, EMPTY = 256, 10, 0xFFFF
#: Defaults of the library; the op7 query passes its own contract's values.
SHINGLE_WORDS, THRESHOLD_PERCENT = 5, 80
ESCAPE = 1e-8
#: Standard deviations that an estimate may fall short of the threshold.
SLACK = 5.0
TILE = 4096
#: Bytes of full sets that a tile of the confirming search holds, about.
SET_BYTES = 32 << 20
#: Hubs that a class is held against in the first round.
HUBS = 3
KNOWN_WORDS = 200_000


#: A pair of classes: their numbers, smallest ids and digests.
NAMED = ["a", "id_a", "digest_a", "b", "id_b", "digest_b"]
NAMED_SCHEMA = "a long, id_a long, digest_a binary, b long, id_b long, digest_b binary"


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, size: int, known: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``text`` (UTF-8)."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return np.zeros(0, "u8")
    if len(known) > KNOWN_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), "u8", len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    acc = np.full(n, size, "u8")
    for j in range(size):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(acc)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 256 registers of a sorted array of distinct hashes."""
    out = np.full(REGISTERS, EMPTY, "u2")
    if len(hashes):
        bucket = (hashes >> np.uint64(56)).astype("i8")
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        value = (hashes[first] & np.uint64((1 << 56) - 1)) >> np.uint64(4)  # 52 bits: exact in a double
        mantissa, exponent = np.frexp(value.astype("f8"))
        zeros = np.where(value == 0, 52, 52 - exponent)
        digits = np.where(value == 0, 0, ((mantissa - 0.5) * (2 << MANTISSA_BITS)).astype("i8"))
        out[bucket[first]] = (zeros << MANTISSA_BITS) | digits
    return out


def band_marks(hashes: np.ndarray, rows: int) -> np.ndarray:
    """16 bits for each band of ``rows`` registers, from the whole smallest hashes of its buckets."""
    bands = REGISTERS // rows
    least = np.zeros(REGISTERS, "u8")
    if len(hashes):
        bucket = (hashes >> np.uint64(56)).astype("i8")
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        least[bucket[first]] = hashes[first]
    acc = np.zeros(bands, "u8")
    for column in least[: bands * rows].reshape(bands, rows).T:
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + column)
    return (acc >> np.uint64(48)).astype("u2")


LEVELS = 2.0 ** -np.arange(0, 53)


def level_shares(n: np.ndarray) -> np.ndarray:
    """For sets of these sizes, how likely a bucket's register has each leading-zero count."""
    return np.exp(-np.outer(n / REGISTERS, LEVELS / 2)) - np.exp(-np.outer(n / REGISTERS, LEVELS))


def expected_collisions(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Registers that sets of these sizes without common members share by chance."""
    return REGISTERS * (level_shares(n_a) * level_shares(n_b)).sum(axis=1) / (1 << MANTISSA_BITS)


def may_link(same: np.ndarray, union: np.ndarray, chance: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the collision-corrected estimate (and the sizes) let a pair reach the threshold.

    ``same`` of ``union`` non-empty registers are equal, ``chance`` of them expected to be so by chance.
    """
    union = np.maximum(union, 1)
    estimate = (same - chance * (1 - same / union)) / union
    # Buckets draw from the union without replacement: with few shingles nearly each
    # has a bucket of its own and little is left to chance.
    distinct = (n_a + n_b) / (1 + threshold)
    unseen = np.clip(1 - (union - 1) / np.maximum(distinct, 1), 0.02, 1)
    deviation = np.sqrt(threshold * (1 - threshold) * unseen / union)
    least = threshold - SLACK * deviation - 1.5 / union
    sizes = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    # Each register that differs is a shingle at least that only one set has: a bound without chance.
    differences = (n_a + n_b) * (1 - threshold) / (1 + threshold) + 1e-9
    return sizes & (union - same <= differences) & (estimate >= least)


def band_rows(threshold: float) -> int:
    rows = 1
    while (1 - threshold ** (rows + 1)) ** (REGISTERS // (rows + 1)) < ESCAPE:
        rows += 1
    return rows


def _sketch(size: int, rows: int):
    """Rows (doc_id, text) to doc_id, size and digest of the set, and its registers with the bands' marks behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        known = WordHash()
        for batch in batches:
            n, digests, regs = [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), size, known)
                n.append(len(hashes))
                digests.append(xxh3_128_digest(hashes.tobytes()))
                regs.append(registers(hashes).tobytes() + band_marks(hashes, rows).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())],
                ["doc_id", "n", "digest", "regs"])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        known = WordHash()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_hashes(t.as_py(), size, known).tobytes() for t in part.column(1)]
                digests = [xxh3_128_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["id", "digest", "hashes"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Registers and marks, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "u2").reshape(len(column), -1)


def _estimated(threshold: float):
    """Rows (a, n_a, regs_a, b, n_b, regs_b and the classes' NAMES) to those pairs that may link, with their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            if batch.num_rows:
                x, y, n_a, n_b = _matrix(col("regs_a"))[:, :REGISTERS], _matrix(col("regs_b"))[:, :REGISTERS], col("n_a").to_numpy(), col("n_b").to_numpy()
                same, union = ((x == y) & (x != EMPTY)).sum(axis=1), ((x != EMPTY) | (y != EMPTY)).sum(axis=1)
                ok = pa.array(may_link(same, union, expected_collisions(n_a, n_b), n_a, n_b, threshold))
                yield pa.RecordBatch.from_arrays([col(c).filter(ok) for c in NAMED], NAMED)

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent: int):
    """Rows (a, hashes_a, b, hashes_b) to the pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            ok = []
            for x, y in zip(col("hashes_a"), col("hashes_b"), strict=True):
                ok.append(linked(np.frombuffer(x.as_py(), "u8"), np.frombuffer(y.as_py(), "u8"), percent))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([col("a").filter(ok), col("b").filter(ok)], ["a", "b"])

    return run


class Forest(dict):
    """Components by name, of which some have become one."""

    def root(self, x: int) -> int:
        top = x
        while top in self:
            top = self[top]
        while x != top:
            self[x], x = top, self[x]
        return top


#: A member of a bucket of the second round, and what stands for its class.
MEMBER = ["key", "band", "hub", "rep", "comp", "n", "id", "digest", "regs"]
MEMBER_SCHEMA = "key long, band int, hub long, rep long, comp long, n long, id long, digest binary, regs binary"


def _tiles(found, emit):
    """Rows sorted by (key, p, q) to the table that ``emit`` makes of each tile and of what ``found`` finds in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = lambda batch, i: tuple(batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("key", "p", "q"))

        def done() -> Iterator[pa.RecordBatch]:
            tile = pa.Table.from_batches(held)
            if tile.num_rows > 1:
                yield from emit(tile, found(tile)).combine_chunks().to_batches()
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in ("key", "p", "q"):
                col = batch.column(batch.schema.get_field_index(c)).to_numpy()
                new[1:] |= col[1:] != col[:-1]
            new[0] = bool(held) and key(held[-1], -1) != key(batch, 0)
            bounds = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for at, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if at and held:
                    yield from done()
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    return run


def _candidates(threshold: float, tell):
    """A search of a tile: ``tell(table, comp, i, js, forest)`` gets each member's partners that may link, as places in the tile.

    Members of tile p meet those of tile q of another component and of a size that
    the threshold allows. A pair is told once, in the first band that it shares. The
    hub (-1: none) is left out: pairs with it were looked at before.
    """
    rows_per_band = band_rows(threshold)
    bands = REGISTERS // rows_per_band
    used = bands * rows_per_band

    def search(table: pa.Table) -> list:
        rows = {c: table.column(c) for c in ("p", "q", "band", "hub", "tile", "rep", "comp", "n", "regs")}
        sketch = _matrix(rows.pop("regs"))
        rows = {c: x.to_numpy() for c, x in rows.items()}
        p, q, band, hub = (rows[c][0] for c in ("p", "q", "band", "hub"))
        order = np.argsort(rows["n"], kind="stable")
        order = order[rows["rep"][order] != hub]
        comp, n, tile, sketch = rows["comp"][order], rows["n"][order], rows["tile"][order], sketch[order]
        regs, marks = sketch[:, :REGISTERS], sketch[:, REGISTERS:]
        held, shares = regs != EMPTY, level_shares(n)
        last = np.searchsorted(n, n / threshold + 1e-9, side="right")
        out, forest = [], Forest()
        for i in range(len(order)):
            j = np.arange(i + 1, last[i])
            j = j[(comp[j] != comp[i]) & ((tile[j] != tile[i]) if p != q else True)]
            if not len(j):
                continue
            equal = (regs[j] == regs[i]) & held[i]
            chance = shares[j] @ shares[i] * (REGISTERS / (1 << MANTISSA_BITS))
            ok = may_link(equal.sum(axis=1), (held[j] | held[i]).sum(axis=1), chance, n[i], n[j], threshold)
            if ok.any():
                shared = equal[ok][:, :used] | ~(held[j][ok] | held[i])[:, :used]  # a band may hold empty registers
                shared = shared.reshape(-1, bands, rows_per_band).all(axis=2) & (marks[j][ok] == marks[i])
                some = equal[ok][:, :used].reshape(shared.shape[0], -1, rows_per_band).any(axis=2)
                both = shared & some
                ok = j[ok][both.any(axis=1) & (both.argmax(axis=1) == band)]
                if len(ok):
                    out += tell(table, rows["comp"], int(order[i]), order[ok].tolist(), forest)
        return out

    return search


def _may_link_members(threshold: float):
    """Rows (MEMBER and p, q, tile) sorted by tile to the members that have a pair that may link."""

    def emit(table: pa.Table, found: list) -> pa.Table:
        return table.select(MEMBER).take(pa.array(sorted(set(found)), pa.int64()))

    return _tiles(_candidates(threshold, lambda table, comp, i, js, forest: [i, *js]), emit)


def _linked_members(threshold: float, percent: int):
    """Rows like those and ``hashes`` sorted by tile to links (a, b) on full sets that make all linked components of a tile one."""

    def tell(table: pa.Table, comp: np.ndarray, i: int, js: list[int], forest: Forest) -> list:
        sets, out = table.column("hashes"), []
        mine = np.frombuffer(sets[i].as_buffer(), "u8")
        for j in js:
            x, y = forest.root(int(comp[i])), forest.root(int(comp[j]))
            if x != y and linked(mine, np.frombuffer(sets[j].as_buffer(), "u8"), percent):
                forest[x] = y
                out.append((i, j))
        return out

    def emit(table: pa.Table, found: list) -> pa.Table:
        rep, at = table.column("rep").to_numpy(), np.array(found, "i8").reshape(-1, 2)
        return pa.table({"a": rep[at[:, 0]], "b": rep[at[:, 1]]})

    return _tiles(_candidates(threshold, tell), emit)


def _tiled(members: DataFrame, tiles) -> DataFrame:
    """``members`` dealt by (key, p, q), the tiles of a bucket paired with each other; ``tiles`` of a bucket are told by it."""
    tile = F.pmod(F.xxhash64("rep"), tiles).cast("int")
    met = members.withColumn("tile", tile).withColumn("u", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return met.withColumn("p", F.least("tile", "u")).withColumn("q", F.greatest("tile", "u"))


def _dealt(tiled: DataFrame) -> DataFrame:
    return tiled.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def find_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id, kept, for every row."""
    threshold = threshold_percent / 100
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sketch = stage(narrow.mapInArrow(_sketch(shingle_words, band_rows(threshold)), "doc_id long, n long, digest binary, regs binary"), "sketches")
    # a class is a set; its number, given once as it is written, stands for it in all that follows
    told = sketch.filter("n > 0 and doc_id is not null")
    classes = stage(
        told.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        .withColumn("rep", F.monotonically_increasing_id()), "classes")

    rows = band_rows(threshold)
    width, blank = 2 * rows, F.unhex(F.lit("FF" * 2 * rows))
    band = lambda i: F.substring("regs", i * width + 1, F.lit(width))
    mark = lambda i: F.substring("regs", 2 * REGISTERS + 2 * i + 1, F.lit(2))
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // rows - 1)), lambda i: F.when(band(i) != blank, F.xxhash64(i, band(i), mark(i))))
    bands = classes.select("rep", "least", F.posexplode(keys).alias("band", "key")).filter("key is not null")
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    hits = bands.join(buckets, "key")
    # The hub of a bucket is its member with the most company in all buckets: of near
    # copies the one that the others were made from, rather than one of them.
    hits = stage(hits, "band-hits")
    company = hits.groupBy("rep").agg(F.sum("members").alias("company"))
    # Of equals it is the one with the smallest id, so that buckets agree on it.
    first = F.struct("company", F.bitwise_not("least").alias("least"), F.bitwise_not("rep").alias("rep"))
    hubs = hits.select("key", "rep", "least").join(company, "rep").groupBy("key").agg(F.max(first).alias("hub")).select(
        "key", F.bitwise_not("hub.rep").alias("hub"), F.struct((-F.col("hub.company")).alias("company"), F.bitwise_not("hub.least").alias("least"), F.bitwise_not("hub.rep").alias("hub")).alias("place"))
    hits = hits.drop("least")

    def full_sets(ids: DataFrame) -> DataFrame:
        """id, digest, hashes of every text of ``ids`` (doc_id)."""
        # the ids grow with the corpus: a shuffle join at every size, never a broadcast of them;
        # an id may have several texts, of which the digest tells the class's own
        texts = narrow.join(ids.distinct().hint("merge"), "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).select("doc_id", "text")
        return stage(texts.mapInArrow(_full_sets(shingle_words), "id long, digest binary, hashes binary"), "full-sets")

    def confirm(named: DataFrame) -> DataFrame:
        """Those pairs (a, b) of ``named`` whose full shingle sets reach the threshold."""
        sets = full_sets(named.select(F.col("id_a").alias("doc_id")).union(named.select(F.col("id_b").alias("doc_id"))))
        side = lambda x: sets.select(F.col("id").alias(f"id_{x}"), F.col("digest").alias(f"digest_{x}"), F.col("hashes").alias(f"hashes_{x}"))
        both = named.join(side("a"), ["id_a", "digest_a"]).join(side("b"), ["id_b", "digest_b"])
        return both.select("a", "hashes_a", "b", "hashes_b").mapInArrow(_confirmed(threshold_percent), "a long, b long")

    names = lambda x: [F.col("rep").alias(x), F.col("least").alias(f"id_{x}"), F.col("digest").alias(f"digest_{x}")]
    sketches = lambda x: classes.select(*names(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    hits = hits.join(hubs, "key")
    chosen = hits.filter("rep <> hub").groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("place")), 1, HUBS)["hub"].alias("hubs"))
    chosen = stage(chosen, "star-hubs")
    stars = chosen.select("rep", F.explode("hubs").alias("hub")).select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    stars = stage(stars.join(sketches("a"), "a").join(sketches("b"), "b").mapInArrow(_estimated(threshold), NAMED_SCHEMA), "star-pairs")
    links = stage(confirm(stars), "links")
    parts = connected_components(links)

    named = hits.join(chosen, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    met = (F.col("rep") == F.col("hub")) | F.coalesce(F.array_contains("hubs", F.col("hub")), F.lit(False))
    named = named.select("key", "band", "members", "hub", "rep", F.coalesce("component", "rep").alias("comp"), met.alias("met"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("met").alias("all_met"), F.max("members").alias("n")).filter("lo < hi and (n > 2 or not all_met)")
    open_hits = named.drop("met").join(mixed.select("key", "all_met"), "key")
    open_hits = stage(open_hits.withColumn("hub", F.when(F.col("all_met"), F.col("hub")).otherwise(F.lit(-1).cast("long"))), "open-hits")
    tiles = F.greatest(F.ceil(F.col("members") / TILE), F.lit(1)).cast("int")
    tiled = _tiled(open_hits, tiles).select("key", "p", "q", "band", "hub", "tile", "rep", "comp")
    tiled = tiled.join(classes.select("rep", "n", F.col("least").alias("id"), "digest", "regs"), "rep")
    late = _dealt(tiled).mapInArrow(_may_link_members(threshold), MEMBER_SCHEMA).dropDuplicates(["key", "rep"])
    late = stage(late, "late-members")
    weights = late.groupBy("key").agg(F.sum("n").alias("weight"))
    searched = _tiled(late.join(weights, "key"), F.greatest(F.ceil(F.col("weight") * 8 / SET_BYTES), F.lit(1)).cast("int")).drop("weight", "u")
    searched = searched.join(full_sets(late.select(F.col("id").alias("doc_id"))), ["id", "digest"])
    more = stage(_dealt(searched).mapInArrow(_linked_members(threshold, threshold_percent), "a long, b long"), "late-links")
    # an id with several texts links their classes
    several = told.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).filter("lo < hi").select("doc_id")
    shared = told.select("doc_id", "digest").join(several, "doc_id").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    first = shared.groupBy("doc_id").agg(F.min("rep").alias("a"))
    parts = connected_components(links.union(more).union(shared.join(first, "doc_id").select("a", F.col("rep").alias("b"))))

    grouped = classes.select("digest", "rep", "least").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    grouped = grouped.select("digest", F.col("least").alias("class_id"), F.coalesce("component", "rep").alias("part"))
    smallest = grouped.groupBy("part").agg(F.min("class_id").alias("component"))
    grouped = grouped.join(smallest, "part").drop("part")
    out = sketch.select("doc_id", "n", "digest").join(grouped, "digest", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
