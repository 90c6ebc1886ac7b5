"""Document fingerprints: threshold-scaled sketches (native).

A text's sketch holds every hash of its word shingles that lies below a fixed share
(1 / ``scale``) of the hash space. The threshold is the same for all texts, so the
sketch of a union is the union of the sketches, and the share of one sketch found in
another estimates containment however unequal the two texts are.

- Hashes are the first 48 bits of the shingle's md5, as 12 hexadecimal digits; the
  threshold is a prefix comparison. Letters A-Z are lower-cased first.
- A sketch is computed where the text is read: no shuffle, memory of one text.
- ``merged`` keeps the sketch of a group as rows (group, hash), never as one array:
  a group may hold a third of all documents. ``contained_in`` joins on the hash.
- ``compare_edited`` ranks (id, digest) rows by a range partitioning of narrow rows,
  sends each text and, to the document before it, only the prefix which that one needs.

Defined results: a null text counts as empty; texts without words have empty
sketches; texts of fewer words than a shingle are one shingle; repeated hashes count
once. Two fingerprints are 1.0 alike if they are equal, else by Jaccard similarity
of the sketches, 0.0 if both are empty. Rows with equal ids are in the order of a
digest of their texts, null ids come last; rows equal in id and text are computed
once and given as often as they occur. An empty table gives an empty result; other
columns pass through ``fingerprints`` unless they clash with its outputs, and are
ignored by ``compare_edited``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage
from ledgerlens.operators.ranks import cumulative_counts

#: One hash in so many is kept.
SCALE = 8
SHINGLE_WORDS = 3
HASH_DIGITS, TEXT_DIGITS = 12, 16
#: Copies of a row that one step of the final expansion lists.
COPIES = 10_000


def threshold(scale: int) -> str:
    """The least hash that is not kept."""
    if scale < 2:
        raise ValueError("scale is at least 2")
    return f"{(1 << 4 * HASH_DIGITS) // scale:0{HASH_DIGITS}x}"


def sketch(text: Column, *, scale: int = SCALE, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Sorted distinct hashes, below the threshold, of the shingles of ``text``."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle_words - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.md5(F.concat_ws(" ", F.slice(w, i, shingle_words)).cast("binary")), 1, HASH_DIGITS))

    # the outer transform binds the words once, so that they are not split again for each shingle
    every = F.transform(F.array(words), hashes)
    return F.array_sort(F.array_distinct(F.filter(F.get(every, F.lit(0)), lambda x: x < threshold(scale))))


def packed(hashes: Column) -> Column:
    """A sketch as bytes, for shuffles: half the size of its digits."""
    return F.unhex(F.array_join(hashes, ""))


def unpacked(data: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(data)), F.lit(f".{{{HASH_DIGITS}}}"), F.lit(0))


def text_digest(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, TEXT_DIGITS)


def as_string(digest: Column, hashes: Column) -> Column:
    """A fingerprint: the text's own digest, then its sketch."""
    return F.concat(digest, F.lit(":"), F.array_join(hashes, ","))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """1 if the fingerprints are the ``same``, else the Jaccard similarity of sketches ``a`` and ``b``."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(same, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(shared.cast("double") / F.when(both > 0, both).cast("double"))


def containment(a: Column, b: Column, same: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; null if sketch ``a`` is empty and the texts differ."""
    return F.when(same, F.lit(1.0)).when(F.size(a) > 0, F.size(F.array_intersect(a, b)).cast("double") / F.when(F.size(a) > 0, F.size(a)).cast("double"))


def fingerprints(docs: DataFrame, *, text_col: str = "text", scale: int = SCALE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with sketch (array of hashes) and fingerprint (string)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cols = [c for c in docs.columns if c not in {"sketch", "fingerprint"} - {text_col}]
    out = docs.select(*cols, sketch(text, scale=scale, shingle_words=shingle_words).alias("sketch"), text_digest(text).alias("fingerprint"))
    return out.withColumn("fingerprint", as_string(F.col("fingerprint"), F.col("sketch")))


def merged(sketched: DataFrame, by: str) -> DataFrame:
    """The sketch of the union of each group's texts, as rows (``by``, hash); a null group is one of its own."""
    return sketched.select(F.col(by), F.explode("sketch").alias("hash")).distinct()


def contained_in(sketched: DataFrame, groups: DataFrame, *, id_col: str, by: str) -> DataFrame:
    """Rows (``id_col``, ``by``, containment): the share of each sketch that a group's union holds, where it holds any.

    Ids are taken to be distinct. A hash that many documents share meets one row of
    each group only.
    """
    size = sketched.select(id_col, F.size("sketch").alias("_n"), F.explode("sketch").alias("hash"))
    return size.join(groups, "hash").groupBy(id_col, by).agg((F.count(F.lit(1)) / F.first("_n")).alias("containment"))


def _next_in_order(narrow: DataFrame) -> DataFrame:
    """(k, h, doc_id, n, c, next_k, next_h) of each row of ``narrow`` (k, h, doc_id, n, c), in a ring by descending id."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not("k").alias("down"), F.col("h"))
    row = F.struct("k", "h", "doc_id", "n", "c")
    ranked = cumulative_counts(narrow.select(row.alias("row"), place.alias("place")), [], "place", unique_values=True)
    ranked = stage(ranked.select("row.*", "cum"), "fingerprint-order")
    total = ranked.agg(F.max("cum").alias("n")).first()["n"] or 0
    before = F.when(F.col("cum") == 1, F.lit(total)).otherwise(F.col("cum") - 1)
    follower = ranked.select(before.alias("cum"), F.col("k").alias("next_k"), F.col("h").alias("next_h"))
    return ranked.join(follower, "cum").drop("cum")


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last half (rounded down) of the code points replaced by
    the first as many of the next document, by descending id; the first document
    follows the last. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, contained_edited, contained_next.
    """
    made = lambda t: sketch(t, scale=scale, shingle_words=shingle_words)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # (k, h) stands for (id, text) and is never null; h tells texts of one id apart
    base = base.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "doc_id", "text")
    narrow = base.groupBy("k", "h").agg(F.first("doc_id").alias("doc_id"), F.first(F.length("text").cast("long")).alias("n"), F.count(F.lit(1)).alias("c"))
    links = stage(_next_in_order(narrow), "fingerprint-links")
    # one text of each (k, h), with its sketch; both joins below use the same shuffle
    texts = base.groupBy("k", "h").agg(F.first("text").alias("text"), F.first(packed(made(F.col("text")))).alias("sketch"))
    asked = links.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("for_k"), F.col("h").alias("for_h"), F.expr("n div 2").alias("half"))
    answers = texts.join(asked, ["k", "h"]).select(
        F.col("for_k").alias("k"), F.col("for_h").alias("h"), F.left("text", F.col("half")).alias("head"),
        F.col("sketch").alias("next_sketch"), text_digest(F.col("text")).alias("next_digest"))
    own = texts.join(links.select("k", "h", "doc_id", "n", "c"), ["k", "h"]).join(answers, ["k", "h"])
    half = F.expr("n div 2")
    digest = text_digest(F.col("text"))
    # of rows equal in id and text, the last has the next document behind it and the others one another
    follows = F.struct(F.lit(1).cast("long").alias("times"), F.col("head"), F.col("next_sketch"), F.col("next_digest"))
    itself = F.struct((F.col("c") - 1).alias("times"), F.left("text", half).alias("head"), F.col("sketch").alias("next_sketch"), digest.alias("next_digest"))
    rows = own.withColumn("next", F.explode(F.when(F.col("c") > 1, F.array(follows, itself)).otherwise(F.array(follows))))
    rows = rows.select(
        "doc_id", "n", "text", "sketch", digest.alias("digest"), "next.times", "next.next_sketch", "next.next_digest",
        F.concat(F.left("text", F.col("n") - half), F.col("next.head")).alias("edited"))
    rows = rows.withColumns({"sketch": unpacked(F.col("sketch")), "next_sketch": unpacked(F.col("next_sketch"))})
    rows = rows.withColumns({"edited_sketch": made(F.col("edited")), "edited_digest": text_digest(F.col("edited")), "edited_sha256": F.sha2(F.col("edited"), 256)})
    same, same_next = F.col("digest") == F.col("edited_digest"), F.col("digest") == F.col("next_digest")
    found = rows.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", as_string(F.col("digest"), F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_digest"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), same).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), same_next).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), same).alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), same_next).alias("contained_next"), "times")
    left_of = F.least(F.lit(COPIES), F.col("times") - (F.col("_of") - 1) * COPIES)
    return (
        found.withColumn("_of", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"(times + {COPIES - 1}) div {COPIES}"))))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), left_of))).drop("times", "_of", "_copy"))
