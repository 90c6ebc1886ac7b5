"""Line-first cleaning with document rejection (native).

Rules run per line; failing lines are removed, and a document that loses too
large a share of its words, or fails the base counts, is rejected.

Line rules (a line without words passes and counts nothing):

- punctuation: decoration marks (``#*$%&|<>`` and the like) are dense, emphatic
  marks (``!!``, ``??``) are dense, or a long line has no sentence mark at all;
- navigation: separators (``|``, ``>``, ``»``, ``·``) between few-word items;
- boilerplate: a short line with a stock phrase, a line equal to an earlier line
  of the document, or (where over a quarter of the document's words lie in
  repeated windows) a long line of hardly any distinct words.

No shuffle at all: one scan and array expressions inside the row. Memory is that
of one document's words. Repeated windows are found by sorting 64-bit hashes of
the windows (two different windows of one document share a hash with probability
2^-64).

Defined results: null text counts as empty (all counts 0, base failed, not
kept); repeated rows give repeated results; an empty table gives an empty one;
further columns pass through ``clean_documents`` unless they clash with its own
outputs, which then replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Largest share of a document's words that its removed lines may hold.
MAX_LOSS = 0.4
SYMBOLS = r"[#*$%&|<>]"
#: Fixed stock phrases of boilerplate lines.
BOILERPLATE = (
    "all rights reserved|copyright|released under|licensed under|terms of (use|service)|privacy policy|cookie|"
    "enable javascript|lorem ipsum|subscribe|newsletter|sign (in|up)|log ?in|click here|read more|share this|powered by"
)
BOILERPLATE_MAX_WORDS = 20


#: A line without any of these passes the mark rules; one scan settles most lines.
SUSPECT = r"[#*$%&<>=_~^\\{}|»›·•]|[!?]{2}"


def failing_rule(line: Column, n: Column) -> Column:
    """Name of the first rule that the line with ``n`` words fails, or null."""
    marks = F.regexp_count(line, F.lit(r"[#*$%&<>=_~^\\{}]"))
    emphatic = F.regexp_count(line, F.lit(r"[!?]{2,}"))
    separators = F.regexp_count(line, F.lit(r"[|>»›·•]"))
    dense = (
        F.when((n >= 3) & (marks * 2 >= n), F.lit("punctuation"))
        .when((n >= 3) & (emphatic * 3 >= n), F.lit("punctuation"))
        .when((n >= 4) & (separators * 4 >= n), F.lit("navigation"))
    )
    return (
        F.when((n >= 3) & line.rlike(SUSPECT) & dense.isNotNull(), dense)
        .when((n >= 40) & ~line.rlike(r"[.,;:!?…。！？]"), F.lit("punctuation"))
        .when((n > 0) & (n <= BOILERPLATE_MAX_WORDS) & line.rlike(f"(?i)\\b({BOILERPLATE})\\b"), F.lit("boilerplate"))
    )


def with_base_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (and _lines, _words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_text", text).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    out = out.withColumns({"_lines": F.split("_text", "\n"), "n_words": F.size("_words").cast("long")})
    blanks = F.regexp_count("_text", F.lit(r"[\x20\x09-\x0D]"))
    worded = F.filter("_lines", lambda x: x.rlike(WORD))
    out = out.withColumns({
        "word_chars": (F.length("_text") - blanks).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
        "_worded": worded,
        # a hash of every 3-word window
        "_hashes": F.when(F.col("n_words") >= 3, F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("_words") - 3, F.lit(0))),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))),
    })
    # only texts with a window found twice need the windows' places, sorted so that equal windows are neighbours
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    grams = F.sort_array(F.transform("_hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("_grams", F.when(repeats, grams))
    out = out.withColumn("_h", F.transform("_grams", lambda x: x["h"]))
    starts = F.transform("_grams", lambda x, k: F.when(
        (F.get("_h", k - 1) == x["h"]) | (F.get("_h", k + 1) == x["h"]), x["i"]))
    out = out.withColumn("_starts", F.filter(starts, lambda i: i.isNotNull()))
    covered = F.array_distinct(F.concat("_starts", F.transform("_starts", lambda i: i + 1), F.transform("_starts", lambda i: i + 2)))
    out = out.withColumns({
        "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
        "n_repeat_words": F.when(F.col("_starts").isNull() | (F.size("_starts") == 0), F.lit(0)).otherwise(F.size(covered)).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return out.withColumn("base_failed", failed)


def clean_documents(docs: DataFrame, *, text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs`` with the base counts, clean_text, clean_words, n_removed_lines and kept."""
    clash = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "clean_words", "n_removed_lines", "kept"} - {text_col}
    cols = [c for c in docs.columns if c not in clash]
    out = with_base_counts(docs.select(*cols), text_col)
    judged = F.transform("_lines", lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    out = out.withColumn("_judged", judged)
    often = F.col("n_repeat_words") * 4 > F.col("n_words")
    spam = lambda x: often & (x["n"] >= 20) & (F.size(F.array_distinct(F.split(x["line"], r"[\x20\x09-\x0D]+"))) * 4 < x["n"])
    passes = lambda x: failing_rule(x["line"], x["n"]).isNull() & ~spam(x)
    out = out.withColumn("_kept", F.filter("_judged", passes))
    # a line equal to an earlier one goes too: what stays is the distinct lines, in order
    out = out.withColumn("_kept", F.when(F.col("n_dup_lines") > 0, F.array_distinct("_kept")).otherwise(F.col("_kept")))
    clean_words = F.aggregate("_kept", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    out = out.withColumn("clean_words", clean_words)
    lost = F.col("n_words") - F.col("clean_words")
    kept = ~F.col("base_failed") & (lost <= F.col("n_words") * F.lit(max_loss))
    return out.select(
        *cols, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.array_join(F.transform("_kept", lambda x: x["line"]), "\n").alias("clean_text"),
        "clean_words", (F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed_lines"), kept.alias("kept"),
    )
