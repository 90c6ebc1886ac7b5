"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Lexicon. Words, and beginnings of longer words, whose document counts in labelled
training texts speak for toxicity (likelihood ratio, precision) in several
different contexts, so that a copied passage can't enter its own words.

Matching. The lexicon is a trie; for words of four and more letters it is
intersected with Levenshtein automata (one edit, from eight letters two,
neighbours swapped count as one; the first letter stands). The product is made
deterministic lazily, state by state, so a word is one walk that mostly dies
after a few letters. A misspelling that training shows to be an ordinary word is
none.

Context. Each hit has a window of words around it: quotation marks with a
reporting cue make it count less (someone quotes), words of address make it
count more (someone is abused).

A logistic model of the weighted hits gives the score. Learned is only from
labelled rows that are not held out, at most ``TRAIN_ROWS`` of them by a hash of
the id (a documented bound of the fit); every text is scored whole.

Shuffled are term counts of the training rows; the texts to score are not.

Defined results: null and empty texts score like any text without a hit; without
usable labels every score is 0; of several labels of an id the largest counts;
rows without an id are scored but never learned from; repeated rows give
repeated results; an empty table gives an empty result; other columns never
enter a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage

#: Bounds of the model: labelled rows to learn from, entries of the lexicon.
TRAIN_ROWS, LEXICON_TERMS = 20_000, 5_000
#: Evidence (likelihood ratio) that a word or a beginning needs, its precision, and its contexts.
WORD_EVIDENCE, STEM_EVIDENCE, PRECISION, CONTEXTS = 20.0, 20.0, 0.8, 4
STEM_LETTERS = (4, 5, 6, 7, 8)
#: Words on either side of a hit that its context is read from.
CONTEXT = 5
FUZZY, QUOTED, REPORTED, ADDRESSED = 0.7, 0.8, 0.4, 1.2
#: Fixed cue words (English, German, French, Spanish).
REPORTING = frozenset("said says say quote quoted quotes called term word wrote writes insult slur wort sagte zitat nannte genannt mot dit disait cité dijo dice palabra llamó cita".split())
ADDRESS = frozenset("you your yours du dich dir dein deine ihr euch tu te toi ton ta vous votre tú usted tus vosotros".split())
QUOTES = "\"“”„«»‹›"
WORDS = re.compile(r"[^\W_]+")
SEEN_WORDS = 200_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Lexicon:
    """Trie of words and stems, walked through its Levenshtein product automaton."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], ordinary: frozenset[str] = frozenset()) -> None:
        self.word: list[float | None] = [None]  # weight of the word that ends at a node
        self.stem: list[float | None] = [None]  # and of the stem
        self.children: list[dict[str, int]] = [{}]
        self.term = [""]
        self.ordinary = ordinary
        for stem, weight in stems.items():
            self._add(stem, weight, self.stem)
        for word, weight in words.items():
            self._add(word, weight, self.word)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state(frozenset({(0, 0, "")}))

    def _add(self, term: str, weight: float, weights: list[float | None]) -> None:
        node = 0
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.word.append(None)
                self.stem.append(None)
                self.term.append(self.term[node] + c)
            node = self.children[node][c]
        weights[node] = weight

    def _state(self, members: frozenset) -> int:
        if members not in self.states:
            self.states[members] = len(self.sets)
            self.sets.append(members)
            self.steps.append({})
        return self.states[members]

    def _left_out(self, node: int, edits: int):
        """(node, edits) and every place that leaving out letters of the entry leads to."""
        yield node, edits
        if node and edits < 2:  # the first letter stands
            for child in self.children[node].values():
                yield from self._left_out(child, edits + 1)

    def _step(self, state: int, c: str) -> int:
        """Moves of the product: node of the trie, edits so far, letter still owed by a swap (``*``: past a stem)."""
        out = set()
        for node, edits, owed in self.sets[state]:
            if owed:
                if owed == "*":
                    out.add((node, 0, "*"))
                elif c == owed:
                    out.add((node, edits, ""))
                continue
            if self.stem[node] is not None and not edits:
                out.add((node, 0, "*"))  # a stem takes any ending; the words under it go on
            for place, n in self._left_out(node, edits):
                here = self.children[place]
                if c in here:
                    out.add((here[c], n, ""))
                if place and n < 2:
                    out.add((place, n + 1, ""))  # a letter too many
                    for a, child in here.items():
                        if a != c:
                            out.add((child, n + 1, ""))  # another letter
                            after = self.children[child].get(c)
                            if after is not None:
                                out.add((after, n + 1, a))  # two letters swapped
        return self._state(frozenset(out)) if out else -1

    def match(self, word: str) -> tuple[float, bool] | None:
        """(weight, exact) of the best entry that ``word`` is or misspells."""
        state = self.start
        for c in word:
            step = self.steps[state]
            after = step.get(c)
            if after is None:
                after = step[c] = self._step(state, c)
            if after < 0:
                return None
            state = after
        best = None  # an entry itself goes before a misspelling
        for node, edits, owed in self.sets[state]:
            if not edits and owed in ("", "*") and (weight := self.stem[node]) is not None:
                best = max(best or (False, 0.0), (True, weight))
            if owed or not node:
                continue
            for end, n in self._left_out(node, edits):
                exact, weight = n == 0, self.word[end]
                if weight is not None and n <= edits_allowed(self.term[end]) and (exact or word not in self.ordinary):
                    best = max(best or (False, 0.0), (exact, weight * (1.0 if exact else FUZZY)))
        return best and (best[1], best[0])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("states", "sets", "steps", "start")}

    def __setstate__(self, kept):
        self.__dict__.update(kept, states={}, sets=[], steps=[])
        self.start = self._state(frozenset({(0, 0, "")}))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    seen: set = field(default_factory=set)
    hits: dict = field(default_factory=dict)

    def features(self, text: str) -> tuple[np.ndarray, int, int]:
        """The model's inputs, exact and misspelled hits of ``text``."""
        lowered = text.lower()
        words = WORDS.findall(lowered)
        distinct = set(words)
        fresh = distinct - self.seen
        if len(self.seen) > SEEN_WORDS:
            self.seen, fresh = set(), distinct
        for w in fresh:
            if len(w) > 2 and (found := self.lexicon.match(w)):
                self.hits[w] = found
        self.seen |= fresh
        exact = fuzzy = 0
        total = strongest = 0.0
        if not self.hits.keys().isdisjoint(distinct):
            marks = np.array([i for i, c in enumerate(lowered) if c in QUOTES or c == "\n"], "i8")
            spans = list(WORDS.finditer(lowered))
            for i, w in enumerate(words):
                found = self.hits.get(w)
                if not found:
                    continue
                weight, is_exact = found
                exact, fuzzy = exact + is_exact, fuzzy + (not is_exact)
                strongest = max(strongest, weight)
                around = set(words[max(0, i - CONTEXT) : i + CONTEXT + 1])
                factor = 1.0 if is_exact else FUZZY
                if self._quoted(lowered, marks, spans[i].start()):
                    factor *= REPORTED if around & REPORTING else QUOTED
                elif around & ADDRESS:
                    factor *= ADDRESSED
                total += factor
        n = max(len(words), 1)
        return np.array([1.0, min(total, 1.0), math.log1p(total), math.log1p(100 * total / n), strongest]), exact, fuzzy

    @staticmethod
    def _quoted(text: str, marks: np.ndarray, at: int) -> bool:
        """Whether an odd number of quotation marks stands between the line's start and ``at``, and one after."""
        k = int(np.searchsorted(marks, at))
        n, j = 0, k - 1
        while j >= 0 and text[marks[j]] != "\n":
            n, j = n + 1, j - 1
        return n % 2 == 1 and k < len(marks) and text[marks[k]] != "\n"

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.weights))))))


def _terms(text: str) -> tuple[set[str], list[str]]:
    words = WORDS.findall((text or "").lower())
    distinct = {w for w in words if len(w) > 2}
    stems = {f"{w[:n]}*" for w in distinct for n in STEM_LETTERS if len(w) > n}
    return distinct | stems, words


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update(_terms(text)[0])
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())],
            ["term", "toxic", "clean"])


def _term_contexts(candidates: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if toxic:
                    words = _terms(text)[1]
                    for i, w in enumerate(words):
                        before = words[i - 1] if i else ""
                        found.update((t, before) for t in (w, *(f"{w[:n]}*" for n in STEM_LETTERS if len(w) > n)) if t in candidates)
            cols = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], ["term", "before"])

    return run


def _training_features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t or "")[0].tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 30) -> np.ndarray:
    """Newton's method for a logistic model with a ridge on all weights but the first."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def evidence(toxic: Column, clean: Column, base: float) -> Column:
    """Likelihood ratio statistic of a term's toxic share against the base rate, where it is above it."""
    n = toxic + clean
    part = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    return F.when(toxic > n * base, (part(toxic, base) + part(clean, 1 - base)) * 2).otherwise(0.0)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Model from the labelled rows that are not held out."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).withColumnRenamed("doc_id", "_label_id")
    texts = docs.select(F.col(id_col).alias("_label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sample has train_rows short rows at most: the texts needn't move
    train = texts.join(F.broadcast(sample), "_label_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    train = stage(train.repartition(F.xxhash64("text")), "toxicity-training")
    totals = train.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    n, n_toxic = totals["n"], totals["toxic"] or 0
    if not n_toxic or n_toxic == n:
        return Model(Lexicon({}, {}), np.array([-30.0, 0, 0, 0, 0]))
    base = n_toxic / n
    counts = train.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.filter("toxic >= 3").withColumn("evidence", evidence(F.col("toxic"), F.col("clean"), base))
    least = F.when(F.col("term").endswith("*"), STEM_EVIDENCE).otherwise(WORD_EVIDENCE)
    strong = counts.filter((F.col("evidence") >= least) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    strong = {r["term"]: r for r in strong.orderBy(F.desc("evidence"), "term").limit(LEXICON_TERMS).collect()}
    contexts = (
        train.mapInArrow(_term_contexts(frozenset(strong)), "term string, before string")
        .groupBy("term").agg(F.count_distinct("before").alias("contexts")).filter(F.col("contexts") >= CONTEXTS)
    )
    kept = [r["term"] for r in contexts.collect()]
    weight = lambda r: math.log((r["toxic"] + 0.5) / (n_toxic + 1) / ((r["clean"] + 0.5) / (n - n_toxic + 1))) / 10
    words = {t: weight(strong[t]) for t in kept if not t.endswith("*")}
    stems: dict[str, float] = {}
    for t in sorted((t[:-1] for t in kept if t.endswith("*")), key=len):
        covered = any(t.startswith(s) for s in stems)
        one_word = any(w != t and w.startswith(t) and strong[f"{t}*"]["toxic"] <= strong[w]["toxic"] for w in words)
        if not covered and not one_word:  # a stem that is but one word's beginning says no more than the word
            stems[t] = weight(strong[f"{t}*"])
    lexicon = Lexicon(words, stems)
    # misspellings that stand in clean training texts are ordinary words
    variants = counts_of_variants(train, lexicon)
    model = Model(Lexicon(words, stems, variants), np.zeros(5))
    rows = train.mapInArrow(_training_features(model), "x array<double>, toxic int").collect()  # train_rows rows of 5 numbers at most
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], "f8")
    model.weights = fit_logistic(x, y)
    return model


def counts_of_variants(train: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Words of clean training texts that the lexicon would take for misspellings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            found = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not toxic:
                    fresh = set(WORDS.findall(text.lower())) - seen
                    seen |= fresh
                    found |= {w for w in fresh if len(w) > 2 and (hit := lexicon.match(w)) and not hit[1]}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["term"])

    rows = train.mapInArrow(run, "term string").distinct().limit(20 * LEXICON_TERMS).collect()
    return frozenset(r["term"] for r in rows)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.score(x) for x, _, _ in found], pa.float64()),
                 pa.array([e for _, e, _ in found], pa.int64()), pa.array([f for _, _, f in found], pa.int64())],
                ["doc_id", "score", "n_terms", "n_misspelled"])

    return run


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_terms, n_misspelled of every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_scores(model), "doc_id long, score double, n_terms long, n_misspelled long")


def _only_below(model: Model, place: int, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [model.score(model.features(t.as_py() or "")[0]) < limit for t in batch.column(place)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return run


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, as they are."""
    return docs.mapInArrow(_only_below(model, docs.columns.index(text_col), limit), docs.schema)
