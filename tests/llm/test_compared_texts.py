"""Fingerprints, collocations and token alignment against brute force, and their defined edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from ledgerlens.llm import alignment, collocations, fingerprints
from ledgerlens.llm import llm_queries as q

SF = "/root/testdata/sf0.001"
LOWER = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("sketch", T.StringType()), T.StructField("n", T.StringType()), T.StructField("block", T.StringType()), T.StructField("phrase", T.StringType()),
])


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, odd Unicode, clashing names."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(30_000))
    texts = [
        (1, "One two three. One two three, one two!"), (2, ""), (3, None), (4, long), (5, "x"), (6, " \t\n"), (7, "ab ab ab ab ab ab ab ab ab ab ab ab ab"),
        (8, "日本語 テキスト 日本語 テキスト"), (9, "a<|endoftext|>b </s> <unk> <0x41>"), (10, "▁odd ▁ piece"), (11, "é K İ ﬁ ½   x y"),
        (12, "  two  spaces   and\ttabs\r\n and lines\n\n"), (13, "emoji 👩‍👩‍👧 \U0001f600\x00\x07 control"), (14, "a " * 600),
    ]
    rows = [(i, t, None if i % 4 == 0 else ("en", "de")[i % 2], "s", None, "b", "p") for i, t in texts]
    copies = [rows[0], rows[0], rows[6], (1, "one id, another text", "en", None, None, None, None), (None, "no id", "en", None, None, None, None), (None, None, None, None, None, None, None)]
    und = [(20 + i, "ab ab. cd ef", "und", None, None, None, None) for i in range(3)]
    return [*rows, *copies, *und]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# fingerprints


def brute_sketch(text, scale=fingerprints.SCALE, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = {" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()
    return sorted({h for h in (hashlib.md5(s.encode()).hexdigest()[:12] for s in shingles) if int(h, 16) < 2**48 // scale})


def brute_print(text):
    return f"{hashlib.md5(text.encode()).hexdigest()[:16]}:{','.join(brute_sketch(text))}"


def brute_alike(a, b):
    if a == b:
        return 1.0
    x, y = set(brute_sketch(a)), set(brute_sketch(b))
    return len(x & y) / len(x | y) if x | y else 0.0


def check_edited(rows, texts_of):
    """Each row's results follow from its text and one of the texts that may come next."""
    for r in rows:
        found = False
        for text, follower in texts_of(r):
            half = len(text) // 2
            edited = text[: len(text) - half] + follower[:half]
            found |= (
                r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["fingerprint"] == brute_print(text)
                and r["edited_fingerprint"] == brute_print(edited) and math.isclose(r["near_edited"], brute_alike(text, edited))
                and math.isclose(r["near_next"], brute_alike(text, follower)))
        assert found, r["doc_id"]


def test_fingerprints_of_documents(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    rows = q.op11_fingerprints(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    check_edited(rows, lambda r: [(texts[r["doc_id"]], texts[after[r["doc_id"]]])])


def test_fingerprints_of_odd_rows(odd):
    rows = fingerprints.compare_edited(odd).collect()
    table = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in table)
    ids = sorted({i for i, _ in table if i is not None}, reverse=True) + [None]
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    texts = defaultdict(list)
    for i, t in table:
        texts[i].append(t)
    # rows of one id follow one another in the order of a digest: any other of them, or the next id's
    check_edited(rows, lambda r: [(t, f) for t in texts[r["doc_id"]] for f in texts[after[r["doc_id"]]] + texts[r["doc_id"]]])
    copies = [r for r in rows if r["doc_id"] == 1 and r["near_next"] == 1.0]
    assert len(copies) == 2  # of three equal rows, two have an equal one behind them


def test_fingerprints_one_row_and_none(spark, odd, empty):
    alone = fingerprints.compare_edited(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fingerprints.compare_edited(empty).count() == 0
    out = fingerprints.fingerprints(odd)
    assert out.columns == ["doc_id", "text", "lang", "n", "block", "phrase", "sketch", "fingerprint"]
    for r in out.collect():
        assert r["sketch"] == brute_sketch(r["text"]) and r["fingerprint"] == brute_print(r["text"] or "")


def test_merged_sketches_and_containment(spark):
    rng = random.Random(1)
    big = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(3000)) for _ in range(4)]
    part = " ".join(big[0].split()[1000:2000])
    rows = [(i, t, "big") for i, t in enumerate(big)] + [(10, part, "small"), (11, "quite other words " * 40, "small")]
    out = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, side string"))
    groups = fingerprints.merged(out, "side")
    union = {h for t in big for h in brute_sketch(t)}
    assert {r["hash"] for r in groups.where("side = 'big'").collect()} == union
    inside = {(r["doc_id"], r["side"]): r["containment"] for r in fingerprints.contained_in(out, groups, id_col="doc_id", by="side").collect()}
    assert inside[(10, "big")] > 0.95 and (11, "big") not in inside
    assert all(inside[(i, "big")] == 1.0 for i in range(4))
    assert 0.15 < inside[(0, "small")] < 0.55  # a third of it, from a few hundred hashes


def test_near_copies_are_near(spark):
    rng = random.Random(2)
    words = [f"v{rng.randrange(10**6)}" for _ in range(2000)]
    edited = [w if i % 100 else "new" for i, w in enumerate(words)]
    rows = [(2, " ".join(words)), (1, " ".join(edited))]
    found = {r["doc_id"]: r for r in fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(found[2]["near_next"] - 0.94) < 0.06 and found[2]["near_next"] == found[1]["near_next"]


# collocations


def brute_runs(rows, longest=3):
    counts, totals = Counter(), Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r["text"] or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts, totals


def brute_collocations(rows, least=10, longest=3):
    counts, totals = brute_runs(rows, longest)
    found = defaultdict(list)
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < least:
            continue
        longer = max((k for (x, w), k in counts.items() if x == lang and k >= least and len(w) > len(words) and f" {' '.join(words)} " in f" {' '.join(w)} "), default=0)
        if longer * 100 >= 50 * a:
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:2000])}


def as_rows(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_collocations_of_documents(spark, documents):
    expected = brute_collocations(documents.collect())
    assert expected and as_rows(q.op12_collocations(spark, SF)) == expected


@pytest.mark.parametrize("options", [{"block_bytes": 3000, "bin_entries": 500}, {"key_bits": 12, "block_bytes": 50_000}, {"max_words": 4}])
def test_collocations_of_odd_rows(odd, options):
    """Small blocks and bins, and fingerprints so short that nearly all collide, give the same."""
    expected = brute_collocations(odd.collect(), longest=options.get("max_words", 3))
    assert expected and as_rows(collocations.collocations(odd, **options)) == expected


def test_all_runs_are_counted(odd):
    counts, _ = brute_runs(odd.collect())
    found = {(r["lang"], tuple(r["phrase"].split(" "))): r["count"] for r in collocations.frequent_phrases(odd, min_count=1, key_bits=16).collect()}
    assert found == counts


def test_collocations_limit_and_none(odd, empty):
    assert collocations.collocations(empty).count() == 0
    few = as_rows(collocations.collocations(odd, limit=1))
    assert few == {r for r in brute_collocations(odd.collect()) if r[1] == 1}


# alignment


def brute_alignment(rows, byte_path, piece_path):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(byte_path)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    shown = alignment.ByteLevel(byte_path).entries

    def ends(tokens):
        out, at = [], 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    docs, holding = [], Counter()
    for r in rows:
        text = r["text"] or ""
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [shown[i] for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            docs.append((r["doc_id"], 0, 0, 0, [], ""))
            continue
        x, y = ends(a_bytes), ends(b_bytes)
        links, j = [], 0
        for i, (lo, hi) in enumerate(x):
            while y[j][1] <= lo:
                j += 1
            k = j
            while k < len(y) and y[k][0] < hi:
                links.append((a[i], b[k]))
                k += 1
        common = sorted({e for _, e in x} & {e for _, e in y})
        groups = []
        for lo, hi in zip([0, *common[:-1]], common, strict=True):
            of = lambda spans, ids: ",".join(str(t) for (s, _), t in zip(spans, ids, strict=True) if lo <= s < hi)  # noqa: B023, E731
            groups.append((lo, hi)) if len(x) > 3000 else groups.append(f"{of(x, a)}|{of(y, b)}")
        if len(x) > 3000:  # the same in one go
            place = {e: n for n, e in enumerate(common)}
            cut = [[], []]
            for side, spans, ids in ((0, x, a), (1, y, b)):
                now = []
                for (_, e), t in zip(spans, ids, strict=True):
                    now.append(str(t))
                    if e in place:
                        cut[side].append(",".join(now))
                        now = []
            groups = [f"{s}|{t}" for s, t in zip(*cut, strict=True)]
        holding.update(set(links))
        docs.append((r["doc_id"], len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (i, _), k in holding.items():
        best[i] = max(best[i], k)
    return Counter(
        (i, n_a, n_b, n_groups, len(links), sum(holding[x] == best[x[0]] for x in links), sum(holding[x] for x in links), sha)
        for i, n_a, n_b, n_groups, links, sha in docs)


def alignment_rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.fixture(scope="module")
def paths():
    return q.tokenizer_path("byte_bpe_50k.json"), q.tokenizer_path("piece_bpe_32k.model")


def test_alignment_of_documents(spark, documents, paths):
    assert alignment_rows(q.op13_token_alignment(spark, SF)) == brute_alignment(documents.collect(), *paths)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 200, "slice_bytes": 50}])
def test_alignment_of_odd_rows(odd, paths, sizes):
    expected = brute_alignment(odd.collect(), *paths)
    assert sum(k for r, k in expected.items() if r[1] == 0) >= 4  # empty, null, and bytes that differ
    assert alignment_rows(alignment.align(odd, *paths, **sizes)) == expected


def test_alignment_of_nothing(spark, empty, paths):
    assert alignment.align(empty, *paths).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert alignment_rows(alignment.align(nothing, *paths)) == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_pair_counts(odd, paths):
    rows = alignment.pair_counts(odd, *paths).collect()
    highest = defaultdict(int)
    for r in rows:
        highest[r["a"]] = max(highest[r["a"]], r["n_docs"])
    assert rows and all(r["best"] == (r["n_docs"] == highest[r["a"]]) for r in rows)
