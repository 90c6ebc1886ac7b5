"""Operators against brute force on whole small tables, and their defined edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerlens.llm import llm_queries as q

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("copies", T.StringType()),
])


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    line = "one two three four five six seven eight nine ten eleven twelve"
    texts = {
        1: "a b c", 2: "", 3: None, 4: long, 5: line, 6: line, 7: " \t\n", 8: "é ü " * 30, 9: line + " thirteen", 10: "x", 11: "A B C", 12: "日本語 テキスト",
    }
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "x", None, "y", "z", None) for i, t in texts.items()]
    return [*rows, rows[4], rows[0], (None, "no id at all here", "en", "s1", 3, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words_of(text):
    return WORD.findall(text or "")


# mixing


def water_fill(sizes: dict, weights: dict, total: float) -> dict:
    target, open_ = {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        above = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not above:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: 3 * sizes[s] for s in above}
        open_ -= above
    return target


def check_mix(rows, source_of):
    sizes = Counter()
    for r in rows:
        sizes[source_of(r)] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = water_fill(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()))
    taken = Counter()
    for r in rows:
        s = source_of(r)
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.5


def test_mix_whole_table(spark, documents):
    rows = q.op1_mix_sources(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    assert all(r["size"] == len(words_of(documents[r["doc_id"]]["text"])) for r in rows)
    check_mix(rows, lambda r: documents[r["doc_id"]]["source"])
    again = q.op1_mix_sources(spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_cases(odd, empty):
    from ledgerlens.llm.mixing import mix, training_order

    rows = mix(odd).collect()
    assert len(rows) == len(odd_rows())
    check_mix(rows, lambda r: r["source"])
    assert mix(empty).collect() == []
    ordered = training_order(odd, mix(odd))
    assert ordered.columns == odd.columns
    words = sum(len(words_of(r["text"])) for r in ordered.collect())
    assert words == sum(r["taken"] for r in rows)


def test_positions_invert_the_schedule(spark):
    from ledgerlens.llm.mixing import mix

    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    rows = mix(docs).collect()
    spots = defaultdict(list)
    for r in rows:
        spots[r["source"]] += [c["position"] for c in r["copies"]]
    mean = {s: float(np.mean(v)) for s, v in spots.items()}
    # densities 1.5-t, 1, 0.5+t have these means
    assert mean["s0"] == pytest.approx(5 / 12, abs=0.01) and mean["s1"] == pytest.approx(0.5, abs=0.01) and mean["s2"] == pytest.approx(7 / 12, abs=0.01)


# quality


def base_counts(text):
    words = words_of(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if count[g] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_whole_table(spark, documents):
    rows = q.op2_quality_rules(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == base_counts(documents[r["doc_id"]]["text"]), r["doc_id"]
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long = [r for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    right = np.mean([r["kept"] == bool(labels[r["doc_id"]]) for r in long])
    assert right > 0.95


def test_quality_cases(odd, empty):
    from ledgerlens.llm.quality import clean_documents

    rows = clean_documents(odd).collect()
    assert len(rows) == len(odd_rows()) and clean_documents(empty).collect() == []
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == base_counts(r["text"])


def test_line_rules(spark):
    from ledgerlens.llm.quality import clean_documents

    rng = random.Random(6)
    good = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(12)) + ", so it went." for _ in range(8)]  # no window twice but the ends
    cases = [
        (1, "\n".join(good)),
        (2, "\n".join(good + ["Home | About | Contact | Help", "All rights reserved.", "%%% $$$ ### &&& ***"])),
        (3, "\n".join([" | ".join(f"item{i}{j}" for j in range(12)) for i in range(8)] + good[:1])),
    ]
    rows = {r["doc_id"]: r for r in clean_documents(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert rows[1]["kept"] and rows[1]["clean_text"] == cases[0][1]
    assert rows[2]["kept"] and rows[2]["clean_text"] == cases[0][1] and rows[2]["n_removed_lines"] == 3
    assert not rows[3]["kept"] and not rows[3]["base_failed"]


# tokens and packing


def test_token_counts(spark, documents, odd, empty):
    from tokenizers import Tokenizer

    from ledgerlens.llm.tokens import count_tokens

    path = q.tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    rows = q.op10_token_counts(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r["doc_id"]]["text"]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), count(text), count(text) > 1024)
    special = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "  two  spaces \n\n\t x's ''s", "\x1c a\x85b\xa0c d", "عربي ١٢٣ 日本", "á e\x00f", "I'll we've", "   "]
    docs = spark.createDataFrame(list(enumerate(special)), "doc_id long, text string").union(odd.select("doc_id", "text"))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(docs, path, block_bytes=200).collect())
    assert got == Counter((r["doc_id"], len((r["text"] or "").encode()), count(r["text"])) for r in docs.collect())
    assert count_tokens(empty, path).collect() == []


def check_pieces(rows, ids_of, window=2048):
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, pieces in by_doc.items():
        ids, at = ids_of(doc), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert zlib.crc32(part) == (r["ids_crc32"] if "ids_crc32" in r else zlib.crc32(r["ids"]))
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    lengths = []
    for s in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        lengths.append(at)
    assert all(n == window for n in lengths[:-1]) and lengths[-1] <= window


def test_packing(spark, documents, odd, empty):
    from tokenizers import Tokenizer

    from ledgerlens.llm.packing import pack

    path = q.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    rows = [r.asDict() for r in q.op5_pack_sequences(spark, SF).collect()]
    assert {r["doc_id"] for r in rows} == set(documents)
    check_pieces(rows, lambda d: ids(documents[d]["text"]))
    special = {100: "a<|endoftext|>b <|startoftext|>", 101: "É́ ΑΣ Σ's\x0bt\x85u\xa0 v", 102: "x" * 300, 103: "\n \n", 104: "é don't I'LL", 105: None}
    texts = special | {i: t for i, t in ((r[0], r[1]) for r in odd_rows()) if i is not None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check_pieces([r.asDict() for r in pack(docs, path, window=64).collect()], lambda d: ids(texts[d]), 64)
    assert len({r["sequence_id"] for r in pack(odd, path).collect()}) >= 1 and pack(empty, path).collect() == []


def test_no_collections_while_words_are_looked_up(monkeypatch):
    import gc

    from ledgerlens.llm.packing import WordIds

    words, on = WordIds(q.tokenizer_path("word_bpe_49k.json"), "<u2"), []
    plain = WordIds._plain
    monkeypatch.setattr(WordIds, "_plain", lambda self, split: (on.append(gc.isenabled()), plain(self, split))[1])
    assert words(["Zwonk the gnarfle", ""])[1] == b"" and on == [False] and gc.isenabled()
    monkeypatch.setattr(WordIds, "_plain", lambda self, split: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        words(["a"])
    assert gc.isenabled()
    gc.disable()
    try:
        monkeypatch.undo()
        words(["a"])
        assert not gc.isenabled()
    finally:
        gc.enable()


# personal data


def brute_spans(text):
    from ledgerlens.llm.pii import luhn

    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15],
    }


def check_spans(rows, text_of):
    for r in rows:
        want = brute_spans(text_of(r["doc_id"]) or "")
        assert [r[f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        joined = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["spans"] + ",").startswith(joined + "," if joined else "")


def test_personal_data(spark, documents, odd, empty):
    from ledgerlens.llm.pii import _anchors, find_spans, mask_documents, spans_of

    rows = q.op6_personal_data(spark, SF).collect()
    assert len(rows) == len(documents)
    check_spans(rows, lambda d: documents[d]["text"])
    texts = {r[0]: r[1] for r in odd_rows()}
    check_spans(find_spans(odd).collect(), texts.get)
    assert find_spans(empty).collect() == []
    rng, machine = random.Random(5), _anchors()
    parts = ["a@b.c", "1.2.3.4", "+1 (22) 333-4444", "4111111111111111", "4111 1111 1111 1111", "256.1.1.1", "..", "@", " ", "-", "x", "+1", "0", ".", "é", "٣", "1" * 30]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        found = spans_of(text, machine)
        assert all(found[k] == v for k, v in brute_spans(text).items()), text
    docs = spark.createDataFrame([(1, "mail a@b.org or password=hunter2222 now"), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r["text"] for r in mask_documents(docs).orderBy("doc_id").collect()] == ["mail [EMAIL] or password=[SECRET] now", None, "clean"]


# near duplicates


def test_accounts_before_words():
    from ledgerlens.llm.pii import _anchors, spans_of

    machine = _anchors()
    for iban in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947", "GB29 NWBK 6016 1331 9268 19", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for after in ("", " for the rent", ". Thanks", " is mine and 12 others are", " a", "\nand more"):
            text = f"Pay to IBAN {iban}{after}"
            assert spans_of(text, machine)["account"] == [(12, 12 + len(iban))], text
    for text in ("IBAN DE89 3704 0044 0532 0130 01 for the rent", "IBAN DE89370400440532013000x and on"):
        assert spans_of(text, machine)["account"] == []


def brute_groups(texts: dict, size: int, percent: int):
    def shingles(text):
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
        if not words:
            return frozenset()
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])

    sets = {d: shingles(t) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    both = Counter(p for h in holders.values() for p in itertools.combinations(sorted(h), 2))
    parent = {d: d for d in texts}

    def find(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_near_duplicates(spark, documents, odd, empty):
    from ledgerlens.llm.near_duplicates import find_groups

    rows = q.op7_near_duplicates(spark, SF).collect()
    want = brute_groups({d: r["text"] for d, r in documents.items()}, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    rows = find_groups(odd, shingle_words=3, threshold_percent=85).collect()
    assert len(rows) == len(odd_rows())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == brute_groups(texts, 3, 85)
    assert find_groups(empty).collect() == []


def test_chains_and_shared_passages(spark):
    """Chains whose ends don't link, and many texts that share a passage without linking."""
    from ledgerlens.llm.near_duplicates import find_groups

    rng = random.Random(11)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    base, passage, texts = words(200), words(120), {}
    for i in range(40):
        base[5 * i : 5 * i + 2] = words(2)
        texts[i] = " ".join(base)
    for i in range(100, 260):
        texts[i] = " ".join(passage + words(60))
    for i in range(300, 420):
        copy = list(passage)
        copy[rng.randrange(len(copy))] = "zz"
        texts[i] = " ".join(copy)
    rows = find_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_groups(texts, 5, 80)


def test_registers_estimate():
    from ledgerlens.llm.near_duplicates import EMPTY, _mix, expected_collisions, registers

    rng = np.random.default_rng(2)
    a = np.unique(_mix(rng.integers(0, 1 << 62, 4000).astype("u8")))
    b = np.unique(np.concatenate([a[: 3600 * len(a) // 4000], _mix(rng.integers(0, 1 << 62, 400).astype("u8"))]))
    x, y = registers(np.sort(a)), registers(np.sort(b))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(((x == y) & (x != EMPTY)).mean() - true) < 0.12
    assert 0 <= expected_collisions(np.array([4000.0]), np.array([4000.0]))[0] < 1


# substrings


def test_cut_points_follow_the_rolling_hash():
    from ledgerlens.llm.substrings import GEAR_BYTES, MEAN_BYTES, cut_points, gear_table

    gear = gear_table()
    data = "Ünïcode text, rolling along; ".encode() * 20 + bytes(random.Random(1).randrange(97, 122) for _ in range(3000))
    h, cuts = 0, set()
    for i, b in enumerate(data):
        h = ((h << 1) + int(gear[b])) & 0xFFFF
        if i >= GEAR_BYTES - 1 and ((h * 0x9E3779B1) & 0xFFFFFFFF) >> 12 < (1 << 20) // MEAN_BYTES:
            j = i + 1
            while j < len(data) and data[j] & 0xC0 == 0x80:
                j += 1
            cuts.add(j)
    assert set(cut_points(np.frombuffer(data, "u1"), gear).tolist()) == cuts | {len(data)}


def test_repeated_passages(spark, documents, empty):
    from ledgerlens.llm.substrings import remove_passages, repeated_passages

    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [words(60) for _ in range(30)]
    texts = {i: words(80) for i in range(200)}
    planted = defaultdict(set)
    for i, p in enumerate(passages):
        for d in rng.sample(range(200), 4):
            texts[d] = f"{words(rng.randint(0, 9))} {texts[d]} {p} {words(20)}"
            planted[d].add(i)
    texts |= {900: "", 901: None, 902: "z" * 50_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = repeated_passages(docs).collect()
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(texts[r["doc_id"]][r["start"] : r["stop"]])
    assert set(found) == set(planted)
    for d, spans in found.items():
        assert len(spans) == len(planted[d])
        # the neighbours of two copies may share a letter or two more
        assert all(any(s[4:-4] in passages[i] for i in planted[d]) for s in spans)
    left = {r["doc_id"]: r["text"] for r in remove_passages(docs, repeated_passages(docs)).collect()}
    for d, text in left.items():
        gone = sum(r["stop"] - r["start"] for r in rows if r["doc_id"] == d and not r["is_first"])
        assert len(text or "") == len(texts[d] or "") - gone
    assert repeated_passages(empty).collect() == []
    assert q.op9_repeated_passages(spark, SF).count() > 0


def test_passages_survive_once_in_chains(spark):
    """Copies that were added to and then copied on: every passage stays in one document."""
    from ledgerlens.llm.substrings import remove_passages, repeated_passages

    rng = random.Random(18)
    words = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(n))
    texts, cores = {}, []
    for i in range(0, 120, 6):
        passages = [words(80) for _ in range(4)]
        cores += [" ".join(p.split()[30:50]) for p in passages]
        for j, chain in enumerate(([0], [0, 1], [0, 1], [2, 0, 1], [2, 0, 1, 3], [3, 0])):
            texts[i + j] = " ".join([words(30), *(passages[k] for k in chain), words(30)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    left = [r["text"] for r in remove_passages(docs, repeated_passages(docs)).collect()]
    assert [sum(c in t for t in left) for c in cores] == [1] * len(cores)


def test_passages_come_from_one_document(spark):
    """Phrases that stand in several documents, or in another order, are no passage."""
    from ledgerlens.llm.substrings import repeated_passages

    rng = random.Random(28)
    words = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(n))
    phrases = [words(14) for _ in range(60)]
    texts = {i: f"{words(30)} {p} {words(30)}" for i, p in enumerate(phrases)}
    texts |= {100 + i: " ".join(phrases[6 * i : 6 * i + 6]) for i in range(10)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert repeated_passages(docs).collect() == []


def test_substring_cases(odd):
    from ledgerlens.llm.substrings import repeated_passages

    assert repeated_passages(odd).filter("doc_id is null").count() == 0


def test_mix_source_without_words(spark):
    from ledgerlens.llm.mixing import mix, training_order

    docs = spark.createDataFrame([(1, "a b", "s"), (2, "", "t"), (3, None, "u")], "doc_id long, text string, source string")
    rows = {r["doc_id"]: r for r in mix(docs).collect()}
    assert (rows[1]["taken"], rows[2]["taken"], rows[3]["taken"]) == (2, 0, 0) and rows[2]["target"] == rows[3]["target"] == 0.0
    assert [r["text"] for r in training_order(docs, mix(docs)).collect()] == ["a b"]
    nothing = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(nothing).collect()] == [0, 0]
    assert training_order(nothing, mix(nothing)).collect() == []


def test_letters_beyond_ascii_after_an_account_cue():
    from ledgerlens.llm.pii import _anchors, iban_valid, spans_of

    machine = _anchors()
    for text in ("iban İa41 1111 1111 1111 11", "iban DE89 3704 0044 0532 0130 0K", "ıban DE89ſ704", "IBAN KK12 1111 1111 1111 1"):
        assert spans_of(text, machine)["account"] == []
    assert iban_valid("de89 3704 0044 0532 0130 00")


@pytest.mark.parametrize("turned", [False, True])
def test_an_id_with_several_texts_keeps_all_their_links(spark, turned):
    from ledgerlens.llm.near_duplicates import find_groups

    rng = random.Random(4)
    words = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = words(120), words(120), words(120)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (4, " ".join(c)), (5, " ".join(c)), (5, " ".join(words(50)))]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    found = find_groups(df, shingle_words=3, threshold_percent=85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4)]


@pytest.mark.parametrize("hubs", [1, 3])
def test_near_duplicates_with_few_hubs_are_all_found(spark, monkeypatch, hubs):
    """A class meets a bounded number of hubs at first; what they miss is found among the rest: against all pairs."""
    import numpy as np

    from ledgerlens.llm import near_duplicates as ND

    monkeypatch.setattr(ND, "HUBS", hubs)
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(4):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(40):
            words = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 6)):
                words[at] = f"w{rng.integers(0, 5000)}"
            texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["component_id"] for r in ND.find_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle_words=3, threshold_percent=85).collect()}
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert found == {i: root(i) for i in range(len(sets))}


def _staged_groups(spark, monkeypatch, texts, size, percent):
    """Groups of ``texts`` (by place), and the rows of every stage."""
    from ledgerlens.llm import near_duplicates as ND

    rows, written = {}, ND.stage

    def counted(df, name):
        out = written(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(ND, "stage", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = ND.find_groups(df, shingle_words=size, threshold_percent=percent).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}, rows


def test_short_texts_do_not_meet_by_chance(spark, monkeypatch):
    """A short text fills a register of a band: without marks, texts that share no word meet in as many buckets as their square."""
    rng = random.Random(8)
    texts = [" ".join(f"s{rng.randrange(10**9)}" for _ in range(30)) for _ in range(2000)]
    found, rows = _staged_groups(spark, monkeypatch, texts, 3, 85)
    assert found == {i: (28, i) for i in range(2000)}
    assert rows["band-hits"] <= 20


def test_near_copies_below_the_threshold_cost_their_number(spark, monkeypatch):
    """Copies that the estimate lets pass and full sets don't: members are written, never their pairs."""
    rng = random.Random(9)
    base, texts = [f"b{i}" for i in range(200)], []
    for i in range(300):
        words = list(base)
        for k in rng.sample(range(200), 4):
            words[k] = f"c{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    found, rows = _staged_groups(spark, monkeypatch, texts, 3, 85)
    assert found == brute_groups(dict(enumerate(texts)), 3, 85)
    late = [n for name, n in rows.items() if name.startswith("late")]
    assert len({c for _, c in found.values()}) > 100 and max(late) <= rows["open-hits"] and rows["late-links"] <= 300 * 42


def test_only_repeated_windows_are_written(spark, monkeypatch):
    """Windows are shipped once, packed; what is written are those that several documents have, as all pairs of texts tell."""
    from ledgerlens.llm import substrings as S

    written, rows = S.stage, {}

    def counted(df, name):
        out = written(df, name)
        rows[name] = [tuple(r) for r in out.collect()]
        return out

    monkeypatch.setattr(S, "stage", counted)
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = words(60)
    texts = {i: words(120) for i in range(30)} | {40: words(20) + " " + shared, 41: shared + " " + words(20), 42: words(5) + " " + shared + " é " + shared}
    listed = [*texts.items(), (41, words(50)), (None, shared), (43, None), (44, "")]
    S.repeated_passages(spark.createDataFrame(listed, "doc_id long, text string").repartition(3)).collect()
    held = {}
    for d, t in listed:
        if d is not None and t:
            for k, x in enumerate(S.Windows(t.encode(), S.MIN_WORDS).digests().tolist()):
                held.setdefault(x, []).append((d, k))
    want = {(d, k, min(y for y, _ in at)) for at in held.values() if len({y for y, _ in at}) > 1 for d, k in at}
    assert want and sum(len(x) for x in rows.values()) == len(want) and {(r[0], r[1], r[3]) for x in rows.values() for r in x} == want


def test_slices_and_blocks_of_windows_change_nothing(monkeypatch):
    import pyarrow as pa

    from ledgerlens.llm import substrings as S

    rng = random.Random(13)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    texts = [(i, " ".join(rng.sample(lines, 4)).encode()) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts], pa.int64()), pa.array([t for _, t in texts], pa.binary())], ["doc_id", "text"])
    found = []
    for block, size in ((10**6, 10**6), (500, 7)):
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "SLICE", size)
        packed = pa.Table.from_batches(list(S._packed(S.MIN_WORDS)(iter([batch])))).sort_by("bin").combine_chunks().to_batches()
        found.append(sorted(tuple(r.values()) for out in S._repeated(iter(packed)) for r in out.to_pylist()))
    assert found[0] and found[0] == found[1]


def test_kept_ids_of_pre_tokens_are_those_of_each_text(monkeypatch):
    """Ids kept in one array, through forgetting and long words, against one text at a time."""
    import public_tokenizers

    from ledgerlens.llm import alignment as AL

    monkeypatch.setattr(AL, "KEPT_WORDS", 12)
    side = AL.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))
    long_word = " " + "abcdefghij" * 9
    for texts in ([" one two", "", " two three"], [long_word + " one", long_word], [], ["", ""], [f" n{i} word{i}" for i in range(40)], [" one two three", long_word]):
        got = side(texts).to_pylist()
        assert got == [side.tokenizer.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
        assert side.sizes.sum() == len(side.flat) and len(side.sizes) == len(side.places) and all(len(w) <= AL.KEPT_CHARS for w in side.places)
