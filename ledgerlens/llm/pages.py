"""Main text of web pages: structure first, then a suffix array per host.

Parsing cuts a page into blocks and leaves out what its markup names as menu,
header, footer, sidebar, notice, advert, form, script, style or reader comment.
Class and id names say nothing of headings, main parts and (but for an article
in an article) of articles; inside a main part a whole name must be a known one,
or the block must be mostly links too.
A page that marks its main part (``article``, else ``main``) yields blocks of that
part only, and the others of all that remains.

A suffix array tells which of them, for every page. The token streams of the
blocks of a host's pages are concatenated, main parts and what lies outside them
apart, and their suffixes ordered by prefix doubling. Covered are runs of
``WINDOW`` and more tokens that distinct pages share outside main parts; inside a
main part they must stand in other main parts too. So what the site repeats around
its articles is found inside them as well, while an article whose beginning is
announced on other pages, or that is copied whole, or quoted by others, stays whole.
Equal streams are one, and so are near-equal ones (``COPIES`` of their shingles in
common): what only copies share is no boilerplate. A block that is
covered for the greater part is boilerplate and goes; the blocks with unique runs
stay. Ordering by more than ``WINDOW`` tokens could not change what is covered, so
the doubling ends there.

The blocks of a host of up to ``SHARD_PAGES`` pages (and ``SHARD_CHARS`` of html) are
shuffled once and its suffix array is made in a task. A larger host, such as one with a
third of all pages, is many tasks' work, and a run that any two of its pages share is found
by digests: its parsed blocks are written; the hashes that stand for the runs (the
least of the hashes of ``SHINGLE`` tokens in a run) are counted in packed lists; of the
runs whose hash two pages have, digests and the smallest and largest group of pages that
has them are aggregated over the host. Near-equal streams of such a host, of those with such a
run, are found by :mod:`ledgerlens.llm.near_duplicates`. The digests of what is
covered then meet the written blocks, which aren't shuffled while the digests are few.

Defined results: null and empty html has empty text; every row of the input
gives one row (repeated ids and pages too); null urls are one host; unclosed
elements end with what holds them, broken tags at the end of a page are left
out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bound_batches, pack_array, stage, unpack_array
from ledgerlens.llm.near_duplicates import SLACK, find_groups, linked

WINDOW, SHARD_PAGES, SHARD_CHARS = 8, 2000, 64_000_000
#: Digests that every task may hold, at most; anchors that a task packs together; bits of them that are left out.
LOOKED_UP, PACKED, ANCHOR_SHIFT = 2_000_000, 1 << 21, 24
#: Share of common shingles (of so many tokens) from which pages are versions of one, and hashes it is estimated by.
COPIES, SHINGLE, HASHES = 0.8, 4, 128
#: Share of a block's tokens in links from which it is a menu, where no main part is marked.
LINKED = 0.6

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Fixed element lists.
RAW = frozenset("script style textarea title noscript iframe template svg math object canvas audio video xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul button select option".split())
DROPPED = frozenset("nav aside header footer form head menu dialog button select search".split())
MAIN = ("article", "main")
VOID = frozenset("hr br img input meta link source wbr col area base embed param track".split())
#: Parts of class and id names, and roles, that name what is not main text.
HINTS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer ad ads advert adverts advertisement advertising adsense sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice popup modal newsletter subscribe subscription signup share sharing social comment comments disqus "
    "replies related recommended recommendations widget toolbar pagination pager copyright legal login masthead topbar teaser".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HEADER_HINTS = frozenset({"header", "masthead"})
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _unwanted(tag: str, attributes: str, zone: str) -> tuple[bool, bool]:
    """Whether an element is no main text, and whether its blocks aren't if they are mostly links."""
    in_article = zone == "article"
    if tag in DROPPED:
        return not (tag == "header" and in_article), False
    if not attributes or tag in ("html", "body"):
        return False, False
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, False
    if found.get("role") in ROLES:
        return True, False
    if tag == "main" or tag in HEADINGS or (tag == "article" and not in_article):
        return False, False
    hints = HINTS if in_article else HINTS | HEADER_HINTS
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    parts = [{p.lower() for p in NAME_PARTS.findall(name)} for name in names]
    if zone == "free":
        return any(p & hints for p in parts), False
    return any(p and p <= hints for p in parts), any(p & hints for p in parts)


def parse(page: str | None) -> tuple[list[str] | None, list[str]]:
    """Blocks of the marked main part (None if nothing is marked), and the others that may be text."""
    page = page or ""
    stack: list[tuple[str, bool, bool]] = []  # open block elements: tag, dropped, dropped where mostly links
    zones: dict[str, list[str]] = {"article": [], "main": [], "free": []}
    marked: set[str] = set()
    buffer: list[str] = []
    linked = anchored = at = 0
    zone, dropped, suspect = "free", False, False
    in_link = False

    def flush() -> None:
        nonlocal linked, anchored
        if buffer:
            text = " ".join(html_lib.unescape("".join(buffer)).split())
            if text and not dropped and not ((zone == "free" or suspect) and anchored and linked >= LINKED * anchored):
                zones[zone].append(text)
            buffer.clear()
        linked = anchored = 0

    def refresh() -> None:
        nonlocal zone, dropped, suspect
        dropped, suspect = any(x[1] for x in stack), any(x[2] for x in stack)
        tags = [x[0] for x in stack]
        zone = "article" if "article" in tags else "main" if "main" in tags else "free"

    def text_until(end: int) -> None:
        nonlocal linked, anchored
        if end > at and not dropped:
            piece = page[at:end]
            buffer.append(piece)
            n = len(piece.split())
            anchored += n
            linked += n if in_link else 0

    for m in MARKUP.finditer(page):
        if m.start() < at:
            continue  # inside an element whose content is no markup
        text_until(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in RAW:
            if not closing and not (m[3] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                if tag == "title":
                    continue
                buffer.append(" ")
            continue
        if tag == "a":
            in_link = not closing
        elif tag in VOID and tag != "hr":
            buffer.append(" " if tag == "br" else "")
        elif tag in BLOCK or (not closing and m[3] and tag in ("span", "section", "ins")):
            if tag not in BLOCK:
                # an inline element counts only if its attributes speak against it
                if not _unwanted(tag, m[3], zone)[0]:
                    continue
            flush()
            if tag in VOID:
                continue
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        refresh()
                        break
                    if stack[i][0] in MAIN and tag not in (*MAIN, "body", "html"):
                        break  # a stray end tag doesn't end the main part
            else:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                if tag == "body" or tag in MAIN:
                    # what should have been closed before
                    while stack and stack[-1][0] in ("head", "nav", "header", "ul", "ol", "li", "menu") and any(x[0] in ("head", "nav", "header", "menu") for x in stack):
                        stack.pop()
                if tag in ("li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == tag:
                    stack.pop()
                stack.append((tag, *_unwanted(tag, m[3] or "", zone)))
                refresh()
                if tag in MAIN and not dropped:
                    marked.add(tag)
        elif closing and any(x[0] == tag for x in stack):
            flush()
            while stack.pop()[0] != tag:
                pass
            refresh()
    if at < len(page):
        text_until(len(page))
    flush()
    chosen = "article" if "article" in marked else "main" if "main" in marked else None
    if chosen:
        return zones[chosen], zones["free"]
    return None, zones["free"]


def runs(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` tokens, of which ``values`` are the hashes."""
    mixed = np.zeros(max(len(values) - n + 1, 0), "u8")
    for j in range(n):
        mixed = (mixed ^ values[j : j + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def versions(streams: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """A number for each stream that near-equal streams share; ``hashes`` are those of the tokens."""
    sets: list[np.ndarray] = []
    salts = np.random.default_rng(8).integers(1, 1 << 63, HASHES, dtype="u8") | np.uint64(1)
    signs = np.zeros((len(streams), HASHES), "u4")
    for k, stream in enumerate(streams):
        mixed = np.unique(runs(hashes[stream], max(1, min(SHINGLE, len(stream)))))
        sets.append(mixed)
        if not len(stream):
            continue
        least = np.full(HASHES, (1 << 32) - 1, "u4")
        for lo in range(0, len(mixed), 4096):
            part = ((mixed[lo : lo + 4096, None] * salts) >> np.uint64(32)).astype("u4")
            least = np.minimum(least, part.min(axis=0))
        signs[k] = least
    group = np.arange(len(streams))
    for k in range(1, len(streams)):
        if len(streams[k]):
            near = np.flatnonzero((signs[:k] == signs[k]).mean(axis=1) >= COPIES - SLACK * math.sqrt(COPIES * (1 - COPIES) / HASHES))
            met: dict[int, bool] = {}
            for j in near:  # one confirmed pair makes groups one
                met[group[j]] = met.get(group[j]) or linked(sets[j], sets[k], round(100 * COPIES))
            near = near[[met[group[j]] for j in near]] if len(near) else near
            if len(near):
                joined = np.unique(group[near])
                group[k] = joined[0]
                if len(joined) > 1:
                    group[: k + 1][np.isin(group[: k + 1], joined)] = joined[0]
    return group


def covered_tokens(streams: list[np.ndarray], window: int = WINDOW, groups: np.ndarray | None = None, inside: np.ndarray | None = None) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of ``window`` or more that streams of two groups have.

    Streams that are ``inside`` main parts don't count for that; their own tokens must
    lie in a run that two groups of such streams have too.
    """
    lengths = np.array([len(s) for s in streams])
    n = int(lengths.sum()) + len(streams)
    page = np.repeat(np.arange(len(streams)) if groups is None else groups, lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    main = np.repeat(np.zeros(len(streams), bool) if inside is None else inside, lengths + 1)
    tokens = np.zeros(n, "i8")
    token = np.ones(n, bool)
    token[ends] = False
    tokens[token] = np.concatenate(streams) if len(streams) else []
    tokens[ends] = (tokens.max() if n else 0) + 1 + np.arange(len(streams))  # separators, all different
    rank = np.unique(tokens, return_inverse=True)[1]
    span = 1
    while span < window:
        step = min(span, window - span)
        after = np.full(n, -1, "i8")
        after[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1]
        span += step
    order = np.argsort(rank, kind="stable")  # the suffix array, ordered by the first ``window`` tokens
    starts = np.flatnonzero(np.diff(rank[order], prepend=-1))

    def several(kind: np.ndarray) -> np.ndarray:
        """Which runs streams of several groups have, among those of a kind."""
        lo, hi = np.where(kind, page, n)[order], np.where(kind, page, -1)[order]
        return np.minimum.reduceat(lo, starts) < np.maximum.reduceat(hi, starts)

    around = several(~main)
    shared = np.where(main, (around & several(main))[rank], around[rank])
    edge = np.zeros(n + window + 1, "i8")
    np.add.at(edge, np.flatnonzero(shared), 1)
    np.add.at(edge, np.flatnonzero(shared) + window, -1)
    covered = np.cumsum(edge)[:n] > 0
    return [covered[e - k : e] for e, k in zip(ends, lengths, strict=True)]


def unique_blocks(pages: list[list[str]], mains: list[list[str] | None] | None = None) -> list[list[str]]:
    """The blocks of each page, of its main part if ``mains`` has one, that aren't covered for the greater part (see :func:`covered_tokens`)."""
    from xxhash import xxh3_64_intdigest

    known: dict[str, int] = {}
    mains = mains or [None] * len(pages)
    parts = [*((False, blocks) for blocks in pages), *((True, blocks or []) for blocks in mains)]
    split = [[b.split() for b in blocks] for _, blocks in parts]
    every = [np.array([known.setdefault(t, len(known)) for block in blocks for t in block], "i8") for blocks in split]
    place: dict[tuple[bool, bytes], int] = {}
    of = [place.setdefault((inside, x.tobytes()), len(place)) for (inside, _), x in zip(parts, every, strict=True)]
    streams, inside = [np.frombuffer(x, "i8") for _, x in place], np.array([k for k, _ in place], bool)
    hashes = np.array([xxh3_64_intdigest(t) for t in known], "u8")
    groups = np.zeros(len(streams), "i8")
    for kind in (False, True):
        own = np.flatnonzero(inside == kind)
        groups[own] = versions([streams[k] for k in own], hashes)
    shared = covered_tokens(streams, groups=groups, inside=inside)
    out = []
    for k, main in enumerate(mains):
        k += 0 if main is None else len(pages)
        covered, at, kept = shared[of[k]], 0, []
        for text, words in zip(parts[k][1], split[k], strict=True):
            if 2 * covered[at : at + len(words)].sum() <= len(words):
                kept.append(text)
            at += len(words)
        out.append(kept)
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = [parse(x.as_py()) for x in part.column(2)]
            texts = pa.array([None if main is None else "\n".join(main) for main, _ in found], pa.string())
            free = pa.array([f for _, f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts, free, *part.columns[3:]], ["page_id", "url", "text", "free", *part.schema.names[3:]])


def _by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, shard, page_id, url, text, free), sorted by host and shard, to the pages' texts."""
    key, rows = None, []

    def done() -> pa.RecordBatch:
        mains = [None if r["text"] is None else r["text"].split("\n") if r["text"] else [] for r in rows]  # a block is a line
        kept = unique_blocks([r["free"] or [] for r in rows], mains)
        cols = [[r["page_id"] for r in rows], [r["url"] for r in rows], ["\n".join(blocks) for blocks in kept]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "url", "text"])

    for batch in batches:
        for row in batch.to_pylist():
            if (row["host"], row["shard"]) != key:
                if rows:
                    yield done()
                key, rows = (row["host"], row["shard"]), []
            rows.append(row)
    if rows:
        yield done()


# -- hosts that are too large for a task ----------------------------------------------------
class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > KNOWN_TOKENS:
            self.clear()
        value = self[token] = xxh3_64_intdigest(token)
        return value


#: Tokens whose hashes a task keeps.
KNOWN_TOKENS = 200_000


def _values(words: list[str], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), "u8", len(words))


def anchors(values: np.ndarray) -> np.ndarray:
    """For each run of ``WINDOW`` tokens the least hash of ``SHINGLE`` tokens in it: equal runs have equal ones, neighbouring runs mostly the same."""
    grams, n = runs(values, SHINGLE), len(values) - WINDOW + 1
    return np.minimum.reduce([grams[j : j + n] for j in range(WINDOW - SHINGLE + 1)]) if n > 0 else grams[:0]


def _among(values: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Which of ``values`` are in a sorted array."""
    if known is None or not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _words(row: dict, inside: bool) -> list[str]:
    return (row["text"] or "").split() if inside else " ".join(row["free"] or []).split()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed rows, with a number for each of their streams (null if it has no token)."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        rows = batch.to_pylist()
        for inside, name in ((False, "around"), (True, "inside")):
            words = [_words(r, inside) for r in rows]
            ids = [int(np.uint64(xxh3_64_intdigest(f"{r['host']} {int(inside)} {' '.join(w)}")).view("i8")) if w else None for r, w in zip(rows, words, strict=True)]
            batch = batch.append_column(name, pa.array(ids, pa.int64()))
        yield batch


def _anchor_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with blocks outside main parts to (host, bin, packed anchors), those of several rows twice."""
    known, held, n = _Hashes(), {}, 0

    def told() -> pa.RecordBatch:
        keys, lists = list(held), []
        for key in keys:
            found, count = np.unique(np.concatenate(held[key]), return_counts=True)
            lists.append(pack_array(np.diff(np.repeat(found, np.minimum(count, 2)), prepend=np.uint64(0)), "<u8"))
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int32()), pa.array(lists, pa.binary())], ["host", "bin", "list"])

    for batch in batches:
        for row in batch.to_pylist():
            found = np.unique(anchors(_values(_words(row, False), known)) >> np.uint64(ANCHOR_SHIFT))
            place = found % np.uint64(row["bins"])
            for b in np.unique(place).tolist():
                held.setdefault((row["host"], b), []).append(found[place == b])
            n += len(found)
            if n > PACKED:
                yield told()
                held, n = {}, 0
    if held:
        yield told()


def _met_twice(lists: pa.Table) -> pa.Table:
    """The anchors of a host's bin that several rows have."""
    every = np.sort(np.concatenate([np.cumsum(unpack_array(x.as_py(), "<u8"), dtype="u8") for x in lists["list"]]))
    met = np.unique(every[1:][every[1:] == every[:-1]])
    return pa.table({"host": pa.array([lists["host"][0].as_py()], pa.int64()), "n": pa.array([len(met)], pa.int64()), "list": pa.array([met.astype("<u8").tobytes()], pa.binary())})


def _by_number(rows) -> dict[int, np.ndarray]:
    """Sorted arrays of each host from rows (host, bytes)."""
    out: dict[int, list] = {}
    for host, data in rows:
        out.setdefault(host, []).append(np.frombuffer(data, "<u8"))
    return {host: np.sort(np.concatenate(parts)) for host, parts in out.items()}


def _looked_up(values: np.ndarray, inside: bool, known: np.ndarray | None) -> np.ndarray:
    """The runs outside main parts whose anchors are known, or those inside that are known themselves."""
    found = runs(values, WINDOW)
    return found[_among(found if inside else anchors(values) >> np.uint64(ANCHOR_SHIFT), known)]


def _run_rows(inside: bool, looked_up):
    """Rows (…, group) to (host, digest, group) of the runs that :func:`_looked_up` finds; of all runs if ``looked_up`` is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            hosts, digests, groups = [], [], []
            for row in batch.to_pylist():
                values = _values(_words(row, inside), known)
                found = np.unique(runs(values, WINDOW) if looked_up is None else _looked_up(values, inside, looked_up.value.get(row["host"])))
                hosts.append(np.full(len(found), row["host"], "i8"))
                digests.append(found.view("i8"))
                groups.append(np.full(len(found), row["group"], "i8"))
            if hosts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hosts, digests, groups)], ["host", "digest", "group"])

    return run


class _Folded(dict):
    """Words as :func:`find_groups` tells them apart, which has no capitals of ASCII."""

    def __missing__(self, token: str) -> str:
        if len(self) > KNOWN_TOKENS:
            self.clear()
        value = self[token] = CAPITAL.sub(lambda m: f"\x01{m[0].lower()}", token)
        return value


CAPITAL = re.compile("[A-Z]")


def _salted(inside: bool, looked_up):
    """Rows with a run that is looked up (see :func:`_run_rows`) to (stream, text): the words after the host's number, so that no two hosts have a shingle in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, folded = _Hashes(), _Folded()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = _words(row, inside)
                if looked_up is None or len(_looked_up(_values(words, known), inside, looked_up.value.get(row["host"]))):
                    salt = f" {row['host']:x}:"
                    out.append((row["inside" if inside else "around"], salt + salt.join(map(folded.__getitem__, words))))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["stream", "text"])

    return run


def _shared_runs(blocks: DataFrame, inside: bool, looked_up) -> DataFrame:
    """(host, digest) of the runs that streams of several groups of near-equal ones have."""
    name = "inside" if inside else "around"
    rows = blocks.where(F.col(name).isNotNull())
    groups = find_groups(rows.mapInArrow(_salted(inside, looked_up), "stream long, text string"), id_col="stream", shingle_words=SHINGLE, threshold_percent=round(100 * COPIES))
    groups = stage(groups.where("component_id <> doc_id").select(F.col("doc_id").alias(name), F.col("component_id").alias("group")).distinct(), "page-groups")
    grouped = rows.join(groups, name, "left").select("host", "text", "free", F.coalesce("group", name).alias("group"))
    held = grouped.mapInArrow(_run_rows(inside, looked_up), "host long, digest long, group long")
    return held.groupBy("host", "digest").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("host", "digest")


def _digests_of(shared: DataFrame) -> dict[int, np.ndarray]:
    """Sorted digests of each host, on the driver."""
    found = shared.toPandas()
    return {int(host): np.sort(part["digest"].to_numpy("i8").view("u8")) for host, part in found.groupby("host")}


def _uncovered(looked_up):
    """Rows of blocks to the pages' texts. What is covered outside and inside main parts is looked up, or comes in rows before the blocks of a host and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        held: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["digests"] is not None:
                    held = {row["host"]: tuple(np.sort(np.array([x["digest"] for x in row["digests"] if x["main"] >= least], "i8").view("u8")) for least in (0, 1))}
                    continue
                inside = row["text"] is not None
                covered = (held if looked_up is None else looked_up.value).get(row["host"], (None, None))[inside]
                texts = row["free"] or [] if not inside else row["text"].split("\n") if row["text"] else []
                words = [t.split() for t in texts]
                values = _values([w for block in words for w in block], known)
                hit = np.flatnonzero(_among(runs(values, WINDOW), covered))
                edge = np.zeros(len(values) + 1, "i8")
                edge[hit] += 1
                edge[hit + WINDOW] -= 1
                upto = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
                ends = np.cumsum([0, *map(len, words)])
                kept = [t for t, lo, hi in zip(texts, ends[:-1], ends[1:], strict=True) if 2 * (upto[hi] - upto[lo]) <= hi - lo]
                out.append((row["page_id"], row["url"], "\n".join(kept)))
            cols = [[r[i] for r in out] for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "url", "text"])

    return run


TOLD = "page_id long, url string, text string"


def _of_large_hosts(parsed: DataFrame) -> DataFrame:
    """page_id, url, text of rows (page_id, url, text, free, host, shard, shards), host being a number: covered is what pages of the whole host share."""
    spark = parsed.sparkSession
    schema = "page_id long, url string, text string, free array<string>, host long, shard int, shards int, around long, inside long"
    blocks = stage(parsed.mapInArrow(_numbered, schema), "page-blocks")
    whole = blocks.withColumn("digests", F.lit(None).cast("array<struct<digest:long,main:int>>"))
    # a bin holds what some shards' pages have at most
    lists = blocks.where("around is not null").withColumn("bins", F.ceil(F.col("shards") / 16).cast("int"))
    lists = lists.select("free", "text", "host", "bins").mapInArrow(_anchor_lists, "host long, bin int, list binary")
    met = stage(lists.groupBy("host", "bin").applyInArrow(_met_twice, "host long, n long, list binary").where("n > 0"), "page-anchors")
    n = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:
        return whole.mapInArrow(_uncovered(spark.sparkContext.broadcast({})), TOLD)
    known = spark.sparkContext.broadcast(_by_number(met.select("host", "list").toLocalIterator())) if n <= LOOKED_UP else None
    some = blocks.join(met.select("host").distinct(), "host", "left_semi")
    around = stage(_shared_runs(some, False, known), "page-runs")
    few = around.count() <= LOOKED_UP
    known = spark.sparkContext.broadcast(_digests_of(around)) if few else None
    marked = blocks.join(around.select("host").distinct(), "host", "left_semi")
    both = _shared_runs(marked, True, known).join(around, ["host", "digest"], "left_semi").withColumn("main", F.lit(1))
    shared = stage(around.join(both, ["host", "digest"], "left").fillna(0, ["main"]), "page-covered")
    if few:
        first, second = _digests_of(shared), _digests_of(shared.where("main = 1"))
        return whole.mapInArrow(_uncovered(spark.sparkContext.broadcast({h: (d, second.get(h)) for h, d in first.items()})), TOLD)
    told = shared.groupBy("host").agg(F.collect_list(F.struct("digest", "main")).alias("digests"))
    told = told.join(blocks.groupBy("host", "shard").agg(F.first("shards").alias("shards")), "host")
    mixed = whole.unionByName(told, allowMissingColumns=True).repartition("host", "shard").sortWithinPartitions("host", "shard", F.col("digests").isNull())
    return mixed.mapInArrow(_uncovered(None), TOLD)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_pages: int = SHARD_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    bound_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    hosted = narrow.withColumn("host", host)
    hosts = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("chars"))
    shards = F.greatest(F.ceil(F.col("pages") / shard_pages), F.ceil(F.col("chars") / SHARD_CHARS)).cast("int").alias("shards")
    # only hosts of several shards, so a row for thousands of pages; numbered from 0 on
    large = stage(hosts.select("host", shards).filter("shards > 1").repartition(1).withColumn("number", F.monotonically_increasing_id()), "page-hosts")
    dealt = hosted.join(F.broadcast(large), "host", "left")
    streams = dealt.where("shards is null").select("page_id", "url", "html", "host", F.lit(0).alias("shard")).mapInArrow(
        _parsed, "page_id long, url string, text string, free array<string>, host string, shard int")
    told = streams.repartition("host", "shard").sortWithinPartitions("host", "shard").mapInArrow(_by_host, TOLD)
    if large.limit(1).count():
        shard = F.pmod(F.xxhash64("page_id", "url"), F.col("shards")).cast("int").alias("shard")
        pages_of = dealt.where("shards is not null").select("page_id", "url", "html", F.col("number").alias("host"), shard, "shards")
        told = told.unionByName(_of_large_hosts(pages_of.mapInArrow(
            _parsed, "page_id long, url string, text string, free array<string>, host long, shard int, shards int")))
    return told.withColumn("n_chars", F.length("text").cast("long"))
