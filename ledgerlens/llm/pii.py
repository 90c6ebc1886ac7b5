"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues. Around each anchor a deterministic local parser
walks to the boundaries of what may stand there and validates it: e-mail, IPv4
address, payment card, phone number, and, by cue, IBAN accounts, social security
numbers, URLs with credentials, and secrets.

Kinds ``email ip card phone`` are the leftmost non-overlapping matches of fixed
patterns (below); what fails its check is dropped, and the search goes on after
it. The cue-driven kinds are added to these and never replace them.

No shuffle: one scan, one text at a time. Offsets are code points, end exclusive.

Defined results: null and empty texts have no spans; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored by
``find_spans`` and passed through by ``mask_documents``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bound_batches

#: Fixed patterns: what follows an e-mail's at-sign, an address, a digit group, a phone number.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Cue-driven kinds: cue (lower case) and what has to follow it.
IBAN = re.compile(r"(?i:iban)[\x20:=#]{0,3}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})\b")
SSN = re.compile(r"(?i)(?:ssn|social security(?: number| no\.?)?)[\x20:=#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})\b")
ACCOUNT = re.compile(r"(?i)(?:account|acct)(?: number| no\.?| nr\.?)?[\x20:=#]{0,3}([0-9](?:[\x20-]?[0-9]){5,16})\b")
#: Letters and digits of an IBAN by country.
IBAN_LENGTHS = dict(x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 "
    "FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 "
    "LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 "
    "SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30").split())
URL = re.compile(r"://[^\s/@:]+:[^\s/@]+@[^\s/]+")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
TOKEN = re.compile(r"(?:ghp_|gho_|sk_live_|sk-|xox[bap]-)[0-9A-Za-z_-]{16,}")
SECRET = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]?[=:][\x20]?[\"']?([^\s\"',;]{6,})")
CUES = {
    "iban": (IBAN, "account"), "ssn": (SSN, "id"), "social security": (SSN, "id"), "account": (ACCOUNT, "account"), "acct": (ACCOUNT, "account"),
    "password": (SECRET, "secret"), "passwd": (SECRET, "secret"), "pwd": (SECRET, "secret"), "secret": (SECRET, "secret"), "token": (SECRET, "secret"),
    "api_key": (SECRET, "secret"), "api-key": (SECRET, "secret"), "apikey": (SECRET, "secret"), "akia": (KEY_ID, "secret"),
    "ghp_": (TOKEN, "secret"), "gho_": (TOKEN, "secret"), "sk_live_": (TOKEN, "secret"), "sk-": (TOKEN, "secret"),
    "xoxb-": (TOKEN, "secret"), "xoxa-": (TOKEN, "secret"), "xoxp-": (TOKEN, "secret"), "://": (URL, "url"),
}
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("account", "id", "secret", "url")
Span = tuple[int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def iban_end(text: str, start: int, stop: int) -> int | None:
    """Where the IBAN that begins at ``start`` and may run on to ``stop`` ends.

    Its country tells its length; without one, or if that fails, it is the longest
    that ends with a word (for a known country only the whole run).
    """
    ends = [i + 1 for i in range(start, stop) if text[i] != " "]
    length = int(IBAN_LENGTHS.get(text[start : start + 2].upper(), 0))
    tries = [ends[length - 1], stop] if 0 < length <= len(ends) else [stop] if length else ends[:13:-1]
    for end in tries:
        if not (text[end : end + 1].isalnum() or text[end : end + 1] == "_") and iban_valid(text[start:end]):
            return end
    return None


def email_at(text: str, at: int, floor: int) -> Span | None:
    """The e-mail around the at-sign at ``at`` that begins at ``floor`` or later."""
    domain = DOMAIN.match(text, at + 1)
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    return (start, domain.end()) if domain and start < at else None


def _anchors():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word in ["@", "+", *"0123456789", *CUES]:
        machine.add_word(word, word)
    machine.make_automaton()
    return machine


def spans_of(text: str, machine) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {k: [] for k in BASE_KINDS + ADDED_KINDS}
    # lower case for the cues only where that keeps every offset
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    email_end = ip_end = card_end = phone_end = run_end = 0
    for last, cue in machine.iter(lowered):
        if cue == "@":
            if last >= email_end and (span := email_at(text, last, email_end)):
                found["email"].append(span)
                email_end = span[1]
        elif cue == "+":
            if last >= phone_end and (m := PHONE.match(text, last)):
                phone_end = m.end()
                if 8 <= len(_digits(m.group())) <= 15:
                    found["phone"].append(m.span())
        elif len(cue) == 1:
            if last < run_end:
                continue
            run_end = last + 1
            if last >= ip_end and (m := ADDRESS.match(text, last)):
                ip_end = m.end()
                if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
                    found["ip"].append(m.span())
            if last >= card_end and (m := CARD.match(text, last)):
                card_end = m.end()
                digits = _digits(m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            # the digits up to here can begin neither kind any more
            while run_end < len(text) and "0" <= text[run_end] <= "9":
                run_end += 1
        else:
            pattern, kind = CUES[cue]
            if m := pattern.match(text, last + 1 - len(cue)):
                span = m.span(1) if pattern.groups else m.span()
                if pattern is URL:
                    start = span[0]
                    while start and text[start - 1].isalnum() and text[start - 1].isascii():
                        start -= 1
                    span = (start, span[1])
                if pattern is IBAN:
                    end = iban_end(text, *span)
                    if end is None:
                        continue
                    span = (span[0], end)
                if not (found[kind] and span[0] < found[kind][-1][1]):
                    found[kind].append(span)
    return found


def _texts(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


FOUND_SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = _anchors()
    for batch in batches:
        counts: list[list[int]] = [[], [], [], []]
        sums, spans = [], []
        for text in batch.column(batch.num_columns - 1):
            found = spans_of(text.as_py() or "", machine)
            for n, kind in zip(counts, BASE_KINDS, strict=True):
                n.append(len(found[kind]))
            sums.append(hashlib.sha256(_texts(found, BASE_KINDS).encode()).hexdigest())
            spans.append(_texts(found, BASE_KINDS + ADDED_KINDS))
        columns = [*batch.columns[:-1], *(pa.array(n, pa.int64()) for n in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans, for every row."""
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_spans, f"doc_id long, {FOUND_SCHEMA}")


def masked(text: str, found: dict[str, list[Span]]) -> str:
    """``text`` with every span replaced by its kind; of overlapping spans the one that begins first names it."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, s in found.items() for a, b in s):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mask(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _anchors()
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else masked(t, spans_of(t, machine)) for x in batch.column(place)]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def mask_documents(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced by tags such as ``[EMAIL]``."""
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(_mask(docs.columns.index(text_col)), docs.schema)
