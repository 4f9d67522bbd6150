"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, plus signs
before digits, digits and identifier cues. Around each anchor a local parser
looks only at its neighbourhood, sets the boundaries of the span and validates
it. Kinds, in their order: email, ip, card, phone, and beyond them url (a user
name and password before an at-sign of a scheme), account (an identifier after
a cue, or an IBAN with a right check sum) and address (a number with a street
cue and at most three names). Parsers run to the boundary that their pattern
sets; none looks a fixed distance around its anchor.

Defined cases: null and empty texts have no spans; texts of any length are read
whole; spans are in code points, end exclusive; spans of one kind do not overlap,
those of different kinds may; repeated rows get the same spans; all columns but
the two named are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstream.llm.common import worker_state

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "address")
ORDER = {k: i for i, k in enumerate(KINDS)}

# Fixed patterns of the base kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"

#: Words before which or after which an identifier may stand, lower case.
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "token", "password", "passwd", "api_key", "apikey", "secret", "konto", "cuenta", "compte")
STREET_CUES = (" street", " avenue", " road", " boulevard", "straße", "strasse", "calle ", "rue ", "avenida ")

_VALUE = re.compile(r"""(?i:[ _-]?(?:no|nr|number|id|key))?\.?["']?[ \t]*[:=#][ \t]*["']?([A-Za-z0-9][A-Za-z0-9+/_-]{5,}(?: [A-Z0-9]{4})*)""")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
_CREDENTIALS = re.compile(r"://[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
_NUMBER_BEFORE = re.compile(r"[0-9]{1,5}[a-z]? $")
_WORD_PART = re.compile(r"[\w'-]")
STREET_WORDS = 3
_HOUSE_NUMBER = re.compile(r" [0-9]{1,5}[a-z]?\b")
_STREET_AFTER = re.compile(r"(?:de |du |des |la |del |le )*[A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+){0,2},? [0-9]{1,5}\b")


def street_start(text: str, at: int) -> int | None:
    """Where a house number and up to three names, each with a capital, start that end at ``at``."""
    found = None
    for _ in range(STREET_WORDS):
        start = at
        while start and _WORD_PART.match(text[start - 1]):
            start -= 1
        if at - start < 2 or not "A" <= text[start] <= "Z" or not start or text[start - 1] != " ":
            break
        # The number is of seven characters at most, with what follows it.
        if m := _NUMBER_BEFORE.search(text[max(0, start - 7) : start]):
            found = max(0, start - 7) + m.start()
        at = start - 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    if not 15 <= len(t) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


@functools.cache
def anchors() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    auto.add_word("@", ("@", 1))
    auto.add_word("://", ("url", 3))
    for d in DIGITS:
        auto.add_word(d, ("digit", 1))
        auto.add_word(f"+{d}", ("plus", 2))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            auto.add_word(form, ("account", len(form)))
    for cue in STREET_CUES:
        kind = "street" if not cue.endswith(" ") else "streets"
        for form in {cue, cue.upper(), cue.title()}:
            auto.add_word(form, (kind, len(form)))
    auto.make_automaton()
    return auto


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then by kind's order."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    ends = dict.fromkeys(KINDS, 0)
    ip_at = card_at = 0  # the next place at which a run of digits may start a match

    def add(start: int, end: int, kind: str) -> None:
        if start >= ends[kind]:
            out.append((start, end, kind))
            ends[kind] = end

    for last, (what, size) in anchors().iter(text):
        at = last - size + 1
        if what == "digit":
            first = at == 0 or text[at - 1] not in DIGITS
            # Two capitals before digits may begin an IBAN, which its check sum tells.
            if first and at > 1 and text[at - 2 : at].isupper() and (at == 2 or not text[at - 3].isalnum()) and (m := _IBAN.match(text, at - 2)) and iban_ok(m[0]):
                add(at - 2, m.end(), "account")
            if at >= ip_at and (first or at == ip_at):
                m = IP.match(text, at)
                if m:
                    ip_at = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        out.append((at, ip_at, "ip"))
            if at >= card_at and (first or at == card_at):
                m = CARD.match(text, at)
                if m:
                    card_at = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, card_at, "card"))
        elif what == "@":
            start = at
            while start > ends["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                add(start, m.end(), "email")
        elif what == "plus":
            if at >= ends["phone"] and (m := PHONE.match(text, at)):
                ends["phone"] = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((at, m.end(), "phone"))
        elif what == "url":
            if m := _CREDENTIALS.match(text, at):
                add(at + 3, m.end(), "url")
        elif what == "account":
            if at and (text[at - 1].isalnum()):
                continue
            if m := _VALUE.match(text, last + 1):
                value = m[1]
                if sum(c in DIGITS for c in value) >= 4:
                    add(m.start(1), m.end(1), "account")
        elif what == "street":
            if last + 1 == len(text) or not text[last + 1].isalpha():
                if (low := street_start(text, at)) is not None:
                    add(low, last + 1, "address")
                elif m := _HOUSE_NUMBER.match(text, last + 1):
                    start = at
                    while start and text[start - 1].isalpha():
                        start -= 1
                    if text[start].isupper():
                        add(start, m.end(), "address")
        elif what == "streets":
            if (not at or not text[at - 1].isalpha()) and (m := _STREET_AFTER.match(text, last + 1)):
                add(at, m.end(), "address")
    out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def personal_data(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their digest, and all spans, for every row; no shuffle."""

    def run(batches):
        worker_state("pii", bool)  # lets go of other operators' memos
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = spans(text.as_py())
                base = [s for s in found if s[2] in BASE]
                n = [sum(s[2] == k for s in base) for k in BASE]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """text with each span, or union of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with all columns and rows, personal data replaced by placeholders."""
    at = documents.columns.index(text_col)

    def run(batches):
        worker_state("pii", bool)  # lets go of other operators' memos
        for batch in batches:
            texts, changed = [], False
            for text in batch.column(at):
                text = text.as_py()
                if found := spans(text):
                    text, changed = redacted(text, found), True
                texts.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)) if changed else batch

    return documents.mapInArrow(run, documents.schema)
