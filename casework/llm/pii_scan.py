"""Personal data: an Aho-Corasick automaton finds anchors, local parsers expand them and validate the boundaries.

Anchors are at-signs, plus signs and digits, URL schemes, and identifier cues (IBAN, account, SSN). At each anchor a parser of its kind
expands to the left and right; the automaton reads the text once whatever the number of kinds. Base kinds are leftmost and
non-overlapping per kind; a match that fails its check is dropped and not tried again inside. `address` (a URL with user data or a numeric host, a
mailto or tel address) and `account` (an IBAN with right check digits, an account or social security number after its cue) come on top.

Defined cases: a null or empty text has no spans; whole texts are scanned whatever their length; repeated rows have their spans each;
spans are sorted by start, then by kind in the order of `KINDS`.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from casework.llm.spans import Span, spans_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_UPPER = re.compile(r"[A-Z]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>()\[\]{}]+")
_QUAD_HOST = re.compile(r"[0-9]+(?:\.[0-9]+){3}(?::[0-9]+)?")
_TARGET = re.compile(r"[A-Za-z0-9._%+@-]{3,}")
_IBAN = re.compile(r"[:#\s]{0,3}(?:number|no\.?)?[:#\s]{0,3}([A-Z]{2}[0-9]{2})(?=\x20?[A-Z0-9])", re.IGNORECASE | re.ASCII)
_IBAN_SIGN = re.compile(r"\x20?[A-Za-z0-9]")
#: Characters of an IBAN by country. Fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20,
    "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_DATE = re.compile(r"(?:1[89]|20)[0-9]{2}[\x20-](?:0?[1-9]|1[0-2])[\x20-](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[\x20-](?:0?[1-9]|1[0-2])[\x20-](?:1[89]|20)[0-9]{2}")
_ACCOUNT = re.compile(r"(?:\s?(?:number|no\.?|nr\.?))?[:#=\s]{0,3}([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9])", re.IGNORECASE)
_SSN = re.compile(r"(?:\s?(?:number|no\.?))?[:#=\s]{0,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])", re.IGNORECASE)
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
CUES = {"account": _ACCOUNT, "acct": _ACCOUNT, "ssn": _SSN, "social security": _SSN}


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban(value: str) -> bool:
    """Length of the country and check digits, spaces and case apart."""
    plain = value.replace(" ", "").upper()
    return len(plain) == IBAN_LENGTHS.get(plain[:2]) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _account_of(text: str, word: str, end: int) -> tuple[int, int] | None:
    """The number after a cue that ends at `end`. An IBAN has as many characters as its country's, whatever words follow; a date is no number."""
    if word != "iban":
        m = CUES[word].match(text, end)
        return m.span(1) if m and not _DATE.fullmatch(m[1]) else None
    m = _IBAN.match(text, end)
    if not m:
        return None
    at = m.end(1)
    for _ in range(IBAN_LENGTHS.get(m[1][:2].upper(), 4) - 4):
        sign = _IBAN_SIGN.match(text, at)
        if not sign:
            return None
        at = sign.end()
    closed = not (text[at:at + 1].isascii() and text[at:at + 1].isalnum())
    return (m.start(1), at) if closed and iban(text[m.start(1):at]) else None


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    """One automaton per Python worker, for texts with A-Z lower-cased; values are (what, text)."""
    found = {"@": "at", "+": "plus"} | {str(d): "digit" for d in range(10)} | {s: "scheme" for s in SCHEMES}
    found |= dict.fromkeys(("iban", *CUES), "cue")
    automaton = ahocorasick.Automaton()
    for text, what in found.items():
        automaton.add_word(text, (what, text))
    automaton.make_automaton()
    return automaton


def _address(text: str, start: int, end: int) -> tuple[int, int] | None:
    if text[end - 1] == ":":
        m = _TARGET.match(text, end)
        return (start, m.end()) if m else None
    m = _AUTHORITY.match(text, end)
    if m and (("@" in m[0] and m[0][-1] != "@") or _QUAD_HOST.fullmatch(m[0])):
        return start, m.end()
    return None


def _lower(text: str) -> str:
    """A-Z lower-cased and nothing else, so that every offset stays."""
    return text.lower() if text.isascii() else _UPPER.sub(lambda m: m[0].lower(), text)


def find(text: str) -> list[Span]:
    spans: list[Span] = []
    done = dict.fromkeys(KINDS, 0)  # where the last match of each kind ended, whether kept or dropped
    run_end = 0  # of the digit run that the last digit anchor stood in
    for last, (what, word) in _anchors().iter(_lower(text)):
        start = last - len(word) + 1
        if what == "at":
            left = start
            while left > done["email"] and text[left - 1] in _LOCAL:
                left -= 1
            m = _DOMAIN.match(text, last + 1) if left < start else None
            if m:
                done["email"] = m.end()
                spans.append(("email", left, m.end()))
        elif what == "digit":
            if start >= done["card"] and (m := _CARD.match(text, start)):
                done["card"] = m.end()
                digits = re.sub(r"[\x20-]", "", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", *m.span()))
            if start >= max(done["ip"], run_end):
                # A start further inside the same run fails where this one does.
                run_end = start + 1
                while run_end < len(text) and text[run_end] in "0123456789":
                    run_end += 1
                if text[run_end:run_end + 1] == "." and (m := _QUAD.match(text, start)):
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                        spans.append(("ip", *m.span()))
        elif what == "plus":
            if start >= done["phone"] and (m := _PHONE.match(text, start)):
                done["phone"] = m.end()
                if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
                    spans.append(("phone", *m.span()))
        elif what == "scheme":
            if start >= done["address"] and (at := _address(text, start, last + 1)):
                done["address"] = at[1]
                spans.append(("address", *at))
        elif start >= done["account"]:
            if found := _account_of(text, word, last + 1):
                done["account"] = found[1]
                spans.append(("account", *found))
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, spans (kind, start, end in code points, end exclusive), one row per row of `docs`."""
    return spans_of(docs, find, key, text)
