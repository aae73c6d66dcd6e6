"""Secret scan: fixed patterns, and windows of high Shannon entropy inside candidate strings.

Candidates are runs of 20 or more characters of the base64 alphabets. Inside a candidate each character class has its own maximal
runs; a window slides over each run and its entropy is kept up to date by adding the entering and taking off the leaving character's count, as are
its numbers of digits, upper- and lower-case letters and separators. Windows at or above the class's threshold that have
the class's mixture join to one span.

Classes of one case or of whole tokens stop at separators (`/ _ - =`), so paths and slugs fall into words that are too short. Base64 runs go over
separators, and there a window needs many letters of both cases, a digit and few separators. Longer tokens need less entropy, and tokens of letters
alone need more of it. The allow-list leaves out what is no secret: UUIDs, placeholders and literal values of the caller's; the rest of
such a candidate is scanned. It never suppresses the fixed patterns.

Defined cases: a null or empty text has no spans; whole texts are scanned whatever their length; each of several repeated rows has its
spans; spans are sorted by start, then by kind in the order of `KINDS`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from math import log2
from typing import NamedTuple

from pyspark.sql import DataFrame

from casework.llm.spans import Span, replaced, spans_of

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey")
# A run shorter than the least length holds no longer one, so the least length can stand in these two patterns.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


class CharClass(NamedTuple):
    """Characters, window length, least entropy (bits a character) and mixture of one class: least digits, least letters of either case, most separators."""

    kind: str
    run: str
    window: int
    bits: float
    digits: int = 1
    each_case: int = 0
    separators: int = 0


#: A uniform draw of 20 characters has about 3.4 bits from 16 symbols, 3.8 from 36 and 4.1 from 64; one of 32 has 4.5 from 52.
CLASSES = (
    CharClass("entropy_hex", r"[0-9a-f]+|[0-9A-F]+", 20, 3.0),
    CharClass("entropy_lower", r"[0-9a-z]+", 20, 3.6),
    CharClass("entropy_upper", r"[0-9A-Z]+", 20, 3.6),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]+", 20, 3.9, each_case=4, separators=3),
    CharClass("entropy_token", r"[A-Za-z0-9+]+", 32, 3.6),
    CharClass("entropy_letters", r"[A-Za-z]+", 32, 4.3, digits=0, each_case=6),
)
KINDS = (*BASE, *(c.kind for c in CLASSES))
_BETWEEN = r"(?<![A-Za-z0-9+]){}(?![A-Za-z0-9+])"
_UUID = re.compile(_BETWEEN.format(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"))
PLACEHOLDERS = ("example", "placeholder", "changeme", "dummy", "sample", "xxxx", "redacted")
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS), re.IGNORECASE | re.ASCII)
#: Candidates consist of tokens of these characters and of separators.
_TOKEN = re.compile(r"[A-Za-z0-9+]+")
REACH = 64


def open_parts(run: str, literals: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Parts of a candidate run that the allow-list leaves open, in order.

    UUIDs and literals are allowed between separators. A placeholder word allows the token around it, in a long token only
    `REACH` characters on either side.
    """
    if run in literals:
        return []
    closed = [m.span() for m in _UUID.finditer(run)]
    for value in literals:
        closed += [m.span() for m in re.finditer(_BETWEEN.format(re.escape(value)), run)] if value and value in run else []
    if _PLACEHOLDER.search(run):
        for token in _TOKEN.finditer(run):
            closed += [(max(token.start(), m.start() - REACH), min(token.end(), m.end() + REACH)) for m in _PLACEHOLDER.finditer(run, *token.span())]
    parts, at = [], 0
    for start, end in sorted(closed):
        if start > at:
            parts.append((at, start))
        at = max(at, end)
    return [*parts, (at, len(run))] if at < len(run) else parts


def _part(character: str) -> int:
    """Digit, upper case, lower case, separator; a plus sign is a letter of no case."""
    if character.isdigit():
        return 0
    if character.isupper():
        return 1
    return 2 if character.islower() else 3 if character != "+" else 4


def high_windows(run: str, c: CharClass) -> Iterable[tuple[int, int]]:
    """Joined spans of the windows with the class's mixture whose entropy is `bits` or more.

    With counts n the entropy is log2(window) - sum(n * log2(n)) / window; one step changes two counts, so it costs the same
    for every window length.
    """
    window = c.window
    if len(run) < window:
        return
    weight = [0.0, *(n * log2(n) for n in range(1, window + 1))]
    counts: dict[str, int] = {}
    parts = [0] * 5
    total, most, start, end = 0.0, window * (log2(window) - c.bits) + 1e-9, -1, -1
    for i, entering in enumerate(run):
        if i >= window:
            leaving = run[i - window]
            n = counts[leaving]
            total += weight[n - 1] - weight[n]
            counts[leaving] = n - 1
            parts[_part(leaving)] -= 1
        n = counts.get(entering, 0)
        total += weight[n + 1] - weight[n]
        counts[entering] = n + 1
        parts[_part(entering)] += 1
        if i < window - 1 or total > most:
            continue
        if parts[0] >= c.digits and min(parts[1], parts[2]) >= c.each_case and parts[3] <= c.separators:
            if i - window + 1 > end:
                if end > start:
                    yield start, end
                start = i - window + 1
            end = i + 1
    if end > start:
        yield start, end


def finder(classes: tuple[CharClass, ...] = CLASSES, literals: frozenset[str] = frozenset()) -> Callable[[str], list[Span]]:
    runs = [(c, re.compile(c.run)) for c in classes]
    order = {k: i for i, k in enumerate((*BASE, *(c.kind for c in classes)))}

    def find(text: str) -> list[Span]:
        lower, spans = text.lower(), []
        if any(cue in lower for cue in _CUES):
            spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
        for m in _CANDIDATE.finditer(text):
            for part in open_parts(m[0], literals):
                for c, run in runs:
                    for r in run.finditer(m[0], *part):
                        spans += [(c.kind, m.start() + r.start() + a, m.start() + r.start() + b) for a, b in high_windows(r[0], c)]
        return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))

    return find


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: tuple[CharClass, ...] = CLASSES,
         literals: frozenset[str] = frozenset()) -> DataFrame:
    """id, spans (kind, start, end in code points, end exclusive), one row per row of `docs`."""
    return spans_of(docs, finder(classes, literals), key, text)


def redact(docs: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES,
           literals: frozenset[str] = frozenset()) -> DataFrame:
    """The rows of `docs` with each secret replaced by its kind in brackets."""
    return replaced(docs, finder(classes, literals), text, lambda kind: f"[{kind.upper()}]")
