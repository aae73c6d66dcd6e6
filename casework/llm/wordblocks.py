"""Words of a text inside a Python task, in blocks, so that a very long text never becomes one list of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: str, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """UTF-8 words (runs of anything but ASCII white space) with A-Z lower-cased, about `block` bytes of text at a time."""
    data, at = text.encode("utf-8", "surrogatepass").lower(), 0
    while at < len(data):
        cut = _SPACE.search(data, min(len(data), at + block))
        end = cut.start() if cut else len(data)
        if words := data[at:end].split():
            yield words
        at = end
