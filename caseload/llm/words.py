"""Words of whole texts in bounded memory: translate the bytes, then split them a chunk at a time."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text split at a time; a chunk ends between words.
CHUNK = 1 << 20


def lowering(separators: bytes) -> bytes:
    """A table for ``bytes.translate``: A-Z in lower case, every separator a blank."""
    table = bytearray(range(256))
    for upper in range(65, 91):
        table[upper] = upper + 32
    for byte in separators:
        table[byte] = 32
    return bytes(table)


def chunks(text: bytes, table: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of ``text`` in order, in lists of about ``size`` bytes."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
