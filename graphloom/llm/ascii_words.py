"""Words of whole texts as bytes, where only ASCII letters are lower-cased and every byte beyond ASCII belongs to a word."""

from __future__ import annotations

from collections.abc import Iterator

LETTERS = b"abcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"
#: Bytes of a text that are split at once, about; a piece ends where a word ends.
PIECE = 1 << 20


def table(kept: bytes) -> bytes:
    """For ``bytes.translate``: A-Z to a-z, ``kept`` and all bytes from 128 as they are, all others to a space."""
    own = set(kept)
    return bytes(b + 32 if 65 <= b <= 90 and b + 32 in own else b if b >= 128 or b in own else 32 for b in range(256))


def words(text: str | None, translation: bytes) -> Iterator[list[bytes]]:
    """Lists of the text's words (null: none) in their order, of one piece each, so that a very long text needs no list of all its words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(translation)
    a = 0
    while a < len(data):
        b = data.find(b" ", a + PIECE)
        b = len(data) if b < 0 else b
        yield data[a:b].split()
        a = b
