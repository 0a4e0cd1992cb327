"""Words of texts as UTF-8 bytes: runs of digits, of A-Z and a-z in lower case, and of all that is not ASCII."""

from __future__ import annotations

import numpy as np

_KEPT = [b for b in range(256) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80]
#: A letter A-Z becomes its lower case, another word byte itself, anything else a space.
_TO_WORDS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text; none for null."""
    return text.translate(_TO_WORDS).split() if text else []


def padded(found: list[bytes]) -> bytes:
    """Words with a space before, between and behind them: a window's words occur in it where the window's padded form does."""
    return b" %b " % b" ".join(found) if found else b" "


def starts(lengths: np.ndarray) -> np.ndarray:
    """Where runs of these lengths start, one behind the other."""
    return np.cumsum(lengths) - lengths
