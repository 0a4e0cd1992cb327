"""Prefix-free parsing of byte strings, in arrays.

Rolling hashes of TRIGGER bytes pick one trigger for each window of ``match`` bytes: the least hash in it, the leftmost of
equals.  Consecutive windows with the same trigger make one phrase; neighbouring phrases overlap by match - 1 bytes, so each
window lies in exactly one phrase, and where equal windows occur, their phrases hold the trigger at the same place of them.
"""

from __future__ import annotations

import numpy as np

TRIGGER = 16
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_RUN = np.uint64(0xE7037ED1A0B428DB)  # odd, so that it has an inverse
_INVERSE = np.uint64(pow(int(_RUN), -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)
#: Windows whose triggers are looked for at once: their places, with those of the last window's hashes, fit _PLACE.
LIMIT = 1 << 23
_powers: list[np.ndarray] = []


def forget() -> None:
    """Frees the tables that a worker keeps."""
    _powers.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _BASES[0]
    return (x ^ x >> np.uint64(29)) * _BASES[1]


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes from each place on; k is built from powers of two."""
    h, have, out, at = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    for level in range(k.bit_length()):
        if k >> level & 1:
            part = h[at : len(data) - k + 1 + at]
            out = part if out is None else out * _BASES[4] + mixed(part)
            at += have
        if level + 1 < k.bit_length():
            h = h[:-have] * _BASES[level % 4] + mixed(h[have:])
            have *= 2
    return mixed(out)


def _sliding_least(keys: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (w - span)], keys[w - span :]) if w > span else keys


def _triggers(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of each w hashes, the leftmost of equals; a text may be longer than places that keys can hold."""
    out = np.empty(len(h) - w + 1, np.int64)
    for at in range(0, len(out), LIMIT):
        part = h[at : at + LIMIT + w - 1]
        places = np.arange(len(part), dtype=np.uint64)
        out[at : at + LIMIT] = (_sliding_least(part & ~_PLACE | places, w) & _PLACE).astype(np.int64) + at
    return out


def _run_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        up, down = np.full(n, _RUN, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def parse(data: np.ndarray, ends: np.ndarray, match: int, k: int = TRIGGER):
    """Phrases of texts that stand one after the other, each up to its end: (text, first window, windows, trigger hash, phrase hash)."""
    n = len(data)
    if n < match:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    h = rolling(data, k)
    trigger = _triggers(h, match - k + 1)
    starts = np.r_[0, ends[:-1]]
    windows = np.maximum(ends - starts - (match - 1), 0)
    used = np.repeat(starts - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
    text = np.repeat(np.arange(len(ends)), windows)
    trigger = trigger[used]
    first = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])]) if len(used) else used
    count = np.diff(np.r_[first, len(used)])
    a = used[first]
    b = a + count + match - k  # the hashes that lie wholly in the phrase
    up, down = _run_powers(len(h) + 1)
    total = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)]
    phrase = mixed((total[b] - total[a]) * down[a])
    return text[first], a - starts[text[first]], count, h[trigger[first]], phrase
