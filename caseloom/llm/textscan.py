"""Words and word windows of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than the six ASCII white-space characters.  Where identity rests on a word, its value is a
128-bit hash of all its bytes, as two halves.  Fingerprints of windows are polynomials modulo 2**64 over
such values, mixed afterwards; two families over the two halves decide where a window's identity rests on them alone.
"""

from __future__ import annotations

import hashlib

import numpy as np

from caseloom.llm.tasks import worker_cache

#: Bytes handled at once: the working arrays take about 60 times as much.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHIFTS = tuple(np.uint64(s) for s in (30, 27, 31))
#: Bytes of a word from which on it is hashed by itself.
LONG_WORD = 32
_KEYS = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 4, dtype=np.uint64)
_MASKS = np.array([2**(8 * k) - 1 for k in range(9)], np.uint64)
_MIXERS = tuple(np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> _SHIFTS[0])
    x *= _MIXERS[0]
    x ^= x >> _SHIFTS[1]
    x *= _MIXERS[1]
    x ^= x >> _SHIFTS[2]
    return x


class Family:
    """One family of fingerprints: byte values, a multiplier, and its powers with their inverses."""

    def __init__(self, seed: int):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.values = draw.integers(0, 2**64, 256, dtype=np.uint64)
        self.multiplier = (int(draw.integers(0, 2**62)) * 4 + 3) % 2**64
        self.inverse = pow(self.multiplier, -1, 2**64)
        self._powers = self._inverses = np.ones(1, np.uint64)

    def powers(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers) < count:
            count = max(count, 2 * len(self._powers))
            with np.errstate(over="ignore"):
                for name, base in (("_powers", self.multiplier), ("_inverses", self.inverse)):
                    steps = np.full(count, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self._powers, self._inverses

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed fingerprints of values[start:end] for each span."""
        powers, inverses = self.powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[:len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def family(seed: int) -> Family:
    known = worker_cache("textscan").setdefault("families", {})
    if seed not in known:
        known[seed] = Family(seed)
    return known[seed]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the index of each text's first word, one more at the end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    space = _SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[1:] = space
    before[0] = True
    after = before[1:].copy()
    after[:-1] = space[1:]
    after[-1] = True
    before = before[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    before[inner] = True
    closing = bounds[1:][bounds[1:] > 0] - 1
    after[closing] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """(2, words): the two halves of a 128-bit hash of each word.

    Two chains with keys of their own take in a word eight bytes at a time, each step a full mix; the halves are made of
    both.  Words of more than ``LONG_WORD`` bytes, a few, are hashed one by one.
    """
    raw = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    sizes = ends - starts
    one, two = (mix(sizes.astype(np.uint64) ^ key) for key in _KEYS[:2])
    own = slice(None)
    for at in range(0, LONG_WORD, 8):
        if at:
            own = np.flatnonzero(sizes > at)
        eight = eights[starts[own] + at] & _MASKS[np.minimum(sizes[own] - at, 8)]
        one[own] = mix(one[own] ^ eight)
        two[own] = mix((two[own] + eight) ^ _KEYS[2])
    out = np.stack([mix(one + mix(two)), mix(two ^ mix(one + _KEYS[3]))])
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[:, i] = np.frombuffer(hashlib.blake2b(raw[starts[i]:ends[i]].tobytes(), digest_size=16, key=b"word values").digest(), "<u8")
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 1) -> np.ndarray:
    own = family(seed)
    return own.spans(own.values[_LOWER[data] if lower else data], starts, ends)


def window_hashes(words: np.ndarray, first: np.ndarray, length: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, text): every window of ``length`` words that lies within one text, and the number of its text.

    A window starts at each word that has ``length - 1`` followers in its text, in order.
    """
    counts = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][text]
    return family(seed).spans(words, starts, starts + length), text
