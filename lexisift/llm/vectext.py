"""Words and pieces of many texts at once, as numpy arrays over their UTF-8 bytes.

Equal byte strings have equal hashes everywhere, in all processes. ``word_hash`` mixes eight bytes at a time and takes a
BLAKE2 digest of what is longer than 64. ``span_hash`` is a polynomial modulo 2**64, which strings of 1024 bytes can be
made to collide in: it only groups what is compared byte by byte afterwards.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "base"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = _INVERSE if inverse else _BASE
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:  # longer ones are made anew each time, so that workers stay small
            _POWERS[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(raw: np.ndarray) -> np.ndarray:
    """prefix[i]: the polynomial of the first i bytes."""
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[raw] * powers(len(raw)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums), True)[start] + (end - start).astype(np.uint64))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LONGEST = 64


def eights(raw: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on, as one number; zeros past the end."""
    out = np.zeros(len(raw) + 8, np.uint64)
    out[: len(raw)] = raw
    for k in (1, 2, 4):
        out[:-k] |= out[k:] << np.uint64(8 * k)
    return out


def word_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, wide: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the bytes from start to end."""
    wide, size = eights(raw) if wide is None else wide, end - start
    out = mix((wide[start] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _STEP))
    rest = np.flatnonzero((size > 8) & (size <= _LONGEST))
    at = 8
    while len(rest):
        left = size[rest] - at
        out[rest] = mix(out[rest] * _STEP + (wide[start[rest] + at] & _KEEP[np.minimum(left, 8)]))
        rest, at = rest[left > 8], at + 8
    for i in np.flatnonzero(size > _LONGEST):
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def piece_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A key of each piece. Up to seven bytes the key is the piece itself with its length; longer ones have the highest bit
    and a hash."""
    wide, size = eights(raw), end - start
    key = (wide[start] & _KEEP[np.minimum(size, 7)]) | (size.astype(np.uint64) << np.uint64(56))
    long_ = np.flatnonzero(size > 7)
    key[long_] = word_hash(raw, start[long_], end[long_], wide) | np.uint64(1 << 63)
    return key


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a longest run without the six ASCII white-space bytes, within a row."""
    inside = np.zeros(len(raw) + 1, bool)
    np.logical_not(SPACE[raw], out=inside[: len(raw)])
    start = inside[: len(raw)].copy()
    start[1:] &= ~inside[: len(raw) - 1] if len(raw) else True
    rows = np.diff(offsets)
    first = offsets[:-1][rows > 0]
    start[first] = inside[first]
    stop = inside[: len(raw)] & ~inside[1:]
    last = offsets[1:][rows > 0] - 1
    stop[last] = inside[last]
    begin = np.flatnonzero(start)
    return begin, np.flatnonzero(stop) + 1, np.searchsorted(offsets, begin, "right") - 1


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    if total:
        step[0] = starts[0]
        step[np.cumsum(lengths)[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
        np.cumsum(step, out=step)
    return step


class RaggedCache:
    """A piece of bytes -> a run of numbers; open addressing in numpy, so that many pieces are looked up at once.

    Pieces are found by their keys; the bytes of those whose key is a hash are kept and compared. Beyond ``most`` pieces
    the cache starts anew, which bounds memory and changes no result.
    """

    def __init__(self, kind=np.uint32, most: int = 1 << 21):
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.bits, self.n = 16, 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.data, self.used = np.zeros(1 << 16, self.kind), 0
        self.text_start, self.text_length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        mask = (1 << self.bits) - 1
        at = (mix(keys) & np.uint64(mask)).astype(np.int64)
        found = self.slot[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            now = self.slot[at[wrong]]
            found[wrong] = now
            wrong = wrong[(now >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return found

    def _place(self, keys: np.ndarray, index: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at, rest = (mix(keys) & np.uint64(mask)).astype(np.int64), np.arange(len(keys))
        while len(rest):
            free = self.slot[at[rest]] < 0
            mine = rest[free]
            self.slot[at[mine]] = index[mine]  # of several that want a slot the last gets it
            won = self.slot[at[mine]] == index[mine]
            self.keys[at[mine[won]]] = keys[mine[won]]
            rest = np.concatenate([mine[~won], rest[~free]])
            at[rest] = (at[rest] + 1) & mask

    def add(self, keys: np.ndarray, lengths: np.ndarray, data: np.ndarray, text_lengths: np.ndarray, text: np.ndarray) -> None:
        """keys: distinct and absent. A caller that adds more than fits looks its keys up again afterwards."""
        if self.n and self.n + len(keys) > self.most:
            self.clear()
        n = self.n + len(keys)
        if n * 2 > 1 << self.bits:
            old, own = self.keys[self.slot >= 0], self.slot[self.slot >= 0]
            self.bits = int(n * 2 - 1).bit_length() + 1
            self.keys, self.slot = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._place(old, own)
        if n > len(self.start):
            for name in ("start", "length", "text_start", "text_length"):
                setattr(self, name, np.resize(getattr(self, name), 2 * n))
        if self.used + len(data) > len(self.data):
            self.data = np.resize(self.data, 2 * (self.used + len(data)))
        if self.text_used + len(text) > len(self.text):
            self.text = np.resize(self.text, 2 * (self.text_used + len(text)))
        self.data[self.used : self.used + len(data)] = data
        self.start[self.n : n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : n] = lengths
        self.text[self.text_used : self.text_used + len(text)] = text
        self.text_start[self.n : n] = self.text_used + np.cumsum(text_lengths) - text_lengths
        self.text_length[self.n : n] = text_lengths
        self._place(keys, np.arange(self.n, n, dtype=np.int32))
        self.n, self.used, self.text_used = n, self.used + len(data), self.text_used + len(text)

    def others(self, found: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the pieces are not the ones found for them, though their keys are equal."""
        size = end - start
        check = np.flatnonzero((size > 7) & (found >= 0))
        at, n = found[check], size[check]
        wrong = self.text_length[at] != n
        same = np.flatnonzero(~wrong)
        if len(same):
            n = n[same]
            differs = self.text[spread(self.text_start[at[same]], n)] != raw[spread(start[check[same]], n)]
            wrong[same] = np.add.reduceat(differs, np.cumsum(n) - n) > 0
        return check[wrong]

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the runs, and the runs one after the other."""
        lengths = self.length[index].astype(np.int64)
        return lengths, self.data[spread(self.start[index], lengths)]


def cached_runs(cache: RaggedCache, raw: np.ndarray, start: np.ndarray, end: np.ndarray, make, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all pieces of raw. make(i): lengths and data of the pieces i, called for those that are not cached, and for
    those whose key is that of another piece."""
    keys = piece_keys(raw, start, end) if keys is None else keys
    found = cache.find(keys)
    lost = np.flatnonzero(found < 0)
    if len(lost):
        new, first = np.unique(keys[lost], return_index=True)
        i = lost[first]
        if len(new) <= cache.most:
            lengths, data = make(i)
            size = np.where(end[i] - start[i] > 7, end[i] - start[i], 0)
            before = cache.n
            cache.add(new, lengths, data, size, raw[spread(start[i], size)])
        if len(new) > cache.most or cache.n < before + len(new):  # too many at once, or it began anew
            if len(np.unique(keys)) <= cache.most:
                return cached_runs(cache, raw, start, end, make, keys)
            half = len(keys) // 2
            parts = [cached_runs(cache, raw, start[at:to], end[at:to], lambda j, at=at: make(j + at), keys[at:to]) for at, to in ((0, half), (half, len(keys)))]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        found[lost] = cache.find(keys[lost])
    wrong = cache.others(found, raw, start, end)
    if not len(wrong):
        return cache.take(found)
    own_lengths, own = make(wrong)
    lengths = cache.length[found].astype(np.int64)
    lengths[wrong] = own_lengths
    to, out = np.cumsum(lengths) - lengths, np.empty(int(lengths.sum()), cache.kind)
    good = np.ones(len(found), bool)
    good[wrong] = False
    out[spread(to[good], lengths[good])] = cache.take(found[good])[1]
    out[spread(to[wrong], lengths[wrong])] = own
    return lengths, out
