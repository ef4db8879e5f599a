"""Hashes of the words and word shingles of a text, in numpy."""

from __future__ import annotations

import numpy as np

#: texts longer than this are hashed piece by piece
PIECE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240817))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.array([6364136223846793005], np.uint64)
_BACK = np.array([pow(6364136223846793005, -1, 1 << 64)], np.uint64)
_FACTORS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: ASCII white space: space and 0x09 to 0x0D
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: everything below 0x80 that is no letter or digit
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), (_STEP if kind == "up" else _BACK)[0], np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(raw: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of bytes that are not ``apart``."""
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~apart[raw]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def _piece(raw: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = word_bounds(raw, apart)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * _power("up", len(raw))[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * _power("down", len(raw))[starts]), starts, ends


def located_words(text: str, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and end byte of each word of the text with A-Z lower-cased."""
    data = text.encode("utf-8", "surrogatepass").lower()
    if len(data) <= PIECE_BYTES:
        return _piece(np.frombuffer(data, np.uint8), apart)
    raw, parts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        end = min(at + PIECE_BYTES, len(raw))
        while end < len(raw):  # on to the next byte between words
            gap = np.flatnonzero(apart[raw[end : end + PIECE_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + PIECE_BYTES, len(raw))
        h, s, e = _piece(raw[at:end], apart)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def word_heads(text: str, apart: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hash of each word, then of its first bytes for each of the (increasing) sizes."""
    data = text.encode("utf-8", "surrogatepass").lower()
    hashes, starts, ends = located_words(text, apart)
    raw, out = np.frombuffer(data, np.uint8), [hashes]
    heads = np.full(len(starts), 7, np.uint64)
    for j in range(sizes[-1]):
        at = np.minimum(starts + j, ends - 1)
        heads = np.where(starts + j < ends, heads * _STEP[0] + _BYTE[raw[at]], heads)
        if j + 1 in sizes:
            out.append(mixed(heads))
    return out


def words(text: str, apart: np.ndarray = SPACES) -> np.ndarray:
    return located_words(text, apart)[0]


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the run of ``k`` words at each word; of a shorter text, of all its words as one."""
    n = len(hashes)
    if not n:
        return hashes
    if n < k:
        return mixed((hashes * _FACTORS[:n]).sum(dtype=np.uint64)[None] + np.uint64(n))
    out = hashes[: n - k + 1] * _FACTORS[0]
    for j in range(1, k):
        out += hashes[j : n - k + 1 + j] * _FACTORS[j]
    return mixed(out)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words."""
    return np.unique(runs(hashes, k))
