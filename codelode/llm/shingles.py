"""Word shingles of many texts at once, as 48-bit hashes, without a Python step per word.

A word is a longest run of ``a-z``, ``0-9`` and ``_`` of the lower-cased text. Texts are laid end to end
as bytes; words are found by comparing neighbours, hashed by differences of one running polynomial, and
their runs of ``width`` words by mixing the word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_WORD = np.zeros(256, dtype=bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _WORD[_c] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text taken at once: arrays of eight times this size stay near the cache.
SPAN = 400_000
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, SPAN * 2), base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def spans(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts lower-cased and encoded, in runs of about ``SPAN`` bytes: index of the first, the run."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        if run and (size + len(data) > SPAN or len(run) >= 60_000):
            yield first, run
            first, run, size = i, [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run


def words(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of every word of the run, in order: the index of its text, its hash."""
    data = np.frombuffer(b"\n".join([*run, b""]), dtype=np.uint8)
    ends_at = np.cumsum(np.fromiter((len(x) + 1 for x in run), dtype=np.int64, count=len(run)))
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _power(len(data) + 1)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)))
    value = (running[end] - running[start]) * inverse[start]
    return np.searchsorted(ends_at, start, side="right"), mix(value + (end - start).astype(np.uint64))


def shingle_sets(run: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text; two 64-bit hashes of each text's word sequence; ``text << 48 | shingle``, sorted and distinct."""
    doc, value = words(run)
    count = np.bincount(doc, minlength=len(run))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    whole = np.zeros((2, len(run)), dtype=np.uint64)
    for i, salt in enumerate((0x51ED270B, 0x2545F491)):
        np.add.at(whole[i], doc, mix(value ^ mix(place.astype(np.uint64) + np.uint64(salt))))
    n = max(0, len(doc) - width + 1)
    if n:
        mixed = value[:n].copy()
        for i in range(1, width):
            mixed = mix(mixed * np.uint64(0xD6E8FEB86659FD93) + value[i : n + i])
        same = doc[:n] == doc[width - 1 :]
        keys = np.unique((doc[:n][same].astype(np.uint64) << np.uint64(48)) | (mixed[same] >> np.uint64(16)))
    else:
        keys = np.empty(0, np.uint64)
    return count, whole[0], whole[1], keys


def minhash_bytes(keys: np.ndarray, n: int, places: int, seed: int = 1) -> np.ndarray:
    """``n x places`` bytes: at each place the lowest byte of the least hash of a text's shingles; 0 where it has none."""
    out = np.zeros((n, places), dtype=np.uint8)
    doc = (keys >> np.uint64(48)).astype(np.int64)
    if not len(keys):
        return out
    begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1, 1 << 63, places, dtype=np.uint64)
    shingle = mix(keys & np.uint64((1 << 48) - 1))
    for k in range(places):
        value = ((shingle * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
        out[doc[begin], k] = np.minimum.reduceat(value, begin) & 255
    return out


def jaccard(left: list[str], right: list[str], width: int) -> np.ndarray:
    """Similarity of each pair: distinct shingles found in both, divided by those found in either; 0 where neither has any."""
    out = np.zeros(len(left))
    both = [x for pair in zip(left, right) for x in pair]
    at = 0
    for first, run in spans(both):
        if first % 2:  # a pair must not be torn: its left text joins this run
            run = [(both[first - 1] or "").lower().encode("utf-8", "surrogatepass"), *run]
            first -= 1
        run = run[: len(run) - len(run) % 2]
        keys = shingle_sets(run, width)[3]
        if not len(keys):
            continue
        pair = keys >> np.uint64(49) << np.uint64(48) | (keys & np.uint64((1 << 48) - 1))
        union, seen = np.unique(pair, return_counts=True)
        of = (union >> np.uint64(48)).astype(np.int64)
        total = np.bincount(of, minlength=len(run) // 2)
        shared = np.bincount(of[seen == 2], minlength=len(run) // 2)
        at = first // 2
        out[at : at + len(total)] = shared / np.maximum(total, 1)
    return out
