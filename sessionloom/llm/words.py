"""Word hashing with numpy, used inside Python tasks; a word is ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes."""

from __future__ import annotations

from functools import cache

import numpy as np

PIECE = 1 << 15
_U = np.uint64


def _mixed(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd-ish 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTES = _mixed(256, 1)
_STEP = _U(0xD1342543DE82EF95)
_IS_WS = np.zeros(256, bool)
_IS_WS[[32, 9, 10, 11, 12, 13]] = True


def word_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start byte and length of each word of ``data``: a sum of byte values times powers of an odd constant, counted from the word's start."""
    ws = _IS_WS[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(ws[1:] != ws[:-1]) + 1
    if len(data) and not ws[0]:
        edges = np.concatenate(([0], edges))
    if len(edges) % 2:
        edges = np.concatenate((edges, [len(data)]))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), _U)
    up, down = _powers()
    first, after = 0, 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            at = int(starts[first])  # a piece of whole words of about PIECE bytes, in which sums are taken
            after = max(first + 1, int(np.searchsorted(ends, at + PIECE)))
            end = int(ends[after - 1])
            if end - at > PIECE:  # one long word
                out[first] = _long_word(data[at:end])
            else:
                sums = np.zeros(end - at + 1, _U)
                np.cumsum(_BYTES[np.frombuffer(data, np.uint8, end - at, at)] * up[: end - at], out=sums[1:])
                s, e = starts[first:after] - at, ends[first:after] - at
                out[first:after] = (sums[e] - sums[s]) * down[s]
            first = after
        lengths = ends - starts
        return mix(out + lengths.astype(_U)), starts, lengths


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate(([_U(1)], np.full(PIECE, x, _U)))) for x in (_STEP, _U(pow(int(_STEP), -1, 1 << 64))))


def _long_word(word: bytes) -> np.uint64:
    """The same sum for a word of any length, piece by piece."""
    up = _powers()[0]
    total, factor = _U(0), _U(1)
    for i in range(0, len(word), PIECE):
        part = _BYTES[np.frombuffer(word[i : i + PIECE], np.uint8)]
        total += (part * up[: len(part)]).sum(dtype=_U) * factor
        factor *= up[PIECE]
    return total


def batch_words(texts: list[bytes], max_bytes: int = 1 << 22):
    """Yields (first text, word hashes, offsets): hashes of the words of consecutive texts; offsets[i]:offsets[i+1] are those of text first+i."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < max_bytes):
            size += len(texts[j]) + 1
            j += 1
        hashes, starts, _ = word_table(b"\n".join(texts[i:j]))
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        yield i, hashes, np.concatenate(([0], np.searchsorted(starts, ends)))
        i = j


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values; the last n-1 places are left out."""
    with np.errstate(over="ignore"):
        m = len(hashes) - n + 1
        if m <= 0:
            return np.zeros(0, _U)
        out = np.zeros(m, _U)
        for k in range(n):
            out = out * _STEP + hashes[k : k + m]
        return mix(out)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
