r"""Words ``[^\x20\x09-\x0D]+`` of blocks of texts and their hashes, in numpy.

A word's hash is its first and last eight bytes and its length, mixed (words as
long as 16 bytes, all of a block at once), or xxh3 of the whole word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

M1, M2, ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_ALL = np.uint64(2**64 - 1)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * M1
    x = (x ^ (x >> _S27)) * M2
    return x ^ (x >> _S31)


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null is empty."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def blocks(texts, size: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts, lowered, in lists of about ``size`` bytes together (a text is never cut)."""
    held, total = [], 0
    for text in texts:
        held.append(lowered(text))
        total += len(held[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one piece, first and last place of each word there, and the number of words of each text."""
    data = b" ".join(texts) + b" "
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.r_[0, edge] if not space[0] else edge
    starts, ends = edge[0::2], edge[1::2]
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, starts, ends, np.diff(np.searchsorted(starts, first))


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    length = ends - starts
    lane = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    unused = (64 - 8 * np.minimum(length, 8)).astype(np.uint64)
    out = mix(mix(lane[starts] & (_ALL >> unused)) + length.astype(np.uint64))
    two = np.flatnonzero((length > 8) & (length <= 16))
    out[two] = mix(out[two] ^ mix(lane[ends[two] - 8] + ODD))
    more = np.flatnonzero(length > 16)
    out[more] = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts[more].tolist(), ends[more].tolist())]
    return out
