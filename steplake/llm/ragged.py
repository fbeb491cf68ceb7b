"""Ragged numpy arrays of the words of many texts."""

from __future__ import annotations

import functools

import numpy as np

#: Bytes hashed at once.
PIECE = 1 << 20
SPACES = b"\t\n\x0b\x0c\r "
#: An odd base and its inverse modulo 2 ** 64.
BASE = 0x5851F42D4C957F2D
CLASS = np.full(256, 2, np.uint8)  # marks; letters, digits and bytes over 127 are 1, white space is 0
CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
CLASS[[*SPACES]] = 0


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(PIECE + 1, BASE, np.uint64), np.full(PIECE + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    return up, down


def token_hashes(data: bytes, classes: np.ndarray = CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each token, a run of bytes of one class above 0.

    A prefix sum of bytes times powers of an odd base gives every token's
    polynomial hash at once. Pieces of bounded size end at white space (a run
    without any is cut where the piece ends).
    """
    hashes, starts, ends, at = [], [], [], 0
    up, down = powers()
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            end = max((data.rfind(c, at, end) for c in (b" ", b"\n")), default=-1) + 1 or end
        b = np.frombuffer(data, np.uint8, end - at, at)
        c = np.concatenate([[0], classes[b], [0]])
        edge = np.flatnonzero(c[1:] != c[:-1])
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
        first, last = edge[:-1], edge[1:]
        on = c[first + 1] > 0
        first, last = first[on], last[on]
        hashes.append((run[last] - run[first]) * down[first])
        starts.append(first + at)
        ends.append(last + at)
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*starts, none]), np.concatenate([*ends, none])
