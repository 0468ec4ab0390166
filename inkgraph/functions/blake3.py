"""BLAKE3 over arrays: all chunks of all inputs go through each step together."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Fixed values of the published specification: initial state, message permutation, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64

#: Words of the message in the order in which each round takes them.
_ORDER = [list(range(16))]
for _ in range(6):
    _ORDER.append([_ORDER[-1][i] for i in PERMUTATION])


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint32(by) | x << np.uint32(32 - by)


def _compress(value: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Next values (8, n) of n states (8, n) with a block's words (16, n) each. The four columns, then the four
    diagonals, of every state are mixed at once."""
    n = value.shape[1]
    a, b, c = value[:4].copy(), value[4:].copy(), np.repeat(np.array(IV[:4], np.uint32)[:, None], n, axis=1)
    d = np.stack((counter & 0xFFFFFFFF, counter >> 32, length, flags)).astype(np.uint32)
    turn = lambda x, by: np.roll(x, -by, axis=0)
    for order in _ORDER:
        for first in (0, 8):
            for word, (r, s) in ((order[first : first + 8 : 2], (16, 12)), (order[first + 1 : first + 8 : 2], (8, 7))):
                a = a + b + words[word]
                d = _rotated(d ^ a, r)
                c = c + d
                b = _rotated(b ^ c, s)
            # diagonals become columns, and columns again
            b, c, d = (turn(x, by if first == 0 else 4 - by) for x, by in ((b, 1), (c, 2), (d, 3)))
    return np.concatenate((a ^ c, b ^ d))


def blake3_many(inputs: Sequence[bytes]) -> list[str]:
    """Hex digests of all inputs."""
    if not inputs:
        return []
    owner, counter, single, parts = [], [], [], []
    for i, data in enumerate(inputs):
        chunks = max(1, -(-len(data) // CHUNK))
        for k in range(chunks):
            owner.append(i)
            counter.append(k)
            single.append(chunks == 1)
            parts.append(data[k * CHUNK : (k + 1) * CHUNK])
    sizes = np.array([len(p) for p in parts], np.int64)
    padded = np.frombuffer(b"".join(p.ljust(CHUNK, b"\0") for p in parts), "<u4").reshape(len(parts), CHUNK // BLOCK, 16)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    counter, single = np.array(counter, np.int64), np.array(single)
    value = np.repeat(np.array(IV, np.uint32)[:, None], len(parts), axis=1)
    for step in range(int(blocks.max())):
        on = np.flatnonzero(blocks > step)
        last = blocks[on] == step + 1
        flags = np.where(last, CHUNK_END | np.where(single[on], ROOT, 0), 0) | (CHUNK_START if step == 0 else 0)
        length = np.where(last, sizes[on] - step * BLOCK, BLOCK)
        value[:, on] = _compress(value[:, on], padded[on, step].T, counter[on], length, flags)
    # neighbours join, level by level; one without a neighbour goes up as it is
    nodes = [[] for _ in inputs]
    for k, i in enumerate(owner):
        nodes[i].append(value[:, k])
    while pairs := [(i, k) for i, own in enumerate(nodes) for k in range(0, len(own) - 1, 2)]:
        words = np.stack([np.concatenate((nodes[i][k], nodes[i][k + 1])) for i, k in pairs], axis=1)
        n = len(pairs)
        flags = np.array([PARENT | (ROOT if len(nodes[i]) == 2 else 0) for i, _ in pairs])
        start = np.repeat(np.array(IV, np.uint32)[:, None], n, axis=1)
        joined = _compress(start, words, np.zeros(n, np.int64), np.full(n, BLOCK), flags)
        above: dict[int, list] = {}
        for at, (i, _) in enumerate(pairs):
            above.setdefault(i, []).append(joined[:, at])
        for i, own in above.items():
            nodes[i] = own + ([nodes[i][-1]] if len(nodes[i]) % 2 else [])
    return [own[0].astype("<u4").tobytes().hex() for own in nodes]


def blake3_hex(data: bytes) -> str:
    return blake3_many([data])[0]
