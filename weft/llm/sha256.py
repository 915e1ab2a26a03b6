"""SHA-256 over many messages at once, with states that can be copied, stored and resumed.

The messages are runs of digests in lowercase hex.  Such a digest is 64 bytes, one block of
the hash, so the state before a child is the state after the blocks of the children before it:
eight 32-bit words, 32 bytes when stored.  All arrays have one column per message.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

U = np.uint32


def _primes(n: int) -> list[int]:
    out, x = [], 2
    while len(out) < n:
        if all(x % p for p in out):
            out.append(x)
        x += 1
    return out


def _root3(x: int) -> int:
    """Integer part of the cube root."""
    r = round(x ** (1 / 3))
    while r ** 3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


#: by the standard's rule: 32 bits behind the point of the primes' square and cube roots
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], U)
ROUND = [U(_root3(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
#: two hex letters of every byte
HEX = np.frombuffer(bytes(range(256)).hex().encode(), np.uint8).reshape(256, 2)


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> U(n)) | (x << U(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) after one block (16, n) each."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> U(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> U(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the blocks (16, n) of their hex text."""
    raw = np.ascontiguousarray(digests.T).astype(">u4").view(np.uint8).reshape(-1, 32)
    return np.ascontiguousarray(HEX[raw].reshape(-1, 64).view(">u4").astype(U).T)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of messages that had ``blocks`` (n,) whole blocks: one block of padding."""
    pad = np.zeros((16, len(blocks)), U)
    pad[0] = U(0x80000000)
    bits = blocks.astype(np.uint64) * np.uint64(512)
    pad[14], pad[15] = (bits >> np.uint64(32)).astype(U), bits.astype(U)
    return compress(state, pad)


def to_bytes(x: np.ndarray) -> list[bytes]:
    """Columns (8, n) as 32 bytes each."""
    raw = np.ascontiguousarray(x.T).astype(">u4").tobytes()
    return [raw[i:i + 32] for i in range(0, len(raw), 32)]


def from_bytes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, ">u4").astype(U).reshape(-1, 8).T)
