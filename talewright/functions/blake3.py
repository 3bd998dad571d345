"""BLAKE3 over many inputs at once, in NumPy lanes."""

from __future__ import annotations

import numpy as np

_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
_NEXT = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_CHUNK, _BLOCK = 1024, 64
#: Chunks that are hashed at once: a bound of memory, whatever a batch of texts has.
LANES = 1 << 13


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8 x lanes) after one block (16 x lanes)."""
    n = cv.shape[1]
    v = np.empty((16, n), dtype=np.uint32)
    v[:8] = cv
    v[8:12] = _IV[:4, None]
    v[12] = (counter & 0xFFFFFFFF).astype(np.uint32)
    v[13] = (counter >> 32).astype(np.uint32)
    v[14] = length
    v[15] = flags

    def g(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        v[a] += v[b] + x
        v[d] = _turn(v[d] ^ v[a], 16)
        v[c] += v[d]
        v[b] = _turn(v[b] ^ v[c], 12)
        v[a] += v[b] + y
        v[d] = _turn(v[d] ^ v[a], 8)
        v[c] += v[d]
        v[b] = _turn(v[b] ^ v[c], 7)

    order = list(range(16))
    for _ in range(7):
        m = [block[k] for k in order]
        for k in range(4):
            g(k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            g(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        order = [order[k] for k in _NEXT]
    return v[:8] ^ v[8:]


def digests(inputs: list[bytes]) -> list[bytes]:
    """The 32-byte digest of each input, of some LANES chunks at a time."""
    out: list[bytes] = []
    start = lanes = 0
    for k, x in enumerate(inputs, 1):
        lanes += max(1, -(-len(x) // _CHUNK))
        if lanes >= LANES or k == len(inputs):
            out += _digests(inputs[start:k])
            start, lanes = k, 0
    return out


def _digests(inputs: list[bytes]) -> list[bytes]:
    sizes = np.array([len(x) for x in inputs], dtype=np.int64)
    chunks = np.maximum(1, -(-sizes // _CHUNK))
    owner = np.repeat(np.arange(len(inputs)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    length = np.minimum(_CHUNK, sizes[owner] - number * _CHUNK)
    padded = np.zeros((len(owner), _CHUNK), dtype=np.uint8)
    lane = 0
    for x, k in zip(inputs, chunks.tolist()):
        padded[lane : lane + k].reshape(-1)[: len(x)] = np.frombuffer(x, dtype=np.uint8)
        lane += k
    words = padded.view("<u4").reshape(len(owner), 16, 16)
    blocks = np.maximum(1, -(-length // _BLOCK))
    single = (chunks == 1)[owner]
    cv = np.repeat(_IV[:, None], len(owner), axis=1)
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        last = blocks[on] == k + 1
        flags = np.where(k == 0, _START, 0) | np.where(last, _END, 0) | np.where(last & single[on], _ROOT, 0)
        size = np.where(last, length[on] - k * _BLOCK, _BLOCK).astype(np.uint32)
        cv[:, on] = _compress(cv[:, on], words[on, k].T, number[on], size, flags.astype(np.uint32))
    count = chunks.copy()
    while count.max() > 1:  # neighbours pair up, an odd last one moves up alone
        first = np.cumsum(count) - count
        place = np.arange(cv.shape[1]) - np.repeat(first, count)
        pairs = np.repeat(count, count)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < pairs))
        flags = (_PARENT | np.where(pairs[left] == 2, _ROOT, 0)).astype(np.uint32)
        up = _compress(np.repeat(_IV[:, None], len(left), axis=1), np.vstack([cv[:, left], cv[:, left + 1]]), np.zeros(len(left), np.int64), np.full(len(left), 64, np.uint32), flags)
        cv = cv.copy()
        cv[:, left] = up
        cv = cv[:, place % 2 == 0]
        count = (count + 1) // 2
    raw = np.ascontiguousarray(cv.T).astype("<u4").tobytes()
    return [raw[k : k + 32] for k in range(0, len(raw), 32)]
