"""CRC-32C of many byte strings at once, in numpy (the checksum of the record format; Python has no fast one built in)."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x82F63B78  # Castagnoli, bits reversed
BLOCK = 256
MASK_DELTA = 0xA282EAD8  # fixed value of the record format


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


_BYTES = _byte_table()
_low = np.arange(65536, dtype=np.uint32)
_PAIRS = _BYTES[_low & 255] ^ (_low >> np.uint32(8))
_PAIRS = _BYTES[_PAIRS & 255] ^ (_PAIRS >> np.uint32(8))  # effect of two bytes


def _shift_tables() -> np.ndarray:
    """What appending BLOCK zero bytes does to a checksum, per half of it."""
    halves = []
    for shift in (0, 16):
        crc = (np.arange(65536, dtype=np.uint64) << np.uint64(shift)).astype(np.uint32)
        for _ in range(BLOCK // 2):
            crc = _PAIRS[crc & 65535] ^ (crc >> np.uint32(16))
        halves.append(crc)
    return np.stack(halves)


_SHIFT = _shift_tables()


def checksums(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string (uint32).

    All strings are cut into blocks, the blocks advance together two bytes at a time, and each string's blocks are
    then chained. Zeros are put before a string to fill its first block: they do not change a checksum that starts at
    zero, and the usual start of all ones is the same as inverting the first four bytes.
    """
    out = np.zeros(len(parts), np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    for i in np.flatnonzero(sizes < 4):  # too short for the trick
        crc = 0xFFFFFFFF
        for byte in parts[i]:
            crc = int(_BYTES[(crc ^ byte) & 255]) ^ (crc >> 8)
        out[i] = crc ^ 0xFFFFFFFF
    long = np.flatnonzero(sizes >= 4)
    if not len(long):
        return out
    blocks = -(-sizes[long] // BLOCK)
    ends = np.cumsum(blocks)
    buffer = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    for i, end in zip(long, ends):
        part = np.frombuffer(parts[i], np.uint8)
        at = int(end) * BLOCK - len(part)
        buffer[at:at + len(part)] = part
        buffer[at:at + 4] ^= 255
    columns = np.ascontiguousarray(buffer.view("<u2").reshape(-1, BLOCK // 2).T)
    crc = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        crc = _PAIRS[(crc ^ column) & 65535] ^ (crc >> np.uint32(16))
    by = np.argsort(-blocks, kind="stable")  # strings with many blocks first, so that those still open are a prefix
    starts, left = (ends - blocks)[by], blocks[by]
    total = np.zeros(len(long), np.uint32)
    for step in range(int(left[0])):
        still = int(np.searchsorted(-left, -step, "left"))  # strings with more than ``step`` blocks
        now = total[:still]
        total[:still] = _SHIFT[0][now & 65535] ^ _SHIFT[1][now >> np.uint32(16)] ^ crc[starts[:still] + step]
    out[long[by]] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crcs: np.ndarray) -> np.ndarray:
    """Checksums as the record format stores them: rotated and shifted by a constant."""
    wide = crcs.astype(np.uint64)
    return ((((wide >> np.uint64(15)) | (wide << np.uint64(17))) & np.uint64(0xFFFFFFFF)) + np.uint64(MASK_DELTA)).astype(np.uint32)
