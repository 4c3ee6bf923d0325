"""PNG files of 8 bits a sample, gray or colour, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(x: np.ndarray) -> bytes:
    """Rows unfiltered; colour frames are blue-green-red in memory and the other way in the file."""
    h, w = x.shape[:2]
    c = x.shape[2] if x.ndim == 3 else 1
    kind = {1: 0, 3: 2, 4: 6}[c]
    if c >= 3:
        x = np.concatenate([x[..., 2::-1], x[..., 3:]], 2)
    rows = np.zeros((h, 1 + w * c), np.uint8)
    rows[:, 1:] = x.reshape(h, w * c)
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(raw: bytes) -> np.ndarray:
    """Raises ValueError for what it can't read."""
    if raw[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at + 8 <= len(raw):
        size, name = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("only 8-bit PNG files without interlacing or palette")
    w, h, c = head[0], head[1], CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w, c), np.uint8)  # a row of zeros above
    for y in range(h):
        line, up, how = rows[y, 1:].reshape(w, c), out[y], rows[y, 0]
        if how == 0:
            out[y + 1] = line
        elif how == 1:
            out[y + 1] = np.cumsum(line, 0, dtype=np.uint8)
        elif how == 2:
            out[y + 1] = line + up
        else:
            left, corner = np.zeros(c, int), np.zeros(c, int)
            for x in range(w):
                above = up[x].astype(int)
                if how == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    a, b, d = abs(p - left), abs(p - above), abs(p - corner)
                    guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, above, corner))
                left = (line[x] + guess) & 255
                out[y + 1, x] = left
                corner = above
    x = out[1:]
    if c >= 3:
        x = np.concatenate([x[..., 2::-1], x[..., 3:]], 2)
    return np.ascontiguousarray(x[..., 0] if c == 1 else x)
