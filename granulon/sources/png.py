"""8- and 16-bit PNG images to and from numpy; label maps must keep all 16 bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray | None:
    """(H, W) or (H, W, channels) of uint8 or uint16; None if it isn't such a PNG or is damaged."""
    try:
        return _decode(data)
    except (ValueError, struct.error, zlib.error, IndexError, KeyError):
        return None


def _decode(data: bytes) -> np.ndarray | None:
    if data[:8] != SIGNATURE:
        return None
    at, packed, palette, header = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    width, height, depth, colour, _, _, interlace = header
    if depth not in (8, 16) or interlace or (colour == 3 and (palette is None or depth != 8)):
        return None
    channels = 1 if colour == 3 else CHANNELS[colour]
    step = channels * depth // 8
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width * step), np.uint8)
    for y in range(height):
        out[y + 1] = _unfilter(int(lines[y, 0]), lines[y, 1:], out[y], step)
    pixels = out[1:].reshape(height, width, step)
    if depth == 16:
        pixels = pixels.reshape(height, width, channels, 2).astype(np.uint16)
        pixels = pixels[..., 0] << 8 | pixels[..., 1]
    if colour == 3:
        return palette[pixels[..., 0]]
    return pixels[..., 0] if channels == 1 else pixels


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:  # each byte adds the one a pixel before: sums along the line
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    out = np.zeros(len(line) + step, np.int64)
    up = np.concatenate([np.zeros(step, np.int64), above.astype(np.int64)])
    for i, x in enumerate(line.tolist()):
        a, b, c = out[i], up[i + step], up[i]
        if kind == 3:
            guess = (a + b) // 2
        elif kind == 4:
            p = a + b - c
            guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
        else:
            raise ValueError("unknown filter")
        out[i + step] = (x + guess) & 255
    return out[step:].astype(np.uint8)


def encode_grey(pixels: np.ndarray, depth: int = 16) -> bytes:
    """A grey PNG of 8 or 16 bits, without filters."""
    height, width = pixels.shape
    rows = pixels.astype(">u2" if depth == 16 else np.uint8)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
