"""Pictures for the image queries; the given tables hold none."""

from __future__ import annotations

import struct
import zlib


def png_bytes(height: int, width: int, bgr: bytes) -> bytes:
    """An 8-bit RGB PNG of a B, G, R pixel buffer."""
    pixels = bytearray(bgr)
    pixels[0::3], pixels[2::3] = pixels[2::3], pixels[0::3]
    row = width * 3
    scan = b"".join(b"\x00" + bytes(pixels[i * row:(i + 1) * row]) for i in range(height))

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(scan)) + chunk(b"IEND", b"")
