"""Screenshots: PNG decoding and the pixels that differ."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The channels of the colour types that are read (grey, RGB, grey with alpha, RGBA).
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
SIGNATURE = b"\x89PNG\r\n\x1a\n"
DIFFERENCES = "id string, status string, pixels long, changed long, ratio double, reason string"


def decode_png(data: bytes) -> np.ndarray:
    """An array (height, width, 4) of an 8-bit PNG that is not interlaced; ValueError for all others."""
    if not data or not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    at, head, packed = len(SIGNATURE), None, b""
    while at + 12 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[4:] != (0, 0, 0) or not head[0] or not head[1]:
        raise ValueError("unsupported PNG")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    try:
        lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * n)
    except (zlib.error, ValueError) as e:
        raise ValueError("broken PNG") from e
    pixels = np.zeros((height + 1, width + 1, n), np.uint8)  # with a row above and a column before
    for y in range(height):
        line, mode = lines[y, 1:].reshape(width, n), lines[y, 0]
        above, out = pixels[y], pixels[y + 1]
        if mode == 0:
            out[1:] = line
        elif mode == 1:
            out[1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif mode == 2:
            out[1:] = line + above[1:]
        elif mode in (3, 4):
            for x in range(1, width + 1):
                left, up, corner = out[x - 1].astype(int), above[x].astype(int), above[x - 1].astype(int)
                if mode == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                out[x] = (line[x - 1] + guess) & 255
        else:
            raise ValueError("broken PNG")
    found = pixels[1:, 1:]
    alpha = found[..., -1:] if n in (2, 4) else np.full((height, width, 1), 255, np.uint8)
    colour = found[..., :3] if n >= 3 else np.repeat(found[..., :1], 3, axis=2)
    return np.concatenate([colour, alpha], axis=2)


def compare_png(left: bytes, right: bytes, threshold: int) -> tuple[str, int | None, int | None, float | None, str | None]:
    """(status, pixels, changed, ratio, reason): a pixel changed if a channel differs by more than the threshold."""
    try:
        a, b = decode_png(left), decode_png(right)
    except ValueError as e:
        return "unavailable", None, None, None, str(e)
    if a.shape != b.shape:
        return "size_mismatch", None, None, None, f"{a.shape[1]}x{a.shape[0]} and {b.shape[1]}x{b.shape[0]}"
    changed = int((np.abs(a.astype(int) - b) > threshold).any(axis=2).sum())
    return "compared", a.shape[0] * a.shape[1], changed, changed / (a.shape[0] * a.shape[1]), None


def pixel_differences(pairs: DataFrame, threshold: int) -> DataFrame:
    """(id, status, pixels, changed, ratio, reason) of pairs of screenshots (id, left, right)."""

    def compare(frames):
        import pandas as pd

        for frame in frames:
            rows = [(i, *compare_png(a, b, threshold)) for i, a, b in zip(frame["id"], frame["left"], frame["right"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "status", "pixels", "changed", "ratio", "reason"]).astype({"pixels": "Int64", "changed": "Int64", "ratio": "Float64"})

    return pairs.select(F.col("id").cast("string").alias("id"), "left", "right").mapInPandas(compare, DIFFERENCES)
