"""Pixels inside kernels: decode, convert, scale, write, measure, and the search for a file size.

A raster is a BINARY column of rows of RGBA bytes with its width and height; it is never spread to one
row per pixel. Kernels take numpy arrays and give error codes instead of raising.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes that are refused.
MAX_PIXELS, MAX_SIDE = 250_000_000, 32_767
RASTER = "width int, height int, rgba binary, error string"


def read_png(data: bytes) -> np.ndarray | str:
    """RGBA pixels (height x width x 4) of a PNG of any depth and colour type, or an error code."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return "damaged"
    at, palette, key, body, head = 8, None, None, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            key = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or not body:
        return "damaged"
    w, h, depth, colour, _, _, interlace = head
    if not w or not h or w > MAX_SIDE or h > MAX_SIDE or w * h > MAX_PIXELS or interlace:
        return "too-large-to-process" if w and h else "damaged"
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride, step = (w * samples * depth + 7) // 8, max(1, samples * depth // 8)
    inflate = zlib.decompressobj()
    raw = inflate.decompress(b"".join(body), h * (stride + 1))
    if len(raw) < h * (stride + 1):
        return "damaged"
    lines = np.frombuffer(raw, np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        above = out[y] = _unfilter(int(lines[y, 0]), lines[y, 1:], above, step)
    return _to_rgba(out, w, h, depth, colour, samples, palette, key)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:  # running sums of every sample
        n = -(-len(line) // step) * step
        padded = np.zeros(n, np.uint8)
        padded[: len(line)] = line
        return np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[: len(line)]
    cur = [0] * step + line.tolist()
    up = [0] * step + above.tolist()
    for i in range(step, len(cur)):
        a, b, c = cur[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        cur[i] = (cur[i] + guess) & 255
    return np.array(cur[step:], np.uint8)


def _to_rgba(lines, w, h, depth, colour, samples, palette, key) -> np.ndarray:
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)[:, : w * samples]
        values = bits @ (1 << np.arange(depth - 1, -1, -1))
    elif depth == 16:
        values = lines.reshape(h, -1, 2).astype(np.int64) @ np.array([256, 1])
    else:
        values = lines.astype(np.int64)
    values = values.reshape(h, w, samples)
    if colour == 3:
        table = np.full((256, 4), 255, np.uint8)
        table[: len(palette), :3] = palette
        if key is not None:
            table[: len(key), 3] = np.frombuffer(key, np.uint8)
        return table[values[:, :, 0]]
    scaled = (values >> 8 if depth == 16 else values * 255 // ((1 << depth) - 1)).astype(np.uint8)
    out = np.full((h, w, 4), 255, np.uint8)
    out[:, :, :3] = scaled[:, :, :1] if colour in (0, 4) else scaled[:, :, :3]
    if colour in (4, 6):
        out[:, :, 3] = scaled[:, :, -1]
    elif key is not None:
        clear = np.array(struct.unpack(f">{samples}H", key[: 2 * samples]))
        out[:, :, 3] = np.where((values == clear).all(axis=2), 0, 255)
    return out


def write_png(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]
    opaque = bool((rgba[:, :, 3] == 255).all())
    pixels = rgba[:, :, :3] if opaque else rgba
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels).reshape(h, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if opaque else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_bmp(data: bytes) -> np.ndarray | str:
    """RGBA pixels of an uncompressed or bit-field BMP, or an error code."""
    if data[:2] != b"BM" or len(data) < 26:
        return "damaged"
    start, size = struct.unpack_from("<II", data, 10)
    if size == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        packing = used = 0
    else:
        w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        (used,) = struct.unpack_from("<I", data, 46)
    down, h = h < 0, abs(h)
    if packing not in (0, 3) or bits not in (8, 16, 24, 32):
        return "too-large-to-process"
    if w <= 0 or h == 0 or w * h > MAX_PIXELS:
        return "damaged"
    stride = (w * bits + 31) // 32 * 4
    if start + stride * h > len(data):
        return "damaged"
    lines = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
    lines = lines if down else lines[::-1]
    out = np.full((h, w, 4), 255, np.uint8)
    if bits == 8:
        each = 3 if size == 12 else 4
        n = used or 256
        table = np.frombuffer(data, np.uint8, n * each, 14 + size).reshape(n, each)[:, 2::-1]
        out[:, :, :3] = table[np.minimum(lines[:, :w], n - 1)]
    elif bits == 24:
        out[:, :, :3] = lines[:, : 3 * w].reshape(h, w, 3)[:, :, ::-1]
    else:
        values = np.ascontiguousarray(lines[:, : w * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint64)
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        for k, m in enumerate(masks):
            low = (m & -m).bit_length() - 1
            out[:, :, k] = (values & np.uint64(m)) >> np.uint64(low) if m >> low == 255 else ((values & np.uint64(m)) >> np.uint64(low)) * np.uint64(255) // np.uint64(m >> low)
    return out


def write_bmp(rgba: np.ndarray) -> bytes:
    """24 bits, bottom-up, 72 DPI; transparency is put on white."""
    flat = on_white(rgba)
    h, w = flat.shape[:2]
    stride = (w * 3 + 3) // 4 * 4
    lines = np.zeros((h, stride), np.uint8)
    lines[:, : 3 * w] = flat[::-1, :, ::-1].reshape(h, -1)
    head = struct.pack("<IIiiHHIIiiII", 54, 40, w, h, 1, 24, 0, stride * h, 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHH", 54 + stride * h, 0, 0) + head + lines.tobytes()


def write_ico(rgba: np.ndarray) -> bytes | None:
    """One PNG in an icon; NULL over 256 pixels a side (256 is stored as 0)."""
    h, w = rgba.shape[:2]
    if max(w, h) > 256:
        return None
    png = write_png(rgba)
    return struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", w % 256, h % 256, 0, 0, 1, 32, len(png), 22) + png


def on_white(rgba: np.ndarray) -> np.ndarray:
    alpha = rgba[:, :, 3:].astype(np.uint32)
    return ((rgba[:, :, :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def box_downscale(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each output pixel is the mean of the input pixels that fall on it, weighted by their alpha."""
    h, w = rgba.shape[:2]
    rows, cols = (np.flatnonzero(np.diff(np.arange(n) * m // n, prepend=-1)) for n, m in ((h, height), (w, width)))
    alpha = rgba[:, :, 3].astype(np.float64)
    add = lambda x: np.add.reduceat(np.add.reduceat(x, rows, axis=0), cols, axis=1)
    count, total = add(np.ones((h, w))), add(alpha)
    out = np.zeros((height, width, 4), np.uint8)
    for k in range(3):
        out[:, :, k] = np.where(total > 0, add(rgba[:, :, k] * alpha) / np.maximum(total, 1e-9) + 0.5, 0).astype(np.uint8)
    out[:, :, 3] = (total / count + 0.5).astype(np.uint8)
    return out


def orient(rgba: np.ndarray, orientation: int) -> np.ndarray:
    """The upright picture for an EXIF orientation of 1 to 8."""
    if orientation >= 5:
        rgba = rgba.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        rgba = rgba[:, ::-1]
    if orientation in (3, 4, 7, 8):
        rgba = rgba[::-1]
    return np.ascontiguousarray(rgba)


def ssim_blocks(a: np.ndarray, b: np.ndarray, side: int = 8) -> float:
    """Mean structural similarity of two planes over blocks of ``side`` pixels (sample variance)."""
    h, w = (n // side * side for n in a.shape)
    if not h or not w:
        return 1.0
    cut = lambda x: x[:h, :w].astype(np.float64).reshape(h // side, side, w // side, side).transpose(0, 2, 1, 3).reshape(-1, side * side)
    x, y = cut(a), cut(b)
    mx, my = x.mean(axis=1), y.mean(axis=1)
    n = side * side - 1
    vx, vy = ((x - mx[:, None]) ** 2).sum(axis=1) / n, ((y - my[:, None]) ** 2).sum(axis=1) / n
    cov = ((x - mx[:, None]) * (y - my[:, None])).sum(axis=1) / n
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


DECODERS = {"png": read_png, "bmp": read_bmp}


def decoded(fmt: Column, content: Column) -> Column:
    """struct(RASTER); formats without a decoder here give 'unsupported-format'."""

    @F.pandas_udf(RASTER)
    def decode(formats: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = []
        for f, d in zip(formats, data, strict=True):
            reader = DECODERS.get(f)
            try:
                out = reader(bytes(d)) if reader and d is not None else "unsupported-format"
            except (ValueError, KeyError, IndexError, struct.error, zlib.error, TypeError):
                out = "damaged"
            rows.append((None, None, None, out) if isinstance(out, str) else (out.shape[1], out.shape[0], out.tobytes(), None))
        return pd.DataFrame(rows, columns=["width", "height", "rgba", "error"]).astype({"width": "Int32", "height": "Int32"})

    return decode(fmt, content)
