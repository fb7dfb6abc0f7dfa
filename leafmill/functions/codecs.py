"""Stream filters and pixel encoders: bytes in, bytes out."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# Filter names of the file format with their short forms.
GENERIC = {
    "FlateDecode": "flate",
    "Fl": "flate",
    "ASCII85Decode": "ascii85",
    "A85": "ascii85",
    "ASCIIHexDecode": "asciihex",
    "AHx": "asciihex",
    "RunLengthDecode": "runlength",
    "RL": "runlength",
}
TERMINAL = {
    "DCTDecode": "jpeg",
    "DCT": "jpeg",
    "JPXDecode": "jpeg2000",
    "CCITTFaxDecode": "ccitt",
    "CCF": "ccitt",
    "JBIG2Decode": "jbig2",
}
LZW = {"LZWDecode", "LZW"}


class UnsupportedFilter(ValueError):
    pass


def flate(data: bytes) -> bytes:
    """Zlib data, or raw deflate if that gives nothing; what a truncated stream holds is kept."""
    for wbits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        d = zlib.decompressobj(wbits)
        out = []
        try:
            for k in range(0, len(data), 4096):
                out.append(d.decompress(data[k : k + 4096]))
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return b""


def ascii85(data: bytes) -> bytes:
    """Base 85 in groups of five; ``z`` is four zeros, ``~`` ends, other bytes are skipped, sums wrap at 32 bits."""
    out, group = bytearray(), []
    for b in data:
        if b == 0x7E:
            break
        if b == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= b <= 0x75:
            group.append(b - 0x21)
            if len(group) == 5:
                out += struct.pack(">I", _base85(group))
                group = []
    if len(group) > 1:
        out += struct.pack(">I", _base85(group + [84] * (5 - len(group))))[: len(group) - 1]
    return bytes(out)


def _base85(digits: list[int]) -> int:
    n = 0
    for d in digits:
        n = (n * 85 + d) & 0xFFFFFFFF
    return n


def asciihex(data: bytes) -> bytes:
    """Hex digits up to ``>``; anything else is skipped and a last single digit is padded with 0."""
    digits = bytes(b for b in data.split(b">", 1)[0] if chr(b) in "0123456789abcdefABCDEF")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def runlength(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data) and data[k] != 128:
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        else:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
    return bytes(out)


def png_predictor(data: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Undoes the row filters 0 to 4; an incomplete last row is dropped."""
    step = max(1, colors * bits // 8)
    width = (columns * colors * bits + 7) // 8
    rows = np.frombuffer(data[: len(data) // (width + 1) * (width + 1)], np.uint8).reshape(-1, width + 1)
    out = np.zeros((len(rows), width), np.uint8)
    above = np.zeros(width, np.uint8)
    for k, row in enumerate(rows):
        kind, line = row[0], row[1:].copy()
        if kind == 1 or kind == 3 or kind == 4:
            line = _left_predicted(line, above, int(kind), step)
        elif kind == 2:
            line = line + above
        elif kind != 0:
            raise ValueError(f"row filter {kind}")
        out[k] = above = line
    return out.tobytes()


def _left_predicted(line: np.ndarray, above: np.ndarray, kind: int, step: int) -> np.ndarray:
    if kind == 1:  # sums of every step-th byte
        pad = np.concatenate([line, np.zeros(-len(line) % step, np.uint8)]).reshape(-1, step)
        return np.cumsum(pad, 0, dtype=np.uint8).reshape(-1)[: len(line)]
    raw, up, got = line.tolist(), above.tolist(), []
    for k, x in enumerate(raw):
        a = got[k - step] if k >= step else 0
        b = up[k]
        if kind == 3:
            got.append((x + (a + b) // 2) & 255)
        else:
            c = up[k - step] if k >= step else 0
            p = a + b - c
            _, near = min((abs(p - a), 0), (abs(p - b), 1), (abs(p - c), 2))
            got.append((x + (a, b, c)[near]) & 255)
    return np.array(got, np.uint8)


def tiff_predictor(data: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Undoes horizontal differences; samples of less than 8 bits are unpacked for it."""
    if bits == 8:
        width = columns * colors
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, 1, dtype=np.uint8).tobytes()
    if bits == 16:
        width = columns * colors * 2
        rows = np.frombuffer(data[: len(data) // width * width], ">u2").reshape(-1, columns, colors)
        return np.cumsum(rows, 1, dtype=np.uint16).astype(">u2").tobytes()
    samples = unpack_samples(data, columns * colors, bits).reshape(-1, columns, colors)
    return pack_samples((np.cumsum(samples, 1) & ((1 << bits) - 1)).reshape(len(samples), -1), bits)


def unpack_samples(data: bytes, per_row: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, one row per line; rows start at byte bounds."""
    width = (per_row * bits + 7) // 8
    rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, width)
    flat = np.unpackbits(rows, axis=1)[:, : per_row * bits].reshape(len(rows), per_row, bits)
    return flat @ (1 << np.arange(bits - 1, -1, -1))


def pack_samples(rows: np.ndarray, bits: int) -> bytes:
    shifts = np.arange(bits - 1, -1, -1)
    flat = ((rows[:, :, None] >> shifts) & 1).astype(np.uint8).reshape(len(rows), -1)
    return np.packbits(flat, axis=1).tobytes()


@dataclass
class Decoded:
    data: bytes
    terminal: str | None  # codec of the remaining bytes, None for plain samples


def decode_chain(data: bytes, filters: list[str], parms: list[dict | None]) -> Decoded:
    """Applies the generic filters in order; a terminal codec is recorded and unknown names are ignored."""
    terminal = None
    for k, name in enumerate(filters):
        if name in LZW:
            raise UnsupportedFilter(name)
        if name in TERMINAL:
            terminal = TERMINAL[name]
            continue
        kind = GENERIC.get(name)
        if kind is None:
            continue
        data = {"flate": flate, "ascii85": ascii85, "asciihex": asciihex, "runlength": runlength}[kind](data)
        p = parms[k] if k < len(parms) and parms[k] else {}
        predictor = int(p.get("Predictor", 1))
        if kind == "flate" and predictor > 1:
            shape = int(p.get("Columns", 1)), int(p.get("Colors", 1)), int(p.get("BitsPerComponent", 8))
            data = tiff_predictor(data, *shape) if predictor == 2 else png_predictor(data, *shape)
    return Decoded(data, terminal)


def png(pixels: np.ndarray, bits: int = 8) -> bytes:
    """PNG of an array of rows x columns (gray) or rows x columns x 3 or 4; ``bits`` 1 takes 0 and 1 values."""
    height, width = pixels.shape[:2]
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    body = np.packbits(pixels.astype(bool), axis=1) if bits == 1 else pixels.astype(np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), body], 1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, bits, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def samples_to_pixels(data: bytes, width: int, height: int, color_space: str, bits: int) -> np.ndarray | None:
    """Rows of gray or RGB pixels; channels by colour space, or guessed from the length; None if too short."""
    known = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4}
    channels = known.get(color_space)
    if channels is None:
        channels = next((c for c in (4, 3, 1) if len(data) >= (width * c * bits + 7) // 8 * height), 1)
    need = (width * channels * bits + 7) // 8 * height
    if width <= 0 or height <= 0 or len(data) < need:
        return None
    if bits == 8:
        flat = np.frombuffer(data[:need], np.uint8).reshape(height, width * channels)
    elif bits == 16:
        flat = np.frombuffer(data[:need], np.uint8).reshape(height, width * channels, 2)[:, :, 0]
    else:
        flat = (unpack_samples(data[:need], width * channels, bits) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    if channels == 1:
        return flat
    rows = flat.reshape(height, width, channels)
    if channels == 4:
        light = 255 - rows[:, :, :3].astype(int)
        rows = (light * (255 - rows[:, :, 3:].astype(int)) // 255).astype(np.uint8)
    return rows


def read_png(data: bytes) -> np.ndarray:
    """RGBA pixels of a PNG without interlacing, of 1, 2, 4, 8 or 16 bits (16 keep their upper byte)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, clear = 8, [], None, None
    width = height = bits = kind = 0
    while at + 8 <= len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        name, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            width, height, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if interlaced:
                raise ValueError("interlaced")
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = np.frombuffer(part, np.uint8)
        elif name == b"IDAT":
            body.append(part)
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = png_predictor(zlib.decompress(b"".join(body)), width, channels, bits)
    if bits == 8:
        flat = np.frombuffer(raw, np.uint8)
    elif bits == 16:
        flat = np.frombuffer(raw, np.uint8).reshape(-1, 2)[:, 0]
    else:
        flat = unpack_samples(raw, width * channels, bits).astype(np.uint8)
        flat = flat if kind == 3 else (flat.astype(int) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    rows = flat.reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        out[..., :3] = palette[rows[..., 0]]
        if clear is not None:
            out[..., 3] = np.append(clear, np.full(256 - len(clear), 255, np.uint8))[rows[..., 0]]
    elif channels <= 2:
        out[..., :3] = rows[..., :1]
        out[..., 3] = rows[..., 1] if channels == 2 else 255
    else:
        out[..., :channels] = rows
    return out
