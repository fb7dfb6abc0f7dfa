import base64
import random
import struct
import zlib

import numpy as np
import pytest

from leafmill.functions import codecs as C
from leafmill.functions import pixels as X
from leafmill.functions import text as T


def rows(spark, expressions, values, schema):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*expressions).collect()]


def test_flate():
    raw = zlib.compressobj(wbits=-15)
    assert C.flate(zlib.compress(b"hello" * 50)) == b"hello" * 50
    assert C.flate(raw.compress(b"raw data") + raw.flush()) == b"raw data"
    assert C.flate(b"") == b"" and b"hello".startswith(C.flate(zlib.compress(b"hello")[:9])[:5])


def test_ascii_codecs():
    r = random.Random(1)
    for n in range(40):
        data = bytes(r.choice([0, r.randint(0, 255)]) for _ in range(n))
        assert C.ascii85(base64.a85encode(data) + b"~>") == data
        assert C.asciihex(data.hex().encode() + b">junk") == data
    assert C.ascii85(b"z~>") == b"\0\0\0\0" and C.ascii85(b" 8 7\ncURD]i,\"Ebo80~> x") == b"Hello World!"
    assert C.asciihex(b"4 a 4") == b"J@"


def test_runlength():
    assert C.runlength(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128]) + b"tail") == b"abcxxx"
    assert C.runlength(bytes([5]) + b"ab") == b"ab" and C.runlength(b"") == b""


def test_png_predictors():
    r = np.random.default_rng(1)
    for colors, bits in ((1, 8), (3, 8), (4, 8), (1, 1), (2, 16)):
        width = (7 * colors * bits + 7) // 8
        step = max(1, colors * bits // 8)
        plain = r.integers(0, 256, (10, width)).astype(int)
        coded = b""
        for k, line in enumerate(plain):
            up = plain[k - 1] if k else np.zeros(width, int)
            a = np.concatenate([np.zeros(step, int), line])[:width]
            c = np.concatenate([np.zeros(step, int), up])[:width]
            p = a + up - c
            paeth = np.select([(abs(p - a) <= abs(p - up)) & (abs(p - a) <= abs(p - c)), abs(p - up) <= abs(p - c)], [a, up], c)
            kind = k % 5
            coded += bytes([kind]) + ((line - [0, a, up, (a + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        assert C.png_predictor(coded, 7, colors, bits) == plain.astype(np.uint8).tobytes()
    with pytest.raises(ValueError):
        C.png_predictor(b"\x09abc", 3)


def test_tiff_predictor():
    assert C.tiff_predictor(bytes([1, 1, 1, 250, 10, 10]), 3) == bytes([1, 2, 3, 250, 4, 14])
    assert C.tiff_predictor(struct.pack(">3H", 1, 65535, 2), 3, 1, 16) == struct.pack(">3H", 1, 0, 2)
    assert C.tiff_predictor(b"\x12\x30", 3, 1, 4) == b"\x13\x60"


def test_chain():
    data = zlib.compress(b"pixels")
    got = C.decode_chain(base64.a85encode(data) + b"~>", ["ASCII85Decode", "FlateDecode", "Strange"], [])
    assert (got.data, got.terminal) == (b"pixels", None)
    assert C.decode_chain(data, ["Fl", "DCTDecode"], []).terminal == "jpeg"
    with pytest.raises(C.UnsupportedFilter):
        C.decode_chain(b"", ["LZWDecode"], [])


def read_png(data):
    width, height, bits, kind = struct.unpack(">IIBB", data[16:26])
    body, at = b"", 8
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(data[at + 4 : at + 8 + n])
        at += 12 + n
    return width, height, bits, kind, zlib.decompress(body)


def test_png_writer():
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert read_png(C.png(rgb)) == (4, 2, 8, 2, b"\0" + rgb[0].tobytes() + b"\0" + rgb[1].tobytes())
    assert read_png(C.png(np.array([[1, 0, 1]]), bits=1)) == (3, 1, 1, 0, b"\0\xa0")


def test_samples():
    assert C.samples_to_pixels(b"\xa0\x40", 3, 2, "DeviceGray", 1).tolist() == [[255, 0, 255], [0, 255, 0]]
    assert C.samples_to_pixels(b"\0\0\0\0\xff\0\0\0", 2, 1, "DeviceCMYK", 8).tolist() == [[[255, 255, 255], [0, 255, 255]]]
    assert C.samples_to_pixels(b"\x12\x00\x34\x00", 2, 1, "DeviceGray", 16).tolist() == [[0x12, 0x34]]
    assert C.samples_to_pixels(b"abc", 1, 1, "Unknown", 8).shape == (1, 1, 3) and C.samples_to_pixels(b"a", 2, 2, "DeviceGray", 8) is None


def test_pixels():
    px = np.array([[[0, 0, 0, 255], [255, 255, 255, 0], [10, 200, 100, 255]]], np.uint8)
    assert X.luminance(px[..., :3]).tolist() == [[0, 255, 132]]
    assert X.quantise(np.array([0, 100, 128, 255]), 4).tolist() == [0, 85, 170, 255]
    assert X.reduce_colours(px, "binary", 180)[0, :, 0].tolist() == [0, 255, 0] and X.reduce_colours(px, "binary", -1)[0, :, 0].tolist() == [255] * 3
    assert X.reduce_colours(px, "binary", 300)[0, :, 0].tolist() == [0, 255, 0] and X.reduce_colours(px, "grayscale")[0, 1, 3] == 255
    assert len(np.unique(X.reduce_colours(np.random.default_rng(1).integers(0, 256, (80, 80, 4)).astype(np.uint8), "16").reshape(-1, 4), axis=0)) == 16
    assert X.has_alpha(px) and X.flatten_on_white(px)[0, 1].tolist() == [255, 255, 255, 255]
    assert X.is_binary(px[:, :2]) and not X.is_gray(px)
    assert X.pack_bits(np.array([[255] * 9, [0] * 8 + [255]])) == b"\xff\x80\x00\x80"
    assert X.target_size(100, 50, 0.5, None) == (50, 25) and X.target_size(100, 50, 0.5, 20) == (20, 10) and X.target_size(10, 10, 2.0) == (10, 10)
    assert X.resize(np.full((4, 4, 4), 7, np.uint8), 2, 3).tolist() == np.full((3, 2, 4), 7).tolist()
    assert max(X.preview(np.zeros((900, 300, 4), np.uint8)).shape[:2]) == 400 and X.preview(np.zeros((90, 30, 4), np.uint8), most=10).shape == (300, 100, 4)


def test_texts(spark):
    from pyspark.sql import functions as F

    n = F.col("n")
    assert rows(spark, [T.signed_size_text(n)], [(-2048,), (5,)], "n long") == [("-2.0 KB",), ("5 B",)]
    assert rows(spark, [T.percent_text(F.lit(1), n), T.compression_ratio(n, F.lit(150))], [(0,), (100,)], "n long") == [("0%", 0.0), ("1.0%", -50.0)]
    assert rows(spark, [T.image_format(F.col("p")), T.trailing_number(F.col("p"))], [("a-001-012.png",), ("x.JPG",), ("y.tif",), ("z",)], "p string") == [("png", 12), ("jpeg", None), (None, None), (None, None)]
    assert rows(spark, [T.colour(F.col("p"))], [("fonts",), ("x",)], "p string") == [(T.COLOURS["fonts"],), (T.GREY,)]
    assert rows(spark, [T.operator_text(F.array(F.lit("/Im1")), F.lit("Do"))], [(1,)], "n long") == [("/Im1 Do",)]
