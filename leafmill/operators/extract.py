"""Image extraction: filter chain, predictors, pixels to PNG; one row per image, undecodable ones marked."""

from __future__ import annotations

from collections.abc import Iterator

from typing import Any

from pyspark.sql import DataFrame

from leafmill.functions import codecs
from leafmill.sources.pdf_file import Document, Name, Stream, filter_lists
from leafmill.sources.pdf_tables import map_files, opened

from .pages import whole

SCHEMA = "path string, obj_num long, gen int, page int, name string, width long, height long, pdf_size long, color_space string, bits int, format string, supported boolean, content binary"


def colour_space(doc: Document, value: object) -> str:
    v = doc.get(value)
    if isinstance(v, list) and v:
        v = doc.get(v[0])
    return str(v) if isinstance(v, Name) else "Unknown"


def extract(doc: Document, image: Stream) -> tuple[str, bool, bytes]:
    """Format, whether it is decoded, and bytes: JPEG as it is, samples as PNG, other codecs raw."""
    try:
        found = doc.decoded(image)
    except codecs.UnsupportedFilter:
        return "lzw", False, image.data
    except ValueError:
        return "raw", False, image.data
    if found.terminal == "jpeg":
        return "jpeg", True, found.data
    if found.terminal:
        return found.terminal, False, found.data
    width, height = whole(doc, image.dict.get("Width")) or 0, whole(doc, image.dict.get("Height")) or 0
    mask = doc.get(image.dict.get("ImageMask")) is True
    bits = 1 if mask else whole(doc, image.dict.get("BitsPerComponent")) or 8
    space = "DeviceGray" if mask else colour_space(doc, image.dict.get("ColorSpace"))
    pixels = codecs.samples_to_pixels(found.data, width, height, space, bits)
    return ("raw", False, found.data) if pixels is None else ("png", True, codecs.png(pixels))


def extract_images(files: DataFrame) -> DataFrame:
    """Images named by pages, each object once, at its first page; images inside forms are not looked for."""

    def rows(path: str, content: bytes) -> Iterator[dict[str, Any]]:
        if (doc := opened(content)) is None:
            return
        seen = set()
        for n, page in enumerate(doc.pages(), 1):
            for name, ref in doc.xobjects(page).items():
                image = doc.get(ref)
                if ref in seen or not isinstance(image, Stream) or doc.get(image.dict.get("Subtype")) != "Image":
                    continue
                seen.add(ref)
                kind, ok, data = extract(doc, image)
                yield {
                    "path": path, "obj_num": ref.num, "gen": ref.gen, "page": n, "name": name, "width": whole(doc, image.dict.get("Width")), "height": whole(doc, image.dict.get("Height")),
                    "pdf_size": len(image.data), "color_space": colour_space(doc, image.dict.get("ColorSpace")), "bits": whole(doc, image.dict.get("BitsPerComponent")) or 8,
                    "format": kind, "supported": ok, "content": data,
                }

    return map_files(files, SCHEMA, rows)


def samples(images: DataFrame) -> DataFrame:
    """(path, obj_num, gen, format, supported, samples): red, or gray, of every pixel of PNG rows; other rows' bytes as they are."""

    def rows(path: str, content: bytes, obj_num: int, gen: int, kind: str, supported: bool) -> Iterator[dict[str, Any]]:
        data = codecs.read_png(content)[..., 0].tobytes() if kind == "png" else content
        yield {"path": path, "obj_num": obj_num, "gen": gen, "format": kind, "supported": supported, "samples": data}

    return map_files(images, "path string, obj_num long, gen int, format string, supported boolean, samples binary", rows, "obj_num", "gen", "format", "supported")


def streams(files: DataFrame) -> DataFrame:
    """(path, obj_num, gen, filters, supported, decoded): every stream through its filter chain and predictors.

    What cannot be decoded (another filter, broken data) comes back as it is, with ``supported`` false; image
    codecs at the end of a chain are left to themselves.
    """

    def rows(path: str, content: bytes) -> Iterator[dict[str, Any]]:
        if (doc := opened(content)) is None:
            return
        for ref, value in doc.objects.items():
            if isinstance(value, Stream):
                try:
                    data, ok = doc.decoded(value).data, True
                except (codecs.UnsupportedFilter, ValueError):
                    data, ok = value.data, False
                yield {"path": path, "obj_num": ref.num, "gen": ref.gen, "filters": filter_lists(doc, value.dict)[0], "supported": ok, "decoded": data}

    return map_files(files, "path string, obj_num long, gen int, filters array<string>, supported boolean, decoded binary", rows)
