"""Compressed previews of extracted images: resize, reduce colours, choose the narrowest lossless form.

Previews are a table keyed by (path, obj_num, gen).  New ones replace old ones by key; undoing is an
anti-join; the rest of a session (selection, totals) is plain relational work on it.  Output is PNG-like
(deflated samples); JPEG and WebP need an encoder that is not here, such rows come back unsupported.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import codecs, pixels
from leafmill.functions.text import image_format
from leafmill.sources.pdf_tables import map_files

KEY = ["path", "obj_num", "gen"]
SCHEMA = "path string, obj_num long, gen int, kind string, data binary, width int, height int, original_size long, compressed_size long, force boolean, supported boolean, error string"
_COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class CompressOptions:
    format: str = "png"
    scale: float = 1.0
    max_width: int | None = None
    colours: str = "none"
    threshold: int | None = None


def narrowest(rgba) -> tuple[str, bytes]:
    """One bit, one gray byte or three bytes per pixel, whichever loses nothing."""
    if pixels.is_binary(rgba):
        return "bits", pixels.pack_bits(rgba[..., 0])
    if pixels.is_gray(rgba):
        return "gray", rgba[..., 0].tobytes()
    return "rgb", rgba[..., :3].tobytes()


def compress(images: DataFrame, options: CompressOptions) -> DataFrame:
    """Previews of images (path, obj_num, gen, content, pdf_size, and force if there is such a column).

    A failed image is a row with an error, not a failed job.
    """
    force = F.col("force") if "force" in images.columns else F.lit(False)
    rows = images.select(*KEY, "content", "pdf_size", force.alias("force"))

    def one(data: bytes) -> tuple[str, bytes, int, int]:
        rgba = codecs.read_png(data)
        width, height = pixels.target_size(rgba.shape[1], rgba.shape[0], options.scale, options.max_width)
        if (width, height) != (rgba.shape[1], rgba.shape[0]):
            rgba = pixels.resize(rgba, width, height)
        if pixels.has_alpha(rgba):
            rgba = pixels.flatten_on_white(rgba)
        return *narrowest(pixels.reduce_colours(rgba, options.colours, options.threshold)), width, height

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                head, tail = (r.path, r.obj_num, r.gen), (bool(r.force),)
                try:
                    if options.format != "png":
                        raise ValueError(f"no {options.format} encoder")
                    kind, data, width, height = one(bytes(r.content))
                    out.append((*head, kind, data, width, height, r.pdf_size, len(zlib.compress(data, 9)), *tail, True, None))
                except (ValueError, KeyError, TypeError, zlib.error) as e:
                    out.append((*head, None, None, None, None, r.pdf_size, None, *tail, False, str(e)[:200]))
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS).astype({"width": "Int32", "height": "Int32", "compressed_size": "Int64"})

    return rows.mapInPandas(run, SCHEMA)


def without_preview(images: DataFrame, previews: DataFrame) -> DataFrame:
    """Images that have no preview yet, whatever its settings."""
    return images.join(previews.select(*KEY), KEY, "left_anti")


def upsert(previews: DataFrame, new: DataFrame) -> DataFrame:
    """Previews with the usable new ones in place of old ones of the same image."""
    usable = new.filter("supported")
    return previews.join(usable.select(*KEY), KEY, "left_anti").unionByName(usable)


def undo(previews: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Previews without the chosen images', or none at all."""
    return previews.limit(0) if chosen is None else previews.join(chosen.select(*KEY), KEY, "left_anti")


def selected(images: DataFrame, chosen: DataFrame, previews: DataFrame) -> DataFrame:
    """Chosen images that are supported, with whether they have a preview."""
    mine = images.filter("supported").join(chosen.select(*KEY), KEY, "left_semi")
    return mine.join(previews.select(*KEY, F.lit(True).alias("has_preview")), KEY, "left").withColumn("has_preview", F.coalesce("has_preview", F.lit(False)))


def preview_pngs(images: DataFrame, side: int = 400, most: int = 24_000_000) -> DataFrame:
    """(path, obj_num, gen, width, height, content): small PNG pictures of PNG rows; what cannot be read is left out."""

    def rows(path: str, content: bytes, obj_num: int, gen: int) -> Iterator[dict]:
        try:
            small = pixels.preview(codecs.read_png(content), side, most)
        except (ValueError, KeyError, zlib.error):
            return
        yield {"path": path, "obj_num": obj_num, "gen": gen, "width": small.shape[1], "height": small.shape[0], "preview": codecs.png(small)}

    return map_files(images, "path string, obj_num long, gen int, width int, height int, preview binary", rows, "obj_num", "gen")


def user_replacements(files: DataFrame, path: str = "path") -> DataFrame:
    """Files of a user as replacement images: format by extension (png, webp, else jpeg), always forced."""
    form = image_format(F.col(path))
    return files.withColumns({"format": F.when(form.isin("png", "webp"), form).otherwise("jpeg"), "force": F.lit(True)})


def with_bytes(entries: DataFrame, files: DataFrame, path: str = "image_path") -> DataFrame:
    """Entries with the bytes of the file that they name; entries whose file is not there are left out."""
    return entries.join(files.select(F.col("path").alias(path), F.col("content").alias("data")), path)
