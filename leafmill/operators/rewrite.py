"""Rewriting PDF files: pruning, image removal, image replacement.

One file is one unit of work; options are arguments of the plan.  Results carry the new bytes, sizes
and what was done; a file that cannot be parsed comes back unchanged with a status.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import codecs
from leafmill.sources.pdf_file import Document, Name, PdfError, Ref, Stream, filter_lists, is_container, parse, references, smallest
from leafmill.sources.pdf_tables import map_files

from . import pages as G

RESULT = "path string, status string, content binary, original_size long, new_size long, savings long, savings_percent double, changed int, affected_pages int, actions array<string>"


@dataclass(frozen=True)
class PruneOptions:
    """Switches in order of application, with their defaults."""

    xmp_metadata: bool = True
    info: bool = True
    javascript: bool = True
    embedded_files: bool = True
    thumbnails: bool = True
    annotations: bool = False
    structure_tree: bool = False
    page_labels: bool = True
    piece_info: bool = True
    mark_info: bool = False
    compress_streams: bool = True
    garbage: bool = True


#: Switches that remove something a reader may miss; all others are safe.
UNSAFE = {"annotations", "structure_tree", "mark_info"}


def option_table(spark) -> DataFrame:
    """(key, position, default, safe) of every switch."""
    rows = [(f.name, k, bool(f.default), f.name not in UNSAFE) for k, f in enumerate(fields(PruneOptions))]
    return spark.createDataFrame(rows, "key string, position int, default boolean, safe boolean")


@dataclass
class Change:
    changed: int = 0
    pages: int = 0
    actions: list[str] = field(default_factory=list)

    def note(self, text: str, n: int = 1) -> None:
        self.actions.append(text)
        self.changed += n


def prune(doc: Document, options: PruneOptions) -> Change:
    out = Change()
    catalog = doc.dict_of(doc.trailer.get("Root"))
    pages = [doc.dict_of(r) for r in doc.pages()]

    def drop(d: dict[str, Any], *keys: str) -> int:
        return sum(d.pop(k, _MISSING) is not _MISSING for k in keys)

    if options.xmp_metadata and drop(catalog, "Metadata"):
        out.note("removed document metadata")
    info = doc.get(doc.trailer.get("Info"))
    if options.info and isinstance(info, dict) and info:
        info.clear()
        out.note("emptied document information")
    if options.javascript and (n := drop(catalog, "Names", "AcroForm", "OpenAction")):
        out.note("removed scripts and actions", n)
    names = catalog.get("Names")
    if options.embedded_files and isinstance(names, Ref) and drop(doc.dict_of(names), "EmbeddedFiles"):
        out.note("removed embedded files")
    for on, key, label in ((options.thumbnails, "Thumb", "thumbnails"), (options.annotations, "Annots", "annotations")):
        if on and (n := sum(drop(p, key) for p in pages)):
            out.note(f"removed {n} {label}", n)
    if options.structure_tree and (n := drop(catalog, "MarkInfo", "StructTreeRoot")):
        out.note("removed structure tree", n)
    if options.page_labels and drop(catalog, "PageLabels"):
        out.note("removed page labels")
    if options.piece_info:
        if drop(catalog, "PieceInfo"):
            out.note("removed private data")
        out.changed += sum(drop(p, "PieceInfo") for p in pages)
    if options.mark_info and drop(catalog, "MarkInfo"):
        out.note("removed mark information")
    if options.compress_streams and (n := sum(_compress(doc, v) for v in doc.objects.values() if isinstance(v, Stream))):
        out.note(f"compressed {n} streams", n)
    if options.garbage:
        keep = doc.reachable() | {r for r, v in doc.objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog"}
        gone = [r for r, v in doc.objects.items() if r not in keep and not is_container(v)]
        for r in gone:
            del doc.objects[r]
        if gone:
            out.note(f"removed {len(gone)} unused objects", len(gone))
    return out


_MISSING = object()


def _compress(doc: Document, stream: Stream) -> bool:
    """Deflates a stream without any filter, if it is no image or font program, is worth it and shrinks."""
    d = stream.dict
    if "Filter" in d or len(stream.data) <= 100 or doc.get(d.get("Subtype")) in ("Image", "Type1C", "OpenType", "CIDFontType0C") or doc.get(d.get("Type")) in ("FontFile", "XRef", "ObjStm"):
        return False
    packed = zlib.compress(stream.data, 9)
    if len(packed) >= len(stream.data):
        return False
    stream.data, d["Filter"] = packed, Name("FlateDecode")
    d.pop("DecodeParms", None)
    return True


def remove_images(doc: Document, sizes: list[tuple[int, int]], low: float = 0.0, high: float = 9999.0) -> Change:
    """Removes drawings of images with one of the pixel sizes whose vertical position lies in the window.

    An image object goes only when nothing refers to it any more.
    """
    out, removed = Change(), set()
    wanted = {s for s in sizes if s[0] > 0 and s[1] > 0}
    for n, page in enumerate(doc.pages(), 1):
        hits = [(op, ref) for _, op, ref, image, ctm, _ in G.replay(doc, page) if (G.whole(doc, image.dict.get("Width")), G.whole(doc, image.dict.get("Height"))) in wanted and low <= ctm[5] <= high]
        if not hits:
            continue
        data, refs = G.page_content(doc, page)
        kept, at = [], 0
        for op, _ in hits:
            kept.append(data[at : op.start])
            at = op.end
        body = b"".join([*kept, data[at:]])
        for k, r in enumerate(refs):
            stream = doc.get(r)
            filtered = bool(filter_lists(doc, stream.dict)[0])
            new = body if k == 0 else b""
            for key in ("Filter", "DecodeParms"):
                stream.dict.pop(key, None)
            if filtered:
                new, stream.dict["Filter"] = zlib.compress(new, 9), Name("FlateDecode")
            stream.data = new
        left = {str(op.operands[-1]) for _, op, *_ in G.replay(doc, page)}
        resources = doc.dict_of(doc.dict_of(doc.dict_of(page).get("Resources")).get("XObject"))
        for op, ref in hits:
            removed.add(ref)
            if str(op.operands[-1]) not in left and resources.get(str(op.operands[-1])) == ref:
                resources.pop(str(op.operands[-1]))
        out.note(f"page {n}: removed {len(hits)} images", len(hits))
        out.pages += 1
    still = doc.reachable()
    used = {r for v in (doc.objects[k] for k in still if k not in removed) for r in references(v)}
    for r in removed - used:
        del doc.objects[r]
    return out


# What an image dictionary says about each kind of new bytes.
SHAPES = {
    "jpeg": {"Filter": Name("DCTDecode"), "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8},
    "gray": {"Filter": Name("FlateDecode"), "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8},
    "rgb": {"Filter": Name("FlateDecode"), "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8},
    "bits": {"Filter": Name("FlateDecode"), "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 1},
}


@dataclass
class Replacement:
    """New bytes of an image: encoded for ``jpeg``, raw samples else."""

    ref: Ref
    kind: str
    data: bytes
    width: int
    height: int
    force: bool = False


def replace_images(doc: Document, replacements: list[Replacement], merge: bool = True) -> Change:
    """Puts new image bytes in place where they are smaller, or forced.

    Other dictionary keys stay; without ``merge`` the dictionary is a new one, and masks and such are lost.
    """
    out = Change()
    for r in replacements:
        old = doc.objects.get(r.ref)
        if not isinstance(old, Stream):
            out.actions.append(f"{r.ref.num} {r.ref.gen}: no such image")
            continue
        data = r.data if r.kind == "jpeg" else zlib.compress(r.data, 9)
        if not r.force and len(data) >= len(old.data):
            out.actions.append(f"{r.ref.num} {r.ref.gen}: kept, it would not shrink")
            continue
        if not merge:
            old.dict = {"Type": Name("XObject"), "Subtype": Name("Image")}
        for key in ("DecodeParms", "Decode"):
            old.dict.pop(key, None)
        old.dict.update(SHAPES[r.kind] | {"Width": r.width, "Height": r.height})
        out.note(f"{r.ref.num} {r.ref.gen}: {len(old.data)} to {len(data)} bytes")
        old.data = data
    return out


def _rewritten(files: DataFrame, change: Callable[..., Change], *extra: str) -> DataFrame:
    def rows(path: str, old: bytes, *more: Any) -> Iterator[dict[str, Any]]:
        done, status, new = Change(), "ok", old
        try:
            doc = parse(old)
            if "Encrypt" in doc.trailer:
                status = "encrypted"
            else:
                done = change(doc, *more)
                # without any change the input is copied; else the smaller of two ways to write the new one
                new = smallest(doc) if done.changed else old
        except (PdfError, ValueError, RecursionError, codecs.UnsupportedFilter) as e:
            done, status, new = Change(), f"failed: {e}"[:200], old
        saved = len(old) - len(new)
        yield {
            "path": path, "status": status, "content": new, "original_size": len(old), "new_size": len(new), "savings": saved,
            "savings_percent": saved * 100.0 / len(old) if old else 0.0, "changed": done.changed, "affected_pages": done.pages, "actions": done.actions,
        }

    return map_files(files, RESULT, rows, *extra)


def prune_files(files: DataFrame, options: PruneOptions | None = None, switches: str | None = None) -> DataFrame:
    """``switches`` names a column of ``files`` that lists what is on for each file, in place of ``options``."""
    if switches is not None:
        names = [f.name for f in fields(PruneOptions)]
        return _rewritten(files, lambda doc, on: prune(doc, PruneOptions(**{n: n in (on or []) for n in names})), switches)
    chosen = options or PruneOptions()
    return _rewritten(files, lambda doc: prune(doc, chosen))


def remove_images_from_files(files: DataFrame, sizes: list[tuple[int, int]], low: float = 0.0, high: float = 9999.0) -> DataFrame:
    return _rewritten(files, lambda doc: remove_images(doc, sizes, low, high))


def replace_images_in_files(files: DataFrame, replacements: DataFrame, merge: bool = True) -> DataFrame:
    """``replacements``: path, obj_num, gen, kind, data, width, height, force."""
    lists = replacements.groupBy("path").agg(F.collect_list(F.struct("obj_num", "gen", "kind", "data", "width", "height", "force")).alias("new"))

    def change(doc: Document, new: list[dict] | None) -> Change:
        return replace_images(doc, [Replacement(Ref(x["obj_num"], x["gen"]), x["kind"], x["data"], x["width"], x["height"], bool(x["force"])) for x in new or []], merge)

    return _rewritten(files.join(lists, "path", "left"), change, "new")


def relative(path: str, base: str | None) -> str:
    """Where a file lies below ``base``; its whole path, without scheme and root, if it does not."""
    plain = [re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", x) for x in (path, base or "/")]
    root = plain[1].rstrip("/") + "/"
    below = plain[0][len(root) :] if plain[0].startswith(root) else plain[0]
    return "/".join(p for p in below.split("/") if p not in ("", ".", ".."))


def write_files(results: DataFrame, folder: str, base: str | None = None) -> DataFrame:
    """Writes each result below ``folder``, at its path relative to ``base``: beside its place, then renamed.

    ``folder`` is a path or an address of any store that Arrow writes to (``hdfs://``, ``s3://``, ...); on a
    cluster a plain path must be one that all machines share.  Files of equal name in different folders
    stay apart.  A task that runs again writes its files again.
    """
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        for batch in batches:
            done = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, target = content.as_py() or b"", f"{root.rstrip('/')}/{relative(path, base)}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, target)
                done.append({"path": path, "target": target, "bytes": len(data)})
            if done:
                yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("target", pa.string()), ("bytes", pa.int64())]))

    return results.select("path", "content").mapInArrow(run, "path string, target string, bytes long")
