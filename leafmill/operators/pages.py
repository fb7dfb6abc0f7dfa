"""Page layer: drawing operators, image placements, and removal of placements.

Replaying the drawing state needs a stack, so it is plain Python per page; pages of many files run in
parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from leafmill.functions import codecs
from leafmill.sources.pdf_file import _END, Document, Lexer, Name, Ref, Stream, _Word
from leafmill.sources.pdf_tables import map_files, media_box, opened

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
STATE = {b"q", b"Q", b"cm"}
PLACEMENT_SCHEMA = (
    "path string, page int, op_idx int, name string, obj_num long, gen int, width long, height long, x double, y double, "
    "ctm array<double>, mediabox array<double>, raw_ops array<string>"
)


@dataclass
class Operation:
    operator: bytes
    operands: list[Any]
    start: int
    end: int


def times(m: Matrix, n: Matrix) -> Matrix:
    """Matrix ``m`` applied before ``n``."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l


def operations(data: bytes) -> list[Operation]:
    """Operators of a content stream with their operands and byte ranges; inline images are passed over."""
    lexer, out, operands = Lexer(data, refs=False), [], []
    lexer.skip()
    start = lexer.at
    while (value := lexer.value()) is not _END:
        if not isinstance(value, _Word):
            operands.append(value)
            continue
        if value == b"ID":
            end = data.find(b"EI", lexer.at)
            while end >= 0 and not (data[end - 1 : end].isspace() and (end + 2 == len(data) or data[end + 2 : end + 3].isspace())):
                end = data.find(b"EI", end + 1)
            lexer.at = len(data) if end < 0 else end + 2
        out.append(Operation(bytes(value), operands, start, lexer.at))
        operands = []
        lexer.skip()
        start = lexer.at
    return out


def operation_text(op: Operation) -> str:
    """Operands and operator; ``?`` for operands that are neither numbers nor names."""
    def one(v: Any) -> str:
        if isinstance(v, Name):
            return "/" + v
        return f"{v:g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else "?"

    return " ".join([*map(one, op.operands), op.operator.decode("latin-1")])


def page_content(doc: Document, page: Ref) -> tuple[bytes, list[Ref]]:
    """All content streams of a page joined in order, and their ids; what cannot be decoded counts as it is."""
    contents = doc.dict_of(page).get("Contents")
    target = doc.get(contents)
    refs = [r for r in (target if isinstance(target, list) else [contents]) if isinstance(r, Ref) and isinstance(doc.get(r), Stream)]
    parts = []
    for r in refs:
        stream = doc.get(r)
        try:
            parts.append(doc.decoded(stream).data)
        except (codecs.UnsupportedFilter, ValueError):
            parts.append(stream.data)
    return b"\n".join(parts), refs


def replay(doc: Document, page: Ref) -> Iterator[tuple[int, Operation, Ref, Stream, Matrix, list[str]]]:
    """Every drawing of an image XObject: operator index, operation, image, matrix and the last ten state operators."""
    found = {k: r for k, r in doc.xobjects(page).items() if isinstance(s := doc.get(r), Stream) and doc.get(s.dict.get("Subtype")) == "Image"}
    if not found:
        return
    data, _ = page_content(doc, page)
    if b"Do" not in data:
        return
    ctm, stack, recent = IDENTITY, [], []
    for k, op in enumerate(operations(data)):
        if op.operator in STATE:
            recent = (recent + [operation_text(op)])[-10:]
        if op.operator == b"q":
            stack.append(ctm)
        elif op.operator == b"Q":
            ctm = stack.pop() if stack else ctm
        elif op.operator == b"cm":
            numbers = [float(x) for x in op.operands if isinstance(x, (int, float)) and not isinstance(x, bool)]
            if len(numbers) == 6 and len(op.operands) == 6:
                ctm = times(tuple(numbers), ctm)
        elif op.operator == b"Do" and op.operands and isinstance(op.operands[-1], Name) and op.operands[-1] in found:
            ref = found[op.operands[-1]]
            yield k, op, ref, doc.get(ref), ctm, list(recent)


def whole(doc: Document, value: Any) -> int | None:
    v = doc.get(value)
    return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def contents(files: DataFrame) -> DataFrame:
    """(path, page, content): the decoded, joined content streams of every page."""

    def rows(path: str, content: bytes) -> Iterator[dict[str, Any]]:
        if (doc := opened(content)) is not None:
            for n, page in enumerate(doc.pages(), 1):
                yield {"path": path, "page": n, "content": page_content(doc, page)[0]}

    return map_files(files, "path string, page int, content binary", rows)


def placements(files: DataFrame) -> DataFrame:
    """Where every image of every page is drawn; position is the matrix' translation."""

    def rows(path: str, content: bytes) -> Iterator[dict[str, Any]]:
        if (doc := opened(content)) is None:
            return
        for n, page in enumerate(doc.pages(), 1):
            box = None
            for k, op, ref, image, ctm, recent in replay(doc, page):
                box = box or media_box(doc.dict_of(page), doc)
                yield {
                    "path": path, "page": n, "op_idx": k, "name": str(op.operands[-1]), "obj_num": ref.num, "gen": ref.gen, "width": whole(doc, image.dict.get("Width")),
                    "height": whole(doc, image.dict.get("Height")), "x": ctm[4], "y": ctm[5], "ctm": list(ctm), "mediabox": box, "raw_ops": recent,
                }

    return map_files(files, PLACEMENT_SCHEMA, rows)
