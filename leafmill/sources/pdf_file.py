"""Reading and writing one PDF file in memory, without any library.

Values are Python ones: numbers, booleans and None; bytes for strings; :class:`Name`, :class:`Ref`,
:class:`Stream`; lists and dictionaries.  Dictionary keys are plain strings without the slash.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from typing import Any

from leafmill.functions import codecs

_DELIMITERS = b"()<>[]{}/%"
_SKIP = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")
_BARE = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]*")
_HEX_IN_NAME = re.compile(rb"#([0-9A-Fa-f]{2})")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_REST_OF_REF = re.compile(rb"[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_LITERAL_RUN = re.compile(rb"[^()\\]+")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_WHOLE = re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+obj[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+endobj")
_ENTRY = re.compile(rb"[\0\t\n\x0c\r ]*(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+([nf])")
_END_OF_STREAM = re.compile(rb"[\0\t\n\x0c\r ]*endstream")
_SAFE_NAME = re.compile(r"[!\"$&'*+,\-.0-9:;=?@A-Z\\^_`a-z|~]*")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj")
_PER_STREAM = 200  # objects of one object stream
ROOT_KEYS = ("Root", "Info", "Encrypt", "AcroForm", "Names")


class Name(str):
    __slots__ = ()


@dataclass(frozen=True, order=True)
class Ref:
    num: int
    gen: int


@dataclass
class Stream:
    dict: dict[str, Any]
    data: bytes


class PdfError(ValueError):
    pass


class _Word(bytes):
    """A bare word: operator or keyword."""


_END = object()


class Lexer:
    """Values from bytes.  ``refs`` off (content streams): numbers stay numbers."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def word(self) -> bytes:
        m = _BARE.match(self.data, self.at)
        self.at = m.end()
        return m[0]

    def value(self, depth: int = 0) -> Any:
        if depth > 200:
            raise PdfError("nested too deeply")
        self.skip()
        data = self.data
        if self.at >= len(data):
            return _END
        b = data[self.at]
        if b == 0x2F:
            self.at += 1
            name = self.word()
            return Name((_HEX_IN_NAME.sub(lambda m: bytes([int(m[1], 16)]), name) if b"#" in name else name).decode("utf-8", "replace"))
        if b == 0x28:
            return self._literal()
        if b == 0x3C:
            if data[self.at : self.at + 2] == b"<<":
                self.at += 2
                return self._dict(depth)
            end = data.find(b">", self.at)
            end = len(data) if end < 0 else end
            out = codecs.asciihex(data[self.at + 1 : end])
            self.at = end + 1
            return out
        if b == 0x5B:
            self.at += 1
            out: list[Any] = []
            while True:
                self.skip()
                if self.at >= len(data):
                    return out
                if data[self.at] == 0x5D:
                    self.at += 1
                    return out
                x = self.value(depth + 1)
                if not isinstance(x, _Word):
                    out.append(x)
        if b in _DELIMITERS:
            self.at += 2 if data[self.at : self.at + 2] == b">>" else 1
            return _Word(data[self.at - 1 : self.at])
        word = self.word()
        if _NUMBER.match(word):
            if b"." in word:
                return float(word)
            n = int(word)
            if self.refs and n >= 0:
                if m := _REST_OF_REF.match(data, self.at):
                    self.at = m.end()
                    return Ref(n, int(m[1]))
            return n
        return {b"true": True, b"false": False, b"null": None}.get(word, _Word(word))

    def _literal(self) -> bytes:
        out, level, data = bytearray(), 0, self.data
        while self.at < len(data):
            if m := _LITERAL_RUN.match(data, self.at):
                out += m[0]
                self.at = m.end()
                continue
            b = data[self.at]
            self.at += 1
            if b == 0x28:
                level += 1
                if level == 1:
                    continue
            elif b == 0x29:
                level -= 1
                if level == 0:
                    break
            elif b == 0x5C and self.at < len(data):
                c = data[self.at]
                self.at += 1
                if 0x30 <= c <= 0x37:
                    m = _OCTAL.match(data, self.at - 1)
                    self.at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif c in b"\r\n":
                    if data[self.at - 1 : self.at + 1] == b"\r\n":
                        self.at += 1
                else:
                    out.append({0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}.get(c, c))
                continue
            out.append(b)
        return bytes(out)

    def _dict(self, depth: int) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while True:
            self.skip()
            if self.at >= len(self.data):
                return out
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.value(depth + 1)
            if not isinstance(key, Name):
                if key is _END:
                    return out
                continue
            x = self.value(depth + 1)
            if x is _END:
                return out
            out[str(key)] = x


@dataclass
class Document:
    objects: dict[Ref, Any] = field(default_factory=dict)
    trailer: dict[str, Any] = field(default_factory=dict)
    version: str = "1.7"

    def get(self, value: Any) -> Any:
        """The value behind references; None if they lead nowhere or in a circle."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value)
        return None

    def dict_of(self, value: Any) -> dict[str, Any]:
        value = self.get(value)
        return value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def decoded(self, stream: Stream) -> codecs.Decoded:
        filters, parms = filter_lists(self, stream.dict)
        return codecs.decode_chain(stream.data, filters, parms)

    def reachable(self, keys: tuple[str, ...] = ROOT_KEYS) -> set[Ref]:
        todo = [r for k in keys if k in self.trailer for r in references(self.trailer[k])]
        seen: set[Ref] = set()
        while todo:
            r = todo.pop()
            if r not in seen and r in self.objects:
                seen.add(r)
                todo += references(self.objects[r])
        return seen

    def pages(self) -> list[Ref]:
        """Page objects in the order of the tree; every node counts once."""
        out: list[Ref] = []
        root = self.dict_of(self.trailer.get("Root")).get("Pages")
        todo, seen = [root], set()
        while todo:
            r = todo.pop()
            if not isinstance(r, Ref) or r in seen:
                continue
            seen.add(r)
            d = self.dict_of(r)
            kids = self.get(d.get("Kids"))
            if isinstance(kids, list):
                todo += reversed(kids)
            elif d:
                out.append(r)
        return out

    def page_count(self) -> int:
        count = self.get(self.dict_of(self.dict_of(self.trailer.get("Root")).get("Pages")).get("Count"))
        return max(count, 0) if isinstance(count, int) and not isinstance(count, bool) else len(self.pages())

    def xobjects(self, page: Ref) -> dict[str, Ref]:
        """XObject resources of the page or of its nearest ancestor that has any."""
        seen: set[Ref] = set()
        at: Any = page
        while isinstance(at, Ref) and at not in seen:
            seen.add(at)
            d = self.dict_of(at)
            found = self.dict_of(self.dict_of(d.get("Resources")).get("XObject"))
            if found:
                return {k: v for k, v in found.items() if isinstance(v, Ref)}
            at = d.get("Parent")
        return {}


def references(value: Any) -> list[Ref]:
    """All references in a value, through dictionaries, lists and stream dictionaries."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, Ref):
            out.append(v)
        elif isinstance(v, Stream):
            todo.append(v.dict)
        elif isinstance(v, dict):
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return out


def is_container(value: Any) -> bool:
    """Object and cross-reference streams: parts of the file's form that no object refers to."""
    return isinstance(value, Stream) and value.dict.get("Type") in ("ObjStm", "XRef")


def filter_lists(doc: Document, d: dict[str, Any]) -> tuple[list[str], list[dict | None]]:
    def as_list(key: str) -> list[Any]:
        v = doc.get(d.get(key))
        return [doc.get(x) for x in v] if isinstance(v, list) else [] if v is None else [v]

    filters = [str(x) for x in as_list("Filter") if isinstance(x, Name)]
    parms = [{k: doc.get(v) for k, v in x.items()} if isinstance(x, dict) else None for x in as_list("DecodeParms")]
    return filters, parms


# --- reading


def _object_at(data: bytes, at: int, doc: Document | None, lengths: dict[Ref, int]) -> tuple[Ref, Any, int]:
    """Reads ``N G obj ... endobj``; returns id, value and the place behind it."""
    m = _OBJECT.match(data, at)
    if not m:
        raise PdfError("no object here")
    lexer = Lexer(data, m.end())
    value = lexer.value()
    value = None if value is _END or isinstance(value, _Word) else value
    lexer.skip()
    if isinstance(value, dict) and data[lexer.at : lexer.at + 6] == b"stream":
        start = lexer.at + 6
        start += 2 if data[start : start + 2] == b"\r\n" else 1 if data[start : start + 1] in (b"\n", b"\r") else 0
        n = value.get("Length")
        n = lengths.get(n) if isinstance(n, Ref) else n
        if not isinstance(n, int) or n < 0 or not _END_OF_STREAM.match(data, start + n):
            end = data.find(b"endstream", start)
            end = len(data) if end < 0 else end
            n = end - start
            if data[end - 2 : end] == b"\r\n":
                n -= 2
            elif n and data[end - 1 : end] in (b"\n", b"\r"):
                n -= 1
        value = Stream(value, data[start : start + n])
        lexer.at = start + n
    return Ref(int(m[1]), int(m[2])), value, lexer.at


def _table(data: bytes, at: int) -> tuple[dict[int, tuple[int, int, int]], dict[str, Any]]:
    """Entries (type, a, b) and trailer of a classic table or a cross-reference stream."""
    entries: dict[int, tuple[int, int, int]] = {}
    lexer = Lexer(data, at)
    lexer.skip()
    if data[lexer.at : lexer.at + 4] == b"xref":
        lexer.at += 4
        while True:
            first = lexer.value()
            if isinstance(first, _Word):
                if first != b"trailer":
                    raise PdfError("broken cross-reference table")
                trailer = lexer.value()
                return entries, trailer if isinstance(trailer, dict) else {}
            count = lexer.value()
            if not isinstance(first, int) or not isinstance(count, int):
                raise PdfError("broken cross-reference table")
            for k in range(count):
                m = _ENTRY.match(data, lexer.at)
                if not m:
                    raise PdfError("broken cross-reference table")
                lexer.at = m.end()
                entries[first + k] = (1, int(m[1]), int(m[2])) if m[3] == b"n" else (0, 0, 0)
    _, value, _ = _object_at(data, lexer.at, None, {})
    if not isinstance(value, Stream):
        raise PdfError("no cross-reference stream")
    d = value.dict
    rows = Document().decoded(value).data
    widths = [int(x) for x in d.get("W", [1, 2, 1])]
    index = d.get("Index") or [0, d.get("Size", 0)]
    at = 0
    for first, count in zip(index[::2], index[1::2], strict=False):
        for k in range(count):
            got = []
            for j, w in enumerate(widths):
                got.append(int.from_bytes(rows[at : at + w], "big") if w else (1 if j == 0 else 0))
                at += w
            if at > len(rows):
                return entries, d
            entries[first + k] = tuple(got)
    return entries, d


def _unpack(doc: Document, holder: Stream) -> dict[int, Any]:
    """Objects of an object stream."""
    data = doc.decoded(holder).data
    n, first = doc.get(holder.dict.get("N")) or 0, doc.get(holder.dict.get("First")) or 0
    head = Lexer(data, 0, refs=False)
    pairs = [(head.value(), head.value()) for _ in range(n)]
    out = {}
    for num, offset in pairs:
        if isinstance(num, int) and isinstance(offset, int):
            value = Lexer(data, first + offset).value()
            out[num] = None if value is _END or isinstance(value, _Word) else value
    return out


def parse(data: bytes) -> Document:
    """A document; falls back to a scan for objects where the cross-reference is broken."""
    if b"%PDF-" not in data[:1024] and not _OBJECT.search(data):
        raise PdfError("not a PDF file")
    m = re.search(rb"%PDF-(\d+\.\d+)", data[:1024])
    doc = Document(version=m[1].decode() if m else "1.7")
    try:
        _by_table(data, doc)
    except (PdfError, ValueError, TypeError, IndexError, KeyError, RecursionError):
        doc.objects, doc.trailer = {}, {}
    if not isinstance(doc.trailer.get("Root"), Ref) or doc.trailer["Root"] not in doc.objects:
        _by_scan(data, doc)
    if not doc.objects:
        raise PdfError("no objects")
    return doc


def _by_table(data: bytes, doc: Document) -> None:
    at = data.rfind(b"startxref")
    place = Lexer(data, at + 9).value() if at >= 0 else None
    if not isinstance(place, int):
        raise PdfError("no startxref")
    entries: dict[int, tuple[int, int, int]] = {}
    todo, seen = [place], set()
    while todo:
        place = todo.pop(0)
        if not isinstance(place, int) or place in seen or not 0 <= place < len(data):
            continue
        seen.add(place)
        found, trailer = _table(data, place)
        for k, v in found.items():
            entries.setdefault(k, v)
        for k, v in trailer.items():
            doc.trailer.setdefault(k, v)
        todo += [trailer.get("XRefStm"), trailer.get("Prev")]
    lengths: dict[Ref, int] = {}
    for num, (kind, a, b) in entries.items():  # whole numbers first: lengths of streams
        if kind == 1 and (m := _WHOLE.match(data, a)):
            lengths[Ref(num, b)] = int(m[3])
    for num, (kind, a, b) in entries.items():
        if kind == 1:
            ref, value, _ = _object_at(data, a, doc, lengths)
            if ref.num != num:
                raise PdfError("the cross-reference points elsewhere")
            doc.objects[ref] = value
    for num, (kind, a, _) in entries.items():
        if kind == 2:
            holder = doc.objects.get(Ref(a, 0))
            if isinstance(holder, Stream):
                if not hasattr(holder, "unpacked"):
                    holder.unpacked = _unpack(doc, holder)
                if num in holder.unpacked:
                    doc.objects[Ref(num, 0)] = holder.unpacked[num]


def _by_scan(data: bytes, doc: Document) -> None:
    lengths = {Ref(int(m[1]), int(m[2])): int(m[3]) for m in _WHOLE.finditer(data)}
    at = 0
    while m := _OBJECT.search(data, at):
        try:
            ref, value, at = _object_at(data, m.start(), doc, lengths)
            doc.objects[ref] = value
        except (PdfError, ValueError, RecursionError):
            at = m.end()
    for m in re.finditer(rb"trailer", data):
        trailer = Lexer(data, m.end()).value()
        if isinstance(trailer, dict):
            doc.trailer.update(trailer)
    for ref, value in list(doc.objects.items()):
        kind = value.dict.get("Type") if isinstance(value, Stream) else value.get("Type") if isinstance(value, dict) else None
        if kind == "ObjStm":
            for num, v in _unpack(doc, value).items():
                doc.objects.setdefault(Ref(num, 0), v)
        elif kind == "XRef":
            doc.trailer.update({k: v for k, v in value.dict.items() if k in (*ROOT_KEYS, "ID")})
    if "Root" not in doc.trailer:
        for ref, value in doc.objects.items():
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                doc.trailer["Root"] = ref


# --- writing


def _text(value: Any, out: bytearray) -> None:
    if isinstance(value, Name):
        out += b"/" + value.encode() if _SAFE_NAME.fullmatch(value) else b"/" + re.sub(rb"[^!\"$&'*+,\-.0-9:;=?@A-Z\\^_`a-z|~]", lambda m: b"#%02X" % m[0][0], value.encode())
    elif isinstance(value, bool):
        out += b"true" if value else b"false"
    elif value is None:
        out += b"null"
    elif isinstance(value, int):
        out += str(value).encode()
    elif isinstance(value, float):
        out += (f"{value:.6f}".rstrip("0").rstrip(".") or "0").encode()
    elif isinstance(value, Ref):
        out += f"{value.num} {value.gen} R".encode()
    elif isinstance(value, bytes):
        out += b"<" + value.hex().encode() + b">"
    elif isinstance(value, list):
        out += b"["
        for k, x in enumerate(value):
            out += b" " if k else b""
            _text(x, out)
        out += b"]"
    elif isinstance(value, dict):
        out += b"<<"
        for k, x in value.items():
            _text(Name(k), out)
            out += b" "
            _text(x, out)
        out += b">>"
    else:
        raise TypeError(type(value))


def serialise(doc: Document) -> bytes:
    """The file with a classic cross-reference table; object and cross-reference streams are left out."""
    out = bytearray(f"%PDF-{doc.version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1"))
    places: dict[Ref, int] = {}
    for ref in sorted(doc.objects):
        value = doc.objects[ref]
        if is_container(value):
            continue
        places[ref] = len(out)
        out += f"{ref.num} {ref.gen} obj\n".encode()
        if isinstance(value, Stream):
            _text({**value.dict, "Length": len(value.data)}, out)
            out += b"\nstream\n" + value.data + b"\nendstream"
        else:
            _text(value, out)
        out += b"\nendobj\n"
    size = max((r.num for r in places), default=0) + 1
    by_num = {r.num: (places[r], r.gen) for r in places}
    start = len(out)
    out += f"xref\n0 {size}\n0000000000 65535 f \n".encode()
    for num in range(1, size):
        out += b"%010d %05d n \n" % by_num[num] if num in by_num else b"0000000000 65535 f \n"
    trailer = {k: v for k, v in doc.trailer.items() if k in (*ROOT_KEYS, "ID")}
    out += b"trailer\n"
    _text({"Size": size, **trailer}, out)
    out += f"\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def serialise_packed(doc: Document) -> bytes:
    """The file with plain objects deflated in object streams, and a cross-reference stream."""
    kept = {r: v for r, v in sorted(doc.objects.items()) if not is_container(v)}
    plain = [r for r, v in kept.items() if r.gen == 0 and not isinstance(v, Stream) and r != doc.trailer.get("Encrypt")]
    top = max((r.num for r in kept), default=0)
    version = doc.version if float(doc.version) >= 1.5 else "1.5"
    out = bytearray(f"%PDF-{version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1"))
    rows: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}

    def put(ref: Ref, value: Any) -> None:
        rows[ref.num] = (1, len(out), ref.gen)
        out.extend(f"{ref.num} {ref.gen} obj\n".encode())
        if isinstance(value, Stream):
            _text({**value.dict, "Length": len(value.data)}, out)
            out.extend(b"\nstream\n" + value.data + b"\nendstream")
        else:
            _text(value, out)
        out.extend(b"\nendobj\n")

    packed = set(plain)
    for ref, value in kept.items():
        if ref not in packed:
            put(ref, value)
    for k in range(0, len(plain), _PER_STREAM):
        top += 1
        index, body = bytearray(), bytearray()
        for n, ref in enumerate(plain[k : k + _PER_STREAM]):
            index += f"{ref.num} {len(body)} ".encode()
            _text(kept[ref], body)
            body += b" "
            rows[ref.num] = (2, top, n)
        entries = {"Type": Name("ObjStm"), "N": len(plain[k : k + _PER_STREAM]), "First": len(index), "Filter": Name("FlateDecode")}
        put(Ref(top, 0), Stream(entries, zlib.compress(bytes(index + body), 9)))
    start, top = len(out), top + 1
    rows[top] = (1, start, 0)
    table = b"".join(kind.to_bytes(1, "big") + a.to_bytes(5, "big") + b.to_bytes(2, "big") for kind, a, b in (rows.get(n, (0, 0, 0)) for n in range(top + 1)))
    trailer = {k: v for k, v in doc.trailer.items() if k in (*ROOT_KEYS, "ID")}
    put(Ref(top, 0), Stream({"Type": Name("XRef"), "Size": top + 1, "W": [1, 5, 2], "Filter": Name("FlateDecode"), **trailer}, zlib.compress(table, 9)))
    out.extend(f"startxref\n{start}\n%%EOF\n".encode())
    return bytes(out)


def smallest(doc: Document) -> bytes:
    """The shorter of the two ways to write a document."""
    return min(serialise(doc), serialise_packed(doc), key=len)
