"""A small deterministic writer of test files, independent of the library's own writer."""

from __future__ import annotations

import zlib


class Builder:
    """Objects as raw bytes, written with a classic table or with a cross-reference stream."""

    def __init__(self):
        self.bodies: dict[int, bytes] = {}

    def add(self, num: int, body: bytes | str) -> Builder:
        self.bodies[num] = body if isinstance(body, bytes) else body.encode("latin-1")
        return self

    def stream(self, num: int, data: bytes, entries: str = "", length: str | None = None) -> Builder:
        head = f"<<{entries} /Length {len(data) if length is None else length}>>\nstream\n".encode("latin-1")
        return self.add(num, head + data + b"\nendstream")

    def build(self, trailer: str, packed: list[int] | None = None) -> bytes:
        out, places = bytearray(b"%PDF-1.6\n"), {}
        for num, body in self.bodies.items():
            if packed is None or num not in packed:
                places[num] = len(out)
                out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
        size = max(self.bodies) + 1
        if packed is None:
            start = len(out)
            out += b"xref\n0 %d\n0000000000 65535 f \n" % size
            for num in range(1, size):
                out += b"%010d 00000 n \n" % places[num] if num in places else b"0000000000 00000 f \n"
            out += f"trailer\n<<{trailer} /Size {size}>>\nstartxref\n{start}\n%%EOF\n".encode("latin-1")
            return bytes(out)
        head, body = b"", b""
        for num in packed:
            head += b"%d %d " % (num, len(body))
            body += self.bodies[num] + b" "
        data = zlib.compress(head + body)
        places[size] = len(out)
        out += b"%d 0 obj\n<</Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d>>\nstream\n" % (size, len(packed), len(head), len(data)) + data + b"\nendstream\nendobj\n"
        places[size + 1] = start = len(out)
        rows = b""
        for num in range(size + 2):
            if num in places:
                row = (1, places[num], 0)
            elif num in packed:
                row = (2, size, packed.index(num))
            else:
                row = (0, 0, 0)
            rows += bytes([row[0]]) + row[1].to_bytes(4, "big") + row[2].to_bytes(2, "big")
        # with the PNG "up" predictor, as producers do
        width, last, coded = 7, bytes(7), b""
        for k in range(0, len(rows), width):
            line = rows[k : k + width]
            coded += b"\x02" + bytes((a - b) & 255 for a, b in zip(line, last))
            last = line
        coded = zlib.compress(coded)
        out += f"{size + 1} 0 obj\n<</Type /XRef /W [1 4 2] /Size {size + 2} {trailer} /Filter /FlateDecode /DecodeParms <</Predictor 12 /Columns 7>> /Length {len(coded)}>>\nstream\n".encode("latin-1") + coded + b"\nendstream\nendobj\n"
        out += b"startxref\n%d\n%%%%EOF\n" % start
        return bytes(out)


def one_page(content: bytes = b"BT /F1 12 Tf (Hi) Tj ET", page_entries: str = "", resources: str = "", more: Builder | None = None, trailer: str = "") -> bytes:
    """Catalog 1, pages 2, page 3, content 4, and whatever ``more`` adds."""
    b = more or Builder()
    b.add(1, "<</Type /Catalog /Pages 2 0 R>>") if 1 not in b.bodies else None
    b.add(2, "<</Type /Pages /Kids [3 0 R] /Count 1>>") if 2 not in b.bodies else None
    b.add(3, f"<</Type /Page /Parent 2 0 R /Contents 4 0 R /Resources <<{resources}>> {page_entries}>>") if 3 not in b.bodies else None
    b.stream(4, content) if 4 not in b.bodies else None
    return b.build(f"/Root 1 0 R {trailer}")
