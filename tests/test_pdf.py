import hashlib
import zlib

import pytest
from pdf_builder import Builder, one_page

from leafmill.operators import documents as D
from leafmill.operators import extract as E
from leafmill.operators import pages as G
from leafmill.operators import rewrite as W
from leafmill.sources import pdf_tables as P
from leafmill.sources.pdf_file import Document, Lexer, Name, PdfError, Ref, Stream, is_container, parse, serialise, serialise_packed, smallest

HAND_WRITTEN = b"""%PDF-1.4
1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj
2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj
3 0 obj <</Type/Page/Parent 2 0 R/MediaBox[0 0 10 20]>> endobj
trailer <</Root 1 0 R>>
%%EOF"""


def image(data, entries="", w=2, h=1):
    return f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /BitsPerComponent 8 /ColorSpace /DeviceRGB {entries}", data


def rich_file():
    b = Builder()
    b.add(1, "<</Type /Catalog /Pages 2 0 R /Names 14 0 R /PageLabels <</Nums []>> /Metadata 13 0 R>>")
    b.add(2, "<</Type /Pages /Kids [3 0 R 16 0 R] /Count 2 /Resources <</XObject <</Im1 6 0 R /Im2 7 0 R>>>>>>")
    b.add(3, "<</Type /Page /Parent 2 0 R /Contents [4 0 R 5 0 R] /Thumb 9 0 R>>")
    b.stream(4, b"q 2 0 0 3 10 20 cm /Im1 Do Q q 1 0 0 1 5 5 cm q 2 0 0 2 1 1 cm")
    b.stream(5, b"/Im2 Do Q Q Q /Im1 Do" + b" " * 200)
    for num, data in ((6, b"abcdef"), (7, b"abcdef"), (8, b"abcdeg")):
        b.stream(num, data, image(data)[0])
    b.stream(9, b"zzz")
    b.add(10, "<</Type /Font /Subtype /TrueType /BaseFont /AB+Arial /FontDescriptor 11 0 R>>")
    b.add(11, "<</Type /FontDescriptor /FontFile2 12 0 R>>")
    b.stream(12, b"font program", "/Length1 12")
    b.stream(13, b"<x/>", "/Type /Metadata /Subtype /XML")
    b.add(14, "<</EmbeddedFiles 15 0 R>>")
    b.add(15, "<<>>")
    b.add(16, "<</Type /Page /Parent 2 0 R /Contents 17 0 R /MediaBox [0 0 100 200] /Resources <</Font <</F1 10 0 R>> /XObject <</Im9 6 0 R>>>>>>")
    b.stream(17, b"/Im9 Do")
    b.add(18, "<</Producer (me) /Title <feff0041>>>")
    b.add(19, "[1 2 3]")
    b.add(20, "<</Orphan true>>")
    b.stream(21, b"orphan stream")
    return b.build("/Root 1 0 R /Info 18 0 R")


@pytest.fixture(scope="module")
def parsed(spark):
    files = [("rich.pdf", rich_file()), ("one.pdf", one_page()), ("hand.pdf", HAND_WRITTEN), ("bad.pdf", b"hello"), ("empty.pdf", b""), ("null.pdf", None), ("locked.pdf", one_page(trailer="/Encrypt 1 0 R"))]
    df = spark.createDataFrame(files, "path string, content binary")
    return df, P.parse_files(df).cache()


def test_values():
    text = b"<</A#20B (a\\(b\\)\\101\\n(c)) /C <4a4B4> /D [1 -2.5 .5 true null 3 0 R /N] % comment\n /E <</F 7>> >>"
    v = Lexer(text).value()
    assert v == {"A B": b"a(b)A\n(c)", "C": b"JK@", "D": [1, -2.5, 0.5, True, None, Ref(3, 0), "N"], "E": {"F": 7}}
    assert isinstance(v["D"][-1], Name)


@pytest.mark.parametrize("packed", [None, [1, 2, 3]])
def test_cross_references(packed):
    b = Builder().add(1, "<</Type /Catalog /Pages 2 0 R>>").add(2, "<</Type /Pages /Kids [3 0 R] /Count 1>>").add(3, "<</Type /Page /Parent 2 0 R /Contents 4 0 R>>")
    b.stream(4, b"0 0 m endstream is only text", length="5 0 R").add(5, "28")
    doc = parse(b.build("/Root 1 0 R", packed))
    assert doc.version == "1.6" and doc.page_count() == 1 and doc.pages() == [Ref(3, 0)]
    assert doc.objects[Ref(4, 0)].data == b"0 0 m endstream is only text"


def test_broken_files_are_scanned():
    good = one_page()
    doc = parse(good.replace(b"startxref\n", b"startxref\n9"))
    assert len(doc.objects) == 4 and doc.pages() == [Ref(3, 0)]
    assert len(parse(good[: good.rfind(b"xref\n0")]).objects) == 4
    assert parse(HAND_WRITTEN).page_count() == 1
    with pytest.raises(PdfError):
        parse(b"nothing here")


def test_round_trip():
    doc = parse(rich_file())
    again = parse(serialise(doc))
    assert again.objects.keys() == doc.objects.keys()
    for r, v in doc.objects.items():
        w = again.objects[r]
        assert (w.data, w.dict) == (v.data, v.dict) if isinstance(v, Stream) else w == v


def test_reachability_stops_on_cycles():
    b = Builder().add(1, "<</Type /Catalog /Pages 2 0 R /Outlines 5 0 R>>").add(5, "<</First 6 0 R>>").add(6, "<</Next 7 0 R /Prev 7 0 R>>").add(7, "<</Next 6 0 R /Gone 99 0 R>>").add(8, "<</X 8 0 R>>")
    doc = parse(one_page(more=b))
    assert {r.num for r in doc.reachable()} == {1, 2, 3, 4, 5, 6, 7}


def test_size_estimates():
    assert P.size_estimate({"AB": 5, "C": [Name("XY"), b"123", True, None, Ref(1, 0)]}) == (2 + 4 + 16) + (1 + 4 + 8 + 6 + 7 + 5 + 4 + 16)
    assert P.json_size_estimate(Stream({"Length": 5000}, b"")) == 5000 and P.json_size_estimate(Stream({"Length": Ref(1, 0)}, b"x" * 999)) == 256
    assert P.json_size_estimate({}) == 64 and P.json_size_estimate(5) == 128


def test_file_rows(parsed):
    rows = {r.path: r for r in P.file_table(parsed[1]).collect()}
    assert {k: v.parse_status for k, v in rows.items()} == {"rich.pdf": "ok", "one.pdf": "ok", "hand.pdf": "ok", "bad.pdf": "failed", "empty.pdf": "failed", "null.pdf": "failed", "locked.pdf": "encrypted"}
    assert rows["rich.pdf"].page_count == 2 and rows["one.pdf"].file_size == len(one_page()) and rows["hand.pdf"].pdf_version == "1.4"
    assert rows["one.pdf"].complete_tail and not rows["bad.pdf"].complete_tail
    pages = {(r.path, r.page): r.mediabox for r in P.page_table(parsed[1]).collect()}
    assert pages["hand.pdf", 1] == [0, 0, 10, 20] and pages["one.pdf", 1] == P.DEFAULT_BOX and pages["rich.pdf", 2] == [0, 0, 100, 200]


def test_categories(parsed):
    objects = P.object_table(parsed[1])
    got = {r.category: r.n for r in D.components(objects).filter("path = 'rich.pdf'").collect()}
    assert got == {"images": 3, "fonts": 1, "content": 5, "forms": 0, "metadata": 2, "structure": 8, "other_streams": 0, "unused": 2}
    large = {r.category: r.n for r in D.components(objects, "large").filter("path = 'rich.pdf'").collect()}
    assert large["fonts"] == 1 and large["content"] == 5 and large["images"] == 3 and large["unused"] == 2


def test_fonts_and_unused(parsed):
    objects = P.object_table(parsed[1])
    (font,) = D.fonts(objects).filter("path = 'rich.pdf'").collect()
    sizes = {r.obj_num: r.size_est for r in objects.filter("path = 'rich.pdf'").collect()}
    assert (font.name, font.subtype, font.embedded, font["size"]) == ("AB+Arial", "TrueType", True, sizes[10] + sizes[11] + sizes[12])
    unused = {r.path: r.unused_objects for r in D.unused_objects(objects).collect()}
    assert unused == {"rich.pdf": 4}  # 8, 19, 20, 21


def test_duplicates_and_reuse(parsed):
    objects = P.object_table(parsed[1])
    (group,) = D.duplicate_images(objects).collect()
    assert sorted(m.id for m in group.members) == ["6 0", "7 0"] and (group.total_size, group.savings) == (12, 6)
    assert D.reused_images(parsed[1]).count() == 0  # image 6 is on two pages but in a duplicate group


def test_analysis_row(parsed):
    rows = {r.path: r for r in D.analyse(parsed[1]).collect()}
    assert len(rows) == 7 and rows["bad.pdf"].total_objects == 0
    r = rows["rich.pdf"]
    assert (r.total_objects, r.unused_objects, r.duplicate_groups, r.duplicate_savings) == (21, 4, 1, 6)
    assert len(r.components) == 8 and len(r.fonts) == 1


def test_placements(parsed):
    rows = sorted((r.page, r.op_idx, r.name, tuple(r.ctm), r.x, r.y, r.raw_ops) for r in G.placements(parsed[0]).filter("path = 'rich.pdf'").collect())
    assert [(p, n, x, y) for p, _, n, _, x, y, _ in rows] == [(1, "Im1", 10, 20), (1, "Im2", 6, 6), (1, "Im1", 0, 0), (2, "Im9", 0, 0)]
    assert rows[0][3] == (2, 0, 0, 3, 10, 20) and rows[1][3] == (2, 0, 0, 2, 6, 6)
    assert rows[0][6] == ["q", "2 0 0 3 10 20 cm"] and len(rows[2][6]) == 10
    edges = P.edge_table(parsed[1]).filter("path = 'one.pdf'").count()
    assert edges == 4 and P.root_table(parsed[1]).filter("path = 'rich.pdf'").count() == 2


def test_matrix_product():
    assert G.times((2, 0, 0, 3, 1, 1), (1, 0, 0, 1, 10, 20)) == (2, 0, 0, 3, 11, 21)
    assert G.times((0, 1, -1, 0, 0, 0), (2, 0, 0, 3, 0, 0)) == (0, 3, -2, 0, 0, 0)


def test_operators_pass_over_inline_images():
    ops = G.operations(b"q BI /W 1 /H 1 ID \x00EI\xff EI Q /A Do")
    assert [o.operator for o in ops] == [b"q", b"BI", b"ID", b"Q", b"Do"]


def test_pruning(spark):
    files = spark.createDataFrame([("rich.pdf", rich_file()), ("bad.pdf", b"zz"), ("same.pdf", HAND_WRITTEN)], "path string, content binary")
    rows = {r.path: r for r in W.prune_files(files).collect()}
    r = rows["rich.pdf"]
    doc = parse(bytes(r.content))
    assert r.status == "ok" and {k for k, v in doc.objects.items() if not is_container(v)} == doc.reachable() and doc.page_count() == 2
    catalog = doc.dict_of(doc.trailer["Root"])
    assert not {"Metadata", "Names", "PageLabels"} & catalog.keys() and all("Thumb" not in doc.dict_of(p) for p in doc.pages())
    assert doc.objects[Ref(5, 0)].dict["Filter"] == "FlateDecode" and doc.decoded(doc.objects[Ref(5, 0)]).data.rstrip() == b"/Im2 Do Q Q Q /Im1 Do"
    assert rows["bad.pdf"].status.startswith("failed") and bytes(rows["bad.pdf"].content) == b"zz"
    assert bytes(rows["same.pdf"].content) == HAND_WRITTEN and rows["same.pdf"].savings == 0
    twice = W.prune_files(spark.createDataFrame([("rich.pdf", bytes(r.content))], "path string, content binary")).first()
    assert twice.changed == 0
    kept = parse(rich_file())
    W.prune(kept, W.PruneOptions(*[False] * 12))
    assert len(kept.objects) == 21


def test_option_table(spark):
    rows = W.option_table(spark).collect()
    assert len(rows) == 12 and sum(r.safe for r in rows) == 9 and {r.key for r in rows if not r.default} == {"annotations", "structure_tree", "mark_info"}


def test_embedded_files_go_only_where_names_stay():
    doc = parse(rich_file())
    W.prune(doc, W.PruneOptions(javascript=False, garbage=False))
    assert "EmbeddedFiles" not in doc.objects[Ref(14, 0)]


def test_image_removal(spark):
    files = spark.createDataFrame([("rich.pdf", rich_file())], "path string, content binary")
    r = W.remove_images_from_files(files, [(2, 1), (0, 9)], 5, 30).first()
    doc = parse(bytes(r.content))
    assert r.changed == 2  # at heights 20 and 6; the two at 0 stay
    left = [(op.operands[-1], m[5]) for p in doc.pages() for _, op, _, _, m, _ in G.replay(doc, p)]
    assert left == [("Im1", 0), ("Im9", 0)]
    assert Ref(6, 0) in doc.objects  # still drawn
    assert doc.objects[Ref(5, 0)].data == b""


def test_image_replacement(spark):
    big = bytes(range(256)) * 20
    b = Builder().stream(6, big, image(big, "/SMask 7 0 R /Decode [0 1]", 40, 40)[0]).stream(7, b"m", image(b"m")[0])
    files = spark.createDataFrame([("x.pdf", one_page(resources="/XObject <</A 6 0 R>>", more=b))], "path string, content binary")
    new = [("x.pdf", 6, 0, "gray", b"\x10" * 400, 20, 20, False), ("x.pdf", 7, 0, "jpeg", b"longer than before", 1, 1, False), ("x.pdf", 99, 0, "rgb", b"", 1, 1, True)]
    schema = "path string, obj_num long, gen int, kind string, data binary, width int, height int, force boolean"
    r = W.replace_images_in_files(files, spark.createDataFrame(new, schema)).first()
    doc = parse(bytes(r.content))
    d = doc.objects[Ref(6, 0)].dict
    assert (d["Width"], d["ColorSpace"], d["SMask"]) == (20, "DeviceGray", Ref(7, 0)) and "Decode" not in d
    assert zlib.decompress(doc.objects[Ref(6, 0)].data) == b"\x10" * 400 and doc.objects[Ref(7, 0)].data == b"m"
    assert r.changed == 1 and len(r.actions) == 3
    forced = [("x.pdf", 7, 0, "jpeg", b"longer than before", 1, 1, True)]
    r = W.replace_images_in_files(files, spark.createDataFrame(forced, schema)).first()
    assert parse(bytes(r.content)).objects[Ref(7, 0)].data == b"longer than before" and r.changed == 1


def test_extraction(spark):
    b = Builder()
    b.stream(6, zlib.compress(b"\xff\0\0\0\xff\0"), image(b"", "/Filter /FlateDecode")[0]).stream(7, b"\xff\xd8jpeg", image(b"", "/Filter [/DCTDecode]")[0])
    b.stream(8, b"x", image(b"", "/Filter /JPXDecode")[0]).stream(9, b"x", image(b"", "/Filter /LZWDecode")[0]).stream(10, b"x", image(b"")[0])
    data = one_page(resources="/XObject <</A 6 0 R /B 7 0 R /C 8 0 R /D 9 0 R /E 10 0 R /A2 6 0 R>>", more=b)
    rows = {r.obj_num: r for r in E.extract_images(spark.createDataFrame([("x.pdf", data), ("b.pdf", b"")], "path string, content binary")).collect()}
    assert {k: (r.format, r.supported) for k, r in rows.items()} == {6: ("png", True), 7: ("jpeg", True), 8: ("jpeg2000", False), 9: ("lzw", False), 10: ("raw", False)}
    assert bytes(rows[6].content)[:8] == b"\x89PNG\r\n\x1a\n" and bytes(rows[7].content) == b"\xff\xd8jpeg"


def test_folder_source_writer_and_stream(spark, tmp_path):
    from leafmill.streaming import drop_folder

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(rich_file())
    (folder / "b.PDF").write_bytes(one_page())
    (folder / "c.txt").write_bytes(b"no")
    files = P.read_files(spark, f"file://{folder}")
    assert files.count() == 2
    out = W.write_files(W.prune_files(files), str(tmp_path / "out")).collect()
    assert len(out) == 2 and all(parse(open(r.target, "rb").read()).pages() for r in out)
    same = spark.createDataFrame([("file:/in/a/x.pdf", b"one"), ("file:///in/b/x.pdf", b"two"), ("/other/../x.pdf", b"three")], "path string, content binary")
    targets = {r.path: r.target for r in W.write_files(same, str(tmp_path / "same"), "file:///in").collect()}
    assert [open(targets[p], "rb").read() for p in ("file:/in/a/x.pdf", "file:///in/b/x.pdf", "/other/../x.pdf")] == [b"one", b"two", b"three"]
    assert sorted(p.name for p in (tmp_path / "same").rglob("*") if p.is_file()) == ["x.pdf"] * 3
    for expected in (25, 29):
        query = drop_folder.write_objects(spark, f"file://{folder}", f"file://{tmp_path}/objects", f"file://{tmp_path}/mark")
        query.awaitTermination(120)
        assert spark.read.parquet(f"file://{tmp_path}/objects").filter("record = 'object'").count() == expected
        (folder / "d.pdf").write_bytes(one_page(b"later"))


def test_corpus_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(50).collect()
    files = spark.createDataFrame([(str(r.doc_id), one_page(r.text.encode())) for r in docs], "path string, content binary").repartition(4)
    parsed = P.parse_files(files)
    rows = {r.path: r for r in parsed.filter("kind = 'stream'").collect()}
    assert all(hashlib.md5(bytes(rows[str(r.doc_id)].content)).digest() == hashlib.md5(r.text.encode()).digest() for r in docs)


def test_pages_of_a_document_without_a_tree():
    assert Document().pages() == [] and Document().page_count() == 0


def test_both_ways_to_write_a_document():
    doc = parse(rich_file())
    plain, packed = serialise(doc), serialise_packed(doc)
    for data in (plain, packed):
        again = parse(data)
        assert {k: v for k, v in again.objects.items() if not is_container(v) and not isinstance(v, Stream)} == {k: v for k, v in doc.objects.items() if not is_container(v) and not isinstance(v, Stream)}
        assert all(again.objects[k].data == v.data for k, v in doc.objects.items() if isinstance(v, Stream) and not is_container(v))
        assert again.pages() == doc.pages() and again.trailer["Root"] == doc.trailer["Root"]
    assert smallest(doc) == min(plain, packed, key=len) and len(packed) < len(plain)


def test_replacing_the_whole_dictionary():
    for merge in (True, False):
        doc = parse(one_page())
        doc.objects[Ref(90, 0)] = Stream({"Subtype": "Image", "SMask": Ref(91, 0)}, b"z" * 500)
        W.replace_images(doc, [W.Replacement(Ref(90, 0), "gray", b"a" * 4, 2, 2)], merge)
        assert ("SMask" in doc.objects[Ref(90, 0)].dict) == merge and doc.objects[Ref(90, 0)].dict["Width"] == 2
