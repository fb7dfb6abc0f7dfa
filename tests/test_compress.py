import numpy as np
from pdf_builder import Builder, one_page

from leafmill.functions import codecs as C
from leafmill.operators import compress as Z
from leafmill.operators import extract as E
from leafmill.operators import rewrite as W
from leafmill.sources.pdf_file import Ref, parse


def test_png_round_trip():
    r = np.random.default_rng(3)
    for channels in (1, 3, 4):
        px = r.integers(0, 256, (5, 7, channels)).astype(np.uint8)
        got = C.read_png(C.png(px[..., 0] if channels == 1 else px))
        assert (got[..., :channels] == px).all() if channels > 1 else (got[..., 1] == px[..., 0]).all()
    bits = r.integers(0, 2, (4, 9))
    assert (C.read_png(C.png(bits, bits=1))[..., 0] == bits * 255).all()


def test_previews_and_replacement(spark):
    noise = np.random.default_rng(4).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    flat = np.full((64, 64, 3), 200, np.uint8)
    b = Builder()
    for num, px in ((6, noise), (7, flat)):
        b.stream(num, px.tobytes(), "/Type /XObject /Subtype /Image /Width 64 /Height 64 /BitsPerComponent 8 /ColorSpace /DeviceRGB")
    b.stream(8, b"j", "/Type /XObject /Subtype /Image /Width 1 /Height 1 /Filter /JPXDecode")
    data = one_page(resources="/XObject <</A 6 0 R /B 7 0 R /C 8 0 R>>", more=b)
    files = spark.createDataFrame([("x.pdf", data)], "path string, content binary")
    images = E.extract_images(files).cache()
    new = Z.compress(images, Z.CompressOptions(max_width=16, colours="binary")).cache()
    rows = {r.obj_num: r for r in new.collect()}
    assert rows[6].kind == "bits" and (rows[6].width, rows[6].height) == (16, 16) and rows[6].compressed_size < rows[6].original_size
    assert not rows[8].supported and rows[8].error
    none = new.limit(0)
    previews = Z.upsert(none, new)
    assert previews.count() == 2 and Z.without_preview(images, previews).count() == 1
    again = Z.upsert(previews, Z.compress(images.filter("obj_num = 6"), Z.CompressOptions(colours="grayscale")))
    assert {r.obj_num: r.kind for r in again.collect()} == {6: "gray", 7: "bits"}
    assert Z.undo(previews, images.filter("obj_num = 6")).count() == 1 and Z.undo(previews).count() == 0
    assert {r.obj_num: r.has_preview for r in Z.selected(images, images, again.filter("obj_num = 7")).collect()} == {6: False, 7: True}
    assert Z.compress(images, Z.CompressOptions(format="webp")).filter("supported").count() == 0
    out = W.replace_images_in_files(files, previews.select("path", "obj_num", "gen", "kind", "data", "width", "height", "force")).first()
    doc = parse(bytes(out.content))
    assert out.changed == 2 and doc.objects[Ref(6, 0)].dict["Width"] == 16 and doc.objects[Ref(6, 0)].dict["BitsPerComponent"] == 1
    assert out.savings > 0


def test_pictures_user_files_and_bytes_by_path(spark):
    wide = C.png(np.zeros((2, 900, 4), np.uint8))
    rows = spark.createDataFrame([("a", 1, 0, wide), ("a", 2, 0, b"no png")], "path string, obj_num long, gen int, content binary")
    r = Z.preview_pngs(rows).collect()
    assert [(x.obj_num, x.width, x.height) for x in r] == [(1, 400, 1)] and C.read_png(bytes(r[0].preview)).shape[:2] == (1, 400)
    files = spark.createDataFrame([("x/1.PNG",), ("x/2.webp",), ("x/3.bmp",), ("x/none",)], "path string")
    assert [(x.format, x.force) for x in Z.user_replacements(files).orderBy("path").collect()] == [("png", True), ("webp", True), ("jpeg", True), ("jpeg", True)]
    stored = spark.createDataFrame([("x/1.PNG", b"one")], "path string, content binary")
    assert [(x.image_path, bytes(x.data)) for x in Z.with_bytes(files.withColumnRenamed("path", "image_path"), stored).collect()] == [("x/1.PNG", b"one")]
