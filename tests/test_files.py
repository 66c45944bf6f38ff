"""PDFs as producers write them, pictures of all kinds, files that are broken: what is read, and what is told."""

import zlib

import numpy as np
import pytest

from inkveil.errors import UnsupportedInput
from inkveil.functions import raster
from inkveil.options import RedactOptions
from inkveil.plans.pipeline import file_pages, folder_pages, redact
from inkveil.sources import files
from inkveil.sources.pdf import Pdf


def pdf(objects, trailer=b"<</Root 1 0 R>>", packed=()):
    """A file of numbered objects, given as bytes or (dictionary, stream); those in packed go into an object stream."""
    out = b"%PDF-1.5\n"
    plain = {n: o for n, o in objects.items() if n not in packed}
    if packed:
        body, head = b"", []
        for n in packed:
            head.append(b"%d %d" % (n, len(body)))
            body += objects[n] + b" "
        first = b" ".join(head) + b" "
        plain[900] = (b"/Type/ObjStm/N %d/First %d/Filter/FlateDecode" % (len(packed), len(first)), zlib.compress(first + body))
    for n, o in plain.items():
        if isinstance(o, tuple):
            o = b"<<%s/Length %d>>stream\n%s\nendstream" % (o[0], len(o[1]), o[1])
        out += b"%d 0 obj %s endobj\n" % (n, o)
    return out + b"trailer " + trailer


def paged(content, page=b"", resources=b"", extra=None, **more):
    return pdf({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
                3: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 600 800]/Contents 4 0 R/Resources<<%s>>%s>>" % (resources, page), 4: (b"", content)} | (extra or {}), **more)


def runs(data, page=0):
    own = Pdf(data)
    return [(r.text, round(r.left, 3), round(r.baseline, 3), round(r.height, 3), round(r.width, 3)) for r in own.runs(own.pages[page])]


TEXT = b"BT /F1 10 Tf 100 700 Td (Jane) Tj ET"


def test_places_follow_matrices_boxes_and_turns():
    assert runs(paged(TEXT)) == [("Jane", 100, 100, 10, 0)]
    assert runs(paged(b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 50 300 Td (Jane) Tj ET Q " + TEXT)) == [("Jane", 110, 180, 20, 0), ("Jane", 100, 100, 10, 0)]
    shifted = paged(TEXT).replace(b"[0 0 600 800]", b"[50 100 650 900]")
    assert runs(shifted) == [("Jane", 50, 200, 10, 0)]
    assert runs(paged(TEXT, b"/Rotate 90")) == [("Jane", 700, 100, 10, 0)] and runs(paged(TEXT, b"/Rotate 180")) == [("Jane", 500, 700, 10, 0)]
    assert runs(paged(TEXT, b"/Rotate -90")) == [("Jane", 100, 500, 10, 0)]
    own = Pdf(paged(TEXT, b"/Rotate 90"))
    assert own.frame(own.pages[0])[:2] == (800, 600)
    assert runs(paged(b"BT /F1 10 Tf 12 TL 1 0 0 1 60 700 Tm (a) Tj T* (b) Tj 5 2 (c) \" ET")) == [("a", 60, 100, 10, 0), ("b", 60, 112, 10, 0), ("c", 60, 124, 10, 0)]


def test_pages_come_by_the_tree():
    page = lambda n, text: {n: b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (n + 1), n + 1: (b"/Filter/FlateDecode", zlib.compress(b"BT /F 9 Tf 10 10 Td (%s) Tj ET" % text))}
    tree = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/MediaBox[0 0 100 100]/Kids[20 0 R 50 0 R]>>", 50: b"<</Type/Pages/Parent 2 0 R/Kids[30 0 R 10 0 R]>>"}
    for packed in ((), (1, 2, 50, 10, 20, 30)):
        data = pdf(tree | page(10, b"third") | page(20, b"first") | page(30, b"second"), packed=packed)
        assert [runs(data, k)[0][:3] for k in range(3)] == [("first", 10, 90), ("second", 10, 90), ("third", 10, 90)]


def test_fonts_give_widths_and_letters():
    simple = {5: b"<</Type/Font/Subtype/TrueType/BaseFont/ABC+Arial/FirstChar 65/Widths[500 250 1000]>>"}
    assert runs(paged(b"BT /F1 20 Tf 10 700 Td (AB) Tj (C) Tj ET", resources=b"/Font<</F1 5 0 R>>", extra=simple)) == [("AB", 10, 100, 20, 15), ("C", 25, 100, 20, 20)]
    assert runs(paged(b"BT /F1 20 Tf 1 Tc 10 700 Td [(A) -500 (B) 100 (C)] TJ ET", resources=b"/Font<</F1 5 0 R>>", extra=simple)) == [("A BC", 10, 100, 20, 46)]
    to = b"1 beginbfchar <0001> <004A> endbfchar 2 beginbfrange <0002> <0003> <0061> <0004> <0005> [<00E9> <D83DDE00>] endbfrange"
    wide = {5: b"<</Type/Font/Subtype/Type0/BaseFont/X/DescendantFonts[6 0 R]/ToUnicode 7 0 R>>", 6: b"<</DW 600/W[1[300] 2 3 400]>>", 7: (b"", to)}
    assert runs(paged(b"BT /F1 10 Tf 10 700 Td <00010002000300040005> Tj ET", resources=b"/Font<</F1 5 0 R>>", extra=wide)) == [("Jabé😀", 10, 100, 10, 23)]
    form = {5: (b"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 5 5]/Resources<<>>", TEXT)}
    assert runs(paged(b"q 1 0 0 1 1 1 cm /X Do Q", resources=b"/XObject<</X 5 0 R>>", extra=form)) == [("Jane", 106, 94, 10, 0)]
    assert runs(paged(rb"BT /F1 10 Tf 10 700 Td (a\(b\)\101\\ (n) \251) Tj ET")) == [("a(b)A\\ (n) ©", 10, 100, 10, 0)]


def test_files_that_would_be_read_wrongly_are_refused():
    with pytest.raises(UnsupportedInput, match="encrypted"):
        Pdf(paged(TEXT, trailer=b"<</Root 1 0 R/Encrypt 9 0 R>>"))
    with pytest.raises(UnsupportedInput, match="no pages"):
        Pdf(b"%PDF-1.4 nothing")
    broken = pdf({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]>>", 3: b"<</Type/Page/Contents 4 0 R>>", 4: (b"/Filter/FlateDecode", b"no deflate")})
    with pytest.raises(UnsupportedInput, match="damaged"):
        Pdf(broken)
    loop = pdf({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[2 0 R 3 0 R]>>", 3: b"<</Type/Page>>"})
    assert len(Pdf(loop).pages) == 1 and runs(loop) == []


def test_one_broken_file_costs_itself_only(spark, tmp_path):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 8, 1)
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "good.jpg")))
    note = {5: b"<</Type/Annot/Subtype/Link/Rect[100 490 180 512]/A<</S/URI/URI(https://github.com/jane)>>>>"}
    mail = b"BT /F1 10 Tf 100 700 Td (Mail jane@example.com now) Tj ET"
    (tmp_path / "good.pdf").write_bytes(paged(mail, b"/Annots[5 0 R]", extra=note).replace(b"[0 0 600 800]", b"[50 100 650 900]"))
    (tmp_path / "good.png").write_bytes(raster.encode_png(np.full((20, 30, 3), 200, np.uint8)))
    (tmp_path / "bad.jpg").write_bytes(b"\xff\xd8\xff\xe0 no picture")
    (tmp_path / "bad.png").write_bytes(raster.encode_png(np.zeros((4, 4, 3), np.uint8))[:40])
    (tmp_path / "bad.webp").write_bytes(b"RIFF0000WEBPVP8 nothing here")
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 " + b"[" * 5000)
    (tmp_path / "note.txt").write_bytes(b"plain words")
    options = RedactOptions(("email", "social"), mode="patterns-only", link_text="redact-identifying", style="box", ocr=False, padding=0)
    drawn = lambda content, dpi: [np.full((1667, 1250, 3), 255, np.uint8)]
    source = folder_pages(spark, str(tmp_path), options, drawn)
    r = redact(source, options)
    audit = {x["doc_id"].split("/")[-1]: (x["pages"], x["warnings"]) for x in r.audit.collect()}
    assert {k: v[0] for k, v in audit.items()} == {"good.jpg": 1, "good.pdf": 1, "good.png": 1, "bad.jpg": 0, "bad.png": 0, "bad.webp": 0, "bad.pdf": 0, "note.txt": 0}
    assert all(v[1][0].startswith("UNSUPPORTED_INPUT") for k, v in audit.items() if not k.startswith("good"))
    got = {x["target"]: x["box"] for x in r.regions.collect()}
    scale = 150 / 72
    assert got["social"].asDict() == pytest.approx({"x": 50 * scale, "y": 388 * scale, "width": 80 * scale, "height": 22 * scale})
    assert got["email"]["x"] > 50 * scale and got["email"]["y"] == pytest.approx((200 - 0.88 * 10) * scale)
    assert r.pdfs.count() == 3
    alone = file_pages(files.read_files(spark, str(tmp_path)), options)
    assert {x["doc_id"].split("/")[-1] for x in alone.pages.collect()} == {"good.pdf", "good.png"}
    assert {x["doc_id"].split("/")[-1] for x in alone.warnings.collect()} >= {"good.jpg", "good.pdf"}
