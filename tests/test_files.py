"""The file reader on files made here: places of characters, compressed objects, passwords, fonts; engines as plug-ins."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quire.plans import pipeline
from quire.sources import decode, engines, pdf, sinks


def made(objects, trailer=b"/Root 1 0 R"):
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return b"%PDF-1.5\n" + body + b"trailer\n<< " + trailer + b" >>\n%%EOF"


def stream(raw, more=b""):
    return b"<< /Length %d %s >>\nstream\n" % (len(raw), more) + raw + b"\nendstream"


def book(content, fonts=b"/F1 << /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 32 /Widths [" + b"600 " * 95 + b"] >>", more=None):
    z = zlib.compress(content)
    return {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 400 500] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << " + fonts + b" >> /XObject << /Im 6 0 R /Fm 7 0 R >> >> >>",
        4: stream(z, b"/Filter /FlateDecode"), 6: stream(b"x", b"/Subtype /Image /Filter /DCTDecode"), 7: stream(b"BT /F1 10 Tf 0 0 Td (form) Tj ET", b"/Subtype /Form /Matrix [1 0 0 1 200 100]"),
    } | (more or {})


TEXT = b"BT /F1 10 Tf 50 450 Td (First line) Tj 0 -12 Td [(sec) -1500 (ond)] TJ ET q 100 0 0 80 20 300 cm /Im Do Q BT 1 0 0 1 50 100 Tm /F1 20 Tf (Big \\(1\\)) Tj ET /Fm Do"

PROSE = b"BT /F1 8 Tf 14 TL 20 450 Td (First line) ' " + b" ".join(b"(Line %d has words enough to make of it a page of dense text) '" % k for k in range(20)) + b" ET"


def chars(page, block):
    return [(c["c"], c["bbox"]) for line in page.blocks[block]["lines"] for s in line["spans"] for c in s["chars"]]


def test_places_of_characters_and_images():
    title, (page,) = pdf.read(made(book(TEXT), b"/Root 1 0 R /Info << /Title <FEFF00DC0062> >>"))
    assert title == "Üb" and (page.width, page.height) == (400, 500) and page.images == [(20, 120, 120, 200)]
    assert page.text == "First line\nsec ond\nBig (1)\nform"
    got = chars(page, 0)
    assert got[0][0] == "F" and got[0][1] == pytest.approx({"x0": 50, "y0": 42, "x1": 56, "y1": 52}) and got[1][1]["x0"] == pytest.approx(56)
    assert [b["bbox"]["x0"] for b in page.blocks] == pytest.approx([50, 50, 200]) and len(page.blocks[0]["lines"]) == 2
    second = [b for c, b in got if c in "osecnd"][-3:]
    assert second[0]["x0"] == pytest.approx(50 + 18 + 15)  # moved by 1500 thousandths of 10 points
    assert page.blocks[1]["bbox"]["y1"] - page.blocks[1]["bbox"]["y0"] == pytest.approx(20)


def test_compressed_objects_and_predictors():
    own = book(TEXT)
    packed = {n: own.pop(n) for n in (1, 2, 3)}
    inner = b"".join(v + b" " for v in packed.values())
    at, index = 0, b""
    for n, v in packed.items():
        index += b"%d %d " % (n, at)
        at += len(v) + 1
    z = zlib.compress(index + inner)
    own[9] = stream(z, b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(index))
    own[10] = stream(b"", b"/Type /XRef /Root 1 0 R /Size 11")
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in own.items()) + b"startxref\n0\n%%EOF"
    assert pdf.read(data)[1][0].text.startswith("First line")
    rows = b"\x02\x01\x02" + b"\x02\x01\x01" + b"\x01\x05\x01" + b"\x04\x01\x01" + b"\x03\x02\x02"
    assert pdf._unpredicted(rows, {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3, 5, 6, 6, 7, 5, 8])


def locked(user, owner, version, level, size):
    """The file of TEXT encrypted with RC4, as the format's public description says."""
    pad = lambda p: (p + pdf._PAD)[:32]
    k = hashlib.md5(pad(owner)).digest()
    for _ in range(50 if level >= 3 else 0):
        k = hashlib.md5(k).digest()
    o = pad(user)
    for i in range(20 if level >= 3 else 1):
        o = pdf.rc4(bytes(b ^ i for b in k[:size]), o)
    key = hashlib.md5(pad(user) + o + (0xFFFFFFFC).to_bytes(4, "little") + b"id").digest()
    for _ in range(50 if level >= 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    u = pdf.rc4(key, pdf._PAD)
    if level >= 3:
        u = hashlib.md5(pdf._PAD + b"id").digest()
        for i in range(20):
            u = pdf.rc4(bytes(b ^ i for b in key), u)
        u += bytes(16)
    own = book(TEXT)
    z = zlib.compress(TEXT)
    own[4] = stream(pdf.rc4(hashlib.md5(key + (4).to_bytes(3, "little") + b"\0\0").digest()[: min(16, size + 5)], z), b"/Filter /FlateDecode")
    own[8] = b"<< /Filter /Standard /V %d /R %d /Length %d /P -4 /O <%s> /U <%s> >>" % (version, level, size * 8, o.hex().encode(), u.hex().encode())
    return made(own, b"/Root 1 0 R /Encrypt 8 0 R /ID [<6964> <6964>]")


@pytest.mark.parametrize("version, level, size", [(1, 2, 5), (2, 3, 16)])
def test_passwords(version, level, size):
    data = locked(b"reader", b"writer", version, level, size)
    for password in ("reader", "writer"):
        assert pdf.read(data, password)[1][0].text.startswith("First line")
    for password in (None, "wrong"):
        with pytest.raises(ValueError, match="encrypted"):
            pdf.read(data, password)
    assert pdf.read(locked(b"", b"writer", version, level, size))[1][0].text.startswith("First line")


def test_aes_of_the_published_example():
    told = bytes.fromhex("000102030405060708090a0b0c0d0e0f7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2")
    assert pdf.aes_cbc(bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), told).hex() == "6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51"


def test_fonts():
    told = b"1 beginbfchar <0003> <0041> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660066> <03A9>] endbfrange"
    fonts = b"/F1 << /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [<< /DW 500 /W [3 [700] 16 18 250] >>] /ToUnicode 8 0 R >> /F2 << /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /germandbls /fi /uni20AC] >> >>"
    content = b"BT /F1 10 Tf 10 100 Td <00030010001100200021> Tj 0 -40 Td /F2 10 Tf (ABC\\344) Tj ET"
    page = pdf.read(made(book(content, fonts, {8: stream(told)})))[1][0]
    assert page.text == "AabffΩ\nßfi€ä"
    assert [round(b["x0"], 2) for _, b in chars(page, 0)] == [10, 17, 19.5, 22, 24.5, 27]  # ff is one glyph of two characters


def test_broken_pages_and_files(spark, tmp_path):
    own = book(PROSE)
    own[2] = b"<< /Type /Pages /Kids [3 0 R 11 0 R] /Count 2 /MediaBox [0 0 400 500] >>"
    own[11] = b"<< /Type /Page /Contents 12 0 R >>"
    own[12] = stream(b"junk", b"/Filter /LZWDecode")
    (tmp_path / "half.pdf").write_bytes(made(own))
    (tmp_path / "locked.pdf").write_bytes(locked(b"pw", b"pw", 2, 3, 16))
    (tmp_path / "junk.pdf").write_bytes(b"junk")
    got = pipeline.extract(spark, str(tmp_path), output_format="plain")
    assert got.pages.count() == 2 and "First line" in got.texts.first()["text"]
    assert [r["page_num"] for r in got.warnings.where("msg LIKE 'stage0: page can%'").collect()] == [1]
    said = sorted(r["message"] for r in got.failures.collect())
    assert len(said) == 2 and said[0].startswith("cannot open file") and said[1].startswith("encrypted file")
    assert pipeline.extract(spark, str(tmp_path), password="pw", output_format="ir").failures.count() == 1
    with pytest.raises(FileNotFoundError):
        pipeline.extract(spark, str(tmp_path / "nothing.pdf"))
    row = pipeline.info(spark, str(tmp_path)).first()
    assert row["page_count"] == 2 and len(row["warnings"]) == 1


def test_engines_as_plugins(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(book(PROSE)))
    (tmp_path / "scan.pdf").write_bytes(made(book(b"q 400 0 0 500 0 0 cm /Im Do Q")))
    words = [{"i": k, "text": w, "conf": 90.0, "left": 50 + 60 * k, "top": 40, "width": 50, "height": 12, "block_num": 1, "par_num": 1} for k, w in enumerate(("Read", "by", "eye"))]

    def only_scans(give):
        return lambda content, page, width, height: give if b"400 0 0 500" in zlib.decompress(content.split(b"stream\n")[1].split(b"\nendstream")[0]) else []

    def failing(content, page, width, height):
        raise RuntimeError("no raster")

    plugins = {
        "words": engines.Engine("eye", lambda: only_scans(words)), "regions": engines.Engine("boxes", lambda: lambda c, p, w, h: [{"i": 0, "x0": 0, "y0": 0, "x1": 600, "y1": 150, "label": None, "confidence": None}]),
        "ruled": engines.Engine("lines", lambda: lambda c, p, w, h: [{"tables": [[["a", None], ["b", "c"]], [["lost"]]], "boxes": [None]}]), "scripts": engines.Engine("osd", lambda: lambda c, p, w, h: [{"osd": "Latin"}]),
        "others": engines.Engine("failing", lambda: failing), "samples": engines.Engine("crop", lambda: lambda c, p, w, h: [{"ocr": "First line", "layer": "first LINE of"}]),
    }
    found = decode.files(spark, str(tmp_path))
    decoded = decode.decode(found)
    layers = pipeline.layers(spark, found, decoded, plugins)
    box = layers["regions"].first()
    assert (box["label"], box["confidence"], box["bbox"]["x1"], box["bbox"]["y1"]) == ("Text", 1.0, 288.0, 72.0)
    table = layers["ruled"].collect()
    assert len(table) == 2 and tuple(table[0]["bbox"]) == (0, 0, 400, 500) and table[0]["rows"] == [["a", None], ["b", "c"]]
    assert {r["script"] for r in layers["pages"].collect()} == {"latin"} and layers["others"].count() == 0
    assert [round(r["s4"], 3) for r in layers["samples"].collect()] == [0.667, 0.667]
    got = pipeline.extract(spark, str(tmp_path), output_format="plain", plugins={k: plugins[k] for k in ("words", "scripts")})
    texts = {r["doc_id"].rsplit("/", 1)[1]: r["text"] for r in got.texts.collect()}
    assert "Read by eye" in texts["scan.pdf"] and "First line" in texts["a.pdf"] and "Read" not in texts["a.pdf"]
    assert engines.made(engines.Engine("huge", lambda: failing, least_gib=1e9)) is None


def test_file_names(spark):
    rows = spark.createDataFrame([("x/a.pdf", "1"), ("y/a.pdf", "2"), ("z/b.c.pdf", "3"), ("plain", "4")], "doc_id string, text string")
    got = {r["doc_id"]: r["name"] for r in sinks.names(rows, "txt").collect()}
    assert got["z/b.c.pdf"] == "b.c.txt" and got["plain"] == "plain.txt" and got["x/a.pdf"] != got["y/a.pdf"] and got["x/a.pdf"].startswith("a-")
