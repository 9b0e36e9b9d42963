import zlib

import numpy as np
import pytest

from gleaner.sources import files, pdf


def build(objects, packed=False):
    """A PDF file of ``number: (dictionary, stream)``."""
    out = b"%PDF-1.5\n"
    if packed:  # dictionaries without a stream in one compressed object
        plain = {n: d for n, (d, s) in objects.items() if s is None}
        head, body = b"", b""
        for n, d in plain.items():
            head += b"%d %d " % (n, len(body))
            body += d + b" "
        objects = {n: o for n, o in objects.items() if n not in plain} | {99: (b"<</Type/ObjStm/N %d/First %d/Filter/FlateDecode>>" % (len(plain), len(head)), zlib.compress(head + body))}
    for n, (d, s) in objects.items():
        if s is not None:
            d = d[:-2] + b"/Length %d>>" % len(s)
        out += b"%d 0 obj\n" % n + d + (b"\nstream\n" + s + b"\nendstream" if s is not None else b"") + b"\nendobj\n"
    return out + b"trailer<</Root 1 0 R>>\n%%EOF"


def sample():
    first = b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) world) Tj 0 -14 Td (second line) Tj 0 -40 Td [(Ne) -20 (xt) -300 (part)] TJ ET"
    second = zlib.compress(b"BT /F2 10 Tf 1 0 0 1 5 5 Tm <00010002> Tj T* /F9 9 Tf (\\101b) ' ET")
    cmap = b"1 beginbfchar <0001> <03A9> endbfchar 1 beginbfrange <0002> <0004> <0062> endbfrange"
    rgb = np.random.default_rng(1).integers(0, 256, (60, 50, 3), dtype=np.uint8)
    cmyk = np.zeros((50, 50, 4), np.uint8)
    cmyk[:, :, 0] = 255
    grey = np.arange(64 * 64, dtype=np.uint8).reshape(64, 64)
    up = np.concatenate([np.full((64, 1), 2, np.uint8), np.diff(grey.astype(int), axis=0, prepend=0).astype(np.uint8)], 1)
    image = lambda w, h, rest: b"<</Type/XObject/Subtype/Image/Width %d/Height %d/BitsPerComponent 8%s>>" % (w, h, rest)
    objects = {
        1: (b"<</Type/Catalog/Pages 2 0 R>>", None), 2: (b"<</Type/Pages/Kids[4 0 R 3 0 R]/Count 2/Resources 10 0 R>>", None),
        4: (b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>", None), 3: (b"<</Type/Page/Parent 2 0 R/Contents[6 0 R]/Resources<</Font<</F2 8 0 R>>/XObject<</A 11 0 R/B 12 0 R/C 13 0 R/D 14 0 R/E 15 0 R/F 16 0 R>>>>>>", None),
        5: (b"<<>>", first), 6: (b"<</Filter/FlateDecode>>", second), 8: (b"<</Type/Font/ToUnicode 9 0 R>>", None), 9: (b"<<>>", cmap), 10: (b"<</Font<</F1 7 0 R>>>>", None), 7: (b"<</Type/Font>>", None),
        11: (image(50, 60, b"/ColorSpace/DeviceRGB/Filter/FlateDecode"), zlib.compress(rgb.tobytes())), 12: (image(50, 50, b"/ColorSpace/DeviceCMYK/Filter/FlateDecode"), zlib.compress(cmyk.tobytes())),
        13: (image(200, 100, b"/ColorSpace/DeviceRGB/Filter/DCTDecode"), b"\xff\xd8jpeg"), 14: (image(20, 90, b"/ColorSpace/DeviceRGB/Filter/DCTDecode"), b"\xff\xd8small"),
        15: (image(64, 64, b"/ColorSpace/DeviceGray/Filter/FlateDecode/DecodeParms<</Predictor 15/Colors 1/Columns 64>>"), zlib.compress(up.tobytes())), 16: (image(80, 80, b"/Filter/JPXDecode"), b"jp2"),
    }
    return objects, rgb, grey


def pixels(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    width, height, colour = int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), data[25]
    n = int.from_bytes(data[33:37], "big")
    rows = np.frombuffer(zlib.decompress(data[41 : 41 + n]), np.uint8).reshape(height, -1)[:, 1:]
    return rows.reshape(height, width, 3) if colour == 2 else rows


@pytest.mark.parametrize("packed", [False, True])
def test_text_and_images(packed):
    objects, rgb, grey = sample()
    data = build(objects, packed)
    assert pdf.page_texts(data) == ["Hello (big) world\nsecond line\n\nNext part", "Ωb\nAb"]
    found = pdf.images(data)
    assert [(m, p) for _, m, p in found] == [("image/png", 2), ("image/png", 2), ("image/jpeg", 2), ("image/png", 2), ("image/jp2", 2)]
    assert (pixels(found[0][0]) == rgb).all() and (pixels(found[1][0]) == [0, 255, 255]).all() and (pixels(found[3][0]) == grey).all()
    assert found[2][0] == b"\xff\xd8jpeg" and found[4][0] == b"jp2"


def test_predictors():
    rows = np.array([[1, 10, 12, 5], [3, 4, 2, 9], [4, 200, 100, 50]], np.uint8)
    got = np.frombuffer(pdf.unpredicted(rows.tobytes(), 1, 3), np.uint8).reshape(3, 3).astype(int)
    assert got[0].tolist() == [10, 22, 27] and got[1].tolist() == [9, 17, 31] and got[2].tolist() == [209, 53, 103]


def test_no_pdf_and_damage():
    for data in (b"", b"hello", build(sample()[0]).replace(b"trailer<<", b"trailer<</Encrypt 5 0 R")):
        with pytest.raises(ValueError):
            pdf.page_texts(data)
    whole = build(sample()[0])
    for cut in range(20, len(whole), 997):
        try:
            pdf.page_texts(whole[:cut])
        except (ValueError, zlib.error):
            pass


def test_extraction(spark):
    rows = [("/a.pdf", bytearray(build(sample()[0]))), ("/b.pdf", bytearray(b"nothing")), ("/c.pdf", None)]
    got = {r.path: r for r in files.extract_pdf(spark.createDataFrame(rows, "path string, content binary")).collect()}
    a = got["/a.pdf"]
    assert a.text.startswith("Hello (big) world") and a.page_count == 2 and [i.mime_type for i in a.images] == ["image/png", "image/png", "image/jpeg", "image/png", "image/jp2"] and a.images[0].page == 2
    assert got["/b.pdf"].text is None and "not a PDF" in got["/b.pdf"].error_message and got["/c.pdf"].error_message
