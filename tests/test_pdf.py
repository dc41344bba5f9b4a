import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.operators import document
from pagemill.plans import pdf as drawing
from pagemill.sources import pdf


def stream(data, info=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), info, data)


def file_of(objects, trailer=b""):
    out = b"%PDF-1.4\n%\xe2\xe3\n" + b"".join(b"%d 0 obj %s endobj\n" % x for x in objects.items())
    return out + b"trailer << /Root 1 0 R " + trailer + b">>\nstartxref\n0\n%%EOF"


def page_of(content, font=b"<< /Type /Font /Subtype /Type1 /BaseFont /F /FirstChar 32 /Widths [ %s ] >>" % (b"500 " * 224), more=None, resources=b""):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [ 3 0 R ] /MediaBox [0 10 300 410] >>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>%s>>>>" % resources, 4: stream(content), 5: font}
    return file_of(objects | (more or {}))


def read(data):
    return [p() for p in pdf.page_readers(data)]


def shown(data):
    return "".join(g["s"] for g in read(data)[0][0]["glyphs"])


def test_text_is_placed():
    page = read(page_of(rb"BT /F1 10 Tf 2 Tc 50 700 Td (A\(b\)\101\\) Tj 14 TL T* (x) Tj (y) ' 0 0 (z) " + b'" ET'))[0][0]
    assert (page["width"], page["height"]) == (300.0, 400.0)
    g = page["glyphs"]
    assert "".join(x["s"] for x in g) == "A(b)A\\xyz"
    assert [x["x"] for x in g[:3]] == [50.0, 57.0, 64.0] and g[0]["w"] == 5.0 and {x["font_size"] for x in g} == {10.0}
    assert [x["y"] for x in g] == [700.0] * 6 + [686.0, 672.0, 658.0]


def test_matrices_spacing_and_rectangles():
    page = read(page_of(b"q 2 0 0 2 10 20 cm 5 5 30 40 re W n BT /F1 6 Tf 50 Tz 3 Ts 1 0 0 1 7 8 Tm [(a) -1000 (b)] TJ ET Q BT /F1 4 Tf 0 0 Td (c) Tj ET"))[0][0]
    a, b, c = page["glyphs"]
    assert (a["x"], a["y"], a["font_size"], a["w"]) == (24.0, 42.0, 6.0, 3.0)
    assert b["x"] == pytest.approx(24 + 2 * (1.5 + 3)) and (c["x"], c["y"], c["font_size"]) == (0.0, 0.0, 4.0)
    assert page["rects"] == [{"seq": 0, "left": 20.0, "top": 110.0, "right": 80.0, "bottom": 30.0}]


def test_encodings():
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /F /Encoding << /BaseEncoding /MacRomanEncoding /Differences [ 65 /eacute /fi /alpha /uni20AC /one 1 /Aring ] >> >>"
    assert shown(page_of(b"BT /F1 9 Tf (ABCDE\x01z\x8e) Tj ET", font)) == "éﬁα€1Åzé"
    cmap = stream(b"2 beginbfrange <0001> <0003> <0041> <0004> <0005> [<0078> <0079007A>] endbfrange 1 beginbfchar <0006> <D83DDE42> endbfchar")
    wide = b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R /DescendantFonts [ << /DW 250 /W [ 1 [ 100 200 ] 3 4 300 ] >> ] >>"
    data = page_of(b"BT /F1 10 Tf <000100020003000400050006> Tj ET", wide, {7: cmap})
    assert shown(data) == "ABCxyz🙂" and [round(g["w"], 6) for g in read(data)[0][0]["glyphs"]] == [1.0, 2.0, 3.0, 3.0, 2.5, 2.5]


def test_filters():
    text = b"BT /F1 9 Tf (compressed) Tj ET"
    rows = [text[i : i + 5].ljust(5) for i in range(0, len(text), 5)]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, rows[i - 1] if i else bytes(5), strict=True)) for i, r in enumerate(rows))
    for data, info in ((zlib.compress(text), b"/Filter /FlateDecode"), (text.hex().encode() + b">", b"/Filter [ /AHx ]"), (zlib.compress(up), b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >>")):
        assert shown(page_of(b"", more={4: stream(data, info)})) == "compressed"
    assert shown(page_of(b"", more={4: stream(b"9jqo^BlbD-BleB1DJ+*+F(f,q~>", b"/Filter /A85")})) == ""  # no operators, no text


def test_forms_and_images():
    form = stream(b"BT /F1 5 Tf (in) Tj ET /Again Do", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0] /Resources << /Font << /F1 5 0 R >> /XObject << /Again 8 0 R >> >>")
    data = page_of(b"/Fm Do BI /W 1 ID (Tj ET EI BT /F1 5 Tf (out) Tj ET", more={8: form}, resources=b"/XObject << /Fm 8 0 R >>")
    assert shown(data).endswith("out") and read(data)[0][0]["glyphs"][0]["x"] == 100.0  # a form that holds itself ends


def test_what_cannot_be_read():
    for bad in (b"", b"text", b"%PDF-1.4\nnothing", file_of({1: b"<< /Type /Catalog >>"}), file_of({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [ 2 0 R ] >>"}), page_of(b"").replace(b"/Root", b"/Encrypt 9 0 R /Root").replace(b"startxref", b"9 0 obj << >> endobj")):
        with pytest.raises(pdf.PdfError):
            list(pdf.page_readers(bad))
    with pytest.raises(pdf.PdfError):
        read(page_of(b"", more={4: stream(b"x", b"/Filter /LZWDecode")}))
    assert read(page_of(b"BT /F1 9 Tf (open"))[0][0]["glyphs"] == [] and shown(page_of(b"Q Q Tj 1 Td BT /None 9 Tf (a) Tj")) == "a"


def test_a_later_object_replaces_an_earlier_one():
    data = page_of(b"BT /F1 9 Tf (old) Tj ET") + b"\n4 0 obj " + stream(b"BT /F1 9 Tf (new) Tj ET") + b" endobj"
    assert shown(data) == "new"


def test_from_files_to_text(spark):
    text = "A Report of Many Things\nThe first line of prose goes on and is bro-\nken here. It ends.\n\nFigure 1 shows nothing\nThe second paragraph stands alone."
    rows = [("a", bytearray(drawing.drawn(2, text))), ("b", bytearray(b"%PDF-1.4 broken")), ("c", bytearray(drawing.drawn(3, "Only words here, as many as one needs.")))]
    pages = pdf.read_pages(spark.createDataFrame(rows, "path string, content binary")).cache()
    errors = sorted((r["path"], r["page_no"]) for r in pages.where("error is not null").collect())
    assert errors == [("b", 0), ("c", 2)]
    blocks, sizes, regions = document.from_pages(pages)
    assert {r["label"] for r in blocks.collect()} >= {"paragraph", "caption"}
    d = {r["path"]: r for r in document.processed(blocks, sizes, regions).join(pages.select("doc_id", "path").distinct(), "doc_id").collect()}
    assert set(d) == {"a", "c"} and d["c"]["text"] == "Only words here, as many as one needs."
    assert "goes on and is broken here. It ends." in d["a"]["text"] and "Figure 1" not in d["a"]["text"]
    assert regions.where(F.col("kind") == "caption").count() == 1
