"""The PDF reader and writer on documents made here."""

import re
import zlib

import pytest

from foliolake.sources.pdf import build, crypto, edit, export, extract, fonts, layout, scan
from foliolake.sources.pdf.cos import Document, Lexer, Name, PdfError, Ref, Stream, ascii85, ascii_hex, decoded, inflate, unpredict, written

TWO = [[(72, 700, "Hello World", 12), (72, 686, "mail bob@example.com now", 12), (72, 600, "BIG", 24)], [(72, 700, "second page", 12)]]


def doc(pages=TWO, **k):
    return Document.load(build.simple(pages, **k))


def texts(d, i=0):
    return [p.text for p in layout.paragraphs(extract.page_scan(d, d.pages()[i]).glyphs)]


def again(d):
    return Document.load(d.save())


def test_objects_round_trip():
    x = {Name("A"): [1, -2.5, True, None, b"(a)\\", Ref(3, 0)], Name("B C"): {Name("D"): Name("e#")}}
    assert Lexer(written(x)).object() == x
    assert Lexer(rb"(a\(b\)\101\n(c))").object() == b"a(b)A\n(c)"
    assert Lexer(b"<48656C6C6>").object() == b"Hell`"


def test_filters():
    data = bytes(range(256)) * 4
    assert inflate(zlib.compress(data)) == data
    assert ascii_hex(b"48 65 6C6>") == b"Hel`"
    assert ascii85(b"87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert unpredict(b"\x02\x01\x02\x02\x01\x01", {"Predictor": 12, "Columns": 2}) == b"\x01\x02\x02\x03"
    assert unpredict(b"\x01\x01\x01", {"Predictor": 2, "Columns": 3}) == b"\x01\x02\x03"
    with pytest.raises(PdfError) as e:
        inflate(zlib.compress(bytes(3 << 20), 9))
    assert e.value.code == "SECURITY_LIMIT"
    with pytest.raises(PdfError):
        decoded(Stream({Name("Filter"): Name("LZWDecode")}, b""))


def test_load_errors():
    for bad, code in ((b"x", "NOT_PDF"), (b"%PDF-1.7 no table", "XREF"), (b"%PDF-1.7\nstartxref\n99999\n%%EOF", "XREF")):
        with pytest.raises(PdfError) as e:
            Document.load(bad)
        assert e.value.code == code
    d = Document.empty()
    d.objects[5] = Ref(5, 0)
    with pytest.raises(PdfError):
        d.resolve(Ref(5, 0))


def test_xref_stream_and_object_stream():
    body = b"%PDF-1.7\n"
    packed = b"1 0 2 36 <</Type/Catalog/Pages 2 0 R>>       <</Type/Pages/Kids[]/Count 0>>"
    first = packed.index(b"<<")
    packed = b"1 0 2 %d " % (packed.index(b"<</Type/Pages") - first) + packed[first:]
    first = packed.index(b"<<")
    at3 = len(body)
    body += b"3 0 obj\n<</Type/ObjStm/N 2/First %d/Length %d>>\nstream\n" % (first, len(packed)) + packed + b"\nendstream\nendobj\n"
    at4 = len(body)
    rows = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([c]) for k, a, c in ((0, 0, 0), (2, 3, 0), (2, 3, 1), (1, at3, 0), (1, at4, 0)))
    body += b"4 0 obj\n<</Type/XRef/W[1 2 1]/Size 5/Root 1 0 R/Length %d>>\nstream\n" % len(rows) + rows + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at4
    d = Document.load(body)
    assert d.catalog["Type"] == "Catalog" and d.pages() == []
    assert d.xref[1].kind == "compressed"


def test_layout_numbers():
    d = doc()
    g = extract.page_scan(d, d.pages()[0]).glyphs
    assert (g[0].text, g[0].advance, g[0].size) == ("H", 6.0, 12.0)
    assert texts(d) == ["Hello World\nmail bob@example.com now", "BIG"]
    two = doc([[(72, 700, "a", 16), (72, 684, "b", 9)]])
    assert len(texts(two)) == 2
    assert layout.alignment([(0, 0, 50, 1), (0, 0, 50, 1), (0, 0, 9, 1)]) == "justified"
    assert layout.alignment([(10, 0, 40, 1), (0, 0, 50, 1), (0, 0, 5, 1)]) == "center"


def test_composite_font_and_cmap():
    m = fonts.cmap(b"2 beginbfchar <0001> <0048> <0002><0065> endbfchar 1 beginbfrange <0003> <0004> <006C> endbfrange 1 beginbfrange <0005> <0005> [<006F>] endbfrange")
    assert m == {1: "H", 2: "e", 3: "l", 4: "m", 5: "o"}
    f = fonts.Font("F", composite=True, to_unicode=m, widths={1: 600.0})
    s = layout.scan(layout.operations(b"BT /F 12 Tf <0001000200030003> Tj ET"), {"F": f})
    assert "".join(g.text for g in s.glyphs) == "Hell" and s.glyphs[0].advance == pytest.approx(7.2)
    assert fonts.css_face("ABCDEF+Times-BoldItalic") == ("serif", 700, "italic")


def test_ruled_and_aligned_tables():
    rules = b"".join(b"%d 600 m %d 700 l S " % (x, x) for x in (100, 200, 300)) + b"".join(b"100 %d m 300 %d l S " % (y, y) for y in (600, 650, 700))
    cells = [(110, 670, "Item", 12), (210, 670, "Cost", 12), (110, 620, "Tea", 12), (210, 620, "3", 12)]
    d = doc([cells], rules=[rules])
    (t,) = layout.tables(extract.page_scan(d, d.pages()[0]))
    assert t.matrix() == [["Item", "Cost"], ["Tea", "3"]]
    d = doc([[(72, y, a, 12) for y, a in ((700, "A"), (680, "B"), (660, "C"))] + [(250, y, a, 12) for y, a in ((700, "x"), (680, "y"), (660, "z"))]])
    (t,) = layout.tables(extract.page_scan(d, d.pages()[0]))
    assert t.matrix() == [["A", "x"], ["B", "y"], ["C", "z"]]
    with pytest.raises(PdfError):
        layout.scan([("re", [0.0, 0.0, 20.0, 20.0])] * 2000)


def test_hidden_layer():
    d = doc()
    edit.add_layer(d, "Secret", visible=False)
    edit.register_layer(d, 0, "L1", "Secret")
    edit.set_content(d, d.pages()[0], b"/OC /L1 BDC " + build.text_line(72, 700, "hidden") + b" EMC " + build.text_line(72, 600, "shown"))
    d = again(d)
    assert texts(d) == ["shown"] and extract.layers(d)[0]["visible"] is False
    edit.show_layer(d, "Secret", True)
    assert texts(again(d)) == ["hidden", "shown"]


def test_encryption_of_each_revision():
    for rev in (4, 5, 6):
        raw = crypto.encrypt(doc(), "own", "usr", rev=rev, perms=-44).save()
        for pw, owner in (("usr", False), ("own", True)):
            d = crypto.open_with(Document.load(raw), pw)
            assert d.owner is owner and texts(d)[1] == "BIG"
        with pytest.raises(PdfError) as e:
            crypto.open_with(Document.load(raw), "wrong")
        assert e.value.code == "BAD_PASSWORD"
    key, iv, plain = (bytes.fromhex(h) for h in ("2b7e151628aed2a6abf7158809cf4f3c", "000102030405060708090a0b0c0d0e0f", "6bc1bee22e409f96e93d7e117393172a"))
    assert crypto.cbc_encrypt(key, iv, plain, False).hex() == "7649abac8119b246cee98e9b12e9197d"
    assert crypto.cbc_decrypt(key, iv, crypto.cbc_encrypt(key, iv, plain + b"x")) == plain + b"x"


def test_pages():
    d = doc([[(72, 700, t, 12)] for t in "abcd"])
    edit.reorder_pages(d, [3, 2, 1, 0])
    edit.delete_pages(d, [0])
    d = again(d)
    assert [texts(d, i)[0] for i in range(3)] == ["c", "b", "a"]
    with pytest.raises(PdfError):
        edit.delete_pages(d, [0, 1, 2])
    with pytest.raises(PdfError):
        edit.reorder_pages(d, [0, 0, 1])
    m = again(edit.merge([d, doc()]))
    assert len(m.pages()) == 5 and texts(m, 3)[1] == "BIG"
    assert [len(p.pages()) for p in edit.split(m, 2)] == [2, 2, 1]
    edit.insert_blank(m, 0)
    edit.duplicate_page(m, 1, 0)
    assert len(again(m).pages()) == 7
    edit.rotate(m, 90)
    edit.rotate(m, 90, 0)
    assert [extract.rotation(m, p) for p in m.pages()[:2]] == [180, 90]
    edit.set_box(m, 0, "crop", [10, 10, 200, 200])
    assert extract.page_boxes(again(m), m.pages()[0])["crop"] == (10, 10, 200, 200)
    with pytest.raises(PdfError):
        edit.set_box(m, 0, "media", None)


def test_redaction_removes_text_everywhere():
    d = doc()
    edit.add_attachment(d, "note.txt", b"write to bob@example.com")
    edit.create_field(d, 0, "who", "text", (72, 500, 200, 520), "bob@example.com")
    out = edit.redact_pattern(d, re.compile(r"[\w.]+@[\w.]+"))
    raw = again(d)
    assert out[0]["glyphs"] == len(" bob@example.com ")  # the padding touches the spaces beside it
    assert "bob" not in " ".join(texts(raw)) and "mail" in texts(raw)[0] and "now" in texts(raw)[0]
    assert extract.attachments(raw) == [] and extract.form_fields(raw)[0]["value"] == ""
    assert edit.scrub_metadata(d) in (True, False)


def test_image_black_out_and_scan_page():
    d = doc([[]])
    page = d.pages()[0]
    ref = edit.add_image(d, extract.encode_png(4, 2, bytes([200] * 24), True))
    edit.resource(d, page, "XObject", "Im", ref)
    edit.set_content(d, page, b"q 400 0 0 200 0 0 cm /Im Do Q")
    s = extract.page_scan(d, page)
    assert extract.scanned_image(d, page, s)["width_px"] == 4
    words = edit.parse_ocr_tsv("level\tleft\ttop\twidth\theight\tconf\ttext\n5\t0\t0\t2\t1\t90\tHi\n5\t0\t0\t1\t1\t-1\tno\n4\t0\t0\t1\t1\t90\tno")
    assert edit.ocr_layer(d, 0, words, 4, 2) == 1 and texts(d) == ["Hi"]
    edit.redact(d, 0, [(0, 0, 100, 100)])
    (row,) = [r for r in extract.images(d, page, extract.page_scan(d, page))]
    data, kind = extract.image_bytes(d, row["obj_num"])
    w, h, raw, _ = extract.png_pixels(data)
    assert kind == "png" and raw.count(0) == 3


def test_text_changes():
    d = doc()
    assert edit.replace_text(d, "hello", "Goodbye")["replacements"] == 1
    assert "Goodbye World" in " ".join(texts(again(d))).replace("\n", " ")
    d = doc()
    edit.edit_paragraph(d, 0, 1, "small", size=10)
    edit.text_box(d, 0, (300, 300, 500, 400), "in a box")
    edit.fill_sign(d, 0, (100, 100, 200, 130), text="Ann")
    edit.fill_sign(d, 0, (100, 100, 200, 130), strokes=[[(110, 110), (120, 120)]])
    have = " ".join(texts(again(d)))
    assert "small" in have and "in a box" in have and "Ann" in have and "BIG" not in have
    with pytest.raises(PdfError):
        edit.fill_sign(d, 0, (0, 0, 10, 10), strokes=[[(50, 50), (60, 60)]])
    lines = edit.reflow("aa bb cc", 5, len, "justified")
    assert [x["text"] for x in lines] == ["aa bb", "cc"] and edit.reflow("a", 10, len, "right")[0]["dx"] == 9


def test_decoration():
    d = doc()
    assert edit.paginate(d, "{page}/{total}", skip_first=True) == 1
    edit.text_watermark(d, "DRAFT", degrees=0)
    edit.image_watermark(d, extract.encode_png(2, 2, bytes(4), False))
    d = again(d)
    assert "2/2" in " ".join(texts(d, 1)) and any("DRAFT" in t for t in texts(d))
    with pytest.raises(PdfError):
        edit.paginate(d, position="middle")


def test_annotations_and_forms():
    d = doc()
    edit.markup(d, 0, "Highlight", (72, 690, 140, 710), contents="note")
    edit.link(d, 0, (0, 0, 10, 10), uri="https://example.com")
    edit.link(d, 0, (0, 0, 10, 10), page=1)
    s = edit.stamp(d, 0, "draft")
    edit.shape(d, 0, "polygon", [(0, 0), (10, 0), (10, 10)])
    with pytest.raises(PdfError):
        edit.link(d, 0, (0, 0, 1, 1), uri="javascript:x")
    with pytest.raises(PdfError):
        edit.shape(d, 0, "line", [(0, 0)])
    d = again(d)
    own = extract.annotations(d, d.pages()[0], d.pages())
    assert [a["subtype"] for a in own] == ["Highlight", "Link", "Link", "Stamp", "Polygon"]
    assert own[0]["opacity"] == 0.4 and own[1]["link_uri"] == "https://example.com" and own[2]["link_page"] == 1
    assert edit.delete_annotation(d, 0, s.num) and edit.flatten_annotations(d) == 1
    assert [a["subtype"] for a in extract.annotations(d, d.pages()[0], d.pages())] == ["Link", "Link", "Polygon"]

    d = doc()
    edit.create_field(d, 0, "CustomerName", "text", (72, 500, 200, 520))
    edit.create_field(d, 0, "AcceptTerms", "checkbox", (72, 470, 84, 482))
    edit.create_field(d, 1, "Country", "choice", (72, 440, 200, 460), options=["MX", "ES"])
    with pytest.raises(PdfError):
        edit.create_field(d, 0, "Country", "text", (0, 0, 1, 1))
    assert edit.fill(d, {"CustomerName": "Ann", "AcceptTerms": "yes", "Country": "ES"}) == 3
    d = again(d)
    own = {f["name"]: f for f in extract.form_fields(d)}
    assert (own["CustomerName"]["value"], own["AcceptTerms"]["value"], own["Country"]["options"], own["Country"]["page_number"]) == ("Ann", "Yes", ["MX", "ES"], 2)
    assert edit.update_field(d, "Country", tooltip="where") and edit.delete_field(d, "AcceptTerms") and not edit.delete_field(d, "none")
    assert edit.hard_flatten(d)["fields"] == 2
    assert "Ann" in " ".join(texts(again(d))) and extract.form_fields(again(d)) == []


def test_document_data():
    d = doc(info={"Title": "Old", "Author": "Ann"})
    edit.set_metadata(d, {"title": "Neu ß", "author": " "})
    d = again(d)
    assert extract.metadata(d)["title"] == "Neu ß" and extract.metadata(d)["author"] is None
    d.trailer.pop("Info")
    assert extract.metadata(d)["title"] == "Neu ß"
    edit.set_outlines(d, [{"path": [0], "title": "A", "page_number": 1}, {"path": [0, 0], "title": "B", "page_number": 2, "top": 700.0}, {"path": [1], "title": "C", "uri": "https://x.org"}])
    edit.add_outline(d, {"title": "D", "page_number": 2}, [0])
    own = extract.outlines(again(d))
    assert [(o["path"], o["title"]) for o in own] == [([0], "A"), ([0, 0], "B"), ([0, 1], "D"), ([1], "C")] and own[1]["top"] == 700
    assert edit.clear_outlines(d) and extract.outlines(d) == []
    edit.add_attachment(d, "a/b.txt", b"x", "text/plain", "desc")
    (a,) = extract.attachments(again(d))
    assert (a["name"], a["size"], a["mime"], a["data"]) == ("a_b.txt", 1, "text/plain", b"x")
    assert edit.delete_attachment(d, "a_b.txt") and not edit.delete_attachment(d, "a_b.txt")
    edit.add_layer(d, "L")
    assert edit.delete_layer(d, "L") and extract.layers(d) == []


def test_optimize_and_active_content():
    d = doc(flate=False)
    d.catalog[Name("OpenAction")] = {Name("S"): Name("JavaScript"), Name("JS"): b"x"}
    same = [d.add(Stream({}, b"abc" * 100)) for _ in range(2)]
    d.catalog[Name("Keep")] = list(same)
    d.add(Stream({}, b"lost"))
    out = edit.optimize(Document.load(d.save()))
    assert out["duplicates"] >= 1 and out["garbage"] >= 1 and out["active"] >= 1 and out["size_after"] < out["size_before"]


def test_attestation():
    raw = edit.attest(doc(), "Ann", "ok")
    (s,) = edit.attested(raw)
    assert s["valid"] and s["signer_name"] == "Ann"
    assert not edit.attested(raw.replace(b"Producer", b"producer") if b"Producer" in raw else raw.replace(b"/Helvetica", b"/helvetica", 1))[0]["valid"]


def test_reports():
    assert "NO_LANGUAGE" in extract.ua_issues(doc()) and "FONT_NOT_EMBEDDED" in extract.archive_issues(doc())


def test_exports():
    rules = b"".join(b"%d 600 m %d 700 l S " % (x, x) for x in (100, 200, 300)) + b"".join(b"100 %d m 300 %d l S " % (y, y) for y in (600, 650, 700))
    d = doc([[(72, 750, "Title", 22), (110, 670, "It|em", 12), (210, 670, "Cost", 12), (110, 620, "Tea", 12), (210, 620, "3", 12)]], rules=[rules])
    assert export.markdown(d) == "# Title\n\n| It\\|em | Cost |\n| :--- | :--- |\n| Tea | 3 |"
    import io
    import zipfile

    for kind, part, word in (("docx", "word/document.xml", "Title"), ("xlsx", "xl/worksheets/sheet1.xml", "Tea"), ("pptx", "ppt/slides/slide1.xml", "Title")):
        z = zipfile.ZipFile(io.BytesIO(getattr(export, kind)(d)))
        assert word in z.read(part).decode()
    assert [export.column(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_scan_tables(spark):
    bad, bomb = b"junk", build.simple([[(72, 700, "x", 12)]])
    files = spark.createDataFrame([("a", bytearray(build.simple(TWO, info={"Title": "T"}))), ("b", bytearray(bad)), ("c", bytearray(bomb)), ("d", None)], "doc_id string, content binary")
    for t in scan.TABLES:
        rows = scan.scan(files, t).collect()
        assert {r["doc_id"]: r["status"]["code"] for r in rows if r["status"]["code"] != "OK"} == {"b": "NOT_PDF", "d": "NOT_PDF"}
    own = scan.scan(files, "paragraphs").where("status.code = 'OK'").orderBy("doc_id", "page_index", "paragraph_id").collect()
    assert [r["text"] for r in own] == ["Hello World\nmail bob@example.com now", "BIG", "second page", "x"]


def test_document_operators(spark, tmp_path):
    from foliolake.operators import documents
    from foliolake.sources import datasource
    from foliolake.streaming.files import stream

    files = spark.createDataFrame([("a", bytearray(build.simple(TWO))), ("b", bytearray(b"junk"))], "doc_id string, content binary")
    out = {r["doc_id"]: r for r in documents.change(files, "rotate", 90).collect()}
    assert out["a"]["status"]["code"] == "OK" and out["b"]["content"] is None
    assert documents.split(files.where("doc_id = 'a'"), 1).count() == 2
    md = documents.export_as(files, "markdown").where("doc_id = 'a'").first()
    assert "second page" in bytes(md["content"]).decode()
    locked = documents.encrypt(files.where("doc_id = 'a'"), "o", "u")
    assert scan.scan(locked.select("doc_id", "content"), "pages").first()["status"]["code"] == "BAD_PASSWORD"
    assert scan.scan(documents.decrypt(locked.select("doc_id", "content"), "o").select("doc_id", "content"), "pages").count() == 2
    two = files.where("doc_id = 'a'").unionByName(files.where("doc_id = 'a'")).selectExpr("'k' as k", "doc_id", "content")
    assert len(Document.load(bytes(documents.merge(two, ["k"], ["doc_id"]).first()["content"])).pages()) == 4
    (tmp_path / "x.pdf").write_bytes(build.simple(TWO))
    (tmp_path / "y.pdf").write_bytes(b"junk")
    datasource.register(spark)
    rows = spark.read.format("pdf").option("table", "lines").load(str(tmp_path)).collect()
    assert sorted({r["status"] for r in rows}) == ["NOT_PDF", "OK"] and len([r for r in rows if r["status"] == "OK"]) == 4
    q = stream(spark, str(tmp_path), "paragraphs").writeStream.format("memory").queryName("paras").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from paras where status.code = 'OK'").first()[0] == 3


def test_form_detection():
    from foliolake.sources.pdf import detect

    rules = b"150 500 m 300 500 l S 150 450 200 20 re S 72 400 12 12 re S 72 300 300 60 re S "
    d = doc([[(72, 503, "Full name:", 12), (60, 455, "Signature ___", 12), (90, 402, "I agree", 12)]], rules=[rules])
    found = detect.candidates(d, 0)
    assert [(c["field_type"], c["label"], c["confidence"]) for c in found] == [("text", "Full name", 0.88), ("signature", "Signature", 0.92), ("checkbox", "I agree", 0.9), ("text", None, 0.65)]
    assert detect.apply(d, 0) == 4 and detect.candidates(d, 0) == []
    own = {f["name"]: f for f in extract.form_fields(again(d))}
    assert {"FullName", "Signature", "IAgree"} <= set(own) and sum(f["is_multiline"] for f in own.values()) == 1


def test_conformance_and_appending():
    from foliolake.sources.pdf import conform

    d = doc(info={"Title": "T"})
    out = conform.tag(d)
    assert out["issues"] == [] and [e["struct_type"] for e in extract.structure(again(d))] == ["Document", "Sect", "P", "H1", "Sect", "P"]
    with pytest.raises(PdfError) as e:
        conform.to_archive(doc())
    assert "FONT_NOT_EMBEDDED" in str(e.value)
    d = doc()
    for p in d.pages():
        for f in d.dict_of(d.dict_of(d.inherited(p, "Resources"))["Font"]).values():
            d.dict_of(f)[Name("FontDescriptor")] = {Name("FontFile2"): d.add(Stream({}, b"x"))}
    edit.add_attachment(d, "a.txt", b"x")
    done = again(conform.to_archive(d, 1))
    assert extract.archive_issues(done, 1) == [] and len(conform.srgb_profile()) % 4 == 0
    raw = edit.attest(doc(), "Ann")
    d = Document.load(raw)
    edit.set_rotation(d, 0, 90)
    more = conform.save_appended(d)
    assert more.startswith(raw) and extract.rotation(Document.load(more), Document.load(more).pages()[0]) == 90 and texts(Document.load(more)) == texts(doc())


def test_pictures():
    import numpy as np

    from foliolake.sources.pdf import raster

    d = doc([[(10, 50, "Text", 12)]], rules=[b"1 0 0 rg 0 0 50 20 re f 0 0 1 RG 0 40 m 100 40 l S "])
    edit.set_box(d, 0, "crop", [0, 0, 100, 80])
    px, missed = raster.paint(d, 0, 72)
    assert px.shape == (80, 100, 3) and tuple(px[70, 10]) == (255, 0, 0) and tuple(px[10, 90]) == (255, 255, 255) and tuple(px[39, 80]) == (0, 0, 255)
    assert (px[22:30, 10:40] == 0).all(2).any() and missed["paths"] == 0
    w, h, raw, _ = extract.png_pixels(raster.render(d, 0, "png", 72))
    assert np.array_equal(np.frombuffer(raw, np.uint8).reshape(h, w, 3), px) and raster.render(d, 0, "tiff", 72)[:4] == b"II*\0"
    for bad in (10, 400):
        with pytest.raises(PdfError):
            raster.paint(d, 0, bad)


def test_layout_in_sql_equals_the_readers(spark):
    from foliolake.operators import layout as L

    pages = [[(72, 700 - 14 * i, f"line {i} of it", 12) for i in range(4)] + [(300, 700, "beside", 12), (340.0, 700.5, "it", 12), (72, 500, "HEAD", 20), (72, 478, "small", 9), (90, 466, "two", 9), (300, 455, "off", 9)], [(72, 700, "x", 12)]]
    files = spark.createDataFrame([("a", bytearray(build.simple(pages))), ("b", bytearray(build.simple(TWO)))], "doc_id string, content binary")
    spans = L.spans(scan.scan(files, "glyphs"))
    lines = L.lines(spans)

    def show(df, *cols):
        return sorted((r["doc_id"], r["page_index"], *(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols)) for r in df.collect())

    assert sorted(x[:3] for x in show(spans, "text")) == sorted(x[:3] for x in show(scan.scan(files, "spans"), "text"))
    assert show(lines, "line_id", "text", "baseline_y") == show(scan.scan(files, "lines"), "line_id", "text", "baseline_y")
    assert show(L.paragraphs(lines), "paragraph_id", "text", "line_count", "leading") == show(scan.scan(files, "paragraphs"), "paragraph_id", "text", "line_count", "leading")
