"""What must not depend on how many files there are, or on how long their keys are."""

import os

import pytest

from foliolake.operators import compare, documents
from foliolake.sources.pdf import build, edit, layout, scan
from foliolake.sources.pdf.cos import Document

from .test_entry import SF

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def mailed(key):
    return build.simple([[(72, 750, "large ring", 18), (72, 500, f"mail p{key}@example.com now", 12)]], info={"Title": "large ring"})


def lines(d):
    return [r["text"] for r in scan.rows(d.save(), "lines")]


def plan(spark, name, sf=SF):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [0, 1999, 19999, 1199999, 10**12])
def test_replaced_text_is_measured_as_its_box_was(key):
    d = Document.load(mailed(key))
    edit.replace_text(d, "example.com", "example.it")
    assert lines(d) == ["large ring", f"mail p{key}@example.it now"]
    d = Document.load(mailed(key))
    edit.replace_text(d, "example.com", "example.com later")
    assert lines(d) == ["large ring", f"mail p{key}@example.com", "later now"]


def test_a_changed_copy_with_a_long_key_differs_in_its_words_only(spark):
    files = spark.createDataFrame([("19999", bytearray(mailed(19999)))], "doc_id string, content binary")
    changed = documents.change(files, "replace_text", "example.com", "example.it")
    both = [scan.scan(f.select("doc_id", "content"), "paragraphs") for f in (files, changed)]
    (r,) = compare.compare_paragraphs(*both, ["doc_id"]).collect()
    assert (r["kind"], r["base_text"], r["target_text"]) == ("modified", "mail p19999@example.com now", "mail p19999@example.it now")


def test_an_object_is_added_without_a_look_at_all_others():
    class Counted(dict):
        looks = 0

        def __iter__(self):
            Counted.looks += 1
            return super().__iter__()

    d = Document.empty()
    d.objects = Counted(d.objects)
    d.objects[500] = b"x"
    assert [d.add(b"").num for _ in range(200)] == [*range(3, 203)] and Counted.looks <= 2


def _page_looks(monkeypatch, run):
    looks, real = [], Document.pages
    monkeypatch.setattr(Document, "pages", lambda self: looks.append(1) or real(self))
    out = run()
    monkeypatch.undo()
    return out, len(looks)


def test_merging_looks_at_the_pages_of_each_file_once(monkeypatch):
    docs = [Document.load(mailed(k)) for k in range(40)]
    out, n = _page_looks(monkeypatch, lambda: edit.merge(docs))
    assert n == 40 and [p.text for x in out.pages() for p in layout.paragraphs(edit.extract.page_scan(out, x).glyphs)][1::2] == [f"mail p{k}@example.com now" for k in range(40)]


def test_splitting_looks_at_the_pages_once(monkeypatch):
    whole = edit.merge([Document.load(mailed(k)) for k in range(40)])
    parts, n = _page_looks(monkeypatch, lambda: edit.split(whole, 3))
    assert n == 1 and [len(p.pages()) for p in parts] == [3] * 13 + [1] and lines(parts[13])[1] == "mail p39@example.com now"


def test_merge_tells_of_every_input_where_one_fails(spark):
    rows = [("a", 1, bytearray(mailed(1))), ("b", 1, bytearray(b"junk")), ("c", 1, bytearray(mailed(2))), ("d", 2, bytearray(b"junk"))]
    got = {r["k"]: r for r in documents.merge(spark.createDataFrame(rows, "doc_id string, k int, content binary"), ["k"], ["doc_id"]).collect()}
    assert [s["code"] for s in got[1]["inputs"]] == ["OK", "NOT_PDF", "OK"] and len(Document.load(bytes(got[1]["content"])).pages()) == 2
    assert got[2]["content"] is None and got[2]["status"]["code"] == "NOT_PDF"


@needs_tables
@pytest.mark.parametrize("name", ["pdf_appended", "pdf_encrypted", "pdf_gates", "pdf_purge"])
def test_files_are_made_and_read_once(spark, name):
    p = plan(spark, name)
    assert "Join" not in p and p.count("MapInArrow") == 1


@needs_tables
@pytest.mark.parametrize("name", ["pdf_image_diff", "pdf_compare_documents"])
def test_pages_are_compared_in_batches(spark, name):
    p = plan(spark, name)
    assert "InPandas" not in p and p.count("MapInArrow") <= 3


def test_tables_of_one_reading_equal_those_of_several(spark):
    files = spark.createDataFrame([("a", bytearray(mailed(1))), ("b", bytearray(b"junk")), ("c", bytearray(build.simple([[]])))], "doc_id string, content binary")
    own = scan.scans(files, {t: t for t in scan.TABLES})
    for t in scan.TABLES:
        assert sorted(map(str, own.selectExpr("doc_id", f"inline({t})").collect())) == sorted(map(str, scan.scan(files, t).collect()))


def test_documents_compared_in_one_reading_equal_tables_compared(spark):
    other = Document.load(mailed(7))
    edit.replace_text(other, "example.com", "example.it")
    edit.insert_blank(other, 1)
    edit.set_metadata(other, {"title": "new"})
    schema = "doc_id string, content binary"
    a = spark.createDataFrame([("x", bytearray(mailed(7))), ("y", bytearray(mailed(8))), ("gone", bytearray(mailed(9))), ("bad", bytearray(b"junk"))], schema)
    b = spark.createDataFrame([("x", bytearray(other.save())), ("y", bytearray(mailed(8))), ("new", bytearray(mailed(9))), ("bad", bytearray(b"junk"))], schema)
    names = ("pages", "paragraphs", "images", "metadata")
    want = compare.compare_documents(*({t: scan.scan(f, t) for t in names} for f in (a, b)), ["doc_id"])
    got = compare.compare_scans(*(scan.scans(f, {t: t for t in names}) for f in (a, b)), ["doc_id"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_texts_of_any_number_give_the_same_items_and_leave_other_operators_no_words(spark):
    from foliolake.llm import common, decontaminate, shingles

    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"before {i} {item} after" if i % 7 == 0 else f"nothing of it {i} " * 9) for i in range(1200)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r[0] for r in decontaminate.find_items(docs, bench).collect()) == list(range(0, 1200, 7))
    assert sorted(r[0] for r in decontaminate.without_items(docs, bench).collect()) == [i for i in range(1200) if i % 7]

    def state(batches):
        import pyarrow as pa

        shingles.shingle_set("a few words of the stage before this one")
        held = len(shingles._words)
        common.entered("decontamination")
        n = len(shingles._words)
        decontaminate.word_ids("five")
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"held": [held], "left": [n], "last": [common._last[0]]})

    r = spark.range(1).coalesce(1).mapInArrow(state, "held long, left long, last string").first()
    assert r["held"] > 0 and r["left"] == 0 and r["last"] == "decontamination"


@needs_tables
def test_groups_are_merged_once(spark):
    p = plan(spark, "pdf_merge_status")
    assert "Join" not in p and p.count("MapInArrow") == 1


def test_reading_a_file_takes_each_cross_reference_at_once(monkeypatch):
    from foliolake.sources.pdf.cos import Lexer

    data, taken, real = edit.merge([Document.load(mailed(k)) for k in range(20)]).save(), [], Lexer.object
    monkeypatch.setattr(Lexer, "object", lambda self, depth=0: taken.append(1) or real(self, depth))
    assert len(Document.load(data).xref) > 60 and len(taken) < 30


def test_comments_and_odd_tokens_are_read_as_before():
    from foliolake.sources.pdf.cos import Lexer, Name, PdfError, Ref

    assert Lexer(b"%x\n[ 1 %]\n 2 0 R%>>\n/a#20b <</K%]>>\n[+3 -.5 true]>> (a\\)) <4> ]").object() == [1, Ref(2, 0), Name("a b"), {"K": [3, -0.5, True]}, b"a)", b"@"]
    assert Lexer(b"7 0 Rx").object() == 7 and Lexer(b"7 0 R", content=True).object() == 7
    for odd in (b"[ab% -]", b"[1 %]"):
        with pytest.raises(PdfError):
            Lexer(odd).object()
    doc = Document(b"xref\n0 2 %c\n0000000000 65535 f \n%c\n0000000017 00000 n \ntrailer <</Size 2>>")
    assert doc._section(0, 0) == {"Size": 2} and [(e.kind, e.offset) for e in doc.xref.values()] == [("free", 0), ("in_use", 17)]


def test_groups_are_dealt_over_more_tasks_than_cores(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([(f"{k}", k, bytearray(mailed(k))) for k in range(50)], "doc_id string, k int, content binary")
    tasks = documents.merge(files, ["k"], ["doc_id"]).groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 50 and max(r["n"] for r in tasks) <= 8


@pytest.mark.parametrize("gap", [b" " * 26, b"\r\n" * 13, b" " * 13 + b"% [a] >> ]\n" + b" " * 13])
def test_white_space_before_anything_but_a_bracket_is_passed_once(gap):
    import time

    from foliolake.sources.pdf.cos import Lexer

    began = time.process_time()
    got = Lexer(b"<</A [1" + gap + b"2" + gap + b"]" + gap + b"/B 3" + gap + b">>").object()
    assert got == {"A": [1, 2], "B": 3} and time.process_time() - began < 0.5


def test_a_signed_file_is_appended_to_and_read_in_a_few_milliseconds():
    import time

    from foliolake.sources.pdf import conform

    signed = edit.attest(Document.load(mailed(1)), "Ann")
    assert b"]" + b" " * 16 in signed  # room for the longest byte range
    began = time.process_time()
    for _ in range(20):
        d = Document.load(signed)
        edit.set_rotation(d, 0, 90)
        out = conform.save_appended(d)
        assert [s["byte_range_valid"] for s in scan.rows(out, "signatures")] == [False] and [r["rotation"] for r in scan.rows(out, "pages")] == [90]
    assert out.startswith(signed) and time.process_time() - began < 1


def test_appending_opens_what_changed_not_the_whole_file(monkeypatch):
    from foliolake.sources.pdf import conform
    from foliolake.sources.pdf.cos import Lexer

    data, taken, real = edit.merge([Document.load(mailed(k)) for k in range(40)]).save(), [], Lexer.indirect
    d = Document.load(data)
    edit.set_metadata(d, {"title": "new"})
    monkeypatch.setattr(Lexer, "indirect", lambda self, *a: taken.append(1) or real(self, *a))
    out = conform.save_appended(d)
    monkeypatch.undo()
    assert len(d.xref) > 120 and len(taken) < 10 and out.startswith(data) and len(Document.load(out).pages()) == 40
    assert next(scan.rows(out, "metadata"))["title"] == "new"
