"""Patterns, scalar functions and relational operators on small inputs."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliolake.functions import geometry as G
from foliolake.functions import patterns as P
from foliolake.functions import text as T
from foliolake.operators import cluster, compare, forms, graph, pages, search, tables


def one(spark, col, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(col).collect()]


X = None


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")


def test_patterns(spark):
    assert one(spark, P.email(X), "Contact us at contact@company.org or support@domain.co.uk for inquiries.", "a@b.co.", "a@b.co@d.com", None)[0] == ["contact@company.org", "support@domain.co.uk"]
    assert one(spark, P.email(X), "a@b.co.")[0] == []
    assert one(spark, P.ssn(X), "SSN: 123-45-6789 and secondary 987-65-4321 confirmed.")[0] == ["123-45-6789", "987-65-4321"]
    assert one(spark, P.card(X), "0000-0000-0000-0000", "4111111111111111", "4111111111111112")[:] == [["0000-0000-0000-0000"], ["4111111111111111"], []]
    assert one(spark, P.rfc(X), "GARM850101XYZ")[0] == ["GARM850101XYZ"]
    assert one(spark, P.curp(X), "GARM850101HDFRRN01")[0] == ["GARM850101HDFRRN01"]
    assert one(spark, P.phone(X), "call +1 (555) 123-4567 now", "12 34", "1234567890123456")[:] == [["+1 (555) 123-4567"], [], ["234567890123456"]]
    assert one(spark, P.matches(X, "Correo"), "x@y.org")[0] == ["x@y.org"]
    assert one(spark, P.mask(X, P.email(X), "#"), "to x@y.org.au and x@y.org.au!")[0] == "to # and #!"
    assert one(spark, P.repeats(X, ["abc", "abcd"], "HELLO"), "xabcx", "xabcdx", "say hello", None) == [False, True, True, False]
    with pytest.raises(ValueError):
        P.matches(X, "nothing")


def test_search(spark):
    assert search.locate_folded("Straße", "strasse") == [(0, 6)] and search.locate_folded("aßb", "ss") == [(1, 2)]
    df = spark.createDataFrame([("d", 0, "Hello Hello"), ("d", 1, "say hello"), ("e", 0, None)], "doc string, p int, text string")
    hits = search.search(df, "Hello", ["doc", "p"]).orderBy("doc", "p", "char_start").collect()
    assert [(r["p"], r["char_start"], r["char_end"], r["truncated"]) for r in hits] == [(0, 0, 5, False), (0, 6, 11, False)]
    assert search.search(df, "HELLO", ["doc", "p"], ignore_case=True, max_hits=2).where("truncated").count() == 2
    for bad in ("", "x" * 513):
        with pytest.raises(ValueError):
            search.search(df, bad, ["doc"])


@settings(max_examples=30, deadline=None)
@given(st.text("aAßbİ .", max_size=12), st.text("aAßb", min_size=1, max_size=3))
def test_folded_hits_are_real(text, query):
    for a, b in search.locate_folded(text, query):
        assert search.folded(query)[0] in search.folded(text[a:b])[0]


def test_scalars(spark):
    assert one(spark, T.pdf_date_to_iso(X), "D:20261008123045Z", "D:20261008123045+02'00'", "D:2026", "D:1", "20261008")[:] == ["2026-10-08T12:30:45Z", "2026-10-08T12:30:45+02:00", "2026-01-01T00:00:00Z", "D:1", "2026-10-08T00:00:00Z"]
    assert one(spark, T.iso_to_pdf_date(X), "2026-10-08T12:30:45Z", "D:2026", "x")[:] == ["D:20261008123045Z", "D:2026", "D:x"]
    assert one(spark, T.csv_field(X), 'High "performance" model', "a,b", "plain")[:] == ['"High ""performance"" model"', '"a,b"', "plain"]
    assert one(spark, T.json_string(X), 'a"\\\n\x01')[0] == 'a\\"\\\\\\n\\u0001'
    assert one(spark, T.transliterate(X), "Ñandú — ß漢")[0] == "Nandu - s?"
    assert one(spark, T.decompose_ligatures(X), "ﬁnal oﬃce")[0] == "final office" and one(spark, T.compose_ligatures(X), "final flow office")[0] == "ﬁnal ﬂow oﬃce"
    assert one(spark, T.identifier(X), "first name, (last)")[0] == "FirstNameLast" and one(spark, T.clean_label(X), " Name :__ ")[0] == "Name"
    assert one(spark, T.url_dangerous(X), " java\tscript:x", "https://a", "none")[:] == [True, False, False]
    assert one(spark, T.url_allowed(X), "HTTP://a", "ftp://a", "http://a\x01", None)[:] == [True, False, False, False]
    assert one(spark, T.win_ansi(X), 0x80, 65, 0x81, schema="x int") == ["€", "A", " "]
    assert one(spark, T.column_name(X), 0, 25, 26, 701, 702, 16383, schema="x int") == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert one(spark, T.sheet_name(X), "'a/b[c]'", "::", "x" * 40)[:] == ["abc", "Table", "x" * 31]
    assert one(spark, T.xml_text(X), "a<\x01&>")[0] == "a&lt;&amp;&gt;" and one(spark, T.pdf_string(X), "a(b)\\")[0] == "a\\(b\\)\\\\"


def test_geometry(spark):
    assert one(spark, G.normal_rotation(X), 45, 315, -90, 134, 224, 225, schema="x int") == [90, 0, 270, 90, 180, 270]
    m = G.matrix(*(F.lit(v) for v in (2.0, 0.0, 0.0, 4.0, 10.0, 20.0)))
    assert tuple(spark.range(1).select(G.transform(G.multiply(m, G.inverse(m)), F.lit(3.0), F.lit(5.0))).first()[0]) == (3.0, 5.0)
    assert G.permission_preset(G.READ_ONLY) < 0
    p = spark.range(1).select(G.permission_value(print=F.lit(True), copy=F.lit(False)).alias("p"))
    assert p.select(G.allows(F.col("p"), "print"), G.allows(F.col("p"), "copy"), G.allows(F.col("p"), "everything")).first()[:] == (True, False, False)
    r = lambda *v: G.rect(*(F.lit(float(x)) for x in v))
    row = spark.range(1).select(G.iou(r(0, 0, 10, 10), r(5, 0, 15, 10)), G.intersects(r(0, 0, 1, 1), r(1, 1, 2, 2)), G.iou(r(0, 0, 1, 1), r(5, 5, 6, 6))).first()
    assert row[0] == pytest.approx(1 / 3) and row[1] is True and row[2] == 0


def test_clusters(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 9.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(cluster.anchored(F.col("v"), 1.0)).collect()] == [[0, 0, 1, 2], []]
    assert [r[0] for r in df.select(cluster.running_means(F.col("v"), 1.5)).collect()] == [[1.0, 9.0], []]


def test_pages(spark):
    df = spark.createDataFrame([("d", i, c) for i, c in enumerate("abcd")], "doc_id string, page_index long, t string")
    show = lambda d: [r["t"] for r in d.orderBy("page_index").collect()]
    assert show(pages.extract(df, [2, 0])) == ["c", "a"] and show(pages.reorder(df, [3, 0, 1, 2])) == ["d", "a", "b", "c"]
    assert show(pages.duplicate(df, 1, 0)) == ["b", "a", "b", "c", "d"]
    assert sorted((r["part"], r["page_index"], r["t"]) for r in pages.split_ranges(df, [(0, 1), (1, 1)]).collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "b")]
    assert {r["status"] for r in pages.delete(df, [0, 1, 2, 3]).collect()} == {"CANNOT_DELETE_ALL"}
    with pytest.raises(ValueError):
        pages.reorder(df, [0, 0])


def test_graph(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 5, 6)], "k int, a long, b long")
    assert sorted((r["node"], r["component"]) for r in graph.components(e, ["k"]).collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    roots = spark.createDataFrame([(0, 1)], "k int, node long")
    assert sorted(r["node"] for r in graph.reachable(e, roots, "k", "a", "b").collect()) == [1, 2, 3]


def test_compare(spark):
    script, like = compare.word_script("a b c".split(), "a x c".split())
    assert script == [("unchanged", "a"), ("deleted", "b"), ("added", "x"), ("unchanged", "c")] and like == pytest.approx(2 / 3)
    box = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
    schema = f"d string, page_index int, paragraph_id int, text string, bbox {box}"
    a = spark.createDataFrame([("d", 0, 0, "same text", (0.0, 0.0, 50.0, 10.0)), ("d", 0, 1, "old words here", (0.0, 50.0, 50.0, 60.0)), ("d", 0, 2, "gone", (0.0, 500.0, 9.0, 510.0))], schema)
    b = spark.createDataFrame([("d", 0, 0, "same text", (0.0, 0.0, 50.0, 10.0)), ("d", 0, 1, "new words here", (0.0, 50.0, 50.0, 60.0))], schema)
    out = compare.compare_paragraphs(a, b, ["d"])
    assert [(r["kind"], r["base_text"], r["target_text"]) for r in out.orderBy("seq").collect()] == [("modified", "old words here", "new words here"), ("deleted", "gone", None)]
    assert compare.diff_summary(out, ["d"]).first()["modified"] == 1


def test_forms_and_tables(spark):
    box = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
    boxes = spark.createDataFrame([("d", 0, (100.0, 100.0, 200.0, 114.0), False), ("d", 1, (100.0, 300.0, 110.0, 310.0), True)], f"d string, candidate_id int, rect {box}, is_square boolean")
    lines = spark.createDataFrame([("d", 0, "Signature:", (40.0, 100.0, 90.0, 112.0), 102.0), ("d", 1, "I agree", (115.0, 300.0, 160.0, 310.0), 302.0)], f"d string, line_id int, text string, bbox {box}, baseline_y double")
    out = {r["candidate_id"]: r for r in forms.label_boxes(boxes, lines, ["d"]).collect()}
    assert (out[0]["label"], out[0]["field_type"], out[0]["confidence"]) == ("Signature", "signature", 0.92)
    assert (out[1]["suggested_name"], out[1]["field_type"]) == ("IAgree", "checkbox")
    fields = spark.createDataFrame([("d", (95.0, 95.0, 205.0, 120.0))], f"d string, field_rect {box}")
    assert [r["candidate_id"] for r in forms.without_taken(boxes, fields, ["d"]).collect()] == [1]
    cells = spark.createDataFrame([("t", 0, 0, "H|1"), ("t", 0, 1, "H2"), ("t", 1, 1, 'a "b"')], "t string, row_idx int, col_idx int, text string")
    rows = tables.matrix(cells, ["t"])
    assert tables.csv(rows, ["t"]).first()["csv"] == 'H|1,H2\r\n,"a ""b"""'
    assert tables.markdown(rows, ["t"]).first()["markdown"] == '| H\\|1 | H2 |\n| :--- | :--- |\n|  | a "b" |\n'
    assert "<th>H|1</th>" in tables.html(rows, ["t"]).first()["html"]


def test_sql_patterns_equal_python_on_random_text(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choices("a.@b-1 +c_2()&Ñ", k=rng.randint(0, 25))) for _ in range(2000)]
    got = one(spark, P.email(X), *texts)
    find = re.compile(P.EMAIL)
    assert got == [[m[1] for m in find.finditer(t)] for t in texts]
