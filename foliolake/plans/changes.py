"""Queries over files made from the part table: each file is changed, packed, merged or exported, then read again; SQL says what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import compare, documents, forms, reports, search
from ..sources.pdf.scan import scan, scans
from .catalog import part_files, parts, query, read

_PARTS = "(SELECT CAST(p_partkey AS VARCHAR) AS doc_id, * FROM part)"
_MAIL = "'mail p' || doc_id || '@example.com now'"
_LINES = f"p_name, 'Brand Size', p_brand || ' ' || CAST(p_size AS VARCHAR), {_MAIL}"


def box(x0: float, y0: float, x1: float, y1: float):
    return (float(x0), float(y0), float(x1), float(y1))


def lines(files: DataFrame, password: str = "") -> DataFrame:
    return scan(files.select("doc_id", "content"), "lines", password).select("doc_id", "text")


def tables(files: DataFrame, **wanted) -> DataFrame:
    """Several tables of each file, as arrays of rows, from one reading."""
    return scans(files.drop("report", "status"), wanted)


def found(files: DataFrame, table: str, password: str = "") -> DataFrame:
    return scan(files.select("doc_id", "content"), table, password)


# --- redaction, text ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, unnest([p_name, 'Brand Size', p_brand || ' ' || CAST(p_size AS VARCHAR)]) AS text FROM {_PARTS}")
def pdf_redact_rect(spark, sf_dir):
    return lines(documents.change(part_files(spark, sf_dir), "redact", 0, [box(60, 490, 500, 520)], label=""))


@query(f"SELECT doc_id, CAST(len({_MAIL}) AS INT) AS glyphs, 1 AS rects, 0 AS page_index FROM {_PARTS}")
def pdf_redact_report(spark, sf_dir):
    """What a redaction tells of itself."""
    out = documents.change(part_files(spark, sf_dir), "redact", 0, [box(60, 490, 500, 520)], label="")
    r = F.from_json("report", "glyphs int, rects int, page_index int")
    return out.select("doc_id", r["glyphs"].alias("glyphs"), r["rects"].alias("rects"), r["page_index"].alias("page_index"))


@query(f"SELECT doc_id, 0 AS files, '' AS value, CAST(0 AS BIGINT) AS left_over FROM {_PARTS}")
def pdf_purge(spark, sf_dir):
    """An address is taken out of the page, a field's value and an attachment."""
    import re

    mail = F.concat(F.lit("p"), "doc_id", F.lit("@example.com"))
    steps = [("add_attachment", ("note.txt", mail.cast("binary")), {}), ("create_field", (0, "who", "text", box(72, 400, 300, 420), mail), {}), ("redact_pattern", (re.compile(r"[\w.]+@[\w.]+"),), {"label": ""})]
    files = documents.change_all(part_files(spark, sf_dir), steps)
    own = tables(files.select("doc_id", "content"), attachments="attachments", fields="form_fields", lines="lines")
    kept = F.size(F.filter("attachments", lambda a: a["name"].isNotNull())).alias("files")
    left = F.size(F.filter("lines", lambda x: F.contains(x["text"], F.lit("@")))).cast("long").alias("left_over")
    return own.select("doc_id", kept, F.explode("fields.value").alias("value"), left)


@query(f"SELECT doc_id, unnest([p_name, 'Brand Size', p_brand || ' ' || CAST(p_size AS VARCHAR), 'mail p' || doc_id || '@example.it now']) AS text FROM {_PARTS}")
def pdf_replace(spark, sf_dir):
    return lines(documents.change(part_files(spark, sf_dir), "replace_text", "example.com", "example.it"))


@query(f"SELECT doc_id, 1 AS replacements, 1 AS paragraphs, false AS truncated FROM {_PARTS}")
def pdf_replace_report(spark, sf_dir):
    out = documents.change(part_files(spark, sf_dir), "replace_text", "EXAMPLE.com", "example.it")
    r = F.from_json("report", "replacements int, paragraphs int, truncated boolean")
    return out.select("doc_id", r["replacements"].alias("replacements"), r["paragraphs"].alias("paragraphs"), r["truncated"].alias("truncated"))


@query(f"SELECT doc_id, unnest([upper(p_name), 'Brand Size', p_brand || ' ' || CAST(p_size AS VARCHAR), {_MAIL}]) AS text FROM {_PARTS}")
def pdf_edit_paragraph(spark, sf_dir):
    return lines(documents.change(part_files(spark, sf_dir), "edit_paragraph", 0, 0, F.upper("p_name"), size=9.0))


@query(f"SELECT doc_id, unnest([{_LINES}, 'box ' || p_brand, 'Ann ' || CAST(p_size AS VARCHAR)]) AS text FROM {_PARTS}")
def pdf_text_box_sign(spark, sf_dir):
    steps = [("text_box", (0, box(72, 300, 400, 340), F.concat(F.lit("box "), "p_brand")), {}), ("fill_sign", (0, box(72, 200, 300, 230)), {"text": F.concat(F.lit("Ann "), "p_size")})]
    return lines(documents.change_all(part_files(spark, sf_dir), steps))


@query(f"SELECT doc_id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS author FROM {_PARTS}")
def pdf_scrub(spark, sf_dir):
    return found(documents.change(part_files(spark, sf_dir), "scrub_metadata"), "metadata").select("doc_id", "title", "author")


@query(f"SELECT doc_id, unnest([{_LINES}, 'Page 1 of 1', 'DRAFT ' || p_brand]) AS text FROM {_PARTS}")
def pdf_decorate(spark, sf_dir):
    steps = [("paginate", (), {}), ("text_watermark", (F.concat(F.lit("DRAFT "), "p_brand"),), {"degrees": 0, "size": 20.0})]
    return lines(documents.change_all(part_files(spark, sf_dir), steps))


# --- annotations and forms --------------------------------------------------------------------------------------------------


@query(
    f"SELECT doc_id, unnest(['Highlight', 'Link', 'Stamp', 'Line', 'Polygon']) AS subtype, unnest([p_name, NULL, p_brand, NULL, NULL]) AS contents, unnest([NULL, 'https://example.com/' || doc_id, NULL, NULL, NULL]) AS link_uri, "
    f"unnest([0.4, 1, 1, 1, 1])::DOUBLE AS opacity, unnest([0, 0, 0, 2, 3])::INT AS points FROM {_PARTS}"
)
def pdf_annotations(spark, sf_dir):
    steps = [
        ("markup", (0, "Highlight", box(72, 690, 140, 710)), {"contents": F.col("p_name")}),
        ("link", (0, box(0, 0, 10, 10)), {"uri": F.concat(F.lit("https://example.com/"), "doc_id")}),
        ("stamp", (0,), {"text": F.col("p_brand")}),
        ("shape", (0, "line", [(10.0, 10.0), (50.0, 20.0)]), {"width": 2.0}),
        ("shape", (0, "polygon", [(10.0, 10.0), (50.0, 20.0), (50.0, 60.0)]), {}),
    ]
    own = found(documents.change_all(part_files(spark, sf_dir), steps), "annotations")
    points = F.when(F.col("subtype").isin("Line", "Polygon"), F.size("points")).otherwise(0)
    return own.select("doc_id", "subtype", "contents", "link_uri", "opacity", points.alias("points"))


@query(f"SELECT doc_id, unnest(['Link', 'Square']) AS subtype FROM {_PARTS}")
def pdf_flatten_annotations(spark, sf_dir):
    """Highlights and stamps become page content; links and shapes stay."""
    steps = [
        ("markup", (0, "Highlight", box(72, 690, 140, 710)), {}), ("link", (0, box(0, 0, 10, 10)), {"uri": "https://example.com"}), ("stamp", (0, "draft"), {}),
        ("shape", (0, "square", [(10.0, 10.0), (50.0, 20.0)]), {}), ("flatten_annotations", (), {}),
    ]
    return found(documents.change_all(part_files(spark, sf_dir), steps), "annotations").select("doc_id", "subtype")


def _fields() -> list:
    """Changes that make a text field, a check box and a choice."""
    return [
        ("create_field", (0, "Maker", "text", box(72, 400, 300, 420), F.col("p_brand")), {"tooltip": "who"}),
        ("create_field", (0, "Big", "checkbox", box(72, 370, 84, 382)), {}),
        ("create_field", (0, "Kind", "choice", box(72, 340, 300, 360)), {"options": ["A", "B"]}),
    ]


@query(
    f"SELECT doc_id, unnest(['Maker', 'Big', 'Kind']) AS name, unnest(['text', 'checkbox', 'choice']) AS field_type, unnest([p_brand, CASE WHEN p_size > 25 THEN 'Yes' ELSE 'Off' END, 'B']) AS value, unnest(['who', NULL, NULL]) AS alt_name, 1 AS page_number FROM {_PARTS}"
)
def pdf_form_fields(spark, sf_dir):
    """Fields made and filled."""
    files = part_files(spark, sf_dir)
    big = F.create_map(F.lit("Big"), F.when(F.col("p_size") > 25, "yes").otherwise("no"), F.lit("Kind"), F.lit("B"))
    own = found(documents.change_all(files, [*_fields(), ("fill", (big,), {})]), "form_fields")
    return own.select("doc_id", "name", "field_type", "value", "alt_name", "page_number")


@query(f"SELECT doc_id, 'Kind' AS name, 'other' AS alt_name FROM {_PARTS}")
def pdf_update_fields(spark, sf_dir):
    steps = [*_fields(), ("update_field", ("Kind",), {"tooltip": "other"}), ("delete_field", ("Big",), {}), ("delete_field", ("Maker",), {})]
    return found(documents.change_all(part_files(spark, sf_dir), steps), "form_fields").select("doc_id", "name", "alt_name")


@query(f"SELECT doc_id, unnest([{_LINES}, p_brand]) AS text FROM {_PARTS}")
def pdf_flatten_forms(spark, sf_dir):
    return lines(documents.change_all(part_files(spark, sf_dir), [*_fields()[:2], ("flatten_forms", (), {})]))


@query(f"SELECT doc_id, 2 AS fields, 1 AS annotations FROM {_PARTS}")
def pdf_hard_flatten(spark, sf_dir):
    out = documents.change_all(part_files(spark, sf_dir), [*_fields()[:2], ("markup", (0, "Underline", box(72, 690, 140, 710)), {}), ("hard_flatten", (), {})])
    last = F.from_json(F.get_json_object("report", "$[3]"), "fields int, annotations int")
    return out.select("doc_id", last["fields"].alias("fields"), last["annotations"].alias("annotations"))


def _blank_forms(spark, sf_dir) -> DataFrame:
    """Forms to be filled in: labels, a rule, a box and a small square."""
    from ..sources.pdf import build

    rules = b"200 500 m 350 500 l S 150 450 200 20 re S 72 400 12 12 re S "

    @F.pandas_udf("binary")
    def made(brand):
        import pandas as pd

        return pd.Series([build.simple([[(72, 503, f"{b} date:", 12), (60, 455, "Signature ___", 12), (90, 402, "I agree", 12)]], rules=[rules]) for b in brand])

    return parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("doc_id"), made("p_brand").alias("content"))


_CANDIDATES = "unnest(['text', 'signature', 'checkbox']) AS field_type, unnest([p_brand || ' date', 'Signature', 'I agree']) AS label, unnest([0.88, 0.92, 0.9])::DOUBLE AS confidence"


@query(f"SELECT doc_id, unnest([0, 1, 2])::INT AS candidate_id, {_CANDIDATES} FROM {_PARTS}")
def pdf_form_candidates(spark, sf_dir):
    own = scan(_blank_forms(spark, sf_dir), "form_candidates").select("doc_id", "candidate_id", "field_type", "label", "confidence")
    first = F.min("candidate_id").over(Window.partitionBy("doc_id"))
    return own.withColumn("candidate_id", (F.col("candidate_id") - first).cast("int"))


@query(f"SELECT doc_id, CAST(3 AS BIGINT) AS fields, CAST(0 AS BIGINT) AS again FROM {_PARTS}")
def pdf_detected_fields(spark, sf_dir):
    """Fields put where they were detected; a second look finds none that aren't taken."""
    files = documents.add_detected_fields(_blank_forms(spark, sf_dir))
    fields = found(files, "form_fields").groupBy("doc_id").agg(F.count("*").alias("fields"))
    more = found(files, "form_candidates").where("candidate_id is not null").groupBy("doc_id").agg(F.count("*").alias("again"))
    return fields.join(more, "doc_id", "left").select("doc_id", "fields", F.coalesce("again", F.lit(0)).cast("long").alias("again"))


# --- document data ----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, upper(p_name) AS title, CAST(NULL AS VARCHAR) AS author, p_brand AS keywords FROM {_PARTS}")
def pdf_set_metadata(spark, sf_dir):
    values = F.create_map(F.lit("title"), F.upper("p_name"), F.lit("author"), F.lit(" "), F.lit("keywords"), F.col("p_brand"))
    return found(documents.change(part_files(spark, sf_dir), "set_metadata", values), "metadata").select("doc_id", "title", "author", "keywords")


@query(f"SELECT doc_id, unnest(['0', '0.0', '1']) AS path, unnest(['Part', 'Inner', 'Web']) AS title, unnest([1, 1, 0])::INT AS page_number, unnest([0, 700, 0])::DOUBLE AS top, unnest([NULL, NULL, 'https://example.com/x']) AS uri FROM {_PARTS}")
def pdf_outlines(spark, sf_dir):
    items = [{"path": [0], "title": "Part", "page_number": 1}, {"path": [0, 0], "title": "Inner", "page_number": 1, "top": 700.0}, {"path": [1], "title": "Web", "uri": "https://example.com/x"}]
    own = found(documents.change(part_files(spark, sf_dir), "set_outlines", items), "outlines")
    return own.select("doc_id", F.array_join("path", ".").alias("path"), "title", F.coalesce("page_number", F.lit(0)).alias("page_number"), F.coalesce("top", F.lit(0.0)).alias("top"), "uri")


@query(f"SELECT doc_id, 'part.txt' AS name, 'text/plain' AS mime, CAST(len(p_name) AS BIGINT) AS size, md5(p_name) AS md5, sha256(p_name) AS sha256, p_brand AS description FROM {_PARTS}")
def pdf_attachments(spark, sf_dir):
    steps = [("add_attachment", ("part.txt", F.col("p_name").cast("binary"), "text/plain", F.col("p_brand")), {}), ("add_attachment", ("gone.txt", b"x"), {}), ("delete_attachment", ("gone.txt",), {})]
    return found(documents.change_all(part_files(spark, sf_dir), steps), "attachments").select("doc_id", "name", "mime", "size", "md5", "sha256", "description")


@query(f"SELECT doc_id, p_brand AS name, p_size % 2 = 1 AS visible, false AS locked FROM {_PARTS}")
def pdf_layers(spark, sf_dir):
    steps = [("add_layer", (F.col("p_brand"),), {}), ("show_layer", (F.col("p_brand"), F.col("p_size") % 2 == 1), {}), ("add_layer", ("gone",), {}), ("delete_layer", ("gone",), {})]
    return found(documents.change_all(part_files(spark, sf_dir), steps), "layers").select("doc_id", "name", "visible", "locked")


@query(f"SELECT doc_id, unnest(CASE WHEN p_size % 2 = 0 THEN ['shown'] ELSE [p_name, 'shown'] END) AS text FROM {_PARTS}")
def pdf_hidden_layer(spark, sf_dir):
    """Text of a hidden layer is left out."""
    from ..sources.pdf import build, edit

    @F.pandas_udf("binary")
    def made(name, size):
        import pandas as pd

        from ..sources.pdf.cos import Document

        out = []
        for n, s in zip(name, size):
            doc = Document.load(build.simple([[(72, 700, "x", 12)]]))
            edit.add_layer(doc, "Secret", visible=bool(s % 2))
            edit.register_layer(doc, 0, "L1", "Secret")
            edit.set_content(doc, doc.pages()[0], b"/OC /L1 BDC " + build.text_line(72, 700, n) + b" EMC " + build.text_line(72, 600, "shown"))
            out.append(doc.save())
        return pd.Series(out)

    return lines(parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("doc_id"), made("p_name", "p_size").alias("content")))


@query(f"SELECT doc_id, CAST(p_size * 90 % 360 AS INT) AS rotation, 10.0::DOUBLE AS crop_x, (100 + p_size)::DOUBLE AS crop_right, 612.0::DOUBLE AS media_right FROM {_PARTS}")
def pdf_page_boxes(spark, sf_dir):
    edge = F.array(F.lit(10.0), F.lit(10.0), 100.0 + F.col("p_size"), F.lit(300.0))
    steps = [("rotate", (F.col("p_size") * 90,), {}), ("set_box", (0, "crop", edge), {})]
    own = found(documents.change_all(part_files(spark, sf_dir), steps), "pages")
    return own.select("doc_id", "rotation", F.col("crop.min_x").alias("crop_x"), F.col("crop.max_x").alias("crop_right"), F.col("media.max_x").alias("media_right"))


# --- whole files ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, 3 AS n_pages, '3,1' AS with_text FROM {_PARTS}")
def pdf_insert_pages(spark, sf_dir):
    """A blank page put in front and the old one copied behind it."""
    files = documents.change_all(part_files(spark, sf_dir), [("insert_blank", (0,), {}), ("duplicate_page", (1, 0), {})])
    own = found(files, "documents").select("doc_id", "n_pages")
    text = found(files, "lines").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("page_index") + 1), lambda a, b: b - a), ",").alias("with_text"))
    return own.join(text, "doc_id")


@query("SELECT CAST(p_size AS INT) AS k, CAST(part AS INT) AS part, CAST(least(3, n - 3 * part) AS INT) AS n_pages, 'OK' AS status FROM (SELECT p_size, n, unnest(range(CAST(ceil(n / 3.0) AS BIGINT))) AS part FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size))")
def pdf_split(spark, sf_dir):
    whole = documents.merge(part_files(spark, sf_dir).withColumnRenamed("p_size", "k"), ["k"], ["doc_id"]).select("k", "content")
    parts = documents.split(whole, 3)
    pages = scan(parts.select(F.concat_ws("/", "k", "part").alias("doc_id"), "content"), "documents").select("doc_id", "n_pages", F.col("status.code").alias("status"))
    key = F.split("doc_id", "/")
    return pages.select(key[0].cast("int").alias("k"), key[1].cast("int").alias("part"), "n_pages", "status")


@query("SELECT CAST(p_size AS INT) AS k, CAST(count(*) AS INT) AS n_inputs, 1 AS unreadable, 'NOT_PDF' AS why, CAST(count(*) AS INT) AS n_pages FROM part GROUP BY p_size")
def pdf_merge_status(spark, sf_dir):
    """A file that can't be read among those of each group."""
    files = part_files(spark, sf_dir).select("doc_id", F.col("p_size").alias("k"), "content")
    bad = files.select("k").distinct().select(F.lit("zz").alias("doc_id"), "k", F.lit(b"junk").alias("content"))
    whole = documents.merge(files.unionByName(bad), ["k"], ["doc_id"])
    wrong = F.filter("inputs", lambda s: s["code"] != "OK")
    told = whole.select(F.col("k").cast("string").alias("doc_id"), "content", (F.size("inputs") - F.size(wrong)).alias("n_inputs"), F.size(wrong).alias("unreadable"), wrong[0]["code"].alias("why"))
    own = tables(told, documents="documents")
    return own.select(F.col("doc_id").cast("int").alias("k"), "n_inputs", "unreadable", "why", F.explode("documents.n_pages").alias("n_pages"))


@query(f"SELECT doc_id, 'compressed' AS kind, true AS one_container, CAST(4 AS BIGINT) AS n_lines FROM {_PARTS}")
def pdf_packed(spark, sf_dir):
    """Object streams and a cross-reference stream, written and read."""
    files = documents.pack(part_files(spark, sf_dir))
    own = found(files, "xref").where("container is not null").groupBy("doc_id", "kind").agg((F.count_distinct("container") == 1).alias("one_container"))
    return own.join(lines(files).groupBy("doc_id").agg(F.count("*").alias("n_lines")), "doc_id")


@query(f"SELECT doc_id, true AS smaller, true AS any_duplicate, CAST(0 AS INT) AS active, CAST(4 AS BIGINT) AS n_lines FROM {_PARTS}")
def pdf_optimise(spark, sf_dir):
    """A file with its page twice is written smaller and reads the same."""
    files = documents.change_all(part_files(spark, sf_dir), [("add_attachment", ("a.txt", b"abc" * 200), {}), ("add_attachment", ("b.txt", b"abc" * 200), {})])
    out = documents.change(files.drop("report", "status"), "optimize")
    r = F.from_json("report", "size_before int, size_after int, duplicates int, active int")
    told = out.select("doc_id", (r["size_after"] < r["size_before"]).alias("smaller"), (r["duplicates"] >= 1).alias("any_duplicate"), r["active"].alias("active"))
    return told.join(lines(out).groupBy("doc_id").agg(F.count("*").alias("n_lines")), "doc_id")


def _locked(spark, sf_dir) -> DataFrame:
    """AES files; a user may change those of odd sizes only."""
    perms = F.when(F.col("p_size") % 2 == 1, G.permission_preset(("print", "modify", "copy"))).otherwise(G.permission_preset(("print",)))
    return documents.encrypt(part_files(spark, sf_dir), "own", "usr", perms.cast("int"), revision=4)


@query(f"SELECT doc_id, true AS encrypted, 'AES-128 (R4)' AS algorithm, 1 AS n_pages, p_size % 2 = 1 AS may_modify, 'BAD_PASSWORD' AS without FROM {_PARTS}")
def pdf_encrypted(spark, sf_dir):
    files = _locked(spark, sf_dir)
    own = tables(files.select("doc_id", "content"), opened=("documents", "usr"), shut="documents")
    told = own.select("doc_id", F.inline("opened"), F.col("shut")[0]["status"]["code"].alias("without"))
    return told.select("doc_id", "encrypted", "algorithm", "n_pages", G.allows(F.col("perms"), "modify").alias("may_modify"), "without")


@query(f"SELECT doc_id, CASE WHEN p_size % 2 = 1 THEN 'OK' ELSE 'PERMISSION_DENIED' END AS by_user, 'OK' AS by_owner, CASE WHEN p_size % 2 = 1 THEN 'OK' ELSE 'PERMISSION_DENIED' END AS reading FROM {_PARTS}")
def pdf_gates(spark, sf_dir):
    """What ``/P`` allows a user and an owner."""
    files = _locked(spark, sf_dir).select("doc_id", "content")
    code = F.col("status.code")
    user = documents.change(files.withColumn("sealed", F.col("content")), "scrub_metadata", password="usr").select("doc_id", "sealed", code.alias("by_user"))
    owner = documents.change(user.withColumn("content", F.col("sealed")), "scrub_metadata", password="own")
    text = tables(owner.select("doc_id", "by_user", code.alias("by_owner"), F.col("sealed").alias("content")), lines=("lines", "usr"))
    return text.select("doc_id", "by_user", "by_owner", F.explode(F.array_distinct("lines.status.code")).alias("reading"))


@query(f"SELECT doc_id, p_brand AS signer_name, 'ok' AS reason, true AS byte_range_valid FROM {_PARTS}")
def pdf_signatures(spark, sf_dir):
    return found(documents.change(part_files(spark, sf_dir), "attest", F.col("p_brand"), "ok"), "signatures").select("doc_id", "signer_name", "reason", "byte_range_valid")


@query(f"SELECT doc_id, 90 AS rotation, true AS revised, true AS kept, false AS covers_all FROM {_PARTS}")
def pdf_appended(spark, sf_dir):
    """A change put behind a signed file: the newest revision wins, the signed bytes stay, and the signature tells that it no longer covers all."""
    signed = documents.change(part_files(spark, sf_dir), "attest", "Ann").drop("report", "status")
    files = documents.append_saved(signed.withColumn("before", F.col("content")), "set_rotation", 0, 90)
    own = tables(files.select("doc_id", F.startswith("content", "before").alias("kept"), "content"), pages="pages", xref="xref", signatures="signatures")
    revised = (F.array_max("xref.revision") > F.array_min("xref.revision")).alias("revised")
    turned = own.select("doc_id", "kept", revised, "signatures", F.explode("pages.rotation").alias("rotation"))
    return turned.select("doc_id", "rotation", "revised", "kept", F.explode("signatures.byte_range_valid").alias("covers_all"))


@query(f"SELECT doc_id, unnest(['Document', 'Sect', 'P', 'Table']) AS struct_type, true AS any FROM {_PARTS}")
def pdf_tagged(spark, sf_dir):
    own = found(documents.tag(part_files(spark, sf_dir)), "struct_elements").where("struct_type in ('Document', 'Sect', 'P', 'Table')")
    return own.groupBy("doc_id", "struct_type").agg((F.count("*") > 0).alias("any"))


@query(f"SELECT doc_id, true AS not_embedded, true AS no_language, 'NOT_CONFORMING' AS status FROM {_PARTS}")
def pdf_conformance(spark, sf_dir):
    """What stands against PDF/A and PDF/UA, and what a conversion says."""
    files = part_files(spark, sf_dir)
    a = found(files, "archive_issues").groupBy("doc_id").agg(F.max(F.col("issue") == "FONT_NOT_EMBEDDED").alias("not_embedded"))
    u = found(files, "ua_issues").groupBy("doc_id").agg(F.max(F.col("issue") == "NO_LANGUAGE").alias("no_language"))
    return a.join(u, "doc_id").join(documents.to_archive(files).select("doc_id", F.col("status.code").alias("status")), "doc_id")


# --- pictures ---------------------------------------------------------------------------------------------------------------


def _pictures(spark, sf_dir) -> DataFrame:
    """Pages that are one picture, as a scanner makes them; its size depends on the part."""
    from ..sources.pdf import build

    @F.pandas_udf("binary")
    def made(size):
        import pandas as pd

        from ..sources.pdf import edit, extract
        from ..sources.pdf.cos import Document

        out = []
        for s in size:
            doc = Document.load(build.simple([[]]))
            page = doc.pages()[0]
            edit.resource(doc, page, "XObject", "Im", edit.add_image(doc, extract.encode_png(4 + int(s) % 5, 2, bytes([200] * (4 + int(s) % 5) * 6), True)))
            edit.set_content(doc, page, b"q 612 0 0 792 0 0 cm /Im Do Q")
            out.append(doc.save())
        return pd.Series(out)

    return parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("doc_id"), "p_size", made("p_size").alias("content"))


@query(f"SELECT doc_id, CAST(4 + p_size % 5 AS INT) AS width_px, 2 AS height_px, 8 AS bits, 612.0::DOUBLE AS right_edge, true AS is_scan FROM {_PARTS}")
def pdf_images(spark, sf_dir):
    files = _pictures(spark, sf_dir)
    own = found(files, "images").select("doc_id", "obj_num", "width_px", "height_px", "bits", F.round("bbox.max_x", 3).alias("right_edge"))
    scans = found(files, "scans").select("doc_id", "obj_num", F.lit(True).alias("is_scan"))
    return own.join(scans, ["doc_id", "obj_num"], "left").select("doc_id", "width_px", "height_px", "bits", "right_edge", F.coalesce("is_scan", F.lit(False)).alias("is_scan"))


@query(f"SELECT doc_id, 'Word' || doc_id AS text FROM {_PARTS}")
def pdf_text_layer(spark, sf_dir):
    """A recogniser's words put under a scanned page; words of no confidence are left out."""
    tsv = F.concat(F.lit("level\tleft\ttop\twidth\theight\tconf\ttext\n5\t0\t0\t2\t1\t90\tWord"), "doc_id", F.lit("\n5\t0\t0\t1\t1\t-1\tno"))
    return lines(documents.recognised(_pictures(spark, sf_dir), 0, tsv, 4 + F.col("p_size") % 5, F.lit(2)))


@query(f"SELECT doc_id, 306 AS width_px, 396 AS height_px, 'OK' AS status FROM {_PARTS}")
def pdf_render(spark, sf_dir):
    """Pages as pictures."""
    pictures = documents.render(part_files(spark, sf_dir), "png", 36)
    at = lambda k: F.conv(F.hex(F.substring("picture", k, 4)), 16, 10).cast("int")
    return pictures.select("doc_id", at(17).alias("width_px"), at(21).alias("height_px"), F.col("status.code").alias("status"))


@query(f"SELECT doc_id, unnest(['docx', 'pptx', 'xlsx']) AS kind, true AS has_title FROM {_PARTS}")
def pdf_office(spark, sf_dir):
    """Office packages; the part that holds the text is read back."""
    files = part_files(spark, sf_dir)
    parts = {"docx": ("word/document.xml", "p_name"), "pptx": ("ppt/slides/slide1.xml", "p_name"), "xlsx": ("xl/worksheets/sheet1.xml", "p_brand")}
    out = None
    for kind, (part, column) in parts.items():
        own = documents.export_as(files, kind).select("doc_id", F.lit(kind).alias("kind"), F.contains(reports.package_part(F.col("content"), part), F.col(column)).alias("has_title"))
        out = own if out is None else out.unionByName(own)
    return out


# --- reading ----------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, unnest(['BT', 'ET', 'Tf', 'Tj', 'Tm', 'S']) AS operator, unnest([6, 6, 6, 6, 6, 6])::BIGINT AS n FROM {_PARTS}")
def pdf_operators(spark, sf_dir):
    return found(part_files(spark, sf_dir), "ops").where("operator in ('BT', 'ET', 'Tf', 'Tj', 'Tm', 'S')").groupBy("doc_id", "operator").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, 'Helvetica' AS base_font, 'sans-serif' AS family, 400 AS weight, false AS is_composite FROM {_PARTS}")
def pdf_fonts(spark, sf_dir):
    return found(part_files(spark, sf_dir), "fonts").select("doc_id", "base_font", "family", "weight", "is_composite")


@query(f"SELECT doc_id, CAST(len(p_name) + 9 + len(p_brand) + len(CAST(p_size AS VARCHAR)) + len({_MAIL}) AS BIGINT) AS glyphs, true AS onward FROM {_PARTS}")
def pdf_glyphs(spark, sf_dir):
    """Every character once; within a run each begins where the one before ends."""
    own = Window.partitionBy("doc_id", "node", "y").orderBy("seq")
    g = found(part_files(spark, sf_dir), "glyphs").withColumn("gap", F.col("x") - F.lag("x").over(own) - F.lag("advance").over(own))
    return g.groupBy("doc_id").agg(F.count("*").alias("glyphs"), F.min(F.coalesce(F.abs("gap") < 0.01, F.lit(True)) | (F.abs("gap") > 20)).alias("onward"))


@query(f"SELECT doc_id, 'Catalog' AS root, true AS reaches_all FROM {_PARTS}")
def pdf_objects(spark, sf_dir):
    """Objects and their references: what the catalogue reaches is everything but the information dictionary."""
    objects = found(part_files(spark, sf_dir), "cos_objects")
    told = objects.groupBy("doc_id").agg(
        F.max(F.when(F.contains("value", F.lit("/Type /Catalog")), "Catalog")).alias("root"), F.flatten(F.collect_list("refs")).alias("refs"),
        F.collect_set(F.when(~F.contains("value", F.lit("/Type /Catalog")) & ~F.contains("value", F.lit("/Title")), F.col("num"))).alias("nums"),
    )
    return told.select("doc_id", "root", (F.size(F.array_except("nums", "refs")) == 0).alias("reaches_all"))


@query(f"SELECT doc_id, {_MAIL} AS text, 'left' AS alignment, 1 AS line_count FROM {_PARTS}")
def pdf_paragraphs(spark, sf_dir):
    own = found(part_files(spark, sf_dir), "paragraphs").where(F.col("text").startswith("mail"))
    return own.select("doc_id", "text", "alignment", "line_count")


@query(f"SELECT doc_id, CAST(6 + len(doc_id) AS INT) AS char_start, 72.0::DOUBLE AS line_left FROM {_PARTS}")
def pdf_hit_boxes(spark, sf_dir):
    """Search over paragraphs, with the boxes of the lines a hit touches."""
    files = part_files(spark, sf_dir)
    keys = ["doc_id", "page_index", "paragraph_id"]
    hits = search.search(found(files, "paragraphs"), "@example", keys)
    boxed = search.hit_boxes(hits, found(files, "lines"), keys)
    return boxed.select("doc_id", "char_start", F.round("bbox.min_x", 3).alias("line_left"))


@query(f"SELECT doc_id, unnest(['A', 'B']) AS first, unnest([p_brand, CAST(p_size AS VARCHAR)]) AS second FROM {_PARTS}")
def pdf_borderless(spark, sf_dir):
    """Tables told by alignment alone."""
    from ..sources.pdf import build

    @F.pandas_udf("binary")
    def made(brand, size):
        import pandas as pd

        out = []
        for b, s in zip(brand, size):
            rows = [(700, "A", b), (680, "B", str(s)), (660, "C", "last")]
            out.append(build.simple([[(72, y, x, 12) for y, x, _ in rows] + [(250, y, z, 12) for y, _, z in rows]]))
        return pd.Series(out)

    files = parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("doc_id"), made("p_brand", "p_size").alias("content"))
    cells = found(files, "table_cells").groupBy("doc_id", "row_idx").agg(F.max(F.when(F.col("col_idx") == 0, F.col("text"))).alias("first"), F.max(F.when(F.col("col_idx") == 1, F.col("text"))).alias("second"))
    return cells.where("row_idx < 2").select("doc_id", "first", "second")


# --- comparison and reports -------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, 'modified' AS kind, {_MAIL} AS base_text, 'mail p' || doc_id || '@example.it now' AS target_text, 'mail,now' AS unchanged FROM {_PARTS}")
def pdf_compare(spark, sf_dir):
    """Paragraphs of a file and its changed copy."""
    files = part_files(spark, sf_dir)
    changed = documents.change(files, "replace_text", "example.com", "example.it")
    out = compare.compare_paragraphs(found(files, "paragraphs"), found(changed, "paragraphs"), ["doc_id"])
    same = F.transform(F.filter("words", lambda w: w["kind"] == "unchanged"), lambda w: w["text"])
    return out.select("doc_id", "kind", "base_text", "target_text", F.array_join(same, ",").alias("unchanged"))


@query(f"SELECT doc_id, 1 AS modified, 0 AS added, 1 AS pages_added, false AS identical FROM {_PARTS} WHERE p_size % 2 = 1 UNION ALL SELECT doc_id, 0, 0, 0, true FROM {_PARTS} WHERE p_size % 2 = 0")
def pdf_compare_documents(spark, sf_dir):
    """Whole documents: files of odd sizes are changed and get a page more."""
    files = part_files(spark, sf_dir)
    odd = documents.change_all(files.where("p_size % 2 = 1"), [("replace_text", ("example.com", "example.it"), {}), ("insert_blank", (1,), {})])
    other = odd.select("doc_id", "content").unionByName(files.where("p_size % 2 = 0").select("doc_id", "content"))
    read = {t: t for t in ("pages", "paragraphs", "images", "metadata")}
    told = compare.compare_scans(tables(files.select("doc_id", "content"), **read), tables(other, **read), ["doc_id"])
    r = F.from_json(reports.json_of(told, ["doc_id"]), "paragraphs struct<modified int, added int>, pages struct<added int>, identical boolean")
    return told.select("doc_id", r["paragraphs"]["modified"].alias("modified"), r["paragraphs"]["added"].alias("added"), r["pages"]["added"].alias("pages_added"), r["identical"].alias("identical"))


@query(f"SELECT doc_id, 'modified' AS kind FROM {_PARTS} WHERE p_size % 5 <> 0")
def pdf_image_diff(spark, sf_dir):
    """Pictures are paired by name or place; those of another size are modified."""
    files = _pictures(spark, sf_dir)
    plain = files.select("doc_id", "p_size", "content")
    four = _pictures(spark, sf_dir).where("p_size % 5 = 0").limit(1).select(F.col("content").alias("one"))
    other = plain.join(F.broadcast(four)).select("doc_id", F.col("one").alias("content"))
    return compare.diff_images(found(plain, "images"), found(other, "images"), ["doc_id"]).select("doc_id", "kind")


@query(f"SELECT doc_id, 0 AS page_index, p_name AS first_text, 72.0::DOUBLE AS min_x FROM {_PARTS}")
def pdf_scene_json(spark, sf_dir):
    """The scene of each page as JSON, read back."""
    scene = reports.scene_json(found(part_files(spark, sf_dir), "paragraphs"))
    r = F.from_json("scene", "page_index int, paragraphs array<struct<text:string,bbox:array<double>>>")
    return scene.select("doc_id", r["page_index"].alias("page_index"), r["paragraphs"][0]["text"].alias("first_text"), r["paragraphs"][0]["bbox"][0].alias("min_x"))


@query(f"SELECT doc_id, 2 AS n_rows, 2 AS n_cols, p_brand AS brand FROM {_PARTS}")
def pdf_table_json(spark, sf_dir):
    made = reports.table_json(found(part_files(spark, sf_dir), "table_cells"))
    r = F.from_json("json", "rows int, columns int, cells array<struct<row:int,col:int,text:string>>")
    return made.select("doc_id", r["rows"].alias("n_rows"), r["columns"].alias("n_cols"), F.filter(r["cells"], lambda c: (c["row"] == 1) & (c["col"] == 0))[0]["text"].alias("brand"))


@query(f"SELECT doc_id, '<th>Brand</th>' AS head, '<td>' || p_brand || '</td>' AS cell FROM {_PARTS}")
def pdf_table_html(spark, sf_dir):
    from ..operators import tables

    rows = tables.matrix(found(part_files(spark, sf_dir), "table_cells").select("doc_id", "row_idx", "col_idx", "text"), ["doc_id"])
    html = tables.html(rows, ["doc_id"])
    return html.select("doc_id", F.regexp_extract("html", "(<th>.*?</th>)", 1).alias("head"), F.regexp_extract("html", "(<td>.*?</td>)", 1).alias("cell"))


# --- functions and patterns that no file is needed for ------------------------------------------------------------------------


@query("SELECT p_partkey, replace(replace(replace(p_name || ' (' || p_brand || ')', '\\', '\\\\'), '(', '\\('), ')', '\\)') AS escaped, CASE WHEN p_size % 2 = 0 THEN 128 ELSE 233 END AS code FROM part")
def pdf_string_escape(spark, sf_dir):
    made = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return read(spark, sf_dir, "part").select("p_partkey", T.pdf_string(made).alias("escaped"), T.win_ansi_codes(F.when(F.col("p_size") % 2 == 0, "€").otherwise("é"))[0].alias("code"))


@query("SELECT l_orderkey, l_linenumber, round((1 - l_discount) * (1 - l_tax), 9) AS red, round(l_tax, 9) AS gray FROM lineitem")
def colours(spark, sf_dir):
    zero = F.lit(0.0)
    rgb = G.rgb_from_cmyk(F.col("l_discount"), zero, zero, F.col("l_tax"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(rgb[0], 9).alias("red"), F.round(G.rgb_from_gray(F.col("l_tax"))[2], 9).alias("gray"))


@query("SELECT l_orderkey, l_linenumber, l_quantity <= 30 AND l_quantity + 10 >= 20 AND l_tax * 100 <= 5 AND l_tax * 100 + 12 >= 3 AS touches FROM lineitem")
def rect_touches(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_tax") * 100
    own = G.rect(x, y, x + 10, y + 12)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.intersects(own, G.rect(F.lit(20.0), F.lit(3.0), F.lit(30.0), F.lit(5.0))).alias("touches"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS x, round(l_extendedprice, 6) AS y FROM lineitem")
def affine_inverse(spark, sf_dir):
    """A matrix times its inverse leaves points where they were."""
    m = G.matrix(*(F.lit(float(v)) for v in (2, -1, 0.5, 3, 10, -20)))
    p = G.transform(G.multiply(m, G.inverse(m)), F.col("l_quantity"), F.col("l_extendedprice"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query(
    "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_linenumber > 1 AND NOT EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_linenumber = 1 AND l.l_quantity + 5 BETWEEN f.l_quantity AND f.l_quantity + 10 AND l.l_tax * 100 + 6 BETWEEN f.l_tax * 100 AND f.l_tax * 100 + 12)"
)
def fields_not_taken(spark, sf_dir):
    """Candidates whose centre lies in no field that is there."""
    x, y = F.col("l_quantity"), F.col("l_tax") * 100
    rects = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.rect(x, y, x + 10, y + 12).alias("rect"))
    fields = rects.where("l_linenumber = 1").select("l_orderkey", F.col("rect").alias("field_rect"))
    return forms.without_taken(rects.where("l_linenumber > 1"), fields, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderpriority || CASE WHEN n > 1 THEN '_' || CAST(n AS VARCHAR) ELSE '' END AS name FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)")
def unique_field_names(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("name"))
    return forms.unique_names(orders, ["o_custkey"], "name", ["o_orderkey"]).select("o_orderkey", "name")


@query("SELECT doc_id, CAST((len(text) - len(replace(text, 'ab', ''))) / 2 AS BIGINT) AS n FROM documents WHERE contains(text, 'ab')")
def substring_matches(spark, sf_dir):
    from ..functions import patterns as P

    docs = read(spark, sf_dir, "documents").where(F.contains("text", F.lit("ab")))
    return docs.select("doc_id", F.size(P.literal(F.col("text"), "ab")).cast("long").alias("n"))
